"""What an issue shows of the page: evidence as JSON, and a description, per audit rule.

Names of evidence fields are the data format that exports and the issue listing read. Lists are cut where the format cuts
them; lists of linking pages, which the format leaves open, are cut at ``LISTED``, with the whole count beside them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import blank, trimmed, utf16_length

#: Pages that a list without a limit of its own names.
LISTED = 50


def fields(**values) -> Column:
    """A JSON object; nulls are kept, and plain values are constants."""
    made = [(v if isinstance(v, Column) else F.lit(v).cast("string") if v is None else F.lit(v)).alias(name) for name, v in values.items()]
    return F.to_json(F.struct(*made), {"ignoreNullFields": "false"})


def fixed(value: Column, digits: int) -> Column:
    """A number as text with so many digits, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("decimal(30,10)"), digits).cast("double"))


def first(array: Column, n: int, *names: str) -> Column:
    """The first ``n`` items, reduced to some of their fields; one field is given bare."""
    cut = F.slice(array, 1, n)
    if len(names) == 1:
        return F.transform(cut, lambda i: i[names[0]])
    return F.transform(cut, lambda i: F.struct(*[i[n].alias(n) for n in names])) if names else cut


def evidence(tests: dict) -> dict[str, Column]:
    """JSON per rule id. ``tests`` are the item tests that rules share with their evidence."""
    c = F.col
    status, url, title, words = c("status_code"), c("url"), c("title"), c("word_count")
    slow, size = c("response_time"), c("page_size")
    depth = F.size("segs")
    images = lambda test: F.filter("images", tests[test])
    inner, outer = lambda test: F.filter("internal_links", tests[test]), lambda test: F.filter("external_links", tests[test])
    tags = lambda test: F.filter("hreflang_tags", test)
    count = lambda a: F.coalesce(F.size(a), F.lit(0))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    pair = lambda a, *names: F.coalesce(F.transform(a, lambda i: F.struct(*[i[n].alias(n) for n in names])), none("struct<" + ", ".join(f"{n}: string" for n in names) + ">"))
    plain = F.concat(F.coalesce(first(images("plain_image"), 1 << 30, "src"), none("string")), F.coalesce(first(inner("plain_link"), 1 << 30, "href"), none("string")))
    unnamed = F.concat(pair(inner("no_text"), "href", "text"), pair(outer("no_text"), "href", "text"))
    generic = F.concat(pair(inner("generic"), "href", "text"), pair(outer("generic"), "href", "text"))
    langs = F.transform("hreflang_tags", lambda t: F.lower(t["lang"]))
    repeated = F.filter(F.array_distinct(langs), lambda x: F.size(F.filter(langs, lambda y: y == x)) > 1)
    bad_tag, relative = lambda t: ~F.coalesce(F.lower(t["lang"]).rlike(tests["language_tag"]), F.lit(False)), lambda t: ~F.coalesce(t["href"].rlike("^https?://"), F.lit(False))
    secure, mixed = tags(lambda t: F.coalesce(t["href"].startswith("https://"), F.lit(False))), tags(lambda t: F.coalesce(t["href"].startswith("http://"), F.lit(False)))
    protocol = lambda u: F.when(F.coalesce(u.startswith("https://"), F.lit(False)), "https").otherwise("http")
    others = F.filter(c("title_list"), lambda u: u != url)
    n_all = c("n_img") + c("n_il") + c("n_xl")
    structured = lambda rule: F.try_element_at("jsonld_findings", F.lit(rule))
    code = lambda i: F.coalesce(i["status_code"], F.lit(0)).alias("statusCode")
    chain = lambda i: F.coalesce(i["redirect_chain"], none("string")).alias("redirectChain")
    og = c("og_tags")
    social = lambda name: fields(ogTags=og, missingTag=f"og:{name}")
    return {
        "IDX-001": fields(metaRobots=c("meta_robots"), detectedDirectives=c("directives")),
        "IDX-002": fields(metaRobots=c("meta_robots"), wordCount=words, title=title, h1Count=c("n_h1")),
        "IDX-003": fields(totalPagesChecked=c("n_pages"), inboundLinkCount=0),
        "IDX-004": fields(canonicalUrl=c("canonical_url"), canonicalStatusCode=c("canon_status")),
        "IDX-005": fields(inboundLinkCount=c("inbound"), hasCanonical=False, statusCode=status),
        "IDX-006": fields(metaRobots=c("meta_robots"), internalLinkCount=c("n_il")),
        "IDX-007": fields(depth=depth, pathSegments=c("segs")),
        "IDX-008": fields(wordCount=words, title=title),
        "CRW-001": fields(statusCode=status, canonicalUrl=c("canonical_url"), targetCanonicalUrl=c("loop_canonical")),
        "CRW-002": fields(statusCode=status, linkingPages=c("linking_list"), linkingPageCount=c("linking_pages")),
        "CRW-003": fields(statusCode=status),
        "CRW-004": fields(hops=c("hops"), chain=first(c("chain"), 10)),
        "CRW-005": fields(statusCode=status, title=title, wordCount=words),
        "CRW-006": fields(paramCount=F.size("names"), params=urls.query_map("url")),
        "CRW-007": fields(mixedContentCount=F.size(plain), examples=plain),
        "CRW-008": fields(responseTimeMs=slow, responseTimeSec=fixed(slow / 1000, 1), threshold=3000),
        "CRW-009": fields(statusCode=status),
        "CRW-010": fields(statusCode=status, canonicalTarget=c("canonical_url")),
        "OPG-001": fields(title=title),
        "OPG-002": fields(title=title, duplicateUrls=first(others, 10), duplicateCount=c("title_urls") - 1),
        "OPG-003": fields(title=title, length=utf16_length("title"), maxRecommended=60),
        "OPG-004": fields(h1Count=0),
        "OPG-005": fields(h1Count=c("n_h1"), h1Tags=c("h1")),
        "OPG-006": fields(metaDescription=None),
        "OPG-007": fields(metaDescription=c("meta_description"), length=utf16_length("meta_description"), maxRecommended=160),
        "OPG-008": fields(wordCount=words, minRecommended=300),
        "OPG-009": fields(title=title, length=utf16_length(trimmed(title)), minRecommended=10),
        "OPG-010": fields(metaDescription=c("meta_description")),
        "PRF-001": fields(responseTimeMs=slow, threshold=5000),
        "PRF-002": fields(pageSizeBytes=size, pageSizeMB=fixed(size / (1024 * 1024), 2), threshold="3 MB"),
        "PRF-003": fields(responseTimeMs=slow, threshold=1000),
        "PRF-004": fields(pageSizeBytes=size, pageSizeKB=fixed(size / 1024, 0), threshold="1 MB"),
        "PRF-005": fields(imageCount=c("n_img"), threshold=50),
        "PRF-006": fields(internalLinkCount=c("n_il"), threshold=200),
        "PRF-007": fields(responseTimeMs=slow, siteAverageMs=F.floor(c("avg_response") + 0.5), multiplier=fixed(slow / c("avg_response"), 1)),
        "PRF-008": fields(pageSizeKB=fixed(size / 1024, 0), siteAverageKB=fixed(c("avg_size") / 1024, 0), multiplier=fixed(size / c("avg_size"), 1)),
        "SD-001": fields(jsonLdCount=0),
        "SD-007": fields(depth=depth, hasBreadcrumbSchema=False),
        **{rule: structured(rule) for rule in ("SD-002", "SD-003", "SD-004", "SD-005", "SD-006", "SD-008", "SD-009", "SD-010", "SD-011", "SD-012")},
        "IMG-001": fields(totalImages=c("n_img"), missingAltCount=count(images("no_alt")), examples=first(images("no_alt"), 5, "src")),
        "IMG-002": fields(longAltCount=count(images("long_alt")), examples=F.transform(first(images("long_alt"), 5), lambda i: F.struct(i["src"].alias("src"), utf16_length(i["alt"]).alias("altLength")))),
        "IMG-003": fields(totalImages=c("n_img"), missingDimensionsCount=count(images("no_size")), examples=first(images("no_size"), 5, "src")),
        "IMG-004": fields(oversizedCount=count(images("oversized")), examples=first(images("oversized"), 5, "src", "width", "height")),
        "IMG-005": fields(genericAltCount=count(images("generic_alt")), examples=first(images("generic_alt"), 5, "src", "alt")),
        "IMG-006": fields(httpImageCount=count(images("plain_image")), examples=first(images("plain_image"), 5, "src")),
        "IMG-007": fields(imageCount=c("n_img"), threshold=30),
        "IMG-008": fields(imageCount=c("n_img"), missingAltCount=c("n_img")),
        "LNK-001": fields(internalLinkCount=0),
        "LNK-002": fields(internalLinkCount=c("n_il"), minRecommended=3),
        "LNK-003": fields(externalLinkCount=c("n_xl"), threshold=100),
        "LNK-004": fields(emptyAnchorCount=F.size(unnamed), examples=first(F.transform(unnamed, lambda i: i["href"]), 10)),
        "LNK-005": fields(genericLinkCount=F.size(generic), examples=generic),
        "LNK-006": fields(redirectedLinkCount=c("links_moved"), examples=c("moved_list")),
        "LNK-007": fields(brokenLinkCount=c("links_broken"), examples=c("broken_list")),
        "LNK-008": fields(selfLinkCount=c("links_self"), examples=first(c("self_list"), 5)),
        "LNK-009": fields(
            brokenExternalLinkCount=count(outer("broken_out")),
            examples=F.transform(first(outer("broken_out"), 50), lambda i: F.struct(i["href"].alias("href"), code(i), i["error"].alias("error"))),
        ),
        "LNK-010": fields(
            redirectingExternalLinkCount=count(outer("moved_out")),
            examples=F.transform(first(outer("moved_out"), 50), lambda i: F.struct(i["href"].alias("href"), code(i), chain(i))),
        ),
        "I18N-001": fields(hreflangTags=c("hreflang_tags"), pageUrl=url),
        "I18N-002": fields(hreflangTags=c("hreflang_tags"), languages=F.transform("hreflang_tags", lambda t: t["lang"])),
        "I18N-003": fields(nonReciprocalCount=c("alternates_one_way"), nonReciprocalTargets=c("one_way_list")),
        "I18N-004": fields(invalidTags=tags(bad_tag)),
        "I18N-005": fields(badTargets=c("bad_list")),
        "I18N-006": fields(duplicates=F.transform(repeated, lambda x: F.struct(x.alias("lang"), F.size(F.filter(langs, lambda y: y == x)).alias("count")))),
        "I18N-007": fields(relativeUrlCount=F.size(tags(relative)), examples=first(tags(relative), 5)),
        "I18N-008": fields(pageLanguages=F.array_distinct(langs), missingLanguages=F.array_except("site_langs", langs), siteLanguages=c("site_langs")),
        "CAN-001": fields(canonicalUrl=None),
        "CAN-002": fields(pageHost=urls.host("url"), canonicalHost=urls.host(c("canon_norm")), canonicalUrl=c("canonical_url")),
        "CAN-003": fields(pageCanonical=c("canonical_url"), targetCanonical=c("target_canonical")),
        "CAN-004": fields(canonicalUrl=c("canonical_url"), paramCount=F.size(urls.query_names("canonical_url")), params=urls.query_map("canonical_url")),
        "CAN-005": fields(pageUrl=url, canonicalUrl=c("canonical_url")),
        "CAN-006": fields(canonicalUrl=c("canonical_url")),
        "CAN-007": fields(metaRobots=c("meta_robots"), canonicalUrl=c("canonical_url")),
        "CAN-008": fields(canonicalizingPageCount=c("canon_incoming"), examples=first(c("canon_list"), 10)),
        "SEC-001": fields(protocol="http"),
        "SEC-002": fields(httpImageCount=count(images("plain_image")), examples=first(images("plain_image"), 5, "src")),
        "SEC-003": fields(httpLinkCount=count(inner("plain_link")), examples=first(inner("plain_link"), 5, "href")),
        "SEC-004": fields(httpExternalCount=count(outer("plain_link")), examples=first(outer("plain_link"), 10, "href")),
        "SEC-005": fields(pageProtocol=protocol(url), canonicalProtocol=protocol(c("canonical_url")), canonicalUrl=c("canonical_url")),
        "SEC-006": fields(externalLinkCount=c("n_xl")),
        "SEC-007": fields(httpCount=F.size(mixed), httpsCount=F.size(secure), httpExamples=first(mixed, 3, "href")),
        "SEC-008": fields(sensitiveParams=F.array_intersect(c("names"), F.array(*map(F.lit, tests["secret_parameters"])))),
        "MOB-001": fields(largeFixedImageCount=count(images("wide")), totalImages=c("n_img"), examples=first(images("wide"), 3, "src", "width")),
        "MOB-002": fields(title=title, length=utf16_length("title"), mobileLimit=50),
        "MOB-003": fields(pageSizeKB=fixed(size / 1024, 0), thresholdKB=500),
        "MOB-004": fields(responseTimeMs=slow, mobileImpact="Mobile networks add their own delay"),
        "MOB-005": fields(imageCount=c("n_img"), internalLinkCount=c("n_il"), externalLinkCount=c("n_xl"), totalResources=n_all),
        "MOB-006": fields(depth=depth, path=urls.path("url")),
        "MOB-007": fields(wordCount=words, threshold=5000),
        "MOB-008": fields(missingDimensionsCount=count(images("no_size")), totalImages=c("n_img"), percentageMissing=F.concat(fixed(100 * count(images("no_size")) / c("n_img"), 0), F.lit("%"))),
        "SOC-001": fields(ogTags=None),
        "SOC-002": social("title"),
        "SOC-003": social("description"),
        "SOC-004": social("image"),
        "SOC-005": social("url"),
        "SOC-006": social("type"),
        "SOC-007": fields(ogImage=F.try_element_at("og_tags", F.lit("og:image"))),
        "SOC-008": fields(ogUrl=F.try_element_at("og_tags", F.lit("og:url")), canonicalUrl=c("canonical_url")),
    }


def is_blank_text(item: Column) -> Column:
    return blank(item["text"])


DESCRIPTIONS = {
    "IDX-001": "A robots directive keeps the page out of search indexes; remove noindex if it should be found.",
    "IDX-002": "The page has real content, yet noindex hides it; check that this is meant.",
    "IDX-003": "No crawled page links here, so visitors and crawlers hardly reach it; link to it from related pages.",
    "IDX-004": "The canonical names a page that does not answer 200; point it at a live page.",
    "IDX-005": "Many pages link here but nothing says how to index it; add a canonical or a robots directive.",
    "IDX-006": "A nofollow directive stops crawlers at the links of this page; drop it unless it is meant.",
    "IDX-007": "The url lies deep in the hierarchy, where pages are crawled rarely; shorten the path.",
    "IDX-008": "There is next to no text to index; add content or exclude the page.",
    "CRW-001": "The redirect comes back to its start, so nothing is ever shown; end it at a page that answers 200.",
    "CRW-002": "The page is missing although internal pages link to it; restore it, redirect it or mend the links.",
    "CRW-003": "The server failed on this url; look into its logs and restore the answer.",
    "CRW-004": "Several redirects follow each other; lead the first straight to the last target.",
    "CRW-005": "It reads like an error page but answers 200; answer 404 or 410 instead.",
    "CRW-006": "Many parameters make many urls of one page; use fewer, or a canonical.",
    "CRW-007": "A secure page refers to insecure addresses, which browsers block or warn of; use https.",
    "CRW-008": "The answer takes over three seconds; speed up the server or cache it.",
    "CRW-009": "The url answers with a client error; restore it, redirect it or remove what leads to it.",
    "CRW-010": "The url redirects; link to its target instead.",
    "OPG-001": "There is no title for results and tabs to show; write one.",
    "OPG-002": "Other pages bear the same title; give each a title of its own.",
    "OPG-003": "Search results will cut the title; keep it within 60 characters.",
    "OPG-004": "No main heading says what the page is about; add one.",
    "OPG-005": "Several main headings compete; keep one and demote the others.",
    "OPG-006": "There is no description for search results; write one.",
    "OPG-007": "Search results will cut the description; keep it within 160 characters.",
    "OPG-008": "There is little text; say more, or merge the page with another.",
    "OPG-009": "The title says too little; use at least ten characters.",
    "OPG-010": "The description tag is blank; fill it.",
    "PRF-001": "The answer takes over five seconds, and visitors leave; find what delays it.",
    "PRF-002": "The page weighs over three megabytes; compress or split it.",
    "PRF-003": "The answer takes over a second; there is room for speed.",
    "PRF-004": "The page weighs over a megabyte; trim markup, scripts and images.",
    "PRF-005": "Over 50 images have to load; load them late or use fewer.",
    "PRF-006": "Over 200 internal links thin out each one's weight; keep those that matter.",
    "PRF-007": "The answer takes over three times as long as the site's mean; compare it with faster pages.",
    "PRF-008": "The page is over five times as large as the site's mean; look for what bloats it.",
    "SD-001": "There is no structured data; add a block that fits the page.",
    "SD-002": "A block without @type cannot be read; name its type.",
    "SD-003": "A block without @context has no vocabulary; add https://schema.org.",
    "SD-004": "The organization has no name; add it.",
    "SD-005": "The article lacks fields that rich results need; add them.",
    "SD-006": "The product has no offers, so no price can be shown; add them.",
    "SD-007": "A page this deep should say where it lies; add a breadcrumb list.",
    "SD-008": "A block is empty or not an object; mend or remove it.",
    "SD-009": "A context is missing or not schema.org; set it right.",
    "SD-010": "The question list has no questions, or some without name or answer; complete it.",
    "SD-011": "The breadcrumb list has no entries, or some without position, name or item; complete it.",
    "SD-012": "The offer lacks a price or a currency; add both.",
    "IMG-001": "Images without alternative text say nothing to readers who cannot see them; describe them.",
    "IMG-002": "Alternative texts over 125 characters are cut by screen readers; shorten them.",
    "IMG-003": "Images without width and height make the page jump; set both.",
    "IMG-004": "Images are larger than any screen needs; scale them down.",
    "IMG-005": "Alternative texts such as photo or img_1 say nothing; describe what is seen.",
    "IMG-006": "A secure page loads images insecurely; use https.",
    "IMG-007": "Over 30 images slow the page; load them late or use fewer.",
    "IMG-008": "Not one image has alternative text; describe them.",
    "LNK-001": "The page leads nowhere within the site; add internal links.",
    "LNK-002": "Fewer than three internal links lead on; add more.",
    "LNK-003": "Over 100 links leave the site; keep those that help readers.",
    "LNK-004": "Links without text say nothing of their target; name it.",
    "LNK-005": "Texts such as click here say nothing of their targets; name them.",
    "LNK-006": "Internal links lead to redirects; link to the final targets.",
    "LNK-007": "Internal links lead to pages that fail; mend or remove them.",
    "LNK-008": "The page links to itself again and again; remove those links.",
    "LNK-009": "External links are broken; replace or remove them.",
    "LNK-010": "External links redirect; link to where they end.",
    "I18N-001": "The alternates leave this very page out; add it to its own list.",
    "I18N-002": "No alternate is the default for other languages; add x-default.",
    "I18N-003": "An alternate does not refer back, so the pair is ignored; make both refer to each other.",
    "I18N-004": "A language tag is malformed and will be ignored; use forms such as en or fr-CA.",
    "I18N-005": "An alternate does not answer 200; point it at a live page.",
    "I18N-006": "A language is named more than once; keep one alternate each.",
    "I18N-007": "Alternates have to be absolute; give scheme and host.",
    "I18N-008": "Other pages of the site come in languages that are missing here; add them if they exist.",
    "CAN-001": "The page names no canonical; add one, to itself if it is the original.",
    "CAN-002": "The canonical is on another site and hands this page's weight over; check that this is meant.",
    "CAN-003": "The canonical names yet another canonical; point at the last one.",
    "CAN-004": "The canonical has parameters; use the clean url.",
    "CAN-005": "A secure page names an insecure canonical; use https.",
    "CAN-006": "The canonical is relative; give the whole url.",
    "CAN-007": "The page is excluded and yet names another canonical, which contradict each other; keep one.",
    "CAN-008": "Many pages name this one as canonical; see whether they are needed.",
    "SEC-001": "The page is served insecurely; serve it by https and redirect.",
    "SEC-002": "Images are loaded insecurely; use https.",
    "SEC-003": "Internal links are insecure; use https.",
    "SEC-004": "Many external links are insecure; use https where the target offers it.",
    "SEC-005": "Page and canonical differ in security; use https for both.",
    "SEC-006": "Many links leave the site; mark those that open new windows or are paid for.",
    "SEC-007": "Alternates mix secure and insecure addresses; use https for all.",
    "SEC-008": "The url carries what looks like a secret; send it in a header or body.",
    "MOB-001": "Most images are wider than small screens; let them scale.",
    "MOB-002": "Small screens will cut the title; keep it within 50 characters.",
    "MOB-003": "The page is heavy for mobile networks; keep it below 500 KB.",
    "MOB-004": "The answer is slow for mobile networks; speed it up.",
    "MOB-005": "Over 200 resources and links strain small devices; use fewer.",
    "MOB-006": "The path is long to read and share on small screens; shorten it.",
    "MOB-007": "The page is very long to scroll; split it or add a table of contents.",
    "MOB-008": "Most images have no dimensions, so the layout jumps; set width and height.",
    "SOC-001": "There are no social tags, so shared links look bare; add title, description and image.",
    "SOC-002": "Shared links have no title of their own; add og:title.",
    "SOC-003": "Shared links have no description; add og:description.",
    "SOC-004": "Shared links have no image; add og:image.",
    "SOC-005": "Shared links have no address of their own; add og:url.",
    "SOC-006": "The kind of content is not named; add og:type.",
    "SOC-007": "The social image is insecure and may not load; use https.",
    "SOC-008": "The social address and the canonical differ, which splits counts; use one.",
}
