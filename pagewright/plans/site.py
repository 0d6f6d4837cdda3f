"""A crawled site made from the driver's ``pages`` table.

The raw pages carry a title and a heading but no status, canonical, images and so on, and their links leave the site.
Those columns are filled by arithmetic on ``page_id``, so that every rule meets pages that break it and pages that do
not, and so that SQL can state the same table. ``pages`` rows are all used; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.session import checkpointed, configure, table

# Structured-data texts, one per remainder; their broken rules are listed with the SQL twin.
BLOCKS = (
    ('{"@context":"https://schema.org","@type":"Organization","name":"Ex"}',),
    ('{"@context":"https://schema.org","@type":"Organization"}', '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"a","item":"/"}]}'),
    ('{"@context":"https://schema.org","@type":"Article","headline":"h","author":"a","image":"i"}',),
    ('{"@context":"https://schema.org","@type":"Product","offers":{"price":"1"}}', "[]"),
    ('{"@type":"Product","name":"n"}', "not json"),
    ('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q","acceptedAnswer":{"@type":"Answer","text":"t"}}]}',),
    ('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[]}', '"text"'),
    ('{"@context":"http://example.org","name":"x"}', '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":"1"}]}'),
)


def url_of(n: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.concat(
        F.when(n % 17 == 3, "http://").otherwise("https://"),
        F.when(n % 13 == 5, "www.").otherwise(""),
        F.lit("ex.test/s"),
        text(n % 5),
        F.when(n % 3 == 0, F.concat(F.lit("/d/"), text(n % 7), F.lit("/e/f/g"))).otherwise(""),
        F.lit("/p"),
        text(n),
        F.when(n % 11 == 4, "/").otherwise(""),
        F.when(n % 19 == 6, "?a=1&b=2&token=3&d=4").otherwise(""),
    )


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table (schema ``schemas.PAGE``)."""
    configure(spark)
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), "html")
    return checkpointed(made(raw))


def _each(count: Column, make) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), make)).otherwise(F.array())


def made(raw: DataFrame) -> DataFrame:
    p = F.col("p")
    own = url_of(p)
    text = lambda c: c.cast("string")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    link = lambda j: F.struct(
        F.when((p + j) % 29 == 0, F.lit("http://ex.test/plain")).when((p % 9 == 2) & (j >= 2), own).otherwise(url_of(F.floor(p / 2) + j * 3)).alias("href"),
        F.when((p + j) % 5 == 0, "").when((p + j) % 5 == 1, " Click here ").otherwise(F.concat(F.lit("link "), text(j))).alias("text"),
        F.lit(None).cast("string").alias("rel"),
        F.lit(False).alias("nofollow"),
    )
    outlink = lambda j: F.struct(
        F.concat(F.when((p + j) % 2 == 0, "http").otherwise("https"), F.lit("://x"), text(j), F.lit(".test/")).alias("href"),
        F.concat(F.lit("out "), text(j)).alias("text"),
        F.lit(None).cast("string").alias("rel"),
        F.lit(False).alias("nofollow"),
        F.when((p + j) % 6 == 0, 404).when((p + j) % 6 == 1, 301).cast("int").alias("status_code"),
        ((p + j) % 11 == 0).alias("is_broken"),
        F.when((p + j) % 7 == 0, F.array(F.lit("a"))).alias("redirect_chain"),
        F.lit(None).cast("string").alias("error"),
    )
    image = lambda k: F.struct(
        F.concat(F.when((p % 2 == 0) & (k % 9 == 0), "http").otherwise("https"), F.lit("://ex.test/i"), text(k)).alias("src"),
        F.when((p % 41 == 3) | ((p + k) % 4 == 0), "").when((p + k) % 4 == 1, "Photo").when((p + k) % 4 == 2, F.concat(F.lit("IMG_"), text(k))).otherwise(F.repeat(F.lit("a"), ((p * k) % 140).cast("int"))).alias("alt"),
        F.when(p % 43 == 4, 1500).when(p % 47 == 5, None).when((p + k) % 3 != 0, (p * k) % 3000).cast("int").alias("width"),
        F.when((p + k) % 5 != 0, 100).cast("int").alias("height"),
    )
    tag = lambda lang, href: F.struct(F.lit(lang).alias("lang"), href.alias("href"))
    tags = F.when(
        p % 4 == 1,
        F.concat(
            F.array(tag("en", F.when(p % 16 == 13, url_of(p + 1)).otherwise(own)), tag("fr", url_of(p + 4))),
            F.when(p % 8 == 1, F.array(tag("x-default", F.lit("https://ex.test/")))).otherwise(F.array()),
            F.when(p % 16 == 5, F.array(tag("EN", F.lit("/rel")), tag("english", F.lit("http://ex.test/en")))).otherwise(F.array()),
        ),
    ).otherwise(F.array())
    og = F.when(
        p % 3 != 0,
        F.map_from_entries(
            F.filter(
                F.array(
                    F.struct(F.lit("og:title").alias("k"), F.when(p % 7 == 0, " ").otherwise("T").alias("v")),
                    F.when(p % 5 != 0, F.struct(F.lit("og:description").alias("k"), F.lit("D").alias("v"))),
                    F.struct(F.lit("og:image").alias("k"), F.when(p % 17 == 2, "").when(p % 4 == 0, "http://ex.test/i").otherwise("https://ex.test/i").alias("v")),
                    F.when(p % 19 != 2, F.struct(F.lit("og:url").alias("k"), F.when(p % 2 == 0, url_of(p + 1)).otherwise(own).alias("v"))),
                    F.when(p % 11 != 0, F.struct(F.lit("og:type").alias("k"), F.lit("website").alias("v"))),
                ),
                lambda e: e.isNotNull(),
            )
        ),
    )
    blocks = F.when(p % 3 == 1, F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in BLOCKS]), (p % 8 + 1).cast("int")))
    columns = {
        "page_id": text(p),
        "project_id": F.lit("site"),
        "url": own,
        "canonical_url": F.when(p % 20 == 9, url_of(p + 20))
        .when(p % 6 == 1, own)
        .when(p % 6 == 2, F.concat(F.lit("/s"), text((p + 1) % 5), F.lit("/p"), text(p + 1)))
        .when(p % 6 == 3, url_of(p - p % 40 + F.when(F.floor(p / 6) % 2 == 0, 1).otherwise(7)))
        .when(p % 6 == 4, "https://other.test/x?y=1")
        .when(p % 6 == 5, F.regexp_replace(own, "^https:", "http:")),
        "status_code": F.when(p % 20 == 7, 404).when(p % 20 == 9, 301).when(p % 40 == 11, 500).when(p % 23 != 12, 200).cast("int"),
        "response_time": F.when(p % 9 != 0, F.when(p % 5 == 0, p * 37 % 7000).otherwise(p * 37 % 900).cast("double")),
        "title": F.when(p % 15 == 2, "  ").when(p % 30 == 4, "Oops, page not found").when(p % 15 == 7, F.concat(title, F.repeat(F.lit("t"), 40))).when(p % 15 != 1, title),
        "meta_description": F.when(p % 4 == 1, F.repeat(F.lit("d"), (p % 200).cast("int"))).when(p % 4 == 2, "   ").when(p % 4 == 3, F.concat(F.lit("About page "), text(p))),
        "meta_robots": F.when(p % 10 == 3, "NoIndex, follow").when(p % 10 == 4, "index, nofollow").when(p % 10 == 5, ""),
        "h1": _each(p % 3, lambda j: F.concat(F.lit("Heading"), text(p % 7), F.lit(" part"), text(j))),
        "h2": _each(p % 4, lambda j: F.concat(F.lit("section"), text(p % 5), F.lit(" notes"), text(j))),
        "h3": _each(p % 2, lambda j: F.concat(F.lit("Detail "), text(p % 11 + 100))),
        "og_tags": og,
        "json_ld": blocks,
        "internal_links": _each(F.when(p % 50 == 6, 210).otherwise(p % 8), link),
        "external_links": _each(F.when(p % 50 == 7, 110).otherwise(p % 13), outlink),
        "images": _each(F.when(p % 37 == 0, 60).otherwise(p * 5 % 12), image),
        "word_count": (p * 53 % 6500).cast("int"),
        "hreflang_tags": tags,
        "page_size": F.when(p % 31 != 0, F.when(p % 5 == 1, p * 79190 % 4000000).otherwise(p * 7919 % 200000)).cast("int"),
        "depth": F.size(F.filter(F.split(own, "/"), lambda s: s != "")) - 2,
    }
    types = {f.name: f.dataType for f in raw.sparkSession.createDataFrame([], schemas.PAGE).schema}
    return raw.select(*[(columns[n].cast(t) if n in columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()])


def as_pages(found: DataFrame) -> DataFrame:
    """Extracted fields as a page table (schema ``schemas.PAGE``); what was not extracted is null."""
    wanted = found.sparkSession.createDataFrame([], schemas.PAGE).schema
    return found.select(*[(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
