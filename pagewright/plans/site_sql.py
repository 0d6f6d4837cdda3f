"""The synthetic site and its audit as SQL, for checking the DataFrame plans."""

from __future__ import annotations

from pagewright.operators import rules as r
from pagewright.operators.evidence import LISTED


def url_of(n: str) -> str:
    n = f"({n})"
    return (
        f"(CASE WHEN {n} % 17 = 3 THEN 'http://' ELSE 'https://' END || CASE WHEN {n} % 13 = 5 THEN 'www.' ELSE '' END || 'ex.test/s' || ({n} % 5)"
        f" || CASE WHEN {n} % 3 = 0 THEN '/d/' || ({n} % 7) || '/e/f/g' ELSE '' END || '/p' || {n}"
        f" || CASE WHEN {n} % 11 = 4 THEN '/' ELSE '' END || CASE WHEN {n} % 19 = 6 THEN '?a=1&b=2&token=3&d=4' ELSE '' END)"
    )


def norm(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '^(https?://)www\.', '\1'), '^(https?://[^/?]+/[^?]+)/(\?|$)', '\1\2')"


def bare(u: str) -> str:
    return f"regexp_replace({u}, '/$', '')"


def ref(u: str) -> str:
    """Comparable form of a reference on the site: absolute, or from the root of https or http ``url``."""
    return f"CASE WHEN {u} LIKE '/%' THEN {norm('regexp_extract(url, ' + chr(39) + '^https?://[^/]+' + chr(39) + ') || ' + u)} ELSE {norm(u)} END"


SITE = rf"""
n AS (SELECT page_id AS p, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw_title FROM pages),
s AS (SELECT p, p::VARCHAR AS page_id, {url_of("p")} AS url,
  CASE WHEN p % 20 = 9 THEN {url_of("p + 20")} WHEN p % 6 = 1 THEN {url_of("p")} WHEN p % 6 = 2 THEN '/s' || ((p + 1) % 5) || '/p' || (p + 1)
       WHEN p % 6 = 3 THEN {url_of("p - p % 40 + CASE WHEN (p // 6) % 2 = 0 THEN 1 ELSE 7 END")} WHEN p % 6 = 4 THEN 'https://other.test/x?y=1'
       WHEN p % 6 = 5 THEN regexp_replace({url_of("p")}, '^https:', 'http:') END AS canonical_url,
  CASE WHEN p % 20 = 7 THEN 404 WHEN p % 20 = 9 THEN 301 WHEN p % 40 = 11 THEN 500 WHEN p % 23 <> 12 THEN 200 END AS status_code,
  CASE WHEN p % 9 <> 0 THEN CASE WHEN p % 5 = 0 THEN p * 37 % 7000 ELSE p * 37 % 900 END END::DOUBLE AS rt,
  CASE WHEN p % 15 = 2 THEN '  ' WHEN p % 30 = 4 THEN 'Oops, page not found' WHEN p % 15 = 7 THEN raw_title || repeat('t', 40) WHEN p % 15 <> 1 THEN raw_title END AS title,
  CASE WHEN p % 4 = 1 THEN repeat('d', p % 200) WHEN p % 4 = 2 THEN '   ' WHEN p % 4 = 3 THEN 'About page ' || p END AS descr,
  CASE WHEN p % 10 = 3 THEN 'NoIndex, follow' WHEN p % 10 = 4 THEN 'index, nofollow' WHEN p % 10 = 5 THEN '' END AS robots,
  p % 3 AS n_h1, CASE WHEN p % 50 = 6 THEN 210 ELSE p % 8 END AS n_il, CASE WHEN p % 50 = 7 THEN 110 ELSE p % 13 END AS n_xl,
  CASE WHEN p % 37 = 0 THEN 60 ELSE p * 5 % 12 END AS n_img, p * 53 % 6500 AS words,
  CASE WHEN p % 31 <> 0 THEN CASE WHEN p % 5 = 1 THEN p * 79190 % 4000000 ELSE p * 7919 % 200000 END END AS page_size,
  p % 3 <> 0 AS og, CASE WHEN p % 7 = 0 THEN ' ' ELSE 'T' END AS og_title, CASE WHEN p % 5 <> 0 THEN 'D' END AS og_description,
  CASE WHEN p % 17 = 2 THEN '' WHEN p % 4 = 0 THEN 'http://ex.test/i' ELSE 'https://ex.test/i' END AS og_image,
  CASE WHEN p % 19 <> 2 THEN CASE WHEN p % 2 = 0 THEN {url_of("p + 1")} ELSE {url_of("p")} END END AS og_url,
  p % 11 <> 0 AS og_type, CASE WHEN p % 3 = 1 THEN p % 8 END AS block FROM n),
k AS (SELECT *, {norm("url")} AS norm_url, {ref("canonical_url")} AS canon_norm,
  len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?]*)', 1), '/'), lambda x: x <> '')) AS deep,
  url LIKE 'https://%' AS https, coalesce(status_code = 200, false) AS ok, coalesce(status_code BETWEEN 300 AND 399, false) AS moved FROM s),
l AS (SELECT k.p, url, norm_url, j, CASE WHEN (p + j) % 29 = 0 THEN 'http://ex.test/plain' WHEN p % 9 = 2 AND j >= 2 THEN url ELSE {url_of("p // 2 + j * 3")} END AS href,
  CASE WHEN (p + j) % 5 = 0 THEN '' WHEN (p + j) % 5 = 1 THEN ' Click here ' ELSE 'link ' || j END AS text FROM k, range(k.n_il) AS t(j)),
lt AS (SELECT *, {norm("href")} AS target FROM l),
x AS (SELECT p, j, CASE WHEN (p + j) % 2 = 0 THEN 'http' ELSE 'https' END || '://x' || j || '.test/' AS href, (p + j) % 11 = 0 OR (p + j) % 6 = 0 AS broken, (p + j) % 7 = 0 OR (p + j) % 6 = 1 AS moved,
  CASE WHEN (p + j) % 6 = 0 THEN 404 WHEN (p + j) % 6 = 1 THEN 301 ELSE 0 END AS code, CASE WHEN (p + j) % 7 = 0 THEN ['a'] ELSE [] END AS chain FROM k, range(k.n_xl) AS t(j)),
i AS (SELECT p, j AS k, p % 2 = 0 AND j % 9 = 0 AS plain, CASE WHEN p % 2 = 0 AND j % 9 = 0 THEN 'http' ELSE 'https' END || '://ex.test/i' || j AS src,
  CASE WHEN p % 41 = 3 OR (p + j) % 4 = 0 THEN '' WHEN (p + j) % 4 = 1 THEN 'Photo' WHEN (p + j) % 4 = 2 THEN 'IMG_' || j ELSE repeat('a', (p * j) % 140) END AS alt,
  CASE WHEN p % 43 = 4 THEN 1500 WHEN p % 47 = 5 THEN NULL WHEN (p + j) % 3 <> 0 THEN (p * j) % 3000 END AS width,
  CASE WHEN (p + j) % 5 <> 0 THEN 100 END AS height FROM k, range(k.n_img) AS t(j)),
h AS (SELECT p, url, 1 AS o, 'en' AS lang, CASE WHEN p % 16 = 13 THEN {url_of("p + 1")} ELSE url END AS href FROM k WHERE p % 4 = 1
  UNION ALL SELECT p, url, 2, 'fr', {url_of("p + 4")} FROM k WHERE p % 4 = 1
  UNION ALL SELECT p, url, 3, 'x-default', 'https://ex.test/' FROM k WHERE p % 8 = 1
  UNION ALL SELECT p, url, 4, 'EN', '/rel' FROM k WHERE p % 16 = 5 UNION ALL SELECT p, url, 5, 'english', 'http://ex.test/en' FROM k WHERE p % 16 = 5)"""

AGGREGATES = rf"""
last_page AS (SELECT norm_url, max_by(status_code, p) FILTER (WHERE true) AS any_status, max(p) AS p FROM k GROUP BY norm_url),
lookup AS (SELECT k.norm_url, k.status_code, k.canon_norm, k.canonical_url, k.moved FROM k JOIN last_page USING (norm_url, p)),
lp AS (SELECT target AS norm_url, url, count(*) AS n, min(p) AS p FROM lt GROUP BY 1, 2),
la AS (SELECT norm_url, sum(n)::BIGINT AS inbound, count(*) AS linking, list(url ORDER BY p, url)[1:{LISTED}] AS linking_list FROM lp GROUP BY 1),
tp AS (SELECT lower(trim(title)) AS key, url, min(p) AS p FROM k WHERE ok AND trim(coalesce(title, '')) <> '' GROUP BY 1, 2),
ta AS (SELECT key, count(*) AS urls, list(url ORDER BY p)[1:11] AS title_list FROM tp GROUP BY 1),
ca AS (SELECT canon_norm AS norm_url, count(*) AS incoming, list(url ORDER BY p)[1:10] AS canon_list FROM k WHERE canon_norm <> norm_url GROUP BY 1),
lo AS (SELECT lt.p, count(*) FILTER (WHERE lookup.moved) AS l_moved, count(*) FILTER (WHERE lookup.status_code >= 400) AS l_broken,
  count(*) FILTER (WHERE target = lt.norm_url) AS l_self, count(*) FILTER (WHERE trim(text) = '') AS l_blank, count(*) FILTER (WHERE lower(trim(text)) = 'click here') AS l_generic,
  count(*) FILTER (WHERE href LIKE 'http://%') AS l_plain, list(href ORDER BY j) FILTER (WHERE href LIKE 'http://%') AS l_plain_list, list(href ORDER BY j) FILTER (WHERE trim(text) = '') AS l_blank_list,
  list({{'href': href, 'text': text}} ORDER BY j) FILTER (WHERE lower(trim(text)) = 'click here') AS l_generic_list, list({{'href': target, 'statusCode': lookup.status_code}} ORDER BY j) FILTER (WHERE lookup.moved) AS l_moved_list,
  list({{'href': target, 'statusCode': lookup.status_code}} ORDER BY j) FILTER (WHERE lookup.status_code >= 400) AS l_broken_list, list(text ORDER BY j) FILTER (WHERE target = lt.norm_url) AS l_self_list FROM lt LEFT JOIN lookup ON lookup.norm_url = lt.target GROUP BY 1),
xa AS (SELECT p, count(*) FILTER (WHERE href LIKE 'http:%') AS x_plain, list(href ORDER BY j) FILTER (WHERE href LIKE 'http:%') AS x_plain_list,
  count(*) FILTER (WHERE broken) AS x_broken, list({{'href': href, 'statusCode': code, 'error': NULL::VARCHAR}} ORDER BY j) FILTER (WHERE broken) AS x_broken_list,
  count(*) FILTER (WHERE moved) AS x_moved, list({{'href': href, 'statusCode': code, 'redirectChain': chain}} ORDER BY j) FILTER (WHERE moved) AS x_moved_list FROM x GROUP BY 1),
ia AS (SELECT p, bool_or(plain) AS i_plain, bool_or(trim(alt) = '') AS i_blank, bool_and(trim(alt) = '') AS i_all_blank, bool_or(len(alt) > 125) AS i_long,
  count(*) FILTER (WHERE width IS NULL OR height IS NULL) AS i_no_size, coalesce(bool_or(width > 2000 OR height > 2000), false) AS i_big,
  bool_or(lower(trim(alt)) = 'photo' OR regexp_matches(lower(trim(alt)), '^(img|dsc)[-_]?[0-9]+$')) AS i_generic,
  count(*) FILTER (WHERE width > 1200 AND height IS NOT NULL) AS i_wide, count(*) FILTER (WHERE plain) AS n_plain, list(src ORDER BY k) FILTER (WHERE plain) AS plain_list,
  count(*) FILTER (WHERE trim(alt) = '') AS n_blank, list(src ORDER BY k) FILTER (WHERE trim(alt) = '') AS blank_list,
  count(*) FILTER (WHERE len(alt) > 125) AS n_long, list({{'src': src, 'altLength': len(alt)}} ORDER BY k) FILTER (WHERE len(alt) > 125) AS long_list,
  list(src ORDER BY k) FILTER (WHERE width IS NULL OR height IS NULL) AS no_size_list,
  count(*) FILTER (WHERE width > 2000 OR height > 2000) AS n_big, list({{'src': src, 'width': width, 'height': height}} ORDER BY k) FILTER (WHERE width > 2000 OR height > 2000) AS big_list,
  count(*) FILTER (WHERE lower(trim(alt)) = 'photo' OR regexp_matches(lower(trim(alt)), '^(img|dsc)[-_]?[0-9]+$')) AS n_generic,
  list({{'src': src, 'alt': alt}} ORDER BY k) FILTER (WHERE lower(trim(alt)) = 'photo' OR regexp_matches(lower(trim(alt)), '^(img|dsc)[-_]?[0-9]+$')) AS generic_list,
  list({{'src': src, 'width': width}} ORDER BY k) FILTER (WHERE width > 1200 AND height IS NOT NULL) AS wide_list FROM i GROUP BY 1),
ll AS (SELECT DISTINCT lower(lang) AS lang FROM h),
hb AS (SELECT DISTINCT {bare("url")} AS own, {bare("href")} AS back FROM h),
hl AS (SELECT {bare("url")} AS own, max_by(status_code, p) AS status_code, max_by(coalesce(status_code, -1), p) AS known FROM k GROUP BY 1),
hx AS (SELECT h.*, hl.known, coalesce(hl.known <> 200 AND hl.known <> -1, false) AS bad,
  hl.own IS NOT NULL AND {bare("h.href")} <> {bare("h.url")} AND NOT EXISTS (SELECT 1 FROM hb WHERE hb.own = {bare("h.href")} AND hb.back = {bare("h.url")}) AS one_way,
  NOT regexp_matches(lower(lang), '{r.LANGUAGE_TAG}') AS malformed, NOT regexp_matches(href, '^https?://') AS relative FROM h LEFT JOIN hl ON hl.own = {bare("h.href")}),
ha AS (SELECT p, bool_or({bare("href")} = {bare("url")}) AS h_self, bool_or(lower(lang) = 'x-default') AS h_default,
  bool_or(malformed) AS h_bad, count(*) > count(DISTINCT lower(lang)) AS h_twice, bool_or(relative) AS h_relative, bool_or(href LIKE 'http://%') AND bool_or(href LIKE 'https://%') AS h_mixed,
  bool_or(bad) AS h_status, bool_or(one_way) AS h_one_way, count(DISTINCT lower(lang)) AS h_langs,
  list({{'lang': lang, 'href': href}} ORDER BY o) AS tags, list(lang ORDER BY o) AS tag_langs, list(lower(lang) ORDER BY o) FILTER (WHERE o <> 4) AS own_langs,
  list({{'lang': lang, 'href': href}} ORDER BY o) FILTER (WHERE one_way) AS one_way_list, list({{'lang': lang, 'href': href, 'statusCode': known}} ORDER BY o) FILTER (WHERE bad) AS bad_list,
  list({{'lang': lang, 'href': href}} ORDER BY o) FILTER (WHERE malformed) AS malformed_list, list({{'lang': lang, 'href': href}} ORDER BY o) FILTER (WHERE relative) AS relative_list,
  count(*) FILTER (WHERE href LIKE 'http://%') AS n_http, count(*) FILTER (WHERE href LIKE 'https://%') AS n_https, list(href ORDER BY o) FILTER (WHERE href LIKE 'http://%') AS http_list FROM hx GROUP BY p),
walk(p, place, named, seen, chain, hops) AS (
  SELECT p, {norm("canonical_url")}, canonical_url, [norm_url], [url], 1 FROM k WHERE moved AND canonical_url IS NOT NULL
  UNION ALL SELECT w.p, {norm("b.canonical_url")}, b.canonical_url, list_append(w.seen, w.place), list_append(w.chain, w.named), w.hops + 1 FROM walk w JOIN lookup b ON b.norm_url = w.place
  WHERE b.moved AND b.canonical_url IS NOT NULL AND NOT list_contains(w.seen, w.place) AND w.hops < 10),
wa AS (SELECT p, max(hops) AS hops, max_by(CASE WHEN hops < 10 AND NOT list_contains(seen, place) THEN list_append(chain, named) ELSE chain END, hops) AS chain FROM walk GROUP BY p),
sc AS (SELECT avg(rt) AS avg_rt, count(rt) AS n_rt, avg(page_size) AS avg_size, count(page_size) AS n_size FROM k),
e AS (SELECT k.*, coalesce(la.inbound, 0) AS inbound, coalesce(la.linking, 0) AS linking, ta.urls AS title_urls, coalesce(ca.incoming, 0) AS incoming, linking_list, title_list, canon_list,
  t.status_code AS t_status, t.canon_norm AS t_canon, t.canonical_url AS t_canonical, b.canonical_url AS b_canonical, lo.*, xa.*, ia.*, ha.*, wa.hops, wa.chain, sc.*, (SELECT count(*) FROM k) AS n_pages,
  (SELECT list(lang ORDER BY lang) FROM ll) AS site_langs,
  coalesce({norm("b.canonical_url")} = k.norm_url, false) AS loops, (SELECT count(*) FROM ll) AS all_langs
  FROM k LEFT JOIN la ON la.norm_url = k.norm_url LEFT JOIN ta ON ok AND ta.key = lower(trim(title)) LEFT JOIN ca ON ca.norm_url = k.norm_url
  LEFT JOIN lookup t ON t.norm_url = k.canon_norm LEFT JOIN lookup b ON b.norm_url = {norm("k.canonical_url")}
  LEFT JOIN lo ON lo.p = k.p LEFT JOIN xa ON xa.p = k.p LEFT JOIN ia ON ia.p = k.p LEFT JOIN ha ON ha.p = k.p LEFT JOIN wa ON wa.p = k.p CROSS JOIN sc)"""

#: Rules broken by the structured-data text of each remainder, worked out by hand.
BLOCK_RULES = {
    "SD-002": (3, 6, 7), "SD-003": (3, 4, 6), "SD-004": (1,), "SD-005": (2,), "SD-006": (4,), "SD-008": (3, 6),
    "SD-009": (3, 4, 7), "SD-010": (6,), "SD-011": (7,), "SD-012": (3,),
}

noindex = "robots = 'NoIndex, follow'"
CONDITIONS = {
    "IDX-001": noindex,
    "IDX-002": f"{noindex} AND (words > 500 OR coalesce(title, '') <> '' OR n_h1 > 0)",
    "IDX-003": "inbound = 0",
    "IDX-004": "canon_norm <> norm_url AND t_status <> 200",
    "IDX-005": "inbound >= 3 AND ok AND robots IS NULL AND canonical_url IS NULL",
    "IDX-006": "robots = 'index, nofollow' AND n_il > 0",
    "IDX-007": "deep > 5",
    "IDX-008": f"words < 50 AND ok AND NOT coalesce({noindex}, false)",
    "CRW-001": "moved AND loops",
    "CRW-002": "status_code BETWEEN 400 AND 499 AND linking > 0",
    "CRW-003": "status_code >= 500",
    "CRW-004": "moved AND hops >= 3",
    "CRW-005": "ok AND words < 100 AND (" + " OR ".join(f"contains(lower(title), '{t.replace(chr(39), chr(39) * 2)}')" for t in r.ERROR_TITLES) + ")",
    "CRW-006": "contains(url, '?')",
    "CRW-007": "https AND (i_plain OR l_plain > 0)",
    "CRW-008": "rt > 3000",
    "CRW-009": "status_code BETWEEN 400 AND 499",
    "CRW-010": "moved",
    "OPG-001": "ok AND trim(coalesce(title, '')) = ''",
    "OPG-002": "ok AND trim(title) <> '' AND title_urls > 1",
    "OPG-003": "len(title) > 60",
    "OPG-004": "ok AND n_h1 = 0",
    "OPG-005": "n_h1 > 1",
    "OPG-006": "ok AND descr IS NULL",
    "OPG-007": "len(descr) > 160",
    "OPG-008": "ok AND words > 0 AND words < 300",
    "OPG-009": "len(trim(title)) BETWEEN 1 AND 9",
    "OPG-010": "ok AND descr IS NOT NULL AND trim(descr) = ''",
    "PRF-001": "rt > 5000",
    "PRF-002": "page_size > 3145728",
    "PRF-003": "rt > 1000 AND rt <= 3000",
    "PRF-004": "page_size > 1048576 AND page_size <= 3145728",
    "PRF-005": "n_img > 50",
    "PRF-006": "n_il > 200",
    "PRF-007": "n_rt >= 3 AND rt > 3 * avg_rt AND rt > 500",
    "PRF-008": "n_size >= 3 AND page_size > 5 * avg_size AND page_size > 102400",
    "SD-001": "ok AND block IS NULL",
    "SD-007": "ok AND block IS NOT NULL AND deep >= 2 AND block NOT IN (1, 7)",
    **{rule: f"block IN ({', '.join(map(str, remainders))})" for rule, remainders in BLOCK_RULES.items()},
    "IMG-001": "i_blank",
    "IMG-002": "i_long",
    "IMG-003": "i_no_size > 0",
    "IMG-004": "i_big",
    "IMG-005": "i_generic",
    "IMG-006": "https AND i_plain",
    "IMG-007": "n_img > 30",
    "IMG-008": "n_img >= 3 AND i_all_blank",
    "LNK-001": "ok AND n_il = 0",
    "LNK-002": "ok AND n_il BETWEEN 1 AND 2",
    "LNK-003": "n_xl > 100",
    "LNK-004": "l_blank > 0",
    "LNK-005": "l_generic > 3",
    "LNK-006": "l_moved > 0",
    "LNK-007": "l_broken > 0",
    "LNK-008": "l_self > 2",
    "LNK-009": "x_broken > 0",
    "LNK-010": "x_moved > 0",
    "I18N-001": "NOT h_self",
    "I18N-002": "NOT h_default",
    "I18N-003": "h_one_way",
    "I18N-004": "h_bad",
    "I18N-005": "h_status",
    "I18N-006": "h_twice",
    "I18N-007": "h_relative",
    "I18N-008": "all_langs > 2 AND h_langs < all_langs",
    "CAN-001": "ok AND canonical_url IS NULL",
    "CAN-002": "canonical_url LIKE 'https://other.test%'",
    "CAN-003": "canon_norm <> norm_url AND t_canon <> canon_norm",
    "CAN-004": "contains(canonical_url, '?')",
    "CAN-005": "https AND canonical_url LIKE 'http://%'",
    "CAN-006": "canonical_url LIKE '/%'",
    "CAN-007": f"{noindex} AND canon_norm <> norm_url",
    "CAN-008": "canon_norm = norm_url AND incoming > 5",
    "SEC-001": "NOT https",
    "SEC-002": "https AND i_plain",
    "SEC-003": "https AND l_plain > 0",
    "SEC-004": "x_plain > 5",
    "SEC-005": "canonical_url IS NOT NULL AND https <> (canonical_url LIKE 'https://%')",
    "SEC-006": "n_xl > 10",
    "SEC-007": "h_mixed",
    "SEC-008": "contains(url, 'token=')",
    "MOB-001": "ok AND i_wide > 3 AND i_wide > n_img * 0.5",
    "MOB-002": "len(title) > 50",
    "MOB-003": "page_size > 512000",
    "MOB-004": "rt > 2000",
    "MOB-005": "n_img + n_il + n_xl > 200",
    "MOB-006": "deep > 4",
    "MOB-007": "words > 5000",
    "MOB-008": "i_no_size > 5 AND i_no_size > n_img * 0.5",
    "SOC-001": "ok AND NOT og",
    "SOC-002": "og AND trim(og_title) = ''",
    "SOC-003": "og AND og_description IS NULL",
    "SOC-004": "og AND og_image = ''",
    "SOC-005": "og AND og_url IS NULL",
    "SOC-006": "og AND NOT og_type",
    "SOC-007": "og AND og_image LIKE 'http://%'",
    "SOC-008": f"og AND og_url IS NOT NULL AND canonical_url IS NOT NULL AND {norm('og_url')} <> canon_norm",
}


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round(({x})::DECIMAL(30,10), {digits})::DOUBLE)"


def shown(**values: str) -> str:
    """A JSON object of SQL expressions."""
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


_segs = "list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?]*)', 1), '/'), lambda x: x <> '')"
_none = "[]::VARCHAR[]"
_plain = f"list_concat(coalesce(plain_list, {_none}), coalesce(l_plain_list, {_none}))"
_parameters = """'{"a":"1","b":"2","token":"3","d":"4"}'::JSON"""
_protocol = lambda u: f"CASE WHEN {u} LIKE 'https://%' THEN 'https' ELSE 'http' END"
_host = lambda u: f"regexp_extract({u}, '^https?://([^/?#]+)', 1)"
_og = """('{' || concat_ws(',', '"og:title":"' || og_title || '"', '"og:description":"' || og_description || '"', '"og:image":"' || og_image || '"', '"og:url":"' || og_url || '"', CASE WHEN og_type THEN '"og:type":"website"' END) || '}')::JSON"""
_first = lambda name, n: f"{name}[1:{n}]"
_social = lambda name: shown(ogTags=_og, missingTag=f"'og:{name}'")
#: Structured-data evidence per remainder of the block, worked out by hand.
BLOCK_EVIDENCE = {
    "SD-002": {n: '{"totalBlocks":2,"missingTypeCount":1}' for n in (3, 6, 7)},
    "SD-003": {3: '{"totalBlocks":2,"missingContextCount":1}', 4: '{"totalBlocks":1,"missingContextCount":1}', 6: '{"totalBlocks":2,"missingContextCount":1}'},
    "SD-004": {1: '{"schemaType":"Organization","missingProperty":"name"}'},
    "SD-005": {2: '{"schemaType":"Article","missingFields":["datePublished"]}'},
    "SD-006": {4: '{"schemaType":"Product","missingProperty":"offers"}'},
    "SD-008": {n: '{"totalBlocks":2,"invalidBlockIndices":[1]}' for n in (3, 6)},
    "SD-009": {
        3: '{"invalidContextCount":1,"invalidContexts":[{"index":1,"context":null}]}',
        4: '{"invalidContextCount":1,"invalidContexts":[{"index":0,"context":null}]}',
        7: '{"invalidContextCount":1,"invalidContexts":[{"index":0,"context":"http://example.org"}]}',
    },
    "SD-010": {6: '{"schemaType":"FAQPage","mainEntityType":"object"}'},
    "SD-011": {7: '{"invalidEntryCount":1,"totalEntries":1}'},
    "SD-012": {3: '{"missingFields":["priceCurrency"]}'},
}
EVIDENCE = {
    "IDX-001": shown(metaRobots="robots", detectedDirectives="['noindex', 'follow']"),
    "IDX-002": shown(metaRobots="robots", wordCount="words", title="title", h1Count="n_h1"),
    "IDX-003": shown(totalPagesChecked="n_pages", inboundLinkCount="0"),
    "IDX-004": shown(canonicalUrl="canonical_url", canonicalStatusCode="t_status"),
    "IDX-005": shown(inboundLinkCount="inbound", hasCanonical="false", statusCode="status_code"),
    "IDX-006": shown(metaRobots="robots", internalLinkCount="n_il"),
    "IDX-007": shown(depth="deep", pathSegments=_segs),
    "IDX-008": shown(wordCount="words", title="title"),
    "CRW-001": shown(statusCode="status_code", canonicalUrl="canonical_url", targetCanonicalUrl="b_canonical"),
    "CRW-002": shown(statusCode="status_code", linkingPages="linking_list", linkingPageCount="linking"),
    "CRW-003": shown(statusCode="status_code"),
    "CRW-004": shown(hops="hops", chain="chain[1:10]"),
    "CRW-005": shown(statusCode="status_code", title="title", wordCount="words"),
    "CRW-006": shown(paramCount="4", params=_parameters),
    "CRW-007": shown(mixedContentCount=f"len({_plain})", examples=_plain),
    "CRW-008": shown(responseTimeMs="rt", responseTimeSec=fixed("rt / 1000", 1), threshold="3000"),
    "CRW-009": shown(statusCode="status_code"),
    "CRW-010": shown(statusCode="status_code", canonicalTarget="canonical_url"),
    "OPG-001": shown(title="title"),
    "OPG-002": shown(title="title", duplicateUrls="list_filter(title_list, lambda x: x <> url)[1:10]", duplicateCount="title_urls - 1"),
    "OPG-003": shown(title="title", length="len(title)", maxRecommended="60"),
    "OPG-004": shown(h1Count="0"),
    "OPG-005": shown(h1Count="n_h1", h1Tags="list_transform(range(n_h1), lambda x: 'Heading' || (p % 7) || ' part' || x)"),
    "OPG-006": shown(metaDescription="NULL"),
    "OPG-007": shown(metaDescription="descr", length="len(descr)", maxRecommended="160"),
    "OPG-008": shown(wordCount="words", minRecommended="300"),
    "OPG-009": shown(title="title", length="len(trim(title))", minRecommended="10"),
    "OPG-010": shown(metaDescription="descr"),
    "PRF-001": shown(responseTimeMs="rt", threshold="5000"),
    "PRF-002": shown(pageSizeBytes="page_size", pageSizeMB=fixed("page_size / 1048576", 2), threshold="'3 MB'"),
    "PRF-003": shown(responseTimeMs="rt", threshold="1000"),
    "PRF-004": shown(pageSizeBytes="page_size", pageSizeKB=fixed("page_size / 1024", 0), threshold="'1 MB'"),
    "PRF-005": shown(imageCount="n_img", threshold="50"),
    "PRF-006": shown(internalLinkCount="n_il", threshold="200"),
    "PRF-007": shown(responseTimeMs="rt", siteAverageMs="floor(avg_rt + 0.5)::BIGINT", multiplier=fixed("rt / avg_rt", 1)),
    "PRF-008": shown(pageSizeKB=fixed("page_size / 1024", 0), siteAverageKB=fixed("avg_size / 1024", 0), multiplier=fixed("page_size / avg_size", 1)),
    "SD-001": shown(jsonLdCount="0"),
    "SD-007": shown(depth="deep", hasBreadcrumbSchema="false"),
    **{rule: "CASE block " + " ".join(f"WHEN {n} THEN '{text}'" for n, text in of.items()) + " END" for rule, of in BLOCK_EVIDENCE.items()},
    "IMG-001": shown(totalImages="n_img", missingAltCount="n_blank", examples=_first("blank_list", 5)),
    "IMG-002": shown(longAltCount="n_long", examples=_first("long_list", 5)),
    "IMG-003": shown(totalImages="n_img", missingDimensionsCount="i_no_size", examples=_first("no_size_list", 5)),
    "IMG-004": shown(oversizedCount="n_big", examples=_first("big_list", 5)),
    "IMG-005": shown(genericAltCount="n_generic", examples=_first("generic_list", 5)),
    "IMG-006": shown(httpImageCount="n_plain", examples=_first("plain_list", 5)),
    "IMG-007": shown(imageCount="n_img", threshold="30"),
    "IMG-008": shown(imageCount="n_img", missingAltCount="n_img"),
    "LNK-001": shown(internalLinkCount="0"),
    "LNK-002": shown(internalLinkCount="n_il", minRecommended="3"),
    "LNK-003": shown(externalLinkCount="n_xl", threshold="100"),
    "LNK-004": shown(emptyAnchorCount="l_blank", examples=_first("l_blank_list", 10)),
    "LNK-005": shown(genericLinkCount="l_generic", examples="l_generic_list"),
    "LNK-006": shown(redirectedLinkCount="l_moved", examples="l_moved_list"),
    "LNK-007": shown(brokenLinkCount="l_broken", examples="l_broken_list"),
    "LNK-008": shown(selfLinkCount="l_self", examples=_first("l_self_list", 5)),
    "LNK-009": shown(brokenExternalLinkCount="x_broken", examples=_first("x_broken_list", 50)),
    "LNK-010": shown(redirectingExternalLinkCount="x_moved", examples=_first("x_moved_list", 50)),
    "I18N-001": shown(hreflangTags="tags", pageUrl="url"),
    "I18N-002": shown(hreflangTags="tags", languages="tag_langs"),
    "I18N-003": shown(nonReciprocalCount="len(one_way_list)", nonReciprocalTargets="one_way_list"),
    "I18N-004": shown(invalidTags="malformed_list"),
    "I18N-005": shown(badTargets="bad_list"),
    "I18N-006": shown(duplicates="[{'lang': 'en', 'count': 2}]"),
    "I18N-007": shown(relativeUrlCount="len(relative_list)", examples=_first("relative_list", 5)),
    "I18N-008": shown(pageLanguages="own_langs", missingLanguages="list_filter(site_langs, lambda x: NOT list_contains(own_langs, x))", siteLanguages="site_langs"),
    "CAN-001": shown(canonicalUrl="NULL"),
    "CAN-002": shown(pageHost=_host("url"), canonicalHost="'other.test'", canonicalUrl="canonical_url"),
    "CAN-003": shown(pageCanonical="canonical_url", targetCanonical="t_canonical"),
    "CAN-004": "CASE WHEN canonical_url LIKE '%?y=1' THEN " + shown(canonicalUrl="canonical_url", paramCount="1", params="""'{"y":"1"}'::JSON""") + " ELSE " + shown(canonicalUrl="canonical_url", paramCount="4", params=_parameters) + " END",
    "CAN-005": shown(pageUrl="url", canonicalUrl="canonical_url"),
    "CAN-006": shown(canonicalUrl="canonical_url"),
    "CAN-007": shown(metaRobots="robots", canonicalUrl="canonical_url"),
    "CAN-008": shown(canonicalizingPageCount="incoming", examples="canon_list"),
    "SEC-001": shown(protocol="'http'"),
    "SEC-002": shown(httpImageCount="n_plain", examples=_first("plain_list", 5)),
    "SEC-003": shown(httpLinkCount="l_plain", examples=_first("l_plain_list", 5)),
    "SEC-004": shown(httpExternalCount="x_plain", examples=_first("x_plain_list", 10)),
    "SEC-005": shown(pageProtocol=_protocol("url"), canonicalProtocol=_protocol("canonical_url"), canonicalUrl="canonical_url"),
    "SEC-006": shown(externalLinkCount="n_xl"),
    "SEC-007": shown(httpCount="n_http", httpsCount="n_https", httpExamples=_first("http_list", 3)),
    "SEC-008": shown(sensitiveParams="['token']"),
    "MOB-001": shown(largeFixedImageCount="i_wide", totalImages="n_img", examples=_first("wide_list", 3)),
    "MOB-002": shown(title="title", length="len(title)", mobileLimit="50"),
    "MOB-003": shown(pageSizeKB=fixed("page_size / 1024", 0), thresholdKB="500"),
    "MOB-004": shown(responseTimeMs="rt", mobileImpact="'Mobile networks add their own delay'"),
    "MOB-005": shown(imageCount="n_img", internalLinkCount="n_il", externalLinkCount="n_xl", totalResources="n_img + n_il + n_xl"),
    "MOB-006": shown(depth="deep", path="regexp_extract(url, '^https?://[^/]+([^?]*)', 1)"),
    "MOB-007": shown(wordCount="words", threshold="5000"),
    "MOB-008": shown(missingDimensionsCount="i_no_size", totalImages="n_img", percentageMissing=fixed("100 * i_no_size / n_img", 0) + " || '%'"),
    "SOC-001": shown(ogTags="NULL"),
    "SOC-002": _social("title"),
    "SOC-003": _social("description"),
    "SOC-004": _social("image"),
    "SOC-005": _social("url"),
    "SOC-006": _social("type"),
    "SOC-007": shown(ogImage="og_image"),
    "SOC-008": shown(ogUrl="og_url", canonicalUrl="canonical_url"),
}


def audit_sql(category: str | None = None) -> str:
    """``rule_id, affected_url, page_id, evidence`` of one category, or of all."""
    wanted = {rule: c for rule, c in CONDITIONS.items() if category is None or r.CATEGORY_OF[rule.split("-")[0]] == category}
    flags = ", ".join(f"CASE WHEN {c} THEN {{'rule_id': '{rule}', 'evidence': ({EVIDENCE[rule]})::VARCHAR}} END" for rule, c in wanted.items())
    return f"""WITH RECURSIVE {SITE}, {AGGREGATES}
SELECT f.rule_id AS rule_id, url AS affected_url, page_id, f.evidence AS evidence FROM (SELECT url, page_id, unnest([{flags}]) AS f FROM e) WHERE f IS NOT NULL"""
