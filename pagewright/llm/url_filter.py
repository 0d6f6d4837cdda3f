"""URL filters with redirect equivalence (DataFrame functions only).

A url is judged by the longest host and path rule that fits it. Urls that redirect to each other, or name each other as
canonical, are aliases: connected components over those edges spread a block decision to every alias that no rule
names. Precedence, strongest first: the url's own rule (so an explicit allow is never overridden by an alias), a block
by rule of any alias, then allow.

Edges are read from the pages (``rel=canonical`` links and ``http-equiv=refresh`` targets outside comments, character
references decoded, resolved against the page) and may be given as a table of (source url, target url) too. Aliases are
compared by lower-cased host, path and query; scheme and fragment do not matter.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and verdict allow; of rules of one
length the first by name counts; html of any length is read whole, and the first tag of each kind counts; repeated rows
each get their own row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.rows import named, quoted
from pagewright.operators.components import connected_components
from pagewright.operators.skew import lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
COMMENT = r"(?s)<!--.*?-->"
# Character references that urls are written with; the ampersand comes last.
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#X27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&#X2F;", "/"), ("&#X2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&#X26;", "&"), ("&amp;", "&"))
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and query; null where the url has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def resolve(href: Column, base: Column) -> Column:
    """An absolute url for ``href`` found on page ``base``; null for blank, fragment-only and non-web targets."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(href.isNull() | (href == "") | href.startswith("#"), None)
        .when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), href))
        .when(href.startswith("?"), F.concat(scheme, F.lit("://"), host_of(base), path_of(base), href))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(base), F.when(folder == "", "/").otherwise(folder), href))
    )


def decoded(value: Column) -> Column:
    """Character references of an attribute value replaced."""
    for name, sign in REFERENCES:
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(source, target)`` alias keys that the pages themselves declare."""
    shown = F.regexp_replace(F.col("html"), COMMENT, "")
    found = F.array(
        F.regexp_extract(F.regexp_extract(shown, CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(shown, REFRESH, 0), TARGET, 1),
    )
    read = pages.select(named(url).alias("base"), named(html).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    marked = read.select("base", F.explode(F.transform(found, decoded)).alias("href"))  # decoded once, before it is used often
    return (
        marked.select(alias_key(F.col("base")).alias("source"), alias_key(resolve(F.col("href"), F.col("base"))).alias("target"))
        .where("source is not null and target is not null and source <> target")
    )


def rule_name(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits; rules fit their host and all its subdomains. Null if none fits."""
    fits = [(r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*[F.when(test, F.lit(r.name)) for r, test in fits])


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: ``keep`` + ``host, path, rule, verdict, alias_of`` (smallest alias key, or null)."""
    keep = tuple(map(quoted, keep))
    edges = page_edges(pages, url, html)
    if redirects is not None:
        source, target = redirects.columns[:2]
        edges = edges.union(redirects.select(alias_key(F.col(source)), alias_key(F.col(target))).where(F.col(source).isNotNull() & F.col(target).isNotNull()))
    members = connected_components(edges, "source", "target")
    action = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.action)])
    absolute = F.concat(F.lit("x://"), F.col("node"))
    ruled = rule_name(host_of(absolute), path_of(absolute), rules)
    decided = members.groupBy("component").agg(F.max(F.coalesce(F.try_element_at(action, ruled) == "block", F.lit(False))).alias("_blocked"))
    # one component may hold any share of the urls
    aliases = lookup(members, "component", decided, members.count()).select(F.col("node").alias("_key"), F.col("component").alias("alias_of"), "_blocked")
    page = named(url)
    judged = pages.select(*keep, host_of(page).alias("host"), path_of(page).alias("path"), alias_key(page).alias("_key"))
    judged = judged.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).join(aliases, "_key", "left")
    own = F.try_element_at(action, F.col("rule"))
    verdict = F.coalesce(own, F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return judged.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "alias_of")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_rule(host: str, path: str) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.name}'"
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    )
    return f"CASE {cases} END"


def _sql_host(url: str) -> str:
    return rf"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _sql_path(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_key(url: str) -> str:
    return rf"CASE WHEN {_sql_host(url)} <> '' THEN {_sql_host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


def _oracle() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    shown = f"regexp_replace(html, {quote(COMMENT)}, '', 'g')"

    def href(outer: str, inner: str) -> str:
        value = f"regexp_extract(regexp_extract({shown}, {quote(outer)}), {quote(inner)}, 1)"
        for name, sign in REFERENCES:
            value = f"replace({value}, {quote(name)}, {quote(sign)})"
        return value

    root = r"regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || " + _sql_host("url")
    return rf"""
WITH RECURSIVE found AS (
  SELECT url, {href(CANONICAL, HREF)} AS href FROM pages
  UNION ALL SELECT url, {href(REFRESH, TARGET)} FROM pages),
resolved AS (
  SELECT url, CASE WHEN coalesce(href, '') = '' OR starts_with(href, '#') THEN NULL
    WHEN contains(href, '://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || href
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(href, '/') THEN {root} || href
    WHEN starts_with(href, '?') THEN {root} || {_sql_path("url")} || href
    ELSE {root} || CASE WHEN regexp_extract({_sql_path("url")}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_sql_path("url")}, '(?s)^(.*/)', 1) END || href
    END AS target FROM found),
keyed AS (SELECT {_sql_key("url")} AS a, {_sql_key("target")} AS b FROM resolved WHERE target IS NOT NULL),
edges AS (SELECT a, b FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
ruled AS (SELECT component, {_sql_rule(_sql_host("'x://' || node"), _sql_path("'x://' || node"))} AS rule FROM comp),
blocked AS (SELECT component, bool_or(coalesce(rule IN ({", ".join(f"'{r.name}'" for r in RULES if r.action == "block")}), false)) AS blocked FROM ruled GROUP BY component),
judged AS (SELECT page_id, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_key("url")} AS key FROM pages),
named AS (SELECT *, {_sql_rule("host", "path")} AS rule FROM judged)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({", ".join(f"'{r.name}'" for r in RULES if r.action == "block")}) THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict,
       comp.component AS alias_of
FROM named LEFT JOIN comp ON comp.node = named.key LEFT JOIN blocked ON blocked.component = comp.component
"""


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": _oracle()}
