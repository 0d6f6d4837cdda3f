"""Redirect chains by doubling, and robots rules by literal prefixes, against the rules as they are worded."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import shared
from pagewright.sources import robots

URL = "https://ex.test/n{}".format


def walked(pages, most=10):
    """Step by step: ``page_id -> (hops, chain)``."""
    last = {}
    for p in pages:
        last[p["url"]] = p
    moved = lambda p: p is not None and p["status_code"] // 100 == 3 and p["canonical_url"] is not None
    out = {}
    for p in pages:
        if moved(p):
            seen, chain, at, named, hops = [p["url"]], [p["url"]], p["canonical_url"], p["canonical_url"], 1
            for _ in range(most - 1):
                if at is None or at in seen:
                    break
                seen, chain, page = [*seen, at], [*chain, named], last.get(at)
                at = named = page["canonical_url"] if moved(page) else None
                hops += at is not None
            out[p["page_id"]] = (hops, chain)
    return out


def joins(df):
    return len(re.findall(r"^[\s:+-]*Join ", df._jdf.queryExecution().optimizedPlan().toString(), re.M))


@pytest.mark.parametrize("seed", range(3))
def test_redirect_chains(spark, seed, monkeypatch):
    rng = random.Random(seed)
    n = 60
    pages = [{"page_id": f"{i:03}", "url": URL(i), "status_code": 301 if rng.random() < 0.95 else 200, "canonical_url": URL(rng.choice((i + 1, i + 1, i + 1, rng.randint(0, n + 5), i))) if rng.random() < 0.97 else None} for i in range(n)]
    df = spark.createDataFrame(pages, "page_id string, url string, status_code int, canonical_url string").withColumn("norm_url", urls.lenient("url"))
    counted = []
    monkeypatch.setattr(shared, "checkpointed", lambda df, plain=shared.checkpointed: (counted.append(joins(df)), plain(df))[1])
    found = shared.redirect_hops(df)
    counted.append(joins(found))
    assert {r["page_id"]: (r["hops"], r["chain"]) for r in found.collect()} == walked(pages)
    assert sum(counted) - counted[0] == 4  # doublings; the first table needs none, or what finds a url's last page


def test_robots_rules_meet_paths_by_prefix(spark):
    rng = random.Random(6)
    parts = ["a", "b", "abc", "private", "x.pdf", "q"]
    patterns = ["/", "", "/*", "/*.pdf$", "/a?b", "/a*b?", "/(a|b)*", "/a+*c", "/private$", "*", "/abc/*/q$", "/x{2}*", "/[ab]*", "/a\\*"]
    patterns += ["/" + "/".join(rng.choices(parts, k=rng.randint(1, 3))) + rng.choice(("", "/", "$", "*", "/*q")) for _ in range(300)]
    rules = [("ex.test", 1 + i % 3, "*", rng.choice(("allow", "disallow")), p, i) for i, p in enumerate(patterns)]
    rules.append(("other.test", 1, "*", "disallow", "/", 0))
    paths = sorted({"/" + "/".join(rng.choices(parts, k=rng.randint(0, 4))) + rng.choice(("", "/", "?q=1")) for _ in range(400)} | {"/aab", "/axb", "/xx1", "/a*"})
    frame = spark.createDataFrame([(f"https://ex.test{p}",) for p in paths], "url string")
    table = spark.createDataFrame(rules, "site string, group_ix int, user_agent string, kind string, pattern string, line_no int")

    every = frame.select(urls.path("url").alias("p0"), F.regexp_extract("url", r"(\?[^#]*)", 1).alias("q")).select(F.lit("ex.test").alias("site"), F.concat("p0", "q").alias("_path")).distinct()
    all_pairs = every.join(table, "site").where(robots.matches(F.col("_path"), F.col("pattern")))
    met = robots.rules_met(every, table)
    assert sorted(map(tuple, met.where(robots.matches(F.col("_path"), F.col("pattern"))).select(*all_pairs.columns).collect())) == sorted(map(tuple, all_pairs.collect()))

    longest = {}
    for r in all_pairs.collect():
        key = (r["_path"], r["group_ix"])
        longest.setdefault(key, {"allow": -1, "disallow": -1})
        longest[key][r["kind"]] = max(longest[key][r["kind"]], len(r["pattern"]))
    blocked = {path for (path, _), best in longest.items() if best["disallow"] > best["allow"]}
    got = {r["url"].removeprefix("https://ex.test"): r["allowed"] for r in robots.allowed(frame, table).collect()}
    assert got == {p: p not in blocked for p in paths} and blocked and len(blocked) < len(paths)


def test_many_rules_make_few_rows(spark):
    rules = spark.range(2000).select(F.lit("ex.test").alias("site"), F.lit(1).alias("group_ix"), F.lit("*").alias("user_agent"), F.lit("disallow").alias("kind"), F.concat(F.lit("/s"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("/")).alias("pattern"))
    paths = spark.range(500).select(F.lit("ex.test").alias("site"), F.concat(F.lit("/s"), F.lpad((F.col("id") * 5).cast("string"), 4, "0"), F.lit("/page")).alias("_path"))
    met = robots.rules_met(paths, rules)
    assert met.count() == 400  # one prefix length: a path meets the rule it begins with, and no other
