"""The source audit against its definition, and its scans on awkward runs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import source_audit
from tests.llm.helpers import LONG, awkward, documents, with_clashes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=10, top=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(lowered(text or ""))
        df[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own, q = shares(counts[lang, source]), shares(whole)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                theirs = shares(counts[lang, other])
                pairs.append((sum((own[t] - theirs[t]) ** 2 // (own[t] + theirs[t]) for t in kept), other))
        terms = [((own[t] - q[t]) ** 2 // (own[t] + q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in source_audit.audit(docs, **options).collect())


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "zwölf", "naïve", "a1b", "x-y", "中文", "\x00nul", "ß"] + [f"w{chr(97 + i)}" for i in range(12)]
    for i in range(n):
        lang = rng.choice(("en", "en", "en", "fr", None, ""))
        source = rng.choice(("hot", "hot", "b", "c", None, "é"))
        text = rng.choice((None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))))
        yield i % (n - 5), text, lang, source  # some ids come twice


def test_definition(spark):
    rows = list(sample(1, 400))
    docs = with_clashes(documents(spark, rows))
    expected = brute(rows)
    assert got(docs) == expected and any(r[2] == "term" for r in expected)
    assert got(docs.repartition(7), keys=9) == expected  # counts sent on early, every run in many parts
    assert got(docs, min_docs=60, top=2) == brute(rows, 60, 2)


def test_groups_without_kept_terms(spark):
    rows = [(1, "rare words", "en", "a"), (2, None, "en", "b"), (3, "", "fr", None), (4, "x " * 50, "de", "a")]
    assert got(documents(spark, rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_the_scale(spark):
    row = spark.range(1).select(source_audit.share(F.lit(5 * 10**11), F.lit(10**13), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (5 * 10**11 + 2) // (10**13 + 2 * 10**6)


def test_runs_over_batches_stay_whole():
    rng = random.Random(3)
    rows = sorted((rng.choice("ab"), rng.choice("xyz"), rng.choice("pq")) for _ in range(200))
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("lang", "term", "source"))})
    for size in (1, 3, 50, 500):
        seen = []
        for batch, at in source_audit.whole_runs(iter(table.to_batches(max_chunksize=size)), ("lang", "term")):
            runs = list(zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()))
            assert np.array_equal(at, [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]])
            seen.append(set(runs))
        assert sum(map(len, seen)) == len(set.union(*seen)) == len({r[:2] for r in rows})


def test_awkward_tables(spark):
    docs = awkward(spark)
    rows = [tuple(r)[:4] for r in docs.collect()]
    assert got(docs, min_docs=1) == brute(rows, 1) and LONG in {r[1] for r in rows}
    assert source_audit.audit(docs.where(F.lit(False))).count() == 0
