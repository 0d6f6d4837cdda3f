"""Periodic runs against a word-by-word definition."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import periodic_runs
from tests.llm.helpers import LONG, awkward, documents, with_clashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_words=12, min_exp=2):
    """Every (start, length, period), straight from the definition."""
    n, best = len(words), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_exp * q):
                best.setdefault((i, j + q), q)  # lags rise: the first one seen is the smallest period
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs),
        *(top or (None,) * 3),
        1000 * top[1] // top[2] if top else None,
        hashed("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        hashed(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def texts(seed, count):
    """Repeats of several periods, nested and neighbouring, over small and large vocabularies."""
    rng = random.Random(seed)
    for _ in range(count):
        vocabulary = [chr(97 + i) for i in range(rng.choice((1, 2, 3, 20)))]
        words = []
        while len(words) < rng.randint(0, 150):
            unit = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
            words += unit * rng.choice((1, 1, 2, 3, 8)) + unit[: rng.randint(0, len(unit))]
        yield rng.choice((" ", "\n", "  ", "\t\v")).join(words)


def test_runs_match_the_definition_whatever_the_ranges_of_lags(spark):
    found = list(texts(1, 300))
    lists = [t.encode().split() for t in found]
    for ranges in ((1, 10_000),), ((1, 1), (2, 2), (3, 7), (8, 30), (31, 10_000)):
        got = [[] for _ in lists]
        for first, last in ranges:
            for out, runs in zip(got, periodic_runs.scan_batch(lists, first, last, [None] * len(lists))):
                out += runs
        for words, runs in zip(lists, got):
            assert periodic_runs.settled(runs) == brute(words)


@pytest.mark.parametrize("min_exp, min_words", [(2, 2), (3, 12), (4, 1)])
def test_other_limits(min_exp, min_words):
    lists = [t.encode().split() for t in texts(2, 80)]
    for words, runs in zip(lists, periodic_runs.scan_batch(lists, 1, 10_000, [None] * len(lists), min_exp=min_exp, min_words=min_words)):
        assert periodic_runs.settled(runs) == brute(words, min_words, min_exp)


def test_query_matches_the_contract(spark, tmp_path):
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(3, 150))] + [(900, None, "en", "a"), (901, "", None, None), (901, "", None, None), (902, " \n ", "en", "a")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    assert {g[0]: g[1:] for g in got} == {i: expected(i, t) for i, t, _, _ in rows}


def test_ranges_of_lags_dealt_to_tasks_give_the_same_rows(spark):
    rng = random.Random(4)
    unit = [f"w{rng.randint(0, 40)}" for _ in range(700)]
    long = " ".join(unit * 3 + ["x"] * 900 + unit[:100])
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (2, long + " end", "en", "a"), (None, "y " * 5000, None, None), (3, "a b " * 10, "en", "a")]
    docs = with_clashes(documents(spark, rows))
    read = lambda df: sorted((repr(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect())
    dealt = read(periodic_runs.periodic_runs(docs, lags=64))
    assert dealt == read(periodic_runs.periodic_runs(docs)) and len(dealt) == 5
    assert [r[2] for r in dealt if r[0] == "None"] == [[(0, 5000, 1)]]
    assert (0, 2100, 700) in dealt[0][2] and (2100, 900, 1) in dealt[0][2]


def test_one_word_repeated_is_not_scanned_square():
    ids = np.zeros(400_000, np.int32)
    assert periodic_runs.scan(ids, np.array([400_000]), 1, 3_000) == [(0, 400_000, 1)]


def test_awkward_tables(spark):
    got = periodic_runs.periodic_runs(awkward(spark))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == 10
    assert rows[1]["runs"] == [] and rows[1]["collapsed"] == "" and rows[3]["n_words"] == 0
    assert [tuple(r) for r in rows[5]["runs"]] == [(0, 40_000, 2 * 97 * 89)]  # the two cycles of LONG meet after 97 * 89 pairs
    assert periodic_runs.periodic_runs(awkward(spark).where(F.lit(False))).count() == 0
