"""Url filters, source mixing, packing, vector search and vector near-duplicates."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann_search, embedding_dedup, mixing, packing, url_filter
from tests.llm.helpers import awkward, documents, rows_of, with_clashes

# --- url filters

PAGES = "page_id long, url string, html string"


def test_url_rules_and_precedence(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "https://a.example.net/x", ""),  # net/ blocks
        (2, "https://a.example.net/en/x", ""),  # the longer rule allows
        (3, "http://EXAMPLE.com/de/1?x#y", ""),
        (4, "https://example.com/fr/1", '<link rel="canonical" href="http://example.com/de/1?x">'),  # alias of a blocked page
        (5, "https://q.org/fr/1", link.format("https://a.example.net/x")),  # blocked alias, but its own rule allows
        (6, "https://plain.io/p", '<meta http-equiv="refresh" content="0; url=/q">'),
        (7, "https://plain.io/q", '<link rel=canonical href="//z.net/">'),  # chain to a blocked url that is no page
        (8, "https://free.io/", ""),
        (9, "nonsense", None),
        (10, None, "x"),
        (11, "https://x.net", ""),  # an empty path starts with no rule's path
        (12, "https://notexample.com/de/", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    verdicts = {i: (got[i]["rule"], got[i]["verdict"]) for i in got}
    assert verdicts == {
        1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("example.com/de/", "block"), 4: (None, "block"), 5: ("org/fr/", "allow"),
        6: (None, "block"), 7: (None, "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"),
    }
    assert (got[3]["host"], got[3]["path"]) == ("example.com", "/de/1")
    assert (got[9]["host"], got[9]["path"], got[10]["host"]) == ("", "", "")


def test_url_references_comments_and_long_html(spark):
    filler = "<p>" + "x" * 300_000 + "</p>"
    rows = [
        (1, "https://a.net/p?x=1&y=2", None),  # blocked by rule
        (2, "https://free.io/1", '<link rel="canonical" href="https://a.net/p?x=1&amp;y=2">'),
        (3, "https://free.io/2", filler + '<link rel="canonical" href="https://a.net/p?x=1&#38;y=2">'),
        (4, "https://free.io/3", '<!-- <link rel="canonical" href="https://a.net/p?x=1&amp;y=2"> -->'),
        (5, "https://free.io/4", '<link rel="canonical" href="https://a.net/q?x=1&amp;amp;y=2">'),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5)] == ["block", "block", "block", "allow", "block"]
    assert got[1]["alias_of"] == got[2]["alias_of"] == got[3]["alias_of"] and got[4]["alias_of"] is None


def test_url_columns_with_dots(spark):
    pages = spark.createDataFrame([(1, "https://a.net/", None)], PAGES).withColumnsRenamed({"url": "the.url", "html": "the.html", "page_id": "page.id"})
    (row,) = url_filter.judge(pages, url="the.url", html="the.html", keep=("page.id",)).collect()
    assert row["page.id"] == 1 and row["verdict"] == "block"


def test_url_redirect_table_and_awkward_rows(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.io/p", None) for i in range(40)] + [(0, "https://h0.io/p", None)], PAGES)
    hops = [(f"https://h{i}.io/p", f"https://h{i + 1}.io/p") for i in range(20)] + [("https://h20.io/p", "http://w.net/"), (None, "https://h30.io/p")]
    redirects = spark.createDataFrame(hops, "a string, b string")
    got = url_filter.judge(pages, redirects)
    assert Counter(r["verdict"] for r in got.collect()) == {"block": 22, "allow": 19}  # the repeated row counts twice
    assert rows_of(url_filter.judge(with_clashes(pages), redirects)) == rows_of(got)
    assert url_filter.judge(pages.limit(0)).count() == 0


# --- source mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), repeat=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free} if total else {}
        over = [s for s in free if target[s] > repeat * sizes[s]]
        if not over:
            return target
        for s in over:
            capped.add(s)
            target[s] = repeat * sizes[s]
        left = sum(sizes.values()) - sum(target[s] for s in capped)


@pytest.mark.parametrize(("seed", "block"), [(1, 128), (2, 7)])
def test_mixing_meets_targets(spark, seed, block):
    rng = random.Random(seed)
    sources = ["s%d" % i for i in range(7)] + [None, "", "é", "tiny"]
    rows = []
    for i in range(300):
        source = "tiny" if i == 0 else rng.choice([*sources[:-1], "s1", "s1", "s1"])
        rows.append((i, " ".join("w" for _ in range(3 if i == 0 else rng.choice([0, 1, 5, 50, 700]))), "en", source))
    docs = documents(spark, rows)
    got = mixing.mix(docs, keep=("doc_id", "source"), block=block).collect()
    again = mixing.mix(docs.repartition(3), keep=("doc_id", "source"), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len((t or "").split()) for i, t, _, _ in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rng = random.Random(4)
    rows = [(i, "  ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 40, 900]))), "en", rng.choice(["a", "b", None])) for i in range(60)]
    rows.append(rows[5])  # a repeated row
    docs = documents(spark, rows)
    texts, sizes = {i: (t or "").split() for i, t, _, _ in rows}, Counter()
    for _, t, _, source in rows:
        sizes[source] += len((t or "").split())
    made = mixing.mixed_documents(docs)
    assert made.dtypes == docs.dtypes
    words, by_source = Counter(), Counter()
    for r in made.collect():
        found = r["text"].split()
        it = iter(texts[r["doc_id"]])
        assert all(w in it for w in found)  # in order, nothing twice within a use
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(found)
        by_source[r["source"]] += len(found)
    copies = Counter(i for i, *_ in rows)
    assert all(0 < n <= 3 * copies[i] * len(texts[i]) for i, n in words.items())
    target = brute_targets(dict(sizes))
    assert all(abs(by_source[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs)
    assert got.count() == 10
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["size"] == by[1]["taken"] == 0 and by[5]["size"] == 40_000
    assert rows_of(mixing.mix(with_clashes(docs))) == rows_of(got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id < 3")).count() == 2  # no words at all
    assert mixing.mixed_documents(with_clashes(docs)).columns == with_clashes(docs).columns
    odd = docs.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    assert mixing.mixed_documents(odd).dtypes == odd.dtypes and mixing.mixed_documents(odd).where("doc_id = 5").count() > 0


def test_permutation_is_one_in_both_directions(spark):
    for n in (1, 2, 97, 1000):
        x, size, key = F.col("id"), F.lit(n).cast("long"), (F.lit(17), F.lit(3), F.lit(0))
        there = mixing.permuted(x, size, *key)
        rows = spark.range(n).select("id", there.alias("x"), mixing.permuted(there, size, *key, back=True).alias("back")).collect()
        assert sorted(r["x"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)


def test_permutations_scatter_and_differ(spark):
    n = 5000
    of = lambda *key: [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), *map(F.lit, key))).collect()]
    one, other, turned = of(17, 0, 0), of(17, 1, 0), of(17, 0, 1)
    for p in (one, other, turned):
        steps = Counter((b - a) % n for a, b in zip(p, p[1:]))
        assert max(steps.values()) < 20  # no fixed step between neighbouring slots
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.06
    assert sum(a == b for a, b in zip(one, other)) < 20 and sum(a == b for a, b in zip(one, turned)) < 20


def test_mixing_slots_match_an_independent_count(spark):
    """Words taken of every document, from the shard counts and the permutation alone, slot by slot."""
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.choice([0, 3, 60])), "en", rng.choice(["a", "a", "b", None])) for i in range(120)]
    docs = documents(spark, rows)
    block, shard, seed = 16, 8, 17
    sized = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    pieces = mixing.mix_pieces(sized, ["doc_id"], [F.col("doc_id"), F.col("size")], block=block, shard=shard, seed=seed).collect()
    spots = {(r["s"], r["at"]): (r["source"], r["size"]) for r in pieces}
    streams = {}
    for (s, at), (source, size) in sorted(spots.items()):
        streams.setdefault(s, []).extend([at] * size)  # the document of every word, in order
    target = brute_targets({src: sum(n for x, n in spots.values() if x == src) for src in {x for x, _ in spots.values()}})
    expected = Counter()
    for s, stream in streams.items():
        source = next(src for (k, _), (src, _) in spots.items() if k == s)
        goal, size, turn = int(target[source] + 0.5), len(stream), 0
        while goal > 0:
            full = size // block
            order = [r[0] for r in spark.range(full).select(mixing.permuted(F.col("id"), F.lit(full).cast("long"), F.lit(seed), F.lit(s).cast("long"), F.lit(turn).cast("long"))).collect()]
            for b in [*order, *([full] if size % block else [])]:
                words = stream[b * block : (b + 1) * block][: max(0, goal)]
                goal -= len(words)
                expected.update((s, at) for at in words)
            turn += 1
    got = Counter()
    for r in pieces:
        got[(r["s"], r["at"])] += (r["words"] or 0) * r["times"] - (r["cut"] if r["words"] else 0)
    assert {k: v for k, v in got.items() if v} == dict(expected)


# --- packing


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


@pytest.mark.parametrize("text", [None, "", "Hello  world's naïve 日本語 text\n\n 12345 !!", "a <|endoftext|> b", "  x​", "x" * 5000, "🙂👍🏽 é́"])
def test_encoding_is_the_tokenizers(text):
    assert packing.encode(text).tolist() == reference_ids(text).tolist()


def test_encoding_of_random_texts_is_the_tokenizers():
    rng = random.Random(31)
    classes = [
        "abcXYZ", "0123456789", " \t\n\r\x0b\x0c", "\u00a0\u2003\u3000\u200b\ufeff\u2028", ".,;:!?'\"-_()[]{}<>/\\|@#$%^&*+=~`", "éüßøçñ", "дж", "日本語한", "אבعر", "🙂👍🏽\u200d🇩🇪",
        "\u0301\u0308", "\x00\x07\x7f", "ⅷ½²", "'s't'll",
    ]
    for _ in range(400):
        text = "".join("".join(rng.choices(rng.choice(classes), k=rng.randint(1, 5))) for _ in range(rng.randint(0, 30)))
        assert packing.encode(text).tolist() == reference_ids(text).tolist(), repr(text)


def histogram(name):
    rng = np.random.default_rng(0)
    made = {
        "uniform": lambda: rng.integers(1, 2049, 20_000),
        "six": lambda: rng.choice([100, 300, 517, 700, 900, 1100], 7000),
        "lognormal": lambda: np.clip(rng.lognormal(5.8, 1.0, 16_000).astype(int), 1, 2048),
        "middle": lambda: rng.integers(600, 1101, 20_000),
        "few": lambda: np.clip(rng.lognormal(6, 1.0, 1100).astype(int), 1, 2048),
        "many": lambda: np.repeat(rng.integers(600, 1101, 4000), 5000),
    }[name]()
    return {n: c for n, c in Counter(made.tolist()).items() if n < packing.CAPACITY}


@pytest.mark.parametrize("name", ["uniform", "six", "lognormal", "middle", "few", "many"])
def test_plan_is_near_the_bound_and_never_worse_than_best_fit(name):
    counts = histogram(name)
    program = packing.solve_program(counts)
    volume = sum(n * c for n, c in counts.items()) / packing.CAPACITY
    assert program.bound >= volume - 1e-6
    covered = Counter()
    for fill, times in program.fills.items():
        assert times > 0 and sum(n * a for n, a in fill) <= packing.CAPACITY
        for n, a in fill:
            covered[n] += a * times
    assert all(covered[n] >= c * (1 - 1e-9) for n, c in counts.items())  # the fractional plan is feasible
    chosen, left = packing.rounded(program, counts)
    assert sum(t for _, t in chosen) >= {"few": 0.4, "uniform": 0.6, "lognormal": 0.6}.get(name, 0.9) * program.bound  # less where lengths are as many as pieces
    plan = packing.sequences(packing.plan_fills(counts))
    assert plan <= packing.sequences(packing.best_fit_fills(counts, packing.CAPACITY))
    assert np.ceil(program.bound - 1e-6) <= plan <= 1.01 * program.bound + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_exactly(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.choice([rng.randint(1, 2048), 2048, 1, 700]) for _ in range(rng.choice([1, 30, 600]))))
    fills = packing.plan_fills(counts, rounds=60)
    used = Counter()
    for fill, times in fills:
        assert times > 0 and sum(n * a for n, a in fill.items()) <= 2048
        for n, a in fill.items():
            used[n] += a * times
    assert used == Counter(counts)
    volume = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in fills) <= 1.25 * volume / 2048 + 2


def check_packed(rows, texts):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    for i, text in texts.items():
        ids = reference_ids(text)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == packing.CAPACITY for r in pieces[1:])
        for r in pieces:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    return len(by_sequence)


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "gamma", "ß"], k=rng.choice([0, 3, 400, 5000]))) for i in range(80)}
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    rows = packing.pack(packing.pieces(docs).persist()).collect()
    n = check_packed(rows, texts)
    assert n <= 1.1 * sum(r["length"] for r in rows) / packing.CAPACITY + 1


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    got = packing.pieces(docs)
    assert got.where("doc_id = 1").select("length").first()[0] == 1
    assert got.where("doc_id = 7").count() == 2
    assert rows_of(packing.pieces(with_clashes(docs))) == rows_of(got)
    packed = packing.pack(got.persist()).collect()
    assert len(packed) == got.count()
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


# --- vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=900, dim=24, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    odd = [(n, None, 0), (n + 20, [], 0), (n + 40, [0.0] * dim, 1), (n + 60, [None] + [1.0] * (dim - 1), 1), (n + 80, [float("nan")] * dim, 1), (n + 100, [float("inf")] + [1.0] * (dim - 1), 1)]
    same = [(n + 200 + i, rows[0][1], i) for i in range(50)]
    return spark.createDataFrame(rows + odd + same, VECTORS), {i: np.array(v, np.float32).astype(float) for i, v, _ in rows + same}


def test_embedding_near_dedup_matches_brute_force(spark):
    df, good = vectors(spark)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    expected = {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
    for tile in (embedding_dedup.TILE, 64):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
        assert len(got) == df.count()
        assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in expected} == expected
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in got if i not in expected)


def test_embedding_bounds_save_work_and_lose_nothing():
    rng = np.random.default_rng(3)
    for spread in (np.ones(64), 0.9 ** np.arange(64)):  # without and with dominant axes
        x = rng.normal(size=(700, 64)) * spread
        x = np.concatenate((x, x[:200] + 0.02 * rng.normal(size=(200, 64)) * spread))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        _, basis = np.linalg.eigh(unit.T @ unit)
        turned, work = unit @ basis[:, ::-1], []
        found = {(int(i), int(j)) for a, b in embedding_dedup.linked_pairs(x, x, turned, turned, 0.9, work) for i, j in zip(a, b)}
        assert found == set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.9))))
        assert sum(work) < 0.5 * len(x) ** 2 * 64


def test_embedding_near_dedup_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01], 0), (4, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = embedding_dedup.near_duplicates(df)
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got.collect()) == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4)]
    clash = df.withColumns({c: F.lit(1) for c in ("vec", "dim", "rid", "times", "first", "cell", "n_links")})
    assert rows_of(embedding_dedup.near_duplicates(clash)) == rows_of(got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_exact_scores(spark):
    df, good = vectors(spark, n=3000, seed=9)
    got = ann_search.search(df, lambda i: i % 20 == 0, shortlist=100, code_block=1000, query_block=100).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    hits = 0
    queries = [i for i in good if i % 20 == 0]
    assert set(by) == set(queries)
    for q in queries:
        scores = x @ good[q]
        order = [int(ids[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q][:20]
        rows = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float(good[q] @ good[r["vec_id"]]), rel=1e-12) for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hits += len(set(order) & {r["vec_id"] for r in rows})
    assert hits / (20 * len(queries)) >= 0.9


def test_search_prefers_smaller_ids_among_more_copies_than_the_shortlist(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0] + [0.0] * 6, 0) for i in range(1, 400)] + [(1000 + i, [float(v) for v in rng.normal(size=8)], 0) for i in range(1500)] + [(0, [2.0, 0.0] + [0.0] * 6, 0)]
    got = ann_search.search(spark.createDataFrame(rows, VECTORS), lambda i: i == 0, k=5, shortlist=40, code_block=500).collect()
    best = sorted(((-2 * v[0], i) for i, v, _ in rows if i))[:5]
    exact_ties = [r["vec_id"] for r in got if r["score"] == 2.0]
    assert exact_ties == sorted(exact_ties) and len(got) == 5
    if best[-1][0] == -2.0:
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in best]


def test_search_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, None, 0), (4, [0.0, 0.0], 0), (20, [1.0, 0.0, 0.0], 0), (None, [9.0, 9.0], 0), (40, [-1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = ann_search.search(df, lambda i: i % 20 == 0)
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()]
    assert sorted(found) == [(0, 1, 1), (0, 2, 2), (0, 3, 40), (40, 1, 1), (40, 2, 2), (40, 3, 0)]
    assert ann_search.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("id", "rid", "dim", "vec", "code", "score", "rank", "query_id")})
    assert rows_of(ann_search.search(clash, lambda i: i % 20 == 0)) == rows_of(got)
