"""Similar pages by classes, and pages that join a segment one after another."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import rounded
from pagewright.operators import semantic, similar
from pagewright.operators.components import connected_components
from pagewright.plans import checks


def test_chains_of_waiting_pages_are_settled_or_an_error(spark):
    node = spark.range(1, 9).toDF("ix")
    near = spark.createDataFrame([(i, i - 1, 0.25, 1) for i in range(2, 9)], "ix long, nb long, sim double, place int")
    members = spark.createDataFrame([(1, 1)], "node long, component long")
    got = semantic.attached(node, near, members)
    assert sorted(tuple(r) for r in got.collect()) == [(i, 1) for i in range(1, 9)]
    with pytest.raises(RuntimeError):
        semantic.attached(node, near, members, max_rounds=2)  # seven steps take three rounds


def in_turn(lists, members):
    """The rule as it is worded: page after page."""
    joined = dict(members)
    for i in sorted(lists):
        if i not in members and (hit := next((j for j in lists[i] if j in joined), None)) is not None:
            joined[i] = joined[hit]
    return joined


def attach(spark, lists, members, **options):
    near = spark.createDataFrame([(i, j, 0.25, p) for i, js in lists.items() for p, j in enumerate(js, 1)], "ix long, nb long, sim double, place int")
    found = semantic.attached(spark.range(1), near, spark.createDataFrame(list(members.items()), "node long, component long"), **options)
    return {r["ix"]: r["segment"] for r in found.collect()}


def test_a_chain_of_5000_pages_takes_few_rounds(spark):
    lists = {i: [i - 1] for i in range(2, 5001)}
    assert attach(spark, lists, {1: 1}, max_rounds=14) == dict.fromkeys(range(1, 5001), 1)


def test_dead_ends_and_second_choices(spark):
    ladder = {i: [i - 1, i - 2] for i in range(12, 60)}  # leads to page 10 and 11, which have nobody
    ladder |= {100: [59, 1], 101: [100, 58], 102: [103, 59], 103: [2, 102], 104: [57, 56, 58]}
    assert attach(spark, ladder, {1: 1, 2: 2}) == in_turn(ladder, {1: 1, 2: 2})
    short = {i: js for i, js in ladder.items() if i < 16 or i > 100} | {100: [15, 1]}
    assert attach(spark, short, {1: 1, 2: 2}, in_a_task=0) == in_turn(short, {1: 1, 2: 2})


@pytest.mark.parametrize("seed", range(3))
def test_many_pages_join_as_in_turn(spark, seed):
    rng = random.Random(seed)
    members = {i: i // 5 * 5 for i in range(20)}
    lists = {}
    for i in range(20, 600):
        near = [j for j in range(max(0, i - 12), i + 12) if j != i and j >= 20] if rng.random() < 0.95 else list(range(20))
        lists[i] = rng.sample(near, rng.randint(0, 6))
    assert attach(spark, lists, members) == in_turn(lists, members)


def fixture(spark, rows):
    """Long vectors from ``(ix, {term: weight})``."""
    out = []
    for ix, terms in rows:
        norm = math.sqrt(sum(w * w for w in terms.values()))
        out += [(ix, t, float(w), i, norm) for i, (t, w) in enumerate(sorted(terms.items(), key=lambda x: (-x[1], x[0])), 1)]
    return spark.createDataFrame(out, "ix long, term string, weight double, place int, norm double")


def site_rows():
    """Pages known by their group only, templated pages, copies with terms in common with others, and pages of their own."""
    rng = random.Random(5)
    rows = [(i, {"group:a": 1.0}) for i in range(12)] + [(20 + i, {"group:b": 1.0}) for i in range(3)] + [(30, {"group:c": 1.0})]
    template = {f"t{j}": 3.0 - j / 4 for j in range(8)}
    rows += [(100 + 3 * i, template) for i in range(40)]
    rows += [(101 + 3 * i, {**template, f"own{i % 5}": 2.0}) for i in range(15)]
    for i in range(150):
        rows.append((300 + i, {f"w{int(rng.paretovariate(0.7)) % 200}": rng.uniform(0.1, 3) for _ in range(rng.randint(1, 24))}))
    return rows


def test_topics_of_classes_equal_their_sql(spark):
    vector = fixture(spark, site_rows()).persist()
    found = semantic.alike(vector)
    con = duckdb.connect()
    con.register("ve", vector.withColumnRenamed("ix", "p").toArrow())
    sql = "WITH " + checks._TOPIC_CTE[checks._TOPIC_CTE.index("si AS (") :]
    pairs = con.sql(f"{sql} SELECT a, b, floor(sim * 1e6 + 0.5) / 1e6 FROM si").fetchall()
    got = similar.expanded(found).withColumn("sim", rounded(F.col("sim"), 6)).collect()
    assert sorted(map(tuple, got)) == sorted(pairs) and sum(1 for a, b, _ in pairs if a < b < 20) == 66
    near = con.sql(f"{sql} SELECT a, b, floor(sim * 1e6 + 0.5) / 1e6, array_to_string(shared, '|'), place FROM kn").fetchall()
    mine = semantic.neighbours(vector, found).select("ix", "nb", rounded(F.col("sim"), 6), F.array_join("shared", "|"), "place").collect()
    assert sorted(map(tuple, mine)) == sorted(near)


def test_equal_pages_cost_one_vector_and_few_pairs_are_scored_in_vain(spark):
    vector = fixture(spark, site_rows())
    found = semantic.alike(vector)
    assert found.members.where("rep < 30 and ix < 30").select("rep").distinct().count() == 2
    assert found.members.where("rep = 100").count() == 40
    heads = vector.join(found.members.where("ix = rep").select("ix"), "ix", "left_semi")
    tried = similar.meetings(similar.offers(heads), semantic.LEAST_SIMILARITY).distinct().count()
    assert tried < 5 * found.pairs.where("a < b").count()


def test_terms_of_one_page_do_not_part_a_template(spark):
    template = {"t1": 3.0, "t2": 2.0, "t3": 1.0}
    vector = fixture(spark, [(i, {**template, f"own{i}": 1.5}) for i in range(300)] + [(900, {"t1": 1.0, "other": 2.0})]).persist()
    found = semantic.alike(vector)
    assert {(r["rep"], r["n"]) for r in found.members.groupBy("rep").agg(F.count("ix").alias("n")).collect()} == {(0, 300), (900, 1)}
    norm = 14 + 1.5**2
    assert {(r["a"], r["b"]): r["sim"] for r in found.pairs.collect()} == {(0, 0): pytest.approx(14 / norm), (0, 900): pytest.approx(3 / math.sqrt(norm * 5))}
    near = semantic.neighbours(vector, found).where("ix in (0, 7)").orderBy("ix", "place").select("ix", "nb", "shared").collect()
    assert [tuple(r) for r in near] == [(i, j, ["t1", "t2", "t3"]) for i in (0, 7) for j in [j for j in range(8) if j != i][:6]]


def test_tiles_give_what_one_does(spark, monkeypatch):
    vector = fixture(spark, site_rows()).persist()
    read = lambda found: (sorted(map(tuple, semantic.neighbours(vector, found).drop("sim").collect()), key=repr), sorted((r["a"], r["b"]) for r in found.pairs.collect()))
    plain = read(semantic.alike(vector))
    monkeypatch.setattr(similar, "BLOCK", 40)
    assert read(semantic.alike(vector)) == plain


def test_the_best_are_kept_whatever_is_held(monkeypatch):
    rng = np.random.default_rng(3)
    n, k = 60, 7
    sims = np.round(rng.random((n, n)), 1)  # many ties
    top = [sorted(rng.choice(12, rng.integers(0, 8), replace=False).tolist()) for _ in range(n)]
    ix = rng.permutation(1000)[:n]
    got = {}
    for held in (1, 1 << 21):
        monkeypatch.setattr(similar, "HELD", held)
        best = similar._Best(ix, pa.array(top, pa.list_(pa.int64())), k, 0.12)
        for i in range(n):
            j = np.array([j for j in range(n) if j != i])
            best.add(np.full(n - 1, i), j, sims[i, j])
        got[held] = [(int(a), int(b), int(c)) for a, b, _, c in zip(*best.settled())]
    common = lambda i, j: len(set(top[i]) & set(top[j]))
    want = [(i, j, common(i, j)) for i in range(n) for j in sorted((j for j in range(n) if j != i and sims[i, j] >= 0.12), key=lambda j: (-sims[i, j], -common(i, j), ix[j]))[:k]]
    assert got[1] == got[1 << 21] == want


def test_hot_classes_give_the_same(spark, monkeypatch):
    vector = fixture(spark, site_rows()).persist()
    read = lambda: sorted(map(tuple, semantic.neighbours(vector).collect()), key=repr)
    plain = read()
    monkeypatch.setattr("pagewright.operators.skew.PLAIN", 0)
    assert read() == plain


def test_pages_known_by_their_group_only_are_all_paired(spark):
    rows = [(i, {"group:a": 1.0}) for i in range(200)] + [(500 + i, {"group:b": 1.0}) for i in range(3)] + [(900, {"term": 1.0})]
    vector = fixture(spark, rows)
    found = semantic.alike(vector)
    assert found.pairs.count() == 2 and similar.expanded(found).count() == 200 * 199 + 3 * 2
    near = {}
    for r in semantic.neighbours(vector, found).collect():
        near.setdefault(r["ix"], []).append((r["place"], r["nb"]))
    assert {i: [nb for _, nb in sorted(v)] for i, v in near.items()} == {**{i: [j for j in range(8) if j != i][:6] for i in range(200)}, **{500 + i: [500 + j for j in range(3) if j != i] for i in range(3)}}
    joined = connected_components(semantic.strong_pairs(semantic.neighbours(vector, found)))
    assert {(r["node"], r["component"]) for r in joined.collect()} == {*((i, 0) for i in range(200)), *((500 + i, 500) for i in range(3))}


def test_pairs_of_pages_leave_the_tiles_unshuffled(spark):
    pairs = similar.expanded(semantic.alike(fixture(spark, site_rows())))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Union" not in plan


def test_large_classes_are_crossed_in_parts(spark, monkeypatch):
    vector = fixture(spark, site_rows()).persist()
    read = lambda: sorted((r["a"], r["b"], round(r["sim"], 9)) for r in semantic.page_pairs(vector).collect())
    plain = read()
    assert all(a < b for a, b, _ in plain) and len({(a, b) for a, b, _ in plain}) == len(plain)
    for block, part, sent in ((50_000, 1, 1), (40, 4, 16), (10, 7, 1 << 18)):
        for name, value in (("BLOCK", block), ("PART", part), ("SENT", sent)):
            monkeypatch.setattr(similar, name, value)
        assert similar.parts(semantic.alike(vector)).selectExpr("max(size(pages))").first()[0] < 40
        assert read() == plain
    ix = pa.array([list(range(9)), [20, 21], [30]])
    sent = list(similar._crossed(np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2]), np.ones(4), ix))
    assert max(len(c[0]) for c in sent) <= 1 << 18 and sum(len(c[0]) for c in sent) == 18 + 9 + 4 + 2
    monkeypatch.setattr(similar, "SENT", 10)
    cut = [c[0].tolist() for c in similar._crossed(np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2]), np.ones(4), ix)]
    assert [len(c) for c in cut] == [18, 9, 6] and sum(cut, []) == np.concatenate([c[0] for c in sent]).tolist()


def test_an_empty_site_has_no_topics(spark):
    node = spark.createDataFrame([], "ix long, page_id string, url string, grp string, depth int, issue_count int, inbound_links int")
    stored = spark.createDataFrame([], "page_id string, keyword string, score double")
    scores = semantic.keyword_scores(node, stored)
    vector = semantic.vectors(node, semantic.term_scores(node, scores))
    found = semantic.alike(vector)
    near = semantic.neighbours(vector, found).persist()
    numbered = semantic.segments(node, near)
    edge = spark.createDataFrame([], "source string, target string")
    empty = [vector, near, similar.expanded(found), numbered, semantic.segment_summary(node, vector, near, numbered), semantic.bridges(node, near, numbered), semantic.link_opportunities(node, near, edge)]
    empty += [semantic.cannibalisation(scores, found), semantic.keyword_distribution(scores, node), semantic.neighbour_report(node, near), semantic.path_clusters(node, semantic.term_scores(node, scores), numbered)]
    assert [df.count() for df in empty] == [0] * len(empty)
