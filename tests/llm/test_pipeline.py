"""The corpus pipeline: each stage against brute force on its own input, and the whole."""

from __future__ import annotations

import random

import corpus_pipeline
from pagewright.llm import secret_scan, simhash
from tests.llm.helpers import awkward, documents, with_clashes
from tests.llm.test_table_operators import check_packed


def corpus(spark):
    rng = random.Random(21)
    english, german = "the house and river with them that have this".split(), "das haus und der fluss mit ihnen die haben".split()
    rows = []
    for i in range(80):
        words = rng.choices(english if i % 2 else german, k=rng.randint(30, 400))
        rows.append((i, " ".join(w + str(rng.randint(0, 9)) if rng.random() < 0.3 else w for w in words), "en" if i % 2 else "de", rng.choice("abc")))
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(5)]  # exact copies
    rows += [(200, "12 34 !!", "en", "a"), (201, None, "en", "a"), (202, "the house password=abcdefgh12345 and river that have", "en", "b")]
    return documents(spark, rows), rows


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs, rows = corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    named = stages["language_id"](spark, docs, "")
    assert {r["doc_id"] for r in named.collect()} == {i for i, *_ in rows} - {200, 201}
    kept = stages["simhash_near_dedup"](spark, named, "")
    by_fp = {}
    for r in named.collect():
        by_fp.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])
    near = lambda a, b: (a ^ b).bit_count() <= simhash.MAX_BITS
    assert not any(near(a, b) for a in by_fp for b in by_fp if a < b)
    assert {r["doc_id"] for r in kept.collect()} == {min(ids) for ids in by_fp.values()}
    safe = stages["secret_scan"](spark, kept, "")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in safe.collect():
        assert r["text"] == secret_scan.redacted(texts[r["doc_id"]], secret_scan.find_spans(texts[r["doc_id"]]))
        assert not secret_scan.find_spans(r["text"]) and r["n_chars"] == len(r["text"])
    for made in (named, kept, safe):
        assert made.dtypes == docs.dtypes
    mixed = stages["source_mixing"](spark, safe, "").persist()
    assert mixed.dtypes == docs.dtypes
    source = {r["doc_id"]: r["text"].split() for r in safe.collect()}
    for r in mixed.collect():
        it = iter(source[r["doc_id"]])
        assert all(w in it for w in r["text"].split())
    once = mixed.dropDuplicates(["doc_id"])
    packed = stages["best_fit_packing"](spark, once, "").collect()
    check_packed(packed, {r["doc_id"]: r["text"] for r in once.collect()})


def test_stages_keep_columns_and_take_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.dtypes == docs.dtypes
        made.collect()
        assert stage(spark, docs.limit(0), "").count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, "").count() >= docs.count()
    assert last(spark, docs.limit(0), "").count() == 0


def test_run_is_the_stages_in_order(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= set(range(80)) | {202}
    assert sum(r["length"] for r in rows) > 0
    assert corpus_pipeline.ORACLE_SQL is None
