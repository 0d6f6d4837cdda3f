"""Which sources of a language differ, and in which terms: a sort-based audit of smoothed term shares.

Each task counts the terms of its documents first, by language and source, so that what is shuffled is one partial row per
(language, term, source) and task, named after its first document: a term that stands in every document has no more rows
than tasks times sources. The partial rows are repartitioned by language and term and sorted within partitions, with source
and document behind (the term leads, as it tells rows apart soonest), and one scan over the runs of equal keys adds document
frequencies and counts and keeps the terms of enough documents. From the kept runs, every task emits partial sums for the
pairs of sources that hold a term of the run, and the terms that a source uses more than its language.

A term that only one of two sources holds adds a value that depends on its count alone, and a term that none holds adds
one value for the pair; so only terms held by both meet in a run, and the others are added by count and by pair. Pairs of
sources are the result itself: their number grows with the sources of a language, never with its documents.

Defined results: a null text, language or source is read as an empty one; rows alike are documents of their own; a text of
any length is read whole; a group without terms, or a language without kept terms, has its pairs with value 0 or as
smoothing alone gives it, and no term rows; ties go to the smaller item by its UTF-8 bytes; extra columns are ignored; an
empty table gives no rows. Counts are exact up to 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.rows import named
from pagewright.session import checkpointed, sized_batches

MIN_DOCS = 10
TOP = 10
#: The contract's scale of a share and its smoothing.
SCALE, SMOOTH = 1_000_000_000, 2
#: (language, source, term) keys that a task counts before it sends them on.
KEYS = 500_000
#: Cells of one block of the pair sums.
CELLS = 1_000_000

#: Letters, lower-cased, and bytes of other scripts stay; all else separates.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_PARTIAL = "lang string, term string, source string, doc bigint, df bigint, n bigint"
_KEPT = "lang string, term string, source string, n bigint, total bigint, head bigint"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


class _Counts:
    """Counts of a task's documents, emitted whenever they hold ``limit`` keys."""

    def __init__(self, limit: int):
        self.limit, self.size, self.groups = limit, 0, {}

    def add(self, lang: str, source: str, doc: int, terms: list[bytes]) -> None:
        _, df, n = self.groups.setdefault((lang, source), (doc, Counter(), Counter()))
        before = len(n)
        n.update(terms)
        df.update(set(terms))
        self.size += len(n) - before

    def emitted(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (doc, df, n) in self.groups.items():
            size = len(n)
            if size:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.array([v] * size, kind) for v, kind in ((lang, pa.string()), (source, pa.string()), (doc, pa.int64()))]
                counts = [pa.array([c[t] for t in n], pa.int64()) for c in (df, n)]
                yield pa.RecordBatch.from_arrays([same[0], terms, same[1], same[2], *counts], names=["lang", "term", "source", "doc", "df", "n"])
        self.size, self.groups = 0, {}


def _starts(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = batch.column(key)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut anew so that no run of equal keys is split, with the starts of their runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys) and len(starts) == 1:
            held.append(batch)  # a run that goes on
            continue
        cut = int(starts[-1])
        ready = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
        for whole in ready:
            yield whole, _starts(whole, keys)
        held = [batch.slice(cut)]
    if held:
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield whole, _starts(whole, keys)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per (language, term, source) of each batch, so that a held run has few rows however many partial ones it had."""
    for batch in batches:
        at = _starts(batch, ("term", "lang", "source"))
        if len(at):
            sums = [pa.array(np.add.reduceat(_numbers(batch, c), at)) for c in ("df", "n")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("lang", "term", "source")], *sums], names=["lang", "term", "source", "df", "n"])


def kept_runs(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, keys: int = KEYS) -> DataFrame:
    """``lang, term, source, n, total, head``: the counts of the terms that enough documents of their language hold.

    ``total`` is the term's count in the language; ``head`` is 1 on one row of a term and 0 on the others.
    """
    sized_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], named(text).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("lang", "source", "text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(keys)
        for batch in batches:
            for group, origin, value, doc in zip(*[c.to_pylist() for c in batch.columns]):
                counts.add(group, origin, doc, terms_of(value))
                if counts.size >= keys:
                    yield from counts.emitted()
        yield from counts.emitted()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_runs(by_source(batches), ("term", "lang")):
            df, sizes = np.add.reduceat(_numbers(batch, "df"), at), np.diff(np.append(at, batch.num_rows))
            stay = np.repeat(df >= min_docs, sizes)
            if not stay.any():
                continue
            total = np.repeat(np.add.reduceat(_numbers(batch, "n"), at), sizes)[stay]
            batch = batch.filter(pa.array(stay))
            inner = _starts(batch, ("term", "lang", "source"))  # parts of a source's run that came in different batches
            head = np.zeros(batch.num_rows, np.int64)
            head[_starts(batch, ("term", "lang"))] = 1
            n = np.add.reduceat(_numbers(batch, "n"), inner)
            columns = [*[batch.column(c).take(inner) for c in ("lang", "term", "source")], pa.array(n), pa.array(total[inner]), pa.array(head[inner])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "n", "total", "head"])

    partial = rows.mapInArrow(counted, _PARTIAL).repartition("lang", "term")
    return partial.sortWithinPartitions("term", "lang", "source", "doc").mapInArrow(kept, _KEPT)


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(``SCALE`` * (n + 2) / (total + 2 * size)); null where the language keeps no term."""
    top = (n + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(size > 0, F.call_function("div", top, (total + SMOOTH * size).cast("decimal(20,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(p: np.ndarray, zero: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source the sums over the terms of what its pairs with later sources gain where both hold the term."""
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for a in range(p.shape[1] - 1):
        mine, others, none, nones = p[:, a : a + 1], p[:, a + 1 :], zero[a], zero[None, a + 1 :]
        yield a, (f(mine, others) - f(mine, nones) - f(none, others) + f(none, nones)).sum(axis=0)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums ``lang, source, item, value`` for pairs of sources that hold a term of the same run.

    A source that lacks a term has its share without occurrences there, so its pairs gain nothing.
    """
    for batch, _ in whole_runs(batches, ("term", "lang")):
        found: list[tuple[str, str, pa.Array, np.ndarray]] = []
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            mine = batch.filter(pc.equal(langs.indices, code))
            at = _starts(mine, ("term",))
            row = np.repeat(np.arange(len(at)), np.diff(np.append(at, mine.num_rows)))
            coded = mine.column("source").dictionary_encode()
            names, column = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            zero = np.empty(len(names), np.int64)
            zero[column] = _numbers(mine, "zero")
            step = max(1, CELLS // len(names))
            for top in range(0, len(at), step):
                block = np.tile(zero, (min(step, len(at) - top), 1))
                chosen = (row >= top) & (row < top + step)
                block[row[chosen] - top, column[chosen]] = _numbers(mine, "p")[chosen]
                for a, sums in _block_sums(block, zero):
                    other = np.flatnonzero(sums)
                    if len(other):
                        found.append((lang, names[a].as_py(), names.take(pa.array(other + a + 1)), sums[other]))
        if found:
            sizes = [len(values) for *_, values in found]
            same = [pa.array(np.repeat(np.array([row[c] for row in found], object), sizes), pa.string()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*same, pa.concat_arrays([row[2] for row in found]), pa.array(np.concatenate([row[3] for row in found]))], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, keys: int = KEYS) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of a source's language by divergence (part ``pair``),
    and the terms that it uses more than its language (part ``term``, the first ``top``)."""
    kept = checkpointed(kept_runs(docs, text, lang, source, min_docs, keys))
    groups = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("head").alias("size"), F.sum("n").alias("all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    totals = checkpointed(
        groups.join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "size", "all_n")])
        .withColumn("zero", share(F.lit(0), F.col("group_n"), F.col("size")))
    )
    runs = kept.join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("size")))

    # pairs: what all terms would add without occurrences, what one side's occurrences change, what both change
    other = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    f = divergence
    none = f(F.col("zero"), F.col("other_zero"))
    base = totals.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("size") * none, F.lit(0)).alias("value"))
    held = runs.groupBy("lang", "source", "n", "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    one = held.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (f(F.col("p"), F.col("other_zero")) - none)).alias("value"))
    both = runs.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_met, "lang string, source string, item string, value bigint")
    changes = one.unionByName(both)
    turned = changes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(changes).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = share(F.col("total"), F.col("all_n"), F.col("size"))
    terms = runs.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    ranked = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked("pair", pairs).unionByName(ranked("term", terms).where(F.col("rank") <= top))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    p = f"1 + ({SCALE}::HUGEINT * ({{n}} + {SMOOTH})) // ({{total}} + {SMOOTH} * v)"
    f = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
words AS (SELECT k, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n,
             coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS group_n
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", total="group_n")} AS p, {p.format(n="k.total", total="all_n")} AS lang_p
           FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, item, sum({f}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY lang, source, item),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({f})::BIGINT AS value FROM (SELECT *, lang_p AS q FROM shares WHERE n > 0 AND p > lang_p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


QUERIES = {"op11_source_audit": op11_source_audit}
ORACLES = {"op11_source_audit": _oracle()}
