"""Periodic runs of words, by comparing the word ids with every shift of themselves.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbour extends, at least
``min_exp`` periods and ``min_words`` words long. For every lag up to n / ``min_exp`` the word-id array is compared with
itself shifted by that lag; a stretch of equal places that is long enough is a run. A stretch that long holds four
neighbours of any grid that is a quarter as wide, so each shift is compared on that grid first, and stretches are measured
only where four neighbours agree: nothing is lost, and all lags of n words cost about n log n comparisons.

The documents of a batch are scanned as one array: words of different documents never have the same id, so no stretch
crosses a border. Documents of more than ``LAGS`` possible lags are dealt to tasks as (document, lag range) rows and their
runs are put together by document; all others are scanned where they are read, without a shuffle.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; texts of any length are
scanned whole; repeated rows each get their own row; a run that several lags see is one run, of its smallest period;
extra columns are ignored; an empty table gives no rows. A null id is a value like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.rows import named, row_key
from pagewright.session import nullable, text_batches

MIN_EXP = 2
MIN_WORDS = 12
#: Lags of a document that one task scans, unless that would make more than ``RANGES`` ranges of it.
LAGS = 8192
RANGES = 64

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: (id, words) -> for each place the place whose word stands there, or None to leave the words as they are.
Rewrite = Callable[[object, int], "np.ndarray | None"]


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII spaces, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _agrees(words: np.ndarray, start: int, end: int, period: int) -> bool:
    return bool((words[start : end - period] == words[start + period : end]).all())


def smallest_period(words: np.ndarray, start: int, end: int, period: int) -> int:
    """Of a run of at least two periods: the smallest period divides every other one."""
    left = period
    for factor in range(2, math.isqrt(period) + 1):
        while left % factor == 0:
            left //= factor
            if _agrees(words, start, end, period // factor):
                period //= factor
    return period // left if left > 1 and _agrees(words, start, end, period // left) else period


def _stretch(words: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The longest stretch around place ``at`` whose words equal those ``lag`` later."""
    end, step = at, 64
    while end + lag < len(words):
        stop = min(end + step, len(words) - lag)
        differs = words[end:stop] != words[end + lag : stop + lag]
        if differs.any():
            end += int(differs.argmax())
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start > 0:
        stop = max(start - step, 0)
        differs = (words[stop:start] != words[stop + lag : start + lag])[::-1]
        if differs.any():
            start -= int(differs.argmax())
            break
        start, step = stop, step * 2
    return start, end


def scan(words: np.ndarray, sizes: np.ndarray, first: int, last: int, min_exp: int = MIN_EXP, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the runs that lags ``first`` to ``last`` see.

    ``words`` holds the ids of documents of ``sizes`` words one after the other, longest first; ids of two documents
    differ. ``last`` may be beyond what the documents allow.
    """
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []  # runs long enough for the next lag: its multiples see them again
    ends, falling = np.cumsum(sizes), -sizes
    for lag in range(first, min(last, int(sizes[0]) // min_exp if len(sizes) else 0) + 1):
        part = int(np.searchsorted(falling, -max(min_exp * lag, min_words), "right"))
        if part == 0:
            break
        size, least = int(ends[part - 1]), max((min_exp - 1) * lag, min_words - lag)
        step = max(1, least // 4)
        same = words[: size - lag : step] == words[lag:size:step]
        agreed = same
        for k in range(1, min(4, least)):
            agreed = agreed[:-1] & same[k:]
        hits = np.flatnonzero(agreed) * step
        if not len(hits):
            continue
        known = [run for run in known if run[1] - run[0] >= min_exp * lag]
        for start, end, period in known:
            if lag % period == 0:
                hits = hits[(hits < start) | (hits >= end - lag)]
        done = -1
        for at in hits.tolist():
            if at < done:
                continue
            start, done = _stretch(words[:size], lag, at)
            if done - start >= least:
                end = done + lag
                period = smallest_period(words, start, end, lag)
                found[start, end] = min(period, found.get((start, end), period))
                known.append((start, end, period))
    return [(start, end, period) for (start, end), period in found.items()]


def scan_batch(texts: list[list[bytes]], first: int, last: int, places: list, **limits: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words, ``(start, length, period)`` of its runs. ``places`` rewrite the words, or are None."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ids = np.empty(int(sizes.sum()), np.int32)
    at = used = 0
    for i in order:
        seen: dict[bytes, int] = {}
        n = len(texts[i])
        own = np.fromiter((seen.setdefault(w, len(seen)) for w in texts[i]), np.int32, n)
        ids[at : at + n] = used + (own if places[i] is None else own[places[i]])
        at, used = at + n, used + len(seen)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in scan(ids, sizes, first, last, **limits):
        k = int(np.searchsorted(starts, start, "right")) - 1
        while sizes[k] == 0:
            k -= 1
        out[order[k]].append((start - int(starts[k]), end - start, period))
    return out


def settled(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Each run once, with its smallest period, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], places: np.ndarray | None, runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by one space."""
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:n]) == 0)
    kept = kept if places is None else places[kept]
    return b" ".join([words[i] for i in kept.tolist()]).decode("utf-8", "surrogatepass")


def _as_rows(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs]


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_exp: int = MIN_EXP,
    min_words: int = MIN_WORDS,
    rewrite: Rewrite | None = None,
    lags: int = LAGS,
) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` for every row of ``docs``."""
    if min_exp < 2:
        raise ValueError("a run holds two periods at least")
    text_batches(docs.sparkSession)
    limits = {"min_exp": min_exp, "min_words": min_words}
    possible = F.coalesce(F.length(named(text)), F.lit(0)) / F.lit(2 * min_exp) + 1  # words are half the characters at most
    ranges = F.least(F.lit(RANGES), F.ceil(possible / lags)).cast("int")
    rows = docs.select(named(id_col).alias("_id"), named(text).alias("_text"), ranges.alias("_ranges"))
    out = nullable(rows.select("_id", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema)

    def places(row_id: object, n: int) -> np.ndarray | None:
        return rewrite(row_id, n) if rewrite and n else None

    def results(ids: pa.Array, texts: list[list[bytes]], moved: list, runs: list) -> pa.RecordBatch:
        runs = [settled(r) for r in runs]
        shown = [collapse(w, m, r) for w, m, r in zip(texts, moved, runs)]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, texts), pa.int64()), pa.array(map(_as_rows, runs), _RUNS), pa.array(shown, pa.string())], names=out.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t.as_py()) for t in batch.column(1)]
            moved = [places(i, len(w)) for i, w in zip(batch.column(0).to_pylist(), texts)]
            yield results(batch.column(0), texts, moved, scan_batch(texts, 1, len(max(texts, key=len, default=())), moved, **limits))

    short = rows.where("_ranges = 1").select("_id", "_text").mapInArrow(whole, out)

    # long documents: alike rows once, and a row for each range of lags
    key = row_key(rows.select("_id", "_text"))
    long = rows.where("_ranges > 1").withColumn("_key", key)
    alike = long.groupBy("_key").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"), F.first("_ranges").alias("_ranges"), F.count(F.lit(1)).alias("_copies"))
    dealt = alike.select("_key", "_id", "_text", "_ranges", F.explode(F.sequence(F.lit(0), F.col("_ranges") - 1)).alias("_range"))
    dealt = dealt.repartition(F.xxhash64("_key", "_range"))
    part = nullable(dealt.select("_key", F.lit(None).cast(RUNS).alias("_runs")).schema)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                row_id, value, n_ranges, at = (batch.column(c)[row].as_py() for c in (1, 2, 3, 4))
                words = words_of(value)
                most = len(words) // min_exp
                first, last = most * at // n_ranges + 1, most * (at + 1) // n_ranges
                runs = scan_batch([words], first, last, [places(row_id, len(words))], **limits)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([_as_rows(runs)], _RUNS)], names=part.names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t.as_py()) for t in batch.column(1)]
            moved = [places(i, len(w)) for i, w in zip(batch.column(0).to_pylist(), texts)]
            runs = [[(r["start"], r["length"], r["period"]) for r in found] for found in batch.column(2).to_pylist()]
            yield results(batch.column(0), texts, moved, runs)

    runs = dealt.mapInArrow(ranged, part).groupBy("_key").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))  # fewer runs than words
    copies = alike.join(runs, "_key").select("_id", "_text", "_runs", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return short.unionByName(copies.select("_id", "_text", "_runs").mapInArrow(joined, out)).withColumnRenamed("_id", id_col)


def planted(row_id: object, n: int) -> np.ndarray | None:
    """The contract's repetition: in a tenth of the documents, words from place a on repeat with period p."""
    h = crc32(str(row_id).encode()) if row_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=planted)
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", F.try_element_at(longest, F.lit(1)))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
