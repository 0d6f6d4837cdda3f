"""Quality selection by importance resampling.

Two generative models over hashed n-grams (unigrams and bigrams of words and punctuation runs, ``BUCKETS`` buckets) are
counted: one of target text, one of the raw corpus. A document's importance weight is the ratio of its probabilities
under the two; adding Gumbel noise to log weights and keeping the top k draws k documents without replacement in
proportion to their weights. k is the stated share of the rows.

The raw model counts every document. The target model counts the documents labelled as good, at most ``TARGET_ROWS`` of
them, chosen by hash; this is the one bounded sample. Counts are summed per task before they are shuffled, and only the
two count tables, ``BUCKETS`` entries each, reach the driver. The k-th key is found by range partitions numbered apart.

Defined results: a null or blank text has no n-grams and log weight 0; without any target document all log weights are
0; noise depends on the id alone, so reruns agree and repeated rows get the same key; ties go to the smaller id; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.ranking import range_index
from pagewright.session import checkpointed, nullable, text_batches

BUCKETS = 10_000
TARGET_ROWS = 20_000
SHARE = 0.85
SEED = 29

_CODE = np.arange(256, dtype=np.uint8)
#: 0 white space, 1 word, 2 punctuation; bytes of other alphabets are word bytes.
CLASSES = np.where(np.isin(_CODE, list(b" \t\n\r\x0b\x0c")), 0, 2).astype(np.uint8)
CLASSES[[c for c in range(256) if c >= 128 or chr(c).isalnum() or c == 95]] = 1
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; the longest table made is kept."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 17), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def buckets_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every unigram and bigram of a text, repeats included."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    kind = CLASSES[raw]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(raw)]))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    # polynomial hashes of all tokens from one running sum
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(raw)), dtype=np.uint64)))
    hashed = (running[ends] - running[starts]) * _power(INVERSE, len(raw) + 1)[starts]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pairs = (hashed[:-1] * np.uint64(3) + hashed[1:]) ^ np.uint64(0x5851F42D4C957F2D)
    both = np.concatenate((hashed, pairs))
    both ^= both >> np.uint64(32)
    return (both % np.uint64(buckets)).astype(np.int64)


def count_buckets(docs: DataFrame, text: str, target: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all documents, and over those for which the boolean column ``target`` holds."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for value, wanted in zip(batch.column(0), batch.column(1)):
                found = np.bincount(buckets_of(value.as_py(), buckets), minlength=buckets)
                raw += found
                if wanted.as_py():
                    good += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    counted = docs.select(text, target).mapInArrow(run, "bucket long, raw long, good long")
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, one added to every count; zeros if there is no target text."""
    if not good.sum():
        return np.zeros(len(raw))
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def resample(docs: DataFrame, labelled: DataFrame, text: str = "text", id_col: str = "doc_id", share: float = SHARE, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """``id_col, n_grams, log_weight, gumbel_key, selected`` per row; ``labelled`` lists the ids of target documents."""
    spark: SparkSession = docs.sparkSession
    by_hash = F.xxhash64(id_col, F.lit(seed))
    ids = labelled.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(by_hash, id_col).limit(target_rows)
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(checkpointed(ids).select(F.col(id_col).alias("_id"), F.lit(True).alias("_good"))), "_id", "left")
    raw, good = count_buckets(marked, "_text", "_good", buckets)
    shared = spark.sparkContext.broadcast(log_ratios(raw, good))
    read = docs.select(id_col, F.col(text).alias("_text"))
    schema = nullable(read.drop("_text").withColumns({"n_grams": F.lit(0).cast("long"), "log_weight": F.lit(0.0)}).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            found = [buckets_of(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([float(ratio[f].sum()) for f in found], pa.float64())], names=schema.names
            )

    uniform = (F.pmod(F.xxhash64(id_col, F.lit(seed + 1)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = checkpointed(read.mapInArrow(score, schema).withColumn("gumbel_key", F.col("log_weight") - F.ln(-F.ln(uniform))))
    take = int(np.ceil(share * keyed.count()))
    ranked = range_index(keyed, [F.desc("gumbel_key"), F.asc(id_col)], "_rank")
    return ranked.withColumn("selected", F.col("_rank") < take).drop("_rank")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))


QUERIES = {"op8_importance_resampling": op8_importance_resampling}
ORACLES = {}
