"""SimHash near-duplicate detection.

Texts are lower-cased (A-Z), split at ASCII white space and cut into shingles; every shingle votes with its XXH64 for
the bits of a 64-bit fingerprint. Fingerprints that differ in at most ``MAX_BITS`` bits are linked, and documents get
the smallest id of their connected component.

Pigeonhole blocks: with ``BLOCKS`` = 6 blocks, two fingerprints at 4 or fewer differing bits agree on at least two whole
blocks, so joining on every pair of blocks (20 to 22 bits) misses no link; candidates are verified by Hamming distance.
Work is on distinct fingerprints, so copies of a text cost nothing. Inside a bucket only a spanning set of links leaves
the task, never all pairs; a bucket above ``TILE`` fingerprints is cut into tiles, and every pair of tiles is compared
in a task of its own.

The buckets of a choice of blocks grow with the number of fingerprints: at 2^30 of them a bucket of 20 bits holds a
thousand, and from some 10^9 fingerprints on 7 or 8 blocks (three or four of which have to agree) make fewer pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a text of any length is hashed
whole; ties of ids within a component go to the smallest; a null id never names a component; repeated rows each get their own row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.forest import hook, run_bounds, sorted_runs
from pagewright.operators.components import connected_components
from pagewright.operators.skew import lookup
from pagewright.session import checkpointed, nullable, text_batches

WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCKS = 6
#: Fingerprints of a bucket that one task compares at once.
TILE = 8192
#: Runs of up to so many fingerprints are compared together with others and may emit all their links.
PAIRWISE = 8
#: Rows of 16 bytes that are sent to every task.
SENT = 200_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        first, last = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    else:
        first, last = [0], [len(joined)]
    digest, total = xxhash.xxh64_intdigest, len(first)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``keep`` + ``fp`` (the fingerprint as a signed long) per row."""
    text_batches(docs.sparkSession)
    read = docs.select(*keep, F.col(text).alias("_text"))
    schema = nullable(read.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            made = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(at)), np.uint64, batch.num_rows)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made.view(np.int64))], names=schema.names)

    return read.mapInArrow(run, schema)


def _block_keys(fp, blocks: int, shared: int):
    """An array of keys, one per choice of ``shared`` blocks: the choice and the bits of its blocks."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    offsets = [sum(widths[:i]) for i in range(blocks)]
    part = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in zip(offsets, widths)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), shared)):
        key = F.lit(n).cast("long")
        for b in chosen:
            key = F.shiftleft(key, widths[b]).bitwiseOR(part[b])
        keys.append(key)
    return F.array(*keys)


def spanning_links(fps: np.ndarray, split: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within ``max_bits`` connect: every pair below ``split`` (or, if 0 < split <
    len, every pair across it) is compared in stripes; only merges are kept."""
    n = len(fps)
    parent = np.arange(n)
    left, right = [], []
    rows = range(n) if split >= n else range(split)
    stripe = max(1, 500_000 // max(n, 1))
    for at in range(0, len(rows), stripe):
        top = min(at + stripe, len(rows))
        other = 0 if split >= n else split
        near = np.bitwise_count(fps[at:top, None] ^ fps[None, other:]) <= max_bits
        a, b = np.nonzero(near)
        a, b = a + at, b + other
        keep = a < b
        a, b = a[keep], b[keep]
        parent, a, b = hook(parent, a, b)
        left.append(a)
        right.append(b)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints whose components are those of all links; ``fps`` holds ``fp``."""
    shared = blocks - max_bits
    if shared < 1:
        raise ValueError("needs more blocks than bits that may differ")
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"), blocks, shared)).alias("key"))
    large = checkpointed(
        keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    )
    # tile of a fingerprint, then every pair of tiles that it takes part in; a bucket of one tile has the pair (0, 0)
    dealt = keyed.withColumn("tiles", F.lit(1)) if large.isEmpty() else keyed.join(large, "key", "left").select("fp", "key", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1))
    paired = dealt.withColumn("other", other).select(
        "key", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pair, side, fp in sorted_runs(batches, 2, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns]):
            fp = fp.view(np.uint64)  # bits are counted as unsigned
            starts, ends = run_bounds(key, pair)
            sizes = ends - starts
            left, right = [], []
            # small runs together: row i against row i + step while both are in one run
            small = sizes <= PAIRWISE
            member = np.repeat(small, sizes)
            run = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, int(sizes[small].max()) if small.any() else 0):
                at = np.flatnonzero(member[:-step] & (run[step:] == run[:-step]))
                hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
                left.append(fp[hit])
                right.append(fp[hit + step])
            for s, e in zip(starts[~small], ends[~small]):
                own = int((side[s:e] == 0).sum())
                diagonal = (pair[s] >> 31) == (pair[s] & ((1 << 31) - 1))
                a, b = spanning_links(fp[s:e], len(fp[s:e]) if diagonal else own, max_bits)
                left.append(fp[s:e][a])
                right.append(fp[s:e][b])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "side").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS, words: int = WORDS, blocks: int = BLOCKS, keep: tuple[str, ...] = (), smallest_id: bool = True) -> DataFrame:
    """``id_col, keep, fp, component, component_id`` per row: the smallest id that links reach, itself included.

    ``component`` is a fingerprint that names the group, whatever the ids are. Without ``smallest_id`` that is all that is
    said of a group: no ``component_id``, and nothing joined for it.
    """
    marked = checkpointed(fingerprints(docs, text, (id_col, *keep), words))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("_first")))
    members = connected_components(near_links(distinct.select("fp"), max_bits, blocks))
    named = checkpointed(distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", "_first", F.coalesce("component", "fp").alias("_component")))
    if not smallest_id:
        table, n = named.select("fp", F.col("_component").alias("component")), named.count()
        found = marked.join(F.broadcast(table), "fp", "left") if n <= SENT else lookup(marked, "fp", table, marked.count())
        return found.select(id_col, *keep, "fp", "component")
    smallest = named.groupBy("_component").agg(F.min("_first").alias("component_id"))
    table = lookup(named, "_component", smallest, named.count()).select("fp", F.col("_component").alias("component"), "component_id")
    return lookup(marked, "fp", table, marked.count()).select(id_col, *keep, "fp", "component", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES = {}
