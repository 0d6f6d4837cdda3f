"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into principal axes, so that leading dimensions hold most of every product. Vectors are dealt to
cells by their leading coordinates: a cosine of ``t`` or more means a distance of at most sqrt(2 - 2t), so only equal and
neighbouring cells can hold linked pairs, and there are at most a few hundred cells whatever the number of rows. Cells
are cut into tiles of bounded size and every pair of tiles is compared in a task of its own: products of the leading
dimensions first, plus the product of the two suffix norms, which bounds the rest (Cauchy-Schwarz); pairs that cannot
reach the threshold are dropped, and the others go on to the next dimensions. Survivors are verified in double precision
on the original vectors. A task returns how many vectors each row links to and a spanning set of links, never all pairs.
Equal vectors are one row with a multiplicity.

The axes come from a sample of at most ``PCA_ROWS`` rows; they change how soon pairs are dropped, never which are found.

Without dominant axes cells prune little, and the work grows with the square of the rows: from some 10^7 vectors on, more
axes (``AXES``) or a higher threshold are needed.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and is its
own component; vectors of different dimension never link; repeated rows are vectors of their own and link to each other;
a null id never names a component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.forest import hook, run_bounds, sorted_runs
from pagewright.llm.vectors import matrix, packed
from pagewright.operators.components import connected_components
from pagewright.operators.skew import lookup
from pagewright.session import checkpointed, nullable

THRESHOLD = 0.9
PCA_ROWS = 32_768
#: Leading coordinates that cells are made of, and vectors of a tile.
AXES, TILE = 3, 16_384
#: The bound is tested after so many dimensions each; rows of a stripe, and pairs of a stripe, at most.
STEP, STRIPE, CELLS = 16, 128, 1_000_000
#: Below this share of pairs that may still link, pairs go on one by one.
SPARSE = 0.02


def principal_axes(rows: DataFrame, kind: str, n: int) -> dict[int, np.ndarray]:
    """An orthonormal basis per dimension, leading axis first, from a bounded sample by hash."""
    every = max(1, -(-n // PCA_ROWS))
    taken = rows.where(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0).select("dim", "vec").limit(2 * PCA_ROWS).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in taken:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    axes = {}
    for dim, vectors in by_dim.items():
        x = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, basis = np.linalg.eigh(x.T @ x)
        axes[dim] = np.ascontiguousarray(basis[:, ::-1])
    return axes


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    x = x.astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


def linked_pairs(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float, work: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold, in stripes of ``x``; ``tx`` and ``ty`` are the turned unit vectors.

    Products grow block by block of dimensions, and after every block the suffix norms bound what is missing. A stripe
    first drops rows of ``y`` that no row of the stripe can reach, and rows of its own that reach none: the rest of the
    stripe is a smaller matrix product. Once few pairs are left, they go on one by one. ``work`` gathers multiply-adds.
    """
    dim = x.shape[1]
    ends = [*range(STEP, dim, STEP), dim]
    fx, fy = tx.astype(np.float32), ty.astype(np.float32)
    rest = lambda t: {s: np.sqrt(np.maximum((t[:, s:] ** 2).sum(axis=1), 0)).astype(np.float32) for s in ends}
    rx, ry = rest(tx), rest(ty)
    least = np.float32(threshold - 1e-4)  # room for single precision
    stripe = max(1, min(STRIPE, CELLS // max(1, len(y))))
    for at in range(0, len(x), stripe):
        rows, columns = np.arange(at, min(at + stripe, len(x))), np.arange(len(y))
        so_far, a, b = np.float32(0), None, None
        lo = 0
        for hi in ends:
            if a is None:
                # the suffix norms are one more dimension of the block's product
                reach = np.column_stack((fx[rows, lo:hi], rx[hi][rows])) @ np.column_stack((fy[columns, lo:hi], ry[hi][columns])).T
                reach += so_far
                may = reach >= least
                if work is not None:
                    work.append(may.size * (hi - lo))
                up, down = may.any(axis=1), may.any(axis=0)
                if not up.any():
                    rows = rows[:0]
                    break
                if hi == dim or may.sum() < SPARSE * may.size:
                    i, j = np.nonzero(may)
                    a, b = rows[i], columns[j]
                    so_far = reach[i, j] - rx[hi][a] * ry[hi][b]
                else:
                    rows, columns = rows[up], columns[down]
                    so_far = reach[np.ix_(up, down)] - rx[hi][rows, None] * ry[hi][columns]
            else:
                so_far = so_far + np.einsum("ij,ij->i", fx[a, lo:hi], fy[b, lo:hi])
                if work is not None:
                    work.append(len(a) * (hi - lo))
                may = so_far + rx[hi][a] * ry[hi][b] >= least
                a, b, so_far = a[may], b[may], so_far[may]
            lo = hi
        if not len(rows) or a is None:
            continue
        for part in range(0, len(a), 32_768):  # the measure itself, on the original vectors
            pa_, pb = a[part : part + 32_768], b[part : part + 32_768]
            dots = np.einsum("ij,ij->i", x[pa_], y[pb])
            norms = np.sqrt(np.einsum("ij,ij->i", x[pa_], x[pa_])) * np.sqrt(np.einsum("ij,ij->i", y[pb], y[pb]))
            hit = dots / norms >= threshold
            if hit.any():
                yield pa_[hit], pb[hit]


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row."""
    spark: SparkSession = rows.sparkSession
    found, kind = packed(rows, id_col, vector)
    found = checkpointed(found)
    distinct = found.where("vec is not null").groupBy("vec", "dim").agg(F.count(F.lit(1)).alias("times"), F.min(id_col).alias("first"))
    distinct = checkpointed(distinct.withColumn("rid", F.monotonically_increasing_id()))
    n_distinct = distinct.count()
    axes = spark.sparkContext.broadcast(principal_axes(distinct, kind, n_distinct))  # basis per dimension
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    offset, base = 64, 128  # a coordinate of a unit vector has few cells either side of 0
    if not 0 < threshold < 1 or 1 / width > offset - 1:
        raise ValueError("threshold must leave cells of a usable width")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                turned = _turned(matrix(batch.column(0).take(pa.array(at)), kind), axes.value)
                code = np.full(len(at), int(dim), np.int64)
                for k in range(AXES):
                    step = np.floor(turned[:, k] / width).astype(np.int64) if k < dim else 0
                    code = code * base + step + offset
                cell[at] = code
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = nullable(distinct.withColumn("cell", F.lit(0).cast("long")).schema)
    placed = checkpointed(distinct.mapInArrow(place, schema))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # cells are few by construction
    tiles = {c: -(-n // tile) for c, n in counts.items()}
    shifts = [sum(d * base**k for k, d in enumerate(step)) for step in product((-1, 0, 1), repeat=AXES)]
    meets = [(c, tiles[c], c + s, tiles[c + s]) for c in tiles for s in shifts if c + s in tiles]
    partners = F.broadcast(spark.createDataFrame(meets, "cell long, tiles int, with long, with_tiles int"))  # 27 per cell at most
    own = F.col("cell") * (1 << 31) + F.pmod(F.xxhash64("rid"), F.col("tiles"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("with_tiles").cast("long") - 1)
    dealt = placed.join(partners, "cell").select("rid", "vec", "times", own.alias("own"), "with", F.explode(numbers).alias("number"))
    dealt = dealt.withColumn("other", F.col("with") * (1 << 31) + F.col("number"))
    dealt = dealt.select(
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("long").alias("side"), "rid", "times", "vec"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        names = batch.schema.names
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, side, rid, times, vec in sorted_runs(batches, 2, arrays):
            for s, e in zip(*run_bounds(lo, hi)):
                x = np.frombuffer(b"".join(vec[s:e]), kind).reshape(e - s, -1).astype(float)
                turned = _turned(x, axes.value)
                n, ids, weight = e - s, rid[s:e], times[s:e]
                cut = 0 if lo[s] == hi[s] else int((side[s:e] == 0).sum())
                top = cut or n  # a tile with itself, or the first ``cut`` rows with the others
                links, parent = np.zeros(n, np.int64), np.arange(n)
                left, right = [], []
                if cut == n:
                    continue
                for a, b in linked_pairs(x[:top], x[cut:], turned[:top], turned[cut:], threshold):
                    b = b + cut
                    a, b = a[a != b], b[a != b]
                    links += np.bincount(a, weight[b], n).astype(np.int64)
                    if cut:
                        links += np.bincount(b, weight[a], n).astype(np.int64)
                    parent, ka, kb = hook(parent, a, b)
                    left.append(ids[ka])
                    right.append(ids[kb])
                has = np.flatnonzero(links)
                a, b = np.concatenate([ids[:0], *left]), np.concatenate([ids[:0], *right])
                if len(has):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate((ids[has], a))),
                            pa.array(np.concatenate((ids[has], b))),
                            pa.array(np.concatenate((links[has], np.zeros(len(a), np.int64)))),
                        ],
                        names=["a", "b", "n"],
                    )

    compared = checkpointed(dealt.repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi", "side").mapInArrow(compare, "a long, b long, n long"))
    linked = compared.where("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    members = connected_components(compared.where("a <> b"))
    named = (
        distinct.drop("dim")
        .join(linked, distinct["rid"] == linked["a"], "left")
        .join(members, distinct["rid"] == members["node"], "left")
        .select("vec", "first", (F.coalesce("n_links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rid").alias("_component"))
    )
    named = checkpointed(named)
    smallest = named.groupBy("_component").agg(F.min("first").alias("component_id"))
    table = lookup(named, "_component", smallest, n_distinct).select("vec", "n_links", "component_id")
    out = lookup(found, "vec", table, found.count())
    component = F.when(F.col("vec").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(
        id_col,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
#: All pairs by brute force, which DuckDB can do on a small table.
ORACLES = {
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS rid FROM embeddings),
ok AS (SELECT rid, vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT rid AS node, rid AS other FROM v UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other),
comp AS (SELECT node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.other GROUP BY node),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp ON comp.node = v.rid LEFT JOIN links ON links.a = v.rid
"""
}
