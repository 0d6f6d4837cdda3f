"""Mixing sources to target weights (DataFrame functions only).

The words of every source form a stream, documents in a pseudorandom but repeatable order, cut into blocks of a fixed
length. Output is laid out in shards of a fixed number of block slots. Every slot draws a source ticket, which makes the
source counts of each shard multinomial; then the small difference between what a source drew and its quota is settled
by handing surplus draws to the sources that came short, so that totals hold exactly. The n-th slot of a source takes
the block at place n of that source's pseudorandom index permutation, one permutation per pass over the source, and
blocks are joined by index. The last slot of a source is cut so that its words meet the target.

Defined results: a null text has size 0 and takes nothing; a very long text is many blocks, each used on its own; a null
source is a source of its own, last in order; documents equal in ``keep`` and size are alike and may swap places in the
stream; repeated rows are separate documents; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.rows import named, row_key
from pagewright.operators.ranking import range_index, salted_index
from pagewright.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Words per block, and block slots per output shard.
BLOCK, SHARD = 128, 4096
WEIGHTS = (5, 2, 1)
#: A source's target stops at this many times its size.
REPEAT = 3
#: Rounds of a permutation.
ROUNDS = 24


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """``(source, s, source_size, target)`` per source; ``s`` numbers sources by code point, null last.

    Shares are a water level: a source gets ``weight * level`` unless that is over ``repeat`` times its size. Sources
    over it are capped and the rest shared again until none is above. Only two sums per round reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = range_index(totals, [F.col("source").asc_nulls_last()], "s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    sources = checkpointed(numbered.withColumn("weight", weight).withColumn("most", repeat * F.col("source_size").cast("double")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.col("weight") * level < F.col("most")
        held = sources.agg(F.sum(F.when(~free, F.col("most"))).alias("capped"), F.sum(F.when(free, F.col("weight"))).alias("weight")).first()
        following = (total - (held["capped"] or 0.0)) / held["weight"] if held["weight"] else level
        if following <= level:
            break
        level = following
    return sources.select("source", "s", "source_size", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def permuted(at: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """The ``at``-th place of a pseudorandom permutation of 0..n-1 that depends on ``key`` as a whole (or, with ``back``,
    where a place comes from).

    Swap or not (Hoang, Morris, Rogaway 2012), which is a permutation for every ``n``: a round pairs each place with its
    mirror image at a round key, and a hash of the pair decides whether the two change places.
    """
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, n, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, mirror)) > 0, mirror).otherwise(x)

    return F.aggregate(F.reverse(rounds) if back else rounds, at.cast("long"), swap)


def _owners(intervals: DataFrame, points: DataFrame, total: int, rows: int) -> DataFrame:
    """Join ``points.ticket`` to the interval ``[lo, hi)`` that holds it, by equal cells of the ticket line."""
    cell = max(1, -(-total // max(4096, rows)))
    cells = intervals.where("hi > lo").withColumn("cell", F.explode(F.sequence((F.col("lo") / cell).cast("long"), ((F.col("hi") - 1) / cell).cast("long"))))
    return points.withColumn("cell", (F.col("ticket") / cell).cast("long")).join(cells, "cell").where("ticket >= lo and ticket < hi").drop("cell", "lo", "hi")


def shard_counts(quotas: DataFrame, seed: int, shard: int) -> DataFrame:
    """``(s, shard, n)``: slots of every source in every output shard; sums over shards are the quotas exactly."""
    spark = quotas.sparkSession
    line = checkpointed(_cumulative(quotas.select("s", "quota"), "s", "quota"))
    head = line.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = int(head["total"] or 0), int(head["rows"])
    slots = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("ticket"))
    drawn = checkpointed(_owners(line, slots, total, rows).groupBy("s", "shard").agg(F.count(F.lit(1)).alias("n")))
    # settle: draws over a source's quota, counted over shards in order, go to sources that came short
    within = (
        _cumulative(drawn, "shard", "n", "s")
        .join(quotas.select("s", "quota"), "s")
        .withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("lo"))))
    )
    within = checkpointed(within.select("s", "shard", "keep", (F.col("n") - F.col("keep")).alias("over")))
    kept = within.groupBy("s").agg(F.sum("keep").alias("has"))
    short = quotas.join(kept, "s", "left").select("s", (F.col("quota") - F.coalesce("has", F.lit(0))).alias("gap")).where("gap > 0")
    lack = checkpointed(_cumulative(short, "s", "gap"))
    head = lack.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = int(head["total"] or 0), int(head["rows"])
    surplus = _cumulative(within.where("over > 0").groupBy("shard").agg(F.sum("over").alias("over")), "shard", "over")
    tickets = surplus.select("shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("ticket"))
    moved = _owners(lack, tickets, total, rows).groupBy("s", "shard").agg(F.count(F.lit(1)).alias("keep"))
    return within.select("s", "shard", "keep").union(moved.select("s", "shard", "keep")).groupBy("s", "shard").agg(F.sum("keep").alias("n")).where("n > 0")


def _cumulative(df: DataFrame, key: str, amount: str, group: str | None = None) -> DataFrame:
    """Intervals ``[lo, hi)`` of the running sum of ``amount`` in order of ``key`` (a long), of each ``group`` on its own.

    Spans of 1024 keys are summed first, so no task holds more than one row per span of a group.
    """
    of = [group] if group else []
    dealt = df.withColumn("_range", F.floor(F.col(key) / 1024))
    before = Window.partitionBy(*of).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*of, "_range").agg(F.sum(amount).alias("_n")).select(*of, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*of, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_upto", F.sum(amount).over(within))
        .join(offsets, [*of, "_range"])
        .select(*df.columns, (F.col("_offset") + F.col("_upto") - F.col(amount)).alias("lo"), (F.col("_offset") + F.col("_upto")).alias("hi"))
    )


def mix_pieces(docs: DataFrame, keep: list[str], order: list[Column], block: int = BLOCK, shard: int = SHARD, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """Every document's pieces, one per block it lies in, with the number of times the mix uses them.

    ``docs`` holds ``keep``, ``source`` and ``size``. Returns ``keep`` + ``source, size, s, at`` (the document),
    ``source_size, target, first, words`` (a run of the document's words; null words for an empty document), ``times``,
    and ``cut`` (words at the end of the run that the last use leaves out).
    """
    sized = checkpointed(docs.select(*keep, "source", "size"))
    sources = checkpointed(source_targets(sized, weights, repeat))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(repeat)).cast("long")
    rest = F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    quotas = checkpointed(
        sources.where("source_size > 0")
        .withColumn("blocks", blocks)
        .withColumn("passes", passes)
        .withColumn("rest", F.when(F.col("passes") >= repeat, 0).otherwise(rest))
        .withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        # the short block comes last in every pass, so only the last slot can overshoot
        .withColumn("over", F.least(F.ceil(F.col("rest") / block).cast("long") * block, F.col("source_size")) - F.col("rest"))
        .withColumn("full", F.floor(F.col("source_size") / block).cast("long"))
        .select("s", "blocks", "full", "quota", "over")
    )
    counts = _cumulative(shard_counts(quotas, seed, shard), "shard", "n", "s")
    # every shard's slots are made in a task of their own choosing, at most ``shard`` from a row
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = permuted(F.col("place"), F.greatest("full", F.lit(1)), F.lit(seed), F.col("s"), F.col("turn"))
    slots = (
        counts.repartition(parts, "s", "shard")
        .withColumn("slot", F.explode(F.sequence("lo", F.col("hi") - 1)))
        .join(quotas, "s")
        .withColumn("turn", F.floor(F.col("slot") / F.col("blocks")))
        .withColumn("place", F.col("slot") % F.col("blocks"))
        .withColumn("block", F.when(F.col("place") < F.col("full"), shuffled).otherwise(F.col("place")))
    )
    uses = slots.groupBy("s", "block").agg(
        F.count(F.lit(1)).alias("times"),
        F.max(F.when(F.col("slot") == F.col("quota") - 1, F.col("over")).otherwise(0)).alias("block_cut"),
    )
    marked = sized.join(sources.select(F.col("source").alias("_source"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    indexed = salted_index(marked, "s", order, "at")
    # where a document's words start in its source's stream
    placed = _cumulative(indexed, "at", "size", "s").withColumnRenamed("lo", "start").drop("hi")
    lies_in = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = placed.withColumn("block", F.explode_outer(lies_in))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    block_end = F.least((F.col("block") + 1) * block, F.col("source_size"))
    return (
        pieces.join(uses, ["s", "block"], "left")
        .withColumn("first", lo - F.col("start"))
        .withColumn("words", hi - lo)
        .withColumn("times", F.coalesce("times", F.lit(0)))
        .withColumn("cut", F.greatest(F.lit(0), F.least(hi - lo, hi - (block_end - F.coalesce("block_cut", F.lit(0))))))
        .select(*keep, "source", "size", "s", "at", "source_size", "target", "first", "words", "times", "cut")
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), **params) -> DataFrame:
    """One row per document: ``keep`` + ``size, source_size, target, taken``."""
    sized = docs.select(F.struct(*[named(c) for c in keep]).alias("_keep"), named(source).cast("string").alias("source"), size_of(named(text)).alias("size"))
    pieces = mix_pieces(sized, ["_keep"], [F.col("_keep"), F.col("size")], **params)
    used = F.sum(F.coalesce(F.col("words") * F.col("times") - F.col("cut"), F.lit(0)))
    mixed = pieces.groupBy("s", "at", "_keep", "size", "source_size", "target").agg(used.cast("long").alias("taken"))
    return mixed.select("_keep.*", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", length: str = "n_chars", **params) -> DataFrame:
    """The mixture itself, in the columns of ``docs``: a row per use of a document.

    A use that takes the whole document keeps its text as it is; one that takes some of its blocks has the words of those
    blocks, joined by single spaces. ``length``, if there is such a column, is set anew. Documents that the mix does not
    use, and those without words, have no row. Rows are known by 128 bits of their values; rows alike in every column are
    copies of one document.
    """
    columns = docs.columns
    row = F.struct(*[named(c) for c in columns])
    marked = docs.select(row.alias("_row"), row_key(docs).alias("_key"), named(text).alias("_text"), named(source).cast("string").alias("source"))
    sized = marked.select("_key", "source", size_of(F.col("_text")).alias("size"))
    pieces = mix_pieces(sized, ["_key"], [F.col("_key"), F.col("size")], **params).where("times > 0")
    repeat = params.get("repeat", REPEAT)
    lists = pieces.groupBy("s", "at", "_key", "size").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times", "cut"))).alias("pieces"))

    def taken(use):
        """Runs of one use; the last use of a block leaves its cut out."""
        used = F.filter("pieces", lambda p: p["times"] >= use)
        return F.transform(used, lambda p: F.struct(p["first"].alias("first"), (p["words"] - F.when(p["times"] == use, p["cut"]).otherwise(0)).alias("words")))

    uses = lists.withColumn("use", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).withColumn("runs", taken(F.col("use")))
    uses = uses.withColumn("words", F.aggregate("runs", F.lit(0).cast("long"), lambda sum_, r: sum_ + r["words"])).where("words > 0")
    uses = uses.select("_key", (F.col("words") == F.col("size")).alias("whole"), "runs")
    joined = marked.select("_key", "_row", "_text").dropDuplicates(["_key"]).join(uses, "_key")
    cut = lambda words: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["words"].cast("int")))), " ")
    rebuilt = F.transform(F.array(F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0))), cut)[0]
    made = joined.withColumn("_text", F.when(F.col("whole"), F.col("_text")).otherwise(rebuilt))
    new = {text: F.col("_text"), length: F.length("_text").cast("long")}
    return made.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in columns])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture by source: what it takes of each, beside the target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, keep=("doc_id", "source"))
    return mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.first("source_size").alias("source_size"), F.round(F.first("target"), 3).alias("target"), F.sum("taken").alias("taken")
    )


QUERIES = {"op4_source_mixing": op4_source_mixing, "mixing_totals": mixing_totals}
#: The level of the targets in one pass: sources capped first are those with the least size per weight.
ORACLES = {
    "mixing_totals": rf"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
t AS (SELECT source, count(*) AS documents, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(s % 3 + 1)::INT]::DOUBLE AS weight, {REPEAT} * source_size::DOUBLE AS most FROM t),
c AS (SELECT *, coalesce(sum(most) OVER before, 0) AS capped, sum(weight) OVER (ORDER BY most / weight DESC, s DESC) AS free
      FROM w WINDOW before AS (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, ((SELECT sum(source_size) FROM t) - capped) / free AS level FROM c),
l AS (SELECT level FROM v WHERE level <= most / weight + 1e-9 ORDER BY most / weight, s LIMIT 1)
SELECT source, documents, source_size, round(least(weight * level, most), 3) AS target, floor(least(weight * level, most) + 0.5)::BIGINT AS taken FROM w, l
"""
}
