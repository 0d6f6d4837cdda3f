"""Best-fit packing by a configuration linear program over the length histogram.

A text becomes byte-level BPE ids and a closing id 0. Texts longer than a sequence are cut into whole sequences, the
shorter rest first. Only the histogram of the remaining lengths (at most one count per length up to the sequence size)
reaches the driver. There the covering program "fewest sequences such that every length is covered" over all ways to
fill a sequence is solved by multiplicative weights: prices of lengths are raised where the plan is behind, and a
knapsack over the prices yields the next fills, and with them a proven lower bound. The fractional plan is rounded down,
the fractions are settled by whole fills at the program's prices, and what is left over is filled largest first with best
fit; all of it as fills with multiplicities and never piece by piece. Spark then deals the pieces: the n-th piece of a
length (dense numbers by hash, so that a very common length is spread) goes to the fill that owns place n.

A booked fill uses up what is due of a length in its round, so the plan has at most (``ROUNDS`` + ``WHOLE_ROUNDS`` + 3) x
sequence size fills, and in practice some ten thousand, whatever the number of pieces: its size is bounded by parameters,
so it is sent to every task.

Defined results: a null text is empty and has the single id 0; a text of any length is encoded whole and cut; pieces of one
length are alike to the plan, and which of them goes where follows from hashes; repeated rows each get their own pieces;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.ranking import salted_index
from pagewright.session import checkpointed, nullable, text_batches

CAPACITY = 2048
ROUNDS = 144
#: Step of the multiplicative weights, and how far below the best a fill may be that is booked.
RATE, SLACK = 0.02, 0.01
#: Rounds that book whole fills, and the share of what rounding left that they go for.
WHOLE_ROUNDS, WHOLE_SHARE = 40, 0.96
END_ID = 0
SPECIAL = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=1)
def rank_encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def general_encoder(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of the ``.json`` vocabulary without added special tokens, then id 0.

    Both files hold the same merges, and the rank encoder is several times as fast; a text that spells a special token
    goes to the general one, which knows it.
    """
    text = text or ""
    if SPECIAL in text:
        ids = general_encoder(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = rank_encoder(vocabulary).encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the shorter one first, then whole sequences."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` + ``piece, start, length, ids_crc32`` per piece of every document."""
    text_batches(docs.sparkSession)
    read = docs.select(*keep, F.col(text).alias("_text"))
    added = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    schema = nullable(read.drop("_text").withColumns({n: F.lit(0).cast(t) for n, t in added}).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            row, number, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(at)):
                ids = encode(value.as_py(), vocabulary)
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            kept = batch.drop_columns(["_text"]).take(pa.array(row, pa.int64())) if batch.num_columns > 1 else None
            columns = [*(kept.columns if kept is not None else []), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return read.mapInArrow(run, schema)


Fill = tuple[tuple[int, int], ...]  # (length, how often), lengths ascending


class Pricing:
    """The knapsack at given prices: the most a sequence can be worth, and fills that come close to it.

    ``best[s]`` is the worth of the best fill of ``s`` places, by dynamic programming over the space used.
    """

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int, slack: float, rng: np.random.Generator, top: float = 0.0):
        self.prices, self.lengths, self.capacity = prices, lengths, capacity
        self.upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        self.best = best = np.zeros(capacity + 1)
        least = int(lengths[0])
        if 3 * len(lengths) < capacity:
            for space in range(least, capacity + 1):
                n = self.upto[space]
                best[space] = max(best[space - 1], (best[space - lengths[:n]] + prices[:n]).max())
        else:  # most lengths occur: slices instead of index lists
            dense, back = np.zeros(capacity + 1), np.zeros(capacity + 1)
            dense[lengths] = prices
            for space in range(least, capacity + 1):
                best[space] = max(best[space - 1], (dense[least : space + 1] + back[capacity - space + least :]).max())
                back[capacity - space] = best[space]
        self.top = max(top, best[capacity])
        self.slack = slack * self.top
        self.taste = 0.3 * self.slack * rng.random(len(lengths))  # fills of like worth should differ

    def fill(self, first: int, room: np.ndarray, forced: bool = False) -> dict[int, int] | None:
        """A fill with the length at place ``first``, within ``room`` pieces of every length, that is worth the most up
        to the slack; None if there is none (if forced, the best there is). Keys are places in ``lengths``."""
        lengths, prices, best = self.lengths, self.prices, self.best
        space = self.capacity - lengths[first]
        lost = self.top - prices[first] - best[space]
        if forced:
            lost = 0.0
        if lost > self.slack:
            return None
        taken = {first: 1}
        full = {first} if room[first] <= 1 else set()
        while n := self.upto[space]:
            short = best[space] - best[space - lengths[:n]] - prices[:n]
            good = (short <= self.slack - lost) & (room[:n] > 0)
            for j in full:
                if j < n:
                    good[j] = False
            j = int(np.where(good, self.taste[:n] - short, -np.inf).argmax())
            if not good[j]:
                return taken if best[space] <= self.slack - lost else None
            taken[j] = taken.get(j, 0) + 1
            if taken[j] + 1 > room[j]:
                full.add(j)
            lost += short[j]
            space -= lengths[j]
        return taken


@dataclass
class Program:
    """A fractional plan that covers every length, and what proves how good it is."""

    fills: dict[Fill, float]
    #: Price per length; no fill is worth more than ``1`` at prices / worth of the best fill, hence the bound.
    prices: dict[int, float]
    bound: float

    @property
    def value(self) -> float:
        return sum(self.fills.values())


def solve_program(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Program:
    """Fewest sequences, fractions allowed, that cover ``counts``: multiplicative weights with knapsack pricing.

    Every round prices the lengths, and books fills worth the most (up to ``SLACK``) for what is behind an even schedule;
    lengths still behind get dearer by a factor. Prices start at one per id, at which every full sequence is worth the
    same. The first third of the rounds only finds prices. The prices of every round bound the program from below: what
    all pieces are worth over what a sequence can be worth.
    """
    rng = np.random.default_rng(1)
    lengths = np.array(sorted(counts))
    need = np.array([counts[n] for n in lengths], float)
    log_price, bound = np.log(lengths / capacity), 0.0
    learning = rounds // 3
    for turn in range(rounds):
        if turn in (0, learning):
            covered, booked = np.zeros(len(lengths)), {}
        pricing = Pricing(np.exp(log_price), lengths, capacity, SLACK, rng)
        bound = max(bound, float(pricing.prices @ need / pricing.top))
        due = (turn + 1) / learning if turn < learning else (turn - learning + 1) / (rounds - learning)
        step = 1 / (learning if turn < learning else rounds - learning)
        behind = np.maximum(0.0, due - covered) * need
        room = behind.copy()
        free = np.where(room > 0.05 * step * need, np.inf, 0.0)
        for i in np.lexsort((rng.random(len(lengths)), -behind / need)).tolist():
            if not free[i] or (fill := pricing.fill(i, free)) is None:
                continue
            times = min(room[j] / a for j, a in fill.items())
            for j, a in fill.items():
                room[j] -= a * times
                if room[j] <= 0.05 * step * need[j]:
                    free[j] = 0.0
            name = tuple(sorted((int(lengths[j]), a) for j, a in fill.items()))
            booked[name] = booked.get(name, 0.0) + times
        covered += (behind - room) / need
        log_price = log_price + RATE * (1 - 0.8 * turn / rounds) * np.clip((due - covered) / step, 0, 1)
        log_price -= log_price.mean()
    # what is not covered yet gets the best fills, whatever else they cover
    pricing = Pricing(np.exp(log_price), lengths, capacity, SLACK, rng)
    every = np.full(len(lengths), np.inf)
    for i in np.argsort(covered).tolist():
        if covered[i] < 1:
            fill = pricing.fill(i, every, forced=True)
            times = (1 - covered[i]) * need[i] / fill[i]
            for j, a in fill.items():
                covered[j] += a * times / need[j]
            name = tuple(sorted((int(lengths[j]), a) for j, a in fill.items()))
            booked[name] = booked.get(name, 0.0) + times
    return Program(booked, dict(zip(lengths.tolist(), np.exp(log_price).tolist())), bound)


def rounded(program: Program, counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole sequences of the program, and the pieces that are left.

    First the whole part of every fill. Then the fractions, which are all there is where pieces are few: the program goes
    on at its prices with whole fills, of what is due in an even schedule, so that a mixture of lengths is left over.
    """
    rng = np.random.default_rng(2)
    left = dict(counts)
    fills: dict[Fill, int] = {}
    for fill, times in sorted(program.fills.items(), key=lambda f: (-f[1], f[0])):
        times = min([int(times), *(left[n] // a for n, a in fill)])
        if times > 0:
            fills[fill] = times
            for n, a in fill:
                left[n] -= a * times
    every = np.array(sorted(left))
    start = np.array([left[n] for n in every], np.int64)
    log_price = np.log([program.prices[n] for n in every.tolist()])
    phase, rest = rng.random(len(every)), start.copy()
    for turn in range(WHOLE_ROUNDS):
        at = np.flatnonzero(rest > 0)
        if not len(at):
            break
        lengths = every[at]
        top = Pricing(np.exp(log_price), every, capacity, SLACK, rng).top  # used up lengths still tell what a sequence is worth
        pricing = Pricing(np.exp(log_price[at]), lengths, capacity, SLACK, rng, top)
        due = np.floor(WHOLE_SHARE * start * min(1.0, 1.25 * (turn + 1) / WHOLE_ROUNDS) + phase).astype(np.int64)
        room = np.clip(due - start + rest, 0, rest)[at]
        before = room.copy()
        for i in reversed(range(len(lengths))):
            while room[i] > 0 and (fill := pricing.fill(i, room)) is not None:
                times = min(int(room[j]) // a for j, a in fill.items())
                for j, a in fill.items():
                    room[j] -= a * times
                name = tuple(sorted((int(lengths[j]), a) for j, a in fill.items()))
                fills[name] = fills.get(name, 0) + times
        rest[at] -= before - room
        log_price[at] += RATE * (room > 0)
    return [(dict(f), t) for f, t in fills.items()], {n: int(c) for n, c in zip(every.tolist(), rest) if c}


def best_fit_fills(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills with multiplicities that use up ``counts``: largest first, then the largest that still fits."""
    left = {n: c for n, c in counts.items() if c > 0}
    fills = []
    while left:
        space, fill = capacity, {}
        for length in sorted(left, reverse=True):
            while length <= space and fill.get(length, 0) < left[length]:
                fits = min(space // length, left[length] - fill.get(length, 0))
                fill[length] = fill.get(length, 0) + fits
                space -= fits * length
        times = min(left[n] // a for n, a in fill.items())
        for n, a in fill.items():
            left[n] -= times * a
            if not left[n]:
                del left[n]
        fills.append((fill, times))
    return fills


def sequences(fills: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in fills)


def plan_fills(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Fills with multiplicities that cover ``counts`` exactly, few sequences in all.

    The rounded program, and best fit for the rest. Where that is over the program's bound, the least full sequences of it
    are opened again for best fit, a tenth after the other; the plan with the fewest sequences is taken, and of such plans
    the one with most of the program in it. Best fit alone is the last one tried.
    """
    whole = counts.get(capacity, 0)
    small = {n: c for n, c in counts.items() if c > 0 and n < capacity}
    fills = [({capacity: 1}, whole)] if whole else []
    if not small:
        return fills
    alone = best_fit_fills(small, capacity)
    easy = sequences(alone) * capacity <= 1.002 * sum(n * c for n, c in small.items())  # a price of one per id is right already
    program = solve_program(small, capacity, rounds // 3 if easy else rounds)
    chosen, left = rounded(program, small, capacity)
    chosen.sort(key=lambda f: -sum(n * a for n, a in f[0].items()))  # fullest first
    plan = chosen + best_fit_fills(left, capacity)
    for share in (0.9, 0.8, 0.7, 0.6, 0.5):
        if sequences(plan) <= np.ceil(program.bound - 1e-6):
            break  # proven to be the fewest
        kept, opened, total = [], dict(small), share * sequences(chosen)
        for f, t in chosen:
            t = min(t, int(total))
            total -= t
            if t:
                kept.append((f, t))
                for n, a in f.items():
                    opened[n] -= a * t
        plan = min(plan, kept + best_fit_fills(opened, capacity), key=sequences)
    plan = min(plan, alone, key=sequences)
    return fills + plan


def plan_table(fills: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Rows (length, first place, pieces per fill, first sequence, offset in the fill), by length and place."""
    owned: dict[int, int] = {}
    rows, sequence = [], 0
    for fill, times in fills:
        offset = 0
        for length, a in sorted(fill.items(), reverse=True):
            rows.append((length, owned.get(length, 0), a, sequence, offset))
            owned[length] = owned.get(length, 0) + a * times
            offset += a * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "place", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(made: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (column ``length``), which should be materialised."""
    spark = made.sparkSession
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = plan_table(plan_fills(histogram, capacity, rounds))
    order = [F.col(c) for c in made.columns if c != "length"]
    indexed = salted_index(made, "length", order, "_place")
    schema = nullable(indexed.drop("_place").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)
    shared = spark.sparkContext.broadcast(plan)
    wide = 1 << 40  # places of one length

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        starts = p["length"] * wide + p["place"]
        for batch in batches:
            length, at = batch["length"].to_numpy(), batch["_place"].to_numpy()
            row = np.searchsorted(starts, length * wide + at, side="right") - 1
            copy, slot = np.divmod(at - p["place"][row], p["each"][row])
            yield batch.drop(columns="_place").assign(sequence_id=p["sequence"][row] + copy, offset=p["offset"][row] + slot * length)

    return indexed.mapInPandas(assign, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(checkpointed(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES = {}
