"""Language identification with a string kernel.

The kernel of two texts is the share of character n-grams (n = 1, 2, 3) that both hold, presence only, over the n-grams
of the landmark texts: a blended-spectrum presence kernel, scaled to 1 for a text with itself. Landmarks are a few texts
per language (Nyström); one ridge regression per language on the kernel values against the landmarks gives its weights.
Scoring is two matrix products per batch: presence rows times landmark n-grams, times weights.

Every labelled language is learned. Learning reads ``SAMPLE`` labelled texts, shared evenly by the languages, but two a
language at least; ``LANDMARKS`` of them, again two a language at least, are landmarks. Of the landmarks' n-grams
``GRAMS`` are used: those that most landmarks of each language hold, in even shares, then those that most landmarks hold
at all. The model grows by two landmarks and a column a language. Texts are taken by hash, whole. Prediction reads every
text whole, and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything if nothing could be
learned; a very long text is one set of n-grams like any other; ties go to the language first in code-point order; repeated rows each get their own row; a null id is never
learned from and not held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.batches import with_text
from pagewright.session import checkpointed, nullable, text_batches

UND = "und"
SAMPLE, LANDMARKS, GRAMS = 960, 160, 1 << 17
RIDGE = 1e-2
SLOT_BITS = 21
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of the lower-cased text, repeats included: 21 bits per character."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-1] | (c[2:] << np.uint64(42)) if len(c) > 2 else c[:0]
    return np.concatenate((c, two, three))


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * MIX) >> np.uint64(64 - SLOT_BITS)


@dataclass
class Model:
    languages: list[str]
    #: n-gram codes by slot, the first of every slot (or -1), and whether another one of the slot follows.
    codes: np.ndarray
    first: np.ndarray
    more: np.ndarray
    #: n-grams x landmarks (presence, each landmark scaled), landmarks x languages.
    landmarks: np.ndarray | None = None
    weights: np.ndarray | None = None

    def presence(self, text: str) -> np.ndarray:
        """Numbers of the known n-grams that the text holds; repeats may occur."""
        return self.numbers(grams(text))

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = self.first[_slots(codes)]
        at, codes = at[at >= 0], codes[at >= 0]
        found = []
        while len(at):  # n-grams that share a slot lie side by side
            hit = self.codes[at] == codes
            found.append(at[hit])
            onward = ~hit & self.more[at]
            at, codes = at[onward] + 1, codes[onward]
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts against the landmarks, one row per text."""
        rows = np.zeros((len(texts), len(self.codes)), np.float32)
        for i, text in enumerate(texts):
            rows[i, self.presence(text)] = 1
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.landmarks) / size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margins = self.kernel(texts) @ self.weights  # about 1 for the language, -1 for the others
        best = margins.argmax(axis=1)
        top = margins[np.arange(len(texts)), best]
        return [self.languages[b] for b in best], np.clip((top.astype(float) + 1) / 2, 0, 1)


def known_grams(marks_of: dict[str, list[np.ndarray]]) -> Model:
    """A model without weights: the n-grams of the landmarks that are used, at most ``GRAMS``."""
    languages = sorted(marks_of)
    codes, held = np.unique(np.concatenate([s for name in languages for s in marks_of[name]]), return_counts=True)
    if len(codes) > GRAMS:
        shares = []  # every language keeps some of its own n-grams, however many languages there are
        for name in languages:
            mine, times = np.unique(np.concatenate(marks_of[name]), return_counts=True)
            shares.append(mine[np.lexsort((mine, -held[np.searchsorted(codes, mine)], -times))[: max(1, GRAMS // (2 * len(languages)))]])
        shares = np.unique(np.concatenate(shares))
        others = ~np.isin(codes, shares)
        rest = codes[others][np.lexsort((codes[others], -held[others]))[: max(0, GRAMS - len(shares))]]
        codes = np.union1d(shares, rest)
    slots = _slots(codes)
    order = np.argsort(slots, kind="stable")
    codes, slots = codes[order], slots[order]
    start = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1]))) if len(codes) else np.empty(0, np.int64)
    first = np.full(1 << SLOT_BITS, -1, np.int32)
    first[slots[start]] = start
    return Model(languages, codes, first, np.concatenate((slots[1:] == slots[:-1], [False])))


def fit_numbers(model: Model, samples: list[tuple[str, np.ndarray]], marks: list[np.ndarray]) -> Model:
    """Fit the weights on (language, numbers of distinct known n-grams) pairs; ``marks`` are those of the landmarks."""
    counts = Counter(language for language, _ in samples)
    table = np.zeros((len(model.codes), len(marks)), np.float32)
    for j, at in enumerate(marks):
        table[at, j] = 1 / np.sqrt(max(1, len(at)))
    k = np.array([table[at].sum(axis=0) / np.sqrt(max(1, len(at))) for _, at in samples], float)
    y = np.array([[1.0 if language == name else -1.0 for name in model.languages] for language, _ in samples])
    share = np.array([1 / counts[language] for language, _ in samples])  # languages weigh the same
    between = table.T.astype(float) @ table
    left = k.T @ (k * share[:, None]) + RIDGE * between + 1e-6 * np.eye(len(marks))
    weights = np.linalg.solve(left, k.T @ (y * share[:, None]))
    return replace(model, landmarks=table, weights=weights.astype(np.float32))


def fit(labelled: DataFrame, text: str, label: str, key: Column) -> Model | None:
    """Fit on a bounded sample by hash of ``key``: the landmarks' n-grams reach the driver, and of every sampled text the
    numbers of those it holds, at most ``GRAMS``."""
    counts = labelled.groupBy(label).count().collect()
    if not counts:
        return None
    # draw more than are used of each language, so that none comes out short, then cut in order of the hash
    most, marks = max(2, SAMPLE // len(counts)), max(2, LANDMARKS // len(counts))
    shares = labelled.sparkSession.createDataFrame([(r[label], min(1.0, max(1.5 * most, most + 30) / r["count"])) for r in counts], "language string, share double")
    drawn = F.pmod(F.col("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    read = labelled.select(F.col(label).cast("string").alias("language"), F.col(text).alias("text"), key.alias("key"))
    some = read.join(F.broadcast(shares), "language").where((drawn < F.col("share")) & (F.col("text") != ""))
    place = F.row_number().over(Window.partitionBy("language").orderBy("key", "text"))
    taken = checkpointed(some.select("language", "text", "key").withColumn("place", place).where(F.col("place") <= most))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(t.as_py())).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["language", "codes"])

    marks_of: dict[str, list[np.ndarray]] = {}
    for r in taken.where(F.col("place") <= marks).mapInArrow(sets, "language string, codes array<long>").collect():
        marks_of.setdefault(r["language"], []).append(np.array(r["codes"], np.int64).astype(np.uint64))
    if not marks_of:
        return None
    model = known_grams(marks_of)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shared.value.presence(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.list_(pa.int32()))], names=["language", "place", "numbers"])

    rows = taken.mapInArrow(known, "language string, place int, numbers array<int>").collect()
    rows.sort(key=lambda r: (r["language"], r["place"]))
    samples = [(r["language"], np.array(r["numbers"], np.int64)) for r in rows]
    return fit_numbers(model, samples, [at for r, (_, at) in zip(rows, samples) if r["place"] <= marks])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + ``lang_pred, score`` per row."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # size fixed by the sample
    read, at = with_text(docs, text, keep)
    schema = nullable(read.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            names, scores = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if fitted and t and LETTER.search(t)]
            for s in range(0, len(known), 64):
                part = known[s : s + 64]
                found, score = fitted.predict([texts[i] for i in part])
                for i, name in zip(part, found):
                    names[i] = name
                scores[part] = score
            columns = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.array(scores)], names=schema.names)

    return read.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id") -> Model | None:
    usable = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return fit(usable, text, label, F.xxhash64(F.col(id_col), F.lit(5)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES = {}
