"""Secret scans: keyword automaton, anchored expressions, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds where a keyword stands; the expression of its kind is then tried
only at that place, anchored, on the original text. Places are taken from left to right and a match uses up its text, so
the result is that of a leftmost non-overlapping search. Runs of hexadecimal digits have no keyword; one linear
expression finds them. Token formats that carry a checksum are kept only if the checksum holds.

Kinds ``assign``, ``access`` and ``hex`` are the base kinds; ``github`` and ``npm`` tokens (prefix, 30 base-62 digits,
six base-62 digits of the CRC-32 of those) are added by checksum.

Defined results: a null text has no spans; repeated rows each get their own row; extra columns are ignored; an empty
table gives no rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.batches import with_text
from pagewright.session import nullable, text_batches

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

# Expressions and least lengths of the contract; letters of keywords in either case, A-Z only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
# Prefixes of tokens that end in a checksum.
GITHUB = re.compile(r"(?:ghp|gho|ghu|ghs|ghr)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(value: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def checksum_holds(match: re.Match) -> bool:
    return base62(zlib.crc32(match[1].encode())) == match[2]


#: Per kind: the anchored expression, and the test that a match has to pass to be kept.
TESTS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (GITHUB, checksum_holds),
    "npm": (NPM, checksum_holds),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case of the same length; only U+0130 grows when lower-cased, and no keyword holds it."""
    return text.lower() if text.isascii() else text.replace("İ", "ı").lower()


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every secret, by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    low = lowered(text)
    if len(low) != len(text):  # no other character is known to grow; offsets must hold in any case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in automaton().iter(low):
        starts.setdefault(kind, []).append(end - length + 1)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, places in starts.items():
        expression, keeps = TESTS[kind]
        free = 0
        for at in sorted(places):
            if at >= free and (match := expression.match(text, at)):
                free = match.end()
                if keeps(match):
                    spans.append((at, free, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with every span, overlapping ones together, replaced by a mark of its first kind."""
    if not spans:
        return text
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<start: int, end: int, kind: string>>"


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """``keep`` + ``spans`` per row; with ``redact``, ``safe_text`` too."""
    text_batches(docs.sparkSession)
    read, at = with_text(docs, text, keep)
    schema = read.select(*keep).withColumn("spans", F.lit(None).cast(SPANS))
    schema = nullable((schema.withColumn("safe_text", F.lit("")) if redact else schema).schema)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, safe = [], []
            for value in batch.column(at):
                value = value.as_py()
                found = find_spans(value)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                if redact:
                    safe.append(redacted(value, found))
            columns = [*batch.columns[: len(keep)], pa.array(spans, kind)]
            if redact:
                columns.append(pa.array(safe, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return read.mapInArrow(run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES = {}
