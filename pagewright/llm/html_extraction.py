"""Main text of web pages by template deduction from the pages of a host.

Tokens are the elements that structure a page, by the path of elements and names that leads to them, and the whole texts
that stand in them. The pages of a host that hold a token, and how often, are its occurrence vector; tokens with one
vector are an equivalence class. Vectors are never gathered: a token's is summed up by counts and by sums of hashes of
(page, occurrences), which is a partial aggregate, so a host may have any share of the pages. A class belongs to the template if
it is on nearly all of the host's different pages, is nested (a text and the element that holds it are in one class) and
is ordered (each token follows the same token of its class on every page). The texts of such classes are the host's own
words, written anew on every page, and are left out.

What is left are the template's slots: its elements that hold text. A slot whose words are mostly links on the host's pages is a menu, and one
in elements that are boilerplate by their tag, role or name (``html_text``) is no main text either; of the others, those in
the article are main slots, or those in the main part on hosts without articles, or else all. The main text of a page are its blocks in main slots. Text
in elements that the template lacks is judged by its own page in the same way, and so are pages of hosts without a template.

The texts of a template hold at most half of the words on a host's pages: where it would be more, the pages are copies of
an article, and no text of theirs is left out. Headings of an article are never template.

Defined results: null or empty html and pages without an article have an empty text; html of any length is read whole;
pages alike are one page for the template and a row each in the result; a null url belongs to no host, so tags, roles and
names alone decide there, as on hosts with fewer than ``MIN_PAGES`` different pages; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.html_text import ROOT, Page, read, token_of
from pagewright.llm.rows import named
from pagewright.llm.url_filter import host_of
from pagewright.operators.skew import lookup
from pagewright.session import checkpointed, nullable, text_batches

#: Different pages of a host from which a template is deduced, and the share of them that hold a template's token.
MIN_PAGES, SHARE = 4, 0.8
#: Share of a slot's words that stand in links, from which it is a menu.
LINKED = 0.5
#: Template tokens that are sent to every task; a larger table is joined by host.
BROADCAST_TOKENS = 1_000_000

#: Below every part of a page.
DROPPED = -1

_SEEN = "host bigint, page bigint, tokens array<bigint>, parents array<bigint>, counts array<int>, texts array<boolean>, words array<int>, linked array<int>, levels array<int>, total int"


def text_token(path: int, text: str) -> int:
    return token_of.__wrapped__(path, "=" + text)  # texts are seldom met again


def occurrences(page: Page) -> tuple[list, ...]:
    """Tokens of a page in the order of their first places: token, parent, count, is a text, words, linked words, and level:
    the part of the page it is in, or ``DROPPED``."""
    order: dict[int, list] = {ROOT: [ROOT, 1, False, 0, 0, 0]}
    for token, parent in page.elements:
        order.setdefault(token, [parent, 0, False, 0, 0, 0])[1] += 1
    for block in page.blocks:
        slot, level = order[block.path], DROPPED if block.dropped else block.inside
        slot[3] += block.words
        slot[4] += block.linked
        slot[5] = level
        if not (block.inside and block.heading):
            text = order.setdefault(text_token(block.path, block.text), [block.path, 0, True, 0, 0, level])
            text[1] += 1
            text[3] += block.words
    return list(order), *([row[i] for row in order.values()] for i in range(6))


def _with_host(pages: DataFrame, url: str, html: str, *more: Column) -> DataFrame:
    host = host_of(named(url))
    return pages.select(F.when(host != "", F.xxhash64(host)).alias("host"), named(html).alias("html"), *more)


def seen_tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The tokens of every different page of a host: one row a page, a few bytes a token."""
    read_ = _with_host(pages, url, html).where(F.col("host").isNotNull() & (F.col("html") != "")).withColumn("page", F.xxhash64("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())]
        names = ["host", "page", "tokens", "parents", "counts", "texts", "words", "linked", "levels", "total"]
        for batch in batches:
            read_pages = [read(value.as_py()) for value in batch.column("html")]
            found = [occurrences(page) for page in read_pages]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            total = pa.array([sum(b.words for b in page.blocks if not b.dropped) for page in read_pages], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), *columns, total], names=names)

    return read_.select("host", "page", "html").mapInArrow(run, _SEEN).dropDuplicates(["host", "page"])


def classes(seen: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``host, token, parent, text, class, words, linked, level`` of the tokens on nearly all different pages of a host.

    A host has fewer of them than 1 / ``share`` times the tokens of its mean page.
    """
    each = seen.select("host", "page", F.explode(F.arrays_zip("tokens", "parents", "counts", "texts", "words", "linked", "levels")).alias("t"))
    each = each.select("host", "t.*", F.xxhash64("page", "t.counts").alias("h"))
    half = lambda value: F.sum(value.bitwiseAND(0x7FFFFFFF))
    vectors = each.groupBy("host", F.col("tokens").alias("token")).agg(
        F.min("parents").alias("parent"),
        F.max("texts").alias("text"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("counts").alias("places"),
        half(F.col("h")).alias("low"),
        half(F.shiftright("h", 32)).alias("high"),
        F.sum("words").alias("words"),
        F.sum("linked").alias("linked"),
        F.max("levels").alias("level"),
    )
    vectors = checkpointed(vectors.where(F.col("pages") >= min_pages))
    hosts = vectors.where(F.col("token") == ROOT).select("host", F.col("pages").alias("of"))
    kept = vectors.join(hosts, "host").where(F.col("pages") >= share * F.col("of"))
    return kept.select("host", "token", "parent", "text", F.xxhash64("pages", "places", "low", "high").alias("class"), "words", "linked", "level")


def by_host(rows: DataFrame, table: DataFrame, tokens: int, n: int) -> DataFrame:
    """``rows`` with the template rows of their host; the table is sent to every task where its tokens are few."""
    return rows.join(F.broadcast(table), "host", "left") if tokens <= BROADCAST_TOKENS else lookup(rows, "host", table, n)


def ordered(seen: DataFrame, members: DataFrame) -> DataFrame:
    """``host, token``: members that follow the same member of their class on all pages that hold them."""
    table = members.groupBy("host").agg(F.collect_list("token").alias("members"), F.collect_list("class").alias("classes"))
    rows = by_host(seen.select("host", "tokens"), table, members.count(), seen.count()).where(F.col("members").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, before = [], [], []
            for host, page, own, groups in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "members", "classes"))):
                group_of, last = dict(zip(own, groups)), {}
                for token in page:
                    if (group := group_of.get(token)) is not None:
                        hosts.append(host)
                        tokens.append(token)
                        before.append(last.get(group, 0))
                        last[group] = token
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, tokens, before)], names=["host", "token", "before"])

    follows = rows.mapInArrow(run, "host bigint, token bigint, before bigint").groupBy("host", "token").agg(F.min("before").alias("a"), F.max("before").alias("b"))
    return follows.where("a = b").select("host", "token")


def templates(seen: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``host, token, main``: the slots of a host's template, main ones and others, and the texts of valid classes (not main)."""
    found = checkpointed(classes(seen, min_pages, share))
    tags = found.where("not text").select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    nested = found.where("text").join(tags, ["host", "parent"]).where(F.col("class") == F.col("parent_class"))
    named_classes = nested.select("host", "class").distinct()
    members = checkpointed(found.join(named_classes, ["host", "class"], "left_semi").select("host", "token", "class"))
    texts = nested.select("host", "token", "words", "level").join(ordered(seen, members), ["host", "token"], "left_semi")
    of_all = seen.groupBy("host").agg(F.sum("total").alias("all_words"))
    held = texts.where(F.col("level") > DROPPED).groupBy("host").agg(F.sum("words").alias("words"))
    copies = held.join(of_all, "host").where(2 * F.col("words") > F.col("all_words")).select("host")
    texts = texts.select("host", "token", F.lit(False).alias("main")).join(copies, "host", "left_anti")

    menu = (F.col("linked") >= LINKED * F.col("words")) & (F.col("level") == 0)
    slots = found.where(~F.col("text") & (F.col("words") > 0)).withColumn("level", F.when(menu, DROPPED).otherwise(F.col("level")))
    top = slots.groupBy("host").agg(F.max("level").alias("top"))
    judged = slots.join(top, "host").select("host", "token", ((F.col("level") > DROPPED) & (F.col("level") == F.col("top"))).alias("main"))
    return judged.unionByName(texts)


def main_text(page: Page, main: frozenset[int] = frozenset(), others: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the main slots and the other tokens of its host's template."""
    known = [b for b in page.blocks if b.path in main]
    unknown = [b for b in page.blocks if b.path not in main and b.path not in others and not b.dropped]
    level = max((b.inside for b in known or unknown), default=0)
    chosen = [b for b in page.blocks if b.path in main or (b.path not in others and not b.dropped and b.inside >= level)]
    return "\n\n".join(b.text for b in chosen if (b.inside and b.heading) or text_token(b.path, b.text) not in others)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``keep`` + ``text``, the main text, for every row of ``pages``."""
    text_batches(pages.sparkSession)
    seen = checkpointed(seen_tokens(pages, url, html))
    template = checkpointed(templates(seen, min_pages, share))
    listed = lambda wanted: F.collect_list(F.when(wanted, F.col("token")))
    table = template.groupBy("host").agg(listed(F.col("main")).alias("main"), listed(~F.col("main")).alias("others"))
    rest = F.struct(*[named(c).alias(c) for c in keep]).alias("rest")
    rows = by_host(_with_host(pages, url, html, rest), table, template.count(), seen.count())
    schema = nullable(rows.select("rest", F.lit("").alias("text")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[frozenset(tokens.as_py() or ()) for tokens in batch.column(c)] for c in ("main", "others")]
            texts = [main_text(read(value.as_py()), *tokens) for value, *tokens in zip(batch.column("html"), *sets)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    found = rows.select("rest", "html", "main", "others").mapInArrow(run, schema)
    return found.select(*[F.col("rest").getField(c).alias(c) for c in keep], "text")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_html_extraction": op12_html_extraction}
ORACLES: dict[str, str] = {}
