"""HTML to structured page rows, with the standard library's parser inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.urls import resolve_text
from pagewright.session import text_batches

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ANCHOR = 200
NUMBER = re.compile(r"^\s*([+-]?\d+)")
TOKEN = re.compile(r"[^A-Za-z0-9_\s]")
#: A script or style, whose text holds no references, or an ampersand that begins none with a semicolon.
BARE = re.compile(r"(<(script|style)\b.*?</\2\s*>)|&(?!(?:#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*);)", re.I | re.S)


def host_key(url: str) -> str:
    name = re.sub(r"^[^/]*//(?:[^@/]*@)?([^/:?#]*).*$", r"\1", url, flags=re.S).lower()
    return re.sub(r"^www\.", "", name.rstrip("."))


def same_site(a: str, b: str) -> bool:
    return bool(a and b) and (a == b or a.endswith("." + b) or b.endswith("." + a))


def _dimension(text: str | None) -> int | None:
    """Leading whole number of an attribute; 0 and nonsense are missing."""
    match = NUMBER.match(text or "")
    return (int(match[1]) or None) if match else None


class _Page(HTMLParser):
    """Collects what the page row needs in one pass; tolerant of unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles, self.meta, self.canonical, self.og = [], {}, None, {}
        self.headings = {h: [] for h in HEADINGS}
        self.scripts, self.links, self.images, self.alternates, self.body = [], [], [], [], []
        self._open: list[tuple[str, list[str]]] = []  # elements whose text is collected
        self._in_body = False
        self._skip = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "body":
            self._in_body = True
        elif tag == "meta":
            name = a.get("name")
            if name in ("description", "robots") and name not in self.meta:
                self.meta[name] = a.get("content", "").strip() or None
            if a.get("property", "").startswith("og:") and a.get("content"):
                self.og[a["property"]] = a["content"]
        elif tag == "link":
            if a.get("rel") == "canonical" and self.canonical is None and "href" in a:
                self.canonical = a["href"]
            if a.get("rel") == "alternate" and a.get("hreflang"):
                self.alternates.append((a["hreflang"], a.get("href", "")))
        elif tag == "img":
            self.images.append((a.get("src", ""), a.get("alt", ""), _dimension(a.get("width")), _dimension(a.get("height"))))
        if tag in ("title", *HEADINGS) or tag == "a" and "href" in a or tag == "script" and a.get("type") == "application/ld+json":
            self._open.append((tag, []))
            if tag == "a":
                self.links.append([a["href"], "", a.get("rel", "")])
        if tag == "script" and a.get("type") != "application/ld+json" or tag == "style":
            self._skip = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == self._skip:
            self._skip = None
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                text = "".join(self._open.pop(i)[1])
                if tag == "title":
                    self.titles.append(text)
                elif tag == "a":
                    self.links[-1 - sum(1 for t, _ in self._open[i:] if t == "a")][1] = text
                elif tag == "script":
                    self.scripts.append(text)
                else:
                    self.headings[tag].append(text)
                break

    def handle_data(self, data):
        for _, texts in self._open:
            texts.append(data)
        if self._in_body:
            self.body.append(data)


def _json_text(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        return None


def page_row(url: str | None, html: str | None, closed: bool = False) -> dict:
    """Fields of one page. A page that cannot be read at all has empty fields.

    Browsers read some references without their semicolon too (``&amp`` at the end of a title that was cut); with
    ``closed``, these stay as they are written.
    """
    url, html = url or "", html or ""
    page = _Page()
    page.feed(BARE.sub(lambda m: m[1] or "&amp;", html) if closed else html)
    page.close()
    own = host_key(url) if "://" in url else ""
    inner, outer, seen = [], [], set()
    for href, text, rel in page.links:
        full = resolve_text(href, url)
        if full is None:
            continue
        text = text.strip()[:ANCHOR]
        mine = same_site(host_key(full), own)
        if (mine, full, text) in seen:
            continue
        seen.add((mine, full, text))
        link = {"href": full, "text": text, "rel": rel or None, "nofollow": "nofollow" in rel.lower().split()}
        (inner if mine else outer).append(link)
    title = page.titles[0].strip() if page.titles else ""
    words = TOKEN.sub("", "".join(page.body)).split()
    texts = {h: [t.strip() for t in page.headings[h] if t.strip()] for h in HEADINGS}
    return {
        "canonical_url": page.canonical,
        "title": title or None,
        "meta_description": page.meta.get("description"),
        "meta_robots": page.meta.get("robots"),
        **texts,
        "og_tags": list(page.og.items()),
        "json_ld": [t for t in map(_json_text, page.scripts) if t is not None],
        "internal_links": inner,
        "external_links": [x | {"status_code": None, "is_broken": None, "redirect_chain": None, "error": None} for x in outer],
        "images": [dict(zip(("src", "alt", "width", "height"), i)) for i in page.images],
        "word_count": len(words),
        "hreflang_tags": [{"lang": lang, "href": href} for lang, href in page.alternates],
        "page_size": len(html.encode("utf-8", "surrogatepass")),
    }


FIELDS = (
    "canonical_url string, title string, meta_description string, meta_robots string, h1 array<string>, h2 array<string>, h3 array<string>, "
    f"h4 array<string>, h5 array<string>, h6 array<string>, og_tags map<string, string>, json_ld array<string>, internal_links array<{schemas.LINK}>, "
    f"external_links array<{schemas.OUTLINK}>, images array<{schemas.IMAGE}>, word_count int, hreflang_tags array<{schemas.ALTERNATE}>, page_size int"
)


def extract(raw: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), closed: bool = False) -> DataFrame:
    """``keep`` + ``url`` + the structured fields per raw page. Narrow: no shuffle, batches stay small. ``closed``: only
    character references that end in a semicolon are decoded."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = raw.sparkSession
    text_batches(spark)
    fields = spark.createDataFrame([], FIELDS).schema
    read = raw.select(*keep, F.col(url).alias("url"), F.col(html).alias("_html"))
    schema = read.drop("_html").schema
    for field in fields:
        schema = schema.add(field)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            rows = [page_row(u.as_py(), h.as_py(), closed) for u, h in zip(batch.column(n - 2), batch.column(n - 1))]
            made = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 1], *made], names=schema.names)

    return read.mapInArrow(run, schema)
