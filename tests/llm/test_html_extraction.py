"""HTML reading, template deduction against occurrence vectors kept whole, and the texts of made-up hosts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm import html_extraction, html_text
from pagewright.llm.html_extraction import main_text, occurrences
from tests.llm.helpers import CLASHES


def text_of(html):
    return main_text(html_text.read(html))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b<b>c</b>d</p>e", "a\n\nbcd\n\ne"),
        ("<p><b>one<br><p>two</p></b>three", "one\n\ntwo\n\nthree"),
        ("<p> a&nbsp;&amp;  &#98;\n c&lt;d &copy; &am </p>", "a & b c<d © &am"),
        ("<ul><li>a<li>b <i>c</i><ul><li>d</ul><li>e</ul>", "a\n\nb c\n\nd\n\ne"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("x<!-- y --><!-- > z -->w<!-- open", "xw"),
        ("a<script>if (1 < 2) '</p>'</script>b<style>p{}</style><SCRIPT>x</SCRIPT >c", "abc"),
        ('<p title="a > b">q</p><p title=\'>\'>r</p><p title="s>t</p>', "q\n\nr\n\nt"),
        ("1 < 2 <3 <p", "1 < 2 <3"),
        ("</div></p>a</span><b>c</p>d", "ac\n\nd"),
        ("<title>t</title><nav>n</nav><header>h</header><p>a</p><aside>s</aside><form>f<p>g</form><footer>z", "a"),
        ("<article><header><h1>h</h1></header><p>a<p class='ad'>x<p>b<div id=comments><p>c</div></article><p>out", "h\n\na\n\nb"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<body class='has-sidebar'><div class='with-comments'>a</div><div class=siteFooter>b</div><div hidden>c</div>", "a"),
        ("<div role=navigation>n</div><p style='display: none'>x</p><p>click <button>me</button>here", "click here"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\n\ner"),
    ],
)
def test_reading(html, text):
    assert text_of(html) == text


def article(rng, n):
    return [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 40))) for _ in range(n)]


def host_pages(rng, host, n, shared=None):
    """Pages without telling names: the same notices, a menu whose links vary, and an article of a few paragraphs."""
    for i in range(n):
        body = article(rng, rng.randint(2, 6)) + ([shared] if shared and i % 4 else [])
        links = "".join(f"<li><a href=/{i}>topic {rng.randint(0, 99)}</a></li>" for _ in range(6))
        html = f"<div class=a1>We save small files on your device <b>today</b></div><ul class=a2>{links}</ul><div class=a3>{''.join(f'<p>{p}</p>' for p in body)}</div><div class=a4>All texts by us</div>"
        yield f"http://{host}/p{i}", html, "\n\n".join(body)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h, *_) in enumerate(rows)], "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_texts_of_a_template_and_menus_are_left_out(spark):
    rng = random.Random(1)
    rows = [*host_pages(rng, "A.test", 30, shared="one passage that most pages of the host share"), *host_pages(rng, "b.test", 12)]
    got = texts(html_extraction.extract(frame(spark, rows)))
    assert got == {i: text for i, (_, _, text) in enumerate(rows)}


def test_a_template_joined_by_host_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = [r for k in range(4) for r in host_pages(rng, f"h{k}.test", 10)]
    monkeypatch.setattr(html_extraction, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr("pagewright.operators.skew.PLAIN", 0)
    assert texts(html_extraction.extract(frame(spark, rows))) == {i: text for i, (_, _, text) in enumerate(rows)}


def test_few_pages_and_copies_teach_nothing(spark):
    rng = random.Random(3)
    few = [(u, h, "") for u, h, _ in host_pages(rng, "few.test", 3)]
    body = article(rng, 1)[0]
    copies = [(f"http://copies.test/{i}", f"<article><h1>Title</h1><p>{body}</p></article>", f"Title\n\n{body}") for i in range(40)]
    near = [(f"http://near.test/{i}", f"<article><h1>Title</h1><p>{body}</p><p>no {i}</p></article>", f"Title\n\n{body}\n\nno {i}") for i in range(40)]
    got = texts(html_extraction.extract(frame(spark, few + copies + near)))
    assert all("We save small files" in got[i] for i in range(3))
    assert {i: got[i] for i in range(3, 83)} == {i + 3: text for i, (_, _, text) in enumerate(copies + near)}


def test_classes_are_those_of_whole_occurrence_vectors(spark):
    rng = random.Random(4)
    rows = [r for k in range(3) for r in host_pages(rng, f"h{k}.test", 9, shared="again and again")]
    rows += rows[:5]  # pages alike count once
    vectors, total = defaultdict(dict), Counter()
    for url, html, _ in dict.fromkeys(rows):
        host = url.split("/")[2]
        total[host] += 1
        tokens, _, counts, *_ = occurrences(html_text.read(html))
        for token, n in zip(tokens, counts):
            vectors[host, token][html] = n
    expected = defaultdict(set)
    for (host, token), vector in vectors.items():
        if len(vector) >= max(4, 0.8 * total[host]):
            expected[host, frozenset(vector.items())].add(token)
    seen = html_extraction.seen_tokens(frame(spark, rows))
    assert seen.count() == 27
    found = defaultdict(set)
    for r in html_extraction.classes(seen).collect():
        found[r["host"], r["class"]].add(r["token"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_members_out_of_order_are_no_template(spark):
    rows = []
    for i in range(12):
        parts = ["<div class=p>first words here</div>", f"<p>own text number {i} of this page with some more words</p>", "<div class=q>second words here</div>"]
        extra = "<div class=r>walking words</div>"
        parts.insert(i % 4, extra)
        rows.append((f"http://x.test/{i}", "".join(parts)))
    got = texts(html_extraction.extract(frame(spark, rows)))
    assert all("walking words" in t and f"number {i} of" in t for i, t in got.items())


def test_awkward_tables(spark):
    rows = [(1, None, "<p>a</p>"), (2, "no host", None), (3, "http://h.test/", ""), (3, "http://h.test/", ""), (None, None, None), (4, "http://h.test/x", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("own") for c in (*CLASHES, "host", "page", "text", "rest", "left_out")})
    got = html_extraction.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in got.collect()) == [(0, 0), (1, 1), (2, 0), (3, 0), (3, 0), (4, 999_999)]
    assert html_extraction.extract(pages.where(F.lit(False))).count() == 0


def test_slots_of_a_template_are_judged_once_for_the_host(spark):
    """What a page does not say itself, its host's template does: a slot that is an aside on the others, too."""
    rng = random.Random(7)
    rows = []
    for i in range(10):
        body = "".join(f"<p>{p}</p>" for p in article(rng, 3))
        rows.append((f"http://s.test/{i}", f"<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=story>{body}</div><div class=more><a href=/>{article(rng, 1)[0]}</a></div>"))
    linked = f"<div class=story><p>short</p></div><div class=more>{article(rng, 1)[0]} without a link here</div>"
    rows.append(("http://s.test/x", linked))
    seen = html_extraction.seen_tokens(frame(spark, rows))
    kinds = Counter(r["main"] for r in html_extraction.templates(seen).collect())
    assert kinds[True] == 1 and kinds[False] >= 2  # the story; the menu and its word, the links below
    assert texts(html_extraction.extract(frame(spark, rows)))[10] == "short"
    assert "without a link" in texts(html_extraction.extract(frame(spark, rows[-1:])))[0]
