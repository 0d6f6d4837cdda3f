"""Keyword extraction and TF-IDF over page fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import contains_ci, rounded

# Words that are never keywords.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his how i if in into is it its just me my no nor not of on "
    "or our out own say she so some than that the their them then there these they this to too us very was we were what "
    "when where which who whom why will with you your about after all also am any been before being between both can did "
    "do does each few get got here him how more most much must new now off old one only other over said same should such "
    "take tell through under up use way well would"
).split()
TOP = 20
EMPTY = "array<string>"


def tokens(text: Column) -> Column:
    """Lower-cased words of more than two characters that are no stop words; ``-`` and ``_`` belong to words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def ngrams(words: Column, longest: int) -> Column:
    """Runs of 1 to ``longest`` words, joined by spaces: all single words first, then pairs, and so on."""
    none = F.array().cast(EMPTY)

    def of(w: Column) -> Column:
        starts = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.concat(*[F.transform(starts(n), _joiner(w, n)) for n in range(1, longest + 1)])

    return F.coalesce(F.transform(F.array(words), of)[0], none)


def _joiner(w: Column, n: int):
    return lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")


def signals(pages: DataFrame) -> DataFrame:
    """``page_id, url, pos, keyword, weight, source`` per n-gram occurrence, in order of appearance."""
    none = F.array().cast(EMPTY)
    path_words = F.flatten(F.transform(F.filter(F.split(urls.path("url"), "[/-]"), lambda s: s != ""), tokens))
    alts = F.filter(F.transform("images", lambda i: i["alt"]), lambda a: F.coalesce(a != "", F.lit(False)))

    def marked(grams: Column, weight: float, source: str) -> Column:
        return F.transform(grams, lambda g: F.struct(g.alias("keyword"), F.lit(float(weight)).alias("weight"), F.lit(source).alias("source")))

    def many(column: Column, longest: int) -> Column:
        return F.flatten(F.transform(F.coalesce(column, none), lambda t: ngrams(tokens(t), longest)))

    found = F.concat(
        marked(ngrams(tokens(F.col("title")), 3), 10, "title"),
        marked(many(F.col("h1"), 3), 8, "h1"),
        marked(ngrams(tokens(F.col("meta_description")), 3), 5, "meta_description"),
        marked(many(F.col("h2"), 3), 4, "headings"),
        marked(many(F.col("h3"), 3), 4, "headings"),
        marked(ngrams(path_words, 2), 3, "url"),
        marked(many(alts, 2), 1, "image_alt"),
    )
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "s")).select("page_id", "url", "pos", "s.keyword", "s.weight", "s.source")


def page_keywords(pages: DataFrame, top: int = TOP) -> DataFrame:
    """``page_id, url, keyword, score, frequency, sources, first``: the best ``top`` of each page, first seen first among equals."""
    summed = signals(pages).groupBy("page_id", "url", "keyword").agg(
        F.sum("weight").alias("score"), F.count(F.lit(1)).cast("int").alias("frequency"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("pos").alias("first")
    )
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "first")
    return summed.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top).drop("_n")


def tf_idf(found: DataFrame, total: DataFrame, top: int = TOP) -> DataFrame:
    """Rescore page keywords by ln(N / df); ``df`` counts the pages whose kept keywords hold the word.

    ``total`` is one row with column ``n``: the number of pages scored.
    """
    df = found.groupBy("keyword").agg(F.count_distinct("page_id").alias("df"))
    scored = found.join(df, "keyword").join(F.broadcast(total)).withColumn("score", rounded(F.col("score") * F.ln(F.col("n") / F.col("df")), 2))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "first", "keyword")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top).drop("_n", "n")


def keyword_table(pages: DataFrame) -> DataFrame:
    """The stored keyword rows of all pages."""
    total = pages.agg(F.count(F.lit(1)).alias("n"))
    return tf_idf(page_keywords(pages), total).select("page_id", "keyword", "score", "frequency", "sources")


def replace_keywords(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of pages that were not scored again, and the fresh rows."""
    return stored.join(fresh.select("page_id").distinct(), "page_id", "left_anti").unionByName(fresh)


def search_keywords(pages: DataFrame, stored: DataFrame, terms: str = "", limit: int = 50, offset: int = 0, shown: int = 10) -> DataFrame:
    """Pages that match every comma-separated term in url, title or a keyword; best keywords each; ``total`` counts all pages."""
    out = pages.select("page_id", "url", "title")
    for term in [t.strip() for t in terms.split(",") if t.strip()]:
        hit = stored.where(contains_ci("keyword", term)).select("page_id").distinct().withColumn("_hit", F.lit(True))
        named = F.coalesce(contains_ci("url", term), F.lit(False)) | F.coalesce(contains_ci("title", term), F.lit(False))
        out = out.join(hit, "page_id", "left").where(named | F.col("_hit")).drop("_hit")
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "keyword")
    top = stored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= shown)
    lists = top.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_n", "keyword", "score"))).alias("_k"))
    total = pages.agg(F.count(F.lit(1)).alias("total"))
    window = out.orderBy("url", "page_id").offset(offset).limit(limit)
    return (
        window.join(lists, "page_id", "left")
        .join(F.broadcast(total))
        .select("page_id", "url", "title", F.transform("_k", lambda k: F.struct(k["keyword"], k["score"])).alias("keywords"), "total")
    )


def pages_with(stored: DataFrame, keyword: str) -> DataFrame:
    return stored.where(F.col("keyword") == keyword).select("page_id").distinct()
