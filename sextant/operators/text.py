"""Tokens, BM25, vectors and screening of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.shared import kept

# The words that queries and passages leave out, and BM25's constants.
STOPWORDS = """
    an and are as at be been being but by can could did do does for from had has have he her
    his how if in into is it its may might more most no nor not of on or our she should so such
    than that the their them then there these they this those to was we were what when where
    which while who whom why will with would you your
""".split()
K1, B = 1.2, 0.75
#: Documents that a task of (query, document) sums takes.
DOCS = 10_000


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and digits without stopwords and single letters, a plural s taken off."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(raw, lambda w: ~w.isin(STOPWORDS) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    return F.transform(kept, lambda w: F.regexp_replace(F.regexp_replace(w, "oe|ae", "e"), "^(.{2,}[^sui])s$", "$1"))


def mentions(text: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in a row in the text."""
    pad = lambda x: F.concat(F.lit(" "), F.array_join(words(x), " "), F.lit(" "))
    return F.contains(pad(text), pad(phrase))


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, len, w): the words of each document and how many they are."""
    return docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w")).select("doc", F.size("w").alias("len"), "w")


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, len, term, tf) of tokenised documents with unique ids.

    With terms(term), distinct, other words are left out before anything is shuffled."""
    each = docs.select("doc", "len", F.explode("w").alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score, n) of queries(query, term) against tokenised documents; n of the query's terms are in the document.

    docs is read twice (once its lengths only) and the queries' postings twice:
    give docs as a written table. Only words of queries are shuffled, by document
    and into as many parts as hold DOCS documents each, so that a task's sums
    don't grow with the table."""
    total, length = docs.agg(F.count(F.lit(1)), F.sum("len")).first()
    asked = queries.select("query", "term").distinct()
    hits = kept(postings(docs, asked.select("term").distinct()), "hits")
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = kept(asked.join(counts, "term"), "asked-terms")
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit((length or 0) / max(total, 1))))
    dealt = hits.repartition(parts_of(total), "doc")
    return dealt.join(counted, "term").groupBy("query", "doc").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("n"))


def parts_of(docs: int) -> int:
    return 8 + docs // DOCS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """The unit mean vector of each group."""
    each = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return mean.select(by, unit(F.col("v")).alias("v"))


def rrf(ranks: DataFrame, k: int = 60) -> DataFrame:
    """(query, item, score): reciprocal ranks of several lists added up."""
    return ranks.groupBy("query", "item").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def clean_runs(sentences: DataFrame, dirty: Column, least: int) -> DataFrame:
    """Maximal runs of sentences without a dirty one, of at least so many characters: (doc, run, text)."""
    w = Window.partitionBy("doc").orderBy("pos")
    islands = sentences.withColumn("dirty", dirty).withColumn("run", F.sum(F.col("dirty").cast("int")).over(w)).where("NOT dirty")
    runs = islands.groupBy("doc", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return runs.where(F.length("text") >= least)


def windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc, chunk, text): windows of white-space words that overlap; a short text is one window."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    step = size - overlap
    rows = docs.select("doc", w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int")))
    return rows.select("doc", F.explode(starts).alias("chunk"), "w").select("doc", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, size), " ").alias("text"))


def overlapping(rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets of words have at least the similarity, a < b.

    Such sets share one of the first n - ceil(least * n) + 1 words of each in
    any order that holds for all; rare words come first, so only pairs with one
    of these in common meet."""
    sets = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("term")).distinct()
    often = sets.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ordered = sets.join(often, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("o"))
    ordered = ordered.select("id", F.transform("o", lambda x: x["term"]).alias("w"))
    head = ordered.select("id", F.explode(F.slice("w", F.lit(1), (F.size("w") - F.ceil(F.size("w") * least - 1e-9) + 1).cast("int"))).alias("term"))
    met = head.withColumnRenamed("id", "a").join(head.withColumnRenamed("id", "b"), "term").where("a < b").select("a", "b").distinct()
    both = met.join(ordered.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(ordered.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return both.select("a", "b", (F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))).alias("jaccard")).where(F.col("jaccard") >= least)


def retrieve(ranked: DataFrame, asked: DataFrame, k: int, screen: Column) -> DataFrame:
    """(query, item, sentence, k): for each query the best k items whose excerpt passes the screen, one of each source.

    ranked is (query, item, source, score, text), asked (query, term). The
    excerpt is the sentence with most of the query's terms, the first of equals;
    items without any are left out, and so are those whose excerpt the screen
    (over the column sentence) holds for."""
    order = [F.desc("score"), F.col("item")]
    place = F.row_number().over(Window.partitionBy("query", "source").orderBy(*order))
    best = ranked.withColumn("_k", place).where("_k = 1").drop("_k")
    each = best.select("query", "item", "score", F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    terms = each.select("query", "item", "pos", F.explode(F.array_distinct(words(F.col("sentence")))).alias("term"))
    hits = terms.join(asked.distinct(), ["query", "term"]).groupBy("query", "item", "pos").agg(F.count(F.lit(1)).alias("n"))
    top = hits.groupBy("query", "item").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"))
    passed = each.join(top, ["query", "item", "pos"]).where(~screen)
    return passed.select("query", "item", "sentence", F.row_number().over(Window.partitionBy("query").orderBy(*order)).alias("k")).where(F.col("k") <= k)
