"""Queries of retrieval (RT, WN05-06)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import decisions as D
from sextant.operators import matching as L
from sextant.operators import ranking as R
from sextant.operators import selection as V
from sextant.operators import text as X
from sextant.plans.registry import N, query

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def words_sql(col: str) -> str:
    raw = f"regexp_extract_all(lower({col}), '[a-z0-9]+')"
    return f"list_transform(list_filter({raw}, lambda w: w NOT IN ({_STOP}) AND (length(w) > 1 OR regexp_full_match(w, '[0-9]'))), lambda w: regexp_replace(regexp_replace(w, 'oe|ae', 'e', 'g'), '^(.{{2,}}[^sui])s$', '\\1'))"


POSTS = f"p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({words_sql('text')}) AS term FROM documents) GROUP BY ALL)"
ASKED = f"q AS (SELECT DISTINCT item_id AS query, unnest({words_sql('text')}) AS term FROM benchmark)"
BM25 = f"""{POSTS}, {ASKED}, len AS (SELECT doc, sum(tf) AS len FROM p GROUP BY doc), st AS (SELECT (SELECT sum(len) FROM len) / (SELECT count(*) FROM documents) AS avgdl, (SELECT count(*) FROM documents) AS n),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
    s AS (SELECT query, doc, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM q JOIN p USING (term) JOIN idf USING (term) JOIN len USING (doc), st GROUP BY ALL)"""  # fmt: skip


def _words(t):
    return t.once("words", lambda: X.tokenised(t.documents, "doc_id", "text"))


def _posts(t, terms=None):
    return X.postings(_words(t) if "words" in t.made else X.tokenised(t.documents, "doc_id", "text"), terms)


def _asked(t):
    return t.once("asked", lambda: t.benchmark.select(F.col("item_id").alias("query"), F.explode(X.words(F.col("text"))).alias("term")).distinct())


def _bm25(t):
    return X.bm25(_words(t), _asked(t))


@query("rt01_tokenizer", f"SELECT doc_id, len(ws) AS n, len(list_distinct(ws)) AS distinct_words FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents)")
def tokenizer(t):
    return t.documents.select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct_words"))


@query("rt02_phrase_mention", "SELECT source, count(*) FILTER (contains(' ' || array_to_string(" + words_sql("text") + ", ' ') || ' ', ' idiot ')) AS n FROM documents GROUP BY source")
def mention(t):
    return t.documents.groupBy("source").agg(F.count_if(X.mentions(F.col("text"), F.lit("idiot"))).alias("n"))


@query("rt03_sentence_spans", r"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([\p{Lu}0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def sentences(t):
    parts = F.split("text", r"(?<=[.!?])\s+(?=[\p{Lu}0-9(\[])")
    return t.documents.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))


@query("rt05_bm25_index", f"WITH {POSTS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def index(t):
    return _posts(t).groupBy("term").agg(N.alias("df"), F.sum("tf").alias("cf"))


@query("rt06_bm25_score", f"WITH {BM25} SELECT query, doc, round(score, 6) AS score FROM s")
def score(t):
    return _bm25(t).select("query", "doc", F.round("score", 6).alias("score"))


@query("wn05_best_passage_per_article", f"""WITH {BM25}, b AS (SELECT query, d.source, doc, round(score, 9) AS score, row_number() OVER (PARTITION BY query, d.source ORDER BY round(score, 9) DESC, doc) AS k FROM s JOIN documents d ON d.doc_id = doc)
    SELECT query, source, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE k = 1) WHERE rank <= 5""")  # fmt: skip
def best_passage(t):
    rows = _bm25(t).withColumn("score", F.round("score", 9)).join(t.documents.select(F.col("doc_id").alias("doc"), "source"), "doc")
    order = [F.desc("score"), F.col("doc")]
    best = R.first_k(rows, ["query", "source"], order, 1)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where("rank <= 5").select("query", "source", "doc", "rank")


MEANS = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
    v AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)"""


@query("rt08_condition_vectors", f"WITH {MEANS} SELECT label, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS x63 FROM v")
def condition_vectors(t):
    v = X.mean_vectors(t.embeddings, "label", "embedding")
    return v.select("label", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[63], 6).alias("x63"))


@query("rt10_dense_cosine", f"WITH {MEANS} SELECT vec_id, v.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS cosine FROM embeddings, v")
def cosine(t):
    v = X.mean_vectors(t.embeddings, "label", "embedding")
    return t.embeddings.select("vec_id", X.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("e")).crossJoin(F.broadcast(v)).select("vec_id", "label", F.round(X.dot(F.col("e"), F.col("v")), 6).alias("cosine"))


@query("rt09_mixed_query_vector", f"WITH {MEANS}, u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v), w AS (SELECT a.label, list_transform(list_zip(a.u, b.u), lambda z: 0.6 * z[1] + 0.4 * z[2]) AS w FROM u a JOIN u b ON b.label = (a.label + 1) % 10) SELECT label, round(w[1] / sqrt(list_dot_product(w, w)), 6) AS x0 FROM w")
def mixed_vector(t):
    v = X.mean_vectors(t.embeddings, "label", "embedding")
    other = v.select(((F.col("label") + 9) % 10).alias("label"), F.col("v").alias("o"))
    w = v.join(other, "label").select("label", F.zip_with("v", "o", lambda a, b: 0.6 * a + 0.4 * b).alias("w"))
    return w.select("label", F.round(X.unit(F.col("w"))[0], 6).alias("x0"))


@query("rt15_mix_fidelity", f"WITH {MEANS} SELECT e.label, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)), 6) AS fidelity FROM embeddings e JOIN v USING (label) GROUP BY e.label")
def fidelity(t):
    v = X.mean_vectors(t.embeddings, "label", "embedding")
    e = t.embeddings.select("label", X.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("e")).join(v, "label")
    return e.groupBy("label").agg(F.round(F.avg(X.dot(F.col("e"), F.col("v"))), 6).alias("fidelity"))


TWO = f"""{BM25}, r1 AS (SELECT query, doc AS item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s),
    r2 AS (SELECT query, doc AS item, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, doc) AS rank FROM q JOIN p USING (term) GROUP BY query, doc),
    f AS (SELECT query, item, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM r1 WHERE rank <= 20 UNION ALL SELECT * FROM r2 WHERE rank <= 20) GROUP BY ALL)"""


def _two(t):
    by = Window.partitionBy("query")
    scored = _bm25(t)
    a = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "doc")))
    b = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "doc")))
    return a.where("rank <= 20").select("query", F.col("doc").alias("item"), "rank").union(b.where("rank <= 20").select("query", "doc", "rank"))


@query("wn06_rrf", f"WITH {TWO} SELECT query, item, round(score, 6) AS score FROM f")
def rrf(t):
    return X.rrf(_two(t)).select("query", "item", F.round("score", 6).alias("score"))


@query("rt11_hybrid_rank", f"""WITH {TWO}, a AS (SELECT f.*, d.source, row_number() OVER (PARTITION BY query, d.source ORDER BY round(score, 9) DESC, item) AS k FROM f JOIN documents d ON d.doc_id = item)
    SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM a WHERE k = 1""")  # fmt: skip
def hybrid(t):
    rows = X.rrf(_two(t)).withColumn("score", F.round("score", 9)).join(t.documents.select(F.col("doc_id").alias("item"), "source"), "item")
    order = [F.desc("score"), F.col("item")]
    best = R.first_k(rows, ["query", "source"], order, 1)
    return best.select("query", "item", F.row_number().over(Window.partitionBy("query").orderBy(*order)).alias("rank"))


@query("rt07_eligibility_filter", f"WITH {POSTS}, {ASKED} SELECT query, count(DISTINCT doc) AS eligible FROM q JOIN p USING (term) JOIN documents d ON d.doc_id = doc WHERE NOT regexp_matches(d.text, '(?i)token = ') GROUP BY query")
def eligibility(t):
    fit = t.documents.where(~F.col("text").rlike("(?i)token = ")).select(F.col("doc_id").alias("doc"))
    # one row of each word of queries in a document, then sums by document in parts that don't grow with the table
    met = _posts(t, _asked(t).select("term").distinct()).join(fit, "doc", "left_semi").repartition(X.parts_of(t.documents.count()), "doc")
    return met.join(_asked(t), "term").groupBy("query", "doc").agg(F.lit(1).alias("one")).groupBy("query").agg(N.alias("eligible"))


@query("rt13_query_composition", "SELECT o_custkey, 'orders ' || array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' ') AS query FROM orders GROUP BY o_custkey")
def composition(t):
    return t.orders.groupBy("o_custkey").agg(F.concat_ws(" ", F.lit("orders"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " ")).alias("query"))


@query("rt14_query_vocabulary", "SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS id, n_name AS text FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def vocabulary(t):
    part = lambda df, kind, k, n: df.select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("id"), F.col(n).alias("text"))
    return part(t.nation, "nation", "n_nationkey", "n_name").union(part(t.region, "region", "r_regionkey", "r_name"))


SENT = r"s AS (SELECT doc_id AS doc, pos, sentence FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS pos FROM documents))"


@query("rt16_treatment_free_runs", rf"""WITH {SENT}, d AS (SELECT *, regexp_matches(sentence, '[0-9@%$]') AS dirty FROM s), g AS (SELECT *, sum(CASE WHEN dirty THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM d)
    SELECT doc, CAST(run AS BIGINT) AS run, length(string_agg(sentence, ' ' ORDER BY pos)) AS n_chars FROM g WHERE NOT dirty GROUP BY doc, run HAVING length(string_agg(sentence, ' ' ORDER BY pos)) >= 150""")  # fmt: skip
def clean_runs(t):
    s = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    return X.clean_runs(s, F.col("sentence").rlike("[0-9@%$]"), 150).select("doc", "run", F.length("text").alias("n_chars"))


@query("rt17_window_chunking", r"""WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 100) / 80) AS BIGINT)))) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc, chunk, md5(array_to_string(w[chunk * 80 + 1 : chunk * 80 + 100], ' ')) AS digest FROM c""")  # fmt: skip
def chunking(t):
    return X.windows(t.documents.select(F.col("doc_id").alias("doc"), "text"), 100, 20).select("doc", "chunk", F.md5("text").alias("digest"))


@query("rt19_section_cap", "SELECT conv_id, turn, length(text) AS n, greatest(0, least(length(text), 500 - (before))) AS kept FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)")
def section_cap(t):
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.length("text")
    return t.conversations.withColumn("before", before).select("conv_id", "turn", n.alias("n"), F.greatest(F.lit(0), F.least(n, 500 - F.col("before"))).alias("kept"))


@query("rt21_judging_pool", f"WITH {TWO} SELECT DISTINCT query, item, sha256('pool:' || query || ':' || item) AS digest FROM f")
def pool(t):
    return _two(t).select("query", "item").distinct().withColumn("digest", F.sha2(F.concat_ws(":", F.lit("pool"), F.col("query").cast("string"), F.col("item").cast("string")), 256))


@query("rt23_consensus", """WITH a AS (SELECT doc_id AS item, quality + toxic AS grade FROM labels WHERE doc_id % 31 <> 0), b AS (SELECT doc_id AS item, CASE WHEN doc_id % 7 = 0 THEN 2 - quality WHEN doc_id % 41 = 0 THEN 5 ELSE quality + toxic END AS grade FROM labels),
    s AS (SELECT doc_id AS item, 1 AS grade FROM labels WHERE doc_id % 14 = 0 UNION ALL SELECT doc_id, 0 FROM labels WHERE doc_id % 70 = 0 UNION ALL SELECT -doc_id, 1 FROM labels WHERE doc_id % 50 = 0 AND doc_id > 0), g AS (SELECT item, max(grade) AS s, count(*) AS n FROM s GROUP BY item),
    r AS (SELECT item, a.grade AS a, b.grade AS b, g.s, g.n FROM a FULL JOIN b USING (item) FULL JOIN g USING (item)),
    p AS (SELECT item, unnest(list_filter([CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'judged by one only' END, CASE WHEN a IS NULL AND b IS NULL THEN 'settled without being judged' END, CASE WHEN a <> b AND s IS NULL THEN 'not settled' END, CASE WHEN a = b AND s IS NOT NULL THEN 'settled though agreed' END,
        CASE WHEN n > 1 THEN 'settled twice' END, CASE WHEN coalesce(a NOT BETWEEN 0 AND 2, false) OR coalesce(b NOT BETWEEN 0 AND 2, false) OR coalesce(s NOT BETWEEN 0 AND 2, false) THEN 'grade out of range' END], lambda x: x IS NOT NULL)) AS problem FROM r)
    SELECT item, CASE WHEN a = b THEN a ELSE s END AS grade, NULL AS problem FROM r WHERE item NOT IN (SELECT item FROM p) UNION ALL SELECT item, NULL, problem FROM p""")
def consensus(t):
    """Two judges of the labelled documents, some settled by a third: the grades that stand, and the problems."""
    i, own = F.col("doc_id"), F.col("quality") + F.col("toxic")
    first = t.labels.where(i % 31 != 0).select(i.alias("item"), own.alias("grade"))
    second = t.labels.select(i.alias("item"), F.when(i % 7 == 0, 2 - F.col("quality")).when(i % 41 == 0, 5).otherwise(own).alias("grade"))
    settled = t.labels.where(i % 14 == 0).select(i.alias("item"), F.lit(1).alias("grade")).union(t.labels.where(i % 70 == 0).select(i, F.lit(0))).union(t.labels.where((i % 50 == 0) & (i > 0)).select(-i, F.lit(1)))
    good, problems = D.consensus(first, second, settled)
    return good.select("item", "grade", F.lit(None).cast("string").alias("problem")).union(problems.select("item", F.lit(None).cast("int"), "problem"))


@query("rt24_jn20_word_overlap", f"WITH b AS (SELECT item_id, list_distinct({words_sql('text')}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) >= 0.1 * len(list_distinct(list_concat(a.w, b.w)))")
def word_overlap(t):
    return X.overlapping(t.benchmark, "item_id", "text", 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query("jn20_sequence_ratio")
def sequence_ratio(t):
    """Part names that are alike by their matching blocks, and the nations' and customers' segments among them."""
    labels = t.part.select(F.col("p_name").alias("label")).union(t.part.select(F.lower("p_type"))).union(t.nation.select(F.lower("n_name")))
    return L.similar_labels(labels).withColumn("ratio", F.round("ratio", 6))


PLAN_SQL = """f AS (SELECT lang AS condition, n_chars AS ord, doc_id AS item FROM documents UNION ALL SELECT source, n_chars, doc_id FROM documents),
    pl AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY ord, item) AS place FROM f QUALIFY place <= 12),
    ar AS (SELECT doc_id AS item, CASE WHEN contains(text, '@') THEN 'contact' END AS reason, 'L' || CAST(n_chars % 4 AS VARCHAR) AS licence FROM documents WHERE n_chars % 11 <> 0),
    se AS (SELECT p.condition, p.item, a.reason, a.licence FROM pl p JOIN ar a USING (item) QUALIFY coalesce(sum(CASE WHEN a.reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.condition ORDER BY p.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 8)"""


def selected(t):
    """Eight of twelve planned articles for each language and each source, the shortest first."""
    d = t.documents
    found = d.select(F.col("lang").alias("condition"), F.col("n_chars").alias("ord"), F.col("doc_id").alias("item")).union(d.select("source", "n_chars", "doc_id"))
    plan = V.planned(found, 12)
    # only what is planned is looked at: a bounded number for each condition
    own = d.where("n_chars % 11 <> 0").select(F.col("doc_id").alias("item"), F.when(F.contains("text", F.lit("@")), "contact").alias("reason"))
    return V.select_articles(plan, own.join(plan.select("item").distinct(), "item", "left_semi"), 8)


@query("rt20_article_selection", f"WITH {PLAN_SQL} SELECT item, string_agg(condition, ';' ORDER BY condition) FILTER (reason IS NULL) AS conditions, any_value(reason) AS refused FROM se GROUP BY item")
def article_selection(t):
    taken, refused = selected(t)
    return taken.select("item", F.array_join("conditions", ";").alias("conditions"), F.lit(None).cast("string").alias("refused")).union(refused.select("item", F.lit(None).cast("string"), "reason"))


@query("rt20_licence_counts", f"WITH {PLAN_SQL} SELECT licence, count(DISTINCT item) AS articles, count(*) AS uses FROM se WHERE reason IS NULL GROUP BY licence")
def licence_counts(t):
    licences = t.documents.select(F.col("doc_id").alias("item"), F.concat(F.lit("L"), (F.col("n_chars") % 4).cast("string")).alias("licence"))
    return V.licence_counts(selected(t)[0], licences)


@query("rt25_search_terms", "SELECT r_regionkey, '(' || string_agg(n_name || '[ti]', ' OR ' ORDER BY n_name) || ') AND ' || r_name AS term FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def search_terms(t):
    names = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(x, F.lit("[ti]"))), " OR ")
    return t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(names.alias("n")).select("r_regionkey", F.concat(F.lit("("), "n", F.lit(") AND "), "r_name").alias("term"))
