"""Queries of sources, sinks and orchestration (SRC, PRJ07, OP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import text as X
from sextant.operators.timing import StageTimes, latency
from sextant.plans import standin as S
from sextant.plans.registry import N, Tables, query
from sextant.sources import bundles as U
from sextant.sources import files as I
from sextant.sources.paged import PagedSource
from sextant.sources.shared import drop_folder, fresh_path


def _scratch(t, name: str) -> str:
    return fresh_path(t.spark, name)


@query("src01_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(t):
    path = _scratch(t, "csv")
    t.nation.write.option("header", True).csv(path)
    return I.read_csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src02_parquet_column_scan", "SELECT l_returnflag, round(sum(l_quantity), 6) AS q FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag")
def column_scan(t):
    return t.lineitem.where("l_discount >= 0.05").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 6).alias("q"))


@query("src03_late_label_scan", "SELECT quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def late_labels(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id").groupBy("quality", "toxic").agg(N.alias("n"))


@query("src04_nested_parquet_sink", "SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS lines, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY l_orderkey")
def nested_sink(t):
    path = _scratch(t, "nested")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.struct(F.array_sort(F.collect_list("l_linenumber")).alias("lines"), F.round(F.sum("l_quantity"), 6).alias("q")).alias("s"))
    g.write.parquet(path)
    return t.spark.read.schema(g.schema).parquet(path).select("k", "s.lines", "s.q")


@query("src05_src06_vocabulary", "SELECT 'E_' || r_regionkey AS code, NULL AS value FROM region UNION ALL SELECT 'E_' || n_regionkey, n_name FROM nation")
def vocabulary(t):
    path = _scratch(t, "specs")
    values = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("possible_values"))
    spec = F.struct(F.lit("M").alias("data_type"), F.lit(None).cast("string").alias("default_value"), F.lit(False).alias("is_antecedent"), "possible_values", F.col("r_name").alias("question"))
    rows = t.region.join(values, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("E_"), F.col("r_regionkey").cast("string")).alias("k"), spec.alias("s"))
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "s")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return I.flatten_vocabulary(I.read_specs(t.spark, path))


@query("src07_condition_extract", "SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand")
def condition_extract(t):
    return t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))


@query("src08_src09_jsonl", "SELECT item_id, length(text) AS n FROM benchmark")
def jsonl(t):
    path = _scratch(t, "jsonl")
    t.benchmark.write.json(path)
    return t.spark.read.schema("item_id bigint, text string").json(path).select("item_id", F.length("text").alias("n"))


@query("src10_embedding_checks", "SELECT count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS broken, count(*) FILTER (list_dot_product(embedding, embedding) = 0) AS zero FROM embeddings")
def embeddings(t):
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return t.embeddings.agg(N.alias("n"), F.count_if(bad).alias("broken"), F.count_if(X.dot(F.col("embedding"), F.col("embedding")) == 0).alias("zero"))


@query("src11_bundle_manifest")
def bundle(t):
    path = _scratch(t, "bundle")
    t.benchmark.write.parquet(path)
    return I.manifest(t.spark, f"{path}/*.parquet")


@query("src12_referential_checks", """WITH v AS (SELECT count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wrong FROM embeddings), p AS (SELECT count(*) AS n FROM labels)
    SELECT 'counts differ by' AS "check", abs(p.n - v.n) AS problems FROM p, v UNION ALL SELECT 'vectors of another size', wrong FROM v UNION ALL SELECT 'passages without an article', count(*) FILTER (d.doc_id IS NULL) FROM labels l LEFT JOIN documents d USING (doc_id)
    UNION ALL SELECT 'passages without a vector', count(*) FILTER (e.vec_id IS NULL) FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id""")
def referential(t):
    """Labelled documents as passages, their documents as articles, the embeddings as vectors."""
    return I.bundle_problems(t.labels, t.documents, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "doc_id", "embedding", 64)


@query("src13_multi_csv_reader", r"SELECT 'customer' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def multi_csv(t):
    path = _scratch(t, "multi")
    out = None
    for kind, df, k in (("customer", t.customer, "c_nationkey"), ("supplier", t.supplier, "s_nationkey")):
        df.select(F.col(k).alias("k")).write.option("header", True).csv(f"{path}/{kind}")
        rows = I.read_csv(t.spark, f"{path}/{kind}", "k int").join(t.nation, F.col("k") == F.col("n_nationkey")).select(F.lit(kind).alias("kind"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("kind").agg(N.alias("n"))


@query("src14_property_graph_store", f"WITH {S.PRI}, {S.CASES}, {S.TOK}, {S.EDGES} SELECT count(*) AS edges, true AS same FROM edges")
def graph_store(t):
    e = S.edges(t)
    nodes = e.select(F.col("concept_id").alias("id")).distinct()
    read_back = I.save_graph(nodes, e, _scratch(t, "graph"))
    return e.agg(N.alias("edges")).withColumn("same", F.lit(read_back == I.fingerprint(e)))


@query("src15_graph_codec", f"WITH {S.PRI}, {S.CASES}, {S.TOK}, {S.EDGES} SELECT condition_id, concept_id, source, weight FROM edges")
def graph_codec(t):
    rows = I.to_rows(S.edges(t))
    schema = "condition_id string, concept_id string, source string, weight double"
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


@query("src17_resumable_fetch", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumable(t):
    return I.pending(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query("src18_article_parse")
def article_parse(t):
    return I.parse_articles(t.pages, "page_id", "html")


@query("src20_spreadsheet_safe", r"SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') THEN ' ' || cell ELSE cell END AS cell FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN '=' || event_type ELSE event_type END AS cell FROM events)")
def spreadsheet_safe(t):
    cell = F.when(F.col("event_type") == "click", F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return t.events.select("event_id", I.guarded(cell).alias("cell"))


@query("src16_paged_source", "SELECT page_id, url, length(html) AS signs FROM pages")
def paged(t):
    """The pages table saved as pages of JSON lines, and read by the paged source, which keeps what it has fetched."""
    path = _scratch(t, "paged")
    t.pages.select("page_id", "url", F.length("html").alias("signs")).repartition(24, "page_id").write.option("ignoreNullFields", False).json(f"{path}/saved")
    t.spark.dataSource.register(PagedSource)
    return t.spark.read.format("paged").schema("page_id bigint, url string, signs int").options(folder=f"{path}/saved", kept=f"{path}/kept", pagesPerTask="4").load().withColumn("signs", F.col("signs").cast("bigint"))


@query("rt26_open_bundle", "SELECT 'benchmark' AS name, count(*) AS rows, NULL AS reason FROM benchmark UNION ALL SELECT 'labels', 0, 'part missing' UNION ALL SELECT 'documents', 0, 'not in the manifest' UNION ALL SELECT 'conversations', 0, 'another schema' UNION ALL SELECT 'elsewhere', 0, 'no bundle'")
def open_bundle(t):
    """A bundle of three tables, of which one loses its parts and one is asked for with another schema: what each opens to."""
    path = _scratch(t, "bundle")
    U.write_bundle({"benchmark": t.benchmark, "labels": t.labels, "conversations": t.conversations.select("conv_id", "turn")}, path)
    drop_folder(t.spark, f"{path}/labels")
    asked = [("benchmark", path, t.benchmark.schema), ("labels", path, t.labels.schema), ("documents", path, t.documents.schema), ("conversations", path, t.conversations.schema), ("elsewhere", f"{path}-none", t.benchmark.schema)]
    out = None
    for name, at, schema in asked:
        opened = U.open_table(t.spark, at, name.replace("elsewhere", "benchmark"), schema)
        one = opened.rows.agg(F.lit(name).alias("name"), N.alias("rows"), F.lit(opened.reason).cast("string").alias("reason"))
        out = one if out is None else out.union(one)
    return out


@query("op02_stage_timing")
def stage_timing(t):
    """Three runs of a query's stages, from evidence to scores: rows and percentiles of the seconds of each."""
    times = StageTimes(t.spark)
    for _ in range(3):
        own = Tables(t.spark, t.folder)
        for name, make in (("evidence", lambda: S.cases(own).join(S.token_sets(own), "case_id", "left")), ("edges", lambda: S.edges(own)), ("scores", lambda: S.kg_scores(own))):
            times.time(name, make, lambda df: df.write.format("noop").mode("overwrite").save())
    table = times.table()
    return latency(table, "stage", "seconds").join(table.groupBy("stage").agg(N.alias("runs"), F.max("rows").alias("rows")), "stage")
