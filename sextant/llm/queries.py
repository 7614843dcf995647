"""The registered query of each operator of this subpackage, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import packing, warc
from sextant.llm.common import table_path
from sextant.llm.decontaminate import contaminated
from sextant.llm.divergence import audit
from sextant.llm.exact_dedup import DigestIndex, dedup_digests, digests
from sextant.llm.fill_in_middle import fill_in_middle, restored
from sextant.llm.labelled import fold
from sextant.llm.licences import licences
from sextant.llm.lm_score import lm_scores
from sextant.llm.pii import pseudonymise
from sextant.llm.quality import fit_quality, score_texts
from sextant.llm.simhash import hex16, near_duplicates
from sextant.llm.token_counts import token_counts
from sextant.llm.toxicity import fit_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


#: The end-of-text id of that vocabulary.
END_OF_TEXT = 49407


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)


def _scored(docs: DataFrame, model, folds: int, held_out: int) -> DataFrame:
    out = score_texts(docs, model)
    return out.select("doc_id", (fold(folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), fold(3) != 1)
    return _scored(docs, model, 3, 1)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences(_table(spark, sf_dir, "documents"), "doc_id", path)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), key=b"a key that each deployment replaces")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table goes through an index of its own in two batches, the lower ids first, so that the later ones meet the earlier ones there."""
    docs = _table(spark, sf_dir, "documents")
    rows = digests(docs)
    ends = rows.agg(F.min("id"), F.max("id")).first()
    middle = F.lit(((ends[0] or 0) + (ends[1] or 0)) // 2)
    index = DigestIndex.fresh(spark, docs.schema["doc_id"].dataType.simpleString())
    out = dedup_digests([rows.where(F.col("id") <= middle), rows.where((F.col("id") > middle) | F.col("id").isNull())], index)
    index.drop()
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def warc_round_trip(pages: DataFrame, between: Callable[[str], None] = lambda folder: None) -> tuple[DataFrame, DataFrame]:
    """Pages as their archives give them back, and the gaps that were quarantined; between may change the archives."""
    spark, folder = pages.sparkSession, table_path(pages.sparkSession, "warc")
    archives = warc.write_archives(pages, folder)
    between(folder)
    records, gaps = warc.salvage(spark, folder, archives)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")), gaps


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, gaps = warc_round_trip(_table(spark, sf_dir, "pages"))
    lost = gaps.first()
    if lost is not None:
        raise RuntimeError(f"the archives were damaged on their way: {lost}")
    return pages


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces.drop("ids")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    return _scored(docs, model, 5, 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to six decimals, since the order of a sum shows in the last digits."""
    out = lm_scores(_table(spark, sf_dir, "documents"), fold(7) != 2)
    return out.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", *[F.round(c, 6).alias(c) for c in ("base_score", "score")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_licence_scan": op3_licence_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc_salvage": op9_warc_salvage,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lm_scores": op13_lm_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op9_warc_salvage": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT page_id, octet_length(b) AS n, h, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM q""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS doc FROM documents),
        o AS (SELECT lang, source, doc, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
        x AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS p FROM x WINDOW w AS (PARTITION BY lang, source)),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS q FROM k WINDOW w AS (PARTITION BY lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
    "op12_fill_in_middle": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        c AS (SELECT *, len(u) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM h),
        p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
        x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
    "op13_lm_scores": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id,
            list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
            [''] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS ws FROM documents),
        f AS (SELECT doc, doc_id, xor(crc, 4294967295) % 7 AS fold, ws FROM d),
        t AS (SELECT doc, coalesce(fold <> 2, false) AS learn, unnest(ws[:len(ws) - 1]) AS h, unnest(ws[2:]) AS w FROM f),
        u AS (SELECT w, count(*) AS c FROM t WHERE learn GROUP BY w),
        b AS (SELECT h, w, count(*) AS c FROM t WHERE learn GROUP BY ALL),
        a AS (SELECT h, sum(c) AS c FROM b GROUP BY h),
        z AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM u),
        p AS (SELECT doc, u.c IS NOT NULL AS known, (coalesce(u.c, 0) + 1) / (n + v + 1) AS p1, a.c AS ch, coalesce(b.c, 0) AS cb, n
            FROM t CROSS JOIN z LEFT JOIN u ON u.w = t.w LEFT JOIN a ON a.h = t.h LEFT JOIN b ON b.h = t.h AND b.w = t.w)
        SELECT doc_id, fold = 2 AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
            round(sum(log10(p1)), 6) AS base_score, round(sum(log10(CASE WHEN ch > 0 THEN 0.5::DOUBLE * cb / ch + 0.5::DOUBLE * p1 ELSE p1 END)), 6) AS score
        FROM p JOIN f USING (doc) GROUP BY doc, doc_id, fold""",
}
