"""Readers and writers: CSV, JSON lines, dimension files, bundles with manifests, property graphs, article XML."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.sources.shared import kept


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def sniff(head: bytes) -> tuple[str, str]:
    """Delimiter and encoding of a delimited file from its first bytes."""
    try:
        text, encoding = head.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = head.decode("cp1252", "replace"), "windows-1252"
    first = text.splitlines()[0] if text else ""
    return max([",", ";", "\t"], key=first.count), encoding


def guarded(cell: Column) -> Column:
    """A cell that spreadsheets won't take for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit(" "), cell)).otherwise(cell)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each code of a JSON dimension file {code: {data_type, default_value, ...}}."""
    text = spark.read.text(path, wholetext=True)
    entry = "map<string, struct<data_type:string, default_value:string, is_antecedent:boolean, possible_values:array<string>, question:string>>"
    return text.select(F.explode(F.from_json("value", entry)).alias("code", "s")).select("code", "s.*")


def flatten_vocabulary(specs: DataFrame, not_applicable: str = "V_11") -> DataFrame:
    """(code, value): the question of each code, value null, and a row for each of its answers."""
    questions = specs.select("code", F.lit(None).cast("string").alias("value"))
    answers = specs.select("code", F.explode("possible_values").alias("value")).where(F.col("value") != not_applicable)
    return questions.union(answers)


def to_rows(edges: DataFrame) -> DataFrame:
    """Edges as canonical JSON rows with an ordinal; empty properties are left out.

    Rows are sorted by ranges; a part's ordinals begin with the rows of the parts
    before it, so that only one count for each part is brought together."""
    row = F.to_json(F.struct(*sorted(edges.columns)))
    rows = kept(edges.select(row.alias("row")).orderBy("row").withColumn("_m", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_start"))
    return rows.join(F.broadcast(starts), "_part").select("row", (F.col("_start") + F.col("_m")).alias("ordinal"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Replace a graph at path and return the fingerprint of what was read back."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    return fingerprint(nodes.sparkSession.read.parquet(f"{path}/edges"))


def fingerprint(df: DataFrame) -> str:
    """SHA-256 over the rows' own digests, in whatever order they come: counts and sums of parts of the digests."""
    d = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(d, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    return hashlib.sha256("|".join(map(str, df.agg(F.count(F.lit(1)), *parts).first())).encode()).hexdigest()


def content_digest(rows: DataFrame, part: str) -> DataFrame:
    """(part, n, mixed, total): a digest of rows in whatever order they come, by one partial aggregate.

    mixed is the exclusive or of 60 bits of each row's MD5, total the sum of
    other 28 bits, so repeated rows count; rows are their columns as text, joined by bars."""
    d = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))
    bits = lambda a, n: F.conv(F.substring(d, a, n), 16, 10).cast("bigint")
    return rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(bits(1, 15)), F.lit(0)).alias("mixed"), F.coalesce(F.sum(bits(16, 7)), F.lit(0)).alias("total"))


def bundle_problems(passages: DataFrame, articles: DataFrame, vectors: DataFrame, link: str, passage: str, vector: str, size: int) -> DataFrame:
    """(check, problems): counts that differ, passages without their article, without their vector, vectors of another size."""
    counts = passages.agg(F.count(F.lit(1)).alias("p")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col(vector).isNull() | (F.size(vector) != size)).alias("wrong")))
    told = F.explode(F.array(F.struct(F.lit("counts differ by").alias("check"), F.abs(F.col("p") - F.col("v")).alias("problems")), F.struct(F.lit("vectors of another size").alias("check"), F.col("wrong").alias("problems")))).alias("e")
    out = counts.select(told).select("e.*")
    for name, other, key in (("passages without an article", articles, link), ("passages without a vector", vectors, passage)):
        out = out.union(passages.join(other.select(key).distinct(), key, "left_anti").agg(F.lit(name), F.count(F.lit(1))))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file of a bundle, hashed where the files are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumable fetch has still to do."""
    return plan.join(done, key, "left_anti")


def parse_articles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, paragraphs) of markup; scripts, styles and navigation are left out."""
    import re

    kind = pages.schema[id_col].dataType.simpleString()
    drop = re.compile(r"(?is)<(script|style|nav|footer|aside)\b.*?</\1\s*>")
    para = re.compile(r"(?is)<p\b[^>]*>(.*?)</p>")
    tag = re.compile(r"(?s)<[^>]*>")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html import unescape

        for pdf in parts:
            rows = []
            for key, html in pdf.itertuples(index=False):
                body = drop.sub(" ", html or "")
                title = re.search(r"(?is)<title\b[^>]*>(.*?)</title>", body)
                rows.append((key, unescape(tag.sub("", title[1])).strip() if title else None, [unescape(tag.sub("", p)).strip() for p in para.findall(body)]))
            yield pd.DataFrame(rows, columns=["id", "title", "paragraphs"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("h")).mapInPandas(run, f"id {kind}, title string, paragraphs array<string>")


def parse_jats(xml: str) -> list[tuple[str, str]]:
    """(section title, text) of an article's body; broken XML gives none."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    return [("".join(s.find("title").itertext()) if s.find("title") is not None else "", " ".join("".join(p.itertext()) for p in s.iter("p"))) for s in root.iter("sec")]
