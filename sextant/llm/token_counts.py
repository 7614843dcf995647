"""Token counts of documents by a separator scan of flat token files (operator 1).

The files hold little-endian unsigned 16-bit ids and nothing else: no index, no
lengths; a separator id ends each document. The scan cuts files into blocks that
tasks read on their own; each block finds its separators by one array
comparison, and a prefix scan over the blocks of a file gives every block the
number of documents before it and where the document running into it began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import ship, table_path, text_or_empty, text_slices, written
from sextant.llm.word_bpe import encoder

WIDTH = 2
#: Ids that one block of the scan holds.
BLOCK = 1 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path within it.

    s3a and s3n go by s3, dbfs by its mount on the workers. Any other scheme
    that pyarrow doesn't know, and a relative path, raise."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        if not path.startswith("/"):
            raise ValueError(f"not an absolute path: {path}")
        return pafs.LocalFileSystem(), path
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise docs into flat files under folder; (file, ordinal, id) tells which document is where.

    Each task attempt writes a file of its own; only the files that the written
    result names count, so repeated or lost tasks do no harm. The separator
    never comes out of a text: strings of special tokens are ordinary text here.
    Null texts count as empty: a separator alone."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, special_text=False).encode
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, at, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
        for batch in text_slices(batches):
            if out is None:
                out = store.open_output_stream(f"{base}/{name}")
            flat, starts = encode(batch.column(1).to_pylist())
            out.write(np.insert(flat, starts[1:], separator).astype("<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n)), batch.column(0)], ["file", "ordinal", "id"])
            at += n
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"file string, ordinal bigint, id {kind}"), "token-files")


def scan_token_files(spark: SparkSession, folder: str, files: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of each document in the named flat files.

    n_tokens leaves the separator out. Ids after a file's last separator are one
    more document with ended false; an empty file has none. files needs the
    column file; repeated names count once."""
    ship(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                n = store.get_file_info(f"{base}/{name}").size // WIDTH
                at = np.arange(0, n, block)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(np.minimum(block, n - at)), pa.array([n] * len(at), pa.int64())], ["file", "at", "n", "total"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(r["n"] * WIDTH, r["at"] * WIDTH), "<u2")
                ends = np.flatnonzero(ids == separator) + r["at"]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["at"]]), pa.array([r["n"]]), pa.array([r["total"]]), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "at", "n", "total", "ends"])

    listed = files.select("file").distinct().mapInArrow(blocks, "file string, at bigint, n bigint, total bigint")
    found = written(listed.repartition(F.col("file"), F.col("at")).mapInArrow(find, "file string, at bigint, n bigint, total bigint, ends array<bigint>"), "token-blocks")
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select("file", "at", "n", "total", F.size("ends").alias("k"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    stitched = marks.select("file", "at", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("carry"))
    each = found.join(stitched, ["file", "at"])
    # a block's document starts: what runs into it, then one past each of its separators but the last
    starts = F.concat(F.array("carry"), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    rows = each.where(F.size("ends") > 0).select("file", "base", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "x"))
    ended = rows.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = each.where(F.col("at") + F.col("n") == F.col("total")).select("file", (F.col("base") + F.size("ends")).alias("ordinal"), F.when(F.size("ends") > 0, F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) + 1).otherwise(F.col("carry")).alias("start"), "total")
    tail = tail.where("start < total").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(tail)


def token_counts(docs: DataFrame, tokenizer_path: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_tokens) of each row of docs, counted back from flat files of all of them."""
    spark = docs.sparkSession
    folder = table_path(spark, "flat-tokens")
    where = write_token_files(docs, folder, tokenizer_path, separator, id_col, text_col)
    spans = scan_token_files(spark, folder, where, separator, block)
    return where.join(spans, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
