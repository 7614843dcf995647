"""Rows that share an id or have none: every stage decides row by row."""

import pytest
from pyspark.sql import functions as F

from sextant.llm.decontaminate import clean, contaminated, with_matches
from sextant.llm.packing import pack
from sextant.llm.row_keys import with_row_key

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_keys_are_distinct_and_single_ids_keep_theirs(spark, tmp_path, nasty, none):
    rows = [(1, "a"), (3, "a"), (3, "b"), (None, "a"), (None, "a"), (5, "d"), (5, "d"), (-(2**63), "x"), (2**63 - 1, "y")]
    for docs in (table(spark, tmp_path, rows), nasty, spark.createDataFrame(rows[:-1], "_file long, _key string").withColumnRenamed("_file", "doc_id").withColumn("_PLACE", F.lit(1))):
        keyed, key = with_row_key(docs)
        got = keyed.collect()
        assert keyed.columns == [*docs.columns, key] and len(got) == docs.count()
        keys = [r[key] for r in got]
        assert len(set(keys)) == len(keys) and None not in keys
        ids = [r.doc_id for r in got]
        assert all(r[key] == r.doc_id for r in got if ids.count(r.doc_id) == 1 and r.doc_id is not None)
        assert not {r[key] for r in got if ids.count(r.doc_id) > 1} & set(ids)
    keyed, key = with_row_key(none)
    assert keyed.collect() == []


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash_near_dedup"])
def test_a_stage_keeps_each_text_once(spark, tmp_path, make_prose, stage):
    long = make_prose(5, 80)
    rows = [(1, "a b"), (3, "a b"), (3, "unique c"), (None, "a b"), (None, "only null has it"), (5, "d"), (5, "d"), (9, long), (7, long), (7, None), (8, ""), (2, long)]
    docs = table(spark, tmp_path, rows)
    for given in (docs, spark.createDataFrame(docs.collect(), SCHEMA)):
        out = dict(corpus_pipeline.STAGES)[stage](spark, given, str(tmp_path))
        assert out.columns == docs.columns
        got = sorted((r.text or "", r.doc_id) for r in out.collect())
        assert [t for t, _ in got] == sorted({t or "" for _, t in rows})
        assert dict(got)["a b"] == 1 and dict(got)[long] == 2 and dict(got)[""] == 8
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where("false"), str(tmp_path)).collect() == []


def test_toxicity_drops_rows_not_ids(spark, tmp_path):
    bad = "vile slur hate " * 12
    rows = [(i, bad if i % 2 else "kind calm words " * 12) for i in range(60)]
    rows += [(100, bad), (100, "kind calm words " * 12), (None, bad), (None, "kind calm words " * 12)]
    docs = table(spark, tmp_path, rows)
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, [r.doc_id for r in got])) == sorted(map(repr, [i for i, t in rows if t != bad]))


def test_pack_keeps_other_columns_and_raises_on_its_own(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i % 9, i, i, i, i, i) for i in range(50)], "id long, piece int, start long, length long, _part long, _rank long, _within long, _before long, n long")
    out = pack(pieces, 10).collect()
    assert all(r._part == r._rank == r._within == r._before == r.n == r.id for r in out)
    for name in ("offset", "Sequence_ID"):
        with pytest.raises(ValueError, match="columns"):
            pack(pieces.withColumnRenamed("n", name), 10)


def test_blocks_of_items_find_what_one_block_finds(spark, make_prose):
    items = spark.createDataFrame([(i, make_prose(500 + i, 12)) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i % 70, make_prose(i, 30) + (" " + make_prose(500 + i % 60, 12) if i % 3 else "")) for i in range(90)], "doc_id long, text string")
    want = sorted(map(tuple, contaminated(docs, items).collect()))
    assert want and sorted(map(tuple, contaminated(docs, items, block_items=10).collect())) == want
    kept = [sorted(map(tuple, clean(docs, items, block_items=n).collect())) for n in (10, 1000)]
    assert kept[0] == kept[1] == sorted(tuple(r)[:2] for r in with_matches(docs, items, "m").where("size(m) = 0").collect())
    with pytest.raises(ValueError, match="has a column"):
        with_matches(docs.withColumn("Matches", F.lit(1)), items)
