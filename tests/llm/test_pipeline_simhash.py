"""The pipeline's near-duplicate stage goes by SimHash, then by the shingles themselves."""

import random

import pytest

from sextant.llm.shingle_join import jaccard, shingle_sets
from sextant.llm.simhash import fingerprint

pipeline = pytest.importorskip("corpus_pipeline")


def distance(a, b):
    return bin(fingerprint(a.encode(), 4) ^ fingerprint(b.encode(), 4)).count("1")


def test_stage_drops_what_simhash_links_and_what_it_misses(spark):
    rng = random.Random(7)
    drawn = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    # many edits spread out: few five-word shingles in common, yet repeated lines keep the fingerprint
    line = " ".join(f"r{i}" for i in range(7))
    repeated = " ".join([line] * 100)
    linked = (repeated + " " + " ".join(drawn[:12]), repeated + " " + " ".join(drawn[20:32]))
    changed = drawn.copy()
    for i in (50, 120, 190, 260, 330):
        changed[i] = "x"
    missed = (" ".join(drawn), " ".join(changed))
    sets = [shingle_sets(list(p), 5) for p in (linked, missed)]
    assert distance(*linked) <= 4 and jaccard(*sets[0]) < 0.8
    assert distance(*missed) > 4 and jaccard(*sets[1]) >= 0.8
    texts = [*linked, *missed, "alone and unlike the others here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pipeline.simhash_near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 4]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from sextant.llm import simhash

    seen, conf = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    for module in (simhash, pipeline):
        monkeypatch.setattr(module, "written", lambda df, label, f=module.written: seen.setdefault(label, int(spark.conf.get(conf))) and f(df, label))
    before = spark.conf.get(conf)
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(5)], "doc_id long, text string")
    monkeypatch.setattr(pipeline, "fit_toxicity", lambda *_: Half())
    monkeypatch.setattr(pipeline, "score_texts", lambda docs, model, key: docs.select(key, model.score().alias("score")))
    spark_read = type("T", (), {"read": type("R", (), {"parquet": staticmethod(lambda path: None)})})
    monkeypatch.setattr(pipeline, "small_batches", lambda _, rows: simhash.small_batches(spark, rows))
    assert pipeline.toxicity(spark_read, df, "").count() == 5
    assert simhash.near_duplicates(df).count() == 5
    assert seen["dropped"] <= 1000 and seen["fingerprints"] <= 1000 and spark.conf.get(conf) == before


class Half:
    def score(self):
        from pyspark.sql import functions as F

        return F.lit(0.25)
