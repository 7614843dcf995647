"""Bundles with damage, paged reading with failures, and stage times."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from sextant.operators.timing import StageTimes, StreamTimes, latency
from sextant.sources import bundles as U
from sextant.sources import paged as P


@pytest.fixture
def bundle(spark, tmp_path):
    table = spark.range(400).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(4)
    path = str(tmp_path / "bundle")
    U.write_bundle({"passages": table, "labels": table.select("id")}, path, "print-1")
    return spark, path, table.schema


def parts(path, name="passages"):
    from pathlib import Path

    return sorted(Path(path, name).glob("part-*"))


def test_a_whole_bundle_opens(bundle):
    spark, path, schema = bundle
    opened = U.open_table(spark, path, "passages", schema, "print-1")
    assert opened.reason is None and not opened.degraded and opened.rows.count() == 400
    assert U.open_table(spark, path, "labels", "id bigint").rows.count() == 400


@pytest.mark.parametrize("damage", ["missing", "truncated", "edited", "added", "folder", "no manifest", "no bundle", "schema", "fingerprint", "absent", "manifest"])
def test_damage_opens_an_empty_table_with_a_reason(bundle, damage):
    import shutil
    from pathlib import Path

    spark, path, schema = bundle
    some = parts(path)[1]
    name, asked, fingerprint = "passages", schema, "print-1"
    if damage == "missing":
        some.unlink()
    elif damage == "truncated":
        some.write_bytes(some.read_bytes()[:-10])
    elif damage == "edited":
        body = bytearray(some.read_bytes())
        body[len(body) // 2] ^= 1
        some.write_bytes(bytes(body))
    elif damage == "added":
        shutil.copy(some, some.with_name("part-99999-more.parquet"))
    elif damage == "folder":
        Path(path, "passages").rename(Path(path, "gone"))
    elif damage == "no manifest":
        Path(path, "manifest").rename(Path(path, "gone"))
    elif damage == "no bundle":
        path += "-none"
    elif damage == "schema":
        asked = "id string, text string"
    elif damage == "fingerprint":
        fingerprint = "print-2"
    elif damage == "absent":
        name = "vectors"
    else:
        for p in parts(path, "manifest"):
            p.write_text(p.read_text().replace("sha256", "sha"))
    for crc in Path(path, "passages").glob(".*.crc") if Path(path, "passages").exists() else ():
        crc.unlink()
    for crc in Path(path, "manifest").glob(".*.crc") if Path(path, "manifest").exists() else ():
        crc.unlink()
    opened = U.open_table(spark, path, name, asked, fingerprint)
    want = {"missing": "part missing", "truncated": "part damaged", "edited": "part damaged", "added": "part not in the manifest", "folder": "part missing", "schema": "another schema", "fingerprint": "another fingerprint", "absent": "not in the manifest", "manifest": "manifest damaged"}
    assert opened.reason == want.get(damage, damage) and opened.degraded
    assert opened.rows.collect() == [] and len(opened.rows.columns) == 2


def save(folder, pages):
    folder.mkdir()
    for i, rows in enumerate(pages):
        (folder / f"page-{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def failing(counts, times):
    """A fetch that fails so many times for each page, and counts what it gave."""
    lock = threading.Lock()

    def fetch(folder, name):
        with lock:
            tried, given = counts.get(name, (0, 0))
            counts[name] = (tried + 1, given + (tried >= times))
        if tried < times:
            raise P.PageError("try again")
        return P.saved_page(folder, name)

    return fetch


def test_failed_pages_are_tried_again_and_fetched_once(tmp_path):
    save(tmp_path / "saved", [[{"id": i}] for i in range(6)])
    counts, kept = {}, str(tmp_path / "kept")
    fetch = failing(counts, 2)
    for _ in range(2):  # the second run finds all pages kept
        for i in range(6):
            assert json.loads(P.fetched(fetch, str(tmp_path / "saved"), f"page-{i:03}.json", kept, pause=0.001)) == {"id": i}
    assert set(counts.values()) == {(3, 1)}
    with pytest.raises(P.PageError):
        P.fetched(failing({}, 9), str(tmp_path / "saved"), "page-000.json", None, tries=3, pause=0.001)
    with pytest.raises(P.PageError):
        P.fetched(P.saved_page, str(tmp_path / "saved"), "none.json", None, tries=2, pause=0.001)


def test_the_source_reads_each_page_once_and_resumes(spark, tmp_path):
    """A run that breaks off at a page that isn't there yet; the next one fetches only what is missing."""
    pages = [[{"id": 10 * i + j, "text": f"t{j}" if j else None, "more": 1} for j in range(i % 4)] for i in range(20)]
    save(tmp_path / "saved", pages)
    spark.dataSource.register(P.PagedSource)

    def read():
        return spark.read.format("paged").schema("id bigint, text string").options(folder=str(tmp_path / "saved"), kept=f"file://{tmp_path}/kept", pagesPerTask="3", tries="1").load()

    broken = tmp_path / "saved" / "page-007.json"
    whole = broken.read_bytes()
    broken.write_bytes(b"{not json\n")
    with pytest.raises(Exception, match="(?i)json|expecting"):
        read().collect()
    broken.write_bytes(whole)
    (tmp_path / "kept" / "page-007.json").unlink()
    for p in (tmp_path / "kept").iterdir():  # kept pages are not fetched again: the saved ones may be gone
        (tmp_path / "saved" / p.name).write_bytes(b"{}\n")
    want = sorted((r["id"], r["text"]) for p in pages for r in p)
    assert sorted(map(tuple, read().collect())) == want
    assert not list((tmp_path / "kept").glob("*.part"))
    (tmp_path / "empty").mkdir()
    assert spark.read.format("paged").schema("id bigint").options(folder=str(tmp_path / "empty")).load().collect() == []


def test_stage_times_count_rows_and_runs(spark, tmp_path):
    times = StageTimes(spark)
    for i in range(4):
        times.time("write", lambda: spark.range(70, numPartitions=3), lambda df, i=i: df.write.parquet(str(tmp_path / f"o{i}")))
    rows = times.table().collect()
    assert [(r.stage, r.run, r.rows) for r in rows] == [("write", i, 70) for i in range(4)] and all(r.seconds > 0 for r in rows)
    found = latency(times.table(), "stage", "seconds").first()
    assert found.p50 <= found.p95 <= found.p99 <= found.most + 1e-6


def test_stream_times_gather_phases(spark, tmp_path):
    times = StageTimes(spark)
    listener = StreamTimes(times)
    spark.streams.addListener(listener)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.queryName("timed").format("memory").trigger(availableNow=True).start()
        stream.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    stages = {r[0]: r[3] for r in times.rows}
    assert stages["timed.addBatch"] == 30 and "timed.triggerExecution" in stages
