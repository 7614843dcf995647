"""The registered queries against their SQL, and on rows that are meant to break them."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from sextant.llm.queries import ORACLE_SQL, QUERIES, op4_exact_dedup, warc_round_trip

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for p in TABLES.iterdir():
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(TABLES)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_exact_dedup_query_on_nasty_rows(spark, nasty, none, tmp_path):
    nasty.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = op4_exact_dedup(spark, f"{tmp_path}/a").collect()
    assert len(got) == nasty.count() and all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for some in by.values():
        assert {r.group_size for r in some} == {len(some)}
        assert {r.keep_id for r in some} == {min((r.doc_id for r in some if r.doc_id is not None), default=None)}
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op4_exact_dedup(spark, f"{tmp_path}/b").collect() == []


def test_warc_query_keeps_null_and_repeated_ids(spark):
    big = "z" * 3000
    data = [(None, "u", big), (1, None, big), (1, None, big), (2, "u", big), (2, "v", None), (None, None, None), (3, "", "")]
    got, gaps = warc_round_trip(spark.createDataFrame(data, "page_id long, url string, html string"))
    assert sorted(map(repr, got.select("page_id", "payload_bytes", "record_type", "refers_to").collect())) == sorted(
        f"Row(page_id={i}, payload_bytes={len(h or '')}, record_type='{t}', refers_to={r})" for (i, _, h), t, r in zip(data, ["revisit"] * 3 + ["response"] * 4, [2, 2, 2] + [None] * 4)
    )
    assert gaps.count() == 0
    empty, gaps = warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == gaps.count() == 0


def test_damage_on_the_way_is_logged_and_the_rest_kept(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(200)], "page_id long, url string, html string").coalesce(1)

    def spoil(folder):
        (path,) = Path(folder.removeprefix("file:")).glob("*.gz")
        data = bytearray(path.read_bytes())
        starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08\x00", bytes(data))]
        data[starts[50] + 60] ^= 0xFF
        data[starts[100] : starts[100]] = b"noise" * 5
        path.write_bytes(bytes(data[:-20]))

    got, gaps = warc_round_trip(pages, spoil)
    ids = sorted(r.page_id for r in got.collect())
    assert len(ids) == 198 and len(set(ids)) == 198
    assert gaps.count() == 3 and gaps.where("end > start").count() == 3
