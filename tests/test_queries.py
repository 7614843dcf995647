"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from sextant.plans import registry

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in TABLES.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 5):.8g}" if float(v) != int(v) else str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def rows_of(name):
    return pq.read_table(TABLES / f"{name}.parquet").to_pylist()


def priorities():
    """(share, hit) of every case and condition, as the stand-in scores them."""
    by, cases = {}, []
    for o in rows_of("orders"):
        by.setdefault(o["o_custkey"], []).append(o["o_orderpriority"])
        cases.append((o["o_custkey"], o["o_orderpriority"]))
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return [(by[c].count(k) / len(by[c]), k == true) for c, true in cases for k in kinds]


def platt_holds(r):
    """No other a and b has a smaller loss: its gradient is nothing."""
    p, y = map(np.array, zip(*priorities()))
    x, pos = np.log(np.maximum(p, 1e-9)), y.sum()
    q = 1 / (1 + np.exp(-(r[0].a + r[0].b * x)))
    g = q - np.where(y, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    return len(r) == 1 and abs(g.sum()) < 1e-3 and abs((g * x).sum()) < 1e-3


def manifest_holds(r):
    """The one digest that the parts of the same table have, written anew, isn't known; names, sizes and digests are."""
    return len({x.name for x in r}) == len(r) and all(x.bytes > 0 and re.fullmatch("[0-9a-f]{64}", x.sha256) and x.name.endswith(".parquet") for x in r)


def articles_hold(r):
    """Titles and paragraphs by a parser of its own."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.title, self.paragraphs, self.skip, self.at = None, [], 0, None

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "nav", "footer", "aside")
            if tag == "p" and not self.skip:
                self.paragraphs.append("")
            if tag in ("p", "title"):
                self.at = tag

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "nav", "footer", "aside")
            self.at = None if tag in ("p", "title") else self.at

        def handle_data(self, data):
            if self.at == "title" and not self.skip:
                self.title = (self.title or "") + data
            elif self.at == "p" and not self.skip and self.paragraphs:
                self.paragraphs[-1] += data

    want = {}
    for p in rows_of("pages"):
        reader = Reader()
        reader.feed(p["html"] or "")
        want[p["page_id"]] = (reader.title and reader.title.strip(), len(reader.paragraphs))
    titles = {x.id: x.title for x in r}
    same = sum(titles[k] == v[0] for k, v in want.items())
    return set(titles) == set(want) and same >= 0.95 * len(want)


def forest_holds(r):
    """Importances of all features, none negative, adding up to one."""
    return sorted(x.feature for x in r) == ["l_discount", "l_quantity", "l_tax"] and all(x.importance >= 0 for x in r) and abs(sum(x.importance for x in r) - 1) < 1e-9


def boosted_holds(r):
    """Every node that splits has two children, leaves have values, and the loss falls below that of equal chances."""
    at = {(x["round"], x["class"], x.node): x for x in r}
    split = [k for k, x in at.items() if x.feature is not None]
    return split and all((a, c, 2 * n) in at and (a, c, 2 * n + 1) in at for a, c, n in split) and all((x.value is None) != (x.feature is None) for x in r) and min(x.watched_loss for x in r) < math.log(4)


def labels_hold(r):
    names = {p["p_name"] for p in rows_of("part")} | {p["p_type"].lower() for p in rows_of("part")} | {n["n_name"].lower() for n in rows_of("nation")}
    want = {(a, b): round(v, 6) for a in names for b in names if a < b and (v := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.72}
    return {(x.a, x.b): x.ratio for x in r} == want


#: What holds for the queries that SQL can't express, by name.
HOLDS = {
    "fu08_platt_fit": platt_holds,
    "fu09_isotonic_fit": lambda r: len(r) > 1 and [x.value for x in sorted(r, key=lambda x: x.low)] == sorted(x.value for x in r),
    "ml08_multinomial_lr": lambda r: len(r) == len({x["class"] for x in r}) > 1 and all(len(x.coefficients) == 2 for x in r),
    "ml10_tree_ensemble": forest_holds,
    "ml10_boosted_trees": boosted_holds,
    "ml11_transformer_forward": lambda r: {x.vec_id for x in r} == {e["vec_id"] for e in rows_of("embeddings")} and all(len(x.logits) == 5 and all(map(math.isfinite, x.logits)) for x in r) and len({tuple(x.logits) for x in r}) > len(r) / 2,
    "src11_bundle_manifest": manifest_holds,
    "src18_article_parse": articles_hold,
    "jn20_sequence_ratio": labels_hold,
    "st01_exact_bootstrap": lambda r: len(r) == 15 and all(x.low < x.value < x.high for x in r),
    "st04_exact_differences": lambda r: len(r) == 3 and all(x.low <= x.value <= x.high and x.excludes_zero == (x.better != "neither") for x in r),
    "op02_stage_timing": lambda r: {x.stage: (x.runs, x.rows > 0, x.p50 > 0) for x in r} == dict.fromkeys(["evidence", "edges", "scores"], (3, True, True)),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    got = QUERIES[name](spark, str(TABLES)).collect()
    assert got and HOLDS[name](got)
