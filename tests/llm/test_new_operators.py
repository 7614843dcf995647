"""Divergence audit, fill-in-middle and language-model scores against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.llm.divergence import audit
from sextant.llm.fill_in_middle import fill_in_middle, restored
from sextant.llm.labelled import fold
from sextant.llm.lm_score import lm_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(doc_id, text):
    """Units, form and output of one text, by the contract's words."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_the_plain_version(spark, nasty, make_prose):
    odd = ["<P>", "a<S", "<<S>", "P><M", "é<M", "<S><S", "日本 語", "😀😀", "<", "ab" * 400_001, "É<P"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*odd, *(make_prose(i, 3 * i) for i in range(200))])], "doc_id long, text string")
    docs = nasty.select("doc_id", "text").union(more)
    out = fill_in_middle(docs.repartition(3)).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    rows = docs.collect()
    want = sorted(((i, *cut(i, t), t or "") for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=repr)
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_ignores_clashing_columns_and_empty_tables(nasty, none):
    assert fill_in_middle(none).collect() == []
    assert fill_in_middle(nasty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def diverged(rows, least, top):
    """The audit by its definition: every kept term of every pair."""
    terms = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, la, s in rows]
    out = []
    for lang in {x[0] for x in terms}:
        df = Counter(w for la, _, ts in terms if la == lang for w in set(ts))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        whole = Counter()
        for la, s, ts in terms:
            if la == lang:
                counts[s].update(w for w in ts if df[w] >= least)
                whole.update(w for w in ts if df[w] >= least)

        def p(c, w, kept=kept):
            return 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in counts:
            pairs = sorted((-sum(f(p(counts[s], w), p(counts[o], w)) for w in kept), o.encode()) for o in counts if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            own = [(-f(p(counts[s], w), p(whole, w)), w.encode()) for w in kept if counts[s][w] and p(counts[s], w) > p(whole, w)]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def test_divergence_equals_the_definition(spark, make_prose):
    rows = [(make_prose(i % 40, 12 + i % 5) + " Ünï ünï ÉÉ 日本-x", ["en", "de", None, "xx"][i % 4], ["a", "b", None, "é", "zz"][i * i % 5]) for i in range(160)]
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("12 34", "fr", "b"), ("once", "fr", "c"), *[("same words", "tie", s) for s in ("q", "r", "é", "😀")] * 2]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "text string, lang string, source string, total long, term string")
    for least, top in ((3, 10), (10, 2)):
        got = sorted(tuple(r) for r in audit(docs.repartition(3), least, top).collect())
        assert got == diverged(rows, least, top)
    assert any(r[0] == "fr" and r[2] == "pair" and r[4] == 0 for r in got)
    assert audit(docs.where("false")).collect() == []


def modelled(rows, learn, order, share):
    """Scores by dictionaries: {row: (n_tokens, n_known, base, score)}, and the number of training tokens."""
    texts = [["<b>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "<e>"] for _, t in rows]
    grams, after = Counter(), Counter()
    for ws, (i, _) in zip(texts, rows):
        if learn(i):
            for k in range(1, order + 1):
                for j in range(1, len(ws)):
                    if j - k + 1 >= 0:
                        grams[tuple(ws[j - k + 1 : j + 1])] += 1
                        after[tuple(ws[j - k + 1 : j])] += 1
    n, v = after[()], sum(len(g) == 1 for g in grams)

    def p(h, w):
        if not h:
            return (grams[(w,)] + 1) / (n + v + 1)
        lower = p(h[1:], w)
        return (1 - share) * grams[(*h, w)] / after[h] + share * lower if after[h] else lower

    out = []
    for ws, (i, _) in zip(texts, rows):
        base = sum(math.log10(p((), w)) for w in ws[1:])
        score = sum(math.log10(p(tuple(ws[max(0, j - order + 1) : j]), ws[j])) for j in range(1, len(ws)))
        out.append((i, len(ws) - 1, sum(grams[(w,)] > 0 for w in ws[1:]), n, round(base, 6), round(score, 6)))
    return out, p, {g[0] for g in grams if len(g) == 1}, {h for h in after if h}


@pytest.mark.parametrize(("order", "slice_bytes", "bucket_grams", "parts"), [(1, 10**7, 10**6, 2), (2, 10**7, 10**6, 1), (2, 900, 700, 4), (3, 900, 50, 3), (4, 10**7, 10**6, 2)])
def test_scores_equal_dictionaries(spark, nasty, make_prose, order, slice_bytes, bucket_grams, parts):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    rows += [(20 + i, make_prose(i % 30, 5 + i % 60)) for i in range(120)] + [(300, "A\x0bB\xa0c É"), (301, "ends"), (302, "withends"), (303, "  ")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, slice string").repartition(parts)
    got = lm_scores(docs, fold(7) != 2, order, 0.4, slice_bytes=slice_bytes, bucket_grams=bucket_grams).collect()
    want, p, words, histories = modelled(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2, order, 0.4)
    assert sorted(((*r[:4], round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    for h in [(), *sorted(histories)[:3]]:  # with the unknown word, all next words add up to one
        assert sum(p(h, w) for w in [*words, "<unknown>"]) == pytest.approx(1)


def test_scores_of_nothing_learned_and_empty_tables(spark, none):
    assert lm_scores(none, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    got = sorted(lm_scores(docs, F.lit(None).cast("boolean")).collect())
    assert [tuple(r) for r in got] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_the_model_beats_its_base_on_held_out_texts(spark, make_prose):
    docs = spark.createDataFrame([(i, make_prose(i % 300, 50)) for i in range(900)], "doc_id long, text string")
    out = lm_scores(docs, fold(7) != 2).where(fold(7) == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]
