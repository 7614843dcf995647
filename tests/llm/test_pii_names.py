"""Names: one person in every title and case, whole names, formats kept; against a plain dictionary."""

import random

import regex

from sextant.llm import pii

KEY = b"key"


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    return {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).collect()}


def test_one_name_in_every_title_and_case(spark):
    got = run(spark, ["Dr. Anna Schmidt met Frau Anna Schmidt.", "Mr JOHN SMITH and Mr John Smith", "Sra. María-José García López vino", "Prof. Anna Weber", "Herr von Berg und Frau Anna van der Meer", "Herr Kim Park, Frau Kim Park"])
    a = regex.fullmatch(r"Dr\. (\w+) (\w+) met Frau (\w+) (\w+)\.", got[0]).groups()
    assert a[:2] == a[2:] and a[0] != "Anna" and a[1] != "Schmidt" and a[0] in pii.FEMALE_NAMES
    b = regex.fullmatch(r"Mr (\w+) (\w+) and Mr (\w+) (\w+)", got[1]).groups()
    assert b[0] == b[2].upper() != b[2] and b[1] == b[3].upper() != b[3]
    c = regex.fullmatch(r"Sra\. (\w+)-(\w+) (\w+) (\w+) vino", got[2]).groups()
    assert not {"María", "José", "García", "López"} & set(c)
    assert regex.fullmatch(r"Prof\. (\w+) \w+", got[3])[1] == a[0]  # the same given name, though its title tells no gender
    d = regex.fullmatch(r"Herr von (\w+) und Frau (\w+) van der (\w+)", got[4]).groups()
    assert d[1] == a[0] and "Berg" not in d and "Meer" not in d
    e = regex.fullmatch(r"Herr (\w+) (\w+), Frau (\w+) (\w+)", got[5]).groups()
    assert e[:2] == e[2:] and e[0] in pii.OTHER_NAMES  # both genders: neither


def test_many_names_stay_apart_and_single(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice(["an", "be", "ka", "lo", "mi", "ru", "se"]) for _ in range(rng.randint(2, 4))).capitalize() for _ in range(600)})[:300]
    texts = [f"Frau {n} Huber, Herr {m} Huber, Frau {n.upper()} Huber" for n, m in zip(names[:150], names[150:])]
    got = run(spark, texts)
    seen = {}
    for i, (n, m) in enumerate(zip(names[:150], names[150:])):
        x = regex.fullmatch(r"Frau (\w+) (\w+), Herr (\w+) (\w+), Frau (\w+) (\w+)", got[i]).groups()
        assert x[4] == x[0].upper() and x[1] == x[3] == x[5]
        for old, new in ((n, x[0]), (m, x[2])):
            assert seen.setdefault(old, new) == new
    assert len(set(seen.values())) == len(names) and not {v.lower() for v in seen.values()} & {n.lower() for n in names}
    assert max(map(len, seen.values())) <= 12


def test_every_text_is_its_dictionarys(spark):
    """The whole corpus by a plain loop: entities gathered, genders resolved, surrogates dealt in rounds, texts rebuilt."""
    rng = random.Random(5)
    people = [(rng.choice(["Ada", "Bob", "Cleo", "Dag", "Eva", "Finn", "Gil"]), rng.choice(["Stone", "Rivers", "Marsh", "Field"])) for _ in range(40)]
    texts = []
    for i in range(120):
        g, s = rng.choice(people)
        t = rng.choice(["Mr", "Mrs", "Dr", "Frau", "Herr"])
        texts.append(rng.choice([f"{t}. {g} {s} wrote to {g.lower()}.{s.lower()}@mail.example.com.", f"{t} {s} called +49 30 {rng.randint(100000, 999999)}; {s} again", f"{t} {g.upper()} {s.upper()}", "nothing here", "", f"{t} {g} {s} and {g} {s}, {s}"]))
    found = {p[:2] for x in texts for e in pii.spans(x) for p in e.parts if p[0] != "initial"}
    kinds = {}
    for k, v in found:
        if k in pii.GIVEN:
            kinds.setdefault(v, set()).add(k)

    def final(k, v):
        told = kinds.get(v, set()) & {"male", "female"} if k in pii.GIVEN else None
        return k if told is None else told.pop() if len(told) == 1 else "person"

    todo, settled, attempt = sorted({(final(k, v), v) for k, v in found}), {}, 0
    own = {v for _, v in found}
    while todo:
        by = {}
        for e in todo:
            by.setdefault(pii.surrogate(KEY, *e, attempt), []).append(e)
        for made, some in by.items():
            if made not in own and made not in settled.values():
                settled[min(some)] = made
        todo, attempt = [e for e in todo if e not in settled], attempt + 1
    assert attempt > 1
    got = run(spark, texts)
    for i, x in enumerate(texts):
        out, at = [], 0
        for k, v, a, b in (p for e in pii.spans(x) for p in e.parts):
            out += [x[at:a], pii.render(final(k, v), x[a:b], settled[final(k, v), v])]
            at = b
        assert got[i] == "".join([*out, x[at:]])
