import random

import pytest

WORDS = "the of and river stone cloud market signal orbit garden copper letter winter silent bridge harbour pepper violet engine marble".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty, very long, tied and repeated rows, and columns whose names operators use inside."""
    base = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, ""), (4, None), (5, " \t\n"), (6, prose(6, 30_000)), (None, prose(1, 60)), (None, None), (7, "x"), (8, prose(8, 80) + " tail"), (9, prose(8, 80)), (-4, "日本語 Σίσυφος 😀 it's"), (2**62, prose(1, 60) + " ")]
    rows = [(i, t, "a", None, 1.5, "z", 3, "q", None, "p") for i, t in base]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, fp string, score double, digest string, n int, _id string, matches string, length string")


@pytest.fixture(scope="session")
def none(nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")
