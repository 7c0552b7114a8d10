from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string, kept string, epoch string, score string"


def make_text(rng: random.Random, n: int, common=("the", "of", "and", "to", "in", "a", "is", "that")) -> str:
    return " ".join(rng.choice(common) if rng.random() < 0.35 else "".join(rng.choice("abcdeorst") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with every awkward case: null, empty, blank, very long, copies, near copies, a null id."""
    rng = random.Random(7)
    base = [make_text(rng, rng.randint(60, 300)) for _ in range(30)]
    near = base[0].split()
    near[10] = "changed"
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, make_text(rng, 30_000)), (104, base[1]), (105, base[1]), (105, base[1]), (106, " ".join(near)), (107, "one"), (108, "Ünïcode ß wörds 漢字 " * 20), (None, base[2]), (109, "a" * 100_000), (110, "x y z " * 50)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with extra columns named like what operators return."""
    rows = [(i, t, ("en", "de", None, "xx")[k % 4], "hot" if k % 3 else (None if k % 2 else f"s{k % 5}"), None if t is None else len(t), "f", "n", "k", "e", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)
