import random

import pytest

from marketday.llm.common import ready

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, slot string, kept string, n int, r1 string, label int"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    return ready(spark)


def words(rng, n):
    return " ".join(rng.choice("al be co du el fa go hi ir jo ka lu me no or pe qu ra si tu".split()) + str(rng.randint(0, 400)) for _ in range(n))


def texts():
    """Plain texts, near and exact copies, a shared passage, repeated lines, nulls, empty, short and long ones."""
    rng = random.Random(11)
    passage = words(rng, 60)
    out = [words(rng, rng.randint(5, 120)) for _ in range(30)]
    out += [out[0]] * 4 + [out[1] + " end"] * 2
    for i in range(12):  # near copies of a long text
        w = words(random.Random(3), 150).split()
        w[i * 7] = "changed"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)}\nCommon Line \n{passage}\n{words(rng, 15)}" for _ in range(12)]
    out += [None, None, "", "", " ", "\n\n", "one", "ONE", "two words", words(rng, 6000), "ab" * 600, "ÄÖ é   漢字 🙂 'S don't \x00 x"]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text); an id twice with different texts, a row twice, ids that are null."""
    out = list(enumerate(texts()))
    return [*out, (3, "another text under a known id"), out[5], out[5], (None, "text without an id"), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", 2, "d", 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
