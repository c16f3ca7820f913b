import hashlib
import random

import pytest

WORDS = "alpha beta gamma delta eins zwei drei été niño straße the of and in to x1 ! ?? Ünder 北京 мир".split()


def random_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, shared passages, repeats inside a document, NULLs, empty and long texts."""
    rng = random.Random(7)
    passages = [random_text(rng, 40) for _ in range(6)]
    rows = []
    for i in range(120):
        body = [random_text(rng, rng.randrange(0, 60)) for _ in range(3)]
        if i % 3 == 0:
            body.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i, " ".join(body)))
    for i in range(12):
        rows.append((200 + i, rows[3][1]))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "x" * 5000), (304, "ab " * 3000), (305, random_text(rng, 20000)),
             (306, random_text(rng, 300) + rows[7][1]), (None, rows[5][1]), (None, "null id " * 30), (307, "one"),
             (308, "\x00\x01 zero"), (3, rows[3][1]), (309, rows[3][1].upper())]
    rows.append(rows[9])
    rows.append((310, passages[0] * 3))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The rows with extra columns whose names clash with internal ones."""
    rows = [(d, t, "en", "s", len(t or ""), i, "q", -1) for i, (d, t) in enumerate(corpus)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, order_id int, anchor string, rid int"
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
