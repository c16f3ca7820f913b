"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenospark.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, size int, phrase long"


def phrases_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
        words = [w for w in re.split("[ \t]+", piece) if w]
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                yield tuple(words[i:i + n])


def plain(rows, least=10, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        f["und" if lang is None else lang].update(phrases_of(text))
    out = set()
    for lang, c in f.items():
        n, found = sum(x for p, x in c.items() if len(p) == 1), {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        scored = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = "New york the of and big Apple état 北京   x\x00y ... z-z".split(" ")
    text = lambda: "".join(rng.choice(words[: rng.choice([4, 13])]) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for _ in range(rng.randrange(0, 50)))
    out = [(i, text(), rng.choice(["en", "fr", None, "und", ""]), 1, 2) for i in range(300)]
    out += [(1, "rare pair here", "en", 0, 0)] * 9 + [(2, "just enough times", "fr", 0, 0)] * 10 + [(3, "w " * 300, "de", 0, 0)]
    return out + [(4, None, "en", 0, 0), (None, "", None, 0, 0), (5, " \t . ", "xx", 0, 0), (6, "L" * 50000 + " one", "en", 0, 0)]


@pytest.mark.parametrize("sampling", [{}, {"sample_every": 1, "sample_least": 1}, {"sample_every": 3, "sample_least": 10**6}])
def test_against_counting(spark, rows, sampling):
    got = co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), **sampling)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_top_and_empty(spark, rows, empty_documents):
    assert {tuple(r) for r in co.collocations(spark.createDataFrame(rows, SCHEMA), top=3).collect()} == plain(rows, top=3)
    assert co.collocations(empty_documents).count() == 0


def test_parts_lose_no_phrase():
    rng = random.Random(1)
    for limit in (8, 20, 64):
        for _ in range(200):
            text = "".join(rng.choice(["a", "bc", "é", " ", " ", "\t", ".", "\n", "word"][: rng.choice([6, 9])]) for _ in range(rng.randrange(150)))
            got = Counter()
            for lo_part in co._parts(text.encode(), limit):
                g = co._Grams([lo_part], ["en"])
                if g.n:
                    whole = [bytes(g.words.buf[a:b]).decode() for a, b in zip(g.words.starts, g.words.ends)]
                    two = set(g.two.tolist())
                    for i in range(g.n):
                        if g.own[i]:
                            got[(whole[i],)] += 1
                            if i in two:
                                got[whole[i], whole[i + 1]] += 1
                                if i + 1 in two:
                                    got[whole[i], whole[i + 1], whole[i + 2]] += 1
            assert got == Counter(phrases_of(text))


def test_score_is_exact(spark):
    rng = random.Random(2)
    cases = [(10**15 - 1, 10**15 - 1, 10**15 - 1), (10**14, 10**15 - 1, 10**15 - 2), (1, 10**9, 10**9)]
    for _ in range(300):
        left, right = rng.randrange(1, 10**15), rng.randrange(1, 10**15)
        cases.append((rng.randrange(1, min(left, right) + 1), left, right))
    frame = spark.createDataFrame(cases, "a long, l long, r long")
    frame = frame.select(*(F.col(c).cast("decimal(15,0)").alias(c) for c in "alr")).withColumn("score", F.expr(co.SCORE))
    for a, left, right, score in frame.collect():
        assert score == 1000000 * int(a) ** 2 // (int(left) * int(right))
