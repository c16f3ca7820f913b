"""Language-model scores against brute force; quality and language on held-out rows; parsing against a plain search."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.llm import language_id, lm_score, quality

SF = "/root/testdata/sf0.1"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def crc(d):
    return zlib.crc32(b"" if d is None else str(d).encode())


def brute_lm(rows, order, strength):
    counts, starts = Counter(), 0
    for d, t in rows:
        if crc(d) % 7 != 2:
            starts += 1
            line = ["<"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(line)):
                counts.update(tuple(line[i - k:i + 1]) for k in range(order))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    out = []
    for d, t in rows:
        line = ["<"] * (order - 1) + tokens(t)
        base = score = known = 0
        for i in range(order - 1, len(line)):
            p = (counts[tuple(line[i:i + 1])] + 1) / (n + v + 1)
            base += math.log10(p)
            known += counts[tuple(line[i:i + 1])] > 0
            for k in range(1, order):
                h = tuple(line[i - k:i])
                c = starts if set(h) == {"<"} else counts[h]
                p = (counts[tuple(line[i - k:i + 1])] + strength * p) / (c + strength)
            score += math.log10(p)
        out.append((str(d), crc(d) % 7 == 2, len(line) - order + 1, known, n, round(base, 6), round(score, 6)))
    return Counter(out)


@pytest.mark.parametrize("order,chunk", [(1, 1 << 20), (2, 20_000), (3, 50_000)])
def test_lm(documents, corpus, order, chunk):
    got = lm_score.score_texts(documents, order, 3.0, chunk).withColumn("doc_id", lm_score.tx.public_id(F.col("order_id"))).collect()
    got = Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert got == brute_lm(corpus, order, 3.0)


def test_lm_default_is_trigrams(documents, corpus):
    got = lm_score.score_texts(documents).withColumn("doc_id", lm_score.tx.public_id(F.col("order_id"))).collect()
    got = Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert got == brute_lm(corpus, 3, 150.0)


def test_lm_without_rows_or_training_rows(spark, documents):
    assert lm_score.score_texts(documents.where("false")).collect() == []
    got = lm_score.score_texts(documents.where(lm_score.held_out(F.col("doc_id"), 7))).collect()
    assert got and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == r.score == 0 for r in got)


def test_lm_beats_base(spark):
    got = lm_score.op7_lm_score(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_cross_parsing():
    rng = np.random.default_rng(3)
    samples = {"a": "".join(rng.choice(list("abc "), 400)), "b": "".join(rng.choice(list("acd "), 300))}
    model = language_id.Model(samples)
    text = "".join(rng.choice(list("abcd! "), 500))
    line = model.symbolic(language_id.letters(text))
    got = model.costs([line], lane=10_000)[0]
    for name, cost in zip(model.names, got):
        sample = model.symbolic(np.array(list(map(ord, "".join(c if c.isalpha() else " " for c in samples[name]))), dtype=np.uint32)).tobytes()
        raw, phrases, i = line.tobytes(), 0, 0
        while i < len(raw):
            n = 1
            while i + n < len(raw) and raw[i:i + n + 1] in sample and raw[i:i + n] in sample:
                n += 1
            phrases, i = phrases + 1, i + n
        want = phrases * np.log2(len(sample)) / len(raw)
        assert cost == pytest.approx(want, rel=0.01)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_few_long_texts_are_learned(spark):
    """Languages whose text lies in few long rows, or in one among many short ones, fill their samples as others do."""
    sentence = lambda letters, n: " ".join(map("".join, np.random.default_rng(n).choice(list(letters), (n // 6, 5))))
    rows = [(i, sentence("abcde", 3_000), "short") for i in range(60)] + [(1000, sentence("abcde", 500_000), "short")]
    rows += [(2000 + 10 * k + i, sentence("fghij", 200_000), f"long{k}") for k in range(8) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.learn(docs)
    names = {r.lang for r in docs.select("lang").distinct().collect()}
    assert set(model.names) == names and len(names) > 5
    assert all(bits >= np.log2(23_000) for bits in model.bits)


def test_language_edges(documents, corpus, empty_documents, spark):
    rows = language_id.identify(documents).collect()
    assert len(rows) == len(corpus)
    named = {r.doc_id: r for r in rows}
    assert all(named[d].lang_pred == "und" and named[d].score == 0 for d in (300, 301, 302)) and named[307].lang_pred == "en"
    assert language_id.identify(empty_documents).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(none).first().lang_pred == "und"


def test_quality_accuracy(spark):
    got = quality.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()
    assert got[got.quality == 1].predicted.mean() > 0.98


def test_quality_edges(documents, corpus, empty_documents, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(documents, labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(empty_documents, labels).count() == 0
    assert all(r.score == 0.5 for r in quality.score_quality(documents, labels.limit(0)).collect())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel(5, 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    counts, y, w = np.array([3, 1, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x = rng.standard_normal((6, quality.WIDTH)) * 0.1
    loss = lambda: -(w * (y * np.log(s := model._forward(x, counts)[-1]) + (1 - y) * np.log(1 - s))).sum() / 3
    for k, g in model._gradients(x, counts, y, w).items():
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-6)
