"""The pipeline's stages against brute force on a fixture, and all of it on a small table."""

import random




import corpus_pipeline as cp
from phenospark.llm import suffix_dedup
from test_decontaminate import words
from test_repeats import brute_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], SCHEMA).repartition(3)


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_dedup(spark, corpus):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 300)))) for i in range(150)]
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[100][1]) for i in range(40)] + [(3000, ""), (3001, None), (3002, rows[5][1].upper())] + [rows[7]]
    got = {r.doc_id for r in cp.simhash_near_dedup(spark, frame(spark, rows), "").collect()}
    assert cp.simhash_near_dedup(spark, frame(spark, rows), "").count() == len(got)
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sets = [(d, shingles(t or "")) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if (not s and not t) or (s and len(s & t) >= 0.8 * len(s | t)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {d for d in parent if root(d) == d}


def brute_kept(rows):
    """The smallest id of each group linked by five-word similarities of 0.8 or more."""
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d for d in parent if root(d) == d}


def fresh(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(n)]


def test_contiguous_edits(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        w = fresh(rng, rng.randrange(150, 600))
        part = rng.uniform(0.805, 0.9)
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w[:int(len(w) * part)] if i % 2 else w + fresh(rng, int(len(w) * (1 / part - 1)))))]
    want = brute_kept(rows)
    assert len(want) <= 122
    assert {r.doc_id for r in cp.simhash_near_dedup(spark, frame(spark, rows), "").collect()} == want


def test_below_the_limit(spark):
    """Scattered edits around the limit, and one bucket in which some texts are similar and others are not."""
    rng, rows = random.Random(6), []
    for i in range(150):
        w = fresh(rng, rng.randrange(150, 400))
        v = list(w)
        for at in rng.sample(range(len(w)), max(1, int(len(w) * rng.uniform(0.018, 0.036)))):
            v[at] = "edited"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    base = fresh(rng, 150)
    rows += [(5000 + i, " ".join(base + fresh(rng, 10 + i))) for i in range(30)]
    want = brute_kept(rows)
    assert 180 < len(want) < 320
    assert {r.doc_id for r in cp.simhash_near_dedup(spark, frame(spark, rows), "").collect()} == want


def test_suffix_stage(spark, corpus):
    rows = [(d, t) for d, t in corpus if d is not None]
    got = sorted((r.doc_id, r.text, r.n_chars) for r in cp.suffix_array_dedup(spark, frame(spark, rows), "").collect() if r.text is not None)
    want = sorted((d, raw.decode("utf-8", "ignore")) for (d, _, _, _, raw), n in brute_bytes([r for r in rows], 200).items() for _ in range(n) if d != 300)
    assert [(d, len(t)) for d, t, _ in got] == [(d, n) for d, _, n in got]
    close = [(d, a, b) for (d, a, _), (_, b) in zip(got, want) if a != b]
    assert all(len(a) - len(b) in range(0, 60) for _, a, b in close) and len(close) < len(got) / 4  # characters at the edges of a cut stay whole


def test_decontamination_stage(spark, corpus, tmp_path):
    rows = [r for r in corpus]
    items = [(i, rows[i][1][:200]) for i in range(0, 30, 5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(str(r.doc_id) for r in cp.benchmark_decontamination(spark, frame(spark, rows), str(tmp_path)).collect())
    grams = {tuple(w[i:i + min(10, len(w))]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9))}
    want = sorted(str(d) for d, t in rows if not any(tuple(w[i:i + n]) in grams for w in [words(t)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1)))
    assert got == want


def test_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = suffix_dedup.tx.Stage(stage(spark, docs, sf), "test").df
        counts.append(docs.count())
        assert docs.columns == columns or name == "packing"
    assert 0 < counts[3] <= counts[2] == counts[1] < counts[0] <= 200
    assert sorted(cp.run(spark, sf).select("doc_id", "start", "ids_crc32").collect()) == sorted(docs.select("doc_id", "start", "ids_crc32").collect())


def test_empty(spark, empty_documents):
    for _, stage in cp.STAGES:
        assert stage(spark, empty_documents, "/root/testdata/sf0.001").count() == 0
