"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count proposals and their border exactly.

Proposals are the words and the pairs of words of a sample of documents (one in ``sample_every`` by hash). A full pass counts all
words, all pairs of proposed words (proposed pairs, and the negative border of pairs), and all triples of two proposed pairs
(every triple is a proposal or border: no longer phrase rests on it). Border phrases that turn out frequent are failures: they
become proposals, and a further pass counts the phrases that rest on them, until no pass finds a failure. Then
every phrase with frequent parts has been counted, so every frequent one. These passes name phrases by codes of 64 bits, whose
counts are at least the phrases' own; the last pass counts the phrases with frequent codes by their words, exactly.

Proposals are looked up in bit sets of fixed size (2 MB for words, 16 MB for pairs and for frequent phrases, whatever the
input), as they grow with it. A bit set that says yes too often only has more phrases counted, never fewer. Tasks count
their texts in pieces and send each phrase once per piece; Spark adds up before and after its shuffle, so a frequent phrase
is few rows. Texts beyond a piece are cut where no phrase crosses, or else at a blank, with the two words that follow
lent to the part before.

Rows. NULL lang is ``und``, together with a lang of that name; NULL and empty texts hold nothing; repeated rows count again;
doc_id is not read. Pieces are cut at ``.,;:!?`` and line ends, words at blanks and tabs; a word may be of any length. Ties are decided
as the contract says. An empty table, or one without phrases frequent enough, gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from phenospark.llm import texts as tx

#: Codes end in two bits that tell a phrase's words.
CODES, COUNTS = "code long, n long", "lang string, phrase string, n long"
#: Bits of the sets of proposed words and pairs, and of frequent phrases; of the blocks that Spark's bitmap functions build.
BITS, FREQUENT_BITS, BLOCK = (1 << 24, 1 << 27), 1 << 27, 1 << 15
#: Bytes of text that a task counts at a time, and rows that it sends at a time.
PIECE_BYTES, BATCH_ROWS = 2 << 20, 1 << 16
BLANKS = tx.separator_table(lambda b: b in (0x09, 0x20))
CUTS = tx.separator_table(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
CUT, BLANK, TWO_WORDS = re.compile(rb"[.,;:!?\x0A-\x0D]"), re.compile(rb"[\x20\x09]"), re.compile(rb"[\x20\x09]*[^\x20\x09]*[\x20\x09]*[^\x20\x09]*")
#: floor(1000000 a a / (l r)) of decimal(15,0): whole numbers throughout, up to 38 digits.
SCORE = "(cast(1000000 as decimal(7,0)) * (a * a)) div (l * r)"
STEP = np.uint64(0x9E3779B97F4A7C15)
SALTS = 8


class Proposals:
    """A set of codes that never denies a member: two bits for each."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, self.blocks = bits, blocks

    @classmethod
    def of(cls, bits: int, phrases: DataFrame) -> Proposals:
        """From a column ``code``. The driver gets at most bits / 8 bytes, in blocks of 4 KB."""
        places = F.array(*(F.shiftright("code", s).bitwiseAND(F.lit(bits - 1)) for s in (2, 33)))
        place = phrases.select(F.explode(places).alias("place"))
        place = place.select(F.shiftright("place", 15).alias("block"), F.col("place").bitwiseAND(F.lit(BLOCK - 1)).alias("bit"))
        return cls(bits, {r.block: bytes(r.held) for r in place.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("held")).collect()})

    def __or__(self, other: Proposals) -> Proposals:
        merged = dict(self.blocks)
        for block, held in other.blocks.items():
            old = np.frombuffer(merged.get(block, bytes(len(held))), dtype=np.uint8)
            merged[block] = (old | np.frombuffer(held, dtype=np.uint8)).tobytes()
        return Proposals(self.bits, merged)

    def table(self) -> np.ndarray:
        out = np.zeros(self.bits // 8, dtype=np.uint8)
        for block, held in self.blocks.items():
            out[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)] = np.frombuffer(held, dtype=np.uint8)
        return out


def _held(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.ones(len(codes), dtype=bool)
    for shift in (2, 33):
        place = (codes >> np.uint64(shift)) & np.uint64(8 * len(table) - 1)
        out &= (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


# ---- inside tasks -------------------------------------------------------------------------------------------------


def _parts(text: bytes, limit: int):
    """(bytes, how many of them are its own): phrases that start in the own bytes end in the part."""
    lo = 0
    while len(text) - lo > limit:
        tail = text[lo + limit // 2:lo + limit]
        cut = max((tail.rfind(c) for c in (b"\n", b".", b",", b"!", b"?", b";", b":")), default=-1)
        if cut >= 0:
            hi = end = lo + limit // 2 + cut
        else:
            found = next((m for m in (CUT.search(text, lo + limit, lo + 2 * limit), BLANK.search(text, lo + limit)) if m), None)
            if not found:
                break
            hi = found.start()
            end = TWO_WORDS.match(text, hi).end()
        yield text[lo:end], hi - lo
        lo = hi
    yield text[lo:], len(text) - lo


class _Grams:
    """Words of some parts of texts, and the codes of the phrases that start at each."""

    def __init__(self, parts: list[tuple[bytes, int]], langs: list[str]):
        w = self.words = tx.Words([p for p, _ in parts], BLANKS | CUTS, lower=True)
        self.n = len(w.starts)
        if not self.n:
            return
        text = w.text_of_words()
        self.langs = sorted(set(langs))
        code_of = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([code_of[x] for x in langs], dtype=np.int64)[text]
        self.own = w.starts - w.text_starts[text] < np.array([o for _, o in parts], dtype=np.int64)[text]
        cuts = np.flatnonzero(CUTS[w.buf])
        joined = np.searchsorted(cuts, w.starts[1:]) == np.searchsorted(cuts, w.ends[:-1])
        #: starts of two words, and of three (as places in ``two``), that are of one piece of one text
        self.two = np.flatnonzero(joined & (text[1:] == text[:-1]))
        self.three = np.flatnonzero(self.two[1:] == self.two[:-1] + 1)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], dtype=np.uint64)
        mixed = tx.mix(w.hashes() ^ salt[self.lang])
        pair = tx.mix(mixed[self.two] * STEP + mixed[self.two + 1])
        triple = tx.mix(pair[self.three] * STEP + mixed[self.two[self.three] + 2])
        self.code, self.pair_code, self.triple_code = ((c << np.uint64(2)) | np.uint64(k) for k, c in enumerate((mixed, pair, triple), 1))

    def allowed(self, sets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs, and which triples, are counted: those all of whose parts are proposals."""
        if sets is None:
            return np.zeros(len(self.two), bool), np.zeros(len(self.three), bool)
        word = _held(sets[0], self.code)
        pair = word[self.two] & word[self.two + 1]
        proposed = pair.copy()
        proposed[pair] = _held(sets[1], self.pair_code[pair])
        return pair, proposed[self.three] & proposed[self.three + 1]

    def codes_beyond(self, old: list[np.ndarray] | None, new: list[np.ndarray] | None):
        """Codes that the new proposals have counted and the old ones had not. Without proposals, all words and pairs."""
        if old is None:
            yield self.code[self.own]
        (pair0, triple0), (pair1, triple1) = self.allowed(old), self.allowed(new)
        yield self.pair_code[(pair1 & ~pair0 if new else True) & self.own[self.two]]
        yield self.triple_code[triple1 & ~triple0 & self.own[self.two[self.three]]]

    def phrases(self, frequent: np.ndarray):
        """Different phrases of one to three words with frequent codes: (size, start of one occurrence, occurrences)."""
        bounds = np.stack((self.words.starts, self.words.ends), axis=1).ravel().astype(np.int64)  # words, and what lies between them
        spans = pa.LargeStringArray.from_buffers(2 * self.n - 1, pa.py_buffer(bounds), pa.py_buffer(self.words.buf)).dictionary_encode()
        number = spans.indices.to_numpy(zero_copy_only=False).astype(np.int64)[::2]
        starts = (np.arange(self.n), self.two, self.two[self.three])
        for size, (at, codes) in enumerate(zip(starts, (self.code, self.pair_code, self.triple_code)), 1):
            at = at[_held(frequent, codes) & self.own[at]]
            key = self.lang[at]
            for k in range(size):
                _, first, key, n = np.unique(key * len(spans.dictionary) + number[at + k], return_index=True, return_inverse=True, return_counts=True)
            words = [spans.dictionary.take(pa.array(number[at[first] + k])) for k in range(size)]
            yield self.lang[at[first]], pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())), n


def _in_pieces(batches):
    for batch, texts in tx.text_chunks(batches, PIECE_BYTES):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        parts = [(p, x) for t, x in zip(texts, langs) for p in _parts(t, PIECE_BYTES)]
        for lo, hi in tx.chunked([len(p[0]) for p, _ in parts], PIECE_BYTES):
            g = _Grams([p for p, _ in parts[lo:hi]], [x for _, x in parts[lo:hi]])
            if g.n:
                yield g


def _sliced(batch: pa.RecordBatch):
    for lo in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(lo, BATCH_ROWS)


def _code_pass(read: DataFrame, old: list[Proposals] | None, new: list[Proposals] | None) -> DataFrame:
    """One pass over (lang, text): counts of what ``new`` has counted beyond ``old``."""
    sets = read.sparkSession.sparkContext.broadcast((old, new))

    def run(batches):
        was, now = ([s.table() for s in x] if x else None for x in sets.value)
        for g in _in_pieces(batches):
            for codes in g.codes_beyond(was, now):
                codes, n = np.unique(codes, return_counts=True)
                yield from _sliced(pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"]))

    return read.mapInArrow(run, CODES).groupBy("code").agg(F.sum("n").alias("n"))


def _phrase_pass(read: DataFrame, frequent: Proposals) -> DataFrame:
    """Exact counts of the phrases with frequent codes; the empty phrase counts all words."""
    sets = read.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        table = sets.value.table()
        for g in _in_pieces(batches):
            names = pa.array(g.langs, pa.string())
            total = np.bincount(g.lang[g.own], minlength=len(g.langs))
            yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(names), pa.string()), pa.array(total.astype(np.int64))], names=["lang", "phrase", "n"])
            for lang, phrase, n in g.phrases(table):
                yield from _sliced(pa.RecordBatch.from_arrays([names.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"]))

    return read.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# ---- on Spark -----------------------------------------------------------------------------------------------------


def _failures(frequent: DataFrame, held: Proposals) -> Proposals:
    """Frequent phrases that are no proposals."""
    sets = frequent.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        table = sets.value.table()
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(codes[~_held(table, codes.view(np.uint64))])], names=["code"])

    return Proposals.of(held.bits, frequent.select("code").mapInArrow(run, "code long"))


def frequent_phrases(docs: DataFrame, least: int = 10, sample_every: int = 16, sample_least: int = 2) -> DataFrame:
    """(lang, phrase, size, n): all phrases of one to three words with n >= least; the empty phrase counts all words.

    A phrase is a proposal if the sample, one document in ``sample_every``, has it ``sample_least`` times.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    sample = read.where(F.pmod(F.xxhash64("lang", "text"), F.lit(sample_every)) == 0)
    of_size = lambda stage, k: stage.df.where(F.col("code").bitwiseAND(F.lit(3)) == k)
    seen = tx.Stage(_code_pass(sample, None, None).where(F.col("n") >= sample_least), "collocations-sample")
    before, proposed = None, [Proposals.of(bits, of_size(seen, k)) for k, bits in enumerate(BITS, 1)]
    seen.drop()
    frequent = Proposals(FREQUENT_BITS, {})
    while True:
        counted = tx.Stage(_code_pass(read, before, proposed).where(F.col("n") >= least), "collocations-codes")
        frequent |= Proposals.of(FREQUENT_BITS, counted.df)
        failed = [_failures(of_size(counted, k), held) for k, held in enumerate(proposed, 1)]
        counted.drop()
        if not any(f.blocks for f in failed):
            break
        before, proposed = proposed, [held | f for held, f in zip(proposed, failed)]
    exact = _phrase_pass(read, frequent).where((F.col("phrase") == "") | (F.col("n") >= least))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return tx.Stage(exact.select("lang", "phrase", size.alias("size"), "n"), "collocations-phrases").df


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, **sampling) -> DataFrame:
    """Per lang the ``top`` phrases by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    Phrases that lie in a longer one with at least ``inside`` percent of their occurrences are left out.
    """
    counts = frequent_phrases(docs, least, **sampling)
    found = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cut = found.select("lang", "phrase", "size", "a", "words", cuts).select(
        "lang", "phrase", "size", "a", "k", joined(1, F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
        F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    # a frequent word begins many phrases: their rows are dealt out under salts
    parts = counts.where("size in (1, 2)").select("lang", F.col("phrase").alias("part"), "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("part").alias(side), F.col("n").alias(name), "salt"), ["lang", side, "salt"])
    wide = cut.withColumns({c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")})
    scored = wide.select("lang", "phrase", "size", F.struct(F.expr(SCORE).alias("score"), "k", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r"))).alias("cut"))
    lowest = scored.groupBy("lang", "phrase", "size").agg(F.min("cut").alias("cut")).select("lang", "phrase", "size", "cut.*")
    longer = found.where("size = 3").select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), F.col("a").alias("held"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where((F.col("size") == 3) | F.col("held").isNull() | (100 * F.col("held") < inside * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The whole of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH lowered AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split_pieces AS (SELECT d, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM lowered),
pieces AS (SELECT d, lang, unnest(range(len(pieces))) AS p, unnest(pieces) AS piece FROM split_pieces),
split_words AS (SELECT d, p, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
words AS (SELECT d, p, lang, unnest(range(len(words))) AS i, unnest(words) AS w1 FROM split_words),
grams AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY d, p ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY d, p ORDER BY i) AS w3 FROM words),
n1 AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
n2 AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
      FROM n2 c JOIN n1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN n1 y ON y.lang = c.lang AND y.w1 = c.w2
      WHERE NOT EXISTS (SELECT 1 FROM n3 t WHERE t.lang = c.lang AND t.w1 = c.w1 AND t.w2 = c.w2 AND 100 * t.f >= 50 * c.f)
        AND NOT EXISTS (SELECT 1 FROM n3 t WHERE t.lang = c.lang AND t.w2 = c.w1 AND t.w3 = c.w2 AND 100 * t.f >= 50 * c.f)
    UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
      FROM n3 c JOIN n1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN n2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
      FROM n3 c JOIN n2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN n1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM n1 WHERE n1.lang = ranks.lang) AS n, score FROM ranks WHERE rank <= 2000"""
