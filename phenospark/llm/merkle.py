"""Merkle manifest of a dataset: per-row proofs, per-source subroots and one root, with leaf coordinates from bitmaps.

Coordinates. The doc_ids of a source are kept as bitmaps: words of 64 ids, merged where tasks meet, and containers of 16 words
that store only the words with a bit, a mask of which those are, and the count of bits before each (the popcount directory).
Counts of containers are added up in three levels of at most 2^18 children. The place of a leaf among its source's is then the
container's base, plus the directory's count, plus the bits of its word below its own: no leaf is sorted. Each container is
offered under 32 salts, so rows that crowd into one spread over as many tasks.

Levels. A leaf goes to slot ``index mod 256`` of the array ``index / 256``; an array is reduced by two levels of runs of 16 to
one digest, which is a node of the next round. No array has more than 256 slots, whatever a source holds. The subroots are the
nodes of one more tree. Coming back down, each array meets the one path above it, so no join repeats rows.

Rows. One per input row. NULL fields count as ``-``; empty texts are ordinary values. A NULL doc_id comes before all others.
Rows of one source with the same doc_id (NULL too) are told apart by their leaf, ascending, equal leaves by place in the input;
only they, and ids of the same word of 64, are sorted, by ranges of all of them, so a large group of them is many tasks. An
empty table gives no rows. Texts are hashed where they lie and never move, so their length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenospark.llm import texts as tx

#: Nodes of a run, and levels that one slot array reduces.
RUN, SLOTS = 16, 256
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIBLINGS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """A row's digest, with ``text`` in place of its text."""
    return digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def fold(leaf_digest: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, leaf_digest, lambda node, s: digest(s["left"], node, s["right"]))


def proof(siblings: Column) -> Column:
    """All sibling digests in one string, from the leaf's level to the root's."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


# ---- coordinates --------------------------------------------------------------------------------------------------


def _containers(rows: DataFrame) -> DataFrame:
    """(key, hi, n, words: [(w, bits, before, n)], mask) per 1,024 ids of a key."""
    words = rows.groupBy("key", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n"))
    held = words.groupBy("key", F.shiftright("word", 4).alias("hi")).agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(15)).cast("int").alias("w"), "bits", F.col("n").alias("n")))).alias("words"),
    )
    before = F.transform("words", lambda x, i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["n"]))
    mask = F.aggregate("words", F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["w"])))
    return held.select("key", "hi", "n", "words", before.alias("before"), mask.alias("mask"))


def _directory(containers: DataFrame) -> DataFrame:
    """Containers with the number of leaves before them in their key, and the key's total."""
    levels = containers.withColumns({"p1": F.shiftright("hi", 18), "p2": F.shiftright("hi", 36)})
    running = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n")
    top = levels.groupBy("key", "p2").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("key"))
    top = top.select("key", "p2", running(["key"], "p2").alias("base2"), total.alias("total"))
    middle = levels.groupBy("key", "p2", "p1").agg(F.sum("n").alias("n")).withColumn("base1", running(["key", "p2"], "p1"))
    middle = middle.join(top, ["key", "p2"]).select("key", "p1", (F.col("base1") + F.col("base2")).alias("base1"), "total")
    bottom = levels.withColumn("base", running(["key", "p1"], "hi")).join(middle, ["key", "p1"])
    return bottom.select("key", "hi", (F.col("base") + F.col("base1")).alias("base"), "total", "words", "before", "mask")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> tuple[DataFrame, tx.Stage]:
    """``place``: the number of rows of the same keys that come before in the order.

    Rows are dealt by ranges of keys and order; each range numbers its own, and adds what earlier ranges hold of its keys.
    """
    stage = tx.Stage(rows.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()), name)
    local = F.row_number().over(Window.partitionBy("range", *keys).orderBy(*order)) - 1
    held = stage.df.groupBy("range", *keys).agg(F.count("*").alias("n"))
    earlier = (F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).alias("earlier")
    numbered = stage.df.withColumn("local", local).join(held.select("range", *keys, earlier), ["range", *keys])
    return numbered.withColumn("place", (F.col("local") + F.col("earlier")).cast("long")).drop("range", "local", "earlier"), stage


def coordinates(rows: DataFrame) -> tuple[DataFrame, list[tx.Stage]]:
    """(key, doc_id, leaf, payload, row) with ``index`` and ``total`` within the key."""
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(-(2**62)).cast("long"))
    placed = rows.withColumns({"word": word, "bit": F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")})
    containers = tx.Stage(_containers(placed), "merkle-bitmaps")
    directory = tx.Stage(_directory(containers.df), "merkle-directory")
    salted = directory.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asking = placed.withColumns({"hi": F.shiftright("word", 4), "salt": F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")})
    met = asking.join(salted.hint("merge"), ["key", "hi", "salt"])  # both sides grow with the input
    slot = F.expr("bit_count(mask & ~shiftleft(-1, cast(word & 15 as int)))")
    met = met.withColumn("slot", slot).withColumns({
        "start": F.col("base") + F.expr("before[slot]"),
        "bits": F.expr("words[slot].bits"),
        "crowded": F.expr("words[slot].n > bit_count(words[slot].bits)"),
    })
    plain = ["key", "total", "doc_id", "leaf", "payload"]
    alone = met.where(~F.col("crowded")).select(*plain, (F.col("start") + F.expr("bit_count(bits & ~shiftleft(-1L, bit))")).alias("index"))
    crowd = tx.Stage(met.where("crowded").select(*plain, "start", "row"), "merkle-crowded")
    used = [containers, directory, crowd]
    if not crowd.df.isEmpty():
        told, stage = ranked(crowd.df, ["key", "start"], ["doc_id", "leaf", "row"], "merkle-told-apart")
        used.append(stage)
        alone = alone.unionByName(told.select(*plain, (F.col("start") + F.col("place")).alias("index")))
    return alone, used


# ---- levels -------------------------------------------------------------------------------------------------------


def _slot_arrays(nodes: DataFrame) -> DataFrame:
    """(key, pack, total, items, inner, top) of nodes (key, total, index, leaf, ...): items in order of their slots."""
    rest = [c for c in nodes.columns if c not in ("key", "total", "index")]
    slot = F.col("index").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    arrays = nodes.groupBy("key", F.shiftright("index", 8).alias("pack")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct(slot, *rest))).alias("items"))
    runs = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / RUN).cast("int"))
    of_run = lambda j: F.sha2(F.array_join(F.slice(F.col("items.leaf"), j * RUN + 1, F.lit(RUN)), ""), 256)
    inner = F.when(F.col("total") > 1, F.transform(runs, of_run))
    top = F.when(F.col("total") == 1, F.col("items")[0]["leaf"]).when(F.col("total") <= RUN, F.col("inner")[0])
    return arrays.withColumn("inner", inner).withColumn("top", top.otherwise(F.sha2(F.array_join("inner", ""), 256)))


def _up(nodes: DataFrame, most: int, name: str) -> list[tx.Stage]:
    """Rounds of slot arrays; keys of at most 256 nodes end in a round, the others go on with a 256th."""
    rounds = [tx.Stage(_slot_arrays(nodes), f"{name}-0")]
    while most > SLOTS:
        most = -(-most // SLOTS)
        above = rounds[-1].df.where(F.col("total") > SLOTS)
        above = above.select("key", F.ceil(F.col("total") / SLOTS).alias("total"), F.col("pack").alias("index"), F.col("top").alias("leaf"))
        rounds.append(tx.Stage(_slot_arrays(above), f"{name}-{len(rounds)}"))
    return rounds


def _tops(rounds: list[tx.Stage]) -> DataFrame:
    found = [r.df.where(F.col("total") <= SLOTS).select("key", F.col("top").alias("leaf")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _siblings(slot: Column, digests: Column) -> Column:
    place = slot % RUN
    left = F.array_join(F.slice(digests, slot - place + 1, place), "")
    right = F.array_join(F.slice(digests, slot + 2, RUN - 1 - place), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _down(rounds: list[tx.Stage], outer: DataFrame) -> DataFrame:
    """Nodes of the first round with ``siblings`` up to the root; ``outer``: (key, upper, ends), the path above a key's top."""
    above = None
    for stage in reversed(rounds):
        ended = stage.df.where(F.col("total") <= SLOTS).join(outer, "key")
        if above is not None:
            path = above.select("key", F.col("index").alias("pack"), F.col("siblings").alias("upper"), "ends")
            ended = ended.unionByName(stage.df.where(F.col("total") > SLOTS).join(path.hint("merge"), ["key", "pack"]))
        items = ended.select("key", "pack", "total", "inner", "upper", "ends", F.col("items.leaf").alias("digests"), F.explode("items").alias("item"))
        slot = F.col("item.slot")
        first = F.when(F.col("total") > 1, F.array(_siblings(slot, F.col("digests"))))
        second = F.when(F.col("total") > RUN, F.array(_siblings(F.shiftright(slot, 4), F.col("inner"))))
        none = F.array().cast(SIBLINGS)
        above = items.select("key", "total", (F.col("pack") * SLOTS + slot).alias("index"), "item", "ends",
                             F.concat(F.coalesce(first, none), F.coalesce(second, none), "upper").alias("siblings"))
    return above


def manifest(docs: DataFrame, **more: Column) -> DataFrame:
    """Per row: doc_id, source, leaf, index and total (its place among its source's leaves), subroot, root, siblings.

    ``more`` are further columns of the rows, computed before the texts are left behind.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"),
                       F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in more.items())).alias("payload"),
                       F.monotonically_increasing_id().alias("row"))
    stored = tx.Stage(rows, "merkle-leaves")
    placed, used = coordinates(stored.df)
    most = used[1].df.agg(F.max("total")).first()[0] or 1
    leaves = _up(placed, most, "merkle-levels")
    for stage in (stored, *used):
        stage.drop()
    # the keys in order, NULL first, are the nodes of the last tree
    n_sources = _tops(leaves).count()
    sources, stage = ranked(_tops(leaves).withColumn("all", F.lit("")), ["all"], ["key"], "merkle-sources")
    nodes = sources.select(F.lit("").alias("key"), F.lit(n_sources).cast("long").alias("total"), F.col("place").alias("index"), "leaf", F.col("key").alias("source_key"))
    upper = _up(nodes, n_sources, "merkle-upper")
    stage.drop()
    root = _tops(upper).select("key", F.array().cast(SIBLINGS).alias("upper"), F.col("leaf").alias("ends"))
    by_source = _down(upper, root).select(F.col("item.source_key").alias("key"), F.col("siblings").alias("upper"),
                                          F.struct(F.col("item.leaf").alias("subroot"), F.col("ends").alias("root")).alias("ends"))
    down = _down(leaves, by_source)
    source = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1))
    return down.select(F.col("item.doc_id").alias("doc_id"), source.alias("source"), F.col("item.leaf").alias("leaf"), "index", "total", "ends.subroot", "ends.root", "siblings",
                       *(F.col(f"item.payload.{n}").alias(n) for n in more))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The whole of documents; rows whose doc_id's CRC is divisible by five are checked with a text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(F.translate(F.col("text"), UPPER, LOWER)))
    rows = manifest(docs, changed=changed)
    folded = fold(F.coalesce("changed", "leaf"), F.col("siblings"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("siblings")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


# ---- the same in SQL, with as many levels as 16^6 leaves of a source and 16^4 sources need ---------------------------


def _levels_sql(name: str, n: int) -> str:
    """Tables name_0 .. name_n of nodes with their siblings; name_0 needs (key, i, h) in name_leaves."""
    parts = []
    for k in range(n + 1):
        nodes = f"SELECT key, i, h FROM {name}_leaves" if k == 0 else (
            f"SELECT key, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}_{k - 1} WHERE n > 1 GROUP BY key, i // 16")
        run = "string_agg(h, '') OVER (PARTITION BY key, i // 16 ORDER BY i ROWS BETWEEN "
        parts.append(f"""{name}_{k} AS (SELECT key, i, h, count(*) OVER (PARTITION BY key) AS n,
            coalesce({run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce({run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({nodes}))""")
    return ",\n".join(parts)


def _tops_sql(name: str, n: int) -> str:
    return " UNION ALL ".join(f"SELECT key, h FROM {name}_{k} WHERE n = 1" for k in range(n + 1))


def manifest_sql(leaf_levels: int = 6, source_levels: int = 4) -> str:
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    proof_parts, joins = [], []
    for name, n, key, at in (("d", leaf_levels, "c.key", "c.i"), ("s", source_levels, "''", "o.i")):
        for k in range(n):
            t = f"{name}{k}"
            joins.append(f"LEFT JOIN {name}_{k} {t} ON {t}.key = {key} AND {t}.i = {at} // {16 ** k} AND {t}.n > 1")
            proof_parts.append(f"coalesce({t}.l || {t}.r, '')")
    folds = ["SELECT *, changed AS f0 FROM paths"]
    for j in range(leaf_levels + source_levels):
        folds.append(f"SELECT *, CASE WHEN l{j} IS NULL THEN f{j} ELSE sha256(l{j} || f{j} || r{j}) END AS f{j + 1} FROM folded_{j}")
    names = [f"d{k}" for k in range(leaf_levels)] + [f"s{k}" for k in range(source_levels)]
    sides = ", ".join(f"{t}.l AS l{j}, {t}.r AS r{j}" for j, t in enumerate(names))
    folded = ",\n".join(f"folded_{j} AS ({sql})" for j, sql in enumerate(folds))
    last = leaf_levels + source_levels
    return f"""WITH RECURSIVE bits AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT b, c FROM bits WHERE k = 8),
crcs AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS p, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT doc_id, s, p + 1, xor(crcs.c >> 8, t.c) FROM crcs JOIN crc_table t ON t.b = (xor(crcs.c, CAST(ascii(s[p]) AS BIGINT)) & 255) WHERE p <= length(s)),
chosen AS (SELECT doc_id AS chosen_id FROM crcs WHERE p = length(s) + 1 AND xor(c, 4294967295) % 5 = 0),
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS key, {whole("text")} AS h,
    CASE WHEN chosen_id IS NULL THEN {whole("text")} ELSE {whole("translate(text, '" + UPPER + "', '" + LOWER + "')")} END AS changed
    FROM documents LEFT JOIN chosen ON doc_id = chosen_id),
d_leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
{_levels_sql("d", leaf_levels)},
d_tops AS ({_tops_sql("d", leaf_levels)}),
s_leaves AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, h, key AS source_key FROM d_tops),
{_levels_sql("s", source_levels)},
s_tops AS ({_tops_sql("s", source_levels)}),
paths AS (SELECT c.doc_id, c.h AS leaf, c.changed, o.h AS subroot, (SELECT h FROM s_tops) AS root, {" || ".join(proof_parts)} AS proof, {sides}
    FROM d_leaves c JOIN s_leaves o ON o.source_key = c.key {" ".join(joins)}),
{folded}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f{last} AS folded_root, f{last} = root AS verified FROM folded_{last}"""
