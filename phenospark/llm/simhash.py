"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are sorted, which is the order of a binary trie's leaves, and cut into blocks; a block is the part of the trie
below (at most) one run of leaves. Pairs of blocks are skipped when their common prefixes already differ in more bits than
the budget. Inside a pair, pairs of trie nodes are traversed together: differing bits add up, and a pair of nodes is pruned
once they exceed the budget, or when everything below is already known to be one group. Of the links found only a spanning
forest leaves the task, so groups of any size stay linear. Groups that meet become components.

Rows: one per input row. NULL or blank text has the fingerprint zero and links like any other. Equal fingerprints are one
trie leaf, so exact copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import components, intervals, texts as tx

SEED = 42


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """64-bit SimHash of each text over its shingles of ``width`` words."""
    digest = xxhash.xxh64_digest
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi in tx.chunked([len(t) for t in texts], 1 << 20):
        hashed, counts = [], []
        for text in texts[lo:hi]:
            words = text.lower().split()
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            n = max(1, len(words) - width + 1) if words else 0
            if n == 1:
                hashed.append(digest(line, SEED))
            elif n:
                begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
                hashed.extend([digest(line[a:b], SEED) for a, b in zip(begins, ends[width - 1:].tolist())])
            counts.append(n)
        counts = np.array(counts)
        sums = np.zeros((len(counts), 64), dtype=np.int64)
        who = np.repeat(np.arange(len(counts)), counts)
        raw = np.frombuffer(b"".join(hashed), dtype=np.uint8).reshape(-1, 8)
        for a in range(0, len(raw), 1 << 16):
            bits = np.unpackbits(raw[a:a + (1 << 16)], axis=1)
            own = who[a:a + (1 << 16)]
            first, _ = tx.runs_of(own)
            sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        bits = (2 * sums > counts[:, None]).astype(np.uint8)
        out[lo:hi] = np.packbits(bits, axis=1).view(">u8")[:, 0]
    return out


def _fingerprint_rows(batches, width):
    for batch, texts in tx.text_chunks(batches, 8 << 20):
        at = batch.schema.get_field_index
        yield pa.RecordBatch.from_arrays([batch.column(at("order_id")), batch.column(at("rid")), pa.array(fingerprints(texts, width).view(np.int64), pa.int64())], names=["order_id", "rid", "fp"])


class Forest:
    """Labels of connected points; a label is the smallest index of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            x, y = x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


class Trie:
    """Levels of a binary trie over sorted values: node boundaries and children for each depth."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.first, self.child = [np.array([0])], []
        node = np.zeros(len(values), dtype=np.int64)
        for depth in range(64):
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            key = node * 2 + bit.astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            child = np.full((len(self.first[-1]), 2), -1)
            child[key[first] // 2, key[first] % 2] = np.arange(len(first))
            self.child.append(child)
            self.first.append(first)
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))

    def span(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.append(self.first[depth], len(self.values))
        return bounds[nodes], bounds[nodes + 1]


def _join_confirmed(forest: Forest, i: np.ndarray, j: np.ndarray, confirm) -> None:
    open_ = forest.label[i] != forest.label[j]
    i, j = i[open_], j[open_]
    if confirm is not None and len(i):
        for lo in range(0, len(i), 50_000):
            ok = confirm(i[lo:lo + 50_000], j[lo:lo + 50_000])
            forest.join(i[lo:lo + 50_000][ok], j[lo:lo + 50_000][ok])
    elif len(i):
        forest.join(i, j)


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int, chunk: int = 200_000, leaf: int = 16, confirm=None) -> Forest:
    """Groups among a (and b, numbered after a) linked by at most ``budget`` differing bits, found by walking node pairs.

    Values are sorted and may repeat. Pairs of nodes with up to ``leaf`` value pairs are compared value by value; larger
    leaves pay when the budget is wide. ``confirm(i, j)`` may turn links down.
    """
    left = Trie(a)
    right, shift = (left, 0) if b is None else (Trie(b), len(a))
    forest = Forest(len(a) + (0 if b is None else len(b)))
    root = np.zeros(1, dtype=np.int64)
    stack = [(0, root, root, np.zeros(1, dtype=np.int64))]
    while stack:
        depth, x, y, diff = stack.pop()
        if len(x) > chunk:
            for lo in range(0, len(x), chunk):
                stack.append((depth, x[lo:lo + chunk], y[lo:lo + chunk], diff[lo:lo + chunk]))
            continue
        own_x, own_y = forest.label[: len(a)], forest.label[shift:] if b is not None else forest.label
        low_x, high_x = np.minimum.reduceat(own_x, left.first[depth])[x], np.maximum.reduceat(own_x, left.first[depth])[x]
        low_y, high_y = np.minimum.reduceat(own_y, right.first[depth])[y], np.maximum.reduceat(own_y, right.first[depth])[y]
        open_ = ~((low_x == high_x) & (low_y == high_y) & (low_x == low_y))
        x, y, diff = x[open_], y[open_], diff[open_]
        if not len(x):
            continue
        (x0, x1), (y0, y1) = left.span(depth, x), right.span(depth, y)
        few = ((x1 - x0) * (y1 - y0) <= leaf) | (depth == 64)
        if few.any():
            small = few & ((x1 - x0) * (y1 - y0) <= 64)
            for lo in range(0, int(small.sum()), chunk):
                at = np.flatnonzero(small)[lo:lo + chunk]
                nx, ny = (x1 - x0)[at], (y1 - y0)[at]
                pair = np.repeat(np.arange(len(at)), nx * ny)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
                i, j = x0[at][pair] + k // ny[pair], y0[at][pair] + k % ny[pair]
                near = np.bitwise_count(left.values[i] ^ right.values[j]) <= budget
                _join_confirmed(forest, i[near], j[near] + shift, confirm)
            for at in np.flatnonzero(few & ~small).tolist():
                rows = max(1, chunk // int(y1[at] - y0[at]))
                for lo in range(int(x0[at]), int(x1[at]), rows):
                    i, j = np.nonzero(np.bitwise_count(left.values[lo:min(lo + rows, int(x1[at])), None] ^ right.values[None, y0[at]:y1[at]]) <= budget)
                    _join_confirmed(forest, i + lo, j + y0[at] + shift, confirm)
            rest = ~few
            x, y, diff = x[rest], y[rest], diff[rest]
        if not len(x):
            continue
        cx, cy = left.child[depth][x], right.child[depth][y]
        nxt = []
        for p in (0, 1):
            for q in (0, 1):
                d = diff + (p != q)
                ok = (cx[:, p] >= 0) & (cy[:, q] >= 0) & (d <= budget)
                if b is None:
                    ok &= ~((x == y) & (p > q))
                nxt.append((cx[ok, p], cy[ok, q], d[ok]))
        nxt = [np.concatenate(v) for v in zip(*nxt)]
        if len(nxt[0]):
            stack.append((depth + 1, *nxt))
    return forest


def _longs(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _edges(names: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """The forest's links as (name, name of the root)."""
    moved = np.flatnonzero(forest.label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int64()), pa.array(names[forest.label[moved]], pa.int64())], names=["src", "dst"])


def _pair_links(batches, budget):
    for own, other in intervals.partners(batches, ["fps"]):
        x = np.sort(_longs(own[0]).view(np.uint64))
        y = None if other is None else np.sort(_longs(other[0]).view(np.uint64))
        yield _edges((x if y is None else np.concatenate((x, y))).view(np.int64), trie_links(x, y, budget))


def _sortable(c: str):
    """Unsigned order as signed order."""
    return F.col(c).bitwiseXOR(F.lit(-(2**63)))


def _prefix_near(budget: int):
    """Whether the common prefixes of two intervals differ in at most ``budget`` bits."""

    def near(a: str, b: str):
        common = lambda p: F.lit(64) - F.when(F.col(f"{p}lo") == F.col(f"{p}hi"), 0).otherwise(F.length(F.bin(F.col(f"{p}lo").bitwiseXOR(F.col(f"{p}hi")))))
        depth = F.least(common(a), common(b))
        differ = F.expr(f"{a}lo ^ {b}lo")
        return F.when(depth == 0, F.lit(True)).otherwise(F.bit_count(F.call_function("shiftrightunsigned", differ, (F.lit(64) - depth).cast("int"))) <= budget)

    return near


def fingerprint_groups(fps: DataFrame, budget: int = 4, block: int = 16_384) -> tuple[DataFrame, list[tx.Stage]]:
    """(fp, root) for every fingerprint that links with another one; ``fps`` has a column fp (long)."""
    ranked = intervals.ranked_blocks(fps.select("fp").distinct(), [_sortable("fp")], block)
    blocks = tx.Stage(ranked.groupBy("block").agg(F.min_by("fp", _sortable("fp")).alias("lo"), F.max_by("fp", _sortable("fp")).alias("hi"), F.collect_list("fp").alias("fps")), "blocks")
    n_blocks = blocks.df.count()
    bounds = {"lo": lambda c: F.min_by("lo", _sortable("lo")), "hi": lambda c: F.max_by("hi", _sortable("hi"))}
    pairs = intervals.close_pairs(blocks.df, bounds, _prefix_near(budget), n_blocks)
    edges = intervals.with_partners(pairs, blocks.df, ["fps"], n_blocks).mapInArrow(lambda it: _pair_links(it, budget), "src long, dst long")
    groups, stages = components.connected_components(edges)
    blocks.drop()
    return groups.select(F.col("node").alias("fp"), F.col("component").alias("root")), stages


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, block: int = 16_384) -> DataFrame:
    """order_id, rid, fp, component_id for every row of ``docs``; component_id is the smallest doc_id reachable."""
    rows = tx.Stage(tx.identified(docs).mapInArrow(lambda it: _fingerprint_rows(it, width), "order_id long, rid long, fp long"), "fingerprints")
    groups, _ = fingerprint_groups(rows.df, budget, block)
    least = rows.df.groupBy("fp").agg(F.min("order_id").alias("least")).join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.df.join(named, "fp")


# ---- similar texts: the pipeline's stage ----------------------------------------------------------------------------

BINS, BANDS = 256, 25


def shingle_sets(words: tx.Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of ``width`` words of each text, and the text of each, ordered by (text, hash); a
    text with fewer words is one shingle."""
    own = words.text_of_words()
    grams = tx.gram_hashes(h, width)
    at = np.arange(len(grams))
    inside = at + width <= words.first[1:][own[at]]
    grams, at = grams[inside], own[at[inside]]
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    whole = np.array([tx.gram_hashes(h[words.first[d]:words.first[d + 1]], int(n_words[d]))[0] for d in short], dtype=np.uint64)
    grams, at = np.concatenate((grams, whole)), np.concatenate((at, short))
    by = np.lexsort((grams, at))
    grams, at = grams[by], at[by]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
    return grams[new], at[new]


def sketches(texts: list[bytes], width: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """SimHash of each text's different words; a one-permutation minimum sketch of its shingles of ``width`` words; a digest
    of the set of shingles; and the keys of ``BANDS`` bands of the sketch's minima (0: a band without shingles).

    An edit touches few words but ``width`` times as many shingles, so fingerprints of words keep near copies close; the
    sketch (a byte per bin, 0: empty) estimates the similarity of the shingles. Bands take the minima of pairs of bins; one of 5 (6 in three of them) is
    equal with the 5th power of that similarity, however the edits lie: at 0.8 one of 25 is equal in all but 0.01 % of pairs.
    """
    fps, marks = np.zeros(len(texts), dtype=np.uint64), []
    digests, keys = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), BANDS), dtype=np.uint64)
    none = np.iinfo(np.uint64).max
    for lo, hi in tx.chunked([len(t) for t in texts], 1 << 20):
        words = tx.Words(texts[lo:hi], lower=True)
        h, own = words.hashes(), words.text_of_words()
        by = np.lexsort((h, own))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (own[by][1:] != own[by][:-1])
        each, who = h[by][new], own[by][new]
        sums, counts = np.zeros((hi - lo, 64), dtype=np.int64), np.bincount(who, minlength=hi - lo)
        for a in range(0, len(each), 1 << 16):
            bits = np.unpackbits(each[a:a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first, _ = tx.runs_of(who[a:a + (1 << 16)])
            sums[who[a:a + (1 << 16)][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        fps[lo:hi] = np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1).view(">u8")[:, 0]
        grams, at = shingle_sets(words, h, width)
        first, _ = tx.runs_of(at)
        if len(first):
            digests[lo + at[first]] = np.add.reduceat(tx.mix(grams.copy()), first)
        least = np.full((hi - lo) * BINS, none, dtype=np.uint64)
        np.minimum.at(least, at * BINS + (grams % np.uint64(BINS)).astype(np.int64), grams)
        byte = (tx.mix(least.copy()) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        byte[least == none] = 0
        marks += [row.tobytes() for row in byte.reshape(hi - lo, BINS)]
        least = least.reshape(hi - lo, 2, BINS // 2).min(axis=1)
        for band in range(BANDS):
            minima = least[:, band::BANDS]
            key = np.full(hi - lo, band + 1, dtype=np.uint64)
            for column in minima.T:
                key = tx.mix(key * np.uint64(tx.BASE) + column)
            keys[lo:hi, band] = np.where((minima == none).all(axis=1), 0, key)
    return fps, marks, digests, keys


def _sketch_rows(batches, width):
    for batch, texts in tx.text_chunks(batches, 4 << 20):
        at = batch.schema.get_field_index
        fps, marks, digests, keys = sketches(texts, width)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64), pa.int64()))
        columns = [batch.column(at("order_id")), batch.column(at("rid")), pa.array(fps.view(np.int64), pa.int64()), pa.array(marks, pa.binary()), pa.array(digests.view(np.int64), pa.int64()), bands]
        yield pa.RecordBatch.from_arrays(columns, names=["order_id", "rid", "fp", "sketch", "digest", "bands"])


def _set_rows(batches, width):
    """(rank, the sorted hashes of the text's different shingles)."""
    for batch, texts in tx.text_chunks(batches, 1 << 20):
        words = tx.Words(texts, lower=True)
        grams, at = shingle_sets(words, words.hashes(), width)
        bounds = np.searchsorted(at, np.arange(len(texts) + 1)).tolist()
        sets = [grams[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("rank")), pa.array(sets, pa.binary())], names=["rank", "grams"])


def _alike(batches, similarity):
    """The pairs whose sets of shingles have the similarity: common ones of all different ones."""
    for batch in batches:
        col = {name: batch.column(batch.schema.get_field_index(name)) for name in ("src", "dst", "x", "y")}
        ok = []
        for x, y in zip(col["x"], col["y"]):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            few, many = sorted((len(x), len(y)))
            common = 0 if few < similarity * many else len(np.intersect1d(x, y, assume_unique=True))
            ok.append(few > 0 and common >= similarity * (few + many - common))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([col["src"].filter(keep), col["dst"].filter(keep)], names=["src", "dst"])


def _similar_links(batches, budget, similarity):
    def side(got):
        fps = _longs(got[0]).view(np.uint64)
        by = np.argsort(fps, kind="stable")
        return fps[by], _longs(got[2])[by], np.frombuffer(b"".join(got[1].to_pylist()), dtype=np.uint8).reshape(-1, BINS)[by]

    for own, other in intervals.partners(batches, ["fps", "sketches", "ranks"]):
        sides = [side(got) for got in (own, other) if got is not None]
        ranks, marks = (np.concatenate([s[k] for s in sides]) for k in (1, 2))

        def confirm(i, j, marks=marks):
            return _estimates(marks[i], marks[j]) >= similarity

        yield _edges(ranks, trie_links(sides[0][0], None if other is None else sides[1][0], budget, leaf=1 << 18, confirm=confirm))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose texts have the similarity, counted over all their shingles."""
    x, y = (sets.select(F.col("rank").alias(end), F.col("grams").alias(name)) for end, name in (("src", "x"), ("dst", "y")))
    return pairs.join(x, "src").join(y, "dst").mapInArrow(lambda it: _alike(it, similarity), "src long, dst long")


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of rows of sketches: equal bytes of those that either text fills."""
    agree = ((x == y) & (x > 0)).sum(axis=1)
    return agree / np.maximum(1, ((x > 0) | (y > 0)).sum(axis=1))


def _sketch_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _estimated(batches, floor):
    """(rank, pivot, estimate) of the pairs whose sketches come near the similarity."""
    for batch in batches:
        col = {name: batch.column(batch.schema.get_field_index(name)) for name in ("rank", "pivot", "x", "y")}
        found = _estimates(_sketch_matrix(col["x"]), _sketch_matrix(col["y"]))
        keep = pa.array(found >= floor)
        yield pa.RecordBatch.from_arrays([col["rank"].filter(keep), col["pivot"].filter(keep), pa.array(found).filter(keep)], names=["rank", "pivot", "estimate"])


def _stars(members: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """(src, dst): every member with the most similar of its buckets' least members, at most one link a member."""
    pivots = members.groupBy("bucket").agg(F.min("rank").alias("pivot"))
    pairs = members.join(pivots, "bucket").where("rank <> pivot").select("rank", "pivot").distinct()
    both = pairs.join(sketches.withColumnRenamed("sketch", "x"), "rank").join(sketches.select(F.col("rank").alias("pivot"), F.col("sketch").alias("y")), "pivot")
    near = both.mapInArrow(lambda it: _estimated(it, floor), "rank long, pivot long, estimate double")
    best = near.groupBy("rank").agg(F.max_by("pivot", F.struct("estimate", "pivot")).alias("pivot"))
    return best.select(F.col("pivot").alias("src"), F.col("rank").alias("dst"))


def _whole_tiles(batches):
    """Tables of whole tiles; rows come tile by tile, and a tile may span batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        keys = [table.column(k).to_numpy() for k in ("bucket", "i", "j")]
        starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _tile_candidates(batches, floor, best):
    """Pairs of a tile in different components whose sketches come near the similarity: all, or a text's best one per component."""
    for table in _whole_tiles(batches):
        bucket, i, j, block, rank, component = (table.column(k).to_numpy() for k in ("bucket", "i", "j", "block", "rank", "component"))
        marks, n, at = _sketch_matrix(table.column("sketch")), len(bucket), np.arange(len(bucket))
        new = np.ones(n, dtype=bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        tile = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], n)[tile]
        seconds = ends - np.bincount(tile, weights=block == j).astype(np.int64)[tile]  # of two blocks, the second one's rows are last
        first = np.where(i == j, at + 1, np.where(block == i, seconds, ends))
        lengths = ends - first
        for lo, hi in tx.chunked(lengths.tolist(), 1 << 16):
            k = lengths[lo:hi]
            x = np.repeat(at[lo:hi], k)
            y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
            apart = component[x] != component[y]
            x, y = x[apart], y[apart]
            found = _estimates(marks[x], marks[y])
            near = found >= floor
            x, y, found = x[near], y[near], found[near]
            if best:
                by = np.lexsort((-found, component[y], x))
                x, y = x[by], y[by]
                top = np.ones(len(x), dtype=bool)
                top[1:] = (x[1:] != x[:-1]) | (component[y][1:] != component[y][:-1])
                x, y = x[top], y[top]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rank[x], rank[y])), pa.array(np.maximum(rank[x], rank[y]))], names=["src", "dst"])


def _across(members: DataFrame, groups: DataFrame, sketches: DataFrame, floor: float, best: bool, block: int) -> DataFrame:
    """(src, dst): pairs of members of one bucket in different components, by their sketches.

    A bucket's largest component is not compared with itself: its blocks meet those of the other members only, and those
    meet each other. A tile is two blocks of about ``block`` members, so no bucket lies in one task.
    """
    named = members.join(groups.withColumnRenamed("node", "rank"), "rank", "left").withColumn("component", F.coalesce("component", "rank"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    open_ = open_.select("bucket", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("others"), F.ceil(F.col("main.n") / block).alias("own"), (F.col("n") <= block).alias("small"))
    rows, main, last = named.join(open_, "bucket"), F.col("component") == F.col("main"), F.col("others") + F.col("own") - 1
    own = F.when(F.col("small"), F.lit(0).cast("long")).when(main, F.col("others") + F.pmod(F.xxhash64("rank"), F.col("own"))).otherwise(F.pmod(F.xxhash64("rank"), F.col("others")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("small"), F.lit(0).cast("long")).when(main, F.col("others") - 1).otherwise(last))
    rows = rows.select("bucket", "rank", "component", own.alias("block"), meets.alias("meets")).join(sketches, "rank")
    tiles = rows.select("bucket", "rank", "component", "sketch", "block", F.explode("meets").alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    tiles = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "rank")
    return tiles.mapInArrow(lambda it: _tile_candidates(it, floor, best), "src long, dst long").distinct()


def _all_links(nominated: DataFrame, members: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float, block: int = 1_024) -> tx.Stage:
    """Confirmed links (src, dst) that connect whatever the links among ``nominated`` and inside buckets connect.

    Sets of shingles travel only for pairs whose sketches come within 0.1 of the similarity, four standard errors. First the
    nominated pairs and one star link a member; then each member with its best partner of every other component it shares a
    bucket with; last all pairs of a bucket that are still in different components. Three steps, whatever the input.
    """
    floor = similarity - 0.1
    links = tx.Stage(_confirmed(nominated.union(_stars(members, sketches, floor)).distinct(), sets, similarity), "links")
    for best in (True, False):
        groups, used = components.connected_components(links.df)
        pairs = tx.Stage(_across(members, groups, sketches, floor, best, block), "pairs")
        more = tx.Stage(links.df.union(_confirmed(pairs.df, sets, similarity)), "links")
        for stage in (links, pairs, *used):
            stage.drop()
        links = more
    return links


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, budget: int = 7, block: int = 8_192) -> DataFrame:
    """order_id, rid, component_id for every row of ``docs``: groups of texts linked by a similarity of at least
    ``similarity`` over their different shingles of ``width`` words. Texts without words are one group.

    Pairs are nominated by word fingerprints that differ in at most ``budget`` bits (with the sketch's estimate, less a
    margin of 0.04) and by equal bands of minimum shingles, which find contiguous edits as well as scattered ones.
    Only pairs whose counted similarity suffices are linked."""
    with tx.small_batches(docs.sparkSession):
        return _similar_texts(docs, width, similarity, budget, block)


def _similar_texts(docs: DataFrame, width: int, similarity: float, budget: int, block: int) -> DataFrame:
    schema = "order_id long, rid long, fp long, sketch binary, digest long, bands array<long>"
    texts = tx.identified(docs)
    rows = tx.Stage(texts.mapInArrow(lambda it: _sketch_rows(it, width), schema), "sketches")
    same = ["fp", "sketch", "digest"]
    distinct = rows.df.groupBy(*same).agg(F.min(F.struct("order_id", "rid")).alias("least"), F.any_value("bands").alias("bands"))
    ranked = tx.Stage(intervals.ranked_blocks(distinct, [_sortable("fp"), F.col("sketch"), F.col("digest")], block), "ranked")
    listed = F.collect_list(F.struct("fp", "sketch", "rank"))
    blocks = tx.Stage(ranked.df.groupBy("block").agg(F.min_by("fp", _sortable("fp")).alias("lo"), F.max_by("fp", _sortable("fp")).alias("hi"), listed.alias("x")).select("block", "lo", "hi", F.col("x.fp").alias("fps"), F.col("x.sketch").alias("sketches"), F.col("x.rank").alias("ranks")), "blocks")
    bounds = {"lo": lambda c: F.min_by("lo", _sortable("lo")), "hi": lambda c: F.max_by("hi", _sortable("hi"))}
    n_blocks = blocks.df.count()
    pairs = intervals.close_pairs(blocks.df, bounds, _prefix_near(budget), n_blocks)
    nominated = tx.Stage(intervals.with_partners(pairs, blocks.df, ["fps", "sketches", "ranks"], n_blocks).mapInArrow(lambda it: _similar_links(it, budget, similarity - 0.04), "src long, dst long").distinct(), "nominated")
    blocks.drop()
    members = ranked.df.select("rank", F.explode("bands").alias("bucket")).where("bucket <> 0")
    shared = members.groupBy("bucket").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("bucket")
    members = tx.Stage(members.join(shared, "bucket"), "members")
    named = members.df.select("rank").union(nominated.df.select("src")).union(nominated.df.select("dst")).distinct()
    named = ranked.df.select("rank", "least.order_id", "least.rid").join(named, "rank")
    sets = tx.Stage(texts.join(named, ["order_id", "rid"]).select("rank", "text").mapInArrow(lambda it: _set_rows(it, width), "rank long, grams binary").dropDuplicates(["rank"]), "sets")
    links = _all_links(nominated.df, members.df, ranked.df.select("rank", "sketch"), sets.df, similarity)
    groups, _ = components.connected_components(links.df)
    for stage in (nominated, members, sets, links):
        stage.drop()
    known = ranked.df.select(*same, F.col("least.order_id").alias("least"), "rank").join(groups.withColumnRenamed("node", "rank"), "rank", "left").withColumn("component", F.coalesce("component", "rank"))
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(*same, "component_id")
    return rows.df.join(named, same).select("order_id", "rid", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The whole of documents with 4-word shingles and 4 differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(tx.public_id(F.col("order_id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), tx.public_id(F.col("component_id")).alias("component_id"))
