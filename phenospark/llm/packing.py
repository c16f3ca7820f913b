"""Bounded-space online packing.

Texts become token ids with an end id; longer ones are cut into pieces of a full sequence and a rest. Pieces are dealt to
groups by hash, so that neither a source nor a copy makes a hot group. Each group streams its pieces past a fixed number of
open windows: a piece goes into the fullest window it fits (best fit), and when none fits and no window may be added, the
fullest is emitted. The windows still open at the end of the groups are merged: their pieces, few per group, are dealt to
fewer groups, longest first, round after round until one group is left.

Rows: one per piece. NULL text is empty and still has its end id. Every row is packed, copies too.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx, tokens

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "sequence_id long, offset long, is_open boolean"


def _pieces(batches, vocabulary: str, end_id: int, size: int, with_ids: bool):
    encoder = tokens.encoder(vocabulary)
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        for lo, hi in tx.chunked(pc.binary_length(batch.column(1)).to_pylist(), 4 << 20):
            ids, texts = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for own, line in zip(ids, encoder.encode(texts)):
                line += end
                for a in range(0, len(line), 4 * size):
                    piece = line[a:a + 4 * size]
                    for k, v in zip(out, (own, a // 4, len(piece) // 4, zlib.crc32(piece), len(line) // 4, piece if with_ids else None)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))


class Windows:
    """At most ``most`` open windows, ordered by free room."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open = size, most, []
        self.count = 0

    def place(self, piece, length: int):
        """Puts a piece; returns a window that is full or has to go, as (number, [(offset, piece)])."""
        gone = None
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number, held = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                gone = self.open.pop(0)
            room, number, held = self.size, self.count, []
            self.count += 1
        held.append((self.size - room, piece))
        if room == length:
            yield number, held
        else:
            bisect.insort(self.open, (room - length, number, held))
        if gone:
            yield gone[1], gone[2]

    def rest(self):
        for _, number, held in self.open:
            yield number, held
        self.open = []


def _pack(batches, size: int, most: int, base: int, last: bool, names: list[str]):
    """Streams rows that come group by group; answers them with sequence_id, offset and whether the window is still open."""
    state = {"group": None, "windows": None}
    rows: list = []

    def emit(group, windows, is_open):
        for number, held in windows:
            sequence = ((base + group) << 32) + number
            rows.extend((piece, sequence, offset, is_open) for offset, piece in held)

    def flush(columns):
        data = list(zip(*(piece for piece, *_ in rows))) or [[] for _ in names]
        arrays = [pa.array(list(v), columns[n]) for n, v in zip(names, data)]
        arrays += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset", "is_open"])

    columns = None
    for batch in batches:
        columns = {n: batch.schema.field(n).type for n in names}
        groups = batch.column(batch.schema.get_field_index("pack_group")).to_pylist()
        lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
        for group, length, piece in zip(groups, lengths, zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))):
            if group != state["group"]:
                if state["windows"]:
                    emit(state["group"], state["windows"].rest(), not last)
                state = {"group": group, "windows": Windows(size, most)}
            emit(group, state["windows"].place(piece, length), False)
        yield flush(columns)
    if state["windows"]:
        emit(state["group"], state["windows"].rest(), not last)
        yield flush(columns)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, size: int = 4096, most_open: int = 64,
         group_tokens: int = 4_000_000, merge_pieces: int = 20_000, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = rows.mapInArrow(lambda it: _pieces(it, vocabulary, end_id, size, with_ids), PIECE_SCHEMA)
    names = [n for n in cut.columns if with_ids or n != "ids"]
    todo = tx.Stage(cut.select(*names).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = tx.parts(todo.df.agg(F.sum("length")).first()[0] or 0, group_tokens)
    schema = ", ".join(f"{n} {t}" for n, t in todo.df.select(*names).dtypes) + f", {PLACED}"
    done, base, stages = None, 0, []
    while True:
        last = groups == 1
        first_round = done is None
        order = [F.xxhash64("piece")] if first_round else [F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
        key = F.xxhash64("piece") if first_round else F.xxhash64("sequence_id", "offset")
        dealt = todo.df.withColumn("pack_group", F.pmod(key, F.lit(groups))).repartition(max(1, groups), "pack_group").sortWithinPartitions("pack_group", *order)
        open_windows = most_open if first_round else merge_pieces
        placed = tx.Stage(dealt.mapInArrow(lambda it, m=open_windows, b=base, e=last: _pack(it, size, m, b, e, names), schema), "packed")
        stages.append(placed)
        closed = placed.df.where("not is_open").drop("is_open")
        done = closed if done is None else done.union(closed)
        if last:
            return done
        base += groups
        left = placed.df.where("is_open").drop("is_open")
        groups = min(max(1, groups // 2), tx.parts(left.count(), merge_pieces))
        todo = tx.Stage(left, "left")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """The whole of documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
