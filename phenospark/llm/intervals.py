"""Joining a sorted sequence with itself by intervals: blocks of consecutive rows, and a recursion that skips far pairs.

The sequence is range-partitioned and cut into blocks, so neither a hot value nor a hot region makes a large block. Blocks
are numbered in order; every 16 form an interval of the next level. Pairs of intervals are split level by level, and a pair
is dropped as soon as its bounds prove that nothing inside can match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenospark.llm.texts import Stage

FAN = 16


def ranked_blocks(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The rows with ``rank`` in the given order and ``block``: consecutive numbers of runs of ``limit`` rows.

    Positions are counted within the sort's partitions and shifted by the sizes of earlier ones; the only window runs over
    one row per partition.
    """
    parts = max(1, -(-rows.count() // (16 * limit)))
    sorted_ = Stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    placed = sorted_.df.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(2**33 - 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(before, "part").withColumn("rank", F.col("before") + F.col("at")).withColumn("block", F.floor(F.col("rank") / limit)).drop("before", "part", "at")


def close_pairs(blocks: DataFrame, bounds: dict[str, Callable[[str], Column]], may_match: Callable[[str, str], Column], n_blocks: int) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold matches.

    ``bounds`` says how each bound of an interval follows from those of its children; ``may_match(a, b)`` gets the prefixes
    of the two sides' columns.
    """
    levels = [blocks.select(F.col("block").alias("id"), *bounds)]
    width = n_blocks
    while width > 1:
        up = levels[-1].withColumn("id", F.floor(F.col("id") / FAN))
        levels.append(up.groupBy("id").agg(*(combine(name).alias(name) for name, combine in bounds.items())))
        width = -(-width // FAN)
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in levels[-2::-1] if len(levels) > 1 else []:
        side = lambda p: level.select(F.floor(F.col("id") / FAN).alias(p), F.col("id").alias(f"{p}id"), *(F.col(n).alias(f"{p}_{n}") for n in bounds))  # noqa: B023, E731
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("aid <= bid").where(may_match("a_", "b_")).select(F.col("aid").alias("a"), F.col("bid").alias("b"))
    return pairs


def owners_width(n_blocks: int) -> int:
    """Neighbouring blocks that one owner holds; blocks travel once per owner, so their copies grow more slowly than pairs."""
    return max(1, int((n_blocks / 16) ** 0.5))


def with_partners(pairs: DataFrame, blocks: DataFrame, contents: list[str], n_blocks: int, width: int | None = None) -> DataFrame:
    """(owner, other, mine, contents of other): blocks that the owner's blocks ``mine`` are paired with, its own blocks first.

    An owner is a run of ``width`` neighbouring blocks and owns about half the pairs of its blocks with others. A task streams
    partners past the owner's blocks, so a block is sent once per owner and a task holds the owner's blocks and one more.
    """
    width = width or owners_width(n_blocks)
    run = lambda c: F.floor(F.col(c) / width)
    of_a = (run("a") + run("b")) % 2 == 0  # blocks of one run: the later one comes to the earlier one
    owned = pairs.select(F.when(of_a, run("a")).otherwise(run("b")).alias("owner"), F.when(of_a, F.col("a")).otherwise(F.col("b")).alias("mine"), "a", "b")
    owned = owned.select("owner", "mine", (F.col("a") + F.col("b") - F.col("mine")).alias("block"))
    owned = owned.groupBy("owner", "block").agg(F.sort_array(F.collect_set("mine")).alias("mine"))
    rows = owned.join(blocks.select("block", *contents), "block").select("owner", F.col("block").alias("other"), "mine", *contents)
    return rows.repartition(max(1, 4 * n_blocks), "owner").sortWithinPartitions("owner", F.floor(F.col("other") / width) != F.col("owner"), "other")


def partners(batches, contents: list[str]):
    """(own contents, other's contents or None for the pair of a block with itself), as Arrow values."""
    owner, own = None, {}
    for batch in batches:
        col = [batch.column(batch.schema.get_field_index(n)) for n in ("owner", "other", "mine", *contents)]
        for row in range(batch.num_rows):
            now, other, mine = (c[row].as_py() for c in col[:3])
            got = [c[row].values for c in col[3:]]
            if now != owner:
                owner, own = now, {}
            if other in mine:  # every block is paired with itself, at its owner
                own[other] = got
            for block in mine:
                assert block in own, "an owner's blocks come before their partners"
                yield own[block], None if block == other else got
