"""Mixing of sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, WORD_PATTERN, text_of

#: Rows of one source and one range of sizes are dealt over this many blocks, so that no source is ordered in one task.
SALTS = 1024


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(text_of(text_col), F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def random_offset(seed: int) -> float:
    """Between 0 and 1, in 16 binary digits."""
    return random.Random(seed).getrandbits(16) / 65536


def source_targets(sources: DataFrame, source_col: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Source and target from the size of each source: one row per source.

    Sources in code point order (null last) take the weights in turn. Targets are in proportion to the weights, and
    what a target would hold over `most` times its source's size is shared out again by weight: each target is
    min(cap, level * weight), and the level follows from one pass over the sources ordered by cap / weight.
    """
    at = Window.orderBy(F.col(source_col).asc_nulls_last())
    by_cap = Window.orderBy(f"{P}ratio", F.col(source_col).asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    turn = (F.row_number().over(at) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")).cast("double")
    sources = sources.withColumn(f"{P}weight", weight).withColumn(f"{P}cap", most * F.col(f"{P}source_size")).withColumn(
        f"{P}ratio", F.col(f"{P}cap") / F.col(f"{P}weight")
    )
    wanted = share * F.sum(f"{P}source_size").over(every)
    sources = sources.withColumn(
        f"{P}level",
        (wanted - F.coalesce(F.sum(f"{P}cap").over(before), F.lit(0.0)))
        / (F.sum(f"{P}weight").over(every) - F.coalesce(F.sum(f"{P}weight").over(before), F.lit(0.0))),
    )
    open_level = F.max(F.when(F.col(f"{P}level") <= F.col(f"{P}ratio"), F.col(f"{P}level"))).over(every)
    return sources.select(
        F.col(source_col).alias(f"{P}source"),
        F.least(F.col(f"{P}cap"), F.coalesce(open_level * F.col(f"{P}weight"), F.col(f"{P}cap"))).alias(f"{P}target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    prefix: str = "",
) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size), each name after the prefix.

    Within a source, rows are ordered by (range of sizes, id modulo SALTS, size, id). Each row expects
    target / source_size copies; it gets one for each integer that offset + the running sum of expected copies
    crosses; the offset is drawn once, from seed, so reruns agree. Null ids count as 0 for the order, null texts have size 0, a source without words has target 0.
    The offset has 16 binary digits, so sums stay exact where the rate is `most` and no row gets more than that.
    Columns of docs that are named like the new ones are replaced.
    """
    new = [f"{prefix}{c}" for c in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.drop(*(c for c in new if c not in (id_col, text_col, source_col))).withColumn(f"{P}size", word_count(text_col))
    bits = F.length(F.bin(f"{P}size"))
    # Never null, so that the join below asks no filter that counts the words again.
    size_range = bits * 16 + F.floor(F.col(f"{P}size") / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0))))
    spread = sized.withColumn(f"{P}range", F.coalesce(size_range.cast("long"), F.lit(0).cast("long"))).withColumn(
        f"{P}salt", F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(SALTS)).cast("int")
    )
    block = [source_col, f"{P}range", f"{P}salt"]
    in_block = Window.partitionBy(*block).orderBy(f"{P}size", F.col(id_col).asc_nulls_first())
    numbered = spread.withColumn(f"{P}nth", F.row_number().over(in_block))

    # Bounded: a source has at most (ranges * SALTS) blocks, however many rows.
    counts = spread.groupBy(*block).agg(F.count(F.lit(1)).alias(f"{P}count"), F.sum(f"{P}size").alias(f"{P}words"))
    ahead = Window.partitionBy(source_col).orderBy(f"{P}range", f"{P}salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(source_col).alias(f"{P}s"), F.col(f"{P}range").alias(f"{P}r"), F.col(f"{P}salt").alias(f"{P}t"),
        F.coalesce(F.sum(f"{P}count").over(ahead), F.lit(0)).alias(f"{P}start"),
        F.sum(f"{P}words").over(Window.partitionBy(source_col)).cast("long").alias(f"{P}source_size"),
    )
    # The first block of a source stands for it: its sizes come from the same scan and exchanges as the starts.
    sources = starts.filter(F.col(f"{P}start") == 0).select(f"{P}s", f"{P}source_size")
    targets = source_targets(sources, f"{P}s", weights, share, most)
    starts = starts.join(targets, F.col(f"{P}s").eqNullSafe(F.col(f"{P}source")))
    placed = numbered.join(
        starts,
        F.col(source_col).eqNullSafe(F.col(f"{P}s")) & (F.col(f"{P}range") == F.col(f"{P}r")) & (F.col(f"{P}salt") == F.col(f"{P}t")),
    )
    rate = F.when(F.col(f"{P}source_size") > 0, F.col(f"{P}target") / F.col(f"{P}source_size")).otherwise(F.lit(0.0))
    i = (F.col(f"{P}start") + F.col(f"{P}nth")).cast("double")
    offset = random_offset(seed)
    copies = (F.floor(F.lit(offset) + rate * i) - F.floor(F.lit(offset) + rate * (i - 1.0))).cast("long")
    kept = [c for c in docs.columns if c not in new or c in (id_col, text_col, source_col)]
    made = [F.col(f"{P}size"), F.col(f"{P}source_size"), F.col(f"{P}target"), F.col(f"{P}copies"), F.col(f"{P}copies") * F.col(f"{P}size")]
    return placed.withColumn(f"{P}copies", copies).select(*kept, *(c.alias(n) for c, n in zip(made, new, strict=True)))


def emit(mixed: DataFrame, columns: list[str], copies_col: str = "copies") -> DataFrame:
    """Each row as often as its copies say."""
    return (
        mixed.filter(F.col(copies_col) > 0)
        .withColumn(f"{P}copy", F.explode(F.sequence(F.lit(1), F.col(copies_col).cast("int"))))
        .select(*columns)
    )
