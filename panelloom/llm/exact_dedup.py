"""Exact duplicates by content sort, in DataFrame operations only.

Rows are range-partitioned on a bounded key of the normalised bytes (their first bytes and SHA-256) by sampled
splitters, sorted externally so that equal texts are adjacent, and each text is compared in full with its
neighbour. A text that fills more than an average partition is spread over several salts; the heads of its runs
are compared in full again in a second, small sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, shared_path, shared_root, shuffle_partitions, text_of, written

#: Bytes of the text that lead the sort key; splitters stay this small whatever the texts are.
KEY_BYTES = 16


def _keyed(docs: DataFrame, id_col: str, text: Column, partitions: int, keep: str) -> DataFrame:
    """docs with digest, salt and number of salts, range-partitioned by content."""
    keyed = docs.withColumn(f"{P}id", F.col(id_col)).withColumn(f"{P}text", text)
    keyed = keyed.withColumn(f"{P}digest", F.unhex(F.sha2(f"{P}text", 256))).withColumn(
        f"{P}prefix", F.substring(F.encode(f"{P}text", "UTF-8"), 1, KEY_BYTES)
    )
    share = max(1.0, docs.count() / partitions)
    # Fewer than `partitions` texts can each hold more than an average partition, so this side is bounded.
    hot = (
        keyed.groupBy(f"{P}digest")
        .count()
        .filter(F.col("count") > share)
        .select(F.col(f"{P}digest").alias(f"{P}hot"), F.ceil(2 * F.col("count") / share).alias(f"{P}salts"))
    )
    keyed = keyed.join(F.broadcast(hot), F.col(f"{P}digest") == F.col(f"{P}hot"), "left").drop(f"{P}hot")
    keyed = keyed.withColumn(
        f"{P}salt", F.coalesce(F.pmod(F.xxhash64(f"{P}id"), F.col(f"{P}salts")), F.lit(0)).cast("long")
    )
    return keyed.repartitionByRange(partitions, f"{P}prefix", f"{P}digest", f"{P}salt")


def _best_first(column: str, keep: str) -> Column:
    return F.col(column).desc_nulls_last() if keep == "largest" else F.col(column).asc_nulls_last()


def _runs(keyed: DataFrame, keep: str) -> DataFrame:
    """Marks the head of each run of equal texts: each text is compared in full with the one before it."""
    by = Window.partitionBy(f"{P}prefix", f"{P}digest", f"{P}salt").orderBy(f"{P}text", _best_first(f"{P}id", keep))
    before = F.lag(f"{P}text").over(by)
    return keyed.withColumn(f"{P}head", before.isNull() | (before != F.col(f"{P}text"))).withColumn(
        f"{P}run", F.sum(F.col(f"{P}head").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are copies of each other. Of rows with equal text the one with the smallest
    (or keep="largest") id stays; null ids lose, and of fully repeated rows exactly one stays. normalise is
    the Column that equality is judged on, by default the text itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_root(spark)
    n = partitions or shuffle_partitions(spark)
    narrow = docs.select(id_col, text_col)
    keyed = _keyed(narrow, id_col, text_of(text_col) if normalise is None else normalise, n, keep)
    runs = _runs(keyed, keep).select(
        *(f"{P}{c}" for c in ("id", "prefix", "digest", "salt", "salts", "run", "head")),
        F.when(F.col(f"{P}head") & F.col(f"{P}salts").isNotNull(), F.col(f"{P}text")).alias(f"{P}text"),
    )
    run = Window.partitionBy(f"{P}prefix", f"{P}digest", f"{P}salt", f"{P}run")
    slim = runs.select(
        f"{P}id", f"{P}digest", f"{P}salt", f"{P}run", f"{P}text",
        F.row_number().over(run.orderBy(F.col(f"{P}head").desc(), _best_first(f"{P}id", keep))).alias(f"{P}rank"),
        F.max(F.when(F.col(f"{P}head"), F.struct(f"{P}id"))).over(run).getField(f"{P}id").alias(f"{P}first"),
        F.count(F.lit(1)).over(run).alias(f"{P}size"),
    )
    slim = written(slim, shared_path(spark, "exact"))

    text = Window.partitionBy(f"{P}digest").orderBy(f"{P}text", _best_first(f"{P}first", keep), f"{P}salt")
    before = F.lag(f"{P}text").over(text)
    heads = (
        slim.filter(F.col(f"{P}text").isNotNull())
        .withColumn(f"{P}new", (before.isNull() | (before != F.col(f"{P}text"))).cast("int"))
        .withColumn(f"{P}group", F.sum(f"{P}new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    )
    group = Window.partitionBy(f"{P}digest", f"{P}group")
    # At most two heads for each average partition: a bounded side again.
    merged = heads.select(
        f"{P}digest", f"{P}salt", f"{P}run",
        (F.col(f"{P}new") == 1).alias(f"{P}wins"),
        F.max(F.when(F.col(f"{P}new") == 1, F.struct(f"{P}first"))).over(group).getField(f"{P}first").alias(f"{P}best"),
        F.sum(f"{P}size").over(group).alias(f"{P}total"),
    )
    out = slim.join(F.broadcast(merged), [f"{P}digest", f"{P}salt", f"{P}run"], "left")
    hot = F.col(f"{P}total").isNotNull()
    return out.select(
        F.col(f"{P}id").alias(id_col),
        F.when(hot, F.col(f"{P}best")).otherwise(F.col(f"{P}first")).alias("keep_id"),
        F.coalesce(f"{P}total", f"{P}size").cast("long").alias("group_size"),
        ((F.col(f"{P}rank") == 1) & F.coalesce(f"{P}wins", F.lit(True))).alias("kept"),
        F.lower(F.hex(f"{P}digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None
) -> DataFrame:
    """The rows that stay, with all their columns; texts are as they were (null stays null)."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    heads = _runs(_keyed(docs, id_col, text_of(text_col), n, keep), keep).filter(f"{P}head")
    spread = heads.filter(F.col(f"{P}salts").isNotNull())
    text = Window.partitionBy(f"{P}digest").orderBy(f"{P}text", _best_first(f"{P}id", keep), f"{P}salt")
    before = F.lag(f"{P}text").over(text)
    first = spread.withColumn(f"{P}new", before.isNull() | (before != F.col(f"{P}text"))).filter(f"{P}new")
    return heads.filter(F.col(f"{P}salts").isNull()).select(*docs.columns).unionByName(first.select(*docs.columns))
