"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers; each attribute less its block's minimum is held as bitmaps, one for each binary digit, over the
block's rows, and these are what is stored. A query is a weighted sum of attributes: bitmaps are added by carry-save
adders, which gives the score's digits as bitmaps again. The top rows are then selected from the most significant digit downward, and
rows that tie at the boundary are resolved exactly by id. Each block leaves k rows for each query, and those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, remove, shared_path, shared_root, shuffle_partitions, written

#: Rows in a block of the index, vectors in a block of queries, and components in either. They bound what a task holds.
BLOCK_ROWS = 1 << 16
BLOCK_QUERIES = 256
BLOCK_COMPONENTS = 1 << 22


def sliced(ids: np.ndarray, values: np.ndarray) -> dict:
    """The index over some rows: ids in order, and of each attribute its minimum, number of binary digits and their bitmaps end to end."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(0)
    bits, slices = [], []
    for d in range(values.shape[1]):
        # Unsigned, as the difference of two 64-bit integers may take all 64 bits.
        column = values[:, d].astype(np.uint64) - np.uint64(int(low[d]) & (2**64 - 1))
        bits.append(int(column.max()).bit_length())
        slices += [_bitmap((column >> np.uint64(b)) & np.uint64(1)) for b in range(bits[-1])]
    return {"ids": ids, "low": low, "bits": np.array(bits, np.int32), "slices": np.concatenate([*slices, np.empty(0, np.uint64)]).tobytes()}


def _bitmap(bits: np.ndarray) -> np.ndarray:
    packed = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    own = np.packbits(bits.astype(bool), bitorder="little")
    packed[: len(own)] = own
    return packed.view(np.uint64)


class Block:
    """Selection by the stored bitmaps of some rows."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: bytes):
        self.ids, self.low = ids, [int(x) for x in low]
        self.n, self.words = len(ids), -(-len(ids) // 64)
        bitmaps = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        self.slices = np.split(bitmaps, np.cumsum(bits)[:-1])

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Digits of sum(weight * attribute) less a constant, lowest first, and that constant."""
        levels: list[list[np.ndarray]] = []
        base = 0
        for d in np.flatnonzero(weights):
            w, own = int(weights[d]), self.slices[d]
            # A negative weight counts what is missing to the largest number of so many digits: its bitmaps are the others' complement.
            base += w * (self.low[d] + (0 if w > 0 else (1 << len(own)) - 1))
            slices = own if w > 0 else ~own
            for a in range(abs(w).bit_length()):
                if abs(w) >> a & 1:
                    for b, bitmap in enumerate(slices):
                        while len(levels) <= a + b:
                            levels.append([])
                        levels[a + b].append(bitmap)
        digits: list[np.ndarray] = []
        at = 0
        while at < len(levels):
            own, carry = levels[at], levels[at + 1] if at + 1 < len(levels) else []
            while len(own) > 2:
                x, y, z = own.pop(), own.pop(), own.pop()
                xy = x ^ y
                carry.append((x & y) | (xy & z))
                own.insert(0, xy ^ z)
            if len(own) == 2:
                x, y = own
                carry.append(x & y)
                own = [x ^ y]
            digits.append(own[0] if own else np.zeros(self.words, np.uint64))
            if carry and at + 1 == len(levels):
                levels.append(carry)
            at += 1
        return digits, base

    def top(self, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id."""
        digits, base = self.sums(weights)
        tied = _bitmap(np.ones(self.n, bool))
        if without is not None:
            own = np.searchsorted(self.ids, without), np.searchsorted(self.ids, without, "right")
            if own[0] < own[1]:
                mask = np.ones(self.n, bool)
                mask[own[0] : own[1]] = False
                tied = _bitmap(mask)
        sure = np.zeros(self.words, np.uint64)
        missing = k
        for digit in reversed(digits):
            ones = tied & digit
            count = int(np.bitwise_count(ones).sum())
            if count > missing:
                tied = ones
            else:
                sure |= ones
                missing -= count
                tied &= ~digit
                if not missing:
                    break
        rows = self._rows(sure)
        if missing:
            rows = np.concatenate([rows, self._rows(tied)[:missing]])  # rows are in order of id
        ones = [((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) for digit in digits]
        if len(digits) < 62 and abs(base) < 1 << 61:
            return self.ids[rows], sum((o << b for b, o in enumerate(ones)), np.full(len(rows), base, np.int64))
        exact = [base + sum(int(o[i]) << b for b, o in enumerate(ones)) for i in range(len(rows))]
        return self.ids[rows], np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * component) of vectors that are whole and finite; the others take no part."""
    x = F.col(vector_col)
    finite = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias(f"{P}id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias(f"{P}v"),
    )


def top_k(
    vectors: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    query_every: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by query_every the k best other rows.

    Rows of the query's own id are no candidates of it. A table with fewer rows gives all of them; a null or broken vector
    neither asks nor answers; vectors of another length than the query's do not answer it. Of repeated ids each row
    is a candidate. Components whose multiple has over 64 bits count as the nearest that has not, and so do scores.

    The index is stored, its bitmaps in blocks of rows. Blocks of queries are sent to each of them, a copy of the
    queries for each 65,536 rows; the index itself moves once.
    """
    spark = vectors.sparkSession
    shared_root(spark)
    made = [shared_path(spark, label) for label in ("vectors", "index")]
    rows = written(quantised(vectors, id_col, vector_col, scale).withColumn("d", F.size(f"{P}v")), made[0])
    asked = F.pmod(F.col(f"{P}id"), F.lit(query_every)) == 0
    size = rows.agg(F.count(F.lit(1)), F.sum("d"), F.count(F.when(asked, 1))).first()
    n_blocks = max(1, -(-size[0] // block_rows), -(-(size[1] or 0) // BLOCK_COMPONENTS))
    n_query_blocks = max(1, -(-size[2] // block_queries), -(-(size[1] or 0) // query_every // BLOCK_COMPONENTS))
    # Few blocks of rows are worked on by several tasks each, which share out the blocks of queries.
    stripes = min(n_query_blocks, -(-shuffle_partitions(spark) // n_blocks))
    row = F.monotonically_increasing_id()  # spreads rows of one id, too
    index = _packed(rows.withColumn("b", F.pmod(F.xxhash64(row), F.lit(n_blocks)).cast("int")), "b")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, d, ids, flat in batch.itertuples(index=False):
                yield pd.DataFrame([{"b": b, "d": d, **sliced(ids, flat.reshape(-1, d))}])

    index = written(index.select("b", "d", "ids", "flat").mapInPandas(build, "b int, d int, ids array<long>, low array<long>, bits array<int>, slices binary"), made[1])
    queries = _packed(rows.filter(asked).withColumn("q", F.pmod(F.xxhash64(row, F.lit(1)), F.lit(n_query_blocks)).cast("int")), "q")
    columns = {"ids": "array<long>", "low": "array<long>", "bits": "array<int>", "slices": "binary", "flat": "array<long>"}

    def side(df: DataFrame, block, stripe, kind: int) -> DataFrame:
        own = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        out = df.select(block.alias("b"), "d", *([F.col("q")] if kind else [F.lit(None).cast("int").alias("q")]), F.lit(kind).alias("kind"), *own)
        return out.withColumn("stripe", stripe).withColumn("place", F.col("b") * F.lit(stripes) + F.col("stripe"))

    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    every_stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    both = side(index, F.col("b"), every_stripe, 0).unionByName(side(queries, every_block, F.pmod("q", F.lit(stripes)), 1))
    # A task has a block's bitmaps first and then, one after the other, the queries.
    tasks = both.repartitionById(n_blocks * stripes, "place").sortWithinPartitions("place", "d", "kind", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, block = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    held, block = (row.place, row.d), Block(row.ids, row.low, row.bits, row.slices)
                elif held == (row.place, row.d):
                    out = []
                    for query, w in zip(row.ids, row.flat.reshape(-1, row.d), strict=True):
                        found, scores = block.top(w, k, int(query))
                        out.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": scores}))
                    yield pd.concat(out)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = tasks.select("place", "d", "kind", *columns).mapInPandas(run, "query_id long, vec_id long, score long")
    # A query's candidates number k for each block.
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = written(found, shared_path(spark, "found"))
    for path in made:
        remove(spark, path)
    return out


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per block and length: ids, and the vectors end to end."""
    lists = rows.groupBy(key, "d").agg(F.collect_list(F.struct(F.col(f"{P}id").alias("i"), F.col(f"{P}v").alias("v"))).alias("own"))
    return lists.select(
        key, "d", F.transform("own", lambda r: r["i"]).alias("ids"), F.flatten(F.transform("own", lambda r: r["v"])).alias("flat")
    )
