"""Near duplicates: DartMinHash signatures, banded joining, exact check of the shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, giving_back, remove, shared_path, shared_root, text_of, written
from .components import components
from .dartminhash import cells, mix, salt, signatures

WORDS, SIMILARITY = 5, 0.8
#: 28 bands of 5 coordinates: two texts of similarity 0.8 share a band with probability 1 - 1.5e-5.
BANDS, BAND_ROWS = 28, 5
#: In buckets of up to so many texts all pairs are checked.
SMALL = 24
#: Further leaders of larger buckets that texts of other classes are checked with.
LEADERS = 8
#: Rows, and shingles for which signatures are thrown, at once.
ROWS_AT_ONCE, AT_ONCE = 256, 100_000
#: Bits of a shingle's hash that are compared in full: two of a text of 10,000 fall together with probability 2e-7.
CELL_BITS = 48
#: Rows of one bucket that go to one task in a join with what is known of the bucket.
SALT_ROWS = 512
#: Bits of the filter for the rows that are cut into shingles again: so many a row, rounded up to a power of two, within these bounds.
FILTER_BITS_A_ROW, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Texts and shingles of a block in the full comparison of large buckets, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1_000_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def shingles(text: str | None, words: int = WORDS, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of a text's runs of five words, and how often each occurs; a shorter text is one run, an empty one has none."""
    own = (text or "").encode("utf-8", "replace").split()
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map((known if known is not None else _Words()).__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = mix(out * np.uint64(0x100000001B3) + h[i : i + n])
    return np.unique(out, return_counts=True)


def unit_cells(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weighted set of shingles as a plain one: a number for each occurrence, so that plain similarity of these is the weighted one."""
    return np.unique(cells(elements, counts)[1] >> np.uint64(64 - CELL_BITS)).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and its hashes alone and with the id."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return rows.select("id", "t", F.xxhash64("t").alias("text_hash"), F.xxhash64("id", "t", F.lit(5)).alias("row_hash"))


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, band_rows: int, by_count: bool) -> DataFrame:
    """uid, id, hashes of the text and the row, hash of the shingle set, its size and band keys, for every document."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, no_id boolean, text_hash long, row_hash long, set_hash binary, n int, bands array<long>"

    def some_rows(batch: pd.DataFrame, known: _Words) -> pd.DataFrame:
        prime = np.uint64(0x100000001B3)
        own = [shingles(t, words, known) for t in batch["t"]]
        if not by_count:
            own = [(elements, np.ones_like(counts)) for elements, counts in own]
        keys = np.zeros((len(own), bands), np.uint64)
        low = 0
        while low < len(own):
            high, n = low, 0
            while high < len(own) and (high == low or n + len(own[high][0]) <= AT_ONCE):
                n += len(own[high][0])
                high += 1
            some = [i for i in range(low, high) if len(own[i][0])]
            if some:
                sets = np.repeat(np.arange(len(some)), [len(own[i][0]) for i in some])
                elements, weights = (np.concatenate([own[i][c] for i in some]) for c in (0, 1))
                sig = signatures(elements, sets, len(some), bands * band_rows, weights.astype(float) if by_count else None)
                key = np.zeros((len(some), bands), np.uint64)
                for r in range(band_rows):
                    key = mix(key * prime + sig[:, r::band_rows])
                keys[some] = key + np.array([salt(b + 1) for b in range(bands)])
            low = high
        return pd.DataFrame({
            "id": batch["id"],
            "no_id": batch["no_id"],
            "text_hash": batch["text_hash"],
            "row_hash": batch["row_hash"],
            "set_hash": [xxhash.xxh128_digest(np.sort(cells(*s)[1]).tobytes()) for s in own],
            "n": [len(unit_cells(*s)) for s in own],
            "bands": [k.view(np.int64) if len(elements) else np.empty(0, np.int64) for (elements, _), k in zip(own, keys, strict=True)],
        })

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            for low in range(0, len(batch), ROWS_AT_ONCE):
                yield some_rows(batch.iloc[low : low + ROWS_AT_ONCE], known)

    rows = _rows(docs, id_col, text_col).withColumn("no_id", F.col("id").isNull())
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # Pandas holds whole numbers beside nulls as doubles, which keep 53 bits.
        rows = rows.withColumn("id", F.coalesce("id", F.lit(0).cast(kind)))
    found = rows.mapInPandas(run, schema).withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id")
    return found.withColumn("uid", F.monotonically_increasing_id())


def _filtered(rows: DataFrame, met: DataFrame, n_met: int) -> DataFrame:
    """Rows whose row_hash is one of met's, and a few others: a bitmap of bounded size goes to the rows, so that only these are shuffled."""
    bits = min(max(1 << (max(1, n_met) * FILTER_BITS_A_ROW - 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod("row_hash", F.lit(bits))
    part, at = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit(32767))
    bitmaps = met.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("part", part).join(F.broadcast(bitmaps), "part")
    return found.filter(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at.bitwiseAND(F.lit(7)))), F.lit(2)) == 1).select(*rows.columns)


def cells_of(rows: DataFrame, met: DataFrame, n_met: int, words: int, by_count: bool) -> DataFrame:
    """uid and cells of met (uid, text_hash, row_hash), whose texts are read and cut into shingles again.

    Most texts share a band with no other, so keeping the cells of all takes far more disk than reading texts twice.
    """
    same = _filtered(rows, met, n_met).join(met, ["text_hash", "row_hash"])
    # Repeated rows are one.
    once = same.groupBy("text_hash", "row_hash", "uid").agg(F.first("t").alias("t")).select("uid", "t")

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            for low in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[low : low + ROWS_AT_ONCE]
                own = [shingles(t, words, known) for t in part["t"]]
                yield pd.DataFrame({"uid": part["uid"], "shingles": [unit_cells(e, c if by_count else np.ones_like(c)) for e, c in own]})

    return once.mapInPandas(run, "uid long, shingles array<long>")


def _small_pairs(members: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """All pairs of each bucket of 2 to SMALL texts whose sizes allow the similarity."""
    few = members.join(counts.filter(F.col("c").between(2, SMALL)).select("key"), "key")
    lists = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("uid", "n"))).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y: (y["uid"] > x["uid"]) & (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]))),
                                                  lambda y: F.struct(x["uid"].alias("a"), y["uid"].alias("b"))))
    )
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _salts() -> Column:
    return F.ceil(F.col("c") / F.lit(SALT_ROWS)).cast("int")


def _with_bucket(members: DataFrame, of_key: DataFrame) -> DataFrame:
    """Rows of buckets joined with one row per bucket (key, c, ...), the rows of a large bucket over several tasks."""
    spread = members.withColumn("salt", F.pmod(F.xxhash64("uid"), _salts()).cast("int"))
    copied = of_key.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts() - 1))).drop("c")
    return spread.join(copied, ["key", "salt"])


def _leader_pairs(members: DataFrame, similarity: float, seeds: list[int]) -> DataFrame:
    """Each text of a bucket with those leaders of the bucket that it may be linked to and is not classed with yet.

    A leader for each seed is drawn by hash, with partial aggregation before the shuffle. The hash is of the text alone, so buckets
    that hold much the same texts have the same leaders and ask for the same pairs.
    """
    me = F.struct(F.col("uid").alias("uid"), F.col("n").alias("n"), F.col("root").alias("root"))
    leaders = members.groupBy("key").agg(F.first("c").alias("c"), *(F.min_by(me, F.xxhash64("uid", F.lit(s))).alias(f"l{s}") for s in seeds))
    fits = F.filter(
        F.array_distinct(F.array(*(F.col(f"l{s}") for s in seeds))),
        lambda x: (x["uid"] != F.col("uid")) & (x["root"] != F.col("root")) & (F.least("n", x["n"]) >= similarity * F.greatest("n", x["n"])),
    )
    rows = _with_bucket(members, leaders).select("uid", F.explode(fits).alias("l"))
    return rows.select(F.least("uid", "l.uid").alias("a"), F.greatest("uid", "l.uid").alias("b"))


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose shingle sets have the similarity, by full comparison."""
    left = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def linked_roots(a: tuple, b: tuple, similarity: float) -> list[tuple[int, int]]:
    """Pairs of classes that links between two blocks join, each block as (roots, sizes, all shingles); no pair closes a ring.

    The shared shingles of all pairs are counted: frequent shingles by a product of matrices, others one by one.
    """
    (roots_a, sizes_a, _), (roots_b, sizes_b, _) = a, b
    rows, cols = len(sizes_a), len(sizes_b)
    both = np.intersect1d(a[2], b[2])
    if not len(both) or (roots_a == roots_a[0]).all() and (roots_b == roots_a[0]).all():
        return []

    def held(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        here = both[at] == flat
        at, owner = at[here], np.repeat(np.arange(len(sizes)), sizes)[here]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (at_a, own_a), (at_b, own_b) = held(sizes_a, a[2]), held(sizes_b, b[2])
    times = np.bincount(at_b, minlength=len(both))
    begin = np.cumsum(times) - times
    frequent = np.bincount(at_a, minlength=len(both)) * times * 100 > rows * cols
    shared = np.zeros(rows * cols)

    rare = np.flatnonzero(~frequent[at_a])
    n = times[at_a[rare]]
    for part in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(np.cumsum(n) >> 22)) + 1):
        own, m = rare[part], n[part]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        shared += np.bincount(np.repeat(own_a[own], m) * cols + own_b[np.repeat(begin[at_a[own]], m) + nth], minlength=rows * cols)

    shared = shared.reshape(rows, cols)
    place = np.cumsum(frequent) - 1
    of_a, of_b = frequent[at_a], frequent[at_b]
    place_a, own_a, place_b, own_b = place[at_a[of_a]], own_a[of_a], place[at_b[of_b]], own_b[of_b]
    for low in range(0, int(frequent.sum()), 2048):
        left, right = np.zeros((rows, 2048), np.float32), np.zeros((cols, 2048), np.float32)
        for matrix, own_place, own in ((left, place_a, own_a), (right, place_b, own_b)):
            part = slice(*np.searchsorted(own_place, [low, low + 2048]))
            matrix[own[part], own_place[part] - low] = 1
        shared += left @ right.T
    links = (shared >= similarity * (sizes_a[:, None] + sizes_b[None, :] - shared)) & (roots_a[:, None] != roots_b[None, :])
    i, j = np.nonzero(links)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for x, y in np.unique(np.stack([roots_a[i], roots_b[j]], axis=1), axis=0).tolist():
        if (u := root(x)) != (v := root(y)):
            parent[u] = v
            out.append((x, y))
    return out


def _block_links(blocks: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes from the full comparison of all blocks of a bucket whose sizes allow the similarity."""
    names = ["level", "closed", "block"]
    ids = blocks.select("key", *names)
    left = ids.select("key", *(F.col(c).alias(f"{c}_a") for c in names))
    right = ids.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    # Texts of the largest class of a bucket need not meet each other.
    once = "level_b = level_a and (closed_b and not closed_a or not closed_b and not closed_a and block_b >= block_a)"
    pairs = left.join(right, "key").filter(f"{once} or level_b = level_a + 1 and not (closed_a and closed_b)")
    for side in "ab":
        pairs = pairs.join(blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in [*names, "roots", "sizes", "flat"])), ["key", *(f"{c}_{side}" for c in names)])

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for row in batch.itertuples(index=False):
                found.update(linked_roots((row.roots_a, row.sizes_a, row.flat_a), (row.roots_b, row.sizes_b, row.flat_b), similarity))
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)

    return pairs.select(*(f"{c}_{side}" for side in "ab" for c in ("roots", "sizes", "flat"))).mapInPandas(run, "a long, b long")


def _blocks(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Texts (uid, n, key, root) of buckets with several classes, dealt by hash to blocks of one level of sizes.

    Texts that may be linked are of the same level or of two adjacent ones. Texts of a bucket's largest class are in blocks of
    their own, marked closed.
    """
    by_class = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"), F.first("c").alias("c"))
    largest = by_class.groupBy("key").agg(F.first("c").alias("c"), F.max(F.struct("own", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.04 / similarity)))
    dealt = _with_bucket(placed, largest).select("uid", "n", "key", "root", level.alias("level"), (F.col("root") == F.col("top.root")).alias("closed"))
    size = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS), F.sum("n") / F.lit(BLOCK_SHINGLES))
    parts = dealt.groupBy("key", "level", "closed").agg(F.ceil(size).alias("parts"))
    dealt = dealt.join(parts, ["key", "level", "closed"]).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(77)), "parts"))
    full = dealt.join(sets, "uid").groupBy("key", "level", "closed", "block").agg(F.collect_list(F.struct("root", "shingles")).alias("m"))
    return full.select(
        "key", "level", "closed", "block", F.col("m.root").alias("roots"),
        F.transform("m", lambda x: F.size(x["shingles"])).alias("sizes"), F.flatten("m.shingles").alias("flat"),
    )


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, members["uid"] == roots["node"], "left").select("uid", "n", "key", "c", F.coalesce("root", "uid").alias("root"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    bands: int = BANDS, band_rows: int = BAND_ROWS, leaders: int = LEADERS, by_count: bool = False,
) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), class_size, kept (one of each class), text_hash.

    A text is its set of five-word shingles; with by_count each is weighted by how often it occurs. Texts are linked where
    their Jaccard similarity, the sum of the lesser over the sum of the greater weights, is at least `similarity`; a class is a
    connected component of links. By count, a line that is repeated hundreds of times makes texts alike that share nothing
    else, so all shingles weigh the same by default. Null and empty texts are one class. Null ids are ordered last; of
    repeated rows one is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_root(spark)
    folder = shared_path(spark, "near-work")

    def keep(df: DataFrame, label: str, **options) -> DataFrame:
        return written(df, f"{folder}/{label}", **options)

    # Sorted cells as differences take less than their full width.
    narrow = {"parquet.writer.version": "v2", "compression": "zstd"}
    every = keep(signed(docs, id_col, text_col, words, bands, band_rows, by_count), "signed", **narrow)
    n_rows = every.count()
    # Equal sets become one text, with partial aggregation before the shuffle however many copies there are.
    same = keep(every.groupBy("set_hash").agg(F.min("uid").alias("rep")), "sets", most_rows=n_rows)
    texts = every.join(same, every["uid"] == same["rep"], "left_semi")
    members = texts.filter("n > 0").select("uid", "n", F.explode("bands").alias("key"))
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = keep(members.join(counts, "key"), "members")
    small, large = members.filter(F.col("c") <= SMALL), members.filter(F.col("c") > SMALL)

    pairs = (
        _small_pairs(small.select("uid", "n", "key"), small.select("key", "c").distinct(), similarity)
        .unionByName(_leader_pairs(large.withColumn("root", F.col("uid")), similarity, [1, 2]))
        .distinct()
    )
    # Only texts that share a band are ever compared.
    met = members.select("uid").distinct()
    met = keep(every.join(met, "uid", "left_semi").select("uid", "text_hash", "row_hash"), "met", most_rows=n_rows)
    sets = keep(cells_of(_rows(docs, id_col, text_col), met, met.count(), words, by_count), "cells", **narrow)
    links = keep(_checked(keep(pairs, "pairs"), sets, similarity), "links")
    roots = keep(components(links, folder), "roots", most_rows=n_rows)

    def merged(roots: DataFrame, found: DataFrame, label: str) -> DataFrame:
        """Roots after further links between classes (a, b): components of classes, a small graph, and each node's class in it."""
        found = keep(found.distinct(), f"{label}-links")
        if found.isEmpty():
            return roots
        above = keep(components(found, folder), f"{label}-classes", most_rows=n_rows).select(F.col("node").alias("root"), F.col("root").alias("above"))
        # A class of one text is no node yet.
        alone = above.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")
        known = roots.unionByName(alone).join(above, "root", "left")
        return keep(known.select("node", F.coalesce("above", "root").alias("root")), f"{label}-roots", most_rows=n_rows)

    # Large buckets with texts of several classes: further leaders meet the texts of other classes.
    placed = _rooted(large, roots)
    more = _checked(_leader_pairs(placed, similarity, list(range(3, 3 + leaders))).distinct(), sets, similarity)
    for side in "ab":
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        more = more.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    roots = merged(roots, more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b"), "more")
    # Whatever classes are left in a large bucket are compared in full.
    blocks = keep(_blocks(_rooted(large, roots), sets, similarity), "blocks")
    roots = merged(roots, _block_links(blocks, similarity), "rest")

    placed = every.select("uid", "id", "text_hash", "set_hash").join(same, "set_hash")
    placed = placed.join(roots, placed["rep"] == roots["node"], "left").withColumn("class", F.coalesce("root", "rep"))
    order = F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    classes = placed.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    out = placed.join(classes, "class").select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"), "text_hash",
    )
    out = written(out, shared_path(spark, "near"), most_rows=n_rows)
    remove(spark, folder)
    return out


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns: the one with the smallest id; of rows with equal id and text any one."""
    by_row = near_groups(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias(f"{P}k"), F.col("text_hash").alias(f"{P}h"))
    kept = by_row.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept")
    same = F.col(id_col).eqNullSafe(F.col(f"{P}k")) & (F.xxhash64(text_of(text_col)) == F.col(f"{P}h"))
    out = docs.join(kept.filter("n = 1"), same, "left_semi")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return out
    more = docs.join(repeated.select(f"{P}k", f"{P}h"), same).dropDuplicates([f"{P}k", f"{P}h"])
    return out.unionByName(more.select(*docs.columns))
