"""Exact copies, mixing, packing, token files, quality, near copies: brute force on small tables with every odd case."""

import contextlib
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import psutil
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm import common, exact_dedup, mixing, near_dedup, packing, quality, sharding, token_files
from panelloom.llm.components import components
from panelloom.llm.dartminhash import mix, signatures
from panelloom.llm.encode import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, copies long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    """Rows of (doc_id, text, source), with columns that clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, -1.0, -1) for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 60)), f"src{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[3][1], "src0") for i in range(70)]  # one text holds over half of the rows
    rows += [(200, None, "src1"), (201, "", None), (202, "   \n", None), (None, "lonely", "src2"), (None, rows[4][1], None)]
    rows += [(300, words(rng, 9000), "src1"), (7, rows[7][1], "src3"), (7, rows[7][1], "src3"), (301, "é  b\n\n中文 <|endoftext|>", "ü")]
    return rows


def test_exact_groups(spark, odd):
    for keep in ("smallest", "largest"):
        got = exact_dedup.exact_groups(frame(spark, odd), keep=keep, partitions=6).collect()
        groups = defaultdict(list)
        for i, t, _ in odd:
            groups[t or ""].append(i)
        assert len(got) == len(odd)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = Counter()
        for r in got:
            ids = by_hash[r["text_sha256"]]
            known = [i for i in ids if i is not None]
            best = (min if keep == "smallest" else max)(known) if known else None
            assert r["keep_id"] == best and r["group_size"] == len(ids)
            if r["kept"]:
                kept[r["text_sha256"]] += 1
                assert r["doc_id"] == best
        assert set(kept) == set(by_hash) and set(kept.values()) == {1}


def test_drop_copies(spark, odd):
    out = exact_dedup.drop_copies(frame(spark, odd), keep="largest", partitions=6)
    assert out.columns == frame(spark, odd).columns
    assert sorted((r["text"] or "") for r in out.collect()) == sorted({t or "" for _, t, _ in odd})


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert packing.pack(docs, PATH).count() == 0
    assert token_files.encode_and_read(docs, PATH).count() == 0
    assert near_dedup.near_groups(docs).count() == 0
    assert quality.score(docs, quality.fit([], [])).count() == 0


def level(sizes, weights, total):
    fixed = {}
    while True:
        free = [k for k in sizes if k not in fixed]
        if not free:
            return fixed
        rate = (total - sum(fixed.values())) / sum(weights[k] for k in free)
        over = [k for k in free if rate * weights[k] > 2 * sizes[k]]
        if not over:
            return fixed | {k: rate * weights[k] for k in free}
        fixed |= {k: 2.0 * sizes[k] for k in over}


def test_mixing(spark, odd):
    got = mixing.mix(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    sizes = Counter()
    for _, t, s in odd:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets = level(dict(sizes), weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = Counter()
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * largest[s]
    again = mixing.mix(frame(spark, odd[::-1])).collect()
    key = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    other = mixing.mix(frame(spark, odd), seed=1).collect()
    assert key(other) != key(got) and sum(r["target"] for r in other) == pytest.approx(sum(r["target"] for r in got))
    assert mixing.emit(mixing.mix(frame(spark, odd).drop("copies", "size")), ["doc_id", "text"]).count() == sum(r["copies"] for r in got)


def test_encoder_equals_library():
    tokenizer, own = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = random.Random(3)
    letters = list("ab1.,'!\n\n   \t é$Ωß中\x00\x01") + ["<|endoftext|>", "'s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [words(rng, 500), "", None]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 64), packing.Limits(64, 9, 20)])
def test_packing(spark, odd, limits):
    rows = packing.pack(frame(spark, odd).repartition(3), PATH, limits=limits, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter()
    for i, t, _ in odd:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        if n == 1 and i is not None:
            own = sorted(docs[i], key=lambda r: r["start"])
            assert tuple(x for r in own for x in r["ids"]) == ids and {r["doc_tokens"] for r in own} == {len(ids)}
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and at <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    if limits == packing.Limits():
        assert padding == 0


def test_loss_tokens_bind_apart_from_tokens():
    packer = packing.Packer(packing.Limits(100, 8, 30), waiting=4, cut_tail=False)
    out = []
    for i in range(20):
        out += list(packer.add(i, np.arange(40), 25))
    out += list(packer.close())
    for pieces in out:
        assert sum(p.end - p.start for p in pieces) <= 100 and sum(p.loss() for p in pieces) <= 30 and len(pieces) <= 8
    assert sum(p.end - p.start for pieces in out for p in pieces) == 800


@pytest.mark.parametrize("shard_bytes", [1 << 20, 400])
def test_token_files(spark, odd, tmp_path, shard_bytes):
    root = f"file://{tmp_path}"
    token_files.write(frame(spark, odd), PATH, root, partitions=5, shard_bytes=shard_bytes)
    rows = token_files.read(spark, root, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t, _) in zip(sorted(rows, key=lambda r: r["start"]), order, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shards, dictionary = token_files.manifest(spark, root).orderBy("number").collect(), token_files.dictionary_of(spark, root)
    assert len(dictionary) > 0 and (len(shards) > 20) == (shard_bytes == 400)
    with pytest.raises(ValueError):
        token_files.ShardReader(shards[0]["path"], dictionary + b"x")
    reader = token_files.ShardReader(shards[0]["path"], dictionary)
    assert reader.ids(reader.n_documents - 1)[-1] == 2


def test_encoder_forgets_and_stays_right(monkeypatch):
    from panelloom.llm import encode

    monkeypatch.setattr(encode, "MOST_WORDS", 300)
    monkeypatch.setattr(encode, "WORDS_STAY", 100)
    tokenizer, own = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = random.Random(8)
    for _ in range(12):
        texts = [words(rng, 60) + rng.choice(["", ".", "\nNext line, it's", "  two"]) for _ in range(8)]
        assert [i.tolist() for i in own.encode_batch(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(own.slots) < 1200
    monkeypatch.setattr(encode, "MOST_IDS", 50)
    texts = [words(rng, 200) for _ in range(5)]
    for _ in range(3):
        assert [i.tolist() for i in own.encode_batch(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_quality():
    rng = random.Random(1)
    vocabulary = words(rng, 300).split()
    text = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
    good = [" ".join(text()) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in text()) for _ in range(60)] + [f"{w} " * 80 for w in vocabulary[:60]]
    model = quality.fit(good[::2] + bad[::2], [1] * 60 + [0] * len(bad[::2]))
    assert np.mean([model.score(t) >= 0.3 for t in good[1::2]]) > 0.95
    assert np.mean([model.score(t) < 0.3 for t in bad[1::2]]) > 0.9
    assert all(0 <= model.score(t) <= 1 for t in ("", None, "a", "x" * 100_000))
    assert quality.fit([], []).score("text") == pytest.approx(0.5)


def test_quality_sample_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(None, "x"), (5, None), (7, "text 7" + " long" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (2, None), (9, 0), (9, 1)], "doc_id long, quality int")
    texts, marks = quality.labelled_sample(docs, labels, "doc_id", "text", "quality")
    ids = {int(t.split()[1]) for t in texts if t}
    again = quality.labelled_sample(docs.repartition(5), labels.repartition(3), "doc_id", "text", "quality")
    assert (texts, marks) == again and len(set(texts)) == len(texts)
    assert ("text 9", 0) in zip(texts, marks, strict=True) and "text 7" in texts and ("" in texts) == (zlib.crc32(b"5") % 5 != 0)
    few, _ = quality.labelled_sample(docs, labels, "doc_id", "text", "quality", most=3)
    assert len(few) == 6
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids) and set(marks) == {0, 1}


def brute_classes(texts, similarity=0.8, by_count=False):
    sets = []
    for t in texts:
        own = (t or "").split()
        runs = Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()
        sets.append({(run, nth) for run, n in runs.items() for nth in range(n if by_count else 1)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_groups(spark):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(4, 90)) for _ in range(40)]
    for base in (words(rng, 150), words(rng, 60)):
        for _ in range(45):
            own = base.split()
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = words(rng, 1)
            texts.append(" ".join(own))
    texts += [texts[0]] * 30 + ["", None, " \n", "one", "one", texts[1] + "\n"]
    line = words(rng, 9)
    texts += [" ".join([line] * n) for n in (2, 10, 11, 12, 40)] + [" ".join(f"long{i}" for i in range(40_000))] * 2
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    by_count = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(frame(spark, rows), by_count=True).collect()}
    assert [by_count[i] for i in range(len(texts))] == brute_classes(texts, by_count=True) != brute_classes(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)
    assert sum(r["kept"] for r in got.values()) == len(set(brute_classes(texts)))
    kept = near_dedup.drop_near(frame(spark, rows + rows[:3] + rows[-1:]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))
    assert kept.columns == frame(spark, []).columns


def test_near_groups_keep_cells_of_texts_that_share_a_band_only(spark, monkeypatch):
    rng = random.Random(12)
    texts = [words(rng, 300) for _ in range(150)]
    near = [f"{texts[0]} more", f"{texts[1]} more", f"{texts[1]} less"]
    rows = [(i, t, "s") for i, t in enumerate(texts + near + [texts[2]])] + [(0, texts[0], "s"), (None, near[0], "s"), (None, near[2], "s")] * 2
    held, write = [], near_dedup.written

    def counted(df, path, **options):
        out = write(df, path, **options)
        if "shingles" in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert held == [5]
    classes = brute_classes([r[1] for r in rows])
    assert sorted((r["doc_id"] is None, r["doc_id"], r["class_id"]) for r in got) == sorted((r[0] is None, r[0], rows[c][0]) for r, c in zip(rows, classes, strict=True))


def test_near_groups_keep_large_ids_beside_null_ones(spark):
    rows = [(2**60 + 1, "a b c", "s"), (None, "d e f", "s"), (2**60 + 2, "g", "s"), (-(2**63) + 1, "a b c", "s")]
    docs = frame(spark, rows).coalesce(1)
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in near_dedup.near_groups(docs).collect())
    assert got == [(-(2**63) + 1, -(2**63) + 1), (0, None), (2**60 + 1, -(2**63) + 1), (2**60 + 2, 2**60 + 2)]
    assert sorted(r["doc_id"] or 0 for r in near_dedup.drop_near(docs).collect()) == [-(2**63) + 1, 0, 2**60 + 2]


def test_few_rows_make_few_files(spark, monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 40) for _ in range(120)]
    rows = [(i, t, "s") for i, t in enumerate(texts + [f"{t} more" for t in texts[:60]])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("30", "false"), strict=True):
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a long, b long")
        stars = components(edges)
        assert len(stars.inputFiles()) == 1 and stars.count() == 200
        groups = near_dedup.near_groups(frame(spark, rows))
        assert len(groups.inputFiles()) == 1
        got = {r["doc_id"]: r["class_id"] for r in groups.collect()}
        monkeypatch.setattr(common, "ROWS_A_FILE", 50)
        groups = near_dedup.near_groups(frame(spark, rows))
        assert len(groups.inputFiles()) == 4
        assert got == {r["doc_id"]: r["class_id"] for r in groups.collect()} == dict(enumerate(brute_classes([r[1] for r in rows])))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def worker_mb():
    """MB of all Python workers below this process."""
    total = 0
    for p in psutil.Process().children(recursive=True):
        with contextlib.suppress(psutil.Error, OSError):  # one may end meanwhile
            if "pyspark.daemon" in " ".join(p.cmdline()):
                total += sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())))
    return total / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_idle_workers_give_memory_back(spark):
    text = words(random.Random(9), 800)
    model = quality.fit(["a b c"] * 5 + ["good text"] * 5, [0] * 5 + [1] * 5)

    def run(n):
        docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" " + text)).alias("text"))
        quality.score(docs, model).write.format("noop").mode("overwrite").save()
        near_dedup.signed(docs, "doc_id", "text", 5, 28, 5, False).write.format("noop").mode("overwrite").save()

    run(10)
    before = worker_mb()
    run(8000)
    assert worker_mb() - before < 30


def test_filter_of_rows_keeps_all_that_are_wanted(spark):
    rng = random.Random(3)
    hashes = [(rng.getrandbits(64) - 2**63,) for _ in range(20_000)]
    rows = spark.createDataFrame([*hashes, (-(2**63),), (2**63 - 1,), (0,)], "row_hash long")
    met = rows.filter((F.col("row_hash") % 10 == 0) | F.col("row_hash").isin(-(2**63), 2**63 - 1))
    found = near_dedup._filtered(rows, met, met.count())
    assert found.columns == rows.columns and met.join(found, "row_hash", "left_anti").isEmpty()
    assert met.count() <= found.count() < 1.5 * met.count()


def from_template(rng, template, n):
    """The template with n of its words changed."""
    own = list(template)
    for i in rng.sample(range(len(own)), n):
        own[i] = f"w{rng.getrandbits(60)}"
    return own


def test_near_groups_links_pairs_among_texts_of_one_template(spark):
    rng = random.Random(4)
    template = [f"t{i}" for i in range(400)]
    texts = []
    for _ in range(110):
        one = from_template(rng, template, 6)
        texts += [one, from_template(rng, one, 8)]
    texts = [" ".join(t) for t in texts]
    expected = brute_classes(texts)
    assert 60 < len(set(expected)) < 160
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    # Few bands of two coordinates: every bucket is large, and few of its texts meet a leader.
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs, bands=8, band_rows=2, leaders=1).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_linked_roots_count_shared_shingles_of_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**31), 2**31, 5000)

    def block(first):
        sets = []
        for i in range(40):
            low = rng.integers(0, 4000) if i % 3 else 100
            sets.append(np.unique(np.concatenate([base[low : low + rng.integers(20, 900)], rng.integers(-(2**31), 2**31, 5)])).astype(np.int32))
        return sets, (np.arange(40) + first, np.array([len(s) for s in sets]), np.concatenate(sets))

    (sets_a, a), (sets_b, b) = block(0), block(100)
    got = near_dedup.linked_roots(a, b, 0.6)
    linked = [(i, 100 + j) for i, x in enumerate(sets_a) for j, y in enumerate(sets_b) if len(np.intersect1d(x, y)) >= 0.6 * len(np.union1d(x, y))]
    assert linked and set(got) <= set(linked)

    def groups(edges):
        near = {n: {n} for e in linked for n in e}
        for x, y in edges:
            if near[x] is not near[y]:
                near[x] |= near[y]
                for n in near[x]:
                    near[n] = near[x]
        return near

    assert groups(got) == groups(linked)


def test_dart_signatures_estimate_weighted_similarity():
    elements = mix(np.arange(1, 7, dtype=np.uint64))
    a, b = np.array([1.5, 3.0, 0.2, 5.0, 1.0, 2.5]), np.array([2.5, 1.0, 0.2, 4.0, 1.0, 0.5])
    sig = signatures(np.concatenate([elements, elements]), np.repeat([0, 1], 6), 2, 4000, np.concatenate([a, b]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in edges:
        parent[max(root(x), root(y))] = min(root(x), root(y))
    alone = {n for n in parent if all(n not in e or e[0] == e[1] for e in edges)}
    assert got == {n: root(n) for n in parent if n not in alone}


def test_shard_store(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    docs = frame(spark, odd).repartition(7)
    assert store.versions() == [] and store.compact() == 0 and store.manifest().count() == 0
    docs = docs.withColumn("shard", docs["doc_id"] + 0).withColumn("day", docs["doc_id"] % 11)
    assert store.append(docs) == 1
    last = store.append(docs, batch_col="day")
    batches = [r["batch"] for r in store.manifest().select("batch").distinct().collect()]
    assert last == 1 + 12 == len(batches)  # eleven days and null
    order = [(set(r["batch"] for r in store.manifest(v).collect()) - set(r["batch"] for r in store.manifest(v - 1).collect())).pop() for v in range(2, last + 1)]
    assert order == ["__HIVE_DEFAULT_PARTITION__", *map(str, range(11))]
    before = store.manifest().count()
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "shard", "day").collect()))
    assert key(store.read(1)) == key(docs)
    version = store.compact(retain=3)
    assert store.manifest(version).count() < before and len(store.versions()) == 3
    assert key(store.read()) == key(docs.unionByName(docs)) == key(store.read(version - 1))
    assert store.read().columns == docs.columns
    assert store.manifest().agg({"n_rows": "sum"}).first()[0] == 2 * len(odd)
    with pytest.raises(ValueError):
        store.read(1)
    with pytest.raises(ValueError):
        store.read(shard_col="shard")
    with pytest.raises(ValueError):
        store.append(docs.drop("day"))
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), version - 1, docs.schema)
    assert store.append(docs.limit(0)) == version + 1 and key(store.read()) == key(docs.unionByName(docs))
    store.expire()
    listed = {r["path"].rpartition("/")[2] for r in store.manifest().collect()}
    assert {f.name for f in tmp_path.rglob("part-*.parquet") if "data" in f.parts and f.stat().st_size} >= listed


def test_empty_shard_store(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    none = frame(spark, [])
    assert store.append(none, batch_col="source") == 1 and store.append(none) == 2
    assert store.compact() == 2 and store.read().schema == none.schema and store.read(shard_col="file").count() == 0
    store.append(frame(spark, odd[:3]))
    assert store.read().count() == 3


def test_one_of_many_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for i in range(5):
        path = f"file://{tmp_path}/{i}"
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n: sharding.put_if_absent(spark, path, f"writer {n}"), range(8)))  # noqa: B023
        assert sum(won) == 1 and (tmp_path / str(i)).read_text() == f"writer {won.index(True)}"


def test_writers_that_race_keep_both_arrivals(spark, odd, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    docs = frame(spark, odd[:20]).coalesce(1)
    stores = [sharding.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda s: s.append(docs), stores))
    assert sorted(versions) == [1, 2, 3] and stores[0].read().count() == 60
