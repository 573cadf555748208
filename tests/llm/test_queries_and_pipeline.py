"""The registered queries over the smallest tables: against their SQL, or brute force where SQL cannot express them; and the pipeline, stage by stage."""

import os
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelloom.llm import html_extract, mixing, quality
from panelloom.llm import queries as corpus

from .test_text_operators import SCHEMA, brute_classes, level, words

DATA = Path(os.environ.get("PANELLOOM_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the shared test tables")
FULL = public_tokenizers.path("byte_bpe_50k.json")


def rows(name):
    return pq.read_table(DATA / f"{name}.parquet").to_pylist()


def plain(df):
    def one(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = corpus.queries()[name](spark, str(DATA)).toPandas()
    assert len(got) and plain(got) == plain(db.execute(corpus.oracle_sql()[name]).fetchdf())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_and_op8(spark):
    tokenizer = Tokenizer.from_file(FULL)
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in rows("documents")}
    pieces = corpus.op3_packing(spark, str(DATA)).collect()
    by_doc, by_sequence = defaultdict(list), Counter()
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]] += p["length"]
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        whole, at = [*ids[key], 1], 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(whole), crc(whole[at : at + p["length"]]))
            at += p["length"]
        assert at == len(whole)
    assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in by_sequence.values())
    start = 0
    for r in corpus.op8_token_files(spark, str(DATA)).orderBy("start").collect():
        whole = [*ids[r["doc_id"]], 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(whole), crc(whole))
        start += len(whole)
    assert start == sum(len(i) + 1 for i in ids.values())


def test_op4(spark):
    docs = sorted(rows("documents"), key=lambda r: r["doc_id"])
    classes = brute_classes([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in corpus.op4_near_dedup(spark, str(DATA)).collect()}
    assert [got[r["doc_id"]]["class_id"] for r in docs] == [docs[c]["doc_id"] for c in classes]
    sizes = Counter(classes)
    assert [got[r["doc_id"]]["class_size"] for r in docs] == [sizes[c] for c in classes]
    assert sum(r["kept"] for r in got.values()) == len(sizes)


def test_op2(spark):
    import hashlib

    got = corpus.op2_sharding(spark, str(DATA)).collect()
    assert sorted((r["doc_id"], r["text_sha256"]) for r in got) == sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows("documents"))
    per_shard = Counter(r["shard"] for r in got)
    assert all(r["shard_rows"] == per_shard[r["shard"]] for r in got)


def test_op6(spark):
    got = {r["doc_id"]: r for r in corpus.op6_quality(spark, str(DATA)).collect()}
    docs = rows("documents")
    assert set(got) == {r["doc_id"] for r in docs} and len(got) == len(docs)
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    train = sorted((i for i in labels if i in text and quality.fold(i)), key=lambda i: (zlib.crc32(str(i).encode()), i))
    model = quality.fit([text[i] for i in train], [labels[i] for i in train])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        assert 0 <= r["score"] <= 1 and r["score"] == pytest.approx(model.score(text[i]), abs=1e-9)
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.7


def test_op9(spark):
    got = {r["page_id"]: r for r in corpus.op9_html(spark, str(DATA)).collect()}
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        text = html_extract.main_text(p["html"])
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (text, len(text), p["url"])
        assert "<" not in text or "&lt;" in p["html"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Good and bad texts with labels, copies, near copies and odd rows, and a column that clashes with names of operators."""
    import random

    rng = random.Random(6)
    good = [words(rng, rng.randint(60, 160)) for _ in range(60)]
    bad = ["".join(rng.choice("#$%&*!") for _ in range(rng.randint(100, 400))) for _ in range(30)]
    texts = good + bad + good[:10]
    for t in good[10:20]:
        own = t.split()
        own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    docs = [(i, t, "en", f"src{i % 3}", len(t), 1, 0.0, 1) for i, t in enumerate(texts)]
    docs += [(500, None, None, None, 0, 1, 0.0, 1), (501, "", "en", "src1", 0, 1, 0.0, 1), (None, good[0], "en", "src1", 9, 1, 0.0, 1), (3, texts[3], "en", "src0", 9, 1, 0.0, 1)]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(docs, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")


def test_pipeline_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [r.asDict() for r in docs.collect()]
    tokenizer = Tokenizer.from_file(FULL)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, small)
        if name == "packing":
            break
        assert got.columns == docs.columns
        found = sorted((r.asDict() for r in got.collect()), key=key)
        if name == "quality":
            train = {}
            for r in kept:
                if r["doc_id"] in labels and quality.fold(r["doc_id"]):
                    train[r["doc_id"]] = min(train.get(r["doc_id"], r["text"] or ""), r["text"] or "")
            order = sorted(train, key=lambda i: (zlib.crc32(str(i).encode()), i))
            model = quality.fit([train[i] for i in order], [labels[i] for i in order])
            want = [r for r in kept if model.score(r["text"]) >= 0.3]
            assert sum(r["doc_id"] is not None and r["doc_id"] < 60 for r in want) >= 55 and not any(60 <= (r["doc_id"] or 0) < 90 for r in want)
        elif name == "exact_dedup":
            best = {}
            for r in sorted(kept, key=key):
                best[r["text"] or ""] = r
            want = list(best.values())
        elif name == "near_dedup":
            own = sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            classes = brute_classes([r["text"] for r in own])
            want = [r for i, r in enumerate(own) if classes[i] == i]
        else:
            sizes = Counter()
            for r in kept:
                sizes[r["source"]] += len((r["text"] or "").split())
            names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
            targets = level(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
            taken = Counter()
            for r in found:
                taken[r["source"]] += len((r["text"] or "").split())
            assert all(abs(taken[s] - targets[s]) <= 2 * 170 for s in sizes)
            copies = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix(docs.drop("copies")).collect()}
            want = [r for r in kept for _ in range(copies[r["doc_id"], r["text"]])]
        assert found == sorted(want, key=key), name
        docs, kept = spark.createDataFrame(found, SCHEMA), found
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in kept)
    pieces = got.collect()
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert {(p["doc_id"], p["doc_tokens"]) for p in pieces} == {(i, len(ids)) for i, ids in want}
    run = corpus_pipeline.run(spark, small)
    assert sorted((p["doc_id"] or -1, p["start"], p["length"]) for p in run.collect() if p["start"] == 0 and p["length"] == p["doc_tokens"])
    assert run.agg({"length": "sum"}).first()[0] == sum(p["length"] for p in pieces)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame({"doc_id": pd.array([], "int64"), "quality": pd.array([], "int64")}).to_parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
