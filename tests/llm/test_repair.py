from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from habitus.llm import repair


def documents(seed, count, kinds=30):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(2, 49_000, rng.integers(2, 9)) for _ in range(kinds)]
    docs = []
    for _ in range(count):
        parts = [phrases[k] for k in rng.integers(0, kinds, rng.integers(0, 60))]
        docs.append(np.concatenate([*parts, rng.integers(2, 49_000, 3), [1]]).astype("<u4"))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_and_ranges(seed):
    docs = documents(seed, 60) + [np.array([1], "<u4")] * 2 + [np.full(400, 7, "<u4"), np.array([1], "<u4")]
    docs[-2] = np.append(docs[-2], 1).astype("<u4")
    ids = np.concatenate(docs)
    payload = repair.pack(ids, np.cumsum([len(d) for d in docs]), 6)
    shard = repair.Shard(payload)
    assert (shard.all() == ids).all() and len(shard.rules) > 20
    assert len(shard.symbols) < 0.6 * len(ids)
    rng = random.Random(seed)
    assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in docs]
    for k, doc in enumerate(docs):
        assert (shard.document(k) == doc).all()
        for _ in range(5):
            a = rng.randrange(len(doc) + 1)
            b = rng.randrange(a, len(doc) + 1)
            assert shard.read_range(k, a, b).tolist() == doc[a:b].tolist()
    grown = repair.expansions(shard.rules)
    assert [len(g) for g in grown] == shard.lengths.tolist()
    assert all(1 not in g[:-1] for g in grown)


def test_documents_with_a_common_last_and_next_first_id():
    rng = np.random.default_rng(3)
    docs = [np.concatenate([[7, 8], rng.integers(2, 49_000, rng.integers(0, 9)), [9, 1]]).astype("<u4") for _ in range(300)]
    ids = np.concatenate(docs)
    shard = repair.Shard(repair.pack(ids, np.cumsum([len(d) for d in docs])))
    assert (shard.all() == ids).all() and len(shard.rules)
    for k, doc in enumerate(docs):
        assert shard.document(k).tolist() == doc.tolist()
        assert shard.read_range(k, 1, len(doc)).tolist() == doc[1:].tolist()
    assert all(1 not in g[:-1] for g in repair.expansions(shard.rules))


def test_files_with_a_common_last_and_next_first_word(spark, make_docs, words, vocabulary, tmp_path):
    texts = [f"the house {words(k, 3)} at home" for k in range(80)]
    path = str(tmp_path / "shards")
    repair.write(make_docs(texts), vocabulary, path)
    tokenizer = Tokenizer.from_file(vocabulary)
    rows = repair.read(spark, path, ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def test_wide_symbols():
    rng = np.random.default_rng(0)
    pairs = rng.integers(2, 49_000, (20_000, 2))
    ids = np.append(np.repeat(pairs, 16, axis=0).ravel(), 1).astype("<u4")
    shard = repair.Shard(repair.pack(ids, np.array([len(ids)]), 8))
    assert (shard.all() == ids).all()


def test_not_a_shard():
    with pytest.raises(ValueError):
        repair.Shard(b"nothing of the kind")


def test_files_hold_every_document(spark, make_docs, words, vocabulary, tmp_path):
    texts = [words(k % 17, 40 + k) for k in range(60)] + [None, "", "a <|endoftext|> b", "퟿ é"]
    pairs = [*enumerate(texts), (5, texts[5]), (5, "again"), (None, "no id"), (-3, "negative")]
    docs, path = make_docs(pairs), str(tmp_path / "shards")
    repair.write(docs, vocabulary, path, shard_ids=500)
    assert spark.read.parquet(path).count() > 5
    rows = repair.read(spark, path, ids=True).collect()
    tokenizer = Tokenizer.from_file(vocabulary)
    rest = sorted(((i is not None, i or 0, t or "") for i, t in pairs))
    start = 0
    by_start = sorted(rows, key=lambda r: r.start)
    assert len(by_start) == len(rest)
    for (known, i, text), r in zip(rest, by_start, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens) == (known, i, start, len(ids))
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_documents(spark, make_docs, vocabulary, tmp_path):
    path = str(tmp_path / "none")
    repair.write(make_docs(["x"]).where("false"), vocabulary, path)
    assert repair.read(spark, path).count() == 0
