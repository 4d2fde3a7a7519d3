from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from habitus.llm import packing, store, vocab

ODD = [
    "", None, "   ", "Plain words, and more. It's we'll they've 12345 x2y", "ÉCOLE Straße ΣΑΣ    été  z",
    "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "don't can't 's 're''ll a.b. c, d,e f.", "1,5. a.\n\nb.\tc,\x1fd\x0be", "日本語 テスト 😀😀 x😀y.",
    "word " * 5000, "x" * 3000, "end.", "End. Of, The. a, b. c",
]


def expected(texts, path):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_ids_are_the_tokenizers(vocabulary):
    encode = vocab.Encoder(vocabulary)
    texts = [t or "" for t in ODD]
    for group in ([t for t in texts if "<|" not in t], texts):
        flat, at = encode(pa.array(group, pa.large_string()))
        got = [[*map(int, flat[a:b]), 1] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == expected(group, vocabulary)


def test_sample_ids_are_the_tokenizers(vocabulary, spark, sample):
    texts = [r.text for r in spark.read.parquet(f"{sample}/documents.parquet").select("text").collect()]
    encode = vocab.Encoder(vocabulary)
    got = []
    for _, part in vocab.slices(vocab.filled(pa.array(texts)), 100_000):
        flat, at = encode(part)
        got += [[*map(int, flat[a:b]), 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == expected(texts, vocabulary)


@settings(max_examples=300, deadline=None)
@given(st.text("abcstvemlrdAZéÀßÿ×ªµİſ01²'.,&#|<> \t\n\x1f\xa0\u0301", max_size=24))
def test_ids_of_any_mixture(one):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encode = vocab.encoder(path)
    flat, at = encode(pa.array([one, "x " + one + "'s", ""], pa.large_string()))
    got = [[*map(int, flat[a:b]), 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in (one, "x " + one + "'s", "")]


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 4096, 5000])
def test_lengths(n):
    parts = packing.lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and max(parts) <= 2048
    assert parts == sorted(parts, reverse=True)
    assert len([p for p in parts if p < 2048]) == bin(n % 2048).count("1")


def test_pieces_hold_every_id_once(make_docs, vocabulary):
    docs = make_docs([*enumerate(ODD), (3, ODD[3]), (None, "no id"), (100, ODD[3])])
    rows = [r.asDict() for r in packing.pack(docs, vocabulary, ids=True).collect()]
    ids = expected(ODD, vocabulary)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert len(r["ids"]) == r["length"] and r["offset"] == 0
    for k, own in enumerate(ids):
        parts = sorted((r["start"], tuple(r["ids"])) for r in rows if r["doc_id"] == k)
        if k == 3:  # a repeated row is packed by itself
            assert len(parts) % 2 == 0 and parts[::2] == parts[1::2]
            parts = parts[::2]
        assert [i for _, p in parts for i in p] == own
        assert {r["doc_tokens"] for r in rows if r["doc_id"] == k} == {len(own)}
    assert sum(r["doc_id"] is None for r in rows) > 0
    by_id = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in by_id] == list(range(len(rows)))
    assert [r["length"] for r in by_id] == sorted(r["length"] for r in rows)


def test_no_documents(make_docs, spark, vocabulary):
    none = make_docs(["x"]).where("false")
    assert packing.pack(none, vocabulary).count() == 0


def test_running_counts_over_many_tasks(spark):
    rows = [(length, part, (part * 7 + length) % 5 + 1) for length in (1, 4) for part in range(0, 5000, 3)]
    totals = spark.createDataFrame(rows, "length long, part int, n long")
    got = {(r.length, r.part): r.base for r in store.earlier_sums(totals, ("length", "part"), "n", "base").collect()}
    base = 0
    for length, part, n in sorted(rows):
        assert got.pop((length, part)) == base
        base += n
    assert not got
