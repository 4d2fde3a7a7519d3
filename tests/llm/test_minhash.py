from __future__ import annotations

import hashlib
import re
import struct

import pytest
import xxhash

from habitus.llm import minhash


def chained(values, seed=42):
    """The engine's hash of several longs."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & (1 << 64) - 1), seed)
    return seed


def codes(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    shingles = [chained(h[k : k + 5]) for k in range(len(h) - 4)] if len(h) >= 5 else [chained(h)] if h else []
    least = {}
    for s in shingles:
        b = ((s >> 57) + 64) % 128
        least[b] = min(s, least.get(b, s))
    out = []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for j in range(128):
        if not least:
            break
        rank = lambda b: signed(xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<i", j), 42)) & ~255)  # noqa: E731, B023
        out.append(least[j if j in least else min(least, key=rank)] & 255)
    return out


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 128
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_rows_equal_those_by_hand(make_docs, words):
    texts = [words(k, 3 + 9 * k) for k in range(25)] + [None, "", " \n", "one", "One two é", "a b c d e", words(3, 900), "😀" * 9]
    pairs = [*enumerate(texts), (None, "no id here at all, none"), (4, "again"), (4, texts[4])]
    rows = minhash.compared(make_docs(pairs)).collect()
    order = sorted((i is not None, i or 0, t or "") for i, t in pairs)
    want = []
    for k, (known, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine, other, changed = codes(text), codes(after), codes(edited)
        packed = ["".join(f"{c:02x}" for c in x) for x in (mine, changed)]
        want.append((
            known, i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *packed,
            round(likeness(mine, changed), 9), round(likeness(mine, other), 9),
        ))
    got = [
        (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
         round(r.near_edited, 9), round(r.near_next, 9))
        for r in rows
    ]
    assert sorted(got) == sorted(want)


def test_likeness_follows_the_shingles(spark, words):
    pairs = []
    for k in range(60):
        a = words(k, 300).split()
        b = a[: 5 * k] + words(k + 500, 300 - 5 * k).split()
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = minhash.with_codes(minhash.with_codes(df, "a", "x"), "b", "y")
    rows = df.select("a", "b", minhash.likeness(df.x, df.y).alias("near")).collect()
    errors = []
    for r in rows:
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (r.a.split(), r.b.split())]
        errors.append(r.near - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert max(map(abs, errors)) < 0.17 and abs(sum(errors) / len(errors)) < 0.02


def test_equal_texts_have_equal_fingerprints(make_docs, words):
    text = words(1, 50)
    rows = minhash.fingerprints(make_docs([text, text, (None, text), words(2, 50), None, ""])).collect()
    assert len({r.fingerprint for r in rows}) == 3 and len(rows) == 6


def test_rows_without_an_id_are_several_ranges(spark, make_docs, words):
    """Each row's successor is the next in order, also where one doc_id holds most rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = [(None, words(k, 40)) for k in range(300)] + [(5, words(k, 40)) for k in range(300)] + [(9, "z")] * 30
        docs = make_docs(pairs).drop("range")
        rows = minhash._ranged(docs).collect()
        parts = {}
        for r in rows:
            parts.setdefault(r.range, []).append((r.guest, r.doc_id is not None, r.doc_id or 0, r.text))
        own = {k: sorted(x[1:] for x in v if not x[0]) for k, v in parts.items()}
        assert sorted(sum(own.values(), [])) == sorted((i is not None, i or 0, t) for i, t in pairs)
        full = [k for k in sorted(own) if own[k]]
        assert len(full) > 2
        for k, after in zip(full, full[1:] + full[:1]):
            assert own[k][-1] <= own[after][0] or after == full[0]
            assert [x[1:] for x in parts[k] if x[0]] == [own[after][0]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_documents(make_docs, count):
    docs = make_docs(["a b c d e f g h", "i j k l m n o p"]).where(f"doc_id < {count}")
    assert minhash.compared(docs).count() == count
