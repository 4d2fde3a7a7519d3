from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from habitus.llm import simhash


def by_hand(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(ids, prints, most=3):
    """Smallest id reachable, by comparing all pairs."""
    parent = {k: k for k in range(len(ids))}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            same = ids[a] is not None and ids[a] == ids[b]
            if same or bin(prints[a] ^ prints[b]).count("1") <= most:
                parent[top(a)] = top(b)
    found = {}
    for k in range(len(ids)):
        found.setdefault(top(k), []).append(ids[k])
    return [min((i for i in found[top(k)] if i is not None), default=None) for k in range(len(ids))]


def test_decoding_is_that_of_the_perfect_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index, used = simhash.codewords(words, 23)
    code = [c for c in range(1 << 12)]
    full = [(c << 11) | int(simhash._syndromes(np.array([c << 11]))[0]) for c in code]
    for w, row, use in zip(words[:60], index, used, strict=False):
        near = {k for k, c in enumerate(full) if bin(c ^ int(w)).count("1") <= 4}
        close = {k for k, c in enumerate(full) if bin(c ^ int(w)).count("1") <= 3}
        got = set(row[use].tolist())
        assert close <= got <= near and len(close) == 1
        assert len(got) in (1, 6)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_every_close_pair_shares_a_key(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    key_a, row_a = simhash.keys_of(a)
    key_b, row_b = simhash.keys_of(b)
    for k in range(len(a)):
        assert set(key_a[row_a == k]) & set(key_b[row_b == k])


def near_copies(words, count, seed):
    rng = random.Random(seed)
    base = words(seed, 400).split()
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = words(rng.randrange(10**6), 1)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("held", [simhash.HELD, 4])
def test_classes_equal_those_of_all_pairs(make_docs, words, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD", held)
    texts = [None, "", "  ", "one", "One two", "a b c", "AÉ b c d", *(words(k, 60) for k in range(30))]
    texts += near_copies(words, 40, 5) + near_copies(words, 25, 6) + [texts[10]] * 3
    pairs = [*enumerate(texts), (3, words(77, 9)), (3, "one"), (None, words(0, 60)), (None, words(99, 50))]
    ids, prints = [i for i, _ in pairs], [by_hand(t) for _, t in pairs]
    rows = simhash.near_duplicates(make_docs(pairs)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in rows)
    want = sorted(
        (i is None, i or 0, f"{p:016x}", c or 0)
        for i, p, c in zip(ids, prints, classes(ids, prints), strict=True)
    )
    assert got == want
    assert len({w[3] for w in want}) < len(want) - 40


def test_large_keys_are_linked_on_the_cube(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 40:
        own = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            own ^= 1 << b
        prints.add(own)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash._cube(spark.createDataFrame(signed, "bits long"), 3).collect()
    for r in links:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3
    place = {s[0]: k for k, s in enumerate(signed)}
    label = list(range(len(prints)))
    for _ in prints:
        for r in links:
            low = min(label[place[r.a]], label[place[r.b]])
            label[place[r.a]] = label[place[r.b]] = low
    want = classes(list(range(len(prints))), prints)
    assert [want.index(w) for w in want] == [label.index(x) for x in label]


def test_no_documents(make_docs):
    assert simhash.near_duplicates(make_docs(["x"]).where("false")).count() == 0


def test_too_many_bits(make_docs):
    with pytest.raises(ValueError):
        simhash.near_duplicates(make_docs(["x"]), most=4)


def test_one_row_of_each_group_stays(spark, words):
    same, other, third = words(1, 40), words(2, 40), words(3, 40)
    rows = [(5, same), (9, same), (None, same), (None, same), (7, other), (7, third), (7, third), (None, other + " x")]
    rows += [(None, None), (3, ""), (None, words(4, 40)), (None, words(4, 40)), (11, words(5, 40)), (11, words(5, 40))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, bits int").repartition(3)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    want = [(5, same), (7, other), (7, third), (3, ""), (None, words(4, 40)), (11, words(5, 40))]
    near = (None, other + " x")  # stays beside ``other`` unless its bits are near
    assert [g for g in got if g != ("None", near[1])] == sorted((str(i), t) for i, t in want)
    assert simhash.deduplicated(docs.where("false")).count() == 0
