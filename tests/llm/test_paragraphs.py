from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from habitus.llm import bloom, paragraphs
from habitus.llm.queries import QUERIES
from habitus.llm.words import Words


def tokens(line):
    return re.findall(r"[0-9a-z\x80-￿]+", line.lower())


def sets(line):
    t = tokens(line)
    return {tuple(t[k : k + 5]) for k in range(len(t) - 4)}


def line_classes(docs):
    """Lines of at least eight words by class: equal or 0.8 alike, by all pairs."""
    places = []
    for d, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            n = len(tokens(line))
            if n >= paragraphs.LEAST:
                places.append((d, at, sets(line)))
            at += n
    label = list(range(len(places)))
    for _ in places:
        for a in range(len(places)):
            for b in range(a):
                x, y = places[a][2], places[b][2]
                if len(x & y) >= 0.8 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return {(d, at): label[k] for k, (d, at, _) in enumerate(places)}


@pytest.fixture(scope="module")
def case(words):
    passage = words(900, 70)
    long = words(901, 60)
    edits = []
    for k in range(12):
        own = long.split()
        own[5 * k] = "edited"
        edits.append(" ".join(own))
    docs = [(k, "\n".join(words(10_000 + 100 * k + j, 20 + j) for j in range(5))) for k in range(8)]
    docs += [(20 + k, f"{words(2000 + k, 33)} {passage} {words(2100 + k, 27)}") for k in range(5)]
    docs += [(40 + k, f"{words(3000 + k, 15)}\n{e}") for k, e in enumerate(edits)]
    docs += [(60, words(1, 30)), (61, words(1, 30).upper() + "!"), (62, f"{words(1, 30)}\n{words(1, 30)}"), (62, words(1, 30))]
    docs += [(63, None), (64, ""), (65, "too short a line"), (66, "too short a line"), (None, words(2, 30)), (None, words(2, 30))]
    return docs


@pytest.mark.parametrize("block", [paragraphs.BLOCK, 3])
def test_line_classes_equal_those_of_all_pairs(make_docs, case, monkeypatch, block):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    rows = paragraphs.duplicates(make_docs(case), run_words=1).where("line").collect()
    got = {}
    for r in rows:
        got.setdefault((r.class_doc_id, r.class_start), set()).add((r.doc_id, r.start))
    want = {}
    for place, label in line_classes(case).items():
        want.setdefault(label, set()).add(place)
    several = {frozenset(v) for v in want.values() if len(v) > 1}
    assert several <= {frozenset(v) for v in got.values()}
    for places in got.values():  # classes of one place are repeated rows
        assert frozenset(places) in several or len(places) == 1 and {d for d, _ in places} <= {62, None}


def test_passages_in_other_surroundings(make_docs, case):
    rows = paragraphs.duplicates(make_docs(case)).collect()
    for k in range(5):
        own = [r for r in rows if r.doc_id == 20 + k]
        assert own and all(33 <= r.start and r.start + r.words <= 33 + 70 for r in own)
        assert all(20 <= r.class_doc_id <= 20 + k for r in own)
        assert any(r.class_doc_id == 20 and r.removed == (k > 0) for r in own)
        assert max(r.start + r.words for r in own) - min(r.start for r in own) >= 45
    assert not {r.doc_id for r in rows} & {*range(8), 63, 64, 65, 66}
    one = {(r.class_doc_id, r.class_start): 0 for r in rows}
    for r in rows:
        one[r.class_doc_id, r.class_start] += not r.removed
    assert min(one.values()) >= 1


def test_every_repeated_line_is_returned(spark, make_docs, words, tmp_path):
    """Lines of 2 to 24 words between other text, near copies, and whole documents of one line."""
    docs = []
    for k, n in enumerate((2, 4, 5, 7, 8, 12, 20, 24)):
        docs += [(10 * k + j, f"{words(100 + 10 * k + j, 30)}\n{words(k, n)}\n{words(300 + 10 * k + j, 30)}") for j in range(2)]
    docs += [(200, words(9, 9)), (201, words(9, 9).upper()), (202, words(8, 3)), (203, words(8, 3)), (None, words(8, 3))]
    near = words(77, 24)
    docs += [(210, f"{words(500, 30)}\n{near}"), (211, f"{words(501, 30)}\n{near.rsplit(' ', 1)[0]} edited")]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_paragraphs"](spark, str(tmp_path)).where("line").collect()
    got = {(r.doc_id, r.start, r.words, r.class_doc_id, r.removed) for r in rows}
    want = {(10 * k + j, 30, n, 10 * k, j > 0) for k, n in enumerate((2, 4, 5, 7, 8, 12, 20, 24)) for j in range(2)}
    want |= {(200, 0, 9, 200, False), (201, 0, 9, 200, True), (202, 0, 3, 202, False), (203, 0, 3, 202, True), (None, 0, 3, 202, True)}
    assert got == want | {(210, 30, 24, 210, False), (211, 30, 24, 210, True)}


def test_rows_tell_the_words_of_their_run(make_docs, words):
    """A stock phrase, a passage over three lines, and a row without a doc_id."""
    phrase, passage = words(1, 9), "\n".join(words(2 + k, 20) for k in range(3))
    docs = [(k, f"{words(100 + k, 30)}\n{phrase}\n{words(200 + k, 30)}\n{passage}") for k in range(2)]
    rows = paragraphs.duplicates(make_docs([*docs, (None, phrase)]), lines=1).collect()
    got = {(r.doc_id, r.start, r.words, r.run_words) for r in rows if r.line}
    want = {(k, 30, 9, 9) for k in range(2)} | {(None, 0, 9, 9)}
    assert got == want | {(k, 69 + 20 * j, 20, 60) for k in range(2) for j in range(3)}
    assert {r.run_words for r in rows if not r.line} <= {60}
    assert any(not r.line for r in rows)


def test_two_hashes_of_a_content(words):
    w = Words(pa.array([words(k % 50, 20 + k % 7) for k in range(100)] + ["a b c", "c b a"]), plain=True)
    content, check = paragraphs._contents(w, w.first[:-1], w.first[1:])
    assert len(set(content.tolist())) == len(set(check.tolist())) == len(set(zip(content.tolist(), check.tolist())))
    assert not set(content.tolist()) & set(check.tolist())


def test_no_documents(make_docs):
    assert paragraphs.duplicates(make_docs(["x"]).where("false")).count() == 0
    assert paragraphs.duplicates(make_docs([None, "", "a b"])).count() == 0


def test_pieces_depend_on_nearby_words_only(words):
    passage = words(5, 200)
    texts = [passage, words(6, 31) + " " + passage + " " + words(7, 9)]
    found = []
    for text, shift in zip(texts, (0, 31), strict=True):
        w = Words(pa.array([text]), plain=True)
        cuts = paragraphs._begins(np.zeros(len(w.start), int), w.hash) - shift
        found.append({c for c in cuts.tolist() if 5 <= c < 185})
    assert found[0] == found[1] and len(found[0]) > 12


def test_passages_of_fifty_words_are_found(make_docs, words):
    """Each in two documents, amid other words and broken into other lines."""
    docs = []
    for k in range(150):
        passage = words(50_000 + k, 51).split()
        for j in range(2):
            own = words(60_000 + 2 * k + j, 20).split() + passage + words(70_000 + 2 * k + j, 20).split()
            own[30 + 9 * j] += "\n"
            docs.append((2 * k + j, " ".join(own)))
    docs += [(1000 + k, words(80_000 + k, 90)) for k in range(150)]
    docs += [(2000 + k, words(85_000 + k, 40) + "\n" + words(3, 15)) for k in range(50)]
    rows = paragraphs.duplicates(make_docs(docs)).collect()
    found = {r.doc_id for r in rows}
    assert len(found & set(range(300))) >= 296
    assert not [d for d in found if d >= 1000]
    assert {r.doc_id for r in rows if r.removed} <= {d for d in range(300) if d % 2}


def test_bands_reach_the_recall():
    for similarity in (0.7, 0.8, 0.9):
        b = paragraphs.bands_for(similarity)
        assert 1 - (1 - similarity**paragraphs.ROWS) ** b >= paragraphs.RECALL


def test_recall_of_banding(words):
    pairs, hit = 0, 0
    for k in range(300):
        a = words(k, 60).split()
        b = list(a)
        b[0], b[-1] = "first", "last"
        w = Words(pa.array([" ".join(a), " ".join(b)]), plain=True)
        keys = paragraphs._bands(w.first[:-1], w.first[1:], paragraphs._joined(w.hash, 5), paragraphs.bands_for())
        pairs, hit = pairs + 1, hit + bool((keys[0] == keys[1]).any())
    assert hit / pairs >= 0.97


def test_words_of_odd_texts():
    texts = ["", "Ab, c", "  ", "é\n9x\tZ ", "", "end"]
    w = Words(pa.array(texts))
    assert np.diff(w.first).tolist() == [0, 2, 0, 3, 0, 1]
    p = Words(pa.array(["ab, C", "AB c"]), plain=True)
    assert p.hash[:2].tolist() == p.hash[2:].tolist()
    assert len(set(Words(pa.array(["a b ab ba aa bb é e"])).hash.tolist())) == 8


def test_filter_keeps_all_keys(spark):
    keys = [int(x) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63 - 1, 500)]
    bits = bloom.bloom(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert bloom.maybe(bits, np.array(keys)).all()
    other = np.random.default_rng(2).integers(-(1 << 63), 1 << 63 - 1, 5000)
    assert bloom.maybe(bits, other).mean() < 0.01
