from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from habitus.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, key int, target int, finish string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], SCHEMA).repartition(3)


def fair(sizes: dict, weights: dict, budget: float, repeats: int = 3) -> dict:
    """Targets by sharing the excess until no source is above its bound."""
    target = dict.fromkeys(sizes, 0.0)
    left, rest = {s for s in sizes if weights[s] > 0}, budget
    while left:
        total = sum(weights[s] for s in left)
        above = {s for s in left if rest * weights[s] / total > repeats * sizes[s]}
        if not above:
            return target | {s: rest * weights[s] / total for s in left}
        for s in above:
            target[s] = repeats * sizes[s]
            rest -= target[s]
        left -= above
    return target


def order(source):
    return (source is None, (source or "").encode())


def rows(words):
    """Uneven sources, one with most rows, long and empty texts, nulls and repeated rows."""
    found = [(k, words(k, 5 + k * 7 % 40), "big") for k in range(60)]
    found += [(100 + k, words(200 + k, 30), "mid") for k in range(20)]
    found += [(200 + k, words(400 + k, 3), "tiny") for k in range(4)]
    found += [(300, None, "none"), (301, "", "none"), (302, " \t\r\n\x0b\x0c ", "none"), (303, None, None)]
    found += [(304, "no break \x1c here", None), (None, "without an id", None), (None, "without an id", None)]
    found += [(305, words(900, 400), "Äther")] + [(306, "same row here", "big")] * 3
    return found


def test_mix_follows_the_queues(spark, words):
    data = rows(words)
    got = [r.asDict() for r in mixing.mix(table(spark, data)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in data)
    sources = sorted({s for _, _, s in data}, key=order)
    total = Counter()
    for _, t, s in data:
        total[s] += size(t)
    weights = {s: 1 + k % 3 for k, s in enumerate(sources)}
    budget = sum(total.values())
    target = fair({s: total[s] for s in sources}, weights, budget)
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    # The queues again, one copy at a time.
    copies = []
    for s in sources:
        queue = sorted((r for r in got if r["source"] == s), key=lambda r: r["key"])
        passed = 0
        for round_ in (1, 2, 3):
            for n, r in enumerate(queue):
                passed += r["size"]
                if r["size"] and r["target"]:
                    copies.append((passed / r["target"], r["key"], order(s), round_, n, r["size"]))
    taken, left = Counter(), budget
    for finish, key, s, _, _, n in sorted(copies):
        left -= n
        if left < 0:
            break
        taken[(key, s)] += n
    assert taken == +Counter({}) + sum((Counter({(r["key"], order(r["source"])): r["taken"]}) for r in got), Counter())
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sources}
    for s in sources:
        mine = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(mine - target[s]) <= largest[s] + 0.25 * target[s]


def test_reruns_agree_and_seeds_differ(spark, words):
    docs = table(spark, rows(words))
    pick = lambda df: sorted((str(r["doc_id"]), r["copies"]) for r in df.collect())
    assert pick(mixing.mix(docs)) == pick(mixing.mix(docs.repartition(7)))
    assert pick(mixing.mix(docs)) != pick(mixing.mix(docs, seed="other"))


def test_drawn_copies(spark, words):
    docs = table(spark, rows(words))
    mixed = mixing.mix(docs)
    drawn = mixing.drawn(docs, mixed).collect()
    assert Counter(r["doc"]["doc_id"] for r in drawn) == Counter(
        i for r in mixed.collect() for i in [r["doc_id"]] * r["copies"]
    )
    # Words that a long document leaves over, as it does not fit, go to all sources.
    assert all(0 < r["finish"] <= 1.4 and r["doc"]["size"] == "x" for r in drawn)
    first = [r["doc"]["source"] for r in sorted(drawn, key=lambda r: (r["finish"], r["round"]))][:30]
    assert len(set(first)) > 2  # sources take turns


def test_given_weights_and_budget(spark, words):
    docs = table(spark, rows(words))
    weights = spark.createDataFrame([("big", 3.0), ("mid", 1.0)], "source string, weight double")
    got = mixing.mix(docs, weights, budget=800).collect()
    by = Counter()
    for r in got:
        by[r["source"]] += r["taken"]
    assert set(+by) == {"big", "mid"} and abs(by["big"] - 600) < 60 and abs(by["mid"] - 200) < 60
    everything = mixing.mix(docs, weights, budget=10**9).collect()
    assert {r["copies"] for r in everything if r["source"] in ("big", "mid")} == {3}


def test_empty_tables(spark):
    assert mixing.mix(table(spark, [(1, "x", "a")]).where("false")).count() == 0
    blank = mixing.mix(table(spark, [(1, None, None), (None, " ", "a")])).collect()
    assert [(r["size"], r["target"], r["copies"], r["taken"]) for r in blank] == [(0, 0.0, 0, 0)] * 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 5)), min_size=1, max_size=6))
def test_targets(spark, sources):
    sized = spark.createDataFrame([(str(k), n) for k, (n, _) in enumerate(sources)], "source string, size long")
    weights = spark.createDataFrame([(str(k), float(w)) for k, (_, w) in enumerate(sources)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(sized, weights).collect()}
    want = fair({str(k): n for k, (n, _) in enumerate(sources)}, {str(k): w for k, (_, w) in enumerate(sources)},
                sum(n for n, _ in sources))
    assert got == pytest.approx(want)
