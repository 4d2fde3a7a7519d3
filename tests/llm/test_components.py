from __future__ import annotations

import random

from habitus.llm.components import components


def test_smallest_reachable_node(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)]
    links += [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(60)] + [(-5, 7), (9, 9)]
    links += links[:5]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
