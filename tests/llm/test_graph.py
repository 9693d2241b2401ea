"""Connected components against a plain union of links, in one task and in many."""

import random

import pytest

from juryframe.llm import graph


def expected(links):
    root = {x: x for link in links for x in link if None not in link and link[0] != link[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def cases():
    rng = random.Random(1)
    yield "nothing", []
    yield "odd", [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (4, 5), (-(2**63), 7), (2**63 - 1, 7)]
    yield "chain", [(i, i + 1) for i in range(200)]
    places = rng.sample(range(500), 500)
    yield "shuffled chain", list(zip(places[:-1], places[1:], strict=True))
    yield "star", [(1000, i) for i in range(300)]
    yield "random", [(rng.randrange(600), rng.randrange(600)) for _ in range(350)]


@pytest.mark.parametrize("task_links", [1 << 18, 40])
@pytest.mark.parametrize("name", [n for n, _ in cases()])
def test_components(spark, name, task_links, monkeypatch):
    monkeypatch.setattr(graph, "TASK_LINKS", task_links)
    links = dict(cases())[name]
    found = graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == expected(links)
