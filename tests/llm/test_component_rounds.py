"""Components take few shuffles, and are those of a plain union-find whatever a task holds at once."""

from __future__ import annotations

import random
import re

import pytest

from paperloom.llm import components


def plain(links):
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    return {x: forest.find(x) for pair in links for x in pair if forest.find(x) != x}


def graph(kind):
    rng = random.Random(7)
    if kind == "chain":
        ids = list(range(-300, 300))
        return list(zip(ids, ids[1:], strict=False))
    if kind == "mixed chain":
        ids = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
        return list(zip(ids, ids[1:], strict=False))
    if kind == "hubs":
        return [(i % 3 * 1000, 5000 + i) for i in range(600)] + [(9999, i * 1000) for i in range(3)] + [(9999, 5000 + i) for i in range(50)]
    return [(rng.randrange(700), rng.randrange(700)) for _ in range(500)] * 2


@pytest.mark.parametrize("held", [1, 64, 500_000])
@pytest.mark.parametrize("kind", ["chain", "mixed chain", "hubs", "random"])
def test_components_are_those_of_a_union_find(spark, kind, held):
    links = graph(kind)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = [(r.node, r.root) for r in components.connected_components(df, held).collect()]
    assert len(found) == len(dict(found))
    assert dict(found) == plain(links)


def test_no_links_have_no_components(spark):
    assert components.connected_components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_a_round_is_dealt_twice_and_stars_need_no_further_round(spark, monkeypatch):
    names, dealt, save = [], [], components.save

    def counted(df, name):
        names.append(name)
        dealt.append(len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())))
        return save(df, name)

    monkeypatch.setattr(components, "save", counted)
    stars = spark.createDataFrame([(i % 7, 100 + i) for i in range(200)], "a long, b long").repartition(1).localCheckpoint()
    components.connected_components(stars).count()
    assert names.count("links") == 1  # a round that only finds that nothing changed is none
    names.clear(), dealt.clear()
    chain = spark.createDataFrame(graph("mixed chain"), "a long, b long").repartition(5).localCheckpoint()
    components.connected_components(chain, 16).count()
    assert names.count("links") > 1
    assert sum(dealt) <= 2 * names.count("links"), list(zip(names, dealt, strict=True))
