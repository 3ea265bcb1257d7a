"""Links come as stars, stars take no round, and components equal a plain union of the links."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import components
from tapeloom.llm.components import connected_components
from tapeloom.llm.lsh_forest import confirmed_links, exact_links, set_names, shingle_sets, spanning_links
from tapeloom.llm.textblocks import blocks


def united(links):
    above = {x: x for link in links for x in link}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for u, v in links:
        low, high = sorted((top(u), top(v)))
        above[high] = low
    return {x: top(x) for x in above}


@pytest.fixture
def stagings(monkeypatch):
    """The frames that components stages."""
    seen, plain = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df: seen.append(df) or plain(df))
    return seen


def found(spark, links):
    rows = connected_components(spark.createDataFrame(links, "u binary, v binary")).collect()
    got = {bytes(r.node): bytes(r.component) for r in rows}
    assert len(got) == len(rows)
    return got


def names(links):
    return [(b"%04d" % u, b"%04d" % v) for u, v in links]


def test_components_of_any_links(spark):
    rng = random.Random(4)
    for links in ([(i, i + 1) for i in range(40)],
                  [(500, i) for i in range(60)] + [(i, 900) for i in range(40, 80)] + [(7, 7), (3000, 3000), (500, 1), (1, 500)],
                  [(rng.randrange(300), rng.randrange(300)) for _ in range(260)], []):
        assert found(spark, names(links)) == united(names(links))


def test_a_forest_of_stars_takes_no_round(spark, stagings):
    links = names([(1, i) for i in range(2, 40)] + [(i, 50) for i in range(51, 60)] + [(50, 51)])
    assert found(spark, links) == united(links)
    # The distinct links and the empty table of loose nodes; no round, nor one more that shows that nothing changes.
    assert len(stagings) == 2


def test_stars_that_share_members_take_two_rounds_at_most(spark, stagings):
    links = names([(hub, 100 + i) for hub in (3, 11, 17, 29) for i in range(hub, hub + 40)])
    assert found(spark, links) == united(links)
    assert len(stagings) <= 2 + 2 * 2


def test_links_are_stars_around_the_first_member():
    near = lambda at, rest: np.abs(rest - at) == 2
    assert sorted(spanning_links(9, near)) == [(0, 2), (0, 4), (0, 6), (0, 8), (1, 3), (1, 5), (1, 7)]
    chain = [np.arange(i, i + 40, dtype=np.uint64) for i in range(0, 12, 3)]
    assert sorted(exact_links(chain)) == [(0, 1), (0, 2), (0, 3)]


def test_parts_of_a_large_cluster_are_joined(spark):
    """Whatever part a member lies in, and whether or not a pivot reaches it: the links of all parts have the exact components."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 60, 3)] + [" ".join([*words[150:], f"x{i}", *words[:60]]) for i in range(20)] + ["a b c d e f g"]
    sets = [s for block in blocks(pa.array(texts, pa.large_string())) for s in shingle_sets(block)]
    named = set_names(sets)
    members = spark.createDataFrame([("c", name, text) for name, text in zip(named, texts, strict=True)], "cluster string, class binary, text string")
    got = united([(bytes(r.u), bytes(r.v)) for r in confirmed_links(members, block=4).collect()])
    want = united([(named[a], named[b]) for a, b in exact_links(sets)])
    assert len(set(want.values())) == 2
    assert {x: top for x, top in got.items() if x in want} == want and all(got[x] == x for x in got.keys() - want.keys())
