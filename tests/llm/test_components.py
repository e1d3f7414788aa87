import random

from feedloom.llm.components import components


def test_components_of_chains_stars_and_loops(spark):
    random.seed(5)
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(40)] + [(200, 200), (201, 200), (200, 201)]
    links += [(random.randrange(300, 360), random.randrange(300, 360)) for _ in range(40)] + [(None, 7), (500, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == {x: find(x) for x in root}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
