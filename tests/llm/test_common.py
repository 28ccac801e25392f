import random

from callsheet.llm.common import components


def brute(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is None or b is None:
            continue
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    sizes = {}
    for n in parent:
        sizes.setdefault(root(n), []).append(n)
    return {n: r for r, nodes in sizes.items() if len(nodes) > 1 for n in nodes}


def check(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    rows = components(df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == brute(links)


def test_components_of_random_links(spark):
    rng = random.Random(4)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3), (4, None)])


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = list(range(400))
    random.Random(5).shuffle(chain)
    check(spark, list(zip(chain, chain[1:])) + [(1000, n) for n in range(1001, 1400)])


def test_no_links(spark):
    check(spark, [])
