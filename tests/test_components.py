import random

from tessera.operators.components import components


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(300, i) for i in range(301, 340)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame(pairs + [(None, 1), (2, None), (500, 500), (0, 1)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}
    assert components(links.limit(0)).count() == 0
