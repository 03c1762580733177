import math
import random

from strandloom.llm.topn import top_n

SCHEMA = "g int, item int, s double, score string, rank int"


def by_hand(rows, n):
    best = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    return {
        (g, i, k + 1)
        for g, items in best.items()
        for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n])
    }


def run(spark, rows, n, **more):
    found = top_n(spark.createDataFrame(rows, SCHEMA), group="g", item="item", score="s", n=n, **more)
    return {(r["g"], r["item"], r["rank"]) for r in found.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, i, round(rng.random(), 2), "x", 0) for i in range(2000)]  # a third of all rows in one group
    for g in range(1, 600):
        for i in range(rng.choice([1, 2, 3, 10])):
            rows.append((g, i, rng.choice([0.5, 0.9, round(rng.random(), 2), None, float("nan"), -math.inf]), "x", 0))
    rows += rows[:500] + [(1, 1, 0.99, "x", 0), (None, 1, 0.5, "x", 0), (2, None, 0.5, "x", 0)]
    for n in (1, 3, 50):
        assert run(spark, rows, n) == by_hand(rows, n)
    assert run(spark, rows, 3, bands=()) == by_hand(rows, 3) == run(spark, rows, 3, bands=(0.01, 0.02, 0.9))


def test_ties_and_empty(spark):
    same = [(1, i, 1.0, "x", 0) for i in range(100)] * 2
    assert run(spark, same, 3) == {(1, 0, 1), (1, 1, 2), (1, 2, 3)}
    assert run(spark, [], 3) == set() and run(spark, same, 0) == set()
