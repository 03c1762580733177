import math
import random

import pytest

from strandloom.llm.cutoffs import fraction_cutoffs

SCHEMA = "src string, id bigint, v double, source string, value double"


def by_hand(rows, targets):
    kept, cuts = set(), {}
    for s in {r[0] for r in rows} - {None}:
        best = {}
        for src, i, v, *_ in rows:
            if src == s and i is not None and v is not None and not math.isnan(v) and v >= 0:
                best[i] = max(v, best.get(i, -1))
        pct = [p for t, p in targets if t == s and p is not None]
        if not pct or not best or max(pct) > 100:
            continue
        ok = [v for v in best.values() if 100 * sum(w >= v for w in best.values()) >= max(pct) * len(best)]
        cuts[s] = max(ok)
        kept |= {(s, i) for i, v in best.items() if v >= cuts[s]}
    return kept, cuts


def run(spark, rows, targets, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    t = spark.createDataFrame(targets, "src string, pct int")
    found = fraction_cutoffs(df, t, source="src", key="id", value="v", percent="pct", **more)
    return {(r["source"], r["key"]) for r in found.kept.collect()}, {r["source"]: r for r in found.cutoffs.collect()}


@pytest.mark.parametrize("most", [500_000, 5])
def test_against_brute_force(spark, most):
    rng = random.Random(most)
    rows = []
    for s, n in (("a", 3000), ("b", 1), ("c", 7), ("d", 400)):
        for i in range(n):
            v = rng.choice([round(rng.lognormvariate(2, 2), 2), round(rng.random(), 1), 5.0])
            rows.append((s, i, rng.choice([v] * 20 + [None, float("nan"), -1.0]), "x", 0.0))
    rows += rows[:200] + [(None, 1, 1.0, "x", 0.0), ("a", None, 1.0, "x", 0.0), ("z", 1, 1.0, "x", 0.0)]
    targets = [("a", 7), ("b", 50), ("c", 33), ("d", 0), ("d", None), ("q", 10)]
    kept, cuts = by_hand(rows, targets)
    got, found = run(spark, rows, targets, most_bracketed=most)
    assert got == kept and {s: r["cutoff"] for s, r in found.items()} == cuts
    assert all(r["n_kept"] == sum(k[0] == s for k in kept) for s, r in found.items())


def test_ties_edges_and_empty(spark):
    rows = [("a", i, 2.0, "x", 0.0) for i in range(50)] + [("b", i, float(i), "x", 0.0) for i in range(10)]
    for pct in (1, 100, 101, 0):
        kept, _ = by_hand(rows, [("a", pct), ("b", pct)])
        assert run(spark, rows, [("a", pct), ("b", pct)])[0] == kept
    assert run(spark, [], [("a", 5)]) == (set(), {}) and run(spark, rows, []) == (set(), {})
