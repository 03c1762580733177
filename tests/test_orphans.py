import random
from datetime import datetime, timedelta

from strandloom.operators.orphans import orphan_counts, orphan_references, orphan_state

REF, PARENT = "ref_table string, row_id bigint, key string, at timestamp", "key string, added_at timestamp, retired_at timestamp"
DAY = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(60)]


def by_hand(refs, parents):
    found = set()
    for table, row, key, at in refs:
        key = (key or "").strip()
        if not key:
            continue
        own = [(a or datetime.min, r) for k, a, r in parents if (k or "").strip() == key]
        if not own:
            found.add((table, row, "missing"))
        elif at is not None and not any(a <= at and (r is None or at < r) for a, r in own):
            found.add((table, row, "late" if at < min(a for a, _ in own) else "deleted"))
    return found


def run(spark, refs, parents, slices=4):
    found = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), slices)
    return {(r["ref_table"], r["row_id"], r["reason"]) for r in found.collect()}, found


def test_against_brute_force(spark):
    rng = random.Random(5)
    keys = [f"k{i}" for i in range(12)]
    parents = []
    for k in keys[:9]:
        for _ in range(rng.choice([1, 1, 2, 3])):
            a = rng.randrange(50)
            parents.append((k, DAY[a], rng.choice([None, DAY[rng.randrange(a, 60)]])))
    refs = [("t", i, rng.choice(["", " ", "\t"]) + rng.choice(keys), rng.choice(DAY)) for i in range(400)]
    refs += [("u", i, "k1", DAY[i % 60]) for i in range(200)]  # one key with a third of the rows
    refs += refs[:50] + [("t", 900, None, DAY[3]), ("t", 901, "  ", DAY[3]), ("t", 902, "k1", None), ("t", 903, "zz", None)]
    for slices in (1, 4, 9):
        assert run(spark, refs, parents, slices)[0] == by_hand(refs, parents)


def test_deletion_arrival_and_null_bounds(spark):
    parents = [("a", DAY[5], DAY[10]), ("a", DAY[20], None), ("b", None, DAY[3]), ("c", DAY[30], None)]
    refs = [("t", i, k, DAY[d]) for i, (k, d) in enumerate(
        [("a", 4), ("a", 5), ("a", 10), ("a", 19), ("a", 20), ("b", 2), ("b", 3), ("c", 1), ("d", 1)])]
    assert run(spark, refs, parents)[0] == {
        ("t", 0, "late"), ("t", 2, "deleted"), ("t", 3, "deleted"), ("t", 6, "deleted"), ("t", 7, "late"), ("t", 8, "missing"),
    }


def test_empty_tables_and_counts(spark):
    assert run(spark, [], [("a", DAY[0], None)])[0] == set()
    ids, found = run(spark, [("t", 1, "a", DAY[0]), ("t", 1, "a", DAY[0])], [])
    assert ids == {("t", 1, "missing")}
    assert [tuple(r) for r in orphan_counts(found).collect()] == [("t", "2020-01", "missing", 1)]


def test_counts_after_every_slice(spark):
    rng = random.Random(8)
    parents = []
    for k in "abcdefgh":
        for _ in range(rng.choice([1, 2, 3])):
            a = rng.randrange(50)
            parents.append((k, DAY[a], rng.choice([None, DAY[rng.randrange(a, 60)]])))
    refs = [("t", i, rng.choice("abcdefghxy"), rng.choice(DAY)) for i in range(300)]
    state = orphan_state(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), 5)
    assert len(state.counts) == len(state.until) == 5
    reopened = 0
    for i, until in enumerate(state.until):
        end = datetime.max if until is None else datetime(1970, 1, 1) + timedelta(microseconds=until)
        seen = [r for r in refs if r[3] < end]
        # a parent retired later still holds; one that arrives later isn't known yet
        known = [(k, a, None if r and r >= end else r) for k, a, r in parents if a < end]
        wanted = {}
        for _, _, reason in by_hand(seen, known):
            wanted[reason] = wanted.get(reason, 0) + 1
        got = {r["reason"]: r["n_orphans"] for r in state.counts[i].collect()}
        assert got == wanted
        reopened += got.get("deleted", 0)
    assert reopened
