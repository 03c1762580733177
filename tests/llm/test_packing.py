import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm.packing import pack_documents, sum_of_squares
from strandloom.llm.tokens import FOLDER, VOCABULARY, encoding

PATH = f"{FOLDER}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


def test_each_step_is_the_best_one():
    rng = random.Random(2)
    sizes = [rng.randrange(0, 15) for _ in range(150)]
    bins, room = sum_of_squares(np.array(sizes), 16)
    gaps = {}
    for size, b in zip(sizes, bins.tolist()):
        if size:
            def squares(g):
                return sum(n * n for n in Counter(x for x in g.values() if 0 < x < 16).values())

            options = [squares(gaps | {k: g - size}) for k, g in gaps.items() if g >= size]
            options.append(squares(gaps | {"new": 16 - size}))
            gaps[b] = gaps.get(b, 16) - size
            assert squares(gaps) == min(options)
        elif b not in gaps:
            gaps[b] = 16
    assert [gaps[b] for b in range(len(room))] == room.tolist() and min(room) >= 0


def check(spark, texts, capacity, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id bigint, text string, container string")
    rows = pack_documents(df, key="id", text="text", capacity=capacity, **more).collect()
    encode = encoding(PATH).encode_ordinary
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
        pieces[r["id"]].append((r["piece_no"], r["first_token"], r["n_tokens"]))
    assert max(fill.values(), default=0) <= capacity
    for i, t in texts:
        n, own = len(encode(t or "")), sorted(pieces[i])
        if len([1 for j, _ in texts if j == i]) == 1:
            assert sum(p[2] for p in own) == n and len(own) == max(1, -(-n // capacity))
            assert [p[1] for p in own] == [k * capacity for k in range(len(own))]
    room = {r["container"]: r["room"] for r in rows}
    assert all(room[c] == capacity - n for c, n in fill.items())
    return rows, fill


def test_whole_documents_and_little_room(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("tide rope a chapel of 1894".split()) for _ in range(rng.choice([3, 20, 60, 150, 700]))))
             for i in range(900)]
    rows, fill = check(spark, texts, 256, lot=150)
    assert sum(fill.values()) / (256 * len(fill)) > 0.97
    again, _ = check(spark, texts, 256, lot=150)
    assert sorted((r["id"], r["piece_no"], r["room"]) for r in rows) == sorted((r["id"], r["piece_no"], r["room"]) for r in again)


def test_nulls_copies_and_edges(spark):
    exact = "a" * 1
    texts = [(1, None), (2, ""), (3, exact), (None, "tide"), (4, "tide " * 64), (5, "rope"), (5, "rope"), (6, "x" * 5000)]
    rows, _ = check(spark, texts, 16)
    assert Counter(r["id"] for r in rows)[5] == 2
    assert check(spark, [], 16)[0] == []
