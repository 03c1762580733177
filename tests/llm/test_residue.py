import os
import random

import numpy as np
import pandas as pd
import pytest

from strandloom.llm import residue
from strandloom.llm.residue_examples import examples



@pytest.fixture(scope="module")
def tables(data):
    texts = pd.read_parquet(os.path.join(os.path.dirname(data), "sf0.01", "documents.parquet"), columns=["text"]).text
    counts = np.zeros(residue.CLASSES**residue.GRAM, dtype=np.int64)
    for _, joined in residue._chunks([t for t in texts if t]):
        code, crosses = residue._grams(joined)
        counts += np.bincount(code[~crosses], minlength=len(counts))
    return residue.fit(counts)


PLAIN = (
    "Our computing column answers Mr Carrholm of Wenford: yes, you may switch JavaScript off at home, though some shops "
    "will then not load. Prices of barley were idle at Wenford, while tar remained sturdy because of want of funds."
)
CASES = {
    "template": ["Prices of barley {{ author }} were idle.", "%%BYLINE%%", "Dear [FIRST NAME], the tide ran late at Wenford."],
    "filler": ["The tide ran. Lorem ipsum dolor sit amet consectetur elit sed nulla vitae magna. The tide ran."],
    "notice": [
        "The tide ran late. Please enable JavaScript to view this newspaper. The tide ran late at Wenford.",
        "Error 404: the requested issue could not be found. Please try again later.",
        "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    ],
}


def run(spark, rows, tables):
    df = spark.createDataFrame(rows, "id bigint, text string, kind string, n_chars int")
    found = residue.residue_spans(df, key="id", text="text", tables=tables).collect()
    return {(r["id"], r["kind"]): (r["n_covered"], r["n_chars"]) for r in found}


def test_kinds(spark, tables):
    cases = [(k, t) for k, ts in CASES.items() for t in ts]
    rows = [(i, t, "x", 0) for i, (_, t) in enumerate(cases)] + [(90, PLAIN, "x", 0), (91, PLAIN.upper(), "x", 0)]
    got = run(spark, rows, tables)
    assert {(i, k) for i, (k, _) in enumerate(cases)} <= set(got) and not {90, 91} & {i for i, _ in got}
    assert all(0 < n <= size for n, size in got.values())
    again = run(spark, [(i + 100 * c, t, k, n) for c in range(3) for i, t, k, n in rows], tables)
    assert len(again) == 3 * len(got)


def test_long_null_and_empty(spark, tables):
    rng = random.Random(1)
    long = " ".join(rng.choice(PLAIN.split()[16:]) for _ in range(200_000))
    assert run(spark, [(1, None, "", 0), (2, "", "", 0), (3, "a", "", 0), (4, "\0", "", 0)], tables) == {}
    got = run(spark, [(1, long + " ${title} {{ author }} " + long, "", 0), (2, "é" * 10, "", 0)], tables)
    assert set(got) == {(1, "template")}
    assert run(spark, [], tables) == {}


def test_examples_drawn_anew_are_found(tables):
    """Other draws of the same wording, so this shows that the fit works and nothing about wording not seen."""
    fresh = examples(seed=1234)
    rng = random.Random(3)
    for kind, texts in fresh.items():
        sample = rng.sample(texts, 200)
        hits = 0
        for t in sample:
            code, crosses = residue._grams(f"{residue._PAD}{t}{residue._PAD}")
            masks = [residue._covered(tables[m][code], crosses, residue.WINDOWS[m]) for m in residue.MODELS[kind]]
            hits += np.logical_or.reduce(masks).sum() >= residue.COVERED[kind]
        assert hits >= 0.9 * len(sample), (kind, hits)


def test_counts_against_a_plain_count(spark):
    texts = ["abca bcab", "abc", "", "zz\nab{c}"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = residue.gram_counts(df)
    wanted = sum(max(0, len(t) + 2 * len(residue._PAD) - residue.GRAM + 1) for t in texts)
    assert counts.sum() == wanted


def test_residue_on_a_third_of_pages_is_found(spark, data):
    texts = pd.read_parquet(os.path.join(os.path.dirname(data), "sf0.01", "documents.parquet"), columns=["text"]).text
    rng = random.Random(8)
    rows = []
    for i, t in enumerate(t for t in texts if t and len(t) > 400):
        words = t.split(" ")
        at = rng.randrange(len(words))
        rows.append((i, " ".join([*words[:at], "{{ headline }}", *words[at:]]) if i % 3 == 0 else t, "", 0))
    filler = " ".join(CASES["filler"]) + " Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi aliquip. "
    rows += [(10_000 + i, filler * 10, "", 0) for i in range(len(rows) // 2)]
    got = run(spark, rows, None)
    assert all((r[0], "template") in got for r in rows if r[0] < 10_000 and r[0] % 3 == 0)
    assert all((r[0], "filler") in got for r in rows if r[0] >= 10_000)
    natural = [r[0] for r in rows if r[0] < 10_000 and r[0] % 3]
    assert len({i for i, _ in got} & set(natural)) < 0.08 * len(natural)


def test_every_context_counts(spark):
    """More text than any sample of it would hold: the counts are those of all windows."""
    rng = np.random.default_rng(4)
    drawn = rng.choice(np.array(list("etaoin{z ")), size=8_200_000).astype("U1")
    rows = ["".join(drawn[i : i + 41_000]) for i in range(0, len(drawn), 41_000)]
    rows += ["click here to subscribe"] * 500 + ["", "a"]
    df = spark.createDataFrame(pd.DataFrame({"text": rows})).repartition(7)
    found = residue.context_counts(df)
    codes = [residue._grams(f"{residue._PAD}{t}{residue._PAD}")[0].astype(np.uint64) for t in rows]
    size, n = np.uint64(len(found)), 2 * residue.GRAM
    ends = np.concatenate([c[:-n] * size + c[n:] for c in codes])
    middle = np.concatenate([c[residue.GRAM : -residue.GRAM] for c in codes])
    order = np.lexsort((middle, ends))
    ends, middle = ends[order], middle[order]
    ends = ends[np.concatenate(([True], (np.diff(ends) != 0) | (np.diff(middle) != 0)))]
    sides = [np.bincount(x.astype(np.int64), minlength=len(found)) for x in (ends // size, ends % size)]
    assert (found == np.minimum(*sides)).all() and found.sum() > 2_000_000
    here = residue._grams("click here to subscribe")[0]
    assert np.median(found[here]) == 1
