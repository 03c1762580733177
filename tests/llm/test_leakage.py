import random
import re
import string
import sys
from difflib import SequenceMatcher

import numpy as np

from strandloom.llm import fingerprints as fp
from strandloom.llm import leakage, runs
from strandloom.llm.leakage import column_order, leaked_items
from strandloom.llm.letters import MISREADINGS, SIZE, plain
from strandloom.llm.runs import Lines, Passage, _opcodes, _placements, _rough_runs, longest_run, longest_runs

WORDS = ("harbour lantern seventeen carriage bishop turnips yellow market quarrel station orchard velvet thunder butcher "
         "canal almanac pepper widow garrison stable ledger magistrate fiddler herring brewery chimney").split()  # fmt: skip
OTHERS = {one: rest.split() for line in MISREADINGS for one, _, rest in [line.partition(":")]}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def wrapped(text, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            cut = width - len(line) - 2
            if cut > 2 and len(w) - cut > 2:
                lines.append(f"{line} {w[:cut]}-")
                line = w[cut:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def misread(text, share, rng):
    return "".join(rng.choice(OTHERS[c]) if c in OTHERS and rng.random() < share else c for c in text)


def test_index_finds_every_pair_within_its_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    others = prints.copy()
    for i in range(len(others)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            others[i] ^= np.uint64(1) << np.uint64(b)
    mine, theirs = fp.MultiIndex(prints).near(others, chunk=700)
    near = np.bitwise_count(others[:, None] ^ prints[None, :]) <= fp.RADIUS
    assert set(zip(mine.tolist(), theirs.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_fingerprints_and_similarity_by_hand():
    rng = np.random.default_rng(2)
    shingles = rng.integers(0, SIZE**3, 200).astype(np.int32)
    weight = fp.weights(rng.integers(0, 1000, SIZE**3))
    table = fp.lanes(weight)
    got = fp.window_prints(shingles, table, weight)
    for k, value in enumerate(got.tolist()):
        window = shingles[k * fp.STEP : k * fp.STEP + fp.WINDOW]
        sums = (table.view(np.uint8).reshape(-1, 64)[window].astype(int)).sum(axis=0)
        wanted = sum(1 << b for b in range(64) if sums[b] > int(weight[window].astype(int).sum()) // 2)
        assert value == wanted
    a, b = np.array([[1, 1, 2]]), np.array([[2, 3, 3]])
    w = np.arange(10, dtype=np.uint8)
    assert fp.weighted_overlap(a, b, w)[0] == 2 / 6


def run(text, lines):
    return longest_run(Passage(text), Lines([plain(x) for x in lines]))


def test_runs():
    rng = random.Random(6)
    text = prose(rng, 60)
    lines = wrapped(text, 40)
    assert run(text, lines) == 60
    foreign = [x for line in lines for x in (line, prose(rng, 4))]
    assert run(text, foreign) == 60
    assert run(text, wrapped(misread(text, 0.03, rng), 40)) >= 50
    words = text.split()
    assert 18 <= run(text, wrapped(" ".join(words[20:39]), 30)) <= 19
    broken = words[:15] + ["elsewhere", "altogether"] + words[15:30] + ["notwithstanding"] + words[31:45]
    assert run(text, wrapped(" ".join(broken), 50)) <= 15
    assert run(text, [prose(rng, 60_000) + " " + text + " " + prose(rng, 60_000)]) == 60
    assert run(text, []) == 0 and run("", lines) == 0 and run("three short words", ["three short words"]) == 0


def test_columns():
    left = np.array([60, 440, 62, 445, 60, 441])
    assert column_order(left).tolist() == [0, 2, 4, 1, 3, 5]
    assert column_order(np.array([60, 60, 90])) is None and column_order(np.array([60, 62, 61, 440, 441, 442])) is None
    assert column_order(np.array([440, 441, 442, 60, 130, 61, 62])).tolist() == [3, 4, 5, 6, 0, 1, 2]


def pages(spark, rows):
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    return spark.createDataFrame(rows, f"id bigint, text string, boxes {box}, passage string, words int")


def found(spark, rows, items, **more):
    tests = spark.createDataFrame(items, "item bigint, passage string, words string")
    hits = leaked_items(pages(spark, rows), tests, key="id", text="text", boxes="boxes", item_key="item",
                        item_text="passage", **more)
    return {(r["id"], r["item"]): r["words"] for r in hits.collect()}


def test_pages(spark):
    rng = random.Random(9)
    texts = [prose(rng, 70) for _ in range(8)]
    items = [(i, t, "") for i, t in enumerate(texts)] + [(99, texts[0], ""), (98, None, ""), (97, "short", "")]
    part = " ".join(texts[1].split()[10:40])
    columns = [wrapped(texts[2], 30), wrapped(prose(rng, 70), 30)]
    across = [x for pair in zip(*columns) for x in pair]
    boxes = [(60 + 380 * (i % 2), 100 + 30 * (i // 2), 400 + 380 * (i % 2), 130, 0.9) for i in range(len(across))]
    rows = [
        (1, "\n".join(wrapped(prose(rng, 50), 40) + wrapped(misread(texts[0], 0.01, rng), 40)), None, "", 0),
        (2, "\n".join(wrapped(prose(rng, 20) + " " + part + " " + prose(rng, 20), 35)), [], "", 0),
        (3, "\n".join(across), boxes, "", 0), (4, prose(rng, 400), None, "", 0), (5, None, None, "", 0), (6, "", None, "", 0),
        (7, " ".join(texts[3].split()[:15]), None, "", 0), (1, "nothing here", None, "", 0),
    ]
    got = found(spark, rows, items)
    assert set(got) == {(1, 0), (1, 99), (2, 1), (3, 2)} and got[2, 1] >= 28
    assert found(spark, rows, items, at_once=3).keys() == got.keys()
    assert found(spark, rows, []) == {} and found(spark, [], items) == {}


def test_short_runs_with_misread_letters_and_foreign_lines_are_candidates():
    rng = random.Random(12)
    texts = [prose(rng, 80) for _ in range(20)]
    made = []
    for text in texts:
        words = text.split()
        start = min(range(60), key=lambda i: len("".join(words[i : i + 20])))
        short = [w[:4] for w in words[start : start + 20]]  # about 80 letters
        made.append((" ".join(words[:30] + short + words[50:]), short))
    index = leakage.PassageIndex([t for t, _ in made], fp.weights(np.zeros(SIZE**3)), 20)
    pages = []
    for _, short in made:
        lines = [" ".join(short[i : i + 7]) for i in (0, 7, 14)]
        lines[::2] = [f"{x[:5]}w{x[6:]}" for x in lines[::2]]  # a letter of another class
        pages.append(["\n".join([lines[0], "zzz kkk", lines[1], "zzz kkk", lines[2]])])
    got = set(map(tuple, index.find(pages).tolist()))
    assert {(i, i) for i in range(20)} <= got
    assert all(i in index.promising(page, list(range(20))) for i, page in enumerate(pages))


def test_foreign_lines_of_any_number_and_other_alphabets_do_not_interrupt(spark):
    rng = random.Random(21)
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπχρστθωςχυζ")
    polish = str.maketrans("aceloszn", "ąćęłóśźń")
    cyrillic = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстужвьыз")
    texts = [prose(rng, 60).translate(x) for x in ({}, greek, polish, cyrillic)]
    rows = []
    for i, text in enumerate(texts):
        lines = wrapped(" ".join(text.split()[10:40]), 40)
        for n in (15, 40, 200):
            page = [x for line in lines for x in (line, *[prose(rng, 6) for _ in range(n)])]
            rows.append((len(rows), "\n".join(page), None, str(i), n))
    got = found(spark, rows, [(i, t, "") for i, t in enumerate(texts)])
    assert set(got) == {(r[0], int(r[3])) for r in rows} and all(30 <= n <= 32 for n in got.values())


def test_a_line_may_hold_parts_of_a_passage_at_many_places():
    rng = random.Random(22)
    words = prose(rng, 200).split()
    cut = [" ".join(words[i : i + 30]) for i in range(0, 200, 40)]
    page = f" {prose(rng, 9)} ".join([*cut, " ".join(words[:38])])
    assert 30 <= run(" ".join(words), [page]) <= 38  # a piece of a long line is joined to one piece before it


def test_opcodes_are_those_of_difflib():
    rng = random.Random(6)
    for n in range(1500):
        letters = "ab" if n % 3 == 0 else "abcdefghij"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(90)))
        b = list(a[rng.randrange(9) :] if n % 2 else rng.choices(letters, k=rng.randrange(90)))
        for i in rng.sample(range(len(b)), min(len(b), rng.randrange(9))):
            b[i] = rng.choice(["", "x", "ab", "a"])
        other = "".join(b)
        assert _opcodes(a, other) == [tuple(x) for x in SequenceMatcher(None, a, other, autojunk=False).get_opcodes()]


def test_lines_found_in_one_order_serve_another():
    rng = random.Random(11)
    text = prose(rng, 60)
    lines = [plain(x) for x in wrapped(misread(text, 0.02, rng), 40)]
    foreign = [plain(x) for x in wrapped(prose(rng, 60), 40)]
    mixed = [x for pair in zip(lines, foreign) for x in pair] + lines[len(foreign) :]
    passage, known = Passage(text), {}
    for order in (mixed, lines, lines[::-1]):
        assert longest_run(passage, Lines(order), 20, known) == longest_run(passage, Lines(order), 20)
    assert known


def test_lines_that_go_on_with_none_cost_no_steps():
    rng = random.Random(8)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(60)]
    passage = Passage(" ".join(words))
    held = [" ".join(words[i : i + 5]) for i in range(0, 60, 5)]
    foreign = [f"qqqqqqq {' '.join(words[i + 1 : i + 4])} qqqqqqq" for _ in range(200) for i in range(0, 55, 5)]
    lines = Lines([plain(x) for x in held[:6] + foreign + held[6:]])
    found = _placements(passage, lines)
    assert found[0].shape[1] > len(foreign)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    chosen = _rough_runs(passage, lines, *found, 20)
    sys.setprofile(None)
    assert len(calls) < len(foreign)
    assert {number for number, *_ in chosen} == {*range(6), *range(6 + len(foreign), 12 + len(foreign))}
    assert longest_run(passage, lines, 20) == 60


def test_lines_between_which_no_short_line_stands_are_not_compared(monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7 if i % 4 < 2 else 3)) for i in range(600)]
    passage = Passage(" ".join(words))
    parts = [" ".join(words[i : i + 2]) for i in range(0, 600, 4)]  # two short words are missing after each
    compared = []
    laid = runs._laid
    monkeypatch.setattr(runs, "_laid", lambda *x: compared.append(x) or laid(*x))
    foreign = [plain(x) for _ in range(40) for part in parts for x in (part, "qqqqqq")]
    assert longest_run(passage, Lines(foreign), 20) < 20 and len(compared) < 20
    whole = [plain(x) for i in range(0, 600, 4) for x in (parts[i // 4], " ".join(words[i + 2 : i + 4]))]
    assert longest_run(passage, Lines(foreign + whole), 20) == 600


def test_pages_searched_at_once_hold_what_each_holds_alone():
    rng = random.Random(14)
    texts = [prose(rng, 60) for _ in range(5)]
    passages = [Passage(t) for t in texts]
    searches = []
    for i in range(40):
        held = wrapped(misread(" ".join(texts[i % 5].split()[i % 7 : 18 + i]), 0.02, rng), rng.choice([12, 30, 300]))
        lines = [plain(x) for line in held for x in (line, *wrapped(prose(rng, i % 4 * 3), 20))]
        order = np.array(rng.sample(range(len(lines)), len(lines))) if i % 2 else None
        if order is not None:  # what is held stands so in the other order only
            lines = [lines[k] for k in np.argsort(order)]
        searches.append((lines, order, passages))
    got = list(longest_runs(searches, 20))
    assert sum(n >= 20 for page in got for n in page) > 20
    for (lines, order, _), page in zip(searches, got):
        orders = [lines] if order is None else [lines, [lines[k] for k in order]]
        alone = [max(longest_run(p, Lines(x), 20) for x in orders) for p in passages]
        assert [n if n >= 20 else 0 for n in page] == [n if n >= 20 else 0 for n in alone]


def test_letters_of_any_alphabet_are_the_same_the_fast_way():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        text = f"A!{c}!b_{c}\n"
        slow = re.sub(r"[^\w\n]+|_+", "", re.sub(r"(?<=[^\W\d_])!(?=[^\W\d_])", "1", text.lower()))
        assert plain(text) == slow
