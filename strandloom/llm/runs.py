"""The longest run of a passage's words that a page holds, line by line, misread letters allowed."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np

from strandloom.llm.letters import EXPLAINED, GRAM, NO_LETTER, SIZE, folded, grams, plain

#: Letters by which rough placements may be off, and beyond a rough placement that are compared.
SLACK, MARGIN = 4, 40
#: Lines of fewer letters are only looked for where they fill the gap between two others.
SHORT = 12
#: The share of its letters that a word of a run has at least in shingles that agree; words of fewer than WORD may have none.
AGREED, WORD = 0.3, 4
#: The share of its letters that agree with the line, for a word that may be read.
READ = 0.55
#: Lines of more letters are cut into pieces of LONG / 2, so that what is compared stays short.
LONG = 120
#: Letters between passages that are searched for at once, so that no line reaches from one into another; and how many
#: letters of passages are searched for, and compared, at once.
APART, TOGETHER, _CELLS = LONG + 8, 1 << 16, 1 << 19
#: So few placements are searched for runs at once; of more, first those are left out that can't lie on one.
FEW = 4_000


class Passage:
    def __init__(self, text: str, min_words: int = 20):
        words = [w for w in (plain(w) for w in re.split(r"\s+", text)) if w]
        ends = np.cumsum([len(w) for w in words]).tolist()
        self.letters = "".join(words)
        self.spans = list(zip([0, *ends[:-1]], ends)) if words else []
        self.ends = np.array([0, *ends], dtype=np.int64)
        self.codes = folded(self.letters)
        self.shingles = grams(self.codes)
        self.order = np.argsort(self.shingles)  # sorted shingles are found faster
        self.ordered = self.shingles[self.order]
        runs = zip(self.spans, self.spans[min_words - 1 :])
        self.least = min((b[1] - a[0] for a, b in runs), default=None)  # letters of the shortest run; None: no run
        self.starts, self.stops = np.array([0]), np.array([len(self.letters)])
        self.apart = np.zeros(len(words), dtype=bool)
        self.word = np.repeat(np.arange(len(words)), np.diff(self.ends))  # of each letter
        self.part = np.zeros(len(self.letters), dtype=np.int64)  # the passage of each letter


class Joined:
    """Passages in a row, to be searched for at once: APART letters that agree with nothing, one word, follow each.

    Each is searched for in the lines of one page, and may stand there for several.
    """

    def __init__(self, passages: list[Passage], pages: list[int]):
        sizes = np.array([len(p.letters) for p in passages], dtype=np.int64)
        self.starts = np.cumsum(sizes + APART) - sizes - APART
        self.stops = self.starts + sizes
        gap = np.full(APART, NO_LETTER - 1, dtype=np.uint8)
        self.letters = "".join([p.letters + "\n" * APART for p in passages])
        self.codes = np.concatenate([x for p in passages for x in (p.codes, gap)])
        self.order = np.concatenate([p.order + s for p, s in zip(passages, self.starts)])
        self.ordered = np.concatenate([p.ordered + k * SIZE**GRAM for p, k in zip(passages, pages)])
        self.ends = np.append(np.concatenate([p.ends + s for p, s in zip(passages, self.starts)]), len(self.codes))
        self.words = np.cumsum([0, *(len(p.ends) for p in passages)])  # where the words of each begin
        self.apart = np.zeros(len(self.ends) - 1, dtype=bool)
        self.apart[self.words[1:] - 1] = True
        self.word = np.repeat(np.arange(len(self.apart)), np.diff(self.ends))
        self.part = np.repeat(np.arange(len(sizes)), sizes + APART)


_BEGIN = {(a[0], b[0]) for pair in EXPLAINED for a, b in (pair, pair[::-1])}


def _explains(a: str, b: str) -> bool:
    return (a, b) in EXPLAINED or (b, a) in EXPLAINED


@lru_cache(1 << 16)
def _accounted(a: str, b: str) -> bool:
    """Whether reading ``b`` for ``a`` is a chain of known misreadings."""
    if a == b:
        return True
    if not a or not b or len(b) > 3 * len(a) + 3 or len(a) > 3 * len(b) + 3:
        return False
    for i in (1, 2):
        for j in (1, 2, 3):
            if i <= len(a) and j <= len(b) and (a[:i] == b[:j] or _explains(a[:i], b[:j])):
                if _accounted(a[i:], b[j:]):
                    return True
    return False


@dataclass
class _Fragment:
    """A stretch [lo, hi) of the passage that one line reads without a break."""

    line: int
    lo: int
    hi: int
    from_start: bool  # it begins where the line begins, and so on
    to_end: bool
    weak: frozenset[int]  # letters read as something unknown
    start: int = 0  # where its run of lines begins


def _reading(a: str, b: str, first: bool, last: bool) -> tuple[int, int, bool] | None:
    """Which part of ``a`` the letters ``b`` stand for (from, to, known), if any."""
    n = len(a)
    spans = [(0, n)]
    if first or last:  # beyond the line's ends the part of the passage is wider than what was read
        sizes = sorted(range(1, n + 1), key=lambda k: abs(k - len(b)))
        spans = [(n - k, n) for k in sizes] if first else [(0, k) for k in sizes]
    for i, j in spans:
        if j - i < 9 and len(b) < 12 and _accounted(a[i:j], b):
            return i, j, True
    for i, j in spans:
        if j - i == len(b) <= 2 and not (a[i:j] + b).isdigit():
            return i, j, False
    return None


def _opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """What difflib's SequenceMatcher(None, a, b, autojunk=False).get_opcodes() gives.

    Which letters are equal stands in one number, a row of bits for each letter
    of ``a``: shifted by a row and a bit, it shows all diagonals at once.
    """
    if not a or not b:
        return [("delete", 0, len(a), 0, 0)] if a else [("insert", 0, 0, 0, len(b))] if b else []
    width = len(b) // 8 + 1  # bytes of a row; one bit at least stays free, so that no diagonal runs on in another row
    at: dict[str, int] = dict.fromkeys(a, 0)
    for j, c in enumerate(b):
        if c in at:
            at[c] |= 1 << j
    of = {c: x.to_bytes(width, "little") for c, x in at.items()}
    rows = b"".join([of[c] for c in a])
    step = 8 * width + 1
    blocks, queue = [], [(0, len(a), 0, len(b))]
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        equal = int.from_bytes(rows[alo * width : ahi * width], "little")
        if blo or bhi < len(b):
            equal &= int.from_bytes(((1 << bhi) - (1 << blo)).to_bytes(width, "little") * (ahi - alo), "little")
        if not equal:
            continue
        runs, size = [equal], 1  # where 1, 2, 4, ... letters in a row are equal
        while longer := runs[-1] & (runs[-1] >> (size * step)):
            runs.append(longer)
            size *= 2
        longest = runs.pop()
        while runs:
            more = runs.pop()
            if longer := longest & (more >> (size * step)):
                longest = longer
                size += 1 << len(runs)
        i, j = divmod((longest & -longest).bit_length() - 1, 8 * width)
        i += alo
        blocks.append((i, j, size))
        if alo < i and blo < j:
            queue.append((alo, i, blo, j))
        if i + size < ahi and j + size < bhi:
            queue.append((i + size, ahi, j + size, bhi))
    blocks.sort()
    ops: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y, size in [*blocks, (len(a), len(b), 0)]:
        if i < x or j < y:
            ops.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if size and ops and ops[-1][0] == "equal":  # blocks that touch are one
            ops[-1] = ("equal", ops[-1][1], x + size, ops[-1][3], y + size)
        elif size:
            ops.append(("equal", x, x + size, y, y + size))
        i, j = x + size, y + size
    return ops


def _fragments(letters: str, start: int, stop: int, line: str, number: int) -> list[_Fragment]:
    part = letters[start:stop]
    exact = part.find(line)
    if exact >= 0:
        return [_Fragment(number, start + exact, start + exact + len(line), True, True, frozenset())]
    ops = _opcodes(part, line)
    found: list[_Fragment] = []
    lo = hi = None
    weak: set[int] = set()
    from_start = False

    def close(to_end: bool) -> None:
        nonlocal lo, weak
        if lo is not None:
            found.append(_Fragment(number, lo, hi, from_start, to_end, frozenset(weak)))
        lo, weak = None, set()

    for k, (kind, i1, i2, j1, j2) in enumerate(ops):
        first, last = k == 0, k == len(ops) - 1
        if kind == "insert":
            if j2 - j1 > 2:
                close(False)
            continue
        if kind == "delete":
            if first or last:
                continue
            if i2 - i1 > 1:
                close(False)
            else:
                weak.add(start + i1)
                hi = start + i2
            continue
        known = (0, i2 - i1, True)
        if kind == "replace":
            known = _reading(part[i1:i2], line[j1:j2], first, last)
        if known is None:
            close(False)
            continue
        a, b = start + i1 + known[0], start + i1 + known[1]
        if lo is None:
            lo, from_start = a, j1 <= 1
        if not known[2]:
            weak.update(range(a, b))
        hi = b
    tail = ops[-1] if ops else None
    close(tail is not None and (tail[0] != "insert" or tail[4] - tail[3] <= 1))
    return found


def longest_run(passage: Passage, lines: Lines, wanted: int = 1, known: dict[tuple, list[tuple]] | None = None) -> int:
    """How many consecutive words of the passage stand in the lines; 0 if too few shingles agree for ``wanted`` words.

    Each line is laid where most of its letter shingles agree with the passage.
    A run goes on within a line, or from the end of one line to the start of a
    later one that takes up where it ended; the lines between, however many, are
    foreign and don't interrupt. Words count if all their letters are read, rightly or with
    known misreadings; longer words may have one or two unknown ones. ``known``
    keeps what is found of each line, for the same lines in other orders.
    """
    if passage.least is None:
        return 0
    placed = _agreed(passage, *_placements(passage, lines), wanted)
    chosen = _chains(passage, lines, _readable(passage, lines, placed), wanted)
    return _measured(passage, lines, chosen.T.tolist(), wanted, {} if known is None else known)


def longest_runs(
    searches: list[tuple[list[str], np.ndarray | None, list[Passage]]], wanted: int
) -> Iterator[list[int]]:
    """For each page's lines, their other order if there is one, and passages: longest_run of each, the longest in any order."""
    group, size = [], 0
    for search in searches:
        letters = sum(len(x) for x in search[0]) + sum(len(p.letters) + APART for p in search[2])
        if group and size + letters > TOGETHER:
            yield from _grouped(group, wanted)
            group, size = [], 0
        group.append(search)
        size += letters
    if group:
        yield from _grouped(group, wanted)


def _grouped(group: list[tuple[list[str], np.ndarray | None, list[Passage]]], wanted: int) -> list[list[int]]:
    counts = [len(x) for x, _, _ in group]
    first = np.cumsum([0, *counts])
    lines = Lines([x for page, _, _ in group for x in page], np.repeat(np.arange(len(group)), counts))
    several = [lines]
    turned = np.array([order is not None for _, order, _ in group])
    if turned.any():
        orders = [np.arange(n) if order is None else order for n, (_, order, _) in zip(counts, group)]
        several.append(lines.in_order(np.concatenate([x + k for x, k in zip(orders, first)])))
    passages = [p for _, _, some in group for p in some]
    pages = np.repeat(np.arange(len(group)), [len(some) for _, _, some in group])
    best = [0] * len(passages)
    sizes = np.cumsum([len(p.letters) for p in passages])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // TOGETHER)) + 1).tolist(), len(passages)]
    for i, j in zip(cuts, cuts[1:]):
        joined = Joined(passages[i:j], pages[i:j].tolist())
        placed = _agreed(joined, *_placements(joined, lines), wanted)
        # most passages are done with here; those that aren't are joined anew
        part, left = joined.part[placed[1]], joined
        kept = np.flatnonzero(np.bincount(part, minlength=j - i)) + i
        if not len(kept):
            continue
        joined = Joined([passages[k] for k in kept], pages[kept].tolist())
        number = np.searchsorted(kept, part + i)
        placed[1:3] += joined.starts[number] - left.starts[part]
        read = _readable(joined, lines, placed)
        found: list[dict[tuple, list[tuple]]] = [{} for _ in kept]
        for order in several:
            if order is not lines:
                read = read.only(turned[pages[kept][joined.part[read.placed[1]]]])
            chosen = _chains(joined, order, read, wanted)
            whose = joined.part[chosen[1]]
            for k in np.unique(whose).tolist():
                own = chosen[:, whose == k]
                own[1:3] -= joined.starts[k]
                own[4:] -= joined.words[k]
                n = _measured(passages[kept[k]], order, own.T.tolist(), wanted, found[k])
                best[kept[k]] = max(best[kept[k]], n)
    ends = np.cumsum([0, *(len(some) for _, _, some in group)]).tolist()
    return [best[a:b] for a, b in zip(ends, ends[1:])]


def _measured(passage: Passage, lines: Lines, chosen: list[list[int]], wanted: int, known: dict[tuple, list[tuple]]) -> int:
    """The longest run in the chosen placements.

    A line is only compared if enough words can lie between what was really
    found to lead to it, or its own beginning, and the word it may lead to.
    """
    best, least = 0, wanted - 3
    starts, ends = [s for s, _ in passage.spans], [e for _, e in passage.spans]
    # By where they end, the pieces so far that reach the end of their line: those from which runs start ever
    # earlier, of pieces cut from a longer line only the latest (only the next may go on with it).
    ending: dict[int, list[_Fragment]] = {}
    latest: dict[int, _Fragment] = {}
    short: dict[tuple[int, int], list[int]] = {}  # the short lines that read a part of the passage
    reach = SHORT + SLACK + 1
    lead = [len(passage.letters)] * (len(passage.letters) + 2 * reach)  # the earliest start of what leads to a place
    for number, placed in groupby(chosen, itemgetter(0)):
        pieces: dict[tuple, _Fragment] = {}
        text = lines.text[number]
        for _, lo, hi, at, on, after, ahead in placed:
            if ahead - after < least and not lines.goes_on[number]:
                begin = min(lo, min(lead[lo : lo + reach + SLACK + 2]))
                if on - (bisect_right(starts, begin) - 1) < least:
                    continue
            key = (lo, hi, at, text)
            if key not in known:
                known[key] = _laid(passage.letters, *key)
            for f in known[key]:
                pieces[f] = _Fragment(number, *f)
        added: list[_Fragment] = []
        for f in sorted(pieces.values(), key=lambda f: f.lo):
            f.start = f.lo
            if f.from_start:
                if lines.goes_on[f.line]:
                    earlier = [latest[e] for e in range(f.lo - 1, f.lo + 2) if e in latest and latest[e].line == f.line - 1]
                else:
                    earlier = [p for e in range(f.lo - SHORT - 1, f.lo + 2) for p in ending.get(e, ())]
                for p in sorted(earlier, key=lambda p: (abs(f.lo - p.hi), p.start, -p.line)):
                    if p.start < f.start and _follows(passage.letters, p, f, lines, short):
                        f.start = p.start
                        f.weak = f.weak | p.weak | ({p.hi} if f.lo == p.hi + 1 else set())
                        break
            if f.to_end:
                added.append(f)
            if bisect_right(ends, f.hi) - bisect_left(starts, f.start) > best:
                best = max(best, _words(passage, f))
        for p in added:
            if p.hi not in latest or (latest[p.hi].line, -latest[p.hi].start) < (p.line, -p.start):
                latest[p.hi] = p
            same = ending.setdefault(p.hi, [])
            if not lines.goes_on[p.line + 1] and (not same or p.start < same[-1].start):
                same.append(p)
                lead[p.hi + reach] = min(lead[p.hi + reach], p.start)
    return best


def _laid(letters: str, lo: int, hi: int, at: int, line: str) -> list[tuple[int, int, bool, bool, frozenset[int]]]:
    """The fragments of a line where it was laid; of a very long line only the part by the passage is compared."""
    first, last = max(0, at - MARGIN), min(len(line), at + hi - lo + MARGIN)
    found = _fragments(letters, max(0, lo - 3), min(len(letters), hi + 4), line[first:last], 0)
    return [(f.lo, f.hi, f.from_start and first == 0, f.to_end and last == len(line), f.weak) for f in found]


def _follows(letters: str, p: _Fragment, f: _Fragment, lines: Lines, short: dict[tuple[int, int], list[int]]) -> bool:
    gap = f.lo - p.hi
    if -1 <= gap <= 1:
        return True
    if not 1 < gap <= SHORT + 1:
        return False
    if (p.hi, f.lo) not in short:
        part = letters[p.hi : f.lo]
        fits = []
        for size in range(gap - 2, gap + 3):
            for i in lines.by_size.get(size, ()):
                text = lines.text[i]
                if (part[0] == text[0] or (part[0], text[0]) in _BEGIN) and _accounted(part, text):
                    fits.append(i)
        fits.sort()
        short[p.hi, f.lo] = fits
    fits = short[p.hi, f.lo]
    return bisect_left(fits, p.line + 1) < bisect_left(fits, f.line)


def _words(passage: Passage, f: _Fragment) -> int:
    best = run = 0
    for s, e in passage.spans:
        if s < f.start:
            continue
        if e > f.hi:
            break
        allowed = 0 if e - s < 4 else 1 if e - s < 8 else 2
        run = run + 1 if sum(s <= w < e for w in f.weak) <= allowed else 0
        best = max(best, run)
    return best


class Lines:
    """The lines of letters of a page, or of several, in one order, with their shingles."""

    def __init__(self, lines: list[str], pages: np.ndarray | None = None):
        cuts = [range(0, max(len(x) - LONG // 2, 0) + 1, LONG // 2) if len(x) > LONG else (0,) for x in lines]
        lines = [x[i : i + LONG // 2] if len(x) > LONG else x for x, cut in zip(lines, cuts) for i in cut]
        self.text = lines
        self.goes_on = [i > 0 for cut in cuts for i in cut] + [False]  # a piece goes on with the line before it
        self.pieces = [len(cut) for cut in cuts]
        self.rank = np.arange(len(lines))  # where each line of the first order stands
        self._count()
        self.lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        self.numbers = np.flatnonzero(self.lengths >= GRAM)
        self.sizes = self.lengths[self.numbers]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = folded("".join([lines[i] for i in self.numbers.tolist()]))
        self.line = np.repeat(np.arange(len(self.numbers)), self.sizes)
        own = grams(self.letters)
        last = 0
        if pages is not None and len(pages):
            pages = np.repeat(pages, self.pieces)[self.numbers]
            own = own + pages[self.line[: len(own)]] * SIZE**GRAM
            last = int(pages[-1]) if len(pages) else 0
        inside = np.flatnonzero(self.line[: len(own)] == self.line[GRAM - 1 :]) if len(own) else np.empty(0, np.int64)
        own = own[inside]
        order = np.argsort(own)
        every, place = own[order], inside[order]
        # the distinct shingles in their order (the last is none), where the places of each begin, and their lines and columns
        begin = np.flatnonzero(np.diff(every, prepend=-1))
        self.own, self.begin = np.append(every[begin], (last + 1) * SIZE**GRAM), np.append(begin, [len(every), len(every)])
        self.row = self.line[place]
        self.column = place - self.starts[self.row]

    def _count(self) -> None:
        self.counts: dict[int, list[int]] = {}
        self.by_size: dict[int, list[int]] = {}  # the short lines
        sizes = np.fromiter(map(len, self.text), dtype=np.int64, count=len(self.text))
        for i in np.flatnonzero((sizes > 0) & (sizes <= SHORT)).tolist():
            self.by_size.setdefault(len(self.text[i]), []).append(i)

    def in_order(self, order: np.ndarray) -> Lines:
        """The same lines in another order; it has the numbers of the lines before they were cut."""
        first = np.cumsum([0, *self.pieces]).tolist()
        turn = [k for i in order.tolist() for k in range(first[i], first[i + 1])]
        other = copy(self)
        other.text = [self.text[k] for k in turn]
        other.goes_on = [*(self.goes_on[k] for k in turn), False]
        other.rank = np.argsort(turn)
        other._count()
        return other

    def short_before(self, size: int) -> list[int]:
        """How many short lines of about that size stand before each line."""
        if size not in self.counts:
            some = np.zeros(len(self.text) + 1, dtype=np.int64)
            for k in range(size - SLACK, size + SLACK + 1):
                some[[i + 1 for i in self.by_size.get(k, ())]] = 1
            self.counts[size] = np.cumsum(some).tolist()
        return self.counts[size]


def _placements(passage: Passage | Joined, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """line, from, to, at: the parts of the passage that lines agree with and where in the line; and where it agrees.

    The latter are the starts of shingles. Placements are sorted by line.
    """
    none = np.empty((4, 0), dtype=np.int64), np.empty(0, dtype=np.int64)
    n, sizes = len(passage.codes), lines.sizes
    # every place of a line where a shingle of the passage stands is a vote for (line, offset)
    which = np.minimum(np.searchsorted(lines.own, passage.ordered), len(lines.own) - 1)
    hit = np.flatnonzero(lines.own[which] == passage.ordered)
    if not len(hit):
        return none
    which = which[hit]
    first = lines.begin[which]
    count = lines.begin[which + 1] - first
    at = np.repeat(passage.order[hit], count)
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(at))
    longest = int(sizes.max())
    width = n + 2 * longest
    bits = n.bit_length()
    ballot = ((lines.row * width + longest - lines.column) << bits)[place]
    ballot += at * ((1 << bits) + 1)  # with the place that votes, so that both are sorted at once
    ballot.sort()
    at = ballot & ((1 << bits) - 1)
    ballot >>= bits
    begin = np.flatnonzero(np.diff(ballot, prepend=-1))
    ballots, votes = ballot[begin], np.diff(begin, append=len(ballot))
    near = votes.copy()  # votes within two letters belong together: misread letters shift what follows
    close = []
    for ahead in (1, 2):  # ballots are sorted and distinct
        ok = np.flatnonzero(ballots[ahead:] - ballots[:-ahead] <= 2)
        near[ok] += votes[ok + ahead]
        near[ok + ahead] += votes[ok]
        close.append((ok, ok + ahead))
    whose = ballots // width
    offset = ballots - whose * width - longest
    part = passage.part[at[begin]]
    lo = np.maximum(passage.starts[part], offset)
    hi = np.minimum(passage.stops[part], offset + sizes[whose])
    enough = near >= np.clip(0.15 * (hi - lo), 1, 3)
    enough &= hi > lo
    # of ballots within two letters that with the most votes speaks for all
    rank = near * (int(votes.max()) + 1) + votes
    keep = enough.copy()
    for left, right in close:
        better = rank[left] >= rank[right]
        keep[np.where(better, right, left)] = False
    k = np.flatnonzero(keep)
    placed = np.stack([lines.numbers[whose[k]], lo[k], hi[k], np.maximum(0, lo[k] - offset[k])])
    return placed, at[np.repeat(enough, votes)]


def _within(passage: Passage | Joined, spans: np.ndarray, marked: np.ndarray, share: float, wanted: int) -> np.ndarray:
    """Which spans meet ``wanted`` words in a row that have that share of marked letters; short words need none."""
    total = np.concatenate(([0], np.cumsum(marked)))
    sizes = np.diff(passage.ends)
    unread = (sizes >= WORD) & (np.diff(total[passage.ends]) < share * sizes) | passage.apart
    stops = np.concatenate(([-1], np.flatnonzero(unread), [len(sizes)]))
    runs = np.flatnonzero(np.diff(stops) - 1 >= wanted)
    first, last = passage.ends[stops[runs] + 1], passage.ends[stops[runs + 1]]
    return np.searchsorted(first, spans[1]) > np.searchsorted(last, spans[0], side="right")


def _cut(letters: np.ndarray, width: int) -> np.ndarray:
    """The letters from two before each place on, in rows; what lies before or after all letters is anything."""
    padded = np.concatenate((np.zeros(2, np.uint8), letters, np.zeros(width, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, width)


@dataclass
class _Read:
    """Placements in any order of the lines, the words that can't be read, each with its placement's row, and bridges."""

    placed: np.ndarray
    broken: np.ndarray
    cut: np.ndarray
    bridges: dict[int, np.ndarray] | None = None  # where short lines may stand, once that is asked for
    may: np.ndarray | None = None  # the placements that may lie on a sequence in some order, once that is asked for

    def only(self, some: np.ndarray) -> _Read:
        kept = some[self.broken]
        row = np.cumsum(some) - 1
        may = None if self.may is None else self.may[some]
        return _Read(self.placed[:, some], row[self.broken[kept]], self.cut[kept], self.bridges, may)


_PARTNERS: dict[str, set[str]] = {}
for _one, _other in EXPLAINED:
    _PARTNERS.setdefault(_one, set()).add(_other)
    _PARTNERS.setdefault(_other, set()).add(_one)


def _bridges(passage: Passage | Joined, texts: set[str]) -> dict[int, np.ndarray]:
    """For each gap beyond SLACK between rough placements, after which letters a short line may fill it.

    As ``_accounted`` has it, a short line reads a part of the passage by chains
    of known misreadings; all places of the passage are tried at once, one bit each.
    """
    n = len(passage.letters)
    points = np.frombuffer(passage.letters.encode("utf-32-le", "replace"), dtype=np.uint32)
    stands: dict[str, int] = {}
    masks: dict[tuple[str, int], int] = {}

    def at(part: str) -> int:
        if part not in stands:
            if len(part) == 1:
                same = np.packbits(points == ord(part), bitorder="little")
                stands[part] = int.from_bytes(same.tobytes(), "little")
            else:
                stands[part] = at(part[0]) & (at(part[1:]) >> 1)
        return stands[part]

    def explained(part: str, size: int) -> int:
        if (part, size) not in masks:
            mask = at(part) if len(part) == size == 1 else 0
            for x in _PARTNERS.get(part, ()):
                if len(x) == size:
                    mask |= at(x)
            masks[part, size] = mask
        return masks[part, size]

    begin = [0] * (SHORT + 1)  # where what a line of so many letters reads may begin
    for text in texts:
        size = len(text)
        states: list[dict[int, int]] = [{} for _ in range(size + 3)]  # by letters of the line, those of the passage: places
        states[0][0] = (1 << n) - 1
        for j in range(size):
            for q in (1, 2, 3) if states[j] else ():
                for p in (1, 2):
                    mask = explained(text[j : j + q], p) if j + q <= size else 0
                    for i, places in states[j].items() if mask else ():
                        if read := places & (mask >> i):
                            states[j + q][i + p] = states[j + q].get(i + p, 0) | read
        for i, places in states[size].items():
            if abs(i - size) <= 2:
                begin[size] |= places
    allowed = {}
    for gap in range(SLACK + 1, SHORT + SLACK + 1):
        places = 0
        for size in range(max(1, gap - SLACK), min(SHORT, gap + SLACK) + 1):
            places |= begin[size]
        for k in (1, 1, 2):  # what begins SLACK before or after is near enough
            places |= places << k | places >> k
        places &= (1 << (n + 1)) - 1
        raw = np.frombuffer(places.to_bytes(n // 8 + 1, "little"), dtype=np.uint8)
        allowed[gap] = np.unpackbits(raw, bitorder="little")[: n + 1].astype(bool)
    return allowed


def _rough_runs(
    passage: Passage, lines: Lines, placed: np.ndarray, agreeing: np.ndarray, wanted: int
) -> list[tuple[int, int, int, int]]:
    """The placements that lie on some sequence of lines in which ``wanted`` words in a row seem readable."""
    chosen = _chains(passage, lines, _readable(passage, lines, _agreed(passage, placed, agreeing, wanted)), wanted)
    return [tuple(p) for p in chosen[:4].T.tolist()]


def _agreed(passage: Passage | Joined, placed: np.ndarray, agreeing: np.ndarray, wanted: int) -> np.ndarray:
    """The placements by which enough words, less two, have that share of their letters in shingles that agree."""
    marked = np.zeros(len(passage.codes) + GRAM, dtype=bool)
    for k in range(GRAM):
        marked[agreeing + k] = True
    return placed[:, _within(passage, placed[1:3], marked, AGREED, wanted - 2)] if placed.size else placed


def _readable(passage: Passage | Joined, lines: Lines, placed: np.ndarray) -> _Read:
    """The placements, with the words that can't be read.

    A word seems readable in a line if READ of its letters agree. Two words less
    are enough, so that rough placements lose none.
    """
    none = np.empty(0, dtype=np.int64)
    if not placed.size:
        return _Read(placed, none, none)
    number, lo, hi, _ = placed
    first, last = passage.word[lo], passage.word[hi - 1]
    width = int((hi - lo).max()) + 4
    step = max(1, _CELLS // width)
    # rows of letters that hold 4 more than are compared, so that all rows can be compared as one
    mine = _cut(passage.codes, width)
    theirs = _cut(lines.letters, width)
    begin = lines.starts[np.searchsorted(lines.numbers, number)]
    broken, cut = [], []
    for i in range(0, len(lo), step):
        s = slice(i, i + step)
        marks = _marks(mine[lo[s] + 2], theirs[begin[s] + placed[3, s]], hi[s] - lo[s], placed[3, s], lines.lengths[number[s]])
        total = np.concatenate((np.zeros(1, np.int32), np.cumsum(marks, dtype=np.int32)))
        count = last[s] - first[s] + 1
        row = np.repeat(np.arange(len(count)), count)
        word = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - first[s], count)
        a = np.maximum(passage.ends[word], lo[s][row])
        b = np.minimum(passage.ends[word + 1], hi[s][row])
        shift = row * width - lo[s][row]
        bad = np.flatnonzero((b - a >= WORD) & (total[b + shift] - total[a + shift] < READ * (b - a)))
        broken.append(row[bad] + i)
        cut.append(word[bad])
    return _Read(placed, np.concatenate(broken), np.concatenate(cut))


def _marks(mine: np.ndarray, theirs: np.ndarray, sizes, at, lengths) -> np.ndarray:
    """Letters that agree in place, or two in a row up to two letters off; all rows after each other."""
    column = np.arange(mine.shape[1], dtype=np.int16)
    np.copyto(mine, np.uint8(NO_LETTER - 1), where=column >= sizes.astype(np.int16)[:, None])
    column -= 2
    left, right = -at.astype(np.int16), (lengths - at).astype(np.int16)
    np.copyto(theirs, np.uint8(NO_LETTER - 2), where=(column < left[:, None]) | (column >= right[:, None]))
    mine, theirs = mine.ravel(), theirs.ravel()
    marks = np.zeros(len(mine), dtype=bool)
    for d in range(5):
        same = mine[: len(mine) - d] == theirs[d:]
        both = same[1:] & same[:-1]
        marks[: len(both)] |= both
        marks[1 : len(same)] |= both
        if d == 2:
            marks[: len(same)] |= same
    return marks


def _chains(
    passage: Passage | Joined, lines: Lines, read: _Read, wanted: int
) -> np.ndarray:
    """The placements that lie on some sequence of lines in which enough words in a row seem readable.

    With each stands how far what leads to it goes on, where the words after its last break begin, and how far those go on.
    """
    placed, broken, cut = read.placed, read.broken, read.cut
    if not placed.size:
        return np.empty((7, 0), dtype=np.int64)
    _, lo, hi, _ = placed
    n = len(lo)
    first, last = passage.word[lo], passage.word[hi - 1]
    # each placement's first and last break, and whether enough words stand between two of them
    words = len(passage.ends) - 1
    first_cut, last_cut, inner = np.full(n, words), np.full(n, -1), np.zeros(n, dtype=bool)
    last_cut[broken] = cut
    first_cut[broken[::-1]] = cut[::-1]
    least = wanted - 3  # the words that are enough, less one
    inner[broken[1:][(broken[1:] == broken[:-1]) & (np.diff(cut) - 2 >= least)]] = True
    whole = last_cut < 0

    # how far back the words before each placement's first break reach, and how far on those after its last
    starts, ons = np.where(whole, first, last_cut + 1), np.where(whole, last, first_cut - 1)
    # a placement that breaks at both its ends goes on with none, and most can't lie on a sequence in any order of the lines
    rough = lo, hi, first, last, starts, ons, whole, inner, least
    if read.may is None and n > FEW:
        texts = {lines.text[i] for which in lines.by_size.values() for i in which}
        read.bridges = _bridges(passage, texts) if 0 < len(texts) <= n else None  # of more it costs more than it saves
        read.may = _in_any_order(passage, lines, *rough, read.bridges)
    may = np.ones(n, dtype=bool) if read.may is None else read.may
    bridges = {gap: x.tobytes() for gap, x in (read.bridges or {}).items()}
    before = {gap: lines.short_before(gap) for gap in range(SLACK + 1, SHORT + SLACK + 1)}
    some = np.flatnonzero(((first_cut > first) | (last_cut < last)) & may)
    some = some[np.argsort(lines.rank[placed[0, some]], kind="stable")]
    number = lines.rank[placed[0]]
    bounds = np.flatnonzero(np.diff(number[some], prepend=-1, append=-1)).tolist()
    together = [range(i, j) for i, j in zip(bounds, bounds[1:])]  # those of one line
    opens, entire = (first_cut > first)[some].tolist(), whole[some].tolist()
    backs, aheads = first.copy(), last.copy()
    line_of, begin, end, head, tail, start, on = (x[some].tolist() for x in (number, lo, hi, first, last, starts, ons))
    back, ahead = list(head), list(tail)
    # by where earlier lines end (SHORT + SLACK before it stand for places before the passage), the first word of what
    # leads there; a line goes on with what ends by it, and beyond SLACK only where a short line may stand between.
    # near and far: the least of what is reached by a place, and of what is reached further before it
    none, base = words + 1, SHORT + SLACK
    room = len(passage.codes) + 4 * base
    reached, near, far = [none] * room, [none] * room, [none] * room
    for line in together:
        for i in line:
            if opens[i]:
                at = begin[i] + base
                most = near[at] if near[at] < back[i] else back[i]
                if far[at] < most:
                    for gap in range(base, SLACK, -1):
                        if reached[at - gap] < most and _bridged(bridges, gap, begin[i] - gap) and before[gap][line_of[i]]:
                            most = reached[at - gap]
                back[i] = most
            if entire[i]:
                start[i] = back[i]
        for i in line:
            x, at = start[i], end[i] + base
            if x <= tail[i] and x < reached[at]:
                reached[at] = x
                for k in range(at - SLACK, at + SLACK + 1):
                    if x < near[k]:
                        near[k] = x
                for k in range(at + SLACK + 1, at + base + 1):
                    if x < far[k]:
                        far[k] = x
    # by where later lines begin, the last word of what follows
    reached, near, far = [-1] * room, [-1] * room, [-1] * room
    for line in reversed(together):
        for i in line:
            if start[i] <= tail[i]:
                at = end[i] + base
                most = near[at] if near[at] > ahead[i] else ahead[i]
                if far[at] > most:
                    for gap in range(SLACK + 1, base + 1):
                        if reached[at + gap] > most and _bridged(bridges, gap, end[i]) and before[gap][-1]:
                            most = reached[at + gap]
                ahead[i] = most
            if entire[i]:
                on[i] = ahead[i]
        for i in line:
            x, at = on[i], begin[i] + base
            if x >= head[i] and x > reached[at]:
                reached[at] = x
                for k in range(at - SLACK, at + SLACK + 1):
                    if x > near[k]:
                        near[k] = x
                for k in range(at - base, at - SLACK):
                    if x > far[k]:
                        far[k] = x
    backs[some], aheads[some], ons[some] = back, ahead, on
    after = np.where(whole, backs, last_cut + 1)
    chosen = np.flatnonzero(inner | may & ((ons - backs >= least) | (aheads - after >= least)))
    chosen = chosen[np.argsort(number[chosen], kind="stable")]
    after = np.where(whole, first, last_cut + 1)
    after[inner] = -least - words  # is always compared
    return np.stack([number, lo, hi, placed[3], ons, after, aheads])[:, chosen]


def _bridged(bridges: dict[int, bytes], gap: int, place: int) -> bool:
    return not bridges or place >= 0 and bridges[gap][place] > 0


def _in_any_order(
    passage, lines: Lines, lo, hi, first, last, starts, ons, whole, inner, least: int, bridges=None
) -> np.ndarray:
    """Which placements would lie on a sequence of enough words if any line might follow any other."""
    base, none = SHORT + SLACK, len(passage.ends)
    room = len(passage.codes) + 2 * base + 1
    entire = np.flatnonzero(whole)
    # where a gap can't be, it leads to the word that is worst
    gaps = [g for g in range(SLACK + 1, base + 1) if lines.short_before(g)[-1]]
    closed = {}
    for g in gaps if bridges else ():
        closed[g] = np.ones(room - g, dtype=bool)
        closed[g][base : base + len(bridges[g])] = ~bridges[g][: room - g - base]

    def spread(reached: np.ndarray, better, worst: int) -> np.ndarray:
        """The best that is reached within SLACK, and by the gaps: before each place, if the least is best, else after it."""
        out = reached.copy()
        for k in (1, 1, 2):  # together SLACK
            wide = out.copy()
            better(wide[k:], out[:-k], out=wide[k:])
            better(wide[:-k], out[k:], out=wide[:-k])
            out = wide
        for g in gaps:
            a, b = (reached[:-g], out[g:]) if worst else (reached[g:], out[:-g])
            if g in shut:
                a = (np.minimum if not worst else np.maximum)(a, shut[g])
            better(b, a, out=b)
        return out

    # how far back and on each place reaches
    from_, to = lo + base, hi + base
    ok = np.flatnonzero(starts <= last)
    start = starts
    shut = {g: np.where(x, none, 0).astype(np.int32) for g, x in closed.items()}
    reached = np.full(room, none, dtype=np.int32)
    start, first, last = start.astype(np.int32), first.astype(np.int32), last.astype(np.int32)
    np.minimum.at(reached, to[ok], start[ok])
    while True:
        leads = spread(reached, np.minimum, none)
        now = np.minimum(first[entire], leads[from_[entire]])
        better = now < start[entire]
        if not better.any():
            break
        start[entire] = now
        np.minimum.at(reached, to[entire[better]], now[better])
    opens = ons >= first
    back = np.where(opens, np.minimum(first, leads[from_]), first)
    on = ons.copy()
    ok = np.flatnonzero(ons >= first)
    shut = {g: np.where(x, -1, none).astype(np.int32) for g, x in closed.items()}
    reached = np.full(room, -1, dtype=np.int32)
    on = on.astype(np.int32)
    np.maximum.at(reached, from_[ok], on[ok])
    while True:
        follows = spread(reached, np.maximum, 0)
        now = np.maximum(last[entire], follows[to[entire]])
        better = now > on[entire]
        if not better.any():
            break
        on[entire] = now
        np.maximum.at(reached, from_[entire[better]], now[better])
    ahead = np.where(starts <= last, np.maximum(last, follows[to]), last)
    return inner | (on - back >= least) | (ahead - start >= least)
