"""Held-out passages that stand, whole or in part, in pages of a corpus.

Windows of the pages and of the passages get weighted SimHash fingerprints; a
multi-index over blocks of the passages' fingerprints finds every pair within
its Hamming radius, exact weighted-shingle similarity verifies the pairs, and
for the pages that remain the longest run of consecutive words is measured.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import fingerprints as fp
from strandloom.llm.letters import GRAM, NO_LETTER, SIZE, folded, grams, plain, stream, trigrams
from strandloom.llm.runs import Passage, longest_runs
from strandloom.workspace import keep, ship_package

#: Words in a row that make a leak, and the least weighted similarity of a page's window to a passage's.
MIN_WORDS, MIN_SIMILARITY = 20, 0.5
#: Letters in a window; how far beyond its windows a stretch is drawn out; and the share of the letters of the
#: passage's shortest run of MIN_WORDS words that stretches must cover, within as many letters of the passage.
LETTERS, REACH, MIN_COVERED = fp.WINDOW + 2, 64, 0.5
#: Before lines are compared, PRESENT of the letters of each word of a run must stand on the page within GRAM letters in a
#: row; words of fewer than SURE letters are taken to stand there.
PRESENT, SURE = 0.5, 6
#: The narrowest column, and how far apart the left edges of a column's lines may lie (in the boxes' pixels).
NARROWEST, JITTER = 150, 25
#: Passages indexed (and sent to the executors) at a time, and their letters (a longer passage is indexed alone);
#: more passages take further passes over the corpus.
PASSAGES_AT_ONCE, LETTERS_AT_ONCE = 4_000, 4_000_000
#: Characters of pages, shingles, and pairs of windows, that a worker handles at a time.
_CHUNK, _SEGMENT, _PAIRS = 500_000, 1 << 17, 4_000


def column_order(left: np.ndarray) -> np.ndarray | None:
    """The order of a page's lines column by column; None if they stand so already, or in one column.

    Columns begin where many lines do: left edges that lie close together are
    one edge, and edges with a twentieth of the lines, NARROWEST apart, are columns.
    """
    if len(left) < 3 or not (np.diff(left) < -NARROWEST).any():
        return None
    edges = np.sort(left)
    first = np.flatnonzero(np.diff(edges, prepend=edges[0] - 2 * JITTER) > JITTER)
    lines = np.diff(np.append(first, len(edges)))
    begins: list[int] = []
    for edge, n in zip(edges[first].tolist(), lines.tolist()):
        if n >= max(3, len(left) / 20) and (not begins or edge - begins[-1] >= NARROWEST):
            begins.append(edge)
    if len(begins) < 2:
        return None
    column = np.searchsorted(np.array(begins) - JITTER, left, side="right")
    return None if (np.diff(column) >= 0).all() else np.argsort(column, kind="stable")


def reading_orders(text: str, left) -> list[list[str]]:
    """A page's lines as they come, and column by column where that differs."""
    lines = text.split("\n")
    if left is None or len(left) != len(lines):
        return [lines]
    order = column_order(np.asarray(left, dtype=np.int64))
    return [lines] if order is None else [lines, [lines[i] for i in order]]


def _chunks(pages: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Letters, page number and stream number of streams of bounded size together."""
    part: list[str] = []
    rows: list[int] = []
    size = 0
    for i, streams in enumerate(pages):
        part += streams
        rows += [i] * len(streams)
        size += sum(map(len, streams))
        if size > _CHUNK:
            letters, owner = stream(part)
            yield letters, np.array(rows, dtype=np.int32)[owner], owner
            part, rows, size = [], [], 0
    if part:
        letters, owner = stream(part)
        yield letters, np.array(rows, dtype=np.int32)[owner], owner


def shingle_counts(documents: DataFrame, text: str) -> np.ndarray:
    """How often each letter trigram occurs in all texts; there are SIZE ** 3 of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for letters, _, owner in _chunks([[t] for t in b["text"]]):
                inside = owner[2:] == owner[:-2]
                total += np.bincount(trigrams(letters)[inside], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"shingle": seen, "n": total[seen]})

    parts = documents.select(F.col(text).alias("text")).mapInPandas(count, "shingle bigint, n bigint")
    counts = np.zeros(SIZE**3, dtype=np.int64)
    for r in parts.groupBy("shingle").agg(F.sum("n").alias("n")).collect():
        counts[r["shingle"]] = r["n"]
    return counts


class PassageIndex:
    """The passages' windows in a multi-index, and the search for pages that hold enough of a passage."""

    def __init__(self, texts: list[str], weight: np.ndarray, min_words: int):
        self.weight, self.lanes, self.min_words = weight, fp.lanes(weight), min_words
        self.passages = [Passage(t, min_words) for t in texts]
        letters = [p.codes for p in self.passages]
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in letters]))).astype(np.int64)
        self.letters = np.concatenate([*letters, np.empty(0, np.uint8)])
        self.owner = np.repeat(np.arange(len(letters)), np.diff(self.starts))
        self.shingles = trigrams(self.letters)
        self.least = np.array([p.least or 0 for p in self.passages], dtype=np.int64)
        prints, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, p in enumerate(self.passages):
            for o in range(fp.STEP if p.least else 0):  # items too short for a run aren't searched for
                found = fp.window_prints(trigrams(p.codes)[o:], self.lanes, weight)
                prints.append(found)
                at.append(self.starts[k] + o + np.arange(len(found)) * fp.STEP)
        self.at = np.concatenate(at)
        none = np.full(GRAM, SIZE**GRAM)  # stands on no page
        self.grams = [np.concatenate((p.shingles, none)) for p in self.passages]
        self.present = np.zeros(SIZE**GRAM + 1, dtype=bool)
        self.index = fp.MultiIndex(np.concatenate(prints))

    def find(self, pages: list[list[str]]) -> np.ndarray:
        """(page, passage) pairs; a page is given as its letters in one or more orders."""
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for letters, page, owner in _chunks(pages):
            first, theirs = self._windows(trigrams(letters), owner)
            pairs.append(self._covered(letters, page, owner, *_stretches(first, theirs, owner, self.owner)))
        return np.unique(np.concatenate(pairs), axis=0)

    def promising(self, orders: list[str], passages: list[int]) -> list[int]:
        """The passages of which enough words in a row have shingles of GRAM letters anywhere on the page."""
        codes = [grams(letters[letters != NO_LETTER]) for letters in map(folded, orders)]
        for x in codes:
            self.present[x] = True
        bounds = np.cumsum([0, *(len(self.grams[k]) for k in passages)])
        hit = self.present[np.concatenate([self.grams[k] for k in passages])]
        for x in codes:
            self.present[x] = False
        read = np.zeros(len(hit), dtype=bool)
        for d in range(GRAM):  # a shingle's letters; each passage ends with GRAM that belong to none
            read[d:] |= hit[: len(hit) - d]
        total = np.concatenate(([0], np.cumsum(read)))
        ends = np.concatenate([self.passages[k].ends + b for k, b in zip(passages, bounds)])
        sizes = np.diff(ends)
        unread = (sizes >= SURE) & (total[ends[1:]] - total[ends[:-1]] < PRESENT * sizes)
        # between two passages stands what counts as a word that can't be read
        whose = np.cumsum([0, *(len(self.passages[k].ends) for k in passages)])
        unread[whose[1:-1] - 1] = True
        stops = np.concatenate(([-1], np.flatnonzero(unread), [len(sizes)]))
        found = stops[:-1][np.diff(stops) - 1 >= self.min_words] + 1
        return sorted({passages[i] for i in np.searchsorted(whose, found, side="right") - 1})

    def searches(self, orders: list[list[str]], left, near: list[tuple[int, list[int]]]) -> Iterator[tuple]:
        """What ``longest_runs`` takes, for the pages and passages that are near."""
        for row, some in near:
            lines = plain(orders[row][0]).split("\n")
            turned = column_order(np.asarray(left.iloc[row], dtype=np.int64)) if len(orders[row]) > 1 else None
            yield lines, turned, [self.passages[k] for k in some]

    def _windows(self, own: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of a page's and a passage's windows that are close by fingerprint and similar by exact comparison."""
        firsts, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        windows = np.lib.stride_tricks.sliding_window_view
        known = windows(self.shingles, fp.WINDOW) if len(self.at) else self.shingles
        for at in range(0, len(own), _SEGMENT):
            seg = own[at : at + _SEGMENT + fp.WINDOW - fp.STEP]
            mine, theirs = self.index.near(fp.window_prints(seg, self.lanes, self.weight))
            first, other = at + mine * fp.STEP, self.at[theirs]
            inside = owner[first] == owner[first + LETTERS - 1]
            first, other = first[inside], other[inside]
            for i in range(0, len(first), _PAIRS):
                f, t = first[i : i + _PAIRS], other[i : i + _PAIRS]
                a, b = windows(own, fp.WINDOW)[f], known[t]
                alike = (a == b).all(axis=1)  # most are, and equal windows need no comparison of sets
                rest = np.flatnonzero(~alike)
                alike[rest] = fp.weighted_overlap(a[rest], b[rest], self.weight) >= MIN_SIMILARITY
                firsts.append(f[alike])
                others.append(t[alike])
        return np.concatenate(firsts), np.concatenate(others)

    def _covered(self, letters, page, owner, first, last, theirs) -> np.ndarray:
        """The pairs of which the stretches, as far as they can be drawn out, cover enough letters of a shortest run."""
        if not len(first):
            return np.empty((0, 2), dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner))))
        mine, passage = owner[first], self.owner[theirs]
        stop = theirs + last - first
        lo, hi = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        margin = np.zeros(2 * REACH, np.uint8)
        a, b = np.concatenate((margin, letters, margin)), np.concatenate((margin, self.letters, margin))
        for i in range(0, len(first), _PAIRS):
            s = slice(i, i + _PAIRS)
            rooms = np.minimum(bounds[mine[s] + 1] - last[s], self.starts[passage[s] + 1] - stop[s])
            hi[s] = stop[s] + _drawn_out(a, b, last[s], stop[s], rooms, 1)
            rooms = np.minimum(first[s] - bounds[mine[s]], theirs[s] - self.starts[passage[s]])
            lo[s] = theirs[s] - _drawn_out(a, b, first[s] - 1, theirs[s] - 1, rooms, -1)
        of = page[first].astype(np.int64) * len(self.passages) + passage
        pair, which = np.unique(of, return_inverse=True)
        wanted = MIN_COVERED * self.least
        may = np.bincount(which, hi - lo) >= wanted[pair % len(self.passages)]  # even if no stretches overlapped
        some = may[which]
        pair, which = pair[may], (np.cumsum(may) - 1)[which[some]]
        lo, hi, passage = lo[some], hi[some], passage[some]
        if not len(pair):
            return np.empty((0, 2), dtype=np.int64)
        whose = pair % len(self.passages)
        # each pair's passage stands in a row of its own; there the stretches are joined to spans that don't touch
        size = self.starts[whose + 1] - self.starts[whose]
        shift = (np.cumsum(size + 1) - size - 1 - self.starts[whose])[which]
        lo, hi = lo + shift, hi + shift
        order = np.argsort(lo)
        lo, hi, which = lo[order], np.maximum.accumulate(hi[order]), which[order]
        begin = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
        lo, hi, which = lo[begin], hi[np.append(begin[1:], len(hi)) - 1], which[begin]
        # letters covered most by a shortest run are covered by one that begins where a span does
        before = np.cumsum(hi - lo) - (hi - lo)
        stop = lo + self.least[whose[which]]
        last = np.searchsorted(lo, stop) - 1
        last = np.minimum(last, np.searchsorted(which, which, side="right") - 1)
        covered = before[last] - before + np.minimum(hi[last], stop) - lo[last]
        most = np.maximum.reduceat(covered, np.flatnonzero(np.diff(which, prepend=-1)))
        enough = pair[most >= wanted[whose]]
        return np.stack([enough // len(self.passages), enough % len(self.passages)], axis=1)


def _stretches(first, theirs, owner, whose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow each other at the same distance joined: first and last letter of the page, first of the passage."""
    order = np.lexsort((first, first - theirs))
    first, theirs = first[order], theirs[order]
    if not len(first):
        return first, first, theirs
    before = slice(None, -1)
    new = (first - theirs)[1:] != (first - theirs)[before]
    new |= np.diff(first) > LETTERS
    new |= (owner[first[1:]] != owner[first[before]]) | (whose[theirs[1:]] != whose[theirs[before]])
    begin = np.concatenate(([0], np.flatnonzero(new) + 1))
    end = np.append(begin[1:], len(first)) - 1
    return first[begin], first[end] + LETTERS, theirs[begin]


def _drawn_out(a: np.ndarray, b: np.ndarray, at, other, room, step: int) -> np.ndarray:
    """How far two texts agree beyond a place, a letter counting 1 and a difference -2, at most REACH letters.

    Around the texts there are 2 * REACH letters more.
    """
    far = np.zeros(len(at), dtype=np.int64)
    rest, best, so_far, begin = np.arange(len(at)), np.zeros(len(at), np.int16), np.zeros(len(at), np.int16), 0
    # most texts differ soon: what can't reach its best place any more isn't compared further
    for end in (REACH // 4, REACH // 2, REACH):
        k = np.arange(begin, end)
        x = _ahead(a, at[rest] + step * begin, end - begin, step)
        y = _ahead(b, other[rest] + step * begin, end - begin, step)
        score = np.where(x == y, np.int8(1), np.int8(-2))
        np.copyto(score, np.int8(-REACH), where=k >= room[rest][:, None])
        total = np.cumsum(score, axis=1, dtype=np.int16) + so_far[:, None]
        place = total.argmax(axis=1)
        most = total[np.arange(len(rest)), place]
        better = most > best
        far[rest[better]] = begin + place[better] + 1
        best = np.maximum(best, most)
        on = total[:, -1] + (REACH - end) > best
        rest, best, so_far, begin = rest[on], best[on], total[on, -1], end
    return far


def _ahead(letters: np.ndarray, at: np.ndarray, width: int, step: int) -> np.ndarray:
    """The letters from each place on, forwards or backwards, in rows."""
    rows = np.lib.stride_tricks.sliding_window_view(letters, width)
    return rows[at + 2 * REACH] if step > 0 else rows[at + 2 * REACH - width + 1][:, ::-1]


_indexes: dict[str, PassageIndex] = {}


def _index(name: str, texts: list[str], weight: np.ndarray, min_words: int) -> PassageIndex:
    """The block's index, built once in each worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = PassageIndex(texts, weight, min_words)
    return _indexes[name]


def _measured(pages: DataFrame, texts: list[str], weight: np.ndarray, min_words: int) -> DataFrame:
    """id, passage, words: the pages that hold runs of at least ``min_words`` words, with the longest."""
    sent = pages.sparkSession.sparkContext.broadcast((texts, weight))
    name = uuid.uuid4().hex

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(name, *sent.value, min_words)
        for b in batches:
            orders = [["\n".join(x) for x in reading_orders(*x)] for x in zip(b["text"], b["left"])]
            rows, numbers, words = [], [], []
            pairs = index.find(orders)
            first = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)).tolist()
            near = []
            for i, j in zip(first, [*first[1:], len(pairs)]):
                row = int(pairs[i, 0])
                near += [(row, k) for k in [index.promising(orders[row], pairs[i:j, 1].tolist())] if k]
            for (row, some), best in zip(near, longest_runs(index.searches(orders, b["left"], near), min_words)):
                for k, n in zip(some, best):
                    if n >= min_words:
                        rows.append(row)
                        numbers.append(k)
                        words.append(n)
            if rows:
                yield pd.DataFrame({"id": b["id"].iloc[rows].reset_index(drop=True), "passage": numbers, "words": words})

    shape = T.StructType([pages.schema["id"], T.StructField("passage", T.LongType()), T.StructField("words", T.LongType())])
    return pages.mapInPandas(search, shape)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    key: str,
    text: str,
    boxes: str | None = None,
    item_key: str,
    item_text: str,
    min_words: int = MIN_WORDS,
    at_once: int = PASSAGES_AT_ONCE,
) -> DataFrame:
    """key, item_key, words: pages that hold at least ``min_words`` consecutive words of an item, and how many.

    Letter case, punctuation, spacing and known misreadings of letters don't
    interrupt a run, nor do whole foreign lines; other words do. ``boxes`` names
    an array of structs with x0, one for each line of the text: where
    lines of several columns alternate, they are also read column by column;
    arrays of another length than the text has lines are ignored. All items with the same passage are reported. Null and empty
    texts hold nothing, and items of fewer than ``min_words`` words are never
    found. Rows that repeat a key are one page each and reported once; rows
    with a null key are searched, too. Empty tables give an empty result. Words
    are what blanks separate, letters those of any alphabet. ``words`` is the
    longest run in any of the page's reading orders.
    """
    ship_package(documents.sparkSession)
    none = F.lit(None).cast("array<int>")
    left = F.col(f"{boxes}.x0") if boxes else none
    pages = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), left.alias("left"))
    pages = pages.where("text is not null and text <> ''")
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:  # a few files of much work each
        pages = pages.repartition(4 * cores)
    tests = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("passage")).where("passage is not null")
    tests = keep(tests.distinct(), "tests")

    weight = fp.weights(shingle_counts(pages, "text"))
    found: DataFrame | None = None
    distinct = tests.select("passage").distinct().orderBy("passage")
    last = None
    while True:
        rest = distinct if last is None else distinct.where(F.col("passage") > F.lit(last))
        sizes = [r["n"] for r in rest.select(F.length("passage").alias("n"), "passage").limit(at_once).select("n").collect()]
        n_fit = max(1, int(np.searchsorted(np.cumsum(sizes), LETTERS_AT_ONCE, side="right"))) if sizes else 0
        block = [r["passage"] for r in rest.limit(n_fit).collect()]
        if not block and found is not None:
            break
        measured = keep(_measured(pages, block, weight, min_words), "runs")
        numbers = measured.sparkSession.createDataFrame(list(enumerate(block)), "passage bigint, text string")
        named = measured.join(numbers, "passage").join(tests.withColumnRenamed("passage", "text"), "text")
        part = named.select(F.col("id").alias(key), F.col("item").alias(item_key), "words")
        found = part if found is None else found.unionByName(part)
        if n_fit == len(sizes) < at_once:
            break
        last = block[-1]
    return found.groupBy(key, item_key).agg(F.max("words").alias("words"))
