"""Template residue, filler and error-page text in pages, by character n-gram likelihood ratios.

A character model of each kind of residue is fitted on labelled examples, the
model of natural prose on all pages in two passes: first from how many contexts
an n-gram stands in, so that frequent residue doesn't pass for prose, then from
how often it stands outside the windows that the first model flags. Windows whose summed log likelihood ratio
is high localise the residue; pages are excluded by the letters they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.leakage import reading_orders
from strandloom.llm.residue_examples import CONTRAST, FIELDS, KINDS, examples
from strandloom.workspace import ship_package

#: Characters with a class of their own besides a-z, digits and the blank; the rest is one class.
MARKS = "{}[]<>%_$#=/:"
CLASSES = 26 + 2 + len(MARKS) + 1
DIGIT, BLANK, OTHER = 26, 27, CLASSES - 1
GRAM = 4

#: Log ratios are clipped to LIMIT and kept as whole numbers of 1/SCALE; shares below FLOOR count as FLOOR.
LIMIT, SCALE, FLOOR = 5.0, 16, 5e-7
#: For each kind of residue its models, and for each model windows (characters) and the least mean log ratio of
#: their n-grams. ``marks`` is the template model without the n-grams that hold none of FIELD_MARKS.
MODELS = {"template": ("template", "marks"), "filler": ("filler",), "notice": ("notice",)}
WINDOWS = {"template": ((9, 3.8), (16, 2.0)), "marks": ((14, 1.3),), "filler": ((28, 1.45),), "notice": ((20, 3.4), (36, 1.75))}
FIELD_MARKS = "{}[]<>%_$#"
#: The characters that the windows of a kind must cover on a page.
COVERED = {"template": 9, "filler": 28, "notice": 20}
#: The weight of a contrast example in the model of natural prose, as a share of its counts.
CONTRAST_SHARE = 3e-2

_CHUNK = 1_000_000
#: Windows that a worker sorts at a time; windows that share a bucket, if more than BUCKETS aren't needed for that.
_SORTED, _IN_BUCKET, _BUCKETS = 4_000_000, 250_000, 4_096
_GAP = "\0"
_PAD = " " * 6  # around each text, so that windows wider than a short text still fit


def _character_classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i
    for c in "0123456789":
        table[ord(c)] = DIGIT
    for c in " \t\n\r\xa0":
        table[ord(c)] = BLANK
    for i, c in enumerate(MARKS):
        table[ord(c)] = 28 + i
    for base, letters in (("a", "àáâãäå"), ("c", "ç"), ("e", "èéêë"), ("i", "ìíîï"), ("n", "ñ"), ("o", "òóôõöø"),
                          ("s", "ß"), ("u", "ùúûü"), ("y", "ýÿ")):
        for c in letters:
            table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 and ord(c.upper()) < 256 else ord(c)] = ord(
                base
            ) - ord("a")
    return table


_CLASS = _character_classes()


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram at every character but the last three, and where it crosses a gap between texts."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
    c = _CLASS[raw].astype(np.int32)
    gap = raw == 0
    if len(c) < GRAM:
        return np.empty(0, np.int32), np.empty(0, bool)
    n = len(c) - GRAM + 1
    code, crosses = c[:n].copy(), gap[:n].copy()
    for k in range(1, GRAM):
        code *= CLASSES
        code += c[k : n + k]
        crosses |= gap[k : n + k]
    return code, crosses


def _chunks(texts: list[str]) -> Iterator[tuple[int, str]]:
    """The number of the first text and the texts of bounded size together, with a gap after each."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(f"{_PAD}{t}{_PAD}")
        size += len(t)
        if size > _CHUNK or i == len(texts) - 1:
            yield first, _GAP.join(part) + _GAP
            first, part, size = i + 1, [], 0


#: A window of an n-gram and its context has 3 * GRAM letters, a number just beyond 64 bits: windows whose first letter is
#: in the classes' upper half are kept apart, as if it were the one in the lower half.
_HALF = CLASSES // 2
_SIZE = np.uint64(CLASSES**GRAM)


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 3 * GRAM letters at every character as a number and half; none that cross a gap."""
    code, crosses = _grams(text)
    n = max(len(code) - 2 * GRAM, 0)
    inside = ~(crosses[:n] | crosses[GRAM : n + GRAM] | crosses[2 * GRAM : n + 2 * GRAM])
    first, middle, last = (code[k : n + k][inside] for k in (0, GRAM, 2 * GRAM))
    upper = first >= _HALF * CLASSES ** (GRAM - 1)
    number = np.where(upper, first - _HALF * CLASSES ** (GRAM - 1), first).astype(np.uint64)
    return (number * _SIZE + middle.astype(np.uint64)) * _SIZE + last.astype(np.uint64), upper


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=~numbers[:1]) != 0]


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences, all first bytes before all second ones, which a shuffle compresses well."""
    return np.ascontiguousarray(np.diff(numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    bytes_ = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T)
    return np.cumsum(bytes_.view(np.uint64).ravel(), dtype=np.uint64)


def context_counts(pages: DataFrame) -> np.ndarray:
    """In how many contexts each character n-gram occurs, to its left or its right, whichever are fewer.

    A repeated text gives its n-grams one context on one side at least, however
    often it stands. Contexts are two n-grams wide. All windows of an n-gram and
    its context are compared, exactly: those that begin alike meet in a bucket, where each counts once.
    """
    chars = pages.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, min(chars // _IN_BUCKET, _BUCKETS), chars // (40 * _IN_BUCKET))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        numbers, upper = (np.concatenate(x) for x in zip(*found))
        for half in (0, 1):
            own = _distinct(numbers[upper == half])
            bucket = (own // _SIZE) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            bucket = (bucket % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [_packed(own[i:j]) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(own)])]
            yield pd.DataFrame({"bucket": bucket[begin] * 2 + half, "windows": parts})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for b in batches:
            for _, text in _chunks(b["text"].tolist()):
                found.append(_windows(text))
                size += len(found[-1][0])
                if size >= _SORTED:
                    yield from pieces(found)
                    found, size = [], 0
        if size:
            yield from pieces(found)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CLASSES**GRAM), dtype=np.int64)

        def add(bucket: int, parts: list[bytes]) -> None:
            windows = _distinct(np.concatenate([_unpacked(x) for x in parts]))
            first = (windows // (_SIZE * _SIZE)).astype(np.int64) + bucket % 2 * _HALF * CLASSES ** (GRAM - 1)
            for side, gram in ((0, first), (1, (windows % _SIZE).astype(np.int64))):
                seen, n = np.unique(gram, return_counts=True)
                total[side, seen] += n

        now, parts = -1, []
        for b in batches:  # sorted by bucket
            for bucket, windows in zip(b["bucket"].tolist(), b["windows"]):
                if bucket != now and parts:
                    add(now, parts)
                    parts = []
                now = bucket
                parts.append(windows)
        if parts:
            add(now, parts)
        side, gram = np.nonzero(total)
        yield pd.DataFrame({"side": side, "gram": gram, "n": total[side, gram]})

    packed = pages.select("text").mapInPandas(gather, "bucket int, windows binary")
    met = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(count, "side int, gram int, n bigint")
    found = met.groupBy("side", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * CLASSES ** GRAM rows
    counts = np.zeros((2, CLASSES**GRAM), dtype=np.int64)
    counts[found["side"].to_numpy(dtype=np.int64), found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return counts.min(axis=0)


def gram_counts(pages: DataFrame, tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """How often each character n-gram occurs in all texts (column ``text``), outside the windows that ``tables`` flag."""
    size = CLASSES**GRAM
    sent = pages.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for _, text in _chunks(b["text"].tolist()):
                code, crosses = _grams(text)
                left_out = crosses.copy()
                for kind in KINDS if sent.value else ():
                    high = _flagged(sent.value, kind, code, crosses)
                    for k in range(GRAM):
                        left_out |= high[k : len(code) + k]
                total += np.bincount(code[~left_out], minlength=size)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    parts = pages.select("text").mapInPandas(count, "gram int, n bigint")
    found = parts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most CLASSES ** GRAM rows
    counts = np.zeros(size, dtype=np.int64)
    counts[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return counts


def _sample_counts(texts: list[str]) -> np.ndarray:
    code, crosses = _grams(_GAP.join(f" {t} " for t in texts) + _GAP)
    return np.bincount(code[~crosses], minlength=CLASSES**GRAM)


def fit(natural: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of residue the scaled log likelihood ratio of every n-gram against natural prose."""
    natural = natural / max(natural.sum(), 1)

    def prose(harmless: list[str], share: float) -> np.ndarray:
        contrast = _sample_counts(harmless)
        return natural * (1 - share) + contrast / contrast.sum() * share

    plain = prose(list(CONTRAST), CONTRAST_SHARE)
    # what names a template's fields is residue only between marks: by itself it is a word like any other
    named = prose([*CONTRAST, *(f"the {f} and {f}s" for f in FIELDS)], 1.5 * CONTRAST_SHARE)
    tables = {}
    for kind, texts in examples().items():
        counts = _sample_counts(texts)
        ratio = np.log((counts / counts.sum() + FLOOR) / ((named if kind == "template" else plain) + FLOOR))
        tables[kind] = np.round(np.clip(ratio, -LIMIT, LIMIT) * SCALE).astype(np.int8)
    marked = np.zeros(CLASSES, dtype=bool)
    marked[_CLASS[[ord(c) for c in FIELD_MARKS]]] = True
    code = np.arange(CLASSES**GRAM)
    holds = np.zeros(CLASSES**GRAM, dtype=bool)
    for _ in range(GRAM):
        holds |= marked[code % CLASSES]
        code //= CLASSES
    tables["marks"] = np.where(holds, tables["template"], 0).astype(np.int8)
    return tables


def _covered(ratios: np.ndarray, crosses: np.ndarray, windows) -> np.ndarray:
    """Which characters lie in windows with a high mean log ratio."""
    n = len(ratios) + GRAM - 1
    total = np.concatenate(([0], np.cumsum(ratios, dtype=np.int64)))
    gaps = np.concatenate(([0], np.cumsum(crosses, dtype=np.int32)))
    change = np.zeros(n + 1, dtype=np.int32)
    for width, least in windows:
        k = width - GRAM + 1
        if len(ratios) < k:
            continue
        high = (total[k:] - total[:-k] >= least * SCALE * k) & (gaps[k:] == gaps[:-k])
        at = np.flatnonzero(high)
        change[at] += 1
        change[at + width] -= 1
    return np.cumsum(change[:-1]) > 0


def _flagged(tables: dict[str, np.ndarray], kind: str, code: np.ndarray, crosses: np.ndarray) -> np.ndarray:
    """Which characters lie in windows of a kind."""
    return np.logical_or.reduce([_covered(tables[m][code], crosses, WINDOWS[m]) for m in MODELS[kind]])


def residue_spans(
    documents: DataFrame, *, key: str, text: str, boxes: str | None = None, tables: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """key, kind, n_covered, n_chars: the characters of each page that look like residue of a kind.

    A row for each page and kind whose windows cover at least COVERED
    characters. ``boxes`` names an array of structs with x0 for the lines
    of the text: lines of several columns that alternate are also read column by
    column, and the order with the larger coverage counts. Null and empty texts have no residue; rows that repeat a key are
    one page each; a null key is kept. An empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    none = F.lit(None).cast("array<int>")
    left = F.col(f"{boxes}.x0") if boxes else none
    pages = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), left.alias("left"))
    pages = pages.where("text is not null and text <> ''")
    if tables is None:
        tables = fit(gram_counts(pages, fit(context_counts(pages))))
    sent = pages.sparkSession.sparkContext.broadcast(tables)

    def localise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, owners = [], []
            for i, x in enumerate(zip(b["text"], b["left"])):
                for order in reading_orders(*x):
                    texts.append("\n".join(order).replace(_GAP, " "))
                    owners.append(i)
            most: dict[tuple[int, str], int] = {}
            for first, joined in _chunks(texts):
                code, crosses = _grams(joined)
                if not len(code):
                    continue
                ends = np.flatnonzero(np.frombuffer(joined.encode("latin-1", "replace"), dtype=np.uint8) == 0)
                starts = np.concatenate(([0], ends[:-1] + 1))
                for kind in KINDS:
                    sums = np.concatenate(([0], np.cumsum(_flagged(sent.value, kind, code, crosses))))
                    n = sums[ends] - sums[starts]
                    for i in np.flatnonzero(n >= COVERED[kind]).tolist():
                        at = (owners[first + i], kind)
                        most[at] = max(most.get(at, 0), int(n[i]))
            found = sorted(most)
            ids, kinds = [b["id"].iloc[i] for i, _ in found], [kind for _, kind in found]
            sizes = [len(b["text"].iloc[i]) for i, _ in found]
            covered = [min(most[at], size) for at, size in zip(found, sizes)]
            if ids:
                own = pd.Series(ids, dtype=b["id"].dtype)
                yield pd.DataFrame({"id": own, "kind": kinds, "n_covered": covered, "n_chars": sizes})

    fields = [("kind", T.StringType()), ("n_covered", T.LongType()), ("n_chars", T.LongType())]
    shape = T.StructType([pages.schema["id"], *[T.StructField(n, t) for n, t in fields]])
    return pages.mapInPandas(localise, shape).withColumnRenamed("id", key)
