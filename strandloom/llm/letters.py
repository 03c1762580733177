"""Scanned text as streams of letter classes, for matching that survives misread letters."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

#: Letters that scanners take for one another share a class. Accented letters join their base.
CLASSES = (
    "eco0éèêëçòóôöœ",
    "tiljf1!ìíîï",
    "aàáâäãå",
    "nuñùúûü",
    "rvyÿ",
    "s58ß",
    "hb6",
    "gq9",
    "d",
    "k",
    "m",
    "p",
    "w",
    "x",
    "z",
    "2",
    "3",
    "4",
    "7",
)
#: Readings of a letter (left) that differ in it, as seen in scans.
MISREADINGS = (
    "e:o c f", "o:c 0 e q", "a:n o", "d:cl", "h:li b", "t:f l i", "n:ri u", "r:v i", "i:l ! 1 j t", "s:f a 5 8",
    "w:vv", "l:i 1", "f:t s", "u:ii n", "k:lc", "g:9 q", "y:v", "b:6 8 h r", "c:o e g", "v:y", "m:in nn rn ni iii",
    "0:o", "1:l i", "5:s", "8:s b", "6:b", "9:g", "ß:b ss 8", "ü:u ii", "ö:o 0", "ä:a n o", "é:e c o", "è:e c o",
    "à:a n o", "ê:e c o", "ç:c e o", "ô:o c 0", "î:i l", "û:u n ii",
)

SIZE = len(CLASSES) + 1
NO_LETTER = 255
GRAM = 5  # letters of a shingle by which lines are laid on a passage


def _folding() -> np.ndarray:
    """The class of every code point: accented letters join their base, letters of no class are spread over all."""
    listed = {c: k for k, letters in enumerate(CLASSES) for c in letters}
    table = np.full(sys.maxunicode + 1, NO_LETTER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalnum():
            small = c.lower()
            base = small if small in listed else unicodedata.normalize("NFKD", small)[0]
            table[code] = listed.get(base, ord(base) % SIZE)
    return table


FOLD = _folding()
EXPLAINED = {(one, other) for line in MISREADINGS for one, _, rest in [line.partition(":")] for other in rest.split()}


def folded(text: str) -> np.ndarray:
    """The class of every character, NO_LETTER for those that are none; ``!`` between letters stands for one."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    code = FOLD[points]
    marks = np.flatnonzero(points[1:-1] == ord("!")) + 1
    inner = marks[(code[marks - 1] != NO_LETTER) & (code[marks + 1] != NO_LETTER)]
    code[inner] = FOLD[ord("1")]
    return code


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter classes of all texts in a row, and the text number of each letter."""
    code = folded("\n".join(t or "" for t in texts))
    at = np.flatnonzero(code != NO_LETTER)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    # letters of text i are those before its end; repeat is cheaper than a search per letter
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    return code[at], np.repeat(np.arange(len(texts), dtype=np.int32), counts)


def plain(text: str) -> str:
    """Lower-case letters, digits and line ends; ``!`` between letters stands for one and becomes 1."""
    try:
        marked = _MARK.sub("1", text) if "!" in text else text
        return marked.encode("latin-1").translate(_LOWER, _DROPPED).decode("latin-1")  # much faster, and the same
    except UnicodeEncodeError:
        return _NEITHER.sub("", _MARK.sub("1", text.lower()))


_NEITHER = re.compile(r"[^\w\n]+|_+")
_MARK = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
_LATIN = [chr(i) for i in range(256)]
_LOWER = "".join(_LATIN).lower().encode("latin-1")
_DROPPED = "".join(c for c in _LATIN if _NEITHER.match(c)).encode("latin-1")


def trigrams(letters: np.ndarray) -> np.ndarray:
    a = letters.astype(np.int32)
    return a[:-2] * (SIZE * SIZE) + a[1:-1] * SIZE + a[2:] if len(a) > 2 else np.empty(0, np.int32)


def grams(letters: np.ndarray) -> np.ndarray:
    """Every GRAM letters in a row as one number."""
    code = np.zeros(max(len(letters) - GRAM + 1, 0), dtype=np.int64)
    for k in range(GRAM if len(code) else 0):
        code = code * SIZE + letters[k : k + len(code)]
    return code
