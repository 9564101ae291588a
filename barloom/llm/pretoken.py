"""Pre-tokens of byte-level BPE for a whole block of texts at once.

The pattern is ``public_tokenizers.PATTERN``. Its character classes are asked from the tokenizer
library whose result is to be matched, so the two can't disagree on a code point. Then a word is
a run of letters, of numbers or of other characters, with one space before it if there is one; a
run of white space leaves its last character to what follows; and seven endings (``'s`` and so on)
stand alone where an apostrophe opens a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
CLASSES = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
POINTS = 0x110000
#: Fixed values of the pattern: what may follow an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _matching_tiktoken(pattern: str, text: str) -> str:
    import tiktoken

    own = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(own.encode_ordinary(text)).decode()


def _matching_tokenizers(pattern: str, text: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
    return "".join(x for x, _ in split.pre_tokenize_str(text))


@lru_cache(maxsize=2)
def classes(library: str) -> np.ndarray:
    """The class of each code point, as ``library`` (tiktoken or tokenizers) sees it."""
    matching = {"tiktoken": _matching_tiktoken, "tokenizers": _matching_tokenizers}[library]
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, POINTS)]).astype("<u4")
    every, out = points.tobytes().decode("utf-32-le"), np.zeros(POINTS, np.uint8)
    for kind, pattern in CLASSES:
        out[np.frombuffer(matching(pattern, every).encode("utf-32-le"), "<u4")] = kind
    return out


def words(body: np.ndarray, at: np.ndarray, library: str) -> np.ndarray:
    """Where words begin in ``body``, whose texts begin (and end) at ``at``. Words cover all of it and end with their text."""
    if not len(body):
        return np.empty(0, np.int64)
    point = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
    plain = len(point) == len(body)
    place = None if plain else np.flatnonzero((body & 0xC0) != 0x80)
    n = len(point)
    first = np.zeros(n + 1, bool)  # of a text
    edges = np.unique(at)
    first[edges if plain else np.searchsorted(place, edges)] = True
    kind = classes(library)[point]
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    # a run that isn't white space, with white space of the same text before it
    after = runs[(kind[runs] != SPACE) & ~first[runs]]
    after = after[kind[after - 1] == SPACE]
    begins[after - 1] = True
    begins[after[point[after - 1] == 0x20]] = False
    # endings
    mark = np.flatnonzero((point == 0x27) & begins[:n])
    if len(mark):
        begun = mark  # an apostrophe after a space has lost its beginning to that space
        padded = np.concatenate([point, np.zeros(3, point.dtype)])
        closed = np.concatenate([first, np.ones(3, bool)])
        for ending in ENDINGS:
            hit = np.ones(len(begun), bool)
            for k, c in enumerate(ending, 1):
                hit &= (padded[begun + k] == ord(c)) & ~closed[begun + k]
            found = begun[hit]
            begins[found + 1] = False
            past = found + 1 + len(ending)
            past = past[past < n]
            begins[past] = True
    got = np.flatnonzero(begins)
    return got if plain else place[got]
