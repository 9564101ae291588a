"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import regex

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Size of the set and component of each document."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    with_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            with_shingle[x].append(i)
    seen = set()
    for some in with_shingle.values():
        for i in some:
            for j in some:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


def without_repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, bytes]]:
    """Bytes, bytes removed, runs removed, and what is left of each document."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept)
    return out


def unigram(text: str | None, scores: dict[str, float], longest: int) -> tuple[int, float]:
    """Pieces and score of the best segmentation of a whole text; of equal ones the one whose last piece begins first."""
    word = ("▁" + text.replace(" ", "▁")) if text else ""
    unknown = min(scores.values()) - 10.0
    best, count = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            score, n = (scores[piece], 1) if piece in scores else (unknown, len(piece.encode())) if len(piece) == 1 else (None, 0)
            if score is not None and best[start] + score > best[end]:
                best[end], count[end] = best[start] + score, count[start] + n
    return count[-1], best[-1]


def window_score(text: str | None, weights, intercept: float, shortest: int, longest: int, window: int) -> float:
    """The highest mean of a window of words, each the mean of the weights of its marked n-grams, through the logistic function."""
    bits = len(weights).bit_length() - 1

    def spread(x: int) -> int:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def value(word: str) -> float:
        marked, found = f"<{word}>", []
        for i in range(len(marked)):
            h = 0
            for n, c in enumerate(marked[i : i + longest], 1):
                h = spread((h + ord(c) * n) % 2**64)
                if n >= shortest:
                    found.append(float(weights[h >> 64 - bits]))
        return sum(found) / len(found)

    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    values = [value(w) for w in regex.findall(r"[\p{L}\p{N}]+", lower)]
    means = [sum(some) / len(some) for some in (values[i : i + window] for i in range(max(len(values) - window, 0) + 1)) if some]
    return 1 / (1 + math.exp(-max(means, default=0.0) - intercept))


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
