"""Personal data in texts: patterns, and a character-level bidirectional LSTM with a CRF for what they miss.

The patterns give the base spans. From them, as labelled spans, a tagger is trained in numpy: characters
choose the inputs of two LSTMs (one reads forwards, one backwards), a linear layer scores the nine tags (outside, and begin
or inside of each kind), and a linear-chain CRF with learnt transitions is fitted by its exact likelihood. Beside the texts as they
are, it sees each labelled span rewritten in other ways to write the same thing (``variants``), and numbers, dates and signs
that are no personal data (``decoys``), in the texts' own surroundings. It is trained in one task on a bounded
sample: at most ``Settings.rows`` texts and ``Settings.windows`` windows; held-out identifiers (CRC-32 divisible by 5) are never among them.

To tag a text, windows that overlap by half are laid over everything within ``reach`` characters of a digit, an ``@`` or a written-out
``at`` or ``dot`` that no base span covers; an added span holds one of these by definition. Each window is decoded by Viterbi; spans cut by an edge that
isn't the text's are left to the next window, and of all windows' spans the disjoint set of the highest total margin is
chosen for the whole text (weighted interval scheduling). A margin is by how much the best path is better than the same path without the span. Added
spans keep clear of base spans, begin and end where words do, have a margin of ``Settings.margin`` at least and must hold what their kind needs (four numbers up to 255, a
Luhn sum, and so on), so base spans always stay as they are.

Null text is an empty one, without spans. A null or repeated identifier is like any other (a null one is never trained on). Without labelled spans in the
sample nothing is added. An empty table gives no rows. A very long text is held by its task with its windows' places; windows are decoded 512 at a time. An added span
has at most half a window's characters. Columns other than the key and the text aren't read by ``find``; ``redact`` keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import pretoken
from barloom.llm.common import slim, small_batches, table, written
from barloom.llm.textblock import tidied
from barloom.llm.toxicity import fifth

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
TAGS = 1 + 2 * len(KINDS)  # outside; begin of kind k is 1 + 2k, inside 2 + 2k
#: The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an added span must hold one of; Java and Python read it alike.
TRIGGER = r"[0-9@]+|[\[({<][\x20]?(?i:at|dot)[\x20]?[\])}>]|\x20(?i:at)\x20[^\x20\n]{1,64}\x20(?i:dot)\x20"
_TRIGGER = re.compile(TRIGGER)
AT = re.compile(r"\x20*[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20*|\x20at\x20|\x20?@\x20?", re.I)
DOT = re.compile(r"\x20*[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20*|\x20dot\x20", re.I)
#: Long numbers and signs that the patterns don't take: they may be personal data, so nothing is learnt from them.
UNSURE = re.compile(r"[0-9](?:[^0-9A-Za-z\n]{0,3}[0-9]){9,}|@|[\[({<]\x20?(?i:at|dot)|(?:[0-9]{1,3}[^0-9A-Za-z\n]{1,3}){3}[0-9]")


@dataclass(frozen=True)
class Settings:
    rows: int = 2_000
    windows: int = 4_000
    #: Labelled spans, and unlabelled places, of one text at most.
    per_text: int = 4
    hidden: int = 16
    learn: int = 72
    window: int = 96
    reach: int = 32
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    margin: float = 1.0
    seed: int = 11


# base spans


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(x * 2 - 9 * (x > 4) for x in own[1::2])) % 10 == 0


def small(number: str) -> bool:
    """Whether a number of whatever length is at most 255."""
    digits = number.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with what may stand before it since the last match: no run of characters is read twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        found, begin = DOMAIN.match(text, at + 1), at
        if found:
            while begin > floor and text[begin - 1] in LOCAL:
                begin -= 1
        if begin < at:
            floor = found.end()
            yield begin, floor
        at = text.find("@", max(floor, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """In a chain of numbers joined by dots, four and four."""
    for chain in NUMBERS.finditer(text):
        if chain[0].count(".") > 2:
            at, parts = chain.start(), chain[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(map(small, parts[i : i + 4])):
                    yield at, at + size
                at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in CALL.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield m.span()


def base(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` of the base spans, by start, then kind; in time proportional to the text's length."""
    return sorted(((a, b, k) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text)), key=lambda s: (s[0], s[2]))


def holds(kind: int, text: str) -> bool:
    """Whether an added span has what its kind needs."""
    if kind == EMAIL:
        return bool(WHOLE_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", text))))
    groups = re.findall("[0-9]+", text)
    digits = "".join(groups)
    if kind == IP:
        return len(groups) == 4 and all(map(small, groups))
    if kind == CARD:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


# the tagger

PAD, SYMBOLS = 0, 132


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A symbol for each code point: ASCII in lower case, all digits alike; others by their class."""
    out = 128 + pretoken.classes("tiktoken")
    own = np.arange(128)
    own[65:91] += 32
    own[48:58] = 48
    own[0] = 1
    out[:128] = own
    return out.astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    return _symbols()[np.frombuffer(text.encode("utf-32-le"), "<u4")]


def start_values(s: Settings) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(s.seed), s.hidden
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(h), shape).astype(np.float32)
    own = {f"{name}{way}": draw(*shape) for way in "fb" for name, shape in (("x", (SYMBOLS, 4 * h)), ("h", (h, 4 * h)))}
    for way in "fb":
        own[f"x{way}"][:, h : 2 * h] += 1  # remember at first
    own |= {"out": draw(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
    own["bias"][0] = 1
    for k in range(len(KINDS)):  # an inside tag follows only its own kind's
        ok = {1 + 2 * k, 2 + 2 * k}
        own["next"][[t for t in range(TAGS) if t not in ok], 2 + 2 * k] = -30
    return own


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def read(own: dict[str, np.ndarray], way: str, ids: np.ndarray, keep: bool = False):
    """Hidden states (time, window, unit) of one LSTM over windows of symbols (time, window); with ``keep`` also what its gradient needs."""
    steps, n = ids.shape
    h = own[f"h{way}"].shape[0]
    states = np.empty((steps, n, h), np.float32)
    kept = [None] * steps
    hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = own[f"x{way}"][ids[t]] + hidden @ own[f"h{way}"]
        gates, new = _squash(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        before, last = cell, hidden
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
        bent = np.tanh(cell)
        hidden = gates[:, 2 * h :] * bent
        states[t] = hidden
        if keep:
            kept[t] = gates, new, before, last, bent
    return (states, kept) if keep else states


def unread(own: dict[str, np.ndarray], way: str, ids: np.ndarray, kept: list, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one LSTM, given that of its hidden states."""
    steps, n = ids.shape
    h = own[f"h{way}"].shape[0]
    by_symbol, by_hidden = np.zeros_like(own[f"x{way}"]), np.zeros_like(own[f"h{way}"])
    dz_all = np.empty((steps, n, 4 * h), np.float32)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
        gates, new, before, last, bent = kept[t]
        dh = dh + wanted[t]
        dc = dc + dh * gates[:, 2 * h :] * (1 - bent**2)
        dz = dz_all[t]
        slope = gates * (1 - gates)
        dz[:, :h] = dc * new * slope[:, :h]
        dz[:, h : 2 * h] = dc * before * slope[:, h : 2 * h]
        dz[:, 2 * h : 3 * h] = dh * bent * slope[:, 2 * h :]
        dz[:, 3 * h :] = dc * gates[:, :h] * (1 - new**2)
        by_hidden += last.T @ dz
        dh = dz @ own[f"h{way}"].T
        dc = dc * gates[:, h : 2 * h]
    flat, order = ids.ravel(), np.argsort(ids.ravel(), kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    by_symbol[used] = np.add.reduceat(dz_all.reshape(-1, 4 * h)[order], first, axis=0)
    return {f"x{way}": by_symbol, f"h{way}": by_hidden}


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(scores: np.ndarray, follow: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags (time, window) under the CRF, and its gradients by the scores (time, window, tag) and by the transitions."""
    steps, n, _ = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + follow, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(follow + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    at = np.arange(n)
    told = sum(scores[t, at, tags[t]] for t in range(steps)) + follow[tags[:-1], tags[1:]].sum(axis=0)
    by_score = np.exp(ahead + back - total[:, None])
    by_follow = np.zeros_like(follow)
    for t in range(1, steps):
        by_follow += np.exp(ahead[t - 1][:, :, None] + follow + (scores[t] + back[t] - total[:, None])[:, None, :]).sum(axis=0)
        by_score[t, at, tags[t]] -= 1
    by_score[0, at, tags[0]] -= 1
    np.subtract.at(by_follow, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return float((total - told).mean()), by_score / n, by_follow / n


def gradients(own: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of all parameters for windows (time, window)."""
    ahead, kept_f = read(own, "f", ids, True)
    back, kept_b = read(own, "b", ids, True)
    both = np.concatenate([ahead, back], axis=2)
    loss, by_score, by_follow = likelihood(both @ own["out"] + own["bias"], own["next"], tags)
    h = ahead.shape[2]
    wanted = by_score @ own["out"].T
    found = {"out": np.tensordot(both, by_score, ([0, 1], [0, 1])), "bias": by_score.sum(axis=(0, 1)), "next": by_follow}
    return loss, found | unread(own, "f", ids, kept_f, wanted[:, :, :h]) | unread(own, "b", ids, kept_b, wanted[:, :, h:])


def fit(ids: np.ndarray, tags: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Parameters after Adam over windows (window, time)."""
    own, rng = start_values(s), np.random.default_rng(s.seed)
    mean, square = ({k: np.zeros_like(v) for k, v in own.items()} for _ in range(2))
    step, steps = 0, s.epochs * -(-len(ids) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(ids))
        for b in range(0, len(ids), s.batch):
            mine = order[b : b + s.batch]
            _, slopes = gradients(own, np.ascontiguousarray(ids[mine].T), np.ascontiguousarray(tags[mine].T))
            size = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
            step += 1
            rate = s.rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in slopes.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                own[k] = (own[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return own


def best_paths(scores: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The tags (time, window) of the best path of each window."""
    steps, n, _ = scores.shape
    came, best = np.empty(scores.shape, np.int8), scores[0]
    for t in range(1, steps):
        ways = best[:, :, None] + follow
        came[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[t]
    path = np.empty((steps, n), np.int64)
    path[-1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t][np.arange(n), path[t]]
    return path


# training windows

WORD = re.compile(r"[A-Za-z]{2,12}")
#: Ends of domains in rewritten addresses.
ENDS = ("com", "org", "net", "edu", "info", "io", "de", "fr", "es", "co.uk")


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _pick(rng, some):
    return some[int(rng.integers(len(some)))]


def card_number(rng, n: int) -> str:
    digits = _digits(rng, n - 1)
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def variant(kind: int, rng, words: list[str]) -> str:
    """Something of a kind, in one of the ways that people write it; ``words`` are the text's own."""
    word = lambda: _pick(rng, words)
    if kind == EMAIL:
        local = word().lower() + _pick(rng, ("", ".", "_", "-", "+")) + _pick(rng, (word().lower(), _digits(rng, 2), ""))
        at, dot = _pick(rng, (("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "{dot}"), ("@", "[dot]"), ("@", " dot "), ("@", "[.]")))
        parts = [word().lower() + _pick(rng, ("", "", _digits(rng, 1))) for _ in range(int(rng.integers(1, 3)))]
        return (local.rstrip("._-+") or "me") + at + dot.join([*parts, *_pick(rng, ENDS).split(".")])
    if kind == IP:
        return _pick(rng, (".", ".", "[.]", " . ", "(.)", "[dot]", " dot ", "(dot)")).join(str(rng.integers(256)) for _ in range(4))
    if kind == CARD:
        digits, gap = card_number(rng, int(_pick(rng, (14, 15, 16, 16, 16, 17, 18, 19)))), _pick(rng, ("", " ", "-", ".", "  ", " - ", "_", "/"))
        sizes = (4, 6, 9) if len(digits) == 15 else (4,) * 5
        parts, at = [], 0
        for size in sizes:
            parts.append(digits[at : at + size])
            at += size
        return gap.join(x for x in parts if x)
    area, mid, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    code = str(rng.integers(1, 99))
    return _pick(rng, (
        f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+{code} ({area}) {mid}-{last}", f"+{code}-{area}-{mid}-{last}", f"+{code} {area} {mid} {last}", f"{area} {mid} {last}", f"00{code} {area} {mid}{last}",
        f"+{code}/{area}/{mid}{last}", f"({area}){mid}-{last}", f"+ {code} {area} {mid} {last}", f"1-{area}-{mid}-{last}", f"+{code}.{area}.{mid}.{last}", f"0{area} {mid}{last}", f"tel {area} {mid} {last}"[4:],
    ))


def decoy(rng, words: list[str]) -> str:
    """Something with digits or signs that is no personal data."""
    number = lambda *n: _digits(rng, int(_pick(rng, n)))
    word = lambda: _pick(rng, words)
    return _pick(rng, (
        f"{1900 + rng.integers(130)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{1900 + rng.integers(130)}", f"{rng.integers(24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}",
        f"v{rng.integers(9)}.{rng.integers(30)}.{rng.integers(30)}", f"{rng.integers(9)}.{rng.integers(30)}", f"{number(1, 2, 3)},{number(3)}.{number(2)}", number(1, 2, 3, 4), number(5, 6, 7, 8), f"{1900 + rng.integers(130)}",
        f"{number(3)} {number(4)}", f"@{word()}", f"{word()} @ {word()}", "@@@", f"{word()}{number(1, 2)}", f"{word()}@{word()}", "".join(map(str, rng.choice(list("0123456789abcdef"), 40))), f"${number(2, 3)}.{number(2)}",
        f"{rng.integers(1900, 2000)}-{rng.integers(2000, 2030)}", f"{word()} at {word()}", f"{number(2)}%", f"#{number(5)}", f"{number(2)}x{number(2)}", f"({number(4)})", f"{number(1)}.", f"looked at {word()} (at {word()})",
        f"{rng.integers(300, 999)}.{rng.integers(300, 999)}.{rng.integers(300, 999)}.{rng.integers(300, 999)}", f"{number(2)}-{number(2)}-{number(2)}",
    ))


def examples(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Windows of symbols, their tags, and how many labelled spans these come from.

    A round takes each labelled span as it is, rewritten as its own and as every kind, and its place with decoys in it; rounds go on until there are
    enough windows. Half as many windows at most, before these, show unlabelled triggers as they stand.
    """
    rng = np.random.default_rng(s.seed)
    size, ids, tags = s.learn, [], []

    def add(left: str, middle: str, right: str, kind: int | None = None) -> None:
        """A window that holds the middle, all of it a span of the kind if there is one, at a random place."""
        room = size - len(middle)
        if room < 0:
            return
        before = min(len(left), int(rng.integers(room + 1)))
        text = left[len(left) - before :] + middle + right[: room - before]
        row, tag = np.full(size, PAD, np.uint8), np.zeros(size, np.int64)
        row[: len(text)] = symbols(text)
        if kind is not None:
            tag[before : before + len(middle)] = 2 + 2 * kind
            tag[before] = 1 + 2 * kind
        ids.append(row)
        tags.append(tag)

    known = [base(text) for text in texts]
    marked = [(text, span) for text, spans in zip(texts, known, strict=True) for span in spans[: s.per_text] if span[1] - span[0] <= size // 2]
    for text, spans in zip(texts, known, strict=True) if marked else ():
        cover = _Cover(spans)
        plain = [m for m in _TRIGGER.finditer(text) if not cover.meets(m.start(), m.end())]
        for i in rng.permutation(len(plain))[: s.per_text].tolist() if len(ids) < s.windows // 2 else ():
            a, b = plain[i].start(), min(plain[i].end(), plain[i].start() + size // 2)
            left, right = text[max(0, a - size // 2) : a], text[b : b + size // 2]
            if not UNSURE.search(left + text[a:b] + right) and not base(left + text[a:b] + right):
                add(left, text[a:b], right)
    while marked and len(ids) < s.windows:
        for text, (a, b, k) in marked:
            words = WORD.findall(text[max(0, a - 4000) : b + 4000]) or ["name"]
            left, right = text[max(0, a - size) : a], text[b : b + size]
            if not (UNSURE.search(left) or UNSURE.search(right)):
                add(left, text[a:b], right, k)
            left, right = re.sub(r"[0-9@]", "", left), re.sub(r"[0-9@]", "", right)
            for kind in (k, *range(len(KINDS))):
                add(left, variant(kind, rng, words), right, kind)
            for _ in range(3):
                add(left, decoy(rng, words), right)
            if len(ids) >= s.windows:
                break
    return np.array(ids, np.uint8).reshape(len(ids), size), np.array(tags, np.int64).reshape(len(ids), size), len(marked)


# tagging


class _Cover:
    """Which places some spans cover."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.begin, self.end, last = [], [], 0
        for a, b, _ in sorted(spans):
            if self.begin and a <= last:
                self.end[-1] = last = max(last, b)
            else:
                self.begin.append(a)
                self.end.append(b)
                last = b

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.begin, b - 1) - 1
        return i >= 0 and self.end[i] > a


def windows(text: str, spans: list[tuple[int, int, int]], s: Settings) -> Iterator[tuple[int, int]]:
    """Begin and end of the windows over a text, each half of the last."""
    cover, begin, end = _Cover(spans), 0, -1

    def over(a: int, b: int) -> Iterator[tuple[int, int]]:
        for at in range(a, max(a + 1, b - s.window // 2), s.window // 2):
            yield at, min(at + s.window, b)

    for m in _TRIGGER.finditer(text):
        if not cover.meets(m.start(), m.end()):
            a, b = max(0, m.start() - s.reach), min(len(text), m.end() + s.reach)
            if a > end:
                if end > begin:
                    yield from over(begin, end)
                begin = a
            end = b
    if end > begin:
        yield from over(begin, end)


def window_spans(own: dict[str, np.ndarray], rows: list[np.ndarray], s: Settings) -> Iterator[list[tuple[int, int, int, float]]]:
    """For each window ``start, end, kind, margin`` of the spans on its best path."""
    ids = np.full((s.window, len(rows)), PAD, np.uint8)
    for k, row in enumerate(rows):
        ids[: len(row), k] = row
    scores = np.concatenate([read(own, "f", ids), read(own, "b", ids)], axis=2) @ own["out"] + own["bias"]
    path, follow = best_paths(scores, own["next"]), own["next"]
    for k, row in enumerate(rows):
        tags, found, t = path[:, k], [], 0
        while t < len(row):
            if not tags[t]:
                t += 1
                continue
            kind, a = (int(tags[t]) - 1) // 2, t
            t += 1
            while t < len(row) and tags[t] == 2 + 2 * kind:
                t += 1
            own_path, without = tags[max(0, a - 1) : t + 1].copy(), tags[max(0, a - 1) : t + 1].copy()
            without[min(a, 1) : min(a, 1) + t - a] = 0
            steps = lambda p: follow[p[:-1], p[1:]].sum()
            margin = (scores[np.arange(a, t), k, tags[a:t]] - scores[a:t, k, 0]).sum() + steps(own_path) - steps(without)
            found.append((a, t, kind, float(margin)))
        yield found


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The disjoint spans of the highest total margin; of equal sets the one that its last, shortest choice gives."""
    spans = sorted(spans, key=lambda x: (x[1], -x[0], x[2]))
    ends = [x[1] for x in spans]
    best, takes = [0.0], []
    for i, (a, _, _, margin) in enumerate(spans):
        before = bisect_right(ends, a, 0, i)
        takes.append(before if best[before] + margin > best[-1] else -1)
        best.append(max(best[-1], best[before] + margin))
    out, i = [], len(spans)
    while i:
        if takes[i - 1] >= 0:
            out.append(spans[i - 1][:3])
            i = takes[i - 1]
        else:
            i -= 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def added(own: dict[str, np.ndarray], texts: list[str], known: list[list[tuple[int, int, int]]], s: Settings = Settings()) -> list[list[tuple[int, int, int]]]:
    """The spans that the tagger adds to each text's base spans."""
    candidates: list[dict[tuple[int, int, int], float]] = [{} for _ in texts]
    places: list[tuple[int, int, int]] = []

    def decode() -> None:
        for (k, a, b), spans in zip(places, window_spans(own, [symbols(texts[k][a:b]) for k, a, b in places], s), strict=True):
            text = texts[k]
            for start, end, kind, margin in spans:
                if (start == 0 and a > 0) or (end == b - a and b < len(text)):
                    continue
                start, end = start + a, end + a
                while start < end and text[start].isspace():
                    start += 1
                while end > start and text[end - 1].isspace():
                    end -= 1
                span = start, end, kind
                cut = text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum()
                if margin >= s.margin and not cut and 0 < end - start <= s.window // 2 and holds(kind, text[start:end]):
                    candidates[k][span] = max(margin, candidates[k].get(span, 0.0))
        places.clear()

    for k, text in enumerate(texts):
        for a, b in windows(text, known[k], s):
            places.append((k, a, b))
            if len(places) == 512:
                decode()
    if places:
        decode()
    out = []
    for spans, mine in zip(known, candidates, strict=True):
        cover = _Cover(spans)
        out.append(reconciled([(*x, m) for x, m in mine.items() if not cover.meets(x[0], x[1]) and not (spans and any(b == x[0] or a == x[1] for a, b, k in spans if k == x[2]))]))
    return out


# on tables


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row (none for an empty sample): the tagger's parameters, empty without labelled spans, fitted in one task on the sample: texts with a trigger, by the smallest hashes of their identifiers."""
    learn = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & ~fifth(F.col("_id")) & F.col("_text").rlike("[0-9@]"))
    sample = learn.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(s.rows)  # short rows, which may be broadcast
    small_batches(docs.sparkSession)
    rows = learn.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_text").alias("_text"))

    def run(part: pa.Table) -> pa.Table:
        ids, tags, labelled = examples(part.sort_by("_id")["_text"].to_pylist(), s)
        raw = BytesIO()
        if labelled:
            np.savez(raw, **fit(ids, tags, s))
        return pa.table({"model": pa.array([raw.getvalue()], pa.binary())})

    return written(rows.groupBy().applyInArrow(run, "model binary"), "pii-model")


def loaded(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(BytesIO(raw))) if raw else {}


def all_spans(texts: list[str], own: dict[str, np.ndarray], s: Settings) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    known = [base(t) for t in texts]
    return list(zip(known, added(own, texts, known, s) if own else [[] for _ in texts], strict=True))


def _shared(docs: DataFrame, model: DataFrame):
    """The parameters, some 100 KB whatever the table's size, for all tasks."""
    row = model.first()
    return docs.sparkSession.sparkContext.broadcast(bytes(row["model"]) if row else b"")


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


def find(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``doc_id``, counts of base spans by kind, digest of the base spans, all spans, and how many were added. Texts without a trigger don't leave the JVM."""
    shared = _shared(docs, model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shared.value)
        for batch in batches:
            found = all_spans(batch.column(1).to_pylist(), own, s)
            counts = [pa.array([sum(x[2] == k for x in known) for known, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [sha256(told(known).encode()).hexdigest() for known, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([told(known + more) for known, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())], names=names)

    rows = slim(docs, key, text)
    only = rows.select(F.col(key).cast("long").alias("doc_id"), F.when(F.col(text).rlike(TRIGGER), F.col(text)).otherwise("").alias("_text"))
    return only.mapInArrow(tidied(run), f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: DataFrame, text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs`` with all its columns; each span of its texts stands as the kind's name in brackets (of overlapping spans, as the first one's)."""
    shared = _shared(docs, model)
    small_batches(docs.sparkSession)

    def hidden(body: str | None, own: dict[str, np.ndarray]) -> str | None:
        if not body or not _TRIGGER.search(body):
            return body
        (known, more), = all_spans([body], own, s)
        out, at = [], 0
        for a, b, k in sorted(known + more, key=lambda x: (x[0], x[2])):
            if a >= at:
                out += [body[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array([hidden(t, own) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)


def op13_bilstm_crf_pii(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
