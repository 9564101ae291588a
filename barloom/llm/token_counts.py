"""Token counts by a Viterbi search that carries nothing but the best score and its number of pieces.

The vocabulary's pieces and scores come from a SentencePiece file and are read as a unigram model.
An Aho-Corasick automaton names all pieces that end at each character; for each place the search
keeps the best score of a segmentation up to there and how many pieces it has. Ties follow the
tokenizer's rule: of two equally good ways to reach a place, the one whose last piece begins first.
A character that is no piece costs 10 more than the worst piece and, with byte fallback, counts as
its UTF-8 bytes. Like the tokenizer, a text that isn't empty gets a space before it.

No piece has a space after another character, so every best segmentation is cut before each run of
spaces, and a text's result is the sum over its words (a run of spaces, then what isn't a space);
each distinct word is searched once. Scores are added exactly, in 64 bits; the tokenizer's 32-bit
sums round from about 2**24 on (a sum of some 500 pieces, or any unknown character here, as the
worst score is -1e9), where its ties can differ from this exact rule.

Null and empty texts have no tokens and score 0; null and repeated identifiers are counted like
others; an empty table gives no rows; other columns are not read. A very long text is one block of its task: its bytes, with
some 24 bytes for each (hashes of ranges), and the places of its words; a single word without spaces is searched as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slim, table
from barloom.llm.textblock import WordPool, blocks, distinct_words, text_bytes, tidied

UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class Vocabulary:
    """Pieces with scores, and the search of a word."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def count(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation."""
        n = len(word)
        best, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
        # matches come by where they end, longest first, so that only a better score takes the place of an earlier beginning
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        if self.single.issuperset(word):
            for end, (length, score) in matches:
                value = best[end + 1 - length] + score
                if value > best[end + 1]:
                    best[end + 1], pieces[end + 1] = value, pieces[end + 1 - length] + 1
            return pieces[n], best[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in matches:
            ends[end].append(match)
        for end in range(n):
            for length, score in ends[end]:
                value = best[end + 1 - length] + score
                if value > best[end + 1]:
                    best[end + 1], pieces[end + 1] = value, pieces[end + 1 - length] + 1
            if word[end] not in self.single and best[end] + self.unknown > best[end + 1]:
                best[end + 1], pieces[end + 1] = best[end] + self.unknown, pieces[end] + len(word[end].encode())
        return pieces[n], best[n]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """From a SentencePiece file: its pieces but for control, unknown, byte and unused ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    pieces = {model.id_to_piece(i): model.get_score(i) for i in kept}
    if crossing := next((p for p in pieces if SPACE in p.lstrip(SPACE)), None):
        raise ValueError(f"a piece goes beyond a word, so words can't be counted apart: {crossing}")
    return Vocabulary(pieces)


@lru_cache(maxsize=2)
def pool_of(path: str) -> WordPool:
    """Counts and scores of words; each task leaves it empty."""
    own = vocabulary(path)
    return WordPool(lambda words: [own.count(w.decode().replace(" ", SPACE)) for w in words], most=600_000, dtype=np.float64)


def word_starts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin: at a text's begin, and at spaces that follow something else."""
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    space = body == 0x20
    return np.flatnonzero(first[:-1] | (space & ~np.append(False, space[:-1])))


def spaced(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each that isn't empty with a space before it."""
    size = np.diff(at)
    new = np.append(0, np.cumsum(size + (size > 0)))
    out = np.full(new[-1], 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new[:-1][size > 0]] = False
    out[inside] = body
    return out, new


def counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pool_of(path)
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            tokens, scores = [], []
            for i, j in blocks(at):
                own, edge = spaced(body[at[i] : at[j]], at[i : j + 1] - at[i])
                start = word_starts(own, edge)
                words, number = distinct_words(own, start)
                place, _ = pool.numbers(words)
                doc = np.searchsorted(edge, start, "right") - 1
                for to, k in ((tokens, 0), (scores, 1)):
                    to.append(np.bincount(doc, pool.values[place + k][number] if len(words) else np.empty(0), j - i))
            done = [np.concatenate(x) if x else np.empty(0) for x in (tokens, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done[0].astype(np.int64)), pa.array(done[1])], names=["doc_id", "n_tokens", "score"])

    return slim(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run, lambda: pool_of(path)), "doc_id long, n_tokens long, score double")


def op9_viterbi_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
