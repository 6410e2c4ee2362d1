"""Token counts of a unigram tokenizer without making the tokens.

The vocabulary's pieces are found by an Aho-Corasick automaton; dynamic programming over the
positions carries the best score and the number of pieces behind it.  Ties are settled as in the
tokenizer itself: of equal scores the path whose last piece starts first stays.  A character that is no piece
counts as unknown, with ten less than the lowest score of all, and gives one token per UTF-8 byte
where the vocabulary has byte pieces, or one token per run of unknown characters.

Texts are cut at spaces before that (each space becomes the mark U+2581 at the start of the next
word; the text gets one at its start), so a task counts every distinct word of a batch once.

The vocabulary is a file of the installed public tokenizers; its pieces are used with the score
-log(rank + 1) of a rank-frequency law, as the file holds merge ranks and no unigram scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = "<unk>"
#: The default file, and words that a task remembers.
VOCABULARY, REMEMBERED = "/opt/tokenizers/piece_bpe_32k.model", 500_000
PENALTY = 10.0

_PIECE = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) by rank; the first is the unknown piece.  Control pieces are left out, byte pieces kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [(UNKNOWN, 0.0)] + [(p, -log(rank + 1)) for rank, p in enumerate(pieces, 1)]


class Counter:
    """Counts pieces of words for one vocabulary [(piece, score), …] whose first entry is the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.known = dict(vocabulary)
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score, piece == vocabulary[0][0]))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))
        # Words of late, and those before them: words that keep coming stay.
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Tokens of one word by the best path; remembers a bounded number of words."""
        got = self.older.get(text) or self.best(text)[0]
        if len(text) <= 64:
            if len(self.seen) >= REMEMBERED // 2:
                self.older = dict(self.seen)
                self.seen.clear()
            self.seen[text] = got
        return got

    def best(self, text: str) -> tuple[int, float]:
        n = len(text)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, start, length, unk = 0, -1e308, 0, 0, False

        # Matches come by their end, of one end the longest first: so the first of equal scores starts first.
        for end, (size, s, u) in self.machine.iter(text):
            if end >= at:
                if length == 1 and not unk:
                    score[at], count[at] = best, count[start] + 1
                elif at:
                    self._settle(text, at, best, start, length, unk, score, count, odd)
                while at < end:
                    at += 1
                    self._settle(text, at, -1e308, 0, 0, False, score, count, odd)
                at, best, length = end + 1, -1e308, 0
            total = score[at - size] + s
            if total > best:
                best, start, unk = total, at - size, u
            length = size
        if at:
            self._settle(text, at, best, start, length, unk, score, count, odd)
        while at < n:
            at += 1
            self._settle(text, at, -1e308, 0, 0, False, score, count, odd)
        return count[n], score[n]

    def _settle(self, text: str, at: int, best: float, start: int, shortest: int, unk: bool, score: list, count: list, odd: list) -> None:
        """Write position ``at``, whose best match is given; without a piece of one character the unknown one competes."""
        if shortest != 1 and score[at - 1] + self.unknown > best:
            best, start, unk = score[at - 1] + self.unknown, at - 1, True
        score[at] = best
        if not unk:
            count[at] = count[start] + 1
            return
        odd[at] = True
        if self.bytes:
            piece = text[start:at]
            count[at] = count[start] + (1 if piece in self.known else len(piece.encode("utf-8", "surrogatepass")))
        else:
            count[at] = count[start] + (0 if start and odd[start] else 1)

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for a null or empty one."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = _PIECE.findall(marked if marked.startswith(MARK) else MARK + marked)
        counts = list(map(self.seen.get, words))
        if None in counts:
            seen, word = self.seen, self.word
            counts = [seen.get(w) or word(w) if c is None else c for c, w in zip(counts, words)]
        return sum(counts)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """A worker builds the automaton once; the file is at the same place on every machine."""
    return Counter(read_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for every row: tokens of the whole text.

    A null or empty text has 0 tokens.  Repeated rows come back as often as they are there, a null
    doc_id stays null, and other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([counter.text(t) for t in b["text"]], np.int64)})

    return docs.select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, tokens long")
