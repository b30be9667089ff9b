"""Token counts of a unigram tokenizer, without making the tokens.

A text is escaped (a space is ``\\u2581``, one goes before the text) and split before every escape. In a
word, an Aho-Corasick automaton enumerates the vocabulary's matches by their end; dynamic programming keeps the best
score up to each place with the number of pieces on the path that has it. Ties go to the path whose last piece starts
first, as in the tokenizer, which replaces a best score only by a greater one. A character that isn't a piece by itself
costs the smallest score less ten; adjoining ones are one unknown piece, or their bytes if the vocabulary has byte pieces.

Nulls: a null text is empty and has no tokens. Repeated rows get equal rows; an empty table gives an empty result. Whole texts
are counted; words recur, so their counts are kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ship

ESCAPE = "▁"
CACHE_ENTRIES = 400_000
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.scores = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> tuple[float, int]:
        """Best score and number of pieces of an escaped word."""
        n = len(word)
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, ends = 0, self.automaton.iter(word) if len(self.automaton) else iter(())
        nxt = next(ends, None)
        while at < n:
            top = None
            # Matches with one end come longest first, so by start, as the tokenizer meets them.
            single = False
            while nxt is not None and nxt[0] == at:
                size, score = nxt[1]
                value = best[at + 1 - size] + score
                if top is None or value > top:
                    top, pieces, free = value, count[at + 1 - size] + 1, False
                single = single or size == 1
                nxt = next(ends, None)
            if not single:
                value = best[at] + self.unknown
                if top is None or value > top:
                    top, free = value, True
                    pieces = count[at] + (len(word[at].encode()) if self.bytes else 0 if loose[at] else 1)
            at += 1
            best[at], count[at], loose[at] = top, pieces, free
        return best[n], count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(ESCAPE, " ")
        words = text.split(" ")
        if not words[0]:
            words = words[1:]
        found = list(map(self.cache.get, words))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    found[i] = self.cache.get(w)
                    if found[i] is None:
                        found[i] = self.word(ESCAPE + w)[1]
                        if len(w) <= 64 and len(self.cache) < CACHE_ENTRIES:
                            self.cache[w] = found[i]
        return sum(found)


def count_tokens(documents: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens. ``pieces`` has the size of a vocabulary and goes to the executors once."""
    shared = ship(documents.sparkSession).sparkContext.broadcast(pieces)
    key = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                counts = [counter.text(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long")
