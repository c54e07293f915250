"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character;
dynamic programming carries the best score and its number of tokens.  Ties and unknown characters
follow the tokenizers library's unigram model: of equal scores the piece that starts first (the
longest) wins; a character that is no piece by itself may be unknown at the least score less 10;
unknown text falls back to its UTF-8 bytes, one token each.

Words are runs of ``[^\\x20\\x09-\\x0D]+`` with the word mark in front and are counted apart (the
library's Metaspace with split); words seen before come from a bounded cache.

Scores are log probabilities.  A file of a unigram model has them.  A BPE file has merge ranks in
their place, different whole numbers; as merges are found in order of frequency, a piece's rank r gives
its probability by the law of Zipf and Mandelbrot, proportional to 1 / (r + MANDELBROT).  Nothing is trained or counted.
Control pieces are no text and left out; byte pieces are for fallback and have a score that no other piece is below.

Defined results: a null or empty text has 0 tokens and score 0; repeated rows get a row each; a word of any
length is one segmentation, whose arrays are as long as the word.
The vocabulary is a sentencepiece file: its path is a parameter and must exist on each executor.
The default one is a BPE file, as no unigram file is available; how near counts are to those of its own ``encode()`` is in the README.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, per_batch, raw_texts, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MANDELBROT = 2.7
BYTE_SCORE = -1000.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and log probabilities of a sentencepiece file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {i: model.get_score(i) for i in ids if not model.is_byte(i)}
    by_rank = sorted(score, key=lambda i: (-score[i], i))
    ranked = [x for x in score.values() if x > -1e8]  # runs of word marks stand far below all others
    if len(set(ranked)) == len(ranked) and all(x == int(x) for x in ranked):  # merge ranks
        total = math.fsum(1 / (r + MANDELBROT) for r in range(1, len(by_rank) + 1))
        score = {i: -math.log((r + MANDELBROT) * total) for r, i in enumerate(by_rank, 1)}
    return [(model.id_to_piece(i), score.get(i, BYTE_SCORE)) for i in ids]


class UnigramCounter:
    LIMIT = 700_000

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min((score for _, score in vocab), default=0.0) - UNKNOWN_PENALTY
        self.count: dict[bytes, int] = {}
        self.score: dict[bytes, float] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best segmentation."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        single = [False] * n
        best[0] = 0.0
        at = 0  # characters before ``at`` are done

        def close(end: int) -> None:  # the unknown character comes last of all that ends there
            nonlocal at
            while at < end:
                if not single[at]:
                    got = best[at] + self.unknown
                    if best[at + 1] is None or got > best[at + 1]:
                        best[at + 1], count[at + 1] = got, count[at] + len(text[at].encode("utf-8"))
                at += 1

        for last, (size, score) in self.pieces.iter(text):  # by end, the longest first
            close(last)
            start = last + 1 - size
            got = best[start] + score
            if best[last + 1] is None or got > best[last + 1]:
                best[last + 1], count[last + 1] = got, count[start] + 1
            if size == 1:
                single[last] = True
        close(n)
        return count[n], best[n]

    def __call__(self, text: bytes | None) -> tuple[int, float]:
        words = (text or b"").split()
        new = set(words).difference(self.count)
        if new:
            if len(self.count) + len(new) > self.LIMIT:
                self.count.clear()
                self.score.clear()
                new = set(words)
            for word in new:
                self.count[word], self.score[word] = self.viterbi(MARK + word.decode("utf-8"))
        return sum(map(self.count.__getitem__, words)), float(sum(map(self.score.__getitem__, words)))


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """The worker's counter for that file."""
    return UnigramCounter(vocabulary(path))


def token_counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score for every row."""

    def make(batch: pa.RecordBatch):
        found = [counter(path)(t) for t in raw_texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [n for n, _ in found], "score": [s for _, s in found]}

    return per_batch(id_text(df), make, "doc_id long, n_tokens long, score double")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary())
