"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadloom.llm.common import PieceCache, only, slices, table, utf8_buffer, vocabulary

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: A piece's log probability by its rank r in the file: Zipf-Mandelbrot, -log(r + SHIFT), in units of 1 / SCALE.
SHIFT, SCALE = 2.7, 1_000_000
#: Each byte of a character outside the vocabulary is one token and scores this much below the rarest piece.
BYTE_PENALTY = 10.0
#: Trie nodes and counts kept by a process; emptied beyond, which changes no result.
MOST_NODES, MOST_COUNTS = 600_000, 300_000

_counters: dict[int, PieceCache] = {}


def piece_scores(raw: bytes) -> tuple[dict[str, int], int]:
    """Fixed-point score of each normal piece of a sentencepiece file, and that of one fallback byte.

    The file's own scores are merge ranks, not probabilities; a unigram model is set on the same pieces by a law
    of their rank alone, so nothing is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    scores = {model.id_to_piece(i): -round(SCALE * math.log(r + SHIFT)) for r, i in enumerate(ids)}
    return scores, min(scores.values(), default=0) - round(SCALE * BYTE_PENALTY)


class Pieces:
    """Which pieces end at a place: an automaton over the vocabulary, its states made when first reached.

    A state is the longest suffix of what was read that begins a piece: (suffix, next states by character, (length,
    score) of the pieces that end here). States are at most the beginnings of pieces, whatever is read.
    """

    def __init__(self, scores: dict[str, int]) -> None:
        self.scores = scores
        self.begins = {p[:i] for p in scores for i in range(len(p) + 1)} | {""}
        self.states: dict[str, tuple] = {}
        self.start = self.state("")

    def state(self, suffix: str) -> tuple:
        if suffix not in self.states:
            ways = tuple((len(suffix) - i, self.scores[suffix[i:]]) for i in range(len(suffix)) if suffix[i:] in self.scores)
            self.states[suffix] = (suffix, {}, ways)
        return self.states[suffix]

    def step(self, state: tuple, char: str) -> tuple:
        suffix = state[0] + char
        while suffix not in self.begins:
            suffix = suffix[1:]
        state[1][char] = after = self.state(suffix)
        return after


class UnigramTrie:
    """Distinct pre-tokens share the forward pass of their common prefixes.

    A node stands for a prefix: its children, the best score of a segmentation of it, that one's fewest tokens
    (negative), and the automaton's state. A node is scored once, when it is inserted, from the nodes above it; the
    counts at a word's last node are the word's.
    """

    def __init__(self, scores: dict[str, int], byte_score: int) -> None:
        self.pieces, self.byte_score = Pieces(scores), byte_score
        self.clear()

    def clear(self) -> None:
        self.nodes, self.root = 1, ({}, 0, 0, self.pieces.start)

    def insert(self, word: str) -> tuple[int, int]:
        """Best score of the word, and the fewest tokens with it."""
        if self.nodes > MOST_NODES:
            self.clear()
        node = self.root
        path = [node]
        push = path.append
        for char in word:
            below = node[0].get(char)
            if below is None:
                state = node[3]
                state = state[1].get(char) or self.pieces.step(state, char)
                score = None
                for length, piece in state[2]:
                    above = path[-length]
                    way = above[1] + piece
                    if score is None or way > score or (way == score and above[2] > more):
                        score, more = way, above[2]
                tokens = 0 if score is None else more - 1
                if score is None or state[2][-1][0] > 1:  # the character is no piece
                    n = len(char.encode())
                    way = node[1] + n * self.byte_score
                    if score is None or way > score or (way == score and node[2] - n > tokens):
                        score, tokens = way, node[2] - n
                below = node[0][char] = ({}, score, tokens, state)
                self.nodes += 1
            push(below)
            node = below
        return node[1], -node[2]


def counter(raw: bytes) -> PieceCache:
    """Score and tokens (two int64) of pre-tokens without white space, each marked as a word's start."""
    if hash(raw) not in _counters:
        trie = UnigramTrie(*piece_scores(raw))

        def many(words: list[bytes]) -> list[bytes]:
            # in order, so that a batch's words with a common prefix meet before the trie is emptied; nodes hold no
            # cycles, so the collector, which would walk all of them again and again, has nothing to find
            gc.disable()
            try:
                found = [x for w in words for x in trie.insert(MARK + w.decode())]
            finally:
                gc.freeze()
                gc.enable()
            blob = np.array(found, np.int64).tobytes()
            return [blob[i : i + 16] for i in range(0, len(blob), 16)]

        _counters[hash(raw)] = PieceCache(many, MOST_COUNTS, ordered=True)
    return _counters[hash(raw)]


def count_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_tokens and score (sum of log probabilities times SCALE) of every whole text.

    Pre-tokens are runs without ASCII white space. Of segmentations with the best score that with fewest tokens
    counts. A null or blank text has 0 of each; repeated rows and null ids are kept; an empty table stays empty;
    other columns are not read. Nothing is shuffled: each task adds up the counts its trie gives.
    """
    raw = vocabulary(docs.sparkSession, model_path or public_tokenizers.path(PIECES))

    def run(batches):
        cache = counter(raw.value)
        for batch in batches:
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 4 << 20):
                texts = [data[at[i] : at[i + 1]].tobytes().split() for i in range(lo, hi)]
                flat, ends = cache.ids(texts)
                sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(flat.view(np.int64).reshape(-1, 2), axis=0)])
                score, tokens = np.diff(sums[ends // 4], axis=0).T
                words = np.array([len(x) for x in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(tokens), pa.array(score)], names=[id_col, "n_pretokens", "n_tokens", "score"])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, n_pretokens long, n_tokens long, score long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
