"""Dictionary phrases of any number of words in token streams, found by walking tries that are kept in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.sources.staging import staged

#: Words of phrases in one trie; it takes some 100 bytes a word.
TRIE_TOKENS = 4_000_000
#: Words of text that one task walks, so that sending it a trie costs about as much as sending it the text.
TASK_TOKENS = 8_000_000
#: Places of a text that travel together; longer texts are cut, with the words that a phrase may need beyond the cut.
PIECE = 1_000
#: Words that are walked at once.
CHUNK = 1_000_000


def expression_dictionary(quads: DataFrame, expr: str = "expr") -> DataFrame:
    """(graph_id, phrase, concept): expressions that a tagger by words would miss, from facts ('"Name of It"', 'expr', concept).

    Those of several words, with an apostrophe or with a hyphen, in lower case, without quotes and with single spaces;
    each with every concept it stands for.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace("s", '"', "")), r"\s+", " "))
    found = quads.where(F.col("t") == expr).where("o IS NOT NULL").select("graph_id", plain.alias("phrase"), F.col("o").alias("concept"))
    return found.where(F.col("phrase").rlike("[ '-]")).distinct()


class Trie:
    """keys[i] = parent * width + word is the edge to node i + 1, in ascending order; phrase[n] is the phrase that ends at node n, or -1.

    Nodes are numbered level by level, so that edges sort by parent, and a step of many walks is one binary search.
    """

    def __init__(self, phrases: pa.Array):
        words = phrases.flatten().dictionary_encode()
        self.ids = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        self.width, self.text = max(len(self.ids), 1), pc.binary_join(phrases, " ")
        code, size = words.indices.to_numpy(), phrases.value_lengths().to_numpy()
        first, node, keys, made = np.cumsum(size) - size, np.zeros(len(size), np.int64), [np.zeros(0, np.int64)], 0
        for depth in range(size.max(initial=0)):
            on = np.flatnonzero(size > depth)
            edges, place = np.unique(node[on] * self.width + code[first[on] + depth], return_inverse=True)
            node[on] = made + 1 + place
            keys.append(edges)
            made += len(edges)
        self.keys, self.phrase = np.concatenate(keys), np.full(made + 1, -1)
        self.phrase[node] = np.arange(len(size))

    def walk(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(text, place, n words, phrase) of all hits, by n; a place whose words leave the trie is dropped from the next step."""
        words = texts.flatten().dictionary_encode()
        known = np.array([self.ids.get(w, -1) for w in words.dictionary.to_pylist()] + [-1])  # a null word is none
        code = known[words.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        size = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        text, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
        first = ends - size
        at, node, n = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        while len(at) and len(self.keys):
            on = at + n < ends[text[at]]
            at, node = at[on], node[on]
            word = code[at + n]
            key = node * self.width + word
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (word >= 0) & (self.keys[edge] == key)
            at, node, n = at[on], edge[on] + 1, n + 1
            hit = at[self.phrase[node] >= 0]
            if len(hit):
                yield text[hit], hit - first[text[hit]], n, self.phrase[node[self.phrase[node] >= 0]]


def _walked(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Hits of a partition's rows, which come sorted: a shard's phrases (kind 0), then the pieces of text (kind 1) that meet them."""
    stored, trie, of = [], None, None
    for batch in batches:
        runs = pd.DataFrame({"pid": batch["pid"].to_numpy(), "kind": batch["kind"].to_numpy()})
        starts = np.flatnonzero((runs != runs.shift()).any(axis=1))
        for low, high in zip(starts, [*starts[1:], len(runs)]):
            rows, (pid, kind) = batch.slice(low, high - low), runs.iloc[low]
            if pid != of:
                stored, trie, of = [], None, pid
            if kind == 0:
                stored.append(rows["toks"])
                continue
            if trie is None and stored:
                trie, stored = Trie(pa.concat_arrays(stored)), []
            if trie is None:
                continue
            size = np.cumsum(rows["toks"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // CHUNK
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1):
                piece = rows.slice(part[0], len(part))
                shift = piece["at"].to_numpy()
                for text, place, n, phrase in trie.walk(piece["toks"]):
                    own = place < step
                    text, begin = text[own], (place[own] + shift[text[own]] + 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([piece["k"].take(pa.array(text)), trie.text.take(pa.array(phrase[own])), pa.array(begin), pa.array(begin + np.int32(n))], ["k", "phrase", "start", "end"])


def find_phrases(rows: DataFrame, keys: list[str], toks: str, phrases: DataFrame, trie_tokens: int = TRIE_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(keys, phrase, start, end): every place where a phrase stands on token boundaries; start from 1, end exclusive.

    The same hits as gazetteer(), for phrases of any and mixed lengths: the work at a place ends with the longest
    beginning of a phrase there, however many lengths there are. Phrases (column phrase, words parted by white space)
    are dealt by their hash to tries of at most about trie_tokens words, texts in pieces to tasks of about task_tokens;
    each task gets one trie's phrases before the pieces that meet it, so that it holds one trie and a batch.
    Neither a frequent first word nor a long text nor repeated rows make a task larger than others.

    Null or empty phrases and texts give nothing, a null token is no word; a phrase given twice counts once, and of
    rows with equal keys each gives its own hits. Keys need other names than the three new columns.
    """
    words = F.filter(F.split("phrase", r"\s+"), lambda w: w != "")
    known = staged(phrases.select(words.alias("toks")).where(F.size("toks") > 0).distinct())
    n_words, longest = known.agg(F.sum(F.size("toks")), F.max(F.size("toks"))).first()
    n_tokens = rows.agg(F.sum(F.greatest(F.size(toks), F.lit(0)))).first()[0]
    step, shards = max(PIECE, longest or 1), -(-(n_words or 1) // trie_tokens)
    deals = -(-max(n_tokens or 0, 1) // task_tokens)
    deal = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    table = known.withColumn("shard", F.pmod(F.xxhash64("toks"), F.lit(shards)).cast("int")).withColumn("_deal", deal(deals))
    empty = rows.select(F.struct(*keys).alias("k")).schema["k"].dataType
    table = table.select((F.col("_deal") * shards + F.col("shard")).alias("pid"), F.lit(0).alias("kind"), F.lit(None).cast(empty).alias("k"), "toks", F.lit(0).alias("at"))
    text = rows.select(F.struct(*keys).alias("k"), F.col(toks).alias("toks")).where(F.size("toks") > 0)
    text = text.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("toks") - 1, F.lit(step))))
    text = text.withColumn("_deal", F.pmod(F.xxhash64("k", "at", F.spark_partition_id()), F.lit(deals)).cast("int")).withColumn("shard", deal(shards))
    text = text.select((F.col("_deal") * shards + F.col("shard")).alias("pid"), F.lit(1).alias("kind"), "k", F.slice("toks", F.col("at") + 1, step + (longest or 1) - 1).alias("toks"), "at")
    met = table.union(text).repartitionById(deals * shards, F.col("pid")).sortWithinPartitions("pid", "kind")
    out = rows.select(F.struct(*keys).alias("k")).schema.add("phrase", "string").add("start", "integer").add("end", "integer")
    return met.mapInArrow(lambda batches: _walked(batches, step), out).select("k.*", "phrase", "start", "end")
