"""Dictionary phrases in token streams, and rules for overlapping spans."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def _grams(toks: str, sizes: list[int], each) -> Column:
    """An array with each(n, start, phrase) of all n-grams of a token column."""

    def of_size(n: int) -> Column:
        firsts = F.slice(toks, 1, F.greatest(F.size(toks) - (n - 1), F.lit(0)))
        return F.transform(firsts, lambda w, i: each(F.lit(n), i + 1, F.concat_ws(" ", w, *(F.get(toks, i + k) for k in range(1, n)))))

    return F.concat(*map(of_size, sizes))


def ngrams(rows: DataFrame, keys: list[str], toks: str, sizes: list[int]) -> DataFrame:
    """(keys, n, start, phrase): all n-grams of a token column, start from 1."""
    one = lambda n, i, phrase: F.struct(n.alias("n"), i.alias("start"), phrase.alias("phrase"))
    return rows.select(*keys, F.explode(_grams(toks, sizes, one)).alias("g")).select(*keys, "g.*")


def phrase_dictionary(texts: DataFrame, sizes: list[int], at_least: int) -> DataFrame:
    """(phrase, n_texts): every n-gram found in so many texts (key, toks) or more.

    Each text gives its distinct n-grams, so that one long text counts once; sums are taken in each task before the shuffle.
    """
    seen = texts.select(F.explode(F.array_distinct(_grams("toks", sizes, lambda _, __, phrase: phrase))).alias("phrase"))
    return seen.groupBy("phrase").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") >= at_least)


def gazetteer(rows: DataFrame, keys: list[str], toks: str, phrases: DataFrame, sizes: list[int]) -> DataFrame:
    """(keys, phrase, start, end): every place where a phrase of the dictionary stands on token boundaries; end exclusive.

    The dictionary may be of any size: it is a table that meets the distinct n-grams of the rows.
    """
    # the n-grams of a small file are many: without the hint their estimated size would have them broadcast
    hits = ngrams(rows, keys, toks, sizes).join(phrases.select("phrase").hint("merge"), "phrase")
    return hits.select(*keys, "phrase", "start", (F.col("start") + F.col("n")).alias("end"))


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, start, end, _s, _e) of different spans of a text that share a token, the earlier or, of the same start, shorter one first.

    The first span is looked for at the places that it covers, the other at its start alone, so each pair is found once.
    """
    one = spans.select(*keys, "start", "end").distinct()
    other = one.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("start").alias("_at"))
    places = one.withColumn("_at", F.explode(F.sequence("start", F.col("end") - 1)))
    pairs = places.join(other, [*keys, "_at"]).where("start < _s OR (start = _s AND end < _e)")
    return pairs.select(*keys, "start", "end", "_s", "_e")


def _marked_inside(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with _inside: whether each lies within a longer one of its text.

    A longer span around it starts before it, or with it and ends later, and ends no earlier; so the furthest end of the distinct
    spans before it in the order of start and falling end tells, and nothing is paired. Spans given twice are peers and don't count.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    before = Window.partitionBy(*keys).orderBy("_nth").rangeBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_nth", F.dense_rank().over(order)).withColumn("_inside", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))).drop("_nth")


def inside_another(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) of spans within a longer one."""
    return _marked_inside(spans.select(*keys, "start", "end").distinct(), keys).where("_inside").drop("_inside")


def without_subsets(spans: DataFrame, keys: list[str]) -> DataFrame:
    return _marked_inside(spans, keys).where("NOT _inside").select(spans.columns)


def longest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap no longer one."""
    pairs = overlapping(spans, keys).withColumn("_more", (F.col("_e") - F.col("_s")) - (F.col("end") - F.col("start")))
    loser = F.when(F.col("_more") > 0, F.struct("start", "end")).when(F.col("_more") < 0, F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))
    beaten = pairs.select(*keys, loser.alias("_l")).where("_l IS NOT NULL").select(*keys, "_l.*").distinct()
    return spans.join(beaten, [*keys, "start", "end"], "left_anti").select(spans.columns)


def overlap_groups(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_group`: spans of a text that hang together over overlaps get one number."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_opens", F.when(F.coalesce(F.col("start") < before, F.lit(False)), 0).otherwise(1))
    return opens.withColumn("_group", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def greedy(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans left after dropping, again and again, the one with most overlaps; of several the shorter, then the later one.

    Only spans that hang together compete, so the choice is made for each such group; spans without overlap stay
    as they are and never leave Spark. Groups go to Python as arrays, many in a batch; within a group the numbers of overlaps are kept
    in a heap and corrected for a dropped span's neighbours alone.
    """
    own = [c for c in spans.columns if c not in (*keys, "start", "end")]
    item = F.struct("start", "end", *own)
    groups = overlap_groups(spans, keys).groupBy(*keys, "_group").agg(F.array_sort(F.collect_list(item)).alias("_spans"))

    @F.pandas_udf("array<boolean>")
    def kept(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_survivors(s, e) for s, e in zip(starts, ends, strict=True)])

    several = groups.where(F.size("_spans") > 1)
    several = several.withColumn("_kept", kept(F.col("_spans")["start"], F.col("_spans")["end"]))
    several = several.select(*keys, F.explode(F.arrays_zip(F.col("_spans").alias("x"), F.col("_kept").alias("k"))).alias("_z")).where("_z.k").select(*keys, "_z.x.*")
    one = groups.where(F.size("_spans") == 1).select(*keys, F.col("_spans")[0].alias("_x")).select(*keys, "_x.*")
    return one.union(several).select(spans.columns)


def _survivors(starts, ends) -> list[bool]:
    """Which spans of a group, in the order of start and end, greedy() keeps."""
    s, e = [int(x) for x in starts], [int(x) for x in ends]
    meets: list[list[int]] = [[] for _ in s]
    open_: list[int] = []
    for i in range(len(s)):
        open_ = [j for j in open_ if e[j] > s[i]]
        for j in open_:
            meets[i].append(j)
            meets[j].append(i)
        open_.append(i)
    n, left = [len(m) for m in meets], [True] * len(s)
    heap = [(-n[i], e[i] - s[i], -s[i], i) for i in range(len(s)) if n[i]]
    heapq.heapify(heap)
    while heap:
        k, _, _, i = heapq.heappop(heap)
        if not left[i] or -k != n[i] or not n[i]:
            continue
        left[i] = False
        for j in meets[i]:
            if left[j]:
                n[j] -= 1
                if n[j]:
                    heapq.heappush(heap, (-n[j], e[j] - s[j], -s[j], j))
    return left


def _places(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("_at")).distinct()


def reconciled(phrases: DataFrame, words: DataFrame, tagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, source): one set of mentions from three sources of spans (keys, start, end).

    Dictionary phrases of several words come first; recognised single words count outside of them; what a tagger found counts
    only where it touches no phrase and covers a word that isn't recognised.
    """
    span = lambda rows, source: rows.select(*keys, "start", "end", F.lit(source).alias("source")).distinct()
    taken, known = _places(phrases, keys), _places(words, keys)
    single = span(words, "word").withColumn("_at", F.col("start")).join(taken, [*keys, "_at"], "left_anti").drop("_at")
    places = span(tagged, "tagger").withColumn("_at", F.explode(F.sequence("start", F.col("end") - 1)))
    touching = places.join(taken, [*keys, "_at"], "left_semi").select(*keys, "start", "end").distinct()
    new = places.join(known, [*keys, "_at"], "left_anti").select(*keys, "start", "end", "source").distinct()
    return span(phrases, "phrase").unionByName(single).unionByName(new.join(touching, [*keys, "start", "end"], "left_anti").select(*keys, "start", "end", "source"))


def first_by_rank(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of hits on the same span the one with the smallest rank."""
    best = Window.partitionBy(*keys, "start", "end").orderBy("rank", "phrase")
    return hits.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def sections(rows: DataFrame, by: list[str], order: str, mark: str) -> DataFrame:
    """rows with depth, section and closed: where each lies between start (mark 1) and end markers (mark -1), other rows having mark 0.

    Depth counts the open starts after the row; an end without an open start is nothing. A section runs from a start at depth 1
    to the end that brings the depth back to 0, nested ones included, and is numbered from 1 within `by`; rows outside have a null
    section. closed: whether the section has its end; one that lacks it runs to the last row. Null marks count as 0.
    """
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.coalesce(F.signum(F.col(mark)).cast("long"), F.lit(0))
    out = rows.withColumn("_sum", F.sum(sign).over(so_far)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(so_far)))
    out = out.withColumn("depth", F.col("_sum") - F.col("_low"))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy(*by).orderBy(order)), F.lit(0))
    out = out.withColumn("_before", before).withColumn("_n", F.sum(F.when((F.col("_before") == 0) & (F.col("depth") == 1), 1).otherwise(0)).over(so_far))
    out = out.withColumn("section", F.when((F.col("depth") > 0) | (F.col("_before") > 0), F.col("_n")))
    ended = F.max((F.col("_before") > 0) & (F.col("depth") == 0)).over(Window.partitionBy(*by, "section"))
    return out.withColumn("closed", F.when(F.col("section").isNotNull(), ended)).drop("_sum", "_low", "_before", "_n")
