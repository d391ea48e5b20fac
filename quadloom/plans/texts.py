"""Dictionary tagging and text functions over conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions import text as fn
from quadloom.operators import mentions as placed
from quadloom.operators import parse, phrases, ranking, spans
from quadloom.operators.closure import types
from quadloom.operators.match import match
from quadloom.plans.registry import query
from quadloom.sources.graphs import star_graph
from quadloom.sources.staging import spread, staged

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")
SIZES = [2, 3]

_TOK = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"
_GRAMS = """g AS (SELECT key, 2 AS n, i AS start, concat(toks[i], ' ', toks[i + 1]) AS phrase FROM {src}, unnest(range(1, len(toks))) AS u(i)
UNION ALL SELECT key, 3, i, concat(toks[i], ' ', toks[i + 1], ' ', toks[i + 2]) FROM {src}, unnest(range(1, len(toks) - 1)) AS u(i))"""
_DICT = f"""src AS (SELECT concat('b', item_id) AS key, {_TOK} AS toks FROM benchmark UNION ALL SELECT concat('d', doc_id), {_TOK} FROM documents),
{_GRAMS.format(src='src')}, dict AS (SELECT phrase, CAST(count(DISTINCT key) AS BIGINT) AS n_texts FROM g GROUP BY phrase HAVING count(DISTINCT key) >= 5)"""
_HITS = f"""{_DICT}, turns AS (SELECT concat(conv_id, '_', turn) AS key, {_TOK} AS toks FROM conversations), {_GRAMS.format(src='turns').replace('g AS', 'h AS', 1)},
hits AS (SELECT h.key, h.phrase, CAST(h.start AS INTEGER) AS "start", CAST(h.start + h.n AS INTEGER) AS "end" FROM h JOIN dict USING (phrase))"""


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    texts = _read(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), spans.tokens(F.col("text")).alias("toks"))
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), "doc_id").alias("key"), spans.tokens(F.col("text")).alias("toks"))
    return spans.phrase_dictionary(texts.union(docs), SIZES, 5)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "conversations").select("conv_id", "turn", "text")).select(F.concat_ws("_", "conv_id", "turn").alias("key"), spans.tokens(F.col("text")).alias("toks"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return spans.gazetteer(_turns(spark, d), ["key"], "toks", dictionary(spark, d), SIZES)


@query("phrase_dict", f"WITH {_DICT} SELECT phrase, n_texts FROM dict")
def phrase_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir)


@query("gazetteer", f"WITH {_HITS} SELECT * FROM hits")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query("expression_dict", "SELECT DISTINCT graph_id, lower(replace(s, '\"', '')) AS phrase, o AS concept FROM quads WHERE t = 'expr' AND regexp_matches(s, '[ ''-]')", "star")
def expression_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.expression_dictionary(star_graph(spark, sf_dir))


def _runs(src: str, key: str) -> str:
    """SQL of all runs of two to eight words: each word beside the seven that follow."""
    after = ", ".join(f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY i) AS w{k}" for k in range(1, 8))
    runs = " UNION ALL ".join(f"SELECT {key}, i, {n} AS n, " + " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))]) + f" AS phrase FROM {src}_w" for n in range(2, 9))
    return f"{src}_t AS (SELECT {key}, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS w FROM {src}), {src}_w AS (SELECT *, {after} FROM {src}_t), {src}_r AS ({runs})"


@query("expression_hits", f"""
WITH b AS (SELECT item_id, {_TOK} AS toks FROM benchmark), d AS (SELECT doc_id, {_TOK} AS toks FROM documents), {_runs("b", "item_id")}, {_runs("d", "doc_id")},
e AS (SELECT DISTINCT phrase FROM b_r WHERE phrase IS NOT NULL)
SELECT doc_id, phrase, CAST(i AS INTEGER) AS "start", CAST(i + n AS INTEGER) AS "end" FROM d_r JOIN e USING (phrase)""")
def expression_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places in the documents where expressions of two to eight words stand; the expressions are facts about the benchmark's texts."""
    runs = spans.ngrams(_read(spark, sf_dir, "benchmark").select("item_id", spans.tokens(F.col("text")).alias("toks")), ["item_id"], "toks", list(range(1, 9)))
    quote = F.concat(F.lit('"'), "phrase", F.lit('"'))
    facts = runs.select(F.lit("g").alias("graph_id"), quote.alias("s"), F.lit("expr").alias("t"), F.concat(F.lit("b:"), "item_id").alias("o"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", spans.tokens(F.col("text")).alias("toks"))
    return phrases.find_phrases(docs, ["doc_id"], "toks", phrases.expression_dictionary(facts))


@query("no_subsets", f"WITH {_HITS} SELECT * FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.key = a.key AND b.\"start\" <= a.\"start\" AND a.\"end\" <= b.\"end\" AND b.\"end\" - b.\"start\" > a.\"end\" - a.\"start\")")
def no_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_subsets(hits(spark, sf_dir), ["key"])


@query("longest_match", f"WITH {_HITS} SELECT * FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.key = a.key AND b.\"start\" < a.\"end\" AND a.\"start\" < b.\"end\" AND b.\"end\" - b.\"start\" > a.\"end\" - a.\"start\")")
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.longest(staged(hits(spark, sf_dir)), ["key"])


@query("span_overlap", f"WITH {_HITS}, s AS (SELECT DISTINCT key, \"start\", \"end\" FROM hits) SELECT a.key, CAST(count(*) AS BIGINT) AS n FROM s a JOIN s b ON a.key = b.key AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\" AND (a.\"start\" < b.\"start\" OR (a.\"start\" = b.\"start\" AND a.\"end\" < b.\"end\")) GROUP BY a.key")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlapping(staged(hits(spark, sf_dir).select("key", "start", "end").distinct()), ["key"]).groupBy("key").agg(F.count("*").alias("n"))


@query("span_contains", f"WITH {_HITS}, s AS (SELECT DISTINCT key, \"start\", \"end\" FROM hits) SELECT DISTINCT a.key, a.\"start\", a.\"end\" FROM s a JOIN s b ON a.key = b.key AND b.\"start\" <= a.\"start\" AND a.\"end\" <= b.\"end\" AND b.\"end\" - b.\"start\" > a.\"end\" - a.\"start\"")
def span_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.inside_another(hits(spark, sf_dir), ["key"])


@query("precede", f"WITH {_HITS}, f AS (SELECT key, phrase, min(\"start\") AS first, max(\"start\") AS last FROM hits GROUP BY key, phrase) SELECT a.key, a.phrase AS a, b.phrase AS b FROM f a JOIN f b ON a.key = b.key AND a.phrase <> b.phrase AND a.first <= b.last")
def precede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a turn's phrases of which one stands, somewhere, no later than the other, however far apart."""
    f = staged(hits(spark, sf_dir).groupBy("key", "phrase").agg(F.min("start").alias("first"), F.max("start").alias("last")))
    one, other = f.select("key", F.col("phrase").alias("a"), "first"), f.select("key", F.col("phrase").alias("b"), "last")
    return one.join(other, "key").where("a <> b AND first <= last").select("key", "a", "b")


@query("greedy_spans")
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.greedy(hits(spark, sf_dir).select("key", "start", "end").distinct(), ["key"])


_LEMMAS = _GRAMS.format(src="lem").replace("g AS", "lg AS", 1)


@query("surface_first", f"WITH {_HITS}, lem AS (SELECT key, list_transform(toks, lambda x: regexp_replace(x, '(..)s$', '\\1')) AS toks FROM turns), {_LEMMAS}, r AS (SELECT key, \"start\", \"end\", phrase, 0 AS rank FROM hits UNION ALL SELECT key, CAST(lg.start AS INTEGER), CAST(lg.start + lg.n AS INTEGER), phrase, 1 FROM lg JOIN dict USING (phrase)) SELECT key, \"start\", \"end\", phrase FROM r QUALIFY row_number() OVER (PARTITION BY key, \"start\", \"end\" ORDER BY rank, phrase) = 1")
def surface_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by their surface forms, and where there is none by the words without a plural s."""
    lemmas = F.transform("toks", lambda x: F.regexp_replace(x, "(..)s$", "$1"))
    both = F.array(F.struct(F.lit(0).alias("rank"), F.col("toks")), F.struct(F.lit(1).alias("rank"), lemmas.alias("toks")))
    forms = _turns(spark, sf_dir).select("key", F.explode(both).alias("f")).select("key", "f.*")
    found = spans.gazetteer(forms, ["key", "rank"], "toks", dictionary(spark, sf_dir), SIZES)
    return spans.first_by_rank(found, ["key"]).select("key", "start", "end", "phrase")


@query("mentions", f"WITH {_HITS}, m AS (SELECT DISTINCT key, phrase, \"start\" FROM hits) SELECT concat(phrase, '@', key, '#', \"start\") AS mention, phrase AS t FROM m")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).select("key", "phrase", "start").distinct()
    return found.select(F.concat("phrase", F.lit("@"), "key", F.lit("#"), F.col("start").cast("string")).alias("mention"), F.col("phrase").alias("t"))


@query("mention_instances", f"""WITH {_HITS}, m AS (SELECT DISTINCT key, phrase, "start", "end", concat('ph:', phrase) AS concept, phrase IN (SELECT phrase FROM g WHERE key LIKE 'b%') AS known FROM hits),
n AS (SELECT *, row_number() OVER (ORDER BY key, "start", "end", concept) + (SELECT max(conv_id) FROM conversations) AS k FROM m WHERE NOT known),
a AS (SELECT key, "start", "end", concept, concept AS node, false AS fresh FROM m WHERE known UNION ALL SELECT key, "start", "end", concept, concat('m_', k), true FROM n)
SELECT concat(key, '_', "start", '_', "end") AS graph_id, node AS s, 'type' AS t, concept AS o FROM a WHERE fresh UNION ALL SELECT concat(key, '_', "start", '_', "end"), node, 'focus', NULL FROM a UNION ALL SELECT concat(key, '_', "start", '_', "end"), concept, 'center', NULL FROM a""")
def mention_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about the phrases in conversations: those of the benchmark are known things, others are classes; the conversations' own nodes m_<id> are in use."""
    found = staged(hits(spark, sf_dir))
    concept = F.concat(F.lit("ph:"), "phrase").alias("concept")
    known = spans.ngrams(_read(spark, sf_dir, "benchmark").select("item_id", spans.tokens(F.col("text")).alias("toks")), ["item_id"], "toks", SIZES)
    used = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("m_"), "conv_id").alias("id"))
    nodes = placed.instantiated(found, ["key"], found.select("phrase", concept), known.select(concept), "m_", used)
    return placed.mention_facts(nodes, ["key"]).select("graph_id", "s", "t", "o")


@query("reconcile_mentions", f"""WITH {_HITS}, l AS (SELECT DISTINCT key, "start", "end" FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.key = a.key AND b."start" < a."end" AND a."start" < b."end" AND b."end" - b."start" > a."end" - a."start")),
v AS (SELECT DISTINCT unnest({_TOK}) AS w FROM benchmark), c AS (SELECT concat(conv_id, '_', turn) AS key, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS ws FROM conversations),
t AS (SELECT key, CAST(i AS INTEGER) AS i, ws[i] AS w FROM c, unnest(range(1, len(ws) + 1)) AS u(i)), f AS (SELECT t.key, t.i, t.w, v.w IS NOT NULL AS known FROM t LEFT JOIN v ON v.w = lower(t.w) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.key = t.key AND l."start" <= t.i AND t.i < l."end"))
SELECT key, "start", "end", 'phrase' AS source FROM l UNION ALL SELECT key, i, i + 1, 'word' FROM f WHERE known UNION ALL SELECT key, i, i + 1, 'tagger' FROM f WHERE NOT known AND regexp_matches(w, '^[A-Z]')""")
def reconcile_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary phrases, words of the benchmark texts, and capitalised words as a tagger's finds."""
    words = _read(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("key"), F.posexplode(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")).alias("i", "w"))
    words = words.select("key", (F.col("i") + 1).alias("start"), (F.col("i") + 2).alias("end"), "w")
    known = _read(spark, sf_dir, "benchmark").select(F.explode(spans.tokens(F.col("text"))).alias("_w")).distinct()
    single = words.join(known, F.lower("w") == F.col("_w"), "left_semi")
    return spans.reconciled(spans.longest(staged(hits(spark, sf_dir)), ["key"]), single, words.where(F.col("w").rlike("^[A-Z]")), ["key"])


@query("ingest_arcs", f"""
WITH t AS (SELECT concat(conv_id, '_', turn) AS key, {_TOK} AS toks FROM conversations), w AS (SELECT key, i, toks[i] AS tok FROM t, unnest(range(1, len(toks) + 1)) AS u(i))
SELECT CASE WHEN i = 1 THEN concat(key, '#1') ELSE concat(key, '#', i - 1) END AS s, CASE WHEN i = 1 THEN 'assert' ELSE 'dep' END AS t, CASE WHEN i = 1 THEN NULL ELSE concat(key, '#', i) END AS o FROM w""")
def ingest_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token is a node that hangs on the one before; a text's first token is asserted."""
    toks = _turns(spark, sf_dir).select("key", F.posexplode("toks").alias("i", "tok"))
    node = lambda i: F.concat("key", F.lit("#"), i.cast("string"))
    first = F.col("i") == 0
    return toks.select(F.when(first, node(F.col("i") + 1)).otherwise(node(F.col("i"))).alias("s"), F.when(first, "assert").otherwise("dep").alias("t"), F.when(~first, node(F.col("i") + 1)).alias("o"))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TAG_OF = " ".join(f"WHEN w IN ({_in(of)}) THEN '{t}'" for t, of in reversed(parse.WORDS.items()))
_BACK, _ON = "(PARTITION BY key, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(PARTITION BY key, n ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_ABOVE = ", ".join(f"('{k}', '{v}')" for k, v in [*parse.KINDS.items(), *((k, parse.KINDS[v]) for k, v in parse.KINDS.items() if v in parse.KINDS)])
_PARSE = f"""s AS (SELECT concat(conv_id, '_', turn) AS key, unnest(range(1, len(string_split_regex(text, '[.!?\\n]+')) + 1)) AS n, unnest(string_split_regex(text, '[.!?\\n]+')) AS text FROM conversations),
tk AS (SELECT key, n, {_TOK} AS toks FROM s), w0 AS (SELECT key, n, unnest(range(1, len(toks) + 1)) AS j, unnest(toks) AS w FROM tk),
w1 AS (SELECT key, n, w, row_number() OVER (PARTITION BY key ORDER BY n, j) AS i, CASE {_TAG_OF} WHEN regexp_matches(w, '{parse.VERB}') THEN 'vb' ELSE 'nn' END AS tag FROM w0),
w2 AS (SELECT *, coalesce(min(CASE WHEN tag IN ('vb', 'md') THEN i END) OVER (PARTITION BY key, n), min(CASE WHEN tag = 'nn' THEN i END) OVER (PARTITION BY key, n), min(i) OVER (PARTITION BY key, n)) AS r,
 max(CASE WHEN tag IN ('vb', 'nn') THEN i END) OVER {_BACK} AS p, min(CASE WHEN tag IN ('vb', 'nn') THEN i END) OVER {_ON} AS nx, max(CASE WHEN tag <> 'dt' THEN i END) OVER {_BACK} AS q FROM w1),
w3 AS (SELECT a.*, b.tag AS qt FROM w2 a LEFT JOIN w1 b ON b.key = a.key AND b.i = a.q),
arc AS (SELECT key, i, CASE WHEN i = r THEN NULL WHEN tag IN ('dt', 'md') THEN coalesce(nx, r) WHEN tag IN ('in', 'cc') THEN coalesce(p, r) WHEN qt = 'in' THEN q WHEN qt = 'cc' THEN coalesce(p, r) ELSE r END AS head,
 CASE WHEN i = r THEN 'root' WHEN tag = 'dt' THEN 'det' WHEN tag = 'md' THEN 'aux' WHEN tag = 'in' THEN 'case' WHEN tag = 'cc' THEN 'coord' WHEN qt = 'in' THEN 'pobj' WHEN qt = 'cc' THEN 'conj' WHEN i < r THEN 'nsbj' ELSE 'obj' END AS label FROM w3)"""


def _sketch(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and arcs of all turns, each turn a graph, by the rule of parse.sketched()."""
    said = _read(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("graph_id"), F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "text"))
    words = said.select("graph_id", "sentence", F.posexplode(spans.tokens(F.col("text"))).alias("j", "word"))
    words = words.withColumn("i", F.row_number().over(Window.partitionBy("graph_id").orderBy("sentence", "j")))
    return staged(parse.sketched(words))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    parsed = _sketch(spark, d)
    kinds = spark.createDataFrame(list(parse.KINDS.items()), "kind string, sup string")
    return parse.parse_facts(parsed, parsed, kinds)


@query("ingest_parse", f"""WITH {_PARSE}, above(c, sup) AS (VALUES {_ABOVE}), c AS (SELECT DISTINCT key, tag AS c FROM w1 UNION SELECT DISTINCT key, label FROM arc WHERE head IS NOT NULL)
SELECT key AS graph_id, concat(key, '#', i) AS s, 'type' AS t, tag AS o FROM w1 UNION ALL SELECT key, concat(key, '#', i), 'type', 'span' FROM w1 UNION ALL SELECT DISTINCT key, tag, 'type', 'pstg' FROM w1
UNION ALL SELECT key, c, 'type', sup FROM c JOIN above USING (c) UNION ALL SELECT key, concat(key, '#', head), label, concat(key, '#', i) FROM arc WHERE head IS NOT NULL
UNION ALL SELECT key, concat(key, '#', i), 'assert', NULL FROM arc WHERE head IS NULL""")
def ingest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("graph_id", "s", "t", "o")


@query("match_parse", f"""WITH {_PARSE}, tg AS (SELECT key, i, tag FROM w1)
SELECT x.key AS graph_id, concat(x.key, '#', y.head) AS h, concat(x.key, '#', y.i) AS a, concat(x.key, '#', x.i) AS c FROM arc x JOIN arc y ON y.key = x.key AND y.i = x.head JOIN tg h ON h.key = y.key AND h.i = y.head
WHERE x.label = 'det' AND y.label = 'obj' AND h.tag IN ('vb', 'md')""")
def match_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determined objects of verbs: a pattern over arcs whose ends are told by the kinds above their tags."""
    facts = staged(_parsed(spark, sf_dir))
    found = match(facts, [("?h", "obj", "?a"), ("?a", "det", "?c")], types(facts), {"h": "verb", "a": "content", "c": "function"})
    return found.select("graph_id", "h", "a", "c")


@query("rule_cover", f"""WITH {_PARSE}, t0 AS (SELECT key, i AS c, head AS v FROM arc WHERE label = 'pobj'), n0 AS (SELECT key, c FROM t0 UNION SELECT key, v FROM t0),
t1 AS (SELECT key, head AS c, min(i) AS v FROM arc WHERE label = 'det' AND (key, head) NOT IN (SELECT key, c FROM n0) GROUP BY key, head), n1 AS (SELECT key, c FROM n0 UNION SELECT key, c FROM t1 UNION SELECT key, v FROM t1),
t2 AS (SELECT key, i AS c, head AS v FROM arc WHERE label = 'conj' AND (key, i) NOT IN (SELECT key, c FROM n1)), n2 AS (SELECT key, c FROM n1 UNION SELECT key, c FROM t2 UNION SELECT key, v FROM t2)
SELECT key AS graph_id, 0 AS rule, CAST(c AS VARCHAR) AS centre FROM t0 UNION ALL SELECT key, 1, CAST(c AS VARCHAR) FROM t1 UNION ALL SELECT key, 2, CAST(c AS VARCHAR) FROM t2
UNION ALL SELECT key, 3, CAST(i AS VARCHAR) FROM arc WHERE (key, i) NOT IN (SELECT key, c FROM n2)""")
def rule_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that get a mention of their own: objects with their prepositions, determined words, conjuncts with what they join, then all others."""
    arcs = _sketch(spark, sf_dir)
    rule = lambda n, label, centre, cover: arcs.where(label).select("graph_id", F.lit(n).alias("rindex"), F.col("i").alias("sol"), F.col(centre).cast("string").alias("centre"), F.array(cover.cast("string")).alias("covers"))
    tried = [rule(0, "label = 'pobj'", "i", F.col("head")), rule(1, "label = 'det'", "head", F.col("i")), rule(2, "label = 'conj'", "i", F.col("head")), rule(3, "true", "i", F.lit(None))]
    return ranking.first_rules(tried[0].union(tried[1]).union(tried[2]).union(tried[3])).select("graph_id", F.col("rindex").alias("rule"), "centre")


@query("ner_to_quads", f"WITH {_HITS}, m AS (SELECT DISTINCT key, \"start\", \"end\", phrase FROM hits) SELECT concat(key, ':', \"start\") AS s, 'type' AS t, CASE WHEN \"end\" - \"start\" = 2 THEN 'pair_ner' ELSE 'triple_ner' END AS o FROM m UNION ALL SELECT concat('\"', phrase, '\"'), 'expr', concat(key, ':', \"start\") FROM m")
def ner_to_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hits(spark, sf_dir).distinct()
    node = F.concat("key", F.lit(":"), F.col("start").cast("string"))
    kind = F.when(F.col("end") - F.col("start") == 2, "pair_ner").otherwise("triple_ner")
    both = F.array(F.struct(node.alias("s"), F.lit("type").alias("t"), kind.alias("o")), F.struct(F.concat(F.lit('"'), "phrase", F.lit('"')).alias("s"), F.lit("expr").alias("t"), node.alias("o")))
    return m.select(F.explode(both).alias("q")).select("q.*")


_DOCS = "SELECT doc_id, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM documents"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "").alias("w"))


@query("case_counts", f"WITH d AS ({_DOCS}), t AS (SELECT unnest(w) AS form FROM d) SELECT lower(form) AS word, form, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY form HAVING count(*) >= 5")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _words(spark, sf_dir).select(F.explode("w").alias("form"))
    return forms.groupBy("form").agg(F.count("*").alias("n")).where("n >= 5").select(F.lower("form").alias("word"), "form", "n")


@query("case_score", f"WITH d AS ({_DOCS}), t AS (SELECT unnest(w) AS form FROM d), c AS (SELECT lower(form) AS word, form, count(*) AS n FROM t GROUP BY form), s AS (SELECT word, sum(n) AS total, count(*) AS k FROM c GROUP BY word) SELECT word, form, round(ln((n + 5.0) / (total + 5.0 * k)), 6) AS score FROM c JOIN s USING (word) WHERE k > 1")
def case_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log share of each case form of a word, smoothed by 5."""
    forms = _words(spark, sf_dir).select(F.explode("w").alias("form")).groupBy("form").agg(F.count("*").alias("n")).withColumn("word", F.lower("form"))
    sums = forms.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("k")).where("k > 1")
    return forms.join(sums, "word").select("word", "form", F.round(F.log((F.col("n") + 5.0) / (F.col("total") + 5.0 * F.col("k"))), 6).alias("score"))


@query("truecase", f"WITH d AS ({_DOCS}), t AS (SELECT unnest(w) AS form FROM d), c AS (SELECT lower(form) AS word, form, count(*) AS n FROM t GROUP BY form), b AS (SELECT word, form, row_number() OVER (PARTITION BY word ORDER BY n DESC, form) AS k FROM c) SELECT word, form FROM b WHERE k = 1")
def truecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's most frequent case form."""
    forms = _words(spark, sf_dir).select(F.explode("w").alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    best = Window.partitionBy("word").orderBy(F.desc("n"), "form")
    return forms.withColumn("word", F.lower("form")).withColumn("k", F.row_number().over(best)).where("k = 1").select("word", "form")


@query("truecase_context")
def truecase_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns in the case that the documents' words have in their context."""
    from quadloom.operators import casing

    turns = _read(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("key"), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "").alias("toks"))
    return casing.truecased(turns, *casing.case_tables(_words(spark, sf_dir).select(F.col("w").alias("toks")), turns.select("toks"))).select("key", F.array_join("toks", " ").alias("text"))


_CASES = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in fn.CONTRACTIONS.items())
_FULL = f"CASE lower(w) {_CASES} END"


@query("contractions", f"SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN {_FULL} IS NULL THEN w WHEN w[1] <> lower(w[1]) THEN concat(upper(({_FULL})[1]), substr({_FULL}, 2)) ELSE {_FULL} END), ' ') AS text FROM conversations")
def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", fn.expanded(F.col("text")).alias("text"))


@query("truncate_words", "SELECT conv_id, turn, array_to_string(list_slice(string_split(text, ' '), 1, 20), ' ') AS text FROM conversations")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", fn.first_words(F.col("text"), 20).alias("text"))


@query("apostrophes", "SELECT doc_id, regexp_replace(replace(replace(text, '’', ''''), '‘', ''''), ' +''', '''', 'g') AS text FROM documents")
def apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", fn.plain_apostrophes(F.col("text")).alias("text"))


@query("strip_sense", "SELECT p_partkey, p_name AS name FROM part")
def strip_sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".n."), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("name"))
    return p.select("p_partkey", fn.without_sense(F.col("name")).alias("name"))


@query("topic_anchor", r"SELECT page_id, concat('topic_', string_split(regexp_extract(url, '([^/]+?)(?:\.[a-z]+)?$', 1), '_')[1]) AS anchor FROM pages")
def topic_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", fn.topic_of(F.col("url")).alias("anchor"))


@query("between_markers", """
WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
f AS (SELECT *, line LIKE 'The %' AS b, line LIKE '%.' AS e FROM l), w AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS starts FROM f)
SELECT doc_id, CAST(sum(CASE WHEN starts > 0 AND e THEN 1 ELSE 0 END) AS BIGINT) AS n FROM w GROUP BY doc_id""")
def between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed lines after the first line that starts a section, counted for each document."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    opened = F.sum(F.when(F.col("line").like("The %"), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("starts", opened).groupBy("doc_id").agg(F.sum(F.when((F.col("starts") > 0) & F.col("line").like("%."), 1).otherwise(0)).cast("long").alias("n"))


_TAGS = "</?(?:ul|nav|article)>|<li>|<p>"


@query("marked_sections", f"""
WITH g AS (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS tags FROM pages), l AS (SELECT page_id, unnest(range(0, len(tags))) AS i, unnest(tags) AS tag FROM g),
m AS (SELECT *, CASE WHEN tag LIKE '</%' THEN -1 WHEN tag IN ('<ul>', '<nav>', '<article>') THEN 1 ELSE 0 END AS mark FROM l),
s AS (SELECT *, sum(mark) OVER (PARTITION BY page_id ORDER BY i) AS s FROM m), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY i), 0) AS before FROM d), n AS (SELECT *, sum(CASE WHEN before = 0 AND depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS section FROM b)
SELECT page_id, CAST(section AS BIGINT) AS section, CAST(count(*) FILTER (mark = 0) AS BIGINT) AS n_entries, CAST(max(depth) AS BIGINT) AS deepest, bool_or(before > 0 AND depth = 0) AS closed
FROM n WHERE depth > 0 OR before > 0 GROUP BY page_id, section""")
def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost lists, navigation blocks and articles of every page, with their entries and how deep they nest."""
    tags = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("i", "tag"))
    mark = F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").isin("<ul>", "<nav>", "<article>"), 1).otherwise(0)
    found = spans.sections(tags.withColumn("mark", mark), ["page_id"], "i", "mark").where("section IS NOT NULL")
    return found.groupBy("page_id", "section").agg(F.count_if(F.col("mark") == 0).alias("n_entries"), F.max("depth").alias("deepest"), F.bool_or("closed").alias("closed"))


@query("emit_exprs", "SELECT DISTINCT concat('expr(\"', p_name, '\", ', p_type, ')') AS line FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 10 = 0)")
def emit_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    new = p.join(p.where("p_partkey % 10 = 0").select("p_name").distinct(), "p_name", "left_anti")
    return new.select(F.format_string('expr("%s", %s)', "p_name", "p_type").alias("line")).distinct()


@query("events_props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
