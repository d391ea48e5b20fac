"""Conversations: each turn's facts meet what the session knows; references are resolved, questions settled, rules fired, a response chosen.

What is said arrives parsed, as rows (session, turn, row, s, t, o, pid): row `fact` is a fact; `link` a metalink from s to o with the
label t; `ask` a question of the user about the node s, of the kind t (`arg`). A session's state is four tables, of which a turn
reads and writes the sessions that speak alone. A derived fact `ask_x`(s, o) is a question to the user, whether x(s, o) holds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.operators.closure import types, types_within
from quadloom.operators.mutate import FACT, add, renamed, representatives
from quadloom.operators.reference import open_request, resolved, truth_answers
from quadloom.operators.rulebook import chain_stored, compiled
from quadloom.operators.salience import DECAY
from quadloom.sources.staging import discard, remove_folder, scratch, small, staged

SAID = "session string, turn long, row string, s string, t string, o string, pid string"
#: facts and links of the session; when each concept was mentioned last; what was asked, by whom, and whether that is settled.
STATE = {
    "facts": "graph_id string, s string, t string, o string, pid string",
    "links": "graph_id string, src string, label string, dst string",
    "features": "graph_id string, c string, turn long",
    "requests": "graph_id string, pid string, who string, kind string, focus string, turn long, salience double, settled boolean",
}
RESPONSE = "session string, turn long, kind string, text string, about string"
#: What is said when nothing else can be; rounds of rules in a turn; batches after which the state's versions are put together.
FALLBACK, ROUNDS, COMPACT = "tell me more", 2, 10
#: Turns from which on it pays to take them at once, and the rows of all their states, as far as known before, that are taken at once.
AHEAD, TOGETHER = 6, 4_000_000


@dataclass(frozen=True)
class Knowledge:
    """Facts that hold in every session (types above all), and stored rules with their conditions; once made: tries, the rules compiled,
    and above, the types (c, sup) that hold in every session."""

    facts: DataFrame
    edges: DataFrame
    conditions: DataFrame | None = None
    tries: tuple[DataFrame, DataFrame] | None = None
    above: DataFrame | None = None

    def ready(self) -> Knowledge:
        if self.tries and self.above is not None:
            return self
        tries = self.tries or (compiled(self.edges, self.conditions), compiled(self.edges, self.conditions, delta=True))
        return replace(self, edges=staged(self.edges), tries=tries, above=small(staged(types(self.facts.select(FACT)).where("c <> sup"))))


def starting(spark: SparkSession, facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """A state in which nothing was said yet; facts (FACT): what sessions, by graph_id, begin with."""
    state = {k: spark.createDataFrame([], v) for k, v in STATE.items()}
    return state if facts is None else state | {"facts": facts.select(FACT)}


def step(state: dict[str, DataFrame], said: DataFrame, know: Knowledge) -> tuple[dict[str, DataFrame], DataFrame]:
    """(state, responses (RESPONSE)) after one turn of each session in said; both hold the speaking sessions alone.

    In order: references of the session are merged with what they stand for, the most salient that fits; a yes or no settles the
    question asked on the turn before; ROUNDS rounds of rules fire; the response is the answer to a question of the user whose node
    was resolved, else a new question that a rule raised, else a newly derived fact, else FALLBACK. Ties go to the more salient
    subject, then to the smaller id.
    """
    said, know = staged(said), know.ready()
    now = staged(said.groupBy(F.col("session").alias("graph_id")).agg(F.max("turn").cast("long").alias("turn")))
    mine = {k: v.join(F.broadcast(now.select("graph_id")), "graph_id", "left_semi") for k, v in state.items()}  # as many rows as the batch has sessions
    own = lambda kind: said.where(F.col("row") == kind).select(F.col("session").alias("graph_id"), "s", "t", "o", "pid", "turn")
    facts = staged(add(mine["facts"], own("fact")))
    links = staged(mine["links"].union(own("link").select("graph_id", "s", "t", "o")).distinct())
    heard = own("fact").select("graph_id", F.explode(F.array_compact(F.array("s", "o"))).alias("c"), "turn")
    features = staged(mine["features"].union(heard).groupBy("graph_id", "c").agg(F.max("turn").alias("turn")))
    fresh = lambda rows: rows.join(now.withColumnRenamed("turn", "_now"), "graph_id").withColumn("salience", 1 - DECAY * (F.col("_now") - F.col("turn")))
    asks = own("ask").select("graph_id", "pid", F.lit("user").alias("who"), F.col("t").alias("kind"), F.col("s").alias("focus"), "turn", F.lit(1.0).alias("salience"), F.lit(False).alias("settled"))
    requests = mine["requests"].union(asks)

    kinds = staged(types_within(facts, know.above))
    facts, pairs = resolved(facts, links, kinds, fresh(features).select("graph_id", "c", "salience"))
    pairs = staged(pairs)
    names = staged(representatives(pairs.select("graph_id", F.col("match").alias("a"), F.col("ref").alias("b"))).where("old <> new"))
    links = links.join(pairs.select("graph_id", F.col("ref").alias("src")).distinct(), ["graph_id", "src"], "left_anti").select("graph_id", "src", "label", "dst")
    links = renamed(links, names, ("src", "dst")).distinct()
    features = renamed(features, names, ("c",)).groupBy("graph_id", "c").agg(F.max("turn").alias("turn"))
    requests = staged(renamed(requests, names, ("focus",)))

    marks = facts.where("t = 'not'").select("graph_id", F.col("s").alias("pid")).distinct().withColumn("denied", F.lit(True))
    replies = own("fact").join(marks, ["graph_id", "pid"], "left").select("graph_id", "pid", "t", "o", F.lit(1.0).alias("salience"), F.coalesce("denied", F.lit(False)).alias("denied"))
    replied = staged(truth_answers(open_request(requests.where("who = 'bot'").drop("who"), now), replies).select("graph_id", "request", "says"))
    told = facts.join(replied.withColumnRenamed("request", "pid"), ["graph_id", "pid"]).select("graph_id", "s", F.expr("substring(t, 5)").alias("t"), "o", F.concat(F.lit("told:"), "pid").alias("pid"), "says")
    denied = told.where("says = 'no'").select("graph_id", F.col("pid").alias("s"), F.lit("not").alias("t"), F.lit(None).cast("string").alias("o"), F.concat(F.lit("q:"), "pid", F.lit("|not|")).alias("pid"))
    facts = staged(add(facts, told.select(FACT).union(denied)))

    derived = staged(chain_stored(facts, know.edges, know.conditions, ROUNDS, kinds, know.tries).where("t NOT IN ('not', 'maybe')"))
    facts = add(facts, derived)

    settled = pairs.join(names.select("graph_id", F.col("old").alias("ref"), "new"), ["graph_id", "ref"], "left").select("graph_id", F.coalesce("new", "ref").alias("focus")).distinct()
    answers = requests.where("who = 'user' AND NOT settled").join(settled, ["graph_id", "focus"]).select("graph_id", F.lit(0).alias("order"), F.lit(0.0).alias("less"), "pid", F.lit("answer").alias("kind"), F.col("focus").alias("text"))
    near = fresh(features).select("graph_id", F.col("c").alias("s"), "salience")
    offers = derived.join(near, ["graph_id", "s"], "left").select("graph_id", F.when(F.col("t").startswith("ask_"), 1).otherwise(2).alias("order"), -F.coalesce("salience", F.lit(0.0)), "pid", F.when(F.col("t").startswith("ask_"), "ask").otherwise("tell"), F.concat_ws(" ", "s", "t", "o"))
    none = now.select("graph_id", F.lit(3), F.lit(0.0), F.lit(None).cast("string"), F.lit("fallback"), F.lit(FALLBACK))
    chosen = answers.union(offers).union(none).groupBy("graph_id").agg(F.min(F.struct("order", "less", "pid", "kind", "text")).alias("b"))
    best = staged(chosen.join(now, "graph_id").select("graph_id", "turn", "b.kind", "b.text", F.col("b.pid").alias("pid")))

    over = replied.select("graph_id", F.col("request").alias("pid")).union(best.where("kind = 'answer'").select("graph_id", "pid")).distinct().withColumn("_over", F.lit(True))
    requests = requests.join(over, ["graph_id", "pid"], "left").withColumn("settled", F.col("settled") | F.coalesce("_over", F.lit(False))).drop("_over")
    asked = best.where("kind = 'ask'").join(derived, ["graph_id", "pid"]).select("graph_id", "pid", F.lit("bot").alias("who"), F.lit("truth").alias("kind"), F.col("o").alias("focus"), "turn", F.lit(1.0).alias("salience"), F.lit(False).alias("settled"))
    out = {
        "facts": facts.select(FACT),
        "links": links,
        "features": fresh(features).where("salience > 1e-9").select("graph_id", "c", "turn"),  # what has faded is forgotten
        "requests": requests.select(*asked.columns).union(asked),
    }
    return {k: staged(v) for k, v in out.items()}, best.select(F.col("graph_id").alias("session"), "turn", "kind", "text", F.col("pid").alias("about"))


def run_turns(state: dict[str, DataFrame], said: DataFrame, know: Knowledge) -> tuple[dict[str, DataFrame], DataFrame]:
    """(state of the sessions in said, responses): the turns of all sessions in the order of their numbers, many of them at once by ahead()."""
    spark, said, parts, know = said.sparkSession, staged(said), [], know.ready()
    spoken = said.select(F.col("session").alias("graph_id")).distinct()
    state = {k: staged(v.join(spoken, "graph_id", "left_semi")) for k, v in state.items()}
    turns = sorted(r.turn for r in said.select("turn").distinct().collect())  # as many as the longest session has turns
    while turns:
        n = _at_once(state, said.where(F.col("turn") >= turns[0])) if len(turns) >= AHEAD else 1
        take = step if n < AHEAD else ahead
        n = 1 if n < AHEAD else n
        rows = said.where(F.col("turn").between(turns[0], turns[n - 1]))
        speaking = rows.select(F.col("session").alias("graph_id")).distinct()
        after, some = take(state, rows, know)
        state = {k: staged(v.join(speaking, "graph_id", "left_anti").unionByName(after[k])) for k, v in state.items()}
        parts.append(some)
        turns = turns[n:]
    out = spark.createDataFrame([], RESPONSE)
    for some in parts:
        out = out.union(some)
    return state, out


def _at_once(state: dict[str, DataFrame], said: DataFrame) -> int:
    """How many of the first turns of said have no more than TOGETHER rows before them, a session's counted for each of its turns."""
    own = said.groupBy(F.col("session").alias("graph_id"), "turn").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("graph_id").orderBy("turn"))
    held = _packed(state).groupBy("graph_id").agg(F.sum("n").alias("held"))
    rows = own.withColumn("n", so_far).join(held, "graph_id", "left").groupBy("turn").agg(F.sum(F.col("n") + F.coalesce("held", F.lit(0))).alias("n"))
    sums = accumulate(r.n for r in rows.orderBy("turn").collect())  # a row for each turn
    return sum(n <= TOGETHER for n in sums)


def _cells(table: str) -> list[str]:
    return STATE[table].split(", ")[1:]


def _packed(state: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, row, n): the rows of all tables of a state as one table, and how often each stands there."""
    out = None
    for k, v in state.items():
        cell = lambda x: (F.struct(*(c.split()[0] for c in _cells(x))) if x == k else F.lit(None)).cast(f"struct<{','.join(c.replace(' ', ':') for c in _cells(x))}>").alias(x)  # noqa: B023, E731
        rows = v.select("graph_id", F.struct(*map(cell, STATE)).alias("row"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("graph_id", "row").agg(F.count("*").alias("n"))


def _unpacked(rows: DataFrame) -> dict[str, DataFrame]:
    """The state whose _packed() rows these are."""
    table = lambda k: rows.where(F.col(f"row.{k}").isNotNull()).select("graph_id", f"row.{k}.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_k")).drop("_k")
    return {k: table(k) for k in STATE}


def ahead(state: dict[str, DataFrame], said: DataFrame, know: Knowledge) -> tuple[dict[str, DataFrame], DataFrame]:
    """What step() makes of the turns in said one after another, by steps that take many turns of a session at once.

    Each turn of a session is a session of its own to step() and begins with a guess of the state before it: the session's state with
    what the turns before changed when they ran last. Turns whose guess has changed run again until there are none. A first
    turn's guess is right, and so is a turn's if those before ran with right ones; so a round settles one turn of each session at
    least, and ends with what step() makes of one after another. Guesses
    are compared by 128 bits of hashes and their numbers of rows.
    """
    turns = staged(said.where("session IS NOT NULL").select("session", "turn", F.concat_ws("#", "session", "turn").alias("graph_id")).distinct())
    said = said.withColumn("session", F.concat_ws("#", "session", "turn"))
    long = lambda n: F.lit(n).cast("long")
    held = staged(_packed(state).select(F.col("graph_id").alias("session"), "row", long(-(1 << 63)).alias("turn"), "n"))
    events, changes, out, marks = held, None, None, None
    while True:
        until = F.coalesce(F.lead("turn").over(Window.partitionBy("session", "row").orderBy("turn")), long((1 << 63) - 1))
        spans = events.select("session", "row", F.col("turn").alias("since"), until.alias("until"), "n").where("n > 0")
        guess = staged(turns.join(spans, "session").where("since < turn AND turn <= until").select("graph_id", "row", "n"))
        text = F.to_json("row")
        mark = guess.groupBy("graph_id").agg(F.count("*").alias("m0"), F.bit_xor(F.xxhash64(text, "n")).alias("m1"), F.bit_xor(F.xxhash64(F.lit("#"), text, "n")).alias("m2"))
        now = staged(turns.select("graph_id").join(mark, "graph_id", "left").na.fill(0))
        todo = staged((now if marks is None else now.join(marks, now.columns, "left_anti")).select("graph_id"))
        if todo.isEmpty():
            break
        again = lambda rows, kind: rows.join(todo, "graph_id", kind)  # noqa: B023, E731
        after, some = step(_unpacked(guess), said.join(todo.select(F.col("graph_id").alias("session")), "session", "left_semi"), know)
        both = _packed(after).select("graph_id", "row", "n", long(0).alias("was")).union(again(guess, "left_semi").select("graph_id", "row", long(0), "n"))
        new = both.groupBy("graph_id", "row").agg(F.sum("n").alias("n"), F.sum("was").alias("was")).where("n <> was").select("graph_id", "row", "n")
        old = changes, out, marks, guess
        changes = staged(new if changes is None else again(changes, "left_anti").union(new))
        some = some.withColumnRenamed("session", "graph_id")
        out = staged(some if out is None else again(out, "left_anti").union(some))
        marks, events = now, held.union(changes.join(turns, "graph_id").select("session", "row", "turn", "n"))
        discard(*(x for x in old if x is not None))
    last = events.groupBy(F.col("session").alias("graph_id"), "row").agg(F.max_by("n", "turn").alias("n")).where("n > 0")
    return _unpacked(staged(last)), out.join(turns.select("graph_id", "session"), "graph_id").select("session", "turn", "kind", "text", "about")


class Sessions:
    """The state of all sessions as versions: a batch writes those of its sessions; a session's state is its last version.

    Every COMPACT batches all are written together. Older versions go when the next batch starts, so a batch that runs again
    after a failure finds the state it began with.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT) -> None:
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _versions(self, before: int) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
        return sorted(n for n in (int(x.split("=")[1]) for x in names if x.startswith("version=")) if n < before)

    def _read(self, versions: list[int], table: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, version long")
        for n in versions:  # at most twice COMPACT
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/state/version={n}/{table}").withColumn("version", F.lit(n).cast("long")))
        return out

    def before(self, number: int) -> dict[str, DataFrame]:
        """The state before the batch of that number."""
        versions = self._versions(number)
        last = staged(self._read(versions, "sessions", "graph_id string").groupBy("graph_id").agg(F.max("version").alias("version")))
        return {k: self._read(versions, k, v).join(last, ["graph_id", "version"], "left_semi").drop("version") for k, v in STATE.items()}

    def write(self, number: int, before: dict[str, DataFrame], after: dict[str, DataFrame], spoken: DataFrame) -> None:
        whole = number % self.compact == 0
        names = spoken
        for k in STATE:
            rest = before[k].join(spoken, "graph_id", "left_anti") if whole else before[k].limit(0)
            table = rest.unionByName(after[k])
            table.write.mode("overwrite").parquet(f"{self.path}/state/version={number}/{k}")
            names = names.union(table.select("graph_id")) if whole else names
        names.distinct().write.mode("overwrite").parquet(f"{self.path}/state/version={number}/sessions")

    def tidy(self, number: int) -> None:
        """Remove what the batch of that number, and those after it, won't read: versions before the last whole one."""
        whole = [n for n in self._versions(number) if n % self.compact == 0]
        for n in self._versions(whole[-1]) if whole else []:
            remove_folder(self.spark, f"{self.path}/state/version={n}")


def converse(said: DataFrame, path: str, know: Knowledge, checkpoint: str, facts: DataFrame | None = None, compact: int = COMPACT):
    """Start a stream of rows SAID; responses go to path/responses, by batch, and the sessions' state to path/state.

    A micro-batch may hold several turns of a session; they are taken in order. facts: what sessions begin with; they are taken in when a
    session first speaks. A batch's folders are overwritten when it runs again; its intermediate tables go when it ends.
    The compiled rules stay for the next stream where know is ready().
    """
    spark = said.sparkSession
    sessions, know = Sessions(spark, path, compact), know.ready()

    def batch(rows: DataFrame, number: int) -> None:
        sessions.tidy(number)
        with scratch(spark):
            rows = staged(rows)
            spoken = staged(rows.select(F.col("session").alias("graph_id")).distinct())
            state = sessions.before(number)
            if facts is not None:
                met = sessions._read(sessions._versions(number), "sessions", "graph_id string").select("graph_id").distinct()
                new = spoken.join(met, "graph_id", "left_anti")
                state = state | {"facts": state["facts"].unionByName(facts.select(FACT).join(new, "graph_id", "left_semi"))}
            after, out = run_turns(state, rows, know)
            sessions.write(number, state, after, spoken)
            out.write.mode("overwrite").parquet(f"{path}/responses/batch={number}")

    return said.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
