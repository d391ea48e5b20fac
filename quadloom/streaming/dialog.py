"""The turn pipeline: from what was said in a turn to a response for each session, as a batch step and as a stream.

A step finds dictionary phrases in the utterances, notes the mentions, lets older ones fade, looks up what the
knowledge has beside the phrases still attended to, scores it, and answers with the best that the session hasn't heard. State is one
table, (session, kind, item, turn): `said` for a phrase's last mention and `used` for a response; a stream keeps a
version of it for each micro-batch, so a batch that runs again after a failure starts from the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.operators import spans
from quadloom.operators.salience import DECAY
from quadloom.sources.staging import staged

STATE = "session string, kind string, item string, turn long"
#: Facts that are pulled for a phrase, the most frequent first; weights of attention and of frequency in a response's score.
BRANCH, ATTENTION, PRIORITY = 10, 1.0, 0.5


def knowledge(phrases: DataFrame) -> DataFrame:
    """(topic, item, priority): the BRANCH most frequent phrases of each first word, from (phrase, n_texts)."""
    rows = phrases.select(F.split("phrase", " ")[0].alias("topic"), F.col("phrase").alias("item"), (F.col("n_texts") / (F.col("n_texts") + 10)).alias("priority"))
    best = Window.partitionBy("topic").orderBy(F.desc("priority"), "item")
    return rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= BRANCH).drop("_k")


def starting(spark: SparkSession, facts: DataFrame | None = None) -> DataFrame:
    """The state before anything is said: empty, or with starting facts (session, item) as mentioned before the first turn."""
    if facts is None:
        return spark.createDataFrame([], STATE)
    return facts.select("session", F.lit("said").alias("kind"), "item", F.lit(-1).cast("long").alias("turn")).distinct()


def step(state: DataFrame, said: DataFrame, phrases: DataFrame, known: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(state after, responses (session, turn, item, score)) of one turn each of some sessions; said: (session, turn, text).

    A session of which nothing attended to has anything left to say gets no response. Ties go to the smaller item.
    """
    turns = staged(said.select("session", "turn", spans.tokens(F.col("text")).alias("toks")))
    hits = spans.longest(spans.gazetteer(turns, ["session"], "toks", phrases, sizes), ["session"])
    now = turns.select("session", F.col("turn").alias("_now"))
    new = hits.select("session", F.col("phrase").alias("item")).distinct().join(now, "session").select("session", F.lit("said").alias("kind"), "item", F.col("_now").cast("long").alias("turn"))
    after = staged(state.union(new).groupBy("session", "kind", "item").agg(F.max("turn").alias("turn")).select("session", "kind", "item", "turn"))
    # what has faded in a session that speaks is forgotten; other sessions stay as they are
    aged = after.join(now, "session", "left")
    faded = (F.col("kind") == "said") & (1 - DECAY * (F.col("_now") - F.col("turn")) <= 1e-9)
    after = staged(aged.where(~F.coalesce(faded, F.lit(False))).select("session", "kind", "item", "turn", "_now"))
    attended = after.where("kind = 'said' AND _now IS NOT NULL").select("session", "_now", F.split("item", " ")[0].alias("topic"), F.col("item").alias("_said"), (1 - DECAY * (F.col("_now") - F.col("turn"))).alias("attention"))
    topics = attended.groupBy("session", "_now", "topic").agg(F.max("attention").alias("attention"))
    offers = topics.join(known, "topic").withColumn("score", F.round(ATTENTION * F.col("attention") + PRIORITY * F.col("priority") + 1e-9, 6))
    heard = after.where("_now IS NOT NULL").select("session", "item").distinct()
    order = F.struct(-F.col("score"), "item")
    best = offers.join(heard, ["session", "item"], "left_anti").groupBy("session", F.col("_now").alias("turn")).agg(F.min_by("item", order).alias("item"), F.max("score").alias("score"))
    responses = staged(best.select("session", F.col("turn").cast("long").alias("turn"), "item", "score"))
    return after.select("session", "kind", "item", "turn").union(responses.select("session", F.lit("used"), "item", "turn")), responses


def run_turns(state: DataFrame, said: DataFrame, phrases: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """(session, turn, item, score) of all responses: the batch twin, turn by turn, all sessions at once."""
    said, out = staged(said), None
    for turn in sorted(r.turn for r in said.select("turn").distinct().collect()):  # as many as the longest session has turns
        state, some = step(staged(state), said.where(F.col("turn") == turn), phrases, known, sizes)
        out = some if out is None else out.union(some)
    return out if out is not None else said.select("session", F.col("turn").cast("long").alias("turn"), F.lit("").alias("item"), F.lit(0.0).alias("score")).limit(0)


def respond(utterances: DataFrame, path: str, phrases: DataFrame, known: DataFrame, sizes: list[int], checkpoint: str):
    """Start a stream of (session, turn, text); responses go to path/responses, state versions to path/state, by batch.

    A micro-batch may hold several turns of a session; they are taken in order. A batch's folders are overwritten when it runs again.
    """
    spark = utterances.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        state = spark.read.schema(STATE).parquet(f"{path}/state/{number - 1}") if number else starting(spark)
        rows, parts = staged(rows), []
        for turn in sorted(r.turn for r in rows.select("turn").distinct().collect()):
            state, some = step(staged(state), rows.where(F.col("turn") == turn), phrases, known, sizes)
            parts.append(some)
        state.write.mode("overwrite").parquet(f"{path}/state/{number}")
        for i, some in enumerate(parts):
            some.write.mode("overwrite" if i == 0 else "append").parquet(f"{path}/responses/batch={number}")

    return utterances.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
