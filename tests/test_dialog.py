"""The turn pipeline: its batch twin against plain Python, and the stream against the twin."""

import random

import pytest

from quadloom.streaming import dialog

WORDS = "red blue cat dog sun".split()
PHRASES = {f"{a} {b}": 5 + 3 * i + j for i, a in enumerate(WORDS) for j, b in enumerate(WORDS) if a != b}


@pytest.fixture(scope="module")
def told():
    rng = random.Random(3)
    return [(f"s{s}", t, " ".join(rng.choices([*WORDS, "and", "the"], k=rng.randint(0, 6)))) for s in range(3) for t in range(rng.randint(1, 4))]


def plain(told):
    state, used, out = {}, {}, set()
    for session, turn, text in sorted(told, key=lambda x: (x[0], x[1])):
        words, said = text.split(), state.setdefault(session, {})
        for i in range(len(words) - 1):
            if " ".join(words[i : i + 2]) in PHRASES:
                said[" ".join(words[i : i + 2])] = turn
        for p in [p for p, t in said.items() if 1 - 0.1 * (turn - t) <= 1e-9]:
            del said[p]
        topics = {}
        for p, t in said.items():
            topics[p.split()[0]] = max(topics.get(p.split()[0], 0), 1 - 0.1 * (turn - t))
        offers = []
        for topic, weight in topics.items():
            items = sorted((p for p in PHRASES if p.startswith(topic + " ")), key=lambda p: (-PHRASES[p], p))[: dialog.BRANCH]
            offers += [(-round(weight + 0.5 * PHRASES[p] / (PHRASES[p] + 10) + 1e-9, 6), p) for p in items if p not in said and p not in used.get(session, ())]
        if offers:
            score, item = min(offers)
            out.add((session, turn, item, -score))
            used.setdefault(session, set()).add(item)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    phrases = spark.createDataFrame(list(PHRASES.items()), "phrase string, n_texts long")
    return phrases, dialog.knowledge(phrases)


def test_twin_and_stream(spark, told, tables, tmp_path):
    schema = "session string, turn long, text string"
    want = plain(told)
    rows = spark.createDataFrame(told, schema)
    got = dialog.run_turns(dialog.starting(spark), rows, *tables, [2])
    assert {tuple(r) for r in got.collect()} == want and want
    rows.where("turn < 2").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = dialog.respond(stream, f"{tmp_path}/out", *tables, [2], f"{tmp_path}/ck")
    q.processAllAvailable()
    rows.where("turn >= 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    heard = spark.read.parquet(f"{tmp_path}/out/responses").select("session", "turn", "item", "score")
    assert {tuple(r) for r in heard.collect()} == want


def test_starting_facts(spark, tables):
    facts = spark.createDataFrame([("s", "red cat")], "session string, item string")
    said = spark.createDataFrame([("s", 0, "hello")], "session string, turn long, text string")
    assert [r.item for r in dialog.run_turns(dialog.starting(spark, facts), said, *tables, [2]).collect()] == ["red sun"]
    assert dialog.run_turns(dialog.starting(spark), said, *tables, [2]).count() == 0
