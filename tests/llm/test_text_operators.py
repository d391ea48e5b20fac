"""Per-document operators against plain Python, on odd texts and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quadloom.llm import byte_bpe, langid, packing, quality, sharding, simhash, token_counts

ODD = [None, "", " ", "a", "  two  spaces \n\n end ", "don't 've I'll x's5 \xa0 \xa0 b", "ÉÈ ß Σ İ ŉ ǅ 漢字。かな１２ ​ x", "tab\tand\r\nline\x0b\x0c \x1c x", "<|endoftext|> <|startoftext|>", "word " * 300, "abc" * 30000, "the cat sat on the mat. " * 5000, "x\n" * 60, "éa \U0001f600 %%% ###"]
SCHEMA = "doc_id long, text string, lang string, source string, fp string, k string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(i, t, None, None, "clash", "clash") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, "", ""), (None, None, None, None, None, None)]
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows += [(1000 + r[0], r[1], None, None, None, None) for r in real]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    for out in (byte_bpe.decode_documents(byte_bpe.encode_documents(empty)), packing.pack_documents(empty), quality.judged(quality.repetition_counts(empty)), simhash.near_duplicates(empty), sharding.shard_documents(empty), token_counts.count_tokens(empty), langid.identify(empty), simhash.drop_near_duplicates(empty), langid.keep_identified(empty)):
        assert out.count() == 0


def test_byte_bpe(docs):
    raw = open(public_tokenizers.path(byte_bpe.RANKS), "rb").read()
    plain = byte_bpe.codec(raw, public_tokenizers.PATTERN)[0]
    text = {(r.doc_id, r.text) for r in docs.collect()}
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert len(out) == docs.count()
    by_text = Counter((tuple(plain.encode_ordinary(t or "")), i) for i, t in text)
    assert {(tuple(r.ids), r.doc_id) for r in out} == set(by_text)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in out} == {(i, t or "") for i, t in text}
    both = byte_bpe.encode_documents(docs, decoded=True).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in both) == sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in out)
    long = "".join(chr(97 + i % 7) + (" ," if i % 11 == 0 else "9") for i in range(150_000))
    assert [x for p in byte_bpe.parts(long, 1000) for x in plain.encode_ordinary(p)] == plain.encode_ordinary(long)


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    plain.encode_special_tokens = True
    expected = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            expected[r.doc_id, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    out = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in out) // 4096) + 1


def test_best_fit_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 60, rng.integers(1, 300))
        plan = packing.best_fit_plan({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}, 100)
        gaps = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, g in enumerate(gaps) if g >= x]
            if fits:
                gaps[min(fits, key=lambda i: gaps[i])] -= x
            else:
                gaps.append(100 - x)
        last = max(first + (n1 - n0 - 1) // each for _, n0, n1, first, each, _ in plan)
        assert last + 1 == len(gaps)


def test_quality(docs):
    out = {}
    for r in quality.judged(quality.repetition_counts(docs)).collect():
        out.setdefault(r.doc_id, r)
    for r in docs.collect():
        if r.doc_id is None:
            continue
        text, got = r.text or "", out[r.doc_id]
        words = WORD.findall(text)
        lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(grams)
        repeat = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 3)}
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)), text[:80]
        for n in quality.COVERAGE:
            seen, cover = set(), set()
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                if g in seen:
                    cover |= set(range(i, i + n))
                seen.add(g)
            assert got[f"dup_chars_{n}"] == sum(len(words[j]) for j in cover)
        assert got.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash(docs):
    rows = docs.where("doc_id is not null").collect()
    rows = [r for r in rows if len(r.text or "") < 20000]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    ids = list(prints)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    out = simhash.near_duplicates(docs.where("doc_id is not null and length(coalesce(text, '')) < 20000")).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in out} == {(i, prints[i], root(i)) for i in ids}


def test_near_pairs_miss_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(12):
            y = int(x) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
            prints.add(y)
    prints |= {0, 1, 3, 7, -1, -2}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(prints))], "doc_id long, fp long")
    for tile in (4096, 3):
        edges = simhash.near_pairs(df.select("fp"), 2, tile=tile).collect()
        everything = sorted(prints)
        label = {x: x for x in everything}

        def root(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for e in edges:
            assert root(e.a) is not None
            label[root(e.a)] = root(e.b)
        got = {}
        for x in everything:
            got.setdefault(root(x), set()).add(x)
        label2 = {x: x for x in everything}
        for i, x in enumerate(everything):
            for y in everything[i + 1 :]:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                    a, b = root(x, label2), root(y, label2)
                    label2[a] = b
        want = {}
        for x in everything:
            want.setdefault(root(x, label2), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_drop_near_duplicates(docs):
    before = simhash.near_duplicates(docs.where("doc_id is not null"))
    want = before.select("component_id").distinct().count()
    kept = simhash.drop_near_duplicates(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns
    assert kept.count() == want
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in before.collect()}


def test_sharding(docs):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == docs.count()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 8, 100):
        now, grown = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((now == grown) | (grown == n)).all()
        assert abs((grown == n).mean() - 1 / (n + 1)) < 0.02


def test_token_counts(docs):
    raw = open(public_tokenizers.path(token_counts.PIECES), "rb").read()
    scores, byte = token_counts.piece_scores(raw)

    def best(word):
        way = [(0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            ways = [(way[i - 1][0] + n * byte, way[i - 1][1] - n)] if word[i - 1] not in scores else []
            ways += [(way[j][0] + scores[word[j:i]], way[j][1] - 1) for j in range(i) if word[j:i] in scores]
            way.append(max(ways))
        return way[-1]

    out = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for r in docs.where("doc_id is not null and length(coalesce(text, '')) < 4000").collect():
        words = [best("▁" + w) for w in WORD.findall(r.text or "")]
        got = out[r.doc_id]
        assert (got.n_pretokens, got.n_tokens, got.score) == (len(words), -sum(x[1] for x in words), sum(x[0] for x in words)), r.text


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_langid_without_letters(docs, spark):
    odd = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd.values())
    labelled = spark.createDataFrame([(i, t, la, None, None, None) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 8)] + [(99, "12 %", None, None, None, None), (98, None, "en", None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(labelled).collect()}
    assert got[99].lang_pred == got[98].lang_pred == "und"
    assert {got[0].lang_pred, got[1].lang_pred} == {"en", "fr"}
    assert {r.doc_id for r in langid.keep_identified(labelled).collect()} == set(range(16))


def test_ids_digest(spark):
    df = spark.createDataFrame([([1, 23, 456],), ([],)], "ids array<int>").select(byte_bpe.ids_sha256("ids").alias("h"))
    assert [r.h for r in df.collect()] == [hashlib.sha256(b"1,23,456").hexdigest(), hashlib.sha256(b"").hexdigest()]
