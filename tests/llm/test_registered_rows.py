"""Each registered query over the smallest tables, whole, against plain Python."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from quadloom.llm import queries, token_counts
from tests.llm.test_substrings import brute
from tests.llm.test_text_operators import WORD, brute_fingerprint


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


def test_op1(spark, sf, texts):
    scores, byte = token_counts.piece_scores(open(public.path(token_counts.PIECES), "rb").read())
    known = {}

    def best(word):
        if word not in known:
            way = [(0, 0)]
            for i in range(1, len(word) + 1):
                n = len(word[i - 1].encode())
                ways = [(way[i - 1][0] + n * byte, way[i - 1][1] - n)] if word[i - 1] not in scores else []
                ways += [(way[j][0] + scores[word[j:i]], way[j][1] - 1) for j in range(i) if word[j:i] in scores]
                way.append(max(ways))
            known[word] = way[-1]
        return known[word]

    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.score) for r in run(spark, sf, "op1_token_counts")}
    words = {i: [best("▁" + w) for w in WORD.findall(t)] for i, t in texts.items()}
    assert got == {i: (len(w), -sum(x[1] for x in w), sum(x[0] for x in w)) for i, w in words.items()}


def test_op3(spark, sf, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: plain.encode_ordinary(t) for i, t in texts.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, sf, "op3_byte_bpe")}
    assert got == {i: (len(x), digest(",".join(map(str, x)).encode()), digest(texts[i].encode())) for i, x in want.items()}


def test_op4(spark, sf, texts):
    got = run(spark, sf, "op4_langid")
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    lettered = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == set(texts) - lettered


def test_op5(spark, sf, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = set()
    for i, t in texts.items():
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        for k, p in enumerate(range(0, len(ids), 4096)):
            want.add((i, k, p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes())))
    got = run(spark, sf, "op5_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096


def test_op6(spark, sf, texts):
    for r in run(spark, sf, "op6_quality"):
        words = WORD.findall(texts[r.doc_id])
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(grams)
        repeat = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_op7(spark, sf, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, sf, "op7_simhash")} == {(i, f"{prints[i]:016x}", label[i]) for i in texts}


def jump(key, n):
    """The published walk, one key at a time."""
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_op8(spark, sf, texts):
    import xxhash

    got = run(spark, sf, "op8_sharding")
    # the session's own hash of a string has seed 42
    key = {i: xxhash.xxh64_intdigest(str(i), 42) for i in texts}
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key", jump(key[i], 8), jump(key[i], 9)) for i, t in texts.items()}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_op9(spark, sf, texts):
    want = {i: (len(t.encode()), len(t.encode()) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) for (i, (kept, runs)), t in zip(brute(texts.items(), 100).items(), (texts[i] for i in sorted(texts)), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op9_suffix_dedup")} == want


def test_op10(spark, sf, texts):
    import regex

    from quadloom.llm import pii

    got = {r.doc_id: r for r in run(spark, sf, "op10_pii")}
    assert set(got) == set(texts)
    some = regex.compile(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    every, stand = set(), {}
    for i, t in texts.items():
        found, made = some.findall(t), got[i]
        assert made.n_entities == len(found)
        every |= set(found)
        # what stands between entities is unchanged, and equal entities have equal surrogates
        rest = some.split(t)
        at = 0
        for k, part in enumerate(rest):
            start = made.text.index(part, at) if part else at
            if k and part:
                stand.setdefault(found[k - 1], set()).add(made.text[at:start])
            at = start + len(part)
    assert not {x for v in stand.values() for x in v} & every
