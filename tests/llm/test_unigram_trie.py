"""The trie's forward scores against a plain pass over each word, on random vocabularies."""

import random

import pytest

from quadloom.llm import token_counts


def plain(word, scores, byte):
    way = [(0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        ways = [] if word[i - 1] in scores else [(way[i - 1][0] + n * byte, way[i - 1][1] - n)]
        ways += [(way[j][0] + scores[word[j:i]], way[j][1] - 1) for j in range(i) if word[j:i] in scores]
        way.append(max(ways))
    return way[-1][0], -way[-1][1]


@pytest.mark.parametrize("seed", range(8))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    letters = "abcé漢"[: rng.randint(2, 5)]
    some = lambda most: "".join(rng.choices(letters, k=rng.randint(1, most)))
    # few distinct scores, so that ways of equal score with more and fewer tokens occur
    scores = {some(5): -rng.randint(1, 6) for _ in range(rng.randint(0, 40))}
    trie = token_counts.UnigramTrie(scores, -9)
    words = [some(14) for _ in range(300)]
    assert [trie.insert(w) for w in words] == [plain(w, scores, -9) for w in words]
    assert [trie.insert(w) for w in sorted(words)] == [plain(w, scores, -9) for w in sorted(words)]


def test_emptied_trie_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    scores = {"a": -1, "ab": -1, "b": -3, "bc": -2}
    trie = token_counts.UnigramTrie(scores, -9)
    words = ["abc", "abcabc", "bcb", "aaaa", "cab"] * 3
    assert [trie.insert(w) for w in words] == [plain(w, scores, -9) for w in words]
