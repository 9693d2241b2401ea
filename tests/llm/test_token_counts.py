import math
import re

import pytest

from juryframe.llm import token_counts
from juryframe.llm.queries import op3_token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def scores():
    return token_counts.piece_scores("piece_bpe_32k.model", 2.7)


def brute_force(word, scores, byte_score):
    """Plain Viterbi over one pre-token."""
    text, longest = token_counts.MARK + word, max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, -(best[end - 1][1] + size))]
        for start in range(max(0, end - longest), end):
            if text[start:end] in scores:
                options.append((best[start][0] + scores[text[start:end]], -(best[start][1] + 1)))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_scores_are_probabilities(scores):
    assert sum(map(math.exp, scores.values())) == pytest.approx(1)


def test_trie_against_brute_force(scores, prose):
    trie = token_counts.PrefixTrie(scores, -30.0)
    words = {*prose(400, 1).split(), "漢字", "😀x", "é", "Straße!", "a" * 50, "the", "then", "there"}
    for w in words:
        assert trie.count(w.encode()) == brute_force(w, scores, -30.0)
    nodes = len(trie.best)
    assert trie.count(b"then") == trie.terminal[b"then"] and len(trie.best) == nodes  # nothing is computed twice


def test_restart_changes_nothing(scores, prose, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 50)
    trie = token_counts.PrefixTrie(scores, -30.0)
    assert [trie.count(w.encode()) for w in prose(60, 2).split()] == [brute_force(w, scores, -30.0) for w in prose(60, 2).split()]


def test_odd_rows(documents, odd_rows, scores):
    found = sorted(token_counts.count_tokens(documents(odd_rows)).collect(), key=str)
    expected = [(i, len(w := WORD.findall(t or "")), sum(brute_force(x, scores, -30.0) for x in w)) for i, t, _, _ in odd_rows if t is None or len(t) < 10_000]
    assert sorted([tuple(r) for r in found if r["doc_id"] != 5], key=str) == sorted(expected, key=str)
    assert [r["n_pretokens"] for r in found if r["doc_id"] == 5] == [60_000]


def test_long_pretokens_need_constant_memory(scores, documents, monkeypatch):
    trie = token_counts.PrefixTrie(scores, -30.0)
    for word in ("then" * 70, "漢" * 300, "ab" * 200 + "é"):
        assert trie.count(word.encode()) == brute_force(word, scores, -30.0) and len(trie.best) == 1
    import tracemalloc

    word = ("QUJDREVGR0hJSktM" * 20_000).encode()
    tracemalloc.start()
    n = trie.count(word)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(word) + 1_000_000 and not trie.terminal
    tracemalloc.stop()
    assert [tuple(r) for r in token_counts.count_tokens(documents([(1, word.decode(), "en", "a")])).collect()] == [(1, 1, n)]


def test_empty(documents):
    assert token_counts.count_tokens(documents([])).count() == 0


def test_query(spark, sf_dir, scores):
    found = {r["doc_id"]: r for r in op3_token_counts(spark, sf_dir).collect()}
    known = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = WORD.findall(r["text"] or "")
        n = sum(known.setdefault(w, None) or known.update({w: brute_force(w, scores, -30.0)}) or known[w] for w in words)
        assert (found[r["doc_id"]]["n_pretokens"], found[r["doc_id"]]["n_tokens"]) == (len(words), n)
