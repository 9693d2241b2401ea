import random

import pytest

import corpus_pipeline
from juryframe.llm import banding, near_text, odd_sketch
from tests.llm.test_simhash import fingerprint


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_roots(texts):
    """The smallest place that links of true similarity reach, over all pairs."""
    sets, root = [grams(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def changed(text, places, seed):
    words, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(len(words)), places):
        words[i] = f"other{seed}x{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts(prose):
    """Near copies at every likeness, one large group, chains, a common passage, short and empty texts."""
    passage = prose(90, 900)
    out = [changed(prose(200, 30 + i % 12), i % 9, i) for i in range(60)]
    out += [f"{passage} {prose(8 + i % 30, 1000 + i)}" for i in range(30)]
    out += [changed(prose(80, 7), 1, 500 + i) for i in range(30)]
    return out + ["", None, "one", "one", "One two", "a b c d e f", "a b c d e f g"]


def test_groups_are_those_of_all_pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r["k"]: r["root"] for r in near_text.near_texts(df, key_col="k").collect()}
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    assert [least[found[k]] for k in range(len(texts))] == brute_roots(texts)


def test_large_groups_in_small_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(banding, "CHUNK", 8)
    test_groups_are_those_of_all_pairs(spark, texts)


def test_hot_passage_is_not_compared_word_by_word(spark, prose, monkeypatch):
    """Texts that share a long passage but are not similar: few are fetched to be compared."""
    passage, fetched, own = prose(60, 900), [], odd_sketch._fetched
    monkeypatch.setattr(banding, "CHUNK", 16)
    monkeypatch.setattr(odd_sketch, "_fetched", lambda nodes, *rest: (fetched.append(nodes.count()), own(nodes, *rest))[1])
    texts = [f"{passage} {prose(60, 1000 + i)}" for i in range(120)]
    texts += [changed(texts[7], 2, 1), changed(texts[100], 2, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r["k"]: r["root"] for r in near_text.near_texts(df, key_col="k").collect()}
    assert found[7] == found[120] and found[100] == found[121] and len(set(found.values())) == 120
    assert sum(fetched) < len(texts) / 2


def test_stage_removes_near_copies_beyond_two_bits(spark, prose, tmp_path):
    base = prose(300, 1)
    near, other = changed(base, 4, 1), changed(base, 40, 2)
    assert bin(fingerprint(base) ^ fingerprint(near)).count("1") > 2
    rows = [(1, base), (2, near), (3, other), (None, prose(60, 2)), (None, prose(60, 3)), (None, prose(60, 3)), (4, prose(60, 4)), (4, prose(60, 5))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 1, 3, 4, 4]
