import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from juryframe.llm import kneser_ney as kn
from juryframe.llm.queries import op9_kneser_ney


def padded(text, order):
    """The text between its edges; a NUL is an edge."""
    return kn.EDGE * (order - 1) + text.replace("\0", kn.EDGE) + kn.EDGE


class Plain:
    """Interpolated modified Kneser-Ney by its definition, over tuples."""

    def __init__(self, texts, order):
        self.order = order
        level = Counter()
        for t in texts:
            s = padded(t, order)
            level.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.levels = {order: level}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discount = {}
        self.context = {}
        for k, counts in self.levels.items():
            n = [sum(c == i for c in counts.values()) for i in range(5)]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                self.discount[k] = [max(0, min(i, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
            else:
                self.discount[k] = [0.5, 1.0, 1.5]
            total, left = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += self.discount[k][min(c, 3) - 1]
            self.context[k] = (total, left)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.levels[1]) + 1)
        below = self.p(gram[1:])
        total, left = self.context[k]
        if gram[:-1] not in total:
            return below
        c = self.levels[k].get(gram, 0)
        rate = (c - self.discount[k][min(c, 3) - 1]) / total[gram[:-1]] if c else 0.0
        return rate + left[gram[:-1]] / total[gram[:-1]] * below

    def perplexity(self, text):
        s = padded(text, self.order)
        logs = [math.log(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1)]
        return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model_against_definition(spark, prose, order):
    texts = [*(prose(20 + i, i) for i in range(12)), "a\0b", "Ünï 漢 😀"]
    df = spark.createDataFrame([(t, 0) for t in [*texts, "", None]], "text string, fold int").repartition(3)
    counts, plain = kn.count_grams(df, order), Plain(texts, order)
    assert {r["gram"]: r["c"] for r in counts.filter("model = 1").collect()} == dict(plain.levels[order])
    vocabulary = [*plain.levels[1], "\u3042"]  # all known symbols and an unknown one
    contexts = {g[:-1] for g in list(plain.levels[order])[:40]} | {"\u3042" * (order - 1), ("\u3042a" * order)[: order - 1]}
    asked = spark.createDataFrame([(1, c + w) for c in contexts for w in vocabulary], "model int, gram string")
    found = {r["gram"]: r["p"] for r in kn.probabilities(asked, kn.levels(counts, order)).collect()}
    assert found == pytest.approx({g: plain.p(g) for g in found}, rel=1e-9) and len(found) == len(contexts) * len(vocabulary)
    for c in contexts:
        assert sum(found[c + w] for w in vocabulary) == pytest.approx(1)


def test_grams_do_not_cross_texts(prose, monkeypatch):
    texts = ["ab", "", "c", prose(5, 1), "\0", "漢字 😀"]
    apart = Counter(s[i : i + 4] for s in (padded(t, 4) for t in texts) for i in range(len(s) - 3))
    grams, counts = kn.gram_counts(texts, 4)
    assert dict(zip(grams, counts.tolist(), strict=True)) == apart
    values = np.arange(1.0, len(grams) + 1)
    n, sums = kn.Answers(grams, values, 4).score(texts)
    # Alphabets too large for numbers give the same.
    monkeypatch.setattr(kn, "_fits", lambda base, order: False)
    grams_2, counts_2 = kn.gram_counts(texts, 4)
    assert dict(zip(grams_2, counts_2.tolist(), strict=True)) == apart
    n_2, sums_2 = kn.Answers(grams, values, 4).score(texts)
    known = dict(zip(grams, values, strict=True))
    plain = [sum(known[s[i : i + 4]] for i in range(len(s) - 3)) for s in (padded(t, 4) for t in texts)]
    assert n.tolist() == n_2.tolist() == [len(t) + 1 for t in texts] and sums.tolist() == sums_2.tolist() == plain


def test_filter_passes_all_trusted(spark, documents, prose):
    rows = [(i, "x", "en", "a") for i in range(-500, 500)] + [(None, "x", "en", "a")]
    own = documents(rows).select("doc_id", "text", F.lit(0).alias("fold"))
    ids = spark.createDataFrame([(i,) for i in range(-500, 500, 3)], "doc_id long")
    passed = {r["doc_id"] for r in kn._maybe_trusted(own, ids).collect()}
    assert set(range(-500, 500, 3)) <= passed and len(passed) < 400


def test_classifier(spark, documents, prose):
    rows = [(i, prose(60, i), "en" if i < 300 else "de", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(60, i).split()).upper(), "en", "a") for i in range(30)]
    rows += [(2000, "", "en", "a"), (2001, None, None, None), (2002, prose(60, 7), None, "a")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(None,), (0,)], "doc_id long")
    found = {r["doc_id"]: r for r in kn.classify(documents(rows), trusted, quantile=0.99, least_trusted=100).collect()}
    assert len(found) == len(rows)
    clean = [found[i]["kept"] for i in range(400)]
    assert sum(clean) >= 0.95 * len(clean) and not any(found[1000 + i]["kept"] for i in range(30))
    assert not found[2000]["kept"] and not found[2001]["kept"] and found[2002]["kept"]
    assert found[0]["threshold"] != found[399]["threshold"] and found[399]["threshold"] == found[2002]["threshold"]
    # Each is scored by the model of the other fold.
    fold = {r[0]: r[1] for r in documents(rows).select("doc_id", kn.fold_of(F.col("doc_id"), F.col("text"))).collect()}
    plain = [Plain([t for i, t, _, _ in rows if i < 400 and i % 2 == 0 and fold[i] != k], 4) for k in range(2)]
    assert found[2000]["perplexity"] is None and found[2001]["perplexity"] is None
    for i in (0, 1, 301, 1003, 2002):
        assert found[i]["perplexity"] == pytest.approx(plain[fold[i]].perplexity(dict((r[0], r[1]) for r in rows)[i]), rel=1e-4)


def test_odd_rows(spark, documents, odd_rows):
    trusted = spark.createDataFrame([(1,), (9,)], "doc_id long")
    assert kn.classify(documents(odd_rows), trusted).count() == len(odd_rows)


def test_nothing_trusted(spark, documents, odd_rows):
    found = kn.classify(documents(odd_rows), spark.createDataFrame([], "doc_id long")).collect()
    assert len(found) == len(odd_rows) and all(r["perplexity"] == pytest.approx(1) if r["n_symbols"] else r["perplexity"] is None for r in found)
    assert all(r["kept"] == (r["n_symbols"] > 0) for r in found)
    assert kn.classify(documents([]), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_query_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [(labels[r["doc_id"]], r["kept"]) for r in op9_kneser_ney(spark, sf).collect() if r["doc_id"] in labels]
    good, bad = [k for q, k in found if q == 1], [k for q, k in found if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_blocks_are_bounded(spark, monkeypatch):
    """One id, and none, on a third of all rows each, and long texts: no block is much larger than others."""
    monkeypatch.setattr(kn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(kn, "LONG_TEXT", 1000)
    rows = [(None, f"text {i}") for i in range(1000)] + [(7, f"other {i}") for i in range(1000)] + [(100_000 + i, f"more {i}") for i in range(1000)] + [(i, "x" * (2000 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = kn.with_blocks(df)
    assert blocks.count() == len(rows) and blocks.filter("block is null").count() == 0
    sizes = {r["block"]: (r["n"], r["long"]) for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 1000).alias("long")).collect()}
    assert max(n for b, (n, _) in sizes.items() if b < 0) < 150 and all(n == 1 for n, long in sizes.values() if long)
