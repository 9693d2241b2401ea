import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from juryframe.operators import voting
from juryframe.operators.voting import combine, combined



def build(lists, compat=True):
    """The network in words."""
    numbers = {}
    network = voting.build([np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64) for words in lists], compat)
    names = ["", *numbers]
    return [[names[i] for i in slot] for slot in network.tolist()]


UNIFORM, PRIOR = (1 / 3, 1 / 3, 1 / 3), (0.256, 0.293, 0.451)


@pytest.mark.parametrize(
    ("texts", "weights", "network", "result"),
    [
        (("a b c", "a b c", "a x c"), UNIFORM, [["a", "a", "a"], ["b", "b", "x"], ["c", "c", "c"]], "a b c"),
        (("a", "b", "c"), UNIFORM, [["a", "b", "c"]], "a"),
        (("a", "b", "c"), PRIOR, [["a", "b", "c"]], "c"),
        (("a b", "a", "a"), UNIFORM, [["a", "a", "a"], ["b", "", ""]], "a"),
        (("a", "a b", "a b"), UNIFORM, [["a", "a", "a"], ["", "b", "b"]], "a b"),
        (("", "x y", "x z"), UNIFORM, [["x", "x"], ["y", "z"]], "x y"),
        (("", "", ""), UNIFORM, [], ""),
    ],
)
def test_worked_examples(texts, weights, network, result):
    assert build([t.split() for t in texts]) == network
    assert combine(texts, weights) == result


def test_fixed_width():
    assert build([[], ["x", "y"], ["x", "z"]], compat=False) == [["", "x", "x"], ["", "y", "z"]]
    assert combine(["", "x y", "x z"], UNIFORM, compat=False) == "x"


def test_null_hypothesis_is_a_word():
    assert combine([None, "None", "b"], UNIFORM) == "None"


words = st.lists(st.sampled_from("abcd"), max_size=7)


@settings(max_examples=60, deadline=None)
@given(words, words, words)
def test_network_keeps_every_hypothesis(a, b, c):
    network = build([a, b, c], compat=False)
    for k, own in enumerate((a, b, c)):
        assert [slot[k] for slot in network if slot[k]] == own


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_merge_has_least_cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    merged = build([a, b], compat=False)
    assert sum(s[0] != s[1] for s in merged) == row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
    return out


def test_vote_prefers_the_first_of_equals():
    assert voting.vote(np.array([[2, 1]]), (0.5, 0.5)).tolist() == [2]
    assert voting.vote(np.array([[0, 1]]), (0.5, 0.5)).tolist() == []


def test_long_texts_take_little_room(monkeypatch):
    """Costs are kept as bits, a few for each pair of words, and several votes share a network."""
    import tracemalloc

    rng = np.random.default_rng(1)
    long = [f"w{i}" for i in rng.integers(0, 300, 4000)]
    texts = [" ".join(long), " ".join(w for i, w in enumerate(long) if i % 5), " ".join(w for i, w in enumerate(long) if i % 7)]
    tracemalloc.start()
    assert len(combine(texts, UNIFORM).split()) > 3500
    assert tracemalloc.get_traced_memory()[1] < 4000 * 4000
    tracemalloc.stop()
    calls, own = [], voting.build
    monkeypatch.setattr(voting, "build", lambda *a: (calls.append(1), own(*a))[1])
    hypotheses = ("a", "b", "c")
    assert voting.combine_each(hypotheses, [UNIFORM, PRIOR]) == ["a", "c"] and len(calls) == 1


def test_column(spark):
    df = spark.createDataFrame([(["a b", "a", "a"],)], "h array<string>")
    assert df.select(combined(F.col("h"), F.array(*[F.lit(w) for w in UNIFORM]))).first()[0] == "a"


def plain_rover(texts, weights):
    """The same rules over lists of words, by a table of least costs to the end of each prefix."""
    network = []
    for text in texts:
        words, n = text.split(), len(network)
        cost = {(0, j): j for j in range(len(words) + 1)} | {(i, 0): i for i in range(n + 1)}
        miss = lambda i, j: words[j] not in network[i]  # noqa: E731, B023
        for i in range(1, n + 1):
            for j in range(1, len(words) + 1):
                cost[i, j] = min(cost[i - 1, j - 1] + miss(i - 1, j - 1), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        i, j, out, gaps = n, len(words), [], [""] * (len(network[0]) if network else 0)
        while (i, j) != (0, 0):
            ways = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
            prices = [miss(i - 1, j - 1) if i and j else None, 1 if i else None, 1 if j else None]
            way = next(k for k in range(3) if prices[k] is not None and cost[ways[k]] + prices[k] == cost[i, j])
            out.insert(0, [*(gaps if way == 2 else network[i - 1]), "" if way == 1 else words[j - 1]])
            i, j = ways[way]
        network = out
    won = []
    for slot in network:
        sums = {}
        for word, weight in zip(slot, weights, strict=False):
            sums[word] = sums.get(word, 0) + weight
        won.append(max(sums, key=lambda w: sums[w]))
    return " ".join(w for w in won if w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def test_queries_against_plain_python(spark, sf_dir):
    """Voted texts, error rates, weights from the train split and summaries, over all clips."""
    from juryframe.plans.catalogue import QUERIES
    from juryframe.schema import EXPERTS
    from juryframe.sources import adapters

    clips = {r["clip_id"]: r for r in adapters.hypotheses(spark, sf_dir).collect()}
    rover, weighted = ({r["clip_id"]: r for r in QUERIES[q](spark, sf_dir).collect()} for q in ("rover", "weighted_rover"))
    assert set(rover) == set(weighted) == set(clips) and {r["split"] for r in rover.values()} == {"train", "val", "test"}
    train = [c for c in clips if rover[c]["split"] == "train"]
    rates = {e: sum(distance(clips[c]["ref"], clips[c][e]) / len(clips[c]["ref"]) for c in train) / len(train) for e in EXPERTS}
    raw = [max(1 - rates[e], 1e-6) for e in EXPERTS]
    prior = [x / sum(raw) for x in raw]
    assert {r["expert"]: r["weight"] for r in QUERIES["rover_weights"](spark, sf_dir).collect()} == pytest.approx(dict(zip(EXPERTS, prior, strict=True)), abs=2e-6)
    sums = {}
    for found, weights, method in ((rover, UNIFORM, "rover"), (weighted, prior, "weighted_rover")):
        for c, row in found.items():
            ref = clips[c]["ref"]
            voted = plain_rover([" ".join(clips[c][e]) for e in EXPERTS], weights)
            edits = distance(ref, voted.split())
            assert (row["voted"], row["edits"], row["n_ref"]) == (voted, edits, len(ref))
            assert row["wer"] == pytest.approx(edits / len(ref))
            sums.setdefault((row["split"], method), []).append((edits, len(ref)))
    for r in QUERIES["rover_summary"](spark, sf_dir).collect():
        pairs = sums.pop((r["split"], r["method"]))
        own = np.array([e / n for e, n in pairs])
        assert r["n"] == len(own) and r["wer_mean"] == pytest.approx(own.mean(), abs=2e-6)
        assert r["wer_sem"] == pytest.approx(own.std(ddof=1) / len(own) ** 0.5, abs=2e-6)
        assert r["wer_corpus"] == pytest.approx(sum(e for e, _ in pairs) / sum(n for _, n in pairs), abs=2e-6)
    assert not sums
