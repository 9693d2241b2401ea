import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from juryframe.llm.mixing import mix_documents, take_copies
from juryframe.llm.queries import op1_mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(totals, weights, share, cap):
    """Shares by weight, the excess of capped sources dealt out again until none is above its cap."""
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * totals[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = cap * totals[s]
            left -= out[s]
        open_ -= over
    return out


def test_against_brute_force(spark, documents, prose):
    rows = [(i, prose(3 + (i * 37) % 190, i), "en", [None, "a", "b", "", "ü", "z", "c"][i % 7]) for i in range(700)]
    rows += [(1000 + i, prose(40, 1), "en", "a") for i in range(300)]
    found = mix_documents(documents(rows)).collect()
    sizes = {i: len(WORD.findall(t)) for i, t, _, _ in rows}
    totals = defaultdict(int)
    for i, _, _, s in rows:
        totals[s] += sizes[i]
    targets, taken = expected_targets(totals, (5, 2, 1), 1.5, 2), defaultdict(int)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(totals.values()))
    for r in found:
        assert r["mix_size"] == sizes[r["doc_id"]] and r["mix_source_size"] == totals[r["source"]]
        assert r["mix_target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["mix_copies"] <= 2 and 0 <= r["mix_rate"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    assert all(abs(taken[s] - targets[s]) <= 0.005 * targets[s] + 5 for s in targets)
    # Rates are tilted exponentially: their logarithms are proportional to size where the cap does not bind.
    import math

    for s in targets:
        slopes = [math.log(r["mix_rate"]) / r["mix_size"] for r in found if r["source"] == s and 0 < r["mix_rate"] < 1.99]
        assert not slopes or max(slopes) - min(slopes) < 1e-9


def test_same_result_however_dealt(documents, prose):
    df = documents([(i, prose(5 + i % 50, i), "en", "ab"[i % 2]) for i in range(200)])
    a, b = ({r["doc_id"]: r["mix_copies"] for r in mix_documents(x).collect()} for x in (df, df.repartition(7, "text")))
    assert a == b


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows)
    mixed = mix_documents(df)
    assert mixed.count() == len(odd_rows) and set(df.columns) <= set(mixed.columns)
    assert {r["mix_size"] for r in mixed.filter("text is null").collect()} == {0}
    copies = sum(r["mix_copies"] for r in mixed.collect())
    taken = take_copies(mixed, df.columns)
    assert taken.count() == copies and taken.columns == df.columns


def test_clashing_columns_stay(documents, prose):
    from pyspark.sql import functions as F

    mine = {c: F.lit(42) for c in ("__src", "__hash", "__salt", "__before", "__n", "__copies", "__copy", "__parts", "SRC", "mix_size")}
    df = documents([(i, prose(10 + i, i), "en", "ab"[i % 2]) for i in range(30)]).withColumns(mine)
    mixed = mix_documents(df, prefix="m_")
    rows = take_copies(mixed, df.columns, prefix="m_").select(*mine).collect()
    assert len(rows) == sum(r["m_copies"] for r in mixed.collect()) and set(map(tuple, rows)) == {(42,) * len(mine)}


def test_large_cells_are_dealt(documents, prose, monkeypatch):
    from collections import Counter

    from juryframe.llm import mixing

    df = documents([(i if i % 3 else None, prose(20, i), "en", "ab"[i % 2]) for i in range(400)])
    whole = Counter((r["source"], r["mix_copies"]) for r in mix_documents(df).collect())
    monkeypatch.setattr(mixing, "LARGE_CELL", 10)
    assert Counter((r["source"], r["mix_copies"]) for r in mix_documents(df).collect()) == whole


def test_empty(documents):
    mixed = mix_documents(documents([]))
    assert mixed.count() == 0 and "mix_copies" in mixed.columns


def test_only_wordless(documents):
    rows = mix_documents(documents([(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert sorted((r["mix_target"], r["mix_copies"]) for r in rows) == [(0.0, 1), (0.0, 1)]


def test_query(spark, sf_dir):
    found = op1_mixture(spark, sf_dir)
    assert found.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert found.filter((F.col("taken") > 2 * F.col("size"))).isEmpty()


def test_texts_do_not_move(spark, sf_dir):
    """What is shuffled for the query are hashes and sizes; its scan is the only place that sees texts."""
    plan = op1_mixture(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line]
    assert exchanged and not any("text#" in line for line in exchanged)


def test_query_is_that_of_the_operator(spark, documents, odd_rows, tmp_path):
    """Sizes, targets and words taken against plain Python over all rows."""
    from collections import defaultdict

    documents(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op1_mixture(spark, str(tmp_path)).collect()
    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, _, s in odd_rows:
        sizes[s] += words(t)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=key) == sorted(((i, words(t)) for i, t, _, _ in odd_rows), key=key)
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order) if sizes[s]}
    total, target = 1.5 * sum(sizes.values()), {s: 0.0 for s in order}
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        for s in over or list(left):
            target[s] = 2 * sizes[s] if over else share[s]
            total -= target[s]
            del left[s]
    by_size = defaultdict(set)
    for s in order:
        by_size[sizes[s]].add(round(target[s], 3))
    for r in found:
        assert round(r["target"], 3) in by_size[r["source_size"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
