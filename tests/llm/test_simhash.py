import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from juryframe.llm import simhash
from juryframe.llm.graph import components
from juryframe.llm.queries import op5_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        counts += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(fps):
    """Root (smallest position) of each fingerprint's component, over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array(fps, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def linked_components(spark, fps, **kw):
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long"), **kw)).collect()}
    return [found.get(f, f) for f in signed]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def near(rng, base, flips):
    return base ^ sum(1 << b for b in rng.sample(range(64), flips))


@pytest.mark.parametrize("group", [256, 2])
def test_links_against_all_pairs(spark, group):
    rng = random.Random(group)
    bases = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = sorted({near(rng, b, k) for b in bases for k in (0, 1, 2, 3, 4, 5) for _ in range(6)})
    assert same_partition(linked_components(spark, fps, group=group), brute_components(fps))


def test_a_large_group_of_neighbours(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base, *(near(rng, base, k) for k in (1, 2, 3) for _ in range(300))})
    assert same_partition(linked_components(spark, fps, group=16), brute_components(fps))


def test_every_pair_shares_a_block():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = near(rng, x, rng.randint(0, 2))
        keys = (x, y)
        masks = [simhash._mask(b) for b in simhash.BLOCKS]
        shared = [i for i, m in enumerate(masks) if (keys[0] ^ keys[1]) & m == 0]
        assert shared
        for i in shared:
            assert any((keys[0] ^ keys[1]) & simhash._mask(f) == 0 for f in simhash.FINER[i])
        assert np.abs(simhash.coordinates(np.array([x], np.uint64), simhash.PIVOTS) - simhash.coordinates(np.array([y], np.uint64), simhash.PIVOTS)).max() <= 2


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (900, 901)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert components(links.limit(0)).count() == 0


def check(rows, found):
    fps = [fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(found, key=str) == expected


def test_odd_rows(documents, odd_rows):
    found = [(r["doc_id"], f"{np.int64(r['fp']).view(np.uint64):016x}", r["component_id"]) for r in simhash.near_duplicates(documents(odd_rows)).collect()]
    check([(i, t) for i, t, _, _ in odd_rows], found)


def test_only_null_ids(documents):
    found = simhash.near_duplicates(documents([(None, "a b c", "en", "a"), (None, "a b c", "en", "a")])).collect()
    assert [r["component_id"] for r in found] == [None, None]


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, sf_dir).collect()])


def test_near_groups_use_fingerprints(spark, prose, monkeypatch):
    """Without bands of MinHash values, texts whose fingerprints are linked are found and verified, and no others."""
    from juryframe.llm import banding
    from tests.llm.test_near_text import changed, grams

    base = prose(400, 1)
    near = next(t for i in range(500) if 0 < bin(fingerprint(base) ^ fingerprint(t := changed(base, 1, i))).count("1") <= 2)
    assert 5 * len(grams(base) & grams(near)) >= 4 * len(grams(base) | grams(near))
    monkeypatch.setattr(banding, "members", lambda nodes, scratch: nodes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("lead")).filter("false"))
    rows = [(0, base), (1, near), (2, prose(300, 2)), (3, base), (4, "a b"), (5, "")]
    found = {r["k"]: r["root"] for r in simhash.near_groups(spark.createDataFrame(rows, "k long, text string"), key_col="k").collect()}
    assert found[0] == found[1] == found[3] and len(set(found.values())) == 4


def test_joins_of_growing_tables_are_shuffles(spark, prose, monkeypatch):
    """No join side but the bitmap of fixed size is broadcast, however small its file."""
    from juryframe.llm import common, odd_sketch

    plans, own = [], common.written
    explained = lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df, *rest))[1]
    monkeypatch.setattr(odd_sketch, "written", explained)
    rows = [(i, prose(50 + i % 3, i % 4)) for i in range(12)]
    simhash.near_groups(spark.createDataFrame(rows, "k long, text string"), key_col="k").count()
    assert len(plans) > 4 and sum("SortMergeJoin" in p for p in plans) > 4
    assert sum(p.count("BroadcastHashJoin") for p in plans) == sum("__bits" in p for p in plans)
