import numpy as np
import pytest

from juryframe.llm import banding, odd_sketch
from juryframe.llm.queries import op12_odd_sketches
from tests.llm.test_near_text import changed


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def expected(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def same(found, rows):
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected(rows), key=key)


@pytest.fixture(scope="module")
def texts(prose):
    """Near copies on both sides of the limit, a group whose texts are near the original but not one another, chains, a common passage."""
    passage = prose(90, 900)
    out = [changed(prose(200, 30 + i % 12), i % 12, i) for i in range(72)]
    out += [f"{passage} {prose(4 + i % 30, 1000 + i)}" for i in range(40)]
    out += [changed(prose(100, 7), 2, 500 + i) for i in range(40)]
    chain = prose(120, 8).split()
    out += [" ".join(chain[3 * i : 3 * i + 90]) for i in range(10)]
    return out


def test_components_are_those_of_all_pairs(spark, documents, odd_rows, texts, tmp_path):
    rows = odd_rows + [(1000 - i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None), (2000, texts[1].upper(), "en", "b"), (2001, texts[1].replace(" ", "\t\n"), "en", "b")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(op12_odd_sketches(spark, str(tmp_path)), [(i, t) for i, t, _, _ in rows])


def test_empty_table_and_nothing_alike(spark, documents, prose, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert op12_odd_sketches(spark, f"{tmp_path}/a").count() == 0
    rows = [(i, prose(50, i) if i else None, "en", "a") for i in range(5)]
    documents(rows).write.parquet(f"{tmp_path}/b/documents.parquet")
    same(op12_odd_sketches(spark, f"{tmp_path}/b"), [(i, t) for i, t, _, _ in rows])


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(op12_odd_sketches(spark, sf_dir), rows)


def test_scratch_is_removed(spark, documents, prose):
    import os

    from juryframe.llm.common import shared_dir

    place = shared_dir(spark).removeprefix("file:")
    docs = documents([(i, changed(prose(60, 1), i % 2, i), "en", "a") for i in range(6)]).cache()
    before = {x for x in os.listdir(place) if x.startswith("table-")}
    odd_sketch.near_duplicates(docs).collect()
    assert len({x for x in os.listdir(place) if x.startswith("table-")} - before) <= 3  # what the lazy result reads


def sets_of(similarity, size, rng):
    x = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
    both, half = int(similarity * size), (size - int(similarity * size)) // 2
    return x[: both + half], np.concatenate([x[:both], x[both + half :]])


@pytest.mark.parametrize("similarity", [0.85, 0.9, 0.97])
def test_sketches_estimate_high_similarities(similarity):
    rng = np.random.default_rng(7)
    bits = []
    for _ in range(200):
        a, b = (odd_sketch.odd_sketch(odd_sketch.samples(x)) for x in sets_of(similarity, 400, rng))
        bits.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
    estimates = [odd_sketch.estimate(x) for x in bits]
    assert abs(np.mean(estimates) - similarity) < 0.01 and np.std(estimates) < 0.03
    assert max(bits) <= odd_sketch.most_differing()


def test_hardly_a_pair_at_the_limit_shares_no_band():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a, b = (odd_sketch.band_keys(odd_sketch.samples(x)) for x in sets_of(0.85, 300, rng))
        assert np.any(a == b)


def test_template_pairs_are_told_apart_by_sketches(spark, prose, tmp_path, documents, monkeypatch):
    """Texts that share half of their shingles meet in bands, but hardly a text is fetched and compared word by word."""
    passage, fetched, own = prose(100, 5), [], odd_sketch._fetched
    monkeypatch.setattr(odd_sketch, "_fetched", lambda nodes, *rest: (fetched.append(nodes.count()), own(nodes, *rest))[1])
    rows = [(i, f"{passage} {prose(70, 2000 + i)}", "en", "a") for i in range(300)]
    rows += [(300 + i, changed(rows[i][1], 2, i), "en", "a") for i in range(20)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(op12_odd_sketches(spark, str(tmp_path)), [(i, t) for i, t, _, _ in rows])
    assert sum(fetched) < 100


def test_large_groups_in_small_blocks(spark, documents, texts, tmp_path, monkeypatch):
    """Blocks of a few texts, sets that are not kept, and many near copies just below the limit of one another."""
    monkeypatch.setattr(banding, "CHUNK", 5)
    monkeypatch.setattr(odd_sketch, "KEPT_BYTES", 4000)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    base = texts[0]
    rows += [(1000 + i, changed(base, 6 + i % 4, 3000 + i), "en", "a") for i in range(60)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(op12_odd_sketches(spark, str(tmp_path)), [(i, t) for i, t, _, _ in rows])
