import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from juryframe.llm import prefix_trie
from juryframe.llm.queries import op13_prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def expected(rows):
    """The trie by whole prefixes, its subtrees by all pairs of prefix and node."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv_id].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()]


def same(found, rows):
    assert found.columns == COLUMNS
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected(rows), key=key)


def run(spark, rows, place):
    extra = "base long, digest string, chars int, k1 long, total long, tag int"
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(3)
    df.write.parquet(f"{place}/conversations.parquet")
    return op13_prefix_trie(spark, str(place))


@pytest.fixture(scope="module")
def rows():
    """Families that share turns, one conversation under many ids, absent and short bases, nulls, ties and repeated rows."""
    rng, out = random.Random(13), []
    for c in [*range(0, 12), *range(100, 140, 3), *range(205, 230, 2), 310, 311, 299, 7005]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(3)} é😀" * rng.randint(0, 2)))
    out += [(c, t, "user", "the same") for c in range(400, 470) for t in range(4)]
    out += [(500, None, None, None), (500, None, None, None), (500, 0, "", ""), (500, 0, "a", "b"), (500, 0, "ab", ""), (501, 3, None, "x"), (501, 3, None, "x")]
    out += [(None, 0, "user", "of no conversation"), (None, None, None, None), (-1, 0, "user", "y"), (-100, 0, "user", "z"), (2**62, 0, "user", "y")]
    out += [(600, t, "user", f"turn {t % 5}") for t in range(700)] + [(601, t, "user", f"turn {t % 5}") for t in range(650)]
    rng.shuffle(out)
    return out


def test_trie_is_that_of_whole_prefixes(spark, rows, tmp_path):
    same(run(spark, rows, tmp_path), rows)


def test_tries_handed_on_in_parts(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "NODES", 7)
    parts = list(prefix_trie._tries(iter([])))
    assert parts == []
    same(run(spark, rows, tmp_path), rows)


def test_parts_of_a_family_merge(monkeypatch):
    """The sums over parts of a trie are those over the whole, whatever the size of the parts."""
    import pyarrow as pa

    kinds = dict(base=pa.int64(), conv_id=pa.int64(), tag=pa.int32(), total=pa.int64(), before=pa.int64(), leaf=pa.int64(), digest=pa.binary(), chars=pa.int64())
    rows = []
    for c in range(40):
        rows.append((0, c, 0, 20, 0, 1, None, None))
        rows += [(0, c, 1, None, None, None, bytes([c % 3 + t % 2]) * 16, 2) for t in range(10)]
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], names=list(kinds))])  # noqa: B905, E731
    sums = {}
    for nodes in (1 << 16, 5):
        monkeypatch.setattr(prefix_trie, "NODES", nodes)
        for name, f, kept in (("tries", prefix_trie._tries, ("n_convs", "weight")), ("shares", prefix_trie._shares, ("n_leaves", "own_chars"))):
            found, parts = defaultdict(lambda: [0, 0]), 0
            for part in f(batch()):
                parts += 1
                for r in part.to_pylist():
                    if r.get("kind", 0) == 0:
                        found[r["k1"], r["k2"]] = [x + r[k] for x, k in zip(found[r["k1"], r["k2"]], kept, strict=True)]
            assert (parts > 1) == (nodes == 5)
            assert sums.setdefault(name, dict(found)) == dict(found)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path).count() == 0


def test_only_turns_that_are_replaced(spark, tmp_path):
    """A conversation whose base is absent and whose own turns are all replaced has no turns, and ends at the root."""
    few = next(c for c in range(1001, 1100) if prefix_trie.given(c) > 2)
    rows = [(few, 0, "user", "a"), (few, 1, "user", "b")]
    found = run(spark, rows, tmp_path)
    assert [tuple(r) for r in found.collect()] == [(few, 0, None, 1, 0, 1, 0, hashlib.sha256(str(few).encode()).hexdigest())]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op13_prefix_trie(spark, sf_dir), rows)
