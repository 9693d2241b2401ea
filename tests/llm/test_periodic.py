import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from juryframe.llm import periodic
from juryframe.llm.queries import op11_periodic_runs


def brute(a, least=24, power=3):
    """(start, length, period) by comparing words at every distance."""
    out = []
    for q in range(1, len(a) // power + 1):
        i = 0
        while i + q < len(a):
            j = i
            while j + q < len(a) and a[j] == a[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q) and not any(a[i : i + length - r] == a[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repeating(draw):
    """Few different words, and stretches that go round."""
    a = draw(st.lists(st.integers(0, draw(st.integers(0, 4))), max_size=90))
    for _ in range(draw(st.integers(0, 3))):
        if len(a) > 3:
            start = draw(st.integers(0, len(a) - 1))
            q = draw(st.integers(1, max(1, (len(a) - start) // 3)))
            for i in range(start + q, min(len(a), start + draw(st.integers(3, 60)))):
                a[i] = a[i - q]
    return a


@settings(max_examples=400, deadline=None)
@given(repeating(), st.sampled_from([(24, 3), (4, 2), (1, 2), (9, 3), (10, 4)]))
def test_runs_are_those_of_all_distances(a, least):
    assert periodic.runs_of(a, *least) == brute(a, *least)


@pytest.mark.parametrize("prime", [3, 7, 31])
def test_runs_survive_colliding_hashes(prime, monkeypatch):
    """Hashes of a few bits collide all the time; what is reported is a run all the same."""
    monkeypatch.setattr(periodic, "_PRIME", prime)
    monkeypatch.setattr(periodic, "_powers", periodic.array("Q", [1]))
    rng = random.Random(prime)
    for _ in range(60):
        a = [rng.randrange(3) for _ in range(80)]
        for i in range(20 + 11, 75):
            a[i] = a[i - 11]
        assert set(periodic.runs_of(a)) <= set(brute(a))


def test_long_periodic_texts_take_little_time():
    n = 100_000
    assert periodic.runs_of([0] * n) == [(0, n, 1)]
    assert periodic.runs_of([i % 7 for i in range(n)]) == [(0, n, 7)]
    half = list(range(n // 2))
    assert periodic.runs_of(half + half) == []
    assert periodic.runs_of(half + half, 24, 2) == [(0, n, n // 2)]


def edited(doc_id, words):
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = edited(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def same(found, rows):
    assert found.columns == COLUMNS
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_on_odd_rows(spark, documents, odd_rows, tmp_path, prose):
    edges = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = odd_rows + [(i, prose(40 * k, i), "en", "a") for k, i in enumerate(edges)] + [(500, "a b " * 40 + "c", None, None), (501, "a b c", None, None)]
    rows = [(i, t if t is None or len(t) < 100_000 else " ".join(t.split()[:900]), lang, s) for i, t, lang, s in rows]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(op11_periodic_runs(spark, str(tmp_path)), [(i, t) for i, t, _, _ in rows])


def test_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_periodic_runs(spark, str(tmp_path)).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(op11_periodic_runs(spark, sf_dir), rows)


def test_operator_keeps_columns_and_text(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_BYTES", 10)
    df = spark.createDataFrame([("k", "x  y\n" * 20 + "z", 1), ("l", None, 2), ("m", "x x x x", 3)], "k string, body string, runs int")
    found = periodic.periodic_runs(df, text_col="body", keep=("k",), least_length=4).collect()
    assert [(r["k"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in sorted(found)] == [("k", 41, [(0, 40, 2)], "x y z"), ("l", 0, [], ""), ("m", 4, [(0, 4, 1)], "x")]
