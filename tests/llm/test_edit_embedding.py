import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from juryframe.llm import edit_embedding as ee
from juryframe.llm.queries import op7_edit_fingerprints


def plain_walk(text):
    """The embedding step by step: at step j write the character, then move on if its bit at j says so."""
    bits = np.random.default_rng(7).integers(0, 2, (ee.PERIOD, ee.CLASSES), dtype=np.int8)
    bits[0] = 1
    codes = np.array([ord(c) for c in text], np.uint32)
    classes, out, i, j = ee.classes_of(codes), [], 0, 0
    while i < len(text):
        out.append(i)
        i += int(bits[j % ee.PERIOD][classes[i]])
        j += 1
    return out


def plain_symbols(text):
    walked, codes = plain_walk(text), [ord(c) for c in text]
    scale = max(ee.LEAST_SCALE, (len(text) - 1).bit_length() if text else 0)
    out = []
    for s in np.concatenate((ee.sample_steps(scale), ee.sample_steps(scale + 1))).tolist():
        if s >= len(walked):
            out.append(ee.PAD)
            continue
        h, mask = 0, (1 << 64) - 1
        for k in range(3):
            i = walked[s] + k
            h = (h * 0x100000001B3 + (codes[i] if i < len(codes) else 0)) & mask
        out.append((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 60)
    return ee.spelled(scale, np.array(out, np.uint8))


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def check(found, rows):
    """rows: (doc_id, text) in descending order of id."""
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        r, other = by[i], edited(text, rows[(k + 1) % len(rows)][1])
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        if len(text) < 20_000:
            assert r["fingerprint"] == plain_symbols(text) and r["edited_fingerprint"] == plain_symbols(other)
        following = by[rows[(k + 1) % len(rows)][0]]["fingerprint"]
        assert r["near_next"] == ee.likeness(ee.parsed(r["fingerprint"]), ee.parsed(following))
        assert r["near_edited"] == ee.likeness(ee.parsed(r["fingerprint"]), ee.parsed(r["edited_fingerprint"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_odd_rows(documents, odd_rows):
    rows, seen = [], set()
    for i, t, lang, source in odd_rows:
        if i is not None and i not in seen:
            seen.add(i)
            rows.append((i, t, lang, source))
    found = ee.edit_fingerprints(documents(rows).repartition(3)).collect()
    check(found, sorted(((i, t or "") for i, t, _, _ in rows), reverse=True))
    assert ee.edit_fingerprints(documents(odd_rows)).count() == len(odd_rows)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_small_tables(documents, prose, n):
    rows = [(i, prose(1 + 3 * i, i), "en", "a") for i in range(n)]
    check(ee.edit_fingerprints(documents(rows).repartition(5)).collect(), [(i, t) for i, t, _, _ in reversed(rows)])


def test_small_chunks_change_nothing(prose, monkeypatch):
    texts = [prose(5 + 7 * i, i) for i in range(60)]
    a = [ee.spelled(*x) for x in ee.Pairs(texts).own]
    monkeypatch.setattr(ee, "FEW", 1)
    assert [ee.spelled(*x) for x in ee.Pairs(texts).own] == a


def test_likeness_falls_with_edits(prose):
    rng, text = random.Random(1), prose(600, 1)
    one = lambda t: ee.Pairs([t]).own[0]
    last = 1.01
    for edits in (0, 3, 30, 300):
        chars = list(text)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                del chars[at]
            else:
                chars.insert(at, "z")
        now = ee.likeness(one(text), one("".join(chars)))
        assert now < last
        last = now
    assert ee.likeness(one(text), one(text)) == 1.0
    assert ee.likeness(one(text), one(prose(600, 2))) < 0.1
    assert ee.likeness(one(""), one("")) == 1.0 and ee.likeness(one(""), one(text)) == 0.0


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(x) for x in range(n)]


def substituted(text, places, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), places):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_recall_against_all_pairs(documents, prose):
    """Clusters of texts with up to six words changed, some of them about as long as a scale or with a common opening."""
    rng, texts = random.Random(3), []
    for c in range(40):
        base = prose((150, 150, 60, 400)[c % 4], 100 + c)
        if c % 5 == 0:
            base = (base * 3)[: rng.choice([1010, 1024, 1040, 2040])]
        texts += [substituted(base, rng.randint(0, 6), rng) for _ in range(12)]
    opening = prose(40, 99)
    texts += [f"{opening} {prose(60, 5000 + i)}" for i in range(60)]
    found = {r["doc_id"]: r for r in ee.edit_fingerprints(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    scales, samples = ee._stacked(pa.array([found[i]["fingerprint"] for i in range(len(texts))]))
    pairs = []
    for i in range(1, len(texts)):
        row = (np.full(i, scales[i]), np.repeat(samples[i][None], i, axis=0))
        near = ee.likenesses(row, (scales[:i], samples[:i]))
        assert near[0] == ee.likeness(ee.parsed(found[i]["fingerprint"]), ee.parsed(found[0]["fingerprint"]))
        pairs += [(int(j), i) for j in np.flatnonzero(near >= ee.ALIKE)]
    assert len(pairs) > 500
    kept = [p for p in pairs if found[p[0]]["class_id"] == found[p[1]]["class_id"]]
    assert len(kept) >= 0.95 * len(pairs)
    # Nothing is linked that all pairs would not link, and sizes are those of the classes.
    brute = components(len(texts), pairs)
    for i, r in found.items():
        assert brute[r["class_id"]] == brute[i] and r["class_id"] <= i
        assert r["class_size"] == sum(x["class_id"] == r["class_id"] for x in found.values())


def test_template_on_a_third_of_the_rows(spark, documents, prose, monkeypatch):
    """Texts of one template that are hardly alike: no pair is handed on, and the near copies among them are found."""
    from juryframe.llm import banding

    monkeypatch.setattr(banding, "CHUNK", 64)
    rng, base = random.Random(6), prose(100, 1)
    texts = [substituted(base, 24, rng) for _ in range(300)] + [prose(100, 7000 + i) for i in range(600)]
    texts += [substituted(texts[i], 1, rng) for i in range(0, 300, 10)]
    found = {r["doc_id"]: r for r in ee.edit_fingerprints(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    near = [(900 + k, i) for k, i in enumerate(range(0, 300, 10)) if ee.likeness(*[ee.parsed(found[x]["fingerprint"]) for x in (900 + k, i)]) >= ee.ALIKE]
    hits = sum(found[a]["class_id"] == found[b]["class_id"] for a, b in near)
    assert len(near) > 20 and hits >= 0.9 * len(near) and all(found[i]["class_size"] == 1 for i in range(300, 900))


def test_single_bands_find_links(prose):
    """Of pairs at the least likeness, taken one by one, nine tenths share a band."""
    rng, hits, total = random.Random(5), 0, 0
    for k in range(150):
        base = prose(rng.randint(40, 300), 700 + k)
        for _ in range(4):
            pair = [ee.Pairs([t]).own[0] for t in (base, substituted(base, rng.randint(1, 12), rng))]
            if ee.ALIKE <= ee.likeness(*pair) < 1:
                width, bands = ee.band_shape(10**6, ee.ALIKE)
                a, b = ee.band_keys(np.array([p[0] for p in pair]), np.stack([p[1] for p in pair]), width, bands)
                hits, total = hits + bool(set(a) & set(b)), total + 1
    assert total > 100 and hits >= 0.95 * total


def test_classes_of_odd_rows(documents, odd_rows):
    rows = [(i, t, lang, source) for i, t, lang, source in odd_rows if t is None or len(t) < 10_000]
    found = ee.edit_fingerprints(documents(rows)).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r["fingerprint"], []).append((r["class_id"], r["class_size"]))
    assert all(len(set(x)) == 1 and x[0][1] >= len(x) for x in sizes.values())
    assert {r["doc_id"]: r["class_id"] for r in found}[7] == 6 and {r["doc_id"]: r["class_id"] for r in found}[3] == 2


def test_query(spark, sf_dir):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    check(op7_edit_fingerprints(spark, sf_dir).collect(), rows)
