from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_quality_rules import measured
from tests.llm.test_simhash import brute_components, fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A small corpus whose whole way through the stages can be followed in plain Python."""
    path = str(tmp_path_factory.mktemp("sf"))
    secret = "token = 0123456789abcdef0123456789abcdef"
    rows = [(i, prose(60 + i, i), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, prose(200, 1), "en", "a") for i in range(5)]  # copies
    rows += [(200, prose(70, 200) + " " + secret, "de", "b"), (201, "too short", "en", "a"), (202, "one two three " * 40, "en", "a"), (203, None, "en", None), (204, prose(80, 204), None, None), (205, prose(90, 205), "en", None)]
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def expected_after_dedup(rows):
    kept = []
    for r in rows:
        n, _, _, _, repeat = measured(r[1])
        if n >= 50 and 100 * repeat <= 50 * n:
            kept.append(r)
    kept.sort()
    roots = brute_components([fingerprint(t) for _, t, _, _ in kept])
    return [r for i, r in enumerate(kept) if roots[i] == i]


def test_stages(spark, corpus):
    path, rows = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        seen.append({"rows": docs.collect(), "columns": docs.columns})
        docs = spark.createDataFrame(seen[-1]["rows"], docs.schema)
    assert all(s["columns"] == COLUMNS for s in seen[:-1])
    want = expected_after_dedup(rows)
    assert sorted(r["doc_id"] for r in seen[1]["rows"]) == [i for i, _, _, _ in want]
    texts = {i: t.replace("token = 0123456789abcdef0123456789abcdef", "[SECRET]") for i, t, _, _ in want}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[2]["rows"]} == {i: (t, len(t)) for i, t in texts.items()}
    copies = Counter(r["doc_id"] for r in seen[3]["rows"])
    words = Counter()
    for r in seen[3]["rows"]:
        words[r["source"]] += len(r["text"].split())
    total = sum(len(t.split()) for t in texts.values())
    assert max(copies.values()) == 2 and sum(words.values()) == pytest.approx(1.5 * total, rel=0.02)
    from tokenizers import Tokenizer

    from juryframe.llm.packing import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    packed = Counter()
    for r in seen[4]["rows"]:
        packed[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == tokens[r["doc_id"]]
    assert packed == {i: tokens[i] * n for i, n in copies.items()}
    assert len({r["sequence_id"] for r in seen[4]["rows"]}) == len(seen[4]["rows"])


def test_run_is_the_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket"]
    want, found = (sorted(map(tuple, df.select(columns).collect())) for df in (docs, corpus_pipeline.run(spark, path)))
    assert want == found and {r[0] for r in found} <= {i for i, _, _, _ in expected_after_dedup(rows)}


def test_rows_without_an_id_and_clashing_columns(spark, corpus, prose):
    """Different texts whose ids are null or equal all leave each stage, with every further column."""
    path, _ = corpus
    rows = [(None, prose(60 + i, 40 + i), "en", "a", 300, 1, 2, 3, i) for i in range(20)] + [(7, prose(60 + i, 80 + i), "en", "a", 300, 1, 2, 3, 20 + i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row int, __place int, mix_copies int, __maybe int")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, path).collect()
        assert sorted(r[-1] for r in kept) == [*range(25)] and {tuple(r)[5:8] for r in kept} == {(1, 2, 3)}
    mixed = corpus_pipeline.mixing_stage(spark, docs, path)
    assert mixed.columns == docs.columns and {tuple(r)[5:8] for r in mixed.collect()} == {(1, 2, 3)}


def test_odd_and_empty_documents(spark, corpus, odd_rows, documents, tmp_path):
    path, _ = corpus
    for rows in (odd_rows, []):
        docs = documents(rows).select(COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path)
        ids = [r["doc_id"] for r in docs.filter("start = 0").collect()]
        # Of what has fifty words: a copy of each group, and no document of repeated words.
        assert set(ids) <= {1, 5, 6, 9, None} and (not rows or {1, 5, 6, 9} <= set(ids))


def test_quality_judges_rows_not_ids(spark, corpus, documents, prose):
    path, _ = corpus
    rows = [(None, prose(60, 1), "en", "a"), (None, "", "en", "a"), (None, None, None, None), (None, prose(70, 2), "en", "a"), (7, prose(80, 3), "en", "a"), (7, "short", "en", "a")]
    kept = corpus_pipeline.quality_stage(spark, documents(rows).select(COLUMNS), path)
    assert sorted(r["text"] for r in kept.collect()) == sorted([rows[0][1], rows[3][1], rows[4][1]])


def folders(spark):
    import os

    from juryframe.llm.common import shared_dir

    return {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith(("pipeline-", "rows-"))}


def test_two_runs_at_once_do_not_meet(spark, corpus):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        one, two = (f.result() for f in [pool.submit(corpus_pipeline.run, spark, corpus[0]) for _ in range(2)])
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(one.select(columns).collect()) == sorted(two.select(columns).collect())


def test_failed_run_leaves_nothing(spark, corpus, monkeypatch):
    def fails(spark, docs, sf_dir):
        raise RuntimeError("lost")

    before = folders(spark)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("fails", fails)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, corpus[0])
    assert folders(spark) == before
