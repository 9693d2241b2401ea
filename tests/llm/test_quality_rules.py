import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from juryframe.llm import quality_rules
from juryframe.llm.queries import op4_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(documents, odd_rows, labels):
    rows = [*odd_rows, (20, "a b a b a b a", "en", "a"), (21, "a b c", "en", "a"), (22, "x\nx\n\nx\ny", "en", "a"), (23, "a b c a b c", "en", "a")]
    found = quality_rules.judge_documents(documents(rows), labels([])).collect()
    expected = sorted(((i, *measured(t)) for i, t, _, _ in rows), key=str)
    assert sorted(((r["doc_id"], *[r[m] for m in MEASURES]) for r in found), key=str) == expected
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


def test_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 40, 700) for k in (0, 1, 3, 30) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    found = {(r["k"], r["n"]): r["p"] for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()}
    for (k, n), p in found.items():
        exact = sum(comb(n, j) * Fraction(1, 20) ** j * Fraction(19, 20) ** (n - j) for j in range(k + 1))
        assert p == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_keep_the_risk(spark, documents, labels, prose):
    # Bad documents have symbols; a few good ones have some too.
    rows = [(i, prose(60, i) + " #" * (40 if i % 10 == 0 else 0), "en" if i < 1500 else "de", "a") for i in range(1650)]
    marks = [(i, 0 if i % 10 == 0 else 1, 0) for i in range(1650)]
    found = quality_rules.judge_documents(documents(rows), labels(marks), cutoffs={"symbol_share": (0.01, 0.05, 0.9)}, alpha=0.02)
    by = {r["doc_id"]: r for r in found.collect()}
    rejected = {i for i, r in by.items() if not r["kept"] and not r["base_failed"]}
    assert rejected == {i for i in range(1500) if i % 10 == 0 and not by[i]["base_failed"]}  # too few labels in de
    assert all(by[i]["rejected_by"] == ["symbol_share"] for i in rejected)


def test_a_risky_cutoff_is_not_taken(spark):
    # Half of the good documents lie beyond the strict cutoff, none beyond the loose one.
    rows = [("en", True, 0.2 if i % 2 else 0.0) for i in range(3000)] + [("en", False, 0.9)] * 30
    df = spark.createDataFrame(rows, "stratum string, good boolean, r double")
    found = quality_rules.certified_cutoffs(df, {"r": (0.1, 0.5)}, alpha=0.01).collect()
    assert [(r["stratum"], r["cutoff"]) for r in found] == [("en", 0.5)]
    assert quality_rules.certified_cutoffs(df.filter("good").limit(100).union(df.filter("not good")), {"r": (0.1, 0.5)}, alpha=0.01).count() == 0


def test_labels_that_cannot_be_used(documents, odd_rows, labels):
    marks = [(None, 1, 0), (1, None, 0), (1, 1, None), (1, 0, 1), (999, 0, 0), (5, 1, 1)]
    assert quality_rules.judge_documents(documents(odd_rows), labels(marks)).count() == len(odd_rows)


def test_empty(documents, labels):
    assert quality_rules.judge_documents(documents([]), labels([])).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = op4_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)
