import random

import pytest

SYLLABLES = "the an er in on re ti es or te of ed is it al ar st nt ng se ha le ve".split()


@pytest.fixture(scope="session")
def prose():
    """prose(n_words, seed): invented words, much like natural text."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


#: Columns that operators might use inside.
CLASHING = "fp long, size long, mix_size long, mix_copies int, copies int, n long, src string, before long, rate double, kept boolean, stratum string, component_id long, block int, key long, value string, kind int, part int, payload string, rank int, url string, spans string, __src string, __hash long, __salt int, __before long, __n long, __copies long, __copy int, __row long, __text string, __place int, __stratum string, __at long, __key string, __kind string, edited_sha256 string, fingerprint string, bucket_place long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows): a table from (doc_id, text, lang, source), with more columns whose names might clash."""

    def make(rows):
        extra = len(CLASHING.split(", "))
        data = [(i, t, lang, source, None if t is None else len(t), *[None] * extra) for i, t, lang, source in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in every column, empty and very long texts, equal texts, repeated rows, line ends, other scripts."""
    long = prose(60_000, 1)
    same = prose(80, 2)
    return [
        (1, prose(100, 3), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "en", "b"),
        (4, " \t\r\n\x0b\x0c ", "en", "b"),
        (5, long, "en", "a"),
        (6, same, "de", "b"),
        (7, same, "de", "b"),
        (8, same, None, None),
        (9, prose(70, 4), "fr", None),
        (9, prose(70, 4), "fr", None),
        (None, prose(60, 5), None, "c"),
        (None, None, None, None),
        (10, "Ünï 漢字 😀 x　y ﻿ é", "xx", "😀"),
        (11, "one", "en", ""),
        (12, "one two", "en", ""),
        (13, "a\n\n  b \n c  ", "en", "c"),
        (14, "x " * 500, "en", "c"),
    ]
