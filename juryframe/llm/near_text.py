"""Near-duplicates by the true similarity of word shingles, row by row.

Two texts are near-duplicates if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; a row's
group is all that such links reach. Candidates agree on one of 40 bands of five MinHash values: at similarity 0.8 a pair
shares none with probability 1.3e-7. Odd sketches discard candidates, and every other one is verified on the shingles; see ``odd_sketch``.

SimHash fingerprints alone cannot find all of these pairs: at similarity 0.8 two fingerprints of 64 bits differ in ten bits on average and
in up to twenty, where unrelated ones differ in 32 by give or take four, and distances to pivots, which differ by less still,
discard next to none of them. Where they are given as ``marks``, as ``simhash.near_groups`` does, they find the pairs within their radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import remove, shuffled, written
from juryframe.llm.odd_sketch import Marks, Rule, roots_of, texts_of

RULE = Rule(shingle=5, percent=80, bands=40, values=5)


def near_texts(docs: DataFrame, *, key_col: str, text_col: str = "text", rule: Rule = RULE, marks: Marks | None = None) -> DataFrame:
    """(key_col, root) of every row, by a unique long ``key_col``: rows with one root are near-duplicates.

    ``docs`` is read more than once and must give the same keys each time. Null and empty texts, and texts without words,
    are one class, with root -1. ``marks`` adds candidates to those of the bands. An empty table stays empty. Other columns are not read, whatever their names.
    """
    scratch: list[str] = []
    texts = texts_of(docs, key_col, text_col)
    roots = roots_of(texts, rule, scratch, marks).select(F.col("digest").alias("d"), F.when(F.col("n") > 0, F.col("root")).otherwise(-1).alias("root"))
    roots = written(roots)
    for path in scratch:
        remove(docs.sparkSession, path)
    return texts.select("doc_id", "digest").join(shuffled(roots), F.col("digest") == F.col("d")).select(F.col("doc_id").alias(key_col), "root")
