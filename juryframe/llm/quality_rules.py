"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule is a number that grows with how odd a document is. A rule's cutoff in a stratum (a language) comes from
labelled documents: with k of n good documents beyond a cutoff, the cutoff holds if the exact (Clopper-Pearson)
upper bound of the false-rejection rate is at most the rule's share of ``alpha``, that is if
``P(Binomial(n, risk) <= k)`` is at most the error allowed to each test. All cutoffs of all rules in all strata
are tested, so ``delta`` is divided by their number (Bonferroni), and ``alpha`` by the number of rules: with
probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents. Of the cutoffs that hold, the one
that rejects the most labelled bad documents is taken, of equal ones the loosest. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.llm.beta import beta_cdf
from juryframe.llm.common import SPACE, WORD, cut

#: Rules, each with its cutoffs from strict to loose.
CUTOFFS = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_lines_per_word": (0.005, 0.01, 0.02, 0.05, 0.1),
    "repeat_share": (0.1, 0.2, 0.3, 0.4),
    "odd_word_length": (1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0),
}
ALPHA, DELTA = 0.02, 0.05
#: The usual mean number of characters in a word; odd_word_length is the distance from it.
USUAL_LENGTH = 5.0


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; all 0 for null."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        # Windows of three words, sorted with their places; equal neighbours are windows found twice or more.
        n = F.size(w)
        windows = F.arrays_zip(
            F.slice(w, F.lit(1), n - 2).alias("a"),
            F.slice(w, F.lit(2), n - 2).alias("b"),
            F.slice(w, F.lit(3), n - 2).alias("c"),
            F.sequence(F.lit(0), n - 3).alias("at"),
        )
        windows = F.transform(F.array(windows), lambda z: F.sort_array(z))

        def covered(z: Column) -> Column:
            pairs = F.arrays_zip(F.slice(z, F.lit(1), F.size(z) - 1).alias("x"), F.slice(z, F.lit(2), F.size(z) - 1).alias("y"))
            same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
            starts = F.transform(F.array(same), lambda s: F.array_union(s["x"]["at"], s["y"]["at"]))[0]
            return F.transform(
                F.array(starts),
                lambda s: F.size(F.array_union(F.array_union(s, F.transform(s, lambda i: i + 1)), F.transform(s, lambda i: i + 2))),
            )[0]

        return F.when(n < 4, F.lit(0)).otherwise(F.transform(windows, covered)[0])

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": F.transform(F.array(words), repeated)[0].cast("long"),
    }


def _scores() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "odd_word_length": F.abs(F.col("word_chars") / n - USUAL_LENGTH),
    }


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k), which for k < n is the beta distribution function of n - k and k + 1 at 1 - risk."""
    return F.when(k >= n, F.lit(1.0)).otherwise(beta_cdf(F.lit(1 - risk), F.greatest(n - k, F.lit(1)).cast("double"), (k + 1).cast("double")))


def certified_cutoffs(labelled: DataFrame, cutoffs: dict[str, tuple[float, ...]] = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) that hold, at most one for each stratum and rule.

    ``labelled`` has stratum, good (boolean) and a column for each rule. A cutoff can hold only for a stratum with
    log(delta) / log(1 - alpha) good labels or more, so there are at most ``labels * alpha`` strata in the result.
    """
    risk = alpha / len(cutoffs)
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score"), F.lit(float(c)).alias("cutoff")) for r, cs in cutoffs.items() for c in cs])
    counts = (
        labelled.select("stratum", "good", F.explode(grid).alias("g"))
        .select("stratum", "good", "g.*")
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.count_if("good").alias("n"),
            F.count_if(F.col("good") & (F.col("score") > F.col("cutoff"))).alias("k"),
            F.count_if(~F.col("good") & (F.col("score") > F.col("cutoff"))).alias("bad"),
        )
    )
    # Each stratum brings the same number of tests.
    strata = counts.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    tests = F.col("strata") * sum(map(len, cutoffs.values()))
    return (
        counts.filter((F.col("n") > 0) & (F.col("k") <= F.col("n") * F.lit(risk)))
        .join(F.broadcast(strata), how="cross")  # one row
        .filter(binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(delta) / tests)
        .filter("bad > 0")
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct("bad", "cutoff"))["cutoff"].alias("cutoff"))
    )


def judge_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    key_col: str | None = None,
    cutoffs: dict[str, tuple[float, ...]] = CUTOFFS,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept, the rules' scores and rejected_by; ``key_col``, if given, is kept.

    ``labels`` has doc_id and quality (1: good). A null text has no words and fails the base rules. A null
    stratum is one of its own. Labels of no document, null labels and null ids are not used; a document labelled more
    than once counts once, good only if every label says so. Rows that repeat are judged each. Without labels
    there are no cutoffs and the base rules alone decide. An empty table stays empty. Texts may be of any length; a
    task holds one text's windows of three words. A score equal to a cutoff is not beyond it. Other columns are not read, whatever
    their names.
    """
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    key = [key_col] if key_col else []
    measured = cut(
        docs.select(*key, docs[id_col].alias("doc_id"), docs[stratum_col].alias("stratum"), docs[text_col].alias("__text"))
        .withColumns(measures(F.col("__text")))
        .drop("__text")
        .withColumns(_scores())
        .withColumn("base_failed", base_failed)
    )
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    found = certified_cutoffs(measured.filter(~F.col("base_failed")).join(marks, "doc_id"), cutoffs, alpha, delta)
    by_stratum = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoff"))
    # Bounded by certified_cutoffs: strata with enough labels, one small map each.
    judged = measured.join(F.broadcast(by_stratum.withColumnRenamed("stratum", "__stratum")), F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    beyond = F.array_compact(F.array(*[F.when(F.col(r) > F.col("cutoff")[r], F.lit(r)) for r in cutoffs]))
    return (
        judged.withColumn("rejected_by", F.when(F.col("cutoff").isNull(), F.array().cast("array<string>")).otherwise(beyond))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *cutoffs, "rejected_by", *key)
    )
