"""Text normalisation, tokens and error rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

NOT_WORD = r"[^\p{L}\p{N}_\s]"
#: Code points above 0xFFFF, which stand for tokens.
MOST_CODES = 0x100000
POLICIES = ("score", "rover", "strict", "equal")


def clean_text(text: Column) -> Column:
    """Null is empty; lower case; only letters, digits, underscores and white space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, ""))


def clean_text_legacy(text: Column) -> Column:
    """Not trimmed, and null is the word none."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit("None"))), NOT_WORD, "")


def tokens(text: Column) -> Column:
    """Split at white space; empty text has no tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def join_tokens(words: Column) -> Column:
    return F.trim(F.array_join(words, " "))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _trimmed(a: Column, b: Column) -> Column:
    """Structs of the two lists without the tokens that they begin and end with alike."""

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda v, w: v.eqNullSafe(w) & v.isNotNull())
        ended = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False))
        return (ended - 1).cast("int")

    def cut(x: Column, ends: Column) -> Column:
        return F.slice(x, ends["head"] + 1, F.size(x) - ends["head"] - ends["tail"])

    def ends(head: Column) -> Column:
        rest = [F.reverse(F.slice(x, head + 1, F.size(x) - head)) for x in (a, b)]
        return F.struct(head.alias("head"), common(*rest).alias("tail"))

    return _bound(_bound(common(a, b), ends), lambda e: F.struct(cut(a, e).alias("a"), cut(b, e).alias("b")))


def _coded(words: Column, dictionary: Column, strange: int) -> Column:
    """A text of one character for each word: its place in the sorted ``dictionary``, found by halving, or ``strange`` if it has none.

    A code from 0x10000 on is a pair of 16-bit units.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    steps = F.filter(powers, lambda k: k <= F.size(dictionary))

    def code(w: Column, steps: Column) -> Column:
        # The number of entries that are no greater than the word, one bit after another.
        step = lambda at, k: F.when(F.get(dictionary, at + k - 1) <= w, at + k).otherwise(at)
        upto = F.aggregate(steps, F.lit(0), step)
        n = _bound(upto, lambda p: F.when(F.get(dictionary, p - 1) == w, p + 1).otherwise(F.lit(strange)))
        return _bound(n, lambda n: F.concat(F.hex(F.shiftright(n, 10) + 0xD800), F.hex(F.pmod(n, F.lit(1024)) + 0xDC00)))

    codes = _bound(steps, lambda s: F.transform(words, lambda w: code(w, s)))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


#: Distances up to which the table of prefixes is walked in a band, before all of it is.
BANDS = (8, 32, 128, 512, 2048)


def _banded(a: Column, b: Column) -> Column:
    """The distance of two texts: in a band about the diagonal that widens until it holds the distance."""
    # A distance beyond the band is -1, which the filter drops; it is worked out once.
    tries = [F.get(F.filter(F.array(F.levenshtein(a, b, k)), lambda d: d >= 0), F.lit(0)) for k in BANDS]
    return F.coalesce(*tries, F.levenshtein(a, b))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Least number of substituted, inserted and deleted tokens, inside the JVM; null for a null list.

    What the lists begin and end with alike is left out. Of the rest each token that both hold becomes a character, by its place in one sorted
    dictionary; all others of a list become one more. The built-in distance then counts characters in a band that widens as
    the distance needs, so the time is the length times the distance. More than MOST_CODES shared tokens raise an error, as there are
    no more characters; ``word_distance_udf`` takes those.
    """

    def distance(t: Column) -> Column:
        shared = F.array_sort(F.array_intersect(t["a"], t["b"]))
        fits = lambda d: F.size(d) <= MOST_CODES - 2
        counted = lambda d: F.when(fits(d), _bound(F.struct(_coded(t["a"], d, 0).alias("a"), _coded(t["b"], d, 1).alias("b")), lambda c: _banded(c["a"], c["b"])))
        return _bound(shared, lambda d: counted(d).when(~fits(d), F.raise_error(F.lit("too many different tokens for word_distance")).cast("int")))

    return F.when(ref.isNotNull() & hyp.isNotNull(), _bound(_trimmed(ref, hyp), distance))


def least_edits(ref: Sequence[str], hyp: Sequence[str]) -> int:
    """The distance of two lists: a column of the table of prefixes is two whole numbers with a bit for each word of ``ref`` (Hyyrö's form of Myers's algorithm)."""
    if not len(ref):
        return len(hyp)
    holds: dict[str, int] = {}
    for i, word in enumerate(ref):
        holds[word] = holds.get(word, 0) | 1 << i
    full, last, edits = (1 << len(ref)) - 1, len(ref) - 1, len(ref)
    up, down = full, 0
    for word in hyp:
        agrees = holds.get(word, 0)
        diagonal = ((((agrees & up) + up) ^ up) | agrees | down) & full
        right, left = down | full & ~(diagonal | up), diagonal & up
        edits += (right >> last) - (left >> last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full & ~(diagonal | right), right & diagonal
    return edits


@F.pandas_udf(IntegerType())
def word_distance_udf(ref, hyp):
    """The same for lists of any vocabulary, in a Python worker: faster where texts are so far apart that bands are wide."""
    import pandas as pd

    return pd.Series([None if r is None or h is None else least_edits(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int32")


def word_error_rate(edits: Column, n_ref: Column, n_hyp: Column, policy: str = "score") -> Column:
    """Edits over reference tokens. Where texts are empty, by policy:

    score: 0 for an empty reference. rover: 0 for an empty reference if the hypothesis is empty too, else 1.
    strict: 1 if either is empty. equal: if either is empty, 0 if both are, else 1.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rate = edits / n_ref.cast("double")
    both = F.when(n_hyp == 0, 0.0).otherwise(1.0)
    if policy == "score":
        return F.when(n_ref == 0, 0.0).otherwise(rate)
    if policy == "rover":
        return F.when(n_ref == 0, both).otherwise(rate)
    if policy == "strict":
        return F.when((n_ref == 0) | (n_hyp == 0), 1.0).otherwise(rate)
    return F.when((n_ref == 0) | (n_hyp == 0), F.when(n_ref == n_hyp, 0.0).otherwise(1.0)).otherwise(rate)


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Character edits over reference characters; an empty reference or hypothesis gives 0 if equal, else 1."""
    either = (F.length(ref) == 0) | (F.length(hyp) == 0)
    return F.when(either, F.when(ref == hyp, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref).cast("double"))


def file_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def title_of(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def without_seed(name: Column) -> Column:
    return F.regexp_replace(name, r"[-_]seed\d+$", "")


def without_prefix(metric: Column, prefix: str = "test/") -> Column:
    return F.replace(metric, F.lit(prefix), F.lit(""))


def digest8(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 8)


def int_list(text: Column) -> Column:
    """Integers of a comma list, blanks skipped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int"))


def parse_runs(specs: list[str]) -> dict[str, str]:
    """``name=path`` arguments by name; the first ``=`` divides."""
    runs: dict[str, str] = {}
    for spec in specs:
        name, found, path = (x.strip() for x in spec.partition("="))
        if not found or not name or not path:
            raise ValueError(f"expected name=path, got {spec!r}")
        if name in runs:
            raise ValueError(f"run {name!r} is given twice")
        runs[name] = path
    if not runs:
        raise ValueError("no run is given")
    return runs
