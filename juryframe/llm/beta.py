"""The distribution function of the beta distribution as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's series for ln gamma, coefficients of 1 / z, 1 / z**3 and so on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Terms of the continued fraction: so many, and so many times the root of a + b more.
TERMS, TERMS_ROOT = 64, 4.0


def ln_gamma(z: Column) -> Column:
    """For z > 0: Stirling's series at z + 8, less the logarithms of what lies between."""
    up = z + 8
    series = (up - 0.5) * F.log(up) - up + 0.9189385332046727  # half of ln(2 pi)
    for k, c in enumerate(STIRLING):
        series = series + c / F.pow(up, F.lit(float(2 * k + 1)))
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return series - F.log(product)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The value for x below the mean, by the continued fraction, from its last term to its first."""

    def term(below: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.lit(1.0) + F.when(j % 2 == 0, even).otherwise(odd) / below

    last = F.ceil(TERMS + TERMS_ROOT * F.sqrt(a + b)).cast("int")
    head = F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.lit(1.0), term)
    front = a * F.log(x) + b * F.log(1 - x) + ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b)
    return F.exp(front) / a / head


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """P(B <= x) of a beta variable with parameters a, b > 0, for 0 < x < 1."""
    low = x < (a + 1) / (a + b + 2)
    # One side is computed: the fraction converges where x is below the mean.
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    value = F.transform(F.array(F.struct(y.alias("y"), p.alias("p"), q.alias("q"))), lambda s: _fraction(s["y"], s["p"], s["q"]))[0]
    return F.when(low, value).otherwise(1 - value)


def beta_cdf_sql(x: str, a: str, b: str) -> str:
    """The same for DuckDB; the arguments are columns or literals."""
    low = f"{x} < ({a} + 1) / ({a} + {b} + 2)"
    y, p, q = (f"CASE WHEN {low} THEN {u} ELSE {v} END" for u, v in ((x, f"1 - {x}"), (a, b), (b, a)))
    even = "(j // 2) * (s.q - j // 2) * s.y / ((s.p + 2 * (j // 2) - 1) * (s.p + 2 * (j // 2)))"
    odd = "-(s.p + j // 2) * (s.p + s.q + j // 2) * s.y / ((s.p + 2 * (j // 2)) * (s.p + 2 * (j // 2) + 1))"
    terms = f"list_transform(range(CAST(ceil({TERMS} + {TERMS_ROOT}::DOUBLE * sqrt({a} + {b})) AS BIGINT), 0, -1), lambda j: CASE WHEN j % 2 = 0 THEN {even} ELSE {odd} END)"
    head = f"list_reduce({terms}, lambda below, t: 1.0::DOUBLE + t / below, 1.0::DOUBLE)"
    front = "exp(s.p * ln(s.y) + s.q * ln(1 - s.y) + lgamma(s.p + s.q) - lgamma(s.p) - lgamma(s.q)) / s.p"
    value = f"list_transform([{{'y': {y}, 'p': {p}, 'q': {q}}}], lambda s: {front} / {head})[1]"
    return f"CASE WHEN {low} THEN {value} ELSE 1 - {value} END"
