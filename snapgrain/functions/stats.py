"""Scalar tails on one-row results: the few functions that Spark lacks."""

from __future__ import annotations

from itertools import accumulate
from math import erfc, exp, lgamma, log, sqrt


def normal_cdf(z: float | None) -> float | None:
    return None if z is None else 0.5 * erfc(-z / sqrt(2))


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def sign_tail(ups: int, downs: int) -> float | None:
    """Chance of at least that many ups among as many fair coins as there are ups and downs; undefined without any.

    From the term at ``ups`` each next one follows by the ratio of two binomial coefficients, so no large integer is made.
    """
    n = ups + downs
    if not n:
        return None
    ratios = ((n - k) / (k + 1) for k in range(ups, n))
    return min(1.0, exp(_log_choose(n, ups) - n * log(2)) * sum(accumulate(ratios, float.__mul__, initial=1.0)))


def hypergeometric_tails(table: list[list[int]]) -> tuple[float, float]:
    """(lower, upper): chances that the first cell of a 2 x 2 table with the same margins is at most, or at least, what it is."""
    (a, b), (c, d) = table
    rows, columns, whole = (a + b, c + d), (a + c, b + d), a + b + c + d
    low, high = max(0, columns[0] - rows[1]), min(rows[0], columns[0])
    scale = _log_choose(whole, columns[0])
    chance = [exp(_log_choose(rows[0], x) + _log_choose(rows[1], columns[0] - x) - scale) for x in range(low, high + 1)]
    return min(1.0, sum(chance[: a - low + 1])), min(1.0, sum(chance[a - low :]))
