"""Tail probabilities, evaluated on one row per comparison."""

from __future__ import annotations

import math

_PARTS: dict[int, tuple[int, list[int]]] = {}  # a plain table: lru_cache is pickled by reference, which executors cannot follow


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    result = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            result *= change
        if abs(change - 1) < 1e-15:
            break
    return result


def regular_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with `df` degrees of freedom."""
    if not math.isfinite(t):
        return 0.0
    return regular_beta(df / 2, 0.5, df / (df + t * t))


def _bounded_parts(n: int) -> tuple[int, list[int]]:
    """(L, P) with 1 / ((1 - q) (1 - q) (1 - q^2) .. (1 - q^n)) = P(q) / (1 - q^L)^(n + 1); L is a multiple of 1..n."""
    cycle = math.lcm(*range(1, n + 1))
    p = [1]
    for i in (1, *range(1, n + 1)):  # times (1 - q^L) / (1 - q^i) = 1 + q^i + .. + q^(L - i)
        grown = p + [0] * (cycle - i)
        for at in range(i, len(grown)):
            grown[at] += grown[at - i]
        for at in range(len(grown) - 1, cycle - 1, -1):
            grown[at] -= grown[at - cycle]
        p = grown
    return cycle, p


def rank_sum_tail(n: int, m: int, most: int) -> float:
    """P(U <= most) of the rank-sum statistic of n and m values without ties, for n values of a few and m of any number.

    The arrangements with U = u are the coefficient of q^u in the product of (1 - q^(m+i)) / (1 - q^i). Multiplying the numerators
    out leaves 2^n terms, each with a closed form in whole numbers, so nothing as long as n * m is held and nothing is rounded.
    """
    n, m = min(n, m), max(n, m)
    cycle, p = _PARTS.get(n) or _PARTS.setdefault(n, _bounded_parts(n))

    def up_to(x: int) -> int:
        return sum(p[j] * math.comb((x - j) // cycle + n, n) for j in range(x % cycle, min(x + 1, len(p)), cycle))

    shifts = {0: 1}
    for i in range(1, n + 1):
        for shift, sign in list(shifts.items()):
            shifts[shift + m + i] = shifts.get(shift + m + i, 0) - sign
    return sum(sign * up_to(most - shift) for shift, sign in shifts.items() if shift <= most) / math.comb(n + m, n)


def rank_sum_two_sided(u_right: float, n_right: int, n_left: int, tie_term: float) -> float:
    """Mann-Whitney p: exact for a small untied sample, else normal with tie and continuity correction."""
    u = max(u_right, n_right * n_left - u_right)
    if tie_term == 0 and min(n_right, n_left) <= 8:
        return min(1.0, 2 * rank_sum_tail(n_right, n_left, n_right * n_left - int(u)))
    n = n_right + n_left
    variance = n_right * n_left / 12 * ((n + 1) - tie_term / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (u - n_right * n_left / 2 - 0.5) / math.sqrt(variance)
    return float(min(1.0, math.erfc(z / math.sqrt(2))))
