import itertools
import math
import random

import pytest

from pairlens.operators import running
from pairlens.operators.correlation import correlate, exact_tau_p, incomplete_beta, student_p
from pairlens.plans import evaluation


def brute(xs, ys):
    n = len(xs)
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(xs[i] - xs[j]) * sign(ys[i] - ys[j]) for i in range(n) for j in range(i))
    n0 = n * (n - 1) / 2
    t = lambda v: sum(v.count(a) * (v.count(a) - 1) / 2 for a in set(v))
    d = (n0 - t(xs)) * (n0 - t(ys))
    tau = s / math.sqrt(d) if d else None
    rank = lambda v: [sum(b < a for b in v) + (v.count(a) + 1) / 2 for a in v]
    rx, ry = rank(xs), rank(ys)
    mx, my = sum(rx) / n, sum(ry) / n
    vx, vy = sum((a - mx) ** 2 for a in rx), sum((b - my) ** 2 for b in ry)
    rho = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / math.sqrt(vx * vy) if vx and vy else None
    return tau, rho, sum(abs(a - b) for a, b in zip(xs, ys)) / n


def test_against_brute_force(spark):
    rng = random.Random(5)
    groups = {"ties": ([rng.randrange(6) for _ in range(150)], [rng.randrange(4) for _ in range(150)]), "free": ([rng.random() for _ in range(90)], [rng.random() for _ in range(90)]), "flat": ([1.0] * 8, [float(i) for i in range(8)]), "same": (list(range(20)), list(range(20)))}
    rows = [(g, float(x), float(y)) for g, (xs, ys) in groups.items() for x, y in zip(xs, ys)] + [("ties", None, 1.0), ("none", None, None)]
    got = {r["g"]: r for r in correlate(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert set(got) == set(groups)
    for g, (xs, ys) in groups.items():
        tau, rho, mae = brute([float(x) for x in xs], [float(y) for y in ys])
        assert got[g]["tau"] == (pytest.approx(tau) if tau is not None else None)
        assert got[g]["spearman"] == (pytest.approx(rho) if rho is not None else None)
        assert got[g]["mae"] == pytest.approx(mae) and got[g]["n_samples"] == len(xs)
    assert got["same"]["tau"] == pytest.approx(1) and got["flat"]["p_tau"] is None and got["same"]["p_spearman"] == 0


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_exact_tau_p_by_enumeration(n):
    for con in range(n * (n - 1) // 2 + 1):
        low = min(con, n * (n - 1) // 2 - con)
        perms = list(itertools.permutations(range(n)))
        some = sum(sum(p[i] < p[j] for i in range(n) for j in range(i + 1, n)) <= low for p in perms)
        assert exact_tau_p(n, con) == pytest.approx(min(1.0, 2 * some / len(perms)))


def test_student_p_known_values():
    # With one degree of freedom t is Cauchy, so p is known in closed form.
    r = 0.5
    t = r * math.sqrt(1 / (1 - r * r))
    assert student_p(r, 3) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
    assert student_p(0.0, 10) == pytest.approx(1.0) and student_p(1.0, 5) == 0.0 and student_p(0.3, 2) is None
    assert incomplete_beta(2, 2, 0.5) == pytest.approx(0.5)


def test_collation_has_every_model(spark, monkeypatch):
    long = spark.createDataFrame([("mdl_aster", "c", 0.5, 0.4, 1.0, 9), ("mdl_new", "c", 0.25, 0.1, 2.0, 7)], "model string, column_name string, tau double, spearman double, mae double, n_samples long")
    monkeypatch.setattr(evaluation, "collated_long", lambda spark, d: long)
    r = evaluation.collated_wide(spark, "").first().asDict()
    assert (r["mdl_aster__tau"], r["mdl_new__tau"], r["mdl_new__n_samples"], r["mdl_dune__tau"]) == (0.5, 0.25, 7, None)


def test_many_continuous_values_without_pairs_of_rows(spark):
    """Against a merge count: 20,000 values in one group, in more ranges than the table needs."""
    rng = random.Random(3)
    xs = [rng.random() for _ in range(20_000)]
    ys = [x + rng.choice([0.1, 0.5]) * rng.random() for x in xs]
    seq = [y for _, y in sorted(zip(xs, ys))]

    def inversions(a):
        if len(a) < 2:
            return a, 0
        m = len(a) // 2
        (p, i), (q, j) = inversions(a[:m]), inversions(a[m:])
        out, n, k = [], i + j, 0
        for v in q:
            while k < len(p) and p[k] <= v:
                out.append(p[k])
                k += 1
            n += len(p) - k
            out.append(v)
        return out + p[k:], n

    dis = inversions(seq)[1]
    pairs = len(xs) * (len(xs) - 1) / 2
    d = spark.createDataFrame([("g", x, y) for x, y in zip(xs, ys)], "g string, x double, y double")
    one, many = (correlate(d, ["g"], "x", "y", ranges).first() for ranges in (None, 16))
    assert one["tau"] == pytest.approx((pairs - 2 * dis) / pairs) and one["n_samples"] == 20_000
    assert tuple(many)[1:] == pytest.approx(tuple(one)[1:])


def test_ranges_grow_with_the_table():
    assert running.ranges_for(1000) == running.ranges_for(0) == 1 and running.ranges_for(10**8) == 400 and running.ranges_for(10**13) == running.MOST_RANGES
