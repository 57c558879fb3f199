"""Scoring: survival curves, medians, interpolation, explanations.

Curves are ``array<double>`` columns; every function here is an array
expression evaluated row by row inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Interval break points (days) of the discrete-time survival model.
BREAKS = (0, 30, 91, 182, 365, 548, 730, 913, 1095, 1278, 1470, 1643, 1825)
NEVER = 999999


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lits(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def cumulative_curve(probs) -> Column:
    """Survival curve = running product of the interval survival probabilities."""
    p = _c(probs)
    return F.transform(F.sequence(F.lit(1), F.size(p)),
                       lambda i: F.aggregate(F.slice(p, 1, i), F.lit(1.0), lambda acc, x: acc * x))


def survival_at_break(curve, breaks: Sequence[float], t: float) -> Column:
    """Value of the curve at the break ``t`` (``t`` must be one of ``breaks[1:]``)."""
    k = list(breaks[1:]).index(t) + 1
    return F.element_at(_c(curve), k)


def _knots(curve, breaks):
    """(times, values) with the origin (0 -> 1) and the far point (999999 -> 0)."""
    ts = _lits(list(breaks) + [NEVER])
    vs = F.concat(F.array(F.lit(1.0)), _c(curve), F.array(F.lit(0.0)))
    return ts, vs


def median_survival(curve, breaks: Sequence[float] = BREAKS) -> Column:
    """I2 (S15): first whole day with S < 0.5 on the linearly interpolated curve
    (S(0) = 1 at the origin); 999999 when the curve never drops below 0.5.

    Closed form on the first interval whose end value is below 0.5:
    ``floor(t0 + (S0 - .5) / (S0 - S1) * (t1 - t0)) + 1``.
    """
    ts = _lits(breaks)
    vs = F.concat(F.array(F.lit(1.0)), _c(curve))
    n = len(breaks)
    idx = F.array_position(F.transform(vs, lambda v: v < 0.5), True).cast("int")  # 1-based, 0 = none
    t0, t1 = F.element_at(ts, F.greatest(idx - 1, F.lit(1))), F.element_at(ts, F.greatest(idx, F.lit(1)))
    s0, s1 = F.element_at(vs, F.greatest(idx - 1, F.lit(1))), F.element_at(vs, F.greatest(idx, F.lit(1)))
    x = t0 + (s0 - F.lit(0.5)) / (s0 - s1) * (t1 - t0)
    day = F.floor(x) + F.lit(1)
    return F.when((idx == 0) | (idx > n), F.lit(NEVER)).otherwise(day).cast("long")


def survival_at_day(curve, day: float, breaks: Sequence[float] = BREAKS) -> Column:
    """I3 (S15): curve at whole day ``ceil(day)`` by linear interpolation with S(0)=1; 0 past the last break."""
    d = float(int(-(-day // 1)))
    if d > breaks[-1]:
        return F.lit(0.0)
    return interpolate(curve, d, list(breaks), origin=True)


def interpolate(curve, t, breaks: Sequence[float] = BREAKS, origin: bool = False) -> Column:
    """Linear interpolation of the curve at ``t`` (a number or column).

    ``origin=False`` (I4, S15) uses the points ``breaks[1:]`` only: before the
    first it returns the first value, after the last the last value.
    ``origin=True`` adds the point (0, 1).
    """
    if origin:
        ts, vs = _lits(breaks), F.concat(F.array(F.lit(1.0)), _c(curve))
    else:
        ts, vs = _lits(breaks[1:]), _c(curve)
    tt = F.lit(float(t)) if isinstance(t, (int, float)) else _c(t)
    m = len(breaks) if origin else len(breaks) - 1
    # index of the first knot >= t (1-based); 0 when none
    j = F.array_position(F.transform(ts, lambda x: x >= tt), True).cast("int")
    jj = F.greatest(j, F.lit(2))
    ta, tb = F.element_at(ts, jj - 1), F.element_at(ts, jj)
    va, vb = F.element_at(vs, jj - 1), F.element_at(vs, jj)
    lin = va + (vb - va) * (tt - ta) / (tb - ta)
    return (F.when(j == 0, F.element_at(vs, m))
            .when(j == 1, F.element_at(vs, 1))
            .otherwise(lin))


def exp_curve(rate, breaks: Sequence[float] = BREAKS) -> Column:
    """Interval survival probabilities ``exp(-rate * width)`` of an exponential model."""
    widths = [float(b - a) for a, b in zip(breaks[:-1], breaks[1:])]
    return F.transform(_lits(widths), lambda w: F.exp(-_c(rate) * w))


def top_contributions(long: DataFrame, coefs: DataFrame, rows: DataFrame, *, row_id: Sequence[str], feature: str = "feature",
                      value: str = "z", coef: str = "coef", fill: str = "fill_z", k: int = 5) -> DataFrame:
    """Per row of ``rows``, the ``k`` largest and ``k`` smallest contributions ``value * coef``
    over **all** model features, as signed strings ``' +name'`` / ``' -name'`` (sign of the
    value), largest first / smallest first; ties by feature name.

    A feature that the sparse long form does not hold for a row has the value
    ``fill`` (``coefs`` has feature, coef, fill; one row per model feature).
    The contributions of absent features are ranked once, as two arrays of the
    model's width; a row takes its own entries and the best of the ranked ones
    it does not hold. Features go by their place in name order: rows and shuffles
    hold no names, and only the few that are returned are looked up.
    """
    rid = list(row_id)

    def entry(v, c, at):
        return F.struct((v * c).alias("c"), at.alias("at"), F.coalesce(~(v > 0), F.lit(True)).alias("neg"))

    def rank(arr, down):
        key = lambda x: F.struct((-x["c"] if down else x["c"]).alias("c"), x["at"].alias("at"), x["neg"].alias("neg"))
        return F.sort_array(F.transform(arr, key))  # by contribution, then name

    named = coefs.filter(F.col(feature).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(
        F.col(feature).alias("f"), F.col(coef).cast("double").alias("c"), F.col(fill).cast("double").alias("v")))).alias("_a"))  # model width
    table = named.select(F.posexplode("_a").alias("_at", "_x")).select("_at", F.col("_x.f").alias(feature), F.col("_x.c").alias("_c"))
    places = F.transform("_a", lambda x, i: entry(x["v"], x["c"], i))
    absent = named.select(F.struct(F.transform("_a", lambda x: x["f"]).alias("f"), places.alias("x"), *[
        F.transform(rank(places, down), lambda x: x["at"]).alias(side) for side, down in (("up", True), ("down", False))]).alias("_r")).scalar()
    own = long.join(table, feature).groupBy(*rid).agg(F.collect_list(entry(F.col(value), F.col("_c"), F.col("_at"))).alias("_own"))
    j = rows.select(*rid).distinct().join(own, rid, "left")
    j = j.select(*rid, F.coalesce("_own", F.expr("cast(array() as array<struct<c:double,at:int,neg:boolean>>)")).alias("_own"))

    sides = {"up": True, "down": False}  # largest first, smallest first
    for side in sides:
        # of the best k + own features at least k are absent ones: no more of the ranked array is looked at, whatever its width
        head = F.slice(absent[side], F.lit(1), F.size("_own") + k)
        j = j.withColumn(f"_{side}", F.slice(F.array_except(head, F.col("_own.at")), 1, k))  # in the order of the ranks
    j = j.withColumns({f"_{side}": F.array(*[F.get(absent["x"], F.get(f"_{side}", F.lit(i))) for i in range(k)]) for side in sides})
    j = j.withColumns({f"_{side}": F.slice(F.sort_array(F.concat(rank(F.col("_own"), down), rank(F.array_compact(f"_{side}"), down))), 1, k)
                       for side, down in sides.items()})

    def told(side):
        best = [F.get(f"_{side}", F.lit(i)) for i in range(k)]
        return F.concat_ws("", *[F.concat(F.when(x["neg"], F.lit(" -")).otherwise(F.lit(" +")), F.get(absent["f"], x["at"])) for x in best])

    return j.select(*rid, told("up").alias("improve_feats"), told("down").alias("worsen_feats"))


def breslow_curves(base_hazard: DataFrame, scores: DataFrame, *, row_id: Sequence[str], xb: str = "xb",
                   grid: Sequence[float]) -> DataFrame:
    """Cox survival ``exp(-H0(t) exp(xb))`` at fixed times, and the grid median
    (first grid time with S < 0.5, else the last grid time).

    ``base_hazard`` is the Breslow table ``(time, H0)``; H0 at each grid time
    is a step lookup: each row of the table goes to the grid times at or after
    it and the latest of them stays (one row per grid time and task is
    shuffled, no join).
    """
    times = _lits(sorted(grid))
    at = base_hazard.select("time", "H0", F.explode(F.filter(times, lambda g: g >= F.col("time"))).alias("at"))
    h = at.groupBy("at").agg(F.max_by("H0", "time").alias("H0"))
    found = h.agg(F.map_from_entries(F.collect_list(F.struct("at", "H0"))).alias("_h"))  # one row, grid-sized
    rid = list(row_id)
    s = _attach_one(scores.select(*rid, xb), found)
    curve = F.transform(times, lambda t: F.exp(-F.coalesce(F.element_at(F.col("_h"), t), F.lit(0.0)) * F.exp(F.col(xb))))
    s = s.withColumn("curve", curve)
    first = F.array_position(F.transform(F.col("curve"), lambda v: v < 0.5), True).cast("int")
    med = F.when(first == 0, F.element_at(times, -1)).otherwise(F.element_at(times, F.greatest(first, F.lit(1))))
    return s.select(*rid, "curve", med.alias("median_grid"))


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from kairos.operators.rows import attach
    return attach(df, one_row, [])
