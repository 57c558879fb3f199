"""Classification metrics and descriptive statistics.

AUC and its variances are exact: scores are reduced to one row per
(group, distinct score) with positive / negative counts, and the counts
below / above each score come from the distributed ``running_sum``. The
placement values of DeLong and Obuchowski are functions of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.functions.stats import Z975, norm_sf
from kairos.operators.rows import attach
from kairos.operators.running import running_sum


def _lab(label: str) -> Column:
    return F.col(label).cast("int")


def score_counts(df: DataFrame, *, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, distinct score): pos, neg, and the counts strictly below / above."""
    by = list(by)
    c = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(*by, score).agg(F.sum(_lab(label)).cast("long").alias("pos"),
                                  F.sum(1 - _lab(label)).cast("long").alias("neg")))
    c = running_sum(c, [score], ["pos", "neg"], by=by, inclusive=False, out_prefix="lt_")
    tot = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = attach(c, tot, by)
    return (c.withColumn("gt_pos", F.col("P") - F.col("lt_pos") - F.col("pos"))
             .withColumn("gt_neg", F.col("N") - F.col("lt_neg") - F.col("neg")))


def auc(df: DataFrame, *, score: str, label: str, by: Sequence[str] = (), z: float = Z975) -> DataFrame:
    """K1 + K2: AUC (Mann-Whitney, ties 1/2, higher score = positive) with DeLong 95% limits.

    Placement of a positive at score s: ``(neg below s + neg at s / 2) / N``;
    of a negative: ``(pos above s + pos at s / 2) / P``. ``var = S10/P + S01/N``
    with the sample variances of the placements.

    ``df`` may be the ``score_pieces`` of many scores of the same rows, with ``by`` their index.
    """
    by = list(by)
    if df.columns == [c.split()[0] for c in _PIECE.split(", ")]:
        return auc_of_pieces(df, z=z)
    c = score_counts(df, score=score, label=label, by=by)
    v10 = F.try_divide(F.col("lt_neg") + F.lit(0.5) * F.col("neg"), F.col("N"))
    v01 = F.try_divide(F.col("gt_pos") + F.lit(0.5) * F.col("pos"), F.col("P"))
    c = c.withColumn("_v10", v10).withColumn("_v01", v01)
    a = c.groupBy(*by).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(F.col("pos") * F.col("_v10")).alias("_s10"), F.sum(F.col("pos") * F.col("_v10") ** 2).alias("_q10"),
        F.sum(F.col("neg") * F.col("_v01")).alias("_s01"), F.sum(F.col("neg") * F.col("_v01") ** 2).alias("_q01"))
    A = F.try_divide(F.col("_s10"), F.col("P"))
    var10 = F.try_divide(F.col("_q10") - F.col("P") * A * A, F.col("P") - 1)
    var01 = F.try_divide(F.col("_q01") - F.col("N") * A * A, F.col("N") - 1)
    var = F.try_divide(var10, F.col("P")) + F.try_divide(var01, F.col("N"))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return a.select(*by, F.col("P").alias("n_pos"), F.col("N").alias("n_neg"), A.alias("auc"),
                    var.alias("var"), F.greatest(A - F.lit(z) * se, F.lit(0.0)).alias("lower"),
                    F.least(A + F.lit(z) * se, F.lit(1.0)).alias("upper"))


#: Rows of a position's scores that are merged by one task, about, and rows from which the bounds between these tasks are taken.
PIECE_ROWS, BOUND_ROWS = 1 << 18, 1 << 10
_PIECE = "index int, bucket int, score binary, pos binary, neg binary"


def _distinct(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores, ascending, with their counts."""
    by = np.argsort(score, kind="stable")
    score, pos, neg = score[by], pos[by], neg[by]
    if not len(score):
        return score, pos, neg
    first = np.flatnonzero(np.concatenate([[True], (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))]))
    return score[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)


def score_bounds(sample: np.ndarray, rows: int) -> np.ndarray:
    """Bounds (scores x buckets - 1) that part ``rows`` rows into buckets of about ``PIECE_ROWS``, from a sample (rows x scores)."""
    at = np.arange(1, -(-rows // PIECE_ROWS)) * len(sample) * PIECE_ROWS // max(rows, 1)
    return np.sort(sample, axis=0)[at].T


def score_pieces(df: DataFrame, bounds: np.ndarray, *, scores: str, label: str, digits: int | None = None) -> DataFrame:
    """Rows with an array of scores each as packed pieces: per batch, position of the array and bucket the distinct scores with their
    counts of positives and negatives (scores and labels that are null are left out).

    ``bounds`` has the bounds of the buckets by position (positions x buckets - 1, ascending); equal scores are in one bucket.
    Scores are rounded to ``digits``.
    """
    def run(batches):
        for batch in batches:
            y, lists = batch.column(label), batch.column(scores)
            keep = pa.compute.and_(pa.compute.is_valid(y), pa.compute.is_valid(lists))
            batch = batch.filter(keep)
            if not batch.num_rows:
                continue
            lists, flat = batch.column(scores), batch.column(scores).flatten()
            z = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = z if digits is None else np.round(z, digits)
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(z.shape)
            one = batch.column(label).to_numpy(zero_copy_only=False).astype("<i8")
            found: dict[str, list] = {c: [] for c in ("index", "bucket", "score", "pos", "neg")}
            for j in range(z.shape[1]):
                k = known[:, j]
                s, pos, neg = _distinct(z[k, j] + 0.0, one[k], 1 - one[k])
                ends = [0, *np.searchsorted(s, bounds[j], "right"), len(s)]
                for b, (a, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if e > a:
                        for c, v in (("index", j), ("bucket", b), ("score", s[a:e].astype("<f8").tobytes()),
                                     ("pos", pos[a:e].astype("<i8").tobytes()), ("neg", neg[a:e].astype("<i8").tobytes())):
                            found[c].append(v)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], [*found])

    return df.select(scores, label).mapInArrow(run, _PIECE)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _distinct(*(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("score", "<f8"), ("pos", "<i8"), ("neg", "<i8"))))


def bucket_offsets(per: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``per`` (index, bucket, ...) with ``lt_<c>``, the sum of c over the buckets below, and ``all_<c>``, over all: a row per position and bucket."""
    below = Window.partitionBy("index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("index")
    return per.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0.0)).alias(f"lt_{c}") for c in sums],
                      *[F.sum(c).over(every).alias(f"all_{c}") for c in sums])


def auc_of_pieces(pieces: DataFrame, *, z: float = Z975) -> DataFrame:
    """The columns of ``auc`` per position (``index``) of ``score_pieces``: a task merges the pieces of one bucket of one position, and the
    placements' sums and sums of squares follow from the counts of the other buckets."""
    names = ["P", "N", "a1", "a2", "b1", "b2"]

    def merge(table: pa.Table) -> pa.Table:
        _, pos, neg = _merged(table)
        pos, neg = pos.astype(float), neg.astype(float)
        low = np.cumsum(neg) - 0.5 * neg  # negatives below, and half of those at the score
        high = pos.sum() - np.cumsum(pos) + 0.5 * pos
        told = [pos.sum(), neg.sum(), pos @ low, pos @ low ** 2, neg @ high, neg @ high ** 2]
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("index", "bucket")]
        return pa.Table.from_arrays([*keys, *[pa.array([float(x)]) for x in told]], ["index", "bucket", *names])

    per = pieces.groupBy("index", "bucket").applyInArrow(merge, "index int, bucket int, " + ", ".join(f"{c} double" for c in names))
    c = bucket_offsets(per, ["P", "N"])
    over = F.col("all_P") - F.col("lt_P") - F.col("P")  # positives in the buckets above
    moved = lambda n, first, second, by: (n * by + F.col(first), n * by * by + 2 * by * F.col(first) + F.col(second))
    (s10, q10), (s01, q01) = moved(F.col("P"), "a1", "a2", F.col("lt_N")), moved(F.col("N"), "b1", "b2", over)
    a = c.select("index", "P", "N", s10.alias("_s10"), q10.alias("_q10"), s01.alias("_s01"), q01.alias("_q01")).groupBy("index").agg(
        F.sum("P").alias("P"), F.sum("N").alias("N"), *[F.sum(x).alias(x) for x in ("_s10", "_q10", "_s01", "_q01")])
    P, N = F.col("P"), F.col("N")
    A = F.try_divide(F.col("_s10"), P * N)
    var10 = F.try_divide(F.try_divide(F.col("_q10"), N * N) - P * A * A, P - 1)
    var01 = F.try_divide(F.try_divide(F.col("_q01"), P * P) - N * A * A, N - 1)
    var = F.try_divide(var10, P) + F.try_divide(var01, N)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return a.select("index", P.cast("long").alias("n_pos"), N.cast("long").alias("n_neg"), A.alias("auc"), var.alias("var"),
                    F.greatest(A - F.lit(z) * se, F.lit(0.0)).alias("lower"), F.least(A + F.lit(z) * se, F.lit(1.0)).alias("upper"))


def rank_auc_of_pieces(pieces: DataFrame) -> DataFrame:
    """AUC per position from the mean ranks of the positives (ties share their mean rank)."""
    def merge(table: pa.Table) -> pa.Table:
        _, pos, neg = _merged(table)
        n = (pos + neg).astype(float)
        rank = np.cumsum(n) - n + (n + 1) / 2
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("index", "bucket")]
        return pa.Table.from_arrays([*keys, *[pa.array([float(x)]) for x in (n.sum(), pos.sum(), pos @ rank)]], ["index", "bucket", "n", "pos", "ranks"])

    per = pieces.groupBy("index", "bucket").applyInArrow(merge, "index int, bucket int, n double, pos double, ranks double")
    total = bucket_offsets(per, ["n"]).groupBy("index").agg(
        F.sum(F.col("ranks") + F.col("pos") * F.col("lt_n")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, n = F.col("pos"), F.col("n")
    return total.select("index", F.try_divide(F.col("ranks") - pos * (pos + 1) / F.lit(2.0), pos * (n - pos)).alias("rank_auc"))


def roc_points(df: DataFrame, *, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """K5: ROC curve points, one per distinct threshold (score >= threshold is positive)."""
    c = score_counts(df, score=score, label=label, by=by)
    return c.select(*by, F.col(score).alias("threshold"),
                    ((F.col("gt_pos") + F.col("pos")) / F.col("P")).alias("tpr"),
                    ((F.col("gt_neg") + F.col("neg")) / F.col("N")).alias("fpr"))


def clustered_auc(df: DataFrame, *, scores: Sequence[str], label: str, cluster: str) -> DataFrame:
    """K3: AUC of several scores with cluster-robust (co)variance (Obuchowski 1997).

    Per score: placements as in ``auc``, summed per cluster (V10_k, V01_k)
    with cluster counts m_k (positives) and n_k (negatives). Returns rows
    ``(a, b, auc_a, auc_b, cov)`` for every ordered score pair (a == b gives the variance):
    ``S10 = I10/((I10-1) M) sum (V10a_k - m_k Aa)(V10b_k - m_k Ab)``, S01 alike over
    negatives, ``S11 = I/(I-1) sum (V10a_k - m_k Aa)(V01b_k - n_k Ab)``,
    ``cov = S10/M + S01/N + (S11ab + S11ba)/(M N)``.
    One row per cluster per score is kept, which is bounded by the clusters.
    """
    parts = []
    for s in scores:
        c = score_counts(df, score=s, label=label)
        c = c.select(F.col(s).alias("_s"), ((F.col("lt_neg") + 0.5 * F.col("neg")) / F.col("N")).alias("_p10"),
                     ((F.col("gt_pos") + 0.5 * F.col("pos")) / F.col("P")).alias("_p01"))
        # one row per (cluster, score) meets the placements, not every row
        rows = (df.groupBy(cluster, F.col(s).alias("_s"))
                .agg(F.sum(_lab(label)).alias("_m"), F.sum(1 - _lab(label)).alias("_n")).join(c, "_s"))
        per = rows.groupBy(cluster).agg(F.sum(F.col("_m") * F.col("_p10")).alias("v10"), F.sum(F.col("_n") * F.col("_p01")).alias("v01"),
                                        F.sum("_m").alias("m"), F.sum("_n").alias("n"))
        parts.append(per.select(cluster, F.lit(s).alias("score"), "v10", "v01", "m", "n"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    tot = u.groupBy("score").agg(F.sum("m").alias("_M"), F.sum("n").alias("_Nn"), F.sum("v10").alias("_sv10"),
                                 F.sum((F.col("m") > 0).cast("int")).alias("I10"),
                                 F.sum((F.col("n") > 0).cast("int")).alias("I01"),
                                 F.count(F.lit(1)).alias("I"))
    u = u.join(tot, "score").withColumn("A", F.col("_sv10") / F.col("_M"))
    u = u.withColumn("d10", F.col("v10") - F.col("m") * F.col("A")).withColumn("d01", F.col("v01") - F.col("n") * F.col("A"))
    a = u.select(cluster, F.col("score").alias("a"), F.col("A").alias("auc_a"), F.col("d10").alias("d10a"),
                 F.col("d01").alias("d01a"), "_M", "_Nn", "I10", "I01", "I")
    b = u.select(cluster, F.col("score").alias("b"), F.col("A").alias("auc_b"), F.col("d10").alias("d10b"),
                 F.col("d01").alias("d01b"))
    j = a.join(b, cluster)
    g = j.groupBy("a", "b", "auc_a", "auc_b", "_M", "_Nn", "I10", "I01", "I").agg(
        F.sum(F.col("d10a") * F.col("d10b")).alias("_s10"), F.sum(F.col("d01a") * F.col("d01b")).alias("_s01"),
        F.sum(F.col("d10a") * F.col("d01b")).alias("_s11ab"), F.sum(F.col("d10b") * F.col("d01a")).alias("_s11ba"))
    M, N = F.col("_M"), F.col("_Nn")
    s10 = F.col("I10") / ((F.col("I10") - 1) * M) * F.col("_s10")
    s01 = F.col("I01") / ((F.col("I01") - 1) * N) * F.col("_s01")
    s11 = F.col("I") / (F.col("I") - 1) * (F.col("_s11ab") + F.col("_s11ba"))
    cov = s10 / M + s01 / N + s11 / (M * N)
    return g.select("a", "b", "auc_a", "auc_b", cov.alias("cov"))


def threshold_metrics(df: DataFrame, *, flag: Column, outcome: Column, by: Sequence[str] = ()) -> DataFrame:
    """K7: PPV, NPV, sensitivity, specificity, LR+, LR-, diagnostic odds ratio and Gini index at a rule.

    The Gini index is that of the two-point ROC curve (0,0), (1 - spec, sens), (1,1):
    ``2 AUC - 1 = sensitivity + specificity - 1``.

    ``flag`` = predicted positive, ``outcome`` = event; one aggregate of four counts.
    """
    f, o = flag.cast("boolean"), outcome.cast("boolean")
    a = df.groupBy(*by).agg(F.count_if(f & o).alias("tp"), F.count_if(f & ~o).alias("fp"),
                            F.count_if(~f & o).alias("fn"), F.count_if(~f & ~o).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = tp / (tp + fn), tn / (tn + fp)
    return a.select(*by, "tp", "fp", "fn", "tn", (tp / (tp + fp)).alias("ppv"), (tn / (tn + fn)).alias("npv"),
                    sens.alias("sensitivity"), spec.alias("specificity"),
                    (sens / (F.lit(1.0) - spec)).alias("lr_pos"), ((F.lit(1.0) - sens) / spec).alias("lr_neg"),
                    ((tp * tn) / (fp * fn)).alias("dor"), (sens + spec - F.lit(1.0)).alias("gini"))


def matched_threshold(df: DataFrame, *, score: str, k: DataFrame) -> DataFrame:
    """K8: the cut above which ``k`` rows lie, ``k`` being a one-row, one-column aggregate.

    The cut is the (k+1)-th largest score, i.e. the smallest score with at
    most k rows strictly above it; flagging ``score > threshold`` flags exactly
    k rows without ties and fewer where the cut falls into a tie. With
    k >= n there is no such score: the threshold is null and every row
    counts as flagged. Counts above each score are a distributed running sum.
    """
    n = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    above = running_sum(n, [score], ["_n"], descending=True, inclusive=False, out_prefix="_above")
    k = k.toDF("k")
    cut = attach(above, k, [])
    found = cut.agg(F.min(F.when(F.col("_above_n") <= F.col("k"), F.col(score))).alias("threshold"),
                    F.sum("_n").alias("_rows"))
    out = attach(found, k, [])
    at = out.select("k", F.when(F.col("k") < F.col("_rows"), F.col("threshold")).alias("threshold"), "_rows")
    flagged = cut.agg(F.max(F.when(F.col("_above_n") <= F.col("k"), F.col("_above_n"))).alias("n"))
    return attach(at, flagged, []).select("k", "threshold", F.coalesce(F.when(F.col("threshold").isNotNull(), F.col("n")), F.col("_rows"),
                                                                      F.lit(0)).cast("long").alias("n_flagged"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact type-7 quantiles per group as the array ``_q``, from counts of the distinct values and their running sums.

    The quantile p lies at rank ``p (n - 1)`` between the values that cover the
    ranks below and above it; each distinct value gives only the ranks it
    covers, so no task holds a group's values.
    """
    by = list(by)
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(cnt, ["_v"], ["_n"], by=by)
    cum = attach(cum, cnt.groupBy(*by).agg(F.sum("_n").alias("_tot")), by)
    p = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("p")) for i, x in enumerate(probs)]))
    at = cum.select(*by, "_v", "_n", "cum__n", "_tot", p.alias("_p"))
    pos = F.col("_p.p") * (F.col("_tot") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    first = F.col("cum__n") - F.col("_n")  # ranks first .. cum - 1 have this value
    holds = lambda rank: (first <= rank) & (rank < F.col("cum__n"))
    at = at.filter(holds(lo) | holds(hi))
    ends = at.groupBy(*by, F.col("_p.i").alias("_i")).agg(
        F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"),
        F.max(pos - lo).alias("_f"))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "_i", (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("q")))), lambda x: x["q"]).alias("_q"))


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """K9: min, Q1, median, mean, Q3, max (type-7 quantiles) and n per group."""
    q = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    a = attach(df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), q, list(by))
    return a.select(*by, "n", F.col("_q")[0].alias("min"), F.col("_q")[1].alias("q1"),
                    F.col("_q")[2].alias("median"), "mean", F.col("_q")[3].alias("q3"), F.col("_q")[4].alias("max"))


def category_shares(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """K9: counts and shares of a categorical column (per group)."""
    c = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(*by).agg(F.sum("n").alias("_tot"))
    return attach(c, tot, by).withColumn("share", F.col("n") / F.col("_tot")).drop("_tot")


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """All (row level x column level) cells with counts, zero cells kept, row shares.

    Levels come from the data (distinct values per side, small), the
    counted cells are right-joined onto their product.
    """
    cnt = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    rl = df.select(row).distinct()
    cl = df.select(col).distinct()
    cells = _product(rl, cl)
    full = cells.join(cnt, [row, col], "left").fillna({"n": 0})
    tot = full.groupBy(row).agg(F.sum("n").alias("_rt"))
    return full.join(tot, row).withColumn("row_share", F.col("n") / F.col("_rt")).drop("_rt")


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All (row level, column level) cells: the column levels arrive as one array
    (a scalar subquery over the distinct levels) and are exploded per row level."""
    c = b.columns[0]
    levels = b.agg(F.collect_list(c).alias("_l")).scalar()
    return a.select("*", F.explode(levels).alias(c))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Pearson chi-square statistic of independence and its degrees of freedom."""
    ct = crosstab(df, row, col)
    rt = ct.groupBy(row).agg(F.sum("n").alias("_r"))
    cc = ct.groupBy(col).agg(F.sum("n").alias("_c"))
    n = ct.agg(F.sum("n").alias("_n"))
    j = attach(ct.join(rt, row).join(cc, col), n, [])
    e = F.col("_r") * F.col("_c") / F.col("_n")
    return j.agg(F.sum((F.col("n") - e) ** 2 / e).alias("chisq"),
                 ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"))


def chi2_tail(x: str, df: str) -> Column:
    """Upper tail of the chi-square distribution for even degrees of freedom (closed form); null for odd ones.

    ``exp(-x/2) sum_{k < df/2} (x/2)^k / k!``; odd ones are in ``kairos.functions.stats.chi2_sf``.
    """
    half = F.col(x) / 2.0
    terms = F.transform(F.sequence(F.lit(0), F.greatest((F.col(df) / 2).cast("int") - 1, F.lit(0))),
                        lambda k: F.pow(half, k) / F.factorial(k))
    return F.when(F.col(df) % 2 == 0, F.exp(-half) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))


def correlation(df: DataFrame, x: str, y: str, z: float = Z975) -> DataFrame:
    """Pearson r, n, the t statistic and Fisher's 95% limits ``tanh(atanh r -+ z / sqrt(n - 3))``
    (the exact p value is in ``stats.pearson_test``)."""
    a = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    a = a.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("r") ** 2)))
    w = F.lit(z) / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3))
    return (a.withColumn("lower", F.tanh(F.atanh("r") - w)).withColumn("upper", F.tanh(F.atanh("r") + w)))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """sum(w x) / sum(w)."""
    return df.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("weighted_mean"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and the size rank (largest first, ties by id)."""
    c = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    from kairos.operators.running import global_row_number
    r = global_row_number(c.withColumn("_neg", -F.col("n")), ["_neg", group], out="size_rank")
    return r.drop("_neg")


def distinct_counts(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct entities and rows per entity."""
    return df.groupBy(*by).agg(F.countDistinct(key).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"),
                               (F.count(F.lit(1)) / F.countDistinct(key)).alias("rows_per_entity"))


def term_counts(df: DataFrame, terms: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each term of an array column, most common first (rank)."""
    t = df.select(*by, F.explode(terms).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("term"))
    return t.withColumn("rank", F.row_number().over(w)) if by else t


def compare_aucs(cov_rows: DataFrame, a: str, b: str) -> DataFrame:
    """K3 paired comparison of two scores from ``clustered_auc`` rows:
    ``z = (Aa - Ab) / sqrt(Va + Vb - 2 Cov)``; the two-sided p value is
    ``2 * norm_sf(|z|)`` (``kairos.functions.stats``) on the one-row result."""
    r = cov_rows
    va = r.filter((F.col("a") == a) & (F.col("b") == a)).select(F.col("auc_a").alias("auc_1"), F.col("cov").alias("v1"))
    vb = r.filter((F.col("a") == b) & (F.col("b") == b)).select(F.col("auc_a").alias("auc_2"), F.col("cov").alias("v2"))
    c = r.filter((F.col("a") == a) & (F.col("b") == b)).select(F.col("cov").alias("c12"))
    j = attach(attach(va, vb, []), c, [])
    return j.select("auc_1", "auc_2", ((F.col("auc_1") - F.col("auc_2"))
                                       / F.sqrt(F.col("v1") + F.col("v2") - F.lit(2.0) * F.col("c12"))).alias("z"))


def compare_all_aucs(cov_rows: DataFrame) -> list[dict]:
    """K3 for every pair of scores in ``clustered_auc`` rows: both AUCs, z and its two-sided p value (scores x scores rows)."""
    rows = {(r["a"], r["b"]): r for r in cov_rows.collect()}
    out = []
    for a, b in sorted(rows):
        if a < b:
            (va, vb), cov = (rows[a, a], rows[b, b]), rows[a, b]["cov"]
            spread = va["cov"] + vb["cov"] - 2 * cov
            z = (va["auc_a"] - vb["auc_a"]) / spread ** 0.5 if spread > 0 else float("nan")
            out.append({"a": a, "b": b, "auc_1": va["auc_a"], "auc_2": vb["auc_a"], "z": z, "p": 2 * norm_sf(abs(z))})
    return out


def auc_table(df: DataFrame, *, scores: Sequence[str], label: str, subgroup: str, digits: int = 3) -> DataFrame:
    """K4: AUC with DeLong limits for every subgroup x method, formatted ``auc (low-high)``.

    Methods are unpivoted to long rows, so one grouped AUC pass covers all.
    """
    long = df.select(subgroup, label, F.explode(F.array(*[F.struct(F.lit(s).alias("method"), F.col(s).cast("double")
                                                                  .alias("score")) for s in scores])).alias("_m")) \
        .select(subgroup, label, "_m.method", "_m.score")
    a = auc(long, score="score", label=label, by=[subgroup, "method"])
    fmt = f"%.{digits}f (%.{digits}f-%.{digits}f)"
    return a.select(subgroup, "method", "n_pos", "n_neg",
                    F.format_string(fmt, F.col("auc"), F.col("lower"), F.col("upper")).alias("auc_ci"))
