"""Binary-classifier metrics as Spark jobs.

Input: any DataFrame with an integer ``label`` (0/1) and a DOUBLE
``score``.  Threshold metrics are one conditional aggregate.  Ranking
metrics first collapse rows to one per distinct score (partial aggregation
map-side), then walk distinct scores in descending order with the
range-partitioned running sums of ``global_rank`` — no single-task window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .ranking import global_rank

THRESHOLD = 0.5
F1_EPS = 1e-12  # the reference adds this to the F1 denominator when tuning


def confusion_counts(scored: DataFrame, threshold: float | Column = 0.5,
                     label: str = "label", score: str = "score") -> DataFrame:
    """One row: tp, fp, tn, fn at ``score >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return scored.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                      F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                     score: str = "score") -> DataFrame:
    """Dense 2×2 (actual, predicted, count)."""
    c = confusion_counts(scored, threshold, label, score)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("count"))
                      for a, p, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return c.select(F.explode(cells).alias("c")).select("c.*")


def _prf(tp: Column, fp: Column, fn: Column):
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(ratio(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return precision, recall, f1


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                      score: str = "score") -> DataFrame:
    """Accuracy, precision, recall, F1 at a threshold (0 where undefined)."""
    c = confusion_counts(scored, threshold, label, score)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall, f1 = _prf(tp, fp, fn)
    return c.select(F.lit(float(threshold)).alias("threshold"),
                    ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def score_curve(scored: DataFrame, label: str = "label", score: str = "score",
                num_partitions: int | None = None) -> DataFrame:
    """Per distinct score, descending: positives/negatives at that score and
    cumulative true/false positives for ``score >= threshold``."""
    per = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return global_rank(per, [F.col("threshold").desc()], rank_col="step",
                       running={"tp": "pos", "fp": "neg"}, num_partitions=num_partitions)


def _totals(scored: DataFrame, label: str) -> Column:
    return scored.agg(F.struct(F.count_if(F.col(label) == 1).alias("p"),
                               F.count_if(F.col(label) != 1).alias("n")).alias("t")).scalar()


def _wide_product(a: Column | str, b: Column | str) -> Column:
    """Exact product of two counts: 2·P·N passes BIGINT at some billion rows of each class."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (a.cast("decimal(18,0)") * b.cast("decimal(19,0)")).cast("decimal(37,0)")


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score",
            num_partitions: int | None = None) -> DataFrame:
    """ROC-AUC with tied scores counted half (Mann–Whitney), from
    integer sums: ``Σ pos·(2·negatives_below + neg_at) / (2·P·N)``."""
    t = _totals(scored, label)
    curve = score_curve(scored, label, score, num_partitions)
    below = t.getField("n") - F.col("fp")
    terms = curve.select(_wide_product("pos", F.lit(2) * below + F.col("neg")).alias("_t"))
    num = terms.agg(F.sum("_t").alias("_num"))
    return num.select(ratio("_num", F.lit(2) * _wide_product(t.getField("p"), t.getField("n"))).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "score",
                      num_partitions: int | None = None) -> DataFrame:
    """Step-wise average precision ``Σ (R_k − R_{k−1})·P_k`` over
    distinct thresholds (no interpolation; MLlib's areaUnderPR is
    trapezoidal and differs)."""
    t = _totals(scored, label)
    curve = score_curve(scored, label, score, num_partitions)
    term = ratio("pos", t.getField("p")) * ratio("tp", F.col("tp") + F.col("fp"))
    return curve.select(term.alias("_t")).agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("average_precision"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              num_partitions: int | None = None) -> DataFrame:
    """(fpr, tpr) at every distinct threshold (no point dropping)."""
    t = _totals(scored, label)
    curve = score_curve(scored, label, score, num_partitions)
    return curve.select("threshold", "tp", "fp", ratio("tp", t.getField("p")).alias("tpr"),
                        ratio("fp", t.getField("n")).alias("fpr"))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score",
             num_partitions: int | None = None) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    t = _totals(scored, label)
    curve = score_curve(scored, label, score, num_partitions)
    return curve.select("threshold", "tp", "fp", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                        ratio("tp", t.getField("p")).alias("recall"))


def best_threshold(scored: DataFrame, objective: str = "f1", label: str = "label", score: str = "score",
                   num_partitions: int | None = None) -> DataFrame:
    """The distinct threshold maximising F1 (``2PR/(P+R+1e-12)``) or
    recall; the lowest threshold wins a tie.  An empty input gives 0.5 with
    score 0 (the reference's fallback)."""
    pr = pr_curve(scored, label, score, num_partitions)
    p, r = F.col("precision"), F.col("recall")
    value = r if objective == "recall" else (F.lit(2.0) * p * r) / (p + r + F.lit(F1_EPS))
    cand = pr.select("threshold", "precision", "recall", value.alias("_v"))
    # Projected first: the curve is built on row numbers, which Spark keeps
    # out of aggregate arguments.
    best = cand.agg(F.max_by(F.struct("threshold", "_v", "precision", "recall"),
                             F.struct(F.col("_v"), -F.col("threshold"))).alias("b"))
    return best.select(F.lit(objective).alias("objective"),
                       F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"),
                       F.coalesce(F.col("b._v"), F.lit(0.0)).alias("score"),
                       F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def classification_report(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                          score: str = "score", names=("No Churn", "Churn")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy (in the F1
    column, as the text report prints it), macro and weighted averages."""
    c = confusion_counts(scored, threshold, label, score)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)  # class 0 seen as the positive class
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    def row(k, name, p, r, f, sup):
        return F.struct(F.lit(k).alias("row_ord"), F.lit(name).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))
    none = F.lit(None).cast("double")
    rows = F.array(
        row(1, names[0], p0, r0, f0, s0), row(2, names[1], p1, r1, f1, s1),
        row(3, "accuracy", none, none, ratio(tp + tn, total), total),
        row(4, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row(5, "weighted avg", ratio(p0 * s0 + p1 * s1, total), ratio(r0 * s0 + r1 * s1, total),
            ratio(f0 * s0 + f1 * s1, total), total))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def summary_metrics(scored: DataFrame, threshold: float = THRESHOLD, label: str = "label", score: str = "score",
                    num_partitions: int | None = None) -> DataFrame:
    """``calculate_metrics``: threshold metrics plus ROC-AUC and PR-AUC, one row."""
    auc = roc_auc(scored, label, score, num_partitions).select(F.struct("roc_auc").alias("s")).scalar()
    ap = average_precision(scored, label, score, num_partitions).select(
        F.struct("average_precision").alias("s")).scalar()
    return threshold_metrics(scored, threshold, label, score).select(
        "threshold", "accuracy", auc.getField("roc_auc").alias("roc_auc"), "precision", "recall", "f1",
        ap.getField("average_precision").alias("pr_auc"))


def grouped_curve(scored: DataFrame, groups: list[str], label: str = "label", score: str = "score",
                  num_partitions: int | None = None) -> DataFrame:
    """``score_curve`` per group (fold, model, permutation…): one global
    rank over (groups, threshold desc); each group's running sums are the
    global ones minus the totals of the groups before it (a table with one
    row per group).  Meant for few groups — folds × models, features ×
    repeats — since the group offsets are a prefix sum over that table."""
    per = scored.groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranked = global_rank(per, [*[F.col(g) for g in groups], F.col("threshold").desc()], rank_col="_step",
                         running={"_tp": "pos", "_fp": "neg"}, num_partitions=num_partitions)
    tot = per.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    w = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*groups, "P", "N", F.coalesce(F.sum("P").over(w), F.lit(0)).alias("_pb"),
                     F.coalesce(F.sum("N").over(w), F.lit(0)).alias("_nb"))
    j = ranked.join(tot, groups)  # AQE broadcasts it when small (size-checked)
    return j.select(*groups, "threshold", "pos", "neg", "P", "N", (F.col("_tp") - F.col("_pb")).alias("tp"),
                    (F.col("_fp") - F.col("_nb")).alias("fp"))


def grouped_metrics(scored: DataFrame, groups: list[str], threshold: float = THRESHOLD, label: str = "label",
                    score: str = "score", num_partitions: int | None = None) -> DataFrame:
    """Per group: roc_auc, average_precision, accuracy, precision, recall, f1."""
    curve = grouped_curve(scored, groups, label, score, num_partitions)
    terms = curve.select(*groups, "P", "N",
                         _wide_product("pos", F.lit(2) * (F.col("N") - F.col("fp")) + F.col("neg")).alias("_a"),
                         (ratio("pos", "P") * ratio("tp", F.col("tp") + F.col("fp"))).alias("_ap"))
    rank_part = terms.groupBy(*groups).agg(
        ratio(F.sum("_a"), F.lit(2) * _wide_product(F.first("P"), F.first("N"))).alias("roc_auc"),
        F.sum("_ap").alias("average_precision"))
    t = F.lit(float(threshold))
    pred, y = F.col(score) >= t, F.col(label) == 1
    c = scored.groupBy(*groups).agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                                    F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall, f1 = _prf(tp, fp, fn)
    thr = c.select(*groups, ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"),
                   recall.alias("recall"), f1.alias("f1"))
    return thr.join(rank_part, groups)
