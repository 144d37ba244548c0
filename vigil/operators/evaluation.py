"""Evaluation aggregates over labelled scores.

Ranking statistics never sort rows globally.  Scores have six decimals in [0, 1], so there are at most
1,000,001 distinct values; rows are first counted per value (partial aggregation) and the cumulative
sums run over those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import clamp, rnd
from vigil.operators.ranks import rows_at


def _pos() -> Column:
    return F.col("label") == 1


# ----------------------------------------------------------------------------------- splits
def chrono_split(df: DataFrame, at: str, tie: str, train: float = 0.65, dev: float = 0.82) -> DataFrame:
    """Adds split = train / validation / test by time order (65 / 17 / 18 %).

    Two rows bound the parts; they are found by rank, and all others are compared with them.
    """
    bounds = {r["name"]: r for r in rows_at(df, [], at, {
        "train": lambda n: F.floor(n * train), "dev": lambda n: F.floor(n * dev)}, tie).collect()}

    def before(name: str) -> Column:
        if name not in bounds:  # the part ends with the last row
            return F.lit(True)
        own = bounds[name]
        return F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")) < F.struct(F.lit(own[at]).alias("at"), F.lit(own[tie]).alias("tie"))

    return df.withColumn("split", F.when(before("train"), "train").when(before("dev"), "validation").otherwise("test"))


def account_disjoint_split(df: DataFrame) -> DataFrame:
    """Adds split by account number modulo 10: below 6 train, from 8 test, else unused."""
    bucket = F.substring_index("account_id", "_", -1).cast("long") % 10
    return df.withColumn(
        "split", F.when(bucket < 6, "train").when(bucket >= 8, "test").otherwise("unused"))


def split_overlap(df: DataFrame) -> DataFrame:
    """Events and accounts per split, and accounts present in more than one split."""
    per_account = df.groupBy("account_id", "split").agg(F.count(F.lit(1)).alias("n"))
    shared = per_account.groupBy("account_id").agg(F.count(F.lit(1)).alias("splits"))
    return per_account.join(shared, "account_id").groupBy("split").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("splits") > 1).alias("overlapping_accounts"))


# -------------------------------------------------------------------------- operating points
def operating_points(df: DataFrame, thresholds: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates at several thresholds in one aggregation."""
    keys = keys or []
    # Counted per distinct outcome vector first: every threshold is one bit of the partial group key.
    flags = [(F.col("score") >= t).alias(f"_t{i}") for i, t in enumerate(thresholds.values())]
    small = df.select(*keys, _pos().alias("_pos"), *flags).groupBy(
        *keys, "_pos", *[f"_t{i}" for i in range(len(thresholds))]).agg(F.count(F.lit(1)).alias("_n"))
    points = F.array(*[
        F.struct(F.lit(name).alias("point"), F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("hit"))
        for i, (name, t) in enumerate(thresholds.items())
    ])

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("_n")).otherwise(0))

    hit, pos = F.col("hit"), F.col("_pos")
    out = small.select(*keys, "_pos", "_n", F.inline(points)).groupBy(*keys, "point", "threshold").agg(
        total(hit & pos).alias("true_positives"), total(hit & ~pos).alias("false_positives"),
        total(~hit & pos).alias("false_negatives"), total(~pos).alias("normal_events"),
        total(pos).alias("takeover_events"))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    one = F.lit(1)
    return out.select(
        "*",
        rnd(tp / F.greatest(one, F.col("takeover_events"))).alias("recall"),
        rnd(tp / F.greatest(one, tp + fp)).alias("precision"),
        rnd(fp / F.greatest(one, F.col("normal_events"))).alias("false_positive_rate"),
        rnd(2.0 * tp / F.greatest(one, 2 * tp + fp + F.col("false_negatives"))).alias("f1"),
    )


def score_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*keys, "score").agg(
        F.count_if(_pos()).alias("p"), F.count_if(~_pos()).alias("n"))


def _part(keys: list[str]):
    return Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))


def rank_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ROC-AUC with tie averaging, average precision and sizes, per key."""
    keys = keys or []
    counts = score_counts(df, keys)
    up = _part(keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    down = _part(keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select(
        *keys, "p", "n", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("below"),
        F.sum("p").over(down).alias("tp"), F.sum(F.col("p") + F.col("n")).over(down).alias("flagged"))
    total_p, total_n = F.sum("p"), F.sum("n")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    precision = F.sum(F.col("p") * (F.col("tp") / F.col("flagged")))
    # No keys: one row over the (bounded) distinct scores.
    grouped = steps.groupBy(*keys)
    return grouped.agg(
        F.when((total_p > 0) & (total_n > 0), rnd(wins / (total_p * total_n).cast("double"))).alias("roc_auc"),
        F.when(total_p > 0, rnd(precision / total_p)).alias("pr_auc"),
        total_p.alias("positives"), (total_p + total_n).alias("samples"))


def choose_threshold(df: DataFrame, max_fpr: float = 0.01, default: float = 0.70) -> DataFrame:
    """Threshold with the best recall whose false-positive rate stays within ``max_fpr``."""
    counts = score_counts(df, [])
    down = Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    curve = counts.select(
        "score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"),
        F.sum("p").over(everything).alias("all_p"), F.sum("n").over(everything).alias("all_n"))
    rate = F.col("fp") / F.greatest(F.lit(1), F.col("all_n"))
    best = F.max(F.when(rate <= max_fpr, F.struct("tp", "score")))
    return curve.agg(best.alias("b"), F.max("all_p").alias("all_p")).select(
        F.coalesce("b.score", F.lit(default)).alias("threshold"),
        rnd(F.coalesce("b.tp", F.lit(0)) / F.greatest(F.lit(1), "all_p")).alias("recall"))


# ------------------------------------------------------------------------------ calibration
def calibration(df: DataFrame, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error, per key."""
    keys = keys or []
    bin_ = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    label = F.col("label").cast("double")
    per_bin = df.groupBy(*keys, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(label).alias("y"),
        F.sum(F.pow(F.col("score") - label, 2)).alias("sq"))
    gap = F.abs(F.col("s") / F.col("n") - F.col("y") / F.col("n")) * F.col("n")
    return per_bin.groupBy(*keys).agg(
        rnd(F.sum("sq") / F.sum("n")).alias("brier_score"),
        rnd(F.sum(gap) / F.sum("n")).alias("expected_calibration_error"))


def separation_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    out = df.groupBy(*(keys or [])).agg(
        F.max(F.when(~_pos(), F.col("score"))).alias("normal_max"),
        F.min(F.when(_pos(), F.col("score"))).alias("takeover_min"))
    return out.withColumn("perfect_ranking_gap", F.col("takeover_min") > F.col("normal_max"))


def wilson_interval(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / trials
    denominator = 1.0 + z * z / trials
    centre = (p + z * z / (2.0 * trials)) / denominator
    half = z * F.sqrt(p * (1.0 - p) / trials + z * z / (4.0 * trials * trials)) / denominator
    ok = trials > 0
    return (F.when(ok, rnd(clamp(centre - half))).otherwise(0.0),
            F.when(ok, rnd(clamp(centre + half))).otherwise(0.0))


def with_wilson(points: DataFrame) -> DataFrame:
    low, high = wilson_interval(F.col("true_positives"), F.col("takeover_events").cast("double"))
    flow, fhigh = wilson_interval(F.col("false_positives"), F.col("normal_events").cast("double"))
    return points.select("*", low.alias("recall_low"), high.alias("recall_high"),
                         flow.alias("fpr_low"), fhigh.alias("fpr_high"))


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! by Stirling's series at k + 11, taken down again."""
    x = k + 11.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    for i in range(1, 11):
        series = series - np.log(k + i)
    return series


def poisson_quantile(lam: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Poisson quantile of a uniform number, vectorised: the weight of a resampled count.

    The sum of the probabilities starts nine deviations below the mean (or at 0), where less than 1e-18 is left out.
    """
    spread = np.sqrt(lam)
    value = np.maximum(0.0, np.floor(lam - 9 * spread))
    pmf = np.exp(np.where(lam > 0, value * np.log(np.maximum(lam, 1e-300)) - lam - _log_factorial(value), 0.0))
    cdf = pmf.copy()
    active = np.flatnonzero((draw > cdf) & (lam > 0))
    while len(active):
        value[active] += 1
        pmf[active] *= lam[active] / value[active]
        cdf[active] += pmf[active]
        active = active[(draw[active] > cdf[active]) & (value[active] < lam[active] + 12 * spread[active] + 40)]
    return value


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def uniforms(score: np.ndarray, known: np.ndarray, replicates: np.ndarray, seed: int, salt: str) -> np.ndarray:
    """A uniform number for each (score, replicate): low bits of Spark's xxhash64(score, replicate, seed, salt).

    Scores that are not ``known`` are null, which the hash passes over.
    """
    bits = (score.astype("float64") + 0.0).view(np.uint64)
    h = np.uint64(42) + _P5 + np.uint64(8) ^ _turned(bits * _P2, 31) * _P1
    h = np.where(known, _mixed(_turned(h, 27) * _P1 + _P4), np.uint64(42))[:, None]
    for number in (replicates.astype(np.uint64)[None, :], np.array([[seed & 0xFFFFFFFF]], np.uint64)):
        h = _mixed(_turned(h + _P5 + np.uint64(4) ^ number * _P1, 23) * _P2 + _P3)
    h = _mixed(_turned(h + _P5 + np.uint64(1) ^ np.uint64(ord(salt) * int(_P5) % 2**64), 11) * _P1)
    return ((h & np.uint64((1 << 52) - 1)).astype("float64") + 0.5) / float(1 << 52)


#: Cells (score, replicate) that a task draws at once.
DRAWN_AT_ONCE = 1_000_000


def _resampled(threshold: float, resamples: int, seed: int):
    """Totals of every replicate over the counts of one task, which come in order of their scores."""
    numbers = np.arange(1, resamples + 1)

    def drawn(score: np.ndarray, known: np.ndarray, mean: np.ndarray, salt: str) -> np.ndarray:
        out = np.zeros((len(score), resamples))
        some = np.flatnonzero(mean > 0)
        lam = np.repeat(mean[some].astype("float64"), resamples)
        out[some] = poisson_quantile(lam, uniforms(score[some], known[some], numbers, seed, salt).ravel()).reshape(len(some), resamples)
        return out

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(resamples) for name in ("np", "nn", "tp", "fp", "wins")}
        first, begun, step = None, False, max(1, DRAWN_AT_ONCE // resamples)
        for batch in batches:
            if batch.num_rows and not begun:
                first, begun = batch.column(0)[0].as_py(), True
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            columns.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, batch.num_rows, step):
                score, p, n, known = (x[at : at + step] for x in columns)
                hit = known & ((score >= threshold) | np.isnan(score))  # as in SQL, NaN is the largest number
                p, n = drawn(score, known, p, "p"), drawn(score, known, n, "n")
                below = sums["nn"] + np.cumsum(n, axis=0) - n
                sums["wins"] += (p * (below + n / 2.0)).sum(axis=0)
                for name, drawn_rows in (("np", p), ("nn", n), ("tp", p[hit]), ("fp", n[hit])):
                    sums[name] += drawn_rows.sum(axis=0)
        if begun:
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array([first] * resamples, pa.float64()), *map(pa.array, sums.values())],
                names=["replicate", "first", *sums])

    return sweep


def bootstrap_ci(df: DataFrame, threshold: float, resamples: int = 2000, seed: int = 2026,
                 confidence: float = 0.95) -> DataFrame:
    """Stratified percentile bootstrap of recall, precision, FPR and ROC-AUC.

    Rows are first counted per (score, label); a replicate draws a Poisson weight for each of those
    counts, rescaled to the stratum size, so its work does not depend on the number of rows.  A task draws all
    replicates of a range of scores and hands on their totals; no drawn weight is shuffled.
    """
    # Dealt by ranges of the score, each range in order; null comes first.
    counts = score_counts(df, []).select(F.col("score").cast("double").alias("score"), "p", "n")
    ranged = counts.repartitionByRange("score").sortWithinPartitions("score")
    # A hash gives each cell its uniform number, so a retried task draws the same weights.
    parts = ranged.mapInArrow(_resampled(threshold, resamples, seed), "replicate int, first double, np double, nn double,"
                              " tp double, fp double, wins double")
    # A range's positives also win over all negatives of the ranges below.
    lower = Window.partitionBy("replicate").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    steps = parts.withColumn("below", F.coalesce(F.sum("nn").over(lower), F.lit(0.0)))
    per = steps.groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in ("np", "nn", "tp", "fp")], F.sum(F.col("wins") + F.col("np") * F.col("below")).alias("wins"))
    one = F.lit(1.0)
    metrics = F.array(
        F.struct(F.lit("recall").alias("metric"), (F.col("tp") / F.greatest(one, "np")).alias("value")),
        F.struct(F.lit("precision").alias("metric"),
                 (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))).alias("value")),
        F.struct(F.lit("false_positive_rate").alias("metric"),
                 (F.col("fp") / F.greatest(one, "nn")).alias("value")),
        F.struct(F.lit("roc_auc").alias("metric"),
                 (F.col("wins") / F.greatest(one, F.col("np") * F.col("nn"))).alias("value")),
    )
    low = (1.0 - confidence) / 2.0
    return per.select(F.inline(metrics)).groupBy("metric").agg(
        rnd(F.percentile("value", F.lit(low))).alias("ci_lower"),
        rnd(F.percentile("value", F.lit(1.0 - low))).alias("ci_upper"),
        F.count(F.lit(1)).alias("resamples"))


# ------------------------------------------------------------------- components and cohorts
VARIANTS = {
    "model_only": "coalesce(model_score, 0.0)", "anomaly_only": "anomaly_score",
    "blend_without_floors": "blended_score", "floors_only": "security_floor",
    "fused_live": "fused_score",
}


def variant_scores(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Long form (variant, label, score) of the five scoring variants."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("variant"), F.expr(text).cast("double").alias("score"))
        for name, text in VARIANTS.items()
    ])
    return df.select("label", *(extra or []), F.inline(rows))


def ablation_table(df: DataFrame, threshold: float) -> DataFrame:
    long = variant_scores(df)
    points = operating_points(long, {"alert": threshold}, ["variant"]).select(
        "variant", "recall", "precision", "false_positive_rate", "true_positives", "false_positives")
    return points.join(rank_metrics(long, ["variant"]).select("variant", "roc_auc"), "variant")


def detection_attribution(df: DataFrame, threshold: float) -> DataFrame:
    """Alerts by outcome and by the component that reached the threshold."""
    blend, floor = F.col("blended_score") >= threshold, F.col("security_floor") >= threshold
    return (
        df.filter(F.col("fused_score") >= threshold)
        .groupBy(
            F.when(_pos(), "true_positives").otherwise("false_positives").alias("outcome"),
            F.when(blend & floor, "both").when(blend, "blend_alone").otherwise("floor_required")
            .alias("category"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )


def floor_attribution(df: DataFrame, threshold: float) -> DataFrame:
    """How often each floor rule fired among alerts whose floor reached the threshold."""
    hit = (F.col("fused_score") >= threshold) & (F.col("security_floor") >= threshold)
    return (
        df.filter(hit)
        .select(F.when(_pos(), "true_positives").otherwise("false_positives").alias("outcome"),
                F.explode("security_floor_codes").alias("code"))
        .groupBy("outcome", "code").agg(F.count(F.lit(1)).alias("alerts"))
    )


def cohort_rates(df: DataFrame, threshold: float) -> DataFrame:
    """Recall and FPR by channel and by scenario, both groupings in one pass."""
    hit = F.col("score") >= threshold
    small = df.groupBy("channel", "scenario").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(_pos()).alias("pos"),
        F.count_if(_pos() & hit).alias("tp"), F.count_if(~_pos() & hit).alias("fp"))
    both = small.select(
        "samples", "pos", "tp", "fp",
        F.inline(F.array(
            F.struct(F.lit("channel").alias("cohort"), F.col("channel").alias("value")),
            F.struct(F.lit("scenario").alias("cohort"), F.col("scenario").alias("value")))),
    ).groupBy("cohort", "value").agg(*[F.sum(c).alias(c) for c in ("samples", "pos", "tp", "fp")])
    neg = F.col("samples") - F.col("pos")
    return both.select(
        "cohort", "value", "samples", F.col("pos").alias("takeovers"),
        F.when(F.col("pos") > 0, rnd(F.col("tp") / F.col("pos"))).alias("recall"),
        F.when(neg > 0, rnd(F.col("fp") / neg)).alias("false_positive_rate"))


def hard_negative_rate(df: DataFrame, threshold: float) -> DataFrame:
    """Intervention rate of legitimate but unusual scenarios."""
    return (
        df.filter((F.col("label") == 0) & (F.col("scenario") != "legitimate"))
        .groupBy("scenario")
        .agg(F.count(F.lit(1)).alias("events"),
             rnd(F.count_if(F.col("score") >= threshold) / F.count(F.lit(1))).alias("intervention_rate"))
    )


def scenario_recall(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(_pos()).groupBy("scenario").agg(
        rnd(F.count_if(F.col("score") >= threshold) / F.count(F.lit(1))).alias("recall"))


def prevalence_stress(points: DataFrame, prevalences: tuple[float, ...] = (0.001, 0.005, 0.01)) -> DataFrame:
    """Projected precision and alert volume at other prevalences."""
    with_p = points.withColumn("prevalence", F.explode(F.array(*[F.lit(p) for p in prevalences])))
    true_rate = F.col("recall") * F.col("prevalence")
    false_rate = F.col("false_positive_rate") * (1.0 - F.col("prevalence"))
    return with_p.select(
        "point", "prevalence",
        rnd(true_rate / F.greatest(true_rate + false_rate, F.lit(1e-12))).alias("projected_precision"),
        rnd(10_000.0 * (true_rate + false_rate), 2).alias("projected_alerts_per_10000"),
        rnd(10_000.0 * false_rate, 2).alias("projected_false_alerts_per_10000"))


def feature_long(df: DataFrame, names: list[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("score"))
        for n in names])
    return df.select("label", F.inline(rows))


def leakage_audit(df: DataFrame, names: list[str], limit: float = 0.75) -> DataFrame:
    """Whether evidence-availability features separate the classes (per feature AUC, means, presence)."""
    counts = feature_long(df, names).groupBy("feature", "score").agg(
        F.count_if(_pos()).alias("p"), F.count_if(~_pos()).alias("n"))
    up = Window.partitionBy("feature").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0)))
    tp, tn = F.sum("p"), F.sum("n")
    auc = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / (tp * tn).cast("double")
    present = F.col("score") > 0
    out = steps.groupBy("feature").agg(
        auc.alias("auc"),
        rnd(F.sum(F.col("score") * F.col("n")) / tn).alias("mean_normal"),
        rnd(F.sum(F.col("score") * F.col("p")) / tp).alias("mean_takeover"),
        rnd(F.sum(F.when(present, F.col("n")).otherwise(0)) / tn).alias("present_rate_normal"),
        rnd(F.sum(F.when(present, F.col("p")).otherwise(0)) / tp).alias("present_rate_takeover"))
    separation = rnd(F.greatest(F.col("auc"), 1.0 - F.col("auc")))
    return out.select(
        "feature", "mean_normal", "mean_takeover", "present_rate_normal", "present_rate_takeover",
        separation.alias("separation_auc"), (separation < limit).alias("passed"))


def univariate_separation(df: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    """Features that separate the classes best on their own."""
    audit = leakage_audit(df, names, limit=0.98)
    return audit.select("feature", "separation_auc", F.col("passed").alias("below_limit")).orderBy(
        F.col("separation_auc").desc(), "feature").limit(top)
