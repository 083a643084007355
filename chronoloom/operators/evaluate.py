"""Expanding walk-forward splits, forecasters in closed form, and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, TEST_FRACTION = 5, 0.165
FLOOR = 1e-12


def with_fold(df: DataFrame, by: Sequence[str] = ("ticker",), folds: int = FOLDS, fraction: float = TEST_FRACTION) -> DataFrame:
    """Add fold (1..folds in the test tail, 0 before it) to rows numbered by rn (from 1) within their series.

    The tail begins at int(n * (1 - fraction)), kept within 1..n-1, and is split evenly, larger folds first.
    """
    if folds < 1 or not 0 < fraction < 1:
        raise ValueError("folds must be at least 1 and fraction between 0 and 1")
    n = df.groupBy(*by).agg(F.max("rn").alias("__n"))
    split = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.col("__n") * (1 - fraction))))
    tail = F.col("__n") - split
    j, size, larger = F.col("rn") - 1 - split, F.floor(tail / folds), tail % folds
    fold = F.when(j < 0, 0).when(j < larger * (size + 1), F.floor(F.try_divide(j, size + 1)) + 1).otherwise(F.floor(F.try_divide(j - larger * (size + 1), size)) + larger + 1)
    return df.join(n, list(by)).withColumn("fold", fold.cast("int")).drop("__n")


def with_roles(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Each row once per fold that uses it: (eval_fold, role), train for all rows before the fold."""
    ks = F.expr(f"filter(sequence(1, {folds}), k -> k >= greatest(fold, 1))")
    return df.withColumn("eval_fold", F.explode(ks)).withColumn("role", F.when(F.col("fold") == F.col("eval_fold"), "test").otherwise("train"))


def valid_counts(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Per entity and fold the rows, complete cases and dates of train and test."""
    ok = F.col(target).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    aggs = []
    for role in ("train", "test"):
        mine = F.col("role") == role
        aggs += [F.count_if(mine).alias(f"{role}_rows"), F.count_if(mine & ok).alias(f"{role}_valid"), F.min(F.when(mine, F.col("date"))).alias(f"{role}_start"), F.max(F.when(mine, F.col("date"))).alias(f"{role}_end")]
    return with_roles(df).groupBy(*by, "eval_fold").agg(*aggs)


def require_estimable(counts: DataFrame) -> None:
    """Raise unless some fold has complete cases both to train and to test on; counts as from valid_counts."""
    if counts.where("train_valid > 0 AND test_valid > 0").isEmpty():
        raise ValueError("no fold has complete cases in both train and test")


def har_coefficients(df: DataFrame, by: Sequence[str] = ("ticker",), x: Sequence[str] = ("rv_d", "rv_w", "rv_m"), y: str = "target_rv5") -> DataFrame:
    """(by, eval_fold, b0, b1, b2, b3): least squares on the complete training rows of each fold.

    All folds in one aggregation of moments (combined before the shuffle), solved by Cramer's rule; null
    where the regressors are collinear.
    """
    train = with_roles(df).where("role = 'train'").na.drop(subset=[*x, y])
    cols = [*x, y]
    moments = [F.avg(c).alias(f"m_{c}") for c in cols] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    m = train.groupBy(*by, "eval_fold").agg(*moments)
    c = lambda a, b: F.col(f"c_{a}_{b}") if f"c_{a}_{b}" in m.columns else F.col(f"c_{b}_{a}")

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    base = [[c(a, b) for b in x] for a in x]
    whole = det(base)
    bs = []
    for k in range(3):
        bs.append(F.try_divide(det([[c(x[i], y) if j == k else base[i][j] for j in range(3)] for i in range(3)]), F.when(F.abs(whole) > 1e-30, whole)).alias(f"b{k + 1}"))
    out = m.select(*by, "eval_fold", F.col(f"m_{y}").alias("my"), *[F.col(f"m_{v}").alias(f"m{i + 1}") for i, v in enumerate(x)], *bs)
    return out.select(*by, "eval_fold", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2") - F.col("b3") * F.col("m3")).alias("b0"), "b1", "b2", "b3")


def forecasts(df: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Test rows with a target, long by model: persistence (today's value) and har."""
    test = df.where("fold > 0 and target_rv5 is not null").withColumn("eval_fold", F.col("fold"))
    both = test.join(har_coefficients(df, by), [*by, "eval_fold"], "left")
    har = F.col("b0") + F.col("b1") * F.col("rv_d") + F.col("b2") * F.col("rv_w") + F.col("b3") * F.col("rv_m")
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("realized_vol_5d").alias("pred")), F.struct(F.lit("har").alias("model"), har.alias("pred")))
    return both.select(*by, "date", "fold", "returns", "ret_lag_1", F.col("target_rv5").alias("actual"), F.inline(models))


def mae() -> Column:
    return F.avg(F.abs(F.col("actual") - F.col("pred")))


def qlike() -> Column:
    """Mean of r - ln r - 1 for r = pred squared / actual squared, both floored."""
    floored = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) * F.col(c), F.lit(FLOOR)))
    r = floored("pred") / floored("actual")
    return F.avg(r - F.log(r) - 1)


def directional() -> Column:
    """Share of rows with a non-zero return whose sign the lagged return has; an unknown lag counts as wrong."""
    right = F.coalesce(F.signum("ret_lag_1") == F.signum("returns"), F.lit(False)).cast("double")
    return F.avg(F.when(F.col("returns").isNull() | (F.col("returns") != 0), right))


def metrics(rows: DataFrame) -> DataFrame:
    """Per model and fold, and over all folds (fold 0), rows pooled: n_test, mae, qlike, directional_accuracy."""
    scored = rows.where("pred is not null")
    out = scored.rollup("model", "fold").agg(F.count(F.lit(1)).alias("n_test"), mae().alias("mae"), qlike().alias("qlike"), directional().alias("directional_accuracy"))
    return out.where("model is not null").na.fill({"fold": 0})


def ablation_table(m: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per model: overall_mae, fold_1_mae.., overall_qlike, overall_directional_accuracy, in one aggregation."""
    at = lambda k, c: F.max(F.when(F.col("fold") == k, F.col(c)))
    maes = [at(k, "mae").alias(f"fold_{k}_mae" if k else "overall_mae") for k in range(folds + 1)]
    return m.groupBy("model").agg(*maes, at(0, "qlike").alias("overall_qlike"), at(0, "directional_accuracy").alias("overall_directional_accuracy"))


def relative_to(m: DataFrame, baseline: str, value: str = "mae") -> DataFrame:
    """(model, fold, value, delta_abs, delta_rel) against the baseline model's row of the same fold; a zero baseline gives null."""
    base = m.where(F.col("model") == baseline).select("fold", F.col(value).alias("__b"))
    both = m.join(base, "fold", "left")
    return both.select("model", "fold", value, (F.col(value) - F.col("__b")).alias("delta_abs"), F.try_divide(F.col(value) - F.col("__b"), F.col("__b")).alias("delta_rel"))


def guardrail(m: DataFrame, model: str, reference: float, tolerance: float = 0.05) -> DataFrame:
    """(model, mae, reference, relative_error, within): a model's overall error held against a figure that was pinned before."""
    error = F.abs(F.col("mae") - reference) / reference
    return m.where((F.col("model") == model) & (F.col("fold") == 0)).select("model", "mae", F.lit(reference).alias("reference"), error.alias("relative_error"), (error <= tolerance).alias("within"))


def within_guardrail(overall: float, reference: float, tolerance: float = 0.05) -> bool:
    """Is a metric within the relative tolerance of its reference?"""
    return abs(overall - reference) / reference <= tolerance
