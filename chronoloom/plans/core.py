"""Queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import classifier
from chronoloom.functions import text as tx
from chronoloom.operators import asof, bars, contracts, eda, evaluate, features, models, news, report, scoring
from chronoloom.session import cut, scratch
from chronoloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes])


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.clean_bars(table(spark, d, "nvda_prices"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.bar_features(_bars(spark, d))


def _kept_features(spark: SparkSession, d: str) -> DataFrame:
    """The features as a table, for plans that read them more than once."""
    return cut(_features(spark, d), "features")


_BARS = """
bars AS (SELECT ticker, date, open, high, low, close, volume FROM (SELECT *, row_number() OVER
  (PARTITION BY ticker, date ORDER BY loaded_at DESC, bar_id DESC) AS k FROM nvda_prices
  WHERE ticker IS NOT NULL AND date IS NOT NULL AND close > 0) WHERE k = 1)"""
_F = f"""
WITH {_BARS},
f1 AS (SELECT *, row_number() OVER w AS rn, ln(close) - lag(ln(close)) OVER w AS returns, CASE WHEN volume > 0 THEN ln(volume) END AS lv,
  close - lag(close) OVER w AS mv FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f2 AS (SELECT *, CASE WHEN count(returns) OVER w5 >= 4 THEN sqrt(sum(returns * returns) OVER w5) END AS realized_vol_5d,
  CASE WHEN count(returns) OVER w5 >= 5 THEN sqrt(sum(returns * returns) OVER w5) END AS rv5_strict,
  CASE WHEN count(returns) OVER w21 >= 21 THEN stddev_samp(returns) OVER w21 * sqrt(252.0) END AS ann_vol_21,
  CASE WHEN count(lv) OVER w21 >= 21 AND stddev_pop(lv) OVER w21 > 1e-12 THEN (lv - avg(lv) OVER w21) / stddev_pop(lv) OVER w21 END AS z,
  sum(CASE WHEN mv IS NOT NULL THEN greatest(mv, 0.0) * (CASE WHEN rn = 2 THEN 1.0 ELSE 1.0 / 14 END) * pow(13.0 / 14, -(rn - 2)) END) OVER wa AS g,
  sum(CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0.0) * (CASE WHEN rn = 2 THEN 1.0 ELSE 1.0 / 14 END) * pow(13.0 / 14, -(rn - 2)) END) OVER wa AS l
  FROM f1 WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING),
  wa AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT *, CASE WHEN rn >= 15 THEN CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM f2),
f4 AS (SELECT *, lag(returns, 1) OVER w AS ret_lag_1, lag(returns, 5) OVER w AS ret_lag_5, lag(returns, 21) OVER w AS ret_lag_21,
  lag(realized_vol_5d, 5) OVER w AS vol_lag_5, lag(realized_vol_5d, 21) OVER w AS vol_lag_21, lag(rsi) OVER w AS rsi_14, lag(z) OVER w AS vol_zscore_21,
  lag(realized_vol_5d) OVER w AS rv_d, lead(realized_vol_5d, 5) OVER w AS target_rv5 FROM f3 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f AS (SELECT *, CASE WHEN count(rv_d) OVER w5 >= 5 THEN avg(rv_d) OVER w5 END AS rv_w, CASE WHEN count(rv_d) OVER w22 >= 22 THEN avg(rv_d) OVER w22 END AS rv_m
  FROM f4 WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w22 AS (PARTITION BY ticker ORDER BY date ROWS 21 PRECEDING))"""


def _cols(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _feature_query(name: str, *cols: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(_features(spark, d).select("ticker", "date", *cols))

    f.__name__ = name
    query(f"{_F} SELECT ticker, date, {_cols(*cols)} FROM f")(f)


# bars


@query(f"WITH {_BARS} SELECT * FROM bars")
def bars_clean(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d)


@query("""SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL""")
def bars_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return bars.order_bars(table(spark, d, "orders"))


@query("""WITH v AS (SELECT 'null_key' AS violation, count(*) FILTER (ticker IS NULL OR date IS NULL) AS n_rows FROM nvda_prices
  UNION ALL SELECT 'null_value', count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) FROM nvda_prices
  UNION ALL SELECT 'not_positive', count(*) FILTER (close <= 0 OR volume <= 0) FROM nvda_prices
  UNION ALL SELECT 'high_below_low', count(*) FILTER (high < low) FROM nvda_prices
  UNION ALL SELECT 'repeated_key', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM nvda_prices GROUP BY ticker, date))
SELECT * FROM v WHERE n_rows > 0""")
def bar_contract(spark: SparkSession, d: str) -> DataFrame:
    return bars.bar_violations(table(spark, d, "nvda_prices"))


# window features

_feature_query("log_returns", "returns")
_feature_query("realized_vol_5", "realized_vol_5d")
_feature_query("realized_vol_strict", "rv5_strict")
_feature_query("price_lags", "ret_lag_1", "ret_lag_5", "ret_lag_21", "vol_lag_5", "vol_lag_21")
_feature_query("target_lead5", "target_rv5")
_feature_query("rsi_14", "rsi_14")
_feature_query("volume_zscore_21", "vol_zscore_21")
_feature_query("rolling_ann_vol_21", "ann_vol_21")
_feature_query("har_features", "rv_d", "rv_w", "rv_m")
_feature_query("price_features_all", "returns", "realized_vol_5d", *features.PRICE_FEATURES)


@query(f"""{_F}, q AS (SELECT ticker, quantile_cont(volume, 0.99) AS p99 FROM bars GROUP BY ticker)
SELECT b.ticker, b.date, b.volume FROM bars b JOIN q USING (ticker) WHERE b.volume > p99""")
def volume_tail(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    limit = eda.percentiles(b, ["ticker"], "volume", {"p99": 0.99})
    return b.join(limit, "ticker").where("volume > p99").select("ticker", "date", "volume")


# as-of joins: scores and news onto bars

CALL_FEATURES = (*[f"finbert_{c}" for c in contracts.CALL_COLUMNS], "days_since_last_call")
NEWS_FEATURES = ("news_sent_mean", "news_risk_max", *contracts.NEWS_COUNTS)
_CALLS = f"""calls AS (SELECT score_id, ticker, call_date, {", ".join(contracts.CALL_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, call_date ORDER BY score_id DESC) AS k
  FROM finbert_scores WHERE ticker IS NOT NULL AND call_date IS NOT NULL) WHERE k = 1)"""
_NEWS = f"""nw AS (SELECT news_id, ticker, as_of, {", ".join(NEWS_FEATURES)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY news_id DESC) AS k
  FROM news_scores WHERE ticker IS NOT NULL AND as_of IS NOT NULL) WHERE k = 1)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "finbert_scores").select("score_id", "ticker", "call_date", *contracts.CALL_COLUMNS)


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_scores").select("news_id", "ticker", "as_of", *NEWS_FEATURES)


@query(f"WITH {_BARS}, {_CALLS} SELECT b.ticker, b.date, c.score_id, c.pos_mean FROM bars b ASOF LEFT JOIN calls c ON b.ticker = c.ticker AND b.date > c.call_date")
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    out = asof.asof_join(_bars(spark, d).select("ticker", "date"), _calls(spark, d), ["ticker"], "date", "call_date", strict=True, precedence=["score_id"])
    return out.select("ticker", "date", "match.score_id", "match.pos_mean")


@query(f"WITH {_BARS}, {_NEWS} SELECT b.ticker, b.date, n.news_id, n.news_sent_mean FROM bars b ASOF LEFT JOIN nw n ON b.ticker = n.ticker AND b.date >= n.as_of")
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    out = asof.asof_join(_bars(spark, d).select("ticker", "date"), _news(spark, d), ["ticker"], "date", "as_of", precedence=["news_id"])
    return out.select("ticker", "date", "match.news_id", "match.news_sent_mean")


@query(f"WITH {_BARS} SELECT c.score_id, (SELECT min(b.date) FROM bars b WHERE b.ticker = c.ticker AND b.date > c.call_date) AS effective_date FROM finbert_scores c")
def asof_next(spark: SparkSession, d: str) -> DataFrame:
    """The first trading day after each call."""
    out = asof.asof_join(_calls(spark, d), _bars(spark, d).select("ticker", "date"), ["ticker"], "call_date", "date", strict=True, forward=True)
    return out.select("score_id", F.col("match.date").alias("effective_date"))


@query(f"""WITH {_BARS}, m AS (SELECT c.call_id, b.date, row_number() OVER (PARTITION BY c.call_id ORDER BY abs(epoch_us(b.date) - epoch_us(c.call_date)), b.date) AS k
  FROM transcript_manifest c JOIN bars b ON b.ticker = c.ticker WHERE c.call_date IS NOT NULL)
SELECT c.call_id, m.date AS nearest_date FROM transcript_manifest c LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (call_id)""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "transcript_manifest").select("call_id", "ticker", "call_date")
    return asof.asof_nearest(calls, _bars(spark, d).select("ticker", "date"), ["ticker"], "call_date", "date").select("call_id", F.col("match.date").alias("nearest_date"))


@query(f"""WITH {_BARS}, {_CALLS} SELECT b.ticker, b.date, CAST(date_diff('day', CAST(c.call_date AS DATE), CAST(b.date AS DATE)) AS DOUBLE) AS days_since_last_call
FROM bars b ASOF LEFT JOIN calls c ON b.ticker = c.ticker AND b.date > c.call_date""")
def asof_days_since(spark: SparkSession, d: str) -> DataFrame:
    out = asof.asof_join(_bars(spark, d).select("ticker", "date"), _calls(spark, d), ["ticker"], "date", "call_date", strict=True, precedence=["score_id"])
    return out.select("ticker", "date", F.datediff(F.to_date("date"), F.to_date("match.call_date")).cast("double").alias("days_since_last_call"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    df = _kept_features(spark, d)
    df = asof.asof_join(df, _calls(spark, d), ["ticker"], "date", "call_date", strict=True, precedence=["score_id"], out="call")
    df = cut(df, "with_calls")
    df = asof.asof_join(df, _news(spark, d), ["ticker"], "date", "as_of", precedence=["news_id"], out="news")
    days = F.datediff(F.to_date("date"), F.to_date("call.call_date")).cast("double")
    calls = {f"finbert_{c}": F.col(f"call.{c}") for c in contracts.CALL_COLUMNS}
    return df.withColumns(calls | {"days_since_last_call": days} | {c: F.col(f"news.{c}").cast("double") for c in NEWS_FEATURES}).drop("call", "news")


def _text_sql(date: str) -> str:
    """The columns that calls (c) and news (n) give to a row with that date."""
    calls = ", ".join(f"c.{c} AS finbert_{c}" for c in contracts.CALL_COLUMNS)
    return f"{calls}, CAST(date_diff('day', CAST(c.call_date AS DATE), CAST({date} AS DATE)) AS DOUBLE) AS days_since_last_call, " + ", ".join(f"CAST(n.{c} AS DOUBLE) AS {c}" for c in NEWS_FEATURES)


@query(f"""WITH {_BARS}, {_CALLS}, {_NEWS}
SELECT b.ticker, b.date, {_text_sql("b.date")}
FROM bars b ASOF LEFT JOIN calls c ON b.ticker = c.ticker AND b.date > c.call_date ASOF LEFT JOIN nw n ON b.ticker = n.ticker AND b.date >= n.as_of""")
def asof_composed(spark: SparkSession, d: str) -> DataFrame:
    """The bars with all that calls and news before them tell: 6 and 13 columns."""
    return _enriched(spark, d).select("ticker", "date", *CALL_FEATURES, *NEWS_FEATURES)


# walk-forward

_FOLDS = f"""{_F},
n AS (SELECT ticker, max(rn) AS n FROM f GROUP BY ticker),
s AS (SELECT ticker, greatest(1, least(n - 1, CAST(floor(n * (1 - 0.165)) AS BIGINT))) AS split FROM n),
x AS (SELECT f.*, CASE WHEN rn - 1 < split THEN 0 ELSE ntile(5) OVER (PARTITION BY f.ticker, rn - 1 < split ORDER BY date) END AS fold FROM f JOIN s ON s.ticker = f.ticker),
r AS (SELECT x.*, k AS eval_fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role FROM x, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k >= greatest(fold, 1))"""
_HAR_X = ("rv_d", "rv_w", "rv_m")


def _har_sql() -> str:
    c = lambda a, b: f"c_{min(a, b)}_{max(a, b)}"
    names = (*_HAR_X, "target_rv5")
    cov = ", ".join(f"covar_pop({a}, {b}) AS {c(a, b)}" for i, a in enumerate(names) for b in names[i:])
    avg = ", ".join(f"avg({a}) AS m_{a}" for a in names)

    def det(m: list[list[str]]) -> str:
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    base = [[c(a, b) for b in _HAR_X] for a in _HAR_X]
    bs = [det([[c(_HAR_X[i], "target_rv5") if j == k else base[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return f"""{_FOLDS},
m AS (SELECT ticker, eval_fold, {avg}, {cov} FROM r WHERE role = 'train' AND rv_d IS NOT NULL AND rv_w IS NOT NULL AND rv_m IS NOT NULL AND target_rv5 IS NOT NULL GROUP BY ALL),
h0 AS (SELECT *, {", ".join(f"CASE WHEN abs({det(base)}) > 1e-30 THEN {b} / {det(base)} END AS b{k + 1}" for k, b in enumerate(bs))} FROM m),
h AS (SELECT *, m_target_rv5 - b1 * m_rv_d - b2 * m_rv_w - b3 * m_rv_m AS b0 FROM h0),
p AS (SELECT x.ticker, x.date, x.fold, x.returns, x.ret_lag_1, target_rv5 AS actual, 'persistence' AS model, realized_vol_5d AS pred FROM x WHERE fold > 0 AND target_rv5 IS NOT NULL
  UNION ALL SELECT x.ticker, x.date, x.fold, x.returns, x.ret_lag_1, target_rv5, 'har', b0 + b1 * rv_d + b2 * rv_w + b3 * rv_m
  FROM x LEFT JOIN h ON h.ticker = x.ticker AND h.eval_fold = x.fold WHERE fold > 0 AND target_rv5 IS NOT NULL),
q AS (SELECT *, greatest(pred * pred, 1e-12) / greatest(actual * actual, 1e-12) AS ratio FROM p WHERE pred IS NOT NULL),
me AS (SELECT model, coalesce(fold, 0) AS fold, count(*) AS n_test, avg(abs(actual - pred)) AS mae, avg(ratio - ln(ratio) - 1) AS qlike,
  avg(CASE WHEN returns IS NULL OR returns <> 0 THEN CASE WHEN sign(ret_lag_1) = sign(returns) THEN 1.0 ELSE 0.0 END END) AS directional_accuracy
  FROM q GROUP BY GROUPING SETS ((model, fold), (model)))"""


_ME = _har_sql()


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.with_fold(_kept_features(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return cut(evaluate.metrics(evaluate.forecasts(_folded(spark, d))), "metrics")  # a few rows, read more than once


@query(f"{_FOLDS} SELECT ticker, date, CAST(fold AS INTEGER) AS fold FROM x")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("ticker", "date", "fold")


@query(f"""{_FOLDS} SELECT ticker, CAST(eval_fold AS INTEGER) AS eval_fold, {", ".join(
    f"count(*) FILTER (role = '{r}') AS {r}_rows, count(*) FILTER (role = '{r}' AND rv_d IS NOT NULL AND rv_w IS NOT NULL AND rv_m IS NOT NULL AND target_rv5 IS NOT NULL) AS {r}_valid, "
    f"min(date) FILTER (role = '{r}') AS {r}_start, max(date) FILTER (role = '{r}') AS {r}_end" for r in ("train", "test"))} FROM r GROUP BY ALL""")
def fold_valid_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.valid_counts(_folded(spark, d), _HAR_X, "target_rv5")


_PRICE = ("realized_vol_5d", *features.PRICE_FEATURES)
FEATURE_SETS = {"price": _PRICE, "price+finbert": (*_PRICE, *CALL_FEATURES), "price+news": (*_PRICE, *NEWS_FEATURES), "price+all": (*_PRICE, *CALL_FEATURES, *NEWS_FEATURES)}


def _complete(columns: tuple[str, ...]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in (*columns, "target_rv5"))


@query(f"""{_FOLDS}, {_CALLS}, {_NEWS},
z AS (SELECT r.*, {_text_sql("r.date")}
  FROM r ASOF LEFT JOIN calls c ON r.ticker = c.ticker AND r.date > c.call_date ASOF LEFT JOIN nw n ON r.ticker = n.ticker AND r.date >= n.as_of)
SELECT feature_set, ticker, count(*) FILTER (a > 0 AND b > 0) AS n_folds FROM ({" UNION ALL ".join(
    f"SELECT '{n}' AS feature_set, ticker, eval_fold, count(*) FILTER (role = 'train' AND {_complete(c)}) AS a, count(*) FILTER (role = 'test' AND {_complete(c)}) AS b FROM z GROUP BY ALL" for n, c in FEATURE_SETS.items())}) GROUP BY ALL""")
def estimable_sets(spark: SparkSession, d: str) -> DataFrame:
    """The preflight: for each feature set and ticker, the folds that can be trained and tested."""
    df = evaluate.with_roles(evaluate.with_fold(cut(_enriched(spark, d), "enriched")))
    ok = [F.count_if((F.col("role") == r) & F.expr(_complete(c))).alias(f"{r}|{n}") for n, c in FEATURE_SETS.items() for r in ("train", "test")]
    per_fold = df.groupBy("ticker", "eval_fold").agg(*ok)
    both = [F.count_if((F.col(f"`train|{n}`") > 0) & (F.col(f"`test|{n}`") > 0)).alias(n) for n in FEATURE_SETS]
    return per_fold.groupBy("ticker").agg(*both).unpivot(["ticker"], [F.col(f"`{n}`") for n in FEATURE_SETS], "feature_set", "n_folds")


@query(f"{_ME} SELECT ticker, date, CAST(fold AS INTEGER) AS fold, round(pred, 6) AS pred, round(actual, 6) AS actual FROM p WHERE model = 'har'")
def walkforward_har(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.forecasts(_folded(spark, d)).where("model = 'har'").select("ticker", "date", "fold", "pred", "actual"))


@query(f"{_ME} SELECT CAST(fold AS INTEGER) AS fold, n_test, {_cols('mae', 'qlike', 'directional_accuracy')} FROM me WHERE model = 'persistence'")
def walkforward_persistence(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_metrics(spark, d).where("model = 'persistence'").drop("model"))


@query(f"{_ME} SELECT model, CAST(fold AS INTEGER) AS fold, {_cols('qlike')} FROM me")
def qlike_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_metrics(spark, d).select("model", "fold", "qlike"))


@query(f"{_ME} SELECT model, CAST(fold AS INTEGER) AS fold, n_test, {_cols('directional_accuracy')} FROM me")
def directional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_metrics(spark, d).select("model", "fold", "n_test", "directional_accuracy"))


@query(f"""{_ME} SELECT model, {", ".join(f"round(max(mae) FILTER (fold = {k}), 6) AS {'overall_mae' if not k else f'fold_{k}_mae'}" for k in range(6))},
  round(max(qlike) FILTER (fold = 0), 6) AS overall_qlike, round(max(directional_accuracy) FILTER (fold = 0), 6) AS overall_directional_accuracy FROM me GROUP BY model""")
def ablation_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.ablation_table(_metrics(spark, d)))


@query(f"""{_ME} SELECT a.model, CAST(a.fold AS INTEGER) AS fold, {", ".join(f"round({e}, 6) AS {n}" for e, n in (("a.mae", "mae"), ("a.mae - b.mae", "delta_abs"), ("(a.mae - b.mae) / nullif(b.mae, 0)", "delta_rel")))}
FROM me a LEFT JOIN me b ON b.model = 'persistence' AND b.fold = a.fold""")
def relative_delta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.relative_to(_metrics(spark, d), "persistence"))


@query(f"""{_ME} SELECT model, CAST(fold AS INTEGER) AS fold, metric, round(value, 6) AS value FROM
  (SELECT model, fold, 'mae' AS metric, mae AS value FROM me UNION ALL SELECT model, fold, 'qlike', qlike FROM me UNION ALL SELECT model, fold, 'directional_accuracy', directional_accuracy FROM me)""")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).select("model", "fold", "mae", "qlike", "directional_accuracy")
    return _rounded(m.unpivot(["model", "fold"], ["mae", "qlike", "directional_accuracy"], "metric", "value"))


#: The figure that persistence is held against where none other is given.
PINNED_MAE = 0.020326


@query(f"""{_ME} SELECT model, round(mae, 6) AS mae, {PINNED_MAE}::DOUBLE AS reference, round(abs(mae - {PINNED_MAE}) / {PINNED_MAE}, 6) AS relative_error, abs(mae - {PINNED_MAE}) / {PINNED_MAE} <= 0.05 AS within
FROM me WHERE fold = 0 AND model = 'persistence'""")
def persistence_guardrail(spark: SparkSession, d: str) -> DataFrame:
    """Is the overall error of persistence within 5 % of the pinned figure? (On other data than those it was pinned on it is not.)"""
    return _rounded(evaluate.guardrail(_metrics(spark, d), "persistence", PINNED_MAE), "reference")


@query()
def gbt_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Errors of boosted trees on the price features, by fold."""
    rows = models.gbt_forecasts(_folded(spark, d), FEATURE_SETS["price"])
    return evaluate.metrics(rows)


def _checked_sets(spark: SparkSession, d: str) -> DataFrame:
    """The enriched rows with their folds; raises before any fit if a feature set has no fold that can be trained and tested."""
    df = cut(evaluate.with_fold(_enriched(spark, d)), "enriched")
    for columns in FEATURE_SETS.values():
        evaluate.require_estimable(evaluate.valid_counts(df, columns, "target_rv5", by=()))
    return df


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """The errors of the trees by feature set (as model) and fold: a walk-forward for each, on its complete cases."""
    df = _checked_sets(spark, d)
    out = None
    for name, columns in FEATURE_SETS.items():
        one = models.gbt_forecasts(df, columns).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return cut(evaluate.metrics(out), "metrics")


def set_table(m: DataFrame) -> DataFrame:
    """A row for each feature set: its errors overall and by fold, the rows they are of, and its difference from price alone."""
    rel = evaluate.relative_to(m, "price").where("fold = 0").select("model", "delta_abs", "delta_rel")
    overall = m.where("fold = 0").select("model", "n_test")
    return evaluate.ablation_table(m).join(overall, "model").join(rel, "model").withColumnRenamed("model", "feature_set")


@query()
def ablation_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """The ablation of the feature sets with boosted trees: a row of errors for each, with its overall mae against that of price alone.

    n_test is the number of rows that the errors are of: sets with calls or news have fewer complete cases.
    """
    return set_table(_compared(spark, d))


def linear_ablation(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.metrics(models.linear_sets(_checked_sets(spark, d), FEATURE_SETS))
    return set_table(cut(m, "metrics"))


@query()
def ablation_sets(spark: SparkSession, d: str) -> DataFrame:
    """The same with least squares: all sets and folds from one reading of the training rows."""
    return linear_ablation(spark, d)


@query()
def ablation_report(spark: SparkSession, d: str) -> DataFrame:
    """The ablation as a report: sets in a fixed order, differences in words and as signed shares."""
    t = report.in_category_order(linear_ablation(spark, d), "feature_set", list(FEATURE_SETS))
    return t.select("position", "feature_set", report.number_text(F.col("overall_mae")).alias("mae"), report.share_text(F.col("delta_rel")).alias("change"), report.delta_sentence(F.col("feature_set"), F.col("delta_rel"), "price").alias("sentence"))


@query()
def gbt_importance(spark: SparkSession, d: str) -> DataFrame:
    """The largest importances of a fit to all complete rows, with each feature's family."""
    gains = models.importance(_enriched(spark, d), FEATURE_SETS["price+all"])
    return gains.withColumn("family", family(F.col("feature"))).orderBy(F.desc("gain"), "feature").limit(15)


def family(name):  # noqa: ANN001, ANN201
    """The family that a feature belongs to."""
    return F.when(name.startswith("finbert_") | (name == "days_since_last_call"), "finbert").when(name.startswith("news_"), "news").otherwise("price")


_UNION_FEATURES = ("ret_lag_1", "ret_lag_21", "vol_lag_5", "rsi_14", "vol_zscore_21")


@query(f"""{_F}, c AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({n}, target_rv5)) AS strength FROM f" for n in _UNION_FEATURES)})
SELECT feature, round(strength, 6) AS strength, 'price' AS family FROM c ORDER BY strength DESC, feature LIMIT 3""")
def topk_features(spark: SparkSession, d: str) -> DataFrame:
    """Of the five features in _UNION_FEATURES, the three that go along with the target most."""
    return _strongest(_features(spark, d), _UNION_FEATURES)


def _strengths(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, strength, family): each feature's correlation with the target, in size; features without one are left out."""
    # corr by its sums, as corr itself fails on a constant feature; that has no strength
    strength = lambda n: F.try_divide(F.abs(F.regr_sxy("target_rv5", n)), F.sqrt(F.regr_sxx("target_rv5", n)) * F.sqrt(F.regr_syy("target_rv5", n)))
    long = df.agg(*[strength(n).alias(n) for n in names]).unpivot([], list(names), "feature", "strength").where("strength IS NOT NULL AND NOT isnan(strength)")
    return long.select("feature", F.round("strength", 6).alias("strength"), family(F.col("feature")).alias("family"), F.col("strength").alias("__exact"))


def _strongest(df: DataFrame, names: tuple[str, ...], n: int = 3) -> DataFrame:
    return _strengths(df, names).orderBy(F.desc("__exact"), "feature").limit(n).drop("__exact")


_STRENGTHS = f"""{_F}, {_CALLS}, {_NEWS},
z AS (SELECT f.*, {_text_sql("f.date")}
  FROM f ASOF LEFT JOIN calls c ON f.ticker = c.ticker AND f.date > c.call_date ASOF LEFT JOIN nw n ON f.ticker = n.ticker AND f.date >= n.as_of),
s AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({n}, target_rv5)) AS strength FROM z" for n in FEATURE_SETS["price+all"])})
SELECT feature, round(strength, 6) AS strength, CASE WHEN starts_with(feature, 'finbert_') OR feature = 'days_since_last_call' THEN 'finbert' WHEN starts_with(feature, 'news_') THEN 'news' ELSE 'price' END AS family
FROM s WHERE strength IS NOT NULL AND NOT isnan(strength)"""


@query(f"{_STRENGTHS} ORDER BY s.strength DESC, feature LIMIT 3")
def topk_all_features(spark: SparkSession, d: str) -> DataFrame:
    """Of all features, those of calls and news too, the three that go along with the target most."""
    return _strongest(_enriched(spark, d), FEATURE_SETS["price+all"])


@query(_STRENGTHS)
def feature_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Every feature of every family with its strength."""
    return _strengths(_enriched(spark, d), FEATURE_SETS["price+all"]).drop("__exact")


# statistics

_M = "avg(power(returns - m, {})) "


@query(f"""{_F}, c AS (SELECT ticker, returns, avg(returns) OVER (PARTITION BY ticker) AS m FROM f),
g AS (SELECT ticker, count(returns) AS n, avg(returns) AS mean, stddev_samp(returns) AS std, {_M.format(3)} / power({_M.format(2)}, 1.5) AS skew, {_M.format(4)} / power({_M.format(2)}, 2) - 3 AS kurt FROM c GROUP BY ticker)
SELECT ticker, n, {_cols("mean", "std", "skew", "kurt")}, round(n / 6.0 * (skew * skew + kurt * kurt / 4), 6) AS jarque_bera, round(exp(-n / 12.0 * (skew * skew + kurt * kurt / 4)), 6) AS p_value FROM g""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.moments(_features(spark, d), ["ticker"], "returns"))


@query(f"""{_F} SELECT ticker, count(returns) AS n, {", ".join(f"round({e}, 6) AS {n}" for e, n in (("avg(returns)", "mean"), ("stddev_samp(returns)", "std"), ("min(returns)", "min"), ("max(returns)", "max"),
  ("quantile_cont(returns, 0.01)", "p01"), ("quantile_cont(returns, 0.25)", "p25"), ("quantile_cont(returns, 0.5)", "p50"), ("quantile_cont(returns, 0.75)", "p75"), ("quantile_cont(returns, 0.99)", "p99")))} FROM f GROUP BY ticker""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.describe(_features(spark, d), ["ticker"], "returns"))


@query(f"""{_F}, k AS (SELECT unnest([1, 5, 10]) AS lag)
SELECT a.ticker, CAST(lag AS INTEGER) AS lag, round(corr(a.returns, b.returns), 6) AS acf FROM f a, k, f b WHERE b.ticker = a.ticker AND b.rn = a.rn - lag AND a.returns IS NOT NULL AND b.returns IS NOT NULL GROUP BY ALL""")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.autocorrelation(_kept_features(spark, d), ["ticker"], "returns", (1, 5, 10)))


@query(f"{_F} SELECT ticker, CAST(regr_count(rv5_strict, lv) AS BIGINT) AS n, {', '.join(f'round({e}(rv5_strict, lv), 6) AS {n}' for e, n in (('regr_slope', 'slope'), ('regr_intercept', 'intercept'), ('corr', 'r')))} FROM f GROUP BY ticker")
def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    """Volatility on log volume."""
    f = _features(spark, d).withColumn("lv", F.when(F.col("volume") > 0, F.log("volume")))
    return _rounded(eda.simple_ols(f, ["ticker"], "rv5_strict", "lv"))


@query(f"""{_F}, c AS (SELECT *, avg(realized_vol_5d) OVER (PARTITION BY ticker) AS m FROM f),
g AS (SELECT ticker, avg(abs(realized_vol_5d - rv_d)) AS naive_mae, sqrt(avg(power(realized_vol_5d - rv_d, 2))) AS naive_rmse, avg(abs(realized_vol_5d - m)) AS mean_mae FROM c GROUP BY ticker)
SELECT ticker, {_cols("naive_mae", "naive_rmse", "mean_mae")}, round(1 - naive_mae / nullif(mean_mae, 0), 6) AS skill FROM g""")
def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.skill(_kept_features(spark, d), ["ticker"], "realized_vol_5d", "rv_d"))


@query(f"{_F} SELECT ticker, CAST(CASE WHEN returns < -0.1 THEN 0 WHEN returns >= 0.1 THEN 21 ELSE floor((returns + 0.1) / 0.2 * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM f WHERE returns IS NOT NULL GROUP BY ALL")
def return_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(_features(spark, d), ["ticker"], "returns", -0.1, 0.1, 20)


_REGIMES = (("first", "2021-01-01", "2021-12-31"), ("second", "2022-01-01", "2022-10-13"), ("third", "2022-10-14", "2023-05-24"), ("fourth", "2023-05-25", "2030-12-31"))


@query(f"""{_F} SELECT ticker, regime, count(ann_vol_21) AS n, round(avg(ann_vol_21), 6) AS mean FROM (SELECT *, CASE {" ".join(
    f"WHEN CAST(date AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}' THEN '{n}'" for n, lo, hi in _REGIMES)} END AS regime FROM f) WHERE regime IS NOT NULL GROUP BY ALL""")
def regime_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.regime_means(_features(spark, d), ["ticker"], "date", "ann_vol_21", _REGIMES))


@query("""WITH d AS (SELECT DISTINCT ticker, CAST(date AS DATE) AS day FROM nvda_prices WHERE ticker IS NOT NULL AND date IS NOT NULL),
s AS (SELECT ticker, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY ticker)
SELECT ticker, day FROM s ANTI JOIN d USING (ticker, day) WHERE isodow(day) < 6""")
def calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return eda.calendar_gaps(table(spark, d, "nvda_prices"), ["ticker"], "date")


@query(f"WITH {_BARS} SELECT ticker, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS total_return FROM bars GROUP BY ticker")
def total_return(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.total_return(_bars(spark, d), ["ticker"], "date", "close"))


@query("SELECT CAST(day AS DATE) AS day, day AS day_start, day + INTERVAL 1 DAY - INTERVAL 1 SECOND AS day_end FROM (SELECT unnest(generate_series(TIMESTAMP '2026-03-01', TIMESTAMP '2026-04-17', INTERVAL 1 DAY)) AS day)")
def day_windows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(eda.day_windows("2026-03-01", "2026-04-17"))


@query(f"""{_F} SELECT 'price' AS span, min(date) AS first_date, max(date) AS last_date FROM f UNION ALL SELECT 'target', min(date), max(date) FROM f WHERE target_rv5 IS NOT NULL
UNION ALL SELECT 'features', min(date), max(date) FROM f WHERE ret_lag_21 IS NOT NULL AND vol_lag_21 IS NOT NULL UNION ALL SELECT 'news', min(as_of), max(as_of) FROM news_scores""")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = _kept_features(spark, d)
    span = lambda df, n, c: df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date")).select(F.lit(n).alias("span"), "first_date", "last_date")
    return span(f, "price", "date").unionByName(span(f.where("target_rv5 IS NOT NULL"), "target", "date")).unionByName(span(f.where("ret_lag_21 IS NOT NULL AND vol_lag_21 IS NOT NULL"), "features", "date")).unionByName(span(table(spark, d, "news_scores"), "news", "as_of"))


# articles


@query(f"""SELECT ticker, CAST(received_at AS DATE) AS as_of_day, round(avg(sentiment_score), 6) AS news_sent_mean, round(max(risk_score), 6) AS news_risk_max, count(*) AS news_count,
  {", ".join(f"CAST(sum(CASE WHEN list_contains(topic_tags, '{t}') THEN 1 ELSE 0 END) AS BIGINT) AS news_topic_{t}" for t in news.TAGS)}
FROM article_score WHERE ticker IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL""")
def daily_news(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(news.daily_news(table(spark, d, "article_score"), F.to_date("received_at")))


@query(f"SELECT article_id, list_filter([{', '.join(repr(t) for t in news.TAGS)}], lambda t: list_contains(topic_tags, t)) AS tags FROM article_score")
def tag_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_score").select("article_id", news.normalise_tags(F.col("topic_tags")).alias("tags"))


_DEDUP_KEY = "trim(coalesce(nullif(title, ''), nullif(source_name, ''), '')), trim(coalesce(nullif(published_at, ''), nullif(as_of, ''), ''))"


@query(f"SELECT article_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {_DEDUP_KEY} ORDER BY article_id) AS k FROM article_score) WHERE k = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_score").select("article_id", "url", "title", "source_name", "published_at", "as_of")
    return _first_articles(a, " ")


def _first_articles(a: DataFrame, strip: str) -> DataFrame:
    key = [news.first_text(F.col("title"), F.col("source_name"), strip=strip), news.first_text(F.col("published_at"), F.col("as_of"), strip=strip)]
    return news.first_wins(a, key, "article_id").select("article_id", "url")


def _stripped(*values: str) -> str:
    return f"trim(coalesce({', '.join(f"nullif({v}, '')" for v in values)}, ''), {' || '.join(f'chr({ord(c)})' for c in news.WHITE)})"


@query(f"SELECT article_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {_stripped('title', 'source_name')}, {_stripped('published_at', 'as_of')} ORDER BY article_id) AS k FROM article_score) WHERE k = 1")
def dedup_stripped(spark: SparkSession, d: str) -> DataFrame:
    """The same with all white space around the keys left out, not spaces alone."""
    return _first_articles(table(spark, d, "article_score").select("article_id", "url", "title", "source_name", "published_at", "as_of"), news.WHITE)


@query("""SELECT url, title, published_at, arg_max(sentiment_score, article_id) FILTER (true) AS sentiment_score, max(article_id) AS last_id, min(article_id) AS first_seen
FROM (SELECT url, title, published_at, article_id, coalesce(sentiment_score, -9) AS sentiment_score FROM article_score) GROUP BY ALL""")
def checkpoint_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_score").select(*news.KEY, "article_id", F.coalesce("sentiment_score", F.lit(-9.0)).alias("sentiment_score"))
    return news.last_wins(a, news.KEY, "article_id").select(*news.KEY, "sentiment_score", F.col("article_id").alias("last_id"), "first_seen")


@query("""SELECT a.article_id FROM article_score a WHERE a.batch_id >= 1 AND NOT EXISTS (SELECT 1 FROM article_score b WHERE b.batch_id = 0
  AND b.url IS NOT DISTINCT FROM a.url AND b.title IS NOT DISTINCT FROM a.title AND b.published_at IS NOT DISTINCT FROM a.published_at)""")
def pending_articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_score").select("article_id", "batch_id", *news.KEY)
    return news.pending(a.where("batch_id >= 1"), a.where("batch_id = 0")).select("article_id")


@query("""WITH o AS (SELECT url, max(article_id) AS rank FROM article_score WHERE batch_id = 0 AND url IS NOT NULL GROUP BY url)
SELECT a.article_id, coalesce(o.rank, 9223372036854775807) AS position FROM article_score a LEFT JOIN o USING (url)""")
def ordered_output(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_score").select("article_id", "batch_id", "url")
    order = a.where("batch_id = 0 AND url IS NOT NULL").select("url", F.col("article_id").alias("rank"))
    return news.in_given_order(a, order, "url", "rank").select("article_id", "position")


_RUN = "SELECT batch_id, article_id, CAST(sum(input_tokens + output_tokens) OVER (PARTITION BY batch_id ORDER BY article_id) AS BIGINT) AS running FROM article_score"


def _running(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_score").select("batch_id", "article_id", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.floor(F.col("article_id") / 8192).alias("block"))
    return news.running_total(a, ["batch_id"], ["article_id"], "block", "tokens").select("batch_id", "article_id", "running")


@query(_RUN)
def running_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _running(spark, d)


@query(f"SELECT batch_id, article_id FROM ({_RUN}) WHERE running <= 100000")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    """The articles of each batch that a budget of tokens lets through."""
    return _running(spark, d).where("running <= 100000").select("batch_id", "article_id")


@query(f"SELECT batch_id, f AS fraction, min(article_id) AS article_id FROM ({_RUN}) r, (SELECT CAST(unnest([0.25, 0.5, 1.0]) AS DOUBLE) AS f) WHERE running >= f * 200000 GROUP BY ALL")
def alert_crossings(spark: SparkSession, d: str) -> DataFrame:
    return news.crossings(_running(spark, d), ["batch_id"], ["article_id"], "running", 200_000, (0.25, 0.5, 1.0))


@query("""SELECT batch_id, count(*) AS n_articles, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(CASE WHEN sentiment_score IS NULL OR risk_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS drop_rate
FROM article_score GROUP BY batch_id""")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    drop = F.when(F.col("sentiment_score").isNull() | F.col("risk_score").isNull(), 1.0).otherwise(0.0)
    g = table(spark, d, "article_score").groupBy("batch_id")
    return g.agg(F.count(F.lit(1)).alias("n_articles"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg(drop), 6).alias("drop_rate"))


_RATES = {"input_tokens": 1.0, "output_tokens": 5.0, "cache_creation_input_tokens": 1.25, "cache_read_input_tokens": 0.1}


@query(f"SELECT article_id, round({' + '.join(f'coalesce({t}, 0) / 1000000.0 * {r}' for t, r in _RATES.items())}, 9) AS cost FROM article_score")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Each article's cost at given rates per million tokens (the rates are a parameter)."""
    return table(spark, d, "article_score").select("article_id", F.round(scoring.token_cost(_RATES), 9).alias("cost"))


@query("""SELECT count(*) AS scored, 7::BIGINT AS dropped, greatest((SELECT count(*) FROM article_score) - count(*) - 7, 0)::BIGINT AS remaining, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(total_cost_usd), 6) AS total_cost_usd, round(sum(total_cost_usd) / 50.0, 6) AS cap_share FROM article_score WHERE batch_id <= 2""")
def cost_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a run that has scored the first batches has cost, against a cap of 50, with 7 articles dropped."""
    a = table(spark, d, "article_score")
    return _rounded(scoring.cost_totals(a.where("batch_id <= 2"), a.count(), 7, 50.0))


@query("""SELECT article_id, md5('Score the article.' || chr(10) || chr(10) || 'published: ' || coalesce(published_at, '') || chr(10) || 'source: ' || coalesce(source_name, '') || chr(10) || 'title: ' || coalesce(title, '')) AS prompt_md5
FROM article_score""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of the articles."""
    p = scoring.prompt("Score the article.", {"published": F.col("published_at"), "source": F.col("source_name"), "title": F.col("title")})
    return table(spark, d, "article_score").select("article_id", F.md5(p).alias("prompt_md5"))


_TAGS_SQL = f"[{', '.join(repr(t) for t in news.TAGS)}]"


@query(f"""WITH a AS (SELECT article_id, sentiment_score * 1.02 AS s, risk_score AS r, topic_tags AS t, article_id % 7 = 3 AS broken FROM article_score),
g AS (SELECT *, coalesce(NOT broken AND s BETWEEN -1 AND 1 AND r BETWEEN 0 AND 1 AND len(list_filter(coalesce(t, []), lambda x: x IS NULL OR NOT list_contains({_TAGS_SQL}, x))) = 0, false) AS ok FROM a)
SELECT article_id, CASE WHEN ok THEN round(s, 6) END AS sentiment_score, CASE WHEN ok THEN round(r, 6) END AS risk_score, CASE WHEN ok THEN list_filter({_TAGS_SQL}, lambda x: coalesce(list_contains(t, x), false)) END AS topic_tags FROM g""")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers in JSON, made from the articles' scores, some out of range and some cut off, and read again: null where one is unusable."""
    a = table(spark, d, "article_score")
    whole = F.to_json(F.struct((F.col("sentiment_score") * 1.02).alias("sentiment_score"), "risk_score", "topic_tags"))
    text = F.when(F.col("article_id") % 7 == 3, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    got = a.select("article_id", scoring.parsed_answer(text).alias("x"))
    return _rounded(got.select("article_id", "x.sentiment_score", "x.risk_score", "x.topic_tags"))


_TAG_LIST = ", ".join(f"'{t}'" for t in news.TAGS)


@query(f"""WITH c AS (SELECT count(*) FILTER (url IS NULL OR title IS NULL) AS null_key, count(*) FILTER (sentiment_score IS NULL OR risk_score IS NULL) AS null_score,
  count(*) FILTER (NOT sentiment_score BETWEEN -1 AND 1) AS sentiment_range, count(*) FILTER (NOT risk_score BETWEEN 0 AND 1) AS risk_range,
  count(*) FILTER (least(input_tokens, output_tokens, cache_creation_input_tokens, cache_read_input_tokens) < 0) AS negative_tokens, count(*) FILTER (total_cost_usd < 0) AS negative_cost,
  count(*) FILTER (len(list_filter(topic_tags, lambda t: t NOT IN ({_TAG_LIST}))) > 0) AS unknown_tag, count(*) FILTER (len(list_distinct(topic_tags)) < len(topic_tags)) AS repeated_tag FROM article_score)
SELECT violation, n_rows FROM (UNPIVOT c ON COLUMNS(*) INTO NAME violation VALUE n_rows) WHERE n_rows > 0""")
def score_contract(spark: SparkSession, d: str) -> DataFrame:
    return news.score_violations(table(spark, d, "article_score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 99, false) AS valid FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(k.between(0, 99), F.lit(False)).alias("valid"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate's batch twin."""
    from chronoloom.streaming.daily import daily_counts

    return _rounded(daily_counts(table(spark, d, "events"), "ts", ["event_id"]))


# texts


_SENTENCES = rf"""s1 AS (SELECT doc_id, regexp_replace(replace(text, chr(1), ' '), '\r\n?', chr(10), 'g') AS t FROM documents),
s2 AS (SELECT doc_id, regexp_replace(t, '([.!?])\n\n+', '\1' || chr(1), 'g') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(t, '{tx.SPACE}+', ' ', 'g') AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(t, '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g') AS t FROM s3),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda p: trim(p, ' ')), lambda p: len(string_split(p, ' ')) >= 4) AS s FROM s4)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(CASE WHEN s IS NOT NULL THEN coalesce(list_sum(list_transform(s, lambda p: len(string_split(p, ' ')))), 0) END AS BIGINT) AS n_words, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    words = F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.size(F.split(x, " ")))
    return s.select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n_sentences"), words.alias("n_words"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query()
def scorer_udf(spark: SparkSession, d: str) -> DataFrame:
    """Calls split into sentences, scored in batches and brought together per document, by a classifier trained on the articles' titles and scores."""
    labelled = table(spark, d, "article_score").select("title", classifier.label(F.col("sentiment_score")).alias("label"))
    scorer = classifier.train(labelled, "title", "label")
    s = table(spark, d, "documents").where("doc_kind = 'call'").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))
    return _rounded(tx.call_aggregate(tx.score_sentences(s, "sentence", scorer), "doc_id"))


@query("""SELECT ticker, count(*) AS n_scores, round(avg(pos_mean), 6) AS pos_mean, round(avg(neg_mean), 6) AS neg_mean, round(avg(CASE WHEN pos_mean >= neg_mean AND pos_mean >= neu_mean THEN 1.0 ELSE 0.0 END), 6) AS pos_frac,
  round(avg(CASE WHEN NOT (pos_mean >= neg_mean AND pos_mean >= neu_mean) AND neg_mean >= neu_mean THEN 1.0 ELSE 0.0 END), 6) AS neg_frac
FROM finbert_scores WHERE pos_mean IS NOT NULL AND neg_mean IS NOT NULL AND neu_mean IS NOT NULL GROUP BY ticker""")
def call_aggregate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "finbert_scores").na.drop(subset=["pos_mean", "neg_mean", "neu_mean"])
    s = s.select("ticker", F.struct(F.col("pos_mean").alias("pos"), F.col("neg_mean").alias("neg"), F.col("neu_mean").alias("neu")).alias("score"))
    return _rounded(tx.call_aggregate(s, "ticker").select("ticker", F.col("n_sentences").alias("n_scores"), "pos_mean", "neg_mean", "pos_frac", "neg_frac"))


_START, _END = ("Prepared remarks", "Ladies and gentlemen"), ("All rights reserved", "See the terms page")


@query("""WITH s AS (SELECT doc_id, list_min(list_filter([instr(text, 'Prepared remarks'), instr(text, 'Ladies and gentlemen')], lambda p: p > 0)) AS a, text FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, substr(text, coalesce(a, 1)) AS rest FROM s),
e AS (SELECT doc_id, rest, list_min(list_filter([instr(rest, 'All rights reserved'), instr(rest, 'See the terms page')], lambda p: p > 0)) AS b FROM r)
SELECT doc_id, md5(trim(CASE WHEN b IS NOT NULL THEN substr(rest, 1, b - 1) ELSE rest END, chr(32) || chr(9) || chr(13) || chr(10))) AS section FROM e""")
def marker_trim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.trimmed(F.col("text"), _START, _END)).alias("section"))


@query("""SELECT doc_id, list_filter([CASE WHEN length(text) < 8000 THEN 'too_short' END, CASE WHEN NOT contains(text, 'Operator') THEN 'no_Operator' END, CASE WHEN NOT contains(text, 'Analyst') THEN 'no_Analyst' END,
  CASE WHEN NOT contains(text, 'question') THEN 'no_question' END, CASE WHEN NOT contains(text, 'quarter') THEN 'no_quarter' END, CASE WHEN NOT contains(text, regexp_extract(fiscal_period, '[0-9]{4}', 0)) THEN 'no_call_year' END], lambda x: x IS NOT NULL) AS faults
FROM documents WHERE doc_kind = 'call' AND text IS NOT NULL""")
def transcript_contract(spark: SparkSession, d: str) -> DataFrame:
    """What the calls' transcripts lack: length, markers, the year of their period."""
    t = table(spark, d, "documents").where("doc_kind = 'call' AND text IS NOT NULL")
    return t.select("doc_id", contracts.transcript_faults(F.col("text"), F.regexp_extract("fiscal_period", "[0-9]{4}", 0), ("Operator", "Analyst", "question", "quarter")).alias("faults"))


_ATTRIBUTES = """([^<>"']|"[^"]*"|'[^']*')*>""".replace("'", "''")
_HTML = rf"""h1 AS (SELECT doc_id, regexp_replace(text, '<!--.*?(-->|$)|<script\b[^>]*>.*?(</script\s*>|$)|<style\b[^>]*>.*?(</style\s*>|$)|<noscript\b[^>]*>.*?(</noscript\s*>|$)|<[!?][^>]*>', chr(2), 'gis') AS t FROM documents),
h2 AS (SELECT doc_id, regexp_replace(t, '<(/?(p|div|li|h1|h2|h3|section)|br)\b{_ATTRIBUTES}', chr(1), 'gi') AS t FROM h1),
h3 AS (SELECT doc_id, replace(replace(regexp_replace(t, '</?[a-z]{_ATTRIBUTES}', chr(2), 'gi'), '&#39;', chr(39)), '&amp;', '&') AS t FROM h2),
h4 AS (SELECT doc_id, list_transform(string_split(t, chr(1)), lambda l: array_to_string(list_transform(string_split(l, chr(2)), lambda p: trim(regexp_replace(p, '{tx.SPACE}+', ' ', 'g'), ' ')), '')) AS lines FROM h3),
h AS (SELECT doc_id, CASE WHEN lines IS NOT NULL THEN array_to_string(list_filter(lines, lambda l: l <> ''), chr(10)) || chr(10) END AS shown FROM h4)"""


@query(f"WITH {_HTML} SELECT doc_id, md5(shown) AS shown_md5, CAST(length(shown) AS INTEGER) AS n_shown FROM h")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of the documents, taken as pages."""
    return tx.visible(table(spark, d, "documents").select("doc_id", "text"), "text", "shown").select("doc_id", F.md5("shown").alias("shown_md5"), F.length("shown").alias("n_shown"))


@query("""SELECT call_id, fiscal_period FROM (SELECT call_id, fiscal_period, count(*) OVER (PARTITION BY ticker, CAST(call_date AS DATE)) AS n FROM transcript_manifest WHERE call_date IS NOT NULL AND ticker IS NOT NULL) WHERE n > 1""")
def manifest_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The manifest contract's uniqueness: calls that are listed more than once for a day."""
    m = table(spark, d, "transcript_manifest").where("call_date IS NOT NULL AND ticker IS NOT NULL").withColumn("day", F.to_date("call_date"))
    many = m.groupBy("ticker", "day").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return m.join(many, ["ticker", "day"], "left_semi").select("call_id", "fiscal_period")


@query("""WITH v AS (SELECT 'null_call_date' AS violation, count(*) FILTER (call_date IS NULL) AS n_rows FROM transcript_manifest
  UNION ALL SELECT 'repeated_ticker_' || k, CAST(sum(n - 1) AS BIGINT) FROM (SELECT 'call_date' AS k, count(*) AS n FROM transcript_manifest WHERE call_date IS NOT NULL GROUP BY ticker, call_date
    UNION ALL SELECT 'filename', count(*) FROM transcript_manifest WHERE filename IS NOT NULL GROUP BY ticker, filename
    UNION ALL SELECT 'fiscal_period', count(*) FROM transcript_manifest WHERE fiscal_period IS NOT NULL GROUP BY ticker, fiscal_period) GROUP BY k)
SELECT violation, n_rows FROM v WHERE n_rows > 0""")
def manifest_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.manifest_violations(table(spark, d, "transcript_manifest"), ["ticker"])


@query(f"""WITH n AS (SELECT * FROM news_scores), c AS (SELECT {", ".join(f"count(*) FILTER ({x} IS NULL) AS null_{x}" for x in ("ticker", "as_of", *NEWS_FEATURES))}, {", ".join(f"count(*) FILTER ({x} < 0) AS negative_{x}" for x in contracts.NEWS_COUNTS)} FROM n),
r AS (SELECT CAST(sum(k - 1) AS BIGINT) AS n_rows FROM (SELECT count(*) AS k FROM n GROUP BY ticker, as_of))
SELECT violation, n_rows FROM (UNPIVOT c ON COLUMNS(*) INTO NAME violation VALUE n_rows) WHERE n_rows > 0 UNION ALL SELECT 'repeated_ticker_as_of', n_rows FROM r WHERE n_rows > 0""")
def daily_news_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.daily_news_violations(table(spark, d, "news_scores"), ["ticker"])


# reports and runs


@query(f"""WITH o AS (SELECT unnest({_TAGS_SQL}) AS tag, unnest(range(1, {len(news.TAGS) + 1})) AS position), t AS (SELECT batch_id, unnest(list_distinct(topic_tags)) AS tag FROM article_score),
n AS (SELECT tag, count(*) AS n FROM t WHERE batch_id = 1 GROUP BY tag HAVING count(*) % 2 = 0), b AS (SELECT count(*) AS n FROM article_score WHERE batch_id = 1)
SELECT tag, n.n AS n_articles, round(n.n / b.n, 6) AS share, CASE WHEN n.n IS NULL THEN 'nan' ELSE printf('%.2f', CAST(n.n AS DOUBLE)) END AS n_text, CAST(position AS INTEGER) AS position FROM o LEFT JOIN n USING (tag), b""")
def tag_table(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the first later batch by topic, in the fixed order of topics; topics without a row (here: those with an odd number) stay, with nulls."""
    a = table(spark, d, "article_score").where("batch_id = 1")
    counts = a.select(F.explode(F.array_distinct("topic_tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_articles")).where("n_articles % 2 = 0")
    t = report.in_category_order(counts, "tag", news.TAGS)
    return t.select("tag", "n_articles", F.round(F.col("n_articles") / F.lit(a.count()), 6).alias("share"), report.number_text(F.col("n_articles"), 2).alias("n_text"), "position")


@query(f"""SELECT article_id, {_stripped("source_name", "feed")} AS source_name, {_stripped("title")} AS title, {_stripped("as_of")} AS body, {_stripped("url")} AS url, {_stripped("published_at")} AS published_at FROM article_score""")
def common_articles(spark: SparkSession, d: str) -> DataFrame:
    """The articles, taken as a vendor's records, in the common form."""
    raw = table(spark, d, "article_score").select("article_id", F.col("source_name").alias("publisher"), F.col("feed").alias("site"), "title", F.col("as_of").alias("text"), "url", F.col("published_at").alias("publishedDate"))
    return raw.select("article_id", *[c.alias(n) for n, c in news.common_article("B").items()])


@query("""WITH k AS (SELECT url, title, published_at, min(article_id) AS article_id FROM article_score WHERE batch_id >= 1 GROUP BY ALL)
SELECT article_id FROM k WHERE NOT EXISTS (SELECT 1 FROM article_score b WHERE b.batch_id = 0 AND b.url IS NOT DISTINCT FROM k.url AND b.title IS NOT DISTINCT FROM k.title AND b.published_at IS NOT DISTINCT FROM k.published_at) ORDER BY article_id LIMIT 500""")
def next_articles(spark: SparkSession, d: str) -> DataFrame:
    """The next 500 articles, in order of arrival, whose key the first batch has not brought: what a run with that limit would score."""
    a = table(spark, d, "article_score").select("article_id", "batch_id", *news.KEY)
    return scoring.next_pending(a.where("batch_id >= 1"), a.where("batch_id = 0"), 500, "article_id").select("article_id")


def _by_length(title: str) -> tuple[str, dict[str, int]]:
    """Stands in for a model: the scores follow from the title's length, and some answers are unusable."""
    n = len(title)
    if n % 50 == 0:
        return "{}", {"input_tokens": n}
    tags = ["macro"] * (n % 2) + ["earnings"] * (n % 3 == 0)
    return json.dumps({"sentiment_score": (n % 21 - 10) / 11, "risk_score": n % 11 / 10, "topic_tags": tags}), {"input_tokens": n, "output_tokens": 1}


@query(f"""WITH k AS (SELECT url, title, received_at, min(article_id) AS id FROM article_score WHERE url IS NOT NULL AND title IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL),
s AS (SELECT CAST(CAST(received_at AS DATE) AS TIMESTAMP) AS as_of, length(title) AS n FROM k WHERE length(title) % 50 <> 0)
SELECT as_of, round(avg((n % 21 - 10) / 11.0), 6) AS news_sent_mean, round(max(n % 11 / 10.0), 6) AS news_risk_max, count(*) AS news_count,
  {", ".join(f"CAST(sum({dict(macro='n % 2', earnings='CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END').get(t, '0')}) AS BIGINT) AS news_topic_{t}" for t in news.TAGS)} FROM s GROUP BY as_of""")
def scoring_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run: the articles scored in waves by a stand-in for a model, checkpointed, and the daily table that it promotes."""
    a = table(spark, d, "article_score").where("url is not null and title is not null and received_at is not null")
    a = a.select("url", "title", "source_name", F.col("received_at").alias("published_at"), F.col("article_id").alias("seq"), F.col("title").alias("prompt"))
    at = scratch(spark, "scoring")
    limits = scoring.Limits(cost_cap=1e9, max_drop_rate=1.0, wave=1_000_000, at_once=max(8, spark.sparkContext.defaultParallelism), per_minute=1e12, pause=0.0)
    out = scoring.run_scoring(cut(a, "articles"), _by_length, limits, {"input_tokens": 1.0}, f"{at}/checkpoint", f"{at}/raw", f"{at}/daily")
    if out.code:
        raise RuntimeError(f"{out.status}: {out.message}")
    return _rounded(spark.read.parquet(f"{at}/daily"))


# more statistics


@query(f"""{_F} SELECT ticker, count(returns) AS n, round(avg(returns) * 252, 6) AS mean_per_year, round(stddev_samp(returns) * sqrt(252.0), 6) AS std_per_year FROM f GROUP BY ticker""")
def annualised(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.annualised(_features(spark, d), ["ticker"], "returns"))


@query(f"""{_F}, k AS (SELECT unnest([1, 5, 10]) AS lag), c AS (SELECT ticker, count(returns) AS n FROM f GROUP BY ticker),
a AS (SELECT a.ticker, CAST(lag AS INTEGER) AS lag, corr(a.returns, b.returns) AS acf FROM f a, k, f b WHERE b.ticker = a.ticker AND b.rn = a.rn - lag AND a.returns IS NOT NULL AND b.returns IS NOT NULL GROUP BY ALL)
SELECT ticker, lag, round(acf, 6) AS acf, round(1.96 / sqrt(n), 6) AS band, abs(acf) > 1.96 / sqrt(n) AS stands_out FROM a JOIN c USING (ticker)""")
def acf_bands(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.acf_with_bands(_kept_features(spark, d), ["ticker"], "returns", (1, 5, 10)))


@query(f"""{_F}, c AS (SELECT ticker, returns, avg(returns) OVER (PARTITION BY ticker) AS m FROM f),
g AS (SELECT ticker, count(returns) AS n, avg(returns) AS mean, stddev_samp(returns) AS std, {_M.format(4)} / power({_M.format(2)}, 2) - 3 AS kurt FROM c GROUP BY ticker),
t AS (SELECT *, CASE WHEN kurt > 0 THEN 4 + 6 / kurt END AS v FROM g) SELECT ticker, n, {_cols("mean", "std")}, round(v, 6) AS t_degrees, round(std * sqrt((v - 2) / v), 6) AS t_scale FROM t""")
def fitted_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(eda.fitted_shapes(_features(spark, d), ["ticker"], "returns"))


@query(f"""{_F}, p AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS p), z AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS p,
  unnest([-1.2815515655446008, -0.8416212335729142, -0.5244005127080409, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080407, 0.8416212335729143, 1.2815515655446008]) AS z),
g AS (SELECT ticker, avg(returns) AS m, stddev_samp(returns) AS s, quantile_cont(returns, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM f GROUP BY ticker)
SELECT ticker, p, round(q[CAST(round(p * 10) AS INTEGER)], 6) AS sample, round(m + s * z, 6) AS normal FROM g, z""")
def quantile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of returns beside the normal distribution's."""
    return _rounded(eda.quantile_pairs(_features(spark, d), ["ticker"], "returns", 9), "p")
