from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.plans import core


def test_all_features_are_ranked(spark, monkeypatch):
    names = core.FEATURE_SETS["price+all"]
    strong = {"news_count": 1.0, "vol_lag_21": 0.1, "days_since_last_call": 0.2}
    data = [(float(i), *[float(i + (i * 7 % 5) * strong[n]) if n in strong else float(i * (3 + k) % 11) for k, n in enumerate(names)]) for i in range(40)]
    df = spark.createDataFrame(data, "target_rv5 double, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(core, "_enriched", lambda spark, d: df)
    got = [(r["feature"], r["family"]) for r in core.QUERIES["topk_all_features"](spark, "").collect()]
    assert got == [("vol_lag_21", "price"), ("days_since_last_call", "finbert"), ("news_count", "news")]
    assert not {f for f, _ in got} & set(core._UNION_FEATURES)


def test_every_feature_set_is_compared(spark, monkeypatch):
    names = core.FEATURE_SETS["price+all"]
    data = [("A", i + 1, datetime(2024, 1, 1) + timedelta(i), 0.01, 1.0 + i, *[float(i)] * len(names)) for i in range(60)]
    df = spark.createDataFrame(data, "ticker string, rn int, date timestamp, returns double, target_rv5 double, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(core, "_enriched", lambda spark, d: df)

    def forecasts(df, columns):  # the more features, the larger the error
        return df.where("fold > 0").select("ticker", "date", "fold", "returns", "ret_lag_1", F.col("target_rv5").alias("actual"), F.lit("gbt").alias("model"), (F.col("target_rv5") + len(columns)).alias("pred"))

    monkeypatch.setattr(core.models, "gbt_forecasts", forecasts)
    got = {r["feature_set"]: (r["n_test"], round(r["overall_mae"]), round(r["fold_5_mae"]), round(r["delta_abs"])) for r in core.QUERIES["ablation_feature_sets"](spark, "").collect()}
    price = len(core.FEATURE_SETS["price"])
    assert got == {n: (10, len(c), len(c), len(c) - price) for n, c in core.FEATURE_SETS.items()}
    monkeypatch.setattr(core, "_enriched", lambda spark, d: df.withColumn("news_count", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="complete cases"):
        core.QUERIES["ablation_feature_sets"](spark, "")
