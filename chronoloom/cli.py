"""Command line: python -m chronoloom {baselines, ablation, import-csv, check} ...; the exit status says whether all is well."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import bars, contracts, evaluate, models, report
from chronoloom.operators.jobs import run_record
from chronoloom.plans import core
from chronoloom.session import get_session, release
from chronoloom.sources import files
from chronoloom.sources.tables import table


def _log(path: str | None, name: str, **figures: object) -> None:
    line = run_record(name, **figures)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("a") as f:
            f.write(line + "\n")


def baselines(spark: SparkSession, data: str, reference: float, tolerance: float, log: str | None) -> int:
    """Persistence and HAR over all folds; 1 if persistence is not within the tolerance of the reference."""
    m = core._metrics(spark, data)
    print(report.plain_table(m.where("fold = 0").orderBy("model"), "Overall"))
    print(report.plain_table(m.where("fold > 0").orderBy("model", "fold"), "By fold"))
    g = evaluate.guardrail(m, "persistence", reference, tolerance).first()
    good = bool(g and g["within"])
    print(f"persistence: mae {g['mae']:.6f}, reference {reference:.6f}, off by {g['relative_error']:.2%}" if g else "persistence: no rows", file=sys.stdout if good else sys.stderr)
    _log(log, "baselines", passed=good, **{f"{r['model']}_mae": r["mae"] for r in m.where("fold = 0").collect()})
    return 0 if good else 1


def ablation(spark: SparkSession, data: str, out: str, only: str | None, learner: str, log: str | None) -> int:
    """The feature sets' errors as a CSV at `out`; nothing is written, and 1 is returned, if a set can't be estimated or a figure is not finite."""
    sets = core.FEATURE_SETS if only in (None, "all") else {n: c for n, c in core.FEATURE_SETS.items() if n in ("price", only)}
    try:
        df = core._checked_sets(spark, data)
        if learner == "linear":
            rows = models.linear_sets(df, sets)
        else:
            each = [models.gbt_forecasts(df, c).withColumn("model", F.lit(n)) for n, c in sets.items()]
            rows = each[0]
            for e in each[1:]:
                rows = rows.unionByName(e)
        t = report.in_category_order(core.set_table(core.cut(evaluate.metrics(rows), "metrics")), "feature_set", list(sets)).orderBy("position").drop("position")
        contracts.check_finite(t)
    except ValueError as e:
        print(e, file=sys.stderr)
        _log(log, "ablation", passed=False, error=str(e))
        return 1
    files.write_csv(t.coalesce(1), out)
    print(report.markdown_table(t))
    _log(log, "ablation", passed=True, sets=list(sets), learner=learner)
    return 0


def import_csv(spark: SparkSession, source: str, out: str) -> int:
    """Bars of a CSV, checked and put in place of the table at `out`."""
    try:
        b = files.read_csv(spark, source, "date timestamp_ntz, " + ", ".join(f"{c} double" for c in bars.BAR_COLUMNS))
        files.promote(b, out, check=lambda df: bars.require(contracts.violations(df, {f"null_{c}": f"`{c}` IS NULL" for c in df.columns}, [["date"]])))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def check(spark: SparkSession, data: str) -> int:
    """The contracts of the tables in a folder; 1 if one is broken."""
    found = {"bars": bars.bar_violations(table(spark, data, "nvda_prices")), "news": contracts.daily_news_violations(table(spark, data, "news_scores"), ["ticker"]), "manifest": contracts.manifest_violations(table(spark, data, "transcript_manifest"), ["ticker"])}
    broken = [(n, r["violation"], r["n_rows"]) for n, v in found.items() for r in v.collect()]
    for line in broken:
        print(*line)
    return 1 if broken else 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--log", help="a file that gets a line for each run")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("baselines")
    b.add_argument("data")
    b.add_argument("--reference", type=float, default=core.PINNED_MAE)
    b.add_argument("--tolerance", type=float, default=0.05)
    a = sub.add_parser("ablation")
    a.add_argument("data")
    a.add_argument("out")
    a.add_argument("--features", choices=[*core.FEATURE_SETS, "all"], default="all")
    a.add_argument("--learner", choices=["linear", "trees"], default="linear")
    i = sub.add_parser("import-csv")
    i.add_argument("source")
    i.add_argument("out")
    c = sub.add_parser("check")
    c.add_argument("data")
    x = p.parse_args(argv)
    spark = spark or get_session(master=x.master)
    try:
        if x.what == "baselines":
            return baselines(spark, x.data, x.reference, x.tolerance, x.log)
        if x.what == "ablation":
            return ablation(spark, x.data, x.out, x.features, x.learner, x.log)
        return import_csv(spark, x.source, x.out) if x.what == "import-csv" else check(spark, x.data)
    finally:
        release()
