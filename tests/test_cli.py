"""The command line: exit statuses and what is written."""

import json

from chronoloom import cli
from chronoloom.sources import files

DATA = "/root/testdata/sf0.001"


def test_baselines(spark, tmp_path, capsys):
    log = f"{tmp_path}/runs/log.jsonl"
    assert cli.main(["--log", log, "baselines", DATA, "--reference", "9.0"], spark) == 1
    line = json.loads((tmp_path / "runs/log.jsonl").read_text())
    assert line["passed"] is False and "By fold" in capsys.readouterr().out
    assert cli.main(["baselines", DATA, "--reference", str(line["persistence_mae"])], spark) == 0


def test_ablation(spark, tmp_path, capsys, monkeypatch):
    out = f"{tmp_path}/ablation"
    assert cli.main(["ablation", DATA.replace("0.001", "0.01"), out, "--features", "price+news"], spark) == 0
    got = files.read_csv(spark, out, "feature_set string, overall_mae double, fold_5_mae double, n_test bigint").collect()
    assert [r["feature_set"] for r in got] == ["price", "price+news"] and all(r["overall_mae"] > 0 and r["n_test"] > 0 for r in got)
    before = sorted(p.name for p in (tmp_path / "ablation").iterdir())

    def broken(df):
        raise ValueError("contract broken: not finite")

    monkeypatch.setattr(cli.contracts, "check_finite", broken)
    assert cli.main(["ablation", DATA.replace("0.001", "0.01"), out, "--features", "price"], spark) == 1
    assert sorted(p.name for p in (tmp_path / "ablation").iterdir()) == before and "not finite" in capsys.readouterr().err


def test_import_and_check(spark, tmp_path, capsys):
    (tmp_path / "b.csv").write_text("close,date,open,high,low,volume\n1.5,2024-01-02,1,2,0.5,9\n1.6,2024-01-03,1,2,0.5,9\n")
    assert cli.main(["import-csv", f"{tmp_path}/b.csv", f"{tmp_path}/bars"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/bars").selectExpr("sum(close)").first()[0] == 3.1
    (tmp_path / "c.csv").write_text("close,date,open,high,low,volume\n1.5,2024-01-02,1,2,0.5,9\n1.6,2024-01-02,1,2,,9\n")
    assert cli.main(["import-csv", f"{tmp_path}/c.csv", f"{tmp_path}/bars"], spark) == 1
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 2 and "repeated_date" in capsys.readouterr().err
    assert cli.main(["check", DATA], spark) == 1 and "bars" in capsys.readouterr().out
