"""The stage commands run end to end on the smallest tables."""

import json
import os
import tempfile

from farewise import cli
from farewise.sources import load_trips
from farewise.sources.fixture import write_trips_csv

from conftest import SF_SMALL


def test_stages_end_to_end(spark, capsys):
    base = tempfile.mkdtemp(prefix="farewise-cli-")
    csv = write_trips_csv(load_trips(spark, SF_SMALL), os.path.join(base, "raw"), with_key=False)
    trips = os.path.join(base, "taxi_parquet")
    cli.main(["ingest", "--csv", csv, "--out", trips])
    lines = capsys.readouterr().out.strip().splitlines()
    report = json.loads(next(line for line in lines if line.startswith("{")))
    assert any(line.startswith("root") for line in lines)
    assert (report["kept"], report["rejected"]) == (948, 52) and report["rows"] == report["kept"]
    assert report["columns"] == 19
    cli.main(["check", "--trips", trips])
    out = os.path.join(base, "outputs")
    cli.main(["reports", "--trips", trips, "--out", out, "--min-trips", "5"])
    for name in ("hourly_demand_revenue", "payment_split", "deviation_by_time", "toll_heavy_grids"):
        assert any(f.endswith(".csv") for f in os.listdir(os.path.join(out, name)))
    ds = os.path.join(base, "ml_fare_dataset")
    cli.main(["ml-prepare", "--trips", trips, "--out", ds, "--top-n", "10", "--partitions", "2"])
    cli.main(["ml-train", "--dataset", ds, "--out", out, "--trees", "5"])
    metrics = spark.read.option("header", True).csv(os.path.join(out, "ml_metrics")).collect()
    assert len(metrics) == 2
    cli.main(["residual-report", "--residuals", os.path.join(out, "residuals"), "--out", out])
    by_hour = spark.read.option("header", True).csv(os.path.join(out, "residuals_by_hour"))
    assert by_hour.columns == ["pickup_hour", "abs_err_model0", "abs_err_model1"]
