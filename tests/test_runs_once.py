"""The runs are sorted once, after they are dealt, and once for the whole report."""

from bitekst.plans import inputs, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_sort_of_the_runs(spark):
    rows = plan(inputs.runs(spark, SF))
    assert rows.count("Sort [") == 1 and rows.count("Exchange hashpartitioning") == 1


def test_report_asks_the_lines_once(spark, monkeypatch):
    seen = []
    runs = inputs.runs
    monkeypatch.setattr(inputs, "runs", lambda *of: seen.append(1) or runs(*of))
    report = queries.QUERIES["final_report"](spark, SF)
    assert report.count() == 1 and len(seen) == 1
    assert "lineitem" not in plan(report)
