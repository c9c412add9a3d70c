import json

import pytest

from columnaut import cli
from columnaut.control import engine, registry
from columnaut.control.engine import Engine, check_plan, levels, load_config, plan_tasks, profile
from columnaut.control.results import TaskResult, plain
from columnaut.operators.meta import IMPACT, RULES, unmet_conditions
from columnaut.sources.readers import Datasets, read_table, sample_rows


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, i * 2, "ab"[i % 2], None if i % 4 == 0 else float(i), i % 2) for i in range(1, 41)]
    return spark.createDataFrame(rows, "a int, b int, c string, d double, y int")


def test_every_task_runs(spark, small, tmp_path):
    config = {"engine": {"profiling_depth": "full", "target_column": "y", "order_by": ["a"]}, "metadata": {"output_dir": str(tmp_path)}, "schema_validation": {"enable_schema_validation": True, "schema": {"required_columns": ["zz"]}}}
    run = Engine(spark, small, config, reference=small.where("a > 10"))
    results = run.run()
    assert {n for n, r in results.items() if r.status == "failed"} == set()
    assert set(results) == {n for n, t in registry.TASKS.items() if t.domain == "core"}
    assert all(not r.problems() for r in results.values())
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["results"]["detect_data_leakage"]["data"]["rows"][0] == ["a", "b", 1.0]
    assert [r["score"] for r in report["top_ml_risks"]] == sorted((r["score"] for r in report["top_ml_risks"]), reverse=True) and "detect_data_leakage" in {r["task"] for r in report["top_ml_risks"]}
    about = json.loads((tmp_path / "metadata_report.json").read_text())
    assert about["semantic_types"]["c"] == "categorical" and "log_resource_usage" in about["diagnostic_results"] and about["outcomes"]["infer_types"] == "success"
    assert len(json.loads((tmp_path / "runs.json").read_text())) == 1 and "infer_types" in (tmp_path / "dag.dot").read_text() and (tmp_path / "run.log").exists()


def test_depth_and_selection():
    basic = plan_tasks(load_config({"engine": {"profiling_depth": "basic"}}))
    full = plan_tasks(load_config({"engine": {"profiling_depth": "full"}}))
    assert set(basic) < set(full) and "compute_correlations" not in basic
    one = plan_tasks(load_config({"task_selection": {"include": ["compute_entropy"]}}))
    assert list(one) == ["infer_types", "compute_entropy"]
    assert "print_shape_debug" not in full
    order = levels(full)
    assert order["infer_types"] == 0 and order["log_resource_usage"] > max(v for n, v in order.items() if not full[n].last)
    assert plan_tasks(load_config({"task_selection": {"include_domains": ["nowhere"]}}))


def test_faults(spark, small):
    registry.load_builtin()
    assert any("unknown task" in w for w in check_plan(registry.TASKS, {"tasks": {"nonsense": {}}}))
    spec = registry.TaskSpec("x", None, depends_on=("y",))
    loop = {"x": spec, "y": registry.TaskSpec("y", None, depends_on=("x",))}
    assert any("cycle" in w for w in check_plan(loop, {})) and any("unknown" in w for w in check_plan({"x": spec}, {}))
    with pytest.raises(ValueError):
        check_plan({"x": spec}, {}, strict=True)

    @registry.register_task("breaks_for_test", domain="test", depth="basic")
    def breaks(context):
        raise KeyError("no")

    @registry.register_task("after_for_test", domain="test", depth="basic", depends_on=["breaks_for_test"])
    def after(context):
        return TaskResult("after_for_test")

    try:
        run = Engine(spark, small, {"task_selection": {"include_domains": ["test"]}})
        results = run.run()
        assert results["breaks_for_test"].status == "failed" and "after_for_test" not in results
        assert run.context.metadata["outcomes"]["after_for_test"] == "skipped"
        with pytest.raises(ValueError):
            registry.register_task("breaks_for_test")(breaks)
        with pytest.raises(ValueError):
            registry.register_task("other", stage="never")(breaks)
    finally:
        del registry.TASKS["breaks_for_test"], registry.TASKS["after_for_test"]


def test_plugins(spark, small, tmp_path):
    (tmp_path / "good.py").write_text("from columnaut.control.registry import register_task\nfrom columnaut.control.results import TaskResult\n@register_task(domain='mine')\nclass CountRows:\n    def run(self, context):\n        return TaskResult('count_rows', figures={'n': context.df.count()})\n")
    (tmp_path / "silent.py").write_text("x = 1\n")
    (tmp_path / "broken.py").write_text("1 / 0\n")
    (tmp_path / "_hidden.py").write_text("1 / 0\n")
    registry.PLUGIN_WARNINGS.clear()
    try:
        assert registry.load_task_group(str(tmp_path)) == ["count_rows"]
        assert sorted(w["plugin"].rsplit("/")[-1] for w in registry.PLUGIN_WARNINGS) == ["broken.py", "silent.py"]
        got = profile(spark, small, {"task_selection": {"include": ["count_rows", "validate_plugin_coverage"], "include_domains": []}})
        assert got["count_rows"].figures == {"n": 40} and got["validate_plugin_coverage"].frame.count() == 2
        assert "print_shape_debug" in registry.load_task_group("columnaut.plugins")
    finally:
        registry.TASKS.pop("count_rows", None)
        registry.TASKS.pop("print_shape_debug", None)
        registry.PLUGIN_WARNINGS.clear()


def test_register(spark, tmp_path):
    assert "summarize_nulls" in registry.list_tasks() and "infer_types" in registry.list_tasks("depth")["basic"] and registry.describe_task("infer_types")["stage"] == "raw"
    names = {t.name for t in registry.filter_tasks({"stage": ["modeling"], "tags": "target"})}
    assert names == {"detect_class_imbalance"} and registry.snake_case("HTTPServerTask") == "http_server_task"
    registry.write_catalogue(str(tmp_path / "t.json"))
    assert set(json.loads((tmp_path / "t.json").read_text())) == set(registry.TASKS)
    assert set(IMPACT) <= set(registry.TASKS) and {t for tasks, *_ in RULES for t in tasks} <= set(registry.TASKS)
    assert unmet_conditions({"detect_skewness": ["max_abs_skew"]}, RULES[:2]) == []


def test_results():
    r = TaskResult("x")
    r.warn("strong", "low", "few rows")
    r.signal(0.5, ["t"], "do it")
    assert not r.problems() and TaskResult("", "odd", score=2).problems() == ["no name", "status 'odd'", "score 2"]
    assert plain({"a": float("nan"), "b": (1, None), 3: {1}}) == {"a": "nan", "b": [1, None], "3": [1]}


def test_csv_and_datasets(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,f,s,d,b,e\n1,1.5,"x, y",2024-01-01 10:00:00,true,\n,NA,null,,False,N/A\n3,2,z,2024-01-02 00:00:00,TRUE,\n')
    t = read_table(spark, str(tmp_path / "t.csv"))
    assert dict(t.dtypes) == {"i": "bigint", "f": "double", "s": "string", "d": "timestamp", "b": "boolean", "e": "string"}
    assert [r.i for r in t.collect()] == [1, None, 3] and [r.s for r in t.collect()] == ["x, y", None, "z"]
    assert dict(read_table(spark, str(tmp_path / "t.csv"), schema="i int, f double, s string, d string, b boolean, e string").dtypes)["i"] == "int"
    t.write.parquet(str(tmp_path / "p.parquet"))
    t.write.json(str(tmp_path / "j.json"))
    t.write.orc(str(tmp_path / "o.orc"))
    assert all(read_table(spark, str(tmp_path / n)).count() == 3 for n in ("p.parquet", "j.json", "o.orc"))
    data = Datasets(spark, str(tmp_path))
    assert {"t", "p", "j", "o"} <= set(data.names()) and data.load("p").count() == 3
    with pytest.raises(ValueError):
        data.load("absent")
    with pytest.raises(ValueError):
        read_table(spark, "x.xlsx")
    assert "infer_types" in Engine(spark, "p", {"engine": {"profiling_depth": "basic"}, "task_selection": {"include": ["infer_types"]}}, datasets=data).run()


def test_sampling(spark):
    t = spark.range(1000).selectExpr("id", "id % 4 as g")
    assert sample_rows(t, 2000)[1] is None
    for strategy in ("head", "random", "odd"):
        got, info = sample_rows(t, 100, strategy)
        assert got.count() == 100 and info["original_rows"] == 1000
    got, _ = sample_rows(t, 400, "stratified", strata="g")
    assert {r.g for r in got.select("g").distinct().collect()} == {0, 1, 2, 3}


def test_inputs(spark, small):
    import pandas as pd

    assert profile(spark, pd.DataFrame({"q": [1.0, float("nan")]}), {"task_selection": {"include": ["summarize_nulls"]}})["summarize_nulls"].frame.first().null_count == 1
    with pytest.raises(ValueError):
        Engine(spark).run()
    with pytest.raises(ValueError):
        Engine(spark, 5).run()
    with pytest.raises(ValueError):
        load_config(5)
    x = engine.Context(small)
    assert x.columns_by_intent(["any"])[1] == {} and x.columns_by_intent(["categorical"])[0] == ["c", "y"]
    missing = Engine(spark, small, {"engine": {"reference_dataset_path": "/nowhere.csv"}, "task_selection": {"include": ["compare_with_reference_dataset"]}}).run()
    assert missing["compare_with_reference_dataset"].status == "skipped"


def test_history(tmp_path):
    p = tmp_path / "h.json"
    p.write_text("broken")
    for t in ("1", "2", "2"):
        engine.add_to_history(p, {"timestamp": t})
    assert [r["timestamp"] for r in json.loads(p.read_text())] == ["1", "2"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"dataset_path": str(tmp_path / "t.csv")}, "task_selection": {"include": ["summarize_nulls"]}}))
    (tmp_path / "c.yaml").write_text("engine: {profiling_depth: basic}\n")
    assert load_config(str(tmp_path / "c.yaml"))["engine"]["profiling_depth"] == "basic"
    assert cli.main(["version"]) == 0 and cli.main(["tasks"]) == 0
    assert cli.main(["run", "--config", str(tmp_path / "c.json"), "--strict", "--visualize-dag", "--no-report"]) == 0
    assert cli.main(["profile", str(tmp_path / "t.csv"), "--depth", "basic", "--output", str(tmp_path / "out")]) == 0
    assert cli.main(["quickstart", "t", "--folder", str(tmp_path)]) == 0
    assert "success  summarize_nulls" in capsys.readouterr().out and (tmp_path / "out" / "report.json").exists()


def test_stream(spark, tmp_path):
    from columnaut.streaming.monitor import monitor

    spark.createDataFrame([(1, None), (2, "x")], "a int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, s string").parquet(str(tmp_path / "in"))
    q = monitor(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    got = {r.column: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["s"].null_count == 1 and got["a"].n_rows == 2


def test_layouts(tmp_path):
    from columnaut.control import layout

    rows = layout.arrange(layout.load_layout(), ["infer_types", "summarize_nulls", "own_task"])
    assert [[x["task"] for x in r] for r in rows] == [["infer_types"], ["summarize_nulls"], ["own_task"]]
    path = tmp_path / "layout.json"
    path.write_text(json.dumps({"title": "t", "layout": [{"row": [{"id": "b", "width": 60}, {"id": "a", "width": 40}]}]}))
    assert layout.arrange(layout.load_layout(str(path)), ["a", "b"]) == [[{"task": "b", "width": 60}, {"task": "a", "width": 40}]]
    path.write_text(json.dumps({"layout": [{"row": [{"id": "b", "width": 60}, {"id": "a", "width": 50}]}]}))
    with pytest.raises(ValueError):
        layout.load_layout(str(path))
