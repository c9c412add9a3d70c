"""Running tasks on a table: configuration, context, plan of the run, reports."""

from __future__ import annotations

import graphlib
import json
import logging
import platform
import resource
import subprocess
import time
import traceback
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..operators import meta, schema
from ..operators.multivariate import reliability_warnings
from ..plans.fused import Shared
from ..sources.readers import Datasets, as_frame, sample_rows
from . import layout, registry
from .registry import DEPTHS, TASKS, TaskSpec
from .results import TaskResult, plain

LEVELS = {"quiet": 100, "warn": logging.WARNING, "stage": 25, "info": 15, "debug": logging.DEBUG}

DEFAULTS: dict[str, Any] = {
    "metadata": {"dataset_path": None, "dataset_name": None, "output_dir": None, "message_verbosity": "info", "layout_name": "default"},
    "engine": {"profiling_depth": "standard", "reference_dataset_path": None, "enable_impact_scoring": True, "exact_quantiles": True, "order_by": [], "target_column": None, "cache": False, "stage_inference": {}},
    "resource_limits": {"enable_sampling": False, "sample_threshold_rows": 1_000_000, "sampling_strategy": "head", "max_memory_gb": 8, "max_runtime_seconds": None},
    "safety": {"strict_mode": False},
    "schema_validation": {"enable_schema_validation": False, "fail_or_warn": "warn", "schema": {}},
    "task_groups": ["core"],
    "task_selection": {"include": [], "exclude": [], "include_domains": ["core"], "include_stages": [], "exclude_stages": [], "include_runtimes": [], "include_experimental": False},
    "tasks": {},
}


def load_config(config: Mapping | str | None = None) -> dict[str, Any]:
    """The defaults with a mapping, or the contents of a YAML or JSON file, laid over them."""
    given: Mapping = {}
    if isinstance(config, str):
        text = Path(config).read_text()
        if config.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
    elif isinstance(config, Mapping):
        given = config
    elif config is not None:
        raise ValueError("config must be a mapping or a path")

    def over(base: Mapping, top: Mapping) -> dict:
        return {k: over(base[k], top[k]) if isinstance(base.get(k), Mapping) and isinstance(top.get(k), Mapping) else top.get(k, base.get(k)) for k in [*base, *(k for k in top if k not in base)]}

    return over(DEFAULTS, given)


class Context:
    """What a task sees: the table, the reference if there is one, settings, and what other tasks have found."""

    def __init__(self, df: DataFrame, reference: DataFrame | None = None, config: Mapping | None = None):
        self.df, self.reference, self.config = df, reference, load_config(config)
        self.results: dict[str, TaskResult] = {}
        self.seconds: dict[str, float] = {}
        self.metadata: dict[str, Any] = {}
        self._typed: dict[str, str] | None = None

    def params(self, task: str, **renamed: str) -> dict[str, Any]:
        """Settings of a task, under the names that its operator uses."""
        return {renamed.get(k, k): v for k, v in (self.config["tasks"].get(task) or {}).items()}

    def param(self, task: str, name: str, default: Any) -> Any:
        found = (self.config["tasks"].get(task) or {}).get(name)
        return default if found is None else found

    def option(self, name: str, default: Any) -> Any:
        found = self.config["engine"].get(name)
        return default if found is None else found

    def order(self) -> list[str]:
        return [c for c in self.option("order_by", []) if c in self.df.columns]

    def contract(self) -> dict | None:
        s = self.config["schema_validation"]
        return s.get("schema") if s.get("enable_schema_validation") else None

    def typed(self) -> DataFrame:
        rows = schema.infer_types(self.df).collect()  # one row per column
        self._typed = {r.column: r.semantic_type for r in rows}
        self.metadata["semantic_types"] = self._typed
        self.metadata["inferred_dtypes"] = {r.column: r.storage_type for r in rows}
        return self.df.sparkSession.createDataFrame(rows, "column string, storage_type string, semantic_type string")

    def semantic_types(self) -> dict[str, str]:
        """Semantic type of each column, inferred once a run."""
        if self._typed is None:
            self.typed()
        return self._typed or {}

    def columns_by_intent(self, wanted: list[str]) -> tuple[list[str], dict[str, str]]:
        """(columns of the wanted semantic types, the others with theirs); 'any' takes all."""
        types = self.semantic_types()
        chosen = [c for c, t in types.items() if "any" in wanted or t in wanted]
        return chosen, {c: t for c, t in types.items() if c not in chosen}

    def timings(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(k, float(v)) for k, v in self.seconds.items()] or [("none", 0.0)], "task string, seconds double")


def check_plan(tasks: Mapping[str, TaskSpec], config: Mapping, strict: bool = False) -> list[str]:
    """What is wrong with a configuration and the tasks' dependencies: unknown task names, unknown dependencies, cycles, plugins that registered nothing."""
    wrong = [f"unknown task in settings: {t}" for t in config.get("tasks", {}) if t not in tasks]
    picked = config.get("task_selection", {})
    wrong += [f"unknown task in selection: {t}" for t in [*picked.get("include", []), *picked.get("exclude", [])] if t not in tasks]
    wrong += [f"{t.name} depends on unknown {d}" for t in tasks.values() for d in t.depends_on if d not in tasks]
    try:
        graphlib.TopologicalSorter({t.name: t.depends_on for t in tasks.values()}).prepare()
    except graphlib.CycleError as e:
        wrong.append("cycle: " + " -> ".join(e.args[1]))
    wrong += [f"plugin {w['plugin']}: {w['warning']}" for w in registry.PLUGIN_WARNINGS]
    if strict and wrong:
        raise ValueError("; ".join(wrong))
    return wrong


def levels(tasks: Mapping[str, TaskSpec]) -> dict[str, int]:
    """How many steps each task is from the tasks without dependencies; those to run last come after all others."""
    out: dict[str, int] = {}
    for name in graphlib.TopologicalSorter({n: [d for d in t.depends_on if d in tasks] for n, t in tasks.items()}).static_order():
        out[name] = 1 + max((out[d] for d in tasks[name].depends_on if d in out), default=-1)
    top = max(out.values(), default=0)
    return {n: v + top + 1 if tasks[n].last else v for n, v in out.items()}


def plan_tasks(config: Mapping) -> dict[str, TaskSpec]:
    """The tasks of a run, in order: those of the depth asked for that meet the selection, with their dependencies; if none does, the core tasks of that depth."""
    registry.load_builtin()
    s, depth = config["task_selection"], DEPTHS.get(config["engine"]["profiling_depth"], 2)

    def fits(t: TaskSpec) -> bool:
        return (
            (not s.get("include") or t.name in s["include"])
            and t.name not in (s.get("exclude") or [])
            and (not s.get("include_domains") or t.domain in s["include_domains"])
            and (not s.get("include_stages") or t.stage in s["include_stages"])
            and t.stage not in (s.get("exclude_stages") or [])
            and (not s.get("include_runtimes") or t.runtime in s["include_runtimes"])
        )

    allowed = [t for t in TASKS.values() if DEPTHS[t.depth] <= depth or t.name in (s.get("include") or [])]
    allowed = [t for t in allowed if s.get("include_experimental") or not t.experimental]
    chosen = {t.name: t for t in allowed if fits(t)} or {t.name: t for t in allowed if t.domain == "core"}
    todo = list(chosen.values())
    while todo:
        for d in todo.pop().depends_on:
            if d in TASKS and d not in chosen:
                chosen[d] = TASKS[d]
                todo.append(TASKS[d])
    order = levels(chosen)
    return {n: chosen[n] for n in sorted(chosen, key=lambda n: (order[n], n))}


def dag_dot(tasks: Mapping[str, TaskSpec]) -> str:
    """The dependencies as a DOT graph, a rank for each level."""
    at = levels(tasks)
    lines = ["digraph tasks {", "  rankdir=LR;"]
    for k in sorted(set(at.values())):
        lines.append("  { rank=same; " + " ".join(f'"{n}";' for n in sorted(at) if at[n] == k) + " }")
    lines += [f'  "{d}" -> "{t.name}";' for t in tasks.values() for d in t.depends_on if d in tasks]
    return "\n".join([*lines, "}"])


class Engine:
    """Profiles a table. `data` may be a Spark or pandas frame, a path, or the name of a data set; else it comes from the configuration."""

    def __init__(self, spark: SparkSession, data: Any = None, config: Mapping | str | None = None, reference: Any = None, datasets: Datasets | None = None):
        self.spark, self.config = spark, load_config(config)
        self.data, self.reference, self.datasets = data, reference, datasets
        self.output = Path(self.config["metadata"]["output_dir"]) if self.config["metadata"].get("output_dir") else None
        self.log = logging.getLogger("columnaut")
        self.log.setLevel(LEVELS.get(self.config["metadata"].get("message_verbosity", "info"), 15))
        if self.output:
            self.output.mkdir(parents=True, exist_ok=True)
        self.context: Context | None = None

    def _load(self) -> DataFrame:
        m = self.config["metadata"]
        data = self.data if self.data is not None else m.get("dataset_path") or m.get("dataset_name")
        if data is None:
            raise ValueError("no table: give data, metadata.dataset_path or metadata.dataset_name")
        if isinstance(data, str) and self.datasets and data in self.datasets.names():
            return self.datasets.load(data)
        return as_frame(self.spark, data)

    def _load_reference(self) -> DataFrame | None:
        given = self.reference if self.reference is not None else self.config["engine"].get("reference_dataset_path")
        if given is None:
            return None
        try:
            return as_frame(self.spark, given)
        except Exception as e:  # a run without its reference is still of use
            self.log.warning("reference can't be read: %s", str(e).split("\n")[0])
            return None

    def run(self) -> dict[str, TaskResult]:
        """Run the tasks and return their results by name. A task that fails doesn't end the run; tasks that depend on it are skipped."""
        handler = logging.FileHandler(self.output / "run.log") if self.output else None
        if handler:
            self.log.addHandler(handler)
        try:
            return self._run()
        finally:
            if handler:
                self.log.removeHandler(handler)
                handler.close()

    def _run(self) -> dict[str, TaskResult]:
        began = time.time()
        df, sampled = self._load(), None
        limits = self.config["resource_limits"]
        if limits.get("enable_sampling"):
            df, sampled = sample_rows(df, limits["sample_threshold_rows"], limits["sampling_strategy"])
        if self.config["engine"].get("cache"):
            df = df.persist()
        context = self.context = Context(df, self._load_reference(), self.config)
        for group in self.config["task_groups"]:
            registry.load_task_group(group)
        registry.load_builtin()
        context.metadata["plan_warnings"] = check_plan(TASKS, self.config, bool(self.config["safety"].get("strict_mode")))
        stage_options = self.config["engine"].get("stage_inference") or self.config.get("stage_inference") or {}
        context.metadata["sampling"] = sampled
        tasks = plan_tasks(self.config)
        outcome: dict[str, str] = {}
        with Shared(df):
            context.metadata["inferred_stage"] = meta.infer_stage(df, **stage_options).first().stage
            for name, task in tasks.items():
                outcome[name] = self._one(task, context, outcome)
        context.metadata |= {"outcomes": outcome, "durations": context.seconds, "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "seconds": time.time() - began, "run": self._about()}
        if self.config["engine"].get("cache"):
            df.unpersist()
        if self.output:
            self.write_reports(tasks)
        return context.results

    def _one(self, task: TaskSpec, context: Context, outcome: Mapping[str, str]) -> str:
        if any(outcome.get(d) in ("failed", "skipped") for d in task.depends_on):
            return "skipped"
        limits = self.config["resource_limits"]
        self.spark.sparkContext.setJobGroup(task.name, task.display_name)
        began = time.time()
        try:
            result = task.run(context)
            if result is None:
                raise RuntimeError("the task gave no result")
            for problem in result.problems():
                self.log.warning("%s: %s", task.name, problem)
        except Exception as e:
            self.log.warning("%s failed: %s", task.name, str(e).split("\n")[0])
            result = TaskResult(task.name, "failed", str(e).split("\n")[0], error={"type": type(e).__name__, "message": str(e)[:2000], "trace": traceback.format_exc()[-2000:]})
        context.seconds[task.name] = time.time() - began
        if limits.get("max_runtime_seconds") and context.seconds[task.name] > limits["max_runtime_seconds"]:
            result.metadata["runtime_limit_exceeded"] = True
            self.log.warning("%s took %.1f s", task.name, context.seconds[task.name])
        if limits.get("max_memory_gb") and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6 > limits["max_memory_gb"]:
            result.metadata["memory_limit_exceeded"] = True
        if task.name == "compute_correlations" and result.status == "success":
            for w in reliability_warnings(context.df).collect():
                result.warn(w.level, w.code, f"columns: {', '.join(w.columns)}")
        if task.name == "schema_validation" and result.status == "success" and self.config["schema_validation"].get("fail_or_warn") == "fail":
            if result.frame.where("check = 'required_columns'").count():
                result.status = "failed"
        context.results[task.name] = result
        self.log.log(15, "%s: %s in %.2f s", task.name, result.status, context.seconds[task.name])
        return "failed" if result.status == "failed" and result.error else "success"

    def _about(self) -> dict[str, Any]:
        def git(*args: str) -> str | None:
            try:
                return subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent).stdout.strip() or None
            except (OSError, subprocess.SubprocessError):
                return None

        return {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "version": __version__, "git_sha": git("rev-parse", "--short", "HEAD"), "host": platform.node(), "os": platform.platform(), "python": platform.python_version(), "spark": self.spark.version}

    def write_reports(self, tasks: Mapping[str, TaskSpec]) -> None:
        """report.json (results but diagnostics, and the top risks), metadata_report.json, run history, the dependencies as DOT."""
        from .tasks import DIAGNOSTIC

        assert self.context and self.output
        self.context.metadata["layout_name"] = self.config["metadata"].get("layout_name")
        dicts = {n: r.to_dict() for n, r in self.context.results.items()}
        risks = sorted(({"task": n, "score": r.score, "recommendations": r.recommendations} for n, r in self.context.results.items() if r.score is not None), key=lambda x: (-x["score"], x["task"]))
        arranged = layout.arrange(layout.load_layout(self.config["metadata"].get("layout_name") or "default"), [n for n in dicts if n not in DIAGNOSTIC])
        report = {"layout": arranged, "results": {n: d for n, d in dicts.items() if n not in DIAGNOSTIC}, "top_ml_risks": risks}
        (self.output / "report.json").write_text(json.dumps(plain(report), indent=1))
        (self.output / "metadata_report.json").write_text(json.dumps(plain(self.context.metadata | {"diagnostic_results": {n: d for n, d in dicts.items() if n in DIAGNOSTIC}}), indent=1))
        (self.output / "dag.dot").write_text(dag_dot(tasks))
        add_to_history(self.output / "runs.json", plain(self.context.metadata["run"] | {"outcomes": self.context.metadata["outcomes"]}))


def add_to_history(path: Path, run: dict) -> None:
    """Append a run to the history, one entry per timestamp; a history that can't be read starts anew."""
    try:
        runs = json.loads(path.read_text()) if path.exists() else []
        if not isinstance(runs, list):
            runs = []
    except ValueError:
        runs = []
    runs = [r for r in runs if r.get("timestamp") != run["timestamp"]] + [run]
    path.write_text(json.dumps(runs, indent=1))


def profile(spark: SparkSession, data: Any, config: Mapping | str | None = None, reference: Any = None) -> dict[str, TaskResult]:
    """Profile a table and return the results by task."""
    return Engine(spark, data, config, reference).run()


