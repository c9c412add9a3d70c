"""The register of tasks: named functions of a context that give a TaskResult, with what the planner needs to know about them."""

from __future__ import annotations

import importlib
import importlib.util
import json
import pkgutil
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

STAGES = ("raw", "cleaned", "modeling", "report", "any")
DEPTHS = {"basic": 1, "standard": 2, "full": 3}


@dataclass(frozen=True)
class TaskSpec:
    name: str
    run: Callable = field(compare=False)
    depth: str = "standard"
    display_name: str = ""
    description: str = ""
    depends_on: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    stage: str = "any"
    domain: str = "core"
    runtime: str = "fast"
    inputs: tuple[str, ...] = ("dataframe",)
    outputs: tuple[str, ...] = ("TaskResult",)
    experimental: bool = False
    semantic_types: tuple[str, ...] = ("any",)
    last: bool = False  # runs after all tasks that aren't

    def as_dict(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "run"}


TASKS: dict[str, TaskSpec] = {}
PLUGIN_WARNINGS: list[dict[str, str]] = []


def snake_case(name: str) -> str:
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[A-Z]+", name)
    return "_".join(words).lower() or name


def register_task(name: str | None = None, **spec) -> Callable:
    """Decorator: register a function (or a class with run(context)) as a task. The name follows from the function's unless given."""

    def add(target):
        own = name or snake_case(target.__name__)
        if own in TASKS:
            raise ValueError(f"task {own!r} is registered already")
        if spec.get("stage", "any") not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}")
        if spec.get("depth", "standard") not in DEPTHS:
            raise ValueError(f"depth must be one of {tuple(DEPTHS)}")
        fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}
        run = (lambda context: target().run(context)) if isinstance(target, type) else target
        fixed.setdefault("display_name", own.replace("_", " ").capitalize())
        fixed.setdefault("description", (target.__doc__ or "").strip().split("\n")[0])
        TASKS[own] = TaskSpec(own, run, **fixed)
        return target

    return add


def load_builtin() -> None:
    importlib.import_module("columnaut.control.tasks")


def list_tasks(by: str | None = None) -> list[str] | dict[str, list[str]]:
    """All names, or names by a field such as stage, depth or domain (by each tag, for tags)."""
    load_builtin()
    if by is None:
        return sorted(TASKS)
    out: dict[str, list[str]] = {}
    for t in sorted(TASKS.values(), key=lambda t: t.name):
        value = getattr(t, by)
        for v in value if isinstance(value, tuple) else (value,):
            out.setdefault(str(v), []).append(t.name)
    return out


def describe_task(name: str) -> dict[str, Any]:
    load_builtin()
    return TASKS[name].as_dict()


def filter_tasks(criteria: Mapping[str, Any], tasks: Iterable[TaskSpec] | None = None) -> list[TaskSpec]:
    """Tasks that meet every criterion: a field equals the value, or is among several; a field that holds several must hold one of them. None never matches."""
    if tasks is None:
        load_builtin()
        tasks = TASKS.values()

    def fits(t: TaskSpec, key: str, want: Any) -> bool:
        have = getattr(t, key, None)
        if have is None:
            return False
        wanted = set(want) if isinstance(want, (list, tuple, set)) else {want}
        return bool(wanted & set(have)) if isinstance(have, tuple) else have in wanted

    return [t for t in tasks if all(fits(t, k, v) for k, v in criteria.items())]


def load_task_group(group: str) -> list[str]:
    """Load plugins and return the names of the tasks that they added: 'core' (the built-in tasks), a folder (every *.py in it whose name doesn't begin with _), a file, or a module.
    Files that register nothing are noted in PLUGIN_WARNINGS."""
    load_builtin()
    if group == "core":
        return sorted(t.name for t in TASKS.values() if t.domain == "core")
    before = set(TASKS)
    path = Path(group)
    files = sorted(p for p in path.glob("*.py") if not p.name.startswith("_")) if path.is_dir() else [path] if path.suffix == ".py" and path.exists() else None
    if files is None:
        module = importlib.import_module(group)
        if hasattr(module, "__path__"):
            for m in pkgutil.iter_modules(module.__path__, group + "."):
                importlib.import_module(m.name)
    else:
        for p in files:
            had = set(TASKS)
            spec = importlib.util.spec_from_file_location(f"columnaut_plugin_{p.stem}", p)
            try:
                spec.loader.exec_module(importlib.util.module_from_spec(spec))
            except Exception as e:  # a plugin's fault must not end the run
                PLUGIN_WARNINGS.append({"plugin": str(p), "warning": f"{type(e).__name__}: {e}"})
                continue
            if set(TASKS) == had:
                PLUGIN_WARNINGS.append({"plugin": str(p), "warning": "registered no task"})
    return sorted(set(TASKS) - before)


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per built-in task."""
    load_builtin()
    rows = [(t.name, t.depth, t.stage, t.domain, t.runtime, ",".join(t.depends_on), ",".join(t.tags), t.description) for t in sorted(TASKS.values(), key=lambda t: t.name) if t.domain == "core"]
    return spark.createDataFrame(rows, "name string, depth string, stage string, domain string, runtime string, depends_on string, tags string, description string")


def write_catalogue(path: str) -> None:
    """All registered tasks as JSON."""
    load_builtin()
    Path(path).write_text(json.dumps({n: t.as_dict() for n, t in sorted(TASKS.items())}, indent=2))
