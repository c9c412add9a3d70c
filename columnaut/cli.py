"""Command line: python -m columnaut run|profile|quickstart|tasks|version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__


def session() -> SparkSession:
    return SparkSession.builder.appName("columnaut").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="columnaut", description="Profile tables with Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run as a configuration says")
    run.add_argument("--config", required=True)
    run.add_argument("--strict", action="store_true", help="stop if the configuration or the tasks' dependencies are faulty")
    run.add_argument("--visualize-dag", action="store_true", help="print the dependencies as DOT")
    run.add_argument("--no-report", action="store_true", help="write no files")
    one = commands.add_parser("profile", help="profile a file")
    one.add_argument("data")
    one.add_argument("--depth", choices=("basic", "standard", "full"), default="standard")
    one.add_argument("--output")
    quick = commands.add_parser("quickstart", help="profile a data set of a folder, by name")
    quick.add_argument("name")
    quick.add_argument("--folder", required=True)
    commands.add_parser("tasks", help="list all tasks as JSON")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0

    from .control import engine, registry

    if args.command == "tasks":
        registry.load_builtin()
        print(json.dumps({n: t.as_dict() for n, t in sorted(registry.TASKS.items())}, indent=1))
        return 0
    datasets = None
    data = None
    if args.command == "run":
        config = engine.load_config(args.config)
        config["safety"]["strict_mode"] = config["safety"].get("strict_mode") or args.strict
        if args.no_report:
            config["metadata"]["output_dir"] = None
        if args.visualize_dag:
            print(engine.dag_dot(engine.plan_tasks(config)))
    elif args.command == "profile":
        config = engine.load_config({"metadata": {"dataset_path": args.data, "output_dir": args.output}, "engine": {"profiling_depth": args.depth}})
    else:
        from .sources.readers import Datasets

        datasets = Datasets(session(), args.folder)
        data, config = args.name, engine.load_config({"engine": {"profiling_depth": "basic"}})
    results = engine.Engine(session(), data, config, datasets=datasets).run()
    for name, r in results.items():
        print(f"{r.status:8} {name} {r.summary}".rstrip())
    return int(any(r.status == "failed" for r in results.values()))


if __name__ == "__main__":
    sys.exit(main())
