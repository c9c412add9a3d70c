"""In what order, and how wide, a report shows the results of tasks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

#: Rows of (task, width in percent).
DEFAULT: list[list[tuple[str, int]]] = [
    [("summarize_dataset_shape", 50), ("data_quality_scorer", 50)],
    [("infer_types", 100)],
    [("summarize_nulls", 50), ("missingness_matrix", 50)],
    [("summarize_numeric", 100)],
    [("summarize_unique", 50), ("summarize_modes", 50)],
    [("summarize_text_fields", 50), ("categorical_length_stats", 50)],
    [("detect_outliers", 50), ("detect_skewness", 50)],
    [("detect_duplicates", 50), ("detect_constant_columns", 50)],
    [("compute_correlations", 100)],
    [("detect_feature_drift", 50), ("detect_target_drift", 50)],
    [("sample_head", 50), ("sample_tail", 50)],
]


def load_layout(name: str = "default") -> list[list[tuple[str, int]]]:
    """The built-in layout, or one from a JSON file: {"layout": [{"row": [{"id": task, "width": percent}, ...]}, ...]}."""
    if name == "default":
        return DEFAULT
    found: Mapping[str, Any] = json.loads(Path(name).read_text())
    rows = [[(str(x["id"]), int(x.get("width", 100))) for x in r["row"]] for r in found["layout"]]
    for row in rows:
        if sum(w for _, w in row) > 100 or any(w <= 0 for _, w in row):
            raise ValueError(f"widths of a row must be above 0 and at most 100 together: {row}")
    return rows


def arrange(layout: Sequence[Sequence[tuple[str, int]]], tasks: Sequence[str]) -> list[list[dict[str, Any]]]:
    """The rows of a layout with the tasks that were run; tasks that it doesn't name follow, each in a row of its own."""
    there, named = set(tasks), {t for row in layout for t, _ in row}
    rows = [[{"task": t, "width": w} for t, w in row if t in there] for row in layout]
    return [r for r in rows if r] + [[{"task": t, "width": 100}] for t in tasks if t not in named]
