"""What a task gives back, and how it is checked and written."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from typing import Any

STATUSES = ("success", "failed", "skipped")


@dataclass
class TaskResult:
    """name, status, a one-line summary, the frame with the rows (a plan, not yet run), figures that rules and scores read, and what was added on the way."""

    name: str
    status: str = "success"
    summary: str = ""
    frame: Any = None
    figures: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    score: float | None = None
    recommendations: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    warnings: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)
    error: dict[str, str] | None = None

    def warn(self, level: str, code: str, description: str, advice: str = "") -> None:
        """Add a reliability warning, by level and code."""
        self.warnings.setdefault(level, {})[code] = {"description": description, "recommendation": advice}

    def signal(self, score: float, tags: list[str], advice: str | None = None) -> None:
        """Set how much the finding matters for a model, from 0 to 1."""
        self.score, self.tags = score, list(tags)
        if advice:
            self.recommendations.append(advice)

    def problems(self) -> list[str]:
        """What is wrong with this result, if anything."""
        out = []
        if not self.name:
            out.append("no name")
        if self.status not in STATUSES:
            out.append(f"status {self.status!r}")
        if not all(isinstance(r, str) for r in self.recommendations):
            out.append("recommendations must be strings")
        if self.score is not None and not (isinstance(self.score, (int, float)) and 0 <= self.score <= 1):
            out.append(f"score {self.score!r}")
        return out

    def to_dict(self, rows: int = 1000) -> dict[str, Any]:
        """For JSON; at most `rows` rows of the frame, and whether there are more."""
        data: dict[str, Any] = {}
        if self.frame is not None and self.status == "success":
            got = self.frame.limit(rows + 1).collect()
            data = {"columns": self.frame.columns, "rows": [list(r) for r in got[:rows]], "more": len(got) > rows}
        return plain(
            {
                "name": self.name, "status": self.status, "summary": self.summary, "data": data, "figures": self.figures, "metadata": self.metadata,
                "ml_impact_score": self.score, "recommendations": self.recommendations, "reliability_warnings": self.warnings, "error": self.error,
            }
        )


def plain(x: Any) -> Any:
    """x made of what JSON knows: times become ISO strings, NaN and infinities strings, other objects their text."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [plain(v) for v in x]
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "item"):
        return plain(x.item())
    return str(x)
