"""A sample plugin: its task is of the domain `internal`, which runs only if a selection asks for it."""

from columnaut.control.registry import register_task
from columnaut.control.results import TaskResult
from columnaut.operators.summaries import dataset_shape


@register_task(depth="basic", domain="internal", tags=["example"])
def print_shape_debug(context):
    """Shape of the table, for debugging."""
    frame = dataset_shape(context.df)
    row = frame.first()
    return TaskResult("print_shape_debug", summary=f"{row.num_rows} rows, {row.num_columns} columns", frame=frame, figures={"num_rows": row.num_rows})
