"""Small results as text, LaTeX or JSON, and saved clusterings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(rows: DataFrame, out) -> int:
    """A table as tab-separated lines with a header, row by row without gathering it; how many rows were written."""
    print("\t".join(rows.columns), file=out)
    n = 0
    for n, r in enumerate(rows.toLocalIterator(), 1):
        print("\t".join("" if v is None else str(v) for v in r), file=out)
    return n


def render(summary: DataFrame, form: str = "text", digits: int = 4) -> str:
    """A summary of a few rows as ``text``, ``latex`` or ``json``."""
    rows = [r.asDict() for r in summary.collect()]
    names = summary.columns
    cells = [["" if r[n] is None else f"{r[n]:.{digits}f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]
    if form == "json":
        return json.dumps(rows, default=str, indent=2)
    if form == "latex":
        body = "\n".join(" & ".join(c.replace("_", r"\_") for c in row) + r" \\" for row in [names, *cells])
        return f"\\begin{{tabular}}{{{'l' * len(names)}}}\n{body}\n\\end{{tabular}}"
    if form != "text":
        raise ValueError(f"form is text, latex or json, not {form!r}")
    width = [max(len(r[i]) for r in [names, *cells]) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, width)).rstrip() for row in [names, *cells])


def write_clustering(assignments: DataFrame, path: str, name: str, settings: dict) -> None:
    """Cluster labels with their members as JSON lines under ``path``; one line for each cluster."""
    lines = assignments.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), F.col("cluster_label").alias("clusterlabel"), F.col("instance_id").alias("instance"))).alias("value"))
    lines.write.mode("overwrite").text(path, compression="gzip")
