"""Job-status report: status mapping, display rules, and an HTML page."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours of the report, and the labels of the job engine's status codes.
COLOURS = {"ok": "#98FB98", "warn": "#F4FA58", "alert": "#FFA07A", "unknown": "orange"}
LABELS = {
    "Completed": ((1, 2), "ok"),
    "In Progress": ((0,), "ok"),
    "Aborted": ((3, 96, 97), "alert"),
    "Yet to Start": ((9, 11, 21, 99), "ok"),
    "Compile Issue": ((8, 12, 13, 19), "warn"),
}
STATUSES = {code: (label, COLOURS[colour]) for label, (codes, colour) in LABELS.items() for code in codes}
UNKNOWN = ("Unknown", COLOURS["unknown"])
DASH = "—"


def status_code(text: Column) -> Column:
    """The number in ``LABEL (n)``, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\((-?\d+)\)", 1), F.lit("")).try_cast("int")


def labelled(text: Column, label: str) -> Column:
    """The value after ``label =`` or ``label :`` of its first line, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*{label}\s*[=:]\s*([^\r\n]*)", 1)), F.lit(""))


def status(code: Column, statuses: dict[int, tuple[str, str]] = STATUSES) -> tuple[Column, Column]:
    """(label, colour) of a code; unknown codes are orange."""
    label, colour = F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1])
    for c, (a, b) in statuses.items():
        label, colour = F.when(code == c, a).otherwise(label), F.when(code == c, b).otherwise(colour)
    return label, colour


def hour(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "HH:mm"), F.lit("---"))


def job_report(catalogue: DataFrame, found: DataFrame, statuses: dict[int, tuple[str, str]] = STATUSES, only: str | None = None) -> DataFrame:
    """Rows of the report in catalogue order.

    catalogue: job, project, info, ordinal.  found: job, status_text, started,
    ended, landed (a file name with a date, or null).  Jobs without a status get
    the unknown one.  ``only`` names a single job to report on.
    """
    if only:
        catalogue = catalogue.where(F.col("job") == only)
    j = catalogue.join(found, "job", "left")
    label, colour = status(status_code(F.col("status_text")), statuses)
    j = j.withColumns({"label": label, "colour": colour})
    started = F.when(F.col("label").isin("Yet to Start", "Compile Issue"), F.lit("---")).otherwise(hour(F.col("started")))
    ended = F.when(F.col("label").isin("In Progress", "Aborted", "Yet to Start", "Compile Issue"), F.lit("---")).otherwise(hour(F.col("ended")))
    day = F.coalesce(F.nullif(F.regexp_extract("landed", r"(\d{8})", 1), F.lit("")), F.regexp_replace(F.substring(F.col("started").cast("string"), 1, 10), "-", ""))
    return j.select(
        "ordinal", F.replace(F.col("job"), F.lit("_"), F.lit(" ")).alias("job"), "project", "label", "colour",
        started.alias("started_at"), ended.alias("ended_at"), F.coalesce(F.nullif(day, F.lit("")), F.lit("N/A")).alias("processing_date"),
        F.coalesce(F.nullif(F.col("info"), F.lit("")), F.lit(DASH)).alias("note"),
    ).orderBy("ordinal")


def token_report(tokens: DataFrame, found: DataFrame, pending: DataFrame, statuses: dict[int, tuple[str, str]] = STATUSES) -> DataFrame:
    """Token rows: a completed job with files waiting is yet to run; the colour stays.

    tokens: job, project, token, info, ordinal.  pending: token, pending.
    """
    j = tokens.join(found.select("job", "status_text"), "job", "left").join(pending, "token", "left")
    label, colour = status(status_code(F.col("status_text")), statuses)
    n = F.coalesce("pending", F.lit(0))
    shown = F.when((F.col("label") == "Completed") & (n > 0), "Yet to Run").when((F.col("label") == "Completed") & (n == 0), "Completed - no pending batches").otherwise(F.col("label"))
    j = j.withColumns({"label": label, "colour": colour})
    return j.select("ordinal", F.replace(F.col("job"), F.lit("_"), F.lit(" ")).alias("job"), "project", shown.alias("label"), "colour", n.cast("long").alias("pending"), F.coalesce(F.nullif(F.col("info"), F.lit("")), F.lit(DASH)).alias("note")).orderBy("ordinal")


def grid(df: DataFrame, n: int = 100) -> str:
    """The first ``n`` rows as aligned text; numbers stand to the right, and a line says if there are more."""
    rows = df.limit(n + 1).collect()
    right = [t.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")) for _, t in df.dtypes]
    cells = [df.columns, *(["" if v is None else str(v) for v in r] for r in rows[:n])]
    widths = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.rjust(w) if at_right else v.ljust(w) for v, w, at_right in zip(c, widths, right, strict=True)).rstrip() for c in cells]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join(lines + ["..."] * (len(rows) > n))


def html_page(title: str, tables: dict[str, DataFrame], legend: dict[str, str] | None = None, send: Callable[[str], None] | None = None) -> str:
    """A page with one table a report; the rows are those of a catalogue, so few.  ``send`` is a hook for mail."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        columns = [c for c in df.columns if c not in ("ordinal", "colour")]
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>")
        for row in df.toLocalIterator():
            style = f' style="background:{html.escape(row["colour"])}"' if "colour" in df.columns else ""
            parts.append("<tr>" + "".join(f"<td{style if c == 'label' else ''}>{html.escape(str(row[c]))}</td>" for c in columns) + "</tr>")
        parts.append("</table>")
    if legend:
        parts.append("<p>" + " ".join(f'<span style="background:{html.escape(c)}">{html.escape(k)}</span>' for k, c in legend.items()) + "</p>")
    page = "<html><body>" + "".join(parts) + "</body></html>"
    if send:
        send(page)
    return page
