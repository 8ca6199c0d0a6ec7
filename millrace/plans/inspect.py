"""Physical plans as lists of nodes, read from the plan objects rather than their text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    name: str
    depth: int
    text: str


def nodes(df: DataFrame) -> list[Node]:
    """Nodes of the executed plan in tree order, with what adaptive execution wraps opened up."""
    out: list[Node] = []

    def walk(plan, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan(), depth)
        if kind not in ("WholeStageCodegenExec", "InputAdapter", "AQEShuffleReadExec"):
            out.append(Node(kind.removesuffix("Exec"), depth, clean(plan.simpleString(100))))
            depth += 1
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i), depth)
        return None

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return out


def clean(text: str) -> str:
    """Plan text without ids that change from run to run."""
    return re.sub(r"#\d+L?|, \[plan_id=\d+\]|isFinalPlan=\w+", "", text).strip()


def shuffles(df: DataFrame) -> int:
    """Shuffle exchanges; broadcasts are not counted."""
    return sum(n.name == "ShuffleExchange" for n in nodes(df))


def broadcasts(df: DataFrame) -> int:
    return sum(n.name == "BroadcastExchange" for n in nodes(df))


def is_wide(df: DataFrame) -> bool:
    return shuffles(df) > 0


def joins_and_exchanges(df: DataFrame) -> list[str]:
    return [n.name for n in nodes(df) if "Join" in n.name or "Exchange" in n.name]


def classify(cases: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """(operation, narrow or wide, shuffles) of each DataFrame."""
    return [(k, "wide" if is_wide(d) else "narrow", shuffles(d)) for k, d in cases.items()]


def _bracketed(text: str, label: str) -> str:
    """What stands in the balanced brackets after ``label: [``."""
    at = text.find(label + ": [")
    if at < 0:
        return ""
    start = at + len(label) + 3
    depth = 1
    for i in range(start, len(text)):
        depth += {"[": 1, "]": -1}.get(text[i], 0)
        if not depth:
            return text[start:i]
    return text[start:]


def scan_filters(df: DataFrame) -> dict[str, str]:
    """PartitionFilters, DataFilters, PushedFilters and ReadSchema of the file scans."""
    text = " ".join(clean(n.text) for n in nodes(df) if n.name == "FileSourceScan")
    out = {k: _bracketed(text, k) for k in ("PartitionFilters", "DataFilters", "PushedFilters")}
    found = re.search(r"ReadSchema: (struct<.*>)", text)
    return out | {"ReadSchema": found[1] if found else ""}


def wrapped_columns(predicate: str, clustered: list[str]) -> list[str]:
    """Clustered columns that a predicate text only uses inside a function call or cast, which defeats min/max skipping."""
    bare = re.sub(r"\b\w+\s*\([^()]*\)", "", predicate)
    return [c for c in clustered if re.search(rf"\b{re.escape(c)}\b", predicate) and not re.search(rf"\b{re.escape(c)}\b", bare)]
