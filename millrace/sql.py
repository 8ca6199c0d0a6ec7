"""SQL text with two clauses that Spark lacks on plain tables: QUALIFY and MERGE.

``sql`` rewrites QUALIFY into a derived table and hands the text to Spark;
``merge_sql`` turns a MERGE statement into one full outer join.  ``run_blocks``
runs a file of annotated blocks, of which some are expected to fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.merge import AmbiguousMergeError

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|\s+|.""", re.DOTALL)
_FLAG = "__qualify"


@dataclass(frozen=True)
class _Word:
    text: str
    at: int
    depth: int


def _words(text: str) -> list[_Word]:
    """Tokens without white space and comments, with their depth of brackets."""
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace() or t.startswith(("--", "/*")):
            continue
        if t == ")":
            depth -= 1
        out.append(_Word(t, m.start(), depth))
        if t == "(":
            depth += 1
    return out


def _inner(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the outermost bracketed subqueries."""
    words = _words(text)
    for k, w in enumerate(words[:-1]):
        if w.text == "(" and w.depth == 0 and words[k + 1].text.upper() in ("SELECT", "WITH"):
            end = next(x.at for x in words[k + 1 :] if x.text == ")" and x.depth == 0)
            yield w.at + 1, end


def rewrite_qualify(text: str) -> str:
    """The same query without QUALIFY; set operations and subqueries are rewritten part by part."""
    if not any(w.text.upper() == "QUALIFY" for w in _words(text)):
        return text
    for start, end in reversed(list(_inner(text))):
        text = text[:start] + rewrite_qualify(text[start:end]) + text[end:]
    top = [w for w in _words(text) if w.depth == 0]
    for w in top:
        if w.text.upper() in ("UNION", "INTERSECT", "EXCEPT") and not text[:w.at].rstrip().endswith("*"):
            k = w.at + len(w.text)
            tail = re.match(r"\s+(ALL|DISTINCT)\b", text[k:], re.IGNORECASE)
            k += tail.end() if tail else 0
            return f"{rewrite_qualify(text[: w.at])} {text[w.at : k]} {rewrite_qualify(text[k:])}"
    at = lambda *names: next((w.at for w in top if w.text.upper() in names), None)
    qualify = at("QUALIFY")
    if qualify is None:
        return text
    select = max(w.at for w in top if w.text.upper() == "SELECT" and w.at < qualify)
    start = next(w.at for w in top if w.text.upper() == "FROM" and w.at > select)
    named = next((w.at for w in top if w.text.upper() == "WINDOW" and w.at > select), None)
    end = next((w.at for w in top if w.text.upper() in ("ORDER", "LIMIT") and w.at > qualify), len(text.rstrip().rstrip(";")))
    condition_end = named if named is not None and named > qualify else end
    condition = text[qualify + len("QUALIFY") : condition_end]
    body = text[start:qualify] + (text[named:end] if named is not None and named > qualify else "")
    columns = text[select + len("SELECT") : start].strip()
    if columns.upper().startswith("DISTINCT"):
        raise ValueError("QUALIFY with SELECT DISTINCT is not supported")
    return f"{text[:select]}SELECT * EXCEPT ({_FLAG}) FROM (SELECT {columns}\n, ({condition.strip()}\n) AS {_FLAG} {body.strip()}\n) WHERE {_FLAG} {text[end:]}"


def sql(spark: SparkSession, text: str) -> DataFrame:
    """``spark.sql`` that also knows QUALIFY."""
    return spark.sql(rewrite_qualify(text.strip().rstrip(";")))


def set_variable(spark: SparkSession, name: str, value: str) -> None:
    """A session variable from an SQL expression, replaced if it is there."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = {value}")


@dataclass(frozen=True)
class Clause:
    """One WHEN of a MERGE: kind ``matched``, ``insert`` or ``source`` (not matched by source)."""

    kind: str
    condition: str | None
    action: str
    values: dict[str, str] | None  # None: all columns by name


@dataclass(frozen=True)
class Merge:
    target: str
    target_alias: str
    source: str
    source_alias: str
    on: str
    clauses: list[Clause]


def _parts(text: str, separator: str = ",") -> list[str]:
    cuts = [w.at for w in _words(text) if w.depth == 0 and w.text == separator]
    return [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]


def _assignments(text: str) -> dict[str, str] | None:
    if text.strip() == "*":
        return None
    pairs = [_parts(p, "=") for p in _parts(text)]
    return {p[0].split(".")[-1].strip("`\" "): "=".join(p[1:]) for p in pairs}


def parse_merge(text: str) -> Merge:
    """A MERGE statement as its parts."""
    text = text.strip().rstrip(";")
    words = [w for w in _words(text) if w.depth == 0]
    upper = [w.text.upper() for w in words]
    if upper[:2] != ["MERGE", "INTO"]:
        raise ValueError("not a MERGE statement")
    using, on = upper.index("USING"), upper.index("ON")
    whens = [i for i, u in enumerate(upper) if u == "WHEN" and upper[i + 1] in ("MATCHED", "NOT")]

    def named(piece: str) -> tuple[str, str]:
        m = re.fullmatch(r"(\(.*\)|[\w.`]+)(?:\s+(?:AS\s+)?([\w`]+))?", piece.strip(), re.DOTALL | re.IGNORECASE)
        if not m:
            raise ValueError(f"cannot read {piece!r}")
        return m[1], (m[2] or m[1].split(".")[-1]).strip("`")

    target, target_alias = named(text[words[2].at : words[using].at])
    source, source_alias = named(text[words[using].at + 5 : words[on].at])
    condition = text[words[on].at + 2 : words[whens[0]].at]
    clauses = []
    for a, b in zip(whens, [*whens[1:], None], strict=True):
        piece = text[words[a].at : words[b].at if b is not None else len(text)]
        m = re.match(r"WHEN\s+(NOT\s+)?MATCHED(\s+BY\s+(?:SOURCE|TARGET))?(?:\s+AND\s+(.*?))?\s+THEN\s+(.*)$", piece, re.DOTALL | re.IGNORECASE)
        if not m:
            raise ValueError(f"cannot read {piece!r}")
        kind = "matched" if not m[1] else "source" if m[2] and m[2].upper().endswith("SOURCE") else "insert"
        action, rest = re.match(r"(\w+)\s*(.*)$", m[4].strip(), re.DOTALL).groups()
        values: dict[str, str] | None = {}
        if action.upper() == "UPDATE":
            values = _assignments(re.sub(r"^SET\s+", "", rest, flags=re.IGNORECASE))
        elif action.upper() == "INSERT":
            found = re.fullmatch(r"\((.*?)\)\s*VALUES\s*\((.*)\)", rest.strip(), re.DOTALL | re.IGNORECASE)
            values = None if rest.strip() == "*" else dict(zip((c.split(".")[-1].strip("`\" ") for c in _parts(found[1])), _parts(found[2]), strict=True))
        clauses.append(Clause(kind, m[3], action.upper(), values))
    return Merge(target, target_alias, source, source_alias, condition.strip(), clauses)


def merge_sql(spark: SparkSession, statement: str, target: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """Rows of the target after a MERGE statement; names are looked up as views unless given.

    The first WHEN of a row's kind whose condition holds decides.  Several source
    rows that would change one target row raise AmbiguousMergeError.
    """
    m = parse_merge(statement)
    target = spark.sql(f"SELECT * FROM {m.target}") if target is None else target
    source = sql(spark, f"SELECT * FROM {m.source}") if source is None else source
    t = target.withColumns({"__t": F.lit(True), "__row": F.monotonically_increasing_id()}).alias(m.target_alias)
    s = source.withColumn("__s", F.lit(True)).alias(m.source_alias)
    both = t.join(s, F.expr(m.on), "full_outer")
    in_t, in_s = F.coalesce(F.col(f"{m.target_alias}.__t"), F.lit(False)), F.coalesce(F.col(f"{m.source_alias}.__s"), F.lit(False))
    state = {"matched": in_t & in_s, "insert": in_s & ~in_t, "source": in_t & ~in_s}
    rule = F.lit(-1)
    for k in reversed(range(len(m.clauses))):
        c = m.clauses[k]
        holds = state[c.kind] & F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else state[c.kind]
        rule = F.when(holds, k).otherwise(rule)

    def value(name: str):
        old = F.when(in_t, F.col(f"{m.target_alias}.`{name}`"))
        for k, c in enumerate(m.clauses):
            if c.action == "DELETE":
                continue
            if c.values is None:
                new = F.col(f"{m.source_alias}.`{name}`") if name in source.columns else (F.col(f"{m.target_alias}.`{name}`") if c.action == "UPDATE" else F.lit(None))
            elif name in c.values:
                new = F.expr(c.values[name])
            else:
                new = F.col(f"{m.target_alias}.`{name}`") if c.action == "UPDATE" else F.lit(None)
            old = F.when(rule == k, new).otherwise(old)
        return old.cast(target.schema[name].dataType).alias(name)

    deleting = [k for k, c in enumerate(m.clauses) if c.action == "DELETE"]
    keep = ~rule.isin(deleting) if deleting else F.lit(True)
    keep = keep & (in_t | (rule >= 0))
    out = both.select(*(value(c) for c in target.columns), F.col(f"{m.target_alias}.__row").alias("__row"), rule.alias("__rule"), keep.alias("__keep"), state["matched"].alias("__matched"))
    changed = out.where("__matched AND __rule >= 0").groupBy("__row").count().where("count > 1")
    if not changed.isEmpty():
        raise AmbiguousMergeError(f"{changed.count()} target rows have several source rows")
    # A target row that several source rows match, none or one of which changes it, stays one row.
    once = out.where("__keep").withColumn("__r", F.row_number().over(_one_row()))
    return once.where("__row IS NULL OR __r = 1").select(*target.columns)


def _one_row():
    from pyspark.sql import Window

    # Inserts have no row number of the target; they are dealt by a hash so that none is a group.
    key = F.coalesce(F.col("__row"), -1 - F.pmod(F.monotonically_increasing_id(), F.lit(2**40)))
    return Window.partitionBy(key).orderBy(F.col("__rule").desc())


@dataclass(frozen=True)
class Block:
    label: str
    note: str | None
    expect_error: bool
    text: str


def blocks(text: str) -> list[Block]:
    """Blocks that begin with ``-- @label:``; ``-- @note:`` and ``-- @expect_error`` may follow."""
    out = []
    for part in re.split(r"(?m)^(?=--\s*@label:)", text):
        label = re.search(r"(?m)^--\s*@label:\s*(.*)$", part)
        if label:
            note = re.search(r"(?m)^--\s*@note:\s*(.*)$", part)
            body = re.sub(r"(?m)^--\s*@.*\n?", "", part).strip()
            out.append(Block(label[1].strip(), note and note[1].strip(), "@expect_error" in part, body))
    return out


def run_blocks(spark: SparkSession, text: str) -> list[tuple[Block, DataFrame | str]]:
    """Each block's DataFrame, or the first line of the error it was expected to raise."""
    out = []
    for block in blocks(text):
        try:
            found: DataFrame | str = sql(spark, block.text)
            found.schema  # noqa: B018  analysis is enough to fail
        except PySparkException as e:
            if not block.expect_error:
                raise
            found = str(e).splitlines()[0]
        else:
            if block.expect_error:
                raise AssertionError(f"{block.label} was expected to fail")
        out.append((block, found))
    return out
