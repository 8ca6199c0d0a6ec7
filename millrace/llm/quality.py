"""Quality rules as a short-circuit cascade, in DataFrame operations.

A rule is a condition on columns that are worked out from the text.  A sample
tells what share of documents each rule rejects, and what its columns cost: the
characters, words or windows it walks over there, times the cost of each.  Rules
run in order of rejections per cost, and a CASE expression stops at the first that
rejects, so that dear columns are only worked out for what the cheap rules keep.
The order changes the cost and which rule is named, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents of the sample that costs and selectivities are estimated on.
SAMPLE_DOCS = 2000
#: Relative cost of a unit of work: one character looked at, one word split off, one window hashed.
UNIT_COST = {"chars": 1.0, "words": 12.0, "lines": 40.0, "windows": 30.0}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``when`` (of the measures by name) holds; ``work`` names the units that it walks over."""

    name: str
    when: Callable[[dict[str, Column]], Column]
    work: tuple[str, ...] = field(default=())


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW))))

    def covered(at: Column) -> Column:
        # Repeated windows may overlap: each covers the words up to the next one's start.
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        other = lambda k: F.get(s, k)["w"]
        same = lambda x, k: F.coalesce(x["w"] == other(k - 1), F.lit(False)) | F.coalesce(x["w"] == other(k + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    # Equal windows have equal hashes; only texts with equal hashes compare the windows themselves.
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))
    exact = let(windows, lambda s: let(places(s), covered))
    again = F.when(n > WINDOW, F.size(F.array_distinct(hashes)) < n - (WINDOW - 1)).otherwise(False)
    return F.when(again, exact).otherwise(0)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _measures() -> dict[str, Column]:
    """Each measure as one expression over _text, _words and _lines."""
    words, lines, text = F.col("_words"), F.col("_lines"), F.col("_text")
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.octet_length(text) - F.octet_length(_without(text, SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(words),
        "n_stutter": F.size(F.filter(words, lambda w, k: F.coalesce(w == F.get(words, k - 1), F.lit(False)))),
    }
    return {k: v.cast("long") for k, v in found.items()}


def _cut(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    rest = [c for c in docs.columns if c not in (*MEASURES, "rejected_by", "_text", "_words", "_lines")]
    d = docs.select(*rest, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return d.select("*", words_of(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(WS))) > 0).alias("_lines")), rest


def measured(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter of every whole text.

    Null text has no words.  Columns of those names are replaced.
    """
    d, rest = _cut(docs)
    return d.select(*rest, *(v.alias(k) for k, v in _measures().items()))


def base_failed(m: dict[str, Column] | None = None) -> Column:
    m = m or {k: F.col(k) for k in MEASURES}
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rules() -> list[Rule]:
    """The standing rules."""
    return [
        Rule("few_words", lambda m: m["n_words"] < MIN_WORDS, ("words",)),
        Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"], ("words", "windows")),
        Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"], ("chars", "lines")),
        Rule("stutter", lambda m: 100 * m["n_stutter"] > 30 * m["n_words"], ("words",)),
        Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], ("chars", "words")),
        Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"], ("chars", "words")),
        Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"], ("chars", "words")),
    ]


def order_rules(docs: DataFrame, given: list[Rule], sample_docs: int = SAMPLE_DOCS, seed: int = 17) -> list[Rule]:
    """Rules by rejection per cost, both estimated on a sample of about ``sample_docs`` documents.

    Ties go by name.  A table without rows keeps the order given.
    """
    total = docs.count()
    if not total:
        return list(given)
    part = docs.select("text")
    if total > sample_docs:
        # By a hash of whole rows, so that partitioning changes nothing and copies do not come or stay away together.
        plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        part = docs.where(F.pmod(F.xxhash64(*plain, F.lit(seed)), F.lit(1 << 40)) < (sample_docs << 40) // total).select("text")
    work = {"chars": F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), "words": F.col("n_words"), "lines": F.col("n_lines"), "windows": F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0))}
    row = measured(part).agg(
        F.count("*").alias("n"),
        *(F.sum(v).alias(f"work_{k}") for k, v in work.items()),
        *(F.count(F.when(r.when({k: F.col(k) for k in MEASURES}), 1)).alias(f"rule_{i}") for i, r in enumerate(given)),
    ).first()
    if not row["n"]:
        return list(given)
    cost = {r.name: sum(UNIT_COST[w] * (row[f"work_{w}"] or 0) for w in r.work) / row["n"] + 1 for r in given}
    gain = {r.name: row[f"rule_{i}"] / row["n"] / cost[r.name] for i, r in enumerate(given)}
    return sorted(given, key=lambda r: (-gain[r.name], r.name))


def verdicts(docs: DataFrame, given: list[Rule] | None = None, sample_docs: int = SAMPLE_DOCS, with_measures: bool | tuple[str, ...] = False) -> DataFrame:
    """Add rejected_by: the first rule of the cascade that rejects, null for kept.

    Dear measures are only worked out for documents that no rule before rejects;
    ``with_measures`` adds those named, or all, for every document.  Null text has
    no words, so ``few_words`` rejects it.  An empty table gives an empty result;
    repeated rows get equal verdicts; columns of those names are replaced.
    """
    ordered = order_rules(docs, rules() if given is None else given, sample_docs)
    wanted = (MEASURES if with_measures else ()) if isinstance(with_measures, bool) else with_measures
    d, rest = _cut(docs)
    m = _measures()
    if wanted:
        d = d.select("*", *(m[k].alias(k) for k in wanted))
        m |= {k: F.col(k) for k in wanted}
    cascade = F.lit(None).cast("string")
    for rule in reversed(ordered):
        cascade = F.when(rule.when(m), rule.name).otherwise(cascade)
    # A row number keeps the optimiser from copying the expressions into filters on the verdict.
    return d.select(*rest, *wanted, F.when(F.monotonically_increasing_id() >= 0, cascade).alias("rejected_by"))
