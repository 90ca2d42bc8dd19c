"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A text that fails a base rule is out. The remaining rules are tried one after
another and a text leaves the cascade at its first failure, so a rule costs
only what the rules before it let through. Their order comes from a sample: the
time that each rule takes on copies of it (without the time of reading them)
and the share of the texts left that it rejects; rules that reject most per
second come first. The
order changes the cost alone: a text is kept if no rule rejects it.

Cases: a null text has no words and fails the base rules, as do empty texts; a
text without words is rejected by no further rule; repeated rows are judged one
by one; an empty table keeps the rules' given order; other columns are never
read unless asked for.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which costs and rejections are measured.
SAMPLE_ROWS = 2_000

#: Bytes of text that each cost is measured on, by repeating the sample.
COST_BYTES = 64 << 20

# SQL takes one of the two backslashes, the pattern needs the other
BLANK = "[\\\\x09-\\\\x0D\\\\x20]+"
NOT_BLANK = "[^\\\\x09-\\\\x0D\\\\x20]"
SYMBOLS = "#*$%&|<>"


@dataclass
class Rule:
    """``rejects`` is SQL that is true for a text the rule throws out; it may use the base columns."""

    name: str
    rejects: str


RULES = [
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("exclaiming", "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words"),
    Rule("capitals", r"10 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > 3 * word_chars"),
]

#: Number of words, and of words in 3-word windows that are found more than
#: once: sort the window hashes with their places, keep the places that have an
#: equal neighbour, and add up what each of them covers that the next does not.
#: One-element arrays bind a name, so that nothing is computed twice even where
#: the optimizer moves the whole expression.
_WORDS = f"""
transform(array(array_remove(split(text, '{BLANK}'), '')), words -> struct(
  cast(size(words) AS bigint) AS n_words,
  transform(array(slice(
      transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))),
      1, greatest(0, size(words) - 2))), windows ->
    CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
      transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
        transform(array(sort_array(transform(
            filter(s, (x, j) -> coalesce(x.h = get(s, j - 1).h, false) OR coalesce(x.h = get(s, j + 1).h, false)),
            x -> x.i))), p ->
          aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0L,
            (total, x) -> total + x))[0])[0]
    END)[0] AS n_repeat_words))[0]
"""
_LINES = f"""
transform(array(filter(split(text, '\n'), x -> x RLIKE '{NOT_BLANK}')), lines -> struct(
  cast(size(lines) AS bigint) AS n_lines,
  cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines))[0]
"""


def base_columns(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, text and the base columns of every row."""
    rows = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_words": F.expr(_WORDS), "_lines": F.expr(_LINES)}).select(
        *columns,
        "text",
        "_words.*",
        "_lines.*",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
    )
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.withColumn("base_failed", failed)


def rule_costs(turns: list[list[float]]) -> list[float]:
    """Seconds of each rule from turns of (seconds of reading alone, seconds with each rule).

    The least of a rule's runs is the one that other work disturbed least.
    Rules that take less than the runs of reading differ by cannot be told
    apart from each other, so that difference is the least cost.
    """
    read, *rules = zip(*turns)
    floor = max(max(read) - min(read), 0.001)
    return [max(min(runs) - min(read), floor) for runs in rules]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample, most first.

    Rejections are conditional: a text counts for a rule only if no rule placed
    before it rejects it. A rule's time is the least of warmed runs over as
    many copies of the sample as make ``COST_BYTES``, without that of reading
    them, so that it stands out from the time a job takes to start.
    """
    total = docs.count()
    if not total:
        return list(rules)
    part = max(1, round(1e6 * sample_rows / total))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part).limit(sample_rows)
    sample = base_columns(sample, []).where(~F.col("base_failed")).cache()
    rejects = [F.coalesce(F.expr(rule.rejects), F.lit(False)) for rule in rules]

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        copied.agg(F.count_if(condition)).first()
        return time.perf_counter() - began

    try:
        n_bytes = sample.agg(F.sum(F.octet_length("text"))).first()[0]
        if not n_bytes:
            return list(rules)
        copies = max(1, COST_BYTES // n_bytes)
        copied = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        # in turns, so that a busy machine slows all alike; the first turn warms up
        turns = [[seconds(c) for c in (F.octet_length("text") < 0, *rejects)] for _ in range(4)]
        costs = rule_costs(turns[1:])
        found = sample.groupBy(*[c.alias(f"_rule{i}") for i, c in enumerate(rejects)]).count().collect()
    finally:
        sample.unpersist()
    left = [(row[:-1], row[-1]) for row in found]
    waiting, order = list(range(len(rules))), []
    while waiting:
        best = max(waiting, key=lambda i: ((1 + sum(n for hits, n in left if hits[i])) / costs[i], -i))
        left = [(hits, n) for hits, n in left if not hits[best]]
        waiting.remove(best)
        order.append(rules[best])
    return order


def judge(docs: DataFrame, columns: list[str], rules: list[Rule]) -> DataFrame:
    """``columns``, the base columns and ``kept`` of every row; rules are tried in order."""
    rows = base_columns(docs, columns)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(False))
    return rows.withColumn("kept", verdict.otherwise(F.lit(True))).drop("text")
