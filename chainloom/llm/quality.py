"""Quality rules as a short-circuit cascade of DataFrame expressions.

Every rule is a Boolean column that is true for a text to reject.  A bounded sample tells
each rule's cost (seconds a row) and selectivity (rejected share); rules then stand in the
order of rejection per cost, and a text that one rule rejects is not shown to the next.
The verdict is that of all rules together, so the order decides the work, not the result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chainloom.llm import common

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Rows that costs and selectivities are estimated on.  They set the order of the rules only.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeat_words(words: str) -> str:
    """SQL of the number of words in windows of three that are found twice or more.

    Windows are compared by a 64-bit hash.  Equal ones stand side by side after sorting by
    hash and place, so that the work is that of a sort, however often a window is repeated.
    The places of repeated windows in order then give the words: three for each, less the
    overlap with the one before.  Texts without a repeated window skip all that.
    """
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"
    ranked = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    twice = "filter(s, (x, k) -> x.h = get(s, k + 1).h OR (k > 0 AND x.h = get(s, k - 1).h))"
    gained = "transform(p, (x, k) -> if(k = 0, 3, least(3, x - get(p, k - 1))))"
    total = let(f"array_sort(transform({let(ranked, 's', twice)}, x -> x.i))", "p", f"aggregate({gained}, 0, (a, x) -> a + x)")
    counted = let(hashes, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {total} END")
    return let(words, "w", f"CASE WHEN size(w) < 3 THEN 0 ELSE {counted} END")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with word and line counts of their whole text.

    Words are runs of characters other than ASCII white space.  A null or empty text has
    none and counts of zero.  Columns named like a count are replaced; others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, WHITE), "")
    with_word = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    staged = df.withColumn("_words", words).withColumn("_lines", with_word)
    staged = staged.select(
        *[c for c in df.columns if c.lower() not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(repeat_words("_words")).cast("bigint").alias("n_repeat_words"),
    )
    return staged


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the counts and the text; all in whole numbers."""
    whole, words = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    kept = lambda pattern: F.length(F.regexp_replace(whole, pattern, ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("exclamations", 10 * (F.length(whole) - kept("!")) > words),
        Rule("few_letters", 10 * kept("[^\\p{L}]") < 6 * F.col("word_chars")),
        Rule("capitals", 10 * kept("[^\\p{Lu}]") > 4 * F.col("word_chars")),
    ]


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Measured cost and rejected share of each rule on a small table of counted rows."""

    def run(condition: Column) -> tuple[float, int, int]:
        start = time.perf_counter()
        row = sample.agg(F.count_if(condition).alias("hit"), F.count("*").alias("n")).first()
        return time.perf_counter() - start, row["hit"], row["n"]

    idle = min(run(F.lit(False))[0] for _ in range(2))
    out = []
    for rule in rules:
        seconds, hit, n = run(F.coalesce(rule.rejects, F.lit(False)))
        out.append(Estimate(rule.name, max(seconds - idle, 1e-3) / max(n, 1), hit / max(n, 1)))
    return out


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """By rejection per cost, the cheapest first among equals."""
    by_name = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-by_name[r.name].rejected / by_name[r.name].seconds, by_name[r.name].seconds, r.name))


def passes(rules: list[Rule]) -> Column:
    """True if no rule rejects; each rule is evaluated only where those before it passed."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), False).otherwise(verdict)
    return verdict


def cascade(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows with their counts, ``base_failed`` and ``kept``.

    ``df`` has a text column.  Null and empty texts fail the base rule; equal texts get
    equal verdicts; an empty table stays empty.
    """
    rules = default_rules(text) if rules is None else rules
    counted = with_counts(df, text)
    sample = common.written(with_counts(df.limit(SAMPLE_ROWS), text), "quality-sample")
    order = ordered(rules, estimate(sample, rules))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(passes(order)))


# The same in SQL, over a table ``documents``.
ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents),
wins AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
           OR word_chars < 2 * n_words OR word_chars > 20 * n_words
           OR 10 * (length(text) - length(replace(text, '!', ''))) > n_words
           OR 10 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 6 * word_chars
           OR 10 * length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) > 4 * word_chars) AS kept
FROM v
"""
