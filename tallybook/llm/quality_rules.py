"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule bounds a ratio of two counts of a document. Whole percentages and whole counts are compared, so that the
verdict does not depend on rounding. Words are runs of characters other than space, tab, newline, vertical tab,
form feed and carriage return.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import quoted, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Common function words of the four languages, in lower case.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be are by from this or at an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}


@dataclass(frozen=True)
class Rule:
    """100 * numerator must lie between low and high times the denominator; a bound may be missing."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=250, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
    Rule("variety", "n_distinct_words", "n_varied_words", low=40),
)
# longer texts need no more distinct words than this many words would
VARIED_WORDS = 200


def _bind(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def _windows(items: Column, n: Column, join) -> Column:
    """`join` of each WINDOW neighbours of an array column of n >= WINDOW items."""
    return F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: join(*[F.get(items, i + k) for k in range(WINDOW)])
    )


def _covered(starts: Column) -> Column:
    """Number of positions in the windows that begin at these positions, which ascend."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(starts) - 1),
        F.lit(0),
        lambda total, k: total
        + F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(WINDOW))),
    )


def _repeated_words(words: Column, hashes: Column, n: Column) -> Column:
    """Words within windows that occur twice or more.

    Windows of unlike digests differ, so most texts end at the first test; otherwise the windows
    themselves are sorted, and neighbours compared.
    """
    digests = _windows(hashes, n, F.xxhash64)

    def exact() -> Column:
        sorted_windows = F.array_sort(
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.struct(
                    F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i")
                ),
            )
        )

        def starts(s: Column) -> Column:
            same = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(F.get(s, k)["w"] == F.get(s, k - 1)["w"], F.lit(False))
                | F.coalesce(F.get(s, k)["w"] == F.get(s, k + 1)["w"], F.lit(False)),
            )
            return F.array_sort(F.transform(same, lambda k: F.get(s, k)["i"]))

        positions = _bind(sorted_windows, starts)
        return _bind(positions, lambda p: F.when(F.size(p) == 0, 0).otherwise(_covered(p)))

    doubtful = _bind(digests, lambda d: F.size(F.array_distinct(d)) < F.size(d))
    return F.when((n >= WINDOW) & doubtful, exact()).otherwise(0)


def measure(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns `keep` and the counts that rules may use, as longs."""
    stop_words = sorted(set(sum(STOP_WORDS.values(), [])))
    text = F.col("_text")
    words = (
        docs.select(F.struct(*keep).alias("_row"), whole_text(docs).alias("_text"))
        .withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("_n", F.size("_words"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn(
            "_lines",
            F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0),
        )
    )
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.translate(text, BLANKS, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_words"), F.col("_hashes"), F.col("_n")),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop_words))),
        "n_distinct_words": F.size(F.array_distinct("_words")),
        "n_varied_words": F.least(F.col("_n"), F.lit(VARIED_WORDS)),
    }
    return words.select("_row", *[c.cast("long").alias(name) for name, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measured row breaks, joined by commas."""
    broken = []
    for rule in rules:
        value, base = 100 * F.col(rule.numerator), F.col(rule.denominator)
        tests = [value < rule.low * base] * (rule.low is not None) + [value > rule.high * base] * (rule.high is not None)
        if tests:
            broken.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(rule.name)))
    return F.concat_ws(",", *broken)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of broken rules for every row.

    Null and empty texts have no words, fail the base test and are not kept. Repeated rows and null ids are judged
    like others; a count exactly at a threshold passes. Other columns are not read.
    """
    measured = measure(docs, F.col("doc_id").cast("long").alias("doc_id"))
    verdict = measured.withColumn("base_failed", base_failed()).withColumn("broken", compile_rules(rules))
    return verdict.select(
        "_row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"),
        "broken",
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their columns."""
    # a row number keeps the optimizer from moving the filter below the counts, where it would repeat their expressions
    measured = measure(docs, *[docs[c] for c in quoted(docs.columns)]).withColumn("_number", F.monotonically_increasing_id())
    passes = ~base_failed() & (compile_rules(rules) == "") & (F.col("_number") >= 0)
    return measured.filter(passes).select("_row.*")


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over the table `documents` in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(sum(STOP_WORDS.values(), []))))
    broken = []
    for rule in rules:
        tests = [f"100 * {rule.numerator} < {rule.low} * {rule.denominator}"] * (rule.low is not None)
        tests += [f"100 * {rule.numerator} > {rule.high} * {rule.denominator}"] * (rule.high is not None)
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END")
    return rf"""
    WITH split AS (
      SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda line: length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) > 0) AS lines
      FROM documents
    ), windows AS (
      SELECT row_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
      FROM split, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)
    ), repeated AS (
      SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, w) > 1
    ), covered AS (
      SELECT row_id, sum(least({WINDOW}, gap)) AS n FROM (
        SELECT row_id, coalesce(lead(i) OVER (PARTITION BY row_id ORDER BY i) - i, {WINDOW}) AS gap FROM repeated
      ) GROUP BY row_id
    ), counts AS (
      SELECT doc_id, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines,
             len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
             len(list_distinct(words)) AS n_distinct_words,
             least(len(words), {VARIED_WORDS}) AS n_varied_words
      FROM split LEFT JOIN covered USING (row_id)
    ), verdicts AS (
      SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
             concat_ws(',', {", ".join(broken)}) AS broken
      FROM counts
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND broken = '' AS kept, broken
    FROM verdicts"""
