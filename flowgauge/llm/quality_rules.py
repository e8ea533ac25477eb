"""Line-first cleaning: judge every line, drop the failing ones, then judge the document by what is left.

Everything is built-in column expressions over one row at a time, so the only work is a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_MARKS_PERCENT = 10
MIN_KEPT_PERCENT = 50
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    r"(?i)\b(cookie policy|uses cookies|accept cookies|privacy policy|terms of (use|service)|all rights reserved"
    r"|enable javascript|javascript is (disabled|required)|lorem ipsum|subscribe to our|sign (in|up) to|log in to"
    r"|skip to (main )?content|back to top|click here to|share (this|on) )"
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule.

    Punctuation: more than a tenth of its non-space characters are marks of ``#*$%&<>!``.
    Navigation: at least two bars, one for every four words or more.
    Boilerplate: a notice phrase in a line of at most thirty words.
    """
    chars = _length_without(line, SPACE + "+")
    marks = F.length(line) - _length_without(line, r"[#*$%&<>!]+")
    bars = F.length(line) - _length_without(line, r"[|]+")
    n_words = F.size(words_of(line))
    return (
        (marks * 100 > chars * MAX_MARKS_PERCENT)
        | ((bars >= 2) & (bars * 4 >= n_words))
        | (line.rlike(BOILERPLATE) & (n_words <= BOILERPLATE_WORDS))
    )


def _covered_words(windows: Column) -> Column:
    """Words under windows whose hash occurs twice or more; ``windows`` holds one hash per start."""

    def spread(ordered: Column) -> Column:
        repeated = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda at: F.coalesce(F.get(ordered, at - 1)["hash"] == ordered[at]["hash"], F.lit(False))
            | F.coalesce(F.get(ordered, at + 1)["hash"] == ordered[at]["hash"], F.lit(False)),
        )
        return _let(
            F.sort_array(F.transform(repeated, lambda at: ordered[at]["start"])),
            lambda starts: F.aggregate(
                F.sequence(F.lit(0), F.size(starts) - 1),
                F.lit(0).cast("long"),
                lambda total, at: total
                + F.coalesce(F.least(F.lit(WINDOW), F.get(starts, at + 1) - starts[at]), F.lit(WINDOW)).cast("long"),
            ),
        )

    paired = F.transform(windows, lambda value, at: F.struct(value.alias("hash"), at.alias("start")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        _let(F.sort_array(paired), spread)
    )


def _word_measures(words: Column) -> Column:
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda start: F.xxhash64(F.slice(words, start, WINDOW))
    )
    repeated = F.when(F.size(words) > WINDOW, _let(windows, _covered_words)).otherwise(F.lit(0).cast("long"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        repeated.alias("n_repeat_words"),
    )


def _line_measures(text: Column) -> Column:
    lines = F.split(text, "\n", -1)

    def measured(all_lines: Column) -> Column:
        worded = F.filter(all_lines, lambda line: line.rlike(WORD))
        good = F.filter(all_lines, lambda line: ~(line.rlike(WORD) & line_fails(line)))
        return _let(
            F.struct(worded.alias("worded"), good.alias("good")),
            lambda part: F.struct(
                (F.size(part["worded"]) - F.size(F.array_distinct(part["worded"]))).cast("long").alias("n_dup_lines"),
                (F.size(all_lines) - F.size(part["good"])).cast("long").alias("n_removed_lines"),
                F.array_join(part["good"], "\n").alias("clean_text"),
            ),
        )

    return _let(lines, measured)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds measures, the cleaned text and the verdict to every row; no row is dropped.

    Columns added: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, clean_text,
    clean_chars, base_failed, kept``. Columns of the input with one of these names are replaced. A document is kept if
    it passes the base rules (at least 20 words, at most 30 % of them in repeated windows of eight words) and the lines
    that pass ``line_fails`` hold at least half of its non-space characters. A null or empty text has no words and
    fails; repeated rows are judged alike; an empty table gives an empty table. Windows are compared by a 64-bit hash
    within one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    symbols = body
    for symbol in SYMBOLS:
        symbols = F.replace(symbols, F.lit(symbol), F.lit(""))
    out = docs.withColumns(
        {
            "_words": _let(words_of(body), _word_measures),
            "_lines": _line_measures(body),
            "n_symbols": (F.octet_length(body) - F.octet_length(symbols)).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.col("_words.n_words"),
            "word_chars": F.col("_words.word_chars"),
            "n_dup_lines": F.col("_lines.n_dup_lines"),
            "n_repeat_words": F.col("_words.n_repeat_words"),
            "n_removed_lines": F.col("_lines.n_removed_lines"),
            "clean_text": F.col("_lines.clean_text"),
        }
    ).drop("_words", "_lines")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return out.withColumns(
        {"base_failed": base_failed, "clean_chars": _length_without(F.col("clean_text"), SPACE + "+").cast("long")}
    ).withColumn(
        "kept", ~F.col("base_failed") & (F.col("clean_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT)
    )


COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "n_removed_lines", "clean_chars",
)

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS words,
    string_split(text, chr(10)) AS lines FROM d),
m AS (SELECT *, CASE WHEN len(words) > {WINDOW}
        THEN list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: array_to_string(words[i:i + {WINDOW} - 1], ' '))
        ELSE [] END AS windows,
    list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS worded,
    list_filter(lines, lambda x: NOT (regexp_matches(x, '{WORD}') AND (
        100 * length(regexp_replace(x, '[^#*$%&<>!]', '', 'g'))
            > {MAX_MARKS_PERCENT} * length(regexp_replace(x, '{SPACE}+', '', 'g'))
        OR (length(regexp_replace(x, '[^|]', '', 'g')) >= 2
            AND 4 * length(regexp_replace(x, '[^|]', '', 'g'))
                >= len(list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda y: y <> '')))
        OR (regexp_matches(x, '{BOILERPLATE}')
            AND len(list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda y: y <> '')) <= {BOILERPLATE_WORDS})))) AS good
    FROM w),
positions AS (SELECT doc_id, windows[i] AS value, i FROM (SELECT doc_id, windows, unnest(range(1, len(windows) + 1)) AS i FROM m)),
repeated AS (SELECT doc_id, i FROM positions QUALIFY count(*) OVER (PARTITION BY doc_id, value) > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM repeated) GROUP BY doc_id),
out AS (SELECT m.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, (len(lines) - len(good))::BIGINT AS n_removed_lines,
    length(regexp_replace(array_to_string(good, chr(10)), '{SPACE}+', '', 'g'))::BIGINT AS clean_chars
    FROM m LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, clean_chars,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words)
        AND 100 * clean_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM out
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*COLUMNS)
