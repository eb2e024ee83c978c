"""Quality rules: a table of thresholds compiled into one projection.

Each row of the table bounds one measure of a text: lengths, symbol, stop-word
and line ratios. A text is kept if it passes the base rule and every bound.
Only built-in expressions run, and nothing is shuffled.

Edge cases: a null text has no words; ratios of a text without words or lines
are 0; ties do not arise, as every row is judged alone, rows that repeat a
document too; very long texts are read whole; an empty table gives an empty
result; other columns are ignored, whatever their names. Windows are compared by
64-bit hashes of their five words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import SPACES, let, null_to_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
PUNCTUATION = ".,;:!?()[]\"'" + SYMBOLS

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it for was with as be on by at this from or an are "
    "de la et le les des en un une du que qui dans pour par pas sur au ne se "
    "el los las y a del con no su para es al lo como "
    "der die das und ist den von zu mit sich auf nicht ein eine im dem"
).split()


class Bound(NamedTuple):
    measure: str
    low: float
    high: float


#: The production table. Measures are per word, per line or per letter, or plain counts.
THRESHOLDS = [
    Bound("words", 10, float("inf")),
    Bound("chars_per_word", 2.0, 12.0),
    Bound("symbols_per_word", 0.0, 0.2),
    Bound("exclamations_per_word", 0.0, 0.3),
    Bound("upper_per_char", 0.0, 0.4),
    Bound("stop_words_per_word", 0.02, 1.0),
    Bound("dup_lines_per_line", 0.0, 0.35),
    Bound("alphabetic_words_per_word", 0.6, 1.0),
]


def _repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def covered(pairs: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.sort_array(F.transform(F.filter(pairs, lambda _, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))
        return let(twice, lambda at: F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(WINDOW)))))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, covered))


def measures(text: Column) -> Column:
    """struct of the counts of a text column."""

    def of(w: Column) -> Column:
        windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        bare = F.transform(w, lambda x: F.lower(F.btrim(x, F.lit(PUNCTUATION))))
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(F.translate(x, SPACES, " " * len(SPACES))) != "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " " + SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            let(windows, _repeated).cast("long").alias("n_repeat_words"),
            let(bare, lambda b: F.struct(F.size(F.filter(b, lambda x: x.isin(STOP_WORDS))).alias("stop"), F.size(F.filter(b, lambda x: x.rlike(r"\p{L}"))).alias("alphabetic"))).alias("kinds"),
            (F.length(text) - F.length(F.translate(text, "!", ""))).alias("exclamations"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("upper"),
        )

    return let(words(text), of)


def judge(documents: DataFrame, table: list[Bound] = THRESHOLDS) -> DataFrame:
    """documents(doc_id, text) with the base counts, base_failed, kept, and the measures that failed."""
    rows = documents.select("doc_id", measures(null_to_empty("text")).alias("m"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    value = {
        "words": F.col("m.n_words").cast("double"),
        "chars_per_word": per("m.word_chars", "m.n_words"),
        "symbols_per_word": per("m.n_symbols", "m.n_words"),
        "exclamations_per_word": per("m.exclamations", "m.n_words"),
        "upper_per_char": per("m.upper", "m.word_chars"),
        "stop_words_per_word": per("m.kinds.stop", "m.n_words"),
        "dup_lines_per_line": per("m.lines.dup", "m.lines.all"),
        "alphabetic_words_per_word": per("m.kinds.alphabetic", "m.n_words"),
    }
    failed = F.filter(F.array(*[F.when((value[b.measure] < b.low) | (value[b.measure] > b.high), F.lit(b.measure)) for b in table]), lambda x: x.isNotNull())
    base_failed = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    return rows.select(
        "doc_id",
        "m.n_words",
        "m.word_chars",
        "m.n_symbols",
        F.col("m.lines.dup").alias("n_dup_lines"),
        "m.n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed"),
    )


def _sql_kept() -> str:
    per = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END)"
    value = {
        "words": "n_words",
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "exclamations_per_word": per("exclamations", "n_words"),
        "upper_per_char": per("upper", "word_chars"),
        "stop_words_per_word": per("stop", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "alphabetic_words_per_word": per("alphabetic", "n_words"),
    }
    return " AND ".join(f"{value[b.measure]} >= {b.low}" + (f" AND {value[b.measure]} <= {b.high}" if b.high != float("inf") else "") for b in THRESHOLDS)


#: The same rows from one row a word, a line and a window.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), win AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS tail
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, tail) AS n FROM win WHERE tail IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), kinds AS (
  SELECT doc_id, count(*) FILTER (b IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS stop, count(*) FILTER (regexp_matches(b, '\\pL')) AS alphabetic
  FROM (SELECT doc_id, lower(trim(word, '{PUNCTUATION.replace("'", "''")}')) AS b FROM u) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(stop, 0) AS stop, coalesce(alphabetic, 0) AS alphabetic,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS exclamations, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS upper
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kinds USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_sql_kept()} AS kept
FROM m
"""
