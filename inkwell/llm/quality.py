"""Quality rules: a threshold table compiled into Spark projections of counts and ratios, without user functions.

measure() adds the counts of a text, RULES turns them into ratios with bounds, verdicts() compiles the table into one
expression for each rule. A rule whose ratio has no denominator (no words, no lines) doesn't fire.

Rows: a null text has no words and fails. Repeated rows are judged alike, each for itself. An empty table gives no
rows. Columns that the input has besides the text are kept by filter_documents() and ignored by the query.
Repeated windows are found by their 64-bit hashes, sorted within the row: n log n for any text, with no cap.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

#: Words of a window, as the base verdict counts repetition.
WINDOW = 8

# Frequent function words of the four languages that the corpus holds.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this are at from or an have not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par au il sur pas plus ne se "
    "el los que y en las un por con una su para es al lo como más o pero sus le ya"
)


class Rule(NamedTuple):
    """A ratio of two counts and its bounds; it is judged for texts of at least `words` words."""

    name: str
    top: str
    bottom: str
    least: float
    most: float
    words: int = 20


#: Thresholds. All are far outside what running prose in any of the languages shows.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0.0, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.005, 1.0, 100),
)


def _stop_words() -> list[str]:
    return list(dict.fromkeys(STOP_WORDS.split()))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts of each text in columns that begin with `q_`, and the input's row as struct `q_in`."""
    has_word = "[^\\x20\\x09-\\x0D]"
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(raw, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(has_word))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_in")
    one = docs.select(row, raw.alias("q_text"), words.alias("q_words"), lines.alias("q_lines"))
    two = one.withColumns(
        {
            "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
            "q_n_words": F.size("q_words").cast("long"),
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_n_symbols": F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_n_bullet_lines": F.size(F.filter("q_lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long"),
            "q_n_ellipsis_lines": F.size(F.filter("q_lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long"),
            "q_n_stop_words": F.regexp_count(
                "q_text", F.lit("(?i)(?<![^\\x20\\x09-\\x0D])(?:" + "|".join(_stop_words()) + ")(?![^\\x20\\x09-\\x0D])")
            ).cast("long"),
        }
    )
    n = F.col("q_n_words").cast("int")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("q_hashes", i + k) for k in range(WINDOW)])
        ),
    )
    three = two.withColumn("q_windows", windows)
    # Few texts repeat a window; only theirs are sorted.
    some = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    pairs = F.when(some, F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    four = three.withColumn("q_sorted", pairs)

    def twin(s: Column, k: Column) -> Column:
        near = [F.get("q_sorted", k - 1)["h"], F.get("q_sorted", k + 1)["h"]]
        return near[0].eqNullSafe(s["h"]) | near[1].eqNullSafe(s["h"])

    starts = F.sort_array(F.transform(F.filter("q_sorted", twin), lambda s: s["i"]))
    five = four.withColumn("q_starts", starts)
    # A start covers a window's words, less those that the next start covers as well.
    covered = F.transform(
        "q_starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("q_starts", k + 1) - s, F.lit(WINDOW)))
    )
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    six = five.withColumn("q_n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long")))
    # The generator keeps later filters above these projections: pushed below, they would repeat all expressions.
    counts = [c for c in six.columns if c.startswith("q_n_") or c == "q_word_chars"]
    return six.select("q_in", F.explode(F.array(F.struct(*counts))).alias("q")).select("q_in", "q.*")


def verdicts(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule, whether a measured text breaks it."""
    out = {}
    for r in rules:
        ratio = F.col(f"q_{r.top}") / F.col(f"q_{r.bottom}").cast("double")
        judged = (F.col("q_n_words") >= r.words) & (F.col(f"q_{r.bottom}") > 0)
        out[r.name] = F.coalesce(F.when(judged, (ratio < r.least) | (ratio > r.most)), F.lit(False))
    return out


def base_failed() -> Column:
    n = F.col("q_n_words")
    return (n < 20) | (100 * F.col("q_n_repeat_words") > 30 * n)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, q_base_failed, q_broken (names of broken rules) and q_kept."""
    broken = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in verdicts(rules).items()]))
    out = measure(docs, text).withColumns({"q_base_failed": base_failed(), "q_broken": broken})
    return out.withColumn("q_kept", ~F.col("q_base_failed") & (F.size("q_broken") == 0))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with the input's columns."""
    return judge(docs, text).where("q_kept").select("q_in.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every text of `documents` with its counts and verdicts; see the module."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select(
        "q_in.doc_id", *[F.col(f"q_{n}").alias(n) for n in names], F.array_join("q_broken", ",").alias("broken_rules")
    )


def _sql() -> str:
    sep = "\\x20\\x09-\\x0D"
    stops = "|".join(_stop_words())
    rules = ", ".join(
        f"CASE WHEN n_words >= {r.words} AND {r.bottom} > 0 AND ({r.top}::DOUBLE / {r.bottom} < {r.least} OR {r.top}::DOUBLE / {r.bottom} > {r.most}) THEN '{r.name}' END"
        for r in RULES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{sep}]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{sep}]')) AS ls FROM d),
s AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS n FROM s),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM
        (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY rid),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^[{sep}]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{sep}]*$'))) AS n_ellipsis_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '^(?i:{stops})$'))) AS n_stop_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS broken_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM b
"""


ORACLE_SQL = _sql()
