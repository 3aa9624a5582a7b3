"""Quality rules: a table of thresholds compiled into one projection.

Every measure and every verdict is a column expression; nothing is shuffled
and each document is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import SPACE, SPACES, fresh

#: Frequent function words of the corpus' languages.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or by an not but which a he you were her she their has had will would there been if when who more no out so up",
    "de": "der die das und in zu den ist von im mit des auf ein eine einen einem einer dem nicht als auch es an werden aus er hat dass sie nach wird bei noch wie um am sind oder zum war",
    "es": "el la los las de del que y en un una por con no para es se lo al como su sus o este si porque esta entre cuando muy sin sobre ser tiene",
    "fr": "le la les de des du et en un une pour que qui dans sur pas au aux avec ce par est plus son sa ses ou il elle ne se sont",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are 0 for a document without words or lines.
RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.30),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.50),
    Rule("bullets", "bullet_line_ratio", None, 0.90),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.50),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeated_words(hashes: Column, ordered: Column, places: Column) -> tuple[Column, Column, Column]:
    """Words that lie in 3-word windows found more than once, by sorting.

    Three steps, each from the column that holds the one before: windows by
    hash with their places, places of repeated windows, words these cover.
    """
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    first = F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def twin(x: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    second = F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
    new = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
    third = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0))
    return first, second, third


def with_quality(df: DataFrame, text: str = "text", name: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with a struct column of measures, failed rules and the verdict.

    The struct holds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), the ratios the rules name, base_failed, failed
    (names of failed rules, in table order) and kept. A null or empty text has
    no words, all counts and ratios 0 and base_failed true. Other columns,
    whatever their names, are left as they are; rows are neither lost nor
    merged; an empty table gives an empty table.
    """
    t, w, l, h, o, p, m, r = fresh(df, "_text", "_words", "_lines", "_windows", "_ordered", "_places", "_measures", "_ratios")
    keep = [F.col(f"`{c}`") for c in df.columns]
    c = F.col

    stop = sorted({y for words in STOP_WORDS.values() for x in words.split() for y in (x, x.capitalize(), x.upper())})
    bare = lambda x: F.btrim(x, F.lit(SPACES))
    long = lambda x: x.cast("long")
    lines = F.filter(F.split(c(t), "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE[1:]}")))
    counts = F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(c(w), ""))).alias("word_chars"),
        long(F.regexp_count(c(t), F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size(l)).alias("n_lines"),
        long(F.size(l) - F.size(F.array_distinct(c(l)))).alias("n_dup_lines"),
        long(F.size(F.filter(c(w), lambda x: x.isin(stop)))).alias("n_stop_words"),
        long(F.size(F.filter(c(l), lambda x: F.substring(bare(x), 1, 2).isin("- ", "* ", "• ")))).alias("n_bullets"),
        long(F.size(F.filter(c(l), lambda x: bare(x).endswith("...") | bare(x).endswith("…")))).alias("n_ellipses"),
    )
    # The last two windows hold fewer words: a hash skips nulls, so these equal no other.
    windows = F.transform(c(w), lambda x, i: F.xxhash64(x, F.get(c(w), i + 1), F.get(c(w), i + 2)))
    first, second, third = _repeated_words(c(h), c(o), c(p))
    read = df.select(*keep, F.coalesce(c(f"`{text}`"), F.lit("")).alias(t))
    read = read.select(*keep, t, F.array_remove(F.split(c(t), f"{SPACE}+"), "").alias(w), lines.alias(l))
    read = read.select(*keep, counts.alias(m), windows.alias(h))
    read = read.select(*keep, m, first.alias(o)).select(*keep, m, second.alias(p))
    read = read.select(*keep, F.struct(f"{m}.*", long(third).alias("n_repeat_words")).alias(m))
    x = c(m)
    ratios = F.struct(
        _ratio(x["word_chars"], x["n_words"]).alias("mean_word_chars"),
        _ratio(x["n_symbols"], x["n_words"]).alias("symbols_per_word"),
        _ratio(x["n_stop_words"], x["n_words"]).alias("stop_word_ratio"),
        _ratio(x["n_dup_lines"], x["n_lines"]).alias("dup_line_ratio"),
        _ratio(x["n_bullets"], x["n_lines"]).alias("bullet_line_ratio"),
        _ratio(x["n_ellipses"], x["n_lines"]).alias("ellipsis_line_ratio"),
    )
    read = read.select(*keep, m, ratios.alias(r))

    def broken(rule: Rule) -> Column:
        value = c(r)[rule.measure]
        sides = [value < rule.low] * (rule.low is not None) + [value > rule.high] * (rule.high is not None)
        return reduce(lambda a, b: a | b, sides, F.lit(False))

    base_failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
    failed = F.array_compact(F.array(*[F.when(broken(rule), F.lit(rule.name)) for rule in rules]))
    result = F.struct(f"{m}.*", f"{r}.*", base_failed.alias("base_failed"), failed.alias("failed"), (~base_failed & (F.size(failed) == 0)).alias("kept"))
    return read.select(*keep, result.alias(name))


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df whose text passes; columns as they were, whatever their names.

    A null or empty text fails. Each row is judged by itself, so repeated rows
    and null ids fare alike; an empty table gives an empty table.
    """
    name, verdict = fresh(df, "_quality", "_verdict")
    keep = [F.col(f"`{c}`") for c in df.columns]
    # A filter is pushed below projections and would take all measures into its condition; it isn't pushed below explode.
    judged = with_quality(df, text, name, rules).select(*keep, F.explode(F.array(F.col(f"{name}.kept"))).alias(verdict))
    return judged.filter(F.col(verdict)).select(*keep)


def _sql_check(rule: Rule) -> str:
    sides = [f"{rule.measure} >= {rule.low}"] * (rule.low is not None) + [f"{rule.measure} <= {rule.high}"] * (rule.high is not None)
    return " AND ".join(sides)


#: The verdict of op5 in DuckDB's SQL, from the same table of rules.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT uid, unnest(range(1, len(w) - 1)) AS i, w FROM w),
r AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY uid),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({", ".join(repr(z) for z in sorted({y for v in STOP_WORDS.values() for x in v.split() for y in (x, x.capitalize(), x.upper())}))}))) AS n_stop,
             len(list_filter(l, lambda x: substring(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1, 2) IN ('- ', '* ', '• '))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN p USING (uid)),
q AS (SELECT *, coalesce(chars, 0) AS word_chars,
             CASE WHEN n_words > 0 THEN coalesce(chars, 0) / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
             CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(_sql_check(rule) for rule in RULES)} AS kept
FROM q
"""
