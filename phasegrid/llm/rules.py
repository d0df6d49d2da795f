"""Operator 5: line-first quality rules, by DataFrame functions only.

Each line of a text is held against rules on punctuation, navigation and boilerplate. Lines that fail one
are removed, and a document is rejected if too much of its text goes, or if it fails the base rules (too
few words, too many words in five-word windows that recur in it).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, table

GAP = r"[\x20\x09-\x0D]+"
#: Phrases of notices, banners and page furniture.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "accept cookies", "we use cookies",
    "subscribe to our", "sign up for", "log in to", "click here", "skip to content", "share this", "powered by", "copyright ©", "licensed under", "released under the", "enable javascript",
)
BOILERPLATE_PATTERN = "(?i)(" + "|".join(BOILERPLATE) + ")"
NAVIGATION_PATTERN = r"(\|[^|]*\|)|([»›][^»›]*[»›])|^[\x20\x09-\x0D]*(?i:home|menu|search|login|next|previous|back to top)[\x20\x09-\x0D]*$"


_PLAIN_NAVIGATION = ("home", "menu", "search", "login", "next", "previous", "back to top")


def line_passes(line: Column) -> Column:
    """Whether a line with words stays, boilerplate aside: it has punctuation if five words or more, few symbols, isn't all in capitals, and isn't navigation.

    Each rule begins with a cheap condition that a line which fails it must meet, so few lines are counted or searched in full.
    """
    n = F.regexp_count(line, F.lit(WORD))
    bare = ~line.rlike(r"[.!?,;:…。]") & (n >= 5)
    symbols = line.rlike(r"[#*$%&|<>]") & (2 * F.regexp_count(line, F.lit(r"[#*$%&|<>]")) > n)
    loud = ~line.rlike("[a-z]") & (F.upper(line) == line) & (F.lower(line) != line) & (n >= 3)
    bar = F.contains(line, F.lit("|")) | F.contains(line, F.lit("»")) | F.contains(line, F.lit("›")) | F.lower(F.btrim(line, F.lit(SPACES))).isin(*_PLAIN_NAVIGATION)
    return ~(bare | symbols | loud | (bar & line.rlike(NAVIGATION_PATTERN)))


def has_boilerplate(text: Column) -> Column:
    """Whether one of the phrases stands in the text, in any case."""
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it, whatever the optimiser makes of the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column) -> Column:
    """The hashes of the five-word windows; none for fewer words."""
    each = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - 4, F.lit(0))) for k in range(5)])
    return F.transform(each, lambda x: F.xxhash64(x))


def _repeat_words(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more.

    Windows are sorted by hash, only where some recur. Each recurring window, in order of place, adds the words that the one
    before hasn't covered.
    """
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
    places = bound(by_hash, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    words = F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), words).otherwise(F.lit(0).cast("long"))


def clean(docs: DataFrame, least_words: int = 10, most_repeats: int = 20, least_left: float = 0.5) -> DataFrame:
    """One row for each of docs(doc_id, text), with the counts, the verdicts and clean_text, the lines that stay.

    A null text has no words and is rejected. A line equals another if all their characters do. Repeated rows return
    as often as they came; null ids are kept; other columns are not read; an empty table gives no rows. Work grows with a text's
    length times its logarithm. All that is measured comes out of one generator, so a filter on any of it isn't moved below
    and what it measures isn't computed again.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.select("*", F.split(F.btrim("text", F.lit(SPACES)), GAP).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    base = base.withColumn("words", F.when(F.get("words", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("words")))
    wordy = F.filter("lines", lambda x: x.rlike(BOILERPLATE_PATTERN) | ~line_passes(x))
    plain = F.filter("lines", lambda x: ~line_passes(x))
    base = base.withColumn("windows", _windows(F.col("words"))).withColumn("bad_lines", F.when(has_boilerplate(F.col("text")), wordy).otherwise(plain))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    measured = F.struct(
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("windows")).alias("n_repeat_words"),
        (F.col("n_words") - F.regexp_count(F.array_join("bad_lines", "\n"), F.lit(WORD))).alias("left_words"),
    )
    base = base.select("doc_id", "text", F.inline(F.array(measured)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    base = base.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("left_words") >= least_left * F.col("n_words")))
    some = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stays = F.when(has_boilerplate(F.col("text")), F.filter(some, lambda x: line_passes(x) & ~x.rlike(BOILERPLATE_PATTERN))).otherwise(F.filter(some, line_passes))
    return base.withColumn("clean_text", F.array_join(stays, "\n")).drop("text")


def op5_rules(spark, sf_dir):
    return clean(table(spark, sf_dir, "documents")).drop("clean_text")


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, unnest(list_value(i, i + 1, i + 2, i + 3, i + 4)) AS place
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM g GROUP BY 1),
k AS (SELECT doc_id, list_filter(lines, lambda l: NOT (
        (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 5 AND NOT regexp_matches(l, '[.!?,;:…。]'))
        OR 2 * len(regexp_extract_all(l, '[#*$%&|<>]')) > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
        OR (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 3 AND upper(l) = l AND lower(l) <> l)
        OR regexp_matches(l, '{NAVIGATION_PATTERN}') OR regexp_matches(l, '{BOILERPLATE_PATTERN}'))) AS kept_lines FROM w),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(translate(text, {_SPACES_SQL}, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(array_to_string(kept_lines, chr(10)), '[^\x20\x09-\x0D]+'))::BIGINT AS left_words
      FROM w JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND left_words >= 0.5 * n_words AS kept FROM b
"""
