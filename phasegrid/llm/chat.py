r"""Operator 7: chat formatting in budgeted windows, by DataFrame functions only.

Prefix sums of turn lengths (in words, which stand for tokens) deal a conversation's turns out to windows: turns that lie inside
one stretch of `new_words` words share a window, and a turn that crosses a stretch's end gets a window of
its own, so a window's new turns exceed the budget only if a single turn does. Each window repeats the
system turn and a few turns before it, within `history_words`; only an assistant turn's first occurrence is
a target.

Template: `### role: text</turn>` and a line feed for each turn. Inside role and text, a backslash becomes
`\b`, `###` becomes `\h`, `</turn>` becomes `\t`, and in roles a colon becomes `\c`: each backslash in the output leads
one of these four, so they can be undone one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

OPEN, CLOSE = "### ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, marked in (*ESCAPES, *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, marked in (*([(":", "\\c")] if role else []), *ESCAPES[::-1]):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def windows(turns: DataFrame, new_words: int = 384, history_words: int = 128, history_turns: int = 2) -> DataFrame:
    """(conv_id, window, text, spans) from turns(conv_id, turn, role, text).

    spans: for each turn in text its start and length in characters, whether it is new here (not repeated)
    and whether it is a target. Null roles and texts are empty; a null conv_id is a conversation of its own.
    Turns with equal numbers go by role and text; repeated rows are turns of their own. A system turn counts as such if it comes
    first. Other columns are not read. A turn of any length is one turn; an empty table gives no rows.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("number"), role.alias("role"), text.alias("text"))
    piece = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(": "), escape(F.col("text")), F.lit(CLOSE))
    conv = Window.partitionBy("conv_id").orderBy("number", "role", "text")
    rows = rows.select("conv_id", "role", piece.alias("piece"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.row_number().over(conv).alias("place"))
    system = (F.col("place") == 1) & (F.col("role") == "system")
    order = Window.partitionBy("conv_id").orderBy("place")
    rows = rows.withColumn("system", system).withColumn("words", F.when(system, 0).otherwise(F.col("words")))
    rows = rows.withColumn("before", F.sum("words").over(order) - F.col("words"))
    slot = F.floor(F.col("before") / new_words)
    crosses = F.floor((F.col("before") + F.greatest(F.col("words"), F.lit(1)) - 1) / new_words) > slot
    rows = rows.withColumn("window", F.when(~F.col("system"), 2 * slot + crosses.cast("long")))
    first = ~F.col("system") & (F.col("window") != F.coalesce(F.lag("window").over(order), F.lit(-1)))
    rows = rows.withColumn("first", first)
    later = [F.lead(F.struct("first", "window", "before"), j).over(order) for j in range(1, history_turns + 1)]
    rows = rows.withColumn("later", F.array(*later))
    place_of = lambda w, new: F.struct(w.alias("window"), new.alias("new"))
    history = F.filter("later", lambda x: x["first"] & (x["before"] - F.col("before") <= history_words))
    own = F.concat(F.array(place_of(F.col("window"), F.lit(True))), F.transform(history, lambda x: place_of(x["window"], F.lit(False))))
    dealt = rows.where(~F.col("system")).select("conv_id", "role", "piece", "place", F.explode(own).alias("at")).select("conv_id", "role", "piece", "place", "at.*")
    # The system turn is repeated in each window of its conversation, and is the only turn of one that has no other.
    repeated = rows.where("system").select(F.col("conv_id").alias("of"), "role", "piece", "place")
    known = rows.where("first").select("conv_id", "window").distinct()
    repeated = repeated.join(known, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    earliest = F.col("window") == F.min("window").over(Window.partitionBy("of"))
    repeated = repeated.select(F.col("of").alias("conv_id"), "role", "piece", "place", F.coalesce("window", F.lit(0).cast("long")).alias("window"), F.coalesce(earliest, F.lit(True)).alias("new"))
    dealt = dealt.unionByName(repeated)
    inside = Window.partitionBy("conv_id", "window").orderBy("place")
    dealt = dealt.withColumn("length", F.length("piece")).withColumn("start", F.sum("length").over(inside) - F.col("length"))
    part = F.struct("place", "piece", "start", "length", "new", (F.col("new") & (F.col("role") == "assistant")).alias("target"))
    made = dealt.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    spans = F.transform("parts", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["new"].alias("new"), x["target"].alias("target")))
    return made.select("conv_id", "window", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("text"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, nth, role, text, target): the turns, each once, from what windows() returns."""
    each = formatted.select("conv_id", "window", "text", F.posexplode("spans").alias("nth", "span")).where("span.new")
    piece = F.expr("substring(text, int(span.start) + 1, int(span.length))")
    body = F.expr(f"substring(piece, {len(OPEN) + 1}, length(piece) - {len(OPEN) + len(CLOSE)})")
    each = each.withColumn("piece", piece).withColumn("body", body).withColumn("mark", F.substring_index("body", ": ", 1))
    rest = F.expr("substring(body, length(mark) + 3)")
    return each.select("conv_id", "window", "nth", unescape(F.col("mark"), True).alias("role"), unescape(rest).alias("text"), F.col("span.target").alias("target"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from its windows."""
    part = F.struct("window", "nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), F.when(F.col("target"), F.col("text")).otherwise("").alias("loss"))
    read = read_back(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    join = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    read = read.select("conv_id", F.size("parts").cast("long").alias("n_turns"), join("turn").alias("turns"), join("loss").alias("loss"))
    read = read.select("conv_id", "n_turns", F.sha2(F.col("turns"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"))
    sizes = formatted.groupBy(F.col("conv_id").alias("of")).agg(F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    return read.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def planted(spark: SparkSession) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op7_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(planted(spark))))


OP7_SQL = r"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n,
    length('### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') || ': '
      || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10)) AS chars FROM a
), c AS (SELECT *, place = 1 AND role = 'system' AS sys, CASE WHEN place = 1 AND role = 'system' THEN 0 ELSE n END AS words FROM b),
d AS (SELECT *, sum(words) OVER (PARTITION BY conv_id ORDER BY place)::BIGINT - words AS before FROM c),
e AS (SELECT *, CASE WHEN NOT sys THEN 2 * (before // 384) + CASE WHEN (before + greatest(words, 1) - 1) // 384 > before // 384 THEN 1 ELSE 0 END END AS win FROM d),
f AS (SELECT *, NOT sys AND win <> coalesce(lag(win) OVER (PARTITION BY conv_id ORDER BY place), -1) AS first FROM e),
g AS (SELECT *,
    CASE WHEN coalesce(lead(first, 1) OVER (PARTITION BY conv_id ORDER BY place) AND lead(before, 1) OVER (PARTITION BY conv_id ORDER BY place) - before <= 128, false) THEN 1 ELSE 0 END
    + CASE WHEN coalesce(lead(first, 2) OVER (PARTITION BY conv_id ORDER BY place) AND lead(before, 2) OVER (PARTITION BY conv_id ORDER BY place) - before <= 128, false) THEN 1 ELSE 0 END AS again,
    greatest(1, count(CASE WHEN first THEN 1 END) OVER (PARTITION BY conv_id)) AS wins FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place))::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
  sum(chars * CASE WHEN sys THEN wins ELSE 1 + again END)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
