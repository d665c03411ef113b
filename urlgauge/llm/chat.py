"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as `<turn role>text</turn>` and a line end; what looks like these marks inside a role or text is
escaped and can be taken back. Prefix sums of the turns' tokens cut a conversation into spans of whole turns.
Each window holds the system turn, a limited number of tokens of the turns before its span, and its span.
Only the span's assistant turns are targets; everything that is repeated is masked, so each one counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
#: Tokens that the marks of a turn count as.
MARKS = 4
#: A token is a run of letters, digits, underlines and non-ASCII characters, or one other visible character.
TOKEN = r"[^\x00-/:-@\[-^`{-\x7F]+|[!-/:-@\[-^`{-~]"
#: Fixed values of the template: what is escaped, and how. The backslash comes first.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("<turn ", "\\s"), (">", "\\g"))
OPEN, SHUT, TURN_END = "<turn ", ">", "</turn>\n"
TARGET = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """`escape` taken back; every backslash of an escaped text starts a code, so the order is safe."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Each turn with its order, tokens, prefix sum and span; `fixed` tells the system turn that every window keeps.

    A conversation's room is the budget less its system turn and the history, at least a quarter of the budget. A
    turn's span is the half room that its first token falls in, so a span of turns of up to half a room each never
    passes the room; a longer turn is a span of its own, whole.
    """
    turns = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("nth", F.row_number().over(by))
    turns = turns.withColumn("fixed", (F.col("nth") == 1) & (F.col("role") == "system"))
    kept = F.first(F.when(F.col("nth") == 1, F.when(F.col("fixed"), F.col("tokens")).otherwise(0)), ignorenulls=True)
    row = Window.partitionBy("conv_id").orderBy("nth")
    so_far = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("half", F.greatest(F.lit(budget - history) - kept.over(so_far), F.lit(budget // 4)).cast("long"))
    turns = turns.withColumn("half", F.expr("half div 2"))
    own = F.when(F.col("fixed"), 0).otherwise(F.col("tokens"))
    turns = turns.withColumn("start", F.sum(own).over(so_far) - own)
    turns = turns.withColumn("cell", F.expr("start div half")).withColumn("long", F.col("tokens") > F.col("half"))
    new = ~F.col("fixed") & (
        (F.col("cell") != F.lag("cell", 1, -1).over(row)) | F.col("long") | F.lag("long", 1, True).over(row) | F.lag("fixed", 1, True).over(row)
    )
    turns = turns.withColumn("opens", new)
    return turns.withColumn("span", F.greatest(F.sum(new.cast("long")).over(so_far), F.lit(1)) - 1).drop("cell", "long", "half")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, span, text, repeated (turns at the start that an earlier window has) and loss (start, length of each target).

    turns: conv_id, turn, role, text; other columns are not looked at. Rows are ordered by turn, then role and
    text; repeated rows are turns of their own. Null roles and texts are empty; a null conv_id is one conversation.
    Starts and lengths are code points of the text. A conversation of a system turn alone is one window; an empty
    table gives no rows.
    """
    turns = spans(turns, budget, history)
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(0, history)
    opening = F.when(F.col("opens"), F.struct("span", "start"))
    turns = turns.withColumn("later", F.when(~F.col("fixed"), F.collect_list(opening).over(ahead)))
    last = F.max("span").over(Window.partitionBy("conv_id"))
    again = F.filter("later", lambda x: (x["span"] > F.col("span")) & (x["start"] >= F.col("start") + F.col("tokens")))
    other = F.when(F.col("fixed"), F.when(F.col("last") > 0, F.sequence(F.lit(1).cast("long"), F.col("last")))).otherwise(F.transform(again, lambda x: x["span"]))
    turns = turns.withColumn("last", last).withColumn("others", F.coalesce(other, F.expr("cast(array() as array<bigint>)")))
    turns = turns.withColumn("line", F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(SHUT), escape(F.col("text")), F.lit(TURN_END)))
    turns = turns.withColumn("before", F.char_length(escape(F.col("role"), role=True)) + len(OPEN) + len(SHUT))
    kept = ["conv_id", "nth", "role", "line", "before"]
    placed = turns.select(*kept, F.explode(F.concat(F.array(F.col("span")), F.col("others"))).alias("at"), "span")
    placed = placed.withColumn("new", F.col("at") == F.col("span"))
    order = Window.partitionBy("conv_id", "at").orderBy("nth")
    size = F.char_length("line")
    placed = placed.withColumn("offset", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    target = F.when(
        F.col("new") & (F.col("role") == TARGET),
        F.struct((F.col("offset") + F.col("before")).alias("start"), (size - F.col("before") - len(TURN_END)).cast("long").alias("length")),
    )
    out = placed.groupBy("conv_id", F.col("at").alias("span")).agg(
        F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("lines"),
        F.sum((~F.col("new")).cast("long")).alias("repeated"),
        F.array_sort(F.collect_list(target)).alias("loss"),
    )
    return out.select("conv_id", "span", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("text"), "repeated", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, span, nth, role and text of each turn of the windows, without repeats."""
    parts = F.split("text", F.lit(TURN_END))
    lines = F.slice(parts, F.col("repeated").cast("int") + 1, F.size(parts) - 1 - F.col("repeated").cast("int"))
    rows = formatted.select("conv_id", "span", F.posexplode(lines).alias("nth", "line"))
    shut = F.locate(SHUT, F.col("line"))
    return rows.select(
        "conv_id", "span", "nth",
        unescape(F.expr(f"substring(line, {len(OPEN) + 1}, locate('{SHUT}', line) - {len(OPEN) + 1})")).alias("role"),
        unescape(F.substring(F.col("line"), shut + 1, F.char_length("line"))).alias("text"),
    )


def loss_texts(formatted: DataFrame) -> DataFrame:
    """conv_id and the texts under the loss mask of each window, unescaped, in order."""
    texts = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return formatted.select("conv_id", "span", texts.alias("texts"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows."""
    turns = read_back(formatted).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("span", "nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("x")))).alias("x"),
    )
    texts = loss_texts(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "texts"))).alias("t"))
    texts = texts.withColumn("t", F.concat_ws("", F.flatten(F.transform("t", lambda x: x["texts"]))))
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.char_length("text").cast("long")).alias("formatted_chars"))
    joined = turns.alias("a").join(texts.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).join(sizes.alias("c"), F.col("a.conv_id").eqNullSafe(F.col("c.conv_id")))
    return joined.select(
        F.col("a.conv_id").alias("conv_id"), "n_turns", F.sha2(F.concat_ws("", F.transform("x", lambda x: x["x"])), 256).alias("turns_sha256"),
        F.char_length("t").cast("long").alias("loss_chars"), F.sha2("t", 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise(TARGET), F.lit(hard))
    return digest(windows(turns.union(own)))


OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
    len(regexp_extract_all(text, '{TOKEN}')) + {MARKS} AS tokens,
    length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '<turn ', '\s'), '>', '\g'))
      + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '<turn ', '\s')) + {len(OPEN) + len(SHUT) + len(TURN_END)} AS size
  FROM t
), h AS (
  SELECT *, nth = 1 AND role = 'system' AS fixed FROM n
), k AS (
  SELECT *, greatest({BUDGET - HISTORY} - max(CASE WHEN fixed THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), {BUDGET // 4}) // 2 AS half,
    sum(CASE WHEN fixed THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY nth) - CASE WHEN fixed THEN 0 ELSE tokens END AS start
  FROM h
), o AS (
  SELECT *, NOT fixed AND (start // half <> coalesce(lag(start // half) OVER w, -1) OR tokens > half
    OR coalesce(lag(tokens > half) OVER w, true) OR coalesce(lag(fixed) OVER w, true)) AS opens
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), s AS (
  SELECT *, greatest(sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY nth), 1) - 1 AS span FROM o
), again AS (
  SELECT a.conv_id, sum(a.size) AS chars
  FROM s a JOIN s b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.opens AND b.span > a.span
    AND (a.fixed OR (b.start >= a.start + a.tokens AND b.start <= a.start + {HISTORY}))
  GROUP BY a.conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = '{TARGET}'), '') AS loss, sum(size) AS chars
  FROM s GROUP BY conv_id
)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(g.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN again ON g.conv_id IS NOT DISTINCT FROM again.conv_id
"""
