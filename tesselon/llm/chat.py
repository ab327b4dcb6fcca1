"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

Method: for every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; only the assistant's contents are learned.  The result is a
row for each perspective and turn: the rendered segment, its place in the rendered dialogue, and the
place of the part that the loss mask covers.  Concatenating a perspective's segments in order gives
its text, so that a conversation of any length never has to fit into one row or task.

No content can forge a turn: in texts and names ``<|`` is written ``<\\|``, and line breaks in names
are blanks.  Places are running sums in two steps: within ranges of turns, and over the ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turns of a range within which lengths are summed first.
RANGE = 256


def _quoted(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: str = "system") -> DataFrame:
    """(conv, perspective, turn, seq, role, name, segment, start, end, mask_start, mask_end, learned).

    Turns of the ``context`` role are rendered for everyone and are nobody's perspective.  A null role
    is the participant ``unknown``; a null text is empty; rows of a null conversation are one
    conversation.  Turns are ordered by number, nulls first, then by role and text, so ties are settled
    and repeated rows stay.  A conversation with context turns only has no perspectives.  Texts of any
    length are rendered whole.  Places count characters of the rendered dialogue, ends are exclusive;
    other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"), _quoted(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    rows = rows.withColumn("g", F.floor(F.col("t") / RANGE))
    speakers = rows.filter(F.col("r") != context).select(F.col("c").alias("sc"), F.col("r").alias("p")).distinct()
    seen = rows.join(speakers, F.col("c").eqNullSafe(F.col("sc"))).drop("sc")
    kind = F.when(F.col("r") == context, context).when(F.col("r") == F.col("p"), "assistant").otherwise("user")
    name = F.when(kind == "user", F.col("r"))
    head = F.concat(F.lit("<|"), kind, F.lit("|>"), F.coalesce(F.concat(F.lit(" name="), F.translate(_quoted(name), "\r\n", "  ")), F.lit("")), F.lit("\n"))
    made = seen.select("c", "p", "t", "g", "r", "x", kind.alias("k"), name.alias("n"), head.alias("h"), F.concat(head, F.col("x"), F.lit("<|end|>\n")).alias("s"))
    made = made.withColumn("size", F.length("s").cast("long"))
    ranges = made.groupBy("c", "p", "g").agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    before = Window.partitionBy("c", "p").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("c").alias("rc"), F.col("p").alias("rp"), F.col("g").alias("rg"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("c", "p", "g").orderBy("t", "r", "x")
    own = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).withColumn("place", F.row_number().over(inside) - 1)
    placed = placed.join(ranges, F.col("c").eqNullSafe(F.col("rc")) & (F.col("p") == F.col("rp")) & F.col("g").eqNullSafe(F.col("rg")))
    start = F.col("base") + F.col("within")
    learned = F.col("k") == "assistant"
    a = start + F.length("h")
    return placed.select(
        F.col("c").alias(conv), F.col("p").alias("perspective"), F.col("t").alias(turn), (F.col("first") + F.col("place")).alias("seq"), F.col("k").alias("role"), F.col("n").alias("name"), F.col("s").alias("segment"),
        start.alias("start"), (start + F.col("size")).alias("end"), F.when(learned, a).alias("mask_start"), F.when(learned, a + F.length("x") + F.length(F.lit("<|end|>"))).alias("mask_end"), learned.alias("learned"),
    )


def transcripts(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, perspective, text, masks) for conversations that fit into a row each."""
    whole = segments.groupBy(conv, "perspective").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end"))).alias("all"))
    masks = F.transform(F.filter("all", lambda s: s.mask_start.isNotNull()), lambda s: F.struct(s.mask_start.alias("start"), s.mask_end.alias("end")))
    return whole.select(conv, "perspective", F.array_join(F.transform("all", lambda s: s.segment), "").alias("text"), masks.alias("masks"))


SQL = """
WITH t AS (SELECT conv_id AS c, turn AS t, coalesce(role, 'unknown') AS r, replace(coalesce("text", ''), '<|', '<\\|') AS x FROM conversations),
p AS (SELECT DISTINCT c, r AS p FROM t WHERE r <> 'system'),
m AS (SELECT t.c, p.p, t.t, t.r, t.x, CASE WHEN t.r = 'system' THEN 'system' WHEN t.r = p.p THEN 'assistant' ELSE 'user' END AS k FROM t JOIN p ON t.c IS NOT DISTINCT FROM p.c),
h AS (SELECT *, CASE WHEN k = 'user' THEN r END AS n, '<|' || k || '|>' || CASE WHEN k = 'user' THEN ' name=' || translate(replace(r, '<|', '<\\|'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS h FROM m),
s AS (SELECT *, h || x || '<|end|>' || chr(10) AS s FROM h),
o AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(sum(length(s)) OVER w AS BIGINT) AS e FROM s
  WINDOW w AS (PARTITION BY c, p ORDER BY t NULLS FIRST, r, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c AS conv_id, p AS perspective, t AS turn, seq, k AS role, n AS name, s AS segment, e - length(s) AS "start", e AS "end",
  CASE WHEN k = 'assistant' THEN e - length(s) + length(h) END AS mask_start,
  CASE WHEN k = 'assistant' THEN e - 1 END AS mask_end, k = 'assistant' AS learned
FROM o"""
