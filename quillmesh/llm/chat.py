"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue, its turns are rendered with that speaker as the assistant and all others as named
users; only the assistant's turns are trained on. System turns are context: they are no participant and never trained.

A rendered dialogue is its segments in order: row (conv_id, perspective, seq) has the segment's text, its mask and the
place of its first character in the whole, so a dialogue of any length is never one value or one task's work. Places
come from sums over spans of SPAN turn numbers, then over a dialogue's spans.

Turns are ordered by turn, then speaker, then text, nulls first. Rows that repeat another are rendered once. A null
conv_id is a dialogue of its own. A null or blank role is the speaker "unknown"; roles are compared as they are. A null
text is empty. A dialogue of system turns only has no participants and no rows. Extra columns are ignored.

No text can forge a turn: within texts and names "<|" is rendered as "< |", and line ends in names as spaces, so that
the markers of a rendered dialogue are those that stand here. content_chars counts the text as rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = "system"
UNKNOWN = "unknown"
SPAN = 64
#: Fixed values of the rendered form.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rendered_role(speaker: Column, perspective: Column) -> Column:
    name = unmarked(F.regexp_replace(speaker, "[\\n\\r\\x0B\\x0C\\x85\\u2028\\u2029]", " "))
    return F.when(speaker == CONTEXT, F.lit("system")).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, segment, trained, start_char, content_start, content_chars."""
    role = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    speaker = F.when(role == "", UNKNOWN).otherwise(F.col("role").cast("string"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), unmarked(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    people = rows.where(F.col("speaker") != CONTEXT).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # Null-safe equality is an ordinary hash join on (is null, value) and can be split when a dialogue is hot.
    people = people.withColumnRenamed("conv_id", "_conv")
    both = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    # Only the text travels; what stands around it is put there at the end.
    head = F.concat(F.lit(OPEN), rendered_role(F.col("speaker"), F.col("perspective")), F.lit(MIDDLE))
    n = (F.length(head) + F.length("text") + len(CLOSE)).cast("long")
    both = both.select("*", n.alias("n"), F.floor(F.col("turn") / SPAN).alias("span"))

    key = ["conv_id", "perspective"]
    inside = Window.partitionBy(*key, "span").orderBy("turn", "speaker", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = both.select("*", F.row_number().over(inside).alias("_row"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_chars"))
    spans = both.groupBy(*key, "span").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in [*key, "span"]], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_k")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "span"]]
    placed = local.join(spans, same)
    start = F.col("_chars") + F.col("_n0")
    return placed.select(
        *key,
        (F.col("_row") + F.col("_k0") - 1).cast("long").alias("seq"),
        "turn",
        "speaker",
        F.concat(head, "text", F.lit(CLOSE)).alias("segment"),
        (F.col("speaker") == F.col("perspective")).alias("trained"),
        start.cast("long").alias("start_char"),
        (start + F.length(head)).cast("long").alias("content_start"),
        F.length("text").cast("long").alias("content_chars"),
    )


def op7_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' 
      ELSE 'user name=' || replace(regexp_replace(speaker, '[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]', ' ', 'g'), '<|', '< |') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text) - 1 AS seq,
    CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
  FROM g)
SELECT conv_id, perspective, seq, turn, speaker, segment, speaker = perspective AS trained, start_char, start_char + length(head) AS content_start, length(text) AS content_chars FROM w
"""
