"""Pieces of exported files, a row per segment: a file is its pieces in order, so that none is held whole by a task.

Turns of conversations are segments, those of users headings; a turn's translation is its text in another script, that of an assistant is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import export
from textloom.plans.base import query, table
from textloom.plans.derived import LETTERS, SIGNS

DRAFT = f"CASE WHEN role = 'user' THEN translate(lower(text), '{LETTERS}', '{SIGNS}') END"
ROWS = f"(SELECT conv_id, turn, role, text, {DRAFT} AS draft, CASE WHEN role = 'user' THEN 'heading' END AS kind FROM conversations)"
BOTH = "text || coalesce(chr(10) || draft, '')"
ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(10), '<br>')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("draft", F.expr(DRAFT)).withColumn("kind", F.when(F.col("role") == "user", "heading"))


@query("snk01_markdown_pieces", f"SELECT conv_id, turn, role, CASE WHEN kind = 'heading' THEN '### ' ELSE '' END || {BOTH} || chr(10) || chr(10) AS piece FROM {ROWS}")
def markdown_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return turns(spark, sf_dir).select("conv_id", "turn", "role", export.markdown_piece(c("kind"), F.lit(3), F.lit(None).cast("string"), c("text"), c("draft"), True).alias("piece"))


@query(
    "snk01_html_pieces",
    f"""SELECT conv_id, turn, role, CASE WHEN kind = 'heading' THEN '<h3><div class="original">' || {ESCAPED.format('text')} || '</div><div class="translation">' || {ESCAPED.format('draft')} || '</div></h3>'
ELSE '<p><div class="original">' || {ESCAPED.format('text')} || '</div></p>' END AS piece FROM {ROWS}""",
)
def html_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return turns(spark, sf_dir).select("conv_id", "turn", "role", export.html_piece(c("kind"), F.lit(3), c("text"), c("draft"), True).alias("piece"))


@query("snk01_json_pieces", f"SELECT conv_id, turn, role, to_json('t' || turn) || ':' || to_json(struct_pack(original := text, translation := coalesce(draft, ''))) AS piece FROM {ROWS}")
def json_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return turns(spark, sf_dir).select("conv_id", "turn", "role", export.json_piece(F.concat(F.lit("t"), "turn"), c("text"), c("draft"), True).alias("piece"))


@query("snk01_vtt_pieces", "SELECT conv_id, turn, role, (turn + 1) || chr(10) || '00:00:00.000 --> 00:00:00.000' || chr(10) || coalesce(draft, text) || chr(10) || chr(10) AS piece FROM " + ROWS)
def vtt_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    return turns(spark, sf_dir).select("conv_id", "turn", "role", export.cue_piece(c("turn") + 1, none, none, c("text"), c("draft"), False, True).alias("piece"))
