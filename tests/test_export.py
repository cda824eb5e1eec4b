"""Exported pieces of each kind of segment."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textloom.operators import export

c = F.col
SCHEMA = "at long, kind string, level long, marker string, text string, draft string"
ROWS = [
    (1, "heading", 9, None, "A & B", "甲"), (2, "heading", None, None, "C", None), (3, "list-item", None, "2.", "x\ny", "z"), (4, "list-item", None, None, "w", " "),
    (5, "code", None, None, "a < b", "never"), (6, "quote", None, None, 'said "q"', None), (7, None, None, None, None, None), (8, "paragraph", None, None, "p\nq", "r"),
]


def pieces(spark, piece):
    return [r[0] for r in spark.createDataFrame(ROWS, SCHEMA).orderBy("at").select(piece).collect()]


def test_markdown(spark):
    both = pieces(spark, export.markdown_piece(c("kind"), c("level"), c("marker"), c("text"), c("draft"), True))
    assert both == ["###### A & B\n甲\n\n", "## C\n\n", "2. x y z\n", "- w\n", "```\na < b\n```\n\n", 'said "q"\n\n', "\n\n", "p\nq\nr\n\n"]
    assert pieces(spark, export.markdown_piece(c("kind"), c("level"), c("marker"), c("text"), c("draft"), False))[:3] == ["###### 甲\n\n", "## C\n\n", "2. z\n"]


def test_html(spark):
    got = pieces(spark, export.html_piece(c("kind"), c("level"), c("text"), c("draft"), True))
    assert got[0] == '<h6><div class="original">A &amp; B</div><div class="translation">甲</div></h6>'
    assert got[4:6] == ["<pre><code>a &lt; b</code></pre>", '<blockquote><div class="original">said &quot;q&quot;</div></blockquote>']
    assert got[7] == '<p><div class="original">p<br>q</div><div class="translation">r</div></p>'
    assert pieces(spark, export.html_piece(c("kind"), c("level"), c("text"), c("draft"), False))[1] == '<h2><div class="translation">C</div></h2>'


def test_json_members_make_an_object(spark):
    key = F.concat(F.lit('k"'), c("at"))
    whole = json.loads("{" + ",".join(pieces(spark, export.json_piece(key, c("text"), c("draft"), True))) + "}")
    assert whole == {f'k"{r[0]}': {"original": r[4] or "", "translation": r[5] or ""} for r in ROWS}
    assert json.loads("{" + pieces(spark, export.json_piece(key, c("text"), c("draft"), False))[2] + "}") == {'k"3': "z"}


def test_cues(spark):
    time = F.lit("00:00:01,500")
    assert pieces(spark, export.cue_piece(c("at"), time, F.lit(None).cast("string"), c("text"), c("draft"), True, True))[7] == "8\n00:00:01.500 --> 00:00:00.000\np\nq\nr\n\n"
    assert pieces(spark, export.cue_piece(c("at"), time, time, c("text"), c("draft"), False, False))[1] == "2\n00:00:01,500 --> 00:00:01,500\nC\n\n"
