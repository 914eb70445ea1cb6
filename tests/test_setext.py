"""Underlined Markdown titles."""

from pyspark.sql import functions as F

from tessella.operators import chunking as C


def test_underlined_titles(spark):
    text = "A title\n=====\nwords here.\n\na smaller one\n  ---  \n\nPlain. Words.\n\n- item\n-- no"
    rows = spark.createDataFrame([(text,)], "text string")
    got = {rules: [(h["block_index"], h["level"], h["text"]) for h in rows.select(C.headings(C.blocks(F.col("text")), rules).alias("h")).first()["h"]] for rules in ("md", "pdf")}
    assert got["md"] == [(0, 1, "A title"), (1, 2, "a smaller one")]
    assert got["pdf"] == [(0, 1, "A title")]
