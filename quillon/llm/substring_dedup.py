"""Substring dedup: seed and extend over winnowed word anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import find_repeats, word_units
from ._shared import Scratch, known, unknown

#: k-gram length and window: repeats of GRAM + WINDOW - 1 = 50 words are certain to share an anchor.
GRAM, WINDOW = 26, 25


def repeated_passages(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Passages of at least ``gram + window - 1`` words that also stand at an earlier place.

    Returns (doc_id, start_word, end_word, n_words, first_doc_id,
    first_start_word). Earlier means a smaller doc_id, or the same document
    further left; a null doc_id sorts first. Every passage is the longest match
    with its earlier place, and every run of that many words that occurs earlier
    lies in the union of its document's passages; passages inside another one
    of the same document are left out.

    Null, empty and short texts have no passages; texts of any length are searched
    whole. doc_id is an integer. A row that is repeated as a whole counts once. Rows that differ under one doc_id are told apart by their
    text, but are not matched with each other at equal positions. Columns other
    than doc_id and text are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(known("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("unit"))
    found = find_repeats(rows, word_units, gram, window, scratch)
    return found.select(
        unknown("id").alias("doc_id"),
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"),
        unknown("rid").alias("first_doc_id"),
        F.col("rstart").alias("first_start_word"),
    ).distinct()
