"""The quality gate as one chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.once import once
from quire.functions.text import has_loop, occurrences, or_empty, strip


def stripped(transcription: Column, footnotes: Column) -> Column:
    """What the rules look at. There is nothing between the two, and stripping comes first."""
    return strip(F.concat(or_empty(transcription), or_empty(footnotes)))


def flag_reason(page_type: Column, text: Column) -> Column:
    """Why a page result is doubtful; empty if it isn't. The order of the rules matters: pages without text
    pass first, and the length only counts for whole text pages."""
    kind = strip(or_empty(page_type))
    before, after = fixed.TOO_SHORT.split("{}")
    illegible = occurrences(text, F.lit(fixed.ILLEGIBLE)) * len(fixed.ILLEGIBLE)
    return (
        F.when(kind.isin(*fixed.EMPTY_TYPES), "")
        .when((kind == "text") & (F.length(text) < fixed.MIN_TEXT_LENGTH), F.concat(F.lit(before), F.length(text).cast("string"), F.lit(after)))
        .when(has_loop(text), fixed.LOOP)
        .when((F.length(text) > 0) & (illegible > fixed.MAX_ILLEGIBLE * F.length(text)), fixed.TOO_ILLEGIBLE)
        .when(text.rlike(fixed.CONTROL_CHARS), fixed.HAS_CONTROL)
        .otherwise("")
    )


def gate(results: DataFrame) -> DataFrame:
    """Page results (page_type, transcription, footnotes) with flag_reason and status."""
    text = once(results, __text=stripped(F.col("transcription"), F.col("footnotes")))
    judged = once(text, flag_reason=flag_reason(F.col("page_type"), F.col("__text"))).drop("__text")
    return judged.withColumn("status", F.when(F.col("flag_reason") == "", "done").otherwise("flagged"))
