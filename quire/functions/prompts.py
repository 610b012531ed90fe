"""Prompts assembled per row from a book's profile. The wording is our own; the conditions are the contract:
nothing is said about what isn't known, and every field of the profile that is known is mentioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import or_empty, truthy

VAGUE = "A page of an old printed book follows; nothing is known beforehand about its language, writing or age."


def describe(profile: Column) -> Column:
    """Sentences about a profile struct; a vague one for null."""
    era, language, script = truthy(profile["era"]), truthy(profile["primary_language"]), truthy(profile["script"])
    plain = F.lower(script).isin("latin", "roman")
    lead = F.concat(
        F.lit("A page of "),
        F.coalesce(F.concat(F.lit("a "), era, F.lit(" book")), F.lit("an old book")),
        or_empty(F.concat(F.lit(" mainly in "), language)),
        or_empty(F.when(~plain, F.concat(F.lit(", written in "), script, F.lit(" script")))),
        F.lit(" follows."),
    )
    others = F.when(F.size(F.coalesce(profile["other_languages"], F.array())) > 0, F.concat(F.lit("It also has passages in "), F.array_join(profile["other_languages"], ", "), F.lit(".")))
    face = F.concat(F.lit("Its typeface: "), truthy(profile["typeface"]), F.lit("."))
    habits = F.concat(F.lit("Its spelling: "), truthy(profile["orthographic_notes"]))
    return F.when(profile.isNull(), VAGUE).otherwise(F.concat_ws(" ", lead, others, face, habits))


def page_prompt(profile: Column, preserve_layout: bool = True) -> Column:
    layout = "Keep its line breaks and layout." if preserve_layout else "Reflow it into running prose without its line breaks."
    rules = f"Copy the text exactly as printed, without correcting, expanding or translating. {layout} Body text goes into transcription, notes into footnotes. Write {fixed.ILLEGIBLE} for what can't be read and set has_uncertain_text. page_type is one of {', '.join(fixed.PAGE_TYPES)}. Answer with the JSON only."
    return F.concat_ws(" ", describe(profile), F.lit(rules))


def profile_prompt() -> Column:
    return F.lit("These are opening pages of one old printed book. Name its language, script and rough period, and its habits of spelling and type. Write unknown where they don't show it. Transcribe nothing. Answer with the JSON only.")
