"""Failures, payloads and token usage of a metered HTTP API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.once import once
from quire.functions.text import has_any, or_empty, strip, truthy

#: Types of the response, of a page result and of a book profile.
RESPONSE = "struct<steps: array<struct<type: string, content: array<struct<type: string, text: string>>>>>"
PAGE_RESULT = "struct<page_type: string, transcription: string, footnotes: string, languages: array<string>, has_uncertain_text: boolean, note: string>"
PROFILE = "struct<primary_language: string, other_languages: array<string>, script: string, era: string, typeface: string, orthographic_notes: string, title_as_printed: string>"


def failure(status: Column, body: Column, headers: Column) -> Column:
    """struct(kind, retry_after, message). Only a body that names the credential rejects a key; a refusal
    without such a marker came from something in between."""
    dead = has_any(body, fixed.DEAD_MARKERS)
    kind = (
        F.when(status == 429, "RateLimited")
        .when(status.isin(401, 403), F.when(dead, "KeyRejected").otherwise("TransientError"))
        .when(status == 400, F.when(dead, "KeyRejected").otherwise("BadResponse"))
        .when(status >= 500, "TransientError")
        .otherwise("BadResponse")
    )
    named = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == "retry-after")  # headers ignore case
    header = truthy(F.get(named, F.lit(0))["value"])
    return F.struct(kind.alias("kind"), F.when(status == 429, header.try_cast("double")).alias("retry_after"), F.left(or_empty(body), F.lit(fixed.SNIPPET)).alias("message"))


def model_text(response: Column) -> Column:
    """The first text block of the first output step of a response struct; null without one."""
    step = F.get(F.filter(response["steps"], lambda s: s["type"] == "model_output"), F.lit(0))
    block = F.get(F.filter(step["content"], lambda c: c["type"] == "text"), F.lit(0))
    return truthy(block["text"])


def unfenced(text: Column) -> Column:
    """Without the code fence that a model may put around its JSON."""
    raw = strip(text)
    opened = F.regexp_replace(raw, r"\A[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"```\s*\z", "")
    return F.when(raw.startswith("```"), closed).otherwise(raw)


def with_payload(df: DataFrame, response: Column, name: str = "payload") -> DataFrame:
    """Adds struct(error, result) of a response struct; error is null if the page type is there. Text, parsed tree and
    result are each found once a row."""
    has_step = F.exists(F.coalesce(response["steps"], F.array()), lambda s: s["type"] == "model_output")
    df = once(df, __step=has_step, __text=model_text(response))
    df = once(df, __raw=unfenced(F.col("__text")))
    df = once(df, __kind=F.schema_of_variant(F.try_parse_json("__raw")), __result=F.from_json("__raw", PAGE_RESULT))
    error = (
        F.when(~F.col("__step"), "no output step")
        .when(F.col("__text").isNull(), "no text in the output")
        .when(F.col("__kind").isNull(), "not valid JSON")
        .when(~F.col("__kind").startswith("OBJECT"), "not an object")
        .when(truthy(F.col("__result.page_type")).isNull(), "no page type")
    )
    df = once(df, __error=error)
    found = F.struct(F.col("__error").alias("error"), F.when(F.col("__error").isNull(), F.col("__result")).alias("result"))
    return df.withColumn(name, found).drop("__step", "__text", "__raw", "__kind", "__result", "__error")


def token_usage(response: Column) -> Column:
    """struct(input, output) of a response as JSON text. The first usage object counts, whichever of its spellings
    is there; zero counts as missing."""
    out = F.lit(None).cast("struct<input: long, output: long>")
    tree = F.try_parse_json(response)

    def first_of(container: str, names: tuple[str, ...]) -> Column:
        got = [F.nullif(F.try_variant_get(tree, f"$.{container}.{n}", "double").cast("long"), F.lit(0).cast("long")) for n in names]
        return F.coalesce(*got, F.lit(0).cast("long"))

    for container in fixed.USAGE_FIELDS:
        is_object = F.schema_of_variant(F.try_variant_get(tree, f"$.{container}", "variant")).startswith("OBJECT")
        out = F.coalesce(out, F.when(is_object, F.struct(first_of(container, fixed.INPUT_FIELDS).alias("input"), first_of(container, fixed.OUTPUT_FIELDS).alias("output"))))
    return F.coalesce(out, F.struct(F.lit(0).cast("long").alias("input"), F.lit(0).cast("long").alias("output")))


def profile_fields(profile: Column) -> Column:
    """A profile struct with unknown era and script emptied."""
    known = lambda c: F.when(F.lower(strip(or_empty(c))).isin("unknown", "n/a", ""), "").otherwise(c)
    return profile.withField("era", known(profile["era"])).withField("script", known(profile["script"]))


def mime_type(image_format: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, image_format), F.lit("image/png"))


def request_body(model: Column, prompt: Column, images: Column, image_format: Column, resolution: Column, schema_json: str, thinking: Column | None = None) -> Column:
    """A request as JSON text: the prompt, then each of ``images`` (array of binary). The resolution and the
    thinking level are left out where null or empty; nothing is to be stored by the other side."""
    kind = mime_type(image_format)
    pictures = F.transform(images, lambda i: F.to_json(F.struct(F.lit("image").alias("type"), F.base64(i).alias("data"), kind.alias("mime_type"), truthy(resolution).alias("resolution"))))
    content = F.concat(F.array(F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text")))), pictures)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    level = F.lit("") if thinking is None else F.when(or_empty(thinking) == "", "").otherwise(F.concat(F.lit(',"thinking_level":'), quoted(thinking)))
    shape = F.lit('],"response_format":{"type":"text","mime_type":"application/json","schema":' + schema_json + "}")
    return F.concat(F.lit('{"model":'), quoted(model), F.lit(',"store":false,"input":['), F.array_join(content, ","), shape, level, F.lit("}"))
