"""Quality rules with host verdicts.

Each text is measured in Arrow batches. Per host, the documents that break any rule are counted; the rates
are shrunk towards a beta prior that is fitted to all hosts by moments, so a host with few documents needs
more evidence. A host's verdict is its allowance, the factor by which its documents may exceed the limits of the
rules for symbols and repeated lines: ``slack`` times the prior's mean over the host's shrunk rate, 1 at least and
``most`` at most. On a usual host a document is thus rejected at ``slack`` times the limits; where failures are
``slack`` times as frequent as usual, at the limits themselves. The base rules always reject, and a document that
breaks no rule stays wherever it was found.

Words are runs of anything but U+0020 and U+0009 to U+000D. Null texts have no words and fail; a document
without a host is judged as on a usual one. Repeated rows count each. Hosts are aggregated in two steps, so one host
may hold any share of the rows. An empty table gives an empty one. Other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import by_bytes, column, staged, texts_of

SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # splits bytes at exactly these white-space characters
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.encode().split()]
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            twice = {g for g, k in Counter(grams).items() if k > 1}
            end = 0
            for i, g in enumerate(grams):
                if g in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def metrics(df: DataFrame, keep: dict[str, Column], text: Column) -> DataFrame:
    """The columns of ``keep`` and the measures of each text, which goes along only if it is one of them."""
    names = list(keep)
    src = df.select(*[c.alias(k) for k, c in keep.items()], *([] if "text" in keep else [text.cast("string").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            got = list(zip(*map(measure, texts_of(batch, "text")), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(g, pa.int64()) for g in got], names=[*names, *METRICS])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in names)
    return src.mapInArrow(run, kept + "".join(f", {m} long" for m in METRICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def beyond(allowance: Column) -> Column:
    """Over one symbol in ten words, or over 30 % repeated lines, each times the allowance."""
    return (10 * F.col("n_symbols") > allowance * F.col("n_words")) | (100 * F.col("n_dup_lines") > allowance * 30 * F.col("n_lines"))


def host_verdicts(measured: DataFrame, slack: float, most: float) -> DataFrame:
    """Per host: n, failed (documents that break any rule), rate (shrunk), allowance."""
    failed = base_failed() | beyond(F.lit(1.0))
    hosts = staged(measured.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failed")), "hosts")
    total = hosts.agg(F.sum("n").alias("docs"), F.sum("failed").alias("bad"), F.count("*").alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    if not total.docs:
        mean, weight = 0.0, 1.0
    else:
        mean = total.bad / total.docs
        noise = mean * (1 - mean) * total.hosts / total.docs  # what equal hosts would show by chance
        spread = max(total.squares / total.docs - mean * mean - noise, 1e-9)
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    rate = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    usual = F.when(F.col("rate") > 0, F.least(F.lit(float(most)), F.greatest(F.lit(1.0), F.lit(slack * mean) / F.col("rate")))).otherwise(float(most))
    return hosts.withColumn("rate", rate).withColumn("allowance", usual)


def kept(slack: float) -> Column:
    """Needs the measures and the host's allowance (null without a host)."""
    return ~base_failed() & ~beyond(F.coalesce("allowance", F.lit(float(slack))))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", slack: float = 2.0, most: float = 4.0) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, host_rate, allowance, kept."""
    measured = staged(metrics(df, {"doc_id": column(id_col), "host": column(host_col).cast("string")}, column(text_col)), "rules")
    verdicts = staged(host_verdicts(measured, slack, most).select("host", "rate", "allowance"), "verdicts")
    return measured.join(verdicts, "host", "left").select("doc_id", *METRICS, base_failed().alias("base_failed"), F.col("rate").alias("host_rate"), "allowance", kept(slack).alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source", slack: float = 2.0, most: float = 4.0) -> DataFrame:
    """The rows of ``df`` that the rules keep, with their columns. Texts are measured twice rather than
    written once more."""
    narrow = metrics(df, {"host": column(host_col).cast("string")}, column(text_col))
    verdicts = staged(host_verdicts(narrow, slack, most).select("host", "allowance"), "verdicts")
    # under names of their own, columns can't clash with the measures
    own = {c: "text" if c == text_col and df.schema[c].dataType.simpleString() == "string" else f"c{i}" for i, c in enumerate(df.columns)}
    whole = metrics(df, {**{n: column(c) for c, n in own.items()}, "host": column(host_col).cast("string")}, column(text_col))
    return whole.join(verdicts, "host", "left").filter(kept(slack)).select(*[F.col(n).alias(c) for c, n in own.items()])


def digest(rules: DataFrame) -> DataFrame:
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM grams) WHERE k > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY rid),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (rule_failed) AS failed FROM ruled WHERE source IS NOT NULL GROUP BY source),
total AS (SELECT sum(n) AS docs, sum(failed) AS bad, count(*) AS hosts, sum(failed * failed / n) AS squares FROM hosts),
prior AS (
  SELECT bad / docs AS mean, least(greatest((bad / docs) * (1 - bad / docs) / greatest(squares / docs - (bad / docs) * (bad / docs) - (bad / docs) * (1 - bad / docs) * hosts / docs, 1e-9) - 1, 1.0), 1e6) AS weight FROM total),
verdict AS (
  SELECT source, least(4.0, greatest(1.0, CASE WHEN (failed + mean * weight) > 0 THEN 2.0 * mean / ((failed + mean * weight) / (n + weight)) ELSE 4.0 END)) AS allowance FROM hosts, prior),
allowed AS (SELECT ruled.*, CAST(coalesce(allowance, 2.0) AS DOUBLE) AS allowance FROM ruled LEFT JOIN verdict ON ruled.source = verdict.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > allowance * n_words OR 100 * n_dup_lines > allowance * 30 * n_lines) AS kept
FROM allowed
"""
