"""Periodic runs of words: stretches that repeat with a period, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least max(6, 4 * q)
words, that no neighbouring word extends. For its automaton a text is a sequence of words. Every state holds the positions
at which its strings end, as an ordered set; from the longest states on, sets are merged into that of the suffix
link, the smaller into the larger. Two positions that become neighbours at a distance d of at most the state's length are
the ends of overlapping occurrences, so they seed a square of period d, which is extended to both sides. A run's words
end q before its end too, and the state of the longest common suffix of these two ends holds no position between
them, so each run is seeded. Seeds of a multiple of the smallest period go.

Only stretches that may hold a run get an automaton. In a run of L words all but the last q + 4 positions begin five
words that occur again q words later; so each of these positions has its next occurrence at most q away, and they are
L - q - 4 >= 3 * q - 4 in a row. Positions whose next occurrence is further away than a third of their row allows are out, until none is;
what is left, with the words that its longest possible period may reach, holds all runs. Equal words have equal
hashes, so hashes suffice there; the automaton compares words.

Words are cut at ASCII white space. Null and empty texts have no words and no runs; repeated rows each have a result,
whatever other columns there are. A text's words are held at once, and about 700 bytes for each word of such a stretch.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import by_bytes, column

#: Words of the shortest run, periods that a run has at least, words that are compared by hash.
SHORTEST, PERIODS, GRAM = 6, 4, 5
RUN = "struct<start: long, length: long, period: long>"
FACTORS = np.random.default_rng(3).integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def squares(words: list[int]) -> dict[int, list[int]]:
    """Per distance d the last words of squares of period d that seed runs."""
    length, link, steps, ends = [0], [-1], [{}], [[]]  # ends: negated, so that an earlier position comes last
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        steps.append({})
        ends.append([-i])
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                steps.append(dict(steps[q]))
                ends.append([])
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    found: dict[int, list[int]] = defaultdict(list)
    longest = len(words) // PERIODS
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        u = link[v]
        if u > 0:
            large, small = ends[u], ends[v]
            if len(large) < len(small):
                large, small = small, large
            reach = min(length[u], longest)
            for x in small:
                k = bisect(large, x)
                if k < len(large) and large[k] - x <= reach:
                    found[large[k] - x].append(-x)
                if k and x - large[k - 1] <= reach:
                    found[x - large[k - 1]].append(-large[k - 1])
                large.insert(k, x)
            ends[u] = large
        ends[v] = None
    return found


def is_power(block: np.ndarray) -> bool:
    """Whether a block is a shorter one, repeated."""
    n, rest, f = len(block), len(block), 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            if (block == np.roll(block, n // f)).all():
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def runs_within(words: list[bytes], first: int) -> Iterator[Run]:
    """The runs of a stretch whose first word has the number ``first``."""
    ids: dict[bytes, int] = {}
    own = [ids.setdefault(w, len(ids)) for w in words]
    numbers = np.array(own)
    for d, seeds in squares(own).items():
        differ = np.flatnonzero(numbers[d:] != numbers[:-d])
        bounds = np.concatenate([[-1], differ, [len(own) - d]])
        at = np.unique(np.searchsorted(bounds, np.unique(seeds) - d))
        for a, b in zip((bounds[at - 1] + 1).tolist(), bounds[at].tolist(), strict=True):
            if b - a + d >= max(SHORTEST, PERIODS * d) and not is_power(numbers[a : a + d]):
                yield Run(first + a, b - a + d, d)


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where runs can be: (first word, word after the last), apart from each other."""
    n = len(words) - GRAM + 1
    if n < 2:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    grams = hashes[:n] * FACTORS[0]
    for i in range(1, GRAM):
        grams += hashes[i : n + i] * FACTORS[i]
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(same):
        return []
    places = order[same]
    away = order[same + 1] - places
    by_place = np.argsort(places)
    places, away = places[by_place], away[by_place]
    while len(places):
        first = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        size = np.diff(first, append=len(places))
        ok = away <= np.repeat((size + GRAM - 1) // (PERIODS - 1), size)
        if ok.all():
            break
        places, away = places[ok], away[ok]
    else:
        return []
    out: list[tuple[int, int]] = []
    for a, m in zip(places[first].tolist(), size.tolist(), strict=True):
        b = min(len(words), a + m - 1 + (m + GRAM - 1) // (PERIODS - 1) + GRAM)
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out[-1][1])
            out.pop()
        out.append((a, b))
    return out


def runs_of(words: list[bytes]) -> list[Run]:
    """All runs, by start, then period."""
    return sorted({(r.start, r.period): r for a, b in stretches(words) for r in runs_within(words[a:b], a)}.values(), key=lambda r: (r.start, r.period))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those after the first period of any run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r.start + r.period : r.start + r.length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period, in words, by start and period) and collapsed, the words
    that stay when of each run only the first period does, joined by spaces. ``prepare`` may change the words of a row (its id,
    its words) before the search. No rows meet, so each task reads its rows once."""
    src = df.select(column(id_col).alias("doc_id"), column(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))
        for batch in by_bytes(batches, "text"):
            n, found, kept = [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or b"").split()
                words = prepare(key, words) if prepare else words
                runs = runs_of(words)
                n.append(len(words))
                found.append([r._asdict() for r in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """Of each row the number of runs, the longest one (ties: the first, then of the shortest period) and the digests of all
    runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    x = found.withColumn("best", best)
    length = -F.col("best.less")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.call_function("div", 1000 * length, F.col("best.period")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """Words with a tail that repeats, in the texts and with the period that the id's crc32 says."""
    h = crc32(b"" if key is None else str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


#: All equal five-word sequences at a distance of at most a quarter of a text are paired; pairs of one distance in a row are a run.
SQL = r"""WITH RECURSIVE steps AS (SELECT CAST(range AS BIGINT) AS k, CAST(range AS BIGINT) AS c, 0 AS s FROM range(256)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM steps WHERE s < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM steps WHERE s = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM documents, tab),
n AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM n),
p AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
i AS (SELECT r, n, h, a, p, ws, unnest(range(n)) AS i FROM p),
w AS (SELECT r, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i),
f AS (SELECT r, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS f FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.r = y.r AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
c AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 5 + q AS len FROM s GROUP BY r, q, island HAVING max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
u AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.q < c.q AND b.s <= c.s AND b.s + b.len >= c.s + c.len)),
t AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min((-len, s, q)) AS best FROM u GROUP BY r),
k AS (SELECT w.r, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = w.r AND w.i >= u.s + u.q AND w.i < u.s + u.len) GROUP BY w.r)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period, CAST(1000 * -best[1] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN k ON k.r = d.r"""
