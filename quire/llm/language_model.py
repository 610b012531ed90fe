"""Language-model scores: likelihood of a text over all its segmentations into subword pieces.

The vocabulary is that of an existing piece model. Its scores (ranks for a BPE model, log probabilities for a
unigram one) give the first weights; expectation-maximization over the words of the training documents makes
them probabilities. A word is a mark and its characters; the forward recursion in log space sums
over all ways to cut it into pieces, and a text's probability is the product over its words and one end
symbol. Characters without a piece are spelled in byte pieces. The base score is an add-one word unigram.

All words of all documents are counted, with sums in each task before the shuffle. Words are scored once each,
whatever the number of texts. The ``hot`` most frequent words (a fixed bound) travel by broadcast; every
other word of a document is joined to the word table, so no word can hold more than a small share of that join.

Null and empty texts are one end symbol. Repeated rows count and are scored each; a null id hashes as the
empty text. Without training documents counts are zero and pieces keep their first weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_pairs, by_bytes, discard, gathered, id_hash, most_frequent, staged, texts_of

MARK = "▁"
BASE = np.uint64(0x100000001B3)
SLOT = np.uint64(0x9E3779B97F4A7C15)
LN10 = log(10)
#: Words of more characters are segmented one at a time.
LONG = 40
#: Words segmented together: few enough to hold, enough that arrays pay off.
BULK = 150_000


class Pieces:
    """Piece strings and a hash table from substrings to piece numbers; the last number is the end symbol."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size, self.end = size + 1, size
        scores = np.array([model.get_score(i) for i in range(size)] + [0.0])
        usable = np.zeros(self.size, bool)
        usable[[*self.names.values(), *self.bytes, self.end]] = True
        ranked = scores[list(self.names.values())].min() < -1000
        # a rank weighs as in Zipf's law; bytes weigh as the rarest piece
        first = np.where(scores <= 0, 1 / (3 - np.maximum(scores, -1e6)), 1.0) if ranked else np.exp(scores)
        first[self.bytes] = first[list(self.names.values())].min()
        first[self.end] = first[list(self.names.values())].max()
        self.first = np.where(usable, first, 0.0)
        self.usable = usable
        self.longest = max(map(len, self.names))
        keys = np.array([self.key(p) for p in self.names], np.uint64)
        bits = int(len(keys) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_keys, self.slot_ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for k, at, i in zip(keys, ((keys * SLOT) >> self.shift).tolist(), self.names.values(), strict=True):
            while self.slot_ids[at] >= 0:
                at = (at + 1) & self.mask
            self.slot_keys[at], self.slot_ids[at] = k, i

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * BASE + np.uint64(ord(c) + 1)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * SLOT) >> self.shift).astype(np.int64)
        ids = self.slot_ids[at]
        got = np.where(self.slot_keys[at] == keys, ids, -1)
        left = np.flatnonzero((self.slot_keys[at] != keys) & (ids >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            ids = self.slot_ids[at[left]]
            hit = (self.slot_keys[at[left]] == keys[left]) & (ids >= 0)
            got[left[hit]] = ids[hit]
            left = left[~hit & (ids >= 0)]
        return got


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def spelled(p: Pieces, weights: np.ndarray, char: int) -> float:
    return float(sum(weights[p.bytes[b]] for b in chr(char).encode()))


def arcs(p: Pieces, chars: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Of equally long words (rows of code points): for each (start, end) the rows and numbers of pieces there."""
    n = chars.shape[1]
    codes = chars.astype(np.uint64) + np.uint64(1)
    out = {}
    for i in range(n):
        h = np.zeros(len(chars), np.uint64)
        for j in range(i + 1, min(n, i + p.longest) + 1):
            h = h * BASE + codes[:, j - 1]
            ids = p.find(h)
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                out[i, j] = rows, ids[rows]
    return out


def bare(p: Pieces, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position the rows whose character has no piece of its own, and those characters."""
    known = p.find(np.unique(chars).astype(np.uint64) + np.uint64(1)) >= 0
    missing = np.unique(chars)[~known]
    return [(r := np.flatnonzero(np.isin(chars[:, i], missing)), chars[r, i]) for i in range(chars.shape[1])] if len(missing) else []


def log_probabilities(p: Pieces, chars: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None, gains: np.ndarray | None = None) -> np.ndarray:
    """Natural-log marginal of each word (rows of code points). With ``counts`` the expected uses of each piece,
    times the word's count, are added to ``gains``."""
    n, length = chars.shape
    got, odd = arcs(p, chars), bare(p, chars)
    ends: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]] = [[] for _ in range(length + 1)]
    for (i, j), (rows, ids) in got.items():
        ends[j].append((i, rows, weights[ids], ids))
    for i, (rows, codes) in enumerate(odd):
        if len(rows):
            cost = {c: spelled(p, weights, c) for c in set(codes.tolist())}
            ends[i + 1].append((i, rows, np.array([cost[c] for c in codes.tolist()]), None))
    forward = np.full((length + 1, n), -np.inf)
    forward[0] = 0
    for j in range(1, length + 1):
        for i, rows, w, _ in ends[j]:
            forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + w)
    if counts is not None:
        backward = np.full((length + 1, n), -np.inf)
        backward[length] = 0
        starts: list[list] = [[] for _ in range(length)]
        for j in range(1, length + 1):
            for i, rows, w, ids in ends[j]:
                starts[i].append((j, rows, w, ids))
        for i in range(length - 1, -1, -1):
            for j, rows, w, ids in starts[i]:
                ahead = w + backward[j, rows]
                share = counts[rows] * np.exp(forward[i, rows] + ahead - forward[length, rows])
                if ids is None:
                    for c, s in zip(chars[rows, i].tolist(), share.tolist(), strict=True):
                        for b in chr(c).encode():
                            gains[p.bytes[b]] += s
                else:
                    gains += np.bincount(ids, share, len(gains)) if len(ids) > 2000 else 0
                    if len(ids) <= 2000:
                        np.add.at(gains, ids, share)
                backward[i, rows] = np.logaddexp(backward[i, rows], ahead)
    return forward[length]


def long_log_probability(p: Pieces, word: str, weights: np.ndarray, count: float = 0, gains: np.ndarray | None = None) -> float:
    """As above for one word of any length."""
    n, get = len(word), p.names.get
    ways: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 1, min(n, i + p.longest) + 1):
            if (k := get(word[i:j])) is not None:
                ways[j].append((i, float(weights[k]), (k,)))
        if word[i] not in p.names:
            ks = tuple(p.bytes[b] for b in word[i].encode())
            ways[i + 1].append((i, float(sum(weights[k] for k in ks)), ks))
    forward = [0.0] + [-np.inf] * n
    for j in range(1, n + 1):
        x = [forward[i] + w for i, w, _ in ways[j]]
        top = max(x)
        forward[j] = top + log(sum(np.exp(v - top) for v in x))
    if gains is not None:
        backward = [-np.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, w, ks in ways[j]:
                ahead = w + backward[j]
                share = count * np.exp(forward[i] + ahead - forward[n])
                for k in ks:
                    gains[k] += share
                backward[i] = np.logaddexp(backward[i], ahead)
    return forward[n]


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray | None]]:
    """Positions of equally long words with their code points, the mark first; None for long words."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(min(len(w), LONG + 1), []).append(k)
    for length, group in groups.items():
        if length > LONG:
            yield group, None
            continue
        for s in range(0, len(group), 1 << 15):
            part = group[s : s + (1 << 15)]
            text = "".join([MARK + words[k] for k in part])
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), length + 1)


def word_log_probabilities(p: Pieces, words: list[str], weights: np.ndarray, counts: np.ndarray | None = None, gains: np.ndarray | None = None) -> np.ndarray:
    out = np.empty(len(words))
    with np.errstate(over="ignore", invalid="ignore"):
        for group, chars in by_length(words):
            if chars is None:
                for k in group:
                    out[k] = long_log_probability(p, MARK + words[k], weights, 0 if counts is None else counts[k], gains)
            else:
                out[group] = log_probabilities(p, chars, weights, None if counts is None else counts[group], gains)
    return out


def log_weights(p: Pieces, amounts: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(amounts / amounts.sum())


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: only A-Z, and only the six ASCII white-space characters


def count_words(src: DataFrame) -> DataFrame:
    """word, n (all texts), c (training texts). ``src``: text, held_out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(held[0].keys() | held[1].keys())
            c = [held[0][w] for w in words]
            n = [a + held[1][w] for a, w in zip(c, words, strict=True)]
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["word", "n", "c"])

        size = 0
        for batch in by_bytes(batches, "text"):
            for text, out_of in zip(texts_of(batch, "text"), batch.column("held_out").to_pylist(), strict=True):
                held[out_of].update(words_of(text))
            size += batch.nbytes
            if len(held[0]) + len(held[1]) > 400_000 or size > 128 << 20:  # words may be long
                yield out()
                size = 0
        yield out()

    return src.select("text", "held_out").mapInArrow(count, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, path: str, ends: int, rounds: int) -> np.ndarray:
    """Log weights of all pieces after ``rounds`` of expectation-maximization over the training words. Each task
    sends at most one sum a piece."""
    p = pieces(path)
    amounts = p.first
    spark = words.sparkSession
    for _ in range(rounds if ends else 0):
        weights = spark.sparkContext.broadcast(log_weights(p, amounts))

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            own, gains = pieces(path), np.zeros(pieces(path).size)
            for batch in gathered(batches, BULK):
                word_log_probabilities(own, batch.column("word").to_pylist(), weights.value, batch.column("c").to_numpy().astype(float), gains)
            used = np.flatnonzero(gains)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(gains[used])], names=["piece", "uses"])

        sums = words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        amounts = np.where(p.usable, 0.1, 0.0)
        for r in sums:
            amounts[r.piece] += r.uses
        amounts[p.end] += ends
    return log_weights(p, amounts)


def score_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, rounds: int = 2, hot: int = 50_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    src = as_pairs(df, id_col, text_col).select("doc_id", "text", (id_hash(F.col("doc_id")) % folds == fold).alias("held_out"))
    counted = staged(count_words(src), "words")
    ends = src.filter("not held_out").count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = total + ends, distinct + (ends > 0)
    fitted = fit_pieces(counted, model_path, ends, rounds)
    weights = spark.sparkContext.broadcast(fitted)
    end = float(fitted[pieces(model_path).end]) / LN10

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BULK):
            lp = word_log_probabilities(pieces(model_path), batch.column("word").to_pylist(), weights.value) / LN10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), batch.column("c"), pa.array(lp, pa.float64())], names=["word", "n", "c", "lp"])

    rated = staged(counted.mapInArrow(rate, "word string, n long, c long, lp double"), "rated")
    discard(counted)
    top = most_frequent(rated, hot).filter(F.octet_length("word") <= 64).collect()  # a fixed bound in rows and bytes
    known = spark.sparkContext.broadcast({r.word.encode(): (r.c > 0, float(np.log10(r.c + 1)), r.lp) for r in top})
    id_type = src.schema["doc_id"].dataType.simpleString()
    tail_type = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int32())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in by_bytes(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                words = words_of(text)
                found, base, score, tail = 0, 0.0, 0.0, []
                for w, tf in Counter(words).items():
                    hit = get(w)
                    if hit is None:
                        tail.append({"word": w.decode(), "tf": tf})
                    else:
                        found += tf * hit[0]
                        base += tf * hit[1]
                        score += tf * hit[2]
                rows.append((len(words) + 1, found, base, score, tail))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], tail_type)],
                names=["doc_id", "held_out", "n_tokens", "found", "base", "score", "tail"],
            )

    docs = staged(src.mapInArrow(split, f"doc_id {id_type}, held_out boolean, n_tokens long, found long, base double, score double, tail array<struct<word: string, tf: int>>").withColumn("row", F.monotonically_increasing_id()), "texts")
    tail = docs.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.tf").alias("tf"))
    rest = (
        tail.join(rated.select("word", "c", "lp"), "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_found"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_base"), F.sum(F.col("tf") * F.col("lp")).alias("tail_score"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    below = float(np.log10(n + 1 * (v + 1)))
    return docs.drop("tail").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + zero("tail_found") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base") + float(np.log10(ends + 1)) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + zero("tail_score") + end).alias("score"),
    )
