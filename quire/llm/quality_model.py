"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network with
temperature-calibrated probabilities.

A token is a run of letters, of digits or of other visible characters. The ``vocabulary`` tokens that occur in most
documents stand for themselves (if they are in three at least and of at most ``LONGEST`` characters), all others for
their shape, of which there are some dozens: the case and length of letters, the first character of symbols if it is
ASCII. A token's vector is its own sparse ternary index vector plus those of its neighbours, summed over all
documents, labelled or not: tasks count documents per token, then sum neighbours per token, and both are whole
numbers, so the vectors don't depend on how the rows are dealt. A document is the mean of
its tokens' vectors with its length, its shares of distinct tokens, of repeated
lines, of repeated three-token runs and of tokens that repeat the one before.

Only the network is fitted to a sample: at most ``sample`` labelled rows of at most ``sample_bytes`` in sum (documented
bounds: those with the smallest hash of the id; where ids repeat, one row of each; a text that would exceed the
bytes is passed over), a fifth of which only stops the fit and sets the temperature. So the driver holds
``sample_bytes`` of text and ``vocabulary`` vectors at most, and a task ``vocabulary`` squared counts, whatever the
table holds.

Null and empty texts are scored as documents without tokens. Without two classes among the training labels
every score is the share of label 1 (0.5 without labels). Labels with a null id or value are ignored. Repeated rows count each
in the statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_pairs, by_bytes, column, discard, filtered, id_hash, most_frequent, staged, texts_of

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
WIDTH, NONZERO, WINDOW, EXTRA = 64, 8, 2, 5
#: Characters of the longest token that may stand for itself; tokens that a task counts or remembers at once, and of how
#: many bytes of text it counts them.
LONGEST, HELD, HELD_BYTES = 64, 200_000, 64 << 20


#: What a token outside the vocabulary is taken for; a fixed set, whatever the texts hold.
SHAPES = ["<9>", "<other>", *(f"<{c}>" for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), *(f"<{kind}{n}>" for kind in ("A", "Aa", "a") for n in range(5))]


def shape(token: str) -> str:
    if token.isdigit():
        return "<9>"
    if not token[0].isalpha():
        return f"<{token[0]}>" if token[0].isascii() else "<other>"
    kind = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
    return f"<{kind}{min(len(token) // 4, 4)}>"


def index_vector(token: str) -> np.ndarray:
    """Sparse and ternary, from the token alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token.encode()))
    out = np.zeros(WIDTH, np.float32)
    out[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def frequent_tokens(src: DataFrame, size: int) -> list[str]:
    """The tokens that occur in most texts of ``src`` (a column text), as many whole steps of ``most_frequent`` as fit
    beside the shapes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            own = {t: n for t, n in held.items() if len(t) <= LONGEST}
            return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], names=["token", "n"])

        for batch in by_bytes(batches, "text"):
            for text in texts_of(batch, "text"):
                held.update(set(TOKEN.findall(text)))
            size += batch.nbytes
            if len(held) > HELD or size > HELD_BYTES:
                yield out()
                held.clear()
                size = 0
        yield out()

    counted = staged(src.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 3"), "tokens")
    top = most_frequent(counted, max(0, size - len(SHAPES))).collect()  # at most ``size`` tokens
    discard(counted)
    return [r.token for r in sorted(top, key=lambda r: (-r.n, r.token))]


def ids_of(tokens: list[str]) -> dict[str, int]:
    """Shapes are always in, as rows of their own."""
    return {t: i for i, t in enumerate(dict.fromkeys([*SHAPES, *tokens]))}


class Rows(dict):
    """The row of any token; that after the last, of no vector, if there is none even for its shape. Tokens outside the
    vocabulary are remembered until they are too many."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self.ids = ids

    def __reduce__(self):
        return Rows, (self.ids,)

    def __missing__(self, token: str) -> int:
        row = self.ids.get(shape(token), len(self.ids))
        if len(token) <= LONGEST:
            if len(self) > HELD + len(self.ids):
                self.clear()
                self.update(self.ids)
            self[token] = row
        return row

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), "<u2" if len(self.ids) < 1 << 16 else "<u4", len(tokens))


def measures(text: str, tokens: list[str]) -> tuple[float, ...]:
    """What a document is judged by beside its vector; zeros without tokens."""
    if not tokens:
        return (0.0,) * EXTRA
    lines = [x for x in text.split("\n") if x.strip()]
    grams = len(tokens) - 2
    runs = 1 - len(set(zip(tokens, tokens[1:], tokens[2:], strict=False))) / grams if grams > 0 else 0.0
    return float(np.log1p(len(tokens))), len(set(tokens)) / len(tokens), 1 - len(set(lines)) / max(len(lines), 1), runs, sum(map(eq, tokens, tokens[1:])) / len(tokens)


def encode(texts: list[str], rows: Rows) -> tuple[list[np.ndarray], list[tuple[float, ...]]]:
    tokens = [TOKEN.findall(text) for text in texts]
    return [rows.of(t) for t in tokens], list(map(measures, texts, tokens))


def encoded(src: DataFrame, ids: dict[str, int]) -> DataFrame:
    """``src`` (doc_id, text) as doc_id, rows (little-endian) and measures, written once and read by what follows."""
    shared = src.sparkSession.sparkContext.broadcast(Rows(ids))  # ``vocabulary`` entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows, extra = encode(texts_of(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(extra, pa.list_(pa.float64()))], names=["doc_id", "rows", "measures"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return staged(src.mapInArrow(run, f"doc_id {kind}, rows binary, measures array<double>"), "encoded", compression="zstd")


def rows_in(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The rows of an encoded batch, for ``n`` vectors."""
    return [np.frombuffer(r, "<u2" if n < 1 << 16 else "<u4") for r in batch.column("rows").to_pylist()]


class Neighbours:
    """How often which token follows which within the window, for ``n`` tokens."""

    def __init__(self, n: int):
        self.n, self.together = n, np.zeros(n * n, np.int32)

    def add(self, texts: list[np.ndarray]) -> None:
        between = np.full(WINDOW, self.n)  # no window reaches the next text
        flat = np.concatenate([part for rows in texts for part in (rows, between)]).astype(np.int64)
        for o in range(1, WINDOW + 1):
            a, b = flat[:-o], flat[o:]
            ok = (a < self.n) & (b < self.n)
            pairs, times = np.unique(a[ok] * self.n + b[ok], return_counts=True)
            self.together[pairs] += times.astype(np.int32)

    def sums(self, index: np.ndarray) -> np.ndarray:
        """The index vectors of each token's neighbours on both sides, summed: whole numbers. Only pairs that occur and the few
        places of an index vector that aren't 0 are looked at."""
        at = np.flatnonzero(self.together)
        times = self.together[at]
        out = np.zeros(self.n * WIDTH)
        places = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        signs = np.take_along_axis(index, places, axis=1)
        for own, other in ((at // self.n, at % self.n), (at % self.n, at // self.n)):
            for k in range(NONZERO):
                out += np.bincount(own * WIDTH + places[other, k], times * signs[other, k], self.n * WIDTH)
        return out.reshape(self.n, WIDTH).astype(np.int64)


def neighbour_sums(table: DataFrame, index: np.ndarray) -> np.ndarray:
    """``Neighbours.sums`` over all documents of an encoded table."""
    shared, n = table.sparkSession.sparkContext.broadcast(index), len(index)  # ``vocabulary`` rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in by_bytes(batches, "rows"):
            found = found or Neighbours(n)
            found.add(rows_in(batch, n))
        if found is not None:
            sums = found.sums(shared.value)
            used = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(sums[used, i]) for i in range(WIDTH))], names=["id", *(f"v{i}" for i in range(WIDTH))])

    own = table.select("rows").mapInArrow(add, "id long" + "".join(f", v{i} long" for i in range(WIDTH)))
    got = own.groupBy("id").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH))).collect()  # ``vocabulary`` rows
    out = np.zeros((n, WIDTH), np.int64)
    for r in got:
        out[r[0]] = r[1:]
    return out


def vectors_of(index: np.ndarray, sums: np.ndarray) -> np.ndarray:
    context = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    return (index / np.sqrt(NONZERO) + context).astype(np.float32)


def word_vectors(src: DataFrame, size: int) -> tuple[dict[str, int], np.ndarray, DataFrame]:
    """Rows and vectors of the tokens of all texts of ``src`` (doc_id, text), and its encoded table."""
    ids = ids_of(frequent_tokens(src.select("text"), size))
    index = np.stack([index_vector(t) for t in ids])
    table = encoded(src, ids)
    return ids, vectors_of(index, neighbour_sums(table, index)), table


def features(rows: list[np.ndarray], measured: list[tuple[float, ...]], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH + EXTRA))
    n = len(vectors)
    wide = np.vstack([vectors, np.zeros((1, WIDTH), np.float32)])  # the last row is of no token
    for k, own in enumerate(rows):
        if not len(own):
            continue
        if len(own) <= n:
            total = wide[own].sum(axis=0, dtype=np.float64)
        else:  # a long text has no more rows than there are vectors
            total = np.bincount(own, minlength=n + 1).astype(np.float64) @ wide
        out[k, :WIDTH] = total / len(own)
    if len(rows):
        out[:, WIDTH:] = measured
    return out


class Network:
    """Two layers; ``fit`` is deterministic."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.w1 = prior, None

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 7) -> Network:
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(y) < 10 or self.prior in (0.0, 1.0):
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, p)
        # both classes weigh the same while learning to rank; calibration comes after
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                h = np.maximum(x[part] @ p[0] + p[1], 0)
                g = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[part]) / len(part)
                gh = np.outer(g, p[2]) * (h > 0)
                grads = [x[part].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for a, b, c, d in zip(p, m, v, grads, strict=True):
                    b += 0.1 * (d - b)
                    c += 0.001 * (d * d - c)
                    a -= 0.003 * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(p, x[held], y[held], 1.0)
            if loss < best[0]:
                best = (loss, [a.copy() for a in p])
        self.w1, self.b1, self.w2, self.b2 = best[1]
        grid = np.exp(np.linspace(-2, 2, 81))
        self.temperature = float(grid[np.argmin([self._loss(best[1], x[held], y[held], t) for t in grid])])
        return self

    @staticmethod
    def _loss(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, t: float) -> float:
        z = (np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3][0]) / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        x = (x - self.mean) / self.scale
        z = (np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(labelled: pd.DataFrame, ids: dict[str, int], vectors: np.ndarray) -> Network:
    """``labelled``: text, label (0 or 1), in a fixed order."""
    x = features(*encode([t or "" for t in labelled["text"]], Rows(ids)), vectors)
    return Network().fit(x, labelled["label"].to_numpy(np.float64))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 1, folds: int = 3, sample: int = 6000, vocabulary: int = 4096, sample_bytes: int = 64 << 20):
    """A broadcast model, word vectors of all rows and a network fitted to labelled rows outside the held-out fold; and the
    encoded table of ``df``."""
    known = labels.select(column(id_col).alias("of"), column(label_col).alias("label")).filter(F.col("of").isNotNull() & F.col("label").isin(0, 1) & (id_hash(F.col("of")) % folds != fold))
    known = known.groupBy("of").agg(F.max("label").cast("int").alias("label"))
    order = F.xxhash64(F.col("of").cast("string"))
    # a sort with a limit sends that many rows from each task, so what can't be among the smallest goes before
    share = min(1.0, (1.2 * sample + 500) / max(known.count(), 1))
    likely = known.filter(order <= F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1))
    chosen = likely.orderBy(order, "of").limit(sample)  # bounded, so it can be broadcast
    # of a repeated id the row of the smallest hash of the text, so no id displaces others
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"), "text")).alias("least")
    found = staged(as_pairs(df, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("of", "label").agg(least).select("of", order.alias("place"), "least.text", "least.bytes", "label"), "sample")
    fits, held = [], 0
    for r in found.select("of", "place", "bytes").orderBy("place", "of").collect():  # at most ``sample`` rows
        if held + (r.bytes or 0) <= sample_bytes:
            fits.append((r.of,))
            held += r.bytes or 0
    own = df.sparkSession.createDataFrame(fits, found.select("of").schema)
    rows = found.join(F.broadcast(own), "of").select("of", "text", "label", "place").orderBy("place", "of")
    ids, vectors, table = word_vectors(as_pairs(df, id_col, text_col), vocabulary)
    network = fit(rows.toPandas(), ids, vectors)
    discard(found)
    return df.sparkSession.sparkContext.broadcast((Rows(ids), vectors, network)), table


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 1, folds: int = 3, sample: int = 6000, vocabulary: int = 4096, sample_bytes: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model, table = train(df, labels, id_col, text_col, label_col, fold, folds, sample, vocabulary, sample_bytes)
    src = table.select("doc_id", (id_hash(F.col("doc_id")) % folds == fold).alias("held_out"), "rows", "measures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vectors, network = model.value
        for batch in by_bytes(batches, "rows"):
            s = network.scores(features(rows_in(batch, len(vectors)), batch.column("measures").to_pylist(), vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_likely(df: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, fold: int = 1, folds: int = 3, vocabulary: int = 4096, sample_bytes: int = 64 << 20, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` with a score of at least ``least``, with their columns. The model learns from the labelled rows
    of ``learn_from`` (``df`` itself if not given): what a stage before has kept may lack one of the classes."""
    model, table = train(df if learn_from is None else learn_from, labels, id_col, text_col, label_col, fold, folds, sample, vocabulary, sample_bytes)
    discard(table)

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        rows, vectors, network = model.value  # a worker keeps the rows it has found
        for batch in by_bytes(batches, text):
            yield batch.filter(pa.array(network.scores(features(*encode(texts_of(batch, text), rows), vectors)) >= least))

    return filtered(df, text_col, run)
