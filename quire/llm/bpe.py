"""BPE encoding and decoding with a lexicon of frequent words and exact merges for all others.

Words of the corpus are counted over all texts; the most frequent ones are merged once and compiled into a
minimal acyclic transducer (``lexicon.py``), which is written to the shared folder and memory-mapped by each
Python worker. Words outside it are merged by rank, many words of one length at a time, which gives the
same ids as merging the leftmost pair of lowest rank again and again. ``frequent`` bounds the lexicon and
has no influence on the result.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_pairs, by_bytes, discard, filesystem, fresh_dir, most_frequent, staged, texts_of
from quire.llm.lexicon import EMPTY, Lexicon, PairTable, compile_words

#: The characters that the library's \s matches; Python's split() adds U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT_ON, ODD = regex.compile(f"[{SPACE}]+"), regex.compile("[\x1c-\x1f]")
#: Entries that a worker keeps between batches.
KEPT = 150_000
#: Bytes of chunks and their ids that are kept between calls, and of text that is counted before counts leave a task.
KEPT_BYTES, COUNTED_BYTES = 48 << 20, 128 << 20
#: Words of more bytes are merged one at a time.
LONG = 256
#: Of each byte: 0 parts chunks, 1 a letter, 2 a digit, 3 anything else.
CLASSES = np.array([0 if b == 0x0A else 1 if chr(b).islower() and b < 0x80 else 2 if 0x30 <= b <= 0x39 else 3 for b in range(256)], np.uint8)
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for themselves, the others
    follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: normalizer, split by a pattern, byte-level BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.normalizer = Tokenizer.from_file(path).normalizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's \s is Unicode white space, which the regex module's isn't in every point
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = np.array([vocab[c] for c in letters], np.uint32)
        self.outer = np.array([vocab[c + end] for c in letters], np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        if max(self.names) >= 1 << 16:
            raise ValueError("two ids share 32 bits here, so a vocabulary has at most 65,536 entries")
        self.long_pairs: dict[int, int] = {}
        self.made = np.array([vocab[a + b] for a, b in merges] + [0], np.uint32)
        keys, first = np.unique(keys, return_index=True)
        self.merges = PairTable.build(keys, first.astype(np.uint32))

    def merge(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of equally long words (rows of bytes): which rows, and their ids, one row each."""
        n, length = words.shape
        if length > LONG:
            for row in range(n):
                yield np.array([row]), self.merge_long(words[row])[None, :]
            return
        ids = self.inner[words]
        ids[:, -1] = self.outer[words[:, -1]]
        rows = np.arange(n)
        ranks = self.merges.find((ids[:, :-1] << np.uint32(16) | ids[:, 1:]).ravel()).reshape(n, length - 1)
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best != EMPTY
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            each = np.arange(len(rows))
            ids[each, at] = self.made[best]
            columns = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            if ids.shape[1] > 1:
                columns = columns[:, :-1]
                ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < ranks.shape[1])
                    r, c = each[ok], side[ok]
                    ranks[r, c] = self.merges.find(ids[r, c] << np.uint32(16) | ids[r, c + 1])

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """One word of any length: a heap of pairs by rank and place over a linked list, n log n."""
        ids = self.inner[word].tolist()
        ids[-1] = int(self.outer[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        left = np.array(ids[:-1], np.uint32) << np.uint32(16) | np.array(ids[1:], np.uint32)
        heap = [(int(r), i, int(k)) for i, (r, k) in enumerate(zip(self.merges.find(left), left, strict=True)) if r != EMPTY]
        heapq.heapify(heap)
        pairs = self.long_pairs
        if len(pairs) > KEPT:
            pairs.clear()

        def push(i: int) -> None:
            j = after[i]
            if j >= 0:
                k = ids[i] << 16 | ids[j]
                r = pairs.get(k)
                if r is None:
                    r = pairs[k] = int(self.merges.find(np.array([k], np.uint32))[0])
                if r != EMPTY:
                    heapq.heappush(heap, (r, i, k))

        while heap:
            r, i, k = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] << 16 | ids[j] != k:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([i for i in ids if i >= 0], np.uint32)

    def chunks(self, text: str) -> list[str]:
        return [c for c in SPLIT_ON.split(text) if c] if ODD.search(text) else text.split()

    def words_of(self, chunks: list[str]) -> list[list[str]]:
        """The words of each distinct chunk. No normalization reaches over white space, so all chunks
        are normalized in one call."""
        if not chunks:
            return []
        out, find = [], self.pattern.findall
        for c in self.normalizer.normalize_str("\n".join(chunks)).split(" "):
            # letters, or letters and one mark, which the pattern would cut the same way
            out.append([c] if c.isalpha() else [c[:-1], c[-1]] if c[:-1].isalpha() and not c[-1].isnumeric() else find(c))
        return out

    def byte_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, lengths, chunk numbers) of the words of non-empty chunks. ASCII without apostrophes is cut
        by character class, as the pattern does; other chunks go through the pattern."""
        easy = np.array([c.isascii() and "'" not in c for c in chunks], bool)
        where, odd = np.flatnonzero(easy), np.flatnonzero(~easy).tolist()
        plain = chunks if not odd else [chunks[i] for i in where.tolist()]
        data = np.frombuffer(("\n".join(plain) + "\n").lower().encode(), np.uint8) if plain else np.zeros(0, np.uint8)
        kind = CLASSES[data]
        before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
        start = (kind != 0) & ((kind != before) | (kind == 2))
        bounds = np.flatnonzero(start | (kind == 0))
        first = start[bounds]
        starts = bounds[first]
        lengths = np.append(bounds[1:], len(data))[first] - starts
        owner = where[np.cumsum(kind == 0)[starts]]
        if not odd:
            return data, starts, lengths, owner
        own = [(w.encode(), k) for k, ws in zip(odd, self.words_of([chunks[i] for i in odd]), strict=True) for w in ws]
        sizes = np.array([len(w) for w, _ in own], np.int64)
        more = np.frombuffer(b"".join(w for w, _ in own), np.uint8)
        at = np.cumsum(sizes) - sizes + len(data)
        every = np.concatenate([owner, np.array([k for _, k in own], np.int64)])
        order = np.argsort(every, kind="stable")
        return np.concatenate([data, more]), np.concatenate([starts, at])[order], np.concatenate([lengths, sizes])[order], every[order]


def encode_words(bpe: WordBpe, lexicon: Lexicon | None, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each) of words given as parts of ``data``."""
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(starts), np.int64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        length = int(lengths[order[a]])
        step = max(1, (1 << 22) // length)
        for k in range(a, b, step):
            words = order[k : min(b, k + step)]
            rows = data[starts[words][:, None] + np.arange(length)]
            rank = lexicon.ranks(rows) if lexicon else np.full(len(words), -1)
            known = np.flatnonzero(rank >= 0)
            if len(known):
                lo = lexicon.offsets[rank[known]].astype(np.int64)
                sizes = lexicon.offsets[rank[known] + 1].astype(np.int64) - lo
                for n in np.unique(sizes).tolist():
                    same = sizes == n
                    pieces.append((words[known[same]], lexicon.ids[lo[same][:, None] + np.arange(n)]))
            new = np.flatnonzero(rank < 0)
            if len(new):
                pieces.extend((words[new[r]], ids) for r, ids in bpe.merge(rows[new]))
    for words, ids in pieces:
        counts[words] = ids.shape[1]
    base = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), "<u4")
    for words, ids in pieces:
        flat[base[words][:, None] + np.arange(ids.shape[1])] = ids
    return flat, counts


class Encoder:
    """Encodes texts of a worker; remembers recent chunks."""

    def __init__(self, path: str, lexicon_uri: str | None):
        self.bpe = WordBpe(path)
        self.lexicon = Lexicon.open(lexicon_uri) if lexicon_uri else None
        self.names = [self.bpe.names[i].encode() for i in range(len(self.bpe.names))]
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, chunks: list[str]) -> None:
        data, starts, lengths, owner = self.bpe.byte_words(chunks)
        flat, counts = encode_words(self.bpe, self.lexicon, data, starts, lengths)
        ends = 4 * np.cumsum(np.bincount(owner, counts, len(chunks)).astype(np.int64))
        ids = flat.tobytes()
        self.size += len(ids) + sum(map(len, chunks))
        at = ends.tolist()
        self.known.update(zip(chunks, [ids[i:j] for i, j in zip([0, *at], at, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian uint32 and the decoded text in UTF-8."""
        bpe, special, known = self.bpe, self.bpe.special, self.known
        split: list[list[str]] = []
        for text in texts:
            if "<|" in text and len(parts := bpe.special_split.split(text)) > 1:
                split.append([c for k, p in enumerate(parts) for c in ((p,) if k % 2 else bpe.chunks(p))])
            else:
                split.append(bpe.chunks(text))
        all_chunks = set().union(*split)
        new = all_chunks - known.keys()
        if len(known) + len(new) > KEPT or self.size > KEPT_BYTES:
            known.clear()
            self.size = 0
            new = all_chunks
        marks = new & special.keys()
        self.learn(list(new - marks))
        for m in marks:
            known[m] = np.array([special[m]], "<u4").tobytes()
        name = self.names.__getitem__
        for chunks in split:
            ids = b"".join([known[c] for c in chunks])
            yield ids, b" ".join(map(name, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def encoder(path: str, lexicon_uri: str | None) -> Encoder:
    return Encoder(path, lexicon_uri)


def frequent_words(df: DataFrame, text_col: str, n: int) -> list[bytes]:
    """At most ``n`` of the most frequent runs of letters (lower-case ASCII, and any bytes from 0x80) over all
    texts; counts are summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        size = 0
        for batch in by_bytes(batches, "text"):
            for text in texts_of(batch, "text"):
                held.update(text.encode().translate(LETTERS).split())
            size += batch.nbytes
            if len(held) > 400_000 or size > COUNTED_BYTES:
                yield out()
                size = 0
        yield out()

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    words = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = [bytes(r.word) for r in most_frequent(words, n).select("word").collect()]
    discard(words)
    return top


def build_lexicon(df: DataFrame, tokenizer_path: str, text_col: str = "text", frequent: int = 50_000) -> str:
    """Counts, merges and compiles the frequent words; returns the URI of the file in the shared folder."""
    words = sorted(frequent_words(df, text_col, frequent))
    sizes = np.array([len(w) for w in words], np.int64)
    flat, counts = encode_words(WordBpe(tokenizer_path), None, np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    data = compile_words((w, tuple(ids.tolist())) for w, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1]) if words else [], strict=True))
    uri = fresh_dir(df.sparkSession, "lexicon")
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/words.tmp") as f:
        f.write(data)
    store.move(f"{path}/words.tmp", f"{path}/words.lexicon")
    return f"{uri}/words.lexicon"


def bpe_encode(df: DataFrame, tokenizer_path: str, lexicon_uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = 50_000) -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded (string)."""
    uri = lexicon_uri or build_lexicon(df, tokenizer_path, text_col, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, uri)
        for batch in by_bytes(batches, "text"):
            got = list(enc.encode(texts_of(batch, "text")))
            ends = np.cumsum([0, *(len(a) // 4 for a, _ in got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(a for a, _ in got), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([d.decode() for _, d in got], pa.string())], names=["doc_id", "ids", "decoded"])

    src = as_pairs(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_digests(df: DataFrame, tokenizer_path: str, lexicon_uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = 50_000) -> DataFrame:
    """As ``bpe_encode``, but only n_tokens and the SHA-256 of ids and decoded text leave the workers."""
    uri = lexicon_uri or build_lexicon(df, tokenizer_path, text_col, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, uri)
        for batch in by_bytes(batches, "text"):
            n, a, b = [], [], []
            for ids, shown in enc.encode(texts_of(batch, "text")):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(shown).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = as_pairs(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
