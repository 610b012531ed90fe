"""Token counts: texts are encoded in Arrow functions that return lengths only.

Batches are balanced by bytes. A long text is split where no piece of the vocabulary can span the cut:
before a space that follows something else, provided that no piece has a space mark after another
character (checked when the model is loaded; a model that has such pieces is never split). There the
merges on both sides are independent, and the space is what the library's own prefix puts back.

Null and empty texts have no tokens. Repeated rows are counted each. Ids may be null or repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import as_pairs, by_bytes, texts_of

MARK = "▁"
#: A space with neither a space nor a space mark before it, and with something else after it.
SAFE = re.compile(rf"(?<=[^ {MARK}]) (?=[^ {MARK}])")


@lru_cache(2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = all(MARK not in p.lstrip(MARK) for p in pieces) and model.encode("a b") == model.encode("a") + model.encode("b")
    return model, plain


def split_safely(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters, cut at the first safe space after that many."""
    parts, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_batch(texts: list[str], path: str, part_chars: int, batch_bytes: int) -> list[int]:
    model, plain = load(path)
    counts = [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, ids in zip(owners, model.encode(parts, num_threads=1), strict=True):
            counts[owner] += len(ids)
        parts.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in split_safely(text, part_chars) if plain and len(text) > part_chars else (text,):
            if part:
                parts.append(part)
                owners.append(i)
                held += len(part.encode())
                if held >= batch_bytes:
                    flush()
    flush()
    return counts


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, part_chars: int = 4096, batch_bytes: int = 1 << 19) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = texts_of(batch, "text")
            counts = count_batch(texts, model_path, part_chars, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    src = as_pairs(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
