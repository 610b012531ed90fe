"""A minimal acyclic transducer from words to token ids, in flat arrays that can be memory-mapped.

Equal suffixes share states (sorted words are added one by one; a finished branch is replaced by an equal
registered one). Each transition holds the number of words that sort before those below it, so a walk adds
up to the word's rank, and the rank names its run of ids. Walks go over many words at once, byte by byte.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint32(0xFFFFFFFF)


class PairTable:
    """Open addressing from uint32 keys to uint32 values, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - (len(keys).bit_length() - 1))

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PairTable:
        bits = max(4, int(len(keys) * 4).bit_length())
        table = cls(np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.uint32))
        left = np.arange(len(keys))
        at = table.slots(keys)
        while len(left):
            free = table.keys[at[left]] == EMPTY
            first, where = np.unique(at[left[free]], return_index=True)
            won = left[free][where]
            table.keys[first], table.values[first] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (len(table.keys) - 1)
        return table

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values as uint32, EMPTY where a key isn't there."""
        at = self.slots(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], EMPTY)
        left = np.flatnonzero((got != keys) & (got != EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (got != EMPTY)]
        return out


def compile_words(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of sorted, distinct, non-empty words as one block of bytes."""
    words: list[bytes] = []
    offsets, ids = [0], []
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states: final, transitions (byte, state)

    def close(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            state = register.get(shape)
            if state is None:
                state = register[shape] = len(states)
                states.append(shape)
            if path:
                path[-1][1][-1] = (path[-1][1][-1][0], state)

    last = b""
    for word, out in entries:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same + 1)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        words.append(word)
        ids.extend(out)
        offsets.append(len(ids))
        last = word
    close(0)
    below = [0] * len(states)
    keys, targets, before = [], [], []
    for state, (final, arcs) in enumerate(states):  # a target always has a smaller number
        n = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            before.append(n)
            n += below[target]
        below[state] = n
    table = PairTable.build(np.array(keys, np.uint32), np.arange(len(keys), dtype=np.uint32))
    arrays = [table.keys, table.values, np.array(targets, np.uint32), np.array(before, np.uint32), np.array([f for f, _ in states], np.uint32), np.array(offsets, np.uint32), np.array(ids, np.uint32)]
    return np.array([len(a) for a in arrays], np.uint64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled automaton over a buffer, mapped from a local file or held in memory."""

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, np.uint64, 7).astype(int)
        arrays, at = [], 56
        for n in sizes:
            arrays.append(np.frombuffer(buffer, np.uint32, n, at))
            at += 4 * n
        keys, values, self.target, self.before, self.final, self.offsets, self.ids = arrays
        self.arcs = PairTable(keys, values)
        self.root = len(self.final) - 1

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        """Mapped where the shared folder is mounted; else read once into an anonymous map."""
        from quire.llm.common import filesystem

        store, path = filesystem(uri)
        if store.type_name == "local":
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with store.open_input_file(path) as f:
            data = f.read()
        held = mmap.mmap(-1, len(data))
        held.write(data)
        return cls(held)

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """``words``: bytes of equally long words, one per row. Ranks, -1 where a word isn't there."""
        n, length = words.shape
        rank = np.zeros(n, np.int64)
        if not len(self.target):
            return rank - 1
        state = np.full(n, self.root, np.uint32)
        alive = np.arange(n)
        for i in range(length):
            arc = self.arcs.find(state[alive] << np.uint32(8) | words[alive, i])
            ok = arc != EMPTY
            rank[alive[~ok]] = -1
            alive, arc = alive[ok], arc[ok]
            rank[alive] += self.before[arc]
            state[alive] = self.target[arc]
        ended = self.final[state[alive]] == 1
        rank[alive[~ended]] = -1
        return rank
