"""All places where entries of a lexicon stand in texts, by an Aho-Corasick automaton in flat arrays.

A text is read once, whatever the entries' lengths. Long texts are cut into pieces that overlap by the longest entry
less one, and all pieces of a block of rows move on by one character together, so numpy does the work of each step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Characters of a piece, at least, and characters of text that are scanned at once.
PIECE, BLOCK = 512, 1 << 20
_SHIFT = 21  # code points have 21 bits


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Automaton:
    """States of the trie of ``entries`` (not empty, all different), numbered by depth; 0 is the root.

    ``edges``: sorted (state, character) keys and ``to``, where they lead. ``fail``: the state of the longest proper suffix.
    ``entry``: which entry a state ends, or -1. ``link``: the next state along ``fail`` that ends an entry, or 0.
    """

    def __init__(self, entries: Sequence[str]) -> None:
        self.entries = list(entries)
        self.length = np.array([len(e) for e in self.entries], np.int64)
        self.longest = int(self.length.max()) if len(self.entries) else 0
        chars = code_points("".join(self.entries))
        first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        at, live, states = np.zeros(len(self.entries), np.int64), np.arange(len(self.entries)), 1
        keys, self.entry = [], [np.array([-1])]
        levels = []
        for depth in range(self.longest):
            live = live[self.length[live] > depth]
            key, place = np.unique((at[live] << _SHIFT) | chars[first[live] + depth], return_inverse=True)
            at[live] = states + place
            ends = np.full(len(key), -1)
            done = live[self.length[live] == depth + 1]
            ends[at[done] - states] = done
            keys.append(key)
            levels.append((states, states + len(key)))
            self.entry.append(ends)
            states += len(key)
        self.edges = np.concatenate([*keys, np.zeros(0, np.int64)])  # parents grow with depth, so keys are sorted
        self.to = np.arange(1, states)
        self.entry = np.concatenate(self.entry)
        self.fail, self.link = np.zeros(states, np.int64), np.zeros(states, np.int64)
        for nth, (a, b) in enumerate(levels):
            if nth:
                parent, char = keys[nth] >> _SHIFT, keys[nth] & ((1 << _SHIFT) - 1)
                self.fail[a:b] = self.step(self.fail[parent], char)
                suffix = self.fail[a:b]
                self.link[a:b] = np.where(self.entry[suffix] >= 0, suffix, self.link[suffix])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where each (state, character) leads, along failures where a state has no such child."""
        out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_) and len(self.edges):
            key = (state[open_] << _SHIFT) | char[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & (state[open_] > 0)]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return out

    def places(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, end, entry) of every place; a null text has none."""
        texts = [t or "" for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        chars, offset = code_points("".join(texts)), np.concatenate([[0], np.cumsum(sizes)])
        none = np.zeros(0, np.int64)
        if not self.longest or not len(chars):
            return none, none, none
        width = max(PIECE, self.longest)
        count = -(-sizes // width)
        row = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        own = offset[row] + nth * width
        start = np.maximum(own - (self.longest - 1), offset[row])
        stop = np.minimum(own + width, offset[row + 1])
        order = np.argsort(start - stop, kind="stable")
        row, own, start, length = row[order], own[order], start[order], (stop - start)[order]
        state, found = np.zeros(len(row), np.int64), []
        moving = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        for t, n in enumerate(moving.tolist()):
            state[:n] = self.step(state[:n], chars[start[:n] + t])
            at = np.flatnonzero((start[:n] + t >= own[:n]) & ((self.entry[state[:n]] >= 0) | (self.link[state[:n]] > 0)))
            reached = state[at]
            while len(at):
                ends = self.entry[reached] >= 0
                found.append((row[at[ends]], start[at[ends]] + t + 1 - offset[row[at[ends]]], self.entry[reached[ends]]))
                reached = self.link[reached]
                at, reached = at[reached > 0], reached[reached > 0]
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))


def row_blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK`` bytes of text; a longer text is a slice of its own."""
    sizes = [len(t) if t else 0 for t in batch.column(column).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def match_batch(automaton: Automaton, batch: pa.RecordBatch, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """(id, start, end, text) of the places in a batch of rows."""
    for block in row_blocks(batch, text_col):
        row, end, entry = automaton.places(block.column(text_col).to_pylist())
        start = end - automaton.length[entry]
        texts = pa.array([automaton.entries[e] for e in entry.tolist()], pa.string())
        yield pa.record_batch([block.column(id_col).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), texts], names=["id", "start", "end", "text"])
