"""Weighted acyclic automata: sequences of words to counts, minimal and flat.

A state is the list of its arcs; an arc has a word, the count of the sequence
read so far (0: that sequence is not accepted) and the state it leads to.
States are made from sorted sequences, deepest first, and registered: equal ones
are one.  Words are numbers from 1 in byte order; 0 stands for "no word", so
sequences sort as they stand in a tree, each before what it begins.
"""

from __future__ import annotations

import bisect
import struct

import numpy as np

Columns = list[np.ndarray]  # one column of word numbers per place, 0 behind the end

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # odd factors (fixed values)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * _MIX[0]
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        out = (out ^ (out >> np.uint64(32))) * _MIX[2]
    return out


def sort_order(columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in sequence order, and where each new sequence begins in it."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        wide = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // wide:
            key = np.unique(key, return_inverse=True)[1]  # the order in fewer bits
        key = key * wide + column
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _register(starts: np.ndarray, word: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of each list of arcs, the lists that stay): lists with the same arcs are one state.

    Lists of the same hash are compared arc by arc; one that differs stays by itself.
    """
    size = np.diff(np.r_[starts, len(word)])
    place = np.arange(len(word)) - np.repeat(starts, size)
    found = np.add.reduceat(_mixed(word, weight, target, place), starts) + size.astype(np.uint64)
    _, first, same = np.unique(found, return_index=True, return_inverse=True)
    model = first[same]
    sized = size == size[model]
    at = np.repeat(np.where(sized, starts[model], starts), size) + place
    equal = (word == word[at]) & (weight == weight[at]) & (target == target[at])
    whole = sized & np.logical_and.reduceat(equal, starts)
    model = np.where(whole, model, np.arange(len(starts)))
    kept = np.flatnonzero(model == np.arange(len(starts)))
    return np.searchsorted(kept, model), kept


class Automaton:
    """Sequences of up to ``depth`` words and their counts."""

    def __init__(self, words: list[bytes], depth: int, starts: np.ndarray, word: np.ndarray, weight: np.ndarray, target: np.ndarray) -> None:
        self.words, self.depth = words, depth
        #: arcs of state s are starts[s] to starts[s + 1]; state 0 has none, the last one is the root
        self.starts, self.word, self.weight, self.target = starts, word, weight, target

    @classmethod
    def build(cls, words: list[bytes], columns: Columns, counts: np.ndarray) -> Automaton:
        """From sorted distinct sequences; words that none of them has are left out."""
        used = np.unique(np.concatenate(columns)) if len(counts) else np.zeros(0, np.int64)
        used = used[used > 0]
        number = np.zeros(len(words) + 1, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        columns = [number[c] for c in columns]
        depth, n = len(columns), len(counts)
        # where a prefix of k + 1 words begins, and the rows that are no longer than it
        fresh, begins = np.zeros(n, bool), []
        for column in columns:
            fresh = fresh | np.r_[True, column[1:] != column[:-1]][:n]
            begins.append(np.flatnonzero(fresh & (column > 0)))
        arcs, first_state = [], 1
        down = np.zeros(0, np.int64)  # rows whose prefix has a state, and that state
        down_state = np.zeros(0, np.int64)
        for k in range(depth - 1, -1, -1):
            at = begins[k]
            ends = np.ones(len(at), bool) if k == depth - 1 else columns[k + 1][at] == 0
            target = np.zeros(len(at), np.int64)
            # a state hangs on the prefix its first row belongs to
            owner = np.searchsorted(at, down, "right") - 1
            target[owner] = down_state
            weight = np.where(ends, counts[at], 0)
            if not len(at):
                continue
            parent = np.searchsorted(begins[k - 1], at, "right") - 1 if k else np.zeros(len(at), np.int64)
            starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            state, kept = _register(starts, columns[k][at], weight, target)
            size = np.diff(np.r_[starts, len(at)])[kept]
            ends_at = np.cumsum(size)
            take = np.arange(ends_at[-1]) + np.repeat(starts[kept] - (ends_at - size), size)
            arcs.append((size, columns[k][at][take], weight[take], target[take]))
            down, down_state = at[starts], state + first_state
            first_state += len(kept)
        sizes, word, weight, target = ([np.concatenate(x) for x in zip(*arcs)] if arcs else [np.zeros(0, np.int64)] * 4)
        starts = np.r_[0, 0, np.cumsum(sizes)] if arcs else np.zeros(2, np.int64)
        return cls([words[i - 1] for i in used], depth, starts, word, weight, target)

    def sequences(self) -> tuple[Columns, np.ndarray]:
        """All accepted sequences, those of fewer words first, and their counts."""
        found, counts = [], []
        state, prefix = np.array([len(self.starts) - 2]), []
        for k in range(self.depth):
            size = self.starts[state + 1] - self.starts[state]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(self.starts[state] - (ends - size), size)
            prefix = [np.repeat(p, size) for p in prefix] + [self.word[at]]
            ok = self.weight[at] > 0
            blank = np.zeros(int(ok.sum()), np.int64)
            found.append([p[ok] for p in prefix] + [blank] * (self.depth - k - 1))
            counts.append(self.weight[at][ok])
            state = self.target[at]
            deeper = state > 0
            prefix, state = [p[deeper] for p in prefix], state[deeper]
        return [np.concatenate(c) for c in zip(*found)], np.concatenate(counts)

    def to_bytes(self) -> bytes:
        names = b"\n".join(self.words)
        out = [struct.pack("<qqq", self.depth, len(self.words), len(names)), names]
        for values in (self.starts, self.word, self.weight, self.target):
            top = int(values.max(initial=0))
            width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1 if w == 8 else 8 * w))
            out += [struct.pack("<qq", width, len(values)), values.astype(f"<u{width}").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        depth, n_words, size = struct.unpack_from("<qqq", data)
        at = 24 + size
        words = data[24:at].split(b"\n") if n_words else []
        arrays = []
        for _ in range(4):
            width, n = struct.unpack_from("<qq", data, at)
            arrays.append(np.frombuffer(data, f"<u{width}", n, at + 16).astype(np.int64))
            at += 16 + n * width
        return cls(words, depth, *arrays)


def numbers_in(words: list[bytes], of: dict[bytes, int]) -> np.ndarray:
    """Number of each word in another numbering, -1 if it is not there; 0 first, for "no word"."""
    return np.r_[0, np.fromiter((of.get(w, -1) for w in words), np.int64, len(words))]


def union(parts: list[Automaton], combine=np.add, at_least: int = 0) -> tuple[list[bytes], Columns, np.ndarray]:
    """Sorted sequences of several automata, their counts combined; those below ``at_least`` go."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i for i, w in enumerate(words, 1)}
    columns, counts = [], []
    for part in parts:
        found, n = part.sequences()
        here = numbers_in(part.words, number)
        columns.append([here[c] for c in found])
        counts.append(n)
    columns, counts = [np.concatenate(c) for c in zip(*columns)], np.concatenate(counts)
    order, starts = sort_order(columns)
    counts = combine.reduceat(counts[order], starts) if len(starts) else counts[:0]
    kept = counts >= at_least
    rows = order[starts[kept]]
    return words, [c[rows] for c in columns], counts[kept]


def look_up(wanted: Columns, columns: Columns, counts: np.ndarray) -> np.ndarray:
    """Counts of wanted sequences among distinct ones in the same numbering; 0 for those that are not there.

    A negative number is a word the others do not have.
    """
    unknown = np.logical_or.reduce([c < 0 for c in wanted])
    wanted = [np.where(unknown, 0, c) for c in wanted]
    both = [np.concatenate([a, b]) for a, b in zip(columns, wanted)]
    n = len(counts)
    order, starts = sort_order(both)
    group = np.zeros(len(order), np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    value = np.zeros(len(starts), np.int64)
    own = order < n
    value[group[own]] = counts[order[own]]
    out = np.zeros(len(order), np.int64)
    out[order] = value[group]
    return np.where(unknown, 0, out[n:])


def cut_place(cut: tuple[bytes, ...], words: list[bytes], columns: Columns) -> int:
    """How many of the sorted sequences lie before ``cut``; its words need not be among ``words``."""
    low, high = 0, len(columns[0])
    for w, column in zip(cut, columns):
        i = bisect.bisect_left(words, w)
        held = column[low:high]
        low, high = low + int(np.searchsorted(held, i + 1)), low + int(np.searchsorted(held, i + 1, "right"))
        if low == high or words[i] != w:
            return low
    return low
