"""A minimal acyclic transducer from words to numbers, kept as arrays that can be memory-mapped.

States that accept the same endings are one state. Each arc carries a number; the sum along
a word's path is the word's place in sorted order, by which its output is looked up.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """arcs: sorted state * 256 + byte; target and output by arc; accepts by state. State 0 is the start."""

    arcs: np.ndarray
    target: np.ndarray
    output: np.ndarray
    accepts: np.ndarray

    def pack(self) -> bytes:
        parts = [np.ascontiguousarray(x, dtype=np.int32) for x in (self.arcs, self.target, self.output, self.accepts)]
        return np.array([len(x) for x in parts], dtype=np.int32).tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def mapped(cls, blob: bytes) -> Transducer:
        """Map a packed transducer from an unnamed temporary file, which goes with the process."""
        file = tempfile.TemporaryFile()
        file.write(blob)
        file.flush()
        data = np.memmap(file, dtype=np.int32, mode="r")
        ends = 4 + np.cumsum(data[:4])
        return cls(*(data[a:b] for a, b in zip([4, *ends[:3]], ends, strict=True)))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words take a step at a time."""
        out = np.zeros(len(words), np.int64)
        if not len(self.arcs) or not words:
            return out - 1
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state, live, at = np.zeros(len(words), np.int64), np.arange(len(words)), 0
        while True:
            live = live[size[live] > at]
            if not len(live):
                break
            key = state[live] * 256 + data[start[live] + at]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            known = self.arcs[arc] == key
            out[live[~known]], size[live[~known]] = -1, 0
            live, arc = live[known], arc[known]
            state[live] = self.target[arc]
            out[live] += self.output[arc]
            at += 1
        alive = out >= 0
        out[alive & (self.accepts[state] == 0)] = -1
        return out


def compile_words(words: list[bytes]) -> Transducer:
    """Build from distinct words in sorted order, minimising as each word's path is left."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int, int]], down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            same = (final[child], tuple(arcs[child].items()))
            arcs[parent][byte] = register.setdefault(same, child)

    path: list[tuple[int, int, int]] = []
    before = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle(path, shared)
        state = path[-1][2] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        before = word
    settle(path, 0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            top = todo[-1]
            missing = [c for c in arcs[top].values() if c not in below]
            if missing:
                todo += missing
            else:
                below[top] = final[top] + sum(below[c] for c in arcs[top].values())
                todo.pop()
        return below[state]

    count(0)
    rows = []
    for state in order:
        passed = int(final[state])
        for byte in sorted(arcs[state]):
            child = arcs[state][byte]
            rows.append((number[state] * 256 + byte, number[child], passed))
            passed += below[child]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return Transducer(table[:, 0], table[:, 1], table[:, 2], np.array([final[s] for s in order], dtype=np.int64))
