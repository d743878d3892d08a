"""Byte-level BPE through a minimal acyclic transducer.

The most frequent units of the corpus and their token ids are compiled into an automaton whose equal suffixes are shared
(built word by word in sorted order), with outputs pushed towards the front. Its arrays are written to one file that each
Python worker maps into memory. A unit the automaton does not accept is merged exactly, by rank.

A unit starts at a space between two non-spaces and runs up to the next such space: byte-level pre-tokens never cross
these places, so a text's ids are the ids of its units in order. Units come from all documents and are counted in Spark;
only the most frequent, ``size`` at most, reach the driver.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import whole_text
from visitloom.sources.workspace import materialize

CUT = re.compile(r"(?<=\S)(?= \S)")
#: Longest unit, in characters, that may enter the automaton, and most units that do.
LONGEST, SIZE = 64, 65_536


def plain(piece: str) -> bool:
    """Whether what ``split(" ")`` gave makes a unit with the space before it: it begins and ends with a non-space."""
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, n over all documents: counted in each task, then summed. Units over ``LONGEST`` are left to the merges."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0):
                seen.update(text.as_py().split(" ")[1:])
            seen = {u: n for u, n in seen.items() if len(u) < LONGEST and plain(u)}
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["unit", "n"])

    return docs.select(whole_text(docs).alias("text")).mapInArrow(counted, "unit string, n long").groupBy("unit").agg(
        F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, size: int = SIZE) -> list[str]:
    """The units above the lowest count that leaves at most ``size`` of them, each with its leading space; units that occur once
    never count. The cut comes from the number of units for each count, so the driver gets these units and no other."""
    counts = materialize(unit_counts(docs).where("n > 1"), "unit-counts")
    for_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    above = F.sum("units").over(Window.orderBy(F.desc("n")))  # one row for each different count
    least = for_count.withColumn("above", above).where(F.col("above") <= size).agg(F.min("n")).first()[0]
    if least is None:
        return []
    return sorted(" " + r.unit for r in counts.where(F.col("n") >= least).select("unit").collect())


class _Builder:
    """Minimal acyclic automaton from sorted keys: a state is frozen and shared once no later key can pass it.

    Values rise with the keys, so the first arc of a path already carries its smallest value and a later key adds the
    difference where it leaves the path; all arcs below put out nothing and their states can be shared.
    """

    def __init__(self):
        self.frozen: dict[tuple, int] = {}
        self.states: list[tuple] = []  # of (final, ((byte, output, target), ...))

    def build(self, items: list[tuple[bytes, int]]) -> int:
        path: list[list] = [[False, []]]  # open states: final, arcs [byte, output, target]
        last = b""
        for key, value in items:
            shared = 0
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
            self._freeze(path, shared)
            value -= sum(state[1][-1][1] for state in path[:shared])
            for i in range(shared, len(key)):
                path[i][1].append([key[i], value if i == shared else 0, -1])
                path.append([False, []])
            path[-1][0] = True
            last = key
        self._freeze(path, 0)
        return self.state(path[0])

    def _freeze(self, path: list, down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            path[-1][1][-1][2] = self.state(state)

    def state(self, state: list) -> int:
        key = (state[0], tuple(map(tuple, state[1])))
        if key not in self.frozen:
            self.frozen[key] = len(self.states)
            self.states.append(key)
        return self.frozen[key]


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The automaton as bytes: a header, then arrays of states, arcs and ids. ``entries``: 32-bit ids of each key.

    An entry's output is the place of its ids in the array of ids; outputs add up along the path.
    """
    ids, items = [], []
    for key in sorted(entries):
        items.append((key, len(ids)))
        ids += [len(entries[key]) // 4, *memoryview(entries[key]).cast("i")]
    builder = _Builder()
    root = builder.build(items)
    arcs = [(256 * n + byte, output, target) for n, (_, out) in enumerate(builder.states) for byte, output, target in out]
    table = np.array(arcs, dtype=np.int32).reshape(-1, 3)
    parts = [np.array([root, len(builder.states), len(arcs), len(ids)]), np.array([f for f, _ in builder.states]),
             table[:, 0], table[:, 1], table[:, 2], np.array(ids)]
    return b"".join(np.ascontiguousarray(p, dtype=np.int32).tobytes() for p in parts)


class Lexicon:
    """Reads a compiled automaton through a memory map, for many keys at a time."""

    def __init__(self, compiled: bytes):
        file = tempfile.TemporaryFile()  # without a name: it goes with the worker
        file.write(compiled)
        file.flush()
        self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(self._map, dtype=np.int32)
        self.root, states, arcs, ids = map(int, numbers[:4])
        ends = np.cumsum([4, states, arcs, arcs, arcs, ids])
        self.final, self.arc, self.output, self.target, self.ids = (numbers[a:b] for a, b in zip(ends, ends[1:]))

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        """The ids of each key, or None where the automaton doesn't accept it. All keys step through it together."""
        found: list[bytes | None] = [None] * len(keys)
        if not keys or not len(self.arc):
            return found
        signs = np.frombuffer(b"".join(keys), dtype=np.uint8)
        length = np.array([len(k) for k in keys])
        at = np.cumsum(length) - length
        key, state, total = np.arange(len(keys)), np.full(len(keys), self.root, np.int32), np.zeros(len(keys), np.int32)
        step = 0
        while len(key):
            done = length[key] == step
            for k, s, t in zip(key[done].tolist(), state[done].tolist(), total[done].tolist()):
                if self.final[s]:
                    found[k] = self.ids[t + 1: t + 1 + self.ids[t]].tobytes()
            key, state, total = key[~done], state[~done], total[~done]
            wanted = state * np.int32(256) + signs[at[key] + step]
            arc = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            there = self.arc[arc] == wanted
            key, arc = key[there], arc[there]
            state, total = self.target[arc], total[there] + self.output[arc]
            step += 1
        return found
