"""Hierarchical multi-length packing of documents into training sequences.

A document of more than one window is cut into whole windows, and its rest is routed to the shortest context tier that
holds it. The longest tier is packed first: its longest rest opens a window, and the gap is filled from this and the
shorter tiers, longest fit first. A gap that nothing fits takes the front of the longest rest left, unless it is shorter
than ``min_cut``. What never fills a window becomes sequences of the shorter tiers, each a power of two long. Full
sequences are then dealt into step groups of equal attention work (sum of squared piece lengths).

Every task packs its own rows in blocks of ``block_tokens`` and hands its rest on to its next block, so nothing is
shuffled, memory holds one block, and a task that runs again gives the same rows. A task ends with less than one window
that is cut into at most log2(window) sequences, so no key, source or length can overload a task.

Defined results: null text is empty and holds the end id alone; rows that repeat an id are packed each on its own; a null
id stays null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import whole_text

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_group long")
#: Windows in a step group.
STEP = 32


@dataclass
class Rest:
    """The part of a document that is not yet in a sequence."""

    doc: object
    ids: bytes
    start: int
    tokens: int

    def take(self, n: int) -> "Rest":
        """Cuts the first ``n`` ids off."""
        front = Rest(self.doc, self.ids[: 4 * n], self.start, self.tokens)
        self.ids, self.start = self.ids[4 * n:], self.start + n
        return front

    def __len__(self) -> int:
        return len(self.ids) // 4


class Pool:
    """Rests by length. Bit n of ``there`` tells whether one of n ids waits."""

    def __init__(self):
        self.by_length: dict[int, list[Rest]] = {}
        self.there = 0
        self.tokens = 0

    def add(self, rest: Rest) -> None:
        n = len(rest)
        self.by_length.setdefault(n, []).append(rest)
        self.there |= 1 << n
        self.tokens += n

    def longest(self, most: int) -> Rest | None:
        """Takes out the longest rest of at most ``most`` ids."""
        n = (self.there & ((2 << most) - 1)).bit_length() - 1
        if n <= 0:
            return None
        found = self.by_length[n].pop()
        if not self.by_length[n]:
            self.there ^= 1 << n
        self.tokens -= n
        return found


@dataclass
class Packer:
    window: int
    min_cut: int
    first_id: int
    step: int = STEP
    pool: Pool = field(default_factory=Pool)
    whole: list = field(default_factory=list)

    def add(self, doc, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            self.whole.append([self._piece(Rest(doc, ids[4 * start: 4 * (start + self.window)], start, tokens))])
        if whole < tokens:
            self.pool.add(Rest(doc, ids[4 * whole:], whole, tokens))

    def pack(self, last: bool) -> list[tuple]:
        """Rows of all whole windows; with ``last`` also of the rest, in sequences of shorter tiers."""
        tier = self.window
        while tier and self.pool.tokens >= self.window:
            opened = self.pool.longest(tier)
            if opened is None or len(opened) <= tier // 2:
                if opened is not None:
                    self.pool.add(opened)  # of a shorter tier
                tier //= 2
                continue
            self._fill(opened, tier)
        rows = self._dealt()
        if last:
            while self.pool.tokens:
                length = 1 << (self.pool.tokens.bit_length() - 1)
                rows += self._rows([self._gather([], length)], length, None)
        return rows

    def _fill(self, opened: Rest, tier: int) -> None:
        pieces, gap = [opened], self.window - len(opened)
        while gap:
            fit = self.pool.longest(min(gap, tier))
            if fit is None and gap >= self.min_cut and (longest := self.pool.longest(self.window)):
                fit = longest.take(gap)
                self.pool.add(longest)
            if fit is None:
                break
            pieces.append(fit)
            gap -= len(fit)
        self.whole.append([self._piece(p) for p in pieces])

    def _gather(self, pieces: list, room: int) -> list:
        while room:
            fit = self.pool.longest(room)
            if fit is None:
                longest = self.pool.longest(self.window)
                fit = longest.take(room)
                self.pool.add(longest)
            pieces.append(self._piece(fit))
            room -= len(fit)
        return pieces

    def _dealt(self) -> list[tuple]:
        """Whole windows to step groups: heaviest first, back and forth over the groups."""
        done = sorted(self.whole, key=lambda s: -sum(p[2] ** 2 for p in s))
        self.whole = []
        groups = max(1, -(-len(done) // self.step))
        base, rows = self.first_id, []
        for i, sequence in enumerate(done):
            lap, at = divmod(i, groups)
            rows += self._rows([sequence], self.window, base + (at if lap % 2 == 0 else groups - 1 - at))
        return rows

    def _rows(self, sequences: list, tier: int, group) -> list[tuple]:
        rows = []
        for pieces in sequences:
            offset = 0
            for doc, start, length, crc, tokens, ids in pieces:
                rows.append((doc, start, length, crc, tokens, self.first_id, offset, tier, group, ids))
                offset += length
            self.first_id += 1
        return rows

    @staticmethod
    def _piece(rest: Rest) -> tuple:
        return rest.doc, rest.start, len(rest), zlib.crc32(rest.ids), rest.tokens, rest.ids


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int, window: int = 4096,
                   min_cut: int = 16, block_tokens: int = 4_000_000, with_ids: bool = True) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and with ``with_ids`` the ids themselves.

    ``encoder`` makes a function from a text to its ids (little-endian, 32 bits) inside a Python worker. ``tier`` is the
    length that the sequence has room for; ``step_group`` is null for sequences of the shorter tiers.
    """
    end = end_id.to_bytes(4, "little")
    fields = PIECES + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int64()] * 9 + [pa.binary()] * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(window, min_cut, TaskContext.get().partitionId() << 32)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))[: len(names)] or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, encode(text.as_py()) + end)
                if packer.pool.tokens >= block_tokens or len(packer.whole) * window >= block_tokens:
                    yield batch(packer.pack(last=False))
        yield batch(packer.pack(last=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(packed, fields)


def public_word_pieces() -> Callable[[str], bytes]:
    import public_tokenizers

    from visitloom.llm.wordpieces import word_pieces

    return word_pieces(public_tokenizers.path("word_bpe_49k.json")).encode
