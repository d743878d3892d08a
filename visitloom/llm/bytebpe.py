"""Byte-level BPE of whole texts: ids from the lexicon or by merging, and back.

``encode_documents`` gives the ids and the decoded text, ``encoding_digests`` their digests only. Both take any table with
``doc_id`` and ``text``.

Defined results: null text is empty and has no ids; a special token in a text is its own id, as in the tokenizers library;
rows that repeat an id are encoded each on its own; texts of any length are encoded whole; an empty table gives no rows; extra columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import whole_text
from visitloom.llm.lexicon import CUT, SIZE, Lexicon, compile_lexicon, frequent_units, plain
from visitloom.llm.wordpieces import _byte_of_sign

#: Characters of text that are split at a time.
PORTION = 1_000_000
#: Beyond this sign, and for these, tables of Unicode may differ between libraries: the library splits such units itself.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u0530-\U0010ffff]")


class _Strings:
    """Strings by id in one array, to join those of many ids at once."""

    def __init__(self, by_id: dict[int, bytes]):
        self.length = np.zeros(max(by_id) + 1, np.int64)
        for i, string in by_id.items():
            self.length[i] = len(string)
        self.start = np.cumsum(self.length) - self.length
        self.signs = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        shift = self.start[ids] - end + length
        return self.signs[np.arange(end[-1] if len(ids) else 0) + np.repeat(shift, length)].tobytes()


class ByteBpe:
    """Units to ids and ids to bytes. A worker keeps what it has met, up to ``keep`` units; results don't depend on it.

    Ids are bytes here: 32-bit numbers one after another.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs = _byte_of_sign()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(signs[c] for c in token): number for token, number in spec["model"]["vocab"].items()
                 if token not in self.specials}
        token = {number: token for token, number in ranks.items()} | {i: c.encode() for c, i in self.specials.items()}
        self._tokens = _Strings(token)
        self._numbers = _Strings({i: b"%d," % i for i in token})
        self._merge = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._at_special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        self._pieces: dict[str, bytes | None] = {}  # by what follows a space; None if that is no unit
        self._units: dict[str, bytes] = {}
        self._keep = keep
        self.lexicon: Lexicon | None = None

    def merged(self, units: list[str]) -> list[bytes]:
        """The ids of each unit by the merge rules alone."""
        unsure = [i for i, u in enumerate(units) if _UNSURE.search(u)] if _UNSURE.search("".join(units)) else []
        alone = {i: array("i", self._library.encode(units[i], add_special_tokens=False).ids).tobytes() for i in unsure}
        sure = [u for i, u in enumerate(units) if i not in alone] if alone else units
        ids = np.array(self._merge.encode_ordinary("".join(sure)), np.int32)
        # Tokens never lie across units, so where a unit ends in bytes tells where its tokens end.
        ends = np.searchsorted(np.cumsum(self._tokens.length[ids]), np.cumsum([len(u.encode()) for u in sure]), "right")
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in unsure:
            out.insert(i, alone[i])
        return out

    def _ids(self, units: list[str]) -> list[bytes]:
        found = self.lexicon.find([u.encode() for u in units]) if self.lexicon else [None] * len(units)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merged([units[i] for i in unseen])):
            found[i] = ids
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, some MB of text at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < PORTION):
                size += len(texts[end])
                end += 1
            yield from self._portion(texts[at:end])
            at = end

    def _portion(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [t.split(" ") for t in texts]
        known = self._pieces
        new = list(set().union(*split).difference(known))
        if len(known) + len(new) > self._keep:
            known.clear()
            new = list(set().union(*split))
        known.update(dict.fromkeys(new))
        new = [p for p in new if plain(p) and not ("<|" in p and self._at_special.search(p))]
        known.update(zip(new, self._ids([" " + p for p in new])))
        for text, pieces in zip(texts, split):
            rest = [known[p] for p in pieces[1:]]
            if None in rest or not plain(pieces[0]) or self._at_special.search(pieces[0]):
                yield np.frombuffer(b"".join(self._with_specials(text)), np.int32)
            else:
                yield np.frombuffer(b"".join([*self._odd(pieces[:1]), *rest]), np.int32)

    def _odd(self, units: list[str]) -> list[bytes]:
        known = self._units
        new = [u for u in dict.fromkeys(units) if u not in known]
        if len(known) + len(new) > self._keep:
            known.clear()
            new = list(dict.fromkeys(units))
        known.update(zip(new, self._ids(new)))
        return [known[u] for u in units]

    def _with_specials(self, text: str) -> list[bytes]:
        out, at = [], 0
        for found in [*self._at_special.finditer(text), None]:
            if part := text[at: found.start() if found else len(text)]:
                out += self._odd(CUT.split(part))
            if found:
                out.append(array("i", [self.specials[found[0]]]).tobytes())
                at = found.end()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8; what is not valid there becomes replacement signs."""
        decoded = self._tokens.join(ids)
        try:
            decoded.decode()
            return decoded
        except UnicodeDecodeError:
            return decoded.decode(errors="replace").encode()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._numbers.join(ids)[:-1]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker, kept between its tasks."""
    return ByteBpe(path)


@lru_cache(maxsize=2)
def _mapped(compiled: bytes) -> Lexicon:
    return Lexicon(compiled)


def lexicon_of(docs: DataFrame, path: str, size: int = SIZE) -> bytes:
    """The compiled automaton of the ``size`` most frequent units of all documents: some MB at most."""
    frequent = frequent_units(docs, size)
    return compile_lexicon({u.encode(): ids for u, ids in zip(frequent, ByteBpe(path).merged(frequent))})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))


def _bpe_in_worker(path: Callable[[], str], shared) -> ByteBpe:
    bpe = byte_bpe(path())
    bpe.lexicon = _mapped(shared.value)
    return bpe


def encode_documents(docs: DataFrame, path: Callable[[], str], compiled: bytes) -> DataFrame:
    """doc_id, ids, and the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe_in_worker(path, shared)
        for b in batches:
            ids = list(bpe.encode(b.column(1).to_pylist()))
            back = [bpe.decode(i).decode() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(encoded, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: Callable[[], str], compiled: bytes) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe_in_worker(path, shared)
        for b in batches:
            count, ids, back = [], [], []
            for found in bpe.encode(b.column(1).to_pylist()):
                count.append(len(found))
                ids.append(hashlib.sha256(bpe.decimal(found)).hexdigest())
                back.append(hashlib.sha256(bpe.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
