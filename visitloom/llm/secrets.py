"""Secret scans through nested encodings.

The text is the first layer. A worklist takes a layer, scans it, and unwraps what is encoded in it: percent escapes and
Unicode escapes, and backslash escapes of single signs, give a layer of the same text with the escapes replaced; a base64 run gives a layer of its own, decompressed
first if it is compressed. New layers go back on the list until none is left. A layer that was met before is not taken
again, so the list ends. Layers of base64 runs are made one at a time, so many compressed ones never lie in memory together.
Every character of a layer carries the span of the text it came from, so what is found at any depth is a span of the
original text: of the escapes themselves, or of the whole base64 run, or of the lines of it that hold the find.

A base64 run goes on over single line ends, and is read from each of its first four signs on, so a path or a prefix before
it does not shift it. Of bytes, all stretches that are text are layers, whatever lies between them, and so are stretches of ASCII
signs in UTF-16.

Fixed kinds: ``assign`` (a key word, ``:`` or ``=``, a value of 12 or more characters), ``access`` (``AKIA`` and capitals or
digits, 18 or more in all), ``hex`` (16 or more lower-case hex digits), leftmost and not overlapping per kind. Matches in
the text itself are the base; those of deeper layers are added.

Defined results: null text is empty and has no spans; equal spans of a kind count once; rows that repeat an id are scanned
each on its own; an empty table gives no rows; extra columns are not read, or stay where documents are redacted, whatever
their names; spans that begin at one place stand in the order of their kinds; texts of any length are scanned whole.
Compressed data is unpacked at any depth, all members or frames of it, and from wherever it begins in a layer. An unpacked layer above ``MOST_BYTES`` is scanned in portions that overlap by half.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import fresh_name, named, whole_text

KINDS = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run that is long enough is found in the same place as the run of any length; short ones need no filter afterwards.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});"
                      r"|&#[xX]([0-9A-Fa-f]{1,6});|\\U([0-9A-Fa-f]{8})")
#: Escapes of single signs, as in strings of JSON and of programs.
_SIGN = re.compile(r"""\\[nrt"'\\/]""")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Begins of compressed data, wherever they are.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
#: Characters of the shortest text that a secret, or a layer with one, is in.
LEAST = 16
#: Stretches without what no match and no encoding has: control characters, and bytes that are no UTF-8.
_TEXT = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{%d,}" % LEAST)
#: Between the lines of one base64 run, and lines of a few signs before and after it.
_LINE_END = re.compile(r"\r?\n[\x20\t>]*")
_SHORT_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{1,15})\r?\n[\x20\t>]*\Z")
_SHORT_AFTER = re.compile(r"\r?\n[\x20\t>]*([A-Za-z0-9+/_-]{1,15}={0,2})(?![A-Za-z0-9+/_-])")
#: ASCII signs in UTF-16, low byte first and last.
_WIDE = [re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}" % LEAST), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){%d,}" % LEAST)]
#: Bytes that begin no character of UTF-8.
_CONTINUED = bytes(range(0x80, 0xC0))
_STANDARD = str.maketrans("-_", "+/")
#: Lines, escapes of bytes that no text has, and what a line with them is made of.
_LINE = re.compile(r"[\x20-\x7e]{%d,}" % LEAST)
_HIGH = re.compile(r"(?:%|\\x)(?:[01]|[89A-Fa-f])[0-9A-Fa-f]")
_ESCAPE = re.compile(r"(?:%|\\x)([0-9A-Fa-f]{2})|(\\[nrt\\'\"])|[\s\S]")
_NAMED = {r"\n": b"\n", r"\r": b"\r", r"\t": b"\t", r"\\": b"\\", r"\'": b"'", r'\"': b'"'}
#: Bytes of an unpacked layer that are scanned at a time; longer ones are scanned in portions that overlap by half.
MOST_BYTES = 1 << 26
#: Most bytes that are unpacked at a time, and of how many.
CHUNK, SLICE = 1 << 20, 1 << 12
#: What a redacted span becomes.
MASK = "[SECRET]"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches in one layer; kind is an index of ``KINDS``."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return spans


class Layer:
    """A text and, for its parts, where they come from: (first character here, start, end there, same length)."""

    def __init__(self, text: str, parts: list[tuple[int, int, int, bool]]):
        self.text, self.parts = text, parts
        self._starts = [p[0] for p in parts]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that the characters from start to end come from."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        here, start, end, same = self.parts[bisect_right(self._starts, i) - 1]
        return (start + i - here, start + i - here + 1) if same else (start, end)

    def replaced(self, pieces: list[tuple[int, int, str]]) -> "Layer":
        """This layer with each (start, end, new text) put in; characters of a new text come from its whole span."""
        out, parts, here, at = [], [], 0, 0

        def copy(start: int, end: int) -> None:
            nonlocal here
            while start < end:  # part by part, as parts map differently
                n = bisect_right(self._starts, start) - 1
                first, a, b, same = self.parts[n]
                stop = min(end, self._starts[n + 1] if n + 1 < len(self.parts) else end)
                parts.append((here, a + start - first, b, True) if same else (here, a, b, False))
                out.append(self.text[start:stop])
                here += stop - start
                start = stop

        for start, end, new in pieces:
            copy(at, start)
            if new:
                parts.append((here, *self.origin(start, end), False))
                out.append(new)
                here += len(new)
            at = end
        copy(at, len(self.text))
        return Layer("".join(out), parts)


def _percent(text: str) -> list[tuple[int, int, str]]:
    pieces = []
    for run in _PERCENT.finditer(text) if "%" in text else ():
        data, at = bytes.fromhex(run[0].replace("%", "")), run.start()
        try:
            for sign in data.decode():
                pieces.append((at, at + 3 * len(sign.encode()), sign))
                at = pieces[-1][1]
        except UnicodeDecodeError:
            pieces += [(run.start() + 3 * i, run.start() + 3 * i + 3, chr(b)) for i, b in enumerate(data) if b < 128]
    return pieces


def _unicode(text: str) -> list[tuple[int, int, str]]:
    pieces = []
    for m in _UNICODE.finditer(text) if "\\" in text or "&#" in text or "%u" in text else ():
        if m[2]:
            at, units = m.start(), [m[2][i + 2: i + 6] for i in range(0, len(m[2]), 6)]
            while units:
                n = 2 if units[0][:2].lower() in ("d8", "d9", "da", "db") and len(units) > 1 else 1
                sign = bytes.fromhex("".join(units[:n])).decode("utf-16-be", "replace")
                pieces.append((at, at + 6 * n, sign))
                at, units = at + 6 * n, units[n:]
        else:
            number = int(m[4]) if m[4] else int(m[1] or m[3] or m[5] or m[6], 16)
            if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000:
                pieces.append((m.start(), m.end(), chr(number)))
    return pieces


def _signs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _NAMED.get(m[0], b"/").decode()) for m in _SIGN.finditer(text)] if "\\" in text else []


def _engine(head: bytes):
    """A decompressor for data that begins so, or None."""
    if head[:2] == b"\x1f\x8b" or len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj(wbits=47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _fed(engine, part: bytes) -> Iterator[bytes]:
    """What the decompressor makes of the part, some MB at a time at most."""
    if hasattr(engine, "needs_input"):
        yield engine.decompress(part, CHUNK)
        while not engine.eof and not engine.needs_input:
            yield engine.decompress(b"", CHUNK)
    else:
        out = engine.decompress(part, CHUNK)
        yield out
        while not engine.eof and (engine.unconsumed_tail or len(out) == CHUNK):
            out = engine.decompress(engine.unconsumed_tail, CHUNK)
            yield out


class Unpacked:
    """All members or frames that the bytes begin with, decompressed one after the other. ``read`` is how many bytes they took
    as far as they are whole; what comes before damage or an early end is given too."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.read = filter(None, source), 0

    def __iter__(self) -> Iterator[bytes]:
        rest, taken = b"", 0
        while True:
            while len(rest) < 6 and (more := next(self.source, b"")):
                rest, taken = rest + more, taken + len(more)
            engine, frames = _engine(rest), rest[:4] == b"\x28\xb5\x2f\xfd"
            if engine is None:
                return
            try:
                while not engine.eof and rest:
                    if frames:
                        for i in range(0, len(rest), 256):  # it knows no limit, but 256 bytes give 11 MB at most
                            yield engine.decompress(rest[i: i + 256])
                            if engine.eof:
                                break
                        left = rest[i + 256:]
                    else:
                        yield from _fed(engine, rest)
                        left = b""
                    if not engine.eof:
                        rest = next(self.source, b"")
                        taken += len(rest)
                if not engine.eof:
                    return
                rest = engine.unused_data + left
            except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
                return
            self.read = taken - len(rest)


def _slices(data: bytes, start: int) -> Iterator[bytes]:
    return (data[i: i + SLICE] for i in range(start, len(data), SLICE))


def _portions(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes in portions of ``MOST_BYTES``, which overlap by half."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        while len(buffer) > MOST_BYTES:
            yield bytes(buffer[:MOST_BYTES])
            del buffer[: MOST_BYTES // 2]
    if buffer:
        yield bytes(buffer)


def _digest(chunks: Iterable[bytes]) -> bytes:
    state = hashlib.blake2b(digest_size=16)
    for chunk in chunks:
        state.update(chunk)
    return state.digest()


def _contents(data: bytes) -> Iterator:
    """The decodable stretches of the data with their first byte and the one after them (None for UTF-16), and :class:`Unpacked` streams, as functions that begin them, of
    all that is compressed in it; ``at`` is where such a stream begins, ``read()`` how much of it was read so far."""
    at = seen = 0
    text = data.decode("utf-8", "surrogateescape")
    for m in _TEXT.finditer(text):
        at, seen = at + len(text[seen: m.start()].encode("utf-8", "surrogateescape")), m.start()
        yield m[0], at, at + len(m[0].encode())
    if b"\0" in data:
        for wide in _WIDE:
            for m in wide.finditer(data):
                yield m[0].replace(b"\0", b"").decode(), m.start(), None
    end = 0
    for at in chain([0], (m.start() for m in _PACKED.finditer(data))):
        if at >= end and _engine(data[at: at + 6]):
            begun = []

            def begin(at=at, begun=begun) -> Unpacked:
                begun.append(Unpacked(_slices(data, at)))
                return begun[-1]

            begin.at, begin.read = at, lambda begun=begun: max((u.read for u in begun), default=0)
            yield begin
            end = at + max(1, begin.read())  # it was read meanwhile


def _opened(begin: Callable[[], Iterable[bytes]], met: set) -> Iterator:
    """The contents of a stream, portion by portion. A long stream that is itself compressed is unpacked from one end to the other."""
    portions = _portions(begin())
    first, second = next(portions, b""), next(portions, None)
    if second is not None and _engine(first[:6]):
        key = _digest(begin())
        if key not in met:
            met.add(key)
            yield lambda: Unpacked(iter(begin()))
    for portion in chain([first], [] if second is None else [second], portions):
        key = _digest([portion])
        if portion and key not in met:
            met.add(key)
            yield from _contents(portion)


def _texts(data: bytes) -> Iterator[tuple[str, tuple]]:
    """The texts in the data and in all that is compressed in it, at any depth, and where they are from: (first byte, end, None), or of
    compressed data and of UTF-16 (first byte, None, end, if its end is known). Bytes that were met before are not opened again."""
    work, met, outer = [_contents(data)], {_digest([data])}, None
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
        elif isinstance(found, tuple):
            text, at, stop = found
            if len(work) == 1:
                yield text, (at, stop, None)
            else:
                yield text, (outer.at, None, outer.at + outer.read() if outer.read() else None)
        else:
            outer = found if len(work) == 1 else outer
            work.append(_opened(found, met))


def _chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 runs as lists of their lines (start, end): runs that only a line end parts are one, with short lines next to them."""
    lines: list[tuple[int, int]] = []
    for m in _BASE64.finditer(text):
        if lines and not (text[lines[-1][1] - 1] != "=" and _LINE_END.fullmatch(text, lines[-1][1], m.start())):
            yield _with_short_lines(text, lines)
            lines = []
        lines.append(m.span())
    if lines:
        yield _with_short_lines(text, lines)


def _with_short_lines(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    before = _SHORT_BEFORE.search(text, max(0, lines[0][0] - 64), lines[0][0])
    after = text[lines[-1][1] - 1] != "=" and _SHORT_AFTER.match(text, lines[-1][1])
    return ([before.span(1)] if before else []) + lines + ([after.span(1)] if after else [])


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """Layers of the runs, whole and line by line. Each is read from its first four signs on, so signs before it do no harm."""
    for lines in _chains(layer.text):
        for some in [lines] if len(lines) == 1 else [lines, *([x] for x in lines)]:
            run = "".join(layer.text[a:b] for a, b in some).rstrip("=").translate(_STANDARD)
            for shift in range(min(4, len(run) - LEAST + 1)):
                signs = len(run) - shift
                data = base64.b64decode(run[shift:] + "A" * (-signs % 4))[: signs * 3 // 4]
                yield from _placed(layer, data, some, shift)


def _placed(layer: Layer, data: bytes, lines: list[tuple[int, int]], shift: int) -> Iterator[Layer]:
    """Layers of the bytes that the lines of a run hold. A text of several lines knows which of its characters are from which."""
    ends, at = [], -shift
    for a, b in lines:
        at += b - a
        ends.append(max(0, at) * 3 // 4)  # bytes that are whole with this line
    for text, where in _texts(data):
        first = bisect_right(ends[:-1], where[0])
        last = len(lines) - 1 if where[1] is None else bisect_left(ends[:-1], where[1])
        parts = [(0, *layer.origin(lines[first][0], lines[last][1]), False)]
        if where[1] is not None and last > first:
            here, byte, parts = 0, where[0], []
            for n in range(first, last + 1):
                parts.append((here, *layer.origin(*lines[n]), False))
                stop = min(ends[n], where[1])
                here += len(data[byte:stop].translate(None, _CONTINUED))
                byte = stop
        yield Layer(text, parts)


def _escaped_layers(layer: Layer) -> Iterator[Layer]:
    """Layers of compressed bytes that are written with percent or \\x escapes."""
    for line in _LINE.finditer(layer.text) if _HIGH.search(layer.text) else ():
        if not _HIGH.search(line[0]):
            continue
        starts, data = [], bytearray()
        for m in _ESCAPE.finditer(line[0]):
            byte = bytes.fromhex(m[1]) if m[1] else _NAMED[m[2]] if m[2] else m[0].encode()
            starts += [line.start() + m.start()] * len(byte)
            data += byte
        starts.append(line.end())
        if not _PACKED.search(data):
            continue
        for text, where in _texts(bytes(data)):
            if where[1] is None:
                yield Layer(text, [(0, *layer.origin(starts[where[0]], starts[where[2]] if where[2] else line.end()), False)])


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as sorted (start, kind, end) of the original text."""
    base = sorted(find(text))
    everything, work, met = set(base), [Layer(text, [(0, 0, len(text), True)])], set()  # of layers, and of iterators over them
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):
            rest, layer = layer, next(layer, None)
            if layer is None:
                continue
            work.append(rest)
        if not layer.text:
            continue
        key = hash(layer.text), len(layer.text), layer.origin(0, len(layer.text))
        if key in met:
            continue
        met.add(key)
        if len(met) > 1:
            for start, kind, end in find(layer.text):
                a, b = layer.origin(start, end)
                everything.add((a, kind, b))
        work += [layer.replaced(pieces) for pieces in (_percent(layer.text), _unicode(layer.text), _signs(layer.text)) if pieces]
        work += [_escaped_layers(layer), _base64_layers(layer)]
    return base, sorted(everything)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base matches), base and spans (``kind:start:end`` in code points, by start)."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [scan(t.as_py()) for t in b.column(1)]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in out], pa.int64()) for k in range(3)]
            texts = [pa.array([spans_text(x[i]) for x in out], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *texts], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(
        scanned, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(text: str | None) -> str | None:
    """The text with every span, at any depth, masked; spans that touch or overlap become one mask."""
    spans, out, at = scan(text or "")[1], [], 0
    if not spans:
        return text
    for start, _, end in spans:
        if start >= at and (start > at or not out):
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars``, where there is such a column, follows the text. Nulls stay."""
    name = fresh_name(docs, "text_without_secrets")

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore").astype(object)

    out = docs.withColumn(name, redacted(docs["text"].cast("string")))
    columns = [F.col(name).alias("text") if c == "text" else F.char_length(name).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else named(c) for c in docs.columns]
    return out.select(*columns)
