"""Secret scans through nested encodings.

Each text is scanned as it is, then every layer that can be unwrapped from it is scanned
too, by a worklist that goes on until nothing new unwraps:

* ``url``: runs of %XX (UTF-8) and %uXXXX are decoded where they stand;
* ``unicode``: backslash escapes (u, U, x, u{...}, surrogate pairs) are decoded where they stand;
* ``base64``: each run of 16 or more characters (both alphabets, padded or not, wrapped
  in lines or not) that gives text becomes a layer of its own;
* ``gzip``, ``zlib``, ``zstd``, ``bz2``, ``xz``: bytes of a base64 or %XX run that begin
  with the format's mark are decompressed, again and again if need be.

A layer keeps for each of its characters where it comes from in the document, so a match
in any layer is reported as a span of the document. Layers whose text and place, or
compressed bytes, were met before are not entered again: cycles (an archive holding
itself) end, and repeated archives are opened once. Layers are made one at a time, and a
decompressed stream is cut into windows where no match can cross, so memory doesn't grow
with what an archive unpacks to.

Defined results: a null text is empty; positions are code points; spans found in several
ways count once; ``base`` spans are those of the text itself, and stay; repeated rows are
scanned one by one; an empty table gives no row; columns besides ``doc_id`` and ``text``
are not read. A span inside a compressed layer is the whole compressed run. A base64 run
that is wrapped across the cut of two windows is read as two.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import io
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeflow.llm import common

#: fixed values: the kinds in order, their patterns and least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
WORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+|%u[0-9A-Fa-f]{4}")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
CODED = r"[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?<!{CODED})(?:(?:{CODED}{{60,}}\r?\n)+{CODED}+|{CODED}{{16,}})={{0,2}}")
MARKS = {"gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00"}
#: a place that no match, escape or base64 run goes across
CUT = re.compile(r"[^A-Za-z0-9+/_.=\-\"':\\%{}\x20\r\n]|\n(?=[^A-Za-z0-9+/_-])")
WINDOW, BLOCK = 4 << 20, 1 << 20

Span = tuple[int, int, int]     # start, kind, end


def scan(text: str) -> list[Span]:
    """The matches of a text, by start, then kind."""
    found = []
    low = text.lower()      # no ASCII letter is lost by it
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run this short of digits is left out, so only long ones need be looked for
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A text, and per character the start and end of what it stands for in the document
    (None: itself; a pair of numbers: all of that span)."""

    text: str
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None
    via: str = ""

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def inner(self, text: str, starts: np.ndarray, ends: np.ndarray, via: str) -> Layer:
        """A layer whose characters stand for these spans of this one."""
        via = f"{self.via}>{via}" if self.via else via
        if isinstance(self.starts, int):
            return Layer(text, self.starts, self.ends, via)
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, starts, ends, via)

    def digest(self) -> bytes:
        place = self.origin(0, len(self.text)) if self.text else ()
        return digest_of(f"{place}{self.text}".encode())


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def percent_run(run: str) -> list[tuple[str, int, int]]:
    """(character, start, end) of a run's escapes; bytes that are no UTF-8 stay as written."""
    if run[1] == "u":
        char = chr(int(run[2:], 16))
        return [(c, k, k + 1) for k, c in enumerate(run)] if 0xD800 <= ord(char) < 0xE000 else [(char, 0, 6)]
    data, out, at = bytes.fromhex(run.replace("%", "")), [], 0
    for char in codecs.decode(data, "utf-8", "surrogateescape"):
        if 0xDC80 <= ord(char) <= 0xDCFF:
            out += [(c, 3 * at + k, 3 * at + k + 1) for k, c in enumerate(run[3 * at:3 * at + 3])]
            at += 1
        else:
            n = len(char.encode())
            out.append((char, 3 * at, 3 * (at + n)))
            at += n
    return out


def escape_run(run: str) -> list[tuple[str, int, int]]:
    if run[1] == "u" and run[2] != "{":
        units = [int(run[k + 2:k + 6], 16) for k in range(0, len(run), 6)]
        out, k = [], 0
        while k < len(units):
            pair = units[k:k + 2]
            two = len(pair) == 2 and 0xD800 <= pair[0] < 0xDC00 <= pair[1] < 0xE000
            if two:
                out.append((chr(0x10000 + (pair[0] - 0xD800 << 10) + pair[1] - 0xDC00), 6 * k, 6 * k + 12))
            elif 0xD800 <= pair[0] < 0xE000:
                out += [(c, 6 * k + j, 6 * k + j + 1) for j, c in enumerate(run[6 * k:6 * k + 6])]
            else:
                out.append((chr(pair[0]), 6 * k, 6 * k + 6))
            k += 1 + two
        return out
    code = int(run[3:-1] if run[2] == "{" else run[2:], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return [(c, k, k + 1) for k, c in enumerate(run)]
    return [(chr(code), 0, len(run))]


def decoded_in_place(layer: Layer, pattern: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with all matches decoded where they stand; None if nothing changes."""
    text, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        chars = decode(m[0])
        text += [layer.text[at:m.start()], *(c for c, _, _ in chars)]
        starts += [np.arange(at, m.start()), np.array([m.start() + a for c, a, _ in chars], dtype=np.int64)]
        ends += [np.arange(at, m.start()) + 1, np.array([m.start() + b for c, _, b in chars], dtype=np.int64)]
        at = m.end()
    if not at:
        return None
    rest = np.arange(at, len(layer.text))
    made = "".join([*text, layer.text[at:]])
    if made == layer.text:
        return None
    return layer.inner(made, np.concatenate([*starts, rest]), np.concatenate([*ends, rest + 1]), via)


def format_of(data: bytes) -> str | None:
    for name, mark in MARKS.items():
        if data.startswith(mark) and (name != "bz2" or data[4:10] == b"1AY&SY"):
            return name
    if len(data) > 6 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0 and not data[1] & 32:
        # this mark is weak: plain text can begin like it
        head = data[:64]
        return None if head.isascii() and head.decode().isprintable() else "zlib"
    return None


class Reader(io.RawIOBase):
    """Blocks of bytes as a file."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held and (block := next(self.blocks, None)) is not None:
            self.held = block
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


def unpacked(blocks: Iterator[bytes], name: str) -> Iterator[bytes]:
    """What the blocks unpack to, in blocks, as far as they are sound."""
    try:
        if name == "zstd":
            import zstandard

            way = zstandard.ZstdDecompressor().stream_reader(io.BufferedReader(Reader(blocks)))
            while block := way.read(BLOCK):
                yield block
        elif name in ("gzip", "zlib"):
            way = zlib.decompressobj(31 if name == "gzip" else 15)
            for data in blocks:
                while data and not way.eof:
                    yield way.decompress(data, BLOCK)
                    data = way.unconsumed_tail
            yield way.flush()
        else:
            way = bz2.BZ2Decompressor() if name == "bz2" else lzma.LZMADecompressor()
            for data in blocks:
                yield way.decompress(data, BLOCK)
                while not way.eof and not way.needs_input:
                    yield way.decompress(b"", BLOCK)
                if way.eof:
                    return
    except Exception as e:
        # each library has errors of its own for bytes that only look like its format
        if type(e).__name__ not in ("error", "ZstdError", "LZMAError", "OSError", "EOFError", "ValueError"):
            raise


def windows(blocks: Iterator[bytes]) -> Iterator[str]:
    """The blocks' text, cut where no match goes across; ends at bytes that are no text."""
    way, held = codecs.getincrementaldecoder("utf-8")(), ""
    try:
        for block in blocks:
            held += way.decode(block)
            if len(held) >= WINDOW:
                cut = max((m.end() for m in CUT.finditer(held, len(held) // 2)), default=0)
                if cut:
                    yield held[:cut]
                    held = held[cut:]
    except UnicodeDecodeError:
        pass
    if held:
        yield held


def is_text(text: str) -> bool:
    return bool(text) and text.translate({9: 32, 10: 32, 13: 32}).isprintable()


class Worklist:
    """The layers of one document, each once."""

    def __init__(self) -> None:
        self.met: set[bytes] = set()

    def new(self, digest: bytes) -> bool:
        if digest in self.met:
            return False
        self.met.add(digest)
        return True

    def archives(self, data: bytes, start: int, end: int, via: str, layer: Layer) -> Iterator[Layer]:
        """Layers of compressed bytes that stand at a span of ``layer``; archives inside an
        archive are opened while it streams by."""
        first, last = layer.origin(start, end)
        if format_of(data) is None or not self.new(digest_of(f"{first}:{last}:".encode() + data)):
            return
        way, blocks, head, heads = [*filter(None, [layer.via]), via], iter(()), data, set()
        while name := format_of(head):
            if head[:BLOCK] in heads:       # it holds itself
                return
            heads.add(head[:BLOCK])
            way.append(name)
            blocks = filter(None, unpacked(itertools.chain([head], blocks), name))
            head = next(blocks, b"")
        for text in windows(itertools.chain([head], blocks)):
            yield Layer(text, first, last, ">".join(way))

    def runs(self, layer: Layer) -> Iterator[Layer]:
        """Layers of base64 and of %XX runs that hold compressed bytes."""
        for m in BASE64.finditer(layer.text):
            yield from self.base64_run(layer, m.start(), m[0])
        if "%" in layer.text:
            for m in PERCENT.finditer(layer.text):
                if len(m[0]) > 18 and m[0][1] != "u":
                    yield from self.archives(bytes.fromhex(m[0].replace("%", "")), m.start(), m.end(), "url", layer)

    def base64_run(self, layer: Layer, at: int, run: str, parts: bool = True) -> Iterator[Layer]:
        places = np.flatnonzero(~np.isin(np.frombuffer(run.encode(), np.uint8), list(b"\r\n=")))
        chars = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
        chars = chars[:len(chars) - (len(chars) % 4 == 1)]
        try:
            data = base64.b64decode(chars + "=" * (-len(chars) % 4))
        except binascii.Error:
            return
        if format_of(data):
            yield from self.archives(data, at, at + len(run), "base64", layer)
            return
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = ""
        if is_text(text):
            sizes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            n = 1 + (sizes > 0x7F) + (sizes > 0x7FF) + (sizes > 0xFFFF)
            last = np.cumsum(n)
            yield layer.inner(text, at + places[(last - n) * 4 // 3], at + places[-(-last * 4 // 3) - 1] + 1, "base64")
        elif parts and re.search(r"[/\n]", run):
            # a path's slash, or lines that are runs of their own
            for m in re.finditer(r"[A-Za-z0-9+_-]{16,}={0,2}", run):
                yield from self.base64_run(layer, at + m.start(), m[0], parts=False)

    def unwrapped(self, layer: Layer) -> Iterator[Layer]:
        if "%" in layer.text and (made := decoded_in_place(layer, PERCENT, percent_run, "url")):
            yield made
        if "\\" in layer.text and (made := decoded_in_place(layer, ESCAPE, escape_run, "unicode")):
            yield made
        yield from self.runs(layer)

    def layers(self, text: str) -> Iterator[Layer]:
        """The text, then every new layer, depth first; only the open path is held."""
        waiting = [iter([Layer(text)])]
        while waiting:
            layer = next(waiting[-1], None)
            if layer is None:
                waiting.pop()
            elif self.new(layer.digest()):
                yield layer
                waiting.append(self.unwrapped(layer))


def find_secrets(text: str | None) -> tuple[list[Span], dict[Span, tuple[str, str]], int]:
    """The base spans, all spans with the way to the layer that first showed each and the
    text found there, and the number of layers."""
    base: list[Span] = []
    found: dict[Span, tuple[str, str]] = {}
    n = 0
    for layer in Worklist().layers(text or ""):
        matches = scan(layer.text)
        if not n:
            base = matches
        n += 1
        for start, kind, end in matches:
            first, last = layer.origin(start, end)
            found.setdefault((first, kind, last), (layer.via, layer.text[start:end]))
    return base, found, n


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()),
                    ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                                  ("via", pa.string()), ("value", pa.string())])))])
DDL = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, "
       "found array<struct<kind: string, start: long, `end`: long, via: string, value: string>>")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and ``found``: each span with the
    way to its layer (``via``, empty for the text itself) and the text found there."""
    common.ship(docs.sparkSession)

    def row(doc_id: int | None, text: str | None) -> tuple:
        base, found, n_layers = find_secrets(text)
        kinds = [k for _, k, _ in base]
        details = [{"kind": KINDS[k], "start": a, "end": b, "via": via, "value": value}
                   for (a, k, b), (via, value) in sorted(found.items())]
        return (doc_id, *map(kinds.count, range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(list(found)),
                n_layers, details)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i, t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            cols = list(zip(*rows)) or [[]] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SCHEMA.types)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)
