"""Secret scan with a worklist of decoded layers.

A text is scanned as it is. Then every encoding found in it (percent escapes, Unicode escapes, base64 runs, and base64 of
compressed bytes) gives a further layer, which is scanned and searched for encodings in turn until no new layer appears.
A base64 run is decoded from each of its four alignments, over line ends too. Decoded bytes are read as text, and compressed
bytes are unpacked wherever they begin; what is unpacked is a layer like any other, read as text and searched for
further beginnings while it streams by, so that at any depth a window and the state of a decompressor are all that is held.
A layer that was seen before in the same text isn't followed again. Each layer knows which characters of the original
text its characters come from, so a secret found in it has a span in the original.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from tallyloom.llm.common import map_batches, texts_of

#: decoded bytes are read as text in windows of about two of these, which share their ends: so much, or an open run of base64 up to a bound
WINDOW, OVERLAP, CARRY = 2 << 20, 1 << 19, 16 << 20
#: by so many first bytes a layer is known, and so often may one of them lie within another like it: what unpacks to itself ends
HEAD, SAME = 4096, 3
MASK = "[SECRET]"
# fixed values: the three kinds, in the order in which they are listed
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("passw", "secret", "token", "api")
MIN_VALUE = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: a base64 run over several lines: all but the first and the last are whole lines
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
SHORTEST = 16
#: what gzip, zlib, bzip2 and zstd begin with
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd")
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
#: no secret, and no encoding of one, is shorter
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){14}|(?:\0[\t\n\r\x20-\x7e]){14}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap within a kind, sorted."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if max(map(len, text.split()), default=0) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class Layer:
    """A decoded text, and for each of its characters the span of the original that it comes from."""

    text: str
    begin: np.ndarray
    end: np.ndarray

    def original(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a]), int(self.end[b - 1])


def _spliced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with the stretches [a, b) replaced; a replacement's characters come from the whole stretch."""
    text, begin, end, at = [], [], [], 0
    for a, b, new in pieces:
        text += [layer.text[at:a], new]
        begin += [layer.begin[at:a], np.full(len(new), layer.begin[a])]
        end += [layer.end[at:a], np.full(len(new), layer.end[b - 1])]
        at = b
    text.append(layer.text[at:])
    begin.append(layer.begin[at:])
    end.append(layer.end[at:])
    return Layer("".join(text), np.concatenate(begin), np.concatenate(end))


def _percent(layer: Layer) -> Layer | None:
    pieces = []
    for m in PERCENT.finditer(layer.text):
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        for piece in re.split(rb"((?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x00-\x7f]))", raw):
            if piece:
                try:
                    pieces.append((at, at + 3 * len(piece), piece.decode()))
                except UnicodeDecodeError:
                    pass
            at += 3 * len(piece)
    return _spliced(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    pieces = []
    for m in ESCAPE.finditer(layer.text):
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((m.start(), m.end(), chr(code)))
    return _spliced(layer, pieces) if pieces else None


def readings(raw: bytes) -> Iterator[str]:
    """Texts that the bytes may be: UTF-8 with other bytes replaced, and UTF-16. Control characters don't end a text."""
    if PRINTABLE.search(raw):
        yield raw.decode(errors="replace")
    if WIDE.search(raw):
        for part in (raw, raw[1:]):
            for kind in ("utf-16-le", "utf-16-be"):
                yield part[: len(part) & ~1].decode(kind, errors="replace")


class _Bytes:
    """A layer of bytes that streams by: texts in it, and in whatever compressed bytes it holds."""

    def __init__(self, above: tuple[bytes, ...] = ()):
        self.above, self.held, self.fresh, self.limit = above, bytearray(), False, 2 * WINDOW
        self.tail, self.inner = b"", []

    def feed(self, piece: bytes) -> Iterator[str]:
        self.held += piece
        self.fresh = True
        if len(self.held) >= self.limit:
            yield from readings(bytes(self.held))
            run = len(self.held) - len(self.held.rstrip(RUN_BYTES))
            del self.held[: -max(OVERLAP, min(run, CARRY))]
            self.limit, self.fresh = len(self.held) + 2 * WINDOW, False
        for one in self.inner:
            yield from one.feed(piece)
        joined = self.tail + piece
        for start in PACKED.finditer(joined):
            if start.end() > len(self.tail):
                one = _Unpacked(start[0], self.above)
                self.inner.append(one)
                yield from one.feed(memoryview(joined)[start.start() :])
        self.inner = [one for one in self.inner if one.alive]
        self.tail = joined[-3:]

    def close(self) -> Iterator[str]:
        if self.fresh:
            yield from readings(bytes(self.held))
        for one in self.inner:
            yield from one.close()


class _Unpacked:
    """One member or frame, unpacked as its bytes come in. What comes before damage counts; what follows it is found by its own beginning."""

    def __init__(self, magic: bytes, above: tuple[bytes, ...]):
        self.above, self.alive, self.head, self.layer = above, True, bytearray(), None
        if magic[:2] == b"\x1f\x8b":
            self.tool, self.slice = zlib.decompressobj(31), 1 << 16
        elif magic[:1] == b"x":
            self.tool, self.slice = zlib.decompressobj(), 1 << 16
        elif magic[:3] == b"BZh":
            self.tool, self.slice = bz2.BZ2Decompressor(), 1 << 16
        else:  # gives all that it can at once, so it gets little at once
            self.tool, self.slice = zstandard.ZstdDecompressor().decompressobj(), 1 << 9

    def _pieces(self, data: bytes) -> Iterator[bytes]:
        if isinstance(self.tool, bz2.BZ2Decompressor):
            while not self.tool.eof:
                yield self.tool.decompress(data, WINDOW)
                data = b""
                if self.tool.needs_input:
                    return
        elif self.slice == 1 << 9:
            yield self.tool.decompress(data)
        else:
            while data and not self.tool.eof:
                yield self.tool.decompress(data, WINDOW)
                data = self.tool.unconsumed_tail

    def feed(self, data) -> Iterator[str]:
        for at in range(0, len(data), self.slice):
            if not self.alive:
                return
            try:
                for piece in self._pieces(bytes(data[at : at + self.slice])):
                    yield from self._give(piece)
            except (zlib.error, zstandard.ZstdError, OSError, EOFError):
                yield from self.close()
                return
            if self.tool.eof:
                yield from self.close()

    def _give(self, piece: bytes) -> Iterator[str]:
        if self.layer is None:
            self.head += piece
            if len(self.head) < HEAD:
                return
            piece = self._known()
        if self.layer is not None:
            yield from self.layer.feed(piece)

    def _known(self) -> bytes:
        """Open the layer when its first bytes are there, unless it is one that holds itself."""
        mark = hashlib.sha1(self.head[:HEAD]).digest()
        if self.above.count(mark) >= SAME:
            self.alive = False
        else:
            self.layer = _Bytes((*self.above, mark))
        return bytes(self.head)

    def close(self) -> Iterator[str]:
        if self.alive:
            if self.layer is None and self.head:
                piece = self._known()
                if self.layer is not None:
                    yield from self.layer.feed(piece)
            if self.layer is not None:
                yield from self.layer.close()
        self.alive = False


def contents(raw: bytes) -> Iterator[str]:
    """Texts in the bytes, and in what they hold compressed, in any number of layers."""
    layer = _Bytes((hashlib.sha1(raw[:HEAD]).digest(),))
    for at in range(0, len(raw), WINDOW):
        yield from layer.feed(raw[at : at + WINDOW])
    yield from layer.close()


def _base64(run: str) -> Iterator[tuple[int, str]]:
    """Texts of a base64 run and the place in it where they begin.

    A run may take in letters, '/', '_' and '-' that stand before what was encoded. Places a multiple of four apart decode
    alike, so four of them have all texts.
    """
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = bare[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        for text in contents(base64.b64decode(part + "=" * (-len(part) % 4))):
            yield k, text


def layers_of(layer: Layer) -> Iterator[Layer]:
    """The layers that one decoding of each kind gives."""
    if "%" in layer.text and (new := _percent(layer)):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _unicode(layer)):
        yield new
    runs = [(m.start(), m.end(), m[0]) for m in BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        joined = ((m, re.sub(r"\s+", "", m[0])) for m in WRAPPED.finditer(layer.text))
        runs += [(m.start(), m.end(), run) for m, run in joined if len(run) >= SHORTEST]
    for start, end, run in runs:
        for k, text in _base64(run):
            a, b = layer.original(start + k, end)
            yield Layer(text, np.broadcast_to(a, len(text)), np.broadcast_to(b, len(text)))


def encoded(text: str) -> bool:
    """Whether a text may hold a further layer."""
    return "%" in text or "\\" in text or "&#" in text or "\n" in text or max(map(len, text.split()), default=0) >= SHORTEST


def all_spans(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and those of all decoded layers, as (start, kind, end) in the original text, sorted, without repeats.

    Layers are followed depth first and made when they are needed, so that one window of each depth is held.
    """
    found = set(base_spans(text) if base is None else base)
    if not encoded(text):
        return sorted(found)
    place = np.arange(len(text))
    open_layers = [layers_of(Layer(text, place, place + 1))]
    seen = {hashlib.sha1(text.encode(errors="surrogatepass")).digest()}
    while open_layers:
        layer = next(open_layers[-1], None)
        if layer is None:
            open_layers.pop()
            continue
        mark = hashlib.sha1(layer.text.encode(errors="surrogatepass") + layer.begin.tobytes()).digest()
        if mark in seen:
            continue
        seen.add(mark)
        open_layers.append(layers_of(layer))
        for a, kind, b in base_spans(layer.text):
            start, end = layer.original(a, b)
            found.add((start, kind, end))
    return sorted(found)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row; a null text is empty and has none.

    Counts and the hash are of the spans in the text itself. One pass over whole texts, nothing is shuffled; other
    columns are not carried on.
    """

    def step(batch):
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in texts_of(batch):
            base = base_spans(text)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            row = (*counts, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(all_spans(text, base)))
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        yield {"doc_id": batch.column(0), **out}

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(docs.select("doc_id", "text"), step, kinds)


def masked(text: str, mask: str = MASK) -> str:
    """The text with every stretch covered by spans replaced."""
    out, at = [], 0
    for a, _, b in all_spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows with secrets in ``text`` replaced and ``n_chars`` set anew where a text has changed; null texts stay."""
    kept = docs.columns

    def step(batch):
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        new = [None if t is None else masked(t, mask) for t in texts]
        out = {n: batch.column(i) for i, n in enumerate(kept)} | {"text": new}
        if "n_chars" in kept:
            sizes = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
            out["n_chars"] = [s if a == b else len(b) for s, a, b in zip(sizes, texts, new, strict=True)]
        yield out

    return map_batches(docs, step, docs.schema)
