"""Secret scans: a worklist of decoded layers, each scanned, each mapped back.

Every layer of a text is scanned for secrets. Parts that look encoded (URL
escapes, Unicode escapes, base64, base64 of gzip, zlib or bzip2 data) are decoded into
further layers until nothing new comes out. Escapes are decoded in place, with the plain
text around them; base64 may go over line breaks. A layer whose content was seen
before is not opened again, so cycles end. A secret found in a layer is reported
at the span of the whole text's characters that it was decoded from.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from itertools import accumulate, chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from tallywright.llm.tasks import arrow_map, batch

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Names of the ASCII characters that HTML has names for.
_NAMED = {name.removesuffix(";"): char for name, char in html5.items() if name.endswith(";") and len(char) == 1 and char < "\x80"}
_ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});?"
    r"|\\([0-3][0-7]{2})|&#([0-9]{1,7});?|&(" + "|".join(sorted(_NAMED)) + ");"
)
#: Bases of the numbers in the groups of an escape.
_BASES = (16, 16, 16, 16, 16, 8, 10)
#: Base64 of one line, or over single line breaks.
_BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}"
    r"|[A-Za-z0-9+/_-]{16,}={0,2}"
)
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_LEAST_BASE64 = 16
#: How compressed data begin in base64, behind a mark that may belong to a path or name.
_PACKED_HEAD = re.compile(r"(?<=[+/])(?:H4sI|Qlpo|e[AFJN])")
#: Bytes that may be text, as many as the shortest base64 holds.
_TEXT_BYTES = re.compile(rb"[\x09\x0A\x0D\x20-\x7E\x80-\xF4]{12,}")
_PRINTABLE = re.compile(r"[^\x09\x0A\x0D\x20-\x7E\x80-퟿-\U0010FFFF]")

#: A compressed layer is opened in pieces of so many bytes.
PIECE_BYTES = 1 << 20
#: No secret, escape or encoded run goes on here: behind a character that none holds, or
#: between words. Pieces end, and stretches with escapes are decoded, from border to border.
_BORDER = re.compile(r"[^A-Za-z0-9+/_.=\"':%\\&#;{}\s-]|(?<=\s)[A-Za-z0-9.]+\x20(?=[A-Za-z0-9])")


@dataclass
class Layer:
    """A text, where its characters come from, and how it was reached."""

    text: str
    path: tuple[str, ...] = ()
    #: None: all characters come from ``span``. Else the start of each one, and the end.
    origin: list[int] | None = None
    span: tuple[int, int] = (0, 0)
    #: None: all is new. Else where the characters lie that the last step decoded, in turn.
    fresh: list[tuple[int, int]] | None = None

    def is_new(self, start: int, end: int) -> bool:
        """Whether a part holds or touches what the last step decoded."""
        if self.fresh is None:
            return True
        at = bisect_left(self.fresh, start, key=itemgetter(1))
        return at < len(self.fresh) and self.fresh[at][0] <= end

    def back(self, start: int, end: int) -> tuple[int, int]:
        if not self.path:
            return start, end
        if self.origin is None:
            return self.span
        return self.origin[start], self.origin[end]


@dataclass
class Found:
    """Secrets of one text: its own, and those of decoded layers."""

    base: list[tuple[int, int, int]] = field(default_factory=list)
    nested: set[tuple[int, int, str]] = field(default_factory=set)

    def base_text(self) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(self.base))

    def spans(self) -> list[tuple[int, int, str]]:
        """``start, end, kind`` of all spans, by start, base kinds first."""
        own = [(start, 0, kind, "", end) for start, kind, end in self.base]
        own += [(start, 1, 0, kind, end) for start, end, kind in self.nested]
        return [
            (start, end, kind_name if nested else KINDS[kind])
            for start, nested, kind, kind_name, end in sorted(own)
        ]


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """``start, kind, end`` of the secrets that stand in a text as it is."""
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        for found in _ASSIGN.finditer(text):
            if found.end(2) - found.start(2) >= 6:
                yield found.start(), 0, found.end()
    if "AKIA" in text:
        for found in _ACCESS.finditer(text):
            yield found.start(), 1, found.end()
    for found in _HEX.finditer(text):
        yield found.start(), 2, found.end()


def _positions(layer: Layer, start: int, pieces: list[tuple[str, int]]) -> tuple[str, list[int]]:
    """Decoded text and where each of its characters starts, of (text, source length) pieces."""
    text, origin, at = [], [], start
    for piece, length in pieces:
        text.append(piece)
        if len(piece) == length:
            origin += [layer.back(i, i)[0] for i in range(at, at + length)]
        else:
            origin += [layer.back(at, at)[0]] * len(piece)
        at += length
    origin.append(layer.back(at, at)[1] if layer.path else at)
    return "".join(text), origin


def _escaped(found: re.Match) -> str:
    """The character that an escape stands for."""
    if found.lastindex > len(_BASES):
        return _NAMED[found[found.lastindex]]
    code = int(found[found.lastindex], _BASES[found.lastindex - 1])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unescaped(layer: Layer, start: int, raw: str, pattern: re.Pattern, name: str) -> Layer:
    """A stretch with its escapes decoded in place."""
    pieces, fresh, at, size = [], [], 0, 0
    for found in pattern.finditer(raw):
        pieces.append((raw[at : found.start()], found.start() - at))
        size += found.start() - at
        if name == "url":
            value = binascii.unhexlify(found[0].replace("%", "")).decode("utf-8", "replace")
        else:
            value = _escaped(found)
        pieces.append((value, found.end() - found.start()))
        fresh.append((size, size + len(value)))
        size += len(value)
        at = found.end()
    pieces.append((raw[at:], len(raw) - at))
    path = (*layer.path, name)
    if layer.origin is None and layer.path:
        return Layer("".join(piece for piece, _ in pieces), path, None, layer.span, fresh)
    text, origin = _positions(layer, start, pieces)
    return Layer(text, path, origin, fresh=fresh)


def _packing(data: bytes) -> str | None:
    """How data are compressed, by their first bytes."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if data[:3] == b"BZh" else None


def _inflated(data: bytes) -> Generator[tuple[str, bytes], None, int]:
    """Pieces of what gzip, zlib or bzip2 data hold, all members, as far as they can be read.

    Returns how many bytes of ``data`` that took.
    """
    rest = data
    while (name := _packing(rest)) is not None:
        opener = bz2.BZ2Decompressor() if name == "bzip2" else zlib.decompressobj(47)
        feed = rest
        try:
            while not opener.eof:
                piece = opener.decompress(feed, PIECE_BYTES)
                feed = b"" if name == "bzip2" else opener.unconsumed_tail
                if piece:
                    yield name, piece
                elif not feed and not opener.eof:
                    return len(data)
        except (OSError, zlib.error):
            return len(data) - len(rest) if rest is not data else len(data)
        taken = len(data) - len(opener.unused_data)
        rest = opener.unused_data.lstrip(b"\0")
    return taken if rest is not data else 0


def _in_pieces(data: Iterator[bytes]) -> Iterator[str]:
    """The text of data in pieces, none ending within what belongs together."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), []
    for own in data:
        text = decoder.decode(own)
        border, reach = 0, 4096
        while not border and reach < 2 * max(len(text), 4096):
            low = max(len(text) - reach, 0)
            for found in _BORDER.finditer(text, low):
                border = found.end()
            reach *= 16
        if border:
            yield "".join([*held, text[:border]])
            held = []
        held.append(text[border:])
    held.append(decoder.decode(b"", True))
    if any(held):
        yield "".join(held)


def _unpacked(layer: Layer, start: int, raw: str) -> Iterator[Layer]:
    """What base64 holds, be it of one line or of several.

    The first lines of a run may be words before the encoded data, the last ones words
    behind them. So data may begin with any line; they end with the last line up to which
    they are text, or where the compressed data end.
    """
    lines = [found.span() for found in _BASE64_LINE.finditer(raw)]
    body = "".join([raw[low:high] for low, high in lines]).replace("-", "+").replace("_", "/")
    ends = list(accumulate(high - low for low, high in lines))
    if len(body) < _LEAST_BASE64:
        return
    streams: dict[int, bytes] = {}

    def stream(skew: int) -> bytes:
        if skew not in streams:
            own = body[skew:]
            own = own[:-1] if len(own) % 4 == 1 else own
            streams[skew] = binascii.a2b_base64(own + "=" * (-len(own) % 4))
        return streams[skew]

    def span(first: int, last: int) -> tuple[int, int]:
        end = len(raw) if last == len(lines) - 1 else lines[last][1]
        return layer.back(start + lines[first][0], start + end)[0], layer.back(start, start + end)[1]

    first, read = 0, []
    while first < len(lines):
        begin = ends[first - 1] if first else 0
        skew = begin % 4
        data = stream(skew)
        at = (begin - skew) // 4 * 3
        stops = ((ends[line] - skew) * 3 // 4 for line in range(first, len(ends)))
        last = None
        if _packing(data[at : at + 3]) is not None:
            last = yield from _opened(layer, data[at:], first, ends, begin, span)
        if last is None:
            last, text = _readable(data, at, stops)
            last = None if last is None else first + last
            if last is not None and ends[last] - begin >= _LEAST_BASE64:
                yield Layer(text, (*layer.path, "base64"), None, span(first, last))
        if last is not None:
            read.append((begin, ends[last]))
        first = first + 1 if last is None else last + 1
    if sum(high - low for low, high in read) < len(body):
        yield from _glued(layer, start, raw, lines, ends, body, stream, read)


def _glued(layer: Layer, start: int, raw: str, lines, ends, body: str, stream, read) -> Iterator[Layer]:
    """What base64 holds that stands behind other characters of its alphabet, such as a path or a name.

    Where it begins is not known, so all four ways to cut a run are read, and whatever text
    they hold is a layer; so are compressed data behind a mark. Parts that have been
    read already, between the borders ``read`` of the run, are left out.
    """

    def is_read(low: int, high: int) -> bool:
        at = bisect_right(read, low, key=itemgetter(1))  # the parts are in order and apart
        return at < len(read) and read[at][0] < high

    def place(offset: int) -> int:
        line = min(bisect_right(ends, offset), len(ends) - 1)
        return start + lines[line][0] + offset - (ends[line - 1] if line else 0)

    def span(low: int, high: int) -> tuple[int, int]:
        end = start + len(raw) if high >= len(body) else place(high - 1) + 1
        return layer.back(place(low), end)[0], layer.back(place(low), end)[1]

    for head in _PACKED_HEAD.finditer(body):
        low = head.start()
        data = stream(low % 4)[low // 4 * 3 :]
        if is_read(low, low + 4) or _packing(data[:3]) is None:
            continue
        for name, members in groupby(_inflated(data), itemgetter(0)):
            for text in _in_pieces(piece for _, piece in members):
                yield Layer(text, (*layer.path, "base64", name), None, span(low, len(body)))
    for skew in range(4):
        for found in _TEXT_BYTES.finditer(stream(skew)):
            low = skew + found.start() // 3 * 4 + found.start() % 3
            high = min(skew + -(-found.end() * 4 // 3), len(body))
            text = found[0].decode("utf-8", "ignore")
            if not is_read(low, high) and len(text) >= 12 and not _PRINTABLE.search(text):
                yield Layer(text, (*layer.path, "base64"), None, span(low, high))


def _opened(layer: Layer, data: bytes, first: int, ends: list[int], begin: int, span) -> Generator[Layer, None, int | None]:
    """Layers of compressed data; returns the last line they take, None if nothing can be read."""
    last = len(ends) - 1
    if last > first:
        pieces = _inflated(data)
        try:
            while True:
                next(pieces)
        except StopIteration as done:
            last = min(bisect_left(ends, begin + -(-done.value * 4 // 3)), last)
    packed = False
    for name, members in groupby(_inflated(data), itemgetter(0)):
        for text in _in_pieces(piece for _, piece in members):
            packed = True
            yield Layer(text, (*layer.path, "base64", name), None, span(first, last))
    return last if packed else None


def _readable(data: bytes, at: int, stops: Iterator[int]) -> tuple[int | None, str]:
    """The last of some lines up to which data are printable text, and that text."""
    decoder, texts, last, kept = codecs.getincrementaldecoder("utf-8")(), [], None, 0
    for line, stop in enumerate(stops):
        try:
            text = decoder.decode(data[at:stop])
        except UnicodeDecodeError:
            break
        if _PRINTABLE.search(text):
            break
        at = stop
        texts.append(text)
        if not decoder.getstate()[0]:
            last, kept = line, len(texts)
    return last, "".join(texts[:kept])


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers one step below a layer."""
    text = layer.text
    for found in _BASE64.finditer(text):
        if layer.is_new(*found.span()):
            yield from _unpacked(layer, found.start(), found[0])
    url = _URL_RUN.search(text) is not None
    if url or _ESCAPE.search(text):
        low = 0
        for high in chain((found.end() for found in _BORDER.finditer(text)), (len(text),)):
            for pattern, name in ((_URL_RUN, "url"), (_ESCAPE, "unicode")):
                if pattern.search(text, low, high):
                    yield _unescaped(layer, low, text[low:high], pattern, name)
            low = high


def scan(text: str) -> Found:
    """All secrets of a whole text, those of decoded layers included."""
    found = Found(base=list(matches(text)))
    seen: set[bytes] = set()
    #: Where secrets stand by themselves, and the shortest way there.
    exact: dict[tuple[int, int, int], tuple[str, ...]] = {}
    waiting: Iterator[Layer] = decoded(Layer(text))
    layers = [waiting]
    while layers:
        layer = next(layers[-1], None)
        if layer is None:
            layers.pop()
            continue
        mark = hashlib.blake2b(
            f"{layer.span if layer.origin is None else layer.origin[:1]}\0{layer.text}".encode("utf-8", "replace"),
            digest_size=16,
        ).digest()
        if mark in seen:
            continue
        seen.add(mark)
        name = "+".join(layer.path)
        for start, kind, end in matches(layer.text):
            if not layer.is_new(start, end):
                continue
            left, right = layer.back(start, end)
            if layer.origin is None:
                found.nested.add((left, right, f"{KINDS[kind]}@{name}"))
            else:
                known = exact.setdefault((left, right, kind), layer.path)
                if len(layer.path) < len(known):
                    exact[left, right, kind] = layer.path
        layers.append(decoded(layer))
    found.nested |= {(left, right, f"{KINDS[kind]}@{'+'.join(path)}") for (left, right, kind), path in exact.items()}
    own = {(start, end) for start, _, end in found.base}
    found.nested = {x for x in found.nested if (x[0], x[1]) not in own}
    return found


def _texts(part: pa.RecordBatch) -> list[str]:
    return [value or "" for value in part.column("text").to_pylist()]


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [scan(text) for text in _texts(part)]
        counts = [[sum(kind == k for _, kind, _ in one.base) for one in found] for k in range(3)]
        spans = [one.spans() for one in found]
        yield batch(
            doc_id=part.column("doc_id"),
            n_assign=pa.array(counts[0], pa.int64()),
            n_access=pa.array(counts[1], pa.int64()),
            n_hex=pa.array(counts[2], pa.int64()),
            base=pa.array([one.base_text() for one in found], pa.string()),
            starts=pa.array([[s for s, _, _ in one] for one in spans], pa.list_(pa.int64())),
            ends=pa.array([[e for _, e, _ in one] for one in spans], pa.list_(pa.int64())),
            kinds=pa.array([[k for _, _, k in one] for one in spans], pa.list_(pa.string())),
        )


def find_secrets(documents: DataFrame) -> DataFrame:
    """Every secret of every document, one row per document.

    Returns ``doc_id, n_assign, n_access, n_hex``, the joined base spans ``base``,
    and all spans as ``starts, ends, kinds`` (code points, end exclusive, by
    start). The kind of a secret of a decoded layer is followed by ``@`` and the
    steps that led there.

    A null or empty text has no spans. Repeated rows each give a row, a null
    ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """
    return arrow_map(
        documents.select("doc_id", "text"),
        _digest,
        "doc_id long, n_assign long, n_access long, n_hex long, base string, "
        "starts array<long>, ends array<long>, kinds array<string>",
    )


def redact(text: str, mark: str) -> str:
    """A text with each run of overlapping secrets replaced by a mark."""
    pieces, at = [], 0
    for start, end, _ in scan(text).spans():
        if start >= at:
            pieces += [text[at:start], mark]
            at = end
        else:
            at = max(at, end)
    return "".join(chain(pieces, [text[at:]])) if pieces else text


def _redact(mark: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [None if x is None else redact(x, mark) for x in part.column("text").to_pylist()]
            lengths = [None if x is None else len(x) for x in texts]
            columns = {name: part.column(name) for name in part.schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(lengths, pa.int64())
            yield batch(**columns)

    return run


def redact_secrets(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret, nested ones included, replaced by a mark.

    Columns stay as they are but for ``text`` and, if there is one, ``n_chars``,
    which is the length of the new text. A null text stays null.
    """
    return arrow_map(documents, _redact(mark), documents.schema)
