"""Secret scans with a worklist of decoded layers.

The text and whatever can be decoded out of it (percent escapes, ``\\u`` escapes, base64, gzip and zlib streams) form a
worklist.  Every layer is scanned; a finding in a layer is mapped back, character by character, to the original text.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

#: Kinds in the order that breaks ties between spans.
KINDS = ("assign", "access", "hex")
_any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as all runs of which short ones are dropped

# Only the first character of a run is tried, and nothing is given back, so that a run is read once.
PERCENT = re.compile(r"(?<![A-Za-z0-9+/_.=:-])(?:[A-Za-z0-9+/_.=:-]*+%[0-9A-Fa-f]{2})++[A-Za-z0-9+/_.=:-]*+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+(?:[A-Za-z0-9+/_.=:-]*(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+)*[A-Za-z0-9+/_.=:-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{4,}+)+={0,2}")
ESCAPED_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")

#: Streams are inflated and scanned by pieces of so many bytes, so that a small stream cannot fill a worker's memory; a piece
#: starts with the end of the one before it, a stream within a stream is fed piece by piece.
PIECE, OVERLAP = 1 << 24, 1 << 16
#: Where more of a decoded layer's characters are control characters or bytes that are no text, it needs a stretch that could
#: hold a finding.
BINARY = 0.3
STRETCH = re.compile(rb"[\x20-\x7e]{12,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if re.search("[:=]", text) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _is_stream(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a gzip or zlib stream that comes in chunks holds, also one that breaks off; gzip members may follow one another."""
    box = zlib.decompressobj(47)
    for rest in chunks:
        while True:
            try:
                piece = box.decompress(rest, PIECE)
            except zlib.error:
                return
            if piece:
                yield piece
            rest = box.unconsumed_tail
            if box.eof:
                rest = box.unused_data
                if rest[:2] != b"\x1f\x8b":
                    return
                box = zlib.decompressobj(47)
            elif not piece and not rest:
                break


def _opened(chunks: Iterator[bytes], above: frozenset = frozenset()) -> Iterator[bytes]:
    """The chunks themselves, or, as long as they are a stream, what it inflates to.  A stream may hold itself: it ends there."""
    first = next(chunks, b"")
    if not _is_stream(first):
        yield first
        yield from chunks
        return
    mark = hashlib.sha256(first).digest()
    if mark in above:
        return
    inner = _inflate(chain([first], chunks))
    if (start := next(inner, None)) is None:
        yield first
        yield from chunks
    else:
        yield from _opened(chain([start], inner), above | {mark})


_CODE = np.zeros(256, bool)
_CODE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\r\n\t ")] = True


def _overlapping(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Each chunk after the end of those before; where that end is inside base64 it starts at a whole group of four."""
    kept = b""
    for chunk in chunks:
        piece = kept + chunk
        yield piece
        cut = max(0, len(piece) - OVERLAP)
        head = np.frombuffer(piece, np.uint8)[:cut]
        other = np.flatnonzero(~(_CODE[head] | _BLANK[head]))
        run = int(other[-1]) + 1 if len(other) else 0
        code = np.flatnonzero(_CODE[head[run:]])
        if len(code) and cut - run - int(code[-1]) <= 2:  # else the run ended before
            gap = np.flatnonzero(np.diff(code) > 3)  # a line break takes three characters at most; blanks beyond that part runs
            code = code[gap[-1] + 1 :] if len(gap) else code
            over = len(code) % 4
            cut = run + int(code[len(code) - over]) if over else cut
        kept = piece[cut:]


#: Where each character of a decoded text starts and ends in what it was decoded from; None: it stands for the whole.
Places = tuple[np.ndarray, np.ndarray] | None


def _text(data: bytes, lenient: bool = False) -> tuple[str, np.ndarray] | None:
    """UTF-8, else (one byte in ten or more is not) Latin-1, and where each character starts; None where much of it is no text
    (``lenient``: and no stretch of it is)."""
    if not data:
        return None
    got = data.decode("utf-8", "replace")
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    if got.count("\ufffd") * 10 > len(got):
        got, lead = data.decode("latin-1"), np.ones(len(data), bool)
    elif "\ufffd" in got:
        replaced: list[tuple[int, int]] = []

        def note(e: UnicodeDecodeError) -> tuple[str, int]:
            replaced.append((e.start, e.end))
            return "\ufffd", e.end

        codecs.register_error("ledgerloom-note", note)
        data.decode("utf-8", "ledgerloom-note")
        for start, end in replaced:
            lead[start:end] = False
            lead[start] = True
    strange = sum(map(got.count, _CONTROLS)) + got.count("\ufffd")
    return (got, np.flatnonzero(lead)) if strange <= BINARY * len(got) or lenient and STRETCH.search(data) else None


#: C0 but tab, line feed and carriage return, and C1.  NUL counts too: UTF-16 is read by ``_layers``.
_CONTROLS = [chr(c) for c in (*range(9), 11, 12, *range(14, 32), *range(127, 160))]


def _layers(data: bytes) -> Iterator[tuple[str, Places]]:
    """The texts that decoded bytes hold: of a stream what it inflates to, in the end, else their own."""
    if _is_stream(data):
        pieces = _overlapping(_opened(iter([data])))
        first = next(pieces, b"")
        if first != data:
            yield from ((text, None) for piece in chain([first], pieces) for text, _ in _plain(piece))
            return
    yield from _plain(data)


def _plain(data: bytes) -> Iterator[tuple[str, Places]]:
    wide = next((kind for kind, odd in (("utf-16-le", 1), ("utf-16-be", 0)) if len(data) >= 8 and data[odd::2].count(0) * 3 > len(data)), None)
    if wide:
        got = data.decode(wide, "replace")
        starts = np.arange(len(got)) * 2
        yield got, (starts, np.minimum(starts + 2, len(data))) if 2 * len(got) == len(data) else None
        return
    found = _text(data)
    kept = np.arange(len(data))
    if found is None and 0 < data.count(0) * 2 < len(data):
        kept = np.flatnonzero(np.frombuffer(data, np.uint8))
        found = _text(data.replace(b"\0", b""))
    if found is None:
        kept, found = np.arange(len(data)), _text(data, True)
    if found:
        text, starts = found
        ends = np.append(starts[1:], len(kept)) - 1
        yield text, (kept[starts], kept[ends] + 1)


def _onto(layers: Iterator[tuple[str, Places]], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, Places]]:
    """Layers of bytes, their places brought from the bytes to the characters that each byte was decoded from."""
    for text, places in layers:
        yield text, None if places is None else (starts[places[0]], ends[places[1] - 1])


def _decoded(kind: str, s: str) -> Iterator[tuple[str, Places]]:
    if kind == "percent":
        raw = np.frombuffer(s.encode(), np.uint8)
        at = np.array([m.start() for m in ESCAPED_BYTE.finditer(s)])
        keep = np.ones(len(raw), bool)
        keep[at + 1] = keep[at + 2] = False
        starts = np.flatnonzero(keep)
        yield from _onto(_layers(unquote_to_bytes(s)), starts, np.append(starts[1:], len(s)))
    elif kind == "unicode":
        letters, starts, at = [], [], 0
        for m in ESCAPE.finditer(s):
            letters += s[at : m.start()]
            starts += range(at, m.start())
            c, at = chr(int(m[1] or m[2], 16)), m.end()
            if "\udc00" <= c <= "\udfff" and letters and "\ud800" <= letters[-1] <= "\udbff":
                letters[-1] = (letters[-1] + c).encode("utf-16", "surrogatepass").decode("utf-16")
            else:
                letters.append(c)
                starts.append(m.start())
        letters += s[at:]
        starts += range(at, len(s))
        got = "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in letters)
        first = np.array(starts)
        last = np.append(first[1:], len(s))
        yield got, (first, last)
        if "\\x" in s and max(got) <= "\xff":  # \x escapes may stand for bytes
            yield from _onto(_layers(got.encode("latin-1")), first, last)
    else:
        place = np.array([k for k, c in enumerate(s) if not c.isspace()]) if any(map(s.count, " \t\r\n")) else np.arange(len(s))
        body = "".join(s.split()).rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            data = base64.b64decode((body + "=" * (-len(body) % 4)).translate({45: "+", 95: "/"}), validate=True)
        except (binascii.Error, ValueError):
            return
        k = np.arange(len(data)) * 8
        yield from _onto(_layers(data), place[k // 6], place[(k + 7) // 6] + 1)


def encoded_parts(text: str):
    """(kind, start, end) of the parts of ``text`` that may decode to another layer."""
    if "%" in text:
        yield from (("percent", m.start(), m.end()) for m in PERCENT.finditer(text))
    if "\\" in text:
        yield from (("unicode", m.start(), m.end()) for m in UNICODE.finditer(text))
    yield from (("base64", m.start(), m.end()) for m in BASE64.finditer(text))
    if "\n" in text:
        yield from (("base64", m.start(), m.end()) for m in WRAPPED.finditer(text))


class _Layer:
    """A decoded text, and where its characters stand in the outermost text (``up`` None: it is that text)."""

    def __init__(self, text: str, up: _Layer | None = None, start: int = 0, end: int = 0, places: Places = None):
        self.text, self.up, self.start, self.end, self.places = text, up, start, end, places

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The outermost text's characters that the characters from a to b come from."""
        layer = self
        while layer.up is not None:
            if layer.places is None:
                a, b = layer.start, layer.end
            else:
                a, b = layer.start + int(layer.places[0][a]), layer.start + int(layer.places[1][b - 1])
            layer = layer.up
        return a, b


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each sorted by start, then kind, then end and without repeats.

    A finding in a decoded layer has the span of the characters that it was decoded from (of a compressed stream: of the
    whole stream).  A layer is identified by its content: one that was seen at the same place is not opened again, so the
    list of layers ends even where decoding leads back to an earlier layer.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda spans: sorted(set(spans), key=lambda x: (x[1], rank[x[0]], x[2]))
    base = base_spans(text)

    def inside(layer: _Layer) -> Iterator[_Layer]:
        for kind, start, end in encoded_parts(layer.text):
            part = layer.text[start:end]
            for inner, places in _decoded(kind, part):
                if inner and inner != part:
                    yield _Layer(inner, layer, start, end, places)

    found, opened = list(base), set()
    work = [inside(_Layer(text))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span(0, len(layer.text)))
        if mark in opened:
            continue
        opened.add(mark)
        found += [(kind, *layer.span(a, b)) for kind, a, b in base_spans(layer.text)]
        work.append(inside(layer))
    return order(base), order(found)


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, and all spans.

    Null text is empty text: no spans, digest of the empty string.  Repeated rows and null keys stay as they are;
    a span is (start, end) in code points, end exclusive.
    """

    def make(texts: list[str]) -> dict:
        out: dict = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded")}
        for t in texts:
            base, every = scan(t)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(every))
            out["n_decoded"].append(len(every) - len(base))
        return out

    return per_text(docs, [key], text, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")
