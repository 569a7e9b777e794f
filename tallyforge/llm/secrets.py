r"""Secret scans through a recursive decoding worklist.

Every layer of a text is scanned with the same three patterns. A layer yields new layers: the layer with its URL escapes
undone, with its Unicode escapes undone, what its base64 runs hold, and the content of each compressed stream that stands in it as characters.
A run is decoded from each of its first four characters on, so that an encoded text anywhere in a run of base64 characters is met, whatever stands glued to it; lines of a
wrapped or indented run are read together as well. Decoded bytes are scanned as bytes, one character each, so that streams are opened at any offset between other bytes. New
layers join the worklist until none is left; a layer whose content was seen at the same place is not taken up again, so that no
cycle can go round.

Spans found in a layer are mapped back to the text: through escapes and base64 character by character, through compression to the whole stream, which ends where the
stream itself says so, or where its bytes no longer decode: what follows it is not part of it. Every head of a stream is tried, those inside others too. Inflated content is scanned in windows of
``WINDOW`` bytes that overlap by ``OVERLAP``, so that streams of any size are scanned whole in bounded memory; a layer inside inflated content
that is longer than ``OVERLAP`` and crosses the border of two windows is found only if it is itself a stream at the content's start.

Null and empty texts have no spans. Columns of the result's names are replaced, others are left alone.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from bisect import bisect_right
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, read

KINDS = ("assign", "access", "hex")
#: The patterns of the three kinds, and what a match needs to stay.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
#: A run that goes on in further lines, which may be indented or quoted.
BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{4,}(?:[\t ]*\r?\n[\t >]*[A-Za-z0-9+/_-]{2,})+")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: The beginning of a compressed stream, as characters.
HEAD = re.compile("(?=\x1f\x8b\x08|x[\x01^\x9c\xda])")
#: What a layer must hold to be worth a scan: the beginning of a secret, or of a further layer.
TELLING = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{12}|\x1f\x8b\x08|x[\x01^\x9c\xda]")
WINDOW, OVERLAP = 4 << 20, 64 << 10
#: Stands for bytes and code points that are no text.
LOST = "\ufffd"


def matches(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three kinds in one layer."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and the way back to the text it came from.

    ``pieces`` are (start, end, start above, end above) of the decoded characters, in order; ``inside`` is the one span above
    that holds the whole layer, where characters cannot be told apart. ``sixes`` are the places above of base64 characters, of which
    four hold three of the layer.
    """

    def __init__(self, text: str, above: Layer | None = None, pieces=None, inside=None, sixes=None):
        self.text, self.above, self.pieces, self.inside, self.sixes = text, above, pieces or [], inside, sixes
        self.starts = [p[0] for p in self.pieces]

    def up(self, at: int, end: bool) -> int:
        """Where the character at ``at`` starts above, or ends."""
        if self.sixes:
            return self.sixes[8 * at // 6] if not end else self.sixes[min((8 * at + 7) // 6, len(self.sixes) - 1)] + 1
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at + end
        _, b, pa_, pb = self.pieces[k]
        return (pb if end else pa_) if at < b else pb + at - b + end

    def root(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.above is not None:
            start, end = layer.inside or (layer.up(start, False), layer.up(end - 1, True))
            layer = layer.above
        return start, end


def unescaped(layer: Layer, runs: re.Pattern, decode) -> Layer | None:
    """The layer with every run that ``decode`` can undo replaced; None where there is none."""
    out, pieces, at, size = [], [], 0, 0
    for m in runs.finditer(layer.text):
        chars = decode(m[0])
        if chars is None:
            continue
        out.append(layer.text[at : m.start()])
        size += m.start() - at
        above = m.start()
        for char, width in chars:
            pieces.append((size, size + len(char), above, above + width))
            out.append(char)
            size += len(char)
            above += width
        at = m.end()
    if not pieces:
        return None
    out.append(layer.text[at:])
    return Layer("".join(out), layer, pieces)


def url_chars(run: str) -> list[tuple[str, int]]:
    """The bytes of a run, one character each."""
    return [(chr(b), 3) for b in bytes.fromhex(run.replace("%", ""))]


def unicode_chars(run: str) -> list[tuple[str, int]] | None:
    chars: list[tuple[str, int]] = []
    high = 0
    for m in UNICODE_ONE.finditer(run):
        code = int(m[1] or m[2] or m[3], 16)
        width = len(m[0])
        if high and 0xDC00 <= code < 0xE000:
            chars[-1] = (chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00), chars[-1][1] + width)
            high = 0
            continue
        high = code if 0xD800 <= code < 0xDC00 else 0
        # a surrogate without its other half, or a number beyond all characters
        chars.append((LOST if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code), width))
    return chars if any(c != LOST for c, _ in chars) else None


def packed(raw: bytes) -> bool:
    """Whether the bytes begin as a gzip or zlib stream does."""
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] << 8 | raw[1]) % 31 == 0


def inflated(chunks):
    """The content of gzip or zlib streams, one after the other, in bounded chunks; it ends where a stream is broken."""
    engine = zlib.decompressobj(47)
    for data in chunks:
        while data:
            try:
                out = engine.decompress(data, WINDOW)
            except zlib.error:
                return
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                if not packed(data):
                    return
                engine = zlib.decompressobj(47)
    with contextlib.suppress(zlib.error):
        if rest := engine.flush():
            yield rest


def opened(raw: bytes, times: int):
    """Chunks of the bytes, inflated so many times."""
    chunks = iter([raw])
    for _ in range(times):
        chunks = inflated(chunks)
    return chunks


def content(raw: bytes):
    """Chunks of the bytes, inflated as often as they are compressed; a stream that holds itself is opened once, and what only looks
    like a stream is left as it is."""
    times, first, met = 0, raw, set()
    while packed(first) and (mark := hashlib.sha256(first).digest()) not in met:
        met.add(mark)
        if (first := next(opened(raw, times + 1), None)) is None:
            break
        times += 1
    return opened(raw, times)


def in_windows(chunks):
    """Chunks as text, one character a byte, in overlapping windows; those without anything telling are left out."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) >= WINDOW:
            if TELLING.search(held):
                yield held.decode("latin-1")
            held = held[-OVERLAP:]
    if TELLING.search(held):
        yield held.decode("latin-1")


def windows(raw: bytes):
    return in_windows(content(raw))


def stream_end(raw: bytes) -> int:
    """How many bytes of ``raw`` the stream at its beginning takes; up to where it breaks off, if it does not end; 0 if it holds nothing."""
    engine, at, made = zlib.decompressobj(47), 0, False
    while at < len(raw) and not engine.eof:
        before, data = engine.copy(), raw[at : at + 4096]
        try:
            while data and not engine.eof:
                made |= bool(engine.decompress(data, WINDOW))
                data = engine.unconsumed_tail
        except zlib.error:
            # the byte at which it breaks
            with contextlib.suppress(zlib.error):
                for k in range(at, len(raw)):
                    data = raw[k : k + 1]
                    while data:
                        made |= bool(before.decompress(data, WINDOW))
                        data = before.unconsumed_tail
                    at = k + 1
            return at if made else 0
        at += 4096
    if engine.eof:
        return min(at, len(raw)) - len(engine.unused_data) if made else 0
    with contextlib.suppress(zlib.error):
        made |= bool(engine.flush())
    return len(raw) if made else 0


def streams(layer: Layer):
    """Layers of what the compressed streams in ``layer`` hold."""
    text = layer.text
    for m in HEAD.finditer(text):
        a = m.start()
        raw, most = b"", 1 << 16
        # as far as the characters are bytes; most streams are short
        while True:
            stop = min(len(text), a + most)
            try:
                raw = text[a:stop].encode("latin-1")
                cut = False
            except UnicodeEncodeError as e:
                raw, cut = text[a : a + e.start].encode("latin-1"), True
            size = stream_end(raw)
            if size < len(raw) or cut or stop == len(text):
                break
            most *= 16
        if size:
            whole = raw[:size]
            # a stream at the content's start may be followed by other bytes
            outer = in_windows(opened(whole, 1)) if packed(next(opened(whole, 1), b"")) else ()
            for found in chain(windows(whole), outer):
                yield Layer(found, layer, inside=(a, a + size))


def base64_layers(layer: Layer):
    """Layers of what base64 runs hold, from each of their first four characters on; lines of one run together, too."""
    text = layer.text
    runs = [range(*m.span()) for m in BASE64_RUN.finditer(text)]
    if "\n" in text:
        for m in BASE64_LINES.finditer(text):
            runs.append([k for part in BASE64_LINE.finditer(text, *m.span()) for k in range(*part.span())])
    for places in runs:
        chars = text[places[0] : places[-1] + 1] if isinstance(places, range) else "".join([text[k] for k in places])
        chars = chars.replace("-", "+").replace("_", "/")
        for first in range(4):
            some = chars[first:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            if len(some) < 11:
                continue
            raw = base64.b64decode(some + "=" * (-len(some) % 4))
            if TELLING.search(raw):
                yield Layer(raw.decode("latin-1"), layer, sixes=places[first : first + len(some)])


def below(layer: Layer):
    """The layers that one step of decoding finds in ``layer``."""
    text = layer.text
    if "%" in text and (made := unescaped(layer, URL_RUN, url_chars)):
        yield made
    if "\\" in text and (made := unescaped(layer, UNICODE_RUN, unicode_chars)):
        yield made
    yield from streams(layer)
    yield from base64_layers(layer)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by start and then kind."""
    base = matches(text)
    spans = set(base)
    work, seen = [below(Layer(text))], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        place = layer.root(0, len(layer.text))
        mark = (place, hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest())
        if mark not in seen:
            seen.add(mark)
            spans.update((kind, *layer.root(a, b)) for kind, a, b in matches(layer.text))
            work.append(below(layer))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str, spans, mark: str = "[REDACTED]") -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += [text[at:a], mark] if a > end or end < 0 else []
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex (of base spans), base_spans and spans, both as kind:start:end joined by commas,
    and with ``redact`` the text with its secrets replaced; else without the text."""
    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_spans": "string", "spans": "string"}
    keep = [c for c in docs.columns if c not in new and (redact or c != text)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in new.items()])

    def work(texts, part):
        found = [scan(t) for t in texts]
        out = {c: part.column(part.schema.get_field_index(c)) for c in keep}
        if redact:
            out[text] = pa.array([None if not old.is_valid else redacted(t, spans) for old, t, (_, spans) in zip(out[text], texts, found, strict=True)], pa.string())
        for kind in KINDS:
            out[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64())
        return out | {"base_spans": pa.array([joined(base) for base, _ in found], pa.string()), "spans": pa.array([joined(spans) for _, spans in found], pa.string())}

    return docs.select(*keep, *([] if redact else [text])).mapInArrow(by_step(text, work), schema)


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
