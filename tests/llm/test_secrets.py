"""Hidden secrets: streams end where they end, decoys hide nothing, and what stands around stays."""

from __future__ import annotations

import base64
import gzip
import random
import re
import urllib.parse
import zlib

import pytest

from tallyforge.llm import secrets

from .test_operators import prose

SECRET = "token=abcdefgh1234"
LONG = f"some words before it, then {SECRET} and much more text that fills the lines of it all"
BYTES = lambda raw: raw.decode("latin-1")
Z, G = zlib.compress(f"{SECRET} and other words".encode()), gzip.compress(f"{SECRET} and other words".encode())
INDENT = lambda text, by: "\n".join(by + line for line in text.splitlines())
#: What hides it, and what stands around: (before, hidden, after).
CASES = {
    "stream, then text": ("head ", BYTES(Z), " tail of an innocent story"),
    "escaped stream, then text": ("head ", "".join(f"\\x{b:02x}" for b in Z), " tail of an innocent story"),
    "quoted stream, then text": ("head ", urllib.parse.quote(Z), " tail of an innocent story"),
    "a decoy before": ("x^2 plus one. ", BYTES(Z), " tail"),
    "a stream before": (BYTES(zlib.compress(b"nothing in here at all")) + " ", BYTES(G), " tail"),
    "text before a stream in base64": ("head ", base64.b64encode(b"data: " + G).decode(), " tail"),
    "letters in the line before": ("attachment_content\n", base64.encodebytes(LONG.encode()).decode(), "tail."),
    "indented lines": ("head:\n", INDENT(base64.encodebytes(LONG.encode()).decode(), "    "), "\n\ntail"),
    "quoted lines of a stream": ("head:\n", INDENT(base64.encodebytes(gzip.compress((prose(random.Random(5), 90) + SECRET).encode())).decode(), "> "), "\n\ntail"),
    "glued to letters": ("head key", base64.b64encode(SECRET.encode()).decode(), " tail"),
    "a stream in a stream": ("head ", base64.b64encode(gzip.compress(b"some bytes \xff " + Z + b" and more")).decode(), " tail"),
}


@pytest.mark.parametrize("case", CASES)
def test_what_stands_around_stays(case):
    before, hidden, after = CASES[case]
    text = before + hidden + after
    base, spans = secrets.scan(text)
    found = [(a, b) for kind, a, b in spans if kind == "assign"]
    assert not base and found and all(len(before) - (case == "glued to letters") <= a < b <= len(text) - len(after) for a, b in found), spans
    clean = secrets.redacted(text, spans)
    assert "[REDACTED]" in clean and clean.startswith(before.rstrip("key")) and clean.endswith(after) and not secrets.scan(clean)[1]


def test_a_broken_stream_ends_where_it_breaks():
    tail = " tail of an innocent story, which goes on and on for quite some time"
    text = f"head {BYTES(Z[:-8])}{tail}"
    ((_, a, b),) = secrets.scan(text)[1]
    assert a == 5 and b < len(text) - len(tail) + 32


def opened(text: str, depth: int = 3) -> set[str]:
    """Secrets found by trying every offset of every layer."""
    found = {m[2] for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8}
    if not depth:
        return found
    layers = {re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text), re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)} - {text}
    for m in re.finditer("(?=\x1f\x8b|x)", text):
        try:
            layers.add(zlib.decompressobj(47).decompress(text[m.start() :].encode("latin-1", "ignore")).decode("latin-1"))
        except zlib.error:
            pass
    for m in re.finditer(r"[A-Za-z0-9+/\n]{12,}={0,2}", text):
        bare = m[0].replace("\n", "").rstrip("=")
        for k in range(4):
            some = bare[k : len(bare) - ((len(bare) - k) % 4 == 1)]
            layers.add(base64.b64decode(some + "=" * (-len(some) % 4)).decode("latin-1"))
    return found.union(*(opened(x, depth - 1) for x in layers if len(x) > 8))


def test_every_offset_finds_nothing_more():
    rng = random.Random(9)
    wraps = [lambda r: base64.b64encode(r), lambda r: base64.encodebytes(r), zlib.compress, gzip.compress, lambda r: urllib.parse.quote(r).encode(), lambda r: "".join(f"\\x{b:02x}" for b in r).encode()]
    hits = 0
    for n in range(120):
        text = f"{prose(rng, 3)} "
        for k in range(rng.randint(1, 3)):
            raw = f"{prose(rng, rng.randint(0, 9))} password: {n}secret{k}{rng.randint(10**6, 10**9)} ".encode()
            for _ in range(rng.randint(1, 2)):
                raw = rng.choice([b"", b"x^2 ", b"data: "]) + rng.choice(wraps)(raw) + rng.choice([b"", b" and"])
            text += raw.decode("latin-1") + rng.choice([" ", "\n", " x^ ", ""])
        want, (_, spans) = opened(text), secrets.scan(text)
        hits += len(want)
        places = {(a, b) for kind, a, b in spans if kind == "assign"}
        assert not want or places, (text, want)
        assert not opened(secrets.redacted(text, spans)), (text, spans)
    assert hits > 150
