"""Statement files as rows with exact places in the bytes.

Spark lists and deals out the files; one file, of 25 MiB at most by its admission, is read by one task from its bytes. A record
in quotes may span lines, so only a reader in order can tell where one starts. Every record comes with the span of its bytes,
so that a value can be shown where it stands.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codecs in the order in which they are tried, marks between cells, and what one file may hold.
CODECS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
MARKS = (",", ";", "\t", "|")
MOST_ROWS = 200_000
HEAD = 64 * 1024
BOM = b"\xef\xbb\xbf"

RECORD = "path string, sha256 string, record_ordinal int, byte_start long, byte_end long, field_count int, raw_values array<string>, values_digest string"
SUMMARY = "path string, sha256 string, outcome string, reason string, codec string, delimiter string, records int, ragged int, byte_size long"


class Unreadable(ValueError):
    """Why a file cannot be read; it never repeats the file's content."""


def decoded(payload: bytes) -> tuple[str, str]:
    """(text, codec). A NUL is never text, and would pass as latin-1."""
    if b"\0" in payload:
        raise Unreadable("control_bytes")
    for codec in CODECS:
        try:
            return payload.decode(codec), codec
        except UnicodeDecodeError:
            continue
    raise Unreadable("not_text")


def delimiter_of(lines: list[str]) -> str:
    some = [x for x in lines if x.strip()][:20]
    if not some:
        raise Unreadable("empty")
    best, found = (0, 0), ""
    for mark in MARKS:
        counts = [x.count(mark) for x in some]
        score = (sum(c == counts[0] for c in counts), counts[0])
        if counts[0] and score > best:
            best, found = score, mark
    if not found:
        raise Unreadable("single_column")
    return found


def records(payload: bytes, delimiter: str | None = None, header_row: int = 1) -> Iterator[tuple[int, int, int, list[str], str, str]]:
    """(ordinal, first byte, byte after the last, cells, codec, delimiter) of each record that is not blank; blank ones count."""
    text, codec = decoded(payload)
    wire = "utf-8" if codec == "utf-8-sig" else codec
    # lines end at LF only: other separators may stand within a cell
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    lines = lines if lines[-1] else lines[:-1]
    mark = delimiter or delimiter_of(text[: HEAD].split("\n")[header_row - 1 :])
    used = 0

    def feed():
        nonlocal used
        for line in lines:
            used += 1
            yield line

    at, seen = len(BOM) if payload.startswith(BOM) else 0, 0
    for ordinal, cells in enumerate(csv.reader(feed(), delimiter=mark), 1):
        size = sum(len(x.encode(wire)) for x in lines[seen:used])
        if any(c.strip() for c in cells):
            yield ordinal, at, at + size, cells, codec, mark
        at, seen = at + size, used


def values_digest(ordinal: int, cells: list[str]) -> str:
    return hashlib.sha256((f"{ordinal}:{len(cells)}|" + "".join(f"{len(c)}:{c}" for c in cells)).encode()).hexdigest()


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and content of all files below a path; Spark's reader passes by files without a byte."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_statements(contents: DataFrame, delimiter: str | None = None, header_row: int = 1, most: int = MOST_ROWS) -> DataFrame:
    """All records of all files (path, content), header and letterhead too: which rows are data is the mapping's to say."""

    def run(batches):
        for batch in batches:
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, out = hashlib.sha256(payload).hexdigest(), []
                try:
                    for n, (ordinal, a, b, cells, _, _) in enumerate(records(payload, delimiter, header_row)):
                        if n >= most:
                            break
                        out.append((path, digest, ordinal, a, b, len(cells), cells, values_digest(ordinal, cells)))
                        if len(out) == 5000:
                            yield made(out)
                            out = []
                except (Unreadable, csv.Error):
                    pass  # the summary of files says so
                yield made(out)

    def made(out):
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return contents.select("path", "content").mapInArrow(run, RECORD)


def summaries(contents: DataFrame, delimiter: str | None = None, header_row: int = 1, most: int = MOST_ROWS) -> DataFrame:
    """One row for each file: complete, truncated (there are more records than are read) or failed, and why."""

    def run(batches):
        for batch in batches:
            out = []
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = ragged = 0
                width = codec = mark = None
                outcome, reason = "complete", None
                try:
                    for _, _, _, cells, codec, mark in records(payload, delimiter, header_row):
                        if n == most:
                            outcome = "truncated"
                            break
                        n += 1
                        width = width or len(cells)
                        ragged += len(cells) != width
                except Unreadable as e:
                    outcome, reason = "failed", str(e)
                except csv.Error:
                    outcome, reason = "failed", "malformed"
                out.append((path, hashlib.sha256(payload).hexdigest(), outcome, reason, codec, mark, n, ragged, len(payload)))
            types = [pa.string()] * 6 + [pa.int32(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return contents.select("path", "content").mapInArrow(run, SUMMARY)


def sliced(contents: DataFrame, located: DataFrame) -> DataFrame:
    """The exact bytes of each located record."""
    span = F.substring(F.col("content"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
    return located.join(contents.select("path", "content"), "path").select(*located.columns, span.alias("bytes"))


def rendered(df: DataFrame, columns: list[str], delimiter: str = ";") -> bytes:
    """A frame of texts as the bytes of one statement, for samples and tests."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(tuple(r) for r in df.select(*columns).toLocalIterator())
    return out.getvalue().encode()
