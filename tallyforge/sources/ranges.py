r"""Statements of any size: the records of one file read by as many tasks as it has byte ranges.

A record in quotes may span lines, so where one starts depends on all bytes before. But a range of lines can do only one of two things to a reader that comes to it: each
range is summed up as where it leaves a reader that comes from outside quotes, and one that comes from inside (a map of two states onto
two), with the records that start in either case. These maps compose from range to range, in any grouping, so that a prefix over one small row a
range tells how the reader comes to each, with the number of records and bytes before. Then all ranges emit their records at once, with exact
byte spans. Records that cross the border of ranges are put together from the ends that the summaries hold.

Spark's text source deals the file out, on any file system that it reads; lines end at LF alone. Nothing holds a file or a range as a whole: a task holds a record and a batch of lines,
and no record of more than ``MOST_RECORD`` bytes.

The preamble (codec, mark between cells) is decided on the first 64 KiB, cut at a line's end. Beyond that a codec may still change, as long as every line before was ASCII: what decides
is the first line that is not, and the first line that the codec decided there cannot read ends the file. Both are minima over lines, found by ranges in any order.

``outcomes`` has one row a file: complete, truncated (byte_limit, row_limit, time_limit) or failed (why). Each record carries the state of its file, so that none
of a failed or truncated file passes for one of a whole file; records from the place of failure on are left out. Files without a byte have an
outcome only if the source lists them; blank records are left out and count in the ordinals.
"""

from __future__ import annotations

import csv
import re
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rounds import settled
from .statement import BOM, CODECS, HEAD, Unreadable, decoded, delimiter_of, values_digest

#: What one file may hold.
MOST_ROWS, MOST_BYTES, MOST_SECONDS, MOST_COLUMNS, MOST_CELL = 200_000, 64 * 1024 * 1024, 60.0, 512, 4096
#: Bytes of a record beyond which it is not held; no record within the limits of cells and columns is larger.
MOST_RECORD = 4 * MOST_COLUMNS * MOST_CELL
#: Ranges and files whose rows a join may send to every task.
FEW = 500_000
WIRE = tuple(c for c in CODECS if c != "utf-8-sig")


@dataclass
class Limits:
    rows: int | None = MOST_ROWS
    bytes: int | None = MOST_BYTES
    #: Of one task's parsing.
    seconds: float | None = MOST_SECONDS
    columns: int = MOST_COLUMNS
    cell: int = MOST_CELL


def physical_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, size, block, raw``: each file's lines in order within a range, which ``block`` names by its first byte."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    at = F.col("_metadata")
    return lines.select(at["file_path"].alias("path"), at["file_size"].alias("size"), at["file_block_start"].alias("block"), F.col("value").cast("binary").alias("raw"))


def in_order(lines: DataFrame, info: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with the columns of ``info``, still in the order of the file. ``info`` has a row for each range or file."""
    if info.count() <= FEW:
        return lines.join(F.broadcast(info), keys)
    numbered = lines.withColumn("line_", F.monotonically_increasing_id()).join(info, keys)
    return numbered.repartition("path", "block").sortWithinPartitions("path", "block", "line_").drop("line_")


def runs(batches, keys: int):
    """(key, rows) of consecutive rows that share their first ``keys`` columns; rows come as an iterator."""
    state: dict = {"row": None}

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    source = rows()
    state["row"] = next(source, None)
    while state["row"] is not None:
        key = state["row"][:keys]

        def mine(key=key):
            while state["row"] is not None and state["row"][:keys] == key:
                row = state["row"]
                state["row"] = next(source, None)
                yield row[keys:]

        group = mine()
        yield key, group
        for _ in group:
            pass


def preambles(lines: DataFrame, delimiter: str | None = None, header_row: int = 1) -> DataFrame:
    """``path, codec, mark, width, problem`` of each file, from its first 64 KiB."""

    def run(batches):
        for (path, _), rows in runs(batches, 2):
            head = b""
            for (raw,) in rows:
                if len(head) <= HEAD:
                    head += raw[: HEAD + 1] + b"\n"
            if len(head) > HEAD:
                head = head[: head.rfind(b"\n", 0, HEAD) + 1] or head[:HEAD]
            codec = mark = problem = None
            width = 0
            try:
                text, codec = decoded(head)
                if not text.strip():
                    raise Unreadable("empty")
                some = text.split("\n")
                mark = delimiter or delimiter_of("\n".join(some[header_row - 1 :] if len(some) >= header_row else some)[: 8 * 1024].split("\n"))
                for n, cells in enumerate(csv.reader((x + "\n" for x in some), delimiter=mark), 1):
                    if n == header_row:
                        width = len(cells)
                        break
            except (Unreadable, csv.Error) as e:
                problem = str(e) if isinstance(e, Unreadable) else "malformed"
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((path, pa.string()), ("utf-8" if codec == "utf-8-sig" else codec, pa.string()), (mark, pa.string()), (width, pa.int32()), (problem, pa.string()))], names=["path", "codec", "mark", "width", "problem"])

    return lines.where("block = 0").select("path", "block", "raw").mapInArrow(run, "path string, codec string, mark string, width int, problem string")


class Quotes:
    """How a line leaves a reader: from outside quotes and from inside. A quote opens only where a cell begins; in quotes two of them are one; what
    follows a closing quote belongs to the cell."""

    def __init__(self, mark: str):
        m = re.escape(mark).encode()
        quoted = rb'(?:[^"]|"")*+"[^' + m + rb"]*+"
        cell = rb'(?:"' + quoted + rb'|[^"' + m + rb"][^" + m + rb"]*+|)"
        more = rb"(?:" + m + cell + rb")*+"
        self.whole, self.rest = re.compile(cell + more), re.compile(quoted + more)

    def inside_after(self, raw: bytes, inside: bool) -> bool:
        if b'"' not in raw:
            return inside
        return not (self.rest if inside else self.whole).fullmatch(raw)


SUMMARY = "path string, block long, n_bytes long, n_lines long, " + ", ".join(f"{k}{h} {t}" for h in (0, 1) for k, t in (("to", "boolean"), ("starts", "long"), ("head", "binary"), ("head_bytes", "long"), ("tail", "binary"), ("tail_bytes", "long"))) + ", odd long, odd_utf8 boolean, odd_cp1252 boolean, bad_utf8 long, bad_cp1252 long, nul long"


def summed_up(lines: DataFrame) -> DataFrame:
    """One row for each range. For a reader that comes from outside quotes (0) and from inside (1): whether it ends inside, the records
    that start, the bytes before the first record's start (head) and from the last one's start if it ends inside (tail). Then where the first line that is not ASCII begins and
    which codecs read it, the first line that a codec cannot read, and the first with a NUL; all in bytes from the range's first line."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in SUMMARY.split(", ")]

    def readable(raw, codec):
        try:
            raw.decode(codec)
        except UnicodeDecodeError:
            return False
        return True

    def run(batches):
        for (path, block, mark), rows in runs(batches, 3):
            quotes, at, n = Quotes(mark), 0, 0
            inside, starts, seen = [False, True], [0, 0], [False, False]
            # while no record has started what comes is the head, afterwards the record at hand
            heads, tails, head_bytes, tail_bytes = [[], []], [[], []], [0, 0], [0, 0]
            odd = odd_utf8 = odd_cp1252 = bad_utf8 = bad_cp1252 = nul = None
            for (raw,) in rows:
                if not raw.isascii():
                    utf8, cp1252 = readable(raw, "utf-8"), readable(raw, "cp1252")
                    if odd is None:
                        odd, odd_utf8, odd_cp1252 = at, utf8, cp1252
                    if not utf8 and bad_utf8 is None:
                        bad_utf8 = at
                    if not cp1252 and bad_cp1252 is None:
                        bad_cp1252 = at
                if nul is None and b"\0" in raw:
                    nul = at
                for h in (0, 1):
                    if not inside[h]:
                        starts[h] += 1
                        seen[h], tails[h], tail_bytes[h] = True, [], 0
                    held, size = (tails, tail_bytes) if seen[h] else (heads, head_bytes)
                    if size[h] <= MOST_RECORD:
                        held[h].append(raw)
                    size[h] += len(raw) + 1
                    inside[h] = quotes.inside_after(raw, inside[h])
                at += len(raw) + 1
                n += 1
            out = [path, block, at, n]
            for h in (0, 1):
                open_ = seen[h] and inside[h]
                out += [inside[h], starts[h], b"".join([x + b"\n" for x in heads[h]]), head_bytes[h], b"".join([x + b"\n" for x in tails[h]]) if open_ else b"", tail_bytes[h] if open_ else 0]
            out += [odd, odd_utf8, odd_cp1252, bad_utf8, bad_cp1252, nul]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], names=names)

    return lines.select("path", "block", "mark", "raw").mapInArrow(run, SUMMARY)


def entered(ranges: DataFrame) -> DataFrame:
    """``ranges`` with how a reader comes to each (``inside``), and the records, lines and bytes before; head, tail and what else depends on the state for that state.

    A range that leaves every reader the same fixes the state, one that exchanges the states turns it; all others leave it. So the state before a range is that of the last
    one that fixes it, turned as often as ranges since then turn."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("to0") == F.col("to1"), F.col("to0"))
    turns = F.when(F.col("to0") & ~F.col("to1"), 1).otherwise(0)
    up = ranges.withColumn("turns_", F.sum(turns).over(Window.partitionBy("path").orderBy("block")))
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("turns_").alias("at"))), ignorenulls=True).over(before)
    found = up.withColumn("last_", last).withColumn("so_far", F.coalesce(F.lag("turns_").over(Window.partitionBy("path").orderBy("block")), F.lit(0)))
    turned = (F.col("so_far") - F.coalesce("last_.at", F.lit(0))) % 2 == 1
    found = found.withColumn("inside", F.coalesce("last_.state", F.lit(False)) != turned)
    now = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    found = found.withColumns({c: now(c) for c in ("starts", "head", "head_bytes", "tail", "tail_bytes", "to")})
    return found.withColumns({"ordinal": F.coalesce(F.sum("starts").over(before), F.lit(0)), "first_byte": F.coalesce(F.sum("n_bytes").over(before), F.lit(0))})


def codecs_of(ranges: DataFrame, heads: DataFrame) -> DataFrame:
    """``path, codec, promoted_from, broken, reason``: the codec in force, and the byte of the first line that cannot be read."""
    at = lambda c: F.min(F.col("first_byte") + F.col(c))
    odd = F.min(F.struct((F.col("first_byte") + F.col("odd")).alias("at"), "odd_utf8", "odd_cp1252"))
    firsts = ranges.groupBy("path").agg(F.min_by("odd_utf8", F.when(F.col("odd").isNotNull(), F.col("block"))).alias("utf8"), F.min_by("odd_cp1252", F.when(F.col("odd").isNotNull(), F.col("block"))).alias("cp1252"), odd.alias("odd"), at("bad_utf8").alias("bad_utf8"), at("bad_cp1252").alias("bad_cp1252"), at("nul").alias("nul"))
    both = firsts.join(heads, "path")
    reads = {"utf-8": F.col("utf8"), "cp1252": F.col("cp1252"), "latin-1": F.lit(True)}
    kept = F.col("utf8").isNull()
    for name, ok in reads.items():
        kept = kept | ((F.col("codec") == name) & ok)
    # the first that reads the first line beyond ASCII
    other = F.when(F.col("utf8"), "utf-8").when(F.col("cp1252"), "cp1252").otherwise("latin-1")
    final = F.when(kept, F.col("codec")).otherwise(other)
    unread = F.when(final == "utf-8", F.col("bad_utf8")).when(final == "cp1252", F.col("bad_cp1252"))
    out = both.select("path", final.alias("codec"), F.when(~kept, F.col("codec")).alias("promoted_from"), F.least("nul", unread).alias("broken"), F.when(F.col("nul") <= F.coalesce(unread, F.col("nul")), "control_bytes").when(unread.isNotNull(), "undecodable").alias("reason"), "mark", "width", "problem")
    return out


RECORD = "path string, record_ordinal long, byte_start long, byte_end long, field_count int, raw_values array<string>, values_digest string, problem string"
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def parsed(path: str, ordinal: int, start: int, end: int, raw: bytes, codec: str, mark: str, size: int, limits: Limits) -> tuple | None:
    """The row of one record; None if it is blank. Problems are values and never repeat content."""
    cells, problem = None, None
    if end > size:
        # the file's last line, which ends without LF
        raw, end = raw[:-1], size
    if end - start > MOST_RECORD + 1:
        problem = "cell_too_long"
    else:
        try:
            lines = raw.decode(codec).split("\n")
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
            # a quote that is never closed ends with the file
            cells = next(csv.reader(iter(lines), delimiter=mark), [])
        except UnicodeDecodeError:
            problem = "undecodable"
        except csv.Error:
            problem = "malformed"
    if cells is not None and not any(c.strip() for c in cells):
        return None
    if cells is not None and len(cells) > limits.columns:
        cells, problem = None, "too_many_columns"
    if cells is not None and any(len(c) > limits.cell for c in cells):
        cells, problem = None, "cell_too_long"
    return path, ordinal, start, end, None if cells is None else len(cells), cells, None if cells is None else values_digest(ordinal, cells), problem


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)


def inner_records(lines: DataFrame, limits: Limits) -> DataFrame:
    """Records that begin and end in one range. ``lines`` has the range's state, ordinal and first byte, codec, mark and the byte up to which to read."""

    def run(batches):
        began, late, out = time.monotonic(), False, []
        for (path, _, inside, ordinal, at, codec, mark, upto, shift, whole), rows in runs(batches, 10):
            quotes, held, start, size = Quotes(mark), [], at, 0
            open_, told = not inside, False
            for (raw,) in rows:
                if open_ and not held:
                    start, ordinal = at, ordinal + 1
                if open_ and size <= MOST_RECORD:
                    held.append(raw)
                size += len(raw) + 1
                at += len(raw) + 1
                inside = quotes.inside_after(raw, inside)
                if not inside:
                    if open_ and (upto is None or at <= upto) and not told:
                        late = late or limits.seconds is not None and time.monotonic() - began > limits.seconds
                        # every range that is not read to its end says so
                        told = late
                        row = (path, ordinal, start + shift, at + shift, None, None, None, "time_limit") if late else parsed(path, ordinal, start + shift, at + shift, b"".join([x + b"\n" for x in held]), codec, mark, whole, limits)
                        if row:
                            out.append(row)
                        if len(out) == 5000:
                            # the time of those who take the rows is not the reader's
                            waits = time.monotonic()
                            yield made(out)
                            began, out = began + time.monotonic() - waits, []
                    held, size, open_ = [], 0, True
        yield made(out)

    return lines.select("path", "block", "inside", "ordinal", "first_byte", "codec", "mark", "upto", "shift", "size", "raw").mapInArrow(run, RECORD)


def crossing_records(ranges: DataFrame, limits: Limits) -> DataFrame:
    """Records over several ranges, from their pieces: the tail of one range, whole ranges without a start, the head of the last."""
    tail = ranges.where("to AND starts > 0").select("path", "block", (F.col("ordinal") + F.col("starts")).alias("n"), F.col("tail").alias("piece"), F.col("tail_bytes").alias("length"), (F.col("first_byte") + F.col("n_bytes") - F.col("tail_bytes")).alias("at"), "codec", "mark", "upto", "shift", "size")
    head = ranges.where("inside").select("path", "block", F.col("ordinal").alias("n"), F.col("head").alias("piece"), F.col("head_bytes").alias("length"), F.col("first_byte").alias("at"), "codec", "mark", "upto", "shift", "size")
    # no more bytes than a record may have are put together, whatever the ranges hold
    upto = F.sum("length").over(Window.partitionBy("path", "n").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    pieces = tail.unionByName(head).withColumn("so_far", F.coalesce(upto, F.lit(0))).withColumn("piece", F.when(F.col("so_far") <= MOST_RECORD, F.col("piece")).otherwise(F.lit(b"")))
    order = F.sort_array(F.collect_list(F.when(F.octet_length("piece") > 0, F.struct("block", "piece"))))
    whole = pieces.groupBy("path", "n", "codec", "mark", "upto", "shift", "size").agg(F.min("at").alias("start"), F.sum("length").alias("length"), order.alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, n, codec, mark, upto_, shift, size, start, length, pieces_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if upto_ is None or start + length <= upto_:
                    rows.append(parsed(path, n, start + shift, start + length + shift, b"".join(p["piece"] for p in pieces_), codec, mark, size, limits))
            yield made([r for r in rows if r])

    return whole.mapInArrow(run, RECORD)


@dataclass
class Statements:
    records: DataFrame
    outcomes: DataFrame


def read(spark: SparkSession, path: str, glob: str | None = None, delimiter: str | None = None, header_row: int = 1, limits: Limits | None = None) -> Statements:
    """The records and outcomes of all files below ``path``.

    ``records``: ``path, record_ordinal, byte_start, byte_end, field_count, raw_values, values_digest, state``. ``outcomes``: ``path, state, reason, codec, promoted_from,
    delimiter, records, data_rows, ragged_rows, byte_size, ranges``."""
    limits = limits or Limits()
    lines = physical_lines(spark, path, glob)
    heads = settled(preambles(lines, delimiter, header_row))
    good = heads.where("problem IS NULL").select("path", "mark")
    ranges = settled(entered(summed_up(in_order(lines, good, ["path"]))))
    sizes = settled(lines.select("path", "size", "block").groupBy("path").agg(F.max("size").alias("size"), F.count_distinct("block").alias("ranges")))
    # the source leaves a byte order mark out, and the last line may end without LF
    taken = ranges.groupBy("path").agg(F.sum("n_bytes").alias("taken"))
    told = codecs_of(ranges, heads).join(sizes, "path").join(taken, "path").withColumn("shift", F.when(F.col("size") - F.col("taken") >= 2, len(BOM)).otherwise(0).cast("long"))
    told = settled(told)
    # a record is read if the bytes read before it are within the limit: the one that crosses it is the last
    info = ranges.select("path", "block", "inside", "ordinal", "first_byte", "starts", "n_bytes", "to", "head", "head_bytes", "tail", "tail_bytes").join(told.select("path", "codec", "mark", F.col("broken").alias("upto"), "shift", "size"), "path")
    small = info.select("path", "block", "inside", "ordinal", "first_byte", "codec", "mark", "upto", "shift")
    found = inner_records(in_order(lines, small, ["path", "block"]), limits).unionByName(crossing_records(info, limits))
    found = settled(found.join(told.select("path", "width"), "path"))
    # limits: rows by their number within the file, bytes by those before a record
    by_file = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = settled(found.repartitionByRange("path", "record_ordinal").withColumn("part", F.spark_partition_id()))
    data = (F.col("record_ordinal") > header_row).cast("long")
    parts = dealt.groupBy("path", "part").agg(F.sum(data).alias("n")).withColumn("rows_before", F.coalesce(F.sum("n").over(by_file), F.lit(0))).drop("n")
    own = F.sum(data).over(Window.partitionBy("path", "part").orderBy("record_ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("own", own).join(parts, ["path", "part"]).withColumn("row_number", F.col("rows_before") + F.col("own"))
    over_rows = (data == 1) & (F.col("row_number") > limits.rows) if limits.rows is not None else F.lit(False)
    over_bytes = F.col("byte_start") > limits.bytes if limits.bytes is not None else F.lit(False)
    reason = F.when(over_bytes, "byte_limit").when(F.col("problem").isNotNull(), F.col("problem")).when(over_rows, "row_limit")
    placed = settled(placed.withColumn("stops", reason))
    stops = placed.where("stops IS NOT NULL").groupBy("path").agg(F.min(F.struct("record_ordinal", "stops")).alias("stop"))
    stops = settled(stops.select("path", F.col("stop.record_ordinal").alias("stop_at"), F.col("stop.stops").alias("stop")))
    kept = placed.join(stops, "path", "left").where("stop_at IS NULL OR record_ordinal < stop_at")
    sums = kept.groupBy("path").agg(F.count("*").alias("records"), F.sum(data).alias("data_rows"), F.count_if((data == 1) & (F.col("field_count") != F.col("width"))).alias("ragged_rows"))
    end = heads.select("path", F.col("problem").alias("unread")).join(sizes, "path").join(told.drop("size", "ranges", "problem"), "path", "left").join(stops, "path", "left").join(sums, "path", "left")
    end = end.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("records", "data_rows", "ragged_rows")})
    limit = F.col("stop").isin("byte_limit", "row_limit", "time_limit")
    why = F.coalesce("unread", "stop", "reason", F.when(F.col("data_rows") == 0, "no_data_rows"))
    state = F.when(why.isNull(), "complete").when(F.col("unread").isNull() & limit, "truncated").otherwise("failed")
    outcomes = settled(end.select("path", state.alias("state"), why.alias("reason"), "codec", "promoted_from", F.col("mark").alias("delimiter"), "records", "data_rows", "ragged_rows", F.col("size").alias("byte_size"), "ranges"))
    records = kept.select("path", "record_ordinal", "byte_start", "byte_end", "field_count", "raw_values", "values_digest").join(outcomes.select("path", "state"), "path")
    return Statements(records, outcomes)
