"""Statements read by byte ranges: the same records as one reader in order finds, whatever stands where ranges meet."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallyforge.session import ship
from tallyforge.sources import ranges, statement

ALL = ranges.Limits(rows=None, bytes=None, seconds=None)


@pytest.fixture
def small_ranges(spark):
    """So many ranges that records cross their borders again and again."""
    ship(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(old, (str(n), "0"), strict=True)]
    for k, v in old.items():
        spark.conf.set(k, v)


def found(spark, folder, limits=ALL, **options):
    got = ranges.read(spark, str(folder), limits=limits, **options)
    outcomes = {r.path.rsplit("/", 1)[-1]: r for r in got.outcomes.collect()}
    records: dict[str, list] = {name: [] for name in outcomes}
    for r in got.records.collect():
        records[r.path.rsplit("/", 1)[-1]].append((r.record_ordinal, r.byte_start, r.byte_end, r.raw_values, r.values_digest))
        assert r.state == outcomes[r.path.rsplit("/", 1)[-1]].state
    return {k: sorted(v, key=lambda x: x[0]) for k, v in records.items()}, outcomes


def in_order(raw: bytes):
    return [(n, a, b, cells, statement.values_digest(n, cells)) for n, a, b, cells, _, _ in statement.records(raw)]


def test_ranges_find_what_one_reader_finds(spark, small_ranges, tmp_path):
    small_ranges(150)
    rng, payloads = random.Random(6), {}
    for k in range(10):
        mark, out = rng.choice(";,\t|"), io.StringIO()
        writer = csv.writer(out, delimiter=mark, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["a", "b", "c"])
        for _ in range(rng.randint(15, 60)):
            cell = lambda: "".join(rng.choice(["x", "y z", '"', "\n", "'", mark, "7", "", " "]) for _ in range(rng.randint(0, 9)))  # noqa: B023, E731
            writer.writerow([cell() for _ in range(3)] if rng.random() > 0.1 else [])
            if rng.random() < 0.1:
                # quotes that open nothing, and what follows a closing one
                out.write(f'ab"c{mark}"d""e"f"g{mark}h\n')
        text = out.getvalue()
        if k % 3 == 0:
            text = text.rstrip("\r\n")
        if k % 4 == 1:
            text += f'x{mark}"never closed\nand more\n\nto the end'
        if k % 2:
            text = text[: len(text) // 2] + text[len(text) // 2 :].replace("x", "é")
        payloads[f"f{k}.csv"] = text.encode(("utf-8", "cp1252", "utf-8-sig", "latin-1")[k % 4])
        (tmp_path / f"f{k}.csv").write_bytes(payloads[f"f{k}.csv"])
    records, outcomes = found(spark, tmp_path)
    for name, raw in payloads.items():
        assert records[name] == in_order(raw), name
        end = outcomes[name]
        assert (end.state, end.records, end.byte_size, end.data_rows) == ("complete", len(records[name]), len(raw), len(records[name]) - 1) and end.ranges > 3


def test_codecs_change_only_after_ascii(spark, small_ranges, tmp_path):
    small_ranges(30_000)
    rows = "".join(f"{i};plain text;1\n" for i in range(5000)).encode()
    assert len(rows) > ranges.HEAD
    cases = {
        "promoted": rows + "7;café;1\n".encode("cp1252") + b"8;x;2\n",
        "latin": rows + b"7;caf\x81;1\n",
        "kept": rows + "7;café;1\n".encode(),
        "two": rows + "7;café;1\n".encode() + b"8;fine;1\n" + "9;café;1\n".encode("cp1252") + b"10;x;1\n",
        "nul": rows + b"7;x\0y;1\n8;x;1\n",
        "early": "0;é;1\n".encode() + rows + b"9;caf\xe9;1\n",
        "single": b"only\none\ncolumn\n",
        "blank": b" \n\n",
    }
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    records, outcomes = found(spark, tmp_path)
    told = {k: (v.state, v.reason, v.codec, v.promoted_from) for k, v in outcomes.items()}
    assert told == {
        "promoted": ("complete", None, "cp1252", "utf-8"), "latin": ("complete", None, "latin-1", "utf-8"), "kept": ("complete", None, "utf-8", None),
        "two": ("failed", "undecodable", "utf-8", None), "nul": ("failed", "control_bytes", "utf-8", None), "early": ("failed", "undecodable", "utf-8", None),
        "single": ("failed", "single_column", None, None), "blank": ("failed", "empty", None, None),
    }
    for name in ("promoted", "kept"):
        assert records[name] == in_order(cases[name])
    assert [len(records[k]) for k in ("latin", "two", "nul", "early")] == [5001, 5002, 5000, 5001]
    assert records["two"][-1][3] == ["8", "fine", "1"]


def test_limits_end_a_file_and_say_so(spark, small_ranges, tmp_path):
    small_ranges(2000)
    head = b"a;b\n"
    cases = {
        "exact": head + b"1;2\n" * 50, "more": head + b"1;2\n" * 51, "wide": head + b"1;2\n" + b";".join([b"x"] * 600) + b"\n3;4\n", "long": head + b"1;2\n1;" + b"y" * 5000 + b"\n3;4\n",
        "ragged": head + b"1;2;3\n4;5\n6\n", "header": head, "open": head + b'1;2\n3;"' + b"open\n" * 900,
    }
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    records, outcomes = found(spark, tmp_path, ranges.Limits(rows=50, bytes=None))
    told = {k: (v.state, v.reason, v.data_rows, v.ragged_rows) for k, v in outcomes.items()}
    assert told == {
        "exact": ("complete", None, 50, 0), "more": ("truncated", "row_limit", 50, 0), "wide": ("failed", "too_many_columns", 1, 0), "long": ("failed", "cell_too_long", 1, 0),
        "ragged": ("complete", None, 3, 2), "header": ("failed", "no_data_rows", 0, 0), "open": ("failed", "cell_too_long", 1, 0),
    }
    assert {k: len(v) for k, v in records.items()} == {"exact": 51, "more": 51, "wide": 2, "long": 2, "ragged": 4, "header": 1, "open": 2}
    records, outcomes = found(spark, tmp_path, ranges.Limits(rows=None, bytes=100))
    # the record that crosses the limit is the last
    assert outcomes["more"].reason == "byte_limit" and outcomes["more"].state == "truncated" and records["more"][-1][2] == 104
    _, outcomes = found(spark, tmp_path, ranges.Limits(seconds=-1.0))
    assert outcomes["more"].reason == "time_limit" and outcomes["more"].state == "truncated"


def test_a_record_longer_than_any_may_be_is_not_held(spark, small_ranges, tmp_path, monkeypatch):
    small_ranges(3000)
    (tmp_path / "f").write_bytes(b'a;b\n1;2\n3;"' + b"z" * 40_000 + b'\n";4\n5;6\n')
    records, outcomes = found(spark, tmp_path, ranges.Limits(cell=100_000))
    assert outcomes["f"].state == "complete" and [r[0] for r in records["f"]] == [1, 2, 3, 4] and len(records["f"][2][3][1]) == 40_001
