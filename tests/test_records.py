"""Text read in splits of any size has the records that Python's own reader finds in it whole."""

import csv
import io
import random

import pyarrow as pa
import pytest

from tallyspark.operators.canonical import ingest_report, kept
from tallyspark.sources import records
from tallyspark.sources.dialects import dialect_profile
from tallyspark.sources.dispatch import load_exports
from tallyspark.sources.records import inside_after, read_records


@pytest.fixture
def splits(spark):
    """Sets the largest split, and the old value afterwards."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def whole(text, width, skipped):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";")
            if any(c.strip() for c in r)]
    return [(r + [""] * width)[:width] for r in rows[skipped + 1:]]


def test_state_of_a_line():
    for line, out, inside in (("a;b", False, True), ('a;"b', True, False), ('"a"";b', True, False),
                              ('"a"b";c', False, False), ('a"b;c', False, False),
                              ('";"', False, True), ('""', False, True), ('x";"', True, True)):
        assert inside_after(line.encode(), False, b";") == out, line
        text = '"' + "\n" + line + '";z\n'
        assert inside_after(line.encode(), True, b";") == inside, (line, text)


def random_file(rng, rows):
    """Cells with breaks, separators and quotes; quotes inside plain cells; blank lines."""
    lines = ["Report; of the year", "name;text;more"]
    for k in range(rows):
        cells = [rng.choice(["plain", 'he"s', "", " ", f'"{"x;" * rng.randrange(9)}"',
                             '"two\nlines"', '"a ""word""\n\n;of"', '"crlf\r\nhere"',
                             '"' + "long\n" * rng.randrange(60) + '"', '"a"b"c'])
                 for _ in range(rng.randrange(1, 5))]
        lines.append(f"r{k};" + ";".join(cells))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", " ", "name;text;more", '""']))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("size", [211, 1 << 20])
def test_splits_of_any_size(spark, tmp_path, splits, size):
    rng = random.Random(4)
    files, want = {}, []
    for k in range(3):
        text = random_file(rng, 40)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        files[f"file:{tmp_path}/{k}.csv"] = 1
        want += whole(text, 3, 1)
    splits(size)
    headers = spark.createDataFrame(list(files.items()), "file string, skipped_rows int")
    rows, lost = read_records(spark, headers, list(files), ";", "utf-8", 3)
    assert sorted(r["cells"] for r in rows.collect()) == sorted(want)
    assert lost is None or lost.isEmpty()


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_an_open_quote_is_counted(spark, tmp_path, splits, size):
    body = "\n".join(f"c{k};n{k};2024-01-0{1 + k % 9};1;10;cup" for k in range(40))
    (tmp_path / "a.csv").write_text(
        f'buyer;order;day created;qty;price;item\n{body}\nz;n;2024-02-01;2;5;"never\n{body}\n')
    splits(size)
    frame = load_exports(spark, str(tmp_path))
    report = {r.reason: r.rows for r in ingest_report(frame).collect()}
    assert report == {"kept": 41, "behind an open quote": 40}
    assert kept(frame).where("customer_id = 'z'").first().product.startswith("never")


@pytest.mark.parametrize("size", [700, 1 << 27])
@pytest.mark.parametrize("titles", ["", "Report\n;;;\n"])
def test_only_the_first_header_is_left_out(spark, tmp_path, splits, size, titles):
    head = "buyer;order;day created;qty;price\n"
    rows = [f"c{k};n{k};2024-01-0{1 + k % 9};1;10\n" for k in range(81)]
    (tmp_path / "a.csv").write_text(titles + head + "".join(rows[:20]) + head + "Report\n"
                                    + "".join(rows[20:]) + head)
    splits(size)
    report = {r.reason: r.rows for r in ingest_report(load_exports(spark, str(tmp_path))).collect()}
    assert report == {"kept": 81, "unparseable date": 3}


class Lines:
    """Lines of blocks that are gone through here."""

    def __init__(self, blocks, size):
        rows = [(line, f"f{k % 2}", k) for k, some in enumerate(blocks) for line in some]
        table = pa.table(dict(zip(("line", "file", "block"), zip(*rows))),
                         pa.schema([("line", pa.binary()), ("file", pa.string()), ("block", pa.int64())]))
        self.batches = table.to_batches(max_chunksize=size)

    def mapInArrow(self, run, kinds):
        return [r for b in run(iter(self.batches)) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [7, 10_000])
def test_lines_are_gone_through_many_at_a_time(monkeypatch, size):
    """Line by line only as long as a block's two starts differ; the same ends as line by line."""
    rng, calls, one = random.Random(5), [], inside_after
    blocks = [random_file(rng, 200).encode().split(b"\n")[rng.randrange(40):] for _ in range(12)]
    blocks.append([b"no quote at all"] * 30)
    blocks.append([b'x;"open'] + [b"no quote"] * 50)
    monkeypatch.setattr(records, "inside_after", lambda *a: calls.append(a) or one(*a))
    got = records.block_ends(Lines(blocks, size), ";")
    want = []
    for some in blocks:
        state = [False, True]
        for line in some:
            state = [one(line, s, b";") for s in state]
        want.append(tuple(state))
    assert [(r["from_out"], r["from_in"]) for r in got] == want
    assert len(calls) < 0.2 * sum(map(len, blocks))


def test_records_of_any_text():
    """What the patterns find is what the state of every line tells."""
    rng = random.Random(6)
    patterns = records._Patterns(";")
    for _ in range(20_000):
        text = b"".join(rng.choice([b'"', b";", b"\n", b"a", b"\r", b'""'])
                        for _ in range(rng.randrange(14))) + b"\n"
        for start in (False, True):
            state, ends, at = start, [], 0
            for line in text[:-1].split(b"\n"):
                state, at = inside_after(line, state, b";"), at + len(line) + 1
                ends += [] if state else [at]
            assert patterns.split(text, start) == (
                (ends[0] if ends else -1) if start else 0, ends[-1] if ends else 0), (text, start)
        whole = text[:patterns.split(text, False)[1]]
        assert records._many(whole, "utf-8", ";", 3, patterns) == [
            r for m in patterns.record.finditer(whole) if m.group()
            for r in records._cells(m.group()[:-1], "utf-8", ";", 3)], whole


def test_the_first_lines_of_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report\nname;text;more\na;b;c\n" + 'a;"b\nb";c\n' * 40)
    profile = dialect_profile(spark, str(tmp_path))
    assert "Scan text" not in profile._jdf.queryExecution().executedPlan().toString()
    assert [(r.skipped_rows, r.columns) for r in profile.collect()] == [(1, ["name", "text", "more"])]
