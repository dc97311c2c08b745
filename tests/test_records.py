"""CSV records over many splits, line numbers and rejects."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.sources import checked, lines, readers

SCHEMA = "id int, a string, b string, v double"


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def field(value, draw):
    if value is None:
        return ""
    text = str(value)
    if draw.random() < 0.5 or any(c in text for c in '",\r\n'):
        return '"' + text.replace('"', '""') + '"'
    return text


def rows_of(seed, n=300):
    draw = random.Random(seed)
    texts = ["plain", 'a "quoted" word', "two\nlines", '"', 'line\n\n\nbreaks, "quotes"\n',
             "x" * 900, "\n" * 7, "comma, here", None, "back \\ slash", "é中", "y\n" * 800]
    return [(i, draw.choice(texts), draw.choice(texts), i / 4) for i in range(n)]


def write(path, rows, seed, end="\n"):
    draw = random.Random(seed)
    body = "".join(",".join(field(v, draw) for v in r) + end for r in rows)
    path.write_text("id,a,b,v" + end + body, encoding="utf-8", newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_splits(small_splits, tmp_path, end):
    rows = rows_of(1)
    write(tmp_path / "one.csv", rows, 2, end)
    write(tmp_path / "two.csv", [(i + 1000, *r) for i, *r in rows], 3, end)
    spark, path = small_splits, str(tmp_path)
    assert lines.text_lines(spark, path).rdd.getNumPartitions() > 50
    loaded = checked.load_csv_checked(spark, path, SCHEMA)
    assert loaded.rejects.isEmpty()
    got = sorted(map(tuple, loaded.rows.collect()), key=lambda r: r[0])
    assert got == rows + [(i + 1000, *r) for i, *r in rows]


def test_like_the_reader_of_one_task(small_splits, tmp_path):
    write(tmp_path / "one.csv", rows_of(4), 5)
    one = small_splits.read.options(header="true", escape='"', multiLine="true").schema(
        SCHEMA).csv(str(tmp_path))
    assert one.rdd.getNumPartitions() == 1
    many = checked.load_csv_checked(small_splits, str(tmp_path), SCHEMA, staged=True).rows
    key = lambda r: r[0]
    assert sorted(many.collect(), key=key) == sorted(one.collect(), key=key)


def test_rejects_have_a_place_and_a_reason(small_splits, tmp_path):
    path = tmp_path / "bad.csv"
    parts = ["id,a,b,v"]
    wanted, good, line = {}, 0, 2
    for i in range(400):
        kind = i % 10
        record = {0: f'{i},"a\nb",c,1.5', 1: f"x{i},a,b,1", 2: f"{i},a,b", 3: f"{i},a,b,1,2",
                  4: f"{i},a,b,none", 5: ""}.get(kind, f"{i},a,,")
        reason = {1: "id: not int", 2: "not 4 fields", 3: "not 4 fields",
                  4: "v: not double"}.get(kind)
        if reason:
            wanted[line] = (reason, record)
        elif kind != 5:
            good += 1
        parts.append(record)
        line += record.count("\n") + 1
    parts.append('9999,"never closed\n,b,1')
    wanted[line] = ("quote left open", parts[-1])
    path.write_text("\n".join(parts) + "\n")
    loaded = checked.load_csv_checked(small_splits, str(path), SCHEMA)
    assert loaded.rows.count() == good
    found = {r.line: (r.reason, r.record.rstrip("\n")) for r in loaded.rejects.collect()}
    assert found == wanted
    assert loaded.rejects.columns == checked.REJECTS


def test_whitespace_rejects(small_splits, tmp_path):
    text = [f"  {i}   {i / 2}  " for i in range(200)]
    text[50], text[120], text[199], text[7] = "50", "a b", "1 2 3", "   "
    (tmp_path / "t.txt").write_text("\n".join(text) + "\n")
    loaded = checked.load_whitespace_checked(small_splits, str(tmp_path), {"k": "int",
                                                                           "v": "double"})
    assert loaded.rows.count() == 196
    assert {r.line: r.reason for r in loaded.rejects.collect()} == {
        51: "not 2 fields", 121: "k: not int", 200: "not 2 fields"}


def test_wrong_header_and_empty_files(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("id,b,a,v\n1,2,3,4\n")
    with pytest.raises(Exception, match="the header"):
        checked.load_csv_checked(small_splits, str(tmp_path), SCHEMA).rows.collect()
    (tmp_path / "a.csv").write_text("id,a,b,v\n")
    (tmp_path / "b.csv").write_text("")
    loaded = checked.load_csv_checked(small_splits, str(tmp_path), SCHEMA)
    assert loaded.rows.count() == loaded.rejects.count() == 0


def test_line_numbers(small_splits, tmp_path):
    path = tmp_path / "truth.txt"
    path.write_text("".join(f"{v}  \n" for v in range(1000, 3000)))
    spark = small_splits
    assert lines.text_lines(spark, str(path)).rdd.getNumPartitions() > 10
    truth = readers.load_positional(spark, str(path))
    assert "PythonRDD" not in truth._jdf.queryExecution().toString()
    assert truth.where(F.col("RUL") - F.col("unit_nr") != 999).count() == 0
    assert truth.count() == 2000
    (tmp_path / "more.txt").write_text("1\n")
    with pytest.raises(ValueError, match="several files"):
        readers.load_positional(spark, str(tmp_path))


def test_python_reads_the_same(small_splits, tmp_path):
    """The standard library's reader over the same file."""
    write(tmp_path / "one.csv", rows_of(9, 120), 9)
    with open(tmp_path / "one.csv", newline="", encoding="utf-8") as f:
        wanted = list(csv.reader(f))[1:]
    found = lines.csv_records(small_splits, str(tmp_path), ["id", "a", "b", "v"]).collect()
    assert sorted(next(csv.reader([r.record])) if "\n" not in r.record else
                  next(csv.reader(r.record.splitlines(keepends=True))) for r in found) \
        == sorted(wanted)


def test_texts_are_cut_into_records_once(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, 'say "x"')], "n long, t string").write.options(
        header="true", escape='"').csv(str(tmp_path / "once"))
    rows, rejects = checked.load_csv_checked(spark, str(tmp_path / "once"), "n long, t string",
                                             staged=True)
    for table in (rows, rejects):
        assert "MapInArrow" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(1, "a\nb"), (2, 'say "x"')]
    assert rejects.count() == 0
    records = lines.csv_records(spark, str(tmp_path / "once"), ["n", "t"])
    assert "MapInArrow" not in records._jdf.queryExecution().optimizedPlan().toString()
