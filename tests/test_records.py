"""CSV records over many lines and splits, and the place of rows in their files."""

import csv
import random

import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions import fixed_values as fv
from tablewright.sources import readers, records

CELLS = ["a", "b\nc", 'x"y', "p,q", "", "\n\n", '"', "é", "one\r\ntwo", "end\n", "1", '",\n"', ",", '""']


def write(path, rows, eol="\n", quoting=csv.QUOTE_MINIMAL, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=eol, quoting=quoting).writerows(rows)
    return str(path)


@pytest.fixture
def small_splits(spark):
    """Sets the size of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1b")

    yield cut
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@given(st.lists(st.lists(st.sampled_from(CELLS), min_size=2, max_size=4).map(tuple), min_size=1, max_size=6), st.sampled_from([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
@settings(max_examples=200, deadline=None)
def test_sides_of_lines(rows, quoting):
    """Outside of cells exactly where a record ends."""
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n", quoting=quoting)
    ends = set()
    for row in rows:
        writer.writerow(row)
        ends.add(out.getvalue().encode().count(b"\n"))
    side = records.OUTSIDE
    for no, line in enumerate(out.getvalue().encode().split(b"\n")[:-1], 1):
        side = records.side_after(line, side, b",")
        assert (side == records.OUTSIDE) == (no in ends)


@pytest.mark.parametrize("size", ["60b", "1m"])
@pytest.mark.parametrize("eol, quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_ALL)])
def test_whole_files(spark, tmp_path, small_splits, size, eol, quoting):
    rng = random.Random(len(size))
    files = {}
    for name in ("b", "a +1", "c"):
        files[name] = [[f"{name}{i}", *(rng.choice(CELLS) + rng.choice(CELLS) for _ in range(2))] for i in range(8)]
    files["c"][3][1] = "long\n" * 70  # a cell over many splits
    for name, rows in files.items():
        write(tmp_path / f"{name}.csv", [["id", "x y", "z"], *rows], eol, quoting)
    small_splits(size)
    df = tw.read_folder(spark, str(tmp_path), with_order=True, source_col="src", infer=False)
    got = [tuple(r)[:4] for r in df.orderBy("_ord").collect()]
    told = lambda c: None if c in fv.NA_TOKENS else c
    assert got == [(*map(told, row), f"{name}.csv") for name in sorted(files) for row in files[name]]


def test_many_tasks_cut_one_file(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.csv", [["id", "t"], *([i, f"line {i}\nmore"] for i in range(90))])
    small_splits("300b")
    df = tw.read_csv(spark, path)
    assert df.rdd.getNumPartitions() > 4 and df.count() == 90


def test_line_breaks_need_no_option(spark, tmp_path):
    path = write(tmp_path / "a.csv", [["n", "t"], [1, "José\nMüller “x”"], [2, "plain"]], encoding="windows-1252")
    plain = write(tmp_path / "b.csv", [["n", "t"], [3, "one"]])
    df = tw.read_csv(spark, [path, plain])
    assert values(df, "n") == [(1, "José\nMüller “x”"), (2, "plain"), (3, "one")]
    flags = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["long_cells"]) for r in readers.file_encodings(spark, [path, plain]).collect()}
    assert flags == {"a.csv": ("windows-1252", True), "b.csv": ("utf-8", False)}


def test_odd_files(spark, tmp_path):
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,x\n\n2,"never closed\nto the end')
    assert values(tw.read_csv(spark, str(tmp_path / "open.csv"))) == [(1, "x"), (2, "never closed\nto the end")]
    (tmp_path / "inch.csv").write_bytes(b'\xef\xbb\xbfa,b\n5" pipe,1\n"7"" pipe\nlong",2\n')
    assert values(tw.read_csv(spark, str(tmp_path / "inch.csv")), "b") == [('5" pipe', 1), ('7" pipe\nlong', 2)]
    (tmp_path / "head.csv").write_bytes(b'"a\nb",c\n')
    assert tw.read_csv(spark, str(tmp_path / "head.csv")).columns == ["a\nb", "c"]
    write(tmp_path / "one.csv", [["a", "b"], ["1", "x\ny"]])
    write(tmp_path / "two.csv", [["a", "c"], ["1", "x\ny"]])
    with pytest.raises(ValueError, match="headers"):
        tw.read_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    with pytest.raises(ValueError, match="single"):
        records.cut_records(spark, [str(tmp_path / "one.csv")], "||")


# ---------------------------------------------------------------- the place in the files


def ordered(spark, path, rows):
    return tw.read_csv(spark, write(path, rows), with_order=True)


def test_first_of_the_file_stays(spark, tmp_path):
    """Without order_by the row that stands first in the file survives, though its content sorts last."""
    df = ordered(spark, tmp_path / "a.csv", [["id", "v"], [1, "zz"], [2, "mm"], [1, "aa"], [2, "zz"], [1, "bb"]])
    plain = CleanConfig().with_(duplicate={"subset": ("id",)}, text={"case_format": "none"})
    assert values(tw.clean(df, plain).data.drop("_ord"), "id") == [(1, "zz"), (2, "mm")]
    last = CleanConfig().with_(duplicate={"subset": ("id",), "keep": "last"}, text={"case_format": "none"})
    assert values(tw.clean(df, last).data.drop("_ord"), "id") == [(1, "bb"), (2, "zz")]
    assert values(tw.dedupe(df, ["id"]).drop("_ord"), "id") == [(1, "zz"), (2, "mm")]


def test_place_is_never_compared(spark, tmp_path):
    rows = [["id", "v"], [1, "x"], [2, "y"], [1, "x"], ["TOTAL", ""]]
    df = ordered(spark, tmp_path / "a.csv", rows)
    result = tw.clean(tw.drop_total_rows(df))
    assert sorted(tuple(map(str, r)) for r in result.data.drop("_ord").collect()) == [("1", "x"), ("2", "y")]
    assert "_ord" not in {r["column"] for r in result.column_status().collect()} | {r["column"] for r in result.warnings().collect()}
    merged = tw.clean_merged({"a.csv": df, "b.csv": df})
    assert {(r["file"], r["duplicates_inside"], r["duplicates_across"]) for r in merged.file_counts.collect()} == {("a.csv", 1, 0), ("b.csv", 0, 4)}


def test_fill_in_file_order(spark, tmp_path):
    df = ordered(spark, tmp_path / "a.csv", [["k", "v"], [9, "first"], [3, ""], [5, "second"], [1, ""], [2, ""]])
    assert values(tw.fill_forward(df, ["v"], None).drop("_ord"), "k") == [(1, "second"), (2, "second"), (3, "first"), (5, "second"), (9, "first")]


@pytest.mark.parametrize("with_base_order", [True, False])
def test_append_in_file_order(spark, tmp_path, with_base_order):
    """Of rows with one key the first of the first file is added, the others are told apart as skipped."""
    base = tw.read_csv(spark, write(tmp_path / "base.csv", [["id", "v"], [1, "base"]]), with_order=with_base_order)
    one = ordered(spark, tmp_path / "one.csv", [["v", "id"], ["zz", 2], ["aa", 2], ["xx", 1]])
    two = ordered(spark, tmp_path / "two.csv", [["id", "v"], [2, "aa"], [3, "qq"], [3, "bb"]])
    result = tw.append_tables(base, {"one.csv": one, "two.csv": two}, CleanConfig().with_(text={"case_format": "none"}), keys=["id"])
    assert result.data.columns == ["id", "v"] and values(result.data, "id") == [(1, "base"), (2, "zz"), (3, "qq")]
    assert sorted((r["id"], r["v"]) for r in result.skipped.collect()) == [(1, "xx"), (2, "aa"), (2, "aa"), (3, "bb")]
    mixed = tw.append_tables(base, {"one.csv": one, "two.csv": two.drop("_ord")}, keys=["id"])
    assert mixed.data.columns == ["id", "v"] and mixed.data.count() == 3
