import pytest
from conftest import values

import tablewright as tw
from tablewright.sources import readers, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


NAMES = "nama,kota\nJosé,Müller “x”\nAna,Ulm\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "windows-1252"])
def test_encodings(spark, tmp_path, encoding):
    df = tw.read_table(spark, write(tmp_path / "a.csv", NAMES, encoding))
    assert df.columns == ["nama", "kota"]
    assert values(df) == [("Ana", "Ulm"), ("José", "Müller “x”")]
    told = tw.read_csv(spark, str(tmp_path / "a.csv"), encoding="utf-8" if encoding.startswith("utf") else encoding)
    assert values(told) == values(df)


def test_bytes_that_windows_1252_does_not_know(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nama\nJosé\n".encode("latin-1") + b"x\x81y\n")
    df = tw.read_csv(spark, str(tmp_path / "a.csv"))
    assert values(df) == [("José",), ("x\x81y",)]


def test_mixed_encodings_in_one_folder(spark, tmp_path):
    write(tmp_path / "b.csv", "nama\nMüller\n", "windows-1252")
    write(tmp_path / "a.csv", "nama\nJosé\n", "utf-8")
    write(tmp_path / "note.txt", "not a table")
    df = tw.read_folder(spark, str(tmp_path))
    assert values(df) == [("José", "a.csv"), ("Müller", "b.csv")]
    assert [p.rsplit("/", 1)[1] for p in readers.list_tables(spark, str(tmp_path))] == ["a.csv", "b.csv"]
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in readers.file_encodings(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "windows-1252"}


def test_empty_words_and_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", "i,d,b,t,s,n,date\n1,1.5,True,a,x,NA,2024-01-15\n02,,False,None,1,null,2024-01-16\n3,2,TRUE,n/a,,#N/A,2024-01-17\n")
    df = tw.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "t": "string", "s": "string", "n": "string", "date": "string"}
    assert values(df, "i") == [
        (1, 1.5, True, "a", "x", None, "2024-01-15"), (2, None, False, None, "1", None, "2024-01-16"), (3, 2.0, True, None, None, None, "2024-01-17"),
    ]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"say ""hi"", ok",1\n"two\nlines",2\n')
    for multi_line in (None, True):
        df = tw.read_csv(spark, path, multi_line=multi_line)
        assert values(df, "b") == [('say "hi", ok', 1), ("two\nlines", 2)]


def test_file_order(spark, tmp_path):
    for name in "ab":
        write(tmp_path / f"{name}.csv", "v\n" + "".join(f"{name}{i}\n" if i % 3 == 0 else "NA\n" for i in range(50)))
    df = tw.read_folder(spark, str(tmp_path), with_order=True, source_col="src")
    ordered = [r["v"] for r in df.orderBy("_ord").collect()]
    assert ordered == [f"{n}{i}" if i % 3 == 0 else None for n in "ab" for i in range(50)]
    filled = tw.fill_forward(df, ["v"], ["_ord"], rows_per_bucket=13).orderBy("_ord").collect()
    assert [r["v"] for r in filled] == [f"{n}{i - i % 3}" for n in "ab" for i in range(50)]


def test_header_and_errors(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,nama lengkap\n1,x\n")
    assert tw.read_header(spark, path) == ["id", "nama lengkap"]
    with pytest.raises(FileNotFoundError):
        tw.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="extension"):
        tw.read_table(spark, write(tmp_path / "a.txt", "x"))
    with pytest.raises(FileNotFoundError):
        tw.read_folder(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv"])
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    tw.write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
    back = tw.read_folder(spark, str(tmp_path / f"t.{fmt}")).drop("Sumber File") if fmt == "csv" else tw.read_table(spark, str(tmp_path / f"t.{fmt}"))
    assert values(back.select("i", "s"), "i") == [(1, "a"), (2, None)]


def test_date_format_of_the_csv_sink(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05 10:00:00' AS t, 1 AS i")
    assert sinks.as_text_dates(df, "%d/%m/%Y").first()["t"] == "05/01/2024"
    assert sinks.as_text_dates(df, None).schema == df.schema


def test_side_outputs_keep_their_columns(spark, tmp_path):
    tables = {"data": spark.range(3), "skipped": spark.range(0).selectExpr("id", "'x' AS Alasan")}
    tw.write_tables(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "skipped")).columns == ["id", "Alasan"]


def test_replacing_the_base_keeps_a_backup(spark, tmp_path):
    base = str(tmp_path / "base")
    tw.write_table(spark.createDataFrame([("A1",)], "id string"), base)
    grown = tw.append_tables(spark.read.parquet(base), {"n": spark.createDataFrame([("A2",)], "id string")}).data
    with pytest.raises(ValueError, match="overwrite"):
        tw.replace_base(grown, base)
    assert spark.read.parquet(base).count() == 1
    backup = tw.replace_base(grown, base, overwrite=True)
    assert backup == base + ".bak"
    assert values(spark.read.parquet(base)) == [("A1",), ("A2",)] and values(spark.read.parquet(backup)) == [("A1",)]


def test_scratch_tables_can_be_cleared(spark, tmp_path):
    from tablewright import session

    before = list(session._written)
    session._written.clear()
    df = session.materialise(spark.range(3))
    assert df.count() == 3 and tw.clear_scratch(spark) == 1
    assert not any(session.path_exists(spark, p.removeprefix("file:")) for p in df.inputFiles())
    session._written.extend(before)


def test_wide_integers_keep_their_digits(spark):
    rows = [("1234567890123456789", "12345678901234567890", "7"), ("1234567890123456788", "3", "2.5")]
    out = readers.infer_types(spark.createDataFrame(rows, "a string, b string, c string"))
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert {r.a for r in out.collect()} == {1234567890123456789, 1234567890123456788}
