import itertools
import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions.compare import canonical
from tablewright.operators import combine, recommend


# ------------------------------------------------------------ merge


def months(frame):
    cols = "id int, nama string, nilai int"
    return {
        "jan.csv": frame(cols, [(1, "andi", 100), (2, "budi", 200)]),
        "feb.csv": frame(cols, [(2, "budi", 200), (3, "cici", 300)]),
        "mar.csv": frame(cols, [(4, "dedi", 400)]),
    }


def test_merge_counts_duplicates_across_files(frame):
    result = tw.clean_merged(months(frame))
    assert result.data.columns == ["id", "nama", "nilai", "Sumber File"]
    assert values(result.data, "id") == [
        (1, "Andi", 100, "jan.csv"), (2, "Budi", 200, "jan.csv"), (3, "Cici", 300, "feb.csv"), (4, "Dedi", 400, "mar.csv"),
    ]
    assert values(result.file_counts, "no") == [(0, "jan.csv", 2, 0, 0), (1, "feb.csv", 2, 0, 1), (2, "mar.csv", 1, 0, 0)]
    summary = {r["metric"]: r["value"] for r in result.summary().collect()}
    assert summary["rows_in"] == 5 and summary["duplicates_across"] == 1 and summary["duplicates_removed"] == 1


def test_merge_rejects_other_columns(frame):
    with pytest.raises(ValueError, match=r"feb\.csv must have the columns"):
        tw.clean_merged({"jan.csv": frame("id int, nama string", [(1, "a")]), "feb.csv": frame("id int, nama_lengkap string", [(1, "a")])})
    with pytest.raises(ValueError):
        tw.stack({"one": frame("id int", [1])})


def test_same_base_name_in_two_folders(frame):
    cols = "id int, nama string"
    result = tw.clean_merged({"a/x.csv": frame(cols, [(1, "p"), (1, "p")]), "b/x.csv": frame(cols, [(1, "p")])})
    assert values(result.file_counts, "no") == [(0, "x.csv", 2, 1, 0), (1, "x.csv", 1, 0, 1)]


def test_source_column_is_touched_by_no_rule(frame):
    cols = "id int, nama string"
    tables = {"2024-01-01": frame(cols, [(1, " a ")]), "  SMALL name ": frame(cols, [(2, "b")])}
    result = tw.clean_merged(tables, source_col="update_source")
    assert {r["update_source"] for r in result.data.collect()} == {"2024-01-01", "  SMALL name "}


# ------------------------------------------------------------ join


def shop(frame):
    return {
        "pelanggan.csv": frame("ID int, Nama string", [(1, "Andi"), (2, "Budi"), (3, "Cici")]),
        "transaksi.csv": frame("ID int, ID_Produk string, Total int", [(1, "P01", 100), (2, "P99", 200), (4, "P01", 400)]),
        "produk.csv": frame("ID_Produk string, Produk string", [("P01", "Laptop"), ("P03", "Mouse")]),
    }


def test_chain_of_three(frame):
    result = tw.clean_joined(shop(frame), ["ID", "ID_Produk"])
    assert [r["Produk"] for r in result.data.orderBy("ID").collect()] == ["Laptop", "Unknown", "Unknown"]
    stages = result.stage_summary().orderBy("stage").collect()
    assert [s["match_rate"] for s in stages] == [66.67, 33.33]
    assert (stages[1]["matched_rows"], stages[1]["unmatched_rows"], stages[1]["rate_text"]) == (1, 2, "33.33%")
    assert stages[0]["flow"] == "pelanggan.csv + transaksi.csv (key: ID) → 66.67% match"
    orphans = {(r["Tahap"], r["File Asal"], r["Alasan"]) for r in result.orphans.collect()}
    assert orphans == {
        (1, "transaksi.csv", "ID 4 tidak ditemukan di pelanggan.csv"),
        (2, "produk.csv", "ID_Produk P03 tidak ditemukan di hasil gabungan"),
    }
    assert {r["metric"]: r["value"] for r in result.summary().collect()}["orphans"] == 2


def test_orphan_columns(frame):
    result = tw.join_chain({"l": frame("ID int, Nama string", [(1, "Andi")]), "r": frame("ID int, Total int", [(1, 100), (4, 400)])}, "ID")
    assert result.orphans.columns == ["ID", "Total", "Tahap", "File Asal", "Alasan"]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_null_keys_meet_nothing(frame, hot_rows):
    left = frame("k int, a string", [(1, "x"), (None, "y"), (None, "z")])
    right = frame("k int, b string", [(1, "p"), (None, "q"), (None, "r")])
    result = tw.join_chain({"left": left, "right": right}, "k", hot_rows=hot_rows)
    assert sorted((r["a"], r["b"] or "") for r in result.data.collect()) == [("x", "p"), ("y", ""), ("z", "")]
    assert tuple(result.stages.select("left_rows", "matched_rows", "match_rate").first()) == (3, 1, 33.33)
    assert sorted(r["b"] for r in result.orphans.select("b").collect()) == ["q", "r"]


def test_empty_left_has_rate_zero(frame):
    empty = frame("k int, a string", [(1, "x")]).where("false")
    result = tw.join_chain({"left": empty, "right": frame("k int, b string", [(1, "p")])}, "k")
    assert tuple(result.stages.select("left_rows", "matched_rows", "match_rate").first()) == (0, 0, 0.0)


def test_name_clashes_get_the_file_stem(frame):
    tables = {"a.csv": frame("k int, name string", [(1, "x")]), "b.csv": frame("k int, name string", [(1, "y")])}
    assert tw.join_chain(tables, "k").data.columns == ["k", "name", "name_b"]
    with pytest.raises(ValueError, match="exists already"):
        tw.join_chain({"a.csv": frame("k int, name string, name_b string", [(1, "x", "z")]), "b.csv": tables["b.csv"]}, "k")


def test_key_shared_by_two_stages(frame):
    tables = {n: frame(f"k int, {n} int", [(1, i), (2, i)]) for i, n in enumerate("abc")}
    assert values(tw.join_chain(tables, ["k", "k"]).data, "k") == [(1, 0, 1, 2), (2, 0, 1, 2)]


def test_join_preconditions(frame):
    tables = shop(frame)
    with pytest.raises(ValueError, match="3 tables is joined by 2 keys"):
        tw.join_chain(tables, ["ID"])
    with pytest.raises(ValueError, match=r"'ID_Produk', which produk\.csv does not have"):
        tw.join_chain({**tables, "produk.csv": frame("KodeProduk string", ["P01"])}, "ID, ID_Produk")
    with pytest.raises(ValueError, match="left"):
        tw.join_chain(tables, ["ID", "ID_Produk"], how="inner")
    with pytest.raises(ValueError, match="is int on the left"):
        tw.join_chain({"a": frame("k int", [1]), "b": frame("k string", ["1"])}, "k")
    with pytest.raises(ValueError):
        tw.join_chain({"a": frame("k int", [1])}, [])


def test_recommendation(frame):
    merge = tw.recommend_combine({n: ["ID", "Nama"] for n in ("jan", "feb", "mar")})
    assert (merge.mode, merge.keys) == ("merge", ())
    headers = {n: d.columns for n, d in shop(frame).items()}
    join = tw.recommend_combine(headers)
    assert (join.mode, join.chain, join.keys) == ("join", tuple(headers), ("ID", "ID_Produk"))
    shuffled = {n: headers[n] for n in ("transaksi.csv", "pelanggan.csv", "produk.csv")}
    assert tw.recommend_combine(shuffled).mode == "unknown"
    everywhere = tw.recommend_combine({"a": ["ID", "A"], "b": ["ID", "B"], "c": ["ID", "C"]})
    assert everywhere.mode == "unknown" and "stays open" in everywhere.reason
    assert tw.recommend_combine({"a": ["X"], "b": ["Y"]}).mode == "unknown"
    two_keys = tw.recommend_combine({"a": ["X", "Y", "1"], "b": ["X", "Y", "2", "Z"], "c": ["Z", "3"]})
    assert two_keys.mode == "unknown"


def test_auto(frame):
    advice, result = tw.combine_auto(months(frame))
    assert advice.mode == "merge" and result.data.count() == 4
    advice, result = tw.combine_auto(shop(frame))
    assert advice.mode == "join" and result.data.count() == 3
    with pytest.raises(ValueError, match="stays? open"):
        tw.combine_auto({"a": frame("ID int, A int", [(1, 1)]), "b": frame("ID int, B int", [(1, 1)])})


# ------------------------------------------------------------ append

ORDER = "`Order ID` string, Nama string, Harga string, Tanggal string"


def ids(df):
    return sorted(r["Order ID"] for r in df.collect())


def test_append_adds_only_new_rows(frame):
    base = frame(ORDER, [("A1", "Budi", "Rp 100.000", "15/01/2025"), ("A2", "Siti", "Rp 200.000", "20/01/2025")])
    new = frame(ORDER, [("A2", "Siti", "Rp 200.000", "20/01/2025"), ("A3", "Andi", "Rp 300.000", "05/02/2025")])
    result = tw.append_tables(base, {"new.csv": new})
    assert ids(result.data) == ["A1", "A2", "A3"]
    assert values(result.file_counts) == [(0, "new.csv", 2, 1, 1, 0)]


def test_append_reorders_columns_and_drops_the_footer(frame):
    base = frame(ORDER, [("A1", "Budi", "Rp 100.000", "15/01/2025"), ("A2", "Siti", "Rp 200.000", "20/01/2025"), ("TOTAL", None, None, None)])
    new = frame("Nama string, Tanggal string, Harga string, `Order ID` string", [("Andi", "05/02/2025", "Rp 300.000", "A3")])
    result = tw.append_tables(base, {"new.csv": new})
    summary = {r["metric"]: r["value"] for r in result.summary().collect()}
    assert ids(result.data) == ["A1", "A2", "A3"] and result.data.columns[0] == "Order ID"
    assert (summary["base_total_rows_removed"], summary["rows_added"], summary["final_rows"]) == (1, 1, 3)


def test_append_rejects_another_column_set(frame):
    with pytest.raises(ValueError, match="lacks"):
        tw.append_tables(frame("A int, B int", [(1, 2)]), {"n": frame("A int, C int", [(3, 4)])})
    with pytest.raises(ValueError):
        tw.append_tables(frame("A int", [1]), {})


def test_append_by_key_tells_both_reasons(frame):
    cols = "`Order ID` string, Nama string, Harga string, no int"
    base = frame(cols, [("A1", "Budi", "Rp 100.000", 0)])
    new = frame(cols, [("A1", "Budi", "Rp 100.000", 1), ("A3", "Cici", "Rp 999.000", 2), ("A3", "Cici", "Rp 900.000", 3), ("A2", "Ayu", "Rp 150.000", 4)], parts=3)
    result = tw.append_tables(base, {"new.csv": new}, keys=["Order ID"], order_by=["no"])
    assert ids(result.data) == ["A1", "A2", "A3"]
    assert result.data.where("`Order ID` = 'A3'").first()["Harga"] == 999000.0
    assert {(r["no"], r["Alasan"]) for r in result.skipped.collect()} == {(1, "sudah ada di file dasar"), (3, "duplikat di file baru")}


def test_similar_ids_are_not_numbers(frame):
    base = frame("`Order ID` string", ["ORD-10641"])
    result = tw.append_tables(base, {"n": frame("`Order ID` string", ["INV-10641", "ABC-10641"])}, keys=["Order ID"])
    assert ids(result.data) == ["ABC-10641", "INV-10641", "ORD-10641"] and result.skipped.count() == 0


def test_equal_ambiguous_dates(frame):
    cols = "`Order ID` string, Tanggal string"
    result = tw.append_tables(frame(cols, [("A1", "03/04/2025")]), {"n": frame(cols, [("A1", "03/04/2025")])})
    assert result.data.count() == 1 and result.skipped.count() == 1


def test_files_are_appended_one_after_the_other(frame):
    cols = "k string, v int"
    base = frame(cols, [("a", 1)])
    files = {"f1": frame(cols, [("b", 1), ("c", 1)]), "f2": frame(cols, [("b", 2), ("d", 1), ("d", 2)]), "f3": frame(cols, [("a", 3), ("d", 3), ("e", 1)])}
    result = tw.append_tables(base, files, keys=["k"], order_by=["v"])
    assert values(result.data) == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1)]
    assert values(result.file_counts, "_file_no") == [(0, "f1", 2, 2, 0, 0), (1, "f2", 3, 1, 1, 1), (2, "f3", 3, 1, 2, 0)]


def test_tagged_append_without_keys_still_finds_base_rows(frame):
    cols = "k string, v int"
    result = tw.append_tables(frame(cols, [("a", 1)]), {"n.csv": frame(cols, [("a", 1), ("b", 2)])}, source_col="Sumber File", base_name="base.csv")
    assert values(result.data) == [("a", 1, "base.csv"), ("b", 2, "n.csv")]


def test_second_append_of_the_same_file_adds_nothing(frame):
    cols = "k string, v double, t string"
    base = frame(cols, [("a", 1.0, "x")])
    new = frame(cols, [("b", None, None), ("c", 3.0, "y")])
    first = tw.append_tables(base, {"n": new})
    assert first.data.where("k = 'b'").first()["t"] == "Unknown"
    # the stored result holds filled values; the raw file is compared before filling
    raw = tw.append_tables(base.unionByName(new), {"n": new})
    assert raw.added.count() == 0
    filled = tw.append_tables(base.unionByName(new), {"n": new}, compare="filled")
    assert values(filled.added.select("k")) == [("b",)]


def test_statistics_are_taken_per_file(frame):
    cols = "k string, v double"
    files = {"f1": frame(cols, [("b", 10.0), ("c", None)]), "f2": frame(cols, [("d", 90.0), ("e", None)])}
    result = tw.append_tables(frame(cols, [("a", 1.0)]), files)
    assert values(result.data) == [("a", 1.0), ("b", 10.0), ("c", 10.0), ("d", 90.0), ("e", 90.0)]
    assert [p.fills["v"].value for _, p in sorted(result.plans.items())] == [10.0, 90.0]
    told = {r["file"]: r["actions"] for r in result.cleaning_summary().collect()}
    assert "median (10.0)" in told["f1"] and "median (90.0)" in told["f2"]


def test_date_order_is_settled_per_file(frame):
    cols = "k string, tanggal string"
    base = frame(cols, [("a", "2025-01-01")])
    files = {"f1": frame(cols, [("b", "25/03/2025"), ("c", "03/04/2025")]), "f2": frame(cols, [("d", "03/25/2025"), ("e", "03/04/2025")])}
    got = {r["k"]: r["tanggal"] for r in tw.append_tables(base, files).data.collect()}
    assert got["c"] == datetime(2025, 4, 3) and got["e"] == datetime(2025, 3, 4)


def test_column_kinds_that_differ_between_files_stay_text(frame):
    cols = "k string, v string"
    files = {"f1": frame(cols, [("b", "Rp 1.000")]), "f2": frame(cols, [("c", "words")])}
    result = tw.append_tables(frame(cols, [("a", "x")]), files)
    assert values(result.data) == [("a", "x"), ("b", "Rp 1.000"), ("c", "words")]


def test_larger_append_keeps_prices_and_dates(spark):
    start = datetime(2024, 1, 1)
    day = [start + timedelta(days=i) for i in range(5400)]
    base = spark.createDataFrame([(f"ORD-{i + 1:05d}", 1000 + i, day[i].strftime("%Y-%m-%d")) for i in range(5000)], "`Order ID` string, Harga long, Tanggal string")
    new = [(f"ORD-{i + 1:05d}", f"Rp {1000 + i:,}", day[i].strftime("%d/%m/%Y")) for i in range(100)]
    new += [(f"ORD-{5001 + i:05d}", f"Rp {1100 + i:,}", day[5000 + i].strftime("%d/%m/%Y")) for i in range(400)]
    new = spark.createDataFrame(new, "`Order ID` string, Harga string, Tanggal string").repartition(5)
    result = tw.append_tables(base, {"new.csv": new}, keys=["Order ID"])
    rows = {r["Order ID"]: (r["Harga"], r["Tanggal"]) for r in result.data.collect()}
    assert len(rows) == 5400 and result.skipped.count() == 100
    assert all(rows[f"ORD-{i + 1:05d}"] == (1000 + i, day[i]) for i in range(5000))
    assert all(rows[f"ORD-{5001 + i:05d}"] == (1100 + i, day[5000 + i]) for i in range(400))


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_one_key_holds_a_third_of_the_rows(spark, hot_rows):
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 200}", i) for i in range(600)]
    base = spark.createDataFrame([("k1", 0), ("hot2", 0)], "k string, v int")
    new = spark.createDataFrame(rows, "k string, v int").repartition(6)
    result = tw.append_tables(base, {"n": new}, keys=["k"], order_by=["v"], hot_rows=hot_rows)
    added = {r["k"]: r["v"] for r in result.added.collect()}
    assert added == {"hot": 0, **{f"k{i}": i for i in range(200) if i != 1}}
    assert values(result.file_counts) == [(0, "n", 900, 200, 3, 697)]


CANONICAL = [
    ("ORD-10641", "ord-10641"), ("100€", "n:100.0"), ("Rp 1.234.567,00*", "n:1234567.0"), ("1.500", "n:1500.0"), ("1,500", "n:1500.0"),
    ("1,5", "n:1.5"), ("1500", "n:1500.0"), ("  Hello ", "hello"), ("", None), (None, None), ("03/04/2025", "d:2025-04-03"),
    ("4 June 2025", "d:2025-06-04"), ("June 4, 2025", "d:2025-06-04"), ("2025-07-04", "d:2025-07-04"), ("12 [3]", "n:12.0"), ("1,2,3", "1,2,3"),
]


def test_canonical_text(frame):
    df = frame("v string", [v for v, _ in CANONICAL])
    got = {r["v"]: r["c"] for r in df.select("v", canonical(F.col("v"), T.StringType()).alias("c")).collect()}
    assert got == dict(CANONICAL)


def test_canonical_types(spark):
    row = spark.sql("SELECT 1 AS i, 1.0D AS d, CAST(1 AS DECIMAL(10,2)) AS m, true AS b, -0.0D AS z, TIMESTAMP_NTZ '2025-07-04 10:00:00' AS t, DATE '2025-07-04' AS a, double('nan') AS n")
    out = row.select(*[canonical(F.col(f.name), f.dataType).alias(f.name) for f in row.schema]).first()
    assert (out["i"], out["d"], out["m"], out["b"], out["z"]) == ("n:1.0",) * 4 + ("n:0.0",)
    assert out["t"] == out["a"] == "d:2025-07-04" and out["n"] is None


def test_union_reconciles_types(frame):
    a, b = frame("v int", [1]), frame("v double", [2.5])
    assert values(combine.unite(a, b)) == [(1.0,), (2.5,)]
    assert values(combine.unite(a, frame("v string", ["x"]))) == [("1",), ("x",)]
    assert combine.unite(a, frame("v long", [2])).schema["v"].dataType == T.LongType()
    assert combine.column_diff(["a", "b"], ["b", "c"]) == (["a"], ["c"])


def test_simple_cleaning(frame):
    df = frame("nama string, umur int, tanggal_masuk string, note string", [("  budi santoso ", 20, "2024-01-15", " a  b "), (" x ", None, None, None), (" x ", None, None, None)])
    rows = values(tw.clean_simple(df).data, "nama")
    assert rows == [("Budi Santoso", 20, datetime(2024, 1, 15), "a  b"), ("X", 20, None, "Unknown")]


def test_tables_and_batch(frame):
    tables = {"Penjualan": frame("tanggal string, produk string, harga string, kuantitas int", [("2024-01-15", "  LAPTOP ASUS [VIP]  ", "Rp 15.000.000", 2)] * 2 + [("2024-02-10", "mouse wireless", "150.000", 5)]),
              "Pelanggan": frame("id int, nama_pelanggan string", [(1, "budi santoso [VIP]")] * 2)}
    assert list(tw.clean_tables(tables)) == ["Penjualan"]
    both = tw.clean_tables(tables, "Penjualan, Pelanggan")
    assert both["Penjualan"].data.count() == 2 and values(both["Pelanggan"].data) == [(1, "Budi Santoso [VIP]")]
    assert list(tw.clean_tables(tables, every=True)) == list(tables)
    with pytest.raises(ValueError, match="Unknown tables"):
        tw.clean_tables(tables, ["nope"])
    metrics, status = tw.tables_summary(both)
    assert metrics.select("table_name").distinct().count() == 2 and status.count() == 6

    def broken():
        raise OSError("cannot read")

    results, lines = tw.clean_batch({**tables, "bad": broken})
    assert list(results) == list(tables) and lines[-1] == ("bad", False, "OSError: cannot read")


def test_configuration(tmp_path):
    cfg = CleanConfig.from_dict({"missing": {"numeric_strategy": "mean"}, "duplicate": {"keep": False}, "unknown": {"x": 1}, "number": {"kolom_angka": ["a"], "no": 1}})
    assert cfg.missing.numeric_strategy == "mean" and cfg.missing.text_constant == "Unknown"
    assert cfg.duplicate.keep == "none" and cfg.number.number_columns == ("a",)
    path = tmp_path / "c.yaml"
    path.write_text("text:\n  case_format: upper\n  kolom_exclude:\n    - x\nformatting:\n  currency: USD\n")
    loaded = CleanConfig.from_yaml(str(path))
    assert loaded.text.case_format == "upper" and loaded.text.exclude_columns == ("x",) and loaded.formatting.currency == "USD"
    assert CleanConfig.from_yaml(str(tmp_path / "none.yaml")) == CleanConfig()
    (tmp_path / "bad.yaml").write_text("a: [")
    assert CleanConfig.from_yaml(str(tmp_path / "bad.yaml")) == CleanConfig()
    assert CleanConfig().formatting.add_total_row is None


def test_a_file_with_an_empty_column_follows_the_others(frame):
    cols = "k string, harga string, tanggal string"
    base = frame(cols, [("a", "Rp 1.000", "2025-01-01")])
    files = {"f1": frame(cols, [("b", None, None)]), "f2": frame(cols, [("c", "Rp 2.000", "2025-01-02")]), "f3": frame(cols, [(None, None, None)]), "f4": frame(cols, [("x", None, None)]).where("false")}
    result = tw.append_tables(base, files)
    assert result.data.schema["harga"].dataType == T.DoubleType() and dict(result.data.dtypes)["tanggal"] == "timestamp_ntz"
    assert sorted(str(r["k"]) for r in result.data.collect()) == ["Unknown", "a", "b", "c"]
    assert [r["rows_read"] for r in result.file_counts.orderBy("_file_no").collect()] == [1, 1, 1, 0]


def test_append_to_and_of_empty_tables(frame):
    cols = "k string, v int"
    empty = frame(cols, [("a", 1)]).where("false")
    assert tw.append_tables(empty, {"n": frame(cols, [("b", 1)])}).data.count() == 1
    assert tw.append_tables(frame(cols, [("b", 1)]), {"n": empty}).data.count() == 1
    assert tw.clean(empty).data.count() == 0


@pytest.mark.parametrize("strategy, expected", [("median", [2.0, 90.0, None]), ("mean", [2.0, 90.0, None]), ("mode", [1.0, 90.0, 0.0])])
def test_fill_values_of_many_tables(frame, strategy, expected):
    from tablewright.operators import quantiles
    from tablewright.operators.impute import fill_values_by

    rows = [(0, 1.0), (0, 1.0), (0, 2.0), (0, 4.0), (0, 2.0), (0, None), (1, 90.0), (1, None), (2, None)]
    df = frame("t int, v double", rows, parts=3)
    wanted = {0: {"v": 5}, 1: {"v": 1}, 2: {"v": 0}}
    found = fill_values_by(df, "t", wanted, strategy)  # modes come back as text
    assert [None if found[g]["v"] is None else float(found[g]["v"]) for g in range(3)] == expected
    assert [quantiles.medians_by(df, "t", wanted, small=2)[g]["v"] for g in range(3)] == [2.0, 90.0, None]


def test_modes_and_constants_per_file(frame):
    cols = "k string, v int, b boolean"
    files = {"f1": frame(cols, [("p", 1, True), ("q", 1, True), ("r", None, None)]), "f2": frame(cols, [("s", 5, False), ("t", None, None)])}
    for strategy, want in (("mode", [(1, True), (5, False)]), ("constant", [(0, False), (0, False)])):
        cfg = CleanConfig.from_dict({"missing": {"numeric_strategy": strategy}})
        got = {r["k"]: (r["v"], r["b"]) for r in tw.append_tables(frame(cols, [("a", 0, True)]), files, cfg).data.collect()}
        assert [got["r"], got["t"]] == want


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_join_with_keys_that_hold_a_third_of_the_rows(spark, hot_rows):
    rows = [(7, i) for i in range(60)] + [(None, i) for i in range(60)] + [(8, i) for i in range(20)] + [(i, i) for i in range(60)]
    left = spark.createDataFrame(rows, "k int, a int").repartition(6)
    others = [(7, "x"), (7, "y"), (None, "n"), (3, "z")] + [(5, f"m{i}") for i in range(40)] + [(99, f"o{i}") for i in range(40)]
    right = spark.createDataFrame(others, "k int, b string").repartition(3)
    result = tw.join_chain({"l": left, "r": right}, "k", hot_rows=hot_rows)
    want = sorted(str((k, a, b)) for k, a in rows for b in ([y for x, y in others if k is not None and x == k] or [None]))
    assert sorted(str((r["k"], r["a"], r["b"])) for r in result.data.collect()) == want
    assert tuple(result.stages.select("left_rows", "matched_rows").first()) == (200, 63)
    assert sorted(r["b"] for r in result.orphans.collect()) == sorted(b for k, b in others if k in (None, 99))


def test_more_frequent_keys_than_any_list(spark):
    left = spark.range(6000).selectExpr("id % 2000 AS k", "id AS a")
    right = spark.range(4000).selectExpr("id % 2000 AS k", "id AS b")
    result = tw.join_chain({"l": left, "r": right}, "k", hot_rows=1)
    assert (result.data.count(), result.data.select("a", "b").distinct().count(), result.orphans.count()) == (12000, 12000, 0)


def test_order_based_fills_stay_inside_their_file(frame):
    cols = "kode string, i int, v double, t string"
    files = {f"f{n}": frame(cols, [(f"{n}{i}", i, float(10 * n + i) if i % 3 == 1 else None, None if i < 2 else f"t{n}{i}") for i in range(7)]) for n in range(3)}
    cfg = CleanConfig.from_dict({"missing": {"numeric_strategy": "interpolate", "text_strategy": "ffill"}})
    result = tw.append_tables(frame(cols, [("x", 0, 0.0, "b")]), files, cfg, order_by=["i"])
    got = {r["kode"]: (r["v"], r["t"]) for r in result.data.collect()}
    for n in range(3):
        assert [got[f"{n}{i}"][0] for i in range(7)] == pytest.approx([10 * n + x for x in (1, 1, 2, 3, 4, 4, 4)])
        assert [got[f"{n}{i}"][1] for i in range(7)] == ["Unknown", "Unknown"] + [f"t{n}{i}" for i in range(2, 7)]


@pytest.mark.parametrize("rows_per_bucket", [3, 1000])
def test_fills_within_tables_over_buckets(spark, rows_per_bucket):
    from tablewright.operators.carry import carry_fill

    rows = [(g, i, float(i) if i in (4, 9) else None) for g in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(5)
    want = {"ffill": [None] * 4 + [4.0] * 5 + [9.0] * 3, "bfill": [4.0] * 5 + [9.0] * 5 + [None] * 2,
            "interpolate": [4.0] * 4 + [4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 9.0, 9.0]}
    for how, values_ in want.items():
        out = carry_fill(df, {"v": how}, ["i"], rows_per_bucket=rows_per_bucket, within="g").orderBy("g", "i").collect()
        assert [r["v"] for r in out] == values_ * 3


def test_many_tables_make_a_flat_plan(spark):
    """A thousand tables, united in halves; types meet in the order of the tables."""
    ints, longs, doubles, words = (spark.createDataFrame([(7,)], f"v {t}") if t != "string" else spark.createDataFrame([("x",)], "v string") for t in ("int", "bigint", "int", "string"))
    doubles = doubles.select((F.col("v") / 2).alias("v"))
    assert sorted(r["v"] for r in combine.unite(ints, longs).collect()) == [7, 7]
    assert combine.unite(ints, longs, doubles).schema["v"].dataType.simpleString() == "double"
    mixed = combine.unite(ints, doubles, words)
    assert sorted(r["v"] for r in mixed.collect()) == ["3.5", "7.0", "x"]
    assert sorted(r["v"] for r in combine.unite(words, ints, doubles).collect()) == ["3.5", "7", "x"]

    one = spark.range(3).select(F.col("id").alias("i"), F.lit("a").alias("s"))
    start = time.monotonic()
    stacked = combine.stack({f"f{i}.csv": one for i in range(1000)})
    stacked.explain()
    assert time.monotonic() - start < 60  # a few seconds on a machine without other work
    depth, level = 0, [stacked._jdf.queryExecution().analyzed()]
    while level:
        depth, level = depth + 1, [node.children().apply(0) for node in level if node.children().nonEmpty()]
    assert depth < 40 and len(stacked.columns) == 3


def test_chains_of_random_headers():
    """Branch and bound against all orders of the tables."""
    rng = random.Random(4)
    for _ in range(150):
        tables = list("abcdef"[: rng.randint(2, 6)])
        shared = {}
        for a, b in itertools.combinations(tables, 2):
            if n := max(0, rng.randint(-2, 3)):
                shared[a, b] = shared[b, a] = n
        scores = [[shared.get(pair, 0) for pair in itertools.pairwise(order)] for order in itertools.permutations(tables)]
        best = max((sum(s) for s in scores if all(s)), default=-1)
        for floor in range(-1, 12):
            assert recommend._chain_above(tables, shared, floor) == (best > floor), (shared, floor)


@pytest.mark.parametrize("heavier", [False, True])
def test_forty_connected_headers_answer_at_once(heavier):
    """Every pair of tables shares one column of its own; one pair may share a second one."""
    headers = {f"t{i}": [f"k{min(i, j)}_{max(i, j)}" for j in range(40) if j != i] for i in range(40)}
    if heavier:
        headers["t3"].append("more"), headers["t30"].append("more")
    start = time.monotonic()
    got = tw.recommend_combine(headers)
    assert time.monotonic() - start < 5  # well below a second on a machine without other work
    assert got.mode == ("unknown" if heavier else "join")
    assert heavier or got.keys == tuple(f"k{i}_{i + 1}" for i in range(39))
