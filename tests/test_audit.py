import pytest
from conftest import values

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions.names import column_role, file_stem
from tablewright.plans.rules import CleanPlan


def messy(frame):
    return frame("nama string, gaji string, tanggal string, umur int", [
        (" budi ", "Rp 5.000", "2024-01-15", 20), (" budi ", "Rp 5.000", "2024-01-15", 20), ("siti", None, None, None), ("ana", "Rp 7.000", "2024-01-16", 30),
    ])


def test_metrics_and_status(frame):
    result = tw.clean(messy(frame), source="in.csv")
    metrics = {r["metric"]: r["value"] for r in result.run_metrics().collect()}
    assert metrics == {"rows_in": 4, "columns_in": 4, "rows_dropped": 0, "duplicates_removed": 1, "missing_found": 3,
                       "missing_repaired": 2, "unparsed": 0, "rows_out": 3, "columns_out": 4}
    status = values(result.column_status(), "no")
    assert status[0] == (1, "nama", "string", 0, "'nama': normalize unicode, strip whitespace, Smart Title Case")
    assert status[1] == (2, "gaji", "double", 1, "'gaji': currency → float; 'gaji' (numeric): 1 missing → median (5000.0)")
    assert status[2] == (3, "tanggal", "timestamp_ntz", 1, "'tanggal' → datetime; 'tanggal' (datetime): 1 missing → left empty (valid datetime)")
    assert "string angka" not in str(status) and "dibiarkan" in str(values(result.column_status("id"), "no"))


def test_clean_column_is_reported_as_clean(frame):
    status = values(tw.clean(frame("i int", [1, 2])).column_status())
    assert status == [(1, "i", "int", 0, "Data already clean")]


def test_totals(frame):
    df = frame("nama string, gaji double, umur int, kode int, jumlah long", [("Budi", 5e6, 20, 1, 2), ("Ani", 6e6, 30, 2, 3)])
    assert tuple(tw.totals(df).first()) == ("TOTAL", 11e6, None, None, 5)
    whole = tw.with_total_row(df)
    assert whole.count() == 3 and tw.drop_total_rows(whole).count() == 3  # sums are filled, so this is no footer
    assert tw.with_total_row(df, add_total_row=False).count() == 2
    assert tw.totals(df.where("false")).count() == 0
    footer = frame("a string, b string", [("x", "1"), (" total ", None), ("TOTAL", "3"), (None, None)])
    assert tw.drop_total_rows(footer).count() == 3


@pytest.mark.parametrize("name, dtype, role", [
    ("gaji_karyawan", "double", "currency"), ("tanggal_masuk", "timestamp_ntz", "date"), ("diskon_pct", "double", "percent"),
    ("umur", "bigint", "integer"), ("x", "bigint", "integer"), ("x", "double", "decimal"), ("x", "string", "text"), ("x", "timestamp", "date"),
])
def test_roles(name, dtype, role):
    assert column_role(name, dtype)[0] == role
    assert column_role("harga", "double", "USD")[1] == '"$"#,##0.00' and column_role("harga", "double")[1] == '"Rp" #,##0'


def test_role_table_and_display(frame):
    df = frame("harga double, margin double, qty int, x double", [(1234.0, 0.155, 1200, 1.5)])
    assert [r["role"] for r in tw.column_roles(df).orderBy("no").collect()] == ["currency", "percent", "integer", "decimal"]
    assert tuple(tw.display_format(df).first()) == ("Rp 1,234", "15.5%", "1,200", "1.50")
    assert tw.display_format(df, "USD").first()[0] == "$1,234.00"


def test_sources_and_preview(frame):
    tables = {"b.csv": frame("i int", [1, 2]), "a.csv": frame("i int", [3])}
    df = tw.stack(tables)
    assert [r[0] for r in tw.list_sources(df).collect()] == ["a.csv", "b.csv"]
    assert tw.filter_source(df, "b.csv").count() == 2
    before, after = tw.preview(df, df.where("i > 1"), 2, ["i"])
    assert [r["i"] for r in before.collect()] == [1, 2] and [r["i"] for r in after.collect()] == [2, 3]
    assert tuple(tw.table_shape(df).first()) == (3, 2)


def test_plan_survives_json(frame):
    df = messy(frame)
    cfg = CleanConfig.from_dict({"text": {"custom_acronyms": ["xyz"]}, "duplicate": {"subset": ["nama"]}})
    plan = tw.clean(df, cfg, order_by=["nama"]).plan
    again = CleanPlan.from_json(plan.to_json())
    assert values(tw.clean_with_plan(df, again)) == values(tw.clean_with_plan(df, plan))
    assert again.duplicate == plan.duplicate and again.dates == plan.dates


def test_file_stem():
    assert [file_stem(p) for p in ("a/b/c.csv", "x.tar.gz", "plain", "d/")] == ["c", "x.tar", "plain", "d"]
