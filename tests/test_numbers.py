import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions import numbers


def read(frame, rule, texts):
    df = frame("i int, v string", list(enumerate(texts)))
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_currency_and_percent(frame):
    df = frame("gaji string, diskon string", [("Rp 5.000.000", "10%"), ("Rp 7.500.000,50", "25%"), ("1.200.000", "5%")])
    out = tw.clean(df).data.orderBy("gaji").collect()
    assert [tuple(r) for r in out] == [(1200000.0, 0.05), (5000000.0, 0.10), (7500000.5, 0.25)]


NUMBERS = [
    ("$229,100,000[b]", 229100000.0), ("$500,000[a][b]", 500000.0), ("Rp 2.500.000,00[1]", 2500000.0),
    ("100,000[b]", 100000.0), ("1.500.000[3]", 1500000.0), ("Rp 75.579", 75579.0), ("Rp. 1.500.000,50", 1500000.5),
    ("-1.500.000", -1500000.0), ("0,5", 0.5), ("1,5", 1.5), ("1,500.50", 1500.5), ("-Rp 5.000", -5000.0),
    ("1234.567", 1234567.0), ("€ 12", 12.0), ("usd 3", 3.0), ("1e5", 100000.0), ("  42  ", 42.0),
    ("1d", None), ("nan", None), ("None", None), ("", None), ("abc", None), ("12 apples", None), (None, None),
]


def test_parse_number(frame):
    texts, expected = zip(*NUMBERS)
    assert dict(zip(texts, read(frame, numbers.parse_number, texts))) == dict(zip(texts, expected))


def test_us_style_keeps_three_decimals(frame):
    assert read(frame, lambda c: numbers.parse_number(c, "us"), ["1234.567", "1,234.567"]) == [1234.567, 1234.567]


PERCENTS = [
    ("15%", 0.15), ("1.234,5%", 12.345), ("12,5 %", 0.125), ("1.5%", 0.015), ("1,234.5%", 12.345), ("-3%", -0.03), ("x%", None), (None, None),
]


def test_parse_percent(frame):
    texts, expected = zip(*PERCENTS)
    assert read(frame, numbers.parse_percent, texts) == pytest.approx(list(expected))


def test_order_totals_survive_their_spelling(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    cents = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    spelled = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("€ "), F.translate(cents, ",.", ".,"))).otherwise(F.concat(cents, F.lit("[z]")))
    out = tw.clean(orders.select("o_orderkey", spelled.alias("biaya"))).data.join(orders, "o_orderkey")
    assert orders.count() == out.where(F.abs(F.col("biaya") - F.col("o_totalprice").cast("double")) < 0.006).count()


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(10**3, 10**13), st.sampled_from(".,"), st.sampled_from(["", "€ ", "usd "])), min_size=1, max_size=30))
def test_grouped_numbers_of_any_size(frame, cases):
    raw = [before + f"{n:,}".replace(",", mark) for n, mark, before in cases]
    assert read(frame, numbers.parse_number, raw) == [float(n) for n, _, _ in cases]


def kinds(df, **cfg):
    found = tw.detect_columns(df, CleanConfig.from_dict(cfg))
    return dict(found.numbers), set(found.dates)


def test_detection_order_and_names(frame):
    df = frame(
        "harga string, persen string, jumlah string, no_telp string, nama string",
        [("Rp 1.000", "5%", "1,000", "0812345", "Budi"), ("2.000", "6%", "2,000", "0812346", "Siti")],
    )
    assert kinds(df) == ({"harga": "currency", "persen": "percent", "jumlah": "number"}, set())


def test_iso_dates_are_no_numbers(frame):
    df = frame("tanggal_masuk string, lain string", [("2024-01-15", "15.01.2024"), ("2024-02-20", "16.02.2024")])
    assert kinds(df) == ({}, {"tanggal_masuk", "lain"})


def test_dashed_phone_numbers_stay_text(frame):
    df = frame("kontak string", ["021-555-1234", "022-555-1235"])
    assert kinds(df) == ({}, set())


def test_names_are_matched_by_whole_words(frame):
    df = frame("gender string, width string, candidate string", [("f", "a", "x"), ("m", "b", "y")])
    assert kinds(df) == ({}, set())
    wide = frame("width string", ["1,000", "2,000"])
    assert kinds(wide)[0] == {"width": "number"}
    assert kinds(wide, match="substring")[0] == {}  # "id" inside "width"


def test_configured_columns_win_and_unknown_ones_are_ignored(frame):
    df = frame("kode string", ["001", "002"])
    cfg = {"number": {"kolom_angka": ["kode", "nothing"], "auto_detect": False}}
    assert kinds(df, **cfg)[0] == {"kode": "number"}


def test_detection_does_not_leak_between_tables(frame):
    cfg = CleanConfig()
    money = frame("x string", ["Rp 1.000", "Rp 2.000"])
    text = frame("x string", ["plain", "words"])
    assert tw.clean(money, cfg).plan.numbers == {"x": "currency"}
    assert tw.clean(text, cfg).plan.numbers == {}
    assert sorted(r[0] for r in tw.clean(text, cfg).data.collect()) == ["plain", "words"]


def test_unparsed_values_are_counted_and_can_be_kept(frame):
    df = frame("harga string", ["Rp 1.000", "Rp 2.000", "Rp 3.000", "free"])
    result = tw.clean(df, CleanConfig.from_dict({"number": {"on_unparsed": "keep_raw_column"}}))
    assert result.plan.unparsed == {"harga": 1}
    rows = {r["harga__raw"]: r["harga"] for r in result.data.where("harga__raw is not null").collect()}
    assert rows == {"free": 2000.0}  # the median stands in, the raw text is kept
    assert [tuple(r) for r in result.warnings().collect()] == [("harga", "unparsed", 1)]


def test_detection_weighs_the_whole_column(frame):
    df = frame("i int, v string", [(1, "Rp 1.000"), (2, "Rp 2.000")] + [(i, "word") for i in range(3, 30)])
    assert tw.detect_columns(df, order_by=["i"]).numbers == {}
