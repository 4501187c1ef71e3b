from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions import dates


SINGLE = [
    ("2024-01-15", datetime(2024, 1, 15)), ("2025.07.10", datetime(2025, 7, 10)), ("2025/03/05", datetime(2025, 3, 5)),
    ("15/02/2024", datetime(2024, 2, 15)), ("12/31/2024", datetime(2024, 12, 31)), ("03/04/2025", datetime(2025, 4, 3)),
    ("1.2.2024", datetime(2024, 2, 1)), ("04 Jun 2025", datetime(2025, 6, 4)), ("4-june-2025", datetime(2025, 6, 4)),
    ("June 4, 2025", datetime(2025, 6, 4)), ("Sept 4 2025", datetime(2025, 9, 4)), ("Jun 2025", datetime(2025, 6, 1)),
    ("2024-01-15 10:30:00", datetime(2024, 1, 15, 10, 30)), ("2024-01-15T10:30:00.25Z", datetime(2024, 1, 15, 10, 30, 0, 250000)),
    ("2024-01-15T1030", datetime(2024, 1, 15, 10, 30)), ("2025-01-01 7", datetime(2025, 1, 1, 7)),
    ("15/01/2024 10:30", datetime(2024, 1, 15, 10, 30)), ("04 Jun 2025 08:01:02", datetime(2025, 6, 4, 8, 1, 2)),
    ("31/12/25", datetime(2025, 12, 31)), ("12/31/99", datetime(1999, 12, 31)), ("20240115", datetime(2024, 1, 15)),
    ("2024", datetime(2024, 1, 1)), (" 2024-01-15 ", datetime(2024, 1, 15)),
    ("10:30", None), ("4 Januari 2025", None), ("2024-13-45", None), ("30/02/2024", None), ("13/13/2024", None), ("words", None), (None, None),
]


def test_single_values(frame):
    df = frame("v string", [t for t, _ in SINGLE])
    got = {r["v"]: r["d"] for r in df.select("v", dates.parse_date(F.col("v")).alias("d")).collect()}
    assert got == dict(SINGLE)


def test_separate_readings(frame):
    df = frame("v string", [("2024-01-15",)])
    assert df.select(dates.parse_ymd(F.col("v"))).first()[0] == datetime(2024, 1, 15)
    assert df.select(dates.parse_day_month(F.col("v"))).first()[0] is None
    assert df.select(dates.parse_named_date(F.lit("June 4, 2025"))).first()[0] == datetime(2025, 6, 4)
    assert df.select(dates.parse_iso_datetime(F.lit("2024-01-15 10:00"))).first()[0] == datetime(2024, 1, 15, 10)
    parts = df.select(*dates.date_parts(F.lit("03-04-2025"))).first()
    assert tuple(parts) == ("-", "03", "04", "2025")


def column(frame, texts, name="tanggal", parts=1):
    return frame(f"no int, {name} string", list(enumerate(texts)), parts)


SPELLINGS = ("%d.%m.%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%B %d, %Y", "%Y-%m-%d %H:%M")


@given(st.lists(st.tuples(st.dates(date(1990, 1, 1), date(2049, 12, 31)), st.sampled_from(SPELLINGS)), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_mixture_of_spellings(frame, drawn):
    """With a day above twelve in each ambiguous spelling every date comes back."""
    drawn = drawn + [(date(2031, 5, 27), s) for s in SPELLINGS]
    result = tw.clean(column(frame, [d.strftime(s) for d, s in drawn], "due_date", parts=3))
    assert [r["due_date"].date() for r in result.data.orderBy("no").collect()] == [d for d, _ in drawn]
    assert result.warnings().count() == 0


@pytest.mark.parametrize("sign", "-./")
def test_a_leading_year_fixes_the_rest(frame, sign):
    """After a year comes the month, even beside values that are read month first."""
    texts = [f"1999{sign}11{sign}02", f"2030{sign}2{sign}9", f"12{sign}31{sign}2001"]
    out = tw.clean(column(frame, texts, "date")).data.orderBy("no").collect()
    assert [r["date"].date() for r in out] == [date(1999, 11, 2), date(2030, 2, 9), date(2001, 12, 31)]


@pytest.mark.parametrize("told, first, ambiguous", [(None, date(2019, 12, 8), 2), ("19/11/2019", date(2019, 12, 8), 0), ("11/19/2019", date(2019, 8, 12), 0)])
def test_one_clear_date_decides_for_its_column(frame, told, first, ambiguous):
    """Two dates that can be read both ways: day first and reported, unless a third one tells the order."""
    texts = ["08/12/2019", "02/10/2020", "07/07/2021", *([told] if told else [])]
    result = tw.clean(column(frame, texts, "date"))
    assert result.data.where("no = 0").first()["date"].date() == first
    assert [(r["column"], r["rows"]) for r in result.warnings().collect()] == ([("date", ambiguous)] if ambiguous else [])
    assert any(str(ambiguous) in r["text"] and r["code"].startswith("ambig") for r in result.actions().collect()) == bool(ambiguous)


def test_evidence_is_kept_per_separator(frame):
    texts = ["25/03/2025", "03/04/2025", "03-25-2025", "03-04-2025"]
    out = {r["no"]: r["tanggal"] for r in tw.clean(column(frame, texts)).data.collect()}
    assert out[1] == datetime(2025, 4, 3) and out[3] == datetime(2025, 3, 4)


def test_free_text_stays_text(frame):
    result = tw.clean(column(frame, ["see 2024-01-15 report", "about 2024-02-01 too", "x 2024-03-01 y"], "catatan"))
    assert result.plan.dates == {} and result.data.schema["catatan"].dataType.simpleString() == "string"


def test_named_but_unreadable_column_stays_text(frame):
    result = tw.clean(column(frame, ["soon", "later", "2024-01-01"], "deadline"))
    assert result.plan.dates == {}


def test_bare_clock_time_is_null_and_counted(frame):
    result = tw.clean(column(frame, ["2024-01-15", "10:30", "2024-01-16"]))
    assert result.data.where("no = 1").first()["tanggal"] is None
    assert result.plan.unparsed == {"tanggal": 1}


def test_integer_columns_never_become_dates(frame):
    result = tw.clean(frame("update_date int, no int", [(2024, 1), (2025, 2)]))
    assert result.plan.dates == {}


def test_fixed_format_fallback(frame):
    df = frame("v string", ["15 January 2024"])
    assert df.select(dates.parse_with_format(F.col("v"), "%d %B %Y")).first()[0] == datetime(2024, 1, 15)
    for fmt, text in (("%d/%m/%Y %H:%M", "15/01/2024 10:30"), ("%b %d, %Y", "Jan 15, 2024")):
        assert df.select(dates.parse_with_format(F.lit(text), fmt)).first()[0] is not None


def test_explicit_columns_without_detection(frame):
    cfg = CleanConfig.from_dict({"date": {"kolom_tanggal": ["x", "nowhere"], "auto_detect": False}})
    out = tw.clean(column(frame, ["2024-01-15", "2024-01-16"], "x"), cfg)
    assert out.data.schema["x"].dataType.simpleString() == "timestamp_ntz"
