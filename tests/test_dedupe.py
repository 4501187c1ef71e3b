import random

import pytest
from conftest import values

import tablewright as tw
from tablewright.config import CleanConfig


def test_whole_rows(frame):
    df = frame("id int, nama string", [(1, "Andi"), (2, "Budi"), (2, "Budi"), (3, "Cici")])
    assert tw.dedupe(df).count() == 3
    assert tw.count_duplicates(df).first()["duplicates"] == 1
    assert tw.count_duplicates(df, keep="none").first()["duplicates"] == 2


ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "p"), (4, None, "q"), (5, "b", "z")]


@pytest.mark.parametrize("keep, expected", [("first", [1, 3, 5]), ("last", [2, 4, 5]), ("none", [5]), (False, [5])])
@pytest.mark.parametrize("parts", [1, 4])
def test_keep_with_ties_and_null_keys(frame, keep, expected, parts):
    df = frame("i int, k string, v string", ROWS, parts)
    assert [r[0] for r in values(tw.dedupe(df, ["k"], keep, ["i"]), "i")] == expected


def test_keep_none_on_whole_rows(frame):
    df = frame("k string", ["a", "a", "b", None, None])
    assert values(tw.dedupe(df, keep="none")) == [("b",)]


def test_unknown_key_and_keep(frame):
    df = frame("k string", ["a"])
    with pytest.raises(KeyError):
        tw.dedupe(df, ["nope"])
    with pytest.raises(ValueError):
        tw.dedupe(frame("k string, v string", [("a", "b")]), ["k"], "middle")


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20), rng.randint(0, 3), i) for i in range(500)]
    want = {}
    for k, d, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, i)
    for parts in (1, 4, 50):
        df = spark.createDataFrame(rows, "k int, d int, i int").repartition(parts)
        got = {r["k"]: r["i"] for r in tw.dedupe(df, ["k"], "first", ["d", "i"]).collect()}
        assert got == want
        # without an order the survivor is arbitrary, but the same every time
        free = sorted(map(tuple, tw.dedupe(df, ["k"], "first").collect()))
        assert free == sorted(map(tuple, tw.dedupe(df.repartition(3), ["k"], "first").collect()))


def test_duplicates_are_compared_before_text_is_normalised(frame):
    df = frame("nama string", ["budi", "BUDI", "budi"])
    assert values(tw.clean(df).data) == [("Budi",), ("Budi",)]
    late = CleanConfig.from_dict({"duplicate": {"after_text": True}})
    assert values(tw.clean(df, late).data) == [("Budi",)]


def test_subset_from_configuration(frame):
    df = frame("i int, k string", [(1, "a"), (2, "a"), (3, "b")])
    cfg = CleanConfig.from_dict({"duplicate": {"subset": ["k"], "keep": "last"}})
    assert values(tw.clean(df, cfg, order_by=["i"]).data, "i") == [(2, "a"), (3, "b")]
    none = CleanConfig.from_dict({"duplicate": {"subset": ["k"], "keep": False}})
    assert values(tw.clean(df, none).data) == [(3, "b")]


def test_provenance(frame):
    df = frame("src int, a string, b int", [(0, "x", 1), (0, "x", 1), (0, None, 2), (1, "x", 1), (1, None, 2), (1, "y", 3), (1, "y", 3), (2, "y", 3)])
    assert values(tw.duplicate_provenance(df, "src", ["a", "b"]), "source") == [(0, 3, 1, 0), (1, 4, 1, 2), (2, 1, 0, 1)]
    seen = {(r["a"], r["b"]): (r["first_source"], r["rows"], r["sources"]) for r in tw.first_seen(df, "src", ["a", "b"]).collect()}
    assert seen == {("x", 1): (0, 3, 2), (None, 2): (0, 2, 2), ("y", 3): (1, 3, 2)}


def test_sample_file(frame):
    rows = [
        ("Hani Wijaya", "hani@email.com", 25, "Jakarta", 5000000, "2024-01-15"),
        ("  budi santoso  ", "budi@email.com", 30, "BANDUNG", 7000000, "2024-02-20"),
        ("Citra Lestari", "citra@email.com", None, "jakarta", 6000000, "2024-03-10"),
        ("Hani Wijaya", "hani@email.com", 25, "Jakarta", 5000000, "2024-01-15"),
        ("doni pratama", "doni@email.com", 28, "surabaya", None, "2024-04-05"),
        ("Eka Putri", "eka@email.com", 35, "JAKARTA", 8000000, "2024-05-12"),
        ("  budi santoso  ", "budi@email.com", 30, "BANDUNG", 7000000, "2024-02-20"),
        ("Fani Rahma", None, 22, "Bandung", 4500000, "2024-06-01"),
        ("Gita Nuraini", "gita@email.com", 27, "SURABAYA", 5500000, None),
        ("Hani Wijaya", "hani@email.com", 25, "Jakarta", 5000000, "2024-01-15"),
        ("Indra Kusuma", "indra@email.com", None, "yogyakarta", 6500000, "2024-08-15"),
        ("Joko Widodo", "joko@email.com", 40, "  JAKARTA  ", 9000000, "2024-09-01"),
        ("Kartini Sari", "kartini@email.com", 33, "bandung", None, "2024-10-10"),
        ("Lisa Permata", "lisa@email.com", 26, "Surabaya", 5200000, "2024-11-20"),
        ("  budi santoso  ", "budi@email.com", 30, "BANDUNG", 7000000, "2024-02-20"),
    ]
    result = tw.clean(frame("nama string, email string, umur int, kota string, gaji int, tanggal_masuk string", rows))
    metrics = {r["metric"]: r["value"] for r in result.run_metrics().collect()}
    assert (metrics["rows_in"], metrics["rows_out"], metrics["duplicates_removed"]) == (15, 11, 4)
    assert result.plan.fills["umur"].value == 28.0 and result.plan.fills["gaji"].value == 6000000.0
    assert {r["kota"] for r in result.data.collect()} == {"Jakarta", "Bandung", "Surabaya", "Yogyakarta"}
    assert result.data.schema["tanggal_masuk"].dataType.simpleString() == "timestamp_ntz"
    assert tw.totals(result.data).first()["gaji"] == sum(r["gaji"] for r in result.data.collect())
    assert tw.totals(result.data).first()["umur"] is None
