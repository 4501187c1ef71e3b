from conftest import values

import pytest
import tablewright as tw
from tablewright.config import CleanConfig


def test_files_that_arrive_are_added_once(spark, tmp_path):
    cols = "k string, harga string, tanggal string, v int"
    base = spark.createDataFrame([("a", "Rp 1.000", "25/03/2025", 1), ("b", "Rp 3.000", "26/03/2025", 2)], cols)
    plan = tw.clean(base).plan
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    first = spark.createDataFrame([("b", "Rp 9.000", "03/04/2025", 1), ("c", "Rp 2.000", "03/04/2025", 1), ("c", "Rp 2.500", "03/04/2025", 2)], cols)
    first.coalesce(1).write.parquet(inbox)
    stream = tw.AppendStream(spark, store, plan, ["k"], order_by=["v"]).start_from(base)
    stream.run(inbox, base.schema, f"{store}/checkpoint").awaitTermination()
    got = {r["k"]: (r["harga"], str(r["tanggal"])[:10]) for r in stream.kept().collect()}
    assert got == {"a": (1000.0, "2025-03-25"), "b": (3000.0, "2025-03-26"), "c": (2000.0, "2025-04-03")}
    assert {(r["k"], r["Alasan"]) for r in stream.skipped().collect()} == {("b", "sudah ada di file dasar"), ("c", "duplikat di file baru")}

    spark.createDataFrame([("c", "Rp 1", "01/01/2025", 1), ("d", "Rp 4.000", "04/04/2025", 1)], cols).coalesce(1).write.mode("append").parquet(inbox)
    stream.run(inbox, base.schema, f"{store}/checkpoint").awaitTermination()
    assert sorted(r["k"] for r in stream.kept().collect()) == ["a", "b", "c", "d"]
    assert stream.skipped().count() == 3


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    stream = tw.AppendStream(spark, str(tmp_path), tw.clean(base).plan, ["k"]).start_from(base)
    rows = spark.createDataFrame([("a", 2), ("b", 2), ("c", None)], "k string, v int")
    for _ in range(2):
        stream.process(rows, 0)
    stream.process(rows.limit(0), 1)
    assert sorted(r["k"] for r in stream.kept().collect()) == ["a", "b", "c"]
    assert values(stream.skipped().select("k")) == [("a",)]


def test_order_based_fills_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, v string")
    plan = tw.clean(df, CleanConfig.from_dict({"missing": {"text_strategy": "ffill"}}), order_by=["i"]).plan
    with pytest.raises(ValueError, match="row order"):
        tw.AppendStream(spark, str(tmp_path), plan)
