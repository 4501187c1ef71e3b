import pytest
from conftest import values
from pyspark.sql import functions as F

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions import text
from tablewright.functions.names import is_name_or_title_column


def apply(frame, rule, texts):
    df = frame("i int, v string", list(enumerate(texts)))
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


@pytest.mark.parametrize("raw, want", [
    ("harbour lights", "Harbour Lights"), ("HARBOUR LIGHTS", "Harbour Lights"), ("harbour QX lights", "Harbour QX Lights"),
    ("PT KAYU MANIS TBK", "PT Kayu Manis TBK"), ("grand piano [SECOND floor]", "Grand Piano [SECOND floor]"),
    ("öl und essig", "Öl Und Essig"), ("sea-green o'hara's boat", "Sea-Green O'Hara's Boat"), ("x[y]z", "X[y]Z"),
    ("(usa)", "(USA)"), ("+ one", "+ One"), ("", ""), (None, None),
])
def test_smart_title(frame, raw, want):
    assert apply(frame, text.smart_title, [raw]) == [want]


def test_smart_title_options(frame):
    assert apply(frame, lambda c: text.smart_title(c, preserve_brackets=False), ["oak [big]"]) == ["Oak [Big]"]
    assert apply(frame, lambda c: text.smart_title(c, preserve_acronyms=False), ["usa by TRAIN"]) == ["Usa By Train"]
    assert apply(frame, lambda c: text.smart_title(c, custom_acronyms=["qrs"]), ["one qrs"]) == ["One QRS"]


def test_smart_title_of_whole_documents(spark):
    """Only case changes, brackets stay as they are, and a second run changes nothing.

    The letter ß is put aside: its capital is two letters in Java.
    """
    path = "/root/testdata/sf0.001/documents.parquet"
    source = spark.read.parquet(path).select(F.concat(F.translate("text", "ß", "z"), F.lit(" [as IT stood] o'the")).alias("raw"))
    once = source.withColumn("once", text.smart_title(F.col("raw")))
    both = once.withColumn("twice", text.smart_title(F.col("once")))
    wrong = both.where(
        (F.lower("raw") != F.lower("once")) | ~F.col("once").contains("[as IT stood]") | (F.col("once") != F.col("twice"))
    )
    assert source.count() > 0 and wrong.count() == 0


def test_squeeze_and_nfkc(frame):
    assert apply(frame, text.squeeze, ["  a  b \t c　", "plain", None]) == ["a b c", "plain", None]
    assert apply(frame, text.nfkc, ["ＡＢＣ ﬁ x y", "plain", None]) == ["ABC fi x y", "plain", None]
    assert apply(frame, text.ascii_only, ["Müller", "ok"]) == ["Mller", "ok"]
    assert apply(frame, text.sentence_case, ["hELLO World", "", None]) == ["Hello world", "", None]


def test_nulls_stay_null_in_the_text_step(frame):
    cfg = CleanConfig.from_dict({"missing": {"text_strategy": "constant"}})
    out = tw.clean(frame("kota string", ["  jakarta  ", "BANDUNG", None]), cfg)
    assert values(out.data) == [("Bandung",), ("Jakarta",), ("Unknown",)]
    rule_only = tw.clean_with_plan(frame("kota string", [("  jakarta  ",), (None,)]), out.plan.__class__(
        columns=("kota",), text=out.plan.text, title=out.plan.title))
    assert sorted(map(str, (r[0] for r in rule_only.collect()))) == ["Jakarta", "None"]


def test_title_case_goes_to_name_columns_only(frame):
    table = frame("nama_toko string, kota string, catatan string", [("kayu JATI", "SOLO [barat]", "buka pagi"), ("rumah kopi", "malang", "tutup SORE")])
    assert values(tw.clean(table).data) == [("Kayu JATI", "Solo [barat]", "buka pagi"), ("Rumah Kopi", "Malang", "tutup SORE")]


def test_case_columns_can_be_named(frame):
    cfg = CleanConfig.from_dict({"text": {"kolom_case": ["kota"]}})
    out = tw.clean(frame("nama_toko string, kota string", [("rumah kopi", "malang")]), cfg).data
    assert values(out) == [("rumah kopi", "Malang")]


def test_upper_goes_to_every_text_column_but_excluded_ones(frame):
    cfg = CleanConfig.from_dict({"text": {"case_format": "upper"}})
    out = tw.clean(frame("nama string, email string, note string", [("a b", " a@b.c ", "x")]), cfg).data
    assert values(out) == [("A B", " a@b.c ", "X")]


def test_unicode_is_left_out_of_the_plan_for_ascii_columns(frame):
    plain = tw.clean(frame("nama string", ["budi"])).plan.text["nama"]
    foreign = tw.clean(frame("nama string", ["José"])).plan.text["nama"]
    assert (plain.needs_unicode, foreign.needs_unicode) == (False, True)


@pytest.mark.parametrize("name, expected", [
    ("nama_pelanggan", True), ("Tour title", True), ("c_name", True), ("kota", True), ("Description", False),
    ("nama_kode", False), ("username", False), ("status", False), ("qty", False),
])
def test_name_columns(name, expected):
    assert is_name_or_title_column(name) is expected


def test_name_columns_by_substring():
    assert is_name_or_title_column("username", "substring") is True
    assert is_name_or_title_column("bandwidth", "substring") is False  # "id" excludes first


def test_smart_title_of_runs(frame):
    """Words in a run are written as each of them alone, and the text is computed once."""
    words = ["a", "It", "usa", "usa.", "Vip,", "aim", "foo", "fOO", "foo).", "(foo", "don't", "o'neil", "x-ray", "été", "Ångström", "þing", "ÿes", "ßa",
             "×", "ŉ", "ǆ", "漢字", "и", "r&b", "akb48", "[a", "a1", "R", "seventeenth", "seventeen", "word", "other", "words"]
    alone = dict(zip(words, apply(frame, text.smart_title, words)))
    texts = [" ".join(words[(i * step) % len(words)] for i in range(100)) for step in (1, 2, 4, 5, 7)] + ["plain words  only \n" * 40]
    assert apply(frame, text.smart_title, texts[:-1]) == [" ".join(alone[w] for w in t.split(" ")) for t in texts[:-1]]
    assert apply(frame, text.smart_title, texts[-1:]) == ["Plain Words  Only \n" * 40]
    plan = frame("v string", [("x",)]).select(text.smart_title(F.translate("v", "A", "a")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
