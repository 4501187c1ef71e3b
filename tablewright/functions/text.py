"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as fv
from tablewright.functions.binding import let
from tablewright.functions.numbers import trim_all

BRACKETED = r"\[[^\]]*\]"
_BRACKET_TOKEN = r"\[[^\]]*\]|"
_TOKENS = r"[\s\x1c-\x1f]+|{run}|(?:(?!\[[^\]]*\])[^\s\x1c-\x1f])+"
_PLAIN_TOKENS = r"[\s\x1c-\x1f]+|{run}|[^\s\x1c-\x1f]+"
# letters that every rule of case treats alike, and that have one capital each
_SMALL, _CAPITAL = "a-zà-öø-þ", "A-ZÀ-ÖØ-Þ"
# a word of these, not all in capitals, with nothing before it and marks only after it
_EVERYDAY = rf"(?=[{_CAPITAL}]*[{_SMALL}]|[{_CAPITAL}](?![{_CAPITAL}{_SMALL}]))[{_CAPITAL}{_SMALL}]++[.,;:!?)]*+(?:(?= )|(?![^\s\x1c-\x1f]))"
RUN_WORDS = 32  # of a run at most: a match goes as deep
# marks before, the word itself, marks after
_WORD = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
NON_ASCII = r"[^\x00-\x7F]"
# white space that is not already one plain blank between two words
_UNEVEN = r"(?U) [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*"


def nfkc(c: Column) -> Column:
    """Unicode NFKC.

    Spark has no built-in for it, so this is the one Arrow UDF of the library.
    NFKC leaves ASCII alone, so ASCII values are sent as nulls and merged back
    on the JVM side: only values that can change travel with their content.
    """
    import pandas as pd

    def normalise(values: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return values.map(lambda v: normalize("NFKC", v), na_action="ignore")

    normalise.__annotations__ = {"values": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(normalise, "string")
    return F.coalesce(udf(F.when(c.rlike(NON_ASCII), c)), c)


def squeeze(c: Column) -> Column:
    """Trim, and turn every run of white space (NBSP included) into one blank."""
    return F.regexp_replace(trim_all(c), _UNEVEN, " ")


def ascii_only(c: Column) -> Column:
    """Drop characters outside ASCII."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def sentence_case(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def _run(acronyms: Iterable[str]) -> str:
    """Pattern of two or more everyday words, no acronyms, with one blank between them: a token whose words all take one capital."""
    tails: dict[str, list[str]] = {}
    for a in sorted(a for a in set(acronyms) if a.isascii() and a.isalpha()):
        tails.setdefault(a[0], []).append("".join(f"[{x}{x.lower()}]" for x in a[1:]))
    known = "|".join(f"[{x}{x.lower()}](?:{'|'.join(rest)})" for x, rest in tails.items())
    word = (rf"(?!(?:{known})(?![{_CAPITAL}{_SMALL}]))" if known else "") + _EVERYDAY
    return rf"{word}(?: {word}){{1,{RUN_WORDS - 1}}}"


def smart_title(
    c: Column,
    preserve_brackets: bool = True,
    preserve_acronyms: bool = True,
    custom_acronyms: Iterable[str] = (),
) -> Column:
    """Title case that leaves ``[...]`` and acronyms alone (F16).

    * text in square brackets stays as it is;
    * a known acronym is written in capitals wherever it stands;
    * an all-capitals word of two or more letters is kept when the rest of the
      text is not all capitals;
    * after an apostrophe only real name parts are capitalised (don't, O'Neil);
    * hyphenated parts are capitalised one by one.

    A word's core is made of letters and digits of any script, so "über"
    becomes "Über" (it is not cut after the umlaut).  Runs of everyday words are one token, which
    ``initcap`` writes as the rules for single words do.
    """
    known = " ".join(dict.fromkeys((*fv.ACRONYMS, *(a.upper() for a in custom_acronyms))))
    acronyms = F.split(F.lit(known), " ")
    run = _run(known.split(" ") if preserve_acronyms else ())
    pattern = _BRACKET_TOKEN + _TOKENS if preserve_brackets else _PLAIN_TOKENS

    def tokens(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit("(?U)" + pattern.replace("{run}", run)), F.lit(0))

    def shouting(x: Column) -> Column:
        outside = F.regexp_replace(x, BRACKETED, "") if preserve_brackets else x
        return ~outside.rlike(r"[\p{L}&&[^\p{Lu}]]") & outside.rlike(r"\p{Lu}")

    def titled(core: Column) -> Column:
        small = F.split(F.lit(" ".join(fv.SMALL_APOSTROPHE_PARTS)), " ")
        by_apostrophe = F.array_join(
            F.transform(
                F.split(core, "'"),
                lambda p, i: F.when((i > 0) & F.array_contains(small, F.lower(p)), F.lower(p)).otherwise(sentence_case(p)),
            ),
            "'",
        )
        by_hyphen = F.array_join(F.transform(F.split(core, "-"), sentence_case), "-")
        return (
            F.when(F.contains(core, F.lit("'")), by_apostrophe)
            .when(F.contains(core, F.lit("-")), by_hyphen)
            .otherwise(sentence_case(core))
        )

    def cased(core: Column, all_caps: Column) -> Column:
        plain = titled(core)
        if not preserve_acronyms:
            return plain
        upper = F.upper(core)
        capitals = (F.length(core) >= 2) & (core == upper) & (core != F.lower(core))
        return (
            F.when(F.array_contains(acronyms, upper), upper).when(~all_caps & capitals, core).otherwise(plain)
        )

    def word(t: Column, all_caps: Column) -> Column:
        def marked(x: Column) -> Column:
            return F.when(x == "", t).otherwise(F.concat(F.regexp_extract(t, _WORD, 1), cased(x, all_caps), F.regexp_extract(t, _WORD, 3)))

        return F.when(t.rlike(r"^[\p{L}\p{N}]+$"), cased(t, all_caps)).otherwise(let(F.regexp_extract(t, _WORD, 2), marked))

    def one(t: Column, all_caps: Column) -> Column:
        keep = t.rlike(r"(?U)^[\s\x1c-\x1f]")
        if preserve_brackets:
            keep = keep | (F.startswith(t, F.lit("[")) & t.rlike("^" + BRACKETED + "$"))
        everyday = F.contains(t, F.lit(" ")) & t.rlike(f"^[{_CAPITAL}{_SMALL}]")
        return F.when(t == " ", t).when(everyday, F.initcap(t)).when(keep, t).otherwise(word(t, all_caps))

    def whole(x: Column) -> Column:
        return let(
            F.struct(tokens(x).alias("tokens"), shouting(x).alias("caps")),
            lambda v: F.array_join(F.transform(v["tokens"], lambda t: one(t, v["caps"])), ""),
        )

    return let(c, whole)


def apply_case(c: Column, case_format: str | None, **title_options) -> Column:
    """title / upper / lower / sentence, anything else leaves the text alone."""
    if case_format == "title":
        return smart_title(c, **title_options)
    if case_format == "upper":
        return F.upper(c)
    if case_format == "lower":
        return F.lower(c)
    if case_format == "sentence":
        return sentence_case(c)
    return c
