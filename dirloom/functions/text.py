"""Cleaning of names, titles, departments, contact details and file names.

Every function maps Columns to a Column of built-in expressions, so they stay in
whole-stage code generation; the two that need Unicode normalisation, ``nfkc``
and ``name_key``'s folding, are Arrow UDFs.  Missing text is ``""``, never null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import patterns as P

ZERO_WIDTH = "​‌‍⁠﻿"


@F.pandas_udf(StringType())
def nfkc(v: pd.Series) -> pd.Series:
    return v.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def decomposed(v: pd.Series) -> pd.Series:
    """NFKD."""
    return v.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


@F.pandas_udf(StringType())
def fold_ascii(v: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form is dropped."""
    return v.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated, and planned, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_chars(c: Column, chars: str) -> Column:
    """Without these characters at either end."""
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_text(c: Column, normalise: bool = False) -> Column:
    """White space collapsed, zero-width characters dropped; ``normalise`` adds NFKC."""
    base = F.coalesce(c, F.lit(""))
    base = nfkc(base) if normalise else base
    return squeeze(F.replace(F.translate(base, ZERO_WIDTH, ""), F.lit("\u00a0"), F.lit(" ")))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital and small letters."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def recased(c: Column, longer_than: int = 0) -> Column:
    """Text that is all in capitals (and longer than this) in title case."""
    return F.when((c == F.upper(c)) & (c != F.lower(c)) & (F.length(c) > longer_than), title_case(c)).otherwise(c)


def text_lines(c: Column) -> Column:
    """Cleaned, non-empty lines; a line equal to the one before is dropped."""
    # White space is squeezed in the whole text at once, which leaves little to do for each line.
    squeezed = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ZERO_WIDTH, ""), r"(?U)[\s&&[^\r\n]]+", " ")
    lines = F.transform(F.split(squeezed, r"[\r\n]+"), lambda x: strip_chars(x, " |:-–—•*"))
    lines = F.filter(lines, lambda x: x != "")
    return let(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def normalize_designation(c: Column) -> Column:
    """Abbreviated titles written out, titles all in capitals recased."""
    v = F.regexp_replace(clean_text(c), r"(?i)^(designation|position|title)\s*[:\-]\s*", "")
    v = F.regexp_replace(v, r"(?i)\bAsst\.?\s*Prof\.?", "Assistant Professor")
    v = F.regexp_replace(v, r"(?i)\bAssoc\.?\s*Prof\.?", "Associate Professor")
    for pattern, full in P.DESIGNATION_ABBREVIATIONS:
        v = F.regexp_replace(v, "(?i)" + pattern, full)
    return strip_chars(clean_text(let(v, recased)), " ,;|-")


def looks_like_designation(c: Column) -> Column:
    return let(clean_text(c), lambda v: (v != "") & (F.length(v) <= 140) & (v.rlike(P.ACADEMIC) | v.rlike(P.NON_ACADEMIC)))


def is_non_academic(c: Column) -> Column:
    return let(clean_text(c), lambda v: v.rlike(P.NON_ACADEMIC) & ~v.rlike(P.STRONG_ACADEMIC))


def strip_honorifics(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean_text(c), P.HONORIFIC, ""))


def clean_name(c: Column) -> Column:
    """Without labels, numbering, bracketed notes and titles behind the name."""
    v = F.regexp_replace(clean_text(c), r"(?i)^(name|faculty|teacher)\s*[:\-]\s*", "")
    v = F.regexp_replace(v, r"^\(?\d{1,3}[.)]\s+", "")
    v = F.regexp_replace(v, r"\s*[\(\[][^)\]]*[\)\]]\s*", " ")

    def untitled(both: Column) -> Column:
        parts = both["parts"]
        titled = F.exists(F.slice(parts, 2, F.size(parts)), looks_like_designation)
        return strip_chars(clean_text(F.when((F.size(parts) > 1) & titled, F.get(parts, F.lit(0))).otherwise(both["v"])), " ,;:-|")

    return let(let(v, lambda v: F.struct(v.alias("v"), F.split(v, r"\s*(?:,|\s[-–—|]\s)\s*").alias("parts"))), untitled)


def looks_like_name(c: Column, strict: bool = True) -> Column:
    """Is this a person's name rather than a heading, a label or a sentence?"""

    def core_of(bare: Column) -> Column:
        for _ in range(2):
            bare = strip_chars(F.regexp_replace(bare, P.DEGREE_SUFFIX, ""), " ,.")
        return bare

    def judge(p: Column) -> Column:
        name, bare, core, words = p["name"], p["bare"], p["core"], p["words"]
        lone_ok = (F.length(core) >= 3) & (name.rlike(P.HONORIFIC) if strict else F.lit(True))
        plain = F.transform(words, lambda w: strip_chars(F.lower(w), ".'"))
        stopped = F.arrays_overlap(plain, F.array(*(F.lit(w) for w in P.NAME_STOPWORDS)))
        titled = core.rlike(P.ACADEMIC) | core.rlike(P.NON_ACADEMIC) | bare.rlike(P.ACADEMIC) | bare.rlike(P.NON_ACADEMIC)
        capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return (
            F.length(name).between(3, 70)
            & core.rlike(P.NAME_CHARS)
            & F.size(words).between(1, 7)
            & ((F.size(words) > 1) | lone_ok)
            & ~stopped
            & ~titled
            & (capital >= F.greatest(F.lit(1), F.floor((F.size(words) + 1) / 2)))
        )

    both = let(clean_name(c), lambda n: F.struct(n.alias("name"), strip_honorifics(n).alias("bare")))
    three = let(both, lambda p: F.struct(p["name"].alias("name"), p["bare"].alias("bare"), core_of(p["bare"]).alias("core")))
    parts = let(three, lambda p: F.struct(p["name"].alias("name"), p["bare"].alias("bare"), p["core"].alias("core"), F.filter(F.split(p["core"], r"[\s,]+"), lambda w: w != "").alias("words")))
    return let(parts, judge)


def name_key(c: Column, fold: bool = True) -> Column:
    """Key under which spellings of a name meet; ``fold`` drops marks on letters."""
    core = F.regexp_replace(strip_honorifics(clean_name(c)), P.DEGREE_SUFFIX, "")
    core = fold_ascii(core) if fold else core
    return F.trim(F.regexp_replace(F.lower(core), "[^a-z]+", " "))


def reveal_email(c: Column) -> Column:
    """``name [at] host [dot] org`` as an address."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), P.HIDDEN_AT, "@")
    return F.regexp_replace(v, P.HIDDEN_DOT, ".")


def extract_emails(c: Column) -> Column:
    """Distinct addresses in order, lower-cased, without names of pictures."""
    found = F.regexp_extract_all(reveal_email(c), F.lit(f"({P.EMAIL})"), F.lit(1))
    found = F.transform(found, lambda x: F.lower(strip_chars(x, ".")))
    picture = r"\.(png|jpg|jpeg|gif|webp)$"
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(picture)))


def extract_phone(c: Column) -> Column:
    """The first labelled number, else the first mobile number, else ``""``."""

    def first(v: Column) -> Column:
        labelled = strip_chars(clean_text(F.regexp_extract(v, P.PHONE_LABEL, 1)), " ,/-")
        return F.coalesce(F.nullif(labelled, F.lit("")), F.regexp_extract(v, P.MOBILE, 0))

    return let(F.coalesce(c, F.lit("")), first)


def extract_degrees(lines: Column, skip: list[Column] | None = None) -> Column:
    """Lines with degrees, distinct, joined by ``; ``, 600 characters at most."""

    def wanted(x: Column) -> Column:
        ok = (F.length(x) <= 220) & x.rlike(P.DEGREE) & ~F.contains(x, F.lit("@"))
        for s in skip or []:
            ok &= x != s
        return ok

    return F.substring(F.array_join(F.array_distinct(F.filter(lines, wanted)), "; "), 1, 600)


def extract_research_interests(c: Column) -> Column:
    return F.substring(clean_text(F.regexp_extract(F.coalesce(c, F.lit("")), P.RESEARCH, 1)), 1, 400)


def safe_filename(c: Column, most: int = 80, default: str = "unnamed", normalise: bool = False) -> Column:
    """A name that any file system takes; ``normalise`` adds NFKC."""
    c = F.coalesce(c, F.lit(""))
    v = F.regexp_replace(nfkc(c) if normalise else c, r'[<>:"/\\|?*\x00-\x1f]', " ")
    v = F.coalesce(F.nullif(F.trim(strip_chars(squeeze(v), ".")), F.lit("")), F.lit(default))
    v = let(v, lambda x: F.when(F.upper(F.substring_index(x, ".", 1)).isin(P.RESERVED_NAMES), F.concat(F.lit("_"), x)).otherwise(x))
    return let(v, lambda x: F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), r"[ .]+$", "")).otherwise(x))


def slug_to_title(c: Column) -> Column:
    """``department-of-computer-science`` as ``Computer Science``."""
    words = F.filter(F.split(strip_chars(F.coalesce(c, F.lit("")), "/ "), r"[-_\s]+"), lambda w: w != "")
    led = (F.lower(F.get(words, F.lit(0))) == "department") & (F.lower(F.get(words, F.lit(1))) == "of")
    words = F.when(led, F.slice(words, 3, F.size(words))).otherwise(words)
    small = ["and", "of", "in", "for", "the", "&"]

    def cased(w: Column, i: Column) -> Column:
        low = F.lower(w)
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        return F.when((i > 0) & low.isin(small), low).when((F.length(w) <= 3) & ~low.isin(small), F.upper(w)).otherwise(capital)

    return F.array_join(F.transform(words, cased), " ")


def normalize_department(c: Column, own: dict[str, str] | Column | None = None) -> Column:
    """A department's full name, by ``own`` names (a map) first; ``""`` for what can't be one."""
    v = F.regexp_replace(clean_text(c), r"(?i)^(?:the\s+)?(?:department|dept\.?)\s+of\s+", "")
    v = F.regexp_replace(v, r"(?i)\s*(?:faculty\s+members?|faculties\s*&\s*staff|teaching\s+staff)\s*$", "")
    v = strip_chars(v, " ,.-|:")
    maps = [m if isinstance(m, Column) else F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (own, P.COMMON_DEPARTMENTS) if m is not None and (isinstance(m, Column) or m)]

    def full(x: Column) -> Column:
        return F.coalesce(*(F.try_element_at(m, F.lower(x)) for m in maps), F.replace(recased(x, 5), F.lit(" & "), F.lit(" and ")))

    return let(v, lambda x: F.when((x == "") | (F.length(x) > 70), "").otherwise(full(x)))


def department_hint(lines: Column) -> Column:
    """The department that the first line naming one names."""
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(F.concat(x, F.lit("\n")), P.DEPARTMENT, 1)), lambda x: x != "")
    return strip_chars(clean_text(F.coalesce(F.get(found, F.lit(0)), F.lit(""))), " ,.-")


def split_designation(c: Column) -> Column:
    """(designation, department) of ``Lecturer, Department of X``."""
    pattern = r"(?i)^(.+?)[,|\-–]?\s*(?:Department|Dept\.?)\s+of\s+(.+)$"

    def split(v: Column) -> Column:
        found = F.regexp_extract(v, pattern, 2)
        title = F.when(found != "", strip_chars(F.regexp_extract(v, pattern, 1), " ,|-–")).otherwise(v)
        return F.struct(title.alias("designation"), clean_text(found).alias("department"))

    return let(c, split)


def clean_alt(c: Column) -> Column:
    """The alternative text of a portrait as a name."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.(jpe?g|png|webp|gif)$", "")
    v = F.regexp_replace(v, r"(?i)^(photo|image|picture|profile\s*(picture|photo)?|pic)\s*(of)?\s*[:\-]?\s*", "")
    v = clean_text(F.regexp_replace(v, r"_+|(?<=\w)-(?=\w)", " "))
    return F.when((v == F.lower(v)) & (v != F.upper(v)), F.initcap(v)).otherwise(v)


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def first_filled(*columns: Column) -> Column:
    """The first column that isn't empty, else ``""``."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def spaced_department(c: Column) -> Column:
    """``Computer_Science`` with spaces, unless it has some."""
    return F.when(F.contains(c, F.lit("_")) & ~F.contains(c, F.lit(" ")), F.replace(c, F.lit("_"), F.lit(" "))).otherwise(c)
