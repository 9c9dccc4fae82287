"""Scalar text functions, as Column expressions. Null in gives null out unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
UNSEEN = "[\\u200B\\u200C\\u200D\\u2060\\uFEFF\\u00AD]"


def strip_document_header(text: Column) -> Column:
    """Without the first line that starts with "# Document:", then without leading line breaks."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*#[ \t]*Document:.*$", 0)
    at = F.position(found, text)
    cut = F.when(found == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text))))
    return F.regexp_replace(cut, r"\A\n+", "")


def normalize_thai(text: Column) -> Column:
    """Arabic digits, no zero-width characters, single spaces, at most one blank line."""
    t = F.translate(text, THAI_DIGITS, DIGITS)
    t = F.regexp_replace(t, UNSEEN, "")
    t = F.regexp_replace(t, " {2,}", " ")
    return F.regexp_replace(t, "\\n{3,}", "\n\n")


def collapse_ws(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def contains_phrase(hay: Column, needle: Column) -> Column:
    """Whether the phrase occurs, whatever its case and white space, with no Latin letter or digit beside it; an empty phrase doesn't."""
    n = collapse_ws(needle)
    pattern = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.coalesce((n != "") & F.rlike(collapse_ws(hay), pattern), F.lit(False))


def link_key(url: Column) -> Column:
    """A link's identity: the number it ends in, else the trimmed link."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/(?:d/|item/|[0-9]{4}/)([A-Za-z0-9_-]+)$", 1), F.lit("")), F.trim(url))


#: Fixed value: numbering and marks before a subject.
AGENDA = r"\A(?:[ \t\n\r0-9๐-๙]+(?:[.．][ \t\n\r0-9๐-๙]*)*[ \t\n\r.)]*|(?:เรื่อง|วาระที่|ระเบียบวาระที่)[ \t\n\r]*)+"


def strip_agenda(title: Column) -> Column:
    """Without the numbering and the marks at the start, in any order, repeatedly."""
    return F.regexp_replace(title, AGENDA, "")


#: Fixed value: the heading of a resolution's first page, up to its subject.
HEADING = r"มติคณะกรรมการสภาวิชาการ.{0,80}?เรื่อง\s(.{10,300})"
#: Words that say nothing of a subject.
EMPTY_WORDS = ("การ", "ความ", "ของ", "และ", "หรือ", "ที่", "ใน", "เพื่อ", "กับ", "ให้", "จาก", "โดย", "ตาม", "เป็น", "มี", "ได้", "ต่อ", "ด้วย", "แก่", "แห่ง", "ซึ่ง", "นี้", "เรื่อง", "ขอ", "ทาง", "อัน", "ณ", "พ.ศ.", "ปี")


def subject_line(text: Column, most: int = 300, within: int = 4000) -> Column:
    """The subject in the heading of the first page (within the first characters), else the first line that is not blank, a # line or a table."""
    head = F.substring(text, 1, within)
    named = F.nullif(F.regexp_extract(collapse_ws(head), HEADING, 1), F.lit(""))
    first = F.trim(F.regexp_extract(head, r"(?m)^[ ]*([^ #<\n][^\n]*)$", 1))
    return F.substring(F.coalesce(strip_agenda(named), first), 1, most)


def row_signature(row: Column) -> Column:
    """Digits as 0 and white space as one space."""
    return collapse_ws(F.regexp_replace(F.translate(row, THAI_DIGITS, DIGITS), "[0-9]", "0"))


def is_bad_output(text: Column, prompt: str | None = None) -> Column:
    """Recognised text that can't be one: under 5 characters, more than half of it one character, or the prompt itself; null counts as bad."""
    t = F.trim(text)
    most = F.array_max(F.transform(F.array_distinct(F.split(t, "")), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit("")))))
    echo = F.contains(t, F.lit(prompt)) if prompt else F.lit(False)
    return F.coalesce((F.length(t) < 5) | (2 * most > F.length(t)) | echo, F.lit(True))


def verify_span(span: Column, body: Column) -> Column:
    """Whether a quoted span stands in the body, white space aside; an empty span doesn't."""
    s = collapse_ws(span)
    return F.coalesce((s != "") & F.contains(collapse_ws(body), s), F.lit(False))


def highlight(body: Column, spans: Column) -> Column:
    """The body with every span in [[ ]], longest first."""
    longest = F.array_sort(F.transform(spans, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.aggregate(longest, body, lambda acc, x: F.replace(acc, x["s"], F.concat(F.lit("[["), x["s"], F.lit("]]"))))


def event_key(ident: Column) -> Column:
    """What stands before the first " — "."""
    return F.substring_index(ident, " — ", 1)


def meeting_key(ident: Column) -> Column:
    """(year, session) as numbers, 9999 where there is none."""
    number = lambda i: F.coalesce(F.expr("try_cast(null as int)") if i < 0 else F.regexp_extract(ident, r"\A([0-9]{4})/([0-9]+)", i).try_cast("int"), F.lit(9999))
    return F.struct(number(1).alias("year"), number(2).alias("session"))


def novel_numbers(text: Column, query: Column) -> Column:
    """How many runs of digits of the text are not among those of the query, repeats counted."""
    own, known = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(query, F.lit("[0-9]+"), F.lit(0))
    return F.size(F.filter(own, lambda x: ~F.array_contains(known, x)))


def one_char_off(a: Column, b: Column) -> Column:
    """Whether two strings of one length differ in at most one character."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (differ <= 1)


def prefix_related(a: Column, b: Column, share: float = 0.7, least: int = 4) -> Column:
    """Whether the shorter string begins the longer and is at least that share of it."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= least) & F.startswith(long, short) & (F.length(short) >= share * F.length(long))


def coverage(title: Column, subject: Column) -> Column:
    """The share of the title's telling words that stand in the subject, white space aside; 1 without such words.

    Numbering, single characters, numbers, signs and EMPTY_WORDS tell nothing.
    """
    telling = lambda w: (F.length(w) >= 2) & ~w.isin(*EMPTY_WORDS) & ~w.rlike("^[0-9๐-๙]+$") & w.rlike("[0-9A-Za-zก-๛À-￿]")
    words = F.filter(F.split(collapse_ws(strip_agenda(title)), " "), telling)
    hay = F.replace(F.coalesce(subject, F.lit("")), F.lit(" "), F.lit(""))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.contains(hay, w))) / F.size(words))


def context_class(text: Column, at: Column, reach: int = 300) -> Column:
    """table or prose, by what stands around a place (from 0)."""
    near = F.substring(text, F.greatest(at - reach, F.lit(0)) + 1, F.lit(2 * reach))
    return F.when(near.rlike("(?i)<t[dr]|<table") | (F.length(near) - F.length(F.replace(near, F.lit("|"), F.lit(""))) >= 3), "table").otherwise("prose")


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff–Obershelp similarity; null if either is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def longest_block(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest piece that stands in both, the first one in the first string; null if either is null."""
    from difflib import SequenceMatcher

    def one(x: str, y: str) -> str:
        m = SequenceMatcher(None, x, y, False).find_longest_match(0, len(x), 0, len(y))
        return x[m.a : m.a + m.size]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="object")


@F.pandas_udf(T.StringType())
def nfc(a: pd.Series) -> pd.Series:
    """Canonical composition, no-break space as space."""
    import unicodedata

    return a.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).replace("\xa0", " "))
