"""Problem 1: sentence boundaries across languages and scripts, in SQL expressions only.

Every replacement keeps the length, one private-use character for one character: marks that end no
sentence (in decimals, URLs, initials, abbreviations, list numbers and quotations) and spaces that
separate no sentences are masked, the text is split by terminator patterns of each script, and the
sentences are read from the original text at the places of the parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOT, QUOTED, SPACE, AFTER_HEADING, TABLE, AFTER_MARKER, BREAK, FOREIGN = (chr(0xE000 + i) for i in range(8))
_TERMS = ".!?…。！？।॥"
_THAI, _NAGARI, _CJK = "฀-๿", "ऀ-ॿ", "一-鿿぀-ヿ"

#: Abbreviations after which a sentence goes on whatever follows.
ABBREVIATIONS = (
    "e.g", "i.e", "cf", "vs", "viz", "approx", "No", "Nos", "Fig", "Figs", "Sec", "Secs", "Ch", "Vol", "Art", "Eq", "Ref", "pp", "p", "Dr", "Mr", "Mrs", "Ms", "Prof", "Assoc", "Asst", "St", "Rd", "Ave", "Gen", "Hon", "Rev",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "B.E", "A.D", "डॉ",
)
#: Words that open a Thai sentence, of prose as of minutes; its subject may follow after a space.
CONNECTIVES = (
    "อย่างไรก็ตาม", "นอกจากนี้", "ทั้งนี้", "อนึ่ง", "ต่อมา", "เบื้องต้น", "ด้วยเหตุนี้", "ดังนั้น", "ในการนี้", "ในวาระเดียวกัน", "ในที่สุด", "ในขณะเดียวกัน", "ในส่วนของงบประมาณ", "สำหรับประเด็นดังกล่าว",
    "อย่างไรก็ดี", "กระนั้น", "ถึงกระนั้น", "แม้กระนั้น", "ในทางกลับกัน", "ในทางตรงกันข้าม", "ยิ่งไปกว่านั้น", "มิฉะนั้น", "ตัวอย่างเช่น", "โดยทั่วไป", "โดยปกติ", "ประการแรก", "ประการที่สอง", "ประการสุดท้าย", "สุดท้ายนี้", "กล่าวโดยสรุป", "ในเวลาต่อมา", "หลังจากนั้น", "เพราะฉะนั้น", "ปัจจุบัน", "ปัจจุบันนี้", "วันรุ่งขึ้น", "ในอดีต", "ในอนาคต", "น่าเสียดายที่",
    "สำหรับเรื่องนี้", "ภายหลังการอภิปราย", "ภายหลังการหารือ", "ภายหลัง", "จากนั้น", "อีกทั้ง", "ในโอกาสนี้", "โดยสรุป", "กล่าวคือ",
)
#: Pronouns, and beginnings of the names of persons and bodies that act: with one of them after a space a Thai sentence begins.
ACTORS = (
    "คณะ", "กรรมการ", "อนุกรรมการ", "ที่ประชุม", "ประธาน", "รองประธาน", "เลขานุการ", "ฝ่าย", "กอง", "สำนัก", "ศูนย์", "งาน", "กลุ่มงาน", "หน่วย(?!กิต)", "สภา", "อธิการบดี", "รองอธิการบดี", "ผู้", "หัวหน้า", "คณบดี", "รองคณบดี",
    "ข้าพเจ้า", "ผม", "ดิฉัน", "ฉัน", "พวกเรา", "เรา(?!ะ)", "พวกเขา", "เขา(?!้)", "เธอ", "ท่าน", "มัน(?!ธ|ต)", "ชาวบ้าน", "ประชาชน", "รัฐบาล", "บริษัท", "โรงเรียน", "ครู(?!ช)", "แพทย์", "นักวิจัย", "ตำรวจ", "ชาวนา", "เด็ก",
    "ภาควิชา", "วิทยาลัย", "สถาบัน", "วิทยาเขต", "มหาวิทยาลัย", "ห้องสมุด", "นาย", "นาง", "อาจารย์", "นักศึกษา", "บัณฑิตวิทยาลัย", "สมาคม", "ตัวแทน", "เจ้าหน้าที่", "คู่ความร่วมมือ",
)
#: Particles that end a Thai sentence before a space.
ENDINGS = ("ครับ", "ค่ะ", "คะ", "หรือไม่", "หรือเปล่า", "ไหม", "เถอะ")
_UNSEEN = "[\u00ad\u200b-\u200d\u2060\ufeff]*"


def _units(part: str) -> list[str]:
    """The letters of a word as patterns, each in all ways to write it that look the same."""
    ways = {"ำ": "(?:ำ|ํา)", "แ": "(?:แ|เเ)"}
    return [ways.get(u) or (f"(?:{u}|{u[::-1]})" if len(u) == 2 else u) for u in re.findall("[ัิ-ู][่-๋]|.", part)]


def _any_of(words: tuple[str, ...]) -> str:
    """Any of the words with invisible characters allowed between its letters, as one pattern in which common beginnings stand once: few branches are tried at a place."""
    tree: dict = {}
    for w in words:
        head, _, tail = w.partition("(?!")
        node = tree
        for u in _units(head):
            node = node.setdefault(u, {})
        node[""] = "|".join(_UNSEEN + _UNSEEN.join(_units(t)) for t in tail[:-1].split("|")) if tail else ""

    def pattern(node: dict) -> str:
        ways = []
        for u, below in sorted(node.items(), reverse=True):
            if u == "":
                ways.append(f"(?!{below})" if below else "")
            else:
                rest = pattern(below)
                ways.append(u + (_UNSEEN + rest if rest and list(below) != [""] else rest))
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return pattern(tree)


_CONNECTIVE = _any_of(CONNECTIVES)
_OPENER = _any_of((*CONNECTIVES, *ACTORS))
_CLOSE = r"""[)\]"'”’»]"""
_NEXT = rf"""(?=[ \n]+["'“‘(\[「『]?[A-ZÀ-Þ{_THAI}{_NAGARI}{_CJK}])"""
#: What fails at most places, and fast, is asked first.
_BOUNDARIES = (
    rf"(?=[{_UNSEEN[1:-2]}{_THAI}])(?<=[ \n])(?={_UNSEEN}{_OPENER})",
    rf"(?=[{_THAI}])(?<=[{''.join(sorted({x[-1] for x in ENDINGS}))}][ \n])(?<=(?:{'|'.join(ENDINGS)})[ \n])",
    rf"{_NEXT}(?<=[^{_THAI}{_NAGARI}{_UNSEEN[1:-2]} \n]{_UNSEEN[:-1]}{{0,2}}[.…]{_CLOSE}{{0,2}})",
    rf"""(?=[ \n]+["'“‘(\[「『]?[^ \na-z{SPACE}])(?<=[?!]{_CLOSE}{{0,2}})""",
    rf"""{_NEXT}(?<={QUOTED}["”’]{{1,2}})""",
    rf"(?<=[?!])(?=[{_CJK}{_NAGARI}])",
    r"(?<=[。！？])(?![。！？”」』’）)\]])",
    r"(?<=[。！？][’）)\]])",
    rf"(?<={QUOTED}[”」』’])(?=[一-鿿ァ-ヺA-Z{_THAI}])",
    r"""(?<=[।॥])(?![।॥”’"])""",
    rf"(?=[{_NAGARI}{_CJK}A-Z])(?<=[{_THAI}] {{1,2}})(?=[{_NAGARI}{_CJK}]|[A-Z][a-z']+ [a-z]+ [a-z]+)",
    r"(?=\n *\n)",
    rf"(?=\n[^\n{AFTER_MARKER}]{{0,8}}{AFTER_MARKER})",
    r"(?<=\n)(?=#)",
    rf"(?<={AFTER_HEADING})",
    rf"(?<=[^{TABLE}])(?={TABLE})",
    rf"(?<={TABLE})(?=[^{TABLE}])",
)
#: Every boundary comes after one of these characters or before the last two kinds; most places fail this test at once.
_SPLIT = rf"""(?:(?<=[ \n.…?!)\]"'”’»」』。！？）।॥{QUOTED}{AFTER_HEADING}{TABLE}])|(?=[\n{TABLE}]))(?:{"|".join(_BOUNDARIES)})"""
#: Masks by pattern, applied in this order; each replaces one character by one.
_MASKS = (
    (r"(?m)^(?<!\b(?:p|pp|No|Sec|Fig|Ch|Art|vs|approx)\.\n)( *\(?[0-9๐-๙]{1,3})\. ", rf"$1{DOT}{AFTER_MARKER}"),
    (r"(?m)^( *(?:\(?[0-9๐-๙]{1,3}\)|\([a-zก-ฮ]\)|[-•*–—·])) ", rf"$1{AFTER_MARKER}"),
    (r"(?m)^(#[^\n]*)\n", rf"$1{AFTER_HEADING}"),
    # decimals, versions, URLs and addresses, dots inside abbreviations
    (r"\.(?=[0-9A-Za-z๐-๙])(?<=[0-9A-Za-z๐-๙]\.)", DOT),
    (r"\.(?<=\b(?:" + "|".join(x.replace(".", f"[.{DOT}]") for x in ABBREVIATIONS) + r")\.)", DOT),
    # initials
    (rf"\.(?= )(?<=(?<![A-Za-z.{DOT}])[A-Z]\.)", DOT),
    (rf"({_CONNECTIVE}{_UNSEEN})[ \n]", rf"$1{SPACE}"),
    (rf"[ \n](?<={SPACE}[ \n])(?=[^ \n])", SPACE),
)


def _quotations(text: Column) -> Column:
    """Ends of sentences, spaces and breaks inside quotations, masked."""
    inside = (f"{_TERMS} \n", QUOTED * len(_TERMS) + SPACE + BREAK)
    curly = F.split(text, r"(?=[“「『])|(?<=[”」』])")
    text = F.array_join(F.transform(curly, lambda p: F.when(p.rlike(r"\A[“「『][^\n]*(?:\n(?! *\n)[^\n]*)*[”」』]\z"), F.translate(p, *inside)).otherwise(p)), "")

    def straight(block: Column) -> Column:
        parts = F.split(block, '"')
        masked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, *inside)).otherwise(p))
        return F.when((F.size(parts) > 1) & (F.size(parts) % 2 == 1), F.array_join(masked, '"')).otherwise(block)

    return F.when(F.contains(text, F.lit('"')), F.array_join(F.transform(F.split(text, "\n\n"), straight), "\n\n")).otherwise(text)


def parts(text: Column) -> Column:
    """The masked text, split; the parts together are as long as the text."""
    own = "".join((DOT, QUOTED, SPACE, AFTER_HEADING, TABLE, AFTER_MARKER, BREAK))
    m = F.translate(text, own, FOREIGN * len(own))
    tables = F.split(m, r"(?=<table)|(?<=</table>)")
    m = F.when(F.contains(m, F.lit("<table")), F.array_join(F.transform(tables, lambda p: F.when(p.startswith("<table"), F.repeat(F.lit(TABLE), F.length(p))).otherwise(p)), "")).otherwise(m)
    for pattern, to in _MASKS[:3]:
        m = F.regexp_replace(m, pattern, to)
    m = F.when(m.rlike('["“「『]'), _quotations(m)).otherwise(m)
    for pattern, to in _MASKS[3:]:
        m = F.regexp_replace(m, pattern, to)
    return F.split(m, _SPLIT, -1)


def sentence_ends(text: Column) -> Column:
    """array<struct<start_pos,end_pos>> of the sentences of a text, in code points from 0, end exclusive and without white space.

    Lines that start with # and <table> islands hold none. Null and empty texts give an empty array.
    """
    trim = f" \n{AFTER_HEADING}{BREAK}{SPACE}"

    def measured(p: Column) -> Column:
        # start and end of what the part holds, relative to the part; nothing for headings and tables
        left = F.length(F.ltrim(p, F.lit(trim)))
        held = F.ltrim(p, F.lit(trim))
        none = (left == 0) | held.startswith("#") | held.startswith(TABLE)
        return F.struct(F.length(p).alias("n"), F.when(~none, F.length(p) - left).alias("s"), F.length(F.rtrim(p, F.lit(trim))).alias("e"))

    def add(acc: Column, p: Column) -> Column:
        place = F.struct((acc["at"] + p["s"]).alias("start_pos"), (acc["at"] + p["e"]).alias("end_pos"))
        return F.struct((acc["at"] + p["n"]).alias("at"), F.when(p["s"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], place)).alias("out"))

    none = F.array().cast("array<struct<start_pos:int,end_pos:int>>")
    got = F.aggregate(F.transform(parts(text), measured), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.coalesce(got, none)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: key, sentence_no from 0, start_pos, end_pos, sentence (as in the text). No shuffle."""
    placed = df.select(key, text, F.posexplode(sentence_ends(F.col(text))).alias("sentence_no", "p"))
    return placed.select(key, "sentence_no", "p.start_pos", "p.end_pos", F.substring(text, F.col("p.start_pos") + 1, F.col("p.end_pos") - F.col("p.start_pos")).alias("sentence"))


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and end_pos of the sentences."""
    return df.select(key, F.explode(sentence_ends(F.col(text))).alias("p")).select(key, F.col("p.end_pos").alias("end_pos")).distinct()
