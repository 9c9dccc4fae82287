"""Problem 10: passages with personal information, replaced by placeholders.

A semi-Markov conditional random field over spans: patterns propose candidate spans with several
boundaries and kinds, features of the whole span and of what stands to its left and right score them, and
dynamic programming over the positions joins non-overlapping spans to the best whole, in which neighbours that are close
score together. The weights are
trained on invented sentences (TRAINING of them, made below from fixed templates), by the likelihood.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import LOOKALIKES, _plain_table

KINDS = ("name", "email", "phone", "id_number", "address")
#: Invented sentences that the weights are fitted to, and passes over them.
TRAINING, PASSES = 1100, 6

#: Titles and ranks, which are no part of a name; courtesy words after which a given name may stand alone.
COURTESY = ("คุณ", "นางสาว", "น.ส.", "นาย", "นาง", "Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Khun")
RANKS = (
    "ผู้ช่วยศาสตราจารย์", "รองศาสตราจารย์", "ศาสตราจารย์", "ว่าที่ร้อยตรี", "ว่าที่ร้อยโท", "อาจารย์", "ผศ.", "รศ.", "ศ.", "ดร.", "อ.", "พล.ต.", "Asst. Prof.", "Assoc. Prof.", "Asst.", "Assoc.", "Professor", "Prof.", "Prof", "Dr.", "Dr",
)
#: Words before a name, and before numbers and addresses by kind.
BEFORE_NAME = (
    "ผู้ประสานงานคือ", "ผู้ประสานงาน", "ผู้ยื่นคำร้อง", "ติดต่อ", "ส่งเอกสารถึง", "เอกสารของ", "ลงชื่อ", "เรียน", "ชื่อ", "สอบถาม", "มี", "และ", "Please write to", "write to", "Send the forms to", "The file of", "file of", "consists of", "or ask", "ask", "and",
    "Contact", "Attn:", "Dear", "signed by", "on behalf of", "联系人为", "联系人", "申请人", "评审人为", "連絡先は", "申請者", "担当は", "と", "、",
)
STRONG = {c for c in BEFORE_NAME if c not in ("มี", "และ", "and", "ask", "と", "、", "Contact", "สอบถาม", "เรียน", "ชื่อ")}
AFTER_NAME = (
    "ที่หมายเลข", "ยังไม่ครบ", "เป็นกรรมการ", "แจ้งว่า", "ขอลา", "เลขที่", "เลขบัตร", "เลขประจำตัว", "หนังสือเดินทาง", "บัตรประชาชน", "รหัสนักศึกษา", "รหัสประจำตัว", "โทร", "อีเมล", "และ", "resides at", "asked for leave", "shows", "at", "and", "の", "である", "と", "、", "，", "。",
)
LABELS = {
    "phone": ("โทรศัพท์มือถือ", "โทรศัพท์", "โทรสาร", "โทร.", "โทร", "มือถือ", "ที่หมายเลข", "tel.", "tel", "fax", "phone", "call", "reached on", "电话", "電話", "फ़ोन", "फोन"),
    "id_number": ("เลขประจำตัวประชาชน", "เลขบัตรประชาชน", "บัตรประชาชนเลขที่", "เลขบัตร ปชช.", "บัตร ปชช.", "หนังสือเดินทางเลขที่", "หนังสือเดินทาง", "รหัสประจำตัวนักศึกษา", "รหัสนักศึกษา", "เลขประจำตัวนักศึกษา", "national ID", "citizen no.", "ID card", "passport no.", "passport", "student ID", "student no."),
    "other": ("ISBN", "doi", "DOI", "ใบสั่งซื้อเลขที่", "ครุภัณฑ์หมายเลข", "Order no.", "Order", "order", "Asset", "asset", "Asset tag", "asset tag", "पाठ्यक्रम", "รายวิชา", "Course", "course", "科目", "课程", "注文番号", "订单号", "ระบบรุ่น", "รุ่น", "version", "版", "บันทึกที่", "ที่ ธว", "memo No.", "No.", "ห้อง", "Room", "room", "ปีการศึกษา", "บัญชี"),
}
_STREETS = "Road|Rd\\.?|Close|Lane|Street|St\\.?|Avenue|Ave\\.?|Drive|Way|Court|Place|Terrace|Crescent|Row|Quay|Boulevard|Blvd\\.?"


def _any(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))


_L = r"(?:[A-ZÀ-ÞĀ-Ž][a-zß-ÿā-ž]+|[A-ZÀ-Þ]{2,}|[OD]'[A-Z][A-Za-zß-ÿ]+)(?:-[A-ZÀ-Þ][A-Za-zß-ÿ]+)*"
_I = r"[A-Z]\."
_PART = r"(?:(?:Van|VAN|De|DE|Von|VON|Del|La|Le) )"
_LATIN = (
    rf"{_L} (?:{_I} )?{_PART}?{_L}", rf"{_I} (?:{_I} )?{_PART}?{_L}", rf"{_PART}?{_L}, (?:{_L}|{_I})(?: {_I})?", _L,
)
_T = "[ก-๎]{2,30}"
_THAI = (rf"{_T} +{_T}", _T)
_HAN = (r"[一-鿿々]{1,4} [一-鿿々]{1,4}", r"[一-鿿々]{2,8}?(?=[、，。（(である]|と[一-鿿A-Z])", r"[一-鿿]{2,4}?(?=联系|先生|女士|老师|同学|表示)", r"[一-鿿]{2,4}")
_TITLE = f"(?:(?:{_any((*COURTESY, *RANKS))})[ \n]*)"
_CUE = re.compile(rf"(?:(?<![ก-๎A-Za-z])(?:(?:{_any(x for x in BEFORE_NAME if x.isascii() or 'ก' <= x[0] <= '๎')})[ :\n]+{_TITLE}*|{_TITLE}+)|(?:联系人为?|申请人|评审人为|連絡先は|申請者|担当は){_TITLE}*|(?<=[一-鿿A-Za-z])[と、]{_TITLE}*(?=[一-鿿A-Z]))")
_LISTING = ("担当は", "連絡先は", "评审人为", "联系人")
_TITLES = re.compile(f"{_TITLE}+\\Z")
_COURTESY = re.compile(f"(?:{_any(COURTESY)})[ \n]*\\Z")
_RIGHT = re.compile(r" (?:แจ้งว่า|ขอลา|ยังไม่ครบ|เป็นกรรมการ|resides at|asked for leave)| ?[(（](?:รหัส|เลข|บัตร|หนังสือเดินทาง|student|citizen|national|ID card|passport)")
_FULL = [re.compile(f"(?:{p})\\Z") for p in (*_LATIN[:3], _THAI[0])]
_STARTS = [re.compile(p) for p in (*_LATIN, *_THAI, *_HAN)]
_PAREN = re.compile(rf"\((?P<n>{_TITLE}*(?:{'|'.join(_LATIN[:3])}|{_THAI[0]})|{_TITLE}+(?:{_T}|{_L}))\)")
_USER = r"[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"{_USER}(?: ?@ ?| ?[\[(]at[\])] ?)[A-Za-z0-9\-]+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9\-]+)+")
_SPELLED = re.compile(rf"{_USER}(?: dot [A-Za-z0-9._+\-]+)* at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9.])(?:\(\+\d{1,3}\)|\+\d{1,3}|\d)(?:[ \-–.]?\d+)*")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2} ?\d{6,8}(?!\d)")
_STREET = re.compile(rf"(?<![A-Za-z0-9/])(?:Unit \d+[A-Z]?, )?\d+(?:/\d+)?,? (?:[A-Z][A-Za-z']+ ){{1,3}}(?:{_STREETS})(?:, ?[A-Z][a-z]+(?: [A-Z][a-z]+)?)?(?: \d{{5}}(?!\d))?")
_THAI_ADDRESS = re.compile(r"(?<![\d/])\d+(?:/\d+)?(?: +(?:หมู่ที่|หมู่|ม\.) ?\d+)?(?: +(?:ซอย|ซ\.) ?[ก-๎]+(?: \d+)?)?(?: +(?:ถนน|ถ\.) ?[ก-๎]+(?: \d+)?)?(?: +(?:ตำบล|ต\.|แขวง) ?[ก-๎]+)?(?: +(?:อำเภอ|อ\.|เขต) ?[ก-๎]+)?(?: +(?:จังหวัด|จ\.) ?[ก-๎]+|(?: +กรุงเทพมหานคร))?(?: +\d{5}(?!\d))?")
_LABEL = {k: re.compile(f"(?:{_any(v)})[ :：(（]*\\Z", re.I) for k, v in LABELS.items()}
_BEFORE = re.compile(rf"(?P<c>{_any(BEFORE_NAME)})[ :\n]*\Z")
_AFTER = re.compile(rf"[ \n]*(?P<c>{_any(AFTER_NAME)}|[.,(（)）:;”\"])")
#: Words that are no part of a name although they look like one.
_NO_NAME = re.compile(rf"(?:{_any(('The', 'Please', 'Contact', 'Reply', 'Her', 'His', 'Send', 'For', 'Course', 'Order', 'Room', 'Unit', 'Subject', 'However', 'Meanwhile', 'After', 'On', 'In', 'At', 'By', 'An', 'Follow', 'See', 'Asset', 'Faculty', 'College', 'Institute', 'Office', 'Campus', 'University', 'Committee', 'Council', 'Department', 'Building', 'Hall', 'Centre', 'Center', 'Library', 'Central', 'Registry', 'Street', 'Road', 'Lane', 'Close', 'Old', 'Pier'))})\b|(?:คณะ|ฝ่าย|กอง|สำนัก|ศูนย์|หน่วย|กลุ่มงาน|สภา|ที่ประชุม|กรรมการ|ประธาน|ผู้|หัวหน้า|รองอธิการ|งาน|ระบบ|ราย|แผน|หลักสูตร|วิชา|การ|ความ|ทุน|โครง|อาคาร|เอกสาร|ข้อ|เกณฑ์|มาตรฐาน|ผล|ร่าง|ค่า|บันทึก|สัญญา|เรือ(?!ง)|เครื่อง|พื้นที่|หอพัก|กิจกรรม|ภาระ|ตาราง|แบบ|ชุด|คู่มือ|ระเบียบการ|ประกาศ|สิทธิ|เส้นทาง|ให้|ได้|และ|ที่|ใน|จาก|ตาม|โดย|เพื่อ|เมื่อ|ด้วย|สำหรับ|พร้อม|ซึ่ง|ร่วม|จำนวน|เวลา|เลข|รหัส|บัตร|หนังสือ|โทร|อีเมล|ทั้งนี้|อนึ่ง|ต่อมา|เบื้องต้น|อย่างไร|นอกจาก|ภายใน|ยัง|เป็น|แจ้ง|ขอ)")
_ODD = re.compile(r"[^\n -~ก-๎฿๏๚๛一-鿿぀-ヿऀ-ॿ、。「」！，？：（）“”–—]")


@lru_cache(1)
def _clean_table() -> dict[int, str | None]:
    table = dict(_plain_table())
    for group in LOOKALIKES:
        for c in group[1:]:
            table[ord(c)] = group[0]
    table |= {0x0E50 + i: str(i) for i in range(10)}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i) in "@+-.[]"}
    return table


def cleaned(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes, other digits and invisible characters made plain, and the place of each character (None: unchanged)."""
    if not _ODD.search(text):
        return text, None
    table, out, at = _clean_table(), [], []
    for i, c in enumerate(text):
        to = table.get(ord(c), c)
        if to:
            out.append(to)
            at += [i] * len(to)
    at.append(len(text))
    return "".join(out), at


def _shape(kind: str, s: str) -> str:
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        return f"{'+' if '+' in s else s[0]}{digits}"
    if kind == "id_number":
        return f"{'A' if s[0].isalpha() else s[0] if digits == 8 else 'n'}{digits}"
    if kind == "email":
        return "@" if "@" in s else "at"
    if kind == "address":
        return f"{'th' if re.search('[ก-๎]', s) else 'en'}{min(4, len(re.findall('ถนน|ถ[.]|ตำบล|ต[.]|อำเภอ|อ[.]|จังหวัด|จ[.]|,', s)))}{'p' if re.search('[0-9]{5}$', s) else ''}"
    w = s.replace(",", " ").split()
    script = "th" if "ก" <= s[0] <= "๎" else "han" if s[0] > "⺀" else "la"
    return f"{script}{min(len(w), 4)}{',' if ',' in s else ''}{'.' if '.' in s else ''}{'!' if any(_NO_NAME.match(x) for x in w) else ''}{'+' if script == 'th' and any(len(x) > 15 for x in w) else ''}{len(s) if script == 'han' else ''}"


def features(t: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a span as a whole: its shape, what labels it on the left, what follows it."""
    left, right = t[max(0, start - 30) : start], t[end : end + 24]
    out = [kind, f"{kind}|{_shape(kind, t[start:end])}"]
    if kind == "name":
        title = _TITLES.search(left)
        bare = left[: title.start()] if title else left
        courtesy = bool(_COURTESY.search(left))
        b, a = _BEFORE.search(bare), _AFTER.match(right)
        cue = ("strong" if b["c"] in STRONG else b["c"]) if b else "none"
        # what stands beside a name decides with its number of words
        words = len(t[start:end].replace(",", " ").split())
        out += [f"name|title{bool(title)}|{min(words, 2)}", f"name|courtesy{courtesy}|{min(words, 2)}", f"name|b:{cue}", f"name|a:{a['c'] if a else 'none'}|{min(words, 2)}", f"name|open{right[:1] == ' ' and bool(_NO_NAME.match(right[1:]))}|{min(words, 2)}"]
    else:
        found = next((k for k, p in _LABEL.items() if p.search(left)), "none")
        out += [f"{kind}|label:{found}", f"{kind}|label:{found}|{_shape(kind, t[start:end])[0]}"]
        if kind == "address":
            # a longer span of the same kind that goes on with a place or a postcode is the better one
            out.append(f"address|goes on{bool(re.match(r',? ?(?:[0-9]{5}|[A-Z][a-z]+|จ[.]|จังหวัด|อ[.]|อำเภอ)', right))}")
    return out


def _listed(t: str, at: int) -> bool:
    """Whether a cue that begins a list of names stands before at in the same sentence, with a name's room between."""
    start = max(t.rfind("。", 0, at), t.rfind("\n", 0, at)) + 1
    return any(t.find(c, start, at - 2) >= 0 for c in _LISTING)


def candidates(t: str) -> list[tuple[int, int, str]]:
    """Proposed spans (start, end, kind) of a cleaned text; they may overlap."""
    out: set[tuple[int, int, str]] = set()
    if "@" in t or "at)" in t or "at]" in t:
        out.update((m.start(), m.end(), "email") for m in _EMAIL.finditer(t))
    if " dot " in t:
        out.update((m.start(), m.end(), "email") for m in _SPELLED.finditer(t))
    for m in _NUMBER.finditer(t):
        s, e = m.span()
        if e - s < 8:
            continue
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 13 and t[e : e + 1] not in ("/",):
            if m[0][0] in "+(0" and digits <= 12:
                out.add((s, e, "phone"))
            if digits == 13:
                out.add((s, e, "id_number"))
        elif digits == 8 and m[0].isdigit():
            out.add((s, e, "id_number"))
        elif digits > 13 and m[0][0] in "+(0":  # an extension or another number may follow a phone
            for p in re.finditer(r" ", m[0]):
                if 9 <= sum(c.isdigit() for c in m[0][: p.start()]) <= 12:
                    out.add((s, s + p.start(), "phone"))
    for m in _PASSPORT.finditer(t):
        out.add((m.start(), m.end(), "id_number"))
    for m in _STREET.finditer(t):
        s, e = m.span()
        out.add((s, e, "address"))
        for cut in re.finditer(r" (?=[A-Z][a-z]+$)|(?: \d{5})$", m[0]):
            out.add((s, s + cut.start(), "address"))
    if "ต" in t or "ถ" in t or "อ" in t:
        for m in _THAI_ADDRESS.finditer(t):
            if sum(x in m[0] for x in ("หมู่", "ซอย", "ซ.", "ถ.", "ถนน", "ต.", "ตำบล", "แขวง", "อำเภอ", "อ.", "จ.", "จังหวัด")) >= 2:
                out.add((m.start(), m.end(), "address"))
    seen: set[int] = set()
    for m in _CUE.finditer(t):
        todo = [m.end()]
        if m.end() in seen or m[0][0] in "と、" and not _listed(t, m.start()):
            continue
        seen.add(m.end())
        titled = bool(_TITLES.search(m[0]))
        strong = titled or any(m[0].startswith(c) for c in STRONG)
        for p in _STARTS:
            got = p.match(t, todo[0])
            if got and got.end() > got.start():
                ends = {got.end()}
                for e in ends:
                    if strong or _AFTER.match(t, e):
                        out.add((got.start(), e, "name"))
    for m in _RIGHT.finditer(t):
        left = t[max(0, m.start() - 45) : m.start()]
        for p in _FULL:
            got = p.search(left)
            if got:
                text = got[0]
                title = re.match(f"{_TITLE}+", text)
                start = m.start() - len(text) + (title.end() if title else 0)
                if start < m.start():
                    out.add((start, m.start(), "name"))
    for m in _PAREN.finditer(t):
        title = re.match(f"{_TITLE}+", m["n"])
        s = m.start("n") + (title.end() if title else 0)
        if s < m.end("n"):
            out.add((s, m.end("n"), "name"))
    return sorted(out, key=lambda c: (c[1], c[0]))


#: Characters between two segments up to which the one before tells something of the one after.
LINKED = 60


def pair_feature(before: tuple[int, int, str], after: tuple[int, int, str]) -> str | None:
    """The feature of two segments in a row, if they are close."""
    return f"pair|{before[2]}>{after[2]}" if 0 <= after[0] - before[1] <= LINKED else None


def best(spans: list[tuple[int, int, str]], scores: list[float], weights: dict[str, float] | None = None) -> list[int]:
    """Viterbi over segments: the non-overlapping spans with the greatest sum of their scores and of those of close neighbours; anything else scores 0. spans by end.

    The value of a span is that of the best segmentation that ends with it; only spans that end close before a span are looked at
    one by one, of the others the best value is known.
    """
    get = (weights or {}).get
    ends = [s[1] for s in spans]
    value: list[float] = []
    before: list[int] = []
    top: list[tuple[float, int]] = [(0.0, -1)]  # the best value of the first n spans
    for i, (start, _, _) in enumerate(spans):
        last = bisect_right(ends, start, 0, i)
        far = bisect_left(ends, start - LINKED, 0, last)
        v, j = top[far]
        for k in range(far, last):
            if value[k] + (w := get(pair_feature(spans[k], spans[i]) or "", 0.0)) > v:
                v, j = value[k] + w, k
        if v < 0.0:
            v, j = 0.0, -1
        value.append(v + scores[i])
        before.append(j)
        top.append(max(top[-1], (value[i], i), key=lambda x: x[0]))
    out, i = [], top[-1][1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _marginals(spans: list, scores: list[float], weights: dict[str, float] | None = None) -> tuple[list[float], dict[str, float]]:
    """(probability of each span, expected number of each pair feature), by the forward and backward sums over segmentations."""
    get, n = (weights or {}).get, len(spans)
    total = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    pairs = [(j, i, f) for i in range(n) for j in range(n) if spans[j][1] <= spans[i][0] for f in [pair_feature(spans[j], spans[i])]]
    into, out_of = defaultdict(list), defaultdict(list)
    for j, i, f in pairs:
        w = get(f, 0.0) if f else 0.0
        into[i].append((j, w))
        out_of[j].append((i, w))
    f = [0.0] * n
    for i in range(n):  # by end, so what may come before is done
        f[i] = scores[i] + total([0.0, *(f[j] + w for j, w in into[i])])
    b = [0.0] * n
    for i in sorted(range(n), key=lambda k: -spans[k][0]):
        b[i] = total([0.0, *(scores[k] + b[k] + w for k, w in out_of[i])])
    z = total([0.0, *f])
    expected: dict[str, float] = defaultdict(float)
    for j, i, name in pairs:
        if name:
            expected[name] += math.exp(f[j] + get(name, 0.0) + scores[i] + b[i] - z)
    return [math.exp(f[i] + b[i] - z) for i in range(n)], expected


#: Templates of invented sentences; {N} full name, {G} given name after a courtesy word, {T} title, {E}, {P}, {I} with its label, {A} are passages, other letters decoys.
TEMPLATES = (
    "ติดต่อ {T}{N} ที่หมายเลข {P} ฝ่ายกฎหมายรายงานผล", "ผู้ประสานงานคือ {T}{N} โทร. {P} อีเมล {E} กองแผนงานเสนอ", "ผู้ยื่นคำร้อง {T}{N} {I} ที่ประชุมรับทราบ", "{T}{N} ({I}) ขอลาพักการศึกษา", "ผู้ยื่นคำร้อง คุณ{G} {I} หัวหน้าภาควิชาพิจารณา", "ไลน์หรือมือถือ {P} ({T}{N}) ทั้งนี้ ผู้แทนเสนอ",
    "ไลน์หรือมือถือ {P} (คุณ{G}) อนึ่ง สำนักทะเบียนเสนอ", "ส่งเอกสารถึง {T}{N} เลขที่ {A} ที่ประชุมรับทราบ", "มี {T}{N} และ {T}{N} เป็นกรรมการสอบ", "เอกสารของ {T}{N} ยังไม่ครบ", "{N} แจ้งว่าเปลี่ยนเบอร์แล้ว", "ที่อยู่ตามทะเบียน {A} โทรศัพท์ {P} สภาเสนอ", "จัดส่งที่ {A} ภายในสัปดาห์หน้า", "เอกสารของ คุณ{G} ยังไม่ครบ", "คุณ{G} แจ้งว่าเปลี่ยนเบอร์", "คุณ{G} ({I}) ขอลา",
    "โทรศัพท์ {P} ต่อ 477 โทรสาร {P} พบกันที่อาคาร H ถนนสายใน", "ใบสั่งซื้อเลขที่ {O} กองแผนงานเสนอ", "ครุภัณฑ์หมายเลข {V} หน่วยประเมินผลเสนอ", "หนังสืออ้างอิง ISBN {B} ผู้แทนเสนอ", "โดยอ้างอิงรายวิชา {C} ที่ประชุมรับทราบ", "แก้ไขข้อมูล {I} ของนักศึกษา", "และ ผลการเทียบโอน และ ระบบคลังข้อสอบ เป็นกรรมการ", "มี ผู้แทนนักศึกษา และ คณะทำงาน เป็นกรรมการสอบ", "อีเมลสำรอง {E}, {E} กองแผนงาน", "สอบถามทางอีเมล{E}ได้ในวันทำการ", "ระบบรุ่น 8.4.14 ที่ประชุม",
    "Please write to {U}{M} at {E}. The council met.", "Send the forms to {U}{M}, {D}. The panel met.", "{M} resides at {D} and can be reached on {P}.", "For questions call {P} or ask {U}{M}. The board met.", "The panel consists of {U}{M} and {U}{M}.", "The file of {U}{M} shows {J}.", "{U}{M} ({J}) asked for leave.", "Her new address is {D}.", "Contact: {E}; tel. {P} ext. 222. The unit met.", "Reply to {E} by Friday.", "on the advice of Dr. W. from the panel.", "The panel consists of Ms {H} and {U}{M}.", "Please write to Ms {H} at {E}.",
    "Mr {H} said that the draft is late.", "The chair thanked Ms. {H} for the draft.", "Please ask Khun {H} about it.", "Mrs. {H} of the board left early. Miss {H} stayed.", "We met Mr. {H}, who agreed.", "Asset tag {V} was moved.", "पाठ्यक्रम {C} के विषय में", "Kept as {V} in the list.", "The number {C} was given.",
    "Order no. {O} was cancelled.", "Course {C} carries 3 credits. The chair of the Faculty of Ocean Studies and the Central Registry.", "Room H-732, Old Pier Building, is closed.", "for course {C} and the Faculty of Community Health.", "ISBN {B} is on loan. Asset {V} was moved.", "Please write to The Dean at {E}.",
    "联系人{Z}，电话{P}。", "评审人为{Z}、{Z}。", "邮寄地址：{D}。", "请发送邮件至{E}。", "订单号{O}已取消。课程{C}为3学分。", "联系人{M}，电话{P}。", "连絡先は{K}、電話{P}。", "連絡先は{K}、電話{P}。", "申請者{K}（{J}）。事務局は確認した。", "担当は{K}と{K}である。", "担当は{M}と{M}である。", "注文番号{O}は取消。科目{C}は3単位である。", "問い合わせは{E}まで。", "申請者{M}（{J}）。", "送付先：{D}。",
)


def _sentence(rng: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    pick = rng.choice
    syllables = "กร นภา ดล วิ สุ ธี รัตน์ พร ชัย มณี ปัญ จิต เพ็ญ ศรี อา วร กิต".split()
    latin = "Mara Velin Doric Sanna Ketil Orrin Talia Brent Halden Merrow Castine Dovale Wexmoor Lanthier".split()

    def thai() -> str:
        return "".join(pick(syllables) for _ in range(rng.randint(2, 3)))

    def digits(n: int) -> str:
        return "".join(str(rng.randint(0, 9)) for _ in range(n))

    def name() -> str:
        a, b = pick(latin), pick(latin)
        form = pick((f"{a} {b}", f"{a} {b}", f"{a} {pick('KLTV')}. {b}", f"{pick('KLTV')}. {b}", f"{b}, {a}", f"{a} {b}".upper(), f"{a} Van {b}", f"{a} O'{b}", f"{a} {b}-{pick(latin)}"))
        return form

    def phone() -> str:
        s = pick(" -.–")
        return pick((f"0{digits(2)}{s}{digits(3)}{s}{digits(4)}", f"0{digits(9)}", f"0{s}{digits(4)}{s}{digits(4)}", f"+66 {digits(2)} {digits(3)} {digits(4)}", f"(+66){digits(2)}-{digits(3)}-{digits(4)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"+44 20 {digits(4)} {digits(4)}"))

    def citizen() -> str:
        s = pick(("-", " ", ""))
        return s.join((digits(1), digits(4), digits(5), digits(2), digits(1)))

    def email() -> str:
        user, host = pick(latin).lower() + pick(("", ".", "_", "+")) + pick(latin).lower(), pick(("office", "dept.office")) + pick((".example", ".test", ".invalid"))
        return pick((f"{user}@{host}", f"{user}@{host}", f"{user} @ {host}", f"{user} (at) {host}", f"{user}[at]{host.replace('.', '[dot]')}", f"{digits(8)}@{host}"))

    def street() -> str:
        return pick(("", f"Unit {rng.randint(1, 40)}, ")) + f"{rng.randint(1, 400)}{pick(('', '/' + str(rng.randint(1, 90))))} {pick(latin)} {pick(('Gate', 'Mill', 'Hill'))} {pick(('Road', 'Lane', 'Street', 'Close', 'Rd.'))}, {pick(latin)} {pick(latin)}{pick(('', ' ' + digits(5)))}"

    def thai_address() -> str:
        d = pick((("ตำบล", "อำเภอ", "จังหวัด"), ("ต.", "อ.", "จ.")))
        return f"{rng.randint(1, 400)}{pick(('', '/' + str(rng.randint(1, 90))))}{pick(('', f' หมู่ {rng.randint(1, 12)}'))}{pick(('', f' ซอย{thai()} {rng.randint(1, 30)}'))}{pick(('', f' ถนน{thai()}', f' ถ.{thai()}'))} {d[0]}{thai()} {d[1]}{thai()} {d[2]}{thai()}{pick(('', ' ' + digits(5)))}"

    ids = lambda th: pick(((("เลขประจำตัวประชาชน ", "เลขบัตร ปชช. ", "บัตรประชาชนเลขที่ ") if th else ("national ID ", "citizen no. ", "ID card "), citizen()), (("หนังสือเดินทางเลขที่ ",) if th else ("passport ",), pick(("ZX", "QX")) + pick(("", " ")) + digits(7)), (("รหัสนักศึกษา ", "รหัสประจำตัวนักศึกษา ") if th else ("student ID ", "student no. "), pick("456") + digits(7))))
    han = "柏思澜若川渚远帆桑牧岚"
    kanji = ("青野", "海老坂", "月城原", "霧島田"), ("千波", "海斗郎", "凪人", "澪花")
    fill = {
        "N": (lambda: pick((f"{thai()} {thai()}", f"{thai()} {thai()}", f"{thai()}  {thai()}", name())), "name"), "G": (thai, "name"), "M": (name, "name"), "H": (lambda: pick(latin), "name"), "Z": (lambda: "".join(pick(han) for _ in range(rng.randint(2, 3))), "name"), "K": (lambda: pick(kanji[0]) + pick(("", " ")) + pick(kanji[1]), "name"),
        "E": (email, "email"), "P": (phone, "phone"), "A": (thai_address, "address"), "D": (street, "address"), "T": (lambda: pick(("", "", "นาย", "นางสาว", "คุณ", "ผศ.", "ผศ. ", "รศ.ดร.", "ดร.", "อ.", "น.ส. ", "ว่าที่ร้อยตรี ", "ผู้ช่วยศาสตราจารย์ ดร.", "Prof. ")), None), "U": (lambda: pick(("", "", "Mr ", "Ms. ", "Mrs. ", "Dr. ", "Asst. Prof. ", "Assoc. Prof. Dr. ")), None),
        "O": (lambda: "41" + digits(11), None), "V": (lambda: f"{digits(5)}-{digits(3)}-{digits(3)}", None), "B": (lambda: f"978-0-00-{digits(5)}-{digits(1)}", None), "C": (lambda: pick("5678") + digits(7), None),
    }
    text, gold = "", set()
    for part in re.split(r"(\{[A-Z]\})", " ".join(pick(TEMPLATES) for _ in range(2))):
        if part in ("{I}", "{J}"):
            label, value = ids(part == "{I}")
            text += pick(label)
            gold.add((len(text), len(text) + len(value), "id_number"))
            text += value
        elif re.fullmatch(r"\{[A-Z]\}", part):
            make, kind = fill[part[1]]
            value = make()
            if kind:
                gold.add((len(text), len(text) + len(value), kind))
            text += value
        else:
            text += part
    return text, gold


@lru_cache(1)
def trained(sentences: int = TRAINING, passes: int = PASSES, seed: int = 7) -> dict[str, float]:
    """Weights by feature, fitted to the likelihood of invented sentences by stochastic gradient steps."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _sentence(rng)
        spans = candidates(text)
        if spans:
            data.append((spans, [features(text, *s) for s in spans], [s in gold for s in spans]))
    weights: dict[str, float] = defaultdict(float)
    for n in range(passes):
        rate = 0.4 / (1 + n)
        rng.shuffle(data)
        for spans, feats, gold in data:
            p, expected = _marginals(spans, [sum(weights[f] for f in fs) for fs in feats], weights)
            chain = [s for s, g in zip(spans, gold) if g]
            for f in filter(None, map(pair_feature, chain, chain[1:])):
                weights[f] += rate
            for f, q in expected.items():
                weights[f] -= rate * q
            for fs, g, q in zip(feats, gold, p):
                if abs(g - q) > 1e-3:
                    for f in fs:
                        weights[f] += rate * (g - q)
    return {f: w for f, w in weights.items() if abs(w) > 1e-6}


def passages(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal passages of a text, in order."""
    t, at = cleaned(text)
    spans = candidates(t)
    if not spans:
        return []
    get = weights.get
    chosen = best(spans, [sum(get(f, 0.0) for f in features(t, *s)) for s in spans], weights)
    if at is None:
        return [spans[i] for i in chosen]
    return [(at[spans[i][0]], at[spans[i][1] - 1] + 1, spans[i][2]) for i in chosen]


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per passage: key, kind, start_pos, end_pos (exclusive), in code points of the text. Null and empty texts give none."""
    weights = dict(trained())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            got: list[tuple[int, int, str]] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = passages(t, weights) if t else ()
                rows += [i] * len(own)
                got += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([g[2] for g in got], pa.string()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], names=["k", "kind", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, kind string, start_pos int, end_pos int").withColumnRenamed("k", key)


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: key and the text with [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS] for each passage; null stays null."""
    weights = dict(trained())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                for s, e, kind in reversed(passages(t, weights) if t else ()):
                    t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "masked"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, masked string").withColumnRenamed("k", key)
