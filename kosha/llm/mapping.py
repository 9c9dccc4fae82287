"""Problem 2: freely typed values to the entries of a reference list.

A multi-pattern automaton over the names in the lists finds the mentions embedded in a value, and the
longest ones that don't overlap win. A value whose mentions leave the meaning open goes to token-set
similarity (tokens: pairs of neighbouring characters), with the edit distance deciding among the nearest: the most
similar names of all, and of every entry that is about as similar its most similar one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual abbreviations of degree names, by the full name without หลักสูตร.
ABBREVIATIONS = {
    "วิทยาศาสตรบัณฑิต": "วท.บ.",
    "วิทยาศาสตรมหาบัณฑิต": "วท.ม.",
    "วิศวกรรมศาสตรบัณฑิต": "วศ.บ.",
    "วิศวกรรมศาสตรมหาบัณฑิต": "วศ.ม.",
    "ศิลปกรรมบัณฑิต": "ศป.บ.",
    "ศิลปกรรมมหาบัณฑิต": "ศป.ม.",
    "บริหารกิจการบัณฑิต": "บธ.บ.",
    "บริหารกิจการมหาบัณฑิต": "บธ.ม.",
    "ปรัชญาดุษฎีบัณฑิต": "ปร.ด.",
}
#: Words that join a degree to its field.
LINKS = ("สาขาวิชา", "สาขา", "วิชาเอก")
#: Remarks that say nothing about which entry is meant.
REMARKS = ("สถาบันเทคโนโลยีธาราวดี", "Tharawadee Institute of Technology", "หลักสูตรนานาชาติ", "หลักสูตรปรับปรุง", "ฉบับปรับปรุง", "ฉบับปี", "ภาคพิเศษ", "ภาคปกติ", "ภาคค่ำ", "งานบริการ", "ฝ่ายวิชาการ", "ฝ่ายธุรการ", "งานธุรการ", "International Program", "นานาชาติ")
PROGRAM_WORD = "หลักสูตร"
#: Share of edits against the longer string from which a value means no entry.
MOST_EDITS = 0.34
#: Nearest names by token sets that the edit distance is taken to, beside the nearest one of every entry that is about as similar; least similarity of token sets.
NEAREST, LEAST, CLOSE = 12, 0.3, 0.1

_IGNORED = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️]")
_TONE_FIRST = re.compile("([่-๋])([ัิ-ู])")
_THAI_DIGITS = {0x0E50 + i: str(i) for i in range(10)}
_KEEP = re.compile(r"[^\wัำ-ฺ็-๎ฯ]|_")


def plain(text: str) -> str:
    """One form for text that reads the same, in lower case, spaces single."""
    t = unicodedata.normalize("NFKC", _IGNORED.sub("", text)).replace("ํา", "ำ").replace("เเ", "แ")
    return " ".join(_TONE_FIRST.sub(r"\2\1", t).translate(_THAI_DIGITS).casefold().split())


def compact(text: str) -> str:
    """plain() without anything but letters, marks and digits."""
    return _KEEP.sub("", plain(text))


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours (bit-parallel)."""
    m = len(a)
    if not m:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, d0, old, dist = full, 0, 0, 0, m
    for c in b:
        pm = at.get(c, 0)
        d0 = (((((pm & vp) + vp) ^ vp) | pm | vn) | ((((~d0) & pm) << 1) & old)) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        dist += bool(hp & top) - bool(hn & top)
        hp, hn = ((hp << 1) | 1) & full, (hn << 1) & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        old = pm
    return dist


class Names:
    """Ways to write each entry, with the entry meant (0: a thing that is no entry)."""

    def __init__(self, forms: dict[str, int], noise: Sequence[str], part: float = 0.0) -> None:
        """part: share of a value that a mention must have to decide against a rest that means nothing; 0 where a mention can't be half a name."""
        import ahocorasick

        self.forms, self.part = forms, part
        self.noise = {compact(x) for x in noise} - set(forms) - {""}
        self.auto = ahocorasick.Automaton()
        for w in [*forms, *self.noise]:
            self.auto.add_word(w, w)
        self.auto.make_automaton()
        self.list = list(forms)
        self.ids = np.array([forms[w] for w in self.list])
        grams = sorted({g for w in self.list for g in self.tokens(w)})
        self.at = {g: i for i, g in enumerate(grams)}
        self.matrix = np.zeros((len(self.list), len(grams)), np.float32)
        for i, w in enumerate(self.list):
            self.matrix[i, [self.at[g] for g in self.tokens(w)]] = 1
        self.sizes = self.matrix.sum(1)
        self.by_entry = np.argsort(self.ids, kind="stable")
        self.starts = np.flatnonzero(np.concatenate([[True], np.diff(self.ids[self.by_entry]) != 0])) if len(self.ids) else np.zeros(0, np.int64)

    @staticmethod
    def tokens(w: str) -> set[str]:
        w = f"^{w}$"
        return {w[i : i + 2] for i in range(len(w) - 1)}

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of the longest mentions that don't overlap."""
        found = sorted(((end + 1 - len(w), end + 1, w) for end, w in self.auto.iter(text)), key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int, str]] = []
        for s, e, w in found:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, w))
        return sorted(taken)

    def nearest(self, text: str) -> tuple[int, float]:
        """(entry, share of edits) of the name with the most similar token set, judged by edits among the nearest few."""
        own = self.tokens(text)
        hits = [self.at[g] for g in own if g in self.at]
        if not hits:
            return 0, 1.0
        score = 2 * self.matrix[:, hits].sum(1) / (self.sizes + len(own))
        near = set(np.argsort(-score, kind="stable")[:NEAREST].tolist())
        if score.max() < LEAST:
            return 0, 1.0
        grouped, ends = score[self.by_entry], [*self.starts[1:].tolist(), len(score)]
        near.update(int(self.by_entry[a + int(grouped[a:b].argmax())]) for a, b, top in zip(self.starts.tolist(), ends, np.maximum.reduceat(grouped, self.starts).tolist()) if top >= max(LEAST, score.max() - CLOSE))
        best = min((self.distance(self.list[i], text), -float(score[i]), int(i)) for i in near)
        return int(self.ids[best[2]]), best[0]

    @staticmethod
    def distance(name: str, text: str) -> float:
        """Share of edits against the longer one; of names that name a degree and a field the field alone must be half right too, as degrees are long and much alike."""
        share = edits(name, text) / max(len(text), len(name))
        a, b = name.partition(LINKS[0])[2], text.partition(LINKS[0])[2]
        return 1.0 if a and b and share and 2 * edits(a, b) > max(len(a), len(b)) else share

    def meant(self, value: str) -> int:
        """The entry that the value means, or 0."""
        text = compact(value)
        if not text:
            return 0
        if text in self.forms:
            return self.forms[text]
        found = self.mentions(text)
        rest, entries, at = [], [], 0
        for s, e, w in found:
            rest.append(text[at:s])
            if w in self.forms:
                entries.append(w)
            at = e
        rest.append(text[at:])
        left = re.sub(r"\d+|พศ", "", "".join(rest))
        if entries and len(left) <= 1:
            return self.forms[max(entries, key=len)]
        bare, at = [], 0
        for s, e, w in found:
            bare.append(text[at:s] + (w if w in self.forms else ""))
            at = e
        bare.append(text[at:])
        ways = dict.fromkeys(["".join(bare), re.sub(r"^\d+|\d+$", "", "".join(bare)), *(compact(p) for p in re.split(r"[/,(]| - ", plain(value)) if len(p) > 3)])
        got = [(share, i, len(w)) for w in ways if w for i, share in [self.nearest(w)]]
        near = [x for x in got if x[0] <= MOST_EDITS]
        if near:
            return min(near)[1]
        if entries:
            longest = max(entries, key=len)
            if len(longest) >= self.part * len(text):
                return self.forms[longest]
        return 0


def faculty_names(rows: Sequence[dict]) -> Names:
    """rows: faculty_id, canonical, prefix_type, aliases."""
    forms: dict[str, int] = {}
    for r in rows:
        own = [r["canonical"], *(a for a in r["aliases"] or () if a)]
        if r["prefix_type"] and r["canonical"].startswith(r["prefix_type"]):
            own.append(r["canonical"][len(r["prefix_type"]) :])
        for x in own:
            forms.setdefault(compact(x), r["faculty_id"])
    forms.pop("", None)
    return Names(forms, REMARKS)


def program_names(rows: Sequence[dict], units: Sequence[str]) -> Names:
    """rows: program_id, canonical, degree, field; units: names of other things, which are remarks here.

    Every degree is combined with every field, so that a pair the list doesn't hold is known as such;
    a field alone means its programme if only one has it.
    """
    held = {(r["degree"], r["field"]): r["program_id"] for r in rows}
    fields, degrees = sorted({r["field"] for r in rows}), {r["degree"] for r in rows}
    degrees |= {PROGRAM_WORD + d for d in ABBREVIATIONS}
    forms: dict[str, int] = {compact(r["canonical"]): r["program_id"] for r in rows}
    for d in sorted(degrees):
        full = d.removeprefix(PROGRAM_WORD)
        for f in fields:
            for start in (d, full, ABBREVIATIONS.get(full)):
                if start:
                    for link in (*LINKS, ""):
                        forms.setdefault(compact(start + link + f), held.get((d, f), 0))
    for f in fields:
        ids = [i for (_, x), i in held.items() if x == f]
        for link in (*LINKS, ""):
            forms.setdefault(compact(link + f), ids[0] if len(ids) == 1 else 0)
    # a field may stand beside a degree that no list knows: then it must be most of the value
    return Names(forms, [*REMARKS, *units], 0.5)


_MADE: dict = {}


def map_values(df: DataFrame, key: str, column: str, field: str, names: tuple) -> DataFrame:
    """One row per item of the array column that is not null: key, field, item_no, item, ref_id (0: no entry).

    names: ("faculties", rows) or ("programs", rows, units), plain values of the bounded reference
    lists. Null and empty arrays give no rows, null items none, blank items 0. Repeated values are
    worked out once per task; no shuffle.
    """
    items = df.select(F.col(key).alias("k"), F.posexplode(column).alias("item_no", "item")).filter(F.col("item").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = repr(names)
        if mark not in _MADE:
            _MADE[mark] = (faculty_names if names[0] == "faculties" else program_names)(*names[1:])
        known = _MADE[mark]
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                if x not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[x] = known.meant(x)
                out.append(seen[x])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=["k", "item_no", "item", "ref_id"])

    kind = df.schema[key].dataType.simpleString()
    return items.mapInArrow(run, f"k {kind}, item_no int, item string, ref_id int").select(F.col("k").alias(key), F.lit(field).alias("field"), "item_no", "item", "ref_id")


def map_resolutions(resolutions: DataFrame, programs: DataFrame, faculties: DataFrame) -> DataFrame:
    """Both array columns of resolutions against their lists (fixed reference tables of some dozens of rows)."""
    p = [r.asDict() for r in programs.select("program_id", "canonical", "degree", "field").orderBy("program_id").collect()]
    f = [r.asDict() for r in faculties.select("faculty_id", "canonical", "prefix_type", "aliases").orderBy("faculty_id").collect()]
    units = [x for r in f for x in (r["canonical"], *(r["aliases"] or ()))]
    return map_values(resolutions, "res_no", "programs", "programs", ("programs", p, units)).unionByName(map_values(resolutions, "res_no", "faculties", "faculties", ("faculties", f)))


def found(resolutions: DataFrame, programs: DataFrame, faculties: DataFrame) -> DataFrame:
    """The items that are not, character for character, canonical."""
    got = map_resolutions(resolutions, programs, faculties)
    kinds = {"programs": [r[0] for r in programs.select("canonical").collect()], "faculties": [r[0] for r in faculties.select("canonical").collect()]}
    same = F.lit(False)
    for k, v in kinds.items():
        same = same | ((F.col("field") == k) & F.col("item").isin(v))
    return got.filter(~same).select("res_no", "field", "item_no", "ref_id").distinct()
