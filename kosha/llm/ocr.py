"""Problem 5: text from scanned pages into continuous paragraphs.

Lexicon: the corpus counts of words (for words cut at a line's end), of short lines by their place on the
page (for running headers and footers), and of units: a character in its context of three characters to
either side, which is a unit for scripts with and without spaces alike. The index is a symmetric-delete one over
units: a unit without its middle character is the key, under which all characters seen there meet with their counts, so that
a rare unit and the frequent ones one substitution away are found together without comparing units.

Confusion pairs are learnt from the corpus: a character that is rare against another one in many of the contexts which that one
rules is read for it; what varies in few places only is no confusion. Known pairs (CONFUSIONS) stand in where a corpus is too small to learn from. A
rare unit is repaired by the frequent unit with the best weighted distance: the count of the printed character in the same context, on
both sides, times the weight of the confusion.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import ChainMap, Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.session import ship, stored

from .common import codepoints, mix, window_hashes

#: What scanners are known to read (first) for what is printed (the others, most likely first); more is learnt from the corpus.
CONFUSIONS = (
    "ธร", "ถกภ", "มน", "นม", "ฮอ", "าว", "ศส", "ดลคต", "ปบ", "บป", "คดต", "ตดค", "ชข", "ขช", "ฝผ", "ผฝ", "ทหฑ", "ฑทต", "ฟพ", "พฟ", "ภถ", "๊่้", "๋่้", "์่้", "ลส", "รธ", "ซช", "ฎฏ", "ฏฎ",
    "+t", "@a", "5s", "0o", "1l", "9g", "ji", "ce", "bh", "8B",
    "字学", "学字", "貝員", "冋同", "入人", "人入", "窠案", "太大", "曰日会", "土士", "士土", "未末", "末未", "己已", "已己", "刀力", "干千", "千干", "王玉", "鳥烏", "石右", "木本", "犬大", "白自", "目日", "侍待", "待侍", "裁栽", "徴微", "綱網", "網綱", "織職", "問間", "間問", "捨拾", "拾捨", "便使", "使便",
)
#: Two letters read for one.
DOUBLES = (("ri", "n"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"))
#: Weight of each further printed character of a known confusion against the one before.
FURTHER = 0.5
#: A confusion is learnt from contexts in which the printed character stands at least so often, if it is found in so many of them, in
#: such a share of them, not in a few only (contexts against occurrences), and after as well as before so many different surroundings.
LEARNT_PRINTED, LEARNT_CONTEXTS, LEARNT_SHARE, LEARNT_SPREAD, LEARNT_SIDES = 20, 4, 0.03, 0.08, 2
#: A misread character is seen in its context at most so often against the printed one, which is seen there at least so often.
RARE_SHARE, LEAST_PRINTED = 0.05, 6
#: Lines at either end of a page among which headers and footers are, their greatest length, the least edge lines and share of a running one.
EDGE, EDGE_CHARS, EDGE_LINES, EDGE_SHARE = 2, 90, 5, 0.75
#: Entries of each lexicon that every worker gets, the most frequent ones (a bound of some MB); texts get what they need of the others by a join.
LEXICON = 100_000
#: Characters in one piece of work; its arrays take some 150 MB of a worker.
CHUNK = 1_000_000
#: Signs at which a word is cut.
SIGNS = "-‐­¬"

_DIGITS = re.compile("[0-9๐-๙]+")
_NUMBER = re.compile(r"\A[\[(\-—–|~. ]*(?:(?:page|p\.?|หน้าที่|หน้า|-)? *[0-9๐-๙]{1,4}(?: *(?:of|จาก|/) *[0-9๐-๙]{1,4})?)[\])\-—–|~. ]*\Z", re.I)
_WORD = re.compile("[A-Za-zऀ-ॿ]+(?:-[A-Za-zऀ-ॿ]+)*")
_THAI = re.compile("[ก-๎]")


def pages(lines: list[str]) -> Iterator[list[int]]:
    """The numbers of the lines that hold text, page by page; # lines are between pages."""
    own: list[int] = []
    for i, line in enumerate(lines):
        if line.startswith("#"):
            yield own
            own = []
        elif line.strip(" "):
            own.append(i)
    yield own


def signatures(line: str) -> list[str]:
    """The line with # for numbers, and that with each word but the first in turn left open, where enough stays."""
    s = _DIGITS.sub("#", line.strip(" "))
    out = [s]
    words = s.split(" ")
    if 2 <= len(words) <= 7:
        for i, w in enumerate(words):
            if i and w and w != "#" and sum(map(len, words)) - len(w) >= 11:
                out.append(" ".join([*words[:i], "*", *words[i + 1 :]]))
    return out


def _near(a: str, b: str, most: int) -> bool:
    from .mapping import edits

    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


class Lexicon:
    """Running lines and words. base: a lexicon that is known already, of which this one holds what it lacks."""

    def __init__(self, edge: list[str], words: dict[str, int], base: "Lexicon | None" = None) -> None:
        self.base = base
        self.edge, self.words = ({*edge}, words) if base is None else (_Both({*edge}, base.edge), ChainMap(words, base.words))
        # running lines by what stands at their ends and in their middle, of which a few misread characters leave something
        self.by_piece: dict[tuple, list[str]] = {}
        for e in edge:
            if "*" not in e and len(e) >= 4 and not self._like(e):
                for piece in self._pieces(e):
                    self.by_piece.setdefault(piece, []).append(e)
        own = {w.split("-", 1)[1] for w in words if "-" in w}
        self.tails = own if base is None else _Both(own, base.tails)
        self.memo: dict[str, bool] = {}

    @staticmethod
    def _pieces(s: str) -> set[tuple]:
        return {(0, s[:5]), (1, s[-5:]), *((2, w) for w in s.split(" ") if len(w) > 5)}

    def _like(self, s: str) -> bool:
        """Whether the signature is that of a more frequent running line with a few characters changed."""
        most = max(1, len(s) // 10)
        own = any(_near(e, s, most) for piece in self._pieces(s) for e in self.by_piece.get(piece, ()))
        return own or self.base is not None and self.base._like(s)

    def asked(self, lines: list[str]) -> tuple[set[str], set[str]]:
        """What could be looked up for a text: keys of lines (signatures and pieces) and words."""
        keys: set[str] = set()
        for own in pages(lines):
            for i in {*own[:EDGE], *own[-EDGE:]}:
                if len(lines[i]) <= EDGE_CHARS:
                    own_keys = signatures(lines[i])
                    keys.update(own_keys, map(repr, self._pieces(own_keys[0])))
        words: set[str] = set()
        body = [x for x in lines if x.strip(" ")]
        for x, after in zip(body, body[1:]):
            if x[-1] in SIGNS and (ends := _ends(x[:-1], after.lstrip(" "))):
                x, y = ends
                words.update((x + y, f"{x}-{y}", y.split("-")[0], y))
        return keys, words

    def running(self, line: str) -> bool:
        """Whether a line at a page's edge is a header, a footer or a page number, perhaps with misread characters."""
        got = self.memo.get(line)
        if got is None:
            s = signatures(line)
            got = bool(_NUMBER.match(line)) or any(x in self.edge for x in s)
            if not got and len(s[0]) >= 4:
                got = self._like(s[0])
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[line] = got
        return got

    def cut(self, line: str, after: str) -> bool:
        """Whether the sign at the line's end cuts a word that goes on in the next line."""
        sign, head, tail = line[-1], line[:-1], after.lstrip(" ")
        if not head or not tail:
            return False
        if _THAI.match(head[-1]) and _THAI.match(tail):
            return True
        ends = _ends(head, tail)
        if not ends or not head[-1].isalpha() and not "ऀ" <= head[-1] <= "ॿ" and sign == "-":
            return False
        if sign in "­¬":
            return True
        a, b = ends
        joined, own = self.words.get(a + b, 0), self.words.get(f"{a}-{b}", 0)
        if joined or own:
            return joined > own
        if not (b[0].isalpha() or "ऀ" <= b[0] <= "ॿ") or a[-1].isupper():
            return False
        last = b.split("-")[0]
        return not (last in self.words and (last in self.tails or b in self.tails))


class _Both:
    """Membership in either of two sets."""

    def __init__(self, a: set, b: set) -> None:
        self.a, self.b = a, b

    def __contains__(self, x: object) -> bool:
        return x in self.a or x in self.b


def _ends(head: str, tail: str) -> tuple[str, str] | None:
    """The last word of a line and the first of the next one."""
    a, b = re.search("[A-Za-zऀ-ॿ]+(?:-[A-Za-zऀ-ॿ]+)*[^\\s]*\\Z|[^\\s]+\\Z", head), re.match("[^\\s.,;:!?)”\"]+", tail)
    return (a[0], b[0]) if a and b else None


def _body(lines: list[str], known: Lexicon) -> tuple[set[int], set[int], list[int]]:
    """(dropped lines, lines that end in a cut word, lines of the body)."""
    drop: set[int] = set()
    for own in pages(lines):
        for i in {*own[:EDGE], *own[-EDGE:]}:
            if len(lines[i]) <= EDGE_CHARS and not lines[i].startswith("<") and known.running(lines[i]):
                drop.add(i)
    body = [i for i, x in enumerate(lines) if i not in drop and x.strip(" ") and not x.startswith(("#", "<table"))]
    cut = {i for i, after in zip(body, body[1:]) if lines[i][-1] in SIGNS and known.cut(lines[i], lines[after])}
    return drop, cut, body


#: Bits of a hash that a sieve goes by; it takes 8 MB, whatever passes it is joined.
SIEVE = 26


def _sieve(hashes: DataFrame) -> np.ndarray:
    """A bit for the upper SIEVE bits of each hash (the only column h)."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - SIEVE).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << SIEVE - 6, np.uint64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - SIEVE)
    return (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def _rests(lines: list[str], own: list[int], of: list[int]) -> dict[int, int]:
    """For the lines of a page the hash of the rest of the page, in which copies of a page agree."""
    each = {i: (2 * k + 1) * _hash(lines[i]) for k, i in enumerate(own)}
    whole = sum(each.values())
    return {i: _signed((whole - each[i]) & 0xFFFFFFFFFFFFFFFF) for i in of}


def _counts(texts: DataFrame) -> DataFrame:
    """(kind, entry, h, n, votes): words inside lines (kind w) with counts; signatures of lines at edges of pages (kind e) with their hash and the pages that differ in the rest."""
    schema = pa.schema([("kind", pa.string()), ("entry", pa.string()), ("h", pa.int64()), ("rest", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge: set[tuple[str, int]] = set()
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [("e", s, _signed(_hash(s)), rest, 1) for s, rest in edge] + [("w", w, 0, 0, n) for w, n in words.items()]
            edge.clear(), words.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            for t in b.column(2).to_pylist():
                lines = (t or "").split("\n")
                words.update(w for x in lines for w in _WORD.findall(x) if not x.endswith(w))
                for own in pages(lines):
                    ends = [i for i in {*own[:EDGE], *own[-EDGE:]} if len(lines[i]) <= EDGE_CHARS]
                    if ends:
                        edge.update((s, rest) for i, rest in _rests(lines, own, ends).items() for s in signatures(lines[i]))
            if len(edge) + len(words) > 300_000:
                yield out()
        yield out()

    each = texts.mapInArrow(run, "kind string, entry string, h bigint, rest bigint, n bigint").groupBy("kind", "entry", "h", "rest").agg(F.sum("n").alias("n"))
    return each.groupBy("kind", "entry", "h").agg(F.sum("n").alias("n"), F.count("*").alias("votes"))


def _inside(texts: DataFrame, edge: DataFrame) -> DataFrame:
    """(h, inside): the pages, different in the rest, that have the signatures of edge in lines not at an edge. edge: h."""
    sieve = texts.sparkSession.sparkContext.broadcast(_sieve(edge))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            hashes, rests = [], []
            for t in b.column(2).to_pylist():
                lines = (t or "").split("\n")
                for own in pages(lines):
                    of = [i for i in own[EDGE:-EDGE] if len(lines[i]) <= EDGE_CHARS]
                    pairs = [(i, _hash(s)) for i in of for s in signatures(lines[i])]
                    if pairs:
                        kept = np.flatnonzero(_passes(sieve.value, np.array([h for _, h in pairs], np.uint64)))
                        if len(kept):
                            rest = _rests(lines, own, of)
                            hashes += [_signed(pairs[k][1]) for k in kept]
                            rests += [rest[pairs[k][0]] for k in kept]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(rests, pa.int64())], names=["h", "rest"])

    return texts.mapInArrow(run, "h bigint, rest bigint").distinct().join(edge, "h", "left_semi").groupBy("h").agg(F.count("*").alias("inside"))


def lexicon(texts: DataFrame, limit: int = LEXICON) -> tuple[list[str], dict[str, int], DataFrame | None]:
    """(signatures of running lines, words with counts, the rest): the most frequent ones of either, and what is beyond the limit as (key, kind, entry, n), if there is any.

    Copies of a page are one vote for a running line. Each entry of the rest stands under every key by which a text may ask for it.
    """
    counted = stored(_counts(texts).filter((F.col("kind") == "w") & (F.col("n") >= 3) | (F.col("kind") == "e") & (F.col("votes") >= EDGE_LINES)))
    at_edge = counted.filter("kind = 'e'")
    inside = _inside(texts, at_edge.select("h").distinct())
    running = at_edge.join(inside, "h", "left").filter(F.col("votes") >= EDGE_SHARE * (F.col("votes") + F.coalesce("inside", F.lit(0)))).select("kind", "entry", F.col("votes").alias("n"))
    known = stored(running.unionByName(counted.filter("kind = 'w'").select("kind", "entry", "n")))
    first = {kind: known.filter(F.col("kind") == kind).orderBy(F.col("n").desc(), "entry").limit(limit).select("entry", "n").collect() for kind in "ew"}
    edge, words = [r[0] for r in first["e"]], {r[0]: r[1] for r in first["w"]}
    if len(edge) < limit and len(words) < limit:
        return edge, words, None
    last = {kind: (rows[-1]["n"], rows[-1]["entry"]) if len(rows) == limit else None for kind, rows in first.items()}
    beyond = F.lit(False)
    for kind, at in last.items():
        if at:
            beyond = beyond | (F.col("kind") == kind) & ((F.col("n") < at[0]) | (F.col("n") == at[0]) & (F.col("entry") > at[1]))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, entry, n in zip(*(c.to_pylist() for c in b.columns)):
                keys = {entry, *map(repr, Lexicon._pieces(entry))} if kind == "e" else {entry, *entry.split("-", 1)[1:]}
                rows += [(k, kind, entry, n) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["key", "kind", "entry", "n"])

    return edge, words, stored(known.filter(beyond).select("kind", "entry", "n").mapInArrow(keyed, "key string, kind string, entry string, n bigint"))


def _with_rest(texts: DataFrame, rest: DataFrame | None) -> DataFrame:
    """(tbl, rec, text, rest): the texts with those entries beyond the limit that they ask for, as many as their own lines and cut words may need."""
    if rest is None:
        return texts.withColumn("rest", F.lit(None).cast("array<struct<kind:string,entry:string,n:bigint>>"))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Lexicon([], {})
        for b in batches:
            rows = [(tbl, rec, k) for tbl, rec, t in zip(*(b.column(i).to_pylist() for i in range(3))) if t for keys in none.asked(t.split("\n")) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.string()))], names=["tbl", "rec", "key"])

    asked = texts.select("tbl", "rec", "text").mapInArrow(ask, "tbl int, rec bigint, key string").distinct()
    got = asked.join(rest, "key").groupBy("tbl", "rec").agg(F.collect_set(F.struct("kind", "entry", "n")).alias("rest"))
    return texts.join(got, ["tbl", "rec"], "left").select("tbl", "rec", "text", "rest")


_DOUBLE_CODE = 0x200000


@lru_cache(1)
def _interest() -> np.ndarray:
    """The characters that may be misread or printed, by code point: letters and marks, and the digits and signs of known confusions."""
    use = np.zeros(0x110000, bool)
    for c in range(0x41, 0x30000):
        use[c] = unicodedata.category(chr(c))[0] in "LM"
    use[[ord(c) for group in CONFUSIONS for c in group]] = True
    return use


def known_confusions() -> dict[int, list[tuple[int, float]]]:
    """What is printed, with weights, by what is read."""
    out = {ord(g[0]): [(ord(x), FURTHER**i) for i, x in enumerate(g[1:])] for g in CONFUSIONS}
    return out | {_DOUBLE_CODE + i: [(ord(x), 1.0)] for i, (_, x) in enumerate(DOUBLES)}


def looks_alike(c: str, r: str) -> bool:
    """Whether one stands for the other without being misread: a look-alike, a compatibility form, another case, another digit."""
    from .lookalikes import LOOKALIKES, compatible

    plain = lambda x: compatible(x).casefold()
    return plain(c) == plain(r) or any(c in g and r in g for g in LOOKALIKES) or c.isdigit() and r.isdigit()


def _windows(cp: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, context key, code) of the characters of interest (use) of a text with three characters of margin; one may have several keys.

    A key of a context on both sides is even and has 32 bits of either side; those of one side are odd.
    """
    ctx = cp.copy()
    ctx[((cp >= 48) & (cp <= 57)) | ((cp >= 0xE50) & (cp <= 0xE59))] = 48
    each = mix(ctx.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h, h2 = window_hashes(each, 3), window_hashes(each, 2)
    at = np.flatnonzero(use[cp])
    at = at[(at >= 3) & (at < len(cp) - 4)]
    latin = ((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122))
    odd = cp[at] < 65  # digits and signs only inside words
    at = at[~odd | latin[at - 1] | latin[at + 1]]
    upper, lower, one = np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFE), np.uint64(1)
    key, code = h[at - 3] & upper | h[at + 1] & lower, cp[at].astype(np.int64)
    # a character of a script whose words are two or three characters long also by two characters on one side
    han = at[(cp[at] >= 0x3400) & (cp[at] < 0xA000)]
    at, key, code = np.concatenate([at, han, han]), np.concatenate([key, h2[han - 2] | one, mix(h2[han + 1]) | one]), np.concatenate([code, *[cp[han].astype(np.int64)] * 2])
    for i, (two, _) in enumerate(DOUBLES):
        p = np.flatnonzero((cp[:-1] == ord(two[0])) & (cp[1:] == ord(two[1])))
        p = p[(p >= 3) & (p < len(cp) - 5)]
        at, key, code = np.concatenate([at, p]), np.concatenate([key, h[p - 3] & upper | h[p + 2] & lower]), np.concatenate([code, np.full(len(p), _DOUBLE_CODE + i)])
    return at, key, code


def _read(texts: DataFrame, edge: list[str], words: dict[str, int], judged: DataFrame | None = None, wrong: list[int] | None = None) -> DataFrame:
    """(key, c, n): counts of characters by context, by pieces of work. With judged (key, c) instead (key, c, tbl, rec, line, col): places.

    Places are those of the judged characters, all of which are among wrong, and of some others, which a join with judged leaves out. c = -1 and -2
    are no characters but dropped lines and lines with a cut word. texts: tbl, rec, text, rest.
    """
    spark: SparkSession = texts.sparkSession
    sent = spark.sparkContext.broadcast((edge, words))
    sieve = judged and spark.sparkContext.broadcast(_sieve(judged.select(F.col("key").bitwiseXOR(F.shiftleft(F.col("c").cast("bigint"), 42)).alias("h"))))
    gap = np.full(4, 10, np.uint32)

    def counted(chars: list, lines: list, use: np.ndarray) -> pa.RecordBatch:
        _, key, code = _windows(np.concatenate([gap, *chars, gap]), use)
        both = key ^ mix(code.astype(np.uint64))
        order = np.argsort(both)
        first = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(order)))
        k, c = key[order[first]], code[order[first]]
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "c", "n"])

    def rows(key: np.ndarray, code: np.ndarray, meta: np.ndarray, col: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(code.astype(np.int32)), pa.array(meta[:, 0].astype(np.int32)), pa.array(meta[:, 1]), pa.array(meta[:, 2].astype(np.int32)), pa.array(col.astype(np.int32))], names=["key", "c", "tbl", "rec", "line", "col"])

    def placed(chars: list, lines: list, use: np.ndarray) -> pa.RecordBatch:
        at, key, code = _windows(np.concatenate([gap, *chars, gap]), use)
        kept = _passes(sieve.value, key ^ (code.astype(np.uint64) << np.uint64(42)))
        at, key, code = at[kept], key[kept], code[kept]
        starts, meta = np.array([x[0] for x in lines], np.int64), np.array([x[1:] for x in lines], np.int64).reshape(-1, 3)
        line = np.searchsorted(starts, at, side="right") - 1
        return rows(key, code, meta[line], at - starts[line])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Lexicon(*sent.value)
        done, use = counted, _interest()
        if sieve:
            done, use = placed, np.zeros(0x110000, bool)
            use[[c for c in wrong if c < _DOUBLE_CODE]] = True
        chars, lines, at = [], [], 4
        marks: list[tuple[int, int, int, int]] = []
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            for tbl, rec, t, rest in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = (t or "").split("\n")
                if tbl > 1:  # only counted
                    drop, cut, body = set(), set(), [i for i, x in enumerate(own) if x.strip(" ") and not x.startswith(("#", "<table"))]
                else:
                    known = base
                    if rest:
                        more = sorted(rest, key=lambda x: (-x["n"], x["entry"]))
                        known = Lexicon([x["entry"] for x in more if x["kind"] == "e"], {x["entry"]: x["n"] for x in more if x["kind"] == "w"}, base)
                    drop, cut, body = _body(own, known)
                if sieve:
                    marks += [(-1, tbl, rec, i) for i in sorted(drop)] + [(-2, tbl, rec, i) for i in sorted(cut)]
                for j, i in enumerate(body):
                    x = own[i]
                    last = j + 1 == len(body) or body[j + 1] > i + 1
                    end = "\n" * 4 if last else "" if i in cut or x[-1] > "⺀" and own[body[j + 1]][0] > "⺀" else " "
                    lines.append((at, tbl, rec, i))
                    piece = codepoints((x[:-1] if i in cut else x) + end)
                    chars.append(piece)
                    at += len(piece)
            if at > CHUNK:
                yield done(chars, lines, use)
                chars, lines, at = [], [], 4
        if chars:
            yield done(chars, lines, use)
        if marks:
            m = np.array(marks, np.int64)
            keys = mix(((m[:, 2] * 2 + m[:, 1]) * (1 << 24) + m[:, 3]).view(np.uint64))
            yield rows(keys, m[:, 0], m[:, 1:], np.zeros(len(m), np.int64))

    return texts.mapInArrow(run, "key bigint, c int, tbl int, rec bigint, line int, col int" if sieve else "key bigint, c int, n bigint")


def _contexts(counts: DataFrame) -> DataFrame:
    """(key, seen): the index: contexts with all characters seen there and their counts, at most one entry per character; contexts without a printed character end here."""
    summed = counts.repartition("key").groupBy("key", "c").agg(F.sum("n").alias("n"))
    return summed.groupBy("key").agg(F.collect_list(F.struct("c", "n")).alias("seen")).filter(F.exists("seen", lambda x: x["n"] >= LEAST_PRINTED))


def learnt_confusions(contexts: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """What is printed, with weights, by what is read, as the corpus shows it: at most one entry per pair of characters.

    Only contexts on both sides teach. A character is read for another one if it is rare (RARE_SHARE) where that one rules, in enough contexts, in a large enough share of the
    contexts, and spread over them and over what stands on either side: a word that differs from another one in one letter is no confusion. The weight of a pair is its rate against that of the best pair of the character read.
    """
    top = F.array_max(F.transform("seen", lambda x: F.struct(x["n"].alias("n"), x["c"].alias("c"))))
    ruled = contexts.filter("key % 2 = 0").withColumn("top", top).filter(F.col("top.n") >= LEARNT_PRINTED)
    share = ruled.groupBy(F.col("top.c").alias("r")).agg(F.count("*").alias("contexts"), F.sum("top.n").alias("printed"))
    each = ruled.select(F.col("top.c").alias("r"), F.col("top.n").alias("m"), F.explode("seen").alias("x"), F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right")).filter((F.col("x.c") != F.col("r")) & (F.col("x.n") <= RARE_SHARE * F.col("m")) & (F.col("x.c") < _DOUBLE_CODE) & (F.col("r") < _DOUBLE_CODE))
    pairs = each.groupBy(F.col("x.c").alias("c"), "r").agg(F.count("*").alias("n"), F.sum("x.n").alias("read"), F.count_distinct("left").alias("lefts"), F.count_distinct("right").alias("rights")).filter((F.col("n") >= LEARNT_CONTEXTS) & (F.least("lefts", "rights") >= LEARNT_SIDES)).join(share, "r")
    kept = pairs.filter((F.col("n") >= LEARNT_SHARE * F.col("contexts")) & (F.col("n") >= LEARNT_SPREAD * F.least("read", "contexts")))
    out: dict[int, list[tuple[int, float]]] = {}
    for r in kept.collect():
        if not looks_alike(chr(r["c"]), chr(r["r"])):
            out.setdefault(r["c"], []).append((r["r"], r["read"] / r["printed"]))
    return {c: sorted(((r, w / max(x for _, x in rs)) for r, w in rs), key=lambda x: (-x[1], x[0])) for c, rs in out.items()}


def confusions(contexts: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """The pairs learnt and, after them, the known ones that the corpus does not show."""
    out = learnt_confusions(contexts)
    for c, rights in known_confusions().items():
        have = {r for r, _ in out.get(c, ())}
        out[c] = [*out.get(c, ()), *((r, w * (FURTHER if have else 1.0)) for r, w in rights if r not in have)]
    return out


def _judged(contexts: DataFrame, wrong: dict[int, list[tuple[int, float]]]) -> DataFrame:
    """(key, c, r): the characters c that are misread in their context, by the counts of the whole corpus, and what is printed.

    Of the characters that c is read for, the one with the best weighted distance: its count in the context times the confusion's weight.
    """
    ways = F.create_map(*[x for c, rights in wrong.items() for x in (F.lit(c), F.array(*[F.struct(F.lit(r).alias("r"), F.lit(float(w)).alias("w")) for r, w in rights]))])
    each = contexts.select("key", "seen", F.explode("seen").alias("e")).select("key", "seen", "e.*").filter(F.col("c").isin(list(wrong)))

    def total(code: Column) -> Column:
        return F.aggregate(F.filter("seen", lambda y: y["c"] == code), F.lit(0).cast("bigint"), lambda s, y: s + y["n"])

    options = F.transform(ways[F.col("c")], lambda x: F.struct((total(x["r"]) * x["w"]).alias("score"), total(x["r"]).alias("n"), x["r"].alias("r")))
    best = each.withColumn("best", F.array_max(options))
    return best.filter((F.col("best.n") >= LEAST_PRINTED) & (F.col("n") <= RARE_SHARE * F.col("best.n"))).select("key", "c", F.col("best.r").alias("r"))


def noise(texts: DataFrame, limit: int = LEXICON) -> DataFrame:
    """(tbl, rec, line, col, kind, c, r): dropped lines, cut words and misread characters (code c, printed r).

    texts: tbl (0 or 1; 2 for texts that are only counted), rec, text. Null and empty texts and rows without a number give no rows; rows read twice give theirs once.
    Copies of one text are counted once. Nothing depends on how the rows are partitioned: counts are of the whole corpus before anything is judged.
    """
    ship(texts.sparkSession)
    texts = texts.filter("tbl is not null and rec is not null and text is not null")
    own = texts.filter("tbl < 2")
    edge, words, rest = lexicon(own, limit)
    once = texts.groupBy("text").agg(F.min("tbl").alias("tbl"), F.min("rec").alias("rec")).select("tbl", "rec", "text")
    contexts = stored(_contexts(_read(_with_rest(once, rest), edge, words)))
    wrong = confusions(contexts)
    judged = stored(_judged(contexts, wrong))
    places = _read(_with_rest(own, rest), edge, words, judged, list(wrong)).join(judged, ["key", "c"], "left").filter("c < 0 or r is not null")
    kind = F.when(F.col("c") == -1, "drop").when(F.col("c") == -2, "hyphen").otherwise("misread")
    return places.select("tbl", "rec", "line", "col", kind.alias("kind"), "c", "r").distinct()


def sources(resolutions: DataFrame, page_results: DataFrame) -> DataFrame:
    """(tbl, rec, text): the scanned resolutions (0), the fresh readings (1) and, as evidence of what is printed, the other resolutions (2)."""
    tbl = F.when(F.get_json_object("metadata", "$.source_kind") == "scan", 0).otherwise(2)
    return resolutions.select(tbl.alias("tbl"), F.col("res_no").alias("rec"), F.col("raw_text").alias("text")).union(page_results.select(F.lit(1), "staging_no", "new_text")).filter("text is not null")


def found(resolutions: DataFrame, page_results: DataFrame) -> DataFrame:
    got = noise(sources(resolutions, page_results))
    return got.select(F.when(F.col("tbl") == 0, "resolutions").otherwise("page_results").alias("tbl"), F.col("rec").alias("rec_no"), F.col("line").alias("line_no"), "kind").distinct()


def paragraphs(resolutions: DataFrame, page_results: DataFrame) -> DataFrame:
    """(tbl, rec_no, paragraph_no, text): dropped lines left out, cut words joined, misread characters repaired, lines joined.

    A blank line, a # line and a table end a paragraph. Lines are joined by a space, between two
    characters of scripts without spaces by nothing.
    """
    texts = sources(resolutions, page_results).filter("tbl < 2").dropDuplicates(["tbl", "rec"])
    fixes = noise(sources(resolutions, page_results)).groupBy("tbl", "rec").agg(F.collect_list(F.struct("line", "col", "kind", "c", "r")).alias("fixes"))
    joined = texts.join(fixes, ["tbl", "rec"], "left").select("tbl", "rec", "text", "fixes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tbl, rec, text, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                lines, drop, cut = text.split("\n"), set(), set()
                for f in sorted(found or (), key=lambda f: (f["line"], -f["col"])):
                    if f["kind"] == "drop":
                        drop.add(f["line"])
                    elif f["kind"] == "hyphen":
                        cut.add(f["line"])
                    else:
                        x, n = lines[f["line"]], 1 + (f["c"] >= _DOUBLE_CODE)
                        lines[f["line"]] = x[: f["col"]] + chr(f["r"]) + x[f["col"] + n :]
                now, no, glue = "", 0, ""
                for i, x in enumerate([*lines, ""]):
                    if i in drop:
                        continue
                    x = x.strip(" ")
                    alone = x.startswith(("#", "<table"))
                    if now and (not x or alone):
                        rows.append((tbl, rec, no, now))
                        no, now = no + 1, ""
                    if alone:
                        rows.append((tbl, rec, no, x))
                        no += 1
                    elif x:
                        if now and not glue:
                            glue = "" if now[-1] > "⺀" and x[0] > "⺀" else " "
                        now = (now + (glue if glue != "cut" else "") if now else "") + (x[:-1] if i in cut else x)
                        glue = "cut" if i in cut else ""
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["tbl", "rec_no", "paragraph_no", "text"])

    out = joined.mapInArrow(run, "tbl int, rec_no bigint, paragraph_no int, text string")
    return out.withColumn("tbl", F.when(F.col("tbl") == 0, "resolutions").otherwise("page_results"))
