"""Names of dictionaries in texts: people, programmes, courses and faculties, and the route a query takes by them.

Reference lists (faculties, programmes) are hand-made and small; dictionaries that grow with the corpus (people,
course names) go out in blocks of NAMES. Each text is read once, by one automaton or one scan for the lists' prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kosha.session import ship

#: Names in one automaton.
NAMES = 200_000
#: Least likeness of a name and its place in the text, characters a place is longer than the name, and at most.
LIKE, SLACK, SPAN = 0.82, 4, 120
#: Least likeness of two degree names, and share of the shorter field that two fields must have in one piece.
HEAD_LIKE, FIELD_SHARE = 0.9, 0.8
#: Degree levels, the longer first; the marks before a field and before a degree.
DEGREES, FIELD_MARK, HEAD_MARK = ("ดุษฎีบัณฑิต", "มหาบัณฑิต", "อนุปริญญา", "บัณฑิต"), "สาขาวิชา", "หลักสูตร"
#: Academic titles, the longer first; parts of names; what stands between given name and surname; words that are no given names.
TITLE = r"(?:ผู้ช่วยศาสตราจารย์|รองศาสตราจารย์|ศาสตราจารย์)\s*ดร\.|(?:ผศ\.|รศ\.|ศ\.)ดร\.|ผู้ช่วยศาสตราจารย์|รองศาสตราจารย์|ศาสตราจารย์|ผศ\.|รศ\.|ศ\.|ดร\.|อ\."
LETTER = "[ก-ฮะ-ฺเ-๎]"
NAME = LETTER + "{2,18}"
BETWEEN = r"(?:\s+|<br\s*/?>\s*)"
NO_NAMES = ("นั้น", "นี้", "ที่", "จะ", "ได้", "เป็น", "ว่า", "ซึ่ง", "อัน", "ให้", "แต่", "ผู้สอน", "ผู้รับ")
RANKS = (("ผู้ช่วยศาสตราจารย์", "ผศ."), ("รองศาสตราจารย์", "รศ."), ("ศาสตราจารย์", "ศ."))
TITLED = f"({TITLE})({NAME}){BETWEEN}({NAME})"
#: A surname alone in the next cell of a table, of at least six characters.
IN_CELLS = rf"<td[^>]*>({TITLE})({NAME})</td>\s*<td[^>]*>\s*({LETTER}{{6,18}})\s*</td>"
#: Fixed value: the mark of an affiliation, the characters after it that hold the faculty and those before it that hold the person.
AFFILIATION, FACULTY_REACH, PERSON_REACH = "สังกัด", 60, 120


def people(text: Column) -> Column:
    """Distinct, sorted array<struct<title,given,surname>> of the people with an academic title, ranks in their short form; null for a null text."""
    both = F.lit(None)
    for i, pattern in enumerate((TITLED, IN_CELLS)):
        part = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
        found = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("t", "g", "s"))]), lambda z: F.struct(short_title(z["t"]).alias("title"), z["g"].alias("given"), z["s"].alias("surname")))
        both = found if i == 0 else F.concat(both, found)
    return F.array_sort(F.array_distinct(F.filter(both, lambda p: ~p["given"].isin(*NO_NAMES))))


def short_title(title: Column) -> Column:
    """The short form of a rank, with ดร. after it where it was."""
    rank = F.trim(F.replace(title, F.lit("ดร."), F.lit("")))
    short = F.coalesce(*[F.when(rank == long, F.lit(x)) for long, x in RANKS], rank)
    return F.concat(short, F.when(F.contains(title, F.lit("ดร.")), "ดร.").otherwise(""))


def close_titles(query: Column) -> Column:
    """A query with no space between a title and the name after it."""
    return F.regexp_replace(query, r"(ผู้ช่วยศาสตราจารย์|รองศาสตราจารย์|ศาสตราจารย์|ผศ\.|รศ\.|ศ\.|ดร\.)\s+(?=[ก-ฮ])", "$1")


def people_at(text: str) -> list[tuple[int, int, str]]:
    """(start, end, full name) of every person with a title, in order of place."""
    found = []
    for pattern in _patterns():
        for m in pattern.finditer(text):
            if m[2] not in NO_NAMES:
                rank = m[1].replace("ดร.", "").strip()
                found.append((m.start(), m.end(), f"{dict(RANKS).get(rank, rank)}{'ดร.' * ('ดร.' in m[1])}{m[2]} {m[3]}"))
    return sorted(found)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    return re.compile(TITLED), re.compile(IN_CELLS)


def like(a: str, b: str, least: float) -> float:
    """The likeness of two strings, 0.0 where it stays under least; the cheap upper bounds come first."""
    m = SequenceMatcher(None, a, b)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return 0.0
    got = m.ratio()
    return got if got >= least else 0.0


@dataclass(frozen=True)
class Entry:
    """A name to look for and the canonical one it stands for; field and level only for programmes."""

    name: str
    canonical: str


class Scan:
    """The entries by prefix, and the places in a text where one may begin."""

    def __init__(self, entries: Iterable[tuple[str, Entry]]) -> None:
        self.by_prefix: dict[str, list[Entry]] = {}
        for prefix, e in entries:
            self.by_prefix.setdefault(prefix, []).append(e)
        self.pattern = re.compile("(?<!มหา)(?:" + "|".join(map(re.escape, self.by_prefix)) + ")") if self.by_prefix else None
        self.reach = max((len(e.name) for es in self.by_prefix.values() for e in es), default=0) + SLACK
        self.found = lru_cache(100_000)(self.at)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "found"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.found = lru_cache(100_000)(self.at)

    def names(self, text: str) -> list[str]:
        """The canonical names in a text, distinct and sorted."""
        if not self.pattern:
            return []
        got = {self.found(m[0], text[m.start() : m.start() + self.reach]) for m in self.pattern.finditer(text)}
        return sorted(got - {None})

    def at(self, prefix: str, here: str) -> str | None:
        raise NotImplementedError


class Faculties(Scan):
    """The first entry of the prefix that is like enough to the text at the place."""

    def at(self, prefix: str, here: str) -> str | None:
        return next((e.canonical for e in self.by_prefix[prefix] if like(e.name, here[: len(e.name) + SLACK], LIKE)), None)


def level(text: str) -> str | None:
    """The degree level a text names; None where it names none, which is no mismatch."""
    flat = _bare(text)
    return next((d for d in DEGREES if d in flat), None)


def field(text: str) -> str | None:
    """What follows the mark of a field, without white space; None without the mark."""
    _, mark, rest = text.partition(FIELD_MARK)
    return _bare(rest) if mark else None


def head(text: str) -> str | None:
    """The degree's name: from the last mark of a programme up to the end of its level; None without a level."""
    before = re.sub("[^ก-๎]+", "", text.partition(FIELD_MARK)[0]).rpartition(HEAD_MARK)[2]
    d = next((d for d in DEGREES if d in before), None)
    return d and before[: before.index(d) + len(d)]


def _bare(text: str) -> str:
    return re.sub(r"(?:<br\s*/?>|\s|​)+", "", text)


def same_field(a: str, b: str) -> bool:
    """Whether both name a field and the fields are alike."""
    x, y = field(a), field(b)
    return x is not None and y is not None and SequenceMatcher(None, x, y).ratio() >= LIKE


def contradicts(canonical: str, span: str) -> str | None:
    """What of a programme the text contradicts: level, head or field; None where nothing speaks against it. Only what both sides name can be contradicted."""
    a, b = level(canonical), level(span)
    return "level" if a and b and a != b else other_programme(canonical, span)


def other_programme(canonical: str, span: str) -> str | None:
    """head or field, where the text names another one, whatever the level."""
    a, b = head(canonical), head(span)
    if a and b and SequenceMatcher(None, a, b).ratio() < HEAD_LIKE:
        return "head"
    a, b = field(canonical), field(span)
    if a and b:
        m = SequenceMatcher(None, a, b)
        if m.find_longest_match(0, len(a), 0, len(b)).size < FIELD_SHARE * min(len(a), len(b)) and m.ratio() < LIKE:
            return "field"
    return None


class Programs(Scan):
    """The entry most like the text at the place, unless the text contradicts it; then the best one it does not contradict and whose field it names."""

    def __init__(self, entries: Iterable[tuple[str, Entry]]) -> None:
        super().__init__(entries)
        self.reach = min(self.reach, SPAN)

    def judged(self, prefix: str, here: str) -> tuple[str | None, str | None, float, str | None]:
        """(name taken, name most alike, its likeness, what the text contradicts of it)."""
        spans = [(e.canonical, here[: min(len(e.canonical) + SLACK, SPAN)].strip()) for e in self.by_prefix[prefix]]
        scored = [(r, c, s) for c, s in spans if (r := like(c, s, LIKE))]
        if not scored:
            return None, None, 0.0, None
        ratio, first, span = max(scored, key=lambda x: x[0])
        why = contradicts(first, span)
        if why is None:
            return first, first, ratio, None
        wanted = level(span)
        for _, c, s in sorted(scored, reverse=True):
            right_level = level(c) == wanted if why == "level" else (wanted is None or level(c) in (None, wanted)) and other_programme(c, s) is None
            if right_level and same_field(c, s):
                return c, first, ratio, why
        return None, first, ratio, why

    def at(self, prefix: str, here: str) -> str | None:
        return self.judged(prefix, here)[0]


def entries(df: DataFrame, aliases: str | None = None) -> list[tuple[str, Entry]]:
    """(prefix, entry) of a reference list, a table of fixed size: each canonical name and, where given, its aliases."""
    rows = df.select("prefix_type", "canonical", *([aliases] if aliases else [])).orderBy(df.columns[0]).collect()
    return [(r[0], Entry(n, r[1])) for r in rows if r[0] and r[1] for n in [r[1], *((r[2] or ()) if aliases else ())] if n]


def tags(df: DataFrame, key: str, text: str, scans: dict[str, Scan]) -> DataFrame:
    """key and, for each scan, the canonical names in the text; null and empty texts have none."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s.names(t or "") for t in texts], pa.list_(pa.string())) for s in scans.values())], names=["k", *scans])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} array<string>" for n in scans)).withColumnRenamed("k", key)


def matches(df: DataFrame, key: str, text: str, programs: Programs) -> DataFrame:
    """key, at, taken, alike, likeness, contradicted: every place where a programme may be named, with how it was judged."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for m in programs.pattern.finditer(t or "") if programs.pattern else ():
                    taken, alike, ratio, why = programs.judged(m[0], t[m.start() : m.start() + programs.reach])
                    rows.append((k, m.start(), taken, alike, round(ratio, 6), why))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "at", "taken", "alike", "likeness", "contradicted"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, at bigint, taken string, alike string, likeness double, contradicted string").withColumnRenamed("k", key)


def nearest(values: DataFrame, value: str, names: list[tuple[int, str]], least: float = LIKE) -> DataFrame:
    """value, ref_id, ratio: the name most like each value, from the least likeness on, the least id on ties. names: (id, name) of a list of fixed size; each value is read once."""
    ship(values.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                best = max(((like(v, n, least), -i) for i, n in names), default=(0.0, 0)) if v else (0.0, 0)
                if best[0]:
                    rows.append((v, -best[1], round(best[0], 6)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int32(), pa.float64()))], names=["v", "ref_id", "ratio"])

    return values.select(F.col(value).alias("v")).mapInArrow(run, "v string, ref_id int, ratio double").withColumnRenamed("v", value)


def affiliations(df: DataFrame, key: str, text: str, faculties: Faculties) -> DataFrame:
    """key, person, faculty: the person named last before the mark of an affiliation, within reach, and the one faculty named right after it.

    A mark whose reach names no faculty or several says nothing; one without a person near before has a null person.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = [m.start() for m in re.finditer(AFFILIATION, t or "")]
                named = people_at(t) if places else []
                for at in places:
                    after = t[at + len(AFFILIATION) : at + len(AFFILIATION) + FACULTY_REACH]
                    own = faculties.names(after) if re.match(r"[\s:：.\-—_|]*(?:คณะ|วิทยาลัย|สถาบัน|วิทยาเขต)", after) else []
                    if len(own) == 1:
                        last = max((p for p in named if p[1] <= at), default=None, key=lambda p: p[0])
                        rows.append((k, last[2] if last and at - last[1] <= PERSON_REACH else None, own[0]))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.string(), pa.string()))], names=["k", "person", "faculty"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, person string, faculty string").withColumnRenamed("k", key)


_LATIN = re.compile("[A-Za-z0-9]")


def mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str, flat: bool = True, alone: bool = True) -> DataFrame:
    """key, name: the names that stand in each text, each once, by one automaton over all names of a block.

    flat: case and runs of white space don't count; alone: no Latin letter or digit may stand beside the name. Blank names stand nowhere.
    Names are read in blocks of NAMES, texts once for each block.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[key].dataType.simpleString()
    each = names.select(F.col(name).alias("n")).filter(F.trim("n") != "").distinct()
    total = each.count()
    blocks = max(1, -(-total // NAMES))
    form: Callable[[str], str] = (lambda t: re.sub(r"\s+", " ", t).strip().lower()) if flat else (lambda t: t)
    out = None
    for block in range(blocks):
        own = each.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block) if blocks > 1 else each
        sent = spark.sparkContext.broadcast([r[0] for r in own.toLocalIterator()])

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for n in sent.value:
                if f := form(n):
                    auto.add_word(f, (len(f), [*(auto.get(f, (0, []))[1]), n]))
            auto.make_automaton()
            for b in batches:
                keys, found = [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    hay = form(t or "")
                    got: set[str] = set()
                    for end, (size, own) in auto.iter(hay) if len(auto) else ():
                        if not alone or not (end - size >= 0 and _LATIN.match(hay[end - size]) or end + 1 < len(hay) and _LATIN.match(hay[end + 1])):
                            got.update(own)
                    keys += [k] * len(got)
                    found += sorted(got)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(found, pa.string())], names=["k", "name"])

        part = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInArrow(run, f"k {kind}, name string")
        out = part if out is None else out.union(part)
    return out.select(F.col("k").alias(key), F.col("name").alias(name))


def widest(found: DataFrame, key: str, name: str) -> DataFrame:
    """The names found in a text without those that are part of a longer one found there."""
    longer = found.groupBy(key).agg(F.collect_set(name).alias("all"))
    inside = F.exists("all", lambda o: (o != F.col(name)) & F.contains(o, F.col(name)))
    return found.join(longer, key).filter(~inside).drop("all")


def renamed(programs: DataFrame) -> DataFrame:
    """(a, b), a < b: programme ids of one programme under two names: one field, and one associate degree's name begins the other's."""
    p = programs.select("program_id", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("degree", F.lit("")).alias("degree")).filter(F.contains("degree", F.lit("อนุปริญญา")))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, F.col("a.field") == F.col("b.field")).filter("a.program_id < b.program_id and a.degree <> b.degree")
    return both.filter(F.startswith("a.degree", F.col("b.degree")) | F.startswith("b.degree", F.col("a.degree"))).select(F.col("a.program_id").alias("a"), F.col("b.program_id").alias("b"))


def detected(queries: DataFrame, key: str, text: str, lists: dict[str, DataFrame]) -> DataFrame:
    """key, people, programs, courses, faculties, fields: what each query names. lists: programs, faculties, people (name), courses (code, name).

    People with a title, else those of the dictionary; courses by code or by name; fields of programmes as the canonical names that have
    the field, only where nothing else was found.
    """
    from kosha.operators.entities import course_codes

    q = queries.select(key, F.col(text).alias("_t"))
    scans = {"programs": Programs(entries(lists["programs"])), "faculties": Faculties(entries(lists["faculties"], "aliases"))}
    out = tags(q, key, "_t", scans).join(q, key)
    titled = F.array_distinct(F.transform(people(close_titles(F.col("_t"))), lambda p: F.concat_ws(" ", p["given"], p["surname"])))
    out = out.withColumn("titled", titled).withColumn("codes", course_codes(F.col("_t")))
    known = mentions(q, key, "_t", lists["people"], "name", flat=False, alone=False).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("known"))
    by_name = mentions(q, key, "_t", lists["courses"], "name").join(lists["courses"].select("name", "code"), "name").groupBy(key).agg(F.collect_set("code").alias("named"))
    fields = widest(mentions(q, key, "_t", lists["programs"].filter(F.col("field").isNotNull()), "field"), key, "field").join(lists["programs"].select("field", "canonical"), "field").groupBy(key).agg(F.array_sort(F.collect_set("canonical")).alias("by_field"))
    none = F.array().cast("array<string>")
    out = out.join(known, key, "left").join(by_name, key, "left").join(fields, key, "left")
    out = out.withColumn("people", F.when(F.size("titled") > 0, F.array_sort("titled")).otherwise(F.coalesce("known", none))).withColumn("courses", F.array_sort(F.array_union("codes", F.coalesce("named", none))))
    empty = (F.size("people") <= 0) & (F.size("programs") == 0) & (F.size("courses") <= 0) & (F.size("faculties") == 0)
    return out.select(key, "people", "programs", "courses", "faculties", F.when(empty, F.coalesce("by_field", none)).otherwise(none).alias("fields"), (F.size("titled") > 0).alias("has_title"), F.contains("_t", F.lit(FIELD_MARK)).alias("has_mark"))


def route() -> Column:
    """The route of a row of detected(): person, course, program (by name or mark), faculty, program (by field), unmatched."""
    return F.when(F.col("has_title"), "person").when(F.size("courses") > 0, "course").when((F.size("programs") > 0) | F.col("has_mark"), "program").when(F.size("faculties") > 0, "faculty").when(F.size("fields") > 0, "program").otherwise("unmatched")
