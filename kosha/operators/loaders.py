"""Documents made ready for an index: tables cut or shortened, pages and bundles split, readings put in, tags and metadata added."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kosha.functions import text as tx
from kosha.session import ship

#: The heading of a mapping grid, the gap up to which tables after it belong together, what is cut where no table follows.
MAPPING, GAP, WITHOUT_TABLE = r"Curriculum\s*Mapping|SKILL\s*MAPPING|แผนที่แสดงการกระจายความรับผิดชอบ", 500, 8000
#: A table, a cell, and what a table that compares courses holds: its heading, a code and credits.
TABLE, CELL = "<table.*?</table>", "<td[^>]*>(.*?)</td>"
COURSE_TABLE, CODE, CREDITS = r"รหัส\s*/\s*หน่วยกิต|Title\s+and\s+Course\s+description|เปลี่ยนเป็น", "[0-9]{8}", r"[0-9]\s*\(\s*[0-9]+\s*-\s*[0-9]+\s*-\s*[0-9]+\s*\)"
#: Characters in a part of a page.
PAGE_CHARS = 6000
#: Fixed values of bundles: the declaration, an item's number, a header of a level, what a real item holds, a count instead of an item.
DECLARED = r"จำนวน\s*([0-9๐-๙]+)\s*หลักสูตร"
ITEM = r"(?:^|\n)[ \t]*(?:#{1,6}[ \t]*)?([๐-๙]{1,2})[.)][ \t]*\**[ \t]*(?=หลักสูตร)(?!หลักสูตร[ \t]*(?:เป็น|เน้น|ควร|ต้อง|จะ|ให้|มี|อยู่|คือ))"
LEVEL = r"(?:^|\n)[ \t]*(?:#{1,6}[ \t]*)?\**[ \t]*ระดับ(?:ปริญญาตรี|บัณฑิตศึกษา|ปริญญาโท|ปริญญาเอก|อนุปริญญา)"
REAL, LEAST_ITEM = r"(?m)โดยผ่านการพิจารณาจาก|เหตุผลการปรับปรุง|สาระในการปรับปรุง|^##\s*Page\s*\d+\s*$", 60

_FLAGS = re.I | re.S


def _mapped(df: DataFrame, key: str, columns: list[str], f: Callable, out: str) -> DataFrame:
    """key and f(*columns) of every row, by Arrow batches. out: the column's name and type."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    name = out.split(" ")[0]
    made = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    as_type = made.sparkSession.createDataFrame([], out).select(name).schema[0].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            values = [f(*row) for row in zip(*(b.column(i + 1).to_pylist() for i in range(len(columns))))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, to_arrow_type(as_type))], names=["k", name])

    return made.mapInArrow(run, f"k {kind}, {out}").withColumnRenamed("k", key)


def mapping_spans(text: str) -> list[tuple[int, int]]:
    """The grid after each mapping heading: the chain of tables that begins close behind it, else a stretch of fixed length.

    Tables closer than GAP to the one before are one chain, whose end every table in it knows.
    """
    tables = [m.span() for m in re.finditer(TABLE, text, _FLAGS)]
    chain_end: list[int] = []
    for i in reversed(range(len(tables))):
        linked = i + 1 < len(tables) and tables[i + 1][0] - tables[i][1] <= GAP
        chain_end.insert(0, chain_end[0] if linked else tables[i][1])
    starts = [a for a, _ in tables]
    spans = []
    for h in re.finditer(MAPPING, text, re.I):
        first = bisect_left(starts, h.end())
        near = first < len(starts) and starts[first] - h.end() <= GAP
        spans.append((h.start(), chain_end[first] if near else min(len(text), h.start() + WITHOUT_TABLE)))
    return spans


def without_mapping(text: str | None) -> str | None:
    """The text without its mapping grids."""
    if text is None:
        return None
    edges = [0, *(x for span in mapping_spans(text) for x in span), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def short_courses(text: str | None) -> str | None:
    """The text with each table that compares courses as lines "code title", each code once, at its first place.

    Only tables with such a heading, a code and credits; the title is the cell after the code's.
    """
    if text is None:
        return None

    def short(m: re.Match) -> str:
        t = m[0]
        if not all(re.search(p, t, re.I) for p in (COURSE_TABLE, r"\d{8}", CREDITS.replace("[0-9]", r"\d"))):
            return t
        cells = re.findall(CELL, t.translate(_DIGITS), _FLAGS)
        lines: dict[str, str] = {}
        for cell, after in zip(cells, [*cells[1:], ""]):
            if code := re.search(CODE, cell):
                lines.setdefault(code[0], re.sub(r"\s+", " ", re.sub("<[^>]*>?", " ", after)).strip(" -,:"))
        return "\n".join(f"{c} {x}" if x else c for c, x in lines.items())

    return re.sub(TABLE, short, text, flags=_FLAGS)


_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")


def load(df: DataFrame, key: str, text: str, how: str = "plain") -> DataFrame:
    """key and text as a loader gives it: plain (grids cut, course tables shortened), metadata (header cut) or normalized (all, with digits and spaces in one form). Null stays null."""
    if how == "metadata":
        return df.select(key, tx.strip_document_header(F.col(text)).alias(text))
    if how not in ("plain", "normalized"):
        raise ValueError(f"unknown loader {how}")
    bare = df if how == "plain" else df.withColumn(text, tx.strip_document_header(F.col(text)))
    out = _mapped(bare, key, [text], lambda t: short_courses(without_mapping(t)), "t string").withColumnRenamed("t", text)
    return out if how == "plain" else out.withColumn(text, tx.normalize_thai(F.col(text)))


def blank_tables(text: Column) -> Column:
    """The text with each table as as many spaces, so that places stay."""
    pattern = f"(?is){TABLE}"
    rest, tables = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.repeat(F.lit(" "), F.length(F.get(tables, i))), F.lit("")))), "")


def page_parts(text: Column, size: int = PAGE_CHARS) -> Column:
    """array<struct<label,body>>: the pages after "## Page N" lines, larger ones in parts N.1, N.2, …; a text without pages in slices chunk1, chunk2, …. Blank parts are left out."""
    slices = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(size)), lambda s: F.substring(t, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    part = lambda label, body: F.struct(label.alias("label"), body.alias("body"))
    marked = F.split(F.regexp_replace(text, r"(?m)^## Page ([0-9]+)[ \t]*$", "\u0001$1\u0002"), "\u0001")
    pages = F.transform(F.slice(marked, F.lit(2), F.size(marked)), lambda p: part(F.concat(F.lit("Page "), F.substring_index(p, "\u0002", 1)), F.btrim(F.substring_index(p, "\u0002", -1), F.lit(" \n\t\r"))))
    cut = F.flatten(F.transform(pages, lambda p: F.when(F.length(p["body"]) <= size, F.array(p)).otherwise(F.transform(slices(p["body"]), lambda c, j: part(F.concat(p["label"], F.lit("."), (j + 1).cast("string")), c)))))
    plain = F.transform(slices(text), lambda c, i: part(F.concat(F.lit("chunk"), (i + 1).cast("string")), c))
    return F.filter(F.when(F.size(marked) > 1, cut).otherwise(plain), lambda p: F.btrim(p["body"], F.lit(" \n\t\r")) != "")


def bundle(text: str | None) -> tuple[str, int, list[int], str | None]:
    """(action, items declared, where items begin, why not) of a text that may hold several curricula: split, single, none or mismatch."""
    said = re.search(DECLARED, text or "")
    if not said:
        return "none", 0, [], None
    n = int(said[1].translate(_DIGITS))
    if n < 2:
        return "single", n, [], None
    bare = re.sub(TABLE, lambda m: " " * len(m[0]), text, flags=_FLAGS)
    numbered = [(int(m[1].translate(_DIGITS)), m) for m in re.finditer(ITEM, bare)]
    held: list[re.Match] = []
    why = "no full run of numbers"
    # every number 1 begins a section; a section goes on with the one before it only below the header of a level
    for first, section in _sections(numbered):
        levels = bool(held) and re.search(LEVEL, bare[held[-1].end() : first.start()])
        held = [*held, *section] if levels else section
        if len(held) >= n:
            at = [m.start(1) for m in held[:n]]
            why = _unlike_items([text[a:b] for a, b in zip(at, [*at[1:], len(text)])])
            if why is None:
                return "split", n, at, None
            held = []
    return "mismatch", n, [], why


def _sections(numbered: list[tuple[int, re.Match]]) -> Iterator[tuple[re.Match, list[re.Match]]]:
    """(first item, items that count on from it) of each stretch from a number 1 to the next; numbers out of turn are passed over."""
    ones = [i for i, (k, _) in enumerate(numbered) if k == 1]
    for a, b in zip(ones, [*ones[1:], len(numbered)]):
        own: list[re.Match] = []
        for k, m in numbered[a:b]:
            if k == len(own) + 1:
                own.append(m)
        yield own[0], own


def _unlike_items(bodies: list[str]) -> str | None:
    """Why these parts are no curricula of a bundle; None if they are."""
    if any(re.search(DECLARED, b[:80]) for b in bodies):
        return "counts"
    if min(map(len, bodies)) < LEAST_ITEM:
        return "short"
    if not all(re.search(REAL, b) for b in bodies):
        return "names only"
    if len({b.strip() for b in bodies}) < len(bodies):
        return "repeated"
    titles = [re.split(r"\n\s*\n|(?:^|\n)\s*[๐-๙]{1,2}\.\s", re.sub(r"^[๐-๙]{1,2}[.)]\s*", "", b, count=1), maxsplit=1)[0] for b in bodies]
    return "one title" if len({re.sub(r"\s*\n\s*", " ", t).strip()[:200] for t in titles}) < len(bodies) else None


def bundles(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, action, declared, starts, reason (see bundle)."""
    out = _mapped(df, key, [text], lambda t: dict(zip(("action", "declared", "starts", "reason"), bundle(t))), "b struct<action:string,declared:int,starts:array<int>,reason:string>")
    return out.select(key, "b.*")


def with_page(text: str, page: int, body: str) -> str | None:
    """The text with another body for a page; None if the page has no header, or headers that don't stand next to each other."""
    heads = list(re.finditer(r"(?m)^## Page (\d+)[ \t]*$", text))
    own = [i for i, m in enumerate(heads) if int(m[1]) == page]
    if not own or own[-1] - own[0] + 1 != len(own):
        return None
    end = heads[own[-1] + 1].start() if own[-1] + 1 < len(heads) else len(text)
    return f"{text[: heads[own[0]].end()]}\n\n{body.strip()}\n\n{text[end:]}"


def replaced_pages(df: DataFrame, key: str, text: str, pages: str) -> DataFrame:
    """key, text, n_replaced, n_missing: the text with its pages' new bodies (pages: array of struct<page,body>, in order; null bodies are passed over)."""

    def f(t: str | None, new: list | None) -> dict:
        done = missing = 0
        for p in new or ():
            if t is not None and p["body"] is not None:
                out = with_page(t, p["page"], p["body"])
                done, missing, t = (done + 1, missing, out) if out is not None else (done, missing + 1, t)
        return {"text": t, "n_replaced": done, "n_missing": missing}

    return _mapped(df, key, [text, pages], f, "b struct<text:string,n_replaced:int,n_missing:int>").select(key, F.col("b.text").alias(text), "b.n_replaced", "b.n_missing")


def iob_spans(words: Column, tags: Column) -> Column:
    """array<struct<label,text>>: words of B-X and the I-X after it as one span; an I-X without its beginning begins one."""
    start = F.struct(F.array().cast("array<struct<label:string,text:string>>").alias("done"), F.lit(None).cast("string").alias("label"), F.lit("").alias("text"))
    close = lambda a: F.when(a["label"].isNull(), a["done"]).otherwise(F.array_append(a["done"], F.struct(a["label"].alias("label"), a["text"].alias("text"))))

    def step(a: Column, z: Column) -> Column:
        label = F.when(z["t"].rlike("^[BI]-."), F.substring(z["t"], 3, 1000))
        goes_on = F.coalesce(F.startswith(z["t"], F.lit("I-")) & (label == a["label"]), F.lit(False))
        longer = F.struct(a["done"].alias("done"), a["label"].alias("label"), F.concat(a["text"], z["w"]).alias("text"))
        return F.when(goes_on, longer).otherwise(F.struct(close(a).alias("done"), label.alias("label"), F.when(label.isNull(), "").otherwise(z["w"]).alias("text")))

    return F.aggregate(F.arrays_zip(words.alias("w"), tags.alias("t")), start, step, close)


def inherited(parent: Column, own: Column) -> Column:
    """A document's metadata with a chunk's own over it (maps of strings; null counts as empty)."""
    empty = F.create_map().cast("map<string,string>")
    p, o = F.coalesce(parent, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(p, lambda k, _: ~F.array_contains(F.map_keys(o), k)), o)
