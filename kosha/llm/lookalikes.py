"""Problem 3: one form for text that looks the same but consists of other characters.

Compatibility forms that look like the ordinary character are replaced and characters that show nothing
are deleted. Then each word with letters shared by several scripts becomes a lattice of its look-alikes,
and the path with the best score under character pairs counted in the corpus, with a price for every
change of script, is taken. The lattice doesn't depend on which look-alike was written, so equal-looking
words get equal paths.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kosha.session import stored

from .common import met

#: Letters that look alike, the Latin one first, then Greek or Cyrillic ones.
LOOKALIKES = (
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "HΗН", "IΙІӀ", "JЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "hһ", "iі", "jјϳ", "oοо", "pр", "sѕ", "vνѵ", "xх", "yу", "qԛ", "wԝ", "ëё", "ïї", "ÄӒ", "äӓ", "ÖӦ", "öӧ",
)
#: Kinds of compatibility characters that look like their plain ones.
_SAME_LOOK = ("<wide>", "<compat>", "<font>")
#: Price, in nats, of a change of script inside a word; and of a script other than Latin.
CHANGE, OTHER = 12.0, 1.0
_WORD = "A-Za-zÀ-ÖØ-öø-ʯͰ-ԯ"


@lru_cache(1)
def _plain_table() -> dict[int, str | None]:
    """Character → what it looks like; None for those that show nothing."""
    out: dict[int, str | None] = {}
    for c in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= c < 0xE000 or 0x20000 <= c < 0x2F800:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf" and c not in range(0x600, 0x606) or c in (0x034F, 0x3164, 0x115F, 0x1160, 0x17B4, 0x17B5) or 0xFE00 <= c < 0xFE10 or 0xE0100 <= c < 0xE01F0:
            out[c] = None
        elif kind == "Zs":
            out[c] = " "
        elif (d := unicodedata.decomposition(ch)).startswith(_SAME_LOOK):
            to = unicodedata.normalize("NFKC", ch)
            wide = d.startswith("<wide>")
            if c not in (0x0E33, 0x0EB3) and (not wide or to.isalnum()) and kind != "No" and " " not in to:
                out[c] = to
    out[0x2010] = out[0x2011] = "-"
    return out


_ODD = re.compile(r"[^\n -~฀-๿一-鿿぀-ヿऀ-ॿ。、「」！，？：“”—]")
_TONE_FIRST = re.compile("([่-๋])([ัิ-ู])")


def compatible(text: str) -> str:
    """Compatibility forms made plain, invisible characters deleted, accents composed, Thai signs in one order."""
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_plain_table()))
    elif not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "ํา" in text:
        text = text.replace("ํา", "ำ")
    if "เเ" in text:
        text = text.replace("เเ", "แ")
    return _TONE_FIRST.sub(r"\2\1", text) if not text.isascii() else text


def script(c: str) -> str:
    return "c" if "Ѐ" <= c <= "ԯ" else "g" if "Ͱ" <= c <= "Ͽ" else "l"


@lru_cache(1)
def _classes() -> dict[str, str]:
    return {c: group for group in LOOKALIKES for c in group}


@lru_cache(1)
def _shared() -> re.Pattern:
    """Words that need a lattice: with a Greek or Cyrillic letter, or only of letters that have look-alikes."""
    latin = "".join(sorted(g[0] for g in LOOKALIKES))
    return re.compile(f"(?<![{_WORD}])[{latin}]+(?![{_WORD}])|[A-Za-zÀ-ÖØ-öø-ʯ]*[Ͱ-ԯ][{_WORD}]*")


class Model:
    """Log scores of neighbouring letters, by script."""

    def __init__(self, pairs: dict[str, int]) -> None:
        self.pairs = pairs
        self.first: Counter = Counter()
        for p, n in pairs.items():
            self.first[p[0]] += n
        self.total = sum(self.first.values())
        self.memo: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        if a != "^" and script(a) != script(b):
            return -CHANGE - OTHER * (script(b) != "l")
        # pairs are weighed by the script's own share, so a rare script doesn't win by a few odd words
        return math.log((self.pairs.get(a + b, 0) + 0.1) / (self.first[a] + 20)) - OTHER * (script(b) != "l") + 0.3 * math.log((self.first[b] + 1) / (self.total + 1))

    def best(self, word: str) -> str:
        """The look-alike path through the word with the best score; ties go to the earlier in LOOKALIKES."""
        found = self.memo.get(word)
        if found is None:
            classes = _classes()
            paths = {"^": (0.0, "")}
            for c in word:
                nxt: dict[str, tuple[float, str]] = {}
                for x in classes.get(c, c):
                    nxt[x] = max(((s + self.step(a, x), p + x) for a, (s, p) in paths.items()), key=lambda y: y[0])
                paths = nxt
            found = max(paths.values(), key=lambda y: y[0])[1]
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def form(self, text: str) -> str:
        return _shared().sub(lambda m: self.best(m[0]), compatible(text))


def letter_pairs(df: DataFrame, texts: list[str]) -> dict[str, int]:
    """Counts of neighbouring letters (^ before a word) over all texts; at most one per pair of letters of three alphabets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{_WORD}]+").findall
        words: Counter = Counter()
        pairs: Counter = Counter()

        def empty() -> None:
            for w, n in words.items():
                # words of mixed scripts are what is to be repaired
                if len({script(c) for c in w}) == 1:
                    for a, b in zip("^" + w, w):
                        pairs[a + b] += n
            words.clear()

        for b in batches:
            for col in b.columns:
                for t in col.to_pylist():
                    if t:
                        words.update(find(t))
            if len(words) > 200_000:
                empty()
        empty()
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

    got = df.select(*texts).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in got.collect()}


def forms(df: DataFrame, key: str, texts: list[str], digest: bool = False) -> DataFrame:
    """One row per row and text column that isn't null: key, field, form; where digest, form and raw as 16-byte hashes.

    Letter case, digits of other scripts, raised or circled digits and the number of spaces and line
    breaks stay as they are. An empty text has the empty form.
    """
    model_pairs = letter_pairs(df, texts)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_pairs)
        for b in batches:
            for i, name in enumerate(texts, 1):
                col = b.column(i)
                keep = col.is_valid()
                raw = col.filter(keep).to_pylist()
                form = [model.form(t) for t in raw]
                keys = b.column(0).filter(keep)
                field = pa.array([name] * len(raw), pa.string())
                if digest:
                    h = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    yield pa.RecordBatch.from_arrays([keys, field, pa.array(map(h, form), pa.binary()), pa.array(map(h, raw), pa.binary())], names=["k", "field", "form", "raw"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, field, pa.array(form, pa.string())], names=["k", "field", "form"])

    schema = f"k {kind}, field string, form {'binary, raw binary' if digest else 'string'}"
    return df.select(F.col(key).alias("k"), *texts).mapInArrow(run, schema).withColumnRenamed("k", key)


#: Variants of one form, and rows of one variant, that are joined in one part.
BLOCK, MEMBERS = 256, 1000


def found(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Pairs of rows whose text has one form but differs: key_a < key_b, field.

    Equal texts are one variant. The variants of a form are paired, then their rows listed, both in parts of bounded size, so that
    neither a form of many variants nor a variant of many rows is one task. classes() gives the same without listing pairs.
    """
    rows = stored(forms(df, key, texts, digest=True))
    variants = rows.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    links = met(variants.select("field", "form", "raw"), ["field", "form"], "raw", BLOCK)
    size = variants.groupBy("field", "raw").agg(F.ceil(F.sum("n") / MEMBERS).cast("int").alias("parts"))
    held = rows.select("field", "raw", key).join(size, ["field", "raw"]).select("field", "raw", key, F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"))
    part = lambda side: links_parts(side, size)
    each = part("b")(part("a")(links.select("field", F.col("a").alias("raw_a"), F.col("b").alias("raw_b"))))
    a = held.select("field", F.col("raw").alias("raw_a"), F.col("part").alias("part_a"), F.col(key).alias("x"))
    b = held.select("field", F.col("raw").alias("raw_b"), F.col("part").alias("part_b"), F.col(key).alias("y"))
    return each.join(a, ["field", "raw_a", "part_a"]).join(b, ["field", "raw_b", "part_b"]).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "field").distinct()


def links_parts(side: str, size: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Each link once for every part of the rows of its variant on one side."""
    own = size.select("field", F.col("raw").alias(f"raw_{side}"), "parts")
    return lambda links: links.join(own, ["field", f"raw_{side}"]).withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def classes(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """One row per row and field that isn't null: key, field, group_id (the least key whose text has the same form), n_variants (different strings of the form)."""
    rows = stored(forms(df, key, texts, digest=True))
    per = rows.groupBy("field", "form", "raw").agg(F.min(key).alias("least")).groupBy("field", "form").agg(F.min("least").alias("group_id"), F.count("*").alias("n_variants"))
    return rows.join(per, ["field", "form"]).select(key, "field", "group_id", "n_variants")
