"""Problem 8: token ids by a public byte-level BPE vocabulary.

The text is split by the vocabulary's pattern. Each pre-token is split further between two bytes that
are side by side inside no entry of the vocabulary, where no merge can happen; the parts are called
atoms. The distinct atoms of the corpus are few, and a fold of Spark's higher-order functions merges
their bytes by a literal rank map. Documents then look their atoms up.

Texts are split and looked up a few megabytes at a time as arrays of bytes; Python sees each distinct
word of such a part once.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kosha.session import stored

#: Where the public vocabularies are.
VOCABULARIES = os.environ.get("KOSHA_TOKENIZERS", "/opt/tokenizers")
#: Atoms sent to every worker: the most frequent ones, at most so many of at most so many bytes (under 64 MB in all).
BROADCAST_ATOMS, BROADCAST_BYTES = 200_000, 64
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 400_000


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Bytes of texts that are split at a time; a longer text is split on its own.
PART = 1 << 22


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The splitting pattern's class of each code point."""
    kind = {"L": _LETTER, "N": _NUMBER}.get
    kinds = np.array([kind(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kinds


def _laid_out(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value begins in them and the last one ends."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _listed(values: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls; several times faster than the column's own list."""
    data, at = _laid_out(values)
    raw, at = data.tobytes(), at.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def _cut(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes as a binary column whose values begin at the given places, ascending from 0."""
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _split(data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of the texts that begin at these bytes, and which is the first of each text (the last entry is their number).

    The vocabulary's pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+. So a pre-token begins
    where the class changes, but white space leaves its last character, if that is U+0020, to what follows it, and else on its own.
    """
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(rows), np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    kind, n = _kinds()[code], len(code)
    edge = np.zeros(n + 3, bool)
    edge[n:] = True
    edge[np.searchsorted(byte, rows[:-1])] = True
    begin = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) + 1
    begin[after - 1] = True
    begin[after] = code[after - 1] != 0x20
    begin |= edge[:n]
    # a contraction where a run of other characters is a single apostrophe
    for i in np.flatnonzero((code == ord("'")) & begin).tolist():
        if not edge[i + 1]:
            pair = "" if edge[i + 2] else chr(code[i + 1]) + chr(code[i + 2])
            size = 3 if pair in ("re", "ve", "ll") else 2 if chr(code[i + 1]) in "stmd" else 0
            if size:
                begin[i + 1] = False
                begin[i + size : i + size + 1] = True
    at = byte[begin]
    return _cut(data, at), np.searchsorted(at, rows)


def split_texts(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """The pre-tokens of a column of texts, PART bytes at a time: first row, row after the last, their pre-tokens and which is the first of each row."""
    data, at = _laid_out(texts.fill_null("").cast(pa.string()))
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        yield i, j, *_split(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def pre_tokens() -> Callable[[str], list[str]]:
    """The same for a single text."""
    return lambda text: [w.decode() for _, _, found, _ in split_texts(pa.array([text], pa.string())) for w in _listed(found)]


@lru_cache(4)
def _neighbours(path: str) -> np.ndarray:
    """Whether two bytes, as left·2^8+right, are side by side in an entry of the vocabulary."""
    near = np.zeros(1 << 16, bool)
    near[[a << 8 | b for t in ranks(path) for a, b in zip(t, t[1:])]] = True
    return near


def atoms(words: pa.Array, near: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes of words that aren't empty, cut where no merge can cross, and which atom is the first of each word (the last entry is their number)."""
    data, at = _laid_out(words)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    begin = np.ones(len(data), bool)
    begin[1:] = ~near[data[:-1].astype(np.uint16) << 8 | data[1:]]
    begin[at[:-1]] = True
    cuts = np.flatnonzero(begin)
    return _cut(data, cuts), np.searchsorted(cuts, at)


_SLOTS, _GROUPS, _FACTOR = 1 << 17, 16381, 1103515245


@lru_cache(4)
def _rank_map(path: str) -> tuple[str, str, str]:
    """(slots, shifts, byte ids) as comma lists: a perfect hash from left·2^16+right to the merged id."""
    known = ranks(path)
    if max(known.values()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits can't be packed")
    pairs: dict[int, int] = {}
    for token, rank in known.items():
        for i in range(1, len(token)):
            if (a := known.get(token[:i])) is not None and (b := known.get(token[i:])) is not None:
                pairs[a << 16 | b] = rank
    size = _SLOTS
    while size < 2 * len(pairs):
        size *= 2
    groups: dict[int, list[int]] = {}
    for k in pairs:
        groups.setdefault(k % _GROUPS, []).append(k)
    slots, shifts = [0] * size, [0] * _GROUPS
    for g, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
        base = [(k * _FACTOR >> 13) & (size - 1) for k in keys]
        if len(set(base)) < len(base):
            raise ValueError("two pairs of one group share a slot; choose another factor")
        d = next(d for d in range(size) if not any(slots[(x + d) & (size - 1)] for x in base))
        shifts[g] = d
        for k, x in zip(keys, base):
            slots[(x + d) & (size - 1)] = k << 16 | pairs[k]
    return ",".join(map(str, slots)), ",".join(map(str, shifts)), ",".join(str(known[bytes([i])]) for i in range(256))


def _longs(text: str) -> Column:
    return F.split(F.lit(text), ",").cast("array<bigint>")


def merged(raw: Column, path: str) -> Column:
    """array<int> of the ids of a binary column: ranked merges folded over its bytes."""
    slots, shifts, single = _rank_map(path)
    table, shift, byte = _longs(slots), _longs(shifts), _longs(single)
    size = slots.count(",") + 1

    def rank(a: Column, b: Column) -> Column:
        key = a * F.lit(65536).cast("bigint") + b
        slot = (F.shiftright(key * F.lit(_FACTOR).cast("bigint"), 13) + F.get(shift, (key % _GROUPS).cast("int"))).bitwiseAND(F.lit(size - 1).cast("bigint"))
        return F.transform(F.array(F.get(table, slot.cast("int"))), lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(65535).cast("bigint"))))[0]

    def step(ids: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: F.struct(F.coalesce(rank(F.element_at(ids, i), F.element_at(ids, i + 1)), F.lit(1 << 20).cast("bigint")).alias("r"), i.alias("i")))
        best = F.transform(F.array(F.array_min(ranked)), lambda m: F.when(m["r"] == (1 << 20), ids).otherwise(F.concat(F.slice(ids, F.lit(1), m["i"] - 1), F.array(m["r"]), F.slice(ids, m["i"] + 2, F.size(ids)))))
        return F.when(F.size(ids) < 2, ids).otherwise(best[0])

    latin = F.decode(raw, "ISO-8859-1")
    start = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.get(byte, F.ascii(F.substring(latin, i, F.lit(1)))))
    return F.when(F.octet_length(raw) == 1, start).otherwise(F.aggregate(F.sequence(F.lit(2), F.octet_length(raw)), start, step)).cast("array<int>")


#: Bytes of an atom up to which its merges are folded; a fold takes time by the square of the length, a heap nearly in proportion.
FOLDED = 256


def heap_merged(raw: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of a byte string of any length: the same merges, the lowest rank first and of equal ones the leftmost, from a heap over a linked list."""
    n = len(raw)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def entry(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        rank = known.get(raw[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    heap = [e for i in range(n) if (e := entry(i))]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (e := entry(k)):
                heapq.heappush(heap, e)
    return [known[raw[i : end[i]]] for i in range(n) if alive[i]]


def _long_merged(atoms_: DataFrame, path: str) -> DataFrame:
    """(atom, n, ids) of long atoms, by the heap."""
    sent = atoms_.sparkSession.sparkContext.broadcast(ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([heap_merged(bytes(a), sent.value) for a in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["atom", "n", "ids"])

    return atoms_.select("atom", "n").mapInArrow(run, "atom binary, n bigint, ids array<int>")


def _counted(texts: DataFrame, path: str) -> DataFrame:
    """(atom, n) of all texts, pre-summed by each task. The vocabulary is read on the driver; workers get the pairs of bytes that occur in it, at most 65,536."""
    sent = texts.sparkSession.sparkContext.broadcast(_neighbours(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: dict[bytes, int]) -> pa.RecordBatch:
            parts, first = atoms(pa.array(list(words), pa.binary()), sent.value)
            n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(first))
            got = pa.table({"atom": parts, "n": n}).group_by("atom", use_threads=False).aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([got["atom"].combine_chunks(), got["n_sum"].combine_chunks()], names=["atom", "n"])

        words: dict[bytes, int] = {}
        for b in batches:
            for _, _, found, _ in split_texts(b.column(0)):
                found = found.dictionary_encode()
                counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                for w, n in zip(_listed(found.dictionary), counts.tolist()):
                    words[w] = words.get(w, 0) + n
                if len(words) > REMEMBERED:
                    yield out(words)
                    words = {}
        yield out(words)

    return texts.mapInArrow(run, "atom binary, n bigint").groupBy("atom").agg(F.sum("n").alias("n"))


def _joined(things: pa.DictionaryArray, packed: list[bytes], first: np.ndarray) -> pa.ListArray:
    """The ids of each run of words or atoms, by the packed ids of the distinct ones."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"))).take(things.indices)
    return pa.ListArray.from_arrays(each.offsets.take(pa.array(first)), each.values)


class _Words:
    """The ids of distinct words as packed int32, by their atoms' ids."""

    def __init__(self, known: dict[bytes, bytes], near: np.ndarray) -> None:
        self.known, self.near, self.kept = known, near, {}

    def __call__(self, words: pa.Array, rare: dict[bytes, bytes]) -> list[bytes]:
        """Of each word; rare has the atoms that this worker lacks. Words without such are remembered."""
        names = _listed(words)
        found = list(map(self.kept.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(self.kept) > REMEMBERED:
                self.kept.clear()
            parts, first = atoms(words.take(pa.array(new)), self.near)
            parts = parts.dictionary_encode()
            distinct = _listed(parts.dictionary)
            own = np.fromiter((a in self.known for a in distinct), bool, len(distinct))
            ids = _joined(parts, [self.known[a] if a in self.known else rare[a] for a in distinct], first)
            keep = np.logical_and.reduceat(own[parts.indices.to_numpy()], first[:-1]).tolist()
            raw, at = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            for i, a, b, k in zip(new, at, at[1:], keep):
                found[i] = raw[a:b]
                if k:
                    self.kept[names[i]] = found[i]
        return found


def _packed(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def vocabulary(df: DataFrame, text: str, path: str) -> DataFrame:
    """(atom, n, ids) of every distinct atom of the texts, stored."""
    counted = stored(_counted(df.select(F.col(text).alias("t")), path))
    short = F.octet_length("atom") <= FOLDED
    # few bytes, much work: dealt out to all cores
    folded = counted.filter(short).repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn("ids", merged(F.col("atom"), path))
    long = counted.filter(~short)
    return stored(folded if long.isEmpty() else folded.unionByName(_long_merged(long, path)))


def encode(df: DataFrame, key: str, text: str, path: str | None = None, as_counts: bool = False, limit: int = BROADCAST_ATOMS) -> DataFrame:
    """One row per input row: key and ids (array<int>), or n_tokens where as_counts.

    No special tokens; their names in a text are ordinary text. Null and empty texts give an empty
    list. The limit most frequent atoms of up to BROADCAST_BYTES bytes go to every worker, a size that
    is bounded; if the corpus has others, the documents that hold them get these by a join.
    """
    path = path or f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
    spark = df.sparkSession
    words = vocabulary(df, text, path)
    short = words.filter(F.octet_length("atom") <= BROADCAST_BYTES)
    top = short.orderBy(F.col("n").desc(), "atom").limit(limit).select("atom", "ids").toArrow()
    known = dict(zip((bytes(x) for x in top.column(0).to_pylist()), map(_packed, top.column(1).to_pylist())))
    sent = spark.sparkContext.broadcast((known, _neighbours(path)))
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema["k"].dataType.simpleString()
    whole = len(known) < limit and words.filter(F.octet_length("atom") > BROADCAST_BYTES).isEmpty()
    if not whole:

        def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, near = sent.value
            for b in batches:
                keys, lacked = [], []
                for i, _, found, first in split_texts(b.column(1)):
                    found = found.dictionary_encode()
                    parts, of = atoms(found.dictionary, near)
                    parts, of = _listed(parts), of.tolist()
                    lacks = [[a for a in parts[x:y] if a not in have] for x, y in zip(of, of[1:])]
                    word = found.indices.to_numpy()
                    at = np.flatnonzero(np.fromiter(map(bool, lacks), bool, len(lacks))[word])
                    rows = np.searchsorted(first, at, "right") - 1 + i
                    for row, atom in {(r, a) for r, w in set(zip(rows.tolist(), word[at].tolist())) for a in lacks[w]}:
                        keys.append(row)
                        lacked.append(atom)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(lacked, pa.binary())], names=["k", "atom"])

        links = docs.mapInArrow(rare, f"k {kind}, atom binary").join(words.select("atom", "ids"), "atom").groupBy("k").agg(F.collect_list(F.struct("atom", "ids")).alias("rare"))
        docs = docs.join(links, docs["k"].eqNullSafe(links["k"]), "left").select(docs["k"], "t", "rare")

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _Words(*sent.value)
        for b in batches:
            out = [pa.array([], pa.int64() if as_counts else pa.list_(pa.int32()))]
            for i, j, found, first in split_texts(b.column(1)):
                extra = b.column(2)[i:j].to_pylist() if b.num_columns > 2 else ()
                found = found.dictionary_encode()
                packed = ids_of(found.dictionary, {bytes(x["atom"]): _packed(x["ids"]) for own in extra for x in own or ()})
                if as_counts:
                    sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))[found.indices.to_numpy()]
                    out.append(pa.array(np.diff(np.append(0, np.cumsum(sizes))[first])))
                else:
                    out.append(_joined(found, packed, first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.concat_arrays(out)], names=["k", "out"])

    return docs.mapInArrow(assemble, f"k {kind}, out {'bigint' if as_counts else 'array<int>'}").select(F.col("k").alias(key), F.col("out").alias("n_tokens" if as_counts else "ids"))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: binary pieces of a literal list, concatenated."""
    path = path or f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
    known = ranks(path)
    pieces = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        pieces[rank] = token
    table = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
