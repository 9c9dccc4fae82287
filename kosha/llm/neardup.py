"""Problem 4: near-duplicate texts with small edits, across the whole collection.

1. Equal texts (without white space) become one class; its first row stands for it.
2. Candidates: every text gives BANDS keys, each of the least values of ROWS random orders of all its
   distinct character runs. Texts with a key in common are candidates, each with all others of the key, unless
   one bit of each least value tells that they are far apart; a pair of the similarity has no key in common with a chance of 4 in
   10,000, a pair of 0.7 with one of 10^-7. With exact=True the
   candidates are instead those of a prefix join: all runs in one order by their count in the collection, rarest first, and the
   shortest prefix of each text that can't miss a partner. That misses nothing, but its blocks grow with the
   square of the collection where texts are made from templates.
3. Candidates are gathered into blocks of relatives, so that every pair of candidates has a block in common. The run
   sets of a block, in one order (the runs of most members first), are stored in a prefix tree. One walk through the
   tree counts the overlaps of each path with all members at once: what texts have in common is counted once for all of them. A
   subtree is left for those members that can't reach the similarity with what remains of it. The overlaps are of
   the full sets, so the result of a block is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.operators.quality import components
from kosha.session import ship, stored

from .common import bare, dealt, distinct, met, mix, window_hashes

#: Characters in a run and the least share of common runs.
RUN, SIMILARITY = 10, 0.6
#: Random orders in a band, and bands.
ROWS, BANDS = 5, 96
#: Of the ROWS * BANDS least values one bit each is kept; a pair of the similarity differs in a fifth of the bits on average, and in more than so many with a chance of 3 in 100,000.
DIFFER = 132
#: Members and characters in one part of a block; more are dealt out in parts, of which each two meet.
BLOCK, BLOCK_CHARS = 256, 1_000_000
#: Members up to which all pairs of a class of equal texts are listed; larger classes are linked to their first member.
LISTED = 64


def runs(text: str, n: int = RUN) -> np.ndarray:
    """Sorted hashes of the distinct runs of n characters without U+0020 and U+000A."""
    return distinct(window_hashes(bare(text), n))


class Tree:
    """A prefix tree over run sets that are joined with themselves.

    Runs are columns, in one order for all sets: those of most sets first, then by value. Runs of one set only can't be
    shared and count for its length alone.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, column, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -n))
        place = np.empty(len(values), np.int64)
        place[order] = np.arange(len(values))
        self.has = np.zeros((len(sets), int((n > 1).sum())), bool)
        row, at = np.repeat(np.arange(len(sets)), self.sizes), place[column]
        kept = at < self.has.shape[1]
        self.has[row[kept], at[kept]] = True
        #: columns still to come, by set and column
        self.left = self.has.sum(1)

    def similar(self, similarity: float) -> Iterator[tuple[int, int, int]]:
        """(i, j, runs in both) of all i < j with at least the similarity."""
        m, width = self.has.shape
        sizes = self.sizes
        # a node: the sets whose paths run together so far, the column reached, the members still in question with their overlaps with the path and what is left of them
        todo = [(np.arange(m), 0, np.arange(m), np.zeros(m, np.int64), self.left)]
        while todo:
            own, depth, others, both, left = todo.pop()
            # the edge: columns until the sets of the node differ
            part = self.has[own, depth:]
            differ = np.flatnonzero((part != part[0]).any(0)) if len(own) > 1 else ()
            end = depth + int(differ[0]) if len(differ) else width
            edge = depth + np.flatnonzero(part[0, : end - depth])
            if len(edge):
                both = both + self.has[np.ix_(others, edge)].sum(1)
            if end > depth:
                left = left - self.has[others, depth:end].sum(1)
            if end == width:  # the sets end here, equal in all columns that can be shared
                for i in own.tolist():
                    hit = others[(others > i) & (both >= similarity * (sizes[others] + sizes[i] - both))]
                    for j, n in zip(hit.tolist(), both[np.isin(others, hit)].tolist()):
                        yield i, j, n
                continue
            # the overlap that can still come is bounded by what is left of the subtree and of each member
            most = self.has[own, end:].sum(1).max()
            best = both + np.minimum(left, most)
            near = (others > own[0]) & (best >= similarity * (sizes[others] + np.maximum(sizes[own].min(), best) - best))
            if near.any():
                one = self.has[own, end]
                for side in (own[one], own[~one]):
                    todo.append((side, end, others[near], both[near], left[near]))


def band_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of a set of hashes, and a bit of each least value, packed into 64-bit words.

    A random order is cut into BANDS ranges, whose least values are those of as many orders; an empty range takes the next one's.
    """
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = np.zeros(-(-ROWS * BANDS // 64) * 64, np.uint8)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS)
    for i, salt in enumerate(_SALTS):
        v = np.sort(mix(own ^ salt))
        at = np.searchsorted(v, starts)
        at[at == len(v)] = 0
        keys = mix(keys * np.uint64(31) + v[at])
        bits[i * BANDS : (i + 1) * BANDS] = v[at] & np.uint64(1)
    return keys, np.packbits(bits).view(np.uint64)


_SALTS = np.random.default_rng(11).integers(1, 1 << 63, ROWS, dtype=np.uint64)


def _read(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, class, n_chars, keys, bits) of every row: the 16-byte hash and length of its text without white space (null counts as empty), its band keys and bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sizes, keys, bits = [], [], [], []
            for t in b.column(1).to_pylist():
                values = bare(t or "")
                hashes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sizes.append(len(values))
                k, w = band_keys(distinct(window_hashes(values, RUN)))
                keys.append(k)
                bits.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(bits)], names=["k", "class", "n_chars", "keys", "bits"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, class binary, n_chars bigint, keys array<bigint>, bits array<bigint>")


def _lists(words: list[np.ndarray]) -> pa.Array:
    counts = np.cumsum([0, *map(len, words)])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.concatenate(words).view(np.int64) if words else np.zeros(0, np.int64)))


def _near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs that differ in at most DIFFER bits. bits: rep, bits."""
    both = pairs.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return both.filter(differ <= DIFFER).select("a", "b")


def _prefixes(df: DataFrame, key: str, text: str, reps: DataFrame, similarity: float) -> DataFrame:
    """(key, rep): the runs of each text's shortest prefix that can't miss a partner, in the order of their counts over the collection."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                own = runs(t or "")
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(own), b.column(0).type), pa.array(own.view(np.int64)), pa.array([len(own)] * len(own), pa.int64())], names=["rep", "key", "size"])

    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).dropDuplicates(["k"]).join(reps.select("k", "no"), "k").select("no", "t")
    each = stored(texts.mapInArrow(run, "rep bigint, key bigint, size bigint"))
    ranked = each.join(each.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("n", "key")))
    return ranked.filter(F.col("r") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1).select("key", "rep")


def _blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(h, i, j, rep, part): blocks in which every pair of candidates meets, in parts of bounded size. sizes: rep, n_chars.

    A text's root is the least of itself and its partners. A pair meets in the block of the greater of its two roots: a family in
    which all know each other is one block, whatever its number of pairs.
    """
    both = pairs.union(pairs.select("b", "a"))
    roots = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")))
    at = pairs.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").select(F.greatest("ra", "rb").alias("h"), "a", "b")
    members = stored(at.select("h", F.explode(F.array("a", "b")).alias("rep")).distinct().join(sizes, "rep"))
    size = members.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_chars") / BLOCK_CHARS)).cast("int").alias("parts"))
    return dealt(members.join(size, "h").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")), ["h", "rep", "part"])


def _matched(blocks: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the similar pairs of each block, by its prefix tree. texts: rep, t."""
    held = blocks.join(texts, "rep").groupBy("h", "i", "j").agg(F.collect_list(F.struct("rep", "part", "t")).alias("members"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            for i, j, members in zip(*(batch.column(c).to_pylist() for c in range(3))):
                sets = [runs(x["t"] or "") for x in members]
                for x, y, n in Tree(sets).similar(similarity):
                    if i == j or members[x]["part"] != members[y]["part"]:
                        a.append(members[x]["rep"])
                        b.append(members[y]["rep"])
                        s.append(n / (len(sets[x]) + len(sets[y]) - n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return held.select("i", "j", "members").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members: rep, key, n_chars of every row; links: a, b, similarity between representatives, a < b).

    key identifies a text; a row given twice counts once for the links. Rows whose texts are equal without white space have
    the same representative, the least key; null counts as empty. Texts with fewer characters than a run have no runs and no links.
    The bands are made for a similarity of at least SIMILARITY; for less take exact.
    """
    ship(df.sparkSession)
    # numbers for the rows, fixed by being stored
    own = stored(_read(df, key, text).withColumn("no", F.monotonically_increasing_id()))
    reps = stored(own.groupBy("class").agg(F.min(F.struct("k", "no", "n_chars")).alias("r")).select("class", "r.*"))
    members = own.select("k", "class", "n_chars").join(reps.select("class", F.col("k").alias("rep")), "class").select("rep", F.col("k").alias(key), "n_chars")
    banded = _prefixes(df, key, text, reps, similarity) if exact else own.join(reps.select("no"), "no", "left_semi").select(F.explode("keys").alias("key"), F.col("no").alias("rep"))
    both = met(banded, ["key"], "rep", BLOCK).select("a", "b").distinct()
    pairs = stored(both if exact else _near(both, own.select(F.col("no").alias("rep"), "bits")))
    blocks = stored(_blocks(pairs, reps.select(F.col("no").alias("rep"), "n_chars")))
    needed = reps.join(blocks.select(F.col("rep").alias("no")).distinct(), "no", "left_semi").select("k", "no")
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(needed, "k").dropDuplicates(["no"]).select(F.col("no").alias("rep"), "t")
    found = _matched(blocks, texts, similarity)
    names = reps.select("no", "k")
    named = found.join(names.toDF("a", "ka"), "a").join(names.toDF("b", "kb"), "b")
    return members, named.groupBy(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).agg(F.max("similarity").alias("similarity"))


def found(df: DataFrame, key: str, text: str, exact: bool = False) -> DataFrame:
    """key_a < key_b of all pairs of similar rows; classes of equal texts of more than LISTED rows only with their first row, as links() and members() give all.

    Copies of one text are not expanded beyond that; no link between different texts is left out.
    """
    members, links = near_duplicates(df, key, text, exact=exact)
    wide = members.filter(F.col("n_chars") >= RUN).groupBy("rep").agg(F.count_distinct(key).alias("n"))
    small = members.select("rep", key).distinct().join(wide.filter(F.col("n") > 1), "rep")
    listed = small.filter(F.col("n") <= LISTED)
    within = listed.alias("a").join(listed.alias("b"), "rep").filter(F.col(f"a.{key}") < F.col(f"b.{key}")).select(F.col(f"a.{key}").alias("x"), F.col(f"b.{key}").alias("y"))
    star = small.filter((F.col("n") > LISTED) & (F.col(key) != F.col("rep"))).select(F.col("rep").alias("x"), F.col(key).alias("y"))
    # between classes: all members of either for small ones, else the representative
    ends = members.select("rep", key).distinct().join(wide, "rep").filter((F.col("n") <= LISTED) | (F.col(key) == F.col("rep"))).select("rep", F.col(key).alias("k"))
    across = links.join(ends.select(F.col("rep").alias("a"), F.col("k").alias("x")), "a").join(ends.select(F.col("rep").alias("b"), F.col("k").alias("y")), "b").select("x", "y")
    every = within.union(star).union(across)
    return every.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """rep_a < rep_b, similarity: the links between different texts, each text by the least key that holds it (see members)."""
    _, found = near_duplicates(df, key, text)
    return found.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.round("similarity", 6).alias("similarity"))


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, rep: every row with the least key whose text is equal without white space; null counts as empty."""
    ship(df.sparkSession)
    own = stored(_read(df, key, text).select("k", "class"))
    return own.join(own.groupBy("class").agg(F.min("k").alias("rep")), "class").select(F.col("k").alias(key), "rep").distinct()


def groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key: key, group_id (the least key reachable over links), n_links (of its text to other texts)."""
    own, found = near_duplicates(df, key, text)
    edges = stored(found.select("a", "b"))
    labels = components(edges, "a", "b", stored).toDF("rep", "label")
    n = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    one = own.select("rep", key).distinct()
    return one.join(labels, "rep", "left").join(n, "rep", "left").select(key, F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
