"""Problem 9: items of varying length into containers of fixed capacity.

Only the histogram of lengths is planned, on the driver: it has at most one entry per length up to the
capacity. Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kosha.session import stored

CAPACITY = 8192
#: Items of one length that are ranked in one part, so that no length is a single task, however many items it has.
PART = 20_000

SEGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "n", "container", "per")])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: segments (length, first rank, items, first container, items in each container).

    The item of rank r, first ≤ r < first+items, goes to container + (r-first) div per. Containers with
    the same room are handled as one group, so the work depends on the number of lengths.
    """
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room → runs (first container, containers)
    rooms: list[int] = []
    made = 0

    def give(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
                used = min(n, left)
                give(room, first + used, n - used)
                out.append((length, rank, used, first, 1))
                give(room - length, first, used)
            else:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    out.append((length, rank, full * per, made, per))
                    give(capacity - per * length, made, full)
                    made, used = made + full, full * per
                else:
                    out.append((length, rank, rest, made, rest))
                    give(capacity - rest * length, made, 1)
                    made, used = made + 1, rest
            rank, left = rank + used, left - used
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece_no, piece_size, container_id.

    An item larger than the capacity is cut into full pieces and a rest; no other is cut. Items of size
    0 or null take no room and come out with container_id null. Ties are broken by the key.
    """
    spark = sizes.sparkSession
    s = F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint"))
    last = F.greatest(F.ceil(s / capacity), F.lit(1)) - 1
    pieces = stored(
        sizes.select(F.col(key).alias("k"), s.alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
        .select("k", "piece_no", F.least(F.col("s") - F.col("piece_no") * capacity, F.lit(capacity)).alias("length"))
    )
    # a row per length, at most capacity, and then one per PART items of a length
    lengths = {r["length"]: r["count"] for r in pieces.filter("length > 0").groupBy("length").count().collect()}
    by_parts = spark.createDataFrame([(x, -(-n // PART)) for x, n in lengths.items()], "length bigint, parts bigint")
    items = pieces.filter("length > 0").join(F.broadcast(by_parts), "length").withColumn("part", F.pmod(F.xxhash64("k", "piece_no"), "parts")).drop("parts")
    counts = items.groupBy("length", "part").count().collect()
    total: dict[int, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: (r["length"], r["part"])):
        starts.append((r["length"], r["part"], total.get(r["length"], 0)))
        total[r["length"]] = total.get(r["length"], 0) + r["count"]
    segments: dict[int, list[tuple]] = {}
    for x in plan(total, capacity):
        segments.setdefault(x[0], []).append(x)
    by_length = spark.createDataFrame(list(segments.items()), T.StructType([T.StructField("length", T.LongType()), T.StructField("segments", T.ArrayType(SEGMENT))]))
    offsets = spark.createDataFrame(starts, "length bigint, part bigint, before bigint")
    ranked = (
        items.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("k", "piece_no")) - 1)
        .join(F.broadcast(offsets), ["length", "part"])  # as many rows as counted above
        .join(F.broadcast(by_length), "length")
        .withColumn("r", F.col("r") + F.col("before"))
    )
    slot = F.filter("segments", lambda g: (g["first"] <= F.col("r")) & (F.col("r") < g["first"] + g["n"]))[0]
    placed = ranked.withColumn("slot", slot).select("k", "piece_no", "length", F.expr("slot.container + (r - slot.first) div slot.per").alias("container_id"))
    none = pieces.filter("length = 0").select("k", "piece_no", "length", F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(none).select(F.col("k").alias(key), F.col("piece_no").cast("int").alias("piece_no"), F.col("length").alias("piece_size"), "container_id")


def found(packed: DataFrame, key: str) -> DataFrame:
    """The keys of the items that had to be cut: those that lie in several containers."""
    return packed.filter("container_id is not null").groupBy(key).agg(F.min("container_id").alias("a"), F.max("container_id").alias("b")).filter("a < b").select(key)
