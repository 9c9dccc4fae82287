"""Checks of indexes, rankings, answers and decisions. A check gives rows or counts and never repairs anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attributed(hits: DataFrame, indexes: DataFrame, result: str, ident: str, index: str, recorded: str | None = None) -> DataFrame:
    """result, index, how: the index that a result came from: recorded, unique (only one exists), elimination (only one holds every id), ambiguous or none.

    hits: result, ident (and recorded: the index it names). indexes: index, ident. An index holds all ids of a result if as many of
    its distinct ids are found in it as the result has; null ids are passed over, and a result without ids fits every index.
    """
    held = indexes.filter(F.col(ident).isNotNull()).select(index, ident).distinct()
    names = indexes.select(index).distinct()
    cited = hits.filter(F.col(ident).isNotNull()).select(result, ident).distinct()
    n = cited.groupBy(result).agg(F.count("*").alias("n"))
    fits = cited.join(held, ident).groupBy(result, index).agg(F.count("*").alias("m")).join(n, result).filter("m = n")
    one = fits.groupBy(result).agg(F.count("*").alias("fits"), F.min(index).alias("only"))
    total = names.agg(F.count("*").alias("total"), F.min(index).alias("single"))  # one row
    named = F.max(recorded) if recorded else F.lit(None).cast(indexes.schema[index].dataType)
    every = hits.groupBy(result).agg(named.alias("named")).join(one, result, "left").join(n, result, "left").join(F.broadcast(total))
    known = every.join(names.select(F.col(index).alias("named"), F.lit(True).alias("known")), "named", "left")
    count = F.when(F.col("n").isNull(), F.col("total")).otherwise(F.coalesce("fits", F.lit(0)))
    how = F.when(F.col("known"), "recorded").when(F.col("total") == 1, "unique").when(count == 1, "elimination").when(count == 0, "none").otherwise("ambiguous")
    picked = F.when(how == "recorded", F.col("named")).when(how == "unique", F.col("single")).when(how == "elimination", F.coalesce("only", "single"))
    return known.select(result, picked.alias(index), how.alias("how"))


def vector_documents(docs: DataFrame, key: str, vectors: str, expected: DataFrame | None = None) -> DataFrame:
    """check, n, bad of documents of several vectors: aligned with the expected keys, none empty, one size, finite, of length 1. What can't be checked has a null bad, which is no pass."""
    flat = F.flatten(vectors)
    sizes = F.array_distinct(F.transform(vectors, lambda v: F.size(v)))
    odd = F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    off = F.exists(vectors, lambda v: F.abs(norm(v) - 1) > 1e-3)
    one = docs.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(vectors), F.lit(0)) <= 0).alias("empty"), F.count_if(F.size(sizes) > 1).alias("mixed"), F.count_if(odd).alias("odd"), F.count_if(off).alias("off"))
    checks = [("not empty", "empty"), ("one size", "mixed"), ("finite", "odd"), ("length 1", "off")]
    out = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(x).alias("bad")) for c, x in checks])).alias("c")).select("c.check", "n", "c.bad")
    if expected is None:
        return out.unionByName(one.select(F.lit("aligned").alias("check"), "n", F.lit(None).cast("bigint").alias("bad")))
    both = docs.select(key).withColumn("a", F.lit(1)).join(expected.select(key).withColumn("b", F.lit(1)), key, "full")
    return out.unionByName(both.agg(F.lit("aligned").alias("check"), F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("bad")))


def cited(answers: DataFrame, labels: DataFrame, judgements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cited, n_phantom, precision, recall, abstained, has_gold of each answer (keys, query_id, answer, has_gold; labels: keys, label, resolution_id).

    A label cited several times counts once; one without a document is a phantom. Precision is null where nothing valid is cited, recall where nothing is relevant.
    """
    from kosha.operators.entities import citations

    said = answers.select(*keys, "query_id", F.explode_outer(citations(F.col("answer"))).alias("label"))
    found = said.join(labels.select(*keys, "label", "resolution_id"), [*keys, "label"], "left").join(judgements.withColumn("rel", F.lit(1)), ["query_id", "resolution_id"], "left")
    per = found.groupBy(*keys).agg(F.count("label").alias("n_cited"), F.count_if(F.col("label").isNotNull() & F.col("resolution_id").isNull()).alias("n_phantom"), F.count_distinct("resolution_id").alias("docs"), F.count_distinct(F.when(F.col("rel") == 1, F.col("resolution_id"))).alias("hits"))
    rel = judgements.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    both = answers.join(per, keys).join(rel, "query_id", "left")
    return both.select(*keys, "query_id", "n_cited", "n_phantom", share("hits", "docs").alias("precision"), share("hits", "n_rel").alias("recall"), F.contains("answer", F.lit(ABSTAIN)).alias("abstained"), "has_gold")


#: Fixed value: what an answer says that finds nothing.
ABSTAIN = "ไม่พบข้อมูล"


def decided(readings: DataFrame, page: list[str], verdicts: Column, decision: Column) -> Column:
    """What is done with a page: apply where both models say new, else what was decided by hand, else wait."""
    both_new = (F.size(verdicts) == 2) & ~F.exists(verdicts, lambda v: v != "new")
    return F.when(both_new, "apply: both new").when(decision == "apply-new", "apply: by hand").when(decision == "keep-old", "skip: keep old").when(decision.isNotNull(), "skip: deferred").otherwise("skip: waiting")


def relabelled(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """chunk rows with new document ids (mapping: old, new), the ids of the chunks after them.

    Raises if a new id is held by a document that keeps its id, if a chunk's id isn't document:index, or if two documents would become one.
    """
    from kosha.session import stored

    m = stored(mapping.select("old", "new"))
    moved = chunks.join(m, chunks["resolution_id"] == m["old"], "left")
    squat = moved.filter("old is null").join(m.select(F.col("new").alias("resolution_id")).distinct(), "resolution_id", "left_semi").limit(1).count()
    odd = moved.filter(F.col("old").isNotNull() & ~F.col("chunk_id").eqNullSafe(F.concat("resolution_id", F.lit(":"), F.col("chunk_index").cast("string")))).limit(1).count()
    merged = m.groupBy("new").agg(F.count_distinct("old").alias("n")).filter("n > 1").limit(1).count()
    for bad, why in ((squat, "a new id is taken"), (odd, "a chunk's id is not made of its document's"), (merged, "two documents would become one")):
        if bad:
            raise ValueError(why)
    ident = F.coalesce("new", "resolution_id")
    return moved.select(F.when(F.col("old").isNull(), F.col("chunk_id")).otherwise(F.concat("new", F.lit(":"), F.col("chunk_index").cast("string"))).alias("chunk_id"), ident.alias("resolution_id"), *[c for c in chunks.columns if c not in ("chunk_id", "resolution_id")])


def report_rows(lines: DataFrame, line: str) -> DataFrame:
    """label, diff, p, significant of a report's table rows "| a vs b | diff | p | yes |"; the sign is of a - b with a < b, whatever the order in the label. Other lines give none."""
    cells = F.transform(F.split(F.btrim(F.col(line), F.lit(" |")), r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.startswith(F.ltrim(line), F.lit("|"))).select(cells.alias("c")).filter((F.size("c") == 4) & F.col("c")[0].contains(" vs "))
    a, b = F.split(F.col("c")[0], " vs ")[0], F.split(F.col("c")[0], " vs ")[1]
    diff = F.replace(F.col("c")[1], F.lit("+"), F.lit("")).try_cast("double")
    out = rows.select(F.concat(F.least(a, b), F.lit(" vs "), F.greatest(a, b)).alias("label"), F.when(a <= b, diff).otherwise(-diff).alias("diff"), F.col("c")[2].try_cast("double").alias("p"), F.contains(F.col("c")[3], F.lit("yes")).alias("significant"))
    return out.filter("diff is not null and p is not null")


def change(d0: Column, s0: Column, d1: Column, s1: Column) -> Column:
    """flipped or moved (from 0.02), null for neither, from a comparison's old and new difference and verdict."""
    return F.when(~s0.eqNullSafe(s1), "flipped").when(F.abs(d1 - d0) >= 0.02, "moved")


def verdict_flips(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (flipped, moved, only old, only new) of two reports (key, diff, significant); equal rows are left out, moves count from 0.02."""
    both = old.select(key, F.col("diff").alias("d0"), F.col("significant").alias("s0"), F.lit(1).alias("o")).join(new.select(key, F.col("diff").alias("d1"), F.col("significant").alias("s1"), F.lit(1).alias("n")), key, "full")
    found = F.when(F.col("n").isNull(), "only old").when(F.col("o").isNull(), "only new").otherwise(change(*map(F.col, ("d0", "s0", "d1", "s1"))))
    return both.select(key, found.alias("change"), F.round("d0", 6).alias("old"), F.round("d1", 6).alias("new")).filter("change is not null")


def decision(cells: Column, margin: float) -> Column:
    """INVALID, STOP, NARROW or CONTINUE over array<struct<diff,significant>>, in this order: a difference that was never measured, one beyond the margin, a real loss, none of these."""
    unmeasured = F.exists(cells, lambda c: c["diff"].isNull() | F.isnan(c["diff"]))
    return F.when((F.size(cells) <= 0) | unmeasured, "INVALID").when(F.exists(cells, lambda c: c["diff"] < -margin), "STOP").when(F.exists(cells, lambda c: (c["diff"] < 0) & c["significant"]), "NARROW").otherwise("CONTINUE")


def linked(files: DataFrame, sources: DataFrame, key: str, name: str, by: str) -> DataFrame:
    """file, source: files and sources of one link (by), one to one, the longest common beginning of their names first; what has no partner by link then by equal names, only where that is unique.

    files, sources: key, name, by.
    """
    f, s = files.select(F.col(key).alias("f"), F.col(name).alias("fn"), F.col(by).alias("fb")), sources.select(F.col(key).alias("s"), F.col(name).alias("sn"), F.col(by).alias("sb"))
    pairs = f.join(s, F.col("fb") == F.col("sb"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("fn"), F.length("sn")))), lambda i: F.substring("fn", F.lit(1), i) == F.substring("sn", F.lit(1), i)))
    scored = pairs.withColumn("score", F.coalesce(same, F.lit(0)))
    best = scored.withColumn("rf", F.row_number().over(Window.partitionBy("f").orderBy(F.col("score").desc(), "s"))).withColumn("rs", F.row_number().over(Window.partitionBy("s").orderBy(F.col("score").desc(), "f"))).filter("rf = 1 and rs = 1").select("f", "s", F.lit("link").alias("how"))
    left = f.join(best.select("f"), "f", "left_anti").join(s.join(best.select("s"), "s", "left_anti"), F.col("fn") == F.col("sn"))
    alone = left.withColumn("nf", F.count("*").over(Window.partitionBy("f"))).withColumn("ns", F.count("*").over(Window.partitionBy("s"))).filter("nf = 1 and ns = 1")
    return best.unionByName(alone.select("f", "s", F.lit("name").alias("how"))).toDF("file", "source", "how")
