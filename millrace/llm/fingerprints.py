"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash in the lowest 1 / ``SCALE`` of the hash range, so its size follows
the document's, and sketches of very unequal documents still estimate containment. The smallest hash is
kept whatever its value, so no text with words has an empty sketch. Sketches merge by set union,
and the merged one is the sketch of the united shingles up to the smallest hashes of the parts.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: sketches of different scales don't compare.
SCALE = 8
#: Words of a shingle; a text with fewer is one shingle.
WORDS = 3
_TOP = -(1 << 63) + (1 << 64) // SCALE
#: Documents in one range of ids in ``with_next``.
_RANGE = 4000


def with_sketch(df: DataFrame, text: Column, out_col: str) -> DataFrame:
    """``df`` with a sorted array<long>; empty for null and for texts without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    df = df.withColumn("_mr_w", F.transform(words, lambda w: F.xxhash64(w)))
    w, n = F.col("_mr_w"), F.size("_mr_w")
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    df = df.withColumn("_mr_s", F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many))
    kept = F.concat(F.filter("_mr_s", lambda h: h < F.lit(_TOP)), F.slice(F.array(F.array_min("_mr_s")), 1, F.least(F.size("_mr_s"), F.lit(1))))
    return df.withColumn(out_col, F.sort_array(F.array_distinct(kept))).drop("_mr_w", "_mr_s")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: 1 for two empty sketches, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merge(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _ranges(ids: DataFrame) -> Column:
    """A number for the range of ids that ``_mr_id`` lies in, higher for higher ids.

    Ranges hold about _RANGE rows each. The bounds lie in a two-level literal, so a row looks at the
    square root of their number twice.
    """
    n = ids.count()
    parts = max(1, min(100_000, ceil(n / _RANGE)))
    if parts == 1:
        return F.lit(0)
    at = [k / parts for k in range(1, parts)]
    bounds = sorted({int(b) for b in ids.select(F.percentile_approx("_mr_id", at, max(10_000, 10 * parts))).first()[0]})
    width = ceil(len(bounds) ** 0.5)
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    long = "array<bigint>"
    coarse = F.array(*[F.lit(g[0]) for g in groups]).cast(long)
    fine = F.array(*[F.array(*map(F.lit, g)).cast(long) for g in groups])
    g = F.size(F.filter(coarse, lambda b: b < F.col("_mr_id")))
    inside = F.size(F.filter(F.coalesce(F.get(fine, g - 1), F.array().cast(long)), lambda b: b < F.col("_mr_id")))
    return F.when(g == 0, 0).otherwise((g - 1) * width + inside)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_mr_id``, ``_mr_text``, ``_mr_fp``, and the next row's as ``_mr_next_text``, ``_mr_next_fp``.

    Next is by descending id; the first follows the last. Equal ids go by descending text, null ids
    come last. Texts move once, to the task of their range of ids; only the first row of each
    range moves again, to the range above.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_mr_id"), F.col(id_col).alias("_mr_own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_mr_text"))
    rows = rows.withColumn("_mr_part", _ranges(rows.select("_mr_id")))
    heads = rows.groupBy("_mr_part").agg(F.max(F.struct("_mr_id", "_mr_text")).alias("h"))
    order = rows.select("_mr_part").distinct()
    everything = Window.orderBy(F.desc("_mr_part"))  # one number for each range
    order = order.select("_mr_part", F.coalesce(F.lead("_mr_part").over(everything), F.max("_mr_part").over(Window.partitionBy())).alias("_mr_after"))
    heads = order.join(heads.withColumnRenamed("_mr_part", "_mr_after"), "_mr_after").select("_mr_part", F.col("h._mr_text").alias("_mr_head"))
    heads = with_sketch(heads, F.col("_mr_head"), "_mr_head_fp")
    spread = with_sketch(rows.repartition("_mr_part"), F.col("_mr_text"), "_mr_fp")
    by = Window.partitionBy("_mr_part").orderBy(F.desc("_mr_id"), F.desc("_mr_text"))
    spread = spread.withColumn("_mr_next", F.lead(F.struct("_mr_text", "_mr_fp")).over(by))
    joined = spread.join(heads, "_mr_part", "left")
    return joined.select("_mr_own_id", "_mr_text", "_mr_fp", F.coalesce("_mr_next._mr_text", "_mr_head").alias("_mr_next_text"), F.coalesce("_mr_next._mr_fp", "_mr_head_fp").alias("_mr_next_fp"))


def fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the sketch of every whole text in ``out_col``; other columns pass through."""
    return with_sketch(docs, F.col(text_col), out_col)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.length("_mr_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("_mr_text", F.lit(1), n - cut), F.substr("_mr_next_text", F.lit(1), cut))
    rows = rows.withColumn("_mr_edited", edited)
    rows = with_sketch(rows, F.col("_mr_edited"), "_mr_edited_fp")
    return rows.select(
        F.col("_mr_own_id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("_mr_edited", 256).alias("edited_sha256"),
        as_text(F.col("_mr_fp")).alias("fingerprint"),
        as_text(F.col("_mr_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_mr_fp"), F.col("_mr_edited_fp")).alias("near_edited"),
        likeness(F.col("_mr_fp"), F.col("_mr_next_fp")).alias("near_next"),
    )
