"""Sharding by extendible hashing: a directory over hash-prefix bits.

A row's key has 120 hash bits: 60 of the key, then 60 of the key and the text, so rows of one hot
key still part where their texts differ. A shard is a bit prefix. Starting from the empty prefix,
only prefixes whose rows exceed the byte limit take another bit. Rows that are equal in key and
text can't part by bits; those of an oversized bucket fill overflow shards in turn.

Work by round: rows are summed by the next ``STEP`` bits once, the sums of all shorter prefixes
come from those cells, and only rows in cells that are still too large go to a next round. The
directory stays a DataFrame; the driver sees one number a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

BITS = 120
#: Bits that a round looks at. 2**15 cells of the default limit hold 2 TB a round.
STEP = 15
#: Overflow rows are numbered within this many groups, so one task never numbers them all.
SALTS = 64


def _bits(of: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(of), 1, 15), 16, 2), 60, "0")


def hash_bits(key: Column, text: Column) -> Column:
    """120 characters 0 or 1; null keys and texts count as empty."""
    k, t = F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(_bits(k), _bits(F.concat(k, F.lit("\n"), F.md5(t))))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``_mr_cell``, ``_mr_shard``, ``_mr_bytes``, ``_mr_rows``, ``_mr_full``: the shard of every cell.

    ``rows`` has ``_mr_bits`` and ``_mr_size``. Cells of a round have the same number of bits; a
    cell of all 120 bits may stay over the limit, then ``_mr_full`` is false.
    """
    found, base, depth = [], rows, 0
    while True:
        top = min(BITS, depth + STEP)
        cells = base.groupBy(F.substring("_mr_bits", 1, top).alias("_mr_cell")).agg(F.sum("_mr_size").alias("b"), F.count("*").alias("n"))
        cells = materialise(cells, "shard-cells")
        every = cells.withColumn("k", F.explode(F.sequence(F.lit(depth), F.lit(top)))).withColumn("p", F.expr("substring(_mr_cell, 1, k)"))
        sums = every.groupBy("k", "p").agg(F.sum("b").alias("_mr_bytes"), F.sum("n").alias("_mr_rows"))
        fits = (F.col("_mr_bytes") <= limit) | (F.col("_mr_rows") == 1)
        # Sums fall with the depth, so a cell's shard is its shortest prefix that fits.
        own = every.select("_mr_cell", "k", "p").join(sums.where(fits | (F.col("k") == BITS)), ["k", "p"])
        first = own.groupBy("_mr_cell").agg(F.min_by(F.struct(F.col("p").alias("_mr_shard"), "_mr_bytes", "_mr_rows"), "k").alias("s"))
        first = materialise(first.select("_mr_cell", "s.*", ((F.col("s._mr_bytes") <= limit) | (F.col("s._mr_rows") == 1)).alias("_mr_full")), "shard-directory")
        found.append(first)
        if top == BITS:
            break
        rest = cells.join(first, "_mr_cell", "left_anti").select("_mr_cell")
        if rest.isEmpty():
            break
        base = materialise(base.withColumn("_mr_cell", F.substring("_mr_bits", 1, top)).join(rest, "_mr_cell", "left_semi").select("_mr_bits", "_mr_size"), "shard-rest")
        depth = top
    return reduce(DataFrame.unionByName, found)


def shard(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = 64 << 20, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``bytes``, ``shard``, ``shard_bytes``, ``shard_rows``.

    ``bytes`` is the text's length in UTF-8, 0 for null. ``shard`` is the bit prefix; overflow
    shards of equal rows have ``+group.number`` after it, and their ``shard_bytes`` and
    ``shard_rows`` count one overflow shard's rows. A row over the limit is a shard of its own.
    Columns of the new names are replaced; an empty table gives an empty table.
    """
    new = ["bytes", "shard", "shard_bytes", "shard_rows"]
    names = [c for c in (keep or docs.columns) if c not in new]
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    bits = hash_bits(F.col(key_col), F.col(text_col))
    light = materialise(docs.select(bits.alias("_mr_bits"), size.alias("_mr_size")), "shard-rows")
    cells = directory(light, limit)
    depths = [r[0] for r in cells.select(F.length("_mr_cell")).distinct().collect()]  # one for each round, 8 at most
    rows = docs.select(*[F.col(f"`{c}`") for c in names], bits.alias("_mr_bits"), size.alias("_mr_size"))
    parts = []
    for k in sorted(depths):
        own = cells.where(F.length("_mr_cell") == k)
        parts.append(rows.withColumn("_mr_cell", F.substring("_mr_bits", 1, k)).join(own, "_mr_cell"))
    if not parts:
        return rows.select(*[F.col(f"`{c}`") for c in names], F.col("_mr_size").alias("bytes"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows")).limit(0)
    out = reduce(DataFrame.unionByName, parts)
    plain = out.where("_mr_full").select(*[F.col(f"`{c}`") for c in names], F.col("_mr_size").alias("bytes"), F.col("_mr_shard").alias("shard"), F.col("_mr_bytes").alias("shard_bytes"), F.col("_mr_rows").alias("shard_rows"))
    if BITS not in depths:
        return plain
    over = out.where("not _mr_full").withColumn("_mr_salt", F.monotonically_increasing_id() % SALTS)
    number = F.row_number().over(Window.partitionBy("_mr_bits", "_mr_salt").orderBy("_mr_size"))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_mr_size"), F.lit(1)))).cast("long")
    over = over.withColumn("_mr_shard", F.concat("_mr_shard", F.lit("+"), F.col("_mr_salt").cast("string"), F.lit("."), F.floor((number - 1) / per).cast("string")))
    whole = Window.partitionBy("_mr_shard")
    over = over.select(*[F.col(f"`{c}`") for c in names], F.col("_mr_size").alias("bytes"), F.col("_mr_shard").alias("shard"), F.sum("_mr_size").over(whole).alias("shard_bytes"), F.count("*").over(whole).alias("shard_rows"))
    return plain.unionByName(over)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the sharded rows, a folder for each shard."""
    out = shard(docs, **options)
    out.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, at 64 MiB a shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, keep=["doc_id"])


#: The same by sums over every prefix of 0 to 45 bits; equal rows beyond the limit don't occur at the check's scale.
SHARDING_SQL = """
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (SELECT substr(bits, 1, k) AS shard, k, sum(bytes) AS b, count(*) AS n
      FROM r, range(0, 46) t(k) GROUP BY ALL),
f AS (SELECT * FROM p WHERE b <= 67108864 OR n = 1),
m AS (SELECT r.doc_id, r.bytes, min_by(struct_pack(s := f.shard, b := f.b, n := f.n), f.k) AS x
      FROM r JOIN f ON substr(r.bits, 1, f.k) = f.shard GROUP BY ALL)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, x.s AS shard, CAST(x.b AS BIGINT) AS shard_bytes, CAST(x.n AS BIGINT) AS shard_rows FROM m
"""
