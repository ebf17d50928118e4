"""Sharding by extendible hashing (operator 9).

A directory is indexed by the leading bits of a hash.  Buckets start as one; a bucket over the byte limit splits on its
next bit, and only such buckets do.  All splits are found from sums over hash prefixes, so documents are never moved
to be counted; DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twigline.llm.common import packed, scratch_path, staged, unpacked

#: Bytes of one shard, at most.
SHARD_BYTES = 1 << 20
#: Bits of the key's hash; rows that agree in all are told apart by a row number's hash.
HASH_BITS = 60
#: Cells of a round's directory up to which it is broadcast; beyond that rows are joined with it by a shuffle.
BROADCAST_CELLS = 1 << 20
#: Bits looked at in one round: bounds its directory to 2 ** ROUND_BITS cells.
ROUND_BITS = 24
MADE = ("shard", "shard_bits", "shard_bytes_each")


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key's text; a null key hashes as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("_h", HASH_BITS - bits)


def _round(rows: DataFrame, done: int, upto: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Split buckets of ``done`` bits down to ``upto`` bits where they are over the limit.

    (cell, leaf depth) of the cells (prefixes of ``upto`` bits) that fit, and (cell, lo, hi) of those that don't.
    """
    cells = rows.groupBy(_prefix(upto).alias("cell")).agg(
        F.sum("_size").alias("size"), F.min("_h").alias("lo"), F.max("_h").alias("hi")
    )
    cells = staged(cells, f"cells-{upto}")
    nodes = cells.select("cell", "size", F.explode(F.sequence(F.lit(done), F.lit(upto))).alias("depth"))
    nodes = nodes.withColumn("node", F.expr(f"shiftrightunsigned(cell, cast({upto} - depth as int))"))
    fits = nodes.groupBy("depth", "node").agg(F.sum("size").alias("size")).filter(F.col("size") <= limit)
    fits = staged(fits.select("depth", "node"), f"fits-{upto}")
    # a shard is a node that fits under one that doesn't
    below = fits.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    leaves = fits.withColumn("parent", F.shiftrightunsigned("node", 1)).join(below, ["depth", "parent"], "left_anti")
    placed = staged(nodes.join(leaves.select("depth", "node"), ["depth", "node"]).select("cell", "depth"), f"placed-{upto}")
    if placed.count() <= BROADCAST_CELLS:
        placed = F.broadcast(placed)
    return placed, cells.filter(F.col("size") > limit).select("cell", "lo", "hi")


def assign_shards(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """The columns of ``df`` with shard (its bits as text, "" for a single shard), shard_bits and shard_bytes_each.

    Every shard holds at most ``limit`` bytes, except that a row larger than that is a shard by itself, named by all
    bits of its key, "!" and a row number.  Rows with equal keys stay together while they fit; past that the bits of a
    row number's hash go on where the key's hash ends (after a "+").  ``size`` defaults to the bytes of column ``text``
    (null: 0).  Null keys hash as the empty text; repeated rows are counted each; an empty table gives no rows; columns
    with the result's names give way.  Only key hash and size are shuffled, unless the directory has over
    ``BROADCAST_CELLS`` cells: then rows join their cell's bits.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    keep = [c for c in df.columns if c not in MADE]
    rows = df.select(packed(keep), key_hash(F.col(key)).alias("_h"), size.cast("long").alias("_size"))
    over = rows.filter(F.col("_size") > limit).select(
        *unpacked(keep), F.concat(_bits("_h", F.lit(HASH_BITS)), F.lit("!"), F.monotonically_increasing_id().cast("string")).alias("shard"),
        F.lit(HASH_BITS).alias("shard_bits"), F.col("_size").alias("shard_bytes_each"),
    )
    out, pending, stem = [over], rows.filter(F.col("_size") <= limit), F.lit("")
    total = pending.agg(F.sum("_size")).first()[0] or 0
    done = 0
    upto = min(ROUND_BITS, max(1, math.ceil(math.log2(max(1, total) / limit)) + 5))
    by_row = False
    while True:
        placed, full = _round(pending, done, upto, limit)
        full = staged(full, f"full-{upto}")
        hit = pending.withColumn("cell", _prefix(upto)).join(placed, "cell")
        # shard name: the leading bits of the hash
        name = F.concat(stem, _bits("_h", F.col("depth")))
        bits = F.col("depth") + (HASH_BITS if by_row else 0)
        out.append(
            hit.select(*unpacked(keep), name.alias("shard"), bits.cast("int").alias("shard_bits"), F.col("_size").alias("shard_bytes_each"))
        )
        left, distinct_keys = full.agg(F.count("*"), F.max(F.col("lo") != F.col("hi"))).first()
        if not left:
            break
        pending = pending.withColumn("cell", _prefix(upto)).join(full.select("cell"), "cell", "left_semi").drop("cell")
        if upto == HASH_BITS or not distinct_keys:
            if by_row:
                raise RuntimeError("row numbers with equal hashes")
            # all that is left shares its key's hash with too many others: go on with a row number's hash
            number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
            pending = pending.withColumn("_k", F.col("_h")).withColumn("_h", number)
            pending = staged(pending, "same-key")
            out.extend(_same_key(pending, keep, limit))
            break
        done, upto = upto, min(HASH_BITS, upto + 12)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _bits(column: str, depth: Column) -> Column:
    return F.substring(F.lpad(F.bin(F.col(column)), HASH_BITS, "0"), F.lit(1), depth.cast("int"))


def _same_key(rows: DataFrame, keep: list[str], limit: int) -> list[DataFrame]:
    """Rows whose keys alone are over the limit: split each key's rows on the bits of their row numbers' hashes."""
    out = []
    sums = rows.groupBy("_k").agg(F.sum("_size").alias("of_key"))
    # so many bits that a bucket is expected to be half full, then more where one still is over the limit
    extra = 0
    while True:
        want = F.greatest(F.lit(0), F.ceil(F.log2(F.col("of_key") / limit))).cast("int") + 1 + extra
        cut = rows.join(sums, "_k").withColumn("depth", F.least(want, F.lit(HASH_BITS)))
        cut = cut.withColumn("bits", _bits("_h", F.col("depth")))
        fit = cut.groupBy("_k", "bits").agg(F.sum("_size").alias("s")).filter(F.col("s") <= limit).select("_k", "bits")
        fit = staged(fit, "row-cells")
        out.append(
            cut.join(fit, ["_k", "bits"]).select(
                *unpacked(keep), F.concat(_bits("_k", F.lit(HASH_BITS)), F.lit("+"), "bits").alias("shard"),
                (F.col("depth") + HASH_BITS).cast("int").alias("shard_bits"), F.col("_size").alias("shard_bytes_each"),
            )
        )
        rows = staged(cut.join(fit, ["_k", "bits"], "left_anti").drop("of_key", "depth", "bits"), "row-rest")
        if rows.isEmpty():
            return out
        extra += 1


def write_shards(df: DataFrame, path: str, **options) -> None:  # noqa: ANN003
    """Write the rows of ``df`` as Parquet, one folder for each shard, with shard_bits and shard_bytes_each."""
    out = assign_shards(df, **options)
    out = out.withColumn("shard", F.concat(F.lit("s"), "shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """The rows of ``write_shards``, whose columns were ``columns``, with shard, shard_bits and shard_bytes_each."""
    schema = StructType([f for f in columns if f.name not in MADE])
    for name, kind in (("shard_bits", "integer"), ("shard_bytes_each", "long"), ("shard", "string")):
        schema = schema.add(name, kind)
    return spark.read.schema(schema).parquet(path).withColumn("shard", F.expr("substring(shard, 2)"))


def op9_sharding(spark, sf_dir):  # noqa: ANN001, ANN201
    """All documents written as shards and read back: every document's shard, and the bytes of that shard."""
    from twigline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "shards")
    write_shards(docs, path)
    back = read_shards(spark, path, docs.schema).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard",
        F.col("shard_bits").cast("long").alias("shard_bits"),
    )
    # a shard is small by its limit; its rows, without texts, meet in one task
    return back.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard")))


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (SELECT unnest(range(0, 25)) AS depth),
sums AS (
  SELECT depth, h >> (60 - depth) AS node, sum(n_bytes) AS s FROM docs, levels GROUP BY ALL
), placed AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(l.depth) AS depth
  FROM docs d, levels l JOIN sums ON sums.depth = l.depth AND sums.node = d.h >> (60 - l.depth)
  WHERE sums.s <= {SHARD_BYTES} GROUP BY ALL
)
SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes FROM (
  SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
         substr(lpad(format('{{:b}}', h), 60, '0'), 1, CAST(depth AS INTEGER)) AS shard, CAST(depth AS BIGINT) AS shard_bits
  FROM placed)
"""
