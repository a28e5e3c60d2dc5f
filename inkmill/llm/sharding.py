"""Sharding, native: extendible hashing over a directory of hash prefixes.

Every document gets a 60-bit hash of its key. A bucket is a prefix of that
hash; a bucket over the byte limit splits on the next bit, and no other bucket
does, until each fits. The directory is computed from bytes summed by prefix:
one pass sums at a depth just finer than the total needs, adds those sums up
for all shorter prefixes and keeps, for every cell, its shortest prefix within
the limit. Cells that are still too large go through the same step again with
the bits that follow, over their own keys only.

Rows that are alike, of one key and one size, are one group with a count from
the first step on; the count is undone last, by chunks. So a key with a third of
all rows has as many groups as it has sizes, and no task gathers its rows.

Rows of one key can't be parted by hashing. Where they exceed the limit, a row
above half of it is a shard of its own; the others, by size, are cut into runs
by running bytes, group by group in arithmetic, so that a run is at least half
the limit wide. A single row above the limit is a shard of its own.

Only the key and the byte count of each document move. Nothing is broadcast by
hint.

Defined results: a null text has 0 bytes; null keys hash as one key, the empty
string. Repeated rows are kept, each with its own place. An empty table gives
no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm.common import cut_lineage, load

HASH_BITS = 60
SHARD_BYTES = 64 * 1024 * 1024
#: The limit of the registered query: the tables at hand are small, and it splits buckets at each of their sizes.
QUERY_BYTES = 128 * 1024
#: Copies of one row that one task writes out at most.
CHUNK_ROWS = 100_000
#: Bits by which a pass looks past the depth that an even split needs.
SLACK_BITS = 3
STEP_BITS = 8


def _hash(key: str) -> str:
    return f"cast(conv(substr(md5(coalesce(cast({key} as string), '')), 1, 15), 16, 10) as long)"


def _prefix(column: str, depth: str | int) -> str:
    return f"shiftrightunsigned({column}, {HASH_BITS} - ({depth}))"


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """Buckets of ``keys`` (h, bytes; one row per hash): depth, prefix, bucket_bytes.

    Cells of one pass map to buckets; what doesn't fit is split again.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit)) + SLACK_BITS))
    done, rest, start = [], keys, 0
    while True:
        cells = rest.groupBy(F.expr(_prefix("h", depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        levels = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("level"), "bytes")
        sums = levels.groupBy("level", F.expr(f"shiftrightunsigned(cell, {depth} - level)").alias("prefix")).agg(F.sum("bytes").alias("bucket_bytes"))
        fitting = sums.filter((F.col("bucket_bytes") <= limit) | F.lit(depth == HASH_BITS) & (F.col("level") == HASH_BITS))
        # the shortest fitting prefix of a cell: no fitting prefix lies above it
        parent = sums.filter(F.col("bucket_bytes") > limit).select((F.col("level") + 1).alias("level"), "prefix")
        halves = parent.select("level", F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        if start == 0:
            root = fitting.filter("level = 0")
            halves = halves.unionByName(root.select("level", "prefix"))
        else:
            halves = halves.unionByName(sums.filter(f"level = {start}").select("level", "prefix"))
        found = fitting.join(halves.distinct(), ["level", "prefix"], "left_semi")
        found = cut_lineage(found.select(F.col("level").alias("depth"), "prefix", "bucket_bytes"))
        done.append(found)
        if depth == HASH_BITS:
            break
        large = cells.filter(F.col("bytes") > limit).select("cell")
        rest = cut_lineage(rest.join(large, F.expr(_prefix("h", depth)) == F.col("cell"), "left_semi"))
        if rest.isEmpty():
            break
        start, depth = depth + 1, min(HASH_BITS, depth + STEP_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (prefix bits, then ``.k`` for the k-th run of one key), shard_bytes."""
    rows = docs.selectExpr(f"`{key}` as doc_id", f"{_hash(f'`{key}`')} as h", f"cast(coalesce(octet_length(cast(`{text}` as string)), 0) as long) as n_bytes")
    groups = cut_lineage(rows.groupBy("h", "doc_id", "n_bytes").agg(F.count(F.lit(1)).alias("copies")))
    keys = cut_lineage(groups.groupBy("h").agg(F.sum(F.expr("n_bytes * copies")).alias("bytes")))
    found = cut_lineage(directory(keys, limit))
    depths = [r[0] for r in found.select("depth").distinct().orderBy("depth").collect()]  # at most HASH_BITS + 1 numbers
    if not depths:
        return groups.selectExpr("doc_id", "n_bytes", "0 as depth", "'' as shard", "n_bytes as shard_bytes").limit(0)
    # a key joins the buckets of every depth that occurs; its own is the only match
    probes = keys.select("h", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(_prefix("h", d)).alias("prefix")) for d in depths])).alias("p"))
    of_key = probes.select("h", "p.depth", "p.prefix").join(found, ["depth", "prefix"])
    placed = groups.join(of_key, "h").selectExpr("*", "case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end as bits")
    if depths[-1] < HASH_BITS:
        return _copies(placed.selectExpr("doc_id", "n_bytes", "depth", "bits as shard", "bucket_bytes as shard_bytes", "copies"))
    placed = cut_lineage(placed)
    fits = placed.filter(f"depth < {HASH_BITS} or bucket_bytes <= {limit}").selectExpr("doc_id", "n_bytes", "depth", "bits as shard", "bucket_bytes as shard_bytes", "copies")
    return _copies(fits.unionByName(_runs(placed.filter(f"depth = {HASH_BITS} and bucket_bytes > {limit}"), limit)))


def _runs(groups: DataFrame, limit: int) -> DataFrame:
    """Cut the rows of keys above the limit into runs; rows above half of it come first, one by one."""
    sized = groups.withColumn("lone", F.expr(f"2 * n_bytes > {limit}"))
    earlier = W.partitionBy("h").orderBy(F.desc("lone"), "n_bytes", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    of_key = W.partitionBy("h")
    sized = sized.select(
        "*",
        F.coalesce(F.sum(F.expr("case when lone then copies end")).over(earlier), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum(F.expr("case when not lone then n_bytes * copies end")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.expr("case when lone then copies end")).over(of_key), F.lit(0)).alias("lones"),
        F.expr(f"{limit} + 1 - coalesce(max(case when not lone then n_bytes end) over (partition by h), 0)").alias("width"),
    )
    lone = sized.filter("lone").selectExpr("doc_id", "n_bytes", "h", "depth", "bits", "explode(sequence(ahead, ahead + copies - 1)) as run", "1L as copies")
    # a run takes the rows that begin within its width: of equal rows, so many
    spans = sized.filter("not lone").selectExpr("*", "explode(sequence(before div width, (before + (copies - 1) * n_bytes) div width)) as r")
    last = "least(copies - 1, ((r + 1) * width - 1 - before) div n_bytes)"
    first = "case when r * width <= before then 0 else (r * width - before + n_bytes - 1) div n_bytes end"
    share = spans.selectExpr("doc_id", "n_bytes", "h", "depth", "bits", "lones + r as run", f"case when n_bytes = 0 then copies else {last} - {first} + 1 end as copies")
    cut = lone.unionByName(share).filter("copies > 0")
    total = F.sum(F.expr("n_bytes * copies")).over(W.partitionBy("h", "run"))
    return cut.withColumn("shard_bytes", total).selectExpr("doc_id", "n_bytes", "depth", "concat(bits, '.', run) as shard", "shard_bytes", "copies")


def _copies(rows: DataFrame) -> DataFrame:
    """One row per copy again; many copies of one row are written by several tasks."""
    few = rows.filter(f"copies <= {CHUNK_ROWS}").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    chunks = rows.filter(f"copies > {CHUNK_ROWS}").withColumn("at", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK_ROWS})")))
    dealt = chunks.repartition(F.xxhash64("shard", "doc_id", "n_bytes", "at")).withColumn("k", F.explode(F.expr(f"sequence(1, cast(least({CHUNK_ROWS}, copies - at * {CHUNK_ROWS}) as int))"))).drop("at")
    return few.unionByName(dealt).drop("copies", "k")


def op2_sharding(spark, sf_dir):
    return shard(load(spark, sf_dir, "documents"), QUERY_BYTES)


#: With one key per row; a row above the limit is the only one of its bucket at full depth.
OP2_SQL = f"""
with r as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
             ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
b as (select level, h >> ({HASH_BITS} - level) as prefix, sum(n_bytes)::bigint as s
      from r, range(0, {HASH_BITS + 1}) t(level) group by all),
f as (select b.level, b.prefix, b.s from b left join b p on p.level = b.level - 1 and p.prefix = b.prefix >> 1
      where (b.s <= {QUERY_BYTES} or b.level = {HASH_BITS}) and (p.s is null or p.s > {QUERY_BYTES}))
select doc_id, n_bytes, f.level::int as depth,
  case when f.level = 0 then '' else lpad(bin(f.prefix), f.level::int, '0') end || case when s > {QUERY_BYTES} then '.0' else '' end as shard, s as shard_bytes
from r join f on r.h >> ({HASH_BITS} - f.level) = f.prefix
"""
