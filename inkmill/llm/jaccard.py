"""N-gram Jaccard join: components of documents whose shingle sets are alike.

Two documents link when 100 * |A and B| >= 80 * |A or B| over their distinct
5-word shingles. The result is exact; links are looked for so that a component
is known, not so that every pair in it is listed.

1. *Sets.* One pass over the texts hashes shingles and gives each row its set's
   size, a 64-bit key and another 64 bits by which two sets of one key are found
   out (then all keys are made anew). From here to the links only sets are known,
   by their keys: copies are one set, whatever their doc_ids, null or repeated.
   The same pass counts shingles into a sketch of fixed size.
2. *Prefixes.* Sets that link share a shingle among the first n - ceil(0.8 n) + 1
   of each, in any common order. The order here is by the sketch's count, in
   powers of two, then by hash: shingles that many documents have come last, so
   that common passages give few candidates. The sketch only sets the order; the
   bound holds whatever it says. After one
   shuffle by shingle, rows go whose shingle no set of fitting size has; the
   place in the prefix bounds which sizes fit (the later, the fewer).
3. *Rounds.* Documents that share a prefix shingle form a group. In each round a
   group names a few leaders; they are held against the group's members of other
   components and of fitting size, then leave the group. Members that no other
   component of the group has a fitting size for go too, so a group of near
   copies ends after a few rounds without all its pairs. The number of leaders
   grows from round to round, so that every pair of a group is decided in the
   end. Within a round components join by the stars of links around its leaders
   only; what that leaves apart is joined after the last.
4. *T-occurrence search* decides: a leader's shingles are the query, the members'
   sets (in blocks of bounded size) the inverted lists. Before sets are moved,
   bitmaps of about a byte a shingle are: a bit that one set has and the other
   hasn't is a shingle not shared, and pairs with too many of them go. The short
   lists are merged with a heap, members short of the required overlap by more
   than the long lists could add are dropped, and the rest are looked up in the
   long lists by binary search (DivideSkip). How many lists are long follows from
   the required overlap and the longest list. Sets are written once, where they
   are made; up to ``FEW`` pairs are brought to them, and of more pairs only the
   sets that they name are moved.
5. Links join components by repeated minimum labels with pointer jumping.

What is broadcast, the sketch's levels and a Bloom filter, has a fixed size.
What each step leaves is written to the shared checkpoint folder.

Defined results: null and empty texts and texts without words have no shingles
and link with nothing; texts of fewer than five words have one shingle. Repeated
rows are kept and share a component, rows of one doc_id with different texts are
looked at one by one. Rows with a null doc_id link like others; a component's
name is its smallest doc_id that isn't null, and null if it has none. An empty
table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm.common import cut_lineage, load, trimmed
from inkmill.llm.shingles import mix, shingle_sets

SKETCH_BITS = 22
BLOOM_BITS = 25
BLOCK = 1 << 16
#: Leaders that a group names in each round; the last number goes on.
LEADERS = (1, 8, 64, 1024)
#: Members in one block of inverted lists.
MEMBERS = 256
#: Pairs that are broadcast; more of them are joined by a shuffle.
FEW = 20_000
MU = 0.01  # the weight of a binary search against a step of the merge

_ROW = "xxhash64(cast(doc_id as long), cast(text as string))"
_TEXT = ["cast(doc_id as long) as doc_id", f"{_ROW} as row", "cast(text as string) as text"]


def required(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The least overlap with which sets of n and m shingles link."""
    return -(-4 * (n + m) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signature(s: np.ndarray, seed: int) -> tuple[int, int]:
    """A set's key under ``seed``, and 64 bits more that don't depend on it."""
    one = mix(s ^ mix(np.uint64([0xA0761D6478BD642F + seed]))).sum(dtype=np.uint64)
    two = mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(np.int64(one.view(np.int64))), int(np.int64(two.view(np.int64)))


# --- arrays of fixed size, added up over all tasks ---------------------------


def _blocks(counts: np.ndarray) -> pd.DataFrame:
    parts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)]
    return pd.DataFrame({"block": range(len(parts)), "data": [zlib.compress(p.tobytes(), 1) for p in parts]})


def _add_up(blocks: DataFrame, dtype: str) -> np.ndarray | None:
    """Sum of the tasks' arrays: block by block, in two steps, each of bounded groups."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, kind, data in zip(batch["block"], batch["kind"], batch["data"]):
                part = np.frombuffer(zlib.decompress(data), kind).astype(np.uint32)
                sums[b] = sums[b] + part if b in sums else part
        yield pd.DataFrame({"block": list(sums), "kind": "u4", "data": [zlib.compress(v.tobytes(), 1) for v in sums.values()]}, columns=["block", "kind", "data"])

    schema = "block int, kind string, data binary"
    start = blocks.select("block", F.lit(dtype).alias("kind"), "data", F.spark_partition_id().alias("p"))
    first = start.repartition(64, "block", F.pmod("p", F.lit(32))).select("block", "kind", "data").mapInPandas(trimmed(add), schema)
    rows = first.repartition(16, "block").mapInPandas(trimmed(add), schema).collect()  # the array itself: a fixed size
    if not rows:
        return None
    found = {r["block"]: np.frombuffer(zlib.decompress(r["data"]), "u4") for r in rows}
    return np.concatenate([found[b] for b in range(len(found))])


# --- 1 and 2: sets and prefixes -----------------------------------------------


def _sets_and_sketch(docs: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)  # up to 255
        seen, any_rows = set(), False
        for batch in batches:
            any_rows = any_rows or len(batch) > 0
            rows = []
            for s in shingle_sets(batch["text"]):
                sig = _signature(s, seed) if len(s) else (0, 0)
                rows.append((len(s), *sig))
                if len(s) and sig not in seen:  # one count for a task's copies
                    seen.add(sig)
                    at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    c = counts[at]
                    counts[at] = c + (c < 255)
            out = pd.DataFrame(rows, columns=["n", "key", "more"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            out.insert(1, "row", batch["row"].array)
            yield out.assign(block=-1, data=None)
        if any_rows:
            yield _blocks(counts).assign(doc_id=pd.array([None] * (len(counts) // BLOCK), "Int64"), row=0, n=0, key=0, more=0)[["doc_id", "row", "n", "key", "more", "block", "data"]]

    return docs.selectExpr(*_TEXT).mapInPandas(trimmed(run), "doc_id long, row long, n long, key long, more long, block int, data binary")


def _order_levels(sketch: np.ndarray | None) -> np.ndarray:
    """Powers of two by which a counter stands above its array's mean."""
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    if sketch is not None:
        unit = max(1.0, float(sketch.mean(dtype=np.float64)) / 2)
        for at in range(0, len(sketch), BLOCK):
            levels[at : at + BLOCK] = np.log2(np.maximum(1, sketch[at : at + BLOCK] / np.float32(unit)))
    return levels


def _prefixes(docs: DataFrame, levels: np.ndarray, seed: int) -> DataFrame:
    """(h, rep, n, most) for each set's prefix, once for a task's copies; rep is the set's key.

    ``most`` is the size of the largest set that may link with this one if h is
    the first shingle that both have: of n shingles i precede h, so the overlap is
    n - i at most, and 9 * overlap >= 4 * (n + m).
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, seen = shared.value, set()
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            size = 0

            def table() -> pd.DataFrame:
                return pd.DataFrame(dict(zip(("h", "rep", "n", "most"), map(np.concatenate, zip(*parts)))))

            for s in shingle_sets(batch["text"]):
                if not len(s) or (sig := _signature(s, seed)) in seen:
                    continue
                seen.add(sig)
                n, k = len(s), prefix_length(len(s))
                by_level = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = s[np.argsort(by_level, kind="stable")[:k]]  # s is sorted by hash already
                most = 9 * (n - np.arange(k)) // 4 - n
                parts.append((_signed(first), np.full(k, sig[0], np.int64), np.full(k, n, np.int32), most.astype(np.int32)))
                size += k
                if size > 300_000:
                    yield table()
                    parts, size = [], 0
            if parts:
                yield table()

    return docs.selectExpr(*_TEXT).mapInPandas(trimmed(run), "h long, rep long, n int, most int")


def _with_partner(rows: DataFrame) -> DataFrame:
    """Drop rows (h, .., n, most) for whose size no other row of h can be a partner.

    By size: a smaller partner must allow for this row's n, a larger one is
    allowed if the next larger is.
    """
    by_size = W.partitionBy("h").orderBy("n")
    smaller = F.max("most").over(by_size.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__smaller", smaller).withColumn("__next", F.lead("n").over(by_size))
    return marked.filter("__smaller >= n or __next <= most").drop("__smaller", "__next")


def _with_partner_elsewhere(rows: DataFrame) -> DataFrame:
    """As ``_with_partner``, but for partners of another component (rows: h, .., n, most, comp).

    Larger rows: the next of another component. Smaller ones: what the rows so far
    allow at most, or, where that is one of the own component, a bound for the
    others: what rows allowed that weren't of the component then on top, and the
    old top whenever another component's row took its place.
    """
    by_size = W.partitionBy("h").orderBy("n", "comp", "rep")
    marked = rows.withColumn("__lead", F.lead(F.struct("n", "comp")).over(by_size))
    marked = marked.withColumn("__after", F.when(F.col("__lead.comp") != F.col("comp"), F.col("__lead.n")))
    marked = marked.withColumn("__next", F.first("__after", ignorenulls=True).over(by_size.rowsBetween(0, W.unboundedFollowing)))
    marked = marked.withColumn("__top", F.max(F.struct("most", "comp")).over(by_size.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("__before", F.lag("__top").over(by_size))
    second = F.when(F.col("__before.comp") != F.col("__top.comp"), F.col("__before.most")).when(F.col("comp") != F.col("__top.comp"), F.col("most"))
    marked = marked.withColumn("__second", second)
    marked = marked.withColumn("__others", F.max("__second").over(by_size.rowsBetween(W.unboundedPreceding, -1)))
    smaller = F.when(F.col("__before.comp") != F.col("comp"), F.col("__before.most")).otherwise(F.col("__others"))
    return marked.filter((smaller >= F.col("n")) | (F.col("__next") <= F.col("most"))).select(*rows.columns)


# --- 4: T-occurrence search ------------------------------------------------------


def divide_skip(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Indexes of the members (sorted sets) that link with the query (a sorted set)."""
    sizes = np.array([len(m) for m in members])
    if not len(members) or not len(query):
        return np.zeros(0, np.int64)
    need = required(len(query), sizes)
    # inverted lists of the query's shingles, members ascending in each
    pool = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(query, pool), len(query) - 1)
    hit = query[at] == pool
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    lists = np.split(owner[order], np.searchsorted(at[order], np.arange(1, len(query))))
    lists.sort(key=len, reverse=True)
    # the longest lists aren't merged; a member that links is in need - n_long short ones at least
    least = int(need.min())
    n_long = max(0, min(least - 1, int(least / (MU * np.log2(max(2, len(lists[0]))) + 1))))
    long, short = lists[:n_long], [x.tolist() for x in lists[n_long:]]
    found, counts = [], []
    for member, run in groupby(heapq.merge(*short)):
        if (c := sum(1 for _ in run)) >= need[member] - n_long:
            found.append(member)
            counts.append(c)
    alive, count = np.array(found, np.int64), np.array(counts, np.int64)
    for k, postings in enumerate(long):
        if not len(alive):
            break
        if len(postings):  # binary search of all that are left
            j = np.minimum(np.searchsorted(postings, alive), len(postings) - 1)
            count += postings[j] == alive
        if k % 16 == 15:  # who can't reach the overlap any more goes
            left = count + (n_long - k - 1) >= need[alive]
            alive, count = alive[left], count[left]
    return alive[count >= need[alive]]


def bitmap(s: np.ndarray) -> bytes:
    """Bits at the shingles' low bits: a power of two of them, four a shingle at least."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_link(query: bytes, n: int, members: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Indexes of the members that their bitmaps don't rule out; no pair that links is ruled out.

    The larger bitmap of two is folded to the smaller one's size, so a bit of one
    side alone still stands for a shingle of one side alone.
    """
    alive = np.zeros(len(members), bool)
    by_length = np.array([len(m) for m in members])
    for length in np.unique(by_length):
        at = np.flatnonzero(by_length == length)
        theirs = np.frombuffer(b"".join(members[k] for k in at), np.uint8).reshape(len(at), length)
        own = np.frombuffer(query, np.uint8)
        width = min(length, len(own))
        own = np.bitwise_or.reduce(own.reshape(-1, width), axis=0)
        theirs = np.bitwise_or.reduce(theirs.reshape(len(at), -1, width), axis=1)
        only_own = np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
        only_theirs = np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64)
        most = np.minimum(n - only_own, sizes[at] - only_theirs)
        alive[at] = most >= required(n, sizes[at])
    return np.flatnonzero(alive)


def _rule_out(rows: DataFrame) -> DataFrame:
    """(leader, rep) of the pairs that may link. Rows come sorted as for ``_search``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, query, n, ids, sizes, bits = None, None, 0, [], [], []
        left: list[tuple[int, int]] = []

        def close() -> None:
            if query is not None and ids:
                left.extend((key[0], ids[k]) for k in may_link(query, n, bits, np.array(sizes)))

        for batch in batches:
            for leader, block, kind, doc, size, data in zip(*(batch[c] for c in ("leader", "block", "kind", "id", "n", "bits"))):
                if (leader, block) != key:
                    close()
                    key, query, n, ids, sizes, bits = (leader, block), None, 0, [], [], []
                if kind == 0:
                    query, n = data, size
                elif not ids or ids[-1] != doc:  # a row that is repeated gives its set twice
                    ids.append(doc)
                    sizes.append(size)
                    bits.append(data)
            if left:
                yield pd.DataFrame(left, columns=["leader", "rep"])
                left.clear()
        close()
        if left:
            yield pd.DataFrame(left, columns=["leader", "rep"])

    return rows.mapInPandas(trimmed(run), "leader long, rep long")


def _dealt(pairs: DataFrame, sets: DataFrame, few: bool, *columns: str) -> DataFrame:
    """(leader, block, kind, id, *columns): for blocks of pairs the leader's row, then the members'."""
    blocks = pairs.groupBy("leader").agg(F.expr(f"cast(ceil(count(*) / {MEMBERS}) as int)").alias("blocks"))
    placed = pairs.join(blocks, "leader").select("leader", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep")
    members = placed.select("leader", "block", F.lit(1).alias("kind"), F.col("rep").alias("r"))
    heads = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("leader").alias("r"))
    named = members.unionByName(heads)
    asked = sets.join(F.broadcast(named) if few else named, F.col("r") == F.col("id")).select("leader", "block", "kind", "id", *columns)
    return asked.repartition("leader", "block").sortWithinPartitions("leader", "block", "kind", "id")


def _search(rows: DataFrame) -> DataFrame:
    """Links between leaders and members. Rows come sorted by leader, block, kind: the leader's own set first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, query, ids, sets = None, None, [], []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if query is not None and ids:
                links.extend((key[0], ids[k]) for k in divide_skip(query, sets))

        for batch in batches:
            for leader, block, kind, doc, data in zip(batch["leader"], batch["block"], batch["kind"], batch["id"], batch["data"]):
                if (leader, block) != key:
                    close()
                    key, query, ids, sets = (leader, block), None, [], []
                s = np.frombuffer(data, np.uint64)
                if kind == 0:
                    query = s
                elif not ids or ids[-1] != doc:
                    ids.append(doc)
                    sets.append(s)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
                links.clear()
        close()
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    return rows.mapInPandas(trimmed(run), "a long, b long")


def _bloom(ids: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the only column of ``ids``; None if it has no rows."""
    column = ids.columns[0]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, any_rows = np.zeros(1 << BLOOM_BITS >> 3, np.uint8), False
        for batch in batches:
            for p in _positions(batch[column].to_numpy()):
                np.bitwise_or.at(packed, p >> 3, (1 << (7 - (p & 7))).astype(np.uint8))
            any_rows = any_rows or len(batch) > 0
        if any_rows:
            yield _blocks(packed)

    return _add_up_bits(ids.mapInPandas(trimmed(build), "block int, data binary"))


def _positions(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(k)).astype(np.int64) & ((1 << BLOOM_BITS) - 1) for k in (0, 13, 26)]


def _within(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    keep = np.ones(len(ids), bool)
    for p in _positions(ids):
        keep &= (packed[p >> 3] >> (7 - (p & 7)) & 1).astype(bool)
    return keep


def _let_through(spark: SparkSession, bloom: np.ndarray, column: str) -> Column:
    """Whether the filter lets a row through: true for all that it was made of, and a few others."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(_within(shared.value, ids.to_numpy()))

    return run(F.col(column))


def _candidate_sets(docs: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """(id, n, bits, data): the sets of ``rows``, and of a few others that the Bloom filter lets through."""
    schema = "id long, n int, bits binary, data binary"
    bloom = _bloom(rows)
    if bloom is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            part = batch[_within(shared.value, batch["row"].to_numpy())]
            for lo in range(0, len(part), 500):
                found = []
                for s in shingle_sets(part["text"].iloc[lo : lo + 500]):
                    if len(s) and (key := _signature(s, seed)[0]) not in seen:
                        seen.add(key)
                        found.append((key, len(s), bitmap(s), s.tobytes()))
                yield pd.DataFrame(found, columns=["id", "n", "bits", "data"])

    return docs.selectExpr(*_TEXT).mapInPandas(trimmed(run), schema)


def _add_up_bits(blocks: DataFrame) -> np.ndarray | None:
    """The union of the tasks' bitmaps, in two steps as in ``_add_up``."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch["block"], batch["data"]):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                sums[b] = sums[b] | part if b in sums else part
        yield pd.DataFrame({"block": list(sums), "data": [zlib.compress(v.tobytes(), 1) for v in sums.values()]}, columns=["block", "data"])

    schema = "block int, data binary"
    first = blocks.withColumn("p", F.spark_partition_id()).repartition(64, "block", F.pmod("p", F.lit(32))).select("block", "data").mapInPandas(trimmed(unite), schema)
    rows = first.repartition(16, "block").mapInPandas(trimmed(unite), schema).collect()  # the bitmap itself: a fixed size
    if not rows:
        return None
    found = {r["block"]: np.frombuffer(zlib.decompress(r["data"]), np.uint8) for r in rows}
    return np.concatenate([found[b] for b in range(len(found))])


# --- 5: components -----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        far = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(far, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        step = cut_lineage(step)
        jump = step.select(F.col("node").alias("m"), F.col("mid").alias("top"))
        moved = step.join(jump, F.col("mid") == F.col("m"), "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("label"))
        moved = cut_lineage(moved)
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


# --- 3: rounds ---------------------------------------------------------------------


def _contract(links: DataFrame) -> DataFrame:
    """(node, label): ends of links, with the smallest node of a star of links (a, b) around an a."""
    star = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    members = links.join(star, "a").select(F.col("b").alias("node"), "label")
    return members.unionByName(star.withColumnRenamed("a", "node")).groupBy("node").agg(F.min("label").alias("label"))


def _between(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links (a, b) of representatives as links of their components."""
    own = moved.select(F.col("rep").alias("r"), F.col("comp").alias("c"))
    for end in ("a", "b"):
        links = links.join(own, F.col(end) == F.col("r"), "left").withColumn(end, F.coalesce("c", end)).drop("r", "c")
    return links.filter("a <> b")


def _relabelled(moved: DataFrame, labels: DataFrame) -> DataFrame:
    """``moved`` (rep, comp) after components have taken the ``labels`` (node, label)."""
    kept = moved.join(labels, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("label", "comp").alias("comp"))
    fresh = labels.filter("node <> label").select(F.col("node").alias("rep"), F.col("label").alias("comp"))
    return cut_lineage(kept.unionByName(fresh).groupBy("rep").agg(F.min("comp").alias("comp")))


def _link_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, comp) of representatives whose component isn't their own. ``groups``: h, rep, n, most, comp."""
    spark = groups.sparkSession
    moved = spark.createDataFrame([], "rep long, comp long")
    found = []
    rounds = 0
    while not groups.isEmpty():
        slots = LEADERS[min(rounds, len(LEADERS) - 1)]
        slot = F.pmod(F.xxhash64("rep", F.lit(rounds)), F.lit(slots))
        # partial minima first, so a large group isn't gathered
        best = groups.groupBy("h", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep").alias("o"), "rep", "n", "most", "comp")).alias("l"))
        leaders = cut_lineage(best.select("h", F.col("l.rep").alias("leader"), F.col("l.n").alias("l_n"), F.col("l.most").alias("l_most"), F.col("l.comp").alias("l_comp")))
        met = groups.join(leaders, "h").filter("rep <> leader and comp <> l_comp and n <= l_most and l_n <= most")
        # of two leaders, the pair is asked for once
        pairs = cut_lineage(met.select("leader", "rep").distinct())
        groups = groups.join(leaders.select("h", F.col("leader").alias("rep")), ["h", "rep"], "left_anti")
        if many := pairs.count():
            pairs = cut_lineage(_rule_out(_dealt(pairs, sets, many <= FEW, "n", "bits")))
            many = pairs.count()
            wanted = sets.select("id", "data")
            if many > FEW:
                ends = pairs.select("leader").union(pairs.select("rep"))
                wanted = wanted.filter(_let_through(spark, _bloom(ends), "id"))
            if many:
                links = cut_lineage(_search(_dealt(pairs, wanted, many <= FEW, "data")))
            if many and not links.isEmpty():
                found.append(links)
                moved = _relabelled(moved, _contract(_between(links, moved)))
                now = moved.select(F.col("rep").alias("r"), F.col("comp").alias("c"))
                groups = groups.join(now, F.col("rep") == F.col("r"), "left").select("h", "rep", "n", "most", F.coalesce("c", "comp").alias("comp"))
        # twice, in the same sort: a row may have been kept for one that went
        groups = cut_lineage(_with_partner_elsewhere(_with_partner_elsewhere(groups)))
        rounds += 1
    if found:
        apart = cut_lineage(_between(reduce(DataFrame.union, found), moved))
        if not apart.isEmpty():
            moved = _relabelled(moved, components(apart))
    return moved


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, row, n, key) of each row; (key, low, row, c) of each set; (rep, comp) of sets whose component isn't their own."""
    seed = 0
    while True:
        scan = cut_lineage(_sets_and_sketch(docs, seed))
        own = scan.filter("block < 0").select("doc_id", "row", "n", "key", "more")
        same = (F.min("more") == F.max("more")) & (F.min("n") == F.max("n"))
        keys = cut_lineage(own.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.count(F.lit(1)).alias("c"), same.alias("same")))
        if keys.filter("not same").isEmpty():
            break
        seed += 1  # two sets of one key
    levels = _order_levels(_add_up(scan.filter("block >= 0").select("block", "data"), "u1"))

    # one shuffle of the prefixes; what no other set's prefix meets goes, copies from several tasks become one
    met = _with_partner(_prefixes(docs, levels, seed).repartition("h")).groupBy("h", "rep").agg(F.max("n").alias("n"), F.max("most").alias("most"))
    groups = cut_lineage(_with_partner(met).withColumn("comp", F.col("rep")))
    asked = keys.join(groups.select(F.col("rep").alias("key")).distinct(), "key").select("row")
    moved = _link_groups(groups, cut_lineage(_candidate_sets(docs, asked, seed)))
    return own.drop("more"), keys.drop("same"), moved


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    own, keys, moved = _linked(docs)
    ends = moved.union(moved.select("comp", "comp")).distinct()
    lows = keys.join(ends, F.col("key") == F.col("rep")).groupBy("comp").agg(F.min("low").alias("low"))
    # a component's smallest id is none above that of one of its sets
    names = keys.filter("c > 1").select("key", "low").unionByName(ends.join(lows, "comp").select(F.col("rep").alias("key"), "low"))
    joined = own.join(names.groupBy("key").agg(F.min("low").alias("low")), "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.expr("case when n > 0 and low is not null then low else doc_id end").alias("component_id"))


def keep_one(docs: DataFrame, nameless: bool = False) -> DataFrame:
    """Of each component one row, that of its smallest doc_id, with the columns of ``docs``.

    Of repeated rows of one doc_id and text one stays; rows of one doc_id with
    other texts are documents of their own. Rows with a null doc_id all stay,
    copies too, unless ``nameless``: then they take part, behind all others, and
    only those without words all stay.

    No text moves but that of rows that go or are repeated, and of a few that a
    Bloom filter takes for them.
    """
    own, _, moved = _linked(docs)
    rows = own.join(moved, F.col("key") == F.col("rep"), "left").groupBy("doc_id", "row").agg(F.max("n").alias("n"), F.min(F.coalesce("comp", "key")).alias("comp"), F.count(F.lit(1)).alias("c"))
    rows = cut_lineage(rows.filter("doc_id is not null or n > 0" if nameless else "doc_id is not null"))
    best = rows.filter("n > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")).select("comp", F.col("best.row").alias("best"))
    decided = rows.join(best, "comp", "left").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "c", F.expr("n > 0 and row <> best").alias("__goes"))
    decided = cut_lineage(decided.filter("__goes or c > 1").select("__id", "__row", "__goes"))
    bloom = _bloom(decided.select("__row"))
    if bloom is None:
        return docs
    marked = docs.withColumn("__r", F.expr(_ROW))
    through = _let_through(docs.sparkSession, bloom, "__r")
    met = marked.filter(through).join(decided, (F.col("__r") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = marked.filter(~through).select(docs.columns).unionByName(met.filter("__goes is null").select(docs.columns))
    if not decided.filter("not __goes").isEmpty():
        kept = kept.unionByName(met.filter("not __goes").dropDuplicates(["__id", "__row"]).select(docs.columns))
    return kept


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(load(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 9 * c >= 4 * (x.n + y.n)),
e as (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join (select a, min(b) as low from r group by a) m on m.a = w.doc_id
"""
