"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

Sources' words are laid out as streams, each cut into blocks of equal size. The highest quotients decide how many blocks each
source gives to every shard; those quotas are integers and add up. A source's blocks are then taken in the order of a seeded
permutation in closed form, round after round, each shard going on where the one before has stopped: so a block knows
from its own number which shards take it, and no group is sorted or ranked. The streams' positions come from a prefix
sum in two levels over hashed buckets, so that a source with a third of all rows spreads over many tasks; repeated rows
are counted first and take one place in it.
"""

from __future__ import annotations

import heapq
import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, prepare, written

#: Documents of one bucket of the prefix sum, about.
BUCKET_ROWS = 4096


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight that stop at `most` times a source's size, the excess going to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for i in order:
        share = left * weights[i] / weight if weight > 0 else 0.0
        out[i] = min(share, most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients vote / (2 * seats + 1); ties go to the earlier party; none gets over its `most`."""
    most = most or [seats] * len(votes)
    n, total = len(votes), sum(votes)
    given = [0] * n
    if total <= 0 or seats <= 0:
        return given
    if seats > n / 2:  # all seats above a common quotient at once: votes over a divisor, rounded
        divisor = total / (seats - n / 2)
        given = [min(m, max(0, math.ceil(v / divisor - 0.5) - 1)) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, given, most, strict=True)) if v > 0 and s < m]
    heapq.heapify(heap)
    for _ in range(max(0, seats - sum(given))):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def shard_quotas(votes: list[float], seats: int, shards: int, most: list[int] | None = None) -> list[list[int]]:
    """Quotas per shard: what each further lot of blocks in the order of quotients adds to each source. The highest
    quotients of more seats hold those of fewer, so no quota is negative and all shards together have `seats`."""
    ends = [sainte_lague(votes, seats * (s + 1) // shards, most) for s in range(shards)]
    return [[b - a for a, b in zip(ends[s - 1] if s else [0] * len(votes), ends[s], strict=True)] for s in range(shards)]


def permutation(blocks: int, seed: int, name: str) -> tuple[int, int]:
    """(factor, shift) of a seeded permutation b -> (factor * b + shift) mod blocks."""
    if blocks <= 1:
        return 1, 0
    draw = zlib.crc32(f"{seed}:{name}".encode())
    factor = 1 + draw % (min(blocks, 1 << 31) - 1)  # below 2**31, so that products stay in 64 bits
    while math.gcd(factor, blocks) != 1:
        factor -= 1
    return factor, zlib.crc32(f"{name}:{seed}".encode()) % blocks


def word_count(text: str):
    """Number of words of a text column, null or empty: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Columns of mix_sources; kept columns of these names give way.
OUTPUT = ("size", "source", "source_size", "target", "taken", "n_shards")


def _takes(block_words: int) -> str:
    """Spark expression: (shard, block, words) of every take of a document's words, in the order of its blocks.

    The block of rank r is taken at r, r + blocks, r + 2 * blocks and so on, as long as the source has seats; ends holds
    the seats up to and including each shard.
    """
    rank = "(__factor * b + __shift) % __blocks"
    words = f"least(__start + __size, (b + 1) * {block_words}) - greatest(__start, b * {block_words})"
    turn = "element_at(__ends, -1)"
    return f"""
        if(__size = 0 OR {turn} = 0, cast(array() AS array<struct<shard: int, block: bigint, words: bigint>>), flatten(transform(
            sequence(__start div {block_words}, (__start + __size - 1) div {block_words}),
            b -> if({rank} >= {turn}, cast(array() AS array<struct<shard: int, block: bigint, words: bigint>>), transform(
                sequence({rank}, {turn} - 1, __blocks),
                t -> struct(size(filter(__ends, e -> e <= t)) AS shard, b AS block, {words} AS words))))))"""


def _placed(docs: DataFrame, weights, share, most, block_words, seed, shards, id_col, text_col, source_col, keep) -> DataFrame:
    """Rows with their place in their source's stream and the plan of the source, repeated rows included, and `keep`."""
    spark = prepare(docs.sparkSession)
    key = ["__id", "__source", "__size", "__tie"]
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), word_count(text_col).alias("__size"), F.xxhash64(text, *keep).alias("__tie"), *keep)
    light = written(sized.groupBy(*key).agg(F.count("*").alias("__times")), "sizes")  # the texts stay in place
    found = sorted(light.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__times")).alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["__source"] is None, (r["__source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    blocks = [-(-s // block_words) for s in sizes]
    quotas = shard_quotas(goal, round(sum(goal) / block_words), shards, [int(most * b) for b in blocks])
    plan = []
    for i, (r, size, target, n) in enumerate(zip(found, sizes, goal, blocks, strict=True)):
        ends, total = [], 0
        for quota in quotas:
            total += quota[i]
            ends.append(total)
        plan.append((r["__source"], size, float(target), max(n, 1), ends, *permutation(n, seed, repr(r["__source"]))))
    kind = "__source string, __source_size long, __target double, __blocks long, __ends array<long>, __factor long, __shift long"
    table = F.broadcast(spark.createDataFrame(plan, kind))  # a row per source, as collected above
    buckets = max(1, sum(r["n"] for r in found) // BUCKET_ROWS)
    placed = light.withColumn("__bucket", F.pmod(F.xxhash64("__id", "__tie"), F.lit(buckets))).withColumn("__words", F.col("__size") * F.col("__times"))
    whole = placed.groupBy("__source", "__bucket").agg(F.sum("__words").alias("__words"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = whole.select("__source", "__bucket", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__head"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("__inner", F.coalesce(F.sum("__words").over(inside), F.lit(0)))
    same = F.col("a.__source").eqNullSafe(F.col("b.__source"))
    at = at.alias("a").join(heads.alias("b"), same & (F.col("a.__bucket") == F.col("b.__bucket"))).select(*(f"a.{c}" for c in key), "__times", (F.col("__head") + F.col("__inner")).alias("__start"))
    at = at.alias("a").join(table.alias("b"), same).select("a.*", *(f"b.{f.split()[0]}" for f in kind.split(", ")[1:]))
    if keep:
        at = written(at, "places").alias("t")
        on = F.col("d.__size") == F.col("t.__size")
        for c in ("__id", "__source", "__tie"):
            on &= F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
        at = sized.alias("d").join(at, on).select(*(f"d.{c}" for c in (*key, *keep)), *(f"t.{c}" for c in at.columns if c not in key))
        at = at.where("__times = 1").unionByName(at.where("__times > 1").dropDuplicates(key))  # equal rows: one, and its number
    return at.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))).withColumn("__start", F.col("__start") + F.col("__copy") * F.col("__size"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 32,
    seed: int = 11,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, size, source, source_size, target, taken (words that the mix takes, repeats counted), n_shards (shards
    that take some of them), and `keep`.

    Sources in the order of code points, null last, weigh `weights` in turn and share `share` times all words; no target
    goes over `most` times its source. One row per source is collected: the number of sources, not of documents, bounds the
    driver. Empty and null texts have size 0 and give nothing; a source without words has target 0; repeated rows count
    each and follow each other; rows of equal id are ordered by size and text hash; texts of any length are cut into blocks;
    kept columns with the name of an output give way to it; an empty table gives no rows; reruns agree.
    """
    own = tuple(c for c in keep if c.lower() not in {*OUTPUT, id_col.lower()})
    at = _placed(docs, weights, share, most, block_words, seed, shards, id_col, text_col, source_col, own)
    took = at.withColumn("__takes", F.expr(_takes(block_words)))
    taken = F.expr("aggregate(__takes, 0L, (sum, x) -> sum + x.words)")
    return took.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), F.size(F.array_distinct("__takes.shard")).alias("n_shards"), *own)


def mix_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 32, seed: int = 11, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (shard, source, block, id, first_word, n_words) for every stretch of a document's words that a shard
    takes, as often as it is taken. Settings and defined cases as in mix_sources; documents that give nothing have no row."""
    at = _placed(docs, weights, share, most, block_words, seed, shards, id_col, text_col, source_col, ())
    each = at.select("__id", "__source", "__start", F.explode(F.expr(_takes(block_words))).alias("__take"))
    first = F.greatest(F.lit(0), F.col("__take.block") * block_words - F.col("__start"))
    return each.select(F.col("__take.shard").alias("shard"), F.col("__source").alias("source"), F.col("__take.block").alias("block"), F.col("__id").alias(id_col), first.alias("first_word"), F.col("__take.words").alias("n_words"))
