"""Near duplicates by MinHash bands, odd sketches and an exact check on full shingle sets.

1. One pass over the texts gives each document the size and digest of its shingle set, its MinHash bands, and its odd
   sketch: a parity bitmap into which every MinHash sample flips one bit. Documents with equal sets are one class.
2. Class representatives that share a band value are candidates. First each bucket has a leader, and each member
   is paired with the leaders of a few of its buckets; XOR population counts of the sketches estimate the similarity and
   drop hopeless pairs; the rest is checked exactly.
3. Buckets that still hold more than one component form families (members that buckets connect). A family is cut into
   blocks, and every two blocks meet in one task that has their texts: pairs of different components that share a band and
   whose sketches allow it are checked exactly there, most alike first, until their components are one. Only links leave
   the task. So no candidate pair is lost: a pair that is never compared lies within one component already.
4. Links become components; copies of a class take over its component.

Buckets are joined on their key, so Spark can split a large one; the texts of a popular leader go to salted groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import hashing as H
from tracelake.llm.common import long_column, prepare, row_slices, text_bytes, written
from tracelake.llm.graph import components

#: Rows of a side that is broadcast at most (16 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Groups that a leader's members are dealt to; members stream past the leader's set, so no group is held in memory.
SALTS = 16
SLICE = 1 << 19
#: Words of 64 parity bits of a sketch, and MinHash samples folded into it.
SKETCH_WORDS = 16
SKETCH_SAMPLES = 256
#: Leaders that a member is paired with in a star round.
PICKS = 3
#: Members of a block of a family; two blocks meet in one task.
BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words has its whole word sequence as one."""
    words, first = H.words_of(data, offsets)
    length = np.diff(first)
    spread = np.uint64(0x9FB21C651E98DF25)
    full = np.zeros(0, np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            full = full * spread + words[i : len(words) - k + 1 + i]
        full = H.mix(full + np.uint64(k))
    out = []
    for i, n in enumerate(length):
        if n >= k:
            out.append(np.unique(full[first[i] : first[i] + n - k + 1]))
        elif n:
            value = words[first[i] : first[i] + 1].copy()
            for w in words[first[i] + 1 : first[i] + n]:
                value = value * spread + w
            out.append(H.mix(value + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minhash(sets: list[np.ndarray], samples: int, seed: int) -> np.ndarray:
    """samples x rows smallest values of 32 bits; empty rows have no meaning here."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
    size = np.array([len(s) for s in sets])
    some = np.flatnonzero(size)
    out = np.zeros((samples, len(sets)), dtype=np.uint32)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        for i in range(samples):
            out[i, some] = np.minimum.reduceat((flat ^ flip[i]) * odd[i], start)
    return out


def _sketch(samples: np.ndarray) -> np.ndarray:
    """Odd sketch of each column: SKETCH_WORDS words of 64 parity bits."""
    n, rows = samples.shape
    key = H.mix(samples.astype(np.uint64) + (np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))[:, None])
    bit = (key % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    width = 64 * SKETCH_WORDS
    count = np.bincount((bit + np.arange(rows) * width).ravel(), minlength=rows * width).reshape(rows, width)
    return np.packbits((count & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest, s0.. sketch words, bands): one row per document; empty sets have a null digest."""
    samples = max(SKETCH_SAMPLES, bands * rows)
    names = [f"s{i}" for i in range(SKETCH_WORDS)]
    kind = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), *((s, pa.int64()) for s in names), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                low = _minhash(sets, samples, seed)
                sketch = _sketch(low)
                band = np.zeros((bands, len(sets)), dtype=np.uint64)
                for r in range(rows):
                    band = H.mix(band * np.uint64(0x9FB21C651E98DF25) + low[r : bands * rows : rows] + np.uint64(1))
                band = H.mix(band + np.arange(bands, dtype=np.uint64)[:, None]).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(band.T).ravel()))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), *(pa.array(np.ascontiguousarray(sketch[:, w]).view(np.int64)) for w in range(SKETCH_WORDS)), flat],
                    schema=kind,
                )

    spark_type = "id long, n_shingles long, digest binary, " + ", ".join(f"{s} long" for s in names) + ", bands array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, spark_type)


def _likeness(a: str, b: str, samples: int):
    """Similarity that the XOR of two odd sketches lets expect (a Spark expression)."""
    bits = 64.0 * SKETCH_WORDS
    odd = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    part = F.least(1 - 2 * odd / bits, F.lit(1.0))
    return F.when(part <= 0, F.lit(0.0)).otherwise(1 + bits * F.log(part) / (4 * samples))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    spark = pairs.sparkSession
    dealt = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")), "pairs")
    roles = dealt.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("role")).union(dealt.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("role")).distinct())
    ids = roles.select("id").distinct()
    if (n := ids.count()) == 0:
        return spark.createDataFrame([], "a long, b long")
    needed = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id")
    groups = roles.join(needed, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, leads = None, np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            a, ident, role = (batch.column(c).to_numpy() for c in ("a", "id", "role"))
            found = []
            for i, j in row_slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                for row, own in zip(range(i, j), sets, strict=True):
                    if role[row] == 0:
                        leader, leads = a[row], own
                        continue
                    assert leader == a[row]
                    if _linked(own, leads, percent):
                        found.append((a[row], ident[row]))
            if found:
                left, right = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return groups.select("a", "id", "role", "text").mapInArrow(run, "a long, b long")


def _between_components(rest: DataFrame, side: DataFrame, docs: DataFrame, k: int, percent: int, floor: float, samples: int) -> DataFrame:
    """Links (a, b) between components of a family, enough of them to join all that links join.

    rest: band, id, component of open buckets; side: id, sketch, bands.
    """
    low = rest.groupBy("band").agg(F.min("id").alias("a"))
    family = components(rest.join(low, "band").where("id <> a").select("a", F.col("id").alias("b"))).withColumnRenamed("component", "family")
    members = written(rest.select("id", "component").distinct().join(family, "id"), "families")
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    own = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    meet = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", "component", "family", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    ids = members.select("id").distinct()
    needed = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id").join(side, "id")
    groups = meet.join(needed, "id").select("family", "i", "j", "block", "id", "component", "text", "bands", F.array(*(f"sketch.s{w}" for w in range(SKETCH_WORDS))).alias("sketch")).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "id")

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        data, offsets = text_bytes(pa.array([r[4] for r in rows], pa.large_string()))
        sets = [s for x, y in row_slices(offsets, SLICE) for s in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k)]
        block, ids, comp = (np.array([r[c] for r in rows]) for c in (1, 2, 3))
        bands, sketch = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        left, right = np.flatnonzero(block == block[0]), np.flatnonzero(block == block[-1])
        within = block[0] == block[-1]
        found, root = [], {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        pairs = []
        for x in left:
            ys = right[(comp[right] != comp[x]) & (right > x if within else True)]
            ys = ys[(bands[ys] == bands[x]).any(axis=1)]
            if len(ys):
                odd = np.bitwise_count((sketch[ys] ^ sketch[x]).view(np.uint64)).sum(axis=1)
                part = np.maximum(1 - 2 * odd / (64.0 * SKETCH_WORDS), 1e-9)
                alike = 1 + 64.0 * SKETCH_WORDS * np.log(part) / (4 * samples)
                pairs += [(-a, int(x), int(y)) for a, y in zip(alike, ys, strict=True) if a >= floor]
        for _, x, y in sorted(pairs):
            a, b = top(int(comp[x])), top(int(comp[y]))
            if a != b and _linked(sets[x], sets[y], percent):
                root[max(a, b)] = min(a, b)
                found.append((int(ids[x]), int(ids[y])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (found := links(held)):
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "i", "j", "block", "id", "component", "text", "bands", "sketch")]
            for f, i, j, block, ident, component, text, bands, sketch in zip(*columns, strict=True):
                if (f, i, j) != key:
                    yield from out()
                    key, held = (f, i, j), []
                held.append((0, block, ident, component, text, bands, sketch))
        yield from out()

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 28,
    rows: int = 4,
    seed: int = 7,
    floor: float = 0.68,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked if 100 * intersection >= percent * union holds for their sets of shingles of
    `shingle_words` words (A-Z lower-cased; fewer words: the whole sequence as one shingle). Bands miss a pair of
    similarity 0.8 with a chance of (1 - 0.8**rows)**bands, 4e-7 at the defaults, and pairs that the sketches put below
    `floor` are not checked: the estimate of a pair at 0.8 has a deviation of 0.027, so that takes 4.4 deviations (6e-6).
    Defined cases: null or blank texts have an empty set and are linked with nothing; repeated rows of one id and text
    give as many equal result rows; rows of one id and different texts are linked as one document that has each of these
    texts, where a leader's text is the last one met; a null id takes part as null and stands alone; texts of any length
    are taken whole; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(docs, shingle_words, bands, rows, seed, id_col, text_col), "signatures")
    usable = sig.where("digest is not null and id is not null")
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"))
    member = usable.select("id", "digest").distinct().join(classes, "digest").select("id", "rep", "digest")
    sketch = F.struct(*(f"s{i}" for i in range(SKETCH_WORDS)))
    reps = written(usable.join(classes.withColumnRenamed("rep", "id"), ["id", "digest"], "left_semi").select("id", "digest", sketch.alias("sketch"), "bands").dropDuplicates(["id", "digest"]), "representatives")
    keyed = reps.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = written(keyed.join(shared, "band").withColumn("component", F.col("id")), "buckets")
    samples = max(SKETCH_SAMPLES, bands * rows)
    side = reps.select("id", "sketch", "bands")

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among pairs, by sketches and then exactly."""
        left = side.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
        right = side.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
        likely = pairs.join(right, "b").join(left, "a").where(_likeness("x", "y", samples) >= floor).select("a", "b")
        return written(_exact(likely, texts.where("id is not null"), shingle_words, percent), "links")

    def open_only(labels: DataFrame) -> DataFrame:
        """Rows of buckets that hold more than one component, with the component of each member."""
        named = buckets.drop("component").join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
        return written(named.join(written(mixed, "mixed"), "band"), "open")

    def star(rows_: DataFrame, salt: int) -> DataFrame:
        """Pairs of each member with leaders of PICKS of its buckets, of another component than its own."""
        lead = rows_.groupBy("band").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(salt)) if salt else F.col("id")).alias("lead"))
        # both sides come from files, so that Spark can split a large bucket
        with_lead = rows_.join(written(lead, "leaders"), "band").where("component <> lead.component").select("id", F.col("lead.id").alias("leader"))
        picks = with_lead.groupBy("id").agg(*(F.min_by("leader", F.xxhash64("leader", F.lit(salt + i))).alias(f"l{i}") for i in range(PICKS)))
        pairs = picks.select("id", F.explode(F.array_distinct(F.array(*(f"l{i}" for i in range(PICKS))))).alias("leader"))
        return pairs.select(F.col("leader").alias("a"), F.col("id").alias("b"))

    labels = written(components(checked(star(buckets, 0))), "components")
    rest = open_only(labels)
    links = labels.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))  # stars say the same in fewer edges
    if not rest.isEmpty():
        links = links.union(written(_between_components(rest, side, texts.where("id is not null"), shingle_words, percent, floor, samples), "links"))
    same = member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = components(links.union(same).distinct())
    out = sig.select("id", "n_shingles").join(found, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
