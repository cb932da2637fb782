"""Stupid-backoff scores from n-gram counts of the whole corpus, as joins of tables.

Every text is exploded to rows (text, n-gram, occurrences); an n-gram is a 64-bit hash of its words. The rows of one length
are partitioned by that hash once, and in its partition each n-gram's count meets the rows that need it: the count table
of a hash range and its join to the exploded n-grams are one pass over sorted rows (a window over the hash), as both
sides would be dealt alike. So counting and looking up share one shuffle and no table is ever in one place. What a text
gets from a range is summed before it leaves it, and summed per document at the end.

Score of a word after its context: count(n-gram) / count(context), if the n-gram occurs `least` times; otherwise `backoff` times
the score with the first context word dropped. Unigrams: count / number of words in the corpus.

With least = 1 an n-gram of the corpus itself is always found, and a document's sum needs two lengths only: contexts of
one word are n-grams of the word before, so below the longest two lengths they cancel. With more, each n-gram that is
found adds what it changes against the next shorter one, a number of its own; a text's sum is then a join with that table.

The most frequent n-grams of a sample of documents (HEAVY of them at most; the sample only decides where rows go) are
counted over all texts first and sent to all tasks, which score them in place. So no row of a frequent n-gram moves, no
hash range is loaded by one, and what is shuffled are the rows of rare n-grams, some hundred in one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import hashing as H
from tracelake.llm.common import prepare, row_slices, text_bytes, trim, written

SPREAD = np.uint64(0x9FB21C651E98DF25)
SLICE = 2 << 20
#: N-grams whose counts are sent to all tasks, at most (16 bytes each), and documents that they are found in, about.
HEAVY = 1 << 19
SAMPLED_ROWS = 8_000
#: Ranges of hashes per shuffle partition.
SPREADING = 8
WIDE = "k long, g long, n int, w int, pre long, suf long, mid long"
LIGHT = "bucket int, k array<long>, g array<long>, n array<int>, w array<int>, own_k long, own_s double"


def _keys(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1.. the key of the n-gram that ends at each word; without n - 1 words before it that has no meaning."""
    keys, run = [H.mix(words + np.uint64(1))], words.copy()
    for n in range(2, order + 1):
        shifted = np.zeros_like(run)
        shifted[1:] = run[:-1]
        run = shifted * SPREAD + words
        keys.append(H.mix(run + np.uint64(n)))
    return keys


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k of each text, word hashes, first word of each text with the total at the end) of some texts (k, text) at a time."""
    data, offsets = text_bytes(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for i, j in row_slices(offsets, SLICE):
        yield ids[i:j], *H.words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def wide_grams(texts: DataFrame, level: int) -> DataFrame:
    """(k, g, n, w, pre, suf, mid) of every occurrence of an n-gram of `level` words in texts (k, text): its key, one, one, and
    the keys of the n-gram without its last, first, and both words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, first in _slices(batch):
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                keys = _keys(words, level)
                ends = np.flatnonzero(np.arange(len(words)) - first[doc] >= level - 1)
                more = [keys[level - 2][ends - 1], keys[level - 2][ends]] if level > 1 else []
                more += [keys[level - 3][ends - 1]] if level > 2 else []
                more += [np.zeros(len(ends), np.uint64)] * (3 - len(more))
                one = np.ones(len(ends), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[ends]]), pa.array(keys[level - 1][ends].view(np.int64)), pa.array(one), pa.array(one), *(pa.array(c.view(np.int64)) for c in more)], names=[f.split()[0] for f in WIDE.split(", ")])
        trim()

    return texts.mapInArrow(run, WIDE)


def _weighted(words: np.ndarray, first: np.ndarray, level: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, weight) of every occurrence of an n-gram of `level` words, where least = 1.

    An n-gram of `order` words is scored and counts once; one of order - 1 words is the context of the word after it and
    counts once less, unless it begins the text (then it is scored as well) or ends it; a shorter one is scored, but not
    needed as a context, only where it is the whole text.
    """
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(words)) - first[doc]
    ends = np.flatnonzero(at >= level - 1)
    doc, at = doc[ends], at[ends]
    m = size[doc]
    if level == order:
        w = np.ones(len(ends), np.int32)
    elif level == order - 1:
        w = np.where(m <= level, 1, np.where((at >= level) & (at <= m - 2), -1, 0)).astype(np.int32)
    else:
        w = (m == level).astype(np.int32)
    return doc, _keys(words, level)[level - 1][ends], w


class _Heavy:
    """Sorted keys with a value each, looked up for many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in keys, places among the heavy ones) of those that are heavy."""
        some = np.flatnonzero(self.maybe[(keys >> self.shift).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return some[:0], some[:0]
        place = np.searchsorted(self.keys, keys[some])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == keys[some]
        return some[hit], place[hit]


def _heavy_counts(texts: DataFrame, sample: DataFrame, levels: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts over all texts of the n-grams that are most frequent in the sample: HEAVY at most reach the driver."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, first in _slices(batch):
                g, n = np.unique(np.concatenate([_weighted(words, first, level, order)[1] for level in levels]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["g", "n"])

    held = written(sample.mapInArrow(keys, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"), "frequent")
    least, sofar = None, 0
    for r in sorted(held.groupBy("n").count().collect(), key=lambda r: -r["n"]):  # a row per frequency of the sample
        if sofar + r["count"] > HEAVY:
            break
        least, sofar = r["n"], sofar + r["count"]
    none = np.zeros(0, np.int64)
    if least is None:
        return none.view(np.uint64), none
    found = held.where(F.col("n") >= least).select("g").toArrow().column("g").to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = _Heavy(sent.value, np.zeros(len(sent.value)))
        total = np.zeros(len(heavy.keys), dtype=np.int64)
        for batch in batches:
            for _, words, first in _slices(batch):
                for level in levels:
                    total += np.bincount(heavy.find(_weighted(words, first, level, order)[1])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(heavy.keys[some].view(np.int64)), pa.array(total[some])], names=["g", "c"])
        trim()

    table = texts.mapInArrow(counted, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).toArrow()
    return table.column("g").to_numpy().view(np.uint64), table.column("c").to_numpy()


def _light(texts: DataFrame, levels: list[int], order: int, heavy: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Rows of LIGHT: a range's rare n-grams of some texts, with arrays of text, key, occurrences and weight; and per text what
    it gets from heavy n-grams."""
    sent = texts.sparkSession.sparkContext.broadcast((heavy[0], np.log10(np.maximum(heavy[1], 1))))

    def arrays(bucket, ids, g, n, w) -> pa.RecordBatch:
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), bucket[1:] != bucket[:-1]]))
        ends = pa.array(np.append(head, len(g)).astype(np.int32))
        none = pa.nulls(len(head))
        return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids, g.view(np.int64), n, w)), none.cast(pa.int64()), none.cast(pa.float64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Heavy(*sent.value)
        for batch in batches:
            for ids, words, first in _slices(batch):
                own = np.zeros(len(ids))
                docs, keys, weights = [], [], []
                for level in levels:
                    doc, g, w = _weighted(words, first, level, order)
                    at, place = table.find(g)
                    own += np.bincount(doc[at], w[at] * table.values[place], len(ids))
                    rest = np.ones(len(g), bool)
                    rest[at] = False
                    docs.append(doc[rest])
                    keys.append(g[rest])
                    weights.append(w[rest])
                doc, g, w = np.concatenate(docs), np.concatenate(keys), np.concatenate(weights)
                # occurrences in one text are one entry; should a hash part equal ones, they are two, which changes nothing
                order_ = np.argsort(H.mix(g + doc.astype(np.uint64) * SPREAD))
                d, k = doc[order_], g[order_]
                head = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
                doc, g = d[head], k[head]
                n = np.diff(np.append(head, len(d))).astype(np.int32)
                w = (np.add.reduceat(w[order_], head) if len(head) else w).astype(np.int32)
                bucket = (g % np.uint64(buckets)).astype(np.int64)
                order_ = np.argsort(bucket * len(ids) + doc)
                yield arrays(bucket[order_], ids[doc[order_]], g[order_], n[order_], w[order_])
                some = np.flatnonzero(own)
                none = [pa.nulls(len(some), t) for t in (kind.field(c).type for c in range(1, 5))]
                yield pa.RecordBatch.from_arrays([pa.array(((ids[some] + some) % buckets).astype(np.int32)), *none, pa.array(ids[some]), pa.array(own[some])], schema=kind)
        trim()

    kind = pa.schema([("bucket", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("k", "g")), *((c, pa.list_(pa.int32())) for c in ("n", "w")), ("own_k", pa.int64()), ("own_s", pa.float64())])
    return texts.mapInArrow(run, LIGHT)


def _sums(texts: DataFrame, sample: DataFrame, levels: list[int], order: int) -> DataFrame:
    """(k, s) of each text where least = 1: weights times the logarithms of counts, summed."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _light(texts, levels, order, _heavy_counts(texts, sample, levels, order), SPREADING * parts).repartition(parts, "bucket")
    rows = dealt.select("bucket", "own_k", "own_s", F.inline_outer(F.arrays_zip("k", "g", "n", "w")))
    counted = rows.withColumn("c", F.sum("n").over(Window.partitionBy("bucket", "g")))
    part = F.when(F.col("own_k").isNotNull(), F.col("own_s")).otherwise(F.col("w") * F.log10("c"))
    return counted.where("own_k is not null or c > 1").select(F.coalesce("own_k", "k").alias("k"), part.alias("s")).groupBy("k").agg(F.sum("s").alias("s"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(id, k, n_words) of texts (k, text, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            count = [np.zeros(0, np.int64)]
            for i, j in row_slices(offsets, SLICE):
                flat, starts = H.joined(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count.append(np.diff(np.append(np.searchsorted(first := H.word_spans(flat)[0], starts), len(first))))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(np.concatenate(count), pa.int64())], names=["id", "k", "n_words"])

    return texts.mapInArrow(run, "id long, k long, n_words long")


def _changes(texts: DataFrame, order: int, least: int, backoff: float, total: int) -> DataFrame:
    """(k, s): parts of each text's score, where longer n-grams count from `least` occurrences on.

    The unigram score of each word, and for each longer n-gram that is found, what it adds to the score that the n-gram
    without its first word gives.
    """
    every = [written(wide_grams(texts, n), "grams") for n in range(1, order + 1)]
    counts = [written(e.groupBy("g").agg(F.sum("n").alias("c"), *(F.first(x).alias(x) for x in ("pre", "suf", "mid"))), "counts") for e in every]
    lone = F.lit(float(total)).alias("c")
    parts = every[0].join(counts[0].select("g", "c"), "g").select("k", (F.col("w") * (F.log10("c") - float(np.log10(max(total, 1))))).alias("s"))
    for n in range(2, order + 1):
        short = [counts[n - 2].select(F.col("g").alias(x), F.log10("c").alias(f"{x}_c")) for x in ("pre", "suf")]
        found = counts[n - 1].where(F.col("c") >= least).join(short[0], "pre").join(short[1], "suf")
        found = found.join(counts[n - 3].select(F.col("g").alias("mid"), F.log10("c").alias("mid_c")), "mid") if n > 2 else found.withColumn("mid_c", F.log10(lone))
        change = found.select("g", (F.log10("c") - F.col("pre_c") - F.col("suf_c") + F.col("mid_c") - float(np.log10(backoff))).alias("d"))
        parts = parts.unionByName(every[n - 1].join(change, "g").select("k", (F.col("w") * F.col("d")).alias("s")))
    return parts


def backoff_scores(docs: DataFrame, order: int = 3, least: int = 1, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, log10_score (sum over its words), mean_log10 (per word; null without words).

    Words are runs of anything but blanks, A-Z lower-cased. Null or blank texts have no words and score 0; texts of any length
    are scored whole; null ids come back as null; repeated rows count and are scored each; an empty table gives no rows;
    other columns are ignored. Texts are told apart by a 64-bit hash of id and text, n-grams by one of their words.
    """
    if order < 1 or least < 1:
        raise ValueError("order and least start at 1")
    prepare(docs.sparkSession)
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(F.coalesce(id_.cast("string"), F.lit("null")), text).alias("k"), text.alias("text"), id_.alias("id"))
    base = written(_word_counts(texts), "word-counts")
    total, n_rows = base.agg(F.sum("n_words"), F.count("*")).first()
    log_total, log_back = float(np.log10(max(total or 0, 1))), float(np.log10(backoff))
    own = base.groupBy("id", "k", "n_words").agg(F.count("*").alias("times"))
    if least == 1:
        sample = texts.select("k", "text").sample(fraction=min(1.0, SAMPLED_ROWS / max(n_rows, 1)), seed=7)  # by rows: equal texts count each
        short = {r["n_words"] for r in own.where((F.col("n_words") > 0) & (F.col("n_words") < order - 1)).select("n_words").distinct().collect()}  # fewer than order of them
        levels = sorted({order, *((order - 1,) if order > 1 else ()), *short})
        sums = _sums(texts.select("k", "text"), sample, levels, order)
        missing: Column = F.lit(log_total) * (F.col("n_words") if order == 1 else F.lit(1))  # the first word is no n-gram's end but its own
    else:
        sums = _changes(texts.select("k", "text"), order, least, backoff, total or 0).groupBy("k").agg(F.sum("s").alias("s"))
        m = F.col("n_words")  # what every word has lost that is found as a unigram only
        steps = sum((F.greatest(m - n, F.lit(0)) for n in range(1, order)), F.lit(0))
        missing = -steps * log_back
    # rows of one id and text have one key: their sum is of all of them
    score = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("s") / F.col("times"), F.lit(0.0)) - missing)
    out = own.join(sums, "k", "left").withColumn("score", score).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.col("id").alias(id_col), "n_words", F.col("score").alias("log10_score"), F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_log10"))
