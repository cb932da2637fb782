import collections
import re
import struct

import duckdb
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from tracelake.llm import mixing, rules
from tracelake.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours = Q.queries()[name](spark, sf_dir)
    theirs = con.sql(Q.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_pipeline(spark, sf_dir):
    """Every stage returns the columns of documents and keeps clean rows; the last one encodes what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sizes = [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        if n < 4:
            assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        if n == 0:
            good = docs.join(labels, "doc_id").where("quality = 1").count()
            assert good >= 0.85 * labels.where("quality = 1").count()
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] and sizes[4] == sizes[5] > sizes[3]
    assert docs.where("not round_trip").count() == 0


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows_of(df):
    return sorted(df.select(*corpus_pipeline.COLUMNS).collect(), key=str)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    """Documents with repeated rows, nulls, empty and long texts, and columns whose names clash with those of operators."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, __text string"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [docs[3], docs[3], (9001, None, None, None, None), (None, docs[5][1], "en", None, 1), (9002, "", "en", "x", 0), (9003, docs[7][1] + " end é", "en", "x", 5), (9004, "long words " * 20_000, "en", "y", 220_000)]
    return spark.createDataFrame([(*r, 1, "x", "x") for r in docs], kind).repartition(4)


def test_rules_stage_against_a_plain_version(spark, corpus, sf_dir):
    found = rules.fit_rules(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = []
    for r in rules.with_statistics(corpus.select(*corpus_pipeline.COLUMNS)).collect():
        row = r.asDict()
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        at = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if at[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and not any(all(row[c.name] >= c.cut if c.above else row[c.name] <= c.cut for c in rule) for rule in found):
            want.append(tuple(row[c] for c in corpus_pipeline.COLUMNS))
    assert rows_of(corpus_pipeline.quality_rules(spark, corpus, sf_dir)) == sorted(spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long").collect(), key=str)


def test_near_duplicate_stage_against_a_plain_version(spark, corpus, sf_dir):
    docs = corpus.select(*corpus_pipeline.COLUMNS).collect()
    sets = collections.defaultdict(list)
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"] or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if s and r["doc_id"] is not None:
            sets[r["doc_id"]].append(s)
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    seen, want = set(), []
    for r in docs:
        i, key = r["doc_id"], (r["doc_id"], r["text"])
        if i is None or (group.get(i, i) == i and key not in seen):
            want.append(r)
            seen.add(key)
    assert rows_of(corpus_pipeline.near_dedup(spark, corpus, sf_dir)) == sorted(want, key=str)


def test_passage_stage_against_a_plain_version(spark, corpus, sf_dir):
    small = corpus.where("doc_id is null or doc_id < 60 or doc_id > 9000")
    docs = small.select(*corpus_pipeline.COLUMNS).collect()
    least = {}
    order = lambda r: -(2**63) if r["doc_id"] is None else r["doc_id"]
    for r in docs:
        b = (r["text"] or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(order(r), least.get(b[k : k + 50], 2**63))
    want = []
    for r in docs:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < order(r):
                gone[k : k + 50] = b"\1" * 50
        text, at = "", 0
        for c in r["text"] or "":
            n = len(c.encode())
            text += "" if all(gone[at : at + n]) else c
            at += n
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert sorted(map(tuple, corpus_pipeline.passage_dedup(spark, small, sf_dir).collect()), key=str) == sorted(want, key=str)


def test_mixing_stage_against_a_plain_version(spark, corpus, sf_dir):
    want = collections.Counter()
    for r in mixing.mix_sources(corpus, keep=("text", "lang", "n_chars")).collect():
        seed = 42 if r["doc_id"] is None else xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest()
        chance = xxhash.xxh64(struct.pack("<i", 23), seed=seed).intdigest() % (1 << 20) / float(1 << 20)
        times = 1 if r["size"] == 0 else int(r["taken"] / r["size"] + chance)
        want[tuple(r[c] for c in corpus_pipeline.COLUMNS)] += times
    got = collections.Counter(map(tuple, corpus_pipeline.mixing(spark, corpus, sf_dir).collect()))
    assert got == +want


def test_sentencepiece_stage_against_the_library(spark, corpus, sf_dir):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter((r["doc_id"], tuple(theirs.encode(r["text"] or ""))) for r in corpus.select("doc_id", "text").collect())
    got = corpus_pipeline.sentencepiece(spark, corpus, sf_dir).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["round_trip"] for r in got)


def test_stages_take_empty_tables(spark, corpus, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus.limit(0), sf_dir).count() == 0
