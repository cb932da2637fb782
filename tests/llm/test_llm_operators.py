"""Each operator against a plain version on a small table with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import json
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import blocks, fingerprint, fm, graph, lm, mixing, neardup, passages, queries, records, rules, spm, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, band long, n_words string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def made():
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdeéß"), rng.integers(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab, n))

    base, shared = prose(120), prose(40)
    words = base.split(" ")
    near = " ".join(["new", *words[1:]])
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(words))
    texts = [base, base, near, far, None, "", "  \n\t ", "one", "One", "two words", prose(30) + "\n" + shared, shared + "\n" + prose(30), "x" * 60 + prose(9), "y" + "x" * 60, "日本語 テスト 🙂 " * 12, "a b a b " * 40, prose(3000), "#bad# *sym* $$$ " * 30, prose(50), prose(50), "line one is here\nline one is here\n\nlast line", "tail space ", "two  blanks", "<|endoftext|> <s>"]
    rows = [(i, t, "en", ["a", "b", None, "ü"][i % 4], len(t or ""), "clash", 7, "clash") for i, t in enumerate(texts)]
    return rows + [(7, "one", "en", "b", 3, "clash", 7, "clash")]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_near_duplicates(spark, docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = neardup.near_duplicates(docs, shingle_words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), group[r["doc_id"]], group[r["doc_id"]] == r["doc_id"])
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicate_families_lose_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(80, k % 9, replace=False):
            words[at] = f"z{k}-{at}"
        texts.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(76)} for k, t in texts}
    group = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == group


def test_components_in_steps_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-50, 900, (600, 2))] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(80):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    assert dict(graph.components(df).collect()) == root
    monkeypatch.setattr(graph, "IN_TASK", 10)
    assert dict(graph.components(df).collect()) == root
    assert graph.components(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(0, "http://a.b/ü c", "x" * 120), (1, None, "x" * 120), (2, "u", None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (6, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", "x" * 120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.archive_round_trip(df).collect() if r["page_id"] is not None)
    want = []
    for p, _, h in pages:
        if p is not None:
            body = (h or "").encode()
            refers = 0 if p == 1 else None
            want.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want)
    index = warc.write_warc(df, warc.scratch(spark, "some"))
    some = warc.read_warc(index.where("page_id IN (0, 6)"), payloads=True).collect()
    assert sorted(bytes(r["body"]).decode() for r in some) == sorted(h for p, _, h in pages if p in (0, 6))
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("body", "size", "digest", "original", "refers_to", "file", "n")))
    assert sorted(map(str, warc.archive_round_trip(clash).collect())) == sorted(map(str, warc.archive_round_trip(df).collect()))
    twice = warc.read_warc(index.where("page_id = 1").unionByName(index.where("page_id = 1"))).collect()
    assert len(twice) == 2


def test_ranges_coalesce(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 10), ("f", 1000, 5), ("g", 0, 3)], "file string, offset long, length long")
    got = sorted((r["file"], r["start"], r["stop"], len(r["records"])) for r in warc.ranges(index, gap=100).collect())
    assert got == [("f", 0, 20, 2), ("f", 1000, 1005, 1), ("g", 0, 3, 1)]


def test_highest_quotients():
    votes, seats = [530.0, 240.0, 0.0, 240.0, 9.0], 37
    ranked = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(seats) if v), reverse=True)[:seats]
    want = collections.Counter(-i for _, i in ranked)
    assert mixing.sainte_lague(votes, seats) == [want[i] for i in range(5)]
    shards = mixing.shard_quotas(votes, seats, 4)
    assert [sum(s[i] for s in shards) for i in range(5)] == mixing.sainte_lague(votes, seats)
    assert mixing.targets([10, 100, 100], [5, 2, 1], 150, 2.0) == pytest.approx([20, 260 / 3, 130 / 3])
    factor, shift = mixing.permutation(97, 1, "a")
    assert sorted((factor * b + shift) % 97 for b in range(97)) == list(range(97))


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_sources(docs, block_words=8).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, source, *_ in rows:
        size[source] += len(WORD.findall(t or ""))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([size[s] for s in order], [5, 2, 1, 5], 1.5 * sum(size.values()), 2.0)
    for s, g in zip(order, goal, strict=True):
        assert abs(taken[s] - g) <= 17
    again = mixing.mix_sources(docs.repartition(5), block_words=8).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(empty).count() == 0
    # shards: each has its quota of blocks of every source, and together they are what is taken
    blocks = mixing.mix_blocks(docs, block_words=8, shards=5).collect()
    words = collections.Counter()
    used = collections.defaultdict(collections.Counter)
    for b in blocks:
        words[b["doc_id"]] += b["n_words"]
        used[b["shard"], b["source"]][b["block"]] += b["n_words"]
    assert words == {k: v for k, v in collections.Counter({r["doc_id"]: 0 for r in got}).items() if v} | {k: sum(r["taken"] for r in got if r["doc_id"] == k) for k in words}
    assert sum(words.values()) == sum(taken.values())
    seats = round(sum(goal) / 8)
    quotas = mixing.shard_quotas(goal, seats, 5, [int(2.0 * -(-size[s] // 8)) for s in order])
    for n, quota in enumerate(quotas):
        for s, q in zip(order, quota, strict=True):
            full = -(-sum(used[n, s].values()) // 8)
            assert full <= q and len(used[n, s]) <= q
    assert all(0 <= b["first_word"] and b["n_words"] <= 8 for b in blocks)
    assert [r for r in got if r["taken"]] and all((r["n_shards"] > 0) == (r["taken"] > 0) for r in got)
    kept = mixing.mix_sources(docs, block_words=8, keep=("text",))
    assert kept.count() == len(rows) and "text" in kept.columns


def test_mixing_numbers_repeated_rows_and_survives_clashes(spark):
    six = spark.createDataFrame([(1, "a b c d e f g h i " * 2, "s", 5, "k", 0, 9)] * 6 + [(None, None, None, 1, "k", 0, 9)] * 2, "doc_id long, text string, source string, size long, taken string, tie int, id int").repartition(3)
    plain = sorted(r["taken"] for r in mixing.mix_sources(six, block_words=8).collect())
    kept = mixing.mix_sources(six, block_words=8, keep=("text", "size", "taken", "tie", "id")).collect()
    assert sorted(r["taken"] for r in kept) == plain and len(plain) == 8 and len(set(plain)) > 2
    assert all(r["tie"] == 0 and r["id"] == 9 and r["size"] == len((r["text"] or "").split()) for r in kept)


def test_records(spark, docs, rows, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in records.token_records(docs, path).collect()) == want
    assert records.token_records(empty, path).count() == 0
    folder = records.scratch(spark, "records")
    part = records.write_records(docs, path, folder).collect()[0]["path"]
    index = records.read_index(part)
    for k in np.random.default_rng(0).permutation(len(index))[:5]:
        doc, ids = records.read_at(part, int(index["offset"][k]), int(index["length"][k]))
        text = next(t for i, t, *_ in rows if i == doc)
        assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 0]
    monkeypatch.setattr(records, "STRETCH", 300)
    many = records.write_records(docs, path, records.scratch(spark, "records"))
    assert many.count() > 3 and sorted(tuple(r) for r in records.read_records(records.written(many, "manifest")).collect()) == want
    broken = bytearray(records.frame(b"payload"))
    broken[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(bytes(broken)), 0)


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = spm.encode_pieces(docs, path)
    kinds = [theirs.is_byte(i) for i in range(theirs.get_piece_size())]
    for r in encoded.collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        ids = theirs.encode(text)
        want = (len(ids), sum(kinds[i] for i in ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(text.encode()), True)
        assert (r["n_tokens"], r["n_fallback"], r["ids_crc32"], r["back_crc32"], r["round_trip"]) == want
    for r in spm.decode_pieces(encoded, path).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["ids"] == theirs.encode(text) and r["round_trip"] and r["text"] == text
    assert spm.encode_pieces(empty, path).count() == 0


def test_wrong_ids_of_equal_length_do_not_come_back(docs, monkeypatch):
    class Wrong(spm.SpmEncoder):
        def encode(self, texts):
            out = []
            for code in super().encode(texts):
                ids = np.frombuffer(code, self.kind).copy()
                if len(ids):
                    right = self.bytes[ids[-1]]
                    ids[-1] = next(i for i, b in enumerate(self.bytes) if len(b) == len(right) and b != right)
                out.append(ids.tobytes())
            return out

    monkeypatch.setattr(spm, "SpmEncoder", Wrong)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = spm.encode_pieces(docs, path, parity=0).collect()
    assert any(r["n_tokens"] for r in got) and all(r["round_trip"] == (r["n_tokens"] == 0) for r in got)
    with pytest.raises(Exception, match="parity is lost"):
        spm.encode_pieces(docs, path, parity=1).collect()


def _proto(n, value):
    """One field of a protobuf message."""
    import struct

    if isinstance(value, bytes):
        return bytes([n << 3 | 2, len(value)]) + value
    if isinstance(value, float):
        return bytes([n << 3 | 5]) + struct.pack("<f", value)
    return (bytes([n << 3]) if n < 16 else bytes([(n << 3) & 127 | 128, n >> 4])) + bytes([value])


def test_models_without_byte_fallback(spark, tmp_path):
    """What a BPE model does not know becomes its unknown piece, and the row says that it does not come back."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁ab", -2.0, 1), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -5.0, 1)]
    data = b"".join(_proto(1, _proto(1, p.encode()) + _proto(2, s) + _proto(3, k)) for p, s, k in pieces)
    data += _proto(2, _proto(3, 2) + _proto(35, 0)) + _proto(3, _proto(1, b"identity") + _proto(3, 1) + _proto(4, 0) + _proto(5, 1))
    path = tmp_path / "plain.model"
    path.write_bytes(data)
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["ab a", "abc ab", "ccc", "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spm.encode_pieces(df, str(path), parity=1).collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == theirs.encode(text) and r["round_trip"] == ("c" not in text)


@pytest.mark.parametrize("as_text", [True, False])
def test_byte_level_agrees_with_the_library(rows, as_text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = as_text
    ours = tokens.byte_level(path, special_as_text=as_text)
    texts = [t or "" for _, t, *_ in rows] + ["x <|endoftext|> y", "a\n\nb", "\ta b\t c", "a\u00a0b c\u2003", " a", "a\n b", "\n", "x" * 5000 + " y", "it's we'll  they've"]
    for lot in (texts, texts[::-1], []):
        for text, code in zip(lot, ours.encode(lot), strict=True):
            assert np.frombuffer(code, ours.kind).tolist() == theirs.encode(text, add_special_tokens=False).ids
    ours.held = ours.remembered + 1
    assert ours.encode(["a b"]) == ours.encode(["a b"])


def test_registered_pieces_carry_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect())
    for found in (queries.op5_sentencepiece(spark, sf_dir), corpus_pipeline.sentencepiece(spark, rows, sf_dir)):
        back = spm.decode_pieces(found, public_tokenizers.path("piece_bpe_32k.model")).collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in back) == texts


def test_unigram_models_are_rebuilt(tmp_path):
    """A hand-made unigram model with byte fallback, as bytes of the protobuf."""
    pieces = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ba", -2.5, 1)]
    data = b"".join(_proto(1, _proto(1, p.encode()) + _proto(2, s) + _proto(3, k)) for p, s, k in pieces)
    data += _proto(2, _proto(3, 1) + _proto(35, 1)) + _proto(3, _proto(1, b"identity") + _proto(3, 1) + _proto(4, 1) + _proto(5, 1))
    path = tmp_path / "tiny.model"
    path.write_bytes(data)
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ours = spm.SpmEncoder(str(path))
    texts = ["ab ba", "  abba  ab ", "é", "", "aab bba"]
    for t, code in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(code, ours.kind).tolist() == theirs.encode(t)


def test_rule_statistics(docs, rows, empty):
    got = rules.judge(docs, []).collect()
    assert len(got) == len(rows) and "source" in got[0].asDict()
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["kept"] == (not r["base_failed"]) and r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert rules.judge(empty, []).count() == 0


def test_repeated_lines_of_any_word_count_and_blank_ones_never(spark):
    texts = {1: "Home\nHome\nHome", 2: "   \n   \none two", 3: "290\n290\nxyz", 4: "\t\r\n\t\r\nA\nA", 5: "\n\n"}
    want = {1: (2, 2 / 3, 1.0), 2: (0, 0.0, 2.0), 3: (1, 1 / 3, 1.0), 4: (1, 0.5, 1.0), 5: (0, 0.0, 0.0)}
    got = rules.with_statistics(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_dup_lines"], r["dup_line_share"], r["words_per_line"]) for r in got} == want


def test_decision_list():
    rng = np.random.default_rng(0)
    data = []
    for k in range(900):
        row = {n: float(rng.random()) for n in rules.SEPARATE}
        row |= {"bad": row["symbols_per_word"] > 0.8 or (row["upper_share"] > 0.7 and row["mean_word"] < 0.4), "fold": k % 3}
        data.append(row)
    found = rules.learn_list(data, cuts=200)
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in found) != r["bad"] for r in data)
    assert 2 <= len(found) <= 6 and wrong < 30
    assert found == rules.learn_list(data, cuts=200)
    assert rules.learn_list([r | {"bad": False} for r in data]) == []
    assert rules.learn_list([]) == []


def test_no_python_in_rule_plans(spark):
    docs = spark.range(9).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    column = [[rules.Condition("symbols_per_word", True, 0.5)]]
    plan = rules.judge(docs, column)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_classifier(spark, sf_dir, docs, empty):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    machine = fm.train(d, labels)
    got = fm.classify(d, machine).join(labels, "doc_id").where("held_out").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got) >= 0.9 * len(got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    rest = fm.classify(docs, machine).collect()
    assert all(0 <= r["score"] <= 1 for r in rest)
    assert fm.classify(empty, machine).count() == 0
    assert fm.classify(docs, fm.train(docs, labels.limit(0))).count() == len(rest)


def test_classifier_against_a_plain_scorer(spark, docs, rows):
    """Scores from dictionaries and a double sum over all pairs of inputs."""
    from tracelake.llm import hashing as H

    rng = np.random.default_rng(2)
    words, wide = 1 << fm.WORD_BITS, fm.DENSE + 1
    m = fm.Machine(-0.2, rng.normal(0, 0.3, words + wide), rng.normal(0, 0.2, (words + wide, 3)), rng.random(wide), rng.random(wide) + 0.5)
    df = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")))
    got = {r["doc_id"]: r["score"] for r in fm.classify(df, m, metadata=("n_chars",)).collect()}
    for i, text, _, _, n_chars, *_ in rows:
        raw = (text or "").encode()
        w = WORD.findall(lower(text or ""))
        if len(w) > 200:
            continue
        bucket = [int(H.words_of(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0] >> np.uint64(64 - fm.WORD_BITS)) for x in w]
        weight = {b: 1 + math.log(c) for b, c in collections.Counter(bucket).items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        x = {b: v / norm for b, v in weight.items()}
        one = max(len(w), 1)
        dense = [sum(b in members for b in raw) / max(len(raw), 1) for members in fm.CLASSES.values()]
        dense += [math.log1p(len(raw)), math.log1p(len(w)), len(raw) / one / 10, sum(a == b for a, b in zip(w, w[1:], strict=False)) / one, len(weight) / min(one, words), math.log1p(n_chars) if i % 3 else None]
        for k, v in enumerate(dense):
            x[words + k] = 0.0 if v is None else min(4, max(-4, (v - m.mean[k]) / m.scale[k])) / 4
        on = sorted(x)
        plain = m.bias + sum(m.linear[a] * x[a] for a in on) + sum(float(m.factors[a] @ m.factors[b]) * x[a] * x[b] for k, a in enumerate(on) for b in on[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, plain)))))


def test_fits_do_not_depend_on_repeated_rows_or_clashes(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = d.union(d.where("doc_id % 3 = 0")).withColumn("quality", F.lit(5)).withColumn("__label", F.lit("x")).withColumn("y", F.lit("x")).repartition(5)
    marks = labels.union(labels).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    assert rules.fit_rules(d, labels) == rules.fit_rules(more, marks)
    one, two = fm.train(d, labels, metadata=("n_chars",)), fm.train(more, marks, metadata=("n_chars",))
    assert np.array_equal(one.linear, two.linear) and np.array_equal(one.factors, two.factors)
    assert rules.fit_rules(d, labels.limit(0)) == [] and rules.fit_rules(d.limit(0), labels) == []
    clash = d.limit(20).withColumn("__text", F.lit(1)).withColumn("kept", F.lit(1)).withColumn("__w", F.lit(1))
    assert rules.judge(clash, []).count() == 20


def test_decision_list_column_is_the_list(spark, sf_dir):
    """What the CASE expression keeps is what the rules, read one after the other, keep."""
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = rules.fit_rules(d, labels)
    assert found
    for r in rules.judge(d, found).collect():
        row = r.asDict()
        want = not r["base_failed"] and not any(all(row[c.name] >= c.cut if c.above else row[c.name] <= c.cut for c in rule) for rule in found)
        assert r["kept"] == want


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = (1 << fm.WORD_BITS) + fm.DENSE
    m = fm.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(fm.DENSE), np.ones(fm.DENSE))
    at, bucket, weight = np.zeros(4, int), np.array([1, 5, 9, 70]), rng.random(4)
    dense = rng.random((1, fm.DENSE))
    x = np.zeros(size)
    x[bucket] = weight
    x[1 << fm.WORD_BITS :] = m.standard(dense)[0]
    on = np.flatnonzero(x)
    plain = m.bias + x @ m.linear + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for n, i in enumerate(on) for j in on[n + 1 :])
    assert m.score(at, bucket, weight, dense)[0] == pytest.approx(1 / (1 + math.exp(-plain)))


def test_fingerprints(spark, docs, rows, empty):
    one = {r[0]: r[1] or "" for r in rows}
    order = sorted(one, reverse=True)
    distinct = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(distinct).collect()}
    assert len(got) == len(order)
    for k, i in enumerate(order):
        text, after = one[i], one[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(text.encode()) and r["edited_fingerprint"] == fingerprint.digest(edited.encode())
        assert r["near_edited"] == fingerprint.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], fingerprint.digest(after.encode())) and 0 <= r["near_next"] <= 1
    assert fingerprint.edited_fingerprints(docs).count() == len(rows)
    assert fingerprint.edited_fingerprints(empty).count() == 0
    assert fingerprint.edited_fingerprints(distinct.where("doc_id = 3")).first()["near_next"] == 1.0


def test_fingerprints_are_told_by_plain_counts():
    """Digest and likeness against a version with dictionaries."""
    for text in ("", "ab", "abcabc" * 9, "é🙂 and more words " * 30):
        raw = text.encode()
        counts = [0] * 128
        for i in range(len(raw) - 2):
            counts[((int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1) % 2**32) >> 25] += 1
        ranked = sorted(counts)
        codes = [sum(c > ranked[q] for q in (31, 63, 95)) for c in counts]
        length = min(255, round(4 * math.log2(len(raw) + 1)))
        mark = fingerprint.digest(raw)
        assert bytes.fromhex(mark)[0] == length and [(bytes.fromhex(mark)[1 + i // 4] >> 2 * (i % 4)) & 3 for i in range(128)] == codes
        other = fingerprint.digest(raw[: len(raw) // 2])
        b = bytes.fromhex(other)
        steps = sum([0, 1, 2, 6][abs(c - ((b[1 + i // 4] >> 2 * (i % 4)) & 3))] for i, c in enumerate(codes))
        assert fingerprint.likeness(mark, other) == pytest.approx(1 - (steps + 4 * min(16, abs(length - b[0]))) / (6 * 128 + 64))


def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one id are dealt to several ranges and still form one round, each once."""
    rows = [(i // 40 if i < 120 else None, f"text {i % 90} " * 7) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(map(str, fingerprint.edited_fingerprints(df).collect()))
    monkeypatch.setattr(fingerprint, "PART_BYTES", 700)
    assert sorted(map(str, fingerprint.edited_fingerprints(df).collect())) == one and len(one) == 160
    assert fingerprint.fingerprint_column(df).where("fingerprint is null").count() == 0


def test_fingerprint_ranges(spark, monkeypatch):
    """Many ranges give the same neighbours as one."""
    df = spark.createDataFrame([(i * 7, f"text number {i} " * 9) for i in range(200)], "doc_id long, text string")
    one = sorted(map(tuple, fingerprint.edited_fingerprints(df).collect()))
    monkeypatch.setattr(fingerprint, "PART_BYTES", 1500)
    assert sorted(map(tuple, fingerprint.edited_fingerprints(df).collect())) == one


def test_passages(docs, rows, empty):
    first, byte = {}, {}
    for i, t, *_ in rows:
        byte[i] = (t or "").encode()
    for i in sorted(byte):
        for k in range(len(byte[i]) - 49):
            first.setdefault(byte[i][k : k + 50], i)
    out = passages.remove_passages(docs, texts=True, carry=["source"])
    got = out.collect()
    assert len(got) == len(rows) and any(r["n_removed"] for r in got)
    for r in got:
        b = byte[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert len(r["text"].encode()) >= len(kept)
    assert {r["source"] for r in got} == {"a", "b", None, "ü"}
    assert passages.remove_passages(empty).count() == 0


@pytest.mark.parametrize("texts", [["hello", None, ""], ["".join(np.random.default_rng(k).choice(list("abcdefgh "), 300)) for k in range(40)], [" \n"], ["x" * 49, "x" * 49]])
def test_passages_without_repeats(spark, texts):
    """Short texts, and blocks without a shared trigger, stay as they are."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = passages.remove_passages(df, texts=True).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["text"]) for r in got} == {i: (0, 0, t or "") for i, t in enumerate(texts)}


def test_blocks_of_texts_stay_out_of_the_jvm(spark, docs, rows):
    """Rows of a packed table name blocks of any size; their files give every row back."""
    packed = blocks.pack(docs, "doc_id", "text", block_bytes=2000, carry=["source"])
    found = packed.collect()
    assert len(found) > 1 and max(len(str(tuple(r))) for r in found) < 500
    batch = pa.Table.from_pylist([r.asDict() for r in found]).combine_chunks().to_batches()[0]
    got = []
    for _, ids, offsets, data, carry in blocks.unpack(batch):
        got += [(int(i), data[a:b].tobytes().decode(), json.loads(c).get("source")) for i, a, b, c in zip(ids, offsets[:-1], offsets[1:], carry.to_pylist(), strict=True)]
    want = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)


def test_hot_triggers_are_dealt_by_windows(spark, docs, monkeypatch):
    """The same bytes go where a trigger's phrases are sent window by window, and where windows are sorted in parts."""
    want = sorted(map(str, passages.remove_passages(docs).collect()))
    monkeypatch.setattr(passages, "HOT_BLOCKS", 1)
    monkeypatch.setattr(passages, "SORTED", 500)
    assert sorted(map(str, passages.remove_passages(docs).collect())) == want


def test_equal_rows_survive_hash_collisions(monkeypatch):
    rng = np.random.default_rng(0)
    text, count, key = rng.integers(97, 99, (400, passages.ROW), dtype=np.uint8), np.full(400, 5, np.int32), rng.integers(0, 3, 400).astype(np.uint64)
    text[:, 8:] = 97
    one, place = passages._equal_rows(key, count, text)
    monkeypatch.setattr(passages.H, "mix", lambda x: np.zeros_like(x))
    other, at = passages._equal_rows(key, count, text)
    assert len(one) == len(other) and (text[one][place] == text).all() and (text[other][at] == text).all() and (np.diff(key[other].astype(int)) >= 0).all()


@pytest.mark.parametrize(("order", "least", "heavy"), [(3, 2, 10), (3, 1, 60), (2, 1, 0), (2, 1, 10**6), (2, 3, 10), (1, 1, 60), (4, 1, 0), (4, 2, 0)])
def test_language_model(docs, rows, empty, order, least, heavy, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "SAMPLED_ROWS", 9)
    words = [(i, WORD.findall(lower(t or ""))) for i, t, *_ in rows]
    count = collections.Counter(tuple(w[k : k + n]) for _, w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def score(g):
        if len(g) == 1:
            return count[g] / total
        return count[g] / count[g[:-1]] if count[g] >= least else 0.4 * score(g[1:])

    found = lm.backoff_scores(docs, order=order, least=least).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in words)
    got = {r["doc_id"]: r for r in found}
    for i, w in words:
        want = sum(math.log10(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        assert got[i]["n_words"] == len(w) and got[i]["log10_score"] == pytest.approx(want, abs=1e-6)
        assert (got[i]["mean_log10"] is None) == (not w)
    if order == 3:
        assert lm.backoff_scores(empty, order=order, least=least).count() == 0
        blank = docs.where("doc_id in (4, 5, 6)")
        assert [r["log10_score"] for r in lm.backoff_scores(blank, order=order, least=least).collect()] == [0.0] * 3


def test_registered_language_model_counts_all_trigrams(spark, tmp_path):
    texts = ["a b c a b d", "a b c", "x y", "z", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [(t or "").split() for t in texts]
    count = collections.Counter(tuple(w[k : k + n]) for w in words for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, words))
    assert count["a", "b", "d"] == count["x", "y"] == 1
    for r in queries.queries()["op10_lm_scores_trigrams"](spark, str(tmp_path)).collect():
        w = words[r["doc_id"]]
        grams = [tuple(w[max(0, k - 2) : k + 1]) for k in range(len(w))]
        want = sum(math.log10(count[g] / (count[g[:-1]] if g[1:] else total)) for g in grams)
        assert r["n_words"] == len(w) and r["log10_score"] == pytest.approx(want, abs=6e-4)
