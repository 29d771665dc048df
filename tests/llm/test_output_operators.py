"""Token codes, packing, classifier, chat, sharding, archives and the pipeline: round trips, laws and held-out accuracy."""

import base64
import gzip
import hashlib
import math
import heapq
import random
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith
from tokenizers import Tokenizer

from lodestone.llm import chat, dac, nbsvm, pack, queries, shard, store, tokens, warc

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def assert_library_ids(path, texts):
    want = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    memory = tokens.WordMemory(path, keeps_space=path == BYTES)
    got = []
    for _, ids, ends in tokens.encoded(memory, pa.array(range(len(texts))), pa.array(texts, pa.string()), 7, 500):
        got += [part.tolist() for part in np.split(ids, ends[:-1])]
    wrong = [t for t, x, y in zip(texts, want, got, strict=True) if x != y]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_remembered_pieces_give_the_library_ids(path):
    rnd = random.Random(4)
    marks = ["a", "b", "É", " ", " ", "\n", ".", ",", "'", "s", "t", "1", "_", "\t", "!", "\u00a0", "é", "ß", "\x1c", "\u0301", "<|endoftext|>", "Σ", "漢", "\x00", "\u09df", "\u0130", "H", "\u0331", "\u180e", "\u3000", "<|ENDOFTEXT|>", "<|endoftext", "\u2028"]
    assert_library_ids(path, ["", "."] + ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 24))) for _ in range(8000)])


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_every_code_point_gives_the_library_ids(path):
    """Each assigned code point before, between and after what texts are cut at, and in random company."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    points = [c for c in points if not 0x4E10 <= ord(c) < 0x9FF0 and not 0xAC10 <= ord(c) < 0xD790 and ord(c) < 0x17000]
    assert_library_ids(path, [f"{c}. {c}, a{c}. {c}a,\n{c}.{c} {c}" for c in points])
    rnd = random.Random(9)
    around = [" ", " ", ".", ",", "\n", "a", "1", "'s"]
    assert_library_ids(path, ["".join(rnd.choice(points if rnd.random() < 0.5 else around) for _ in range(rnd.randint(2, 16))) for _ in range(20_000)])


def test_codes_give_random_access():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        segment = dac.Segment(dac.encode(ids))
        assert len(segment) == n and segment.range(0, n).tolist() == ids.tolist()
        some = rnd.integers(0, max(n, 1), 60 if n else 0)
        assert segment.take(some).tolist() == ids[some].tolist()
        for i in some.tolist():
            assert segment[i] == ids[i]
            assert segment.range(i, min(n, i + 70)).tolist() == ids[i : i + 70].tolist()


def test_token_codes_round_trip(spark, data, odd, none):
    library = Tokenizer.from_file(WORDS)
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd, none):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or 0))
        codes = store.stored(dac.encode_documents(docs, WORDS, 2, partitions=3), "test-codes")
        got = sorted(dac.read_documents(codes).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [r[1] for r in rows]
        ids = {t: library.encode(t, add_special_tokens=False).ids + [2] for _, _, t in rows}
        start = 0
        for r in got:
            found = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] == start and r["n_tokens"] == len(found)
            assert found in [ids[t] for _, d, t in rows if d == r["doc_id"]]
            start += len(found)
        if start:
            flat = [t for r in got for t in np.frombuffer(r["ids"], "<u4").tolist()]
            asked = spark.range(0, start, max(1, start // 50)).withColumnRenamed("id", "position")
            read = sorted((r["position"], r["token"]) for r in dac.read_tokens(codes, asked.union(asked.limit(3))).collect())
            places = [*range(0, start, max(1, start // 50))]
            assert read == sorted((p, flat[p]) for p in places + [r["position"] for r in asked.limit(3).collect()])


def test_differencing_is_a_partition():
    rnd = random.Random(6)
    for _ in range(40):
        lengths = [rnd.randint(1, 128) for _ in range(rnd.randint(0, 90))]
        sums, members = pack.differencing(lengths, 7)
        assert sorted(i for m in members for i in m) == list(range(len(lengths)))
        assert sums == [sum(lengths[i] for i in m) for m in members]
        for m in pack.fill_windows(lengths, 200) if lengths else []:
            assert sum(lengths[i] for i in m) <= 200


def plain_differencing(lengths, windows):
    """Sums of Karmarkar-Karp multiway differencing with all windows written out."""
    heap = [(-n, i, [0] * (windows - 1) + [n]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    for tie in range(len(lengths), 2 * len(lengths) - 1):
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        heapq.heappush(heap, (merged[0] - merged[-1], tie, merged))
    return heap[0][2] if heap else [0] * windows


def test_differencing_is_karmarkar_karp():
    rnd = random.Random(13)
    better = 0
    for _ in range(120):
        lengths = [rnd.randint(1, 128) for _ in range(rnd.randint(0, 60))]
        windows = rnd.choice((1, 2, 3, 7, 20))
        sums, _ = pack.differencing(lengths, windows)
        assert sums == plain_differencing(lengths, windows)
        greedy = [0] * windows
        for n in sorted(lengths, reverse=True):
            greedy[greedy.index(min(greedy))] += n
        better += max(greedy) - min(greedy) > sums[-1] - sums[0]
    assert better > 30  # a fill of the emptiest window would not pass


def test_features_match_plainly_counted_ones():
    rnd = random.Random(14)
    texts = ["", None, "a", "ab", "é", "word word word", "a b a b a b", "\n".join(["the same line"] * 9), *(" ".join(rnd.choice(["aa", "b", "c", "dé"]) for _ in range(rnd.randint(1, 90))) for _ in range(40))]
    features = nbsvm.Featurizer()
    for text in texts:
        raw = (text or "").encode()
        want = {b + 1 for b in raw} | {0x10000 + x + (y << 8) for x, y in zip(raw, raw[1:])} | {0x20000 + ((x + (y << 8) + (z << 16)) * 2654435761 % (1 << 32) >> 15) for x, y, z in zip(raw, raw[1:], raw[2:])}
        words = raw.split()
        pairs, seen, run, longest = list(zip(words, words[1:])), set(), 0, 0
        for pair in pairs:
            run = run + 1 if pair in seen else 0
            longest, _ = max(longest, run), seen.add(pair)
        twice = sum(x == y for x, y in pairs)
        want |= {512 + k for k, n in enumerate(nbsvm.ORDERS) if longest >= n} | {512 + len(nbsvm.ORDERS) + k for k, n in enumerate(nbsvm.COUNTS) if twice >= n}
        assert set(features(text).tolist()) == want


def test_packing_holds_each_id_once(spark, data, odd, none):
    library = Tokenizer.from_file(BYTES)
    for docs, waste in ((spark.read.parquet(f"{data}/documents.parquet").repartition(1), 0.03), (odd, 1)):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
        pieces, windows = defaultdict(list), defaultdict(list)
        for r in pack.pack_documents(docs, BYTES, 0).collect():
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"] and r["length"] > 0
            pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], ids))
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
        for d, own in texts.items():
            assert sum(len(p[2]) for p in pieces[d]) == sum(map(len, own))
            if len(own) == 1:
                assert [t for p in sorted(pieces[d]) for t in p[2]] == own[0]
        total = 0
        for spans in windows.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 1024
            total += end
        assert 1 - total / (1024 * len(windows)) <= waste
    assert pack.pack_documents(none, BYTES, 0).count() == 0


def test_windows_are_padded(spark, odd):
    pieces = pack.pack_documents(odd, BYTES, 0)
    assert {len(r["ids"]) for r in pack.assemble(pieces).collect()} == {1024}


def test_classifier_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op4_quality_classifier(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in known) / len(known) > 0.95
    assert {b for a, b in known if a == 0} == {0} or sum(b for a, b in known if a == 0) <= 1


def test_classifier_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (9, 1), (None, 0), (8, None), (77, 0)], "doc_id long, quality int")
    model = nbsvm.fit(odd, labels)
    assert len(nbsvm.score(odd, model).collect()) == odd.count()
    assert {r["score"] for r in nbsvm.score(odd, nbsvm.fit(none, labels)).collect()} == {0.5}
    assert nbsvm.score(none, model).count() == 0


def test_dual_coordinate_descent_separates():
    rnd = np.random.default_rng(8)
    rows = [np.unique(np.concatenate(([1 + label], rnd.integers(100, 400, 20)))) for label in (0, 1) * 100]
    labels = np.array([0, 1] * 100)
    model = nbsvm.fit_rows(rows, labels, np.arange(200) // 2 % 5)
    assert all((model.score(f) > 0.5) == bool(y) for f, y in zip(rows, labels, strict=True))


def test_count_ratios_match_a_plain_count():
    rnd = random.Random(2)
    rows = [sorted(rnd.sample(range(50), 8)) for _ in range(40)]
    labels = [rnd.randrange(2) for _ in rows]
    got = nbsvm.log_count_ratios([np.array(r, np.uint32) for r in rows], np.array(labels))
    for gram in range(50):
        share = [(1 + sum(gram in r for r, y in zip(rows, labels, strict=True) if y == label)) / (1 + labels.count(label)) for label in (0, 1)]
        assert math.isclose(got[gram], math.log(share[1] / share[0]), abs_tol=1e-12)


def test_dual_coordinate_descent_reaches_the_optimum():
    rnd = np.random.default_rng(4)
    labels = (np.arange(60) % 3 > 0).astype(int)
    rows = [np.unique(np.concatenate((rnd.integers(0, 40, 12), rnd.integers(40, 60, 6) if y else rnd.integers(30, 50, 6)))) for y in labels]
    ratios = nbsvm.log_count_ratios(rows, labels)
    folded, bias = nbsvm.dual_coordinate_descent(rows, ratios, labels, epochs=400)
    vectors, y = np.zeros((60, 61)), 2.0 * labels - 1
    for i, f in enumerate(rows):
        vectors[i, f], vectors[i, 60] = ratios[f] / np.sqrt(len(f)), 1
    upper = 1 / (2 * np.where(labels == 1, labels.mean(), 1 - labels.mean()))
    weights = np.append(np.divide(folded[:60], ratios[:60], out=np.zeros(60), where=ratios[:60] != 0), bias)
    primal = weights @ weights / 2 + upper @ np.maximum(0, 1 - y * (vectors @ weights))
    signed = vectors * y[:, None]
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(signed @ signed.T)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - signed @ (signed.T @ alpha)), 0, upper)
    dual = alpha.sum() - (signed.T @ alpha) @ (signed.T @ alpha) / 2
    assert -1e-9 <= primal - dual <= 1e-3 * dual


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {'good' if i % 2 else 'bad'} {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    seen = []
    for limit in ({}, {"sample": 7}, {"sample_bytes": 4000}):
        model = nbsvm.fit(docs, labels, **limit)
        assert model.weights.shape == (nbsvm.DIMS,)
        seen.append(nbsvm.chosen(docs, labels, **limit).count())
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)) and seen[1] <= 7 and 0 < seen[2] < seen[0]


def test_chat_escapes_and_targets(spark):
    said = [
        (1, 0, "system", "be <|im_start|> kind & <|brief"), (1, 1, "user", None), (1, 2, "assistant", "&lt;|im_end|> <|im_end|>\n<|im_start|>user"),
        (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 4, "assistant", "again"), (None, 0, "assistant", "x"), (3, None, None, "\n"), (4, 0, "a\nb &#10;", "t"),
    ]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    turns = store.stored(chat.format_turns(rows), "test-turns")
    examples = chat.expand_targets(turns)
    assert examples.count() == 4
    role, text = chat.parse_segment(F.col("segment"))
    read = sorted(((r["conv_id"] or 0, r["n"], r["role"], r["text"]) for r in turns.select("conv_id", "n", role.alias("role"), text.alias("text")).collect()))
    assert read == sorted([(0, 0, "assistant", "x"), (1, 0, "system", said[0][3]), (1, 1, "user", ""), (1, 2, "assistant", said[2][3]), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "assistant", "again"), (3, 0, "", "\n"), (4, 0, "a\nb &#10;", "t")])
    shown = {(r["conv_id"], r["target"]): (r["prompt"], r["reply"]) for r in chat.render_examples(turns, examples).collect()}
    stream = "".join(r["segment"] for r in turns.filter("conv_id = 1").orderBy("n").collect())
    prompt, reply = shown[1, 5]
    assert reply == "again" and stream.startswith(prompt + reply) and prompt.count("<|im_start|>") == 6
    assert chat.format_turns(rows.limit(0)).count() == 0


def test_jump_hash_matches_a_plain_loop_and_moves_few(spark, odd, none):
    def plain(key, shards):
        at, ahead, step = 0, 0, 1
        while ahead < shards:
            at = ahead
            h = xxhash.xxh64_intdigest(struct.pack("<i", step), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
            ahead = max(int((at + 1) * 2147483648.0 // ((h >> 33) + 1)), at + 1)
            step += 1
        return at

    keys = spark.range(3000).withColumn("a", shard.jump_shard(F.col("id"), 40)).withColumn("b", shard.jump_shard(F.col("id"), 41)).collect()
    assert all(r["a"] == plain(r["id"], 40) for r in keys)
    assert all(r["b"] in (r["a"], 40) for r in keys)
    assert 30 < sum(r["b"] == 40 for r in keys) < 130
    sizes = np.bincount([r["a"] for r in keys], minlength=40)
    assert sizes.min() > 40 and sizes.max() < 120
    index = shard.shard_index(odd, "doc_id", "text", 5).collect()
    for s in {r["shard"] for r in index}:
        own = sorted(r["slot"] for r in index if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len(index) == odd.count() and shard.shard_index(none, "doc_id", "text", 5).count() == 0
    assert shard.assign_shards(odd, "doc_id", 5).columns == odd.columns


def test_sharding_query_matches_brute_force(spark, data, odd):
    """Sizes, checksums and shards by plain code; slots of every shard without gaps, also where rows repeat."""
    clones = odd.union(odd.filter("doc_id = 5").crossJoin(spark.range(30_000).select()))
    for docs, rows in ((spark.read.parquet(f"{data}/documents.parquet"), queries.op6_sharding(spark, data)), (clones, shard.shard_index(clones, "doc_id", "text", 40).withColumnRenamed("key", "doc_id"))):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
        keys = docs.select("doc_id").distinct().select("doc_id", shard.jump_shard(F.col("doc_id"), 40).alias("a"), shard.jump_shard(F.col("doc_id"), 41).alias("b")).collect()
        where = {r["doc_id"]: (r["a"], r["b"]) for r in keys}
        got = rows.collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == Counter((d, len(t) + 16, zlib.crc32(t), *where[d]) for d, t in texts)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_archives(spark, tmp_path):
    pages = [(1, "https://a/1", "<p>x</p>"), (2, "https://a/2\r\nX: y", "<p>x</p>"), (3, None, None), (4, "https://b/4", ""), (5, "https://b/5", "é" * 9000), (5, "https://b/5", "é" * 9000), (None, "n", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    warc.write_archive(warc.with_revisits(df), path)
    rows = warc.read_archive(spark, path).collect()
    kinds = sorted((r["record_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in rows)
    page = "<urn:x-page:{}>".format
    assert kinds == sorted([("", "response", "", 1), (page(1), "revisit", page(2), 8), (page(2), "response", "", 8), (page(3), "revisit", page(4), 0), (page(4), "response", "", 0), (page(5), "response", "", 18000), (page(5), "response", "", 18000)])
    assert {r["payload"].decode() for r in rows if r["payload"] is not None} == {"<p>x</p>", "", "é" * 9000, "z"}
    some = warc.read_archive(spark, path, payload=False).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("https://b/"))
    assert some.count() == 3 and all(r["payload"] is None for r in some.collect())
    plain = b"".join(warc.record(f"<r{i}>", "response", "u", b"p" * i, "", None, "2020-01-01T00:00:00Z").replace(b"WARC-Payload-Digest: sha1:\r\n", b"") for i in range(4))
    (tmp_path / "b.warc").write_bytes(plain)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(plain[:400]) + gzip.compress(plain[400:]))
    for name in ("b.warc", "c.warc.gz"):
        assert sorted(len(r["payload"]) for r in warc.read_archive(spark, f"file://{tmp_path}/{name}").collect()) == [0, 1, 2, 3]
    warc.write_archive(warc.with_revisits(df.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0


def archive_rows(spark, path):
    return sorted((r["record_id"], r["payload"]) for r in warc.read_archive(spark, path).collect())


def test_archives_append_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    first, second, third = ([(f"<{k}{i}>", bytes(f"{k}{i}", "ascii")) for i in range(3)] for k in "abc")
    records = lambda rows: warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")).unionByName(
        spark.createDataFrame([(i, "response", "u", p, None) for i, p in rows], "record_id string, record_type string, target_uri string, payload binary, refers_to string")
    )
    warc.write_archive(records(first), path)
    warc.write_archive(records(second), path)
    assert archive_rows(spark, path) == first + second
    (tmp_path / "a" / "foreign.warc").write_bytes(warc.record("<f>", "response", "u", b"f", "", None, "2020-01-01T00:00:00Z").replace(b"WARC-Payload-Digest: sha1:\r\n", b""))
    (tmp_path / "a" / f"part-{'0' * 32}.warc.gz").write_bytes(b"of an attempt that was never committed")
    assert archive_rows(spark, path) == first + second + [("<f>", b"f")]
    warc.write_archive(records(third), path, mode="overwrite")
    assert archive_rows(spark, path) == third + [("<f>", b"f")]
    writer = warc.WarcWriter({"path": path})
    done = writer.write(iter([pa.RecordBatch.from_pylist([{"record_id": "<x>", "record_type": "response", "target_uri": "u", "payload": b"x", "refers_to": None}])]))
    writer.abort([done, None])
    assert archive_rows(spark, path) == third + [("<f>", b"f")] and len(list((tmp_path / "a").glob("part-*"))) <= 4


def test_damaged_archives_raise(tmp_path):
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    noise = random.Random(3).randbytes(30_000)
    raw = [warc.record(f"<r{i}>", "response", "u", p, digest(p), None, "2020-01-01T00:00:00Z") for i, p in enumerate((b"a", noise, b"c"))]
    whole = b"".join(map(warc.member, raw))
    reader = warc.WarcReader({"path": str(tmp_path)})

    def read(data):
        path = tmp_path / "x.warc.gz"
        path.write_bytes(data)
        return [r for b in reader.read(warc.ArchiveFile(str(path))) for r in b.to_pylist()]

    assert len(read(whole)) == 3
    first = len(warc.member(raw[0]))
    for damaged in (whole[:-1], whole[: first + 40], whole[: first + 10_000], whole[: first + 9000] + b"\0" * 50 + whole[first + 9050 :], whole[:16] + b"\0\0\0\0" + whole[20:]):
        with pytest.raises(ValueError, match="x.warc.gz, member at"):
            read(damaged)
    plain, packed = b"".join(raw), gzip.compress(b"".join(raw))
    assert len(read(plain)) == len(read(packed)) == 3
    for damaged in (plain[:-40], plain[: len(raw[0]) + 60], packed[:-20], packed[: len(packed) // 2]):
        with pytest.raises(ValueError, match="x.warc.gz, member at"):
            read(damaged)


def test_payloads_that_heads_turn_down_are_not_inflated(tmp_path, monkeypatch):
    inflated = [0]
    make = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.own = make(bits)

        def decompress(self, *args):
            out = self.own.decompress(*args)
            inflated[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    body = random.Random(8).randbytes(200_000)
    kinds = ["response", "metadata", "response", "request"]
    path = tmp_path / "y.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.record(f"<r{i}>", k, f"https://{k[0]}/{i}", body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None, "2020-01-01T00:00:00Z")) for i, k in enumerate(kinds)))
    for filters, options, rows, payloads in (
        ([], {}, 4, 4),
        ([EqualTo(("record_type",), "request")], {}, 1, 1),
        ([In(("record_type",), ("request", "metadata")), StringStartsWith(("target_uri",), "https://m")], {}, 1, 1),
        ([EqualTo(("record_type",), "none")], {}, 0, 0),
        ([], {"payload": "false"}, 4, 0),
    ):
        reader = warc.WarcReader({"path": str(path)} | options)
        assert list(reader.pushFilters(filters)) == []
        inflated[0] = 0
        assert sum(b.num_rows for b in reader.read(warc.ArchiveFile(str(path)))) == rows
        assert payloads * len(body) <= inflated[0] <= payloads * len(body) + 4 * (warc.HEAD + 1000)


def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = store.stored(stage(spark, docs, data), "test-stage")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert cp.STAGES[-1][1](spark, docs, data).select("doc_id").distinct().count() == before
    assert sorted(map(tuple, cp.run(spark, data).select("doc_id", "start", "length").collect())) == sorted(
        map(tuple, cp.STAGES[-1][1](spark, docs, data).select("doc_id", "start", "length").collect())
    )


def test_pipeline_stages_on_odd_tables(spark, data, odd, none):
    import corpus_pipeline as cp

    for docs in (odd, none):
        for name, stage in cp.STAGES:
            stage(spark, docs, data).count()
