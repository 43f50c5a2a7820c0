import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from granary.llm import bpe, huffman, packing
from granary.llm.common import work_path
from granary.llm.tokenize import WordTokenizer
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import TEXTS, awkward

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [t for _, t in TEXTS] + ["a\x1cb", "Don't THEY'LL 12ab_3 __ <|endoftext|> x", "a<|endoftext|><|startoftext|>B <|ENDOFTEXT|> <| endoftext |>", "'S 's'T", "ǅ ŉ ß ẞ", "a'b''s", "１２ ½ ⅓", "…“a”—b", "²ªº"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def runs(ids, sizes):
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_words_equal_the_library(spark, small, library):
    texts = HARD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    worker = WordTokenizer(PATH, most=2000)
    for _ in range(2):
        assert runs(*worker.encode(texts, 1)) == [library(t) for t in texts]
    assert runs(*worker.encode([])) == []


def test_control_strings_in_random_texts(library):
    rng = np.random.default_rng(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "<|EndOfText|>", " ", "\n", "a", "B", "'s", "1", "é", "</w>", "_", "中"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(3000)]
    assert runs(*WordTokenizer(PATH).encode(texts, 1)) == [library(t) for t in texts]


def test_memory_is_bounded_by_bytes():
    rng = np.random.default_rng(1)
    worker = WordTokenizer(PATH, most=100_000)
    for _ in range(20):
        worker.encode([" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(20))])
        assert 32 * len(worker.first) + 4 * len(worker.ids) < 200_000


def test_other_steps_go_to_the_library(tmp_path):
    import json

    file = json.loads(open(PATH, encoding="utf-8").read())
    file["normalizer"]["normalizers"] = file["normalizer"]["normalizers"][:2]  # keeps the case
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file), encoding="utf-8")
    own = Tokenizer.from_file(str(other))
    texts = ["Some Text WITH capitals", "none"]
    assert runs(*WordTokenizer(str(other)).encode(texts)) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def sequences(pieces):
    """Length of each sequence, whose pieces must follow each other without a gap."""
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
    return [sum(p.length for p in parts) for parts in by_sequence.values()]


def wide(p):
    return np.frombuffer(p.ids, "<u2" if len(p.ids) == 2 * p.length else "<u4").tolist()


def test_packing_covers_each_id_once(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack_documents(docs).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for k, text in texts.items():
        parts = sorted(by_doc[k], key=lambda p: p.start)
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert [i for p in parts for i in wide(p)] == library(text)
        assert {p.doc_tokens for p in parts} == {sum(p.length for p in parts)}
    used = sequences(pieces)
    assert max(used) <= 2048 and sum(used) / (2048 * len(used)) > 0.98
    digests = {tuple(r) for r in packing.digest(packing.pack_documents(docs)).select("doc_id", "start", "ids_crc32").collect()}
    assert digests == {(p.doc_id, p.start, zlib.crc32(np.asarray(wide(p), "<u4"))) for p in pieces}


def test_packing_does_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    filled = [sorted(sequences(packing.pack_documents(docs.repartition(n)).collect())) for n in (1, 5)]
    assert filled[0] == filled[1]


def test_plan_equals_one_window_at_a_time():
    rng = np.random.default_rng(2)
    for _ in range(60):
        window = int(rng.integers(5, 60))
        lengths = rng.integers(1, window, rng.integers(1, 80)).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        left, single = dict(counts), []
        while left:
            longest = max(left)
            taken = {longest: 1}
            for _ in range(2):
                for k, m in taken.items():
                    left[k] -= m
                    if not left[k]:
                        del left[k]
                single.append(longest + sum(k * m for k, m in taken.items())) if _ else None
                taken = packing.fill(left, window - longest) if not _ else {}
        lines = packing.plan(counts, window)
        assert sorted(single) == sorted(sum(k * m for k, m in p.items()) for p, t in lines for _ in range(t))
        assert {k: sum(p.get(k, 0) * t for p, t in lines) for k in counts} == counts
        assert len(lines) <= len(counts) * (window // min(counts)).bit_length() + len(counts)


def test_packing_of_awkward_rows(spark):
    pieces = packing.pack_documents(awkward(spark)).collect()
    sequences(pieces)
    assert sorted((p.doc_id or 0) for p in pieces if p.start == 0) == sorted((i or 0) for i, _ in TEXTS)
    assert packing.pack_documents(awkward(spark).limit(0)).count() == 0


def test_fill_is_the_best_multiset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(1, 8)).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        room = int(rng.integers(1, 60))
        best = max(s for s in (sum(x for k, x in enumerate(lengths) if m >> k & 1) for m in range(1 << len(lengths))) if s <= room)
        chosen = packing.fill(counts, room)
        assert sum(k * v for k, v in chosen.items()) == best
        assert all(0 < v <= counts[k] for k, v in chosen.items())


def test_code_lengths_are_optimal_under_the_limit():
    import heapq

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 300):
        counts = rng.zipf(1.4, n).astype(np.int64)
        free = huffman.code_lengths(counts, 30)
        heap = counts.tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert (free * counts).sum() == (cost or counts.sum())
        tight = huffman.code_lengths(counts, max(1, (n - 1).bit_length()))
        assert tight.max() <= max(1, (n - 1).bit_length())
        assert sum(2.0 ** -int(x) for x in tight if x) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_block_round_trip():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 20_000) % 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids), 14)
    sizes = np.array([0, 1, 127, 128, 129, 0, 10_000, len(ids) - 10_385, 0])
    bits, n_bits, marks, n_marks = huffman.encode_blocks(ids, sizes, lengths, huffman.canonical(lengths))
    assert n_marks.tolist() == [-(-s // huffman.STRIDE) for s in sizes]
    found, width = huffman.decoding_table(lengths)
    assert (huffman.decode_blocks(sizes, bits.tobytes(), n_bits, marks, found, width) == ids).all()


@pytest.mark.parametrize("table", ["documents", "awkward", "empty"])
def test_files_round_trip(spark, small, library, table):
    docs = spark.read.parquet(f"{small}/documents.parquet") if table == "documents" else awkward(spark)
    docs = docs.limit(0) if table == "empty" else docs
    path = huffman.write_ids(docs, work_path(spark, "test"), rows_per_file=30)
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r.start)
    rows = docs.select("doc_id", "text").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    expected = sorted((r.doc_id or 0, np.asarray(library(r.text), "<u4").tobytes()) for r in rows)
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == expected
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens * 4 == len(r.ids) for r in got)


def test_files_of_a_hot_id(spark, library):
    rows = [(5 if i % 2 else i, f"text {i}" + " more" * (i % 7)) for i in range(300)]
    path = huffman.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), work_path(spark, "test"), rows_per_file=20)
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted((i, np.asarray(library(t), "<u4").tobytes()) for i, t in rows)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/blocks").groupBy("bucket").count().collect()]
    assert max(sizes) < 60


def test_the_sessions_settings_stay(spark, small):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_part_files_ascend(spark):
    docs = spark.range(400, 0, -1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = huffman.write_ids(docs, work_path(spark, "test"), rows_per_file=25)
    files = sorted(f for f in os.listdir(path.removeprefix("file://") + "/blocks") if f.endswith(".parquet"))
    rows = [r for f in files for r in pq.ParquetFile(f"{path.removeprefix('file://')}/blocks/{f}").read(["doc_id", "start"]).to_pylist()]
    assert len(files) >= 16 and [r["doc_id"] for r in rows] == list(range(1, 401))
    assert [r["start"] for r in rows] == sorted(r["start"] for r in rows)


def test_byte_bpe_equals_tiktoken(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    worker = bpe.Codec(path, public_tokenizers.PATTERN, most=3000)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=worker.ranks, special_tokens={})
    hard = [t or "" for t in HARD] + ["a  b", " \n x", "foo \n bar", "foo\n bar", "foo  \n  bar ", "  a", " a ", "ab" * 700, "a\u3000 b", "a \u3000b", "=-" * 300, "hello" * 120, "x" * 5001, "中文字符" * 500, "".join(chr(97 + k * k % 23) for k in range(5000))]
    texts = hard + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for _ in range(2):
        ids = worker.encode(texts)
        assert ids == [" ".join(map(str, encoding.encode_ordinary(t))) for t in texts]
    assert worker.decode(ids) == [t.encode() for t in texts]
    both = [worker._contracted([w.encode()], q) for w in ("hello" * 40, "aaaab" * 30, "x" * 255) for q in (bpe._ENCODE, bpe._ENCODE_LONG)]
    assert both[::2] == both[1::2]


@pytest.mark.parametrize("pattern", [r"\w+ \w+|\s+|\S+", r"(?s).{1,7}"])
def test_byte_bpe_with_another_pattern(pattern):
    worker = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=worker.ranks, special_tokens={})
    texts = ["some words stand here, and there", "a  b\n c", "", "é 中文 x", " lead"]
    assert worker.encode(texts) == [" ".join(map(str, encoding.encode_ordinary(t))) for t in texts]


def test_byte_bpe_memory_is_bounded():
    rng = np.random.default_rng(1)
    worker = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, most=50_000)
    for _ in range(10):
        worker.encode([" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 200)) for _ in range(20))])
        for held in (worker.memory, worker.words):
            assert sum(len(k) + len(v) for k, v in held.items()) < 100_000 and len(held) < 500


def test_byte_bpe_of_awkward_rows(spark):
    got = bpe.encode_documents(awkward(spark)).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in TEXTS)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_documents(awkward(spark).limit(0), digests=True).count() == 0
