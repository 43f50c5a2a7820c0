"""Token ids in files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

The files are a folder in any store that Spark writes to: ``blocks`` (Parquet; a row per document with its bits) and
``lengths`` (Parquet; the code length of each id, from which the canonical code follows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import map_arrow, materialize, range_bounds, range_bucket, scratch, slices, small_batches, table, work_path

END, LIMIT, STRIDE = 1, 18, 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, merged = [], weight
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))  # whether each item of the merged list is an id itself
        merged = both[rank]
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, each the one before plus one."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        span = np.uint64(1) << (np.uint64(lengths.max()) - lengths[order].astype(np.uint64))
        first = np.concatenate([[np.uint64(0)], np.cumsum(span)[:-1]]).astype(np.uint64)
        codes[order] = first >> (np.uint64(lengths.max()) - lengths[order].astype(np.uint64))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each next ``width`` bits: the id, shifted by 5, and its code length."""
    width, used = int(lengths.max(initial=1)), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    found = np.repeat(entry, 1 << (width - lengths[order].astype(np.int64)))
    return np.concatenate([found, np.zeros((1 << width) - len(found), np.uint32)]), width


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits and checkpoints of consecutive documents of ``sizes`` ids: each begins on a byte of its own.

    Returns the bytes, how many each document has, the checkpoints and how many each has. The checkpoints are the bit offsets of each ``stride``-th id, as little-endian uint32.
    """
    length = lengths[ids].astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([[0], np.cumsum(length)])
    bits = total[firsts[1:]] - total[firsts[:-1]]
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = total[:-1] + np.repeat(begin[:-1] * 8 - total[firsts[:-1]], sizes)
    word = at >> 5
    shifted = codes[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - length.astype(np.uint64))
    # a code of at most 32 bits touches two words of 32 bits
    out = np.zeros(int(begin[-1] // 4) + 3, np.uint32)
    if len(ids):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sums = np.add.reduceat(shifted, heads)  # the bits are apart, so a sum is an or
        out[word[heads]] |= (sums >> np.uint64(32)).astype(np.uint32)
        out[word[heads] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = out.astype(">u4").view(np.uint8)[: begin[-1]]
    nth = np.arange(len(ids)) - np.repeat(firsts[:-1], sizes)
    marked = nth % stride == 0
    marks = (at - np.repeat(begin[:-1] * 8, sizes))[marked].astype("<u4")
    return data, np.diff(begin), marks, -(-sizes // stride)


def decode_blocks(sizes: np.ndarray, bits: bytes, n_bits: np.ndarray, marks: np.ndarray, found: np.ndarray, width: int, stride: int = STRIDE) -> np.ndarray:
    """Ids of consecutive documents of ``sizes`` ids: the runs between checkpoints are decoded side by side."""
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)])
    begin = np.concatenate([[0], np.cumsum(n_bits)])
    runs = -(-sizes // stride)
    marks = marks.astype(np.int64)
    at = marks + np.repeat(begin[:-1] * 8, runs)
    first_run = np.concatenate([[0], np.cumsum(runs)])
    nth = np.arange(len(at)) - np.repeat(first_run[:-1], runs)
    left = np.minimum(stride, np.repeat(sizes, runs) - nth * stride)
    order = np.argsort(-left, kind="stable")
    at, left = at[order], left[order]
    ids = np.zeros((stride, len(at)), np.uint32)
    wide = (raw[:-7].astype(np.uint64) << np.uint64(24)) | (raw[1:-6].astype(np.uint64) << np.uint64(16)) | (raw[2:-5].astype(np.uint64) << np.uint64(8)) | raw[3:-4].astype(np.uint64)
    wide = wide.astype(np.uint32)
    live = np.searchsorted(-left, -np.arange(stride), side="left")  # runs with more than k ids
    mask = np.uint32((1 << width) - 1)
    for k in range(stride):
        n = int(live[k])
        if not n:
            break
        a = at[:n]
        entry = found[(wide[a >> 3] >> (32 - width - (a & 7)).astype(np.uint32)) & mask]
        ids[k, :n] = entry >> np.uint32(5)
        at[:n] += entry & np.uint32(31)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    by_run, left = ids.T[back], left[back]
    return by_run[np.arange(stride) < left[:, None]]


def _tokenized(parts: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from granary.llm.tokenize import word_tokenizer

    tokenizer = word_tokenizer(path, 112 << 20)
    for part in slices(parts, 1, 4 << 20):  # fewer, larger searches among the remembered chunks
        ids, sizes = tokenizer.encode(part.column(1).to_pylist(), end)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), binaries(ids.astype("<u2" if tokenizer.size <= 65536 else "<u4"), sizes)], names=["doc_id", "n_tokens", "ids"])


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``sizes`` numbers as an Arrow array of their bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _raw(column: pa.Array) -> memoryview:
    """The bytes of a column of binaries without nulls, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]


def _numbers(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The ids of a column of binaries, two or four bytes each."""
    raw = _raw(column)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * int(sizes.sum()) else "<u4")


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for part in parts:
        got = np.bincount(_numbers(part.column(1), np.asarray(part.column(0))), minlength=len(counts))
        got[: len(counts)] += counts
        counts = got
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])


def _coded(parts: Iterator[pa.RecordBatch], lengths: np.ndarray, stride: int) -> Iterator[pa.RecordBatch]:
    codes = canonical(lengths)
    for part in parts:
        for a in range(0, part.num_rows, 512):
            piece = part.slice(a, 512)
            sizes = np.asarray(piece.column(1))
            bits, n_bits, marks, n_marks = encode_blocks(_numbers(piece.column(2), sizes), sizes, lengths, codes, stride)
            columns = [piece.column(0), piece.column(1), binaries(bits, n_bits), binaries(marks, n_marks), piece.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "bits", "checkpoints", "spread"])


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end: int = END, limit: int = LIMIT, stride: int = STRIDE, rows_per_file: int = 20_000) -> str:
    """Encode documents (doc_id, text) and write their ids in the folder ``path``, in ascending doc_id order.

    Jobs: encode each text once into an intermediate table in the shared folder; range bounds of doc_id; sum the counts
    of ids (the driver gets one row per id of the vocabulary); code each document with the global code; shuffle the
    coded documents by range, each to the partition of its number, and write them sorted, so that the order of the part
    files is that of the ranges. ``start`` comes from the sums of the ranges and a running sum within each. Null texts count
    as empty, null doc_ids stand first, rows that repeat a doc_id stand beside each other in order of a hash of their ids
    (if they are so many that they hold several ranges, they are dealt over these by it), an empty table gives an empty
    folder of files; other columns are not read.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    name = str(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):
        kinds = "doc_id long, n_tokens long, ids binary"
        encoded = materialize(map_arrow(rows, lambda parts: _tokenized(parts, name, end), kinds), "ids")
        encoded = encoded.withColumn("spread", F.xxhash64("ids"))
        bounds = range_bounds(encoded, "doc_id", rows_per_file)
        bucket = range_bucket("doc_id", bounds, F.col("spread"))
        counted = map_arrow(encoded.select("n_tokens", "ids"), _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
        for r in counted:
            counts[r["id"]] = r["n"]
        lengths = code_lengths(counts, limit)
        sums = {r["bucket"]: r["n"] for r in encoded.groupBy(bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n")).collect()}
        before, starts = 0, []
        for k in range(len(bounds) + 1):
            starts.append(before)
            before += sums.get(k, 0)
        kinds = "doc_id long, n_tokens long, bits binary, checkpoints binary, spread long"
        coded = map_arrow(encoded.select("doc_id", "n_tokens", "ids", "spread"), lambda parts: _coded(parts, lengths, stride), kinds)
        order = [F.col("doc_id").asc_nulls_first(), "spread", "n_tokens", "bits"]
        running = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        base = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("bucket") + 1)
        blocks = (
            coded.withColumn("bucket", bucket)
            .repartitionById(len(bounds) + 1, "bucket")
            .withColumn("start", base + F.coalesce(running, F.lit(0)))
            .select("bucket", "doc_id", "start", "n_tokens", "bits", "checkpoints")
        )
        with small_batches(spark):
            blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    table_rows = spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used], pa.int32())}))
    table_rows.coalesce(1).write.parquet(f"{path}/lengths")
    return path


def _decoded(parts: Iterator[pa.RecordBatch], lengths: np.ndarray, stride: int) -> Iterator[pa.RecordBatch]:
    found, width = decoding_table(lengths)
    for part in parts:
        for a in range(0, part.num_rows, 512):
            piece = part.slice(a, 512)
            sizes = np.asarray(piece.column(2))
            n_bits = np.asarray(pc.binary_length(piece.column(3)))
            ids = decode_blocks(sizes, _raw(piece.column(3)), n_bits, np.frombuffer(_raw(piece.column(4)), "<u4"), found, width, stride).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            sums = [zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(2), binaries(ids, sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])


def read_ids(spark: SparkSession, path: str, stride: int = STRIDE, checksums_only: bool = False) -> DataFrame:
    """Read a folder of :func:`write_ids` back: doc_id, start, n_tokens, ids (little-endian uint32), ids_crc32.

    With ``checksums_only`` the ids are decoded but not returned. Blocks are independent of each other.
    """
    rows = spark.read.parquet(f"{path}/lengths").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    kinds = "doc_id long, start long, n_tokens long, " + "ids binary, " * (not checksums_only) + "ids_crc32 long"

    def decoded(parts):
        for batch in _decoded(parts, lengths, stride):
            yield batch.drop_columns(["ids"]) if checksums_only else batch

    blocks = spark.read.parquet(f"{path}/blocks").select("doc_id", "start", "n_tokens", "bits", "checkpoints")
    return map_arrow(blocks, decoded, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ids(table(spark, sf_dir, "documents"), work_path(spark, "token-files"))
    return read_ids(spark, path, checksums_only=True)
