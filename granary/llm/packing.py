"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

The remaining lengths are those of the whole table, as a count for each length below the window. The windows are planned on
these counts alone; a plan has a few lines for each length, since a filling that is the best one is repeated until one
of its lengths is short. Each piece then finds its place in the plan by its number among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import keyed_side, map_arrow, materialize, scratch, slices, table

WINDOW, END = 2048, 1


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is closest to ``room`` from below, as counts by length.

    Subset sums are the bits of one integer; a length that occurs c times enters as 1, 2, 4, ... copies and a rest. The
    search ends as soon as ``room`` itself is reached; the counts are read back from the states that were kept.
    """
    mask, states, items = (1 << (room + 1)) - 1, [1], []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            items.append((length, take))
            states.append((states[-1] | states[-1] << length * take) & mask)
            left, copies = left - take, copies * 2
            if states[-1] >> room & 1:
                left, copies = 0, 0
        if states[-1] >> room & 1:
            break
    at, chosen = states[-1].bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(states[:-1])):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(filling as copies by length, windows filled so), until ``counts`` (number of pieces by length) is empty.

    Each window takes the longest length and the best multiset beside it. What was best stays best as long as its lengths
    last, so it is repeated at once, until one of them is short.
    """
    left, lines = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        picked = fill({k: n for k, n in left.items() if n}, window - longest)
        left[longest] += 1
        picked[longest] = picked.get(longest, 0) + 1
        times = min(left[k] // m for k, m in picked.items())
        for k, m in picked.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        lines.append((picked, times))
    return lines


def spots(lines: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """A row for each length of each line of a plan, by length and first number: length, number of its first piece, pieces
    a window, first sequence, offset of its pieces in the window."""
    rows, used, sequence = [], {}, 0
    for picked, times in lines:
        offset = 0
        for length in sorted(picked, reverse=True):
            copies = picked[length]
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(parts: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to pieces: whole windows, and a rest with its number among the task's rests of its length."""
    from pyspark import TaskContext

    from granary.llm.tokenize import word_tokenizer

    tokenizer, task = word_tokenizer(path), TaskContext.get().partitionId()
    rests, whole = np.zeros(window, np.int64), 0
    for part in slices(parts, 1):
        flat, sizes = tokenizer.encode(part.column(1).to_pylist(), end)
        pieces = -(-sizes // window)
        total = np.repeat(sizes, pieces)
        nth = np.arange(len(total)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(total - nth * window, window)
        full = length == window
        number = np.zeros(len(length), np.int64)
        number[full] = whole + np.arange(int(full.sum()))
        whole += int(full.sum())
        at = np.flatnonzero(~full)
        order = at[np.argsort(length[at], kind="stable")]
        size, first, many = np.unique(length[order], return_index=True, return_counts=True)
        number[order] = np.repeat(rests[size] - first, many) + np.arange(len(order))
        rests[size] += many
        kind = "<u2" if tokenizer.size <= 65536 else "<u4"
        cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * np.int32(np.dtype(kind).itemsize)
        ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(flat.astype(kind))])
        doc = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), pieces)))
        columns = [doc, pa.array(nth * window), pa.array(length), pa.array(total), pa.array(np.full(len(length), task, np.int64)), pa.array(number), ids]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "task", "number", "ids"])


def _placed(parts: Iterator[pa.RecordBatch], rows: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Pieces with the number of pieces of their length (whole windows: of any) in tasks before theirs, to pieces in place."""
    sequences = 0 if not len(rows) else None
    for part in parts:
        length, number = np.asarray(part.column(2)), np.asarray(part.column(4)) + np.asarray(part.column(5))
        sequence, offset = -1 - number, np.zeros(len(length), np.int64)  # whole windows count down from -1
        rest = np.flatnonzero(length < window)
        if len(rest) and sequences is None:
            # the line of a piece: the last one of its length that begins at or before its number
            by = np.lexsort((number[rest], length[rest]))
            rest = rest[by]
            lines = np.concatenate([rows[:, :2], np.stack([length[rest], number[rest]], 1)])
            where = np.lexsort((np.repeat([0, 1], [len(rows), len(rest)]), lines[:, 1], lines[:, 0]))
            own = np.maximum.accumulate(np.where(where < len(rows), where, -1))[where >= len(rows)]
            _, first, copies, begin, place = rows[own].T
            nth = number[rest] - first
            sequence[rest] = begin + nth // copies
            offset[rest] = place + nth % copies * length[rest]
        columns = [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(sequence), pa.array(offset), part.column(6)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Cut and pack documents (doc_id, text) into sequences of at most ``window`` ids.

    Returns pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, two bytes each if the
    vocabulary allows, else four). A document's ids are those of its whole text, then ``end``. Whole windows of a long
    document stand alone, under negative sequence ids; the rests of all documents fill windows by minimum bin slack,
    under sequence ids from 0. The pieces of a sequence stand beside each other in one partition, in order of their offsets.

    Jobs: encode each text once into a table in the shared folder; count pieces by task and length (the driver gets a row
    per length below the window, and plans); running sums of these counts over tasks, and the plan, give each piece its
    place; one shuffle brings sequences together. A lost task finds the same places again.

    Null text counts as empty and gives one piece with ``end`` alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = str(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with scratch(docs.sparkSession) as work:
        kinds = "doc_id long, start long, length long, doc_tokens long, task long, number long, ids binary"
        pieces = materialize(map_arrow(rows, lambda parts: _cut(parts, path, window, end), kinds), "pieces")
        counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
        totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
        work.keep(pieces, counts)
    found = spots(plan({r["length"]: r["n"] for r in totals if r["length"] < window}, window))
    numbered = pieces.join(keyed_side(counts.select("task", "length", "before")), ["task", "length"])
    kinds = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    placed = map_arrow(numbered.select("doc_id", "start", "length", "doc_tokens", "before", "number", "ids"), lambda parts: _placed(parts, found, window), kinds)
    return placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")


def wide(ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ids of two or four bytes each, as uint32."""
    return ids.view("<u2" if len(ids) == 2 * int(length.sum()) else "<u4").astype("<u4")


def _digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for part in parts:
        length = np.asarray(part.column(2))
        raw = part.column(6)
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
        ids = wide(np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], length)
        cuts = np.concatenate([[0], np.cumsum(length)]).tolist()
        sums = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
        columns = [part.column(0), part.column(1), part.column(2), sums, *(part.column(i) for i in (3, 4, 5))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids, as little-endian uint32, in place of the ids."""
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(pieces, _digested, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with their ids."""
    return pack_documents(docs)
