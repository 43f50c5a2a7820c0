"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import map_arrow, range_bounds, range_bucket, slices, table, text_of
from granary.llm.shingles import EMPTY, densify, groups, mix, shingle_hashes

BINS, BITS, WORDS = 256, 4, 5


def signatures(texts: list[bytes], bins: int = BINS, bits: int = BITS, words: int = WORDS) -> np.ndarray:
    """The low-order bits of the densified minima of each text, one uint8 a bin. A text without words has zeros.

    A shingle's hash is used once: its high bits name the bin and the bin keeps its least hash. Each bin's number is mixed
    into its minimum before the low bits are taken, so that bins that hold one value agree by chance independently.
    """
    salt = mix(np.arange(1, bins + 1, dtype=np.uint64))
    out = np.zeros((len(texts), bins), np.uint8)
    for a, b in groups(texts):
        hashes, many = shingle_hashes(b"".join(texts[a:b]), np.array([len(t) for t in texts[a:b]], np.int64), words)
        cell = (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64) % bins
        minima = np.full((b - a) * bins, EMPTY)
        np.minimum.at(minima, cell + np.repeat(np.arange(b - a), many) * bins, mix(hashes) >> np.uint64(1))
        dense = densify(minima.reshape(-1, bins))
        out[a:b] = np.where(dense == EMPTY, np.uint64(0), mix(dense ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return out


def packed(signature: np.ndarray, bits: int = BITS) -> list[str]:
    """Rows of low-order bits as hexadecimal strings."""
    rows = np.unpackbits(signature[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(signature), -1)
    return [r.tobytes().hex() for r in np.packbits(rows, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity row by row: the share of equal bins less what equal low bits give by chance, 0 to 1."""
    chance = 1 / (1 << bits)
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(parts: Iterator[pa.RecordBatch], bins: int, bits: int, words: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, role, doc_id, hash of text, text); role 0: first rows of the next range, role 1: the range's own."""
    ahead: dict[str, object] = {"range": None, "text": ""}
    held: tuple | None = None  # the row whose following text is not known yet

    def done(rows: list[tuple]) -> pa.RecordBatch:
        docs, texts, nexts = zip(*rows)
        raw = [t.encode() for t in texts]
        changed = [edited(t, n).encode() for t, n in zip(texts, nexts)]
        own = signatures(raw, bins, bits, words)
        other = signatures(changed, bins, bits, words)
        # the next row's text is mostly the following row of this very list
        after = np.empty_like(own)
        after[:-1] = own[1:]
        last = [k for k in range(len(rows)) if k + 1 == len(rows) or nexts[k] is not texts[k + 1]]
        after[last] = signatures([nexts[k].encode() for k in last], bins, bits, words)
        columns = [
            pa.array(docs, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            pa.array(packed(own, bits)),
            pa.array(packed(other, bits)),
            pa.array(likeness(own, other, bits)),
            pa.array(likeness(own, after, bits)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ready: list[tuple] = []
    size = 0
    for part in slices(parts, 3):
        for range_, role, doc, text in zip(*(part.column(i).to_pylist() for i in range(4))):
            if ahead["range"] != range_:
                if held:
                    ready.append((*held, ahead["text"]))
                    held = None
                ahead = {"range": range_, "text": None}
            if role == 0:
                if ahead["text"] is None:
                    ahead["text"] = text
                continue
            if held:
                ready.append((*held, text))
                size += len(text)
            held = (doc, text)
            if size > 1 << 20:
                yield done(ready)
                ready, size = [], 0
    if held:
        ready.append((*held, ahead["text"]))
    if ready:
        yield done(ready)


def compare_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS, rows_per_range: int = 4000) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts, and their likeness.

    One shuffle of the texts, by ranges of doc_id, each to the partition of its number; the first row of a range that has
    rows also goes to the last range before it that has rows (that of the first one to the last one), so that each task
    finds the text that follows its last row. A task streams its rows and holds a few MB of them. Rows that tie on doc_id
    follow each other in order of a hash of their text; if they are so many that they hold several ranges, they are dealt
    over these by it. A null doc_id stands first, a null text counts as empty, a single row follows itself, an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    bounds = range_bounds(rows, "doc_id", rows_per_range)
    n = len(bounds) + 1
    spread = F.xxhash64("text")
    own = range_bucket("doc_id", bounds, spread)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", spread.alias("spread")))
    opens = rows.groupBy(own.alias("range")).agg(first.alias("first")).orderBy("range").collect()  # a row for each range
    known = [(r["range"], r["first"]["doc_id"], r["first"]["spread"], opens[k - 1]["range"]) for k, r in enumerate(opens)]
    ends = docs.sparkSession.createDataFrame(known, "range int, first_id long, first_spread long, ahead int")
    rows = rows.withColumns({"range": own, "spread": spread}).join(F.broadcast(ends), "range")
    firsts = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("spread") == F.col("first_spread"))
    lead = F.struct(F.col("ahead").alias("range"), F.lit(0).alias("role"))
    target = F.struct(F.col("range"), F.lit(1).alias("role"))
    sent = rows.select(F.explode(F.when(firsts, F.array(target, lead)).otherwise(F.array(target))).alias("to"), "doc_id", "spread", "text")
    dealt = sent.select("to.range", "to.role", "doc_id", "text", "spread").repartitionById(n, "range")
    dealt = dealt.sortWithinPartitions("range", "role", F.col("doc_id").asc_nulls_first(), "spread", "text").drop("spread")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(dealt, lambda parts: _compared(parts, bins, bits, words), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
