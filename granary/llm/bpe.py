"""Byte-level BPE by DuckDB recursive queries, a database per worker process; decoding by ordered aggregation."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import batches, map_arrow, slices, table

#: A state row is a word with its tokens; its token positions, as rows, join the merge table, and each word's pair of minimum
#: rank, leftmost among equals, is contracted. A word without a pair that merges has come to its fixpoint.
_ENCODE = """
WITH RECURSIVE state(word, tokens) AS (
  SELECT word, tokens FROM words
  UNION ALL
  SELECT s.word, list_concat(s.tokens[:best.i - 1], [best.merged], s.tokens[best.i + 2:])
  FROM state s JOIN (
    SELECT p.word, min({'merged': m.merged, 'i': p.i}) AS best
    FROM (SELECT word, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS i FROM state) p
    JOIN merges m ON m.a = p.a AND m.b = p.b
    GROUP BY p.word
  ) f ON f.word = s.word
)
SELECT word, array_to_string(arg_min(tokens, len(tokens)), ' ') AS ids FROM state GROUP BY word ORDER BY word
"""
#: The same for long words, of which only the last state is held. A calm merge is one whose token no merge of lower rank
#: takes: after the leftmost pair, the next equal one is contracted next, and so on, so that all of them are contracted in
#: one step, every other one where they overlap. Of a merge that is not calm, the leftmost pair is contracted alone.
_ENCODE_LONG = """
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM words
  UNION
  SELECT word, list(CASE WHEN start THEN merged ELSE a END ORDER BY i) FILTER (NOT coalesce(gone, false))
  FROM (
    SELECT word, i, a, merged, start, lag(start) OVER (PARTITION BY word ORDER BY i) AS gone
    FROM (
      SELECT word, i, a, merged,
        hit AND CASE WHEN calm THEN row_number() OVER (PARTITION BY word, run, hit ORDER BY i) % 2 = 1 ELSE i = first END AS start
      FROM (
        SELECT word, i, a, merged, calm, coalesce(merged = least, false) AS hit,
          min(i) FILTER (merged = least) OVER (PARTITION BY word) AS first,
          i - sum(coalesce(merged = least, false)::INT) OVER (PARTITION BY word ORDER BY i) AS run
        FROM (
          SELECT p.word, p.i, p.a, m.merged, m.calm, min(m.merged) OVER (PARTITION BY p.word) AS least
          FROM (SELECT word, unnest(tokens) AS a, unnest(list_append(tokens[2:], -1)) AS b, unnest(range(len(tokens))) AS i FROM state) p
          LEFT JOIN merges m ON m.a = p.a AND m.b = p.b
        ) WHERE least IS NOT NULL
      )
    )
  ) GROUP BY word
)
SELECT word, array_to_string(tokens, ' ') AS ids FROM state ORDER BY word
"""
#: A token's text has a character for each byte.
_DECODE = """
SELECT c.doc, array_to_string(list(v.text ORDER BY c.i), '') AS text
FROM coded c JOIN vocabulary v ON v.id = c.id GROUP BY c.doc
"""
#: Words of more bytes are contracted by the query for long words; both queries give the same ids.
LONGEST = 256
#: A space that does not begin a word.
_RUN = re.compile(r" (?:\s|$)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _size(strings) -> int:
    """Bytes that strings in a table take, about."""
    return sum(map(len, strings)) + 100 * len(strings)


class Codec:
    """Encodes and decodes with the ranks of one file.

    Remembers the ids of words, and of the chunks between spaces; if these and their keys take more than ``most``
    bytes, those of the latest texts stay. Chunks are for the pattern of :mod:`public_tokenizers` alone, of which no
    match crosses a cut; with another pattern texts are split whole.
    """

    def __init__(self, path: str, pattern: str, most: int = 96 << 20, memory_mb: int = 300):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks, self.pattern, self.most = read_ranks(path), regex.compile(pattern), most
        self.chunked = pattern == public_tokenizers.PATTERN
        self.split_at = regex.compile(r"(?= \S)")
        self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.db = duckdb.connect()
        self.db.execute(f"SET threads = 1; SET memory_limit = '{memory_mb}MB'; SET preserve_insertion_order = false")
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        columns = pa.table([pa.array(c, pa.int32()) for c in zip(*merges)], names=["a", "b", "merged"])
        self.db.register("merge_rows", columns)
        self.db.execute("CREATE TABLE takes AS SELECT t, min(merged) AS least FROM (SELECT a AS t, merged FROM merge_rows UNION ALL SELECT b, merged FROM merge_rows) GROUP BY t")
        self.db.execute("CREATE TABLE merges AS SELECT r.*, coalesce(t.least, r.merged) >= r.merged AS calm FROM merge_rows r LEFT JOIN takes t ON t.t = r.merged; CHECKPOINT")
        self.db.unregister("merge_rows")
        self.together = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for token in self.ranks:
            raw = np.frombuffer(token, np.uint8)
            self.together[raw[:-1], raw[1:]] = True
        vocabulary = pa.table({"id": pa.array(list(self.token), pa.int32()), "text": pa.array([t.decode("latin-1") for t in self.token.values()])})
        self.db.register("vocabulary_rows", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.db.unregister("vocabulary_rows")
        self.memory: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.held = [0, 0]  # bytes of both, about

    def contract(self, words: list[str]) -> list[str]:
        """The ids of each word (one match of the pattern), as decimal numbers joined by spaces."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [""] * len(raw)
        short = [k for k, w in enumerate(raw) if len(w) <= LONGEST]
        for k, ids in zip(short, self._contracted([raw[k] for k in short], _ENCODE)):
            out[k] = ids
        if len(short) < len(raw):
            long = [k for k, w in enumerate(raw) if len(w) > LONGEST]
            pieces = [self._pieces(raw[k]) for k in long]
            found = iter(self._contracted(list(chain.from_iterable(pieces)), _ENCODE_LONG))
            for k, p in zip(long, pieces):
                out[k] = " ".join(next(found) for _ in p)
        return out

    def _pieces(self, word: bytes) -> list[bytes]:
        """A word cut where two bytes meet that no token holds side by side: no token crosses such a cut."""
        data = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.together[data[:-1], data[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _contracted(self, raw: list[bytes], query: str, most: int = 400_000) -> list[str]:
        """The ids of words of about ``most`` bytes at once; a longer word stands alone."""
        out: list[str] = []
        for first, last in batches(raw, most):
            part = raw[first:last]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])]).astype(np.int32)
            tokens = self.bytes_of[np.frombuffer(b"".join(part), np.uint8)]
            rows = pa.table({"word": pa.array(np.arange(len(part), dtype=np.int32)), "tokens": pa.ListArray.from_arrays(offsets, tokens)})
            self.db.register("words", rows)
            out += self.db.sql(query).to_arrow_table().column("ids").to_pylist()
            self.db.unregister("words")
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut before each space that has no white space after it: no match of the pattern crosses such a cut."""
        if not self.chunked:
            return self.pattern.findall(text)
        if _RUN.search(text):
            return [c for c in self.split_at.split(text) if c]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + c for c in rest]

    def encode(self, texts: list[str | None]) -> list[str]:
        """The ids of each text (null: empty) as decimal numbers joined by spaces."""
        cut = [self.chunks(t or "") for t in texts]
        used: set[str] = set()
        for c in cut:
            used.update(c)
        memory, known = self.memory, self.words
        if new := list(used.difference(memory)):
            spelled = list(map(self.pattern.findall, new)) if self.chunked else [[c] for c in new]
            words = set(chain.from_iterable(spelled))
            fresh = list(words.difference(known))
            ids = self.contract(fresh)
            known.update(zip(fresh, ids))
            get = known.__getitem__
            found = [get(s[0]) if len(s) == 1 else " ".join(map(get, s)) for s in spelled]
            memory.update(zip(new, found))
            self.held[0] += _size(fresh) + _size(ids)
            self.held[1] += _size(new) + _size(found)
            if self.held[0] > self.most:  # what recurs is in the latest texts
                self.words = {w: known[w] for w in words}
                self.held[0] = _size(self.words) + _size(self.words.values())
        get = memory.__getitem__
        out = [" ".join(map(get, c)) for c in cut]
        if self.held[1] > self.most:
            self.memory = {c: memory[c] for c in used}
            self.held[1] = _size(self.memory) + _size(self.memory.values())
        return out

    def decode(self, ids: list[str], at_once: int = 1 << 20) -> list[bytes]:
        """The bytes of each list of ids, by aggregation ordered by token position."""
        out: list[bytes] = []
        for a, b in batches(ids, at_once):
            counts = np.array([x.count(" ") + 1 if x else 0 for x in ids[a:b]])
            numbers = np.fromstring(" ".join(x for x in ids[a:b] if x), np.int32, sep=" ")
            places = np.arange(len(numbers), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
            self.db.register("coded", pa.table({"doc": np.repeat(np.arange(b - a, dtype=np.int32), counts), "i": places, "id": numbers}))
            found = dict(self.db.sql(_DECODE).fetchall())
            self.db.unregister("coded")
            out += [found.get(k, "").encode("latin-1") for k in range(b - a)]
        return out


_loaded: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def _ran(parts: Iterator[pa.RecordBatch], path: str, pattern: str, full: bool) -> Iterator[pa.RecordBatch]:
    worker = codec(path, pattern)
    for part in slices(parts, 1):
        ids = worker.encode(part.column(1).to_pylist())
        raw = worker.decode(ids)
        columns = [part.column(0), pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())]
        if full:
            columns += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(raw, pa.binary())]
        else:
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids" if full else "ids_sha256", "decoded" if full else "decoded_sha256"])


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """Encode documents (doc_id, text) and decode the ids again: doc_id, n_tokens, ids, decoded (bytes).

    With ``digests``: the SHA-256 of the decimal ids joined by one space and of the decoded bytes instead. Each match of
    ``pattern`` (matches cover the text, without groups) is encoded by itself, without special tokens. One pass over the scan's partitions, no shuffle; a worker
    holds a few MB of texts, its database and a bounded memory of chunks. Null texts count as empty and have no ids;
    a null doc_id stays null, repeated rows stay, an empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    path, split = str(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN
    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, lambda parts: _ran(parts, path, split, not digests), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
