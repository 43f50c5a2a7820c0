"""n-gram Jaccard join: MinHash LSH forest for candidates, exact verification of their shingle sets.

Texts with equal shingle sets are one class. Each tree of the forest sorts the classes by a string of MinHash labels of
its own, as a walk through its prefix trie; classes meet at the prefix that they share there. Prefixes are
shortened from the deepest on until the links that they find reach the target recall. Meetings whose sketches are near
the threshold make candidate groups, and within a group all sets are compared exactly: each text is read once, as its
difference from the group's first text, and what leaves a task is a row per class, never a row per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import fresh, keyed_side, map_arrow, materialize, scratch, slices, table, text_of
from granary.llm.graph import components
from granary.llm.shingles import EMPTY, densify, distinct, groups, mix, shingle_hashes

WORDS, THRESHOLD = 5, 0.8
TREES, RECALL = 96, 0.9999
#: A sketch has a label of 8 bits in each bin of a few independent one-permutation hashings.
PASSES, BINS = 8, 32
#: Labels that a tree has beyond the shortest prefix; trees that are walked first.
LEVELS, FIRST = 8, 8
#: Neighbours are candidates if their sketches' likeness is less than the threshold by this at most: more than four
#: standard deviations of the estimate.
MARGIN = 0.12
_TAG = np.uint64(0xA5A5A5A5A5A5A5A5)


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two sets share a prefix of ``depth`` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_for(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets with probability ``recall``."""
    depth = 1
    while depth < 24 and meets(threshold, depth + 1, trees) >= recall:
        depth += 1
    return depth


def depth_for(found: list[tuple[float, int]], shortest: int, threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """Shorten the prefix until the forest meets ``recall`` of the links, by what its first trees have met.

    ``found`` counts the pairs of the first trees by estimated similarity. A link of similarity s stands for as many links as
    the inverse of its chance to be met there; each of these is met by the whole forest with a chance that grows as the prefix
    gets shorter. The shortest prefix holds for any pair at the threshold.
    """
    links = [(max(near, threshold), n) for near, n in found if near >= threshold]
    weights = [n / meets(near, shortest, FIRST) for near, n in links]
    for depth in range(shortest + LEVELS, shortest, -1):
        if weights and sum(w * meets(near, depth, trees) for (near, _), w in zip(links, weights)) >= recall * sum(weights):
            return depth
    return shortest


def sketches(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A row of labels for each text (``many`` consecutive hashes): low bits of the densified minima of all passes."""
    n, owner = len(many), np.repeat(np.arange(len(many)) * BINS, many)
    minima = np.full((PASSES, n * BINS), EMPTY)
    for k in range(PASSES):
        value = mix(hashes + np.uint64((k + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        np.minimum.at(minima[k], (value >> np.uint64(59)).astype(np.int64) + owner, value & np.uint64((1 << 59) - 1))
    dense = densify(minima.reshape(-1, BINS)).reshape(PASSES, n, BINS).transpose(1, 0, 2).reshape(n, PASSES * BINS)
    return (mix(dense ^ mix(np.arange(1, PASSES * BINS + 1, dtype=np.uint64))) & np.uint64(255)).astype(np.uint8)


def tree_places(trees: int, depth: int) -> np.ndarray:
    """The places of a sketch whose labels make the string of each tree."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(PASSES * BINS)[:depth] for _ in range(trees)])


def _signed(parts: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in slices(parts, 2):
        texts = [t.encode() for t in part.column(2).to_pylist()]
        hashes, many = shingle_hashes(b"".join(texts), np.array([len(t) for t in texts], np.int64), words)
        labels = sketches(hashes, many)
        sets, sizes = distinct(hashes, many)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        digests = [hashlib.blake2b(sets[x:y], digest_size=16).digest() for x, y in zip(cuts, cuts[1:])]
        found = [row.tobytes() if n else None for row, n in zip(labels, many)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        columns = [part.column(0), part.column(1), pa.array(digests, pa.binary()), sizes, pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "digest", "bytes", "sketch"])


def sign(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, digest of the shingle set, bytes, sketch (null for a text without words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return map_arrow(rows, lambda parts: _signed(parts, words), "doc_id long, text_hash long, digest binary, bytes long, sketch binary")


def _labels(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PASSES * BINS)


def _strung(parts: Iterator[pa.RecordBatch], trees: range, shortest: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, sketch, group) to a row for each tree: a key of the tree and the shortest prefix, and the labels beyond it."""
    places = tree_places(trees.stop, shortest + LEVELS)
    power = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(shortest)], np.uint64)
    for part in parts:
        labels, n = _labels(part.column(1)), part.num_rows
        roots, tails = np.zeros((n, len(trees)), np.uint64), np.zeros((n, len(trees), LEVELS), np.uint8)
        for k, t in enumerate(trees):
            roots[:, k] = mix(((labels[:, places[t, :shortest]].astype(np.uint64) + np.uint64(1)) * power).sum(1, dtype=np.uint64) + np.uint64(t))
            tails[:, k] = labels[:, places[t, shortest:]]
        nodes, own = (pa.array(np.repeat(np.asarray(part.column(i)), len(trees))) for i in (0, 2))
        tail = tails.reshape(-1, LEVELS).view(">u8").reshape(-1).astype(np.uint64)
        columns = [nodes, own, pa.array(roots.reshape(-1).view(np.int64)), pa.array(tail.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "group", "root", "tail"])


def _near(parts: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (src, dst, depth, sketch, other) to those whose sketches agree enough, with the number of equal labels."""
    for part in parts:
        if part.num_rows:
            same = (_labels(part.column(3)) == _labels(part.column(4))).sum(1)
            keep = pa.array(same >= least * PASSES * BINS)
            columns = [part.column(0), part.column(1), part.column(2), pa.array(same, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "depth", "same"]).filter(keep)


def shared(a: Column, b: Column, shortest: int) -> Column:
    """Labels that two strings of one root have in common from the first on."""
    differ = a.bitwiseXOR(b)
    found = F.lit(shortest) + (differ == 0).cast("int")
    for k in range(1, LEVELS):
        found = found + (F.shiftrightunsigned(differ, 64 - 8 * k) == 0).cast("int")
    return found


def meetings(known: DataFrame, trees: range, shortest: int) -> DataFrame:
    """(src, dst, depth): classes (node, sketch, group) that stand side by side in the walk through some of ``trees``, belong
    to different groups and share ``depth`` labels, ``shortest`` at least; each two once."""
    strings = map_arrow(known.select("node", "sketch", "group"), lambda parts: _strung(parts, trees, shortest), "node long, group long, root long, tail long")
    walk = Window.partitionBy("root").orderBy("tail", "node")
    before = F.struct(*[F.lag(c).over(walk).alias(c) for c in ("node", "group", "tail")])
    steps = strings.withColumn("before", before).filter("before.node IS NOT NULL AND before.group != group")
    src, dst = F.least("node", "before.node").alias("src"), F.greatest("node", "before.node").alias("dst")
    return steps.select(src, dst, shared(F.col("tail"), F.col("before.tail"), shortest).alias("depth")).groupBy("src", "dst").agg(F.max("depth").alias("depth"))


def near(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (src, dst, depth) whose sketches (node, sketch) are near the threshold, with ``same``."""
    ends = pairs.join(known.select(F.col("node").alias("src"), "sketch"), "src").join(known.select(F.col("node").alias("dst"), F.col("sketch").alias("other")), "dst")
    kinds = "src long, dst long, depth int, same long"
    return materialize(map_arrow(ends.select("src", "dst", "depth", "sketch", "other"), lambda parts: _near(parts, threshold - MARGIN), kinds), "near")


def neighbours(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(src, dst): near neighbours in the forest, by which classes (node, sketch) that may be linked hang together.

    In each tree a class meets the class that stands before it in the sorted trie. What the first trees meet makes groups and
    gives the depth down to which the prefixes of the others are shortened (:func:`depth_for`); there, only meetings of two
    groups count. All must be near by their sketches, so that texts which share a long passage and no more do not hang
    together. A class has at most one meeting per tree, and a few in all if many texts resemble it.
    """
    shortest = shortest_for(threshold, trees, recall)
    known = classes.filter("sketch IS NOT NULL").select("node", "sketch")
    firsts = near(meetings(known.withColumn("group", F.col("node")), range(FIRST), shortest), known, threshold)
    found = firsts.groupBy("same").count().collect()  # a row for each number of equal labels
    depth = depth_for([(r["same"] / (PASSES * BINS), r["count"]) for r in found], shortest, threshold, trees, recall)
    firsts = firsts.select("src", "dst")
    grouped = known.join(components(firsts, "src", "dst"), "node", "left").withColumn("group", F.coalesce("label", "node"))
    rest = meetings(grouped, range(FIRST, trees), shortest).filter(F.col("depth") >= depth)
    return firsts.unionByName(near(rest, known, threshold).select("src", "dst"))


def compare(
    sets: list[np.ndarray], base: int, missing: np.ndarray, sizes: np.ndarray, weights: np.ndarray, side: np.ndarray, cross: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weight of linked sets for each set, and its component's first set.

    Each of ``sizes`` is a set's size; ``sets`` holds how it differs from a common set of ``base`` members: what it has
    beside that set, and, tagged, the ``missing`` ones. The intersection of two sets is ``base`` less what either misses,
    plus the common part of their differences, which comes from an inverted index. With ``cross`` only pairs of different
    ``side`` count.
    """
    n = len(sets)
    each = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), each)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    sorted_owner = owner[order]
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])[: len(flat)]
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    freq = np.diff(np.concatenate([first, [len(flat)]]))
    back = np.empty_like(number)
    back[order] = number
    cuts = np.concatenate([[0], np.cumsum(each)])
    linked = np.zeros((n, n), bool)
    for k in range(n):
        mine = back[cuts[k] : cuts[k + 1]]
        mine = mine[freq[mine] > 1]
        both = base - missing[k] - missing
        if len(mine):
            many = freq[mine]
            at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = both + np.bincount(sorted_owner[at], minlength=n)
        linked[k] = both >= threshold * (sizes[k] + sizes - both) - 1e-9
        linked[k, k] = False
    if cross:
        linked &= side[:, None] != side[None, :]
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0:
            root[k], todo = k, [k]
            while todo:
                more = np.flatnonzero(linked[todo.pop()] & (root < 0))
                root[more] = k
                todo += more.tolist()
    return linked @ weights, root


def _once(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node (column 0) of a partition: rows that repeat a document stay behind before the shuffle."""
    seen: set[int] = set()
    for part in parts:
        keep = []
        for node in part.column(0).to_pylist():
            keep.append(node not in seen)
            seen.add(node)
        yield part if all(keep) else part.filter(pa.array(keep))


_DELTAS = pa.schema(
    [("part", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32()), ("node", pa.int64()), ("weight", pa.int64()), ("base", pa.int64())]
    + [("missing", pa.int64()), ("size", pa.int64()), ("delta", pa.binary()), ("links", pa.int64()), ("root", pa.int64())]
)


def _deltas(parts: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, lead, node, own, blocks, weight, text) sorted by part, block and lead first.

    Each block's texts become differences from its group's lead. A group of one block is compared at once.
    """
    out: list[tuple] = []

    def close(key: tuple, rows: dict[int, tuple]) -> None:
        raw = [r[3].encode() for r in rows.values()]
        sets: list[np.ndarray] = []
        for a, b in groups(raw):
            hashes, many = shingle_hashes(b"".join(raw[a:b]), np.array([len(t) for t in raw[a:b]], np.int64), words)
            hashes, many = distinct(hashes, many)
            sets += np.split(hashes, np.cumsum(many)[:-1])
        lead, nodes = sets[0], list(rows)
        lost = [np.setdiff1d(lead, s, assume_unique=True) ^ _TAG for s in sets]
        differ = [np.concatenate([np.setdiff1d(s, lead, assume_unique=True), m]) for s, m in zip(sets, lost)]
        if next(iter(rows.values()))[1] == 1:
            weights = np.array([r[2] for r in rows.values()], np.int64)
            links, root = compare(differ, len(lead), np.array([len(m) for m in lost]), np.array([len(s) for s in sets]), weights, np.zeros(len(sets)), False, threshold)
            out.extend((key[0], None, None, nodes[k], None, None, None, None, None, int(links[k]), nodes[root[k]]) for k in np.flatnonzero(links))
            return
        for k, (own, blocks, weight, _) in enumerate(rows.values()):
            if own == key[1]:  # the lead is a member of one block only
                out.append((key[0], own, blocks, nodes[k], weight, len(lead), len(lost[k]), len(sets[k]), differ[k].tobytes(), None, None))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DELTAS)], schema=_DELTAS)
        out.clear()
        return batch

    task, rows = None, {}
    for part in slices(parts, 7):
        for k, block, _, node, *row in zip(*(part.column(i).to_pylist() for i in range(8))):
            if (k, block) != task:
                if rows:
                    close(task, rows)
                task, rows = (k, block), {}
            rows.setdefault(node, tuple(row))
        if out:
            yield flush()
    if rows:
        close(task, rows)
    if out:
        yield flush()


def _crossed(parts: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, low, high, own, node, weight, base, missing, size, delta) sorted by pair of blocks: each is compared when it is over."""
    out: list[tuple] = []

    def close(key: tuple, rows: list[tuple]) -> None:
        side, nodes, weights, base, missing, sizes, deltas = zip(*rows)
        sets = [np.frombuffer(d, np.uint64) for d in deltas]
        links, root = compare(sets, base[0], np.array(missing), np.array(sizes), np.array(weights, np.int64), np.array(side), key[1] != key[2], threshold)
        out.extend((nodes[k], int(links[k]), nodes[root[k]]) for k in np.flatnonzero(links))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])
        out.clear()
        return batch

    task, rows = None, []
    for part in slices(parts, 9):
        for k, low, high, *row in zip(*(part.column(i).to_pylist() for i in range(10))):
            if (k, low, high) != task:
                if rows:
                    close(task, rows)
                task, rows = (k, low, high), []
            rows.append(tuple(row))
        if out:
            yield flush()
    if rows:
        close(task, rows)
    if out:
        yield flush()


def verify(docs: DataFrame, members: DataFrame, words: int, threshold: float, block_classes: int, block_bytes: int) -> DataFrame:
    """(node, links, root): exact links within the groups of ``members`` (node, part, n, rep, bytes).

    A group of more than ``block_classes`` classes or ``block_bytes`` of text is dealt out in blocks. Each text is read by
    its block alone, beside the group's lead; pairs of blocks, a task each, get differences from the lead, not texts.
    """
    spark = docs.sparkSession
    sizes = members.groupBy("part").agg(F.count("*").alias("k"), F.sum("bytes").alias("b"))
    sizes = sizes.select("part", F.greatest(F.ceil(F.col("k") / block_classes), F.ceil(F.col("b") / block_bytes)).cast("int").alias("blocks"))
    rep = [F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")]
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = materialize(members.join(sizes, "part").select("node", "part", "n", "blocks", own.alias("own"), *rep), "dealt")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    told = texts.join(keyed_side(dealt), F.col("rep_id").eqNullSafe(F.col("d")) & (F.col("rep_hash") == F.col("h")))
    kinds = "node long, part long, own int, blocks int, weight long, text string"
    told = map_arrow(told.select("node", "part", "own", "blocks", F.col("n").alias("weight"), "text"), _once, kinds)
    lead = F.col("node") == F.col("part")
    block = F.explode(F.when(lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))
    rows = told.select("part", block.alias("block"), (~lead).alias("follows"), "node", "own", "blocks", "weight", "text")
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block", "follows", "node")
    kinds = "part long, own int, blocks int, node long, weight long, base long, missing long, size long, delta binary, links long, root long"
    deltas = materialize(map_arrow(rows, lambda parts: _deltas(parts, words, threshold), kinds), "deltas")

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = deltas.filter("links IS NULL").select("*", other)
    pairs = pairs.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "weight", "base", "missing", "size", "delta")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.expr(f"cast(pmod(xxhash64(part) + cast(high as long) * (high + 1) div 2 + low, {n}) as int)")
    crossed = pairs.withColumn("task", nth).repartitionById(n, "task").drop("task").sortWithinPartitions("part", "low", "high", "node")
    crossed = map_arrow(crossed, lambda parts: _crossed(parts, threshold), "node long, links long, root long")
    return materialize(deltas.filter("links IS NOT NULL").select("node", "links", "root").unionByName(crossed), "links")


def link(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
    block_classes: int = 256,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """All links of similarity ``threshold`` or more among documents (doc_id, text), a row per document.

    Returns doc_id, text_hash, digest, class_id, n_links, keeper: ``class_id`` is the least doc_id of the documents that
    links join, ``n_links`` the number of other documents whose shingle set is that similar (copies included), and
    ``keeper`` is true for the document that stands for its class. The forest's prefixes are shortened until the estimated
    recall of links is ``recall``; pairs within a candidate group are verified exactly, by sets of 64-bit hashes.

    Words are runs without white space, as they are written. A text of fewer words than a shingle is one shingle; texts
    without words are one class, linked to no other. Null text counts as empty, a null doc_id stays null, repeated rows are
    copies, long texts are compared whole, an empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as work:
        signed = materialize(sign(docs, words), "signatures")
        classes = signed.groupBy("digest").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("bytes").alias("bytes"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")
        )
        classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        groups_ = components(neighbours(classes, threshold, trees, recall), "src", "dst").withColumnRenamed("label", "part")
        members = materialize(classes.select("node", "n", "rep", "bytes").join(groups_, "node"), "candidates")
        verified = verify(docs, members, words, threshold, block_classes, block_bytes)

        joined = components(verified.filter("node != root"), "node", "root").withColumnRenamed("label", "group")
        links = verified.groupBy("node").agg(F.sum("links").alias("links"))
        own = classes.select("digest", "node", "n", "rep", "least").join(joined, "node", "left").join(links, "node", "left")
        own = materialize(own.withColumn("group", F.coalesce("group", "node")), "classes")
        # a table of its own, so that the join below can split a hot group, which an aggregation beside it could not
        group = materialize(own.groupBy("group").agg(F.min("least").alias("class_id"), F.min("rep").alias("keeper")), "groups")
        resolved = own.join(group, "group").select("digest", "class_id", "keeper", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        work.keep(signed, own, group)
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    return signed.select("doc_id", "text_hash", "digest").join(resolved, "digest").select("doc_id", "text_hash", "digest", "class_id", "n_links", keeps.alias("keeper"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of least doc_id (ties: by a hash of the text; of repeated rows, one).

    The documents that go, and the few keepers whose row is repeated, are found on keys alone; the texts are shuffled only
    if those keys are too many to broadcast. All columns stay as they are, whatever their names.
    """
    own_id, own_hash, d, h = fresh(docs.columns, "own_id", "own_hash", "d", "h")
    linked = link(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.max("keeper").alias("keeper"), F.count("*").alias("n"))
    marked = materialize(linked.filter("NOT keeper OR n > 1"), "marked")
    rows = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64(text_of())})
    on = F.col(own_id).eqNullSafe(F.col(d)) & (F.col(own_hash) == F.col(h))
    kept = rows.join(keyed_side(marked.select(d, h)), on, "left_anti")
    repeated = materialize(marked.filter("keeper").select(d, h), "repeated")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(keyed_side(repeated), on, "left_semi").dropDuplicates([own_id, own_hash]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
