"""The registered queries against brute force on the smallest tables, where SQL cannot express them."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from granary.llm.bpe import read_ranks
from granary.llm.fingerprints import edited, likeness, packed, signatures
from granary.llm.queries import QUERIES, SQL

from tests.llm.test_near import brute
from tests.llm.test_rules import spans
from tests.llm.test_tokens import library, sequences  # noqa: F401


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    found = con.execute(SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_packing(spark, small, texts, library):  # noqa: F811
    ids = {k: library(t) for k, t in texts.items()}
    rows = QUERIES["op2_packing"](spark, small).collect()
    used = sequences(rows)
    assert max(used) <= 2048 and len(used) <= 1.02 * sum(used) / 2048 + 1
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])


def test_token_files(spark, small, texts, library):  # noqa: F811
    expected, start = {}, 0
    for k, t in texts.items():
        ids = library(t)
        expected[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, small).collect()} == expected


def test_byte_bpe(spark, small, texts):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op5_byte_bpe"](spark, small).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_secret_scans(spark, small, texts):
    kinds = ("assign", "access", "hex")
    rows = QUERIES["op6_secret_scans"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        own = spans(texts[r.doc_id])
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in own]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in own) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_ngram_join(spark, small, texts):
    got = QUERIES["op7_ngram_join"](spark, small).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(list(texts.items()))


def test_sharding(spark, small, texts):
    rows = sorted(QUERIES["op8_sharding"](spark, small).collect(), key=lambda r: r.doc_id)
    total = [0] * 8
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r["size"]
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert max(total) - min(total) <= 2 * max(r["size"] for r in rows)
    for s in range(8):
        own = [r.slot for r in rows if r.shard == s]
        assert own == list(range(len(own)))


def test_fingerprints(spark, small, texts):
    keys = list(texts)
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, small).collect()}
    assert list(sorted(got)) == keys
    for k, following in zip(keys, keys[1:] + keys[:1]):
        changed = edited(texts[k], texts[following])
        s = signatures([texts[k].encode(), changed.encode(), texts[following].encode()])
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == packed(s[:2])
        assert r.near_edited == pytest.approx(likeness(s[:1], s[1:2])[0]) and r.near_next == pytest.approx(likeness(s[:1], s[2:])[0])
