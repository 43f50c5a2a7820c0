import corpus_pipeline
from granary.llm import packing, quality, secrets
from granary.llm.queries import QUERIES, SQL

from tests.llm.helpers import awkward
from tests.llm.test_near import brute
from tests.llm.test_rules import base
from tests.llm.test_tokens import library, wide  # noqa: F401


def clean(text):
    n, chars, symbols, dups, repeats = base(text)
    words = [w.lower() for w in (text or "").split()]
    stops = sum("".join(c for c in w if c not in ".,;:!?\"'()") in quality.STOP_WORDS for w in words)
    lines = len([x for x in (text or "").split("\n") if x.strip()])
    return not (n < 50 or 100 * repeats > 50 * n) and 2 * n <= chars <= 12 * n and 10 * symbols <= n and 20 * stops >= n and 2 * dups <= lines


def test_pipeline_equals_its_stages_by_brute_force(spark, small, library):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if clean(r.text)]
    least = {c for _, c, _ in brute(rows)}
    kept = {i: t for i, t in rows if i in least}
    redacted = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    pieces = corpus_pipeline.run(spark, small).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(kept)
    for i in kept:
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in parts for x in wide(p)] == library(redacted[i])
    assert set(packing.digest(corpus_pipeline.run(spark, small)).columns) >= {"doc_id", "start", "length", "ids_crc32"}


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_pipeline_of_no_documents_and_of_awkward_ones(spark, tmp_path):
    rows = awkward(spark)
    for name, docs, kept in (("none", rows.limit(0), set()), ("awkward", rows, {p.doc_id for p in rows.collect() if clean(p.text)})):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert {p.doc_id for p in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()} == kept


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)
