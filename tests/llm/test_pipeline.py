import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_documents import brute_components, repeated, slow_fingerprint
from test_line_dedup import brute

from tidemark.llm import quality
from tidemark.llm.encoding import BYTE_BPE, encoder, tokenizer_path


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120").write.parquet(f"{root}/documents.parquet")
    return root


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    (_, good), (_, lines), (_, one), (_, pack) = corpus_pipeline.STAGES
    kept = good(spark, docs, small)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert set(rows) == {d for d, k in judged.items() if k}
    for t in rows.values():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert len(w) >= 20 and 100 * repeated(w) <= 30 * len(w)
    deduped = lines(spark, kept, small)
    assert deduped.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in deduped.collect()), key=str)
    assert got == brute(list(rows.items())) and deduped.where(F.col("n_chars") != F.length("text")).count() == 0
    ids, fps = [d for d, _ in got], [slow_fingerprint(t) for _, t in got]
    want = {d for d, c in zip(ids, brute_components(ids, fps)) if d == c}
    unique = one(spark, deduped, small)
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == want
    tokens = {d: len(encoder(tokenizer_path(BYTE_BPE)).tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in got if d in want}
    packed = {}
    for r in pack(spark, unique, small).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == tokens
    assert {r["doc_id"]: r["t"] for r in corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("t")).collect()} == tokens


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, repeated rows, ties, very long and empty texts, and extra columns with awkward names."""
    line = lambda n, k: " ".join(f"w{(n * 100 + i) * 7919 % 1000003}" for i in range(k))
    text = {n: "\n".join(line(7 * n + j, 12) for j in range(4)) for n in range(5)}
    long = "\n".join(line(1000 + j, 30) for j in range(600))
    odd = [(None, text[0]), (1, text[1]), (1, text[1]), (2, text[1] + " "), (3, None), (4, ""), (5, text[2] + "\n" + line(0, 12)), (6, long), (7, "\n".join([line(90, 12)] * 4)), (8, text[3]), (None, text[4])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `x.y` int, h int, fp string, words array<string>, `back``tick` double"
    rows = [(d, t, "en" if i % 2 else None, None, len(t or ""), i, i, "k", ["w"], 0.5) for i, (d, t) in enumerate(odd)]
    docs, (_, good), (_, lines), (_, one), (_, pack) = spark.createDataFrame(rows, schema), *corpus_pipeline.STAGES
    kept = good(spark, docs, "")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert kept.columns == docs.columns and ids(kept) == sorted([None, None, 1, 1, 2, 5, 6, 8], key=str)
    deduped = lines(spark, kept, "")
    assert deduped.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in deduped.collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert deduped.where(F.col("n_chars") != F.length("text")).count() == 0
    unique = one(spark, deduped, "")
    fps = [slow_fingerprint(t) for _, t in got]
    groups = brute_components([d for d, _ in got], fps)
    assert unique.columns == docs.columns and len(ids(unique)) == len({g if g is not None else ("none", f) for g, f in zip(groups, fps)})
    tok = encoder(tokenizer_path(BYTE_BPE)).tokenizer
    total = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in unique.collect())
    assert pack(spark, unique, "").agg(F.sum("length")).first()[0] == total
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == total
    # the stages after the first take what it would have dropped
    assert len(ids(lines(spark, docs, ""))) == len(odd)
    assert sorted(map(str, ids(one(spark, docs, "")))) == sorted(map(str, [None, None, 1, 3, 5, 6, 7, 8]))
    assert pack(spark, docs, "").select("doc_id").distinct().count() == len({d for d, _ in odd})


def test_empty(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
