"""The registered queries on the smallest data: against their SQL, or column by column against plain Python."""

import hashlib
import html
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import brute_components, slow_fingerprint

from tidemark.llm import edit_counts, queries, shards
from tidemark.llm.encoding import BYTE_BPE, WORD_BPE, encoder, pack_ids, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


def library(name, texts):
    tok = encoder(tokenizer_path(name)).tokenizer
    return tok, {d: e.ids for d, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False))}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


def test_op1(spark, texts):
    _, ids = library(WORD_BPE, texts)
    start, want = 0, []
    for d, x in ids.items():
        data = pack_ids([*x, 2])
        want.append((d, start, len(x) + 1, zlib.crc32(data)))
        start += len(x) + 1
    assert sorted(map(tuple, rows(spark, "op1_token_codes"))) == want


def test_op2(spark, texts):
    tok, ids = library(WORD_BPE, texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(x), sha(pack_ids(x)), sha(tok.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()]
    assert sorted(tuple(r)[:4] for r in rows(spark, "op2_tree_bpe")) == want


def test_op5(spark, texts):
    out = rows(spark, "op5_minimax_shards")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out) == [(d, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for d, t in texts.items()]
    keys = {r["text"]: r["k"] for r in spark.createDataFrame([(t,) for t in set(texts.values())], "text string").select("text", F.xxhash64("text").alias("k")).collect()}
    sizes, shard_of = {}, {}
    for r in out:
        sizes[keys[texts[r["doc_id"]]]] = sizes.get(keys[texts[r["doc_id"]]], 0) + r["size"]
        shard_of.setdefault(keys[texts[r["doc_id"]]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())  # equal texts are one group
    alone, rest = [], dict(sorted(sizes.items()))
    while max(rest.values()) * (24 - len(alone)) > sum(rest.values()):
        alone.append(max(rest, key=rest.get))
        rest.pop(alone[-1])
    loads = {}
    for k, n in rest.items():
        loads[min(shard_of[k])] = loads.get(min(shard_of[k]), 0) + n
    assert len(loads) <= 24 - len(alone) and max(loads.values()) == shards.smallest_capacity(list(rest.values()), 24 - len(alone))
    in_order = [min(shard_of[k]) for k in rest]
    assert in_order == sorted(in_order)
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op6(spark, texts):
    tok, ids = library(WORD_BPE, texts)
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    asked = {r["doc_id"]: r["a"] or r["b"] for r in given.select("doc_id", edit_counts.sample_edits(1).alias("a"), edit_counts.sample_edits(2).alias("b")).collect()}
    want = {}
    for d, t in texts.items():
        for e in asked[d]:
            t = t[: e["pos"]] + e["insert"] + t[e["pos"] + e["n_delete"] :]
        want[d] = (len(ids[d]), len(tok.encode(t, add_special_tokens=False).ids))
    out = rows(spark, "op6_edit_counts")
    assert {r["doc_id"]: (r["n_tokens"], r["n_tokens_after"]) for r in out} == want and len(out) == len(texts)
    assert sum(r["n_chars_encoded"] for r in out) < sum(map(len, texts.values())) / 2


def pixels(png):
    """Grey samples of a PNG of unfiltered rows."""
    at, body = 8, b""
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        if png[at + 4 : at + 8] == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", png, at + 8)
            assert (width, depth, colour) == (192, 8, 0)
        body += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(body)
    assert all(raw[i * 193] == 0 for i in range(height))
    return b"".join(raw[i * 193 + 1 : (i + 1) * 193] for i in range(height))


def slow_feature(payload):
    n, mean, bits = len(payload), sum(payload) / len(payload), ""
    for i in range(64):
        part = payload[i * n // 64 : (i + 1) * n // 64]
        bits += "1" if sum(part) / len(part) > mean else "0"
    return f"{sum(payload)}-{int(bits, 2):016x}"


def test_op7(spark, texts, tmp_path):
    from tidemark.llm import media

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    media.write_media(docs, str(tmp_path / "m"))
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.read_media(spark, str(tmp_path / "m")).collect()}
    want = []
    for d, t in texts.items():
        data = t.encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert pixels(stored[d]) == payload
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(stored[d]), sha(stored[d]), slow_feature(payload)))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in rows(spark, "op7_archive_media")]
    assert sorted(got) == want


def test_op8(spark):
    want = []
    for page_id, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall():
        inner = re.sub(r"<(/?)(p|h1|br)[^>]*>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())
        want.append((page_id, url, text, len(text)))
    assert sorted(tuple(r[c] for c in ("page_id", "url", "text", "n_chars")) for r in rows(spark, "op8_tag_path_text")) == want


def test_op9(spark, texts):
    fps = [slow_fingerprint(t) for t in texts.values()]
    want = [(d, f"{f:016x}", c) for d, f, c in zip(texts, fps, brute_components(list(texts), fps))]
    assert sorted(tuple(r) for r in rows(spark, "op9_simhash_anchors")) == want


def test_op10(spark, texts):
    _, ids = library(BYTE_BPE, texts)
    out = rows(spark, "op10_hilbert_packing")
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(pieces) == list(texts)
    for d, found in pieces.items():
        whole, at = np.array([*ids[d], 1], "<u4"), 0
        for start, length, crc, total in sorted(found):
            assert (start, total, crc) == (at, len(whole), zlib.crc32(whole[start : start + length].tobytes()))
            at += length
        assert at == len(whole)
    short = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        short += at < 2048
    assert short <= 4  # the last of each partition
