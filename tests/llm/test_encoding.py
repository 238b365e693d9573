import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import edit_counts, packing, token_codes, tree_bpe
from tidemark.llm.encoding import _ALPHABET, BYTE_BPE, WORD_BPE, Encoder, encoder, pack_ids, tokenizer_path

ALPHABET = [*"ab cdé'sst\n\n  \t!?<|>12 Σςſİ̈\x1c\x1f\x85\xa0　你好日ÀßK", "<|endoftext|>", "<|startoftext|>", " the", "\r\n", "'ll", "'RE"]
EDGES = [None, "", " ", "\n", "a", "twin", "twin", "x" * 40_000, "Ab1!" * 12_000, "word " * 9_000, "a<|endoftext|>b " + "é" * 20_000, "ab" * 17_000 + "<|endoftext|>" + "q" * 9000]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(n)]


def library(path, texts_):
    return [e.ids for e in Encoder(tokenizer_path(path)).tokenizer.encode_batch([t or "" for t in texts_], add_special_tokens=False)]


def frame(spark, values):
    return spark.createDataFrame([(None if i == 3 else i, t, 7, "k") for i, t in enumerate(values)], "doc_id long, text string, n_tokens int, ids string")


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_the_library(path):
    some = texts(4000, 1)
    enc = Encoder(tokenizer_path(path), limit=500, pieces=100)  # small caches start anew often
    got = [x for i in range(0, len(some), 90) for x in enc.encode_many(some[i : i + 90])]
    assert got == [pack_ids(x) for x in library(path, some)]


def test_tree_join_is_exact():
    model, rnd = tree_bpe.WordBpe(tokenizer_path(WORD_BPE)), random.Random(3)
    for _ in range(150):
        word = "".join(rnd.choices(rnd.choice(["ab", "thein", "a", "etaoinshrdlu", "!?.", "0éß"]), k=rnd.randint(1, 500)))
        word, size = "".join(_ALPHABET[c] for c in word.encode()), rnd.choice([1, 3, 7, 50])
        assert model.symbols_tree(word, True, size) == (pack_ids(model.encode(word, True)), -(-len(word) // size) - 1)


def test_leaves_of_any_size_join_to_the_whole():
    path, rnd = tokenizer_path(WORD_BPE), random.Random(9)
    model, enc = tree_bpe.WordBpe(path), encoder(path)
    words = ["the", "don't", "Wörter,", "x" * 40, "a<|endoftext|>b", "12,5", "'s", "...", "İΣς", "naïve", "<|endoftext|>", "hello.World!"]
    values = texts(300, 11) + [" ".join(rnd.choices(words, k=60)) for _ in range(60)] + ["".join(rnd.choices(words, k=30)) for _ in range(60)]
    for text, want in zip(values, library(WORD_BPE, values)):
        for size in (1, 2, 5, 16, 1000):
            assert model.tree(text, enc, size)[0] == pack_ids(want), (text, size)


def test_given_documents_are_joined(spark):
    """Every document longer than a leaf comes out of joins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in tree_bpe.encode_documents(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, want in zip(rows, library(WORD_BPE, [r["text"] for r in rows])):
        chars = len("".join((r["text"] or "").split()))
        assert bytes(got[r["doc_id"]]["ids"]) == pack_ids(want)
        assert (got[r["doc_id"]]["n_joins"] > 0) == (chars > tree_bpe.LEAF)


@pytest.mark.parametrize("leaf, subtree", [(500, 3000), (60, 700), (512, 1 << 18)])
def test_tree_encoding_and_decoding(spark, leaf, subtree):
    values = EDGES + texts(60, 2)
    df = frame(spark, values)
    out = tree_bpe.decode_ids(tree_bpe.encode_documents(df, leaf=leaf, subtree=subtree)).collect()
    want = library(WORD_BPE, values)
    tok = encoder(tokenizer_path(WORD_BPE)).tokenizer
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["text"]) for r in out) == sorted((str(None if i == 3 else i), pack_ids(w), tok.decode(w, skip_special_tokens=False)) for i, w in enumerate(want))
    assert tree_bpe.decode_ids(tree_bpe.encode_documents(df.limit(0))).count() == 0


def test_codes_round_trip_and_direct_access():
    rnd = np.random.default_rng(1)
    for ids in ([], [0], [255], [256], rnd.integers(0, 1 << 24, 5000), rnd.integers(0, 300, 1025)):
        ids = np.asarray(ids, np.int64)
        back = token_codes.Codes.from_bytes(token_codes.Codes.of(ids).to_bytes())
        assert (back.decode() == ids).all() and len(back.decode()) == len(ids)
        assert [back.access(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()


def test_token_files(spark, tmp_path):
    values = EDGES + texts(40, 4)
    df = frame(spark, values)
    token_codes.write_codes(df, str(tmp_path / "c"), segment_tokens=300)
    got = token_codes.read_documents(spark, str(tmp_path / "c")).collect()
    want = {i: pack_ids([*w, 2]) for i, w in enumerate(library(WORD_BPE, values))}
    order = [3, *(i for i in range(len(values)) if i != 3)]  # without doc_id first
    start = 0
    by_id = {r["doc_id"]: r for r in got}
    for i in order:
        r = by_id[None if i == 3 else i]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(want[i]) // 4, want[i])
        start += len(want[i]) // 4
    ids = struct.unpack(f"<{len(want[8]) // 4}I", want[8])
    asked = spark.createDataFrame([(8, 0), (8, len(ids) - 1), (8, len(ids)), (10, 5), (999, 0)], "doc_id long, position long")
    hits = {(r["doc_id"], r["position"]): r["token"] for r in token_codes.read_tokens(spark, str(tmp_path / "c"), asked).collect()}
    assert hits == {(8, 0): ids[0], (8, len(ids) - 1): 2, (10, 5): struct.unpack("<I", want[10][20:24])[0]}
    token_codes.write_codes(df.limit(0), str(tmp_path / "empty"))
    assert token_codes.read_documents(spark, str(tmp_path / "empty")).count() == 0


def test_edit_trees():
    enc, rnd = encoder(tokenizer_path(WORD_BPE)), random.Random(5)
    for _ in range(150):
        letters = rnd.choice(["ab  \n", "thein .,", "Aé <|>'s "])
        text = "".join(rnd.choices(letters, k=rnd.choice([0, 5, 300, 3000])))
        tree = edit_counts.TokenTree(text, enc)
        for _ in range(5):
            pos, n, new = rnd.randint(0, len(text) + 3), rnd.choice([0, 1, 7, 400]), "".join(rnd.choices(letters, k=rnd.choice([0, 1, 9, 700])))
            at = min(pos, len(text))
            text = text[:at] + new + text[at + n :]
            tree.edit(pos, n, new)
            assert "".join(tree.leaves) == text
            assert tree.n_tokens == len(enc.tokenizer.encode(text, add_special_tokens=False).ids)


def test_edits_encode_little():
    tree = edit_counts.TokenTree("some words here " * 5000, encoder(tokenizer_path(WORD_BPE)))
    tree.encoded = 0
    tree.edit(40_000, 5, "x")
    assert 0 < tree.encoded < 1000


def edit(text, pos, n, new):
    at = min(max(pos or 0, 0), len(text))
    return text[:at] + (new or "") + text[at + max(n or 0, 0) :]


def test_kept_trees_take_batches_of_edits(spark, tmp_path):
    """Trees are written and read between batches; counts equal the library's, and no more than the regions is encoded."""
    rnd = random.Random(6)
    values = [None, "", "one two three", "twin", "twin", *("".join(rnd.choices("thein .,é\n", k=rnd.choice([5, 400, 4000]))) for _ in range(12)), "word " * 40_000]
    ids = [None if i == 7 else 3 if i == 4 else i for i in range(len(values))]
    df = spark.createDataFrame([(d, t, 1) for d, t in zip(ids, values)], "doc_id long, text string, leaves int")
    texts_ = {d: [t or "" for e, t in zip(ids, values) if e == d] for d in ids}
    trees = edit_counts.build_trees(df)
    for batch in range(3):
        edits = [(d, k, rnd.choice([None, 0, 3, 900, 10**9]), rnd.choice([None, 0, 1, 40]), rnd.choice([None, "", " ", "new words", "x"])) for d in [None, 0, 3, 5, 6, 17] for k in range(rnd.randint(1, 4))]
        trees.write.parquet(f"{tmp_path}/{batch}")
        kept = spark.read.parquet(f"{tmp_path}/{batch}")
        trees = edit_counts.apply_edits(edit_counts.gather_edits(kept, spark.createDataFrame(edits, "doc_id long, seq long, pos long, n_delete long, insert string")))
        for d, _, pos, n, new in edits:
            texts_[d] = [edit(t, pos, n, new) for t in texts_[d]]
    out = trees.collect()
    tok = encoder(tokenizer_path(WORD_BPE)).tokenizer
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert sorted(str((r["doc_id"], "".join(r["leaves"]), r["n_tokens"], r["n_chars"])) for r in out) == sorted(str((d, t, count(t), len(t))) for d, some in texts_.items() for t in some)
    assert sorted(str((r["doc_id"], r["n_tokens_built"])) for r in out) == sorted(str((d, count(t or ""))) for d, t in zip(ids, values))
    by_id = {r["doc_id"]: r["n_chars_encoded"] for r in out}
    assert by_id[2] == 0 and 0 < by_id[17] < 20_000
    assert edit_counts.build_trees(df.limit(0)).count() == 0
    assert edit_counts.apply_edits(trees.limit(0).withColumn("edits", edit_counts.sample_edits(1))).count() == 0


def test_hilbert_neighbours():
    grid = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    order = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_narrow_ids_round_trip():
    for ids in ([], [5], [65_535, 0], [65_536, 1], [1 << 31, 70_000, 3]):
        assert packing.widen(packing.narrow(pack_ids(ids)), len(ids)) == pack_ids(ids)


def test_packing(spark):
    values = EDGES + texts(80, 6)
    df = frame(spark, values)
    out = packing.pack(df, length=64, partitions=3).collect()
    want = {None if i == 3 else i: pack_ids([*w, 1]) for i, w in enumerate(library(BYTE_BPE, values))}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, ids in want.items():
        rows = sorted(pieces[d], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in rows) == ids and [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert all(r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in rows)
    short = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        total = sum(r["length"] for r in rows)
        assert total <= 64
        short += total < 64
    assert short <= 3
    assert packing.pack(df.limit(0)).count() == 0


def test_alike_documents_pack_together(spark):
    rnd = random.Random(1)
    kinds = [["red", "green", "blue"], ["one", "two", "three"], ["cat", "dog", "bird"]]
    df = spark.createDataFrame([(i, " ".join(rnd.choices(kinds[i % 3], k=60))) for i in range(60)], "doc_id long, text string")
    order = [r["doc_id"] % 3 for r in packing.pack(df, partitions=1).orderBy("sequence_id", "offset").collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) < 20  # about 39 in a random order
