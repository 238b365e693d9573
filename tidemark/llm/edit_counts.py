"""Token counts that follow edits (operator 6).

A document is kept as leaves of whole words, each ending in white space, where the tokenizer always cuts.
Over the leaves lies a segment tree of characters and tokens. An edit finds its leaves by the characters, is
made in their text, takes in the next leaf where the white space between them went away, and encodes that
region only; the sums on the paths to the root follow. Everything outside the region keeps its counts.

``build_trees`` encodes every text once; its rows are written and kept. ``apply_edits`` takes kept rows and a batch of
edits, encodes the edited regions alone, and gives rows of the same form, to be kept in turn. Rows without edits pass
by. A text without white space is one leaf, so its edits encode all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import _SPLIT, WORD_BPE, Encoder, encoder, tokenizer_path
from .store import P, documents, materialize, small_batches, text_of

LEAF = 256
#: Characters of one Arrow batch of trees.
BATCH_CHARS = 2_000_000
TREES = ["doc_id", "n_tokens_built", "n_tokens", "n_chars", "n_chars_encoded", "leaves", "leaf_tokens"]
EDITS = "array<struct<seq: long, pos: long, n_delete: long, insert: string>>"


def split_leaves(text: str, size: int = LEAF) -> list[str]:
    """Pieces of ``size`` characters or more, each but the last ending in white space."""
    out, start = [], 0
    while len(text) - start > size:
        m = _SPLIT.search(text, start + size - 1)
        if m is None:
            break
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


class TokenTree:
    """Leaves of one document under a segment tree; ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str, enc: Encoder, tokens: list[int] | None = None, leaves: list[str] | None = None):
        self.enc, self.encoded = enc, 0
        self._build(split_leaves(text) if leaves is None and enc.kind == "word" else leaves or [text], tokens)

    def _count(self, texts: list[str]) -> list[int]:
        self.encoded += sum(map(len, texts))
        return [len(ids) // 4 for ids in self.enc.encode_many(texts)]

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)  # characters, tokens
        self.sums[self.width : self.width + len(leaves), 0] = [len(x) for x in leaves]
        self.sums[self.width : self.width + len(leaves), 1] = self._count(leaves) if tokens is None else tokens
        for level in (self.width >> k for k in range(1, self.width.bit_length())):
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level : 2] + self.sums[2 * level + 1 : 4 * level : 2]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def tokens(self) -> list[int]:
        return self.sums[self.width : self.width + len(self.leaves), 1].tolist()

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos``, and its place there; the last leaf at the end."""
        node = 1
        while node < self.width:
            node *= 2
            if pos >= self.sums[node, 0]:
                pos -= int(self.sums[node, 0])
                node += 1
        leaf = node - self.width
        while leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
            pos = len(self.leaves[leaf])
        return leaf, pos

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node >>= 1

    def edit(self, pos: int, n_delete: int, insert: str) -> None:
        """Replaces ``n_delete`` characters at ``pos``; both are clipped to the text."""
        size = int(self.sums[1, 0])
        pos = min(max(pos, 0), size)
        first, a = self._find(pos)
        last, z = self._find(min(size, pos + max(n_delete, 0)))
        region = self.leaves[first][:a] + insert + self.leaves[last][z:]
        while last + 1 < len(self.leaves) and not (region and _SPLIT.fullmatch(region[-1])):
            last += 1
            region += self.leaves[last]
        if first and not (self.leaves[first - 1] and _SPLIT.fullmatch(self.leaves[first - 1][-1])):
            # an emptied neighbour: the context before it reaches back to the last white space
            while first and not (self.leaves[first - 1] and _SPLIT.fullmatch(self.leaves[first - 1][-1])):
                first -= 1
                region = self.leaves[first] + region
        parts = split_leaves(region) if self.enc.kind == "word" else [region]
        counts = self._count(parts)
        if len(parts) > last - first + 1 and sum(map(len, parts[last - first :])) <= 4 * LEAF:
            # a little more text than there are leaves for: the last one takes it in
            parts[last - first :], counts[last - first :] = ["".join(parts[last - first :])], [sum(counts[last - first :])]
        if len(parts) > last - first + 1:
            kept = self.tokens
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], kept[:first] + counts + kept[last + 1 :])
            return
        for i in range(last - first + 1):
            self._set(first + i, parts[i] if i < len(parts) else "", counts[i] if i < len(parts) else 0)


def gather_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the column ``edits``: the rows (doc_id, seq, pos, n_delete, insert) of each document, by seq.

    Null doc_ids match each other; rows that share a doc_id all get its edits; ties in seq are ordered by the other
    columns; repeated edits each apply; no edits: null. A document's edits of one batch must fit in a task.
    """
    lists = edits.groupBy(F.col("doc_id").alias(f"{P}doc")).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "n_delete", "insert"))).alias("edits"))
    return trees.join(lists, trees["doc_id"].eqNullSafe(lists[f"{P}doc"]), "left").drop(f"{P}doc")


def _mapped(rows: DataFrame, step: Callable[..., tuple[TokenTree, int, int]], tokenizer: str) -> DataFrame:
    """Rows of ``TREES`` from what ``step`` makes of the encoder and a row's other columns: a tree, its first tokens, characters encoded by edits."""
    path = tokenizer_path(tokenizer)
    kinds = [*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=TREES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            out, size = [], 0
            for doc_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree, built, spent = step(enc, *row)
                out.append((doc_id, built, tree.n_tokens, int(tree.sums[1, 0]), spent, tree.leaves, tree.tokens))
                size += out[-1][3]
                if size > BATCH_CHARS:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return rows.mapInArrow(run, "doc_id long, n_tokens_built long, n_tokens long, n_chars long, n_chars_encoded long, leaves array<string>, leaf_tokens array<long>")


def build_trees(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """The tree of every row (``TREES``), all of it encoded.

    Null text: empty. Repeated and null doc_ids, and repeated rows, each get a tree. Empty table: empty result.
    """

    def step(enc: Encoder, text: str) -> tuple[TokenTree, int, int]:
        tree = TokenTree(text, enc)
        return tree, tree.n_tokens, 0

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), step, tokenizer)


def apply_edits(trees: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """``trees`` with the column ``edits``, after these: the same rows, n_chars_encoded grown by what the edits had encoded.

    Edits apply in order, each to the text that the one before left. Null edits: none. Null insert: nothing. Positions
    are clipped. Rows stay rows; those without edits do not pass through Python.
    """

    def step(enc: Encoder, built: int, spent: int, leaves: list[str], tokens: list[int], edits: list[dict]) -> tuple[TokenTree, int, int]:
        tree = TokenTree("", enc, tokens, leaves)
        for e in edits:
            tree.edit(e["pos"] or 0, e["n_delete"] or 0, e["insert"] or "")
        return tree, built, spent + tree.encoded

    rows = trees.select(*TREES, F.coalesce(F.col("edits").cast(EDITS), F.array().cast(EDITS)).alias("edits"))
    edited = _mapped(rows.where("size(edits) > 0").select("doc_id", "n_tokens_built", "n_chars_encoded", "leaves", "leaf_tokens", "edits"), step, tokenizer)
    return edited.unionByName(rows.where("size(edits) = 0").select(*TREES))


def sample_edits(batch: int) -> Column:
    """Two edits in each document of one half, by a hash of its id, at places that its id decides."""
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(2 * batch + k)), F.col("n_chars") + 1)
    edit = lambda seq, n, insert: F.struct(F.lit(seq).cast("long").alias("seq"), at(seq).alias("pos"), F.lit(n).cast("long").alias("n_delete"), F.lit(insert).alias("insert"))
    return F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch % 2, F.array(edit(1, 7, " revised wording, 42 "), edit(2, 1, "x")))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are written and read back; then come two batches of edits, each to one half of the documents."""
    small_batches(spark)
    trees = materialize(build_trees(documents(spark, sf_dir)), "trees")
    for batch in (1, 2):
        trees = apply_edits(trees.withColumn("edits", sample_edits(batch)))
    return trees.select("doc_id", F.col("n_tokens_built").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_chars_encoded")
