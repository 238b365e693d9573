"""Cross-tokenizer alignment (operator 12).

Every document is encoded by two tokenizers, once, and the ids are written. Byte offsets where tokens of both end cut
the tokens into groups; tokens of a group are linked. How many documents hold a pair of ids linked is counted in dense
vectors: distinct pairs are dealt into parts by a hash, each part gets a minimal perfect hash function, and tasks count
into vectors indexed by it, which are summed as a tree of bounded fan-in. A function gives some index for any key, so
each index keeps its key for comparison. A second pass over the ids aligns the documents again and looks the counts up.

Parts are taken in blocks of bounded size, so what is sent to tasks does not grow: more pairs mean more passes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import BYTE_BPE, batches, byte_alphabet, encoder, latin, pack_ids, tokenizer_path
from .store import documents, materialize, small_batches, text_of

PIECES = "piece_bpe_32k.model"
#: Pairs of a part, about; parts of a block; and vectors that are summed at a time.
PART, BLOCK, FAN_IN = 1 << 17, 32, 32
GAMMA = 2
MARK = "▁"
#: Before a space that follows neither a space nor the mark that stands for one.
CUT = re.compile(f"(?<=[^ {MARK}])(?= )")
#: Characters of units that a worker keeps.
UNITS = 7_000_000


class Pair:
    """The two tokenizers: ids of a text, and each id's bytes."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True  # their strings are plain text
        self.first.no_truncation()
        self.first.no_padding()
        self.ranked = encoder(first).ranked  # gives what the library gives for Latin-1 texts, and knows no special tokens
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        vocab = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        n = self.second.get_piece_size()
        pieces = list(map(self.second.id_to_piece, range(n)))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # no piece goes on over a space, so what stands between spaces can be encoded by itself, and kept
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        # the tokenizer adds no space to an empty text, so a last space is known from the start
        self.lone = {" ": pack_ids([self.second.piece_to_id(MARK)])}
        self.units: dict[str, bytes | None] = dict(self.lone)
        self.held = 0
        # a token with the mark that follows it: within a group, at the end of its first half, at its end
        self.written = [f"{i}{m}" for i in range(max(len(self.bytes_a), n)) for m in ",|;"]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both, as little-endian unsigned 32-bit integers; none where a text is empty or the tokens' bytes are not the text with a space before it."""
        spaced = [" " + t for t in texts]
        out = []
        for s, a, b in zip(spaced, self._first(spaced), self._second(spaced), strict=True):
            fits = len(s) > 1 and b is not None and int(self.len_a[np.frombuffer(a, "<u4")].sum()) == len(s.encode())
            out.append((a, b) if fits else (b"", b""))
        return out

    def _first(self, spaced: list[str]) -> list[bytes]:
        """Byte-level tokens are the text's bytes, so their lengths tell whether it is whole."""
        easy = [self.ranked is not None and latin(s) for s in spaced]
        hard = [s for s, e in zip(spaced, easy, strict=True) if not e]
        others = iter(self.first.encode_batch_fast(hard, add_special_tokens=False) if hard else [])
        return [self.ranked.encode_to_numpy(s, disallowed_special=()).astype("<u4", copy=False).tobytes() if e else pack_ids(next(others).ids) for s, e in zip(spaced, easy, strict=True)]

    def _second(self, spaced: list[str]) -> list[bytes | None]:
        """None where the pieces' bytes are not the text's."""
        cut = [CUT.split(s) if self.apart else [s] for s in spaced]
        new = list({u for us in cut for u in us if u not in self.units})
        for i in range(0, len(new), 10_000):
            # each begins with the space that the tokenizer itself adds
            for u, ids in zip(new[i : i + 10_000], self.second.encode([u[1:] for u in new[i : i + 10_000]], num_threads=1), strict=True):
                whole = b"".join(map(self.bytes_b.__getitem__, ids)) == u.encode()
                self.units[u] = pack_ids(ids) if whole else None
                self.held += len(u) + 8
        out: list[bytes | None] = []
        for us in cut:
            parts = list(map(self.units.__getitem__, us))
            out.append(None if None in parts else b"".join(parts))
        if self.held > UNITS:
            self.units, self.held = dict(self.lone), 0
        return out


@cache
def pair(first: str, second: str) -> Pair:
    """One in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(first, second)


class Aligned:
    """Groups and links of a batch of documents."""

    def __init__(self, a: list[bytes], b: list[bytes], tok: Pair):
        self.tok = tok
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
        self.docs = len(a)
        na, nb = (np.array([len(i) // 4 for i in x], np.int64) for x in (a, b))
        self.n_a, self.n_b = na, nb
        end_a, end_b = np.cumsum(tok.len_a[self.a]), np.cumsum(tok.len_b[self.b])
        # both tokenizers cover the same bytes of each document, so offsets run through the batch
        ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        ends[end_a] = True
        only_b = np.zeros_like(ends)
        only_b[end_b] = True
        ends &= only_b
        last_a, last_b = np.flatnonzero(ends[end_a]), np.flatnonzero(ends[end_b])
        self.stop_a, self.stop_b = last_a + 1, last_b + 1
        self.start_a, self.start_b = (np.concatenate([[0], s[:-1]]) if len(s) else s for s in (self.stop_a, self.stop_b))
        self.size_a, self.size_b = self.stop_a - self.start_a, self.stop_b - self.start_b
        self.doc_of = np.searchsorted(np.cumsum(na), self.start_a, side="right")  # of each group
        self.n_groups = np.bincount(self.doc_of, minlength=self.docs)
        of_groups = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        stops = np.cumsum(self.n_groups)
        self.n_links = of_groups[stops] - of_groups[stops - self.n_groups]

    def per_doc(self, n: np.ndarray) -> np.ndarray:
        """Sums over each document's links, which stand in its order."""
        upto, stops = np.concatenate([[0], np.cumsum(n)]), np.cumsum(self.n_links)
        return upto[stops] - upto[stops - self.n_links]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, pair) of every link of occurrences, by document. A pair is its first id times the number of second ids, plus the second."""
        n = self.size_a * self.size_b
        group = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        x, y = self.a[self.start_a[group] + k // self.size_b[group]], self.b[self.start_b[group] + k % self.size_b[group]]
        return self.doc_of[group], (x * len(self.tok.bytes_b) + y).astype(np.uint64)

    def digests(self) -> list[str]:
        """Hash of each document's groups, written as text; empty without tokens."""
        whole = np.empty(len(self.a) + len(self.b), np.int64)
        # a group's tokens of the first stand before its tokens of the second
        whole[np.arange(len(self.a)) + np.repeat(self.start_b, self.size_a)] = self._marked(self.a, self.stop_a, 1)
        whole[np.arange(len(self.b)) + np.repeat(self.stop_a, self.size_b)] = self._marked(self.b, self.stop_b, 2)
        out, start, codes = [], 0, whole.tolist()
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join(map(self.tok.written.__getitem__, codes[start : start + n]))[:-1].encode()).hexdigest() if n else "")
            start += n
        return out

    @staticmethod
    def _marked(ids: np.ndarray, stops: np.ndarray, mark: int) -> np.ndarray:
        marked = ids * 3
        marked[stops - 1] += mark
        return marked


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = (keys + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Perfect:
    """Minimal perfect hash function of distinct keys, with the keys for comparison.

    Of each level's table the places that one key alone hashes to are kept as bits; the other keys go on to the next
    level. A key's index is the number of bits before its own.
    """

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits)
            self.ranks.append(at + np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)]))
            at += int(ones.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> Perfect:
        levels, rest = [], np.unique(keys)
        while len(rest):
            size = 64 * -(-GAMMA * len(rest) // 64)
            place = (hashed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[place]]
        out = cls(levels, np.zeros(0, np.uint64))
        every = np.unique(keys)
        out.keys = np.empty_like(every)
        out.keys[out._index(every)] = every
        return out

    def _index(self, keys: np.ndarray) -> np.ndarray:
        """Some index for each key; -1 where no level has it."""
        index, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = hashed(keys[open_], seed) % np.uint64(64 * len(bits))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[here], bit[here]
            index[open_[here]] = ranks[w] + np.bitwise_count(bits[w] & (np.uint64(1) << b) - np.uint64(1))
            open_ = open_[~here]
        return index

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; -1 where the key kept there is another."""
        found = self._index(keys)
        if not len(self.keys):
            return found
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels) + self.keys.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Perfect:
        (n,) = np.frombuffer(data, "<i8", 1)
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(data, "<u8", -1, at))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (hashed(keys, 1 << 20) % np.uint64(parts)).astype(np.int64)


def encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(row, doc_id, a, b): ids of both tokenizers as little-endian unsigned 32-bit integers, written."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pair(first, second)
        for whole in it:
            for batch in batches(whole, 500_000):
                ids = tok.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1))], names=["row", "doc_id", "a", "b"])

    return materialize(rows.mapInArrow(run, "row long, doc_id long, a binary, b binary"), "aligned_ids")


def _aligned(batch: pa.RecordBatch, tok: Pair, tokens: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Slices of so many tokens, aligned."""
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    start = held = 0
    for i, x in enumerate(a):
        if i > start and held + len(x) // 4 > tokens:
            yield batch.slice(start, i - start), Aligned(a[start:i], b[start:i], tok)
            start, held = i, 0
        held += len(x) // 4
    if start < len(a):
        yield batch.slice(start), Aligned(a[start:], b[start:], tok)


def _in_documents(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """(pair, how many documents of a batch hold it linked)."""
    doc, keys = x.links()
    span = np.int64(len(x.tok.bytes_a) * len(x.tok.bytes_b))
    once = _distinct(doc * span + keys.astype(np.int64))
    pairs = np.sort(once % span)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else pairs
    return pairs[first].astype(np.uint64), np.diff(np.concatenate([first, [len(pairs)]]))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def functions(ids: DataFrame, first: str, second: str, part: int) -> tuple[DataFrame, int]:
    """(part, n, function): a minimal perfect hash function for each part of the distinct pairs, written; and the number of parts."""

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, found, held = pair(first, second), [], 0
        for batch in it:
            for _, x in _aligned(batch, tok):
                found.append(_distinct(x.links()[1]))
                held += len(found[-1])
                if held > 1 << 21:
                    found = [np.unique(np.concatenate(found))]
                    held = len(found[0])
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64))], names=["key"])
                        found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["key"])

    keys = materialize(ids.select("a", "b").mapInArrow(pairs, "key long").distinct(), "aligned_pairs")
    parts = max(1, -(-keys.count() // part))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(b.column("key").to_numpy().view(np.uint64), parts)), b.column("key")], names=["part", "key"])

    def build(t: pa.Table) -> pa.Table:
        f = Perfect.of(t.column("key").to_numpy().view(np.uint64))
        return pa.table({"part": t.column("part")[:1].combine_chunks(), "n": pa.array([len(f.keys)]), "function": pa.array([f.to_bytes()], pa.binary())})

    dealt = keys.mapInArrow(deal, "part long, key long")
    return materialize(dealt.groupBy("part").applyInArrow(build, "part long, n long, function binary"), "aligned_functions"), parts


def tree_sum(vectors: DataFrame, nodes: int) -> DataFrame:
    """(part, counts) of ``vectors`` (part, node, counts): sums of at most FAN_IN vectors at a time, until one is left."""

    def add(t: pa.Table) -> pa.Table:
        total = None
        for c in t.column("counts"):
            v = np.frombuffer(c.as_buffer(), "<i8")
            total = v.copy() if total is None else np.add(total, v, out=total)
        return pa.table({"part": t.column("part")[:1].combine_chunks(), "node": t.column("node")[:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        nodes = -(-nodes // FAN_IN)
        vectors = vectors.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("part", "node").applyInArrow(add, "part long, node long, counts binary")
        if nodes <= 1:
            return vectors.select("part", "counts")


class Block:
    """Functions of some parts, in order of part, each with the place of its first count."""

    def __init__(self, rows: list[tuple[int, int, bytes]], parts: int):
        self.parts, self.functions, self.starts, at = parts, {}, {}, 0
        for part, n, function in sorted(rows):
            self.functions[part], self.starts[part] = Perfect.from_bytes(function), at
            at += n
        self.size = at

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where the block has none."""
        part, out = part_of(keys, self.parts), np.full(len(keys), -1, np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p, f in self.functions.items():
            own = order[edges[p] : edges[p + 1]]
            i = f.index(keys[own])
            out[own] = np.where(i >= 0, i + self.starts[p], -1)
        return out


def _blocks(spark: SparkSession, table: DataFrame, parts: int, block: int) -> Iterator[tuple[int, Block]]:
    for low in range(0, parts, block):
        yield low, Block([tuple(r) for r in table.where((F.col("part") >= low) & (F.col("part") < low + block)).select("part", "n", "function").collect()], parts)


def counted(ids: DataFrame, table: DataFrame, first: str, second: str, parts: int, block: int) -> DataFrame:
    """(part, n, function, counts): of each pair of a part, how many documents hold it linked; written."""
    spark, sums = ids.sparkSession, []
    tasks = ids.rdd.getNumPartitions()
    for _, b in _blocks(spark, table, parts, block):
        shared = spark.sparkContext.broadcast(b)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tok, b = pair(first, second), shared.value
            total, node = np.zeros(b.size, "<i8"), TaskContext.get().partitionId()
            for batch in it:
                for _, x in _aligned(batch, tok):
                    keys, n = _in_documents(x)
                    at = b.index(keys)
                    total[at[at >= 0]] += n[at >= 0]
            for p, f in b.functions.items():
                mine = total[b.starts[p] : b.starts[p] + len(f.keys)]
                if mine.any():
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([node]), pa.array([mine.tobytes()], pa.binary())], names=["part", "node", "counts"])

        sums.append(materialize(tree_sum(ids.select("a", "b").mapInArrow(run, "part long, node long, counts binary"), tasks), "aligned_counts"))
    every = sums[0]
    for s in sums[1:]:
        every = every.unionByName(s)
    return materialize(table.join(every, "part"), "aligned_counts")


def highest(table: DataFrame, first: str, second: str) -> np.ndarray:
    """Of each id of the first tokenizer, the highest count of its pairs: as many numbers as the tokenizer has ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(pair(first, second).bytes_b)
        for b in it:
            for f, c in zip(b.column("function"), b.column("counts"), strict=True):
                ids = (Perfect.from_bytes(f.as_py()).keys // np.uint64(width)).astype(np.int64)
                some, at = np.unique(ids, return_inverse=True)
                most = np.zeros(len(some), np.int64)
                np.maximum.at(most, at, np.frombuffer(c.as_buffer(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(most)], names=["id", "most"])

    best = table.select("function", "counts").mapInArrow(run, "id long, most long").groupBy("id").agg(F.max("most").alias("most")).toArrow()
    out = np.zeros(max(best.column("id").to_pylist(), default=0) + 1, np.int64)
    out[best.column("id").to_numpy()] = best.column("most").to_numpy()
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, *, first: str = BYTE_BPE, second: str = PIECES, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of ``docs``.

    Null and empty texts, and those that a tokenizer changes, have no tokens: zeros and an empty digest. Repeated rows
    are documents of their own and count each; null doc_ids stay null; ties for the highest count are all best. Texts
    are encoded whole; a document's tokens must fit in a task. Other columns are not read. An empty table gives no rows.
    """
    spark, first, second = docs.sparkSession, tokenizer_path(first), tokenizer_path(second)
    ids = encoded(docs, first, second)
    table, parts = functions(ids, first, second, part)
    counts = counted(ids, table, first, second, parts, block)
    best = spark.sparkContext.broadcast(highest(counts, first, second))
    names = [c for c in COLUMNS if c != "doc_id"]
    kinds = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in names)])
    passes = []
    for low, b in _blocks(spark, counts, parts, block):
        totals = np.zeros(b.size, np.int64)
        for r in counts.where((F.col("part") >= low) & (F.col("part") < low + block)).select("part", "counts").collect():
            v = np.frombuffer(r["counts"], "<i8")
            totals[b.starts[r["part"]] : b.starts[r["part"]] + len(v)] = v
        shared = spark.sparkContext.broadcast((b, totals))

        def run(it: Iterator[pa.RecordBatch], shared=shared, leads=low == 0) -> Iterator[pa.RecordBatch]:
            tok, (b, totals), most = pair(first, second), shared.value, best.value
            for batch in it:
                for rows, x in _aligned(batch, tok):
                    some, where = np.unique(x.links()[1], return_inverse=True)
                    at = b.index(some)
                    n = np.where(at >= 0, totals[at] if b.size else 0, 0)
                    is_best = (at >= 0) & (n == most[(some // np.uint64(len(tok.bytes_b))).astype(np.int64)])
                    out = {"n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links}
                    zeros = np.zeros(x.docs, np.int64)
                    made = [pa.array(v if leads else zeros) for v in out.values()]
                    sums = [pa.array(x.per_doc(v[where].astype(np.int64))) for v in (is_best, n)]
                    yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *made, *sums, pa.array(x.digests() if leads else [""] * x.docs, pa.string())], names=["row", "doc_id", *names])

        passes.append(ids.mapInArrow(run, kinds))
    if len(passes) == 1:
        return passes[0].select(*COLUMNS)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("row", "doc_id").agg(*((F.max if c == "groups_sha256" else F.sum)(c).alias(c) for c in names))
    return summed.select(*COLUMNS)


def op12_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(documents(spark, sf_dir))
