"""BPE encoding by tree concatenation, and decoding (operator 2).

A text is cut into leaves of so many characters, wherever that falls. Leaves are encoded on their own and joined
pairwise, as a tree: the tokens beside a join are encoded again in a window that doubles until its first token is the
left side's and its last token the right side's. A BPE encoding is the only token sequence whose neighbours are all
encodings of their own concatenation, so agreement on one token at each end makes the joined sequence exactly the
encoding of the whole. Where the tokenizer always cuts, as at white space, the sides agree at once, so a window never
reaches beyond the pre-token that the join splits.

A text is a subtree of one task up to ``SUBTREE`` characters; longer ones are several subtrees, dealt to any tasks
(a word too long for one subtree is cut in its midst), and their results are joined in the same way.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import _ALPHABET, WORD_BPE, Encoder, batches, encoder, pack_ids, tokenizer_path, with_ids
from .store import documents, small_batches, text_of

#: Characters of a leaf, and of the subtree that one task encodes.
LEAF, SUBTREE = 512, 1 << 18


class WordBpe:
    """The BPE model of a tokenizer file, for whole words and for their parts."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.whole = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix or None)
        # within a word no symbol carries the suffix, so neither do merges
        inner = [m for m in merges if not (self.suffix and m[1].endswith(self.suffix))]
        self.part = BPE(vocab=model["vocab"], merges=inner)
        self.token = {i: t for t, i in model["vocab"].items()}
        #: Ids that end a pre-token: with the suffix, or special.
        self.closing = {i for t, i in model["vocab"].items() if self.suffix and t.endswith(self.suffix)} | {a["id"] for a in spec.get("added_tokens", [])}

    def encode(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole if last else self.part).tokenize(symbols)]

    def symbols(self, ids: list[int], last: bool) -> str:
        body = "".join(map(self.token.__getitem__, ids))
        return body.removesuffix(self.suffix) if last and self.suffix else body

    def join(self, left: bytes, right: bytes) -> bytes:
        """Ids of both sides' text from the ids of each; a pre-token is split between them."""
        window = 4
        while True:
            a, b = memoryview(left[-4 * window :]).cast("I").tolist(), memoryview(right[: 4 * window]).cast("I").tolist()
            begins, ends = len(left) <= 4 * window, len(right) <= 4 * window
            for i in range(len(a) - 1, -1, -1):
                if a[i] in self.closing:
                    a, begins = a[i + 1 :], True
                    break
            last = False
            for i, t in enumerate(b):
                if t in self.closing:
                    b, ends, last = b[: i + 1], True, True
                    break
            new = self.encode(self.symbols(a, False) + self.symbols(b, last), last)
            if (begins or new[0] == a[0]) and (ends or new[-1] == b[-1]):
                return left[: len(left) - 4 * len(a)] + pack_ids(new) + right[4 * len(b) :]
            window *= 2

    def join_all(self, parts: list[tuple[bytes, bool]]) -> tuple[bytes, int]:
        """(ids, joins) of parts (ids, whether the last pre-token goes on): neighbours first, then neighbours of these."""
        joins = len(parts) - 1
        while len(parts) > 1:
            pairs = [(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = [(self.join(x, y) if goes_on else x + y, more) for (x, goes_on), (y, more) in pairs] + parts[2 * len(pairs) :]
        return parts[0][0] if parts else b"", max(joins, 0)

    def symbols_tree(self, symbols: str, last: bool, size: int) -> tuple[bytes, int]:
        """Ids of (a part of) one pre-token, and joins."""
        cuts = range(0, len(symbols), size)
        return self.join_all([(pack_ids(self.encode(symbols[i : i + size], last and i + size >= len(symbols))), i + size < len(symbols)) for i in cuts])

    def tree(self, text: str, enc: Encoder, size: int) -> tuple[bytes, int]:
        """Ids of a text, and joins."""
        words = enc.words(text)
        ends = list(accumulate(map(len, words)))
        ids, parts, begun, at = enc._ids.__getitem__, [], b"", 0
        for cut in range(size, ends[-1] if ends else 0, size):
            i = bisect_left(ends, cut)
            if i < at:  # the same word again: it was cut already
                continue
            whole = begun + b"".join(map(ids, words[at:i]))
            if ends[i] == cut:
                parts.append((whole + ids(words[i]), False))
                begun = b""
            else:
                inside, begun = self._split(words[i], cut - ends[i] + len(words[i]), enc, size)
                inside[0] = (whole + inside[0][0], inside[0][1])
                parts += inside
            at = i + 1
        parts.append((begun + b"".join(map(ids, words[at:])), False))
        return self.join_all(parts)

    def _split(self, word: str, at: int, enc: Encoder, size: int) -> tuple[list[tuple[bytes, bool]], bytes]:
        """Leaves that end within a word, the first after ``at`` characters, and the ids of the rest of the word."""
        leaves, held, room = [], [], at
        for symbols in pieces_of(word, enc):
            if isinstance(symbols, int):
                held.append(pack_ids([symbols]))
                continue
            begin = 0
            while len(symbols) - begin > room > 0:
                held.append(pack_ids(self.encode(symbols[begin : begin + room], False)))
                leaves.append((b"".join(held), True))
                held, begin, room = [], begin + room, size
            held.append(pack_ids(self.encode(symbols[begin:], True)))
            room -= len(symbols) - begin
            if room <= 0:
                leaves.append((b"".join(held), False))
                held, room = [], size
        if not leaves:
            return [(b"".join(held), False)], b""
        return leaves, b"".join(held)


def pieces_of(word: str, enc: Encoder) -> Iterator[str | int]:
    """Pre-tokens of a word in the byte alphabet; special tokens as ids."""
    plain = enc.pre_tokens(word)
    if plain is not None:
        yield from (p if p.isascii() else p.encode().decode("latin-1").translate(_ALPHABET) for p in plain)
        return
    at = 0
    for mark in [*(enc._marks.finditer(word) if enc._marks else ()), None]:
        part = word[at : mark.start() if mark else len(word)]
        if part:
            yield from (piece for piece, _ in enc.tokenizer.pre_tokenizer.pre_tokenize_str(enc.tokenizer.normalizer.normalize_str(part)))
        if mark:
            yield enc.tokenizer.token_to_id(mark[0])
            at = mark.end()


@cache
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def subtrees(text: str, enc: Encoder, size: int) -> Iterator[tuple[int, int, bool, bool, str]]:
    """(run, piece, last, model, payload): runs concatenate; pieces of a run are joined."""
    run, held, chars = 0, [], 0
    for word in enc.words(text):
        if len(word) <= size:
            held.append(word)
            chars += len(word) + 1
        if held and (chars >= size or len(word) > size):
            yield run, 0, True, False, " ".join(held)
            run, held, chars = run + 1, [], 0
        if len(word) > size:
            for symbols in pieces_of(word, enc):
                if isinstance(symbols, int):
                    yield run, 0, True, False, enc.tokenizer.id_to_token(symbols)
                else:
                    for i in range(0, len(symbols), size):
                        yield run, i // size, i + size >= len(symbols), True, symbols[i : i + size]
                run += 1
    if held:
        yield run, 0, True, False, " ".join(held)


def encode_documents(docs: DataFrame, tokenizer: str = WORD_BPE, leaf: int = LEAF, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, ids, n_joins): ids as little-endian unsigned 32-bit integers, equal to the library's.

    Null text: empty. Repeated doc_ids and rows: each gets its row. Texts of any length; empty table: empty result.
    Only a tokenizer that drops white space is cut into leaves; with others every text is encoded whole, without joins.
    """
    path = tokenizer_path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if encoder(path).kind != "word":
        return with_ids(rows, path).withColumn("n_joins", F.lit(0).cast("long"))
    long = F.length("text") > subtree
    numbered = rows.where(long).withColumn("row", F.monotonically_increasing_id())
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("run", pa.int64()), ("piece", pa.int64()), ("last", pa.bool_()), ("model", pa.bool_()), ("payload", pa.string())])

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, model = encoder(path), _model(path)
        for b in (part for all_rows in it for part in batches(all_rows)):
            found = [model.tree(t, enc, leaf) for t in b.column("text").to_pylist()]
            enc.trim()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "ids", "n_joins"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, text, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "row")), strict=True):
                out = [(d, row, *x) for x in subtrees(text, encoder(path), subtree)] or [(d, row, 0, 0, True, False, "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, model = encoder(path), _model(path)
        for b in it:
            payload, symbols, last = (b.column(c).to_pylist() for c in ("payload", "model", "last"))
            found = [model.symbols_tree(p, end, leaf) if s else model.tree(p, enc, leaf) for p, s, end in zip(payload, symbols, last, strict=True)]
            enc.trim()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "run", "piece", "last")), pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "row", "run", "piece", "last", "ids", "n_joins"])

    def assemble(t: pa.Table) -> pa.Table:
        parts = sorted(zip(*(t.column(c).to_pylist() for c in ("run", "piece", "last", "ids")), strict=True))
        ids, joins = _model(path).join_all([(ids, not last) for _, _, last, ids in parts])
        return pa.table({"doc_id": t.column("doc_id").slice(0, 1).cast(pa.int64()), "ids": pa.array([ids], pa.binary()), "n_joins": pa.array([joins + sum(t.column("n_joins").to_pylist())], pa.int64())})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.mapInArrow(cut, "doc_id long, row long, run long, piece long, last boolean, model boolean, payload string").repartition(n, "row", "run", "piece")
    coded = dealt.mapInArrow(encode, "doc_id long, row long, run long, piece long, last boolean, ids binary, n_joins long")
    result = "doc_id long, ids binary, n_joins long"
    return rows.where(~long).mapInArrow(whole, result).unionByName(coded.groupBy("row").applyInArrow(assemble, result))


@cache
def _names(path: str) -> list[str] | None:
    """Tokens by id, of a tokenizer file without a decoder; None with one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        return None
    token = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
    return [token.get(i, "") for i in range(max(token) + 1)]


def decode_ids(tokens: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Adds ``text`` to the rows with ``ids``, as the library's decode with skip_special_tokens=False.

    Null ids: null text. Empty ids: empty text. Repeated rows each stand; an empty table gives an empty result.
    """
    path = tokenizer_path(tokenizer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(path)  # no more is needed where tokens are joined by spaces
        tok = None if names else encoder(path).tokenizer
        for b in it:
            text = []
            for ids in b.column("ids").to_pylist():
                numbers = None if ids is None else memoryview(ids).cast("I").tolist()
                text.append(None if ids is None else " ".join(map(names.__getitem__, numbers)) if names else tok.decode(numbers, skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "text"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())]))


def op2_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    decoded = decode_ids(encode_documents(documents(spark, sf_dir)))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"), "n_joins")
