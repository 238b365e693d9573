"""Exact, fast tokenizer calls for Spark's Python workers.

The tokenizers library spends most of its time per call, and words repeat. A text is cut where its
word-level pre-tokenizer always cuts (white space), each distinct word is encoded when a worker first meets it, and
the words' ids are concatenated. Words of plain Latin text skip the general pipeline: they are pre-tokenized with
the published pattern and handed to the BPE model directly. Byte-level BPE whose ids are merge ranks runs
Latin-1 texts through tiktoken, whose result is the same. Everything else goes through ``Tokenizer.encode``
itself; tests hold all paths against it.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

# The pre-tokenization patterns stored in the two public tokenizer files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Unicode white space as the library's pattern engine sees it (str.split also cuts at \x1c-\x1f).
WS = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{WS}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_STOPS = frozenset(".,;:!?")
#: No normalization, combining mark or unusual case rule below U+0250.
_PLAIN = re.compile("[!-~\xa1-ɏ]+")


def tokenizer_path(name_or_path: str) -> str:
    """A path, or the name of a file of the installed public vocabularies."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(free)) for b in range(256)}


_ALPHABET = byte_alphabet()
#: No id has a high byte, so this never occurs among packed ids.
_MARK = b"\xff\xff\xff\xff"


def pack_ids(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids of pre-tokens, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.make(piece)
        return ids


class _Words(dict):
    """Ids of words, made when first asked for. Words of letters, and those with one stop at the end, are no more than that in the pattern."""

    def __init__(self, pieces: _Pieces, hard: Callable[[str], bytes]):
        super().__init__()
        self.pieces, self.hard, self.held = pieces, hard, 0

    def __missing__(self, word: str) -> bytes:
        if not word.isascii():
            ids = self.hard(word)
        elif word.isalpha():
            ids = self.pieces[word.lower()]
        elif word[-1] in _STOPS and word[:-1].isalpha():
            ids = self.pieces[word[:-1].lower()] + self.pieces[word[-1]]
        else:
            ids = self.hard(word)
        self[word] = ids
        self.held += len(word) + 8
        return ids


class Encoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``limit``: characters of words to keep, ``pieces``: of pre-tokens; beyond these a cache starts anew,
    so memory is bounded.
    """

    def __init__(self, path: str, limit: int = 7_000_000, pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.limit, self.pieces = path, limit, pieces
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [a["content"] for a in spec.get("added_tokens", [])]
        simple = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not _SPLIT.search(a["content"]) for a in spec.get("added_tokens", []))
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        self.kind = "plain"
        if simple and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not norm:
            self.kind = "byte"
        elif simple and [p["type"] for p in before.get("pretokenizers", [])] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.ranked = self._by_rank(spec["model"]) if self.kind == "byte" else None
        self._cut = regex.compile(WORD_PATTERN).findall
        self._marks = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self._pre = _Pieces(self._piece)
        self._ids = _Words(self._pre, self._word)

    @cached_property
    def tokenizer(self):
        """The library's own; made when it is first needed."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    @cached_property
    def _model(self):
        return self.tokenizer.model

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out = {"word": self._words, "byte": self._bytes, "plain": self._plainly}[self.kind](texts)
        self.trim()
        return out

    def trim(self) -> None:
        """Starts a full cache anew."""
        if self._ids.held > self.limit:
            self._ids.clear()
            self._ids.held = 0
        if len(self._pre) > self.pieces:
            self._pre.clear()

    def _plainly(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pre_tokens(self, word: str) -> list[str] | None:
        """Lower-cased pre-tokens of a word of plain Latin text; None for others, and for words with special tokens."""
        if not _PLAIN.fullmatch(word) or self._marks and self._marks.search(word):
            return None
        low = word.lower()
        return [low] if low.isalpha() else self._cut(low)

    def _word(self, word: str) -> bytes:
        pieces = self.pre_tokens(word)
        return self._plainly([word])[0] if pieces is None else b"".join(map(self._pre.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        tokens = self._model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    @staticmethod
    def words(text: str) -> list[str]:
        return [w for w in _SPLIT.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def _words(self, texts: list[str]) -> list[bytes]:
        ids = self._ids.__getitem__
        return [b"".join(map(ids, self.words(t))) for t in texts]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        """Latin-1 texts by the ranked form of the same vocabulary, others by the library itself."""
        if self.ranked is None:
            return self._plainly(texts)
        easy = [latin(t) and not any(s in t for s in self.specials) for t in texts]
        others = [t for t, e in zip(texts, easy, strict=True) if not e]
        hard = iter(self._plainly(others) if others else [])
        return [self.ranked.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() if e else next(hard) for t, e in zip(texts, easy, strict=True)]

    def _by_rank(self, model: dict):
        """The same vocabulary for tiktoken, if its ids are ranks: bytes first, then merges in order."""
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"].get(t) for t in pairs]
        alone = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        if ids != list(range(256, 256 + len(pairs))) or len(alone) != 256 + len(pairs):
            return None
        import tiktoken

        byte_of = {c: b for b, c in _ALPHABET.items()}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in alone.items()}
        return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, with its cache."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def batches(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``chars`` characters, so that a batch of long texts is not encoded at once."""
    sizes, start, held = pc.binary_length(batch.column("text")).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def with_ids(df: DataFrame, tokenizer: str, *, drop_text: bool = True) -> DataFrame:
    """Adds ``ids`` (binary) for the column ``text``, which holds no nulls; the other columns stay."""
    path = tokenizer_path(tokenizer)
    fields = [f for f in df.schema.fields if not (drop_text and f.name == "text")]
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in it:
            for b in batches(whole):
                ids = enc.encode_many(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType())]))
