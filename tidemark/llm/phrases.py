"""Phrase collocation mining by a sample and its negative border (operator 11).

A sample of the documents is mined level by level with a lowered threshold. What it finds are proposals; their negative
border are the phrases that are not proposed though both their parts, without the last and without the first word, are
(of single words: all others). One pass over all documents counts proposals and border, by hash: an entry is a few bytes
in a block of its bucket, and buckets are summed as arrays. A phrase that is frequent has frequent parts only, so
nothing is missed unless a phrase of the border turns out frequent. An expansion pass counts every longer phrase that
such a one can be part of: those whose parts are known, failures of the border, or themselves counted in this pass.
That closes the border. The same pass counts all that may be frequent by their words, so equal hashes change nothing.
Counts are of whole texts and exact whatever the sample holds: it decides only what is counted in which pass.

Tasks learn which phrases are known from bits set by their hashes, a table of bounded size. Phrases that share another's
bits are counted too, which costs work and changes nothing. Counting within a chunk of words is by hash, verified word by
word; between tasks it is by the phrase itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import documents, materialize, small_batches, text_of

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: One document in so many is in the sample; its threshold lies a standard deviation below the expected count.
SAMPLE = 8
#: Bits of the table of known phrases at most, and bits for each phrase below that.
MAX_BITS, BITS_EACH = 1 << 27, 16
#: Bytes of text whose entries one bucket takes: its arrays stay small whatever there is to count.
BUCKET = 8 << 20
#: Words that are counted at once, and distinct words that a task keeps.
CHUNK, VOCABULARY = 1 << 20, 400_000
COUNTED = "lang string, phrase string, m int, n long"
#: Capitals become small, ends of pieces a line feed, tabs a space.
FOLD = bytes(10 if c in b".,;:!?\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase whose hash is ``a`` with the word of hash ``b`` after it."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


#: Bits of a hash that an entry keeps beside its bucket.
KEPT = np.uint64(40)
LOW = (np.uint64(1) << KEPT) - np.uint64(1)


def code_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of hashes: bucket and kept bits."""
    return (hashes >> KEPT) % np.uint64(buckets) << KEPT | hashes & LOW


class Known:
    """Bits at two places of each hash, or of what ``buckets`` leave of it."""

    def __init__(self, bits: np.ndarray, buckets: int = 0):
        self.bits, self.size, self.buckets = bits, len(bits) * 8, buckets

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return hashes & np.uint64(size - 1), hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(code_of(hashes, self.buckets) if self.buckets else hashes, self.size):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _table(hashes: DataFrame, buckets: int = 0) -> Broadcast:
    """The bits of ``hashes`` (h); at most MAX_BITS of them are sent to the driver and to the tasks."""
    size = min(MAX_BITS, max(1 << 10, 1 << (BITS_EACH * hashes.count()).bit_length()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            places = np.unique(np.concatenate(Known.places(b.column("h").to_numpy().view(np.uint64), size)))
            slots, first = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else places
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    slots = hashes.select("h").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, "<i8")
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast((table.view(np.uint8), buckets))


def known(phrases: DataFrame) -> Broadcast:
    """The bits of ``phrases`` (lang, phrase)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = [p.encode().split(b" ") for p in b.column("phrase").to_pylist()]
            hashes = np.array([word_hash(lang.encode()) for lang in b.column("lang").to_pylist()], np.uint64)
            for j in range(LONGEST):
                at = np.array([i for i, w in enumerate(words) if len(w) > j], np.int64)
                hashes[at] = mix(hashes[at], np.array([word_hash(words[i][j]) for i in at], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    return _table(phrases.select("lang", "phrase").mapInArrow(run, "h long"))


class _Ids(dict):
    """Numbers of a language's words, from 1; the end of a piece is 0."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0})
        self.words, self.hashes, self.start = [b"\n"], [0], np.uint64(word_hash(lang.encode()))

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        self.hashes.append(word_hash(word))
        return i

    def of(self, text: str, step: int = 1 << 20) -> Iterator[np.ndarray]:
        """Numbers of a text's words, of so many bytes at a time."""
        data, start = text.encode().translate(FOLD), 0
        while start < len(data):
            stop = data.find(b" ", start + step)
            part = data[start : stop if stop >= 0 else len(data)]
            tokens = [w for w in part.replace(b"\n", b" \n ").split(b" ") if w]
            yield np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
            start += len(part)
        yield np.zeros(1, np.int32)


def _groups(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place, how many, hash) of each distinct phrase of ``m`` words at the places ``at``: by hash, verified."""
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    lead = np.repeat(at[first], n)
    if all(np.array_equal(ids[at + j], ids[lead + j]) for j in range(m)):
        return at[first], n, hashes[first]
    _, first, n = np.unique(np.stack([ids[at + j] for j in range(m)], axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], n, hashes[first]


#: A place of each phrase in a chunk, how many of it, whether it is known, and its hash.
Found = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _count(ids: np.ndarray, stop: int, book: _Ids, old: Known | None, new: Known | None, words: bool, expand: bool) -> Iterator[Found]:
    """(m, ...) of the phrases that a pass counts and that start before ``stop``; m = 0 is the number of words.

    Without ``expand``: all words if asked for, and phrases both of whose parts are in ``old``, one of them in ``new``.
    With it: all that is in ``old``, and phrases whose parts are in ``old`` or counted, one of them in ``new`` or counted.
    """
    raw = np.array(book.hashes, np.uint64)
    hash_of = mix(np.full(len(raw), book.start), raw)
    is_old, is_new = (k.has(hash_of) if k else np.zeros(len(raw), bool) for k in (old, new))
    is_old[0] = is_new[0] = False
    if words or expand:
        n = np.bincount(ids[:stop], minlength=len(raw))
        n[0] = 0
        place, some = np.zeros(len(raw), np.int64), np.flatnonzero(n if words else n * is_old)
        place[ids[:stop]] = np.arange(stop)
        yield 0, np.zeros(1, np.int64), n.sum(keepdims=True), np.ones(1, bool), np.zeros(1, np.uint64)
        yield 1, place[some], n[some], is_old[some], hash_of[some]
    # of each place that starts a phrase of m - 1 words that is known, or counted by an expansion: its hash, and whether it is new
    at = np.flatnonzero(is_old[ids])
    hashes, fresh = hash_of[ids[at]], is_new[ids[at]]
    for m in range(2, LONGEST + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        if not len(both):
            return
        at, wanted = at[both], fresh[both] | fresh[both + 1]
        hashes = mix(hashes[both], raw[ids[at + m - 1]])
        inside = old.has(hashes)
        own = (wanted | inside if expand else wanted) & (at < stop)
        if own.any():
            place, n, h = _groups(ids, at[own], hashes[own], m)
            yield m, place, n, inside[np.searchsorted(at, place)], h
        goes_on = inside | wanted if expand else inside
        at, hashes = at[goes_on], hashes[goes_on]
        fresh = new.has(hashes) | wanted[goes_on] if expand else new.has(hashes)


def _chunks(docs: DataFrame, old: Broadcast | None, new: Broadcast | None, words: bool, expand: bool, give: Callable[[str, _Ids, np.ndarray, list[Found]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What ``give`` makes of the phrases that are counted in each chunk of a language's words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [Known(*b.value) if b else None for b in (old, new)]
        books: dict[str, _Ids] = {}
        held: dict[str, list[np.ndarray]] = {}
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ids = np.concatenate(parts)
                for start in range(0, len(ids), CHUNK):  # phrases that start in a chunk may end after it
                    part = ids[start : start + CHUNK + LONGEST - 1]
                    yield from give(lang, books[lang], part, _count(part, min(CHUNK, len(part)), books[lang], *have, words, expand))
            held.clear()
            if sum(len(b.words) for b in books.values()) > VOCABULARY:
                books.clear()

        for b in it:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lang not in books:
                    books[lang] = _Ids(lang)
                for ids in books[lang].of(text):
                    held.setdefault(lang, []).append(ids)
                    n_held += len(ids)
                if n_held >= CHUNK:
                    yield from flush()
                    n_held = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, kind)


def count(docs: DataFrame, threshold: int, old: Broadcast | None = None, new: Broadcast | None = None, *, words: bool = False, expand: bool = False) -> DataFrame:
    """(lang, phrase, m, n) of ``docs`` (lang, text, no nulls): exact counts from ``threshold`` on, and with m = 0 all words of a language.

    Tasks give each phrase of a chunk once, so phrases are dealt as they are, hot or not.
    """

    def give(lang: str, book: _Ids, part: np.ndarray, found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
        names = pa.array(book.words, pa.binary()).cast(pa.string())
        for m, place, n, _, _ in found:
            for i in range(0, len(place), 200_000):
                at = place[i : i + 200_000]
                each = [names.take(pa.array(part[at + j])) for j in range(m)]
                joined = pc.binary_join_element_wise(*each, " ") if m else pa.repeat("", len(at))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), joined, pa.repeat(pa.scalar(m, pa.int32()), len(at)), pa.array(n[i : i + len(at)].astype(np.int64))], names=["lang", "phrase", "m", "n"])

    found = _chunks(docs, old, new, words, expand, give, COUNTED).repartition("lang", "phrase")
    return found.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n")).where((F.col("n") >= threshold) | (F.col("m") == 0))


def count_hashes(docs: DataFrame, threshold: int, old: Broadcast, buckets: int) -> DataFrame:
    """(h, inside): what ``buckets`` leave of the hashes of proposals and border that come ``threshold`` times or more.

    ``old`` are the proposals; ``inside`` tells them. A chunk's entries of a bucket are one row: kept bits and counts, by
    their bytes, so that equal high bytes stand together.
    """

    def give(lang: str, book: _Ids, part: np.ndarray, found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
        parts = [(n, i, h) for m, _, n, i, h in found if m]
        n, inside, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        code = code_of(h, buckets)
        order = np.lexsort((code, inside))
        n, inside, code = n[order].astype("<u4"), inside[order], code[order]
        group = code >> KEPT << np.uint64(1) | inside
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        stop = np.concatenate([first[1:], [len(group)]]) if len(first) else first
        low = code & LOW
        rows = [(int(group[a] >> np.uint64(1)), bool(inside[a]), np.concatenate([low[a:z].view("u1").reshape(-1, 8)[:, :5].T.ravel(), n[a:z].view("u1").reshape(-1, 4).T.ravel()]).tobytes()) for a, z in zip(first.tolist(), stop.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "inside", "entries"])

    def add(t: pa.Table) -> pa.Table:
        lows, counts = [], []
        for x in t.column("entries"):
            planes = np.frombuffer(x.as_buffer(), "u1").reshape(9, -1)
            lows.append(sum(planes[i].astype(np.uint64) << np.uint64(8 * i) for i in range(5)))
            counts.append(np.ascontiguousarray(planes[5:].T).view("<u4").ravel())
        low, n = np.concatenate(lows), np.concatenate(counts).astype(np.int64)
        order = np.argsort(low)
        low, n = low[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        often = low[first][np.add.reduceat(n, first) >= threshold]
        code = np.uint64(t.column("bucket")[0].as_py()) << KEPT | often
        return pa.table({"h": pa.array(code.view(np.int64)), "inside": pa.repeat(t.column("inside")[0], len(code))})

    blocks = _chunks(docs, old, old, True, False, give, "bucket long, inside boolean, entries binary")
    return blocks.groupBy("bucket", "inside").applyInArrow(add, "h long, inside boolean")


def frequent(docs: DataFrame, *, least: int = MIN_COUNT, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, m, n): every phrase of one to five words that occurs ``least`` times or more in its language; with m = 0 all its words.

    Null texts: none. Null languages: `und`. Repeated rows each count. A text without words and an empty table give no
    phrases. Long texts are counted in chunks, phrases across their borders included.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"), "doc_id")
    some = materialize(texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).select("lang", "text"), "phrase_sample")
    mean = least / sample
    low = max(2, ceil(mean - sqrt(mean)))
    proposed = level = materialize(count(some, low, words=True).where("m > 0"), "phrase_proposals")
    for _ in range(2, LONGEST + 1):
        if level.isEmpty():
            break
        level = materialize(count(some, low, known(proposed), known(level)), "phrase_proposals")
        proposed = proposed.unionByName(level)
    buckets = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    often = materialize(count_hashes(texts, least, known(proposed), buckets), "phrase_hashes")
    return materialize(count(texts, least, _table(often, buckets), _table(often.where("NOT inside"), buckets), expand=True), "phrases")


def collocations(counts: DataFrame, *, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of ``counts`` from frequent().

    The score of a phrase is the lowest over its cuts of 1000 a n / (l r), rounded down. A phrase goes if a phrase with
    one word more holds it and is as frequent; then so does any longer one that is. Ties: a descending, then the
    phrase's bytes. Exact decimals; no phrases: no rows.
    """
    words = counts.where("m = 0").select("lang", F.col("n").alias("all"))
    phrases = counts.where("m > 0").select("lang", "phrase", "m", "n")
    sides = F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))
    longer = phrases.where("m > 2").select("lang", F.explode(sides).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.where("m > 1").join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n")
    cuts = materialize(kept.select("lang", "phrase", "m", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")), "phrase_cuts")
    placed = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - m)")})
    joined = placed.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(words, "lang")
    score = F.expr("(1000BD * CAST(a AS decimal(20, 0)) * CAST(`all` AS decimal(20, 0))) div (CAST(l AS decimal(20, 0)) * CAST(r AS decimal(20, 0)))")
    best = joined.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", F.col("all").alias("n"))).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within a part of each language, then among the parts' firsts
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    near = best.withColumn("place", F.row_number().over(part)).where(f"place <= {top}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations(frequent(documents(spark, sf_dir)))


#: Every phrase is counted, whatever its parts.
ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS x(m)),
f AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT c.lang, c.phrase, max(b.a) AS a FROM f c JOIN f b ON b.lang = c.lang AND b.m > c.m AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') WHERE c.m > 1 GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN longer ON longer.lang = f.lang AND longer.phrase = f.phrase WHERE f.m > 1 AND (longer.a IS NULL OR 100 * longer.a < 100 * f.a)),
cut AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
