"""Operators 11 to 13 against plain Python, on odd rows and on the smallest data."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import alignment, phrases, queries, sketches
from tidemark.llm.encoding import BYTE_BPE, pack_ids, tokenizer_path
from tidemark.llm.store import P, materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


# --- operator 11


def plain_counts(rows, least):
    """{(lang, phrase): n} from ``least`` on, and words by language, of (lang, text)."""
    found, words = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            found.update((lang or "und", " ".join(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    return {k: n for k, n in found.items() if n >= least}, {k: n for k, n in words.items() if n}


def plain_collocations(counts, words, top):
    out = []
    for lang in words:
        own = {p: n for (x, p), n in counts.items() if x == lang}
        rows = []
        for p, a in own.items():
            w = p.split(" ")
            if len(w) < 2 or any(f" {p} " in f" {q} " and q != p and n >= a for q, n in own.items()):
                continue
            cuts = [(1000 * a * words[lang] // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, p.encode(), p, own[" ".join(w[:k])], own[" ".join(w[k:])]))
        out += [(lang, i, p, -a, lo, hi, words[lang], -score) for i, (score, a, _, p, lo, hi) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def odd_rows():
    rnd = np.random.default_rng(11)
    vocabulary = ["the", "The", "of", "x1", "été", "ﬁ", "a\x00b", "zz y", "É"]
    rows = [(i, " ".join(rnd.choice(vocabulary, rnd.integers(0, 40))) + rnd.choice([".", "\n", ",\t", ""]), rnd.choice(["en", "fr"])) for i in range(150)]
    rows = [(d, re.sub(" ", lambda _: str(rnd.choice([" ", "  ", "\t", "; ", "\x0b"], p=[0.8, 0.05, 0.05, 0.05, 0.05])), t), str(g)) for d, t, g in rows]
    return [*rows, (None, "the of the of", None), (None, None, "en"), (3, "", None), (3, " .;", "xx"), *[(7, "one two three four five six", "de")] * 9]


@pytest.mark.parametrize("sample", [1, 3, 10**9])
def test_phrases_against_plain_counts(spark, sample, monkeypatch):
    """Whatever the sample holds; with a table of bits that is full too."""
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int")
    counts, words = plain_counts([(g, t) for _, t, g in rows], 5)
    for bits in (1 << 27, 1 << 6):
        monkeypatch.setattr(phrases, "MAX_BITS", bits)
        got = phrases.frequent(docs, least=5, sample=sample).collect()
        assert {(r["lang"], r["phrase"]): r["n"] for r in got if r["m"]} == counts
        assert {r["lang"]: r["n"] for r in got if not r["m"] and r["n"]} == words
        assert len(got) == len({(r["lang"], r["phrase"]) for r in got})
    found = phrases.collocations(phrases.frequent(docs, least=5, sample=sample), top=7)
    assert sorted(map(tuple, found.collect())) == plain_collocations(counts, words, 7)


def test_phrases_of_a_long_text_cross_chunks(spark):
    n = phrases.CHUNK // 3 + 10
    docs = spark.createDataFrame([(1, "a b c " * n, "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["n"] for r in phrases.frequent(docs, least=100).collect()}
    assert got[""] == 3 * n and got["a b c a b"] == n - 1 and got["b c a b c"] == n - 1 and got["c a b c a"] == n - 2 and got["c a"] == n - 1


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(phrases.frequent(empty)).count() == 0


def test_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 3, 4, 1, 2], np.int32)
    at, n, _ = phrases._groups(ids, np.array([0, 2, 4]), np.zeros(3, np.uint64), 2)
    assert sorted(zip(ids[at].tolist(), n.tolist(), strict=True)) == [(1, 2), (3, 1)]


# --- operator 12


def plain_encode(tok, text):
    """Ids as the libraries give them for a whole text."""
    a, b = tok.first.encode(" " + text, add_special_tokens=False).ids, tok.second.encode(text)
    whole = text and b"".join(map(tok.bytes_a.__getitem__, a)) == b"".join(map(tok.bytes_b.__getitem__, b)) == f" {text}".encode()
    return (pack_ids(a), pack_ids(b)) if whole else (b"", b"")


def plain_alignment(rows):
    tok = alignment.Pair(tokenizer_path(BYTE_BPE), tokenizer_path(alignment.PIECES))
    aligned = []
    for _, text in rows:
        a, b = (np.frombuffer(x, "<u4").tolist() for x in plain_encode(tok, text or ""))
        ends = [[], []]
        for side, ids, by in ((0, a, tok.bytes_a), (1, b, tok.bytes_b)):
            at = 0
            for i in ids:
                at += len(by[i])
                ends[side].append(at)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = lambda side, ids, lo, hi: [i for i, e in zip(ids, ends[side], strict=True) if lo < e <= hi]
        aligned.append((a, b, [(group(0, a, lo, hi), group(1, b, lo, hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]))
    links = [[(x, y) for g, h in groups for x in g for y in h] for _, _, groups in aligned]
    held, best = Counter(p for ls in links for p in set(ls)), defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _), (a, b, groups), ls in zip(rows, aligned, links, strict=True):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), digest))
    return out


def test_tokens_are_those_of_the_files():
    """Bytes of every id, against the libraries' own decoding; special tokens in a text are plain text."""
    tok = alignment.Pair(tokenizer_path(BYTE_BPE), tokenizer_path(alignment.PIECES))
    for text in ["naïve <|endoftext|> <s> x", "日本 \n\t 🙂", "a  b   c"]:
        a, b = (np.frombuffer(x, "<u4").tolist() for x in tok.encode([text])[0])
        assert b"".join(tok.bytes_a[i] for i in a).decode() == b"".join(tok.bytes_b[i] for i in b).decode() == " " + text
        assert 50256 not in a and not {1, 2} & set(b)


def test_units_give_the_whole_texts_tokens():
    """Random texts with spaces, marks, bytes that no piece has, and special tokens."""
    rnd = np.random.default_rng(5)
    tok = alignment.Pair(tokenizer_path(BYTE_BPE), tokenizer_path(alignment.PIECES))
    bits = [" ", "  ", "   ", "▁", "\n", "\t", "a", "the", "é", "日本", "🙂", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", ".", "1", "\x00", "\u0301", "ﬁ", "\xa0", "\u3000", "'s"]
    texts = ["".join(rnd.choice(bits, rnd.integers(0, 30))) for _ in range(4000)]
    assert tok.encode(texts) == [plain_encode(tok, t) for t in texts]


@pytest.mark.parametrize(("part", "block"), [(1 << 17, 32), (64, 3)])
def test_alignment_of_odd_rows(spark, part, block):
    """In one block, and in many."""
    rows = [(1, "The naïve café, 日本語 <|endoftext|> and <s>"), (2, None), (3, ""), (4, " "), (None, "The naïve café"), (1, "again and again"), (1, "again and again"), (9, "x" * 3000 + " end\n\n\tof it  "), (10, "a▁b"), (11, "the the the the")]
    docs = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, row string, n_a int")
    got = alignment.align(docs, part=part, block=block)
    key = lambda r: tuple(map(str, r))
    assert got.columns == alignment.COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_alignment(rows), key=key)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12(spark, texts):
    assert sorted(map(tuple, queries.queries()["op12_pair_alignment"](spark, SF).collect())) == plain_alignment(list(texts.items()))


def test_perfect_hashes():
    rnd = np.random.default_rng(12)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.integers(0, 1 << 48, n, np.uint64))
        f = alignment.Perfect.from_bytes(alignment.Perfect.of(keys).to_bytes())
        assert sorted(f.index(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rnd.integers(0, 1 << 48, 5000, np.uint64), keys)
        assert (f.index(others) == -1).all()


def test_vectors_sum_as_a_tree(spark):
    rows = [(p, n, np.full(5, n + p, "<i8").tobytes()) for p in (0, 1) for n in range(alignment.FAN_IN**2 + 3) if n % 7]
    df = spark.createDataFrame([(p, n, bytearray(b)) for p, n, b in rows], "part long, node long, counts binary")
    got = {r["part"]: np.frombuffer(r["counts"], "<i8").tolist() for r in alignment.tree_sum(df, alignment.FAN_IN**2 + 3).collect()}
    assert got == {p: [sum(n + p for x, n, _ in rows if x == p)] * 5 for p in (0, 1)}


# --- operator 13


def plain_sketch(text, k=sketches.K):
    words = [xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]

    def fold(ws):
        h = 42
        for w in ws:
            h = xxh64_intdigest(struct.pack("<Q", w), h)
        return h - (1 << 64) if h >> 63 else h

    runs = [words[i : i + 5] for i in range(len(words) - 4)] or [words] * bool(words)
    return sorted(set(map(fold, runs)))[:k]


def plain_near(a, b, k=sketches.K):
    u = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*u}) / len(u) if u else 1.0


def hexed(s):
    return "".join(f"{h % (1 << 64):016x}" for h in s)


def plain_op13(rows):
    """Of (doc_id, text) in order."""
    out = []
    for i, (d, t) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        s, e, o = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(s), hexed(e), plain_near(s, e), plain_near(s, o)))
    return out


def test_op13(spark, texts):
    got = queries.queries()["op13_bottom_k"](spark, SF).collect()
    assert sorted(tuple(r)[:7] for r in got) == plain_op13(list(texts.items()))
    assert all(r["n_shingles"] == len(plain_sketch(texts[r["doc_id"]])) for r in got if len(r["fingerprint"]) < 16 * sketches.K)


def test_next_documents_of_odd_rows(spark):
    """Null and repeated ids, equal rows, empty texts, columns with helpers' names; over many blocks and one."""
    rows = [(None, "n1", 1), (None, None, 2), (5, "five", 3), (5, "also five", 4), *[(6, "same", 5)] * 4, (-3, "", 6), (9, "nine 🙂", 7)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, `h` int").repartition(5), "odd_rows")
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sketches.with_next(docs, {"n": F.length(f"{P}text")}).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(rows) and all(r[f"{P}n"] == len(r[f"{P}text"]) and r[f"{P}next_n"] == len(r[f"{P}next_text"]) for r in got)
        after = Counter((r["doc_id"], r[f"{P}text"], r[f"{P}next_text"]) for r in got)
        assert after[6, "same", "same"] == 3 and after[6, "same", "nine 🙂"] == 1 and after[-3, "", "five"] + after[-3, "", "also five"] == 1
        # every text follows as often as it stands: one cycle
        assert Counter(r[f"{P}next_text"] for r in got) == Counter(t or "" for _, t, _ in rows)
        assert [x[0] is None for x in after if x[1] == "nine 🙂"] == [False] and after[9, "nine 🙂", "n1"] + after[9, "nine 🙂", ""] == 1


def test_next_of_one_document_and_of_none(spark):
    one = sketches.with_next(spark.createDataFrame([(1, "only")], "doc_id long, text string")).collect()
    assert [(r[f"{P}text"], r[f"{P}next_text"]) for r in one] == [("only", "only")]
    assert sketches.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate(spark):
    """A merged sketch is that of all shingles; estimates lie near the true shares."""
    rnd = np.random.default_rng(13)
    word = lambda n: [f"w{x}" for x in rnd.integers(0, 10**9, n)]
    base, other = word(4000), word(2000)
    pairs = {"part": (base[:3000], base), "half": (base, base[:2000] + other), "small": (base[:20], base[:30]), "none": ([], []), "apart": (base, other)}
    df = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in pairs.items()], "k string, a string, b string").select("k", sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    found = {r["k"]: r for r in df.select("k", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c"), sketches.distinct_count(F.col("a")).alias("n"), sketches.merge(F.col("a"), F.col("b")).alias("m")).collect()}
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k, (a, b) in pairs.items():
        x, y = runs(a), runs(b)
        assert found[k]["r"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.15)
        assert found[k]["c"] == pytest.approx(len(x & y) / len(x) if x else 1.0, abs=0.2)
        assert found[k]["n"] == pytest.approx(len(x), rel=0.3)
    assert found["small"]["r"] == 16 / 26 and found["small"]["n"] == 16 and found["none"]["n"] == 0
    parts = spark.createDataFrame([(k, " ".join(t)) for k, (a, b) in pairs.items() for t in (a, b)] + [(None, "a b c d e"), ("null", None)], "k string, t string")
    merged = {r["k"]: r["s"] for r in sketches.merged(parts.select("k", sketches.sketch(F.col("t")).alias("s")), ["k"], "s").collect()}
    assert all(merged[k] == found[k]["m"] for k in pairs) and merged[None] == plain_sketch("a b c d e") and merged["null"] == []
