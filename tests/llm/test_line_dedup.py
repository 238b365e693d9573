import random

from tidemark.llm import line_dedup
from tidemark.llm.store import P


def units(words):
    return words if len(words) >= 8 else [" " + c for c in " ".join(words)]


def near(a, b):
    if a == b:
        return True
    a, b = units(a), units(b)
    if (a[0][0] == " ") != (b[0][0] == " ") or min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    m = max(len(a), len(b))
    p = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    s = next((i for i in range(min(len(a), len(b))) if a[-1 - i] != b[-1 - i]), min(len(a), len(b)))
    return p + s >= m - 1


def brute(rows):
    """Texts of (doc_id, text) without lines that have an earlier near line."""
    lines = [(-(1 << 63) if d is None else d, i, line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))]
    words = [line.split() for _, _, line in lines]
    gone = {(d, i, line) for (d, i, line), w in zip(lines, words) if w and any((e, k) < (d, i) and v and near(w, v) for (e, k, _), v in zip(lines, words))}
    return sorted(((d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (-(1 << 63) if d is None else d, i, x) not in gone)) for d, t in rows), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_random_edits_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    rows, seeds = [], [[rnd.choice(vocab) for _ in range(n)] for n in (3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 70)]
    for d in range(60):
        out = []
        for _ in range(6):
            line = list(rnd.choice(seeds))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.choice([0, len(line), rnd.randrange(len(line) + 1)])
                kind = rnd.randrange(3)
                line[at : at + (kind > 0)] = [rnd.choice(vocab)] if kind < 2 else []
            out.append(rnd.choice(["", " "]) + " ".join(line))
        rows.append((d, "\n".join(out)))
    assert run(spark, rows) == brute(rows)


def test_short_lines_against_brute_force(spark):
    rnd = random.Random(5)
    seeds = ["Chapter one", "a b c d e f g h", "abcdefgh", "a b c d e f g", "See also: notes", "😀" * 9, "tiny", "eight ch", "seven c"]
    rows = []
    for d in range(50):
        out = []
        for _ in range(5):
            line = list(rnd.choice(seeds))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at, kind = rnd.randrange(len(line) + 1), rnd.randrange(3)
                line[at : at + (kind > 0)] = [rnd.choice("abé 😁")] if kind < 2 else []
            out.append("".join(line))
        rows.append((d, "\n".join(out)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (None, "a b\n\na b"), (3, "a b\n\n c"), (4, long), (5, long + " y"), (6, "twin"), (6, "twin"), (7, "twin\n"), (8, "c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a\na", 5, "k", 6)], "doc_id long, text string, n int, words string, `x.y` int")
    out = line_dedup.dedup_lines(df)
    assert out.columns[:5] == df.columns
    row = out.first()
    assert (row["text"], row["n"], row["words"], row[f"{P}n_removed"]) == ("a", 5, "k", 1)
