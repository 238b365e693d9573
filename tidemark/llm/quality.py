"""Quality rules with adaptive thresholds (operator 4). DataFrame functions only.

Each document gets four ratios: symbols by character, repeated lines by line, repeated words by word, and characters
by word. Per language and source, the distribution of each ratio, and of the sizes that it is taken of, is kept as a
mergeable quantile sketch: counts of values rounded up to five significant bits, so any quantile is off by at most
1/16, equal for any order of merging, and a group's sketch has a few hundred rows at most. Documents that fail the
base rules are left out of it.

A group's threshold is its ninth decile plus five times the distance from its median to there. That distance is
one event in a document of the group's median size at least (a symbol, a repeated line, two windows of words; for the
mean length of words the sketch's own resolution), since a ratio can't tell finer. No fixed cutoff bounds it.
Quantiles of a group of n documents are drawn towards those of its language by weight, n : 100, so sparse groups pass
over into their language smoothly. Documents are joined with their group's thresholds and filtered; beyond the
threshold each has one event free, which a short document could not spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import P, columns, documents, materialize, text_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Per ratio: what is counted, of what, and how many make an event.
RATIOS = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW), "word_length": ("word_chars", "n_words", 0)}
SIZES = ["word_chars", "n_lines", "n_words"]
#: Ratios are in millionths. SPREAD: times the distance; PRIOR: documents that a language's quantiles count for.
SCALE, SPREAD, PRIOR = 1_000_000, 5, 100
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in ``words``, the first included."""

    def covered(hashes: Column) -> Column:
        def marks(p: Column) -> Column:
            same = lambda x, k: F.get(p, k)["h"].eqNullSafe(x["h"])
            found = F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(found, lambda v: v.isNotNull()))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        reach = lambda m: F.transform(m, lambda v, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), v - F.get(m, k - 1))))
        return let(let(pairs, marks), lambda m: F.aggregate(reach(m), F.lit(0), lambda a, v: a + v))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) <= WINDOW, 0).otherwise(let(windows(w), count))).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the five counts and the number of lines with a word, as prefixed columns. Null text: zeros."""
    text = text_of()
    worded = let(F.filter(F.split(text, "\n"), has_word), lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    found = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeats")))
    made = F.struct(found.alias(f"{P}w"), worded.alias(f"{P}l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias(f"{P}n_symbols"))
    # from a generator, so that filters and later columns use the counts and do not make them again
    out = docs.select(*columns(docs), F.inline(F.array(made)))
    return out.select(
        *columns(docs),
        F.col(f"{P}w.n").alias(f"{P}n_words"),
        F.col(f"{P}w.chars").alias(f"{P}word_chars"),
        f"{P}n_symbols",
        F.col(f"{P}l.dup").cast("long").alias(f"{P}n_dup_lines"),
        F.col(f"{P}w.repeats").alias(f"{P}n_repeat_words"),
        F.col(f"{P}l.n").cast("long").alias(f"{P}n_lines"),
    )


def measures() -> dict[str, Column]:
    """The ratios and the sizes that they are taken of."""
    ratio = lambda part, whole: F.expr(f"if({P}{whole} = 0, 0L, {SCALE}L * {P}{part} div {P}{whole})")
    return {k: ratio(part, whole) for k, (part, whole, _) in RATIOS.items()} | {k: F.col(f"{P}{k}") for k in SIZES}


def base_failed() -> Column:
    return F.expr(f"{P}n_words < 20 OR 100 * {P}n_repeat_words > 30 * {P}n_words")


def sketch(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, value, n): documents by rounded value of each measure, without those that fail the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures().items())))
    low = F.expr("greatest(length(bin(v)) - 5, 0)")
    rows = counted.where(~base_failed()).select(*keys, pairs.alias("r")).select(*keys, "r.*").withColumn("low", low)
    return rows.groupBy(*keys, "measure", F.expr("shiftleft(shiftright(v, low) + 1, low) - 1").alias("value")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_docs, mid_ and top_ of each measure): median and ninth decile that a group's sketch gives."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "n_docs": F.sum("n").over(group)})
    at = lambda k, q: F.min(F.when((F.col("measure") == k) & (F.col("upto") * 100 >= F.col("n_docs") * q), F.col("value")))
    return ranked.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), *(at(k, q).alias(f"{name}_{k}") for k in measures() for name, q in (("mid", 50), ("top", 90))))


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, threshold of each ratio): one row a group that has a document past the base rules. Null languages and sources are groups of their own."""
    by_group = sketch(counted, ["lang", "source"])
    own = quantiles(by_group, ["lang", "source"])
    names = [c for c in own.columns if c.startswith(("mid_", "top_"))]
    by_lang = quantiles(merge(by_group, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), *(F.col(c).alias(f"l_{c}") for c in names))
    drawn = own.join(by_lang, own["lang"].eqNullSafe(by_lang["l"])).select("lang", "source", *(F.expr(f"(n_docs * {c} + {PRIOR} * l_{c}) div (n_docs + {PRIOR})").alias(c) for c in names))
    step = lambda k, whole, event: f"{event * SCALE}L div greatest(mid_{whole}, 1L)" if event else f"mid_{k} div 16"
    return drawn.select("lang", "source", *(F.expr(f"top_{k} + {SPREAD} * greatest(top_{k} - mid_{k}, {step(k, whole, event)})").alias(f"{P}max_{k}") for k, (_, whole, event) in RATIOS.items()))


def limits_of(counted: DataFrame) -> DataFrame:
    """``thresholds``, written: the planner then knows their size, and broadcasts few of them without a shuffle of the rows."""
    return materialize(thresholds(counted), "thresholds")


def judge(counted: DataFrame, limits_by_group: DataFrame) -> DataFrame:
    """Adds base_failed and kept, prefixed, by joining documents with their group's thresholds."""
    t = limits_by_group.select(F.col("lang").alias(f"{P}lang"), F.col("source").alias(f"{P}source"), *(f"{P}max_{k}" for k in RATIOS))
    joined = counted.join(t, counted["lang"].eqNullSafe(t[f"{P}lang"]) & counted["source"].eqNullSafe(t[f"{P}source"]), "left")
    within = " AND ".join(f"{SCALE}L * ({P}{part} - {event}) <= {P}max_{k} * {P}{whole}" for k, (part, whole, event) in RATIOS.items())
    return joined.withColumns({f"{P}base_failed": base_failed(), f"{P}kept": ~base_failed() & F.coalesce(F.expr(within), F.lit(False))})


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, five counts, base_failed, kept), a row for each row of ``docs``; the counts are made once.

    Null text: zeros, so it fails. Null language or source: a group of its own. Repeated rows: each counted and judged.
    A ratio that ties with its threshold is kept. Texts of any length are read whole. Empty table: empty result.
    """
    counted = materialize(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return judge(counted, limits_of(counted)).select("doc_id", *(F.col(f"{P}{c}").alias(c) for c in COUNTS), F.col(f"{P}base_failed").alias("base_failed"), F.col(f"{P}kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns, whatever their names.

    Rows are written once with their counts; thresholds come from the counts alone. Nulls, ties, repeated rows, long
    texts and empty tables as in ``assess``.
    """
    counted = materialize(with_counts(docs), "counted")
    return judge(counted, limits_of(counted)).where(f"{P}kept").select(*columns(docs))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN cov ON cov.r = w.r),
m AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
             CASE WHEN word_chars = 0 THEN 0 ELSE 1000000 * n_symbols // word_chars END AS symbols,
             CASE WHEN n_lines = 0 THEN 0 ELSE 1000000 * n_dup_lines // n_lines END AS dup_lines,
             CASE WHEN n_words = 0 THEN 0 ELSE 1000000 * n_repeat_words // n_words END AS repeats,
             CASE WHEN n_words = 0 THEN 0 ELSE 1000000 * word_chars // n_words END AS word_length FROM c),
u AS (SELECT lang, source, measure, CAST(v AS BIGINT) AS v FROM (
        SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'word_chars', 'n_lines', 'n_words']) AS measure,
               unnest([symbols, dup_lines, repeats, word_length, word_chars, n_lines, n_words]) AS v FROM m WHERE NOT base_failed)),
s AS (SELECT lang, source, measure, (((v >> greatest(length(bin(v)) - 5, 0)) + 1) << greatest(length(bin(v)) - 5, 0)) - 1 AS value FROM u),
k AS (SELECT lang, source, measure, value, count(*) AS n FROM s GROUP BY ALL),
kl AS (SELECT lang, measure, value, sum(n) AS n FROM k GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS nd FROM k),
ql AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY lang, measure) AS nd FROM kl),
t AS (SELECT lang, source, measure, max(nd) AS nd, min(value) FILTER (WHERE upto * 100 >= nd * 50) AS a, min(value) FILTER (WHERE upto * 100 >= nd * 90) AS b FROM q GROUP BY ALL),
tl AS (SELECT lang, measure, min(value) FILTER (WHERE upto * 100 >= nd * 50) AS a, min(value) FILTER (WHERE upto * 100 >= nd * 90) AS b FROM ql GROUP BY ALL),
h AS (SELECT t.lang, t.source, t.measure, (t.nd * t.a + 100 * tl.a) // (t.nd + 100) AS a, (t.nd * t.b + 100 * tl.b) // (t.nd + 100) AS b
      FROM t JOIN tl ON t.lang IS NOT DISTINCT FROM tl.lang AND t.measure = tl.measure),
w2 AS (SELECT lang, source, max(a) FILTER (WHERE measure = 'word_chars') AS mc, max(a) FILTER (WHERE measure = 'n_lines') AS ml, max(a) FILTER (WHERE measure = 'n_words') AS mw FROM h GROUP BY ALL),
lim AS (SELECT h.lang, h.source, measure, b + 5 * greatest(b - a, CASE measure WHEN 'symbols' THEN 1000000 // greatest(mc, 1) WHEN 'dup_lines' THEN 1000000 // greatest(ml, 1)
             WHEN 'repeats' THEN 16000000 // greatest(mw, 1) ELSE a // 16 END) AS high FROM h JOIN w2 ON h.lang IS NOT DISTINCT FROM w2.lang AND h.source IS NOT DISTINCT FROM w2.source),
g AS (SELECT lang, source, max(high) FILTER (WHERE measure = 'symbols') AS hs, max(high) FILTER (WHERE measure = 'dup_lines') AS hd,
             max(high) FILTER (WHERE measure = 'repeats') AS hr, max(high) FILTER (WHERE measure = 'word_length') AS hw FROM lim GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(1000000 * (n_symbols - 1) <= hs * word_chars AND 1000000 * (n_dup_lines - 1) <= hd * n_lines
         AND 1000000 * (n_repeat_words - 16) <= hr * n_words AND 1000000 * word_chars <= hw * n_words, false) AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
"""
