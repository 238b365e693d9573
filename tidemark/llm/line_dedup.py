"""Line dedup within an edit bound of one unit (operator 3). DataFrame functions only.

A line's units are its words if it has eight or more, else the characters of its words with one space between. One unit
in eight may differ: two lines are near when their words are equal, or both have eight units or more of one kind and
one unit inserted, deleted or replaced makes them equal. A line goes when a near line stands earlier, in the order of
(doc_id, line number); lines without a word always stay.

Deletion neighbourhood: a line's variants with unit j left out, and the places where it could have lost a
unit, become hashed keys (length, j, hash of the units before, hash of the units after); lines that share a
key are one edit apart. The earliest line of each key is the witness, the units of line and witness
are verified, and verified lines go. Keys are aggregated before they are joined back, so no pairs are listed
within a group. Since one edit leaves a line's head or tail alone, only lines that share either with another
line are looked at closer; of these, only lines that agree with another on all but one of eight blocks get
variants, for the units of that block. Both conditions are necessary for a pair, so none is lost.

Texts are shuffled once, into a table bucketed by row key that all later joins by row reuse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import has_word, let, words_of
from .store import P, columns, documents, materialize, new_path

MIN_UNITS = 8
ROW = [f"{P}doc", f"{P}h"]
LINE = ["k1", "k2"]
FIRST = -(1 << 63)


def _line_hash(words: Column) -> Column:
    return let(F.array_join(words, " "), lambda line: F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")))


def _units(words: Column) -> Column:
    """Words, or the characters of a short line; these begin with a space, so they differ from words."""
    chars = F.transform(F.regexp_extract_all(F.array_join(words, " "), F.lit("(?s)."), F.lit(0)), lambda c: F.concat(F.lit(" "), c))
    return F.when(F.size(words) >= MIN_UNITS, words).otherwise(chars)


def _ends(units: Column, n: Column) -> Column:
    """Keys of head and tail. Their length is the largest power of two within half the units; a length of twice a power of two has the next smaller too, for partners that are one unit shorter."""

    def keys(m: Column) -> Column:
        return F.array(F.xxhash64(F.lit("head"), m, F.slice(units, 1, m)), F.xxhash64(F.lit("tail"), m, F.slice(units, n - m + 1, m)))

    def at(m: Column) -> Column:
        return F.when((n == 2 * m) & (m > MIN_UNITS // 2), F.concat(keys(m), keys((m / 2).cast("int")))).otherwise(keys(m))

    power = F.pow(F.lit(2.0), F.floor(F.log2(n / 2 + F.lit(1e-9)))).cast("int")
    return F.when(n < MIN_UNITS, F.array().cast("array<bigint>")).otherwise(let(power, at))


def _blocks(units: Column, n: Column, m: Column) -> Column:
    """(m, lo, hi, key) for the line as one of ``m`` units without units lo + 1 to hi; one unit more falls into the gap if n = m + 1."""
    q = F.greatest(F.lit(1), F.floor(m / 8).cast("int"))

    def block(b: Column) -> Column:
        lo, hi = b * q, F.when(b == 7, m).otherwise(F.least((b + 1) * q, m))
        left = F.greatest(m - hi, F.lit(0))
        cut = F.xxhash64(m, b, F.slice(units, F.lit(1), F.least(lo, m)), F.slice(units, n - left + 1, left))
        return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), cut.alias("key"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), block), lambda s: s["lo"] < m)


def _lines(table: DataFrame) -> DataFrame:
    """(row key, line number, words) of every line with a word."""
    rows = table.where(F.col("text").isNotNull()).select(*ROW, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(has_word(F.col("line"))).select(*ROW, "line_no", words_of(F.col("line")).alias("words"))


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with its row key (doc_id, hash of the text), in a table bucketed by it."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumns({ROW[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), ROW[1]: F.xxhash64("text")})
    name = f"tidemark_lines_{uuid.uuid4().hex}"
    keyed.repartition(n, *ROW).write.option("compression", "zstd").option("path", new_path(spark, "lines")).bucketBy(n, *ROW).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and ``table`` knows them and their buckets
    return table


def _near(lines: DataFrame, table: DataFrame, firsts: DataFrame) -> DataFrame:
    """(k1, k2) of distinct lines that have an earlier line one edit away."""
    ends = lines.where(F.size("ends") > 0).select(F.explode("ends").alias("e"), *LINE)
    # aggregates are written before they are joined back: then both sides of the join are plain shuffles, whose hot keys Spark splits
    shared = materialize(ends.groupBy("e").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a != z").select("e"), "line_ends")
    wanted = ends.join(shared, "e", "left_semi").select(*LINE).distinct().join(firsts, LINE)
    asked = wanted.groupBy(F.col("first.doc").alias(ROW[0]), F.col("first.h").alias(ROW[1])).agg(F.collect_set("first.line_no").alias("asked"))
    picked = let(F.split("text", "\n"), lambda ls: F.transform("asked", lambda i: F.struct(i.alias("line_no"), F.get(ls, i).alias("line"))))
    found = table.select(*ROW, "text").join(asked, ROW).select(*ROW, F.inline(picked)).select(*ROW, "line_no", words_of(F.col("line")).alias("words"))
    place = F.struct(F.col(ROW[0]).alias("doc"), F.col("line_no"), F.col(ROW[1]).alias("h")).alias("place")
    chosen = materialize(found.select(_line_hash(F.col("words")).alias("k"), place, _units(F.col("words")).alias("units")).select("k.*", "place", "units").dropDuplicates(LINE), "candidates")

    # the edit's block: lines that agree on all but one of about eight blocks, for either length of the partner
    n, j = F.col("n"), F.col("j")
    sized = chosen.withColumn("n", F.size("units"))
    blocks = sized.select(*LINE, F.explode(F.concat(_blocks(F.col("units"), n, n), _blocks(F.col("units"), n, n - 1))).alias("b"))
    shared = materialize(blocks.groupBy("b.key").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a != z").select("key"), "line_blocks")
    flagged = blocks.select(*LINE, "b.*").join(shared, "key", "left_semi").groupBy(*LINE).agg(F.collect_list(F.struct("m", "lo", "hi")).alias("flags"))

    # hashes of the units before and after each place, as exclusive ors of (unit, distance from that end)
    one = Window.partitionBy(*LINE).orderBy("j")
    each = sized.join(flagged, LINE).select(*LINE, "place", "n", "flags", F.posexplode("units").alias("i", "w")).withColumn("j", F.col("i") + 1)
    summed = each.withColumns({"p": F.xxhash64("w", "j"), "s": F.xxhash64("w", n - j)})
    summed = summed.withColumns({"upto": F.bit_xor("p").over(one.rowsBetween(Window.unboundedPreceding, 0)), "since": F.bit_xor("s").over(one.rowsBetween(0, Window.unboundedFollowing))})
    before, after = F.col("upto").bitwiseXOR(F.col("p")), F.col("since").bitwiseXOR(F.col("s"))
    key = lambda kind, n, j, a, z: F.xxhash64(F.lit(kind), n.cast("int"), j.cast("int"), a, z)
    within = lambda own, end: F.exists("flags", lambda f: (f["m"] == (n if own else n - 1)) & (j > f["lo"]) & (j <= f["hi"] + end))
    variants = F.array(
        F.when(within(True, 0), key("replaced", n, j, before, after)),
        F.when(within(False, 1), key("lost", n - 1, j, before, after)),
        F.when(within(True, 1), key("lost", n, j, before, F.col("since"))),
        F.when((n == j) & within(True, 0), key("lost", n, j + 1, F.col("upto"), F.lit(0).cast("long"))),
    )
    keyed = materialize(summed.select(*LINE, "place", F.explode(variants).alias("v")).where("v IS NOT NULL"), "line_variants")
    best = materialize(keyed.groupBy("v").agg(F.min(F.struct("place", *LINE)).alias("w"), F.count("*").alias("c")).where("c > 1").select("v", "w"), "line_witnesses")
    witness = keyed.join(best, "v").where("w.place < place").groupBy(*LINE).agg(F.min("w").alias("w")).select(*LINE, F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2"))

    left = chosen.select(*LINE, F.col("units").alias("a"))
    right = chosen.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("units").alias("b"))
    pairs = witness.join(left, LINE).join(right, ["w1", "w2"])
    agree = lambda a, b: F.array_position(F.concat(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.array(F.lit(False))), False) - 1
    longest = F.greatest(F.size("a"), F.size("b"))
    verified = agree(F.col("a"), F.col("b")) + agree(F.reverse("a"), F.reverse("b")) >= longest - 1
    return pairs.where(verified).select(*LINE)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines: all its columns, ``text`` rebuilt, plus prefixed n_lines and n_removed.

    Null text stays null. A text that loses all its lines becomes empty. Null doc_ids come before all others.
    Rows that share doc_id and text stand at the same place: none counts as earlier than the other. Blank
    lines stay. Lines of any length; an empty table gives an empty result. Columns may have any names.
    """
    table = bucketed(docs)
    units = let(_units(F.col("words")), lambda u: _ends(u, F.size(u)))
    hashed = _lines(table).select(*ROW, "line_no", _line_hash(F.col("words")).alias("k"), units.alias("ends"))
    lines = materialize(hashed.select(*ROW, "line_no", "k.*", "ends"), "line_keys")
    firsts = materialize(lines.groupBy(*LINE).agg(F.min(F.struct(F.col(ROW[0]).alias("doc"), F.col("line_no"), F.col(ROW[1]).alias("h"))).alias("first")), "line_firsts")
    near = materialize(_near(lines, table, firsts), "line_near")
    decided = materialize(firsts.join(near.withColumn("near", F.lit(True)), LINE, "left"), "line_decisions")
    here = F.struct(F.col(ROW[0]).alias("doc"), F.col("line_no"))
    gone = lines.join(decided, LINE).where(F.col("near") | (here > F.struct(F.col("first.doc"), F.col("first.line_no"))))
    removed = gone.groupBy(*ROW).agg(F.collect_set("line_no").alias(f"{P}removed"))
    joined = table.join(removed, ROW, "left")

    def rebuilt(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{P}removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(f"{P}removed").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rebuilt))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    kept = [text.alias("text") if c == "text" else column for c, column in zip(docs.columns, columns(docs), strict=True)]
    return joined.select(*kept, F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias(f"{P}n_lines"), F.coalesce(F.size(f"{P}removed"), F.lit(0)).alias(f"{P}n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col(f"{P}n_lines").cast("long").alias("n_lines"), F.when(F.col(f"{P}n_removed") < 0, 0).otherwise(F.col(f"{P}n_removed")).cast("long").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


#: Pairs by shared first or last four units, then the same verification.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
w AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
s AS (SELECT doc_id, i, array_to_string(ws, ' ') AS k, ws FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, i, k, CASE WHEN len(ws) >= 8 THEN ws ELSE list_transform(range(1, length(k) + 1), lambda j: ' ' || substring(k, j, 1)) END AS ws FROM s),
f AS (SELECT k, min((doc_id, i)) AS first, any_value(ws) AS ws, any_value(len(ws)) AS n FROM k GROUP BY k),
c AS (SELECT a.k AS k, a.ws AS x, b.ws AS y, greatest(a.n, b.n) AS m, least(a.n, b.n) AS o FROM f a JOIN f b
      ON a.ws[1:4] = b.ws[1:4] WHERE a.n >= 8 AND b.n >= 8 AND b.first < a.first AND abs(a.n - b.n) <= 1
      UNION SELECT a.k, a.ws, b.ws, greatest(a.n, b.n), least(a.n, b.n) FROM f a JOIN f b
      ON a.ws[-4:] = b.ws[-4:] WHERE a.n >= 8 AND b.n >= 8 AND b.first < a.first AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT k FROM c WHERE
      len(list_filter(range(1, o + 1), lambda j: x[1:j] = y[1:j])) + len(list_filter(range(1, o + 1), lambda j: x[-j:] = y[-j:])) >= m - 1),
gone AS (SELECT k.doc_id, k.i FROM k JOIN f ON f.k = k.k LEFT JOIN near ON near.k = k.k WHERE near.k IS NOT NULL OR (k.doc_id, k.i) > f.first),
t AS (SELECT w.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (WHERE gone.i IS NULL), '') AS t
      FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE sha256(t) END AS text_sha256
FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id
"""
