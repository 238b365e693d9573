"""Document fingerprints: bottom-k sketches of shingle hashes (operator 13). DataFrame functions only.

A text's shingles are its runs of five words, lower-cased; a shorter text is one shingle, a text without words has
none. The sketch holds the k least distinct hashes of them, ascending. Sketches merge: the k least of two sketches'
union are the sketch of both texts' shingles together, in any order and grouping. The k least of a union are an even
sample of its shingles, so the share of them that lies in both sketches estimates resemblance, the share among those
in the first containment, and the k-th hash the number of distinct shingles; a sketch with fewer than k hashes is its
whole set, and all three are exact.

The following document of each is found without an ordered pass over all: range boundaries cut (doc_id, text hash,
row) into blocks, every block's first row is also sent to the block before it, and blocks are windows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import let, words_of
from .store import P, columns, documents, partitions_for, text_of

#: Hashes of a sketch: the standard error of a resemblance is at most 0.045.
K = 128
WIDTH = 5
FIRST = -(1 << 63)


def shingles(text: Column, width: int = WIDTH) -> Column:
    """A hash for each run of ``width`` words; one for all words if there are fewer, none without words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    cut = lambda w: F.when(F.size(w) >= width, runs(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)), cut)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k least distinct shingle hashes, ascending. A null text has no shingles."""
    return least(shingles(F.coalesce(text, F.lit("")), width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both have; 1 if neither has any."""
    both = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return let(merge(a, b, k), both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first one's shingles that the second has; 1 if the first has none, and NULL if none of its hashes is among the k least of both."""

    def share(u: Column) -> Column:
        of = lambda x: F.size(F.array_intersect(x, u))
        return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.try_divide(of(F.array_intersect(a, b)), of(a)))

    return let(merge(a, b, k), share)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the place of the k-th hash among all values."""
    place = (F.element_at(s, -1).cast("double") - float(FIRST)) / 2.0**64
    return F.when(F.size(s) < k, F.size(s)).otherwise(F.round((k - 1) / place)).cast("long")


def as_text(s: Column) -> Column:
    """Sixteen hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merged(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """(keys, ``column``): one sketch for all parts of a key, such as a source or the pieces of a text.

    Hashes are made distinct, and only the k least of a key and task are dealt by key, so a key's parts may be any
    number. Null sketches and null keys: nothing, and a key like any other. Ties and repeats are one hash. A key whose
    parts are all empty has an empty sketch; no parts: no rows.
    """
    rows = parts.select(*keys, F.explode_outer(column).alias(f"{P}h"))
    once = rows.distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(f"{P}h").asc_nulls_last()))
    return once.withColumn(f"{P}n", place).where(F.col(f"{P}n") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(f"{P}h")).alias(column))


def _numbers(values: list[int]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with the prefixed text and next text, and of each ``made`` column its value and the next document's.

    The order is (doc_id, text hash); null doc_ids come first, and rows that share both are alike and follow each
    other. After the last document comes the first. Null texts are empty, a single document follows itself, an empty
    table gives no rows. ``docs`` must be a table's scan or as steady: if it gives its rows in another order when it is
    read again, the query fails and says so. Other columns may have any names.
    """
    spark, made, names = docs.sparkSession, made or {}, ["d", "h", "row"]
    d, h, row = (f"{P}{n}" for n in names)
    rows = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), f"{P}text": text_of(), row: F.monotonically_increasing_id()}).withColumn(h, F.xxhash64(f"{P}text"))
    n = partitions_for(spark, rows.agg(F.sum(F.octet_length(f"{P}text") + 24)).first()[0])
    dealt = rows.select(d, h, row).repartitionByRange(n, d, h, row)
    firsts = sorted(tuple(r[1]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(d, h, row))).collect())  # at most one for each of the n
    if not firsts:
        firsts = [(FIRST, FIRST, 0)]
    bound = {c: _numbers([b[i] for b in firsts]) for i, c in enumerate((d, h, row))}
    at = lambda i, c: F.get(bound[c], i)

    def step(low: Column, jump: Column) -> Column:
        i = low + jump
        reached = (at(i, d) < F.col(d)) | (at(i, d) == F.col(d)) & ((at(i, h) < F.col(h)) | (at(i, h) == F.col(h)) & (at(i, row) <= F.col(row)))
        return F.when((i < len(firsts)) & reached, i).otherwise(low)

    jumps = [1 << k for k in reversed(range(max(1, (len(firsts) - 1).bit_length())))]
    block, guest = f"{P}block", f"{P}guest"
    found = rows.withColumn(block, F.aggregate(_numbers(jumps).cast("array<int>"), F.lit(0), step))
    own = F.col(block)
    leads = (at(own, d) == F.col(d)) & (at(own, h) == F.col(h)) & (at(own, row) == F.col(row))
    places = F.when(leads, F.array(own, F.pmod(own - 1, F.lit(len(firsts))))).otherwise(F.array(own))
    sent = found.select(*columns(docs), d, h, row, f"{P}text", F.posexplode(places).alias(guest, block)).repartition(n, block)
    order = Window.partitionBy(block).orderBy(guest, d, h, row)
    with_made = sent.withColumns({f"{P}{m}": c for m, c in made.items()})
    after = with_made.withColumns({f"{P}next_{m}": F.lead(f"{P}{m}").over(order) for m in ["text", *made]})
    followed = F.coalesce(f"{P}next_text", F.raise_error(F.lit("with_next: rows came in another order when they were read again; give a written table")).cast("string"))
    return after.where(F.col(guest) == 0).withColumn(f"{P}next_text", followed).select(*columns(docs), *(F.col(f"{P}{x}{m}") for m in ["text", *made] for x in ("", "next_")))


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = with_next(documents(spark, sf_dir).select("doc_id", "text"), {"s": sketch(F.col(f"{P}text"))})
    n = F.length(f"{P}text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col(f"{P}text"), F.lit(1), n - moved), F.substring(F.col(f"{P}next_text"), F.lit(1), moved))
    cut = followed.select("doc_id", n.cast("long").alias("n_chars"), f"{P}s", f"{P}next_s", edited.alias("edited"))
    # from a generator, so that the edited sketch is made once
    both = cut.select("doc_id", "n_chars", f"{P}s", f"{P}next_s", F.inline(F.array(F.struct(F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("e")))))
    own, other, e = F.col(f"{P}s"), F.col(f"{P}next_s"), F.col("e")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(e).alias("edited_fingerprint"), resemblance(own, e).alias("near_edited"), resemblance(own, other).alias("near_next"), containment(own, e).alias("contained_in_edited"), distinct_count(own).alias("n_shingles"))
