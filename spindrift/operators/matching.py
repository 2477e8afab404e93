"""Texts found in other texts: edit-similarity joins and approximate containment.

Both meet by equality first. Strings that are close share a segment (pigeonhole),
so a join on segments finds every close pair without comparing a block's strings
with one another. A value that a text nearly holds shares half its words with a
window of it, so only windows around shared words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import let, similarity

_INT = "array<int>"


def _upto(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast(_INT))


def _segment(length: Column, parts: Column, i: Column) -> Column:
    """Place (from 0) and size of segment i (from 1) of a string in parts: the
    last ones are a character longer if the length does not divide."""
    size, longer = F.floor(length / parts), length % parts
    start = (i - 1) * size + F.greatest(F.lit(0), i - 1 - (parts - longer))
    return F.struct(start.cast("int").alias("at"), (size + (i > parts - longer).cast("int")).cast("int").alias("size"))


def close_pairs(strings: DataFrame, block: list[str], column: str, tenths: int = 1) -> DataFrame:
    """Pairs (one < two) of distinct strings of a block whose edit
    similarity is at least 1 - ``tenths`` / 10: block, one, two.

    A string of length l may differ from one of length m >= l by
    t = m * tenths / 10 edits, so of t + 1 segments of the shorter one at least
    one stands unchanged in the longer one, near its place. Segments are the
    keys of the join; by the multi-match-aware bounds a longer string has few
    substrings for each. Nulls are left out.
    """
    rows = strings.where(F.col(column).isNotNull()).select(*block, F.col(column).alias("_s")).distinct().withColumn("_l", F.length("_s"))
    allowed = lambda length: F.floor(length * tenths / 10)
    # as the shorter one: for each number of edits that a longer partner allows
    most = F.floor(F.col("_l") * 10 / (10 - tenths))
    short = rows.select("*", F.explode(_upto(allowed(F.col("_l")), allowed(most))).alias("_t"))
    short = short.select("*", F.explode(_upto(F.lit(1), F.col("_t") + 1)).alias("_i")).withColumn("_g", _segment(F.col("_l"), F.col("_t") + 1, F.col("_i")))
    index = short.select(*block, "_l", "_t", "_i", F.substring("_s", F.col("_g.at") + 1, F.col("_g.size")).alias("_key"), F.col("_s").alias("_short"))
    # as the longer one: substrings where a shorter one's segment could stand
    long = rows.select(*block, F.col("_s").alias("_long"), F.col("_l").alias("_m"), allowed(F.col("_l")).cast("int").alias("_t"))
    long = long.select("*", F.explode(_upto(F.greatest(F.lit(1), F.ceil(F.col("_m") * (10 - tenths) / 10)), F.col("_m"))).alias("_l"))
    long = long.select("*", F.explode(_upto(F.lit(1), F.col("_t") + 1)).alias("_i")).withColumn("_g", _segment(F.col("_l"), F.col("_t") + 1, F.col("_i")))
    apart, left, at = F.col("_m") - F.col("_l"), F.col("_i") - 1, F.col("_g.at")
    right = F.col("_t") - left
    first = F.greatest(F.lit(0), at - left, at + apart - right)
    last = F.least(F.col("_m") - F.col("_g.size"), at + left, at + apart + right)
    probes = long.select(*block, "_l", "_t", "_i", "_long", F.explode(_upto(first, last)).alias("_at"), F.col("_g.size").alias("_n"))
    probes = probes.select(*block, "_l", "_t", "_i", "_long", F.substring("_long", F.col("_at") + 1, F.col("_n")).alias("_key"))
    met = probes.join(index, [*block, "_l", "_t", "_i", "_key"]).where("_long <> _short")
    pairs = met.select(*block, F.least("_short", "_long").alias("one"), F.greatest("_short", "_long").alias("two")).distinct()
    return pairs.where(similarity(F.col("one"), F.col("two")) >= 1 - tenths / 10)


def similar_rows(rows: DataFrame, block: list[str], row_id: str, column: str, least: float) -> DataFrame:
    """Pairs of rows (a < b by id) of a block whose strings have an edit
    similarity of ``least`` or more: a, b, similarity.

    Below about 0.7 no segment needs to stand unchanged, so the strings of a
    block meet one another; but each string counts once however many rows have
    it, lengths that differ too much are passed over, and rows are joined to the
    pairs of strings that are close. Blocks are few bytes and much
    work, so they are dealt into a fixed number of parts. Nulls are left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(F.col(column).isNotNull())
    strings = rows.select(*block, F.col(column).alias("_s")).distinct().repartition(parts, *block)
    one, two = (strings.withColumnRenamed("_s", c) for c in ("one", "two"))
    longest = F.greatest(F.length("one"), F.length("two"))
    # by a hair more than allowed, so that rounding leaves the verdict to the similarity
    lengths = F.abs(F.length("one") - F.length("two")) <= longest * (1 - least) + 1e-6
    same = F.when(F.col("one") == F.col("two"), 1.0).otherwise(similarity(F.col("one"), F.col("two")))
    close = one.join(two.hint("merge"), block).where((F.col("one") <= F.col("two")) & lengths).select("*", same.alias("similarity")).where(F.col("similarity") >= least)
    close = close.unionByName(close.where("one <> two").select(*block, F.col("two").alias("one"), F.col("one").alias("two"), "similarity"))
    a = rows.select(*block, F.col(column).alias("one"), F.col(row_id).alias("a"))
    b = rows.select(*block, F.col(column).alias("two"), F.col(row_id).alias("b"))
    return close.join(a, [*block, "one"]).join(b, [*block, "two"]).where("a < b").select("a", "b", "similarity")


def _starts(hits: Column, n: Column, size: Column, length: Column) -> Column:
    """Windows of ``size`` words, by where they start, that hold at least half of
    n words: each begins no earlier than its last needed hit allows."""
    need = F.ceil(F.least(n, size) / 2).cast("int")
    spans = F.transform(_upto(F.lit(0), F.size(hits) - need), lambda i: F.struct(F.get(hits, i).alias("a"), F.get(hits, i + need - 1).alias("b")))
    near = F.filter(spans, lambda s: s["b"] - s["a"] < size)
    return F.array_distinct(F.flatten(F.transform(near, lambda s: _upto(F.greatest(F.lit(0), s["b"] - size + 1), F.least(s["a"], length - size)))))


def containment(holder: Column, value: Column) -> Column:
    """How well a text holds a value, both normalised: 1 where it
    stands as it is (an empty value always does); else the best edit similarity
    of a window of about as many words that shares half of the value's; 0 where
    no window does. Null if either is."""

    def best(row: Column) -> Column:
        n, length = F.size(row["w"]), F.size(row["text"])
        hits = F.filter(F.transform(row["text"], lambda x, i: F.when(F.array_contains(row["w"], x), i)), lambda i: i.isNotNull())

        def over(hits: Column) -> Column:
            def of_size(d: int) -> Column:
                size = F.greatest(F.lit(1), n + d)
                return F.array_max(F.transform(_starts(hits, n, size, length), lambda s: similarity(F.array_join(F.slice(row["text"], s + 1, size), " "), row["value"])))

            few = 2 * F.size(hits) < F.greatest(F.lit(1), n - 1)
            return F.when(few, 0.0).otherwise(F.coalesce(F.greatest(*(of_size(d) for d in (-1, 0, 1))), F.lit(0.0)))

        return let(hits, over)

    row = F.struct(F.split(value, " ").alias("w"), F.split(holder, " ").alias("text"), value.alias("value"))
    return F.when(holder.isNull() | value.isNull(), F.lit(None).cast("double")).when((value == "") | F.contains(holder, value), 1.0).otherwise(let(row, best))


def best_containment(values: DataFrame, texts: DataFrame, keys: list[str], value_id: str) -> DataFrame:
    """How well a text holds a value, both normalised: values (keys,
    value_id, value), texts (keys, text; one or more a key): keys, value_id,
    score, the best ``containment`` over the key's texts.

    A null value, or one without a text, has no row. Values and texts meet once,
    by a merge join: nothing that grows with them is broadcast, whatever Spark
    takes the size of a text to be.
    """
    values = values.where(F.col("value").isNotNull()).select(*keys, value_id, "value")
    texts = texts.where(F.col("text").isNotNull()).select(*keys, "text")
    met = values.join(texts.hint("merge"), keys).select(*keys, value_id, "value", containment(F.col("text"), F.col("value")).alias("score"))
    return met.groupBy(*keys, value_id, "value").agg(F.max("score").alias("score")).drop("value")
