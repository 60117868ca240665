"""Cleaning of names, sentinels and lists, joins by edit distance and nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tags(text: Column) -> Column:
    """Markup tags out, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def null_if(x: Column, sentinel) -> Column:
    """Null where the value is a sentinel such as -1 or ``(none)``."""
    return F.nullif(x, F.lit(sentinel))


def list_items(text: Column, separator: str = ",") -> Column:
    """Distinct trimmed items of a list inside one string; null has none."""
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x))), lambda x: x != "")


def match_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _segment(chars: Column, i: int, most: int) -> tuple[Column, Column]:
    """Place (from 0) and length of part ``i`` of the ``most`` + 1 even parts of a text of ``chars`` characters, longer parts last."""
    parts = most + 1
    base, short = F.floor(chars / parts).cast("int"), parts - chars % parts
    return base * i + F.greatest(F.lit(i) - short, F.lit(0)), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _part_key(chars: Column, i: int, part: Column) -> Column:
    return F.xxhash64(chars, F.lit(i), part)


def _pieces(text: Column, chars: Column, i: int, size: Column, low: Column, high: Column) -> Column:
    return F.transform(F.sequence(low, high), lambda at: _part_key(chars, i, F.substr(text, at + 1, size)))


def _own_parts(text: Column, most: int) -> Column:
    """A key for each part of the text."""
    n = F.length(text)
    cuts = [_segment(n, i, most) for i in range(most + 1)]
    return F.array(*[_part_key(n, i, F.substr(text, at + 1, size)) for i, (at, size) in enumerate(cuts)])


def _sought_parts(text: Column, most: int) -> Column:
    """Keys of the parts that any text within ``most`` edits must share one of.

    For each length of the other text, and each of its parts, the pieces of this
    one that may be that part: if part i is the first that is unchanged, at most i
    edits stand before it and at most ``most`` - i after it, which bounds its shift on both sides.
    """
    n, keys = F.length(text), []
    for longer in range(-most, most + 1):
        other = n - longer
        for i in range(most + 1):
            at, size = _segment(other, i, most)
            low = F.greatest(at - i, at + longer - (most - i), F.lit(0))
            high = F.least(at + i, at + longer + (most - i), n - size)
            pieces = _pieces(text, other, i, size, low, F.greatest(low, high))
            keys.append(F.when((other >= 0) & (low <= high), pieces).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(*keys))


def edit_pairs(left: DataFrame, right: DataFrame, name: str, other: str, most: int = 3) -> DataFrame:
    """name, other, distance: all pairs of distinct values of two columns at an edit distance of at most ``most``, none left out.

    ``other`` is cut into ``most`` + 1 parts, one of which stands unchanged, near its
    place, in any text within the distance; so the pairs meet by an equi-join on a part's
    hash. The letters that two texts don't share, at most two for an edit, rule out most
    candidates before the banded distance decides. Nulls match nothing. A frequent part is a
    frequent join key, which adaptive execution splits between tasks; nothing is gathered.
    """
    bit = lambda x: F.pow(F.lit(2.0), F.pmod(F.ascii(x), F.lit(62))).cast("bigint")
    letters = lambda c: F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(F.when(x == "", F.lit(0).cast("bigint")).otherwise(bit(x))))
    a = left.select(F.col(name).alias("_a")).where("_a is not null").distinct().withColumn("_la", letters(F.col("_a")))
    b = right.select(F.col(other).alias("_b")).where("_b is not null").distinct().withColumn("_lb", letters(F.col("_b")))
    a = a.withColumn("_key", F.explode(_sought_parts(F.col("_a"), most)))
    b = b.withColumn("_key", F.explode(F.array_distinct(_own_parts(F.col("_b"), most))))
    near = F.bit_count(F.col("_la").bitwiseXOR(F.col("_lb"))) <= 2 * most
    pairs = a.join(b, "_key").where(near).withColumn("distance", F.levenshtein("_a", "_b", most)).where("distance >= 0")
    return pairs.select(F.col("_a").alias(name), F.col("_b").alias(other), "distance").distinct()


def fuzzy_match(left: DataFrame, right: DataFrame, name: str, other: str, most: int = 3) -> DataFrame:
    """For each distinct ``name`` its nearest ``other`` by edit distance of match keys, if that is at most ``most``; ties by text.

    Names of one key are matched once. Names without letters and digits have the empty key, which other short keys may match.
    """
    names = left.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_k", match_key(F.col(name)))
    first = right.where(F.col(other).isNotNull()).groupBy(match_key(F.col(other)).alias("_l")).agg(F.min(other).alias(other))
    pairs = edit_pairs(names, first, "_k", "_l", most).join(first, "_l")
    best = pairs.groupBy("_k").agg(F.min(F.struct("distance", other)).alias("_best"))
    return names.join(best, "_k").select(name, F.col(f"_best.{other}").alias(other), F.col("_best.distance").alias("distance"))
