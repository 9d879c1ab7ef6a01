"""Names that share most of their characters, as a set-similarity join.

Similarity is the number of shared distinct lower-case characters over the longer
length (``functions.text.char_similarity``). It depends on a name's set of characters
and its length only, so names of equal set and length are one class. Two classes are
compared only if they meet under a key: their lengths allow the similarity, and they
share what any such pair must share of their rarest characters (one of them where one
shared character is enough, else two). Bitmaps then bound the overlap, and what is left
is computed exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import kept


def letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c != ""))


def classes_of(rows: DataFrame, name: str) -> DataFrame:
    """(class, size, chars, length, n): one row for names of one character set and length; empty names have none."""
    made = rows.select(F.sort_array(letters(F.col(name))).alias("chars"), F.length(name).alias("length")).filter("length > 0")
    return made.groupBy("chars", "length").agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("chars", "length")).withColumn("size", F.size("chars"))


def _at_least(length: Column, least: float) -> Column:
    """Shared characters that a name of this length needs; rounded down by a hair, as the exact test decides."""
    return F.greatest(F.ceil(length * least - 1e-9).cast("int"), F.lit(1))


def candidates(rows: DataFrame, name: str, least: float) -> DataFrame:
    """Pairs of different classes that pass the bounds, each once: (a, b, and both sides' columns)."""
    if not 0 < least <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    # A name that has too few characters for its own length is like none.
    cls = kept(classes_of(rows, name).filter(F.col("size") >= _at_least(F.col("length"), least)), "classes")
    # Characters by how rare they are; the table has a row a character.
    rarity = cls.select(F.explode("chars").alias("char")).groupBy("char").count()
    ordered = cls.select("class", F.explode("chars").alias("char")).join(rarity, "char").groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("count", "char"))), lambda x: x["char"]).alias("rare"))
    need = _at_least(F.col("length"), least)
    bits = F.aggregate("chars", F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))
    both = cls.join(ordered, "class").withColumns({"need": need, "bits": bits})
    # A pair that needs two shared characters shares two of each side's size - need + 2 rarest; one that needs one, one of size - need + 1.
    singles = F.when(F.col("need") == 1, F.transform("rare", lambda c: F.concat(c, c))).otherwise(F.array().cast("array<string>"))
    first = F.slice("rare", 1, F.greatest(F.col("size") - F.greatest("need", F.lit(2)) + 2, F.lit(0)))
    twos = F.flatten(F.transform(first, lambda c, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda d: F.concat(c, d))))
    keyed = kept(both.withColumn("keys", F.concat(singles, twos)).select("class", "length", "size", "n", "chars", "bits", "keys"), "keys")
    # The longer one of a pair looks for each length that the shorter may have.
    shorter = keyed.select(*(F.col(c).alias(f"a_{c}") for c in keyed.columns)).withColumn("key", F.explode("a_keys")).withColumn("at", F.col("a_length"))
    longer = keyed.select(*(F.col(c).alias(f"b_{c}") for c in keyed.columns)).withColumn("key", F.explode("b_keys")).withColumn("at", F.explode(F.sequence(_at_least(F.col("b_length"), least), F.col("b_length"))))
    met = shorter.join(longer, ["key", "at"]).filter((F.col("a_length") < F.col("b_length")) | (F.col("a_class") < F.col("b_class")))
    # A pair that meets under several keys counts under the first.
    met = met.filter(F.element_at(F.array_intersect("a_keys", "b_keys"), 1) == F.col("key"))
    alone = lambda x, y: F.bit_count(F.col(f"{x}_bits").bitwiseAND(F.bitwise_not(f"{y}_bits")))
    most = F.least(F.col("a_size") - alone("a", "b"), F.col("b_size") - alone("b", "a"))
    return met.filter(most >= _at_least(F.col("b_length"), least))


def near_classes(rows: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """(chars_a, length_a, n_a, chars_b, length_b, n_b, similarity) of different classes at ``least`` or more, the shorter first."""
    shared = F.size(F.array_intersect("a_chars", "b_chars"))
    out = candidates(rows, name, least).withColumn("similarity", shared / F.col("b_length")).filter(F.col("similarity") >= least)
    return out.select(*(F.col(f"{s}_{c}").alias(f"{c}_{s}") for s in "ab" for c in ("chars", "length", "n")), "similarity")


def near_names(rows: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """(a, b, similarity, n_a, n_b): each pair of different names at ``least`` or more, the smaller text first, with its numbers of rows.

    Pairs of classes, with the names of each class joined to both sides: names of one
    class are alike as far as their set fills their length.
    """
    names = kept(rows.filter(F.length(name) > 0).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).withColumns({"chars": F.sort_array(letters(F.col("name"))), "length": F.length("name")}), "names")
    pairs = near_classes(names, "name", least).select("chars_a", "length_a", "chars_b", "length_b", "similarity")
    side = lambda s: names.select(F.col("name").alias(f"name_{s}"), F.col("n").alias(f"n_{s}"), F.col("chars").alias(f"chars_{s}"), F.col("length").alias(f"length_{s}"))
    other = pairs.join(side("a"), ["chars_a", "length_a"]).join(side("b"), ["chars_b", "length_b"]).select("name_a", "n_a", "name_b", "n_b", "similarity")
    same = side("a").join(side("b"), (F.col("chars_a") == F.col("chars_b")) & (F.col("length_a") == F.col("length_b")) & (F.col("name_a") < F.col("name_b")))
    same = same.withColumn("similarity", F.size("chars_a") / F.col("length_a")).filter(F.col("similarity") >= least).select("name_a", "n_a", "name_b", "n_b", "similarity")
    swap = F.col("name_a") > F.col("name_b")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    return other.unionByName(same).select(pick("name", "a", "b").alias("a"), pick("name", "b", "a").alias("b"), "similarity", pick("n", "a", "b").alias("n_a"), pick("n", "b", "a").alias("n_b"))
