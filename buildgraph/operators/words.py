"""Word search and letter counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_words(tokens: DataFrame, middle: str, others: str, min_length: int = 4) -> DataFrame:
    """Distinct words made of the seven letters only, holding the middle one; sorted.

    ``tokens`` has ``word``.
    """
    if len(middle) != 1 or len(others) != 6:
        raise ValueError("one middle letter and six other letters are needed")
    letters = "".join(sorted({middle, *others}))
    return (
        tokens.filter(
            F.col("word").rlike(f"^[{letters}]+$")
            & F.contains("word", F.lit(middle))
            & (F.length("word") >= min_length)
        )
        .select("word")
        .distinct()
        .orderBy("word")
    )


def short_words(words: DataFrame) -> DataFrame:
    """Words too short to have a leading pair."""
    return words.filter(F.length("word") < 2)


def pair_counts(words: DataFrame) -> DataFrame:
    """Words per first two characters; one-letter words are left out."""
    long = words.filter(F.length("word") >= 2)
    return long.groupBy(
        F.substring("word", 1, 1).alias("first"), F.substring("word", 2, 1).alias("second")
    ).agg(F.count(F.lit(1)).alias("words"))


def length_counts(words: DataFrame) -> DataFrame:
    """Words per first character and length in characters; one-letter words are left out."""
    long = words.filter(F.length("word") >= 2)
    return long.groupBy(
        F.substring("word", 1, 1).alias("first"), F.length("word").cast("int").alias("length")
    ).agg(F.count(F.lit(1)).alias("words"))
