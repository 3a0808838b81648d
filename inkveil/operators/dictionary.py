"""Look-ups of district names in a dictionary table (one column, ``dong``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import compact


def _endings(rows: DataFrame, text_col: str, shortest: int, longest: int, border: str, whole: bool) -> DataFrame:
    """Rows with each ending of the compact text that stands after a border syllable, or is the whole (if ``whole``)."""
    text = F.regexp_replace(F.col(text_col), r"(?U)\s+", "")
    step = rows.withColumn("_text", text).withColumn("_n", F.explode(F.sequence(F.lit(shortest), F.lit(longest))))
    n, length = F.col("_n"), F.length("_text")
    fits = (n < length) & F.substring(F.col("_text"), length - n, F.lit(1)).rlike(f"[{border}]")
    if whole:
        fits = fits | (n == length)
    return step.where(fits).withColumn("ending", compact(F.substring(F.col("_text"), length - n + 1, n))).drop("_text", "_n")


def exact(rows: DataFrame, dongs: DataFrame, text_col: str, key: list[str]) -> DataFrame:
    """Keys of rows whose text ends in a district of the dictionary: an ending of 2 to 7 characters after 구, 시, 군, 읍 or 면, or the whole."""
    ends = _endings(rows.where(F.col(text_col).rlike(r"(?U)[동리]\s*$")), text_col, 2, 7, "구시군읍면", whole=True)
    names = dongs.select(compact(F.col("dong")).alias("ending")).distinct()
    return ends.join(names, "ending", "left_semi").select(*key).distinct()


def _variants(name: Column) -> Column:
    """A name and all that is left of it without one character, each once."""
    n = F.length(name)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n)))
    return F.array_distinct(F.concat(F.array(name), F.when(n > 0, shorter).otherwise(F.array().cast("array<string>"))))


def near_names(asked: DataFrame, names: DataFrame, asked_col: str, name_col: str) -> DataFrame:
    """Pairs of ``asked`` and ``names`` (their columns of these names, each value once) at an edit distance of one at most.

    Deletion neighbourhoods: each side emits itself and all its forms with one character less; two strings one edit apart
    share such a form, whether the edit inserts, deletes or replaces, so an equi-join on forms misses none, and the distance
    is then verified. A form is shared by a few names only, however long the dictionary, so no key is hot.

    Defined cases: null values pair with nothing; an empty value pairs with single characters; empty tables give no rows.
    """
    spread = lambda df, c: df.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_form", F.explode(_variants(F.col(c))))
    met = spread(asked, asked_col).join(spread(names, name_col), "_form").select(asked_col, name_col).distinct()
    return met.where(F.levenshtein(asked_col, name_col, 1) >= 0)


def fuzzy(rows: DataFrame, dongs: DataFrame, text_col: str, key: list[str]) -> DataFrame:
    """Keys of rows whose text ends in a district with one character wrong: an ending of 3 to 6 characters, not in 동 or 리, one edit off at most."""
    ends = _endings(rows.where(~F.col(text_col).rlike(r"(?U)[동리]\s*$")), text_col, 3, 6, "구시군읍면도", whole=False).where(F.length("ending") >= 3)
    names = dongs.select(compact(F.col("dong")).alias("name"))
    known = near_names(ends, names, "ending", "name").select("ending").distinct()
    return ends.join(known, "ending", "left_semi").select(*key).distinct()
