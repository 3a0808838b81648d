"""Detection of personal data in page texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import normalized
from inkveil.operators import dictionary
from inkveil.operators.spans import blocks, cut, once, resolve, with_candidates
from inkveil.plans.rules import RULES, Rule

PAGE = ["doc_id", "page_index"]


def page_finds(pages: DataFrame, rules: tuple[Rule, ...] = RULES, dongs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Add ``finds``: what the rules find on each page, overlaps resolved, as an array in order of priority.

    One narrow pass: each row is a page, and all rules' candidates live in it. Rules that ask the
    dictionary are left out without ``dongs``; with it, only their candidates are exploded, joined and
    gathered by page.
    """
    rules = tuple(r for r in rules if dongs is not None or not r.lookup)
    found = once(pages, "_norm", normalized(F.coalesce(F.col(text_col), F.lit(""))))
    found = with_candidates(found, rules, F.col(text_col))
    if dongs is not None and any(r.lookup for r in rules):
        found = _confirmed(found, rules, dongs)
    return once(found, "finds", resolve(F.col("_all"))).drop("_norm", "_all")


def _confirmed(found: DataFrame, rules: tuple[Rule, ...], dongs: DataFrame) -> DataFrame:
    asking = [i for i, r in enumerate(rules) if r.lookup]
    asked = found.select(*PAGE, F.explode(F.filter("_all", lambda c: c["rule"].isin(asking))).alias("c")).select(*PAGE, F.col("c.rule").alias("rule"), F.col("c.start").alias("start"), F.col("c.match").alias("match"))
    key = [*PAGE, "rule", "start"]
    said = [getattr(dictionary, kind)(asked.where(F.col("rule").isin([i for i in asking if rules[i].lookup == kind])), dongs, "match", key) for kind in ("exact", "fuzzy")]
    passed = said[0].unionByName(said[1]).groupBy(*PAGE).agg(F.collect_set(F.struct("rule", "start")).alias("_passed"))
    joined = found.join(passed, PAGE, "left")
    stays = lambda c: ~c["rule"].isin(asking) | F.coalesce(F.array_contains("_passed", F.struct(c["rule"].alias("rule"), c["start"].alias("start"))), F.lit(False))
    return joined.withColumn("_all", F.filter("_all", stays)).drop("_passed")


def items(found: DataFrame, excluded: Iterable[str] = (), text_col: str = "text") -> DataFrame:
    """A review item for each find: ids ``r-0``, ``r-1`` ... of a document in order of page, rule and place.

    Excluded categories go last of all, as they hold their places against lower rules.
    """
    flat = found.select(*PAGE, blocks(F.col(text_col)).alias("_text"), F.explode("finds").alias("f"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "f.rule", "f.start")
    numbered = flat.withColumn("_n", F.row_number().over(order) - 1)
    kept = numbered.where(~F.col("f.category").isin(list(excluded))) if excluded else numbered
    content = cut(F.col("_text"), F.col("f.claim_start"), F.col("f.claim_end") - F.col("f.claim_start"))
    return kept.select(
        "doc_id",
        F.concat(F.lit("r-"), F.col("_n")).alias("id"),
        F.lit("detected").alias("origin"),
        F.col("page_index").alias("page"),
        F.col("f.category").alias("category"),
        content.alias("content"),
        F.col("f.pattern_type").alias("pattern_type"),
        F.col("f.confidence").alias("confidence"),
        F.col("f.status").alias("validation"),
        F.col("f.claim_start").alias("start"),
        F.col("f.claim_end").alias("end"),
    )


def detect(pages: DataFrame, rules: tuple[Rule, ...] = RULES, dongs: DataFrame | None = None, excluded: Iterable[str] = (), text_col: str = "text") -> DataFrame:
    """Review items of ``pages`` (``doc_id, page_index, text``)."""
    return items(page_finds(pages, rules, dongs, text_col), excluded, text_col)


def masked(text: Column, finds: Column, token: bool = False) -> Column:
    """Text with its finds blacked out: a block for each character, or the category in brackets for each find.

    Finds that overlap are first joined, so that no part of either is left.
    """
    spans = F.array_sort(F.transform(finds, lambda f: F.struct(f["claim_start"].alias("s"), f["claim_end"].alias("e"), f["category"].alias("c"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, f: Column) -> Column:
        begin = F.greatest(a["at"], f["s"])
        fill = F.when(f["s"] >= a["at"], F.concat(F.lit("["), f["c"], F.lit("]"))).otherwise("") if token else F.repeat(F.lit("█"), F.greatest(f["e"] - begin, F.lit(0)))
        return F.struct(F.greatest(a["at"], f["e"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(f["s"] - a["at"], F.lit(0))), fill).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
