"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: Function words of the languages that the corpus may hold; a text of prose has some of them.
STOP_WORDS = (
    "the of and to a in is that it for on was with as be by at this are or "
    "der die das und ist von zu den mit nicht ein eine im auf "
    "le la les de des et un une est que en du pour dans au "
    "el los las y por con del se una al su no es o "
    "il di che per e non da sono del della em os um uma het een van dat"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` (SQL over the measures) must lie in [``low``, ``high``]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios have n_words or n_lines as divisor; a text without any fails min_words first.
RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeat_words", "try_divide(n_repeat_words, n_words)", high=0.5),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", low=2, high=15),
    Rule("symbols", "try_divide(n_symbols, n_words)", high=0.6),
    Rule("duplicate_lines", "try_divide(n_dup_lines, n_lines)", high=0.5),
    Rule("bullet_lines", "try_divide(n_bullet_lines, n_lines)", high=0.9),
    Rule("ellipsis_lines", "try_divide(n_ellipsis_lines, n_lines)", high=0.5),
    Rule("letters", "try_divide(n_letter_words, n_words)", low=0.3),
    Rule("stop_words", "n_stop_words", low=2),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, so that the value is written, and computed, once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(sorted_windows: str) -> str:
    """Positions of the windows (struct of w, i) whose w occurs twice or more: equal ones are neighbours once sorted."""
    s = sorted_windows
    return (
        f"array_distinct(flatten(zip_with(slice({s}, 1, size({s}) - 1), slice({s}, 2, size({s}) - 1), "
        "(a, b) -> if(a.w = b.w, array(a.i, b.i), cast(array() as array<int>)))))"
    )


#: Windows of three words are compared by hash; only where two hashes meet are the words compared, so the count is exact.
_REPEAT_WORDS = _let(
    "hashed",
    "sort_array(transform(sequence(1, size(ws) - 2), i -> struct(xxhash64(ws[i - 1], ws[i], ws[i + 1]) as w, i as i)))",
    _let(
        "met",
        _repeated("hashed"),
        "if(size(met) = 0, 0, "
        + _let("exact", "sort_array(transform(met, i -> struct(concat_ws(' ', slice(ws, i, 3)) as w, i as i)))", f"size(array_distinct(flatten(transform({_repeated('exact')}, i -> sequence(i, i + 2)))))")
        + ")",
    ),
)

_OF_WORDS = {
    "n_words": "size(ws)",
    "n_repeat_words": f"if(size(ws) < 4, 0, {_REPEAT_WORDS})",
    "n_letter_words": r"size(filter(ws, w -> w rlike '\\p{L}'))",
    "n_stop_words": f"size(filter(ws, w -> lower(w) in ({', '.join(repr(w) for w in STOP_WORDS)})))",
}
_OF_LINES = {
    "n_lines": "size(ls)",
    "n_dup_lines": "size(ls) - size(array_distinct(ls))",
    "n_bullet_lines": r"size(filter(ls, x -> x rlike '^[\\x20\\x09-\\x0D]*[-*•]'))",
    "n_ellipsis_lines": r"size(filter(ls, x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))",
}
_OF_TEXT = {
    "word_chars": r"length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ''))",
    "n_symbols": r"length(regexp_replace(t, '[^#*$%&|<>]+', ''))",
}
MEASURES = (*_OF_WORDS, *_OF_LINES, *_OF_TEXT)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of every whole text: counts of words, characters, symbols, lines and repeats.

    All are built-in functions in one row-wise step. It is written as a generator of one row, so that
    no optimizer rule copies the measures into each filter and rule that uses them. Columns of the
    measures' names in the input are replaced.
    """
    fields = lambda some: "named_struct(" + ", ".join(f"'{k}', cast({v} as bigint)" for k, v in some.items()) + ")"
    words = _let("ws", r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')", fields(_OF_WORDS))
    lines = _let("ls", r"filter(split(t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", fields(_OF_LINES))
    every = _let("t", f"coalesce(`{text_col}`, '')", f"named_struct('w', {words}, 'l', {lines}, 't', {fields(_OF_TEXT)})")
    kept = [c for c in docs.columns if c not in MEASURES]
    step = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(F.expr(every))).alias("_m"))
    return step.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_m.{g}.{k}").alias(k) for g, some in (("w", _OF_WORDS), ("l", _OF_LINES), ("t", _OF_TEXT)) for k in some))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures breaks, as one array expression."""
    broken = []
    for r in rules:
        sides = [f"({r.measure}) < {r.low}"] * (r.low is not None) + [f"({r.measure}) > {r.high}"] * (r.high is not None)
        broken.append(F.when(F.coalesce(F.expr(" OR ".join(sides)), F.lit(False)), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Add the measures, ``broken`` (names of broken rules) and ``kept``.

    One projection, no shuffle. Defined cases: a null text is empty and has no words, so it breaks
    ``min_words``; a ratio without a divisor breaks nothing; repeated rows are judged alike, each on
    its own; an empty table gives no rows; other columns pass through, but those of the names of
    measures and verdicts are replaced (:func:`keep_good` keeps them).
    """
    judged = measures(docs, text_col).withColumn("broken", compile_rules(rules))
    return judged.withColumn("kept", F.size("broken") == 0)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that break no rule, with all their columns as they are, whatever their names.

    Defined cases: as in :func:`judge`.
    """
    ours = {c.lower() for c in (*MEASURES, "broken", "kept")}
    held = docs
    for c in docs.columns:
        if c.lower() in ours:
            held = held.withColumnRenamed(c, unused(f"_{c}", held))
    good = judge(held, rules, dict(zip(docs.columns, held.columns))[text_col]).where("kept")
    return good.select(*(F.col(f"`{h}`").alias(c) for c, h in zip(docs.columns, held.columns)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id
),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND n_symbols <= 0.6 * n_words
    AND n_dup_lines <= 0.5 * n_lines AND n_bullet_lines <= 0.9 * n_lines AND n_ellipsis_lines <= 0.5 * n_lines
    AND n_letter_words >= 0.3 * n_words AND n_stop_words >= 2 AS kept
FROM j
"""
