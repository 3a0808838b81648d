"""Matches of patterns with their places, as array columns; places count code points from 0."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.plans import rules as R

#: A text with so long a run of syllables that end a region makes backtracking patterns crawl; address rules search it in linear time.
SYLLABLE_RUN = r"(?:[시군구도]\s*){12}"
#: Unicode white space, and pairs of marks of which a text that holds one takes the next.
_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARKS = [(chr(a), chr(a + 1)) for a in (*range(1, 9, 2), *range(0x100000, 0x10FFFC, 2))]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column by a generator of one row, so that no optimizer rule copies its expression into what uses it."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def running_sum(values: Column) -> Column:
    """Sums up to each entry of a non-empty array of ints, by blocks of the root of its size, so that long arrays stay cheap."""
    plus = lambda a, x: a + x

    def by(v: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / size).cast("int")), lambda b: F.slice(v, b * size + 1, size))

        def joined(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), plus))
            starts = F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, 1, j), F.lit(0), plus))
            return let(starts, lambda at: F.flatten(F.transform(blocks, lambda x, j: F.transform(x, lambda _, i: F.get(at, j) + F.aggregate(F.slice(x, 1, i + 1), F.lit(0), plus)))))

        return let(blocks, joined)

    return let(values, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: by(v, size)))


#: A letter for private use that marks where matches stood. Spark compiles a pattern to split by for each text, but one to replace only once.
_MARK = "\ue0f3"


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of all matches of a Java pattern that matches no empty string."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(matches: Column) -> Column:
        marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_MARK)), _MARK, -1)
        gaps = F.slice(F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(marked), 1, F.size(matches))
        ends = running_sum(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        return F.when(F.size(matches) > 0, F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def re2(pattern: str) -> str:
    """A pattern of the catalogue for RE2, with Unicode classes as in ``Rule.java``."""
    out, inside = "", False
    for t in re.findall(r"\\.|.", pattern, re.DOTALL):
        if t in (r"\s", r"\d"):
            chars = _WHITE if t == r"\s" else r"\p{Nd}"
            out += chars if inside else f"[{chars}]"
        else:
            inside = (inside or t == "[") and t != "]"
            out += t
    return out


def linear_spans(text: Column, patterns: tuple[str, ...]) -> Column:
    """:func:`spans` of each pattern (without look-around), found by RE2: leftmost-first like Java's matcher, but without backtracking. Null for null."""
    compiled = [f"({re2(p)})" for p in patterns]

    def marked(text: str, pattern: str) -> list[dict]:
        a, b = next(m for m in _MARKS if m[0] not in text and m[1] not in text)
        found, at = [], 0
        head, *rest = pc.replace_substring_regex(pa.array([text]), pattern, f"{a}\\1{b}")[0].as_py().split(a)
        at = len(head)
        for part in rest:
            match, _, gap = part.partition(b)
            found.append({"start": at, "end": at + len(match), "match": match})
            at += len(match) + len(gap)
        return found

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())])))
        return pa.array([None if t is None else [marked(t, p) for p in compiled] for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, "array<array<struct<start:int,end:int,match:string>>>")(text)


_SPANS = "array<struct<start:int,end:int,match:string>>"


def _let_sql(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _raw(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_sql(text: str, pattern: str) -> str:
    """:func:`spans` as SQL text. A page's rules make thousands of expressions, which Spark parses faster than Python can send them."""
    total = lambda part: f"aggregate({part}, 0, (a, x) -> a + x)"
    inner = f"transform(part, (x, i) -> bs[j] + {total('slice(part, 1, i + 1)')})"
    sums = _let_sql("parts", "transform(sequence(0, cast((size(ls) - 1) / w as int)), k -> slice(ls, k * w + 1, w))", _let_sql("bs", _let_sql("ss", f"transform(parts, part -> {total('part')})", f"transform(ss, (x, i) -> {total('slice(ss, 1, i)')})"), f"flatten(transform(parts, (part, j) -> {inner}))"))
    gaps = f"if(contains({text}, '{_MARK}'), split({text}, {_raw(pattern)}, -1), split(regexp_replace({text}, {_raw(pattern)}, '{_MARK}'), '{_MARK}', -1))"
    lengths = f"zip_with(slice({gaps}, 1, size(ms)), ms, (g, m) -> length(g) + length(m))"
    ends = _let_sql("ls", lengths, _let_sql("w", "cast(ceil(sqrt(size(ls))) as int)", sums))
    placed = _let_sql("es", ends, "zip_with(ms, es, (m, e) -> named_struct('start', e - length(m), 'end', e, 'match', m))")
    return _let_sql("ms", f"regexp_extract_all({text}, {_raw(pattern)}, 0)", f"if(size(ms) > 0, {placed}, cast(array() as {_SPANS}))")


#: Characters of a block of :func:`blocks`.
BLOCK = 2048


def blocks(text: Column) -> Column:
    """The text in blocks of :data:`BLOCK` characters, so that a place far on is reached without counting all characters before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on, as ``substring`` gives them, of a text in :func:`blocks`."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + length) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, length)


def before(blocks: Column, start: Column, n: int = R.ANCHOR_WINDOW) -> Column:
    """The ``n`` characters before a place of a text in :func:`blocks`, lower-cased, without white space."""
    first = F.greatest(start - n, F.lit(0))
    return F.regexp_replace(F.lower(cut(blocks, first, start - first)), r"(?U)\s+", "")


def anchor(context: Column, rule: R.Rule) -> Column:
    """Struct(category, pattern_type, boost) of the first anchor group with a word in ``context``; without one the rule's own and no boost, or null if the rule needs one."""

    def told(category: str, pattern_type: str, boost: float) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(pattern_type).alias("pattern_type"), F.lit(boost).alias("boost"))

    found = F.lit(None).cast("struct<category:string,pattern_type:string,boost:double>") if rule.required else told(rule.category, rule.pattern_type, 0.0)
    for group in reversed(rule.anchors):
        any_word = reduce(lambda a, b: a | b, (F.contains(context, F.lit(w)) for w in group.words))
        found = F.when(any_word, told(group.category or rule.category, group.category or rule.pattern_type, R.ANCHOR_BOOST)).otherwise(found)
    return found


def bank_start(text: Column, start: Column) -> Column:
    """Where a bank's name begins that stands before ``start`` with only white space between, else ``start``."""
    head = F.substring(text, F.lit(1), start)
    name = F.regexp_extract(head, rf"([가-힣]*(?:{'|'.join(R.BANK_ENDINGS)}))(?U:\s*)$", 0)
    return start - F.length(name)


CANDIDATE = "struct<rule:int,category:string,pattern_type:string,status:string,confidence:double,start:int,end:int,claim_start:int,claim_end:int,match:string>"


def _asked_sql(rule: R.Rule) -> str:
    """SQL: is the page, of which ``korean`` says whether it holds a Hangul syllable, worth running a rule without parts, or with a test of the page beside them?"""
    tests = [f"(korean OR contains(_norm, '{rule.word}'))" if rule.word else "korean"] if rule.korean else []
    if rule.pre and (rule.part or not rule.around):
        tests.append(f"_norm rlike {_raw('(?U)' + rule.pre)}")
    if rule.needs:
        tests.append(f"_norm rlike {_raw('(?U)' + rule.needs)}")
    return " AND ".join(tests) or "true"


def _hits_sql(i: int, rule: R.Rule, asked: str, linear: int | None) -> str:
    """SQL for all matches of rule ``i`` on a page, by place, if ``asked``. ``linear``: its number among those in ``_linear``, where they are found already."""
    if rule.around:
        within = f"filter({_PARTS[rule.around][0]}, p -> p.match rlike {_raw('(?U)' + (rule.part or rule.pre))})"
        found = f"flatten(transform({within}, p -> transform({spans_sql('p.match', rule.java)}, s -> named_struct('start', s.start + p.start, 'end', s.end + p.start, 'match', s.match))))"
    else:
        found = spans_sql("_norm", rule.java) if linear is None else f"_linear[{linear}]"
    named = f"transform({found}, s -> named_struct('rule', {i}, 'start', s.start, 'end', s.end, 'match', s.match))"
    return f"if({asked}, {named}, cast(array() as {_FOUND}))"


def _told_sql(rules: tuple[R.Rule, ...]) -> str:
    """SQL that adds ``told`` to each of ``_hits``: category, pattern type and boost by the first anchor group with a word before it, null where the rule needs one; and ``claim``, where its claim begins."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    kind = "struct<category:string,pattern_type:string,boost:double>"

    def told(rule: R.Rule) -> str:
        as_struct = lambda category, pattern_type, boost: f"named_struct('category', {text(category)}, 'pattern_type', {text(pattern_type)}, 'boost', {boost}D)"
        groups = [(" OR ".join(f"contains(c, {text(w)})" for w in g.words), as_struct(g.category or rule.category, g.category or rule.pattern_type, R.ANCHOR_BOOST)) for g in rule.anchors]
        other = f"cast(null as {kind})" if rule.required else as_struct(rule.category, rule.pattern_type, 0.0)
        return "CASE " + " ".join(f"WHEN {words} THEN {then}" for words, then in groups) + f" ELSE {other} END" if groups else other

    n = R.ANCHOR_WINDOW
    joined = f"array_join(slice(_blocks, cast(f div {BLOCK} as int) + 1, cast(h.start div {BLOCK} - f div {BLOCK} as int) + 1), '')"
    head = f"substring({joined}, f % {BLOCK} + 1, h.start - f)"
    # Anchors have no letters but Hangul and a to z, so only texts with A to Z are worth lowering.
    low = _let_sql("t", head, "if(t rlike '[A-Z]', lower(t), t)")
    context = _let_sql("f", f"greatest(h.start - {n}, 0)", rf"regexp_replace({low}, r'(?U)\s+', '')")
    by_rule = "CASE h.rule " + " ".join(f"WHEN {i} THEN {told(r)}" for i, r in enumerate(rules)) + " END"
    banks = [str(i) for i, r in enumerate(rules) if r.category == "BankAccount"]
    named = rf"length(regexp_extract(substring(_norm, 1, h.start), r'[가-힣]*(?:{'|'.join(R.BANK_ENDINGS)})(?U:\s*)$', 0))"
    claim = f"if(h.rule IN ({', '.join(banks)}) AND t IS NOT NULL, h.start - {named}, h.start)" if banks else "h.start"
    return f"transform(_hits, h -> {_let_sql('t', _let_sql('c', context, by_rule), f'named_struct({_HIT}, {chr(39)}told{chr(39)}, t, {chr(39)}claim{chr(39)}, {claim})')})"


_HIT = ", ".join(f"'{c}', h.{c}" for c in ("rule", "start", "end", "match"))
_FOUND = "array<struct<rule:int,start:int,end:int,match:string>>"
_PARTS = {R.NUMBERS: ("_numbers", r"_norm rlike r'(?U)\d'"), R.MAILS: ("_mails", "contains(_norm, '@')")}
#: Only texts of more bytes than characters are searched for syllables.
_KOREAN = "(octet_length(_norm) > length(_norm) AND _norm rlike '[가-힣]')"


def _judged(hit: Column, rules: tuple[R.Rule, ...]) -> Column:
    """A hit of ``_told`` as a candidate; null if its rule's check or its missing anchor refuses it."""
    checks = {}
    for i, r in enumerate(rules):
        checks.setdefault(r.validate, []).append(i)
    said = reduce(lambda other, c: F.when(hit["rule"].isin(checks[c]), c(hit["match"])).otherwise(other), checks, F.lit(None))
    base = F.get(F.array(*(F.lit(r.base) for r in rules)), hit["rule"])

    def candidate(said: Column) -> Column:
        told = hit["told"]
        sure = F.round(F.least(F.lit(1.0), base + said["bonus"] + told["boost"]), 2)
        fields = [hit["rule"], told["category"], told["pattern_type"], said["status"], sure, hit["start"], hit["end"], hit["claim"], hit["end"], hit["match"]]
        return F.when(said["ok"] & told.isNotNull(), F.struct(*fields).cast(CANDIDATE))

    return let(said, candidate)


def with_candidates(df: DataFrame, rules: tuple[R.Rule, ...], source: Column | None = None) -> DataFrame:
    """Add ``_all``: candidates of all ``rules`` in ``_norm``, by rule, then place, in one pass over the page.

    First the page is searched for the few parts that hold digits or an ``@``; rules for numbers and mail then run there only,
    and each question that several rules ask of a page is answered once.
    Pages with so long a run of syllables that backtracking address rules crawl are the only ones whose address
    rules are matched in Python, in linear time; no other page passes through it. ``source``: the column that ``_norm`` was
    made of, so that such pages are told before it is made.
    """
    if not rules:
        return df.withColumn("_all", F.array().cast(f"array<{CANDIDATE}>"))
    asked = {sql: f"_asked{k}" for k, sql in enumerate(dict.fromkeys(map(_asked_sql, rules)))}
    added = {name: sql for sql, name in asked.items()}
    for around, (name, test) in _PARTS.items():
        if any(r.around == around for r in rules):
            added[name] = f"if({test}, {spans_sql('_norm', '(?U)' + around)}, cast(array() as {_SPANS}))"
    parts = _let_sql("korean", _KOREAN, "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in added.items()) + ")")
    slow = [i for i, r in enumerate(rules) if r.category == "Address"]

    def searched(df: DataFrame, linear: bool) -> DataFrame:
        df = once(df, "_parts", F.expr(parts))
        df = df.select("*", *(F.col(f"_parts.{k}").alias(k) for k in added)).drop("_parts")
        hits = ", ".join(_hits_sql(i, r, asked[_asked_sql(r)], slow.index(i) if linear and i in slow else None) for i, r in enumerate(rules))
        df = once(df, "_hits", F.expr(f"concat({hits})")).drop("_linear", *added)
        df = once(df, "_blocks", F.when(F.size("_hits") > 0, blocks(F.col("_norm"))))
        return once(df, "_told", F.expr(_told_sql(rules))).drop("_hits", "_blocks")

    if slow:
        source = F.col("_norm") if source is None else F.coalesce(source, F.lit(""))
        crawls = (F.octet_length(source) > F.length(source)) & source.rlike(f"(?U){SYLLABLE_RUN}")
        crawling = df.where(crawls).withColumn("_linear", linear_spans(F.col("_norm"), tuple(rules[i].pattern for i in slow)))
        found = searched(df.where(~crawls), False).unionByName(searched(crawling, True))
    else:
        found = searched(df, False)
    kept = F.filter(F.transform("_told", lambda h: _judged(h, rules)), lambda c: c.isNotNull())
    return once(found, "_all", kept).drop("_told")


Test = Callable[[Column, Column], Column]
Place = Callable[[Column], Column]


def _fold(found: Column, kind: str, clash: Test) -> Column:
    """What stays of candidates in the given order: those that do not clash with one that stays before them."""
    kept = F.array().cast(f"array<{kind}>")
    return F.aggregate(found, kept, lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.concat(kept, F.array(c))))


def greedy(found: Column, kind: str, low: Place, high: Place, clash: Test) -> Column:
    """:func:`_fold` in near-linear time, for candidates (``kind``) that clash only if their hulls from ``low`` to ``high`` overlap.

    Sorted by place, the candidates fall into islands that no hull joins; each is folded alone. Of hulls in order of their
    lows, the i first all end before the next begins just if the i-th smallest end does, so two sorted arrays show
    the borders, and no running maximum is carried along.
    """

    def by_islands(placed: Column) -> Column:
        def cut(ends: Column) -> Column:
            border = lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(placed, i)["low"])
            starts = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), border)
            return let(starts, lambda s: F.transform(s, lambda a, j: F.slice(placed, a + 1, F.coalesce(F.get(s, j + 1), F.size(placed)) - a)))

        in_order = lambda xs: F.sort_array(F.transform(xs, lambda x: F.struct(x["at"].alias("at"), x["c"].alias("c"))))
        stays = lambda xs: F.when(F.size(xs) == 1, in_order(xs)).otherwise(_fold(in_order(xs), f"struct<at:int,c:{kind}>", lambda k, c: clash(k["c"], c["c"])))
        left = F.flatten(F.transform(let(F.sort_array(F.transform(placed, lambda x: x["high"])), cut), stays))
        return F.transform(F.sort_array(left), lambda x: x["c"])

    placed = lambda cs: F.sort_array(F.transform(cs, lambda c, i: F.struct(low(c).cast("int").alias("low"), high(c).cast("int").alias("high"), i.alias("at"), c.alias("c"))))
    return F.when(F.size(found) < 2, found).otherwise(let(placed(found), by_islands))


def _clash(k: Column, c: Column) -> Column:
    """Does what one claims overlap what the other matched?"""
    return (k["claim_start"] < c["end"]) & (c["start"] < k["claim_end"])


def _low(c: Column) -> Column:
    return F.least(c["start"], c["claim_start"])


def _high(c: Column) -> Column:
    return F.greatest(c["end"], c["claim_end"])


def resolve(found: Column) -> Column:
    """Greedy claims in the given order: a candidate stays unless it overlaps what an earlier one claims."""
    return greedy(found, CANDIDATE, _low, _high, _clash)


def resolve_table(candidates: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Greedy claims over a table: rows of ``candidates`` (``start, end, claim_start, claim_end``) that stay on their ``page``, taken by ``order``.

    Islands are cut by a window: one begins where no candidate before it reaches. Only an island is gathered, so a page may
    have any number of candidates. Defined cases: nulls in ``order`` come last; rows that ``order`` ties are taken by their
    columns from left to right, so no result varies; rows with a null place never clash and stay; pages with null keys
    are pages; an empty table gives no rows; other columns come along.
    """
    at = Window.partitionBy(*page).orderBy("_low", "_high", *order)
    placed = candidates.withColumn("_low", F.least("start", "claim_start")).withColumn("_high", F.greatest("end", "claim_end"))
    reach = F.max("_high").over(at.rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.withColumn("_new", F.coalesce(F.col("_low") >= reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(at))
    nulls_last = [key for i, c in enumerate(order) for key in (F.isnull(c).alias(f"_null{i}"), F.col(c))]
    row = F.struct(*nulls_last, F.struct(*candidates.columns).alias("c"))
    islands = cut.groupBy(*page, "_island").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kind = islands.schema["_rows"].dataType.elementType.simpleString()
    stayed = _fold(F.col("_rows"), kind, lambda k, c: F.coalesce(_clash(k["c"], c["c"]), F.lit(False)))
    return islands.select(F.explode(stayed).alias("_r")).select("_r.c.*")
