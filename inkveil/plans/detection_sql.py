"""DuckDB SQL for detection: the rules of the catalogue as list functions, priority as a fold."""

from __future__ import annotations

from inkveil.plans.rules import RULES, Rule

def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def rrn_valid(t: str) -> str:
    d = _digits(t)
    total = " + ".join(f"{w} * CAST(substr({d}, {i + 1}, 1) AS INT)" for i, w in enumerate((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))
    return f"CASE WHEN length({d}) = 13 THEN (11 - ({total}) % 11) % 10 = CAST(substr({d}, 13, 1) AS INT) ELSE false END"


def luhn_valid(t: str) -> str:
    d = _digits(t)
    digit = f"CAST(substr(reverse({d}), k, 1) AS INT)"
    return f"(length({d}) >= 12 AND list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)"


def card_format(t: str) -> str:
    d, seps = _digits(t), f"regexp_replace({t}, '[0-9]', '', 'g')"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND regexp_matches({d}, '^[234569]') AND (length({d}) <> 13 OR {d} LIKE '4%') AND (length({d}) <> 15 OR regexp_matches({d}, '^3[47]'))"
        f" AND ({seps} = '' OR {seps} = repeat(substr({seps}, 1, 1), length({seps}))))"
    )


def _status(r: Rule, t: str) -> tuple[str, str, str]:
    """SQL for: does the match stand, its status, the bonus."""
    if r.category in ("RRN", "Card"):
        valid = rrn_valid(t) if r.category == "RRN" else luhn_valid(t)
        return "true" if r.category == "RRN" else card_format(t), f"CASE WHEN {valid} THEN 'Valid' ELSE 'Invalid' END", f"CASE WHEN {valid} THEN 0.3 ELSE 0.0 END"
    status = {"Passport": "Valid", "Email": "Valid", "DateOfBirth": "NotValidated", "Address": "NotValidated"}.get(r.category, "ChecksumNotApplicable")
    return "true", f"'{status}'", "0.0"


def normalized(t: str) -> str:
    """Full-width and misread characters as the rules see them; these tables have no full-width ones."""
    token = "[0-9lI|Ooㅡ.\\-]"
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{token}+|[^{token[1:]}+'), lambda r: CASE WHEN regexp_matches(r, '^{token}') AND regexp_matches(r, '[0-9]') THEN translate(r, 'lI|Ooㅡ', '11100-') ELSE r END), '')"


def candidates(rules: dict[int, Rule], pages: str) -> str:
    """CTEs ``p`` (pages) and ``cand`` (a row for each match that stands). ``pages``: a SELECT of doc_id, page_index, text."""
    parts = []
    for i, r in rules.items():
        pattern = r.pattern.replace("'", "''")
        ok, status, bonus = _status(r, "m")
        context = "regexp_replace(lower(substr(text, greatest(s - 24, 0) + 1, s - greatest(s - 24, 0))), '\\s+', '', 'g')"
        group = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({context}, {w!r})' for w in g.words)} THEN {k}" for k, g in enumerate(r.anchors)) + " END"
        category = "CASE g " + " ".join(f"WHEN {k} THEN '{g.category or r.category}'" for k, g in enumerate(r.anchors)) + f" ELSE '{r.category}' END"
        kind = "CASE g " + " ".join(f"WHEN {k} THEN '{g.category or r.pattern_type}'" for k, g in enumerate(r.anchors)) + f" ELSE '{r.pattern_type}' END"
        parts.append(
            f"SELECT doc_id, page_index, {i} AS rule, {category} AS category, {kind} AS pattern_type, {status} AS status,"
            f" CAST(round(least(1.0, {r.base} + {bonus} + CASE WHEN g IS NULL THEN 0.0 ELSE 0.2 END), 2) AS DOUBLE) AS confidence, s, s + length(m) AS e, substr(orig, s + 1, length(m)) AS m FROM ("
            f"SELECT *, {group} AS g FROM (SELECT doc_id, page_index, orig, text, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda k: CAST(list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS INT))) AS s"
            f" FROM (SELECT doc_id, page_index, orig, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM p) WHERE len(ms) > 0)"
            f") WHERE {ok}" + (" AND g IS NOT NULL" if r.required else "")
        )
    return f"p AS (SELECT doc_id, page_index, text AS orig, {normalized('text')} AS text FROM ({pages})), cand AS ({' UNION ALL '.join(parts)})"


def finds(rules: dict[int, Rule], pages: str) -> str:
    """CTEs up to ``found``: what stays of the candidates after the greedy fold by rule and place."""
    row = "{'rule': rule, 'category': category, 'pattern_type': pattern_type, 'status': status, 'confidence': confidence, 's': s, 'e': e, 'm': m}"
    return (
        f"{candidates(rules, pages)}, lists AS (SELECT doc_id, page_index, list([{row}] ORDER BY rule, s) AS cs FROM cand GROUP BY ALL),"
        " folded AS (SELECT doc_id, page_index, list_reduce(cs, lambda kept, c: CASE WHEN len(list_filter(kept, lambda k: k.s < c[1].e AND c[1].s < k.e)) > 0 THEN kept ELSE list_concat(kept, c) END) AS ks FROM lists),"
        " found AS (SELECT doc_id, page_index, unnest(ks, recursive := true) FROM folded)"
    )


def chosen(*kinds: str) -> dict[int, Rule]:
    """Rules by pattern type, with their places among those that need no dictionary."""
    rules = [r for r in RULES if not r.lookup]
    return {i: r for i, r in enumerate(rules) if not kinds or r.pattern_type in kinds}

