"""What keeps a page's detection cheap, and that it loses no find."""

import random
import re
from math import nan

import pytest
from pyspark.sql import functions as F

from inkveil.operators import layout, spans
from inkveil.operators.detect import detect
from inkveil.plans.rules import RULES

PIECES = "서울특별시 강남구 읍 면 동 리 역삼 로 길 대로 마을 마를 아파트 APT 빌 빌라 T 자이 더샵 호 층 1 23 456 - 7-8 , 번지 궁전 가 주공 SK 경기도 성남시 X".split(" ") + [" ", "  ", "\n", "　"]


def page(*lines, height=0.02):
    """Lines of text (x, y, text) as one page."""
    placed = [(c, x + 0.02 * i, y) for x, y, text in lines for i, c in enumerate(text)]
    n = len(placed)
    return "".join(p[0] for p in placed), [p[1] for p in placed], [p[2] for p in placed], [0.02] * n, [height] * n


def test_lines_are_found_once_for_all_seeds_of_a_size():
    p = layout._Page(*page((0.3, 0.1, "강남구 역삼로 12"), (0.3, 0.13, "한솔아파트")))
    assert p.cell(0, 10, 2) == [*range(15)] and p.cell(0, 3, 0) == [*range(10)]
    assert len(p.known) == 1


def test_a_glyph_without_a_place_is_in_no_cell_and_ends():
    text, x, y, w, h = page((0.3, 0.1, "강남구 역삼로 12"), (0.3, 0.13, "한솔아파트"))
    got = layout._Page(text + "가나", [*x, nan, 0.3], [*y, nan, nan], [*w, 0.02, 0.02], [*h, 0.02, nan]).cell(0, 10, 2)
    assert got == [*range(15)]


def test_only_pages_with_all_letters_of_a_buildings_word_are_searched_for_late_ones(spark):
    texts = ["강남구 현대 을 강 마", "경기도 P 1 T A", "강남구 아파", "", "트 파 아"]
    rows = spark.createDataFrame(enumerate(texts), "n int, t string").select("n", layout._may_grow(F.col("t")).alias("may")).collect()
    assert {r.n for r in rows if r.may} == {0, 1, 4}


def test_every_match_holds_what_its_rule_needs():
    rng, asking, met = random.Random(1), [r for r in RULES if r.needs], set()
    for _ in range(20000):
        text = "".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randrange(2, 12)))
        for k, r in enumerate(asking):
            if found := re.search(r.pattern, text):
                assert re.search(r.needs, found.group()), (r.pattern_type, text)
                met.add(k)
    assert len(met) == len(asking) == 6


@pytest.mark.parametrize("mark", ["", spans._MARK, spans._MARK * 2])
def test_places_hold_beside_the_mark(spark, mark):
    text = f"a{mark}12{mark}b 3{mark}{mark}45"
    df = spark.createDataFrame([(text,), ("",), (None,), (mark,)], "t string")
    both = df.select("t", spans.spans(F.col("t"), r"\d+").alias("a"), F.expr(spans.spans_sql("t", r"\d+")).alias("b")).collect()
    for r in both:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", r.t or "")]
        assert [tuple(s) for s in r.a or []] == [tuple(s) for s in r.b or []] == want
    assert "regexp_replace" in spans.spans_sql("t", r"\d+")  # split by a pattern compiles it for each text


def test_anchors_hold_in_any_case(spark):
    words = ["Fax", "FAX", "fax", "팩스", "F a X", "FX"]
    pages = spark.createDataFrame([(i, 0, f"{w} 02-123-4567") for i, w in enumerate(words)], "doc_id int, page_index int, text string")
    got = {r.doc_id: r.category for r in detect(pages).collect()}
    assert got == {0: "FaxNumber", 1: "FaxNumber", 2: "FaxNumber", 3: "FaxNumber", 4: "FaxNumber", 5: "PhoneNumber"}
