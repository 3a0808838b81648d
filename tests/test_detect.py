import dataclasses
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.operators.detect import detect, page_finds
from inkveil.operators.layout import detect_layout
from inkveil.operators.redact import post_check, redact_texts
from inkveil.operators.spans import linear_spans, spans
from inkveil.functions import checks
from inkveil.functions.text import ocr_digits
from inkveil.plans import catalogue
from inkveil.plans.rules import RULES, Rule

DONGS = "서빙고동 압구정동 역삼동 반포동 성복동 여의도동 용암동".split()

#: Text, then what is found in it: (category, content, confidence, validation).
CASES = [
    ("연락처 010-1234-5678 입니다", [("PhoneNumber", "010-1234-5678", 0.7, "ChecksumNotApplicable")]),
    ("010-1234-5678", [("PhoneNumber", "010-1234-5678", 0.5, "ChecksumNotApplicable")]),
    ("팩스번호 02-3133-2457 입니다", [("FaxNumber", "02-3133-2457", 0.7, "ChecksumNotApplicable")]),
    ("passport number M12345678 ref", [("Passport", "M12345678", 0.7, "Valid")]),
    ("주민등록번호 901231-1234563 확인", [("RRN", "901231-1234563", 1.0, "Valid")]),
    ("주민등록번호 901231-1234564 확인", [("RRN", "901231-1234564", 0.8, "Invalid")]),
    ("901231-1234564", [("RRN", "901231-1234564", 0.6, "Invalid")]),
    ("주민등록번호 ９０１２３１-１２３４５６３", [("RRN", "９０１２３１-１２３４５６３", 1.0, "Valid")]),
    ("이메일: hong.gildong@example.co.kr 입니다", [("Email", "hong.gildong@example.co.kr", 1.0, "Valid")]),
    ("홍길동010-1234-5678", [("PhoneNumber", "010-1234-5678", 0.5, "ChecksumNotApplicable")]),
    ("카드번호 4111-1111-1111-1111 결제", [("Card", "4111-1111-1111-1111", 0.9, "Valid")]),
    ("카드번호 4111-1111-1111-1112 결제", [("Card", "4111-1111-1111-1112", 0.6, "Invalid")]),
    ("전송: 2679-8328", [("FaxNumber", "2679-8328", 0.6, "ChecksumNotApplicable")]),
    ("전화: (65)62531033", [("PhoneNumber", "(65)62531033", 0.6, "ChecksumNotApplicable")]),
    ("국민은행 123-45-678901 입금", [("BankAccount", "국민은행 123-45-678901", 0.7, "ChecksumNotApplicable")]),
    ("계좌 123-45-678901 로 입금", [("BankAccount", "123-45-678901", 0.7, "ChecksumNotApplicable")]),
    ("정산코드 123-45-678901 참조", []),
    ("작성일 2026.08.13 결재", []),
    ("연락처 0l0-l234-5678", [("PhoneNumber", "0l0-l234-5678", 0.7, "ChecksumNotApplicable")]),
    ("IBM", []),
    ("Ollo", []),
    ("주소: 서울특별시 강남구 테헤란로 123", [("Address", "서울특별시 강남구 테헤란로 123", 0.7, "NotValidated")]),
    ("우리 회사는 테헤란로 123 에 있습니다", []),
    ("올해 경기 침체로 3년째 어렵다", []),
    ("강남구 사무동 회의", []),
    ("서초구청 총무행정동 업무", []),
    ("영등포구 여의도를", [("Address", "영등포구 여의도를", 0.45, "NotValidated")]),
    ("광주광역시 서구 60-2", [("Address", "광주광역시 서구 60-2", 0.4, "NotValidated")]),
    ("강남구 60-2", []),
    ("궁전 T 동 901호", [("Address", "궁전 T 동 901호", 0.35, "NotValidated")]),
    ("메뉴 T 3호", []),
    ("아파트 관리사무소", []),
    ("회의실 302호", []),
    ("사무처 788-2791 로 연락", [("PhoneNumber", "788-2791", 0.35, "ChecksumNotApplicable")]),
    ("4785380592391139", [("RRN", "4785380592391", 0.9, "Valid")]),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def dongs(spark):
    return spark.createDataFrame([(d,) for d in DONGS], "dong string")


def test_cases(spark, dongs):
    df = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(CASES)], "doc_id long, page_index int, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in detect(df, dongs=dongs).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.category, r.content, r.confidence, r.validation))
    assert {CASES[i][0]: g for i, g in got.items()} == {t: want for t, want in CASES}


def test_priority_exclusion_and_redaction(spark):
    df = spark.createDataFrame([(1, 0, "전화 02-2679-8201, 8327 / 전송: 2679-8328 / 2020-2264 2020-2265")], "doc_id long, page_index int, text string")
    every = [(r.id, r.category) for r in detect(df).orderBy("start").collect()]
    assert [c for _, c in every] == ["PhoneNumber", "FaxNumber", "FaxNumber", "PhoneNumber"]  # the label is over 24 characters off
    assert [(r.id, r.category) for r in detect(df, excluded=["PhoneNumber"]).collect()] == [x for x in every if x[1] == "FaxNumber"]
    red = redact_texts(page_finds(df))
    row, check = red.first(), post_check(red).first()
    assert len(row.redacted) == len(row.text) and "8327" not in row.redacted and row.redacted.startswith("전화 █")
    assert check.n_left == 0 and check.before != check.after
    assert redact_texts(page_finds(df), token=True).first().redacted.startswith("전화 [PhoneNumber] /")


def test_regex_bombs_end(spark):
    bombs = ["가" * 20_000, "서울특별시 강남구 테헤란로 1" + " " * 20_000, "시" * 5_000, "시구동 " * 3_000, "강남구 역삼동 1" + " 2동" * 20_000, "02-123-4567" + ",1234" * 20_000]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(bombs)], "doc_id long, page_index int, text string")
    assert detect(df).count() >= 1


def line(text, x0=0.0, y=0.5, step=0.01, w=0.01, h=0.02, gap_at=None, gap=0.0):
    return [(c, x0 + i * step + (gap if gap_at is not None and i >= gap_at else 0.0), y, w, h) for i, c in enumerate(text)]


def found(spark, glyphs, dongs=None):
    df = spark.createDataFrame([(1, 0, glyphs)], "doc_id long, page_index int, glyphs array<struct<ch:string,x:double,y:double,w:double,h:double>>")
    return [(r.category, r.pattern_type, r.content) for r in detect_layout(df, dongs=dongs).orderBy("id").collect()]


def test_numbers_on_a_layout(spark):
    column = [(c, 0.5, 0.1 + 0.02 * i, 0.01, 0.02) for i, c in enumerate("5533322223233")]
    assert not [x for x in found(spark, column) if x[0] == "RRN"]
    number = "901231-1234563"
    assert found(spark, line(number[:7]) + line(number[7:], y=0.55))[0][0] == "RRN"
    assert not [x for x in found(spark, line("4111 1111 1111 1111", gap_at=10, gap=0.3)) if x[0] == "Card"]


def test_address_cells(spark, dongs):
    step = dict(step=0.02, w=0.02, h=0.02)
    row = line("강남구 역삼동 123", 0.1, 0.1, **step)
    phone = line("02-123-4567", 0.1 + 0.02 * 11 + 0.3, 0.1, **step)
    building = line("한솔아파트", 0.1, 0.13, **step)
    got = found(spark, row + phone + building, dongs)
    # The text runs the phone into the lot's number, so the rule without a number finds the address; its cell is whole.
    assert ("Address", "AddressDict", "강남구 역삼동 123한솔아파트") in got
    assert any(x[0] == "PhoneNumber" for x in got)
    name = line("김문구|", 0.1, 0.1, **step) + line("강남구 역삼동 123", 0.24, 0.1, **step)
    assert [x[2] for x in found(spark, name, dongs) if x[0] == "Address"] == ["강남구 역삼동 123"]
    two = row + line("서초구 반포동 45", 0.1, 0.13, **step)
    assert [x[2] for x in found(spark, two, dongs)] == ["강남구 역삼동 123", "서초구 반포동 45"]
    code = lambda n: line(n + " 강남구 역삼동 123", 0.1, 0.1, **step)
    assert [x[2] for x in found(spark, code("135-080"), dongs) if x[0] == "Address"] == ["135-080 강남구 역삼동 123"]
    assert [x[2] for x in found(spark, code("334"), dongs) if x[0] == "Address"] == ["강남구 역삼동 123"]


def test_region_with_building_below(spark):
    step = dict(step=0.02, w=0.02, h=0.02)
    glyphs = line("경기도 성남시 분당구", 0.1, 0.1, **step) + line("02-123-4567", 0.7, 0.1, **step) + line("매화마을 동신빌라", 0.1, 0.13, **step)
    got = found(spark, glyphs)
    assert any(x[1] == "AddressRegionBuilding" and "매화마을" in x[2] for x in got)


@pytest.mark.parametrize("run", ["시 군 구 도\n" * 4, "구" * 40, "시군구" * 400])
def test_addresses_beside_a_run_of_syllables(spark, run):
    address = "서울특별시 강남구 테헤란로 123"
    text = f"주소: {address} 끝. {run} 끝. \x01 주소: {address} 끝"
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")
    got = [(r.category, r.content, text[r.start : r.end]) for r in detect(df).collect()]
    assert got == [("Address", address, address)] * 2
    assert address not in redact_texts(page_finds(df)).first().redacted


def test_linear_matches_are_javas(spark):
    rules = [r for r in RULES if r.category == "Address"]
    texts = [t for t, _ in CASES if t] + ["궁전 T\u3000동 ９０１호 \U0001f600 한솔아파트 1동\xa02호 강남구 역삼동 12-3, 101동 202호"]
    df = spark.createDataFrame([(t, "\n".join(texts)) for t in texts], "t string, every string")
    for c in ("t", "every"):
        rows = df.select(linear_spans(F.col(c), tuple(r.pattern for r in rules)).alias("a"), F.array(*(spans(F.col(c), r.java) for r in rules)).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(any(r.a) for r in rows)


@pytest.mark.parametrize("n", [105, 10_000])
def test_lists_of_any_length(spark, n):
    tails = ", ".join(f"{i % 10_000:04}" for i in range(n))
    details = " ".join(f"{i % 900 + 1}동" for i in range(n))
    texts = [(1, f"연락처 010-1234-5678, {tails}"), (2, f"전송: 2679-8328, {tails}"), (3, f"주소: 서울특별시 강남구 테헤란로 123 {details}")]
    finds = {r.doc_id: r.content for r in detect(spark.createDataFrame(texts, "doc_id long, text string").withColumn("page_index", F.lit(0))).collect()}
    assert finds == {i: t.partition(" ")[2] for i, t in texts}


def test_prefilters_see_other_digits_and_blanks(spark):
    texts = [(1, "주민등록번호 ٩٠١٢٣١-١٢٣٤٥٦٣ 확인"), (2, "계좌 123 45 678901 로 입금")]
    found = detect(spark.createDataFrame(texts, "doc_id long, text string").withColumn("page_index", F.lit(0))).collect()
    assert {(r.doc_id, r.category, r.content) for r in found} == {(1, "RRN", "٩٠١٢٣١-١٢٣٤٥٦٣"), (2, "BankAccount", "123 45 678901")}


def test_rules_of_users_match_anywhere_and_parts_lose_nothing(spark):
    own = Rule("Licence", "Licence", r"[A-Z]{3} plate's?", 0.5, checks.format_only, (), pre="plate")
    texts = [t for t, _ in CASES if t] + ["ABC plate's", "((02)123-4567) S12345678M1234567 R123A4567", "생일 90 년 1 월 2 일 (65)6253-1033,1034 ABC 12", "1\n2 901231\n1234563 D", "M1M12345678"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*texts, "\n".join(texts), " ".join(reversed(texts))])], "doc_id long, page_index int, text string")
    rules = (own, *(r for r in RULES if r.around))
    whole = tuple(dataclasses.replace(r, around=None) for r in rules)
    found = lambda rules: sorted((r.doc_id, r.f) for r in page_finds(df, rules).select("doc_id", F.col("finds").cast("string").alias("f")).collect())
    assert found(rules) == found(whole)
    assert any("Licence" in f for _, f in found(rules))


def test_digits_of_scanned_texts(spark):
    """Runs by character classes, on drawn texts; a million hyphens end at once."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123lI|Ooㅡ.-ab 가") for _ in range(rng.randrange(40))) for _ in range(2000)] + ["-" * 10**6 + "l5", "", None]

    def fixed(text):
        change = str.maketrans("lI|Ooㅡ", "11100-")
        return re.sub(r"[0-9lI|Ooㅡ.\-]+", lambda m: m[0].translate(change) if re.search("[0-9]", m[0]) else m[0], text)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", ocr_digits(F.col("text")).alias("got")).collect():
        assert r.got == (None if r.text is None else fixed(r.text))


def test_pages_without_hangul(spark):
    """A line of a building needs no syllable; a page is passed over only if no rule can match there."""
    pages = spark.createDataFrame([(1, 0, "APT 12-3"), (2, 0, "élan 12-3"), (3, 0, "")], "doc_id long, page_index int, text string")
    rules = tuple(r for r in RULES if r.pattern_type == "AddressBuildingLine")
    assert [(r.doc_id, r.content) for r in detect(pages, rules).collect()] == [(1, "APT 12-3")]


def test_copies_of_a_find_go_where_no_rule_claims_them(spark, tmp_path):
    bare = " and so on and on and on and on, "
    docs = [(1, "Er ich password=d2d270200196d60b80 der.\nFoo.\npassword=d2d270200196d60b80"), (2, f"tel 12345678{bare}12345678, 123456789"), (3, f"fax 555 1234, tel 2345551234{bare}2345551234 555 1234"), (4, "a.b@c.de, a.b@c.de"), (5, "none"), (None, "tel 12345678")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["redact_residual"](spark, str(tmp_path)).select("doc_id", "n_found", "n_left").collect()]
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(got, key=str) == sorted(con.sql(catalogue.ORACLE_SQL["redact_residual"]).fetchall(), key=str)
    pages = spark.createDataFrame([(i, 0, t) for i, t in docs if i], "doc_id long, page_index int, text string")
    for token in (False, True):
        red = redact_texts(page_finds(pages), token=token)
        assert {r.doc_id: r.n_left for r in post_check(red).collect()} == dict.fromkeys(range(1, 6), 0)
        left = {r.doc_id: r.redacted for r in red.collect()}
        assert left[2] == (f"tel [PhoneNumber]{bare}[PhoneNumber], [PhoneNumber]9" if token else f"tel {'█' * 8}{bare}{'█' * 8}, {'█' * 8}9")
        assert left[5] == "none" and "2345551234" not in left[3]
