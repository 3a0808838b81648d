"""Column functions on text: normalising, hashing, labels, boxes as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories and their labels, in the order of the review list.
CATEGORY_LABELS = {
    "RRN": "주민등록번호",
    "PhoneNumber": "전화번호",
    "FaxNumber": "팩스번호",
    "Passport": "여권번호",
    "Card": "신용카드",
    "BankAccount": "계좌번호",
    "Email": "이메일",
    "DateOfBirth": "생년월일",
    "Address": "주소",
    "Custom": "사용자 지정",
}

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Letters and marks that scanned texts have for digits and hyphens, and what they stand for.
_LIKE, _DIGITS = "lI|Ooㅡ", "11100-"
_TOKEN = rf"0-9{_LIKE}.\-"


def halfwidth(text: Column) -> Column:
    """Full-width ASCII and the ideographic space become half-width; the length stays."""
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike("[！-～　]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def ocr_digits(text: Column) -> Column:
    """Letters misread for digits become digits, only in runs of digits, such letters, dots and hyphens that hold a digit; the length stays."""
    run = rf"(?<![{_TOKEN}])[{_LIKE}.\-]*+[0-9][{_TOKEN}]*+"
    # One piece more between the runs than runs; the last is followed by none.
    pieces = F.zip_with(F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda gap, r: F.concat(gap, F.coalesce(F.translate(r, _LIKE, _DIGITS), F.lit(""))))
    mixed = rf"[0-9][.\-]*+[{_LIKE}]|[{_LIKE}][.\-]*+[0-9]"
    return F.when(text.rlike(mixed), F.array_join(pieces, "")).otherwise(text)


def normalized(text: Column) -> Column:
    """The text that rules see; offsets are those of the original."""
    return ocr_digits(halfwidth(text))


def compact(text: Column) -> Column:
    """Without white space and ASCII digits: the form in which names are looked up."""
    return F.regexp_replace(text, r"(?U)[\s0-9]", "")


def has_text(text: Column) -> Column:
    """``HasText`` if anything but white space is there, else ``NoText``; null has none."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), "HasText").otherwise("NoText")


def fingerprint(pages: Column) -> Column:
    """``sha256:`` and the hash of a document's page texts, each with a line feed, white space folded to single spaces."""
    joined = F.concat(F.array_join(pages, "\n", ""), F.lit("\n"))
    folded = F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), "^ | $", "")
    return F.concat(F.lit("sha256:"), F.sha2(folded.cast("binary"), 256))


def category_label(code: Column) -> Column:
    """The label of a category; an unknown one passes through."""
    pairs = F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, code), code)


def category_code(label: Column) -> Column:
    """The category of a label; an unknown one passes through."""
    pairs = F.create_map(*(F.lit(x) for code, text in CATEGORY_LABELS.items() for x in (text, code)))
    return F.coalesce(F.try_element_at(pairs, label), label)


def _plain(x: Column) -> Column:
    """A number rounded to six places, without trailing zeros."""
    fixed = F.round(x, 6).cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def box_string(x: Column, y: Column, width: Column, height: Column) -> Column:
    """``x,y,width,height``."""
    return F.concat_ws(",", *map(_plain, (x, y, width, height)))


def parse_box(text: Column) -> Column:
    """Struct of x, y, width, height, or null unless there are four numbers; a blank part is 0."""
    numbers = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p) == "", F.lit(0.0)).otherwise(F.trim(p).try_cast("double")))
    bad = (F.size(numbers) != 4) | F.exists(numbers, lambda n: n.isNull() | F.isnan(n))
    return F.when(text.isNotNull() & ~bad, F.struct(*(F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height")))))


def page_list(text: Column) -> Column:
    """Page numbers above 0 in a list parted by commas or white space; of each part the leading digits count."""
    numbers = F.transform(F.split(text, r"(?U)[,\s]+"), lambda p: F.regexp_extract(p, r"^[+-]?\d+", 0).try_cast("int"))
    return F.filter(numbers, lambda n: n > 0)


def iso_utc(ts: Column) -> Column:
    """A timestamp as the review files write it. The session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
