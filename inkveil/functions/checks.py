"""Column functions that validate numbers: checksums and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the resident number's check digit.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
CHECKSUM_BONUS = 0.3


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def verdict(ok: Column | bool, status: Column | str, bonus: Column | float) -> Column:
    """What a validator says of a match: does it stay, its status, and what it adds to the confidence."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(ok).alias("ok"), lit(status).alias("status"), lit(bonus).cast("double").alias("bonus"))


def _by_checksum(ok: Column, valid: Column) -> Column:
    return verdict(ok, F.when(valid, "Valid").otherwise("Invalid"), F.when(valid, CHECKSUM_BONUS).otherwise(0.0))


def rrn_valid(text: Column) -> Column:
    """Is the last of 13 digits the check digit of the others."""
    d = digits(text)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(RRN_WEIGHTS)), F.lit(0))
    return F.coalesce((F.length(d) == 13) & ((11 - total % 11) % 10 == F.substring(d, 13, 1).try_cast("int")), F.lit(False))


def rrn(text: Column) -> Column:
    """A resident number is never rejected; a right check digit adds to its confidence."""
    return _by_checksum(F.lit(True), rrn_valid(text))


def luhn_valid(text: Column) -> Column:
    """The Luhn checksum of 12 digits or more."""
    d = digits(text)
    return (F.length(d) >= 12) & F.call_function("luhn_check", d)


def card_format(text: Column) -> Column:
    """13 to 19 digits, a first digit and length that cards have, and one kind of separator."""
    d, n = digits(text), F.length(digits(text))
    one_kind = F.size(F.array_distinct(F.split(F.regexp_replace(text, "[0-9]", ""), ""))) <= 1
    return n.between(13, 19) & d.rlike("^[234569]") & ((n != 13) | d.startswith("4")) & ((n != 15) | d.rlike("^3[47]")) & one_kind


def card(text: Column) -> Column:
    """What is no card is rejected; a right Luhn checksum adds to the confidence."""
    return _by_checksum(card_format(text), luhn_valid(text))


def format_only(text: Column) -> Column:
    return verdict(True, "Valid", 0.0)


def no_checksum(text: Column) -> Column:
    return verdict(True, "ChecksumNotApplicable", 0.0)


def not_validated(text: Column) -> Column:
    return verdict(True, "NotValidated", 0.0)


def postal_token(text: Column) -> Column:
    """Six digits with a hyphen, the first 1-7, or five without, the first two 01-63."""
    d = digits(text)
    hyphen = F.contains(text, F.lit("-"))
    return (hyphen & d.rlike("^[1-7][0-9]{5}$")) | (~hyphen & d.rlike("^(0[1-9]|[1-5][0-9]|6[0-3])[0-9]{3}$"))


def significant_number(text: Column) -> Column:
    """Three digits or more that are no postal code."""
    return (F.length(digits(text)) >= 3) & ~postal_token(text)
