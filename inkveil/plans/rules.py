"""The catalogue of detection rules, in order of priority."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from inkveil.functions import checks

# Words that raise a match's confidence when they stand before it.
RRN_WORDS = ("주민등록번호", "주민번호", "주민등록", "rrn")
CARD_WORDS = ("카드번호", "신용카드", "체크카드", "카드", "cardno", "cardnumber")
BIRTH_WORDS = ("생년월일", "생일")
EMAIL_WORDS = ("e-mail", "email", "이메일", "메일주소", "메일")
PHONE_WORDS = ("연락처", "전화번호", "전화", "휴대폰", "핸드폰", "c.p.", "c.p", "h.p.", "hp", "tel")
FAX_WORDS = ("팩스번호", "팩스", "fax", "전송")
PASSPORT_WORDS = ("여권번호", "여권#", "여권", "한국여권번호", "한국여권", "passportno", "passportnumber", "passportnumbers")
ACCOUNT_WORDS = ("은행", "계좌번호", "입금처", "지급처", "계좌")
ADDRESS_WORDS = ("주소", "거주", "본적", "자택", "배송", "발송")
BANK_ENDINGS = ("은행", "뱅크", "금고", "우체국", "수협", "신협", "축협")

# Confidence of an anchor, and characters before a match that are searched for one.
ANCHOR_BOOST = 0.2
ANCHOR_WINDOW = 24

# Patterns of the numbers.
RRN = r"\d{6}[-\s]?\d{7}"
CARD = r"(?:\d{4}[-.\s/]\d{4}[-.\s/]\d{4}[-.\s/]\d{1,7}|\d{13,19})"
PASSPORT = r"[MSROD](?:\d{8}|\d{3}[A-Z]\d{4})"
LOCAL, DOMAIN = r"[A-Za-z0-9._%+\-]", r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL = f"{LOCAL}+@{DOMAIN}"
AREA_CODES = "02|031|032|033|041|042|043|044|051|052|053|054|055|061|062|063|064|070|080"
#: Further last numbers of a phone number's line, as they stand in the patterns below.
TAILS = r"(?:,\s?\d{4})*"
PHONE = rf"(?:01[016789][-.\s]?\d{{3,4}}[-.\s]?\d{{4}}(?:,\s?\d{{4}})*)|(?:\(?(?:{AREA_CODES})\)?[-.\s]?\d{{3,4}}[-.\s]?\d{{4}}(?:,\s?\d{{4}})*)"
PHONE_BARE = r"(?:\(\d{1,4}\)[-.\s]?)?\d{3,4}[-.\s]?\d{4}(?:,\s?\d{4})*"
PHONE_LOCAL = r"\d{3,4}[-.]\d{4}(?:,\s?\d{4})*"
ACCOUNT = r"\d{2,6}[-\s]\d{2,6}[-\s]\d{1,6}(?:[-\s]\d{1,6})?"
_MONTH, _DAY = "(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
BIRTH = rf"(?:(?:18|19|20)\d{{2}}|\d{{2}})(?:\s*년\s*{_MONTH}\s*월\s*{_DAY}\s*일|\s*[.\-/]\s*{_MONTH}\s*[.\-/]\s*{_DAY}\s*\.?)"

# Parts of addresses. A suffix may stand up to two blanks off, as scanned texts have it.
_SIDO = r"[가-힣]{2,7}\s{0,2}(?:특별자치시|특별자치도|특별시|광역시|시|도)\s*"
_SHORT = r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|중북|중남|전북|전남|경북|경남|제주)\s*"
_GU = r"(?:[가-힣]{1,10}\s{0,2}(?:시|군|구)\s*)"
REGION = rf"(?:{_SIDO}{_GU}{{0,2}}|{_SHORT}{_GU}{{1,2}}|{_GU}{{1,2}})"
STRONG_REGION = rf"(?:{_SIDO}{_GU}{{1,2}}|{_SHORT}{_GU}{{1,2}})"
TOWN = r"(?:[가-힣]{1,10}\s{0,2}(?:읍|면)\s*)?"
ROAD = r"[가-힣A-Za-z0-9]{1,20}\s{0,2}(?:대로|로|길)\s*\d+(?:-\d+)?"
LOT = r"[가-힣]{1,10}[\s\d]{0,3}(?:읍|면|동|리)\s*\d+(?:-\d+)?(?:번지)?"
# The optional comma binds its white space, so that a long run of blanks is read once.
DETAIL = r"(?:\s*(?:,\s*)?(?:[A-Za-z0-9]{1,4}\s*(?:동|층|호|가|번지)|\d{1,3}\s*-\s*\d{1,3}))*"
DONG = r"[가-힣]{1,6}[\s\d]{0,3}(?:동|리)"
DAMAGED_DONG = r"[가-힣]{2,5}(?:를|롱|둥|등)"
BRANDS = r"자이|래미안|힐스테이트|더\s?샵|롯데캐슬|푸르지오|편한세상|SK\s?뷰|아이파크|위브"
BUILDING = rf"(?:[가-힣A-Za-z0-9]{{1,12}}\s{{0,2}}(?:마을|마를|아파트|아파트먼트|APT|빌라|빌리지|타운|단지|주공|맨션|맨숀|주택|시티|연립|빌딩|타워|T|빌)|(?:[가-힣A-Za-z0-9]{{1,12}}\s{{0,2}})?(?:{BRANDS}))"
_HOUSES = rf"(?:아파트먼트|아파트|APT|빌라|빌리지|빌딩|맨션|맨숀|주택|시티|주공|타워|타운|단지|연립|마을|{BRANDS}|빌)"
_UNIT, _BETWEEN = r"(?:[A-Za-z]?\d+\s*(?:동|호|번지|가|층)|[A-Za-z0-9]+\s*-\s*\d+)", r"[가-힣A-Za-z0-9\s.]{0,12}"
BUILDING_LINE = rf"(?:(?:[가-힣A-Za-z]{{1,10}}\s{{0,2}})?{_HOUSES}{_BETWEEN}{_UNIT}|{_UNIT}{_BETWEEN}{_HOUSES}|(?:[가-힣]\s{{0,2}}){{1,4}}T\s{{0,2}}(?:\d+\s*동(?:\s*\d+\s*호)?|동\s*\d{{2,}}\s*호|[A-Za-z0-9]+\s*-\s*\d+))"
DAMAGED_LOT = r"(?:[가-힣]{0,4}[\s\d]{0,3}동\s*)?\d{1,4}\s*-\s*\d{1,4}(?:번지)?"
LATE_BUILDING = r"(?:마을|마를|아파트|APT|빌라|빌리지|타운|단지|주공|맨션|연립|빌딩)"


# Parts of a page outside of which the rules cannot match: a number's match begins with a digit or with one of these
# characters before a digit, and goes on in characters of its class; an address of mail lies around an ``@``.
NUMBERS = r"[(MSROD]?\d[\d\s\-./,()A-Z년월일]*+"
MAILS = rf"(?<![A-Za-z0-9._%+@\-]){LOCAL}*+@[A-Za-z0-9._%+@\-]*+"


@dataclass(frozen=True)
class Anchor:
    """Words of which one before a match raises its confidence, and may change its category."""

    words: tuple[str, ...]
    category: str | None = None


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``validate`` is a column function; ``pre`` a cheap pattern without which ``pattern`` cannot match (empty: none).

    ``lookup`` names the dictionary check that a match must pass (``exact``, ``fuzzy``); ``digit_boundary``
    refuses matches within longer runs of digits. ``around``: :data:`NUMBERS` or :data:`MAILS`, if all matches lie
    within such parts of a page; ``part``: what a part must hold for a match, if that is not ``pre``. ``korean``: every match
    holds a Hangul syllable, or stands on a page with ``word``; other pages are passed over without a look at ``pre``.
    ``needs``: a second pattern like ``pre``, which the page must hold as well.
    """

    category: str
    pattern_type: str
    pattern: str
    base: float
    validate: Callable[[Column], Column]
    anchors: tuple[Anchor, ...]
    required: bool = False
    pre: str = r"\d"
    lookup: str | None = None
    digit_boundary: bool = False
    around: str | None = None
    part: str | None = None
    korean: bool = False
    word: str | None = None
    needs: str = ""

    @property
    def java(self) -> str:
        """The pattern with Unicode classes, as in the other dialects that it has to agree with.

        Java's matcher calls itself for each repeat of a group unless the repeat is possessive. Tails and
        details end a pattern, where giving repeats back cannot help, so they are made so: any number matches.
        A mail address begins where its run of characters does, or after the match before it: without that, each
        character of a long run would be tried.
        """
        if self.digit_boundary:
            return rf"(?U)(?<!\d)(?:{self.pattern})(?!\d)"
        mail = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}"
        return "(?U)" + self.pattern.replace(EMAIL, mail).replace(TAILS, TAILS + "+").replace(DETAIL, DETAIL + "+")


_FAX_OR_PHONE = (Anchor(FAX_WORDS, "FaxNumber"), Anchor(PHONE_WORDS))
_PLACE = (Anchor(ADDRESS_WORDS),)
_ADDRESS_PRE = "[시군구도]"
#: What every road, every lot and every building holds.
_ROAD_NEEDS, _LOT_NEEDS = r"[로길]\s*\d", r"[읍면동리]\s*\d"
_BUILDING_NEEDS = rf"마을|마를|아파트|APT|빌|타운|단지|주공|맨션|맨숀|주택|시티|연립|타워|T|{BRANDS}"

RULES = (
    Rule("RRN", "RRN", RRN, 0.6, checks.rrn, (Anchor(RRN_WORDS),), pre=r"\d{6}", around=NUMBERS),
    Rule("Card", "Card", CARD, 0.4, checks.card, (Anchor(CARD_WORDS),), pre=r"\d{4}", around=NUMBERS),
    Rule("Passport", "Passport", PASSPORT, 0.5, checks.format_only, (Anchor(PASSPORT_WORDS),), pre=r"[MSROD]\d{3}", around=NUMBERS),
    Rule("Email", "Email", EMAIL, 0.85, checks.format_only, (Anchor(EMAIL_WORDS),), pre="@", around=MAILS),
    Rule("PhoneNumber", "PhoneNumber", PHONE, 0.5, checks.no_checksum, _FAX_OR_PHONE, pre=r"\d{4}", around=NUMBERS),
    Rule("PhoneNumber", "PhoneNumber", PHONE_BARE, 0.4, checks.no_checksum, _FAX_OR_PHONE, required=True, pre=r"\d{4}", around=NUMBERS),
    Rule("BankAccount", "BankAccount", ACCOUNT, 0.5, checks.no_checksum, (Anchor(ACCOUNT_WORDS),), required=True, pre=r"\d{2}[-\s]\d{2}", around=NUMBERS),
    Rule("DateOfBirth", "DateOfBirth", BIRTH, 0.3, checks.not_validated, (Anchor(BIRTH_WORDS),), required=True, pre="생", around=NUMBERS, part=r"\d", korean=True),
    Rule("Address", "Address", f"{REGION}{TOWN}(?:{ROAD}|{LOT}){DETAIL}", 0.5, checks.not_validated, _PLACE, pre=_ADDRESS_PRE, korean=True, needs=rf"{_ROAD_NEEDS}|{_LOT_NEEDS}"),
    Rule("Address", "AddressDict", f"{REGION}{TOWN}{DONG}", 0.5, checks.not_validated, _PLACE, pre=_ADDRESS_PRE, korean=True, lookup="exact"),
    Rule("Address", "AddressFuzzy", f"{REGION}{TOWN}{DAMAGED_DONG}", 0.45, checks.not_validated, _PLACE, pre=_ADDRESS_PRE, korean=True, lookup="fuzzy"),
    Rule("Address", "AddressBuilding", f"{REGION}{TOWN}{BUILDING}", 0.4, checks.not_validated, _PLACE, pre=_ADDRESS_PRE, korean=True, needs=_BUILDING_NEEDS),
    Rule("Address", "Address", f"{ROAD}{DETAIL}", 0.5, checks.not_validated, _PLACE, required=True, pre="[주거본자배발]", korean=True, needs=_ROAD_NEEDS),
    Rule("Address", "Address", f"{LOT}{DETAIL}", 0.5, checks.not_validated, _PLACE, required=True, pre="[주거본자배발]", korean=True, needs=_LOT_NEEDS),
    Rule("Address", "AddressDamagedDong", f"{STRONG_REGION}{TOWN}{DAMAGED_LOT}", 0.4, checks.not_validated, _PLACE, pre=_ADDRESS_PRE, korean=True, needs=r"\d\s*-\s*\d"),
    Rule("Address", "AddressBuildingLine", BUILDING_LINE, 0.35, checks.not_validated, _PLACE, pre=r"\d", korean=True, word="APT", needs=_BUILDING_NEEDS),
    Rule("PhoneNumber", "PhoneNumberSeoulLocal", PHONE_LOCAL, 0.35, checks.no_checksum, _FAX_OR_PHONE, pre=r"\d[-.]\d", around=NUMBERS),
)
