"""Problem 1: personal information inside free text.

Method: anchor expansion.  One Aho-Corasick automaton over the accent-folded text finds anchors (at-signs, schemes, digits,
openers of addresses, identifier cues, family names, person and organization cues); at each anchor, and nowhere else, a
deterministic local parser expands to the item's boundaries and validates it.  Overlaps are resolved by priority and position,
and every surviving item is replaced by a typed placeholder.

Defined results: a null text gives null text and no items; empty text stays empty; texts are processed whole; items are
counted per occurrence, so repeats count each time; repeated rows are processed alike; extra columns are untouched.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_udf
from .textforms import UPPER

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

#: Family names, folded.  They anchor a search; the parser decides.
FAMILY = set(
    "an au ba bach banh be bui cao cam chau chu chung cong cu da dam dang danh dao dau diep dinh do doan dong duong "
    "giang giap ha han hoang ho hong hua huynh khong khuat khuc kieu kim la lai lam le len leu lo loi luc luong luu ly "
    "ma mac mach mai man nghiem ngo nguy nguyen nham ninh nong on ong pham phan phi pho phung phuong quach quan quang "
    "ta tang thach thai than thieu tieu to ton tong tra tran trieu trinh truong tu tuong ung van vi vo vu vuong".split()
)

#: Words after which a person is named.
PERSON_CUES = (
    "ho ten", "ho va ten", "gioi thieu ten", "khach ten", "ten la", "ten", "cua", "goi lai cho", "nguoi bao:", "nguoi bao",
    "nguoi nhan:", "nguoi nhan", "nguoi gui:", "ke toan", "thu quy", "gap", "hoac", "xung la", "hen", "chau", "ghi", "ban cua",
    "call back", "ship to", "caller said", "said", "neighbour", "neighbor", "signed as", "signed", "spoke to", "contact", "on behalf of",
    "name is", "ong", "ba", "anh", "chi", "co", "bac", "chu", "mr", "mrs", "ms", "dear",
)
#: Words that open the name of an organization, a building or a road.
ORG_CUES = (
    "cong ty", "c.ty", "cty", "ctcp", "ngan hang", "benh vien", "phong kham", "phong mach", "trung tam", "hop tac xa", "htx", "doanh nghiep",
    "dntn", "tap doan", "truong", "truong hoc", "cua hang", "van phong", "cong an", "uy ban", "sieu thi", "nha may", "tong dai",
)
PLACE_CUES = ("duong", "pho", "d.", "chung cu", "toa nha", "toa", "phuong", "p.", "quan", "q.", "xa", "x.", "thi tran", "tt.", "ap", "thon", "xom", "khu", "ngo", "hem", "ngach", "kiet", "huyen", "tinh", "thanh pho", "tp.", "tower", "building")
#: Capitalized words that open a place as they stand; other capitalized words that fold to a cue are names.
PLACE_WORDS = ("Đường", "Phố", "Phường", "Quận", "Xã", "Ngõ", "Hẻm", "Chung", "Tòa", "Toà", "Ấp", "Thôn", "Khu", "Thị", "Trường")
#: What a person does of whom a name at the start of a phrase tells.
DOES = re.compile(r"\s+(?:called|calls|said|says|wrote|writes|asked|asks|phoned|phones|complained|complains|reported|reports|answered)\b")
ID_CUES = ("ssn", "social security", "can cuoc", "cccd", "cmnd", "cmtnd", "chung minh", "dinh danh", "ho chieu", "passport", "id number", "id card", "id no", "giay to", "xac minh so")
NOT_ID_CUES = ("tai khoan", "stk", "account", "acct", "ma so thue", "mst", "tax code", "otp", "ma otp", "code", "don", "order", "hoa don", "invoice", "van don", "parcel", "ma", "the")
ACCOUNT_CUES = ("tai khoan", "stk", "account", "ma so thue", "mst", "tax code")
#: What an address may begin with, beside a number.
ADDRESS_CUES = ("nha so", "so", "ngo", "hem", "ngach", "kiet", "k", "can ho", "phong", "can", "flat", "apartment", "apt", "unit", "room")
SCHEMES = ("mailto:", "tel:", "sms:", "callto:")
EMAIL_CUES = ("@", "[at]", "(at)", "{at}", " at ", " a cong ", " a còng ")

#: Lower-case words that end a name typed in lower case.
STOPS = set(
    "goi hoi roi va bao noi hoc ca ben theo co la tu so sdt dt thi bi o tai nho voi de khi lop sinh nha from on at and or for to got with "
    "said wanted the in by hoac mat giao nhan gui khong nhe nha lai sau truoc hen xin doi cho moi dien thoai".split()
)

#: The same with accents, and the words that cannot be a given name even right after a family name.
STOPS |= set(
    "gọi hỏi rồi và nói học cà phê có là từ sđt đt thì bị ở tại nhờ với khi lớp nhà hoặc mất nhận gửi không nhé lại sau trước hẹn xin đòi cho mời điện thoại".split()
)
HARD_STOPS = set("goi gọi hoi hỏi va và la là hoc học thì bi bị co có hen hẹn gan gần roi rồi khong không from on at and or for got said the".split())
#: Cues that may stand before any word; after them only capitalized names count.
LOOSE_CUES = frozenset("ong ba anh chi co bac chu mr mrs ms dear".split())

_SEP = r"[ ._\- ]?"
_ZERO, _D = "[0oO]", "[0-9oO]"
_PHONE = re.compile(
    rf"(?<![\w#@./+])(?:\(\+?84\)|\+84|84|{_ZERO}){_SEP}(?:\(0\){_SEP})?(?:[35789](?:{_SEP}{_D}){{8}}|2(?:{_SEP}{_D}){{9}})(?![\w@]|[-_.]\d)"
)
_ID12 = re.compile(r"(?<![\w#@./+\-])0(?:[ .\-]?\d){11}(?![\d@]|[-.]\d)")
#: Codes of provinces run from 1 to this; an identity number begins with one.
PROVINCES = 96
_ID9 = re.compile(r"(?<![\w#@./+\-])\d{3}([ .\-]?)\d{3}\1\d{3}(?![\d@/]|[-.,]\d| ?(?:d\b|dong\b|trieu\b|tr\d|vnd|k\b))")
_NORTH = re.compile(r"(?<![\w#@./+\-])(?:\+?1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-.])\d{3}[-.]\d{4}(?![\w@]|[-_.]\d)")
_SSN = re.compile(r"(?<![\w#@./+\-])\d{3}-\d\d-\d{4}(?![\w@]|[-_.]\d)")
_PASSPORT = re.compile(r"(?<![\w#@])[a-z]( ?)\d{7}(?!\w)")
_LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| cham | dot | \. )"
_DOMAIN = re.compile(rf"[a-z0-9][a-z0-9\-]*(?:{_DOT}[a-z0-9\-]+)*?{_DOT}[a-z]{{2,}}(?![a-z0-9])")

_W = r"[a-z][a-z'’]*"
_NAME1 = rf"{_W}(?: {_W}){{0,3}}"
_NO = r"\d+[a-z]?(?:[/\-]\d+[a-z]?)*"
_WARD = rf"(?:, ?(?:phuong|p\.|quan|q\.|xa|x\.|thi tran|tt\.|ap|thon|khu|tp\.) ?{_NAME1}|, {_NAME1}(?= ward\b| district\b| quarter\b))?(?: ward| district| quarter)?"
_ROAD = r"(?:duong|pho|d\.|dai lo|ql\.?|tinh lo)"
_ADDRESS = [
    re.compile(rf"(?<![^\W_])(?<![/.#]){x}")
    for x in (
        rf"(?:nha )?so {_NO},? (?:to \d+,? )?(?:ap|thon|xom|ban|khoi|khu|{_ROAD}|ngo|hem|ngach|kiet)(?: \d+)? ?{_NAME1}{_WARD}",
        rf"(?:ngo|hem|ngach|kiet) {_NO},? {_ROAD} ?{_NAME1}(?:, {_NAME1})?",
        rf"{_NO} (?:hem|ngo|ngach|kiet) {_NO} {_NAME1}{_WARD}",
        rf"k\d+(?:/\d+[a-z]?)* {_ROAD} ?{_NAME1}{_WARD}",
        rf"{_NO} {_ROAD} ?{_NAME1}{_WARD}",
        rf"{_NO} {_NAME1}, ?(?:phuong|p\.|quan|q\.|xa|x\.|thi tran|tt\.) ?{_NAME1}",
        rf"(?:can ho|phong|can|flat|apartment|apt|unit|room)\.? (?=[a-z]{{0,3}}\d)\w[\w.\-]*,? (?:(?:chung cu|toa nha|toa|khu) {_NAME1}|{_NAME1} (?:tower|building|house|court|apartments))(?:, {_NAME1} (?:street|road|lane|avenue))?{_WARD}",
        rf"{_NO} {_NAME1} (?:street|road|lane|avenue|alley)(?:, {_NAME1} (?:ward|district|quarter|town))?",
    )
]


def fold(text: str) -> str:
    """Lower case without accents, one character for each character of ``text`` (which must be NFC)."""
    out = []
    for c in text:
        if c < "\x80":
            out.append(c.lower())
        elif c in "đĐÐð":
            out.append("d")
        else:
            base = unicodedata.normalize("NFD", c)[0].lower()
            out.append(base if len(base) == 1 else c)
    return "".join(out)


_AUTOMATON: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """The anchors of all parsers, built once a process."""
    global _AUTOMATON
    if _AUTOMATON is None:
        a, said = ahocorasick.Automaton(), {}
        for kind, words in (("email", EMAIL_CUES), ("digit", "0123456789"), ("person", PERSON_CUES), ("org", ORG_CUES), ("place", PLACE_CUES), ("id", ID_CUES), ("notid", NOT_ID_CUES), ("family", FAMILY), ("address", ADDRESS_CUES), ("scheme", SCHEMES)):
            for w in words:
                said.setdefault(fold(w), set()).add(kind)
        for w, kinds in said.items():
            a.add_word(w, (len(w), tuple(sorted(kinds))))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _word(text: str, start: int, end: int) -> bool:
    return (start == 0 or not text[start - 1].isalnum()) and (end >= len(text) or not text[end].isalnum() or not text[end - 1].isalnum())


_TOKEN = re.compile(r"[^\W\d_]+", re.UNICODE)


def _email(low: str, at: int, cue: int) -> tuple[int, int] | None:
    """The address around the at-sign of length ``cue`` at ``at``; a blank may stand on either side of it."""
    left = at
    while left > 0 and low[left - 1] == " ":
        left -= 1
    start = left
    while start > 0 and low[start - 1] in _LOCAL_PART:
        start -= 1
    while start < left and low[start] in "._%+-":
        start += 1
    right = at + cue
    while right < len(low) and low[right] == " ":
        right += 1
    domain = _DOMAIN.match(low, right)
    if start == left or not domain or at - left > 1 or right - at - cue > 1:
        return None
    return start, domain.end()


def _capital(word: str) -> bool:
    return word[0].isupper()


def _organizations(text: str, low: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of organizations and places: the cue and the words after it, up to two lower-case words in a row."""
    spans: list[tuple[int, int]] = []
    for start, end in cues:
        if spans and start < spans[-1][1]:
            continue
        pos, lower, last = end, 0, end
        while m := _TOKEN.search(text, pos):
            if pos > end and text[pos : m.start()] not in (" ", "-", "\u00a0") or text[pos : m.start()].strip(" .-"):
                break
            if _capital(m[0]):
                lower, last = 0, m.end()
            else:
                lower += 1
                if lower > 1:
                    break
            pos = m.end()
        spans.append((start, last))
    return spans


def find_items(note: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The note in NFC and its items (start, end, type) in reading order, not overlapping."""
    text = unicodedata.normalize("NFC", note)
    low = fold(text)
    hits: dict[str, list[tuple[int, int]]] = {}
    for last, (n, kinds) in automaton().iter(low):
        for kind in kinds:
            hits.setdefault(kind, []).append((last - n + 1, last + 1))
    items: list[tuple[int, int, str]] = []
    taken = bytearray(len(low))  # what is part of an item

    def take(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            items.append((a, b, kind))
            taken[a:b] = b"\x01" * (b - a)

    for a, b in sorted(hits.get("email", ()), key=lambda h: (low[h[0]] != "@", h)):  # a sign before a word for it
        if m := _email(low, a, b - a):
            take(*m, "EMAIL")
    runs = [a for a, _ in hits.get("digit", ()) if a == 0 or low[a - 1] not in "0123456789"]
    if runs or "address" in hits:
        opened = [a for a, b in hits.get("address", ()) if (a == 0 or not low[a - 1].isalnum()) and (b >= len(low) or not low[b].isalpha())]
        for a, m in _parsed(_ADDRESS, low, sorted({*runs, *opened})):
            if not any(taken[m.start() : m.end()]):
                take(*_trim_address(text, m), "ADDRESS")
    if runs:
        id_cues, not_id, account = (_Cues(low, c) for c in (hits.get("id", ()), hits.get("notid", ()), [x for x in hits.get("notid", ()) if low[x[0] : x[1]] in ACCOUNT_CUES]))
        schemes = {b for _, b in hits.get("scheme", ())}
        for _, m in _parsed((_ID12,), low, runs):
            if 1 <= int(re.sub(r"\D", "", m[0])[:3]) <= PROVINCES and not_id.near(m.start(), 3) <= id_cues.near(m.start(), 24):
                take(*m.span(), "ID_NUMBER")
        for _, m in _parsed((_PHONE, _NORTH), low, sorted({a - k for a in runs for k in range(3) if a >= k and all(c in "+(o" for c in low[a - k : a])} | schemes)):
            if account.near(m.start(), 3) < 0:
                take(*m.span(), "PHONE")
        for rx in (_ID9, _SSN):
            for _, m in _parsed((rx,), low, runs):
                if (rx is _ID9 or id_cues.near(m.start(), 24) >= 0) and not_id.near(m.start(), 3) <= id_cues.near(m.start(), 24):
                    take(*m.span(), "ID_NUMBER")
        for _, m in _parsed((_PASSPORT,), low, [a - k for a in runs for k in (1, 2) if a >= k]):
            if (id_cues.near(m.start(), 12) >= 0 or not m[1] and text[m.start()].isupper()) and not_id.near(m.start(), 2) < 0:
                take(*m.span(), "ID_NUMBER")
    if "family" in hits or "person" in hits:
        cues = [(a, b) for a, b in sorted(hits.get("org", []) + hits.get("place", [])) if _word(low, a, b) and _opens_place(text, low, a, b)]
        for a, b in _organizations(text, low, cues):
            taken[a:b] = b"\x01" * (b - a)
        items += _names(text, low, hits, taken)
    return text, sorted(items)


def _parsed(parsers: tuple[re.Pattern, ...] | list[re.Pattern], low: str, anchors: list[int]) -> Iterator[tuple[int, re.Match]]:
    """What each parser reads at the anchors, in reading order, none beginning within what the same parser has read."""
    for rx in parsers:
        end = 0
        for a in anchors:
            if a >= end and (m := rx.match(low, a)):
                end = m.end()
                yield a, m


class _Cues:
    """Whole words of one kind, to be found by where they end."""

    def __init__(self, low: str, found: list[tuple[int, int]]) -> None:
        self.ends = sorted(b for a, b in found if _word(low, a, b))

    def near(self, at: int, reach: int) -> int:
        """The end of the last word that ends at most ``reach`` before ``at``, or -1."""
        k = bisect.bisect_right(self.ends, at) - 1
        return self.ends[k] if k >= 0 and at - self.ends[k] <= reach else -1


def _opens_place(text: str, low: str, a: int, b: int) -> bool:
    """Whether the cue at a..b opens an organization or a place, and isn't part of a name that folds to the same letters."""
    said, cue = text[a:b], low[a:b]
    if cue.endswith(".") or cue in ("tower", "building", "cty", "ctcp", "htx", "dntn"):
        return True
    if said[0].isupper() and (m := _BEFORE.search(text, max(0, a - 20), a)) and m[1][0].isupper():  # it goes on a capitalized run
        return False
    if " " in cue:
        return not (said[0].isupper() and said[said.index(" ") + 1].isupper()) or said.isupper()
    if cue in NUMBERED and not low[b : b + 2].strip()[:1].isdigit():
        return False
    if said[0].isupper():
        return said in PLACE_WORDS
    if not said.isascii() and said not in PLACE_SPELLINGS:
        return False
    back = a
    for _ in range(_CUED_WORDS):
        back = low.rfind(" ", 0, max(0, back - 1)) + 1
        if not back:
            break
    return not _CUED.search(low, back, a)


#: Place words as they are spelt; a word that folds to one of them but is spelt otherwise is a name.
PLACE_SPELLINGS = frozenset("đường phố phường quận xã ấp thôn xóm khu ngõ hẻm ngách kiệt huyện tỉnh tòa toà trường".split())
#: Words that open a place only before a number.
NUMBERED = frozenset(("ngo", "hem", "ngach", "kiet"))
_CUED_WORDS = 6  # the longest cue and the words that may stand behind it
_CUED = re.compile(r"(?:ho ten|ten|cua|goi lai cho|nguoi (?:nhan|bao):?|ghi|xung la|chau|gap|hen|hoac|ke toan|thu quy|to|said|as) (?:[a-z]+ ){0,3}$")


def _trim_address(text: str, m: re.Match) -> tuple[int, int]:
    """The match without lower-case words that trail the last capitalized name."""
    start, end = m.span()
    words = list(_TOKEN.finditer(text, start, end))
    if words and words[-1].end() == end and _capital(words[-1][0]):  # a name of more words than the parser asks for
        while (w := _TOKEN.match(text, end + 1)) and text[end] == " " and _capital(w[0]) and not words[-1][0].isupper():
            words.append(w)
            end = w.end()
    while len(words) > 1 and not _capital(words[-1][0]) and any(_capital(w[0]) for w in words) and fold(words[-1][0]) not in ("street", "road", "lane", "avenue", "ward", "tower", "building", "district", "quarter", "town", "alley"):
        words.pop()
    return start, (words[-1].end() if words else end)


_BEFORE = re.compile(r"(?<![^\W\d_])([^\W\d_]+) $")
_NO_PERSON = re.compile(r"\s*(?:street|road|lane|avenue|tower|building|ward|district|quarter|market|hospital|clinic|bank|jsc|co\b|ltd|hotline)")
_OPENS = re.compile(r"(?:^|[,;.:/(\n]|- |– )\s*$")


def _of_organization(low: str, cues: list[tuple[int, int]] | tuple, at: int) -> bool:
    """Whether an organization is named in the phrase before ``at``, whose name may still go on there, or a place just before it."""
    if low[low.rfind(" ", 0, at - 1) + 1 : at - 1] in PLACE_CUES:
        return True
    phrase = max((low.rfind(c, 0, at) for c in ".,;:\n"), default=-1)
    return any(phrase < a and b <= at for a, b in cues)


_TITLES = frozenset("mr mrs ms miss dr".split())
_SPELT_TITLES = frozenset("Ông Bà Anh Chị Cô Chú Bác".split())
#: Two to four capitalized words in a row.
_RUN = re.compile(rf"(?<![\w'])[{UPPER}][^\W\d_{UPPER}]+(?: [{UPPER}][^\W\d_{UPPER}]+){{1,3}}")


def _names(text: str, low: str, hits: dict[str, list[tuple[int, int]]], taken: bytearray) -> list[tuple[int, int, str]]:
    """Runs of two to five name words: after a person cue, or at the start of a phrase with a family name in it."""
    found: list[tuple[int, int, str]] = []
    starts: dict[int, bool] = {}  # position of a possible name: whether a cue stands before it
    loose: dict[int, bool] = {}  # whether only such cues stand there that may precede any word
    for a, b in hits.get("person", ()):
        if _word(low, a, b):
            c = b
            while c < len(low) and low[c] in " :":
                c += 1
            starts[c] = True
            loose[c] = loose.get(c, True) and low[a:b] in LOOSE_CUES
    for a, b in hits.get("family", ()):
        if not _word(low, a, b):
            continue
        while text[a].isupper() and (m := _BEFORE.search(text, max(0, a - 20), a)) and m[1][0].isupper():  # a family name may stand last
            a = m.start(1)
        if a not in starts and (_OPENS.search(low, max(0, a - 3), a) or text[a].isupper() and a > 1 and low[a - 1] == " " and text[a - 2].islower() and not _of_organization(low, hits.get("org", ()), a)):
            starts[a] = False
    for m in _RUN.finditer(text):  # whoever does something at the start of a phrase
        if m.start() not in starts and DOES.match(low, m.end()) and _OPENS.search(low, max(0, m.start() - 3), m.start()):
            starts[m.start()] = True
    for start in sorted(starts):
        first = _TOKEN.match(text, start)
        if not first or taken[start]:
            continue
        cued, words, pos = starts[start], [first], first.end()
        capital = _capital(first[0])
        if not capital and (fold(first[0]) not in FAMILY or loose.get(start)):
            continue
        while len(words) < (6 if capital else 4) and (m := _TOKEN.match(text, pos + 1)) and text[pos] in " \u00a0":
            if capital != _capital(m[0]) or (not capital and m[0] in (STOPS if len(words) > 1 else HARD_STOPS)):
                break
            words.append(m)
            pos = m.end()
        while words and (fold(words[0][0]) in _TITLES and len(words) < 4 or len(words) > 2 and words[0][0] in _SPELT_TITLES):
            words.pop(0)
        folded = [fold(w[0]) for w in words]
        if not 2 <= len(words) <= 5 or any(taken[words[0].start() : words[-1].end()]) or _NO_PERSON.match(low, words[-1].end()):
            continue
        known = folded[0] in FAMILY or folded[-1] in FAMILY
        after = low[words[-1].end() : words[-1].end() + 10]
        if capital and (known or cued) or not capital and folded[0] in FAMILY and (cued or re.match(r"\s*[,/] ?[+(\do]|\s+goi hoi", after)):
            a, b = words[0].start(), words[-1].end()
            found.append((a, b, "NAME"))
            taken[a:b] = b"\x01" * (b - a)
    return found


ITEMS = "struct<redacted:string,items:array<struct<pii_type:string,item_no:int,start:int,end:int>>>"


def scrub(note: str | None) -> tuple[str | None, list[tuple[str, int, int, int]]]:
    """The note with typed placeholders, and its items (type, number within the type, start, end in the NFC text)."""
    if note is None:
        return None, []
    text, items = find_items(note)
    numbers, rows, out, at = dict.fromkeys(TYPES, 0), [], [], 0
    for a, b, kind in items:
        numbers[kind] += 1
        rows.append((kind, numbers[kind], a, b))
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]]), rows


def _scrub_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for notes in batches:
        done = [scrub(n) for n in notes]
        yield pd.DataFrame({"redacted": [t for t, _ in done], "items": [[dict(zip(("pii_type", "item_no", "start", "end"), r)) for r in rows] for _, rows in done]})


def scrubbed(text: Column) -> Column:
    """A struct of the redacted text and its items."""
    return python_udf(_scrub_batches, ITEMS)(text)


def with_scrubbed(df: DataFrame, text: str, out: str = "pii") -> DataFrame:
    """``df`` and a struct column ``out``; all other columns stay as they are."""
    return df.withColumn(out, scrubbed(F.col(f"`{text}`")))
