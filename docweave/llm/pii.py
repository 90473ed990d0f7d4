"""Personal information in free text: found on a deobfuscated copy, replaced in the source.

Transducers rewrite the text and keep, for every character they put out, the offset of the source character it came from:

1. ``plain``: characters without width vanish, compatibility forms and look-alike letters become plain ones, decomposed syllables
   and accents are composed;
2. ``spelled``: runs of spelled digits (Korean and English) become digits;
3. ``signs``: disguises of "@" and "." such as ``[at]``, ``(골뱅이)``, ``at_`` and ``[dot]`` become the signs.

Detectors for e-mail addresses, identity numbers, telephone numbers, postal addresses and names run on the result; spans are mapped
back, so positions and replacements are those of the text as stored. Of overlapping finds the earlier type in ``TYPES`` stays.

Defined results: NULL and empty texts have no items; texts of any length are scanned whole; repeated rows are found each; a name or a
reference number of equipment, documents and parts is no item.
"""

from __future__ import annotations

import re as plain_re
import unicodedata

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.form import BLANKS, char_map
from docweave.session import once, ship, spread, table

TYPES = ("email", "id_number", "phone", "address", "person_name")

# Spelled digits.
KO_DIGITS = {"공": "0", "영": "0", "일": "1", "이": "2", "삼": "3", "사": "4", "오": "5", "육": "6", "륙": "6", "칠": "7", "팔": "8", "구": "9"}
EN_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Common Korean surnames, words of rank that follow a name, words before a name, titles.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류유홍전고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도석선설마길위표명기왕금옥인맹제탁국"
LONG_SURNAMES = "남궁|황보|제갈|선우|독고|사공|서문|동방"
RANKS = "팀장|주임|반장|기술원|대리|과장|부장|차장|사원|소장|실장|국장|처장|계장|조장|기사|기장|책임|선임|수석|연구원|주무관|사무관|교수|박사|대표|이사|상무|전무|사장|원장|센터장|관리자|감독|요원|님|씨"
BEFORE_KO = "문의|참석|참석자|서명|신청자|담당자|담당|수령인은|수령인|비상연락망|성명|이름|작성자|검토자|확인자|승인자|보고자|연락처|책임자|받는 사람|보낸 사람|예금주|신원"
BEFORE_EN = "met|[Bb]y|[Cc]ontact|Attn|Attention|Visitor|Dear|[Aa]sk for|[Cc]all|[Ss]ee|c/o|Signed|Name|Recipient|Operator|Technician|Inspector|Caller|From|To"
TITLES = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Eng|Prof|Sir|Capt|Sgt)\.?\s+)"
ACTS_KO = "떠났|말했|물었|답했|출근했|퇴근했|보고했|서명했|요청했|승인했|작성했|신청했|참석했|만났|전화했|방문했|도착했"
ACTS_EN = "[a-z]{2,}ed|said|told|wrote|found|left|took|made|met|sent|saw|went|came|gave|spoke|kept|held|drove|ran"
NO_PERSON = "The|This|That|These|Those|Each|Every|All|Any|No|Our|Your|Their|His|Her|Its|New|Old|Main|When|While|After|Before|If|And|But|Radio|Radar|Power|Control|Air|Ground|Site|Unit|System|Station|Team|Center|Centre|Office|Building|Inc|Ltd|Co|Corp|Street|Road|North|South|East|West"
LISTS = ("참석", "참석자", "명단", "작업자", "배석")
OFFICES = "팀반부과실국처소"
NOT_NAMES = "팀반부과실기계수식용품류점표"

# Words whose number is one of equipment, parts or documents; kinds of streets.
REFERENCES = r"(?:note|bin|rev|kit|S/N|serial|part|parts|lot|order|doc|ref|model|no|부품 신청|문서번호|시리얼|일련번호|부품번호|주파수|IP)\.?:?\s*"
NAME_PARTICLES = "님|씨|은|는|이|가|을|를|과|와|의|께|도|에게|께서|이며"
PARTICLES = "으로|로|번|에서|에|은|는|을|를|이며|이다|입니다|이고|인"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Row|Way|Court|Ct|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Crescent|Close|Highway|Hwy|Parkway|Alley|Walk|Quay"


@once
def single():
    """Of each code point that ``plain`` changes by itself: what it becomes, None if nothing."""
    return {ord(c): (to or None) for c, to in char_map().items() if len(to) <= 1} | {ord(c): " " for c in BLANKS if c != "\n"}


@once
def rules():
    c = re.compile
    sep = r"[-. ]"
    area = r"0(?:2|[3-6]\d|70|80|50\d?)"
    ko = "".join(KO_DIGITS)
    name_ko = rf"(?<![가-힣])(?:{LONG_SURNAMES}|[{SURNAMES}])(?: ?[가-힣]{{2,3}}?|(?: [가-힣]){{2,3}}?)"
    short_ko = rf"(?<![가-힣])(?:{LONG_SURNAMES}|[{SURNAMES}])(?: ?[가-힣]{{2}}|(?: [가-힣]){{2}})"
    rank = rf"(?:{RANKS})(?:님|께서|에게|이며|입니다|으로|이|가|은|는|을|를|과|와|의|께|도|로|에)?(?![가-힣])"
    given = r"[A-Z][a-zà-öø-ÿ]+(?:-[A-Z][a-zà-öø-ÿ]+)?"
    initial = r"[A-Z]\."
    name_en = rf"(?:{given}(?:\s{initial})*\s(?:{given}|[A-Z]{{2,}})|{initial}(?:\s?{initial})*\s(?:{given}|[A-Z]{{2,}})|[A-Z][A-Z'-]+,\s{given}(?:\s{initial})*|[A-Z]{{2,}}\s[A-Z]{{2,}})"
    any_name = rf"(?P<name>{name_ko}|{name_en})"
    phone_tail = r"(?:\s*[(+]?\d)"
    import ahocorasick

    cues = ahocorasick.Automaton()
    for w in [*RANKS.split("|"), *BEFORE_KO.split("|"), "에게", "께서", "의 지갑", "의 가방", "의 사원증", "의 휴대", "의 신분증", "의 명함", "의 차량", "의 연락처", "의 주소", "의 전화"]:
        cues.add_word(w, w)
    for w in [*LISTS, *ACTS_KO.split("|")]:
        cues.add_word(w, w)
    cues.make_automaton()
    return {
        "cues": cues,
        "numbers": plain_re.compile(r"\d{3}(?:\d{3}|[A-Za-z]\d{4}|[-. ]\d{4}|[- ]\d\d[- ]\d{4}| ?- ?\d\d ?- ?\d{4})"),
        "house": plain_re.compile(r"[로길리산동] ?\d"),
        "street": plain_re.compile(rf"\d (?:[A-Z][\w'’-]* ){{1,4}}(?:{STREETS})\b"),
        "cue_en": plain_re.compile(rf"\b(?:{BEFORE_EN}|Mr|Mrs|Ms|Miss|Dr|Eng|Prof|Sir|Capt|Sgt|Attendees|Present)\b[.:]?\s+(?=[A-Z])|\s(?:signed|wrote|called|reported|approved|requested|confirmed)\b"),
        "acts_en": plain_re.compile(rf"[A-Z][a-zà-öø-ÿ]+(?:-[A-Z][a-z]+)?\s(?:[A-Z]\.\s)?[A-Z][a-zà-öø-ÿ-]+\s(?:has\s|have\s|had\s)?(?:{ACTS_EN})\b"),
        "list_cue": plain_re.compile(r"(?:" + "|".join([*LISTS, "Attendees", "Present"]) + r")\s?:\s*"),
        "at_guard": plain_re.compile(r"[\[({<]\s*(?:at|골뱅이|앳)|at_|_at|골뱅이|\sat\s+[a-z0-9-]+(?:\.|\s+dot\s|\s*[\[(]dot)", plain_re.I),
        "dot_guard": plain_re.compile(r"[\[({<]\s*(?:dot|점|닷)|dot_|_dot|\s(?:dot|점|닷)\s", plain_re.I),
        "changed": plain_re.compile("[" + "".join(plain_re.escape(chr(x)) for x in single() if x < 0x10000) + "]"),
        "far": plain_re.compile("[\U00010000-\U0010ffff]"),
        "any": plain_re.compile("(?s)."),
        "compose": c(r"\P{M}\p{M}+|[ᄀ-ᅟ][ᅠ-ᇿ]+"),
        "ko_guard": plain_re.compile(rf"[{ko}][-. ]{{0,3}}[{ko}](?:[-. ]{{0,3}}[{ko}]){{5}}"),
        "ko_digits": c(rf"(?<![가-힣])[{ko}](?:[-. ]{{0,3}}[{ko}]){{6,}}(?:(?![가-힣])|(?={PARTICLES}))"),
        "en_guard": plain_re.compile("[" + "".join(sorted({x for w in EN_DIGITS for x in (w[0], w[0].upper())})) + "](?i:" + "|".join(w[1:] for w in EN_DIGITS) + r")[-,. ]{1,3}(?i:" + "|".join(EN_DIGITS) + r")[-,. ]"),
        "en_digits": c(r"\b(?:" + "|".join(EN_DIGITS) + r")(?:[-,. ]{1,3}(?:" + "|".join(EN_DIGITS) + r")){6,}\b", re.I),
        "at": c(r"(?<=[\w+.-])(?:\s*[\[({<]\s*(?:at|골뱅이|앳)\s*[\])}>]\s*|\s+_?at_\s+|\s+_at_?\s+|\s*골뱅이\s*|\s+at\s+(?=[a-z0-9-]+(?:(?:\.|\s+dot\s+|\s*[\[(]dot[\])]\s*)[a-z0-9-]+)*(?:\.|\s+dot\s+|\s*[\[(]dot[\])]\s*)[a-z]{2,}\b(?![\w.+-]*\s*(?:@|[\[({<]\s*(?:at|골뱅이)|at_))))(?=[A-Za-z0-9])", re.I),
        "dot": c(r"(?<=[A-Za-z0-9])(?:\s*[\[({<]\s*(?:dot|점|닷)\s*[\])}>]\s*|\s+_?dot_\s+|\s+_dot_?\s+|\s+(?:dot|점|닷)\s+(?=[a-z]{2,}))(?=[A-Za-z0-9])", re.I),
        "email": c(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9][A-Za-z0-9._+%-]*(?:@|(?<=<[^<>\n]{0,80})\s?@\s?)(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])"),
        "resident": c(r"(?<![\w.-])(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\s?-?\s?[1-8]\d{6}(?![\d-]|\.\d|[A-Za-z])"),
        "licence": c(r"(?<![\w.-])\d{2}([- ])\d{2}\1\d{6}\1\d{2}(?![\d-]|[A-Za-z])|(?<![\w.-])\d{2}\s?-\s?\d{2}\s?-\s?\d{6}\s?-\s?\d{2}(?![\d-]|[A-Za-z])"),
        "passport": c(r"(?<![A-Za-z0-9.-])[MSRODGmsrodg]\s?(?:\d{8}|\d{3}[A-Za-z]\d{4})(?![A-Za-z0-9-])"),
        "social": c(r"(?<![\w.-])\d{3}\s?([- ])\s?\d{2}\s?\1\s?\d{4}(?![\d-]|[A-Za-z])"),
        "phone": c(
            rf"(?<![\w.+-])(?:"
            rf"\+?82{sep}?(?:\(0\){sep}?)?1[016789]{sep}?\d{{3,4}}{sep}?\d{{4}}"
            rf"|\+?82{sep}?(?:\(0\){sep}?)?(?:2|[3-6]\d){sep}?\d{{3,4}}{sep}?\d{{4}}"
            rf"|(?:\(01[016789]\)|01[016789]\)?){sep}?\s?\d{{3,4}}{sep}?\d{{4}}"  # a bracket around the whole number is not the number's
            rf"|(?:\({area}\)|{area}\)?){sep}?\s?\d{{3,4}}{sep}\d{{4}}"
            rf"|(?:\+?1{sep})?(?:\([2-9]\d{{2}}\)\s?|[2-9]\d{{2}}{sep}|[2-9]\d{{2}}\)\s?)[2-9]\d{{2}}{sep}\d{{4}}"
            rf")(?![\d-]|\.\d|[A-Za-z])"
        ),
        "reference": c(rf"(?:^|(?<![A-Za-z가-힣])){REFERENCES}$", re.I),
        "address_ko": c(
            r"(?<![가-힣])(?:[가-힣]{2,}(?:특별시|광역시|특별자치시|특별자치도|도|시)\s+)?(?:[가-힣]{2,}(?:특별시|광역시|특별자치시|시|군|구)\s+){1,2}(?:[가-힣]{2,}(?:읍|면|동)\s+)?"
            r"(?:[가-힣0-9]+(?:로|길)(?:\s?\d+(?:번)?(?:길|로))?\s?\d+(?:-\d+)?(?!\d)|[가-힣]{2,}(?:리|동|가)\s+(?:산\s?)?\d+(?:-\d+)?(?:번지)?)"
            r"(?:,?\s?(?:\([가-힣A-Za-z0-9 ]+\)|\d+동|\d+층|\d+호)(?![가-힣]{2,}))*"
        ),
        "address_en": c(rf"(?<![\w.-])\d{{1,5}}\s(?:[A-Z][\w'’-]*\s){{1,4}}(?:{STREETS})\b\.?(?:,?\s(?:Unit|Apt|Apartment|Suite|Ste|Floor|Fl|Room|Rm)\.?\s?#?\w+)?(?:,\s[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*)*(?:,\s[A-Z]{{2}})?\s\d{{4,6}}(?:-\d{{4}})?)?"),
        "title": c(rf"(?<![A-Za-z]){TITLES}(?P<name>{name_en})(?![A-Za-z])"),
        "before": c(
            rf"(?:(?<![가-힣])(?:{BEFORE_KO})(?:\s?:)?\s+|(?<![A-Za-z])(?:{BEFORE_EN})(?:\s?:)?\s+)(?:{TITLES})?(?P<name>{name_en}(?![A-Za-z])"
            rf"|{name_ko}(?=\s*(?:[,.;|/()\n]|$|{phone_tail}|\s?{rank})|(?<=:\s+{name_ko})\s))"
        ),
        "after_ko": c(rf"{any_name}(?=\s?{rank}|에게서?(?![가-힣])|께서?(?![가-힣])|의 (?:지갑|가방|사원증|휴대전화|신분증|명함|차량|연락처|주소|전화))"),
        "after_en": c(rf"(?<![A-Za-z.])(?P<name>{name_en})(?=\s(?:signed|wrote|called|reported|approved|requested|confirmed)\b|,\sID\b)"),
        "subject": c(
            rf"(?<![A-Za-z.'’-]|(?:[Tt]he|[Aa]n?|[Ff]rom|of|in|at) )(?!(?:{NO_PERSON})\b)(?P<name>{given}(?:\s{initial})?\s(?!(?:{NO_PERSON})\b){given})(?=\s(?:has\s|have\s|had\s)?(?:{ACTS_EN})\b)"
            rf"|(?<![가-힣])(?P<name>(?:{LONG_SURNAMES}|[{SURNAMES}])[가-힣]{{2}})(?=(?:은|는|이|가|께서)\s(?:[가-힣]+\s){{0,3}}[가-힣]*(?:{ACTS_KO}))"
        ),
        "joined": c(rf"(?<![A-Za-z.])(?P<name>{name_en})\s+and\s+(?:{TITLES})?(?P<other>{name_en})(?=\s(?:signed|wrote|called|reported|approved|requested|confirmed|met)\b)"),
        "list": c(r"(?:참석|참석자|명단|작업자|배석|Attendees|Present)\s?:\s*(?P<list>[^\n:]+?)(?=\n|$|(?<=[가-힣]{2})\.|(?<=[a-z]{2})(?<!Eng|Mrs|Miss|Prof|Sir|Capt|Sgt|Mr|Ms|Dr)\.|\s안건)"),
        "name_ends": plain_re.compile(rf"(?:{NAME_PARTICLES})?(?!\w)"),
        "bullets": c(r"\s*(?:\n[ \t]*(?:[-*·•▪○]|\d{1,3}[.)])[ \t]*[^\n]+)+"),
        "marked_list": c(r"(?:참석|참석자|명단|작업자|배석|Attendees|Present)\s?:[ \t]*(?:\n[ \t]*(?:[-*·•▪○]|\d{1,3}[.)])[ \t]*[^\n]+)+"),
        "marked_name": c(rf"\n[ \t]*(?:[-*·•▪○]|\d{{1,3}}[.)])[ \t]*(?:{TITLES})?{any_name}(?=\s*(?:[,|/(.\n]|$)|\s?{rank})"),
        "list_name": c(rf"(?:{TITLES})?{any_name}(?=\s*(?:,|$|\.|\||/|와|과|및))"),
        "by_number": c(rf"(?P<name>{short_ko}|(?<=[|/,]\s?){name_ko}|{name_en})\s*(?:[,/|(:]\s?)?$"),
        "in_brackets": c(rf"^\s*\(\s*(?:{TITLES})?{any_name}\s*\)"),
    }


class Mapped:
    """A text with the source offset of each of its characters; None stands for offsets that are the places themselves."""

    def __init__(self, text: str, at: list[int] | None = None, size: int | None = None):
        self.text, self.at, self.size = text, at, len(text) if size is None else size

    def rewritten(self, pattern, to) -> Mapped:
        """Matches replaced by to(match); its characters come from the match's first on, those beyond the match from its last."""
        out, at, end = [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            i, j = m.span()
            out.append(self.text[end:i])
            at.extend(self.at[end:i] if self.at else range(end, i))
            out.append(new)
            at.extend(self.origin(min(i + k, j - 1)) for k in range(len(new)))
            end = j
        if not end:
            return self
        out.append(self.text[end:])
        at.extend(self.at[end:] if self.at else range(end, len(self.text)))
        return Mapped("".join(out), at, self.size)

    def origin(self, i: int) -> int:
        return self.at[i] if self.at else i

    def end(self, j: int) -> int:
        """Where the source of the characters before j ends: marks and characters without width belong to the one before them."""
        return (self.at[j] if j < len(self.at) else self.size) if self.at else j


def grouped(digits: str) -> str:
    """Spelled digits without signs between them, as such a number is written: the detectors know numbers by their groups."""
    for first, *sizes in ((r"[2-9]\d{9}$", 3, 3, 4), (r"1[2-9]\d{9}$", 1, 3, 3, 4), (r"02\d{7}$", 2, 3, 4), (r"02\d{8}$", 2, 4, 4), (r"0[3-6]\d{8}$", 3, 3, 4), (r"0[3-6]\d{9}$", 3, 4, 4), (r"\d{9}$", 3, 2, 4)):
        if re.match(first, digits):
            out, at = [], 0
            for n in sizes:
                out.append(digits[at : at + n])
                at += n
            return "-".join(out)
    return digits


def deobfuscated(text: str) -> Mapped:
    r = rules()
    m = Mapped(text)
    if not text.isascii():
        changed = r["any"] if r["far"].search(text) else r["changed"]
        if changed.search(text):
            plain = changed.sub(lambda x: (to if (to := single().get(ord(x.group()), x.group())) else ""), text)
            m = Mapped(plain) if len(plain) == len(text) else m.rewritten(changed, lambda x: (to if (to := single().get(ord(x.group()), x.group())) else ""))
        if not unicodedata.is_normalized("NFC", m.text):
            m = m.rewritten(r["compose"], lambda x: to if len(to := unicodedata.normalize("NFC", x.group())) <= len(x.group()) else x.group())
    elif "\t" in text or "\r" in text:
        m = Mapped(text.translate(single()))
    if r["ko_guard"].search(m.text):
        m = m.rewritten(r["ko_digits"], lambda x: grouped("".join(KO_DIGITS.get(c, c) for c in x.group())))
    if r["en_guard"].search(m.text):
        m = m.rewritten(r["en_digits"], lambda x: grouped("".join(EN_DIGITS[w.lower()] for w in re.findall(r"[A-Za-z]+", x.group()))))
    if r["at_guard"].search(m.text):
        m = m.rewritten(r["at"], lambda _: "@")
    return m.rewritten(r["dot"], lambda _: ".") if "@" in m.text and r["dot_guard"].search(m.text) else m


def windows(text: str) -> list[tuple[int, int]]:
    """The stretches that can hold an item, merged and in order: around signs, long numbers, house numbers and words that go with names."""
    r, out = rules(), []
    spots = [(m.start() - 70, m.end() + 60) for m in r["numbers"].finditer(text)]
    spots += [(m.start() - 70, m.end() + 70) for m in r["house"].finditer(text)]
    spots += [(m.start() - 12, m.end() + 100) for m in r["street"].finditer(text)]
    spots += [(m.start() - 60, m.end() + 60) for m in r["cue_en"].finditer(text)]
    spots += [(m.start() - 6, m.end() + 6) for m in r["acts_en"].finditer(text)]
    for m in r["list_cue"].finditer(text):  # a list goes on to the end of its line, or of the marked lines below
        bullets = r["bullets"].match(text, m.end() - 1)
        end = bullets.end() if bullets else text.find("\n", m.end())
        spots.append((m.start() - 60, len(text) if end < 0 else end + 1))
    for i, word in r["cues"].iter(text):
        if word == "담당" and text[i + 1 : i + 2] not in (":", " ") or word == "에게" and text[i - 3 : i - 1] == "담당":
            continue  # a function, not a name
        spots.append((i - 45, i + (320 if word in LISTS else 60)))
    at = text.find("@")
    while at >= 0:
        spots.append((at - 80, at + 80))
        at = text.find("@", at + 1)
    for i, j in sorted(spots):
        i = max(0, i)
        while i and not text[i - 1].isspace():
            i -= 1
        while j < len(text) and not text[j].isspace():  # nor does it end within a word
            j += 1
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, min(j, len(text))) for i, j in out]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) on a deobfuscated text, in order, none overlapping."""
    r, found = rules(), []
    taken = bytearray(len(text))

    def add(kind: str, i: int, j: int) -> bool:
        if any(taken[i:j]):
            return False
        taken[i:j] = b"\1" * (j - i)
        found.append((kind, i, j))
        return True

    def refers(i: int) -> bool:
        return bool(r["reference"].search(text, max(0, i - 16), i))

    def name(m, group="name", base=0, ends=NOT_NAMES):
        i, j = (x + base for x in m.span(group))
        s = text[i:j]
        if "\n" not in s and not ("가" <= s[0] <= "힣" and s[-1] in ends):
            add("person_name", i, j)

    areas = windows(text)

    def each(rule):
        for i, j in areas:
            yield from r[rule].finditer(text, i, j)

    if "@" in text:
        for m in each("email"):
            add("email", *m.span())
    for rule in ("resident", "licence", "passport", "social"):
        for m in each(rule):
            if rule == "passport" or not refers(m.start()):
                add("id_number", *m.span())
    for m in each("phone"):
        if not refers(m.start()):
            add("phone", *m.span())
    for rule in ("address_ko", "address_en"):
        for m in each(rule):
            add("address", *m.span())
    for rule in ("title", "before", "after_ko", "after_en", "subject"):
        for m in each(rule):
            name(m, ends=OFFICES if rule == "after_ko" else NOT_NAMES)
    for m in each("joined"):
        name(m)
        name(m, "other")
    for m in each("list"):
        for x in r["list_name"].finditer(m.group("list")):
            name(x, base=m.start("list"))
    for m in each("marked_list"):
        for x in r["marked_name"].finditer(m.group()):
            name(x, base=m.start())
    for kind, i, j in [x for x in found if x[0] in ("phone", "id_number")]:
        before = text[max(0, i - 30) : i]
        if x := r["by_number"].search(before):
            name(x, base=i - len(before))
        if x := r["in_brackets"].search(text[j : j + 40]):
            name(x, base=j)
    for known in {text[i:j] for kind, i, j in found if kind == "person_name"}:  # a name found once is a name wherever the text has it again
        i = text.find(known)
        while i >= 0:
            j = i + len(known)
            if not taken[i] and not text[i - 1 : i].isalnum() and r["name_ends"].match(text, j) and not refers(i):
                add("person_name", i, j)
            i = text.find(known, j)
    return sorted(found, key=lambda x: x[1])


def items(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the items in a text as stored, as code-point offsets."""
    if not text:
        return []
    m = deobfuscated(text)
    return [(kind, m.origin(i), m.end(j)) for kind, i, j in spans(m.text)]


def redacted(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    out, end = [], 0
    for kind, i, j in found:
        out += [text[end:i], f"[{kind.upper()}]"]
        end = j
    return "".join([*out, text[end:]]) if found else text


def find_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_type, start_pos, end_pos) of every item."""

    def each(batches):
        for batch in batches:
            rows = [(i, kind, a, b) for i, t in enumerate(batch.column(1).to_pylist()) for kind, a, b in items(t)]
            at = pa.array([x[0] for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.int32())], [key, "pii_type", "start_pos", "end_pos"])

    schema = df.select(F.col(key), F.lit("").alias("pii_type"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos")).schema
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(each, schema)


def redact(df: DataFrame, text: str) -> DataFrame:
    """df with typed placeholders in the text column; nothing else changes."""

    def each(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = pa.array([redacted(t, items(t)) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], new, *batch.columns[i + 1 :]], batch.schema.names)

    return df.mapInArrow(each, df.schema)


def p9_found(spark, sf_dir: str) -> DataFrame:
    return find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "pii_type", "start_pos")


def p9_redacted(spark, sf_dir: str) -> DataFrame:
    return redact(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


ship(__name__)
