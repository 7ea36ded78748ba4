"""Personal information in free text, by bootstrapped contextual extraction.

Candidates are cut from the texts by their outer form.  Seeds are few: numbers and
addresses that a cue word announces ("phone", "my address is"), and full names that
stand in the commenters' own columns.  Seeds induce lexical patterns (words to the
left, words to the right, the form); a bipartite graph of patterns and instances is
scored iteratively in Spark: patterns by the instances they hold, instances by their
patterns.  Every candidate that is no seed, of any kind, is taken only if the graph
scores it high enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm import textops as tx
from docketlens.session import discard, spill

FIELDS = ("comment_text", "attachment_text")
ROUNDS = 3
#: What the shape of a number or an address is worth as one observation, before any is scored: the counts of a large collection outweigh it.
SHAPE_PRIOR = {"email": 0.9, "address": 0.9, "phone": 0.6, "identity_number": 0.3, "name": 0.0}
#: Parts that the instances of one pattern are spread over.
SALTS = 8
#: How far the trust in a form counts without any context: of numbers and addresses, and of names by how many of their parts commenters bear.
FORM_WEIGHT, KNOWN_WEIGHT = 0.7, {"both": 0.9, "part": 0.5, "unknown": 0.3}
#: Score at which an undecided candidate of a kind is taken.
ACCEPT = {"email": 0.3, "phone": 0.3, "identity_number": 0.3, "address": 0.3, "name": 0.45}
#: A word in lower case in more than this share of all texts is an ordinary word; at most (words per text / share) words can be.
ORDINARY_SHARE = 0.0005
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_GAP = r"(?:[ \t\x0c\xa0]|\s*<br ?/?>\s*|\r?\n)"
_AT = re.compile(r"\s?(?:@|\[at\]|\(at\))\s?|\s+at\s+", re.IGNORECASE)
_LOCAL = re.compile(r"(?:<?mailto:)?[\w.+%-]*\w$", re.IGNORECASE)
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s+dot\s+)"
_DOMAIN = re.compile(rf"[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)*{_DOT}[A-Za-z]{{2,}}\b>?", re.IGNORECASE)
_SPOKEN_DOT = re.compile(r"[\w-]+(?:\s+dot\s+|\s?\[dot\]\s?|\s?\(dot\)\s?)", re.IGNORECASE)
_PHONE = re.compile(
    r"(?:\+\d{1,3}(?:[\s.-]?\(0\))?[\s.-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\s.-]?\d{2,5}){1,4}|1[-.\s]\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}|\(\d{3}\)[\s.-]?\d{3}[\s.-]\d{4}|\d{3}[-./\s]\d{3}[-.\s]\d{4}|\d{3}\s\d{3}\s\d{2}\s\d{2}|0\d(?:[\s.]\d{2}){4}|\d{10}|\d{3}[-.]\d{4})"
    r"(?:\s*(?:ext|x|extension)\.?\s*\d{1,6})?(?![\w-]|[.,/]\d)",
    re.IGNORECASE,
)
_IDENTITY = re.compile(r"(?:\d{3}[-\s.]\d{2}[-\s.]\d{4}|\d{9}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]-\d{3}-\d{3}-\d{3}|[A-Z]\d{7,8}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])(?![\w-]|[.,/]\d)")
# Kinds of streets.
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Terrace|Ter|Drive|Dr|Boulevard|Blvd|Way|Place|Pl|Circle|Cir|Parkway|Pkwy|Highway|Hwy|Square|Sq|Loop|Trail|Trl|Pike|Row|Alley|Crescent|Close|Turnpike"
_UNIT = rf"(?:,?{_GAP}+(?:Apt|Apartment|Unit|Suite|Ste|Room|Rm|Floor|Fl)\.?{_GAP}*#?\s?\w{{1,5}}|,?{_GAP}*\#\s?\w{{1,5}})?"
# A state by its two letters or by one or two words before a ZIP code.
_TOWN = rf"(?P<town>,?{_GAP}+(?-i:[A-Z][\w.]+(?:{_GAP}[A-Z][a-z]+)?,?{_GAP}+(?:[A-Z]{{2}}\b(?:{_GAP}+\d{{5}}(?:-\d{{4}})?)?|[A-Z][a-z]+(?:{_GAP}[A-Z][a-z]+)?,?{_GAP}+\d{{5}}(?:-\d{{4}})?\b)))?"
_STREET = rf"\d{{1,6}}(?:-\d{{1,4}}|[A-Z])?{_GAP}+(?:[NSEW]{{1,2}}\.?{_GAP}+)?(?:(?:[A-Z][\w'’]*|\d{{1,3}}(?:st|nd|rd|th)){_GAP}+){{1,3}}(?:{_STREETS})\b\.?"
_HOUSE = re.compile(rf"{_STREET}{_UNIT}{_TOWN}", re.IGNORECASE)
_BOX = re.compile(rf"(?<![\w$.,/#-])(?:(?:P\.?\s?O\.?|POST OFFICE){_GAP}?BOX{_GAP}+\d{{1,6}}\b|(?:RR|R\.R\.|HC|RURAL ROUTE|STAR ROUTE){_GAP}+\d{{1,3}},?{_GAP}+BOX{_GAP}+\d{{1,6}}\b){_UNIT}{_TOWN}", re.IGNORECASE)
# Streets as written in Spanish, French and German, with town and postal code.
_PLACE = r"(?P<town>,?\s+\d{4,5}\s+[^\W\d_a-z][\w-]+(?:\s[^\W\d_a-z][\w-]+)?)?"
_STREET_ES = re.compile(rf"\b(?:[Cc]alle|[Aa]venida|[Aa]vda?\.?|[Pp]laza|[Pp]aseo|[Cc]amino)\s+(?:(?:de|del|la|las|los|el)\s+){{0,3}}[^\W\d_a-z]\w+(?:\s+[^\W\d_a-z]\w+){{0,2}},?\s+(?:n[.º°]*\s*)?\d{{1,4}}\b{_PLACE}")
_STREET_FR = re.compile(rf"\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)\s+(?:(?:de|du|des|la|le|les)\s+|d['’]|l['’]){{0,3}}[^\W\d_a-z][\w’'-]+(?:\s+[^\W\d_a-z][\w-]+){{0,2}}{_PLACE}")
_STREET_DE = re.compile(rf"\b[^\W\d_a-z][^\W\d_]*(?:straße|strasse|weg|platz|allee|gasse)\s+\d{{1,4}}[a-z]?\b(?![-./]\d){_PLACE}")
_FOREIGN = ("calle", "avenida", "avda", "plaza", "paseo", "camino", "rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "allée ", "quai ", "straße", "strasse", "weg ", "platz ", "allee ", "gasse ")
_DIGIT = re.compile(r"\d")

# A letter, or the second half of a wrongly decoded one.
_L = "(?:[^\\W\\d_]|(?<=[ÃÂ√])[^\\s\\w]|[�√])"
_CAP = rf"[^\W\d_a-zß-öø-ÿ]{_L}*(?:['’-][^\W\d_]{_L}*)*"
_NAME = re.compile(
    rf"(?:(?P<title>(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Sr|Sra|Herr|Frau|Mme|Mx)\.?){_GAP}+)?(?P<one>{_CAP}\.?)(?:{_GAP}+[\"“'(](?P<nick>{_CAP})[\"”')])?(?P<mid>(?:{_GAP}+[A-Z]\.?(?![\w'’]))?)(?P<comma>,?)(?:{_GAP}+(?P<two>{_CAP}))?"
)
# A word in small letters, the word after it, and a title or an initial before it.
_SMALL = rf"[a-zß-öø-ÿ]{_L}*(?:['’-][^\W\d_]{_L}*)*"
_SMALL_WORD = re.compile(rf"(?<![\w'’.@-]){_SMALL}(?!\w)")
_SMALL_NEXT = re.compile(rf"(?P<comma>,?)(?:{_GAP}+[a-z]\.?(?![\w'’]))?{_GAP}+(?P<two>{_SMALL})(?![\w@])")
_SMALL_BEFORE = re.compile(rf"(?<![\w'’.])(?:(?P<title>mr|mrs|ms|miss|dr|prof|rev|sr|sra|herr|frau|mme|mx)\.?|(?P<initial>[a-z])\.){_GAP}+$")
# What follows the name of a law, place, street or organisation.
_NOT_PERSON = frozenset(
    "act doctrine rule bridge park street st avenue ave road rd lane ln court ct terrace drive dr boulevard blvd way place circle cir parkway pkwy highway river lake creek valley county city town falls springs junction port hill hills "
    "association council company corporation foundation federation institute international incorporated coalition department university group committee agency board bureau commission office clause table exhibit docket section "
    "hospital school college church center centre station dam canyon forest island mountain act, amendment treaty test plan v. vs cpr &".split()
)
# Words that may stand right before a name with a capital.
_OPENERS = frozenset("dear best regards sincerely respectfully thanks thank yours by from with my the neighbor chief according name is am i".split())
# Words before numbers of things other than people.
_THINGS = frozenset("order entry model lot tracking invoice part milepost docket exhibit rin serial batch item case number: table version section page report permit claim ref reference".split())
# Words that announce what follows them, the seeds of each kind.
_CUES = {
    "email": frozenset("email e mail emails address correo electrónico courriel adresse write contact".split()),
    "phone": frozenset("phone telephone tel tél call cell mobile fax voicemail text teléfono téléphone telefon handy móvil llame appelez".split()),
    "identity_number": frozenset("ssn social security passport taxpayer tin licence license driver alien registration insurance".split()),
    "address": frozenset("address live lives reside resides residing home house mail mailing vivo domicilio dirección habite adresse wohne anschrift".split()),
}


def _letters(text: str) -> list[str]:
    return tx.WORD.findall(text.lower())


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words (and the sign) before and the two after a place in the text, digits folded."""
    before = re.findall(r"[^\W\d_]+|\d+|[,:;.()\"—-]", re.sub(r"<[^<>]{0,60}>", "\n", text[max(0, start - 40) : start]).lower())[-3:]
    after = re.findall(r"[^\W\d_]+|\d+|[,:;.()\"—-]", re.sub(r"<[^<>]{0,60}>", "\n", text[end : end + 40]).lower())[:2]
    fold = lambda parts: " ".join("0" if p.isdigit() else p for p in parts)
    line_start = start == 0 or "\n" in text[max(0, start - 2) : start]
    line_end = end >= len(text) or text[end : end + 2].lstrip(" ,").startswith("\n") or text[end : end + 5] == "<br/>"
    return ("^ " if line_start else "") + fold(before), fold(after) + (" $" if line_end else "")


_RUN = re.compile(r"\d+")
#: What may not stand right before a number of a person.
_BARRED = frozenset("$.,/#-_") | frozenset("0123456789")


def _shape(text: str) -> str:
    return re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", text))


def _email_form(text: str) -> str:
    """How the two signs of an address are written, its names left out."""
    return "email " + " ".join(re.sub(r"[\w.+%-]+?(?=\s|@|\[|\(|$)", "a", text.lower()).split())


def find_numbers(text: str) -> list[tuple[str, int, int, str, float | None]]:
    """(kind, start, end, form, score) of emails, phones, identity numbers and addresses.

    The score is 1 for seeds (a cue word stands before), 0 for numbers of things, and
    None where the graph is to decide.
    """
    found: list[tuple[str, int, int, str, float | None]] = []

    def free(start: int, end: int) -> bool:
        return all(end <= s or e <= start for _, s, e, _, _ in found)

    def seed(kind: str, start: int, reach: int = 4) -> float | None:
        before = _letters(text[max(0, start - 40) : start])[-reach:]
        return 1.0 if not _CUES[kind].isdisjoint(before) else None

    low = text.lower()
    if "@" in text or "[at]" in low or "(at)" in low or " at " in low and "dot" in low:
        for at in _AT.finditer(text):
            # The bare word "at" stands in an address only before a spelled-out dot.
            if at.group().strip().lower() == "at" and not _SPOKEN_DOT.match(text, at.end()):
                continue
            domain = _DOMAIN.match(text, at.end())
            begin = at.start()
            while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-:<"):
                begin -= 1
            local = domain and _LOCAL.search(text, begin, at.start())
            if local and free(local.start(), domain.end()):
                found.append(("email", local.start(), domain.end(), _email_form(text[local.start() : domain.end()]), seed("email", local.start())))
    starts = [m.start() for m in _RUN.finditer(text)]
    if not starts:
        return found

    def street(m: re.Match, form: str) -> None:
        words = m.group().split()
        # Written in small letters a number before a common word ("3 people drive") is no street.
        if free(m.start(), m.end()) and (form != "street" or m.group().isupper() or words[1][0].isupper() or words[1][:1].isdigit() or m.group("town")):
            found.append(("address", m.start(), m.end(), f"address {form}", seed("address", m.start())))

    for at in starts:
        if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in _BARRED)) and (m := _HOUSE.match(text, at)):
            street(m, "street")
    if "box" in low:
        for m in _BOX.finditer(text):
            street(m, "box")
    for at in starts:
        begin = at
        while begin > at - 2 and begin and "A" <= text[begin - 1] <= "Z" or begin == at and begin > 1 and text[begin - 1] == "-" and "A" <= text[begin - 2] <= "Z":
            begin -= 1
        if at > 2 and text[at - 1] in " \t\n\xa0" and "A" <= text[at - 2] <= "Z" and "A" <= text[at - 3] <= "Z":
            begin = at - 3
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in _BARRED):
            continue
        m = _IDENTITY.match(text, begin)
        if m and free(m.start(), m.end()):
            before = _letters(text[max(0, begin - 45) : begin])[-4:]
            score = 0.0 if not _THINGS.isdisjoint(before[-2:]) else 1.0 if not _CUES["identity_number"].isdisjoint(before) else None
            found.append(("identity_number", m.start(), m.end(), _shape(m.group()), score))
    for at in starts:
        begin = at
        while begin and text[begin - 1] in "+(" and at - begin < 2:
            begin -= 1
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in _BARRED):
            continue
        m = _PHONE.match(text, begin)
        if m and free(m.start(), m.end()):
            before = _letters(text[max(0, begin - 25) : begin])[-2:]
            found.append(("phone", m.start(), m.end(), re.sub(r"\d+$", "0", _shape(m.group())) if "x" in m.group().lower() else _shape(m.group()), 0.0 if not _THINGS.isdisjoint(before) else seed("phone", begin, 3)))
    if any(word in low for word in _FOREIGN):
        for pattern, form in ((_STREET_ES, "calle"), (_STREET_FR, "rue"), (_STREET_DE, "straße")):
            for m in pattern.finditer(text):
                street(m, form)
    return found


_CAPITALISED = re.compile(rf"(?<!\w){_CAP}")
#: Characters a title, an initial and white space before a family name may take.
_REACH = 24


def _odd(word: str) -> bool:
    """Too few plain letters to be a name, as in garbled text."""
    return len(word) > 1 and sum(c.isascii() for c in word) < 0.6 * len(word)


def find_names(text: str, taken: list[tuple[int, int]], ordinary: frozenset[str]) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, given, family, form, what follows) of runs of capitalised words that are no ordinary words."""
    out = []
    # Only near a capitalised word that is no ordinary word can a name begin.
    telling = [m.start() for m in _CAPITALISED.finditer(text) if m.group().lower() not in ordinary]
    at = nxt = 0
    while True:
        while nxt < len(telling) and telling[nxt] < at:
            nxt += 1
        if nxt == len(telling):
            break
        at = max(at, telling[nxt] - _REACH)
        match = _NAME.search(text, at)
        if not match:
            break
        title, one, two, comma = match.group("title"), match.group("one"), match.group("two"), match.group("comma")
        start = match.start()
        low = one.rstrip(".").lower()
        at = match.end("one")
        # An ordinary word at the start is no part of a name, and a lone word is none without a title.
        if (len(low) > 1 and low in ordinary) or (not two and not title):
            continue
        if two:
            family = two.lower()
            at_two = match.end("two")
            if family in ordinary or len(family) < 3 or one.endswith(".") and len(low) > 1:
                if not title:
                    continue
                two = None
        if not two:
            if not title or len(low) < 3 or low in ordinary:
                continue
            given, family, form, end = "", low, "title", match.end("one")
        else:
            end = at_two
            if comma:
                given, family, form = two.lower(), low, "reversed"
            elif len(low) == 1:
                given, family, form = low, two.lower(), "initial"
            else:
                given, family, form = low, two.lower(), "title" if title else "full"
            if comma and "\n" in text[match.end("comma") : match.start("two")]:
                continue
            # "Regards, Given Family": the word before the comma is no family name.
            if comma and (more := re.match(rf"{_GAP}+(?:[A-Z]\.?{_GAP}+)?({_CAP})", text[end : end + 40])) and len(more.group(1)) > 2 and more.group(1).lower() not in ordinary:
                at = match.end("comma")
                continue
        if _odd(given) or _odd(family):
            continue
        if any(start < e and s < end for s, e in taken):
            continue
        follow = re.match(r"[ \t]+(\S+)", text[end : end + 30])
        word = follow.group(1).rstrip(",.;:)") if follow else ""
        before = re.search(r"([^\W\d_][\w'’]*)[ \t]+$", text[max(0, start - 25) : start])
        if not text[start:end].isupper():
            # Within a longer run of capitalised words it is a title, a body or a place.
            if _TITLE_WORD.fullmatch(word) and word.lower() not in ordinary or word == "&" or before and before.group(1)[0].isupper() and not title and before.group(1).lower() not in _OPENERS:
                word = "&"
        elif before and before.group(1).isupper() and before.group(1).lower() not in ordinary and word.isupper() and word.lower() not in ordinary:
            word = "&"
        out.append((start, end, given, family, form, word.lower()))
        at = end
    return out


_BREAK = re.compile(r"<br ?/?>")
_SMALL_TITLE = re.compile(r"(?:(?<![\w'’.])(?:mr|mrs|ms|miss|dr|prof|rev|sr|sra|herr|frau|mme|mx|[a-z]\.)\.?)$")
_SMALL_RUN = re.compile(rb"\x01[\x02\x03]?\x01|\x02\x01")


class SmallSigns(dict):
    """token -> 1 with a rare word in small letters, 2 a title or an initial, 3 a lone letter, 0 else; a bounded memo."""

    def __init__(self, ordinary: frozenset[str]):
        super().__init__()
        self.ordinary = ordinary

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        rare = any(len(w) > 2 and w.islower() and w not in self.ordinary for w in _SMALL_WORD.findall(token))
        self[token] = value = 1 if rare else 2 if _SMALL_TITLE.search(token) else 3 if len(token) == 1 and token.isalpha() else 0
        return value

    def near(self, text: str) -> bool:
        """Whether two such words, or a title and one, stand side by side; most texts end here."""
        tokens = (_BREAK.sub(" ", text) if "<br" in text else text).split()
        return _SMALL_RUN.search(bytes(map(self.__getitem__, tokens))) is not None


def find_small_names(text: str, taken: list[tuple[int, int]], ordinary: frozenset[str]) -> list[tuple[int, int, str, str, str, str]]:
    """As find_names, of runs of words in small letters that are no ordinary words."""
    out, at = [], 0
    for found in _SMALL_WORD.finditer(text):
        start, end, one = found.start(), found.end(), found.group()
        if one in ordinary or start < at or len(one) < 3 or not one.islower():
            continue
        before = _SMALL_BEFORE.search(text, max(0, start - 10), start)
        more = _SMALL_NEXT.match(text, end)
        two = more.group("two") if more else None
        if two and (two in ordinary or len(two) < 3 or not two.islower() or more.group("comma") and "\n" in more.group()):
            two = None
        if two:
            # "neighbor, given family": the word before the comma is no family name.
            if more.group("comma") and (third := _SMALL_NEXT.match(text, more.end())) and not third.group("comma") and len(third.group("two")) > 2 and third.group("two") not in ordinary:
                continue
            given, family, form, stop = (two, one, "small reversed", more.end()) if more.group("comma") else (one, two, "small full", more.end())
            shapes = [(start, stop, given, family, form)]
        else:
            shapes = []
        # The word after a title or an initial may be a family name whatever follows it.
        if before:
            shapes.append((before.start(), end, before.group("initial") or "", one, "small title" if before.group("title") else "small initial"))
        for start, stop, given, family, form in shapes:
            if _odd(given) or _odd(family) or any(start < e and s < stop for s, e in taken):
                continue
            follow = re.match(r"[ \t]+(\S+)", text[stop : stop + 30])
            out.append((start, stop, given, family, form, follow.group(1).rstrip(",.;:)").lower() if follow else ""))
            at = max(at, stop)
    return out


_CAND = pa.schema(
    [("field", pa.string()), ("comment_id", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("instance", pa.string()), ("given", pa.string()), ("family", pa.string()), ("form", pa.string()), ("lft", pa.string()), ("rgt", pa.string()), ("score", pa.float64())]
)
_CAND_SQL = "field string, comment_id string, kind string, place int, size int, instance string, given string, family string, form string, lft string, rgt string, score double"


def _candidates(ordinary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = SmallSigns(ordinary)
        for batch in batches:
            ids = batch.column("comment_id").to_pylist()
            out: tuple[list, ...] = tuple([] for _ in _CAND)
            for field in FIELDS:
                for comment_id, text in zip(ids, batch.column(field).to_pylist()):
                    if not text:
                        continue
                    found = find_numbers(text)
                    rows = [(kind, s, e, "".join(c for c in text[s:e].lower() if c.isalnum()), None, None, form, score) for kind, s, e, form, score in found]
                    names = find_names(text, taken := [(s, e) for _, s, e, _, _ in found], ordinary)
                    if signs.near(text):
                        names += find_small_names(text, taken + [(s, e) for s, e, *_ in names], ordinary)
                    for s, e, given, family, form, word in names:
                        rows.append(("name", s, e, f"{given} {family}".strip(), given, family, form, 0.0 if word in _NOT_PERSON or family in _NOT_PERSON else None))
                    for kind, s, e, instance, given, family, form, score in rows:
                        before, after = context(text, s, e)
                        for column, value in zip(out, (field, comment_id, kind, s, e - s, instance, given, family, form, before, after, score)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _CAND)], schema=_CAND)

    return run


_TITLE_WORD = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_A-Z]{2,}")

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("low", pa.int64())])
_STANDALONE = re.compile(r"(?<![\w@.+%-])[^\W\d_]+(?![\w@+%]|[.-]\w)")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, int] = {}
        for field in FIELDS:
            for text in batch.column(field).to_pylist():
                # Texts all in small letters say nothing about capitals.
                if text and any(c.isupper() for c in text):
                    for word in set(_STANDALONE.findall(text)):
                        counts[word] = counts.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([n if w[0].islower() else 0 for w, n in counts.items()], pa.int64())], schema=_WORDS)


def ordinary_words(comments: DataFrame, given: DataFrame, family: DataFrame) -> frozenset[str]:
    """Words no name is made of: in lower case in more than ORDINARY_SHARE of all texts, or common in any case and no commenter's name.

    Their number is bounded by the share.  At least five texts must hold a word.
    """
    total = comments.count()
    counts = comments.select(*FIELDS).mapInArrow(_count_words, "word string, n long, low long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    common = counts.where((F.col("low") > max(4, ORDINARY_SHARE * total)) | (F.col("n") > max(4, 2 * ORDINARY_SHARE * total)))
    marked = common.join(given.withColumnRenamed("given", "word"), "word", "left").join(family.withColumnRenamed("family", "word"), "word", "left")
    named = F.coalesce(F.col("g_n"), F.lit(0)) + F.coalesce(F.col("f_n"), F.lit(0)) >= 3
    ordinary = marked.where((F.col("low") > max(4, ORDINARY_SHARE * total)) & (~named | (F.col("low") > 0.5 * F.col("n"))) | ~named)
    return frozenset(r[0] for r in ordinary.select("word").toLocalIterator())


def known_names(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed names: (given, g_n) and (family, f_n), the commenters' own names that occur at least twice."""
    word = lambda c: F.lower(F.regexp_extract(F.trim(c), r"^([^\s\d,.|]{3,})$", 1))
    given = comments.select(word(F.col("first_name")).alias("given")).where("given <> ''").groupBy("given").agg(F.count("*").alias("g_n")).where("g_n > 1")
    family = comments.select(word(F.col("last_name")).alias("family")).where("family <> ''").groupBy("family").agg(F.count("*").alias("f_n")).where("f_n > 1")
    return given, family


def organisation_words(comments: DataFrame) -> DataFrame:
    """(word, o_n): words of the organisations commenters name, in at least two rows."""
    words = comments.where("organization is not null").select(F.explode(F.split(F.lower("organization"), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("o_n")).where("o_n > 1")


def full_names(comments: DataFrame) -> DataFrame:
    """(given, family): full names in the commenters' own columns, the seeds of names."""
    word = lambda c: F.lower(F.regexp_extract(F.trim(c), r"^([^\s\d,.|]{3,})$", 1))
    return comments.select(word(F.col("first_name")).alias("given"), word(F.col("last_name")).alias("family")).where("given <> '' and family <> ''").distinct()


def _weight(form: str = "form") -> F.Column:
    """How far trust in the form counts by itself."""
    out = F.lit(FORM_WEIGHT)
    for known, value in KNOWN_WEIGHT.items():
        out = F.when(F.col(form).endswith(f" {known}"), F.lit(value)).otherwise(out)
    return out


def scored_items(comments: DataFrame) -> DataFrame:
    """(field, comment_id, kind, place, size, route) of every item found; route is ``seed`` or ``pattern``.

    Repeats of a comment are searched as they are stored.
    """
    texts = comments.where("comment_id is not null").select("comment_id", *FIELDS)
    given, family = (spill(t, "p5-known") for t in known_names(comments))
    candidates = spill(texts.mapInArrow(_candidates(ordinary_words(comments, given, family)), _CAND_SQL), "p5-candidates")
    bodies = organisation_words(comments)
    # Names are looked up once per distinct pair of words.
    pairs = candidates.where("kind = 'name'").select("given", "family").distinct().join(given, "given", "left").join(family, "family", "left")
    pairs = pairs.join(bodies.select(F.col("word").alias("given"), F.col("o_n").alias("og")), "given", "left").join(bodies.select(F.col("word").alias("family"), F.col("o_n").alias("of")), "family", "left")
    pairs = pairs.join(full_names(comments).withColumn("own", F.lit(1)), ["given", "family"], "left")
    # Words of organisations that are no commenter's name.
    body = (F.col("og").isNotNull() & F.col("g_n").isNull()) | (F.col("of").isNotNull() & F.col("f_n").isNull())
    pairs = spill(pairs.select("given", "family", "g_n", "f_n", "own", body.alias("body")), "p5-pairs")
    named = candidates.where("kind = 'name'").join(pairs, ["given", "family"], "left")
    lone = F.col("form").endswith("initial") | F.col("form").endswith("title")
    score = F.when((F.col("score") == 0.0) | F.col("body"), 0.0).when(F.col("own").isNotNull() & ~lone, 1.0)
    # The form tells how much is known: unknown names earn trust of their own.
    both = F.when(lone, F.col("f_n").isNotNull()).otherwise(F.col("g_n").isNotNull() & F.col("f_n").isNotNull())
    known = F.when(both, "both").when((F.col("g_n").isNotNull() & ~F.col("form").endswith("initial")) | F.col("f_n").isNotNull(), "part").otherwise("unknown")
    named = named.withColumn("score", score).withColumn("form", F.concat_ws(" ", "form", known)).select(*candidates.columns)
    rows = spill(candidates.where("kind <> 'name'").unionByName(named).withColumn("row", F.monotonically_increasing_id()), "p5-rows")
    discard(candidates)
    # Patterns: the words before, the words after, and the form.  One instance counts once per pattern.
    last_two = lambda c: F.regexp_extract(c, r"(\S+ ?\S*)$", 1)
    # Rare words in small letters of which none is a known name (typos, mostly) teach nothing; only what trusted patterns precede is taken.
    unproved = F.col("form").startswith("small ") & F.col("form").endswith(" unknown")
    lefts = [F.concat(F.lit("L "), last_two(F.col("lft"))), F.concat(F.lit("LL "), F.col("lft"))]
    own_patterns = F.when(unproved, F.array(*lefts)).otherwise(F.array(*lefts, F.concat(F.lit("R "), F.col("rgt")), F.concat(F.lit("S "), F.col("form"))))
    key = F.xxhash64("kind", "pattern")
    node = F.xxhash64("kind", "instance")
    prior = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SHAPE_PRIOR.items()])
    exploded = rows.where(~unproved).select("kind", node.alias("node"), "score", _weight().alias("weight"), prior.alias("prior"), F.explode(own_patterns).alias("pattern"))
    links = spill(exploded.groupBy("node", key.alias("key")).agg(F.max("score").alias("seed"), F.max("weight").alias("weight"), F.max(F.col("pattern").startswith("S ")).alias("shape"), F.first("prior").alias("prior")), "p5-all-links")
    # A context of one instance can teach nothing.
    shared = links.groupBy("key").agg(F.count("*").alias("held"), F.max("shape").alias("shape")).where("held > 1 or shape").select("key")
    salt = lambda c: F.pmod(F.col(c), F.lit(SALTS)).cast("int").alias("salt")
    # Never broadcast: the copies are more than the planner's estimate.
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    seeds = links.groupBy("node").agg(F.max("seed").alias("seed"))
    belief = spill(seeds.select("node", "seed", F.col("seed").alias("belief")), "p5-belief")
    useful = spill(links.select("*", salt("node")).join(spread(shared), ["key", "salt"]).select("node", "key", "weight", "shape", F.when(F.col("shape"), F.col("prior")).otherwise(0.0).alias("prior"), "salt"), "p5-links")
    discard(links)
    trust = None
    for number in range(ROUNDS):
        held = useful.select("node", "key", "prior").join(belief.select("node", "belief"), "node")
        sums = held.groupBy("key").agg(F.coalesce(F.sum("belief"), F.lit(0.0)).alias("yes"), F.sum(1 - F.col("belief")).alias("no"), F.sum(F.expr("if(belief is null, 1, 0)")).alias("open"), F.max("prior").alias("prior"))
        last, trust = trust, spill(sums.select("key", ((F.col("yes") + F.col("prior")) / (F.col("yes") + F.coalesce("no", F.lit(0.0)) + 0.5 * F.col("open") + 1.0)).alias("trust")), f"p5-trust{number}")
        # Context and form together count; how far a form alone counts is its weight.
        per = useful.join(spread(trust), ["key", "salt"]).groupBy("node").agg(F.max(F.expr("if(shape, 0, trust)")).alias("context"), F.max(F.expr("if(shape, trust * weight, 0)")).alias("form"))
        before, belief = belief, spill(belief.select("node", "seed").join(per, "node", "left").select("node", "seed", F.coalesce("seed", F.expr("1 - (1 - coalesce(context, 0)) * (1 - coalesce(form, 0))")).alias("belief")), f"p5-belief{number}")
        discard(before)
        discard(last)
    discard(useful)
    # An item is judged where it stands: by its own seed score, else by the trust of its own patterns and the belief in the instance.
    own = rows.where("score is null").select("row", "kind", node.alias("node"), _weight().alias("weight"), F.explode(own_patterns).alias("pattern")).select("row", "node", "weight", key.alias("key"), F.col("pattern").startswith("S ").alias("shape"), salt("row"))
    judged = own.join(spread(trust), ["key", "salt"], "left").groupBy("row", "node").agg(F.max(F.expr("if(shape, 0, trust)")).alias("context"), F.max(F.expr("if(shape, trust * weight, 0)")).alias("form"))
    judged = judged.join(belief.select("node", "belief"), "node", "left").select("row", F.expr("greatest(1 - (1 - coalesce(context, 0)) * (1 - coalesce(form, 0)), 0.8 * coalesce(belief, 0))").alias("found"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in ACCEPT.items()])
    found = F.col("found") * F.when(F.col("form").endswith(" unknown"), 0.75).otherwise(1.0)
    final = rows.join(judged, "row", "left").where(F.coalesce(F.col("score"), found) >= limit)
    return final.select("field", "comment_id", "kind", "place", "size", F.when(F.col("score") == 1.0, "seed").otherwise("pattern").alias("route"), "form")


def personal_items(comments: DataFrame) -> DataFrame:
    """(field, comment_id, kind, place, size) of every item of personal data found."""
    return scored_items(comments).select("field", "comment_id", "kind", "place", "size")


def fields_with_items(comments: DataFrame) -> DataFrame:
    """p5: distinct (field, comment_id, kind) of fields that hold at least one item.  NULL and empty fields hold none."""
    return personal_items(comments).select("field", "comment_id", "kind").distinct()


def _redactor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
            end = len(text) + 1
            for item in sorted(items, key=lambda i: (-i["place"], -i["size"])):
                stop = item["place"] + item["size"]
                if stop <= end:
                    text = text[: item["place"]] + PLACEHOLDERS[item["kind"]] + text[stop:]
                    end = item["place"]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("comment_id"), pa.array(out, pa.string())], names=["field", "comment_id", "redacted"])


def redacted_texts(comments: DataFrame) -> DataFrame:
    """p5: (field, comment_id, redacted) of every non-NULL text, each item replaced by a placeholder naming its kind.

    Of a comment's repeats the longest text per field is used, and the least of their names.
    """
    people = F.min(F.struct("first_name", "last_name", "organization")).alias("who")
    longest = comments.where("comment_id is not null").groupBy("comment_id").agg(*[F.max_by(f, F.struct(F.length(f), F.col(f))).alias(f) for f in FIELDS], people)
    longest = spill(longest.select("comment_id", *FIELDS, "who.*"), "p5-texts")
    items = personal_items(longest)
    gathered = items.groupBy("field", "comment_id").agg(F.collect_set(F.struct("place", "size", "kind")).alias("items"))
    long_form = None
    for field in FIELDS:
        part = longest.select(F.lit(field).alias("field"), "comment_id", F.col(field).alias("text")).where("text is not null")
        long_form = part if long_form is None else long_form.unionByName(part)
    joined = long_form.join(gathered, ["field", "comment_id"], "left")
    plain = joined.where("items is null").select("field", "comment_id", F.col("text").alias("redacted"))
    return joined.where("items is not null").mapInArrow(_redactor, "field string, comment_id string, redacted string").unionByName(plain)
