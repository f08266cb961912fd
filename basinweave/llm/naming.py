"""Reading of person and organisation names as people type them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from basinweave.llm.canonical import deletions, edits

_TITLES = frozenset("dr prof professor mr mrs ms miss herr frau sir dipl ing phd msc bsc ma md jr sr ii iii".split())
_SPECIAL = str.maketrans({"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "ı": "i", "’": "'"})

#: Full given names with their short forms (fixed values).
_FORMS: dict[str, str] = {
    "alexander": "alex sasha xander sandro lex", "benjamin": "ben benny benji", "christina": "chris tina christy kristina", "christopher": "chris topher kit",
    "christian": "chris", "daniel": "dan danny", "david": "dave davy", "dmitri": "dima mitya dmitry dimitri", "edward": "ed eddie ted ned",
    "eleanor": "ellie nell nora ella lea", "elizabeth": "liz beth eliza lizzie betty bess lisa ellie", "francisco": "paco pancho fran curro cisco",
    "gabriela": "gabi gaby", "giuseppe": "beppe peppe peppino pino", "hiroshi": "hiro", "ines": "inez", "ingrid": "inga", "irina": "ira irena", "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn", "jonathan": "jon johnny jonny jonty", "john": "jack johnny jon", "jose": "pepe joselito", "joseph": "joe joey", "jurgen": "juergen jorg",
    "katherine": "kate kathy katie kat kathryn catherine kit", "lakshmi": "laxmi", "margaret": "maggie meg peggy marge greta", "matthias": "matt matze matti hias",
    "matthew": "matt matty", "michael": "mike mick mickey micha", "nicholas": "nick nicky", "nikolai": "nick kolya niko nikolay", "patricia": "pat patty trish tricia",
    "pavel": "pasha", "peter": "pete", "ramon": "moncho", "rebecca": "becky", "richard": "rick dick rich ricky", "robert": "rob bob bobby bert robbie",
    "samuel": "sam sammy", "stephen": "steve", "susan": "sue suzy susie", "susanna": "sue susie susi susan sanna", "tatiana": "tanya", "theodora": "thea dora theo teddy",
    "thomas": "tom tommy", "tomasz": "tomek tom tomas", "victoria": "vicky tori vicki", "william": "will bill billy liam willy", "andrew": "andy drew", "andre": "andy",
    "anthony": "tony", "antonio": "tony toni", "charles": "charlie chuck", "gregory": "greg", "jessica": "jess", "joshua": "josh", "ekaterina": "katya", "maria": "mary masha",
    "johannes": "hannes hans", "lukasz": "luke lukas", "marek": "mark", "zoe": "zoey", "fatima": "fati", "yusuf": "yousef joseph",
}
#: (short form, full name), the full names themselves left out.
NICKNAMES: tuple[tuple[str, str], ...] = tuple((short, full) for full, shorts in _FORMS.items() for short in shorts.split())


def fold(text: str) -> str:
    """Letters without marks, in lower case."""
    text = unicodedata.normalize("NFKD", text.translate(_SPECIAL))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()


def person_parts(name: str | None) -> tuple[str, str, str] | None:
    """(surname, given, middle initials) in folded form; given may be an initial. None for blank names.

    Commas put the surname first. Without one, the last part is the surname unless the parts are reversed, which is decided
    later, when the corpus is known.
    """
    if name is None or not name.strip():
        return None
    text = fold(name)
    text = re.sub(r"(?<=[a-z])-(?=[a-z])", "", text)
    last_first = None
    if "," in text:
        head, tail = text.split(",", 1)
        if not set(re.findall(r"[a-z]+", tail)) <= _TITLES:
            last_first = head
            text = tail
        else:
            text = head
    words = [w for w in re.findall(r"[^\W\d_]+", text) if w not in _TITLES]
    if last_first is not None:
        surname = "".join(w for w in re.findall(r"[^\W\d_]+", last_first) if w not in _TITLES)
        given = words
    elif len(words) > 1:
        surname, given = words[-1], words[:-1]
    else:
        surname, given = (words or [""])[0], []
    if not surname:
        return None
    if len(surname) == 1 and given:  # "Miller A. B."
        full = [w for w in given if len(w) > 1]
        if full:
            rest = [w for w in [*given, surname] if w != full[0]]
            surname, given = full[0], rest
    first = given[0] if given else ""
    middle = "".join(w[0] for w in given[1:])
    return surname, first, middle


def email_parts(email: str | None) -> str:
    """The part of an address before the at sign, folded; '' if there is none."""
    if not email or "@" not in email:
        return ""
    return fold(email.strip()).split("@", 1)[0]


# --- organisations ---------------------------------------------------------------------------------------------------------

_STOP = frozenset("of for the and at in de der des di du la el fur für von und".split())
#: Kinds of organisation: the words that make them, in their usual order (fixed values).
ORG_KINDS: tuple[tuple[str, ...], ...] = (
    ("technical", "university"), ("university",), ("national", "centre", "hydrological", "research"), ("institute", "atmospheric", "physics"),
    ("institute", "technology"), ("remote", "sensing", "laboratory"), ("geological", "survey"), ("river", "basin", "authority"), ("analytics",),
    ("academy", "sciences"), ("meteorological", "service"), ("space", "agency"), ("ministry", "environment"), ("college",), ("hospital",), ("foundation",),
    ("laboratory",), ("institute",), ("centre",), ("agency",), ("authority",), ("research",),
)
_WORDS = {w: w for kind in ORG_KINDS for w in kind} | {
    "center": "centre", "centro": "centre", "zentrum": "centre", "universidad": "university", "universitat": "university", "universite": "university",
    "universita": "university", "universidade": "university", "uni": "university", "univ": "university", "tech": "technical", "technische": "technical",
    "technological": "technical", "technol": "technology", "tecnologia": "technology", "technologie": "technology", "inst": "institute", "instituto": "institute",
    "institut": "institute", "lab": "laboratory", "labs": "laboratory", "ctr": "centre", "nat": "national", "natl": "national", "nacional": "national",
    "hydrol": "hydrological", "res": "research", "atmos": "atmospheric", "phys": "physics", "geol": "geological", "geo": "geological", "surv": "survey",
    "auth": "authority", "rem": "remote", "sens": "sensing", "analytix": "analytics",
}
_ENDINGS = frozenset("ltd limited inc gmbh llc corp co plc sa ag".split())
_UNIT_WORDS = frozenset("department dept chair school faculty division section group unit departamento lehrstuhl fakultat".split())
_ACRONYMS: dict[str, tuple[str, ...]] = {"u": ("university",)} | {
    "".join(w[0] for w in kind): kind for kind in ORG_KINDS if len(kind) > 1
}


def _near_words() -> dict[str, list[str]]:
    """The long words of organisations by all their forms with up to one letter left out, in the order of ``_WORDS``."""
    out: dict[str, list[str]] = {}
    for w in _WORDS:
        if len(w) >= 6:
            for form in deletions(w, 1):
                out.setdefault(form, []).append(w)
    return out


_NEAR = _near_words()


@lru_cache(maxsize=200_000)
def _org_word(w: str) -> str | None:
    """The standard form of a word of organisations, also with a typing error; None for other words."""
    if w in _WORDS:
        return _WORDS[w]
    if len(w) >= 6:
        near = {known for form in deletions(w, 1) for known in _NEAR.get(form, ()) if abs(len(known) - len(w)) <= 1 and edits(w, known, 1) <= 1}
        return next((_WORDS[known] for known in _WORDS if known in near), None) if near else None
    return None


def organisation_parts(text: str | None) -> tuple[str, str] | None:
    """(kind, place) of an affiliation as typed; None for blank ones and '-'. Departments and chairs are left out."""
    if text is None or not re.search(r"\w", text):
        return None
    parts = [p for p in re.split(r"[,;()]", re.sub(r"(?<=\w)&(?=\w)", " and ", text)) if re.search(r"\w", p)]

    def words(part: str) -> list[str]:
        part = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", ""), part)
        return [w for w in re.findall(r"[^\W_]+", fold(part)) if w not in _STOP and w not in _ENDINGS]

    kept = [p for p in parts if not _UNIT_WORDS & set(words(p))] or parts
    bag: list[str] = []
    place: list[str] = []
    for w in (w for p in kept for w in words(p)):
        if w in _ACRONYMS:
            bag += _ACRONYMS[w]
        elif standard := _org_word(w):
            bag.append(standard)
        else:
            place.append(w)
    if bag == ["technical", "technical"]:
        bag = ["technical"]
    if place and not bag and len(place) == 1 and (m := re.fullmatch(r"(\w{4,}?)(tech|analytics|lab|uni)", place[0])):
        place, bag = [m[1]], {"tech": ["institute", "technology"], "analytics": ["analytics"], "lab": ["laboratory"], "uni": ["university"]}[m[2]]
    if "institute" in bag and "technical" in bag and "university" not in bag:
        bag = ["technology" if w == "technical" else w for w in bag]  # "Inst Tech"
    have = set(bag)
    kind = next((" ".join(k) for k in ORG_KINDS if have >= set(k)), " ".join(sorted(have)))
    return kind, " ".join(sorted(place))
