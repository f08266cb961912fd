"""Quantities recorded in different units, brought to one common unit.

Two operators work on measured quantities.

``read_quantities`` reads figures with a stated unit out of attribute records (a value, its unit and the texts beside them)
and converts the largest to millimetres or seconds, exactly (fractions, no floating point). It is one pass without shuffle
but for a final maximum per entity.

``unit_shifts`` handles histories whose unit is *not* stated: the values of each source, in time order, are cut into levels
by exact penalised changepoint search on the logarithm, and shifts between neighbouring levels that match a known conversion
factor are reported with the factor that reverses them. Each history is searched as a whole: rows of a source come sorted to one
task, the search takes them one by one with a small state, and levels are given out as soon as no later row can change them.

Defined cases
    * null, blank or unreadable attributes, numbers without any unit and units of no fixed size (pixel, level) give no row;
    * of several figures of one entity the larger counts, lengths before times where an entity tells both;
    * repeated rows of an entity count once; a decimal comma is a decimal point ("0,125", "12,5"), but "1,000" is a thousand;
    * extra columns are ignored;
    * non-positive, infinite or missing values take no part in a history; a history of one value is one level.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH, TIME = "length", "time"

# Millimetres and seconds of each unit.
_DEGREE = Fraction(111_320_000)
_METRE = Fraction(1000)
_UNITS: tuple[tuple[str, str, Fraction], ...] = (
    (r"arc[- ]?degrees?|decimal degrees?|degrees?|[Dd]egs?|dd|°|º", LENGTH, _DEGREE),
    (r"arc[- ]?min(?:ute)?s?|min(?:ute)?s? of arc|′|'(?!')", LENGTH, _DEGREE / 60),
    (r"arc[- ]?sec(?:ond)?s?|sec(?:ond)?s? of arc|″|\"|''", LENGTH, _DEGREE / 3600),
    (r"nautical miles?|nmi|NM", LENGTH, Fraction(1_852_000)),
    (r"statute miles?|miles?|mi", LENGTH, Fraction(1_609_344)),
    (r"[Kk]ilomet(?:re|er)s?|[Kk][Mm]s?", LENGTH, _METRE * 1000),
    (r"[Hh]ectomet(?:re|er)s?|hm", LENGTH, _METRE * 100),
    (r"[Dd]ecamet(?:re|er)s?|dam", LENGTH, _METRE * 10),
    (r"[Dd]ecimet(?:re|er)s?|dm", LENGTH, _METRE / 10),
    (r"[Cc]entimet(?:re|er)s?|cms?", LENGTH, _METRE / 100),
    (r"[Mm]illimet(?:re|er)s?|mm", LENGTH, Fraction(1)),
    (r"[Mm]et(?:re|er)s?|mtrs?|M|m", LENGTH, _METRE),
    (r"[Ff]eet|[Ff]oot|ft", LENGTH, Fraction(3048, 10)),
    (r"[Yy]ards?|yd", LENGTH, Fraction(9144, 10)),
    (r"[Ii]nch(?:es)?", LENGTH, Fraction(254, 10)),
    (r"[Ss]ec(?:ond)?s?|s", TIME, Fraction(1)),
    (r"[Mm]in(?:ute)?s?", TIME, Fraction(60)),
    (r"[Hh]ours?|hrs?|h", TIME, Fraction(3600)),
    (r"[Dd]ays?|DAYS?|d", TIME, Fraction(86_400)),
    (r"[Ww]eeks?|wks?", TIME, Fraction(7 * 86_400)),
    (r"[Mm]onths?|mons?|mo", TIME, Fraction(30 * 86_400)),
    (r"[Yy]ears?|yrs?|a", TIME, Fraction(365 * 86_400)),
    (r"[Dd]ecades?", TIME, Fraction(3650 * 86_400)),
)
_ADVERBS = {
    "hourly": 3600, "daily": 86_400, "weekly": 7 * 86_400, "fortnightly": 14 * 86_400, "monthly": 30 * 86_400,
    "quarterly": 90 * 86_400, "yearly": 365 * 86_400, "annual": 365 * 86_400, "annually": 365 * 86_400,
}
_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "sixteen": 16, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90,
    "hundred": 100, "thousand": 1000, "half": Fraction(1, 2), "quarter": Fraction(1, 4), "third": Fraction(1, 3),
    "tenth": Fraction(1, 10), "hundredth": Fraction(1, 100), "twelfth": Fraction(1, 12), "fifth": Fraction(1, 5),
}

_UNIT = "|".join(f"(?P<u{i}>{p})" for i, (p, _, _) in enumerate(_UNITS))
# "m." and "min." may end with a point; letters, digits and powers may not follow, nor may the name of a rate ("m/s").
_UNIT_RE = re.compile(rf"(?:{_UNIT})(?![\w²³^])(?!\s*/\s*[a-zA-Z])")
_WORD = "|".join(sorted(_WORDS, key=len, reverse=True))
# "1,000" has a separator of thousands; "0,125" and "12,5" have a decimal comma.
_NUMBER = r"(?:[1-9]\d{0,2}(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)(?:[eE][-+]?\d+)?"
_THOUSANDS_RE = re.compile(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?(?:[eE].*)?")
_NUMBER_RE = re.compile(
    rf"(?<![\w.,^])(?:(?P<frac>{_NUMBER}\s*/\s*\d+)|(?P<num>{_NUMBER})(?:\^(?P<pow>\d+))?"
    rf"|(?P<words>(?:(?:an?\s+)?(?:{_WORD})(?:[- ]+|\b))(?:(?:{_WORD})s?(?:[- ]+|\b))*)(?:of\s+an?\s+|an?\s+)?)",
    re.I,
)
_MULT_RE = re.compile(r"\s*(?:(thousand|hundred)\s+)?", re.I)
_JOIN_RE = re.compile(r"\s*(?:x|×|by|to|and|or|-|–|—|\.\.+|/|~)\s*", re.I)
_ISO_RE = re.compile(r"\bP(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?(?![\w])")
_ISO = (365 * 86_400, 30 * 86_400, 7 * 86_400, 86_400, 3600, 60, 1)
_ADVERB_RE = re.compile(rf"\b(?:({_NUMBER}|{_WORD}|bi|semi|twice|once|every other)[- ]*)?({'|'.join(_ADVERBS)})\b", re.I)
_TIMES_RE = re.compile(
    rf"\b(once|twice|thrice|({_NUMBER}|{_WORD})\s+times)\s+(?:per|a|an|every|each)\s+(?=\w)|\b(every other|every second|every|each|per)\s+(?=[a-zA-Z])",
    re.I,
)
_UNIT_MULT_RE = re.compile(r"^\s*x?\s*(\d+)(?:\^(\d+))?\s*(?=[^\d\s.,^])|^\s*(thousand|hundred)\s+", re.I)
_STATED_RE = re.compile(r"(?:\b(?:in|is|as|of|are|unit|units)\b\s*:?\s*)(?=\S)", re.I)


def _number(text: str) -> Fraction:
    return Fraction(text.replace(",", "") if _THOUSANDS_RE.fullmatch(text) else text.replace(",", "."))


def _unit_at(text: str, pos: int) -> tuple[str, Fraction, int] | None:
    m = _UNIT_RE.match(text, pos)
    if not m:
        return None
    i = int(m.lastgroup[1:])
    return _UNITS[i][1], _UNITS[i][2], m.end()


def _figure(m: re.Match) -> Fraction | None:
    try:
        if m["frac"]:
            top, bottom = m["frac"].split("/")
            return _number(top.strip()) / int(bottom)
        if m["num"]:
            return _number(m["num"]) ** int(m["pow"]) if m["pow"] else _number(m["num"])
        value = Fraction(1)
        for word in re.findall(r"[a-z]+", m["words"].lower()):
            value *= _WORDS.get(word, _WORDS.get(word.rstrip("s"), 1))
        return value
    except (ValueError, ZeroDivisionError):
        return None


def text_quantities(text: str) -> list[tuple[str, Fraction]]:
    """All (dimension, amount) that a text tells, each figure with its unit; figures without one are left out."""
    out: list[tuple[str, Fraction]] = []
    for m in _ISO_RE.finditer(text):
        parts = [int(x) for x in m.groups("0")]
        if any(parts):
            out.append((TIME, Fraction(sum(n * f for n, f in zip(parts, _ISO)))))
    for m in _ADVERB_RE.finditer(text):
        each, by = Fraction(_ADVERBS[m[2].lower()]), (m[1] or "").lower()
        if by in ("twice", "semi"):
            each /= 2
        elif by in ("every other", "bi"):
            each *= 2
        elif by in _WORDS:
            each *= _WORDS[by]
        elif by and by != "once":
            each *= _number(by)
        out.append((TIME, each))
    for m in _TIMES_RE.finditer(text):
        if (u := _unit_at(text, m.end())) and u[0] == TIME:
            said = (m[1] or m[3]).lower()
            times = {"twice": Fraction(2), "thrice": Fraction(3), "every other": Fraction(1, 2), "every second": Fraction(1, 2)}.get(said, Fraction(1))
            if m[2]:
                times = Fraction(_WORDS[m[2].lower()]) if m[2].lower() in _WORDS else _number(m[2])
            if times:
                out.append((TIME, u[1] / times))
    pending: list[Fraction] = []  # figures that share the unit of the next one: "1 x 2 km"
    end = None
    pos = 0
    while m := _NUMBER_RE.search(text, pos):
        value = _figure(m)
        pos = m.end()
        if end is not None and not _JOIN_RE.fullmatch(text, end, m.start()):
            pending = []
        mult = _MULT_RE.match(text, pos)
        scale = {"thousand": 1000, "hundred": 100}.get((mult[1] or "").lower(), 1)
        at = mult.end()
        if text[at : at + 1] in "-–" and not m["words"]:
            at += 1
        u = _unit_at(text, at)
        if value is None:
            end = None
            continue
        if u is None:
            pending, end = [*pending, value], pos
            continue
        out += [(u[0], v * scale * u[1]) for v in [*pending, value]]
        pending, pos = [], u[2]
        end = None
    return out


def stated_unit(text: str | None) -> tuple[str, Fraction] | None:
    """The unit that a unit field or a sentence about the unit names: 'x100 m', 'thousand metres', 'values are given in km'."""
    if not text or not text.strip():
        return None
    text = re.sub(r"\((?:nominal|approx\.?|about)\)", "", text).strip()
    scale = Fraction(1)
    if m := _UNIT_MULT_RE.match(text):
        scale = Fraction({"thousand": 1000, "hundred": 100}.get((m[3] or "").lower(), 0)) if m[3] else Fraction(int(m[1])) ** int(m[2] or 1)
        text = text[m.end() :]
    if (u := _unit_at(text, 0)) and re.fullmatch(r"\.?\s*", text[u[2] :]):
        return u[0], u[1] * scale
    for m in _STATED_RE.finditer(text):
        if u := _unit_at(text, m.end()):
            return u[0], u[1] * scale
    return None


_BARE_RE = re.compile(rf"\s*(?:~|≈|ca\.?|approx\.?|about)?\s*({_NUMBER}(?:\s*/\s*\d+)?)\s*", re.I)


def record_quantity(attributes: str | None, fields: tuple[str, ...], value_field: str | None, unit_field: str | None, text_fields: tuple[str, ...]) -> tuple[str, int] | None:
    """(dimension, whole amount) of one attribute record, or None."""
    if attributes is None:
        return None
    try:
        record = json.loads(attributes, parse_float=str, parse_int=str)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    found: list[tuple[str, Fraction]] = []
    for name in (*fields, *text_fields):
        if isinstance(x := record.get(name), str):
            found += text_quantities(x)
    if value_field and (raw := record.get(value_field)) is not None and not isinstance(raw, (bool, dict, list)):
        bare = _BARE_RE.fullmatch(str(raw))
        if bare:
            unit_text = record.get(unit_field) if isinstance(record.get(unit_field), str) else None
            unit = stated_unit(unit_text)
            if unit is None and not (unit_text or "").strip(" -"):
                texts = [record[name] for name in text_fields if isinstance(record.get(name), str)]
                unit = next((u for x in texts if not text_quantities(x) and (u := stated_unit(x))), None)
            if unit is not None:
                top, _, bottom = bare[1].partition("/")
                value = _number(top.strip()) / (int(bottom) if bottom and int(bottom) else 1)
                found.append((unit[0], value * unit[1]))
        else:
            found += text_quantities(str(raw))
    found = [q for q in found if q[1] > 0]
    if not found:
        return None
    dimension = LENGTH if any(d == LENGTH for d, _ in found) else TIME
    return dimension, math.floor(max(v for d, v in found if d == dimension) + Fraction(1, 2))


def means_type(c: Column, name: str) -> Column:
    """Whether a freely typed type means ``name``: decoration apart and up to two letters off."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(type:|[a-z]{2}:|ontology/)|\(entity\)|#\d+", ""), r"[^a-z]", "")
    return F.coalesce(F.levenshtein(bare, F.lit(name), 2) >= 0, F.lit(False)) | bare.isin(name + "object")


def read_quantities(entities: DataFrame) -> DataFrame:
    """(entity_id, dimension, amount) of all Resolution and Dataset entities that tell a quantity and its unit."""
    resolution = means_type(F.col("type"), "resolution") | F.regexp_replace(F.lower("type"), "[^a-z]", "").isin("gridsize")
    dataset = means_type(F.col("type"), "dataset") | F.regexp_replace(F.lower("type"), "[^a-z]", "").isin("datacollection")
    rows = entities.where(F.col("id").isNotNull() & F.col("attributes").isNotNull()).select(
        "id", "attributes", F.when(resolution, "r").when(dataset, "d").alias("kind")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, kind in zip(pdf["id"], pdf["attributes"], pdf["kind"]):
                if kind == "r":
                    q = record_quantity(text, (), "value", "unit", ("nativeResolution", "description"))
                else:
                    q = record_quantity(text, ("spatialResolution",), None, None, ())
                if q and q[1] < 2**62:
                    out.append((key, *q))
            yield pd.DataFrame(out, columns=["entity_id", "dimension", "amount"])

    read = rows.where("kind is not null").mapInPandas(run, "entity_id string, dimension string, amount long")
    return read.groupBy("entity_id", "dimension").agg(F.max("amount").alias("amount"))


# --- histories without a stated unit -------------------------------------------------------------------------------------

#: Ratios between units in which one quantity is commonly recorded (fixed values).
KNOWN_FACTORS: dict[str, float] = {
    "10": 10.0, "60": 60.0, "100": 100.0, "1000": 1000.0, "3600": 3600.0, "24": 24.0, "7": 7.0, "30": 30.0, "365": 365.0,
    "86400": 86_400.0, "degree-km": 111.32, "degree-m": 111_320.0, "foot-m": 1 / 0.3048, "mile-km": 1.609344, "nautical-km": 1.852,
}


class LevelSearch:
    """The levels of a history that minimise squared error plus ``penalty`` a level, searched exactly, one value at a time.

    Kept is the least cost as a function of the open level's value: pieces (from, to, n, sum, squares, start) of parabolas, of which
    a piece goes once no value of the open level makes its start the best (functional pruning). Of equal costs the earlier start
    counts. ``back`` holds the start of the last level for each prefix from ``base`` on.
    """

    def __init__(self, penalty: float):
        self.penalty, self.best, self.base, self.origin = penalty, -penalty, 0, 0.0
        self.pieces: list[tuple[float, float, int, float, float, int]] = []
        self.back = array("q")

    def add(self, x: float) -> None:
        t = self.base + len(self.back)
        if t == 0:
            self.origin = x
        x -= self.origin
        anew = self.best + self.penalty  # cost of a level that starts here
        cut: list[tuple[float, float, int, float, float, int]] = []
        free = -math.inf  # from here to the next piece kept, the new level is the best
        for lo, hi, n, s, q, start in self.pieces:
            inside = s * s - n * (q - anew)
            if inside < 0:
                continue
            root = math.sqrt(inside)
            lo, hi = max(lo, (s - root) / n), min(hi, (s + root) / n)
            if lo > hi:
                continue
            if free < lo:
                cut.append((free, lo, 0, 0.0, anew, t))
            cut.append((lo, hi, n, s, q, start))
            free = hi
        if free < math.inf:
            cut.append((free, math.inf, 0, 0.0, anew, t))
        self.best, last, self.pieces, square = math.inf, t, [], x * x
        for lo, hi, n, s, q, start in cut:
            n, s, q = n + 1, s + x, q + square
            self.pieces.append((lo, hi, n, s, q, start))
            level = min(max(s / n, lo), hi)
            cost = (n * level - 2 * s) * level + q
            if cost < self.best or (cost == self.best and start < last):
                self.best, last = cost, start
        self.back.append(last)

    def starts(self, end: int) -> list[int]:
        """Starts of the levels of the values from ``base`` up to ``end``."""
        out = []
        while end > self.base:
            end = self.back[end - self.base - 1]
            out.append(end)
        return out[::-1]

    def settled(self) -> int:
        """The last cut that every history that goes on from here has."""
        live = {start for *_, start in self.pieces}
        while len(live) > 1:
            latest = max(live)
            live.remove(latest)
            live.add(self.back[latest - self.base - 1])
        return live.pop() if live else self.base

    def forget(self, end: int) -> None:
        """Leaves out what lies before a settled cut."""
        self.back, self.base = self.back[end - self.base :], end


def changepoints(x: np.ndarray, penalty: float) -> list[int]:
    """Starts of the levels of ``x`` that minimise squared error plus ``penalty`` a level: exact search with pruning."""
    search = LevelSearch(penalty)
    for value in x.tolist():
        search.add(value)
    return search.starts(len(x))


def match_factor(shift: float, tolerance: float) -> tuple[str, float] | None:
    """The known factor whose logarithm lies within ``tolerance`` of a level shift; its name and the factor that reverses it."""
    best = None
    for name, factor in KNOWN_FACTORS.items():
        for sign in (1, -1):
            off = abs(shift - sign * math.log(factor))
            if off <= tolerance and (best is None or off < best[0]):
                best = (off, name, factor ** (-sign))
    return best and best[1:]


SHIFT_SCHEMA = "source string, block string, segment int, start_at timestamp, rows long, level double, factor string, reverse_by double"


class _History:
    """Levels of one source, given out in order."""

    def __init__(self, source: str, penalty: float, tolerance: float):
        self.source, self.tolerance, self.search = source, tolerance, LevelSearch(penalty)
        self.at, self.x = array("q"), array("d")  # of the rows from search.base on; microseconds
        self.segment, self.reverse, self.before = 0, 1.0, None

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        self.at.frombytes(at.tobytes())
        self.x.frombytes(x.tobytes())
        for value in x.tolist():
            self.search.add(value)

    def levels(self, end: int, each: list[tuple] | None = None) -> list[tuple]:
        """Rows of the levels up to the cut ``end``, which are then forgotten; to ``each`` goes (segment, reverse_by) of every value."""
        base, cuts, out = self.search.base, self.search.starts(end), []
        x = np.array(self.x[: end - base])
        for a, b in zip(cuts, [*cuts[1:], end]):
            level = float(np.median(x[a - base : b - base]))
            hit = match_factor(level - self.before, self.tolerance) if self.before is not None else None
            if hit:
                self.reverse *= hit[1]
            if each is not None:
                each += [(self.segment, self.reverse)] * (b - a)
            start = np.datetime64(self.at[a - base], "us")
            out.append((self.source, str(start.astype("datetime64[M]")), self.segment, start, b - a, level, hit[0] if hit else None, self.reverse))
            self.segment, self.before = self.segment + 1, level
        self.at, self.x = self.at[end - base :], self.x[end - base :]
        self.search.forget(end)
        return out

    def rest(self, each: list[tuple] | None = None) -> list[tuple]:
        return self.levels(self.search.base + len(self.x), each)


def unit_shifts(
    history: DataFrame, source: str, at: str, value: Column, penalty: float = 6.0, tolerance: float = 0.12, max_block: int = 4096
) -> DataFrame:
    """Levels of each source's whole history, and for each level the known factor by which it is off the one before.

    ``reverse_by`` multiplies the values of a level to bring them to the unit of the source's first level; 1.0 where no known
    factor matches. ``block`` is the month in which a level starts. Every ``max_block`` rows the levels that no later row can change
    are given out; the size has no effect on the result.
    """
    rows = _ordered_history(history, source, at, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "block", "segment", "start_at", "rows", "level", "factor", "reverse_by"]
        for held, _, settle in _fed(batches, penalty, tolerance, max_block):
            yield pd.DataFrame(held.levels(held.search.settled()) if settle else held.rest(), columns=columns)

    return rows.mapInPandas(run, SHIFT_SCHEMA)


def _ordered_history(history: DataFrame, source: str, at: str, value: Column, ident: str | None = None) -> DataFrame:
    """Values above zero of each source in order of time, one source in one partition: (source, at, x, ident)."""
    number = value.cast("double")
    ids = F.col(ident).cast("string") if ident else F.lit("")
    rows = history.select(F.col(source).alias("source"), F.col(at).cast("timestamp").alias("at"), F.log(number).alias("x"), ids.alias("ident")).where(
        F.col("source").isNotNull() & F.col("at").isNotNull() & (number > 0) & (number < float("inf"))
    )
    return rows.repartition("source").sortWithinPartitions("source", "at", "x", "ident")


def _fed(batches: Iterator[pd.DataFrame], penalty: float, tolerance: float, max_block: int) -> Iterator[tuple[_History, list[str], bool]]:
    """Feeds ordered rows to one history after another. Gives (history, new ids, whether only what is settled may be given out)."""
    held: _History | None = None
    new: list[str] = []
    for pdf in batches:
        names, x, ids = pdf["source"].to_numpy(), pdf["x"].to_numpy(np.float64), pdf["ident"].tolist()
        times = pdf["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
        change = (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()
        for a, b in zip([0, *change], [*change, len(names)]):
            if a == b:
                continue
            if held is None or held.source != names[a]:
                if held is not None:
                    yield held, new, False
                held, new = _History(names[a], penalty, tolerance), []
            for c in range(a, b, max_block):
                d = min(b, c + max_block)
                held.add(times[c:d], x[c:d])
                new += ids[c:d]
                if d < b or len(held.x) >= max_block:
                    yield held, new, True
                    new = []
    if held is not None:
        yield held, new, False


CONVERTED_SCHEMA = "source string, ident string, value double, converted double, segment int"


def convert_units(
    history: DataFrame, source: str, at: str, value: Column, ident: str, penalty: float = 6.0, tolerance: float = 0.12, max_block: int = 4096
) -> DataFrame:
    """(source, ident, value, converted, segment): every value of each source in the unit of the source's first level.

    The levels and factors are those of ``unit_shifts``. A level is known only when no later row can change it; until then its values
    are held.
    """
    rows = _ordered_history(history, source, at, value, ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for held, new, settle in _fed(batches, penalty, tolerance, max_block):
            waiting += new
            each: list[tuple] = []
            values = np.exp(np.array(held.x))
            held.levels(held.search.settled(), each) if settle else held.rest(each)
            out = [(held.source, k, v, v * factor, segment) for k, v, (segment, factor) in zip(waiting, values.tolist(), each)]
            del waiting[: len(each)]
            yield pd.DataFrame(out, columns=["source", "ident", "value", "converted", "segment"])

    return rows.mapInPandas(run, CONVERTED_SCHEMA)
