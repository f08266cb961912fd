"""Free-entered values mapped to the entries of a reference list.

Each distinct token of the values is joined to the vocabulary of the list by edit distance (blocking on shared deletion
variants, then verified), and the repaired tokens are combined by soft TF-IDF into a score per complete entry. The value as one
run of letters counts as a token as well, so that lost, added or misplaced blanks do no harm. A value that is cut off is taken
as the only entry that begins with it.

Tokens longer than ``LONG`` letters are not blocked by deletion variants, of which they have too many, but by ``PARTS`` parts: two
edits leave one of them whole, at most two places away. So tokens of any length are repaired.

Only distinct values and tokens are worked on; the records are joined back to their values at the end. The reference list
(entries and other names) is a fixed table; it is read on the driver, may have ``MAX_ENTRIES`` entries and as many other names (more
are an error), and is sent with the functions. Its blocks are a table that is joined, broadcast only up to ``SENT_BLOCKS`` rows.

Defined cases
    * null and blank values, and values that are exactly an entry, are no case;
    * a value that means no entry gives ``UNMATCHED``; so does an empty list or one that is ambiguous to the letter (a
      cut-off value that begins several entries);
    * equal scores are settled by the smaller edit distance, then by the entry's name; repeated records count once;
    * very long values and words are read and repaired like any other; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinweave.llm.lexicon import FIELD_SYNONYMS, FILLER

UNMATCHED = "UNMATCHED"
MAX_EDITS = 2
MAX_ENTRIES = 100_000
LONG, PARTS = 20, 6
#: Rows of the blocks of a vocabulary that are broadcast (about 10 MB); more are joined like any table.
SENT_BLOCKS = 200_000
THRESHOLD = 0.78

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_DECOR = re.compile(r"^\s*[a-z]+[:/]\s*(?=\S)|\(\s*entity\s*\)|#\d+\s*$", re.I)  # of type names
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Compatibility forms unified, marks and case removed."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in text if not unicodedata.combining(ch)).casefold()


def tokens_of(value: str, camel: bool = False) -> list[str]:
    """Folded tokens. ``camel`` is for type names: decoration goes, changes of case split; else filler words go."""
    if camel:
        return _TOKEN.findall(fold(_CAMEL.sub(" ", _DECOR.sub(" ", value))))
    value = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", ""), value)  # n.l.p. -> nlp
    return [t for t in _TOKEN.findall(fold(value)) if t not in FILLER]


def edits(a: str, b: str, most: int = MAX_EDITS) -> int:
    """Inserted, lost, changed and swapped letters between two tokens, or ``most + 1`` if they are more.

    Swapped letters may have lost or gained letters between them (unrestricted Damerau-Levenshtein distance).
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y),
                d[i + 1][j] + 1,
                d[i][j + 1] + 1,
                d[k][m] + (i - k - 1) + 1 + (j - m - 1) if k and m else far,
            )
        seen[x] = i
    return min(d[-1][-1], most + 1)


def allowed_edits(n: int) -> int:
    """Edits that a token of ``n`` letters may be away from a word."""
    return 0 if n <= 2 else 1 if n <= 4 else MAX_EDITS


def deletions(token: str, most: int = MAX_EDITS) -> set[str]:
    """The token with up to ``most`` letters left out."""
    out, layer = {token}, {token}
    for _ in range(min(most, max(0, len(token) - 1))):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        out |= layer
    return out


def blocks(token: str, most: int, known: bool) -> set[str]:
    """Keys under which a token meets all words within ``most`` edits; ``known`` for words of the vocabulary."""
    n = len(token)
    out: set[str] = set()
    if n <= LONG + (0 if known else MAX_EDITS):
        out |= deletions(token, most)
    if known:
        sizes, shifts = ([n] if n > LONG else []), (0,)
    else:
        sizes, shifts = [x for x in range(n - most, n + most + 1) if x > LONG], range(-most, most + 1)
    for size in sizes:
        step = size / PARTS
        for k in range(PARTS):
            a, b = int(k * step), int((k + 1) * step)
            out |= {f"{size}|{k}|{token[a + x : b + x]}" for x in shifts if a + x >= 0 and b + x <= n}
    return out


class Reference:
    """A reference list with its surfaces: each surface is an entry written in one way, as tokens and as one run of letters."""

    def __init__(self, entries: Iterable[str], synonyms: Iterable[tuple[str, str]] = (), camel: bool = False):
        self.camel = camel
        surfaces: dict[tuple[str, ...], str] = {}
        self.names: dict[str, str] = {}
        entries = sorted({e for e in entries if e and e.strip()})
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"a reference list may have {MAX_ENTRIES} entries")
        for text, entry in [*((e, e) for e in entries), *sorted(synonyms)]:
            toks = tokens_of(text, camel)
            if toks:
                surfaces.setdefault(tuple(sorted(set(toks))), entry)
                surfaces.setdefault(("".join(toks),), entry)
        for e in entries:
            words = [w for w in re.findall(r"\w+", e)]
            if not camel and len(words) >= 3:
                surfaces.setdefault(("".join(w[0] for w in words).lower(),), e)
            self.names[fold(e)] = e
        self.starts = sorted(self.names)
        self.surfaces = sorted(surfaces.items())
        count: dict[str, int] = defaultdict(int)
        for toks, _ in self.surfaces:
            for t in toks:
                count[t] += 1
        n = max(1, len(self.surfaces))
        self.idf = {t: math.log(1 + n / c) for t, c in count.items()}
        self.top = math.log(1 + n)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, (toks, _) in enumerate(self.surfaces):
            for t in toks:
                self.by_token[t].append(i)
        self.norms = [math.sqrt(sum(self.idf[t] ** 2 for t in toks)) for toks, _ in self.surfaces]

    def prefix_entry(self, value: str) -> str | None:
        """The only entry that begins with a cut-off value of four letters or more."""
        start = re.sub(r"[\s.…]+$", "", fold(value)).strip()
        if len(start) < 4:
            return None
        at = bisect_left(self.starts, start)
        hits = {self.names[name] for name in self.starts[at : at + 2] if name.startswith(start)}
        return hits.pop() if len(hits) == 1 else None

    def best(self, toks: list[str], compact: str, repairs: dict[str, list[tuple[str, int]]]) -> str | None:
        """The entry with the highest soft TF-IDF score, at least ``THRESHOLD``."""
        scores: dict[int, tuple[float, int]] = {}
        for bag in ({*toks}, {compact}):
            norm = 0.0
            got: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for t in bag:
                near = repairs.get(t, ())
                least = min((d for _, d in near), default=None)
                weight = max((self.idf[v] for v, d in near if d == least), default=self.top)
                norm += weight * weight
                each: dict[int, tuple[float, int]] = {}
                for v, d in near:
                    gain = weight * self.idf[v] * (1 - 0.5 * d / max(len(v), 1))
                    for i in self.by_token[v]:
                        if i not in each or each[i][0] < gain:
                            each[i] = (gain, d)
                for i, (gain, d) in each.items():
                    got[i][0] += gain
                    got[i][1] += d
            for i, (dot, d) in got.items():
                score = dot / (math.sqrt(norm) * self.norms[i]) if norm and self.norms[i] else 0.0
                if i not in scores or (score, -d) > (scores[i][0], -scores[i][1]):
                    scores[i] = (score, int(d))
        hits = [(-s, d, self.surfaces[i][1]) for i, (s, d) in scores.items() if s >= THRESHOLD]
        return min(hits)[2] if hits else None


def token_repairs(tokens: DataFrame, reference: Reference) -> DataFrame:
    """(token, word, edits): each distinct token joined to the vocabulary words within its allowed edits."""
    words = sorted(reference.by_token)
    listed = tokens.sparkSession.createDataFrame(pd.DataFrame({"word": words}, dtype=object), "word string")

    def expand(known: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(t, v) for t in pdf.iloc[:, 0] for v in blocks(t, MAX_EDITS if known else allowed_edits(len(t)), known)]
                yield pd.DataFrame(rows, columns=["word" if known else "token", "block"])

        return run

    vocabulary = listed.mapInPandas(expand(True), "word string, block string")
    if sum(1 + len(w) * (len(w) + 1) // 2 if len(w) <= LONG else PARTS for w in words) <= SENT_BLOCKS:
        vocabulary = F.broadcast(vocabulary)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [edits(t, w) for t, w in zip(pdf["token"], pdf["word"])]
            out = pdf.assign(edits=d)
            # the allowance is that of the shorter of the two, so that "api" does not take up "a"
            most = [allowed_edits(min(len(t), len(w))) for t, w in zip(out["token"], out["word"])]
            yield out[[x <= m for x, m in zip(d, most)]]

    pairs = tokens.mapInPandas(expand(False), "token string, block string").join(vocabulary, "block").select("token", "word").distinct()
    return pairs.mapInPandas(verify, "token string, word string, edits int")


def map_values(values: DataFrame, reference: Reference) -> DataFrame:
    """(value, canonical) for each distinct row of ``values`` (value: neither null nor blank)."""
    camel = reference.camel

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                toks = tokens_of(value, camel)
                for t in {*toks, "".join(toks)} or {""}:
                    rows.append((value, t))
            yield pd.DataFrame(rows, columns=["value", "token"])

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, near in zip(pdf["value"], pdf["near"]):
                toks = tokens_of(value, camel)
                repairs: dict[str, list[tuple[str, int]]] = defaultdict(list)
                for r in near:
                    repairs[r["token"]].append((r["word"], int(r["edits"])))
                found = reference.best(toks, "".join(toks), repairs) or reference.prefix_entry(value)
                out.append((value, found or UNMATCHED))
            yield pd.DataFrame(out, columns=["value", "canonical"])

    pieces = values.mapInPandas(split, "value string, token string")
    repairs = token_repairs(pieces.where("token != ''").select("token").distinct(), reference)
    near = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("token", "word", "edits"))).alias("near")
    return pieces.join(repairs, "token", "left").groupBy("value").agg(near).mapInPandas(rank, "value string, canonical string")


def canonical_values(records: DataFrame, id_col: str, value_col: str, reference: Reference, tbl: str) -> DataFrame:
    """(tbl, record_id, canonical) of all records whose value is neither null nor blank nor exactly an entry."""
    entries = records.sparkSession.createDataFrame(pd.DataFrame({"value": sorted(set(reference.names.values()))}, dtype=object), "value string")
    cases = (
        records.select(F.col(id_col).alias("record_id"), F.col(value_col).alias("value"))
        .where(F.col("record_id").isNotNull() & F.col("value").rlike(r"(?U)\S"))
        .join(entries, "value", "left_anti")
        .distinct()
    )
    mapped = map_values(cases.select("value").distinct(), reference)
    return cases.join(mapped, "value").select(F.lit(tbl).alias("tbl"), "record_id", "canonical").distinct()


def bounded_rows(df: DataFrame, *columns: str) -> list[tuple]:
    """The different rows of a fixed table without nulls; an error if they are more than ``MAX_ENTRIES``."""
    rows = df.select(*columns).dropna().distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list and its other names may have {MAX_ENTRIES} rows each")
    return [tuple(r) for r in rows]


def field_reference(research_fields: DataFrame, synonyms: dict[str, tuple[str, ...]] = FIELD_SYNONYMS) -> Reference:
    """Reference of the research fields, with other names: those of ``synonyms`` (by default the lexicon's) and their scope notes."""
    notes = [(note, name) for name, note in bounded_rows(research_fields, "name", "scope_note")]
    names = [r[0] for r in bounded_rows(research_fields, "name")]
    known = set(names)
    return Reference(names, [*notes, *((s, e) for e, all_ in synonyms.items() if e in known for s in all_)])


def type_reference(ontology_types: DataFrame, type_alias: DataFrame) -> Reference:
    """Reference of the ontology's types, with their aliases."""
    names = [r[0] for r in bounded_rows(ontology_types, "name")]
    aliases = [(t, c) for t, c in bounded_rows(type_alias, "token", "canonical") if t and c]
    return Reference(names, aliases, camel=True)
