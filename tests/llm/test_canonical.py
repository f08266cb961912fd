import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from basinweave.llm import canonical as C

FIELDS = ["Hydrology", "Hydrogeology", "Soil Science", "Machine Learning", "Natural Language Processing", "Remote Sensing"]
TYPES = ["Dam", "River", "Model", "RainfallRunoffModel", "FloodEvent", "InSituNetwork", "Dataset"]


def mapped(spark, reference, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r.value: r.canonical for r in C.map_values(df, reference).collect()}


def test_fields(spark):
    ref = C.Reference(FIELDS, [("水文学", "Hydrology"), ("pedology", "Soil Science")])
    want = {
        "hydrology": "Hydrology", "Hydrolgy": "Hydrology", "PhD in Hydrology": "Hydrology", "水文学": "Hydrology", "Hydrog..": "Hydrogeology",
        "science soil": "Soil Science", "soi lscience": "Soil Science", "Pedology (MSc)": "Soil Science", "n.l.p.": "Natural Language Processing",
        "remote sensgi": "Remote Sensing", "Remote working": C.UNMATCHED, "soil pipes": C.UNMATCHED, "hydro": C.UNMATCHED, "-": C.UNMATCHED,
        "research": C.UNMATCHED, "machine tools trade": C.UNMATCHED, "x" * 5000: C.UNMATCHED,
    }
    assert mapped(spark, ref, list(want)) == want


def test_types(spark):
    ref = C.Reference(TYPES, [("inundation", "FloodEvent")], camel=True)
    want = {
        "type:Dam": "Dam", "Damsel": C.UNMATCHED, "de:RainfallRunoffModel": "RainfallRunoffModel", "rainfall-runof model.": "RainfallRunoffModel",
        "Fashion Model": C.UNMATCHED, "Model#1": "Model", '"River"': "River", "riverboat": C.UNMATCHED, "Inundation": "FloodEvent",
        "insitunetork": "InSituNetwork", "Dataset (entity)": "Dataset", "event ticket": C.UNMATCHED,
    }
    assert mapped(spark, ref, list(want)) == want


def test_cases_of_records(spark):
    ref = C.Reference(FIELDS)
    rows = [("a", "Hydrology", 1), ("b", "hydrology ", 1), ("b", "hydrology ", 1), ("c", None, 1), ("d", " \t", 1), (None, "hydrology", 1), ("e", "?", 1)]
    df = spark.createDataFrame(rows, "id string, v string, canonical int")
    got = sorted(tuple(r) for r in C.canonical_values(df, "id", "v", ref, "t").collect())
    assert got == [("t", "b", "Hydrology"), ("t", "e", C.UNMATCHED)]
    assert C.canonical_values(df.limit(0), "id", "v", ref, "t").count() == 0
    assert C.canonical_values(df, "id", "v", C.Reference([]), "t").where("canonical != 'UNMATCHED'").count() == 0


def brute_edits(a, b):
    """Length of the shortest way by single edits, for short tokens."""
    layer, seen, n = {a}, {a}, 0
    letters = sorted(set(b))
    while b not in layer:
        n += 1
        if n > 2:
            return 3
        nxt = set()
        for t in layer:
            for i in range(len(t) + 1):
                nxt |= {t[:i] + x + t[i:] for x in letters}
                nxt |= {t[:i] + x + t[i + 1 :] for x in letters} if i < len(t) else set()
                nxt.add(t[:i] + t[i + 1 :])
                if i + 1 < len(t):
                    nxt.add(t[:i] + t[i + 1] + t[i] + t[i + 2 :])
        layer = nxt - seen
        seen |= nxt
    return n


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_edits_against_brute_force(a, b):
    assert C.edits(a, b) == brute_edits(a, b)


def test_deletion_blocking_is_complete():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(5, 9)))
        t = list(w)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(t))
            how = rng.randrange(4)
            if how == 0:
                del t[i]
            elif how == 1:
                t.insert(i, rng.choice("abcde"))
            elif how == 2:
                t[i] = rng.choice("abcde")
            elif i + 1 < len(t):
                t[i], t[i + 1] = t[i + 1], t[i]
        t = "".join(t)
        assert C.edits(t, w) <= 2
        assert set(C.deletions(t)) & set(C.deletions(w))


def test_reference_takes_any_order_of_entries():
    for order in itertools.permutations(FIELDS[:3]):
        assert C.Reference(order).surfaces == C.Reference(FIELDS[:3]).surfaces


LONGWORDS = ["internationalization", "counterrevolutionaries", "hydrometeorologicalobservationnetwork", "x" * 30 + "abcdefghij" * 5]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(LONGWORDS), st.lists(st.tuples(st.sampled_from("idsx"), st.integers(0, 99), st.sampled_from("aeqx")), max_size=2))
def test_blocks_lose_no_word_within_two_edits(word, changes):
    token = word
    for kind, at, letter in changes:
        i = at % len(token)
        if kind == "i":
            token = token[:i] + letter + token[i:]
        elif kind == "d":
            token = token[:i] + token[i + 1 :]
        elif kind == "s":
            token = token[:i] + letter + token[i + 1 :]
        else:
            token = token[:i] + token[i : i + 2][::-1] + token[i + 2 :]
    if C.edits(token, word) <= 2:
        assert C.blocks(token, 2, False) & C.blocks(word, 2, True)


def test_long_words_are_repaired(spark):
    long = "internationalhydrometeorologicalobservationnetwork"
    ref = C.Reference([f"{long} Studies", "Hydrology"])
    typo = long[:9] + long[10:30] + "z" + long[31:]
    assert mapped(spark, ref, [typo, long.upper(), "q" * 60]) == {typo: f"{long} Studies", long.upper(): f"{long} Studies", "q" * 60: C.UNMATCHED}


def test_lists_beyond_the_limit_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ENTRIES", 3)
    types = spark.createDataFrame([("Dam",), ("River",), ("Dam",), ("Dam",), (None,)], "name string")
    few = spark.createDataFrame([("weir", "Dam"), ("creek", "River")], "token string, canonical string")
    many = spark.createDataFrame([(f"weir{i}", "Dam") for i in range(10)], "token string, canonical string")
    assert len(C.type_reference(types, few).names) == 2
    for args in ((types, many), (many.select(many.token.alias("name")), few)):
        try:
            C.type_reference(*args)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_a_large_vocabulary_takes_the_joined_way(spark, monkeypatch):
    ref = C.Reference(FIELDS)
    sent = mapped(spark, ref, ["Hydrolgy", "remote sensgi", "soi lscience", "zzz"])
    monkeypatch.setattr(C, "SENT_BLOCKS", 0)
    assert mapped(spark, ref, ["Hydrolgy", "remote sensgi", "soi lscience", "zzz"]) == sent
