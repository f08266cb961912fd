import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from basinweave.llm import linkage as L
from basinweave.llm import naming as N


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    assert L.lcs(a, b) == brute_lcs(a, b)
    assert 0 <= L.lcs_ratio(a, b) <= 1


def test_one_typing_error_shares_a_block():
    rng = random.Random(4)
    for _ in range(500):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14)))
        b, i = list(a), rng.randrange(len(a))
        how = rng.randrange(4)
        if how == 0:
            del b[i]
        elif how == 1:
            b.insert(i, "x")
        elif how == 2:
            b[i] = "x"
        elif i + 1 < len(b):
            b[i], b[i + 1] = b[i + 1], b[i]
        assert {k for k, _ in L.block_keys(a)} & {k for k, _ in L.block_keys("".join(b))}, (a, b)


def test_names():
    assert N.person_parts("Kulbal-grove, R. H.") == ("kulbalgrove", "r", "h")
    assert N.person_parts("Dr. Zoë A. Jipström, PhD") == ("jipstrom", "zoe", "a")
    assert N.person_parts("A.W. Kazescu") == ("kazescu", "a", "w")
    assert N.person_parts(" ") is N.person_parts(None) is None
    tu = ("technical university", "gavritfot")
    for x in ("TU Gavritfot", "TU-Gavritfot", "T.U. Gavritfot", "Chair of Hydraulics, TU Gavritfot", "TECHNICAL UNIVERSITY OF GAVRITFOT", "Tech. Univ. Gavritfot", "Technische Universität Gavritfot", "Technical Unversity of  Gavritfot"):
        assert N.organisation_parts(x) == tu, x
    assert N.organisation_parts("Nat. Ctr. Hydrol. Res., Kazmar") == N.organisation_parts("NCHR (Kazmar)") == ("national centre hydrological research", "kazmar")
    assert N.organisation_parts("-") is N.organisation_parts("  ") is N.organisation_parts(None) is None


MENTIONS = [
    ("a1", "Benjamin Kuljafgrove", "University of Kazmarbal", "x1@m.example"),
    ("a2", "Ben Kuljafgrove", "Univ. of Kazmarbal", None),
    ("a3", "Kuljafgrove, B.", "Universität Kazmarbal", "benjamin.kuljafgrove@m.example"),
    ("a4", "Benjamin Kuljfagrove", "TU Lohsidvos", None),
    ("p1#0", "B. Kuljafgrove", "-", None),
    ("p2#0", "Katherine Kuljafgrove", "NCHR Lohsidvos", None),
    ("p3#1", "K. Kuljafgrove", "NCHR, Lohsidvos", None),
    ("p4#1", "Kuljafgrove Katherine", "", None),
    ("p5#0", None, "TU Lohsidvos", None),
    ("p6#0", " ", None, None),
    ("a1", "Benjamin Kuljafgrove", "University of Kazmarbal", "x1@m.example"),
    ("b1", "Benjamin Q. Zomtutwicz", "University of Kazmarbbal", None),
    ("b2", "Benjamin Q. Zomtutwicz", "Technical University of Kazmarbal", None),
    ("b3", "Benjamin R. Zomtutwicz", "Technical University of Kazmarbal", None),
] + [(f"f{i}", f"{g} Family{'abcdefgh'[i % 8] * 3}{i}x".replace(str(i), "klmnopqrstuvwxyz"[i % 16]), None, None) for i, g in enumerate(["Katherine", "Benjamin"] * 6)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "key string, name string, affiliation string, email string, person string")


def test_persons(spark):
    got = {tuple(r) for r in L.person_pairs(frame(spark, MENTIONS)).collect()}
    ben, kate = ["a1", "a2", "a3", "a4", "p1#0"], ["p2#0", "p3#1", "p4#1"]
    want = {p for g in (ben, kate) for p in itertools.combinations(sorted(g), 2)}
    assert {p for p in got if p[0][0] != "f"} == want
    assert L.person_pairs(frame(spark, [])).count() == 0


def test_organisations(spark):
    rows = [("k", "n", a, None) for a in ("University of Kazmarbal", "University of Kazmarbal", "Univ Kazmarbal", "University of Kazmarbbal", "TU Kazmarbal", "-", None, "", "NCHR Lohsidvos")]
    got = sorted(tuple(r) for r in L.organisation_pairs(frame(spark, rows).select("affiliation")).collect())
    assert got == [("Univ Kazmarbal", "University of Kazmarbal"), ("Univ Kazmarbal", "University of Kazmarbbal"), ("University of Kazmarbal", "University of Kazmarbbal")]


def test_refined_blocks_lose_no_pair(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice(["bal", "det", "kim", "rog", "sun"]) for _ in range(3)) + "ansky" for _ in range(40)}
    for w in sorted(words)[:20]:
        i = rng.randrange(len(w) - 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
    df = spark.createDataFrame([("s", w, 1) for w in sorted(words)], "scope string, token string, n long")
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if max(len(a), len(b)) - brute_lcs(a, b) <= 1}
    for most in (0, 5, 10_000):
        got = {(r.a, r.b) for r in L.near_pairs(df, most).where("lost <= 1").collect()}
        assert got == want, most


def test_refined_blocks_keep_pairs_two_letters_apart(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) + "grove" for _ in range(40)}
    for w in sorted(words):
        for _ in range(2):
            v = list(w)
            for _ in range(2):
                i = rng.randrange(len(v) - 5) if len(v) > 5 else 0
                how = rng.randrange(3)
                v[i : i + (how != 1)] = [] if how == 0 else ["x"]
            words.add("".join(v))
    df = spark.createDataFrame([("s", w, 1) for w in sorted(words)], "scope string, token string, n long")
    got = {m: {tuple(r) for r in L.near_pairs(df, m).collect()} for m in (1, 20, 200, 10_000)}
    assert got[1] == got[20] == got[200] == got[10_000]
    assert sum(lost == 2 for *_, lost in got[1]) > 20


def test_many_mentions_of_one_spelling(spark):
    rows = [(f"k{i}", "Katherine Kuljafgrove", "NCHR Lohsidvos", None) for i in range(3000)] + [("x1", "Kate Kuljafgrove", None, None), ("x2", "K. Kuljafgrove", None, None)]
    assert L.person_pairs(frame(spark, rows)).count() == 2 * 3000 + 1


def test_pointers_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([("s", f"t{i}", f"t{i + 1}") for i in range(40)], "scope string, token string, parent string")
    assert {(r.token, r.root) for r in L.follow_pointers(chain).collect()} == {(f"t{i}", "t40") for i in range(40)}


def test_classes_agree_with_pairs(spark):
    who = L.persons(frame(spark, MENTIONS))
    links = {r.key: r.links for r in L.person_classes(who).collect()}
    pairs = [tuple(r) for r in L.person_pairs(frame(spark, MENTIONS)).collect()]
    assert links == {k: sum(k in p for p in pairs) for k in links}
    assert links["a1"] == 4 and len(links) == len({m[0] for m in MENTIONS if m[1] and m[1].strip()})
