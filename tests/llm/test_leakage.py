import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basinweave.llm import leakage as L

PLACES = ["Kazgodrel", "Surkensah", "Rogvihmep", "Jipgisvih", "Jipgodtan", "Dednijded", "Bigzeznat", "Ritzomdif", "Hiksursof", "Fotzubtan", "Tutzinnij"]
WHO = ["the night crew", "a ferry mechanic", "the bell ringer", "our youngest diver", "two rival beekeepers"]
DID = ["traced a faint dye plume", "wrapped the sonde in felt", "counted 40 stranded eels", "buried 8 copper tags", "reset the paper drum"]
WHEN = ["as the third storm cell formed", "although no permit was issued", "just after the market closed", "under a lid of yellow dust"]
FILL = "the survey at this site shows that the mean annual flow depends on local land use and was checked against the gauge record".split()


def items(n=60):
    rng = random.Random(3)
    out = []
    for i in range(n):
        name = [PLACES[i % 11][:4] + "abcdefghijklmnopqrstuvwxyz"[i // 3] + p.lower() for p in rng.sample(PLACES, 3)]
        text = " ".join(f"{rng.choice(WHO).capitalize()} {rng.choice(DID)} across the {p.capitalize()} moor {rng.choice(WHEN)}." for p in name)
        stock = "Choose the single best answer to the question using only the passage. " if i % 2 else ""
        out.append((i, stock + text + f" Who was across the {name[2].capitalize()} moor?", "a"))
    return out


def find(spark, docs, its):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(its, "item_id long, text string, answer string")
    return sorted(tuple(r) for r in L.leaked_items(d, i).collect())


def test_forms(spark):
    its = items()
    rng = random.Random(9)
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    body = {i: t.split("passage. ")[-1].rsplit(". ", 1)[0] + "." for i, t, _ in its}
    sentence = {i: b.split(". ")[1] + "." for i, b in body.items()}
    wrapped = "\n> ".join(" ".join(body[3].split()[k : k + 6]) for k in range(0, 60, 6))
    docs = [
        (0, fill(80) + ". " + body[0] + " " + fill(50)),
        (1, fill(20) + " " + body[1].upper() + fill(3000)),
        (2, body[2].lower().replace(",", "").replace(".", "")),
        (3, fill(30) + "\n> " + wrapped),
        (4, "<p>" + body[4].replace(" the ", " <b>the</b>&nbsp;") + "</p>"),
        (5, fill(40) + ". " + sentence[5] + " " + fill(40)),
        (6, fill(40) + ". " + body[6].replace(" the ", " a ").replace("across", "along") + fill(9)),
        (7, "Choose the single best answer to the question using only the passage. " + fill(60)),
        (8, fill(30) + " the night crew traced a faint dye plume as the third storm cell formed " + fill(30)),
        (9, None), (10, ""), (11, " \n"), (12, fill(4000)),
        (13, body[0]), (13, body[0]),
    ]
    got = find(spark, [(*d, "x") for d in docs], its)
    assert got == [(k, k) for k in range(7)] + [(13, 0)]
    assert find(spark, [(*docs[0], "x")][:0], its) == []
    assert find(spark, [(*d, "x") for d in docs], []) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("efgh"), min_size=L.K + L.WINDOW - 1, max_size=9))
def test_every_long_shared_run_shares_a_fingerprint(left, right, shared):
    h = L._WordHashes()
    a, b = L.fingerprints(left + shared + right, h), L.fingerprints(right + shared + left, h)
    assert len(np.intersect1d(a, b)) > 0


def test_share_counts_words_in_order():
    item = [f"w{i}" for i in range(30)]
    assert L.matched_share(item, item) == 1
    assert abs(L.matched_share(["x"] * 9 + item[5:15] + ["y"] * 9, item) - 10 / 30) < 1e-9
    swapped = item[15:] + ["z"] * 8 + item[:15]
    assert L.matched_share(swapped, item) <= 0.6
    assert L.matched_share([], item) == L.matched_share(item, []) == 0


def test_many_candidates_take_the_shuffled_way(spark, monkeypatch):
    its = items()
    docs = [(k, t, "x") for k, t, _ in its[:9]]
    sent = find(spark, docs, its)
    monkeypatch.setattr(L, "MAX_SENT_IDS", 0)
    assert find(spark, docs, its) == sent == [(k, k) for k in range(9)]


def test_many_questions_on_one_passage(spark):
    first = "Read the passage below. Choose the single best answer to the question using only the passage. "
    its = [(i, first * (i % 2) + t.split("passage. ")[-1], a) for i, t, a in items()]
    body = its[0][1].rsplit(". ", 1)[0] + "."
    its += [(100 + k, first * (k % 2) + f"{body} What was question {k} about?", "a") for k in range(7)]
    frame = spark.createDataFrame(its, "item_id long, text string, answer string")
    got = {r.item_id: r.passage for r in L.passages(frame).collect()}
    assert len(got) == len(its) and {got[i] for i in (0, *range(100, 107))} == {body}
    assert not any("Choose" in p or "Read the" in p for p in got.values())
    assert find(spark, [(1, "fill " * 30 + body, "x")], its) == [(1, i) for i in (0, *range(100, 107))]


def test_questions_without_a_mark(spark):
    body = items()[0][1].rsplit(". ", 1)[0] + "."
    for many in (3, 5, 6, 40):
        its = [(k, f"{body} Name the matter of question {k} in a word.", "a") for k in range(many)]
        assert find(spark, [(1, "fill " * 30 + body, "x")], its) == [(1, k) for k in range(many)], many


def test_result_does_not_depend_on_the_number_of_items(spark):
    its = items(60)
    docs = [(k, "fill " * 9 + t, "x") for k, t, _ in its[:6]] + [(50, "The night crew traced a faint dye plume across the Elsewhere moor as the third storm cell formed.", "x")]
    alone = [find(spark, docs, its[:n]) for n in (6, 39, 41, 60)]
    assert alone == [[(k, k) for k in range(6)]] * 4


def test_many_passages_in_one_document(spark, monkeypatch):
    its = items(30)
    doc = [(7, " ".join(t for _, t, _ in its), "x")]
    monkeypatch.setattr(L, "TESTS", 4)
    assert find(spark, doc, its) == [(7, k) for k in range(30)]


def common_items(n=300):
    """Passages of few phrases, each in far more than 20 sentences; every fifth has no name."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        names = ["".join(rng.choice("bdfghjklmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(3)]
        text = " ".join(f"{rng.choice(WHO).capitalize()} {rng.choice(DID)} {f'across the {p.capitalize()} moor ' if i % 5 else ''}{rng.choice(WHEN)}." for p in names)
        out.append((i, text, "a"))
    return out


def test_no_candidate_is_left_out(spark, monkeypatch):
    its = common_items()
    rng = random.Random(8)
    other = lambda w: "".join(rng.choice("qxz") for _ in w)
    named = re.compile(r"(?<=across the )\w+")
    misspelt = lambda t: named.sub(lambda m: m[0][:3] + "x" + m[0][4:], t)
    docs = []
    for k in range(0, 60, 2):
        docs.append((k, "fill " * 9 + misspelt(its[k][1]), "x"))
        docs.append((k + 1, " ".join(w if j % 4 != k % 4 or "moor" in its[k][1].split()[j : j + 2] else other(w) for j, w in enumerate(its[k][1].split())), "x"))
    held = {r.item_id: r.passage for r in L.passages(spark.createDataFrame(its, "item_id long, text string, answer string")).collect()}
    told = spark.createDataFrame(sorted(held.items()), "pid long, passage string")
    rare = {r.pid: frozenset(r.rare) for r in L.distinctive_words(told).collect()}
    assert {not r for r in rare.values()} == {True, False}
    share = lambda t, i: L.matched_share(L.words_of(t), L.words_of(held[i]), rare[i])
    want = sorted((d, i) for d, t, _ in docs for i in held if share(t, i) >= L.SHARE)
    assert {(k, k) for k in range(0, 60, 2)} <= set(want) and sum((k + 1, k) in want for k in range(0, 60, 2)) > 20
    assert find(spark, docs, its) == want
    monkeypatch.setattr(L, "MAX_SENT_IDS", 0)
    monkeypatch.setattr(L, "SENT_BLOCKS", 0)
    assert find(spark, docs, its) == want


def test_spellings_are_those_of_a_run(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice((3, 4, 5, 7, 8, 9, 20, 21, 23, 40))))
    rare = sorted({w for w in (word() for _ in range(60)) if len(w) > 3})
    change = lambda w, j, x: rng.choice((w[:j] + x + w[j:], w[:j] + w[j + 1 :], w[:j] + x + w[j + 1 :], w[:j] + w[j : j + 2][::-1] + w[j + 2 :]))
    seen = [change(change(w, rng.randrange(len(w)), "b"), rng.randrange(len(w) - 1), "c") for w in rare for _ in range(4)]
    words = sorted({w for w in seen + rare + [word() for _ in range(60)] if len(w) > 3})
    got = L.spellings(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in rare], "rare string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, r) for w in words for r in rare if L._same(w, r))
