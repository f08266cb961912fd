"""Evaluation passages inside training documents, found by winnowing.

Both sides are cut into words, every run of ``K`` words gets a hash, and each window of neighbouring hashes keeps its smallest: with
a window of ``w`` hashes, a shared run of ``K + w - 1`` words or more is sure to share a fingerprint. Here the window is one, so that
none of them is left out. From shared fingerprints on, runs are extended word by word over the whole text, over small edits, and a
document is reported for an item if such runs, in order, cover ``SHARE`` of the passage.

Passages are worked on once each, however many items have them. They share phrases, so a run counts only if it holds a distinctive
word of the passage (one that at most ``RARE`` of all different sentences have, such as a name), and a run does not go on over a
distinctive word that the document lacks.

Candidates are all pairs in which such a run can occur; no fingerprint or word is left out for being common. For a passage with
distinctive words they are the documents that share a fingerprint with any passage and hold one of these words, in any spelling that
a run takes for it; for a passage without, the documents that share a fingerprint with it.

Instructions that many items share and the questions at the end are no part of a passage. A sentence of several items is taken for
an instruction if what most of these have in common is shorter than what they differ in, so that a passage which many items share
is none, whether its questions end in a question mark or not.

Defined cases
    * null, blank and short texts and passages without words give no row; each (document, item) is given once;
    * typing forms do not matter: case, marks, mark-up, quoting, line breaks inside words, numbers in words or digits;
    * exact and near copies of a document are each reported; very long texts are searched whole;
    * items with the same passage are all reported; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinweave.llm.canonical import SENT_BLOCKS, blocks, edits
from basinweave.session import stable

K, WINDOW = 3, 3
SHARE = 0.33
#: Words that a run must have to count.
RUN_WORDS = 6
#: A sentence that so many items have may be an instruction.
STOCK_ITEMS = 5
#: A word is distinctive if at most this share of the different sentences of passages have it, or only one.
RARE = 0.01
#: Passages that one row compares with a document; further ones go into further rows.
TESTS = 256
#: Ids of candidate documents and fingerprints of passages are sent to all executors up to this number (16 MB), words up to ``SENT_BLOCKS``.
MAX_SENT_IDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n[\s>|*#]*(?=[^\W\d_])")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, ord("'"), 0x2019, 0x2018, 0x02BC, ord("*")])
_NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_RARE = re.compile(r"[<&\xad​-‍⁠﻿*'’‘ʼ]|-\s*\n|‐")


def words_of(text: str) -> list[str]:
    """Words of a text in one form."""
    if _RARE.search(text):
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        text = _BREAK.sub("", text).translate(_INVISIBLE)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = _WORD.findall(text.lower())
    return [_NUMBERS.get(w, w) for w in words] if not _NUMBERS.keys().isdisjoint(words) else words


class _WordHashes(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) >= 1_000_000:
            self.clear()
        self[w] = h
        return h


def fingerprints(words: list[str], hashes: _WordHashes, window: int = WINDOW) -> np.ndarray:
    """Distinct winnowed hashes of all runs of ``K`` words, as signed 64-bit numbers."""
    n = len(words) - K + 1
    if n <= 0:
        return np.empty(0, np.int64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = a[:n].copy()
    for j in range(1, K):
        h = h * np.uint64(0x9E3779B97F4A7C15) ^ (a[j : n + j] + np.uint64(0x632BE59BD9B4E019 * j % 2**64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    w = min(window, n)
    low = h[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(low, h[j : n - w + 1 + j], out=low)
    return np.unique(low).view(np.int64)


def fingerprint_table(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print) of all runs of ``K`` words of the texts; no shuffle."""
    id_type = texts.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [fingerprints(words_of(t), hashes, 1) if t else np.empty(0, np.int64) for t in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                prints = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(prints)], names=["id", "print"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(run, f"id {id_type}, print long")


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, passage): each item's text without shared instructions and the questions at its end."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                sentences = [s.strip() for s in _SENTENCE.split(t) if s.strip()]
                while sentences and sentences[-1].endswith("?"):
                    sentences.pop()
                rows += [(i, n, s, len(words_of(s))) for n, s in enumerate(sentences)]
            yield pd.DataFrame(rows, columns=["item_id", "n", "sentence", "size"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    kept = stable(rows.distinct().mapInPandas(split, "item_id long, n int, sentence string, size int"))
    own = kept.select("item_id", "sentence", "size").distinct()
    many = own.groupBy("sentence").agg(F.count("*").alias("items")).where(F.col("items") >= STOCK_ITEMS)
    at = own.join(many, "sentence").select("item_id", F.col("sentence").alias("stock"), "items")
    beside = at.join(own, "item_id").groupBy("stock", "items", "sentence", "size").agg(F.count("*").alias("c"))
    shared = 2 * F.col("c") >= F.col("items")
    part = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    sums = beside.groupBy("stock").agg(part(shared, F.col("size")).alias("common"), part(~shared, F.col("c") * F.col("size") / F.col("items")).alias("differing"))
    kept = kept.join(sums.where("common < differing").select(F.col("stock").alias("sentence")), "sentence", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("n", "sentence")))
    return kept.groupBy("item_id").agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["sentence"])).alias("passage"))


def distinctive_words(texts: DataFrame) -> DataFrame:
    """(pid, passage, rare): the distinctive words of each passage."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, s, w) for i, t in zip(pdf["pid"], pdf["passage"]) for s in _SENTENCE.split(t) for w in set(words_of(s)) if w.isalpha() and len(w) > 3]
            yield pd.DataFrame(rows, columns=["pid", "sentence", "word"])

    each = stable(texts.mapInPandas(words, "pid long, sentence string, word string"))
    most = max(1, int(RARE * each.select("sentence").distinct().count()))
    few = each.groupBy("word").agg(F.countDistinct("sentence").alias("n")).where(F.col("n") <= most).select("word")
    rare = each.select("pid", "word").distinct().join(few, "word").groupBy("pid").agg(F.collect_list("word").alias("rare"))
    return texts.join(rare, "pid", "left").select("pid", "passage", F.coalesce("rare", F.array().cast("array<string>")).alias("rare"))


def _same(a: str, b: str) -> bool:
    return a == b or (len(a) > 3 and len(b) > 3 and a[:1].isalpha() and edits(a, b, 1 if min(len(a), len(b)) < 8 else 2) <= (1 if min(len(a), len(b)) < 8 else 2))


#: How two texts may go on after a difference: words skipped in the document, words skipped in the passage.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2), (3, 2), (2, 3), (3, 1), (1, 3))


def _extend(doc: list[str], item: list[str], rare: frozenset[str], d: int, i: int, step: int) -> tuple[list[int], int]:
    """Positions of the passage matched from (d, i) on, forwards or backwards, and where the run ends in the document."""
    got: list[int] = []
    nd, ni = len(doc), len(item)
    end = d - step
    while 0 <= d < nd and 0 <= i < ni:
        if _same(doc[d], item[i]):
            got.append(i)
            end = d
            d, i = d + step, i + step
            continue
        for a, b in _STEPS:
            x, y = d + a * step, i + b * step
            if not (0 <= x < nd and 0 <= y < ni and doc[x] == item[y]):
                continue
            if any(item[z] in rare for z in range(i, y, step)):
                continue
            x2, y2 = x + step, y + step
            if len(item[y]) > 3 or not 0 <= y2 < ni or (0 <= x2 < nd and _same(doc[x2], item[y2])):
                d, i = x, y
                break
        else:
            break
    return got, end


def matched_share(doc: list[str], item: list[str], rare: frozenset[str] = frozenset()) -> float:
    """Share of the passage's words that runs in the document cover, in order; ``rare`` are its distinctive words."""
    if len(item) < K or len(doc) < K:
        return 0.0
    seeds: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(item) - K + 1):
        seeds[tuple(item[i : i + K])].append(i)
    runs: list[tuple[int, int, frozenset[int]]] = []
    covered: set[tuple[int, int]] = set()
    grams = zip(*(doc[j:] for j in range(K)))
    for d, gram in enumerate(grams):
        for i in seeds.get(gram, ()):
            if (d, i) in covered:
                continue
            ahead, end = _extend(doc, item, rare, d, i, 1)
            back, start = _extend(doc, item, rare, d - 1, i - 1, -1)
            got = frozenset(ahead) | frozenset(back)
            covered.update((d + x - i, x) for x in ahead)
            for x in ahead:
                covered.update((d + x - i + s, x) for s in (-2, -1, 1, 2))
            if len(got) >= min(RUN_WORDS, len(item)) and (not rare or any(item[x] in rare for x in got)):
                runs.append((min(start, d), max(end, d), got))
    # the best sequence of runs that go on in both texts: for each place in the passage, the best that ends there so far
    runs.sort(key=lambda r: (r[0], r[1]))
    ended: list[tuple[int, int, frozenset[int]]] = []  # by end in the document: sequences that a run may not follow yet
    best: list[frozenset[int]] = [frozenset()] * len(item)
    most = 0
    for k, (a, b, got) in enumerate(runs):
        while ended and ended[0][0] < a + 3:
            both = heapq.heappop(ended)[2]
            if len(both) > len(best[max(both)]):
                best[max(both)] = both
        top = got
        for held in best[: min(got) + 4]:
            if len(held) + len(got) > len(top) and len(both := held | got) > len(top):
                top = both
        most = max(most, len(top))
        heapq.heappush(ended, (b, k, top))
    return most / len(item)


def _sent(few: DataFrame, most: int) -> DataFrame:
    """A table, written once, that is sent to all executors if it has at most so many rows; a larger one is joined like any table."""
    few = stable(few)
    return F.broadcast(few) if few.count() <= most else few


def _reach(word: str) -> int:
    """Edits that ``_same`` may allow a word."""
    return 1 if len(word) < 8 else 2


def spellings(words: DataFrame, rare: DataFrame) -> DataFrame:
    """(word, rare): all pairs of a word of documents and a distinctive word that ``_same`` takes for one."""

    def expand(known: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(w, b) for w in pdf.iloc[:, 0] for b in blocks(w, _reach(w), known)]
                yield pd.DataFrame(rows, columns=["rare" if known else "word", "block"])

        return run

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[_same(w, r) for w, r in zip(pdf["word"], pdf["rare"])]]

    listed = _sent(rare.mapInPandas(expand(True), "rare string, block string"), SENT_BLOCKS)
    met = words.mapInPandas(expand(False), "word string, block string").join(listed, "block").select("word", "rare").distinct()
    return met.mapInPandas(verify, "word string, rare string")


def candidates(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, pid): every pair of a document and a passage (pid, passage, rare) for which ``matched_share`` may not be 0, once."""
    plain = F.size("rare") == 0
    prints = stable(fingerprint_table(told.select(F.struct("pid", plain.alias("plain")).alias("of"), "passage"), "of", "passage"))
    prints = prints.select("print", "id.pid", "id.plain")
    known = _sent(prints.groupBy("print").agg(F.max("plain").alias("plain")), MAX_SENT_IDS)
    # which fingerprint it was matters only for passages without distinctive words
    hits = fingerprint_table(docs, "doc_id", "text").join(known, "print").select(F.col("id").alias("doc_id"), F.when(F.col("plain"), F.col("print")).alias("print"))
    hits = stable(hits.distinct())
    by_print = hits.join(prints.where("plain").select("print", "pid"), "print").select("doc_id", "pid")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, w) for i, t in zip(pdf["doc_id"], pdf["text"]) for w in set(words_of(t)) if len(w) > 3 and w[0].isalpha()]
            yield pd.DataFrame(rows, columns=["doc_id", "word"])

    words = docs.join(_sent(hits.select("doc_id").distinct(), MAX_SENT_IDS), "doc_id", "left_semi").mapInPandas(split, "doc_id long, word string")
    rare = stable(told.select("pid", F.explode("rare").alias("rare")))
    near = _sent(spellings(words.select("word").distinct(), rare.select("rare").distinct()), SENT_BLOCKS)
    by_word = words.join(near, "word").select("doc_id", "rare").distinct().join(rare, "rare").select("doc_id", "pid")
    return by_print.unionByName(by_word).distinct()


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", share: float = SHARE, scores: bool = False
) -> DataFrame:
    """(doc_id, item_id) of all documents that hold ``share`` of an item's passage; with its share if ``scores``."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    held = stable(passages(items))
    texts = stable(held.groupBy("passage").agg(F.min("item_id").alias("pid")).select("pid", "passage"))
    told = stable(distinctive_words(texts))
    pairs = candidates(docs, told)
    part = F.floor(F.row_number().over(Window.partitionBy("doc_id").orderBy("pid")) / TESTS).alias("part")
    tests = pairs.select("doc_id", "pid", part).join(told, "pid")
    tests = stable(tests.groupBy("doc_id", "part").agg(F.collect_list(F.struct("pid", "passage", "rare")).alias("tests")))
    if tests.count() <= MAX_SENT_IDS:  # few candidates: texts of the others need not be shuffled; with many, the join below does it alone
        docs = docs.join(F.broadcast(tests.select("doc_id").distinct()), "doc_id", "left_semi")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[list[str], frozenset[str]]] = {}
        for pdf in batches:
            out = []
            for key, text, tests_ in zip(pdf["doc_id"], pdf["text"], pdf["tests"]):
                doc = words_of(text)
                for t in tests_:
                    item = known.get(t["pid"])
                    if item is None:
                        item = known[t["pid"]] = words_of(t["passage"]), frozenset(t["rare"])
                    s = matched_share(doc, *item)
                    if s >= share:
                        out.append((key, t["pid"], s))
            yield pd.DataFrame(out, columns=["doc_id", "pid", "share"])
            if len(known) > 20_000:
                known.clear()

    found = docs.join(tests, "doc_id").mapInPandas(verify, "doc_id long, pid long, share double")
    found = found.join(held.join(texts, "passage").select("pid", "item_id"), "pid").select("doc_id", "item_id", "share")
    return found if scores else found.select("doc_id", "item_id").distinct()
