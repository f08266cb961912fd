"""Keyword-stuffed pages and pages of links, tags or product lines.

The gaps between the occurrences of each term are measured over the whole page. Writing reuses its content words irregularly and far
apart; stuffing brings them back at short or at regular lags. The words of a page are judged in windows; one is stuffed if
    * content words recur within ``SHORT_LAG`` words (the positional autocorrelation over these lags) too often,
    * or recur within ``LONG_LAG`` words almost always while function words are few,
    * or most content words recur regularly: the gaps of their term hardly vary (``EVEN``), or their lag, to the occurrence before or
      the one before that, lies in a window of lags, anywhere up to the length of the page, in which the autocorrelation of the whole
      page has a peak (``PEAK``),
    * or function words are all but absent and there are no sentences either: a list of distinct nouns, links, tags or products.
      Sentences are told by their ends, so that prose in a language whose function words are not listed is none.
A page is reported if stuffed windows hold more than ``SHARE`` of its words. Numbered references, table rows and headers say
nothing either way and are left out; an address is one word in its window and ``URL_WORDS`` in the share.

One pass without shuffle; nothing about the corpus is needed.

Defined cases: null and blank texts and pages with fewer than ``LEAST_WORDS`` words are never reported; a page at exactly
``SHARE`` is not; very long texts are read whole; repeated rows are given once; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SHORT_LAG, LONG_LAG = 24, 5, 24
SHORT_RECUR, LONG_RECUR, REGULAR = 0.4, 0.6, 0.6
#: Regular recurrence: greatest deviation of a term's gaps, by their mean, from this many gaps on; least share of the content words
#: in one window of lags (of lags that the page holds so many times), ``WINDOW`` of them at least, and the width of these windows by the lag.
EVEN, EVEN_GAPS, PEAK, LAG_WIDTH = 0.25, 6, 0.25, 0.05
#: Words of a sentence at least, on average, where its ends are taken for those of prose.
SENTENCE_WORDS = 4
FEW_FUNCTION, SOME_FUNCTION, CJK_FUNCTION = 0.08, 0.2, 0.035
SHARE, LEAST_WORDS, URL_WORDS = 0.5, 25, 4

#: Common function words of English, Spanish, French, German, Portuguese, Italian and Dutch (fixed values).
FUNCTION_WORDS = frozenset(
    """a an the of to in on at by for with from into onto over under about between after before during without within through against
    and or but nor so yet if than that which who whom whose this these those there here when where while although because as since once
    is are was were be been being am do does did has have had can could may might will would shall should must not no
    it its he she they we you i his her their our your my them him however also more most each every some any all both such only
    el la los las un una unos unas de del al en con por para sin sobre entre desde hasta y o pero que como su sus se es son fue ser ha han lo más muy no si según
    l d n c j qu s t à le les des du au aux dans sur avec pour par sans sous entre et ou mais que qui dont ce cette ces il elle ils elles est sont a été ont ne plus encore près autre se sa son ses leur
    der die das den des ein eine einer einem einen im in am an auf aus bei mit nach seit von vor zu zum zur über unter für gegen ohne um durch und oder aber
    dass wenn weil als wie ist sind war waren wird werden wurde hat haben hatte nicht kein keine sich es er sie wir ihr ab rund bisher vor auch noch nur
    o os as um uma do da dos das no na nos nas em com e il lo gli dei della nel nella con che di per het een van en op te met voor""".split()
)
_PARTICLES = frozenset("的了在是和与为於于及或但而被把从对由也都就着过其此该中仍已将")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_TOKEN = re.compile(r"[.!?…](?=[\"'”»)\]]*(?:\s|$))|[。！？]|https?://\S+|www\.\S+|[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+", re.I)
_URL = "\x00url"
#: Marks that end a sentence, where the pattern of tokens finds them.
_ENDS = ".!?…。！？"
_TAG = re.compile(r"<[/a-z!][^<>]{0,2000}>", re.I)
_NEUTRAL = re.compile(r"^\s*(?:#{1,6}\s|\||\[\d+\]|\d{1,3}[.)]\s.*\(\d{4}\)|[-=*_\s]{3,}$)")


def page_words(text: str) -> list[str]:
    """Words of the lines that count, and ends of sentences; a tag with an address in it is that address, others are blanks."""
    if "<" in text:
        text = _TAG.sub(lambda m: " http://x " if "http" in m[0] else " ", text)
    lines = [line for line in text.splitlines() if not _NEUTRAL.match(line)]
    return [_URL if w[:4] == "http" or w[:4] == "www." else w for w in _TOKEN.findall("\n".join(lines).lower())]


def _recurrences(codes: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content words in the order of their terms, and their terms; within a term in the order of the page."""
    at = np.flatnonzero(content)
    order = at[np.argsort(codes[at], kind="stable")]
    return order, codes[order]


def regular_words(n: int, order: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Whether each word of a page of ``n`` words recurs regularly; ``order`` and ``term`` as from ``_recurrences``."""
    regular = np.zeros(n, bool)
    same = term[1:] == term[:-1]
    gaps, of = np.diff(order)[same].astype(float), term[1:][same]
    if len(gaps) < EVEN_GAPS:
        return regular
    # gaps of each term, and how much they vary
    size = int(term[-1]) + 1
    count = np.bincount(of, minlength=size)
    if (often := count >= EVEN_GAPS).any():
        mean = np.bincount(of, gaps, size) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(of, gaps * gaps, size) / np.maximum(count, 1) - mean**2, 0))
        regular[order] = (often & (spread <= EVEN * mean))[term]
    # peaks of the autocorrelation, over lags to the last occurrence and the one before it
    least = max(PEAK * len(order), WINDOW)
    for step in (1, 2):
        hit = np.flatnonzero((term[step:] == term[:-step]) & ((order[step:] - order[:-step]) * (EVEN_GAPS + 1) <= n))
        if len(hit) < least:
            continue
        late, early = order[step:][hit], order[hit]
        lag = np.log(late - early) / np.log1p(LAG_WIDTH)
        for shift in (0.0, 0.5):  # windows of lags as wide as LAG_WIDTH of the lag, and the same shifted by half
            bins = (lag + shift).astype(np.int64)
            hot = (np.bincount(bins) >= least)[bins]
            regular[late[hot]] = True
            regular[early[hot]] = True
    return regular


_FUNCTION, _PARTICLE, _ENDED = -1, -3, -2
_FIXED = dict.fromkeys(FUNCTION_WORDS, _FUNCTION) | dict.fromkeys(_PARTICLES, _PARTICLE) | dict.fromkeys(_ENDS, _ENDED)


def page_weights(tokens: list[str]) -> tuple[int, int]:
    """(words in stuffed windows, all words); an address counts as ``URL_WORDS``.

    The gap of a word within short lags is that to its nearest occurrence on either side.
    """
    number: dict[str, int] = {}
    raw = np.array([_FIXED[w] if w in _FIXED else number.setdefault(w, len(number)) for w in tokens], np.int64)
    is_end = raw == _ENDED
    codes = raw[~is_end]
    n = len(codes)
    if not n:
        return 0, 0
    function = (codes == _FUNCTION) | (codes == _PARTICLE)
    order, term = _recurrences(codes, ~function)
    near, far = np.zeros(n, bool), np.zeros(n, bool)  # recurs within SHORT_LAG, within LONG_LAG
    hit = np.flatnonzero(term[1:] == term[:-1])
    gap = order[hit + 1] - order[hit]
    for mark, lag in ((near, SHORT_LAG), (far, LONG_LAG)):
        close = hit[gap <= lag]
        mark[order[close]] = True
        mark[order[close + 1]] = True

    starts = np.arange(0, n, WINDOW)
    per_window = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    size = np.diff(np.append(starts, n))
    few = per_window(function)
    share, content = few / size, size - few
    weight = size + (URL_WORDS - 1) * per_window(codes == number.get(_URL, -9))
    ends = np.flatnonzero(is_end)
    ends = ends - np.arange(len(ends)) - 1  # numbers of the words before them
    closed = np.bincount(ends[ends >= 0] // WINDOW, minlength=len(starts))
    beside = np.zeros(len(starts) + 2, bool)
    beside[1:-1] = closed > 0
    prose = (closed <= size / SENTENCE_WORDS) & ((closed > 0) | (beside[:-2] & beside[2:]))
    short, long = per_window(near), per_window(far)
    stuffed = (
        ((share < FEW_FUNCTION) & ~prose)
        | ((content > 0) & (per_window(regular_words(n, order, term)) >= REGULAR * content))
        | (short >= SHORT_RECUR * content)
        | ((long >= LONG_RECUR * content) & (share < SOME_FUNCTION))
    )
    # Chinese characters recur as parts of different words, so there only the absence of particles tells
    signs = [k for w, k in number.items() if len(w) == 1 and _CJK.match(w)]
    if signs or (codes == _PARTICLE).any():
        sign = np.zeros(len(number) + 1, bool)
        sign[signs] = True
        most = per_window(sign[np.maximum(codes, -1)] | (codes == _PARTICLE)) > size / 2
        stuffed = np.where(most, share < CJK_FUNCTION, stuffed)
    return int(weight[stuffed].sum()), int(weight.sum())


def stuffed_share(text: str | None) -> float:
    """Share of a page's words in stuffed windows; 0 for pages that are too short to tell."""
    if not text:
        return 0.0
    words = page_words(text)
    stuffed, total = page_weights(words)
    return stuffed / total if total >= LEAST_WORDS else 0.0


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scores: bool = False) -> DataFrame:
    """(doc_id) of all stuffed pages; with each page's share if ``scores``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share = [stuffed_share(t) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "share": share})
            yield out if scores else out[out["share"] > SHARE]

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    scored = rows.mapInPandas(run, "doc_id long, share double")
    return scored if scores else scored.select("doc_id").distinct()
