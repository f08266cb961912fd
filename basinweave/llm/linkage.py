"""Variant spellings of persons and organisations, linked.

Names are read into fields (``naming``); then spellings of one token (a surname, a place) are linked by suffix blocking:
each token is indexed by suffixes of about half its length, and by the same of its reverse, which one typing error leaves
intact on one side. Suffixes are only ever used together with another field (the initial of the given name, the kind of
organisation); those that more than ``MAX_BLOCK`` tokens share even so are refined by the rest of the token with as many letters left
out as may differ. Pairs of a block are compared by the ratio of their longest common subsequence. Each spelling points to the most
frequent spelling near it, and pointers are followed to their end, so that links never chain through unlike names.

A person is a surname with a given name; people change their organisation more often than two of one name meet, so a different
organisation alone does not part them. Initials are completed from the address, else from the only person of that surname and
initial, with those at the same organisation before all others. Where middle initials contradict, mentions stay apart.

All of this is done on profiles, the different combinations of a name with an affiliation, and not on mentions; these are joined to
their profile's person once, at the end. Groups are only ever joined on or streamed, never collected: a block is held up to
``MAX_BLOCK`` tokens. ``person_classes`` and ``organisation_classes`` give one row for each mention or spelling; the pairs asked for
are derived from these last.

Defined cases
    * null and blank names are no mentions; null, blank and '-' affiliations are none; authors that are null keep their position;
    * repeated and updated rows of one key count once for each spelling; exact copies of a spelling are not pairs;
    * equal frequencies are settled by the token itself; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinweave.llm import naming
from basinweave.llm.canonical import deletions
from basinweave.session import stable

MIN_SUFFIX, SHORT, MAX_BLOCK = 3, 7, 200
RATIO = 0.8
#: A given name is taken for a misspelling of one that is so many times as frequent.
GIVEN_RATIO = 8


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = at.get(y, 0)
        row = ((row + (row & match)) | (row & ~match)) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths: 1 for equal tokens."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def block_keys(token: str) -> list[tuple[str, str]]:
    """(key, rest) of a token: suffixes of about half its length, of it and of its reverse; short ones with a letter left out."""
    n = len(token)
    out = [("~" + d, "") for d in deletions(token, 1)] if n <= SHORT else []
    for size in sorted({max(MIN_SUFFIX, n // 2 - 1), max(MIN_SUFFIX, n // 2), max(MIN_SUFFIX, (n - 1) // 2)}):
        if size < n:
            out += [("<" + token[-size:], token[:-size]), (">" + token[:size], token[size:])]
    return out or [("=" + token, "")]


def letter_set(token: str) -> int:
    """The letters of a token as bits; letters may share one."""
    out = 0
    for x in token:
        out |= 1 << (ord(x) & 63)
    return out


_PAIR = "scope string, a string, b string, na long, nb long, lost int"


def near_pairs(tokens: DataFrame, max_block: int = MAX_BLOCK, most: int = 2) -> DataFrame:
    """(scope, a, b, na, nb, lost): pairs of tokens of one scope and block that differ by at most ``most`` letters; ``lost`` counts them.

    ``tokens``: scope, token, n. Blocks are streamed in order, so the keys are shuffled once. Of blocks of more than ``max_block``
    tokens the key is refined by the rest of the token with up to ``most`` letters left out. Tokens of a block that differ by that
    many have such a rest in common, the letters that their rests share in order; so no block is cut and no pair is lost.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, k, t, n, r) for s, t, n in zip(pdf["scope"], pdf["token"], pdf["n"]) for k, r in dict(block_keys(t)).items()]
            yield pd.DataFrame(rows, columns=["scope", "key", "token", "n", "rest"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = zip(pdf["scope"], pdf["key"], pdf["token"], pdf["n"], pdf["rest"])
            rows = [(s, f"{k}|{d}", t, n) for s, k, t, n, r in each for d in deletions(r, most) | ({""} if len(r) <= most else set())]
            yield pd.DataFrame(rows, columns=["scope", "key", "token", "n"])

    def compared(a: str, b: str) -> int | None:
        if abs(len(a) - len(b)) > most:
            return None
        common = lcs(a, b)
        lost = max(len(a), len(b)) - common
        return lost if lost <= most and (2 * common >= RATIO * (len(a) + len(b)) or (lost == 1 and min(len(a), len(b)) >= 3)) else None

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = zip(pdf["scope"], pdf["a"], pdf["b"], pdf["na"], pdf["nb"])
            rows = [(s, a, b, m, n, lost) for s, a, b, m, n in each if (lost := compared(a, b)) is not None]
            yield pd.DataFrame(rows, columns=["scope", "a", "b", "na", "nb", "lost"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of the blocks that are small enough; of the others each token, without a partner."""
        held: list[tuple[str, int, str, int]] = []
        at: tuple[str, str] | None = None
        large = False
        out: list[tuple] = []

        def close() -> None:
            for i, (a, m, _, letters) in enumerate(held):
                for b, n, _, others in held[i + 1 :]:
                    # each letter of one that the other lacks is lost
                    if (letters ^ others).bit_count() <= 2 * most and (lost := compared(a, b)) is not None:
                        out.append((at[0], None, None, a, b, m, n, lost) if a < b else (at[0], None, None, b, a, n, m, lost))
            held.clear()

        for pdf in batches:
            for s, k, t, n, r in zip(pdf["scope"], pdf["key"], pdf["token"], pdf["n"], pdf["rest"]):
                if (s, k) != at:
                    close()
                    at, large = (s, k), False
                if not large:
                    held.append((t, n, r, letter_set(t)))
                    large = len(held) > max_block
                    if large:
                        out += [(s, k, z, x, None, y, None, None) for x, y, z, _ in held]
                        held.clear()
                else:
                    out.append((s, k, r, t, None, n, None, None))
            yield pd.DataFrame([(s, k, r, a, b, m, n, lost) for s, k, r, a, b, m, n, lost in out], columns=_STREAMED)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=_STREAMED)

    keyed = tokens.select("scope", "token", "n").mapInPandas(keys, "scope string, key string, token string, n long, rest string")
    keyed = keyed.repartition("scope", "key").sortWithinPartitions("scope", "key", "token")
    seen = stable(keyed.mapInPandas(stream, "scope string, key string, rest string, a string, b string, na long, nb long, lost int"))
    few = seen.where("b is not null").select("scope", "a", "b", "na", "nb", "lost")
    rest = seen.where("b is null").select("scope", "key", F.col("a").alias("token"), F.col("na").alias("n"), "rest")
    rows = rest.mapInPandas(refine, "scope string, key string, token string, n long")
    left, right = (rows.select("scope", "key", F.col("token").alias(x), F.col("n").alias("n" + x)) for x in "ab")
    pairs = left.join(right, ["scope", "key"]).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= most))
    many = pairs.select("scope", "a", "b", "na", "nb").distinct().mapInPandas(compare, _PAIR)
    return few.unionByName(many).distinct()


_STREAMED = ["scope", "key", "rest", "a", "b", "na", "nb", "lost"]


def follow_pointers(parents: DataFrame) -> DataFrame:
    """(scope, token, root): pointers followed to their end, doubling the way each round until none goes on; they may form no circle."""
    roots = parents.select("scope", "token", F.col("parent").alias("root"))
    while True:
        step = roots.select("scope", F.col("token").alias("root"), F.col("root").alias("next"))
        roots = stable(roots.join(step, ["scope", "root"], "left").select("scope", "token", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if roots.where("on").isEmpty():
            return roots.drop("on")
        roots = roots.drop("on")


def canonical_tokens(pairs: DataFrame, times: float = 1.0) -> DataFrame:
    """(scope, token, root) for the tokens that are variants: each points to the most frequent token near it."""
    ways = (("a", "b"), ("b", "a"))
    both = pairs.select("scope", F.explode(F.array(*[F.struct(F.col(x).alias("token"), F.col("n" + x).alias("n"), F.col(y).alias("other"), F.col("n" + y).alias("m")) for x, y in ways])).alias("p"))
    both = both.select("scope", "p.*")
    up = (F.col("m") > F.col("n") * times) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("token")) & F.lit(times <= 1))
    return follow_pointers(stable(both.where(up).groupBy("scope", "token").agg(F.max_by("other", F.struct("m", F.col("other"))).alias("parent"))))


def _joined_root(df: DataFrame, roots: DataFrame, scope: str, token: str, out: str) -> DataFrame:
    r = roots.select(F.col("scope").alias(scope), F.col("token").alias(token), F.col("root").alias("_root"))
    return df.join(r, [scope, token], "left").withColumn(out, F.coalesce("_root", token)).drop("_root")


# --- organisations ---------------------------------------------------------------------------------------------------------


def organisations(affiliations: DataFrame) -> DataFrame:
    """(affiliation, kind, place) of each distinct affiliation as written; ``place`` in its most frequent spelling."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, n, *p) for a, n in zip(pdf["affiliation"], pdf["n"]) if (p := naming.organisation_parts(a))]
            yield pd.DataFrame(rows, columns=["affiliation", "n", "kind", "place"])

    distinct = affiliations.where("affiliation is not null").groupBy("affiliation").agg(F.count("*").alias("n"))
    parsed = stable(distinct.mapInPandas(parse, "affiliation string, n long, kind string, place string"))
    tokens = parsed.where("place != ''").groupBy(F.col("kind").alias("scope"), F.col("place").alias("token")).agg(F.sum("n").alias("n"))
    roots = canonical_tokens(near_pairs(tokens, most=1))
    return stable(_joined_root(parsed, roots, "kind", "place", "org_place").select("affiliation", "kind", F.col("org_place").alias("place")))


def organisation_classes(orgs: DataFrame) -> DataFrame:
    """(key, class, links) of each affiliation of ``orgs``: its organisation, and how many other spellings this has."""
    told = orgs.where("place != ''").select(F.col("affiliation").alias("key"), F.concat_ws("|", "kind", "place").alias("class"))
    return told.join(told.groupBy("class").agg((F.count("*") - 1).alias("links")), "class").select("key", "class", "links")


def organisation_pairs(affiliations: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b) of different affiliations, as written, of one organisation; ``orgs`` is given where it is known."""
    orgs = (organisations(affiliations) if orgs is None else orgs).where("place != ''")
    a = orgs.select("kind", "place", F.col("affiliation").alias("key_a"))
    b = orgs.select("kind", "place", F.col("affiliation").alias("key_b"))
    return a.join(b, ["kind", "place"]).where("key_a < key_b").select("key_a", "key_b")


# --- persons ---------------------------------------------------------------------------------------------------------------

_MENTION = "key string, name string, affiliation string, surname string, given string, middle string, comma boolean, mail string"
_PROFILE = ["name", "affiliation", "mail"]


def read_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions (key, name, affiliation, email) with the fields of their names; blank names are left out.

    ``mail`` is what the address may say of the given name, where that is only an initial; '' else.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, name, affiliation, email in zip(pdf["key"], pdf["name"], pdf["affiliation"], pdf["email"]):
                parts = naming.person_parts(name)
                if parts is None:
                    continue
                mail = ""
                if len(parts[1]) == 1:
                    local = naming.email_parts(email)
                    head, dot, _ = local.partition(".")
                    letters = local.rstrip("0123456789")
                    mail = head if dot and len(head) > 1 else letters if "." not in letters else ""
                rows.append((key, name, affiliation or "", *parts, "," in name, mail))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MENTION.split(", ")])

    return mentions.where("key is not null and name is not null").select("key", "name", "affiliation", "email").mapInPandas(parse, _MENTION)


def persons(mentions: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """(key, name, person): the person of each mention (key, name, affiliation, email); ``orgs`` is given where it is known."""
    read = stable(read_mentions(mentions).distinct())
    profiles = stable(read.groupBy("name", "affiliation", "surname", "given", "middle", "comma", "mail").agg(F.count("*").alias("n")))
    orgs = organisations(mentions.select("affiliation")) if orgs is None else orgs
    return read.select("key", *_PROFILE).join(_profile_persons(profiles, orgs), _PROFILE).select("key", "name", "person")


def _given_words(profiles: DataFrame) -> DataFrame:
    """(word, as_given, as_last, known, root) of the words of names: how often each is a given name and a surname, whether it is
    known as a given name, and the one that it is a misspelling of."""
    zero = F.lit(0).cast("long")
    as_given = F.when(F.length("given") > 2, F.struct(F.col("given").alias("word"), F.col("n").alias("g"), zero.alias("l")))
    as_last = F.when(~F.col("comma") & (F.col("given") != ""), F.struct(F.col("surname").alias("word"), zero.alias("g"), F.col("n").alias("l")))
    each = profiles.select(F.explode(F.array_compact(F.array(as_given, as_last))).alias("w")).select("w.*")
    words = stable(each.groupBy("word").agg(F.sum("g").alias("as_given"), F.sum("l").alias("as_last")).where("as_given > 0"))
    tokens = words.where("as_given * 3 >= as_last").select(F.lit("").alias("scope"), F.col("word").alias("token"), F.col("as_given").alias("n"))
    roots = canonical_tokens(near_pairs(tokens, most=1), GIVEN_RATIO).select(F.col("token").alias("word"), F.col("root"))
    known = F.col("as_given") >= 3 + 2 * F.col("as_last")
    return stable(words.join(roots, "word", "left").select("word", "as_given", "as_last", known.alias("known"), F.coalesce("root", "word").alias("root")))


def _profile_persons(profiles: DataFrame, orgs: DataFrame) -> DataFrame:
    """(name, affiliation, mail, person) of all profiles."""
    words = _given_words(profiles)
    of = lambda key, x: words.select(F.col("word").alias(key), *[F.col(c).alias(f"{x}_{c}") for c in ("as_given", "known", "root")])

    # names written the other way round: the last word is known as a given name, the first isn't
    seen = profiles.join(of("given", "g"), "given", "left").join(of("surname", "s"), "surname", "left")
    often = lambda x: F.when(F.col(f"{x}_known"), F.col(f"{x}_as_given")).otherwise(0)
    turn = ~F.col("comma") & (F.length("given") > 1) & (F.coalesce(often("s"), F.lit(0)) > 3 * F.coalesce(often("g"), F.lit(0)))
    # given names: misspellings, and initials that the address completes
    seen = seen.select(
        *_PROFILE, "middle", "n", F.when(turn, F.col("given")).otherwise(F.col("surname")).alias("surname"),
        F.when(turn, F.coalesce("s_root", "surname")).otherwise(F.coalesce("g_root", "given")).alias("given"),
    )
    known = words.where("known").select(F.col("word").alias("mail"), "known")
    complete = (F.length("given") == 1) & F.col("known") & F.col("mail").startswith(F.col("given")) & (F.col("mail") != F.col("surname"))
    seen = seen.join(known, "mail", "left").withColumn("given", F.when(complete, F.col("mail")).otherwise(F.col("given"))).drop("known")
    seen = seen.join(orgs.select("affiliation", F.concat_ws("|", "kind", "place").alias("org")), "affiliation", "left")
    seen = _full_names(stable(seen)).withColumn("initial", F.substring("given", 1, 1)).transform(stable)

    # surnames: spellings near each other, within one initial of the given name; two letters off only with all else equal
    pairs = stable(near_pairs(seen.groupBy(F.col("initial").alias("scope"), F.col("surname").alias("token")).agg(F.sum("n").alias("n"))))
    told = seen.where("length(given) > 1 and org is not null").select(F.col("initial").alias("scope"), "surname", "given", "org").distinct()
    a, b = (told.withColumnRenamed("surname", x) for x in "ab")
    backed = pairs.where("lost = 2").join(a, ["scope", "a"]).join(b, ["scope", "b", "given", "org"], "left_semi").select(*pairs.columns).distinct()
    seen = stable(_joined_root(seen, canonical_tokens(pairs.where("lost <= 1").unionByName(backed)), "initial", "surname", "family"))

    # initials: the only person of the surname and initial, those at the same organisation first
    full = seen.where("length(given) > 1").select("family", "initial", "given", "org").distinct()
    at_org = full.where("org is not null").groupBy("family", "initial", "org").agg(F.count("*").alias("n_org"), F.min("given").alias("g_org"))
    anywhere = full.groupBy("family", "initial").agg(F.min("given").alias("g_all"), F.max("given").alias("g_last"))
    short = seen.where("length(given) <= 1").join(at_org, ["family", "initial", "org"], "left").join(anywhere, ["family", "initial"], "left")
    who = (
        F.when(F.col("n_org") == 1, F.col("g_org"))
        .when(F.col("g_all") == F.col("g_last"), F.col("g_all"))
        .when(F.col("g_all").isNull(), F.col("given"))
        .otherwise(F.concat_ws("@", "given", F.coalesce("org", F.lit(""))))
    )
    rest = [*_PROFILE, "middle", "n", "family"]
    seen = seen.where("length(given) > 1").select(*rest, F.col("given").alias("who")).unionByName(short.select(*rest, who.alias("who"))).transform(stable)

    # middle initials: one that contradicts the person's usual one is another person
    usual = seen.where("middle != ''").groupBy("family", "who", "middle").agg(F.sum("n").alias("n"))
    usual = usual.groupBy("family", "who").agg(F.max_by("middle", F.struct("n", "middle")).alias("usual"))
    seen = seen.join(usual, ["family", "who"], "left")
    apart = (F.col("middle") != "") & (F.substring("middle", 1, 1) != F.substring("usual", 1, 1))
    return seen.select(*_PROFILE, F.concat_ws("|", "family", "who", F.when(apart, F.col("middle")).otherwise(F.lit(""))).alias("person"))


def _full_names(seen: DataFrame) -> DataFrame:
    """Short forms of given names replaced: by a full name that the surname has, at the organisation first, else by the usual one."""
    named = seen.where("length(given) > 1")
    usual = named.groupBy("given").agg(F.sum("n").alias("n"))
    own = usual.select(F.col("given").alias("short"), F.col("n").alias("n_own"))
    forms = seen.sparkSession.createDataFrame(naming.NICKNAMES, "short string, full string")  # fixed, a few hundred rows
    forms = usual.withColumnRenamed("given", "full").join(F.broadcast(forms), "full").join(own, "short", "left")
    # the short form itself counts as often as it is used as a name, so that names which are no short forms here stay
    forms = stable(forms.select("short", "full", "n", (F.coalesce("n_own", F.lit(0)) < F.col("n")).alias("rarer")))
    asked = seen.select("surname", F.col("given").alias("short"), F.coalesce("org", F.lit("")).alias("at")).distinct().join(F.broadcast(forms), "short")
    here = named.select("surname", F.col("given").alias("full"), F.coalesce("org", F.lit("")).alias("at")).distinct()
    at_org = here.where("at != ''").withColumn("at_org", F.lit(True))
    anywhere = here.select("surname", "full").distinct().withColumn("anywhere", F.lit(True))
    chosen = asked.join(at_org, ["surname", "full", "at"], "left").join(anywhere, ["surname", "full"], "left")
    rank = F.struct(F.col("at_org").isNotNull(), F.col("anywhere").isNotNull(), "n", "full")
    chosen = chosen.groupBy("surname", "short", "at").agg(F.max_by(F.struct("full", "rarer"), rank).alias("c")).where("c.rarer")
    chosen = chosen.select("surname", F.col("short").alias("given"), "at", F.col("c.full").alias("full"))
    joined = seen.withColumn("at", F.coalesce("org", F.lit(""))).join(chosen, ["surname", "given", "at"], "left")
    return joined.withColumn("given", F.coalesce("full", "given")).drop("full", "at")


def person_classes(who: DataFrame) -> DataFrame:
    """(key, class, links) of each mention of ``who`` (key, name, person): its person, and how many mentions have another spelling."""
    spelled = who.select("key", "name", "person").distinct()
    per_name = spelled.groupBy("person", "name").agg(F.count("*").alias("n"))
    per_person = per_name.groupBy("person").agg(F.sum("n").alias("total"))
    links = per_name.join(per_person, "person").select("person", "name", (F.col("total") - F.col("n")).alias("links"))
    return spelled.join(links, ["person", "name"]).groupBy("key", F.col("person").alias("class")).agg(F.max("links").alias("links"))


def person_pairs(mentions: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b) of mentions of one person whose names, as written, differ."""
    who = stable(persons(mentions, orgs))
    # spellings meet first, so mentions of one spelling, however many, never meet each other
    spelled = who.select("person", "name").distinct()
    pairs = spelled.withColumnRenamed("name", "name_a").join(spelled.withColumnRenamed("name", "name_b"), "person").where("name_a < name_b")
    a = who.select("person", F.col("name").alias("name_a"), F.col("key").alias("k1"))
    b = who.select("person", F.col("name").alias("name_b"), F.col("key").alias("k2"))
    found = pairs.join(a, ["person", "name_a"]).join(b, ["person", "name_b"]).where("k1 != k2")
    return found.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def all_mentions(applications: DataFrame, papers: DataFrame) -> DataFrame:
    """(key, name, affiliation, email) of applicants and authors."""
    people = applications.select(F.col("id").alias("key"), "name", "affiliation", "email")
    authors = papers.select("paper_id", F.posexplode("authors").alias("at", "author")).select(
        F.concat("paper_id", F.lit("#"), F.col("at").cast("string")).alias("key"),
        F.col("author.name").alias("name"),
        F.col("author.affiliation").alias("affiliation"),
        F.lit(None).cast("string").alias("email"),
    )
    return people.unionByName(authors)
