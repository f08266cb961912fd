"""Text functions as native column expressions: sections, chunks, spans, tokens, addresses, slugs. No shuffle, no Python."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers of sections by kind of source, tried in this order.
_BASE = (
    ("abstract", r"(?i)^#\s+(abstract|摘要)"), ("introduction", r"(?i)^#\s+(introduction|引言|背景)"), ("related_work", r"(?i)^#\s+(related\s*work|literature\s*review|相关工作)"),
    ("methods", r"(?i)^#\s+(methods?|methodology|方法)"), ("data", r"(?i)^#\s+(data|datasets?|数据)"), ("study_area", r"(?i)^#\s+(study\s*area|study\s*region|研究区域)"),
    ("results", r"(?i)^#\s+(results?|结果)"), ("discussion", r"(?i)^#\s+(discussion|讨论)"), ("conclusion", r"(?i)^#\s+(conclusions?|结论)"),
    ("references", r"(?i)^#\s+(references|参考文献)"), ("subsection", r"^##\s+(.+)"), ("subsubsection", r"^###\s+(.+)"),
)
_REPORT = (
    ("executive_summary", r"(?i)^#\s+(executive\s*summary|摘要)"), ("key_findings", r"(?i)^#\s+(key\s*findings|主要发现)"), ("recommendations", r"(?i)^#\s+(recommendations?|建议)"),
    ("interventions", r"(?i)^#\s+(interventions?|干预)"), ("governance", r"(?i)^#\s+(governance|治理)"),
)
_NEWS = (("overview", r"(?i)^#\s+(overview|概览)"), ("impact", r"(?i)^#\s+(impact|影响)"), ("response", r"(?i)^#\s+(response|响应)"), ("causes", r"(?i)^#\s+(causes?|原因)"))
IMPORTANCE = {
    "abstract": 0.9, "methods": 0.95, "data": 0.9, "study_area": 0.85, "results": 0.85, "discussion": 0.7, "introduction": 0.6, "conclusion": 0.6, "executive_summary": 0.95,
    "key_findings": 0.9, "recommendations": 0.85, "interventions": 0.9, "governance": 0.85, "impact": 0.9, "overview": 0.85, "response": 0.8, "causes": 0.75, "references": 0.2,
}
STOP_WORDS = "the and for with from that this are was were have has had into over under between using used source section figure table data model".split()
MAX_CHUNK = 8000
#: Tokens of a label or statement that are compared.
MAX_TOKENS = 80


def _alternatives(pattern: str) -> list[str]:
    """The words that a pattern of ``_BASE`` and its like begins a title with."""
    return pattern.partition("(")[2].partition("(")[2].rpartition(")")[0].split("|")


def _spellings(word: str) -> list[str]:
    """A word of a pattern as it is matched, without blanks; both where its last letter may be missing."""
    plain = word.replace(r"\s*", "").lower()
    return [plain[:-1], plain[:-2]] if plain.endswith("?") else [plain]


def _title_reader(*tables: tuple[tuple[str, str], ...]) -> tuple[str, dict[str, str]]:
    """One pattern for the titles of all tables, the first first, and the section type of each word that it may find."""
    words = [(w, name) for table in tables for name, p in table if p.startswith("(?i)") for w in _alternatives(p)]
    names: dict[str, str] = {}
    for w, name in words:
        for x in _spellings(w):
            names.setdefault(x, name)
    return r"(?i)^#\s+(" + "|".join(w for w, _ in words) + ")", names


def header_type(line: Column, source_type: Column) -> Column:
    """Type of section that a line opens; null for other lines. One pattern a line, then a look-up."""

    def first(*tables):
        pattern, names = _title_reader(*tables)
        word = F.lower(F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\s+", ""))
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), word)

    below = F.when(line.startswith("###"), F.when(line.rlike(r"^###\s+(.+)"), F.lit("subsubsection"))).otherwise(F.when(line.rlike(r"^##\s+(.+)"), F.lit("subsection")))
    report = source_type.isin("Report", "Policy")
    title = F.when(report, first(_REPORT, _BASE)).when(source_type == "News", first(_NEWS, _BASE)).otherwise(first(_BASE))
    return F.when(line.startswith("##"), below).otherwise(title)


def importance(section_type: Column) -> Column:
    """Importance of a section type for extraction; 0.5 for others."""
    table = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, section_type), F.lit(0.5))


SECTION = "struct<type:string,title:string,importance:double,start_line:int,end_line:int,text:string>"


def with_sections(df: DataFrame, text: str = "text", source_type: str = "source_type", out: str = "sections") -> DataFrame:
    """Adds the array of sections (type, title, importance, start_line, end_line, text) of a text, in order. No shuffle.

    Text before the first header belongs to no section; a text without headers is one section of type content; null and empty
    texts have none. Lines and headers are columns of their own, so that they are found once for each text.
    """
    lines, heads = F.col("_lines"), F.col("_heads")
    full = F.col(text)
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(x.startswith("#"), x).alias("line")))
    staged = df.withColumn("_lines", F.split(full, "\n", -1)).withColumn("_n", F.size(lines))
    staged = staged.withColumn("_marked", F.filter(marked, lambda s: s["line"].isNotNull()))
    typed = F.transform("_marked", lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"), header_type(s["line"], F.col(source_type)).alias("type")))
    staged = staged.withColumn("_heads", F.filter(typed, lambda s: s["type"].isNotNull()))

    def section(h, k):
        nxt = F.get(heads, k + 1)
        last = nxt.isNull()
        end = F.when(last, F.col("_n")).otherwise(nxt["i"])
        count = end - h["i"] - 1
        body = F.when(count > 0, F.array_join(F.slice(lines, h["i"] + 2, count), "\n")).when(last, F.lit("")).otherwise(F.lit("\n"))
        return F.struct(
            h["type"].alias("type"), F.trim(F.regexp_replace(h["line"], r"^#+\s*", "")).alias("title"), importance(h["type"]).alias("importance"),
            h["i"].alias("start_line"), (end - 1).alias("end_line"), body.alias("text"),
        )

    whole = F.array(
        F.struct(F.lit("content").alias("type"), F.lit("Content").alias("title"), F.lit(0.5).alias("importance"), F.lit(0).alias("start_line"), (F.col("_n") - 1).alias("end_line"), full.alias("text"))
    )
    found = F.when(full.isNull() | (full == ""), F.array().cast(f"array<{SECTION}>")).when(F.size(heads) == 0, whole).otherwise(F.transform(heads, section))
    return staged.withColumn(out, found).drop("_lines", "_n", "_marked", "_heads")


def chunk_sizes(section_array: Column, max_chunk: int = MAX_CHUNK) -> Column:
    """Lengths of the chunks that sections are packed into: by importance, greedily, at most ``max_chunk`` before separators."""
    ordered = F.array_sort(
        F.transform(section_array, lambda s, i: F.struct((-s["importance"]).alias("o"), i.alias("i"), F.length(s["text"]).alias("n")))
    )
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(-1).alias("open"))

    def add(acc, s):
        fits = acc["open"] + s["n"] <= max_chunk
        return (
            F.when(acc["open"] < 0, F.struct(acc["done"].alias("done"), s["n"].alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), (acc["open"] + 2 + s["n"]).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s["n"].alias("open")))
        )

    return F.aggregate(ordered, start, add, lambda acc: F.when(acc["open"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


CHUNK = "struct<types:array<string>,importance:double,start_line:int,end_line:int,text:string>"


def chunks(section_array: Column, max_chunk: int = MAX_CHUNK) -> Column:
    """The chunks that sections are packed into, as ``chunk_sizes`` counts them, with their text; the most important first."""
    ordered = F.array_sort(F.transform(section_array, lambda s, i: F.struct((-s["importance"]).alias("o"), i.alias("i"), s.alias("s"))))
    none = F.array().cast(f"array<{CHUNK}>")
    new = lambda s: F.struct(
        F.array(s["type"]).alias("types"), s["importance"].cast("double").alias("importance"), s["start_line"].cast("int").alias("start_line"), s["end_line"].cast("int").alias("end_line"), s["text"].alias("text")
    )

    def add(done: Column, entry: Column) -> Column:
        s, last = entry["s"], F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            F.array_append(last["types"], s["type"]).alias("types"), F.greatest(last["importance"], s["importance"].cast("double")).alias("importance"), last["start_line"].alias("start_line"),
            F.greatest(last["end_line"], s["end_line"].cast("int")).alias("end_line"), F.concat(last["text"], F.lit("\n\n"), s["text"]).alias("text"),
        )
        fits = (F.size(done) > 0) & (F.length(last["text"]) + F.length(s["text"]) <= max_chunk)
        return F.when(fits, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, new(s)))

    packed = F.aggregate(ordered, none, add)
    by_rank = F.array_sort(F.transform(packed, lambda c, i: F.struct((-c["importance"]).alias("o"), i.alias("i"), c.alias("c"))))
    return F.transform(by_rank, lambda x: x["c"])


def text_span(search: Column, full: Column, section_array: Column) -> Column:
    """(start, end, length, text, section, title) of a quotation in a text, as ``find_span`` finds it; null if it isn't there.

    The section is the last one that begins at or before its line; 'unknown' above the first.
    """
    start = find_span(search, full)
    line = F.size(F.split(F.left(full, start), "\n", -1)) - 1
    inside = F.try_element_at(F.filter(section_array, lambda s: s["start_line"] <= line), F.lit(-1))
    size = F.length(search)
    span = F.struct(
        start.alias("start"), (start + size).alias("end"), size.alias("length"), F.substring(full, start + 1, size).alias("text"),
        F.coalesce(inside["type"], F.lit("unknown")).alias("section"), inside["title"].alias("title"),
    )
    return F.when(start.isNotNull(), span)


def squeeze(c: Column) -> Column:
    """White space made single blanks."""
    return F.regexp_replace(c, r"\s+", " ")


def find_span(search: Column, full: Column) -> Column:
    """Start (from 0) of a quotation in a text, without regard to case, by its first 100 characters; null if it isn't there."""
    at = F.position(F.left(F.lower(F.trim(search)), F.lit(100)), F.lower(full))
    return F.when((search != "") & (full != "") & (at > 0), at - 1)


def validate_source_text(quote: Column, full: Column, threshold: float = 0.7) -> Column:
    """(valid, match, confidence) of a quotation: exact, with other white space or case, by its beginning, or by its words."""
    q, f = F.lower(squeeze(F.trim(quote))), F.lower(squeeze(full))
    words = F.slice(F.split(q, " ", -1), 1, 20)
    share = F.size(F.filter(words, lambda w: F.contains(f, w))) / F.size(words)
    result = lambda ok, how, c: F.struct(ok.alias("valid"), F.lit(how).alias("match"), c.alias("confidence"))
    yes = F.lit(True)
    return (
        F.when(quote.isNull() | (quote == "") | full.isNull() | (full == ""), result(F.lit(False), "missing", F.lit(0.0)))
        .when(F.contains(full, quote), result(yes, "exact", F.lit(1.0)))
        .when(F.contains(f, q), result(yes, "normalized", F.lit(0.95)))
        .when(F.contains(f, F.left(q, F.lit(100))), result(yes, "partial", F.lit(0.7)))
        .otherwise(result(share >= threshold, "similarity", share))
    )


def significant_tokens(c: Column, most: int | None = MAX_TOKENS) -> Column:
    """Distinct tokens of four and more letters or digits without stop words, of the first ``most`` such tokens; None: of all."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    return F.array_distinct(kept if most is None else F.slice(kept, 1, most))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the smaller number of tokens; 0 where one has none. Arguments: arrays of distinct tokens."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def urls(c: Column) -> Column:
    """Addresses in a text, without punctuation at their end."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(https?://[^\s<>\"'\])]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def doi(c: Column) -> Column:
    """First DOI in a text, without punctuation at its end; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1), r"[.,;:)\]}]+$", ""), F.lit(""))


def slug(c: Column, size: int = 80) -> Column:
    """Lower-case words joined by hyphens, at most ``size`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(size))


def first_sentence(c: Column) -> Column:
    """Text up to the first end of a sentence."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(squeeze(c)), r"^(.+?[.!?])(\s|$)", 1), F.lit("")), F.trim(squeeze(c)))


def summarize(c: Column, size: int = 200) -> Column:
    """Text cut to ``size`` characters with three points."""
    t = F.trim(squeeze(c))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(size - 3))), F.lit("...")))


def link_class(url: Column) -> Column:
    """Kind of resource that an address leads to."""
    u = F.lower(url)
    return (
        F.when(u.rlike(r"zenodo|figshare|dataverse|dryad|pangaea|osf\.io|huggingface\.co/datasets"), "dataset")
        .when(u.rlike(r"github\.com"), "repository")
        .when(u.rlike(r"doi\.org"), "doi")
        .when(u.rlike(r"\.(geojson|json|csv|tsv|zip|tiff?|gpkg|nc)(\?|#|$)"), "dataset")
        .otherwise("external")
    )


def resource_class(url: Column, context: Column) -> Column:
    """Kind of resource by its address and the words around it; 'navigation' is to be dropped."""
    u, v = F.lower(url), F.lower(F.concat_ws(" ", url, context))
    has = lambda *w: reduce(or_, [F.contains(v, F.lit(x)) for x in w])
    return (
        F.when(has("github.com", "gitlab.com", "bitbucket.org"), "repository")
        .when(has("zenodo", "figshare", "dataverse", "dryad", "pangaea", "osf.io", "huggingface.co/datasets"), "dataset")
        .when(has("supplement", "supporting information", "additional file"), "supplement")
        .when(has("data availability", "dataset", "data repository"), "dataset")
        .when(has("code availability", "source code", "software"), "code")
        .when(u.endswith(".pdf"), "paper")
        .when(F.contains(u, F.lit("doi.org")), "doi")
        .when(has("privacy", "cookie", "terms", "login", "subscribe"), "navigation")
        .otherwise("external")
    )


def title_case(c: Column) -> Column:
    """Words with a capital first letter, separators made blanks."""
    return F.initcap(F.trim(F.regexp_replace(c, r"[\s_-]+", " ")))


def humanize_key(c: Column) -> Column:
    """Field name as words: separators and changes of case made blanks, first letter a capital."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2"), r"\s+", " "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))


def singular(c: Column) -> Column:
    """Singular of an English noun by its ending."""
    return (
        F.when(c.rlike("(?i)(ss|us|is)$"), c).when(c.rlike("(?i)ies$"), F.regexp_replace(c, "(?i)ies$", "y")).when(c.rlike("(?i)(ches|shes|xes|zes)$"), F.regexp_replace(c, "(?i)es$", ""))
        .when(c.rlike("(?i)s$"), F.regexp_replace(c, "(?i)s$", "")).otherwise(c)
    )


def plural(c: Column, n: Column) -> Column:
    """Number and noun, the noun in the plural unless there is one."""
    many = F.when(c.rlike("(?i)[^aeiou]y$"), F.regexp_replace(c, "(?i)y$", "ies")).when(c.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, c).otherwise(many))


def context(search: Column, full: Column, around: int = 50) -> Column:
    """A quotation with the ``around`` characters before and after it; null if the text doesn't have it."""
    at = F.position(search, full)
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (search != ""), F.substr(full, start, at - start + F.length(search) + around))


def scope_signal(c: Column) -> Column:
    """Whether a text speaks of the whole globe."""
    return F.coalesce(c.rlike(r"(?i)\b(global|worldwide|world-wide|planetary|all continents)\b"), F.lit(False))


def place_pair(c: Column) -> Column:
    """A place named as 'Town, Country' in a text; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\b([A-Z][\p{L}'-]+(?: [A-Z][\p{L}'-]+)*, [A-Z][\p{L}'-]+(?: [A-Z][\p{L}'-]+)*)", 1), F.lit(""))


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def short_text(c: Column, size: int = 600) -> Column:
    """Text with single blanks, cut to ``size`` characters with three points."""
    t = strip(squeeze(c))
    return F.when(F.length(t) > size, F.concat(strip(F.left(t, F.lit(size))), F.lit("..."))).otherwise(t)


def long_sentence(c: Column) -> Column:
    """The beginning of a text up to the first end of a sentence after 80 characters."""
    t = short_text(c, 800)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^(.{80,}?[.!?])\s", 1), F.lit("")), t)


def claim_sentence(c: Column) -> Column:
    """The first sentence of 80 and more characters that says what was shown, else the first of that length; null if there is none."""
    sentences = F.filter(F.split(short_text(c, 1200), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 80)
    says = F.filter(sentences, lambda s: s.rlike(r"(?i)\b(show|shows|demonstrate|achieve|achieves|provide|provides|improve|improves|result|results)\b"))
    return F.coalesce(F.get(says, 0), F.get(sentences, 0))


def section_map(section_array: Column) -> Column:
    """Sections by key: array of (key, text), one for each type and title in lower case, the first of each; short sections have none."""
    kept = F.filter(F.transform(section_array, lambda s: F.struct(s["type"].alias("type"), s["title"].alias("title"), strip(s["text"]).alias("text"))), lambda s: F.length(s["text"]) >= 20)
    each = F.flatten(F.transform(kept, lambda s: F.array(*[F.struct(strip(F.lower(s[k])).alias("key"), s["text"].alias("text")) for k in ("type", "title")])))
    named = F.filter(each, lambda e: e["key"] != "")
    keys = F.transform(named, lambda e: e["key"])
    return F.filter(named, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def section_by_role(entries: Column, hints: tuple[str, ...]) -> Column:
    """(key, text) of the section that suits a role: for each hint in turn the one of that key, else the first whose key holds it."""
    long = F.filter(entries, lambda e: F.length(e["text"]) > 80)

    def first(test) -> Column:
        return F.get(F.filter(long, lambda e: test(e["key"])), 0)

    def of_hint(hint: str) -> list[Column]:
        return [first(lambda k: k == hint), first(lambda k: F.contains(k, F.lit(hint)))]

    return F.coalesce(*[c for hint in hints for c in of_hint(hint)])
