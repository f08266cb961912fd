"""Generated, minified and vendored source files and data saved as code.

What is known of a file decides, in this order:
    1. attribute files (``.gitattributes``): lines that set or unset ``linguist-generated`` or ``linguist-vendored`` for a glob;
       within a file later lines win, and files of deeper directories win over those above them;
    2. patterns for repositories that declare nothing, equivalent to what such files commonly mark: directories of package managers
       and copies, names that tools give to their output;
    3. the content, where it is known: notices of generators and licence banners of other projects in the first lines and in all
       comments above the code, code without blanks, serial numbering, literals that fill the file; text inside a string is no notice;
    4. mined patterns: a directory name, the last part of a file name (``*_pb2.py``) or a file name (without number of version) of
       which the files known by 1 and 3 are marked in at least ``MINED_REPOS`` repositories and by ``MINED_SHARE`` of all files known
       marks the files of which nothing else is known, in any repository; a directory needs as many different names in it.

Classification is narrow; only the mined patterns, a table with three sums each, are aggregated and joined back.

Defined cases: null trees, paths and contents are unknown, not hand-written; backslashes separate like slashes; files of other
kinds are no case; repeated fetches of a repository count together; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinweave.session import stable

SOURCE = re.compile(r"\.(?:py|js)$", re.I)
MINED_REPOS, MINED_SHARE = 5, 0.9

_DIRS = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendors|vendored|_vendor|third[-_]?party|extern|externals?|deps|dependencies"
    r"|site-packages|dist|Pods|Carthage|Godeps|\.yarn|__generated__|generated)/",
    re.I,
)
_NAMES = re.compile(
    r"(?:[.-]min\.js|[._-]bundle\.js|[._-]chunk\.js|_pb2(?:_grpc)?\.py|[._]pb\.(?:js|py)|_pb\.js|\.g\.(?:py|js)|[._-](?:auto)?generated\.(?:py|js)|_rc\.py|(?:^|/)ui_\w+\.py|\.tab\.py|_wrap\.py)$",
    re.I,
)
_NOTICE = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated\b|\bdo not (?:edit|modify)\b|changes?\b[^\n]{0,40}\bwill be (?:lost|overwritten)|created by:.{0,40}\bcompiler"
    r"|\b(?:file|code|module|source)\b[^\n]{0,20}\b(?:was|is|has been)\b[^\n]{0,10}\b(?:produced|generated|created|written) automatically"
    r"|\bautomatically (?:generated|produced|created)|automatisch (?:erzeugt|generiert|erstellt)|généré automatiquement|generado automáticamente|自动生成"
    r"|\bcode generated by\b|^\W*generated (?:by|from|with|using)\b|^\W*output of \w[\w.-]* [\d.]+ for\b",
    re.I | re.M,
)
_NEGATED = re.compile(r"\b(?:edit(?:ed)? by hand|nothing here|not (?:auto|generated)|never generated|hand-?written)\b", re.I)
_COMMENT = re.compile(r"""^\s*(?:#|//|/\*|\*|"{3}|'{3}|<!--|;)""")
_OPEN = re.compile(r"""/\*|<!--|"{3}|'{3}""")
_CLOSE = {"/*": "*/", "<!--": "-->"}
_VERSION = r"v?\d+(?:\.\d+)+"
_BANNER = (
    re.compile(rf"@license\s+(?P<n>[\w@/.-]+?)(?:\s+{_VERSION}|\s*$)", re.I | re.M),
    re.compile(rf"^\W*(?P<n>[\w.-]+?)(?:\.js|\.py)?\s+{_VERSION}\s*\|", re.I | re.M),
    re.compile(rf"^\W*(?P<n>[\w-]+)\.(?:js|py)\b[^\n]*\bversion\s+{_VERSION}", re.I | re.M),
    re.compile(r"(?:copyright\s*)?(?:\(c\)|©)\s*(?:\d{4}(?:\s*-\s*\d{4})?,?\s*)?(?:the\s+)?(?P<n>[\w.-]+?)\s+(?:authors|contributors|developers|team|project)\b", re.I),
    re.compile(r"licen[cs]e found with (?P<n>[\w-]+)", re.I),
)
_SERIAL = re.compile(r"\d+")
_LITERAL = re.compile(r"""(?:b|r|u)?(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|-?\b\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?\b|0x[0-9a-fA-F]+""")
_KEYWORD = re.compile(r"\b(?:def|class|return|function|if|for|while|import|lambda|async|await|throw|raise|with|yield)\b")


def glob_regex(pattern: str, at: str) -> re.Pattern:
    """A pattern of an attribute file in directory ``at`` ('' or 'a/b/') as a regular expression over whole paths."""
    anchored = "/" in pattern.strip("/") or pattern.startswith("/")
    body, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            inner = p[i + 1 : end].replace("\\", "\\\\")
            body, i = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    tail = "(?:/.*)?" if pattern.endswith("/") else ""
    return re.compile(re.escape(at) + ("" if anchored else "(?:[^/]+/)*") + body + tail + r"\Z")


def attribute_rules(files: dict[str, str | None]) -> list[tuple[re.Pattern, bool]]:
    """(pattern, marked) of all attribute files of a repository, the strongest last."""
    found = []
    for path, text in files.items():
        clean = norm_path(path)
        if text and clean.rpartition("/")[2] == ".gitattributes":
            found.append((clean.count("/"), clean.rpartition("/")[0], text))
    rules = []
    for _, at, text in sorted(found):
        for line in text.splitlines():
            parts = line.split()
            if len(parts) < 2 or parts[0].startswith("#"):
                continue
            for attr in parts[1:]:
                m = re.fullmatch(r"([-!]?)linguist-(?:generated|vendored)(?:=(\w+))?", attr)
                if m:
                    on = not m[1] and (m[2] or "true").lower() not in ("false", "0", "no")
                    rules.append((glob_regex(parts[0], at + "/" if at else ""), on))
    return rules


def norm_path(path: str) -> str:
    """Path with slashes, without a leading './'."""
    return re.sub(r"^(?:\./)+", "", path.replace("\\", "/"))


def declared(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool | None:
    """What the attribute files say of a path; None if nothing."""
    said = None
    for pattern, on in rules:
        if pattern.match(path):
            said = on
    return said


def other_banner(head: str, own: set[str]) -> bool:
    """Whether a licence banner at the top of a file names another project."""
    for pattern in _BANNER:
        for m in pattern.finditer(head):
            name = re.sub(r"\.(?:js|py)$", "", m["n"].lower())
            if name and name not in own and not name.isdigit():
                return True
    return False


def leading_comments(lines: list[str]) -> list[str]:
    """Lines of the comments above the first code, however many; of doc strings the lines that look like comments."""
    out: list[str] = []
    close = None
    for line in lines:
        bare = line.strip()
        inner = bare
        if close is None:
            if bare and not _COMMENT.match(line):
                break
            if m := _OPEN.match(bare):
                close, inner = _CLOSE.get(m[0], m[0]), bare[m.end() :]
        comment = close in _CLOSE.values() or _COMMENT.match(line)
        if close is not None and close in inner:
            if code := inner.partition(close)[2].strip():
                out += [line[: len(line.rstrip()) - len(code)]] if comment else []
                break
            close = None
        if comment:
            out.append(line)
    return out


def content_kind(text: str | None, own: set[str]) -> str | None:
    """generated, minified, vendored or data; None for hand-written source and unknown content."""
    if not text or not text.strip():
        return None
    lines = text.splitlines()
    head = "\n".join(line for line in lines[:12] if _COMMENT.match(line) or len(line) < 200)[:4000]
    top = leading_comments(lines)
    first = [line if _COMMENT.match(line) else _LITERAL.sub("", line) for line in lines[:1]]
    for line in [*first, *(line for line in lines[1:6] if _COMMENT.match(line)), *top]:
        if len(line) < 200 and _NOTICE.search(line) and not _NEGATED.search(line):
            return "generated"
    comments = "\n".join([*(line for line in head.splitlines() if _COMMENT.match(line)), *top])
    if other_banner(comments, own):
        return "vendored"
    code = [line for line in lines if line.strip() and not _COMMENT.match(line)]
    if not code:
        return None
    body = "\n".join(code)
    size = len(body)
    literal = [m[0] for m in _LITERAL.finditer(body)]
    # long strings of words are text of the program; numbers, keys and encoded bytes are data
    data = sum(len(x) for x in literal if x[0] not in "\"'bru" or " " not in x)
    filled = data + sum(body.count(c) for c in "[]{}(),:\n ")
    if size >= 200 and data >= 0.3 * size and filled >= 0.85 * size and len(literal) >= 1 and not _KEYWORD.search(_LITERAL.sub("", body)):
        return "data"
    longest = max(code, key=len)
    blanks = sum(c in " \t" for c in longest) / len(longest)
    if len(longest) >= 200 and len(longest) >= 0.6 * size:
        bare = _LITERAL.sub("", longest)
        if blanks < 0.12 and len(bare) > 0.4 * len(longest) and re.search(r"[;{}(),]", bare):
            return "minified"
    # serial numbering: most lines are alike but for the numbers and names in them, and the numbers count up
    if len(code) >= 6:
        masks = Counter(re.sub(r"[A-Za-z_]*\d+|\"[^\"]*\"|'[^']*'", "0", line.strip()) for line in code)
        alike = sum(n for n in masks.values() if n >= 3)
        counters = [int(m[0]) for line in code for m in [_SERIAL.search(line)] if m]
        runs = sum(b - a in (0, 1) for a, b in zip(counters, counters[1:]))
        if alike >= 0.75 * len(code) and len(counters) >= 0.5 * len(code) and runs >= 0.5 * max(1, len(counters) - 1):
            return "generated"
    return None


def name_stem(path: str) -> str:
    """File name without extension and version, for mining."""
    base = norm_path(path).rpartition("/")[2].lower()
    return re.sub(r"[-_.]?v?\d+(?:\.\d+)+", "", base)


_LAST_PART = re.compile(r"[._-][^/._-]+\.(?:py|js)$")


def path_patterns(clean: str) -> list[str]:
    """The patterns that are mined, of one path: its directories, the last part of its name, and its name."""
    low = clean.lower()
    last = _LAST_PART.search(low)
    return sorted({f"{d}/" for d in low.split("/")[:-1] if d} | {name_stem(low)} | ({f"*{last[0]}"} if last else set()))


FILE_SCHEMA = "full_name string, path string, stem string, patterns array<string>, known boolean, usual boolean, kind string"


def classify_files(repositories: DataFrame) -> DataFrame:
    """One row for each source file of each row's tree: what is known of it and its kind (null: hand-written or unknown)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, tree, names, texts in zip(pdf["full_name"], pdf["tree"], pdf["names"], pdf["texts"]):
                files = dict(zip(names, texts)) if names is not None else {}
                rules = attribute_rules(files)
                content = {norm_path(p): t for p, t in files.items() if t is not None}
                own = {x.lower() for x in re.split(r"/", name)} if name else set()
                for path in dict.fromkeys(tree):
                    if path is None or not SOURCE.search(path):
                        continue
                    clean = norm_path(path)
                    text = content.get(clean)
                    inside = content_kind(text, own)
                    said = declared(clean, rules)
                    usual = "vendored" if _DIRS.search(clean) else "generated" if _NAMES.search(clean) else None
                    if said is not None:
                        kind = "declared" if said else None
                    else:
                        kind = usual or inside
                    known = text is not None or said is not None
                    out.append((name, path, name_stem(clean), path_patterns(clean), known, usual is not None and said is None, kind))
            yield pd.DataFrame(out, columns=["full_name", "path", "stem", "patterns", "known", "usual", "kind"])

    rows = repositories.where("full_name is not null and tree is not null").select(
        "full_name", "tree", F.map_keys("key_files").alias("names"), F.map_values("key_files").alias("texts")
    )
    return rows.mapInPandas(run, FILE_SCHEMA)


def mined_patterns(files: DataFrame) -> DataFrame:
    """(pattern) of all patterns that stand for files nobody wrote by hand, by what is known outside the usual ones."""
    seen = files.where("known and not usual").select("full_name", "stem", F.explode("patterns").alias("pattern"), F.col("kind").isNotNull().alias("marked"))
    few = lambda c: F.approx_count_distinct(F.when(F.col("marked"), F.col(c)))  # noqa: E731 (as good as exact for counts as low as these)
    sums = seen.groupBy("pattern").agg(few("full_name").alias("repos"), few("stem").alias("names"), F.avg(F.col("marked").cast("int")).alias("share"))
    wide = ~F.col("pattern").endswith("/") | (F.col("names") >= MINED_REPOS)
    return sums.where((F.col("repos") >= MINED_REPOS) & (F.col("share") >= MINED_SHARE) & wide).select("pattern")


def file_kinds(repositories: DataFrame) -> DataFrame:
    """(full_name, path, kind) of each source file: declared, generated, minified, vendored, data, mined; null if written by hand."""
    files = stable(classify_files(repositories.select("full_name", "tree", "key_files")))  # read three times below
    unknown = files.where("kind is null and not known").select("full_name", "path", F.explode("patterns").alias("pattern"))
    mined = unknown.join(mined_patterns(files), "pattern").select("full_name", "path", F.lit("mined").alias("kind"))
    both = files.select("full_name", "path", "kind").unionByName(mined)
    # of repeated fetches with different contents, and of equal rows, one kind: by name, any before none
    return both.groupBy("full_name", "path").agg(F.min("kind").alias("kind"))


def found_files(repositories: DataFrame) -> DataFrame:
    """(full_name, path) of all source files that nobody wrote by hand."""
    return file_kinds(repositories).where("kind is not null").select("full_name", "path")
