"""Readers: document stores, event logs, spatial samples, web pages. All give DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.functions.text import link_class
from basinweave.operators import spatial

STORE_SCHEMA = (
    "version string, entities array<struct<id:string,type:string,attributes:string,metadata:string,verificationState:string,createdAt:string>>, "
    "triples array<struct<subject:string,predicate:string,object:string,metadata:string,verificationState:string>>"
)
EVENT_SCHEMA = "id string, type string, timestamp string, objects array<string>, details string, actor string"


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of a JSON document store. Rows of older versions without a state count as extracted; triple ids follow
    from their content."""
    doc = spark.read.schema(STORE_SCHEMA).option("multiLine", True).json(path)
    state = lambda c: F.coalesce(F.col(c), F.lit("extracted"))
    number = lambda m: F.get_json_object(m, "$.confidence").try_cast("double")
    e = doc.select(F.posexplode("entities").alias("seq", "e")).select(
        F.col("e.id").alias("id"), F.col("e.type").alias("type"), F.get_json_object("e.attributes", "$.name").alias("name"), F.col("e.attributes").alias("attributes"),
        F.coalesce(number("e.metadata"), F.lit(1.0)).alias("confidence"), state("e.verificationState").alias("verification_state"),
        F.to_timestamp("e.createdAt").alias("created_at"), F.col("seq").cast("long").alias("seq"),
    )
    t = doc.select(F.posexplode("triples").alias("seq", "t")).select(
        F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws("\x1f", "t.subject", "t.predicate", "t.object"), 256), 1, 10)).alias("triple_id"),
        F.col("t.subject").alias("subject"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("object"), F.coalesce(number("t.metadata"), F.lit(1.0)).alias("confidence"),
        state("t.verificationState").alias("verification_state"), F.col("seq").cast("long").alias("seq"),
    )
    return e, t


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log with one JSON object a line; lines that can't be read are left out."""
    rows = spark.read.schema(EVENT_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.where("id is not null and type is not null")
    return good.select(F.col("id").alias("event_id"), F.to_timestamp("timestamp").alias("ts"), "type", F.coalesce("objects", F.array().cast("array<string>")).alias("objects"), "details", "actor")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files."""
    return spatial.features_of_geojson(spark.read.text(path, wholetext=True))


def read_point_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Points of a CSV file with quoted fields and coordinate columns under any usual name."""
    return spatial.points_of_table(spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True))


class _Page(HTMLParser):
    _SKIP = {"script", "style", "noscript", "nav", "footer", "header", "svg", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.links, self.parts = "", {}, [], []
        self._skip, self._in, self._link = 0, None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self._SKIP:
            self._skip += 1
        elif tag == "title":
            self._in = "title"
        elif tag == "meta" and a.get("content"):
            self.meta.setdefault(a.get("property") or a.get("name") or "", a["content"])
        elif tag == "a" and a.get("href"):
            self._link = [a["href"], ""]
        if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP and self._skip:
            self._skip -= 1
        elif tag == "title":
            self._in = None
        elif tag == "a" and self._link:
            self.links.append(tuple(self._link))
            self._link = None

    def handle_data(self, data):
        if self._in == "title":
            self.title += data
        elif not self._skip:
            self.parts.append(data)
        if self._link is not None:
            self._link[1] += data


def parse_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, description, body, links) of HTML pages: titles and descriptions of social tags first, boilerplate left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, html in zip(pdf["id"], pdf["html"]):
                page = _Page()
                page.feed(html or "")
                title = page.meta.get("og:title") or page.meta.get("citation_title") or page.title.strip()
                about = page.meta.get("og:description") or page.meta.get("description") or ""
                body = "\n".join(" ".join(line.split()) for line in "".join(page.parts).splitlines() if line.strip())
                out.append((key, " ".join(title.split()), about, body, [{"url": u, "label": " ".join(t.split())} for u, t in page.links]))
            yield pd.DataFrame(out, columns=["id", "title", "description", "body", "links"])

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "id string, title string, description string, body string, links array<struct<url:string,label:string>>")


def page_links(parsed: DataFrame) -> DataFrame:
    """(id, url, label, kind) of the distinct links of parsed pages."""
    return parsed.select("id", F.explode("links").alias("l")).select("id", "l.url", "l.label", link_class(F.col("l.url")).alias("kind")).dropDuplicates(["id", "url"])


def abstract_from_index(rows: DataFrame, id_col: str, index_col: str) -> DataFrame:
    """(id, abstract) of inverted indexes (word -> positions), words put back in order."""
    words = rows.select(F.col(id_col).alias("id"), F.explode(index_col).alias("word", "positions")).select("id", "word", F.explode("positions").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return words.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("abstract"))


def route_connector(address: str = "input"):
    """Connector that an input belongs to, the first that fits: repository, GeoJSON, spatial file, paper or page."""
    from pyspark.sql.functions import col, lower, when

    a = lower(col(address))
    return (
        when(a.rlike(r"github\.com/[\w.-]+/[\w.-]+"), "repository").when(a.rlike(r"\.geojson(\?|$)"), "geojson").when(a.rlike(r"\.(csv|tsv|zip|shp|tiff?|gpkg|kml|nc)(\?|$)"), "spatial")
        .when(a.rlike(r"10\.[0-9]{4,}/\S+|arxiv\.org|doi\.org") | ~a.rlike("^https?://"), "paper").otherwise("page")
    )
