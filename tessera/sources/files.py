"""Readers of the corpus's file formats; each gives a DataFrame with declared types."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import urllib.request
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered as number_all
from ..operators.storage import materialize
from . import split_json
from .turtle import read_turtle, turtle_triples  # noqa: F401  (readers of this module's interface)

NARRATOR = (
    "popularName string, name string, teknonym string, generation string, lineage string, residence string, deathYear string,"
    " birthYear string, title string, office string, attribute string, narratorId string"
)
RECORD = (
    "book string, bookName string, refNo bigint, chain array<string>, type string, chapter string, chapterPreface string, topics array<string>,"
    " mentions array<string>, quranVerses array<string>, similar array<string>, stronglySimilar array<string>, seeAlso array<string>, textAr string, textEn string"
)
VERSE = "surah bigint, ayah bigint, text_ar string, text_en string, tafsir_en string"


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """narrators, records and books of a graph file: one object with three maps. Empty English texts are null.

    A file is read by as many tasks as it has blocks.
    """
    entries, maps = split_json.read_maps(spark, path)
    entries = materialize(entries)
    of = lambda section, schema: entries.where(F.col("section") == section).select("id", F.from_json("value", schema).alias("x")).select("id", "x.*")
    books = maps.where("section = 'bookNames'").select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "name"))
    return {"narrators": of("narrators", NARRATOR), "records": of("hadiths", RECORD).withColumn("textEn", F.nullif("textEn", F.lit(""))), "books": books}


def read_csv_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any malformed row ends the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", multiLine=True, escape='"')


def read_csv_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed rows are left out."""
    return spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED", multiLine=True, escape='"')


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    """surah, ayah, word, segment, form, tag, features of lines with four columns; # begins a comment."""
    parts = F.split("value", "\t")
    place = F.split(parts[0], ":")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 4) & (F.size(place) == 4))
    numbers = [place[i].try_cast("int").alias(n) for i, n in enumerate(("surah", "ayah", "word", "segment"))]
    return rows.select(*numbers, parts[1].alias("form"), parts[2].alias("tag"), parts[3].alias("features")).where("surah is not null and ayah is not null and word is not null")


def read_keyed_json(spark: SparkSession, path: str, value: str = "string", missing_ok: bool = True) -> DataFrame:
    """(key, value) of a JSON object; an absent optional file gives no rows."""
    try:
        text = spark.read.text(path, wholetext=True)
        return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    except Exception as e:
        if not missing_ok or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"key string, value {value}")


def read_pages(spark: SparkSession, path: str, book_id: int) -> DataFrame:
    """book_id, page_index (from 0), text, vol, page_num, headings; meta may be an object or a string of JSON."""
    meta = "struct<page:string,vol:string,headings:array<string>>"
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<page_id:bigint,meta:string,text:string>>")).alias("p"))
    parsed = F.from_json(F.when(F.col("p.meta").startswith('"'), F.from_json(F.concat(F.lit('{"x":'), F.col("p.meta"), F.lit("}")), "x string")["x"]).otherwise(F.col("p.meta")), meta)
    return listed.select(
        F.lit(book_id).alias("book_id"), (F.col("p.page_id") - 1).alias("page_index"), F.col("p.text").alias("text"), parsed["vol"].alias("vol"), parsed["page"].alias("page_num"), parsed["headings"].alias("headings")
    )


def read_mapping(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """(a, b, page_index) of a mapping from 'a:b' or 'a' to a page; entries without positive numbers are left out."""
    rows = read_keyed_json(spark, path, "struct<page_index:bigint,page:bigint,heading:string>", missing_ok=False)
    key = F.split("key", ":")
    page = F.coalesce("value.page_index", F.col("value.page") - (1 if one_based else 0))
    out = rows.select(key[0].try_cast("int").alias("a"), F.get(key, F.lit(1)).try_cast("int").alias("b"), page.alias("page_index"), F.col("value.heading").alias("heading"))
    return out.where("a > 0 and (b is null or b > 0) and page_index >= 0")


def read_phrases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Phrase ranges (phrase, verse, first, last), and the number of malformed ranges per phrase."""
    rows = read_keyed_json(spark, path, "struct<count:bigint,ayahs:bigint,surahs:bigint,ayah:map<string,array<array<bigint>>>>", missing_ok=False)
    pairs = rows.select(F.col("key").alias("phrase"), F.explode("value.ayah").alias("verse", "ranges")).select("phrase", "verse", F.explode("ranges").alias("r"))
    good = (F.size("r") == 2) & F.regexp_like("verse", F.lit(r"^\d+:\d+$"))
    ranges = pairs.where(good).select("phrase", F.replace("verse", F.lit(":"), F.lit("_")).alias("verse"), F.col("r")[0].alias("first"), F.col("r")[1].alias("last"))
    return ranges, pairs.groupBy("phrase").agg(F.count_if(~good).alias("skipped"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines, read line by line; read_turtle takes prefixes and abbreviations."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"\S*)\s*\.\s*$"
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(pattern)))
    part = lambda i: F.regexp_extract("value", pattern, i)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    literal = F.regexp_extract(part(3), r"^\"((?:[^\"\\]|\\.)*)\"", 1)
    return lines.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(part(3).startswith('"'), literal).otherwise(bare(part(3))).alias("o"))


def follow_chain(triples: DataFrame, predicate: str) -> DataFrame:
    """(head, node, pos) of linked lists: heads follow nothing; each round steps all lists at once.

    A list ends at its last node, or where it would come back to one it has. Lists without a head (rings) are left out.
    """
    links = materialize(triples.where(F.col("p") == predicate).select(F.col("s").alias("node"), F.col("o").alias("next")).groupBy("node").agg(F.min("next").alias("next")))
    heads = links.select("node").join(links.select(F.col("next").alias("node")), "node", "left_anti")
    level = materialize(heads.select(F.col("node").alias("head"), "node", F.lit(0).alias("pos")))
    out, pos = level, 0
    while not level.isEmpty():
        pos += 1
        step = level.join(links, "node").select("head", F.col("next").alias("node"), F.lit(pos).alias("pos"))
        level = materialize(step.join(out.select("head", "node"), ["head", "node"], "left_anti"))
        out = out.unionAll(level)
    return out


def numbered(df: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """df with rn, from 1, by `order` in each group, or over all rows without one task for them."""
    if group is None:
        return number_all(df, "rn", F.col(order))
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def read_remote(spark: SparkSession, url: str, folder: str, reader: Callable[[SparkSession, str], DataFrame], timeout: float = 60.0) -> DataFrame:
    """What reader makes of a remote file, which is fetched once to `folder` (shared with executors) and read from there afterwards."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", url.split("://", 1)[-1])
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(part, path)  # a broken fetch never looks like a whole one
    return reader(spark, path)


def pdf_text(data: bytes) -> str:
    """The strings that a PDF's content streams show, in order, one line for each text object; plain or deflated streams alone."""
    lines = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        with contextlib.suppress(zlib.error):
            body = zlib.decompress(body)
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", block, re.S)
            text = b"".join(re.sub(rb"\\(.)", rb"\1", x, flags=re.S) for x in shown).decode("latin-1").strip()
            if text:
                lines.append(text)
    return "\n".join(lines)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files, one file to a row."""

    def run(frames):
        for f in frames:
            yield f.assign(text=[pdf_text(x) for x in f["content"]])[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def glossary(lines: DataFrame) -> DataFrame:
    """(term, meaning) of a text's lines like `term: meaning`, the first meaning of a term; lines: (path, text)."""
    rows = lines.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    parts = F.split("line", r"\s*:\s*", 2)
    named = rows.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("term"), F.trim(parts[1]).alias("meaning"), "path", "i").where("term <> '' and meaning <> ''")
    return named.groupBy("term").agg(F.min_by("meaning", F.struct("path", "i")).alias("meaning"))
