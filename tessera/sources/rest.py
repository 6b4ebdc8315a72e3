"""A paged REST endpoint as a Spark data source; each key is read by one task, with retries."""

from __future__ import annotations

import itertools
import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.storage import materialize


class Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class RestReader(DataSourceReader):
    """Options: url with {key} and {page}; keys; partitions; firstPage, mostPages, pauseSeconds, tries; more: the field that says
    whether further pages follow; cache: a folder, shared with executors, in which a key's whole answer is kept."""

    def __init__(self, options):
        self.url = options["url"]
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.splits = int(options.get("partitions", "8"))
        self.first_page = int(options.get("firstPage", "1"))
        self.most_pages = int(options.get("mostPages", "20"))
        self.pause = float(options.get("pauseSeconds", "0.2"))
        self.tries = int(options.get("tries", "4"))
        self.more = options.get("more", "has_more")
        self.cache = options.get("cache")

    def partitions(self):
        n = max(1, min(self.splits, len(self.keys)))
        return [Keys(self.keys[i::n]) for i in range(n)]

    def _get(self, url: str) -> dict:
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as r:
                    return json.load(r)
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.tries - 1:
                    raise
                time.sleep(self.pause * 2**attempt)

    def _pages(self, key: str) -> list[dict]:
        """All pages of a key; one that has more than mostPages is an error, not a shorter answer."""
        out = []
        for page in itertools.count(self.first_page):
            if len(out) == self.most_pages:
                raise RuntimeError(f"{key} has more than {self.most_pages} pages")
            out.append(self._get(self.url.format(key=key, page=page)))
            if not (isinstance(out[-1], dict) and out[-1].get(self.more)) or "{page}" not in self.url:
                return out
            time.sleep(self.pause)

    def _kept(self, key: str) -> list[dict]:
        if not self.cache:
            return self._pages(key)
        path = os.path.join(self.cache, re.sub(r"[^A-Za-z0-9._-]", "_", key) + ".json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        pages = self._pages(key)
        os.makedirs(self.cache, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(pages, f, ensure_ascii=False)
        os.replace(part, path)
        return pages

    def read(self, partition: Keys):
        for key in partition.keys:
            for page, body in enumerate(self._kept(key), self.first_page):
                yield (key, page, json.dumps(body, ensure_ascii=False))


class RestSource(DataSource):
    """spark.dataSource.register(RestSource); spark.read.format("paged_rest").options(url=..., keys=...).load()"""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "key string, page int, body string"

    def reader(self, schema):
        return RestReader(self.options)


def range_counts(answers: DataFrame) -> DataFrame:
    """(surah, ayah, n) from answers to count requests, whose bodies are objects of counts by 's:a'; other keys are left out."""
    rows = answers.select(F.explode(F.from_json("body", "map<string,bigint>")).alias("key", "n"))
    part = lambda i: F.regexp_extract("key", r"^(\d+):(\d+)$", i).try_cast("int")
    return rows.select(part(1).alias("surah"), part(2).alias("ayah"), "n").where("surah > 0 and ayah > 0")


def fetch_missing(spark, url: str, pages: int, path: str, chunk: int = 200, **options) -> int:
    """Fetches the pages 1 to `pages` that path lacks, `chunk` at a time, each stored before the next; returns how many were missing.

    Pages whose answer is empty are not stored, and so are asked for again by the next run.
    """
    spark.dataSource.register(RestSource)
    schema = "page int, body string"
    try:
        have = spark.read.schema(schema).parquet(path).select("page")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], "page int")
    missing = materialize(spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page")).join(have, "page", "left_anti"))
    count, last = missing.count(), 0
    for _ in range(-(-count // chunk)):
        # the driver sees one chunk of numbers at a time
        some = [r["page"] for r in missing.where(F.col("page") > last).orderBy("page").limit(chunk).collect()]
        last = some[-1]
        reader = spark.read.format("paged_rest").options(url=url, keys=",".join(map(str, some)), **options)
        rows = reader.load().select(F.col("key").cast("int").alias("page"), "body").where("body not in ('{}', 'null', '[]')")
        rows.write.mode("append").parquet(path)
    return count
