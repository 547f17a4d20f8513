"""A page API as a Spark data source: children of pages, with cursors; and the bodies of pages that were found.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("base", "https://host/api").option("roots", "1,2").load()

The source reads the children of each root by a task of their own, which suits many small trees; crawl() deals each level of all trees
over tasks, which suits large ones. A missing page (404) has no rows. Credentials are read from
the environment variable named in the option "tokenEnv", on the executors. bodies() fetches the bodies of any number of pages,
dealt over tasks; sources/space.py makes chunks of both.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources import shared

SCHEMA = "page_id string, title string, parent_id string, version int"
PAGE_SIZE, TIMEOUT_S = 100, 30


def fetch(url: str, token: str | None = None) -> dict | None:
    """A JSON object, None where there is no such page."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


def children(base: str, page_id: str, get: Callable[[str], dict | None]) -> Iterator[tuple]:
    """All children of a page, following the cursors. A child without a version is looked up by itself."""
    url: str | None = f"{base}/pages/{urllib.parse.quote(page_id)}/children?limit={PAGE_SIZE}"
    while url and (found := get(url)) is not None:
        for child in found.get("results", []):
            version = (child.get("version") or {}).get("number")
            if version is None:
                own = get(f"{base}/pages/{urllib.parse.quote(str(child['id']))}") or {}
                version = (own.get("version") or {}).get("number")
            yield str(child["id"]), child.get("title"), page_id, version
        following = (found.get("_links") or {}).get("next")
        url = urllib.parse.urljoin(f"{base}/", following) if following else None


def walk(base: str, root: str, excluded: set[str], get: Callable[[str], dict | None]) -> Iterator[tuple]:
    """All pages below a root, breadth first; pages with excluded titles go with all below them."""
    level = [root]
    while level:
        below = []
        for page in level:
            for row in children(base, page, get):
                if row[1] not in excluded:
                    yield row
                    below.append(row[0])
        level = below


def crawl(spark: SparkSession, base: str, roots: list[str], excluded_titles: list[str] | None = None, token_env: str | None = None, tasks: int | None = None, get: Callable[[str], dict | None] | None = None) -> DataFrame:
    """(root, page_id, title, parent_id, version, depth) of all pages below the roots, level by level: the pages of a level are dealt over tasks,
    which ask for their children, and what they find is written before the next level starts. A task that is lost asks again for its own
    pages' children, from the first cursor on; no level that is written is asked for again. Pages with excluded titles go with all below them."""
    excluded = set(excluded_titles or [])
    n = tasks or 2 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = os.environ.get(token_env) if token_env else None
        ask = get or (lambda url: fetch(url, token))
        for batch in batches:
            for root, page_id, depth in batch[["root", "page_id", "depth"]].itertuples(index=False):
                rows = [(root, *row, depth + 1) for row in children(base.rstrip("/"), page_id, ask) if row[1] not in excluded]
                yield pd.DataFrame(rows, columns=["root", "page_id", "title", "parent_id", "version", "depth"])

    schema = "root string, page_id string, title string, parent_id string, version int, depth int"
    level = spark.createDataFrame([(r, r, 0) for r in roots], "root string, page_id string, depth int")
    levels = []
    while not levels or levels[-1].limit(1).count():
        level = shared.keep(level.select("root", "page_id", "depth").repartition(n).mapInPandas(run, schema), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def bodies(pages: DataFrame, base: str, token_env: str | None = None, tasks: int | None = None, get: Callable[[str], dict | None] | None = None) -> DataFrame:
    """(page_id, title, html) of all pages that have a body; a missing one (404) has no row. Any other failure ends the task, which Spark
    tries again; `tasks` bounds how many requests are under way at a time."""
    spread = pages.select("page_id").repartition(tasks or 2 * pages.sparkSession.sparkContext.defaultParallelism, "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = os.environ.get(token_env) if token_env else None
        ask = get or (lambda url: fetch(url, token))
        for batch in batches:
            rows = []
            for page_id in batch["page_id"]:
                found = ask(f"{base.rstrip('/')}/pages/{urllib.parse.quote(page_id)}?body-format=export_view")
                if found is not None:
                    rows.append((page_id, found.get("title") or "", ((found.get("body") or {}).get("export_view") or {}).get("value") or ""))
            yield pd.DataFrame(rows, columns=["page_id", "title", "html"])

    return spread.mapInPandas(run, "page_id string, title string, html string")


class _Root(InputPartition):
    def __init__(self, root: str):
        self.root = root


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["base"].rstrip("/")
        self.roots = [r for r in options["roots"].split(",") if r]
        self.excluded = {t for t in options.get("excludedtitles", "").split("|") if t}
        self.token_env = options.get("tokenenv")

    def partitions(self) -> list[InputPartition]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token = os.environ.get(self.token_env) if self.token_env else None
        yield from walk(self.base, partition.root, self.excluded, lambda url: fetch(url, token))


class PageSource(DataSource):
    """Options: base, roots (ids, comma between), excludedTitles (bar between), tokenEnv."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
