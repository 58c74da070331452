"""Recorded answers of a code host as tables: pages of searches by a data source of its own, details of changes with an outcome each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Hits on a full page of a search, and the last page that a search has.
PER_PAGE, LAST_PAGE = 30, 10
HIT = "search_keyword string, page int, position int, hits int, number bigint, title string, html_url string, state string, created_at string, user_login string"
#: What a recorded answer to a request for a change's details holds, where it is whole.
DETAIL = (
    "number bigint, title string, body string, state string, created_at string, closed_at string, merged_at string, additions bigint, deletions bigint, changed_files bigint, "
    "user struct<login: string>, merged_by struct<login: string>, patch string, broken string"
)


class _Page(InputPartition):
    def __init__(self, keyword: str, page: int, files: list[str]):
        self.keyword, self.page, self.files = keyword, page, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.last = options["path"], int(options.get("lastpage", LAST_PAGE))
        named = options.get("keywords")
        self.keywords = set(json.loads(named)) if named else None

    def _files(self) -> tuple[object, str]:
        from pyarrow import fs

        if ":/" not in self.path:
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.path))

    def partitions(self) -> list[_Page]:
        """A partition for each recorded page of each keyword asked for: names are listed here, nothing is read."""
        from pyarrow import fs

        system, root = self._files()
        pages: dict[tuple[str, int], list[str]] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in f.path.split("/") if "=" in p)
            if f.is_file and f.size and not f.base_name.startswith(("_", ".")) and "search_keyword" in parts and parts.get("page", "").isdigit():
                keyword, page = unquote(parts["search_keyword"]), int(parts["page"])
                if 1 <= page <= self.last and (self.keywords is None or keyword in self.keywords):
                    pages.setdefault((keyword, page), []).append(f.path)
        return [_Page(k, p, sorted(files)) for (k, p), files in sorted(pages.items())]

    def read(self, partition: _Page) -> Iterator[tuple]:
        system, _ = self._files()
        items = []
        for name in partition.files:
            try:
                items += json.loads(system.open_input_stream(name).read()).get("items") or []
            except (ValueError, AttributeError):  # a broken page lists nothing
                continue
        for i, x in enumerate(items):
            user = x.get("user") or {}
            yield partition.keyword, partition.page, i, len(items), x.get("number"), x.get("title"), x.get("html_url"), x.get("state"), x.get("created_at"), user.get("login")


class RecordedSearch(DataSource):
    """Hits of recorded searches, a partition a page.

    Option path: a folder that the driver and all executors reach, with a file of JSON at search_keyword=K/page=N/ for each
    page (as Spark writes partitions). Options: keywords (a JSON list; else all), lastpage.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return HIT

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def search(spark: SparkSession, path: str, quota: int | None = None, keywords: list[str] | None = None) -> DataFrame:
    """(search_keyword, number, title, html_url, state, created_at, user_login): what a search that goes page by page would have found.

    Each keyword's pages count up to the first that isn't full, or is missing, and its hits up to the quota. The same
    change may be a hit of several keywords.
    """
    spark.dataSource.register(RecordedSearch)
    reader = spark.read.format("recorded_search").option("path", path)
    if keywords is not None:
        reader = reader.option("keywords", json.dumps(keywords))
    hits = reader.load()
    # a keyword has LAST_PAGE * PER_PAGE hits at most
    before = Window.partitionBy("search_keyword").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    in_order = Window.partitionBy("search_keyword").orderBy("page")
    hits = hits.withColumns({"short": F.coalesce(F.min("hits").over(before), F.lit(PER_PAGE)) < PER_PAGE, "place": F.dense_rank().over(in_order)})
    hits = hits.where(~F.col("short") & (F.col("place") == F.col("page")))
    if quota is not None:
        hits = hits.where((F.col("page") - 1) * PER_PAGE + F.col("position") < quota)
    return hits.select("search_keyword", "number", "title", "html_url", "state", "created_at", "user_login")


def record_search(hits: DataFrame, path: str, keyword: Column, order: list[Column | str], payload: Column) -> None:
    """Writes hits (payload: a struct for each) as recorded pages: by keyword in the given order, up to LAST_PAGE pages."""
    h = hits.select(keyword.alias("search_keyword"), F.row_number().over(Window.partitionBy(keyword).orderBy(*order)).alias("n"), payload.alias("item"))
    h = h.where(F.col("n") <= PER_PAGE * LAST_PAGE).withColumn("page", F.ceil(F.col("n") / PER_PAGE).cast("int"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])
    pages = h.groupBy("search_keyword", "page").agg(F.to_json(F.struct(F.count("*").alias("total_count"), items.alias("items"))).alias("value"))
    pages.write.partitionBy("search_keyword", "page").text(path)


def key_of(url: Column) -> Column:
    """(owner, repo, number) of a change's address, as one text in lower case; null where it is none."""
    pattern = r"^https?://([^/]+/)?([^/]+)/([^/?#]+)/(?:pull/|issues/)?([0-9]+)(?:[/?#.]|$)"
    part = lambda i: F.regexp_extract(url, pattern, i)
    return F.when(part(4) != "", F.lower(F.concat_ws("/", part(2), part(3), part(4))))


def details(changes: DataFrame, answers: DataFrame, url: str = "html_url") -> DataFrame:
    """changes with what recorded answers (url, status, body) tell of them, and the outcome of each.

    outcome: "ok"; "not_found" (status 404); "refused" (another status than 200); "broken" (no JSON object, or one with a
    field of another type); "missing" (never recorded); "no_change" (the address names none). Columns are null unless ok, but
    for empty title and body where the answer has none. Answers go to changes by the key in their address; of several for
    a key the best counts: ok, then broken, refused, not_found, then the greater body. No row of changes is lost or doubled.
    """
    of = F.from_json("body", DETAIL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    a = answers.select(key_of(F.col("url")).alias("key"), F.col("status").cast("int").alias("status"), "body").where("key is not null").withColumn("d", of)
    whole = (F.col("status") == 200) & F.col("d").isNotNull() & F.col("d.broken").isNull() & F.col("d.number").isNotNull()
    outcome = F.when(F.coalesce(whole, F.lit(False)), "ok").when(F.col("status") == 404, "not_found").when(F.col("status") == 200, "broken").otherwise("refused")
    a = a.withColumn("outcome", outcome).withColumn("rank", F.element_at(F.create_map(*[F.lit(x) for p in zip(("ok", "broken", "refused", "not_found"), range(4)) for x in p]), F.col("outcome")))
    best = a.groupBy("key").agg(F.min(F.struct("rank", F.length("body").alias("n"), F.col("body").alias("tie"), "outcome", "d")).alias("best"))
    best = best.select(F.col("key").alias("answer_key"), "best.outcome", "best.d")
    ok, d = F.col("outcome") == "ok", lambda f: F.col(f"d.{f}")
    told = {
        "pr_title": F.when(ok, F.coalesce(d("title"), F.lit(""))), "pr_description": F.when(ok, F.coalesce(d("body"), F.lit(""))), "pr_state": F.when(ok, d("state")),
        **{f"pr_{n}": F.when(ok, d(n)) for n in ("created_at", "closed_at", "merged_at", "additions", "deletions", "changed_files")},
        "pr_user": F.when(ok, d("user.login")), "pr_merged_by": F.when(ok, d("merged_by.login")), "patch_text": F.when(ok, d("patch")),
    }
    key = key_of(F.col(url))
    out = changes.withColumn("change_key", key).join(best, F.col("change_key") == F.col("answer_key"), "left")
    out = out.withColumn("outcome", F.when(F.col("change_key").isNull(), "no_change").otherwise(F.coalesce("outcome", F.lit("missing"))))
    return out.select(*changes.columns, *[c.alias(n) for n, c in told.items()], "outcome")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, body, unreadable) of recorded answers, a line of JSON each; lines that are none keep their text in unreadable."""
    return spark.read.schema("url string, status int, body string, unreadable string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable").json(path)
