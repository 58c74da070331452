"""Reading, saving and labelling what outside services gave, as queries over the driver's tables with their SQL."""

from __future__ import annotations

import asyncio

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.operators import calling
from patchlight.plans import labelling as records
from patchlight.plans.queries import query
from patchlight.sources import csv_splits, files, recorded, tables
from patchlight.streaming import saving


@query("SELECT page_id, url, html FROM pages", prs=False)
def src_csv_chunked(spark, sf):
    """Fields that span lines, read in splits of a file: quotes are counted by split, records cut in each."""
    path = files.fresh_folder(spark, "pages-lines")
    files.write_csv(tables.parquet(spark, sf, "pages").select("page_id", "url", "html"), path)
    return csv_splits.read(spark, path, "page_id bigint, url string, html string")


# Searches: conversations stand for keywords' topics, turns for hits


def _topic() -> Column:
    return F.concat(F.lit("topic "), F.floor(F.col("conv_id") / 12).cast("string"), F.lit("/ü"))


@query("""SELECT k AS search_keyword, turn::BIGINT AS number, text AS title, 'c/' || conv_id || '/' || turn AS html_url, CASE WHEN turn % 2 = 0 THEN 'open' ELSE 'closed' END AS state, role AS user_login FROM (
  SELECT *, 'topic ' || floor(conv_id / 12)::BIGINT || '/ü' AS k, row_number() OVER (PARTITION BY floor(conv_id / 12)::BIGINT ORDER BY conv_id, turn, role, text) AS n FROM conversations) WHERE n <= 50""", prs=False)
def src_rest_search(spark, sf):
    """Recorded pages of one search a topic, 30 hits a page, read by a data source with a partition a page; 50 hits a topic are taken."""
    c = tables.parquet(spark, sf, "conversations")
    path = files.fresh_folder(spark, "searches")
    item = F.struct(F.col("turn").cast("bigint").alias("number"), F.col("text").alias("title"), F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("html_url"), F.when(F.col("turn") % 2 == 0, "open").otherwise("closed").alias("state"), F.struct(F.col("role").alias("login")).alias("user"))
    recorded.record_search(c, path, _topic(), ["conv_id", "turn", "role", "text"], item)
    return recorded.search(spark, path, quota=50).drop("created_at")


# Details: pages stand for changes of their host, and what was recorded of them for the answers


def _addresses(pages: DataFrame) -> DataFrame:
    """page_id, html and an address that names a change, but for every twelfth page."""
    part = lambda i: F.regexp_extract("url", "^https?://([^/]+)/([^/?#]+)", i)
    at = F.concat(F.lit("https://code.example/"), part(1), F.lit("/"), part(2), F.lit("/pull/"), F.col("page_id").cast("string"))
    return pages.select("page_id", "html", F.when(F.col("page_id") % 12 == 10, "https://code.example/about").otherwise(at).alias("html_url"))


def _answers(changes: DataFrame) -> DataFrame:
    """Recorded answers (url, status, body): by number some are never made, not found, refused, cut off, of another shape or empty; some are made twice."""
    k, i = F.col("page_id") % 12, F.col("page_id")
    third = lambda c: F.when(k % 3 == 0, c)
    body = F.to_json(F.struct(
        i.alias("number"), F.when(k != 4, F.concat(F.lit("Page "), i.cast("string"))).alias("title"), F.when(k % 2 == 0, F.col("html_url")).alias("body"), F.when(k % 3 == 0, "closed").otherwise("open").alias("state"),
        third(F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string"))).alias("merged_at"), F.length("html").cast("bigint").alias("additions"), (i % 7).alias("deletions"),
        F.struct(F.concat(F.lit("u"), (i % 5).cast("string")).alias("login")).alias("user"), third(F.struct(F.lit("m").alias("login"))).alias("merged_by"), F.col("html").alias("patch"),
    ))
    rows = changes.select("page_id", F.concat("html_url", F.when(k == 2, "#again").otherwise("")).alias("url"), F.when(k == 3, 404).when(k == 6, 502).otherwise(200).alias("status"), body.alias("body")).where(k != 5)
    sent = F.when(k == 7, F.left("body", F.floor(F.length("body") / 2).cast("int"))).when(k == 8, F.regexp_replace("body", '^.."number":[0-9]+|^."number":[0-9]+', '{"number":"none"')).when(k == 9, "").otherwise(F.col("body"))
    again = rows.where(k == 1).select("url", F.lit(404).alias("status"), F.lit("{}").alias("body"))
    return rows.select("url", "status", sent.alias("body")).unionByName(again)


@query("""WITH q AS (SELECT page_id, html, page_id % 12 AS k, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 1) AS owner, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 2) AS repo FROM pages), r AS (
  SELECT *, 'https://code.example/' || owner || '/' || repo || '/pull/' || page_id AS html_url, CASE k WHEN 10 THEN 'no_change' WHEN 5 THEN 'missing' WHEN 3 THEN 'not_found' WHEN 6 THEN 'refused' WHEN 7 THEN 'broken' WHEN 8 THEN 'broken' WHEN 9 THEN 'broken' ELSE 'ok' END AS outcome FROM q
) SELECT page_id, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN k = 4 THEN '' ELSE 'Page ' || page_id END END AS pr_title, CASE WHEN outcome = 'ok' THEN CASE WHEN k % 2 = 0 THEN html_url ELSE '' END END AS pr_description,
  CASE WHEN outcome = 'ok' THEN CASE WHEN k % 3 = 0 THEN 'closed' ELSE 'open' END END AS pr_state, CASE WHEN outcome = 'ok' AND k % 3 = 0 THEN '2024-01-0' || (k % 9 + 1) END AS pr_merged_at, CASE WHEN outcome = 'ok' THEN length(html) END::BIGINT AS pr_additions,
  CASE WHEN outcome = 'ok' THEN 'u' || page_id % 5 END AS pr_user, CASE WHEN outcome = 'ok' AND k % 3 = 0 THEN 'm' END AS pr_merged_by, CASE WHEN outcome = 'ok' THEN html END AS patch_text, count(*) OVER (PARTITION BY outcome) AS of_outcome FROM r""", prs=False)
def src_rest_detail(spark, sf):
    """Details of each page from recorded answers, each row with its outcome and how many rows have that."""
    changes = _addresses(tables.parquet(spark, sf, "pages"))
    path = files.fresh_folder(spark, "answers")
    files.write_json(_answers(changes), path)
    found = recorded.details(changes, recorded.read_answers(spark, path))
    n = found.groupBy("outcome").agg(F.count("*").alias("of_outcome"))  # six rows
    return found.join(F.broadcast(n), "outcome").select("page_id", "outcome", "pr_title", "pr_description", "pr_state", "pr_merged_at", "pr_additions", "pr_user", "pr_merged_by", "patch_text", "of_outcome")


# Saving in batches


_CUSTOMER = "c_custkey bigint, c_name string, c_mktsegment string"


def _in_files(df: DataFrame, name: str, n: int) -> str:
    path = files.fresh_folder(df.sparkSession, name)
    df.repartition(n).write.parquet(path)
    return path


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer", prs=False)
def incremental_save(spark, sf):
    """Two files a batch are saved; a run that is stopped within its second batch is started again."""
    source = _in_files(tables.parquet(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "arrived", 5)
    target = files.fresh_folder(spark, "saved")

    def stop(batch: int) -> None:
        if batch == 1:
            raise InterruptedError("stopped within a batch")

    try:
        saving.save(spark, source, _CUSTOMER, target, files_per_batch=2, before_commit=stop)
    except Exception as e:  # the stream's own error holds the cause
        if "stopped within a batch" not in str(e):
            raise
    saving.save(spark, source, _CUSTOMER, target, files_per_batch=2)
    return saving.saved(spark, target, _CUSTOMER).drop("batch")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", prs=False)
def resume_checkpoint(spark, sf):
    """The orders that are still to be done, after those with returned items were done and saved in batches."""
    done = tables.parquet(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    target = files.fresh_folder(spark, "done")
    saving.save(spark, _in_files(done, "worked-on", 4), "o_orderkey bigint", target, files_per_batch=3)
    return saving.remaining(tables.parquet(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), spark, target, "o_orderkey bigint", "o_orderkey")


# Labelling by two agents: recorded answers, some late, some errors, come through the pool of calls


def replay(field: str):
    """A client that gives the answer recorded with the row, takes too long or fails, as its outcome says."""

    async def client(row: dict) -> str:
        if field == "answer" and row["recorded_outcome"] == "error":
            raise ConnectionError("refused")
        if field == "answer" and row["recorded_outcome"] == "timeout":
            await asyncio.sleep(3600)
        return row[f"recorded_{field}"]

    return client


_SHORT = 0.05


@query(records._RECORDS.replace("Timeout after 30 seconds", f"Timeout after {_SHORT:g} seconds") + "SELECT * FROM lr", prs=False)
def llm_call(spark, sf):
    """Documents with labels are shown to a first agent, whose answer a second one reviews, 16 calls at a time in a task."""
    told = records.answers(spark, sf).select("doc_id", *[F.col(c).alias(f"recorded_{c}") for c in ("answer", "review", "outcome")])
    docs = tables.parquet(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    changes = told.join(docs, "doc_id", "left").withColumns({"commit_messages": F.lit(None).cast("string"), "patch_text": F.lit(None).cast("string"), "additions": F.lit(0), "deletions": F.lit(0), "files": F.lit(0)})
    sent = ("recorded_answer", "recorded_review", "recorded_outcome")
    done = calling.two_agents(changes, "TypeScript", lambda: replay("answer"), lambda: replay("review"), sent, deadline=_SHORT)
    return done.drop(*sent, "review_outcome")
