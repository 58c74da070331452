"""The operators as queries over the driver's tables, each with the SQL that gives the same rows.

Changes are orders (of a customer, who stands for the repository, by priority, which stands for the author), merged when
the first of their line items was shipped later; line items are the files of a change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions import distributions as D
from patchlight.functions import patch as P
from patchlight.functions import statistics as S
from patchlight.operators import changes as O
from patchlight.sources import tables
from patchlight.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AGENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]

PR_SQL = """WITH d AS (
  SELECT l_orderkey AS pr_id, l_partkey AS filename, l_linenumber AS line, l_quantity::BIGINT AS additions, round(l_discount * 100)::BIGINT AS deletions, l_quantity::BIGINT + round(l_discount * 100)::BIGINT AS changes, l_shipdate AS shipped_at FROM lineitem
), st AS (
  SELECT pr_id, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(changes)::BIGINT AS changes, count(DISTINCT filename) AS files, min(shipped_at) AS shipped FROM d GROUP BY pr_id
), pr AS (
  SELECT o_orderkey AS id, o_custkey AS repo_id, o_orderpriority AS agent, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'AI' ELSE 'Human' END AS agent_group,
    CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderdate AS created_at, CASE WHEN shipped > o_orderdate THEN shipped END AS merged_at,
    coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(changes, 0) AS changes, coalesce(files, 0) AS files FROM orders LEFT JOIN st ON pr_id = o_orderkey
), p AS (
  SELECT *, CASE WHEN merged_at IS NOT NULL THEN 'merged' ELSE lower(state) END AS status,
    CASE WHEN changes <= 10 THEN 'Small' WHEN changes <= 50 THEN 'Medium' WHEN changes <= 200 THEN 'Large' ELSE 'Very Large' END AS size FROM pr
)
"""


def query(sql: str | None = None, prs: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = PR_SQL + sql if prs else sql
        return f

    return add


def details(spark: SparkSession, sf: str) -> DataFrame:
    deleted = F.round(F.col("l_discount") * 100).cast("bigint")
    added = F.col("l_quantity").cast("bigint")
    return tables.parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pr_id"), F.col("l_partkey").alias("filename"), F.col("l_linenumber").alias("line"), added.alias("additions"), deleted.alias("deletions"), (added + deleted).alias("changes"), F.col("l_shipdate").alias("shipped_at"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """What orders alone tell of changes."""
    agent = F.col("o_orderpriority")
    return tables.parquet(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), agent.alias("agent"), O.group_of(agent, AGENTS).alias("agent_group"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.col("o_orderdate").alias("created_at"))


def prs(spark: SparkSession, sf: str) -> DataFrame:
    """Changes with the sums of their details, from which the time of merging comes, too: one aggregation, one join."""
    stats = O.commit_stats(details(spark, sf), F.min("shipped_at").alias("shipped")).withColumnRenamed("pr_id", "id")
    o = orders(spark, sf).join(stats, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("additions", "deletions", "changes", "files")})
    o = o.withColumn("merged_at", F.when(F.col("shipped") > F.col("created_at"), F.col("shipped"))).drop("shipped")
    return o.withColumns({"status": O.status(F.col("merged_at"), F.col("state")), "size": O.size_bucket(F.col("changes"))})


def _merged() -> Column:
    return F.col("status") == "merged"


# Sources


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40", prs=False)
def src_parquet(spark, sf):
    return tables.parquet(spark, sf, "part").where("p_size > 40").select("p_partkey", "p_name")


@query("SELECT c_custkey AS id, c_name AS title, '' AS body, 0 AS stars FROM customer", prs=False)
def conform_columns(spark, sf):
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("stars", T.IntegerType())])
    return tables.conform(tables.parquet(spark, sf, "customer"), shape, {"body": "", "stars": 0}, {"id": ["c_custkey"], "title": ["c_title", "c_name"]})


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([0-9]+)', 1) AS owner, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([0-9]+)', 2) AS repo, TRY_CAST(nullif(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([0-9]+)', 3), '') AS BIGINT) AS number FROM pages", prs=False)
def parse_pr_url(spark, sf):
    p = r"^https?://([^/]+)/([^/?#]+)/([0-9]+)"
    part = lambda i: F.regexp_extract("url", p, i)
    return tables.parquet(spark, sf, "pages").select("page_id", part(1).alias("owner"), part(2).alias("repo"), F.expr("try_cast(nullif(regexp_extract(url, r'^https?://([^/]+)/([^/?#]+)/([0-9]+)', 3), '') AS bigint)").alias("number"))


@query("SELECT page_id, string_split(replace(replace(url, 'https://', ''), 'http://', ''), '/')[1] AS first, string_split(url, '/')[-1] AS last FROM pages", prs=False)
def url_split(spark, sf):
    bare = F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return tables.parquet(spark, sf, "pages").select("page_id", F.split(bare, "/")[0].alias("first"), F.element_at(F.split("url", "/"), -1).alias("last"))


# Selecting and labelling


@query("SELECT id, agent_group FROM p")
def classify_group(spark, sf):
    return orders(spark, sf).select("id", "agent_group")


@query("SELECT id, agent FROM p WHERE agent_group = 'AI'")
def filter_ai_agents(spark, sf):
    return orders(spark, sf).where(F.col("agent").isin(AGENTS)).select("id", "agent")


@query("SELECT id, status, size FROM p")
def pr_status_and_size(spark, sf):
    return prs(spark, sf).select("id", "status", "size")


_RATIO = "CASE WHEN additions > 0 THEN deletions::DOUBLE / additions ELSE 0 END"


@query(f"SELECT id, round(ratio, 6) AS ratio, CASE WHEN abs(ratio - 1) < 0.5 THEN 'Balanced Changes' WHEN ratio < 0.5 THEN 'More Additions' WHEN ratio > 1.5 THEN 'More Deletions' END AS pattern FROM (SELECT id, {_RATIO} AS ratio FROM p)")
def change_ratio(spark, sf):
    r = O.ratio(F.col("deletions"), F.col("additions"))
    return prs(spark, sf).select("id", F.round(r, 6).alias("ratio"), O.change_pattern(r).alias("pattern"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build')", prs=False)
def filter_repo_lang(spark, sf):
    return tables.parquet(spark, sf, "customer").where(O.contains_word(F.col("c_mktsegment"), "Build")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", prs=False)
def filter_repo_lang_exact(spark, sf):
    return tables.parquet(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")


@query("SELECT id, CASE WHEN files <= 0 THEN 'None' WHEN files <= 2 THEN 'Low' WHEN files <= 5 THEN 'Medium' ELSE 'High' END AS bucket FROM p")
def complexity_bucket(spark, sf):
    return prs(spark, sf).select("id", O.complexity_bucket(F.col("files")).alias("bucket"))


@query("SELECT id, round((deletions - additions)::DOUBLE / (additions + deletions), 6) AS safety FROM p WHERE additions + deletions > 0")
def safety_ratio(spark, sf):
    total = F.col("additions") + F.col("deletions")
    return prs(spark, sf).where(total > 0).select("id", F.round((F.col("deletions") - F.col("additions")).cast("double") / total, 6).alias("safety"))


@query("SELECT id, CASE WHEN additions > 0 AND deletions > 0 THEN 'Both' WHEN additions > 0 THEN 'Only Adds' WHEN deletions > 0 THEN 'Only Removes' END AS behaviour, CASE WHEN deletions > additions THEN 'Improves' WHEN deletions < additions THEN 'Reduces' ELSE 'Neutral' END AS resolution, additions - deletions AS net, least(additions, deletions) AS replaced FROM p")
def net_operations(spark, sf):
    a, d = F.col("additions"), F.col("deletions")
    behaviour = F.when((a > 0) & (d > 0), "Both").when(a > 0, "Only Adds").when(d > 0, "Only Removes")
    return prs(spark, sf).select("id", behaviour.alias("behaviour"), F.when(d > a, "Improves").when(d < a, "Reduces").otherwise("Neutral").alias("resolution"), (a - d).alias("net"), F.least(a, d).alias("replaced"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN t[:80] || ' [cut]' ELSE t END AS clipped, coalesce(nullif(left(t, 20), ''), 'none') AS head FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13), ' ') AS t FROM documents)", prs=False)
def clip_text(spark, sf):
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" "))
    return tables.parquet(spark, sf, "documents").select("doc_id", F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 80), F.lit(" [cut]"))).otherwise(t).alias("clipped"), F.coalesce(F.nullif(F.left(t, F.lit(20)), F.lit("")), F.lit("none")).alias("head"))


# Joins


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'type_related' ELSE 'not_type_related' END AS label FROM documents LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS r FROM labels) WHERE r = 1) l USING (doc_id)", prs=False)
def left_join_labels(spark, sf):
    labels = O.first_rows(tables.parquet(spark, sf, "labels"), ["doc_id"], [F.col("quality").asc_nulls_last(), F.col("toxic").asc_nulls_last()])
    return tables.parquet(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "type_related").otherwise("not_type_related").alias("label"))


@query("SELECT id FROM p WHERE repo_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_repo(spark, sf):
    repos = tables.parquet(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("repo_id"))
    return orders(spark, sf).join(repos, "repo_id", "left_semi").select("id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", prs=False)
def anti_join_seen(spark, sf):
    seen = tables.parquet(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.not_seen(tables.parquet(spark, sf, "customer"), seen, "c_custkey").select("c_custkey")


@query("SELECT id, additions, deletions, changes, files FROM p")
def left_join_stats(spark, sf):
    return prs(spark, sf).select("id", "additions", "deletions", "changes", "files")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id", prs=False)
def lookup_first_k(spark, sf):
    return O.joined_text(tables.parquet(spark, sf, "conversations"), "conv_id", ["turn"], F.col("text"), "\n", 5)


# Summing up


_SHARE = "round(100.0::DOUBLE * {} / greatest(1, (SELECT count(*) FROM orders)), 6)"


@query(f"SELECT count(DISTINCT pr_id) AS covered, {_SHARE.format('count(DISTINCT pr_id)')} AS share, count(DISTINCT pr_id) FILTER (WHERE filename % 4 = 2) AS rust, {_SHARE.format('count(DISTINCT pr_id) FILTER (WHERE filename % 4 = 2)')} AS rust_share FROM d")
def coverage(spark, sf):
    """Changes with details, and those with files of one kind: counted by change first, so no distinct keys are gathered."""
    has = details(spark, sf).groupBy("pr_id").agg(F.max((F.col("filename") % 4 == 2).cast("int")).alias("rust")).agg(F.count("*").alias("covered"), F.coalesce(F.sum("rust"), F.lit(0)).alias("rust"))
    n = tables.parquet(spark, sf, "orders").agg(F.count("*").alias("n"))
    share = lambda c: F.round(F.lit(100.0) * F.col(c) / F.greatest("n", F.lit(1)), 6)
    return has.join(n).select("covered", share("covered").alias("share"), "rust", share("rust").alias("rust_share"))


@query("SELECT name, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'merged') / count(*), 6) AS rate FROM (SELECT CASE WHEN agent_group = 'AI' THEN agent ELSE 'Human' END AS name, status FROM p) GROUP BY name")
def acceptance_by_agent(spark, sf):
    name = F.when(F.col("agent_group") == "AI", F.col("agent")).otherwise("Human")
    rates = prs(spark, sf).groupBy(name.alias("name")).agg(F.round(F.lit(100.0) * F.count_if(_merged()) / F.count("*"), 6).alias("rate"))
    return rates.orderBy(F.col("name") == "Human", F.desc("rate"))


@query("SELECT pr_id, additions, deletions, changes, files FROM st")
def commit_stats(spark, sf):
    return O.commit_stats(details(spark, sf))


@query("SELECT pr_id, string_agg('=== ' || filename || ' (+' || additions || '/-' || deletions || ') ===', chr(10) || chr(10) ORDER BY line, filename, additions::VARCHAR, deletions::VARCHAR) AS text FROM d GROUP BY pr_id")
def collect_patches(spark, sf):
    head = F.format_string("=== %s (+%s/-%s) ===", F.col("filename").cast("string"), F.col("additions").cast("string"), F.col("deletions").cast("string"))
    return O.joined_text(details(spark, sf).withColumns({"a": F.col("additions").cast("string"), "b": F.col("deletions").cast("string")}), "pr_id", ["line", "filename", "a", "b"], head, "\n\n")


@query("SELECT agent, count(*) AS n FROM p GROUP BY agent ORDER BY n DESC")
def value_counts(spark, sf):
    return orders(spark, sf).groupBy("agent").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT coalesce(p_brand, 'Unknown') AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 20", prs=False)
def top_languages(spark, sf):
    return tables.parquet(spark, sf, "part").groupBy(F.coalesce("p_brand", F.lit("Unknown")).alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(20)


@query("""SELECT agent_group, count(*) AS total, count(*) FILTER (WHERE status = 'merged') AS merged, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status = 'open') AS "open",
  round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'merged') / count(*), 6) AS merge_rate, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'closed') / count(*), 6) AS close_rate, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'open') / count(*), 6) AS open_rate FROM p GROUP BY agent_group""")
def acceptance_metrics(spark, sf):
    return O.acceptance(prs(spark, sf), "agent_group")


@query("SELECT s.size, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'merged') / nullif(count(id), 0), 6), 0) AS rate FROM (VALUES ('Small'), ('Medium'), ('Large'), ('Very Large')) s(size) LEFT JOIN p ON p.size = s.size GROUP BY s.size")
def acceptance_by_size(spark, sf):
    every = spark.sql("SELECT * FROM VALUES ('Small'), ('Medium'), ('Large'), ('Very Large') AS t(size)")
    rates = prs(spark, sf).groupBy("size").agg(F.round(F.lit(100.0) * F.count_if(_merged()) / F.count("*"), 6).alias("rate"))
    return every.join(rates, "size", "left").select("size", F.coalesce("rate", F.lit(0.0)).alias("rate"))


@query("SELECT agent_group, round(median(h), 4) AS median, round(avg(h), 4) AS mean, round(stddev_samp(h), 4) AS std FROM (SELECT agent_group, epoch_us(merged_at - created_at) / 3.6e9 AS h FROM p WHERE merged_at IS NOT NULL) WHERE h > 0 GROUP BY agent_group")
def time_to_merge_stats(spark, sf):
    h = prs(spark, sf).where(_merged()).select("agent_group", O.hours_between(F.col("created_at"), F.col("merged_at")).alias("h")).where("h > 0")
    m = D.quantiles(h, ["agent_group"], F.col("h"), {"median": 0.5}).withColumn("median", F.round("median", 4))
    return h.groupBy("agent_group").agg(F.round(F.avg("h"), 4).alias("mean"), F.round(F.stddev_samp("h"), 4).alias("std")).join(m, "agent_group")


@query("SELECT agent, round(avg(changes), 6) AS mean, round(stddev_samp(changes), 6) AS std, round(stddev_samp(changes) / sqrt(count(*)), 6) AS sem, round(1.96::DOUBLE * stddev_samp(changes) / sqrt(count(*)), 6) AS ci FROM p GROUP BY agent")
def mean_std_sem_ci(spark, sf):
    return prs(spark, sf).groupBy("agent").agg(*[F.round(c, 6).alias(n) for n, c in O.spread(F.col("changes").cast("double")).items()])


# Windows, distributions, samples, sets


@query("SELECT id, round(100.0::DOUBLE * avg((status = 'merged')::INT) OVER (PARTITION BY agent_group ORDER BY created_at RANGE BETWEEN INTERVAL '2591999999999 microseconds' PRECEDING AND CURRENT ROW), 6) AS rolling FROM p")
def rolling_rate_30d(spark, sf):
    r = O.rolling_mean(prs(spark, sf).select("id", "agent_group", "created_at", "status"), ["agent_group"], "created_at", _merged().cast("int"))
    return r.select("id", F.round(100 * F.col("rolling"), 6).alias("rolling"))


@query("SELECT agent_group, count(*) AS n, round(avg(changes), 6) AS mean, round(quantile_cont(changes, 0.25), 6) AS q1, round(quantile_cont(changes, 0.5), 6) AS q2, round(quantile_cont(changes, 0.75), 6) AS q3 FROM p WHERE changes > 0 GROUP BY agent_group")
def box_stats(spark, sf):
    p = prs(spark, sf).where("changes > 0").select("agent_group", "changes")
    q = D.quantiles(p, ["agent_group"], F.col("changes"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})
    return p.groupBy("agent_group").agg(F.count("*").alias("n"), F.round(F.avg("changes"), 6).alias("mean")).join(q, "agent_group")


@query("""SELECT agent_group, i AS place, round(lo + i * step, 6) AS at, round(d, 6) AS density FROM (
  SELECT agent_group, i, any_value(lo) AS lo, any_value(step) AS step, CASE WHEN any_value(h) > 0 THEN sum(exp(-0.5::DOUBLE * pow((lo + i * step - changes) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) ELSE 1 END AS d FROM (
    SELECT agent_group, changes, min(changes) OVER g AS lo, (max(changes) OVER g - min(changes) OVER g) / 99.0::DOUBLE AS step, count(*) OVER g AS n, stddev_samp(changes) OVER g * pow(count(*) OVER g, -0.2::DOUBLE) AS h FROM p WHERE changes > 0 WINDOW g AS (PARTITION BY agent_group))
  , (SELECT unnest(range(100))::INT AS i) GROUP BY agent_group, i)""")
def violin_data(spark, sf):
    """What a violin of each group's changed lines shows: the density at 100 places. SQL sums the curves of all rows."""
    d = D.kernel_density(prs(spark, sf).where("changes > 0"), ["agent_group"], F.col("changes"))
    return d.select("agent_group", "place", F.round("at", 6).alias("at"), F.round("density", 6).alias("density"))


@query("SELECT agent, changes, round(max(r)::DOUBLE / any_value(n), 6) AS share FROM (SELECT agent, changes, row_number() OVER (PARTITION BY agent ORDER BY changes) AS r, count(*) OVER (PARTITION BY agent) AS n FROM p) GROUP BY agent, changes")
def ecdf(spark, sf):
    v = prs(spark, sf).groupBy("agent", "changes").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("agent").orderBy("changes").rowsBetween(Window.unboundedPreceding, 0))
    return v.select("agent", "changes", F.round(upto.cast("double") / F.sum("n").over(Window.partitionBy("agent")), 6).alias("share"))


@query("SELECT id, rank() OVER (PARTITION BY agent ORDER BY changes) + (count(*) OVER (PARTITION BY agent, changes) - 1) / 2.0::DOUBLE AS rank FROM p")
def average_rank(spark, sf):
    return S.midranks(prs(spark, sf).select("id", "agent", "changes"), "changes", ["agent"]).select("id", "rank")


@query("SELECT quality, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42/' || doc_id), doc_id) AS r FROM labels) WHERE r <= 25", prs=False)
def stratified_sample(spark, sf):
    return O.sampled(tables.parquet(spark, sf, "labels"), "quality", "doc_id", 25).select("quality", "doc_id")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1", prs=False)
def distinct_keep_first(spark, sf):
    return O.first_rows(tables.parquet(spark, sf, "documents"), ["source"], [F.col("doc_id")]).select("source", "doc_id")


@query("SELECT c_custkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier", prs=False)
def union_all(spark, sf):
    a = tables.parquet(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("kind"))
    return a.unionByName(tables.parquet(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", prs=False)
def index_intersection(spark, sf):
    o = tables.parquet(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


# Time


@query("SELECT last_day(m) AS month, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m", prs=False)
def monthly_volume(spark, sf):
    """By the last day of each month; months without any are there, too."""
    return O.calendar(tables.parquet(spark, sf, "orders"), "o_orderdate").select(F.last_day("month").alias("month"), "n")


@query("SELECT w.weekday, count(event_id) AS n, round(100.0::DOUBLE * count(event_id) / nullif((SELECT count(*) FROM events), 0), 6) AS share FROM (SELECT unnest(generate_series(0, 6)) AS weekday) w LEFT JOIN events ON isodow(ts) - 1 = w.weekday GROUP BY w.weekday", prs=False)
def weekday_dist(spark, sf):
    return O.weekdays(tables.parquet(spark, sf, "events"), "ts")


@query("SELECT last_day(m) AS month, round(h, 4) AS median FROM (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM (SELECT date_trunc('month', created_at) AS m FROM p WHERE merged_at > created_at)) LEFT JOIN (SELECT date_trunc('month', created_at) AS m, median(epoch_us(merged_at - created_at) / 3.6e9) AS h FROM p WHERE merged_at > created_at GROUP BY 1) USING (m)")
def monthly_median_ttm(spark, sf):
    """Months without a merged change have a row, but no median."""
    h = O.hours_between(F.col("created_at"), F.col("merged_at"))
    m = D.quantiles(prs(spark, sf).where(_merged()).withColumn("month", O.unit_of("month", F.col("created_at"))), ["month"], h, {"median": 0.5}).withColumn("median", F.round("median", 4))
    return O.units(m, "month").join(m, "month", "left").select(F.last_day("month").alias("month"), "median")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2", prs=False)
def stream_event_windows(spark, sf):
    return windows.replay(spark, sf)


# Patches and patterns: lines of documents that begin with E stand for added, with T for removed ones

_LINES = "WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) "


@query(_LINES + "SELECT doc_id, array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, 'E') AND NOT starts_with(x, 'EEE')), lambda x: x[2:]), chr(10)) AS added, len(list_filter(l, lambda x: starts_with(x, 'T') AND NOT starts_with(x, 'TTT')))::INT AS removed FROM t", prs=False)
def added_lines(spark, sf):
    return tables.parquet(spark, sf, "documents").select("doc_id", P.marked_text(F.col("text"), "E").alias("added"), F.size(P.marked(F.col("text"), "T")).alias("removed"))


@query(_LINES + "SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: starts_with(l[i], 'T') AND starts_with(l[i + 1], 'E')))::BIGINT AS n FROM t", prs=False)
def adjacent_lines(spark, sf):
    return tables.parquet(spark, sf, "documents").select("doc_id", P.followed_by(F.col("text"), lambda x: x.startswith("T"), lambda x: x.startswith("E")).alias("n"))


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_ASCII = "(SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g') AS t FROM pages)"


def _ascii_pages(spark, sf):
    return tables.parquet(spark, sf, "pages").select("page_id", F.regexp_replace("html", r"[^\x00-\x7F]", " ").alias("t"))


# Statistics

_Z = "greatest((abs(u1 - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) / sqrt(2.0::DOUBLE)"


@query("SELECT round((ma - mh) / sqrt(((na - 1) * va + (nh - 1) * vh) / (na + nh - 2)), 6) AS d FROM (SELECT avg(changes) FILTER (WHERE agent_group = 'AI') AS ma, avg(changes) FILTER (WHERE agent_group <> 'AI') AS mh, var_samp(changes) FILTER (WHERE agent_group = 'AI') AS va, var_samp(changes) FILTER (WHERE agent_group <> 'AI') AS vh, (count(*) FILTER (WHERE agent_group = 'AI'))::DOUBLE AS na, (count(*) FILTER (WHERE agent_group <> 'AI'))::DOUBLE AS nh FROM p)")
def cohens_d_pooled(spark, sf):
    return prs(spark, sf).agg(F.round(S.cohens_d(F.col("changes").cast("double"), F.col("agent_group") == "AI"), 6).alias("d"))


@query(f"""SELECT repo_group, a, b, c, d, round(chi2, 6) AS chi2, round({S.erfc_sql('sqrt(chi2 / 2.0)')}, 6) AS p, round(sqrt(chi2 / (a + b + c + d)), 6) AS v, CASE WHEN b = 0 OR c = 0 THEN 'inf'::DOUBLE ELSE round(a * d / (b * c)::DOUBLE, 6) END AS odds FROM (
  SELECT *, (a + b + c + d) * pow(greatest(abs(a * d - b * c)::DOUBLE - (a + b + c + d) / 2.0::DOUBLE, 0), 2) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) AS chi2 FROM (
    SELECT repo_id % 3 AS repo_group, count(*) FILTER (WHERE agent_group = 'AI' AND status = 'merged') AS a, count(*) FILTER (WHERE agent_group = 'AI' AND status <> 'merged') AS b, count(*) FILTER (WHERE agent_group <> 'AI' AND status = 'merged') AS c, count(*) FILTER (WHERE agent_group <> 'AI' AND status <> 'merged') AS d FROM p GROUP BY 1))""")
def chi2_2x2(spark, sf):
    t = _tables_2x2(prs(spark, sf).withColumn("repo_group", F.col("repo_id") % 3), "repo_group")
    chi2 = S.chi2_yates(*map(F.col, "abcd"))
    return t.select("repo_group", *"abcd", F.round(chi2, 6).alias("chi2"), F.round(S.chi2_p(chi2), 6).alias("p"), F.round(S.cramers_v(chi2, F.col("a") + F.col("b") + F.col("c") + F.col("d")), 6).alias("v"), F.round(S.odds_ratio(*map(F.col, "abcd")), 6).alias("odds"))


def _tables_2x2(df: DataFrame, by: str) -> DataFrame:
    ai, m = F.col("agent_group") == "AI", _merged()
    return df.groupBy(by).agg(F.count_if(ai & m).alias("a"), F.count_if(ai & ~m).alias("b"), F.count_if(~ai & m).alias("c"), F.count_if(~ai & ~m).alias("d"))


@query("""SELECT repo_id, round(least(1, sum(q) FILTER (WHERE q <= o * 1.0000001)), 6) AS p FROM (SELECT *, exp(base - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS q, exp(base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS o FROM (
  SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS x FROM (
    SELECT repo_id, count(*) FILTER (WHERE agent_group = 'AI' AND status = 'merged') AS a, count(*) FILTER (WHERE agent_group = 'AI' AND status <> 'merged') AS b, count(*) FILTER (WHERE agent_group <> 'AI' AND status = 'merged') AS c, count(*) FILTER (WHERE agent_group <> 'AI' AND status <> 'merged') AS d FROM p GROUP BY 1))) GROUP BY repo_id""")
def fisher_exact(spark, sf):
    return _tables_2x2(prs(spark, sf), "repo_id").select("repo_id", F.round(S.fisher_p(*map(F.col, "abcd")), 6).alias("p"))


@query("SELECT round(corr(additions, deletions), 6) AS ad, round(corr(additions, files), 6) AS af, round(corr(deletions, files), 6) AS df FROM p")
def corr_matrix(spark, sf):
    return prs(spark, sf).agg(*[F.round(F.corr(a, b), 6).alias(a[0] + b[0]) for a, b in (("additions", "deletions"), ("additions", "files"), ("deletions", "files"))])


_SQUARINGS = 14


def _component_sql(i: int, of: str) -> str:
    """The first component of a table (i, j, x): a column of its square's square's ... square, by which others vanish, at length 1, its greatest loading positive."""
    steps = "".join(f""", q{i}{k} AS MATERIALIZED (SELECT i, j, x / sum(CASE WHEN i = j THEN x END) OVER () AS x FROM (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {of if k == 0 else f"q{i}{k - 1}"} a JOIN {of if k == 0 else f"q{i}{k - 1}"} b ON a.j = b.i GROUP BY a.i, b.j))""" for k in range(_SQUARINGS))
    return steps + f""", v{i} AS MATERIALIZED (SELECT i, x / sqrt(sum(x * x) OVER ()) * sign(first_value(x) OVER (ORDER BY round(abs(x / sqrt((SELECT sum(x * x) FROM q{i}{_SQUARINGS - 1} WHERE j = (SELECT arg_max(i, x) FROM q{i}{_SQUARINGS - 1} WHERE i = j)))), 12) DESC, i)) AS w FROM q{i}{_SQUARINGS - 1} WHERE j = (SELECT arg_max(i, x) FROM q{i}{_SQUARINGS - 1} WHERE i = j)
), l{i} AS (SELECT sum(a.w * c.x * b.w) AS l FROM {of} c JOIN v{i} a ON a.i = c.i JOIN v{i} b ON b.i = c.j)"""


@query(f"""WITH e AS MATERIALIZED (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i) WHERE embedding IS NOT NULL
), s AS MATERIALIZED (SELECT vec_id, i, (x - avg(x) OVER c) / nullif(stddev_pop(x) OVER c, 0) AS z FROM e WINDOW c AS (PARTITION BY i)
), c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / (SELECT count(DISTINCT vec_id) FROM s) AS x FROM s a JOIN s b USING (vec_id) GROUP BY a.i, b.i){_component_sql(1, "c")}
, c2 AS MATERIALIZED (SELECT c.i, c.j, c.x - (SELECT l FROM l1) * a.w * b.w AS x FROM c JOIN v1 a ON a.i = c.i JOIN v1 b ON b.i = c.j){_component_sql(2, "c2")}
SELECT vec_id, round(sum(z * v1.w), 6) AS c1, round(sum(z * v2.w), 6) AS c2, round((SELECT l FROM l1) / (SELECT sum(x) FROM c WHERE i = j), 6) AS ratio1, round((SELECT l FROM l2) / (SELECT sum(x) FROM c WHERE i = j), 6) AS ratio2
FROM s JOIN v1 USING (i) JOIN v2 USING (i) GROUP BY vec_id""", prs=False)
def standardize_pca(spark, sf):
    """Two components of standardised embeddings with the part of the variance that each explains. SQL squares the matrix of correlations until one is left."""
    v = tables.parquet(spark, sf, "embeddings").where("embedding is not null")
    of = D.principal_components(v, "embedding", 2)
    c1, c2 = D.scores(v, "embedding", of)
    return v.select("vec_id", F.round(c1, 6).alias("c1"), F.round(c2, 6).alias("c2"), *[F.round(F.lit(float(r)), 6).alias(f"ratio{i + 1}") for i, r in enumerate(of.ratio)])


# Labelling


_CM = "count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND NOT t) AS tn, count(*) FILTER (WHERE NOT p AND t) AS fn"


@query(f"SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT {_CM} FROM (SELECT quality = 1 AS p, toxic = 1 AS t FROM labels))", prs=False)
def eval_metrics(spark, sf):
    return O.confusion(tables.parquet(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


# More of the same


@query("SELECT d.pr_id, count(*) AS rows, count(*) > 0 AS has_files FROM d JOIN pr ON pr.id = d.pr_id AND pr.agent_group = 'AI' GROUP BY d.pr_id")
def file_count(spark, sf):
    chosen = tables.parquet(spark, sf, "orders").where(F.col("o_orderpriority").isin(AGENTS)).select(F.col("o_orderkey").alias("pr_id"))
    return details(spark, sf).join(chosen, "pr_id", "left_semi").groupBy("pr_id").agg(F.count("*").alias("rows")).withColumn("has_files", F.col("rows") > 0)


@query("SELECT id FROM p WHERE files > 0 AND state <> 'open' AND (additions > 50 OR deletions > 20)")
def filter_type_prs(spark, sf):
    return prs(spark, sf).where((F.col("files") > 0) & (F.col("state") != "open") & ((F.col("additions") > 50) | (F.col("deletions") > 20))).select("id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE additions > 0) AS adding, sum(CASE WHEN agent_group = 'AI' THEN additions ELSE 0 END)::BIGINT AS ai_additions, sum(deletions)::BIGINT AS deletions FROM p")
def group_totals(spark, sf):
    return prs(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("additions") > 0).alias("adding"), F.sum(F.when(F.col("agent_group") == "AI", F.col("additions")).otherwise(0)).alias("ai_additions"), F.sum("deletions").alias("deletions"))


@query("SELECT v.unique AS features, count(id) AS n FROM (SELECT unnest(generate_series(0, 15)) AS unique) v LEFT JOIN p ON p.files = v.unique GROUP BY 1", prs=True)
def diversity_hist(spark, sf):
    n = prs(spark, sf).groupBy(F.col("files").alias("features")).agg(F.count("*").alias("n"))
    return spark.range(16).select(F.col("id").alias("features")).join(n, "features", "left").select("features", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT agent_group, count(*) AS n, round(avg(changes), 6) AS mean, round(median(changes), 6) AS median FROM p WHERE changes > 0 GROUP BY agent_group")
def nonzero_filtered_stats(spark, sf):
    p = prs(spark, sf).where("changes > 0").select("agent_group", "changes")
    m = D.quantiles(p, ["agent_group"], F.col("changes"), {"median": 0.5}).withColumn("median", F.round("median", 6))
    return p.groupBy("agent_group").agg(F.count("*").alias("n"), F.round(F.avg("changes"), 6).alias("mean")).join(m, "agent_group")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders", prs=False)
def batch_slices(spark, sf):
    return _batches(tables.parquet(spark, sf, "orders"))


def _batches(orders: DataFrame) -> DataFrame:
    """Batches of 100 keys in order."""
    return O.places(orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.floor(F.col("place") / 100).alias("batch"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders", prs=False)
def batch_slices_all(spark, sf):
    """batch_slices of all orders."""
    return _batches(tables.parquet(spark, sf, "orders"))
