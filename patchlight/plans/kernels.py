"""More operators as queries with their SQL: files, labels, kernels over lines, effect sizes, populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.functions import distributions as D
from patchlight.functions import patch as P
from patchlight.functions import patterns as C
from patchlight.functions import statistics as S
from patchlight.operators import changes as O
from patchlight.plans.queries import _ASCII, _LINES, _Z, AGENTS, _ascii_pages, _merged, _quoted, _tables_2x2, details, prs, query
from patchlight.sources import files, tables

# Files


@query("SELECT page_id, url, html FROM pages", prs=False)
def src_csv(spark, sf):
    path = files.fresh_folder(spark, "pages-csv")
    files.write_csv(tables.parquet(spark, sf, "pages").select("page_id", "url", "html"), path)
    return tables.csv(spark, path, "page_id bigint, url string, html string")


@query("SELECT o_orderkey, o_orderstatus FROM orders", prs=False)
def sink_csv(spark, sf):
    path = files.fresh_folder(spark, "orders-csv")
    files.write_csv(files.existing(tables.parquet(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "html_url"]), path)
    return tables.csv(spark, path, "o_orderkey bigint, o_orderstatus string")


@query("SELECT '| agent_group | n | merged |' AS line UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || agent_group || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE status = 'merged') || ' |' FROM p GROUP BY agent_group")
def sink_md(spark, sf):
    """A table as one Markdown file, and its lines."""
    r = prs(spark, sf).groupBy("agent_group").agg(F.count("*").alias("n"), F.count_if(_merged()).alias("merged"))
    path = files.fresh_folder(spark, "report")
    files.write_markdown(r, path, ["agent_group"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 2 = 0 AND s.url = p.url)", prs=False)
def resume_dedup(spark, sf):
    pages = tables.parquet(spark, sf, "pages")
    return tables.not_seen(pages, pages.where("page_id % 2 = 0"), "url").select("page_id")


_PROBED = {"page_id": "bigint", "url": "string", "html": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count(*) AS rows, count({c}) AS filled FROM pages" for c, t in _PROBED.items()), prs=False)
def schema_probe(spark, sf):
    return files.probe(tables.parquet(spark, sf, "pages").select(*_PROBED))


_COUNTED = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "pages": ["page_id", "url", "html"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS name, cast({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY {c} HAVING count(*) > 0.001 * (SELECT count(*) FROM {t})" for t, cs in _COUNTED.items() for c in cs if c not in ("o_totalprice", "o_orderdate", "page_id", "html", "url", "o_orderkey"))
       + " UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', '{c}', cast({c} AS VARCHAR), count(*) FROM {t} GROUP BY {c} HAVING count(*) > greatest(0.001 * (SELECT count(*) FROM {t}), 1)" for t, c in (("pages", "url"), ("pages", "html"), ("orders", "o_orderkey")))
       + " UNION ALL SELECT 'orders', 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM orders GROUP BY o_orderdate HAVING count(*) > greatest(0.001 * (SELECT count(*) FROM orders), 1)", prs=False)
def frequent_values(spark, sf):
    """Of every column of two tables the values that more than a thousandth of the rows, and more than one, have: all columns of a table in one plan."""
    out = None
    for t, columns in _COUNTED.items():
        f = D.frequent_values(tables.parquet(spark, sf, t).select(*columns), 0.001).where("n > 1 or name in ('o_orderstatus', 'o_orderpriority', 'o_custkey')").withColumn("tab", F.lit(t))
        out = f if out is None else out.unionByName(f)
    return out


# Selecting and labelling


def _any_sql(patterns: list[str], x: str = "t", flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_quoted(flags + p)})" for p in patterns) + ")"


#: By language, the extractor's keywords, patch patterns, false positives and features.
EXTRACTORS = {
    "cs": (C.CSHARP_KEYWORDS, C.CSHARP_PATCH_PATTERNS, C.CSHARP_FALSE_POSITIVES, C.CSHARP_EXTRACTED),
    "rs": (C.RUST_KEYWORDS, C.RUST_PATCH_PATTERNS, C.RUST_FALSE_POSITIVES, C.RUST_EXTRACTED),
}


def extracted(df: DataFrame, language: str) -> DataFrame:
    """The rows whose text t is about types by the catalogues of the language's own extractor."""
    keywords, patch, fps, features = EXTRACTORS[language]
    t = F.col("t")
    line_hit = F.exists(P.lines(t), lambda x: P.any_match(F.trim(x), patch))
    counts = list(P.catalogue_counts(t, features, False).values())
    return df.where(O.type_related(F.length("t"), P.any_match(t, fps, True), counts, P.any_match(t, keywords, True), line_hit, False))


def _extractor_query(language: str) -> None:
    keywords, patch, fps, features = EXTRACTORS[language]
    plain = [p.replace(r"(?!\?)", r"(?:[^?]|$)") for p in features.values()]  # the same texts match
    line_hit = f"len(list_filter(string_split(t, chr(10)), lambda x: {_any_sql(patch, 'trim(x)', '')})) > 0"

    def run(spark: SparkSession, sf: str):
        return extracted(_ascii_pages(spark, sf), language).select("page_id")

    run.__name__ = f"filter_type_prs_{language}_own"
    query(f"SELECT page_id FROM {_ASCII} WHERE length(t) > 0 AND NOT {_any_sql(fps)} AND ({_any_sql(plain, 't', '')} OR {_any_sql(keywords)} OR {line_hit})", prs=False)(run)


_extractor_query("cs")
_extractor_query("rs")


@query("SELECT doc_id FROM labels WHERE coalesce(quality = 1, false)", prs=False)
def filter_final_label(spark, sf):
    return tables.parquet(spark, sf, "labels").where(F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


@query("SELECT page_id, 'rust_file_detected' AS detection_method FROM pages WHERE ends_with(url, '.html')", prs=False)
def const_detection_method(spark, sf):
    return tables.parquet(spark, sf, "pages").where(F.col("url").endswith(".html")).select("page_id", F.lit("rust_file_detected").alias("detection_method"))


@query("SELECT doc_id, coalesce(nullif(left(text, 20), ''), 'none') AS head FROM documents", prs=False)
def safe_str_slice(spark, sf):
    return tables.parquet(spark, sf, "documents").select("doc_id", O.first_chars(F.col("text"), 20, "none").alias("head"))


@query("SELECT id, merged_at IS NOT NULL AS merged FROM p")
def is_merged(spark, sf):
    return prs(spark, sf).select("id", O.is_merged(F.col("merged_at")).alias("merged"))


@query("SELECT id, status FROM p")
def pr_status(spark, sf):
    return prs(spark, sf).select("id", O.status(F.col("merged_at"), F.col("state")).alias("status"))


@query("SELECT id, CASE WHEN changes <= 10 THEN 'Small' WHEN changes <= 50 THEN 'Medium' ELSE 'Large' END AS size FROM p")
def pr_size_3(spark, sf):
    return prs(spark, sf).select("id", O.size_bucket_3(F.col("changes")).alias("size"))


@query("SELECT id, size FROM p")
def pr_size_4(spark, sf):
    return prs(spark, sf).select("id", O.size_bucket(F.col("changes")).alias("size"))


@query("SELECT id, CASE WHEN additions > 0 AND deletions > 0 THEN 'Both' WHEN additions > 0 THEN 'Only Adds' WHEN deletions > 0 THEN 'Only Removes' END AS behaviour FROM p")
def any_behaviour(spark, sf):
    return prs(spark, sf).select("id", O.behaviour(F.col("additions"), F.col("deletions")).alias("behaviour"))


@query("SELECT id, CASE WHEN deletions > additions THEN 'Improves' WHEN deletions < additions THEN 'Reduces' ELSE 'Neutral' END AS resolution FROM p")
def resolution_class(spark, sf):
    return prs(spark, sf).select("id", O.resolution(F.col("additions"), F.col("deletions")).alias("resolution"))


_HOURS = "epoch_us(merged_at - created_at) / 3.6e9"


@query(f"SELECT id, round({_HOURS}, 6) AS hours FROM p WHERE {_HOURS} > 0 AND {_HOURS} < 10000")
def drop_invalid_durations(spark, sf):
    h = prs(spark, sf).select("id", O.hours_between(F.col("created_at"), F.col("merged_at")).alias("hours"))
    return h.where("hours > 0 and hours < 10000").withColumn("hours", F.round("hours", 6))


@query(f"SELECT id, round({_HOURS}, 6) AS hours FROM p")
def hours_between(spark, sf):
    return prs(spark, sf).select("id", F.round(O.hours_between(F.col("created_at"), F.col("merged_at")), 6).alias("hours"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'none' ELSE '2024-01-0' || (event_id % 9 + 1) END AS DATE) AS day FROM events", prs=False)
def parse_ts_coerce(spark, sf):
    """Texts that are no times become null."""
    text = F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.concat(F.lit("2024-01-0"), (F.col("event_id") % 9 + 1).cast("string")))
    return tables.parquet(spark, sf, "events").select("event_id", F.try_to_timestamp(text).cast("date").alias("day"))


# Joins and sets


@query("SELECT pr_id, line FROM d WHERE pr_id IN (SELECT id FROM pr WHERE agent_group = 'AI' AND state = 'open')")
def semi_join_details(spark, sf):
    o = tables.parquet(spark, sf, "orders").where(F.col("o_orderpriority").isin(AGENTS) & (F.col("o_orderstatus") == "O"))
    return details(spark, sf).join(o.select(F.col("o_orderkey").alias("pr_id")), "pr_id", "left_semi").select("pr_id", "line")


@query("SELECT doc_id, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)", prs=False)
def map_lookup(spark, sf):
    d = tables.parquet(spark, sf, "documents").select("doc_id")
    return O.left_with_zeros(d, tables.parquet(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey", prs=False)
def left_join_evidence(spark, sf):
    """Only a key's first row of evidence joins."""
    e = tables.parquet(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.parquet(spark, sf, "customer").select("c_custkey").join(e, "c_custkey", "left")


_POSITIVE = "CASE WHEN {} THEN 'type_related' ELSE 'not_type_related' END"


@query(f"SELECT c_custkey, {_POSITIVE.format('c_custkey IN (SELECT o_custkey FROM orders)')} AS prediction FROM customer", prs=False)
def membership_flag(spark, sf):
    seen = tables.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return tables.parquet(spark, sf, "customer").join(seen, "c_custkey", "left").select("c_custkey", _prediction(F.col("there")).alias("prediction"))


def _prediction(c: Column) -> Column:
    return F.when(c, "type_related").otherwise("not_type_related")


@query(f"SELECT id, {_POSITIVE.format('files > 3')} AS prediction FROM p WHERE agent_group = 'AI' AND repo_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def regex_population(spark, sf):
    repos = tables.parquet(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("repo_id"))
    return prs(spark, sf).where("agent_group = 'AI'").join(repos, "repo_id", "left_semi").select("id", _prediction(F.col("files") > 3).alias("prediction"))


@query(f"SELECT doc_id, {_POSITIVE.format('lower(flag) = ' + _quoted('true'))} AS prediction FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'True' WHEN toxic = 1 THEN NULL ELSE 'no' END AS flag FROM labels)", prs=False)
def llm_population(spark, sf):
    """Truth written as a boolean or as text, in any case."""
    flag = F.when(F.col("quality") == 1, "True").when(F.col("toxic") == 1, F.lit(None)).otherwise("no")
    return tables.parquet(spark, sf, "labels").select("doc_id", _prediction(F.lower(flag) == "true").alias("prediction"))


@query("SELECT DISTINCT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem", prs=False)
def set_difference(spark, sf):
    return tables.parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).subtract(tables.parquet(spark, sf, "lineitem").select("l_orderkey"))


@query("SELECT DISTINCT agent FROM p")
def distinct_values(spark, sf):
    return tables.parquet(spark, sf, "orders").select(F.col("o_orderpriority").alias("agent")).distinct()


@query("SELECT agent, avg_files FROM (SELECT agent, round(avg(files), 6) AS avg_files FROM p GROUP BY agent) ORDER BY avg_files DESC")
def sort_by(spark, sf):
    return prs(spark, sf).groupBy("agent").agg(F.round(F.avg("files"), 6).alias("avg_files")).orderBy(F.desc("avg_files"), "agent")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", prs=False)
def head_limit(spark, sf):
    return tables.parquet(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(10)


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 5", prs=False)
def first_k_per_group(spark, sf):
    return O.first_rows(tables.parquet(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], 5).select("conv_id", "turn")


# Summing up


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id", prs=False)
def patch_concat(spark, sf):
    rows = tables.parquet(spark, sf, "conversations").where("text is not null")
    return O.joined_text(rows.withColumn("at", F.col("text")), "conv_id", ["turn", "at"], F.col("text"), "\n")


# Kernels over lines: lines of documents that begin with E stand for added, with T for removed ones


def _documents(spark, sf):
    return tables.parquet(spark, sf, "documents")


@query(_LINES + "SELECT doc_id, array_to_string(list_filter(l, lambda x: starts_with(x, 'E') AND NOT starts_with(x, 'EEE')), chr(10)) AS added FROM t", prs=False)
def added_lines_keep_plus(spark, sf):
    return _documents(spark, sf).select("doc_id", P.marked_text(F.col("text"), "E", keep_mark=True).alias("added"))


@query(_LINES + "SELECT doc_id, array_to_string(list_filter(l, lambda x: starts_with(x, 'E')), chr(10)) AS added FROM t", prs=False)
def added_lines_loose(spark, sf):
    return _documents(spark, sf).select("doc_id", P.marked_text(F.col("text"), "E", keep_mark=True, headers=True).alias("added"))


def _line_counts(name: str, p: str, ignore_case: bool) -> None:
    of = f"list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '{{}}')), lambda x: len(regexp_extract_all(x, {_quoted(('(?i)' if ignore_case else '') + p)}))))"
    a, r = f"coalesce({of.format('<')}, 0)::BIGINT", f"coalesce({of.format(' ')}, 0)::BIGINT"

    def run(spark: SparkSession, sf: str):
        count = lambda mark: P.count_in_lines(P.marked(F.col("t"), mark, headers=True), p, ignore_case)
        n = _ascii_pages(spark, sf).select("page_id", count("<").alias("added"), count(" ").alias("removed"))
        return n.select("page_id", "added", "removed", (F.col("added") - F.col("removed")).alias("net"), (F.col("added") + F.col("removed")).alias("total"), F.least("added", "removed").alias("replaced"))

    run.__name__ = name
    query(f"SELECT *, added - removed AS net, added + removed AS total, least(added, removed) AS replaced FROM (SELECT page_id, {a} AS added, {r} AS removed FROM {_ASCII})", prs=False)(run)


_line_counts("tag_occurrences", "<[a-z]+", False)


@query("SELECT id, additions + deletions + files AS total, (additions > 0)::BIGINT + (deletions > 0)::BIGINT + (files > 0)::BIGINT AS features FROM p")
def feature_totals(spark, sf):
    total, unique = P.total_and_unique(["additions", "deletions", "files"])
    return prs(spark, sf).select("id", total.alias("total"), unique.alias("features"))


# Statistics

_U = """(SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM (SELECT (count(*) FILTER (WHERE g))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT g))::DOUBLE AS n2, sum(r) FILTER (WHERE g) AS r1, sum(c * c - 1)::DOUBLE AS ties FROM (
  SELECT agent_group = 'AI' AS g, rank() OVER (ORDER BY changes) + (count(*) OVER (PARTITION BY changes) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY changes) AS c FROM p)))"""


def _compared(spark, sf):
    return S.mann_whitney(prs(spark, sf).withColumn("one", F.lit(1)), "changes", F.col("agent_group") == "AI", ["one"])


@query(f"""SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, u1, round(least(1, {S.erfc_sql('z')}), 6) AS p, m.* FROM (SELECT *, {_Z} AS z FROM {_U}), (
  SELECT median(changes) FILTER (WHERE agent_group = 'AI') AS median1, median(changes) FILTER (WHERE agent_group <> 'AI') AS median2, round(avg(changes) FILTER (WHERE agent_group = 'AI'), 6) AS mean1, round(avg(changes) FILTER (WHERE agent_group <> 'AI'), 6) AS mean2 FROM p) m""")
def mann_whitney_u(spark, sf):
    """Both groups' numbers, medians and means, U and p."""
    of = prs(spark, sf).select((F.col("agent_group") == "AI").alias("ai"), "changes")
    q = D.quantiles(of, ["ai"], F.col("changes"), {"q": 0.5}).agg(F.max(F.when(F.col("ai"), F.col("q"))).alias("median1"), F.max(F.when(~F.col("ai"), F.col("q"))).alias("median2"))  # one row
    m = of.agg(*[F.round(F.avg(F.when(c, F.col("changes"))), 6).alias(f"mean{i}") for i, c in ((1, F.col("ai")), (2, ~F.col("ai")))])
    return _compared(spark, sf).select("n1", "n2", "u1", F.round("p", 6).alias("p")).crossJoin(q).crossJoin(m)


@query(f"SELECT round(2 * u1 / (n1 * n2) - 1, 6) AS r FROM {_U}")
def rank_biserial(spark, sf):
    return _compared(spark, sf).select(F.round("rank_biserial", 6).alias("r"))


@query("SELECT round((avg(changes) FILTER (WHERE agent_group = 'AI') - avg(changes) FILTER (WHERE agent_group <> 'AI')) / sqrt((var_samp(changes) FILTER (WHERE agent_group = 'AI') + var_samp(changes) FILTER (WHERE agent_group <> 'AI')) / 2), 6) AS d FROM p")
def cohens_d_simple(spark, sf):
    return prs(spark, sf).agg(F.round(S.cohens_d_simple(F.col("changes").cast("double"), F.col("agent_group") == "AI"), 6).alias("d"))


_CELLS = ", ".join(f"count(*) FILTER (WHERE agent_group {g} 'AI' AND status {s} 'merged') AS {n}" for n, g, s in (("a", "=", "="), ("b", "=", "<>"), ("c", "<>", "="), ("d", "<>", "<>")))
_CHI2 = "(a + b + c + d) * pow(greatest(abs(a * d - b * c)::DOUBLE - (a + b + c + d) / 2.0::DOUBLE, 0), 2) / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0)"
_REPO = f"(SELECT repo_id % 7 AS k, {_CELLS} FROM p GROUP BY 1)"


def _cells(spark, sf):
    return _tables_2x2(prs(spark, sf).withColumn("k", F.col("repo_id") % 7), "k"), [F.col(c) for c in "abcd"]


@query(f"SELECT k, round({_CHI2}, 6) AS chi2 FROM (SELECT k, greatest(a, 1) AS a, greatest(b, 1) AS b, greatest(c, 1) AS c, greatest(d, 1) AS d FROM {_REPO})")
def chi2_floored(spark, sf):
    t, cells = _cells(spark, sf)
    return t.select("k", F.round(S.chi2_yates(*[F.greatest(c, F.lit(1)) for c in cells]), 6).alias("chi2"))


@query(f"SELECT k, round(sqrt(({_CHI2}) / (a + b + c + d)), 6) AS v, CASE WHEN sqrt(({_CHI2}) / (a + b + c + d)) < 0.1 THEN 'negligible' WHEN sqrt(({_CHI2}) / (a + b + c + d)) < 0.3 THEN 'small' WHEN sqrt(({_CHI2}) / (a + b + c + d)) < 0.5 THEN 'medium' ELSE 'large' END AS size FROM {_REPO}")
def cramers_v(spark, sf):
    t, cells = _cells(spark, sf)
    v = S.cramers_v(S.chi2_yates(*cells), F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    return t.select("k", F.round(v, 6).alias("v"), S.size_of_v(v).alias("size"))


@query(f"SELECT k, CASE WHEN b = 0 OR c = 0 THEN 'inf'::DOUBLE ELSE round(a * d / (b * c)::DOUBLE, 6) END AS odds FROM {_REPO}")
def odds_ratio(spark, sf):
    t, cells = _cells(spark, sf)
    return t.select("k", F.round(S.odds_ratio(*cells), 6).alias("odds"))


@query(f"SELECT k, round((a::DOUBLE / (a + b)) / nullif(c::DOUBLE / (c + d), 0), 6) AS ratio FROM {_REPO}")
def acceptance_ratio(spark, sf):
    t, (a, b, c, d) = _cells(spark, sf)
    return t.select("k", F.round(F.try_divide(a / (a + b), c / (c + d)), 6).alias("ratio"))


@query(f"""SELECT repo_id, round(CASE WHEN least(a + b, c + d) < 50 OR least(a, b, c, d) < 5 THEN f ELSE {S.erfc_sql('sqrt(x2 / 2.0)')} END, 6) AS p FROM (SELECT repo_id, a, b, c, d, {_CHI2} AS x2, f FROM (
  SELECT repo_id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1, sum(q) FILTER (WHERE q <= o * 1.0000001)) AS f FROM (SELECT *, exp(base - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS q, exp(base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS o FROM (
    SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS x FROM (SELECT repo_id % 60 AS repo_id, {_CELLS} FROM p GROUP BY 1))) GROUP BY repo_id))""")
def proportion_test(spark, sf):
    t = _tables_2x2(prs(spark, sf).withColumn("repo_id", F.col("repo_id") % 60), "repo_id")
    return t.select("repo_id", F.round(S.proportion_p(*[F.col(c) for c in "abcd"]), 6).alias("p"))


@query("""SELECT event_id, CASE WHEN abs(x) < 0.2 THEN 'negligible' WHEN abs(x) < 0.5 THEN 'small' WHEN abs(x) < 0.8 THEN 'medium' ELSE 'large' END AS d, CASE WHEN x < 0.1 THEN 'negligible' WHEN x < 0.3 THEN 'small' WHEN x < 0.5 THEN 'medium' ELSE 'large' END AS v,
  CASE WHEN x / 10 < 0.001 THEN '***' WHEN x / 10 < 0.01 THEN '**' WHEN x / 10 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT event_id, value / 100 AS x FROM events WHERE value IS NOT NULL)""", prs=False)
def interpretations(spark, sf):
    """What sizes of effects and p-values are called."""
    x = F.col("value") / 100
    return tables.parquet(spark, sf, "events").where("value is not null").select("event_id", S.size_of_d(x).alias("d"), S.size_of_v(x).alias("v"), S.stars(x / 10).alias("stars"))


# Labelling


@query("SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens FROM documents", prs=False)
def token_estimate(spark, sf):
    return _documents(spark, sf).select("doc_id", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fn FROM labels", prs=False)
def confusion_matrix(spark, sf):
    return O.confusion(tables.parquet(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1).select("tp", "fp", "tn", "fn")
