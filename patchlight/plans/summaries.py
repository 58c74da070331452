"""What the extractors export of the changes about types, its summaries, and what reviewers say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.operators import changes as O
from patchlight.operators import extractors as E
from patchlight.operators import labelling as L
from patchlight.plans import corpus, labelling
from patchlight.plans.extraction import EXTRACTORS, _of_frame, _signs_sql, asks, candidates, extracting
from patchlight.plans.queries import query
from patchlight.sources import files, tables

_TOLD = ["id", "repo_id", "agent", "agent_group", "title", "state", "created_at"]


def _counts(ex: E.Extractor) -> list[str]:
    counts, more, _, _ = extracting(ex)
    return [*counts, "total_features", *more]


def found(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The changes about types of an extractor's language: what is known of each, all its counts and detection_method. What isn't asked for isn't counted."""
    ex = EXTRACTORS[name]
    of = E.extract_from(candidates(spark, sf, name, _TOLD), corpus.details(spark, sf), ex, corpus.ORDER)
    return of.select(*_TOLD, *_counts(ex), F.col("files").alias("files_in_language"), "detection_method")


def export(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """found(), and of each change its details' sums, files_changed, patch_text, merged: line items are read and grouped once."""
    ex = EXTRACTORS[name]
    out = E.extract_with_details(candidates(spark, sf, name, _TOLD), corpus.details(spark, sf), ex, corpus.ORDER, F.min("shipped_at").alias("shipped"))
    merged = F.coalesce(F.col("shipped") > F.col("created_at"), F.lit(False)).alias("merged")
    return out.select(*_TOLD, *_counts(ex), F.col("files").alias("files_in_language"), "detection_method", "additions", "deletions", "changes", "files_changed", "patch_text", merged)


def export_sql(name: str) -> str:
    """CTE tp, as export()."""
    counts, more, signs, chosen = extracting(EXTRACTORS[name])
    made = ", ".join(f'{c} AS "{n}"' for n, c in counts.items()) + f", ({' + '.join(counts.values())})::BIGINT AS total_features" + "".join(f', {c} AS "{n}"' for n, c in more.items())
    return _of_frame(EXTRACTORS[name]) + f""", k AS (SELECT pr_id, files AS files_in_language, hit, {made} FROM a
), t0 AS (SELECT {', '.join(f'c1.{c}' for c in _TOLD)}, k.* EXCLUDE (pr_id, hit), {_signs_sql(signs)} AS detection_method FROM c1 JOIN k ON k.pr_id = c1.id WHERE {chosen}
), st AS (SELECT pr_id, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(changes)::BIGINT AS changes, count(DISTINCT filename) AS files_changed, min(shipped_at) AS shipped FROM x WHERE pr_id IN (SELECT id FROM t0) GROUP BY pr_id
){corpus.COLLECTED_SQL}, tp AS (SELECT t0.*, st.* EXCLUDE (pr_id, shipped), t.text AS patch_text, coalesce(shipped > created_at, false) AS merged FROM t0 LEFT JOIN st ON st.pr_id = id LEFT JOIN t ON t.pr_id = id)
"""


for _name in EXTRACTORS:
    def _run(spark: SparkSession, sf: str, name: str = _name) -> DataFrame:
        return export(spark, sf, name)

    _run.__name__ = f"export_type_prs_{_name}"
    asks(export_sql(_name) + "SELECT * FROM tp")(_run)


# Summaries of the export


def _summed(name: str, of: str, key: str, sql: str, make) -> None:
    """A query that sums what the export of a language tells of each change up by a key; rows without one are left out."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return found(spark, sf, of).where(F.col(key).isNotNull()).groupBy(key).agg(*make())

    run.__name__ = name
    asks(export_sql(of) + f"SELECT {key}, {sql} FROM tp WHERE {key} IS NOT NULL GROUP BY {key}")(run)


_TS, _CS, _ANY = list(EXTRACTORS["ts"].features), list(EXTRACTORS["cs"].features), ("any_additions", "any_removals", "any_replacements")
for _suffix, _key in (("agent", "agent"), ("group", "agent_group")):
    _summed(f"feature_density_by_{_suffix}", "ts", _key, ", ".join(f'round(sum("{f}")::DOUBLE / count(*), 4) AS "{f}"' for f in _TS), lambda: [F.round(F.sum(f).cast("double") / F.count("*"), 4).alias(f) for f in _TS])
    _summed(f"any_stats_by_{_suffix}", "ts", _key, ", ".join(f"sum({c})::BIGINT AS {c}" for c in _ANY), lambda: [F.sum(c).alias(c) for c in _ANY])
    _summed(f"feature_stats_by_{_suffix}", "cs", _key, 'count(*) AS pr_count, sum(total_features)::BIGINT AS total, round(avg(total_features), 4) AS mean, ' + ", ".join(f'sum("{f}")::BIGINT AS "{f}"' for f in _CS),
            lambda: [F.count("*").alias("pr_count"), F.sum("total_features").alias("total"), F.round(F.avg("total_features"), 4).alias("mean"), *[F.sum(f).alias(f) for f in _CS]])


@asks(export_sql("ts") + "SELECT agent AS name, sum(any_additions)::BIGINT AS additions, sum(any_removals)::BIGINT AS removals FROM tp WHERE agent_group = 'AI' GROUP BY agent UNION ALL SELECT 'Human', sum(any_additions)::BIGINT, sum(any_removals)::BIGINT FROM tp WHERE agent_group = 'Human'")
def agent_breakdown(spark, sf):
    """Lines that add and remove an any by agent, and a row for all people."""
    sums, tp = [F.sum("any_additions").alias("additions"), F.sum("any_removals").alias("removals")], found(spark, sf, "ts").select("agent", "agent_group", "any_additions", "any_removals")
    tp = files.stored(tp, "any-lines")
    return tp.where("agent_group = 'AI'").groupBy(F.col("agent").alias("name")).agg(*sums).unionByName(tp.where("agent_group = 'Human'").agg(*sums).select(F.lit("Human").alias("name"), "additions", "removals"))


_PARTS = {"by_agent": "coalesce(agent, 'none')", "by_group": "agent_group", "by_method": "detection_method"}


@asks(export_sql("ts") + "SELECT 'total' AS section, 'prs' AS name, count(*)::DOUBLE AS value FROM tp UNION ALL SELECT 'total', 'any_additions', sum(any_additions)::DOUBLE FROM tp UNION ALL SELECT 'total', 'with_any_additions', (count(*) FILTER (WHERE any_additions > 0))::DOUBLE FROM tp UNION ALL "
      + " UNION ALL ".join(f"SELECT '{s}', {c}, count(*)::DOUBLE FROM tp GROUP BY 2" for s, c in _PARTS.items())
      + " UNION ALL SELECT 'density_by_agent', coalesce(agent, 'none') || '.' || f, round(sum(n)::DOUBLE / count(*), 4) FROM (SELECT agent, unnest([" + ", ".join(f"'{f}'" for f in _TS) + "]) AS f, unnest([" + ", ".join(f'"{f}"' for f in _TS) + "]) AS n FROM tp) GROUP BY 2")
def sink_json_summary(spark, sf):
    """A nested summary (totals, counts by agent, group and method, densities of features by agent) written beside the export as one line of JSON, and read back as rows."""
    tp = files.stored(found(spark, sf, "ts").select("agent", "agent_group", "detection_method", "any_additions", *_TS), "summed-up")
    agent = F.coalesce("agent", F.lit("none"))
    numbers = lambda by: tp.groupBy(by.alias("k")).agg(F.count("*").cast("double").alias("v"))
    dense = tp.groupBy(agent.alias("k")).agg(F.map_from_arrays(F.array(*map(F.lit, _TS)), F.array(*[F.round(F.sum(f).cast("double") / F.count("*"), 4) for f in _TS])).alias("v"))
    # a row for each agent, group and method
    whole = files.nested({
        "total": tp.agg(F.count("*").cast("double").alias("prs"), F.sum("any_additions").cast("double").alias("any_additions"), F.count_if(F.col("any_additions") > 0).cast("double").alias("with_any_additions")),
        "by_agent": numbers(agent), "by_group": numbers(F.col("agent_group")), "by_method": numbers(F.col("detection_method")), "density_by_agent": dense,
    })
    path = files.fresh_folder(spark, "nested-summary")
    files.write_json(whole, path)
    back = spark.read.schema("total map<string, double>, by_agent map<string, double>, by_group map<string, double>, by_method map<string, double>, density_by_agent map<string, map<string, double>>").json(path)
    flat = lambda s: back.select(F.lit(s).alias("section"), F.explode(s).alias("name", "value"))
    deep = back.select(F.explode("density_by_agent").alias("k", "m")).select("k", F.explode("m").alias("f", "value")).select(F.lit("density_by_agent").alias("section"), F.concat_ws(".", "k", "f").alias("name"), "value")
    return flat("total").unionByName(flat("by_agent")).unionByName(flat("by_group")).unionByName(flat("by_method")).unionByName(deep)


# Flags of patches, and reviews of changes


_FLAGS = ["has_tests", "has_todo", "has_eslint_disable", "has_ts_ignore", "has_any_type"]
_FLAG_SQL = {
    "has_tests": "contains(lower(p), 'test') OR contains(lower(p), 'spec')", "has_todo": "contains(lower(p), 'todo') OR contains(lower(p), 'fixme')", "has_eslint_disable": "contains(lower(p), 'eslint-disable')",
    "has_ts_ignore": "contains(p, '@ts-ignore') OR contains(p, '@ts-nocheck')", "has_any_type": "contains(p, ': any') OR contains(p, '<any>')",
}
#: CTE fl: the changes with patches, their flags, status, and a review where one was made (of the number's hundreds).
_FLAGGED_SQL = corpus.SQL + corpus.COLLECTED_SQL + f""", s0 AS (SELECT pr_id, min(shipped_at) AS shipped FROM x GROUP BY pr_id
), {labelling._RECORDS.removeprefix('WITH ')}, fl AS (SELECT id, CASE WHEN shipped > created_at THEN 'merged' ELSE state END AS status, {', '.join(f'({c}) AS {n}' for n, c in _FLAG_SQL.items())}, validator_agreed, validator_confidence
  FROM (SELECT c.id, c.state, c.created_at, s0.shipped, coalesce(t.text, '') AS p FROM c LEFT JOIN s0 ON s0.pr_id = c.id LEFT JOIN t ON t.pr_id = c.id) LEFT JOIN lr ON lr.doc_id = id)
"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """id, status, flags of the patches, validator_agreed and validator_confidence (null without a review)."""
    c = corpus.changes(spark, sf)
    shipped = corpus.details(spark, sf).groupBy(F.col("pr_id").alias("id")).agg(F.min("shipped_at").alias("shipped"))
    text = corpus.collected(spark, sf).select(F.col("pr_id").alias("id"), *[x.alias(n) for n, x in O.quality_flags(F.col("text")).items()])
    reviews = L.records(labelling.answers(spark, sf)).select(F.col("doc_id").alias("id"), "validator_agreed", "validator_confidence")
    j = c.join(shipped, "id", "left").join(text, "id", "left").join(reviews, "id", "left")
    status = F.when(F.col("shipped") > F.col("created_at"), "merged").otherwise(F.col("state"))
    return j.select("id", status.alias("status"), *[F.coalesce(f, F.lit(False)).alias(f) for f in _FLAGS], "validator_agreed", "validator_confidence")


@query(_FLAGGED_SQL + "SELECT " + ", ".join(f"round(100.0::DOUBLE * avg({f}::INT), 6) AS {f}" for f in _FLAGS) + " FROM fl", prs=False)
def indicator_rates(spark, sf):
    return flagged(spark, sf).agg(*[F.round(100 * F.avg(F.col(f).cast("double")), 6).alias(f) for f in _FLAGS])


_FACTORS = ["has_tests", "has_ts_ignore", "validator_agreed"]


@query(_FLAGGED_SQL + f"SELECT factor, held, round(100.0::DOUBLE * avg((status = 'merged')::INT), 6) AS rate, count(*) AS n FROM (SELECT status, unnest({_FACTORS}) AS factor, unnest([{', '.join(_FACTORS)}]) AS held FROM fl) WHERE held IS NOT NULL GROUP BY factor, held", prs=False)
def acceptance_by_factor(spark, sf):
    """The rate of merged changes with and without tests, silenced checks and the reviewer's agreement."""
    held = flagged(spark, sf).unpivot("status", _FACTORS, "factor", "held").where("held is not null")
    return held.groupBy("factor", "held").agg(F.round(100 * F.avg((F.col("status") == "merged").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query(_FLAGGED_SQL + "SELECT status, round(100.0::DOUBLE * avg(validator_agreed::INT), 6) AS agreement, count(validator_agreed) AS n FROM fl GROUP BY status", prs=False)
def agreement_by_status(spark, sf):
    return flagged(spark, sf).groupBy("status").agg(F.round(100 * F.avg(F.col("validator_agreed").cast("double")), 6).alias("agreement"), F.count("validator_agreed").alias("n"))


@query(_FLAGGED_SQL + """SELECT id, round((CASE WHEN has_tests THEN 2 ELSE 0 END - CASE WHEN has_todo THEN 1 ELSE 0 END - CASE WHEN has_eslint_disable THEN 2 ELSE 0 END - CASE WHEN has_ts_ignore THEN 3 ELSE 0 END
  - CASE WHEN has_any_type THEN 2 ELSE 0 END + CASE WHEN validator_agreed THEN 1 ELSE 0 END)::DOUBLE + coalesce(validator_confidence, 0), 6) AS score FROM fl""", prs=False)
def quality_score(spark, sf):
    return flagged(spark, sf).select("id", F.round(O.quality_score(*[F.col(f) for f in _FLAGS], F.col("validator_agreed"), F.col("validator_confidence")), 6).alias("score"))


@query(labelling._RECORDS + "SELECT d.doc_id, coalesce(final_is_type_related, false) AS final, coalesce(validation_result, 'NONE') AS validation FROM documents d LEFT JOIN lr USING (doc_id)", prs=False)
def final_decision(spark, sf):
    """Of every document whether both agents say yes: the second by its approval; NONE where no label was asked for."""
    of = L.records(labelling.answers(spark, sf)).select("doc_id", "final_is_type_related", "validation_result")
    j = tables.parquet(spark, sf, "documents").select("doc_id").join(of, "doc_id", "left")
    return j.select("doc_id", F.coalesce("final_is_type_related", F.lit(False)).alias("final"), F.coalesce("validation_result", F.lit("NONE")).alias("validation"))
