"""Prompts, answers and their review as queries over assembled changes and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.operators import changes as O
from patchlight.operators import labelling as L
from patchlight.plans import corpus
from patchlight.plans.extraction import asks
from patchlight.plans.queries import query
from patchlight.sources import tables


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _clip(name: str, n: int, default: str) -> str:
    return f"coalesce(nullif(left({name}, {n}), ''), {_text(default)})"


def _prompt_sql(language: str) -> str:
    points, tone = L.RUBRICS[language]
    f = {k: _clip(k, *v) for k, v in L.CLASSIFIER_FIELDS.items()}
    tail = "\n\nIt is, if it concerns:\n" + "".join(f"- {p}\n" for p in points) + f"\nName your evidence. {tone} Answer as JSON: " + L.ANSWER_FORM
    return f"""{_text(f'Is this change about {language} types?' + chr(10) * 2 + 'Title: ')} || {f['title']} || {_text(chr(10) * 2 + 'Description: ')} || {f['body']} || {_text(chr(10) * 2 + 'Commit messages: ')} || {f['commit_messages']} || {_text(chr(10) * 2 + 'Patch: ')} || {f['patch_text']}
  || {_text(chr(10) * 2 + 'Lines: +')} || additions || '/-' || deletions || {_text(f'; {language} files: ')} || files || {_text(tail)}"""


_FIRST5 = "SELECT pr_id, string_agg(message, chr(10) ORDER BY message) AS commit_messages FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY message) AS n FROM m WHERE message IS NOT NULL) WHERE n <= 5 GROUP BY pr_id"
_SHOWN = corpus.COLLECTED_SQL + f""", s AS (SELECT pr_id, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(DISTINCT filename) AS files FROM x GROUP BY pr_id), m5 AS ({_FIRST5}
), sh AS (SELECT c.id, title, body, commit_messages, text AS patch_text, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(files, 0) AS files FROM c LEFT JOIN s ON s.pr_id = c.id LEFT JOIN m5 ON m5.pr_id = c.id LEFT JOIN t ON t.pr_id = c.id)
"""


def shown(spark: SparkSession, sf: str) -> DataFrame:
    """id and what a prompt shows of each change; of its messages the first five, in order of their texts."""
    c = corpus.changes(spark, sf).select("id", "title", "body")
    stats = O.commit_stats(corpus.details(spark, sf, True)).select(F.col("pr_id").alias("id"), "additions", "deletions", "files")
    messages = O.joined_text(corpus.commits(spark, sf).where("message is not null"), "pr_id", ["message"], F.col("message"), "\n", 5).select(F.col("pr_id").alias("id"), F.col("text").alias("commit_messages"))
    patches = corpus.collected(spark, sf).select(F.col("pr_id").alias("id"), F.col("text").alias("patch_text"))
    return O.left_with_zeros(c, stats, "id").join(messages, "id", "left").join(patches, "id", "left")


@asks(_SHOWN + f"SELECT id, {_prompt_sql('TypeScript')} AS prompt, length({_prompt_sql('TypeScript')}) // 4 AS tokens FROM sh")
def build_prompt(spark, sf):
    p = shown(spark, sf).select("id", L.classifier_prompt("TypeScript").alias("prompt"))
    return p.withColumn("tokens", F.floor(F.length("prompt") / 4))


@asks(_SHOWN + "SELECT id, " + ", ".join(f"{_prompt_sql(k)} AS {n}" for n, k in (("csharp", "C#"), ("rust", "Rust"))) + " FROM sh")
def build_prompt_rubrics(spark, sf):
    return shown(spark, sf).select("id", L.classifier_prompt("C#").alias("csharp"), L.classifier_prompt("Rust").alias("rust"))


# Answers, assembled from labels: some broken, some empty


_BOOL = "CASE WHEN {} THEN 'true' ELSE 'false' END"
_ANSWERS = f"""WITH a0 AS (SELECT doc_id, quality, toxic, doc_id % 10 AS k FROM labels), a AS (SELECT doc_id, CASE WHEN k = 3 THEN 'no json' WHEN k = 5 THEN '{{}}' ELSE '{{"is_type_related": ' || {_BOOL.format('quality = 1')} || ', "confidence": 0.' || k || ', "reasoning": "row ' || doc_id || '", "evidence": ["line ' || k || '", "title"], "detected_in": {{"title": ' || {_BOOL.format('k > 4')} || ', "body": ' || {_BOOL.format('k < 2')} || ', "patches": true}}}}' END AS answer,
  CASE WHEN k = 8 THEN '{{}}' ELSE '{{"validation_result": "' || CASE WHEN toxic = 1 THEN 'REJECTED' WHEN k = 1 THEN 'UNCERTAIN' ELSE 'APPROVED' END || '", "agreed_classification": ' || {_BOOL.format('toxic = 0')} || ', "validator_confidence": 0.' || (9 - k) || ', "validator_reasoning": "seen ' || k || '"}}' END AS review,
  CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'timeout' ELSE 'ok' END AS outcome FROM a0)
"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, answer, review, outcome."""
    k, yes = F.col("doc_id") % 10, lambda c: F.when(c, "true").otherwise("false")
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    answer = j('{"is_type_related": ', yes(F.col("quality") == 1), ', "confidence": 0.', k, ', "reasoning": "row ', F.col("doc_id"), '", "evidence": ["line ', k, '", "title"], "detected_in": {"title": ', yes(k > 4), ', "body": ', yes(k < 2), ', "patches": true}}')
    result = F.when(F.col("toxic") == 1, "REJECTED").when(k == 1, "UNCERTAIN").otherwise("APPROVED")
    review = j('{"validation_result": "', result, '", "agreed_classification": ', yes(F.col("toxic") == 0), ', "validator_confidence": 0.', 9 - k, ', "validator_reasoning": "seen ', k, '"}')
    return tables.parquet(spark, sf, "labels").select(
        "doc_id", F.when(k == 3, "no json").when(k == 5, "{}").otherwise(answer).alias("answer"), F.when(k == 8, "{}").otherwise(review).alias("review"),
        F.when(F.col("doc_id") % 17 == 0, "error").when(F.col("doc_id") % 13 == 0, "timeout").otherwise("ok").alias("outcome"))


def _field(t: str, path: str, kind: str, default: str) -> str:
    return f"coalesce(TRY_CAST(CASE WHEN json_valid({t}) THEN json_extract_string({t}, '$.{path}') END AS {kind}), {default})"


_PARSED = {
    "is_type_related": _field("answer", "is_type_related", "BOOLEAN", "false"), "confidence": _field("answer", "confidence", "DOUBLE", "0.0::DOUBLE"), "reasoning": _field("answer", "reasoning", "VARCHAR", "''"),
    "evidence": "coalesce(CASE WHEN json_valid(answer) THEN json_extract(answer, '$.evidence')::VARCHAR END, '[]')",
} | {f"detected_in_{p}": _field("answer", f"detected_in.{p}", "BOOLEAN", "false") for p in ("title", "body", "commits", "patches")}
_REVIEWED = {
    "validation_result": _field("review", "validation_result", "VARCHAR", "'UNCERTAIN'"), "validator_agreed": _field("review", "agreed_classification", "BOOLEAN", "false"),
    "validator_confidence": _field("review", "validator_confidence", "DOUBLE", "0.0::DOUBLE"), "validator_reasoning": _field("review", "validator_reasoning", "VARCHAR", "''"),
}


@query(_ANSWERS + "SELECT doc_id, " + ", ".join(f"{s} AS {n}" for n, s in (_PARSED | _REVIEWED).items()) + " FROM a", prs=False)
def parse_llm_json(spark, sf):
    both = L.parsed(F.col("answer")) | L.reviewed(F.col("review"))
    return answers(spark, sf).select("doc_id", *[c.alias(n) for n, c in both.items()])


_RECORDS = _ANSWERS + """, b AS (SELECT doc_id, outcome, CASE WHEN outcome = 'ok' THEN answer END AS answer, CASE WHEN outcome <> 'error' THEN review END AS review FROM a
), z AS (SELECT doc_id, outcome, """ + ", ".join(f"{s} AS {n if n.startswith('detected') else 'classifier_' + n}" for n, s in _PARSED.items()) + ", " + ", ".join(f"{s} AS {n}" for n, s in _REVIEWED.items()) + """ FROM b
), rec AS (SELECT * REPLACE (CASE outcome WHEN 'error' THEN 'Classifier API error' WHEN 'timeout' THEN 'Timeout after 30 seconds' ELSE classifier_reasoning END AS classifier_reasoning, CASE WHEN outcome = 'error' THEN 'ERROR' ELSE validation_result END AS validation_result,
  CASE WHEN outcome = 'error' THEN 'Classifier API error' ELSE validator_reasoning END AS validator_reasoning), outcome = 'error' AS error FROM z
), lr AS (SELECT * EXCLUDE (outcome), classifier_is_type_related AND validation_result = 'APPROVED' AS final_is_type_related FROM rec)
"""


@query(_RECORDS + "SELECT * FROM lr", prs=False)
def error_row(spark, sf):
    return L.records(answers(spark, sf))


@query(_RECORDS + """SELECT count(*) AS total, count(*) FILTER (WHERE final_is_type_related) AS type_related, count(*) FILTER (WHERE NOT final_is_type_related) AS not_type_related, count(*) FILTER (WHERE error) AS errors, round(100.0::DOUBLE * count(*) FILTER (WHERE final_is_type_related) / count(*), 6) AS percentage,
  round(avg(classifier_confidence), 6) AS avg_classifier_confidence, round(avg(validator_confidence), 6) AS avg_validator_confidence, """ + ", ".join(f"count(*) FILTER (WHERE validation_result = '{r}') AS validation_{r.lower()}" for r in ("APPROVED", "REJECTED", "UNCERTAIN", "ERROR")) + ", " + ", ".join(f"count(*) FILTER (WHERE detected_in_{p}) AS detected_in_{p}" for p in ("title", "body", "commits", "patches")) + " FROM lr", prs=False)
def llm_summary(spark, sf):
    return L.summary(L.records(answers(spark, sf)))


_REVIEW_PROMPT = [
    f"Review this answer to the question whether a change is about TypeScript types.\n\nTitle: ", "\n\nDescription: ", "\n\nTypeScript files: ", "; lines: +", "/-", "\n\nAnswer: ", ", confidence ", "\nReasoning: ", "\n\nDoes the reasoning fit the evidence, and the confidence? Answer as JSON: " + L.REVIEW_FORM,
]


@asks(_SHOWN + ", q AS (SELECT *, id % 3 = 0 AS yes, CASE WHEN id % 4 > 0 THEN 'row ' || id END AS reasoning FROM sh) SELECT id, " + " || ".join(_text(a) + (f" || {b}" if b else "") for a, b in zip(_REVIEW_PROMPT, [
    _clip("title", 200, "No title"), _clip("body", 500, "No description"), "files", "additions", "deletions", "CASE WHEN yes THEN 'TYPE-RELATED' ELSE 'NOT TYPE-RELATED' END", "'0.' || (id % 10) || '5'", _clip("reasoning", 500, "No reasoning provided"), ""])) + " AS prompt FROM q")
def validator_prompts(spark, sf):
    i = F.col("id")
    s = shown(spark, sf).withColumns({"is_type_related": i % 3 == 0, "confidence": (i % 10) / 10 + 0.05, "reasoning": F.when(i % 4 > 0, F.concat(F.lit("row "), i.cast("string")))})
    return s.select("id", L.validator_prompt("TypeScript").alias("prompt"))


@query("SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE r1 <> '' AND coalesce(lower(r1) = lower(r2), false)) / nullif(count(*) FILTER (WHERE r1 <> ''), 0), 6) AS agreement, count(*) FILTER (WHERE r1 <> '') AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN '' WHEN quality = 1 THEN 'Y' ELSE 'n' END AS r1, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN toxic = 0 THEN 'y' ELSE 'N' END AS r2 FROM labels)", prs=False)
def inter_rater(spark, sf):
    """Raters write y and n in either case, and leave some rows blank."""
    r1 = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("quality") == 1, "Y").otherwise("n")
    r2 = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("toxic") == 0, "y").otherwise("N")
    rows = tables.parquet(spark, sf, "labels").select(r1.alias("r1"), r2.alias("r2"))
    return rows.agg(F.round(L.agreement(F.col("r1"), F.col("r2")), 6).alias("agreement"), F.count_if(F.col("r1") != "").alias("n"))
