"""Labelling of changes by a pair of reviewers: prompts, the answers' shapes, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.operators import changes as O

# How many characters of each field a prompt shows, and what stands for a missing one.
CLASSIFIER_FIELDS = {"title": (500, "No title"), "body": (1000, "No description"), "commit_messages": (800, "No commit messages"), "patch_text": (2000, "No patches available")}
VALIDATOR_FIELDS = {"title": (200, "No title"), "body": (500, "No description"), "reasoning": (500, "No reasoning provided")}
# The answers' fields.
ANSWER = "is_type_related boolean, confidence double, reasoning string, evidence array<string>, detected_in struct<title: boolean, body: boolean, commits: boolean, patches: boolean>"
REVIEW = "validation_result string, agreed_classification boolean, validator_confidence double, validator_reasoning string, suggested_changes string"
ANSWER_FORM = '{"is_type_related": true/false, "confidence": 0.0-1.0, "reasoning": "...", "evidence": ["..."], "detected_in": {"title": true/false, "body": true/false, "commits": true/false, "patches": true/false}}'
REVIEW_FORM = '{"validation_result": "APPROVED" / "REJECTED" / "UNCERTAIN", "agreed_classification": true/false, "validator_confidence": 0.0-1.0, "validator_reasoning": "...", "suggested_changes": "..."}'
#: What makes a change one about types, and how strictly it is read, by language.
RUBRICS = {
    "TypeScript": (["annotations added, changed or taken away", "type errors and compiler settings", "any replaced by a type", "types, interfaces and generics reshaped", "assertions and guards"], "Say yes only on clear evidence."),
    "C#": (["annotations and declarations", "nullable and non-nullable references, null-forgiving marks", "records, tuples, init-only and required members", "patterns, casts and constraints", "implemented interfaces"], "Be lenient: little evidence is enough for yes."),
    "Rust": (["signatures, lifetimes, generics and bounds", "unsafe blocks, functions, traits and impls", "traits, aliases and smart pointers", "unwrap and expect for handled results, or back", "casts made safer, Send and Sync"], "Say yes only when the evidence is clear."),
}


def clipped(name: str, n: int, default: str) -> Column:
    return O.first_chars(F.col(name), n, default)


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("string")


def classifier_prompt(language: str) -> Column:
    """The prompt for a change: title, body, commit_messages, patch_text (clipped), additions, deletions, files."""
    points, tone = RUBRICS[language]
    f = {k: clipped(k, *v) for k, v in CLASSIFIER_FIELDS.items()}
    return _said(
        f"Is this change about {language} types?\n\nTitle: ", f["title"], "\n\nDescription: ", f["body"], "\n\nCommit messages: ", f["commit_messages"], "\n\nPatch: ", f["patch_text"],
        "\n\nLines: +", _number("additions"), "/-", _number("deletions"), f"; {language} files: ", _number("files"), "\n\nIt is, if it concerns:\n" + "".join(f"- {p}\n" for p in points) + f"\nName your evidence. {tone} Answer as JSON: " + ANSWER_FORM)


def validator_prompt(language: str) -> Column:
    """The prompt that has the first answer reviewed: title, body, reasoning (clipped), files, additions, deletions, is_type_related, confidence."""
    f = {k: clipped(k, *v) for k, v in VALIDATOR_FIELDS.items()}
    return _said(
        f"Review this answer to the question whether a change is about {language} types.\n\nTitle: ", f["title"], "\n\nDescription: ", f["body"], f"\n\n{language} files: ", _number("files"), "; lines: +", _number("additions"), "/-", _number("deletions"),
        "\n\nAnswer: ", F.when(F.col("is_type_related"), "TYPE-RELATED").otherwise("NOT TYPE-RELATED"), ", confidence ", F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), "\nReasoning: ", f["reasoning"],
        "\n\nDoes the reasoning fit the evidence, and the confidence? Answer as JSON: " + REVIEW_FORM)


def parsed(answer: Column) -> dict[str, Column]:
    """The fields of a first answer; false, 0, '' and none for those that it lacks, and for all of a broken one."""
    a, no = F.from_json(answer, ANSWER), F.lit(False)
    return {
        "is_type_related": F.coalesce(a["is_type_related"], no), "confidence": F.coalesce(a["confidence"], F.lit(0.0)), "reasoning": F.coalesce(a["reasoning"], F.lit("")),
        "evidence": F.to_json(F.coalesce(a["evidence"], F.array().cast("array<string>"))),
    } | {f"detected_in_{p}": F.coalesce(a["detected_in"][p], no) for p in ("title", "body", "commits", "patches")}


def reviewed(review: Column) -> dict[str, Column]:
    """The fields of a review, likewise; without a result it is UNCERTAIN."""
    v = F.from_json(review, REVIEW)
    return {
        "validation_result": F.coalesce(v["validation_result"], F.lit("UNCERTAIN")), "validator_agreed": F.coalesce(v["agreed_classification"], F.lit(False)),
        "validator_confidence": F.coalesce(v["validator_confidence"], F.lit(0.0)), "validator_reasoning": F.coalesce(v["validator_reasoning"], F.lit("")),
    }


def records(df: DataFrame, seconds: float = 30) -> DataFrame:
    """df (answer, review, outcome: ok, timeout or error) with the record of each change in place of these.

    An error of the first reviewer gives an ERROR record that is false throughout. A timeout is no error: the first answer
    is then no, with that reason, and the review counts. final_is_type_related: yes, and approved.
    """
    failed, late = F.coalesce(F.col("outcome") == "error", F.lit(False)), F.coalesce(F.col("outcome") == "timeout", F.lit(False))
    first, second = parsed(F.when(~failed & ~late, F.col("answer"))), reviewed(F.when(~failed, F.col("review")))
    message = F.lit("Classifier API error")
    first["reasoning"] = F.when(failed, message).when(late, F.lit(f"Timeout after {seconds:g} seconds")).otherwise(first["reasoning"])
    second["validation_result"] = F.when(failed, "ERROR").otherwise(second["validation_result"])
    second["validator_reasoning"] = F.when(failed, message).otherwise(second["validator_reasoning"])
    out = df.select(*[F.col(c) for c in df.columns if c not in ("answer", "review", "outcome")], *[c.alias(f"classifier_{n}" if not n.startswith("detected") else n) for n, c in first.items()], *[c.alias(n) for n, c in second.items()], failed.alias("error"))
    return out.withColumn("final_is_type_related", F.col("classifier_is_type_related") & (F.col("validation_result") == "APPROVED"))


def summary(df: DataFrame) -> DataFrame:
    """One row: how many records there are, by label, review and place of evidence, and mean confidences."""
    n, yes = F.count("*"), F.count_if("final_is_type_related")
    return df.agg(
        n.alias("total"), yes.alias("type_related"), (n - yes).alias("not_type_related"), F.count_if("error").alias("errors"), F.round(F.coalesce(F.try_divide(100.0 * yes, n.cast("double")), F.lit(0.0)), 6).alias("percentage"),
        F.round(F.avg("classifier_confidence"), 6).alias("avg_classifier_confidence"), F.round(F.avg("validator_confidence"), 6).alias("avg_validator_confidence"),
        *[F.count_if(F.col("validation_result") == r).alias(f"validation_{r.lower()}") for r in ("APPROVED", "REJECTED", "UNCERTAIN", "ERROR")], *[F.count_if(f"detected_in_{p}").alias(f"detected_in_{p}") for p in ("title", "body", "commits", "patches")])


def agreement(rater1: Column, rater2: Column) -> Column:
    """An aggregate: of the rows that the first rater marked, the percentage that the second marked alike, cases aside; null if there are none."""
    marked = F.coalesce(rater1, F.lit("")) != ""
    return F.try_divide(100.0 * F.count_if(marked & F.coalesce(F.lower(rater1) == F.lower(rater2), F.lit(False))), F.count_if(marked).cast("double"))
