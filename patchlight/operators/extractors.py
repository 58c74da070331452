"""Extractors: which changes are about types, what they add, and by which sign they were found.

Tables: changes (id, title, body, agent, repo_id, ...), repositories (id, language), details (pr_id, filename, patch,
additions, deletions, changes; further columns may give their order), commits (pr_id, message).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.functions import patch as P
from patchlight.functions import patterns as C
from patchlight.operators import changes as O


@dataclass(frozen=True)
class Extractor:
    language: str  #: looked for in the repository's language, in any case
    suffixes: list[str]
    generated: list[str]
    keywords: list[str]  #: of titles and bodies, in either case
    patch_patterns: list[str]  #: of added lines without marks
    false_positives: list[str]  #: of titles and bodies, in either case
    features: dict[str, str]  #: counted in added lines
    keep_mark: bool = False  #: whether features see the marks of added lines
    whole_lines: bool = False  #: whether ^ in false positives stands at each line
    tokens: dict[str, str] = field(default_factory=dict)  #: counted in added and in removed lines
    any_lines: bool = False  #: whether lines that say any are counted, and needed


TYPESCRIPT = Extractor("TypeScript", [".ts", ".tsx"], [".d.ts"], C.TYPE_KEYWORDS, C.PATCH_PATTERNS, C.FALSE_POSITIVES, C.TS_EXTRACTED, keep_mark=True, any_lines=True)
CSHARP = Extractor("C#", [".cs"], [".Designer.cs", ".g.cs"], C.CSHARP_KEYWORDS, C.CSHARP_PATCH_PATTERNS, C.CSHARP_FALSE_POSITIVES, C.CSHARP_EXTRACTED)
RUST = Extractor("Rust", [".rs"], [".pb.rs", "build.rs"], C.RUST_KEYWORDS, C.RUST_PATCH_PATTERNS, C.RUST_FALSE_POSITIVES, C.RUST_EXTRACTED, whole_lines=True,
                 tokens={"unsafe": C.UNSAFE_PATTERN, "unwrap": C.UNWRAP_PATTERN, "as_cast": C.AS_CAST_PATTERN})


def of_language(changes: DataFrame, repositories: DataFrame, language: str) -> DataFrame:
    """The changes of repositories whose language contains the word."""
    repos = repositories.where(O.contains_word(F.col("language"), language)).select(F.col("id").alias("repo_id"))
    return changes.join(repos, "repo_id", "left_semi")


def told(patterns: list[str], lines: bool = False) -> Column:
    """Whether title or body holds one of the patterns."""
    return F.exists(P.each_text(F.col("title"), F.col("body")), lambda x: P.any_match(x["t"], patterns, True, lines, x["low"]))


def any_lines(patch: Column) -> dict[str, Column]:
    """Lines that add or remove an any, at most one a line, and typed lines that such a line replaces."""
    t = F.coalesce(patch, F.lit(""))
    return {
        "any_additions": P.occurrences(t, C.ANY_ADDED_LINE, lines=True), "any_removals": P.occurrences(t, C.ANY_REMOVED_LINE, lines=True),
        "any_replacements": P.occurrences(t, C.ANY_REPLACED_LINES, lines=True),
    }


def token_counts(added: Column, removed: Column, tokens: dict[str, str] = RUST.tokens) -> dict[str, Column]:
    return {f"{n}_{side}": P.occurrences(t, p) for n, p in tokens.items() for side, t in (("additions", added), ("removals", removed))}


def method(signs: dict[str, Column]) -> Column:
    """The names of the signs that hold, joined by bars."""
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in signs.items()])


def valid_details(details: DataFrame, ex: Extractor) -> DataFrame:
    return details.where(P.has_suffix(F.col("filename"), ex.suffixes, ex.generated))


def patch_counts(details: DataFrame, ex: Extractor, order: list[str] = ("filename",)) -> DataFrame:
    """For each pr_id with valid files: files (rows), patch_patterns, and the counts of features, tokens and lines over its patches, joined in the given order."""
    rows = F.sort_array(F.collect_list(F.when(F.col("patch").isNotNull(), F.struct(*order, F.col("patch")))))
    g = valid_details(details, ex).groupBy("pr_id").agg(F.count("*").alias("files"), F.array_join(F.transform(rows, lambda r: r["patch"]), "\n").alias("text"))
    return _counted(g, ex)


def _counted(g: DataFrame, ex: Extractor) -> DataFrame:
    """g with patch_patterns and counts in place of text, its patches joined by line feeds: so a line of one is a line of the text."""
    g = g.withColumn("plus", P.marked(F.col("text"), "+", every_break=True)).withColumn("patch_patterns", P.any_line_match(F.col("text"), ex.patch_patterns, F.col("plus")))
    g = g.withColumns({"added": F.array_join(F.col("plus") if ex.keep_mark else P.unmarked(F.col("plus")), "\n"), "removed": P.marked_text(F.col("text"), "-", every_break=True)})
    g = g.withColumn("features", P.counted(F.col("added"), ex.features, False))
    counts = {n: F.col("features")[n] for n in ex.features} | token_counts(F.col("added"), F.col("removed"), ex.tokens)
    if ex.any_lines:
        counts |= any_lines(F.col("text"))
    others = [c for c in g.columns if c not in ("text", "plus", "added", "removed", "features")]
    return g.select(*others, *[c.alias(n) for n, c in counts.items()])


def candidates(changes: DataFrame, repositories: DataFrame, ex: Extractor) -> DataFrame:
    """The changes of an extractor's language with type_keywords and false_positive. To be stored where several steps read it: titles and bodies are looked through once, and only those of the language."""
    return of_language(changes, repositories, ex.language).withColumns({"false_positive": told(ex.false_positives, ex.whole_lines), "type_keywords": told(ex.keywords)})


def extract(changes: DataFrame, repositories: DataFrame, details: DataFrame, ex: Extractor, order: list[str] = ("filename",)) -> DataFrame:
    """The changes about types of an extractor's language, with files, counts, total_features and detection_method.

    A change is about types if it has valid files, neither title nor body is a false positive, and it shows a sign: for
    C# and Rust a feature, an unsafe token, a keyword in title or body or a pattern in an added line; for TypeScript a
    line that says any and, besides, a keyword or a pattern. Null titles, bodies and patches show none. Details are
    grouped only for changes that may still be chosen.
    """
    return extract_from(candidates(changes, repositories, ex), details, ex, order)


def extract_from(candidates: DataFrame, details: DataFrame, ex: Extractor, order: list[str] = ("filename",)) -> DataFrame:
    """extract(), of candidates()."""
    c = candidates.where(~F.col("false_positive")).drop("false_positive")
    d = details.join(c.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    return _chosen(c.join(patch_counts(d, ex, order).withColumnRenamed("pr_id", "id"), "id"), ex)


def extract_with_details(candidates: DataFrame, details: DataFrame, ex: Extractor, order: list[str], *more: Column) -> DataFrame:
    """extract_from(), with what all details of each change sum up to: additions, deletions, changes, files_changed (different names), patch_text (as collected_patches(); null without any) and more aggregates.

    Details are read and grouped once. A candidate that stands twice is two changes.
    """
    c = candidates.where(~F.col("false_positive")).drop("false_positive")
    d = details.join(c.select(F.col("id").alias("pr_id")), "pr_id", "left_semi").withColumn("valid", P.has_suffix(F.col("filename"), ex.suffixes, ex.generated))
    rows = F.sort_array(F.collect_list(F.when(F.col("patch").isNotNull(), F.struct(*O.collectable(order), F.col("valid")))))
    g = d.groupBy(F.col("pr_id").alias("id")).agg(
        F.count_if("valid").alias("files"), rows.alias("rows"), *[F.sum(n).alias(n) for n in ("additions", "deletions", "changes")], F.size(F.collect_set("filename")).cast("bigint").alias("files_changed"), *more)
    g = g.where("files > 0").withColumn("text", F.array_join(F.transform(F.filter("rows", lambda r: r["valid"]), lambda r: r["patch"]), "\n"))
    g = _counted(g, ex).withColumn("patch_text", F.nullif(O.under_headers(F.filter("rows", lambda r: ~O.is_blank(r["patch"]))), F.lit(""))).drop("rows")
    return _chosen(c.join(g, "id"), ex)


def _chosen(j: DataFrame, ex: Extractor) -> DataFrame:
    """Of candidates with counts those about types, with total_features and detection_method."""
    j = j.withColumn("total_features", P.total_and_unique(list(ex.features))[0])
    hit = F.col("type_keywords") | F.col("patch_patterns")
    if ex.any_lines:
        signs = {n: F.col(c) > 0 for n, c in (("any_add", "any_additions"), ("any_rem", "any_removals"), ("any_rep", "any_replacements"))}
        chosen = ((F.col("any_additions") > 0) | (F.col("any_removals") > 0) | (F.col("any_replacements") > 0)) & hit
    else:
        signs = {"features": F.col("total_features") > 0}
        if "unsafe" in ex.tokens:
            signs["unsafe"] = (F.col("unsafe_additions") > 0) | (F.col("unsafe_removals") > 0)
        chosen = hit
        for s in signs.values():
            chosen = chosen | s
    signs |= {"type_keywords": F.col("type_keywords"), "patch_patterns": F.col("patch_patterns")}
    return j.where(chosen).withColumn("detection_method", method(signs))


def scores(changes: DataFrame, details: DataFrame, commits: DataFrame | None, ex: Extractor = TYPESCRIPT) -> DataFrame:
    """changes with files, text_score (title and body), commit_score (the best message; 0 without commits), patch_score (the best patch), any_* (sums over patches) and total_score."""
    c = changes.withColumn("text_score", F.coalesce(P.score_text(F.col("title"), C.SCORED_KEYWORDS), F.lit(0)) + F.coalesce(P.score_text(F.col("body"), C.SCORED_KEYWORDS), F.lit(0)))
    of = patch_scores(details, ex).withColumnRenamed("pr_id", "id")
    c = O.left_with_zeros(c, of, "id")
    if commits is not None:
        c = O.left_with_zeros(c, commit_scores(commits).withColumnRenamed("pr_id", "id"), "id")
    else:
        c = c.withColumn("commit_score", F.lit(0).cast("bigint"))
    return c.withColumn("total_score", F.col("text_score") + F.col("commit_score") + F.col("patch_score") + C.PER_FILE * F.col("files"))


def commit_scores(commits: DataFrame) -> DataFrame:
    return commits.groupBy("pr_id").agg(F.max(F.coalesce(P.score_text(F.col("message"), C.SCORED_KEYWORDS), F.lit(0))).alias("commit_score"))


def patch_scores(details: DataFrame, ex: Extractor = TYPESCRIPT) -> DataFrame:
    """For each pr_id with valid files: files, patch_score and any_*: scores and counts are taken patch by patch."""
    d = valid_details(details, ex).select("pr_id", P.score_patch(F.col("patch"), C.SCORED_LINES).alias("score"), *[x.alias(n) for n, x in any_lines(F.col("patch")).items()])
    return d.groupBy("pr_id").agg(F.count("*").alias("files"), F.max("score").alias("patch_score"), *[F.sum(n).alias(n) for n in ("any_additions", "any_removals", "any_replacements")])


def extract_scored(changes: DataFrame, details: DataFrame, commits: DataFrame | None, ex: Extractor = TYPESCRIPT) -> DataFrame:
    """The changes whose scores suffice: with files, text or patch, and total; and detection_method."""
    s = scores(changes.where(~told(ex.false_positives, ex.whole_lines)), details, commits, ex)
    text, lines = F.col("text_score") >= C.LEAST_TEXT, F.col("patch_score") >= C.LEAST_PATCH
    return s.where((F.col("files") > 0) & (text | lines) & (F.col("total_score") >= C.LEAST_TOTAL)).withColumn("detection_method", method({"text": text, "patch": lines}))
