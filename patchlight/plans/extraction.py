"""Extractors, kernels over patches and reports as queries over the assembled changes (see corpus), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlight.functions import patch as P
from patchlight.functions import patterns as C
from patchlight.functions import statistics as S
from patchlight.operators import changes as O
from patchlight.operators import extractors as E
from patchlight.operators import report
from patchlight.plans import corpus
from patchlight.plans.queries import _Z, query
from patchlight.sources import files

EXTRACTORS = {"ts": E.TYPESCRIPT, "cs": E.CSHARP, "rs": E.RUST}


def asks(sql: str):
    """A query over the assembled changes: sql follows the CTEs of corpus.SQL."""
    return query(corpus.SQL + sql, prs=False)


# Pieces of SQL


def _q(p: str, ignore_case: bool = False, lines: bool = False) -> str:
    flags = "i" * ignore_case + "m" * lines
    return "'" + ((f"(?{flags})" if flags else "") + p).replace("'", "''") + "'"


def _n(p: str, x: str, ignore_case: bool = False, lines: bool = False) -> str:
    """How often a pattern is found. What SQL's patterns lack is put otherwise: no '?' after one as a difference, a word that returns as a test of what follows it."""
    if "(?!\\?)" in p:
        return f"({_n(p.replace('(?!' + chr(92) + '?)', ''), x, ignore_case)} - {_n(p.replace('(?!' + chr(92) + '?)', chr(92) + '?'), x, ignore_case)})"
    if "\\1" in p:
        head = _q(p.split(".*")[0] + "(.*)")
        return f"len(list_filter(list_zip(regexp_extract_all({x}, {head}, 1), regexp_extract_all({x}, {head}, 2)), lambda z: regexp_matches(z[2], '\\b' || z[1] || '\\b')))::BIGINT"
    return f"coalesce(len(regexp_extract_all({x}, {_q(p, ignore_case, lines)})), 0)::BIGINT"


def _any(patterns: list[str], x: str, ignore_case: bool = False, lines: bool = False) -> str:
    return "coalesce(" + " OR ".join(f"regexp_matches({x}, {_q(p, ignore_case, lines)})" for p in patterns) + ", false)"


def _lines(x: str, mark: str = "+", headers: bool = False) -> str:
    return f"list_filter(string_split(coalesce({x}, ''), chr(10)), lambda z: starts_with(z, '{mark}')" + (")" if headers else f" AND NOT starts_with(z, '{mark * 3}'))")


def _marked(x: str, mark: str = "+", keep: bool = False, headers: bool = False) -> str:
    found = _lines(x, mark, headers)
    return f"array_to_string({found if keep else f'list_transform({found}, lambda z: z[2:])'}, chr(10))"


def _hit(patterns: list[str]) -> str:
    return f"len(list_filter(list_transform({_lines('patch')}, lambda z: trim(z[2:], ' ' || chr(9))), lambda z: {_any(patterns, 'z')})) > 0"


def _score(x: str, scored: list[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({x}, {_q(p, True)}) THEN {n} ELSE 0 END" for p, n in scored) + ")::BIGINT"


def _patch_score(x: str, scored: list[tuple[str, int]], line: str = "z") -> str:
    return f"coalesce(list_sum(list_transform({_lines(x)}, lambda z: CASE " + " ".join(f"WHEN regexp_matches({line}, {_q(p)}) THEN {n}" for p, n in scored) + " ELSE 0 END)), 0)::BIGINT"


def _valid(ex: E.Extractor, name: str = "filename") -> str:
    base = f"string_split({name}, '/')[-1]"
    good = " OR ".join(f"(ends_with(lower({base}), '{s}') AND length({base}) > {len(s)})" for s in ex.suffixes)
    bad = " OR ".join(f"ends_with({base}, '{g}')" if g.startswith(".") else f"{base} = '{g}'" for g in ex.generated)
    return f"(({good}) AND NOT ({bad}))"


def _told(patterns: list[str], lines: bool = False) -> str:
    return f"({_any(patterns, 'title', True, lines)} OR {_any(patterns, 'body', True, lines)})"


def _in_language(language: str) -> str:
    return f"repo_id IN (SELECT id FROM r WHERE contains(lower(language), '{language.lower()}'))"


_ANY_LINES = {"any_additions": C.ANY_ADDED_LINE, "any_removals": C.ANY_REMOVED_LINE, "any_replacements": C.ANY_REPLACED_LINES}
_METHOD = "concat_ws('|', {})"


def _signs_sql(signs: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in signs.items()) + ")"


def _of_frame(ex: E.Extractor) -> str:
    """CTEs: g has files, hit and text of each change with valid files; a added and removed lines, too."""
    return f""", c1 AS (SELECT *, {_told(ex.keywords)} AS kw FROM c WHERE {_in_language(ex.language)} AND NOT {_told(ex.false_positives, ex.whole_lines)}
), g AS (SELECT pr_id, count(*) AS files, bool_or({_hit(ex.patch_patterns)}) AS hit, coalesce(string_agg(patch, chr(10) ORDER BY line, filename, patch), '') AS text FROM x WHERE {_valid(ex)} AND pr_id IN (SELECT id FROM c1) GROUP BY pr_id
), a AS (SELECT *, {_marked('text', keep=ex.keep_mark)} AS added, {_marked('text', '-')} AS removed FROM g)"""


def extracting(ex: E.Extractor) -> tuple[dict[str, str], dict[str, str], dict[str, str], str]:
    """SQL over _of_frame's a of an extractor: counts of features, of tokens and lines, the signs by name, and which changes are chosen."""
    counts = {n: _n(p, "added") for n, p in ex.features.items()}
    more = {f"{n}_{side}": _n(p, t) for n, p in ex.tokens.items() for side, t in (("additions", "added"), ("removals", "removed"))}
    if ex.any_lines:
        more |= {n: _n(p, "text", lines=True) for n, p in _ANY_LINES.items()}
        signs = {"any_add": "any_additions > 0", "any_rem": "any_removals > 0", "any_rep": "any_replacements > 0"}
        chosen = "(any_additions > 0 OR any_removals > 0 OR any_replacements > 0) AND (kw OR hit)"
    else:
        signs = {"features": "total_features > 0"} | ({"unsafe": "(unsafe_additions > 0 OR unsafe_removals > 0)"} if ex.tokens else {})
        chosen = " OR ".join([*signs.values(), "kw", "hit"])
    return counts, more, signs | {"type_keywords": "kw", "patch_patterns": "hit"}, chosen


def candidates(spark: SparkSession, sf: str, name: str, known: list[str] = ("id",)) -> DataFrame:
    """An extractor's candidates with what is known of them. Stored, as it is read twice: for the keys that details are filtered by, and for the changes."""
    c = E.candidates(corpus.changes(spark, sf), corpus.repositories(spark, sf), EXTRACTORS[name])
    return files.stored(c.select(*known, "false_positive", "type_keywords"), f"candidates-{name}")


def _extractor(name: str, ex: E.Extractor) -> None:
    counts, more, signs, chosen = extracting(ex)
    kept = ["id", "files", "total_features", *more, "detection_method"]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return E.extract_from(candidates(spark, sf, name), corpus.details(spark, sf), ex, corpus.ORDER).select(*kept)

    run.__name__ = f"filter_type_prs_{name}"
    asks(_of_frame(ex) + f""", k AS (SELECT pr_id, files, hit, ({' + '.join(counts.values())})::BIGINT AS total_features{''.join(f', {s} AS {n}' for n, s in more.items())} FROM a)
SELECT id, files, total_features{''.join(', ' + n for n in more)}, {_signs_sql(signs)} AS detection_method FROM c1 JOIN k ON k.pr_id = c1.id WHERE {chosen}""")(run)


for _name, _ex in EXTRACTORS.items():
    _extractor(_name, _ex)


# Titles, bodies, messages


_FLAGS = {"fp": (C.FALSE_POSITIVES, False), "keyword": (C.TYPE_KEYWORDS, False), "cs_fp": (C.CSHARP_FALSE_POSITIVES, False), "cs_keyword": (C.CSHARP_KEYWORDS, False), "rs_fp": (C.RUST_FALSE_POSITIVES, True), "rs_keyword": (C.RUST_KEYWORDS, False)}


def _flags(name: str, flags: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return corpus.changes(spark, sf).select("id", *[E.told(*_FLAGS[f]).alias(f) for f in flags])

    run.__name__ = name
    asks(f"SELECT id, {', '.join(f'{_told(*_FLAGS[f])} AS {f}' for f in flags)} FROM c")(run)


_flags("has_fp", ["fp", "cs_fp", "rs_fp"])
_flags("has_type_keywords", ["keyword", "cs_keyword", "rs_keyword"])
_flags("has_fp_and_keywords", ["fp", "keyword"])


@asks(f"SELECT pr_id, bool_or({_hit(C.PATCH_PATTERNS)}) AS ts, bool_or({_hit(C.CSHARP_PATCH_PATTERNS)}) AS cs, bool_or({_hit(C.RUST_PATCH_PATTERNS)}) AS rs FROM x GROUP BY pr_id")
def has_patch_type_patterns(spark, sf):
    d = corpus.details(spark, sf).select("pr_id", *[P.any_line_match(F.col("patch"), ex.patch_patterns).alias(n) for n, ex in EXTRACTORS.items()])
    return d.groupBy("pr_id").agg(*[F.max(n).alias(n) for n in EXTRACTORS])


@asks("SELECT pr_id, line, filename, " + ", ".join(f"{_valid(ex)} AS {n}" for n, ex in EXTRACTORS.items()) + " FROM x")
def is_valid_file(spark, sf):
    return corpus.details(spark, sf).select("pr_id", "line", "filename", *[P.has_suffix(F.col("filename"), ex.suffixes, ex.generated).alias(n) for n, ex in EXTRACTORS.items()])


_TEXT = f"coalesce({_score('title', C.SCORED_KEYWORDS)}, 0) + coalesce({_score('body', C.SCORED_KEYWORDS)}, 0)"
_PATCH_OF = f"""SELECT pr_id, count(*) AS files, max({_patch_score('patch', C.SCORED_LINES)}) AS patch_score, {', '.join(f"sum({_n(p, 'patch', lines=True)})::BIGINT AS {n}" for n, p in _ANY_LINES.items())} FROM x WHERE {_valid(E.TYPESCRIPT)} GROUP BY pr_id"""
_SCORES = f""", ps AS ({_PATCH_OF}), cs AS (SELECT pr_id, max({_score('message', C.SCORED_KEYWORDS)}) AS commit_score FROM m GROUP BY pr_id
), s AS (SELECT *, text_score + commit_score + patch_score + 2 * files AS total_score FROM (
  SELECT c.*, {_TEXT} AS text_score, coalesce(cs.commit_score, 0) AS commit_score, coalesce(ps.patch_score, 0) AS patch_score, coalesce(ps.files, 0) AS files FROM c LEFT JOIN ps ON ps.pr_id = c.id LEFT JOIN cs ON cs.pr_id = c.id))
"""


def _inputs(spark, sf):
    return corpus.changes(spark, sf), corpus.details(spark, sf), corpus.commits(spark, sf)


@asks(f"SELECT id, {_score('title', C.SCORED_KEYWORDS)} AS title_score, coalesce({_score('body', C.SCORED_KEYWORDS)}, 0)::BIGINT AS score FROM c")
def score_text(spark, sf):
    s = lambda c: P.score_text(F.col(c), C.SCORED_KEYWORDS)
    return corpus.changes(spark, sf).select("id", s("title").alias("title_score"), F.coalesce(s("body"), F.lit(0)).alias("score"))


_STRIPPED = "trim(z[2:], ' ' || chr(9))"


@asks(f"SELECT pr_id, line, filename, {_patch_score('patch', C.SCORED_LINES)} AS score, {_patch_score('patch', C.SCORED_STRIPPED_LINES, _STRIPPED)} AS stripped_score FROM x")
def score_patch(spark, sf):
    t, added = F.col("patch"), F.col("added")
    d = corpus.details(spark, sf).withColumn("added", P.marked(t, every_break=True))
    return d.select("pr_id", "line", "filename", P.score_patch(t, C.SCORED_LINES, found=added).alias("score"), P.score_patch(t, C.SCORED_STRIPPED_LINES, P.stripped, added).alias("stripped_score"))


@asks(f", t2 AS (SELECT pr_id, string_agg(patch, chr(10) ORDER BY line, filename, patch) AS text FROM x GROUP BY pr_id) SELECT id, {_TEXT} AS score, {_patch_score('text', C.SCORED_LINES)} AS line_score FROM c LEFT JOIN t2 ON t2.pr_id = id")
def score_text_and_patch(spark, sf):
    """Both scores of a change, its patches taken as one."""
    c = corpus.changes(spark, sf).select("id", *[F.coalesce(P.score_text(F.col(x), C.SCORED_KEYWORDS), F.lit(0)).alias(x) for x in ("title", "body")])
    text = O.joined_text(corpus.details(spark, sf, True).where("patch is not null"), "pr_id", corpus.ORDER, F.col("patch"), "\n").withColumnRenamed("pr_id", "id")
    return c.join(text, "id", "left").select("id", (F.col("title") + F.col("body")).alias("score"), P.score_patch(F.col("text"), C.SCORED_LINES).alias("line_score"))


@asks(_SCORES + "SELECT id, text_score, commit_score, patch_score, files, total_score FROM s")
def total_score(spark, sf):
    return E.scores(*_inputs(spark, sf)).select("id", "text_score", "commit_score", "patch_score", "files", "total_score")


@asks(_SCORES + "SELECT pr_id, commit_score AS best FROM (SELECT pr_id, coalesce(commit_score, 0) AS commit_score FROM cs)")
def max_commit_score(spark, sf):
    return E.commit_scores(corpus.commits(spark, sf)).select("pr_id", F.col("commit_score").alias("best"))


@asks(_SCORES + "SELECT pr_id, files, patch_score AS best, any_additions, any_removals, any_replacements FROM ps")
def max_patch_score(spark, sf):
    return E.patch_scores(corpus.details(spark, sf)).select("pr_id", "files", F.col("patch_score").alias("best"), *_ANY_LINES)


_SCORED_SIGNS = _signs_sql({"text": "text_score >= 10", "patch": "patch_score >= 18"})
_SCORED = f"SELECT id, total_score, {_SCORED_SIGNS} AS method FROM s WHERE files > 0 AND (text_score >= 10 OR patch_score >= 18) AND total_score >= 28 AND NOT {_told(C.FALSE_POSITIVES)}"


@asks(_SCORES + f"SELECT id, total_score FROM ({_SCORED})")
def filter_scored(spark, sf):
    return E.extract_scored(*_inputs(spark, sf)).select("id", "total_score")


@asks(_SCORES + _SCORED.replace("total_score, ", "", 1))
def detection_method(spark, sf):
    return E.extract_scored(*_inputs(spark, sf)).select("id", F.col("detection_method").alias("method"))


# Kernels over patches


def _documents_lines(name: str, sql: str, make) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return corpus.details(spark, sf).select("pr_id", "line", "filename", *make(F.col("patch")))

    run.__name__ = name
    asks(f"SELECT pr_id, line, filename, {sql} FROM x")(run)


def _occurrences(name: str, p: str, ignore_case: bool) -> None:
    n = lambda mark: f"coalesce(list_sum(list_transform({_lines('patch', mark)}, lambda z: len(regexp_extract_all(z, {_q(p, ignore_case)})))), 0)::BIGINT"

    def make(t: Column) -> list[Column]:
        a, r = (P.count_in_lines(P.marked(t, mark), p, ignore_case) for mark in "+-")
        return [a.alias("added"), r.alias("removed"), (a - r).alias("net"), (a + r).alias("total"), F.least(a, r).alias("replaced")]

    _documents_lines(name, f"{n('+')} AS added, {n('-')} AS removed, {n('+')} - {n('-')} AS net, {n('+')} + {n('-')} AS total, least({n('+')}, {n('-')}) AS replaced", make)


_occurrences("any_occurrences", C.ANY_PATTERN, False)
_occurrences("dynamic_occurrences", C.DYNAMIC_PATTERN, True)
_occurrences("unsafe_occurrences", C.UNSAFE_PATTERN, False)
_occurrences("unwrap_occurrences", C.UNWRAP_PATTERN, False)
_occurrences("as_cast_occurrences", C.AS_CAST_PATTERN, False)
_documents_lines("escape_hatches", ", ".join(f"{_n(p, 'patch', n == 'dynamic')} AS \"{n}\"" for n, p in (("any", C.ANY_PATTERN), ("dynamic", C.DYNAMIC_PATTERN), ("unsafe", C.UNSAFE_PATTERN), ("unwrap", C.UNWRAP_PATTERN), ("as_cast", C.AS_CAST_PATTERN))),
                 lambda t: [P.occurrences(t, p, n == "dynamic").alias(n) for n, p in (("any", C.ANY_PATTERN), ("dynamic", C.DYNAMIC_PATTERN), ("unsafe", C.UNSAFE_PATTERN), ("unwrap", C.UNWRAP_PATTERN), ("as_cast", C.AS_CAST_PATTERN))])
_documents_lines("any_adds_and_replacements", ", ".join(f"{_n(p, 'patch', lines=True)} AS {n}" for n, p in _ANY_LINES.items()), lambda t: [c.alias(n) for n, c in E.any_lines(t).items()])
_documents_lines("any_replacements", f"{_n(C.ANY_REPLACED_LINES, 'patch', lines=True)} AS n", lambda t: [E.any_lines(t)["any_replacements"].alias("n")])
_L = "string_split(coalesce(patch, ''), chr(10))"
_documents_lines("type_to_any_conversions", f"len(list_filter(range(1, len({_L})), lambda i: starts_with({_L}[i], '-') AND NOT starts_with({_L}[i], '---') AND contains({_L}[i], ':') AND NOT contains(lower({_L}[i]), 'any') AND starts_with({_L}[i + 1], '+') AND regexp_matches({_L}[i + 1], {_q(C.ANY_PATTERN)})))::BIGINT AS n",
                 lambda t: [P.type_to_any(t, C.ANY_PATTERN).alias("n")])
_documents_lines("marked_lines", f"{_marked('patch')} AS added, {_marked('patch', keep=True)} AS kept, {_marked('patch', keep=True, headers=True)} AS loose, {_marked('patch', '-')} AS removed",
                 lambda t: [P.marked_text(t).alias("added"), P.marked_text(t, keep_mark=True).alias("kept"), P.marked_text(t, keep_mark=True, headers=True).alias("loose"), P.marked_text(t, "-").alias("removed")])
_documents_lines("quality_flags", "contains(lower(p), 'test') OR contains(lower(p), 'spec') AS has_tests, contains(lower(p), 'todo') OR contains(lower(p), 'fixme') AS has_todo, contains(lower(p), 'eslint-disable') AS has_eslint_disable, contains(p, '@ts-ignore') OR contains(p, '@ts-nocheck') AS has_ts_ignore, contains(p, ': any') OR contains(p, '<any>') AS has_any_type".replace("p)", "coalesce(patch, ''))").replace("(p,", "(coalesce(patch, ''),"),
                 lambda t: [c.alias(n) for n, c in O.quality_flags(t).items()])


#: By catalogue: its language's extractor, whether cases differ, whether marks are kept, whether headers count as added lines.
CATALOGUES = {
    "ts": (E.TYPESCRIPT, C.TS_FEATURES, True, False, False), "csharp": (E.CSHARP, C.CSHARP_FEATURES, True, False, False), "rust": (E.RUST, C.RUST_FEATURES, True, False, False),
    "csharp_no_lookahead": (E.CSHARP, {k: p for k, p in C.CSHARP_FEATURES.items() if "(?!" not in p}, True, False, False),
    "ts_extractor": (E.TYPESCRIPT, C.TS_EXTRACTED, False, True, False), "csharp_extractor": (E.CSHARP, C.CSHARP_EXTRACTED, False, False, False), "rust_extractor": (E.RUST, C.RUST_EXTRACTED, False, False, False),
    "ts_human": (E.TYPESCRIPT, C.TS_HUMAN, False, True, False), "csharp_human": (E.CSHARP, C.CSHARP_HUMAN, False, True, False),
    "ts_analysis": (E.TYPESCRIPT, C.TS_ANALYSIS, True, True, True), "csharp_analysis": (E.CSHARP, C.CSHARP_ANALYSIS, True, True, True), "rust_analysis": (E.RUST, C.RUST_ANALYSIS, False, False, False),
    "ts_subset": (E.TYPESCRIPT, C.TS_SUBSET, True, True, True), "csharp_subset": (E.CSHARP, C.CSHARP_SUBSET, True, True, True), "csharp_safety": (E.CSHARP, C.CSHARP_SAFETY, True, True, True),
}


def features(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """id, agent, agent_group, created_at, shipped, added_text, and a count for each feature of a catalogue: of its language's changes, over the added lines of their valid files."""
    ex, catalogue, ignore_case, keep, headers = CATALOGUES[name]
    c = E.of_language(corpus.changes(spark, sf), corpus.repositories(spark, sf), ex.language)
    d = E.valid_details(corpus.details(spark, sf), ex).join(c.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    rows = F.sort_array(F.collect_list(F.when(F.col("patch").isNotNull(), F.struct(*corpus.ORDER, "patch"))))
    d = d.groupBy(F.col("pr_id").alias("id")).agg(F.min("shipped_at").alias("shipped"), F.countDistinct("filename").alias("files"), F.sum("changes").alias("changes"), F.array_join(F.transform(rows, lambda r: r["patch"]), "\n").alias("text"))
    d = d.withColumn("added_text", P.marked_text(F.col("text"), "+", keep, headers))
    d = d.withColumn("counts", P.counted(F.col("added_text"), catalogue, ignore_case))
    return c.join(d.select("id", "shipped", "files", "changes", "added_text", "counts.*"), "id")


def _features_sql(name: str) -> str:
    """CTE f, as features()."""
    ex, catalogue, ignore_case, keep, headers = CATALOGUES[name]
    n = ", ".join(f'{_n(p, "added_text", ignore_case)} AS "{k}"' for k, p in catalogue.items())
    return f""", v AS (SELECT pr_id, min(shipped_at) AS shipped, count(DISTINCT filename) AS files, sum(changes)::BIGINT AS changes, coalesce(string_agg(patch, chr(10) ORDER BY line, filename, patch), '') AS text FROM x WHERE {_valid(ex)} GROUP BY pr_id
), w AS (SELECT *, {_marked('text', '+', keep, headers)} AS added_text FROM v
), f AS (SELECT c.*, w.shipped, w.files, w.changes, w.added_text, {n} FROM c JOIN w ON w.pr_id = c.id WHERE {_in_language(ex.language)})
"""


def _total_unique(names) -> tuple[str, str]:
    return " + ".join(f'"{k}"' for k in names), " + ".join(f'("{k}" > 0)::BIGINT' for k in names)


def _counts_query(name: str) -> None:
    names = list(CATALOGUES[name][1])
    t, u = _total_unique(names)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        total, unique = P.total_and_unique(names)
        return features(spark, sf, name).select("id", *names, total.alias("total"), unique.alias("features"))

    run.__name__ = f"feature_counts_{name}"
    asks(_features_sql(name) + f"""SELECT id, {', '.join(f'"{k}"' for k in names)}, {t} AS total, {u} AS features FROM f""")(run)


for _name in CATALOGUES:
    _counts_query(_name)


# Sums of features by group


_TS = list(C.TS_ANALYSIS)
_WHO = "CASE WHEN agent_group = 'AI' THEN agent ELSE 'Human' END"


def _who() -> Column:
    return F.when(F.col("agent_group") == "AI", F.col("agent")).otherwise("Human").alias("name")


def _mean_sql(names, group: str | None = None, weights=None) -> str:
    keep = f" FILTER (WHERE agent_group = '{group}')" if group else ""
    return " + ".join(f'coalesce(avg("{n}"){keep}, 0)' + (f" * {weights[n]}::DOUBLE" if weights else "") for n in names)


def _mean(names, group: str | None = None, weights=None) -> Column:
    out = F.lit(0.0)
    for n in names:
        x = F.when(F.col("agent_group") == group, F.col(n)) if group else F.col(n)
        out = out + F.coalesce(F.avg(x), F.lit(0.0)) * (weights[n] if weights else 1.0)
    return out


_LONG = "SELECT agent_group, " + f"unnest([{', '.join(_q(k) for k in _TS)}]) AS feature, unnest([{', '.join(chr(34) + k + chr(34) for k in _TS)}]) AS x FROM f"


@asks(_features_sql("ts_analysis") + f"""SELECT *, ai - human AS difference FROM (SELECT feature, round(100.0::DOUBLE * avg((x > 0)::INT) FILTER (WHERE agent_group = 'AI'), 6) AS ai, round(100.0::DOUBLE * avg((x > 0)::INT) FILTER (WHERE agent_group = 'Human'), 6) AS human, round(avg(x), 6) AS mean FROM ({_LONG}) GROUP BY feature)""")
def adoption_rate(spark, sf):
    """Shares of changes with each feature, the greatest lead of AI first."""
    long = features(spark, sf, "ts_analysis").unpivot("agent_group", _TS, "feature", "x")
    share = lambda g: F.round(100 * F.avg(F.when(F.col("agent_group") == g, (F.col("x") > 0).cast("double"))), 6)
    r = long.groupBy("feature").agg(share("AI").alias("ai"), share("Human").alias("human"), F.round(F.avg("x"), 6).alias("mean"))
    return r.withColumn("difference", F.col("ai") - F.col("human")).orderBy(F.desc("difference"), "feature")


@asks(_features_sql("ts_analysis") + "SELECT agent_group, " + ", ".join(f'round(avg("{k}"), 6) AS "{k}"' for k in _TS) + " FROM f GROUP BY agent_group")
def feature_means(spark, sf):
    return features(spark, sf, "ts_analysis").groupBy("agent_group").agg(*[F.round(F.avg(k), 6).alias(k) for k in _TS])


_RUST = list(C.RUST_ANALYSIS)


@asks(_features_sql("rust_analysis") + f"SELECT {_WHO} AS name, " + ", ".join(f'round(avg("{k}"), 6) AS "{k}"' for k in _RUST) + " FROM f GROUP BY 1")
def agent_feature_matrix(spark, sf):
    """Mean counts by agent, in order of names, and Human last."""
    m = features(spark, sf, "rust_analysis").groupBy(_who()).agg(*[F.round(F.avg(k), 6).alias(k) for k in _RUST])
    return m.orderBy(F.col("name") == "Human", "name")


@asks(_features_sql("ts_analysis") + f"SELECT name, round(avg(u), 6) AS mean, round(stddev_samp(u), 6) AS std FROM (SELECT {_WHO} AS name, {_total_unique(_TS)[1]} AS u FROM f) GROUP BY name")
def diversity_by_agent(spark, sf):
    f = features(spark, sf, "ts_analysis").select(_who(), P.total_and_unique(_TS)[1].alias("u"))
    return f.groupBy("name").agg(F.round(F.avg("u"), 6).alias("mean"), F.round(F.stddev_samp("u"), 6).alias("std"))


@asks(_features_sql("ts_analysis") + " UNION ALL ".join(f"SELECT '{t}' AS tier, round({_mean_sql(fs, 'AI')}, 6) AS ai, round({_mean_sql(fs, 'Human')}, 6) AS human FROM f" for t, fs in C.TIERS.items()))
def tier_usage(spark, sf):
    """Sums of the means of each tier's features."""
    one = features(spark, sf, "ts_analysis").agg(*[F.struct(F.lit(t).alias("tier"), F.round(_mean(fs, "AI"), 6).alias("ai"), F.round(_mean(fs, "Human"), 6).alias("human")).alias(t) for t, fs in C.TIERS.items()])
    return one.select(F.explode(F.array(*C.TIERS)).alias("r")).select("r.*")


@asks(_features_sql("ts_analysis") + f"SELECT {_WHO} AS name, round({_mean_sql(C.SOPHISTICATION, None, C.SOPHISTICATION)}, 6) AS weighted FROM f GROUP BY 1")
def sophistication(spark, sf):
    r = features(spark, sf, "ts_analysis").groupBy(_who()).agg(F.round(_mean(C.SOPHISTICATION, None, C.SOPHISTICATION), 6).alias("weighted"))
    return r.orderBy(F.desc("weighted"), "name")


@asks(_features_sql("ts_analysis") + f"SELECT agent_group, round({_mean_sql(C.MODERN)}, 6) AS modern, round({_mean_sql(C.LEGACY)}, 6) AS legacy FROM f GROUP BY agent_group")
def modern_vs_legacy(spark, sf):
    return features(spark, sf, "ts_analysis").groupBy("agent_group").agg(F.round(_mean(C.MODERN), 6).alias("modern"), F.round(_mean(C.LEGACY), 6).alias("legacy"))


@asks(_features_sql("ts_analysis") + "SELECT agent_group, " + ", ".join(f'round(100.0::DOUBLE * avg(("{k}" > 0)::INT), 6) AS "{k}"' for k in C.TS_SAFETY) + " FROM f GROUP BY agent_group")
def safety_adoption(spark, sf):
    return features(spark, sf, "ts_analysis").groupBy("agent_group").agg(*[F.round(100 * F.avg((F.col(k) > 0).cast("double")), 6).alias(k) for k in C.TS_SAFETY])


@asks(_features_sql("ts_analysis") + f"SELECT id, round(CASE WHEN changes > 0 THEN 100.0::DOUBLE * ({_total_unique(_TS)[0]}) / changes ELSE 0 END, 6) AS density FROM f")
def feature_density(spark, sf):
    """Features for a hundred changed lines."""
    f = features(spark, sf, "ts_analysis").select("id", "changes", P.total_and_unique(_TS)[0].alias("total"))
    return f.select("id", F.round(O.ratio(100 * F.col("total"), F.col("changes")), 6).alias("density"))


_RUST_FRAME = _of_frame(E.RUST) + ", k AS (SELECT c1.agent_group, " + ", ".join(f"{_n(p, 'added')} AS {n}" for n, p in E.RUST.tokens.items()) + " FROM c1 JOIN a ON a.pr_id = c1.id) "


@asks(_RUST_FRAME + "SELECT agent_group, round(avg(unwrap), 6) AS unwrap, round(avg(as_cast), 6) AS as_cast, round(avg(unsafe), 6) AS unsafe, 0.0::DOUBLE AS other FROM k GROUP BY agent_group")
def secondary_escape_means(spark, sf):
    """Means of counts, as a stored table has them: as text; a column that isn't there has the mean 0."""
    c = E.of_language(corpus.changes(spark, sf), corpus.repositories(spark, sf), "Rust").where(~E.told(C.RUST_FALSE_POSITIVES, True))
    d = corpus.details(spark, sf).join(c.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    stored = c.join(E.patch_counts(d, E.RUST, corpus.ORDER).withColumnRenamed("pr_id", "id"), "id").select("agent_group", *[F.col(f"{n}_additions").cast("string").alias(n) for n in E.RUST.tokens])
    return O.stored_means(stored, ["agent_group"], ["unwrap", "as_cast", "unsafe", "other"])


@asks(", ".join(["SELECT language, agent_group, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{ex.language}' AS language, agent_group FROM c WHERE {_in_language(ex.language)}" for ex in EXTRACTORS.values()) + ") GROUP BY language, agent_group"]))
def dataset_overview(spark, sf):
    c, r = corpus.changes(spark, sf), corpus.repositories(spark, sf)
    names = F.array(*[F.when(O.contains_word(F.col("language"), ex.language), ex.language) for ex in EXTRACTORS.values()])
    r = r.select(F.col("id").alias("repo_id"), F.explode(F.array_compact(names)).alias("language"))
    return c.join(r, "repo_id").groupBy("language", "agent_group").agg(F.count("*").alias("n"))


# Texts of changes


@asks(corpus.COLLECTED_SQL + "SELECT * FROM t")
def collected_patches(spark, sf):
    return corpus.collected(spark, sf)


def _heads(x: str = "text") -> str:
    return f"list_transform(list_filter(string_split({x}, chr(10)), lambda z: starts_with(z, '===') AND ends_with(z, '===')), lambda z: trim(string_split(string_split(z, '===')[2], '(')[1], ' ' || chr(9)))"


@asks(corpus.COLLECTED_SQL + f"SELECT pr_id, array_to_string({_heads()}, ',') AS names FROM t")
def header_filenames(spark, sf):
    return corpus.collected(spark, sf).select("pr_id", F.array_join(P.header_names(F.col("text")), ",").alias("names"))


def _names_file(ex: E.Extractor, n: int) -> str:
    holds = " OR ".join(f"contains(z, '{s}')" for s in ex.suffixes)
    bad = " OR ".join(f"contains(z, '{g}')" for g in ex.generated)
    return f"(len(list_filter({_heads()}, lambda z: {_valid(ex, 'z')})) > 0 OR len(list_filter(string_split(text, chr(10))[1:{n}], lambda z: (starts_with(z, 'diff --git') OR starts_with(z, '---') OR starts_with(z, '+++')) AND ({holds}) AND NOT ({bad}))) > 0)"


_FIRST = {"ts": 50, "cs": 50, "rs": 200}
#: Half of the texts lose their headers, so that what follows them is looked at.
_BARE = corpus.COLLECTED_SQL + ", b AS (SELECT pr_id, CASE WHEN pr_id % 2 = 0 THEN text ELSE replace(regexp_replace(text, '=== [^=]* ===', 'index', 'g'), '--- a/', 'diff --git a/x b/') END AS text FROM t) "


def _read() -> tuple[Column, Column]:
    """What P.with_lines() makes."""
    return F.col("rows"), F.col("names")


def _bare(spark, sf):
    plain = F.replace(F.regexp_replace("text", "=== [^=]* ===", "index"), F.lit("--- a/"), F.lit("diff --git a/x b/"))
    return corpus.collected(spark, sf).withColumn("text", F.when(F.col("pr_id") % 2 == 0, F.col("text")).otherwise(plain))


@asks(_BARE + "SELECT pr_id, " + ", ".join(f"{_names_file(ex, _FIRST[n])} AS {n}" for n, ex in EXTRACTORS.items()) + " FROM b")
def patch_has_lang_file(spark, sf):
    return P.with_lines(_bare(spark, sf), "text").select("pr_id", *[P.names_file(F.col("text"), ex.suffixes, ex.generated, _FIRST[n], _read()).alias(n) for n, ex in EXTRACTORS.items()])


_FILES = {n: f"len(list_distinct(list_filter({_heads()}, lambda z: {_valid(ex, 'z')})))" for n, ex in EXTRACTORS.items()}
_DIFFS = f"len(list_distinct(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda z: starts_with(z, 'diff --git')), lambda z: regexp_replace(string_split(z, ' ')[4], '^b/', '')), lambda z: {_valid(E.RUST, 'z')})))"


@asks(_BARE + f"SELECT pr_id, {_FILES['ts']}::BIGINT AS ts, {_FILES['cs']}::BIGINT AS cs, (CASE WHEN {_FILES['rs']} > 0 THEN {_FILES['rs']} ELSE {_DIFFS} END)::BIGINT AS rs FROM b")
def patch_file_count(spark, sf):
    return P.with_lines(_bare(spark, sf), "text").select("pr_id", *[P.file_count(F.col("text"), ex.suffixes, ex.generated, n == "rs", _read()).alias(n) for n, ex in EXTRACTORS.items()])


_STATED = "len(list_filter({}, lambda z: z <> '')) > 0"
_SUM = "coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda z: starts_with(z, '===') AND ends_with(z, '===')), lambda z: coalesce(TRY_CAST(regexp_extract(z, '[(][+]([0-9]+)/-([0-9]+)[)]', {}) AS BIGINT), 0))), 0)"


@asks(_BARE + f", s AS (SELECT pr_id, text, {_SUM.format(1)} AS p, {_SUM.format(2)} AS q, len(list_distinct(list_filter({_heads()}, lambda z: z <> '')))::BIGINT AS files FROM b) SELECT pr_id, (CASE WHEN p + q > 0 THEN p ELSE len({_lines('text')}) END)::BIGINT AS additions, (CASE WHEN p + q > 0 THEN q ELSE len({_lines('text', '-')}) END)::BIGINT AS deletions, files FROM s")
def patch_additions_deletions(spark, sf):
    plus, minus, files = P.header_sums(F.col("text"), _read())
    return P.with_lines(_bare(spark, sf), "text").select("pr_id", plus.alias("additions"), minus.alias("deletions"), files.alias("files"))


# The report


def _frame_sql(i: int, name: str, escape: str, ignore_case: bool, safety: str) -> str:
    names = list(CATALOGUES[name][1])
    t, u = _total_unique(names)
    body = _features_sql(name)
    for cte in ("v", "w", "f"):
        body = body.replace(f", {cte} AS (", f", {cte}{i} AS (").replace(f"FROM {cte}\n", f"FROM {cte}{i}\n").replace(f"JOIN {cte} ON {cte}.", f"JOIN {cte}{i} AS {cte} ON {cte}.")
    body = body.replace("\n), w AS (", f"\n), w{i} AS (").replace("\n), f AS (", f"\n), f{i} AS (")
    return body + f""", l{i} AS (SELECT '{CATALOGUES[name][0].language}' AS language, agent_group = 'AI' AS ai, {_n(escape, 'added_text', ignore_case)} AS escape, {u} AS "unique", {t} AS total, "{safety}" AS safety, coalesce(shipped > created_at, false) AS merged FROM f{i})"""


#: By language: its catalogue, its escape hatch and whether in any case, its safety anti-pattern.
REPORTED = [("ts", C.ANY_PATTERN, False, "non_null_assertion"), ("csharp", C.DYNAMIC_PATTERN, True, "null_forgiving"), ("rust", C.UNSAFE_PATTERN, False, "unsafe_impl")]


def report_frame(spark: SparkSession, sf: str) -> DataFrame:
    """language, ai, escape, unique, total, safety, merged of each language's changes."""
    out = None
    for name, escape, ignore_case, safety in REPORTED:
        f = features(spark, sf, name)
        total, unique = P.total_and_unique(list(CATALOGUES[name][1]))
        f = f.select(F.lit(CATALOGUES[name][0].language).alias("language"), (F.col("agent_group") == "AI").alias("ai"), P.occurrences(F.col("added_text"), escape, ignore_case).alias("escape"), unique.alias("unique"), total.alias("total"), F.col(safety).alias("safety"), F.coalesce(F.col("shipped") > F.col("created_at"), F.lit(False)).alias("merged"))
        out = f if out is None else out.unionByName(f)
    return out


_CHI = "(a + b + c + d) * pow(greatest(abs(a * d - b * c)::DOUBLE - (a + b + c + d) / 2.0::DOUBLE, 0), 2) / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0)"
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"
_LABEL = lambda names, i: "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in names.items()) + " END"
_REPORT = "".join(_frame_sql(i, *r) for i, r in enumerate(REPORTED)) + f""", l AS ({' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(len(REPORTED)))}
), q AS (SELECT language, metric, count(*) FILTER (WHERE ai AND held) AS a, count(*) FILTER (WHERE ai AND NOT held) AS b, count(*) FILTER (WHERE NOT ai AND held) AS c, count(*) FILTER (WHERE NOT ai AND NOT held) AS d FROM (
  SELECT language, ai, unnest(['has_escape', 'has_safety', 'merged']) AS metric, unnest([escape > 0, safety > 0, merged]) AS held FROM l) GROUP BY language, metric
), fi AS (SELECT language, metric, least(1, sum(e) FILTER (WHERE e <= o * 1.0000001)) AS f FROM (SELECT *, exp(base - lgamma(y + 1) - lgamma(a + b - y + 1) - lgamma(a + c - y + 1) - lgamma(d - a + y + 1)) AS e, exp(base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS o FROM (
  SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS y FROM q)) GROUP BY language, metric
), sh AS (SELECT language, metric, a, b, c, d, least(a + b, c + d) < 50 OR least(a, b, c, d) < 5 AS few, f, {_CHI} AS x2 FROM q JOIN fi USING (language, metric)
), mv AS (SELECT language, metric, ai, x FROM (SELECT language, ai, unnest(['escape', 'unique', 'total']) AS metric, unnest([escape, "unique", total])::DOUBLE AS x FROM l) WHERE metric <> 'escape' OR x > 0
), mr AS (SELECT *, rank() OVER (PARTITION BY language, metric ORDER BY x) + (count(*) OVER (PARTITION BY language, metric, x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY language, metric, x) AS k FROM mv
), ma AS (SELECT language, metric, (count(*) FILTER (WHERE ai))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT ai))::DOUBLE AS n2, sum(rk) FILTER (WHERE ai) AS r1, sum(k * k - 1)::DOUBLE AS ties, avg(x) FILTER (WHERE ai) AS m1, avg(x) FILTER (WHERE NOT ai) AS m2, median(x) FILTER (WHERE ai) AS d1, median(x) FILTER (WHERE NOT ai) AS d2,
  var_samp(x) FILTER (WHERE ai) AS v1, var_samp(x) FILTER (WHERE NOT ai) AS v2 FROM mr GROUP BY language, metric
), mu AS (SELECT *, {_Z} AS z FROM (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM ma WHERE n1 > 0 AND n2 > 0)
), al AS (
  SELECT language, {_LABEL(report.SHARES, 0)} AS rq, {_LABEL(report.SHARES, 1)} AS metric, CASE WHEN few THEN 'Fisher''s exact' ELSE 'Chi-square' END AS test, coalesce(100.0::DOUBLE * a / nullif(a + b, 0), 0) AS ai, coalesce(100.0::DOUBLE * c / nullif(c + d, 0), 0) AS human,
    CASE WHEN few THEN f ELSE {S.erfc_sql('sqrt(x2 / 2.0)')} END AS p, CASE WHEN few THEN 'OR' ELSE 'V' END AS effect_name, CASE WHEN few THEN CASE WHEN b = 0 OR c = 0 THEN 'inf'::DOUBLE ELSE a * d / (b * c)::DOUBLE END ELSE sqrt(x2 / (a + b + c + d)) END AS effect, NULL::DOUBLE AS r FROM sh
  UNION ALL SELECT language, {_LABEL(report.COUNTS, 0)}, {_LABEL(report.COUNTS, 1)}, 'Mann-Whitney U', CASE WHEN metric = 'escape' THEN d1 ELSE m1 END, CASE WHEN metric = 'escape' THEN d2 ELSE m2 END, least(1, {S.erfc_sql('z')}), 'd',
    CASE WHEN n1 < 2 OR n2 < 2 OR v1 + v2 = 0 THEN 0 ELSE (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END, 2 * u1 / (n1 * n2) - 1 FROM mu
)
SELECT language, rq, metric, test, round(ai, 6) AS ai, round(human, 6) AS human, round(p, 6) AS p, effect_name, round(effect, 6) AS effect, round(r, 6) AS r, {_STARS} AS sig FROM al"""


@asks(_REPORT)
def language_report(spark, sf):
    """Six questions for each language: the two groups' figures, the test, its p and stars, and the size of the effect."""
    r = report.language_report(files.stored(report_frame(spark, sf), "report-frame"))
    return r.withColumns({c: F.round(c, 6) for c in ("p", "effect", "r")})


@asks(_features_sql("ts_analysis") + f""", lg AS (SELECT agent_group = 'AI' AS g, feature, x FROM ({_LONG}))
SELECT feature, n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN top > 0 THEN u1 END AS u1, CASE WHEN top > 0 THEN round(least(1, {S.erfc_sql('z')}), 6) END AS p, CASE WHEN top > 0 THEN round(2 * u1 / (n1 * n2) - 1, 6) END AS rank_biserial FROM (SELECT *, {_Z} AS z FROM (
  SELECT feature, n1, n2, top, r1 - n1 * (n1 + 1) / 2 AS u1, ties FROM (
    SELECT feature, max(x) AS top, (count(*) FILTER (WHERE g))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT g))::DOUBLE AS n2, sum(r) FILTER (WHERE g) AS r1, sum(c * c - 1)::DOUBLE AS ties FROM (
      SELECT feature, g, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY feature, x) AS c FROM lg) GROUP BY feature)) WHERE top > 0
  UNION ALL SELECT feature, count(*) FILTER (WHERE g), count(*) FILTER (WHERE NOT g), max(x), NULL, NULL, NULL FROM lg GROUP BY feature HAVING max(x) <= 0)""")
def per_feature_tests(spark, sf):
    t = S.per_feature_tests(features(spark, sf, "ts_analysis").select("agent_group", *_TS), _TS, F.col("agent_group") == "AI")
    return t.select("feature", "n1", "n2", "u1", F.round("p", 6).alias("p"), F.round("rank_biserial", 6).alias("rank_biserial"))


@asks(_features_sql("ts") + """, b AS (SELECT agent_group, files FROM f), k AS (SELECT least(min(m), 20) AS k FROM (SELECT agent_group, max(files) AS m FROM b GROUP BY agent_group))
SELECT g.agent_group, v.bin, count(b.files) AS n, round(count(b.files)::DOUBLE / nullif(sum(count(b.files)) OVER (PARTITION BY g.agent_group), 0), 6) AS density FROM (SELECT DISTINCT agent_group FROM b) g, (SELECT unnest(range(0, k + 1)) AS bin FROM k) v
  LEFT JOIN b ON b.agent_group = g.agent_group AND least(b.files, (SELECT k FROM k)) = v.bin AND b.files <= (SELECT k FROM k) + 1 GROUP BY g.agent_group, v.bin""")
def histogram(spark, sf):
    """Files a change, in bins of one, 0 to the least of the groups' greatest numbers and 20."""
    return O.histogram(features(spark, sf, "ts").select("agent_group", "files"), "agent_group", "files", 20)
