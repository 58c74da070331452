"""Kernels and statistics against values worked out by hand or published."""

import bisect
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions import patch as P
from patchlight.functions import patterns as C
from patchlight.functions import statistics as S
from patchlight.operators import changes as O
from patchlight.operators import extractors as E
from patchlight.operators import labelling as L
from patchlight.plans import queries as plans
from patchlight.sources import tables

PATCH = "--- a/x.ts\n+++ b/x.ts\n-let a: Foo;\n+let a: any;\n+let b = c as any;\n ctx: any"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_marked_lines(spark):
    p = F.lit(PATCH)
    r = one(spark, P.marked_text(p), P.marked_text(p, "-"), F.size(P.marked(p, "+", headers=True)), P.occurrences(P.marked_text(p), C.ANY_PATTERN), P.marked_text(F.lit(None).cast("string")))
    assert tuple(r) == ("let a: any;\nlet b = c as any;", "let a: Foo;", 3, 2, "")


def test_followed_by(spark):
    minus, plus = (lambda x: x.startswith("-") & ~x.startswith("---")), (lambda x: x.startswith("+") & ~x.startswith("+++"))
    assert one(spark, P.followed_by(F.lit(PATCH), minus, plus), P.followed_by(F.lit(None).cast("string"), minus, plus))[:] == (1, 0)


def test_header_sums(spark):
    r = one(spark, *P.header_sums(F.lit("=== a.ts (+3/-1) ===\n=== b.ts (+2/-0) ===")), *P.header_sums(F.lit("=== a.ts (+0/-0) ===\n+x\n+y")))
    assert tuple(r) == (5, 1, 2, 2, 0, 1)


def test_suffixes(spark):
    r = one(spark, *[P.has_suffix(F.lit(n).cast("string"), [".ts", ".tsx"], [".d.ts"]) for n in ("a/b.TS", "a/b.d.ts", ".ts", None)])
    assert tuple(r) == (True, False, False, False)


def test_buckets_and_stars(spark):
    r = one(spark, *[O.size_bucket(F.lit(n)) for n in (10, 11, 50, 51, 200, 201)], *[S.stars(F.lit(p)) for p in (0.001, 0.0009, 0.05)])
    assert tuple(r) == ("Small", "Medium", "Medium", "Large", "Large", "Very Large", "**", "***", "ns")


def test_group_of(spark):
    r = one(spark, *[O.group_of(F.lit(n).cast("string"), C.AI_AGENTS) for n in ("Devin", "Human", None)])
    assert tuple(r) == ("AI", "Human", "Human")


@pytest.mark.parametrize("table, chi2, p", [((297, 351, 68, 201), 32.6657, 1.0945e-8), ((128, 520, 0, 269), 60.1223, 8.914e-15), ((142, 567, 2, 42), 5.4591, 0.019467)])
def test_chi2_published(spark, table, chi2, p):
    x = S.chi2_yates(*map(F.lit, table))
    r = one(spark, x, S.chi2_p(x))
    assert r[0] == pytest.approx(chi2, abs=1e-3) and r[1] == pytest.approx(p, rel=1e-3)


@pytest.mark.parametrize("table, p", [((128, 520, 0, 269), 1.39568e-21), ((142, 567, 2, 42), 0.0090151), ((402, 307, 44, 0), 5.4788e-11), ((26, 683, 1, 43), 1.0)])
def test_fisher_published(spark, table, p):
    df = spark.createDataFrame([table], "a long, b long, c long, d long")
    assert df.select(S.fisher_p(*map(F.col, "abcd"))).first()[0] == pytest.approx(p, rel=1e-4)


def test_odds_ratio(spark):
    assert one(spark, S.odds_ratio(*map(F.lit, (5, 0, 3, 4))))[0] == math.inf


def test_ranks_and_u(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 1)], "x int, g int")
    assert sorted(r["rank"] for r in S.midranks(df, "x", ["g"]).collect()) == [1, 2.5, 2.5, 4]
    u = S.mann_whitney(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "x int, g string").withColumn("k", F.lit(1)), "x", F.col("g") == "a", ["k"]).first()
    assert (u["u1"], u["rank_biserial"]) == (0, -1)


def test_calendar_fills_gaps(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-05'), (timestamp'2024-03-01'), (null) AS t(at)")
    assert [r["n"] for r in O.calendar(df, "at").orderBy("month").collect()] == [1, 0, 1]


def test_rolling_window_is_open_on_the_left(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 1.0D), (timestamp'2024-01-31', 3.0D) AS t(at, x)").withColumn("g", F.lit(1))
    assert [r["rolling"] for r in O.rolling_mean(df, ["g"], "at", F.col("x")).orderBy("at").collect()] == [1.0, 3.0]


def test_confusion(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, False)] * 4 + [(False, True)] * 2 + [(None, True)]
    r = O.confusion(spark.createDataFrame(rows, "p boolean, t boolean"), F.col("p"), F.col("t")).first()
    assert (r.accuracy, r.precision, r.recall, r.specificity, r.f1) == (0.7, 0.75, 0.6, 0.8, 0.666667)


def test_conform_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,pr_title,patch\n1,"x","+a\n+b"\n2,,\n')
    df = tables.csv(spark, str(tmp_path / "a.csv"), "id long, pr_title string, patch string")
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("patch", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = tables.conform(df, shape, {"title": "none", "n": 0}, {"title": ["pr_title"]}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "x", "+a\n+b", 0), (2, "none", None, 0)]


def test_kernels_over_headers(spark):
    from patchlight.functions import patch as P
    from patchlight.operators import changes as O

    rows = [(1, "=== a/b.TS (+1/-0) ===\n+x as any as any\n=== c.md (+0/-2) ==="), (2, "diff --git a/x.tsx b/x.tsx"), (3, None), (4, "x.ts\n=== ==="), (5, "\n" * 60 + "+++ b/y.ts")]
    df = spark.createDataFrame(rows, "id int, t string")
    t = F.col("t")
    got = {r.id: r for r in df.select("id", P.header_names(t).alias("names"), P.names_file(t, [".ts", ".tsx"]).alias("there"), P.count_in_lines(P.marked(t), r"as\s+any").alias("n")).collect()}
    assert got[1].names == ["a/b.TS", "c.md"] and got[3].names == [] and got[4].names == [""]
    assert [got[i].there for i in range(1, 6)] == [True, True, False, False, False]
    assert [got[i].n for i in range(1, 6)] == [2, 0, 0, 0, 0]
    final, validation = O.judged(F.col("id") < 4, F.when(F.col("id") < 3, "APPROVED"), F.col("id") == 1)
    assert [tuple(r) for r in df.orderBy("id").select(final, validation).take(3)] == [(False, "ERROR"), (True, "APPROVED"), (False, "UNCERTAIN")]


def test_files_keep_lines_quotes_and_spaces(spark):
    from patchlight.sources import files, tables

    rows = [(1, 'a "quoted", text\nof two lines'), (2, "  spaces "), (3, None), (4, "")]
    path = files.fresh_folder(spark, "t")
    files.write_csv(spark.createDataFrame(rows, "id int, t string"), path)
    back = {r.id: r.t for r in tables.csv(spark, path, "id int, t string").collect()}
    assert back == {1: rows[0][1], 2: rows[1][1], 3: None, 4: None}


def test_extractors_use_their_own_catalogues(spark):
    from patchlight.plans import kernels

    texts = {"cs": ["struct X", "public record Y", "#nullable enable"], "rs": ["pub trait Shape", "struct X", "enum Kind"], "": ["a plain walk", ""]}
    df = spark.createDataFrame([(t,) for ts in texts.values() for t in ts], "t string")
    for language in ("cs", "rs"):
        got = {r.t for r in kernels.extracted(df, language).collect()}
        assert set(texts[language]) <= got and not got & set(texts[""])


def test_batches_cover_all_orders(spark):
    from patchlight.plans import queries

    r = queries.QUERIES["batch_slices_all"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert sorted(x.batch for x in r) == [k // 100 for k in range(n)]


# Scores, lines and Unicode


def test_only_added_lines_score(spark):
    lines = {"+ // the type foo": 0, " context interface X": 0, "+interface Shape {": 25, "-interface Old {": 0, "+++ b/interface X": 0, "+let a: any;": 15, "+  let b = c as Row": 12, "+plain": 0, "+let a: Foo;\n+type X = 1": 40}
    df = spark.createDataFrame([*lines.items(), (None, 0)], "t string, n int")
    assert all(r.s == r.n for r in df.select("n", P.score_patch(F.col("t"), C.SCORED_LINES).alias("s")).collect())
    assert one(spark, P.score_patch(F.lit("+ // the type foo"), C.SCORED_STRIPPED_LINES, P.stripped))[0] == 25


def test_texts_score_in_either_case(spark):
    assert one(spark, *[P.score_text(F.lit(t), C.SCORED_KEYWORDS) for t in ("Type Id = 1", "NOIMPLICITANY", "a: Foo;", "plain")])[:] == (12, 11, 10, 0)


def test_words_are_unicode(spark):
    df = spark.createDataFrame([("as caf\u00e9", "\u00e9type x = 1", "a\u00a0as\u00a0B")], "a string, b string, c string")
    r = df.select(P.occurrences(F.col("a"), r"\bas\s+\w+\b"), P.occurrences(F.col("b"), r"\btype\s+"), P.occurrences(F.col("c"), r"\s+as\s+[A-Z]")).first()
    assert tuple(r) == (1, 0, 1)


def test_every_kind_of_line_break(spark):
    t = F.lit("+a\r\n+b\x0b+c\u2028+d\x85-e\n+f")
    assert one(spark, P.marked_text(t, every_break=True), P.marked_text(t, "-", every_break=True), F.size(P.marked(t)))[:] == ("a\nb\nc\nd\nf", "e", 3)


def test_any_lines_and_conversions(spark):
    r = one(spark, *E.any_lines(F.lit(PATCH)).values(), P.type_to_any(F.lit(PATCH), C.ANY_PATTERN))
    assert tuple(r) == (1, 0, 1, 1)


def test_file_counts_and_names(spark):
    texts = ["=== a/x.rs (+1/-0) ===\n=== b/build.rs (+1/-0) ===\n=== a/x.rs (+2/-2) ===", "diff --git a/bin/y.rs b/bin/y.rs\ndiff --git a/z.pb.rs b/z.pb.rs\ndiff --git", "diff --git a/x.ts b/x.ts", "+++ b/x.d.ts", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rs, ts = E.RUST, E.TYPESCRIPT
    got = [tuple(r) for r in df.orderBy("id").select(P.file_count(F.col("t"), rs.suffixes, rs.generated, True), P.file_count(F.col("t"), rs.suffixes, rs.generated), P.names_file(F.col("t"), ts.suffixes, ts.generated), P.names_file(F.col("t"), rs.suffixes, rs.generated, 200)).collect()]
    assert got == [(1, 1, False, True), (1, 0, False, True), (0, 0, True, False), (0, 0, False, False), (0, 0, False, False)]


def test_quality_flags_and_patterns(spark):
    r = one(spark, *O.quality_flags(F.lit("+ TODO: a SPEC // ESLINT-disable @TS-IGNORE x: any")).values(), *O.quality_flags(F.lit(None).cast("string")).values(), *[O.change_pattern(F.lit(x)) for x in (0.2, 0.5, 1.0, 1.5, 1.6)])
    assert tuple(r) == (True, True, True, False, True) + (False,) * 5 + ("More Additions", None, "Balanced Changes", None, "More Deletions")


# Extractors


def test_extractors_choose_changes(spark):
    changes = spark.createDataFrame([
        (1, "interface Row", None, "Devin", 1), (2, "input type", "interface Row", "Devin", 1), (3, None, "plain", None, 1), (4, "plain", "plain", "x", 1), (5, "interface Row", "", "x", 2), (6, "interface Row", "", "x", 1), (7, "typed", None, "x", 3), (8, "x", "// SAFETY: fine", "x", 3), (9, "x", "y\n// SAFETY: fine", "x", 3),
    ], "id long, title string, body string, agent string, repo_id long")
    repos = spark.createDataFrame([(1, "My TypeScript"), (2, None), (3, "Rust")], "id long, language string")
    details = spark.createDataFrame([
        (1, "a.ts", "+x: any\n-y: any", 1), (2, "a.ts", "+x: any", 1), (3, "b.TSX", "-a: Foo;\n+a: any;", 2), (3, "b.tsx", None, 1), (4, "a.d.ts", "+x: any", 1), (4, "a.ts", "+plain", 2), (5, "a.ts", "+x: any", 1), (6, "a.md", "+x: any", 1), (7, "lib.rs", "-unsafe { }\n+plain", 1), (8, "lib.rs", "+unsafe { }", 1), (9, "lib.rs", "+unsafe { }", 1),
    ], "pr_id long, filename string, patch string, line int")
    ts = {r.id: r for r in E.extract(changes, repos, details, E.TYPESCRIPT, ["line"]).collect()}
    assert set(ts) == {1, 3}
    assert (ts[1].detection_method, ts[3].detection_method, ts[3].files) == ("any_add|any_rem|type_keywords|patch_patterns", "any_add|any_rep|patch_patterns", 2)
    rs = {r.id: r for r in E.extract(changes, repos, details, E.RUST, ["line"]).collect()}
    assert set(rs) == {7} and (rs[7].detection_method, rs[7].unsafe_removals, rs[7].unsafe_additions) == ("unsafe", 1, 0)
    assert E.extract(changes, repos, details.where("false"), E.CSHARP, ["line"]).collect() == []


def test_scored_extractor(spark):
    changes = spark.createDataFrame([(1, "interface Row", None), (2, "plain", "plain"), (3, "console.log of a type", None), (4, "interface Row", "type X = 1")], "id long, title string, body string")
    details = spark.createDataFrame([(1, "a.ts", "+interface X\n+plain"), (1, "b.ts", "+let a: Foo;"), (2, "a.ts", "+interface X\n+type Y = 1"), (3, "a.ts", "+interface X"), (4, "a.md", "+interface X")], "pr_id long, filename string, patch string")
    commits = spark.createDataFrame([(1, "wip"), (1, "noImplicitAny"), (2, None)], "pr_id long, message string")
    s = {r.id: r for r in E.scores(changes, details, commits).collect()}
    assert [(s[i].text_score, s[i].commit_score, s[i].patch_score, s[i].files, s[i].total_score) for i in (1, 2, 4)] == [(12, 11, 25, 2, 52), (0, 0, 50, 1, 52), (24, 0, 0, 0, 24)]
    got = {r.id: r.detection_method for r in E.extract_scored(changes, details, commits).collect()}
    assert got == {1: "text|patch", 2: "patch"}
    assert {r.id: r.total_score for r in E.extract_scored(changes, details, None).collect()} == {1: 41, 2: 52}


# Statistics against brute force


def test_small_samples_have_exact_p(spark):
    rng, rows, want = random.Random(4), [], {}
    for k, (n1, n2) in enumerate([(1, 1), (2, 3), (3, 3), (4, 6), (8, 3), (1, 9), (5, 9)]):
        x = rng.sample(range(1000), n1 + n2)
        rows += [(k, v, i < n1) for i, v in enumerate(x)]
        u = lambda a, b: sum(p > q for p in a for q in b)
        seen = u(x[:n1], x[n1:])
        seen = max(seen, n1 * n2 - seen)
        every = [u([x[i] for i in c], [x[i] for i in range(n1 + n2) if i not in c]) for c in itertools.combinations(range(n1 + n2), n1)]
        want[k] = min(1, 2 * sum(v >= seen for v in every) / len(every))
    got = S.mann_whitney(spark.createDataFrame(rows, "k int, x int, g boolean"), "x", F.col("g"), ["k"]).collect()
    assert {r.k: r.p for r in got} == pytest.approx(want)


def test_ranks_over_many_stretches(spark):
    rng = random.Random(5)
    x = [rng.choice([rng.randrange(40), rng.random() * 40]) for _ in range(3000)]
    df = spark.createDataFrame([(float(v), i % 3, 1) for i, v in enumerate(x)], "x double, g int, one int")
    order = sorted(x)
    got = {r.x: r["rank"] for r in S.midranks(df, "x", ["one"]).collect()}
    assert all(got[v] == (bisect.bisect_left(order, v) + 1 + bisect.bisect_right(order, v)) / 2 for v in x)


def test_features_that_never_occur_have_no_test(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 3), ("b", 0, 4)], "g string, no int, yes int")
    r = {x.feature: x for x in S.per_feature_tests(df, ["no", "yes"], F.col("g") == "a").collect()}
    assert (r["no"].u1, r["no"].p, r["no"].rank_biserial) == (None, None, None) and r["yes"].u1 == 0 and r["yes"].p == pytest.approx(1 / 3)


def test_fisher_of_large_tables(spark):
    def brute(a, b, c, d):
        lg = math.lgamma
        chance = lambda x: math.exp(lg(a + b + 1) + lg(c + d + 1) + lg(a + c + 1) + lg(b + d + 1) - lg(a + b + c + d + 1) - lg(x + 1) - lg(a + b - x + 1) - lg(a + c - x + 1) - lg(d - a + x + 1))
        every = [chance(x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        return min(1, sum(p for p in every if p <= chance(a) * (1 + 1e-7)))

    tables_ = [(3, 20000, 9, 30000), (4, 900000, 2, 100000), (5000, 7000, 5100, 6900), (0, 5, 5, 0), (0, 0, 3, 4), (1, 40, 20000, 900)]
    got = spark.createDataFrame(tables_, "a long, b long, c long, d long").select(*"abcd", S.fisher_p(*map(F.col, "abcd")).alias("p")).collect()
    assert all(r.p == pytest.approx(brute(*r[:4]), rel=1e-5, abs=1e-12) for r in got)


def test_rolling_mean_against_brute_force(spark):
    rng, day = random.Random(6), 86_400_000_000
    rows = [(k, rng.choice("ab"), rng.randrange(100) * day + rng.choice([0, 1, day - 1]), float(rng.randrange(5))) for k in range(300)] + [(900, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, us long, x double").withColumn("at", F.timestamp_micros("us"))
    got = {r.id: r.rolling for r in O.rolling_mean(df, ["g"], "at", F.col("x")).collect()}
    for i, g, t, _ in rows:
        near = [x for _, h, u, x in rows if h == g and t is not None and u is not None and t - 30 * day < u <= t]
        assert got[i] == (pytest.approx(sum(near) / len(near)) if near else None)
    assert len(got) == 301


def test_gaps_are_filled(spark):
    df = spark.sql("SELECT timestamp(a) AS at FROM VALUES ('2024-01-06'), ('2024-01-08'), ('2024-01-08'), (null) AS t(a)")
    assert [(r.weekday, r.n) for r in O.weekdays(df, "at").orderBy("weekday").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 0)]
    assert [r.share for r in O.weekdays(df.where("false"), "at").collect()] == [None] * 7


def test_histogram_bins(spark):
    rows = [("a", x) for x in (0, 1, 1, 5, 6, 7)] + [("b", x) for x in (2, 5, 5)]
    r = O.histogram(spark.createDataFrame(rows, "g string, x int"), "g", "x", 20)
    assert {(x.g, x.bin): x.n for x in r.collect() if x.n} == {("a", 0): 1, ("a", 1): 2, ("a", 5): 2, ("b", 2): 1, ("b", 5): 2}
    assert r.count() == 12 and {round(x[1], 4) for x in r.groupBy("g").agg(F.sum("density")).collect()} == {1.0}


def test_components_of_standardised_vectors(spark):
    import numpy as np

    df = plans.QUERIES["standardize_pca"](spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()], float)
    z = (x - x.mean(0)) / x.std(0)  # the deviation of the population, as scalers take it
    values, vectors = np.linalg.eigh(np.cov(z.T))
    for k, name in ((-1, "c1"), (-2, "c2")):
        want, got = z @ vectors[:, k], np.array([r[name] for r in df])
        assert min(np.abs(want - got).max(), np.abs(want + got).max()) < 1e-4


# Labelling and files


def test_records_of_answers(spark):
    yes = '{"is_type_related": true, "confidence": 0.9, "evidence": ["a"], "detected_in": {"title": true}}'
    ok = '{"validation_result": "APPROVED", "agreed_classification": true}'
    rows = [(1, yes, ok, "ok"), (2, yes, ok, "error"), (3, yes, ok, "timeout"), (4, "broken", None, "ok"), (5, yes, "{}", None)]
    r = {x.id: x for x in L.records(spark.createDataFrame(rows, "id int, answer string, review string, outcome string")).collect()}
    assert [r[i].final_is_type_related for i in range(1, 6)] == [True, False, False, False, False]
    assert [r[i].validation_result for i in range(1, 6)] == ["APPROVED", "ERROR", "APPROVED", "UNCERTAIN", "UNCERTAIN"]
    assert (r[3].classifier_reasoning, r[2].validator_reasoning, r[1].classifier_evidence, r[4].classifier_evidence, r[1].detected_in_title) == ("Timeout after 30 seconds", "Classifier API error", '["a"]', "[]", True)


def test_prompts_clip_and_fill(spark):
    df = spark.createDataFrame([("t" * 600, None, "", "p" * 3000, 1, None, 2)], "title string, body string, commit_messages string, patch_text string, additions int, deletions int, files int")
    p = df.select(L.classifier_prompt("Rust")).first()[0]
    assert "t" * 500 in p and "t" * 501 not in p and "p" * 2000 in p and "p" * 2001 not in p and "No description" in p and "No commit messages" in p and "+1/-0; Rust files: 2" in p


def test_agreement_of_raters(spark):
    df = spark.createDataFrame([("y", "Y"), ("n", "y"), ("", "y"), (None, "n"), ("N", None)], "a string, b string")
    assert df.agg(L.agreement(F.col("a"), F.col("b"))).first()[0] == pytest.approx(100 / 3)


def test_markdown_and_json_files(spark):
    from patchlight.sources import files

    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    files.write_markdown(df, (at := files.fresh_folder(spark, "md")), ["k"])
    assert [r.value for r in spark.read.text(at).collect()] == ["| k | n |", "|---|---|", "| a |  |", "| b | 2 |"]
    files.write_json(df, (at := files.fresh_folder(spark, "json")))
    assert sorted(r.value for r in spark.read.text(at).collect()) == ['{"k":"a","n":null}', '{"k":"b","n":2}']


def test_places_across_stretches_and_regions(spark):
    keys = [-70, -1, 0, 1, 3, 4, 15, 16, 17, 63, 64, 1000, 5000]
    df = spark.createDataFrame([(k, k * 2) for k in keys] + [(None, 1)], "k long, v long")
    r = O.places(df, "k", bits=2).orderBy("place").collect()
    assert [(x.k, x.v, x.place) for x in r] == [(k, k * 2, i) for i, k in enumerate(keys)]
    assert O.places(df.where("false"), "k").collect() == []
