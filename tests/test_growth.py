"""Steps that cost more than the rows they give: what is repeated in plans, and what is tried in vain."""

import pytest
from pyspark.sql import functions as F

from patchlight.functions import patch as P
from patchlight.functions import patterns as C
from patchlight.operators import changes as O
from patchlight.operators import extractors as E
from patchlight.plans import corpus
from patchlight.plans import queries as plans

SF = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_assembled_patches_repeat_little(spark):
    """A filter on the patch is pushed below its assembly, which is repeated there: lookups, not cases over all pieces."""
    found = optimised(corpus.details(spark, SF).where("trim(patch) <> ''").select("patch"))
    assert found.count("element_at(") <= 12 and found.count("CASE WHEN") <= 2


def test_assembled_patches_follow_signed_keys(spark):
    """The looked-up names and pieces are those of the arithmetic that the SQL states."""
    for d in corpus.details(spark, SF).where("patch like '--- a/%'").limit(50).collect():
        assert d.patch.startswith(f"--- a/{d.filename}\n+++ b/{d.filename}\n")
    assert corpus._name(-3) == "src/m-3" + corpus.ENDINGS["cs"][4] and corpus._pieces("cs", -7) == "".join("\n" + corpus.PIECES["cs"][(-7 + j * -1) % 18] for j in range(5))


def test_report_reads_its_frame_once(spark):
    assert all("report-frame" in f for f in plans.QUERIES["language_report"](spark, SF).inputFiles())


@pytest.mark.parametrize("p, words", [
    (r"\bunsafe\s+impl\b", ["unsafe"]), (r"\.\s*(?:unwrap|expect)\s*\(", ["unwrap", "expect"]), (r"Array<any>|:\s*any", ["any"]), (r"a?b*", []), (r"(?i)abc", []), (r"(?i:abc)", []), (r"[a-z]+", []), (r"\h+abc", []), (r"(?:ab|c?)x", ["x"]),
])
def test_words_that_patterns_need(p, words):
    assert P.needed(p) == words


def test_nothing_is_missed_for_lack_of_words(spark):
    """Letters whose other case is an ASCII one (long s, the sign of kelvin), null and empty texts, and all catalogues over all pieces."""
    texts = ["baſe AS Foo ſatiſfies x", "Keyof T", "as İs", None, "", *[x for k in corpus.PIECES for x in corpus.PIECES[k]]]
    texts += ["\n".join(corpus.PIECES[k]) for k in corpus.PIECES]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for catalogue in (C.TS_ANALYSIS, C.CSHARP_ANALYSIS, C.RUST_ANALYSIS, C.TS_EXTRACTED, C.CSHARP_EXTRACTED, C.RUST_EXTRACTED):
        for ignore_case in (False, True):
            plain = F.struct(*[F.coalesce(F.regexp_count("t", P.pattern(p, ignore_case)), F.lit(0)).cast("bigint").alias(n) for n, p in catalogue.items()])
            got = df.select("t", P.counted(F.col("t"), catalogue, ignore_case).alias("a"), plain.alias("b")).where("a <> b").collect()
            assert not got
    keywords = [p for p, _ in C.SCORED_KEYWORDS]
    plain = sum((F.when(F.regexp_like("t", P.pattern(p, True)), n).otherwise(0) for p, n in C.SCORED_KEYWORDS), F.lit(0)).cast("bigint")
    assert not df.where(~P.score_text(F.col("t"), C.SCORED_KEYWORDS).eqNullSafe(plain)).collect()
    assert not df.where(P.any_match(F.col("t"), keywords, True) != (F.coalesce(plain, F.lit(0)) > 0)).collect()


def test_patches_read_once_say_the_same(spark):
    texts = ["=== a.ts (+1/-2) ===\n+x\n-y\n+z", "=== b(c.rs ===\n=== ===\n===", "diff --git a/x b/y.rs\n+++ b/y.ts", "", None, "+a\r\n+b\x0b+c\n+d"]
    df = P.with_lines(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    t, read = F.col("t"), (F.col("rows"), F.col("names"))
    pairs = [(P.names_file(t, [".ts"], [".d.ts"]), P.names_file(t, [".ts"], [".d.ts"], read=read)), (P.file_count(t, [".rs"], [], True), P.file_count(t, [".rs"], [], True, read)), *zip(P.header_sums(t), P.header_sums(t, read))]
    for a, b in pairs:
        assert not df.where(~a.eqNullSafe(b)).collect()
    assert [r[0] for r in df.select(F.size(P.marked(t, every_break=True))).collect()] == [2, 0, 0, 0, 0, 4]


def test_collected_patches_keep_null_names(spark):
    rows = [(1, 2, "b", "+x", None, 1), (1, 1, None, "+y", 3, 4), (1, 3, "c", " \n", 1, 1), (2, 1, "a", None, 1, 1)]
    d = spark.createDataFrame(rows, "pr_id int, line int, filename string, patch string, additions int, deletions int")
    assert [tuple(r) for r in O.collected_patches(d, ["line"]).collect()] == [(1, "=== null (+3/-4) ===\n+y\n\n=== b (+null/-1) ===\n+x")]


@pytest.mark.parametrize("name", ["collected_patches", "patch_has_lang_file", "patch_file_count", "patch_additions_deletions", "build_prompt", "acceptance_by_factor", "quality_score", "score_text_and_patch"])
def test_texts_of_patches_arent_shuffled(spark, name):
    """What groups patches by change shuffles keys and numbers of line items: no lists of texts."""
    text = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list(struct(line" in text.replace(" ", "")
    lists = [i for i, x in enumerate(text.split("\n")) if "partial_collect_list(struct(line" in x.replace(" ", "")]
    for i in lists:
        above = next(x for x in reversed(text.split("\n")[:i]) if "HashAggregate" in x or "Exchange" in x)
        assert "Exchange" not in above


def test_score_patch_splits_a_patch_once(spark):
    text = optimised(plans.QUERIES["score_patch"](spark, SF))
    assert text.count("split(") == 2  # at line feeds, or at every break


@pytest.mark.parametrize("text,n", [("+a\n+b", 2), ("+a\r\n+b\r+c", 3), ("+ä\u2028+b\x85+c", 3), ("+a\u2029+b", 2), ("+ä\n+…", 2), ("+a\x1c+b\x1d+c\x1e+d\x0b+e\x0c+f", 6)])
def test_every_kind_of_break_ends_a_line(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(P.marked(F.col("t"), every_break=True))).collect()[0][0] == n


def test_exports_read_line_items_once(spark):
    """what the extractor counts, the details' sums and the patches come from one grouping; candidates are stored."""
    text = plans.QUERIES["export_type_prs_rs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1 and "orders.parquet" not in text and text.count("candidates-rs") == 2


def test_summaries_count_what_they_sum(spark):
    """no features are counted and no text is put together where only lines that say any are asked for."""
    text = optimised(plans.QUERIES["any_stats_by_agent"](spark, SF))
    assert "type-changes" not in text and "=== " not in text
    assert C.ANY_ADDED_LINE in text and C.TS_EXTRACTED["unique_symbol"] not in text


def test_titles_of_other_languages_arent_read(spark):
    """repositories are filtered by language before titles and bodies are looked through, once."""
    text = optimised(E.candidates(corpus.changes(spark, SF), corpus.repositories(spark, SF), E.RUST))
    assert text.index("content[_-]?type") < text.index("Join LeftSemi") and text.count("content[_-]?type") == 1


def test_extract_with_details_says_what_its_parts_say(spark):
    """Null and blank patches, files of other languages, equal names, a change without valid files, a false positive, a change that stands twice, no change at all."""
    d = spark.createDataFrame([
        (1, 1, "a.rs", "+unsafe { x }\r", 1, 2, 3), (1, 2, "b.md", "+text\n-y", 4, None, 4), (1, 3, "a.rs", None, 1, 1, 2), (1, 4, None, " \t\n", 1, 1, 2), (1, 5, "c.rs", "+impl A\x0b+fn f\u2028-let x = y.unwrap();", 7, 7, 14), (1, 5, "c.rs", "", 7, 7, 14),
        (2, 1, "z.md", "+unsafe", 1, 1, 2), (3, 1, "a.rs", None, 2, 2, 4), (3, 2, "b.rs", "\n", 2, 2, 4), (4, 1, "a.rs", "+struct A", 1, 1, 2), (5, 1, "a.rs", "+x\ny", 1, 0, 1), (None, 1, "a.rs", "+struct A", 1, 1, 2),
    ], "pr_id int, line int, filename string, patch string, additions bigint, deletions bigint, changes bigint").repartition(3)
    changes = spark.createDataFrame([(1, 7, "plain", None), (2, 7, "unsafe", ""), (3, 7, "a trait Foo", "b"), (4, 7, "content-type", "x"), (5, 7, "words", "y"), (5, 7, "words", "y"), (6, 7, "unsafe", None), (1, 8, "other", None)], "id int, repo_id int, title string, body string")
    repos = spark.createDataFrame([(7, "Rust"), (7, "rust"), (8, "Go")], "id int, language string")
    whole = E.extract_with_details(E.candidates(changes, repos, E.RUST), d, E.RUST, corpus.ORDER, F.max("line").alias("last"))
    found = E.extract(changes, repos, d, E.RUST, corpus.ORDER)
    stats = O.commit_stats(d, F.max("line").alias("last")).withColumnsRenamed({"pr_id": "id", "files": "files_changed"})
    parts = found.join(stats, "id").join(O.collected_patches(d, corpus.ORDER).withColumnsRenamed({"pr_id": "id", "text": "patch_text"}), "id", "left")
    key = lambda r: str(sorted(r.asDict().items(), key=str))
    got, want = (sorted(map(key, x.select(*sorted(parts.columns)).collect())) for x in (whole, parts))
    assert got == want and len(got) >= 2 and sorted(whole.columns) == sorted(parts.columns)
    one = whole.where("id = 1").collect()[0]
    assert (one.files, one.files_changed, one.additions, one.deletions, one.unwrap_removals) == (4, 3, 21, 18, 1) and one.patch_text.count("=== ") == 3
    assert whole.where("id = 3").collect()[0].patch_text is None
