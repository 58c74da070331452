"""The report that compares two groups of authors by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.functions import distributions as D
from patchlight.functions import statistics as S

#: Question and metric by column of the frame: shares of changes, and counts a change.
SHARES = {"has_escape": ("RQ1", "escape prevalence"), "has_safety": ("RQ2", "safety anti-pattern adoption"), "merged": ("RQ3", "acceptance rate")}
COUNTS = {"escape": ("RQ1", "escape intensity"), "unique": ("RQ2", "feature diversity"), "total": ("RQ2", "feature volume")}


def _named(names: dict[str, tuple[str, str]], i: int) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col("metric") == k, F.lit(v[i])).otherwise(out)
    return out


def language_report(frame: DataFrame) -> DataFrame:
    """Six rows for each language of a frame (language, ai, escape, unique, total, safety, merged; one row a change, counts and two booleans).

    language, rq, metric, test, ai, human, p, sig, effect_name, effect, r. Shares (in percent): changes with an escape,
    with the safety anti-pattern, merged; by proportion_test. Counts: escapes of the changes that have any (medians), and
    unique and total features (means); by Mann-Whitney with Cohen's d and the rank-biserial r.
    """
    flags = frame.select("language", "ai", (F.col("escape") > 0).alias("has_escape"), (F.col("safety") > 0).alias("has_safety"), "merged").unpivot(["language", "ai"], list(SHARES), "metric", "held")
    n = {"a": F.col("ai") & F.col("held"), "b": F.col("ai") & ~F.col("held"), "c": ~F.col("ai") & F.col("held"), "d": ~F.col("ai") & ~F.col("held")}
    t = flags.groupBy("language", "metric").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    share = lambda x, y: F.round(F.lit(100.0) * F.coalesce(F.try_divide(F.col(x).cast("double"), (F.col(x) + F.col(y)).cast("double")), F.lit(0.0)), 6)
    test = S.proportion_test(*map(F.col, "abcd"))
    shares = t.select("language", _named(SHARES, 0).alias("rq"), _named(SHARES, 1).alias("metric"), test["test"].alias("test"), share("a", "b").alias("ai"), share("c", "d").alias("human"),
                      test["p"].alias("p"), test["effect_name"].alias("effect_name"), test["effect"].alias("effect"), F.lit(None).cast("double").alias("r"))

    long = frame.select("language", "ai", *[F.col(c).cast("double").alias(c) for c in COUNTS]).unpivot(["language", "ai"], list(COUNTS), "metric", "x").where("metric <> 'escape' or x > 0")
    u = S.mann_whitney(long, "x", F.col("ai"), ["language", "metric"]).drop("greatest")
    of = lambda f, g, x="x": f(F.when(F.col("ai") == g, F.col(x)))
    means = long.groupBy("language", "metric").agg(of(F.avg, True).alias("mean1"), of(F.avg, False).alias("mean2"), S.cohens_d(F.col("x"), F.col("ai")).alias("effect"))
    q = D.quantiles(long.where("metric = 'escape'"), ["language", "metric", "ai"], F.col("x"), {"q": 0.5})
    medians = q.groupBy("language", "metric").agg(of(F.max, True, "q").alias("median1"), of(F.max, False, "q").alias("median2"))  # two rows a language
    means = means.join(medians, ["language", "metric"], "left")
    shown = lambda i: F.round(F.when(F.col("metric") == "escape", F.col(f"median{i}")).otherwise(F.col(f"mean{i}")), 6)
    counts = u.where("n1 > 0 and n2 > 0").join(means, ["language", "metric"]).select(
        "language", _named(COUNTS, 0).alias("rq"), _named(COUNTS, 1).alias("metric"), F.lit("Mann-Whitney U").alias("test"), shown(1).alias("ai"), shown(2).alias("human"), "p", F.lit("d").alias("effect_name"), "effect", F.col("rank_biserial").alias("r"))
    return shares.unionByName(counts).withColumn("sig", S.stars(F.col("p")))
