"""Operators over tables of changes: selecting, joining, summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_word(c: Column, word: str) -> Column:
    """Whether c contains word in any case; null: no."""
    return F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))


def group_of(agent: Column, agents: list[str]) -> Column:
    """'AI' for the named agents, 'Human' for all others and for none."""
    return F.when(agent.isin(agents), "AI").otherwise("Human")


def status(merged_at: Column, state: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").otherwise(F.lower(state))


def size_bucket(changes: Column) -> Column:
    return F.when(changes <= 10, "Small").when(changes <= 50, "Medium").when(changes <= 200, "Large").otherwise("Very Large")


def complexity_bucket(unique: Column) -> Column:
    return F.when(unique <= 0, "None").when(unique <= 2, "Low").when(unique <= 5, "Medium").otherwise("High")


def hours_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)).cast("double") / F.lit(3.6e9)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    return F.unix_micros(at.cast("timestamp"))


def unit_of(unit: str, at: Column) -> Column:
    """The start of the day, month, ... without a zone."""
    return F.date_trunc(unit, at.cast("timestamp")).cast("timestamp_ntz")


def change_pattern(ratio: Column) -> Column:
    """How deletions stand to additions."""
    return F.when(F.abs(ratio - 1) < 0.5, "Balanced Changes").when(ratio < 0.5, "More Additions").when(ratio > 1.5, "More Deletions")


def quality_flags(patch: Column) -> dict[str, Column]:
    """What a patch holds: the first three in any case, the others in just theirs; a null patch holds nothing."""
    p = F.coalesce(patch, F.lit(""))
    low = F.lower(p)
    return {
        "has_tests": low.contains("test") | low.contains("spec"), "has_todo": low.contains("todo") | low.contains("fixme"), "has_eslint_disable": low.contains("eslint-disable"),
        "has_ts_ignore": p.contains("@ts-ignore") | p.contains("@ts-nocheck"), "has_any_type": p.contains(": any") | p.contains("<any>"),
    }


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not above 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def left_with_zeros(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """df with the columns of stats, one row for each key, 0 where it has none."""
    new = [c for c in stats.columns if c != key]
    return df.join(stats, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in new})


def commit_stats(details: DataFrame, *more: Column) -> DataFrame:
    """Sums of a change's details, and the number of its different files; and what more aggregates give."""
    return details.groupBy("pr_id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum("changes").alias("changes"), F.countDistinct("filename").alias("files"), *more)


def joined_text(df: DataFrame, key: str, order: list[str], piece: Column, separator: str, first: int | None = None) -> DataFrame:
    """Each key's pieces (the first ones, if a number is given: others don't get as far as the grouping), in order, as one text."""
    if first:
        df = df.withColumn("__piece", piece)
        df, piece = first_rows(df, [key], [F.col(c) for c in [*order, "__piece"]], first), F.col("__piece")
    rows = F.sort_array(F.collect_list(F.struct(*order, piece.alias("__piece"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["__piece"]), separator).alias("text"))


def collected_patches(details: DataFrame, order: list[str]) -> DataFrame:
    """Each pr_id's patches that aren't blank, in order, each under a header '=== filename (+additions/-deletions) ==='."""
    d = details.where(~is_blank(F.col("patch")))
    return d.groupBy("pr_id").agg(under_headers(F.sort_array(F.collect_list(F.struct(*collectable(order))))).alias("text"))


def is_blank(patch: Column) -> Column:
    return F.btrim(patch, F.lit(" \t\n\r")) == ""


def collectable(order: list[str]) -> list[str]:
    """The columns of details that under_headers() takes, in the order that sorts them."""
    return list(dict.fromkeys([*order, "patch", "additions", "deletions", "filename"]))


def under_headers(rows: Column) -> Column:
    """The patches of an array of details as one text, each under its header."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    piece = lambda r: F.concat(F.lit("=== "), shown(r["filename"]), F.lit(" (+"), shown(r["additions"]), F.lit("/-"), shown(r["deletions"]), F.lit(") ===\n"), r["patch"])
    return F.array_join(F.transform(rows, piece), "\n\n")


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """Each by's first n rows."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def acceptance(df: DataFrame, *by: str) -> DataFrame:
    """Counts of changes by status, and rates in percent."""
    n = F.count("*")
    part = lambda s: F.count_if(F.col("status") == s)
    rate = lambda s: F.round(F.lit(100.0) * part(s) / n, 6)
    return df.groupBy(*by).agg(n.alias("total"), part("merged").alias("merged"), part("closed").alias("closed"), part("open").alias("open"), rate("merged").alias("merge_rate"), rate("closed").alias("close_rate"), rate("open").alias("open_rate"))


def spread(x: Column) -> dict[str, Column]:
    """Mean, deviation, standard error and the half-width of its 95% interval."""
    sem = F.stddev_samp(x) / F.sqrt(F.count(x))
    return {"mean": F.avg(x), "std": F.stddev_samp(x), "sem": sem, "ci": F.lit(1.96) * sem}


def units(df: DataFrame, unit: str) -> DataFrame:
    """One row for each unit of time from the first to the last that column unit of df has."""
    return df.agg(F.min(unit).alias("a"), F.max(unit).alias("b")).select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias(unit))


def places(df: DataFrame, key: str, bits: int = 12) -> DataFrame:
    """df and each row's place, from 0, by a whole-number key; rows without a key go, equal keys follow each other in any order.

    Rows are numbered within stretches of 2^bits keys, after those of the stretches before, which are summed up within
    regions of as many stretches: no task holds more rows than a stretch or a region has, but one, that sums up the regions.
    """
    df = df.where(F.col(key).isNotNull()).withColumn("__part", F.shiftright(F.col(key).cast("bigint"), bits)).withColumn("__region", F.shiftright("__part", bits))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy("__region", "__part").agg(F.count("*").alias("__n"))
    regions = counts.groupBy("__region").agg(F.sum("__n").alias("__n")).select("__region", before(Window.orderBy("__region")).alias("__far"))
    firsts = counts.select("__region", "__part", before(Window.partitionBy("__region").orderBy("__part")).alias("__near")).join(regions, "__region").drop("__region")
    at = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return df.drop("__region").withColumn("__at", at).join(firsts, "__part").withColumn("place", F.col("__far") + F.col("__near") + F.col("__at")).drop("__part", "__far", "__near", "__at")


def calendar(df: DataFrame, at: str, unit: str = "month") -> DataFrame:
    """Counts for each unit of time from the first to the last, gaps as 0."""
    counts = df.where(F.col(at).isNotNull()).groupBy(unit_of(unit, F.col(at)).alias(unit)).agg(F.count("*").alias("n"))
    return units(counts, unit).join(counts, unit, "left").select(unit, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rolling_mean(df: DataFrame, by: list[str], at: str, x: Column, days: int = 30) -> DataFrame:
    """df and the mean of x over (t - days, t], for each by; rows of one time have the same. Rows without a time have none, nor count.

    The difference of two running sums: up to t, and up to t - days, which a probe at that time reads,
    after all rows that stand there. Sums run within days, after the sums of the days before, so no task holds more than a day.
    """
    us, span = 86_400_000_000, days * 86_400_000_000
    t = df.select(*by, micros(F.col(at)).alias("__t"), x.cast("double").alias("__x")).where("__t is not null")
    seen = t.groupBy(*by, "__t").agg(F.coalesce(F.sum("__x"), F.lit(0.0)).alias("__s"), F.count("__x").alias("__n"))
    marks = seen.withColumn("__k", F.lit(0)).unionByName(seen.select(*by, (F.col("__t") - span).alias("__t"), F.lit(0.0).alias("__s"), F.lit(0).cast("bigint").alias("__n"), F.lit(1).alias("__k")))
    marks = marks.withColumn("__d", F.floor(F.col("__t") / us))
    daily = marks.groupBy(*by, "__d").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(*by, "__d", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    here = Window.partitionBy(*by, "__d").orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.withColumns({"__s": F.sum("__s").over(here), "__n": F.sum("__n").over(here)}).join(daily, [*by, "__d"])
    run = run.select(*by, (F.col("__t") + F.when(F.col("__k") == 1, span).otherwise(0)).alias("__t"), "__k", (F.col("__s") + F.col("__s0")).alias("__s"), (F.col("__n") + F.col("__n0")).alias("__n"))
    part = lambda c, k: F.max(F.when(F.col("__k") == k, F.col(c)))
    means = run.groupBy(*by, "__t").agg(F.try_divide(part("__s", 0) - part("__s", 1), part("__n", 0) - part("__n", 1)).alias("rolling"))
    return df.withColumn("__t", micros(F.col(at))).join(means, [*by, "__t"], "left").drop("__t")


def sampled(df: DataFrame, strata: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, by the MD5 of seed and key."""
    return first_rows(df, [strata], [F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), F.col(key)], n)


def confusion(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """TP, FP, TN, FN over rows where both are known, and the measures that follow; null where they divide by 0."""
    c = df.select(predicted.alias("p"), truth.alias("t")).where("p is not null and t is not null")
    c = c.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(~F.col("p") & ~F.col("t")).alias("tn"), F.count_if(~F.col("p") & F.col("t")).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    div = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select("tp", "fp", "tn", "fn", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(tn, tn + fp).alias("specificity"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def size_bucket_3(changes: Column) -> Column:
    return F.when(changes <= 10, "Small").when(changes <= 50, "Medium").otherwise("Large")


def is_merged(merged_at: Column) -> Column:
    """Whether the time of merging is there, and not blank."""
    return F.coalesce(F.trim(merged_at.cast("string")) != "", F.lit(False))


def first_chars(c: Column, n: int, default: str) -> Column:
    """The first n characters; default for null and empty texts."""
    return F.coalesce(F.nullif(F.left(c, F.lit(n)), F.lit("")), F.lit(default))


def behaviour(added: Column, removed: Column) -> Column:
    return F.when((added > 0) & (removed > 0), "Both").when(added > 0, "Only Adds").when(removed > 0, "Only Removes")


def resolution(added: Column, removed: Column) -> Column:
    return F.when(removed > added, "Improves").when(removed < added, "Reduces").otherwise("Neutral")


def quality_score(tests: Column, todo: Column, lint_off: Column, ignored: Column, untyped: Column, agreed: Column, confidence: Column) -> Column:
    """2 for tests, 1 for agreement, less 1 for to-dos and 2, 3, 2 for silenced linters, silenced checks and untyped values, plus the confidence."""
    worth = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    return worth(tests, 2) - worth(todo, 1) - worth(lint_off, 2) - worth(ignored, 3) - worth(untyped, 2) + worth(agreed, 1) + F.coalesce(confidence, F.lit(0.0))


def type_related(files: Column, false_positive: Column, counts: list[Column], keyword: Column, patch: Column, need_count: bool) -> Column:
    """Whether a change is about types: it has files, is no false positive, and a count above 0 and (need_count) or else or a hit in text or patch."""
    counted = F.greatest(*counts, F.lit(0)) > 0
    hit = keyword | patch
    return (files > 0) & ~false_positive & ((counted & hit) if need_count else (counted | hit))


def judged(classified: Column, validation: Column, error: Column) -> tuple[Column, Column]:
    """The final label (positive and approved) and the validation, which is ERROR, and the label false, after an error."""
    failed = F.coalesce(error, F.lit(False))
    return ~failed & F.coalesce(classified & (validation == "APPROVED"), F.lit(False)), F.when(failed, "ERROR").otherwise(F.coalesce(validation, F.lit("UNCERTAIN")))


def stored_means(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Means of columns that may hold numbers as text; what is no number counts as 0, and so does a column that isn't there."""
    x = lambda n: F.coalesce(F.expr(f"try_cast(`{n}` as double)"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    return df.groupBy(*by).agg(*[F.round(F.avg(x(n)), 6).alias(n) for n in names])


def histogram(df: DataFrame, by: str, x: str, most: int) -> DataFrame:
    """by, bin, n, density: whole numbers x in bins of one from 0 to the least of most and the greatest x of each by; the last bin holds its upper end, too, and none what lies beyond."""
    counts = df.groupBy(by, x).agg(F.count("*").alias("n"))
    tops = counts.groupBy(by).agg(F.max(x).alias("top"))
    last = tops.agg(F.least(F.min("top"), F.lit(most)).alias("last"), F.collect_set(by).alias("names"))
    bins = last.select(F.explode("names").alias(by), "last").select(by, "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("bin"))
    of = counts.join(last.select("last"), F.col(x) <= F.col("last") + 1).groupBy(by, F.least(x, "last").cast("bigint").alias("bin")).agg(F.sum("n").alias("n"))
    out = bins.drop("last").join(of, [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.round(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(by)).cast("double")), 6))


def weekdays(df: DataFrame, at: str) -> DataFrame:
    """weekday (0: Monday), n, share (in percent): all seven, days without rows as 0."""
    n = df.where(F.col(at).isNotNull()).groupBy(F.weekday(at).cast("bigint").alias("weekday")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(7).select(F.col("id").alias("weekday")).join(n, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))
    return every.withColumn("share", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(Window.partitionBy()).cast("double")), 6))
