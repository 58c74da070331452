"""Licence scans: logistic regression on word n-grams names the licence family of paragraphs, and templates confirm it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm.common import ASCII_LOWER, ASCII_UPPER, materialise

UNKNOWN = "unknown"
#: Notices by family, in usual words.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "SPDX-License-Identifier: MIT", "Licensed under the MIT License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "reserved": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Other wordings of notices by family, for training only: in them names stand as people write them.
NOTICES = {
    "agpl": ["Licensed under AGPLv3.", "License: AGPL-3.0", "Distributed under the terms of the AGPL.", "This server is available under the GNU AGPL v3.", "Released under the Affero GPL, version 3 or later.", "Code is covered by the GNU Affero GPL."],
    "apache-2.0": ["Available under the Apache 2.0 license.", "License: Apache-2.0", "This library is distributed under the Apache License v2.", "Released under the Apache 2 licence.", "Apache License 2.0, see LICENSE.", "Published under the terms of the Apache Software License 2.0."],
    "bsd": ["Licensed under the 3-clause BSD license.", "License: BSD-2-Clause", "Distributed under a modified BSD licence.", "Code is available under the New BSD License.", "Released under the simplified BSD license.", "This module is provided under BSD terms."],
    "cc-by": ["Text is available under CC-BY 4.0.", "License: CC-BY-4.0", "Published under the Creative Commons Attribution licence.", "Shared under a Creative Commons Attribution 3.0 licence.", "This article is distributed under CC BY 3.0.", "Content licensed as CC BY."],
    "cc-by-nc": ["Text is available under CC-BY-NC.", "License: CC-BY-NC-4.0", "Published under the Creative Commons Attribution Non-Commercial licence.", "Shared under CC BY-NC 3.0.", "These slides are distributed under a Creative Commons Attribution-NonCommercial 3.0 licence.", "Photographs licensed as CC BY-NC."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike licence.", "License: CC-BY-SA-4.0", "Content is available under CC BY-SA 3.0 unless otherwise noted.", "Published under the Creative Commons Attribution Share-Alike 3.0 licence.", "Shared under CC-BY-SA.", "These maps are licensed as CC BY-SA."],
    "cc0": ["License: CC0-1.0", "Available under CC0.", "This data set is published under the Creative Commons Zero licence.", "Distributed under Creative Commons CC0.", "Shared as CC0 1.0 Universal.", "The files are offered under CC0."],
    "gpl": ["Licensed under GPLv2 or later.", "License: GPL-3.0-or-later", "Distributed under the terms of the GPL.", "This tool is released under the GNU GPL v3.", "Code is available under the General Public License of GNU, version 2.", "Covered by the GNU GPL, version 2 only.", "Our tools are GPLv3 software.", "GPLv2, see COPYING."],
    "isc": ["License: ISC", "Available under the ISC licence.", "This package is distributed under the ISC license.", "Licensed under the terms of the ISC license.", "Code is provided under ISC.", "Published under the ISC License, see below."],
    "lgpl": ["Licensed under LGPLv3.", "License: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "Distributed under the terms of the LGPL.", "This library is available under the GNU LGPL v2.1.", "Released under the Lesser GPL, version 3.", "These modules are LGPLv2 code."],
    "mit": ["License: MIT (see file)", "Code is available under the MIT licence.", "Distributed under the terms of the MIT license.", "This project is MIT licensed.", "Licensed under MIT.", "Published under the MIT/X11 license."],
    "mpl-2.0": ["Licensed under MPL 2.0.", "License: MPL-2.0", "Distributed under the Mozilla Public License, version 2.", "Code is available under the terms of the MPLv2.", "Released under the Mozilla Public Licence 2.0.", "This add-on is covered by the MPL 2."],
}
#: How a family's name is spelt, as words in lower case (the names of families that go on from it are told apart by what follows).
NAMES = {
    "agpl": r"(?:gnu )?(?:agpl|affero)(?:v?[0-9])?\b", "apache-2.0": r"(?:apache|asl)(?: software)?(?: license| licence)?(?: version)?(?: v)? ?v?2\b", "bsd": r"(?:[0-9a-z]+ clause |new |modified |simplified |revised |original )?bsd\b",
    "cc-by": r"(?:cc by|creative commons attribution)(?! (?:nc|sa|nd|non|noncommercial|share|sharealike|no|noderiv\w*)\b)", "cc-by-nc": r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:sa|nd|share|sharealike|no|noderiv\w*)\b)",
    "cc-by-sa": r"(?:cc by sa|creative commons attribution share ?alike)\b", "cc0": r"(?:creative commons )?(?:cc0|creative commons zero)\b", "gpl": r"(?:gnu )?(?:gplv?[123]?\b|general public licen[cs]e\b)", "isc": r"isc\b",
    "lgpl": r"(?:gnu )?(?:lgplv?[23]?\b|(?:lesser|library) (?:gpl|general public licen[cs]e)\b)", "mit": r"(?:mit|expat)\b", "mpl-2.0": r"(?:mozilla public licen[cs]e|mpl)(?: version)?(?: v)? ?v?2\b",
}
_FILL = r"(?: (?:the|a|an|both|either|terms|conditions|provisions|version|of|and|its|own|standard|permissive|open|source|free))*"
#: What makes a name a notice: words of licensing before it, or "license" at the paragraph's beginning, or "... licensed" after it.
SAID = (r" (?:licen[cs]ed|released|distributed|redistributed|published|provided|available|offered|shared|covered|governed|issued|licensing) (?:under|by|as|with)" + _FILL + " ", r"\A licen[cs]e(?: type| is)?(?: the)? ", r" spdx license identifier ")
#: Families whose notices hold much of each other's: where another one's template is met better, a family isn't confirmed.
RIVALS = [["agpl", "gpl", "lgpl"], ["cc-by", "cc-by-nc", "cc-by-sa"], ["isc", "mit"]]
#: Runs of two words by which a line says that it is no notice.
DENIED = ["not licensed", "not released", "not under", "not distributed", "not available", "never licensed", "never released", "isn t", "longer licensed", "longer under"]
#: What may stand around a notice.
AROUND = [("", ""), ("Copyright (c) 2021 The Authors. ", ""), ("", " See the file for details."), ("Notice: ", " The authors."), ("This project and its documents: ", " Thank you for reading."), ("// ", " //")]
#: Paragraphs that speak of like things and are no notices.
OTHERS = ["The museum opens at nine and closes at five in all weathers.", "He got a driving license in May.", "She studied at MIT before she moved to the coast.", "The general public was free to visit the garden.", "Please read the terms of the meeting before you vote.", "The foundation published a free guide to birds.", "An Apache helicopter flew over the village.", "This work was done by hand in the winter months.", "The following conditions were hard for all of them.", "Version 2 of the map shows the new road.", "The source of the river lies in the hills.", "All of the rights and wrongs were told again.", "Permission to enter was given by the owner.", "It is released in spring and sold in autumn.", "The file was found under a pile of papers.", "You may not use the lift when there is a fire.", "The library lends books under these rules.", "A copy of the letter is in the archive.", "This text is not licensed under the MIT License.", "It was never released under the GNU General Public License.", "The map is not available under the Apache License."]
#: The paragraphs of half of so many documents, about, teach the unknown class.
SAMPLE_DOCS = 600
#: Least share of a template's runs of two words that a paragraph must hold to confirm its family.
CONFIRMED = 0.6
#: A paragraph with such a part of a template's runs of two words (two at least), or with a run that has one of these words, isn't an unknown one.
SHARED = 0.15
MARKS = ["bsd", "cc", "cc0", "creative", "gnu", "hereby", "license", "licensed", "mozilla", "mpl", "redistribute", "redistribution", "reserved", "spdx"]
#: A paragraph of at least this probability of a family that names a licence isn't an unknown one either (less likely ones don't move the threshold).
NEAR = 0.3
#: So large a part of all unknown paragraphs has to stay below the threshold.
STRICT = 0.9995
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that stand in any text.
COMMON = {"a", "all", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"}
#: A line feed, lines without words, and a line feed: what lies between blocks of lines.
BREAK = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
#: Words of a span of a block, and from one span to the next: runs of SPAN - STEP + 1 words, more than any template has, lie in one span.
SPAN, STEP = 64, 16


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.translate(paragraph, ASCII_UPPER, ASCII_LOWER), SEPARATORS), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Runs of two words."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def grams(w: Column) -> Column:
    """Words and runs of two (the last word stands in both)."""
    return F.concat(w, pairs(w))


def lines(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(text, r"\r?\n"), lambda p: F.trim(p) != "")


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line of a text that isn't blank (one with a null paragraph for other texts), as words w; the text goes."""
    out = docs.withColumn("paragraph", F.explode_outer(lines(F.col(text)))).drop(text)
    return out.withColumn("w", F.coalesce(words(F.col("paragraph")), F.array().cast("array<string>")))


def _trimmed(span: Column) -> Column:
    """A span from two words before (which may deny it) the first to the last run of two words, not both common ones, that a template has, so that what stands around a notice doesn't count."""
    every = sorted({x for ts in TEMPLATES.values() for t in ts for x in runs(t) if not set(x.split()) <= COMMON})
    at = F.filter(F.transform(pairs(span), lambda p, i: F.when(p.isin(every), i + 1)), lambda i: i.isNotNull())
    first = F.greatest(F.array_min(at) - 2, F.lit(1))
    return F.when(F.size(at) > 0, F.slice(span, first, F.array_max(at) - first + 2)).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (block, line, w) of a text, which goes: each line (line is true) and the spans of blocks that may hold a notice wrapped over lines.

    Blocks are runs of lines with words. Those of two lines at least that hold a template's runs of two words, wherever
    they stand, are cut into overlapping spans. A text without any gives one row, with no words.
    """
    out = docs.select("*", F.posexplode_outer(F.split(F.col(text), BREAK)).alias("block", "b")).drop(text)
    out = out.withColumns({"lines": lines(F.col("b")), "bw": words(F.col("b"))})
    starts = F.sequence(F.lit(1), F.greatest(F.size("bw") - SPAN + STEP, F.lit(1)), F.lit(STEP))
    spans = F.when((F.size("lines") > 1) & holds_any(F.col("bw")), F.transform(starts, lambda i: _trimmed(F.slice(F.col("bw"), i, SPAN))))
    none = F.array().cast("array<struct<line:boolean,w:array<string>>>")
    rows = F.concat(
        F.coalesce(F.transform("lines", lambda p: F.struct(F.lit(True).alias("line"), words(p).alias("w"))), none),
        F.coalesce(F.transform(spans, lambda w: F.struct(F.lit(False).alias("line"), w.alias("w"))), none),
    )
    out = out.withColumn("c", F.explode_outer(rows)).drop("lines", "bw", "b")
    return out.withColumns({"line": F.col("c.line"), "w": F.coalesce("c.w", F.array().cast("array<string>"))}).drop("c")


def _table(spark: SparkSession) -> DataFrame:
    rows = [(a + t + b, f) for f, ts in TEMPLATES.items() for t in ts for a, b in AROUND] + [(a + t + b, f) for f, ts in NOTICES.items() for t in ts for a, b in AROUND[:3]] + [(a + t + b, UNKNOWN) for t in OTHERS for a, b in AROUND]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', '{f}')" for p, f in rows) + " AS t(paragraph, family)").withColumn("w", words(F.col("paragraph")))


def _classes() -> list[str]:
    return sorted([*TEMPLATES, UNKNOWN])


def runs(t: str) -> list[str]:
    """The distinct runs of two words of a template."""
    v = "".join(c if c.isalnum() else " " for c in t.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(v, v[1:])})


def _in_templates(w: Column, test) -> Column:
    """Whether, of the runs of two words that the words share with templates, test(runs, those of a template) is true for one."""
    every = [runs(t) for ts in TEMPLATES.values() for t in ts]
    known = sorted({x for r in every for x in r})
    found = F.filter(pairs(w), lambda p: p.isin(known))  # looked up in a set that is made once, not for each row
    return F.exists(F.array(found), lambda f: (F.size(f) > 0) & reduce(lambda a, b: a | b, [test(f, r) for r in every]))


def _shared(found: Column, r: list[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*map(F.lit, r))))


def holds_any(w: Column) -> Column:
    """Whether the words hold CONFIRMED of the runs of two of any template."""
    return _in_templates(w, lambda f, r: _shared(f, r) >= CONFIRMED * len(r))


def speaks_of_any(w: Column) -> Column:
    """Whether the words share SHARED of the runs of two of any template, or one with a word of MARKS."""
    def test(f: Column, r: list[str]) -> Column:
        marked = [x for x in r if set(x.split()) & set(MARKS)]
        some = _shared(f, r) >= max(2, SHARED * len(r))
        return some | F.arrays_overlap(f, F.array(*map(F.lit, marked))) if marked else some

    return _in_templates(w, test)


def confirmed(w: Column, family: Column) -> Column:
    """Whether the words name the family's licence as theirs, or hold CONFIRMED of the runs of two of one of its templates and no less of them than of a rival's; and deny nothing."""
    def held(f: str) -> Column:
        shares = [F.size(F.array_intersect(pairs(w), F.array(*map(F.lit, runs(t))))) / F.lit(float(len(runs(t)))) for t in TEMPLATES[f]]
        return F.greatest(*shares, F.lit(0.0))

    def sure(f: str) -> Column:
        rivals = [r for group in RIVALS if f in group for r in group if r != f]
        enough = held(f) >= CONFIRMED
        return enough & (held(f) >= F.greatest(*map(held, rivals), F.lit(0.0))) if rivals else enough

    denied = F.arrays_overlap(pairs(w), F.array(*map(F.lit, DENIED)))
    return ~denied & (named(w, family) | reduce(lambda x, f: F.when(family == f, sure(f)).otherwise(x), TEMPLATES, F.lit(False)))


def _padded(w: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))


def named(w: Column, family: Column | None = None) -> Column:
    """Whether the words say that something is under the family's licence, by its name (of any family, without one)."""
    before = "(?:" + "|".join(SAID) + ")"
    if family is None:
        return _padded(w).rlike(before + "(?:" + "|".join(NAMES.values()) + ")")
    found = F.lit(False)
    for f, name in NAMES.items():
        after = r"| (?:" + name + r") licen[cs]ed " if f in ("mit", "bsd", "isc") else ""
        found = F.when(family == f, _padded(w).rlike(before + "(?:" + name + ")" + after)).otherwise(found)
    return found


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> PipelineModel:
    """The model: fitted on the templates and other notices in several surroundings, on other paragraphs, and on those of a sample of documents.

    The sample is chosen by the hash of keys and texts; paragraphs that speak of licences as templates do aren't taken for unknown ones.
    """
    spark, n = docs.sparkSession, docs.count()
    # by key and text: rows of one key, or without one, don't come together
    row = F.concat(F.lit("licence/"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.xxhash64(F.col(text)).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rate = min(1.0, SAMPLE_DOCS / max(n, 1))
    sample = paragraphs(docs.select(draw.alias("d"), F.col(text).alias("t")).where(F.col("d") < rate / 2), "t")
    sample = sample.where((F.size("w") > 0) & ~speaks_of_any(F.col("w")) & ~named(F.col("w"))).select("w").distinct()
    classes = F.array(*map(F.lit, _classes()))
    rows = _table(spark).select("w", "family").unionByName(sample.select("w", F.lit(UNKNOWN).alias("family")))
    rows = rows.select(grams(F.col("w")).alias("g"), (F.array_position(classes, F.col("family")) - 1).cast("double").alias("y"))
    vocabulary = CountVectorizer(inputCol="g", outputCol="x", binary=True, minDF=1, vocabSize=1 << 14).fit(_table(spark).select(grams(F.col("w")).alias("g")))
    lr = LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="p", rawPredictionCol="raw", predictionCol="best", family="multinomial", regParam=2e-5, elasticNetParam=0.5, maxIter=60)
    return PipelineModel([vocabulary, lr.fit(vocabulary.transform(rows).coalesce(4))])


def threshold(judged: DataFrame) -> float:
    """The least probability of a family: what STRICT of all distinct unknown paragraphs (h, s) stay below, 0.5 at least. Rows without h aren't such."""
    level = judged.where("h is not null").groupBy("h").agg(F.max("s").alias("s")).agg(F.percentile_approx("s", STRICT, 100000)).first()[0]
    return max(0.5, level or 0.0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: its key, n_paragraphs, n_notices, n_unsure, families.

    A paragraph is a line that isn't blank. Its family is the likeliest one, if all families together are likelier than 'unknown',
    reach the threshold that all documents' unknown paragraphs set, and a template or the licence's name confirms it: then it is a notice. Spans of lines (see candidates) are
    judged alike: a block of lines has one notice for each family that its spans and none of its lines give. n_unsure
    counts lines of a family that no template confirms and that their block has no notice of. families: those of the
    notices, sorted, joined by commas; '' for none. Null and blank texts have no paragraphs; repeated rows get a row
    each, null keys too; other columns don't matter; an empty table stays empty.
    """
    model = train(docs, key, text)
    n = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines(F.col(text)))), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), n.alias("n"), F.col(text).alias("t"))
    judged = model.transform(candidates(rows, "t").withColumn("g", grams(F.col("w"))))
    unknown = _classes().index(UNKNOWN)
    families = F.zip_with("p", F.array(*map(F.lit, _classes())), lambda p, f: F.struct(p.alias("p"), f.alias("f")))
    family = F.array_max(F.filter(families, lambda x: x["f"] != UNKNOWN))["f"]
    some = F.size("w") > 0
    # exploded, so that the model's functions run once a row, however many columns use what they give
    judged = judged.select("id", "row", "n", "block", "line", "w", F.explode(F.array(vector_to_array("p"))).alias("p")).withColumn("s", 1 - F.get("p", F.lit(unknown)))
    judged = judged.withColumn("family", F.when((F.col("s") > 0.5) & some, family)).drop("p")
    judged = judged.withColumns({
        "sure": F.when(F.col("family").isNotNull(), confirmed(F.col("w"), F.col("family"))),
        "h": F.when(F.col("line") & some & ~speaks_of_any(F.col("w")) & ~((F.col("s") > NEAR) & named(F.col("w"))), F.xxhash64("w")),
    })
    judged = materialise(judged.drop("w"), "licences-judged")
    judged = judged.withColumn("sure", F.when(F.col("s") >= threshold(judged), F.col("sure")))
    at, sure, line = F.struct("block", "family"), F.col("sure"), F.col("line")
    per_row = judged.groupBy("row").agg(
        F.first("id").alias(key), F.first("n").alias("n_paragraphs"), F.count_if(sure & line).alias("in_lines"), F.collect_set(F.when(sure & line, at)).alias("lines"),
        F.collect_set(F.when(sure & ~line, at)).alias("spans"), F.collect_list(F.when(~sure & line, at)).alias("unsure"),
    )
    return per_row.select(
        key, "n_paragraphs", (F.col("in_lines") + F.size(F.array_except("spans", "lines"))).alias("n_notices"),
        F.size(F.filter("unsure", lambda x: ~F.array_contains(F.col("spans"), x))).cast("bigint").alias("n_unsure"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.array_union("lines", "spans"), lambda x: x["family"]))), ",").alias("families"),
    )
