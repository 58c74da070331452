"""Licence notices that no template spells, and the model's scores by hand."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patchlight.llm import licences

#: Family and notice; none is a template or stands in the training table.
UNSEEN = """gpl|Licensed under GPLv3.
gpl|SPDX-License-Identifier: GPL-2.0-only
mpl-2.0|Licensed under the Mozilla Public License 2.0.
cc-by-sa|Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.
mit|License: MIT
apache-2.0|The sources are available under the Apache 2.0 license.
gpl|This plug-in is distributed under the GNU GPL, version 2.
gpl|The game is released under the terms of the GPL v3 or any later version.
gpl|License: GPLv2
gpl|Our kernel module is licensed under the GNU General Public License.
gpl|All scripts here are covered by the GPL.
gpl|The editor is free and published under the GNU GPLv3.
agpl|The hosted service is licensed under the GNU AGPLv3.
agpl|License: AGPLv3
agpl|This dashboard is distributed under the AGPL, see COPYING.
agpl|Our back end is released under the terms of the GNU Affero General Public License v3.
lgpl|The parser is licensed under the LGPL.
lgpl|SPDX-License-Identifier: LGPL-2.1-or-later
lgpl|The bindings are distributed under the GNU LGPL version 3.
lgpl|Our codec is available under the terms of the GNU Lesser General Public License 2.1.
lgpl|License: LGPLv2
apache-2.0|The compiler is licensed under Apache 2.0.
apache-2.0|License: Apache License 2.0
apache-2.0|This client is released under the Apache License, v2.0.
apache-2.0|Published under the Apache 2 license by its authors.
apache-2.0|The SDK is offered under the terms of the Apache License version 2.0.
bsd|The allocator is licensed under a BSD license.
bsd|License: BSD-3-Clause
bsd|The driver is available under the two clause BSD licence.
bsd|Released under the 2-clause BSD license.
bsd|This shell is distributed under the terms of the revised BSD license.
mit|The theme is licensed under the MIT licence.
mit|The plugin is available under the terms of the MIT license.
mit|Distributed under the MIT License, see LICENSE.txt for more.
mit|This gem is released as open source under MIT; it is licensed under the MIT terms.
mit|The widget is offered under the MIT license.
isc|The tool is licensed under the ISC license.
isc|License: ISC, by its authors
isc|The daemon is available under the terms of the ISC licence.
isc|Released under the ISC license in 2020.
mpl-2.0|The extension is licensed under the MPL 2.0.
mpl-2.0|License: Mozilla Public License 2.0
mpl-2.0|Source files are available under the MPL, version 2.0.
mpl-2.0|The engine is distributed under the terms of the Mozilla Public License v2.0.
cc-by|The handbook is licensed under CC BY 4.0.
cc-by|The figures are available under a Creative Commons Attribution 4.0 licence.
cc-by|License: CC BY 3.0
cc-by|This lecture is shared under the Creative Commons Attribution 4.0 International licence.
cc-by-nc|The recordings are licensed under CC BY-NC 4.0.
cc-by-nc|The drawings are available under a Creative Commons Attribution-NonCommercial 4.0 licence.
cc-by-nc|License: CC BY-NC 3.0
cc-by-sa|The wiki is licensed under CC BY-SA 3.0.
cc-by-sa|License: CC BY-SA 4.0
cc-by-sa|The atlas is published under a Creative Commons Attribution-ShareAlike 4.0 licence.
cc0|The table is available under CC0 1.0.
cc0|License: CC0
cc0|The word list is published under Creative Commons Zero.""".split("\n")
#: What speaks of the same things and grants nothing.
PLAIN = """She took her degree at MIT and later taught there.
The Apache people lived in the south west.
A driving licence is issued by the town hall.
The bus is available on working days under the bridge.
GPL prices rose by two percent, the gas company said.
The general public is invited to the opening.
The Mozilla foundation published its yearly report.
This recipe was shared by my aunt.
His plan was released under pressure from the press.
The song was distributed by a small label in the south.
An ISC meeting was held on Monday.
The book is available in every library of the county.
Creative people in common rooms drew maps.
Not licensed under the GPL.
The code was never released under the MIT license.""".split("\n")


def test_notices_that_no_template_spells(spark):
    texts = {t for ts in [*licences.TEMPLATES.values(), *licences.NOTICES.values()] for t in ts}
    rows = [tuple(x.split("|")) for x in UNSEEN] + [("", t) for t in PLAIN]
    assert not texts & {t for _, t in rows} and len(UNSEEN) >= 57
    walk = "A free walk by the river was open to all of them in spring.\nThe museum shows the new road in all weathers.\n"
    docs = spark.createDataFrame([(k, walk + t + "\n" + walk) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.families for x in licences.scan(docs).collect()}
    wrong = [(t, got[k]) for k, (f, t) in enumerate(rows) if got[k] != f]
    assert not [w for w in wrong if w[0] in PLAIN], wrong
    assert len(wrong) <= 0.05 * len(UNSEEN), wrong


def test_clashing_columns_stay_out_of_the_way(spark):
    names = ["id", "row", "n", "t", "w", "g", "x", "p", "raw", "best", "block", "line", "s", "family", "sure", "h", "paragraph", "lines", "score", "families"]
    docs = spark.createDataFrame([(1, "Released under the MIT License.\nA walk."), (None, "License: ISC"), (3, None)], "doc_id long, text string").withColumns({n: F.lit("mine") for n in names})
    assert sorted((str(r.doc_id), r.n_paragraphs, r.families) for r in licences.scan(docs).collect()) == [("1", 2, "mit"), ("3", 0, ""), ("None", 1, "isc")]


def test_scores_by_hand(spark):
    """The probabilities of a paragraph, from the fitted weights and its words and runs of two, summed up one by one."""
    docs = spark.createDataFrame([(k, f"A walk of {k} miles.\nThe river was open.") for k in range(30)], "doc_id long, text string")
    model = licences.train(docs)
    vocabulary, lr = {g: i for i, g in enumerate(model.stages[0].vocabulary)}, model.stages[1]
    for text in ("Licensed under the MIT License.", "A walk of 3 miles.", "", "License: GPL-2.0 or the Mozilla one"):
        df = spark.createDataFrame([(text,)], "t string").select(licences.words(F.col("t")).alias("w")).withColumn("g", licences.grams(F.col("w")))
        got = model.transform(df).select(vector_to_array("p").alias("p")).first().p
        w = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        found = {vocabulary[g] for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] if g in vocabulary} | ({vocabulary[w[-1]]} if w and w[-1] in vocabulary else set())
        z = [lr.interceptVector[c] + sum(lr.coefficientMatrix[c, j] for j in found) for c in range(lr.numClasses)]
        e = [math.exp(v - max(z)) for v in z]
        assert got == pytest.approx([v / sum(e) for v in e], abs=1e-9)
