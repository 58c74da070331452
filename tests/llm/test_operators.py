"""The corpus operators against brute force, SQL, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.llm import chat, decontamination, language, licences, mixing, neardup, quality, queries, sharding, urls, vectors
from patchlight.llm.common import components
from patchlight.llm.tokens import word_hashes

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words here and there", None, "s", 1), (4, "!!! 123 ...", "de", "t", 9),
    (5, "word " * 30000, "en", "t", 1), (6, "x" * 300000, None, None, 1), (7, "tie one two three four five", "fr", "s", 1), (8, "tie one two three four five", "fr", "u", 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, EMPTY).withColumn("score", F.lit("mine")).withColumn("shard_note", F.lit(1))


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


# 1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(r) > 20 and sum(x.lang == x.lang_pred for x in r) / len(r) > 0.95
    assert all((zlib.crc32(str(x.doc_id).encode()) % 4 == 2) == x.held_out and 0 <= x.score <= 1 for x in r)


def test_language_odd_rows(spark):
    r = language.identify(odd(spark)).collect()
    assert len(r) == len(ODD)
    assert {x.doc_id for x in r if x.lang_pred == "und"} == {1, 2, 4}
    assert language.identify(spark.createDataFrame([], EMPTY)).collect() == []
    assert {x.doc_id for x in language.accepted(odd(spark)).collect()} <= {None, 5, 6, 7, 8}


def test_language_of_dirty_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    monkeypatch.setattr(language, "FIT_TOTAL", 60)
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 3, "de" if i % 2 else "en", None, 0) for i in range(200)]
    rows += [(1000 + i, "the dog und die cat", f"typo{i}", None, 0) for i in range(40)]
    r = language.identify(spark.createDataFrame(rows, EMPTY)).collect()
    assert len(r) == len(rows) and {x.lang_pred for x in r} == {"de", "en"}
    assert all(x.lang_pred == x.lang for x in r if x.doc_id < 1000)


def test_temperature_prefers_the_likelier():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=language._softmax(v)) for v in z])
    assert 2.5 < language.temperature(z * 3, y) < 3.6


# 2


def test_chat_events_fold(spark):
    rows = [
        ("c", 1, "message", None, "user", "hi"), ("c", 2, "message", None, "assistant", "a"), ("c", 3, "delta", None, None, "b"), ("c", 4, "regenerate", 2, None, "new"),
        ("c", 5, "delta", 2, None, "er </turn> \\"), ("c", 6, "edit", 1, None, "hello"), ("c", 7, "message", None, "user", None), ("c", 8, "delete", 7, None, None), ("d", 1, "delta", None, None, "lost"),
    ]
    log = spark.createDataFrame(rows, "conv_id string, seq long, kind string, target long, role string, text string")
    m = chat.fold(log)
    assert [tuple(r) for r in m.orderBy("seq").select("conv_id", "role", "text").collect()] == [("c", "user", "hello"), ("c", "assistant", "newer </turn> \\")]
    r = chat.render(m).select(chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in r.t] == [("user", "hello"), ("assistant", "newer </turn> \\")] and r.l == "newer </turn> \\"
    assert chat.render(chat.fold(log.where("false"))).collect() == []


# 3


def test_mix_takes_near_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60), "abcdefg")), None, ["a", "b", "c", None][min(3, int(rng.random() ** 2 * 4))], 0) for i in range(400)]
    r = mixing.digest(mixing.mix(spark.createDataFrame(rows, EMPTY), block_words=16)).collect()
    text = {i: t for i, t, *_ in rows}
    taken, target = defaultdict(int), {}
    of = {i: s for i, _, _, s, _ in rows}
    for x in r:
        assert x.size == len(text[x.doc_id].split()) and 0 <= x.taken <= 3 * x.size
        taken[of[x.doc_id]] += x.taken
        target[of[x.doc_id]] = x.target
    assert len(r) == 400 and all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.digest(mixing.mix(spark.createDataFrame([], EMPTY))).collect() == []
    assert len(mixing.digest(mixing.mix(odd(spark))).collect()) == len(ODD)


# 4


def weighted_classes(rows):
    texts = sorted({t for _, t in rows if t is not None})
    sketch, n = np.zeros((2, neardup.COUNTERS), np.int64), sum(t is not None for _, t in rows)
    for _, t in rows:
        if t is not None:
            for row, at in zip(sketch, neardup._cells(neardup.shingles(t, 5)[0])):
                row += np.bincount(at, minlength=neardup.COUNTERS)
    idf = neardup.idf_of(sketch, n)
    weights = {t: dict(zip(*map(list, neardup.weigh(t, idf)))) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            wa, wb = weights[a], weights[b]
            low = sum(min(w, wb[h]) for h, w in wa.items() if h in wb)
            if low and low / (sum(wa.values()) + sum(wb.values()) - low) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if t is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    return {(i, t): i if t is None else least[find(t)] for i, t in rows}


def test_neardup_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 8)  # so that buckets are cut
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    base = words(rng, 120, vocabulary)
    rows = [(i, " ".join(base)) for i in range(5)]
    for i in range(5, 70):  # one wide group of near copies
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(words(rng, 60, vocabulary))) for i in range(70, 100)]
    rows += [(100, None), (101, ""), (102, ""), (103, "one two"), (104, "One, two!"), (104, "One, two!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0))
    r = neardup.classes(docs).collect()
    want = weighted_classes(rows)
    assert Counter((x.doc_id, x.text, x.class_id) for x in r) == Counter((i, t, want[i, t]) for i, t in rows)
    by_class = Counter(x.class_id for x in r if x.kept)
    assert set(by_class.values()) == {1} and set(by_class) == set(want.values())
    assert sorted(x.doc_id for x in neardup.deduplicated(docs).collect()) == sorted(by_class)


def test_neardup_odd_rows(spark):
    r = neardup.classes(odd(spark)).collect()
    assert len(r) == len(ODD) and {x.doc_id: x.class_id for x in r}[8] == 7 and sum(x.kept for x in r if x.doc_id == 2) == 1
    assert neardup.classes(spark.createDataFrame([], EMPTY)).collect() == []


def test_neardup_weights_follow_from_parts_of_the_texts():
    rng = np.random.default_rng(4)
    found = []
    for n in (50_000, 50_000_000):  # texts of 300 shingles
        sketch = rng.poisson(300 * n / neardup.COUNTERS, (2, neardup.COUNTERS))
        sketch[:, :4] += np.array([n, n // 3, n // 50, 1])
        idf = neardup.idf_of(sketch, n)
        assert (idf[:, 3:] == 1.5).all() and (np.diff(idf[:, :4], axis=1) > 0.05).all()
        found.append(idf[:, :4])
    assert np.allclose(found[0], found[1], atol=0.002)
    assert (neardup.idf_of(np.zeros((2, neardup.COUNTERS), np.int64), 0) == 1.5).all()


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(3)
    same = n = 0
    for _ in range(150):
        h = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.uniform(1, 3, 60), rng.uniform(1, 3, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same += (neardup.samples(h, a) == neardup.samples(h, b)).mean() - want
        n += 1
    assert abs(same / n) < 0.02


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# 5


@pytest.mark.parametrize("chunk, short", [(8, 4), (512, 24)])
def test_vectors_against_all_pairs(spark, monkeypatch, chunk, short):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "SHORT", short)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + rng.normal(size=16) * 0.18).astype(np.float32).tolist(), c % 2) for i in range(25)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], None), (203, None, 0), (204, [], 0), (205, [0.0] * 16, 0), (206, [float("nan")] * 16, 0), (207, [None] * 16, 0), (208, rows[0][1][:8], 0), (209, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in vectors.links(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert got == set(con.execute(vectors.ORACLE_SQL).fetchall())
    assert vectors.links(df.where("false")).collect() == []


def test_vectors_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, [2e300, 4e300, 6e300], 1), (3, [1e-300, 2e-300, 3e-300], 1), (4, [float("inf"), 1.0, 1.0], 1), (5, v, None), (6, [-x for x in v], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit("mine"), "cell": F.lit(1), "kept": F.lit(2)})
    got = Counter(tuple(r) for r in vectors.links(df).collect())
    assert got == Counter({(1, 4, 1, True): 2, (None, 4, 1, False): 1, (2, 4, 1, False): 1, (3, 4, 1, False): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1})


def test_vectors_recall_and_strangers():
    """At each size nearly all pairs of cosine 0.98 share a bucket, and few unrelated ones."""
    rng = np.random.default_rng(1)
    for n in (10, 5000, 10**7):
        tables, projections = shape = vectors.shape_for(n)
        x = rng.normal(size=(1500, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(1500, 64))
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = vectors.keys(x, shape), vectors.keys(y, shape)
        assert (a == b).any(1).mean() >= 0.998
        assert (a == np.roll(a, 1, 0)).mean() * n <= 0.2
    assert vectors.shape_for(10**9)[0] < 4 * vectors.shape_for(10**5)[0]


# 6


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    r = sharding.shard(odd(spark)).collect()
    assert len(r) == len(ODD) and all(x.grown_shard in (x.shard, 8) for x in r)
    slots = defaultdict(list)
    for x in sharding.shard(spark.createDataFrame([(i, str(i), None, None, 0) for i in range(500)], EMPTY)).collect():
        slots[x.shard].append(x.slot)
    assert len(slots) == 8 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(spark.createDataFrame([], EMPTY)).collect() == []


# 7


def test_licences_found_and_confirmed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"gpl": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0", "mit": "the MIT License", "apache-2.0": "Apache License, Version 2.0", "reserved": "All rights reserved."}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.families for r in queries.op7_licence_scans(spark, SF).collect()}
    assert got == {i: ",".join(sorted(f for f, s in lines.items() if s in t)) for i, t in text.items()} and any(got.values())


def test_licences_odd_rows(spark):
    extra = spark.createDataFrame([(50, "A free walk.\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en", "s", 1)], EMPTY)
    r = {x.doc_id: x for x in licences.scan(odd(spark).drop("score", "shard_note").unionByName(extra)).collect()}
    assert (r[50].n_paragraphs, r[50].n_notices, r[50].families) == (3, 2, "cc-by-nc,mit")
    assert (r[1].n_paragraphs, r[2].n_paragraphs, r[6].families) == (0, 0, "")
    assert licences.scan(spark.createDataFrame([], EMPTY)).collect() == []


WRAPPED = {
    "mit": ["MIT License", "", "Copyright (c) 2021 The Authors", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy', 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"],
    "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"],
    "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
}


def test_licences_wrapped_over_lines(spark):
    walk = ["A free walk by the river was open to all of them.", "The museum shows the new road in all weathers."] * 30
    rows = [(k, "\n".join(v), f) for k, (f, v) in enumerate((f, x) for f, v in WRAPPED.items() for x in (v, [f" * {y}".rstrip() for y in v], [*walk, *v, *walk], ["\r".join(["A walk.", ""]), "", *v]))]
    rows += [(100, "\n".join(walk), "")]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    got = {x.doc_id: x for x in licences.scan(docs).collect()}
    assert {k: got[k].families for k, _, _ in rows} == {k: f for k, _, f in rows}
    assert all(got[k].n_notices == bool(f) and got[k].n_paragraphs == sum(x.strip() != "" for x in t.split("\n")) for k, t, f in rows)


def test_licences_told_apart(spark):
    rows = [
        ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or\nwithout fee is hereby granted, provided that the above copyright notice and this\npermission notice appear in all copies."),
        ("", "Not licensed under the MIT License."), ("", "It was never released under the GNU General Public License, version 2."), ("mit", "Released under the MIT License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
    ]
    got = {x.doc_id: x.families for x in licences.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == {k: f for k, (f, _) in enumerate(rows)}


def test_licences_threshold_covers_all_documents(spark, monkeypatch):
    walk = [(k, f"A walk of {k} miles by the river was open to all of them.") for k in range(900)]
    second = [k for k in range(2000, 2100) if int(hashlib.md5(f"licence/{k}".encode()).hexdigest()[:8], 16) >= 1 << 31]
    reworded = [(k, "SPDX: GNU General Public License, Mozilla Public License, MIT License, BSD License, Creative Commons: see what the license file says.") for k in second[:3]]
    real = [(3000 + k, f"He read this work in the {w} of the village, and the museum of the file: released under the MIT License.") for k, w in enumerate(["letters", "maps", "songs", "books", "library"])]
    seen, level = [], licences.threshold
    monkeypatch.setattr(licences, "threshold", lambda judged: seen.append({r.id for r in judged.where("h is not null").collect()}) or level(judged))
    got = {x.doc_id: x.families for x in licences.scan(spark.createDataFrame(walk + reworded + real, "doc_id long, text string")).collect()}
    assert {k: f for k, f in got.items() if f} == {k: "mit" for k, _ in real}
    assert seen == [{k for k, _ in walk}]  # no sample of them, and none that speaks of licences


def test_licences_threshold_of_all_paragraphs(spark):
    scores = spark.createDataFrame([(k, k / 10000) for k in range(10000)] * 2 + [(None, 1.0)] * 5000, "h long, s double")
    assert 0.9993 < licences.threshold(scores) < 0.9997


# 8


def test_url_rules(spark):
    rows = ["https://a.example.NET/en/1", "https://example.net/de", "http://badnet/", "https://x.example.com/de/3?q", "https://example.com/en", "https://a.org/fr/1", None, "no scheme", "x://h#frag"]
    r = [tuple(x) for x in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert [x[2] for x in r] == ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None, None, None]
    assert r[0][0] == "a.example.net" and r[6][:2] == ("", "") and r[8][:2] == ("h", "") and r[0][3] == "allow" and r[1][3] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


SPAM = "gambling-hub.com mega-jackpot.io getrichquick.biz porn-tube.xyz roulette-king.co hot-singles.com bestloans.biz cryptobonus.io superslots.net casinolux.de viagra-24.info xxx-cams.org lotterywinner.fr fakewatches-discount.com sexydates.co.uk".split()
PLAIN = "shop.bbc.co.uk spiegel.de stadtbibliothek.de nytimes.com wikipedia.org oxford-press.org www.lemonde.fr monde-diplomatique.fr elpais.com windsor.co.uk moneta.fr gov.uk botany.io quarterly-review.org allotment.info parliament.uk kitchenware.de railways.co.uk".split()


def test_urls_of_hosts_never_seen(spark):
    known = {r.h for r in urls.labelled(spark).select(urls.host(F.col("url")).alias("h")).collect()}
    pages = {urls_ for (urls_,) in duckdb.sql("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()}
    assert not known & {*SPAM, *PLAIN} and not known & pages
    r = urls.judge(spark.createDataFrame([(i, f"https://{h}/en/{i}") for i, h in enumerate(SPAM + PLAIN)], "page_id long, url string"), {}).collect()
    right = [(x.verdict == "block") == (x.page_id < len(SPAM)) for x in r]
    assert sum(right) / len(right) >= 0.9, [(x.host, round(x.score, 2)) for x in r if (x.verdict == "block") != (x.page_id < len(SPAM))]
    assert {x.host: x.verdict for x in r if x.host in SPAM[:5]} == dict.fromkeys(SPAM[:5], "block")


def test_urls_of_sites_held_out(spark):
    """Each third of the registered names, judged by a model of the other two: over 100 sites in each that training names nowhere."""
    table = urls.labelled(spark).withColumn("fold", F.crc32("name") % 3).cache()
    blocked, right, due, names = 0, 0, 0, 0
    for fold in range(3):
        held = table.where(F.col("fold") == fold)
        names += held.select("name").distinct().count()
        assert held.select("name").distinct().count() > 100
        model = urls.train(table.where(F.col("fold") != fold))
        for r in urls.judge(held.withColumn("page_id", F.col("label")), {}, model=model).collect():
            blocked, due = blocked + (r.verdict == "block"), due + (r.page_id == 1)
            right += r.verdict == "block" and r.page_id == 1
    assert names == len(urls.BLOCK) + len(urls.ALLOW) and right / blocked >= 0.9 and right / due >= 0.9


def test_url_table_is_not_the_pages(spark):
    """No word of the odd hosts of the given table, no host of it, and none of its shapes of paths."""
    import re

    pages = [u for (u,) in duckdb.sql("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    words = {w for r in urls.labelled(spark).collect() for w in re.split("[^a-z0-9]+", r.url)}
    assert not words & {"ads", "track", "adult", "casino", "win", "cheap", "pills", "free", "bets", "spam", "farm", "example"}
    assert not {r.name for r in urls.labelled(spark).collect()} & set(pages)
    assert not any(re.search(r"/(en|de|fr|es)/[0-9]", r.url) for r in urls.labelled(spark).collect())


def test_url_scores_against_brute_force(spark):
    import math

    from pyspark.ml.feature import HashingTF

    rows = ["https://Casino-Lux.example.com/win?x", "http://a.b/", "x", None, "https://" + "long." * 3000 + "org/" + "p" * 20000, "http://a.b/", "http:///only/path"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(None, rows[0])], "page_id long, url string").withColumns({"host": F.lit(1), "score": F.lit("s"), "rule": F.lit("r")})
    model, index = urls.train(urls.labelled(spark)), HashingTF(numFeatures=urls.FEATURES)
    got = urls.judge(df).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        found = set()
        for mark, t in (("h", x.host), ("p", x.path)):
            framed = f"{mark}^{t}$"
            found |= {mark + framed[i : i + n] for n in urls.GRAMS if len(framed) > n for i in range(1, len(framed) - n + 1)}
        z = model.intercept + sum(float(model.coefficients[i]) for i in {index.indexOf(g) for g in found})
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)))


# 9


def test_decontamination_takes_both_hashes_of_a_window(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, item.replace("w10", "other"))], "doc_id long, text string")
    b = spark.createDataFrame([("a", item)], "item_id string, text string")
    w = decontamination._hashed(b.withColumnRenamed("text", "t"), "t").select(F.explode(decontamination._windows(F.col("w"), F.lit(1))).alias("x")).select("x.*").collect()
    assert [x.start for x in w] == list(range(1, 9)) and len({x.window for x in w} | {x.check for x in w}) == 16
    assert {(r.doc_id, r.n_hit) for r in decontamination.contamination(docs, b).collect()} == {(1, 20), (2, 0)}


def test_decontamination_odd_rows_against_sql(spark):
    run = " ".join(f"x{i}" for i in range(1, 16))
    docs = [(1, "a b c " + run + " d e", 1), (2, None, 1), (3, "", 1), (4, "Short ITEM here, yes short item", 1), (None, "short item", 1), (1, "other words short item", 1), (5, run[3:] + " " + run[3:], 1), (5, run[3:] + " " + run[3:], 1)]
    items = [(10, run), (9, "short item"), (8, ""), (7, None), (None, "yes"), (9, "words")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string, n_hit int"), spark.createDataFrame(items, "item_id int, text string")
    got = sorted(map(str, decontamination.digest(decontamination.contamination(d, b)).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR, n_hit INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id INT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = con.execute(f"SELECT {', '.join(names)} FROM ({decontamination.ORACLE_SQL})").fetchall()
    want = sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r)) + ")" for r in rows)
    assert got == want
    assert len(decontamination.contamination(odd(spark), b).collect()) == len(ODD)
    assert decontamination.contamination(spark.createDataFrame([], EMPTY), b.where("false")).collect() == []
    assert {r.n_hit for r in decontamination.contamination(d, b.where("false")).collect()} == {0}


# 10


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = queries.op10_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    good, bad = [x.score for x in r if x.quality == 1], [x.score for x in r if x.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(x.predicted == (x.score >= 0.3) for x in r)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (7, 1), (6, 0), (8, None), (99, 1)], "doc_id long, quality int")
    r = quality.classify(odd(spark), labels).collect()
    assert len(r) == len(ODD) and all(0 <= x.score <= 1 for x in r)
    assert {x.score for x in quality.classify(odd(spark), labels.where("false")).collect()} == {0.5}
    assert quality.classify(spark.createDataFrame([], EMPTY), labels).collect() == []


def test_class_prior_of_planted_shares():
    rng = np.random.default_rng(8)

    def drawn(n, good):
        x = rng.normal(1.2 if good else -1.2, 1, (n, 4))
        return quality._design(x, [np.linspace(-2, 2, 9)] * 4)

    for share in (0.2, 0.5, 0.8):
        n = int(4000 * share)
        u = np.concatenate([drawn(n, True), drawn(4000 - n, False)])
        assert abs(quality.class_prior(drawn(2000, True), rng.permutation(u)) - share) < 0.07


def test_risk_and_its_gradient():
    rng = np.random.default_rng(9)
    p, u = rng.normal(0.5, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    for w, prior in ((np.zeros(3), 0.4), (rng.normal(size=3), 0.3), (np.array([4.0, 4, 4]), 0.95)):
        plain = np.mean([np.log1p(np.exp(x @ w)) for x in u]) - prior * np.mean([np.log1p(np.exp(x @ w)) for x in p])
        want = prior * np.mean([np.log1p(np.exp(-(x @ w))) for x in p]) + max(0, plain) + quality.RIDGE * sum(w * w) / 2
        assert quality.risk(w, p, u, prior) == pytest.approx(want)
        step = 1e-6 * np.eye(3)
        if plain > 0:
            assert quality.slope(w, p, u, prior) == pytest.approx([(quality.risk(w + s, p, u, prior) - quality.risk(w - s, p, u, prior)) / 2e-6 for s in step], abs=1e-5)
        else:  # the step raises what has fallen below 0
            negative = lambda v: np.logaddexp(0, u @ v).mean() - prior * np.logaddexp(0, p @ v).mean()
            assert negative(w - 1e-3 * (quality.slope(w, p, u, prior) - quality.RIDGE * w)) > plain
    assert plain < 0


def test_negative_labels_teach_nothing(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 40, ["fine", "words", "here", "and", "there"] if i % 3 else ["BUY", "!!!", "NOW", "9999"]))) for i in range(300)], "doc_id long, text string")
    some = [(i, 1) for i in range(0, 120) if i % 3]
    scores = [{r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(some + more, "doc_id long, quality int")).collect()} for more in ([], [(i, 0) for i in range(120, 200)])]
    assert scores[0] == scores[1] and np.mean([scores[0][i] > scores[0][j] for i in range(150, 300) if i % 3 for j in range(150, 300, 3)]) > 0.95
    both = spark.createDataFrame([*some, (1, 0), (1, None)], "doc_id long, quality int")  # contradictory labels are none
    assert len(quality.classify(docs, both).collect()) == 300


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(12)]
    z, n = np.zeros((language.BUCKETS + 1, 3)), np.zeros((language.BUCKETS + 1, 3))

    def weight(i, c):
        if abs(z[i, c]) <= language.L1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * language.L1) / ((language.BETA + n[i, c] ** 0.5) / language.ALPHA + language.L2)

    for epoch in range(language.EPOCHS):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[r]
            w = [[weight(i, c) for c in range(3)] for i in at]
            e = [np.exp(sum(v * w[j][c] for j, v in enumerate(x))) for c in range(3)]
            for j, (i, v) in enumerate(zip(at, x)):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    s = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / language.ALPHA
                    z[i, c] += g - s * w[j][c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(6)])
    assert language.ftrl(rows, 3)[:6] == pytest.approx(want)


# Queries with SQL, and words


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    show = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(show, df.collect())) == sorted(map(show, rows))


def test_words_of_long_texts_are_hashed_whole():
    rng = random.Random(0)
    text = " ".join("".join(rng.choices("abcXé9", k=rng.randint(1, 9))) for _ in range(120000))
    assert (word_hashes(text) == np.concatenate([word_hashes(w) for w in text.split()[:50]] + [word_hashes(w) for w in text.split()[50:]])).all()


def test_probe_survives_the_template(spark):
    r = [x for x in queries.op2_chat_formatting(spark, SF).collect() if x.conv_id == -7][0]
    t = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())


def test_ngrams_at_the_joints_of_long_texts_count_once(monkeypatch):
    rng = random.Random(3)
    for text in ("".join(rng.choice("ab éñ 1.") for _ in range(400)), "a" * 50, " a  b   c    d" * 9):
        monkeypatch.setattr(language, "_SEGMENT", 1 << 18)
        whole = language.counts(text)
        for n in (7, 16, 33):
            monkeypatch.setattr(language, "_SEGMENT", n)
            parts = language.counts(text)
            assert abs(parts - whole).sum() <= len(text) // n  # a run of spaces over a joint may be one space more
            if "  " not in "".join(c if c.isalpha() else " " for c in text):
                assert (parts == whole).all()


def test_samples_of_one_key_are_bounded(spark, monkeypatch):
    """Rows of one key, or of none, are drawn apart, equal ones once: the fit gets about as many as from rows of their own keys."""
    monkeypatch.setattr(language, "FIT_ROWS", 40)
    seen, real = [], language.materialise
    monkeypatch.setattr(language, "materialise", lambda df, name: seen.append(out := real(df, name)) or out)
    rows = [(None if i % 2 else 7, f"the dog and the cat number {i}", "en") for i in range(3000)] + [(None, "the very same text", "en")] * 3000 + [(1, "der hund und die katze", "de")]
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = {r.l: r["count"] for r in seen[0].groupBy("l").count().collect()}
    assert 2 <= n["en"] <= 80 and n["de"] == 1
