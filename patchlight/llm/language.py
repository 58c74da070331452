"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import materialise, unused

#: n-grams of 1 to 3 characters fall into so many buckets.
BUCKETS = 1 << 14
#: Labelled rows of each language that the weights are fitted on (about; all rows, if there are fewer). Document frequencies cover all labelled rows.
FIT_ROWS = 1500
#: Of those, one in so many calibrates the temperature instead.
CALIBRATE = 5
#: Languages that are learnt at most, those with the most labelled rows, and rows that the weights are fitted on in all: bounds of the
#: fit, so that dirty labels neither widen the weights nor fill the fitting task.
LANGUAGES, FIT_TOTAL = 256, 24_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.02, 0.01
#: Below this calibrated probability the language counts as rejected.
LEAST_SCORE = 0.35
_SEGMENT = 1 << 18
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTER = np.zeros(128, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def counts(text: str) -> np.ndarray:
    """How often the n-grams of each bucket occur in the whole text; all that isn't a letter counts as a space."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _SEGMENT):
        piece = (" " if not at else text[max(0, at - 2) : at]) + text[at : at + _SEGMENT] + ("" if at + _SEGMENT < len(text) else " ")
        c = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        c[(c < 128) & ~_LETTER[np.minimum(c, 127)]] = 32
        kept = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]
        again = int(kept[: min(2, at)].sum())  # characters of the piece before, which only begin n-grams that reach beyond them
        c = c[kept]
        h = np.zeros(len(c), np.uint32)
        for n in range(3):
            if len(c) <= n:
                break
            h = h[: len(c) - n] * np.uint32(31) + c[n:] * _MUL[n]
            g = h ^ (h >> np.uint32(15))
            total += np.bincount((g[max(0, again - n) :] * _MUL[0]) >> np.uint32(32 - 14), minlength=BUCKETS)
    return total


def tf_idf(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and their weights, of length 1."""
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (BUCKETS + 1 by classes; the last row is the bias) by follow-the-regularised-leader with elastic net."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(z, n)


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, on a grid from 1/20 to 20."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Broadcast | None:
    """idf, weights, languages and temperature as a broadcast, from the rows with text and language; None if there are none.

    Two passes: document frequencies over all labelled rows, and the fit on about FIT_ROWS of each language (fewer beyond
    FIT_TOTAL in all), chosen by the hash of their keys and texts, equal rows once. Of more than LANGUAGES labels, the rarest teach nothing; of equally
    rare ones the last by code point. The driver gets only frequencies and weights, whose size BUCKETS and LANGUAGES bound.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    most = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES + 1).collect()
    sizes = {r["l"]: r["n"] for r in most[:LANGUAGES]}
    if not sizes:
        return None
    langs = sorted(sizes)
    if len(most) > LANGUAGES:
        rows = rows.where(F.col("l").isin(langs))
    each = min(FIT_ROWS, FIT_TOTAL / len(langs))

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, np.int64)
        for f in frames:
            for t in f["t"]:
                seen += counts(t) > 0
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": seen[at]})

    df = np.zeros(BUCKETS)
    for r in rows.select("t").mapInPandas(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))]), F.col("l"))
    # drawn by key and text, so rows of one key, or without one, don't come together; equal rows count once
    row = F.concat("k", F.lit("/"), F.xxhash64("t").cast("string"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("fit/"), row)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    sample = rows.where(draw < share).distinct().select("k", "l", "t", (F.pmod(F.crc32(F.concat(F.lit("cal/"), row)), F.lit(CALIBRATE)) == 0).alias("c"))

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = [tf_idf(counts(t), idf) for t in f["t"]]
            yield pd.DataFrame({"k": f["k"], "l": f["l"], "c": f["c"], "at": [a.astype(np.int32).tobytes() for a, _ in xs], "x": [x.astype(np.float32).tobytes() for _, x in xs]})

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(frames)).sort_values(["k", "l", "x"])
        bias = np.array([BUCKETS])
        made = [(np.r_[np.frombuffer(a, np.int32), bias], np.r_[np.frombuffer(x, np.float32), 0.1], langs.index(y), c) for a, x, y, c in zip(all_rows["at"], all_rows["x"], all_rows["l"], all_rows["c"])]
        w = ftrl([m[:3] for m in made if not m[3]] or [m[:3] for m in made], len(langs))
        held = [m for m in made if m[3]]
        t = temperature(np.array([x @ w[a] for a, x, _, _ in held]), np.array([y for _, _, y, _ in held], int))
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "t": [t]})

    found = materialise(sample.mapInPandas(encoded, "k string, l string, c boolean, at binary, x binary"), "language-sample").coalesce(1).mapInPandas(fit, "w binary, t double").first()
    weights = np.frombuffer(found["w"], np.float32).reshape(BUCKETS + 1, len(langs)).copy() if found else np.zeros((BUCKETS + 1, len(langs)), np.float32)
    return spark.sparkContext.broadcast((idf, weights, langs, found["t"] if found else 1.0))


def _judged(docs: DataFrame, model: Broadcast | None, text: str) -> tuple[DataFrame, str]:
    """docs with one more column, whose name follows, of lang_pred and score."""
    name = unused("judged", docs)
    if model is None:
        return docs.withColumn(name, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))), name

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        idf, w, langs, temp = model.value
        out = []
        for t in texts:
            if t is None:
                out.append(("und", 0.0))
                continue
            at, x = tf_idf(counts(t), idf)
            p = _softmax((x @ w[at] + 0.1 * w[BUCKETS]) / temp)
            out.append((langs[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn(name, judge(F.when(F.col(text).rlike(r"\p{L}"), F.col(text)))), name


def predict(docs: DataFrame, model: Broadcast | None, text: str = "text") -> DataFrame:
    """docs, and columns lang_pred and score (the calibrated probability of lang_pred).

    'und' with score 0 for null texts and texts without a letter, and for all if nothing could be learnt. Equal texts get
    equal results; ties go to the first language by code point. Existing columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    judged, name = _judged(docs, model, text)
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], f"{name}.lang_pred", f"{name}.score")


def held_out(docs: DataFrame, key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """True where crc32 of the key's text leaves the remainder part; null keys count as empty texts."""
    return F.pmod(F.crc32(F.coalesce(docs[key].cast("string"), F.lit(""))), F.lit(parts)) == part


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, and columns held_out, lang_pred, score; learnt from the rows that aren't held out.

    Null texts or languages teach nothing; null keys hash as empty ones; repeated rows count as often as they stand; an
    empty table stays empty.
    """
    out = held_out(docs, key)
    return predict(docs.drop("held_out").withColumn("held_out", out), train(docs.where(~out), key, text, lang), text)


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of docs whose language could be told: not 'und', and a score of LEAST_SCORE at least.

    So rows with null texts or texts without a letter go, empty ones among them; repeated rows stay or go together. All
    other columns stay as they are, null keys, languages and sources too; an empty table stays empty.
    """
    judged, name = _judged(docs, train(docs.where(~held_out(docs))), "text")
    ok = (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)
    return judged.where(ok).drop(name)
