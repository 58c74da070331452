"""Quality of texts by positive-unlabelled learning: a linear model that minimises the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import materialise
from patchlight.llm.language import held_out
from patchlight.llm.tokens import word_hashes

#: Rows that the model is fitted on, about (all, if there are fewer): trusted positives and unlabelled texts. Rows labelled otherwise are unlabelled ones.
POSITIVES, UNLABELLED = 4000, 8000
#: Each feature is cut at so many quantiles of the unlabelled texts.
BINS = 16
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
THRESHOLD = 0.3
_GROUPS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r", "line": b"\n", "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|"}
_KIND = np.full(256, len(_GROUPS), np.uint8)  # the rest of ASCII: other signs
for _i, _bytes in enumerate(_GROUPS.values()):
    _KIND[list(_bytes)] = _i
_KIND[128:192] = len(_GROUPS) + 1  # inner bytes of a character
_KIND[192:] = len(_GROUPS) + 2  # characters beyond ASCII
FEATURES = 16


def features(text: str | None) -> np.ndarray:
    """Style of a whole text: shares of kinds of characters, repetition of words and lines, lengths. A null text is an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.zeros(len(_GROUPS) + 3, np.int64)
    for at in range(0, len(data), 1 << 20):
        n += np.bincount(_KIND[data[at : at + (1 << 20)]], minlength=len(n))
    chars, letters = max(int(n.sum() - n[-2]), 1), max(int(n[0] + n[1]), 1)
    w = word_hashes(text)
    counts = np.unique(w, return_counts=True)[1]
    words, lines = max(len(w), 1), text.split("\n")
    return np.array([
        n[1] / letters, n[2] / chars, n[3] / chars, n[4] / chars, n[5] / chars, n[6] / chars, n[7] / chars, n[8] / chars, n[-1] / chars,
        len(counts) / words, (w[1:] == w[:-1]).sum() / words, counts.max(initial=0) / words, len(set(lines)) / len(lines),
        np.log1p(len(w)), letters / words, len(w) / len(lines),
    ])


def _design(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One column for each stretch of each feature, and one for the bias."""
    cols = [np.ones((len(x), 1))]
    for j, c in enumerate(cuts):
        at = np.searchsorted(c, x[:, j], side="right")
        cols.append((at[:, None] == np.arange(len(c) + 1)[None, :]).astype(float))
    return np.concatenate(cols, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(size: int, gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Where STEPS steps by Adam lead from 0."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from trusted positives p and unlabelled u alone, by the best bin of scores.

    A linear model that tells p from u is fitted on one half of each and scores the other. Above a threshold there are as
    many of the unlabelled ones, of those of the positives, as positives among them, and more if negatives score so high:
    the least such ratio, with a margin for chance, is the estimate.
    """
    def fitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _descend(a.shape[1], lambda w: (b.T @ _sigmoid(b @ w) / len(b) - a.T @ _sigmoid(-(a @ w)) / len(a)) / 2 + RIDGE * w)

    found = []
    for k in (0, 1):
        if len(p) < 4 or len(u) < 4:
            return 0.5
        w = fitted(p[k::2], u[k::2])
        zp, zu = np.sort(p[1 - k :: 2] @ w), np.sort(u[1 - k :: 2] @ w)
        cuts = np.unique(zp)
        above_p, above_u = 1 - np.searchsorted(zp, cuts) / len(zp), 1 - np.searchsorted(zu, cuts) / len(zu)
        chance = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
        best = np.argmin((above_u + 1.01 * chance) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under logistic loss, and the ridge."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative) + RIDGE * (w @ w) / 2


def slope(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the risk; where its second part is below 0, the step that raises that part instead."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    down = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    up = -prior * (p.T @ _sigmoid(-zp)) / len(p)
    return (up + down if negative >= 0 else -down) + RIDGE * w


def fit(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk. Their logistic function is the probability of a positive, as far as the prior is right."""
    return _descend(p.shape[1], lambda w: slope(w, p, u, prior))


def _draw(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Broadcast | None:
    """The model, from docs and their positive labels (1; ids with contradictory labels have none); None without positives or texts.

    Other labels are used for nothing but to tell contradictory ones. Keys with positive labels are drawn by their hash, about
    POSITIVES, so few enough to be sent to all tasks. Of their rows, and of all docs, about POSITIVES and UNLABELLED rows are
    drawn by the hash of key and text, however many rows a key has; equal rows count once.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    trusted = labels.where(F.col(label).isNotNull()).groupBy(k.alias("k")).agg(F.min(label).alias("y0"), F.max(label).alias("y1")).where("y0 = 1 and y1 = 1").select("k", F.lit(1).alias("y"))
    n_pos, n_docs = trusted.count(), docs.count()
    if not n_pos or not n_docs:
        return None
    some = F.broadcast(trusted.where(_draw(F.col("k"), "label/") < min(1.0, POSITIVES / n_pos)))
    n_rows = docs.select(k.alias("k")).join(some, "k").count()
    row = F.concat("k", F.lit("/"), F.coalesce(F.xxhash64("t").cast("string"), F.lit("")))
    sample = docs.select(k.alias("k"), F.col(text).alias("t")).join(some, "k", "left").withColumns({
        "u": _draw(row, "plain/") < min(1.0, UNLABELLED / n_docs), "y": F.when(_draw(row, "row/") < min(1.0, POSITIVES / max(n_rows, 1)), F.col("y")),
    }).where("u or y is not null").distinct()

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "y": f["y"].fillna(-1).astype(int), "u": f["u"], "x": [features(t) for t in f["t"]]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("k", kind="stable")
        x, y = np.stack(rows["x"].to_list()), rows["y"].to_numpy()
        base = x[rows["u"].to_numpy(bool)] if rows["u"].any() else x
        cuts = [np.unique(np.quantile(base[:, j], np.arange(1, BINS) / BINS)) for j in range(FEATURES)]
        if not (y == 1).any():
            return
        p, u = _design(x[y == 1], cuts), _design(base, cuts)
        prior = class_prior(p, u)
        yield pd.DataFrame({"w": [fit(p, u, prior).tobytes()], "cuts": [[c.tolist() for c in cuts]], "prior": [prior]})

    found = materialise(sample.select("k", "t", "y", "u").mapInPandas(encoded, "k string, y int, u boolean, x array<double>"), "quality-sample")
    found = found.coalesce(1).mapInPandas(learn, "w binary, cuts array<array<double>>, prior double").first()
    return found and spark.sparkContext.broadcast((np.frombuffer(found["w"]).copy(), [np.array(c) for c in found["cuts"]], found["prior"]))


def score(docs: DataFrame, model: Broadcast | None, text: str = "text") -> DataFrame:
    """docs, and columns score (0 to 1, the probability of good quality) and predicted (1 if score >= THRESHOLD, else 0).

    Null texts score as empty ones, equal texts alike; without a model all score 0.5. Existing columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    if model is None:
        s = F.lit(0.5)
    else:
        @F.pandas_udf("double")
        def rate(texts: pd.Series) -> pd.Series:
            w, cuts, _ = model.value
            if not len(texts):
                return pd.Series([], dtype=float)
            return pd.Series(_sigmoid(_design(np.stack([features(t) for t in texts]), cuts) @ w))

        s = rate(F.col(text))
    return docs.withColumn("score", s).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs, and columns held_out, score, predicted; learnt from the texts and labels of rows that aren't held out (crc32 of the key mod 5 is not 0).

    Null keys hash as empty ones; repeated rows count as often as they stand; labels without a row teach nothing; an empty
    table stays empty.
    """
    model = train(docs.where(~held_out(docs, key, 5, 0)), labels.where(~held_out(labels, key, 5, 0)), key, text, label)
    return score(docs.drop("held_out").withColumn("held_out", held_out(docs, key, 5, 0)), model, text)
