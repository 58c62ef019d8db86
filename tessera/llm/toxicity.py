"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over a text's words and word beginnings. Each
model also sees the probabilities of the categories before its own; while it is trained these are
out-of-fold predictions, so that it learns from what it will see later, not from memorised answers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import claim, least_hashed, small_batches, text_of, work_folder, written
from .linear import Rows, best_threshold, fit, logit, sigmoid

#: Hash space of features; labelled rows that a chain is fitted on at most, and features of all these rows together; features that it keeps, folds.
SPACE = 1 << 18
SAMPLE = 6000
SAMPLE_FEATURES = 16_000_000
SELECTED = 768
FOLDS = 4
#: How many times as much recall counts as precision where thresholds are chosen.
RECALL = 1.0
CACHE_ENTRIES = 300_000

CATEGORIES = ("explicit", "severe", "toxic")

_WORD = re.compile(r"\w+")


class Features(dict):
    """Chunk between white space (UTF-8) -> packed hashes of its words and their beginnings of 3 to 6 letters."""

    def __missing__(self, chunk: bytes) -> bytes:
        import xxhash

        out = []
        for word in _WORD.findall(chunk.decode("utf-8").lower()):
            names = [word] + [f"^{word[:k]}" for k in range(3, min(7, len(word)))]
            out += [xxhash.xxh32_intdigest(name) % SPACE for name in names]
        found = self[chunk] = np.array(out, "<u4").tobytes()
        return found


def feature_set(text: str, cache: Features) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    return np.unique(np.frombuffer(b"".join(map(cache.__getitem__, set(text.encode("utf-8").split()))), "<u4"))


@dataclass
class Chain:
    """Linear models in order: biases, weights of features (categories, SPACE), weights of earlier log-odds, and thresholds."""

    categories: tuple[str, ...]
    biases: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, categories), each column from the features and the columns before it."""
        z = np.zeros((len(sets), len(self.categories)))
        for k, own in enumerate(sets):
            z[k] = self.weights[:, own].sum(axis=1)
        before = np.zeros_like(z)
        for j in range(z.shape[1]):
            p = sigmoid(z[:, j] + self.biases[j] + before[:, :j] @ self.links[j, :j])
            before[:, j], z[:, j] = logit(p) / 4, p
        return z


def select(column: np.ndarray, row: np.ndarray, y: np.ndarray, used: np.ndarray, most: int = SELECTED) -> tuple[np.ndarray, np.ndarray]:
    """Of a 0/1 matrix (column, row of each 1), the features that tell the classes apart best over the used rows, strongest
    first, by chi-squared with Yates' correction; and their log-odds."""
    a = np.bincount(column, (y * used)[row], SPACE)
    b = np.bincount(column, ((1 - y) * used)[row], SPACE)
    p, n = max(1.0, (y * used).sum()), max(1.0, ((1 - y) * used).sum())
    both = (a + b) * (p + n - a - b)
    chi = np.where(both > 0, (p + n) * np.maximum(0, np.abs(a * (n - b) - b * (p - a)) - (p + n) / 2) ** 2 / np.maximum(1, both * p * n), 0)
    odds = np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (n + 1))
    order = np.argsort(-chi, kind="stable")[:most]
    order = order[chi[order] > 6.6]
    return order, odds[order]


def derive_categories(sets: list[np.ndarray], toxic: np.ndarray):
    """A function of used rows (a mask): (rows, 3) labels of CATEGORIES from one label.

    Of the toxic rows, those with a leading marker are explicit, and those with at least the median number of
    markers severe. Markers are features far commoner in toxic rows; they and the median come from the used rows
    alone, so that rows held out have no part in the labels that a model is fitted to.
    """
    rows, is_toxic = Rows(sets, SPACE), toxic > 0

    def labels(used: np.ndarray) -> np.ndarray:
        order, odds = select(rows.column, rows.row, toxic, used.astype(float))
        markers = order[odds > 3]
        mark, lead = np.zeros(SPACE, bool), np.zeros(SPACE, bool)
        mark[markers], lead[markers[:32]] = True, True
        counts = np.array([mark[s].sum() for s in sets])
        leads = np.array([lead[s].any() for s in sets], bool)
        median = np.median(counts[is_toxic & used]) if (is_toxic & used).any() else 0
        return np.stack([is_toxic & leads, is_toxic & (counts >= max(1, median)), is_toxic], axis=1).astype(float)

    return labels


def fit_chain(sets: list[np.ndarray], labels, categories: tuple[str, ...], folds: int = FOLDS, seed: int = 1) -> Chain:
    """Fits the models in order; a category without both classes gets its prior, and a threshold that agrees.

    labels is a matrix (rows, categories), or a function that makes one from the rows that it may look at.
    """
    n, width = len(sets), len(categories)
    fold = np.random.default_rng(seed).permutation(n) % folds
    everyone = np.ones(n, bool)
    passes = [(f, fold != f) for f in range(folds)] + [(None, everyone)]
    given = [labels(used) if callable(labels) else labels for _, used in passes] if n else []
    chain = Chain(categories, np.zeros(width), np.zeros((width, SPACE), np.float32), np.zeros((width, width)), np.full(width, 2.0))
    seen, held = np.zeros((n, width)), np.bincount(np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64), minlength=SPACE)
    few = [s[held[s] > 2] for s in sets]  # a feature of two rows can't tell classes apart
    whole = Rows(few, SPACE)
    column, row = whole.column, whole.row
    for j in range(width):
        if not n:
            chain.biases[j] = -6.0
            continue
        oof = np.zeros(n)
        for (f, used), matrix in zip(passes, given):
            y, train = matrix[:, j], np.flatnonzero(used)
            chosen, _ = select(column, row, y, used.astype(float))
            place = np.full(SPACE, -1)
            place[chosen] = np.arange(len(chosen))
            rows = Rows([], len(chosen))
            keep = place[column] >= 0
            rows.n, rows.column, rows.row = n, place[column[keep]], row[keep]
            b, links, w = fit(seen[train, :j], y[train], rows.only(train) if len(chosen) else None, l2=1e-4, rounds=120)
            if f is not None:
                z = b + seen[:, :j] @ links + (rows.times(w) if len(chosen) else 0)
                oof[~used] = sigmoid(z[~used])
            else:
                chain.biases[j], chain.links[j, :j] = b, links
                chain.weights[j, chosen] = w
        chain.thresholds[j] = best_threshold(oof, given[-1][:, j], RECALL)
        seen[:, j] = logit(oof) / 4
    return chain


def sample(df: DataFrame, labels: DataFrame, *, most: int = SAMPLE, most_features: int = SAMPLE_FEATURES, label_columns: tuple[str, ...] = ("toxic",), id_column: str = "doc_id", text_column: str = "text", seed: int = 1, folder: str | None = None) -> pd.DataFrame:
    """Up to `most` labelled rows, those with the least hashes of their ids, with `most_features` features together: features and labels, on the driver.

    The chosen labels, at most `most` rows, are broadcast; the documents are read once, and only chosen ones
    reach Python. Rows count whole: in the order of the hashes, those that still fit.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = labels.where(" and ".join(f"{c} is not null" for c in label_columns) + f" and {id_column} is not null")
    known = known.groupBy(F.col(id_column).cast("long").alias("own_id")).agg(*[F.max(c).cast("double").alias(f"label_{c}") for c in label_columns])
    order = [F.xxhash64("own_id", F.lit(seed)), F.col("own_id")]
    chosen = least_hashed(known, "own_id", most, seed)

    def features(batches):
        cache = Features()
        for batch in batches:
            batch["features"] = [feature_set(t, cache).astype("<u4").tobytes() for t in batch.pop("text")]
            yield batch

    rows = df.select(F.col(id_column).cast("long").alias("own_id"), text_of(text_column).alias("text")).join(F.broadcast(chosen), "own_id")
    names = [f"label_{c}" for c in label_columns]
    kinds = ", ".join(f"{n} double" for n in names)
    made = written(rows.select("own_id", *names, "text").mapInPandas(features, f"own_id long, {kinds}, features binary"), folder or work_folder(spark, "toxicity"))
    sizes = made.groupBy("own_id").agg(F.max(F.octet_length("features")).alias("size"))  # a row for each chosen label
    fitting = sizes.withColumn("total", F.sum("size").over(W.orderBy(*order))).where(F.col("total") <= 4 * most_features).select("own_id")
    found = made.join(F.broadcast(fitting), "own_id", "left_semi").groupBy("own_id", *names).agg(F.min("features").alias("features")).toPandas().sort_values(["own_id", *names], ignore_index=True)
    return found.assign(features=[np.frombuffer(f, "<u4") for f in found["features"]])


def train(df: DataFrame, labels: DataFrame, **options) -> Chain:
    """The chain of CATEGORIES, fitted on a bounded sample of the rows of `labels` (doc_id, toxic)."""
    rows = sample(df, labels, **options)
    sets = list(rows["features"])
    toxic = rows["label_toxic"].to_numpy(float) if len(rows) else np.zeros(0)
    return fit_chain(sets, derive_categories(sets, toxic), CATEGORIES)


def scorer(chain: Chain):
    """A column function of whole texts: a struct of p_<category> and `flag`, whether the last category is at its threshold."""
    kinds = ", ".join(f"p_{c} double" for c in chain.categories) + ", flag boolean"

    @F.pandas_udf(kinds)
    def score(texts: pd.Series) -> pd.DataFrame:
        if len(claim(_CACHE)) > CACHE_ENTRIES:
            _CACHE.clear()
        p = chain.probabilities([feature_set(t, _CACHE) for t in texts])
        out = pd.DataFrame(p, columns=[f"p_{c}" for c in chain.categories])
        return out.assign(flag=p[:, -1] >= chain.thresholds[-1])

    return lambda text_column: score(text_of(text_column))


_CACHE = Features()


def toxicity(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, a probability for each category, and toxic, for every document, each read whole.

    Labels are (doc_id, toxic); a null label or id is no label, repeated ones count as toxic if one is. Null and
    empty texts have no features and get the prior. Without labels, or with labels of one class, nothing is
    toxic unless all labels are. Ids may be null or repeat. Other columns are ignored; an empty table gives no
    rows. Documents are read once to fit (a bounded sample) and once to score; nothing is shuffled.
    """
    chain = train(df, labels, id_column=id_column, text_column=text_column, **options)
    scored = df.select(F.col(id_column).cast("long").alias("doc_id"), scorer(chain)(text_column).alias("own"))
    return scored.select("doc_id", *[F.col(f"own.p_{c}").alias(f"p_{c}") for c in chain.categories], F.col("own.flag").alias("toxic"))


def keep_clean(df: DataFrame, labels: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """The rows of df that aren't toxic, with all their columns, whatever their names.

    Nulls, empty and very long texts, ties and tables without rows are as in toxicity(): each row is decided by its
    own text, so repeated rows stay or go together. Nothing is shuffled.
    """
    chain = train(df, labels, text_column=text_column, **options)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), scorer(chain)(text_column).alias("own"))
    return whole.where("not own.flag").select("whole.*")
