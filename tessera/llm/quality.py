"""Quality by co-training two views.

The text view sees how words look and recur, the metadata view a document's source, language, stored length
and layout of lines. Both are first fitted on labelled rows. Then, over rounds, each classifier scores every
unlabelled document and labels those that it is surest of for the other. Both are calibrated on labelled rows
that neither was trained on, and combined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import claim, least_hashed, leave_out, small_batches, text_of, work_folder, written
from .linear import best_threshold, fit, platt, sigmoid

#: Hash spaces of the views, and the width of both together.
SHAPES, SOURCES, LANGS = 512, 256, 64
TEXT_WIDTH, META_WIDTH = SHAPES + 4, SOURCES + LANGS + 4
#: Labelled rows to fit on at most; rounds; the share of all unlabelled documents that a view labels a round, how many these are at most
#: (the classes get their own shares of them), and its least confidence.
LABELLED, ROUNDS, SHARE, GIVEN, SURE = 6000, 4, 0.05, 200, 0.95
CACHE_ENTRIES = 300_000
#: Bytes from which on a chunk without white space is cut into pieces of so many characters, each with a shape of its own.
LONG, PIECE = 64, 32

_RUNS = re.compile(r"(.)\1+", re.DOTALL)


class Shapes(dict):
    """Chunk between white space (UTF-8) -> 55 bits of its hash, then 9 bits of the hash of its shape."""

    def __missing__(self, chunk: bytes) -> int:
        import xxhash

        shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in chunk.decode("utf-8"))
        own = xxhash.xxh32_intdigest(_RUNS.sub(r"\1\1", shape)) % SHAPES
        found = self[chunk] = xxhash.xxh3_64_intdigest(chunk) // SHAPES * SHAPES + own
        return found


def _pieces(chunk: bytes) -> list[bytes]:
    if len(chunk) <= LONG:
        return [chunk]
    text = chunk.decode("utf-8")
    return [text[at : at + PIECE].encode("utf-8") for at in range(0, len(text), PIECE)]


def text_view(text: str, cache: Shapes) -> np.ndarray:
    """Shares of word shapes (square roots), and shares of words and word pairs that recur, of a whole text.

    Words are chunks between white space; of a chunk longer than LONG bytes (a script without spaces, encoded data)
    each piece of PIECE characters counts as one.
    """
    out = np.zeros(TEXT_WIDTH, np.float32)
    chunks = text.encode("utf-8").split()
    if chunks and max(map(len, chunks)) > LONG:
        chunks = [p for c in chunks for p in _pieces(c)]
    n = len(chunks)
    if n:
        h = np.fromiter(map(cache.__getitem__, chunks), np.uint64, n)
        out[:SHAPES] = np.sqrt(np.bincount((h % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES) / n)
        out[SHAPES] = np.mean(h[1:] == h[:-1]) if n > 1 else 0
        if n > 1:
            pairs = (h[1:] * np.uint64(0x9E3779B97F4A7C15)) ^ h[:-1]
            out[SHAPES + 1] = 1 - len(np.unique(pairs)) / (n - 1)
        out[SHAPES + 2] = 1 - len(np.unique(h)) / n
    else:
        out[SHAPES + 3] = 1
    return out


def metadata_view(text: str, source: str, lang: str, n_chars: float) -> np.ndarray:
    """Source and language (hashed), stored length, and layout: lines, their mean length, and whether lengths agree."""
    import xxhash

    out = np.zeros(META_WIDTH, np.float32)
    out[xxhash.xxh32_intdigest(source) % SOURCES] = 1
    out[SOURCES + xxhash.xxh32_intdigest(lang) % LANGS] = 1
    lines = text.count("\n") + 1
    out[-4:] = np.log1p(max(0.0, n_chars)) / 10, np.log1p(lines) / 5, np.log1p(len(text) / lines) / 10, float(n_chars != len(text))
    return out


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (slope, offset), the stack of both (bias, weights), and the least probability that is kept."""

    views: tuple[tuple[float, np.ndarray], tuple[float, np.ndarray]]
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    stack: tuple[float, np.ndarray]
    threshold: float

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(rows, 3): of the text view, the metadata view, and both."""
        z = np.stack([slope * (b + x @ w) + offset for (b, w), (slope, offset), x in zip(self.views, self.calibrations, (text, meta))], axis=1)
        return np.column_stack([sigmoid(z), sigmoid(self.stack[0] + z @ self.stack[1])])


def _held_out(y: np.ndarray, seed: int) -> np.ndarray:
    """Which rows calibration and threshold are chosen on: a quarter of each class, rounded up."""
    held, draw = np.zeros(len(y), bool), np.random.default_rng(seed)
    for side in (0, 1):
        own = draw.permutation(np.flatnonzero(y == side))
        held[own[: -(-len(own) // 4)]] = True
    return held


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest, rounds: int = ROUNDS, seed: int = 1) -> CoTrained:
    """Fits both views on labelled rows and on what they teach each other.

    surest(views, shares) gives for each view the unlabelled rows that it labels: (text rows, meta rows, labels). `shares` are
    those of the classes 0 and 1. A quarter of each class's labelled rows is held out for calibration and threshold;
    of a class with one row, that row is fitted on as well. With labels of one class all rows get its side.
    """
    if not len(y) or y.min() == y.max():
        none = (0.0, np.zeros(text.shape[1])), (0.0, np.zeros(meta.shape[1]))
        return CoTrained(none, ((1.0, 0.0), (1.0, 0.0)), (6.0 if not len(y) or y.max() > 0 else -6.0, np.zeros(2)), 0.5)
    held = _held_out(y, seed)
    fitted = ~held | np.isin(y, [side for side in (0, 1) if (y == side).sum() == 1])
    shares = (float(np.mean(y[fitted] == 0)), float(np.mean(y[fitted] == 1)))
    given: list[dict] = [{}, {}]  # rows that each view has been given, with their labels, by their values
    views = [None, None]
    for r in range(rounds + 1):
        for k, x in enumerate((text, meta)):
            more = [row for row, _ in given[k].values()]
            rows = np.vstack([x[fitted], *[m[None] for m in more]])
            target = np.concatenate([y[fitted], [side for _, side in given[k].values()]])
            before = np.concatenate([[views[k][0]], views[k][1]]) if views[k] else None
            b, w, _ = fit(rows, target, l2=1e-4, rounds=200 if before is None else 60, start=before)
            views[k] = b, w
        if r < rounds:
            for k, (texts, metas, labels) in enumerate(surest(views, shares)):
                for row, whole, side in zip((metas, texts)[k], np.hstack([texts, metas]), labels):
                    given[1 - k].setdefault(whole.tobytes(), (row, float(side)))
    scores = [b + x[held] @ w for (b, w), x in zip(views, (text, meta))]
    calibrations = tuple(platt(s, y[held].astype(float)) for s in scores)
    z = np.stack([slope * s + offset for s, (slope, offset) in zip(scores, calibrations)], axis=1)
    b, w, _ = fit(z, y[held].astype(float), l2=1e-3, rounds=400)
    w = np.maximum(0, w)
    bad = 1 - sigmoid(b + z @ w)
    return CoTrained(tuple(views), calibrations, (float(b), w), 1 - best_threshold(bad, 1.0 - y[held]))


def pick(scores: np.ndarray, codes: np.ndarray, most: int, sure: float) -> np.ndarray:
    """Places of the `most` highest scores of at least `sure`; rows with one code are one (their scores are equal), ties go by code."""
    some = np.flatnonzero(scores >= sure)
    order = some[np.lexsort((codes[some], -scores[some]))]
    new = np.append(True, codes[order][1:] != codes[order][:-1])[: len(order)]
    return order[new][:most]


def _inputs(columns: list[str], text_column: str) -> list:
    text = text_of(text_column)
    optional = [F.coalesce(F.col(c).try_cast("string"), F.lit("")) if c in columns else F.lit("") for c in ("source", "lang")]
    n_chars = F.coalesce(F.col("n_chars").try_cast("double"), F.lit(-1.0)) if "n_chars" in columns else F.length(text).cast("double")
    return [text, *optional, n_chars]


def _hash(columns: list[str], text_column: str):
    return F.xxhash64(*_inputs(columns, text_column))


def _views(cache: Shapes, texts, sources, langs, n_chars) -> np.ndarray:
    """Both views of rows side by side."""
    if len(claim(cache)) > CACHE_ENTRIES:
        cache.clear()
    out = np.zeros((len(texts), TEXT_WIDTH + META_WIDTH), np.float32)
    for k, own in enumerate(zip(texts, sources, langs, n_chars)):
        out[k, :TEXT_WIDTH], out[k, TEXT_WIDTH:] = text_view(own[0], cache), metadata_view(*own)
    return out


_CACHE = Shapes()


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as places (two bytes) and values (four) of what isn't 0."""
    found = []
    for row in x:
        at = np.flatnonzero(row)
        found.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
    return found


def _unpacked(rows) -> np.ndarray:
    out = np.zeros((len(rows), TEXT_WIDTH + META_WIDTH), np.float32)
    for k, raw in enumerate(rows):
        n = len(raw) // 6
        out[k, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:]


def features(df: DataFrame, folder: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """own_id, own_hash (of all that the views see) and views (both, packed: a tenth of the text) of every row, a table in `folder`: the one pass over texts."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            columns = [batch[c].tolist() for c in ("text", "source", "lang", "n_chars")]
            found = []
            for at in range(0, len(batch), 512):
                found += _packed(_views(_CACHE, *[c[at : at + 512] for c in columns]))
            yield pd.DataFrame({"own_id": batch["own_id"], "own_hash": batch["own_hash"], "views": found})

    inputs = [c.alias(n) for c, n in zip(_inputs(df.columns, text_column), ("text", "source", "lang", "n_chars"))]
    rows = df.select(F.col(id_column).cast("long").alias("own_id"), _hash(df.columns, text_column).alias("own_hash"), *inputs)
    return written(rows.mapInPandas(run, "own_id long, own_hash long, views binary"), folder)


def surest_of(pool: DataFrame, views, counts: tuple[int, int], sure: float = SURE) -> pd.DataFrame:
    """view, side and views of the rows of pool (views, code) that each view is surest of, `counts` of each class (0, 1) at most, by scoring all.

    Each task keeps its best, so what is sorted in the end are so many rows a task; equal rows count once.
    """

    def run(batches):
        best = {}
        for batch in batches:
            codes, packed = batch["code"].to_numpy(), batch["views"].to_numpy()
            for k, x in enumerate(_split(_unpacked(packed))):
                p = sigmoid(views[k][0] + x @ views[k][1])
                for side, q in ((0, 1 - p), (1, p)):
                    own = pick(q, codes, counts[side], sure)
                    held = best.get((k, side), (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)))
                    score, code, rows = (np.concatenate(c) for c in zip(held, (q[own], codes[own], packed[own])))
                    keep = pick(score, code, counts[side], sure)
                    best[k, side] = score[keep], code[keep], rows[keep]
        for (k, side), (score, code, rows) in best.items():
            yield pd.DataFrame({"view": k, "side": side, "score": score, "code": code, "views": rows})

    found = pool.select("views", "code").mapInPandas(run, "view int, side int, score double, code long, views binary").dropDuplicates(["view", "side", "code"])
    place = F.row_number().over(W.partitionBy("view", "side").orderBy(F.desc("score"), "code"))
    few = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("side") == 0, counts[0]).otherwise(counts[1]))
    return few.select("view", "side", "code", "views").toPandas().sort_values(["view", "side", "code"])


def train(df: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, share: float = SHARE, given: int = GIVEN, sure: float = SURE, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, folder: str | None = None) -> tuple[CoTrained, DataFrame]:
    """The model, and the table of features() that it was fitted on.

    The first fit is on up to `labelled` rows of labels (doc_id, quality), those with the least hashes of their ids. In each of
    `rounds` rounds both views score every document without a label, from its features, and each labels the `share` of them,
    at most `given`, that it is surest of. So what comes to the driver is bounded: `labelled` + 2 * rounds * `given` rows of about 300
    bytes. Documents with any label never get another.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "quality")
    made = features(df, f"{folder}/views", id_column=id_column, text_column=text_column)
    known = labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("own_id")).agg(F.min("quality").cast("double").alias("quality"))
    marked = written(made.join(known, "own_id", "left").select("own_id", "views", F.xxhash64("views").alias("code"), "quality"), f"{folder}/marked")
    given_label = marked.where("quality is not null")
    chosen = least_hashed(given_label.select("own_id").distinct(), "own_id", labelled, seed)
    first = given_label.join(F.broadcast(chosen), "own_id", "left_semi").groupBy("own_id", "quality").agg(F.min("views").alias("views"))
    rows = first.toPandas().sort_values("own_id")
    pool = marked.where("quality is null")
    most = min(float(given), share * pool.count())

    def surest(views, shares):
        counts = tuple(int(most * s) + 1 for s in shares)
        found = surest_of(pool, views, counts, sure)
        return [(*_split(_unpacked(own["views"])), own["side"].to_numpy(float)) for own in (found[found["view"] == k] for k in (0, 1))]

    x = _split(_unpacked(rows["views"]))
    return co_train(*x, rows["quality"].to_numpy(float), surest, rounds, seed), made


SCORES = "p_text double, p_meta double, p_quality double, keep boolean"


def _scored(model: CoTrained, x: np.ndarray) -> pd.DataFrame:
    p = model.probabilities(*_split(x)) if len(x) else np.zeros((0, 3))
    return pd.DataFrame(p, columns=["p_text", "p_meta", "p_quality"]).assign(keep=p[:, 2] > model.threshold)


def scorer(model: CoTrained, columns: list[str], text_column: str = "text"):
    """A column, from whole texts: a struct of p_text, p_meta, p_quality and keep."""

    @F.pandas_udf(SCORES)
    def score(texts: pd.Series, sources: pd.Series, langs: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        parts = [[s.iloc[at : at + 512].tolist() for s in (texts, sources, langs, n_chars)] for at in range(0, len(texts), 512)]
        return pd.concat([_scored(model, _views(_CACHE, *own)) for own in parts], ignore_index=True) if parts else _scored(model, np.zeros((0, 0)))

    return score(*_inputs(columns, text_column))


def quality(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality and keep for every document, each read whole.

    Labels are (doc_id, quality); a null label or id is no label, repeated ones count by the lowest. Null and
    empty texts have a feature of their own; null source or language counts as empty, an n_chars that is null, missing
    or no number as unknown. With labels of one class every row gets that class; without labels all are kept. Ids may
    be null or repeat; rows that are equal get equal scores. Other columns are ignored; an empty table gives no rows.
    Texts are read once and never shuffled; features, a tenth as large, are shuffled once, to meet the labels.
    """
    model, made = train(df, labels, id_column=id_column, text_column=text_column, **options)
    return _decided(model, made).select(F.col("own_id").alias("doc_id"), "own.p_text", "own.p_meta", "own.p_quality", "own.keep")


def _decided(model: CoTrained, made: DataFrame) -> DataFrame:
    """The rows of features() with `own`, a struct of SCORES."""

    @F.pandas_udf(SCORES)
    def score(packed: pd.Series) -> pd.DataFrame:
        return _scored(model, _unpacked(packed))

    return made.select("own_id", "own_hash", score("views").alias("own"))


def keep_good(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None, **options) -> DataFrame:
    """The rows of df that are good enough, with all their columns, whatever their names.

    Nulls, empty and very long texts, ties, repeated rows and tables without rows are as in quality(): rows that agree in
    id, text and metadata stay or go together. Texts reach Python once; what goes is looked up by id and hash.
    """
    folder = folder or work_folder(df.sparkSession, "quality")
    model, made = train(df, labels, id_column=id_column, text_column=text_column, folder=folder, **options)
    gone = _decided(model, made).where("not own.keep").select("own_id", "own_hash")
    return leave_out(df, gone, f"{folder}/gone", id_column=id_column, own_hash=_hash(df.columns, text_column))
