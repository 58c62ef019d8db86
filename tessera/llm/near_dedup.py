"""Near-duplicates by MinHash.

One pass over the texts makes each document's set of word shingles, minima of many universal hash
functions over it, and a key for each band of minima. Documents with equal sets form a class, and only
classes go on. In each bucket (classes with a band key in common) every class is held against a pivot, the
one that meets most others, on whole sets; what links is joined by large-star and small-star. Where the
classes that a pivot meets still lie in several components they are then compared in blocks, so that no link
within a bucket is lost. Pairs within the pivot's component, which can't change it, and pairs whose sizes rule
a link out are never made.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, in_batches, keep_staying, sieved, small_batches, text_of, work_folder, written
from .components import connected_components

#: Minima in a band, and the most that a link at the threshold may be missed with.
BAND_ROWS = 5
MISS = 1e-6
#: Classes, and shingles of them together, that a block of a hot pivot has on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Words that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 250_000

ROWS = "doc_id long, row long, text_hash long, n_shingles long, key binary, bands array<long>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands that a pair of this similarity shares none of with at most the given probability."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))))


class Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = Words()


def shingle_set(text: str, size: int, words: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; all words as one if there are fewer."""
    found = text.encode("utf-8").lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : n - k + 1 + j]) * _ODD
        h ^= h >> np.uint64(29)
    return np.unique(h)


class MinHash:
    """Band keys of sets: minima of universal functions a*x + b mod 2**64, of which the upper halves count."""

    def __init__(self, bands: int, rows: int = BAND_ROWS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 64, bands * rows, np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands * rows) minima of sets that aren't empty."""
        x, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        out, held = np.empty((len(self.a), len(sets)), np.uint64), np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            np.multiply(x, a, out=held)
            np.add(held, b, out=held)
            out[i] = np.minimum.reduceat(held, starts)
        return out.T >> np.uint64(32)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(sets, bands) 64-bit keys; equal where a band's minima are, and distinct between bands."""
        own = signatures.reshape(len(signatures), self.bands, self.rows)
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), own.shape[:2]).copy()
        for j in range(self.rows):
            h = (h ^ own[:, :, j]) * _ODD
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def _key(own: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; the empty set has none."""
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    small_batches(df.sparkSession)
    text = text_of(text_column)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketch(texts: DataFrame, words: int, bands: int) -> DataFrame:
    """A row for each document (doc_id, text, text_hash): doc_id, row (unique), text_hash, n_shingles, key of its set, and band keys of sets new to the task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hashing, cache, seen = MinHash(bands), claim(_WORDS), set()
        row = TaskContext.get().partitionId() << 40
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

        def some(held):
            nonlocal row
            fresh = [k for k, (*_, own) in enumerate(held) if own is not None]
            keys = dict(zip(fresh, hashing.keys(hashing.signatures([held[k][-1] for k in fresh])))) if fresh else {}
            for k, (doc, text_hash, n, key, _) in enumerate(held):
                yield doc, row, text_hash, n, key, keys.get(k)
                row += 1

        def rows():
            held, size = [], 0
            for batch in batches:
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                for doc, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    own = shingle_set(text.as_py(), words, cache)
                    key = _key(own)
                    known = key is None or key in seen
                    if not known:
                        seen.add(key)
                        if len(seen) > 200_000:
                            seen.clear()
                    held.append((doc, text_hash, len(own), key, None if known else own))
                    size += 0 if known else len(own)
                    if size >= 1 << 16 or len(held) >= 4096:
                        yield from some(held)
                        held, size = [], 0
            yield from some(held)

        yield from in_batches(rows(), schema)

    return texts.mapInArrow(run, ROWS)


def whole_sets(texts: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """vertex and shingles of the classes in wanted (vertex, key, doc_id), made anew from the texts of those documents alone.

    Sets are as large as the texts, and few documents meet any other; so they aren't kept by sketch(). Which
    documents to read is told by a map whose size follows their number; the few that it lets through by
    chance have keys that aren't wanted.
    """

    def run(batches):
        import pyarrow as pa

        cache = claim(_WORDS)
        schema = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int64()))])

        def rows():
            for batch in batches:
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                for text in batch.column(0):
                    own = shingle_set(text.as_py(), words, cache)
                    if len(own):
                        yield _key(own), own.view(np.int64)

        yield from in_batches(rows(), schema, weigh=lambda r: 8 * len(r[1]) + 60)

    few = sieved(texts.select("doc_id", "text"), "doc_id", wanted.select("doc_id"), wanted.count()).where("maybe")
    made = few.select("text").mapInArrow(run, "key binary, shingles array<long>")
    return made.join(wanted.select("vertex", "key").hint("merge"), "key").dropDuplicates(["key"]).select("vertex", "shingles")


def _similar(shared, sizes, percent: int):
    """Whether sets with so many shingles in common, of so many together, are linked."""
    return 100 * shared >= percent * (sizes - shared)


def star_links(spokes: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Those of spokes (pivot, vertex) whose whole sets are similar enough, as edges a, b.

    spokes also have the sizes of both sets, and pairs that these rule out aren't made. A pivot's set goes once to
    each of its chunks, of at most some 256 classes, and chunks are dealt to tasks: a task streams through sorted rows and holds
    the set of one pivot. Pairs and numbers of chunks are tables in `folder`, so that Spark splits the join where a pivot is hot.
    """
    able = spokes.where(100 * F.least("n_shingles", "pivot_shingles") >= percent * F.greatest("n_shingles", "pivot_shingles"))
    a, b = F.least("pivot", "vertex"), F.greatest("pivot", "vertex")
    once = able.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.struct("pivot", "vertex", "n_shingles")).alias("own")).select("own.*")
    once = written(once, f"{folder}/pairs")
    parts = written(once.groupBy("pivot").agg(_blocks().alias("chunks")), f"{folder}/chunks")
    outer = once.join(parts.hint("merge"), "pivot").select("pivot", F.pmod(F.xxhash64("vertex"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("side"), "vertex")
    inner = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("pivot").alias("vertex"))

    def run(batches):
        import pyarrow as pa

        pivot, hub = None, None
        for batch in batches:
            found = []
            pivots, sides, vertices = (batch.column(k).to_pylist() for k in range(3))
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for k, (own, side, vertex) in enumerate(zip(pivots, sides, vertices)):
                shingles = values[ends[k] : ends[k + 1]]
                if not side:
                    pivot, hub = own, shingles.copy()
                elif own == pivot:
                    at = np.minimum(np.searchsorted(hub, shingles), len(hub) - 1)
                    if _similar(int((hub[at] == shingles).sum()), len(hub) + len(shingles), percent):
                        found.append((own, vertex))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    met = outer.unionAll(inner).join(sets.select("vertex", F.array_sort("shingles").alias("shingles")).hint("merge"), "vertex")
    dealt = met.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "side")
    return dealt.select("pivot", "side", "vertex", "shingles").mapInArrow(run, "a long, b long")


def _blocks():
    """Number of blocks for a group of classes (n_shingles each)."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def links_in_block(vertices: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between components in a block, or between its two sides.

    Intersections are counted exactly by products of 0/1 matrices over shingles that two sets share.
    """
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    owner, where = owner[keep], column[where[keep]]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for lo in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(where, [lo, lo + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[a:b], where[a:b] - lo] = 1
        shared += block @ block.T
    sizes = np.array([len(s) for s in sets], np.int64)
    two = sides.min() != sides.max()
    parent = {int(x): int(x) for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for first in range(0, len(sets), 128):  # a few rows at a time, to hold no further matrix of this size
        some = np.arange(first, min(first + 128, len(sets)))
        inter = shared[some].astype(np.int64)
        linked = _similar(inter, sizes[some, None] + sizes[None, :], percent)
        linked &= labels[some, None] != labels[None, :]
        linked &= sides[some, None] < sides[None, :] if two else some[:, None] < np.arange(len(sets))[None, :]
        for i, j in zip(*np.nonzero(linked)):
            a, b = root(int(labels[some[i]])), root(int(labels[j]))
            if a != b:
                parent[a] = b
                found.append((int(vertices[some[i]]), int(vertices[j])))
    return found


def _across(spokes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame | None:
    """Links between components among the classes that meet a pivot (pivot, vertex, n_shingles), None if there is nothing left to compare.

    Any two classes of a bucket meet its pivot, and each has been held against it. So a pivot is done if the
    classes that it meets lie in one component. Otherwise they are dealt to groups, by whether they lie in the pivot's
    component and by size, each size step being the ratio that still allows a link, and groups to blocks. Blocks meet
    if their groups' steps are neighbours and not both lie in the pivot's component.
    """
    own = labels.select(F.col("vertex").alias("pivot"), F.col("label").alias("pivot_label"))
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("long")
    tagged = spokes.join(labels.hint("merge"), "vertex", "left").join(own.hint("merge"), "pivot", "left")
    label, hub = F.coalesce("label", "vertex"), F.coalesce("pivot_label", "pivot")
    tagged = written(tagged.select("pivot", "vertex", "n_shingles", label.alias("label"), (2 * step + (label == hub).cast("long")).alias("of")), f"{folder}/tagged")
    # Groups are combined before they are shuffled, and pivots told from groups: no task meets all classes of a hot pivot.
    every = tagged.groupBy("pivot", "of").agg(_blocks().alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    every = written(every, f"{folder}/every")
    open_ = every.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("pivot")
    groups = written(every.join(open_.hint("merge"), "pivot", "left_semi").select("pivot", "of", "blocks"), f"{folder}/groups")
    if groups.isEmpty():
        return None
    other = groups.select("pivot", F.col("of").alias("to"), F.col("blocks").alias("to_blocks"))
    near = F.abs(F.shiftright("of", 1) - F.shiftright("to", 1)) <= 1
    meet = groups.join(other.hint("merge"), "pivot").where(near & ~((F.col("of") % 2 == 1) & (F.col("to") % 2 == 1)))
    each = tagged.join(meet.hint("merge"), ["pivot", "of"]).withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1)))
    first = F.struct("of", "own") <= F.struct(F.col("to").alias("of"), F.col("other").alias("own"))
    one, two = (lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))), (lambda a, b: F.when(first, F.col(b)).otherwise(F.col(a)))
    each = each.select(
        "pivot", one("of", "to").alias("g"), two("of", "to").alias("h"), one("own", "other").alias("i"), two("own", "other").alias("j"),
        F.when(first, 0).otherwise(1).alias("side"), "vertex", "label",
    )
    each = written(each, f"{folder}/blocks")

    def compare(key, group):
        import pyarrow as pa

        found, labels, sides = [], group["label"].to_numpy(), group["side"].to_numpy()
        _, g, h, i, j = (k.as_py() for k in key)
        if len(np.unique(labels)) > 1 and ((g, i) == (h, j) or sides.min() != sides.max()):
            held = group["shingles"].combine_chunks()
            ends, values = held.offsets.to_numpy(), held.values.to_numpy()
            found = links_in_block(group["vertex"].to_numpy(), labels, sides, [values[x:y] for x, y in zip(ends, ends[1:])], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return each.join(sets.hint("merge"), "vertex").groupBy("pivot", "g", "h", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and stays for every document.

    Texts, A-Z lower-cased, are words `[^\\x20\\x09-\\x0D]+`; a document's set holds its distinct shingles of
    `words` words, all words as one shingle if they are fewer. Documents are linked if
    100 * intersection >= percent * union, confirmed on whole sets. component_id is the smallest id that links
    reach, its own included; kept tells whether that is the document's own id. stays is true for one document of a
    component: the one with the smallest id, then the smallest text_hash.

    Null and empty texts, or white space alone, have the empty set, are linked with nothing, kept and stay. A null id
    is never the smallest, unless all of a component's are null; then component_id is null and all are kept, one stays.
    Rows that repeat an id and text share a component and their decisions. Other columns are ignored; an empty
    table gives no rows. Long texts are hashed whole. A link at the threshold is missed with a probability of
    at most 1e-6, more similar ones far less.

    Copies are one class, so a hot text costs one row a task. Buckets are never listed pair by pair: a class
    meets one pivot a bucket, and blocks of about 256 classes meet only where a pivot meets two components. Joins are by
    sorted shuffles, whatever Spark guesses of their sides; only a bit map of counted size is sent to every task.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "near")
    texts = _texts(df, id_column, text_column)
    rows = written(sketch(texts, words, band_count(percent)), f"{folder}/rows")
    first = F.min(F.when(F.col("bands").isNotNull(), F.struct("row", "doc_id", "bands")))
    top = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_hash"))
    classes = rows.where("key is not null").groupBy("key").agg(top.alias("top"), first.alias("first"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.select("key", "top", "n_shingles", F.col("first.row").alias("vertex"), F.col("first.doc_id").alias("doc_id"), F.col("first.bands").alias("bands")), f"{folder}/classes")
    each = classes.select("vertex", F.explode("bands").alias("bucket"))
    shared = written(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/buckets")
    members = written(each.join(shared.hint("merge"), "bucket"), f"{folder}/members")
    meets = members.groupBy("vertex").agg(F.sum("n").alias("meets"))
    scored = members.join(meets.hint("merge"), "vertex").select("bucket", "vertex", "meets")
    pivots = written(scored.groupBy("bucket").agg(F.max(F.struct("meets", "vertex")).alias("top")).select("bucket", F.col("top.vertex").alias("pivot")), f"{folder}/pivots")
    spokes = members.join(pivots.hint("merge"), "bucket").where("vertex <> pivot").select("pivot", "vertex").distinct()
    sizes = classes.select("vertex", "n_shingles")
    sized = spokes.join(sizes.hint("merge"), "vertex").join(sizes.select(F.col("vertex").alias("pivot"), F.col("n_shingles").alias("pivot_shingles")).hint("merge"), "pivot")
    spokes = written(sized.select("pivot", "vertex", "n_shingles", "pivot_shingles"), f"{folder}/spokes")
    wanted = written(classes.select("vertex", "key", "doc_id").join(members.select("vertex").distinct().hint("merge"), "vertex"), f"{folder}/wanted")
    sets = written(whole_sets(texts, words, wanted), f"{folder}/sets", "snappy")
    labels = written(connected_components(star_links(spokes, sets, percent, folder), f"{folder}/stars"), f"{folder}/labels")
    more = _across(spokes, labels, sets, percent, f"{folder}/across")
    if more is not None:
        stars = labels.select(F.col("vertex").alias("a"), F.col("label").alias("b"))
        labels = written(connected_components(stars.unionAll(more), f"{folder}/joined"), f"{folder}/joined-labels")
    named = classes.join(labels.hint("merge"), "vertex", "left").select("key", "top", F.coalesce("label", "vertex").alias("label"))
    named = written(named, f"{folder}/named")
    least = written(named.groupBy("label").agg(F.min("top").alias("least")), f"{folder}/least")  # a table, so that Spark splits the join of a hot label
    found = written(named.join(least.hint("merge"), "label").select("key", "least"), f"{folder}/found")
    out = rows.select("doc_id", "n_shingles", "text_hash", "key").join(found.hint("merge"), "key", "left")
    lone = F.col("key").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", (lone | kept & (F.col("text_hash") == F.col("least.text_hash"))).alias("stays"))


def keep_first(df: DataFrame, decisions: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of df that stay by near_duplicates(), one of each component, with all their columns, whatever their names.

    Rows without shingles (null and empty texts, white space) stay. Rows that repeat an id and text are one row; rows
    that share an id but not the text are decided each for itself, null ids too. A table without rows gives none.
    """
    return keep_staying(df, decisions, folder or work_folder(df.sparkSession, "near-stay"), id_column=id_column, text_column=text_column)
