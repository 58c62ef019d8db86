"""Links of op9_near_dedup against all links of a table, found by an exact prefix-filtered join without MinHash.

    python tests/llm/recall_near.py /root/testdata/check_h [words] [percent]

Prints one JSON line: links between different sets, those whose two sides have one component_id, and whether all
documents have the component that the exact links give.
"""

import json
import os
import sys
from collections import defaultdict

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, one at a time."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b"\0".join(words[i : i + k])) for i in range(len(words) - k + 1)), np.uint64))


def links(sets: list[np.ndarray], percent: int):
    """All pairs (i, j), j < i, of different sets with 100 * intersection >= percent * union. Two linked sets share a shingle among the rarest of each."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    held: dict[int, list[int]] = defaultdict(list)
    sizes = np.array([len(s) for s in sets])
    for i in np.argsort(sizes, kind="stable").tolist():
        own = sets[i]
        seen = counts[np.searchsorted(values, own)]
        prefix = own[np.lexsort((own, seen))][: len(own) - -(-percent * len(own) // 100) + 1].tolist()
        near = np.unique(np.array([j for x in prefix for j in held.get(x, ())], np.int64))
        near = near[100 * sizes[near] >= percent * sizes[i]]
        if len(near):
            joined = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            shared = np.add.reduceat((own[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            for j in near[100 * shared >= percent * (sizes[i] + sizes[near] - shared)].tolist():
                yield i, j
        for x in prefix:
            held[x].append(i)


def main(folder: str, words: int, percent: int) -> dict:
    from pyspark.sql import SparkSession

    from tessera.llm import near_dedup

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, words=words, percent=percent).collect()}
    ids, texts = map(list, zip(*docs.select("doc_id", "text").toLocalIterator()))
    spark.stop()
    classes: dict[bytes, list[int]] = defaultdict(list)
    sets, empty = [], []
    for doc, text in zip(ids, texts):
        own = shingles(text, words)
        if not len(own):
            empty.append(doc)
            continue
        key = own.tobytes()
        if key not in classes:
            sets.append(own)
        classes[key].append(doc)
    members = list(classes.values())
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    total = caught = 0
    for i, j in links(sets, percent):
        total += 1
        caught += found[members[i][0]] == found[members[j][0]]
        parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for k, own in enumerate(members):
        least[root(k)] = min([*own, *([least[root(k)]] if root(k) in least else [])])
    exact = {doc: least[root(k)] for k, own in enumerate(members) for doc in own} | {doc: doc for doc in empty}
    return {"table": folder, "words": words, "percent": percent, "documents": len(ids), "sets": len(sets), "links": total, "links in one component": caught, "recall": caught / max(1, total), "documents with the exact component": sum(exact[d] == c for d, c in found.items())}


if __name__ == "__main__":
    given = [int(x) for x in sys.argv[2:4]]
    print(json.dumps(main(sys.argv[1], *(given or (3, 85)))))
