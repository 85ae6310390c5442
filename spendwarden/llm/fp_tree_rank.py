"""Ranked lexical search with a document FP-tree and branch-and-bound.

Documents become term vectors restricted to the items' terms. Blocks of vectors, each with its terms in order of falling
document frequency, form a tree in which vectors that begin with the same terms share a path. Every node carries, for its
subtree, the greatest frequency of each term and the least length factor m; both together bound the score of every document
below. Each item walks the tree depth-first, best child first, and leaves out subtrees whose bound is under its k-th score.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .texts import Words, flat, slices

TOP = 10
ITEMS, ITEM_TERMS = 256, 16_384  # items, and distinct terms of theirs, searched in one pass over the vectors
TREE_DOCS, TREE_ENTRIES = 16_384, 3_000_000  # documents and their terms in one tree
LEAF = 48  # documents below which a subtree is scored and not split
CELLS = 6_000_000  # node maxima held at once; wide vocabularies get larger leaves
NO_ID = 1 << 63  # a document without id comes after all others
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased; null has none."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def item_blocks(items: DataFrame, most: int = ITEMS, terms: int = ITEM_TERMS) -> Iterator[list[tuple]]:
    """(item_id, term counts) of all items that have a term, in blocks of bounded size, one item at least."""
    block, seen = [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        count = Counter(terms_of(r["text"]))
        if not count:
            continue
        if block and (len(block) == most or len(seen | count.keys()) > terms):
            yield block
            block, seen = [], set()
        block.append((r["item_id"], count))
        seen |= count.keys()
    if block:
        yield block


class Vocabulary:
    """The terms of a block of items, found in flat texts by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        size = np.array([len(t) for t in terms])
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(terms), np.uint8)
        value = Words(data, at).hash
        order = np.argsort(value, kind="stable")
        self.hash, self.number, self.start, self.size, self.data = value[order], order, at[:-1][order], size[order], data

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the words that are terms."""
        spot = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        at = np.flatnonzero((self.hash[spot] == w.hash) & (self.size[spot] == w.ends - w.starts))
        spot = spot[at]
        size = self.size[spot]
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        step = np.arange(size.sum()) - np.repeat(first, size)
        other = w.data[np.repeat(w.starts[at], size) + step] != self.data[np.repeat(self.start[spot], size) + step]
        if other.any():
            same = np.add.reduceat(other, first) == 0
            at, spot = at[same], spot[same]
        return at, self.number[spot]


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), term (numbers into terms), tf, of every document with a term; whole texts."""
    vocabulary = Vocabulary(terms)
    width = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = flat(part.column(1))
                w = Words(LOWER[data], at)
                n = np.diff(w.of)
                place, number = vocabulary.find(w)
                text = np.searchsorted(w.of, place, "right") - 1
                key, tf = np.unique(text * width + number, return_counts=True)
                of = np.searchsorted(key // width, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(v)) for v in ((key % width).astype(np.int32), tf.astype(np.int64))]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "term", "tf"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def length_factors(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """25 + (75 n N) div L for each n."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        n = n.astype(object)
    return (25 + 75 * n * documents // length).astype(np.int64)


def part_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Shared paths of documents given as rising term numbers; nodes are stretches of the documents in path order."""

    def __init__(self, term: np.ndarray, tf: np.ndarray, of: np.ndarray, m: np.ndarray, width: int, leaf: int = LEAF):
        path = term.astype(">u4")
        keys = [path[a:b].tobytes() for a, b in zip(of, of[1:], strict=False)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        size = np.diff(of)[self.order]
        self.at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(self.at[-1]) - np.repeat(self.at[:-1] - of[self.order], size)
        self.term, tf, self.m = term[take], tf[take], m[self.order]
        self.part = part_scores(tf, np.repeat(self.m, size))
        shared = np.zeros(max(len(keys) - 1, 0), np.int64)  # terms that neighbours begin with in common
        for i in range(len(shared)):
            a, b = self.term[self.at[i] : self.at[i + 1]], self.term[self.at[i + 1] : self.at[i + 2]]
            short = min(len(a), len(b))
            differ = a[:short] != b[:short]
            shared[i] = differ.argmax() if differ.any() else short
        leaf = max(leaf, -(-2 * len(keys) * width // CELLS))
        self.span, self.kids = [(0, len(keys))], []
        for node, (lo, hi) in enumerate(self.span):  # grows while it is read
            self.kids.append([])
            if hi - lo <= leaf:
                continue
            depth = shared[lo : hi - 1]
            edges = [lo, *(np.flatnonzero(depth == depth.min()) + lo + 1).tolist(), hi]
            start = lo
            for a, b in zip(edges[1:], [*edges[2:], None], strict=False):
                if b is None or b - start > leaf:  # small neighbours stay together
                    self.kids[node].append(len(self.span))
                    self.span.append((start, a))
                    start = a
        top = np.zeros((len(self.span), width), np.int64)
        least = np.zeros(len(self.span), np.int64)
        for node in range(len(self.span) - 1, -1, -1):
            lo, hi = self.span[node]
            kids = self.kids[node]
            least[node] = least[kids].min() if kids else self.m[lo:hi].min()
            if kids:
                top[node] = top[kids].max(0)
            else:
                np.maximum.at(top[node], self.term[self.at[lo] : self.at[hi]], tf[self.at[lo] : self.at[hi]])
        self.bound = part_scores(top, least[:, None])

    def scores(self, node: int, weight: np.ndarray) -> np.ndarray:
        """Exact scores of a node's documents."""
        lo, hi = self.span[node]
        a, b = self.at[lo], self.at[hi]
        return np.add.reduceat(self.part[a:b] * weight[self.term[a:b]], self.at[lo:hi] - a)


def search(tree: Tree, weights: np.ndarray, ids: list[int], best: list[list[tuple]], k: int = TOP) -> int:
    """Adds the tree's documents to each item's heap of its k best (score, -id); returns how many documents were scored.

    A subtree goes only if its bound is below the k-th score, so equal scores are all seen.
    """
    bounds = (tree.bound.astype(float) @ weights.T.astype(float)) * (1 + 1e-11)
    scored = 0
    for i, heap in enumerate(best):
        stack, weight, bound = [0], weights[i], bounds[:, i]
        while stack:
            node = stack.pop()
            if bound[node] <= 0 or (len(heap) == k and bound[node] < heap[0][0]):
                continue
            kids = tree.kids[node]
            if kids:
                stack += sorted(kids, key=bound.__getitem__)
                continue
            lo, hi = tree.span[node]
            scored += hi - lo
            score = tree.scores(node, weight)
            for s in np.flatnonzero(score >= (heap[0][0] if len(heap) == k else 1)):
                entry = (int(score[s]), -ids[tree.order[lo + s]])
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    return scored


def _searched(found: DataFrame, order: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score: the k best of each task's documents."""

    def tree_of(rows: pa.Table) -> tuple[Tree, list[int]]:
        terms, tf = rows.column("term").combine_chunks(), rows.column("tf").combine_chunks()
        size = np.diff(np.asarray(terms.offsets))
        of = np.concatenate([[0], np.cumsum(size)])
        number = order[terms.flatten().to_numpy(zero_copy_only=False)]
        sort = np.argsort(np.repeat(np.arange(len(size)), size) * len(order) + number, kind="stable")
        m = length_factors(rows.column("n").to_numpy(), documents, length)
        tree = Tree(number[sort], tf.flatten().to_numpy(zero_copy_only=False)[sort], of, m, len(order))
        return tree, [NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in weights]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                tree, ids = tree_of(pa.Table.from_batches(held))
                search(tree, weights, ids, best, k)
                held.clear()

        docs = entries = 0
        for batch in batches:
            size = np.diff(np.asarray(batch.column(2).offsets))
            part = (np.cumsum(size) + entries) // TREE_ENTRIES + (np.arange(1, len(size) + 1) + docs) // TREE_DOCS
            for p in np.unique(part):
                here = part == p
                if p and held:
                    flush()
                held.append(batch.filter(pa.array(here & (size > 0))))
                docs, entries = sum(b.num_rows for b in held), sum(len(b.column(2).flatten()) for b in held)
                if docs == 0:
                    held.clear()
        flush()
        rows = [(i, None if -d == NO_ID else -d, s) for i, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item, ties by smaller doc_id.

    Scores, weights and m as in the README. Every row of docs is a document: repeated ids rank on their own, rows without
    id come after others of their score. Rows of items with one id are ranked each for itself. Null and empty texts have
    no terms: such documents count nowhere, such items have no rows. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items):
        terms = sorted(set().union(*(count for _, count in block)))
        found = written(vectors(docs, terms), "vectors")
        documents, length = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            return out
        df = np.zeros(len(terms), np.int64)
        for r in found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # as many rows as the block has terms
            df[r["term"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        order = np.empty(len(terms), np.int64)  # place of each term by falling df
        order[np.lexsort((np.arange(len(terms)), -df))] = np.arange(len(terms))
        number = {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(block), len(terms)), np.int64)
        for i, (_, count) in enumerate(block):
            for t, q in count.items():
                weights[i, order[number[t]]] = q * weight[number[t]]
        near = _searched(found, order, weights, documents, length, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = near.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], "item int, item_id bigint")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most ITEMS names
    return out
