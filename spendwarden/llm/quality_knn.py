"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space.

Terms are words, character-class trigrams and counts of repeated words and passages. A truncated singular value decomposition of
the labelled sample gives the latent space. The sample's unit vectors are broadcast, every document is compared with all
of them in blocks of exact cosine products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, sample_ids, texts_of
from .texts import Words, flat, mix, runs_of, slices

PER_LABEL = 1500  # labelled documents of each label that vote; with RANK it bounds what is broadcast
RANK = 48
FIT_ROWS = 200  # sample texts whose terms the driver holds at a time
ROUNDS, SETTLED = 300, 1e-12  # rounds for the axes at most, and the error relative to the greatest eigenvalue that ends them
NEIGHBOURS = 25
SHARPNESS = 8  # a neighbour votes with its cosine to this power
GOOD = 0.3
SLOTS = 2048
REPEATS = 4  # repeated and new words, repeated and new passages
WORD_SLOTS, WORD_WEIGHT = 1024, 0.5  # hashed words, and their weight beside the other groups of terms
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CLASS = np.full(256, 31, np.uint32)  # 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, then punctuation
CLASS[[*range(97, 123), *range(128, 256)]] = 0
CLASS[list(range(65, 91))] = 1
CLASS[list(range(48, 58))] = 2
CLASS[[32, 9]] = 3
CLASS[10] = 4
for _i, _c in enumerate(b".,;:!?'\"()[]{}<>|/\\#$%&*+-=@_~"):
    CLASS[_c] = 5 + _i % 26


def _repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many values of each text were seen before in it."""
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    key = mix(keys ^ mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    return np.bincount(text[order][1:][again], minlength=len(of) - 1)


def terms(column: pa.Array) -> np.ndarray:
    """Term weights of whole texts: square roots of shares within each group of terms; a text without bytes has none."""
    data, at = flat(column)
    n = len(at) - 1
    out = np.zeros((n, SLOTS + REPEATS + WORD_SLOTS))
    if not len(data):
        return out
    kind = np.concatenate([CLASS[data], [4, 4]]).astype(np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))  # a text's last trigrams go on with line ends, not with the next text
    second, third = (np.where(left > k, kind[k : len(data) + k], np.uint32(4)) for k in (1, 2))
    code = ((kind[:-2] << np.uint32(10)) | (second << np.uint32(5)) | third) * np.uint32(2654435761) >> np.uint32(32 - 11)
    text = np.repeat(np.arange(n), np.diff(at))
    out[:, :SLOTS] = np.bincount(text * SLOTS + code, minlength=n * SLOTS).reshape(n, SLOTS) / np.maximum(np.diff(at), 1)[:, None]
    w = Words(data, at)
    count = np.diff(w.of)
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.of[:-1][count > 0]] = False
    total = np.concatenate([[0], np.cumsum(same)])
    passages, passage_of = runs_of(w.hash, w.of, 5)
    for place, hits, all_ in ((SLOTS, total[w.of[1:]] - total[w.of[:-1]], count), (SLOTS + 2, _repeated(passages, passage_of), np.diff(passage_of))):
        out[:, place] = hits / np.maximum(all_, 1)
        out[:, place + 1] = np.where(all_ > 0, 1 - out[:, place], 0)
    slot = (mix(Words(LOWER[data], at).hash) >> np.uint64(64 - 10)).astype(np.int64)
    of = np.repeat(np.arange(n), count)
    out[:, SLOTS + REPEATS :] = WORD_WEIGHT**2 * np.bincount(of * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS) / np.maximum(count, 1)[:, None]
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _top_axes(gram: np.ndarray, rank: int) -> np.ndarray:
    """Eigenvectors of the greatest eigenvalues, falling, by iterated subspaces: no copy of the matrix is made, as a full
    decomposition makes four."""
    size = len(gram)
    wide = min(size, 3 * rank)
    base, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((size, wide)))
    for _ in range(ROUNDS):
        image = gram @ base
        values, turn = np.linalg.eigh(base.T @ image)
        order = np.argsort(-values)
        values, axes = values[order][:rank], (base @ turn[:, order])[:, :rank]
        left = np.linalg.norm(image @ turn[:, order[:rank]] - axes * values, axis=0)
        if (left <= SETTLED * max(values[0], 1e-300)).all():
            break
        base, _ = np.linalg.qr(image)
    return axes


class Voters:
    """The latent space (weights and axes) and the labelled unit vectors in it; terms go in slice by slice, none are kept."""

    def __init__(self, column: pa.Array, labels: np.ndarray):
        size, held = SLOTS + REPEATS + WORD_SLOTS, 0
        gram, at_all = np.zeros((size, size)), np.zeros(size)
        parts = [column.slice(i, FIT_ROWS) for i in range(0, len(column), FIT_ROWS)]
        for x in map(terms, parts):
            held += len(x)
            at_all += (x > 0).sum(0)
            for i in range(0, size, FIT_ROWS):
                gram[i : i + FIT_ROWS] += x[:, i : i + FIT_ROWS].T @ x
        self.idf = np.log((1 + held) / (1 + at_all)) + 0.2
        gram *= self.idf
        gram *= self.idf[:, None]
        self.axes = _top_axes(gram, RANK)
        del gram
        self.vectors, self.labels = np.concatenate([self.place(terms(p)) for p in parts]), labels.astype(float)

    def place(self, x: np.ndarray) -> np.ndarray:
        return _unit((x * self.idf) @ self.axes)

    def score(self, column: pa.Array) -> np.ndarray:
        """Share of label 1 in the neighbours' votes; 0 for texts without content and where nothing is similar."""
        near = self.place(terms(column)) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        pick = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, pick, 1), 0) ** SHARPNESS
        total = vote.sum(1)
        return np.round(np.where(total > 0, (vote * self.labels[pick]).sum(1) / np.where(total > 0, total, 1), 0), 6)


def voters(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Voters | None:
    """Learned from at most per_label documents of each label that aren't held out; None if no labelled text is there."""
    rows = texts_of(docs, sample_ids(labels.where("quality in (0, 1)"), "quality", per_label))
    if not rows:
        return None
    column = pa.array([r[2] for r in rows], pa.large_string())
    return Voters(column, np.array([r[1] for r in rows]))


def quality_report(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; without labelled texts every score is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(voters(docs, labels, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                score = model.score(part.column(1)) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
