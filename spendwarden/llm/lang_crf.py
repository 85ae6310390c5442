"""Language identification with a linear-chain conditional random field over words.

Each word has affix, byte n-gram and lexicon features; learned transitions say how readily the language changes from one
word to the next. Forward-backward gives every word of a code-switched text its label; a document's language is the one
with the largest share of the words' posterior mass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, sample_ids, texts_of
from .texts import Words, flat, mix, slices

PER_LANGUAGE = 400  # labelled documents of a language that the model is fitted on
LEXICON = 2000  # commonest words of each language in that sample
BITS = 16
BLOCK = 32  # words of a chain that are run through side by side
SPLICE = 24  # mean length of a one-language stretch in training sequences
SEQUENCES, LENGTH, EPOCHS, BATCH = 2500, 48, 3, 100
MEMBER = np.zeros(256, bool)
MEMBER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
FAMILIAR, DEVIATIONS = 0.15, 3.0  # a text is of no learned language if so many standard deviations fewer of its words are in the lexicon


def words_of(column: pa.Array) -> Words:
    """Words of lower-cased texts: runs of letters; general punctuation and the signs of Latin-1 end a word."""
    data, at = flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    if (data > 127).any():
        data = data.copy()
        for lead, seconds, width in ((0xE2, (0x80, 0x81), 3), (0xC2, range(0x80, 0xC0), 2)):
            i = np.flatnonzero(data == lead)
            i = i[np.isin(data[np.minimum(i + 1, len(data) - 1)], list(seconds))]
            for k in range(width):
                data[i + k] = 32
    return Words(data, at, MEMBER)


class Features:
    """Hashed features of words: affixes per word, n-grams per byte, lexicon words."""

    def __init__(self, w: Words, lexicon: np.ndarray):
        n, size = len(w.starts), w.ends - w.starts
        self.n = n
        data = np.concatenate([w.data, np.zeros(4, np.uint8)]).astype(np.uint32)
        self.affixes = []
        head = np.zeros(n, np.uint64)
        for k in range(4):
            head = head * np.uint64(257) + np.where(size > k, data[w.starts + k] + 1, 0).astype(np.uint64)
            if k:
                self.affixes.append(self._slot(head, 11 + k))
        tail = np.zeros(n, np.uint64)
        for k in range(4):
            tail = tail * np.uint64(257) + np.where(size > k, data[np.maximum(w.ends - 1 - k, 0)] + 1, 0).astype(np.uint64)
            if k:
                self.affixes.append(self._slot(tail, 21 + k))
        # trigrams that begin at each byte of a word and end in it or just past its end
        self.at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(self.at[-1]) - np.repeat(self.at[:-1], size) + np.repeat(w.starts, size)
        left = np.repeat(w.ends, size) - place
        code = (data[place] << 16) | (np.where(left > 1, data[place + 1], 0) << 8) | np.where(left > 2, data[place + 2], 0)
        self.grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
        spot = np.minimum(np.searchsorted(lexicon, w.hash), max(len(lexicon) - 1, 0)) if len(lexicon) else np.zeros(n, np.int64)
        self.entry = np.where(lexicon[spot] == w.hash, spot, len(lexicon)) if len(lexicon) else spot

    @staticmethod
    def _slot(value: np.ndarray, salt: int) -> np.ndarray:
        return (mix(value + np.uint64(salt << 48)) >> np.uint64(64 - BITS)).astype(np.int32)

    def scores(self, affix: np.ndarray, gram: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Log potentials of each word and label from weight tables of shape (labels, slots)."""
        out = np.empty((self.n, len(affix)))
        if self.n:
            for k in range(len(affix)):
                s = np.add.reduceat(gram[k][self.grams], self.at[:-1])
                s = s + entry[k][self.entry]
                for a in self.affixes:
                    s += affix[k][a]
                out[:, k] = s
        return out

    def spread(self, per_word: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the three weight tables from per-word gradients of shape (words, labels)."""
        size = np.diff(self.at)
        affix, gram, entry = [], [], []
        for g in per_word.T:
            affix.append(sum(np.bincount(a, g, slots) for a in self.affixes))
            gram.append(np.bincount(self.grams, np.repeat(g, size), slots))
            entry.append(np.bincount(self.entry, g))
        wide = max(map(len, entry))
        return np.array(affix), np.array(gram), np.array([np.pad(e, (0, wide - len(e))) for e in entry])


def chain(emit: np.ndarray, of: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Posterior of each word's label, for texts with words of[i]:of[i+1]; emit are log potentials, change a matrix of potentials.

    Forward-backward, exact, in blocks of words: each block's transfer matrix is computed side by side with the others',
    the states at block borders are then passed along each text, and last the words inside blocks get their posteriors.
    """
    n, k = emit.shape
    if n == 0:
        return emit.copy()
    e = np.exp(emit - emit.max(1, keepdims=True))
    count = np.diff(of)
    texts = np.flatnonzero(count)
    blocks = -(-count[texts] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    m = first[-1]
    order = np.arange(m) - np.repeat(first[:-1], blocks)
    start = np.repeat(of[texts], blocks) + order * BLOCK
    size = np.minimum(BLOCK, np.repeat(of[texts + 1], blocks) - start)
    steps = np.arange(BLOCK)[:, None]
    inside = steps < size
    at = np.minimum(start + steps, n - 1)
    eb = e[at]
    through = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(BLOCK):
        here = inside[t]
        if here.all():
            through = (through @ change) * eb[t][:, None, :]
        else:
            through[here] = (through[here] @ change) * eb[t][here][:, None, :]
        through /= through.max((1, 2), keepdims=True)
    into, out = np.empty((m, k)), np.empty((m, k))
    rank = np.argsort(-blocks, kind="stable")
    most = blocks[rank]
    state = np.ones((len(texts), k))
    for j in range(most[0]):
        a = np.searchsorted(-most, -j, "left")  # texts with more than j blocks
        b = first[rank[:a]] + j
        into[b] = state[:a]
        s = np.einsum("mk,mkl->ml", state[:a], through[b])
        state[:a] = s / s.sum(1, keepdims=True)
    state = np.ones((len(texts), k))
    for j in range(most[0] - 1, -1, -1):
        a = np.searchsorted(-most, -j, "left")
        b = first[rank[:a]] + j
        out[b] = state[:a]
        s = np.einsum("mkl,ml->mk", through[b], state[:a])
        state[:a] = s / s.sum(1, keepdims=True)
    ahead = np.empty((BLOCK, m, k))
    state = into
    for t in range(BLOCK):
        s = (state @ change) * eb[t]
        s /= s.sum(1, keepdims=True)
        ahead[t] = state = np.where(inside[t][:, None], s, state)
    back = out
    post = np.empty((n, k))
    for t in range(BLOCK - 1, -1, -1):
        here = inside[t]
        p = ahead[t] * back
        p /= p.sum(1, keepdims=True)
        post[at[t][here]] = p[here]
        s = (eb[t] * back) @ change.T
        s /= s.sum(1, keepdims=True)
        back = np.where(here[:, None], s, back)
    return post


class Model:
    """Weights of the field: labels, sorted lexicon hashes, weight tables (labels, slots) and log transitions."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, affix: np.ndarray, gram: np.ndarray, entry: np.ndarray, change: np.ndarray):
        self.labels, self.lexicon, self.affix, self.gram, self.entry, self.change = labels, lexicon, affix, gram, entry, change

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of every word and label, word offsets of the texts)."""
        return self._decode(column)[:2]

    def _decode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = words_of(column)
        f = Features(w, self.lexicon)
        return chain(f.scores(self.affix, self.gram, self.entry), w.of, np.exp(self.change)), w.of, f.entry

    def shares(self, column: pa.Array) -> np.ndarray:
        """Share of each label in the posterior mass of each text; zeros where a text has no words."""
        return self.read(column)[0]

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shares, words, words of the lexicon) of each text."""
        post, of, entry = self._decode(column)
        hits = np.concatenate([[0], np.cumsum(entry < len(self.lexicon))])
        total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0)])
        mass = total[of[1:]] - total[of[:-1]]
        return mass / np.maximum(np.diff(of), 1)[:, None], np.diff(of), hits[of[1:]] - hits[of[:-1]]


def fit(rows: list[tuple], seed: int = 7) -> Model | None:
    """Learns from (doc_id, language, text): sequences are spliced from stretches of single languages, so changes are seen too."""
    labels = sorted({r[1] for r in rows})
    w = words_of(pa.array([r[2] for r in rows], pa.large_string()))
    label_of = np.repeat([labels.index(r[1]) for r in rows], np.diff(w.of)) if rows else np.zeros(0, int)
    labels_with_words = [k for k in range(len(labels)) if (label_of == k).any()]
    if not labels_with_words:
        return None
    if len(labels_with_words) < len(labels):
        kept = [labels[k] for k in labels_with_words]
        return fit([r for r in rows if r[1] in kept], seed)
    lexicon = []
    for k in range(len(labels)):
        value, times = np.unique(w.hash[label_of == k], return_counts=True)
        lexicon.append(value[np.lexsort((value, -times))[:LEXICON]])
    lexicon = np.unique(np.concatenate(lexicon))

    rng = np.random.default_rng(seed)
    pools = [np.flatnonzero(label_of == k) for k in range(len(labels))]
    cut = rng.random((SEQUENCES, LENGTH)) < 1 / SPLICE
    cut[:, 0] = True
    kind = rng.integers(len(labels), size=cut.sum())
    spot = (rng.random(cut.sum()) * np.array([len(p) for p in pools])[kind]).astype(np.int64)
    piece = np.cumsum(cut.ravel()) - 1
    y = kind[piece]
    flat_at = np.flatnonzero(cut.ravel())
    step = np.arange(cut.size) - flat_at[piece]
    x = np.empty(cut.size, np.int64)
    for k, pool in enumerate(pools):
        mine = y == k
        x[mine] = pool[(spot[piece[mine]] + step[mine]) % len(pool)]

    f = Features(w, lexicon)
    size_of_word = np.diff(f.at)
    k, slots = len(labels), 1 << BITS
    tables = [np.zeros((k, slots)), np.zeros((k, slots)), np.zeros((k, len(lexicon) + 1)), np.zeros((k, k))]
    seen = [np.full_like(t, 1e-2) for t in tables]
    of = np.arange(0, BATCH * LENGTH + 1, LENGTH)
    for _ in range(EPOCHS):
        deal = rng.permutation(SEQUENCES).reshape(-1, BATCH)
        for chosen in deal:
            at = (chosen[:, None] * LENGTH + np.arange(LENGTH)).ravel()
            part = Features.__new__(Features)
            part.n = len(at)
            part.affixes = [a[x[at]] for a in f.affixes]
            size = size_of_word[x[at]]
            part.at = np.concatenate([[0], np.cumsum(size)])
            part.grams = f.grams[np.arange(part.at[-1]) - np.repeat(part.at[:-1], size) + np.repeat(f.at[x[at]], size)]
            part.entry = f.entry[x[at]]
            emit, change = part.scores(*tables[:3]), np.exp(tables[3])
            post = chain(emit, of, change)
            truth = np.eye(k)[y[at]]
            pairs = _pairs(emit, change)
            wanted = np.zeros((k, k))
            np.add.at(wanted, (y[at].reshape(BATCH, LENGTH)[:, :-1].ravel(), y[at].reshape(BATCH, LENGTH)[:, 1:].ravel()), 1)
            steps = [*part.spread((truth - post) / BATCH, slots), (wanted - pairs) / BATCH]
            for t, s, g in zip(tables, seen, steps, strict=True):
                g = np.pad(g, ((0, 0), (0, t.shape[1] - g.shape[1]))) - 1e-5 * t
                s += g * g
                t += 0.3 * g / np.sqrt(s)
    return Model(labels, lexicon, *[t.astype(np.float32) for t in tables[:3]], tables[3])


def _pairs(emit: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Expected number of each change of label over sequences of LENGTH words."""
    k = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True)).reshape(BATCH, LENGTH, k)
    ahead = np.empty((LENGTH, BATCH, k))
    state = np.ones((BATCH, k))
    for t in range(LENGTH):
        state = (state @ change) * e[:, t]
        state /= state.sum(1, keepdims=True)
        ahead[t] = state
    back, total = np.ones((BATCH, k)), np.zeros((k, k))
    for t in range(LENGTH - 1, 0, -1):
        right = e[:, t] * back
        p = ahead[t - 1][:, :, None] * change * right[:, None, :]
        total += (p / p.sum((1, 2), keepdims=True)).sum(0)
        back = right @ change.T
        back /= back.sum(1, keepdims=True)
    return total


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits the field on at most per_language labelled documents of each language that aren't held out; None without any."""
    return fit(texts_of(docs, sample_ids(docs.where("text is not null"), "lang", per_language)))


def unfamiliar(words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Texts with significantly fewer words of the lexicon than FAMILIAR of them; a short text never is one."""
    return hits + DEVIATIONS * np.sqrt(words * FAMILIAR * (1 - FAMILIAR)) < words * FAMILIAR


def _labelled(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs as k0, k1, ..., with lang_pred, score and foreign (of no learned language, by its words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of languages alone
    names = [f"k{i}" for i in range(len(keep))]
    read = keep if "text" in keep else [*keep, "text"]
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            batch = batch.rename_columns([f"k{i}" for i in range(len(read))])
            for part in slices(batch, f"k{at}"):
                text = part.column(at)
                lettered = np.array([t is not None and LETTER.search(t) is not None for t in text.to_pylist()], bool)
                label, score, foreign = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if m is not None and lettered.any():
                    share, words, hits = m.read(text)
                    foreign = unfamiliar(words, hits)
                    best = share.max(1)
                    label[lettered] = np.array(m.labels, object)[share.argmax(1)[lettered]]
                    score[lettered] = np.minimum(best[lettered], 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score), pa.array(foreign)], names=[*names, "lang_pred", "score", "foreign"])

    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "lang_pred string", "score double", "foreign boolean"])
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from the whole text.

    score is the label's share of the words' posterior mass. Texts that are null or have no letter, and all texts if no
    model could be learned, are und with score 0. Ties go to the label first in order, as do letters that form no word (a lone sign of Latin-1), with score 0.
    """
    return _labelled(docs, model, ["doc_id"]).select(F.col("k0").alias("doc_id"), "lang_pred", "score")


def known_only(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, that are of learned languages, one or several.

    Texts that are und go, and texts whose words are hardly ever in the lexicon of any language. How many languages were
    learned plays no part, and evenly mixed texts stay. Without a model no text is known.
    """
    rows = _labelled(docs, model, docs.columns).where((F.col("lang_pred") != UNKNOWN) & ~F.col("foreign"))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_report(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return predict(docs, train(docs, per_language)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
