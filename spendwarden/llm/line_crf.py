"""Quality rules with line labels: a linear-chain conditional random field tells content lines from boilerplate.

Each line has features of shape, punctuation, repetition and place; learned transitions say how readily content and
boilerplate follow each other. Viterbi decoding labels the lines of every whole text, and the share of words in content
lines decides whether the document is kept, unless the plain rules have already refused it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_ids, texts_of
from .texts import Words, flat, mix, runs_of, slices

PER_LABEL = 600  # labelled documents of each quality that the field is fitted on
LEAST_SHARE = 0.5  # of the words in content lines
LEAST_WORDS, REPEATED, WINDOW = 20, 30, 8
SEQUENCES, LENGTH, STRETCH, EPOCHS, BATCH = 1500, 32, 8, 6, 100
RIDGE = 0.02  # pulls weights of rare features to nought
BLOCK = 64  # lines of a text that are decoded side by side with other blocks
CONTENT, BOILERPLATE = 0, 1

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
IN_LINE = np.ones(256, bool)
IN_LINE[10] = False


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, STOP, MARK, CRY, BAR, LINK, DIGIT = map(_table, (b"#*$%&|<>", b".!?:;", b".,;:!?", b"!", b"|", b"/@", b"0123456789"))
UPPER, LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
LETTER = UPPER | LOWER
LETTER[128:] = True
HEAD = np.ones(256, bool)  # bytes that begin a character
HEAD[128:192] = False

# edges of the bins of each measure; the last measures are kinds and not numbers
EDGES = {
    "words": (0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5),
    "word length": (2.5, 3.5, 4.5, 6, 8, 12),
    "symbols": (1e-9, 0.01, 0.03, 0.08, 0.2),
    "upper case": (1e-9, 0.02, 0.05, 0.15, 0.5, 0.9),
    "digits": (1e-9, 0.02, 0.1, 0.3),
    "marks": (1e-9, 0.01, 0.03, 0.06, 0.12),
    "cries a word": (1e-9, 0.1, 0.5),
    "bars a word": (1e-9, 0.1, 0.3),
    "links a word": (1e-9, 0.2),
    "same as word before": (1e-9, 0.02, 0.1, 0.3),
    "distinct words": (0.3, 0.5, 0.7, 0.9, 0.9999),
}
KINDS = {"ends": 4, "begins": 4, "equal lines": 4, "equal to line before": 2, "place": 4}
SLOTS = sum(len(e) + 1 for e in EDGES.values()) + sum(KINDS.values())


def _again(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen before, seen later) within the text, for every key."""
    key = mix(keys ^ mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:][same]] = True
    later[order[:-1][same]] = True
    return before, later


class Lines:
    """Lines with a word, and the words, of a slice of whole texts; null counts as empty."""

    def __init__(self, column: pa.Array):
        self.data, self.at = flat(column)
        self.words = Words(self.data, self.at, ~SPACE)
        rows = Words(self.data, self.at, IN_LINE)
        of_word = np.searchsorted(rows.starts, self.words.starts, "right") - 1
        used = np.zeros(len(rows.starts), bool)
        used[of_word] = True
        self.starts, self.ends, self.hash = rows.starts[used], rows.ends[used], rows.hash[used]
        self.line_of_word = (np.cumsum(used) - 1)[of_word]
        self.of = np.searchsorted(self.starts, self.at)
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.of))
        self.size = np.bincount(self.line_of_word, minlength=len(self.starts))
        self.seen, self.later = _again(self.hash, self.text)

    def _per_text(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[of[1:]] - total[of[:-1]]).astype(np.int64)

    def counts(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
        w, data = self.words, self.data
        n = np.diff(w.of)
        windows, of = runs_of(w.hash, w.of, WINDOW)
        text = np.repeat(np.arange(len(n)), np.diff(of))
        before, later = _again(windows, text)
        long = n[text] >= WINDOW
        first = (np.arange(len(windows)) - of[text] + w.of[text])[(before | later) & long]
        covered = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(covered, first, 1)
        np.add.at(covered, first + WINDOW, -1)
        inside = w.inside & HEAD[data] if len(data) else np.zeros(0, bool)
        return {
            "n_words": n.astype(np.int64), "word_chars": self._per_text(inside, self.at), "n_symbols": self._per_text(SYMBOL[data], self.at),
            "n_dup_lines": self._per_text(self.seen, self.of), "n_repeat_words": self._per_text(np.cumsum(covered)[:-1] > 0, w.of),
        }

    def features(self) -> np.ndarray:
        """Slots of the features of each line, one per measure."""
        n, data, w = len(self.starts), self.data, self.words
        if not n:
            return np.zeros((0, len(EDGES) + len(KINDS)), np.int64)
        total = lambda table: np.add.reduceat(np.append(table[data], False).astype(np.int64), np.stack([self.starts, self.ends], 1).ravel())[::2]
        chars = np.maximum(total(HEAD & ~SPACE), 1)
        words = np.maximum(self.size, 1)
        upper, lower = total(UPPER), total(LOWER)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (self.line_of_word[1:] == self.line_of_word[:-1])
        by_line = lambda flags: np.bincount(self.line_of_word, flags, n)
        before, _ = _again(w.hash, self.line_of_word)
        share = {
            "words": self.size, "word length": chars / words, "symbols": total(SYMBOL) / chars, "upper case": upper / np.maximum(upper + lower, 1),
            "digits": total(DIGIT) / chars, "marks": total(MARK) / chars, "cries a word": total(CRY) / words, "bars a word": total(BAR) / words,
            "links a word": total(LINK) / words, "same as word before": by_line(same) / words, "distinct words": 1 - by_line(before) / words,
        }
        first_word = np.searchsorted(self.line_of_word, np.arange(n))
        last_word = np.searchsorted(self.line_of_word, np.arange(n), "right") - 1
        head, tail = data[w.starts[first_word]], data[w.ends[last_word] - 1]
        spot = np.arange(n)
        first, last = spot == self.of[self.text], spot == self.of[self.text + 1] - 1
        next_to = np.zeros(n, bool)
        next_to[1:] = (self.hash[1:] == self.hash[:-1]) & (self.text[1:] == self.text[:-1])
        kind = {
            "ends": np.select([STOP[tail], MARK[tail], LETTER[tail] | DIGIT[tail]], [0, 1, 2], 3),
            "begins": np.select([UPPER[head], LETTER[head], DIGIT[head]], [0, 1, 2], 3),
            "equal lines": self.seen * 2 + self.later, "equal to line before": next_to * 1, "place": first * 2 + last,
        }
        out, base = [], 0
        for name, edges in EDGES.items():
            out.append(base + np.digitize(share[name], edges))
            base += len(edges) + 1
        for name, many in KINDS.items():
            out.append(base + kind[name])
            base += many
        return np.stack(out, 1)


def viterbi(emit: np.ndarray, of: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best labels of texts with lines of[i]:of[i+1]; emit are log potentials of each line, change of each change. Ties go to the first label.

    Blocks of lines are solved side by side for each label before them, the labels at block borders are passed along each text.
    """
    n, k = emit.shape
    if not n:
        return np.zeros(0, np.int64)
    count = np.diff(of)
    texts = np.flatnonzero(count)
    blocks = -(-count[texts] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    m = first[-1]
    step = np.arange(m) - np.repeat(first[:-1], blocks)
    start = np.repeat(of[texts], blocks) + step * BLOCK
    size = np.minimum(BLOCK, np.repeat(of[texts + 1], blocks) - start)
    deep = int(size.max())
    come = np.zeros((deep, m, k, k), np.int8)  # best label before, by label before the block and label here
    reach = np.where((step == 0)[:, None, None], 0.0, change) + emit[start][:, None, :]
    for t in range(1, deep):
        here = np.flatnonzero(size > t)
        ways = reach[here][:, :, :, None] + change
        come[t, here] = ways.argmax(2)
        reach[here] = ways.max(2) + emit[start[here] + t][:, None, :]
    rank = np.argsort(-blocks, kind="stable")
    most = blocks[rank]
    state = np.zeros((len(texts), k))
    enter = np.zeros((m, k), np.int64)  # best label before the block, by label at its end
    for j in range(most[0]):
        b = first[rank[: np.searchsorted(-most, -j, "left")]] + j
        ways = state[: len(b)][:, :, None] + reach[b]
        enter[b] = ways.argmax(1)
        state[: len(b)] = ways.max(1)
    into, out = np.zeros(m, np.int64), np.zeros(m, np.int64)
    label = state.argmax(1)
    for j in range(most[0] - 1, -1, -1):
        many = np.searchsorted(-most, -j, "left")
        b = first[rank[:many]] + j
        out[b] = label[:many]
        into[b] = label[:many] = enter[b, label[:many]]
    found = np.zeros(n, np.int64)
    label = out
    for t in range(deep - 1, -1, -1):
        here = np.flatnonzero(size > t)
        found[start[here] + t] = label[here]
        if t:
            label[here] = come[t, here, into[here], label[here]]
    return found


class Field:
    """Weights (slots, labels) and log transitions."""

    def __init__(self, weight: np.ndarray, change: np.ndarray):
        self.weight, self.change = weight, change

    def emit(self, slots: np.ndarray) -> np.ndarray:
        return self.weight[slots].sum(1)

    def labels(self, lines: Lines) -> np.ndarray:
        return viterbi(self.emit(lines.features()), lines.of, self.change)


def expectations(emit: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each label, expected changes) of sequences of one length: emit has the shape (sequences, lines, labels)."""
    e, a = np.exp(emit - emit.max(2, keepdims=True)), np.exp(change)
    s, n, k = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    state = e[:, 0]
    for t in range(n):
        state = e[:, t] * (state @ a) if t else e[:, 0]
        ahead[:, t] = state = state / state.sum(1, keepdims=True)
    changes = np.zeros((k, k))
    for t in range(n - 1, 0, -1):
        right = e[:, t] * back[:, t]
        both = ahead[:, t - 1][:, :, None] * a * right[:, None, :]
        changes += (both / both.sum((1, 2), keepdims=True)).sum(0)
        left = right @ a.T
        back[:, t - 1] = left / left.sum(1, keepdims=True)
    post = ahead * back
    return post / post.sum(2, keepdims=True), changes


def fit(rows: list[tuple], seed: int = 11) -> Field | None:
    """Learns from (doc_id, quality, text): lines of quality 1 are content, of quality 0 boilerplate.

    Training sequences are spliced from stretches of both, so changes are seen too. None unless both are there.
    """
    lines = Lines(pa.array([r[2] for r in rows], pa.large_string()))
    slots = lines.features()
    label = np.where(np.array([r[1] for r in rows], np.int64)[lines.text] == 1, CONTENT, BOILERPLATE) if len(rows) else np.zeros(0, np.int64)
    pools = [np.flatnonzero(label == k) for k in (CONTENT, BOILERPLATE)]
    if not all(map(len, pools)):
        return None
    rng = np.random.default_rng(seed)
    begin = rng.random((SEQUENCES, LENGTH)) < 1 / STRETCH
    begin[:, 0] = True
    kind = rng.integers(2, size=begin.sum())
    spot = (rng.random(begin.sum()) * np.array([len(p) for p in pools])[kind]).astype(np.int64)
    piece = np.cumsum(begin.ravel()) - 1
    y = kind[piece]
    gone = np.arange(begin.size) - np.flatnonzero(begin.ravel())[piece]
    x = np.empty(begin.size, np.int64)
    for k, pool in enumerate(pools):
        x[y == k] = pool[(spot[piece[y == k]] + gone[y == k]) % len(pool)]
    x, y = x.reshape(SEQUENCES, LENGTH), y.reshape(SEQUENCES, LENGTH)
    weight, change = np.zeros((SLOTS, 2)), np.zeros((2, 2))
    seen = [np.full_like(weight, 1e-2), np.full_like(change, 1e-2)]
    for _ in range(EPOCHS):
        for chosen in rng.permutation(SEQUENCES).reshape(-1, BATCH):
            at, truth = slots[x[chosen]], np.eye(2)[y[chosen]]
            post, changes = expectations(weight[at].sum(2), change)
            off = ((truth - post) / BATCH).reshape(-1, 2)
            which = at.reshape(len(off), -1)
            step = np.stack([np.bincount(which.ravel(), np.repeat(off[:, k], which.shape[1]), SLOTS) for k in (0, 1)], 1) - RIDGE * weight
            wanted = np.zeros((2, 2))
            np.add.at(wanted, (y[chosen][:, :-1].ravel(), y[chosen][:, 1:].ravel()), 1)
            for table, total, g in ((weight, seen[0], step), (change, seen[1], (wanted - changes) / BATCH)):
                total += g * g
                table += 0.3 * g / np.sqrt(total)
    return Field(weight, change)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """Fitted on at most per_label labelled documents of each quality that aren't held out."""
    return fit(texts_of(docs, sample_ids(labels.where("quality in (0, 1)"), "quality", per_label)))


def _judged(docs: DataFrame, field: Field | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs as k0, k1, ..., with the counts, content_share, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    read = keep if "text" in keep else [*keep, "text"]
    at = read.index("text")
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            batch = batch.rename_columns([f"k{i}" for i in range(len(read))])
            for part in slices(batch, f"k{at}"):
                lines = Lines(part.column(at))
                out = lines.counts()
                n = out["n_words"]
                label = model.labels(lines) if model else np.zeros(len(lines.starts), np.int64)
                content = lines._per_text(np.where(label == CONTENT, lines.size, 0), lines.of)
                share = np.where(n > 0, content / np.maximum(n, 1), 0.0)
                failed = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEATED * n)
                more = {**out, "content_share": share, "base_failed": failed, "kept": ~failed & (share >= LEAST_SHARE)}
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, more.values())], names=[*names, *more])

    kinds = [*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "n_words bigint", "word_chars bigint", "n_symbols bigint",
             "n_dup_lines bigint", "n_repeat_words bigint", "content_share double", "base_failed boolean", "kept boolean"]
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, ", ".join(kinds))


def rules_report(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, the counts, content_share (words in content lines), base_failed and kept of every row.

    Null and empty texts have no words and fail the plain rules. Without a field every line is content. Rows with one id
    are judged each for itself; an empty table gives an empty table.
    """
    return _judged(docs, field, ["doc_id"]).withColumnRenamed("k0", "doc_id")


def kept_only(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names."""
    rows = _judged(docs, field, docs.columns).where("kept")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def marked_lines(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, line (from 0, among the lines with a word), content, text of every line with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                lines = Lines(part.column(1))
                label = model.labels(lines) if model else np.zeros(len(lines.starts), np.int64)
                whole = lines.data.tobytes()
                text = [whole[a:b].decode() for a, b in zip(lines.starts, lines.ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(lines.text)), pa.array(np.arange(len(label)) - lines.of[lines.text]), pa.array(label == CONTENT), pa.array(text, pa.string())],
                                                 names=["doc_id", "line", "content", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line bigint, content boolean, text string")
