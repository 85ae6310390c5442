"""Lossless similarity join on names.

Two names of lengths p and q reach the cutoff t only if their common subsequence is at least
ceil(t*(p+q)/2) long. From that follow, without losing a match:

* keys: every lost or added letter destroys at most two bigrams, so matching names share a known number of
  bigrams. With the bigrams of a name in rising frequency, the shared ones must include `grams` of a short
  prefix, and every choice of `grams` prefix bigrams becomes one join key. Names too short for this bound use
  what is left after deleting the few letters the cutoff allows. One bigram per key suits small or repetitive
  name sets, two or three suit large and varied ones; a hashed sample of names tells which costs least;
* below a cutoff of 75 a match may destroy every bigram, but the common subsequence is still made of letters both names
  have. There a key is one letter, numbered where it repeats, of the rarest that a name cannot all be without;
* bit signatures: bigrams and letters hashed into bits. Each differing bit needs a differing element, so
  too many differing bits rule a pair out before its text is compared;
* classes: where many names differ only in their digits, a key is held by nearly all of them. A common subsequence is made of
  digits and of other letters, so two names can match only if the texts without digits have a common subsequence that lacks
  at most the lesser number of digits. Names of one such text and one number of digits are a class; classes are compared
  first, and a name then meets the names of classes that may match. Every pair is met once.

Spark groups names by key. A key held by very many names is first combined with the wider keys of the same names
(matching names share one of those too), and what is still crowded is spread over a grid of cells, so that no task
sees a whole hot key. Within a cell signatures are compared as arrays and only surviving pairs are scored, on their whole
texts. Pairs found by keys are made distinct, those found by classes are so already.

Where a name would be sent to very many classes, classes are put into blocks instead and every two blocks make one cell. A name then
goes to as many cells as there are blocks, and the cell is told which of its classes may match.

Pairs may be far more than names. fuzzy_fold hands them, where they are found, to a fold that returns what is wanted of them, so
that they are neither stored nor shuffled.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import common_lengths
from ..session import cut

BUCKETS = 1 << 14  # bound of the frequency table kept on the driver
CELL_ROWS = 4096  # names of one key that one cell may hold
CROWD_CELLS = 64  # a key needing more cells than this is refined first
WIDEST = 3  # bigrams in the refining keys
SAMPLE_NAMES = 20000  # names looked at to choose the key width
PAIR_COST, KEY_COST = 3e-8, 5e-6  # seconds per compared pair and per key row
CLASS_NAMES = 4  # names a class must hold in the mean for classes to be tried
CLASS_PAIRS = 1 << 33  # pairs of classes that may be compared for it
BLOCK_CELLS = 64  # cells' rows that a block of classes may hold
BLOCK_PARTS = 8  # classes of more than this part of a block are split
FEW_NAMES = 128  # names of one side that all names of the other are compared with, without keys
STEP_ROWS, STEP_PAIRS = 1 << 16, 1 << 20
GRAM_WORDS, LETTER_WORDS = 4, 2
GRAM_CUTOFF = 75  # bigrams bound nothing under this
_SIGNATURE = [f"g{i}" for i in range(GRAM_WORDS)] + [f"c{i}" for i in range(LETTER_WORDS)]


def _need(total: int, cutoff: float) -> int:
    """Least common subsequence for two names of this joint length."""
    return math.ceil(cutoff * total / 200.0 - 1e-9)


def _partners(n: int, cutoff: float) -> range:
    t = cutoff / 100.0
    return range(max(1, math.ceil(n * t / (2 - t) - 1e-9)), math.floor(n * (2 - t) / t + 1e-9) + 1)


class _Plan:
    """Key layout for one cutoff, worked out once on the driver."""

    def __init__(self, cutoff: float, grams: int):
        if cutoff <= 0:
            raise ValueError("a cutoff of 0 matches everything")
        self.width = 2 if cutoff >= GRAM_CUTOFF else 1  # bigrams or letters
        self.cutoff, self.grams = cutoff, grams if self.width == 2 else 1
        self.short = max((n for n in range(1, 200) if self._overlap(n) < grams), default=0)
        self._prefix: dict[int, int] = {}
        self._drops: dict[int, int] = {}

    def _overlap(self, n: int, above: int = 0) -> int:
        sizes = [p for p in _partners(n, self.cutoff) if p > above]
        if self.width == 1:
            return min((_need(n + p, self.cutoff) for p in sizes), default=n)
        return min((3 * _need(n + p, self.cutoff) - (n + p) - 1 for p in sizes), default=n)

    def prefix(self, n: int) -> int:
        """Bigrams (or letters) to choose from; 0 for names that only use deletions."""
        if n <= self.short:
            return 0
        if n not in self._prefix:
            all_ = n - self.width + 1
            self._prefix[n] = min(all_, all_ - self._overlap(n, self.short) + self.grams)
        return self._prefix[n]

    def drops(self, n: int) -> int:
        """Letters to delete; -1 where no partner is short."""
        if n not in self._drops:
            sizes = [p for p in _partners(n, self.cutoff) if min(n, p) <= self.short]
            self._drops[n] = max((n - _need(n + p, self.cutoff) for p in sizes), default=-1)
        return self._drops[n]


def _tokens(name: str, width: int) -> list[int]:
    """Hashed letters (width 1) or bigrams (width 2), numbered where they repeat."""
    raw, seen, out = name.encode("utf-32-le", "surrogatepass"), {}, []
    for i in range(len(name) - width + 1):
        h = zlib.crc32(raw[4 * i : 4 * (i + width)])
        k = seen.get(h, 0)
        seen[h] = k + 1
        out.append(h * 64 + min(k, 63) if k else h * 64)
    return out


def _bits(tokens: list[int], words: int) -> list[int]:
    sig = 0
    for t in tokens:
        sig |= 1 << ((t * 0x9E3779B97F4A7C15 >> 20) % (64 * words))
    return [((sig >> (64 * i)) + (1 << 63) & (1 << 64) - 1) - (1 << 63) for i in range(words)]


def _bucket(token: int) -> int:
    return (token * 0x9E3779B97F4A7C15 >> 24) % BUCKETS


def _bucket_batch(width: int):
    return F.pandas_udf(lambda names: pd.Series([[_bucket(t) for t in _tokens(n, width)] + [BUCKETS] for n in names]), "array<int>")


def _text_key(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0xABCDEF)) - (1 << 63)


def _key_maker(plan: _Plan, rarity: np.ndarray):
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    picks: dict[int, list[np.ndarray]] = {}

    def make(name: str) -> list[int]:
        keys: set[int] = set()
        size = plan.prefix(len(name))
        if size >= plan.grams:
            if size not in picks:
                chosen = np.array(list(combinations(range(size), plan.grams)))
                picks[size] = [chosen[:, i] for i in range(plan.grams)]
            rare = np.array(sorted(_tokens(name, plan.width), key=lambda t: (rarity[_bucket(t)], t))[:size], dtype=np.uint64)
            with np.errstate(over="ignore"):
                mixed = sum((rare[p] + f) * f for p, f in zip(picks[size], factors))
                mixed ^= mixed >> np.uint64(29)
            keys.update(mixed.view(np.int64).tolist())
        for d in range(plan.drops(len(name)) + 1):
            keys.update(_text_key("".join(c)) for c in combinations(name, len(name) - d))
        return list(keys)

    return make


def _signer(plan: _Plan | None, rarity: np.ndarray | None):
    """Keys and signatures of names; without a plan only signatures."""
    fields = ["keys", *_SIGNATURE]
    make = _key_maker(plan, rarity) if plan else lambda name: None

    def sign(names: pd.Series) -> pd.DataFrame:
        rows = []
        for name in names:
            grams = _tokens(name, 2)
            rows.append([make(name), *_bits(grams, GRAM_WORDS), *_bits(_tokens(name, 1), LETTER_WORDS)])
        return pd.DataFrame(rows, columns=fields)

    return F.pandas_udf(sign, "keys array<bigint>, " + ", ".join(f"{f} bigint" for f in fields[1:]))


def _keys_only(plan: _Plan, rarity: np.ndarray):
    make = _key_maker(plan, rarity)
    return F.pandas_udf(lambda names: pd.Series([make(n) for n in names]), "array<bigint>")


def _rarity(names: DataFrame, width: int = 2) -> tuple[np.ndarray, int]:
    """How often each bucket of bigrams (or letters) occurs, and the number of names.

    At most BUCKETS + 1 rows reach the driver, whatever the data.
    """
    rows = names.select(F.explode(_bucket_batch(width)("name")).alias("b")).groupBy("b").count().collect()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for b, n in rows:
        out[b] = n
    return out[:BUCKETS], int(out[BUCKETS])


def _choose_grams(names: DataFrame, total: int, cutoff: float, rarity: np.ndarray) -> int:
    """Key width with the least estimated cost; the sample only steers the layout, never the result."""
    if total <= SAMPLE_NAMES or cutoff < GRAM_CUTOFF:
        return 1
    return min(_key_costs(names, total, cutoff, rarity).items(), key=lambda x: x[1])[0]


def _key_costs(names: DataFrame, total: int, cutoff: float, rarity: np.ndarray) -> dict[int, float]:
    """Estimated seconds by key width, from a hashed sample."""
    step = -(-total // SAMPLE_NAMES)
    sample = names.where(F.pmod(F.xxhash64("name"), F.lit(step)) == 0)

    def cost(grams: int) -> float:
        keys = sample.select(F.explode(_keys_only(_Plan(cutoff, grams), rarity)("name")).alias("key"))
        c = F.col("count").cast("double")
        pairs, rows = keys.groupBy("key").count().agg(F.sum(c * (c - 1) / 2), F.sum(c)).first()
        return (pairs or 0) * step * step * PAIR_COST + (rows or 0) * step * KEY_COST

    return {g: cost(g) for g in (1, 2, 3)}


def _pair_columns(held: tuple[str, ...]) -> list[str]:
    return ["left_name", "right_name", "score", *[f"left_{c}" for c in held], *[f"right_{c}" for c in held]]


def _turned(columns: list[str]) -> list[str]:
    """The same columns seen from the other name."""
    other = {"left": "right", "right": "left"}
    return ["_".join([other.get(side, side), *rest]) for side, *rest in (c.split("_", 1) for c in columns)]


def _pair_schema(held: tuple[str, ...]) -> str:
    return "left_name string, right_name string, score double" + "".join(f", {c} bigint" for c in _pair_columns(held)[3:])


class Fold:
    """What becomes of the pairs of one task. open sees a table of names with what is carried along, pairs the matches between its
    rows, each pair of names once in a whole job and in either order where a table is joined with itself; close comes last."""

    schema: str

    def open(self, t: pa.Table) -> None:
        pass

    def pairs(self, left: np.ndarray, right: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def done(self) -> Iterator[pa.RecordBatch]:
        """All pairs of the table were seen."""
        yield from ()


class _Listed(Fold):
    """The pairs themselves, with what is held of either name."""

    def __init__(self, held: tuple[str, ...] = ()):
        self.held, self.schema = held, _pair_schema(held)

    def open(self, t):
        self.columns = [t.column(c).combine_chunks() for c in ("name", *self.held)]

    def pairs(self, left, right, score):
        left, right = pa.array(left), pa.array(right)
        names, *kept = self.columns
        more = [column.take(at) for at in (left, right) for column in kept]
        yield pa.RecordBatch.from_arrays([names.take(left), names.take(right), pa.array(score), *more], names=_pair_columns(self.held))


def _met(cutoff: float, n: np.ndarray, d: np.ndarray, words: list[np.ndarray], texts: Callable, left: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """(rows, other rows, common lengths) of pairs that may match, step by step: bounds before whole texts. Row left[k] meets count[k] rows from begin[k]."""
    size_of = n - d
    upto = np.cumsum(count)
    lo = 0
    while lo < len(left):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + STEP_PAIRS, "right")))
        for at in range(done, upto[hi - 1], STEP_PAIRS):  # one row may have more partners than a step holds
            flat = np.arange(at, min(at + STEP_PAIRS, upto[hi - 1]))
            of = lo + np.searchsorted(upto[lo:hi], flat, "right")
            li, ri = left[of], flat - (upto[of] - count[of]) + begin[of]
            total = size_of[li] + size_of[ri]
            need = np.ceil((n[li] + n[ri]) * (cutoff / 200.0) - 1e-9).astype(np.int64) - np.minimum(d[li], d[ri])
            differ = sum(np.bitwise_count(words[w][li] ^ words[w][ri]).astype(np.int64) for w in range(LETTER_WORDS))
            ok = differ <= total - 2 * need
            li, ri, total, need = li[ok], ri[ok], total[ok], need[ok]
            differ = sum(np.bitwise_count(words[w][li] ^ words[w][ri]).astype(np.int64) for w in range(LETTER_WORDS, len(words)))
            grams = np.maximum(size_of[li] - 1, 0) + np.maximum(size_of[ri] - 1, 0)
            ok = (need <= np.minimum(size_of[li], size_of[ri])) & (differ <= grams - 2 * np.maximum(3 * need - total - 1, 0))
            li, ri, need = li[ok], ri[ok], need[ok]
            if not len(li):
                continue
            lcs = common_lengths(texts(), li, ri)
            ok = lcs >= need
            yield li[ok], ri[ok], lcs[ok]
        lo = hi


_SORTED = [f"c{w}" for w in range(LETTER_WORDS)] + [f"g{w}" for w in range(GRAM_WORDS)]


def _scan_cells(cutoff: float, selfjoin: bool, classes: bool = False, make: Callable[[], Fold] = _Listed, turned: bool = False):
    """Compare signatures cell by cell over rows sorted by (key, i, j, part).

    With classes the rows are texts without digits (d digits left out, n letters with them), and the pairs leave as ids of
    classes that may match. Else they go to a fold; turned: the second part's names are those of the left side.
    """

    def compare(t: pa.Table, fold: Fold | None):
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        part, n = t.column("part").to_numpy(), t.column("n").to_numpy()
        words = [t.column(c).to_numpy().view(np.uint64) for c in _SORTED]
        d = t.column("d").to_numpy() if classes else np.zeros(len(n), dtype=np.int64)
        own, size = t.column("own").to_numpy(), len(key)
        texts = functools.cache(lambda: t.column("name").to_numpy())
        new = np.ones(size, dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], size)
        group = np.cumsum(new) - 1
        ones = np.add.reduceat(part.astype(np.int64), starts)  # rows of the second part come last
        first_right = (ends - ones)[group]
        rows = np.arange(size)
        end = ends[group]
        if selfjoin:  # a cell on the diagonal pairs its rows among themselves
            begin = np.where(i == j, rows + 1, first_right)
            count = np.where((i == j) | (part == 0), end - begin, 0)
        else:
            begin, count = first_right, np.where(part == 0, end - first_right, 0)
        left = np.flatnonzero(count > 0)
        if not len(left):
            return
        if fold:
            fold.open(t)
        for li, ri, lcs in _met(cutoff, n, d, words, texts, left, begin[left], count[left]):
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(own[li]), pa.array(own[ri])], names=["a", "b"])
                continue
            score = 200.0 * lcs / (n[li] + n[ri])
            ok = score >= cutoff
            if not selfjoin:  # names of one class meet both ways
                ok &= (own[li] != own[ri]) | (own[li] < 0) | (texts()[li] < texts()[ri])
            if ok.any():
                li, ri = (ri[ok], li[ok]) if turned else (li[ok], ri[ok])
                yield from fold.pairs(li, ri, score[ok])
        if fold:
            yield from fold.done()

    def scan(batches):
        fold = None if classes else make()
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < STEP_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            tail = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([x == x[-1] for x in tail])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield from compare(t.slice(0, whole).combine_chunks(), fold)
                held, rows = t.slice(whole).to_batches(), t.num_rows - whole
        if rows:
            yield from compare(pa.Table.from_batches(held).combine_chunks(), fold)

    return scan


def _scan_blocks(cutoff: float, selfjoin: bool, make: Callable[[], Fold], turned: bool = False):
    """Compare names block by block over rows sorted by (i, j, part). Rows of part -1 say which classes (own, n) of the two blocks may match."""

    def compare(t: pa.Table, fold: Fold):
        part, own, n = (t.column(c).to_numpy() for c in ("part", "own", "n"))
        near = part < 0
        a, b = own[near], n[near]
        rows = np.flatnonzero(~near)
        if not len(a) or not len(rows):
            return
        alone = selfjoin and t.column("i")[0] == t.column("j")[0]
        t = t.take(pa.array(rows[np.lexsort((own[rows], part[rows]))])).combine_chunks()  # either block by classes
        part, own, n = (t.column(c).to_numpy() for c in ("part", "own", "n"))
        words = [t.column(c).to_numpy().view(np.uint64) for c in _SORTED]
        texts = functools.cache(lambda: t.column("name").to_numpy())
        size = int(np.searchsorted(part, 1))
        start = 0 if alone else size
        first, last = (np.searchsorted(own[:size], a, side) for side in ("left", "right"))
        begin, end = (start + np.searchsorted(own[start:], b, side) for side in ("left", "right"))
        many = last - first
        of = np.repeat(np.arange(len(a)), many)
        left = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(of))
        begin, end = begin[of], end[of]
        if alone:  # names of one class meet once
            begin = np.where(a[of] == b[of], left + 1, begin)
        some = np.flatnonzero(end > begin)
        some = some[np.argsort(left[some], kind="stable")]
        if not len(some):
            return
        fold.open(t)
        for li, ri, lcs in _met(cutoff, n, np.zeros(len(n), dtype=np.int64), words, texts, left[some], begin[some], (end - begin)[some]):
            score = 200.0 * lcs / (n[li] + n[ri])
            ok = score >= cutoff
            if ok.any():
                li, ri = (ri[ok], li[ok]) if turned else (li[ok], ri[ok])
                yield from fold.pairs(li, ri, score[ok])
        yield from fold.done()

    def scan(batches):
        fold, held, at = make(), [], None
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(i)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and (i[lo], j[lo]) != at:
                    yield from compare(pa.Table.from_batches(held).combine_chunks(), fold)
                    held = []
                at = (i[lo], j[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks(), fold)

    return scan


def _fold_rows(make: Callable[[], Fold], held: tuple[str, ...]):
    """A fold over rows of pairs with what is held of either name."""

    def run(batches):
        fold = make()
        for batch in batches:
            sides = [pa.Table.from_arrays([batch.column(f"{side}_{c}") for c in ("name", *held)], names=["name", *held]) for side in ("left", "right")]
            rows = np.arange(batch.num_rows)
            if len(rows):
                fold.open(pa.concat_tables(sides).combine_chunks())
                yield from fold.pairs(rows, rows + len(rows), batch.column("score").to_numpy())
                yield from fold.done()

    return run


def _distinct_names(df: DataFrame, column: str, ids: str | None = None) -> DataFrame:
    if ids:
        return df.where(F.length(column) > 0).groupBy(F.col(column).alias("name")).agg(F.min(ids).alias("first"), F.count("*").alias("rows"))
    return df.select(F.col(column).alias("name")).where(F.length("name") > 0).distinct()


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many partitions as shuffles have. Without a number adaptive execution joins partitions by their bytes, and the
    few bytes of many names, whose comparing takes long, end in one or two tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _in_cells(lk: DataFrame, rk: DataFrame, cell_rows: int, crowded: bool) -> DataFrame:
    """Rows of the same or of two keyed tables with their cells (key, i, j) and part; crowded keys are spread over a grid."""
    same = lk is rk
    one, zero = F.lit(1), F.lit(0)

    def cells(k: DataFrame, name: str) -> DataFrame:
        parts = F.ceil(F.count("*") / cell_rows).cast("int").alias(name)
        return k.groupBy("key").agg(parts).where(F.col(name) > 1)

    if not crowded:
        lrows = lk.withColumns({"i": zero, "j": zero, "part": zero})
        rows = lrows if same else lrows.unionByName(rk.withColumns({"i": zero, "j": zero, "part": one}))
    elif same:
        hot = cells(lk, "p")
        h, g = F.pmod(F.xxhash64("name", "own"), F.coalesce("p", one)).cast("int"), F.col("g")
        spread = lk.join(hot, "key", "left").withColumn("h", h).withColumn("g", F.explode(F.sequence(F.lit(0), F.coalesce("p", one) - 1)))
        rows = spread.withColumn("i", F.least("h", g)).withColumn("j", F.greatest("h", g)).withColumn(
            "part", F.when(F.col("h") > g, 1).otherwise(0)).drop("p", "h", "g")
    else:
        hot = cells(lk, "pl").join(cells(rk, "pr"), "key", "full_outer")

        def grid(k: DataFrame, mine: str, other: str, part: int) -> DataFrame:
            own, across = ("i", "j") if part == 0 else ("j", "i")
            return (
                k.join(hot, "key", "left").withColumn(own, F.pmod(F.xxhash64("name", "own"), F.coalesce(mine, one)).cast("int"))
                .withColumn(across, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
                .withColumn("part", F.lit(part)).drop("pl", "pr")
            )

        rows = grid(lk, "pl", "pr", 0).unionByName(grid(rk, "pr", "pl", 1))
    return (_spread(rows, "key", "i", "j") if crowded else rows.repartition("key", "i", "j")).sortWithinPartitions("key", "i", "j", "part")


def _blocks(lc: DataFrame, rc: DataFrame, cell_rows: int) -> tuple[int, int, float]:
    """Blocks of either side, and rows that sending every name to its cells makes."""
    most = cell_rows * BLOCK_CELLS
    parts = int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if lc is rc:
        rows = lc.agg(F.sum("held")).first()[0] or 0
        k = max(math.ceil(rows / most), math.ceil(math.sqrt(2 * parts)))
        return k, k, float(rows) * k
    left, right = (c.agg(F.sum("held")).first()[0] or 0 for c in (lc, rc))
    k, m = (max(math.ceil(rows / most), math.ceil(math.sqrt(2 * parts))) for rows in (left, right))
    return k, m, float(left) * m + float(right) * k


def _in_blocks(lm: DataFrame, rm: DataFrame, lc: DataFrame, rc: DataFrame, near: DataFrame, blocks: tuple[int, int], part_rows: int) -> DataFrame:
    """Names of either side with their cells (i, j) of two blocks and part, and as part -1 the classes that may match there.

    A class of more than part_rows names is split by hashes of its names, so blocks are of about one size.
    """
    same, (k, m) = lm is rm, blocks
    zero = F.lit(0)

    def pieces(classes: DataFrame, to: str) -> DataFrame:
        return classes.where(F.col("held") > part_rows).select(F.col("own").alias(to), F.ceil(F.col("held") / part_rows).cast("int").alias(f"{to}_pieces"))

    def piece(own: str, place, many: str):
        return F.when(F.col(many).isNull(), F.col(own)).otherwise(F.xxhash64(own, place).bitwiseAND(F.lit((1 << 63) - 1)))

    def split(names: DataFrame, classes: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("name"), F.col("own_pieces")).cast("int")
        return names.join(F.broadcast(pieces(classes, "own")), "own", "left").withColumn("own", piece("own", place, "own_pieces")).drop("own_pieces")

    def block(own: str, many: int):
        return F.pmod(F.xxhash64(own), F.lit(many)).cast("int")

    both = near.join(F.broadcast(pieces(lc, "a")), "a", "left").join(F.broadcast(pieces(rc, "b")), "b", "left")
    both = both.withColumn("s", F.explode(F.sequence(zero, F.coalesce("a_pieces", F.lit(1)) - 1))).withColumn("t", F.explode(F.sequence(zero, F.coalesce("b_pieces", F.lit(1)) - 1)))
    if same:
        both = both.where("a <> b or s <= t")
    both = both.select(piece("a", F.col("s"), "a_pieces").alias("a"), piece("b", F.col("t"), "b_pieces").alias("b")).withColumns({"x": block("a", k), "y": block("b", m)})
    left, right = split(lm, lc).withColumn("h", block("own", k)), None if same else split(rm, rc).withColumn("h", block("own", m))
    if same:
        after = F.col("x") > F.col("y")
        told = both.select(F.when(after, F.col("b")).otherwise(F.col("a")).alias("own"), F.when(after, F.col("a")).otherwise(F.col("b")).alias("n"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        rows = left.withColumn("g", F.explode(F.sequence(zero, F.lit(k - 1)))).withColumns(
            {"i": F.least("h", "g"), "j": F.greatest("h", "g"), "part": F.when(F.col("h") > F.col("g"), 1).otherwise(0)}).drop("h", "g")
        cell, cells = F.expr(f"i * {k} - i * (i - 1) div 2 + j - i"), k * (k + 1) // 2
    else:
        told = both.select(F.col("a").alias("own"), F.col("b").alias("n"), F.col("x").alias("i"), F.col("y").alias("j"))
        rows = left.withColumn("i", F.col("h")).withColumn("j", F.explode(F.sequence(zero, F.lit(m - 1)))).withColumn("part", zero).drop("h").unionByName(
            right.withColumn("j", F.col("h")).withColumn("i", F.explode(F.sequence(zero, F.lit(k - 1)))).withColumn("part", F.lit(1)).drop("h"))
        cell, cells = F.expr(f"i * {m} + j"), k * m
    rows = rows.unionByName(told.withColumn("part", F.lit(-1)), allowMissingColumns=True)
    parts = min(cells, 4 * int(lm.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(parts, F.pmod(cell, F.lit(parts)).cast("int")).sortWithinPartitions("i", "j", "part")


def _by_classes(lnames: DataFrame, rnames: DataFrame, total: int, cutoff: float, cell_rows: int, class_names: int, other_cost,
                held: tuple[str, ...] = (), make: Callable[[], Fold] | None = None) -> DataFrame | None:
    """Scored pairs by classes of names without digits, each once; None if keys are estimated to cost less."""
    same = lnames is rnames
    bare = F.regexp_replace("name", "[0-9]", "")

    def classed(names: DataFrame) -> DataFrame:
        n = F.length("name").cast("bigint")
        return names.select("name", *held, n.alias("n"), bare.alias("bare"), (n - F.length(bare)).alias("d"))

    def distinct_classes(named: DataFrame) -> DataFrame:
        own = F.xxhash64("bare", "d").bitwiseAND(F.lit((1 << 63) - 1))
        return named.groupBy("bare", "d").agg(F.min("n").alias("n"), F.count("*").alias("held")).withColumn("own", own)

    left, right = classed(lnames), classed(rnames)
    lc = cut(distinct_classes(left))
    rc = lc if same else cut(distinct_classes(right))
    nl, nr = lc.count(), rc.count()
    if (nl if same else nl + nr) * class_names > total or nl * nr > CLASS_PAIRS:
        return None
    sign = _signer(None, None)

    def signed(classes: DataFrame) -> DataFrame:
        return classes.select(F.col("bare").alias("name"), "n", "d", "own", F.lit(0).alias("key"), sign("bare").alias("s")).select(
            "name", "n", "d", "own", "key", *[F.col(f"s.{w}").alias(w) for w in _SIGNATURE])

    ls = cut(signed(lc))
    rs = ls if same else cut(signed(rc))
    near = _in_cells(ls, rs, cell_rows, True).mapInArrow(_scan_cells(cutoff, same, True), "a bigint, b bigint")
    if same:  # a class also meets itself
        near = near.unionByName(lc.select(F.col("own").alias("a"), F.col("own").alias("b")))
    near = cut(near)
    sizes = near.join(lc.select(F.col("own").alias("a"), F.col("held").alias("p")), "a").join(rc.select(F.col("own").alias("b"), F.col("held").alias("q")), "b")
    pairs, left_rows, right_rows = sizes.agg(F.sum(F.col("p").cast("double") * F.col("q")), F.sum(F.col("p").cast("double")), F.sum(F.col("q").cast("double"))).first()
    turn = not same and (left_rows or 0) < (right_rows or 0)  # names of one side are repeated for every class they may match: of the side that makes fewer rows
    moved = left_rows if turn else right_rows
    k, m, spread_rows = _blocks(lc, rc, cell_rows)
    blocks = spread_rows < (moved or 0)
    cost = (pairs or 0) * PAIR_COST + min(moved or 0, spread_rows) * KEY_COST / 10
    if cost > 60 and cost > other_cost():
        return None

    def members(named: DataFrame, classes: DataFrame) -> DataFrame:
        rows = _spread(named.join(classes.select("bare", "d", "own"), ["bare", "d"]), "own", "name").select("name", *held, "n", "own", sign("name").alias("s"))
        return cut(rows.select("name", *held, "n", "own", *[F.col(f"s.{w}").alias(w) for w in _SIGNATURE]))

    make = make or functools.partial(_Listed, held)
    lm = members(left, lc)
    rm = lm if same else members(right, rc)
    if blocks:
        return _in_blocks(lm, rm, lc, rc, near, (k, m), max(1, cell_rows * BLOCK_CELLS // BLOCK_PARTS)).mapInArrow(_scan_blocks(cutoff, same, make), make().schema)
    if turn:
        lm, rm, near = rm, lm, near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    anchors = lm.join(near.select(F.col("a").alias("own")).distinct(), "own", "left_semi").withColumn("key", F.col("own"))
    others = rm.join(near.select(F.col("a").alias("key"), F.col("b").alias("own")), "own")
    if not same:  # classes of two tables never are one and the same
        anchors, others = anchors.withColumn("own", F.lit(-1).cast("bigint")), others.withColumn("own", F.lit(-2).cast("bigint"))
    rows = _in_cells(anchors, others.select(*anchors.columns), cell_rows, True)
    return rows.mapInArrow(_scan_cells(cutoff, False, make=make, turned=turn), make().schema)


def fuzzy_pairs(left: DataFrame, left_name: str, right: DataFrame, right_name: str, cutoff: float,
                grams: int | None = None, cell_rows: int = CELL_ROWS, crowd_cells: int = CROWD_CELLS,
                class_names: int = CLASS_NAMES, ids: str | None = None) -> DataFrame:
    """All (left_name, right_name, score) of distinct names with score >= cutoff (percent). No pair is lost.

    With ids, a bigint column of both sides, pairs also say the least id and the number of rows of either name: left_first,
    left_rows, right_first, right_rows. So names of one row need no join to come by their id.
    """
    same = left is right and left_name == right_name
    held = ("first", "rows") if ids else ()
    lnames = cut(_distinct_names(left, left_name, ids))
    rnames = lnames if same else cut(_distinct_names(right, right_name, ids))
    scored = _scored(lnames, rnames, cutoff, grams, cell_rows, crowd_cells, class_names, held)
    if not same:
        return scored
    # both directions, and each name with itself
    columns = _pair_columns(held)
    ways = F.inline(F.array(*[F.struct(*[F.col(c).alias(to) for c, to in zip(way, columns)]) for way in (columns, _turned(columns))]))
    itself = lnames.select(*[F.lit(100.0).alias(c) if c == "score" else F.col(c.split("_", 1)[1]).alias(c) for c in columns])
    return scored.select(ways).unionByName(itself)


def fuzzy_fold(left: DataFrame, right: DataFrame, cutoff: float, make: Callable[[], Fold], grams: int | None = None, cell_rows: int = CELL_ROWS,
               crowd_cells: int = CROWD_CELLS, class_names: int = CLASS_NAMES) -> DataFrame:
    """What folds return for all pairs of names with score >= cutoff (percent). No pair is lost, none is stored.

    left and right are stored tables with a row per name, not empty, and what the fold wants to see of it, both of the same columns.
    One and the same table twice is joined with itself: each pair of two names comes once, in either order, no name with itself.
    """
    return _scored(left, right, cutoff, grams, cell_rows, crowd_cells, class_names, tuple(c for c in left.columns if c != "name"), make)


def fuzzy_fold_within(names: DataFrame, group: str, cutoff: float, make: Callable[[], Fold], cell_rows: int = CELL_ROWS) -> DataFrame:
    """What folds return for all pairs of names of one group (a bigint) with score >= cutoff (percent); a name is once in a group."""
    held = [c for c in names.columns if c not in ("name", group)]
    signed = names.select("name", *held, F.col(group).alias("key"), F.length("name").cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("own"), _signer(None, None)("name").alias("s"))
    rows = cut(signed.select("name", *held, "key", "n", "own", *[F.col(f"s.{w}").alias(w) for w in _SIGNATURE]))
    return _in_cells(rows, rows, cell_rows, True).mapInArrow(_scan_cells(cutoff, True, make=make), make().schema)


def _scored(lnames: DataFrame, rnames: DataFrame, cutoff: float, grams: int | None, cell_rows: int, crowd_cells: int, class_names: int,
            held: tuple[str, ...], make: Callable[[], Fold] | None = None) -> DataFrame:
    """Scored pairs of two tables of names, each once, or what a fold returns for them."""
    same = lnames is rnames
    _Plan(cutoff, 1)  # refuses a cutoff of 0
    both = lnames.select("name") if same else lnames.select("name").unionByName(rnames.select("name"))
    total = both.count()
    rarity = functools.cache(lambda: _rarity(both, _Plan(cutoff, 1).width)[0])
    scored = None
    if not grams and not same and total > cell_rows and min(lnames.count(), rnames.count()) <= FEW_NAMES:
        scored = _by_all(lnames, rnames, cutoff, cell_rows, held, make)
    elif not grams and total > cell_rows:
        cost = lambda: min(_key_costs(both, total, cutoff, rarity()).values()) if cutoff >= GRAM_CUTOFF else math.inf
        scored = _by_classes(lnames, rnames, total, cutoff, cell_rows, class_names, cost, held, make)
    if scored is not None:
        return scored
    grams = grams or _choose_grams(both, total, cutoff, rarity())
    if not make:
        return _by_keys(lnames, rnames, both, total, cutoff, rarity(), grams, cell_rows, crowd_cells, held)
    # keys find a pair more than once: what is carried is joined to the distinct pairs
    ln = lnames.select("name")
    pairs = _by_keys(ln, ln if same else rnames.select("name"), both, total, cutoff, rarity(), grams, cell_rows, crowd_cells)
    l, r = (names.select(*[F.col(c).alias(f"{side}_{c}") for c in ("name", *held)]) for names, side in ((lnames, "left"), (rnames, "right")))
    return pairs.join(l, "left_name").join(r, "right_name").mapInArrow(_fold_rows(make, held), make().schema)


def _by_all(lnames: DataFrame, rnames: DataFrame, cutoff: float, cell_rows: int, held: tuple[str, ...] = (), make: Callable[[], Fold] | None = None) -> DataFrame:
    """Scored pairs where one side has few names: no keys, every signature meets every other one."""
    sign = _signer(None, None)

    def rows(names: DataFrame) -> DataFrame:
        s = _spread(names, "name").select("name", *held, F.length("name").cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("own"), F.lit(0).alias("key"), sign("name").alias("s"))
        return cut(s.select("name", *held, "n", "own", "key", *[F.col(f"s.{w}").alias(w) for w in _SIGNATURE]))

    make = make or functools.partial(_Listed, held)
    return _in_cells(rows(lnames), rows(rnames), cell_rows, True).mapInArrow(_scan_cells(cutoff, False, make=make), make().schema)


def _by_keys(lnames: DataFrame, rnames: DataFrame, both: DataFrame, total: int, cutoff: float, rarity: np.ndarray, grams: int,
             cell_rows: int, crowd_cells: int, held: tuple[str, ...] = ()) -> DataFrame:
    """Scored pairs by keys of rare bigrams or letters, each once."""
    same = lnames is rnames
    sign = _signer(_Plan(cutoff, grams), rarity)

    def keyed(names: DataFrame) -> DataFrame:
        s = names.select("name", *held, F.length("name").cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("own"), sign("name").alias("s"))
        return s.select("name", *held, "n", "own", *[F.col(f"s.{w}").alias(w) for w in _SIGNATURE], F.explode("s.keys").alias("key"))

    crowded = total > cell_rows
    lk = cut(keyed(lnames)) if crowded else keyed(lnames)
    rk = lk if same else (cut(keyed(rnames)) if crowded else keyed(rnames))

    if crowded and cutoff >= GRAM_CUTOFF and grams < WIDEST and total > cell_rows * crowd_cells:
        limit = F.count("*") > cell_rows * crowd_cells
        both_keys = lk.select("key") if same else lk.select("key").unionByName(rk.select("key"))
        packed = cut(both_keys.groupBy("key").agg(limit.alias("much")).where("much").select("key"))
        if not packed.isEmpty():
            wide = _keys_only(_Plan(cutoff, WIDEST), rarity)

            def refined(k: DataFrame) -> DataFrame:
                inside = k.join(packed, "key", "left_semi").withColumn("wide", F.explode(wide("name")))
                return cut(k.join(packed, "key", "left_anti").unionByName(inside.withColumn("key", F.xxhash64("key", "wide")).drop("wide")))

            lk = refined(lk)
            rk = lk if same else refined(rk)

    make = functools.partial(_Listed, held)
    near = _in_cells(lk, rk, cell_rows, crowded).mapInArrow(_scan_cells(cutoff, same, make=make), make().schema)
    if same:
        columns, after = _pair_columns(held), F.col("left_name") > F.col("right_name")
        near = near.select(*[F.when(after, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(columns, _turned(columns))])
    return near.distinct()


def best_matches(pairs: DataFrame, k: int) -> DataFrame:
    """The k best right names per left name: score first, then name."""
    w = Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def fuzzy_join(left: DataFrame, left_name: str, right: DataFrame, right_name: str, cutoff: float,
               how: str = "inner", k: int | None = None) -> DataFrame:
    """Join rows whose names reach the cutoff.

    how: inner (rows of both sides and score), semi / anti (left rows with / without a match).
    k keeps the k best right names per left name.
    """
    pairs = fuzzy_pairs(left, left_name, right, right_name, cutoff)
    if k:
        pairs = best_matches(pairs, k)
    if how in ("semi", "anti"):
        hits = pairs.select(F.col("left_name").alias(left_name)).distinct()
        return left.join(hits, left_name, f"left_{how}")
    clash = (set(left.columns) & set(right.columns)) | ({"left_name", "right_name", "score"} & set(left.columns + right.columns))
    if clash:
        raise ValueError(f"rename columns that clash: {sorted(clash)}")
    return (
        left.join(pairs, left[left_name] == pairs["left_name"])
        .join(right, F.col("right_name") == right[right_name])
        .drop("left_name", "right_name")
    )
