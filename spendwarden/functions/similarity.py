"""Name similarity: 100 times 2*LCS/(len a + len b), case-sensitive, on whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .addresses import normalize_address


def _lcs_one(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full  # zero bits count the common subsequence
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_many(left: np.ndarray, right: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The same for many pairs at once; left texts of at most 64 letters."""
    n = len(left)
    letters, codes = np.unique(np.concatenate([left.view(np.uint32), right.view(np.uint32)]), return_inverse=True)
    width = left.dtype.itemsize // 4
    a, b = codes[: n * width].reshape(n, width), codes[n * width :].reshape(n, -1)
    rows = np.arange(n)
    masks = np.zeros((n, len(letters)), dtype=np.uint64)
    for k in range(width):
        on = la > k
        masks[rows[on], a[on, k]] |= np.uint64(1 << k)
    row = np.full(n, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(b.shape[1]):
            hit = np.where(lb > k, row & masks[rows, b[:, k]], np.uint64(0))
            row = (row + hit) | (row - hit)
    full = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << (la % 64).astype(np.uint64)) - np.uint64(1))
    return la - np.bitwise_count(row & full).astype(np.int64)


def common_lengths(texts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of texts[left] and texts[right], pair by pair."""
    at, pos = np.unique(np.concatenate([left, right]), return_inverse=True)
    used = texts[at]
    size = np.fromiter(map(len, used), dtype=np.int64, count=len(used))
    li, ri = pos[: len(left)], pos[len(left) :]
    out = np.zeros(len(left), dtype=np.int64)
    usual = (size[li] <= 64) & (size[ri] <= 256)
    for k in np.flatnonzero(~usual):
        out[k] = _lcs_one(used[li[k]], used[ri[k]])
    todo = np.flatnonzero(usual & (size[li] > 0) & (size[ri] > 0))
    if not len(todo):
        return out
    width = int(size[size <= 256].max())
    codes = np.array([t if len(t) <= 256 else "" for t in used], dtype=f"U{width}").view(np.uint32).reshape(len(used), width)
    known = np.zeros(int(codes.max()) + 1, dtype=bool)
    known[codes.ravel()] = True
    rank = np.cumsum(known, dtype=np.int32) - 1
    codes = rank[codes]
    letters = int(rank[-1]) + 1
    own, row_of = np.unique(li, return_inverse=True)
    step = max(1, (1 << 22) // letters)  # rows whose letter masks are held at a time
    order = todo if len(own) <= step else todo[np.argsort(row_of[todo], kind="stable")]
    first = row_of[order]
    for lo in range(0, len(own), step):
        rows = own[lo : lo + step]
        masks = np.zeros((len(rows), letters), dtype=np.uint64)
        for k in range(min(64, width)):
            on = np.flatnonzero((size[rows] > k) & (size[rows] <= 64))
            masks[on, codes[rows[on], k]] |= np.uint64(1 << k)
        mine = order if len(own) <= step else order[np.searchsorted(first, lo) : np.searchsorted(first, lo + step)]
        flat = masks.ravel()
        for a in range(0, len(mine), 1 << 15):
            some = mine[a : a + (1 << 15)]
            base, r = (row_of[some] - lo) * letters, ri[some]
            lb = size[r]
            row = np.full(len(some), ~np.uint64(0))
            with np.errstate(over="ignore"):
                for k in range(int(lb.max())):
                    hit = row & flat[base + codes[r, k]]
                    if (lb <= k).any():
                        hit[lb <= k] = 0
                    row = (row + hit) | (row - hit)
            la = size[li[some]]
            full = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << (la % 64).astype(np.uint64)) - np.uint64(1))
            out[some] = la - np.bitwise_count(row & full).astype(np.int64)
    return out


def _ratio_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    a, b = left.to_numpy(dtype=object)[known], right.to_numpy(dtype=object)[known]
    la = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    lb = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    lcs = np.zeros(len(a), dtype=np.int64)
    usual = (la > 0) & (lb > 0) & (la <= 64) & (lb <= 256)
    for i in np.flatnonzero(~usual):
        lcs[i] = _lcs_one(a[i], b[i])
    todo = np.flatnonzero(usual)
    for lo in range(0, len(todo), 4096):
        at = todo[lo : lo + 4096]
        lcs[at] = _lcs_many(a[at].astype("U"), b[at].astype("U"), la[at], lb[at])
    total = la + lb
    out[known] = np.where(total == 0, 100.0, 200.0 * lcs / np.maximum(total, 1))
    return pd.Series(out).astype("Float64" if np.isnan(out).any() else "float64")


def ratio(a: Column, b: Column) -> Column:
    """Similarity in percent; one Arrow batch at a time."""
    # not deterministic in name only: keeps the planner from running it once per use
    return F.pandas_udf(_ratio_batch, "double").asNondeterministic()(a, b)


def possible(a: Column, b: Column, cutoff: float) -> Column:
    """Cheap bound: lengths alone allow the cutoff. Never false for a true match."""
    la, lb = F.length(a), F.length(b)
    return 200.0 * F.least(la, lb) >= cutoff * (la + lb)


def match_addresses(df: DataFrame, a: str, b: str, out: str, threshold: float = 0.85) -> DataFrame:
    """df with a flag: the addresses are equal after cleaning, or have similar streets and no differing ZIP codes."""
    both = F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False))
    parsed = df.withColumn("_a", normalize_address(F.col(a))).withColumn("_b", normalize_address(F.col(b)))
    known = F.coalesce((F.length("_a.zip_code") > 0) & (F.length("_b.zip_code") > 0), F.lit(False))
    streets = F.coalesce((F.length("_a.street") > 0) & (F.length("_b.street") > 0), F.lit(False))
    scored = parsed.withColumn("_score", ratio(F.col("_a.street"), F.col("_b.street")))
    alike = streets & (F.coalesce("_score", F.lit(0.0)) >= threshold * 100)
    same = F.col("_a.normalized") == F.col("_b.normalized")
    differ = known & (F.col("_a.zip_code") != F.col("_b.zip_code"))
    return scored.withColumn(out, both & (same | (~F.coalesce(differ, F.lit(False)) & alike))).drop("_a", "_b", "_score")
