"""Near-duplicate classes with DartMinHash over weighted five-word shingles.

A text is the weighted set of its shingles, the weight being how often a shingle occurs. Each unit of weight is a region
at which darts are thrown: hashes give their arrival times (a Poisson process) and coordinates. Only arrivals before a
bound that falls with the text's weight are made, about k log k per text, and the earliest per coordinate is kept; two
texts agree in a coordinate with the probability of their weighted Jaccard similarity. Coordinates are joined in bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .store import written
from .texts import Words, flat, mix, runs_of, slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, WIDE = 24, 5  # a pair of similarity 0.8 shares a band with probability 1 - 7e-5
COORDS = BANDS * WIDE
CENTRES = (1, 8)  # members of a bucket that all others are compared with, round by round
SLOTS = 1 << 20  # counters for how common shingles are; they order shingles and never decide results
CELL = 256  # members of one shingle that meet the others in one cell
HOPS = 2  # enough for links to one centre
DARTS = COORDS * (math.log(COORDS) + 2)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every unit of weight, offsets per text): the n-th occurrence of a shingle is a unit of its own.

    Words are lower-cased runs of letters and digits. A text of fewer than five words is one shingle, one without words none.
    """
    w = Words(*flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))))
    shingles, of = runs_of(w.hash, w.of, SHINGLE)
    if not len(shingles):
        return shingles, of
    text = np.repeat(np.arange(len(of) - 1, dtype=np.uint64), np.diff(of))
    key = shingles ^ mix(text + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    begin = np.flatnonzero(new)
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    again = nth > 0
    shingles = shingles.copy()
    shingles[again] = mix(shingles[again] + nth[again].astype(np.uint64) * _GOLDEN)
    return shingles, of


def darts(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Signatures of shape (texts, COORDS): the earliest dart of each coordinate; zeros for texts without units."""
    count = np.diff(of)
    out = np.zeros((len(count), COORDS), np.uint64)
    todo, wanted = np.flatnonzero(count), DARTS
    while len(todo):
        bound = wanted / count[todo]
        at = np.concatenate([[0], np.cumsum(count[todo])])
        pick = np.arange(at[-1]) - np.repeat(at[:-1], count[todo]) + np.repeat(of[todo], count[todo])
        unit, text = hashes[pick], np.repeat(np.arange(len(todo)), count[todo])
        best = np.full(len(todo) * COORDS, np.inf)
        name = np.zeros(len(todo) * COORDS, np.uint64)
        arrival = np.zeros(len(unit))
        turn = 0
        while len(unit):
            turn += 1
            h = mix(unit + np.uint64(turn * int(_GOLDEN) % (1 << 64)))
            arrival = arrival - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            alive = arrival <= bound[text]
            unit, text, arrival, h = unit[alive], text[alive], arrival[alive], mix(h[alive] + np.uint64(1))
            slot = text * COORDS + (h % np.uint64(COORDS)).astype(np.int64)
            np.minimum.at(best, slot, arrival)
            first = arrival == best[slot]
            name[slot[first]] = h[first]
        filled = np.isfinite(best).reshape(-1, COORDS).all(1)
        out[todo[filled]] = name.reshape(-1, COORDS)[filled]
        todo, wanted = todo[~filled], wanted * 2  # a coordinate without dart: throw again for longer
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of each signature."""
    s = signature.reshape(len(signature), BANDS, WIDE)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, s.shape[:2]).copy()
    for i in range(WIDE):
        h = mix(h ^ s[:, :, i])
    return h.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), ka, kb (128-bit value of the weighted set), bands of every row; bands are empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, of = units(part.column(1))
                count = np.diff(of)
                keys = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)])
                    keys.append(pa.array((total[of[1:]] - total[of[:-1]]).view(np.int64)))
                value = bands(darts(hashes, of))[count > 0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((count > 0) * BANDS)]).astype(np.int32)), pa.array(value.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), *keys, lists], names=["doc_id", "n", "ka", "kb", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n bigint, ka bigint, kb bigint, bands array<bigint>")


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of texts in the same place; 0 where both have none."""
    (ha, oa), (hb, ob) = units(a), units(b)
    na, nb = np.diff(oa), np.diff(ob)
    pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    key = mix(np.concatenate([ha, hb]) ^ mix(pair.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    both = np.bincount(pair[order][1:][key[order][1:] == key[order][:-1]], minlength=len(na)) if len(key) else np.zeros(len(na))
    return both / np.maximum(na + nb - both, 1)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs(a, b) whose texts(doc_id, text) have at least that similarity."""
    rows = pairs.hint("merge").join(texts.toDF("a", "ta"), "a").hint("merge").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                yield part.select(["a", "b"]).filter(pa.array(jaccard(part.column(2), part.column(3)) >= least))

    return written(rows.mapInArrow(run, "a bigint, b bigint"), "links")


def _members(reps: DataFrame) -> DataFrame:
    """rep, n, keys (its buckets that hold others too), met (members of these, added up) of the texts that meet others."""
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    per = rows.join(sizes, "key").groupBy("rep", "n").agg(F.collect_list("key").alias("keys"), F.sum("m").alias("met"))
    return written(per, "members")


def _centred(rows: DataFrame, centres: int) -> DataFrame:
    """rows(key, rep, n, met, comp) of the buckets that hold different classes, with the centres of their bucket.

    Centres are the members that meet the most others in all their buckets, one from each of so many hashed parts of
    the bucket. In a group of edited copies that is the text they were made from, to which all are most similar.
    """
    who = F.struct("met", F.bitwise_not("rep").alias("back"), "n", "comp")  # of equal ones the least id
    part = F.pmod(F.xxhash64("rep"), F.lit(centres))
    names = [f"c{i}" for i in range(centres)]
    best = [F.max(F.when(part == i, who)).alias(c) for i, c in enumerate(names)]
    open_ = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *best).where("lo < hi")
    return written(rows.join(open_.select("key", F.array_compact(F.array(*names)).alias("centres")), "key"), "buckets")


def _to_compare(rows: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of members and centres of another class whose sizes let them be so similar."""
    n = F.col("n")
    other = F.filter("centres", lambda c: (c["comp"] != F.col("comp")) & (F.least(n, c["n"]) >= F.lit(least) * F.greatest(n, c["n"])))
    pairs = rows.select("rep", F.explode(other).alias("c")).select("rep", F.bitwise_not("c.back").alias("centre"))
    return pairs.select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _common(left: DataFrame) -> np.ndarray:
    """How many units of left's texts fall into each slot: for single ones 1, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch):
                count += np.bincount(_slot(units(part.column(0))[0]), minlength=SLOTS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["slot", "n"])

    found = left.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(left: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """rep, comp, n, shingle, place, brief: the first places of each text's units, the rarest first, that others have too.

    Two texts of n >= m units and that similarity have least * n of them in common, and 2 * least / (1 + least) * m. Their
    first common one thus stands in the larger text among the first n - least * n + 1, and in the smaller one among the
    fewer places called brief.
    """
    shared = left.sparkSession.sparkContext.broadcast(common)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, of = units(part.column(2))
                count = np.diff(of)
                text = np.repeat(np.arange(len(count)), count)
                often = shared.value[_slot(hashes)]
                order = np.lexsort((hashes, often, text))
                place = np.arange(len(hashes)) - np.repeat(of[:-1], count)
                reach, brief = (count - np.ceil(count * share - 1e-6).astype(np.int64) for share in (least, 2 * least / (1 + least)))
                keep = (place <= reach[text]) & (often[order] > 1)
                of_ = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays([part.column(0).take(of_), part.column(1).take(of_), pa.array(count).take(of_), pa.array(hashes[order][keep].view(np.int64)),
                                                  pa.array(place[keep]), pa.array(place[keep] <= brief[text[keep]])], names=["rep", "comp", "n", "shingle", "place", "brief"])

    return written(left.select("rep", "comp", "text").mapInArrow(run, "rep bigint, comp bigint, n bigint, shingle bigint, place bigint, brief boolean"), "prefixes")


def _left_over(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of the members that rounds have left in buckets of different classes, without loss.

    A join on the rarest shingles of these members; sizes and places say which pairs can still be so similar. The members
    that have a crowded shingle in brief are dealt to cells of about CELL, each of which meets all others.
    """
    open_ = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    who = rows.join(open_, "key").select("rep", "comp").distinct()
    left = written(who.join(texts.toDF("rep", "text").hint("merge"), "rep"), "left")
    rare = _prefixes(left, _common(left), least)
    cells = F.ceil(F.sum(F.col("brief").cast("int")) / CELL).cast("int").alias("cells")
    keys = rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), cells).where("lo < hi and cells > 0").select("shingle", "cells")
    met = written(rare.join(keys, "shingle"), "met")
    one = met.where("brief").withColumn("cell", F.pmod(F.xxhash64("rep"), "cells").cast("int")).drop("brief", "cells")
    all_ = met.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("brief", "cells")
    x, y = one.alias("x"), all_.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep"))
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    can = (F.col("x.n") >= F.lit(least) * F.col("y.n")) & (rest >= F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-6)
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cell") == F.col("y.cell"))
    pairs = x.join(y.hint("merge"), same & smaller & can & (F.col("x.comp") != F.col("y.comp")))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(node, component) after links have tied some components together.

    First everything takes the least id within HOPS links, which is nearly all where links lead to a few centres; what
    links still tie together then becomes one.
    """
    ends = links.join(comps.toDF("a", "src"), "a").join(comps.toDF("b", "dst"), "b").where("src <> dst").select("src", "dst")
    both = written(ends.union(ends.select("dst", "src")).distinct().toDF("a", "b"), "ends")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
    for _ in range(HOPS - 1):
        least = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("up").alias("m"))
        label = label.join(least, F.col("node") == F.col("a")).select("node", F.least("up", "m").alias("up"))
    label = written(label, "groups")
    rest = both.join(label.toDF("a", "src"), "a").join(label.toDF("b", "dst"), "b").where("src < dst").select("src", "dst").distinct()
    top = label.join(connected_components(rest).toDF("up", "top"), "up", "left").select(F.col("node").alias("component"), F.coalesce("top", "up").alias("top"))
    return written(comps.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "groups")


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id of every row: the least doc_id among the documents that links of at least that similarity lead to.

    Texts with the same shingles are one class at once. In each band's bucket every member is compared with the most
    central one, which costs no pairs within the bucket. In buckets that still hold different classes, members are
    compared with some more central ones of other classes. What is left in buckets of different classes is joined
    without loss on rare shingles, so that every pair of a bucket is judged, whatever the centres are like. Every link
    is verified on the whole texts. Texts without words are classes of their own, rows without id have a null class,
    rows of one id count as one document, an empty table gives an empty one, other columns don't matter.
    """
    signed = written(_signed(docs), "signed")
    reps = written(signed.where("n > 0 and doc_id is not null").groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "representatives")
    members = _members(reps)
    met = members.select(F.col("rep").alias("doc_id"))
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met.hint("merge"), "doc_id", "left_semi"), "compared")
    comps = members.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    rows = members.select(F.explode("keys").alias("key"), "rep", "n", "met", F.col("rep").alias("comp"))
    for centres in CENTRES:
        buckets = _centred(rows, centres)
        links = _verified(_to_compare(buckets, least), texts, least)
        rows = buckets.where(~F.exists("centres", lambda c: c["back"] == F.bitwise_not("rep"))).select("key", "rep", "n", "met", "comp")
        if not links.isEmpty():
            comps = _merged(comps, links)
            rows = rows.drop("comp").join(comps.toDF("rep", "comp"), "rep")
    links = _verified(_left_over(rows, texts, least), texts, least)
    if not links.isEmpty():
        comps = _merged(comps, links)
    found = reps.join(comps.toDF("rep", "component"), "rep", "left").select("ka", "kb", "n", F.coalesce("component", "rep").alias("class_id"))
    return signed.join(found, ["ka", "kb", "n"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def first_of_class(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of docs, with all columns, whose id is their class's; rows without id stay."""
    others = classes(docs, least).where("doc_id <> class_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others.hint("merge"), docs["doc_id"].cast("long") == F.col("_other"), "left_anti")
