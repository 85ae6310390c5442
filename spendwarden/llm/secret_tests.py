"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests on long tokens.

A token's encoding is inferred from its characters. Three tests ask whether it looks drawn at random from that alphabet:
chi-squared uniformity, runs above and below the middle of the alphabet, and serial correlation. What passes all three
gets a p-value against ordinary text, the likelihood bound p <= text(token) / uniform(token), which sharpens with length.
Benjamini and Hochberg's rule over all tokens of a length band then holds the share of false discoveries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# fixed values: the base patterns
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so a shorter one holds no longer one
HEX = r"[0-9a-f]{24,}"

# a token is a maximal run of these; where an assignment begins in one, the match goes on through its value
SIGNS = "A-Za-z0-9+/_=-"
TOKEN = rf"(?<![{SIGNS}])(?:[{SIGNS}]*?{ASSIGN.replace('(?i)(?:', '(?i:')}|[{SIGNS}]{{20,}})"
PART = 16  # least length of the parts of a token that are tested by themselves
# fixed values: letter frequencies of running text, in per cent, a to z
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
LOWER, UPPER, DIGIT, SIGN = 0.88, 0.06, 0.03, 0.03  # shares of the kinds of characters in running text
ALPHABETS = (  # pattern, characters in order, size
    (r"^[0-9]+$", "0123456789", 10),
    (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 26),
    (r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 36),
    (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 52),
    (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 62),
    (r"^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64),
    (r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 64),
)
REJECT = 0.001  # each test rejects randomness below this p
FALSE_SHARE = 0.01
STEPS = 4  # evidence is kept in quarters of a natural logarithm
TOP = 4000
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(a: Column) -> Column:
    """0 and the running sums of an array of longs."""
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _starts(lengths: Column) -> Column:
    """Sums of what stands before each element; by blocks, so that long arrays cost no square."""
    cut = F.when(F.size(lengths) == 0, F.array().cast("array<array<bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return _let(cut, lambda blocks: F.flatten(F.zip_with(
        blocks, F.slice(_running(F.transform(blocks, _sum)), F.lit(1), F.size(blocks)),
        lambda block, base: F.transform(F.slice(_running(block), F.lit(1), F.size(block)), lambda x: x + base))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, hit, part>> of a pattern's matches, leftmost and not overlapping, in code points.

    Each match is extracted with the gap before it; the end of the text counts as a last, empty match, so the search is
    linear. part is the group of the match (0: all of it).
    """
    flag = "(?s)"
    both = f"{flag}(.*?)({pattern}|\\z)"
    take = lambda g: F.regexp_extract_all(text, F.lit(both), F.lit(g))
    pieces = F.arrays_zip(take(1).alias("gap"), take(2).alias("hit"), take(2 + group).alias("part"))

    def placed(p: Column) -> Column:
        at = _starts(F.transform(p, lambda x: F.length(x["gap"]).cast("long") + F.length(x["hit"])))
        return F.filter(
            F.zip_with(p, at, lambda x, s: F.struct(
                (s + F.length(x["gap"])).alias("start"), (s + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"), x["part"].alias("part"))),
            lambda x: x["stop"] > x["start"])

    none = F.array().cast("array<struct<start:bigint,stop:bigint,hit:string,part:string>>")
    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(none)


def _pieces(token: Column) -> Column:
    """array<struct<start, hit>> of the parts between a token's separators, where it has any, that are long enough to be tested."""
    cut = F.split(token, "[/=_-]", -1)
    placed = F.zip_with(cut, _starts(F.transform(cut, lambda x: F.length(x).cast("long") + 1)), lambda x, s: F.struct(s.alias("start"), x.alias("hit")))
    none = F.array().cast("array<struct<start:bigint,hit:string>>")
    return F.when(token.rlike("[/=_-]"), F.filter(placed, lambda x: F.length(x["hit"]) >= PART)).otherwise(none)


def _tested(start: Column, hit: Column) -> Column:
    size = F.length(hit)
    return F.struct(start.alias("start"), (start + size).alias("stop"), F.floor(F.log2(size.cast("double"))).cast("int").alias("band"), evidence(hit).alias("evidence"))


def tokens(text: Column) -> Column:
    """array<struct<whole, parts>>: tokens that touch no base span, with band of length and evidence, and their parts between / = _ -.

    A base span of hexadecimal or access kind lies whole in one token, so the token's own text tells; an assignment is
    found by the same search as the tokens, from the token it begins in.
    """
    run = lambda x: F.regexp_extract(x["hit"], f"^[{SIGNS}]+", 0)
    free = F.filter(found(text, TOKEN, 1), lambda x: (F.length(x["part"]) < 6) & (F.length(run(x)) >= 20) & ~run(x).rlike(HEX) & ~run(x).rlike(ACCESS))
    return F.transform(free, lambda x: _let(F.struct(x["start"].alias("start"), run(x).alias("hit")), lambda t: F.struct(
        _tested(t["start"], t["hit"]).alias("whole"), F.transform(_pieces(t["hit"]), lambda p: _tested(t["start"] + p["start"], p["hit"])).alias("parts"))))


def _span(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> of the three fixed kinds, sorted; kind is the place in KINDS."""
    assign = F.filter(found(text, ASSIGN, 1), lambda x: F.length(x["part"]) >= 6)
    return F.sort_array(F.concat(
        F.transform(assign, _span(0)), F.transform(found(text, ACCESS), _span(1)), F.transform(found(text, HEX), _span(2))))


def _log_text() -> list[float]:
    """log probability of each ASCII character in running text."""
    out = [math.log(SIGN / 5)] * 128
    for i, share in enumerate(LETTERS):
        out[97 + i] = math.log(LOWER * share / sum(LETTERS))
        out[65 + i] = math.log(UPPER * share / sum(LETTERS))
    for i in range(48, 58):
        out[i] = math.log(DIGIT / 10)
    return out


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to about 1e-7 (Zelen and Severo's polynomial)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    up = F.exp(-z * z / 2) * F.lit(1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, up).otherwise(F.lit(1.0) - up)


def evidence(token: Column) -> Column:
    """Quarters of -log p against ordinary text, at most TOP; 0 if a test rejects randomness. Long tokens cost their length times 64 at most."""
    which = F.lit(len(ALPHABETS) - 1)
    for i, (pattern, _, _) in reversed(list(enumerate(ALPHABETS[:-1]))):
        which = F.when(token.rlike(pattern), F.lit(i)).otherwise(which)
    order = F.array(*[F.lit(a) for _, a, _ in ALPHABETS])
    size = F.array(*[F.lit(float(n)) for _, _, n in ALPHABETS])
    log_text = F.array(*[F.lit(v) for v in _log_text()])

    def measure(k: Column) -> Column:
        alphabet, wide = F.element_at(order, k["which"] + 1), F.element_at(size, k["which"] + 1)
        # one case only: hexadecimal and base 36 letters are looked up in lower case
        body = F.regexp_replace(F.when(k["which"].isin(1, 4), F.lower(k["token"])).otherwise(k["token"]), "=+$", "")
        return _let(F.struct(body.alias("b"), alphabet.alias("a"), wide.alias("w"), F.filter(F.split(body, ""), lambda c: c != "").alias("c"), k["token"].alias("token")), lambda s: _let(
            F.struct(s["b"].alias("b"), s["w"].alias("w"), s["c"].alias("c"), s["token"].alias("token"), F.size(s["c"]).cast("double").alias("n"),
                     F.transform(s["c"], lambda c: F.instr(s["a"], c).cast("double") - 1).alias("x")), decide))

    def decide(s: Column) -> Column:
        n, w = s["n"], s["w"]
        squares = F.aggregate(F.array_distinct(s["c"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(s["b"]) - F.length(F.replace(s["b"], c, F.lit(""))), F.lit(2)))
        df = w - 1
        chi = w / n * squares - n
        z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (F.lit(1.0) - F.lit(2.0) / (F.lit(9.0) * df))) / F.sqrt(F.lit(2.0) / (F.lit(9.0) * df))
        high = F.aggregate(s["x"], F.lit(0.0), lambda acc, x: acc + F.when(x >= w / 2, 1.0).otherwise(0.0))
        low = n - high
        turns = F.aggregate(
            F.zip_with(F.slice(s["x"], F.lit(1), F.size(s["x"]) - 1), F.slice(s["x"], F.lit(2), F.size(s["x"]) - 1), lambda a, b: F.when((a >= w / 2) != (b >= w / 2), 1.0).otherwise(0.0)),
            F.lit(1.0), lambda acc, x: acc + x)
        mean = F.lit(2.0) * high * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (turns - mean) / F.sqrt(spread)).otherwise(F.lit(9.0))
        middle = F.aggregate(s["x"], F.lit(0.0), lambda acc, x: acc + x) / n
        var = F.aggregate(s["x"], F.lit(0.0), lambda acc, x: acc + (x - middle) * (x - middle))
        along = F.aggregate(
            F.zip_with(F.slice(s["x"], F.lit(1), F.size(s["x"]) - 1), F.slice(s["x"], F.lit(2), F.size(s["x"]) - 1), lambda a, b: a * b - middle * (a + b) + middle * middle),
            F.lit(0.0), lambda acc, x: acc + x)
        z_serial = F.when(var > 0, along / var * F.sqrt(n)).otherwise(F.lit(9.0))
        gain = F.aggregate(F.split(s["token"], ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(-F.log(w) - F.element_at(log_text, F.ascii(c) + 1)))
        fit = (_tail(z_chi) >= REJECT) & (2 * _tail(F.abs(z_runs)) >= REJECT) & (2 * _tail(F.abs(z_serial)) >= REJECT)
        step = F.least(F.greatest(F.floor((gain - math.log(len(ALPHABETS))) * STEPS), F.lit(0)), F.lit(TOP))
        return F.when((n >= 2) & fit, step).otherwise(F.lit(0)).cast("int")

    return _let(F.struct(token.alias("token"), which.alias("which")), measure)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with _base (spans of the fixed kinds) and _tokens (the tokens beside them); null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_base": base_spans(text), "_tokens": tokens(text)})


def cutoffs(scan: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Least evidence that counts as a discovery, by band of length, over all tokens and parts of the corpus.

    At most TOP + 1 counts per band reach the driver.
    """
    every = F.flatten(F.transform("_tokens", lambda t: F.concat(F.array(t["whole"]), t["parts"])))
    counts = scan.select(F.explode(every).alias("t")).groupBy("t.band", "t.evidence").agg(F.count("*").alias("n")).collect()
    out = {}
    for band in {r["band"] for r in counts}:
        steps = sorted(((r["evidence"], r["n"]) for r in counts if r["band"] == band), reverse=True)
        tests, above = sum(n for _, n in steps), 0
        for step, n in steps:
            above += n
            if step > 0 and math.exp(-step / STEPS) <= above * share / tests:
                out[band] = step
    return out


def decided(scan: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """scan with _spans: the base spans and the discoveries (a token, or else its parts), sorted by start, then kind."""
    cut = F.lit(TOP + 1)
    pick = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in sorted(cuts.items()) for v in pair]), t["band"]), cut) if cuts else cut
    more = F.flatten(F.transform("_tokens", lambda t: F.when(t["whole"]["evidence"] >= pick(t["whole"]), F.array(t["whole"])).otherwise(F.filter(t["parts"], lambda x: x["evidence"] >= pick(x)))))
    return scan.withColumn("_spans", F.sort_array(F.concat("_base", F.transform(more, _span(3)))))


def _named(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a text without secrets has empty spans."""
    light = written(scanned(docs).select("doc_id", "_base", "_tokens"), "secrets")
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return decided(light, cutoffs(light)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_named("_base").cast("binary"), 256).alias("base_sha256"), _named("_spans").alias("spans"))


def _running_most(a: Column) -> Column:
    """The greatest of each element and those before it, of an array of longs; by blocks, so that long arrays cost no square."""
    def most(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.try_element_at(acc, F.lit(-1))))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    return _let(blocks, lambda cut: F.flatten(F.zip_with(
        cut, F.concat(F.array(F.lit(None).cast("bigint")), most(F.transform(cut, F.array_max))),
        lambda block, before: F.when(block.isNotNull(), F.transform(most(F.coalesce(block, F.array().cast("array<bigint>"))), lambda v: F.greatest(v, before))).otherwise(F.array().cast("array<bigint>")))))


def merged_spans(spans: Column) -> Column:
    """array<struct<start, stop>>: sorted spans with overlapping ones made one; a span begins anew where it starts at or after the end of all before."""
    def ends(most: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == 1) | (F.element_at(spans, i)["start"] >= F.element_at(most, F.greatest(i - 1, F.lit(1)))))
        return _let(first, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(spans) + 1)), lambda a, b: F.struct(
            F.element_at(spans, a)["start"].alias("start"), F.element_at(most, b - 1).alias("stop"))))

    return _let(_running_most(F.transform(spans, lambda x: x["stop"])), ends)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every secret span replaced by mask and n_chars counted anew; texts without secrets stay as they are.

    Overlapping spans are masked as one. All columns of docs are kept.
    """
    # written, so that texts are scanned once and the two jobs after it have small plans
    scan = written(scanned(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "text")).drop("text"), "secrets")
    rows = decided(scan.withColumn("text", F.col("_row.text")), cutoffs(scan.select("_tokens")))
    # what stands between two masked spans, from the end of one to the start of the next
    kept = lambda m: F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(m, lambda x: x["stop"])),
        F.concat(F.transform(m, lambda x: x["start"]), F.array(F.length("text").cast("long"))),
        lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int")))
    text = F.when(F.size("_spans") == 0, F.col("text")).otherwise(F.array_join(_let(_let(F.col("_spans"), merged_spans), kept), mask))
    rows = rows.select("_row", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept_size = F.col("_row.n_chars")
        new["n_chars"] = F.when(F.col("text").isNull(), kept_size).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
