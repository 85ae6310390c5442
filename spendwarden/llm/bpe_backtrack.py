"""Byte-level BPE by backtracking over longest matches, and decoding.

A token sequence is the one that merging gives exactly if every two neighbours would stay apart when merged alone. So a
piece is read from the left: the longest token at the position is taken if it may follow the token before, else the
next shorter one; where none fits, the last token is taken back and the position is closed for good. Positions are closed
at most once, so the work is linear. Whether two tokens may be neighbours is memoised. Bytes are mapped to Latin-1
characters, which the Aho-Corasick automaton of the vocabulary matches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import slices

MEMO = 400_000  # pieces, and token pairs, whose answers a worker keeps
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"  # fixed value: what counts as white space
# fixed value: the splitting pattern for texts of ASCII characters, where letters and digits are known
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class _Memo(dict):
    """Answers of make. When half of MEMO are new, the older half goes; what is still asked for moves on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one rank file; pattern splits a text into pieces that are encoded separately."""

    def __init__(self, ranks: bytes, pattern: str):
        import ahocorasick
        import regex

        tokens = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines()) if a]
        self.bytes_of = dict(tokens)
        self.id_of = {token: i for i, token in tokens}
        self.length = {i: len(token) for i, token in tokens}
        self.left, self.right, self.merged = {}, {}, {}
        self.shorter: dict[int, int | None] = {}
        self.apart = _Memo(lambda pair: self._stay_apart(*pair))
        self.automaton = ahocorasick.Automaton()
        for i, token in sorted(tokens):
            self._learn(i, token)
        for i in self.left:
            token = self.bytes_of[i]
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((j for j in (self.id_of.get(token[:n]) for n in range(len(token) - 1, 0, -1)) if j in self.left), None)
        self.automaton.make_automaton()
        self.reach = max(map(len, self.id_of), default=1)
        self.apart.clear()
        plain = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(plain).findall
        # short ASCII texts dominate; the plain engine splits them alike, but faster
        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == _known_pattern() else self.split
        self.memo = _Memo(self._encode_piece)

    def _learn(self, i: int, token: bytes) -> None:
        """Finds the two tokens whose merge makes this one; tokens that no merge makes stay out and only match whole pieces."""
        if len(token) == 1:
            self.left[i] = self.right[i] = i
            return
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
            if a in self.left and b in self.left and a < i and b < i and self._stay_apart(a, b):
                self.left[i], self.right[i] = a, b
                self.merged[a, b] = i
                return

    def _stay_apart(self, a: int, b: int) -> bool:
        """False if merging the bytes of a and b would join something across their border.

        Merges are undone from the latest back: at each step the later of the two border tokens falls apart, and a merge
        across the border counts only if it comes before the one just undone.
        """
        bound = 1 << 62
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < bound:
                return False
            left_next, right_next = self.right[a], self.left[b]
            if a > b and left_next != a or right_next == b:
                if left_next == a:
                    return True
                bound, a = a, left_next
            else:
                bound, b = b + 1, right_next

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.id_of.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        text, n = raw.decode("latin-1"), len(raw)
        match, shorter, length, apart, reach = self.automaton.iter_long, self.shorter, self.length, self.apart, self.reach
        shut: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        token = next(match(text[:reach]))[1]
        while True:
            while token is not None:
                end = at + length[token]
                if (not shut or end not in shut) and (last < 0 or apart[last, token]):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last = end, token
                if at == n:
                    return struct.pack(f"<{len(out)}I", *out)
                token = next(match(text[at : at + reach]))[1]
            else:
                shut.add(at)
                token = out.pop()  # it ends where no sequence goes on, so a shorter one is tried
                at -= length[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        pieces = (self.split_ascii if text.isascii() else self.split)(text)
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _known_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_codecs: dict[str, Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _vocabulary(docs: DataFrame, path: str | None, pattern: str | None):
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN  # a vocabulary file, not data


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array of int) of every row; null and empty texts have no ids.

    path is a rank file. Columns that docs lacks are left out, others are dropped.
    """
    vocabulary, pattern = _vocabulary(docs, path, pattern)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [codec.encode(t or "") for t in part.column(len(kept)).to_pylist()]
                at = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(np.diff(at).astype(np.int64)), lists], names=[*kept, "n_tokens", "ids"])

    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept), "n_tokens bigint", "ids array<int>"])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text (binary: the bytes of the ids) of rows(doc_id, ids); null ids give no bytes."""
    vocabulary, pattern = _vocabulary(rows, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            raw = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes that they decode to, of every row."""
    vocabulary, pattern = _vocabulary(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
