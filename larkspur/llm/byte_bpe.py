"""Byte-level BPE by ranks: a segment tree over the byte positions of a piece.

A text is cut by the vocabulary's pattern.  A piece that is a token is taken whole; in any other, leaf i
of a segment tree holds the rank of the pair of tokens that begins at byte i (nothing where no token
begins), inner nodes the least (rank, position) below, so the root tells the leftmost pair of the
least rank.  A merge updates three leaves - the merged token's, its right neighbour's, which is no
start any more, and the left neighbour's - and their paths: O(n log n) for a piece of n bytes.

The distinct pieces of a batch that are not known yet are merged side by side: trees of one width are
rows of one array, and a step does the next merge of each.  Pieces beyond the widest array have a tree
of their own.  Every row is encoded on its own, in one pass over the table without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepared, text_bytes

#: Above every (rank, position).
NONE = 1 << 62
#: Pairs of a tree that is a row of an array; bits of a position in such a row.
WIDTHS, BITS = (8, 16, 32, 64), 7
#: Trees that are merged side by side.
TREES = 1 << 13
#: A worker keeps the ids of this many pieces, and of those it kept before them; the most characters of one that is kept.
KEPT, KEPT_CHARS = 250_000, 64
#: Pieces that are looked at together; bounds what a very long text takes.
TOGETHER = 1 << 16


class Codec:
    """Encoder and decoder of one file of ranks (token in base64, rank); one instance a worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece of one byte or more by merging alone."""
        n, ranks = len(piece), self.ranks
        pairs, shift = n - 1, n.bit_length()
        width, low = 1 << max(0, (pairs - 1).bit_length()), (1 << shift) - 1
        tree = [NONE] * (2 * width)
        for i in range(pairs):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                tree[width + i] = rank << shift | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, end: int) -> None:
            """The pair that begins at byte i now ends at ``end`` (0: there is none)."""
            rank = ranks.get(piece[i:end]) if end else None
            value, k = NONE if rank is None else rank << shift | i, width + i
            while k and tree[k] != value:
                tree[k] = value
                value, k = min(value, tree[k ^ 1]), k >> 1

        while pairs and (least := tree[1]) < NONE:
            i = least & low
            j = after[i]
            end = after[i] = after[j]
            if j < pairs:
                put(j, 0)
            if end < n:
                before[end] = i
            put(i, after[end] if end < n else 0)
            if before[i] >= 0:
                put(before[i], end)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of the pairs of two tokens, NONE where they do not join."""
        asked = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.joined[at] << BITS | place, NONE)

    def forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 2 to width + 1 bytes, by merging alone, all of them step by step."""
        rows, span = len(pieces), width + 2
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join([x.ljust(span, b"\0") for x in pieces]), np.uint8).reshape(rows, span)
        tokens = self.single[raw]
        place = np.arange(width)
        first = np.where(place < sizes[:, None] - 1, self.leaves(tokens[:, :width], tokens[:, 1 : width + 1], place), NONE)
        tree = np.full((rows, 2 * width), NONE)
        tree[:, width:] = first
        k = width // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        after, before = np.tile(np.arange(1, span + 1), (rows, 1)), np.tile(np.arange(-1, span - 1), (rows, 1))
        alive = np.arange(span) < sizes[:, None]
        tree, tokens, after, before, alive = (x.reshape(-1) for x in (tree, tokens, after, before, alive))
        row = np.flatnonzero(tree[1 :: 2 * width] < NONE)
        while len(row):
            roots, base, size = row * (2 * width), row * span, sizes[row]
            least = tree[roots + 1]
            i, token = least & ((1 << BITS) - 1), least >> BITS
            j = after[base + i]
            end = after[base + j]
            tokens[base + i], after[base + i], alive[base + j] = token, end, False
            before[base + np.minimum(end, span - 1)] = i
            h = before[base + i]
            own = np.where(end < size, self.leaves(token, tokens[base + np.minimum(end, span - 1)], i), NONE)
            left = np.where(h >= 0, self.leaves(tokens[base + np.maximum(h, 0)], token, h), own)
            i, j, h = (roots + width + x for x in (i, np.where(j < width, j, i), np.where(h >= 0, h, i)))
            tree[j], tree[i] = NONE, own
            tree[h] = left
            i, j, h = i - roots, j - roots, h - roots
            k = width
            while k > 1:
                k //= 2
                i, j, h = i >> 1, j >> 1, h >> 1
                for x in (i, j, h):
                    below = roots + 2 * x
                    tree[roots + x] = np.minimum(tree[below], tree[below + 1])
            row = row[tree[roots + 1] < NONE]
        packed = tokens[alive].astype(np.int32).tobytes()
        ends = np.cumsum(alive.reshape(rows, span).sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Distinct pieces with their packed ids."""
        out, wide = {}, {w: [] for w in WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, sys.byteorder)
            elif width := next((w for w in WIDTHS if len(raw) <= w + 1), 0):
                wide[width].append((piece, raw))
            else:
                out[piece] = np.array(self.merged(raw), np.int32).tobytes()
        for width, some in wide.items():
            for at in range(0, len(some), TREES):
                names, raw = zip(*some[at : at + TREES])
                out.update(zip(names, self.forest(raw, width)))
        return out

    def cut(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text in runs of at most ``TOGETHER``."""
        if len(text) <= TOGETHER:
            yield self.split.findall(text)
        else:
            found = (m[0] for m in self.split.finditer(text))
            yield from iter(lambda: list(islice(found, TOGETHER)), [])

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) in order; a long text has several runs, and each text one at least."""
        held, count = [], 0
        for number, text in enumerate(texts):
            for pieces in self.cut(text):
                held.append((number, pieces))
                count += len(pieces)
                if count >= TOGETHER:
                    yield from self._found(held)
                    held, count = [], 0
        yield from self._found(held)

    def _found(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        met = set().union(*(pieces for _, pieces in held)).difference(known)
        known.update({x: older[x] for x in met if x in older})
        fresh = self.learn(met.difference(older))
        known.update(fresh)
        for number, pieces in held:
            yield number, np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)
        for x in [x for x in fresh if len(x) > KEPT_CHARS]:
            del known[x]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in text_bytes(column):
        yield raw.decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of docs; null and empty texts have no ids.  Else as ``round_trip``."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = [np.zeros(0, np.int32)] * batch.num_rows
            for i, run in c.encode(_texts(batch.column(1))):
                ids[i] = np.concatenate([ids[i], run]) if len(ids[i]) else run
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids give no bytes, an id that is no token raises."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    prepared(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs, the second digest over the decoded ids.

    Null and empty texts have no tokens and the digests of the empty string.  Very long texts, and very
    long pieces in them, are encoded whole, some pieces at a time.  Bytes that are no UTF-8 are read as
    replacement characters.  Repeated rows give equal rows; columns other than doc_id and text are not
    looked at; an empty table gives an empty result.
    """

    def run(batches):
        c = codec(path, pattern)
        name = c.names.__getitem__
        for batch in batches:
            rows = batch.num_rows
            counts, told, raw = [0] * rows, [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            for i, run in c.encode(_texts(batch.column(1))):
                ids = run.tolist()
                told[i].update((" " * bool(counts[i] and ids) + " ".join(map(name, ids))).encode())
                raw[i].update(c.decode(ids))
                counts[i] += len(ids)
            digests, back = [x.hexdigest() for x in told], [x.hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    import public_tokenizers

    from .common import read

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
