"""Byte-level BPE by speculation: propose longest matches, check neighbours, merge only what fails.

A sequence of tokens is the BPE encoding of its word exactly if every two neighbours are, on their
own, the encoding of their joined bytes.  So greedy longest matches are proposed for each distinct
word, all pairs of neighbours of a batch are looked up together in a sorted table of verdicts (each
new pair is decided once by exact merging of two tokens), and only words with a failing pair go
through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_view

# The published splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker keeps the encodings of this many distinct words, and of those it kept before them.
KEPT_WORDS = 120_000
NEVER = (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the printable form in which vocabularies of this kind are stored."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file; one instance a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for k, v in [*self.ids.items(), *self.special.items()]:
            self.bytes_of[v] = k
        self.lead = {k[:n] for k in self.ids for n in range(1, len(k) + 1)}
        self.merges = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            a, b = raw(a), raw(b)
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(regex.escape(x.decode()) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[str, tuple[str, int]] = {}
        self.older: dict[str, tuple[str, int]] = {}
        self.merged_words = 0

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first: by scanning if the word is short, else with a heap."""
        part = [self.single[b] for b in word]
        n, merges = len(part), self.merges
        if n <= 40:
            rules = [merges.get(x, NEVER) for x in zip(part, part[1:])]
            while rules:
                best = min(rules)
                if best is NEVER:
                    break
                i = rules.index(best)
                part[i : i + 2] = [best[1]]
                del rules[i]
                if i < len(rules):
                    rules[i] = merges.get((part[i], part[i + 1]), NEVER)
                if i:
                    rules[i - 1] = merges.get((part[i - 1], part[i]), NEVER)
            return part
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, part[i], part[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if part[i] != a or (j := right[i]) >= n or part[j] != b:
                continue
            part[i], part[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get((new, part[k])):
                    heapq.heappush(heap, (m[0], i, new, part[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges.get((part[h], new))):
                heapq.heappush(heap, (m[0], h, part[h], new, m[1]))
        return [x for x in part if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids, lead = [], 0, len(word), self.ids, self.lead
        while at < n:
            if (whole := ids.get(word[at:])) is not None:
                out.append(whole)
                break
            end, best = at + 1, at + 1
            while end < n and word[at : end + 1] in lead:
                end += 1
                if word[at:end] in ids:
                    best = end
            out.append(ids[word[at:best]])
            at = best
        return out

    def _compatible(self, asked: np.ndarray) -> np.ndarray:
        """Verdicts of sorted distinct pairs; those not met before are decided and kept."""
        at = np.searchsorted(self.pairs, asked)
        fresh = asked[(at == len(self.pairs)) | (self.pairs[np.minimum(at, max(0, len(self.pairs) - 1))] != asked)] if len(self.pairs) else asked
        if len(fresh):
            said = []
            for p in fresh.tolist():
                a, b = p >> 32, p & 0xFFFFFFFF
                said.append(self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
            place = np.searchsorted(self.pairs, fresh)
            self.pairs, self.verdicts = np.insert(self.pairs, place, fresh), np.insert(self.verdicts, place, said)
            at = np.searchsorted(self.pairs, asked)
        return self.verdicts[at]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and keep them: word -> (ids joined by commas, number of ids)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [self.greedy(w) for w in raw]
        flat = np.fromiter((x for f in found for x in f), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = np.zeros(len(flat), bool)
        first[np.cumsum(sizes) - sizes] = True
        pairs = (np.concatenate([[0], flat[:-1]]) << 32) | flat
        asked, back = np.unique(pairs[~first], return_inverse=True)
        bad = np.zeros(len(flat), bool)
        bad[~first] = ~self._compatible(asked)[back]
        for i in np.unique(np.repeat(np.arange(len(found)), sizes)[bad]).tolist():
            found[i] = self.exact(raw[i])
            self.merged_words += 1
        for word, f in zip(words, found):
            self.known[word] = ",".join(map(str, f)), len(f)

    def encode(self, texts: list[str]) -> list[tuple[str, int]]:
        """(ids joined by commas, number of ids) of each text."""
        parts, met = [], set()
        special = {k.decode(): (str(v), 1) for k, v in self.special.items()}
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for text in texts:
            if any(s in text for s in special):
                words = []
                for piece in self.apart.split(text):
                    words += [(piece,)] if piece in special else self.split.findall(piece)
            else:
                words = self.split.findall(text)
            parts.append(words)
            met.update(words)
        met.difference_update(known)
        known.update({(s,): v for s, v in special.items()})
        known.update({w: older[w] for w in met if w in older})
        if fresh := [w for w in met if w not in known]:
            self.learn(fresh)
        out = []
        for words in parts:
            got = [known[w] for w in words]
            out.append((",".join([g[0] for g in got]), sum([g[1] for g in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(raw: np.ndarray, at: np.ndarray, limit: int = 1 << 20):
    from .common import groups_of

    for first, last in groups_of(at, limit):
        yield [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[first:last].tolist(), at[first + 1 : last + 1].tolist())]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of docs; a null text has no ids."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [[int(x) for x in s.split(",")] if s else [] for texts in _slices(*text_view(batch.column(1))) for s, _ in c.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs.

    Null and empty texts have no tokens and the digests of the empty string.  Texts of any length are
    encoded whole.  Every row is encoded on its own, so repeated rows and other columns do not matter; an
    empty table gives an empty result.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            counts, digests, back = [], [], []
            for texts in _slices(*text_view(batch.column(1))):
                for joined, n in c.encode(texts):
                    counts.append(n)
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(c.decode(np.fromstring(joined, np.int64, sep=",").tolist() if joined else []).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    from .common import read

    return round_trip(read(spark, sf_dir, "documents"), vocabulary())
