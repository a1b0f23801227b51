"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

    P(w | v) = a_b c(v, w) / c(v) + d_b c(w) / N + e_b / (V + 1)

The weights (a, d, e) depend on the bucket b = floor(log2 c(v)) of the context; every context has
its bigrams, whatever its frequency.  The weights are learned by expectation-maximisation on counts
from which the token at hand has been deleted (each training token is held out from its own
estimate), gathered over all training tokens as a table of bucket and quantised probabilities.

Everything counted is counted over all training documents.  Tokens are 64-bit hashes.  Tasks
aggregate what they read into sorted arrays, one per model part, and Spark shuffles those:

1. counts of tokens, by parts of the hash; N, V, and the frequent tokens (a bounded table, broadcast:
   it spreads the pairs of frequent tokens, and changes no result);
2. every chunk of documents asks the parts about its pairs (context v, token w): two frequent tokens
   go to the part of the pair's hash, a rare token to its own part, and a frequent token behind a
   rare context to that of the context.  These parts have the counts that the broadcast lacks.  A
   pair of rare tokens first goes to the part of the context, which adds c(v), then to that of w;
3. a part counts its own pairs, so it can answer for all of them: first with the table for the EM,
   then, given the weights, with a sum per document;
4. the sums of each chunk meet, and its documents come out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, prepared
from .hashing import mix, words

#: Tokens of the broadcast table of frequent ones (3 MB); no result depends on it.
FREQUENT = 1 << 18
#: Training tokens that a part answers for on average, at most.
PART = 4_000_000
_ID = np.int64(19)  # bits of a frequent token's number
#: Order of a part's rows: its counts of tokens, pairs to pass on, pairs to answer for.
COUNTS, PASS, ASK = 0, 1, 2
END = np.uint64(0x8A5CD789635D2DFF)
#: Steps in which the logarithm of a probability is quantised for the EM, per factor of two.
STEPS = 4


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned keys, narrow if they allow it."""
    d = np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))
    return d.astype(np.uint32) if len(d) and int(d.max()) < 1 << 32 else d


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, context) of every token; each text ends with END, and begins behind one."""
    row, word = words(column)
    n = len(column)
    size = np.bincount(row, minlength=n)
    all_rows = np.repeat(np.arange(n), size + 1)
    out = np.empty(len(all_rows), np.uint64)
    ends = np.cumsum(size + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, word
    context = np.concatenate([[END], out[:-1]]) if len(out) else out
    return all_rows, out, context


def _count(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total weights."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def _part(mixed: np.ndarray, parts: int) -> np.ndarray:
    return (((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Tally:
    """Totals by key; what comes in is folded whenever it has doubled."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > len(self.keys) + (1 << 20):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            k, c = zip((self.keys, self.counts), *self.new)
            self.keys, self.counts = _count(np.concatenate(k), np.concatenate(c))
            self.new, self.size = [], 0
        return self.keys, self.counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        have, counts = self.fold()
        if not len(have):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, counts[at], 0)


def unigrams(docs: DataFrame, parts: int) -> DataFrame:
    """(part, n_types, n_tokens, data): the counts of the tokens of each part."""

    def gather(batches):
        tally = Tally()
        for batch in batches:
            tally.add(*_count(tokens(batch.column(0))[1]))
        keys, counts = tally.fold()
        cut = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        at = [i for i in range(parts) if cut[i] < cut[i + 1]]
        data = [pack(_steps(keys[cut[i] : cut[i + 1]]), counts[cut[i] : cut[i + 1]].astype(np.int32)) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def merge(batches):
        tallies: dict[int, Tally] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                steps, counts = unpack(data)
                tallies.setdefault(part, Tally()).add(np.cumsum(steps, dtype=np.uint64), counts)
        for part, tally in tallies.items():
            keys, counts = tally.fold()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([pack(_steps(keys), counts)], pa.binary())], ["part", "n_types", "n_tokens", "data"])

    mine = docs.where(~F.coalesce(held_out("doc_id"), F.lit(False))).select("text").mapInArrow(gather, "part int, data binary")
    return mine.repartition(parts, "part").mapInArrow(merge, "part int, n_types long, n_tokens long, data binary")


def frequent(table: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, counts) of the tokens above the least count that at most ``most`` tokens exceed.

    Only a histogram of counts (512 numbers a part) and those tokens come to the driver.
    """

    def histogram(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                h = np.bincount(np.floor(np.log2(unpack(data)[1]) * 8).astype(np.int64), minlength=512)
                at = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(h[at], pa.int64())], ["bin", "n"])

    h = np.zeros(512, np.int64)
    for r in table.select("data").mapInArrow(histogram, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        h[r["bin"]] = r["n"]
    above = np.cumsum(h[::-1])[::-1]
    least = int(np.argmax(above <= most))

    def pick(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                steps, counts = unpack(data)
                top = np.floor(np.log2(counts) * 8) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(steps, dtype=np.uint64)[top].view(np.int64)), pa.array(counts[top])], ["token", "count"])

    got = table.select("data").mapInArrow(pick, "token long, count long").toPandas()
    keys, counts = got["token"].to_numpy().astype(np.int64).view(np.uint64), got["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _ids(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of each key in a sorted table; len(table) stands for those that are not in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


def split_counts(table: DataFrame, parts: int, times: int) -> DataFrame:
    """The rows of the count table for ``times`` as many parts; a part is a range of hashes, so each is cut."""

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                steps, counts = unpack(data)
                keys = np.cumsum(steps, dtype=np.uint64)
                cut = np.searchsorted(_part(keys, parts * times), np.arange(part * times, (part + 1) * times + 1))
                at = [i for i in range(times) if cut[i] < cut[i + 1]]
                out = [pack(_steps(keys[cut[i] : cut[i + 1]]), counts[cut[i] : cut[i + 1]]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([part * times + i for i in at], pa.int32()), pa.array(out, pa.binary())], ["part", "data"])

    return table.select("part", "data").mapInArrow(run, "part int, data binary").select(F.lit(-1).cast("long").alias("chunk"), "part", F.lit(COUNTS).alias("kind"), "data")


def _chunks(batches, rows: int = 1 << 14, size: int = 8 << 20):
    """Batches of at most ``rows`` rows, put together until they have about ``size`` bytes."""
    held, n, total = [], 0, 0
    for batch in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
        if held and (n + batch.num_rows > rows or total + batch.nbytes > size):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, total = [], 0, 0
        held.append(batch)
        n, total = n + batch.num_rows, total + batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(_part(keys, parts), np.arange(parts + 1))


def requests(docs: DataFrame, top, parts: int) -> DataFrame:
    """(chunk, part, kind, data, ids): what each chunk of documents asks of each part; part -1 describes the chunk.

    A part gets, sorted by key, pairs of frequent tokens (key, document, times), rare tokens with a
    frequent context, frequent tokens with a rare context, apart from those the pairs of rare tokens,
    and which of the documents are for training.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        table, counts = top.value
        none = len(table)
        known = np.append(counts, 0)
        for number, batch in enumerate(_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) | number
            training = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            row, token, context = tokens(batch.column(1))
            n = batch.num_rows
            w, v = _ids(table, token), _ids(table, context)
            common, led = w < none, v < none
            base = np.bincount(row[common], np.log10(known[w[common]] + 0.5), minlength=n).astype(float)
            out = [(-1, ASK, pack(np.bincount(row, minlength=n), np.bincount(row[common], minlength=n), base, training))]
            both = common & led
            pair, times = _count((((v[both] << _ID) | w[both]).astype(np.uint64) << np.uint64(14)) | row[both].astype(np.uint64))
            key, doc = pair >> np.uint64(14), (pair & np.uint64((1 << 14) - 1)).astype(np.uint16)
            to = _part(mix(key), parts)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(parts + 1))
            lists = []  # (key that says the part, other side, document) of each kind of pair with a rare side
            for pick, rare, other in ((~common & led, token, v.astype(np.uint32)), (common & ~led, context, w.astype(np.uint32)), (~common & ~led, context, token)):
                r, o, d = rare[pick], other[pick], row[pick].astype(np.uint16)
                sort = np.lexsort((d, o, r))
                lists.append((r[sort], o[sort], d[sort], _cuts(r[sort], parts)))
            for p in range(parts):
                a = order[cut[p] : cut[p + 1]]
                cells = [(x[c[p] : c[p + 1]], y[c[p] : c[p + 1]], z[c[p] : c[p + 1]]) for x, y, z, c in lists]
                if len(a) or len(cells[0][0]) or len(cells[1][0]):
                    out.append((p, ASK, pack(_steps(key[a]), doc[a], np.minimum(times[a], 2**31 - 1).astype(np.int32), *(z for x in cells[:2] for z in (_steps(x[0]), *x[1:])), training)))
                if len(cells[2][0]):
                    out.append((p, PASS, pack(_steps(cells[2][0]), *cells[2][1:], training)))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), *(pa.array([x[i] for x in out], k) for i, k in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()))), pa.array([batch.column(0) if x[0] < 0 else [] for x in out], pa.list_(batch.schema.field(0).type))], ["chunk", "part", "kind", "data", "ids"])

    return docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")).mapInArrow(run, f"chunk long, part int, kind int, data binary, ids array<{id_type}>")


def _each_part(batches):
    """(part, its counts of tokens, [(chunk, kind, data)]) of a partition's rows, which come sorted by part and kind."""
    part, counts, held = -1, Tally(), []
    for batch in batches:
        for chunk, p, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if p != part:
                if held:
                    yield part, counts, held
                part, counts, held = p, Tally(), []
            if p >= 0 and kind == COUNTS:
                steps, c = unpack(data)
                counts.add(np.cumsum(steps, dtype=np.uint64), c)
            elif p >= 0:
                held.append((chunk, kind, data))
    if held:
        yield part, counts, held


#: Columns of a pair of rare tokens (w behind v) on its way to the part of w, and of that part's counts.
RARE = ["part", "kind", "chunk", "doc", "w", "v", "cv", "training", "data"]
_RARE = "part int, kind int, chunk long, doc int, w long, v long, cv long, training boolean, data binary"


def passed_on(asked: DataFrame, parts: int) -> DataFrame:
    """The pairs of rare tokens, one a row, with c(v), for the part of w."""

    def run(batches):
        for _, counts, rows in _each_part(batches):
            for chunk, kind, data in rows:
                if kind != PASS:
                    continue
                steps, w, doc, training = unpack(data)
                v = np.cumsum(steps, dtype=np.uint64)
                n = len(v)
                arrays = [_part(w, parts).astype(np.int32), np.full(n, PASS, np.int32), np.full(n, chunk), doc.astype(np.int32), w.view(np.int64), v.view(np.int64), counts.of(v), training[doc]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(n, pa.binary())], RARE)

    return asked.select("chunk", "part", "kind", "data").where(f"kind <> {ASK}").mapInArrow(run, _RARE)


def _rare_parts(batches):
    """(document's chunk, document, counts of context, pair and token, training) of each part's pairs of rare tokens; rows come sorted by part and kind."""
    part, counts, held = None, Tally(), []

    def done():
        chunk, doc, w, v, cv, training = (np.concatenate(x) for x in zip(*held))
        key, pairs = mix(w) + mix(v + np.uint64(2)), Tally()
        pairs.add(*_count(key[training]))
        return chunk, doc, cv, pairs.of(key), counts.of(w), training

    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])).tolist() if len(parts) else []
        for i, j in zip(cuts, [*cuts[1:], len(parts)]):
            if parts[i] != part:
                if held:
                    yield done()
                part, counts, held = parts[i], Tally(), []
            if kinds[i] == COUNTS:
                for data in batch.column(8).slice(i, j - i).to_pylist():
                    steps, c = unpack(data)
                    counts.add(np.cumsum(steps, dtype=np.uint64), c)
            else:
                chunk, doc, w, v, cv, training = (batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in range(2, 8))
                held.append((chunk, doc, w.view(np.uint64), v.view(np.uint64), cv, training.astype(bool)))
    if held:
        yield done()


class Part:
    """The counts of one model part's pairs, from the requests of all chunks."""

    def __init__(self, counts: Tally, rows: list[tuple]):
        self.counts = counts
        self.pairs, self.mixed = Tally(), Tally()
        for _, data in rows:
            for key, _, times, _, doc, training, _, common in self._open(data):
                mine = training[doc]
                (self.pairs if common else self.mixed).add(*_count(key[mine], times[mine]))

    def _open(self, data: bytes):
        """(pair, context, times, token, document, training, rare token, two frequent tokens) of each kind of pair."""
        steps, doc, times, rare, context, at, behind, token, there, training = unpack(data)
        key = np.cumsum(steps, dtype=np.uint64)
        yield key, (key >> np.uint64(_ID)).astype(np.int64), times.astype(np.int64), (key & np.uint64((1 << int(_ID)) - 1)).astype(np.int64), doc, training, False, True
        w = np.cumsum(rare, dtype=np.uint64)
        yield mix(w) + mix(context + np.uint64(1)), context.astype(np.int64), np.ones(len(w), np.int64), w, at, training, True, False
        v = np.cumsum(behind, dtype=np.uint64)
        yield mix(v ^ np.uint64(0x5851F42D4C957F2D)) + mix(token + np.uint64(3)), v, np.ones(len(v), np.int64), token.astype(np.int64), there, training, False, False

    def estimates(self, data: bytes, frequent: np.ndarray):
        """(document, times, count of the context, of the pair, of the token, training, rare token) of what was asked."""
        count = lambda x: self.counts.of(x) if x.dtype == np.uint64 else frequent[x]
        for key, v, times, w, doc, training, rare, common in self._open(data):
            yield doc, times, count(v), (self.pairs if common else self.mixed).of(key), count(w), training[doc], rare


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


class Cells:
    """Totals (weight, p2, p1) by cell of bucket and quantised probabilities, over tokens deleted from their own counts."""

    def __init__(self, n: int):
        self.n, self.found = n, {"cell": [], "weight": [], "p2": [], "p1": []}

    def add(self, times, cv, cvw, cw) -> None:
        t = times.astype(float)
        p2 = np.where(cv > 1, (cvw - 1) / np.maximum(cv - 1, 1), 0.0)
        p1 = (cw - 1) / max(self.n - 1, 1)
        q = [np.where(p > 0, np.minimum(np.floor(-np.log2(np.where(p > 0, p, 1.0)) * STEPS), 253).astype(np.int64), 255) for p in (p2, p1)]
        u, inv = np.unique((_bucket(cv) << 16) | (q[0] << 8) | q[1], return_inverse=True)
        for k, x in (("weight", t), ("p2", t * p2), ("p1", t * p1)):
            self.found[k].append(np.bincount(inv, x, minlength=len(u)))
        self.found["cell"].append(u)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in self.found.values()], list(self.found))


_CELLS = "cell long, weight double, p2 double, p1 double"


def _cells(asked: DataFrame, top, n: int) -> DataFrame:
    """Cells of all training tokens but those that are rare behind a rare context."""

    def run(batches):
        counts = top.value[1]
        for _, known, rows in _each_part(batches):
            rows = [(chunk, data) for chunk, kind, data in rows if kind == ASK]
            if not rows:
                continue
            model, cells = Part(known, rows), Cells(n)
            for _, data in rows:
                for _, times, cv, cvw, cw, training, _ in model.estimates(data, counts):
                    cells.add(times[training], cv[training], cvw[training], cw[training])
            yield cells.batch()

    return asked.select("chunk", "part", "kind", "data").mapInArrow(run, _CELLS)


def _rare_cells(rare: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for _, _, cv, cvw, cw, training in _rare_parts(batches):
            cells = Cells(n)
            cells.add(np.ones(int(training.sum())), cv[training], cvw[training], cw[training])
            yield cells.batch()

    return rare.mapInArrow(run, _CELLS)


def _totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("weight", "p2", "p1")))


def mixture(bucket: np.ndarray, weight: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """(bucket, 3) weights by expectation-maximisation; a bucket without data takes those of its neighbour below."""
    out = np.full((66, 3), 1 / 3)
    out[0] = 0, 0.5, 0.5
    p = np.stack([p2, p1, np.full(len(p1), p0)], 1)
    for _ in range(rounds):
        share = out[bucket] * p
        share *= (weight / np.maximum(share.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, share[:, i], minlength=66) for i in range(3)], 1)
        have = total.sum(1) > 0
        out[have] = total[have] / total[have].sum(1, keepdims=True)
    for b in range(1, 66):
        if not (bucket == b).any():
            out[b] = out[b - 1] if b > 1 else (0, 0.5, 0.5)
    out[:, 2] = np.maximum(out[:, 2], 1e-6)
    return out / out.sum(1, keepdims=True)


def _log_chance(weights: np.ndarray, cv, cvw, cw, n: int, v: int) -> np.ndarray:
    a = weights[_bucket(cv)]
    return np.log10(a[:, 0] * np.where(cv > 0, cvw / np.maximum(cv, 1), 0.0) + a[:, 1] * (cw / max(n, 1)) + a[:, 2] / (v + 1))


def _answer(doc, score, base, known) -> bytes:
    """Sums by document."""
    size = int(doc.max()) + 1 if len(doc) else 0
    at = np.flatnonzero(np.bincount(doc, minlength=size))
    sums = [np.bincount(doc, x, minlength=size)[at] for x in (score, base, known)]
    return pack(at.astype(np.uint16), sums[0], sums[1], sums[2].astype(np.float32))


def _answers(asked: DataFrame, top, n: int, v: int, weights: np.ndarray) -> DataFrame:
    """(chunk, data): sums per document of each part's tokens."""

    def run(batches):
        counts = top.value[1]
        for _, mine, rows in _each_part(batches):
            rows = [(chunk, data) for chunk, kind, data in rows if kind == ASK]
            model = Part(mine, rows)
            for chunk, data in rows:
                docs, score, base, known = [], [], [], []
                for doc, times, cv, cvw, cw, _, rare in model.estimates(data, counts):
                    docs.append(doc)
                    score.append(times * _log_chance(weights, cv, cvw, cw, n, v))
                    base.append(np.log10(cw + 0.5) if rare else np.zeros(len(doc)))
                    known.append(((cw > 0) if rare else np.zeros(len(doc))).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_answer(*map(np.concatenate, (docs, score, base, known)))], pa.binary())], ["chunk", "data"])

    return asked.select("chunk", "part", "kind", "data").mapInArrow(run, "chunk long, data binary")


def _rare_answers(rare: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    def run(batches):
        for chunk, doc, cv, cvw, cw, _ in _rare_parts(batches):
            score, base, known = _log_chance(weights, cv, cvw, cw, n, v), np.log10(cw + 0.5), (cw > 0).astype(float)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            for some in np.split(order, cuts):
                yield pa.RecordBatch.from_arrays([pa.array(chunk[some[:1]]), pa.array([_answer(doc[some], score[some], base[some], known[some])], pa.binary())], ["chunk", "data"])

    return rare.mapInArrow(run, "chunk long, data binary")


def scored(docs: DataFrame, frequent_tokens: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Null and empty texts are one END token; texts of any length are read whole.  A null doc_id counts
    as training.  Repeated rows are counted and scored each; columns other than doc_id and text are
    not looked at.  Without any training row, N and V are 0 and all scores are those of the uniform
    estimate.  ``frequent_tokens`` bounds the broadcast table and changes no result.
    """
    spark = prepared(docs.sparkSession)
    scratch = Scratch(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = dict(docs.dtypes)["doc_id"]
    table = scratch.keep(unigrams(docs, least))
    total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    n, v = int(total[0]), int(total[1])
    times = max(1, -(-n // (PART * least)))
    parts = least * times
    top = spark.sparkContext.broadcast(frequent(table, min(frequent_tokens, (1 << int(_ID)) - 1)))
    counts = split_counts(table, least, times)
    everything = requests(docs, top, parts).unionByName(counts.withColumn("ids", F.lit(None).cast(f"array<{id_type}>")))
    asked = checkpointed(everything.repartition(parts, "part").sortWithinPartitions("part", "kind"))
    empty = {c: F.lit(None).cast(k) for c, k in (x.split() for x in _RARE.split(", "))}
    known = counts.select(*[F.col(c) if c in ("part", "kind", "data") else empty[c].alias(c) for c in RARE])
    rare = checkpointed(passed_on(asked, parts).unionByName(known).repartition(parts, "part").sortWithinPartitions("part", "kind"))
    scratch.drop(table)
    cells = _totals(_cells(asked, top, n).unionByName(_rare_cells(rare, n))).toPandas()
    w = np.maximum(cells["weight"].to_numpy(), 1e-300)
    weights = mixture(cells["cell"].to_numpy().astype(np.int64) >> 16, cells["weight"].to_numpy(), cells["p2"].to_numpy() / w, cells["p1"].to_numpy() / w, 1.0 / (v + 1))
    answers = _answers(asked, top, n, v, weights).unionByName(_rare_answers(rare, n, v, weights))
    own = asked.where("part < 0").select("chunk", "data", "ids")
    floor = float(np.log10(n + 0.5 * (v + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def chunks(batches):
        """(description of a chunk, its ids, [answers]) of rows that come sorted by chunk."""
        at, head, ids, rows = None, None, None, []
        for batch in batches:
            lists = batch.column(2)
            for i, (chunk, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if chunk != at:
                    if head is not None:
                        yield head, ids, rows
                    at, head, rows = chunk, None, []
                if lists[i].is_valid:
                    head, ids = data, lists[i].values
                else:
                    rows.append(data)
        if head is not None:
            yield head, ids, rows

    def finish(batches):
        for head, ids, rows in chunks(batches):
            sizes, common, base, training = unpack(head)
            score, known = np.zeros(len(sizes)), common.astype(float)
            for answer in rows:
                at, s, b, k = unpack(answer)
                score[at] += s
                base[at] += b
                known[at] += k
            yield pa.RecordBatch.from_arrays([ids, pa.array(~training), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), n)), pa.array(base - sizes * floor), pa.array(score)], names)

    met = own.unionByName(answers.withColumn("ids", F.lit(None).cast(f"array<{id_type}>"))).repartition(parts, "chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir):
    from .common import read

    return scored(read(spark, sf_dir, "documents"))
