"""Exact removal of repeated byte strings with a family of suffix arrays that grows by merging.

Every string of ``length`` bytes that starts anywhere else too, in the same document or another, is
found; all bytes under such strings are covered.  Suffixes of all positions would be far more data
than the text, so the work is narrowed in exact steps:

1. Anchors.  Among the ``GRAM``-byte grams of a length-byte string the one with the least hash
   (the leftmost of equals) is its anchor; equal strings have equal anchors at equal offsets.
   The strings that one anchor answers for are consecutive and make one span of the text.
2. Grams that occur at one anchor only are dropped by a grouped count; so are all strings they
   answer for.  An anchor whose whole span occurs elsewhere has all its strings covered.
3. What remains are anchors with one gram and different spans, as at the borders of a passage that
   several documents share.  One span of each kind goes to the partition of its gram.  There the
   spans arrive in batches; each batch gets a sorted array of its suffixes, cut at ``length`` bytes
   and ordered by their fingerprints (equal prefixes stand together, which is all that matching
   asks of the order), is merge-scanned against the levels that exist, and becomes a level;
   levels of equal size merge, so a suffix is moved a logarithmic number of times.

A gram with over ``hot`` kinds of spans is split: each span's suffixes are dealt to buckets by their
fingerprints, as arrays, and the buckets go through the same family apart.

Spans are told apart by 128 bits (gram and span), suffixes by two fingerprints of 64 bits each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups_of, signed, text_view
from .hashing import PIECE, mix, prefix, span_hash

LENGTH = 400
GRAM = 64
#: Length of the shorter strings that ``measured`` counts beside those it removes.
SHORTER = 256
#: Kinds of spans from which on a gram's suffixes are dealt to several tasks.
HOT = 1024
#: Suffixes, or kinds of spans, that a task of the matching takes on average.
SHARE = 1 << 14
_SECOND = np.random.default_rng(611).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOW = np.uint64(PIECE - 1)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(raw: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """(row, first, last, anchor, gram hash, span hash) of every anchor: positions within the row.

    first and last are the starts of the first and the last string that the anchor answers for.
    Texts are taken in pieces below PIECE bytes; pieces of one long text overlap by length - 1
    bytes, and the strings of an anchor that straddles two pieces make two spans.
    """
    step = PIECE - 1 - length
    out = []
    for first, last in groups_of(at, step):
        a, b = int(at[first]), int(at[last])
        for begin in range(a, max(b, a + 1), step):
            end = min(b, begin + step + length - 1)
            if end - begin < length:
                continue
            part = raw[begin:end]
            sums = prefix(part)
            n = len(part)
            grams = mix(span_hash(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
            best = _window_minima((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
            row = np.arange(first, last)
            ends = np.minimum(at[first + 1 : last + 1], end) - begin
            starts = np.maximum(at[first:last], begin) - begin
            room = np.maximum(ends - starts - length + 1, 0)
            if not room.sum():
                continue
            rows = np.repeat(row, room)
            where = np.arange(len(rows)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(starts, room)
            anchor = (best[where] & _LOW).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            stop = np.concatenate([new[1:], [len(where)]]) - 1
            s, t, anchor = where[new], where[stop], anchor[new]
            whole = part.tobytes()
            spans = np.fromiter((xxhash.xxh3_64_intdigest(whole[x : y + length], x - z & 0xFFFFFFFF) for x, y, z in zip(s.tolist(), t.tolist(), anchor.tolist())), np.uint64, len(s))
            shift = begin - at[rows[new]]
            out.append((rows[new], s + shift, t + shift, anchor + shift, grams[anchor], spans))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Family:
    """Sorted arrays of suffix fingerprints whose sizes fall geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, checks: np.ndarray, ids: np.ndarray, repeated: np.ndarray) -> None:
        """Take a batch (two fingerprints and the number of each suffix); set repeated[number] for every match."""
        prints, checks, ids = self._sorted((prints, checks, ids), repeated)
        for have, second, numbers in self.levels:
            at = np.minimum(np.searchsorted(have, prints), len(have) - 1)
            same = (have[at] == prints) & (second[at] == checks)
            repeated[ids[same]] = True
            repeated[numbers[at[same]]] = True
        self.levels.append((prints, checks, ids))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            new, old = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted(tuple(map(np.concatenate, zip(old, new))), repeated))

    @staticmethod
    def _sorted(level: tuple, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A level in order, one suffix of each kind; the numbers of those that had company are set."""
        order = np.argsort(level[0], kind="stable")
        prints, checks, ids = (x[order] for x in level)
        if not len(prints):
            return prints, checks, ids
        equal = (prints[1:] == prints[:-1]) & (checks[1:] == checks[:-1])
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        repeated[ids[twice]] = True
        first = np.concatenate([[True], ~equal])
        return prints[first], checks[first], ids[first]


def _suffixes(contexts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, second fingerprint) of all length-byte strings of the contexts."""
    raw, at = text_view(contexts)
    rows, prints, checks = [], [], []
    for first, last in groups_of(at, PIECE):
        part = raw[at[first] : at[last]]
        room = np.maximum(np.diff(at[first : last + 1]) - length + 1, 0)
        starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(at[first:last] - at[first], room)
        rows.append(np.repeat(np.arange(first, last), room))
        prints.append(mix(span_hash(prefix(part), starts, starts + length)))
        checks.append(span_hash(prefix(part, _SECOND), starts, starts + length))
    return np.concatenate(rows), np.concatenate(prints), np.concatenate(checks)


def _runs(repeated: np.ndarray, lead: int, length: int) -> tuple[list[int], list[int]]:
    """Covered byte ranges, relative to the anchor, of the strings whose flags are set."""
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    return (np.flatnonzero(edge == 1) - lead).tolist(), (np.flatnonzero(edge == -1) - lead - 1 + length).tolist()


KEY = ["gram", "span"]
_RUNS = "gram long, span long, froms array<int>, tos array<int>"


def _grown(flags: np.ndarray, size: int) -> np.ndarray:
    while len(flags) < size:
        flags = np.concatenate([flags, np.zeros(len(flags), bool)])
    return flags


def _covered(contexts: DataFrame, length: int, hot: int, scratch: Scratch) -> DataFrame:
    """(gram, span, froms, tos) for kinds of spans (gram, span, n, lead, context) that share a gram with others."""

    def match(batches):
        family, kinds, flags, size = Family(), [], np.zeros(1 << 16, bool), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, prints, checks = _suffixes(batch.column(4), length)
            flags = _grown(flags, size + len(row))
            flags[size : size + len(row)] |= (batch.column(2).to_numpy() > 1)[row]
            family.add(prints, checks, np.arange(size, size + len(row)), flags)
            kinds.append((batch.column(0), batch.column(1), batch.column(3).to_pylist(), size + np.searchsorted(row, np.arange(batch.num_rows + 1))))
            size += len(row)
        for gram, span, leads, cut in kinds:
            found = [_runs(flags[cut[i] : cut[i + 1]], lead, length) for i, lead in enumerate(leads)]
            yield pa.RecordBatch.from_arrays([gram, span, pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([y for _, y in found], pa.list_(pa.int32()))], ["gram", "span", "froms", "tos"])

    def suffixes(batches):
        """One row for each kind of span and bucket of its suffixes' fingerprints."""
        for batch in batches:
            row, prints, checks = _suffixes(batch.column(4), length)
            start = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row] - np.array(batch.column(3).to_pylist(), np.int64)[row]
            bucket = (prints % batch.column(5).to_numpy().astype(np.uint64)[row]).astype(np.int64)
            order = np.lexsort((bucket, row))
            row, bucket = row[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])) if len(row) else np.zeros(0, np.int64)
            cuts = pa.array(np.append(first, len(row)), pa.int32())
            take = pa.array(row[first])
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (signed(prints), signed(checks), start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(bucket[first].astype(np.int32)), *lists], ["gram", "span", "n", "bucket", "prints", "seconds", "starts"])

    def match_dealt(batches):
        family, held, flags, size = Family(), [], np.zeros(1 << 16, bool), 0
        for batch in batches:
            prints, checks, starts = (batch.column(i).flatten().to_numpy() for i in (4, 5, 6))
            sizes = pa.compute.list_value_length(batch.column(4)).to_numpy()
            flags = _grown(flags, size + len(prints))
            flags[size : size + len(prints)] |= np.repeat(batch.column(2).to_numpy() > 1, sizes)
            family.add(prints.view(np.uint64), checks.view(np.uint64), np.arange(size, size + len(prints)), flags)
            held.append((batch.select(["gram", "span"]), sizes, starts, size))
            size += len(prints)
        for names, sizes, starts, at in held:
            hit = flags[at : at + len(starts)]
            owner = np.repeat(np.arange(len(sizes)), sizes)[hit]
            have = np.flatnonzero(np.bincount(owner, minlength=len(sizes)))
            cuts = np.append(np.searchsorted(owner, have), len(owner))
            take = pa.array(have)
            yield pa.RecordBatch.from_arrays([names.column(0).take(take), names.column(1).take(take), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(starts[hit]))], ["gram", "span", "starts"])

    spark = contexts.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = scratch.keep(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot))
    total = many.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    few = contexts.join(many.select("gram").hint("shuffle_hash"), "gram", "left_anti") if total else contexts
    usual = few.repartition(max(least, contexts.count() // SHARE + 1), "gram").mapInArrow(match, _RUNS)
    if not total:
        return usual
    buckets = F.least(F.ceil(F.col("kinds") / hot), F.lit(length)).cast("int").alias("buckets")
    dealt = contexts.join(many.select("gram", buckets), "gram").select(*KEY, "n", "lead", "context", "buckets").mapInArrow(suffixes, "gram long, span long, n long, bucket int, prints array<long>, seconds array<long>, starts array<int>")
    again = dealt.repartition(max(least, total // SHARE + 1), "gram", "bucket").mapInArrow(match_dealt, "gram long, span long, starts array<int>")
    shared = again.groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("s"))
    return usual.unionByName(shared.select(*KEY, F.col("s").alias("froms"), F.transform("s", lambda x: x + length).alias("tos")))


def covered_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, version, froms, tos): ranges of bytes to remove, one row a document that has any.

    version is a digest of the text, so that rows with one doc_id and different texts stay apart.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")

    def run(batches):
        for batch in batches:
            row, first, last, anchor, gram, span = anchors_of(*text_view(batch.column(2)), length)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.astype(np.int32)), pa.array((anchor - first).astype(np.int16)), pa.array((last - first).astype(np.int16)), pa.array(signed(gram)), pa.array(signed(span))],
                ["doc_id", "version", "pos", "lead", "more", "gram", "span"],
            )

    anchors = scratch.keep(texts.mapInArrow(run, f"doc_id {id_type}, version long, pos int, lead short, more short, gram long, span long"))
    again = scratch.keep(anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))
    repeated = scratch.keep(anchors.join(again, "gram"))
    scratch.drop(anchors)
    kinds = scratch.keep(repeated.groupBy("mixed", *KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "pos", "lead", "more")).alias("one")))
    asked = kinds.where("mixed").select(*KEY, "n", "one.*").groupBy("doc_id", "version").agg(F.collect_list(F.struct(*KEY, "n", "pos", "lead", "more")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "i", "version": "v"})
    held = texts.join(asked.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(asked["i"]) & (texts["version"] == asked["v"])).select("asked", "text")

    def cut(batches):
        for batch in batches:
            raw, at = text_view(batch.column(1))
            lists = batch.column(0)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            gram, span, n, pos, lead, more = lists.flatten().flatten()
            lead64, more64, begin = lead.to_numpy().astype(np.int64), more.to_numpy().astype(np.int64), at[owner] + pos.to_numpy()
            whole = raw.tobytes()
            contexts = pa.array([whole[x:y] for x, y in zip((begin - lead64).tolist(), (begin - lead64 + more64 + length).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([gram, span, n, lead, contexts], ["gram", "span", "n", "lead", "context"])

    contexts = scratch.keep(held.mapInArrow(cut, "gram long, span long, n long, lead short, context binary").dropDuplicates(KEY))
    borders = _covered(contexts, length, hot, scratch)
    parts = repeated.where("mixed").join(borders, KEY).select("doc_id", "version", F.arrays_zip(F.transform("froms", lambda x: x + F.col("pos")).alias("f"), F.transform("tos", lambda x: x + F.col("pos")).alias("t")).alias("z"))
    parts = parts.select("doc_id", "version", F.inline("z").alias("f", "t"))
    full = repeated.where("not mixed").select("doc_id", "version", (F.col("pos") - F.col("lead")).alias("f"), (F.col("pos") - F.col("lead") + F.col("more") + length).alias("t"))
    ranges = parts.unionByName(full).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("f", "t"))).alias("r"))
    out = scratch.keep(ranges.select("doc_id", "version", F.col("r.f").alias("froms"), F.col("r.t").alias("tos")))
    scratch.drop(again, repeated, kinds, contexts)
    return out


def _longer(docs: DataFrame, ranges: DataFrame, scratch: Scratch, length: int, hot: int) -> DataFrame:
    """covered_ranges for a greater length, given those of a smaller one.

    A repeated string consists of repeated shorter ones, so it lies in one of their maximal runs;
    only runs of length bytes or more are looked at again.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    kind = f"struct<i:{id_type},v:bigint,at:int>"

    def cut(batches):
        for batch in batches:
            for i, (body, runs) in enumerate(_with_runs(batch, 2)):
                wide = [(x, y) for x, y in runs if y - x >= length]
                for k in range(0, len(wide), 4096):
                    some = wide[k : k + 4096]
                    owner = pa.array([i] * len(some), pa.int32())
                    ids = pa.StructArray.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array([x for x, _ in some], pa.int32())], ["i", "v", "at"])
                    yield pa.RecordBatch.from_arrays([ids, pa.array([body[x:y] for x, y in some], pa.binary())], ["doc_id", "text"])

    met = _with_ranges(docs.select("doc_id", F.xxhash64("text").alias("version"), "text"), ranges.where(F.exists(F.arrays_zip("froms", "tos"), lambda z: z["tos"] > z["froms"])), inner=True)
    pieces = scratch.keep(met.mapInArrow(cut, f"doc_id {kind}, text binary"))
    found = covered_ranges(pieces, scratch, length, hot).select(F.col("doc_id").alias("piece"), "froms", "tos")
    scratch.drop(pieces)
    moved = F.arrays_zip(F.transform("froms", lambda x: x + F.col("piece.at")).alias("f"), F.transform("tos", lambda x: x + F.col("piece.at")).alias("t"))
    rows = found.select(F.col("piece.i").alias("doc_id"), F.col("piece.v").alias("version"), moved.alias("z")).select("doc_id", "version", F.inline("z").alias("f", "t"))
    return rows.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("f", "t"))).alias("r")).select("doc_id", "version", F.col("r.f").alias("froms"), F.col("r.t").alias("tos"))


def _union(froms: np.ndarray, tos: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ranges sorted by their start."""
    if not len(froms):
        return []
    reach = np.maximum.accumulate(tos)
    new = np.concatenate([[True], froms[1:] > reach[:-1]])
    return list(zip(froms[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(froms) - 1]])].tolist()))


def _with_runs(batch: pa.RecordBatch, text: int, froms: int = -2):
    """(bytes, removed runs) of each row of a batch; froms and the column behind it have the ranges."""
    raw, at = text_view(batch.column(text))
    at_froms = batch.num_columns + froms
    lists, ends = batch.column(at_froms), batch.column(at_froms + 1)
    cut = np.concatenate([[0], np.cumsum([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])]).astype(np.int64)
    f, t = lists.flatten().to_numpy(), ends.flatten().to_numpy()
    for i in range(batch.num_rows):
        yield raw[at[i] : at[i + 1]].tobytes(), _union(f[cut[i] : cut[i + 1]], t[cut[i] : cut[i + 1]])


def _without(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(body)]
    return b"".join(body[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def _with_ranges(docs: DataFrame, ranges: DataFrame, inner: bool = False, name: str = "_range") -> DataFrame:
    named = ranges.toDF(f"{name}_id", f"{name}_version", f"{name}_froms", f"{name}_tos")
    on = docs["doc_id"].eqNullSafe(named[f"{name}_id"]) & (F.xxhash64(docs["text"]) == named[f"{name}_version"])
    return docs.join(named.hint("shuffle_hash"), on, "inner" if inner else "left").select(*[docs[c] for c in docs.columns], f"{name}_froms", f"{name}_tos")


def measured(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shorter: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs.

    With ``shorter`` there is also n_repeated, the bytes under strings of that many bytes that start
    elsewhere too; then the strings of length bytes are looked for in such runs only.

    Null texts are empty.  Texts below length bytes have nothing to remove; texts of any length are
    read whole; repeated rows are separate documents, so all of them go (strings are judged on the
    input).  Other columns are not looked at; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    if shorter is None:
        ranges = covered_ranges(docs, scratch, length, hot)
        joined = _with_ranges(docs, ranges)
    else:
        wide = covered_ranges(docs, scratch, shorter, hot)
        ranges = _longer(docs, wide, scratch, length, hot)
        both = ranges.toDF("doc_id", "version", "froms", "tos").join(wide.withColumnsRenamed({"froms": "wide_froms", "tos": "wide_tos", "doc_id": "wide_id", "version": "wide_version"}), F.col("doc_id").eqNullSafe(F.col("wide_id")) & (F.col("version") == F.col("wide_version")), "right")
        named = both.select("wide_id", "wide_version", "wide_froms", "wide_tos", "froms", "tos")
        joined = docs.join(named.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(named["wide_id"]) & (F.xxhash64(docs["text"]) == named["wide_version"]), "left").select(docs["doc_id"], docs["text"], "wide_froms", "wide_tos", "froms", "tos")

    def run(batches):
        for batch in batches:
            sizes, gone, spans, digests = [], [], [], []
            for body, runs in _with_runs(batch, 1):
                kept = _without(body, runs)
                sizes.append(len(body))
                gone.append(len(body) - len(kept))
                spans.append(len(runs))
                digests.append(hashlib.sha256(kept).hexdigest())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if shorter is not None:
                arrays.append(pa.array([sum(y - x for x, y in runs) for _, runs in _with_runs(batch, 1, -4)], pa.int64()))
                names.append("n_repeated")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_repeated long" if shorter is not None else ""))


def removed(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs with the covered bytes taken out of text.

    A character that is cut at the edge of a removed run is dropped whole; null texts stay null; if
    there is a column n_chars, it is counted anew.
    """
    joined = _with_ranges(docs, covered_ranges(docs, Scratch(docs.sparkSession), length, hot))
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            valid = batch.column(text).is_valid().to_pylist()
            texts = [_without(*x).decode("utf-8", "ignore") if ok else None for ok, x in zip(valid, _with_runs(batch, text))]
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark, sf_dir):
    from .common import read

    return measured(read(spark, sf_dir, "documents"), shorter=SHORTER)
