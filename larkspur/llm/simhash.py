"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of five segments.  Two fingerprints that differ in at
most ``bits`` = 2 places have a segment from which every chain of consecutive segments stays within
its proportional budget (chain length x 2 / 5, rounded down: 0, 0, 1, 1, 2).  The two leading
segments must therefore be equal, which makes 26 bits an equi-join key; the longer chains prune
pairs before the whole Hamming distance is taken.

A crowded block of fingerprints is cut again: two of its members that are within two bits agree in
one of any three parts of the bits that are still free, so each member goes to three narrower blocks,
and pairs are taken only in blocks that are small or have hardly a free bit left.

``similar`` and ``keep_one`` decide a Jaccard index of 0.8 over five-word shingles.  At that index a
64-bit fingerprint differs in about ten places and no segment of a ring selects anything, so pairs
are proposed by shared shingles, pruned by a pigeonring over fingerprints of 256 bits, then by their
full Hamming distance, and decided by the exact index.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, signed, slices, text_bytes
from .hashing import mix, words

WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned SimHash of a text; shingle words at a time, 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for done in range(0, n, block):
        size = min(block, n - done)
        digests = b"".join(map(xxhash.xxh64_digest, (g for g, _ in zip(grams, range(size))), repeat(seed)))
        cells = np.frombuffer(digests, np.uint8).reshape(size, 8)[:, ::-1]
        if size < 512:
            ones += np.unpackbits(cells, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            for k in range(8):
                ones[8 * k : 8 * k + 8] += np.bincount(cells[:, k], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(fp))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: str, i: int) -> str:
    i %= 5
    return f"(shiftrightunsigned({fp}, {STARTS[i]}) & {(1 << WIDTHS[i]) - 1}L)"


def _blocks(depth: int) -> list[list[int]]:
    """Masks of the bits in which a block's members agree, by depth; mask b has the parts 3 b to 3 b + 2 below it."""
    levels = [[sum(((1 << WIDTHS[k % 5]) - 1) << STARTS[k % 5] for k in (i, i + 1)) for i in range(5)]]
    for _ in range(depth):
        below = []
        for mask in levels[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            cut = [round(len(free) * j / 3) for j in range(4)]
            below += [mask | sum(1 << b for b in free[cut[j] : cut[j + 1]]) for j in range(3)]
        levels.append(below)
    return levels


def _long(mask: int) -> str:
    return f"{mask - (1 << 64) if mask >> 63 else mask}L"


def links(distinct: DataFrame, scratch: Scratch, limit: int = 64, depth: int = 3) -> DataFrame:
    """Pairs (x, y) of the distinct fingerprints fp that differ in two bits or fewer: all of them.

    ``limit`` only says from which size on a block is cut again.  After ``depth`` cuts 10 to 12 bits
    are free, which bounds a block, whatever the table's size.
    """
    levels = _blocks(depth)
    start = lambda expression: f"case block div {3**at} " + " ".join(f"when {i} then {expression(i)}" for i in range(5)) + " end"
    chain = lambda n: " + ".join(start(lambda i, k=k: f"bit_count({_segment('x', i + k)} ^ {_segment('y', i + k)})") for k in range(2, n))
    rows = distinct.select("fp", F.explode(F.expr("array(" + ",".join(f"struct({b} as block, fp & {_long(m)} as same)" for b, m in enumerate(levels[0])) + ")")).alias("b")).select("b.*", "fp")
    found = []
    for at in range(depth + 1):
        rows = scratch.keep(rows)
        sizes = scratch.keep(rows.groupBy("block", "same").agg(F.count("*").alias("n")).where("n > 1"))
        crowded = sizes.where(F.col("n") > limit).select("block", "same")
        small = rows.join(sizes.where(F.col("n") <= limit).drop("n") if at < depth else sizes.drop("n"), ["block", "same"])
        pairs = small.withColumnRenamed("fp", "x").join(small.withColumnRenamed("fp", "y"), ["block", "same"]).where("x < y").where(f"{chain(3)} <= 1").where(f"{chain(4)} <= 1").where("bit_count(x ^ y) <= 2")
        found.append(pairs.select("x", "y"))
        if at == depth or not crowded.head(1):
            break
        masks = "array(" + ",".join(_long(m) for m in levels[at + 1]) + ")"
        rows = rows.join(crowded, ["block", "same"]).select("fp", "block", F.explode(F.array(*map(F.lit, range(3)))).alias("j")).select(F.expr("3 * block + j").alias("block"), F.expr(f"fp & element_at({masks}, 3 * block + j + 1)").alias("same"), "fp")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  Texts of any length are read
    whole.  Rows with one doc_id are each returned; a null doc_id takes the component of its fingerprint, null if it has none.
    Columns other than doc_id and text are not looked at.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, shingle))
    heads = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    near = links(heads.select("fp"), scratch)
    ids = heads.where("rep is not null")
    a, b = ids.select(F.col("fp").alias("x"), F.col("rep").alias("a")), ids.select(F.col("fp").alias("y"), F.col("rep").alias("b"))
    roots = components(near.join(a, "x").join(b, "y").select("a", "b"), scratch)
    named = heads.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp")


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; a text of fewer words is one shingle."""
    row, word = words(column)
    gram = word.copy()
    for k in range(1, shingle):
        gram[:-k] += np.where(row[k:] == row[:-k], mix(word[k:]) * np.uint64((2 * k + 1) ** 9), np.uint64(0))
    size = np.bincount(row, minlength=len(column))
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    whole = place <= np.maximum(size[row] - shingle, 0)
    return _distinct(row[whole], mix(gram[whole]))


def _pieces(batches, text: int):
    return (part for batch in batches for part in slices(batch, text))


def _wide(row: np.ndarray, gram: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The four words of each text's SimHash of 256 bits, from its distinct shingles."""
    out = []
    for seed in range(4):
        cells = mix(gram + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8)
        ones = [np.bincount(row * 256 + cells[:, k], minlength=256 * len(n)).reshape(-1, 256).astype(float) @ _BITS.astype(float) for k in range(8)]
        out.append(np.packbits(np.concatenate(ones, 1) * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0])
    return out


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(values)))


def common_shingles(docs: DataFrame, shingle: int, most: int = 1 << 17, least: int = 2, hold: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of at most ``most`` shingles that many documents share.

    They only order shingles, so counts need not be whole: a task adds up what it sees of
    ``hold`` shingles and tells those of ``least`` documents.
    """

    def run(batches):
        held, n = [], 0

        def told():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= least
            return pa.RecordBatch.from_arrays([pa.array(signed(value[often])), pa.array(count[often])], ["shingle", "n"])

        for part in _pieces(batches, 0):
            held.append(_shingles(part.column(0), shingle)[1])
            n += len(held[-1])
            if n >= hold:
                yield told()
                held, n = [], 0
        if held:
            yield told()

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    value, count = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(value)
    return value[order], count[order]


def prefixes(docs: DataFrame, shingle: int, similarity: float, common) -> DataFrame:
    """(doc_id, version, g, n, f0..f3, keys): digest and size of a text's set of shingles, its SimHash, and its prefix.

    All sets are sorted alike: shingles that few documents have first.  A set that shares
    ``similarity`` of the union with another shares one of its first n - similarity n + 1 shingles.
    """
    names = ["doc_id", "version", "g", "n", "f0", "f1", "f2", "f3", "keys"]

    def run(batches):
        table, counts = common.value
        for part in _pieces(batches, 1):
            row, gram = _shingles(part.column(1), shingle)
            n = np.bincount(row, minlength=part.num_rows)
            cuts = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
            g = mix(sums[cuts[1:]] - sums[cuts[:-1]] + n.astype(np.uint64))
            wide = [pa.array(signed(f)) for f in _wide(row, gram, n)]
            often = np.zeros(len(gram), np.int64)
            if len(table):
                at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
                often = np.where(table[at] == gram, counts[at], 0)
            gram = gram[np.lexsort((gram, often, row))]
            length = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + (n > 0)
            keep = np.arange(len(gram)) - cuts[row] < length[row]
            arrays = [part.column(0), part.column(2), pa.array(signed(g)), pa.array(n.astype(np.int32)), *wide, _lists(gram[keep], np.concatenate([[0], np.cumsum(length)]))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, g long, n int, f0 long, f1 long, f2 long, f3 long, keys array<long>")


def radius(similarity: float) -> int:
    """Bits of 256 in which fingerprints of sets of that index or more differ: the mean and five deviations and a half.

    By the angle the mean share is acos(c) / pi with c = 2 s / (1 + s); sets of four and five shingles,
    the smallest that can differ at 0.8, come to 48 bits of 256, which is four deviations below.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(256 * share + 5.5 * np.sqrt(256 * share * (1 - share)) + 1))


def pigeonring(tau: int) -> str:
    """SQL over dif0..dif3, differing bits by segment: chains from some segment keep to their budgets, and the whole to tau."""
    chains = []
    for i in range(4):
        chains.append("(" + " and ".join(f"{' + '.join(f'dif{(i + k) % 4}' for k in range(size))} <= {size * tau // 4}" for size in range(1, 4)) + ")")
    return f"({' or '.join(chains)}) and dif0 + dif1 + dif2 + dif3 <= {tau}"


def _sets(docs: DataFrame, shingle: int, heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, items) of the wanted sets, from the text of one document each."""

    def run(batches):
        for part in _pieces(batches, 1):
            row, gram = _shingles(part.column(1), shingle)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(gram, cuts)], ["g", "items"])

    ids = heads.join(wanted, "g").select("g", F.col("rep").alias("doc_id"), F.col("version"))
    if wanted.count() <= 1 << 19:
        ids = F.broadcast(ids)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64("text"))
    return text.join(ids, ["doc_id", "version"]).select("g", "text").mapInArrow(run, "g long, items array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs (x, y) of digests whose sets have a Jaccard index of similarity or more.

    The pigeonring over their fingerprints sends most pairs away before sets are compared.
    """
    prints = [f"f{k}" for k in range(4)]
    marks = heads.select("g", *prints)
    x, y = (marks.toDF(c, *(f"{c}{k}" for k in range(4))) for c in "xy")
    apart = pairs.join(x, "x").join(y, "y").select("x", "y", *(F.expr(f"bit_count(x{k} ^ y{k})").alias(f"dif{k}") for k in range(4)))
    near = scratch.keep(apart.where(pigeonring(radius(similarity))).select("x", "y"))
    sets = scratch.keep(_sets(docs, shingle, heads, near.select(F.explode(F.array("x", "y")).alias("g")).distinct()))
    p, q = sets.select(F.col("g").alias("x"), F.col("items").alias("p")), sets.select(F.col("g").alias("y"), F.col("items").alias("q"))
    same = "size(array_intersect(p, q))"
    out = scratch.keep(near.join(p, "x").join(q, "y").where(f"{same} * {1 + similarity}D >= (size(p) + size(q)) * {similarity}D - 1e-6D").select("x", "y").distinct())
    scratch.drop(near, sets)
    return out


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) over links of documents whose sets of shingles have a Jaccard index of similarity or more.

    Equal sets are one node.  Sets that are similar enough share a shingle of their prefixes, at
    places that leave enough shingles behind them: a join on the shingle proposes every such pair,
    the pigeonring prunes, and the index of the 64-bit shingle hashes decides.  First each set meets
    the most central set of every shingle (whose shingles are shared most, as those of an original
    are), then all pairs of a shingle that are not in one component yet, of shingles with several
    components: components stay the same, and a large group of copies makes few pairs.

    Null texts are empty; texts without words are one group, fewer words than a shingle are one
    shingle.  Texts of any length are read whole.  Rows with one doc_id are each returned; a null
    doc_id has the component of an equal set, null if there is none.  Ties are settled by doc_id,
    columns other than doc_id and text are not looked at, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    marks = scratch.keep(prefixes(docs, shingle, similarity, common))
    one = ("n", "f0", "f1", "f2", "f3", "keys")
    heads = scratch.keep(marks.where("doc_id is not null").groupBy("g").agg(F.min(F.struct("doc_id", "version")).alias("one"), *(F.first(c).alias(c) for c in one)).select("g", F.col("one.doc_id").alias("rep"), F.col("one.version").alias("version"), *one))
    rows = heads.select("g", "n", F.posexplode("keys").alias("i", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    live = scratch.keep(rows.toDF("x", "nx", "i", "key").join(shared, "key").select("key", "x", "nx", "i", "members"))
    weights = live.groupBy("x").agg(F.sum("members").alias("weight"))
    drawn = live.join(weights, "x").groupBy("key").agg(F.max(F.struct("weight", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("i").alias("j"))).alias("head"))
    met = live.join(drawn, "key").select("x", "nx", "i", "head.y", "head.ny", "head.j")
    fits = f"least(nx - i, ny - j) * {1 + similarity}D >= (nx + ny) * {similarity}D - 1e-6D"
    ordered = (F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    stars = _verified(met.where("x <> y").where(fits).select(*ordered).distinct(), docs, heads, shingle, similarity, scratch)
    first = components(stars.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    many = live.where("members > 2").select("key", "x", "nx", "i").join(first.withColumnRenamed("node", "x"), "x", "left").select("key", "x", "nx", "i", F.coalesce("component", "x").alias("c"))
    mixed = many.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    many = scratch.keep(many.join(mixed, "key"))
    scratch.drop(live)
    other = many.toDF("key", "y", "ny", "j", "d")
    rest = _verified(many.join(other, "key").where("x < y and c <> d").where(fits).select("x", "y").distinct(), docs, heads, shingle, similarity, scratch)
    scratch.drop(many)
    roots = components(stars.unionByName(rest).select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    named = heads.select("g", "rep").join(roots.withColumnRenamed("node", "g"), "g", "left").select("g", "rep", F.coalesce("component", "g").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    return marks.select("doc_id", "g").join(named.join(least, "c").select("g", "component_id"), "g", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that are near-duplicates of a row with a smaller doc_id.

    Of rows with one doc_id all stay or go together; rows without a doc_id stay.  Null texts are empty, and
    texts without words are copies of each other.  Texts of any length are read whole; other columns are
    carried along; an empty table gives an empty result.
    """
    gone = similar(docs, shingle, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")


def query(spark, sf_dir):
    from .common import read

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
