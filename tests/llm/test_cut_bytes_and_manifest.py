"""Fill-in-middle, byte-level BPE by ranks and the Merkle manifest, against brute force."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, fill_middle, merkle
from larkspur.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
LONG = " ".join(f"word{i % 700}{'x' * (i % 9)}" for i in range(90_000))
TEXTS = [
    None, "", " ", " \t\n", "one", " two words ", "a\x01b \x02a\x02b \x01", "\x01", "\x02\x02 \x01\x01a", "has <P> in it", "nearly <S <M", "<", "é ü ß x  y", "\U0001f600 \U0001f601\n\n\U0001f602 z",
    "tabs\tand\x0bvertical\x0cfeeds\r\n", "don't we'll I'd 12345 67 !!! ...", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "antidisestablishmentarianism " * 3, "\x00\x00 nul", "Ünïcödé " * 20, LONG, "one", "one", "zq" * 3000, "日本語のテキスト 中文 한국어 العربية",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, form string, node string, _marked string, idx int"


def rows_of(texts):
    rows = [(i, t, [None, "en", "de", "", "en"][i % 5], [None, "s", "t"][i % 3], None if t is None else len(t), "x", "y", "z", 1) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id", "en", "s", 5, "x", "y", "z", 1), (None, None, None, None, None, "x", "y", "z", 1), (-3, "AbC", "solo", "s", 3, "x", "y", "z", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark):
    """Every text under ids that cut it in every form, with delimiters and escapes in the texts."""
    rows = [(i * len(TEXTS) + j, t) for i in range(12) for j, t in enumerate(TEXTS) if t is not LONG or i < 3] + [(None, "no id here"), (7, "one"), (7, "one")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, form string, _text string")
    cut = fill_middle.transformed(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["back"]) for r in cut))) == sorted(repr((i, *brute_middle(i, t), t or "")) for i, t in rows)
    assert {r["form"] for r in cut} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(df.where("false")).count() == 0


def test_byte_bpe(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path, pattern = public_tokenizers.path(name), public_tokenizers.PATTERN
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        ids = byte_bpe.encoded(docs, path, pattern)
        got = {r["doc_id"]: r["ids"] for r in ids.collect()}
        want = {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
        assert {i: got[i] for i in want} == want
        back = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decoded(ids, path, pattern).collect()}
        assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
        told = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs, path, pattern).collect()}
        assert all(told[i] == (len(want[i]), sha(" ".join(map(str, want[i]))), sha(t or "")) for i, t in enumerate(TEXTS))
    assert byte_bpe.round_trip(docs.where("false"), path, pattern).count() == 0


def test_segment_tree_merges_as_scanning_does():
    """Pieces of every kind, also such as are tokens, beside a scan for the leftmost least rank."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(path, r"\S+")
    import numpy as np

    rng = np.random.default_rng(2)
    for n in [*range(1, 40), 200, 511, 512, 513]:
        for letters in (b"ab", b"etaoin shrdlu", bytes(range(256))):
            piece = bytes(letters[i] for i in rng.integers(0, len(letters), n))
            parts = [piece[i : i + 1] for i in range(n)]
            while rules := [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ranks]:
                i = min(rules)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want = [codec.ranks[p] for p in parts]
            assert codec.merged(piece) == want
            if n > 1:
                assert all(np.frombuffer(found, np.int32).tolist() == want for w in byte_bpe.WIDTHS if n <= w + 1 for found in codec.forest([piece, b"the", piece], w)[::2])
    codec.merged(b"ab" * 200_000)


def brute_manifest(rows, fanout=8):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            run = i - i % fanout
            yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])
            i //= fanout

    trees = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "=" + r[2], []).append((r[0] is not None, r[0] or 0, digest(r, r[1]), r))
    names = sorted(trees, key=str.encode)
    levels = {x: climb([leaf for *_, leaf, _ in sorted(trees[x], key=lambda t: t[:3])]) for x in names}
    tops = climb([levels[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            way = [*path(levels[x], i), *path(tops, k)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = digest(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for before, after in way:
                node = sha(before + node + after)
            out.append((r[0], leaf, levels[x][-1][0], tops[-1][0], sha("".join(b + a for b, a in way)), node, node == tops[-1][0]))
    return out


@pytest.mark.parametrize("fanout,depth,times", [(8, 3, 40), (2, 1, 6), (2, 2, 6), (3, 4, 6)])
def test_merkle(spark, fanout, depth, times):
    """Nulls, repeated rows, many and few rows a language, several rounds of superblocks; clashing columns."""
    texts = [t for t in TEXTS if t is not LONG] * times
    rows = rows_of(texts if fanout == 8 else [f"{t} {i}" for i, t in enumerate(texts)])
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout, depth, parts=5)
    assert got.columns == columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute_manifest(rows, fanout)))


def test_merkle_of_few_rows(spark, docs):
    rows = rows_of(TEXTS)
    for some in ([], rows[:1], rows[:2], rows[1:7:5]):
        got = merkle.manifest(spark.createDataFrame(some, SCHEMA)).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute_manifest(some) if some else []))


@needs_tables
@pytest.mark.parametrize("name", ["op11_fill_middle_markers", "op13_merkle_superblocks"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, want = queries()[name](spark, DIR).toPandas(), con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: sorted(map(repr, x[sorted(want.columns)].astype(object).where(lambda v: pd.notna(v), None).itertuples(index=False, name=None)))
    strip = lambda x: [re.sub(r"np\.\w+\((\w+)\)", r"\1", r).replace(".0,", ",") for r in x]
    assert strip(plain(got)) == strip(plain(want))
