"""Operators on texts against brute force, with null, empty, long and repeated rows and clashing columns."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import bpe, fingerprint, html_extract, lm_scoring, sentence_dedup, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, source string, size int, froms string, version string, bucket int"
RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(RNG.choice(WORDS, 3000).tolist())


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n).tolist())


@pytest.fixture(scope="module")
def texts():
    shared = prose(60)
    out = [prose(40) for _ in range(12)]
    out += [out[0], out[0], out[1] + " more", None, "", "   ", "a", LONG, "é" * 300 + " ü " + shared, prose(5) + shared + prose(9), shared, shared.upper(), "tail " + LONG[:3000]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", 9, "x", "y", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty, texts):
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    assert got == {i: (prints[i], c) for i, c in enumerate(brute_components(len(texts), links))}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [2, 64])
def test_pigeonring_links(spark, limit):
    from larkspur.llm.common import Scratch, components

    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 62, 12)
    prints = sorted({int(b) ^ sum({1 << int(k) for k in rng.integers(0, 62, rng.integers(0, 4))}) for b in base for _ in range(12)})
    near = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), Scratch(spark), limit)
    number = {p: i for i, p in enumerate(prints)}
    found = [(number[r["x"]], number[r["y"]]) for r in near.collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    assert sorted({(max(p), min(p)) for p in found}) == sorted(want)
    edges = spark.createDataFrame([(a, b) for a, b in found] + [(5, 5)], "a long, b long")
    named = {r["node"]: r["component"] for r in components(edges, Scratch(spark)).collect()}
    assert all(named[a] == brute_components(len(prints), found)[a] for a, _ in found)


def test_keep_one(docs, empty, spark):
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {0, 2, 18} <= kept and not {12, 13, 23} & kept
    text = prose(400, np.random.default_rng(8)).split()
    near = [" ".join(text[:k] + ["changed"] + text[k + 1 :]) for k in (100, 200, 300)]
    found = simhash.keep_one(spark.createDataFrame(list(enumerate([" ".join(text), *near, prose(400)])), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 4]
    assert simhash.keep_one(empty).count() == 0


def brute_shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else set()


def brute_similar(texts, similarity=0.8):
    sets = [brute_shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    return brute_components(len(texts), linked)


def test_similar_beside_a_head_that_is_no_copy(spark):
    """Two copies of a text link, though a smaller doc_id has the same words in another order."""
    rng = np.random.default_rng(5)
    wide = [f"v{i}" for i in range(2000)]
    rows = []
    for _ in range(6):
        text = rng.choice(wide, 120).tolist()
        for order in range(3):
            mixed = rng.permutation(text).tolist() if order else text
            rows += [" ".join(mixed)] + ([" ".join([*mixed, "more"])] * 2 + [" ".join(mixed[1:])] if order else [])
    found = simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(brute_similar(rows)))


def test_similar_finds_every_copy(spark):
    """Copies with the end cut off, a block appended or words changed here and there, about and below similarity 0.8."""
    rng = np.random.default_rng(11)
    wide = [f"v{i}" for i in range(5000)]
    rows = []
    for n in (9, 40, 203, 600):
        for share in (0.02, 0.05, 0.1, 0.15, 0.19, 0.21, 0.25):
            cut, added, some = (rng.choice(wide, n).tolist() for _ in range(3))
            rows += [" ".join(cut), " ".join(cut[: round(n * (1 - share))]), " ".join(added), " ".join(added + rng.choice(wide, round(n * share)).tolist()), " ".join(some)]
            for i in rng.choice(n, max(1, round(n * share / 10)), replace=False):
                some[i] = "changed"
            rows.append(" ".join(some))
    rows += ["one common line of nine words at the top " + r for r in rows[::7]] + [None, "", "a", "a b", "A  B"]
    found = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(found).collect()} == dict(enumerate(brute_similar(rows)))


def brute_removed(texts, length):
    where = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        where.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone].tobytes())
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 16384), (100, 1), (400, 16384)])
def test_suffix_family(docs, empty, texts, length, hot):
    got = sorted(tuple(r) for r in suffix_dedup.measured(docs, length, hot).collect())
    want = brute_removed([*texts, texts[0]], length)
    assert got == sorted((i % len(texts), *w) for i, w in enumerate(want))
    assert suffix_dedup.measured(empty).count() == 0


def test_suffix_family_beside_shorter_strings(docs, empty, texts):
    got = sorted(tuple(r) for r in suffix_dedup.measured(docs, 200, 2, shorter=100).collect())
    rows = [*texts, texts[0]]
    want = [(i % len(texts), *a, b[1]) for i, (a, b) in enumerate(zip(brute_removed(rows, 200), brute_removed(rows, 100)))]
    assert got == sorted(want) and any(a != b for *_, a, _, _, b in want)
    assert suffix_dedup.measured(empty, shorter=256).count() == 0


def test_removed_keeps_columns(docs, texts):
    out = suffix_dedup.removed(docs, 100)
    assert out.dtypes == docs.dtypes
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[15]["text"] is None and rows[0]["froms"] == "x"
    assert rows[12]["text"] == "" and rows[18]["text"] == "a"


def test_suffix_levels_merge():
    family, flags = suffix_dedup.Family(), np.zeros(200, bool)
    prints = np.arange(200, dtype=np.uint64)
    prints[150] = prints[3]
    for i in range(0, 200, 10):
        family.add(prints[i : i + 10], prints[i : i + 10], np.arange(i, i + 10), flags)
    assert np.flatnonzero(flags).tolist() == [3, 150]
    assert len(family.levels) <= 6 and all(len(a[0]) > 2 * len(b[0]) for a, b in zip(family.levels, family.levels[1:]))


def test_lm_counts(docs, empty, texts):
    got = {r["doc_id"]: r for r in lm_scoring.scored(docs).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    train = Counter(w for i, ts in enumerate(tokens) if not held[i] for w in ts * (2 if i == 0 else 1))
    n, v = sum(train.values()), len(train)
    for i, ts in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(w in train for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), abs=1e-6)
        assert r["score"] < 0
    assert got[20]["score"] > got[20]["base_score"]
    assert lm_scoring.scored(empty).count() == 0


def test_lm_distribution():
    w = lm_scoring.mixture(np.array([1, 2, 2]), np.array([3.0, 5.0, 2.0]), np.array([0.2, 0.9, 0.0]), np.array([0.1, 0.01, 0.2]), 0.001)
    assert w.sum(1) == pytest.approx(1.0) and (w >= 0).all()
    assert w[2][0] < w[1][0]


def brute_scores(texts, ids):
    """The model of lm_scoring counted with dictionaries, its weights from the same table of cells."""
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in ids]
    uni, pairs = Counter(), Counter()
    for ts, mine in zip(tokens, train):
        if mine:
            uni.update(ts)
            pairs.update(zip([None, *ts], ts))
    n, v = sum(uni.values()), len(uni)
    bucket = lambda c: int(np.floor(np.log2(c))) + 1 if c else 0
    step = lambda p: min(int(np.floor(-np.log2(p) * lm_scoring.STEPS)), 253) if p > 0 else 255
    cells = defaultdict(lambda: np.zeros(3))
    for ts, mine in zip(tokens, train):
        for c, w in zip([None, *ts], ts) if mine else ():
            p2 = (pairs[c, w] - 1) / (uni[c] - 1) if uni[c] > 1 else 0.0
            p1 = (uni[w] - 1) / (n - 1)
            cells[bucket(uni[c]), step(p2), step(p1)] += 1, p2, p1
    total = np.array(list(cells.values()))
    weights = lm_scoring.mixture(np.array([k[0] for k in cells]), total[:, 0], total[:, 1] / total[:, 0], total[:, 2] / total[:, 0], 1 / (v + 1))
    chance = lambda c, w: weights[bucket(uni[c])] @ [pairs[c, w] / uni[c] if uni[c] else 0.0, uni[w] / n, 1 / (v + 1)]
    return [sum(log10(chance(c, w)) for c, w in zip([None, *ts], ts)) for ts in tokens]


@pytest.mark.parametrize("frequent", [0, 3, 8, 1 << 18])
def test_lm_scores(docs, texts, frequent):
    """Frequent and rare contexts and tokens alike, whichever side of the broadcast table they are on."""
    want = brute_scores([*texts, texts[0]], [*range(len(texts)), 0])
    got = lm_scoring.scored(docs, frequent).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_lm_without_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm_scoring.scored(spark.createDataFrame([(i, "two words") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r["held_out"] and r["train_tokens"] == r["n_known"] == 0 and r["score"] <= 0 for r in got)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 800)
    rows = [(i, f"{prose(25, rng)} {'you VILE fool' if y else 'kind day'}! {prose(25, rng)}") for i, y in enumerate(labels)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "word " * 60_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert 0 < len(model[0]) < 2000
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    out = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == labels[i] for i in out]) > 0.97
    assert got[900] == got[901] and 0 <= got[902] <= 1
    kept = toxicity.scored(docs, model, keep_below=toxicity.THRESHOLD)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.THRESHOLD}
    assert toxicity.scored(empty, toxicity.learn(empty, marks)).count() == 0


def test_toxicity_fit_beside_dictionaries(spark):
    """The same passes with plain dictionaries, a coordinate at a time, give the same weights and bias."""
    from math import copysign, exp, sqrt

    from larkspur.llm.hashing import mix

    rng = np.random.default_rng(7)
    labels = rng.integers(0, 2, 300)
    rows = [(i, f"{prose(12, rng)} {'so vile a fool' if y else 'a kind day'} {prose(6, rng)}") for i, y in enumerate(labels)]
    at, weights, bias = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int"))
    known = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    known.sort(key=lambda i: int(mix(np.array([i], np.uint64))[0]))
    import pyarrow as pa

    z, n, b, bn = defaultdict(float), defaultdict(float), -2.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= toxicity.L1 else -(z[k] - copysign(toxicity.L1, z[k])) / ((toxicity.BETA + sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    found = {i: sorted(set(toxicity.features(pa.array([rows[i][1]]))[1].tolist())) for i in known}
    for _ in range(toxicity.PASSES):
        for i in known:
            w = {k: weight(k) for k in found[i]}
            g = 1 / (1 + exp(-(b + sum(w.values())))) - labels[i]
            for k in found[i]:
                z[k] += g - (sqrt(n[k] + g * g) - sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
            bn += g * g
            b -= 0.1 * g / (1 + sqrt(bn))
    want = {k: weight(k) for k in z if weight(k)}
    assert bias == pytest.approx(b) and dict(zip(at.tolist(), weights.tolist())) == pytest.approx(want) and len(want) > 5


def test_fingerprints(spark, docs, empty, texts):
    rows = spark.createDataFrame(list(enumerate([*texts, "Straße  ﬁn", "STRASSE fin"])), "doc_id long, text string")
    every = [t or "" for t in [*texts, "Straße  ﬁn", "STRASSE fin"]]
    got = {r["doc_id"]: r for r in fingerprint.edits(rows, 3).collect()}
    for i, t in enumerate(every):
        following = every[(i + 1) % len(every)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(fingerprint.canonical(t) == fingerprint.canonical(edited))
        assert r["near_next"] == float(fingerprint.canonical(t) == fingerprint.canonical(following))
    groups = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(rows).collect()}
    assert groups[26] == 25 and groups[12] == 0 and groups[23] == 22 and groups[17] == groups[15] == 15
    assert {r["doc_id"] for r in fingerprint.exact_groups(docs).collect()} == set(range(len(texts))) and fingerprint.exact_groups(empty).count() == 0
    assert fingerprint.edits(docs).count() == len(texts) + 1
    assert fingerprint.edits(empty).count() == 0


def brute_sentences(rows, run, least):
    """{(doc_id, text): (sentences, removed, text left)} by comparing every run of every pair of documents."""
    cut = {(i, t): [x for x in re.split(r"(?<=[.!?])(?=[ \t-\r])|(?<=\n)", t or "")] for i, t in rows}
    units = {k: [x.lower().split() for x in v] for k, v in cut.items()}
    runs = []
    for k in sorted(units, key=lambda k: (k[0], k[1] or "")):
        said = [(p, u) for p, u in enumerate(units[k]) if u]
        for a in range(len(said)):
            for b in range(a + run, len(said) + 1):
                if sum(len(u) for _, u in said[a:b]) >= least:
                    runs.append((tuple(" ".join(u) for _, u in said[a:b]), k, a, b))
                    break
    first, gone = {}, defaultdict(set)
    for key, k, a, b in runs:
        if key in first:
            gone[k] |= set(range(a, b))
        else:
            first[key] = True
    return {k: (sum(1 for u in units[k] if u), len(gone[k]), " ".join(" ".join(u) for j, u in enumerate(x for x in units[k] if x) if j not in gone[k])) for k in units}


@pytest.mark.parametrize(("run", "least"), [(2, 12), (3, 0), (2, 0)])
def test_sentence_spans_beside_brute_force(spark, run, least):
    rng = np.random.default_rng(run * 50 + least)
    bank = [prose(int(rng.integers(1, 30)), rng).capitalize() + str(rng.choice([".", "!", "?"])) for _ in range(40)]
    rows = [(i, str(rng.choice([" ", "\n", "  "])).join(bank[j] for j in rng.integers(0, 40, rng.integers(0, 14)))) for i in range(40)]
    passage = " ".join(bank[:5])
    rows += [(50, f"unfinished words {passage} and more"), (51, f"{prose(40, rng)} {passage}"), (52, passage), (53, passage), (54, None), (55, ""), (56, " "), (57, prose(5000, rng)), (3, rows[4][1])]
    want = brute_sentences(rows, run, least)
    got = sentence_dedup.deduplicated(spark.createDataFrame([(*r, 1) for r in rows] + [(*rows[0], 1)], "doc_id long, text string, hash int"), run, least).collect()
    assert len(got) == len(rows) + 1
    by_id = defaultdict(list)
    for (i, _), w in want.items():
        by_id[i].append(w)
    for r in got:
        left = " ".join(r["text"].lower().split())
        assert any(r["n_removed"] == w[1] and left == w[2] for w in by_id[r["doc_id"]])


def test_sentence_spans(spark, empty):
    s = [f"Sentence number {i} has {i * i} little words." for i in range(12)]
    bodies = [" ".join(s[:6]), " ".join(["Start here my friend."] + s[1:5] + ["End it now please."]), " ".join(s[6:]), None, "", "no end", "No one wrote this line of many words that goes on and on and has no end for a long time at all yes. Nor this one which is as long as the other line was and says nothing more."]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(bodies)], "doc_id long, text string, hash int")
    got = {r["doc_id"]: r for r in sentence_dedup.deduplicated(rows).collect()}
    assert got[0]["n_removed"] == 0 and got[2]["n_removed"] == 0
    assert (got[1]["n_removed"], got[1]["text"]) == (4, "Start here my friend. End it now please.")
    assert got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "no end" and got[6]["n_sentences"] == 2
    assert sentence_dedup.deduplicated(empty).count() == 0


def test_sentences_rejoin(texts):
    for t in texts:
        raw = (t or "").encode()
        assert b"".join(sentence_dedup.sentences(raw)[0]) == raw


def test_bpe(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    odd = ["<|endoftext|>hello <|endoftext|>", "naïve ​ café 日本語 🙂🙂", "x" * 700, "  lead\n\n tail \t", "a\u0000b", "don't we'LL 123456"]
    rows = spark.createDataFrame(list(enumerate([*texts, *odd])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(rows, bpe.vocabulary()).collect()}
    for i, x in enumerate([*texts, *odd]):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.round_trip(empty, bpe.vocabulary()).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(docs, bpe.vocabulary()), bpe.vocabulary()).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))


def test_pages(spark):
    line = "All rights are reserved by the big old publishing house of nowhere"
    pages = [f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav>menu</nav><div class='cookie-notice'>cookies</div><p>Unique &amp; text {i} about thing{i * 7}  number\n{i}.</p><p>{line}</p><p>Second{i} part.</p><div id=comments><p>reader</p></div><footer>foot</footer></body></html>" for i in range(6)]
    rows = [(i, f"https://Example.org/{i}", h, "x") for i, h in enumerate(pages)] + [(9, "https://other.org/", None, "x"), (10, None, "", "x"), (11, None, "<p>plain &lt; page", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    for i in range(6):
        want = f"Unique & text {i} about thing{i * 7} number {i}.\nSecond{i} part."
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
    assert got[9]["text"] == got[10]["text"] == "" and got[11]["text"] == "plain < page"
    assert html_extract.main_text(df.where("false")).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    """If every text had one fingerprint, bytes would still make the groups."""
    rows = spark.createDataFrame([(5, "one"), (3, "ONE "), (2, "two"), (9, None), (1, "")], "doc_id long, text string")
    prints = fingerprint.fingerprints(rows).withColumn("fingerprint", F.lit("0"))
    monkeypatch.setattr(fingerprint, "fingerprints", lambda _: prints)
    assert {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(rows).collect()} == {5: 3, 3: 3, 2: 2, 9: 1, 1: 1}


STORY = "The long story of the day goes here and tells what happened in the town by the river. " * 3


@pytest.mark.parametrize(
    "page",
    [
        f'<main class="content no-sidebar"><p>{STORY}</p></main>',
        f'<div class="has-sidebar"><article><p>{STORY}</p></article></div>',
        f'<form action="/"><div><p>{STORY}</p></div></form>',
        f'<div class="comment-free-analysis"><p>{STORY}</p></div>',
        f"<article><header><h1>{STORY}</h1></header></article>",
        f'<div><h2 class="section-header">{STORY}</h2></div>',
        f'<div><p class="social-policy">{STORY}</p></div>',
        f'<article class="teaser"><p>Read this too.</p></article><div><p>{STORY}</p></div>',
        f'<div class="sidebar-layout"><p>{STORY}</p></div>',
        f'<div id="page-header-less"><p>{STORY}</p></div>',
    ],
)
def test_structure_keeps_the_story(page):
    got = html_extract.blocks(f'<html><body><nav>menu</nav><div class="ad">Buy this now.</div>{page}<div class="site-footer">foot</div></body></html>')
    assert STORY.strip() in [text for _, text in got]
    assert not [t for _, t in got if "menu" in t or "Buy" in t or "foot" in t]


@pytest.mark.parametrize("name", ["ad", "ad-banner", "cookie-notice", "comments", "comment-list", "user-comments", "related-posts", "share-buttons", "newsletter-signup", "left-sidebar", "main-nav", "page-header"])
def test_named_parts_go(name):
    for attribute in ("class", "id"):
        assert [t for _, t in html_extract.blocks(f'<div><p>{STORY}</p></div><div {attribute}="{name} x"><p>not this</p></div>')] == [STORY.strip()]


def brute_runs(pages, ids, run=html_extract.RUN):
    """Texts without the blocks that runs on enough pages cover, counted with dictionaries."""
    found = [[(text.split(" "), own) for own, text in html_extract.blocks(p or "")] for p in pages]
    flat = [[(w, own) for words, own in s for w in words] for s in found]
    seen = defaultdict(set)
    for i, s in zip(ids, flat):
        for k in range(len(s) - run + 1):
            seen[tuple(w for w, _ in s[k : k + run])].add(i)
    judged = []
    for s, f in zip(found, flat):
        gone, most = [False] * len(f), [0] * len(f)
        for k in range(len(f) - run + 1):
            n = len(seen[tuple(w for w, _ in f[k : k + run])])
            for j in range(k, k + run):
                pages_, share = html_extract.LEAST[f[j][1]]
                gone[j] |= n >= max(pages_, int(np.ceil(share * len(set(ids)))))
                most[j] = max(most[j], n)
        at, blocks = 0, []
        for words, _ in s:
            blocks.append((" ".join(words), all(gone[at : at + len(words)]), max(most[at : at + len(words)])))
            at += len(words)
        judged.append(blocks)
    hollow = [bool(b) and all(g for _, g, _ in b) for b in judged]
    return ["\n".join(t for t, g, n in b if not g or (h and 2 * sum(hollow) > n)) for b, h in zip(judged, hollow)]


@pytest.mark.parametrize("shard", [1000, 16, 3])
def test_host_runs_beside_brute_force(spark, shard):
    """Runs on some of a host's pages, repeated rows, one long page: the same for any size of shard."""
    rng = np.random.default_rng(9)
    lines = {0.9: prose(12, rng), 0.5: prose(10, rng), 0.36: prose(9, rng), 0.2: prose(15, rng)}
    rows = []
    for i in range(50):
        body = [f"<p>{' '.join(f'u{rng.integers(10**6)}' for _ in range(30))}</p>"] + [f"<{t}>{x}</{t}>" for s, x in lines.items() if i % 50 < 50 * s for t in ("div",)]
        rng.shuffle(body)
        body = "".join(body)
        rows.append((i, "http://big.example/" + str(i), f"<article>{body}</article>" if i % 3 == 0 else f"<div>{body}</div>"))
    rows += [rows[4], rows[4], (60, "http://big.example/long", f"<p>{' '.join(f'w{k}' for k in range(4000))} {lines[0.9]}</p>"), (61, "http://big.example/null", None)]
    want = Counter(zip((r[0] for r in rows), brute_runs([r[2] for r in rows], [r[0] for r in rows])))
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard)
    assert Counter((r["page_id"], r["text"]) for r in got.collect()) == want


@pytest.mark.parametrize("wrap", ["{}", "<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize("part", ['<div class="comments">{}</div>', '<section id="reader-comments">{}</section>', '<ol class="commentlist"><li class="comment">{}</li></ol>', '<div class="ads">{}</div>', '<div class="notice">{}</div>', "<nav>{}</nav>"])
def test_parts_longer_than_the_story_go(wrap, part):
    many = part.format("".join(f"<p>Reader {i} says that {STORY}</p>" for i in range(4)))
    page = wrap.format('<div class="story"><h1>T</h1><p>one sentence</p></div>' + many)
    assert html_extract.blocks(f"<html><body>{page}</body></html>") == [(wrap != "{}", "T"), (wrap != "{}", "one sentence")]


def test_pages_of_one_template(spark):
    """A template block takes no word of what follows it, and a page of nothing else is empty; copies of an article stay."""
    notice = "All the pages of this place are kept by the friends of the old river house"
    rows = [(i, "http://a.example/x", f"<div>{notice}</div><p>Story number {i} about topic {i * i}</p>") for i in range(5)] + [(5, "http://a.example/x", f"<div>{notice}</div>")]
    copy = "<p>One article that many pages of the house have, as it was told to its readers</p><p>and its second part of many words that goes on to the very end</p>"
    rows += [(10 + i, "http://b.example/x", copy) for i in range(5)] + [(20 + i, "http://b.example/x", f"<div>{notice}</div><p>Own text {i}</p>") for i in range(6)]
    rows += [(30 + i, "http://c.example/x", f"<div>{notice}</div>{copy}") for i in range(4)] + [(40 + i, "http://c.example/x", f"<div>{notice}</div><p>Own text {i}</p>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "One article that many pages of the house have, as it was told to its readers\nand its second part of many words that goes on to the very end"
    assert got == {**{i: f"Story number {i} about topic {i * i}" for i in range(5)}, 5: "", **{10 + i: whole for i in range(5)}, **{20 + i: f"Own text {i}" for i in range(6)}, **{30 + i: whole for i in range(4)}, **{40 + i: f"Own text {i}" for i in range(5)}}


def test_copies_are_counted_over_all_shards(spark):
    """Copies about half as many as the pages of their block: the host's count says what stays, not that of a shard."""
    copy, rows = "One article that many pages of the house have, as it was told to its readers", []
    for k in range(1, 12):
        rows += [(i, f"http://h{k}.example/{i}", f"<p>{copy}</p>" + f"<p>Own text {i}</p>" * (i > k)) for i in range(1, 13)]
    want = {(u, copy if i > 6 else "") for i, u, t in rows if "Own" not in t for i in [int(u.split(".")[0][8:])]} | {(u, f"Own text {i}") for i, u, t in rows if "Own" in t}
    for shard in (1000, 5, 3):
        got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard)
        assert {(r["url"], r["text"]) for r in got.collect()} == want


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='", "</script", "<script>", "<div class=ad>", "<form>", "</b>", "<!--", "<", "<p", "<div", '<i a="x">', "<b><p></i>", "<!x", "&amp", "<li>", "<a '>", "<div class='sidebar'><b>x"])
def test_long_pages_take_linear_time(piece):
    for tail in ("", ">", "'>\">"):
        began = time.process_time()
        html_extract.blocks(piece * ((1 << 20) // len(piece)) + tail)
        assert time.process_time() - began < 12


def test_formulas_and_discussions_stay():
    page = '<article><p>Let <math><mi>x</mi></math> be a number.</p><div class="discussion"><p>We find that it holds.</p></div></article>'
    assert html_extract.blocks(page) == [(True, "Let x be a number."), (True, "We find that it holds.")]
    assert html_extract.blocks('<p>a < b and "c > d" <a href="x>y" title=\'">\'>link</a> 1 <2 <p title="open>shut') == [(False, 'a < b and "c > d" link 1 <2'), (False, "shut")]


def test_grouping_helpers():
    totals = defaultdict(int)
    tally = lm_scoring.Tally()
    for _ in range(5):
        keys = np.sort(RNG.integers(0, 50, 30).astype(np.uint64))
        k, c = lm_scoring._count(keys)
        tally.add(k, c)
        for x in keys.tolist():
            totals[x] += 1
    k, c = tally.fold()
    assert dict(zip(k.tolist(), c.tolist())) == dict(totals)
