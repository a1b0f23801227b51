"""Main text of web pages: structure first, then a suffix array over the pages of a host.

Structure: scripts, styles, menus, page headers and footers, dialogs, adverts, navigation, cookie boxes
and reader comments go by their elements, roles and names, at any size; what is named a notice, a
search or a sign-up goes unless the page has no other text.  Forms, and elements whose class or id
names a part of the layout, go only if less than half of the page's text is inside, or an article stands
outside of them, so that a page wrapped in one form, or a layout class with a telling name, keeps its
story.  If the articles of a page hold most of its text, only they are kept.

Host suffix array: the token streams of a host's pages are concatenated and their suffixes sorted
to a depth of ``RUN`` tokens.  Neighbouring suffixes that agree to that depth are a substring
repeated in the host; it is boilerplate if it stands on enough distinct pages of the host: a third
outside of articles, three fifths inside.  Runs go over the borders of blocks, and a block goes if runs
cover all of it; a block with a word of its own stays whole, so no sentence loses its head to the
template before it.  A page all of whose blocks are covered has no text of its own, and a block of it
stays only if the host's such pages are more than half as many as the pages that have the block: these
are copies of one article.

Hosts of over ``SHARD`` pages are dealt into shards by a hash of page_id, yet judged as a whole: the
shards tell the runs that stand on a share of their pages, the sums decide, and runs that only some
shards told are counted again; so are the pages without text of their own, in hosts that have runs on
enough pages.  The result is the same for any size of shard.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepared, signed
from .hashing import mix

RUN = 8
#: Least number and least share of a host's pages for a run outside (False) and inside (True) of articles.
LEAST = {False: (3, 1 / 3), True: (4, 0.6)}
SHARD = 2048
#: Hosts with several shards that may be broadcast; beyond it the host table is joined by a shuffle.
FEW_HOSTS = 10_000

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Attributes up to the end of a tag, quotes closed; a tag in which a quote stays open for so long ends at its first bracket.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LONGEST_TAG = 1 << 16
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot munder mover mstyle".split())
DROPPED = frozenset("head nav footer aside button menu dialog".split())
DOUBTFUL = frozenset("form fieldset".split())
OWN_TEXT = frozenset("article main".split())
TEXTUAL = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption td th tr tbody".split())
# Roles, and names of classes and ids, of parts other than the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# By what becomes of them: gone at any size; gone unless they are all of the page; gone if they hold less than half of it.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus share sharing newsletter pager pagination toolbar".split()
)
ALONE = frozenset("notice notices alert subscribe subscription signup popup login search".split())
LAYOUT = frozenset("banner sidebar sidenav rail header masthead topbar social modal overlay related recommended widget".split())
PARTS = SURE | ALONE | LAYOUT
HOLDERS = frozenset("area bar block body bottom box button buttons container content form group holder icons inner item items left link links list main message nav outer panel posts region right row section slot space stories text thread top unit wrap wrapper zone".split())


def _kind(name: str) -> int:
    return 3 if name in SURE else 2 if name in ALONE else 1


def _named_part(tag: str, attributes: str) -> int:
    """Whether a class, id or role says that the element is no part of the article: 0 no, else the kind of ``_kind``.

    One-word names count for any element but those of page structure; of compound names the last
    word counts (site-footer), or the first before a word for a holder (comment-list), and neither
    for elements of running text (an h2 of class section-header).
    """
    found = 0
    for kind, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            found = max(found, 3 * (value.strip() in ROLES))
            continue
        if tag in ("html", "body", "article", "main"):
            continue
        for name in value.split():
            words = [w for w in re.split(r"[-_:]+", name) if w]
            if len(words) == 1 and words[0] in PARTS and not (tag in TEXTUAL and words[0] in ("header", "banner", "related", "social")):
                found = max(found, _kind(words[0]))
            if len(words) > 1 and tag not in TEXTUAL and words[0] not in ("no", "has", "with", "without", "non", "is", "not"):
                if words[-1] in PARTS:
                    found = max(found, _kind(words[-1]))
                elif words[0] in PARTS and all(w in HOLDERS or w in PARTS or w.isdigit() for w in words[1:]):
                    found = max(found, _kind(words[0]))
    return found


def _marks(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, element, closing, attributes) of tags, and of comments and declarations with an empty element, in order.

    One pass: a bracket that begins no tag is text, and so is all behind the last closing bracket.
    """
    at, last = 0, page.rfind(">")
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        if begin > last:
            return
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            yield begin, at, "", False, ""
            continue
        name = _NAME.match(page, begin + 1)
        if not name:
            at = begin + 1
            continue
        rest = _REST.match(page, name.end(), name.end() + LONGEST_TAG)
        at = rest.end() if rest else page.find(">", name.end()) + 1
        tag, closing = name[2].lower(), bool(name[1])
        yield begin, at, tag, closing, page[name.end() : at - 1]
        if tag in RAW and not closing and page[at - 2] != "/":
            end = _closing(page, tag, at)
            yield at, end, "", False, ""
            at = end


_CLOSING: dict[str, re.Pattern] = {}


def _closing(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of an element whose content is no markup."""
    if tag not in _CLOSING:
        _CLOSING[tag] = re.compile(rf"</{tag}\b", re.I)
    m = _CLOSING[tag].search(page, at)
    return page.find(">", m.end()) + 1 or len(page) if m else len(page)


def blocks(page: str) -> list[tuple[bool, str]]:
    """(within an article or main, text) of the blocks of a page that structure does not rule out, in page order."""
    found: list[tuple[bool, str, tuple[int, ...]]] = []  # with the doubtful elements around it
    weights: list[int] = []  # characters in each doubtful element
    alone: list[bool] = []  # whether it stays only if there is nothing else
    part: list[str] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # (element, ruled out, within an article, doubtful elements)
    opened: Counter[str] = Counter()
    at, out, own, doubts = 0, False, False, ()

    def flush():
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                found.append((own, text, doubts))
                for d in doubts:
                    weights[d] += len(text)

    def closed(depth: int):
        nonlocal out, own, doubts
        if (stack[depth - 1][1:] if depth else (False, False, ())) != (out, own, doubts):
            flush()
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        out, own, doubts = stack[-1][1:] if stack else (False, False, ())

    for begin, end, tag, closing, attributes in _marks(page):
        if begin > at and not out:
            part.append(page[at:begin])
        at = end
        if not tag:
            continue
        if closing:
            if tag not in INLINE:
                flush()
            if opened[tag] > 0:
                closed(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            continue
        if tag == "br" or tag in ("td", "th"):
            part.append(" ") if not out else None
        elif tag not in INLINE:
            flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:  # their end tags are optional
            closed(len(stack) - 1)
        named = _named_part(tag, attributes) if attributes else 0
        gone = out or tag in DROPPED or (tag == "header" and not own) or named == 3
        inside = doubts
        if not gone and (tag in DOUBTFUL or named):
            flush()
            inside = (*doubts[-1:], len(weights)) if len(doubts) > 8 else (*doubts, len(weights))
            weights.append(0)
            alone.append(named == 2)
        if gone != out or inside != doubts or tag in OWN_TEXT or tag not in INLINE or tag == "a":
            if gone != out:
                flush()
            stack.append((tag, gone, own or (tag in OWN_TEXT and not gone), inside))
            opened[tag] += 1
            out, own, doubts = stack[-1][1:]
    if not out:
        part.append(page[at:])
    flush()
    total = sum(len(text) for _, text, _ in found)
    other = any(not any(alone[d] for d in inside) for _, _, inside in found)
    article = any(mine and not inside for mine, _, inside in found)
    stays = [not (other if only else 2 * w <= total) for w, only in zip(weights, alone)]
    kept = [(mine, text) for mine, text, inside in found if all(stays[d] for d in inside) and (mine or not inside or not article)]
    trusted = [b for b in kept if b[0]]
    return trusted if 2 * sum(len(t) for _, t in trusted) >= sum(len(t) for _, t in kept) else kept


def repeats(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, class of each, distinct pages of each class) of all runs of ``run`` tokens, by a suffix array.

    tokens are the concatenated streams of the pages; page numbers them, and several streams can
    have one number.
    """
    n, stream = len(tokens), np.zeros(len(tokens), np.int64)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    stream[1:] = np.cumsum(page[1:] != page[:-1])
    _, rank = np.unique(tokens, return_inverse=True)
    depth = 1
    while depth < run:  # prefix doubling: ranks of suffixes to twice the depth, the last step overlaps
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        after[: n - step][stream[: n - step] != stream[step:]] = -1
        key = rank * np.int64(n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        depth += step
    inside = np.zeros(n, bool)
    inside[: n - run + 1] = stream[: n - run + 1] == stream[run - 1 :]
    suffixes = np.lexsort((page, rank))  # the suffix array, and pages in order within equal prefixes
    suffixes = suffixes[inside[suffixes]]
    if not len(suffixes):
        return suffixes, suffixes, suffixes
    r, p = rank[suffixes], page[suffixes]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    fresh = first | np.concatenate([[True], p[1:] != p[:-1]])
    cls = np.cumsum(first) - 1
    return suffixes, cls, np.bincount(cls, fresh).astype(np.int64)


def boilerplate(starts: np.ndarray, support: np.ndarray, own: np.ndarray, total: int, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run that stands on enough of a host's ``total`` pages; support is that of the run at each start."""
    n = len(own)
    covered = np.zeros(n, bool)
    for inside, (pages, share) in LEAST.items():
        often = support >= max(pages, int(np.ceil(share * total)))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts[often], 1)
        np.add.at(edge, starts[often] + run, -1)
        covered |= (np.cumsum(edge)[:-1] > 0) & (own == inside)
    return covered


class Shard:
    """The pages of one host, or of one shard of it: their blocks as one stream of token hashes."""

    def __init__(self, ids: list, pages: list[list[tuple[bool, str]]]):
        self.pages = [[(own, text.split(" ")) for own, text in page] for page in pages]
        words = [w for page in self.pages for _, b in page for w in b]
        self.tokens = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        self.sizes = [sum(len(b) for _, b in page) for page in self.pages]
        number = {x: i for i, x in enumerate(dict.fromkeys(ids))}
        self.count = len(number)
        page = np.repeat([number[x] for x in ids], self.sizes).astype(np.int64) if ids else np.zeros(0, np.int64)
        self.own = np.repeat([own for p in self.pages for own, _ in p], [len(b) for p in self.pages for _, b in p]).astype(bool)
        self.starts, self.cls, self.support = repeats(self.tokens, page)

    def keys(self) -> np.ndarray:
        """A hash of each class of runs that other shards have too."""
        first = np.searchsorted(self.cls, np.arange(len(self.support)))
        at = self.starts[first] if len(first) else first
        key = np.zeros(len(at), np.uint64)
        for k in range(RUN):
            key += mix(self.tokens[at + k]) * np.uint64((2 * k + 3) ** 11)
        return mix(key)

    def judged(self, support: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Which blocks are boilerplate, the pages that have each, and the pages of such blocks only; ``support`` is that of each class among ``total`` pages."""
        at = support[self.cls]
        covered = boilerplate(self.starts, at, self.own, total)
        most = np.zeros(len(covered), np.int64)  # the pages that have the run of most pages at each token
        for k in range(RUN):
            np.maximum.at(most, self.starts + k, at)
        lengths = np.array([len(b) for page in self.pages for _, b in page], np.int64)
        starts = np.cumsum(lengths) - lengths
        gone = np.logical_and.reduceat(covered, starts) if len(starts) else np.zeros(0, bool)
        often = np.maximum.reduceat(most, starts) if len(starts) else np.zeros(0, np.int64)
        edges = np.cumsum([0, *map(len, self.pages)])
        return gone, often, [b > a and bool(gone[a:b].all()) for a, b in zip(edges, edges[1:])]

    def texts(self, support: np.ndarray, total: int, copies: int | None = None) -> list[str]:
        """Texts without the blocks that are boilerplate; ``copies`` is the host's number of pages of such blocks only, if these are not all its pages."""
        gone, often, hollow = self.judged(support, total)
        copies = sum(hollow) if copies is None else copies
        out, i = [], 0
        for page, empty in zip(self.pages, hollow):
            left = [b for k, (_, b) in enumerate(page, i) if not gone[k] or (empty and 2 * copies > often[k])]
            out.append("\n".join(map(" ".join, left)))
            i += len(page)
        return out

    def told(self, values: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(support of each class, pages, pages without text of their own) of the host, from its counts."""
        total, copies, keys, n = int(values[0]), int(values[1]), values[2::2], values[3::2]
        support = np.zeros(len(self.support), np.int64)
        if len(keys):
            order = np.argsort(keys)
            mine = signed(self.keys())
            at = np.minimum(np.searchsorted(keys[order], mine), len(keys) - 1)
            support = np.where(keys[order][at] == mine, n[order][at], 0)
        return support, total, copies


_OPEN = zstandard.ZstdDecompressor()


def _shards(batches) -> Iterator[tuple[tuple, list, bytes | None, Shard]]:
    """((host, shard), [(page_id, url)], the host's counts if a row without page brings them, pages) of rows sorted by host, shard and kind."""
    key, held, told = None, [], None

    def done():
        pages = [[(x[0] == "1", x[1:]) for x in _OPEN.decompress(d).decode().split("\n") if x] for _, _, d in held]
        return key, [(a, b) for a, b, _ in held], told, Shard([a for a, _, _ in held], pages)

    for batch in batches:
        for host, shard, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, shard) != key:
                if held:
                    yield done()
                key, held, told = (host, shard), [], None
            if kind == 0:
                told = row[2]
            else:
                held.append(row)
    if held:
        yield done()


def _counted(parsed: DataFrame, hosts: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """For each sharded host, its number of pages, of those without text of their own, and its runs that may be boilerplate with their pages, as rows of kind 0.

    A shard tells its runs that stand on half of the least share of its pages or more.  If all shards of
    a host tell a run, its pages are known; else they are counted again, unless the shards that did not
    tell it cannot make the difference.  With the runs known, each shard counts its pages without text of
    their own; hosts without such runs have none.
    """
    low = min(share for _, share in LEAST.values())

    def propose(batches):
        for (host, _), _, _, shard in _shards(batches):
            told = shard.support >= low / 2 * shard.count
            keys = signed(shard.keys()[told])
            yield pa.RecordBatch.from_arrays([pa.array([host] * (len(keys) + 1), pa.string()), pa.array(np.append(keys, 0)), pa.array(np.append(shard.support[told], 0)), pa.array(np.full(len(keys) + 1, shard.count))], ["host", "key", "n", "pages"])

    def count(batches):
        for (host, _), _, told, shard in _shards(batches):
            asked = np.frombuffer(told or b"", np.int64)
            keys = signed(shard.keys())
            hit = np.isin(keys, asked)
            yield pa.RecordBatch.from_arrays([pa.array([host] * int(hit.sum()), pa.string()), pa.array(keys[hit]), pa.array(shard.support[hit])], ["host", "key", "n"])

    def count_hollow(batches):
        for (host, _), _, told, shard in _shards(batches):
            support, total, _ = shard.told(np.frombuffer(told, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([sum(shard.judged(support, total)[2])], pa.int64())], ["host", "copies"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["host", "data"])

    proposed = scratch.keep(_dealt(parsed, parts).mapInArrow(propose, "host string, key long, n long, pages long"))
    totals = proposed.where("key = 0").groupBy("host").agg(F.sum("pages").alias("total"))
    sums = proposed.where("key <> 0").groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("pages").alias("seen")).join(totals, "host")
    need = F.ceil(F.col("total") * F.lit(low))
    sums = scratch.keep(sums.where(F.col("n") + (F.col("total") - F.col("seen")) * F.lit(low / 2) >= need))
    open_ = sums.where("seen < total").select("host", "key")
    known = sums.where(F.col("seen") == F.col("total")).select("host", "key", "n")
    if open_.head(1):
        asked = _told(open_.groupBy("host").agg(F.collect_list("key").alias("k")).mapInArrow(packed, "host string, data binary"), hosts)
        some = parsed.join(open_.select("host").distinct(), "host", "left_semi").select(*parsed.columns)
        known = known.unionByName(_dealt(some.unionByName(asked), parts).mapInArrow(count, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n")))
    pairs = known.groupBy("host").agg(F.flatten(F.collect_list(F.array("key", "n"))).alias("k"))
    told = scratch.keep(totals.join(pairs, "host", "left").select("host", "total", F.coalesce("k", F.array().cast("array<bigint>")).alias("k")))
    whole = lambda rows, copies: _told(rows.select("host", F.concat(F.array("total", copies), "k").alias("k")).mapInArrow(packed, "host string, data binary"), hosts)
    having = told.where(F.size("k") > 0)
    if not having.head(1):
        return whole(told, F.lit(0).cast("long"))
    some = parsed.join(having.select("host"), "host", "left_semi").select(*parsed.columns)
    copies = _dealt(some.unionByName(whole(having, F.lit(0).cast("long"))), parts).mapInArrow(count_hollow, "host string, copies long").groupBy("host").agg(F.sum("copies").alias("copies"))
    return whole(told.join(copies, "host", "left"), F.coalesce("copies", F.lit(0)))


def _told(data: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row of kind 0 for each shard of a host."""
    rows = hosts.join(data, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(0).alias("kind"), "data")
    return rows.select("host", "shard", "kind", F.lit(None).alias("page_id"), F.lit(None).cast("string").alias("url"), "data")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "host", "shard").sortWithinPartitions("host", "shard", "kind", "page_id", "url")


def main_text(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html).

    Null and empty html give an empty text; pages without a host in their url are one host.  Pages of
    any length are read whole.  Repeated rows are separate pages with one page_id, and stand for one
    page when repeats are counted; other columns are not looked at; an empty table gives an empty
    result.
    """
    spark = prepared(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")).where("shards > 1")
    many = large.count()
    large = F.broadcast(large) if many <= FEW_HOSTS else large
    id_type = dict(pages.dtypes)["page_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [pack.compress("\n".join("01"[own] + text for own, text in blocks(x or "")).encode("utf-8", "replace")) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(data, pa.binary())], ["host", "shard", "kind", "page_id", "url", "data"])

    def extract(batches):
        kind = None

        def looked(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(3).type
                yield batch

        for _, held, told, pages in _shards(looked(batches)):
            texts = pages.texts(pages.support, pages.count) if told is None else pages.texts(*pages.told(np.frombuffer(told, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], kind), pa.array([x for _, x in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def parsed(some: DataFrame, shards) -> DataFrame:
        return some.select("host", shards.alias("shard"), F.lit(1).alias("kind"), "page_id", "url", "html").mapInArrow(parse, f"host string, shard int, kind int, page_id {id_type}, url string, data binary")

    if not many:
        ready = parsed(rows, F.lit(0))
    else:
        scratch = Scratch(spark)
        spread = scratch.keep(parsed(rows.join(large, "host"), F.pmod(F.xxhash64("page_id"), F.col("shards")).cast("int")))
        told = _counted(spread, large, scratch, parts)
        ready = parsed(rows.join(large, "host", "left_anti"), F.lit(0)).unionByName(spread).unionByName(told)
    return _dealt(ready, parts).mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long")


def query(spark, sf_dir):
    from .common import read

    return main_text(read(spark, sf_dir, "pages"))
