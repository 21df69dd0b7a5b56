"""Main text of HTML pages with a suffix array per host.

A page becomes blocks (paragraphs, headings, list items, cells ...) with their
container.  The pages of a host are dealt into chunks of about ``CHUNK_BYTES``
by a hash, so a host with a third of all pages is many small groups.  In a
chunk the token streams of all pages (a mark per block, then its words) are
concatenated and their suffixes sorted by prefix doubling; neighbours in that
order give the longest repeated runs.  Runs of ``RUN`` tokens or more that
occur on enough distinct pages of the host are template text, and blocks they
cover by ``COVERED`` percent are boilerplate.

A host of several chunks is counted as a whole in three passes over its chunks:
1. each chunk names the runs that half of ``FEW`` percent of its pages have; a
   run that could reach ``FEW`` percent of the host's pages, were it just under
   that bound in all other chunks, is a candidate, so none is lost, and a host
   has no more of them than some 20 of its pages have runs;
2. each chunk counts the pages of every candidate, and the sums are exact;
3. the blocks are covered by the runs that are frequent on the host.

What is kept, in page order:
* blocks outside markup that says it is no article (nav, header, footer, aside,
  form, script ..., or a class, id or role of ``AWAY``; a header inside an
  article stays if it has a heading, and an article element named as a teaser or
  a comment is no article);
* if the page has an article or main element, only blocks inside it, except
  those covered by runs that ``MOST`` percent of a host of ``SURE`` pages have
  (an article that was copied to some pages is no template);
* else blocks that are not covered by runs of ``FEW`` percent of the host's
  pages, two pages at least.

Defined cases: null html gives an empty text; truncated pages and unclosed
elements end with the page; a null or odd url is the host ''; repeated rows
are repeated pages, equal rows count as one page for the runs; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import cut, partitions

CHUNK_BYTES = 1 << 20
TASK_BYTES = 32 << 20  # of pages that a task has, about
MOST_HOSTS = 100_000  # (host, bytes) rows that are broadcast at most: some MB
RUN = 6
DEPTH = 6        # doublings: suffixes are ordered by their first RUN * 2 ** DEPTH tokens
COVERED = 80
SURE, MOST = 20, 80
FEW = 10

AWAY_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select option textarea menu dialog object canvas head title".split())
AWAY = frozenset(("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices newsletter subscribe signup popup modal overlay "
                  "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer copyright legal share sharing social related "
                  "recommended comment comments reply replies respond discussion disqus widget toolbar search login skip").split())
TEASERS = [[x] for x in "related recommended teaser promo sponsored sponsor ad advert widget comment reply".split()]
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
                    "li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")
_TITLED = re.compile(r"(?:(?!</header).)*?<h[1-6]\b", re.S | re.I)  # a heading before the header's end


def _is_away(tag: str, attributes: str) -> bool:
    if tag in AWAY_TAGS:
        return True
    if "=" not in attributes or tag in ("body", "html", "main"):
        return False
    for name, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value.strip() in AWAY_ROLES:
                return True
        elif tag == "article":  # named after what it is: related-post, comment; not after what it has: with-sidebar
            if any(_PART.findall(word)[:1] in TEASERS for word in value.split()):
                return True
        elif any(not AWAY.isdisjoint(_PART.findall(word)) for word in value.split()):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[str, str, bool, bool]], bool]:
    """([(mark, text, away, in_main)], whether the page has a main element)."""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    away, main, has_main = False, False, False
    mark, parts, at, n = "", [], 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((mark, text, away, main))
            parts.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", page[at:])  # a tag that the page's end cuts off
            parts.append(page[at:at + cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    away, main = stack[-1][1:] if stack else (False, False)
                    break
            continue
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[0].endswith("/>"):
            continue
        if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            stack.pop()  # its end tag was left out
            away, main = stack[-1][1:] if stack else (False, False)
        if tag == "header" and main and not away and _TITLED.match(page, at):
            stack.append((tag, away, main))  # an article's own header, with its title and lead
            mark = f"<{tag}{m[3]}>"
            continue
        away = away or _is_away(tag, m[3])
        main = main or (tag in MAIN and not away) or 'role="main"' in m[3]  # a teaser among related posts is no article
        has_main = has_main or main
        stack.append((tag, away, main))
        if tag in BLOCKS:
            mark = f"<{tag}{m[3]}>"
    close()
    return out, has_main


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common start of each with the one before).

    Letters of the order are hashed runs of RUN tokens, so a suffix whose first
    run occurs once has its place after the first sort; only groups of equal
    starts are sorted on, by doubling (Larsson and Sadakane, 1999), up to
    2**DEPTH runs.  Common starts are counted in whole runs."""
    n = len(tokens)
    grams = np.concatenate([W.window_hashes(W.mix(tokens.view(np.uint64)), RUN), W.mix(np.arange(n, n + min(RUN - 1, n), dtype=np.uint64))])
    order = np.argsort(grams)
    rank = np.empty(n, np.int64)  # place of the first suffix with an equal start
    first = np.concatenate([[True], grams[order[1:]] != grams[order[:-1]]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], RUN
    for _ in range(DEPTH):
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        follow = np.where(active + step < n, rank[np.minimum(active + step, n - 1)], -1)
        by = np.lexsort((follow, rank[active]))
        active, follow, old = active[by], follow[by], rank[active[by]]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        index = np.arange(len(active))
        place = old + index - np.maximum.accumulate(np.where(new_group, index, 0))
        order[place] = active
        changed = new_group | np.concatenate([[True], follow[1:] != follow[:-1]])
        rank = rank.copy()
        rank[active] = place[np.maximum.accumulate(np.where(changed, index, 0))]
        levels.append(rank)
        step *= 2
    common, a, b = np.zeros(n, np.int64), order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[1 + same] += RUN << k
        a[same] += RUN << k
        b[same] += RUN << k
    return order, common


def _distinct(of: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """Distinct pages of each of the groups 0 .. n-1."""
    pages = int(page.max(initial=0)) + 1
    return np.bincount(np.unique(of * np.int64(pages) + page) // pages, minlength=n)


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For every token, on how many distinct pages the most common repeated run
    that covers it occurs (0: no run of RUN tokens is on two pages)."""
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, common = suffix_array(tokens)
    start = common < RUN  # a new group of suffixes with a common run
    group = np.cumsum(start) - 1
    near = np.flatnonzero((np.bincount(group) > 1)[group])  # places in groups of two suffixes or more
    if not len(near):
        return out
    distinct = _distinct(group[near], page[order[near]], int(group[-1]) + 1)[group[near]]
    hit = distinct > 1
    at, on = order[near[hit]], distinct[hit]
    for j in range(RUN):  # longer runs are covered by the runs that start inside them
        np.maximum.at(out, at + j, on)
    return out


@lru_cache(1 << 14)
def _mark_hash(mark: str) -> int:
    return int.from_bytes(blake2b(mark.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def packed(page: str | None) -> tuple[str, list[int], bytes, bool]:
    """(texts of the blocks by line, hashes of their marks, 1 for away plus 2
    for in main by block, whether the page has a main element)."""
    found, has_main = blocks(page or "")
    return ("\n".join(text for _, text, _, _ in found), [_mark_hash(mark) for mark, _, _, _ in found],
            bytes(away + 2 * in_main for _, _, away, in_main in found), has_main)


class Stream:
    """The tokens of the pages of a chunk one after the other: of each block the
    hash of its mark and those of its words, and an end of its own per page.
    ``same_page`` numbers equal pages alike."""

    def __init__(self, texts: list[str], marks: list[list[int]], same_page: list[int]):
        self.lines = [text.split("\n") if own else [] for text, own in zip(texts, marks, strict=True)]
        words = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in W.words_of(pa.array(texts, pa.large_string()), lower=False))])
        size = np.array([text.count(" ") + 1 for own in self.lines for text in own], np.int64)  # words of each block
        held = np.array([len(own) for own in marks], np.int64)  # blocks of each page
        of_page = np.repeat(np.arange(len(held)), held)
        before = np.cumsum(size) - size
        self.start = before + np.arange(len(size)) + of_page
        self.stop = self.start + size + 1
        tokens = np.bincount(of_page, size + 1, len(held)).astype(np.int64) + 1
        end = np.cumsum(tokens) - 1
        self.tokens = np.empty(int(tokens.sum()), np.int64)
        self.tokens[self.start] = np.fromiter(chain.from_iterable(marks), np.int64, len(size))
        self.tokens[np.repeat(self.start + 1 - before, size) + np.arange(len(words))] = words.view(np.int64)
        self.tokens[end] = -1 - np.arange(len(held))
        self.page = np.repeat(np.array(same_page, np.int64), tokens)
        self.distinct = len(set(same_page))
        ends = np.zeros(len(self.tokens) + 1, np.int64)
        ends[end + 1] = 1
        ends = np.cumsum(ends)
        self.whole = np.flatnonzero(ends[RUN:] == ends[:-RUN])  # where a run of RUN tokens is inside its page

    def runs(self) -> np.ndarray:
        """Hashes of the runs of RUN tokens at ``whole``; they are the same in every chunk."""
        return W.window_hashes(W.mix(self.tokens.view(np.uint64)), RUN)[self.whole].view(np.int64) if len(self.whole) else np.zeros(0, np.int64)

    def common_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(run, its distinct pages) of the runs of ``_least`` pages, by the order of the suffixes."""
        if not len(self.whole):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, common = suffix_array(self.tokens)
        start = common < RUN
        group = np.cumsum(start) - 1
        on = _distinct(group, self.page[order], int(group[-1]) + 1)
        of = np.full(len(self.tokens), -1)  # the place of a run in ``runs``
        of[self.whole] = np.arange(len(self.whole))
        place = of[order[start]]
        named = (place >= 0) & (on >= _least(self.distinct))
        return self.runs()[place[named]], on[named]

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, its distinct pages here) of those ``wanted`` that are here."""
        wanted = np.unique(wanted)
        at, hit = _found(self.runs(), wanted)
        on = _distinct(at[hit], self.page[self.whole[hit]], len(wanted))
        return wanted[on > 0], on[on > 0]

    def covered(self, run: np.ndarray, on: np.ndarray) -> np.ndarray:
        """For every token, the largest ``on`` of the runs that cover it (0: none)."""
        by = np.argsort(run)
        at, hit = _found(self.runs(), run[by])
        out, here = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        here[self.whole[hit]] = on[by][at[hit]]
        for j in range(min(RUN, len(out))):
            np.maximum(out[j:], here[:len(out) - j], out=out[j:])
        return out

    def main_texts(self, on_pages: np.ndarray, kinds: list[bytes], has_main: list[bool], distinct: int) -> list[str]:
        """Main texts of the pages, on a host with ``distinct`` pages."""
        few, most = max(2, -(-distinct * FEW // 100)), max(2, -(-distinct * MOST // 100))
        sums = {level: np.concatenate([[0], np.cumsum(on_pages >= level)]) for level in (few, most)}
        covered = {level: (100 * (x[self.stop] - x[self.start]) >= COVERED * (self.stop - self.start)).tolist() for level, x in sums.items()}
        out, b = [], 0
        for lines, kind, main in zip(self.lines, kinds, has_main, strict=True):
            kept = []
            level = most if main else few
            checked = distinct >= SURE if main else True
            for text, k in zip(lines, kind, strict=True):
                if not (k & 1 or (main and not k & 2) or (checked and covered[level][b])):
                    kept.append(text)
                b += 1
            out.append("\n\n".join(kept))
        return out


def _found(runs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each run in the sorted ``known``, whether it is there)."""
    if not len(known):
        return np.zeros(len(runs), np.int64), np.zeros(len(runs), bool)
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return at, known[at] == runs


def _least(distinct: int) -> int:
    """Pages of a chunk of ``distinct`` pages that a run must have to be named."""
    return max(1, distinct * FEW // 200)


def _same_pages(table: pa.Table) -> list[int]:
    number: dict[tuple, int] = {}
    return [number.setdefault(key, len(number)) for key in zip(table.column("page_id").to_pylist(), table.column("url").to_pylist(), strict=True)]


def main_texts(pages: list[str | None], same_page: list[int]) -> list[str]:
    """Main texts of the pages of a host; ``same_page`` numbers equal pages alike."""
    texts, marks, kinds, has_main = (list(x) for x in zip(*map(packed, pages), strict=True))
    stream = Stream(texts, marks, same_page)
    return stream.main_texts(repeated(stream.tokens, stream.page), kinds, has_main, stream.distinct)


_OUT = "page_id long, url string, text string, n_chars long"


def _rows(table: pa.Table, texts: list[str]) -> pa.Table:
    return pa.table({"page_id": table.column("page_id").cast(pa.int64()), "url": table.column("url").cast(pa.string()), "text": pa.array(texts, pa.string()),
                     "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def _of_small_hosts(dealt: DataFrame, tasks: int) -> DataFrame:
    """Hosts of one chunk."""

    def run(table: pa.Table) -> pa.Table:
        return _rows(table, main_texts(table.column("html").to_pylist(), _same_pages(table)))

    return dealt.select("host", "chunk", "page_id", "url", "html").repartition(tasks, "host", "chunk").groupBy("host", "chunk").applyInArrow(run, _OUT)


def _of_large_hosts(dealt: DataFrame, tasks: int) -> DataFrame:
    """Hosts of several chunks, with the host's ``chunks`` and distinct ``pages``
    and ``slack``, the pages that a run may have in its chunks without being named."""
    level = F.greatest(F.lit(2), F.ceil(F.col("pages") * FEW / 100)).cast("long")
    dealt = dealt.select("host", "chunk", "page_id", "url", "chunks", "pages", level.alias("level"), "slack", "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, kinds, has_main = (list(x) for x in zip(*map(packed, batch.column("html").to_pylist()), strict=True)) if batch.num_rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.int64())), pa.array(kinds, pa.binary()),
                                              pa.array(has_main, pa.bool_())], [*batch.schema.names[:-1], "texts", "marks", "kinds", "has_main"])

    def stream(table: pa.Table) -> Stream:
        return Stream(table.column("texts").to_pylist(), table.column("marks").to_pylist(), _same_pages(table))

    def counted(table: pa.Table, run: np.ndarray, n: np.ndarray) -> pa.Table:
        of_host = {c: pa.array([table.column(c)[0].as_py()] * len(run), t) for c, t in (("host", pa.string()), ("chunks", pa.int64()), ("level", pa.int64()), ("slack", pa.int64()))}
        return pa.table(of_host | {"run": pa.array(run, pa.int64()), "n": pa.array(n, pa.int64())})

    def name(table: pa.Table) -> pa.Table:
        chunk = stream(table)
        run, on = chunk.common_runs()
        return counted(table, run, on - (_least(chunk.distinct) - 1))

    def count(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows or not wanted.num_rows:
            return counted(wanted, *[np.zeros(0, np.int64)] * 2) if wanted.num_rows else counted(table, *[np.zeros(0, np.int64)] * 2)
        return counted(table, *stream(table).counts(_flat(wanted, "runs")))

    def texts(table: pa.Table, frequent: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(table, [])
        chunk = stream(table)
        on_pages = chunk.covered(_flat(frequent, "runs"), _flat(frequent, "ns"))
        return _rows(table, chunk.main_texts(on_pages, table.column("kinds").to_pylist(), table.column("has_main").to_pylist(), table.column("pages")[0].as_py()))

    def to_chunks(counts: DataFrame, enough) -> DataFrame:
        """The runs of a host beside each of its chunks."""
        rows = counts.groupBy("host", "chunks", "level", "slack", "run").agg(F.sum("n").alias("n")).filter(enough)
        of_host = rows.groupBy("host", "chunks", "level", "slack").agg(F.collect_list(F.struct("run", "n")).alias("r"))  # of some 20 pages of a host at most
        return of_host.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "chunks", "level", "slack",
                              F.col("r.run").alias("runs"), F.col("r.n").alias("ns"))

    # one shuffle of the parsed pages, which all three passes read
    parsed = dealt.mapInArrow(parse, "host string, chunk long, page_id {}, url string, chunks long, pages long, level long, slack long, texts string, marks array<long>, kinds binary, "
                              "has_main boolean".format(dealt.schema["page_id"].dataType.simpleString())).repartition(tasks, "host", "chunk")
    chunks = parsed.groupBy("host", "chunk")
    run_counts = "host string, chunks long, level long, slack long, run long, n long"
    named = to_chunks(chunks.applyInArrow(name, run_counts), F.col("n") + F.col("slack") >= F.col("level"))
    frequent = to_chunks(chunks.cogroup(named.groupBy("host", "chunk")).applyInArrow(count, run_counts), F.col("n") >= F.col("level"))
    return chunks.cogroup(frequent.groupBy("host", "chunk")).applyInArrow(texts, _OUT)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.array([v for row in table.column(name).to_pylist() for v in row], np.int64)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("bytes"))
    # pages are not shuffled to find their host's size while the hosts are few enough to send, which is checked
    sizes = cut(sizes.withColumn("chunks", F.ceil((F.col("bytes") + 1) / F.lit(CHUNK_BYTES)).cast("long")))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(partitions(pages.sparkSession), -(-int(total) // TASK_BYTES))  # grows with the pages
    sent = F.broadcast if sizes.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS else (lambda df: df)
    chunk = F.pmod(F.xxhash64("page_id", "url"), "chunks")
    # dealt by both on purpose: a join by host would otherwise leave all chunks of a host in one task
    small = _of_small_hosts(rows.join(sent(sizes.filter("chunks = 1")), "host").withColumn("chunk", chunk), tasks)
    large = sizes.filter("chunks > 1").drop("bytes")
    if large.isEmpty():
        return small
    in_chunk = (rows.drop("html").join(sent(large), "host").withColumn("chunk", chunk).distinct()
                .groupBy("host", "chunks", "chunk").agg(F.count(F.lit(1)).alias("n")))
    least = F.greatest(F.lit(1), F.floor(F.col("n") * FEW / 200))  # _least
    large = cut(in_chunk.groupBy("host", "chunks").agg(F.sum("n").alias("pages"), F.sum(least - 1).cast("long").alias("slack")))
    return small.unionByName(_of_large_hosts(rows.join(sent(large), "host").withColumn("chunk", chunk), tasks))
