"""Benchmark decontamination with an FM-index for each shard of training text.

The windows of the benchmark's items are the queries; a task indexes its own texts, shard by shard, once,
and searches all windows in each:

* A word outside the benchmark's vocabulary cannot be in an occurrence, so a shard keeps only runs of
  vocabulary words that are as long as the shortest window, each run ended by a separator of its own.
* Suffixes are sorted by prefix doubling over those not yet told apart; the Burrows-Wheeler transform
  goes into a wavelet matrix (a wavelet tree level by level) whose prefix counts answer ranks.
* Backward search narrows the windows' intervals in step. Occurrences are located by walking to a
  sampled suffix position, and the words they cover merge into removal spans.

The items travel as word numbers, four bytes a word, in blocks of bounded size. A task holds the distinct
words of the whole benchmark and one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.shared import LOWER_SQL, Task, small_batches
from lattice.llm.text import ALNUM, LOWER, U64, blocks, spans, words, words_of

SHARD = 1 << 19  # indexed words of a shard; a longer text is a shard of its own
HELD = 1 << 22  # bytes of text that a shard holds where the text is wanted back
SAMPLE = 8  # every so many positions of a shard are kept for locating
WINDOWS = 1 << 16  # windows searched in step

HITS = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>"


@dataclass(frozen=True)
class Windows:
    """Items as numbers of words (0 is no word), one after another; windows are runs of ``width`` or, of a shorter item, all of it."""

    width: int
    word: np.ndarray
    first: np.ndarray  # where each item's words begin, one more than items
    items: np.ndarray  # item ids

    def by_length(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows x length, item of each) for each length there is."""
        size = np.diff(self.first)
        length = np.minimum(size, self.width)
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = size[own] - n + 1
            start = np.repeat(self.first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            for k in range(0, len(start), WINDOWS):
                yield self.word[start[k : k + WINDOWS, None] + np.arange(n)].astype(np.int64), np.repeat(own, count)[k : k + WINDOWS]


@dataclass(frozen=True)
class Benchmark:
    """The benchmark's distinct words (sorted hashes; a word's number is its place plus 1), its shortest window and its blocks."""

    vocabulary: np.ndarray
    shortest: int
    blocks: list  # of Windows, or broadcasts of them

    def each(self) -> Iterator[Windows]:
        """The blocks one at a time; of a broadcast one the worker keeps nothing where there are several."""
        for x in self.blocks:
            if isinstance(x, Windows):
                yield x
                continue
            yield x.value
            if len(self.blocks) > 1 and hasattr(x, "_value"):
                del x._value


def benchmark_of(items: Iterable[tuple[int, str]], width: int = 8, block_chars: int = 4_000_000) -> Benchmark:
    """The items' words in blocks of about so many characters. Items without id or text have no windows."""
    blocks, now, size = [], [], 0
    for item, text in items:
        if item is not None and len(w := words_of(text, ALNUM)):
            now.append((item, w))
            size += len(text) + 8
            if size >= block_chars:
                blocks.append(now)
                now, size = [], 0
    blocks += [now] if now else []
    vocabulary = np.unique(np.concatenate([np.zeros(0, U64), *(np.unique(np.concatenate([w for _, w in b])) for b in blocks)]))
    shortest = min((min(width, len(w)) for b in blocks for _, w in b), default=1)
    made = []
    for b in blocks:
        word = (np.searchsorted(vocabulary, np.concatenate([w for _, w in b])) + 1).astype(np.int32)
        made.append(Windows(width, word, np.concatenate(([0], np.cumsum([len(w) for _, w in b]))), np.array([i for i, _ in b], np.int64)))
    return Benchmark(vocabulary, shortest, made)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are separators, each unlike any other: they come first, by place."""
    n = len(text)
    gap = text == 0
    key = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()))
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], np.diff(key[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at, step = np.flatnonzero(~(first & np.concatenate((first[1:], [True])))), 1
    while len(at):  # the places in the order of suffixes that share their first ``step`` words with others
        suffix = order[at]
        follow = np.minimum(suffix + step, n - 1)
        key = rank[suffix] * (n + 1) + np.where(suffix + step < n, rank[follow] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[at] = suffix  # groups keep their places, so sorted keys refill them in order
        new = np.concatenate(([True], np.diff(key) != 0))
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at, step = at[~(new & np.concatenate((new[1:], [True])))], 2 * step
    return order


class FMIndex:
    """Counts and places of word sequences in one shard's text of word ids with separators (0)."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(text)
        self.n, self.levels = n, max(1, int(top).bit_length())
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.ones, self.zeros, level = [], [], before
        for bit in range(self.levels - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(b))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate((level[b == 0], level[b == 1]))
        self.level_begin = np.concatenate(([0], np.cumsum(np.bincount(self._reversed(np.arange(1 << self.levels))[before], minlength=1 << self.levels))))
        kept = (order % sample == 0) | (before == 0)  # the walk never has to cross a separator
        self.kept_rank = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.kept, self.place = kept, order[kept]

    def _reversed(self, x: np.ndarray) -> np.ndarray:
        """Bits in reverse: the order in which the last level of the matrix groups the symbols."""
        out = np.zeros_like(x)
        for k in range(self.levels):
            out |= ((x >> k) & 1) << (self.levels - 1 - k)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][at]
            at = np.where((symbol >> bit) & 1, self.zeros[k] + one, at - one)
        return at - self.level_begin[self._reversed(symbol)]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, low, high) of the windows that occur: suffixes low..high-1 begin with them."""
        rows = np.arange(len(windows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[rows, k]
            low, high = self.begin[symbol] + self.rank(symbol, low), self.begin[symbol] + self.rank(symbol, high)
            live = high > low
            rows, low, high = rows[live], low[live], high[live]
        return rows, low, high

    def step(self, at: np.ndarray) -> np.ndarray:
        """The suffix one word longer to the left of each."""
        symbol = np.zeros(len(at), np.int64)
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][at]
            b = self.ones[k][at + 1] - one
            symbol |= b.astype(np.int64) << bit
            at = np.where(b, self.zeros[k] + one, at - one)
        return self.begin[symbol] + at - self.level_begin[self._reversed(symbol)]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by their order."""
        out, todo, steps, now = np.empty(len(at), np.int64), np.arange(len(at)), 0, at
        while len(todo):
            done = self.kept[now]
            out[todo[done]] = self.place[self.kept_rank[now[done]]] + steps
            todo, now = todo[~done], now[~done]
            now, steps = self.step(now), steps + 1
        return out


def _runs(word: np.ndarray, at: np.ndarray, windows: Benchmark, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word id, text, place in the text) of the runs kept, each run with a separator behind it."""
    maybe = np.flatnonzero(coarse[(word >> U64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(windows.vocabulary, word[maybe]), len(windows.vocabulary) - 1)
    ids = np.zeros(len(word) + 1, np.int64)
    ids[maybe] = np.where(windows.vocabulary[k] == word[maybe], k + 1, 0)
    inside = ids > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[at] = inside[at]  # a text's bounds end a run
    bound = at[at > 0] - 1
    last[bound] = inside[bound]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = stop - start >= windows.shortest
    start, size = start[long], (stop - start)[long] + 1
    total = np.cumsum(size)
    place = np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)
    symbol = ids[place]
    symbol[total - 1] = 0
    text = np.repeat(np.searchsorted(at, start, side="right") - 1, size)
    return symbol, text, place - at[text]


def _search(symbol: np.ndarray, text: np.ndarray, place: np.ndarray, benchmark: Benchmark) -> tuple[dict, dict]:
    """Of each text with occurrences: its hit word ranges, and its items."""
    index = FMIndex(symbol, len(benchmark.vocabulary))
    edge, items = np.zeros(len(symbol) + 1, np.int64), {}
    for windows in benchmark.each():
        for table, number in windows.by_length():
            row, low, high = index.search(table)
            if not len(row):
                continue
            count = high - low
            found = index.locate(np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count))
            np.add.at(edge, found, 1)
            np.add.at(edge, found + table.shape[1], -1)
            for p in np.unique(text[found] * len(windows.items) + np.repeat(number[row], count)).tolist():
                items.setdefault(p // len(windows.items), set()).add(int(windows.items[p % len(windows.items)]))
    hit = np.cumsum(edge)[:-1] > 0
    start = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    stop = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
    ranges: dict[int, list] = {}
    for t, a, b in zip(text[start].tolist(), place[start].tolist(), place[stop].tolist(), strict=True):
        ranges.setdefault(t, []).append((a, b + 1))
    return ranges, items


def _shards(batches: Iterator[pa.RecordBatch], benchmark: Benchmark, held: int) -> Iterator[tuple[pa.Table, np.ndarray, dict, dict]]:
    """(rows, words of each text, hit ranges, items) of one shard after another; the rows hold at most about ``held`` bytes of text."""
    coarse = np.zeros(1 << 20, bool)
    coarse[(benchmark.vocabulary >> U64(44)).astype(np.int64)] = True
    own, counts, parts, rows, size, chars = [], [], [], 0, 0, 0
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            word, at = words(buf, offsets, ALNUM)
            own.append(batch.slice(i, j - i) if held else batch.slice(i, j - i).drop_columns(["text"]))
            counts.append(np.diff(at))
            if len(benchmark.vocabulary):
                symbol, text, place = _runs(word, at, benchmark, coarse)
                parts.append((symbol, text + rows, place))
                size += len(symbol)
            rows, chars = rows + j - i, chars + len(buf)
            if size >= SHARD or rows >= 20_000 or 0 < held <= chars:
                yield pa.Table.from_batches(own), np.concatenate(counts), *(_search(*(np.concatenate(x) for x in zip(*parts, strict=True)), benchmark) if size else ({}, {}))
                own, counts, parts, rows, size, chars = [], [], [], 0, 0, 0
    if rows:
        yield pa.Table.from_batches(own), np.concatenate(counts), *(_search(*(np.concatenate(x) for x in zip(*parts, strict=True)), benchmark) if size else ({}, {}))


def _hits(batches: Iterator[pa.RecordBatch], benchmark: Benchmark) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to HITS."""
    for own, counts, ranges, items in _shards(batches, benchmark, 0):
        found = pa.array([[{"start": a, "stop": b} for a, b in ranges.get(k, ())] for k in range(len(own))], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        ids = pa.array([sorted(items.get(k, ())) for k in range(len(own))], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([own["doc_id"].combine_chunks(), pa.array(counts), found, ids], names=["doc_id", "n_words", "spans", "items"])


def _benchmark(docs: DataFrame, benchmark: DataFrame, width: int, block_chars: int) -> Benchmark:
    """The benchmark with its blocks as broadcasts. The driver reads one item after another and holds their word numbers."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    made = benchmark_of(((r[0], r[1]) for r in rows), width, block_chars)
    return Benchmark(made.vocabulary, made.shortest, [docs.sparkSession.sparkContext.broadcast(b) for b in made.blocks])


def find(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_chars: int = 4_000_000) -> DataFrame:
    """Hits of each document: doc_id, n_words, spans (word ranges hit, merged), items (ids of items found).

    A row for each row of ``docs``; rows with the same or a null doc_id stay apart. Null texts have no
    words. An empty benchmark hits nothing. Items without id or text are left out; rows of one
    item_id are one item. Words are as in the module of texts: ASCII is lower-cased, ``ALNUM``.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(Task(_hits, benchmark=_benchmark(docs, benchmark, width, block_chars)), HITS)


def digest(hits: DataFrame) -> DataFrame:
    """Counts of find()'s rows: n_hit words, n_items, the hash of the item ids, and contaminated at two items or more."""
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)")
    n_items = F.size("items").cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the word ranges; a line break stands for each."""
    data = text.encode()
    buf = np.frombuffer(data, np.uint8)
    start, stop, _ = spans(LOWER[buf], np.array([0, len(buf)]), ALNUM)
    kept, last = [], 0
    for a, b in ranges:
        kept.append(data[last : start[a]].rstrip(b" "))
        last = stop[b - 1]
    return b"\n".join([*kept, data[last:]]).decode()


def _cut(batches: Iterator[pa.RecordBatch], benchmark: Benchmark) -> Iterator[pa.RecordBatch]:
    """(text, more) to (text without the spans, more)."""
    for own, _, ranges, _ in _shards(batches, benchmark, HELD):
        if ranges:
            texts = own["text"].to_pylist()
            for k, found in ranges.items():
                texts[k] = without(texts[k], found)
            own = own.set_column(0, "text", pa.array(texts, own.schema.field("text").type))
        yield from own.to_batches()


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_chars: int = 4_000_000) -> DataFrame:
    """The documents without the spans that benchmark windows cover; a line break stands for each. n_chars, if there, follows.

    Texts without hits stay as they are, null ones too. All rows and columns stay, whatever their names; no row moves.
    """
    small_batches(docs.sparkSession)
    more = [f for f in docs.schema.fields if f.name != "text"]
    kinds = "".join(f", _{k} {f.dataType.simpleString()}" for k, f in enumerate(more))
    own = docs.select("text", *(F.col(f"`{f.name}`").alias(f"_{k}") for k, f in enumerate(more)))
    cut = own.mapInArrow(Task(_cut, benchmark=_benchmark(docs, benchmark, width, block_chars)), f"text string{kinds}")
    places = {f.name: k for k, f in enumerate(more)}
    out = cut.select(*(F.col("text") if n == "text" else F.col(f"_{places[n]}").alias(n) for n in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def oracle_sql(width: int = 8) -> str:
    """digest() of find() in DuckDB: windows of items joined with those of documents; for tables whose doc_id is a key."""
    words_ = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, {words_} AS w FROM documents),
        items AS (SELECT item_id, {words_} AS w FROM benchmark WHERE item_id IS NOT NULL),
        wanted AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {width}) AS n, array_to_string(w[k : k + least(len(w), {width}) - 1], ' ') AS run
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS k FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM wanted),
        runs AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)),
        found AS MATERIALIZED (SELECT r.doc_id, r.k, r.n, x.item_id FROM runs r JOIN wanted x ON x.n = r.n AND x.run = r.run),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY 1),
        of AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY 1)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, sha256(coalesce(o.names, '')) AS items_sha256, coalesce(o.n_items, 0) >= 2 AS contaminated
        FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN of o ON o.doc_id = d.doc_id"""
