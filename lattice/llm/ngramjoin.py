"""Exact self-join of documents by Jaccard similarity of their word shingles, and its linked classes.

Documents are compared in size-banded tiles by hashed bitmap signatures, then by exact intersection of sorted
arrays. A document is its set of 64-bit shingle hashes; equal sets are one node. Steps:

1. Sizes, set ids and hashed bitmap signatures of all documents. A signature's bit is the parity of the
   shingles that hash to it, so the bits in which two differ are at most the shingles they do not share:
   the count of differing bits bounds the overlap from above. Its width follows the set's size, and a
   wider signature folds to a narrower one's width.
2. Sizes fall into bands so that similar sets are of one band or of neighbours. All pairs of a band and its
   neighbour are too many, so a tile is what of a band files under one shingle: two sets that are similar
   enough share a shingle among the first ``n - ceil(t n) + 1`` of each in any common order. The order
   puts shingles that many sets hold last, so what many documents quote files few of them. Lists of one
   set go; a list under a frequent shingle is dealt into parts.
3. Each set is compared with the most central members of most of its lists, and the two of lists of two with
   each other; signatures first, then exactly. Copies and near copies, whose lists are long, come together
   here without all their pairs.
4. Of lists that still join different classes, each band with its upper neighbour is a tile, split where it
   is long; pairs in it are bounded by signatures, some of the lists first. Of each set and each class
   not smaller than its own that signatures do not keep apart, the likeliest pair is intersected.
5. What is still apart goes against the whole class, in tiles of its members: wide signatures, then exact
   intersections up to the first link.

Classes are found by distributed stars. Of every two sets that are similar enough, one is compared with
the other or with all of the other's class unless both are in one class already, so the classes are those
of all links; and no step returns more than a row for each set and class that it may join.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm.shared import LOWER_SQL, Task, components, components_sql, drop_table, small_batches, table
from lattice.llm.text import GRAPH, U64, blocks, mix, words

WIDTH = 5
PERCENT = 80
HOT_LOCAL, HOT_GLOBAL = 4, 64  # counts in a task, and over all tasks, from which a shingle's order counts as frequent
HOT_ROWS = 1 << 20  # frequent shingles that the order knows; more only makes lists longer
CHUNK = 1 << 21  # shingles that a task holds for counting
FIRST = 3  # members that a set is compared with before there are classes
EARLY = 8  # one of so many lists is compared before all are
MEMBERS = 1024  # members of a class in one tile against other sets
TILE = 2048  # members of a band of a list compared in one tile where it has more than two tiles' worth
PART = 256  # sets of a frequent shingle in a part of its list, about
BROADCAST_BYTES = 64 << 20  # of the hash table of a side that may be broadcast

GROUP = ("key", "tile", "p", "q")  # what names a tile

_STEP = U64(0xD6E8FEB86659FD93)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether so many rows of a few numbers each may be broadcast."""
    return rows * (60 + 8 * len(df.columns)) <= BROADCAST_BYTES


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows within: rows of a few numbers travel in larger ones than texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shingle_sets(word: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words than ``width``, the whole sequence; none without words."""
    n = max(0, len(word) - width + 1)
    h = np.full(n, U64(width))
    for k in range(width):
        h = mix(h * _STEP + word[k : k + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(h[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.full(1, U64(b - a))
            for k in range(a, b):
                x = mix(x * _STEP + word[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_id(s: np.ndarray, seed: int = 0) -> int:
    """64 bits of the whole set, as a signed integer; seeds give independent ones."""
    return int(mix(np.add.reduce(mix(s ^ (_STEP + U64(seed))), keepdims=True) + U64(len(s))).view(np.int64)[0])


def band(n: Column, percent: int) -> Column:
    """Bands of sizes: of two similar sets the larger is in the same band or the next."""
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9).cast("int")


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of a set; its width in bits is the power of two from its size up, 64 at least."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def similar(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


class Signatures:
    """Signatures of many sets by width, and upper bounds of the overlaps of pairs of them."""

    def __init__(self, column: pa.Array, n: np.ndarray):
        self.n = n
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
        self.size = np.diff(offsets)
        self.row = np.zeros(len(n), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == w)
            self.row[rows] = np.arange(len(rows))
            self.by[w] = data[offsets[rows][:, None] + np.arange(w)].view(U64)

    def most_shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of the pairs."""
        out = np.zeros(len(i), np.int64)
        wide = np.where(self.size[i] >= self.size[j], i, j)
        slim = np.where(self.size[i] >= self.size[j], j, i)
        for a, b in {(a, b) for a in self.by for b in self.by if a >= b}:
            at = np.flatnonzero((self.size[wide] == a) & (self.size[slim] == b))
            for k in range(0, len(at), 50_000):
                p = at[k : k + 50_000]
                x, y = self.by[a][self.row[wide[p]]], self.by[b][self.row[slim[p]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                out[p] = (self.n[wide[p]] + self.n[slim[p]] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
        return out


def _measure(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, n, set_id, check, bits) of each document; kind 1: (shingle, count) of those frequent in this task."""
    held, size, seen = [], 0, set()
    names = ["kind", "doc_id", "n", "set_id", "check", "bits"]

    def frequent() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        h, c = h[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(c), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary())], names=names)

    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            sets = shingle_sets(*words(buf, offsets, GRAPH), width)
            ids, check = ([set_id(s, seed + k) if len(s) else None for s in sets] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(check, pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=names)
            for s, x in zip(sets, ids, strict=True):
                if x is not None and x not in seen:
                    seen.add(x)
                    held.append(s)
                    size += len(s)
            if size >= CHUNK:
                yield frequent()
                held, size, seen = [], 0, set()
    if held:
        yield frequent()


def _file(batches: Iterator[pa.RecordBatch], width: int, percent: int, seed: int, frequent) -> Iterator[pa.RecordBatch]:
    """(key, part, parts, set_id, n, central): each set under the first shingles of it, once in a task. central is the share, in thousandths, of frequent shingles."""
    hot, level = frequent.value
    coarse = np.zeros(1 << 20, bool)
    coarse[(hot >> U64(44)).astype(np.int64)] = True
    seen: set[int] = set()
    for batch in batches:
        for _, _, buf, offsets in blocks(batch):
            keys, parts, ids, sizes, shares = [], [], [], [], []
            for s in shingle_sets(*words(buf, offsets, GRAPH), width):
                if not len(s) or (x := set_id(s, seed)) in seen:
                    continue
                seen.add(x)
                n = len(s)
                first = n + (-percent * n // 100) + 1  # n - ceil(t n) + 1
                maybe = np.flatnonzero(coarse[(s >> U64(44)).astype(np.int64)])
                rank = np.zeros(n, np.int64)
                if len(maybe):
                    k = np.minimum(np.searchsorted(hot, s[maybe]), len(hot) - 1)
                    rank[maybe] = np.where(hot[k] == s[maybe], level[k], 0)
                    order = np.lexsort((s, rank))
                    s, rank = s[order], rank[order]
                keys.append(s[:first])
                parts.append(rank[:first] // PART + 1)
                ids.append(x)
                sizes.append(n)
                shares.append(1000 * int((rank > 0).sum()) // n)
            count = [len(k) for k in keys]
            if keys:
                each = np.repeat(np.array(ids), count)
                of = np.concatenate(parts)
                part = (mix(each.view(U64)) % of.astype(U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(part), pa.array(of.astype(np.int32)), pa.array(each), pa.array(np.repeat(np.array(sizes), count)), pa.array(np.repeat(np.array(shares, np.int32), count))], names=["key", "part", "parts", "set_id", "n", "central"])


def _bound(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, bits_a, bits_b) whose signatures leave them similar enough: (a, b)."""
    for batch in batches:
        if batch.num_rows:
            n = np.concatenate((batch.column(2).to_numpy(), batch.column(3).to_numpy()))
            found = Signatures(pa.concat_arrays([batch.column(4), batch.column(5)]), n)
            i = np.arange(batch.num_rows)
            bound = found.most_shared(i, i + batch.num_rows)
            yield batch.select([0, 1]).filter(pa.array(100 * bound >= percent * (n[: len(i)] + n[len(i) :] - bound)))


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, p, q, n, set_id, band, component, size, bits) sorted by the first five: for each set and class not smaller than its own that a tile may link, the likeliest partner (f, k, other, share).

    A tile has sets of the band it is named by, which come first, and of the next, which are not compared with each other.
    """
    tail: pa.Table | None = None

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        group = np.stack([t[c].to_numpy() for c in GROUP])
        end = np.append(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1, t.num_rows)
        stop = np.repeat(end, np.diff(np.concatenate(([0], end))))
        n, ids, comp, size = (t[c].to_numpy() for c in ("n", "set_id", "component", "size"))
        home = t["band"].to_numpy() == t["tile"].to_numpy()
        bits = t["bits"].chunk(0)
        found = Signatures(bits, n)
        count = np.where(home, stop - np.arange(t.num_rows) - 1, 0)
        i = 0
        total = np.cumsum(count)
        while i < t.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), side="right")))
            a = np.repeat(np.arange(i, j), count[i:j])
            b = np.arange(len(a)) + np.repeat(np.arange(i, j) + 1 - (np.cumsum(count[i:j]) - count[i:j]), count[i:j])
            live = (comp[a] != comp[b]) & (100 * n[a] >= percent * n[b])
            a, b = a[live], b[live]
            bound = found.most_shared(a, b)
            ok = 100 * bound >= percent * (n[a] + n[b] - bound)
            a, b, bound = a[ok], b[ok], bound[ok]
            smaller = (size[a] < size[b]) | ((size[a] == size[b]) & (comp[a] > comp[b]))
            one, other = np.where(smaller, a, b), np.where(smaller, b, a)
            share = bound / (n[a] + n[b] - bound)
            order = np.lexsort((ids[other], -share, comp[other], ids[one]))
            one, other, share = one[order], other[order], share[order]
            best = np.ones(len(one), bool)
            best[1:] = (ids[one][1:] != ids[one][:-1]) | (comp[other][1:] != comp[other][:-1])
            one, other, share = one[best], other[best], share[best]
            yield pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(comp[other]), pa.array(ids[other]), pa.array(share)], names=["f", "k", "other", "share"])
            i = j

    for batch in batches:
        t = pa.Table.from_batches([batch])
        tail = t if tail is None else pa.concat_tables([tail, t])
        if tail.num_rows >= 20_000:
            last = [tail[c][-1].as_py() for c in GROUP]
            same = np.logical_and.reduce([tail[c].to_numpy() == v for c, v in zip(GROUP, last, strict=True)])
            cut = int(np.argmax(same))
            if cut:
                yield from compare(tail.slice(0, cut))
                tail = tail.slice(cut)
    if tail is not None and tail.num_rows:
        yield from compare(tail)


def _named(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (set_id, text); texts without shingles are left out."""
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            sets = shingle_sets(*words(buf, offsets, GRAPH), width)
            kept = [(set_id(s, seed), k) for k, s in enumerate(sets, i) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), batch.column(1).take(pa.array([k for _, k in kept], pa.int64()))], names=["set_id", "text"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, salt, role, set_id, text) sorted so that a pivot's own text comes first: links (a, b)."""
    pivot, own = None, None
    for batch in batches:
        pivots, salts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        a, b = [], []
        for i, j, buf, offsets in blocks(batch):
            for k, s in enumerate(shingle_sets(*words(buf, offsets, GRAPH), width), i):
                if set_id(s, seed) != ids[k]:
                    continue  # another text under the same doc_id
                if ids[k] == pivots[k]:
                    pivot, own = (pivots[k], salts[k]), s
                elif pivot == (pivots[k], salts[k]):
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    if similar(int((own[at] == s).sum()), len(s), len(own), percent):
                        a.append(ids[k])
                        b.append(pivots[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Members:
    """Sets of a tile of one class, with signatures wide enough that few bounds are far from the overlap."""

    def __init__(self, percent: int):
        self.percent, self.sets, self.ids, self.bits = percent, [], [], None

    def add(self, s: np.ndarray, x: int) -> None:
        self.sets.append(s)
        self.ids.append(x)

    def _parity(self, s: np.ndarray) -> np.ndarray:
        bits = np.bincount((s & U64(self.width - 1)).astype(np.int64), minlength=self.width) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(U64)

    def linked(self, s: np.ndarray) -> int | None:
        """Some member that s links with."""
        if self.bits is None:
            self.n = np.array([len(x) for x in self.sets])
            self.width = min(1 << 17, max(64, 1 << (16 * int(self.n.max()) - 1).bit_length()))
            self.bits = np.stack([self._parity(x) for x in self.sets])
        both = self.n + len(s)
        fits = np.flatnonzero(100 * np.minimum(self.n, len(s)) >= self.percent * np.maximum(self.n, len(s)))
        own = self._parity(s)
        bound = np.zeros(len(self.n), np.int64)
        for k in range(0, len(fits), 64):
            p = fits[k : k + 64]
            bound[p] = (both[p] - np.bitwise_count(self.bits[p] ^ own).sum(1, dtype=np.int64)) // 2
        likely = fits[100 * bound[fits] >= self.percent * (both[fits] - bound[fits])]
        for m in likely[np.argsort(-bound[likely] / both[likely], kind="stable")].tolist():
            t = self.sets[m]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            if similar(int((t[at] == s).sum()), len(s), len(t), self.percent):
                return self.ids[m]
        return None


def _against(batches: Iterator[pa.RecordBatch], width: int, percent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, tile, role, set_id, text) sorted so that a tile's members (role 0) come before the sets to compare: links (a, b)."""
    now, members = None, Members(percent)
    for batch in batches:
        names, tiles, roles, ids = (batch.column(k).to_pylist() for k in range(4))
        a, b = [], []
        for i, j, buf, offsets in blocks(batch):
            for k, s in enumerate(shingle_sets(*words(buf, offsets, GRAPH), width), i):
                if set_id(s, seed) != ids[k]:
                    continue  # another text under the same doc_id
                if now != (names[k], tiles[k]):
                    now, members = (names[k], tiles[k]), Members(percent)
                if roles[k] == 0:
                    members.add(s, ids[k])
                elif members.sets and (m := members.linked(s)) is not None:
                    a.append(ids[k])
                    b.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Join:
    """One run over ``docs`` (doc_id, text); ``nodes`` are distinct sets with a document of each."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.width, self.percent, self.seed = docs.sparkSession, width, percent, 0
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        small_batches(self.spark)
        while True:  # again under other seeds if two sets have one id, which a second id of each tells
            measured = table(self.docs.mapInArrow(Task(_measure, width=width, seed=self.seed), "kind int, doc_id long, n long, set_id long, check long, bits binary"), "sets")
            self.rows = measured.where("kind = 0").select("doc_id", "n", "set_id", "bits")
            found = measured.where("kind = 0 and set_id is not null").groupBy("set_id")
            self.nodes = table(found.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") != F.max("check")).alias("mixed")), "nodes")
            if self.nodes.where("mixed").isEmpty():
                break
            self.seed += 2
        frequent = measured.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("c")).where(F.col("c") >= HOT_GLOBAL)
        self.frequent = frequent.orderBy(F.desc("c"), "doc_id").limit(HOT_ROWS)
        self.made = [measured, self.nodes]

    def lists(self) -> DataFrame:
        """(key, part, parts, set_id, n, band, pivot, members): parts of lists, of two sets or more or of a list with other parts.

        Of a part and band the pivot is the set with the largest share of frequent shingles: among near copies
        the one with the least of its own, which most of the others are likeliest to link with. The number
        of parts follows the shingle's count, so none is long.
        """
        hot = self.frequent.toPandas()  # HOT_ROWS at most
        shingle = hot["doc_id"].to_numpy(np.int64).view(U64)
        order = np.argsort(shingle)
        shared = self.spark.sparkContext.broadcast((shingle[order], hot["c"].to_numpy(np.int64)[order]))
        posts = self.docs.mapInArrow(Task(_file, width=self.width, percent=self.percent, seed=self.seed, frequent=shared), "key long, part int, parts int, set_id long, n long, central int")
        by_part = Window.partitionBy("key", "part")
        posts = posts.repartition("key", "part").withColumn("band", band(F.col("n"), self.percent))
        first = F.min(F.struct((-F.col("central")).alias("c"), "n", "set_id")).over(Window.partitionBy("key", "part", "band"))
        found = posts.withColumn("pivot", first).withColumn("lo", F.min("set_id").over(by_part)).withColumn("hi", F.max("set_id").over(by_part)).where("lo <> hi or parts > 1")
        found = found.withColumn("members", F.count("*").over(by_part))
        return table(found.select("key", "part", "parts", "set_id", "n", "band", F.col("pivot.set_id").alias("pivot"), "members"), "lists")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are similar enough: signatures first, then whole sets from the texts."""
        node = self.nodes
        left = node.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        right = node.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        with batch_rows(self.spark, 10_000):
            bound = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
            kept = table(bound.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(Task(_bound, percent=self.percent), "a long, b long"), "bound")
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(64)))
        counts = kept.groupBy("b").agg(F.ceil(F.count("*") / 512).alias("salts"))
        salted = salted.join(counts, "b").withColumn("salt", F.pmod("salt", "salts"))
        members = salted.select(F.col("b").alias("pivot"), "salt", F.lit(1).alias("role"), F.col("a").alias("set_id"))
        members = members.unionAll(salted.select(F.col("b").alias("pivot"), "salt", F.lit(0).alias("role"), F.col("b").alias("set_id")).distinct())
        members = table(members.join(node.select("set_id", "rep"), "set_id").select("pivot", "salt", "role", "set_id", "rep"), "members")
        dealt = self.with_texts(members).select("pivot", "salt", "role", "set_id", "text").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "set_id")
        out = table(dealt.mapInArrow(Task(_verify, width=self.width, percent=self.percent, seed=self.seed), "a long, b long"), "links")
        drop_table(kept)
        drop_table(members)
        return out

    def with_texts(self, members: DataFrame) -> DataFrame:
        """Rows of a table with the texts of their documents (rep), or, for sets of rows without doc_id only, with that of one of those rows."""
        few = fits(members, members.count())
        found = self.docs.join(F.broadcast(members) if few else members, F.col("doc_id") == F.col("rep")).select(*members.columns, "text")
        lost = members.where("rep is null")
        if lost.isEmpty():
            return found
        texts = self.docs.where("doc_id is null").mapInArrow(Task(_named, width=self.width, seed=self.seed), "set_id long, text string").dropDuplicates(["set_id"])
        return found.unionAll(lost.join(texts, "set_id").select(*members.columns, "text"))

    def tiled(self, lists: DataFrame, classes: DataFrame) -> DataFrame:
        """(f, k, other, size): of each set f and each other class k of ``size`` members that share a list and that signatures do not keep apart, the likeliest partner."""
        sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
        named = classes.join(sizes, "component").select("set_id", "component", "size")
        named = F.broadcast(named) if fits(named, classes.count()) else named
        own = lists.where("members > 2 or parts > 1").join(named, "set_id", "left").select("key", "set_id", "n", "band", F.coalesce("component", "set_id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
        own = own.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("tile"), "set_id", "n", "band", "component", "size")
        open_ = own.groupBy("key", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.min("band").alias("least"))
        own = own.join(open_.where("lo <> hi and least = tile").select("key", "tile", "members"), ["key", "tile"])
        tiles = F.ceil(F.col("members") / TILE).cast("int")
        mine = F.pmod(F.xxhash64("set_id"), tiles).cast("int")
        spread = own.select("key", "tile", "set_id", "n", "band", "component", "size", mine.alias("mine"), F.explode(F.when(F.col("members") > 2 * TILE, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(-1)))).alias("other"))
        keyed = spread.select("key", "tile", F.when(F.col("other") < 0, 0).otherwise(F.least("mine", "other")).alias("p"), F.when(F.col("other") < 0, 0).otherwise(F.greatest("mine", "other")).alias("q"), "n", "set_id", "band", "component", "size")
        with_bits = keyed.join(self.nodes.select("set_id", "bits"), "set_id").select("key", "tile", "p", "q", "n", "set_id", "band", "component", "size", "bits")
        dealt = with_bits.repartition(*GROUP).sortWithinPartitions(*GROUP, "n", "set_id")
        with batch_rows(self.spark, 10_000):
            found = dealt.mapInArrow(Task(_tiles, percent=self.percent), "f long, k long, other long, share double")
            best = found.groupBy("f", "k").agg(F.max(F.struct("share", F.col("other").alias("o"))).alias("b"))
            return table(best.select("f", "k", F.col("b.o").alias("other")).join(sizes.select(F.col("component").alias("k"), "size"), "k", "left").select("f", "k", "other", F.coalesce("size", F.lit(1)).alias("size")), "likely")

    def against(self, open_: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (a, b) of the sets f with the whole of class k, of the rows (f, k, size) of ``open_``."""
        tiles = F.ceil(F.col("size") / MEMBERS).cast("int")
        hubs = open_.select("k", "size").distinct()
        members = classes.join(hubs, classes.component == hubs.k).select("k", F.pmod(F.xxhash64("set_id"), tiles).cast("int").alias("tile"), F.lit(0).alias("role"), "set_id")
        others = open_.select("k", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.lit(1).alias("role"), F.col("f").alias("set_id"))
        both = members.unionAll(others).join(self.nodes.select("set_id", "rep"), "set_id")
        both = table(both.select("k", "tile", "role", "set_id", "rep"), "members")
        dealt = self.with_texts(both).select("k", "tile", "role", "set_id", "text").repartition("k", "tile").sortWithinPartitions("k", "tile", "role", "set_id")
        out = table(dealt.mapInArrow(Task(_against, width=self.width, percent=self.percent, seed=self.seed), "a long, b long"), "links")
        drop_table(both)
        return out


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (set_id, component) after more links."""
    if links.isEmpty():
        return found
    known = found.where("set_id <> component").select(F.col("set_id").alias("a"), F.col("component").alias("b"))
    return table(components(known.unionAll(links)).select(F.col("node").alias("set_id"), "component"), "classes")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id that links reach.

    Two rows link when they share ``percent`` of the shingles that either has. Equal sets link. Null
    and empty texts have no shingles and link with nothing: their component is their own doc_id. A null
    doc_id counts as larger than any other and keeps a class only if none has one. Rows of one doc_id are
    rows of their own; a class they are in is the same only if their texts link.
    """
    run = Join(docs, width, percent)
    lists = run.lists()
    shared = lists.where("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count("*").alias("c"))
    order = Window.partitionBy("set_id").orderBy(F.desc("c"), "pivot")
    star = shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    two = lists.where("members = 2").groupBy("key", "part").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).select("a", "b").distinct()
    star = table(star.unionAll(two).distinct(), "star")
    links = run.links(star)
    found = table(components(links).select(F.col("node").alias("set_id"), "component"), "classes")
    tried = star.unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = lists.where(F.pmod(F.xxhash64("key"), F.lit(EARLY)) == 0)
    for part in (some, lists):  # what some of the lists join need not be compared again in every other
        likely = run.tiled(part, found)
        pairs = table(likely.select(F.col("f").alias("a"), F.col("other").alias("b")).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionAll(pairs).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = run.links(pairs)
        before, found = found, merged(found, more)
    after, found = found, before
    left = likely.where("size > 1").join(after.select(F.col("set_id").alias("f"), F.col("component").alias("cf")), "f", "left").join(after.select(F.col("set_id").alias("k"), F.col("component").alias("ck")), "k", "left")
    left = table(left.where("coalesce(cf, f) <> coalesce(ck, k)").select("f", "k", "size"), "open")
    if not left.isEmpty():
        after = merged(after, run.against(left, found))
    found = after.select(F.col("set_id").alias("node"), "component")
    drop_table(lists)
    named = run.nodes.select("set_id", "rep").join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = named.join(least, "component").select(F.col("set_id").alias("s"), "component_id")
    out = run.rows.join(label, F.col("set_id") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each class; of rows that share it, one.

    Rows without doc_id stay: nothing tells which of them would go.
    """
    found = table(classes(docs, width, percent), "kept")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    counts = kept.agg(F.count("*").alias("n"), F.countDistinct("_kept").alias("d")).first()
    ids = kept.distinct()
    out = docs.join(F.broadcast(ids) if fits(ids, counts["d"]) else ids, docs["doc_id"].cast("long") == ids["_kept"], "left_semi")
    out = out if counts["n"] == counts["d"] else out.dropDuplicates(["doc_id"])
    return out.unionAll(docs.where(docs["doc_id"].isNull()))


def oracle_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """The same classes in DuckDB, by all pairs that share a shingle; for tables whose doc_id is a key."""
    return f"""WITH RECURSIVE cut AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda k: array_to_string(w[k : k + {width - 1}], ' '))) END AS s FROM cut),
        kinds AS MATERIALIZED (SELECT s, min(id) AS id, len(s) AS n FROM (SELECT id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
        posts AS MATERIALIZED (SELECT id, n, unnest(s) AS h FROM kinds),
        pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM posts a JOIN posts b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        same AS (SELECT k.id AS a, x.id AS b FROM (SELECT id, list_sort(s) AS s FROM sets) x JOIN kinds k ON k.s = x.s AND k.id <> x.id),
        links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT a, b FROM same),
        {components_sql("cut", "links")}
        SELECT x.id AS doc_id, len(x.s) AS n_shingles, t.component AS component_id FROM sets x JOIN top t ON t.node = x.id"""
