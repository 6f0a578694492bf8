"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: rare ones first, by a fixed-size sketch of
corpus counts, then by hash. The order's first stretch of each set (its prefix)
finds the sets that can be similar. The order is cut into fragments at pivots of
equal weight; partial overlaps are counted in each fragment and summed
per pair, which is exact.

Groups of near copies aren't expanded into pairs. In each round every set names the one
nearest to it, by a parity bitmap, of those in other components that share an n-gram of the
round's stretch; the named pairs are counted and their components join. Once few named
pairs still link, all pairs that are left across components, share any prefix n-gram
and pass the bitmap's bound are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.kernels import Prefix, U, Words, mix, slices
from tickforge.llm.repeats import buckets_for, dealt, packed, unpacked
from tickforge.llm.scratch import Scratch, components, small

#: The sketch: so many counters, in blocks of so many, each up to 255 per task.
CELLS, BLOCK = 1 << 22, 1 << 16
#: Fragments that the global order is cut into.
FRAGMENTS = 4
#: 64-bit words of a set's parity bitmap, which bounds how much two sets differ from below.
PARITY = 8
BITS = [f"p{k}" for k in range(PARITY)]
#: Members of an n-gram that are compared in one piece; larger groups are cut.
PIECE = 4096
#: Members of an n-gram up to which those that can't link with any other are left out at once.
FEW = 64
_POSTING = np.dtype([("s", "<u8"), ("node", "<i8"), ("size", "<i4"), ("place", "<i4")])


class Order:
    """The global order of n-grams, and the ranks that cut it into fragments of about equal weight."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        weight = np.bincount(levels, minlength=64) * 2.0 ** np.arange(64)
        ends = np.cumsum(weight) / weight.sum()
        cuts = np.arange(1, FRAGMENTS) / FRAGMENTS
        level = np.searchsorted(ends, cuts)
        inside = (cuts - (ends[level] - weight[level] / weight.sum())) / (weight[level] / weight.sum())
        self.pivots = np.array([(int(a) << 58) + int(b * (1 << 58)) for a, b in zip(level, np.clip(inside, 0, 1), strict=True)], U)

    def rank(self, h: np.ndarray) -> np.ndarray:
        return (self.levels[(h >> U(42)).astype(np.int64)].astype(U) << U(58)) | (h >> U(6))


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the n-grams of a slice; a text of fewer words has its whole sequence as one."""
    w = Words(buf, offsets, lower=True)
    _, doc, h = w.runs(n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, Prefix(w.hashes).hash(w.first[:-1][short], w.first[1:][short])])
    return doc, h


class Sets:
    """The sets of a slice's texts in global order: text and hash of each element, sizes, first elements, digests."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, n: int, order: Order | None):
        doc, h = shingles(buf, offsets, n)
        rank = order.rank(h) if order else h
        by = np.lexsort((h, rank, doc))
        doc, h, rank = doc[by], h[by], rank[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.h, self.rank = doc[new], h[new], rank[new]
        self.size = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def digest(self, seed: int = 0) -> np.ndarray:
        """64 bits of each set, whatever the order of its elements."""
        s = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.h ^ U(seed)))])
        return mix(s[self.at[1:]] - s[self.at[:-1]] + self.size.astype(U)).view(np.int64)


SECOND = 0x5851F42D4C957F2D


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """log2 of the count in each cell, over the n-grams of all documents; CELLS bytes whatever the input's size."""

    def count(batches):
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0)):
                total += np.bincount((shingles(buf, offsets, n)[1] >> U(42)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        cells = np.minimum(total, 255).astype(np.uint8).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], names=["block", "cells"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(cells.as_buffer(), np.uint8)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        levels = [np.log2(np.maximum(v, 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "cells"])

    blocks = docs.select("text").mapInArrow(count, "block int, cells binary")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for r in blocks.repartition(CELLS // BLOCK, "block").mapInArrow(add, "block int, cells binary").collect():
        out[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(-1)


def digested(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, tag, size, a, b, p0..) of each row: a hash of the text, the set's size, 128-bit digest and parity bitmap; a names the set."""

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in slices(batch.column(1)):
                s = Sets(buf, offsets, n, None)
                width = 64 * PARITY
                odd = (np.bincount(s.doc * width + (mix(s.h) >> U(9)).astype(np.int64) % width, minlength=(hi - lo) * width) & 1).astype(np.uint8)
                parity = np.packbits(odd.reshape(-1, width), axis=1).view("<i8")
                bits = [pa.array(np.ascontiguousarray(parity[:, k])) for k in range(PARITY)]
                row = [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(s.size, pa.int64()), pa.array(s.digest()), pa.array(s.digest(SECOND)), *bits]
                yield pa.RecordBatch.from_arrays(row, names=["doc_id", "tag", "size", "a", "b", *BITS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(sign, f"doc_id {kind}, tag long, size long, a long, b long, {', '.join(c + ' long' for c in BITS)}")


def can_link(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with a common element at places p and q leave room for enough overlap."""
    n, m, p, q = (v.astype(np.int64) for v in (n, m, p, q))
    room = np.minimum(n - p, m - q) + np.minimum(p, q)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * room >= percent * (n + m))


def shared_postings(docs: DataFrame, order, n: int, percent: int, buckets: int) -> DataFrame:
    """(gram, node, size, place) for the prefix n-grams that several distinct sets have; node is a set's digest.

    Copies in a batch send once. A batch that has several sets for an n-gram knows that it is
    shared and tells the others with one entry, so a frequent n-gram sends one entry a batch.
    Where all sets of an n-gram meet, those that can link with none of them are left out.
    """

    def grouped(e: np.ndarray, many: np.ndarray):
        """Entries without copies, where each n-gram begins, its number of entries, whether any is known as shared."""
        by = np.lexsort((e["node"], e["s"]))
        e, many = e[by], many[by]
        new = np.ones(len(e), bool)
        new[1:] = (e["s"][1:] != e["s"][:-1]) | (e["node"][1:] != e["node"][:-1])
        lead = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1]]))
        known = np.logical_or.reduceat(many, lead)
        e = e[new]
        lead = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1]]))
        return e, lead, np.diff(np.append(lead, len(e))), known

    def send(batches):
        for batch in batches:
            parts = []
            for _, hi, buf, offsets in slices(batch.column(0)):
                s = Sets(buf, offsets, n, order.value)
                keep = np.where(s.size > 0, s.size - (percent * s.size + 99) // 100 + 1, 0)
                place = np.arange(int(keep.sum())) - np.repeat(np.cumsum(keep) - keep, keep)
                at = place + np.repeat(s.at[:-1], keep)
                e = np.zeros(len(at), _POSTING)
                e["s"], e["node"], e["size"], e["place"] = s.h[at], s.digest()[s.doc[at]], s.size[s.doc[at]], place
                parts.append(e)
            e = np.concatenate(parts) if parts else np.zeros(0, _POSTING)
            if not len(e):
                continue
            e, lead, count, _ = grouped(e, np.zeros(len(e), bool))
            alone = count == 1
            out = [(*r, 0) for r in dealt(e[lead[alone]], buckets)] + [(*r, 1) for r in dealt(e[lead[~alone]], buckets)]
            rest = np.repeat(~alone, count)
            rest[lead] = False
            if rest.any():
                out.append((int(e["node"][rest][0]) % buckets, packed(e[rest]), 2))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int32()))], names=["bucket", "data", "kind"])

    def rows(e: np.ndarray) -> pa.RecordBatch:
        cols = [e["s"].view(np.int64), e["node"], e["size"], e["place"]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["gram", "node", "size", "place"])

    def receive(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, data, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                e = unpacked(data, _POSTING)
                if kind == 2:
                    yield rows(e)
                else:
                    held.setdefault(bucket, []).append((e, np.full(len(e), kind == 1)))
        for parts in held.values():
            e, lead, count, known = grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            keep = np.repeat(known | (count > FEW), count)
            end = np.repeat(lead + count, count)
            live = np.flatnonzero(~keep)
            for step in range(1, FEW):
                live = live[live + step < end[live]]
                ok = live[can_link(e["size"][live], e["size"][live + step], e["place"][live], e["place"][live + step], percent)]
                keep[ok] = keep[ok + step] = True
            yield rows(e[keep])

    sent = docs.select("text").mapInArrow(send, "bucket long, data binary, kind int").repartition(buckets, "bucket")
    return sent.mapInArrow(receive, "gram long, node long, size int, place int")


def fragments(docs: DataFrame, order, n: int) -> DataFrame:
    """(node, fragment, grams): each set cut at the order's pivots; docs: (text)."""

    def cut(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(0)):
                s = Sets(buf, offsets, n, order.value)
                key = s.doc * FRAGMENTS + np.searchsorted(order.value.pivots, s.rank, "right")
                edges = pa.array(np.searchsorted(key, np.arange((hi - lo) * FRAGMENTS + 1)), pa.int32())
                grams = pa.ListArray.from_arrays(edges, pa.array(s.h.view(np.int64)))
                names = pa.array(np.repeat(s.digest(), FRAGMENTS))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(FRAGMENTS), hi - lo), pa.int32()), grams], names=["node", "fragment", "grams"])

    return docs.select("text").mapInArrow(cut, "node long, fragment int, grams array<long>")


def wide_parity(docs: DataFrame, n: int) -> DataFrame:
    """(node, size, bits): parity bitmaps as wide as half of the set at least, in 64-bit words; docs: (text)."""

    def sign(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(0)):
                s = Sets(buf, offsets, n, None)
                words = np.maximum(PARITY, 1 << np.ceil(np.log2(np.maximum(s.size, 1) / 128)).clip(0).astype(np.int64))
                at = np.concatenate([[0], np.cumsum(words)])
                cell = (mix(s.h) >> U(9)).astype(np.int64) & (64 * words[s.doc] - 1)
                odd = (np.bincount(64 * at[s.doc] + cell, minlength=64 * int(at[-1])) & 1).astype(np.uint8)
                bits = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.packbits(odd).view("<i8")))
                yield pa.RecordBatch.from_arrays([pa.array(s.digest()), pa.array(s.size, pa.int64()), bits], names=["node", "size", "bits"])

    return docs.select("text").mapInArrow(sign, "node long, size long, bits array<long>")


def apart(left: Column, right: Column) -> Column:
    """Bits in which two bitmaps differ; the wider one is folded to the other's width, which keeps it a bitmap of the same set."""

    def folded(wide: Column, narrow: Column) -> Column:
        times = F.size(wide) / F.size(narrow)
        step = lambda i: F.slice(wide, (i * F.size(narrow) + 1).cast("int"), F.size(narrow))
        return F.aggregate(F.sequence(F.lit(1), (times - 1).cast("int")), step(F.lit(0)), lambda acc, i: F.zip_with(acc, step(i), lambda x, y: x.bitwiseXOR(y)))

    one = F.when(F.size(left) > F.size(right), folded(left, right)).otherwise(left)
    two = F.when(F.size(right) > F.size(left), folded(right, left)).otherwise(right)
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def plausible(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that wide bitmaps don't rule out; the narrow ones say nothing of sets with thousands of elements."""
    bits, sides = of_pairs(docs, sets, pairs, lambda texts: wide_parity(texts, n))
    side = lambda c, v: F.first(F.when(F.col("node") == F.col(c), F.col(v)), True)
    both = bits.join(small(sides), "node").groupBy("a", "b").agg(side("a", "bits").alias("left"), side("b", "bits").alias("right"), side("a", "size").alias("n"), side("b", "size").alias("m"))
    return both.where((100 + percent) * apart(F.col("left"), F.col("right")) <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b")


def of_pairs(docs: DataFrame, sets: DataFrame, pairs: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """(make() of a text of each set that is in a pair, (node, a, b) for both sides of each pair); sets: (node, doc_id, ...)."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b"), F.struct(F.col("b").alias("node"), "a", "b"))).alias("s")).select("s.*")
    ids = sets.select("node", "doc_id").join(small(sides.select("node").distinct()), "node", "left_semi").select("doc_id").distinct()
    return make(docs.join(small(ids), "doc_id", "left_semi")), sides


def compared(points: DataFrame, label: DataFrame | None, pieces: DataFrame | None, buckets: int, percent: int, salt: int, every: bool) -> DataFrame:
    """(a, b): pairs of sets in different components that share a prefix n-gram and may link by sizes, places and bitmaps.

    points: (gram, node, size, place, p0..); label: (node, component); pieces: (gram,
    pieces) of the n-grams with large groups. For each set only the nearest other one in a piece of
    its groups, or every pair.
    """
    df = points
    df = df.join(small(label), "node", "left").withColumn("part", F.coalesce("component", "node")) if label is not None else df.withColumn("part", F.col("node"))
    df = df.join(small(pieces), "gram", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))) if pieces is not None else df.withColumn("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("pieces")).cast("int")
    df = df.withColumn("own", own).withColumn("first", F.col("own")).withColumn("second", F.col("own"))
    if every and pieces is not None:
        # a large group's pieces meet two by two
        other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
        df = df.select("*", other).withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    df = df.select("gram", "first", "second", "own", "node", "part", "size", "place", *BITS)

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        gram, first, second, own, node, part, size, place = (t.column(k).to_numpy() for k in range(8))
        by = np.lexsort((part, node, second, first, gram))
        gram, first, second, own, node, part = (v[by] for v in (gram, first, second, own, node, part))
        size, place = size[by].astype(np.int64), place[by].astype(np.int64)
        bits = np.stack([t.column(8 + k).to_numpy()[by] for k in range(PARITY)], axis=1).view(U)
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        lead = np.flatnonzero(new)
        count = np.diff(np.append(lead, len(gram)))
        end = np.repeat(lead + count, count)
        closed = np.minimum.reduceat(part, lead) == np.maximum.reduceat(part, lead)
        live = np.flatnonzero(~np.repeat(closed, count))
        far = np.full(len(gram), 1 << 30)
        with_ = np.zeros(len(gram), np.int64)
        out_a, out_b, step = [], [], 1
        while len(live):
            live = live[live + step < end[live]]
            i, j = live, live + step
            ok = (part[i] != part[j]) & ((first[i] == second[i]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            ok = can_link(size[i], size[j], place[i], place[j], percent)
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64)
            ok = (100 + percent) * apart <= (100 - percent) * (size[i] + size[j])
            i, j, apart = i[ok], j[ok], apart[ok]
            if every:
                out_a.append(np.minimum(node[i], node[j]))
                out_b.append(np.maximum(node[i], node[j]))
            else:
                for x, y in ((i, j), (j, i)):
                    nearer = (apart < far[x]) | ((apart == far[x]) & (node[y] < with_[x]))
                    far[x[nearer]], with_[x[nearer]] = apart[nearer], node[y[nearer]]
            step += 1
        if every:
            a, b, d = np.concatenate([*out_a, node[:0]]), np.concatenate([*out_b, node[:0]]), None
            by = np.lexsort((b, a))
        else:
            some = np.flatnonzero(far < 1 << 30)
            a, b, d = node[some], with_[some], far[some]
            by = np.lexsort((b, d, a))
        a, b = a[by], b[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (every & (b[1:] != b[:-1]))
        d = d[by][new] if d is not None else np.zeros(int(new.sum()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], d)], names=["a", "b", "apart"])

    found = df.repartition(buckets, "gram", "first", "second").mapInArrow(run, "a long, b long, apart long")
    if not every:
        found = found.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("nearest")).select("a", F.col("nearest.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair of sets: partial overlaps are counted in each fragment, then summed.

    sets: (node, doc_id, ...) names a document of each set. Only these texts are read, and each set
    is sent, cut into its fragments, once for each of its pairs.
    """
    cut, sides = of_pairs(docs, sets, pairs, lambda texts: fragments(texts, order, n))
    sent = cut.join(small(sides), "node")
    side = lambda c: F.first(F.when(F.col("node") == F.col(c), F.col("grams")), True)
    both = sent.groupBy("a", "b", "fragment").agg(side("a").alias("left"), side("b").alias("right"))
    counted = both.select("a", "b", F.size(F.array_intersect("left", "right")).cast("long").alias("common"), (F.size("left") + F.size("right")).alias("both"))
    total = counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.sum("both").alias("both"))
    return total.select("a", "b", (100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).alias("linked"))


def connected(scratch: Scratch, docs: DataFrame, members: DataFrame, n: int, percent: int, piece: int = PIECE) -> DataFrame | None:
    """(node, component) of the sets that link with another one, by name; None if no n-gram is shared."""
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    order = spark.sparkContext.broadcast(Order(sketch(docs, n)))
    entries = scratch.save(shared_postings(docs, order, n, percent, buckets), "entries")
    scratch.drop()
    if entries.isEmpty():
        return None
    sets = members.groupBy(F.col("a").alias("node")).agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in BITS))
    sets = scratch.save(sets, "sets")
    points = scratch.save(entries.join(sets.drop("doc_id").hint("merge"), "node"), "points")
    large = entries.groupBy("gram").count().where(F.col("count") > piece)
    large = scratch.save(large.select("gram", F.ceil(F.col("count") / piece).cast("int").alias("pieces")), "large")
    pieces = None if large.isEmpty() else large
    scratch.drop("entries")
    label, tried = None, None
    k, last = 0, False
    while True:
        # a round sees one stretch of all n-grams, the last one all of them
        seen = points if last else points.where(F.shiftrightunsigned(F.xxhash64("gram"), 61) == k)
        pairs = compared(seen, label, pieces, buckets, percent, k, last)
        if last and tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"named{k}")
        pairs = scratch.save(plausible(docs, sets, pairs, n, percent), f"pairs{k}")
        checked = scratch.save(linked(docs, sets, pairs, order, n, percent), f"checked{k}")
        named, good = checked.agg(F.count("*"), F.sum(F.col("linked").cast("long"))).first()
        tried = checked if tried is None else tried.unionByName(checked)
        if good:
            label = components(scratch, tried.where("linked").select("a", "b"))
        if last:
            break
        k, last = k + 1, 2 * (good or 0) <= named or k == 7
    scratch.drop("points", "sets", "large")
    return label


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, piece: int = PIECE, tag: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; with xxhash64(text) as tag, if asked for.

    The set of a text is that of its distinct n-word shingles over lower-cased (A-Z)
    words; with fewer words, the whole sequence as one; null and blank texts have
    an empty set and link with nothing. Two sets link at a Jaccard similarity of
    percent/100 or more. component_id is the smallest doc_id reachable by links.
    Sets are named by their content, so rows that repeat a doc_id are judged each by its own
    text. A row with a null doc_id links with nothing and has a null component;
    other columns are ignored; an empty table gives no rows. doc_id may have any type that can be ordered.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    members = scratch.save(digested(docs, n), "members")
    real = members.where("size > 0 AND doc_id IS NOT NULL")
    label = connected(scratch, docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), real, n, percent, piece)
    members, real = members.drop(*BITS), real.drop(*BITS)
    # copies meet before components do, so a large group sends few rows
    classes = real.groupBy("a", "b", "size").agg(F.min("doc_id").alias("least"))
    if label is not None:
        classes = classes.join(label.select(F.col("node").alias("a"), "component").hint("merge"), "a", "left")
        classes = scratch.save(classes, "classes")
        joined = classes.where("component IS NOT NULL")
        least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        joined = joined.join(least.hint("merge"), "component").select("a", "b", "size", "component_id")
        classes = joined.unionByName(classes.where("component IS NULL").select("a", "b", "size", F.col("least").alias("component_id")))
    else:
        classes = classes.select("a", "b", "size", F.col("least").alias("component_id"))
    names = ["doc_id", F.col("size").alias("n_shingles"), "component_id", *["tag"] * tag]
    grouped = real.join(classes.hint("merge"), ["a", "b", "size"]).select(*names)
    return grouped.unionByName(members.where("size = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id")).select(*names))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents: 4-word shingles, 0.85."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
