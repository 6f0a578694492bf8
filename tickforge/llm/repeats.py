"""Repeated windows of fixed length over a corpus, found without comparing all windows.

Each window has an anchor, the least hash among the grams at its start places, so
equal windows have equal anchors. Runs of windows with one anchor are asked about
together; what is repeated in part is left to the caller.

Asking: every batch settles what repeats inside it and sends one entry for each
key to the key's bucket, however often the key occurs; buckets grow in number with the
table, so none gathers more than a bounded share. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.kernels import Prefix, U, mix

#: Documents for each bucket.
PER_BUCKET = 2000
ALL, PART = 1, 2  # bits of a reply: the whole run repeats; parts of it may, so ask again
# doc and tag name a row; tags are 0, and vanish when packed, where doc_id is unique
_ENTRY = np.dtype([("s", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("a", "<i4"), ("b", "<i4"), ("many", "<u1")])
REPLY = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("a", "<i4"), ("b", "<i4"), ("code", "<u1")])
REPLIES = "doc_id long, tag long, a array<int>, b array<int>, code array<int>"
PACKED = "bucket long, data binary"


def packed(e: np.ndarray) -> bytes:
    """Records as byte planes: bytes of one significance lie together, so the shuffle's compression removes the empty ones."""
    return e.view(np.uint8).reshape(len(e), e.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def dealt(e: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed records) by s. Least hashes are small numbers, so they are mixed before they choose a bucket."""
    where = (mix(e["s"]) >> U(64 - max(1, (buckets - 1).bit_length()))).astype(np.int64)
    by = np.argsort(where, kind="stable")
    e, where = e[by], where[by]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(e) else []
    return [(int(where[i]), packed(e[i:j])) for i, j in zip(cuts, [*cuts[1:], len(e)][: len(cuts)], strict=True)]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each window of so many values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at, span = values, np.arange(len(values), dtype=np.int32), 1

    def join(shift: int, size: int):
        left, right = least[:size], least[shift : shift + size]
        take = right < left
        return np.where(take, right, left), np.where(take, at[shift : shift + size], at[:size])

    while span * 2 <= width:
        least, at = join(span, len(least) - span)
        span *= 2
    if span < width:
        least, at = join(width - span, n)
    return at[:n]


def anchored_runs(prefix: Prefix, edges: np.ndarray, window: int, gram: int):
    """(text, first window, last window, anchor's place, its hash, hash of the run), in units of the texts; edges: offsets of texts."""
    n = int(edges[-1])
    g = prefix.hash(np.arange(max(n - gram + 1, 0)), np.arange(max(n - gram + 1, 0)) + gram)
    at = sliding_argmin(g, window - gram + 1)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + window <= edges[1:][doc])
    at, doc = at[inside], doc[inside]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, np.int64)
    first, last = inside[cut], inside[np.append(cut[1:], len(at)) - 1] if len(cut) else inside[cut]
    d = doc[cut]
    return d, first - edges[d], last - edges[d], at[cut] - edges[d], g[at[cut]], prefix.hash(first, last + window)


def entries(doc, tag, a, b, s, k) -> np.ndarray:
    out = np.zeros(len(doc), _ENTRY)
    out["doc"], out["tag"], out["a"], out["b"], out["s"], out["k"] = doc, tag, a, b, s, k
    return out


def replies(doc, tag, a, b, code) -> np.ndarray:
    out = np.zeros(len(doc), REPLY)
    out["doc"], out["tag"], out["a"], out["b"], out["code"] = doc, tag, a, b, code
    return out


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): doc_id as a long, and what tells rows of one doc_id apart: a hash of the text, 0 for all if ids are unique.

    Rows that repeat a doc_id and its text share the tag: they are alike in all that follows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return docs.withColumn("tag", F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text"))


def settle(e: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entries to pass on, one or few for a key; replies that are certain already) of one batch.

    smaller: a run repeats only if a document with a smaller id has it. Otherwise
    any second place counts.
    """
    # a key's lead is a run whose reply is open (many < 2), if it has one: the sender of the others has named their own already
    e = e[np.lexsort((e["a"], e["tag"], e["doc"], *([] if smaller else [e["many"] > 1]), e["k"], e["s"]))]
    if not len(e):
        return e, np.zeros(0, REPLY)
    new_s = np.concatenate([[True], e["s"][1:] != e["s"][:-1]])
    new_k = new_s | np.concatenate([[True], e["k"][1:] != e["k"][:-1]])
    s_id, k_id = np.cumsum(new_s) - 1, np.cumsum(new_k) - 1
    k_at, s_at = np.flatnonzero(new_k), np.flatnonzero(new_s)
    size = np.diff(np.append(k_at, len(e)))
    many = np.logical_or.reduceat(e["many"] > 0, k_at)
    kinds = np.bincount(s_id[k_at])
    least = e["doc"][k_at][k_id]
    if smaller:
        whole, lead = e["doc"] > least, e["doc"] == least
    else:
        whole, lead = ((size > 1) | many)[k_id], new_k
    wild = (np.logical_or.reduceat(e["many"] > 1, s_at) | (kinds > 1))[s_id]
    part = wild & lead & (e["many"] < 2)
    real = e["many"] < 2
    code = np.where(whole & real, ALL, 0) + np.where(part, PART, 0)
    hit = np.flatnonzero(code)
    sure = replies(*(e[c][hit] for c in ("doc", "tag", "a", "b")), code[hit])
    # one entry for a key that has several runs; the leaders of a key with one
    on = np.where(wild, new_s, lead)
    out = e[on].copy()
    w = wild[on]
    out["many"] = np.where(w, 2, np.where(((size > 1) | many)[k_id][on], 1, 0) if not smaller else 0)
    return out, sure


def answer(e: np.ndarray, smaller: bool) -> np.ndarray:
    """The replies to all entries of a bucket."""
    return settle(e, smaller)[1]


def ask(source: DataFrame, make, buckets: int, smaller: bool) -> DataFrame:
    """(doc_id, tag, a, b, code) for the runs that make(batch) gives as entries: those that repeat, wholly or maybe in part."""

    def send(batches):
        for batch in batches:
            e, direct = settle(make(batch), smaller)
            rows = [(bucket, 0, data) for bucket, data in dealt(e, buckets)]
            if len(direct):
                rows.append((int(direct["doc"][0]) % buckets, 1, packed(direct)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])

    def receive(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    yield grouped(unpacked(data, REPLY), buckets)
                else:
                    held.setdefault(bucket, []).append(unpacked(data, _ENTRY))
        for parts in held.values():
            yield grouped(answer(np.concatenate(parts), smaller), buckets)

    sent = source.mapInArrow(send, "bucket long, kind int, data binary").repartition(buckets, "bucket")
    return by_document(sent.mapInArrow(receive, PACKED), REPLY, buckets, REPLIES)


def grouped(r: np.ndarray, groups: int) -> pa.RecordBatch:
    """Replies as one packed row for each group of documents."""
    key = mix(r["doc"].astype(U) ^ r["tag"].astype(U))
    by = np.argsort(key, kind="stable")
    r, where = r[by], (key[by] >> U(64 - max(1, (groups - 1).bit_length()))).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(r) else []
    rows = [(int(where[i]), packed(r[i:j])) for i, j in zip(cuts, [*cuts[1:], len(r)][: len(cuts)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "data"])


def by_document(replies: DataFrame, kind: np.dtype, groups: int, schema: str) -> DataFrame:
    """All replies of a row (doc_id, tag) in lists, as many as it has runs at most."""
    names = [n for n in kind.names if n not in ("doc", "tag")]

    def gather(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(group, []).append(data)
        for parts in held.values():
            r = np.concatenate([unpacked(x, kind) for x in parts])
            r = r[np.lexsort((r["tag"], r["doc"]))]
            new = np.flatnonzero(np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1])]))
            edges = pa.array(np.append(new, len(r)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(r[c].view(np.int64) if kind[c] == np.dtype("<u8") else r[c].astype(np.int32))) for c in names]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(r[c][new]), pa.int64()) for c in ("doc", "tag")), *lists], names=["doc_id", "tag", *names])

    return replies.repartition(groups, "bucket").mapInArrow(gather, schema)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column without nulls inside."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets)) if not column.null_count else np.array([len(x) if x else 0 for x in column.to_pylist()])
    values = np.asarray(column.flatten()) if len(column) else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(column)), sizes), values


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the half-open ranges [a, b)."""
    if not len(a):
        return []
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True))


def buckets_for(docs: DataFrame) -> int:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, -(-docs.count() // PER_BUCKET))
