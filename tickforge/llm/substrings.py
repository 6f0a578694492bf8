"""Substring dedup of byte strings by prefix-free parsing.

Rolling hashes of 201 bytes trigger phrase ends: a place triggers where its hash is the
least of those in some window, so a phrase depends on nothing but its own bytes, has a
bounded length also on texts such as `aaaa`, and overlaps the next by what a window needs.

The parse is the list of phrases by place. A phrase with several places in the parse repeats
as a whole. Phrases that share a trigger but differ form a dictionary; its suffix array, over
the starts of windows and to the depth of a window, puts equal windows next to each other, and with the
parse's places of each phrase this is the corpus order: suffixes whose longest common prefix
with a neighbour reaches a window are the repeated ones. Equal windows share a trigger, so triggers
are dealt to tasks with a dictionary each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.kernels import CODES, Prefix, slices
from tickforge.llm.repeats import ALL, PACKED, PART, REPLIES, REPLY, anchored_runs, ask, buckets_for, by_document, entries, flat, grouped, merged, replies, tagged
from tickforge.llm.scratch import Scratch, small

WINDOW, GRAM = 400, 201
#: Different phrases of one trigger up to which they share a dictionary; the windows of more are dealt one by one.
TOGETHER = 2000
#: Bytes of phrases that are ordered at once.
CHUNK = 1 << 21
PHRASES = "s long, doc_id long, tag long, a int, b int, phrase binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def parse(window: int, gram: int):
    """The phrases of a batch (doc_id, tag, text) as entries: trigger, hash, and places."""

    def make(batch):
        out = []
        ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, _, buf, offsets in slices(batch.column(2)):
            d, a, b, _, s, k = anchored_runs(Prefix(CODES[buf]), offsets, window, gram)
            out.append(entries(ids[lo + d], tags[lo + d], a, b, s, k))
        return np.concatenate(out) if out else entries([], [], [], [], [], [])

    return make


def phrases(found: DataFrame, window: int, gram: int) -> DataFrame:
    """One place of each phrase that shares its trigger with others, with its bytes; found: (doc_id, tag, text, a, b, code)."""

    def cut(batches):
        for batch in batches:
            row, a = flat(batch.column(3))
            b, code = flat(batch.column(4))[1], flat(batch.column(5))[1]
            for lo, hi, buf, offsets in slices(batch.column(2)):
                mine = np.flatnonzero((row >= lo) & (row < hi) & (code & PART > 0))
                d, x, y = row[mine] - lo, a[mine].astype(np.int64), b[mine].astype(np.int64)
                fits = y + window <= np.diff(offsets)[d]
                d, x, y = d[fits], x[fits], y[fits]
                if not len(d):
                    continue
                # the trigger: the least hash that all windows of the phrase have
                g = Prefix(CODES[buf])
                start, end = offsets[d] + y, offsets[d] + x + window - gram + 1
                s = np.array([g.hash(np.arange(i, j), np.arange(i, j) + gram).min() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
                raw = buf.tobytes()
                data = pa.array([raw[i:j] for i, j in zip((offsets[d] + x).tolist(), (offsets[d] + y + window).tolist(), strict=True)], pa.binary())
                at = pa.array(lo + d)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(x, pa.int32()), pa.array(y, pa.int32()), data], names=["s", "doc_id", "tag", "a", "b", "phrase"])

    return found.mapInArrow(cut, PHRASES)


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at starts, whether each shares its first depth bytes with the one before) by prefix doubling.

    text must reach depth bytes past every start.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    n, known = len(text), min(8, depth)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = (key << np.uint64(8)) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while known < depth:
        step = min(known, depth - known)
        behind = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        # only suffixes that are followed to the end of a window need a rank
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        known += step
    order = np.argsort(rank[starts], kind="stable")
    ranked = rank[starts][order]
    return order, np.concatenate([[False], ranked[1:] == ranked[:-1]])


def dictionary(window: int, groups: int, chunk: int = CHUNK):
    """The runs of repeated windows in phrases that differ under one trigger, as packed replies; batches in order of trigger."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(rows.column("phrase").to_pylist()), np.uint8)
        a, b = (rows.column(c).to_numpy().astype(np.int64) for c in "ab")
        count = b - a + 1
        at = np.cumsum(count + window - 1) - (count + window - 1)
        own = np.repeat(np.arange(len(a)), count)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        order, same = suffix_order(text, at[own] + inside, window)
        twice = np.zeros(len(own), bool)
        twice[order] = same | np.append(same[1:], False)
        hit = np.flatnonzero(twice)
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = (own[hit[1:]] != own[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        first, last = hit[np.flatnonzero(edge[:-1])], hit[np.flatnonzero(edge[1:])]
        who = own[first]
        doc, tag = (rows.column(c).to_numpy()[who] for c in ("doc_id", "tag"))
        return grouped(replies(doc, tag, a[who] + inside[first], a[who] + inside[last], ALL), groups)

    def run(batches):
        held, size = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            size += batch.column(5).nbytes
            if size >= chunk:
                s = held.column("s").to_numpy()
                end = int(np.flatnonzero(s != s[-1])[-1]) + 1 if s[0] != s[-1] else 0  # the last trigger may go on
                if end:
                    yield settle(held.slice(0, end))
                    held = held.slice(end)
                    size = held.column("phrase").nbytes
        if held is not None and len(held):
            yield settle(held)

    return run


def alone(window: int):
    """The windows of phrases as entries, one by one."""

    def make(batch):
        a, b = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4))
        count = b - a + 1
        text = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8)
        at = np.cumsum(count + window - 1) - (count + window - 1)
        own = np.repeat(np.arange(len(a)), count)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        h = Prefix(CODES[text]).hash(at[own] + inside, at[own] + inside + window)
        doc, tag = (batch.column(k).to_numpy()[own] for k in (1, 2))
        return entries(doc, tag, a[own] + inside, a[own] + inside, h, h)

    return make


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """(doc_id, tag, runs): first and last window of each run of repeated windows, for the rows of tagged() that have any.

    A row with a null doc_id is left out, as are texts shorter than a window. Rows that
    repeat a doc_id and text are places of their own, so they repeat each other.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "tag", "text")
    n = buckets_for(docs)
    parsed = scratch.save(ask(docs, parse(window, gram), n, False), "parse")
    scratch.drop()
    doubtful = parsed.where(F.exists("code", lambda c: c.bitwiseAND(PART) > 0))
    joined = docs.join(doubtful, ["doc_id", "tag"]).select("doc_id", "tag", "text", "a", "b", "code")
    words = scratch.save(phrases(joined, window, gram), "phrases")
    scratch.drop()
    hot = scratch.save(words.groupBy("s").count().where(F.col("count") > together).select("s"), "hot")
    several = not hot.isEmpty()
    few = words.join(small(hot), "s", "left_anti") if several else words
    ordered = few.select("s", "doc_id", "tag", "a", "b", "phrase").repartition(n, "s").sortWithinPartitions("s")
    have = [parsed, by_document(ordered.mapInArrow(dictionary(window, n), PACKED), REPLY, n, REPLIES)]
    if several:
        many = words.join(small(hot), "s", "left_semi").select("s", "doc_id", "tag", "a", "b", "phrase")
        have.append(ask(many, alone(window), n, False))
    whole = None
    for df in have:
        runs = df.select("doc_id", "tag", F.filter(F.arrays_zip("a", "b", "code"), lambda z: z["code"].bitwiseAND(ALL) > 0).alias("runs")).where(F.size("runs") > 0)
        whole = runs if whole is None else whole.unionByName(runs)
    spans = whole.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    out = scratch.save(spans.select("doc_id", "tag", F.col("runs.a").alias("a"), F.col("runs.b").alias("b")), "spans")
    scratch.drop("parse", "phrases", "hot")
    return out


def remove(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of what is left of every row of tagged(); kept bytes are hashed as they are."""

    def strip(batches):
        for batch in batches:
            rows = []
            for doc, text, a, b in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = (text.as_py() or "").encode()
                runs = merged(np.array(a.as_py()), np.minimum(np.array(b.as_py()) + window, len(raw))) if a.is_valid else []
                sha, at, gone = hashlib.sha256(), 0, 0
                for x, y in runs:
                    sha.update(raw[at:x])
                    at, gone = y, gone + y - x
                sha.update(raw[at:])
                rows.append((doc.as_py(), len(raw), gone, len(runs), sha.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "a", "b").mapInArrow(strip, RESULT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, judged by its own text.

    doc_id: an integer. Null texts are empty; a row with a null doc_id keeps all of its text; other columns are ignored; no rows give none.
    """
    docs = tagged(docs)
    return remove(docs, removed_spans(docs, window, gram, together), window)


def substring_query(spark, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
