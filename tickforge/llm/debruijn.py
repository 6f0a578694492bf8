"""Substring dedup of word sequences over a compacted de Bruijn graph.

Edges are k-mers of words (the windows), nodes what neighbouring edges share.
Nonbranching paths are compacted as runs of edges with one minimiser: first only
minimisers are joined, then the edges under those that several documents have.
Source coordinates (document and place) verify each repeated edge: it counts
for a document only if one with a smaller id has it too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.kernels import U, Prefix, Words, slices
from tickforge.llm.repeats import ALL, PACKED, ask, buckets_for, by_document, dealt, entries, flat, grouped, merged, packed, sliding_argmin, tagged, unpacked
from tickforge.llm.scratch import Scratch

WINDOW, GRAM = 13, 7
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_ASKED = np.dtype([("s", "<u8"), ("doc", "<i8"), ("tag", "<i8")])


def windows(buf: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(words, text, place in the text, minimiser, prefix) of the windows of a slice."""
    w = Words(buf, offsets)
    prefix = Prefix(w.hashes)
    m = max(len(w.starts) - gram + 1, 0)
    g = prefix.hash(np.arange(m), np.arange(m) + gram)
    at = sliding_argmin(g, window - gram + 1)
    doc = w.doc_of()[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + window <= w.first[1:][doc])
    return w, doc[inside], inside, g[at[inside]], prefix


def shared_minimisers(docs: DataFrame, n: int, window: int, gram: int) -> DataFrame:
    """(doc_id, tag, s): the minimisers of a document that other documents have as well."""

    def send(batches):
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for lo, _, buf, offsets in slices(batch.column(2)):
                _, doc, _, s, _ = windows(buf, offsets, window, gram)
                new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])) if len(s) else []
                e = np.zeros(len(new), _ASKED)
                e["s"], e["doc"], e["tag"] = s[new], ids[lo + doc[new]], tags[lo + doc[new]]
                parts.append(e)
            e = np.concatenate(parts) if parts else np.zeros(0, _ASKED)
            e = e[np.lexsort((e["tag"], e["doc"], e["s"]))]
            new = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.zeros(0, bool)
            e = e[new]
            first = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1]])) if len(e) else np.zeros(0, np.int64)
            alone = np.diff(np.append(first, len(e))) == 1
            direct = e[~np.repeat(alone, np.diff(np.append(first, len(e))))]
            # what several documents of the batch have is certain: one entry tells the others
            out = [(*r, 0) for r in dealt(e[first[alone]], n)] + [(*r, 1) for r in dealt(e[first[~alone]], n)]
            if len(direct):
                out.append((int(direct["doc"][0]) % n, packed(direct), 2))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int32()))], names=["bucket", "data", "kind"])

    def receive(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, data, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                e = unpacked(data, _ASKED)
                if kind == 2:
                    yield grouped(e, n)
                else:
                    held.setdefault(bucket, []).append((e, np.full(len(e), kind == 1)))
        for parts in held.values():
            e, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(e["s"], kind="stable")
            e, many = e[by], many[by]
            first = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1]]))
            size = np.diff(np.append(first, len(e)))
            several = np.maximum.reduceat(e["doc"], first) != np.minimum.reduceat(e["doc"], first)
            shared = np.repeat(several | np.logical_or.reduceat(many, first), size)
            yield grouped(e[shared & ~many], n)

    sent = docs.mapInArrow(send, "bucket long, data binary, kind int").repartition(n, "bucket")
    return by_document(sent.mapInArrow(receive, PACKED), _ASKED, n, "doc_id long, tag long, s array<long>")


def repeated_edges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, Scratch]:
    """(doc_id, tag, a): places of the windows that a document with a smaller id has as well; docs: rows of tagged()."""
    scratch = Scratch(docs.sparkSession, "debruijn")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "tag", "text")
    n = buckets_for(docs)
    shared = scratch.save(shared_minimisers(docs, n, window, gram), "shared")
    scratch.drop()

    def edges(batch):
        ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        out = []
        row, s = flat(batch.column(3))
        for lo, hi, buf, offsets in slices(batch.column(2)):
            w, doc, at, m, prefix = windows(buf, offsets, window, gram)
            a, b = np.searchsorted(row, [lo, hi])
            # a document's shared minimisers: found by the pair of text and hash
            known = np.sort(s[a:b].view(U) ^ (row[a:b] - lo).astype(U) * U(0x9E3779B97F4A7C15))
            mine = m ^ doc.astype(U) * U(0x9E3779B97F4A7C15)
            place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[place] == mine) if len(known) else np.zeros(0, np.int64)
            doc, at = doc[hit], at[hit]
            h = prefix.hash(at, at + window)
            local = at - w.first[:-1][doc]
            out.append(entries(ids[lo + doc], tags[lo + doc], local, local, h, h))
        return np.concatenate(out) if out else entries([], [], [], [], [], [])

    asked = docs.join(shared, ["doc_id", "tag"]).select("doc_id", "tag", "text", "s")
    found = ask(asked, edges, n, True)
    found = found.select("doc_id", "tag", F.filter(F.arrays_zip("a", "code"), lambda z: z["code"].bitwiseAND(ALL) > 0)["a"].alias("a"))
    return scratch.save(found, "edges"), scratch


def keep_words(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of the kept words of every row of tagged()."""

    def strip(batches):
        for batch in batches:
            rows = []
            for doc, text, a in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = (text.as_py() or "").encode().split()
                starts = np.array(a.as_py() if a.is_valid else [], np.int64)
                kept, at, gone = [], 0, 0
                for x, y in merged(starts, np.minimum(starts + window, len(words))):
                    kept += words[at:x]
                    at, gone = y, gone + y - x
                kept += words[at:]
                rows.append((doc.as_py(), len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = docs.join(found, ["doc_id", "tag"], "left")
    return joined.select("doc_id", "text", "a").mapInArrow(strip, RESULT)


def word_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, judged by its own text.

    doc_id: an integer. Rows of one doc_id don't repeat each other, as none has a smaller id. Null texts have
    no words; a row with a null doc_id keeps all words; other columns are ignored; no rows give none.
    """
    docs = tagged(docs)
    found, scratch = repeated_edges(docs, window, gram)
    scratch.drop("shared")
    return keep_words(docs, found, window)


def debruijn_query(spark, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    return word_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


DEBRUIJN_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM g),
m AS MATERIALIZED (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (h) WHERE doc_id > first),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i : gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
