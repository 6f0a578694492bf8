"""Line dedup with a log-template tree.

A line's leaf is its token count and its leading tokens; variable fields (tokens
with digits) are generalised at once, and all templates in one leaf that differ in a
single token are merged, whether they recur on their own or not. A template that
recurs across enough documents, merged or alone, is dropped everywhere but at its
first place; a line of several merged templates stays where it is the first of all.

Lines that can merge share the leaf and one half of their tokens, so only lines
whose halves are in enough documents give out their tokens one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.kernels import BASE, U, Prefix, Words, mix, powers, slices
from tickforge.llm.scratch import Scratch

#: Documents in which a template must occur to be dropped; leading tokens that choose the leaf;
#: tokens from which one may vary, so that merged lines are alike in three quarters at least.
DOCUMENTS, DEPTH, LEAST = 10, 2, 4
FIELD_HASH = U(0x2A2A2A2A2A2A2A2A)
#: Size of the bitmap of frequent keys (8 MB whatever the input), and the bits of it that one task gathers at a time.
BITS, BLOCK = 26, 1 << 21
_ODD = U(0xC2B2AE3D27D4EB4F)


def parsed(batch: pa.RecordBatch):
    """(rows, line numbers, hashes of the generalised tokens, first token and end of each line with a word), by slices of a batch."""
    for lo, _, buf, offsets in slices(batch.column(1)):
        # every line is a text of its own here
        breaks = np.flatnonzero(buf == 10) + 1
        edges = np.unique(np.concatenate([offsets, breaks]))
        w = Words(buf, edges)
        digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
        hashes = np.where(digits[w.ends] > digits[w.starts], FIELD_HASH, w.hashes)
        some = np.flatnonzero(w.counts > 0)
        doc = np.searchsorted(offsets, edges[some], "right") - 1
        line = np.searchsorted(breaks, edges[some], "right") - np.searchsorted(breaks, offsets[doc], "right")
        yield lo + doc, line, hashes, w.first[some], w.first[some + 1]


def halves(prefix: Prefix, s: np.ndarray, e: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token that starts the second half, first key, second key, whether there is one) of each line.

    Lines that differ in one token of the second half share the first key, those
    that differ in one of the first half, behind the leading tokens, the second.
    A line of fewer than LEAST tokens has its whole sequence as key.
    """
    k = e - s
    mid = s + np.where(k >= LEAST, np.maximum(depth, (k + 1) // 2), k)
    one = mix(prefix.hash(s, mid) + k.astype(U) * _ODD)
    more = mid - s > depth
    more &= k >= LEAST
    two = mix(mix(prefix.hash(s, np.minimum(s + depth, e)) + k.astype(U) * _ODD) + prefix.hash(mid, e))
    return mid, one, two, more


def frequent_keys(docs: DataFrame, documents: int, depth: int) -> np.ndarray:
    """A bitmap of 2**BITS bits with one set for each key of that many documents; it steers speed, never results."""

    def count(batches):
        for batch in batches:
            found = [np.zeros(0, U)]
            for doc, _, hashes, s, e in parsed(batch):
                _, one, two, more = halves(Prefix(hashes), s, e, depth)
                key, row = np.concatenate([one, two[more]]), np.concatenate([doc, doc[more]])
                by = np.lexsort((row, key))
                key, row = key[by], row[by]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                found.append(key[new])
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    def gather(batches):
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for block in np.unique(cell // BLOCK).tolist():
                sets.setdefault(block, np.zeros(BLOCK, bool))[cell[cell // BLOCK == block] % BLOCK] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([np.packbits(v).tobytes() for v in sets.values()], pa.binary())], names=["block", "bits"])

    keys = docs.select("doc_id", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= documents)
    cells = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("cell")).repartition((1 << BITS) // BLOCK, F.expr(f"cell div {BLOCK}"))
    out = np.zeros(((1 << BITS) // BLOCK, BLOCK // 8), np.uint8)
    for r in cells.mapInArrow(gather, "block long, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def template_lines(docs: DataFrame, bitmap, depth: int) -> DataFrame:
    """(doc_id, tag, line, template, groups) of the lines whose keys are frequent.

    template is a hash of the tokens in order; groups has, once for each template of a
    batch, hashes of the tokens but for one behind the leading ones (of all tokens of a
    line with fewer than LEAST), and is null in its other rows.
    """

    def find(batches):
        bits = bitmap.value
        hot = lambda key: (bits[(c := (key >> U(64 - BITS)).astype(np.int64)) >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
        for batch in batches:
            said = np.zeros(0, U)
            for doc, line, hashes, s, e in parsed(batch):
                p = Prefix(hashes)
                mid, one, two, more = halves(p, s, e, depth)
                late = hot(one)
                early = more & hot(two)
                at = np.flatnonzero(late | early)
                if not len(at):
                    continue
                s, e, mid, late, early = (v[at] for v in (s, e, mid, late, early))
                template = p.hash(s, e)
                _, lead = np.unique(template, return_index=True)
                new = np.zeros(len(at), bool)
                new[lead] = True
                new &= ~np.isin(template, said)
                said = np.union1d(said, template)
                # tokens that may vary: those of the first half, of the second, or both
                lo = np.where(early, s + depth, mid)
                hi = np.where(late, e, mid)
                short = e - s < LEAST
                per = np.where(new, np.where(short, 1, hi - lo), 0)
                row = np.repeat(np.arange(len(at)), per)
                token = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + lo[row]
                whole = (p.sums[e] - p.sums[s]) * p.inverse[s]
                token = np.where(short[row], s[row], token)
                place = token - s[row]
                out = hashes[token] * powers(BASE, int(place.max(initial=0)) + 1)[place]
                rest = mix(whole[row] - np.where(short[row], U(0), out))
                group = mix(rest + (e - s)[row].astype(U) * _ODD + np.where(short[row], 0, place + 1).astype(U) * U(BASE))
                edges = np.concatenate([[0], np.cumsum(per)])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(group.view(np.int64)))
                groups = lists.take(pa.array(np.arange(len(at)), mask=~new))
                rows = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(line[at], pa.int32()), pa.array(template.view(np.int64)), groups], names=["doc_id", "tag", "line", "template", "groups"])

    return docs.select("doc_id", "text", "tag").mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, line int, template long, groups array<long>")


def recurring(scratch: Scratch, lines: DataFrame, documents: int) -> DataFrame:
    """(template, first) of the templates that recur, alone or with all others that differ in one token; first is the first place of these."""
    # equal templates of a document meet before they are counted
    once = scratch.save(lines.groupBy("template", "doc_id").agg(F.min(F.struct("tag", "line")).alias("at")), "once")
    df = once.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at.tag", "at.line")).alias("at"))
    groups = lines.where("groups IS NOT NULL").groupBy("template").agg(F.first("groups").alias("groups"))
    wild = scratch.save(df.join(groups.hint("merge"), "template").select("template", "n", "at", F.explode("groups").alias("group")), "wild")
    many = wild.groupBy("group").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("at").alias("first")).where(F.col("n") >= documents)
    many = scratch.save(many, "many")
    # a document may have several templates of a group, so groups without a template that recurs alone are counted by document
    open_ = wild.where(F.col("n") < documents).join(many.where(F.col("most") < documents).select("group").hint("merge"), "group").select("template", "group")
    by_doc = open_.join(once.select("template", "doc_id").hint("merge"), "template").select("group", "doc_id").distinct()
    sure = by_doc.groupBy("group").count().where(F.col("count") >= documents).select("group")
    sure = scratch.save(many.where(F.col("most") >= documents).select("group").unionByName(sure), "sure")
    firsts = many.join(sure.hint("merge"), "group").select("group", "first")
    return wild.select("template", "group").join(firsts.hint("merge"), "group").groupBy("template").agg(F.min("first").alias("first"))


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS, depth: int = DEPTH) -> DataFrame:
    """docs with recurring template lines removed from text, and n_lines, n_dropped (long) added.

    The first place of a recurring template (smallest doc_id, then line) is kept. Lines
    without a word stay. Null texts stay null with no lines; a null doc_id is
    never matched, so its rows are unchanged; rows of one doc_id count as one document, but lose
    lines each by its own text (the first place is in one of them; rows that repeat it in whole all keep it);
    other columns are kept, n_lines and n_dropped replaced. No rows give none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    base = docs.drop("n_lines", "n_dropped")
    twice = base.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    tag = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text")
    known = base.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", tag.alias("tag"))
    bitmap = spark.sparkContext.broadcast(frequent_keys(known, documents, depth))
    scratch.drop()
    lines = scratch.save(template_lines(known, bitmap, depth), "lines")
    again = scratch.save(recurring(scratch, lines, documents), "recurring")
    scratch.drop("once", "wild", "many", "sure")
    places = lines.select("doc_id", "tag", "line", "template").join(again.hint("merge"), "template")
    gone = scratch.save(places.where(F.struct("doc_id", "tag", "line") != F.col("first")).select("doc_id", "tag", "line"), "gone")
    scratch.drop("lines", "recurring")
    per = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).agg(F.collect_set("line").alias("_gone_lines")).hint("merge")
    joined = base.withColumn("_own_tag", tag).join(per, (F.col("doc_id") == F.col("_gone_id")) & (F.col("_own_tag") == F.col("_gone_tag")), "left").drop("_gone_id", "_gone_tag", "_own_tag")
    joined = joined.withColumn("_parts", F.split("text", "\n"))
    n = F.coalesce(F.size("_parts"), F.lit(0))
    hit = F.col("_gone_lines").isNotNull() & (n > 0)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "_gone_lines")
    left = F.array_join(F.transform(kept, lambda i: F.get("_parts", i)), "\n")
    return joined.select(
        *(F.when(hit, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in base.columns),
        n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone_lines"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_query(spark, sf_dir: str) -> DataFrame:
    """op4 over all documents: what is left of each."""
    return drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
