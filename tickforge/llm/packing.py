"""Best-fit packing: documents as token sequences of bounded length.

Tokens come from a public tokenizer file. Packing is online: a fixed number of open bins, kept
as a bitset keyed by free space; a piece goes to the fullest bin it fits, and
when all bins are open the fullest one closes. Pieces arrive in runs of bounded length, the
longest of a run first, which leaves short ones to fill what is open.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.scratch import Scratch

LENGTH, END_ID = 1024, 2
#: Bins open at once in one partition.
OPEN = 4096
#: Pieces in a run, and the least that a task packs.
RUN = 8192
# How the byte-level tokenizer file splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_worker: dict = {}


def byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the rest count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def probes() -> list[str]:
    """Texts on which two tokenizer libraries have to agree: all kinds of characters alone, in runs, and mixed."""
    every = [chr(c) for c in [*range(0x500), *range(0x600, 0x700), *range(0x900, 0x980), *range(0x2000, 0x2300), *range(0x3040, 0x3100), *range(0x4E00, 0x4E80), *range(0xFF00, 0xFF60), *range(0x1F600, 0x1F640)]]
    r = random.Random(5)
    common = "aeinrstldo  \n\t'\u00a0.,-01239sS"
    mixed = ["".join(r.choice(common if r.random() < 0.8 else every) for _ in range(400)) for _ in range(40)]
    return [" ".join(every), "".join(c + c + " " for c in every), "It's we'll they've I'm you'd 'RE 's", *mixed]


def tokenizer(path: str):
    """A function from text to ids for a tokenizer file, as its own library's encode() without added special tokens gives them.

    A byte-level vocabulary whose ids are its merge ranks is run by the quicker
    library if both agree on all probes. A text with one of the file's
    special strings always goes to the file's own library.
    """
    if path not in _worker:
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        plain = lambda text: own.encode(text, add_special_tokens=False).ids
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in own.get_vocab().items() if token not in special and all(c in letters for c in token)}
        quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        same = all(quick(p) == plain(p) for p in probes())
        _worker[path] = (lambda text: plain(text) if any(s in text for s in special) else quick(text)) if same else plain
    return _worker[path]


def encode(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The token ids of each whole text, END_ID included; nulls are empty."""
    ids = tokenizer(path)
    for text in texts:
        yield np.array([*ids(text.as_py() or ""), END_ID], "<u4")


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """The pieces of each document, with their ids if asked for; only the first piece of a long one can be shorter."""

    def pieces(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, seq in zip(batch.column(0).to_pylist(), encode(batch.column(1), path), strict=True):
                n = len(seq)
                edges = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row = (doc, k, a, b - a, zlib.crc32(seq[a:b].tobytes()), seq[a:b].astype(np.int32) if ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + ", ids array<int>" * ids)


class OpenBins:
    """Open bins by free space; the bitset's lowest set bit from a size up is the best fit."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count, self.made = length, most, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this size."""
        fits = self.bits >> size
        if fits:
            free = size + ((fits & -fits).bit_length() - 1)
            bin_ = self._take(free)
        else:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.length, self.made
            self.made += 1
        if free > size:
            self.by_free[free - size].append(bin_)
            self.bits |= 1 << (free - size)
            self.count += 1
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_


def runs(batches: Iterator[pa.RecordBatch], length: int = RUN) -> Iterator[pa.Table]:
    """The rows of the batches in order, in tables of so many; the last may be shorter."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            take = batch.slice(0, length - n)
            held.append(take)
            batch, n = batch.slice(len(take)), n + len(take)
            if n == length:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, path: str, length: int = LENGTH, most: int = OPEN, ids: bool = False) -> DataFrame:
    """Every piece with sequence_id and offset: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Null texts are empty (one end token); repeated rows are packed each; a null
    doc_id stays null; an empty table gives no rows; other columns are ignored.
    Pieces are dealt by doc_id and sorted, so a lost task packs the same again.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark, "pack").save(cut_pieces(docs, path, length, ids), "pieces")
    # few tasks: each leaves some bins open at its end
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, pieces.count() // RUN))
    dealt = pieces.repartition(parts, "doc_id", "piece").sortWithinPartitions("doc_id", "piece", "start", "length", "ids_crc32")

    def place(batches):
        from pyspark import TaskContext

        bins, base = OpenBins(length, most), TaskContext.get().partitionId() << 40
        for run in runs(batches):
            sizes = run.column("length").to_numpy()
            put = np.zeros((len(sizes), 2), np.int64)
            for k in np.argsort(-sizes, kind="stable").tolist():
                put[k] = bins.place(int(sizes[k]))
            run = run.append_column("sequence_id", pa.array(base + put[:, 0])).append_column("offset", pa.array(np.ascontiguousarray(put[:, 1])))
            yield from run.combine_chunks().to_batches()

    kinds = PIECES + ", ids array<int>" * ids
    return dealt.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_query(spark, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
