"""Language ID by segmentation-marginalised unigrams.

For each language, probabilities of the pieces of a fixed public vocabulary are
fitted by expectation-maximisation; a text's likelihood sums over all ways of
cutting its whole words into pieces (forward algorithm), once per distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickforge.llm.kernels import U, Words, mix, slices

#: Labelled documents at most that the model is fitted on, the first by a hash of doc_id.
SAMPLE = 1500
STEPS, SMOOTH = 3, 0.05
#: Bytes of the longest words that the model is fitted on. Longer ones are scored like any other.
LEARNED = 32
#: Bytes from which a word is segmented on its own, and starts in it that are looked up together.
LONG, STRETCH = 256, 4096
#: Distinct words whose scores a task remembers.
REMEMBERED = 1 << 17
UNKNOWN = "und"
_STEP = U(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of the pieces, the 256 single bytes among them
    probs: np.ndarray  # pieces x langs
    longest: int  # bytes of the longest piece


def hash_of(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_STEP) + b + 1) % (1 << 64)
    return h


def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """(sorted hashes of all the vocabulary's pieces as bytes, word start being a space, and of every single byte as a fallback; the longest one's bytes)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            pieces.add(sp.id_to_piece(i).replace("▁", " ").encode())
    pieces.discard(b"")
    return np.unique(mix(np.array([hash_of(p) for p in pieces], U))), max(map(len, pieces))


def found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the hashes that are a piece's, those pieces)."""
    m = mix(h)
    at = np.minimum(np.searchsorted(keys, m), len(keys) - 1)
    rows = np.flatnonzero(keys[at] == m)
    return rows, at[rows]


def lattice(keys: np.ndarray, letters: np.ndarray, longest: int):
    """For each start in the rows of a byte matrix, in order: (start, [(bytes, rows, pieces)])."""
    m, n = letters.shape
    if n <= LONG:
        for i in range(n):
            h, out = np.zeros(m, U), []
            for size in range(1, min(longest, n - i) + 1):
                h = h * _STEP + letters[:, i + size - 1].astype(U) + U(1)
                rows, piece = found(keys, h)
                if len(rows):
                    out.append((size, rows, piece))
            yield i, out
        return
    # one long word at a time: all its starts in a stretch are looked up together
    one = np.zeros(1, np.int64)
    for lo in range(0, n, STRETCH):
        starts = np.arange(lo, min(lo + STRETCH, n))
        h, here = np.zeros(len(starts), U), [[] for _ in starts]
        for size in range(1, longest + 1):
            inside = starts + size <= n
            h = h * _STEP + letters[0, np.minimum(starts + size - 1, n - 1)].astype(U) + U(1)
            rows, piece = found(keys, h)
            for k, p in zip(rows.tolist(), piece.tolist(), strict=True):
                if inside[k]:
                    here[k].append((size, one, np.array([p])))
        yield from zip(starts.tolist(), here, strict=True)


def by_length(words: list[bytes]):
    """(indices, byte matrix) for the words of each length; a long word is a matrix of its own."""
    sizes = np.array([len(w) for w in words], np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for part in [at] if n <= LONG else at[:, None]:
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)


def forward(model: Model, words: list[bytes]) -> np.ndarray:
    """Log likelihood of each whole word (rows; a space goes before it) by language, over all segmentations.

    Only the sums that the longest piece can still reach are held; they are scaled on the way.
    """
    out = np.zeros((len(words), len(model.langs)))
    for at, letters in by_length([b" " + w for w in words]):
        m, n = letters.shape
        ring = min(model.longest, n) + 1
        sums = np.zeros((ring, m, len(model.langs)))
        sums[0] = 1
        logs = np.zeros((m, len(model.langs)))
        for i, pieces in lattice(model.keys, letters, model.longest):
            if i % 16 == 15:
                top = sums.max(axis=0)
                sums /= top
                logs += np.log(top)
            now = sums[i % ring].copy()
            sums[i % ring] = 0
            for size, rows, piece in pieces:
                sums[(i + size) % ring, rows] += now[rows] * model.probs[piece]
        out[at] = logs + np.log(sums[n % ring])
    return out


def fit(path: str, counted: dict[tuple[str, str], int]) -> Model | None:
    """A model from counts of (language, word), by expectation-maximisation over the words of at most LEARNED bytes."""
    langs = sorted({k for k, _ in counted})
    if not langs:
        return None
    keys, longest = vocabulary(path)
    words = sorted({w.encode() for _, w in counted if len(w.encode()) <= LEARNED})
    index = {w: k for k, w in enumerate(words)}
    weight = np.zeros((len(index), len(langs)))
    for (lang, word), n in counted.items():
        if word.encode() in index:
            weight[index[word.encode()], langs.index(lang)] += n
    probs = np.full((len(keys), len(langs)), 1 / len(keys))
    groups = [(at, letters.shape[1], list(lattice(keys, letters, longest))) for at, letters in by_length([b" " + w for w in words])]
    for _ in range(STEPS):
        mass = np.full_like(probs, SMOOTH)
        for at, n, edges in groups:
            alpha = np.zeros((n + 1, len(at), len(langs)))
            beta = np.zeros_like(alpha)
            alpha[0], beta[n] = 1, 1
            for i, pieces in edges:
                for size, rows, piece in pieces:
                    alpha[i + size, rows] += alpha[i, rows] * probs[piece]
            for i, pieces in reversed(edges):
                for size, rows, piece in pieces:
                    beta[i, rows] += beta[i + size, rows] * probs[piece]
            scale = np.where(alpha[n] > 1e-290, weight[at] / np.maximum(alpha[n], 1e-290), 0.0)
            for i, pieces in edges:
                for size, rows, piece in pieces:
                    part = alpha[i, rows] * probs[piece] * beta[i + size, rows] * scale[rows]
                    for k in range(len(langs)):
                        mass[:, k] += np.bincount(piece, part[:, k], len(keys))
        probs = mass / mass.sum(axis=0)
    return Model(langs, keys, probs, longest)


class Memory:
    """Scores of words that were seen before, by their hashes; it starts anew when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.logs = np.zeros(0, U), np.zeros((0, len(model.langs)))

    def scores(self, hashes: np.ndarray, word) -> np.ndarray:
        """Log likelihoods for sorted distinct hashes; word(k) gives the bytes of the k-th."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), len(self.model.langs)))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        out[new] = forward(self.model, [word(k) for k in new])
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.logs = hashes, out
        elif len(new):
            keys, logs = np.concatenate([self.keys, hashes[new]]), np.concatenate([self.logs, out[new]])
            by = np.argsort(keys)
            self.keys, self.logs = keys[by], logs[by]
        return out


def score(memory: Memory, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, -1 without a letter; its share of the likelihood) of each text."""
    best, share = np.full(len(texts), -1), np.zeros(len(texts))
    for lo, hi, buf, offsets in slices(texts):
        w = Words(buf, offsets)
        distinct, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        logs = memory.scores(distinct, lambda k: raw[w.starts[first[k]] : w.ends[first[k]]])[inverse]  # noqa: B023
        sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
        total = sums[w.first[1:]] - sums[w.first[:-1]]
        top = total.argmax(axis=1)
        odds = 1 / np.exp(np.minimum(total - total[np.arange(len(top)), top][:, None], 0)).sum(axis=1)
        letters = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for k in np.flatnonzero(~has):
            has[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
        best[lo:hi], share[lo:hi] = np.where(has, top, -1), np.where(has, odds, 0.0)
    return best, share


def language_id(docs: DataFrame, path: str, train: str = "crc32(cast(doc_id AS string)) % 4 <> 2", sample: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score added.

    docs: (doc_id, text, lang, ...). The model learns from at most `sample` rows
    that meet `train` with text and lang, the first by a hash of doc_id. Null
    texts and texts without a letter get `und` and 0, as do all texts where nothing can
    be learned; equal likelihoods go to the first language. lang_pred and score
    replace columns of these names; nulls, repeated rows and other columns stay.
    """
    spark = docs.sparkSession
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(train)
    ids = [r[0] for r in known.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample).collect()]
    counted: dict = {}
    if ids:
        words = known.where(F.col("doc_id").isin(ids)).select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
        counted = {(r["lang"], r["word"]): r["count"] for r in words.groupBy("lang", "word").count().toLocalIterator()}
    model = fit(path, counted)
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary
    base = docs.drop("lang_pred", "score")
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches):
        m = shared.value
        memory = Memory(m) if m else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            if m is None:
                names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                best, share = score(memory, texts)
                names = [m.langs[k] if k >= 0 else UNKNOWN for k in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(share, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(predict, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def language_query(spark, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = language_id(docs, vocabulary_path())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
