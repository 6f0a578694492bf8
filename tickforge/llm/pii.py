"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on windows of the documents, labelled by the
patterns' spans. Overlapping windows are decoded and reconciled over the whole
text: each character takes its label from the window in which it is most central, and
a span is widened to the letters and digits that it would cut through.
Every window of every text is decoded, and the training windows are drawn from all texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.kernels import U, mix, slices

KINDS = ("email", "ip", "card", "phone")
SIZE, STRIDE = 128, 96
#: Windows at most that the network is trained on, half of them with base spans, the first by a hash of document and place.
SAMPLE = 1600
STEPS, BATCH, HIDDEN, EMBED, RATE = 150, 64, 12, 12, 0.02
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and place.

    Scans from each at sign and each run of digits, so a long text costs time in
    proportion; the matches are those of the plain patterns from left to right.
    """
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        end = m.end() if m else max(end, at + 1)  # no local part reaches across an at sign
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def codes(text: str) -> np.ndarray:
    """Characters as 0 (padding) to 127; those beyond ASCII by whether they are letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 126, points + 1, 127)
    return out.astype(np.int64)


def window_starts(length: int) -> np.ndarray:
    """Starts of all overlapping windows of a text of so many characters."""
    return np.arange(0, length, STRIDE)


def labels(text: str) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, a, b in reversed(patterns(text)):
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def squashed(x: np.ndarray) -> np.ndarray:
    """Into (-1, 1), by x / (1 + |x|)."""
    return x / (1 + np.abs(x))


class Network:
    """Embedding, LSTM in both directions, linear scores, CRF transitions.

    Gates are linear between 0 and 1, and cells are squashed without exponentials: every
    character of a corpus goes through them.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *shape: r.normal(0, 0.2, shape)
        self.p = {"E": w(128, EMBED), "Wf": w(EMBED + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN), "Wb": w(EMBED + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN), "V": w(2 * HIDDEN, TAGS), "c": np.zeros(TAGS), "T": w(TAGS, TAGS)}
        self.p["bf"][:HIDDEN] = self.p["bb"][:HIDDEN] = 1.0  # forget gates open

    def lstm(self, x: np.ndarray, w: np.ndarray, b: np.ndarray):
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.zeros((n, t, HIDDEN)), []
        inner = x @ w[:EMBED] + b
        for i in range(t):
            z = inner[:, i] + h @ w[EMBED:]
            s = np.clip(z[:, : 3 * HIDDEN] / 4 + 0.5, 0, 1)
            f, g, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            new = squashed(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + g * new
            th = squashed(c)
            h = o * th
            out[:, i] = h
            kept.append((f, g, o, new, before, th, h_before))
        return out, kept

    def lstm_back(self, x, w, kept, d_out):
        n, t, _ = x.shape
        dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.zeros_like(x)
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for i in range(t - 1, -1, -1):
            f, g, o, new, before, th, h_before = kept[i]
            dh = dh + d_out[:, i]
            dc = dc + dh * o * (1 - np.abs(th)) ** 2
            open_ = lambda s: ((s > 0) & (s < 1)) / 4
            dz = np.concatenate([dc * before * open_(f), dc * new * open_(g), dh * th * open_(o), dc * g * (1 - np.abs(new)) ** 2], axis=1)
            dw[:EMBED] += x[:, i].T @ dz
            dw[EMBED:] += h_before.T @ dz
            db += dz.sum(0)
            dx[:, i] = dz @ w[:EMBED].T
            dh, dc = dz @ w[EMBED:].T, dc * f
        return dw, db, dx

    def scores(self, x: np.ndarray):
        e = self.p["E"][x]
        f, kf = self.lstm(e, self.p["Wf"], self.p["bf"])
        b, kb = self.lstm(e[:, ::-1], self.p["Wb"], self.p["bb"])
        h = np.concatenate([f, b[:, ::-1]], axis=2)
        return h @ self.p["V"] + self.p["c"], (e, kf, kb, h)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tag sequences."""
        s, (e, kf, kb, h) = self.scores(x)
        n, t, k = s.shape
        trans = self.p["T"]
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = s[:, 0]
        for i in range(1, t):
            alpha[:, i] = lse(alpha[:, i - 1][:, :, None] + trans, 1) + s[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = lse(trans + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - z[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + trans + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        ds[np.arange(n)[:, None], np.arange(t), y] -= 1
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds, pairs = ds / n, pairs / n
        dh = ds @ self.p["V"].T
        g = {"V": np.einsum("nth,ntk->hk", h, ds), "c": ds.sum((0, 1)), "T": pairs}
        g["Wf"], g["bf"], dx = self.lstm_back(e, self.p["Wf"], kf, dh[:, :, :HIDDEN])
        g["Wb"], g["bb"], back = self.lstm_back(e[:, ::-1], self.p["Wb"], kb, dh[:, ::-1, HIDDEN:])
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x, dx + back[:, ::-1])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            at = r.integers(0, len(x), min(BATCH, len(x)))
            for k, g in self.gradients(x[at], y[at]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.p[k] -= RATE * (1 - 0.8 * i / steps) * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.999**i)) + 1e-8)
        return self

    def quick_scores(self, x: np.ndarray) -> np.ndarray:
        """scores() in single precision, of nothing but the outputs; inputs are looked up by character, the gates' scale is in the weights."""
        n, t = x.shape
        out = np.empty((t, n, 2 * HIDDEN), np.float32)
        gate = np.repeat([0.25, 1.0], [3 * HIDDEN, HIDDEN])
        middle = np.repeat([0.5, 0.0], [3 * HIDDEN, HIDDEN])
        one = np.float32(1)
        for w, b, own, places in ((self.p["Wf"], self.p["bf"], slice(None, HIDDEN), range(t)), (self.p["Wb"], self.p["bb"], slice(HIDDEN, None), range(t - 1, -1, -1))):
            table = ((self.p["E"] @ w[:EMBED] + b) * gate + middle).astype(np.float32)
            inner = (w[EMBED:] * gate).astype(np.float32)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for i in places:
                z = table[x[:, i]]
                z += h @ inner
                new = z[:, 3 * HIDDEN :]
                new = new / (one + np.abs(new))
                s = np.clip(z[:, : 3 * HIDDEN], np.float32(0), one)
                c *= s[:, :HIDDEN]
                c += s[:, HIDDEN : 2 * HIDDEN] * new
                h = s[:, 2 * HIDDEN :] * c
                h /= one + np.abs(c)
                out[i, :, own] = h
        return (out @ self.p["V"].astype(np.float32) + self.p["c"].astype(np.float32)).transpose(1, 0, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags of each window."""
        s = self.quick_scores(x)
        tags = np.zeros(x.shape, np.int8)
        # a run of k tags changes k + 1 transitions, so where each step with a tag loses more than two of them can gain, no tag at all is the best path
        room = np.float32(2 * (self.p["T"].max() - self.p["T"][0, 0]))
        unsure = np.flatnonzero((s[:, :, 0] - s[:, :, 1:].max(2)).min(1) <= room)
        if len(unsure):
            tags[unsure] = self.best_path(s[unsure])
        return tags

    def best_path(self, s: np.ndarray) -> np.ndarray:
        n, t, k = s.shape
        best, back = s[:, 0], np.zeros((n, t, k), np.int8)
        for i in range(1, t):
            v = best[:, :, None] + self.p["T"]
            back[:, i] = v.argmax(1)
            best = v.max(1) + s[:, i]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(n), i, tags[:, i]]
        return tags


def windows(text: str, starts: np.ndarray) -> np.ndarray:
    c = np.concatenate([codes(text), np.zeros(SIZE, np.int64)]).astype(np.uint8)
    return c[starts[:, None] + np.arange(SIZE)]


def holding(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts of a text's windows, whether each one holds a part of a base span)."""
    starts = window_starts(len(text))
    held = np.zeros(len(starts) + 1, np.int64)
    for _, a, b in patterns(text):
        held[max(0, (a - SIZE) // STRIDE + 1)] += 1
        held[(b - 1) // STRIDE + 1] -= 1
    return starts, np.cumsum(held[:-1]) > 0


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tags) of the sample: half of windows that hold a part of a base span, half of any window.

    Windows come from all texts, in order of a hash. A first pass counts both kinds, which says
    below which hash about four times each half lies; so all tasks together send no
    more than that to the driver, whatever their number.
    """

    def count(batches):
        for batch in batches:
            held = [holding(text)[1] for _, text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, held))], pa.int64()), pa.array([sum(int(x.sum()) for x in held)], pa.int64())], names=["n", "k"])

    def cut(kind: int, most: int):
        def run(batches):
            for batch in batches:
                hs, data = [], []
                for doc, text in texts_of(batch):
                    starts, held = holding(text)
                    h = mix(starts.astype(U) + U(zlib.crc32(f"{doc}".encode()) << 32)) >> U(1)
                    at = np.flatnonzero((h < U(most)) & (held if kind else True))
                    if not len(at):
                        continue
                    y = np.concatenate([labels(text), np.zeros(SIZE, np.int64)])
                    for k, x in zip(at.tolist(), windows(text, starts[at]), strict=True):
                        hs.append(int(h[k]))
                        data.append(x.tobytes() + y[starts[k] : starts[k] + SIZE].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(data, pa.binary())], names=["h", "data"])

        return run

    sums = docs.mapInArrow(count, "n long, k long").agg(F.sum("n"), F.sum("k")).first()
    every, half = [], sample // 2
    for kind, total in enumerate(n or 0 for n in sums):
        most, found = min(1 << 63, int((1 << 63) * (4 * half / max(total, 1)))), []
        while total:
            found = docs.mapInArrow(cut(kind, most), "h long, data binary").orderBy("h", "data").limit(half).collect()
            if len(found) >= min(half, total) or most == 1 << 63:
                break
            most = min(1 << 63, 4 * most)
        every += found
    both = np.frombuffer(b"".join(r["data"] for r in every), np.uint8).reshape(-1, 2, SIZE).astype(np.int64)
    return both[:, 0], both[:, 1]


def texts_of(batch):
    """(doc_id, text) of the rows with a text."""
    for lo, hi, buf, offsets in slices(batch.column(1)):
        for k in np.flatnonzero(offsets[1:] > offsets[:-1]):
            yield batch.column(0)[lo + int(k)].as_py(), buf[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")


def reconcile(length: int, starts: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) over the whole text from the tags of its windows."""
    said, depth = np.zeros(length + SIZE, np.int64), np.full(length + SIZE, -1)
    inner = np.minimum(np.arange(SIZE), SIZE - 1 - np.arange(SIZE))
    for start, t in zip(starts.tolist(), tags, strict=True):
        own = slice(start, start + SIZE)
        take = inner > depth[own]
        said[own] = np.where(take, t, said[own])
        depth[own] = np.where(take, inner, depth[own])
    out, kind, begin = [], -1, 0
    for i in np.flatnonzero(np.append(said[:length], 0) != np.append(-1, said[:length])).tolist() + [length]:
        tag = said[i] if i < length else 0
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2):
            out.append((int(kind), begin, i))
            kind = -1
        if now >= 0 and kind < 0:
            kind, begin = now, i
    return out


def whole(text: str, a: int, b: int, least: int) -> tuple[int, int]:
    """A decoded span without spaces at its ends, widened to whole runs of letters and digits; nothing before least is taken."""
    a = max(a, least)
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    if a >= b:
        return a, a
    while a > least and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every document.

    docs: (doc_id, text), other columns ignored. Null texts are empty, without spans.
    The network adds a span only where it overlaps no other. Repeated rows give a row each; a null doc_id stays null; no rows give none.
    """
    docs = docs.select("doc_id", "text")
    x, y = training_windows(docs)
    network = Network().train(x, y) if len(x) else Network()
    shared = docs.sparkSession.sparkContext.broadcast(network.p if len(x) else None)

    def find(batches):
        net = Network()
        if shared.value:
            net.p = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = len(batch.column(0))
            base: list[list] = [[]] * n
            every = [""] * n
            for lo, hi, buf, offsets in slices(batch.column(1)):
                hits = np.concatenate([[0], np.cumsum(_TRIGGER[buf])])
                rows = np.flatnonzero(offsets[1:] > offsets[:-1])
                texts = [buf[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in rows]
                starts = [window_starts(len(t)) for t in texts]
                wide = [windows(t, at) for t, at in zip(texts, starts, strict=True)]
                flat = np.concatenate(wide) if wide else np.zeros((0, SIZE), np.uint8)
                tags = np.concatenate([net.decode(flat[i : i + 2048]) for i in range(0, len(flat), 2048)]) if len(flat) and shared.value else np.zeros(flat.shape, np.int8)
                said = tags.any(1)
                at = 0
                for k, text, s in zip(rows, texts, starts, strict=True):
                    # every base span has a digit or an at sign
                    spans = patterns(text) if hits[offsets[k + 1]] > hits[offsets[k]] else []
                    base[lo + k] = spans
                    taken = np.zeros(len(text) + 1, bool)
                    for _, a, b in spans:
                        taken[a:b] = True
                    extra = []
                    for kind, a, b in reconcile(len(text), s, tags[at : at + len(s)]) if said[at : at + len(s)].any() else []:
                        a, b = whole(text, a, b, extra[-1][2] if extra else 0)
                        if b > a and not taken[a:b].any():
                            extra.append((kind, a, b))
                            taken[a:b] = True
                    at += len(s)
                    every[lo + k] = written(spans + extra)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            shas = pa.array([hashlib.sha256(written(b).encode()).hexdigest() if b else nothing for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, shas, pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(find, RESULT)


def pii_query(spark, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
