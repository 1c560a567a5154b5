"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages; only the document has a label. Every passage is encoded, gated
attention weighs the encodings, and the weighted sum is scored. Encoder, gates and score are
learned together from document labels on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, raw_text, scalars, schema_of, table

#: Bytes of a passage, and of the passages that are looked at together.
PASSAGE_BYTES = 512
SLICE_BYTES = 2_048 * PASSAGE_BYTES
#: Most labelled documents that the model is fitted on, and passages (evenly spaced) of each; scores take all passages.
MOST_LABELLED, MOST_PASSAGES = 6_000, 128
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED = 24, 12, 40, 64, 0.01, 3
#: Passages that are encoded at once.
CHUNK = 8_192

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?'\"-()", b"!", b"|", b"#$%&*@^~+=<>", b"[]{}/\\_`", b"\t\r\x0b\x0c", bytes(range(128, 192)), bytes(range(192, 256))]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES + 7
#: Masks that leave the first n bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
_TAIL = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(17)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def passages(raw: bytes) -> np.ndarray:
    """A row of features for every passage; a text without bytes is one row of zeros."""
    if not raw:
        return np.zeros((1, N_FEATURES), np.float32)
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros((-(-len(data) // PASSAGE_BYTES), N_FEATURES), np.float32)
    pairs: list[np.ndarray] = []
    before = np.zeros((0, 2), np.uint64)  # the beginning of the last word of the slice before
    for start in range(0, len(data), SLICE_BYTES):
        part = data[start : start + SLICE_BYTES]
        n = -(-len(part) // PASSAGE_BYTES)
        of = np.arange(len(part)) // PASSAGE_BYTES
        kind = _CLASS[part]
        sizes = np.bincount(of, minlength=n).astype(np.float32)
        rows = out[start // PASSAGE_BYTES : start // PASSAGE_BYTES + n]
        rows[:, :N_CLASSES] = np.bincount(of * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / sizes[:, None]
        # Neighbours of the slice tell where words begin and end; blanks stand around the text.
        around = np.full(len(part) + 17, 32, np.uint8)
        around[0] = data[start - 1] if start else 32
        ahead = data[start : start + len(part) + 16]
        around[1 : 1 + len(ahead)] = ahead
        blank = _BLANK[around]
        inner = ~blank[1 : 1 + len(part)]
        first, last = np.flatnonzero(inner & blank[: len(part)]), np.flatnonzero(inner & blank[2 : 2 + len(part)])
        words = np.bincount(of[first], minlength=n)
        many = np.maximum(words, 1)
        end = kind[last]
        rows[:, N_CLASSES] = (np.bincount(of[inner], minlength=n)) / many / 10
        rows[:, N_CLASSES + 1] = np.bincount(of[first], kind[first] == 1, minlength=n) / many
        rows[:, N_CLASSES + 2] = np.bincount(of[last], end == 5, minlength=n) / many
        rows[:, N_CLASSES + 3] = np.bincount(of[last], (end >= 6) & (end <= 9), minlength=n) / many
        if not len(first):
            continue
        padded = np.zeros(len(part) + 16, np.uint8)
        padded[: len(ahead)] = ahead
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 16)[first]).view(np.uint64)
        pairs.append((heads[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ heads[:, 1])
        stop = np.lib.stride_tricks.sliding_window_view(blank[1:], 16)[first]
        size = np.where(stop.any(1), stop.argmax(1), 16)
        words_16 = np.stack([heads[:, 0] & _HEAD[size], heads[:, 1] & _TAIL[size]], 1)
        again = (np.concatenate([before, words_16[:-1]]) == words_16[1 - len(before) :]).all(1)
        rows[:, N_CLASSES + 6] = np.bincount(of[first[1 - len(before) :]], again, minlength=n) / many
        before = words_16[-1:]
    if pairs:
        # How often word beginnings repeat in the whole text is told to each passage.
        every = np.concatenate(pairs)
        out[:, N_CLASSES + 4] = len(np.unique(every)) / len(every)
        out[:, N_CLASSES + 5] = min(1.0, np.log1p(len(every)) / 10)
    return out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


@dataclass
class AttentionModel:
    """Encoder relu(x E + e), attention softmax over w . (tanh(h V) * sigmoid(h U)), score sigmoid(z c + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.maximum(0, x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = (t * g) @ p["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(_sums(a, starts), sizes)
        z = _sums(h * a[:, None], starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s, "sizes": sizes}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x, starts)["s"]

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, starts)
        d = (f["s"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(_sums(f["a"] * da, starts), f["sizes"]))
        dt, dg = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {
            "E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da,
            "c": f["z"].T @ d, "b": d.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> AttentionModel:
    """Learn from bags of passages and their labels (0 or 1). Without both labels the score is constant."""
    if not len(bags) or labels.min() == labels.max():
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(labels.mean()) if len(bags) else 0.5)
    every = np.concatenate(bags)
    rng = np.random.default_rng(seed)
    init = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
    weights = {"E": init(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE) / 2, "U": init(HIDDEN, GATE) / 2, "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    model = AttentionModel(every.mean(0).astype(float), np.maximum(every.std(0), 1e-2).astype(float), weights)
    m, v, step = {k: np.zeros_like(x) for k, x in weights.items()}, {k: np.zeros_like(x) for k, x in weights.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            sizes = np.array([len(bags[k]) for k in pick])
            grad = model.gradient(np.concatenate([bags[k] for k in pick]).astype(float), np.cumsum(sizes) - sizes, labels[pick].astype(float))
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * weights[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                weights[k] -= RATE * (0.5 ** (epoch // 10)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = []
        for t in column(b, "text"):
            bag = passages(raw_text(t))
            bags.append((bag if len(bag) <= MOST_PASSAGES else bag[np.linspace(0, len(bag) - 1, MOST_PASSAGES).astype(int)]).tobytes())
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "quality"), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AttentionModel:
    """Fit on about ``most`` labelled documents at most, never on held-out ids.

    They are those whose hashed doc_id is lowest, so that reruns take the same. Labels that are null
    don't count; of several for a doc_id the mean decides. Of rows that repeat a doc_id one is learned from.
    """
    use = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    use = use.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("quality"))
    (n,) = scalars(use, F.count("*"))
    scale = 1 << 30
    use = use.where(F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(scale)) < F.lit(int(min(1.0, most / max(n, 1)) * scale)))
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(use), F.col("doc_id") == use["label_id"])
    rows = picked.select("doc_id", "quality", "text").mapInArrow(_bags, "doc_id long, quality int, bag binary")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")).collect()  # a bounded number of bounded bags
    rows = sorted((r["doc_id"], bytes(r["bag"]), r["quality"]) for r in rows)
    bags = [np.frombuffer(r[1], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(bags, np.array([r[2] for r in rows], np.int64))


def _scores(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out, bags, size = column(b, "text"), [], [], 0
            for i, t in enumerate(texts):
                bags.append(passages(raw_text(t)))
                size += len(bags[-1])
                if size >= CHUNK or i == len(texts) - 1:
                    sizes = np.array([len(x) for x in bags])
                    out.append(model.score(np.concatenate(bags), np.cumsum(sizes) - sizes))
                    bags, size = [], 0
            keep = [c for c in b.schema.names if c != "quality_score"]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*keep, "quality_score"])

    return run


def score_quality(documents: DataFrame, model: AttentionModel) -> DataFrame:
    """``documents`` with quality_score (0 to 1), from the whole text alone.

    A null or empty text is one empty passage. Every row is scored by itself; a column
    quality_score of the input is replaced, others pass through.
    """
    documents = documents.drop("quality_score")
    return documents.mapInArrow(_scores(model), schema_of(documents, set(), "quality_score double"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    )
