"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, extended, steps, table, text_bytes, tidied, uniform

#: Bytes of a passage, hashed byte-pair features beside 256 byte features, units of the encoder and of the gate.
PASSAGE, PAIRS, HIDDEN, GATE = 512, 256, 24, 16
#: A score from which a document counts as good.
GOOD = 0.3


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages that cover each text from start to end (one of zeros for an empty text), and passages per text.

    A passage's features are the square roots of the shares of its bytes and of its hashed byte pairs, the share of
    distinct eight-byte pieces, and its length.
    """
    lengths = np.diff(offsets)
    number = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(number) - number
    n = int(number.sum())
    text = data[offsets[0] : offsets[-1]].astype(np.int64)
    inside = np.arange(len(text)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    owner = np.repeat(first, lengths) + inside // PASSAGE
    size = np.bincount(owner, minlength=n).astype(np.float32)
    out = np.zeros((n, 256 + PAIRS + 2), np.float32)
    out[:, :256] = np.bincount(owner * 256 + text, minlength=n * 256).reshape(n, 256)
    if len(text) > 1:
        same = owner[1:] == owner[:-1]
        pair = ((text[:-1] * 256 + text[1:]) * 40503 >> 5) & (PAIRS - 1)
        out[:, 256 : 256 + PAIRS] = np.bincount((owner[1:] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS)
    if len(text) >= 8:
        piece = text[: len(text) - 7].copy()
        for k in range(1, 8):
            piece = piece * 0x100000001B3 + text[k : len(text) - 7 + k]
        whole = owner[7:] == owner[: len(text) - 7]
        key = np.sort((owner[: len(text) - 7] << 20 | (piece * -7046029254386353131 >> 44 & 0xFFFFF))[whole])
        distinct = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        out[:, -2] = np.bincount(distinct >> 20, minlength=n) / np.maximum(1, np.bincount(key >> 20, minlength=n))
    out[:, : 256 + PAIRS] = np.sqrt(out[:, : 256 + PAIRS] / np.maximum(size, 1)[:, None])
    out[:, -1] = size / PASSAGE
    return out, number


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class GatedAttention:
    """h = tanh(x W + b); a = softmax over a document of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum(a h) c + d)."""

    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        first = np.cumsum(number) - number
        h = np.tanh(x @ self.W + self.b)
        v, u = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        s = (v * u) @ self.w
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), number))
        a = e / np.repeat(np.add.reduceat(e, first), number)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ self.c + self.d[0])}


def train(x: np.ndarray, number: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> GatedAttention:
    """Adam on the log loss of documents (``number`` passages each, in order)."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    net = GatedAttention(draw(x.shape[1], HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    net.d[0] = np.log(share / (1 - share))
    names = ("W", "b", "V", "U", "w", "c", "d")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    start = np.cumsum(number) - number
    t = 0
    for _ in range(epochs):
        order = random.permutation(len(number))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            n = number[docs]
            rows = np.repeat(start[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            xs = x[rows]
            f = net.forward(xs, n)
            first = np.cumsum(n) - n
            dp = ((f["p"] - y[docs]) / len(docs)).astype(np.float32)
            dz = np.repeat(dp[:, None] * net.c, n, axis=0)
            da = (dz * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), n))
            dvu = ds[:, None] * net.w
            dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
            dh = (dz * f["a"][:, None] + dv @ net.V.T + du @ net.U.T) * (1 - f["h"] ** 2)
            grads = {"c": f["z"].T @ dp, "d": dp.sum(keepdims=True), "w": (f["v"] * f["u"]).T @ ds, "V": f["h"].T @ dv, "U": f["h"].T @ du, "W": xs.T @ dh + decay * net.W, "b": dh.sum(axis=0)}
            t += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                value = getattr(net, k)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, usable=None, most: int = 4000, most_passages: int = 24, seed: int = 3) -> GatedAttention | None:
    """A network learned from ``labels.quality`` of at most ``most`` documents, drawn by a hash of doc_id; None without labelled documents.

    Of a sampled document longer than ``most_passages`` passages, as many evenly spaced ones are learned from. Null
    labels and ids are left out, and so are ids whose labels differ; a document with several rows counts once each.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    if usable is not None:
        marked = marked.where(usable(F.col("k")))
    share = min(1.0, (1.5 * most + 100) / max(1, marked.count()))  # what can be in the sample: only that goes to the driver
    marked = marked.where(uniform(seed, "k") <= share).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi")
    marked = marked.orderBy(uniform(seed, "k"), "k").limit(most).select("k", "y")
    span = PASSAGE * most_passages
    text = F.col("text").cast("string").cast("binary")
    gap = F.greatest(F.floor(F.octet_length("b") / F.lit(span)), F.lit(1)) * PASSAGE
    pieces = F.transform(F.sequence(F.lit(0), F.lit(most_passages - 1)), lambda i: F.col("b").substr((i * gap).cast("int") + 1, F.lit(PASSAGE)))
    got = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(text, F.lit(b"")).alias("b")).join(F.broadcast(marked), "k")
    got = got.select("k", "y", F.when(F.octet_length("b") <= span, F.array("b")).otherwise(pieces).alias("w")).orderBy(uniform(seed, "k"), "k", "w").limit(most).collect()
    if not got:
        return None
    y = np.array([r["y"] for r in got], np.float32)
    data, offsets = text_bytes(pa.array([b"".join(r["w"]) for r in got], pa.binary()))
    del got
    x, number = zip(*(passages(data, offsets[i : j + 1]) for i, j in steps(offsets, 1 << 19)))
    return train(np.concatenate(x), np.concatenate(number), y)


def score(docs: DataFrame, net: GatedAttention | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, score (that label 1 is likelier) and predicted (1 from GOOD on).

    Every byte of a text lies in one passage. A null or empty text is a document of one empty passage. Without a
    network every score is 0.5. Repeated rows get equal scores, other columns are ignored or kept as they are, and an
    empty table gives an empty result.
    """
    taken = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = extended(docs.select(*keep), "score double, predicted int")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            p = np.full(len(offsets) - 1, 0.5)
            for i, j in steps(offsets, 1 << 20) if net else ():
                p[i:j] = net.forward(*passages(data, offsets[i : j + 1]))["p"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= GOOD).astype(np.int32))], [*keep, "score", "predicted"])

    return taken.mapInArrow(tidied(work), schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``, learned from labels where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"), lambda k: crc_bucket(k, 5) != 0)
    return score(docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))), net, ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is GOOD or more.

    Learned from the labels of the documents that came in; without any, all score 0.5 and stay. Null and empty texts are
    scored as a document of one empty passage; repeated rows stay repeated; columns are kept as they are; an empty table
    stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are called
    return score(rows, fit(docs, table(spark, sf_dir, "labels")), ["row"]).where(F.col("predicted") == 1).select("row.*")
