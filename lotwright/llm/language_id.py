"""Language ID: a byte convolutional network trained in numpy and applied to batched fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, extended, steps, table, text_bytes, tidied, uniform

#: Bytes of a window, of the embedding of a byte, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
SPAN = max(WIDTHS)


@dataclass
class ByteConvNet:
    """Byte embedding, filters of several widths, max pooling over the window, softmax over ``labels``."""

    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # SPAN * EMBED x filters; rows past a filter's width are zero
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        e = self.embed[windows]
        n = windows.shape[1] - SPAN + 1
        return np.lib.stride_tricks.sliding_window_view(e.reshape(len(e), -1), SPAN * EMBED, axis=1)[:, :: EMBED][:, :n]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each label for each row of ``windows`` (uint8, zero padded)."""
        x = np.ascontiguousarray(self.patches(windows)).reshape(-1, SPAN * EMBED) @ self.filters
        pooled = np.maximum(x.reshape(len(windows), -1, x.shape[1]).max(axis=1) + self.bias, 0)
        return _softmax(pooled @ self.dense + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Adam on the cross-entropy of labelled windows."""
    random = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    width = np.repeat(WIDTHS, FILTERS)
    mask = (np.arange(SPAN * EMBED)[:, None] // EMBED < width[None, :]).astype(np.float32)
    net = ByteConvNet(
        names,
        random.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (random.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(len(width), np.float32),
        random.normal(0, 0.1, (len(width), len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(getattr(net, k)) for _ in "mv"] for k in ("embed", "filters", "bias", "dense", "offset")}
    t = 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            w = windows[rows]
            patches = net.patches(w)
            x = np.ascontiguousarray(patches).reshape(-1, SPAN * EMBED) @ net.filters
            x = x.reshape(len(w), -1, x.shape[1])
            top = x.argmax(axis=1)  # rows x filters
            raw = np.take_along_axis(x, top[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            slope = _softmax(pooled @ net.dense + net.offset)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = (slope @ net.dense.T) * (raw > 0)
            chosen = patches[np.arange(len(w))[:, None], top]  # rows x filters x SPAN * EMBED
            grads = {
                "dense": pooled.T @ slope,
                "offset": slope.sum(axis=0),
                "bias": back.sum(axis=0),
                "filters": np.einsum("rf,rfk->kf", back, chosen) * mask,
                "embed": np.zeros_like(net.embed),
            }
            spread = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            met = w[np.arange(len(w))[:, None, None], top[:, :, None] + np.arange(SPAN)]
            np.add.at(grads["embed"], met.reshape(-1), spread)
            t += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value = getattr(net, k)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows that cover each text from its start to its end, zero padded, and their number for each text (1 at least)."""
    lengths = np.diff(offsets)
    number = np.maximum(1, -(-lengths // size))
    first = np.cumsum(number) - number
    which = np.arange(int(number.sum())) - np.repeat(first, number)
    start = np.repeat(offsets[:-1], number) + which * size
    left = np.clip(np.repeat(offsets[1:], number) - start, 0, size)
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < left[:, None]
    padded = np.zeros(at.shape, np.uint8)
    padded[inside] = data[at[inside]]
    return padded, number


def fit(docs: DataFrame, usable: F.Column | None = None, most: int = 4000, most_labels: int = 1000, seed: int = 11) -> ByteConvNet | None:
    """A network learned from text and lang of at most ``most`` documents; None without any labelled text.

    The sample is drawn by a hash of doc_id with weights that even out the languages; of each sampled document one
    window, at a place drawn by the same hash, is learned from. Rows without text, lang or doc_id are left out. More
    than ``most_labels`` different labels raise an error: they would not fit a softmax, and none is dropped.
    """
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(F.col("doc_id").alias("k"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("b"))
    rows = rows.where("k IS NOT NULL AND lang IS NOT NULL AND octet_length(b) > 0")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    start = F.floor(uniform(seed + 1, "k") * F.greatest(F.octet_length("b") - WINDOW + 1, F.lit(1))).cast("int") + 1
    drawn = rows.select("lang", (-F.log(uniform(seed, "k"))).alias("u"), "k", F.expr("b").substr(start, F.lit(WINDOW)).alias("w"))
    sizes = {r["lang"]: r["n"] for r in counts.orderBy("lang").limit(most_labels + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} languages")
    # u * n is exponential with mean n: so many rows of a language are expected under a bound; only those go to the driver
    n, low, high = np.array([*sizes.values()], float), 0.0, 64.0 * max(sizes.values())
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * -np.expm1(-middle / n)).sum() < 1.5 * most + 100 else (low, middle)
    weight = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("lang")]
    drawn = drawn.select("lang", "w", (F.col("u") * weight).alias("u"), "k").where(F.col("u") <= high)
    got = drawn.orderBy("u", "k", "w").limit(most).select("lang", "w").collect()
    padded = np.zeros((len(got), WINDOW), np.uint8)
    for row, r in zip(padded, got):
        row[: len(r["w"])] = np.frombuffer(bytes(r["w"]), np.uint8)
    return train(padded, [r["lang"] for r in got])


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score: the label of the highest mean probability over all windows.

    Every byte of a text lies in one window. A null text or one without a letter gives ``und`` and score 0, and so
    does every text when there is no network. Ties go to the first label in order. Repeated rows get equal results,
    columns of any other names are ignored or kept as they are, and an empty table gives an empty result.
    """
    taken = docs.select(*keep, F.col("text").cast("string").alias("_text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = extended(docs.select(*keep), "lang_pred string, score double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            label, score = np.full(len(letters), -1), np.zeros(len(letters))
            for i, j in steps(offsets, 1 << 19) if net else ():
                windows, number = windows_of(data, offsets[i : j + 1], WINDOW)
                p = np.concatenate([net.probabilities(windows[k : k + 1024]) for k in range(0, len(windows), 1024)])
                first = np.cumsum(number) - number
                mean = np.add.reduceat(p.astype(np.float64), first, axis=0) / number[:, None]
                label[i:j], score[i:j] = mean.argmax(axis=1), mean.max(axis=1)
            label[~letters], score[~letters] = -1, 0.0
            names = [*(net.labels if net else ()), "und"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([names[k] for k in label], pa.string()), pa.array(np.clip(score, 0, 1))], [*keep, "lang_pred", "score"]
            )

    return taken.mapInArrow(tidied(work), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    net = fit(docs, ~held_out)
    return predict(docs.withColumn("held_out", held_out), net, ["doc_id", "held_out"])


#: A document's mean probability under which the pipeline takes its language as unknown.
LEAST = 0.35


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network recognises: not ``und``, mean probability LEAST or more.

    Learned from all rows with a label. Columns are kept as they are, whatever they are called; null texts and texts
    without a letter go; repeated rows stay repeated; without any label no document is recognised; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are called
    return predict(rows, fit(docs), ["row"]).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST)).select("row.*")
