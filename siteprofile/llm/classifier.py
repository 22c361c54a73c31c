"""A quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lloyd
from .common import bound_batches, materialize

#: Bytes of a piece of text that is compressed by itself, of a dictionary, and the level.
PIECE, DICTIONARY, LEVEL = 1024, 112_640, 3
#: Bounds of the sample that is learnt from: documents of a class and bytes of their text for a dictionary, documents for the calibration.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, CALIBRATION = 4_000, 8_000_000, 20_000
#: Weight that holds the calibration's slope finite where a sample separates the classes.
RIDGE = 1e-3


class Model(NamedTuple):
    """The two dictionaries, and the score 1 / (1 + exp(-(base + slope * difference)))."""

    good: bytes
    bad: bytes
    base: float
    slope: float


def pieces(text: bytes) -> Iterator[bytes]:
    """The whole text in consecutive pieces."""
    return (text[i : i + PIECE] for i in range(0, len(text), PIECE))


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    """With a trained dictionary, or, for other bytes, with these as they are."""
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few for that, the samples themselves, the last ones nearest."""
    if sum(map(len, samples)) >= 8 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # samples that have nothing in common
            pass
    return b"\n".join(samples)[-DICTIONARY:]


def difference(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: bytes) -> float:
    """How many bytes fewer the good dictionary needs than the bad one, per byte of the text; 0 for an empty one."""
    fewer = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text))
    return fewer / max(len(text), 1)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; that of an empty text for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def lessons(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and label of the rows to learn from: labels 0 and 1 whose id's remainder is not 1; an id with both labels, or null, teaches nothing."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 1))
    both = own.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("_m"))
    return both.where("label = _m").drop("_m")


def share(n: int, most: int) -> Column:
    """Holds for about most of n ids, or all, by a hash; the same ids in each run."""
    return F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, most / max(n, 1))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of the labelled documents.

    Half of the ids, by a hash, may give text to the dictionaries: about SAMPLE_DOCUMENTS of each label, and of these, in
    the order of another hash, whole texts in pieces until SAMPLE_BYTES. One task a label trains, and the dictionary alone
    comes to the driver. Of the other half about CALIBRATION documents are compared with both dictionaries, and a logistic
    curve is fitted to their differences and labels. The ids of the sample, bounded as above, are broadcast, so the texts
    are read in one scan and not shuffled. Without rows of both labels the score is the share of label 1, and 0.5
    without any; a calibration sample that lacks a label gives the slope that the dictionaries' own sample has.
    """
    taught = materialize(lessons(labels, id_col, label_col).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")), "lessons")
    counts = {(r.label, r.fold): r.n for r in taught.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(v for (label, _), v in counts.items() if label == q) for q in (0, 1)]
    if not n[0] or not n[1]:
        rate = (n[1] + 1e-9) / (n[0] + n[1] + 2e-9)
        return Model(b"", b"", math.log(rate / (1 - rate)), 0.0)
    split = all(counts.get((q, f), 0) for q in (0, 1) for f in (0, 1))  # else both halves serve both ends
    bad, good = (share(counts[q, 0] if split else n[q], SAMPLE_DOCUMENTS) for q in (0, 1))
    teach = ((F.col("fold") == 0) | F.lit(not split)) & F.when(F.col("label") == 1, good).otherwise(bad)
    fit = ((F.col("fold") == 1) | F.lit(not split)) & share(sum(v for (_, f), v in counts.items() if f == 1 or not split), CALIBRATION)
    sample = taught.select("id", "label", teach.alias("teach"), fit.alias("fit")).where("teach OR fit")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    texts = materialize(texts.join(F.broadcast(sample), "id"), "sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces(text.as_buffer().to_pybytes()):
                    if size.get(label, 0) < SAMPLE_BYTES:
                        samples.setdefault(label, []).append(piece)
                        size[label] = size.get(label, 0) + len(piece)
        for label, found in samples.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([dictionary(found)], pa.binary())], ["label", "data"])

    ordered = texts.where("teach").select("label", "text", F.xxhash64("id", F.lit("order")).alias("_o"))
    ordered = ordered.repartition(2, "label").sortWithinPartitions("label", "_o", "text")
    found = {r.label: bytes(r.data) for r in ordered.mapInArrow(learn, "label int, data binary").collect()}
    good, bad = found.get(1, b""), found.get(0, b"")
    own = differences(texts.where("fit").select(F.col("label").alias("keep"), "text"), good, bad).collect()
    pairs = sorted((r.difference, float(r.keep)) for r in own)  # sums of floats in one order, so reruns agree
    return Model(good, bad, *logistic(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Base and slope of the logistic curve, by Newton's steps; 0 and 1 where there is nothing to fit."""
    if not len(x):
        return 0.0, 1.0
    mid, wide = float(x.mean()), float(x.std()) or 1.0
    a = np.column_stack([np.ones(len(x)), (x - mid) / wide])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(2), a.T @ (y - p) - RIDGE * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] - w[1] * mid / wide), float(w[1] / wide)


def differences(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """keep, difference of rows keep, text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = compressor(good), compressor(bad)
        for batch in batches:
            found = [difference(*both, x.as_buffer().to_pybytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["keep", "difference"])

    return rows.mapInArrow(run, lloyd.schema(rows, ["keep"], "difference double"))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """row (the columns keep, or all) and score, between 0 and 1: how likely a text has label 1.

    The whole text is cut into pieces of PIECE bytes, each compressed with either dictionary, so that the dictionary and not
    the text before decides; the difference of the sums, per byte, goes through the calibrated curve. Texts are read
    once and nothing is shuffled. Null and empty texts have difference 0 and the curve's score there. Repeated rows are
    scored each; an empty table gives no rows; a very long text is worked on piece by piece. Clashing columns stay inside row.
    """
    bound_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("keep"), text.alias("text"))
    found = differences(rows, model.good, model.bad)
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(model.base) + F.lit(model.slope) * F.col("difference")))
    return found.select(F.col("keep").alias("row"), (1 / (1 + F.exp(-power))).alias("score"))
