"""Toxicity scores from a character n-gram linear classifier (operator 1).

Features are the distinct 3- to 5-character strings of the lower-cased whole
text, hashed to a fixed number of places.  Each is scaled by its naive Bayes
log-count ratio between toxic and other training documents, and a logistic
model is fitted on the scaled features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bound_batches, crc_fold

BITS = 18
SIZES = (3, 4, 5)
TRAIN_ROWS = 2000  # rows of each class that the model is fitted on at most
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """Distinct hashed n-grams of texts; one scratch array serves all texts of a worker."""

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
        self.bits, self.sizes = bits, sizes
        self.last = np.zeros(1 << bits, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        chars = f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(chars, np.uint32).astype(np.uint64) + np.uint64(1)
        out, h = [], c * _A
        for n in range(2, max(self.sizes) + 1):
            h = (h[:-1] ^ c[n - 1:]) * _A
            h = h ^ (h >> np.uint64(29))
            if n in self.sizes:
                out.append(((h * _B) >> np.uint64(64 - self.bits)).astype(np.int32))
            if len(h) < 2:
                break
        places = np.concatenate(out) if out else np.zeros(0, np.int32)
        order = np.arange(len(places), dtype=np.int32)
        self.last[places] = order  # the last writer of a place stands for it
        return places[self.last[places] == order]


def class_counts(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Rows of each class (0, 1) in which each place occurs, a few hundred rows at a time."""
    out = np.zeros((2, size))
    for c in (0, 1):
        mine = np.flatnonzero(y == c)
        for a in range(0, len(mine), 200):
            out[c] += np.bincount(np.concatenate([rows[i] for i in mine[a:a + 200]]), minlength=size)
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, weight: dict[int, float], bits: int = BITS, l2: float = 0.02,
        steps: int = 200, alpha: float = 1.0, noise: float = 3.0) -> tuple[np.ndarray, float]:
    """(weight per place with the ratio folded in, intercept) of the logistic model, by Nesterov's gradient method.

    ``weight`` is what a row of each class counts for.  A row is its distinct
    places over the root of their number, so long texts do not outweigh short
    ones.  Places whose ratio is within ``noise`` standard errors of 0 carry
    no sign of either class and are left out.  Without both classes the
    intercept alone tells the share of the only class.
    """
    size = 1 << bits
    per_row = np.array([weight[int(c)] for c in y], float)
    total = per_row.sum()
    share = float(np.clip((y * per_row).sum() / max(total, 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    if not len(y) or y.min() == y.max():
        return np.zeros(size), float(np.log(share / (1 - share)))
    counts = class_counts(rows, y, size)
    q, p = (alpha + weight[c] * counts[c] for c in (0, 1))
    ratio = np.log(p / (alpha + weight[1] * (y == 1).sum())) - np.log(q / (alpha + weight[0] * (y == 0).sum()))
    firm = np.abs(ratio) >= noise * np.sqrt(1 / (alpha + counts[0]) + 1 / (alpha + counts[1]))
    norm = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    rows = [r[firm[r]] for r in rows]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    used, places = np.unique(np.concatenate(rows), return_inverse=True)
    if not len(used):
        return np.zeros(size), float(np.log(share / (1 - share)))
    value = ratio[used[places]] * np.repeat(norm, np.diff(ends))
    value, places = np.append(value, 0.0), np.append(places, 0).astype(np.int32)  # an empty last row stays in range
    cut, weight = ends[:-1], per_row

    def forward(w: np.ndarray) -> np.ndarray:
        s = np.add.reduceat(w[places] * value, cut)
        s[np.diff(ends) == 0] = 0
        return s

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for a in range(0, len(y), 500):  # pieces keep the work arrays small
            b = min(len(y), a + 500)
            i, j = ends[a], ends[b]
            out += np.bincount(places[i:j], value[i:j] * np.repeat(e[a:b], np.diff(ends[a:b + 1])), len(used))
        return out

    x = np.ones(len(used))  # largest squared singular value, by power iteration
    for _ in range(6):
        x = back(weight * forward(x / np.linalg.norm(x)))
    lip = 0.25 * (np.linalg.norm(x) + total) / total + l2 / total
    w, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = weight * (1 / (1 + np.exp(-(forward(vw) + vb))) - y) / total
        nw, nb = vw - (back(e) + l2 / total * vw) / lip, vb - e.sum() / lip
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    full = np.zeros(size)
    full[used] = w * ratio[used]
    return full, b


def predict(grams: Grams, w: np.ndarray, b: float, texts: list[str | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        g = grams.of(t)
        out[i] = b + (w[g].sum() / np.sqrt(len(g)) if len(g) else 0.0)
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS, folds: int = 4, held_out: int = 2) -> tuple[np.ndarray, float]:
    """The model from labelled texts outside the held-out fold (crc32 of the id modulo ``folds``).

    At most ``rows`` texts of each class, those with the lowest id hashes, are
    used; each stands for its share of its class, so scores follow the class
    shares of all labels that name a row of ``docs``.  An id labelled twice takes the larger label, an id
    with several texts the smallest text; null ids and labels are left out.
    """
    spark = docs.sparkSession
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
             .where(crc_fold("_id", folds) != held_out)
             .join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for y in (0, 1):
        one = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        sample = one if sample is None else sample.unionAll(one)
    kind = known.schema["_id"].dataType.simpleString()
    ids = spark.createDataFrame([tuple(r) for r in sample.collect()], f"_id {kind}, _y int")  # 2 * rows at most

    def features(batches):
        grams = Grams()
        for b in batches:
            places = [grams.of(t).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(places, pa.binary())], ["_y", "_places"])

    texts = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
             .join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")))
    got = sorted((r["_y"], bytes(r["_places"])) for r in texts.mapInArrow(features, "_y int, _places binary").collect())
    y = np.array([g[0] for g in got], float)
    weight = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    return fit([np.frombuffer(g[1], np.int32) for g in got], y, weight)


def score(docs: DataFrame, model: tuple[np.ndarray, float], carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns as one struct ``row``, and ``score``, the model's probability of the whole text."""
    bound_batches(docs.sparkSession)
    w, b = model[0].astype(np.float32), model[1]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("_text"))

    def run(batches):
        grams, wide = Grams(), w.astype(np.float64)
        for x in batches:
            p = predict(grams, wide, b, x.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([x.column("row"), pa.array(p)], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """id, held_out, score, predicted (1 if score >= ``threshold``) for every row.

    Null texts are empty and score the model's intercept.  Repeated rows and
    null ids are scored like any other.  With no usable label the score is the
    lowest class share the model knows; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, folds=folds, held_out=held_out)
    fold = (crc_fold("_id", folds) == held_out).alias("held_out")
    return (score(docs, model, [id_col], text_col).select(F.col(f"row.`{id_col}`").alias("_id"), "score")
            .select(F.col("_id").alias(id_col), fold, "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns unchanged."""
    model = train(docs, labels, **options)
    text_col = options.get("text_col", "text")
    return score(docs, model, docs.columns, text_col).where(F.col("score") < threshold).select("row.*")
