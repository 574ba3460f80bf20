"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import broadcast_value, id_remainder, mixed, pieces_of, saved, with_columns, word_hashes

#: Labelled documents that are used of each label at most, those whose hashed ids are smallest: the bound of the
#: sample, and with DIMS of what is broadcast (2 * SAMPLE * (DIMS + 1) + TERMS * DIMS numbers).
SAMPLE = 1500
#: Length of a latent vector; neighbours that vote.
DIMS, NEIGHBOURS = 48, 25
#: Terms: hashed trigrams of character classes, hashed words, and words that repeat the one before.
SHAPES, WORDS = 2048, 1024
TERMS = SHAPES + WORDS + 1
#: How the three kinds weigh in a document's vector.
WEIGHTS = (1.0, 0.3, 1.0)
#: Bytes and rows of texts whose term counts are held at once.
STEP, ROWS = 1_000_000, 500


def _class(code: int) -> int:
    if code < 128 and not chr(code).isalnum():
        return 32 if chr(code).isspace() and code != 10 else code  # signs stand for themselves
    kind = unicodedata.category(chr(code))
    return ord({"Lu": "A", "Ll": "a"}.get(kind, {"L": "L", "N": "0", "P": "P", "Z": " "}.get(kind[0], "S")))


_CLASSES = np.array([_class(c) for c in range(1 << 16)], np.uint64)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the terms, a row for each text; null as empty."""
    texts = [t or "" for t in texts]
    lengths = np.array([len(t) for t in texts])
    chars = _CLASSES[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), (1 << 16) - 1)]
    row = np.repeat(np.arange(len(texts)), lengths)
    same = row[2:] == row[:-2]
    with np.errstate(over="ignore"):
        grams = (mixed(chars[:-2] << np.uint64(16) | chars[1:-1] << np.uint64(8) | chars[2:]) >> np.uint64(64 - 11)).astype(np.int64) if len(chars) > 2 else np.zeros(0, np.int64)
    out = np.bincount((row[:-2] * TERMS + grams)[same], minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    for k, t in enumerate(texts):
        words = word_hashes(t.encode("utf-8", "replace"))
        out[k, SHAPES : SHAPES + WORDS] = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=WORDS)
        out[k, -1] = (words[1:] == words[:-1]).sum()
    return out


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Roots of relative frequencies by kind of term, so that the length of a text doesn't matter."""
    words = np.maximum(counts[:, SHAPES:-1].sum(axis=1, keepdims=True), 1)
    shapes = np.maximum(counts[:, :SHAPES].sum(axis=1, keepdims=True), 1)
    parts = (counts[:, :SHAPES] / shapes, counts[:, SHAPES:-1] / words, counts[:, -1:] / words)
    return np.concatenate([w * np.sqrt(p) for w, p in zip(WEIGHTS, parts, strict=True)], axis=1).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x DIMS
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    prior: float
    weights: np.ndarray  # what a vote counts: labelled documents of its label for each in the sample

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (_frequencies(counts) * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest labelled documents, weighted by similarity and by the label's rows for each sampled one; the prior where none is similar."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = self.embed(term_counts(texts)) @ self.vectors.T  # exact cosines with all labelled documents
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        # The eighth power lets the closest of the neighbours decide.
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** 8 * self.weights[at]
        total = weight.sum(axis=1)
        voted = (weight * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(voted, 0, 1), self.prior)


def fit_vectors(counts, labels: np.ndarray, rows: dict[int, int] | None = None) -> Model:
    """Latent-semantic axes by a randomised SVD of the weighted term frequencies; the seed is fixed.

    counts: dense term counts, or anything whose slices are such. rows: how many labelled documents of each label
    there are, where labels is a sample of them.
    """
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 1.0, labels)
    x, holding = np.empty((len(labels), TERMS), np.float32), np.zeros(TERMS, np.int64)
    for k in range(0, len(x), ROWS):  # in steps, so that the driver needs little more than x
        part = counts[k : k + ROWS]
        holding += (part > 0).sum(axis=0)
        x[k : k + ROWS] = _frequencies(part)
    idf = (np.log((1 + len(labels)) / (1 + holding)) + 1).astype(np.float32)
    x *= idf
    q = np.random.default_rng(0).standard_normal((TERMS, DIMS + 16)).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :DIMS]
    weights = np.ones(len(labels))
    for label, n in (rows or {}).items():
        weights[labels == label] = n / max(1, (labels == label).sum())
    prior = float((weights * labels).sum() / weights.sum())
    axes = axes.astype(np.float32)
    vectors = x @ axes
    return Model(idf, axes, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), labels.astype(np.float64), prior, weights)


class _Sparse:
    """Rows of terms and their counts; slices are dense."""

    def __init__(self, terms: pa.ChunkedArray, counts: pa.ChunkedArray):
        self.terms, self.counts = terms, counts

    def __getitem__(self, at: slice) -> np.ndarray:
        terms, counts = self.terms[at], self.counts[at]
        out = np.zeros((len(terms), TERMS), np.int32)
        for row, term, n in zip(out, terms, counts, strict=True):
            row[term.values.to_numpy()] = n.values.to_numpy()
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """Rows doc_id, text, label: at most per_label of each label; and how many ids have each label. An id labelled both ways is left out."""
    docs = docs.select("doc_id", "text")
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    one = one.filter(F.col("label") == F.col("most")).filter(train)
    ids = saved(docs.select("doc_id").distinct().join(one, "doc_id").select("doc_id", "label"), "labelled")
    rows = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}  # two at most
    chosen = [ids.filter(F.col("label") == v).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(per_label) for v in (0, 1)]
    wanted = chosen[0].unionAll(chosen[1])
    found = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "label")  # wanted: 2 * per_label rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), rows


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = SAMPLE) -> Model:
    def counted(batches):
        for ids, texts, label in pieces_of(batches, ["doc_id", "text", "label"], "text", STEP, ROWS):
            c = term_counts(texts)
            cells = [np.flatnonzero(r) for r in c]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array([r[x] for r, x in zip(c, cells, strict=True)], pa.list_(pa.int32()))], names=["doc_id", "label", "term", "n"])

    sample, rows = labelled_sample(docs, labels, train, per_label)
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    got = sample.mapInArrow(counted, "doc_id long, label int, term array<int>, n array<int>").toArrow().sort_by("doc_id")  # the rows come in no set order
    return fit_vectors(_Sparse(got["term"], got["n"]), got["label"].to_numpy().astype(float), rows)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns with score double (0 to 1, higher: label 1 likelier) and predicted int (1 from 0.5 on).

    Null and empty texts, which resemble nothing, get the share of label 1 in all labelled rows, as all texts do
    where nothing is labelled (then 1.0). Columns of docs named score or predicted are replaced.
    """
    rows = docs.drop("score", "predicted")
    shared = broadcast_value(docs.sparkSession, model)

    def scored(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            one = pa.RecordBatch.from_arrays([text], names=["t"])
            score = np.concatenate([shared.value.score(t) for (t,) in pieces_of([one], ["t"], "t", STEP, ROWS)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(scored, with_columns(rows.schema, "score double, predicted int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows whose crc32(doc_id) modulo 3 isn't 1."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return classify(rows, model).drop("text")
