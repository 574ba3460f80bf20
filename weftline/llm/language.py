"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_remainder, pieces_of, with_columns

#: Lengths of the n-grams.
ORDERS = (1, 2, 3)
#: Buckets are 2 to this power. Languages at most: the matrix takes 128 KB of the broadcast for each, 128 MB in all.
BITS, LANGUAGES = 15, 1000
#: Added to every count.
SMOOTHING = 0.1
STEP = 2_000_000

_LETTER = regex.compile(r"\p{L}")
#: Code points below 128: letters in lower case, all other signs as a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def gram_buckets(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram at each character; and where each text begins.

    Every text is followed by end marks, so its buckets don't depend on its neighbours.
    """
    most = max(ORDERS)
    lengths = np.array([len(t) for t in texts])
    chars = np.frombuffer(("".join(t + "\0" * (most - 1) for t in texts) + "\0" * most).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = chars < 128
    chars[low] = _FOLD[chars[low]]
    starts = np.concatenate([[0], np.cumsum(lengths + most - 1)])
    for k in range(1, most):
        chars[starts[1:] - k] = 1
    chars[starts[-1] :] = 1
    out, h = [], chars.astype(np.uint64)
    for n in range(1, most + 1):
        if n > 1:
            with np.errstate(over="ignore"):
                h = h[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in ORDERS:
            with np.errstate(over="ignore"):
                out.append((((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32))
    return out, starts


def fit(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, log-probabilities by language and bucket (with the prior in the last column).

    Counts all documents for which the column train holds and language and text aren't null. The counts come
    to the driver summed, 2**BITS for each language at most. More than LANGUAGES languages raise a ValueError.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(totals)
    at = {x: k for k, x in enumerate(langs)}

    def counted(batches):
        counts: dict[str, np.ndarray] = {}
        for each, texts in pieces_of(batches, ["lang", "text"], "text", STEP):
            for lang in set(each):
                buckets, starts = gram_buckets([t for x, t in zip(each, texts, strict=True) if x == lang], BITS)
                inside = np.ones(starts[-1], bool)
                for k in range(1, max(ORDERS)):
                    inside[starts[1:] - k] = False
                total = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for b in buckets:
                    total += np.bincount(b[: len(inside)][inside], minlength=1 << BITS)
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at[lang])), pa.array(used), pa.array(n[used])], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(counted, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    model = np.full((len(langs), (1 << BITS) + 1), SMOOTHING)
    model[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    model[:, :-1] = np.log(model[:, :-1] / model[:, :-1].sum(axis=1, keepdims=True))
    model[:, -1] = np.log([totals[x] / sum(totals.values()) for x in langs])
    return langs, model.astype(np.float32)


def _scored(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    able = [k for k, t in enumerate(texts) if t and langs and _LETTER.search(t)]
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if able:
        buckets, starts = gram_buckets([texts[k] for k in able], BITS)
        # From each text's begin to its end marks, and from there to the next text: every second sum is a text's.
        cuts = np.stack([starts[:-1], starts[1:] - max(ORDERS) + 1], axis=1).ravel()
        sums = np.empty((len(langs), len(able)))
        for k, w in enumerate(table):
            sums[k] = w[-1]
            for b in buckets:
                sums[k] += np.add.reduceat(w[b], cuts, dtype=np.float64)[::2]
        share = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
        for k, best, s in zip(able, sums.argmax(axis=0), share, strict=True):
            lang[k], score[k] = langs[best], s
    return lang, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs' columns with lang_pred and score, the probability of lang_pred among the languages learned.

    `und` with score 0 for a null text, one without a letter, or where nothing was learned. Of languages
    that are equally likely the first in order of names is taken. A column of docs named lang_pred or
    score is replaced.
    """
    langs, table = model
    rows = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scored(batches):
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], names=["t"])
            done = [_scored(t, langs, shared.value) for (t,) in pieces_of([one], ["t"], "t", STEP)]
            lang, score = pa.array([x for d, _ in done for x in d], pa.string()), pa.array([x for _, d in done for x in d], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(scored, with_columns(rows.schema, "lang_pred string, score double"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(doc_id) modulo 3 isn't 1 (a null id's isn't)."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
