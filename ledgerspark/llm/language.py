"""Language ID with blended-spectrum string kernels.

Two texts are alike by the character n-grams (of one to ``orders`` characters) that both contain, over the geometric mean of their
own counts. Landmark texts span the Nyström features, kernel ridge regression is fitted one language against the rest, and
texts are scored in batches as products of a presence matrix with landmark and class weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import stored, text_hash, unused

#: n-gram hashes are taken to so many bits; two n-grams may share a number.
HASH_BITS = 18
_SIZE = 1 << HASH_BITS
#: Parts of a language in which training documents are ranked first.
SALTS = 64
#: Landmarks of all languages together; texts that are scored at a time; rows of weights summed at a time; tasks that sum the normal equations.
MOST_LANDMARKS, BATCH, ROWS, TASKS = 512, 64, 4096, 8
#: Bytes of weights up to which landmarks are folded into n-gram weights, and those of a model that may be broadcast.
FOLD_BYTES, BROADCAST_BYTES = 256 << 20, 1 << 30


@dataclass(frozen=True)
class Model:
    """Fitted classifier. Rows of ``basis`` are n-grams (``slot`` finds them, the last row is for all others); their sum over a text, times
    ``mix`` if there is one, gives class scores."""

    classes: list[str]
    slot: np.ndarray
    basis: np.ndarray
    mix: np.ndarray | None
    orders: int


def grams(text: str, orders: int, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-grams present in the whole text, letters lower-cased. ``seen``: all-false scratch array."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    code = np.zeros(len(points), np.uint64)
    for n in range(1, orders + 1):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] if n > 1 else code) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        mixed = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        seen[(mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def in_training(doc_id: Column) -> Column:
    """Documents that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def training_sample(docs: DataFrame, per_class: int, orders: int) -> DataFrame:
    """``(lang, doc_id, text_key, grams)`` of at most ``per_class`` labelled texts of each language, those of the lowest hashes of id and text.

    Rows are told apart by id, text and language, so one id with many texts brings no more than any other, and rows repeated whole count
    once. Only hashes are ranked; the texts of the sample are read whole on executors and never leave them.
    """
    usable = in_training(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text"))
    key = ["lang", "doc_id", "text_key"]
    rows = docs.where(usable).select(F.col("lang").cast("string").alias("lang"), "doc_id", text_hash().alias("text_key"), "text")
    lowest = [F.xxhash64("doc_id", "text_key"), F.col("doc_id"), F.col("text_key")]
    ids = rows.select(*key).distinct().withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)))
    # First within parts of a language, then among what those leave: a frequent language is not in one task.
    for group in (["lang", "salt"], ["lang"]):
        best = Window.partitionBy(*group).orderBy(*lowest)
        ids = ids.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_class).drop("rank")
    picked = stored(ids.select(*key), "training-ids")  # its size is known then, so texts need no shuffle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_SIZE, bool)
        for batch in batches:
            made = [grams(t.as_py(), orders, seen).astype(np.int32) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int32()))], [*key, "grams"])

    schema = f"lang string, doc_id {dict(docs.dtypes)['doc_id']}, text_key long, grams array<int>"
    made = rows.join(picked, key, "left_semi").mapInArrow(run, schema).dropDuplicates(key)
    return stored(made, "training-grams")


def overlaps(basis: np.ndarray, slot: np.ndarray, texts: list[np.ndarray], kind=np.float64) -> np.ndarray:
    """Sums of the rows of ``basis`` over the n-grams of each text, taken ``ROWS`` at a time."""
    out = np.zeros((len(texts), basis.shape[1]), kind)
    for k, found in enumerate(texts):
        rows = slot[found]
        for at in range(0, len(rows), ROWS):
            out[k] += basis[rows[at : at + ROWS]].sum(axis=0, dtype=kind)
        out[k] /= np.sqrt(max(1, len(rows)))
    return out


def presence(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(slot, basis)``: which landmark has which n-gram; a row of zeros stands for n-grams that none has."""
    used = np.unique(np.concatenate(marks))
    slot = np.full(_SIZE, len(used), np.int64)
    slot[used] = np.arange(len(used))
    basis = np.zeros((len(used) + 1, len(marks)), np.uint8)
    for k, g in enumerate(marks):
        basis[slot[g], k] = 1
    return slot, basis


def fit(sample: DataFrame, landmarks: int, ridge: float, orders: int, most_landmarks: int = MOST_LANDMARKS) -> Model | None:
    """Nyström features over landmark texts of the languages, kernel ridge regression one against the rest on all of the sample.

    Executors make the features and sum the normal equations: a square matrix from each of ``TASKS`` tasks, and for each language the sum of its
    features. ``landmarks`` texts a language are landmarks, fewer if that were over ``most_landmarks``; every language is learned in any case.
    """
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not counts:
        return None
    classes = sorted(counts)
    each = max(1, min(landmarks, most_landmarks // len(classes)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key")
    chosen = sample.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each).orderBy("rank", "lang").limit(most_landmarks)
    marks = [np.array(r["grams"], np.int64) for r in chosen.select("grams").collect()]
    slot, basis = presence(marks)
    norm = np.sqrt([max(1, len(g)) for g in marks])
    values, vectors = np.linalg.eigh(overlaps(basis, slot, marks) / norm)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    total = sum(counts.values())
    balance = {c: total / len(classes) / n for c, n in counts.items()}
    shared = sample.sparkSession.sparkContext.broadcast((slot, basis, norm, root, balance))  # at most 2 ** HASH_BITS x most_landmarks bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, basis, norm, root, balance = shared.value
        square = np.zeros(root.shape)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(langs), BATCH):
                own = [np.asarray(texts[k].values, np.int64) for k in range(at, min(at + BATCH, len(langs)))]
                features = overlaps(basis, slot, own) / norm @ root
                weight = np.array([balance[c] for c in langs[at : at + BATCH]])
                square += features.T @ (features * weight[:, None])
                for c, row in zip(langs[at : at + BATCH], features * weight[:, None], strict=True):
                    sums[c] = sums.get(c, 0) + row
        made = {None: square, **sums}
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["lang", "part"])

    parts = sample.select("lang", "grams").repartition(TASKS, "lang").mapInArrow(run, "lang string, part binary").collect()
    square = ridge * np.eye(len(marks))
    sums = dict.fromkeys(classes, 0)
    for r in parts:
        got = np.frombuffer(r["part"])
        if r["lang"] is None:
            square += got.reshape(square.shape)
        else:
            sums[r["lang"]] = sums[r["lang"]] + got
    # Targets are 1 for the own language and -1 for all others.
    target = 2 * np.stack([sums[c] for c in classes], axis=1) - sum(sums.values())[:, None]
    mix = root @ np.linalg.solve(square, target) / norm[:, None]
    if len(basis) * len(classes) * 4 <= FOLD_BYTES:
        return Model(classes, slot, (basis @ mix).astype(np.float32), None, orders)
    return Model(classes, slot, basis, mix.astype(np.float32), orders)


def scores(model: Model, texts: list[str], seen: np.ndarray) -> np.ndarray:
    """Class scores of a batch, presence matrix times weights; the matrix is held as lists of n-gram numbers."""
    sums = overlaps(model.basis, model.slot, [grams(t, model.orders, seen) for t in texts])
    return sums if model.mix is None else sums @ model.mix


def predict(docs: DataFrame, model: Model | None, batch_rows: int = BATCH) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of those names are replaced, others may have any name.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Of equal scores the first language by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # checked in :func:`train`
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = kept.columns.index("text")
    letter = unused(kept, "letter")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen = np.zeros(_SIZE, bool)
        for batch in batches:
            names, sure = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            texts = batch.column(text_at)
            some = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)) if own else []
            for at in range(0, len(some), batch_rows):
                rows = some[at : at + batch_rows]
                got = scores(own, [texts[int(r)].as_py() for r in rows], seen)
                odds = np.exp(4 * (got - got.max(1, keepdims=True)))
                best = got.argmax(1)
                part = odds[np.arange(len(rows)), best] / odds.sum(1)
                for r, b, p in zip(rows, best, part, strict=True):
                    names[r], sure[r] = own.classes[b], float(p)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(sure, pa.float64())], schema.names
            )

    return kept.select("*", has_letter(F.col("text")).alias(letter)).mapInArrow(run, schema)


def train(docs: DataFrame, per_class: int = 300, landmarks: int = 40, orders: int = 4, ridge: float = 0.1) -> Model | None:
    """Model of every language in ``lang``; None if there is no labelled text. ``per_class`` bounds the sample of each.

    Raises if the model is too large to broadcast (some 100,000 languages); none is left out for that.
    """
    model = fit(training_sample(docs, per_class, orders), landmarks, ridge, orders)
    if model and model.basis.nbytes + (model.mix.nbytes if model.mix is not None else 0) > BROADCAST_BYTES:
        raise ValueError(f"weights of {len(model.classes)} languages are over {BROADCAST_BYTES} bytes")
    return model


def identify(docs: DataFrame, per_class: int = 300, landmarks: int = 40, orders: int = 4) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``, learned from the documents that are not held out.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing is labelled.
    Rows repeated whole get equal answers, and count once in the sample. A null doc_id is neither held out nor learned from. Of equal scores the
    first language by name is taken. An empty table gives no rows. Columns but doc_id, text and lang are not read.
    """
    model = train(docs, per_class, landmarks, orders)
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
