"""Toxicity scores by a convolutional classifier with thresholds per language.

Training reads all labelled documents: three quarters for the weights, one
quarter to set a threshold for each language (the language is predicted from
the words, too).  In every epoch each task starts from the shared weights of
``toxicity_model``, goes over its own rows in minibatches and gives its weights
back; their mean by rows is where the next epoch starts.  A task has about
``TASK_ROWS`` documents, so what an epoch does to the weights does not depend
on how the table is cut into files.  Words per language and the logits of the
quarter set aside (in steps of 1 / 1024) are counted in Spark.  Scoring
broadcasts the model (some 3 MB, set by its shape) and is one pass over whole
texts without a shuffle.

The score is 0.7 at the threshold of the text's language; labels, languages,
sources and ids are no inputs of it.

Defined results: null and empty texts are scored as a text without words;
without labelled rows of both classes every score is 0; labels that are null
or whose document is missing are ignored, of several labels of a document the
highest counts; repeated rows repeat their result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import toxicity_model
from .common import TextBatch, checkpointed
from .toxicity_model import ToxicityModel

CUT = 0.7


# Documents of a training task; epochs at least and at most, and the documents all epochs should read together.
TASK_ROWS = 8192
EPOCHS, READ_ROWS = (3, 12), 100_000
LOGIT_STEPS = 1024
# Documents of a class set aside at least; with fewer, all labelled rows serve for the weights and for the thresholds.
LEAST_ASIDE = 50
# Labels up to which they are broadcast (a few MB).
BROADCAST_LABELS = 1 << 18


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", label_col: str = "toxic") -> ToxicityModel | None:
    """Fit on all labelled rows (those of ``where``, a condition on the id column, if given); None if a class is missing."""
    use = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if where is None else where))
    use = checkpointed(use.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label")).withColumn(
        "_aside", F.pmod(F.xxhash64("_label_id", F.lit("split")), F.lit(4)) == 0))
    few = use.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.join(F.broadcast(use) if few else use, docs[id_col] == use["_label_id"]).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), "_label", "_aside")
    if not few:
        rows = checkpointed(rows)  # the epochs read the joined rows, none joins again
    sizes = {(r["_label"], r["_aside"]): r["n"] for r in rows.groupBy("_label", "_aside").agg(F.count("*").alias("n")).collect()}
    if any(sizes.get((label, False), 0) + sizes.get((label, True), 0) == 0 for label in (0, 1)):
        return None
    aside = F.col("_aside")
    if min(sizes.get((label, True), 0) for label in (0, 1)) < LEAST_ASIDE or min(sizes.get((label, False), 0) for label in (0, 1)) == 0:
        sizes = {(label, False): sizes.get((label, False), 0) + sizes.get((label, True), 0) for label in (0, 1)}
        fit, held = rows, rows
    else:
        fit, held = rows.where(~aside), rows.where(aside)
    n = sizes[0, False] + sizes[1, False]
    fit = fit.select("text", "_label").coalesce(max(1, math.ceil(n / TASK_ROWS)))
    model = toxicity_model.start()
    for epoch in range(min(max(math.ceil(READ_ROWS / n), EPOCHS[0]), EPOCHS[1])):
        model = _epoch(fit, model, epoch)
    toxicity_model.fit_languages(model, _language_words(rows))
    found = _logits(held, model).groupBy("lang", "z", "_label").agg(F.count("*").alias("n")).toArrow()
    lang, z, label, count = (found.column(c).to_numpy() for c in ("lang", "z", "_label", "n"))
    order = np.lexsort((label, z, lang))
    toxicity_model.calibrate(model, lang[order], z[order] / LOGIT_STEPS, label[order].astype(np.float64), count[order].astype(np.float64))
    return model


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = TextBatch(batch.column("text"))
    return np.split(toxicity_model.word_ids(words), words.first[1:-1])


def _epoch(rows: DataFrame, model: ToxicityModel, number: int) -> ToxicityModel:
    """The mean, by rows, of the weights that the tasks find on their own rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = toxicity_model.Epoch(shared.value, [5, number, TaskContext.get().partitionId()])
        for batch in batches:
            if batch.num_rows:
                own.add(_texts(batch), batch.column("_label").to_numpy().astype(np.float32), np.ones(batch.num_rows, np.float32))
        if own.rows:
            total = own.weights().astype(np.float64) * own.rows
            yield pa.RecordBatch.from_arrays([pa.array([own.rows]), pa.array([total.tobytes()], pa.binary())], names=["rows", "weights"])

    def add(batches):
        rows, total = 0, 0.0
        for batch in batches:
            for n, w in zip(batch.column("rows").to_pylist(), batch.column("weights").to_pylist()):
                rows, total = rows + n, total + np.frombuffer(w, np.float64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.tobytes()], pa.binary())], names=["rows", "weights"])

    # Sums of 4 MB each: added up in executors, so that a few reach the driver however many tasks there are.
    found = checkpointed(rows.mapInArrow(run, "rows long, weights binary")).coalesce(4).mapInArrow(add, "rows long, weights binary").collect()
    total = np.sum([np.frombuffer(r["weights"], np.float64) for r in found], axis=0)
    return toxicity_model.with_weights(total / sum(r["rows"] for r in found))


def _language_words(rows: DataFrame) -> dict[str, np.ndarray]:
    """How often each word row occurs in each language."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def cells():
            for lang, own in held.items():
                used = np.flatnonzero(own)
                # A language without words is one, too.
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, 0)), pa.array(np.append(own[used], 0))],
                                                 names=["lang", "word", "n"])
            held.clear()
        for batch in batches:
            for text, lang in zip(_texts(batch), batch.column("lang").to_pylist()) if batch.num_rows else ():
                own = held.setdefault(lang, np.zeros(toxicity_model.ROWS[0], np.int64))
                np.add.at(own, text[:, 0], 1)
            if len(held) > 256:
                yield from cells()
        yield from cells()
    summed = rows.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("cells"))
    out = {}
    for row in summed.toLocalIterator():  # bounded by languages x word rows
        out[row["lang"]] = np.zeros(toxicity_model.ROWS[0])
        out[row["lang"]][[c[0] for c in row["cells"]]] = [c[1] for c in row["cells"]]
    return out


def _logits(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(lang: index of the predicted language, z: logit in steps, _label) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            words = TextBatch(batch.column("text"))
            ids = toxicity_model.word_ids(words)
            z, lang = shared.value.logits(ids, words.first), shared.value.language(ids, words.first)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(np.rint(z * LOGIT_STEPS).astype(np.int64)), batch.column("_label")],
                                             names=["lang", "z", "_label"])
    return rows.select("text", "_label").mapInArrow(run, "lang long, z long, _label int")


def score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None,
          cut: float = CUT) -> DataFrame:
    """``keep`` columns (default: all) plus score and predicted (1 if score >= cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            if m is None:
                s = np.zeros(batch.num_rows)
            else:
                words = TextBatch(batch.column("text"))
                s = m.scores(toxicity_model.word_ids(words), words.first, cut)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(s.astype(np.float64))], names=["kept", "score"])

    out = inner.mapInArrow(run, f"kept {inner.schema['kept'].dataType.simpleString()}, score double")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], "score", (F.col("score") >= cut).cast("int").alias("predicted"))
