"""Toxicity of whole texts by a bidirectional recurrent network over overlapping windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps

from .names import free_names
from .recurrent import Network, lexicon, score_windows, train, window_starts
from .words import Slice, slices

LENGTH = 32
STRIDE = 24
MAX_CLEAN = 2_000
MAX_TOXIC = 1_000
WINDOWS_PER_DOCUMENT = 16
FOLDS = 5
EMPTY_SCORE = 0.0
TRIALS = 6
SLICE = 2 << 20


@dataclass
class ToxicityModel:
    """A fitted network, or the share of toxic labels where there was nothing to tell apart."""

    network: Network | None
    share: float

    def scores(self, part: Slice) -> np.ndarray:
        """The score of each text of a slice: that of its worst window."""
        n_words = part.n_words
        if self.network is None:
            return np.where(n_words > 0, self.share, EMPTY_SCORE)
        words, which = lexicon(part)
        gates = self.network.gates(words)
        starts = [window_starts(int(n), LENGTH, STRIDE) for n in n_words]
        count = np.fromiter(map(len, starts), np.int64, len(starts))
        out = np.full(len(starts), -np.inf)
        if count.sum():
            begin = np.concatenate(starts) + np.repeat(part.first_word[:-1], count)
            place = np.arange(LENGTH)
            mask = place < np.repeat(np.minimum(n_words, LENGTH), count)[:, None]
            worst = np.empty(len(begin), np.float32)
            for a in range(0, len(begin), 8192):
                rows = slice(a, a + 8192)
                ids = which[np.minimum(begin[rows, None] + place, len(which) - 1)]
                worst[rows] = score_windows(self.network, gates, ids, mask[rows])
            full = np.flatnonzero(count)
            out[full] = np.maximum.reduceat(worst, (np.cumsum(count) - count)[full])
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(out, -50, 50))), EMPTY_SCORE)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, seed: int = 5,
) -> ToxicityModel:
    """Fit a model on labelled documents outside the held-out fold.

    At most ``max_toxic`` toxic and ``max_clean`` clean documents are taken, the first by a hash of the
    id, with ``WINDOWS_PER_DOCUMENT`` random windows of each; what a task learns from is bounded by
    these three numbers.  ``TRIALS`` tasks fit one network each, from different starts, and only their
    parameters come to the driver; the one with the least loss on documents it did not learn from is the
    model, so that an unlucky start or the rounding of a machine does not decide.  Rows without id, text
    or label are left out; several labels of one document count as toxic if one does, and of several
    texts of one id the one with the smallest hash is taken.  With no documents of one kind the model is
    the share of toxic ones.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max(F.col("toxic") != 0).cast("int").alias("toxic"))
    )
    first = lambda toxic, n: known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    chosen = first(1, max_toxic).union(first(0, max_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic, keys, out = *(batch.column(i).to_pylist() for i in (0, 1, 3)), []
            for part in slices(batch.column(2), SLICE):
                for i in range(part.n_texts):
                    a, n = int(part.first_word[i]), int(part.n_words[i])
                    starts = window_starts(n, LENGTH, STRIDE)
                    if len(starts) > WINDOWS_PER_DOCUMENT:
                        rng = np.random.default_rng([seed, ids[part.first + i] & (1 << 62) - 1])
                        starts = np.sort(rng.choice(starts, WINDOWS_PER_DOCUMENT, replace=False))
                    span = lambda s: part.data[
                        part.starts[a + s] : part.ends[a + min(s + LENGTH, n) - 1]  # noqa: B023
                    ]
                    if len(starts):
                        own = [span(int(s)).tobytes().decode("utf-8", "replace") for s in starts]
                        out.append((ids[part.first + i], toxic[part.first + i], own, keys[part.first + i]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "toxic", "windows", "text_key"]
            )

    sample = cut_lineage(
        texts.join(F.broadcast(chosen), "id")  # at most max_toxic + max_clean ids
        .select("id", "toxic", "text", F.xxhash64("text"))
        .mapInArrow(run, "id long, toxic int, windows array<string>, text_key long")
        .groupBy("id")
        .agg(F.min("toxic").alias("toxic"), F.min_by("windows", F.struct("text_key", "windows")).alias("windows")),
        "sample",
    )
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n):
        return ToxicityModel(None, n_toxic / n if n else 0.0)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        own = seed + int(rows["trial"][0].as_py())
        net, loss = train(rows["windows"].to_pylist(), rows["toxic"].to_pylist(), LENGTH, seed=own)
        return pa.table({"loss": pa.array([loss]), "seed": pa.array([own]), "parameters": pa.array([pickle.dumps(net.p)], pa.binary())})

    fitted = (
        sample.withColumn("trial", F.explode(F.lit(list(range(TRIALS)))))
        .groupBy("trial")  # the whole bounded sample for each trial
        .applyInArrow(fit, "loss double, seed long, parameters binary")
        .collect()
    )
    drop_steps(sample)
    chosen_fit = min(fitted, key=lambda r: (r.loss, r.seed))
    network = Network(chosen_fit.seed)
    network.p = pickle.loads(chosen_fit.parameters)
    return ToxicityModel(network, n_toxic / n)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``score`` (0 to 1) for each row of ``docs``, from its whole text alone.

    A text is cut into windows of ``LENGTH`` words, ``STRIDE`` apart, the last ending with the text; the
    worst window has the say.  Null, empty and blank texts score 0.  Null ids and repeated rows are
    scored like others; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n_texts), pa.array(model.scores(part).astype(float))],
                    ["id", "score"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, score double"
    )


def without_toxic(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, columns unchanged.

    The text is scored where the row lies; nothing is shuffled.  Null and empty texts stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def score(texts: pa.Array) -> pa.Array:
        parts = [model.scores(p) for p in slices(texts, SLICE)]
        return pa.array(np.concatenate(parts).astype(float) if parts else np.zeros(0))

    (name,) = free_names(docs, "toxicity")
    scored = docs.withColumn(name, F.arrow_udf(score, "double")(F.col(f"`{text_col}`").cast("string")))
    return scored.filter(F.col(name) < threshold).select(*columns)
