"""Quality rules: fixed counts and a calibrated classifier of hashed n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.features import SIZE, margin, ngram_groups, rule_counts, sparse_row
from tallywright.llm.linear import Linear, Rows, calibrated, fit
from tallywright.llm.tasks import arrow_map, batch, give_back, texts_of
from tallywright.sources.scratch import stage

#: Labelled rows of each class a model is fitted on, a quarter of them for calibration.
SAMPLE_ROWS = 1200
#: Fixed thresholds: fewest words, most repeated words in percent, least probability of quality.
LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_QUALITY = 0.5


Groups = Callable[[bytes], list[np.ndarray]]


def _sparse(groups: Groups):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [sparse_row(groups(text)) for text in texts_of(part)]
            yield batch(
                target=part.column("target"),
                part=part.column("part"),
                features=pa.array([row[0].astype(np.int32) for row in rows], pa.list_(pa.int32())),
                shares=pa.array([row[1].astype(np.float32) for row in rows], pa.list_(pa.float32())),
            )

    return run


def sampled_rows(
    documents: DataFrame, targets: DataFrame, groups: Groups = ngram_groups
) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, targets and parts of the rows named by ``targets`` (doc_id, target).

    ``targets`` is of bounded size; so is what reaches the driver: at most ``SIZE`` features
    a row.
    """
    sample = (
        one_text_each(documents.select("doc_id", "text").join(F.broadcast(targets), "doc_id"))
        .selectExpr("text", "double(target) as target", "int(pmod(xxhash64(doc_id, 1), 4)) as part")
    )
    rows = arrow_map(
        sample, _sparse(groups), "target double, part int, features array<int>, shares array<float>"
    ).toArrow()
    lists = [rows.column(name).combine_chunks() for name in ("features", "shares")]
    if not rows.num_rows:
        return Rows.of([]), np.empty(0), np.empty(0, np.int64)
    bounds = lists[0].offsets.to_numpy().astype(np.int64)
    sparse = Rows(
        lists[0].values.to_numpy()[bounds[0] : bounds[-1]],
        lists[1].values.to_numpy()[bounds[0] : bounds[-1]],
        bounds - bounds[0],
    )
    return sparse, rows.column("target").to_numpy(), rows.column("part").to_numpy()


def _part(rows: Rows, chosen: np.ndarray) -> Rows:
    sizes = np.diff(rows.bounds)
    picked, sizes = np.repeat(chosen, sizes), sizes[chosen]
    return Rows(rows.features[picked], rows.values[picked], np.concatenate([[0], np.cumsum(sizes)]))


def fitted(rows: Rows, targets: np.ndarray, part: np.ndarray, share: float) -> Linear | None:
    """A linear model fitted on three quarters of the rows and calibrated on the rest.

    ``share`` is how many rows have a target of 1 where the model is used, whatever the
    sample's share is. None if the rows don't hold both classes.
    """
    kept = part == 0
    if not (targets > 0.5).any() or not (targets < 0.5).any():
        return None
    learn, check = (~kept, kept) if kept.any() and len(set(targets[kept] > 0.5)) == 2 else (kept | True, kept | True)
    model = fit(_part(rows, learn), targets[learn], SIZE)
    model.scale, model.shift = calibrated(model.margins(_part(rows, check)), targets[check])
    model.shift += _log_odds(share) - _log_odds(float(targets[check].mean()))
    return model


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """A bounded sample: the rows with the smallest hash of ``doc_id``."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def one_text_each(sample: DataFrame) -> DataFrame:
    """One row per ``doc_id`` of a bounded sample: the one whose text has the smallest hash."""
    rest = [name for name in sample.columns if name != "doc_id"]
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), *rest)).alias("first")
    return sample.groupBy("doc_id").agg(first).select("doc_id", *[f"first.{name}" for name in rest])


def _judge(model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = model.value
        for part in parts:
            texts = texts_of(part)
            counts = np.array([rule_counts(text) for text in texts], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            scores = np.ones(len(texts))
            if linear is not None:
                scores = linear.probability(np.array([margin(ngram_groups(text), linear.weights) for text in texts]))
            yield batch(
                doc_id=part.column("doc_id"),
                n_words=counts[:, 0],
                word_chars=counts[:, 1],
                n_symbols=counts[:, 2],
                n_dup_lines=counts[:, 3],
                n_repeat_words=counts[:, 4],
                base_failed=failed,
                score=scores,
                kept=~failed & (scores >= LEAST_QUALITY),
            )

    return run


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``documents``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept``; ``score`` is the probability that the text is labelled
    as quality. The model is fitted on ``SAMPLE_ROWS`` labelled rows of each class at most,
    those with the smallest hash of ``doc_id``.

    A null or empty text has no words and fails. Labels that are null or not 0 or 1 are
    left out, of repeated ones the largest counts; without labels of both classes the
    score is 1 and only the fixed counts decide. Repeated rows each give a row, a null
    ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("target"))
    )
    chosen = [smallest_hashes(known.where(f"target = {label}"), SAMPLE_ROWS) for label in (0, 1)]
    chosen = stage(chosen[0].union(chosen[1]), "chosen")
    share = known.agg(F.avg("target")).first()[0] or 0.0
    model = fitted(*sampled_rows(documents, chosen), share)
    give_back()
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return arrow_map(
        documents.select("doc_id", "text"),
        _judge(shared),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, score double, kept boolean",
    )
