"""Quality classifier from weak labels.

Heuristic labellers vote on each document (low quality, quality, or nothing). How
often each pattern of votes occurs, over all documents, is all that expectation
maximisation needs: it estimates how often each labeller gives each vote on documents of
either class, and with that the probability of low quality of each pattern. A
linear scorer of hashed n-grams is trained on these probabilities; its score, which also
sees what no heuristic looks at, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.features import margin, ngram_groups, style, style_group
from tallywright.llm.rules import fitted, sampled_rows, smallest_hashes
from tallywright.llm.tasks import arrow_map, batch, give_back, named, texts_of
from tallywright.sources.scratch import stage

#: Documents of each side that the scorer is trained on.
SAMPLE_ROWS = 1200
#: Least probability of quality of a document that stays.
LEAST_QUALITY = 0.5

# Labellers as (measure, quality below or above, low quality beyond).
LABELLERS = (
    ("symbols", 0.05, 0.30),
    ("punctuation", 0.02, 0.06),
    ("upper", 0.15, 0.40),
    ("repeats", 0.20, 0.50),
    ("same_next", 0.05, 0.25),
    ("dup_lines", 0.20, 0.50),
    ("distinct", 0.35, 0.15),
    ("sentences", 0.02, 0.004),
    ("mean_word", 14.0, 25.0),
)
ABSTAIN, GOOD, LOW = 0, 1, 2


def votes_of(measures: dict[str, float]) -> list[int]:
    """The vote of each labeller on a text of these measures."""
    votes = []
    for name, good, low in LABELLERS:
        value, up = measures[name], low > good
        if (value >= low) if up else (value <= low):
            votes.append(LOW)
        elif (value <= good) if up else (value >= good):
            votes.append(GOOD)
        else:
            votes.append(ABSTAIN)
    if measures["words"] < 20:  # too short to tell repeats and sentences
        for at in (3, 4, 5, 6, 7):
            votes[at] = ABSTAIN
    return votes


def pattern_of(votes: list[int]) -> int:
    return sum(vote * 3**at for at, vote in enumerate(votes))


def votes_in(pattern: int) -> list[int]:
    return [pattern // 3**at % 3 for at in range(len(LABELLERS))]


def expectation_maximisation(
    patterns: list[int], counts: np.ndarray, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of low quality per pattern, vote rates (class, labeller, vote), prior.

    Starts from documents with any vote for low quality; a small prior keeps rates off 0.
    """
    if not patterns:
        return np.empty(0), np.empty((2, len(LABELLERS), 3)), 0.5
    votes = np.array([votes_in(pattern) for pattern in patterns]).reshape(len(patterns), len(LABELLERS))
    low = np.where((votes == LOW).any(axis=1), 0.9, 0.02)
    weights = counts / max(counts.sum(), 1)
    rates, prior = np.empty((2, votes.shape[1], 3)), 0.5
    # What is expected of a labeller before any document is seen, in shares of a document count.
    expected = np.array([[0.3, 0.69, 0.01], [0.3, 0.4, 0.3]])
    for _ in range(rounds):
        prior = float(np.clip((weights * low).sum(), 1e-3, 1 - 1e-3))
        for side, share in enumerate((1 - low, low)):
            for vote in range(3):
                held = (votes == vote).T @ (weights * share)
                rates[side, :, vote] = held + 0.005 * expected[side, vote]
            rates[side] /= rates[side].sum(axis=1, keepdims=True)
        logs = np.log(rates)
        places = np.arange(votes.shape[1])
        sides = [np.where(votes == ABSTAIN, 0, logs[side, places, votes]).sum(axis=1) for side in (0, 1)]
        odds = sides[1] - sides[0] + np.log(prior / (1 - prior))
        following = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(following - low).max(initial=0) < 1e-9:
            break
        low = following
    return low, rates, prior


def _groups(text: bytes) -> list[np.ndarray]:
    return [*ngram_groups(text), style_group(style(text))]


def _vote(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [pattern_of(votes_of(style(text))) for text in texts_of(part)]
        yield batch(doc_id=part.column("doc_id"), pattern=np.array(found, np.int32))


def _judge(model, low, extra: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, chances = model.value, low.value
        for part in parts:
            texts = texts_of(part)
            measures = [style(text) for text in texts]
            weak = np.array([1 - chances.get(pattern_of(votes_of(one)), 0.0) for one in measures])
            scores = weak
            if linear is not None:
                margins = [
                    margin([*ngram_groups(text), style_group(one)], linear.weights)
                    for text, one in zip(texts, measures, strict=True)
                ]
                scores = 1 - linear.probability(np.array(margins))
            columns = {name: part.column(name) for name in extra}
            yield batch(**columns, weak_quality=weak, quality_score=scores, stays=scores >= LEAST_QUALITY)

    return run


def classify(documents: DataFrame) -> DataFrame:
    """All rows of ``documents`` with ``weak_quality, quality_score, stays``.

    ``weak_quality`` is what the labellers say, ``quality_score`` what the scorer says, each
    the probability of quality. Columns of those names are replaced. No label is used.

    A null or empty text gets the votes of a text without words. Repeated rows each give
    a row, a null ``doc_id`` stays null and is not trained on, an empty table gives
    no rows. If the labellers find only one side, their own probability decides.
    """
    spark = documents.sparkSession
    voted = stage(
        arrow_map(documents.select("doc_id", "text"), _vote, "doc_id long, pattern int"), "votes"
    )
    # At most 3 ** len(LABELLERS) patterns.
    counted = sorted((row[0], row[1]) for row in voted.groupBy("pattern").count().collect())
    patterns = [pattern for pattern, _ in counted]
    low, _, share = expectation_maximisation(patterns, np.array([n for _, n in counted], float))
    chances = dict(zip(patterns, low.tolist(), strict=True))
    model = None
    if counted:
        table = spark.createDataFrame(list(chances.items()), "pattern int, target double")
        rows = voted.where("doc_id is not null").join(F.broadcast(table), "pattern")
        sides = [
            smallest_hashes(rows.where(side).select("doc_id", "target").distinct(), SAMPLE_ROWS)
            for side in ("target > 0.5", "target <= 0.5")
        ]
        chosen = stage(sides[0].union(sides[1]).groupBy("doc_id").agg(F.min("target").alias("target")), "chosen")
        model = fitted(*sampled_rows(documents, chosen, _groups), share)
        give_back()
    kept = [name for name in documents.columns if name not in ("weak_quality", "quality_score", "stays")]
    rows = documents.select(*map(named, kept))
    found = T.StructType.fromDDL("weak_quality double, quality_score double, stays boolean")
    return arrow_map(
        rows,
        _judge(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(chances), kept),
        T.StructType([*rows.schema.fields, *found.fields]),
    )


def keep_quality(documents: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns as they are."""
    return classify(documents).where("stays").select(*map(named, documents.columns))
