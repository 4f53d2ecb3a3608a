"""Mixing sources to target weights, with soft membership in domains.

A classifier fitted on a labelled table gives each document a probability for every
domain. Document rates are then fitted: nonnegative, as close to one as can be (each
document weighed by its tokens), so that the tokens expected of each domain match its
target. The fit is projected gradient descent on the squared distance to the targets.
Each step needs a few numbers per pair of domains from the corpus; a document's own rate
follows from one number per domain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywright.llm.features import SIZE, ngram_groups, sparse_row
from tallywright.llm.rules import one_text_each, smallest_hashes
from tallywright.llm.tasks import arrow_map, batch, give_back, named, texts_of
from tallywright.sources.scratch import stage

#: Labelled rows of each domain that the classifier is fitted on, and the most domains.
SAMPLE_ROWS = 400
MOST_DOMAINS = 64
#: Smoothing of a domain's n-grams.
SMOOTH = 0.1
#: More steps than any fit should need; one that does fails.
STEPS = 100
#: Lengths of a step that are tried in one pass.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.005)
#: Weight of rates close to one against targets met, and the distance to the targets, as a share
#: of the budget, below which they count as met.
RIDGE = 1e-7
CLOSE = 1e-5

# Target weights of the domains of the test tables.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


class Domains:
    """A naive Bayes model of hashed n-grams, and how sure it may be of a text."""

    def __init__(self, names: list[str], logs: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.logs, self.prior = names, logs, prior

    def posterior(self, text: bytes) -> np.ndarray:
        score = self.prior.copy()
        for group in ngram_groups(text):
            # The n-grams of a text repeat each other: as sure as its square root says.
            score += self.logs[:, group].mean(axis=1) * np.sqrt(len(group))
        score = np.exp(score - score.max())
        return score / score.sum()


def _domain_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, dict[int, float]] = {}
    for part in parts:
        for text, domain in zip(texts_of(part), part.column("domain").to_pylist(), strict=True):
            own = sums.setdefault(domain, {})
            for feature, share in zip(*(x.tolist() for x in sparse_row(ngram_groups(text))), strict=True):
                own[feature] = own.get(feature, 0.0) + share
    rows = [(domain, feature, share) for domain, own in sums.items() for feature, share in own.items()]
    domains, features, shares = zip(*rows) if rows else ((), (), ())
    yield batch(
        domain=pa.array(domains, pa.string()),
        feature=pa.array(features, pa.int32()),
        share=pa.array(shares, pa.float64()),
    )


def fit_domains(documents: DataFrame, labelled: DataFrame, names: list[str]) -> Domains:
    """The classifier of the domains of ``labelled`` (doc_id, domain).

    It is fitted on ``SAMPLE_ROWS`` rows of each domain, those with the smallest hash of
    ``doc_id``. Labelled rows of domains that are not among ``names`` are left out.
    """
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    known = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = None
    for name in names:
        own = smallest_hashes(known.where(F.col("domain") == name), SAMPLE_ROWS)
        picked = own if picked is None else picked.union(own)
    picked = stage(picked, "chosen")
    sample = one_text_each(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    sums = (
        arrow_map(sample.select("text", "domain"), _domain_counts, "domain string, feature int, share double")
        .groupBy("domain", "feature")
        .agg(F.sum("share").alias("share"))
        .toArrow()  # at most SIZE rows of a domain; as columns, for rows of Python objects take many times that
    )
    table = np.full((len(names), SIZE), SMOOTH / 100)
    for part in sums.to_batches():
        places = pc.index_in(part.column("domain"), pa.array(names, pa.string())).to_numpy()
        table[places, part.column("feature").to_numpy()] += part.column("share").to_numpy()
    del sums
    give_back()
    held = {row[0]: row[1] for row in picked.groupBy("domain").count().collect()}
    prior = np.log([held.get(name, 0) + 1.0 for name in names])
    return Domains(names, np.log(table / table.sum(axis=1, keepdims=True)), prior - prior.max())


def _memberships(domains, kept: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = domains.value
        for part in parts:
            texts = texts_of(part)
            found = [model.posterior(text).tolist() for text in texts]
            yield batch(
                **{name: part.column(name) for name in kept},
                tokens=np.array([len(text.split()) for text in texts], np.int64),
                posterior=pa.array(found, pa.list_(pa.float64())),
            )

    return run


def _measured(candidates: list[list[float]]):
    """Per task and candidate push: expected tokens, the curve of rows not at zero, and the dual value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(candidates[0])
        sums = np.zeros((len(candidates), width + width * width + 1))
        for part in parts:
            tokens = part.column("tokens").to_numpy().astype(np.float64)
            posterior = part.column("posterior").flatten().to_numpy().reshape(-1, width)
            for at, push in enumerate(candidates):
                rate = np.maximum(0, 1 + posterior @ np.array(push))
                used = rate * tokens
                active = posterior * np.where(rate > 0, tokens, 0)[:, None]
                sums[at, :width] += used @ posterior
                sums[at, width:-1] += (active.T @ posterior).ravel()
                sums[at, -1] += (used @ rate) / 2
        candidate, place = np.indices(sums.shape, np.int32).reshape(2, -1)
        yield batch(candidate=candidate, place=place, total=sums.ravel())

    return run


@dataclass
class _Step:
    """What a push of the domains gives."""

    push: np.ndarray
    expected: np.ndarray
    curve: np.ndarray
    value: float


def _tried(members: DataFrame, pushes: list[np.ndarray]) -> list[_Step]:
    width = len(pushes[0])
    found = np.zeros((len(pushes), width + width * width + 1))
    # A row per candidate and number, whatever the number of documents.
    rows = (
        arrow_map(
            members.select("tokens", "posterior"),
            _measured([push.tolist() for push in pushes]),
            "candidate int, place int, total double",
        )
        .groupBy("candidate", "place")
        .agg(F.sum("total"))
        .collect()
    )
    for candidate, place, total in rows:
        found[candidate, place] = total
    return [
        _Step(push, own[:width], own[width:-1].reshape(width, width), float(own[-1]))
        for push, own in zip(pushes, found)
    ]


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None) -> DataFrame:
    """``members`` (doc_id, tokens, posterior) with the ``rate`` of each row and what is ``missed``.

    The expected tokens ``sum(rate * tokens * posterior)`` match ``targets``, shares of ``budget``,
    as nearly as nonnegative rates allow; among such rates those as close to one as can
    be are taken. The default budget is the smallest at which no document has to be used
    less than once. ``missed`` is the same in every row: the largest distance of a domain's
    expected tokens to its target, as a share of the budget. It stays below ``CLOSE``
    where the targets can be met, and tells how far off they are where they cannot.

    A rate is one plus the push of the document's domains, projected onto zero where that is
    negative. The push follows the gradient, the distance to the targets, in the metric of the
    rows not at zero, by the length at which the objective is best among a few.
    """
    width = len(targets)
    first = _tried(members, [np.zeros(width)])[0]
    natural = first.expected
    if not natural.sum() > 0:
        return members.withColumns({"rate": F.lit(1.0), "missed": F.lit(0.0)})
    shares = np.array(targets, float) / sum(targets)
    if budget is None:
        lift = np.linalg.pinv(first.curve) @ shares  # of a document of each domain, per token of the budget
        budget = float(1 / lift.min() if lift.min() > 0 else (natural / shares).max())
    goal = shares * budget
    # Rates far from one cost a little, so that targets out of reach have a best fit too.
    cost = RIDGE * natural.sum() / width

    def value(step: _Step) -> float:
        return float(step.push @ goal - step.value - cost * step.push @ step.push / 2)

    at = first
    for _ in range(STEPS):
        slope = goal - at.expected - cost * at.push
        if np.abs(slope).max() <= CLOSE / 10 * budget:
            break
        ahead = np.linalg.solve(at.curve + cost * np.eye(width), slope)
        tried = _tried(members, [at.push + length * ahead for length in LENGTHS])
        best = max(tried, key=value)
        if value(best) <= value(at):  # as good as doubles can tell
            break
        at = best
    else:
        raise RuntimeError(f"the rates have not settled after {STEPS} steps")
    missed = float(np.abs(goal - at.expected).max() / budget)
    pushed = sum((F.col("posterior")[i] * F.lit(float(x)) for i, x in enumerate(at.push)), F.lit(1.0))
    return members.withColumns({"rate": F.greatest(F.lit(0.0), pushed), "missed": F.lit(missed)})


def memberships(documents: DataFrame, domains: Domains) -> DataFrame:
    """``doc_id, tokens, posterior`` of every row of ``documents``; tokens are words."""
    shared = documents.sparkSession.sparkContext.broadcast(domains)
    return arrow_map(
        documents.select("doc_id", "text"),
        _memberships(shared, ["doc_id"]),
        "doc_id long, tokens long, posterior array<double>",
    )


def _with_rows(documents: DataFrame, domains: Domains) -> tuple[DataFrame, list[Column]]:
    """``text, others, tokens, posterior`` of every row, and the documents' columns in these.

    ``others`` is a struct of all columns but the text, so that none can clash with one
    needed on the way.
    """
    shared = documents.sparkSession.sparkContext.broadcast(domains)
    places = {name: f"c{at}" for at, name in enumerate(documents.drop("text").columns)}
    others = F.struct(*[named(name).alias(place) for name, place in places.items()])
    rows = documents.select("text", others.alias("others"))
    schema = StructType([*rows.schema, *StructType.fromDDL("tokens long, posterior array<double>")])
    own = {name: F.col("others")[place] for name, place in places.items()}
    columns = [own.get(name, F.col("text")).alias(name) for name in documents.columns]
    return arrow_map(rows, _memberships(shared, ["text", "others"]), schema), columns


def mix(
    documents: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None
) -> DataFrame:
    """``doc_id, tokens, posterior, rate, missed`` of every row of ``documents``.

    ``posterior`` holds a probability per domain, in the order of the sorted names of
    ``targets``; ``rate`` is how often the row is to be used, on average; ``missed`` tells how
    far the targets are from being met (see ``fit_rates``).

    A null or empty text has no tokens, the share of each domain among the labelled rows as
    posterior. Without tokens at all every rate is 1. Without labelled rows all domains are
    equally likely; labelled rows of other domains than the targets' are left out. Repeated
    rows each give a row and count towards the targets, a null ``doc_id`` stays null, other
    columns are ignored, an empty table gives no rows.
    """
    names = sorted(targets)
    domains = fit_domains(documents, labelled, names)
    members = stage(memberships(documents, domains), "members")
    return fit_rates(members, [targets[name] for name in names], budget)


def repeat_by_rate(
    documents: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None
) -> DataFrame:
    """The documents as often as their rates say, with their columns as they are.

    A rate of 1.3 is one row, and with probability 0.3 a second one; the draw is a hash of
    ``doc_id``. Rows with the same ``doc_id`` share the largest of their rates; so do rows
    with a null ``doc_id``, whose draw is a hash of the text.
    """
    names = sorted(targets)
    rows, columns = _with_rows(documents, fit_domains(documents, labelled, names))
    # The rows come along to their rates: joining them would shuffle every text.
    members = stage(rows, "members")
    doc_id = next(own for own, name in zip(columns, documents.columns) if name.lower() == "doc_id")
    rated = fit_rates(members, [targets[name] for name in names], budget).select(
        doc_id.cast("long").alias("doc_id"), "rate", "text", "others"
    )
    largest = rated.groupBy("doc_id").agg(F.max("rate").alias("largest"), F.count("*").alias("rows"))
    repeated = stage(largest.where("rows > 1").select("doc_id", "largest"), "repeated")
    unnamed = repeated.where("doc_id is null").first()
    several = repeated.where("doc_id is not null")
    if unnamed is not None:
        rated = rated.withColumn("rate", F.when(F.col("doc_id").isNull(), unnamed["largest"]).otherwise(F.col("rate")))
    if not several.isEmpty():
        # Rows without an id are not joined: all have the one key that joins nothing, and would meet in one task.
        known = rated.where("doc_id is not null").join(several, "doc_id", "left")
        known = known.withColumn("rate", F.coalesce("largest", "rate")).drop("largest")
        rated = known.unionByName(rated.where("doc_id is null"))

    def draw(key: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1000003)) / F.lit(1000003.0)

    drawn = F.when(F.col("doc_id").isNull(), draw("text")).otherwise(draw("doc_id"))
    copies = F.array_repeat(F.lit(1), F.floor(F.col("rate") + drawn).cast("int"))
    return rated.select("text", "others", F.explode(copies).alias("copy")).select(*columns)
