"""Compression-distance classification with two zstandard dictionaries.

One dictionary is trained on ordinary text, one on what labelled toxic texts hold
more often than ordinary ones: word beginnings whose counts differ by many standard
deviations. Each window of a text is compressed twice, knowing ordinary text
only and knowing toxic text too. The bytes saved are the window's distance; the
largest, and how many and what share are large, become the text's score by a logistic
curve, calibrated on labelled rows that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.linear import fit_few
from tallywright.llm.rules import one_text_each
from tallywright.llm.tasks import arrow_map, batch, texts_of, words_of
from tallywright.sources.scratch import stage

#: Labelled rows of each class that a model is fitted on: two of three for the dictionaries,
#: one for the curve.
SAMPLE_ROWS = 3000
WINDOW_WORDS = 8
HEAD_LENGTHS = (12, 10, 8, 7, 6, 5)
#: A word beginning is marked if it is so many times as frequent in toxic texts, by so many
#: standard deviations.
FREQUENT, SIGNIFICANT = 8.0, 4.5
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
LEVEL = 12


def heads_of(word: bytes) -> list[bytes]:
    """Beginnings of a word between spaces, the longest first."""
    framed = b" " + word + b" "
    return [framed[:length] for length in HEAD_LENGTHS if len(framed) >= length]


def windows_of(text: bytes) -> list[bytes]:
    words = words_of(text)
    return [
        b" " + b" ".join(words[at : at + WINDOW_WORDS]) + b" " for at in range(0, len(words), WINDOW_WORDS)
    ]


def _heads(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word beginnings with a hash of the next word, so that copies of a text count once."""
    for part in parts:
        heads, following, toxic = [], [], []
        for text, label in zip(texts_of(part), part.column("toxic").to_pylist(), strict=True):
            words = words_of(text)
            pairs = {(head, after) for word, after in zip(words, [*words[1:], b""], strict=False) for head in heads_of(word)}
            heads += [head for head, _ in pairs]
            following += [crc32(after) for _, after in pairs]
            toxic += [label] * len(pairs)
        yield batch(
            head=pa.array(heads, pa.binary()),
            following=pa.array(following, pa.int64()),
            toxic=pa.array(toxic, pa.int32()),
        )


def _passages(marked: set[bytes]):
    """Of toxic rows their marked word beginnings, of ordinary rows their text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            passages = []
            for text, toxic in zip(texts_of(part), part.column("toxic").to_pylist(), strict=True):
                if toxic:
                    heads = [
                        next((head for head in heads_of(word) if head in marked), b"") for word in words_of(text)
                    ]
                    passages.append(b"".join(heads))
                else:
                    passages.append(b" ".join(words_of(text)))
            yield batch(toxic=part.column("toxic"), passage=pa.array(passages, pa.binary()))

    return run


def _dictionary(samples: list[bytes], size: int, **options: int) -> bytes:
    """A trained dictionary; of samples too few to train on, all of them."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Distances:
    """Bytes that knowing toxic text saves, per window of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.both = _compressor(ordinary), _compressor(toxic + ordinary)

    def of(self, text: bytes) -> list[float]:
        plain, both = self.ordinary.compress, self.both.compress
        saved = np.array([len(plain(window)) - len(both(window)) for window in windows_of(text)] or [0])
        told = [saved >= least for least in (2, 3, 4)]
        return [
            float(saved.max()),
            float(np.sort(saved)[-3:].sum()),
            float(saved.mean()),
            *(float(np.log1p(one.sum())) for one in told),
            *(float(one.mean()) for one in told),
            float(np.log1p(len(saved))),
        ]


def _features(ordinary: bytes, toxic: bytes):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(ordinary, toxic)
        for part in parts:
            found = [distances.of(text) for text in texts_of(part)]
            yield batch(toxic=part.column("toxic"), features=pa.array(found, pa.list_(pa.float64())))

    return run


def _held_out(ids: pa.Array) -> list[bool]:
    return [one is not None and crc32(str(one).encode()) % 5 == 0 for one in ids.to_pylist()]


def _score(ordinary: bytes, toxic: bytes, weights: np.ndarray, shift: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(ordinary, toxic) if len(weights) else None
        for part in parts:
            found = [distances.of(text) if distances else [] for text in texts_of(part)]
            margins = np.array(found).reshape(len(found), -1) @ weights + shift
            scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield batch(
                doc_id=part.column("doc_id"),
                held_out=pa.array(_held_out(part.column("doc_id")), pa.bool_()),
                score=scores,
                predicted=(scores >= 0.5).astype(np.int32),
            )

    return run


def _log_odds(share: float) -> float:
    return float(np.log(share / (1 - share)))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    Rows whose crc32 of ``doc_id`` as text is divisible by 5 are held out: their labels
    are not used. A model is fitted on ``SAMPLE_ROWS`` labelled rows of each class at most,
    those with the smallest hash of ``doc_id``, and then weighed by the share of toxic rows
    among all labels that are used; everything else covers all rows.

    A null or empty text is scored like a text without toxic windows. Labels that are null
    or not 0 or 1 are left out, of repeated ones the largest counts. Without labels of
    both classes every score is the share of toxic labels, 0 if there are none. Repeated
    rows each give a row, a null ``doc_id`` stays null and isn't held out, other
    columns are ignored, an empty table gives no rows.
    """
    spark = documents.sparkSession
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = [
        known.where(f"toxic = {label}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        for label in (0, 1)
    ]
    chosen = stage(chosen[0].union(chosen[1]), "chosen")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    # At most 2 * SAMPLE_ROWS rows.
    sample = stage(
        one_text_each(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
        .selectExpr("text", "toxic", "int(pmod(xxhash64(doc_id, 1), 3) = 0) as part"),
        "sample",
    )
    sizes = {(row[0], row[1]): row[2] for row in sample.groupBy("toxic", "part").count().collect()}
    schema = "doc_id long, held_out boolean, score double, predicted int"
    texts = documents.select("doc_id", "text")
    if not all(sizes.get((label, part)) for label in (0, 1) for part in (0, 1)):
        shift = _log_odds(share) if 0 < share < 1 else (1000.0 if share else -1000.0)
        return arrow_map(texts, _score(b"", b"", np.empty(0), shift), schema)

    seen, unseen = sample.where("part = 0"), sample.where("part = 1")
    counted = (
        arrow_map(seen.select("text", "toxic"), _heads, "head binary, following long, toxic int")
        .distinct()
        .groupBy("head")
        .agg(F.sum("toxic").alias("toxic"), F.sum(F.lit(1) - F.col("toxic")).alias("ordinary"))
    )
    words = dict(
        seen.groupBy("toxic").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).cast("double")).collect()
    )
    rate, usual = f"toxic / {words[1]}", f"ordinary / {words[0]}"
    spread = f"sqrt((toxic + ordinary + 1) / ({words[1]} * {words[0]}))"
    marked = counted.where(f"{rate} - {usual} >= {SIGNIFICANT} * {spread} and {rate} >= {FREQUENT} * {usual}")
    heads = {bytes(row[0]) for row in marked.select("head").collect()}
    passages = arrow_map(seen.select("text", "toxic"), _passages(heads), "toxic int, passage binary")
    samples: tuple[list[bytes], list[bytes]] = ([], [])
    for label, passage in sorted((row[0], bytes(row[1])) for row in passages.collect()):
        if passage:
            samples[label].append(passage)
    ordinary = _dictionary([window for text in samples[0] for window in windows_of(text)], ORDINARY_BYTES)
    toxic = _dictionary(samples[1], TOXIC_BYTES, d=6, k=16)
    features = arrow_map(
        unseen.select("text", "toxic"), _features(ordinary, toxic), "toxic int, features array<double>"
    ).collect()
    columns = np.array([row[1] for row in features])
    targets = np.array([row[0] for row in features], float)
    weights, shift = fit_few(columns, targets)
    shift += _log_odds(share) - _log_odds(float(targets.mean()))
    return arrow_map(texts, _score(ordinary, toxic, weights, shift), schema)
