"""Lexical retrieval packing: sequences of documents that share rare tokens.

Documents are dealt to shards by a weighted min-hash of their tokens, so that documents
with the same rare tokens meet. Each shard is a BM25 index of its documents. A
seed document opens a window; the index returns the best unused neighbours, which
fill the window one after another. The one that no longer fits is cut there, and
its rest is the next seed, so no window but a shard's last has room left; that one is
cut at powers of two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.tasks import arrow_map, batch
from tallywright.sources.scratch import stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
#: Tokens of a shard; the memory of a packing task grows with it and with nothing else.
SHARD_TOKENS = 2_000_000
BM25_K1, BM25_B = 1.2, 0.75
#: Terms held by more than one in so many documents of a shard are frequent.
FREQUENT = 8
#: Neighbours sorted at a time.
BEST = 64

#: Texts are encoded so many bytes at a time.
SLICE_BYTES = 8 << 20
_PUNCTUATION = ".,;:!?|*#$%&)(\"'"
_PUNCTUATION_CLASS = re.escape(_PUNCTUATION)
#: Small letters that are one code point in any form, as a class of a pattern.
_LOWER = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Letters up to here have one code point in lower case and in composed form.
LATIN_END = "\u0180"
#: Stands for the end of a word; no UTF-8 text holds it.
_WORD_END = b"\xff"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer that remembers the ids of words.

    White space never is part of a token of this vocabulary, nor do letters and the
    punctuation behind them share one, so a text's ids are those of its words in turn.
    Words of Latin letters alone go straight to the merges; all else, and every text
    with a ``<|`` that may be a special token, goes through the whole tokenizer. The
    distinct words of many texts are encoded once, and their ids are dealt to all places.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.merge, self.ids = _merger(path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids end."""
        special = pc.match_substring(texts, "<|")
        rows = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        places = lists.flatten().dictionary_encode()
        ids, ends = _dealt_out(*self._words(places.dictionary), places.indices.to_numpy())
        offsets = lists.offsets.to_numpy()
        text_ends = np.concatenate([[0], ends])[offsets[1:] - offsets[0]]
        return _spliced(ids, text_ends, {row: self._whole(texts[row].as_py()) for row in rows.tolist()})

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and where each word's ids end.

        A word is one or two parts, and equal parts of words are encoded once.
        """
        plain = pc.match_substring_regex(words, f"^[{_LOWER}]+[{_PUNCTUATION_CLASS}]*$")
        cores = pc.if_else(plain, pc.ascii_rtrim(words, _PUNCTUATION), None).dictionary_encode()
        tails = pc.if_else(plain, pc.replace_substring_regex(words, f"^[{_LOWER}]+", ""), None).dictionary_encode()
        merged = [self.merge(core + _WORD_END) for core in cores.dictionary.cast(pa.binary()).to_pylist()]
        others = [_parts(word) if word else () for word in words.filter(pc.invert(plain)).to_pylist()]
        parts = {part: at for at, part in enumerate(dict.fromkeys(part for pair in others for part in pair))}
        first = [*map(len, merged)]
        pool = [self.ids[np.fromiter(chain.from_iterable(merged), np.int64, sum(first))]]
        found = [self._merged(part) for part in parts]
        odd = [part for part, own in zip(parts, found) if own is None]
        rest = self.tokenizer.encode_batch_fast([*tails.dictionary.to_pylist(), *odd], add_special_tokens=False)
        encoded = iter(rest[len(tails.dictionary) :])
        second = [np.array(x.ids, "<u2") for x in rest[: len(tails.dictionary)]]
        third = [np.array(next(encoded).ids, "<u2") if own is None else own for own in found]
        pool = np.concatenate([*pool, *second, *third]).astype("<u2")
        ends = np.cumsum(np.array([0, *first, *map(len, second), *map(len, third)], np.int64))
        # Two numbers of parts for each word; number 0 is no part at all.
        numbers = np.zeros((len(words), 2), np.int64)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        numbers[at, 0] = 1 + cores.indices.drop_null().to_numpy()
        numbers[at, 1] = 1 + len(first) + tails.indices.drop_null().to_numpy()
        low = 1 + len(first) + len(second)
        for row, pair in zip(np.flatnonzero(pc.invert(plain).to_numpy(zero_copy_only=False)).tolist(), others):
            for column, part in enumerate(pair):
                numbers[row, column] = low + parts[part]
        ids, ends = _dealt_out(pool, ends, numbers.ravel())
        return ids, ends[1::2]

    def _merged(self, part: str) -> np.ndarray | None:
        """The ids of a part of Latin letters, None of any other."""
        text = part.lower()
        if text.isalpha() and max(text) < LATIN_END:
            return self.ids[self.merge(text.encode() + _WORD_END)]
        return None


def _dealt_out(pool: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a pool by their numbers, one after another, and where each of them ends."""
    sizes = np.diff(ends, prepend=0)[numbers]
    until = np.cumsum(sizes)
    total = int(until[-1]) if len(until) else 0
    return pool[np.repeat(ends[numbers] - until, sizes) + np.arange(total)], until


def _spliced(
    ids: np.ndarray, ends: np.ndarray, others: dict[int, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of some texts, which have none so far, where they belong."""
    if not others:
        return ids, ends
    starts = np.concatenate([[0], ends[:-1]])
    pieces, low, added = [], 0, np.zeros(len(ends), np.int64)
    for row in sorted(others):
        pieces += [ids[low : starts[row]], others[row]]
        low = starts[row]
        added[row] = len(others[row])
    return np.concatenate([*pieces, ids[low:]]), ends + np.cumsum(added)


def _merger(path: str):
    """The vocabulary's merges as a function of a word's bytes, and the ids of its ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {value: chr(value) for value in plain}
    shown |= {value: chr(256 + at) for at, value in enumerate(sorted(set(range(256)) - shown.keys()))}
    value_of = {char: value for value, char in shown.items()}

    def raw(token: str) -> bytes:
        body = token.removesuffix(suffix)
        return bytes(value_of[char] for char in body) + (_WORD_END if body != token else b"")

    tokens = [(bytes([value]), vocabulary[shown[value]]) for value in range(255)]
    tokens.append((_WORD_END, 0))  # always merged with the byte before it
    tokens += [(bytes([value]) + _WORD_END, vocabulary[shown[value] + suffix]) for value in range(255)]
    for left, right in model["merges"]:
        tokens.append((raw(left) + raw(right), vocabulary[left + right]))
    ranks = {token: rank for rank, (token, _) in enumerate(tokens)}
    coder = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return coder._core_bpe.encode_single_piece, np.array([number for _, number in tokens], "<u2")


def _parts(word: str) -> tuple[str, ...]:
    """A word without the punctuation behind it, and that punctuation."""
    core = word.rstrip(_PUNCTUATION)
    if core and len(core) < len(word) and core[-1].isalpha():
        return core, word[len(core) :]
    return (word,)


def encoder(path: str | None) -> Encoder:
    """The worker's encoder for a vocabulary file, by default the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _races(size: int) -> np.ndarray:
    """Per token its place in an exponential race; late merges, which are rare, run faster."""
    draws = np.random.default_rng(7).random(size) + 1e-12
    times = -np.log(draws) / (np.arange(size) / size + 1e-3) ** 3
    return np.argsort(np.argsort(times)).astype(np.int32)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in turn, so many at a time that their words fit into little memory."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield texts.slice(low, high - low)
        low = high


def _with_end(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids as bytes, with the end id behind them."""
    texts = np.arange(len(ends))
    whole = np.empty(len(ids) + len(ends), "<u2")
    whole[ends + texts] = END_ID
    whole[np.arange(len(ids)) + np.repeat(texts, np.diff(ends, prepend=0))] = ids
    offsets = np.concatenate([[0], 2 * (ends + texts + 1)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])


def _encode(path: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        races = _races(max(coder.size, END_ID + 1))
        winners = np.argsort(races).astype(np.int32)
        holders = np.zeros(len(races), np.int64)
        for part in parts:
            names, low = part.column("doc_id"), 0
            for texts in _slices(part.column("text").cast(pa.string()).fill_null("")):
                ids, ends = coder.encode(texts)
                sizes = np.diff(ends, prepend=0)
                held = np.flatnonzero(sizes)
                keys = np.zeros(len(ends), np.int32)
                if len(held):
                    keys[held] = winners[np.minimum.reduceat(races[ids], (ends - sizes)[held])]
                    pairs = np.repeat(np.arange(len(ends), dtype=np.uint64) << np.uint64(16), sizes) | ids
                    pairs.sort()
                    first = np.append(True, pairs[1:] != pairs[:-1])
                    holders += np.bincount((pairs[first] & np.uint64(0xFFFF)).astype(np.int64), minlength=len(races))
                yield batch(
                    doc_id=names.slice(low, len(texts)),
                    ids=_with_end(ids, ends),
                    n=sizes + 1,
                    key=keys,
                    token=pa.nulls(len(texts), pa.int32()),
                    holders=pa.nulls(len(texts), pa.int64()),
                )
                low += len(texts)
        seen = np.flatnonzero(holders).astype(np.int32)
        empty = len(seen)
        yield batch(
            doc_id=pa.nulls(empty, pa.int64()),
            ids=pa.nulls(empty, pa.binary()),
            n=pa.nulls(empty, pa.int64()),
            key=pa.nulls(empty, pa.int32()),
            token=seen,
            holders=holders[seen],
        )

    return run


def _dealt(totals: list[tuple[int, int]], shard_tokens: int) -> list[tuple[int, int, int]]:
    """``key, first shard, number of shards`` for the token totals of all keys."""
    dealt, shard, room = [], 0, shard_tokens
    for key, total in sorted(totals):
        if total >= shard_tokens:
            pieces = -(-total // shard_tokens)
            dealt.append((key, shard + 1, pieces))
            shard, room = shard + 1 + pieces, shard_tokens
            continue
        if total > room:
            shard, room = shard + 1, shard_tokens
        dealt.append((key, shard, 1))
        room -= total
    return dealt


class Shard:
    """The BM25 index of some documents, and their packing into windows.

    The end id is no term. Terms that many documents hold have a weight for every
    document, all others a list of postings.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.ids = ids
        counted = [np.unique(own[:-1], return_counts=True) for own in ids]
        sizes = np.array([len(terms) for terms, _ in counted])
        terms = np.concatenate([terms for terms, _ in counted])
        counts = np.concatenate([counts for _, counts in counted]).astype(np.float32)
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        lengths = np.array([len(own) - 1 for own in ids], np.float32)
        damped = BM25_K1 * (1 - BM25_B + BM25_B * lengths / mean)
        weights = (idf[terms] * counts * (BM25_K1 + 1) / (counts + damped[rows])).astype(np.float32)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = terms
        held = np.bincount(terms, minlength=len(idf))
        frequent = np.flatnonzero(held * FREQUENT > len(ids))
        # A frequent term is held by one in FREQUENT documents, so this is as large as
        # FREQUENT times the postings it stands for.
        self.place = np.full(len(idf), -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        often = self.place[terms] >= 0
        self.dense = np.zeros((len(frequent), len(ids)), np.float32)
        self.dense[self.place[terms[often]], rows[often]] = weights[often]
        rare = np.flatnonzero(~often)
        order = rare[np.argsort(terms[rare], kind="stable")]
        self.rows, self.weights = rows[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.used = np.zeros(len(ids), bool)
        self.next_unused = 0

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of a seed."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        place = self.place[terms]
        wanted = np.zeros(len(self.dense), np.float32)
        wanted[place[place >= 0]] = 1
        found = wanted @ self.dense
        rare = terms[place < 0].astype(np.int64)
        low, sizes = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
        until = np.cumsum(sizes)
        if len(until) and until[-1]:
            at = np.repeat(low - until + sizes, sizes) + np.arange(until[-1])
            found = found + np.bincount(self.rows[at], self.weights[at], len(found))
        return found

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share terms with a seed, the best first."""
        scores = self.scores(seed)
        scores[self.used] = 0
        found = np.flatnonzero(scores > 0)
        while len(found):
            # Few neighbours fill a window: the best are sorted first.
            best = scores[found]
            if len(found) > BEST:
                least = np.partition(best, len(found) - BEST)[len(found) - BEST]
                first, found = found[best >= least], found[best < least]
            else:
                first, found = found, found[:0]
            yield from first[np.argsort(-scores[first], kind="stable")].tolist()

    def seed(self) -> int | None:
        while self.next_unused < len(self.used) and self.used[self.next_unused]:
            self.next_unused += 1
        return self.next_unused if self.next_unused < len(self.used) else None

    def pieces(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        """``document, start, length, sequence, offset`` of all pieces."""
        sequence, filled = 0, 0
        open_pieces: list[tuple[int, int, int]] = []
        current = self.seed()
        waiting: Iterator[int] | None = None
        while current is not None:
            self.used[current] = True
            start, size = 0, len(self.ids[current])
            while start < size:
                length = min(size - start, window - filled)
                open_pieces.append((current, start, length))
                start, filled = start + length, filled + length
                if filled == window:
                    at = 0
                    for document, first, count in open_pieces:
                        yield document, first, count, sequence, at
                        at += count
                    open_pieces, sequence, filled, waiting = [], sequence + 1, 0, None
            if not open_pieces:
                current = self.seed()
                continue
            if waiting is None:
                waiting = self.neighbours(open_pieces[0][0])
            current = next(waiting, None)
            if current is None:  # nothing else shares a term with the seed
                current = self.seed()
        yield from _by_powers(open_pieces, sequence)


def _by_powers(pieces, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The last pieces of a shard in sequences whose lengths are powers of two."""
    rest, left, offset = sum(length for _, _, length in pieces), 0, 0
    left = 1 << (rest.bit_length() - 1) if rest else 0
    for document, start, length in pieces:
        while length:
            taken = min(length, left - offset)
            yield document, start, taken, sequence, offset
            start, length, offset, rest = start + taken, length - taken, offset + taken, rest - taken
            if offset == left:
                sequence, offset = sequence + 1, 0
                left = 1 << (rest.bit_length() - 1) if rest else 0


def _pack(idf, mean: float, window: int):
    def packed(shard: int, documents: list, ids: list[bytes]) -> pa.RecordBatch:
        ids = [np.frombuffer(own, "<u2") for own in ids]
        index = Shard(ids, idf.value, mean)
        rows = list(index.pieces(window))
        table = np.array(rows, np.int64).reshape(-1, 5)
        sums = [
            zlib.crc32(ids[document][start : start + length].astype("<u4").tobytes())
            for document, start, length, _, _ in rows
        ]
        lengths = np.array([len(own) for own in ids], np.int64)
        return batch(
            doc_id=pa.array(documents, pa.int64()).take(pa.array(table[:, 0])),
            start=table[:, 1],
            length=table[:, 2],
            ids_crc32=np.array(sums, np.int64),
            doc_tokens=lengths[table[:, 0]],
            sequence_id=(shard << 24) + table[:, 3],
            offset=table[:, 4],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, documents, ids = None, [], []
        for part in parts:
            shards = part.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            names, own = part.column("doc_id").to_pylist(), part.column("ids").to_pylist()
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if shards[low] != current and ids:
                    yield packed(int(current), documents, ids)
                    documents, ids = [], []
                current = shards[low]
                documents += names[low:high]
                ids += own[low:high]
        if ids:
            yield packed(int(current), documents, ids)

    return run


def pack(
    documents: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Returns per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Each id of a document lies in exactly one piece.

    A null or empty text is the end id alone. Repeated rows are packed as often as
    they occur, a null ``doc_id`` stays null, other columns are ignored, an empty
    table gives no rows. A text of any length is cut over as many sequences as it
    needs.
    """
    spark = documents.sparkSession
    encoded = stage(
        arrow_map(
            documents.select("doc_id", "text"),
            _encode(tokenizer),
            "doc_id long, ids binary, n long, key int, token int, holders long",
        ),
        "encoded",
    )
    # Repeated rows of a key differ in their place alone, and are dealt to all its shards.
    rows = encoded.where("token is null").withColumn("place", F.monotonically_increasing_id())
    holders = encoded.where("token is not null").groupBy("token").agg(F.sum("holders")).collect()
    totals = rows.groupBy("key").agg(F.sum("n"), F.count("*")).collect()
    count, tokens = sum(x[2] for x in totals), sum(x[1] for x in totals)
    idf = np.full(65536, np.log(2 * count + 2), np.float32)
    for token, held in holders:
        idf[token] = np.log(1 + (count - held + 0.5) / (held + 0.5))
    dealt = spark.createDataFrame(
        _dealt([(x[0], x[1]) for x in totals], shard_tokens), "key int, first long, pieces long"
    )
    # One row for each token of the vocabulary at most.
    shards = rows.join(F.broadcast(dealt), "key").select(
        "doc_id", "ids", "n", F.expr("first + pmod(xxhash64(doc_id, n, place), pieces)").alias("shard")
    )
    ordered = shards.repartition("shard").sortWithinPartitions("shard", "doc_id", "n")
    return arrow_map(
        ordered.select("shard", "doc_id", "ids"),
        _pack(spark.sparkContext.broadcast(idf), tokens / max(count, 1), window),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
