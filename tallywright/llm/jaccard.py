"""N-gram Jaccard join: subsets of small sets, inverted lists of large ones.

Documents whose sets of word shingles are alike are linked, and links are followed to
groups. The join is size-aware:

* A *small* set enumerates, for each size a partner may have, all its subsets of
  the least overlap that makes the pair alike. Two small sets are alike exactly if
  they share such a subset.
* A *large* set scans inverted lists. Shingles are ordered from rare to frequent, by a
  sketch that counts all shingles of the corpus in a fixed number of counters; two
  alike sets share one of their first shingles, so only those are posted, and what
  is frequent comes last and is hardly ever posted.
* The boundary is the largest size up to which subsets cost less than scanning
  the lists, both estimated from the sketch.

Equal sets are one class. A list isn't expanded into all its pairs: first
each member is compared with the list's pivot, the one with the fewest rare shingles,
which is the least altered of a group of copies and so joins nearly all of it. Then
only members of different groups are compared, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallywright.llm.components import components
from tallywright.llm.tasks import arrow_map, batch, give_back, named, shingles_of, signed, texts_of
from tallywright.sources.scratch import stage

WORDS = 5
#: Counters of the frequency sketch, a power of two.
SKETCH = 1 << 20
#: Counters that are added up together.
CHUNK = 1 << 14
#: Sets of more shingles are always large.
LARGEST_SMALL = 16
#: A shingle expected in more sets than this above the average has its list split.
HOT_LIST = 20_000
#: Such a list is split into the square of this many parts.
HOT_SIDE = 8
HOT_SPLIT = HOT_SIDE * HOT_SIDE
#: A set that more than one in this many rows has is joined back by broadcast.
HEAVY_MARKS = 1000
#: Members of a pivot that one task compares.
PIVOT_MEMBERS = 512
#: Postings that a task gathers before it packs them by bucket.
HELD_BACK = 1 << 20
#: Postings of a bucket, on average; a reading task holds one bucket at a time.
BUCKET = 1 << 20
#: There are at least 2 to this many buckets.
BUCKET_BITS = 10
#: Bits that tell which texts a join can't need, a power of two from 32,768.
NEEDED_BITS = 1 << 26
#: Rows of an Arrow batch of lists.
LISTED_ROWS = 1 << 18
POSTING = np.dtype([("gram", "u8"), ("mark", "i8"), ("place", "i8"), ("salt", "u1")])
LISTED = np.dtype([*POSTING.descr, ("head", "i8"), ("head_place", "i8")])


def least_overlap(left: int, right: int) -> int:
    """Fewest common elements with which 100 * intersection >= 75 * union."""
    return -(-3 * (left + right) // 7)


def posted(size: int) -> int:
    """How many of its rarest shingles a set posts."""
    return size - -(-3 * size // 4) + 1


def partner_sizes(size: int) -> range:
    return range(-(-3 * size // 4), 4 * size // 3 + 1)


def subset_count(size: int, boundary: int) -> int:
    return sum(comb(size, least_overlap(size, other)) for other in partner_sizes(size) if other <= boundary)


def boundary_of(list_length: float) -> int:
    """The size up to which subsets cost less than lists of an expected length."""
    boundary = 0
    for size in range(1, LARGEST_SMALL + 1):
        if subset_count(size, size) > posted(size) * (1 + list_length):
            break
        boundary = size
    return boundary


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: what is always zero lies together."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(dtype).ravel()


#: A column that documents don't have.
_SET_MARK = "_tallywright_set_mark"


def _measure(shingle_words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for part in parts:
            sizes, marks = [], []
            for text in texts_of(part):
                grams = shingles_of(text, shingle_words)
                sizes.append(len(grams))
                marks.append(_mark(grams))
                np.add.at(sketch, grams & np.uint64(SKETCH - 1), 1)
            yield batch(
                doc_id=part.column("doc_id"),
                n_shingles=np.array(sizes, np.int64),
                mark=signed(np.array(marks, np.uint64)),
                chunk=pa.nulls(len(sizes), pa.int32()),
                held=pa.nulls(len(sizes), pa.binary()),
            )
        chunks = sketch.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        gone = pa.nulls(len(used), pa.int64())
        held = pa.array([_packed_counts(chunks[at]) for at in used], pa.binary())
        yield batch(doc_id=gone, n_shingles=gone, mark=gone, chunk=used.astype(np.int32), held=held)

    return run


def _mark(grams: np.ndarray) -> int:
    """The hash of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes())


def _with_mark(shingle_words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = [_mark(shingles_of(text, shingle_words)) for text in texts_of(part)]
            columns = {name: part.column(name) for name in part.schema.names}
            yield batch(**columns, **{_SET_MARK: signed(np.array(marks, np.uint64))})

    return run


def _packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(counts))


def _counts(packed: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(packed), np.int64)


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk of counters; the sum of each chunk."""
    sums: dict[int, np.ndarray] = {}
    for part in parts:
        for chunk, held in zip(part.column("chunk").to_pylist(), part.column("held").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + _counts(held)
    packed = pa.array([_packed_counts(counts) for counts in sums.values()], pa.binary())
    yield batch(chunk=pa.array(list(sums), pa.int32()), held=packed)


def _small_keys(grams: np.ndarray, boundary: int) -> Iterator[int]:
    """A hash for each subset with which a partner of some size is alike."""
    size, bodies = len(grams), [gram.tobytes() for gram in grams]
    for other in partner_sizes(size):
        if other <= boundary:
            pair = (min(size, other) << 8) + max(size, other)
            for subset in combinations(bodies, least_overlap(size, other)):
                yield xxhash.xxh3_64_intdigest(b"".join(subset), seed=pair)


def pack_postings(rows: np.ndarray) -> bytes:
    """Postings sorted by shingle in fewer bytes: steps between shingles, small numbers as planes."""
    steps = np.diff(rows["gram"], prepend=np.uint64(0))
    raw = _planes(steps) + _planes(rows["place"].copy()) + rows["salt"].tobytes() + rows["mark"].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_postings(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = len(raw) // POSTING.itemsize
    rows = np.empty(count, POSTING)
    rows["gram"] = np.cumsum(_from_planes(raw[: 8 * count], np.uint64), dtype=np.uint64)
    rows["place"] = _from_planes(raw[8 * count : 16 * count], np.int64)
    rows["salt"] = np.frombuffer(raw, np.uint8, count, 16 * count)
    rows["mark"] = np.frombuffer(raw, np.int64, count, 17 * count)
    return rows


def _dealt(rows: np.ndarray, bucket_bits: int) -> pa.RecordBatch:
    """One packed row for each bucket that ``rows`` touch; a split list goes to several buckets."""
    buckets = (rows["gram"] >> np.uint64(64 - bucket_bits)).astype(np.int64) + rows["salt"]
    buckets &= (1 << bucket_bits) - 1
    order = np.lexsort((rows["gram"], buckets))
    rows, buckets = rows[order], buckets[order]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    packed = [pack_postings(own) for own in np.split(rows, starts[1:])] if len(rows) else []
    return batch(bucket=buckets[starts].astype(np.int32), packed=pa.array(packed, pa.binary()))


def _post(sketch, shingle_words: int, boundary: int, hot: float, bucket_bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        waiting, held_back = [], 0

        def postings(grams, mark: int, place, salt) -> None:
            nonlocal held_back
            rows = np.empty(len(grams), POSTING)
            rows["gram"], rows["place"], rows["salt"] = grams, place, salt
            rows["mark"] = signed(np.array([mark], np.uint64))[0]
            waiting.append(rows)
            held_back += len(rows)

        for part in parts:
            for text in texts_of(part):
                grams = shingles_of(text, shingle_words)
                size = len(grams)
                mark = xxhash.xxh3_64_intdigest(grams.tobytes())
                if not size or mark in seen:
                    continue
                seen.add(mark)
                if size <= boundary:
                    postings(np.array(list(_small_keys(grams, boundary)), np.uint64), mark, size << 32, 0)
                if partner_sizes(size)[-1] > boundary:
                    held = counts[grams & np.uint64(SKETCH - 1)]
                    order = np.lexsort((grams, held))[: posted(size)]
                    places = (size << 32) + np.arange(len(order))
                    salts = np.where(held[order] > hot, 1 + mark % HOT_SPLIT, 0)
                    postings(grams[order], mark, places, salts)
                if held_back >= HELD_BACK:
                    yield _dealt(np.concatenate(waiting), bucket_bits)
                    waiting, held_back = [], 0
        if waiting:
            yield _dealt(np.concatenate(waiting), bucket_bits)

    return run


def lists_of(rows: np.ndarray) -> np.ndarray:
    """The postings of lists (or parts of split ones) that can hold a pair, each with its pivot.

    A list is the postings of one shingle and salt; its pivot is the member with the fewest
    rarer shingles, the lowest mark of several. Repeated postings count once.
    """
    rarer = rows["place"] & 0xFFFFFFFF
    order = np.lexsort((rows["mark"], rarer, rows["salt"], rows["gram"]))
    rows = rows[order]
    rows = rows[np.append(True, rows[1:] != rows[:-1])[: len(rows)]]
    new = np.append(True, (rows["gram"][1:] != rows["gram"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1]))
    starts = np.flatnonzero(new[: len(rows)])
    lengths = np.diff(np.append(starts, len(rows)))
    heads = rows[np.repeat(starts, lengths)]
    kept = (np.repeat(lengths, lengths) > 1) | (rows["salt"] > 0)
    listed = np.empty(int(kept.sum()), LISTED)
    for name in POSTING.names:
        listed[name] = rows[name][kept]
    listed["head"], listed["head_place"] = heads["mark"][kept], heads["place"][kept]
    return listed


def _list(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket; the lists of each bucket, of which one at a time is held."""

    def finished(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        listed = lists_of(np.concatenate([unpack_postings(own) for own in packed]))
        for start in range(0, len(listed), LISTED_ROWS):
            own = listed[start : start + LISTED_ROWS]
            columns = {name: np.ascontiguousarray(own[name]) for name in LISTED.names}
            yield batch(**columns | {"gram": signed(columns["gram"]), "salt": columns["salt"].astype(np.int32)})

    bucket, packed = None, []
    for part in parts:
        for at, own in zip(part.column("bucket").to_pylist(), part.column("packed").to_pylist(), strict=True):
            if at != bucket and packed:
                yield from finished(packed)
                packed = []
            bucket = at
            packed.append(own)
    if packed:
        yield from finished(packed)


def _may_link(left: str, right: str) -> F.Column:
    """Whether two postings of one shingle can belong to alike sets, by size and place."""
    sizes = f"shiftright({left}, 32)", f"shiftright({right}, 32)"
    rest = f"least({sizes[0]} - ({left} & 4294967295), {sizes[1]} - ({right} & 4294967295))"
    return F.expr(
        f"4 * least({sizes[0]}, {sizes[1]}) >= 3 * greatest({sizes[0]}, {sizes[1]}) "
        f"and 7 * {rest} >= 3 * ({sizes[0]} + {sizes[1]})"
    )


def _compare(shingle_words: int, percent: int):
    """Rows by pivot, the pivot's own text first; the members that are alike with it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.empty(0, np.uint64)
        for part in parts:
            left, right = [], []
            pivots, marks = part.column("pivot").to_pylist(), part.column("mark").to_pylist()
            for mark, at, text in zip(marks, pivots, texts_of(part), strict=True):
                grams = shingles_of(text, shingle_words)
                if signed(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], np.uint64))[0] != mark:
                    continue  # another row with the same doc_id
                if mark == at:
                    pivot, own = mark, grams
                elif pivot == at:
                    common = len(np.intersect1d(own, grams, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(grams) - common):
                        left.append(at)
                        right.append(mark)
            yield batch(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return run


def _may_need(bits):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.column("bit").to_numpy()
            kept = (bits.value[at >> 3] >> (at & 7)) & 1
            yield part.select(["doc_id", "text"]).filter(pa.array(kept.astype(bool)))

    return run


def _texts_of(
    pairs: DataFrame, classes: DataFrame, texts: DataFrame
) -> tuple[DataFrame, DataFrame, Broadcast]:
    """``mark, doc_id`` of the sets in ``pairs``, ``doc_id, text`` of few other rows than these, and the bitmap.

    Most texts are in no pair. A bitmap of fixed size over the hashes of those that are
    keeps the others from being shuffled; the join that follows is exact.
    """
    marks = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    needed = stage(marks.join(classes.select("mark", "doc_id"), "mark"), "needed")
    bit = F.expr(f"pmod(xxhash64(doc_id), {NEEDED_BITS}L)").alias("bit")
    # Buckets and positions count from 1.
    chunks = (
        needed.select(bit)
        .groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("chunk"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    )
    bits = np.zeros((NEEDED_BITS >> 15, 4096), np.uint8)
    table = chunks.toArrow()  # at most NEEDED_BITS
    for chunk, own in zip(table.column("chunk").to_pylist(), table.column("bits").to_pylist(), strict=True):
        bits[chunk - 1] = np.frombuffer(own, np.uint8)
    del table
    give_back()
    shared = pairs.sparkSession.sparkContext.broadcast(bits.ravel())
    rows = texts.select(F.col("doc_id").cast("long"), "text", bit)
    return needed, arrow_map(rows, _may_need(shared), "doc_id long, text string"), shared


def _alike(pairs: DataFrame, classes: DataFrame, documents: DataFrame, shingle_words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike, by the whole texts of ``documents``.

    The members of a pivot are dealt to groups of bounded size, each with the pivot's text.
    """
    needed, texts, bits = _texts_of(pairs, classes, documents)
    sizes = pairs.groupBy("a").agg(F.expr(f"ceil(count(*) / {PIVOT_MEMBERS})").alias("groups"))
    members = pairs.join(sizes, "a").select(
        F.col("a").alias("pivot"),
        F.col("b").alias("mark"),
        F.expr("pmod(xxhash64(b), groups)").alias("part"),
    )
    heads = sizes.select(
        F.col("a").alias("pivot"),
        F.col("a").alias("mark"),
        F.explode(F.expr("sequence(0L, groups - 1)")).alias("part"),
    )
    rows = (
        members.union(heads)
        .join(needed, "mark")
        .join(texts, "doc_id")
        .withColumn("member", F.expr("pivot <> mark"))
        .repartition("pivot", "part")
        .sortWithinPartitions("pivot", "part", "member", "mark")
    )
    alike = arrow_map(rows.select("pivot", "mark", "text"), _compare(shingle_words, 75), "a long, b long")
    links = stage(alike, "links")
    bits.destroy()
    return links


def _first() -> F.Column:
    """A list's pivot: the member with the fewest rarer shingles, the lowest mark of several."""
    return F.min(F.struct(F.expr("place & 4294967295").alias("rarer"), "mark", "place"))


def _apart(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists that hold members of different groups, with the group of each and the pivot's.

    A split list stays split: what is known of it goes to each of its parts.
    """
    labelled = lists.join(groups, lists.mark == groups.node, "left").selectExpr(
        "gram", "salt", "mark", "place", "coalesce(component, mark) as label"
    )
    parts = labelled.groupBy("gram", "salt").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.expr("min(struct(place & 4294967295 as rarer, mark, label))").alias("pivot"),
    )
    parts = stage(parts, "parts")
    several = (
        parts.groupBy("gram")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("pivot").alias("pivot"))
        .where("low <> high")
        .selectExpr("gram", "pivot.label as usual")
    )
    known = parts.select("gram", "salt").join(several, "gram")
    return stage(labelled.join(known, ["gram", "salt"]), "apart")


def _across(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list and different groups that sizes and places allow to be alike.

    The larger set seeks the smaller one by size: what its place leaves room for. The smaller
    set can only be found at a place among its first seventh. Members of the pivot's group
    aren't held against each other.

    The parts of a split list are a square of cells: a seeker goes to the cells of its row, a
    target to those of its column, so any two meet in one cell, and no task holds the list.
    """
    rows = apart.selectExpr(
        "*", "shiftright(place, 32) as size", "place & 4294967295 as rarer", "label = usual as common"
    )
    cells = f"if(salt > 0, sequence(0, {HOT_SIDE - 1}), array(0))"
    row_of, column_of = (f"if(salt > 0, cast((salt - 1) {sign} {HOT_SIDE} as int), 0)" for sign in ("div", "%"))
    step = "cast(floor(log2({}) * 8) as int)"
    reach = "least(size, (4 * size - 7 * rarer) div 3)"
    least = "(3 * size + 3) div 4"
    seekers = rows.where(f"{reach} >= {least}").selectExpr(
        "gram", "mark as a", "place as a_place", "label as a_label", "common",
        f"{row_of} as cell_row", f"{cells} as cell_columns",
        f"explode(sequence({step.format(least)}, {step.format(reach)})) as step",
    ).withColumn("cell_column", F.explode("cell_columns")).drop("cell_columns")
    targets = rows.where("7 * rarer <= size").selectExpr(
        "gram", "mark as b", "place as b_place", "label as b_label", "common as b_common",
        f"{step.format('size')} as step", f"{column_of} as cell_column", f"explode({cells}) as cell_row",
    )
    both = None
    for left, right in (("not common", "true"), ("common", "not b_common")):
        joined = (
            seekers.where(left).drop("common")
            .join(targets.where(right).drop("b_common"), ["gram", "step", "cell_row", "cell_column"])
            .where("a_label <> b_label")
            .where(_may_link("a_place", "b_place"))
            .selectExpr("least(a, b) as a", "greatest(a, b) as b")
        )
        both = joined if both is None else both.union(joined)
    return both.distinct()


def similar_groups(documents: DataFrame, shingle_words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, mark, component_id, group_mark`` for every row of ``documents``.

    ``mark`` is the hash of the row's set; rows of one mark have equal sets.
    ``group_mark`` is the smallest mark that links reach, ``component_id`` the smallest ``doc_id`` that links reach.

    A null or empty text has no shingles and is linked with nothing; its component
    is its own ``doc_id``. Repeated rows each give a row; a null ``doc_id`` stays null
    and is never the smallest unless there is no other. Other columns are ignored,
    an empty table gives no rows. Texts of any length are used whole.

    These are components only: pairs already known to be in one component aren't compared,
    so neither all alike pairs nor their number is known. Rows with a null ``doc_id`` do not
    link: two texts that are alike only with such a row's text stay apart.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    measured = stage(
        arrow_map(
            texts, _measure(shingle_words), "doc_id long, n_shingles long, mark long, chunk int, held binary"
        ),
        "measured",
    )
    rows = measured.where("chunk is null").select("doc_id", "n_shingles", "mark")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("mark").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    # One row per chunk of counters: SKETCH numbers at any size.
    held = measured.where("chunk is not null").select("chunk", "held").repartition("chunk")
    sketch = np.zeros(SKETCH, np.int64)
    for row in arrow_map(held, _add_up, "chunk int, held binary").collect():
        sketch[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = _counts(bytes(row.held))
    total = max(int(sketch.sum()), 1)
    usual = float(np.median(sketch))
    excess = float((sketch * np.maximum(sketch - usual - 6 * np.sqrt(usual), 0)).sum()) / total
    boundary = boundary_of(excess)
    shared = spark.sparkContext.broadcast(sketch)
    # A set posts about a quarter of its shingles.
    bucket_bits = max(BUCKET_BITS, (total // (4 * BUCKET)).bit_length())
    postings = arrow_map(
        texts,
        _post(shared, shingle_words, boundary, usual * 2 + HOT_LIST, bucket_bits),
        "bucket int, packed binary",
    )
    lists = stage(
        arrow_map(
            postings.repartition("bucket").sortWithinPartitions("bucket"),
            _list,
            "gram long, mark long, place long, salt int, head long, head_place long",
        ),
        "lists",
    )
    # Of a list that is split, the pivots of its parts are compared with one of them.
    heads = lists.where("salt > 0").selectExpr("gram", "head as mark", "head_place as place").distinct()
    tops = heads.withColumn("top", _first().over(Window.partitionBy("gram")))
    tops = tops.where("top.mark <> mark").where(_may_link("top.place", "place"))
    stars = (
        lists.where("mark <> head")
        .where(_may_link("place", "head_place"))
        .selectExpr("head as a", "mark as b")
        .union(tops.selectExpr("top.mark as a", "mark as b"))
    )
    # The lists are written, and nothing reads the counts any more.
    shared.destroy()
    del sketch, shared
    links = _alike(stage(stars.distinct(), "stars"), classes, texts, shingle_words)
    # What the pivots didn't join: members of different groups in one list.
    apart = _apart(lists, components(links))
    across = _across(apart)
    links = links.union(_alike(stage(across, "across"), classes, texts, shingle_words))
    groups = components(links)
    named = (
        groups.join(classes, groups.node == classes.mark)
        .groupBy("component")
        .agg(F.min("doc_id").alias("group_id"))
    )
    grouped = groups.join(named, "component").selectExpr("node as mark", "component", "group_id")
    known = stage(
        classes.join(grouped, "mark", "left").selectExpr(
            "mark",
            "copies",
            "coalesce(group_id, doc_id) as component_id",
            "coalesce(component, mark) as group_mark",
        ),
        "known",
    )
    return _named(rows, known)


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Every row with its component. Rows of a set with many copies aren't gathered in one task.

    Such sets are fewer than ``HEAVY_MARKS``, as each has its share of all rows.
    """
    total = known.agg(F.sum("copies")).first()[0] or 0
    heavy = known.where(F.col("copies") * HEAVY_MARKS > total).drop("copies")
    light = known.where(F.col("copies") * HEAVY_MARKS <= total).drop("copies")
    filled = rows.where("n_shingles > 0")
    bare = rows.where("n_shingles = 0").selectExpr("*", "doc_id as component_id", "mark as group_mark")
    often = filled.join(F.broadcast(heavy), "mark")
    seldom = filled.join(F.broadcast(heavy.select("mark")), "mark", "left_anti").join(light, "mark", "left")
    columns = [
        "doc_id",
        "n_shingles",
        "mark",
        "coalesce(component_id, doc_id) as component_id",
        "coalesce(group_mark, mark) as group_mark",
    ]
    parts = [part.selectExpr(*columns) for part in (often, seldom, bare)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def keep_one_of_each_group(documents: DataFrame, shingle_words: int = WORDS) -> DataFrame:
    """The documents without those that are alike with an earlier one of their group.

    Of each group the row with the smallest ``doc_id`` stays, once. Rows without
    shingles stay, once per ``doc_id``. A row with a null ``doc_id`` stays. Columns stay as
    they are. Texts that share a ``doc_id`` but aren't alike stay or go each by itself.
    """
    groups = similar_groups(documents, shingle_words)
    kept = (
        groups.where("n_shingles = 0 or doc_id = component_id")
        .groupBy("doc_id", "group_mark")
        .agg(F.min("mark").alias(_SET_MARK))
        .select("doc_id", _SET_MARK)
    )
    known = documents.where("doc_id is not null")
    schema = StructType([*known.schema.fields, StructField(_SET_MARK, LongType())])
    rows = (
        arrow_map(known, _with_mark(shingle_words), schema)
        .join(kept, ["doc_id", _SET_MARK], "left_semi")
        .dropDuplicates(["doc_id", _SET_MARK])
        .select(*map(named, documents.columns))
    )
    nameless = documents.where("doc_id is null")
    return rows.unionAll(nameless)
