"""Content identity in order: what changes it and what does not."""

import hashlib

import pytest

from tallywright.contracts import TEXT, SourceContract
from tallywright.sources.identity import source_identity

LEDGER = SourceContract(key="t", filename="t.csv", id_column="a", types={"a": TEXT})


def identity(spark, tmp_path, lines, block=4, end="\n", **conf):
    folder = tmp_path / f"d{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    (folder / "t.csv").write_text("\n".join(lines) + end)
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        rows = source_identity(spark, str(folder), [LEDGER], block).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return rows[0] if rows else None


def test_the_tree_is_one_of_blocks(spark, tmp_path):
    lines = ["a", *[str(at) for at in range(20)]]
    level = [str(int(hashlib.md5(line.encode()).hexdigest()[:15], 16)) for line in lines]
    while len(level) > 1:
        level = [hashlib.md5(",".join(level[at : at + 4]).encode()).hexdigest() for at in range(0, len(level), 4)]
    row = identity(spark, tmp_path, lines)
    assert (row.source_key, row.line_count, row.ordered_digest) == ("t", 21, level[0])
    assert row.byte_size == len("\n".join(lines)) + 1


def test_swapped_lines_are_found_and_splits_do_not_matter(spark, tmp_path):
    lines = ["a", *[f"{at},{at * at % 17}" for at in range(400)]]
    row = identity(spark, tmp_path, lines)
    split = {"spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "1b"}
    assert identity(spark, tmp_path, lines, **split) == row
    swapped = [*lines[:200], lines[201], lines[200], *lines[202:]]
    for changed in (swapped, lines[:-1], [*lines, lines[3]], [*lines[:-1], "x"]):
        assert identity(spark, tmp_path, changed).ordered_digest != row.ordered_digest


def test_a_missing_source_has_no_identity(spark, tmp_path):
    assert source_identity(spark, str(tmp_path / "nowhere"), [LEDGER]).collect() == []


@pytest.mark.parametrize("lines", [["a"], ["a", "", ""]])
def test_few_lines(spark, tmp_path, lines):
    assert identity(spark, tmp_path, lines).line_count == len(lines)
