"""Numbered lines to embed."""

import pytest

from tallyframe.sources.examples import read_embedding_lines


def test_numbers_follow_files_and_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join([f"line {i}" if i % 3 else "" for i in range(500)]) + "\n")
    (tmp_path / "b.txt").write_text('{"id": "own", "text": "x"}\n{"text": "y"}\nplain\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.id: r.text for r in read_embedding_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {str(i): f"line {i}" if i % 3 else "" for i in range(500)} | {"own": "x", "501": "y", "502": "plain"}


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "a.txt").write_text("{broken\n")
    with pytest.raises(Exception):
        read_embedding_lines(spark, str(tmp_path / "a.txt")).collect()
