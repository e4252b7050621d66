"""Transcripts read in splits and scanned in chunks, against plain versions over whole files."""

import random
import re

import pytest

from spanveil.operators import transcript

PIECES = ["Thread t1:\n", "Thread t2:\r\n", "Started: now | Thread: t3\n", "User (web):\n", "Agent (bot):\n", "User (web): My name is Orla Quist\n", "Agent (bot): Hi there\r", "=" * 20 + "\n", "hello\n", "é\x0bb\n", "\n", "\r\n", "a\u2028b\r\n", "[Intent: x]\n", "tail"]


def _plain_lines(data):
    text = re.sub("\r\n?", "\n", data.decode())
    return [x for x in re.split(rf"(?<=[{transcript.LINE_ENDS}])(?!\Z)", text) if x]


def _files(folder, n, seed):
    r, out = random.Random(seed), {}
    for i in range(n):
        data = "".join(r.choice(PIECES) for _ in range(r.randrange(40))).encode()
        data = (b"\xef\xbb\xbf" if i % 5 == 0 and data else b"") + data
        (folder / f"f{i}.txt").write_bytes(data)
        out[f"f{i}.txt"] = _plain_lines(data)
    return out


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    [spark.conf.set(k, v) for k, v in keys.items()]
    yield
    [spark.conf.set(k, v) for k, v in old.items()]


def test_lines_of_split_files(spark, tmp_path, small_splits):
    want = _files(tmp_path, 25, 4)
    rows = transcript.read_lines(spark, f"{tmp_path}/*.txt").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line_no)):
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line_no, r.line))
    assert got == {f: list(enumerate(x)) for f, x in want.items() if x}


def _plain_blocks(rows):
    out, thread, block, speaker = {}, None, 0, None
    for r in rows:
        thread = r.thread_mark if r.thread_mark is not None else thread
        if r.boundary:
            block, speaker = block + 1, r.role if thread is not None else None
        out[r.line_no] = (thread, block, speaker)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_blocks_over_chunks(spark, chunk):
    r = random.Random(6)
    rows = [(f, i, r.choice(PIECES)) for f in ("a", "b", None) for i in range(60)]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string")
    classified = transcript.classify(lines)
    got = {f: {x.line_no: (x.thread, x.block, x.speaker) for x in transcript.blocks(classified, chunk).collect() if x.file == f} for f in ("a", "b", None)}
    told = classified.collect()
    assert got == {f: _plain_blocks(sorted((x for x in told if x.file == f), key=lambda x: x.line_no)) for f in ("a", "b", None)}
    assert transcript.blocks(classified.where("false"), chunk).count() == 0


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    unit = "User (web): call 555 010 2003\nsome more words of the same turn\n"
    (tmp_path / "one.txt").write_text("Thread t:\n" + unit * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        lines = transcript.read_lines(spark, str(tmp_path / "one.txt"))
        assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 10
        told = transcript.blocks(transcript.classify(lines)).selectExpr("count(*) n", "max(line_no) m", "max(block) b", "count(distinct line_no) d", "count_if(thread = 't' or thread_mark = 't') t").first()
        assert tuple(told) == (400_001, 400_000, 200_001, 400_001, 400_001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
