"""Transcript files: lines classified, threads carried forward, blocks redacted by thread."""

from __future__ import annotations

import argparse
import json
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.operators import allowlist, names
from spanveil.operators.folds import fold
from spanveil.operators.vault import Vault
from spanveil.shared import settled

# The line grammar.
STARTED = r"^Started:\s+.*\|\s+Thread:\s+(\S+)\s*$"
THREAD = r"^Thread\s+(\S+):\s*$"
HEADER = r"^(User|Agent)\s+\([^)]*\):\s*$"
INLINE = r"^((?:User|Agent)\s+\([^)]*\):)\s*(.*\S)\s*$"
RULE = r"^(?:={20}|-{10,}\s*$)"
LINE_ENDS = r"\n\x0B\f\x1C-\x1E\x85\u2028\u2029"
# End of the fixed values.


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): all lines of text files, with their line ends.

    CR and CRLF become LF; the other separators of lines of Unicode end a line
    too. Files are read in splits, each by a task; a line's number is its place in
    its split plus the lines of the splits before. Whether a file's last line has
    an end shows in the file's size.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.col("_metadata.file_size").alias("_size"), "value", F.monotonically_increasing_id().alias("_at"))
    raw = settled(raw)
    place = F.struct("_split", "_at")
    over = F.sum(F.octet_length("value") + 1) - F.max("_size")  # 1 without a last line end; 3 less with a byte order mark, which the reader takes off
    per_file = raw.groupBy("file").agg(over.alias("_over"), F.min(place).alias("_begin"), F.max(place).alias("_last"))
    mark = F.when(F.col("_over").isin(-3, -2) & (F.col("_begin") == place), "\ufeff").otherwise("")
    end = F.when(F.col("_over").isin(1, -2) & (F.col("_last") == place), "").otherwise("\n")
    ended = raw.join(per_file, "file").withColumn("text", F.concat(mark, "value", end))
    lines = F.filter(F.split(F.regexp_replace("text", r"\r\n?", "\n"), rf"(?<=[{LINE_ENDS}])(?!\z)"), lambda x: x != "")
    parts = ended.select("file", "_split", "_at", lines.alias("lines"))
    inside = Window.partitionBy("file", "_split").orderBy("_at")
    placed = parts.withColumn("_before", F.sum(F.size("lines")).over(inside) - F.size("lines"))
    splits = parts.groupBy("file", "_split").agg(F.sum(F.size("lines")).alias("_n"))
    offsets = splits.withColumn("_first", F.sum("_n").over(Window.partitionBy("file").orderBy("_split")) - F.col("_n")).drop("_n")
    return placed.join(offsets, ["file", "_split"]).select("file", F.col("_before").alias("_b"), "_first", F.posexplode("lines").alias("_i", "line")).select("file", (F.col("_first") + F.col("_b") + F.col("_i")).cast("int").alias("line_no"), "line")


def classify(lines: DataFrame) -> DataFrame:
    """Adds thread_mark, role, prefix, inline, boundary and skipped to (file, line_no, line). A null line is an empty one."""
    line = F.rtrim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\n$", ""))
    mark = F.coalesce(F.nullif(F.regexp_extract(line, STARTED, 1), F.lit("")), F.nullif(F.regexp_extract(line, THREAD, 1), F.lit("")))
    inline, header = line.rlike(INLINE), line.rlike(HEADER)
    body = F.trim(line)
    return lines.select(
        "*",
        mark.alias("thread_mark"),
        F.when(inline | header, F.regexp_extract(line, r"^(User|Agent)", 1)).alias("role"),
        F.when(inline & ~header, F.regexp_extract(line, INLINE, 1)).alias("prefix"),
        F.when(inline & ~header, F.regexp_extract(line, INLINE, 2)).alias("inline"),
        (mark.isNotNull() | inline | header | line.rlike(RULE)).alias("boundary"),
        ((body == "") | F.startswith(body, F.lit("[Intent:")) | F.startswith(body, F.lit("[Area:"))).alias("skipped"),
    )


#: Lines of a file that one task looks at in order.
CHUNK = 100_000


def carried(lines: DataFrame, value: Column, name: str, total: bool = False) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null up to each line of its file, or their running sum.

    Chunks of a file are scanned each by itself; what a chunk ends with is
    combined over the chunks, a row each, and handed to the chunks after it.
    """
    inside = Window.partitionBy("file", "_chunk").orderBy("line_no")
    after = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_v", value)
    own = F.sum("_v") if total else F.last("_v", ignorenulls=True)
    end = F.sum("_v") if total else F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no")))
    ends = marked.groupBy("file", "_chunk").agg(end.alias("_e"))
    before = F.sum("_e").over(after) if total else F.last("_e", ignorenulls=True).over(after)
    ends = ends.select(F.col("file").alias("_file"), F.col("_chunk").alias("_of"), before.alias("_before"))
    joined = marked.withColumn("_own", own.over(inside)).join(ends, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_chunk") == F.col("_of")))
    both = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)) if total else F.coalesce("_own", "_before")
    return joined.withColumn(name, both).drop("_v", "_own", "_file", "_of", "_before")


def blocks(classified: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds thread (carried forward), block, and speaker: lines up to the next boundary share a block, and the role of its first line if that stands in a thread."""
    out = classified.withColumn("_chunk", F.coalesce(F.floor(F.col("line_no") / chunk), F.lit(-1)))  # lines without a number come first
    out = carried(carried(out, F.col("thread_mark"), "thread"), F.col("boundary").cast("int"), "block", total=True)
    head = F.when(F.col("boundary"), F.struct(F.when(F.col("thread").isNotNull(), F.col("role")).alias("role")))
    return carried(out, head, "_head").withColumn("speaker", F.col("_head.role")).drop("_head", "_chunk")


def redact(lines: DataFrame, mode: str = "user-only", terms: list[str] | None = None) -> DataFrame:
    """(file, line_no, line, redacted, tokens, processed): lines in the order of their file.

    A thread of a file has one vault. The previous assistant message is the last
    agent block of the thread, as it was written. ``tokens`` counts distinct tokens
    of a line, ``processed`` whether it was looked at. A null line stays null.
    """
    if mode not in ("user-only", "both"):
        raise ValueError("mode must be user-only or both")
    allow = names.terms_of(terms)
    schema = T.StructType([lines.schema["file"], lines.schema["line_no"], *T._parse_datatype_string("line string, redacted string, tokens int, processed boolean")])
    step = lambda thread, row: (thread.line(row, mode, allow),)
    return fold(blocks(classify(lines)), ["file", "thread"], [F.col("line_no")], _Thread, step, schema)


class _Thread:
    """A thread's vault, its last agent block, and the block at hand."""

    def __init__(self) -> None:
        self.vault, self.previous = Vault(), ""
        self.block: int | None = None
        self.speaker: str | None = None
        self.head, self.said = "", []

    def _begin(self, row: dict) -> None:
        if self.speaker == "Agent":
            self.previous = "\n".join(x for x in (self.head.strip(), "".join(self.said).strip()) if x)
        self.block, self.speaker = row["block"], row["speaker"]
        self.head, self.said = row["inline"] or "", []

    def line(self, row: dict, mode: str, allow: frozenset[str]) -> dict:
        if row["block"] != self.block:
            self._begin(row)
        line, inline = row["line"] or "", row["inline"]
        new, n, seen = row["line"], 0, False
        if inline is not None or not row["boundary"]:
            if inline is None:
                self.said.append(line)
            seen = self.speaker is not None and (self.speaker == "User" or mode == "both")
            if seen and (inline is not None or not row["skipped"]):
                got = names.redact(inline if inline is not None else line.removesuffix("\n"), self.vault, self.previous, allow)
                new, n = (f"{row['prefix']} " if inline is not None else "") + got.text + ("\n" if line.endswith("\n") else ""), len(got.replacements)
        return {"file": row["file"], "line_no": row["line_no"], "line": row["line"], "redacted": new, "tokens": n, "processed": seen}


def stats(lines: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row: threads, user_blocks, agent_blocks, processed_lines, replaced_tokens."""
    marked = blocks(classify(lines))
    spoke = lambda who: F.count_if((F.col("role") == who) & F.col("thread").isNotNull()).alias(f"{who.lower()}_blocks")
    a = marked.agg(F.count_distinct("file", "thread_mark").alias("threads"), spoke("User"), spoke("Agent"))
    b = redacted.agg(F.count_if("processed").alias("processed_lines"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("replaced_tokens"))
    return a.crossJoin(b)  # one row each


def should_redact(role: Column, mode: str) -> Column:
    return F.lit(True) if mode == "both" else F.coalesce(role == "User", F.lit(False))


def output_path(path: str, explicit: str | None = None, tag: str = "") -> str:
    """<stem>.redacted[.tag]<suffix> beside the input, unless a path is given."""
    p = PurePosixPath(path)
    return explicit or str(p.with_name(f"{p.stem}.redacted{'.' + tag if tag else ''}{p.suffix}"))


def write(redacted: DataFrame, path: str, tag: str = "") -> None:
    """Text files, lines in order: a folder ``name=<stem>.redacted[.tag]<suffix>`` for each transcript."""
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    suffix = F.regexp_extract(base, r"(?<=[^/])(\.[^./]+)$", 1)
    name = F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(suffix)), F.lit(".redacted" + ("." + tag if tag else "")), suffix)
    whole = redacted.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("redacted", F.lit("")).alias("redacted")))), lambda x: x["redacted"]), "").alias("value"))
    whole.select(F.regexp_replace("value", r"\n$", "").alias("value"), name.alias("name")).write.partitionBy("name").text(path)


def redact_file(spark: SparkSession, path: str, output: str | None = None, tag: str = "", mode: str = "user-only", terms: list[str] | None = None) -> tuple[str, Row]:
    """Redact one transcript into one file named after it; its path, and the ``stats``. The lines pass the driver one by one."""
    lines = read_lines(spark, path)
    redacted = redact(lines, mode, terms).cache()
    where = output_path(path, output, tag)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(where)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for row in redacted.orderBy("line_no").toLocalIterator():
            out.write(bytearray(row.redacted.encode()))
    finally:
        out.close()
    counted = stats(lines, redacted).first()
    redacted.unpersist()
    return where, counted


def main(args: list[str] | None = None) -> None:
    """Redact a transcript file from the command line."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("input")
    parser.add_argument("--output")
    parser.add_argument("--tag", default="")
    parser.add_argument("--mode", default="user-only", choices=("user-only", "both"))
    parser.add_argument("--terms", help="JSON file whose strings and keys are no names")
    parser.add_argument("--name-terms", help="JSON file whose name fields are no names")
    given = parser.parse_args(args)
    terms = []
    for path, read in ((given.terms, allowlist.all_terms), (given.name_terms, allowlist.name_terms)):
        terms += read(json.loads(Path(path).read_text(encoding="utf-8"))) if path else []
    where, counted = redact_file(SparkSession.builder.getOrCreate(), given.input, given.output, given.tag, given.mode, terms)
    print(where, *(f"{k}={v}" for k, v in counted.asDict().items()))


if __name__ == "__main__":
    main()
