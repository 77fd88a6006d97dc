"""Removal of lines that many documents share, as bitmaps of the lines to keep.

Each line's key is hashed; the hashes, without their text, are cut into ranges, sorted by hash, document and position, and
read as a stream in which a key's first occurrence comes first. What goes back to a document is a bitmap of its lines,
compressed as runs of kept lines. Everything runs in DataFrame functions.

A range of hashes is a task; a key that many lines have is cut into slices of documents beforehand, which are streamed
like keys of their own and added up afterwards, so no key makes a large task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, prepare

#: What is stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
LEAST_DOCS = 10
#: Lines of a range at most, about; lines that are looked at for frequent keys; and the part of them from which a key is sliced.
RANGE, SAMPLE, SHARE = 1_000_000, 1_000_000, 1 / 2000


def line_keys(text: Column) -> Column:
    """array<struct<h, g>> of a text's lines: two hashes (96 bits) of the stripped line with A-Z in lower case.

    Lines of white space have no key: null.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(WHITE))
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g")))

    return F.transform(F.split(lower, "\n", -1), hashed)


def frequent(lines: DataFrame, total: int, n: int) -> DataFrame:
    """(h, g, slices) of keys with many lines, at most 1 / SHARE of them, by a sample of rows.

    A slice has about a quarter of the lines of a range, of which there are ``n``. It only decides how keys are cut into
    tasks; a key it misses or adds changes no result.
    """
    part = min(1.0, SAMPLE / max(total, 1))
    least = max(2.0, SHARE * part * total)
    seen = lines.sample(part, 1).groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return seen.select("h", "g", F.ceil(F.col("n") * (4 * n / (part * max(total, 1)))).cast("int").alias("slices"))


def streamed(lines: DataFrame, n: int) -> DataFrame:
    """Lines (h, g, piece, row, pos) of the ranges ``part``, each sorted by key, document and position and read once."""
    key = ["part", "h", "g", "piece"]
    stream = Window.partitionBy(*key).orderBy("row", "pos")
    before = F.lag("row").over(stream)
    lines = lines.select(*key, "row", "pos").repartitionById(n, "part")
    lines = lines.withColumn("new", (before.isNull() | (before != F.col("row"))).cast("int")).withColumn("first", F.row_number().over(stream) == 1)
    return lines.withColumn("n_docs", F.sum("new").over(Window.partitionBy(*key))).drop("new", "part")


def marked(lines: DataFrame, total: int) -> DataFrame:
    """Every line (h, g, row, pos) with n_docs, the number of rows that have its key, and whether it is the key's first."""
    conf = lines.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(int(conf), math.ceil(total / RANGE))
    hot = keep(frequent(lines, total, n), "frequent")
    # Hashes are even, so ranges of equal width are ranges of about equal size.
    plain = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(n).cast("long"), 32).cast("int")
    piece = F.pmod(F.xxhash64("row"), "slices").cast("int")
    wide = lines.join(F.broadcast(hot), ["h", "g"]).withColumn("piece", piece)
    wide = wide.withColumn("part", F.pmod(F.xxhash64("h", "g", "piece"), F.lit(n)).cast("int"))
    cold = lines.join(F.broadcast(hot), ["h", "g"], "left_anti").select("*", F.lit(0).alias("piece"), plain.alias("part"))
    # The slices of a frequent key have different documents: numbers add up, and the first of the firsts is the key's.
    cold, sliced = streamed(cold, n), keep(streamed(wide, n), "sliced")
    firsts = sliced.filter("first").groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("row", "pos")).alias("at"))
    sliced = sliced.drop("n_docs", "first").join(F.broadcast(firsts), ["h", "g"]).withColumn("first", F.struct("row", "pos") == F.col("at"))
    shown = ["h", "g", "row", "pos", "n_docs", "first"]
    return cold.select(*shown).union(sliced.select(*shown))


def kept_runs(dropped: Column, n: Column) -> Column:
    """array<struct<start, length>> of the lines that stay, from the ascending numbers of those that don't and the number of lines."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("start"), F.concat(starts, F.array(n)).alias("end"))
    runs = F.transform(edges, lambda e: F.struct(e["start"].alias("start"), (e["end"] - e["start"]).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text, n_lines), written once, and (row, dropped), the lines that rows lose.

    A line goes if at least ``least_docs`` rows have its key; ``keep_first`` leaves a key's first occurrence. A null text
    is an empty one, which is one empty line; lines without a key stay. Rows of one doc_id, also equal ones, are
    documents of their own. Other columns aren't read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    rows = keep(rows.withColumn("keys", line_keys(F.col("text"))).withColumn("n_lines", F.size("keys")), "lines")
    total = rows.agg(F.sum("n_lines")).first()[0] or 0
    lines = rows.select("row", F.posexplode("keys").alias("pos", "key")).filter("key is not null").select("key.h", "key.g", "row", "pos")
    gone = marked(lines, total).filter(F.col("n_docs") >= least_docs)
    if keep_first:
        gone = gone.filter(~F.col("first"))
    dropped = gone.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))
    return rows.drop("keys"), dropped


def applied(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows (row, doc_id, text) with n_lines, n_dropped and ``keep``, the runs of lines that stay."""
    rows = rows.join(dropped, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return rows.select("row", "doc_id", "text", "n_lines", F.size("dropped").alias("n_dropped"), kept_runs(F.col("dropped"), F.col("n_lines")).alias("keep"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that a bitmap keeps, joined by line feeds."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep) of every row; no text."""
    return applied(*bitmaps(docs, least_docs, keep_first)).drop("row", "text")


def clean(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, text) of every row with the kept lines only."""
    return applied(*bitmaps(docs, least_docs, keep_first)).select("doc_id", kept_text(F.col("text"), F.col("keep")).alias("text"))


def report(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and kept_sha256, the hash of what its bitmap keeps."""
    rows = applied(*bitmaps(docs, least_docs))
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep")))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
