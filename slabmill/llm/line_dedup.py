"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import ascii_lower
from slabmill.operators.once import compute_once

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the shared lines gone from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key of at least ``min_chars`` code points that is found in at least ``min_docs`` different documents (values of ``key``)
    loses all its lines except in the largest ``key``. NULL keys count as one document, smaller than any; a NULL text is one empty line and
    becomes an empty text. Rows alike in key and text are treated alike. Columns named ``n_lines`` or ``n_dropped`` are replaced.

    Lines are exploded with their position and met by two 64-bit hashes of their key. Documents are counted in two steps
    (distinct per hash and document, then per hash), so a line of a third of all documents is summed before it is shuffled;
    the join back to the lines of hot hashes is one that Spark splits. Only positions return to a document, never line texts, and a text goes
    through that join once. An empty table gives no rows; the lines of a very long text are looked up by position, so its cost is linear.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(F.col(text), F.lit(""))
    same = F.xxhash64(whole)
    lines = (
        docs.select(F.col(key).cast("long").alias("doc"), same.alias("same"), F.posexplode(F.split(whole, "\n", -1)).alias("position", "line"))
        .select("doc", "same", "position", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "same", "position", F.xxhash64("key").alias("hash"), F.xxhash64(F.lit("second"), "key").alias("hash2"))
    )
    found = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    shared = lines.groupBy("hash", "hash2").agg(found.alias("found"), F.max("doc").alias("keeper")).where(F.col("found") >= min_docs).drop("found")
    gone = (
        lines.join(shared, ["hash", "hash2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "same")
        .agg(F.collect_set("position").alias("gone"))
    )
    rest = [c for c in own if c != text]
    row = F.struct(*rest) if rest else F.lit(None).cast("boolean")
    rows = docs.select(row.alias("row"), F.col(key).cast("long").alias("doc"), same.alias("same"), whole.alias("text"))
    met = rows.alias("r").join(gone.alias("g"), F.col("r.doc").eqNullSafe(F.col("g.doc")) & (F.col("r.same") == F.col("g.same")), "left")
    met = met.select("row", "text", "gone")
    cut = compute_once(met, "cut", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)).alias("lines"))
    lines = F.col("cut.lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return cut.select(*(kept.alias(text) if c == text else F.col("row")[c].alias(c) for c in own), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
