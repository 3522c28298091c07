"""Line dedup: lines whose normalised form stands in many documents leave every document.

Lines are exploded as 128-bit hashes of their keys (never as text), equal hashes of one document
are merged before the shuffle, and distinct documents are counted per hash. The hashes over the
threshold meet the documents' hashes again (they are broadcast if they are few), each document learns
which of its keys to drop, and its text is reassembled by position from the lines that stay; a text is
moved at most once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

BLANK = b"\x20\t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z (and no other letter) lower-cased."""
    return [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _document(id_col: str, text_col: str) -> Column:
    """A document is a distinct pair of id and text: repeated rows count once and get one answer."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))))


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(document, dropped)``: for each document with common lines, the hashes of their keys."""
    least = max(min_chars, 1)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, what = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {k for k in line_keys(text) if len(k) >= least and (least == 1 or len(k.decode("utf-8", "replace")) >= least)}
                who += [doc] * len(own)
                what += [_hash(k) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.binary()), pa.array(what, pa.binary())], ["document", "h"])

    rows = docs.select(_document(id_col, text_col).alias("document"), F.col(text_col).alias("text"))
    lines = written(rows.mapInArrow(explode, "document binary, h binary").distinct(), "lines")
    # Written, so that its size is known: a small table of common lines is broadcast, and a large one
    # meets the lines in a join whose hot keys can be split.
    common = written(lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h"), "common-lines")
    return lines.join(common, "h").groupBy("document").agg(F.collect_set("h").alias("dropped"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text rebuilt from the lines that stay, and ``_n_lines``, ``_n_dropped``.

    A key of at least ``min_chars`` code points (an empty key never counts) found in at least
    ``min_docs`` documents loses all its lines. A null or empty text is one empty line and comes
    back as ''. Rows are kept, repeated ones too; other columns pass through unchanged.
    """
    drops = common_lines(docs, min_docs, min_chars, id_col, text_col)
    both = docs.withColumn("_line_doc", _document(id_col, text_col)).join(
        drops.select(F.col("document").alias("_line_doc"), F.col("dropped").alias("_line_drop")), "_line_doc", "left")
    both = both.select(*docs.columns, "_line_drop")
    at, n = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(n).to_pylist()):
                rows = (text or "").split("\n")
                kept = rows
                if drop:
                    out = set(drop)
                    kept = [x for x, k in zip(rows, line_keys(text)) if not k or _hash(k) not in out]
                texts.append("\n".join(kept))
                lines.append(len(rows))
                dropped.append(len(rows) - len(kept))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return both.mapInArrow(rebuild, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
c AS (SELECT key FROM (SELECT doc_id, unnest(list_distinct(keys)) AS key FROM k) WHERE key <> ''
      GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS pos FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN c USING (key) GROUP BY doc_id
"""
