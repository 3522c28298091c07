"""A content-addressed store of token-id streams.

A rolling hash over the last ids of a stream cuts it into chunks where the content says so, so
equal passages give equal chunks wherever they stand. Every distinct chunk is stored once, under
the SHA-256 of its payload; a document is a recipe, the list of its chunks' addresses; recipes lie
in ascending order of document with their place in the whole stream; a manifest holds a Merkle
root for each segment of recipes. All files are Parquet, so any store that Spark writes will do.

    chunks/    address binary, n int, payload binary    (unsigned 16- or 32-bit little-endian ids)
    recipes/   segment, doc_id, start, n_tokens, ids_crc32, addresses array, ends array
    manifest/  segment, documents, root binary
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, table, written
from .tokens import encoder

WINDOW, MEAN_BITS, LEAST, MOST = 16, 8, 64, 1024
SEGMENT_DOCS = 8192
_ids = np.random.default_rng(1973).integers(0, 2**63, 1 << 16, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where a hash of the last 16 ids has 8 zero bits, 64 to 1024 ids apart."""
    n = len(ids)
    ends, at = [], 0
    if n > LEAST:
        up = np.full(n, _P, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_ids[ids & 0xFFFF] * up)))
        # (total[i] - total[i - w]) / p^i is the window's hash; scaling by the odd p^i keeps low zeros,
        # so the division is replaced by multiplying with the inverse powers.
        down = np.full(n, pow(_P, -1, 2**64), np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        h = (total[WINDOW:] - total[:-WINDOW]) * down[WINDOW - 1:]
        for e in (np.flatnonzero((h >> np.uint64(50)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + WINDOW).tolist():
            while e - at > MOST:
                at += MOST
                ends.append(at)
            if e - at >= LEAST:
                at = e
                ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n] if n > at else ends


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, addresses, ends, payloads)``; a payload met before in the partition is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), set()
        small = enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []
        for b in batches:
            for doc, own in zip(b.column(0), enc.encode(b.column(1))):
                ids = np.concatenate((own, end))
                addresses, ends, payloads, at = [], [], [], 0
                for to in cuts(ids):
                    part = ids[at:to]
                    payload = (b"\x02" + part.astype("<u2").tobytes()) if small else b"\x04" + part.tobytes()
                    address = sha256(payload).digest()
                    payloads.append(None if address in seen else payload)
                    seen.add(address)
                    addresses.append(address)
                    ends.append(to)
                    at = to
                rows.append((doc.as_py(), len(ids), crc32(ids.tobytes()), addresses, ends, payloads))
                if len(rows) == 1000:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, addresses array<binary>, ends array<long>, payloads array<binary>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_tokens", "ids_crc32", "addresses", "ends", "payloads"])


def _leaf(doc_id, start, n, crc, addresses) -> bytes:
    return sha256(f"{doc_id}:{start}:{n}:{crc}:".encode() + b"".join(addresses)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node is hashed alone."""
    level = leaves or [sha256(b"").digest()]
    while len(level) > 1:
        level = [sha256(b"".join(level[i:i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def _roots(recipes: DataFrame) -> DataFrame:
    """``(segment, documents, root)``, from the recipes of each segment (bounded in number)."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["start"])
        leaves = [_leaf(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["addresses"]) for r in rows]
        return pa.table({"segment": pa.array([rows[0]["segment"]], pa.int64()), "documents": pa.array([len(rows)], pa.int64()), "root": pa.array([merkle_root(leaves)], pa.binary())})

    return recipes.select("segment", "doc_id", "start", "n_tokens", "ids_crc32", "addresses").groupBy("segment").applyInArrow(run, "segment long, documents long, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write the store at ``path``.

    Documents stand in ascending order of id, null first; rows that repeat an id follow each
    other in order of their content. An empty table writes an empty store.
    """
    spark = docs.sparkSession
    staged = written(encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), vocabulary, end_id), "encoded")
    chunks = staged.select(F.explode(F.arrays_zip("addresses", "payloads")).alias("c")).select("c.*").where("payloads IS NOT NULL")
    width = F.when(F.substring("payload", 1, 1) == F.lit(b"\x02"), 2).otherwise(4)
    chunks = chunks.select(F.col("addresses").alias("address"), F.col("payloads").alias("payload")).dropDuplicates(["address"])
    chunks.select("address", ((F.octet_length("payload") - 1) / width).cast("int").alias("n"), "payload") \
        .write.option("compression", "zstd").parquet(f"{path}/chunks")
    segments = max(1, -(-staged.count() // SEGMENT_DOCS))
    order = ["doc_id", "ids_crc32", F.xxhash64("addresses")]
    parted = written(staged.drop("payloads").repartitionByRange(segments, *order).withColumn("segment", F.spark_partition_id().cast("long")), "parted")
    discard(staged)
    sums = parted.groupBy("segment").agg(F.sum("n_tokens").alias("all"))
    before = sums.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    own = Window.partitionBy("segment").orderBy(F.col("doc_id").asc_nulls_first(), *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    recipes = parted.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(before, "segment")
    recipes.select("segment", "doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "addresses", "ends") \
        .write.option("compression", "zstd").parquet(f"{path}/recipes")
    discard(parted)
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def payload_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(address, n, crc)`` of every stored chunk, read from its payload; a payload that isn't its address's has null."""

    def run(batches):
        for b in batches:
            n, crc = [], []
            for address, payload in zip(b.column(0), b.column(1)):
                raw = payload.as_py()
                ok = raw is not None and sha256(raw).digest() == address.as_py()
                ids = payload_ids(raw) if ok else None
                n.append(len(ids) if ok else None)
                crc.append(crc32(ids.tobytes()) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("address", "payload").mapInArrow(run, "address binary, n long, crc long")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo that of CRC-32 (bit 31 is x^0)."""
    out, one = np.zeros_like(a), np.uint64(1)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & one == one, b, np.uint64(0))
        b = np.where(b & one == one, (b >> one) ^ np.uint64(0xEDB88320), b >> one)
    return out


def shifted_crc(crc: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to that of the whole if ``follow`` bytes come after it."""
    out, power = crc.astype(np.uint64), np.full(len(crc), 0x00800000, np.uint64)  # x^8
    follow = follow.copy()
    while len(follow) and follow.max() > 0:
        out = np.where(follow & 1 == 1, _times(out, power), out)
        power = np.full(len(crc), int(_times(power[:1], power[:1])[0]), np.uint64)
        follow >>= 1
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, verified)`` of every document, from the files alone.

    Every payload is hashed and must be its address's; a document's length and CRC are put together
    from its chunks' (the CRC of a concatenation is the XOR of its parts' CRCs, each shifted by what
    follows), so payloads are read once where they lie and never moved. ``verified``: they agree
    with the recipe, and the segment's Merkle root is that of the manifest. A chunk that is missing
    or altered makes its documents unverified; a store of no documents gives none.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("segment", "start", "n_tokens", F.explode(F.arrays_zip("addresses", "ends")).alias("c")).select(
        "segment", "start", F.col("c.addresses").alias("address"), (4 * (F.col("n_tokens") - F.col("c.ends"))).alias("follow"))
    both = parts.join(checked_chunks(spark, path), "address", "left").select("segment", "start", "n", "crc", "follow")

    @F.pandas_udf("long")
    def shift(crc: pd.Series, follow: pd.Series) -> pd.Series:
        return pd.Series(shifted_crc(crc.fillna(0).to_numpy(np.int64).astype(np.uint64), follow.to_numpy(np.int64))).astype("int64")

    docs = both.withColumn("part", shift("crc", "follow")).groupBy("segment", "start").agg(
        F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"), F.min(F.col("crc").isNotNull()).alias("whole"))
    told = spark.read.parquet(f"{path}/manifest").withColumnRenamed("root", "told_root")
    roots = _roots(recipes).join(told, ["segment", "documents"], "left").select("segment", F.coalesce(F.col("root") == F.col("told_root"), F.lit(False)).alias("rooted"))
    out = recipes.select("segment", "doc_id", "start", F.col("n_tokens").alias("told_n"), F.col("ids_crc32").alias("told_crc")).join(docs, ["segment", "start"]).join(roots, "segment")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("whole") & F.col("rooted") & (F.col("n_tokens") == F.col("told_n")) & (F.col("ids_crc32") == F.col("told_crc"))).alias("verified"))


def restored(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` with ``ids`` the whole stream of each document (32-bit little-endian).

    A document of which a chunk is missing is left out, as its stream can't be told.
    """
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("addresses").alias("i", "address"))
    chunks = spark.read.parquet(f"{path}/chunks").select("address", "payload")

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: b"".join(payload_ids(bytes(p["payload"])).tobytes() for p in ps))

    whole = parts.join(chunks, "address", "left").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("i", "payload"))).alias("parts"))
    return whole.where(F.forall("parts", lambda p: p["payload"].isNotNull())).select("doc_id", "start", joined("parts").alias("ids"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_back(spark, path)
