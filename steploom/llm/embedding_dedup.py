"""Embedding near-dedup by tile products of int8 codes with rigorous error bounds.

Equal vectors are one class. The classes of a label are dealt into blocks of bounded size; each
pair of blocks of one label is a tile. A tile multiplies the int8 codes of its two blocks (in
float32, which holds these sums exactly) and adds a bound of what quantisation can have hidden:
with x = s c + e for unit vectors, |x.y - s t c.d| <= |e_x| |t d| + |s c| |e_y| + |e_x| |e_y|, each norm known
for each vector. Only pairs that may reach the threshold are computed again in double precision.
A tile gives back link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, table, written

#: Vectors in a block; a tile needs a few times BLOCK * STRIP * 4 bytes.
BLOCK, STRIP = 4096, 512


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their steps, and the norms of what the codes leave out."""
    step = np.abs(x).max(axis=1) / 127.0
    step[step == 0] = 1.0
    code = np.rint(x / step[:, None])
    return code.astype(np.int8), step, np.linalg.norm(x - code * step[:, None], axis=1)


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    parent, out = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for us, vs in links:
        for u, v in zip(us.tolist(), vs.tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((u, v))
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked (row of x, row of y) pairs of one tile; within x (upper triangle) if ``y`` is None."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    code, step, left = quantised(unit)
    if y is None:
        y, unit_y, code_y, step_y, left_y = x, unit, code, step, left
        own = True
    else:
        unit_y, own = y / np.linalg.norm(y, axis=1)[:, None], False
        code_y, step_y, left_y = quantised(unit_y)
    size = np.linalg.norm(code.astype(np.float64), axis=1) * step
    size_y = np.linalg.norm(code_y.astype(np.float64), axis=1) * step_y
    wide = code_y.astype(np.float32).T.copy() if x.shape[1] * 127 * 127 < 1 << 24 else code_y.astype(np.float64).T.copy()
    norm, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = []
    for at in range(0, len(x), STRIP):
        rows = slice(at, at + STRIP)
        near = (code[rows].astype(wide.dtype) @ wide) * step[rows, None] * step_y
        near += left[rows, None] * size_y + size[rows, None] * left_y + left[rows, None] * left_y + 1e-6
        i, j = np.nonzero(near >= threshold)
        i += at
        if own:
            keep = i < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 15):
            a, b = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            cos = np.einsum("ij,ij->i", x[a], y[b]) / (norm[a] * norm_y[b])
            ok = cos >= threshold
            out.append((a[ok], b[ok]))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles, each row divided by its largest component, so that squares neither overflow nor vanish."""
    x = x.astype("<f8")
    return x / np.abs(x).max(axis=1)[:, None]


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, v, own, usable)``; usable: a label, and finite components that are not all zero; own: the components as they came."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), F.col(vector_col).alias("own"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite
    # Scaled by its largest component, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.when(ok & (top > 0), F.transform("v", lambda c: c / top))
    return rows.withColumn("v", scaled).withColumn("usable", F.coalesce(F.col("v").isNotNull() & (norm > 0), F.lit(False)))


def embedding_links(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row: links of cosine >= ``threshold`` within a label.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing,
    as does one without label or id, or of another length. Equal vectors link with each other;
    rows that repeat an id count as vectors of their own. An empty table gives an empty result.
    """
    # Equal vectors of a label share two 64-bit hashes, which stand for them in all that is moved.
    marks = [F.when(F.col("usable"), F.xxhash64(F.lit(i), "label", "v")).alias(f"m{i}") for i in (1, 2)]
    # Blocks carry components as they came: four bytes each of floats, from which the tiles make doubles.
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    rows = _classes(vectors, id_col, vector_col, label_col)
    rows = written(rows.select("vec_id", "label", F.size("v").alias("dim"), "usable", F.col("own" if single else "v").alias("x"), *marks), "vectors")
    classes = rows.where("usable").groupBy("label", "dim", "m1", "m2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("x", "vec_id").alias("x"))
    classes = written(classes, "classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # A class is dealt by its hash; the sort of a block's rows makes its tiles agree.
    dealt = classes.join(counts, ["label", "dim"]).withColumn("block", F.pmod("m1", F.col("blocks")).cast("int"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "m1", "m2"])
        x = np.stack(pdf["x"].to_numpy()).astype(kind)
        return pd.DataFrame({"label": [str(pdf["label"].iloc[0])], "dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "blocks": [int(pdf["blocks"].iloc[0])],
                             "reps": [pdf["rep"].to_numpy("<i8").tobytes()], "copies": [pdf["copies"].to_numpy("<i8").tobytes()], "x": [x.tobytes()]})

    blocks = dealt.groupBy("label", "dim", "block").applyInPandas(packed, "label string, dim int, block int, blocks int, reps binary, copies binary, x binary")
    blocks = written(blocks, "blocks")
    # Each block goes to the tiles in which it is one of the two: as many as its label has blocks.
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "reps", "copies", "x")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        dim = int(pdf["dim"].iloc[0])
        reps = [np.frombuffer(r, "<i8") for r in pdf["reps"]]
        copies = [np.frombuffer(r, "<i8") for r in pdf["copies"]]
        x = [_scaled(np.frombuffer(r, kind).reshape(-1, dim)) for r in pdf["x"]]
        both = len(x) == 2
        shift = len(x[0]) if both else 0
        found = tile_links(x[0], x[1] if both else None, threshold)
        ids, times = np.concatenate(reps), np.concatenate(copies)
        links = np.zeros(len(ids), np.int64)
        pairs = []
        for a, b in found:
            np.add.at(links, a, times[b + shift])
            np.add.at(links, b + shift, times[a])
            pairs.append((a, b + shift))
        tree = _forest(len(ids), pairs)
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate((ids[some], ids[[u for u, _ in tree]])).astype(np.int64), "b": np.concatenate((ids[some], ids[[v for _, v in tree]])).astype(np.int64),
                             "links": np.concatenate((links[some], np.zeros(len(tree), np.int64)))})

    found = written(tiles.groupBy("label", "dim", "i", "j").applyInPandas(tile, "a long, b long, links long"), "tiles")
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    joined = written(components(found.where("a <> b")), "joined")
    own = classes.select(F.col("m1").alias("c1"), F.col("m2").alias("c2"), "rep", "copies").join(
        links, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "c1", "c2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    own = written(own, "told")
    out = rows.select("vec_id", "m1", "m2").join(own, (F.col("m1") == F.col("c1")) & (F.col("m2") == F.col("c2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("c1").isNull(), 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP4_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""
