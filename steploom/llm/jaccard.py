"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Small sets enumerate their subsets of the size that a similar pair must share (so two small sets
with a common subset are similar by construction); large sets are found by scanning inverted
lists. The boundary between small and large is where the counted cost is least.

The lists of large sets are kept on *cells*. A list on a single shingle of a passage that a
thousand documents quote holds all of them, whether or not they are similar. So each set is dealt
by hash into a third more cells than the most elements in which a similar pair of its size band can
differ: some cells are equal in both sets, whole, and lists on whole cells (about four shingles)
stay short unless documents really are alike. As a similar pair must share several cells, each set
drops its cells of longest lists, one fewer than it must share, and the pair still meets. Cells
are exact, not approximate: no similar pair is lost.

Only connectivity is asked for, so groups of copies need no pair for each two members. Equal sets
are one class. In each list the member with most company is the hub; pairs with hubs are verified
first and joined into components. What is then left are lists that still hold more than one
component: pairs of light lists are verified each, and what heavy lists hold together is counted
in tiles of bounded size. Verification counts the intersection of the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, table, written
from .shingles import mixed, shingle_set, word_hashes

#: One posting of a list costs its scan and its share of verifications, in rows of subsets.
LIST_COST = 4
#: Subsets of sets above this size are never cheaper.
LARGEST_SMALL = 32
#: Lists and shingles of at most so many sets are light: their pairs are enumerated.
LIGHT = 8
#: Ids of candidates are broadcast up to this size; beyond it they and the texts are shuffled.
BROADCAST_BYTES = 16 << 20
#: Documents, and bytes of text, in a block of a group; a tile counts BLOCK * BLOCK intersections.
BLOCK, BLOCK_BYTES = 2048, 64 << 20


class Plan:
    """Which keys a set of a size emits, at similarity ``num / den``; ``small`` is the boundary."""

    def __init__(self, num: int, den: int, small: int = 0):
        self.num, self.den, self.small = num, den, small
        self.tops = [small]
        while self.tops[-1] < 2**40:
            top = max(self.tops[-1] + 1, self.tops[-1] * den // num)
            self.tops.append(max(top, top * den // num))

    def overlap(self, both: int) -> int:
        """The least intersection of a similar pair whose sizes sum to ``both``."""
        return -(-self.num * both // (self.num + self.den))

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def subset_sizes(self, n: int) -> list[int]:
        least = -(-n * self.num // self.den)
        return sorted({self.overlap(n + m) for m in range(least, min(self.small, self.largest(n)) + 1)} - {0})

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """``(band, most differing, cells)`` of the bands in which the larger set of a pair may lie."""
        out = []
        for i in range(1, len(self.tops)):
            if self.tops[i] >= n and self.tops[i - 1] < self.largest(n):
                differ = 2 * self.tops[i] * (self.den - self.num) // (self.den + self.num)
                out.append((i, differ, (differ + 1) * 4 // 3 + 2))
            elif self.tops[i - 1] >= self.largest(n):
                break
        return out

    def rows(self, n: int) -> tuple[int, int]:
        """Subsets and postings of a set of ``n``."""
        return sum(comb(n, c) for c in self.subset_sizes(n)) if n <= self.small else 0, sum(c for _, _, c in self.bands(n))

    def keys(self, s: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """``(keys, band, need)``: a similar set of the band shares at least ``need`` of the keys.

        With ``m`` cells that are not empty and at most ``d`` elements that differ, ``m - d`` cells
        are equal in both. Where that may be none, the set also emits a key of its band, on which
        all such sets meet.
        """
        n, out = len(s), []
        if n <= self.small:
            own = mixed(s, 3)
            for c in self.subset_sizes(n):
                out.append((mixed(_subset_sums(own, c), 1000 + c), 0, 1))
        element, spread = None, None
        for band, differ, cells in self.bands(n):
            if element is None:
                element, spread = mixed(s, 4), mixed(s, 5) >> np.uint64(32)
            cell = (spread * np.uint64(cells)) >> np.uint64(32)
            order = np.argsort(cell, kind="stable")
            at = cell[order]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(element[order])))
            edge = np.flatnonzero(np.diff(at)) + 1
            lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
            keys = mixed(mixed(total[hi] - total[lo] + at[lo], 6) + (hi - lo).astype(np.uint64), 2000 + band)
            if len(lo) <= differ:
                keys = np.concatenate((keys, mixed(np.array([band], np.uint64), 7)))
            out.append((keys, band, max(1, len(lo) - differ)))
        return out


def _subset_sums(x: np.ndarray, c: int) -> np.ndarray:
    """Sums (modulo 2^64) of all subsets of ``c`` elements, as the total less what is left out."""
    from itertools import combinations

    left = len(x) - c
    if left == 0:
        return x.sum(keepdims=True)
    pick = np.array(list(combinations(range(len(x)), left)))
    return x.sum() - x[pick].sum(axis=1)


def _chunks(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Rows of a text column in runs of bounded size."""
    texts, start, held = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        texts.append(x.as_py())
        held += len(texts[-1] or "")
        if held >= most:
            yield start, texts
            texts, start, held = [], i + 1, 0
    if texts:
        yield start, texts


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[np.ndarray]:
    for _, texts in _chunks(batch, column):
        for words in word_hashes(texts):
            yield shingle_set(words, k)


def shingle_counts(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, print)``: the size of each document's set and a 128-bit hash of the set."""

    def run(batches):
        for b in batches:
            n, prints = [], []
            for s in _sets(b, 1, k):
                n.append(len(s))
                prints.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "n", "print"])

    return docs.mapInArrow(run, "doc_id long, n long, print binary")


def postings(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """``(key, doc, n, band, need)``: the keys of every set; a set met twice in a partition counts once."""
    names = ["key", "doc", "n", "band", "need"]

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    def run(batches):
        seen = set()
        for b in batches:
            cols, held = [[] for _ in names], 0
            for doc, s in zip(b.column(0).to_pylist(), _sets(b, 1, k)):
                mark = blake2b(s.tobytes(), digest_size=16).digest()
                if doc is None or not len(s) or mark in seen:
                    continue
                seen.add(mark)
                for keys, band, need in plan.keys(s):
                    m = len(keys)
                    for c, x in zip(cols, (keys.view(np.int64), np.full(m, doc, np.int64), np.full(m, len(s), np.int32), np.full(m, band, np.int32), np.full(m, need, np.int32))):
                        c.append(x)
                    held += m
                if held > 1 << 18:
                    yield batch(cols)
                    cols, held = [[] for _ in names], 0
            if held:
                yield batch(cols)

    return docs.mapInArrow(run, "key long, doc long, n int, band int, need int")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``den * intersection >= num * union``."""
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        last, own = None, None
        for b in batches:
            first, second, keep = b.column(2), b.column(3), []
            for start in range(0, b.num_rows, 256):
                rows = range(start, min(b.num_rows, start + 256))
                for i, words in zip(rows, word_hashes([second[i].as_py() for i in rows])):
                    text = first[i].as_py()
                    if text != last:
                        last, own = text, shingle_set(word_hashes([text])[0], k)
                    other = shingle_set(words, k)
                    n = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(n > 0 and den * n >= num * (len(own) + len(other) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long"), "links")


def _near(a: str, b: str, num: int, den: int):
    return F.greatest(a, b) * num <= F.least(a, b) * den


def _hub_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Each list's members with its hub, the member with most company, if their sizes are near enough.

    Hubs are aggregated before they are shuffled and joined from a written table, so that a list of
    any length is many tasks.
    """
    rows = lists.withColumn("company", F.count("*").over(Window.partitionBy("doc")))
    hub = F.max(F.struct("company", (-F.col("doc")).alias("d"), "n", "doc"))
    hubs = written(rows.groupBy("key").agg(hub.alias("hub")).select("key", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    met = lists.join(hubs, "key").where((F.col("doc") != F.col("hub")) & _near("n", "hub_n", num, den))
    return met.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()


def _list_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a list whose components differ."""
    l, r = lists.alias("l"), lists.alias("r")
    far = (F.col("l.key") == F.col("r.key")) & (F.col("l.doc") < F.col("r.doc")) & (F.col("l.component") != F.col("r.component"))
    return l.join(r, far & _near("l.n", "r.n", num, den)).select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; links at Jaccard >= num / den.

    A set: the distinct runs of ``k`` words; of a text with fewer words, all of them as one;
    empty without words. Empty sets link with nothing, also not with each other. Rows that repeat
    are one class. A row without id takes no part in linking and has no component. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = written(shingle_counts(docs, k), "sets")
    sizes = {r["n"]: r["count"] for r in base.where(f"n BETWEEN 1 AND {LARGEST_SMALL}").groupBy("n").count().collect()}  # LARGEST_SMALL rows at most
    plan = Plan(num, den, boundary(sizes, num, den))
    # Written, so that the join with it can split a print that many copies share.
    reps = written(base.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep")), "reps")
    members = written(base.where("doc_id IS NOT NULL").join(reps, "print", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "members")

    keyed = postings(docs, k, plan).withColumn("held", F.count("*").over(Window.partitionBy("key"))).where("held > 1")
    # Of keys that two similar sets share, the rarest stays in both if each drops its need - 1 most
    # frequent ones: a set whose other keys are its own drops out, however common its passages are.
    rank = F.row_number().over(Window.partitionBy("doc", "band").orderBy(F.col("held").desc(), F.col("key").desc()))
    lists = keyed.withColumn("rank", rank).where("rank >= need").select("key", "doc", "n")
    own = written(lists.join(members.withColumnRenamed("doc_id", "doc"), "doc").select("key", F.col("rep").alias("doc"), "n").distinct(), "lists")
    # The only texts that verification can ask for: picked where they lie if the ids are few, else moved once.
    ids = written(own.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    texts = written(docs.join(ids, "doc_id"), "texts")
    links = verified(_hub_pairs(own, num, den), texts, k, num, den)
    first = written(components(links), "joined")
    apart = written(_apart(own, first), "apart")
    discard(own, first)
    links = links.unionByName(verified(_list_pairs(apart.where(f"held <= {LIGHT}"), num, den), texts, k, num, den))
    links = links.unionByName(_heavy_links(apart.where(f"held > {LIGHT}"), texts, k, num, den))
    discard(apart, texts)
    joined = written(components(links), "joined")
    whole = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("doc_id").alias("m"), F.coalesce("component", "rep").alias("component_id")).groupBy("m").agg(F.min("component_id").alias("component_id"))
    return base.join(whole, base["doc_id"] == whole["m"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _heavy_links(lists: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links among documents that long lists hold together, as spanning forests of tiles.

    Documents that long lists connect form a group; a group is dealt into blocks of bounded size
    and each two blocks are a tile, which counts all its intersections at once. So no pair is a
    row, and a large group is many tasks.
    """
    stars = lists.select(F.col("first").alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()
    groups = written(components(stars), "groups")
    lengths = docs.select(F.col("doc_id").alias("node"), F.octet_length("text").alias("bytes"))
    shares = F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    sizes = written(groups.join(lengths, "node").groupBy("component").agg(F.ceil(shares).cast("int").alias("blocks")), "group-sizes")
    dealt = groups.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("g"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    texts = docs.join(dealt, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "text")

    def run(t: pa.Table) -> pa.Table:
        own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        t = t.sort_by([("block", "ascending"), ("doc_id", "ascending")])
        ids = np.array(t.column("doc_id").to_pylist(), np.int64)
        first = int((np.array(t.column("block").to_pylist()) == t.column("i")[0].as_py()).sum())
        sets = [shingle_set(w, k) for s in range(0, t.num_rows, 256) for w in word_hashes([x.as_py() for x in t.column("text")[s:s + 256]])]
        a, b = tile_links(sets, None if own else first, num, den)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return written(texts.groupBy("g", "i", "j").applyInArrow(run, "a long, b long"), "links")


def tile_links(sets: list[np.ndarray], first: int | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a tile: within ``sets``, or between the first ``first`` and the rest.

    Intersections are counted shingle by shingle: a light one, in few sets, adds to the pairs of
    its list; heavy ones are columns of a matrix whose product counts all pairs at once.
    """
    n = np.array([len(s) for s in sets], np.int64)
    cut = len(sets) if first is None else first
    rows = np.repeat(np.arange(len(sets)), n)
    values, place, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    lo = 0 if first is None else cut
    count = np.zeros((cut, len(sets) - lo), np.int32)
    order = np.argsort(place, kind="stable")
    order = order[df[place[order]] > 1]
    member, of = rows[order], place[order]
    light = df[of] <= LIGHT
    m, o = member[light], of[light]
    for step in range(1, LIGHT):  # the members of one list stand together, in ascending order
        if step >= len(m):
            break
        same = o[step:] == o[:-step]
        u, v = m[:-step][same], m[step:][same]
        keep = (u < cut) & (v >= lo)
        np.add.at(count, (u[keep], v[keep] - lo), 1)
    m, o = member[~light], of[~light]
    heavy, column = np.unique(o, return_inverse=True)
    for at in range(0, len(heavy), 2048):
        pick = (column >= at) & (column < at + 2048)
        x = np.zeros((len(sets), min(2048, len(heavy) - at)), np.float32)
        x[m[pick], column[pick] - at] = 1
        count += (x[:cut] @ x[lo:].T).astype(np.int32)
    near = den * count.astype(np.int64) >= num * (n[:cut, None] + n[None, lo:] - count)
    u, v = np.nonzero(near & (count > 0))
    v = v + lo
    keep = u < v
    return _forest(len(sets), u[keep], v[keep])


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes: breadth first, so that links beyond the forest cost little."""
    order = np.argsort(np.concatenate((u, v)), kind="stable")
    to = np.concatenate((v, u))[order]
    at = np.searchsorted(np.concatenate((u, v))[order], np.arange(n + 1))
    seen, a, b = np.zeros(n, bool), [], []
    for start in np.flatnonzero(np.diff(at)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            x = todo.pop()
            new = to[at[x]:at[x + 1]]
            new = np.unique(new[~seen[new]])
            seen[new] = True
            a += [x] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _apart(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The lists that still hold more than one component: each member with its component, the list's length and first member."""
    rows = written(lists.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component")), "told")
    ends = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"), F.min("doc").alias("first"))
    ends = written(ends.where("lo < hi").select("key", "held", "first"), "ends")
    return rows.join(ends, "key")


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest set size whose subsets are enumerated, by least total cost."""
    costs = {}
    for x in range(LARGEST_SMALL + 1):
        plan = Plan(num, den, x)
        costs[x] = sum(c * (a + LIST_COST * b) for n, c in sizes.items() for a, b in [plan.rows(n)])
        if x > 4 and costs[x] > 4 * min(costs.values()) > 0:
            break
    return min(costs, key=lambda x: (costs[x], x))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(seen)::BIGINT AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
