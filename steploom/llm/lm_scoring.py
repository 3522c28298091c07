"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model smoothed with a Dirichlet prior of the next lower order. As an
automaton, each history seen in training is a state; a seen n-gram is an arc from its history's state
that carries its log-probability and leads to the state of the longest history that it ends with;
every state has a failure arc to the state of its shorter history, which carries
log(k / (c(history) + k)); the empty history is the root, whose arcs never fail. The end of a text
leads to the state of starts. A block's texts are one stream of tokens, read from left to right: the
state is carried from token to token, failure arcs are followed until a state has an arc for the
token, and the log-probabilities add up. The stream is read in lanes side by side; a lane begins
order - 1 tokens early at the root, which brings it to the state that the token before it left.

No machine holds the model. Documents are gathered into blocks of bounded size, written as
vocabularies and token indexes. Each block sends its distinct n-grams, as sorted hashes with their
training counts, cut by hash range into packets (keys as steps from one to the next, compressed); each
range is merged by one task, which answers every block with the counts of just its n-grams. So a block
gets the part of the automaton that its texts can reach, and counts of frequent n-grams are combined
before they are sent. Blocks are written dealt by their number, so only counts come to them. A key has
24 bits more than it takes to number all n-grams: one in 16 million shares its key with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, table, written
from .shingles import mixed, word_hashes

ORDER, PRIOR, ADD = 3, 100.0, 0.1
BLOCK_TOKENS, RANGE_KEYS = 1_000_000, 4_000_000
#: Lanes in which a block is read.
LANES = 4096
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_M = np.uint64(0xD6E8FEB86659FD93)

BLOCKS = "block long, doc_ids array<long>, held binary, sizes binary, vocabulary binary, tokens binary, n_tokens long"
PACKETS = "block long, kind int, part long, keys binary, counts binary"
ANSWERS = "block long, kind int, part long, counts binary, types long, total long"


def _packed(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers as compressed planes of bytes, after their length."""
    x = np.ascontiguousarray(x, f"<u{width}")
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, width).T.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, width: int = 8) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel()


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of whole documents ``(doc_id, text, held)`` gathered until they hold ``block_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, words, size, made = [], [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def row():
            tokens = np.concatenate(words)
            vocabulary, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
            # Frequent words have small indexes, so that the indexes' high bytes are mostly zero.
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cols = [[first + made], [ids], [np.array(held, np.uint8).tobytes()], [np.array([len(w) for w in words], "<u4").tobytes()],
                    [vocabulary[order].astype("<u8").tobytes()], [_packed(rank[index], 4)], [len(tokens)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["block", "doc_ids", "held", "sizes", "vocabulary", "tokens", "n_tokens"])

        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                for doc, out, w in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), word_hashes([x.as_py() for x in part.column(1)])):
                    ids.append(doc)
                    held.append(bool(out))
                    words.append(np.concatenate((w, [END])))
                    size += len(w) + 1
                    if size >= block_tokens:
                        yield row()
                        ids, held, words, size, made = [], [], [], 0, made + 1
        if ids:
            yield row()

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """The n-grams of one block row; their keys have ``width`` bits."""

    def __init__(self, row: dict, order: int, width: int):
        self.shift = np.uint64(64 - width)
        self.ids, self.block = row["doc_ids"], row["block"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.tokens = _unpacked(row["tokens"], 4)
        self.ends = np.cumsum(self.sizes)
        self.train = np.repeat(~self.held, self.sizes)
        self.order = order

    def ngrams(self, n: int) -> np.ndarray:
        """For each token the hash of the n-gram that ends with it; starts count as tokens before a text."""
        words = self.vocabulary[self.tokens]
        h, now = words.copy(), words
        first = self.ends - self.sizes
        for _ in range(n - 1):
            now = np.concatenate(([START], now[:-1]))
            now[first] = START
            h = h * _M + now
        return mixed(h, n) >> self.shift

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, the place of each token's key, and the training counts of the keys."""
        if n == 1:
            keys, rank = np.unique(mixed(self.vocabulary, 1) >> self.shift, return_inverse=True)
            place = rank[self.tokens]
        else:
            keys, place = np.unique(self.ngrams(n), return_inverse=True)
        return keys, place, np.bincount(place[self.train], minlength=len(keys))


def _parts(keys: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, int, int]]:
    """``(range, from, to)`` of sorted keys of ``width`` bits cut by their first ``bits``, without empty ranges."""
    if not len(keys):
        return
    of = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(keys)]))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(of[lo]), lo, hi


def packets(made: DataFrame, order: int, bits: int, width: int, kinds: range) -> DataFrame:
    """What each block asks and tells of its n-grams of the lengths ``kinds``; kind 0 holds the training texts that start."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Block(row, order, width)
                rows = [(own.block, 0, 0, b"", _packed([int((~own.held).sum())]))] if 0 in kinds else []
                for n in (n for n in kinds if n):
                    keys, _, counts = own.distinct(n)
                    for part, lo, hi in _parts(keys, bits, width):
                        rows.append((own.block, n, part, _packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), _packed(counts[lo:hi])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])], ["block", "kind", "part", "keys", "counts"])

    return made.select("block", "doc_ids", "held", "sizes", "vocabulary", "tokens").mapInArrow(run, PACKETS)


def merged(sent: DataFrame) -> DataFrame:
    """The answers: for each packet the training counts over all blocks; types and totals once a range."""

    def run(t: pa.Table) -> pa.Table:
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        keys = [np.cumsum(_unpacked(x.as_py())) if kind else np.zeros(1, np.uint64) for x in t.column("keys")]
        counts = np.concatenate([_unpacked(x.as_py()) for x in t.column("counts")]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        answer, at = [], 0
        for k in keys:
            answer.append(_packed(total[place[at:at + len(k)]]))
            at += len(k)
        rest = [0] * (t.num_rows - 1)
        return pa.table({"block": t.column("block"), "kind": t.column("kind"), "part": t.column("part"), "counts": pa.array(answer, pa.binary()),
                         "types": pa.array([int((total > 0).sum()), *rest], pa.int64()), "total": pa.array([int(total.sum()), *rest], pa.int64())})

    return sent.groupBy("kind", "part").applyInArrow(run, ANSWERS)


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are numbered: the root, then the histories of 1, 2, ... words in order of their keys, then
    the histories of starts alone. An arc's code is its state times the vocabulary's size plus the word.
    """

    def __init__(self, own: Block, counts: dict[int, np.ndarray], starts: int, tokens: int, types: int, prior: float):
        words, top = len(own.vocabulary), own.order - 1
        word, first = own.tokens.astype(np.int64), own.ends - own.sizes
        ended = np.zeros(len(word), bool)
        ended[own.ends - 1] = True
        offset = [0, 1]  # of the states of each length
        for n in range(1, own.order):
            offset.append(offset[n] + len(counts[n]))
        begin = offset[own.order]  # the history of n starts is begin + n - 1, that of none the root
        self.initial = begin + top - 1 if top else 0
        self.words = words
        self.fail = np.zeros(begin + top, np.int64)
        self.fail_weight = np.zeros(begin + top)
        self.fail[begin + 1:] = np.arange(begin, begin + top - 1) if top > 1 else 0
        self.fail_weight[begin:] = np.log10(prior / (starts + prior))
        codes, targets, weights = [], [], []
        lower, before = None, None  # of the n-grams one shorter: probabilities, and each token's
        for n in range(1, own.order + 1):
            keys, place, _ = own.distinct(n)
            seen = counts[n]
            at = np.zeros(len(keys), np.int64)
            at[place[::-1]] = np.arange(len(place))[::-1]  # where a text has each n-gram
            if n == 1:
                state = np.zeros(len(keys), np.int64)
                chance = (seen + ADD) / (tokens + ADD * (types + 1))
            else:
                state = offset[n - 1] + before[np.maximum(at, 1) - 1]
                held = np.where(state < begin, counts[n - 1][before[np.maximum(at, 1) - 1]], 0)
                opening = np.isin(at, first)
                state[opening], held[opening] = begin + n - 2, starts
                chance = (seen + prior * lower[before[at]]) / (held + prior)
            # Only the root has arcs for what training has not seen; they lead back to it.
            real = seen > 0 if n > 1 else np.ones(len(keys), bool)
            to = np.where(seen > 0, offset[n] + np.arange(len(keys)), 0) if n < own.order else offset[n - 1] + before[at]
            to = np.where(ended[at], self.initial, to)
            codes.append(state[real] * words + word[at[real]])
            targets.append(to[real])
            weights.append(np.log10(chance[real]))
            if n < own.order:
                self.fail[offset[n]:offset[n + 1]] = offset[n - 1] + before[at] if n > 1 else 0
                self.fail_weight[offset[n]:offset[n + 1]] = np.log10(prior / (seen + prior))
            if n == 1:
                self.known, self.base = seen[place] > 0, weights[0][place]
            lower, before = chance, place
        order = np.argsort(codes := np.concatenate(codes))
        self.codes, self.targets, self.weights = codes[order], np.concatenate(targets)[order], np.concatenate(weights)[order]
        self.reach = top

    def read(self, word: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """The log-probability of each token of a stream, which begins in the state of starts."""
        n, out = len(word), np.zeros(len(word))
        step = max(self.reach + 1, -(-n // lanes))
        at = np.arange(0, n, step) - self.reach
        at[0] = 0
        stop = np.minimum(np.arange(0, n, step) + step, n)
        state = np.zeros(len(at), np.int64)
        state[0] = self.initial
        own = np.arange(0, n, step)
        while len(at):
            token = word[at]
            weight, todo = np.zeros(len(at)), np.arange(len(at))
            while len(todo):
                code = state[todo] * self.words + token[todo]
                place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[place] == code
                done, place = todo[hit], place[hit]
                weight[done] += self.weights[place]
                state[done] = self.targets[place]
                todo = todo[~hit]
                weight[todo] += self.fail_weight[state[todo]]
                state[todo] = self.fail[state[todo]]
            counted = at >= own
            out[at[counted]] = weight[counted]
            at = at + 1
            going = at < stop
            if not going.all():
                at, state, stop, own = at[going], state[going], stop[going], own[going]
        return out


def scores(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text",
           block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Learns from the documents whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as
    empty text, which is held out). Null or empty texts are one token, the end. Rows that repeat
    count as often as they stand. An empty table gives an empty result.
    """
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.crc32(text_id.cast("binary")) % 10 == 0).alias("held"))
    made = bucketed(blocks(rows, block_tokens), "block", "blocks")
    size = made.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, int(size * order // range_keys).bit_length())
    width = min(64, int(size * order).bit_length() + 24)
    # The single words first: the model needs their totals. The answers on longer n-grams go straight to the blocks.
    short = written(merged(packets(made, order, bits, width, range(2))), "answers")
    answers = short.unionByName(merged(packets(made, order, bits, width, range(2, order + 1)))) if order > 1 else short
    counted = short.where("kind = 1").agg(F.sum("total"), F.sum("types")).first()
    tokens, types = counted[0] or 0, counted[1] or 0
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        got = {}
        for kind, part, raw in sorted(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("counts").to_pylist()), key=lambda r: r[:2]):
            got.setdefault(kind, []).append(_unpacked(raw).astype(np.int64))
        for row in left.to_pylist():
            own = Block(row, order, width)
            counts = {k: np.concatenate(v) for k, v in got.items()}
            machine = Automaton(own, counts, int(counts[0][0]), tokens, types, prior)
            first = own.ends - own.sizes
            weights = machine.read(own.tokens.astype(np.int64))
            out.append(pa.table([pa.array(own.ids, pa.int64()), pa.array(own.held), pa.array(own.sizes), pa.array(np.add.reduceat(machine.known.astype(np.int64), first)),
                                 pa.array(np.full(len(first), tokens)), pa.array(np.add.reduceat(machine.base, first)), pa.array(np.add.reduceat(weights, first))],
                                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    told = answers.select("block", "kind", "part", "counts")
    return made.drop("n_tokens").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(read, out_schema)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"))
    # Bits of ten that the histories tell of a token beyond its frequency.
    return out.withColumn("gain_per_token", (F.col("score") - F.col("base_score")) / F.col("n_tokens"))
