"""Operators on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import re
import zlib
from hashlib import sha256
from math import log10

import pytest

from steploom.llm import chat, embedding_dedup, jaccard, line_dedup, lm_scoring, mixing, packing, pii, quality, token_store

WORD = re.compile("[^\x20\x09-\x0d]+")
P = pytest.importorskip("public_tokenizers")


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mixing(docs):
    d = docs([(i, "w " * (i % 7), f"s{i % 3}" if i % 4 else None) for i in range(200)] + [(200, None, "s0"), (5, "w " * 5, "s2")])
    got = mixing.mix(d, budgets=(0.5, 1.0)).collect()
    one = {r["doc_id"]: r for r in got if r["budget"] == 1.0}
    half = {r["doc_id"]: r for r in got if r["budget"] == 0.5}
    assert all(half[k]["copies"] <= one[k]["copies"] for k in one)
    by = {}
    for r in got:
        if r["budget"] == 1.0:
            t = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
            t[0] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(len(WORD.findall(r["text"] or "")) for r in d.collect())
    assert sum(t[1] for t in by.values()) == pytest.approx(total)
    assert all(abs(t[0] - t[1]) <= 10 for t in by.values())
    assert mixing.mix(docs([])).count() == 0


def test_jaccard_against_brute_force(docs):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randrange(50)}" for _ in range(n)] for n in (3, 4, 9, 14, 30, 120)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    table = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n "), (0, texts[0])]
    sets = {}
    for i, t in table:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(table), 4, 85, 100).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard.jaccard_components(docs([])).count() == 0


def test_embeddings(spark):
    v = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.99, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1), (9, [1.0, 0.0], None), (10, [2.0, 0.0], 1), (11, [], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(df, 0.98).collect()}
    assert got[1] == (3, 1, True) and got[3] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 11))
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_token_store(spark, docs, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    table = [(5, "hello big world " * 200), (1, None), (3, ""), (9, "hello big world " * 200 + "end"), (3, "again")]
    token_store.write_store(docs(table), str(tmp_path / "s"), P.path("word_bpe_49k.json"), 2)
    got = sorted(tuple(r) for r in token_store.read_back(spark, str(tmp_path / "s")).collect())
    assert all(r[4] for r in got) and [r[0] for r in got] == [1, 3, 3, 5, 9]
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in table}
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(ids[t]) for _, t in table)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    back = {bytes(r["ids"]) for r in token_store.restored(spark, str(tmp_path / "s")).collect()}
    assert back == set(ids.values())


def test_quality_cutoffs(spark, docs):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(2000)]
    bad = [(i, " ".join(f"w{i}x{j}###" for j in range(60))) for i in range(2000, 2100)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    d = docs([*good, *bad, (9000, None), (9001, "La " * 80)])
    got = {r["doc_id"]: r for r in quality.quality(d, labels).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert got[9000]["base_failed"] and got[9000]["n_words"] == 0 and got[9001]["n_repeat_words"] == 80
    kept = quality.good_documents(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    none = quality.quality(d, labels.limit(0)).where("doc_id >= 2000 AND doc_id < 2100 AND kept").count()
    assert none == 100 and quality.quality(docs([]), labels).count() == 0


def test_repeat_words(docs):
    texts = ["a b c a b c", "a a a a", "a b c", "x a b c y a b c z a b c d", "a b c d a b c d", ""]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measured(docs(list(enumerate(texts))), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        g = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        assert got[i] == len({k for j, x in enumerate(g) if g.count(x) > 1 for k in (j, j + 1, j + 2)}), t


def test_line_dedup(docs):
    d = docs([(i, f"Common LINE \nown {i}\n\ncommon line") for i in range(10)] + [(10, None), (11, "nine"), (12, "x\n\ty")] + [(0, "Common LINE \nown 0\n\ncommon line")])
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(d, 10).collect()}
    assert got[3]["text"] == "own 3\n" and got[3]["_n_lines"] == 4 and got[3]["_n_dropped"] == 2
    assert got[10]["text"] == "" and got[10]["_n_lines"] == 1 and got[12]["text"] == "x\n\ty"
    assert line_dedup.drop_common_lines(d, 11).where("_n_dropped > 0").count() == 0


def test_lm_against_brute_force(docs):
    table = [(i, t) for i, t in enumerate(["a b a", "A b c", "", None, "c c c a", "zz a b"] * 5)]
    tok = {i: [w.lower() for w in WORD.findall(t or "")] + ["</s>"] for i, t in table}
    train = [i for i in tok if zlib.crc32(str(i).encode()) % 10]
    for order in (2, 3):
        counts = [{} for _ in range(order + 1)]
        for i in train:
            w = ["<s>"] * (order - 1) + tok[i]
            for j in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    g = tuple(w[j - n + 1:j + 1])
                    counts[n][g] = counts[n].get(g, 0) + 1
        total, types = sum(counts[1].values()), len(counts[1])
        got = {r["doc_id"]: r for r in lm_scoring.scores(docs(table), order=order, prior=5.0, block_tokens=20, range_keys=30).collect()}
        for i in tok:
            w, score = ["<s>"] * (order - 1) + tok[i], 0.0
            for j in range(order - 1, len(w)):
                p = (counts[1].get((w[j],), 0) + 0.1) / (total + 0.1 * (types + 1))
                for n in range(2, order + 1):
                    g = tuple(w[j - n + 1:j + 1])
                    h = sum(c for k, c in counts[n].items() if k[:-1] == g[:-1])
                    p = (counts[n].get(g, 0) + 5.0 * p) / (h + 5.0)
                score += log10(p)
            assert got[i]["score"] == pytest.approx(score), (order, i)
            assert got[i]["train_tokens"] == total and got[i]["n_tokens"] == len(tok[i])
    assert lm_scoring.scores(docs([])).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_lm_longer_histories_against_brute_force(docs, order):
    assert lm_scoring.ORDER >= 3
    table = [(i, t) for i, t in enumerate(["a b a c", "A b c", "", None, "c c c a b a b", "zz a b c a"] * 5 + ["b a b zz", "a b a b"])]
    tok = {i: ["<s>"] * (order - 1) + [w.lower() for w in WORD.findall(t or "")] + ["</s>"] for i, t in table}
    counts = {}
    for i, w in tok.items():
        for j in range(order - 1, len(w)) if zlib.crc32(str(i).encode()) % 10 else ():
            for n in range(1, order + 1):
                counts[tuple(w[j - n + 1:j + 1])] = counts.get(tuple(w[j - n + 1:j + 1]), 0) + 1
    after = {}
    for g, c in counts.items():
        after[g[:-1]] = after.get(g[:-1], 0) + c
    types = sum(len(g) == 1 for g in counts)
    want = {}
    for i, w in tok.items():
        want[i] = 0.0
        for j in range(order - 1, len(w)):
            p = (counts.get((w[j],), 0) + 0.1) / (after[()] + 0.1 * (types + 1))
            for n in range(2, order + 1):
                g = tuple(w[j - n + 1:j + 1])
                p = (counts.get(g, 0) + 5.0 * p) / (after.get(g[:-1], 0) + 5.0)
            want[i] += log10(p)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs(table), order=order, prior=5.0, block_tokens=20, range_keys=30).collect()}
    assert got == pytest.approx(want)


def test_packing(docs):
    table = [(i, "word salad " * (i * 37 % 900)) for i in range(60)] + [(60, None), (3, "twice")]
    got = [r.asDict() for r in packing.pack(docs(table), P.path("byte_bpe_50k.json"), 1).collect()]
    seq = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in got}.values())
    assert packing.pack(docs([]), P.path("byte_bpe_50k.json"), 1).count() == 0


def test_personal_data(docs):
    text = "mail a.b@c.de, 10.0.0.256 10.0.0.1 4111 1111 1111 1111 4111 1111 1111 1112 +1 (212) 555-0199 é x@y.z"
    got = {r["doc_id"]: r for r in pii.personal_data(docs([(1, text), (2, None), (3, ""), (1, text), (4, "1 " * 3000 + "a@b.c")])).collect()}
    found = [(pii.KINDS[s["k"]], text[s["start"]:s["end"]]) for s in got[1]["base"]]
    assert ("email", "a.b@c.de") in found and ("ip", "10.0.0.1") in found and ("email", "x@y.z") in found and ("phone", "+1 (212) 555-0199") in found
    assert ("ip", "10.0.0.256") not in found and not got[2]["spans"] and not got[3]["spans"]
    assert [(s["k"], s["start"]) for s in got[4]["base"]] == [(0, 6000)]
    assert pii.personal_data(docs([])).count() == 0


def test_chat(spark):
    t = spark.createDataFrame([(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (1, 1, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.placed(chat.formatted_turns(t))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20 and got[1]["loss_sha256"] == sha256(b"<|im_end|>" * 2).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["turns_sha256"] == sha256(b"\nx\n").hexdigest()
    assert chat.read_back(chat.placed(chat.formatted_turns(t.limit(0)))).count() == 0
