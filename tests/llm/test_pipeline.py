"""The stages of corpus_pipeline on small tables, against brute force."""

import re

import pytest

import corpus_pipeline as pipeline

WORD = re.compile("[^\x20\x09-\x0d]+")


def _shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _survivors(rows):
    """The number of groups, and the texts in each: distinct (id, text) pairs joined at Jaccard 0.8; empty texts are alone."""
    pairs = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    sets = [_shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    groups = {}
    for r, p in zip(root, pairs):
        groups.setdefault(r, set()).add(p)
    return list(groups.values())


def _text(name):
    """A text whose length is its own, so that its tokens tell it from others."""
    return " ".join(f"{name}{j}" for j in range(60 + 3 * (ord(name) - ord("a"))))


ROWS = [(1, _text("a")), (1, _text("b")), (2, _text("b")), (3, _text("c")), (3, _text("c")), (None, _text("d")), (None, _text("d")), (None, _text("c")),
        (None, _text("e")), (4, _text("e") + " more"), (5, _text("f")), (6, _text("f")), (7, ""), (8, None), (5, _text("g"))]


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in pipeline.near_duplicates(spark, docs(ROWS), "").collect()]
    groups = _survivors(ROWS)
    assert len(got) == len(groups) and all(len(g & set(got)) == 1 for g in groups)
    plain = [r for r in ROWS if r[0] in (2, 4, 6, 7, 8)]
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs(plain + [(9, _text("b"))]), "").collect()}
    assert kept == {2, 4, 6, 7, 8}


def test_run_packs_one_text_of_each_group(spark, docs, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs(ROWS).drop("n_words").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]), []).append(r)
    groups = [g for g in _survivors(ROWS) if all(len(WORD.findall(t)) >= 50 for _, t in g)]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {p: (p[0], len(tok.encode(p[1], add_special_tokens=False).ids) + 1) for g in groups for p in g}
    mixed = set(got)
    assert mixed and all(len(mixed & {size[p] for p in g}) <= 1 for g in groups) and mixed <= set(size.values())
