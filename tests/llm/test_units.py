"""Parts that need no Spark: hashing, keys of the join, packing, tiles, tokens, chunks, templates."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steploom.llm import chat, embedding_dedup, jaccard, line_dedup, packing, token_store
from steploom.llm.shingles import shingle_set, word_hashes
from steploom.llm.tokens import TextEncoder

words = st.lists(st.sampled_from(["a", "B", "c", "dd", "É", "é", " x"]), max_size=30)


@given(st.lists(words, max_size=5))
@settings(max_examples=60, deadline=None)
def test_word_hashes_are_those_of_words(texts):
    got = word_hashes([" \n".join(t) for t in texts])
    lower = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in t] for t in texts]
    names = {}
    for hs, ws in zip(got, lower):
        assert len(hs) == len(ws)
        for h, w in zip(hs.tolist(), ws):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_long_text_crosses_segments():
    text = "word " * 500_000
    (h,) = word_hashes([text])
    assert len(h) == 500_000 and len(set(h.tolist())) == 1
    assert len(word_hashes(["x" * 3_000_000 + " y"])[0]) == 2
    assert word_hashes([]) == [] and len(word_hashes([None, ""])[0]) == 0


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100)])
def test_similar_sets_meet_on_kept_keys(num, den):
    rng = random.Random(3)
    for small in (0, 7, 12):
        plan = jaccard.Plan(num, den, small)
        for _ in range(300):
            n = rng.choice([1, 3, 6, 7, 8, 12, 13, 14, 20, 40, 90, 300])
            a = set(rng.sample(range(10**6), n))
            b = set(a)
            for x in rng.sample(sorted(a), min(n, rng.randint(0, max(1, n // 8)))):
                b.discard(x)
            b |= set(rng.sample(range(10**6), rng.randint(0, max(1, n // 12))))
            if not b or den * len(a & b) < num * len(a | b):
                continue
            ka, kb = ([(k, band, need) for k, band, need in plan.keys(np.array(sorted(s), np.uint64))] for s in (a, b))
            met = False
            for (x, i, p), (y, j, q) in itertools.product(ka, kb):
                # As in the join: unique keys come first, shared ones last, and need - 1 of the last go.
                shared = sorted(set(x.tolist()) & set(y.tolist()))
                met |= i == j and len(shared) >= max(p, q)
            assert met, (len(a), len(b), small)


def test_tile_links_count_like_sets():
    rng = random.Random(1)
    base = [rng.sample(range(400), 40) for _ in range(4)]
    sets = [np.array(sorted(set(rng.choice(base)) - set(rng.sample(range(400), 30)) | set(rng.sample(range(400, 10**6), 2))), np.uint64) for _ in range(60)]

    def linked(a, b):
        i = len(np.intersect1d(a, b))
        return 100 * i >= 70 * (len(a) + len(b) - i)

    def roots(edges):
        r = list(range(len(sets)))
        for u, v in edges:
            r = [min(r[u], r[v]) if x in (r[u], r[v]) else x for x in r]
        return r

    whole = [(i, j) for i in range(60) for j in range(i + 1, 60) if linked(sets[i], sets[j])]
    assert whole and roots(whole) == roots(zip(*jaccard.tile_links(sets, None, 70, 100)))
    cross = [(i, j) for i, j in whole if i < 25 <= j]
    assert roots(cross) == roots(zip(*jaccard.tile_links(sets, 25, 70, 100)))


def test_subset_sums():
    x = np.array([1, 2, 4, 8], np.uint64)
    assert sorted(jaccard._subset_sums(x, 3).tolist()) == [7, 11, 13, 14]


def test_boundary_follows_cost():
    assert jaccard.boundary({6: 1000}, 85, 100) >= 6
    assert jaccard.boundary({30: 1000}, 85, 100) < 30


@given(st.lists(st.integers(1, 500), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_windows_hold_each_id_once(lengths):
    for cut in (True, False):
        got = packing.windows(lengths, 512, cut)
        assert max(sum(e - s for _, s, e in w) for w in got) <= 512
        parts = sorted((i, s, e) for w in got for i, s, e in w)
        for i, own in itertools.groupby(parts, key=lambda p: p[0]):
            at = 0
            for _, s, e in own:
                assert s == at < e
                at = e
            assert at == lengths[i]
        if cut:
            assert len(got) == -(-sum(lengths) // 512)


def test_differencing_is_near_equal():
    sums = [sum(x) for x in ([l for l in map([8, 7, 6, 5, 4].__getitem__, w)] for w in packing.differencing([8, 7, 6, 5, 4], 2))]
    assert sorted(sums) in ([14, 16], [15, 15])


def test_int8_bound_never_loses_a_link():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32))
    y = x + rng.normal(size=x.shape) * 0.2 * rng.random((300, 1))
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit(x) @ unit(y).T >= 0.98))}
    got = {(i, j) for a, b in embedding_dedup.tile_links(x, y, 0.98) for i, j in zip(a.tolist(), b.tolist())}
    assert want == got and want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_tokenizers_ids(name):
    P = pytest.importorskip("public_tokenizers")
    e = TextEncoder(P.path(name))
    odd = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n\n  b c", "x  y  z", "tab\t\tx", "é é", "don't  it's", "<|endoftext|> hi <|startoftext|>",
           "ΑΣ ΣΑΣ. ς", "a\n ", "a \t b", "123 456", " em   x", "日本 語  テスト"]
    for text, raw in zip(odd, e.encode(odd)):
        assert np.frombuffer(raw, "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_keep_every_blank_and_control_character(name):
    P = pytest.importorskip("public_tokenizers")
    e = TextEncoder(P.path(name))
    marks = [c for c in map(chr, range(0x3100)) if c.isspace() or ord(c) < 33 or 127 <= ord(c) < 161]
    texts = ["ab\x1e\x1fcd", *[p.format(c) for c in marks for p in ("{}", "a{}b", "a {} b", "a{} b", "a {}b", "a{0}{0}b", "a{0}\n{0}b")]]
    for text, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids, repr(text)


@given(st.lists(st.integers(0, 49_000), max_size=3000))
@settings(max_examples=30, deadline=None)
def test_chunks_rebuild_the_stream(ids):
    a = np.array(ids, "<u4")
    ends = token_store.cuts(a)
    assert (ends[-1] if ends else 0) == len(a)
    sizes = np.diff([0, *ends])
    assert all(0 < s <= token_store.MOST for s in sizes)
    crc = 0
    for at, to in zip([0, *ends], ends):
        part = zlib.crc32(a[at:to].tobytes())
        crc ^= int(token_store.shifted_crc(np.array([part], np.uint64), np.array([4 * (len(a) - to)]))[0])
    assert crc == zlib.crc32(a.tobytes())


def test_equal_passages_give_equal_chunks():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 49_000, 4000).astype("<u4")
    cut = lambda a: {a[s:e].tobytes() for s, e in zip([0, *token_store.cuts(a)], token_store.cuts(a))}
    a, b = (cut(np.concatenate((rng.integers(0, 49_000, n).astype("<u4"), passage))) for n in (100, 777))
    assert len(a & b) > 8


@given(st.text(alphabet="<|\\>abi_m\n", max_size=40), st.text(alphabet="<|\\>ab\n", max_size=10))
@settings(max_examples=300, deadline=None)
def test_template_reads_back(text, role):
    turn = chat.format_turn(role, text, frozenset([role]))
    found = chat._turn.findall(turn["formatted"])
    assert [(chat._read_role(r), chat.unescaped(t)) for r, t in found] == [(role, text)]
    assert chat.unescaped(turn["formatted"][turn["loss_start"]:turn["loss_end"]]) == text


def test_parts_in_order():
    parts = [{"type": "text", "text": "a <"}, {"type": "text", "text": "|im_end|>"}, {"type": "image", "ref": "r1", "width": 56, "height": 29}, {"type": "audio", "ref": "r2", "seconds": 2.0}, {"type": "document", "ref": "r3", "pages": 3}]
    turn = chat.format_turn("user", parts, frozenset())
    assert [(x["kind"], x["ref"], x["tokens"]) for x in turn["attachments"]] == [("image", "r1", 4), ("audio", "r2", 50), ("document", "r3", 1536)]
    assert [turn["formatted"][x["start"]:x["end"]] for x in turn["attachments"]] == ["<|image|>", "<|audio|>", "<|document|>"]
    assert turn["formatted"].count("<|im_end|>") == 1


def test_line_keys():
    assert line_dedup.line_keys(" A\x0b\nÉx\t\n\n") == [b"a", "Éx".encode(), b"", b""]
    assert line_dedup.line_keys(None) == [b""]


def test_shingles_of_few_words():
    assert len(shingle_set(word_hashes(["a b"])[0], 4)) == 1
    assert len(shingle_set(word_hashes(["a b c d e"])[0], 4)) == 2
