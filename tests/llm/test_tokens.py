import io
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tramline.llm import idcoder, packing, token_output, tokens
from tramline.llm.common import Workspace
from tramline.llm.tokens import NAMES, WordCachedTokenizer, public_path

from .conftest import prose

FACTORY = {n: (Tokenizer.from_file(public_path(n)), WordCachedTokenizer(public_path(n))) for n in NAMES}


def plain(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", NAMES)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé ñ́ \n\t 'sS,.!1<|²Σς 東-_\x1c"), max_size=30), max_size=4))
@settings(max_examples=150, deadline=None)
def test_cached_ids_equal_direct_ones(name, texts):
    direct, cached = FACTORY[name]
    assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode_batch([*texts, None])] == [plain(direct, t).tolist() for t in [*texts, None]]


@given(st.lists(st.integers(0, 60_000), max_size=400), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, repeat):
    x = np.array(ids * (repeat + 1), "<u4")
    data = idcoder.encode_block(x)
    y, end = idcoder.decode_block(b"??" + data, 2)
    assert y.tolist() == x.tolist() and end == len(data) + 2


def test_large_block_compresses_and_damage_shows():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.integers(0, 3, 30_000)).astype("<u4") % 500
    data = idcoder.encode_block(x)
    assert len(data) < 2 * len(x)
    for at in (5, 40, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(idcoder.CorruptBlock):
            y, _ = idcoder.decode_block(bytes(bad))
            if y.tolist() == x.tolist():  # the flipped bit carried nothing
                raise idcoder.CorruptBlock
    with pytest.raises(idcoder.CorruptBlock):
        idcoder.decode_block(data[:-9])


def expected_digests(texts, name, end):
    direct = FACTORY[name][0]
    return {i: np.append(plain(direct, t), end).astype("<u4") for i, t in enumerate(texts)}


def test_token_files(spark, make_docs, edge_texts):
    work = Workspace(spark, "t")
    folder = work.path("files")
    manifest = work.store(token_output.write_token_files(make_docs(edge_texts), folder, block_ids=500, file_ids=4000), "manifest")
    got = token_output.read_token_files(manifest).collect()
    direct = FACTORY["byte_bpe_50k.json"][0]
    want = sorted((i is not None, i or 0, len(ids := np.append(plain(direct, t), 0).astype("<u4")), zlib.crc32(ids.tobytes())) for i, t in edge_texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert manifest.count() > 2
    assert token_output.read_token_files(work.store(token_output.write_token_files(make_docs([]), work.path("none")), "m")).count() == 0


def test_file_cut_short_is_an_error(tmp_path):
    w = token_output.FileWriter(f"file://{tmp_path}", 100, 10**6)
    w.add(1, np.arange(250, dtype="<u4"))
    name = w.close()[0]
    data = (tmp_path / name).read_bytes()
    assert [(d, x.tolist()) for d, x in token_output.read_documents(io.BytesIO(data))] == [(1, list(range(250)))]
    with pytest.raises(idcoder.CorruptBlock):
        list(token_output.read_documents(io.BytesIO(data[:-30])))


@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_differencing_deals_every_item_once(lengths):
    windows = packing.pack(lengths, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 100 for w in windows)


def test_differencing_balances():
    rng = random.Random(2)
    lengths = [rng.randint(20, 100) for _ in range(400)]
    sums = [sum(lengths[i] for i in w) for w in packing.difference(lengths, 20)]
    assert max(sums) - min(sums) <= 5
    with pytest.raises(ValueError):
        packing.pack([101], 100)


def test_packing_covers_all_ids(spark, make_docs, edge_texts):
    rng = random.Random(5)
    texts = edge_texts + [(100 + i, prose(rng, rng.randint(1, 400))) for i in range(200)]
    rows = packing.pack_documents(make_docs(texts)).collect()
    direct = FACTORY["word_bpe_49k.json"][0]
    left = {}
    for i, t in texts:
        left.setdefault(i, []).append(np.append(plain(direct, t), 1).astype("<u4"))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(left)
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, left[i]))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in left[i])
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert total / (2048 * len(windows)) > 0.85
    assert packing.pack_documents(make_docs([])).count() == 0


def test_windows_are_filled_for_any_lengths():
    rng = np.random.default_rng(4)
    cases = [[300] * 1000 + [512] * 24, [512] * 1024, [1025] * 100, [683] * 1024, rng.integers(1, 513, 1024).tolist(), [2047] * 40, [1], [2048]]
    for lengths in cases:
        windows = packing.pack_cut(lengths)
        assert max(sum(n for _, _, n in w) for w in windows) <= packing.WINDOW
        pieces = sorted(p for w in windows for p in w)
        covered = [0] * len(lengths)
        for i, start, n in pieces:
            assert start == covered[i] and n > 0
            covered[i] += n
        assert covered == lengths
        least = -(-sum(lengths) // packing.WINDOW)
        assert len(windows) == least or sum(lengths) >= 0.97 * packing.WINDOW * len(windows)


@pytest.mark.parametrize("name", NAMES)
def test_mixed_white_space_and_scripts_encode_as_the_tokenizer_does(name):
    rng = random.Random(5)
    parts = ["foo", "Bar", " ", "  ", "\n", "\n\n", " \n", "\n ", ",", ".", "!!", "é", "İstanbul", "ßx", "123", "3.5", "'s", "don't", "\t", "中文", "Σας", "x" * 70, "-", "(a)", "<|endoftext|>", "\xa0", "e\u0301", "Ǆ"]
    tokenizer = FACTORY[name][1]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "\n"]
    want = [np.array(tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokenizer.encode_batch(texts) == want


def test_chunks_that_share_a_place_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "SLOT_BITS", 3)
    own = tokens.WordCachedTokenizer(tokens.public_path("byte_bpe_50k.json"))
    whole = [" ".join(f"{a}{n}x, {a * 9}middle{n}tail" for a in ("ab", "Öl", "q") for n in range(40)), "", None, "ab1x, ab1x, élève"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(whole)] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in whole]
    assert 0 < len(own.chunks) <= 8


def test_looking_up_does_not_grow_with_what_is_kept():
    own = tokens.WordCachedTokenizer(tokens.public_path("byte_bpe_50k.json"))
    kept = pa.array([f"{i:x}" for i in range(400_000)])
    own.slots[tokens.slots_of(kept)] = np.arange(len(kept))
    own.chunks, own.sizes, own.ids = kept, np.ones(len(kept), np.int64), np.zeros(len(kept), np.uint32)
    some = pa.array(["1f", "2e"])
    own._chunks(some)
    began = time.process_time()
    for _ in range(20):
        own._chunks(some)
    assert time.process_time() - began < 0.5
