"""Best-fit packing: the rule step by step, the whole contract, and how few sequences it takes."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from tramline.llm import bestfit
from tramline.llm.tokens import public_path


def squares(rooms):
    return sum(n * n for n in Counter(rooms).values())


def brute_place(rooms, length, capacity):
    """Rooms of the open sequences after the piece: all places tried, the sum of squares taken in full."""
    fits = [i for i, r in enumerate(rooms) if r >= length]
    if not fits:
        return [*rooms, *([capacity - length] if length < capacity else [])], capacity
    tried = [(squares(after := [x for j, r in enumerate(rooms) if (x := r - length * (j == i))]), rooms[i], after) for i in fits]
    _, room, after = min(tried, key=lambda t: t[:2])
    return after, room


@pytest.mark.parametrize("capacity", [4, 11, 30])
def test_each_place_has_the_least_sum_of_squares(capacity):
    rng = random.Random(capacity)
    sequences, rooms = bestfit.Sequences(capacity), []
    for _ in range(400):
        length = rng.randint(1, capacity if rng.random() < 0.2 else max(1, capacity // 3))
        rooms, room = brute_place(rooms, length, capacity)
        _, offset = sequences.place(length)
        assert offset == capacity - room
        assert sorted(rooms) == sorted(r for r in range(1, capacity + 1) for _ in range(sequences.count[r]))


def test_pieces_are_never_too_long():
    with pytest.raises(ValueError):
        bestfit.sum_of_squares([3, 12], 11)
    with pytest.raises(ValueError):
        bestfit.sum_of_squares([0], 11)


def check(rows, docs, capacity=bestfit.CAPACITY):
    """All pieces of all documents once, whole where they fit, gapless in their sequences; the number of sequences."""
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[(doc_id, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_documents_are_packed_whole_into_few_sequences(make_docs, edge_texts):
    from tests.llm.conftest import prose

    rng = random.Random(5)
    docs = [*edge_texts, *((100 + i, prose(rng, rng.randint(3, 600))) for i in range(250))]
    rows = bestfit.pack_whole(make_docs(docs).coalesce(1)).collect()
    n = check(rows, docs)
    assert n <= -(-sum(r.length for r in rows) // bestfit.CAPACITY) + 1


def test_small_capacity_pools_and_partitions(make_docs, edge_texts):
    rows = bestfit.pack_whole(make_docs(edge_texts * 3).repartition(3), capacity=16, pool=4).collect()
    check(rows, edge_texts * 3, 16)


def test_empty_table(make_docs):
    assert bestfit.pack_whole(make_docs([])).collect() == []


def test_query_over_a_written_table(spark, make_docs, edge_texts, tmp_path):
    make_docs(edge_texts).write.parquet(f"{tmp_path}/documents.parquet")
    df = bestfit.op12_bestfit(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    check(df.collect(), edge_texts)
