import collections

import numpy as np
import public_tokenizers
import pyarrow as pa
from brute import crc
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD
from tokenizers import Tokenizer

from ledgerlake.llm import online_packing, registry
from ledgerlake.llm.piece_ids import WordEncoder, word_encoder

SF001 = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abé1.'s \n\t\r\x1c　İßſ×ª", "<|endoftext|>", "<|startoftext|>", "  ", "😀", "é", "'ll"]), max_size=30)
                .map("".join), max_size=4))
def test_words_encode_as_the_whole_text(texts):
    ids, ends = word_encoder(PATH)(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [whole(t) for t in texts]


def test_a_full_memo_starts_anew():
    encoder = WordEncoder(PATH)
    encoder.pieces.most = 5
    for _ in range(2):
        texts = pa.array(["one two three four", None, "five, six two", "seven eight nine ten eleven twelve"])
        ids, ends = encoder(texts)
        assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [whole(t) for t in texts.to_pylist()]


def check(rows, docs, size, most_padding):
    """Every id of every document in exactly one piece, windows gapless and padded little."""
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= most_padding
    # documents of the same ids under one doc_id are told apart by number only
    want = collections.defaultdict(list)
    for doc, text in docs:
        want[doc].append([*whole(text), 2])
    covered = collections.Counter()
    for (doc, start, length, sum_, total), times in pieces.items():
        fits = [ids for ids in want[doc] if len(ids) == total and crc(ids[start : start + length]) == sum_]
        assert fits
        covered[doc] += length * times
    assert covered == {doc: sum(map(len, all_)) for doc, all_ in want.items()}


def test_odd_rows(spark, odd, none):
    check(online_packing.pack(odd).collect(), ODD, 4096, 0)
    for size, windows, fan in ((8, 2, 2), (64, 1, 2), (100, 3, 3)):
        rows = online_packing.pack(odd.repartition(7), size=size, open_windows=windows, fan=fan).collect()
        check(rows, ODD, size, 0 if size & (size - 1) == 0 else size)
    assert online_packing.pack(none).count() == 0


def test_documents_of_the_table(spark):
    docs = registry.documents(spark, SF001).repartition(5)
    check(online_packing.pack(docs, fan=2).collect(), [tuple(r) for r in docs.collect()], 4096, 0)


def test_placing_is_best_fit_and_emits_the_fullest():
    windows = online_packing.Windows(0, 0, 10, 2)
    item = lambda n: (n, 0, n, np.zeros(n, np.int32))
    windows.place(item(6))
    windows.place(item(7))  # no room: a second window
    windows.place(item(3))  # fits both: the fuller one, which is full then and goes
    assert [(r[0], r[5], r[6]) for r in windows.out] == [(7, 0, 0), (3, 0, 7)] and [w[0] for w in windows.open] == [4]
    windows.place(item(5))  # opens the second
    windows.place(item(8))  # none fits: the fullest takes its head and goes, the rest is placed
    assert [(r[0], r[1], r[2], r[6]) for r in windows.out[2:]] == [(6, 0, 6, 0), (8, 0, 4, 6)]
    assert sorted(w[0] for w in windows.open) == [1]
    windows.close()
    assert [(r[2], r[5]) for r in windows.out[4:]] == [(5, 2), (3, 2), (1, 3)]
