import itertools

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import store
from ledgerlake.llm.piece_ids import ByteEncoder, WordEncoder

PATHS = {ByteEncoder: public_tokenizers.path("byte_bpe_50k.json"), WordEncoder: public_tokenizers.path("word_bpe_49k.json")}
ENCODERS = {kind: kind(path) for kind, path in PATHS.items()}
TOKENIZERS = {kind: Tokenizer.from_file(path) for kind, path in PATHS.items()}
PARTS = [*"aB9_.'(\"-é“、\n\t \x0b\x1c\x85\xa0 ᠎ ​　́Σ", "\n\n", "  ", "\r\n", "'s", "'LL", "x\ny", "<|", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]


def whole(kind, texts):
    return [TOKENIZERS[kind].encode(t or "", add_special_tokens=False).ids for t in texts]


def pieced(encoder, texts):
    ids, *ends = encoder(texts)
    starts, stops = ends if len(ends) == 2 else (ends[0][:-1], ends[0][1:])
    return [ids[a:z].tolist() for a, z in zip(starts, stops, strict=True)]


@pytest.mark.parametrize("kind", ENCODERS)
@settings(max_examples=500, deadline=None)
@given(texts=st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6), first=st.integers(0, 2))
def test_cut_texts_encode_as_whole_ones(kind, texts, first):
    assert pieced(ENCODERS[kind], pa.array(texts, pa.string())[first:]) == whole(kind, texts[first:])


@pytest.mark.parametrize("kind", ENCODERS)
def test_words_beside_marks_and_line_ends_are_encoded_once(kind):
    encoder = kind(PATHS[kind])
    heads, tails = ([f"{x}{c}" for c in "abcdefghijklmnopqrst"] for x in ("head", "tail"))
    texts = [f"so {a}.\n{b}, or {a}? ({b})" for a, b in itertools.product(heads, tails)]
    assert pieced(encoder, pa.array(texts)) == whole(kind, texts)
    assert len(encoder.pieces.row) < 100


@pytest.mark.parametrize("kind", ENCODERS)
def test_a_full_memo_keeps_what_is_used_most(kind):
    encoder = kind(PATHS[kind])
    encoder.pieces.most = 40
    encoded, encode = [], encoder.pieces.encode
    encoder.pieces.encode = lambda new: (encoded.extend(new), encode(new))[1]
    for k in range(20):
        texts = ["the cat the dog the cat", *[f"the word{chr(97 + k)}{c}" for c in "abcdefghij"]]
        assert pieced(encoder, pa.array(texts)) == whole(kind, texts)
    assert encoded.count(" the") == encoded.count("the") == 1
    assert len(encoded) < 20 * 10 + 10


def test_batch_limits_hold_within_only(spark):
    before = {k: spark.conf.get(k, None) for k in store.BATCH}
    with store.small_batches(spark):
        assert {k: spark.conf.get(k) for k in store.BATCH} == store.BATCH
    assert {k: spark.conf.get(k, None) for k in store.BATCH} == before


def test_case_and_kind_of_white_space_make_no_new_word():
    encoder = WordEncoder(PATHS[WordEncoder])
    texts = ["so The the\tTHE\nthe tHE", "so <|endoftext|> The", "so <|EndOfText|> THE"]
    assert pieced(encoder, pa.array(texts[:1])) == whole(WordEncoder, texts[:1])
    assert len(encoder.pieces.row) == 2
    assert pieced(encoder, pa.array(texts)) == whole(WordEncoder, texts)
