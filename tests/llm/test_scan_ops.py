import json
import re

import public_tokenizers
from brute import crc, license_row, pii_base
from odd_rows import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, license_scan, packing, pii, registry, token_store
from ledgerlake.llm.piece_ids import byte_encoder

SF001 = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def key(x):
    return json.dumps(x, default=str)


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*"ab é1.'s \n\t\r\x1c\u3000\u2028\x85\xa0 ", "<|endoftext|>", "  ", "😀"]), max_size=40).map("".join), max_size=5))
def test_pieces_encode_as_the_whole_text(texts):
    import pyarrow as pa

    ids, starts, stops = byte_encoder(bpe.vocabulary())(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(starts, stops)] == [whole(t) for t in texts]


def test_license_scan_against_brute_force(spark, odd, none):
    got = license_scan.scan(odd).collect()
    want = [(d, *license_row(t)) for d, t in ODD]
    assert sorted(map(key, [tuple(r[:6]) for r in got])) == sorted(map(key, want))
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan(none).count() == 0
    docs = registry.documents(spark, SF001)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        assert tuple(r[1:6]) == license_row(texts[r.doc_id])


def test_notice_survives_an_inserted_word(spark):
    notice = license_scan.NOTICES[1][0].split()
    rows = [(1, " ".join([*notice[:12], "dear", *notice[12:]])), (2, " ".join(notice[:8])), (3, "licensed under the")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "apache-2.0" in got[1].split(",") and got[3] == ""


def test_pii_against_brute_force(spark, odd, none):
    docs = registry.documents(spark, SF001)
    for df in (odd, docs):
        got = pii.scan(df).collect()
        want = [(r.doc_id, *pii_base((r.text or "").replace("﷐", "�"))) for r in df.select("doc_id", "text").collect()]
        short = [(r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got]
        assert sorted(map(key, short)) == sorted(key((d, n, h)) for d, n, h, _ in want)
    by = {r.doc_id: r.spans for r in pii.scan(odd).collect()}
    spans = pii_base(ODD[9][1])[2]
    assert by[8] == ",".join(s for k in spans for s in spans[k]) and by[8]
    assert pii.scan(none).count() == 0


def test_pii_own_kinds_and_redaction(spark):
    rows = [(1, "bank GB82 WEST 1234 5698 7654 32 ok"), (2, "GB83 WEST 1234 5698 7654 32"), (3, 'token = "' + "a1" * 20 + '"'),
            (4, "a1" * 20), (5, "ssn 123-45-6789"), (6, "123-45-6789"), (7, None), (8, "write joe@x.org or +49 30 1234567, 10.1.2.3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' as _t", "1 as _r")
    got = {r.doc_id: r for r in pii.scan(df).collect()}
    assert [bool(got[i].spans) for i in range(1, 9)] == [True, False, True, False, True, False, False, True]
    red = pii.redact(df)
    assert red.columns == df.columns
    text = {r.doc_id: r.text for r in red.collect()}
    assert text[1] == "bank [IBAN] ok" and text[2] == rows[1][1] and text[7] is None
    assert text[8] == "write [EMAIL] or [PHONE], [IP]" and text[3] == 'token = "[SECRET]"'


def test_iban_before_capitals_and_digits(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    rows = [(i, f"IBAN {x} {more}") for i, (x, more) in enumerate((x, m) for x in ibans for m in ("BIC COBADEFF", "EUR 100", "2024", "and so on", ""))]
    rows.append((99, "IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFF"))  # wrong check digits
    text = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:-1]:
        assert text[i] == "IBAN [IBAN] " + t.split(ibans[i // 5] + " ")[1]
    assert text[99] == rows[-1][1]


def test_long_runs_stay_linear(spark):
    long = ["1.2.3.4 " * 30000, "a" * 300000, "a@" + "b." * 100000, "1 " * 200000, "+1" + "(" * 200000, "1." * 150000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scan(df).collect()}
    assert got[0].n_ip == 30000 and got[2].n_email == 1
    assert [r.n_card for r in got.values()] == [0] * 6


def test_token_store(spark, odd, none):
    got = token_store.digest(odd).collect()
    assert sorted(key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(
        key((d, len(whole(t)) + 1, crc([*whole(t), 2]))) for d, t in ODD)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_store.digest(none).count() == 0


def test_token_files_hold_whole_ids_and_prune(spark, tmpdir_path):
    docs = registry.documents(spark, SF001)
    path = f"{tmpdir_path}/orc"
    token_store.write(docs, path)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in token_store.lookup(spark, path, [3, 77]).collect():
        assert r.ids == [*whole(rows[r.doc_id]), 2]
    plan = token_store.lookup(spark, path, [3, 77])._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*doc_id", plan)


def check_packing(docs, got):
    by_doc, by_seq = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.SIZE
    want = []
    for d, t in docs:
        ids = [*whole(t), 0]
        want += [key((d, k, s, n, crc(ids[s : s + n]))) for k, (s, n) in enumerate(packing.cuts(len(ids), packing.SIZE))]
    assert sorted(want) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    return len(by_seq), -(-sum(r.length for r in got) // packing.SIZE)


def test_packing(spark, odd, none):
    check_packing(ODD, packing.pack(odd).collect())
    assert packing.pack(none).count() == 0
    docs = registry.documents(spark, SF001)
    used, least = check_packing([tuple(r) for r in docs.collect()], packing.pack(docs).collect())
    assert used <= least * 1.03 + 1


def test_plan_uses_each_length_once():
    import random
    from collections import Counter

    rnd = random.Random(5)
    for n in (1, 10, 500, 20000):
        counts = Counter(min(2048, int(rnd.expovariate(1 / 400)) + 1) for _ in range(n))
        plan = packing.plan(counts)
        used = Counter()
        for lengths, t in plan:
            assert sum(lengths) <= 2048 and t > 0
            for x in lengths:
                used[x] += t
        assert used == counts
        least = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert sum(t for _, t in plan) <= least * 1.01 + 2
