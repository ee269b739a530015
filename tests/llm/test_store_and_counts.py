import zlib

import numpy as np
import pytest
from helpers import ROWS, clashing, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import token_attribution, token_store

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def whole():
    return tokenizers.Tokenizer.from_file(token_store.default_tokenizer())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"abzAZ éßñİΣǅ½١ .,'!|<>\n\t\x1c\x85_-12☃漢", "\u0301", "don't", "<|endoftext|>", "ing "]), max_size=60))
def test_chunks_encode_as_whole_texts(parts):
    text = "".join(parts)
    enc = token_store.encoder(token_store.default_tokenizer())
    assert enc.encode(text).tolist() == whole_tokenizer().encode(text, add_special_tokens=False).ids


def whole_tokenizer(held=[]):
    if not held:
        held.append(whole())
    return held[0]


@pytest.mark.parametrize("kind", [token_store.BYTE_PLANES, token_store.BIT_PLANES])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_and_segments_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    payload = token_store.write_segment([3, 9], [n - n // 2, n // 2], ids, kind, block=64)
    s = token_store.Segment(payload)
    assert (s.read() == ids).all() and s.lengths.tolist() == [n - n // 2, n // 2]
    for first, count in ((0, 5), (60, 10), (n, 3), (n // 2, n)):
        assert (s.read(first, count) == ids[first : first + count]).all()


@pytest.mark.parametrize("planes", [token_store.BYTE_PLANES, token_store.BIT_PLANES])
def test_store_against_brute_force(spark, planes):
    store = token_store.write(clashing(documents(spark)), planes=planes, block=50, segment_ids=300, rows_per_shard=3)
    got = {}
    for r in token_store.documents_of(store).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at, expected = 0, {}
    for doc, text in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*whole_tokenizer().encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.setdefault(doc, []).append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_empty_store(spark):
    assert token_store.documents_of(token_store.write(documents(spark, []))).count() == 0


def test_attribution_against_offsets(spark):
    pytest.importorskip("tiktoken")
    got = token_attribution.count(clashing(documents(spark)))
    enc = token_attribution.encoder(token_attribution.default_tokenizer())
    expected = []
    for doc, text, lang, source in ROWS:
        record, parts = token_attribution.sections([source or "", lang or ""], text or "")
        pieces = [enc.encoding.decode_single_token_bytes(i) for i in enc.encoding.encode_ordinary(record)]
        owner = [i for i, p in enumerate(parts) for _ in p.encode()]
        counts, at = [0] * len(parts), 0
        for p in pieces:
            held = owner[at : at + len(p)]
            counts[max(sorted(set(held)), key=held.count)] += 1
            at += len(p)
        chars = 0
        for i, p in enumerate(parts):
            expected.append((doc, i, chars, chars + len(p), counts[i]))
            chars += len(p)
    assert rows(got, "doc_id", "section", "start", "end", "n_tokens") == sorted(expected, key=str)
    assert token_attribution.count(documents(spark, [])).count() == 0


def test_crossing_tokens_go_to_most_bytes_then_first():
    assert token_attribution.owners(np.array([3, 7, 9]), np.array([2, 5, 9])).tolist() == [0, 1, 2]
    assert token_attribution.owners(np.array([4]), np.array([2, 2, 4])).tolist() == [0]
