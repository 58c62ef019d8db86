import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe, packing, token_files, tokens


def _expected(library, docs):
    return sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda x: (x[0] is not None, x))


def test_pieces_are_binary_digits():
    assert packing.piece_lengths(13) == [8, 4, 1]
    assert packing.piece_lengths(4096 * 2 + 1) == [4096, 4096, 1]
    assert all(sum(packing.piece_lengths(n)) == n for n in range(1, 9000, 37))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZéß'.,!0 9\n\t́ \x1c日ǅ", max_size=40), min_size=1, max_size=5))
def test_chunks_give_the_ids_of_whole_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    got = list(tokens.word_ids(file).encode_batch(pa.array(texts)))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    own = tokens.word_ids(file)
    assert not own.by_chunk
    assert np.frombuffer(own.encode(pa.array(["a  b c"]))[0], "<u4").tolist() == Tokenizer.from_file(file).encode("a  b c", add_special_tokens=False).ids


def test_special_strings_get_the_ids_of_the_plain_call(library, tokenizer):
    texts = ["<|endoftext|>", "a<|endoftext|>b c", "x <|startoftext|> <|EndOfText|> y", "plain"]
    got = [np.frombuffer(g, "<u4").tolist() for g in tokens.word_ids(tokenizer).encode_batch(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [49407]


def test_the_precondition_is_read_from_the_definition(library):
    import json

    own = json.loads(library.to_str())
    assert tokens.chunks_are_independent(own)
    spaced = json.loads(library.to_str())
    spaced["added_tokens"][0]["content"] = "two words"
    assert not tokens.chunks_are_independent(spaced)
    spaced["added_tokens"][0] |= {"content": "one", "lstrip": True}
    assert not tokens.chunks_are_independent(spaced)


def test_a_tokenizer_that_keeps_case(library, tmp_path):
    import json

    from tokenizers import Tokenizer

    own = json.loads(library.to_str())
    own["normalizer"]["normalizers"] = [s for s in own["normalizer"]["normalizers"] if s["type"] != "Lowercase"]
    (tmp_path / "t.json").write_text(json.dumps(own))
    whole = Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["Hello WORLD <|endoftext|> <|ENDOFTEXT|>", "hello world"]
    got = [np.frombuffer(g, "<u4").tolist() for g in tokens.word_ids(str(tmp_path / "t.json")).encode_batch(pa.array(texts))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts] and got[0] != got[1]


def test_packing_covers_every_id_once(odd_docs, tokenizer, library):
    rows = packing.pack(odd_docs, tokenizer).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["length"] == 1 << r["bucket"] and r["length"] <= 4096 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in rows)
    by_bucket = sorted((r["sequence_id"], -r["bucket"]) for r in rows)
    assert [b for _, b in by_bucket] == sorted(b for _, b in by_bucket)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["start"]), []).append((r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()))
    for doc, ids in _expected(library, odd_docs):
        got, at = [], 0
        while at < len(ids):
            n, own = pieces[doc, at][0]
            assert n == len(ids)
            got, at = got + own, at + len(own)
        assert got == ids
    assert sum(r["length"] for r in rows) == sum(len(i) for _, i in _expected(library, odd_docs))


def test_packing_nothing(no_docs, tokenizer):
    assert packing.pack(no_docs, tokenizer).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, tokenizer, longest=100)


def test_token_files_keep_order_and_ids(odd_docs, tokenizer, library):
    rows = sorted(token_files.token_files(odd_docs, tokenizer, files=3).collect(), key=lambda r: r["start"])
    expected, at = _expected(library, odd_docs), 0
    assert [r["doc_id"] for r in rows] == [d for d, _ in expected]
    for r, (_, ids) in zip(rows, expected):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sorted(zlib.crc32(r["ids"]) for r in rows) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in expected)


def test_files_follow_the_size_of_the_input(spark, odd_docs, tokenizer, monkeypatch):
    from tessera.llm import common

    assert 100_000 < common.planned_bytes(odd_docs, "text") < 10 << 20
    monkeypatch.setattr(token_files, "FILE_BYTES", common.planned_bytes(odd_docs, "text") // 6)
    manifest = token_files.write_token_files(odd_docs, tokenizer, common.work_folder(spark, "sized"))
    assert 4 < manifest.count() <= 7


def test_no_token_files(no_docs, tokenizer):
    assert token_files.token_files(no_docs, tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from([0.0, 50.0, 95.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    block = token_files.encode_block(np.array(ids, np.uint32), percentile)
    back, end = token_files.decode_block(b"xx" + block, 2)
    assert back.tolist() == ids and end == len(block) + 2


def test_outliers_are_exceptions():
    ids = np.full(4096, 7, np.uint32)
    ids[::100] = 4_000_000_000
    assert len(token_files.encode_block(ids)) < 4096 // 8 + 41 * 8 + 100


def test_any_range_of_a_file(tmp_path):
    from pyarrow import fs

    system, draw = fs.LocalFileSystem(), np.random.default_rng(1)
    docs = [draw.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 9000, 1, 4096)]
    out = token_files.Writer(system.open_output_stream(str(tmp_path / "f")))
    for k, d in enumerate(docs):
        out.add(k or None, d.tobytes())
    out.close()
    reader, whole = token_files.Reader(system.open_input_file(str(tmp_path / "f"))), np.concatenate(docs)
    for first, n in ((0, 1), (4095, 2), (5000, 4000), (0, len(whole)), (3, 0)):
        assert reader.ids(first, n).tolist() == whole[first : first + n].tolist()
    for run in (1, 100_000):
        assert [(d, i.tolist()) for d, _, i in reader.documents(run)] == [(k or None, d.tolist()) for k, d in enumerate(docs)]


@pytest.fixture(scope="module")
def bpe():
    import base64

    import public_tokenizers
    import tiktoken

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return file, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_hash_is_minimal_and_perfect():
    keys = [b"%d" % i for i in range(5000)]
    own = byte_bpe.PerfectHash(keys)
    assert sorted(own.numbers(keys).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_merges_agree_with_the_library(bpe):
    file, pattern, library = bpe
    own = byte_bpe.byte_bpe(file, pattern)

    @settings(max_examples=80, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet="ab e'st \n", max_size=80))
    def run(text):
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert own.decode(own.encode([text])[0]) == text.encode()

    run()
    assert np.frombuffer(own.encode(["ab" * 3000])[0], "<u4").tolist() == library.encode_ordinary("ab" * 3000)


def test_bpe_columns(odd_docs, no_docs, bpe):
    file, pattern, library = bpe
    key = lambda x: (x[0] is not None, x)
    rows = byte_bpe.decode(byte_bpe.encode(odd_docs, file, pattern), file, pattern).collect()
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"].decode()) for r in rows), key=key)
    assert got == sorted(((r["doc_id"], library.encode_ordinary(r["text"] or ""), r["text"] or "") for r in odd_docs.collect()), key=key)
    assert byte_bpe.encode(no_docs, file, pattern).count() == 0
