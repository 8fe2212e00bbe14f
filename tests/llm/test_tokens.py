"""Token counts, encoding and packing against the tokenizers library itself."""

import json
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from assayer.llm import bpe, byte_bpe, packing, pretokens, token_counts
from conftest_llm import documents
from tokenizers import Tokenizer

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", FILES)
def test_ids_match_the_library(name):
    rng, parts = random.Random(3), [" ", "  ", "\n", "\t", "\xa0", "a", "b'", "'s", "'re", "'l", "1", "é", "!", "<|endoftext|>", "\x1c", "\x85", "　", "́", "日", " x", "²", "Σ", "İ", "A", "'", "zz"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["", "'", "'r", "x" * 3000 + "ab" * 900]
    ids, n = pretokens.Encoder(public_tokenizers.path(name)).encode(texts)
    for text, found, count, wanted in zip(texts, ids, n, library(name).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == wanted.ids, repr(text)
        assert count == len(wanted.ids)


def test_long_and_short_words_merge_alike():
    merger = bpe.Merger(public_tokenizers.path(FILES[0]))
    word = b"internationalisation"
    flat, n = merger.merge([word, word * 9])
    assert flat[: n[0]].tolist() == merger._alone(word).tolist()
    assert flat[n[0] :].tolist() == merger._alone(word * 9).tolist()


@pytest.mark.parametrize("name", FILES)
def test_parts_of_long_texts(name, monkeypatch):
    """Texts without blanks, with newlines alone, with special strings: cut in parts, the ids stay."""
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 40)
    rng = random.Random(6)
    texts = ["\n".join(f"w{rng.randrange(999)}'s" for _ in range(300)), "".join(rng.choice(["ab", "7", "!", "'", "don't", "é", "_-"]) for _ in range(900)), "x <|endoftext|>y<|endoftext|>\n" * 40, "ΟΔΟΣ Σ <|startoftext|> ΑΣ" * 20, " \n" * 300 + "a"]
    for text, found, wanted in zip(texts, pretokens.Encoder(public_tokenizers.path(name)).encode(texts)[0], library(name).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == wanted.ids, text[:80]


def test_large_vocabularies_keep_their_ids(tmp_path):
    """Ids over 65,535, which 16 bits don't hold."""
    chars = bpe.byte_alphabet()
    vocab = {c: 70_000 + i for i, c in enumerate(chars)} | {"ab": 200_001, "abc": 131_072}
    spec = {"added_tokens": [{"content": "<|x|>", "id": 300_000, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}], "model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "ab c"], "end_of_word_suffix": None}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    ids, n = pretokens.Encoder(str(tmp_path / "t.json")).encode(["abcab<|x|>a"])
    assert np.frombuffer(ids[0], "<u4").tolist() == [131_072, 200_001, 300_000, 70_000 + chars.index("a")] and n.tolist() == [4]


def test_twenty_megabytes(spark):
    """A long text of lines and one without blanks, in one batch each: right counts, and memory within bounds."""
    lines, solid = "\n".join(f"w{i % 5003}" for i in range(3_300_000)), "ab7!" * 5_000_000
    encoder = pretokens.Encoder(public_tokenizers.path(FILES[0]))
    tracemalloc.start()
    counts = [int(encoder.encode([x], counts_only=True)[1][0]) for x in (lines, solid)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    piece = encoder.encode(["\n".join(f"w{i}" for i in range(5003)), "\n"], counts_only=True)[1]
    whole, rest = divmod(3_300_000, 5003)
    tail = encoder.encode(["\n".join(f"w{i}" for i in range(rest))], counts_only=True)[1][0]
    assert counts == [whole * (piece[0] + 1) + tail, 15_000_000]


def test_fourfold_chunks(spark):
    """Texts without white space have no stable boundary until one chunk holds them whole."""
    rows = [(1, "xy7" * 700), (2, "ab " * 900), (3, "q" * 999)]
    found = token_counts.count_tokens(documents(spark, rows), chunk=64, overlap=16).collect()
    tokens = library(FILES[1])
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(i, len(tokens.encode(t, add_special_tokens=False).ids)) for i, t in rows]


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_WORDS", 64)
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 300)
    encoder, texts = pretokens.Encoder(public_tokenizers.path(FILES[0])), [" ".join(f"w{i}x{i * 7}" for i in range(k, k + 50)) for k in range(20)]
    for text, ids in zip(texts, encoder.encode(texts)[0], strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library(FILES[0]).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1024), (400, 16)])
def test_counts(spark, corpus, chunk, overlap):
    found = token_counts.count_tokens(documents(spark, corpus), chunk=chunk, overlap=overlap).collect()
    tokens = library(FILES[1])
    wanted = sorted((i, len((t or "").encode()), len(tokens.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == wanted
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)


def test_round_trip(spark, corpus):
    tokens = library(FILES[0])
    found = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in byte_bpe.encode_decode(documents(spark, corpus)).collect())
    wanted = [(i, tokens.encode(t or "", add_special_tokens=False).ids) for i, t in corpus]
    assert found == sorted((i, len(x), np.array(x, "<u4").tobytes(), tokens.decode(x, skip_special_tokens=False)) for i, x in wanted)


def test_packing(spark, corpus):
    found, tokens = packing.pack(documents(spark, corpus), window=64).collect(), library(FILES[0])
    ids = {i: [*tokens.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    at = 0
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 64 + r.offset == at
        at += r.length
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.offset + r.length <= 64
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert at == sum(len(ids[i]) for i, _ in corpus)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert token_counts.count_tokens(empty).count() == byte_bpe.encode_decode(empty).count() == packing.pack(empty).count() == 0
