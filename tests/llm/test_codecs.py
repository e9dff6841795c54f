"""Token counts, piece codec: against the libraries on whole texts."""

import random

import public_tokenizers
import pytest
from tests.llm.conftest import ODD

from millrace.llm import piece_codec, token_counts
from millrace.llm.queries import op10_digest

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "日本", "'s", "12", "<|endoftext|>", "!!", "x" * 50, "\x1c", " ", "\u0085", "▁", "\x00", "<s>", "</s>", "<0x0A>"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randrange(250))) for _ in range(n)] + [x or "" for x in ODD] + ["日" * 300, " " * 300, "ab " * 100 + "z" * 300 + " q" * 100]


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 2), (40, 8), (100, 30), (token_counts.CHUNK, token_counts.OVERLAP)])
def test_spliced_counts(chunk, overlap):
    counter = token_counts.TokenCounter(BPE, chunk, overlap)
    texts = random_texts(400, chunk)
    want = [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert counter.by_word(texts) == want


@pytest.mark.parametrize("change", ["lstrip", "prefix", "lower", None])
def test_files_without_the_usual_pattern_are_encoded_whole(tmp_path, change):
    import json

    spec = json.load(open(BPE, encoding="utf-8"))
    if change == "lstrip":
        spec["added_tokens"][0]["lstrip"] = True
    elif change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "lower":
        spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    counter = token_counts.TokenCounter(str(tmp_path / "t.json"), 40, 8)
    assert counter.whole == (change is not None)
    texts = random_texts(100, 6) + ["A B  C <|endoftext|> d"]
    assert counter.count(texts) == [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_huge_text():
    rnd = random.Random(1)
    text = "".join(rnd.choices(["the ", "cat", " sat", "\n", "mat. ", "dog's "], k=300_000))
    counter = token_counts.TokenCounter(BPE)
    assert counter.count([text])[0] == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_count_query(spark, docs_of, nothing):
    got = token_counts.count_tokens(docs_of(ODD + ODD), BPE)
    assert "text" not in got.columns and got.columns[-1] == "n_tokens"
    counter = token_counts.TokenCounter(BPE)
    want = [len(counter.tokenizer.encode(t or "", add_special_tokens=False)) for t in ODD] * 2
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == want
    assert token_counts.count_tokens(nothing, BPE).count() == 0


def test_codec_equals_the_library():
    codec = piece_codec.ChunkTable(PIECES)
    texts = random_texts(600, 3)
    for text, (ids, decoded) in zip(texts, codec.code(texts), strict=True):
        import numpy as np

        want = codec.model.encode(text, add_eos=True)
        assert np.frombuffer(ids, np.int32).tolist() == want
        assert decoded == codec.model.decode(want)


def test_a_normaliser_is_refused(monkeypatch):
    monkeypatch.setattr(piece_codec, "PROBES", ["a" + piece_codec.MARK + "b", "x"])
    piece_codec.ChunkTable(PIECES)

    class Lower:
        def __init__(self, model_file):
            pass

        get_piece_size = staticmethod(lambda: 0)
        id_to_piece = staticmethod(str)
        normalize = staticmethod(lambda x: piece_codec.MARK + x.lower())

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Lower)
    monkeypatch.setattr(piece_codec, "PROBES", ["A"])
    with pytest.raises(ValueError, match="normaliser"):
        piece_codec.ChunkTable(PIECES)


def test_full_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_ENTRIES", 5)
    codec = piece_codec.ChunkTable(PIECES)
    for text in random_texts(50, 4):
        import numpy as np

        assert np.frombuffer(codec.code([text])[0][0], np.int32).tolist() == codec.model.encode(text, add_eos=True)
    assert len(codec.table) < 300


def test_codec_query(spark, docs_of, nothing):
    import hashlib

    got = op10_digest(piece_codec.encode_decode(docs_of(ODD), PIECES)).orderBy("doc_id").collect()
    model = piece_codec.ChunkTable(PIECES).model
    for r, t in zip(got, ODD, strict=True):
        ids = model.encode(t or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_decode(nothing, PIECES).count() == 0
    assert piece_codec.encode_decode(docs_of(["a b"]), PIECES).columns[:2] == ["doc_id", "lang"]
