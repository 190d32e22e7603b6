import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_samples import awkward_docs, awkward_texts
from tokenizers import Tokenizer

from flowbench.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_every_document_back_and_fill_sequences(spark):
    docs = awkward_docs(spark).repartition(3)
    pieces = packing.pack(docs, VOCABULARY, block_tokens=20_000).toPandas()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    expected = defaultdict(list)
    for doc, text in awkward_texts():
        expected[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    assert len(pieces) and (pieces["length"] > 0).all()
    known = pieces[pieces.doc_id.notna()]
    for doc, parts in known.groupby("doc_id"):
        copies = sorted(map(tuple, expected[int(doc)]))
        total = sum(map(len, copies))
        assert parts["length"].sum() == total
        if len(copies) == 1:
            parts = parts.sort_values("start")
            ids = np.concatenate([np.frombuffer(b, "<u4") for b in parts.ids])
            assert ids.tolist() == list(copies[0]) and parts.doc_tokens.eq(total).all()
            assert (parts.start.to_numpy() == np.cumsum([0, *parts["length"][:-1]])).all()
    assert all(zlib.crc32(b) == c for b, c in zip(pieces.ids, pieces.ids_crc32))
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert (sequence.offset.to_numpy() == np.cumsum([0, *sequence["length"][:-1]])).all()
        used = sequence["length"].sum()
        assert used <= 2048 and used & (used - 1) == 0  # nothing is padded


def test_descending_documents_go_to_the_cheapest_sequence():
    placed = packing.assign([5, 10, 8, 9], 16, 0.0)
    # 10 and 9 open the two sequences; 8 fits in neither, so the cheaper one takes 7 and the other 1; then 5
    assert [p[:4] for p in placed] == [(1, 0, 10, 0), (3, 0, 9, 1), (2, 0, 7, 1), (2, 7, 1, 0), (0, 0, 5, 0)]
    assert [p[4] for p in placed] == [0, 0, 9, 10, 11]


def test_cached_pieces_equal_whole_texts():
    encoder = packing.PieceEncoder(VOCABULARY)
    rng = np.random.default_rng(0)
    usual = [chr(c) for c in range(1, 0x300)] + list("  \n\n's'll 12")
    texts = ["".join(rng.choice(usual, 40)) for _ in range(400)] + ["<|endoftext|> x", "it's  we'll\n\n 'S", "日本語 ½ ²"]
    for text in texts:
        assert np.array_equal(encoder.encode(text), encoder.whole(text))


def test_pieces_are_written_as_the_vocabulary_does_and_kept_without_slack(monkeypatch):
    encoder = packing.PieceEncoder(VOCABULARY)
    pieces = [chr(c) for c in range(0x250)] + [" a", " é", "  ", " \n", "'s", " 12", "\x7f~", "word" * 50]
    for piece in pieces:
        assert encoder.written(piece) == piece.encode().decode("latin-1").translate(packing.byte_letters())
    monkeypatch.setattr(packing, "KNOWN_PIECES", 40)
    texts = [" ".join(f"w{i}x{k}" for k in range(6)) + " the end\n" for i in range(30)] + ["a b " * 30, ""]
    for text in texts:
        assert np.array_equal(encoder.encode(text), encoder.whole(text)) and len(encoder) <= 40
        assert len(encoder.ends) == len(encoder) + 1 and len(encoder.flat) == encoder.ends[-1]


def test_pieces_of_the_last_texts_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_PIECES", 40)
    encoder = packing.PieceEncoder(VOCABULARY)
    assert not len(encoder.encode("")) and not len(encoder)
    merge, merged = encoder.merge, []
    monkeypatch.setattr(encoder, "merge", lambda piece: merged.append(piece) or merge(piece))
    for i in range(60):
        text = f"the end{chr(97 + i % 26) * (1 + i // 26)} of the word {i}"
        assert np.array_equal(encoder.encode(text), encoder.whole(text)) and len(encoder) <= 40
    assert len(merged) > 120 and merged.count(encoder.written(" word")) == 1
    full = " ".join("a" * k for k in range(1, 41))  # as many pieces as there is room for
    assert np.array_equal(encoder.encode(full), encoder.whole(full)) and len(encoder) == 40
    assert len(encoder.ends) == len(encoder) + 1 and len(encoder.flat) == encoder.ends[-1]


def test_letters_are_those_of_unicode():
    for char in map(chr, range(0x250)):
        if not packing.UNUSUAL.search(char):
            assert bool(packing.re.fullmatch(packing.LETTERS, char)) == bool(packing.re.fullmatch(r"[^\W\d_]", char))


def test_added_tokens_are_those_of_the_file():
    encoder, tokenizer = packing.PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in ["<|endoftext|>", "a b<|endoftext|> c", "é <|endoftext|><|endoftext|>\n日本", "<|endoftext| >", "<|endoftext", "plain"]:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == expected
        assert expected.count(tokenizer.token_to_id("<|endoftext|>")) == text.count("<|endoftext|>")


def test_empty_table_and_bad_length(spark):
    assert packing.pack(awkward_docs(spark, []), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(awkward_docs(spark, []), VOCABULARY, seq_len=1000)
