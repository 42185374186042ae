"""Word encoder: the tokenizer's own ids for every chunk, many of them encoded at a time."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyframe.llm import encoding
from surveyframe.llm.encoding import WordEncoder, word_chunks

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "don't 'tis x.'s <|endoftext|> a<|startoftext|>'s <|ENDOFTEXT|> </w> a</w> ÉÀ×ß ÿÞ İ Σας ΣΑΣ é ́e é́ a b     \u0085 \x1c \x00 １２ 日本語 가 ᅡ K 123 !!! <| |> 🙂🙂 Å"


class Counted:
    """A tokenizer that tells how many texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.fixture
def counted():
    e = WordEncoder(PATH)
    e.tokenizer = Counted(e.tokenizer)
    return e


def ids(e, text):
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end = word_chunks(buf, np.array([0, len(buf)]))
    rows = e.rows(buf, start, end)
    flat, cuts = e.flat(rows).tolist(), np.concatenate(([0], np.cumsum(e.counts(rows)))).tolist()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def alone(text):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in text.encode().split()]


def invented(n, seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéèüßnrstXÄ0.,'!-")
    return [f"{k}{''.join(rng.choice(letters, rng.integers(1, 12)))}" for k in range(n)]


def test_ids_are_those_of_each_chunk_alone(counted):
    words = invented(2_000, 1)
    text = " ".join(w + x for w, x in zip(words, [*(" " + o for o in ODD.split(" ")), *[""] * len(words)], strict=False)) + " " + "x" * 3_000
    assert ids(counted, text) == alone(text)
    assert ids(counted, text) == alone(text)  # remembered
    assert ids(counted, " \n") == []
    assert ids(counted, ODD) == alone(ODD)


def test_distinct_words_are_encoded_many_at_a_time(counted):
    text = " ".join(invented(5_000, 2))
    assert ids(counted, text) == alone(text)
    assert counted.tokenizer.texts < 500


def test_lengths_that_do_not_tell_leave_chunks_alone(counted):
    counted.length[:] = 3
    text = " ".join([*invented(300, 3), ODD])
    assert ids(counted, text) == alone(text)


def test_chunks_met_again_are_kept_when_others_are_forgotten(monkeypatch, counted):
    monkeypatch.setattr(encoding, "REMEMBERED", 3_000)
    often = " ".join(f"é{w}" for w in invented(1_000, 4))
    for k in range(8):
        text = " ".join([often, *invented(1_000, 10 + k)])
        assert ids(counted, text) == alone(text)
        assert len(counted.hash) == len(counted.met) <= 3_000
    met, before = [], counted._encoded
    counted._encoded = lambda chunks: met.extend(chunks) or before(chunks)
    for k in range(8):
        assert ids(counted, often) == alone(often)
        fresh = " ".join([often, *invented(1_000, 30 + k)])
        assert ids(counted, fresh) == alone(fresh)
    assert not set(met) & set(often.encode().split())
