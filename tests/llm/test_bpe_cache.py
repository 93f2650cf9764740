import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafmill.llm import bpe


def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_a_full_cache_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20 * bpe.ENTRY_BYTES)
    made = []
    cache = bpe.Cache(lambda text: made.append(text) or text.encode())
    for i in range(200):
        assert cache[f"w{i}"] == f"w{i}".encode()
        assert cache["often"] == b"often"
    assert made.count("often") == 1
    assert len(cache) + len(cache.older) <= 20


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    tool = bpe.Codec(bpe_path())
    made, merged = [], tool.merged_ids
    monkeypatch.setattr(tool, "merged_ids", lambda text: made.append(text) or merged(text))
    tool.pieces.make = tool.merged_ids
    text = "Say quibblestone! quibblestone? quibblestone;quibblestone quibblestone"
    ids = tool.encode(text)
    assert tool.decode(ids) == text
    assert made.count(" quibblestone") == 1
    assert tool.pieces.most + tool.after_space.most <= bpe.CACHE_BYTES  # of both generations, 2 * CACHE_BYTES


def test_new_words_of_many_texts_are_encoded_together(monkeypatch):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("etaoinshrdlé") for _ in range(pick.randint(5, 14)))
    texts = [" ".join(word() + pick.choice(["", "", ",", "'s.", "\n"]) for _ in range(100)) for _ in range(60)]
    for name, value in {"PAIR_SLOTS": 64, "WORDS": 1500, "CHARS": 3000, "PAIRS": 50}.items():
        monkeypatch.setattr(bpe, name, value)
    tool = bpe.Codec(bpe_path())
    made, merged = [], tool.merged_ids
    monkeypatch.setattr(tool, "merged_ids", lambda text: made.append(text) or merged(text))
    tool.pieces.make = tool.merged_ids
    ids = tool.encode_all(texts)
    assert len(made) < 1500  # of 6000 words
    library = Tokenizer.from_file(bpe_path())
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_texts_together_are_encoded_as_alone(monkeypatch):
    for name, value in {"PAIR_SLOTS": 16, "WORDS": 40, "CHARS": 300, "FEW": 4, "LONG": 40, "CACHE_BYTES": 4000}.items():
        monkeypatch.setattr(bpe, name, value)
    tool, pick = bpe.Codec(bpe_path()), random.Random(4)
    odd = " \n\t\x85  ab'sc1é½😀_.,-T​"
    texts = ["", " ", "a" * 300, "x " * 100, " <|endoftext|> y<|endoftext|>", "日本語 " * 50]
    texts += ["".join(pick.choice(odd) for _ in range(pick.randint(1, 80))) for _ in range(3000)]
    library = Tokenizer.from_file(bpe_path())
    ids = tool.encode_all(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
