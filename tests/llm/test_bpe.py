import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    pick = random.Random(1)
    odd = ["", " ", "  a  b\n\n c ", "<|endoftext|>x <|endoftext|>", "a" * 5000, "don't I'll we've\t\t x", "日本語 𝒳😀😀", "½ ² ٣ 12345", " <|endoftext|> "]
    marks = " \n\t ab'sc1é½😀_.-T ​"
    odd += ["".join(pick.choice(marks) for _ in range(pick.randint(1, 60))) for _ in range(2000)]
    return odd + ["".join(pick.choice("etaoinshrdlucmfwyp ") for _ in range(pick.randint(1, 40))) for _ in range(4000)]


def test_ids_and_texts_are_the_library_s(library):
    tool = bpe.codec(PATH)
    all_texts = texts()
    for t, e in zip(all_texts, library.encode_batch(all_texts, add_special_tokens=False), strict=True):
        ids = tool.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert tool.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    tool = bpe.Codec(PATH)
    for t in texts()[:500]:
        assert np.frombuffer(tool.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_any_ids_decode_as_in_the_library(library):
    pick = random.Random(2)
    for _ in range(300):
        ids = [pick.randrange(50257) for _ in range(20)]
        assert bpe.codec(PATH).decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(odd_docs, library):
    frame, rows = odd_docs
    got = bpe.encode_decode(frame, PATH).collect()
    want = [(d, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for d, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, bytes(r.ids), r.decoded)) for r in got)
    assert bpe.encode_decode(frame.limit(0), PATH).count() == 0
