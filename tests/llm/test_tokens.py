import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import tokens


@pytest.fixture(scope="module")
def both():
    path = tokens.tokenizer_path()
    return tokens.WordEncoder(path), Tokenizer.from_file(path)


def test_equals_the_library(both):
    enc, plain = both
    rng = random.Random(1)
    alphabet = "abcXYZéÉßñÀ .,\n\t'ś \x1c\x85İΣσς123#*<|>日本'-_×÷" + "<|endoftext|>"
    texts = ["", None, "   ", "Hello, world.\n", "<|endoftext|> a<|startoftext|>b", "a.b, c.. d,", "é é É", "ΑΣ ΣΑΣ İ", "it's don't"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = list(enc.encode(texts))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in got] == want


def test_long_text_and_small_cache(both, monkeypatch):
    enc, plain = both
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    text = " ".join(words)
    monkeypatch.setattr(tokens, "CHUNK", 100)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    got = list(enc.encode([text, "ab", text]))
    want = np.array(plain.encode(text, add_special_tokens=False).ids)
    assert (got[0] == want).all() and (got[2] == want).all() and got[1].tolist() == plain.encode("ab", add_special_tokens=False).ids


def test_every_file_gives_the_librarys_ids():
    """Files whose blanks matter aren't cached by word."""
    import glob
    import os

    paths = glob.glob(os.path.join(os.path.dirname(tokens.tokenizer_path()), "*.json"))
    assert len(paths) >= 2
    rng = random.Random(7)
    texts = ["", None, " Hello,  World\n\n x", "ÄÖ é É", "<|endoftext|> a", "日本 12 3"] + ["".join(rng.choice("abZ É.,\n  '12") for _ in range(50)) for _ in range(60)]
    cached = {}
    for path in paths:
        enc, plain = tokens.WordEncoder(path), Tokenizer.from_file(path)
        cached[os.path.basename(path)] = enc.cached
        assert [i.tolist() for i in enc.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert cached["word_bpe_49k.json"] and not cached["byte_bpe_50k.json"]


def test_other_settings_are_left_to_the_library(tmp_path):
    import json

    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        settings = json.load(f)
    settings["normalizer"]["normalizers"].append({"type": "StripAccents"})
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f)
    enc, plain = tokens.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.cached and [i.tolist() for i in enc.encode(["é è x"])] == [plain.encode("é è x", add_special_tokens=False).ids]


def test_frequent_words_stay_in_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CHUNK", 100)
    enc, plain = tokens.WordEncoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    letters = "abcdefghij"
    rare = ["".join(letters[int(d)] for d in str(1000 + i)) for i in range(400)]
    learnt, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (learnt.extend(words), learn(words)))
    texts = [f"often {w}, Often." for w in rare]
    got = [i.tolist() for i in enc.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt.count("often") == learnt.count("Often.") == 1 and len(enc.place) < 100
