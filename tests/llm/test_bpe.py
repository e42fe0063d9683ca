import random

import numpy as np
import pytest

from factweave.llm import bpe

from .helpers import corpus, frame

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))


def ids(b):
    return list(memoryview(b).cast("I"))


ODD = ["", "'s don't I'LL", "<|endoftext|>a<|startoftext|> <|x", "ΑΣ ΣΑΣ", "İstanbul ẞ ǅ", "½²Ⅷ٣x5 a_b __", "日本語🙂🙂", "\x1c\x1d a\x85b　c", "!!!???...###", "a" * 2000, "ab" * 700 + "c"]


def test_same_as_the_library(both):
    lib, enc = both
    rng = random.Random(3)
    texts = ODD + [t or "" for _, t in corpus()] + ["".join(rng.choice("aaabcdeinth'é ñß.!1") for _ in range(rng.randint(1, 500))) for _ in range(150)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = ids(enc.encode(t))
        assert got == want
        d = bpe.Decoder(enc.v)
        assert d.feed(got[:3]) + d.feed(got[3:]) + d.close() == lib.decode(want, skip_special_tokens=False)


def test_words_in_pieces_and_in_constant_memory(both):
    _, enc = both
    word = "".join(random.Random(1).choice("thandedble") for _ in range(20_000))
    t = bpe.Transducer(enc.v)
    out, most = [], 0
    for i in range(0, len(word) - 1, 7):
        out += t.feed(word[i : min(i + 7, len(word) - 1)])
        most = max(most, len(t.text))
    out += t.close(word[-1])
    assert most < 4 * t.hold
    assert out == ids(enc.word(word))


def test_lockstep_makes_the_transducers_steps(both):
    _, enc = both
    rng = random.Random(9)
    words = ["".join(rng.choice(["th", "e", "ing", "an", "é", "st", "'", "日", "a", "b", "aa", "!", "7"]) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    words += ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 30)]
    words = [w.encode() for w in words]
    assert enc.lockstep.encode(words) == [enc.word(w.decode()) for w in words]
    v = enc.v
    some = [i for i in rng.sample(sorted(v.tokens), 1500) if i not in v.special.values()]
    assert [bool(enc.lockstep.whole[i]) for i in some] == [v.follows(-1, i) for i in some]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(2000)]
    pairs = [(a, b) for a, b in pairs if not v.tokens[a].endswith(bpe.END)]
    got = enc.lockstep.follows(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [v.follows(a, b) for a, b in pairs]


def test_tables_stay_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 50)
    monkeypatch.setattr(bpe, "_PAIRS", 64)
    enc = bpe.Encoder(both[1].v)
    for t in [t or "" for _, t in corpus()] + ["x" * 300 + " y"]:
        assert ids(enc.encode(t)) == both[0].encode(t, add_special_tokens=False).ids
    assert len(enc.words) + len(enc.older) < 400 and enc.lockstep.known.size <= 64


def test_bytes_come_back(both):
    _, enc = both
    d = bpe.Decoder(enc.v, "bytes")
    assert d.feed(ids(enc.encode("naïve café 日本"))) + d.close() == "naïve café 日本 "


def test_operator(spark, both):
    lib, _ = both
    rows = corpus()
    got = {r.doc_id: (ids(bytes(r.ids)), r.decoded) for r in bpe.encode_decode(frame(spark, rows), bpe.default_path()).collect()}
    for doc, text in rows:
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert got[doc] == (want, lib.decode(want, skip_special_tokens=False))
    assert bpe.encode_decode(frame(spark, []), bpe.default_path()).count() == 0
