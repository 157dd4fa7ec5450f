import random

import pytest

from palate.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder.of(PATH)


def test_join_is_exact(coder):
    rng = random.Random(5)
    for alphabet in ("a", "ab", "aeinrst", "theanding", "!.", "éèa"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 400)))
            raw = "".join(coder.parts(text)) if len(coder.parts(text)) == 1 else None
            if raw is None:
                continue
            cuts = sorted({0, len(raw), *(rng.randrange(len(raw)) for _ in range(6))})
            pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            leaves = [coder.piece(p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
            assert coder.tree(leaves) == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_like_the_library(spark, coder):
    rng = random.Random(7)
    odd = ["<|endoftext|>", "it's", "don'T", "İ", "J̌", "é", "é", "\x1c", "\x85", "　", "ΑΣ", "123", "...", "'", "'s", "𝄞", "한글", "ﬁ", " ", "\n", "ẞ", "a" * 50]
    texts = [None, "", "  \n", *("".join(rng.choice(odd) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(300))]
    long = "".join(rng.choice("abcdeé") for _ in range(30_000))
    texts += [long, "x " + long + " y" + "!" * 9000 + " <|endoftext|>" + "b" * 5000 + "<|startoftext|>" + "7" * 3000, "ab" * 40_000, "-'s" * 4000]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want, text and text[:80]
        assert got[i].decoded == coder.tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.report(df.where("false"), PATH).collect() == []


def test_split_like_the_normaliser(coder):
    for i in [*range(1, 0x3100), 0xFEFF, 0x180E, 0x200B]:
        if 0xD800 <= i < 0xE000:
            continue
        want = coder.tokenizer.normalizer.normalize_str("a" + chr(i) + "b").count(" ")
        assert len(bpe.split("a" + chr(i) + "b")) == 1 + want, hex(i)


def test_worker_memory_is_bounded(coder, monkeypatch):
    """Few words are remembered, as packed ids, a batch is cut in parts, and merges for long words are loaded when one comes."""
    monkeypatch.setattr(bpe, "MEMORY", 300)
    monkeypatch.setattr(bpe, "TAKEN", 500)
    own = bpe.Coder(PATH)
    assert "open" not in vars(own)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeé,. ") for _ in range(rng.randrange(0, 120))) for _ in range(400)] + ["", " "]
    got = []
    for text, ids in zip(texts, own.texts(texts), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        got.append(ids)
    assert len(own.memory) <= 300 and all(isinstance(code, bytes) for code in (own.memory | own.roots).values())
    assert own.texts([]) == [] and own.piece("ab", False) and "open" in vars(own)
