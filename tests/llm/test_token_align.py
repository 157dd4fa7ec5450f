import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from palate.llm import token_align as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, id string, groups int, block int"


def plain(rows):
    """All links and groups of every text by sets of bytes."""
    a_model, b_model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = T.byte_letters()
    out, total = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(letters[c] for c in a_model.id_to_token(t)) for t in a]
            pieces = [b_model.id_to_piece(t) for t in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(t) else p.replace("▁", " ").encode() for t, p in zip(b, pieces)]
            if b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode():
                a = b = []
        links, groups = [], []
        if a:
            owner = [[k for k, x in enumerate(side) for _ in x] for side in (a_bytes, b_bytes)]
            links = [(a[x], b[y]) for x, y in sorted(set(zip(*owner)))]
            ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
            start = 0
            for end in sorted(ends[0] & ends[1]):
                groups.append(tuple(",".join(str(ids[k]) for k in sorted(set(own[start:end]))) for ids, own in zip((a, b), owner)))
                start = end
        total.update(links)
        out.append((i, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda groups: hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else ""
    return [
        (i, na, nb, len(g), len(k), sum(total[p] == best[p[1]] for p in k), sum(total[p] for p in k), digest(g)) for i, na, nb, g, k in out
    ]


def found(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=str)


TEXTS = [
    None, "", " ", "The quick brown fox.", "The quick brown fox.", "  two  spaces\n\n\ttabs ", "naïve café 你好世界 🙂🙂", "▁ is not kept",
    "<|endoftext|> and <s> are text", "a" * 3000, "x1" * 700 + " " * 2500 + "_" * 1500, "Straße " * 900, "don't we'll 12345678", "\x00\x01​",
]


@pytest.mark.parametrize("block", [1, 1 << 30])
def test_against_sets_of_bytes(spark, monkeypatch, block):
    rows = [(k // 2 if k % 5 else None, t, "x", 1, 2) for k, t in enumerate(TEXTS)]
    fast = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    aligner = T._aligner

    def small(*args):
        run = aligner(*args)

        def inside(batches):
            T.BLOCK_BYTES = T.STEP_BYTES = block
            return run(batches)

        return inside

    monkeypatch.setattr(T, "_aligner", small)
    assert found(T.report(fast, A, B)) == sorted(plain([r[:2] for r in rows]), key=str)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(T.report(docs, A, B)) == sorted(plain([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_groups_are_kept_as_text(spark):
    got = T.token_align(spark.createDataFrame([(7, "ab")], "doc_id int, text string"), A, B).first()
    assert "|" in got.groups and got.doc_id == 7 and got.n_groups == got.groups.count("|")


def test_empty(spark):
    assert T.report(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_fast_encoding_equals_the_library():
    side = T.ByteLevel(A)
    texts = [t for t in TEXTS if t] + ["'s 'S ’s    x", "\r\n \r\n", "é" * 1200, "ab" * 200]
    assert side.encode(texts) == [side.exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_chains_converge():
    # B tokens shifted by one against A tokens: one group over the whole line.
    a_end = np.append(np.arange(2, 20_001, 2), 20_001)
    b_end = np.append(np.arange(1, 20_001, 2), 20_001)
    assert set(T.label_groups(a_end, b_end)) == {len(b_end) - 1}
