"""BPE encoding and decoding as the tokenizers library does, with tree concatenation for long unsplit text.

Tokens never cross white space, so a text's tokens are those of its words in order, and a word met before comes from a bounded
memory. A word of over LONG characters is not encoded as one: it is split as the tokenizer splits, and a part that
the tokenizer leaves unsplit is cut in halves again and again down to leaves, which Spark encodes as rows in parallel.
Going up the tree, two neighbours are joined by encoding a window of the tokens on both sides again; the window doubles
until its first and last token are those that were there. Then every adjacent pair of tokens is one that encoding its own
text gives, which only the encoding of the whole has; if that never happens, the window ends as the whole.

Defined results: null counts as empty; empty and blank texts have no tokens and decode to the empty string; strings of
special tokens in a text become those tokens; repeated rows are encoded each; other columns are kept out.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.models import BPE

from palate.llm.common import bound_batches, shuffle_width
from palate.session import stage

LONG = 2048
LEAF = 512
WINDOW = 4
#: Words that a worker remembers. Each of a task's workers comes to hold a memory, as they change places between encoding and decoding.
MEMORY = 250_000
#: Characters that are cut into words at a time.
TAKEN = 1 << 20
# White space as the tokenizer's normaliser takes it.
_BLANK = r"\t-\r \u0085   -     　"
_WORDS = regex.compile(f"[^{_BLANK}]+")


# Letters that no normalisation but lower case changes, then marks without an apostrophe.
_PLAIN = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|()-]*)")
# A byte's character in a byte-level vocabulary: itself where it prints, else the next free one from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTS} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in _PRINTS)}


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Coder:
    """The tokenizer of one file; one per worker process."""

    _made: dict[str, Coder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.closed = self.tokenizer.model
        self.path = path
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        # Ids as packed 32-bit integers: a tuple of integers takes three times the memory.
        self.memory: dict[str, bytes] = {}
        self.roots: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.names = np.array([self.tokenizer.id_to_token(i) for i in range(size)], object)

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @cached_property
    def open(self) -> BPE:
        """The same merges without word ends, for text that goes on."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def words(self, words: set[str]) -> None:
        """Put words into the memory. Letters with or without closing marks are two parts to the tokenizer: the letters,
        in lower case, and the marks. All other words are encoded by it, together."""
        if len(self.memory) + len(words) > MEMORY:
            self.memory.clear()
            self.roots.clear()
        memory, roots, odd = self.memory, self.roots, []
        for word in words:
            if word in memory:
                continue
            plain = _PLAIN.fullmatch(word)
            if not plain:
                odd.append(word)
                continue
            out = b""
            for part in (plain[1].lower(), plain[2]):
                if part and part not in roots:
                    raw = part if part.isascii() else "".join([_BYTE[b] for b in part.encode()])
                    roots[part] = _pack([t.id for t in self.closed.tokenize(raw)])
                out += roots[part] if part else b""
            memory[word] = out
        if odd:
            for word, code in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                memory[word] = _pack(code.ids)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = size = 0
        for to, text in enumerate(texts, 1):
            size += len(text)
            if size < TAKEN and to < len(texts):
                continue
            cut = [split(t) for t in texts[at:to]]
            self.words(set(chain.from_iterable(cut)))
            known = self.memory.__getitem__
            out += [np.frombuffer(b"".join(map(known, words)), np.int32) for words in cut]
            at, size = to, 0
        return out

    def parts(self, word: str) -> list[str | int]:
        """A long word as the tokenizer splits it: byte strings and ids of special tokens."""
        cut = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", word) if self.special else [word]
        out: list[str | int] = []
        for piece in cut:
            if piece in self.special:
                out.append(self.tokenizer.token_to_id(piece))
            elif piece:
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]
        return out

    def piece(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.closed if last else self.open).tokenize(text)]

    def spelled(self, ids: list[int], last: bool) -> str:
        text = "".join(self.names[ids])
        return text.removesuffix("</w>") if last else text

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The tokens of two neighbours' text; ``last``: the right one ends the word."""
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            to_end = len(b) == len(right)
            window = self.piece(self.spelled(a, False) + self.spelled(b, last and to_end), last and to_end)
            if (len(a) == len(left) or window[0] == a[0]) and (to_end or window[-1] == b[-1]):
                return left[: -len(a)] + window + right[len(b) :]
            size *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Join neighbours, level by level."""
        level, ends = leaves, [False] * (len(leaves) - 1) + [True]
        while len(level) > 1:
            pairs = range(0, len(level) - 1, 2)
            joined = [self.join(level[i], level[i + 1], ends[i + 1]) for i in pairs]
            flags = [ends[i + 1] for i in pairs]
            if len(level) % 2:
                joined.append(level[-1])
                flags.append(ends[-1])
            level, ends = joined, flags
        return level[0]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def split(text: str) -> list[str]:
    # str.split() also splits at four control characters, which are no white space to the tokenizer.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _WORDS.findall(text)
    return text.split()


def halves(text: str) -> list[str]:
    """Leaves of at most LEAF characters, by halving."""
    if len(text) <= LEAF:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle]) + halves(text[middle:])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = Coder.of(path)
            ids = coder.texts(batch.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])

    return run


_CUT = "row bigint, id bigint, word int, part int, leaf int, last boolean, text string, ids array<int>"


def _cut(path: str):
    """Texts with long words as rows: stretches of short words, special tokens, leaves."""

    def pieces(coder: Coder, text: str):
        short: list[str] = []
        n = size = 0
        for word in split(text):
            if len(word) <= LONG:
                short.append(word)
                size += len(word)
                if size < 1 << 16:
                    continue
                yield n, 0, None, None, " ".join(short), None
                short, size, n = [], 0, n + 1
                continue
            if short:
                yield n, 0, None, None, " ".join(short), None
                short, size, n = [], 0, n + 1
            for k, part in enumerate(coder.parts(word)):
                if isinstance(part, int):
                    yield n, k, None, None, None, [part]
                    continue
                leaves = halves(part)
                for i, leaf in enumerate(leaves):
                    yield n, k, i, i == len(leaves) - 1, leaf, None
            n += 1
        if short or not n:
            yield n, 0, None, None, " ".join(short), None

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in _CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = Coder.of(path)
            rows: list[tuple] = []
            for row, key, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
                for piece in pieces(coder, text):
                    rows.append((row, key, *piece))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = Coder.of(path)
            out = []
            for leaf, last, text, ids in zip(*(batch.column(c).to_pylist() for c in ("leaf", "last", "text", "ids"))):
                out.append(ids if text is None else coder.texts([text])[0] if leaf is None else coder.piece(text, last))
            at = batch.schema.names.index("text")
            columns = [batch.column(i) for i in range(at)] + [pa.nulls(len(out), pa.string()), pa.array(out, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _grow(path: str):
    def run(table: pa.Table) -> pa.Table:
        coder = Coder.of(path)
        rows = sorted(table.select(["word", "part", "leaf", "ids"]).to_pylist(), key=lambda r: (r["word"], r["part"], r["leaf"] or 0))
        ids: list[int] = []
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and (rows[to]["word"], rows[to]["part"]) == (rows[at]["word"], rows[at]["part"]):
                to += 1
            ids += coder.tree([r["ids"] for r in rows[at:to]]) if to - at > 1 else rows[at]["ids"]
            at = to
        return pa.table({"id": table.column("id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and token ids."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Texts with a stretch of over LONG characters between spaces, so all with such a word.
    long = (F.length("text") > LONG) & F.exists(F.split("text", " "), lambda w: F.length(w) > LONG)
    plain = texts.where(~long).mapInArrow(_encode(path), "id bigint, ids array<int>")
    rows = stage(texts.where(long).withColumn("row", F.monotonically_increasing_id()), "long")
    cut = rows.mapInArrow(_cut(path), _CUT).repartition(shuffle_width(docs.sparkSession), "row", "word", "part", "leaf")
    grown = cut.mapInArrow(_encode_pieces(path), _CUT).groupBy("row").applyInArrow(_grow(path), "id bigint, ids array<int>")
    return plain.unionByName(grown).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` with the decoded text."""
    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = Coder.of(path).names
            lists = batch.column(ids_col)
            flat = names[lists.flatten().to_numpy(zero_copy_only=False)]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            text = [" ".join(flat[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: id, n_tokens and the digests of ids and of decoded text."""
    both = decode(encode(docs, path), path)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
