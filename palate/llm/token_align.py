"""Alignment of the tokens of two tokenizers over the same text, by pointer jumping.

Both token sequences of a text cover the same bytes. Every token points to the farthest-right token of the other side that
overlaps it, if that reaches further right than the token itself; a token of side B that ends where an A token ends
points to itself. Successors are doubled (next = next[next]) for all tokens of a batch of texts at once until nothing
changes: each token then points to the last token of its group, so about log2 of the longest chain rounds label all groups.

Overlapping A-B pairs are counted per block of texts (bounded in bytes and rows) before anything is shuffled: a block
sends its distinct id pairs once, with counts, to the corpus-wide sums, and gets one count per distinct pair back. Texts are
never shuffled, and no count leaves the executors. What comes back meets the texts' pair lists in one group per block.

A is byte-level BPE, read from its JSON file; B is a sentencepiece model. A is encoded by tiktoken with the file's own entries
as ranks (equal ids, tested); texts with an unsplit run of over LONG_RUN characters, on which that takes the square of
the run, and texts that it refuses are encoded by the tokenizers library.

Defined results: a text that is null or empty, or that a tokenizer does not give back byte for byte, has no tokens: all numbers
0, groups ''. Rows are separate texts whatever their ids (null and repeated ids are kept); very long texts are one row
and are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches
from palate.session import fill_slots, stage

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 20_000
#: Texts of so many bytes are encoded and aligned at once.
STEP_BYTES = 1 << 19
LONG_RUN = 1000
LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
# Fixed value: how this byte-level tokenizer splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: ids and bytes of every entry."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {t["content"] for t in vocab["added_tokens"]}
        letters = byte_letters()
        size = max(vocab["model"]["vocab"].values()) + 1
        self.table = [b""] * max(size, *(t["id"] + 1 for t in vocab["added_tokens"]), 1)
        for token, i in vocab["model"]["vocab"].items():
            if token not in special:
                self.table[i] = bytes(letters[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.table) if b}
        self.fast = tiktoken.Encoding("side_a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        model.no_truncation()
        model.no_padding()
        return model

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[int]:
        long = len(text) >= LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or LONG_SPACE.search(text))
        if not long:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # its regular expression gives up on some texts
                pass
        return self.exact.encode(text, add_special_tokens=False).ids


class Pieces:
    """Side B: ids and bytes of every piece; it puts the space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


def label_groups(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For every token (all A, then all B), the B token that ends its group, by successor doubling.

    a_end, b_end: the tokens' end offsets, ascending; both end at the same place.
    """
    n_a = len(a_end)
    over_a = np.searchsorted(b_end, a_end - 1, side="right")
    over_b = np.searchsorted(a_end, b_end - 1, side="right")
    succ = np.concatenate([n_a + over_a, np.where(a_end[over_b] > b_end, over_b, n_a + np.arange(len(b_end)))])
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            return succ - n_a
        succ = jumped


class Batch:
    """A few texts aligned at once: their tokens lie one after another on one line of bytes."""

    def __init__(self, a_path: str, b_path: str, texts: list[str | None]):
        side_a, side_b = _sides(a_path, b_path)
        named = [t for t in texts if t]
        a, b = side_a.encode([" " + t for t in named]), side_b.encode(named)
        at = iter(zip(named, a, b))
        self.a, self.b = [], []
        for t in texts:
            mine, theirs = [], []
            if t:
                _, mine, theirs = next(at)
                raw = b" " + t.encode()
                if b"".join(map(side_a.table.__getitem__, mine)) != raw or b"".join(map(side_b.table.__getitem__, theirs)) != raw:
                    mine, theirs = [], []
            self.a.append(mine)
            self.b.append(theirs)
        self.n_a = np.array([len(x) for x in self.a], np.int64)
        self.n_b = np.array([len(x) for x in self.b], np.int64)
        ids = lambda lists: np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in lists if x]])
        self.a_id, self.b_id = ids(self.a), ids(self.b)
        a_size, b_size = _sizes(a_path, b_path)
        a_end, b_end = np.cumsum(a_size[self.a_id]), np.cumsum(b_size[self.b_id])
        doc = np.arange(len(texts))
        self.a_doc, self.b_doc = np.repeat(doc, self.n_a), np.repeat(doc, self.n_b)
        if not len(self.a_id):
            self.a_group = self.b_group = self.pair = self.pair_doc = np.zeros(0, np.int64)
            self.n_groups = np.zeros(len(texts), np.int64)
            return
        last = label_groups(a_end, b_end)
        is_last = np.zeros(len(self.b_id), np.int64)
        is_last[last] = 1
        group = np.cumsum(is_last)[last] - 1
        self.a_group, self.b_group = group[: len(self.a_id)], group[len(self.a_id) :]
        self.n_groups = np.bincount(self.b_doc[is_last > 0], minlength=len(texts))
        first = np.searchsorted(b_end, a_end - a_size[self.a_id], side="right")
        n = np.searchsorted(b_end, a_end - 1, side="right") - first + 1
        b_of = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.pair = np.repeat(self.a_id, n) * len(b_size) + self.b_id[b_of]
        self.pair_doc = np.repeat(self.a_doc, n)

    def groups(self, a_path: str, b_path: str) -> list[str]:
        """Per text `a1,a2|b1;a3|b2,b3`: the ids of each group, in order."""
        a_size, b_size = _sizes(a_path, b_path)
        places = np.empty(len(self.a_id) + len(self.b_id), np.int64)
        before = np.searchsorted(self.b_group, self.a_group)  # B tokens of earlier groups
        places[np.arange(len(self.a_id)) + before] = 2 * self.a_id + np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a_id)]
        before = np.searchsorted(self.a_group, self.b_group, side="right")
        places[np.arange(len(self.b_id)) + before] = 2 * (len(a_size) + self.b_id) + np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b_id)]
        words = list(map(_words(a_path, b_path).__getitem__, places.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=1)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in side.table], np.int64) for side in _sides(a_path, b_path))


@functools.lru_cache(maxsize=1)
def _words(a_path: str, b_path: str) -> list[str]:
    a_size, b_size = _sizes(a_path, b_path)
    return [f"{i}{end}" for ends, n in ((",|", len(a_size)), (",;", len(b_size))) for i in range(n) for end in ends]


def _steps(texts: list[str | None]):
    """Ranges of a batch's rows with about STEP_BYTES characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _aligner(a_path: str, b_path: str, schema: pa.Schema):
    """Rows of two kinds: one per text, and one per block that holds the block's distinct id pairs."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        block, rows, size, pairs, pair_docs = 0, [], 0, [], []

        def flush():
            nonlocal block, rows, size, pairs, pair_docs
            key, which = np.unique(np.concatenate(pairs), return_inverse=True)
            # Per text, its distinct pairs as places in the block's list, and how often it holds each.
            mine, times = np.unique(np.concatenate(pair_docs) * max(len(key), 1) + which, return_counts=True)
            ends = np.searchsorted(mine, np.arange(len(rows) + 1) * max(len(key), 1))
            n_b = len(_sizes(a_path, b_path)[1])
            offsets = lambda e: pa.array(np.append(e, e[-1]), pa.int32())
            total = np.bincount(which, minlength=len(key)).astype(np.int64)
            none, head = np.zeros(len(rows), np.int64), [0] * len(rows) + [0, len(key)]
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(head, pa.int32()), pa.array(values, kind))
            columns = {
                "block": pa.array(np.full(len(rows) + 1, task + block), pa.int64()),
                "is_block": pa.array([False] * len(rows) + [True]),
                "id": pa.array([r[0] for r in rows] + [None], schema.field("id").type),
                **{c: pa.array(np.append([r[k] for r in rows], 0).astype(np.int64)) for k, c in ((1, "n_a"), (2, "n_b"), (3, "n_groups"))},
                "n_links": pa.array(np.append(np.add.reduceat(np.append(times, 0), ends[:-1]) * (np.diff(ends) > 0) if len(rows) else none, 0)),
                "groups": pa.array([r[4] for r in rows] + [""]),
                "at": pa.ListArray.from_arrays(offsets(ends), pa.array(mine % max(len(key), 1), pa.int32())),
                "times": pa.ListArray.from_arrays(offsets(ends), pa.array(times, pa.int64())),
                "a": lists(key // n_b, pa.int32()),
                "b": lists(key % n_b, pa.int32()),
                "n": lists(total, pa.int64()),
            }
            made = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
            block, rows, size, pairs, pair_docs = block + 1, [], 0, [], []
            return made

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in _steps(texts):
                done = Batch(a_path, b_path, texts[start:end])
                pairs.append(done.pair)
                pair_docs.append(done.pair_doc + len(rows))
                rows += zip(ids[start:end], done.n_a, done.n_b, done.n_groups, done.groups(a_path, b_path))
                size += sum(len(t or "") for t in texts[start:end])
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                    yield flush()
        if rows:
            yield flush()

    return run


def _sums(table: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block with the corpus-wide counts of the block's pairs."""
    at = pairs.column("pos").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("is_best").to_numpy()
    lists, times = table.column("at").combine_chunks(), table.column("times").combine_chunks().flatten().to_numpy()
    place = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    np.add.at(n_best, doc, best[place] * times)
    np.add.at(count_sum, doc, count[place] * times)
    kept = table.drop_columns(["block", "at", "times"])
    return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each id pair, and the highest such count of its B id."""
    each = aligned.where("is_block").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counts = stage(each.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    # At most one row per entry of B's vocabulary.
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    return counts.join(best, "b").select("a", "b", "count", "best")


def token_align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per text: id, n_a, n_b, n_groups, n_links, groups (its SHA-256 with `digest`), n_best, count_sum."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    out = f"block bigint, is_block boolean, id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
    out += ", at array<int>, times array<bigint>, a array<int>, b array<int>, n array<bigint>"
    empty = spark.createDataFrame([], out)
    aligned = fill_slots(rows).mapInArrow(_aligner(a_path, b_path, empty.toArrow().schema), out)
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    aligned = stage(aligned, "aligned")
    known = pair_counts(aligned).select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))
    asked = aligned.where("is_block").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p")).select("block", "pos", "p.*")
    told = asked.join(known, ["a", "b"]).select(F.col("block").alias("of_block"), "pos", "count", F.col("is_best").cast("int").alias("is_best"))
    texts = aligned.where("NOT is_block").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "times")
    result = f"id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint"
    done = texts.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(_sums, result)
    return done.withColumnRenamed("id", id_col)


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return token_align(docs, a_path, b_path, digest=True).withColumnRenamed("groups", "groups_sha256")
