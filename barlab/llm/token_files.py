"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by corpus frequency (rank 0 is the commonest), so most take one byte. Each value takes
one to four data bytes; two bits a value, four values a byte, say how many, in a stream of their own. A reader looks
every control byte up in a table of lengths and gathers the data bytes with numpy.

A file set is a table of blocks, written in ascending doc_id order, and a table of ranks. A block has columns shard,
block, doc_ids, counts (ids of each document), control and data.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import byte_slices, gathered, shuffle_partitions, staged, table

#: Ids in one block, about; a longer document is a block of its own.
BLOCK_IDS = 1_000_000
#: Bytes of words and ids remembered by a Python worker; beyond this the memory starts afresh. What an entry costs
#: besides its bytes, about.
REMEMBERED_BYTES, _OVERHEAD = 200 << 20, 190
#: Blocks up to which their places are broadcast (24 bytes each); beyond, the blocks shuffle.
BROADCAST_ROWS = 100_000
#: Documents decoded at once, and bytes of text encoded at once.
_STEP, _STEP_BYTES = 500, 8 << 20
_TOKENS = ["doc_id", "ids", "token", "n"]
#: Marks that end the piece of a letter before them.
MARKS = ".,;:!?"

#: For each control byte, the number of data bytes of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1


def encode_stream(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    sizes = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < sizes[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_stream(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a stream."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = padded[starts].astype(np.uint32)
    for place in range(1, 4):
        longer = np.flatnonzero(lengths > place)
        if not len(longer):
            break
        values[longer] |= padded[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return values


def _stays_letter(c: str) -> bool:
    """Whether a character is a letter to its end after normalising and lower-casing."""
    return c.isalpha() and unicodedata.normalize("NFC", c).lower().isalpha()


class _Words(dict):
    """Ids of white-space separated words, as little-endian integers of ``kind``. White space separates pieces in the
    tokenizer too, so a text's ids are those of its words in order; it lower-cases, so A-Z may be lower-cased before.
    After a letter its pieces end before a mark, so words are learned without the marks that follow them."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.tokenizer, self.held = kind, Tokenizer.from_file(path), 0
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spell = str.maketrans({b: c for c, b in byte_alphabet().items()})
        self[""] = b""

    def model_ids(self, word: str) -> bytes:
        """Ids of a word of Latin-1 letters. The tokenizer's steps before its model leave such a word one piece in
        lower case, so the model is asked at once."""
        spelled = word.lower()
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(self.spell)
        return np.array([t.id for t in self.model.tokenize(spelled)], self.kind).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the library gives them."""
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(made), self.kind).tobytes()
        ends = np.cumsum([0, *map(len, made)]) * np.dtype(self.kind).itemsize
        return [flat[a:b] for a, b in pairwise(ends.tolist())]

    def put(self, word: str, ids: bytes) -> None:
        self[word] = ids
        self.held += len(word) + len(ids) + _OVERHEAD

    def learn(self, words: list[str]) -> None:
        """Makes the ids of words that aren't known, each distinct word once."""
        whole, marked = {}, []
        for word in words:
            core = word.rstrip(MARKS)
            if core and len(core) < len(word) and _stays_letter(core[-1]):
                marks = word[len(core) :]
                marked.append((word, core, marks))
                for part in (core, marks):
                    if part not in self:
                        whole[part] = None
            else:
                whole[word] = None
        others = []
        for word in whole:
            if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                self.put(word, self.model_ids(word))
            else:
                others.append(word)
        for word, ids in zip(others, self.ids(others)):
            self.put(word, ids)
        for word, core, marks in marked:
            self.put(word, self[core] + self[marks])

    def forget(self) -> None:
        """Starts afresh beyond REMEMBERED_BYTES."""
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self[""], self.held = b"", 0


@lru_cache(maxsize=1)
def _words(path: str, kind: str) -> _Words:
    return _Words(path, kind)


def id_kind(path: str, end_id: int) -> str:
    """The narrowest numpy type of two or four bytes for the ids of a tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _ids_of(texts: pa.Array, known: _Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts end to end, ``end_id`` after each text's, and the number of ids of each. Words are told
    apart a batch at a time, so each distinct word is looked up once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = pc.dictionary_encode(lists.flatten())
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    known.forget()
    known.learn([w for w in words if w not in known])
    found = [known[w] for w in words]
    width = np.dtype(known.kind).itemsize
    sizes = np.array([*map(len, found), width], np.int64) // width
    flat = np.frombuffer(b"".join(found) + np.array([end_id], known.kind).tobytes(), known.kind)
    # The end of a text is one more word, the last in the table.
    text_words = pc.list_value_length(lists).to_numpy().astype(np.int64)
    text_ends = np.cumsum(text_words)
    index = np.insert(index.astype(np.int64), text_ends, len(words))
    lengths = sizes[index]
    counts = np.add.reduceat(lengths, text_ends - text_words + np.arange(len(texts))) if len(texts) else np.empty(0, np.int64)
    return gathered(flat, (np.cumsum(sizes) - sizes)[index], lengths), counts


def _binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts) * ids.itemsize]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def tokenized(docs: DataFrame, path: str, end_id: int, kind: str = "<u4", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian integers of ``kind`` in one binary), ``end_id`` after each document's; and, with
    null ids, a row for each token of a task: token and n, how often the task met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _words(path, kind), np.zeros(1, np.int64)
        for whole in batches:
            for batch in byte_slices(whole, 1, _STEP_BYTES):
                texts = pc.fill_null(batch.column(1), "")
                ids, counts = _ids_of(texts, known, end_id)
                odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
                if len(odd):  # strings of added tokens keep their case and may hold white space
                    parts = np.split(ids, np.cumsum(counts)[:-1])
                    for i, own in zip(odd, known.ids(texts.take(pa.array(odd)).to_pylist())):
                        parts[i] = np.append(np.frombuffer(own, kind), np.array(end_id, kind))
                        counts[i] = len(parts[i])
                    ids = np.concatenate(parts)
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
                none = pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), _binaries(ids, counts), none, none], _TOKENS)
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], _TOKENS)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, ids binary, token bigint, n bigint")


def write_files(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Tokenize ``docs`` and write its file set; returns the blocks and the ranks as read back.

    Null text is empty, so has the end id alone. Null ids come first; rows repeated with one id follow each other.
    Every distinct token has one row in the ranks, so the driver holds at most the vocabulary. Other columns are
    ignored. An empty table gives an empty file set."""
    spark = docs.sparkSession
    kind = id_kind(path, end_id)
    width = np.dtype(kind).itemsize
    made = staged(tokenized(docs, path, end_id, kind), "ids")
    tokens = made.where("ids is not null").select("doc_id", "ids")
    ranks = staged(made.where("ids is null").groupBy("token").agg(F.sum("n").alias("n")), "ranks")
    rank_of = rank_table(ranks, inverse=True)
    shared = spark.sparkContext.broadcast(rank_of)
    sorted_ = tokens.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            keys, ids = zip(*waiting)
            control, data = encode_stream(shared.value[np.frombuffer(b"".join(ids), kind)])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([list(keys)], pa.list_(pa.int64())),
                "counts": pa.array([[len(x) // width for x in ids]], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if n and n + len(ids.as_py()) // width > block_ids:
                    yield made()
                    block, waiting, n = block + 1, [], 0
                waiting.append((key, ids.as_py()))
                n += len(waiting[-1][1]) // width
        if waiting:
            yield made()

    blocks = staged(
        sorted_.mapInArrow(pack, "shard int, block int, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"),
        "token-files",
    )
    return blocks, ranks


def rank_table(ranks: DataFrame, inverse: bool = False) -> np.ndarray:
    """Token of each rank, or the rank of each token."""
    rows = sorted(((-r["n"], r["token"]) for r in ranks.collect()))
    tokens = np.array([t for _, t in rows], np.uint32)
    if not inverse:
        return tokens
    found = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.uint32)
    found[tokens] = np.arange(len(tokens), dtype=np.uint32)
    return found


def read_files(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per document of a file set, in no order: doc_id, start (ids before it in the whole set), ids (as little-endian
    unsigned 32-bit integers in one binary)."""
    spark = blocks.sparkSession
    token_of = spark.sparkContext.broadcast(rank_table(ranks))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                before, keys, counts, control, data = (batch.column(c)[i].as_py() for c in range(5))
                ids = token_of.value[decode_stream(control, data, sum(counts))].astype("<u4")
                ends = np.cumsum([0, *counts])
                for start in range(0, len(keys), _STEP):
                    own = range(start, min(start + _STEP, len(keys)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([keys[j] for j in own], pa.int64()), "start": pa.array(before + ends[own], pa.int64()),
                        "ids": pa.array([ids[ends[j] : ends[j + 1]].tobytes() for j in own], pa.binary()),
                    })

    sizes = blocks.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", earlier(Window.orderBy("shard")).alias("before_shard"))
    starts = sizes.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("before_block")).join(shards, "shard")
    if blocks.select("shard").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = blocks.join(starts, ["shard", "block"]).select(
        (F.col("before_shard") + F.col("before_block")).alias("before"), "doc_ids", "counts", "control", "data"
    )
    return placed.mapInArrow(unpack, "doc_id bigint, start bigint, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_files(*files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
