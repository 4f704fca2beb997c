"""Byte-level BPE by backtracking over longest matches.

An Aho-Corasick automaton gives the longest token at every byte. The encoder takes longest tokens left to right; two
neighbours may stand together only if no merge across their border would have come first, which a table of pairs
answers. On a conflict it falls back to the next shorter token, and to the token before when none is left. A position
that failed once is never entered again, so the work is linear in the text, and the result equals the merges done in
order of rank. Decoding gathers bytes through a table of offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import byte_slices, table

#: How text splits into pieces before the merges (fixed: the published pattern of this vocabulary).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of pieces and ids that a task remembers; beyond this its memory starts afresh. What an entry costs besides
#: its bytes, about; a longer piece than so many characters isn't remembered. Pairs of tokens remembered.
REMEMBERED_BYTES, _OVERHEAD, LONGEST_PIECE, PAIRS = 64 << 20, 190, 256, 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable
    in Latin-1, the rest in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memory(dict):
    """Ids (as little-endian 32-bit integers) of the pieces met so far."""

    def __init__(self, bpe: Encoder):
        self.bpe, self.held = bpe, 0

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.bpe.encode_piece(piece), "<i4").tobytes()
        if len(piece) <= LONGEST_PIECE:
            self[piece] = found
            self.held += len(piece) + len(found) + _OVERHEAD
        return found

    def forget(self) -> None:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        spell = lambda token: bytes(alphabet[c] for c in token)
        size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes = [b""] * size
        for token, i in vocabulary.items():
            self.token_bytes[i] = spell(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.id_of = {spell(token): i for token, i in vocabulary.items()}
        # Ranks count merges from 1; single bytes have rank 0.
        self.rank, self.parts, self.pair = [0] * size, [None] * size, {}
        for rank, merge in enumerate(spec["model"]["merges"], 1):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocabulary[left + right]
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = rank, (vocabulary[left], vocabulary[right])
            self.pair[vocabulary[left], vocabulary[right]] = rank
        self.matcher = ahocorasick.Automaton()
        for spelled, i in self.id_of.items():
            self.matcher.add_word(spelled.decode("latin-1"), (len(spelled) - 1, i))
        self.matcher.make_automaton()
        self.shorter: dict[int, int] = {}
        self.together: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self)

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self.shorter.get(token)
        if found is None:
            spelled = self.token_bytes[token]
            found = next((self.id_of[spelled[:n]] for n in range(len(spelled) - 1, 0, -1) if spelled[:n] in self.id_of), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between these two neighbours alone. Takes the later of the two apart
        again and again; a merge across the border must not come before what stood there was made."""
        known = self.together.get((left, right))
        if known is not None:
            return known
        a, b, before, answer = left, right, len(self.rank) + 1, True
        while True:
            merged = self.pair.get((a, b))
            if merged is not None and merged < before:
                answer = False
                break
            if self.parts[a] is None and self.parts[b] is None:
                break
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.parts[a][1]
            else:  # of equal merges the left one comes first
                before, b = self.rank[b] + 1, self.parts[b][0]
        if len(self.together) > PAIRS:
            self.together.clear()
        self.together[left, right] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        spelled = piece.encode()
        whole = self.id_of.get(spelled)
        if whole is not None:
            return [whole]
        longest = [0] * len(spelled)
        for end, (back, token) in self.matcher.iter(spelled.decode("latin-1")):
            longest[end - back] = token
        n, at, out = len(spelled), 0, []
        open_ = bytearray(b"\1") * (n + 1)
        token, token_bytes = longest[0], self.token_bytes
        while True:
            end = at + len(token_bytes[token])
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.next_shorter(token)
            while token < 0:
                open_[at] = 0
                last = out.pop()
                at -= len(token_bytes[last])
                token = self.next_shorter(last)

    def encode(self, text: str) -> np.ndarray:
        if self.special and self.split_special.search(text):
            parts = self.split_special.split(text)
            packed = b"".join(np.array([self.special[p]], "<i4").tobytes() if p in self.special else self.encode_plain(p) for p in parts)
        else:
            packed = self.encode_plain(text)
        return np.frombuffer(packed, "<i4")

    def encode_plain(self, text: str) -> bytes:
        self.memory.forget()
        return b"".join(map(self.memory.__getitem__, PIECES.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and where each begins."""
    spelled = encoder(path).token_bytes
    starts = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
    return np.frombuffer(b"".join(spelled), np.uint8), starts


def decode_ids(ids: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """The bytes of ``ids`` end to end, and the number of bytes up to each id's end."""
    flat, starts = offset_table(path)
    lengths = starts[ids + 1] - starts[ids]
    ends = np.cumsum(lengths)
    if not len(ids):
        return b"", ends
    gather = np.repeat(starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
    return flat[gather].tobytes(), ends


#: Bytes of text encoded before their ids are handed on, and about as many ids decoded at once.
_STEP_BYTES, _IDS = 2 << 20, 500_000


def _ids(texts: pa.Array, path: str) -> pa.ListArray:
    bpe = encoder(path)
    lists = [bpe.encode(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32), pa.int32()))


def _texts(column: pa.ListArray, path: str) -> pa.Array:
    """Tokens' bytes as UTF-8, with U+FFFD for what isn't valid."""
    lengths = [0 if x is None else x for x in column.value_lengths().to_pylist()]
    values, at, i, out = column.flatten().to_numpy().astype(np.int64), 0, 0, []
    while i < len(lengths):
        j, n = i, 0
        while j < len(lengths) and (j == i or n + lengths[j] <= _IDS):
            n += lengths[j]
            j += 1
        spelled, ends = decode_ids(values[at : at + n], path)
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *lengths[i:j]])]
        out += [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        i, at = j, at + n
    return pa.array(out, pa.string())


_NEW = {"bpe_ids": StructField("bpe_ids", ArrayType(IntegerType(), False), False), "decoded": StructField("decoded", StringType(), False)}


def _mapped(df: DataFrame, text: str, made: dict) -> DataFrame:
    """``df`` with new columns in place of ``text``, the first made of it and each other of the one before."""
    kept = [f for f in df.schema.fields if f.name != text and f.name not in made]
    names = [*(f.name for f in kept), *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for batch in byte_slices(whole, at, _STEP_BYTES):
                columns = [batch.column(at)]
                for make in made.values():
                    columns.append(make(columns[-1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns[1:]], names)

    return df.select(*(f.name for f in kept), text).mapInArrow(run, StructType([*kept, *(_NEW[n] for n in made)]))


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``bpe_ids`` (array<int>) in place of the text column. Null and empty texts give no ids. Strings of the
    vocabulary's added tokens stand for those tokens. Other columns pass through; one named bpe_ids is replaced."""
    return _mapped(docs, text, {"bpe_ids": lambda c: _ids(c, path)})


def decode_documents(encoded: DataFrame, path: str, ids: str = "bpe_ids") -> DataFrame:
    """Adds ``decoded`` (string): the tokens' bytes as UTF-8, with U+FFFD for what isn't valid. Null ids give an
    empty text. Other columns pass through; one named decoded is replaced."""
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), _texts(batch.column(ids), path)], [*(f.name for f in kept), "decoded"])

    return encoded.mapInArrow(run, StructType([*kept, _NEW["decoded"]]))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As encode_documents and then decode_documents, in one pass through Python."""
    return _mapped(docs, text, {"bpe_ids": lambda c: _ids(c, path), "decoded": lambda c: _texts(c, path)})


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's text. Rows that repeat and rows without an id give a row
    each; null and empty texts have no ids and decode to an empty text; an empty table gives none."""
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("bpe_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
