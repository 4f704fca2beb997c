"""SentencePiece encoding of merge type by backtracking over longest matches, and decoding.

The library merges, again and again, the two neighbours whose joined piece has the highest score (of equal scores the
leftmost), whatever the two are; so there is no list of merges to look pairs up in. Two neighbours may stand together
if merging their joined characters from scratch gives just the two (the answer is remembered), and a sequence whose
neighbours all may is the result of the merges: a merge across a border would have come first in the pair as well. The
encoder takes longest pieces of an Aho-Corasick automaton left to right; on a conflict it falls back to the next
shorter piece, and to the piece before when none is left. A position that failed stands in a bitfield and is not
entered again, so the work is linear in the text. Characters outside the vocabulary become their bytes.

No piece spans a border whose two characters stand together in no piece, so a text may be cut there. Words are such
parts wherever no piece holds a space after another character; a task remembers the ids of those it met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import PAIRS
from .common import byte_slices, gathered, table

#: What stands for a space in pieces (fixed by the format).
SPACE = "▁"
#: Characters of a text that are cut into words at once; a longer word is cut further.
STEP_CHARS, LONG_WORD = 1 << 20, 256
#: Bytes of words and ids that a task remembers before it starts afresh, and what an entry costs besides, about.
REMEMBERED_BYTES, _OVERHEAD = 128 << 20, 190


class _IdBytes(dict):
    """The id of a piece as a little-endian 32-bit integer; of a character outside the vocabulary, those of its bytes."""

    byte_id: list[int]

    def __missing__(self, character: str) -> bytes:
        return np.array([self.byte_id[b] for b in character.encode()], "<i4").tobytes()


class _Words(dict):
    """The ids of the words met so far."""

    model: PieceEncoder
    held = 0

    def __missing__(self, word: str) -> bytes:
        found = self.model.encode_word(word)
        if len(word) <= LONG_WORD:
            self[word] = found
            self.held += len(word) + len(found) + _OVERHEAD
        return found

    def forget(self) -> None:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0


class PieceEncoder:
    """Tables of one model file: pieces with their scores, bytes, and which characters stand together in a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  ﬁ ") != SPACE * 3 + "ﬁ" + SPACE:
            raise ValueError("only models that leave texts as they are, but for a space put before, are known here")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [model.unk_id()] * 256
        self.token_bytes: list[bytes] = []
        self.is_byte = np.zeros(model.get_piece_size(), bool)
        self.begins_with_space = np.zeros(model.get_piece_size(), bool)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.token_bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.token_bytes.append(b"")
            elif model.is_unknown(i):
                self.token_bytes.append(" ⁇ ".encode())
            elif model.is_unused(i):
                raise ValueError("a model with unused pieces")
            else:
                self.id_of[piece], self.score[piece] = i, model.get_score(i)
                self.begins_with_space[i] = piece.startswith(SPACE)
                self.token_bytes.append(piece.replace(SPACE, " ").encode())
        self.beside = {piece[k : k + 2] for piece in self.id_of for k in range(len(piece) - 1)}
        #: The finest rule of cutting words that divides no two neighbours of a piece, or None.
        self.words = next((rule for rule in _RULES if not any(len(rule.findall(two)) > 1 for two in self.beside)), None)
        self.matcher = ahocorasick.Automaton()
        for piece in self.id_of:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        self.shorter: dict[str, str] = {}
        self.together: dict[tuple[str, str], bool] = {}
        self.id_bytes = _IdBytes({piece: np.int32(i).tobytes() for piece, i in self.id_of.items()})
        self.id_bytes.byte_id = self.byte_id
        self.memory = _Words()
        self.memory.model = self

    def merged(self, text: str) -> list[str]:
        """The merges of a few characters, step by step."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def next_shorter(self, piece: str) -> str:
        """The longest piece (or the single character) that is a proper prefix of ``piece``, or an empty string."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.id_of), piece[:1] if len(piece) > 1 else "")
            if len(piece) > 1:
                self.shorter[piece] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two again gives just the two; an empty left side asks whether the piece can be made."""
        known = self.together.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.together) > PAIRS:
                self.together.clear()
            self.together[left, right] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """``text`` in pieces and single characters outside the vocabulary."""
        if text in self.id_of and self.compatible("", text):
            return [text]
        longest = list(text)
        for end, piece in self.matcher.iter(text):
            longest[end - len(piece) + 1] = piece
        n, at, out, before, together, shorter = len(text), 0, [], "", self.together.get, self.shorter.get
        failed = bytearray((n >> 3) + 1)
        piece = longest[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = together((before, piece))
                if self.compatible(before, piece) if fits is None else fits:
                    out.append(piece)
                    if end == n:
                        return out
                    at, before, piece = end, piece, longest[end]
                    continue
            piece = shorter(piece) or self.next_shorter(piece)
            while not piece:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                before = out[-1] if out else ""
                at -= len(last)
                piece = self.next_shorter(last)

    def cut(self, text: str) -> list[str]:
        """``text`` cut wherever two neighbours stand together in no piece."""
        beside = self.beside
        cuts = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in beside), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_word(self, word: str) -> bytes:
        parts = self.cut(word) if len(word) > LONG_WORD else [word]
        return b"".join([b"".join(map(self.id_bytes.__getitem__, self.pieces(part))) for part in parts])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers, without begin and end."""
        if not text:
            return b""
        text, found, at = SPACE + text.replace(" ", SPACE), [], 0
        while at < len(text):
            stop = _border(text, at + STEP_CHARS) if self.words else len(text)
            part = text[at:stop] if at or stop < len(text) else text
            self.memory.forget()
            found.append(b"".join(map(self.memory.__getitem__, self.words.findall(part) if self.words else self.cut(part))))
            at = stop
        return b"".join(found)


#: Rules of cutting words: spaces with the letters, or with the other characters, after them (superscript two counts with
#: these); spaces with all that follows.
_RULES = (
    re.compile(rf"{SPACE}*(?:[^\W\d_²]+|(?:(?!{SPACE})[\W\d_²])+)|{SPACE}+"),
    re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"),
)
_BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def _border(text: str, at: int) -> int:
    """The next place from ``at`` on where a space follows another character, or the end."""
    found = _BORDER.search(text, at) if at < len(text) else None
    return found.start() if found else len(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes end to end, and where each begins."""
    spelled = encoder(path).token_bytes
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ``ids``: the space put before goes, controls are nothing, and each byte of a run of byte pieces that
    is no part of a character becomes U+FFFD."""
    flat, starts = offset_table(path)
    ids = ids.astype(np.int64)
    lengths = starts[ids + 1] - starts[ids]
    seen = np.flatnonzero(lengths)
    if not len(seen):
        return ""
    spelled, model = gathered(flat, starts[ids], lengths).tobytes(), encoder(path)
    drop, byte = int(model.begins_with_space[ids[seen[0]]]), model.is_byte[ids[seen]]
    # A control between two bytes keeps them from making a character.
    if (byte[:-1] & byte[1:] & (np.diff(seen) > 1)).any():
        return _lenient(ids, path, int(seen[0]) if drop else -1)
    try:
        return spelled[drop:].decode()
    except UnicodeDecodeError:
        return _lenient(ids, path, int(seen[0]) if drop else -1)


def _lenient(ids: np.ndarray, path: str, cut: int) -> str:
    """As ``decode`` where bytes don't all make characters: runs of byte pieces one after the other. The space of the id
    at ``cut`` goes."""
    model, out, at = encoder(path), [], 0
    while at < len(ids):
        stop = at + 1
        while stop < len(ids) and model.is_byte[ids[stop]] == model.is_byte[ids[at]]:
            stop += 1
        run = b"".join(model.token_bytes[i] for i in ids[at:stop])
        if not model.is_byte[ids[at]]:
            out.append((run[1:] if at <= cut < stop else run).decode())
        else:
            k = 0
            while k < len(run):
                size = next((n for n in (1, 2, 3, 4) if k + n <= len(run) and _is_character(run[k : k + n])), 0)
                out.append(run[k : k + size].decode() if size else "\ufffd")
                k += size or 1
        at = stop
    return "".join(out)


def _is_character(part: bytes) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


def with_ends(ids: bytes, model: PieceEncoder) -> bytes:
    return np.array([model.begin], "<i4").tobytes() + ids + np.array([model.end], "<i4").tobytes()


#: Bytes of text encoded before their ids are handed on.
_STEP_BYTES = 2 << 20


def encode_documents(docs: DataFrame, path: str, text: str = "text", ends: bool = True) -> DataFrame:
    """Adds ``piece_ids`` (array<int>) in place of the text column, with the begin and end ids unless ``ends`` is off.
    Null and empty texts have no ids but those. Other columns pass through; one named piece_ids is replaced."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "piece_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for batch in byte_slices(whole, at, _STEP_BYTES):
                lists = [model.encode(t or "") for t in batch.column(at).to_pylist()]
                lists = [with_ends(x, model) for x in lists] if ends else lists
                offsets = np.cumsum([0, *(len(x) // 4 for x in lists)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), ids], [*(f.name for f in kept), "piece_ids"])

    schema = StructType([*kept, StructField("piece_ids", ArrayType(IntegerType(), False), False)])
    return docs.select(*(f.name for f in kept), text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """Adds ``decoded`` (string). Null ids give an empty text. Other columns pass through; one named decoded is replaced."""
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.array(x.values) if x.is_valid else np.empty(0, np.int64), path) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), "decoded"])

    return encoded.mapInArrow(run, StructType([*kept, StructField("decoded", StringType(), False)]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, begin and end included, as little-endian 32-bit integers) and
    decoded_sha256 of every row's text, in one pass. Rows that repeat and rows without an id give a row each; null and
    empty texts have the begin and end ids alone and decode to an empty text; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for whole in batches:
            for batch in byte_slices(whole, 1, _STEP_BYTES):
                rows = []
                for text in batch.column(1):
                    ids = with_ends(model.encode(text.as_py() or ""), model)
                    decoded = decode(np.frombuffer(ids, "<i4"), path)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema.names)

    schema = StructType([
        docs.select("doc_id").schema.fields[0], StructField("n_tokens", LongType(), False), StructField("ids_sha256", StringType(), False),
        StructField("decoded_sha256", StringType(), False),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
