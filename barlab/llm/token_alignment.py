"""Alignment of two tokenizers' tokens over the same bytes.

Where tokens of both end at one byte, the text is cut into groups; in a group, tokens whose byte ranges overlap are
linked. What a range of bytes knows by itself is a fragment: the tokens up to the first common end in it (open in
front, for their group may begin earlier), the groups between (closed: their text and their counted links), and the
tokens after the last common end (open behind). Two neighbouring fragments compose to one: what is open behind the
left and in front of the right makes one more group. That is associative, with the empty fragment as its unit, so very
long documents are cut into byte ranges, tokenized wherever Spark puts them, and their fragments reduced as a tree.

A range is tokenized with a little text on either side, out to borders where no token of either tokenizer can reach
across: a single space between two letters, beside which the pieces of the one are cut in any case, and which stands
with the letter before it in no piece of the other.

The counts of linked id pairs over all documents go back to documents by parcels: each parcel of documents asks once
for every pair it holds, whatever the number of its documents that hold it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import PIECES, byte_alphabet
from .common import byte_slices, gathered, staged, table
from .piece_bpe import SPACE, PieceEncoder

#: Characters of a byte range; a document of more is spread over tasks. Fragments composed at once in a round.
RANGE_CHARS, FAN = 1 << 15, 16
#: Distinct pairs of all documents of a parcel together, about.
PARCEL_PAIRS = 2_000_000
#: Letters beyond this aren't asked for at borders: whether a character is one depends on the version of the tables.
_LETTERS_BELOW = "\u0530"

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NONE = np.empty(0, np.int64)
NOTHING: Tokens = (_NONE, _NONE, _NONE, _NONE)


class Tokenizers:
    """Both vocabularies: encoders, byte lengths, decimal ids with what follows them in a group."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        made = [vocabulary[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        merged = set(made)
        spelled_out = {token: i for token, i in ranks.items() if len(token) == 1 or i in merged}
        if made != sorted(made) or len(spelled_out) < 256:
            raise ValueError("the first vocabulary's ids must be in order of their merges")
        self.a = tiktoken.Encoding("pieces", pat_str=PIECES.pattern, mergeable_ranks=spelled_out, special_tokens={})
        self.a_bytes = np.zeros(1 + max(ranks.values()), np.int64)
        for token, i in ranks.items():
            self.a_bytes[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = PieceEncoder(path_b)
        self.beside = spelled.beside
        self.b_flat = np.frombuffer(b"".join(spelled.token_bytes), np.uint8)
        self.b_bytes = np.array([len(t) for t in spelled.token_bytes], np.int64)
        self.b_starts = np.cumsum(self.b_bytes) - self.b_bytes
        self.most = max(len(self.a_bytes), len(self.b_bytes))
        # Entry 3 i + 0, 1 or 2: id i with a comma, a bar or a semicolon after it.
        self.said = [b"%d%c" % (i, c) for i in range(self.most) for c in b",|;"]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """``text`` begins with a space: ids of both, and whether the second's bytes are those of the text."""
        spelled = text.encode()
        a = self.a.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        b = self.b.encode_as_numpy(text[1:]).astype(np.int64)
        return a, b, gathered(self.b_flat, self.b_starts[b], self.b_bytes[b]).tobytes() == spelled

    def border(self, text: str, k: int) -> bool:
        """Whether no token reaches across the place before character ``k``, a space."""
        letter = lambda c: c < _LETTERS_BELOW and c.isalpha()
        return 0 < k < len(text) - 1 and text[k] == " " and letter(text[k - 1]) and letter(text[k + 1]) and text[k - 1] + SPACE not in self.beside


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


@dataclass
class Fragment:
    """A byte range's part of an alignment. Without a common end (``cut`` is false) all tokens are open, in ``front``."""

    cut: bool = False
    front: Tokens = NOTHING
    body: list[bytes] = field(default_factory=list)
    groups: int = 0
    links: int = 0
    codes: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)
    behind: Tokens = NOTHING
    differs: bool = False
    n_a: int = 0
    n_b: int = 0


def closed(both: Tokenizers, tokens: Tokens, start: int) -> Fragment:
    """The groups of tokens from byte ``start`` on whose last ends fall together, as a closed fragment."""
    a, a_ends, b, b_ends = tokens
    size = int(a_ends[-1]) - start
    in_a, in_b = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    in_a[a_ends - start], in_b[b_ends - start] = 1, 1
    ends, cuts = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    # Between two ends next to each other stand one token of each.
    codes, times = np.unique(a[upto_a[ends - 1]] << 32 | b[upto_b[ends - 1]], return_counts=True)
    # A group's tokens of the first come before its tokens of the second.
    group_a, group_b = np.searchsorted(cuts, a_ends - start), np.searchsorted(cuts, b_ends - start)
    said = np.empty(len(a) + len(b), np.int64)
    said[np.arange(len(a)) + np.concatenate([[0], upto_b[cuts]])[group_a]] = 3 * a + in_b[a_ends - start]
    said[np.arange(len(b)) + upto_a[cuts][group_b]] = 3 * b + 2 * in_a[b_ends - start]
    text = b"".join(map(both.said.__getitem__, said.tolist()))
    return Fragment(True, NOTHING, [text], len(cuts), len(ends), codes, times, n_a=len(a), n_b=len(b))


def _part(tokens: Tokens, low: int, high: int) -> Tokens:
    """The tokens that end in (low, high]."""
    a, a_ends, b, b_ends = tokens
    i, j = np.searchsorted(a_ends, [low, high], "right"), np.searchsorted(b_ends, [low, high], "right")
    return a[i[0] : i[1]], a_ends[i[0] : i[1]], b[j[0] : j[1]], b_ends[j[0] : j[1]]


def fragment(both: Tokenizers, tokens: Tokens) -> Fragment:
    """What the tokens that end in a byte range know by themselves."""
    common, sizes = np.intersect1d(tokens[1], tokens[3], assume_unique=True), {"n_a": len(tokens[0]), "n_b": len(tokens[2])}
    if not len(common):
        return Fragment(False, tokens, **sizes)
    first, last = int(common[0]), int(common[-1])
    out = closed(both, _part(tokens, first, last), first) if last > first else Fragment(True)
    out.n_a, out.n_b = len(tokens[0]), len(tokens[2])
    out.front, out.behind = _part(tokens, -1, first), _part(tokens, last, np.iinfo(np.int64).max)
    return out


def _start(tokens: Tokens, both: Tokenizers) -> int:
    return int(tokens[1][0] - both.a_bytes[tokens[0][0]]) if len(tokens[0]) else int(tokens[3][0] - both.b_bytes[tokens[2][0]])


def composed(both: Tokenizers, parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments as one, from left to right."""
    out, counted = Fragment(), []
    for x in parts:
        out.differs |= x.differs
        if out.differs:
            continue
        out.n_a, out.n_b = out.n_a + x.n_a, out.n_b + x.n_b
        if not x.cut:
            where = "behind" if out.cut else "front"
            setattr(out, where, _joined(getattr(out, where), x.front))
            continue
        if not out.cut:
            out.cut, out.front = True, _joined(out.front, x.front)
        else:
            tokens = _joined(out.behind, x.front)
            middle = closed(both, tokens, _start(tokens, both))
            _add(out, middle, counted)
        _add(out, x, counted)
        out.behind = x.behind
    if out.differs:
        return Fragment(differs=True)
    if counted:
        codes, inverse = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
        out.codes, out.times = codes, np.bincount(inverse, np.concatenate([t for _, t in counted])).astype(np.int64)
    return out


def _joined(x: Tokens, y: Tokens) -> Tokens:
    return tuple(np.concatenate(z) for z in zip(x, y))  # type: ignore[return-value]


def _add(out: Fragment, x: Fragment, counted: list) -> None:
    out.body += x.body
    out.groups += x.groups
    out.links += x.links
    if len(x.codes):
        counted.append((x.codes, x.times))


def whole(both: Tokenizers, x: Fragment) -> Fragment:
    """A document's fragment with its front closed: a document begins at a common end, and ends at one."""
    if x.differs or not x.cut:
        return Fragment(differs=x.differs)
    return composed(both, [Fragment(True), x])


# Rows


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups binary, parcel string, pairs binary"
_KEYS = ["front", "behind"]
_FRAGMENT = "row long, k long, at long, cut boolean, differs boolean, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs binary, " + ", ".join(
    f"{k}_{t} binary" for k in _KEYS for t in ("a", "a_ends", "b", "b_ends")
)


def _packed(codes: np.ndarray, times: np.ndarray, small: bool) -> bytes:
    kind = np.uint16 if small else np.uint32
    return b"".join([(codes >> 32).astype(kind).tobytes(), (codes & 0xFFFFFFFF).astype(kind).tobytes(), times.astype(np.uint32).tobytes()])


def _unpacked(packed: bytes, small: bool) -> tuple[np.ndarray, np.ndarray]:
    kind, width = (np.uint16, 2) if small else (np.uint32, 4)
    n = len(packed) // (2 * width + 4)
    ids = np.frombuffer(packed, kind, 2 * n).astype(np.int64)
    return ids[:n] << 32 | ids[n:], np.frombuffer(packed, np.uint32, n, 2 * n * width).astype(np.int64)


class _Parcels:
    """Numbers of the parcels that one task fills."""

    def __init__(self, kind: str):
        self.task, self.number, self.held = f"{kind}{TaskContext.get().partitionId()}", 0, 0

    def take(self, pairs: int) -> str:
        if self.held and self.held + pairs > PARCEL_PAIRS:
            self.number, self.held = self.number + 1, 0
        self.held += pairs
        return f"{self.task}-{self.number}"


def _document_row(both: Tokenizers, x: Fragment, parcels: _Parcels, digest: bool) -> tuple:
    if x.differs or not x.cut:
        return 0, 0, 0, 0, b"", parcels.take(0), b""
    groups = b"".join(x.body)[:-1]
    said = hashlib.sha256(groups).hexdigest().encode() if digest else groups
    return x.n_a, x.n_b, x.groups, x.links, said, parcels.take(len(x.codes)), _packed(x.codes, x.times, both.most <= 1 << 16)


def _short(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """The rows of documents that one task tokenizes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, parcels = tokenizers(path_a, path_b), _Parcels("s")
        for all_ in batches:
            for batch in byte_slices(all_, 1, 4 << 20):
                rows = []
                for text in batch.column(1).to_pylist():
                    if not text:
                        rows.append(_document_row(both, Fragment(), parcels, digest))
                        continue
                    a, b, same = both.encode(" " + text)
                    found = closed(both, (a, np.cumsum(both.a_bytes[a]), b, np.cumsum(both.b_bytes[b])), 0) if same else Fragment(differs=True)
                    rows.append(_document_row(both, found, parcels, digest))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows), _types(schema, 1))], schema.names)

    schema = _schema(docs, _DOC)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _schema(docs: DataFrame, rest: str) -> StructType:
    return StructType([docs.select("doc_id").schema.fields[0], *StructType.fromDDL(rest).fields])


def _types(schema: StructType, skip: int) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields[skip:]]


def _slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Byte ranges of long documents: row, doc_id, k, low and high (its tokens end in (low, high]), base (where its text
    begins) and the text out to the next borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for row, doc, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                text, low = " " + text.as_py(), 0
                for k, at in enumerate(range(0, len(text), RANGE_CHARS)):
                    stop = min(at + RANGE_CHARS, len(text))
                    left, right = at, stop
                    while left and not both.border(text, left):
                        left = max(0, text.rfind(" ", 0, left))
                    while right < len(text) and not both.border(text, right):
                        right = text.find(" ", right + 1)
                        right = len(text) if right < 0 else right
                    high = low + len(text[at:stop].encode())
                    yield pa.RecordBatch.from_pylist([{
                        "row": row.as_py(), "doc_id": doc.as_py(), "k": k, "low": low, "high": high, "base": low - len(text[left:at].encode()), "part": text[left:right],
                    }], _arrow(schema))
                    low = high

    long_ = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = StructType([
        StructField("row", long_.schema["row"].dataType), long_.schema["doc_id"], *StructType.fromDDL("k long, low long, high long, base long, part string").fields,
    ])
    return long_.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    return pa.schema(list(zip(schema.names, _types(schema, 0))))


def _fragment_row(both: Tokenizers, row: int, k: int, x: Fragment) -> tuple:
    ends = [z.tobytes() for key in _KEYS for z in getattr(x, key)]
    return row, k // FAN, k % FAN, x.cut, x.differs, x.n_a, x.n_b, x.groups, x.links, b"".join(x.body), _packed(x.codes, x.times, both.most <= 1 << 16), *ends


def _fragments_of(both: Tokenizers, rows: pa.Table | pa.RecordBatch) -> list[Fragment]:
    out = []
    for r in rows.to_pylist():
        codes, times = _unpacked(r["pairs"], both.most <= 1 << 16)
        front, behind = (tuple(np.frombuffer(r[f"{k}_{t}"], np.int64) for t in ("a", "a_ends", "b", "b_ends")) for k in _KEYS)
        out.append(Fragment(r["cut"], front, [r["groups"]] if r["groups"] else [], r["n_groups"], r["n_links"], codes, times, behind, r["differs"], r["n_a"], r["n_b"]))
    return out


def _long(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """The rows of long documents: ranges as fragments, spread over tasks, composed in a tree."""
    slices = staged(_slices(docs, path_a, path_b), "slices")
    schema = StructType.fromDDL(_FRAGMENT)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for r in batch.to_pylist():
                a, b, same = both.encode(r["part"])
                tokens = (a, r["base"] + np.cumsum(both.a_bytes[a]), b, r["base"] + np.cumsum(both.b_bytes[b]))
                x = fragment(both, _part(tokens, r["low"], r["high"])) if same else Fragment(differs=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_fragment_row(both, r["row"], r["k"], x), _types(schema, 0))], schema.names)

    def reduce(group: pa.Table) -> pa.Table:
        both = tokenizers(path_a, path_b)
        group = group.sort_by("at")
        x = composed(both, _fragments_of(both, group))
        row = _fragment_row(both, group["row"][0].as_py(), group["k"][0].as_py(), x)
        return pa.table([pa.array([v], t) for v, t in zip(row, _types(schema, 0))], schema.names)

    parts = slices.repartition("row", "k").mapInArrow(begin, schema)
    most = slices.agg(F.max("k")).first()[0] or 0
    while True:
        parts = parts.groupBy("row", "k").applyInArrow(reduce, schema)
        most //= FAN
        if most == 0:
            break
    ids = slices.where("k = 0").select(F.col("row").alias("own"), "doc_id")
    counts = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *schema.fields])
    final = _schema(docs, _DOC)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, parcels = tokenizers(path_a, path_b), _Parcels("l")
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = _document_row(both, whole(both, _fragments_of(both, one)[0]), parcels, digest)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), *(pa.array([v], t) for v, t in zip(row, _types(final, 1)))], final.names)

    return parts.join(ids, parts["row"] == ids["own"]).select(*counts.names).mapInArrow(finish, final)


def alignments(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """``docs``: doc_id, text. doc_id, n_a, n_b, n_groups, n_links and groups (binary: ids of the first and the second
    tokenizer, as in ``a1,a2|b1;a3|b2``, or with ``digest`` the hex of its SHA-256) of every row, with its parcel and
    its packed distinct pairs. The first tokenizer gets a space and the text, the second the text.

    Null and empty texts, and those whose bytes the second doesn't give back, have no tokens: zeros and an empty text.
    Rows that repeat and rows without an id give a row each; an empty table gives none."""
    own = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > RANGE_CHARS
    return _short(own.where(~is_long), path_a, path_b, digest).unionByName(_long(own.where(is_long), path_a, path_b, digest))


def _asked(rows: DataFrame, small: bool) -> DataFrame:
    """parcel, code and n: each pair of a parcel, with how many of its documents hold it (in one or a few rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for batch in byte_slices(all_, 1, 16 << 20):
                parcels = np.array(batch.column(0).to_pylist(), object)
                for parcel in np.unique(parcels.astype(str)):
                    held = [_unpacked(batch.column(1)[int(i)].as_py(), small)[0] for i in np.flatnonzero(parcels == parcel)]
                    codes, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([parcel] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["parcel", "code", "n"])

    return rows.select("parcel", "pairs").mapInArrow(run, "parcel string, code long, n long")


def pair_counts(asked: DataFrame) -> DataFrame:
    """code (the first's id in the upper half), documents that hold the pair linked, and best: whether no pair of the
    first's id has more. An id has at most as many pairs as the second vocabulary has ids."""
    counts = asked.groupBy("code").agg(F.sum("n").alias("documents"))
    top = F.max("documents").over(Window.partitionBy(F.shiftright("code", 32)))
    return counts.withColumn("best", F.col("documents") == top)


def link_scores(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no pair of the same first id exceeds over all
    documents), count_sum (documents that hold the pair, over all links) and groups_sha256, as ``alignments`` says."""
    small = tokenizers(path_a, path_b).most <= 1 << 16
    rows = staged(alignments(docs, path_a, path_b, digest=True), "aligned")
    asked = staged(_asked(rows, small), "asked")
    answers = asked.select("parcel", "code").join(pair_counts(asked), "code")
    out = _schema(docs, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        known, at = np.unique(right["code"].to_numpy(), return_index=True)
        documents, best = right["documents"].to_numpy()[at], right["best"].to_numpy()[at]
        scores = []
        for pairs in left["pairs"]:
            codes, times = _unpacked(pairs.as_py(), small)
            i = np.searchsorted(known, codes)
            scores.append((int(times[best[i]].sum()), int((times * documents[i]).sum())) if len(codes) else (0, 0))
        n_best, total = zip(*scores) if scores else ((), ())
        columns = [left[c].combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left["groups"].cast(pa.string()).combine_chunks()], out.names)

    return rows.groupBy("parcel").cogroup(answers.groupBy("parcel")).applyInArrow(look_up, out)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return link_scores(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))
