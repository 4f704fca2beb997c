"""Removal of long repeated byte strings by suffix arrays over content-defined shards.

Documents are packed into parcels. Every 50-byte string has an anchor, the 20-byte string of least hash inside it, so
equal strings have equal anchors; successive strings with one anchor are a run. Least hashes crowd at the low end of their
range, so anchors are hashed again, which deals them evenly. A parcel's anchors go through a Golomb-coded exchange, whose
owners grow with the bytes of text, and only runs around anchors that several places hold are looked at again: each parcel
sends each distinct run once, with the smallest document that has it, to the anchor's shard. Shards travel in bundles, a row
for each parcel and bundle, as rows for each parcel and shard would grow with the square of the input. A shard takes what
lies between the first and the last string of a run whose hash another string of the shard has as well, sorts the suffixes
of that by induced sorting and reads off the permuted common prefixes which strings are equal, and so the smallest document
that has each. These answers go back to the parcels, where the bytes that each document loses are
put together. Runs of an anchor that very many places hold are cut into their single strings, which go to shards by
their own hash, so that no anchor's runs gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import byte_slices, gathered, shuffle_partitions, staged, table
from .suffix_array import permuted_prefixes, suffix_array

WIDTH, GRAM = 50, 20
#: Distinct runs in one shard, about; bytes of text per owner of the exchange; bytes of text in a parcel.
SHARD_RUNS, OWNER_BYTES, PARCEL_BYTES = 40_000, 24 << 20, 4 << 20
#: Shards in one bundle at most, and bundles up to which a shard is a bundle of its own.
BUNDLE, BUNDLES = 16, 200
#: Strings in a run; longer ones (of one repeated byte, say) are cut.
LONGEST_RUN = 64
#: An anchor is named to its owner with its number of places where a parcel has so many, and is hot beyond so many in
#: all; its runs are then cut into single strings.
HEAVY_PLACES, HOT_PLACES = 32, 20_000

_U = np.uint64
_BASE = 0x27D4EB2F165667C5
_CHUNK = 1 << 15
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
#: Stands for a null id: after every other.
_NO_ID = (1 << 63) - 1


def _power(m: int) -> np.uint64:
    return _U(pow(_BASE, m, 1 << 64))


def _doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings of 2, 4 and 16 bytes at each place."""
    one = (data.astype(np.uint64) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)
    one ^= one >> _U(32)
    two = one[:-1] * _power(1) + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    return two, four, eight[:-8] * _power(8) + eight[8:]


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def _string_hashes(data: np.ndarray) -> np.ndarray:
    """Of each WIDTH-byte string of ``data``."""
    out = [np.empty(0, np.uint64)]
    last = len(data) - WIDTH + 1
    for lo in range(0, last, _CHUNK):
        two, _, sixteen = _doubled(data[lo : min(lo + _CHUNK, last) + WIDTH - 1])
        n = len(two) - WIDTH + 2
        h = (sixteen[:n] * _power(16) + sixteen[16 : 16 + n]) * _power(16) + sixteen[32 : 32 + n]
        out.append(_finished(h * _power(2) + two[48 : 48 + n]))
    return np.concatenate(out)


def _least_hashes(data: np.ndarray) -> np.ndarray:
    """The anchor of each WIDTH-byte string of ``data``."""
    _, four, sixteen = _doubled(data)
    h = _finished(sixteen[:-4] * _power(4) + four[16:])
    many, reach = WIDTH - GRAM + 1, 1
    least = h
    while reach * 2 <= many:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(h) - many + 1], least[many - reach : len(h) - reach + 1])


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of ``sizes`` bytes, end to end in ``data``: each run's first string, its number of strings (at most
    LONGEST_RUN) and its anchor, spread evenly over all numbers. Strings lie within one document."""
    ends = np.cumsum(sizes)
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, np.maximum(ends - sizes, ends - WIDTH + 1), 1)
    np.subtract.at(edges, ends, 1)
    whole = np.cumsum(edges[:-1], dtype=np.int8) == 0
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    last = len(data) - WIDTH + 1
    for lo in range(0, last, _CHUNK):
        hi = min(lo + _CHUNK, last)
        least, inside = _least_hashes(data[lo : hi + WIDTH - 1]), whole[lo:hi]
        cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
        keep = inside[cut]
        out.append((cut[keep] + lo, np.diff(np.append(cut, hi - lo))[keep], least[cut[keep]]))
    first, many, anchor = (np.concatenate(x) for x in zip(*out))
    anchor = _finished(anchor)
    if many.max(initial=0) > LONGEST_RUN:
        cuts = -(-many // LONGEST_RUN)
        step = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * LONGEST_RUN
        first, many, anchor = np.repeat(first, cuts) + step, np.minimum(np.repeat(many, cuts) - step, LONGEST_RUN), np.repeat(anchor, cuts)
    return first, many, anchor


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays, each after its length in bytes, compressed together."""
    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return _COMPRESSOR.compress(np.array([len(x) for x in raw], np.int64).tobytes() + b"".join(raw))


def _unpacked(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw = _DECOMPRESSOR.decompress(packed)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, len(kinds)).tolist()):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_SENT = "parcel bigint, texts binary, owner int, block binary, again binary, heavy array<int>, places array<int>"
_SENT_TYPES = dict(
    parcel=pa.int64(), texts=pa.binary(), owner=pa.int32(), block=pa.binary(), again=pa.binary(), heavy=pa.list_(pa.int32()), places=pa.list_(pa.int32())
)


def _row(kinds: dict, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in kinds.items()], names=list(kinds))


def _send(bits: int, span: int, parcel_bytes: int, heavy_places: int):
    """Rows of parcels, and rows of their anchors' blocks, one for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            sizes, data = np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
            yield _row(_SENT_TYPES, parcel=parcel, texts=_packed(np.array(ids, np.int64), sizes, data))
            distinct, places = np.unique(runs(data, sizes)[2] >> _U(64 - bits), return_counts=True)
            for owner, a, b in exchange.by_owner(distinct, span):
                own = places[a:b]
                heavy = np.flatnonzero(own >= heavy_places)
                yield _row(
                    _SENT_TYPES, parcel=parcel, owner=owner, block=exchange.coded(distinct[a:b], owner, span), again=exchange.bitmap(own > 1),
                    heavy=heavy, places=own[heavy],
                )

        for whole in batches:
            for batch in byte_slices(whole, 1, parcel_bytes):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = text.encode()
                    if texts and held + len(raw) > parcel_bytes:
                        yield from made()
                        parcel, ids, texts, held = parcel + 1, [], [], 0
                    ids.append(doc)
                    texts.append(raw)
                    held += len(raw)
        if texts:
            yield from made()

    return run


def _answers(hot_places: int):
    def answer(blocks: pd.DataFrame) -> pd.DataFrame:
        """For each block of one owner, which of its anchors several places hold, and which of them are hot."""
        weights = []
        for block, again, heavy, places in zip(*(blocks[c] for c in ("block", "again", "heavy", "places"))):
            own = 1.0 + exchange.flags(again, exchange.size_of(block))
            own[np.asarray(heavy, np.int64)] = places
            weights.append(own)
        totals = exchange.sums_over_blocks(list(blocks["block"]), weights)
        return pd.DataFrame({
            "parcel": blocks["parcel"], "owner": blocks["owner"], "shared": [exchange.bitmap(t > 1) for t in totals],
            "hot": [exchange.bitmap(t > hot_places) if (t > hot_places).any() else None for t in totals],
            "n": [int((t > 1).sum()) for t in totals],
        })

    return answer


class _Parcel:
    """A parcel's documents and its shared runs: ``starts`` (first strings), ``number`` (of the distinct run, in the order
    of shards), and per distinct run its ``pieces`` (bytes), ``least`` (smallest document) and ``shard``."""

    def __init__(self, texts: bytes, answers: list, bits: int, span: int, shards: int):
        self.ids, self.sizes, self.data = _unpacked(texts, np.int64, np.int64, np.uint8)
        first, many, anchor = runs(self.data, self.sizes)
        distinct, inverse = np.unique(anchor >> _U(64 - bits), return_inverse=True)
        shared, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        told = {a["owner"]: a for a in answers or ()}
        for owner, a, b in exchange.by_owner(distinct, span):
            shared[a:b] = exchange.flags(told[owner]["shared"], b - a)
            if told[owner]["hot"] is not None:
                hot[a:b] = exchange.flags(told[owner]["hot"], b - a)
        whole, cut = (shared & ~hot)[inverse], (shared & hot)[inverse]
        starts, counts, shard = first[whole], many[whole], (anchor[whole] % _U(shards)).astype(np.int64)
        raw = self.data.tobytes()
        if cut.any():  # single strings, by their own hash
            n = many[cut]
            single = np.repeat(first[cut] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + WIDTH]) % shards for a in single.tolist()), np.int64, len(single))
            starts, counts, shard = np.append(starts, single), np.append(counts, np.ones(len(single), np.int64)), np.append(shard, own)
        known: dict[bytes, int] = {}
        ends = starts + counts + WIDTH - 1
        number = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        shard_of = np.zeros(len(known), np.int64)
        shard_of[number] = shard
        order = np.argsort(shard_of, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        self.starts, self.number, self.shard = starts, rank[number], shard_of[order]
        self.owner = self.ids[np.searchsorted(np.cumsum(self.sizes), starts, side="right")]
        self.least = np.full(len(known), _NO_ID)
        np.minimum.at(self.least, self.number, self.owner)
        names = list(known)
        self.pieces = [names[k] for k in order.tolist()]


_RUNS = "parcel bigint, bundle int, packed binary"


def _distinct_runs(bits: int, span: int, shards: int, parts: int):
    """Per parcel and bundle of ``parts`` shards a row with the parcel's distinct shared runs, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _Parcel(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), bits, span, shards)
                bundle, part = np.divmod(own.shard, parts)
                cuts, packed = np.flatnonzero(np.diff(bundle, prepend=-1)), []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bundle)]):
                    lengths = np.fromiter(map(len, own.pieces[a:b]), np.int32, b - a)
                    counts = np.bincount(part[a:b], minlength=parts).astype(np.int32)
                    packed.append(_packed(counts, own.least[a:b], lengths, b"".join(own.pieces[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(packed), pa.int64()), pa.array(bundle[cuts], pa.int32()), pa.array(packed, pa.binary())],
                    ["parcel", "bundle", "packed"],
                )

    return run


def smallest_holders(pieces: list[bytes], least: np.ndarray) -> np.ndarray:
    """``pieces``: distinct byte strings of at least WIDTH bytes, each with its smallest document. For every
    WIDTH-byte string of every piece, in order, the smallest document of any piece that has it."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = data.astype(np.int32) + 2
    symbols[begins + lengths] = 1
    order = suffix_array(np.append(symbols, 0))
    counts = lengths - WIDTH + 1
    tops = np.cumsum(counts)
    string_of = np.full(len(data) + 1, -1, np.int64)
    string_of[np.repeat(begins - (tops - counts), counts) + np.arange(tops[-1])] = np.arange(tops[-1])
    whole = order[string_of[order] >= 0]  # strings that lie whole inside a piece, in suffix order
    room = np.repeat(begins + lengths, lengths + 1) - np.arange(len(data))
    new = permuted_prefixes(data, whole, room)[whole] < WIDTH
    new[0] = True
    heads = np.flatnonzero(new)
    least_of = np.repeat(least, counts)[string_of[whole]]
    smallest = np.empty(tops[-1], np.int64)
    smallest[string_of[whole]] = np.repeat(np.minimum.reduceat(least_of, heads), np.diff(np.append(heads, len(whole))))
    return smallest


def _repeated(pieces: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For every WIDTH-byte string of every piece, in order, whether another one has its hash."""
    tops, ends = np.cumsum(counts), np.cumsum(counts + WIDTH - 1)
    places = np.repeat(ends - counts - WIDTH + 1 - (tops - counts), counts) + np.arange(tops[-1])
    h = _string_hashes(np.frombuffer(b"".join(pieces), np.uint8))[places]
    ranked = np.sort(h)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(len(h), bool)
    return twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h


def smallest_of_strings(pieces: list[bytes], least: np.ndarray) -> np.ndarray:
    """As ``smallest_holders``; only what can hold an equal string is sorted, and what is equal of several pieces once."""
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - WIDTH + 1
    begins = np.cumsum(counts) - counts
    smallest = np.repeat(least, counts)
    at = np.flatnonzero(_repeated(pieces, counts))
    if not len(at):
        return smallest
    piece = np.searchsorted(begins, at, side="right") - 1
    heads = np.flatnonzero(np.diff(piece, prepend=-1))
    owner, first, last = piece[heads], at[heads], at[np.append(heads[1:], len(at)) - 1]
    known: dict[bytes, int] = {}
    lo, hi = first - begins[owner], last - begins[owner] + WIDTH
    middles = (known.setdefault(pieces[k][a:b], len(known)) for k, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist()))
    number = np.fromiter(middles, np.int64, len(owner))
    held = np.full(len(known), _NO_ID)
    np.minimum.at(held, number, least[owner])
    n = last - first + 1
    many = np.zeros(len(known), np.int64)
    many[number] = n
    found = smallest_holders(list(known), held)
    smallest[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] = gathered(found, (np.cumsum(many) - many)[number], n)
    return smallest


def _judged(runs_: list[list[bytes]], docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one shard, per parcel and run in the order sent: stretches of strings with one smallest document (how many
    stretches, where each ends, and that document)."""
    known: dict[bytes, int] = {}
    numbers = [np.fromiter((known.setdefault(x, len(known)) for x in own), np.int64, len(own)) for own in runs_]
    if not known:
        return [(np.empty(0, np.int64),) * 3 for _ in runs_]
    least = np.full(len(known), _NO_ID)
    np.minimum.at(least, np.concatenate(numbers), np.concatenate(docs))
    pieces = list(known)
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - WIDTH + 1
    tops = np.cumsum(counts)
    smallest = smallest_of_strings(pieces, least)
    heads = np.zeros(len(smallest), bool)
    heads[1:] = smallest[1:] != smallest[:-1]
    heads[tops - counts] = True
    begin = np.flatnonzero(heads)
    piece = np.searchsorted(tops, begin, side="right")
    end, value = np.append(begin[1:], len(smallest)) - (tops - counts)[piece], smallest[begin]
    many = np.bincount(piece, minlength=len(known))
    at = np.cumsum(many) - many
    return [(many[own], gathered(end, at[own], many[own]), gathered(value, at[own], many[own])) for own in numbers]


def _verdicts(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bundle, what is ``_judged`` of each parcel's runs, shard by shard."""
    sent = [_unpacked(packed, np.int32, np.int64, np.int32, np.uint8) for packed in group["packed"]]
    shards = [np.append(0, np.cumsum(counts)) for counts, _, _, _ in sent]
    ends = [np.append(0, np.cumsum(lengths, dtype=np.int64)) for _, _, lengths, _ in sent]
    told: list[list] = [[] for _ in sent]
    for k in range(len(sent[0][0])):
        runs_, docs = [], []
        for (_, least, _, raw), shard, end in zip(sent, shards, ends):
            cuts = end[shard[k] : shard[k + 1] + 1]
            own, cuts = raw[cuts[0] : cuts[-1]].tobytes(), (cuts - cuts[0]).tolist()
            runs_.append([own[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
            docs.append(least[shard[k] : shard[k + 1]])
        for row, verdict in zip(told, _judged(runs_, docs)):
            row.append(verdict)
    out = []
    for row in told:
        many, end, value = (np.concatenate(x) for x in zip(*row))
        out.append(_packed(many.astype(np.int32), end.astype(np.int32), value))
    return pd.DataFrame({"parcel": group["parcel"], "bundle": group["bundle"], "verdict": out})


def _cut(bits: int, span: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, answers, verdicts = (batch.column(c)[i].as_py() for c in range(3))
                yield _left(_Parcel(texts, answers, bits, span, shards), verdicts)

    return run


def _left(own: _Parcel, verdicts: list | None) -> pa.RecordBatch:
    """A parcel's documents without the strings that smaller documents have."""
    ids, sizes, data, ends = own.ids, own.sizes, own.data, np.cumsum(own.sizes)
    gone = np.zeros(len(data), bool)
    if verdicts:
        parts = [_unpacked(v["verdict"], np.int32, np.int32, np.int64) for v in sorted(verdicts, key=lambda v: v["bundle"])]
        many, end, least = (np.concatenate(x) for x in zip(*parts))
        many = many.astype(np.int64)
        at = np.cumsum(many) - many
        begin = np.append(0, end[:-1])
        begin[at] = 0
        n = many[own.number]
        stretch = np.repeat(at[own.number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lost = least[stretch] < np.repeat(own.owner, n)
        base, stretch = np.repeat(own.starts, n)[lost], stretch[lost]
        edges = np.bincount(base + begin[stretch], minlength=len(data) + 1) - np.bincount(base + end[stretch] + WIDTH - 1, minlength=len(data) + 1)
        gone = np.cumsum(edges[:-1]) > 0
    heads = gone & ~np.concatenate([[False], gone[:-1]])
    heads[(ends - sizes)[sizes > 0]] |= gone[(ends - sizes)[sizes > 0]]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.append(0, ends)])
    removed, spans = total(gone), total(heads)
    offsets = np.append(0, np.cumsum(sizes - removed)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(sizes), pa.array(removed), pa.array(spans),
         pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~gone]))])],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def removed_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", parcel_bytes: int = PARCEL_BYTES, heavy_places: int = HEAVY_PLACES, hot_places: int = HOT_PLACES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, as one binary).

    A byte goes where a WIDTH-byte string over it also starts in a document of smaller id. Null and empty texts keep
    nothing and lose nothing. A null id comes after every other. Rows repeated with one id never take from each other.
    Other columns are ignored; an empty table gives no rows. (Ids of both ends, -2**63 and 2**63 - 1, in one table leave no
    number for a null id and are refused.)"""
    spark = docs.sparkSession
    number = F.col(key).cast("long")
    total, held, low, top = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)), F.min(number), F.max(number)).first()
    # Null has the last number; where an id has it, all ids move down by one.
    moved = int(top == _NO_ID)
    if moved and low == -_NO_ID - 1:
        raise ValueError("ids of both ends of the range")
    doc = F.coalesce(number - moved, F.lit(_NO_ID))
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    owners, bits = max(shuffle_partitions(spark), -(-(held or 0) // OWNER_BYTES)), min(60, total.bit_length() + 18)
    span = exchange.span_of(bits, owners)
    sent = staged(rows.mapInArrow(_send(bits, span, parcel_bytes, heavy_places), _SENT), "parcels")
    blocks = sent.where("owner is not null").select("parcel", "owner", "block", "again", "heavy", "places")
    answers = staged(blocks.groupBy("owner").applyInPandas(_answers(hot_places), "parcel bigint, owner int, shared binary, hot binary, n bigint"), "answers")
    shards = max(shuffle_partitions(spark), -(-(answers.agg(F.sum("n")).first()[0] or 0) // SHARD_RUNS))
    bundles = max(-(-shards // BUNDLE), min(shards, BUNDLES))
    parts = -(-shards // bundles)
    told = answers.groupBy("parcel").agg(F.collect_list(F.struct("owner", "shared", "hot")).alias("answers"))
    parcels = sent.where("owner is null").select("parcel", "texts").join(told.hint("shuffle_hash"), "parcel", "left")
    found = parcels.select("parcel", "texts", "answers").mapInArrow(_distinct_runs(bits, span, shards, parts), _RUNS)
    verdicts = found.groupBy("bundle").applyInPandas(_verdicts, "parcel bigint, bundle int, verdict binary")
    verdicts = staged(verdicts.groupBy("parcel").agg(F.collect_list(F.struct("bundle", "verdict")).alias("verdicts")), "verdicts")
    cut = parcels.join(verdicts.hint("shuffle_hash"), "parcel", "left").select("texts", "answers", "verdicts").mapInArrow(
        _cut(bits, span, shards), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    return cut.withColumn("doc_id", F.col("doc_id") + moved) if moved else cut


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
