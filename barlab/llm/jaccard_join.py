"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so with the distances of documents to a pivot the triangle inequality tells which pairs
can't be close. Unrelated shingle sets all lie at distance 1 from each other, where no pivot tells anything, so the
space is first cut by anchors: each set's shingles are dealt into parts by hash, and two sets that are close enough
agree in whole parts (there are more parts than differing shingles). Each anchor shared by two sets is a cell. A few
anchors of each set come first: there every document meets the cell's pivot alone, which connects most copies for one
comparison each. Of all anchors only cells that hold several components remain, and their smallest document is their
pivot. Inside a cell the distance to the pivot, computed exactly, makes the Voronoi region around it (up to twice
the threshold) and the rest, with the documents between one and two thresholds in both; so any two linked documents
stay together. Regions divide again around new pivots as long as that parts them; small ones are compared pair by pair.
Ones whose documents all lie at the same distance from everything, which no pivot can part, are put together where they
hold mostly the same documents, and blocks of documents meet with their sets: those of other components meet all, those of
the largest only these. A pair that its sketches can't part is compared there and then, and connects what it joins, so
that a block gives out the links that connect its components and never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange
from .common import byte_slices, given_back, shuffle_partitions, staged, table
from .components import contracted

WIDTH = 5
#: Documents of a cell up to which all pairs are compared.
LEAF = 8
#: Regions are divided while that takes away this part of their rows or more; documents in one block of what is left, and
#: their shingles together, about.
PROGRESS, BLOCK, BLOCK_SHINGLES = 0.5, 512, 2_000_000
#: Anchors of a set that are looked at first.
HEADS = 4
#: Documents per owner of the anchor exchange, about.
PER_OWNER = 40_000

#: Documents up to which their ids are broadcast (8 bytes each) to pick their texts or sets; beyond, both sides shuffle.
BROADCAST_ROWS = 500_000

#: Words whose hashes a task remembers.
REMEMBERED = 250_000

#: Buckets of a sketch; bytes of text whose shingles are made at once.
_BUCKETS, _STEP_BYTES = 256, 4 << 20

_SALTS = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    def __init__(self):
        self.known = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the five-word shingles (of all words, if fewer) after lower-casing A-Z."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WIDTH + 1)
        total = np.full(n, min(len(h), WIDTH), np.uint64)
        for i in range(min(len(h), WIDTH)):
            total += mix(h[i : i + n] * _ODD[i] + _U(i))
        return np.unique(mix(total))


def class_top(level: int) -> int:
    """Largest size in a class."""
    return int(2 ** ((level + 1) / 2) + 1e-9) if level else 1


def size_class(n: int) -> int:
    level = max(0, int(2 * np.log2(n)) - 1)
    while class_top(level) < n:
        level += 1
    while level and class_top(level - 1) >= n:
        level -= 1
    return level


def anchors(shingles: np.ndarray) -> np.ndarray:
    """Hashes of parts of the set such that any set with similarity of at least 0.8 has one of them in common.

    Sets of n and m shingles that similar differ in at most (n + m) // 9. Sizes fall into classes, each half an octave
    wide, and a set whose partners may be in the next class is cut up for that one as well. Of the parts that aren't
    empty, in one order for all, one more than may differ suffice; large parts come first, for they say most. A set
    with too few parts is cut up again with another salt."""
    n, out = len(shingles), []
    own = size_class(n)
    for level in (own, own + 1):
        top = class_top(level)
        if level > own and 5 * n // 4 <= class_top(own):
            break
        differ = (n + min(5 * n // 4, top)) // 9
        parts = -(-27 * top // 100) + 3
        for salt in range(_SALTS):
            tag = _U((level * 131 + salt + 1) * int(_ODD[1]) % (1 << 64))
            part = (mix(shingles + tag) >> _U(33)) % _U(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = mix(np.add.reduceat(mix(shingles[order] ^ tag), starts) + part[starts] * _ODD[2] + tag)
            held = np.diff(np.append(starts, n))
            out.append(sums[np.lexsort((sums, -held))[: differ + 1]])
            if len(starts) > differ:
                break
        else:
            out.append(mix(np.array([level], np.uint64) * _ODD[3]))
    return np.unique(np.concatenate(out))


_FIRST = (
    "doc_id bigint, n_shingles bigint, set_hash binary, heads array<bigint>, sender int, owner int, block binary, counts array<int>, ids array<bigint>"
)


def _arrow(**columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    kinds = dict(
        doc_id=pa.int64(), n_shingles=pa.int64(), set_hash=pa.binary(), heads=pa.list_(pa.int64()), sender=pa.int32(), owner=pa.int32(), block=pa.binary(),
        counts=pa.list_(pa.int32()), ids=pa.list_(pa.int64()),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()], names=list(kinds)
    )


def _first_pass(bits: int, span: int):
    """Rows of documents (their set's size, hash and first anchors), then rows of anchor blocks, one for each owner;
    within a partition equal sets send their anchors once, under their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, slot_of, keys, least = Shingler(), {}, [], []
        for whole in batches:
            for batch in byte_slices(whole, 1, _STEP_BYTES):
                sizes, hashes, heads = [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = shingle(text)
                    digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                    sizes.append(len(own))
                    hashes.append(digest)
                    if digest and key is not None:
                        slot = slot_of.setdefault(digest, len(keys))
                        if slot == len(keys):
                            keys.append(anchors(own) >> _U(64 - bits))
                            least.append(key)
                        least[slot] = min(least[slot], key)
                        heads.append(keys[slot][:HEADS].astype(np.int64))
                    else:
                        heads.append(None)
                yield _arrow(doc_id=batch.column(0), n_shingles=sizes, set_hash=hashes, heads=heads)
        if not keys:
            return
        key, id_ = np.concatenate(keys), np.repeat(np.array(least, np.int64), [len(k) for k in keys])
        order = np.lexsort((id_, key))
        key, id_ = key[order], id_[order]
        distinct, counts = np.unique(key, return_counts=True)
        ends = np.cumsum(counts)
        sender = TaskContext.get().partitionId()
        for owner, a, b in exchange.by_owner(distinct, span):
            yield _arrow(
                sender=[sender], owner=[owner], block=[exchange.coded(distinct[a:b], owner, span)],
                counts=[counts[a:b].astype(np.int32)], ids=[id_[ends[a] - counts[a] : ends[b - 1]]],
            )
        del keys, least, slot_of, key, id_, order, shingle
        given_back()

    return run


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of one owner, a bitmap of the anchors that several documents hold."""
    totals = exchange.sums_over_blocks(list(blocks["block"]), [np.asarray(c, np.float64) for c in blocks["counts"]])
    return pd.DataFrame({"sender": blocks["sender"], "owner": blocks["owner"], "bitmap": [exchange.bitmap(t > 1) for t in totals]})


def _shared_anchors(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, block, counts, ids, bitmap in zip(*(batch[c] for c in ("owner", "block", "counts", "ids", "bitmap"))):
                counts = np.asarray(counts)
                many = np.repeat(exchange.flags(bitmap, len(counts)), counts)
                cells = exchange.decoded(block, owner, span).view(np.int64)
                yield pd.DataFrame({"cell": np.repeat(cells, counts)[many], "x": np.asarray(ids)[many]})

    return run




def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles, and how many fall into each bucket of their hash."""
    shingle = Shingler()
    for whole in batches:
        for batch in byte_slices(whole, 1, _STEP_BYTES):
            lists = [shingle(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            sketches = [np.bincount((x >> _U(56)).astype(np.int64), minlength=_BUCKETS).astype("<u4").tobytes() for x in lists]
            values = pa.array(np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], ["x", "sketch", "shingles"]
            )
    del shingle
    given_back()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sketches tell of pairs: no more shingles are shared than the smaller counts of all buckets together, so
    far (surely beyond twice the threshold) and open (possibly linked, and not yet connected)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, _BUCKETS).astype(np.int64) for c in (3, 4))
            same = batch.column(2).to_numpy(zero_copy_only=False)
            most, both = np.minimum(a, b).sum(axis=1), (a + b).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(10 * most < 6 * (both - most)), pa.array((10 * most >= 8 * (both - most)) & ~same)],
                ["p", "x", "far", "open"],
            )


def _picked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` is among the distinct ``ids`` (x)."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = ids.select(F.col("x").alias(key))
    return rows.join(F.broadcast(named) if few else named, key, "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("x").unionByName(pairs.select(F.col("p").alias("x"))).distinct()


def _compared(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """``pairs``: p, x, same (already connected), distinct. Adds near (linked, exactly; false where it needn't be known)
    and far (surely beyond twice the threshold). Pairs that their sketches can't part are compared shingle by shingle,
    but for those already connected."""
    of = lambda name, column, rows: rows.select(F.col("x").alias(name), F.col(column).alias(f"{name}_{column}"))
    sketched = pairs.join(of("x", "sketch", sets), "x").join(of("p", "sketch", sets), "p").select("p", "x", "same", "p_sketch", "x_sketch")
    told = staged(sketched.mapInArrow(_bounded, "p bigint, x bigint, far boolean, open boolean"), f"{label}-told")
    open_ = told.where("open").select("p", "x")
    wanted = staged(_ends(open_), f"{label}-ends")
    wanted_sets = _picked(sets, "x", wanted)
    shared = F.size(F.array_intersect("p_shingles", "x_shingles"))
    whole = open_.join(of("x", "shingles", wanted_sets), "x").join(of("p", "shingles", wanted_sets), "p").select(
        "p", "x", shared.alias("shared"), (F.size("p_shingles") + F.size("x_shingles") - shared).alias("whole")
    )
    exact = whole.select(
        "p", "x", (100 * F.col("shared") >= 80 * F.col("whole")).alias("near"), (10 * F.col("shared") < 6 * F.col("whole")).alias("far"),
    )
    return exact.unionByName(told.where("not open").select("p", "x", F.lit(False).alias("near"), "far"))


def linked_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", heads: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links of at least
    0.8 similarity, its own included).

    Null and empty texts have no shingles and are linked with nothing. Equal sets are linked. A null id can't be
    reached: such rows are components of their own with a null id. Rows repeated with one id are one document; if their
    texts differ, each text's links are the document's. Other columns are ignored. An empty table gives no rows. Without
    ``heads`` all anchors are looked at at once."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.select("doc_id").count()
    owners = max(shuffle_partitions(spark), -(-total // PER_OWNER))
    bits = min(60, total.bit_length() + 18)
    span = exchange.span_of(bits, owners)
    first = staged(rows.mapInArrow(_first_pass(bits, span), _FIRST), "anchors")
    sent = first.where("owner is not null").select("sender", "owner", "block", "counts", "ids")
    known = first.where("owner is null").select("doc_id", "n_shingles", "set_hash", "heads")
    groups = known.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "heads")).alias("r"))
    groups = staged(groups.select("set_hash", F.col("r.doc_id").alias("rep"), "r.heads"), "groups")
    join = _Join(lambda ids: staged(_picked(rows, "doc_id", ids).mapInArrow(_sets, "x bigint, sketch binary, shingles array<bigint>"), "sets"))
    # A document of several texts holds them together from the start.
    told = known.where("set_hash is not null and doc_id is not null")
    several = told.groupBy("doc_id").agg(F.min("set_hash").alias("one"), F.max("set_hash").alias("other")).where("one < other").select("doc_id")
    if not several.isEmpty():
        named = told.join(several, "doc_id", "left_semi").join(groups.select("set_hash", "rep"), "set_hash")
        least = named.groupBy("doc_id").agg(F.min("rep").alias("a"))
        join.link(staged(named.join(least, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")), "own-links"), "own")
    if heads:
        join.meet_pivots(groups.select(F.explode("heads").alias("cell"), F.col("rep").alias("x")))
    answers = sent.select("sender", "owner", "block", "counts").groupBy("owner").applyInPandas(_answer, "sender int, owner int, bitmap binary")
    cells = sent.join(answers, ["sender", "owner"]).select("owner", "block", "counts", "ids", "bitmap").mapInPandas(
        _shared_anchors(span), "cell bigint, x bigint"
    )
    join.divide(cells, groups.select(F.col("rep").alias("x")).distinct())
    out = known.join(groups.select("set_hash", "rep"), "set_hash", "left")
    if join.roots is not None:
        out = out.join(join.roots.withColumnRenamed("x", "rep"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id")
    )


class _Merged(dict):
    """Components while links are found: a forest over roots."""

    def __missing__(self, root: int) -> int:
        return root

    def of(self, root: int) -> int:
        while self[root] != root:
            self[root] = root = self[self[root]]
        return root


def _links(group: pd.DataFrame) -> pd.DataFrame:
    """Of one block pair: links that connect documents of different components, exactly, as few as connect them."""
    side = group["side"].to_numpy()
    left, right = group[side != 1], group[side != 0]
    sketches = np.stack([np.bincount(x.view(np.uint64) >> _U(56), minlength=_BUCKETS) for x in group["shingles"]]).astype(np.int32)
    a, b = sketches[side != 1], sketches[side != 0]
    sizes, found, merged = (a.sum(axis=1), b.sum(axis=1)), [], _Merged()
    order = np.argsort(sizes[1], kind="stable")
    b, size_b, right = b[order], sizes[1][order], right.iloc[order]
    x_b, root_b, set_b = right["x"].to_numpy(), right["root"].to_numpy(), right["shingles"].to_numpy()
    lo, hi = np.searchsorted(size_b, -(-4 * sizes[0] // 5)), np.searchsorted(size_b, 5 * sizes[0] // 4, side="right")
    for own, x, root, size, set_, i, j in zip(a, left["x"].to_numpy(), left["root"].to_numpy(), sizes[0], left["shingles"].to_numpy(), lo, hi):
        most = np.minimum(own, b[i:j]).sum(axis=1)
        near = np.flatnonzero((10 * most >= 8 * (size + size_b[i:j] - most)) & (root_b[i:j] != root) & (x_b[i:j] != x)) + i
        # The likeliest first: once two components are one, their other pairs needn't be compared.
        for k in near[np.argsort(-most[near - i], kind="stable")]:
            mine, other = merged.of(root), merged.of(root_b[k])
            if mine == other:
                continue
            shared = len(np.intersect1d(set_, set_b[k], assume_unique=True))
            if 100 * shared >= 80 * (size + size_b[k] - shared):
                merged[max(mine, other)] = min(mine, other)
                found.append((min(x, x_b[k]), max(x, x_b[k])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _of_different_documents(rows: DataFrame) -> DataFrame:
    """``rows``: cell, x. Cells, of those that hold the same documents one: its pairs are theirs."""
    held = lambda seed: F.sum(F.xxhash64("x", F.lit(seed)).cast("decimal(20,0)"))
    prints = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), held(1).alias("one"), held(2).alias("two"))
    return prints.groupBy("many", "one", "two").agg(F.min("cell").alias("cell")).select("cell")


def _put_together(active: DataFrame) -> DataFrame:
    """``active``: cell, x, root, n. A cell most of whose documents lie in a larger one goes there, so that documents which
    many cells of one group hold are dealt out once. Cells that others go to stay where they are, and grow to twice their
    documents at most: otherwise the others stay apart. Documents of one cell are together still."""
    top = F.max(F.struct("n", "cell")).over(Window.partitionBy("x"))
    rows = staged(active.select("cell", "x", "root", "n", top["cell"].alias("top")), "last-tops")
    votes = rows.groupBy("cell", "n", "top").agg(F.count(F.lit(1)).alias("votes")).groupBy("cell", "n").agg(F.max(F.struct("votes", "top")).alias("best"))
    hooks = staged(votes.where("best.top != cell and 2 * best.votes >= n").select("cell", F.col("best.top").alias("to")), "last-hooks")
    hooks = hooks.join(hooks.select(F.col("cell").alias("to")), "to", "left_anti")
    moved = staged(rows.join(hooks, "cell", "left").select("cell", "x", "root", "n", F.coalesce("to", "cell").alias("to")), "last-moved")
    own = F.max(F.when(F.col("to") == F.col("cell"), F.col("n")))
    wide = moved.select("to", "x").distinct().groupBy("to").agg(F.count(F.lit(1)).alias("all"))
    wide = wide.join(moved.groupBy("to").agg(own.alias("own")), "to").where("all > 2 * own").select("to", F.lit(True).alias("wide"))
    return moved.join(wide, "to", "left").select(F.when(F.col("wide"), F.col("cell")).otherwise(F.col("to")).alias("cell"), "x", "root").distinct()


def _remaining(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components of undivided cells. Sizes must lie within 5:4 of each other, so a cell
    falls into classes of that width, each against itself and the next. Large classes are compared block by block, but
    for blocks of their largest component with each other, which holds no open pair: its documents go to as many block
    pairs as the others fill blocks, and only the others to every block."""
    rows = active.select("cell", "x", "root").join(_of_different_documents(active), "cell", "left_semi").join(sets.select("x", F.size("shingles").alias("size")), "x")
    rows = staged(rows.select("cell", "x", "root", "size", F.floor(F.log("size") / float(np.log(1.25)) + 1e-9).alias("kind")), "last-rows")
    to = F.explode(F.array(F.struct(F.col("kind").alias("kind"), F.lit(0).alias("next")), F.struct((F.col("kind") - 1).alias("kind"), F.lit(1).alias("next"))))
    placed = rows.withColumn("to", to).select("cell", "x", "root", "size", "to.kind", "to.next")
    # A class is worth comparing where it has a member of its own and two components.
    held = placed.groupBy("cell", "kind", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), F.min("next").alias("own"))
    counts = held.groupBy("cell", "kind").agg(
        F.max(F.struct("n", "root", "sizes")).alias("main"), F.sum("n").alias("n"), F.sum("sizes").alias("sizes"), F.count(F.lit(1)).alias("roots"),
        F.min("own").alias("own"),
    ).where("roots > 1 and own = 0")
    blocks = lambda n, sizes: F.ceil(F.greatest(n / BLOCK, sizes / BLOCK_SHINGLES)).cast("int")
    counts = counts.select(
        "cell", "kind", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.sizes")).alias("mains"),
        blocks(F.col("n") - F.col("main.n"), F.col("sizes") - F.col("main.sizes")).alias("others"),
    )
    # Blocks of the largest component are numbered after those of the others.
    drawn, is_main = F.xxhash64("x"), F.col("root") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(drawn, F.col("mains"))).otherwise(F.pmod(drawn, F.col("others"))).cast("int")
    meets = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    blocked = placed.join(counts, ["cell", "kind"]).withColumns({"block": block, "meets": meets})
    pair = lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.when(j == F.col("block"), 2).when(F.col("block") < j, 0).otherwise(1).alias("side"))
    spread = blocked.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("meets") - 1), pair)))
    # Sets come last, as they are what weighs.
    dealt = staged(spread.select("cell", "kind", "to.i", "to.j", "to.side", "x", "root"), "last-blocks")
    groups = dealt.join(sets.select("x", "shingles"), "x").select("cell", "kind", "i", "j", "side", "x", "root", "shingles").groupBy("cell", "kind", "i", "j")
    return groups.applyInPandas(_links, "a bigint, b bigint")


class _Join:
    """Links found so far and the components they make: ``roots`` (x, root) of the documents with links."""

    def __init__(self, sets_of):
        self.sets_of, self.links, self.roots = sets_of, None, None

    def link(self, found: DataFrame, label: str) -> None:
        """``found``: a, b."""
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.roots = contracted(self.links, f"roots-{label}")

    def compare(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        compared = staged(_compared(pairs, sets, label), f"compared-{label}")
        self.link(compared.where("near").select(F.col("p").alias("a"), F.col("x").alias("b")), label)
        return compared

    def rooted(self, rows: DataFrame) -> DataFrame:
        """Adds the root of x."""
        if self.roots is None:
            return rows.withColumn("root", F.col("x"))
        return rows.join(self.roots, "x", "left").withColumn("root", F.coalesce("root", "x"))

    def meet_pivots(self, cells: DataFrame) -> None:
        """``cells``: cell, x. Compares every document with the smallest one of each of its cells."""
        pivots = cells.groupBy("cell").agg(F.min("x").alias("p"), F.max("x").alias("most")).where("p < most").select("cell", "p")
        pairs = staged(cells.join(pivots, "cell").where("x != p").select("p", "x", F.lit(False).alias("same")).distinct(), "head-pairs")
        if not pairs.isEmpty():
            self.compare(pairs, self.sets_of(staged(_ends(pairs), "head-ends")), "heads")

    def several(self, cells: DataFrame, label: str) -> DataFrame:
        """Rows of the cells that hold more than one component: cell, x, root, n, p (the pivot, their smallest document),
        p_root."""
        rows = staged(self.rooted(cells.select("cell", "x")), f"{label}-rooted")
        first = F.min(F.struct("x", "root")).alias("first")
        mixed = rows.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"), first).where("least < most")
        return rows.join(mixed.select("cell", "n", F.col("first.x").alias("p"), F.col("first.root").alias("p_root")), "cell")

    def divide(self, cells: DataFrame, reps: DataFrame) -> None:
        """``cells``: cell, x; ``reps``: the documents that stand for their sets. Divides cells around pivots until every
        linked pair is compared or connected."""
        active = staged(self.several(cells.join(reps, "x", "left_semi"), "all"), "active")
        depth, whole, before = 0, None, None
        while not active.isEmpty():
            ids = staged(active.select("x").distinct(), f"active-ids{depth}")
            whole = self.sets_of(ids) if whole is None else whole
            # Later rounds hold few of the documents: the sets of others needn't move.
            sets = _picked(whole, "x", ids) if depth else whole
            small, large = active.where(F.col("n") <= LEAF), active.where(F.col("n") > LEAF)
            n = large.count()
            if before is not None and n > (1 - PROGRESS) * before:
                self.link(staged(_remaining(_put_together(active), sets), "last-links"), "last")
                return
            before = n
            a = small.select("cell", F.col("x").alias("p"), F.col("root").alias("a_root"))
            b = small.select("cell", "x", F.col("root").alias("b_root"))
            pairs = a.join(b, "cell").where("p < x and a_root != b_root").select("p", "x", F.lit(False).alias("same"))
            stars = large.where("x != p").select("p", "x", (F.col("root") == F.col("p_root")).alias("same")).distinct()
            compared = self.compare(pairs.unionByName(stars.select("p", "x", "same")).groupBy("p", "x").agg(F.max("same").alias("same")), sets, f"{depth}")
            if not n:
                return
            # Cells of one pivot go on as one; the part in the name keeps what was divided apart.
            told = stars.select("p", "x").join(compared, ["p", "x"])
            named = lambda side: F.xxhash64("p", F.lit(f"{side}{depth}")).alias("cell")
            inner = told.where("not far").select(named("in"), "x")
            outer = told.where("not near").select(named("out"), "x")
            active = staged(self.several(inner.unionByName(outer), f"{depth}"), f"active{depth}")
            depth += 1


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))
