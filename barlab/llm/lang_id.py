"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes holds counts, frozen after training. A byte costs the
code length its longest known context gives it; where the context never saw the byte, an escape is paid and the next
shorter context is asked, down to a uniform byte. The language with the shortest code for the whole text wins.

The tree is kept as one hash table per string length, from the last bytes to the full code length in every language
(escapes included) and to the escape cost of the string as a context, so scoring is a few table lookups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import byte_slices, given_back, table

#: Longest context, in bytes.
ORDER = 4
#: Bound of the training sample: about so many bytes of text a language, whole documents picked by a hash of the id.
SAMPLE_BYTES = 600_000
#: The score weighs the evidence of so many bytes of text, at the text's own rate.
SCORE_BYTES = 50

LETTER = regex.compile(r"\p{L}")
#: Bytes of text scored at once.
_CHUNK = 1 << 18


def grams(data: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with at least ``n`` bytes of their own text up to them, and those bytes as one integer."""
    at = np.flatnonzero(place >= n - 1)
    packed = np.zeros(len(at), np.uint64)
    for back in range(n - 1, -1, -1):
        packed = (packed << np.uint64(8)) | data[at - back]
    return at, packed


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes end to end, each one's place in its text, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for language in sorted(set(languages)):
            data, place, _ = laid_out([t.encode() for t, l in zip(texts, languages) if l == language])
            for n in range(1, ORDER + 2):
                found, counts = np.unique(grams(data, place, n)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([language] * len(found)), "n": pa.array(np.full(len(found), n, np.int32)),
                    "gram": pa.array(found.astype(np.int64)), "times": pa.array(counts.astype(np.int64)),
                })


def gram_counts(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``labelled``: doc_id, lang, text. Counts of byte strings by language over a sample: lang, n, gram, times."""
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.lit(float(sample_bytes)) / F.col("bytes")
    sample = labelled.join(F.broadcast(sizes.where("bytes > 0")), "lang").where(drawn).select("lang", "text")
    return sample.mapInArrow(_count, "lang string, n int, gram bigint, times bigint").groupBy("lang", "n", "gram").agg(
        F.sum("times").alias("times")
    )


class Table:
    """Open-addressing hash table from distinct integers to their index, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self.home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        at = self.home(keys)
        found = self.slots[at]
        if not len(self.keys):
            return found
        off = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            found[off] = self.slots[at[off]]
            off = off[(found[off] >= 0) & (self.keys[found[off]] != keys[off])]
        return found


class Model:
    """Code lengths in bits; ``counts`` has columns lang, n, gram, times."""

    def __init__(self, counts: pa.Table):
        self.languages = sorted(set(counts["lang"].to_pylist()))
        index = {l: i for i, l in enumerate(self.languages)}
        lang = np.array([index[l] for l in counts["lang"].to_pylist()], np.int64)
        n, gram, times = (counts[c].to_numpy() for c in ("n", "gram", "times"))
        self.tables, self.costs, self.escapes = [], [], []
        many = len(self.languages)
        for length in range(1, ORDER + 2):
            own = n == length
            keys = np.unique(gram[own]).astype(np.uint64)
            seen = np.zeros((len(keys), many), np.int64)
            seen[np.searchsorted(keys, gram[own].astype(np.uint64)), lang[own]] = times[own]
            contexts, context_of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), many)), np.zeros((len(contexts), many))
            np.add.at(total, context_of, seen)
            np.add.at(kinds, context_of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(seen / (total + kinds)[context_of])
            if length == 1:
                lower = np.full((len(keys), many), 8.0)
            else:
                lower = self.costs[-1][self.tables[-1].find(keys & np.uint64((1 << 8 * (length - 1)) - 1))]
            self.costs.append(np.where(seen > 0, known, escape[context_of] + lower).astype(np.float32))
            # Escape cost of each string one shorter, as a context of this length's last byte.
            if length == 1:
                self.root = escape[0] if len(escape) else np.zeros(many)
            else:
                aligned = np.zeros((len(self.tables[-1].keys), many), np.float32)
                aligned[self.tables[-1].find(contexts)] = escape
                self.escapes.append(aligned)
            self.tables.append(Table(keys))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _CHUNK:
                out.append(self._code_lengths(group))
                group, size = [], 0
        if group:
            out.append(self._code_lengths(group))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def _code_lengths(self, texts: list[bytes]) -> np.ndarray:
        data, place, lengths = laid_out(texts)
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.arange(len(data))
        window = np.zeros(len(data), np.uint64)
        for back in range(min(ORDER, len(data) - 1) if len(data) else 0, -1, -1):
            window[back:] = (window[back:] << np.uint64(8)) | data[: len(data) - back]
        for n in range(ORDER + 1, 0, -1):
            fit = place[left] >= n - 1
            asked, short = left[fit], left[~fit]
            keys = window[asked] & np.uint64((1 << 8 * n) - 1)
            found = self.tables[n - 1].find(keys)
            hit = found >= 0
            bits[asked[hit]] += self.costs[n - 1][found[hit]]
            missed = asked[~hit]
            if n > 1:
                context = self.tables[n - 2].find(keys[~hit] >> np.uint64(8))
                known = context >= 0
                bits[missed[known]] += self.escapes[n - 2][context[known]]
            else:
                bits[missed] += self.root + 8.0
            left = np.concatenate([short, missed])
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(lengths)
        if len(full):
            sums[full] = np.add.reduceat(bits.astype(np.float64), (np.cumsum(lengths) - lengths)[full], axis=0)
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        encoded = [(t or "").encode() for t in texts]
        bits = self.code_lengths(encoded)
        languages, scores = [], []
        for text, raw, own in zip(texts, encoded, bits):
            if not text or not self.languages or not LETTER.search(text):
                languages.append("und")
                scores.append(0.0)
                continue
            best = int(own.argmin())
            languages.append(self.languages[best])
            scores.append(float(1 / np.exp2((own[best] - own) * min(1.0, SCORE_BYTES / len(raw))).sum()))
        return languages, scores


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame) -> Model:
    """From rows with a text and a language that aren't held out; a null id is not held out."""
    labelled = docs.where("text is not null and lang is not null").where(~F.coalesce(held_out(), F.lit(False)))
    return Model(gram_counts(labelled.select("doc_id", "lang", "text")).toArrow())


def identified(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score of every row's whole text, and of its columns those in ``keep`` (all, if
    None; columns of the new names are replaced). ``und`` with score 0 where the text is null or has no letter, or
    nothing could be learned. Equal texts get equal answers; ties go to the first language by code point."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, whole.schema.get_field_index(text), 4 * _CHUNK):
                languages, scores = shared.value.predict(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
                )

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def language(model: Model, spark: SparkSession, text: Column) -> Column:
    """The predicted language of a text, for use in a filter: the text alone goes to Python, and nothing else comes back."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [shared.value.predict(texts.iloc[i : i + 200].tolist())[0] for i in range(0, len(texts), 200)]
            yield pd.Series([x for part in out for x in part], dtype=object)
            del texts, out
        given_back()

    return predict(text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identified(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
