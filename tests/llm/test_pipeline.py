import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect_and_keep_columns(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(40)), f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " end"), (102, "12 34"), (103, None)]
    docs = documents(rows)
    columns = docs.columns
    gone, before = [], {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        gone.append(before - ids)
        before = ids
    assert gone[0] == {102, 103} and gone[1] == {0} and gone[2] == {101}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count() and last.where(F.col("n_tokens") == 0).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All rows of run() on a small table: which documents stay, how often, and their tokens."""
    import hashlib
    import re
    from collections import Counter

    from pyspark.sql import types as T
    from tokenizers import Tokenizer

    import public_tokenizers
    from barlab.llm import mixing

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(n))
    rows = [(i, text(rng.randrange(5, 60)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper(), "en", rows[i][3], 0) for i in range(5)]
    rows += [(200 + i, rows[20 + i][1] + " tail", "en", rows[20 + i][3], 0) for i in range(10)] + [(300, None, "en", "s0", 0), (301, "1 2 3", "en", "s0", 0)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("doc_id", "text", "lang", "source", "n_chars"), (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType()))])
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    kept = [r for r in rows if r[1] and re.search("[a-zA-Z]", r[1])]
    largest = {}
    for r in kept:
        largest[lower(r[1])] = max(largest.get(lower(r[1]), -1), r[0])
    kept = [r for r in kept if largest[lower(r[1])] == r[0]]

    def shingles(t):
        w = lower(t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {r[0]: shingles(r[1]) for r in kept}, {r[0]: r[0] for r in kept}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = [r for r in kept if root[r[0]] == r[0]]
    copies = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame(kept, schema)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept:
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids
        if copies[r[0]]:
            want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += copies[r[0]]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
