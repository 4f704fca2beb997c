import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import bpe, exact_dedup, exchange, golomb, html_extract, jaccard_join, lang_id, license_scan, line_quality, mixing, suffix_array, suffix_dedup, token_files

P = pytest.importorskip("public_tokenizers")
WORDS = [f"w{i}" for i in range(40)]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(rng):
    """Texts with copies, near copies, shared passages, empty and odd ones."""
    base = prose(rng, 120, [f"{a}{b}" for a in "abcdefgh" for b in WORDS])
    passage = prose(rng, 60, [f"p{w}" for w in WORDS])
    out = [base, base.upper(), base + " tail", base, "", None, "   \n ", "one two", "one two", "x" * 400, "x" * 300 + "é" * 90, "a\0b" * 40]
    for i in range(25):
        words = base.split()
        words[rng.randrange(120)] = f"new{i}"
        if i % 3 == 0:
            words[rng.randrange(120)] = f"more{i}"
        out.append(" ".join(words))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(8)]
    out += [prose(rng, n, [f"{a}{b}" for a in "klmnop" for b in WORDS]) for n in (1, 3, 4, 5, 6, 9, 2000)]
    return out


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        values = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (golomb.decode(golomb.encode(values, 1 << 40)) == values).all()


@pytest.mark.parametrize("setting", [{}, {"broadcast_prints": 9}, {"hot_part": 0.0}, {"hot_part": 1.0}])
def test_exact_duplicates(documents, monkeypatch, setting):
    plans, write = {}, exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, label: plans.setdefault(label, df) and write(df, label))
    rows = list(enumerate(corpus(random.Random(1)))) + [(None, "one two"), (None, "none like it"), (7, "one two"), (-(1 << 63), "two three"), (None, "two three")]
    rows += [(90, "z" * 100_000), (91, "Z" * 100_000)]
    groups = collections.defaultdict(list)
    lower = lambda t: (t or "").translate(str.maketrans(exact_dedup.ascii_lower.__globals__["UPPER"], exact_dedup.ascii_lower.__globals__["LOWER"]))
    for i, t in rows:
        groups[lower(t)].append(i)
    want = collections.Counter()
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_duplicates(documents(rows), **setting).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    # The scans that read texts move none; of files they read their own.
    scans = {label: df for label, df in plans.items() if label.startswith("told")}
    assert len(scans) > 1 if "broadcast_prints" in setting else len(scans) == 1
    for df in scans.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and all("hashpartitioning(print" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    monkeypatch.undo()
    assert exact_dedup.exact_duplicates(documents([]), **setting).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("heads, leaf, progress, shuffled", [(True, 8, 0.2, False), (False, 1, 1.1, True), (False, 2, 0.05, False)])
def test_jaccard_components(documents, monkeypatch, heads, leaf, progress, shuffled):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "PROGRESS", progress)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    if shuffled:
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    compared, whole = [], jaccard_join._remaining
    monkeypatch.setattr(jaccard_join, "_remaining", lambda *a: compared.append(1) or whole(*a))
    rng = random.Random(2)
    rows = list(enumerate(corpus(rng)))
    chain = prose(rng, 150, [f"c{w}{v}" for w in WORDS for v in "xyz"]).split()
    for i in range(30):  # a chain whose ends are far apart
        chain = [*chain]
        chain[i * 5] = f"z{i}"
        rows.append((200 + i, " ".join(chain)))
    sets = shingle_sets(rows)
    want = {i: (len(sets[i]), c) for i, c in components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(documents(rows), heads=heads).collect()}
    assert got == want
    assert progress < 1 or compared


def test_jaccard_odd_rows(documents):
    assert jaccard_join.linked_documents(documents([])).count() == 0
    assert [tuple(r) for r in jaccard_join.linked_documents(documents([(None, "a b"), (3, "a b")])).orderBy("doc_id").collect()] == [(None, 1, None), (3, 1, 3)]
    rows = [(5, "a b c"), (5, "d e f"), (2, "A b c"), (3, "d e F"), (3, "d e F"), (7, "g " * 100_000), (8, "g " * 90_000), (9, None)]
    got = sorted(tuple(r) for r in jaccard_join.linked_documents(documents(rows)).collect())
    assert got == [(2, 1, 2), (3, 1, 2), (3, 1, 2), (5, 1, 2), (5, 1, 2), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_anchors_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard_join.anchors(a), jaccard_join.anchors(b)))


@pytest.mark.parametrize("digit", [2, 5, 512])
def test_suffix_array(monkeypatch, digit):
    monkeypatch.setattr(suffix_array, "ONE_DIGIT", digit)
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 9, 4000])) for _ in range(rng.randint(1, 70))] + [0]
        assert list(suffix_array.suffix_array(np.array(s))) == sorted(range(len(s)), key=lambda i: s[i:])


def test_cells_of_the_same_documents_are_compared_once(spark, monkeypatch):
    rng, dealt = random.Random(17), []
    monkeypatch.setattr(jaccard_join, "staged", lambda frame, label, f=jaccard_join.staged: dealt.append((label, f(frame, label))) or dealt[-1][1])
    base = [rng.randrange(-(2**63), 2**63) for _ in range(100)]
    shingles = {1: base, 2: base[:95], 3: base[:70] + [rng.randrange(2**63) for _ in range(30)], 4: base[5:], 5: base[:95]}
    cells = {10: [1, 2, 3], 11: [3, 2, 1], 12: [1, 4], 13: [4, 1], 14: [1, 2, 3, 5]}
    active = spark.createDataFrame([(c, x, x) for c, own in cells.items() for x in own], "cell long, x long, root long")
    sets = spark.createDataFrame([(x, None, sorted(own)) for x, own in shingles.items()], "x long, sketch binary, shingles array<long>")
    found = {(r.a, r.b) for r in jaccard_join._remaining(active, sets).collect()}
    whole = {(a, b) for a in shingles for b in shingles if a < b and 100 * len({*shingles[a]} & {*shingles[b]}) >= 80 * len({*shingles[a]} | {*shingles[b]})}
    assert found <= whole and not any(3 in pair for pair in found) and (1, 4) in found
    joined = {x: x for x in shingles}
    for _ in shingles:
        for a, b in found:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert joined == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}
    assert {r.cell for r in dict(dealt)["last-blocks"].select("cell").distinct().collect()} == {10, 12, 14}


def test_undivided_cells_deal_out_the_largest_component_once(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "staged", lambda frame, label, f=jaccard_join.staged: dealt.append((label, f(frame, label))) or dealt[-1][1])
    base = list(range(1, 101))
    shingles = {x: base[:99] + [1000 + x] for x in range(60)} | {60: base[:98] + [2000, 2001], 61: base[:50] + list(range(3000, 3050)), 62: base[:50] + list(range(3000, 3049)) + [4000]}
    active = spark.createDataFrame([(1, x, 0 if x < 60 else x) for x in shingles], "cell long, x long, root long")
    sets = spark.createDataFrame([(x, None, own) for x, own in shingles.items()], "x long, sketch binary, shingles array<long>")
    found = {(r.a, r.b) for r in jaccard_join._remaining(active, sets).collect()}
    assert (61, 62) in found and {b for a, b in found if a < 60} == {60}
    # 60 documents of the largest component meet one block; 3 others meet it and 15 blocks.
    assert dict(dealt)["last-blocks"].count() <= 60 + 3 * 16


def test_cells_of_mostly_the_same_documents_are_put_together(spark):
    cells = {1: range(0, 30), 2: range(10, 38), 3: range(15, 40), 4: range(29, 60), 5: [50, 51, 100, 101, 102], 6: [70, 71], 7: range(29, 50)}
    active = spark.createDataFrame([(c, x, x, len(own)) for c, own in cells.items() for x in own], "cell long, x long, root long, n long")
    got = {}
    for r in jaccard_join._put_together(active).collect():
        assert r.x == r.root and r.x not in got.setdefault(r.cell, set())
        got[r.cell].add(r.x)
    assert all(any({*own} <= held for held in got.values()) for own in cells.values())
    assert len(got) < len(cells) and sum(map(len, got.values())) < sum(map(len, cells.values()))
    assert all(len(held) <= 2 * len(cells[c]) for c, held in got.items())
    # Cells that would make the one they go to more than twice as large stay apart.
    wide = {1: range(10)} | {c: [2 * c - 4, 2 * c - 3, 100 + 2 * c, 101 + 2 * c] for c in range(2, 7)} | {7: [0, 5, 300, 301], 8: [1, 6, 310, 311]}
    active = spark.createDataFrame([(c, x, x, len(own)) for c, own in wide.items() for x in own], "cell long, x long, root long, n long")
    got = {(r.cell, r.x) for r in jaccard_join._put_together(active).collect()}
    assert got == {(c, x) for c, own in wide.items() for x in own}


def test_suffix_array_of_many_names():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(4000)]
    raw = b" ".join(words[i] for i in rng.integers(0, len(words), 20_000))
    order = suffix_array.suffix_array(np.append(np.frombuffer(raw, np.uint8).astype(np.int32) + 1, 0))[1:]
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert all(raw[a : a + 300] <= raw[b : b + 300] for a, b in zip(order.tolist(), order[1:].tolist()))


def test_permuted_prefixes():
    rng = random.Random(14)
    for _ in range(60):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 90)))
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        got = suffix_array.permuted_prefixes(np.frombuffer(raw, np.uint8), np.array(order), np.arange(len(raw), 0, -1))
        for a, b in zip(order, order[1:]):
            assert got[b] == next((k for k in range(len(raw) - max(a, b)) if raw[a + k] != raw[b + k]), len(raw) - max(a, b))


@pytest.mark.parametrize("setting", [{}, {"hot_places": 3, "heavy_places": 2}, {"parcel_bytes": 900}, {"parcel_bytes": 900, "hot_places": 1}])
def test_removed_repeats(documents, monkeypatch, setting):
    monkeypatch.setattr(suffix_dedup, "SHARD_RUNS", 40)
    rng = random.Random(5)
    rows = list(enumerate(corpus(rng))) + [(7, "one two"), (60, prose(rng, 30_000)), (61, "")]
    rows += [(70, rows[0][1] + "!"), (70, rows[0][1] + "!")]
    if setting:
        rows.append((2**63 - 1, rows[0][1] + "?"))
    seen, want = {}, collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen.setdefault(raw[k : k + 50], i) != i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(raw), sum(gone), spans, kept] += 1
    # A null id comes last: all it shares goes.
    want[None, len(rows[0][1]), len(rows[0][1]), 1, b""] += 1
    rows.append((None, rows[0][1]))
    got = collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.removed_repeats(documents(rows), **setting).collect())
    assert got == want
    assert suffix_dedup.removed_repeats(documents([])).count() == 0


def test_shards_of_removed_repeats_travel_in_bundles(documents, monkeypatch):
    rng = random.Random(15)
    rows = list(enumerate(corpus(rng)))
    show = lambda found: sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.collect())
    want, tables = show(suffix_dedup.removed_repeats(documents(rows))), {}
    for name, value in (("SHARD_RUNS", 2), ("BUNDLE", 16), ("BUNDLES", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup, "staged", lambda frame, label, f=suffix_dedup.staged: tables.setdefault(label, f(frame, label)))
    assert show(suffix_dedup.removed_repeats(documents(rows), parcel_bytes=900)) == want
    shards = tables["answers"].agg(F.sum("n")).first()[0] // 2
    sent = tables["verdicts"].agg(F.count(F.lit(1)), F.max(F.size("verdicts"))).first()
    assert shards > 200 and sent[0] > 3 and 1 < sent[1] <= max(3, -(-(shards + 1) // 16))


def test_anchors_are_dealt_evenly_to_owners(documents, monkeypatch):
    rng, tables = random.Random(17), {}
    rows = [(i, prose(rng, 3000)) for i in range(12)]
    monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", 4000)  # long texts make owners, however few they are
    monkeypatch.setattr(suffix_dedup, "staged", lambda frame, label, f=suffix_dedup.staged: tables.setdefault(label, f(frame, label)))
    suffix_dedup.removed_repeats(documents(rows)).count()
    sizes = collections.Counter()
    for owner, block in tables["parcels"].where("owner is not null").select("owner", "block").collect():
        sizes[owner] += exchange.size_of(bytes(block))
    owners = -(-sum(len(t.encode()) for _, t in rows) // 4000)
    assert owners > 4 and set(sizes) == set(range(owners)) and max(sizes.values()) < 2 * sum(sizes.values()) / owners


def test_smallest_of_strings_sorts_what_repeats(monkeypatch):
    rng, sorted_ = random.Random(16), []
    monkeypatch.setattr(suffix_dedup, "smallest_holders", lambda x, least, f=suffix_dedup.smallest_holders: sorted_.extend(x) or f(x, least))
    for letters in (b"a", b"ab", b"abcdefgh", b"abcdefgh"):
        base = bytes(rng.choice(letters) for _ in range(900))
        places = [(rng.randrange(840), rng.randrange(50, 114)) for _ in range(40)]
        pieces = list({base[a : a + n] for a, n in places if a + n <= 900} | {bytes(rng.choice(b"mnopqrs") for _ in range(70)) for _ in range(20)})
        least, want = np.array([rng.randrange(9) for _ in pieces]), {}
        for p, doc in zip(pieces, least.tolist()):
            for k in range(len(p) - 49):
                want[p[k : k + 50]] = min(want.get(p[k : k + 50], 9), doc)
        assert suffix_dedup.smallest_of_strings(pieces, least).tolist() == [want[p[k : k + 50]] for p in pieces for k in range(len(p) - 49)]
    assert sorted_ and not any(x[0] in b"mnopqrs" for x in sorted_)


def test_line_quality_rejects_what_boilerplate_leaves(documents):
    rng = random.Random(6)
    common = "Share This   page with your friends and read all of the other news here today"
    rows = [(i, f"{common}\n{prose(rng, 40, [f'{a}{w}' for a in 'abcdef' for w in WORDS])}") for i in range(40)]
    rows += [(100, common + "\nshort one"), (101, None), (102, "few words"), (103, "\n".join(["a b c d e f"] * 4))]
    got = {r.doc_id: r for r in line_quality.judged(documents(rows)).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 15 for i in range(40))
    assert not got[100].kept and not got[100].base_failed
    assert got[101].base_failed and got[101].n_words == 0 and got[102].base_failed
    assert got[103].n_dup_lines == 3 and got[103].n_repeat_words == 24 and got[103].base_failed
    assert line_quality.judged(documents([])).count() == 0


def test_line_limit_does_not_grow_with_the_source(documents):
    rng = random.Random(16)
    footer = "Share this page with your friends and read all of the other news here today"
    text = lambda: prose(rng, 40, [f"{a}{w}" for a in "abcdef" for w in WORDS])
    rows = [(i, f"{text()}\n{footer}" if i < 40 else text(), "large") for i in range(400)]
    rows += [(1000 + i, f"{text()}\n{footer}", "copies") for i in range(25)]
    copy = f"{text()}\nonly this text has this line"
    rows += [(2000 + i, copy, "copies") for i in range(200)] + [(3000, f"few words\n{footer}", "large")]
    for by_text in (True, False):
        got = {r.doc_id: r for r in line_quality.judged(documents(rows), by_text=by_text).collect()}
        assert all(got[i].n_removed_words == (15 if i < 40 else 0) and got[i].kept for i in range(400))
        assert all(got[1000 + i].n_removed_words == 15 for i in range(25))
        assert all((got[2000 + i].n_removed_words == 0) == got[2000 + i].kept == by_text for i in range(200))
        assert not got[3000].base_failed and not got[3000].kept


def test_lines_count_distinct_documents(documents):
    rng = random.Random(17)
    text = lambda: prose(rng, 40, [f"{a}{w}" for a in "abcdef" for w in WORDS])
    rows = [(i % 15, f"{text()}\nLine of\tfifteen  documents", None) for i in range(90)] + [(None, f"{text()}\nthe line of those without id", "n") for _ in range(21)]
    rows += [(50, "same words again\n" * 30, "n")] * 30 + [(60, "y" * 50_000, "n")]
    got = collections.Counter((r.doc_id, r.n_removed_words, r.kept) for r in line_quality.judged(documents(rows)).collect())
    assert got[None, 6, True] == 21 and got[50, 0, False] == 30 and got[60, 0, False] == 1
    assert all(n == 0 for i, n, _ in got if i is not None and i < 15)


def test_license_automaton_against_search():
    rng, scan = random.Random(7), license_scan.Scanner()
    split = [license_scan.words_of(t) for _, t in license_scan.TEMPLATES]
    places = lambda run: [(t, i + len(run) - 1) for t, w in enumerate(split) for i in range(len(w) - len(run) + 1) if w[i : i + len(run)] == run]
    for _ in range(40):
        words = []
        while len(words) < 30:
            t = rng.choice(split)
            a = rng.randrange(len(t))
            words += t[a : a + rng.randrange(1, 10)] if rng.random() < 0.6 else [b"zzz"]
        longest = [max(n for n in range(i + 2) if n == 0 or places(words[i - n + 1 : i + 1])) for i in range(len(words))]
        want = [(i, n) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(words) or longest[i + 1] != n + 1)]
        runs = scan.maximal_runs(words)
        assert [r[:2] for r in runs] == want
        assert all(scan.automaton.ends[s] == sorted(places(words[i - n + 1 : i + 1])) for i, n, s in runs)


def test_license_chains_against_every_chain():
    rng = random.Random(18)
    for _ in range(300):
        places, first = [], 0
        for _ in range(rng.randint(1, 9)):
            first += rng.randrange(4)
            last, size = first + rng.randint(2, 6), 0
            if places and last <= places[-1][0]:
                last = places[-1][0] + (rng.random() < 0.7)
            size = last - first + 1
            places += [(last, size, size - 1 + rng.randrange(12)) for _ in range(rng.randint(1, 2))]
        most = 0

        def follow(i, total):
            nonlocal most
            most = max(most, total)
            last, _, end = places[i]
            for k in range(i + 1, len(places)):
                to, size, stop = places[k]
                if last < to and end < stop and to - size <= last + license_scan.SKIP and stop - size <= end + license_scan.SKIP:
                    follow(k, total + min(size, to - last, stop - end))

        for i, (_, size, _) in enumerate(places):
            follow(i, size)
        got = license_scan.best_chains(places, 1)
        assert got[0][2] == most and all(a[1] < b[0] or a[0] > b[1] for n, a in enumerate(got) for b in got[n + 1 :])


def test_edited_licenses_are_found():
    rng, scan = random.Random(19), license_scan.scanner()
    for t, (label, text) in enumerate(license_scan.TEMPLATES):
        own = license_scan.words_of(text)
        for _ in range(12):
            words, at, k = list(own), rng.randrange(len(own)), rng.randrange(len(own))
            if len(own) > 30:  # four of its own words, and a word changed
                words[at:at] = own[k : k + 4]
                words[rng.randrange(len(words))] = b"qqq"
            lead = [b"x"] * rng.randrange(5)
            assert label in {s[0] for s in scan.spans(lead + words)}, (t, label)
    assert scan.spans([b"the", b"software", b"is", b"fine"] * 5000) == []


def test_whole_bodies_are_found_and_told_apart():
    """Each body, cut, edited or with another text around it, has its own label; what two of them share has one of theirs."""
    rng, scan = random.Random(20), license_scan.scanner()
    texts = license_scan.bodies()
    assert len(texts) == 9 and scan.automaton.length[0] == 0
    for label, text in texts:
        own = license_scan.words_of(text)
        for part in (own, own[: len(own) // 2], own[len(own) // 3 :]):
            words = list(part)
            for k in range(50, len(words), 60):
                words[k] = b"edited"
            found = [s for s in scan.spans([b"lead"] * 9 + words + [b"tail"] * 9) if s[4] > 600]
            assert {s[0] for s in found} == {label} and sum(s[3] for s in found) > 0.75 * len(part), label
    common = license_scan.words_of(prose(rng, 20_000, "the of and to in or by this license work any you may not for is that".split()))
    assert scan.spans(common) == []


def test_license_query_columns(spark, tmp_path):
    notice = license_scan.TEMPLATES[4][1]
    phrase = "the Mit-License. General PUBLIC license mit license2"
    rows = [(1, f"x {notice} y"), (2, phrase), (3, None), (4, ""), (2, phrase), (None, "apache license"), (5, "wörter " * 60_000 + "Released under the MIT License.")]
    spark.createDataFrame([(i, t, 9, "l") for i, t in rows], "doc_id bigint, text string, n_words int, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in license_scan.op5_license_scan(spark, str(tmp_path)).collect())
    want = collections.Counter()
    for i, t in rows:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        found = [(k, k + len(p.split()) - 1, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        base = {x[2] for x in found}
        extra, score = {1: ({"bsd"}, 1.0), 5: ({"mit"}, 1.0)}.get(i, (set(), 0.5 if found else 0.0))
        want[i, len(words), len(found), min((x[0] for x in found), default=None), max((x[0] for x in found), default=None), ",".join(sorted(base)), ",".join(sorted(base | extra)), score] += 1
    assert got == want
    assert license_scan.scanned(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_mix_comes_near_its_targets(documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), ["a", "b", None][min(2, i % 5)]) for i in range(600)] + [(900, None, "b"), (901, None, "empty")]
    out = mixing.mixed(documents(rows)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in mixing.mixed(documents(rows)).collect())
    sources = {r.source: (r.source_size, r.target) for r in out}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    for source, (size, target) in sources.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in out if r.source == source) - target) <= 60 + 0.01 * target
    assert max(r.copies for r in out) <= 3 and len(out) == len(rows)


def test_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(9)
    alphabet = [*"abcdeABCé'st  \n\t.,!?019", *map(chr, range(0x80, 0x180)), "　", "́", "😀", "中", "\x1c", "\xa0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>a", "aaaa" * 500, None, ""]
    want = {}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in bpe.digests(documents(list(enumerate(texts))), path).collect()}
    assert got == want


def test_token_files_equal_the_library(documents):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(10)
    alphabet = [*"abcdeABCé'st  \n\t.,!?019", "É.", "İ.", "́", "😀", "\x1c", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, ""]
    start, want = 0, {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, np.array(ids, "<u4").tobytes())
        start += len(ids)
    files = token_files.write_files(documents(list(enumerate(texts))), path, end_id=1)
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_files(*files).collect()}
    assert got == want
    assert token_files.read_files(*token_files.write_files(documents([]), path, end_id=1)).count() == 0


def test_stream_round_trip():
    rng = np.random.default_rng(11)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.decode_stream(*token_files.encode_stream(values), n) == values).all()


def ppm_bits(text, counts, order):
    """Code length of ``text`` from counts of its language, byte by byte."""
    bits = 0.0
    for i in range(len(text)):
        for n in range(min(order, i), -1, -1):
            context = text[i - n : i]
            seen = counts.get(context)
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= np.log2(seen[text[i]] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_language_models_against_a_context_tree(spark, documents):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30, ["le", "la", "été", "mer"] if i % 2 else ["the", "sea", "of", "was"]), "s", "fr" if i % 2 else "en") for i in range(80)]
    docs = documents(rows)
    model = lang_id.train(docs)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {"en": {}, "fr": {}}
    for i, text, _, lang in rows:
        raw = text.encode()
        if not held(i):
            for at in range(len(raw)):
                for n in range(min(lang_id.ORDER, at) + 1):
                    seen = counts[lang].setdefault(raw[at - n : at], {})
                    seen[raw[at]] = seen.get(raw[at], 0) + 1
    texts = ["the sea été of", "xyz", "la", "", "q"]
    got = model.code_lengths([t.encode() for t in texts])
    for own, text in zip(got, texts):
        assert own == pytest.approx([ppm_bits(text.encode(), counts[l], lang_id.ORDER) for l in model.languages], rel=1e-4, abs=1e-3)
    out = {r.doc_id: r for r in lang_id.identified(docs, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, _, lang in rows if held(i))
    odd = lang_id.identified(documents([(1, None), (2, "12 34"), (3, ""), (4, "é")]), model)
    assert {r.doc_id: r.lang_pred == "und" for r in odd.collect()} == {1: True, 2: True, 3: True, 4: False}
    assert lang_id.identified(documents([(1, "a")]), lang_id.train(documents([]))).first().lang_pred == "und"


def main_of(source):
    page = html_extract.Page(source)
    return [page.texts[i] for i in page.main()]


def test_html_blocks():
    article = '<article><section id="search-algorithms"><p>A</section><p class="social history">B</p><div class="share-price">C</div><noscript>D </noscript>&am<b>p;</b></article>'
    assert main_of(article) == ["A", "B", "C", "D &amp;"]
    assert main_of("<ul class=menu><li>x</ul><div class=text><p>a<p>b<br>c<table><tr><td>1<td>2<tr><td>3</table></div><p don't>q</p> 1 < 2 &lt; 3 <!-- c --> z") == [
        "a", "b c", "1", "2", "3", "q", "1 < 2 < 3 z"
    ]
    assert main_of("<article><h1>T</h1><p><b>x.<br><p>y</article><div class=comments><article class=comment>no</article></div>") == ["T", "x.", "y"]
    assert main_of('<p title="unclosed>one</p><p>two</p>') == ["one", "two"]
    assert main_of("<header>h</header><main><header><h1>Title</h1></header>a<aside>b</aside><form>c<input></form></main>d<footer>e</footer>") == ["Title", "a"]
    assert main_of("<script>if (a < b) '</p>'</script>x<style>y</style><textarea><p>z</textarea><svg><text>t</text></svg>") == ["x"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<div>a", "<i>", "<i><p>x</p>", "<li>x", '<a href="x>', "<!-- ", "</", "&"])
def test_html_is_read_in_linear_time(piece):
    took = []
    for size in (125_000, 500_000):
        began = time.process_time()
        html_extract.Page("<i>" * 20_000 + piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


@pytest.mark.parametrize("setting", [{"limit": 3}, {"limit": 3, "broadcast_rows": 0}])
def test_html_templates_against_a_count(spark, setting):
    rng = random.Random(13)
    boxes = [f"<div><p>Box {b} of the site</p><ul><li>one<li>two {b % 2}</ul></div>" for b in range(6)]
    quote, rows, parts = "<p>What several of them quote</p>", [], []
    for i in range(40):
        host, own = f"h{i % 2}.example", [rng.choice(boxes) for _ in range(rng.randrange(3))]
        body = [f"<p>Text {i // 2 * 2} </p>", *own, quote]  # two hosts with the same articles; every other page twice
        rows.append((i, f"https://{host}/{i}", "<nav><ul><li>m</ul></nav><article>" + "".join(body) + "</article>", 1, "clash"))
        parts.append((host, f"Text {i // 2 * 2}", own))
    rows += [(*rows[0][:2], rows[0][2] + "<div class=ad>other</div>", 2, "copy"), (90, None, None, 0, None), (91, "y", "", 0, None), (None, "z", "<p>n</p>" + "w " * 100_000, 0, None)]
    texts = lambda box: [f"Box {boxes.index(box)} of the site", "one", f"two {boxes.index(box) % 2}"]
    subtrees = lambda box: [("div", *texts(box)), ("ul", *texts(box)[1:])]
    held = collections.defaultdict(set)
    for host, text, own in parts:
        for box in own:
            for s in subtrees(box):
                held[host, s].add(html_extract.article_of([text, *(t for b in own for t in texts(b)), "What several of them quote"]))
    want = {}
    for (i, *_), (host, text, own) in zip(rows, parts):
        out = [text]
        for box in own:
            whole, inner = (len(held[host, s]) > 3 for s in subtrees(box))
            out += [] if whole else texts(box)[:1] if inner else texts(box)
        want[i] = "\n\n".join([*out, "What several of them quote"])
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, blocks int, host string").repartition(3)
    got = html_extract.extracted(frame, **setting).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.page_id] for r in got if r.page_id is not None and r.page_id < 40)
    assert {(r.page_id, r.url, r.text[:3]) for r in got if r.page_id is None or r.page_id >= 40} == {(90, None, ""), (91, "y", ""), (None, "z", "n\n\n")}
    assert html_extract.extracted(frame.limit(0), **setting).count() == 0


def sentences(n, tag="number"):
    return "".join(f"<p>This is {tag} {k} of the article, and it says something in a whole sentence.</p>" for k in range(n))


@pytest.mark.parametrize("source, more", [
    ("<body><main>{}</main><div><article><a href=1>Teaser card</a></article></div></body>", []),
    ("<main>{}<article><a href=1>Teaser card</a></article></main>", []),
    ("<article>{}<section id=navigation><h2>Navigation</h2><p>Birds find their way by the stars and by the field of the earth.</p></section></article>", ["Navigation", "Birds"]),
    ("<article>{}<section id=modal><p>Modal logic speaks of what may be and what has to be the case.</p></section></article>", ["Modal"]),
    ("<article>{}<div class=overlay><p>An overlay network lies above another network and hides its ways.</p></div></article>", ["An overlay"]),
    ("<body>{}<section id=discussion><h2>Discussion</h2>" + sentences(4, "claim") + "</section></body>", ["Discussion"] + ["This is claim"] * 4),
    ("<body>{}<section id=related><h2>Related work</h2>" + sentences(4, "claim") + "</section></body>", ["Related work"] + ["This is claim"] * 4),
    ("<body>{}<div class=related><ul><li><a href=1>This is the long title of another article that goes on and on here.</a></ul></div></body>", []),
    ("<article>{}<div class=comment-body><p>Nice article, thanks!</p></div></article>", []),
    ("<article>{}<div class=article-ad>Buy now</div><div class=promo-box><p>Get 20% off.</p></div></article>", []),
    ("<article>{}<p class=ad>Ad here</p><p class=cookie-notice>We use cookies.</p></article>", []),
    ("<article>{}<div class=navigation><a href=1>One</a> <a href=2>Two</a></div></article>", []),
    ("<main><h1>Title</h1><article>{}</article></main>", []),
])
def test_main_part_by_its_text(source, more):
    got = main_of(source.format(sentences(8)))
    assert [t for t in got if not t.startswith("This is number")] == [t for t in got if any(t.startswith(m) for m in more)] and len(got) == 8 + len(more)


def test_counts_alone_remove_what_sites_repeat(spark):
    """Boxes without a telling name or element, on hosts of any size; a table that edited copies of one article share stays."""
    rows, rng = [], random.Random(2)
    box = "<div class=x7><p>Call us today or visit the office in the old town.</p><ul><li>Mon to Fri<li>Sat</ul></div>"
    for i in range(30):
        own = "".join(f"<p>{prose(rng, 40)} {i}.</p>" for _ in range(3))
        rows.append((i, f"http://small{i // 6}.example/{i}", f"<body><h1>Page {i}</h1>{own}{box}</body>"))
    long = [f"<p>{prose(rng, 60)}</p>" for _ in range(40)]
    for i in range(8):
        edited = long[:i] + [f"<p>Edit {i}.</p>"] + long[i + 1 :]
        rows.append((100 + i, f"http://copies.example/{i}", "<body>" + "".join(edited) + "<table><tr><td>seven<td>eight</table></body>"))
    for i in range(100, 140):
        rows.append((200 + i, f"http://copies.example/o{i}", f"<body><p>{prose(rng, 50)} {i}</p></body>"))
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("office in the old town" not in got[i] and "Sat" not in got[i] and got[i].startswith(f"Page {i}") and got[i].count("\n\n") == 3 for i in range(30))
    assert all(got[100 + i].endswith("seven\n\neight") for i in range(8))


ODD = [(None, "one two three"), (None, None), (3, "one two three"), (3, "one two three"), (4, ""), (5, "word " * 40_000), (6, "é \u0000 \u2028 x")]


def test_mix_of_odd_rows(documents):
    out = mixing.mixed(documents([(*r, "s") for r in ODD])).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in ODD)
    assert sorted(r.size for r in out) == [0, 0, 3, 3, 3, 4, 40_000] and all(r.copies <= 3 for r in out)
    assert mixing.mixed(documents([])).count() == 0


def test_bpe_and_token_files_of_odd_rows(documents):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in bpe.digests(documents(ODD), path).collect())
    assert got == collections.Counter((i, len(tokenizer.encode(t or "").ids)) for i, t in ODD)
    assert bpe.digests(documents([]), path).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(documents(ODD), path), path).where("doc_id = 6").first()
    assert both.decoded == ODD[-1][1] and both.norm == "y"
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = token_files.read_files(*token_files.write_files(documents(ODD), path, end_id=1)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 3, 3, 4, 5, 6]
    sizes = {(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD}
    assert {(r.doc_id, len(r.ids) // 4) for r in rows} == sizes and all(b.start == a.start + len(a.ids) // 4 for a, b in zip(rows, rows[1:]))


def test_token_files_in_many_blocks(documents, monkeypatch):
    path, rows = P.path("word_bpe_49k.json"), [(i, f"alpha beta {i} gamma") for i in range(60)]
    whole = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_files(*token_files.write_files(documents(rows), path, end_id=1)).collect()}
    monkeypatch.setattr(token_files, "BROADCAST_ROWS", 0)
    blocks, ranks = token_files.write_files(documents(rows), path, end_id=1, block_ids=20)
    assert blocks.count() > 10
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_files(blocks, ranks).collect()} == whole


def test_language_of_odd_rows(spark, documents):
    rows = [(i, prose(random.Random(i), 20, ["le", "mer"] if i % 2 else ["the", "sea"]), "s", "fr" if i % 2 else "en") for i in range(40)]
    model = lang_id.train(documents([*rows, (None, "la mer", "s", "fr"), (7, "x", "s", None)]))
    got = collections.Counter((r.doc_id, r.lang_pred) for r in lang_id.identified(documents(ODD), model, keep=["doc_id"]).collect())
    assert got[3, "en"] == 2 and got[None, "und"] == 1 and got[4, "und"] == 1 and sum(got.values()) == len(ODD)
    kept = documents(ODD).where(lang_id.language(model, spark, F.col("text")) != "und")
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([None, 3, 3, 5, 6])


def test_ties_of_languages_go_to_the_first(spark, documents):
    """Two languages learned from the same texts cost every text the same."""
    learned = [(i, f"some words of a text number {i // 2}", "s", "bb" if i % 2 else "aa") for i in range(40)]
    model = lang_id.Model(lang_id.gram_counts(documents(learned).select("doc_id", "lang", "text")).toArrow())
    found = lang_id.identified(documents([(1, "some other words"), (2, "zzz")]), model).collect()
    assert {(r.lang_pred, round(r.score, 6)) for r in found} == {("aa", 0.5)}


def test_equal_lots_are_told_apart_by_id(documents, monkeypatch):
    monkeypatch.setattr(mixing, "_hash32", lambda _: F.lit(7).cast("long"))
    rows = [(i, "one two three", "ab"[i % 2]) for i in range(40)] + [(3, "one two three", "b")] * 2
    out = [sorted((r.doc_id, r.copies) for r in mixing.mixed(documents(rows)).collect()) for _ in range(2)]
    assert out[0] == out[1] and len(out[0]) == 42
