"""SentencePiece encoding, importance resampling and alignment of tokenizers."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barlab.llm import importance, piece_bpe, token_alignment as alignment

P = pytest.importorskip("public_tokenizers")
PIECES = "piece_bpe_32k.model"
ODD = [
    None, "", " ", "  ", "▁", "a▁b", "▁ x", "\0", "a\0b", "<s> </s> <unk> <0x41>", "ﬁ ⑨ é", " " * 100, "=" * 70, "x" * 700, "\U0001f916漢字",
    "12345 67,8", "\n\t\r\n  a", "Здрав <|endoftext|>", "it's we'll 'S", "a" * 40 + " " * 40 + "b",
]


def texts(rng, n):
    parts = ["ing", "the", "er", "é", "漢", "\U0001f916", " ", "  ", "\n", "1", "23", "<s>", "!!", "=", "-", "Зд", "Q", "zq", "▁", "²."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path(PIECES))


def test_pieces_equal_the_library(documents, library, monkeypatch):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD + texts(rng, 400) + ["".join(rng.choice("abcdefghijklmnop") for _ in range(900))] * 2)] + [(None, "x y"), (5, "twice")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_bpe.digests(documents(rows), P.path(PIECES)).collect()), key=str) == sorted(want, key=str)
    assert piece_bpe.digests(documents(rows).limit(0), P.path(PIECES)).count() == 0
    monkeypatch.setattr(piece_bpe, "STEP_CHARS", 7)
    model = piece_bpe.PieceEncoder(P.path(PIECES))
    for t in texts(rng, 300):
        assert np.frombuffer(model.encode(t), "<i4").tolist() == library.encode(t)
        model.words = None
        assert np.frombuffer(model.encode(t), "<i4").tolist() == library.encode(t)


def test_piece_columns_round_trip(documents, library):
    rows = [(i, t) for i, t in enumerate(ODD)]
    encoded = piece_bpe.encode_documents(documents(rows), P.path(PIECES), ends=False)
    assert {r.doc_id: r.piece_ids for r in encoded.collect()} == {i: library.encode(t or "") for i, t in rows}
    assert {r.doc_id: r.decoded for r in piece_bpe.decode_documents(encoded, P.path(PIECES)).collect()} == {i: library.decode(library.encode(t or "")) for i, t in rows}


def test_any_ids_decode_as_the_library_does(library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(3, 259), rng.randrange(32000), 1, 2]) for _ in range(rng.randrange(9))]
        assert piece_bpe.decode(np.array(ids, np.int64), P.path(PIECES)) == library.decode(ids), ids


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(rows, target, percent):
    """Importance resampling as it is defined, one document at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in grams(t)[1])
    g = Counter(bucket(f) for t in target for f in grams(t)[1])
    s_all, g_all = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (g_all + 10000))))
    out = []
    for i, t in rows:
        words, found = grams(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("percent, ranges, step, samples", [(5, None, 200_000, 1 << 20), (60, 7, 3, 20), (100, 1, 1, 1 << 20), (0, 3, 200_000, 1)])
def test_importance_against_its_definition(documents, monkeypatch, percent, ranges, step, samples):
    rng = random.Random(8)
    monkeypatch.setattr(importance, "STEP_WORDS", step)
    monkeypatch.setattr(importance, "SAMPLES", samples)
    vocabulary = [f"W{i}" for i in range(60)] + ["café", "a-b", "_x_"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 19, 20, 40, 90])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "..."), (None, "w1 " * 30), (-5, "w2 " * 25), (2**63 - 1, "w2 " * 25), (3, rows[3][1])] + [(2000 + i, "copy of one text " * 8) for i in range(60)]
    target = [" ".join(rng.choice(vocabulary[:9]) for _ in range(30)) for _ in range(10)] + [None]
    got = importance.resampled(documents(rows), documents(list(enumerate(target))), percent, ranges=ranges)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(drawn(rows, target, percent), key=key)


def test_importance_of_empty_tables(documents):
    some = documents([(1, "a b"), (2, None)])
    assert importance.resampled(some.limit(0), some).count() == 0
    assert {r.doc_id: r.rank for r in importance.resampled(some, some.limit(0)).collect()} == {1: None, 2: None}


PATHS = P.path("byte_bpe_50k.json"), P.path(PIECES)


def aligned(rows, library):
    """Alignments and scores as they are defined, one document at a time, from the two libraries."""
    import json

    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    spelled = {i: bytes(byte_of[c] for c in t) for t, i in json.load(open(PATHS[0]))["model"]["vocab"].items()}
    found, documents = [], Counter()
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text or "")
        of_b = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
        sizes = [len(spelled[i]) for i in a], [len(of_b(i)) for i in b]
        if not text or b"".join(map(of_b, b)) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        ends = np.cumsum(sizes[0]).tolist(), np.cumsum(sizes[1]).tolist()
        groups, links, i, j = [([], [])], [], 0, 0
        while i < len(a) or j < len(b):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                groups[-1][0].append(a[i])
                i += 1
            if y <= x:
                groups[-1][1].append(b[j])
                j += 1
            if x == y:
                groups.append(([], []))
        found.append((a, b, groups[:-1], links))
        documents.update(set(links))
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(documents[p] == best[p[0]] for p in links), sum(documents[p] for p in links), digest))
    return out


@pytest.mark.parametrize("size, fan, parcel", [(1 << 15, 16, 2_000_000), (40, 2, 5), (7, 3, 100), (1, 16, 1)])
def test_alignment_against_its_definition(documents, library, monkeypatch, size, fan, parcel):
    rng = random.Random(6)
    for name, value in (("RANGE_CHARS", size), ("FAN", fan), ("PARCEL_PAIRS", parcel)):
        monkeypatch.setattr(alignment, name, value)
    words = ["the", "café", "thinking", "О", "word", "3,5", "\n", "  x", "it's", "🤖", "漢字"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(25 if size > 1 else 6)]
    rows = list(enumerate(ODD + some + ["the same text " * 6] * 5)) + [(None, "no id here"), (3, some[0])]
    got = alignment.link_scores(documents(rows), *PATHS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(aligned(rows, library), key=str)


def test_alignment_of_an_empty_table(documents):
    assert alignment.link_scores(documents([]), *PATHS).count() == 0


def test_fragments_compose_in_any_tree(library):
    rng, both = random.Random(9), alignment.tokenizers(*PATHS)
    for text in texts(rng, 60) + ["some plain words " * 20]:
        a, b, same = both.encode(" " + text)
        if not same:
            continue
        tokens = (a, np.cumsum(both.a_bytes[a]), b, np.cumsum(both.b_bytes[b]))
        want = alignment.closed(both, tokens, 0)
        size = int(tokens[1][-1])
        cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(rng.randrange(8)))})
        parts = [alignment.fragment(both, alignment._part(tokens, x, y)) for x, y in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.composed(both, parts[k : k + 2])]
        got = alignment.whole(both, parts[0])
        assert (b"".join(got.body), got.groups, got.links, got.n_a, got.n_b) == (b"".join(want.body), want.groups, want.links, want.n_a, want.n_b)
        assert got.codes.tolist() == want.codes.tolist() and got.times.tolist() == want.times.tolist()
