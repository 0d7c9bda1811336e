"""Search of vectors, vector codes and token alignment against brute-force versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import alignment, ball_tree, vector_codes
from quantloom.llm.vectors import integers, pack, unpack

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# vectors


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_packed_vectors():
    rows = [[0.5, -1.0, 0.0], None, [1.0, None], [float("nan")], [], [3e5, 2.0], [0.5, -1.0]]
    keep, values, lengths = integers(pa.array(rows, pa.list_(pa.float64())).slice(0, 7), 256)
    assert keep.tolist() == [True, False, False, False, True, True, True] and lengths.tolist() == [3, 0, 2, 2]
    codes = pack(values, lengths)
    assert codes[0] == codes[3] and unpack(codes, 3).tolist() == [[128, -256, 0], [0, 0, 0], [76800000, 512, 0], [128, -256, 0]]
    assert unpack(codes[:1] * 2, 2).tolist() == [[128, -256]] * 2


# 11


@pytest.mark.parametrize("spread", [1, 300, 10**7, 2**29])
def test_ball_tree_finds_the_best(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (3000, 6))
    q = rng.integers(-spread, spread + 1, (70, 6))
    tree = ball_tree.BallTree(x, leaf=16)
    scores = q.astype(object) @ x.T.astype(object)
    want = [sorted(range(len(x)), key=lambda j: (-s[j], j))[:4] for s in scores]
    who, score, row = tree.search(q, np.full(len(q), ball_tree.NO_SCORE), 4)
    assert row.reshape(-1, 4).tolist() == want and score.tolist() == [scores[i][j] for i, r in enumerate(want) for j in r]
    least = np.array([scores[i][r[1]] for i, r in enumerate(want)], "i8")  # known from elsewhere
    got = list(zip(*(c.tolist() for c in tree.search(q, least, 4)[::2])))
    assert all((i, j) in got for i, r in enumerate(want) for j in r if scores[i][j] >= least[i])


def test_ball_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(32, 8)) * 10_000
    x = np.repeat(centres, 500, 0).astype("i8") + rng.integers(-5, 6, (16000, 8))
    tree, seen = ball_tree.BallTree(x), []
    rows = tree.rows
    tree.rows = lambda kind: seen.append(kind) or rows(kind)
    tree.search(x[:10], np.full(10, ball_tree.NO_SCORE), 3)
    up = x[:10] @ tree.centres[-1].T + np.sqrt((x[:10] ** 2).sum(1))[:, None] * tree.radii[-1]
    best = np.sort(x[:10] @ x.T, 1)[:, -3]
    assert (up >= best[:, None]).mean() < 0.2


def brute_top(rows, every, k):
    """rows: (key, vector); repeated rows count each time."""
    cand = [(i, key, [math.floor(256 * x) for x in v]) for i, (key, v) in enumerate(rows) if whole(v)]
    out = []
    for i, key, q in cand:
        if key is not None and key % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for n, j, c in cand if n != i)
            out += [(key, r, j, -s) for r, (s, _, _, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def test_top_k_query_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.25, 1.0)) for _ in range(3)]) for i in range(300)]
    rows += [(50, [1.0, 1.0, 1.0])] * 3 + [(100, None), (150, [1.0, None, 0.0]), (200, [float("nan")] * 3), (250, []), (None, [1.0, 1.0, 1.0]), (350, [1.0]), (400, [0.0, 1.0, 1.0, 1.0])]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, shard int, code string")
    for values in (1 << 22, 1):
        got = ball_tree.top_k(df, df.filter("vec_id % 50 = 0"), 5, 256, shard_values=values, part_rows=4)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == brute_top(rows, 50, 5)
    empty = df.limit(0)
    assert ball_tree.top_k(empty, empty, 5, 256).collect() == []
    one = df.filter("vec_id = 350")
    assert ball_tree.top_k(one, one, 5, 256).collect() == []


# 13


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = [(k, lab, [math.floor(1024 * x) for x in v]) for k, lab, v in rows if whole(v)]
    dim = -(-max(len(v) for _, _, v in rows) // parts)
    x = np.array([v + [0] * (parts * dim - len(v)) for _, _, v in rows], "i8").reshape(len(rows), parts, dim)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, pack(np.array(rows[i][2], "i8"), np.array([len(rows[i][2])]))[0]))
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        at = far.argmin(-1)
        if step < rounds:
            for p in range(parts):
                for e in set(at[:, p].tolist()):
                    own = x[at[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own)
    errors = far.min(-1).sum(-1)
    label = Counter()
    for (_, lab, _), e in zip(rows, errors.tolist()):
        label[lab] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted([(k, bytes(c).hex(), e, label[lab], digest) for (k, lab, _), c, e in zip(rows, at.astype("u1"), errors.tolist())], key=str)


@pytest.mark.parametrize(("m", "d", "spread"), [(256, 16, 300), (1, 3, 5), (70, 1, 4), (130, 2, 10**7), (64, 0, 1)])
def test_slice_index(m, d, spread):
    rng = np.random.default_rng(m + d)
    entries, x = rng.integers(-spread, spread + 1, (m, d)), rng.integers(-spread, spread + 1, (500, d))
    index = vector_codes.SliceIndex(entries)
    at, far = index.nearest(x)
    want = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (at == want.argmin(1)).all() and (far == want.min(1)).all()
    radius = rng.integers(0, spread + 1, 500)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(-1)
    bits = np.unpackbits(index.within(x, radius).view("u1"), axis=1, bitorder="little")[:, :m]
    assert (bits.astype(bool) == inside).all()


def test_vector_codes_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i % 400, None if i % 7 == 0 else i % 5, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(600)]
    rows += [(7, 1, rows[7][2])] * 40 + [(None, 1, [0.5] * 9), (3, None, None), (4, 2, [1.0, None]), (5, 2, [float("inf")] * 9), (6, 2, []), (8, 3, [1.0, -2.0])]
    df = spark.createDataFrame([(k, lab, v, 1, "y") for k, lab, v in rows], "vec_id long, label int, embedding array<double>, code int, key string")
    for entries in (256, 20):
        got = vector_codes.compress(df, entries=entries)
        assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute_codes(rows, entries=entries)
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.filter("embedding is null")).collect() == []
    only = vector_codes.compress(df.filter("vec_id = 6 and size(embedding) = 0")).collect()
    assert [(r.code, r.error) for r in only] == [("00000000", 0)]


def test_label_sums_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 else 1, i) for i in range(50)], "key long, label int, _error long")
    totals = rows.groupBy("label").agg(F.sum("_error").alias("label_error"))
    want = sorted(map(str, vector_codes._joined(rows, totals, "label").collect()))
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST", 0)
    assert sorted(map(str, vector_codes._joined(rows, totals, "label").collect())) == want and len(want) == 50


# 12


def brute_alignment(docs):
    """docs: texts. The definition: both tokenizers over whole texts, cuts where both end."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    of_a = lambda i: bytes(byte[c] for c in ta.id_to_token(i))

    def of_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    groups = []
    for text in docs:
        a, b = ta.encode(f" {text}", add_special_tokens=False).ids if text else [], tb.encode(text) if text else []
        want = f" {text}".encode()
        if not text or b"".join(map(of_a, a)) != want or b"".join(map(of_b, b)) != want:
            groups.append(None)
            continue
        ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
        ea, eb = ends(a, of_a), ends(b, of_b)
        common = sorted(set(ea) & set(eb))
        own, i, j = [], 0, 0
        for c in common:
            x, y = [], []
            while i < len(a) and ea[i] <= c:
                x.append(a[i])
                i += 1
            while j < len(b) and eb[j] <= c:
                y.append(b[j])
                j += 1
            own.append((x, y))
        groups.append(own)
    count = Counter(p for g in groups if g for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g in groups:
        g = g or []
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SIGNS = ["a", "B", "é", " ", "  ", " ", "\n", "\t", "\r", "\r\n", " ", "　", "\x1c", "\x85", "▁", "日本", "ж", "12", "7", "'s", "don't", "...", "====", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\x00", "😀", "﻿", "é", "the ", " and"]


def test_alignment_of_odd_texts(spark):
    rng = random.Random(12)
    texts = [None, "", " ", "  ", "x" * 3000, "= - " * 2000, "ab" * 4000, "word " * 3000, "=" * 5001, "日本語" * 700]
    texts += ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    rows = [(None if i == 3 else i // 2, t, "en", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n_a int").repartition(3)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_alignment(texts))), key=str)
    for most in (alignment.MOST_PAIRS, 300, 0):
        got = alignment.align(df, A, B, most=most)
        assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == want
    assert alignment.align(df.limit(0), A, B).collect() == []


def test_ranks_equal_the_library():
    both, rng = alignment.aligner(A, B), random.Random(4)
    pool = [chr(c) for lo, hi in ((0, 0x250), (0x400, 0x500), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x4F00), (0xAC00, 0xAD00)) for c in range(lo, hi)] + ["'s", "'LL", " ", "  ", "1", "²", "½"] * 20
    assert both.fast is not None
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))
        assert alignment._SETTLED.fullmatch(text) and both.fast.encode_ordinary(text) == both.a.encode(text, add_special_tokens=False).ids


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = alignment.op12_alignment(spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, *w) for d, w in zip(docs, brute_alignment([d.text for d in docs])))


def test_pair_counts_handed_on_early(spark):
    df = spark.createDataFrame([(f"some words {i} and {i * 7}",) for i in range(300)], "text string")
    counted = lambda most: sorted(map(tuple, alignment.pair_counts(df, A, B, most).collect()))
    assert counted(50) == counted(2_000_000)


def test_odd_embeddings_through_queries(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (ball_tree.op11_ball_tree, vector_codes.op13_vector_codes, alignment.op12_alignment):
        assert query(spark, str(tmp_path)).collect() == []
