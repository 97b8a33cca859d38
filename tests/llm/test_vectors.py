"""Clustering, byte pairs and whitening against brute force, with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from quillscreen.llm import ball_trees, byte_pairs, whitening

VECTORS = "vec_id long, embedding array<double>, x string, cluster string, distance string"
BAD = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1e300] * 64]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], VECTORS).repartition(parts)


def gauss(rng, middle=0.0, size=64, spread=0.2):
    return [rng.gauss(middle, spread) for _ in range(size)]


def lloyd(rows, k=8, rounds=10, start=None):
    """Plain k-means over Python integers; one row per vector."""
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and abs(c) < 1e9 for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        to = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            if members := [x for (_, x), t in zip(kept, to) if t == j]:
                centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    return [(i, j, d) for i, x in kept for d, j in [nearest(x)]], centroids


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def test_clusters_equal_plain_k_means(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, gauss(rng, (i % 7) / 5)) for i in range(300)] + [(900 + i, [0.25] * 64) for i in range(120)] + [(5, gauss(rng)), (5, gauss(rng)), (None, gauss(rng))]
    rows += [(2000 + i, v) for i, v in enumerate(BAD)]
    monkeypatch.setattr(ball_trees, "BLOCK", 100)
    got, centroids = ball_trees.cluster_vectors(table(spark, rows))
    want, middle = lloyd(rows)
    assert centroids == middle and sort(got.collect()) == sort(want)


def test_clusters_with_ties_and_few_vectors(spark):
    # Half the vectors lie exactly between two centroids, and some centroids stay empty as their start is a copy of another.
    rows = [(i, [0.0] * 64) for i in range(40)] + [(100 + i, [1.0] + [0.0] * 63) for i in range(40)] + [(200 + i, [0.5] + [0.0] * 63) for i in range(80)]
    for some, rounds in ((rows, 10), (rows, 0), (rows[:3], 10)):
        got, centroids = ball_trees.cluster_vectors(table(spark, some), rounds=rounds)
        want, middle = lloyd(some, rounds=rounds)
        assert centroids == middle and sort(got.collect()) == sort(want)


def test_clusters_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, gauss(rng, 1000.0 * (i % 5), spread=40000.0)) for i in range(60)]
    rows = [(i, [max(-131000.0, min(131000.0, c)) for c in v]) for i, v in rows]
    got, _ = ball_trees.cluster_vectors(table(spark, rows))
    assert sort(got.collect()) == sort(lloyd(rows)[0])


def test_clusters_of_nothing(spark):
    for rows in ([], [(i, v) for i, v in enumerate(BAD)]):
        got, centroids = ball_trees.cluster_vectors(table(spark, rows))
        assert got.collect() == [] and centroids == []


def test_whole_balls_are_assigned_without_their_vectors():
    """Far apart groups: the balls that hold one group go whole, and the bound is what stops the others."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (200, 64)), rng.integers(995, 1005, (200, 64))])
    order, nodes = ball_trees.grow(points)
    assert sorted(order) == list(range(400)) and (nodes["sums"][0] == points.sum(axis=0)).all()
    row = {"points": points[order].astype(np.int32).tobytes(), **{k: v.tobytes() for k, v in nodes.items()}}
    tree = ball_trees.Tree(row, 64)
    whole, to, single, _ = tree.assign(np.array([[0] * 64, [1000] * 64]))
    assert len(whole) == 2 and sorted(to) == [0, 1] and not len(single)
    tree.radius = np.zeros_like(tree.radius) + 1e9
    assert len(tree.assign(np.array([[0] * 64, [1000] * 64]))[2]) == 400


def test_op11_totals(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, gauss(rng, (i % 3) / 2)) for i in range(90)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ball_trees.op11_ball_trees(spark, str(tmp_path)).collect()
    want, centroids = lloyd(rows)
    per = {c: sum(d for _, k, d in want if k == c) for c in range(8)}
    assert sort(got) == sort((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in want)


# ---- byte pairs

PATH = public_tokenizers.path(byte_pairs.MODEL)
RNG = random.Random(5)
LETTERS = "ab'srtelv  \n\t12½!.,é日本\u0085 \x1c😀ß՘Ᲊñ\U000323b0"
TEXTS = ["", " ", "<|endoftext|>", "x<|endoftext|> y<|endo", "don't we'll'x'", "a" * 3000, " " * 2000 + "b", "".join(RNG.choice("abcdefgh") for _ in range(6000))]
TEXTS += ["".join(RNG.choice(LETTERS) for _ in range(RNG.randint(0, 50))) for _ in range(1500)] + ["<|endoftext|>".join("ab "[: RNG.randint(0, 3)] for _ in range(5)) for _ in range(20)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture
def coder(monkeypatch):
    c = byte_pairs._loader(PATH)()
    c.forget()
    return c


@pytest.mark.parametrize(("window", "long"), [(1_000_000, 1024), (5, 1024), (40, 2), (3000, 1 << 30)])
def test_byte_pairs_equal_the_library(library, coder, monkeypatch, window, long):
    monkeypatch.setattr(byte_pairs, "WINDOW", window)
    monkeypatch.setattr(byte_pairs, "LONG", long)
    want = [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert [g.tolist() for g in coder.encode(TEXTS)] == want
    assert [coder.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_decoding_of_any_ids(library, coder):
    for _ in range(300):
        ids = [RNG.randrange(50257) for _ in range(RNG.randint(0, 20))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for bad in ([50257], [-1]):
        with pytest.raises(ValueError, match="vocabulary"):
            coder.decode(bad)


def test_words_are_forgotten_and_met_again(coder, monkeypatch):
    monkeypatch.setattr(byte_pairs, "KNOWN_WORDS", 10)
    first = [g.tolist() for g in coder.encode(TEXTS[:200])]
    assert len(coder.slot) > 10 and [coder.encode([t])[0].tolist() for t in TEXTS[:200]] == first


def test_every_letter_and_digit_falls_in_the_librarys_class(library, coder):
    """Each code point after a letter, a digit and a sign: the same words as the library's splitter."""
    step = range(1, 0x32400, 7)
    for c in (*coder.rare, *(chr(p) for p in step if not 0xD800 <= p < 0xE000)):
        text = f"a{c}1{c}!{c} {c}"
        words = [w for ws in coder.split(text) for w in ws]
        assert [len(w.encode()) for w in words] == [len(w) for w, _ in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_merges_out_of_order_are_refused():
    import json

    with open(PATH) as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="merge"):
        byte_pairs.Coder(json.dumps(spec).encode(), "")


def test_token_report(spark, library):
    texts = [None, *TEXTS[:40], TEXTS[5], TEXTS[5]]
    rows = [(None if i == 7 else i, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, t string, n_tokens string").repartition(3)

    def line(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sort(byte_pairs.token_report(docs, PATH).collect()) == sort(line(i, t) for i, t, *_ in [*rows, rows[4]])
    assert byte_pairs.token_report(docs.limit(0), PATH).collect() == []
    back = byte_pairs.decode(byte_pairs.encode(docs, PATH), PATH, to="t").collect()
    assert all(r.t == (r.text or "") for r in back) and len(back) == len(rows) + 1


# ---- whitening


def exact(rows):
    """(ids, n * x - S, n, covariance as doubles rounded from exact fractions)"""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - s for a, s in zip(r, sums)] for r in x]
    size = range(len(sums))
    return [i for i, _ in rows], d, n, np.array([[float(Fraction(sum(r[a] * r[b] for r in d), n**3)) for b in size] for a in size])


@pytest.mark.parametrize("size", [6, 40])
def test_whitening_equals_exact_fractions(spark, size):
    rng = random.Random(size)
    good = [(i, [c * (k + 1) for k, c in enumerate(gauss(rng, 3.0, size))]) for i in range(150)] + [(None, gauss(rng, 0.0, size)), (3, gauss(rng, 0.0, size)), (3, gauss(rng, 0.0, size))]
    bad = [(9000, None), (9001, []), (9002, [None] * size), (9003, [float("nan")] * size), (9004, [float("-inf")] * size), (9005, [1e300] * size), (9006, [1.0] * (size + 1))]
    vectors = table(spark, good + bad, 5)
    got = whitening.transform(vectors, whitening.fit(vectors)).collect()
    ids, d, n, cov = exact(good)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, size)
    assert len(got) == len(good) * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    assert sorted(str((r.id, r.deviation)) for r in got if r.component == 1) == sorted(str((i, sum(c * c for c in r))) for i, r in zip(ids, d))
    want = np.abs(np.array(d, float) / n @ axes[:, :k] / np.sqrt(values[:k]))
    for c in range(k):
        assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == c + 1), sorted(want[:, c]), atol=1e-9)
        assert all(abs(r.explained / (values[c] / np.trace(cov)) - 1) < 1e-10 for r in got if r.component == c + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_covariance_keeps_what_doubles_lose(spark):
    """Entries of very unlike size: the double-double sum agrees with exact fractions far below the last bit of a double."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * 2.0 ** rng.randint(-3, 30) for _ in range(4)]) for i in range(400)]
    _, d, n, _ = exact(rows)
    found = whitening.integers(table(spark, rows, 7), "vec_id", "embedding")
    high, low = whitening.covariance(found, "x", n, whitening.moments(found).centre())
    for a in range(4):
        for b in range(4):
            want = Fraction(sum(r[a] * r[b] for r in d), n**3)
            scale = Fraction(sum(abs(r[a] * r[b]) for r in d), n**3)
            assert abs(Fraction(high[a, b]) + Fraction(low[a, b]) - want) < scale * Fraction(1, 10**28)


def test_eigenvectors_of_close_and_equal_values():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    values = np.array([5.0, 5.0, 5.0 - 1e-9, *np.linspace(4, 1, 17)])
    high = (q * values) @ q.T
    high = (high + high.T) / 2
    e, x = whitening.eigen(high, np.zeros_like(high))
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-14 and np.abs(high @ x - x * e).max() < 1e-13 and (np.diff(e) <= 1e-12).all()


def test_whitening_without_variance(spark):
    same = table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])
    got = whitening.transform(same, whitening.fit(same)).collect()
    assert len(got) == 15 and {(r.deviation, r.whitened, r.identity_error) for r in got} == {(0, None, None)}
    flat = table(spark, [(i, [float(i), 7.0]) for i in range(5)])
    got = whitening.transform(flat, whitening.fit(flat)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and all(r.identity_error < 1e-10 for r in got)
    for rows in ([], [(1, None), (2, [])]):
        nothing = table(spark, rows)
        assert whitening.transform(nothing, whitening.fit(nothing)).collect() == []


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(2**44) * (i % 2), float(i)]) for i in range(4)]
    vectors = table(spark, rows)
    got = {r.id: r.deviation for r in whitening.transform(vectors, whitening.fit(vectors)).collect() if r.component == 1}
    assert got == {i: None for i in range(4)}
