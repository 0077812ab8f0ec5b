"""Jaccard join against sets of shingles by hand."""

import collections
import itertools

import numpy as np
import pytest

from prepbank.llm import jaccard


def shingles_by_hand(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components_by_hand(rows, percent=85):
    sets = [shingles_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    first = {}
    for (key, _), r in zip(rows, root, strict=True):
        first[r] = min((x for x in (first.get(r), key) if x is not None), default=None)
    return collections.Counter((key, len(s), first[r]) for (key, _), s, r in zip(rows, sets, root, strict=True))


def made(seed):
    """Texts of 2 to 900 words with copies of which a share of the words is another one; a long chain; texts around one passage."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(4000)]
    texts = []
    for i in range(60):
        base = list(rng.choice(vocabulary, int(rng.integers(2, [12, 40, 120, 900][i % 4]))))
        texts.append(" ".join(base))
        for share in (0.004, 0.01, 0.02, 0.03, 0.05)[: i % 6]:
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
        texts.append(" ".join(base[1:]))
        texts.append(" ".join([*base, str(rng.choice(vocabulary))]).upper())
    long = list(rng.choice(vocabulary, 700))
    texts += [" ".join(long[at : at + 300]) for at in range(0, 400, 12)]
    texts += [" ".join([*long[:80], *rng.choice(vocabulary, 60)]) for _ in range(30)]
    texts += ["", " \n", "one", "ONE", "one two three", "one  two three", "one two three four", "ab ab ab ab ab ab ab", None]
    order = rng.permutation(len(texts))
    return [(int(k), t) for k, t in zip(order, texts, strict=True)]


@pytest.mark.parametrize("seed, rows, shingles, often", [(1, 1024, 1 << 20, 64), (2, 16, 64, 2)])
def test_components(spark, monkeypatch, seed, rows, shingles, often):
    """Also with lists cut into many blocks, and keys of three classes taken for hot ones."""
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "SPARSE", min(often, jaccard.SPARSE) // 2)
    monkeypatch.setattr(jaccard, "DENSE", 4 if often == 64 else 0)
    data = made(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id bigint, text string, key string, n int").repartition(3)
    got = jaccard.jaccard_components(docs, block_rows=rows, block_shingles=shingles)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert collections.Counter(map(tuple, got.collect())) == components_by_hand(data)


def test_similar_texts_that_link_to_no_first_one(spark):
    """A list whose first row links to nothing, so that the tiles have to find what links; long enough for several blocks."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        cut = sorted(rng.choice(400, 9, replace=False))
        rows.append((i, " ".join(f"x{i}y{j}" if j in cut else w for j, w in enumerate(base))))
    rows += [(100 + i, t + f" tail{i}") for i, t in rows[::3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    wanted = components_by_hand(rows)
    assert len({c for _, _, c in wanted}) > 5
    assert collections.Counter(map(tuple, jaccard.jaccard_components(docs, block_rows=16).collect())) == wanted


def test_odd_rows(spark, odd, odd_rows, none):
    got = jaccard.jaccard_components(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [(r[0], r[1]) for r in odd_rows]
    wanted = collections.Counter()
    for (key, n, c), k in components_by_hand(rows).items():
        wanted[key, n, c if n else key] += k
    assert collections.Counter(map(tuple, got.collect())) == wanted
    assert jaccard.jaccard_components(none).count() == 0


def test_linked_sets_share_a_key():
    """No pair of linked sets of any size is without a common key of the tile of the larger one's band."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 90, 200, 1000, 5000]:
        for _ in range(20 if n < 60 else 5):
            shared = rng.integers(0, 2**64, n, np.uint64)
            # As many other elements as a link allows, dealt at random to both sides.
            other = next(k for k in itertools.count() if 100 * n < 85 * (n + k + 1))
            here = int(rng.integers(0, other + 1))
            extra = rng.integers(0, 2**64, other, np.uint64)
            a, b = np.unique(np.r_[shared, extra[:here]]), np.unique(np.r_[shared, extra[here:]])
            keys_a, own_a = jaccard.part_keys(a)
            keys_b, own_b = jaccard.part_keys(b)
            common, at_a, at_b = np.intersect1d(keys_a, keys_b, return_indices=True)
            assert (a == b).all() if not other else (own_a[at_a] | own_b[at_b]).any()


def test_bound_and_overlap():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        pool = rng.integers(0, 2**64, 2 * n, np.uint64)
        a, b = (np.unique(rng.choice(pool, n)) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert jaccard.overlap(a, b) == shared
        big = max(jaccard.bitmap_bits(len(a)), jaccard.bitmap_bits(len(b)))
        x, y = jaccard.bitmap(a, big), jaccard.bitmap(b, big)
        assert jaccard.overlap_bound(x, len(a), y, len(b)) >= shared
        assert (jaccard.folded(x, 64) == jaccard.bitmap(a, 64)).all()
    # The bound rules unlike sets of one size out without their elements.
    a, b = (np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(2))
    x, y = jaccard.bitmap(a, 1024), jaccard.bitmap(b, 1024)
    assert jaccard.overlap_bound(x, 500, y, 500) < jaccard.least_overlap(500, 500)
