"""Fingerprints, scores, languages, packing and compression rules against brute force."""

import collections
import math
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepbank.llm import ctw, langid, packing, quality, simhash
from prepbank.llm.components import components
from prepbank.llm.registered import tokenizer_path


def fingerprint(text, n=3):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(fps):
    """Component of each fingerprint by all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_near_duplicates(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    root = linked({fingerprint(r[1]) for r in odd_rows})
    first = {}
    for r in odd_rows:
        if r[0] is not None:
            f = root[fingerprint(r[1])]
            first[f] = min(first.get(f, r[0]), r[0])
    wanted = collections.Counter((r[0], f"{fingerprint(r[1]):016x}", first.get(root[fingerprint(r[1])])) for r in odd_rows)
    assert collections.Counter(map(tuple, got)) == wanted
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    alone = {(None, r[1]) for r in odd_rows if r[0] is None and root[fingerprint(r[1])] not in first}
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([*first.values(), *(i for i, _ in alone)])


@pytest.mark.parametrize("max_list", [1024, 2])
def test_links_lose_none(spark, max_list):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    for f in fps[:40]:
        for bits in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(63, bits, replace=False)))
    dense = fps[-1]
    fps += [dense ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = simhash.links(table, max_list)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    wanted = linked(fps)
    assert {f: got.get(f, f) for f in fps} == wanted


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def context_tree(texts):
    """Probability of a decision for 1 given (context, node), by the definition."""
    depth = ctw.DEPTH
    n = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for t in texts:
        s = bytes([ctw.END]) * depth + t + bytes([ctw.END])
        for p in range(depth, len(s)):
            for j in range(8):
                node, bit = 1 << j | s[p] >> 8 - j, s[p] >> 7 - j & 1
                for d in range(depth + 1):
                    n[s[p - d : p], node][bit] += 1
                    if d:
                        children[s[p - d + 1 : p], node].add((s[p - d : p], node))

    def kt(key):
        a, b = n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    @lru_cache(None)
    def weighted(key):
        return kt(key) if len(key[0]) == depth else float(np.logaddexp(kt(key), sum(map(weighted, children[key])))) - math.log(2)

    def one(context, node, d=0):
        key = (context[depth - d :], node)
        if key not in n:
            return 0.5
        a, b = n[key]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(kt(key) - math.log(2) - weighted(key))
        return w * own + (1 - w) * one(context, node, d + 1)

    def score(t):
        s = bytes([ctw.END]) * depth + t + bytes([ctw.END])
        total = 0.0
        for p in range(depth, len(s)):
            for j in range(8):
                x = one(s[p - depth : p], 1 << j | s[p] >> 8 - j)
                total += math.log10(x if s[p] >> 7 - j & 1 else 1 - x)
        return total

    return score


def test_scores(odd, odd_rows, none):
    small = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    rows = [(r[0], (r[1] or "").encode().lower().split()) for r in odd_rows if len(r[1] or "") < 1000]
    held = lambda i: (i or 0) % 4 == 1
    out = ctw.score_texts(small, F.coalesce(F.col("doc_id") % 4, F.lit(0)) == 1, chunk_bytes=600).collect()
    c = collections.Counter()
    for i, w in rows:
        if not held(i):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    score = context_tree([b" ".join(w) for i, w in rows if not held(i)])
    wanted = sorted(
        (
            (str(i), held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n,
             sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), score(b" ".join(w)))
            for i, w in rows
        ),
        key=str,
    )
    got = sorted(((str(r[0]), *r[1:]) for r in out), key=str)
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=lambda x: (x[0], x[2])), sorted(wanted, key=lambda x: (x[0], x[2])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)
    assert ctw.score_texts(none, F.lit(False)).count() == 0


def test_scores_without_training(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    (row,) = ctw.score_texts(docs, F.lit(True)).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0
    assert row["score"] == pytest.approx(-24 * math.log10(2))


def test_probabilities_sum_to_one():
    grams = np.array([0x6162636465660000 >> 8 & ~0xFF | y for y in range(256)], np.uint64)
    counts = np.arange(256) % 5
    chance, nodes = ctw.subtrees(grams, counts)
    top = ctw.top_mixture(ctw._crown(nodes))
    assert (10 ** ctw.gram_logs(grams, chance, top)).sum() == pytest.approx(1)


SENTENCES = {
    "en": "the house and the garden with those other things which they have seen there this year",
    "de": "das haus und der garten mit den anderen sachen die sie hier nicht gesehen haben dieses jahr",
    "fr": "la maison et le jardin avec les autres choses que nous avons vues dans cette belle annee",
    "es": "la casa y el jardin con las otras cosas que ellos han visto aqui en este hermoso agosto",
}


def test_language_id(spark, none):
    rows, i = [], 0
    for lang, text in SENTENCES.items():
        w = text.split()
        for _ in range(60):
            i += 1
            rows.append((i, " ".join(w[(i * 7 + 3 * k * k + k) % len(w)] for k in range(9)), lang))
    rows += [(1001, None, "en"), (1002, "12 34 --", "de"), (1003, "", None), (None, "Der Garten", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, F.coalesce(F.col("doc_id") % 4, F.lit(2)) != 2).collect()}
    held = [(d, x) for d, _, x in rows if d and d % 4 == 2 and d < 1000]
    assert sum(got[d]["lang_pred"] == x for d, x in held) / len(held) > 0.9
    assert [tuple(got[d])[1:] for d in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = langid.fit(docs, F.lit(True), sample=20)
    assert ("germanic", "romance") in model.machines and ("de", "en") in model.machines and ("de", "fr") not in model.machines
    assert langid.drop_unknown(docs, model, least=0.0).count() == len(rows) - 3
    assert langid.identify(none, F.lit(True)).count() == 0
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def check_packing(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(odd, odd_rows, none):
    from tokenizers import Tokenizer

    out = packing.pack(odd, tokenizer_path(), 512, ids=True, bucket_rows=4)
    rows = out.collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = collections.Counter()
    for r in odd_rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            data = np.array(ids[at : at + 512], "<u4").tobytes()
            wanted[r[0], piece, at, len(data) // 4, zlib.crc32(data)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    n = check_packing(rows, 512)
    assert n <= -(-sum(r["length"] for r in rows) // 512) + 1
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    assert len(joined) == n
    for r in rows:
        assert joined[r["sequence_id"]][4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"])
    assert packing.pack(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_against_best(seed):
    """Every item once, no bin over; the reduction never costs a bin against the optimum of small instances."""
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 13, 11)]
    rows, bins = packing.plan_bins(dict(collections.Counter(sizes)), 12)
    load, seen = collections.Counter(), collections.Counter()
    for size, lo, hi, base, _, copies in rows:
        for rank in range(lo, hi):
            load[base + (rank - lo) // copies] += size
            seen[size] += 1
    assert seen == collections.Counter(sizes) and max(load.values()) <= 12 and len(load) == bins

    @lru_cache(None)
    def least(left, room):
        if not left:
            return 0
        best = 99
        for i, s in enumerate(left):
            rest = left[:i] + left[i + 1 :]
            best = min(best, least(rest, room - s) if s <= room else 1 + least(rest, 12 - s))
        return best

    assert bins <= 1 + least(tuple(sorted(sizes, reverse=True)), 0)


def test_special_strings_and_odd_separators():
    from tokenizers import Tokenizer

    words, tokenizer = packing._words(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("a<|endoftext|>b", "a\x1cb c", "İx. ΣΣ Ḱ!", "don't 'S 12.5", "\x85 \xa0 x"):
        assert words.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def counts_by_hand(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_compression_rules(spark, odd, odd_rows, none):
    got = quality.compression_rules(odd).collect()
    assert collections.Counter((r[0], *counts_by_hand(r[1])) for r in odd_rows) == collections.Counter(tuple(r)[:6] for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.compression_rules(none).count() == 0
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(int(x)) for x in rng.integers(33, 0x2FF, 12)) for _ in range(300))
    prose = " ".join("".join(chr(97 + int(x)) for x in rng.integers(0, 12, 5)) for _ in range(400))
    again = "".join(f"{i} copies of it, and then once more. " for i in range(100))
    docs = spark.createDataFrame([(1, noise), (2, prose), (3, again)], "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.compression_rules(docs).collect()}
    assert kept == {1: False, 2: True, 3: False}


def test_each_compression_rule_rejects_its_cases(spark):
    """Loops, noise, and texts of which a part is either; a bad tail counts; prose of any length stays."""
    rng = np.random.default_rng(2)
    stems = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 6))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))

    def noise(n):
        return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))

    loop = "".join(f"row{i} of table{i} holds {i} and{i} value{i} {i}.\n" for i in range(120))
    cases = {
        "low ratio": [loop, prose(60) + "\n" + loop],
        "high ratio": [" ".join(noise(60) for _ in range(60)), prose(20) + " " + " ".join(noise(30) for _ in range(60))],
        "chunks": [
            # A third of noise in the middle, in the tail alone (under a chunk), and a loop among prose.
            prose(400) + "\n" + " ".join(noise(70) for _ in range(20)) + "\n" + prose(400),
            prose(900)[:2048] + " " + " ".join(noise(60) for _ in range(16)),
            prose(1400) + "\n" + loop[:4000] + "\n" + prose(1400),
        ],
        None: [prose(n) for n in (50, 60, 90, 200, 400, 1000, 5000)],
    }
    rows = [(i, text, rule) for i, (rule, text) in enumerate((r, t) for r, ts in cases.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ratio string")
    got = {r["doc_id"]: r for r in quality.compression_rules(docs).collect()}
    assert {i: got[i]["rejected_by"] for i, _, _ in rows} == {i: rule for i, _, rule in rows}
    assert all(r["kept"] == (r["rejected_by"] is None) for r in got.values())
