"""The whole pipeline against plain versions of its stages, on documents with planted copies, menus and junk."""

import collections
import zlib

import numpy as np
import pytest
from test_native import lines_by_hand, targets_by_hand
from test_texts import check_packing, fingerprint, linked

import corpus_pipeline
from prepbank.llm import langid, lines
from prepbank.llm.registered import tokenizer_path
from prepbank.session import fresh_path


def made():
    """Documents of three languages and four sources: clean ones, exact and near copies, a menu on most pages of a source, a null and an
    empty text, digits alone, a repeated row, and a document of a few thousand tokens."""
    rng = np.random.default_rng(12)
    stems = {lang: ["".join(rng.choice(list(letters), 4)) for _ in range(300)] for lang, letters in (("en", "abcdefghi"), ("fr", "jklmnopqr"), ("es", "stuvwxyzé"))}

    def prose(lang, n):
        return " ".join(rng.choice(stems[lang], n))

    rows = []
    for i in range(120):
        lang = ["en", "fr", "es"][i % 3]
        text = prose(lang, int(rng.integers(20, 120)))
        rows.append((i, text + ("\nhome | about | contact" if i % 4 == 1 else ""), lang, f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[7][1], "fr", "s2", 1) for i in range(5)]
    long = prose("en", 3000)
    rows += [(300, long, "en", "s0", 1), (301, long + " last", "en", "s3", 1)]
    rows += [(400, None, "en", "s0", None), (401, "", None, "s1", 0), (402, "123 456 7", None, None, 9), rows[3]]
    return rows


def test_run_against_plain_stages(spark):
    from tokenizers import Tokenizer

    rows = made()
    folder = fresh_path(spark, "pipeline-in")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    # Language ID: what has a letter, as every text is clearly of its language.
    kept = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    scores = langid.identify(docs, docs["doc_id"] >= 0).where("lang_pred <> 'und'").collect()
    assert min(r["score"] for r in scores) > langid.LEAST_SCORE
    # Line dedup: the menu goes.
    texts = lines_by_hand([(r[0], r[1], r[3]) for r in kept], lines.RATIO, lines.LEAST)
    assert not any("about" in t for t in texts)
    kept = [(r[0], t, r[3]) for r, t in zip(kept, texts, strict=True)]
    # Near-dedup: the smallest id of each component of fingerprints.
    signed = {r: fingerprint(r[1]) for r in kept}
    roots = linked(set(signed.values()))
    first = {}
    for r, f in signed.items():
        first[roots[f]] = min(first.get(roots[f], r), r)
    kept = sorted(first.values())
    assert {300} == {r[0] for r in kept} & {300, 301} and not {r[0] for r in kept} & set(range(200, 205))
    # Mixing: words taken near the targets, at most three copies.
    sizes = collections.Counter()
    for _, text, source in kept:
        sizes[source] += len(text.split())
    targets = targets_by_hand(sizes)
    copies = collections.Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert set(copies) <= {r[0] for r in kept} and max(copies.values()) <= 3
    taken = collections.Counter()
    for key, text, source in kept:
        taken[source] += copies[key] * len(text.split())
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.05)
    # Packing: every piece of every copy, with the tokens of the text as it was left.
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = collections.Counter()
    for key, text, _ in kept:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[key, piece, at, len(part), zlib.crc32(part.tobytes())] += copies[key]
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +wanted
    assert check_packing(got, 4096) <= 2 * -(-sum(r["length"] for r in got) // 4096)
    again = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["piece"]) for r in again) == collections.Counter((r["doc_id"], r["piece"]) for r in got)
