"""Language ID: the family first, then one-versus-one linear support vector machines within it."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prepbank.llm.common import restored
from prepbank.session import materialize

# Common languages by family. Languages that aren't listed share families by likeness.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "oc", "ro"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "indo-iranian": ("hi", "ur", "bn", "mr", "pa", "gu", "ne", "fa", "ku", "ps"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# Bounds of the fit: labelled documents of a language, and of a family's side in a duel of families.
SAMPLE = 1000
SIDE = 2 * SAMPLE
# Hashed features of letter pairs and letter triples.
PAIRS = 512
TRIPLES = 2048
UNKNOWN = "und"
COST = 10.0
STEPS = 300
# Steepness of the score over a margin.
SLOPE = 2.0
# A document whose language has a lower score than this is taken for one of no learned language.
LEAST_SCORE = 0.2

_LATIN_END = 0x250
_LATIN = np.array([chr(i).isalpha() for i in range(_LATIN_END)])


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one 0 for each run of others, and 0 at both ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(code), bool)
    low = code < _LATIN_END
    letter[low] = _LATIN[code[low]]
    if not low.all():
        high, at = np.unique(code[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in high])[at]
    padded = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint64)
    return padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of hashed letter pairs and triples, 0 standing for a word's edge; None without a letter."""
    c = _letters(text)
    if len(c) < 3:
        return None
    two = (c[:-1] * np.uint64(0x9E3779B1) + c[1:]) * np.uint64(0x85EBCA77C2B2AE63)
    three = ((c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0xC2B2AE3D) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.concatenate([
        np.bincount((two >> np.uint64(40)).astype(np.int64) % PAIRS, minlength=PAIRS) / len(two),
        np.bincount((three >> np.uint64(40)).astype(np.int64) % TRIPLES, minlength=TRIPLES) / len(three),
    ])
    return np.sqrt(counts / 2)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = STEPS) -> np.ndarray:
    """Weights (the last one the offset) that minimize |w|^2 / 2 + cost * mean squared hinge loss, by accelerated gradients.

    Both classes (y = 1, -1) weigh the same in total.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    lipschitz = 1 + 2 * cost * float((share * (x**2).sum(axis=1)).sum())
    w = ahead = np.zeros(x.shape[1])
    for i in range(steps):
        short = np.maximum(0, 1 - y * (x @ ahead))
        gradient = ahead - 2 * cost * ((share * short * y) @ x)
        new = ahead - gradient / lipschitz
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


class Model:
    """Machines (first, second) -> weights, a positive margin speaking for the first; families and their languages."""

    def __init__(self, machines: dict[tuple[str, str], np.ndarray], family_of: dict[str, str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(family_of):
            self.families.setdefault(family_of[lang], []).append(lang)
        self.machines = machines

    def _choose(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """Winner of the most duels, the larger sum of margins deciding ties, and its smallest margin."""
        if len(names) == 1:
            return names[0], np.inf
        wins, sums, least = (dict.fromkeys(names, v) for v in (0, 0.0, np.inf))
        for a, b in combinations(names, 2):
            margin = float(x @ self.machines[a, b][:-1] + self.machines[a, b][-1])
            for name, m in ((a, margin), (b, -margin)):
                wins[name] += m > 0
                sums[name] += m
                least[name] = min(least[name], m)
        best = max(sorted(names), key=lambda name: (wins[name], sums[name]))
        return best, least[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); UNKNOWN and 0 without a letter or without a learned language."""
        x = None if text is None else features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        chosen, first = self._choose(sorted(self.families), x)
        lang, second = self._choose(self.families[chosen], x)
        margin = min(first, second)
        return lang, 1.0 if margin == np.inf else float(1 / (1 + np.exp(-SLOPE * margin)))


def family(lang: str) -> str | None:
    """Family of a listed language; a tag's part after - or _ does not count."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0])


def alike(means: dict[str, np.ndarray]) -> dict[str, str]:
    """Families of about equal size, as many as the root of the number of languages: each language joins the nearest of
    the first languages, which are chosen to lie far apart, that has room left."""
    names = sorted(means)
    if not names:
        return {}
    x = np.array([means[name] for name in names])
    n = int(np.ceil(np.sqrt(len(names))))
    room = dict.fromkeys(range(n), 2 * -(-len(names) // n))
    apart = ((x - x[0]) ** 2).sum(axis=1)
    firsts = [0]
    while len(firsts) < n:
        firsts.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[firsts[-1]]) ** 2).sum(axis=1))
    far = np.stack([((x - x[i]) ** 2).sum(axis=1) for i in firsts], axis=1)
    found = {}
    for i in np.argsort(far.min(axis=1), kind="stable"):
        at = next(int(j) for j in np.argsort(far[i], kind="stable") if room[int(j)])
        room[at] -= 1
        found[names[i]] = f"languages like {names[firsts[at]]}"
    return found


def _families(chosen: DataFrame, langs: list[str]) -> dict[str, str]:
    """The family of each language: the listed one, or by likeness of the mean features."""
    found = {x: family(x) for x in langs}
    others = [x for x in langs if found[x] is None]
    if not others:
        return found

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(_vector(x) for x in group["x"])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "mean": [total / len(group)]})

    few = chosen.where(F.col("lang").isin(others)).select("lang", "x")
    means = few.groupBy("lang").applyInPandas(mean, "lang string, mean array<double>").collect()
    return found | alike({r["lang"]: np.array(r["mean"]) for r in means})


def _vector(packed: bytes) -> np.ndarray:
    """Features from the places and values that aren't 0."""
    at = np.frombuffer(packed, [("at", "<u2"), ("value", "<f8")])
    out = np.zeros(PAIRS + TRIPLES)
    out[at["at"]] = at["value"]
    return out


def _packed(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    out = np.empty(len(at), [("at", "<u2"), ("value", "<f8")])
    out["at"], out["value"] = at, x[at]
    return out.tobytes()


def labelled_sample(rows: DataFrame, sample: int) -> DataFrame:
    """Rows (lang, nth, x) of rows (lang, text): the features of at most ``sample`` different texts of each language, those with the
    smallest hashes.

    Only hashes are ranked; copies fall together in each task, so a language of one text in very many copies is a language with
    one text. Then one text of each chosen hash is turned into features, which is all that goes on.
    """
    hashed = rows.withColumn("at", F.xxhash64("text", F.lit("sample")))
    w = W.partitionBy("lang").orderBy("at")
    ranked = hashed.select("lang", "at").distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample)
    ranked = materialize(ranked, "ranked")
    texts = hashed.join(ranked, ["lang", "at"]).groupBy("lang", "nth").agg(F.first("text").alias("text"))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            out = batch[["lang", "nth"]].assign(x=[None if x is None else _packed(x) for x in found])
            yield out[out["x"].notna()]

    return texts.mapInPandas(turn, "lang string, nth int, x binary")


def fit(
    docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE
) -> Model:
    """Machines for each pair of families and for each pair of languages of one family.

    Every language with a text is learned, from at most ``sample`` different texts of it among the rows where ``learn`` holds (and text and
    language are there). In a duel of families each side has at most ``SIDE`` texts, or one of each language, evenly from its
    languages. Each machine is fitted in a task of its own over the features of that bounded sample. To the driver come a row for
    each language and the machines; as unlisted languages share families, the machines grow with the 1.5th power of their number.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.rlike(text_col, F.lit(r"\p{L}")))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    chosen = materialize(labelled_sample(rows, sample), "labelled")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not langs:
        return Model({}, {})

    family_of = _families(chosen, langs)
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family_of[lang], []).append(lang)
    duels = []
    for a, b in combinations(sorted(members), 2):
        for side, f in ((1, a), (-1, b)):
            duels += [(a, b, x, side, max(1, SIDE // len(members[f]))) for x in members[f]]
    for group in members.values():
        for a, b in combinations(group, 2):
            duels += [(a, b, a, 1, sample), (a, b, b, -1, sample)]
    if not duels:
        return Model({}, family_of)
    table = docs.sparkSession.createDataFrame(duels, "first string, second string, lang string, side int, most int")
    # The n-th texts that count are the first ones left; a hash whose text has no letter leaves a gap.
    counted = chosen.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("nth")))

    def learn_one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array([_vector(v) for v in group["x"]])
        w = linear_svm(x, group["side"].to_numpy().astype(float))
        return pd.DataFrame({"first": [group["first"].iloc[0]], "second": [group["second"].iloc[0]], "w": [w]})

    fitted = counted.join(F.broadcast(table), "lang").where("nth <= most").drop("nth", "most").groupBy("first", "second").applyInPandas(
        learn_one, "first string, second string, w array<double>"
    )
    return Model({(r["first"], r["second"]): np.array(r["w"]) for r in fitted.collect()}, family_of)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score), from the whole text alone; no shuffle."""
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return restored(slim.mapInPandas(run, schema), docs, id_col).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, lang_pred, score; learned where ``learn`` holds.

    A null text or one without a letter is ``und`` with score 0, as is every text if no row has a language to learn;
    with one learned language all others get it with score 1. Null ids and repeated rows are kept; texts of any length are
    read whole; an empty table gives an empty result; other columns take no part.
    """
    return predict(docs, fit(docs, learn, lang_col, text_col), id_col, text_col)


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The documents that have one of the learned languages with a score of ``least`` or more, with all their columns.

    Where nothing could be learned, all documents with a letter stay: there is no evidence against any.
    """
    if not model.families:
        return docs.where(F.coalesce(F.rlike(text_col, F.lit(r"\p{L}")), F.lit(False)))

    @F.pandas_udf("boolean")
    def has_language(texts: pd.Series) -> pd.Series:
        found = (model.predict(t) for t in texts)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in found], dtype=bool)

    return docs.where(has_language(F.col(text_col)))
