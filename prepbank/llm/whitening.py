"""Embedding whitening: principal components by spectral divide and conquer over QDWH polar decompositions."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.llm.common import restored
from prepbank.session import materialize

SCALE = 256
COMPONENTS = 4
EPS = np.finfo(float).eps
# Components with a smaller share of the whole variance are rounding errors: nothing can be divided by their deviation.
LEAST_SHARE = 1e-13
# Shifts that are tried for one split before the block counts as a multiple of the identity.
SHIFTS = 24
LARGEST = 2**63 - 1


def polar(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QDWH iteration (dynamically weighted Halley, in its QR form)."""
    size = len(a)
    alpha = np.linalg.norm(a)
    x = a / alpha
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(1.0, max(low, EPS))
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift parts the eigenvalues.

    The projector on the upper one is half of identity plus polar factor of the shifted matrix. A shift strictly between the smallest and
    the largest eigenvalue has some on both sides, as has the mean of the diagonal of any matrix but c I; one that falls on an
    eigenvalue shows in a projector that isn't idempotent and is moved.
    """
    size, diagonal = len(a), np.sort(np.diag(a))
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(size))
    shifts = [(diagonal[(size - 1) // 2] + diagonal[size // 2]) / 2]
    shifts += [mean + spread / np.sqrt(size) * t for i in range(SHIFTS // 2) for t in (0.5**i - 1, 1 - 0.5 ** (i + 1))]
    start = np.random.default_rng(size).normal(size=(size, size))
    for shift in shifts:
        moved = a - shift * np.eye(size)
        if np.linalg.norm(moved) == 0:
            continue
        projector = (polar(moved) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size or np.linalg.norm(projector @ projector - projector) > 1e-8 * np.sqrt(size):
            continue
        # Two steps of subspace iteration: the eigenvalues of a projector are 0 and 1.
        basis = np.linalg.qr(projector @ start[:, :rank])[0]
        whole = np.linalg.qr(projector @ basis, mode="complete")[0]
        upper, lower = whole[:, :rank], whole[:, rank:]
        if np.linalg.norm(lower.T @ a @ upper) <= max(1e-11 * spread, 64 * EPS * np.linalg.norm(a)):
            return upper, lower
    return None


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix: the k largest, falling.

    Subspaces are split until a block is of one row or a multiple of the identity. The upper part goes first; a lower part is only
    split where the upper ones hold fewer than k components.
    """
    scale = np.linalg.norm(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def part(block: np.ndarray, basis: np.ndarray) -> None:
        size = len(block)
        flat = np.linalg.norm(block - np.diag(np.diag(block))) <= 4 * EPS * scale
        found = None if flat else _split(block)
        if found is None:
            # Diagonal up to rounding, or eigenvalues that double precision cannot part.
            for i in np.argsort(-np.diag(block), kind="stable"):
                values.append(float(block[i, i]))
                vectors.append(basis[:, i])
            return
        for side in found:
            if len(values) >= k:
                return
            inner = side.T @ block @ side
            part((inner + inner.T) / 2, basis @ side)

    if len(a):
        part((a + a.T) / 2, np.eye(len(a)))
    order = np.argsort(-np.array(values), kind="stable")[:k]
    if not len(order):
        return np.zeros(0), np.zeros((len(a), 0))
    q = np.linalg.qr(np.stack([vectors[i] for i in order], axis=1))[0]
    return np.einsum("ij,ik,kj->j", q, a, q), q


@dataclass
class Whitening:
    """What every task needs: rows and sums of the fit list, eigenvalues, components as columns, the trace of the covariance, and the
    largest entry by which the covariance of the whitened fit list is off the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, block: "_Block") -> np.ndarray:
        """x - S / n, from the exact whole numbers n x - S where these fit."""
        return np.asarray(block.exact(self) / self.n, float)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        firm = self.values > LEAST_SHARE * self.trace
        spread = np.sqrt(np.where(firm, self.values, 1.0))
        return np.where(firm, centred @ self.axes / spread, 0.0)


class _Block:
    """Whole-number vectors of an Arrow batch, filled up with zeros to ``width``."""

    def __init__(self, vectors: pd.Series, width: int):
        self.x = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            self.x[i, : len(v)] = v
        self.most = max(int(self.x.max(initial=0)), -int(self.x.min(initial=0)))

    def exact(self, fit: Whitening) -> np.ndarray:
        """n x - S; Python's own integers where 64 bits don't hold them."""
        if fit.n * self.most + max(map(abs, fit.sums), default=0) <= LARGEST:
            return fit.n * self.x - np.array(fit.sums, np.int64)
        return fit.n * self.x.astype(object) - np.array(fit.sums, object)

    def deviations(self, fit: Whitening) -> list[int | None]:
        """Exact sums of squares; None beyond a bigint."""
        off = self.exact(fit)
        most = max((abs(int(v)) for v in (off.max(initial=0), off.min(initial=0))), default=0)
        if off.dtype == object or most**2 * max(1, off.shape[1]) > LARGEST:
            off = off.astype(object)
        return [s if (s := int(v)) <= LARGEST else None for v in (off * off).sum(axis=1)]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (id as text, x): floor(scale * c) of every component as bigint, held to its range; vectors that are null or have a
    null or non-finite component are left out."""
    c = F.col(vec_col)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.where(c.isNotNull() & whole).select(F.col(id_col).cast("string").alias("id"), x.alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and exact sums of each dimension; one row a dimension comes to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            block = _Block(batch["x"], max([len(total), *map(len, batch["x"])]))
            n += len(batch)
            small = block.most * len(batch) <= LARGEST
            here = (block.x if small else block.x.astype(object)).sum(axis=0).astype(object)
            here[: len(total)] += total
            total = here
        yield pd.DataFrame({"i": np.arange(-1, len(total)), "s": [str(n), *map(str, total)]})

    parts = fit.select("x").mapInPandas(add, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in rows}
    return by.pop(-1, 0), [by[i] for i in range(len(by))]


def _covariance(fit: DataFrame, model: Whitening, whitened: bool) -> np.ndarray:
    """Covariance (divisor n) of the fit list, or of its whitened form: each task centres and multiplies its rows, and the
    products are summed by entry. The driver gets the dimension squared."""
    width = len(model.sums)
    size = len(model.values) if whitened else width

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            m = model.centred(_Block(batch["x"], width))
            m = model.whiten(m) if whitened else m
            total += m.T @ m
            sums += m.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(size + 1), "r": [*total, sums]})

    flat = fit.select("x").mapInPandas(products, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "v"))
    rows = flat.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((size + 1, size))
    full[rows["i"], rows["j"]] = rows["v"]
    mean = full[size] / model.n
    return full[:size] / model.n - np.outer(mean, mean)


def fit_whitening(whole: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Learn a whitening from integer vectors (column x), each distinct one counted once.

    Copies are dropped in each task ahead of the shuffle, so a vector that holds a third of all rows costs no more than another
    one. The distinct list is written once and read for the sums, the covariance and the check; the d x d matrix is split on the
    driver.
    """
    fit = materialize(whole.select("x").distinct(), "fit")
    n, sums = _sums(fit)
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if not n or not sums:
        return model
    v = _covariance(fit, model, whitened=False)
    model.values, model.axes = leading_components(v, min(k, len(sums)))
    model.trace = float(np.trace(v))
    firm = model.values > LEAST_SHARE * model.trace
    if firm.any():
        off = _covariance(fit, model, whitened=True)[np.ix_(firm, firm)] - np.eye(firm.sum())
        model.error = float(np.abs(off).max())
    return model


def transform(whole: DataFrame, model: Whitening) -> DataFrame:
    """Rows (id, deviation, whitened) of integer vectors: the exact sum over dimensions of (n x - S)^2, null beyond a bigint, and the
    whitened coordinates. No shuffle; the model goes to every task."""
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = _Block(batch["x"], len(model.sums))
            white = model.whiten(model.centred(block))
            yield pd.DataFrame({
                "id": batch["id"], "deviation": pd.array(block.deviations(model), dtype="Int64"), "whitened": list(white),
            })

    return whole.mapInPandas(run, schema)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector and each of its first k components: id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with a null or non-finite entry take no part; shorter vectors count as filled up with zeros; of vectors
    without entries there are no rows. Null ids and repeated rows are kept; equal vectors are one row of the fit list. A component
    without variance (all of one single distinct vector) has whitened 0, and no share in identity_error; explained is 0 where there
    is no variance at all. Entries beyond the range of a bigint are held to it. An empty table gives an empty result; other
    columns take no part.
    """
    whole = integer_vectors(vectors, id_col, vec_col)
    model = fit_whitening(whole, k)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    out = restored(transform(whole, model), vectors, id_col)
    out = out.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, explained)).cast("array<double>")
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.error).alias("identity_error"),
    )
