"""Whitening of vectors by an eigendecomposition that grows with every vector.

Each task keeps the eigenvalues and eigenvectors of its own vectors' scatter and takes in one vector at a time: a centred
rank-one change, whose new eigenvalues are the roots of a secular equation. The tasks' decompositions are
combined by such changes too. A last pass over all vectors makes the basis exact (Rayleigh-Ritz).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.session import materialize

SCALE, SHIFT = 1024, 100_000  # of the whole numbers that stand for components
COMPONENTS = 8
FAN_IN = 8  # decompositions that one task combines
EPS = float(np.finfo(np.float64).eps)
MODEL_BYTES = 256 << 20  # of bases that one pass over the vectors holds
ROWS_AT_ONCE = 4096
STATE = "dims int, bucket long, n long, sums binary, mean binary, values binary, basis binary"
PRODUCTS = "dims int, bucket long, n long, mean binary, products binary"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, offset): the eigenvalues of diag(d) + z z', each as offset from the pole ``d[near]``; d rises strictly, no z is zero.

    Root i lies between d[i] and d[i + 1], the last one up to d[-1] + z'z. Both sides of the
    equation are replaced by a pole each with the same value and slope, and the root of that is taken; where it leaves the
    bracket, the bracket is halved.
    """
    k, w = len(d), z * z
    total = w.sum()
    gap = np.append(np.diff(d), total)
    at = np.arange(k)
    middle = 1 + (w / (d[None, :] - d[:, None] - gap[:, None] / 2)).sum(axis=1)  # the equation at the middle of each bracket
    near = np.where((middle >= 0) | (at == k - 1), at, at + 1)
    poles = d[None, :] - d[near][:, None]
    low = np.where(near == at, 0.0, -gap / 2)
    high = np.where(near == at, np.where(at == k - 1, gap, gap / 2), 0.0)
    low = np.where((at == k - 1) & (middle < 0), gap / 2, low)
    high = np.where((at == k - 1) & (middle >= 0), gap / 2, high)
    before = at[None, :] <= at[:, None]
    p, q = poles[at, at], np.append(poles[at[:-1], at[:-1] + 1], np.inf)
    x = (low + high) / 2
    for _ in range(100):
        diff = poles - x[:, None]
        term = w / diff
        slope = term / diff
        f = 1 + term.sum(axis=1)
        left, left_slope = np.where(before, term, 0).sum(axis=1), np.where(before, slope, 0).sum(axis=1)
        right, right_slope = f - 1 - left, slope.sum(axis=1) - left_slope
        bound = 8 * EPS * (1 + k * (np.abs(left) + np.abs(right)))
        done = (np.abs(f) <= bound) | (high - low <= 4 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        dp, dq = p - x, q - x
        last = np.isinf(q)
        dq_safe = np.where(last, 1.0, dq)
        s, t = left_slope * dp * dp, np.where(last, 0.0, right_slope * dq_safe * dq_safe)
        c = 1 + left - left_slope * dp + np.where(last, right, right - right_slope * dq_safe)
        # c + s / (dp - y) + t / (dq - y) = 0 in y, with y the step
        b = c * (dp + dq_safe) + s + t
        e = c * dp * dq_safe + s * dq_safe + t * dp
        root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
        denominator = np.where(b > 0, b + root, b - root)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(last, dp + s / np.where(c == 0, np.nan, c), np.where(b > 0, 2 * e / denominator, denominator / (2 * c)))
            other = np.where(b > 0, denominator / (2 * c), 2 * e / denominator)
        fits = (x + step > low) & (x + step < high)
        step = np.where(fits, step, np.where(last, np.nan, other))
        new = x + step
        x = np.where(done, x, np.where((new > low) & (new < high), new, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, basis: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``basis diag(values) basis' + change change'``.

    Deflation: directions that the change hardly touches keep their pair, and of (nearly) equal eigenvalues all but one
    are turned out of its way. The others' vectors come from the z that the computed roots belong to exactly,
    which keeps them orthogonal.
    """
    z = change @ basis
    size = float(np.sqrt(z @ z))
    if size == 0:
        return values, basis
    tiny = 8 * EPS * max(float(np.abs(values).max()), size * size)
    cuts = np.nonzero(np.diff(values) > tiny)[0] + 1
    if len(cuts) < len(values) - 1:
        basis = basis.copy()
        for begin, end in zip(np.append(0, cuts), np.append(cuts, len(values)), strict=True):
            if end - begin > 1 and (norm := float(np.linalg.norm(z[begin:end]))) > 0:
                mirror = z[begin:end].copy()
                mirror[-1] += np.copysign(norm, mirror[-1])
                mirror /= np.linalg.norm(mirror)
                part = basis[:, begin:end]
                basis[:, begin:end] = part - 2 * np.outer(part @ mirror, mirror)
                z[begin : end - 1], z[end - 1] = 0, -np.copysign(norm, z[end - 1])
    moved = np.abs(z) * size > tiny
    if not moved.any():
        return values, basis
    d, z = values[moved], z[moved]
    k = len(d)
    near, offset = secular_roots(d, z)
    distance = (d[near][:, None] - d[None, :]) + offset[:, None]  # root i minus pole j
    rows, columns = np.arange(k)[:, None], np.arange(k)[None, :]
    other = np.where(rows < columns, rows, np.minimum(rows + 1, k - 1))  # the pole that root i is set against
    below = d[other] - d[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(rows == k - 1, distance, distance / below)
    exact = np.sqrt(np.abs(ratio.prod(axis=0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        turned = np.copysign(exact, z)[None, :] / -distance
    hit = distance == 0
    if hit.any():
        turned[hit.any(axis=1)] = hit[hit.any(axis=1)].astype(np.float64)
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    new_values, new_basis = values.copy(), basis.copy()
    new_values[moved] = d[near] + offset
    new_basis[:, moved] = basis[:, moved] @ turned.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_basis[:, order]


@dataclass
class Spectrum:
    """Number, sums, mean, and eigenvalues and eigenvectors of the scatter of some vectors."""

    n: int
    sums: np.ndarray  # exact whole numbers
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, object), np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """Takes in one vector: a rank-one change by its distance to the mean so far."""
        away = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> Spectrum:
        """Both together: a rank-one change for each eigenpair of the other, and one for the distance of the means."""
        if not self.n or not other.n:
            return other if not self.n else self
        n, away = self.n + other.n, other.mean - self.mean
        values, basis = self.values, self.basis
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                values, basis = rank_one(values, basis, vector * np.sqrt(value))
        values, basis = rank_one(values, basis, away * np.sqrt(self.n * other.n / n))
        return Spectrum(n, self.sums + other.sums, self.mean + away * (other.n / n), values, basis)

    def row(self, bucket: int) -> tuple:
        sums = ",".join(map(str, self.sums)).encode()
        return len(self.mean), bucket, self.n, sums, *(np.ascontiguousarray(x, np.float64).tobytes() for x in (self.mean, self.values, self.basis))

    @classmethod
    def of(cls, row) -> Spectrum:
        mean, values, basis = (np.frombuffer(x, np.float64) for x in (row.mean_, row.values_, row.basis))
        return cls(int(row.n), np.array([int(x) for x in row.sums.split(b",")], object), mean, values, basis.reshape(len(mean), -1))


@dataclass(frozen=True)
class Whitening:
    """The fitted components of vectors of one length: ``basis`` has a column for each, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    basis: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """The vectors' coordinates, from differences to the mean that are exact as long as n x fits a double."""
        sums = np.array(self.sums, np.float64)
        exact = self.n * float(np.abs(x).max(initial=0)) < 2**53
        return ((self.n * x - sums) / self.n if exact else x - sums / self.n) @ self.basis


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the vectors that are neither null nor empty nor hold a null or non-finite entry, as doubles."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(fine).select("vec_id", "v")


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, length, vectors as a matrix) of bounded blocks of vectors of one length; entries are floor(1024 c) + 100000."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            lengths = part.column(column).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                own = part.take(pa.array(np.nonzero(lengths == dims)[0]))
                v = own.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield own, dims, np.floor(SCALE * v) + SHIFT


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python's whole numbers."""
    if len(x) and float(np.abs(x).max()) * len(x) < 2**53:
        return np.array([int(s) for s in x.sum(axis=0)], object)
    return np.array([sum(map(int, column)) for column in x.T], object)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Spectrum] = {}
    for _, dims, x in _blocks(batches, 0):
        state = found.setdefault(dims, Spectrum.empty(dims))
        state.sums = state.sums + _exact_sums(x)
        for row in x:
            state.add(row)
    if found:
        bucket = _partition()
        yield pa.RecordBatch.from_pylist([dict(zip(_names(STATE), s.row(bucket), strict=True)) for s in found.values()], _arrow(STATE))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _combined(states: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row for each length: the tasks' rows are stored, and rows of ``FAN_IN`` buckets meet in a task, round by round."""
    states = materialize(states, "parts")
    tasks = (states.agg(F.max("bucket")).first()[0] or 0) + 1
    while tasks > 1:
        states = states.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("dims", "bucket").applyInPandas(merge, schema)
        tasks = -(-tasks // FAN_IN)
    return states


def _merge_spectra(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.rename(columns={"mean": "mean_", "values": "values_"}).sort_values("n", ascending=False, kind="stable")
    whole = Spectrum.empty(int(rows["dims"].iloc[0]))
    for row in rows.itertuples():
        whole = whole.merge(Spectrum.of(row))
    return pd.DataFrame([whole.row(int(rows["bucket"].iloc[0]))], columns=_names(STATE))


def _merge_products(rows: pd.DataFrame) -> pd.DataFrame:
    """Numbers, means and centred products of two parts give those of both."""
    n, mean, products = 0, 0.0, 0.0
    for row in rows.rename(columns={"mean": "mean_"}).itertuples():
        other, m = np.frombuffer(row.mean_, np.float64), int(row.n)
        away = other - mean
        own = np.frombuffer(row.products, np.float64).reshape(len(other), -1)
        products = products + own + np.outer(away, away) * (n * m / (n + m))
        n, mean = n + m, mean + away * (m / (n + m))
    return pd.DataFrame([(int(rows["dims"].iloc[0]), int(rows["bucket"].iloc[0]), n, mean.tobytes(), products.tobytes())], columns=_names(PRODUCTS))


def _products(x: DataFrame, of: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, tuple[int, np.ndarray]]:
    """For each length (number, covariance with divisor n) of what ``of`` makes of the vectors, centred before multiplying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, pd.DataFrame] = {}
        for _, dims, v in _blocks(batches, 0):
            y = of(dims, v)
            if y is None:
                continue
            mean = y.mean(axis=0)
            y = y - mean
            part = pd.DataFrame([(dims, 0, len(y), mean.tobytes(), (y.T @ y).tobytes())], columns=_names(PRODUCTS))
            found[dims] = _merge_products(pd.concat([found[dims], part])) if dims in found else part
        if found:
            rows = pd.concat(found.values()).assign(bucket=_partition())
            yield pa.RecordBatch.from_pandas(rows, _arrow(PRODUCTS), preserve_index=False)

    parts = x.select("v").mapInArrow(run, PRODUCTS)
    whole = _combined(parts, _merge_products, PRODUCTS).collect()
    return {r["dims"]: (r["n"], np.frombuffer(r["products"], np.float64).reshape(-1, len(r["mean"]) // 8) / r["n"]) for r in whole}


def fit(x: DataFrame) -> list[dict[int, Whitening]]:
    """The components of all vectors of ``x`` (see ``usable``), by length, in groups of bounded size.

    A vector's length decides which fit it belongs to. What reaches the driver is one basis for each length,
    never more than ``MODEL_BYTES`` at once unless a single one is larger.
    """
    parts = x.select("v").mapInArrow(_spectra, STATE)
    stored = materialize(_combined(parts, _merge_spectra, STATE), "spectra")
    groups: list[list[int]] = [[]]
    held = 0
    for row in stored.select("dims").orderBy("dims").toLocalIterator():
        size = 8 * row["dims"] ** 2
        if groups[-1] and held + size > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(row["dims"])
        held += size
    return [_refined(x, stored.filter(F.col("dims").isin(g)).toPandas()) for g in groups if g]


def _refined(x: DataFrame, rows: pd.DataFrame) -> dict[int, Whitening]:
    """Rayleigh-Ritz: the covariance of all vectors in the combined basis, summed over tasks, turns the basis into eigenvectors."""
    rough = {}
    for row in rows.rename(columns={"mean": "mean_", "values": "values_"}).itertuples():
        s = Spectrum.of(row)
        basis, _ = np.linalg.qr(s.basis[:, ::-1])
        rough[len(s.mean)] = Whitening(s.n, tuple(s.sums), s.values[::-1] / s.n, basis, 0.0)
    shared = x.sparkSession.sparkContext.broadcast(rough)  # at most MODEL_BYTES
    exact = _products(x, lambda dims, v: shared.value[dims].project(v) if dims in shared.value else None)
    fitted = {}
    for dims, (n, covariance) in exact.items():
        values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
        values, basis = np.maximum(values[::-1], 0), rough[dims].basis @ turn[:, ::-1]
        top = np.abs(basis).argmax(axis=0)
        basis = basis * np.sign(basis[top, np.arange(dims)])  # of either sign the one whose largest entry is positive
        fitted[dims] = Whitening(n, rough[dims].sums, values, basis, float(values.sum()))
    return fitted


def _axes(model: Whitening, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the first components, and 1 / sqrt of each; NaN where the variance is zero."""
    values = model.values[:most]
    flat = values <= len(model.sums) * EPS * model.trace
    return values, np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, values)))


def _deviation(model: Whitening, x: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    largest = model.n * float(np.abs(x).max()) + max(map(abs, model.sums))
    if largest < 2**62:
        away = model.n * x.astype(np.int64) - np.array(model.sums, np.int64)
        if float(np.abs(away).max()) ** 2 * away.shape[1] < 2**62:
            return (away * away).sum(axis=1).tolist()
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Entries c count as floor(1024 c) + 100000. A vector that is null or empty or has a null or non-finite entry is
    dropped. Vectors of another length are fitted among themselves; of d < ``components`` entries there are d components.
    A component without variance has a null ``whitened`` and takes no part in ``identity_error``, the largest absolute entry
    of the whitened vectors' covariance minus the identity; ``explained`` is null where nothing varies. Repeated rows and
    ids count and stay; a null id stays null; other columns are not read; an empty table gives no rows.
    ``deviation`` is null where it exceeds a long.
    """
    x = usable(vectors, vec_id, embedding)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, out = vectors.sparkSession, None
    for models in fit(x):
        shared = spark.sparkContext.broadcast({d: Whitening(m.n, m.sums, m.values, m.basis[:, :components], m.trace) for d, m in models.items()})

        def white(dims: int, v: np.ndarray, shared=shared) -> np.ndarray | None:
            if dims not in shared.value:
                return None
            return np.nan_to_num(shared.value[dims].project(v) * _axes(shared.value[dims], components)[1])

        errors = {}
        for dims, (_, covariance) in _products(x, white).items():
            used = ~np.isnan(_axes(models[dims], components)[1])
            errors[dims] = float(np.abs(covariance - np.eye(len(covariance)))[np.ix_(used, used)].max()) if used.any() else 0.0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, errors=errors) -> Iterator[pa.RecordBatch]:
            for rows, dims, v in _blocks(batches, 1):
                if dims not in shared.value:
                    continue
                model = shared.value[dims]
                values, scale = _axes(model, components)
                k, who = len(values), np.repeat(np.arange(len(v)), len(values))
                flat = (model.project(v) * scale).reshape(-1)
                explained = values / model.trace if model.trace else np.full(k, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(who)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                        pa.array(np.full(len(who), model.n)),
                        pa.array(_deviation(model, v), pa.int64()).take(pa.array(who)),
                        pa.array(flat, from_pandas=True),
                        pa.array(np.tile(explained, len(v)), from_pandas=True),
                        pa.array(np.full(len(who), errors[dims])),
                    ],
                    _names(schema),
                )

        part = x.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
