"""Embedding whitening by a bidiagonal qd solver.

1. *Blockwise QR*: rows are centred exactly (whole numbers less the mean's whole part, less
   its fraction), and each task keeps only the triangular factor of the rows it has seen.
   The factors meet in groups of ``FAN``, round by round, until one is left: squared singular
   values of it, divided by n, are the eigenvalues of the covariance, which itself is never formed.
2. *Householder bidiagonalisation* of that triangle (its size is the vectors' length; driver).
3. *dqds* finds the singular values of the bidiagonal matrix to high relative accuracy:
   differential quotient-difference transforms with shifts that never pass the least one.
4. *Twisted factorisations* of the tridiagonal product recover the right vectors, from both
   ends to where they meet best.  Where neighbouring values are so close that these
   vectors are not orthogonal to working accuracy, plane rotations of the triangle's
   columns finish them.
5. Every row is projected and divided by the root of the eigenvalue; the covariance of the result
   is summed in the tasks, centred block by block, merged like the factors, and compared
   with the identity.

Defined cases: vectors that are null, empty or hold null or non-finite components go, and so do those
of another length than most (see ``vectors.integer_vectors``); components beyond 2**25 on either side count as that.
Components without variance (a singular value under ``EPS`` times length of the greatest) can't be
whitened and are left out, so a single vector, or equal ones, give no rows.  ``deviation`` is null where it exceeds a long.
A null vec_id stays null; repeated rows count and are returned one by one; an empty table gives no rows; other columns are
ignored.  Vectors longer than ``MAX_LENGTH`` are refused, for the driver solves a matrix of that width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import blocks, integer_vectors, matrix

SCALE = 64
OFFSET = 1_000_000
LIMIT = 1 << 31
COMPONENTS = 32
MAX_LENGTH = 4096
FAN = 32
EPS = float(np.finfo(np.float64).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with r = U B V^T for the upper bidiagonal B of a and b."""
    w, n = np.array(r, dtype=np.float64), r.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        most = np.abs(x).max(initial=0)
        if len(x) < 2 or not np.abs(x[1:]).any():
            return None
        h = x / most
        h[0] += np.copysign(np.linalg.norm(h), h[0])
        return h / np.linalg.norm(h)

    for k in range(n):
        h = reflector(w[k:, k].copy())
        if h is not None:
            w[k:, k:] -= 2 * np.outer(h, h @ w[k:, k:])
        if k < n - 2:
            h = reflector(w[k, k + 1 :].copy())
            if h is not None:
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(w).copy(), np.diag(w, 1).copy(), v


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform: the new array and its d."""
    d, out, between, ds = q[0] - shift, [], [], []
    for i in range(len(q) - 1):
        ds.append(d)
        top = d + e[i]
        t = q[i + 1] / top if top else 0.0
        out.append(top)
        between.append(e[i] * t)
        d = d * t - shift
    ds.append(d)
    return [*out, d], between, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix with diagonal a and superdiagonal b, descending."""
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if not scale:
        return np.zeros(len(a))
    found: list[float] = []
    work = [([float(x) for x in (a / scale) ** 2], [float(x) for x in (b / scale) ** 2], 0.0)]
    tiny = (10 * EPS) ** 2
    while work:
        q, e, sigma = work.pop()
        while q:
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            if e[-1] <= tiny * (sigma + q[-1]) or e[-1] < 1e-300:
                found.append(q.pop() + sigma)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= tiny * sigma or e[i] < 1e-300), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1] / 1.5:
                q.reverse()
                e.reverse()
            plain = _qd(q, e, 0.0)
            if min(plain[2]) <= 0:
                q, e = plain[:2]
                if q[-1] <= 0:  # singular: an exact zero splits off
                    found.append(sigma)
                    q.pop()
                    e.pop()
                continue
            # 1/d are the diagonal of the inverse, so the least value lies between these two
            low, high = 1 / sum(1 / d for d in plain[2]), min(plain[2])
            for shift in (low + 0.75 * (high - low), low * (1 - 4 * EPS), low * 0.5, 0.0):
                trial = _qd(q, e, shift)
                if min(trial[2]) >= 0 and min(trial[1]) >= 0:
                    q, e, sigma = trial[0], trial[1], sigma + shift
                    break
    return np.sort(np.array(found))[::-1] * scale**2


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B for an eigenvalue, from the twisted factorisation with the least twist element."""
    n = len(a)
    d, l = a * a, np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)
    plus, minus, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    small = EPS * (np.max(d) or 1) * EPS
    s[0] = -value
    for i in range(n - 1):
        top = d[i] + s[i]
        plus[i] = d[i] * l[i] / (top if abs(top) > small else small)
        s[i + 1] = plus[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        top = d[i] * l[i] * l[i] + p[i + 1]
        t = d[i] / (top if abs(top) > small else small)
        minus[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size else np.eye(n)[r]


def rotate(r: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided plane rotations until the columns of r v are orthogonal: squared lengths and v, descending."""
    m, v = r @ v, v.copy()
    n = v.shape[1]
    floor = EPS * np.linalg.norm(m) ** 2
    for _ in range(30):
        turned = False
        for i in range(n - 1):
            for j in range(i + 1, n):
                x, y, z = m[:, i] @ m[:, i], m[:, j] @ m[:, j], m[:, i] @ m[:, j]
                if abs(z) <= 4 * EPS * np.sqrt(x * y) or abs(z) <= EPS * floor:
                    continue
                turned = True
                t = (y - x) / (2 * z)
                t = np.copysign(1, t) / (abs(t) + np.hypot(1, t))
                c = 1 / np.hypot(1, t)
                for w in (m, v):
                    w[:, [i, j]] = np.stack([c * w[:, i] - c * t * w[:, j], c * t * w[:, i] + c * w[:, j]], axis=1)
        if not turned:
            break
    size = (m * m).sum(axis=0)
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


def solve(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, descending, and its right vectors as columns."""
    a, b, v = bidiagonalise(r)
    values = dqds(a, b)
    if not len(values) or not values[0]:
        return values, v
    z = np.column_stack([twisted(a, b, x) for x in values]) if len(values) > 1 else np.ones((1, 1))
    t = np.diag(a) + np.diag(b, 1)
    wrong = max(np.abs(z.T @ z - np.eye(len(a))).max(), np.abs(t.T @ (t @ z) - z * values).max() / values[0])
    if wrong <= 1e-12:
        return values, v @ z
    full, kept = np.linalg.qr(z)
    return rotate(r, v @ (full * np.where(np.diag(kept) < 0, -1.0, 1.0)))


def _merge(parts: DataFrame, n: int, merge) -> np.ndarray | None:
    """Arrays of tasks, ``part, flat``, merged by ``FAN`` until one is left; only that one reaches the driver."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        flat = merge([np.asarray(x) for x in group.sort_values("part")["flat"]])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "flat": [flat]})

    while n > 1:
        parts, n = parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(run, parts.schema), -(-n // FAN)
    found = parts.collect()
    return np.array(found[0]["flat"]) if found else None


def _emit(part: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["part", "flat"])


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangles(rows: DataFrame, whole: np.ndarray, fraction: np.ndarray, d: int) -> np.ndarray:
    """The triangular factor of all centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in blocks(batches):
            r = _triangle(np.vstack([r, (matrix(batch.column(0), d) - whole) - fraction]), d)
        if len(r):
            yield _emit(TaskContext.get().partitionId(), r.reshape(-1))

    parts = rows.select("x").mapInArrow(run, "part int, flat array<double>")
    return _merge(parts, rows.rdd.getNumPartitions(), lambda rs: _triangle(np.vstack([x.reshape(d, d) for x in rs]), d).reshape(-1)).reshape(d, d)


@dataclass(frozen=True)
class Whitening:
    """Mean (whole part and fraction), unit eigenvectors as columns, eigenvalues, the trace and the number of vectors."""

    n: int
    sums: np.ndarray
    whole: np.ndarray
    fraction: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole) - self.fraction) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``x`` of all rows; None where there is no variance."""
    if length > MAX_LENGTH:
        raise ValueError(f"vectors of {length} components; the solver takes {MAX_LENGTH} at most")
    if not length:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), length)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    partial = rows.select("x").mapInArrow(sums, "n long, s array<long>").select("n", F.posexplode("s").alias("at", "s"))
    found = partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    n = found[0]["n"]
    total = [int(r["s"]) for r in sorted(found, key=lambda r: r["at"])]
    whole = np.array([s // n for s in total], dtype=np.int64)
    fraction = np.array([(s % n) / n for s in total])
    r = _triangles(rows, whole, fraction, length)
    squares, v = solve(r)
    keep = squares[:components] > (EPS * max(length, 64)) ** 2 * (squares[0] or 1)
    k = int(keep.sum())
    return Whitening(n, np.array(total, dtype=object), whole, fraction, v[:, :k], squares[:k] / n, float((r * r).sum() / n)) if k else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    d, k = len(model.whole), len(model.values)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        """Count, mean and centred products of two sets of rows at a time."""
        out = parts[0].copy()
        for x in parts[1:]:
            n, gap = out[0] + x[0], x[1 : k + 1] - out[1 : k + 1]
            out[k + 1 :] += x[k + 1 :] + (np.outer(gap, gap) * (out[0] * x[0] / n)).reshape(-1)
            out[1 : k + 1] += gap * (x[0] / n)
            out[0] = n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in blocks(batches):
            w = model.apply(matrix(batch.column(0), d))
            c = w - w.mean(axis=0)
            part = np.concatenate([[len(w)], w.mean(axis=0), (c.T @ c).reshape(-1)])
            held = part if held is None else join([held, part])
        if held is not None:
            yield _emit(TaskContext.get().partitionId(), held)

    parts = rows.select("x").mapInArrow(run, "part int, flat array<double>")
    found = _merge(parts, rows.rdd.getNumPartitions(), join)
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened array<double>`` of each row."""
    d, k, n = len(model.whole), len(model.values), model.n
    rest = np.array([int(s) - n * int(m) for s, m in zip(model.sums, model.whole)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            far = (x - model.whole) * n - rest  # n * x less the sums, modulo 2**64
            exact = ((x - model.whole) - model.fraction) * float(n)
            fits = (exact * exact).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            w = model.apply(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((far * far).sum(axis=1), mask=~fits), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def query(spark, sf_dir: str) -> DataFrame:
    rows, length = integer_vectors(table(spark, sf_dir, "embeddings"), SCALE, OFFSET, LIMIT)
    model = fit(rows, length)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(x / model.trace)) for x in model.values])
    wide = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"))
