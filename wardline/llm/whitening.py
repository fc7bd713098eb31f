"""Operator 11, whitening of embeddings by a block Jacobi-Davidson method.

Entries become whole numbers (64 times the entry, rounded down), so that equal vectors are equal bytes: the fit list is a distinct
over packed vectors, with partial sums before the shuffle. It is written in blocks of rows, and the covariance is never formed: one pass takes a
block of directions W to the sum of c (c . W) over all centred vectors c, each task adding its blocks up before 16 or so columns are
summed by place. Directions come from Rayleigh-Ritz over a growing subspace. Each pair that is not yet exact asks for a correction t,
orthogonal to all wanted directions Q, with (1 - QQ')(V - e)(1 - QQ') t = -residual; MINRES solves these for all pairs at once, a pass an
inner step. Pairs are locked in falling order once their residual is at double precision, and the subspace is restarted when it is
wide. The driver holds some (dimensions x 100) numbers and no rows.

whitened is (x - S/n) . u / sqrt(e) over all rows, copies included; n * x - S is a whole number, so centring is exact, and so is
deviation. Components of no variance (e below 1e-12 of the trace) are left out: they can't be whitened.

Cases: null and empty vectors, those with null or non-finite entries, and those with an entry beyond 2^62 / 64, which has no long, are
dropped. If lengths differ, those of the most frequent length of the fit list (the longer of equally frequent ones) are kept. A
deviation that does not fit a long is null. Fewer than two different vectors have no component, and so no rows. Repeated rows and null
ids are rows of their own. Other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, table

COMPONENTS = 16
#: Pairs that are carried along beyond the wanted ones, inner steps at most, subspaces a restart keeps and reaches (in blocks).
GUARD, INNER, KEEP, WIDEST = 4, 8, 2, 5
_LARGEST = float(1 << 62)
#: Sums of so many tasks go straight to the driver; those of more are added by place first.
DIRECT = 64


# ---- vectors of whole numbers -------------------------------------------------------------------------------------


def whole(column: pa.Array):
    """(length, rows, whole numbers) of the vectors of a list column that are kept, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(64 * pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False))
        bad = ~(np.abs(values) < _LARGEST)
    spoilt = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[bad], minlength=len(lengths)) > 0
    begin = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[(lengths > 0) & ~spoilt]):
        rows = np.flatnonzero((lengths == d) & ~spoilt)
        yield int(d), rows, values[begin[rows][:, None] + np.arange(d)].astype(np.int64)


def packed(vectors: DataFrame) -> DataFrame:
    """dims, width, bytes of each vector, in the narrowest width, so that equal vectors have equal bytes."""

    def run(batches):
        for batch in batches:
            for d, _, x in whole(batch.column(0)):
                most = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
                width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
                for w in np.unique(width):
                    own = x[width == w].astype(f"<i{w}")
                    offsets = np.arange(len(own) + 1, dtype=np.int32) * (d * int(w))
                    data = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(own.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), d), pa.int32()), pa.array(np.full(len(own), w), pa.int32()), data], names=["dims", "width", "bytes"])

    return vectors.mapInArrow(run, "dims int, width int, bytes binary")


def _blocks(distinct: DataFrame) -> DataFrame:
    """dims, width, n, bytes, sums (decimal texts): many vectors a row."""

    def run(batches):
        for batch in batches:
            dims, width = (batch.column(c).to_numpy() for c in (0, 1))
            for d, w in sorted(set(zip(dims.tolist(), width.tolist(), strict=True))):
                data = b"".join(batch.column(2).filter(pa.array((dims == d) & (width == w))).to_pylist())
                x = np.frombuffer(data, f"<i{w}").reshape(-1, d)
                sums = x.astype(object).sum(axis=0) if w == 8 else x.sum(axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_pylist([{"dims": d, "width": w, "n": len(x), "bytes": data, "sums": [str(v) for v in sums]}], schema=_BLOCK)

    return distinct.mapInArrow(run, "dims int, width int, n long, bytes binary, sums array<string>")


_BLOCK = pa.schema([("dims", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary()), ("sums", pa.list_(pa.string()))])


def moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where they hold it, else Python's numbers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(abs(s) for s in sums))
    if most < 1 << 61:
        return x.astype(np.int64) * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


# ---- the method, over products ------------------------------------------------------------------------------------


def _orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what v adds to `against`."""
    for _ in range(3):
        v = v - against @ (against.T @ v)
        u, s, _ = np.linalg.svd(v, full_matrices=False)
        v = u[:, s > 1e-10 * max(s.max(initial=0.0), 1e-300)]
    return v


def _corrections(product, q: np.ndarray, e: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for (1 - QQ')(V - e)(1 - QQ') t = -r, a column for each e, all in step: each step is one product."""
    out = lambda x: x - q @ (q.T @ x)
    v_old, v = np.zeros_like(r), out(-r)
    beta = np.linalg.norm(v, axis=0)
    goal = 0.02 * beta
    v = v / np.where(beta > 0, beta, 1)
    t, w_old, w = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    rest, c_old, c, s_old, s = beta.copy(), np.ones_like(e), np.ones_like(e), np.zeros_like(e), np.zeros_like(e)
    beta = np.zeros_like(e)
    for _ in range(steps):
        a = out(product(v) - e * v)
        alpha = (v * a).sum(axis=0)
        new = a - alpha * v - beta * v_old
        new = out(new)
        beta_new = np.linalg.norm(new, axis=0)
        # the two rotations before and the new one take the tridiagonal column to triangular form
        d1, d2, d3 = s_old * beta, c_old * beta, alpha
        d2, d3 = c * d2 + s * d3, c * d3 - s * d2
        size = np.hypot(d3, beta_new)
        safe = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, np.where(size > 0, d3 / safe, 1.0), np.where(size > 0, beta_new / safe, 0.0)
        w_old, w = w, (v - d1 * w_old - d2 * w) / safe
        t += np.where(size > 0, c * rest, 0.0) * w
        rest = -s * rest
        v_old, v, beta = v, new / np.where(beta_new > 0, beta_new, 1), beta_new
        if (np.abs(rest) <= goal).all():
            break
    return out(t)


def jacobi_davidson(product, d: int, wanted: int, most_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues and unit eigenvectors of the symmetric matrix of which product(W) is the product with W."""
    wide = min(d, wanted + GUARD)
    locked, none = np.zeros((d, 0)), np.zeros((d, 0))
    basis = _orthonormal(np.random.default_rng(11).normal(size=(d, wide)), none)
    image = product(basis)
    last = np.inf
    for _ in range(most_rounds):
        h = basis.T @ image
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        active = min(wide - locked.shape[1], len(e))
        u, theta = basis[:, :active], e[:active]
        r = image[:, :active] - u * theta
        size = np.linalg.norm(r, axis=0)
        top = max(abs(e[0]), float(np.abs(locked_e).max()) if locked.shape[1] else 0.0) if len(e) else 0.0
        exact = 64 * np.finfo(float).eps * top
        left = wanted - locked.shape[1]
        # residuals that no longer fall are as small as rounding lets them be
        stuck = size[:left].max(initial=0.0) <= 1e-11 * top and size[:left].max(initial=0.0) > 0.5 * last
        last = size[:left].max(initial=0.0)
        done = 0
        while done < left and done < active and (size[done] <= exact or stuck):
            done += 1
        if done:
            locked_e = np.append(locked_e if locked.shape[1] else np.zeros(0), theta[:done])
            locked, last = np.hstack([locked, u[:, :done]]), np.inf
            basis, image, u, theta, r, size = basis[:, done:], image[:, done:], u[:, done:], theta[done:], r[:, done:], size[done:]
        if locked.shape[1] >= wanted:
            break
        if basis.shape[1] + wide > min(d, WIDEST * wide) and basis.shape[1] + locked.shape[1] < d:
            basis, image = basis[:, : KEEP * wide], image[:, : KEEP * wide]
        open_ = size > exact
        t = _corrections(product, np.hstack([locked, u]), theta[open_], r[:, open_], INNER) if open_.any() else none
        new = _orthonormal(t, np.hstack([locked, basis])) if t.shape[1] else none
        if not new.shape[1]:  # nothing to add: directions that were not seen yet
            new = _orthonormal(np.random.default_rng(12).normal(size=(d, wide)), np.hstack([locked, basis]))
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"residuals {size} of pairs that are not exact after {most_rounds} rounds")
    order = np.argsort(-locked_e, kind="stable")
    return locked_e[order], locked[:, order]


# ---- over rows ----------------------------------------------------------------------------------------------------


class Fit:
    """The fit list in blocks, with n, S and products with the centred covariance."""

    def __init__(self, vectors: DataFrame):
        self.blocks = cut(_blocks(packed(vectors).distinct()))
        sizes = self.blocks.groupBy("dims").agg(F.sum("n").alias("n"), F.sum(F.octet_length("bytes")).alias("size")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
        self.n, self.d, self.sums = 0, 0, []
        if sizes:
            self.n, self.d = sizes[0]["n"], sizes[0]["dims"]
            self.blocks = self.blocks.where(F.col("dims") == self.d)
            sums = self.blocks.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
            self.sums = [int(r["s"]) for r in sums.orderBy("at").collect()]  # a row for each dimension
        # A pass is short: tasks for all cores a few times over, but none under 4 MB or above 512 MB where the list allows it.
        size = sizes[0]["size"] if sizes else 0
        tasks = max(min(size >> 22, 4 * vectors.sparkSession.sparkContext.defaultParallelism), size >> 29, 1)
        self.direct = tasks <= DIRECT
        self.blocks = self.blocks.select("width", "bytes").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(self, of) -> np.ndarray:
        """The sum of of(centred rows) over all blocks, where `of` gives an array of some fixed shape."""
        n, d, sums = self.n, self.d, self.sums

        def run(batches):
            total = None
            for batch in batches:
                for w, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    got = of(moved(np.frombuffer(data.as_buffer(), f"<i{w}").reshape(-1, d), n, sums).astype(np.float64) / n)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["v"])

        parts = self.blocks.mapInArrow(run, "v array<double>")
        if self.direct:  # a sum of each task, DIRECT at most
            return np.sum([r["v"] for r in parts.collect()], axis=0)
        parts = parts.select(F.posexplode("v").alias("at", "v"))
        return np.array([r["v"] for r in sorted(parts.groupBy("at").agg(F.sum("v").alias("v")).collect())])

    def product(self, w: np.ndarray) -> np.ndarray:
        return self.summed(lambda c: c.T @ (c @ w)).reshape(w.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([(c * c).sum()]))[0]) / self.n


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict:
    """n, sums, the covariance's trace, its largest eigenvalues and their eigenvectors, and the identity error of what they whiten."""
    fit = Fit(vectors)
    try:
        trace = fit.trace() if fit.n > 1 else 0.0
        e, u = np.zeros(0), np.zeros((fit.d, 0))
        error = 0.0
        if trace > 0:
            e, u = jacobi_davidson(fit.product, fit.d, min(components, fit.d))
            some = e > 1e-12 * trace
            e, u = e[some], u[:, some]
            to = u / np.sqrt(e)
            white = fit.summed(lambda c: (c @ to).T @ (c @ to)).reshape(len(e), len(e)) / fit.n
            error = float(np.abs(white - np.eye(len(e))).max())
        return {"n": fit.n, "d": fit.d, "sums": fit.sums, "trace": trace, "e": e, "u": u, "error": error}
    finally:
        fit.blocks.unpersist()


def whiten(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """ident, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component."""
    model = fitted(rows.select(vector), components)

    def run(batches):
        n, sums, k = model["n"], model["sums"], len(model["e"])
        to = model["u"] / np.sqrt(model["e"])
        for batch in batches:
            for d, at, x in whole(batch.column(1)) if k else ():
                if d != model["d"]:
                    continue
                c = moved(x, n, sums)
                if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * d < 1 << 63:
                    deviation = pa.array((c * c).sum(axis=1))
                else:
                    deviation = pa.array([v if v < 1 << 63 else None for v in (c.astype(object) ** 2).sum(axis=1)], pa.int64())
                white, each = (c.astype(np.float64) / n) @ to, np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), n, np.int64)), deviation.take(pa.array(each)),
                     pa.array(white.ravel()), pa.array(np.tile(model["e"] / model["trace"], len(at))), pa.array(np.full(len(each), model["error"]))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(ident, vector).mapInArrow(run, f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": query}
ORACLE: dict[str, str] = {}
