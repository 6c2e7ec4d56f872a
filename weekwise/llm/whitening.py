"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

An entry c becomes the integer floor(64 c); the shift of 1,000,000 that the
contract adds cancels in every covariance.

1. Tasks add up products of integer vectors without rounding, as float64
   matrix products of 20-bit digits over few rows; 32-bit digits of the sums
   are added by Spark. With n vectors and sums S the scatter n * sum(y y') - S S'
   is n^2 times the covariance.
2. Its characteristic polynomial: tasks reduce the matrix to Hessenberg form
   modulo one 31-bit prime each, and Chinese remainders give the integer
   coefficients. The number of primes follows from a bound on them; one more
   prime checks the result.
3. All roots are real and none is negative, so the sign changes of the
   shifted polynomial are exactly the number of roots above the shift. That
   isolates the largest roots, multiplicities included; each is then
   bisected to 110 bits.
4. Tasks find the null space of (scatter - root) by inverse iteration in
   256-bit fixed point, one root each.

The driver holds a d x d matrix and d + 1 coefficients for dimension d,
whatever the number of vectors. Step 3 takes about d^2 operations on integers
of d * log2(trace) bits per split: meant for some hundred dimensions.

Defined results
- null vectors, vectors with null or non-finite entries and empty vectors are
  dropped; so are vectors whose length is not the commonest one (the larger of
  equally common ones).
- entries beyond 2^62 / 64 count as that bound.
- repeated rows, null and repeated ids count and return as rows of their own.
- components belong to eigenvalues above 0 only: constant dimensions, fewer
  vectors than dimensions or an empty table give fewer components or no rows.
- equal eigenvalues get an orthonormal basis of their space.
- a deviation of more than 38 digits is null; the query's 64-bit column is
  null where the deviation does not fit.
- extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwise.llm.frames import only

DIGIT = 20
ROWS = 1 << 13  # rows * (2^20)^2 stays below 2^53
LIMIT = float(2**62)
FIXED = 256
ROOT_BITS = 110
OUT_ROWS = 4096


# -- integer vectors and their scatter -----------------------------------------


def integer_rows(lists: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector (0 if dropped); which have length d; those as rows of floor(64 c)."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    lengths = np.where(bad[ends] == bad[ends - lengths], lengths, 0)
    if d is None:
        return lengths, lengths > 0, np.zeros((0, 0), np.int64)
    kept = np.flatnonzero(lengths == d)
    with np.errstate(over="ignore"):
        y = np.floor(64 * values[(ends[kept] - d)[:, None] + np.arange(d)])
    return lengths, kept, np.clip(y, -LIMIT, LIMIT).astype(np.int64)


def exact_products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers."""
    digits, rest = [], z
    while len(rest) and max(-int(rest.min()), int(rest.max())) >= 1 << DIGIT:
        digits.append((rest & ((1 << DIGIT) - 1)).astype(np.float64))
        rest = rest >> DIGIT
    digits.append(rest.astype(np.float64))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for a, x in enumerate(digits):
        for b, y in enumerate(digits):
            total += (x.T @ y).astype(np.int64).astype(object) << (DIGIT * (a + b))
    return total


def _commonest_length(rows: DataFrame) -> int:
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = np.unique(integer_rows(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["d", "n"])

    counts = rows.select("vector").mapInArrow(lengths, "d bigint, n bigint").filter("d > 0").groupBy("d")
    best = counts.agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def scatter(rows: DataFrame, d: int) -> np.ndarray:
    """Sums of products of (vector, 1) with itself: d + 1 rows and columns of Python integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            _, _, y = integer_rows(batch.column(0), d)
            for lo in range(0, len(y), ROWS):
                part = y[lo : lo + ROWS]
                total += exact_products(np.c_[part, np.ones(len(part), np.int64)])
        cells, places, digits = [], [], []
        for i in range(d + 1):
            for j in range(i, d + 1):
                value, place = int(total[i, j]), 0
                while value:
                    low = value if -(1 << 31) <= value < 1 << 31 else value & 0xFFFFFFFF
                    cells.append(i * (d + 1) + j)
                    places.append(place)
                    digits.append(low)
                    value, place = (value - low) >> 32, place + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array(places, pa.int32()), pa.array(digits, pa.int64())],
            ["cell", "place", "digit"],
        )

    parts = rows.select("vector").mapInArrow(add, "cell int, place int, digit bigint")
    total = np.zeros((d + 1, d + 1), object)
    for r in parts.groupBy("cell", "place").agg(F.sum("digit").alias("digit")).collect():  # some (d + 1)^2 rows
        i, j = divmod(r["cell"], d + 1)
        total[i, j] += r["digit"] << (32 * r["place"])
    return np.triu(total) + np.triu(total, 1).T


# -- characteristic polynomial ------------------------------------------------


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # decides below 3.2e9
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2^31, largest first, whose product has more than `bits` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to `a` modulo p with zeros below its first subdiagonal."""
    h, d = a.copy(), len(a)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k != j + 1:
            h[[k, j + 1]] = h[[j + 1, k]]
            h[:, [k, j + 1]] = h[:, [j + 1, k]]
        factor = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - factor[:, None] * h[j + 1]) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factor % p).sum(1)) % p
    return h


def characteristic_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, constant term first."""
    h, d = hessenberg(a, p), len(a)
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(d):
        c, along = np.zeros(k + 1, np.int64), 1
        c[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            along = along * int(h[i + 1, i]) % p
            c[i] = int(h[i, k]) * along % p
        poly[k + 1, 1:] = poly[k, :-1]
        poly[k + 1] = (poly[k + 1] - (c[:, None] * poly[: k + 1] % p).sum(0)) % p
    return poly[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - m), constant term first, for a symmetric m without negative eigenvalues."""
    d, trace = len(m), int(np.trace(m))
    # The k-th coefficient is a sum of products of k eigenvalues, largest where all of them are trace / d.
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    *moduli, last = primes(bound.bit_length() + 33)  # the last one checks the others
    shared = spark.sparkContext.broadcast([int(x) for x in m.ravel()])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                a = np.array([x % p for x in shared.value], np.int64).reshape(d, d)
                rows = [pa.array([p], pa.int64()), pa.array([characteristic_mod(a, p).tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, ["p", "rest"])

    tasks = spark.createDataFrame([(p,) for p in [*moduli, last]], "p bigint").repartition(min(len(moduli) + 1, 64))
    rests = {r["p"]: r["rest"] for r in tasks.mapInArrow(reduce, "p bigint, rest array<bigint>").collect()}
    product, coefficients = 1, [0] * (d + 1)
    for p in moduli:
        inverse = pow(product % p, -1, p)
        coefficients = [x + product * ((r - x) * inverse % p) for x, r in zip(coefficients, rests[p])]
        product *= p
    coefficients = [x - product if 2 * x > product else x for x in coefficients]
    if [x % last for x in coefficients] != rests[last]:
        raise ArithmeticError("the characteristic polynomial fails its check modulo one more prime")
    return coefficients


# -- roots -------------------------------------------------------------------------


def roots_above(poly: list[int], x: Fraction) -> int:
    """Number of roots above x, with multiplicity, of a polynomial with real roots only; x has a power of two below."""
    c, d, s = list(poly), len(poly) - 1, x.denominator.bit_length() - 1
    c = [v << (s * (d - k)) for k, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += x.numerator * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], x: Fraction) -> int:
    d, s, value = len(poly) - 1, x.denominator.bit_length() - 1, poly[-1]
    for k in range(d - 1, -1, -1):
        value = value * x.numerator + (poly[k] << (s * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of at least the `most` largest roots above 0, falling, to ROOT_BITS bits.

    `poly` has real roots only, none of them negative.
    """
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    most = min(most, len(poly) - 1)
    if most <= 0:
        return []
    found, have = [], 0
    top = Fraction(1 << (-poly[-2]).bit_length())  # above the sum of all roots
    todo = [(Fraction(0), top, len(poly) - 1, 0)]
    while todo and have < most:
        low, high, above_low, above_high = todo.pop()
        n = above_low - above_high
        if not n:
            continue
        close = (high - low) * (1 << ROOT_BITS) <= high
        if n == 1 and not close:
            low, high = _narrowed(poly, low, high, above_high)
            close = True
        if close:
            found.append(((low + high) / 2, n))
            have += n
            continue
        middle = (low + high) / 2
        above = roots_above(poly, middle)
        todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def _narrowed(poly: list[int], low: Fraction, high: Fraction, above_high: int) -> tuple[Fraction, Fraction]:
    """The interval (low, high] around its only root, narrowed by the sign, which shows the parity of the roots above."""
    while (high - low) * (1 << ROOT_BITS) > high:
        middle = (low + high) / 2
        sign = _sign(poly, middle)
        if not sign:
            return middle, middle
        if (sign > 0) == (above_high % 2 == 0):
            high = middle
        else:
            low = middle
    return low, high


# -- eigenvectors ----------------------------------------------------------------


def _factor(a: np.ndarray) -> list[int]:
    """LU factors with row exchanges, in place, in fixed point; the rows in their new order."""
    d, order = len(a), list(range(len(a)))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1  # the smallest step: an exact null vector
        a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[k, k + 1 :]) >> FIXED
    return order


def _solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x, d = b[order].copy(), len(lu)
    for k in range(d):
        x[k + 1 :] -= (lu[k + 1 :, k, None] * x[k]) >> FIXED
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] << FIXED) // lu[k, k]
        x[:k] -= (lu[:k, k, None] * x[k]) >> FIXED
    return x


def _orthonormal(x: np.ndarray) -> np.ndarray:
    for k in range(x.shape[1]):
        for _ in range(2):
            x[:, k] = (x[:, k] << FIXED) // max(1, isqrt(int((x[:, k] ** 2).sum())))
            for j in range(k):
                x[:, k] -= (x[:, j] * (int((x[:, j] * x[:, k]).sum()) >> FIXED)) >> FIXED
        x[:, k] = (x[:, k] << FIXED) // max(1, isqrt(int((x[:, k] ** 2).sum())))
    return x


def null_space(m: list[int], d: int, trace: int, root: Fraction, size: int) -> list[list[float]]:
    """`size` orthonormal vectors that m maps to `root` times themselves."""
    a = np.array([(x << FIXED) // trace for x in m], object).reshape(d, d)
    shift = (root.numerator << FIXED) // (root.denominator * trace)
    for i in range(d):
        a[i, i] -= shift
    order = _factor(a)
    start = np.random.default_rng(7).integers(-(1 << 30), 1 << 30, (d, size)).astype(object)
    x = _orthonormal(start)
    for _ in range(3):
        x = _orthonormal(_solve(a, order, x))
    vectors = np.array([[v / (1 << FIXED) for v in row] for row in x.tolist()]).T
    lead = vectors[np.arange(size), np.abs(vectors).argmax(1)]
    return (vectors * np.where(lead < 0, -1.0, 1.0)[:, None]).tolist()


# -- the operator --------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted whitening; `project` maps centred integer vectors to components, a column each."""

    d: int
    n: int
    sums: list[int]
    eigenvalues: list[float]
    explained: list[float]
    vectors: np.ndarray  # a row for each component
    identity_error: float | None = None

    @property
    def project(self) -> np.ndarray:
        return self.vectors.T / np.sqrt(self.eigenvalues)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S without rounding."""
        largest = max(-int(y.min()), int(y.max())) if y.size else 0
        if self.n * largest + max(map(abs, self.sums), default=0) < 1 << 62:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)


def _floats(values: np.ndarray, n: int) -> np.ndarray:
    if values.dtype == object:
        return np.array([int(v) / n for v in values.ravel()], np.float64).reshape(values.shape)
    return values / n


def _rows(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    return only(vectors, vec_id=id_column, vector=vector)


def fit(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector: str = "embedding") -> Whitening:
    """Components of all vectors of the table, and how far their whitened covariance is from the identity."""
    spark, rows = vectors.sparkSession, _rows(vectors, id_column, vector)
    d = _commonest_length(rows)
    if not d:
        return Whitening(0, 0, [], [], [], np.zeros((0, 0)))
    total = scatter(rows, d)
    n, sums = int(total[d, d]), [int(x) for x in total[d, :d]]
    m = n * total[:d, :d] - np.outer(total[d, :d], total[d, :d])
    trace = int(np.trace(m))
    model = Whitening(d, n, sums, [], [], np.zeros((0, d)))
    if not trace:
        return model
    roots = largest_roots(characteristic(spark, m), components)
    shared = spark.sparkContext.broadcast([int(x) for x in m.ravel()])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, above, below, size in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_space(shared.value, d, trace, Fraction(int(above), int(below)), size)
                rows = [pa.array([k], pa.int32()), pa.array([found], pa.list_(pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(rows, ["k", "vectors"])

    wanted = [(k, str(r.numerator), str(r.denominator), size) for k, (r, size) in enumerate(roots)]
    tasks = spark.createDataFrame(wanted, "k int, above string, below string, size int").repartition(len(wanted))
    solved = {r["k"]: r["vectors"] for r in tasks.mapInArrow(solve, "k int, vectors array<array<double>>").collect()}
    for k, (root, size) in enumerate(roots):
        model.eigenvalues += [float(root / n**2)] * size
        model.explained += [float(root / trace)] * size
    model.vectors = np.array([v for k in range(len(roots)) for v in solved[k]])[:components]
    model.eigenvalues, model.explained = model.eigenvalues[:components], model.explained[:components]
    model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    size, project = len(model.eigenvalues), model.project

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            _, _, y = integer_rows(batch.column(0), model.d)
            for lo in range(0, len(y), ROWS):
                w = _floats(model.centred(y[lo : lo + ROWS]), model.n) @ project
                w = np.c_[w, np.ones(len(w))]
                total += w.T @ w
        cells = [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, ["cell", "value"])

    parts = rows.select("vector").mapInArrow(add, "cell int, value double")
    total = np.zeros((size + 1) ** 2)
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # (size + 1)^2 rows
        total[r["cell"]] = r["value"]
    total = total.reshape(size + 1, size + 1) / model.n
    # The vectors are centred; what rounding leaves of their mean is taken off here.
    covariance = total[:size, :size] - np.outer(total[size, :size], total[size, :size])
    return float(np.abs(covariance - np.eye(size)).max())


def transform(
    vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    rows = _rows(vectors, id_column, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    size, wide = len(model.eigenvalues), pa.decimal128(38, 0)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"]

    def deviations(c: np.ndarray) -> pa.Array:
        largest = max(-int(c.min()), int(c.max()))
        if largest**2 * model.d < 1 << 63:
            return pa.array((c.astype(np.int64) ** 2).sum(1)).cast(wide)
        exact = [int(x) for x in (c.astype(object) ** 2).sum(1)]
        return pa.array([x if x < 10**38 else None for x in exact], wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not size:
            return
        project = model.project
        for batch in batches:
            _, kept, y = integer_rows(batch.column(1), model.d)
            for lo in range(0, len(y), OUT_ROWS):
                c = model.centred(y[lo : lo + OUT_ROWS])
                w, row = _floats(c, model.n) @ project, np.repeat(np.arange(len(c)), size)
                out = [
                    batch.column(0).take(pa.array(kept[lo : lo + OUT_ROWS][row])),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(c))),
                    pa.array(np.full(len(row), model.n, np.int64)),
                    deviations(c).take(pa.array(row)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, len(c))),
                    pa.array(np.full(len(row), model.identity_error)),
                    pa.array(np.tile(model.eigenvalues, len(c))),
                ]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double"
    return rows.mapInArrow(run, schema + ", identity_error double, eigenvalue double")


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Fit on all vectors and transform them."""
    return transform(vectors, fit(vectors, components, id_column, vector), id_column, vector)
