"""Fit of the policy network, by matrix products over stored blocks of rows.

Network, loss, block means, optimiser and its limits are those of Spark's
``MultilayerPerceptronClassifier``: sigmoid layers, softmax with cross entropy,
L-BFGS with a strong Wolfe line search.  What differs is where the time goes:
the rows are stored once as plain numbers, and a pass multiplies them a few
hundred at a time in a numeric library.  A pass is one job; its sums are as
large as the network, whatever the number of rows.
"""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.runtime import cut_lineage

# Rows of a block, whose mean counts once; rows that are multiplied at a time.
BLOCK = 128
STEP_ROWS = 256
# Bytes of a stored piece; partial sums that the driver adds by itself.
PIECE_BYTES = 64 << 10
FEW_SUMS = 64
# Bytes that go to a worker at a time: what stays in the caches is read faster.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# Fixed values of the optimiser.
CORRECTIONS = 10
TOLERANCE = 1e-6
LOSSES = 20
SEARCH_STEPS = 10
DECREASE, CURVATURE = 1e-4, 0.9

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


# ---- rows ------------------------------------------------------------------
def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a null or a vector of another length is an error."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count or not pc.all(pc.equal(pc.list_value_length(vectors), width)).as_py():
        raise ValueError(f"every vector needs {width} numbers")
    values = vectors.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold nulls")
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def stored_blocks(data: DataFrame, vector: Column, label: Column, width: int, classes: int) -> DataFrame:
    """Rows as plain numbers, stored once; ``rows`` are those of a piece's block.

    Blocks are cut partition by partition, so the last of each may be shorter.
    """
    piece = max(1, min(BLOCK, PIECE_BYTES // (8 * width)))

    def pieces(x: np.ndarray, y: np.ndarray, block: int) -> pa.RecordBatch:
        starts = (np.arange(0, len(y), block)[:, None] + np.arange(0, block, piece)).ravel()
        bounds = np.append(starts, len(y)).astype(np.int32)

        def binary(numbers: np.ndarray, size: int) -> pa.Array:
            held = [None, pa.py_buffer(bounds * np.int32(size)), pa.py_buffer(np.ascontiguousarray(numbers))]
            return pa.Array.from_buffers(pa.binary(), len(starts), held)

        rows = pa.array(np.full(len(starts), block, np.int32))
        return pa.RecordBatch.from_arrays(
            [rows, binary(y, 1), binary(x, 8 * width)], names=["rows", "labels", "vectors"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.empty((0, width)), np.empty(0, np.uint8)
        for batch in batches:
            new, labels = matrix(batch.column(0), width), batch.column(1)
            if not np.isfinite(new).all():
                raise ValueError("vectors must hold finite numbers")
            if labels.null_count:
                raise ValueError("every row needs a label")
            codes = labels.to_numpy()
            if len(codes) and not 0 <= codes.min() <= codes.max() < classes:
                raise ValueError(f"labels must be below {classes}")
            x, y = np.concatenate([x, new]), np.concatenate([y, codes.astype(np.uint8)])
            whole = len(y) // BLOCK * BLOCK
            if whole:
                yield pieces(x[:whole], y[:whole], BLOCK)
                x, y = x[whole:], y[whole:]
        if len(y):
            yield pieces(x, y, len(y))

    asked = data.select(vector.cast("array<double>").alias("vector"), label.cast("int").alias("label"))
    return cut_lineage(asked.mapInArrow(pack, "rows int, labels binary, vectors binary"))


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers of the pieces of a batch, without a copy."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind)


# ---- network ---------------------------------------------------------------
ONES = np.ones(STEP_ROWS)


class Network:
    """Layers with room for the outputs of one step."""

    def __init__(self, layers: Sequence[int], weights: np.ndarray):
        self.weights, self.biases = [], []
        shapes = list(zip(layers, layers[1:]))
        at = 0
        for inputs, outputs in shapes:
            end = at + inputs * outputs
            self.weights.append(weights[at:end].reshape(inputs, outputs))
            self.biases.append(weights[end : end + outputs])
            at = end + outputs
        # Sigmoids need the negative sum: the sign goes into the layer.
        self.falling = [(-w, -b) for w, b in zip(self.weights[:-1], self.biases[:-1])]
        self.outputs = [np.empty((STEP_ROWS, n)) for n in layers[1:-1]]
        self.deltas = [np.empty((STEP_ROWS, n)) for n in layers[1:-1]]
        self.slopes = [np.empty((STEP_ROWS, n)) for n in layers[1:-1]]
        self.products = [np.empty(shape) for shape in shapes]
        self.gradients = [np.zeros(shape) for shape in shapes]
        self.bias_gradients = [np.zeros(n) for n in layers[1:]]
        self.loss = 0.0

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs of every layer and the sums of the last, a row for each class."""
        inputs = [x]
        for (weights, bias), room in zip(self.falling, self.outputs):
            out = room[: len(x)]
            np.matmul(inputs[-1], weights, out=out)
            out += bias
            np.exp(out, out=out)
            out += 1.0
            np.divide(1.0, out, out=out)
            inputs.append(out)
        return inputs, self.weights[-1].T @ inputs[-1].T + self.biases[-1][:, None]

    def classes(self, x: np.ndarray) -> np.ndarray:
        """Class with the largest sum of every row, ties to the first."""
        found = np.zeros(len(x), np.int32)
        for start in range(0, len(x), STEP_ROWS):
            sums = self.forward(x[start : start + STEP_ROWS])[1]
            most = sums[0].copy()
            for k in range(1, len(sums)):
                larger = sums[k] > most
                most[larger] = sums[k][larger]
                found[start : start + STEP_ROWS][larger] = k
        return found

    def add(self, x: np.ndarray, targets: np.ndarray, shares: np.ndarray) -> None:
        """Add loss and gradient of some rows, each with its share of its block.

        ``targets`` has a row for each class.
        """
        inputs, sums = self.forward(x)
        sums -= sums.max(axis=0)
        chances = np.exp(sums, out=sums)
        chances /= chances.sum(axis=0)
        self.loss -= float((targets * np.log(chances)).sum(axis=0) @ shares)
        delta = ((chances - targets) * shares).T
        for i in range(len(self.weights) - 1, -1, -1):
            np.matmul(inputs[i].T, delta, out=self.products[i])
            self.gradients[i] += self.products[i]
            self.bias_gradients[i] += ONES[: len(x)] @ delta
            if i:
                out, slope = self.deltas[i - 1][: len(x)], self.slopes[i - 1][: len(x)]
                np.matmul(delta, self.weights[i].T, out=out)
                np.multiply(inputs[i], inputs[i], out=slope)
                np.subtract(inputs[i], slope, out=slope)
                out *= slope
                delta = out

    def gradient(self) -> np.ndarray:
        both = zip(self.gradients, self.bias_gradients)
        return np.concatenate([part.ravel() for pair in both for part in pair])


def predicted(layers: Sequence[int], weights: np.ndarray, vector: Column) -> Column:
    """Class of every vector."""
    layers = list(layers)

    @F.arrow_udf("int")
    def classes(vectors: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return pa.array(Network(layers, weights).classes(matrix(vectors, layers[0])))

    return classes(vector.cast("array<double>"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send at most ``BATCH_BYTES`` at a time; the setting is put back."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


SUMS = "part int, blocks double, loss double, gradient binary"


def summed(blocks: DataFrame, layers: Sequence[int], few: int = FEW_SUMS) -> Objective:
    """Mean loss of all blocks and its gradient at any weights, each one job."""
    layers = list(layers)
    parts = blocks.rdd.getNumPartitions()

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            network, share, each = Network(layers, weights), 0.0, np.eye(layers[-1])
            with np.errstate(all="ignore"):
                for batch in batches:
                    y = numbers(batch.column(1), np.uint8)
                    x = numbers(batch.column(2), np.float64).reshape(len(y), layers[0])
                    sizes = pc.binary_length(batch.column(1)).to_numpy()
                    shares = np.repeat(1.0 / batch.column(0).to_numpy(), sizes)
                    share += shares.sum()
                    for start in range(0, len(y), STEP_ROWS):
                        rows = slice(start, start + STEP_ROWS)
                        network.add(x[rows], each[:, y[rows]], shares[rows])
            values = [[TaskContext.get().partitionId()], [share], [network.loss], [network.gradient().tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.float64(), pa.float64(), pa.binary()))],
                names=["part", "blocks", "loss", "gradient"],
            )

        def together(sums: pa.Table) -> pa.Table:
            rows = sorted(sums.to_pylist(), key=lambda r: r["part"])
            count, loss, gradient = total(rows)
            first = {"part": rows[0]["part"], "blocks": count, "loss": loss, "gradient": gradient.tobytes()}
            return pa.Table.from_pylist([first], schema=sums.schema)

        sums = blocks.mapInArrow(work, SUMS)
        if parts > few:
            sums = sums.groupBy(F.col("part") % isqrt(parts)).applyInArrow(together, SUMS)
        with small_batches(blocks.sparkSession):
            rows = sums.collect()
        count, loss, gradient = total(sorted(rows, key=lambda r: r["part"]))
        count = round(count)
        return (loss / count, gradient / count) if count else (float("nan"), gradient)

    def total(rows: Sequence) -> tuple[float, float, np.ndarray]:
        size = sum((a + 1) * b for a, b in zip(layers, layers[1:]))
        gradient, count, loss = np.zeros(size), 0.0, 0.0
        for row in rows:
            gradient += np.frombuffer(row["gradient"], np.float64)
            count, loss = count + row["blocks"], loss + row["loss"]
        return count, loss, gradient

    return at


# ---- optimiser -------------------------------------------------------------
class SearchFailed(Exception):
    """No step along a direction meets the conditions."""


def minimised(objective: Objective, start: np.ndarray, max_iter: int) -> np.ndarray:
    """L-BFGS from ``start``: the weights at its end.

    It ends after ``max_iter`` steps, when the loss has not changed over the
    last ``LOSSES`` of them, when the gradient is small, or when the search
    fails twice in a row, the second time without history.
    """
    x, (loss, slope) = start, objective(start)
    first, losses = loss, [float("inf")]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed = False
    done = 0
    while done < max_iter:
        if len(losses) > 1 and abs(loss - max(losses)) <= TOLERANCE * first:
            break
        if np.linalg.norm(slope) <= max(TOLERANCE * loss, 1e-8):
            break
        try:
            way = _direction(slope, steps, changes)
            step, new_x, new_loss, new_slope = _strong_wolfe(
                objective, x, way, loss, slope, 1.0 if done else 1.0 / np.linalg.norm(way)
            )
            if step * np.linalg.norm(slope) < 1e-10:
                raise SearchFailed("the step is too short")
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        steps = [new_x - x, *steps][:CORRECTIONS]
        changes = [new_slope - slope, *changes][:CORRECTIONS]
        x, loss, slope = new_x, new_loss, new_slope
        losses = [*losses, loss][-LOSSES:]
        failed = False
        done += 1
    return x


def _direction(slope: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Downhill by the inverse curvature that the last steps show."""
    scale = 1.0
    if steps:
        curved = steps[0] @ changes[0]
        if not curved >= 0:
            raise SearchFailed("the history bends the wrong way")
        scale = curved / (changes[0] @ changes[0])
    way = slope.copy()
    products, shares = [], []
    for step, change in zip(steps, changes):
        products.append(step @ change)
        shares.append((step @ way) / products[-1])
        if np.isnan(shares[-1]):
            raise SearchFailed("the history has no number")
        way -= shares[-1] * change
    way *= scale
    for step, change, product, share in reversed([*zip(steps, changes, products, shares)]):
        way += (share - (change @ way) / product) * step
    return -way


def _strong_wolfe(
    objective: Objective, x: np.ndarray, way: np.ndarray, loss: float, slope: np.ndarray, length: float
) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Length of a step that meets the strong Wolfe conditions, and what is there."""
    fall = slope @ way
    if fall > 0:
        raise SearchFailed("the direction leads uphill")

    def look(t: float) -> tuple[float, float, float]:
        nonlocal found
        at = x + way * t
        value, gradient = objective(at)
        found = (t, at, value, gradient)
        return t, value, gradient @ way

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(SEARCH_STEPS):
            now = look(_cubic(*sorted((low, high), key=lambda end: end[0])))
            t, value, rise = now
            if value > loss + DECREASE * t * fall or value >= low[1]:
                high = now
                continue
            if abs(rise) <= CURVATURE * abs(fall):
                return found
            if rise * (high[0] - low[0]) >= 0:
                high = low
            low = now
        raise SearchFailed("no point in the interval fits")

    found: tuple = ()
    low, t = (0.0, loss, fall), length
    for tried in range(SEARCH_STEPS):
        now = look(t)
        _, value, rise = now
        if not np.isfinite(value):
            t /= 2.0
            continue
        if value > loss + DECREASE * t * fall or (value >= low[1] and tried):
            return zoom(low, now)
        if abs(rise) <= CURVATURE * abs(fall):
            return found
        if rise >= 0:
            return zoom(now, low)
        low = now
        t *= 1.5
    raise SearchFailed("no step fits")


def _cubic(left: tuple[float, float, float], right: tuple[float, float, float]) -> float:
    """Least point of the cubic through both ends, kept off them."""
    (a, value_a, rise_a), (b, value_b, rise_b) = np.array([left, right])
    with np.errstate(all="ignore"):
        d1 = rise_a + rise_b - 3 * (value_a - value_b) / (a - b)
        d2 = np.sqrt(d1 * d1 - rise_a * rise_b)
        t = b - (b - a) * (rise_b + d2 - d1) / (rise_b - rise_a + 2 * d2)
    lowest, highest = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return float(lowest if t < lowest else highest if t > highest else t)
