"""Near-duplicate vectors by cosine, compared in tiles along principal directions.

Equal vectors of a label become one class first. Unit vectors are turned so that
the directions with most variance come first, and dealt to cells of the leading
two coordinates. Two vectors with cosine c differ by at most sqrt(2 - 2c) in any
coordinate, so only neighbouring cells are compared, tile against tile. A tile
pair adds up products of leading coordinates, bounds the rest by the product of the
vectors' suffix norms, and drops pairs that can no longer reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casoteca.llm.components import components, over_rows
from casoteca.sources.workspace import cut_lineage

#: Vectors of a tile.
TILE = 512
#: Coordinates that are added up before the bound is taken again.
STEP = 8
#: Leading coordinates that make the cells.
CELL_DIMS = 2
#: Cells up to which their sizes go along with the tasks.
FEW_CELLS = 500_000
#: Room for rounding in bounds; the decision itself is made on the vectors as given.
SLACK = 1e-9


def usable(vector: str, label: str) -> Column:
    """Labelled vectors with finite components, not all of them zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) \
        & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _units(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def principal_directions(classes: DataFrame, width: int) -> np.ndarray:
    """Directions of all unit vectors by falling variance; the driver gets one matrix a task."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                unit = _units(_matrix(batch["vector"]))
                total += unit.T @ unit
                seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())],
                                             ["cell", "value"])

    sums = classes.select("vector").mapInArrow(gather, "cell long, value double") \
        .groupBy("cell").agg(F.sum("value").alias("value")).collect()
    matrix = np.zeros(width * width)
    for cell, value in sums:
        matrix[cell] = value
    _, directions = np.linalg.eigh(matrix.reshape(width, width))
    return directions[:, ::-1]


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs whose cosine may reach the threshold, and how many products were added up.

    ``x`` and ``y`` are unit vectors in principal coordinates.
    """
    def rest(m: np.ndarray) -> np.ndarray:
        tail = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate((tail, np.zeros((len(m), 1))), axis=1))

    rx, ry = rest(x), rest(y)
    width = x.shape[1]
    part = x[:, :STEP] @ y[:, :STEP].T
    work = part.size * min(STEP, width)
    i, j = np.nonzero(part + np.outer(rx[:, min(STEP, width)], ry[:, min(STEP, width)]) >= threshold - SLACK)
    total = part[i, j]
    for a in range(STEP, width, STEP):
        b = min(a + STEP, width)
        if not len(i):
            break
        total = total + np.einsum("ij,ij->i", x[i, a:b], y[j, a:b])
        work += len(i) * (b - a)
        keep = total + rx[i, b] * ry[j, b] >= threshold - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    return i, j, work


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, scaled against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that join parts of n nodes not joined before."""
    parent = list(range(n))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return np.array(keep, np.int64)


_TILE = "label string, cell string, width int, tile long, ids binary, sizes binary, vectors binary"


def _compare(threshold: float, directions: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                turn = directions[width]
                sides = []
                for s in "xy":
                    ids = np.frombuffer(row[s + "_ids"], np.int64)
                    sides.append((ids, np.frombuffer(row[s + "_sizes"], np.int64),
                                  np.frombuffer(row[s + "_vectors"], np.float64).reshape(len(ids), width)))
                (a, na, x), (b, nb, y) = sides
                same = row["x_tile"] == row["y_tile"]
                i, j, _ = near_pairs(_units(x) @ turn, _units(y) @ turn, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                ok = _cosines(x[i], y[j]) >= threshold
                i, j = i[ok], j[ok]
                counts_a, counts_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                np.add.at(counts_a, i, nb[j])
                np.add.at(counts_b, j, na[i])
                at = _forest(i, j + (0 if same else len(a)), len(a) + (0 if same else len(b)))
                node = np.concatenate((a[counts_a > 0], b[counts_b > 0], a[i[at]]))
                links = np.concatenate((counts_a[counts_a > 0], counts_b[counts_b > 0],
                                        np.zeros(len(at), np.int64)))
                other = np.concatenate((np.full(len(node) - len(at), -1), b[j[at]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(links), pa.array(other, mask=np.arange(len(node)) < len(node) - len(at))],
                    ["node", "links", "other"])
    return run


def near_vectors(table: DataFrame, threshold: float = 0.93, id_column: str = "vec_id",
                 vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Links between vectors of one label with cosine >= ``threshold``.

    Returns one row per input row: the id, n_links (other vectors linked
    directly), component_id (smallest id reachable), kept (id = component_id).
    Vectors that are NULL, zero or hold NULL or non-finite components, and rows
    without a label, link with nothing; vectors of different lengths never link.
    Rows that share an id are compared like others, row by row; a row without an id gets
    no links. Other columns are not looked at. All pairs of linked vectors are counted inside tile pairs and
    never written out; only a spanning forest of each tile pair is.
    """
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"),
                        F.col(vector_column).cast("array<double>").alias("vector"))
    return over_rows(rows, lambda r: _near_rows(r, threshold)).withColumnRenamed("id", id_column)


def _near_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """``near_vectors`` of rows with unique ids."""
    fit = rows.where(usable("vector", "label") & F.col("id").isNotNull())
    members = cut_lineage(fit.select("id", "label", "vector",
                                     F.transform("vector", lambda x: x + F.lit(0.0)).alias("key")))
    classes = cut_lineage(members.groupBy("label", F.col("key").alias("vector"))
                          .agg(F.min("id").alias("node"), F.count("*").alias("size"))
                          .withColumn("width", F.size("vector")))
    widths = [r[0] for r in classes.select("width").distinct().limit(1001).collect()]
    if len(widths) > 1000:
        raise ValueError("more than 1000 different vector lengths")
    turns = {w: principal_directions(classes.where(F.col("width") == w), w) for w in widths}
    side = float(np.sqrt(2 - 2 * threshold)) + 1e-6 if threshold < 1 else 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.asarray(batch["width"])
            cells = np.zeros((batch.num_rows, CELL_DIMS), np.int64)
            lead = np.zeros(batch.num_rows)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                unit = _units(_matrix(batch["vector"].take(pa.array(mine)))) @ turns[int(w)]
                k = min(CELL_DIMS, int(w))
                cells[mine, :k] = np.floor(unit[:, :k] / side)
                lead[mine] = unit[:, min(k, int(w) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(lead)],
                [*batch.schema.names, "c0", "c1", "lead"])

    placed = cut_lineage(classes.mapInArrow(
        place, "label string, vector array<double>, node long, size long, width int, c0 long, c1 long, lead double"))
    # Rows of a cell get numbers from a hash split, so that a hot cell is numbered by many tasks.
    cell = ["label", "width", "c0", "c1"]
    sized = cut_lineage(placed.groupBy(*cell).agg(F.count("*").alias("n")))
    few = sized.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    dealt = placed.join(F.broadcast(sized) if few else sized, cell).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (TILE // 2)))) \
        .repartition(*cell, "tile")        # a cell's tiles are packed by different tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*cell, "tile")),
                 *(pa.array([x.values.to_numpy(zero_copy_only=False).astype(t).tobytes() for x in batch[c]], pa.binary())
                   for c, t in (("ids", "<i8"), ("sizes", "<i8"), ("flat", "<f8")))],
                [*cell, "tile", "ids", "sizes", "vectors"])

    grouped = dealt.groupBy(*cell, "tile").agg(F.collect_list(F.struct("node", "size", "vector")).alias("rows")) \
        .select(*cell, "tile", F.col("rows.node").alias("ids"), F.col("rows.size").alias("sizes"),
                F.flatten("rows.vector").alias("flat"))
    tiles = cut_lineage(grouped.mapInArrow(
        pack, "label string, width int, c0 long, c1 long, tile long, ids binary, sizes binary, vectors binary"))
    x = tiles.select(*(F.col(c).alias(f"x_{c}") for c in tiles.columns))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("d0"), F.lit(b).alias("d1"))
                                for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) >= (0, 0))))
    y = tiles.select("*", steps.alias("d")).select(
        F.col("label"), F.col("width"), (F.col("c0") + F.col("d.d0")).alias("k0"),
        (F.col("c1") + F.col("d.d1")).alias("k1"), ((F.col("d.d0") == 0) & (F.col("d.d1") == 0)).alias("own"),
        *(F.col(c).alias(f"y_{c}") for c in ("tile", "ids", "sizes", "vectors")))
    pairs = x.join(y, (x.x_label == y.label) & (x.x_width == y.width) & (x.x_c0 == y.k0) & (x.x_c1 == y.k1)) \
        .where(~F.col("own") | (F.col("x_tile") <= F.col("y_tile"))) \
        .select("width", F.when(F.col("own"), F.col("x_tile")).otherwise(F.lit(-1)).alias("x_tile"),
                F.when(F.col("own"), F.col("y_tile")).otherwise(F.lit(-2)).alias("y_tile"),
                *(f"{s}_{c}" for s in "xy" for c in ("ids", "sizes", "vectors")))
    found = cut_lineage(pairs.mapInArrow(_compare(threshold, turns), "node long, links long, other long"))
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    joined = components(links)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    state = classes.join(counts, "node", "left").join(joined, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"))
    per_id = members.join(state.withColumnRenamed("vector", "key"), ["label", "key"]).select("id", "links", "component")
    return rows.select("id").join(per_id, "id", "left").select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"))
