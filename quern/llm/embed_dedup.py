"""Near-duplicate embeddings by a subspace pigeonhole join.

1. Rows with one label and one vector form a class; a class is one row from here on.
2. Unit vectors with cosine t or more have squared distance 2 - 2t at most. A
   fixed random rotation spreads that distance over all coordinates. Rotated
   vectors are split in blocks of 8 coordinates; by pigeonhole a pair within
   the budget has a block within the block's proportional share of it.
3. Each block is range-joined: a grid over the block's first coordinates, with
   cells two radii wide, takes each vector at its home cell and, as a probe, at
   every cell its ball touches. Only pairs within the block's budget come out.
4. The union of the blocks' candidates is verified with the exact cosine, in
   double precision, of vectors brought to one scale by powers of two, so that
   neither tiny nor huge ones lose a link or gain one.

No pair at the threshold can be missed; rounding is covered by a slack in the
block budgets, not in the verification.

Defined cases: a row with a null label or id, or a null, empty or zero vector,
or one with null or non-finite components, links with nothing; vectors of
different length don't link; a row with a null id has a null component and is
kept; a repeated row is another vector; an empty table gives an empty result.
Only the id, the label and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .support import Scratch, components, salted_join

COSINE = 0.98
WIDTH, GRID = 8, 3
SLACK = 1e-5


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20240229 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_cells(unit: np.ndarray, cosine: float):
    """For each block: its coordinates (n, WIDTH), home cells (n, g) and probed cells (n, 2**g, g), and its squared budget."""
    n, d = unit.shape
    turned = unit @ rotation(d)
    for lo in range(0, d, WIDTH):
        part = turned[:, lo : lo + WIDTH]
        w = part.shape[1]
        budget = 2 * (1 - cosine) * w / d + SLACK
        radius = budget**0.5 + SLACK
        x = np.zeros((n, WIDTH), np.float32)
        x[:, :w] = part
        g = min(GRID, w)
        side = 2 * radius
        home = np.floor(x[:, :g].astype(float) / side).astype(np.int64)
        low = np.floor((x[:, :g].astype(float) - radius) / side).astype(np.int64)
        corner = (np.arange(1 << g)[:, None] >> np.arange(g)) & 1
        probes = low[:, None, :] + corner[None]
        # A ball is exactly two cells wide, or three if it touches a third at one point: radius has slack, cells are half open.
        yield x, home, probes, budget


def cell_keys(cells: np.ndarray, block: int, d: int, label: np.ndarray) -> np.ndarray:
    key = K.mix64(label.view(np.uint64) + K.U64(block * 65536 + d))
    for i in range(cells.shape[-1]):
        c = cells[..., i].view(np.uint64)
        key = K.mix64((key[:, None] if c.ndim > key.ndim else key) ^ (c + K.U64((i + 1) * K.BASE % (1 << 64))))
    return key


def _probes(cosine: float):
    def run(batches):
        names = ["cid", "lab", "home", "cell", "budget", *[f"x{i}" for i in range(WIDTH)]]
        for batch in batches:
            cid = batch.column(0).to_numpy(zero_copy_only=False)
            lab = batch.column(1).to_numpy(zero_copy_only=False)
            column = batch.column(2)
            sizes = np.asarray(column.value_lengths())
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                vec = units(flat[at[rows][:, None] + np.arange(d)])
                for block, (x, home, probes, budget) in enumerate(block_cells(vec, cosine)):
                    n, many = probes.shape[:2]
                    for is_home, keys, times in ((True, cell_keys(home, block, d, lab[rows]), 1), (False, cell_keys(probes, block, d, lab[rows]).reshape(-1), many)):
                        cols = [np.repeat(cid[rows], times), np.repeat(lab[rows], times), np.full(n * times, is_home), K.signed(keys), np.full(n * times, budget)]
                        cols += [np.repeat(x[:, i], times) for i in range(WIDTH)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def scaled(v: Column) -> Column:
    """A finite non-zero vector over a power of two, so that its largest component is in [1, 2).

    No digit of it changes, and no sum of squares is too large or too small for a double.
    """
    power = F.floor(F.log2(F.array_max(F.transform(v, F.abs)))).cast("int")
    # In two steps, as the reciprocal of the least double has no place among doubles.
    half = F.floor(-power / F.lit(2.0)).cast("int")
    return F.transform(v, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -power - half))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """One row a vector: key, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("cid", F.when(sound, F.xxhash64("label", "v")))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"), F.first(F.xxhash64("label")).alias("lab"))
    classes = scratch.save(classes.withColumn("v", scaled(F.col("v"))))
    schema = "cid long, lab long, home boolean, cell long, budget double, " + ", ".join(f"x{i} float" for i in range(WIDTH))
    cells = scratch.save(classes.select("cid", "lab", "v").mapInArrow(_probes(cosine), schema))
    a, b = cells.where("home").alias("a"), cells.where("not home").alias("b")
    gap = sum(((F.col(f"a.x{i}") - F.col(f"b.x{i}")) * (F.col(f"a.x{i}") - F.col(f"b.x{i}")) for i in range(1, WIDTH)), (F.col("a.x0") - F.col("b.x0")) * (F.col("a.x0") - F.col("b.x0")))
    near = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.lab") == F.col("b.lab")) & (gap <= F.col("a.budget"))
    pairs = a.join(b, near).select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).distinct()
    x, y = classes.select(F.col("cid").alias("u"), F.col("v").alias("x")), classes.select(F.col("cid").alias("v"), F.col("v").alias("y"))

    def dot(p: str, q: str):
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)

    cos = dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    links = scratch.save(pairs.join(x, "u").join(y, "v").where(cos >= cosine).select("u", "v"))
    sizes = classes.select("cid", "m", "rep")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(sizes, F.col("v") == F.col("cid")).groupBy("u").agg(F.sum("m").alias("others"))
    comp = components(scratch, links)
    # A component is named by a class; its id is the least id of all its classes.
    least = comp.join(sizes, F.col("node") == F.col("cid")).groupBy("component_id").agg(F.min("rep").alias("least"))
    head = salted_join(comp, least, "component_id", F.col("node"), "inner").select("node", "least")
    classes2 = sizes.join(others, F.col("cid") == F.col("u"), "left").join(head, F.col("cid") == F.col("node"), "left")
    classes2 = classes2.select("cid", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("id", "cid").join(classes2, "cid", "left")
    cid = F.when(F.col("cid").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"))
