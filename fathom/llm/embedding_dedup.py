"""Near-duplicate vectors: tiles in the order of the first principal axis, compared with early stops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import components, cut

#: Vectors in a tile, bins of the first axis for each label, and rows that the axes are fitted on (least hash first).
TILE, BINS, FIT_ROWS = 2048, 4096, 20_000
EPS = 1e-9


def axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling second moment; they only order the work, so a sample will do."""
    if not len(vectors):
        return np.eye(vectors.shape[1])
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, v = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(v[:, ::-1])


def close_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, at_least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) with a cosine of `at_least` or more; same: a is b, and i < j.

    Both are rotated; products of the leading axes come first, and a pair is given up once these plus the product of
    the norms of what is left (Cauchy-Schwarz) can't reach the bound. Within EPS of it the given vectors decide.
    """
    a, b = (v.astype(np.float64) / np.abs(v).max(axis=1, keepdims=True).astype(np.float64) for v in (a, b))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    p, q = x @ rotation, y @ rotation
    dim, lead = p.shape[1], min(8, p.shape[1])
    rest = lambda v, k: np.sqrt(np.maximum(0, (v[:, k:] ** 2).sum(axis=1)))
    part = p[:, :lead] @ q[:, :lead].T
    ok = part + np.outer(rest(p, lead), rest(q, lead)) >= at_least - EPS
    while lead < dim and ok.sum() > ok.size // 20:  # many are left: the next axes for all
        to = min(2 * lead, dim)
        part += p[:, lead:to] @ q[:, lead:to].T
        lead = to
        ok &= part + np.outer(rest(p, lead), rest(q, lead)) >= at_least - EPS
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    out = [], []
    for k in range(0, len(i), 1 << 16):
        ik, jk = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        got = part[ik, jk] + np.einsum("ij,ij->i", p[ik, lead:], q[jk, lead:])
        near = np.flatnonzero(np.abs(got - at_least) < EPS)
        if len(near):
            u, v = a[ik[near]], b[jk[near]]
            got[near] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
        out[0].append(ik[got >= at_least])
        out[1].append(jk[got >= at_least])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n indexes reaches."""
    r = np.arange(n)
    while True:
        m = np.minimum(r[i], r[j])
        s = r.copy()
        for at in (i, j, r[i], r[j]):
            np.minimum.at(s, at, m)
        s = s[s]
        if (s == r).all():
            return r
        r = s


def link_vectors(vectors: DataFrame, at_least: float = 0.98) -> DataFrame:
    """One row per vector: n_links, component_id (the least vec_id reachable by links) and kept.

    Vectors link when their labels and dimensions are equal and their cosine, in double precision, is `at_least` or
    more. Equal vectors become one with a count first, so copies cost nothing. A histogram of the first principal
    axis deals each label's vectors into tiles of about TILE, in that axis's order, hot bins over many tiles; tiles
    that lie further apart on the axis than linked unit vectors can are never met. Of each pair of tiles there come
    link counts and one edge per linked vector, not the pairs. The driver holds one square matrix of axes for each dimension
    that occurs. Vectors of floats are kept as such, all others as doubles; cosines are doubles either way.

    Vectors that are null, empty or zero, hold nulls or non-finite numbers, or have no label or vec_id link with
    nothing. A repeated vec_id gives a row each. Empty tables give no rows; other columns go.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = own.where(fine).withColumn("dim", F.size("embedding"))
    alike = ["label", "dim", "embedding"]
    one = cut(usable.groupBy(*alike).agg(F.min("vec_id").alias("id"), F.count("*").alias("many")))
    dims = [r.dim for r in one.select("dim").distinct().collect()]
    turn = {}
    for d in dims:
        rows = one.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(min(FIT_ROWS, 2_000_000 // d + 1)).select("embedding").toArrow()
        turn[d] = axes(rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
    reach = float(np.sqrt(2 - 2 * at_least)) + 1e-6

    def on_axis(batches):
        for b in batches:
            t = pa.table(b)
            x = np.zeros(t.num_rows)
            dim = t.column("dim").to_numpy()
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                v = t.column("embedding").combine_chunks().take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                axis = turn[int(d)][:, 0]
                x[rows] = (v @ axis) / np.linalg.norm(v, axis=1)
            yield from t.append_column("x", pa.array(x)).to_batches()

    label, item = dict(own.dtypes)["label"], np.float32 if kind == "float" else np.float64
    placed = one.mapInArrow(on_axis, f"label {label}, dim int, embedding array<{kind}>, id long, many long, x double").withColumn("bin", F.floor((F.col("x") + 1) * (BINS / 2)))
    bins = placed.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy("label", "dim").orderBy("bin")) - F.col("n"))
    dealt = placed.join(bins, ["label", "dim", "bin"]).withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))) / TILE))

    def packed(t: pa.Table) -> pa.Table:
        x = t.column("x").to_numpy()
        v = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(item)
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "tile": t.column("tile")[:1], "lo": [x.min()], "hi": [x.max()], "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "many": pa.array([t.column("many").to_numpy().tobytes()], pa.binary()), "data": pa.array([v.tobytes()], pa.binary())})

    tiles = cut(dealt.select("label", "dim", "tile", "x", "id", "many", "embedding").groupBy("label", "dim", "tile").applyInArrow(packed, f"label {label}, dim int, tile long, lo double, hi double, ids binary, many binary, data binary"))
    p, q = tiles.alias("p"), tiles.alias("q")
    met = p.join(q, (F.col("p.label") == F.col("q.label")) & (F.col("p.dim") == F.col("q.dim")) & (F.col("p.tile") <= F.col("q.tile")) & (F.col("q.lo") - F.col("p.hi") <= reach))
    met = met.select("p.dim", (F.col("p.tile") == F.col("q.tile")).alias("same"), F.col("p.ids").alias("i"), F.col("p.many").alias("m"), F.col("p.data").alias("v"), F.col("q.ids").alias("i2"), F.col("q.many").alias("m2"), F.col("q.data").alias("v2"))

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                c = [b.column(k)[r] for k in range(8)]
                d, same = c[0].as_py(), c[1].as_py()
                ids, many = ([np.frombuffer(c[k].as_buffer(), np.int64) for k in ks] for ks in ((2, 5), (3, 6)))
                data = [np.frombuffer(c[k].as_buffer(), item).reshape(-1, d) for k in (4, 7)]
                i, j = close_pairs(*data, turn[d], at_least, same)
                if not len(i):
                    continue
                n = 0 if same else len(ids[0])
                every, count = (ids[0], many[0]) if same else (np.concatenate(x) for x in (ids, many))
                links = np.zeros(len(every), np.int64)
                np.add.at(links, i, count[n + j])
                np.add.at(links, n + j, count[i])
                order = np.argsort(every, kind="stable")
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                root = every[order][roots(len(every), back[i], back[n + j])][back]
                some = links > 0
                yield pa.record_batch({"id": every[some], "n": links[some], "root": root[some]})

    found = cut(met.repartition("i", "i2").mapInArrow(compare, "id long, n long, root long"))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    of = components(found, "id", "root")
    named = one.join(linked, "id", "left").join(of, "id", "left").select(*alike, (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = usable.join(named, alike).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = own.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
