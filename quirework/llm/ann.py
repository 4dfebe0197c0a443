"""Approximate nearest neighbours: score-aware (anisotropic) quantisation with exact reranking.

Vectors are scaled to length 1, so the largest cosine is the largest inner product. A coarse k-means
deals them to cells; what is left after the cell's centre is coded with 4 bits for each group of
``SUB`` dimensions. Codes and codebooks minimise an error that weighs the part parallel to the
vector ``eta`` times as much as the rest, since only that part changes large inner products.

A query looks up one table of 16 entries for each group (rounded to 8 bits) to scan a cell's codes
and scores the ``rerank`` best of each block exactly, in double precision, on the original vectors.

Codes of rows that lie close together say little about their order, so each row keeps the length of what
its code leaves out, each cell that of its farthest row. A cosine is at most what the code says plus that
length: rows and cells that could still pass the k-th best found are looked into too, so none of the k
nearest is missed, however the vectors lie. Each query starts with its k-th best among the sample.

All is fitted on at most ``sample`` vectors; every row is indexed. Of rows with the same vector only
the ``k`` + 1 least ids can ever be returned, so the rest is not indexed (an exact saving: ties go to
the smaller id). Cells are cut into blocks of at most ``block`` rows, a cell's queries into parts, so no
task holds a whole cell, however large.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
dimension is not the table's most common one. Rows that repeat an id count as one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUB = 2
SAMPLE = 20_000
BLOCK = 8192
QUERIES = 2048
SLACK = 1e-9  # what rounding may add to a bound


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part. Where an id repeats its least vector counts, and
    only vectors of the commonest length do, as cosines of others with them aren't defined."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    inf = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    v = v.filter(fine & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (size[0] if size else 0))


@dataclass
class Codec:
    """Centres and books; ``decoded`` gives what codes stand for, without the centre."""

    centres: np.ndarray  # cells x d
    books: np.ndarray  # groups x 16 x SUB
    width: int  # d, padded to whole groups
    eta: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n centres of largest inner product with each row."""
        s = x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)
        n = min(n, s.shape[1])
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (one of 16 for each group) by coordinate descent on the anisotropic error."""
        return _encode(self.padded(x), self.padded(x - self.centres[cell]), self.books, self.eta, sweeps)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books))[None], codes].reshape(len(codes), -1)


def _encode(x: np.ndarray, rest: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    n, groups = len(x), books.shape[0]
    xs, rs = x.reshape(n, groups, SUB), rest.reshape(n, groups, SUB)
    codes = np.zeros((n, groups), np.uint8)
    parallel = np.zeros((n, groups))
    for sweep in range(sweeps + 1):
        for g in range(groups):
            err = rs[:, g, None, :] - books[g][None]  # n x 16 x SUB
            own = (err**2).sum(axis=2)
            along = (err * xs[:, g, None, :]).sum(axis=2)
            others = (parallel.sum(axis=1) - parallel[:, g])[:, None] if sweep else 0.0
            pick = (own + (eta - 1) * (others + along) ** 2 if sweep else own).argmin(axis=1)
            codes[:, g] = pick
            parallel[:, g] = along[np.arange(n), pick]
    return codes


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def train(x: np.ndarray, cells: int, threshold: float = 0.2, rounds: int = 4, seed: int = 5) -> Codec:
    """``x``: sampled vectors of length 1. ``threshold``: inner products above it matter."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    width = -(-d // SUB) * SUB
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    centres = _kmeans(x, min(cells, len(x)), rng)
    codec = Codec(centres, np.zeros((width // SUB, 16, SUB)), width, eta)
    cell = codec.cells(x, 1)[:, 0]
    xp, rp = codec.padded(x), codec.padded(x - centres[cell])
    xs, rs = xp.reshape(len(x), -1, SUB), rp.reshape(len(x), -1, SUB)
    for g in range(width // SUB):
        codec.books[g] = _kmeans(rs[:, g], 16, rng, 8)
    for _ in range(rounds):
        codes = _encode(xp, rp, codec.books, eta, 1)
        chosen = codec.books[np.arange(width // SUB)[None], codes]
        parallel = ((rs - chosen) * xs).sum(axis=2)
        total = parallel.sum(axis=1)
        for g in range(width // SUB):
            outer = (eta - 1) * xs[:, g, :, None] * xs[:, g, None, :] + np.eye(SUB)
            right = np.einsum("nij,nj->ni", outer, rs[:, g]) + (eta - 1) * (total - parallel[:, g])[:, None] * xs[:, g]
            for code in range(16):
                own = codes[:, g] == code
                if own.any():
                    codec.books[g, code] = np.linalg.solve(outer[own].sum(axis=0), right[own].sum(axis=0))
    return codec


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def search(vectors: DataFrame, is_query: Column, k: int = 5, share: float = 0.8, rerank: int = 48, sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by cosine.

    ``share``: part of the cells that a query looks into whatever their bounds, nearest first; ``rerank``: rows of a
    block that it scores whatever theirs.
    """
    rows = usable(vectors)
    total = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit("ann")), "vec_id").limit(sample).collect() if total else []
    shape = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return vectors.sparkSession.createDataFrame([], shape)
    x = _unit(np.array([r[1] for r in picked]))
    d = x.shape[1]
    cells = int(min(4096, max(1, round(np.sqrt(total) / 4))))
    codec = train(x, cells)
    cells = len(codec.centres)
    probes = min(cells, max(1, -(-int(cells * share * 100) // 100)))
    context = vectors.sparkSession.sparkContext
    held, sampled = context.broadcast(codec), context.broadcast((np.array([r[0] for r in picked]), x))

    def surely(ids: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A score that k other rows reach: the k-th best of the sample."""
        own, known = sampled.value
        if len(own) <= k:
            return np.full(len(u), -np.inf)
        out = []
        for at in range(0, len(u), 64):
            s = u[at : at + 64] @ known.T
            s[ids[at : at + 64, None] == own[None]] = -np.inf
            out.append(np.partition(s, -k, axis=1)[:, -k])
        return np.concatenate(out)

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                u = _unit(_matrix(part.column(1), d))
                cell = m.cells(u, 1)[:, 0]
                codes = m.encode(u, cell)
                rest = u - m.centres[cell]
                far, left_out = np.linalg.norm(rest, axis=1), np.linalg.norm(m.padded(rest) - m.decoded(codes), axis=1)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = pa.array([c.tobytes() for c in codes[:, ::2] | codes[:, 1::2] << 4], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), packed, pa.array(left_out), pa.array(far)], names=["vec_id", "v", "cell", "codes", "left_out", "far"])

    def asking(reach: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    u = _unit(_matrix(part.column(1), d))
                    least = surely(part.column(0).to_numpy(), u)
                    look = u @ m.centres.T + reach[None] >= least[:, None] - SLACK
                    np.put_along_axis(look, m.cells(u, probes), True, 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least), pa.array([np.flatnonzero(r).astype(np.int32) for r in look], pa.list_(pa.int32()))], names=["vec_id", "v", "least", "cells"])

        return run

    # the k + 1 least ids of each distinct vector; Spark keeps that many in each task before it deals them out
    least = Window.partitionBy("v").orderBy("vec_id")
    base = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).drop("n")
    coded = base.mapInArrow(coding, "vec_id long, v array<double>, cell int, codes binary, left_out double, far double")
    held_by = {r[0]: (r[1], r[2]) for r in coded.groupBy("cell").agg(F.count("*"), F.max("far")).collect()}  # at most one row for each cell
    sizes = {c: n for c, (n, _) in held_by.items()}
    reach = np.array([held_by[c][1] if c in held_by else -np.inf for c in range(cells)])
    asked = rows.filter(is_query).mapInArrow(asking(reach), "vec_id long, v array<double>, least double, cells array<int>").select("vec_id", "v", "least", F.explode("cells").alias("cell"))

    loads = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}
    counts = F.array(*[F.lit(max(1, -(-sizes.get(c, 0) // block))) for c in range(cells)])
    parts = F.array(*[F.lit(max(1, -(-loads.get(c, 0) // queries))) for c in range(cells)])
    salt = F.xxhash64("vec_id")
    coded = coded.drop("far").withColumn("block", F.pmod(salt, F.get(counts, F.col("cell"))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
    asked = asked.withColumn("part", F.pmod(salt, F.get(parts, F.col("cell"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.get(counts, F.col("cell")) - 1)))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if left.num_rows and right.num_rows:
            m = held.value
            ids = left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            original = _matrix(left["v"].combine_chunks(), d)[order]
            packed = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(ids), -1)
            scale = np.abs(original).max(axis=1, keepdims=True)
            norms = np.linalg.norm(original / scale, axis=1) * scale[:, 0]
            left_out, centre = left["left_out"].to_numpy()[order], m.centres[left["cell"][0].as_py()]
            asked_ids, asked_v = right["vec_id"].to_numpy(), _matrix(right["v"].combine_chunks(), d)
            for q, v, least in zip(asked_ids, asked_v, right["least"].to_numpy(), strict=True):
                size = np.abs(v).max()
                length = np.linalg.norm(v / size) * size

                def exactly(rows: np.ndarray) -> np.ndarray:
                    return (original[rows] @ v) / (norms[rows] * length)  # noqa: B023

                if len(ids) > rerank:
                    unit = _unit(v[None])
                    tables = np.einsum("gks,gs->gk", m.books, m.padded(unit)[0].reshape(-1, SUB))
                    step = max(1e-12, float(np.abs(tables).max()) / 127)
                    table = np.round(tables / step).astype(np.int32)
                    guess = np.zeros(len(ids), np.int32)
                    for g in range(len(table)):
                        guess += table[g][codes[:, g]]
                    cut = np.partition(guess, len(guess) - rerank)[len(guess) - rerank]
                    above, level = np.flatnonzero(guess > cut), np.flatnonzero(guess == cut)
                    best = np.concatenate([above, level[: rerank - len(above)]])
                    known = exactly(best[ids[best] != q])
                    if len(known) >= k:
                        least = max(least, np.partition(known, -k)[-k])
                    most = float(unit[0] @ centre) + guess * step + len(table) * step / 2 + left_out
                    could = most >= least - SLACK
                    could[best] = True
                    best = np.flatnonzero(could)
                else:
                    best = np.arange(len(ids))
                best = best[ids[best] != q]
                score = exactly(best)
                top = np.lexsort((ids[best], -score))[:k]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q)), pa.array(ids[best][top]), pa.array(score[top])], names=["query_id", "vec_id", "score"]))
        none = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, none) if out else none.empty_table()

    keys = ["cell", "block", "part"]
    found = coded.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
