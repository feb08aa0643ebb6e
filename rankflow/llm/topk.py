"""Exact top-k by inner product: ball trees per shard, branch and bound.

Components are turned into integers floor(256 * x), so scores are exact. Candidates make
shards of bounded size where they are read; a ball tree is built for each shard once and
written in the shared folder, as are the queries in blocks. Nothing of either reaches the
driver. A task then holds one tree and streams blocks through it: at each node only those
queries descend whose upper bound

    q . centre + |q| * radius

reaches their current kth score, the child with the larger bound first. The search runs
in rounds. In the first, each block meets one shard, another for each block; in later
ones as many shards as all rounds before times `GROWTH`. Between rounds, the best so far
are merged, and their kth scores go on to the next round's tasks.

Vectors that are null, empty or hold null or non-finite components take no part. Only
vectors of equal length are compared. Every row but those with the query's own id is a
candidate, repeated rows too; ties go to the smaller id. Queries alike in id and vector
are one query; of one id with several vectors, each has its own k rows. Scores past 64
bits are the nearest 64-bit integer. A query with no candidate, and an empty table, have
no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import open_fs, shared_dir, spread, written

SHARD = 8192
BLOCK = 8192
LEAF = 128
GROWTH = 7
NONE = -np.iinfo(np.int64).max
LAST = np.iinfo(np.int64).max
WIDE = 2.0**100


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, v (array<double>) of the vectors that take part."""
    wide = F.col("embedding").cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad).select("vec_id", wide.alias("v"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles; exact below 2**100, where larger ones are cut off."""
    return np.floor(256.0 * np.clip(x, -WIDE, WIDE))


def _exact(row: np.ndarray) -> list[int]:
    """floor(256 * x) of any finite components."""
    return [int(np.floor(256 * v)) if abs(v) < 2.0**52 else 256 * int(v) for v in row.tolist()]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of the integers of two sets of vectors, as 64-bit integers."""
    a, b = integers(queries), integers(vectors)
    high, low = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    large_a, large_b = high >= 2.0**28, low >= 2.0**28
    if large_a.any() or large_b.any():
        a, b = np.where(large_a[:, None], 0, a), np.where(large_b[:, None], 0, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    scores = (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T
    if large_a.any() or large_b.any():
        own, other = [_exact(r) for r in queries], [_exact(r) for r in vectors]
        for i in range(len(own)):
            for j in range(len(other)) if large_a[i] else np.flatnonzero(large_b).tolist():
                scores[i, j] = min(max(sum(x * y for x, y in zip(own[i], other[j], strict=True)), NONE + 1), LAST)
    return scores


class Tree:
    """Ball tree over vectors of integers; nodes split at the median along the widest direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.wide = integers(vectors)
        self.loose = bool(np.abs(vectors).max(initial=0) >= WIDE)  # no bounds then
        self.leaf, self.nodes, rows = leaf, [], []
        self._build(np.arange(len(ids)), rows)
        order = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.ids, self.vectors = ids[order], vectors[order]

    def _build(self, rows: np.ndarray, done: list) -> int:
        points = self.wide[rows]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        radius, node = float(away.max()), len(self.nodes)
        start = sum(map(len, done))
        self.nodes.append([centre, radius, start, start + len(rows), -1, -1])
        if len(rows) <= self.leaf or radius == 0:
            done.append(rows)
            return node
        far = points[away.argmax()]
        other = points[((points - far) ** 2).sum(axis=1).argmax()]
        order = np.argsort((points - centre) @ (other - far), kind="stable")
        half = len(rows) // 2
        self.nodes[node][4] = self._build(rows[order[:half]], done)
        self.nodes[node][5] = self._build(rows[order[half:]], done)
        return node

    def save(self) -> bytes:
        centres = np.array([n[0] for n in self.nodes])
        numbers = np.array([n[2:] for n in self.nodes], np.int64)
        return _packed(ids=self.ids, vectors=self.vectors, centres=centres, radii=np.array([n[1] for n in self.nodes]), numbers=numbers, loose=np.array(self.loose))

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        own, d = cls.__new__(cls), _unpacked(raw)
        own.ids, own.vectors, own.loose = d["ids"], d["vectors"], bool(d["loose"])
        own.nodes = [[c, float(r), *n] for c, r, n in zip(d["centres"], d["radii"], d["numbers"].tolist(), strict=True)]
        return own

    def search(self, best: Best) -> None:
        self._visit(0, np.arange(len(best.ids)), best)

    def _visit(self, at: int, active: np.ndarray, best: Best) -> None:
        centre, radius, a, z, first, second = self.nodes[at]
        bound = best.wide[active] @ centre + best.norm[active] * radius
        bound = bound * (1 + 1e-9) + 1e-3 + 2e-9 * np.abs(bound)
        active = active[(bound >= best.kth[active]) | best.loose[active] | self.loose]
        if not len(active):
            return
        if first < 0:
            best.offer(active, self.ids[a:z], self.vectors[a:z])
            return
        one, two = self.nodes[first], self.nodes[second]
        gain = best.wide[active] @ (one[0] - two[0]) + best.norm[active] * (one[1] - two[1])
        for child, group in ((first, active[gain >= 0]), (second, active), (first, active[~(gain >= 0)])):
            if len(group):
                self._visit(child, group, best)


class Best:
    """The k best candidates of a block of queries in one shard, as far as they reach the kth scores known before."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.wide = integers(vectors)
        self.loose = np.abs(vectors).max(axis=1, initial=0) >= WIDE
        self.norm = np.sqrt((self.wide**2).sum(axis=1))
        self.floor = kth
        self.kth = kth.astype(np.float64)
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), LAST)

    def offer(self, active: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.vectors[active], vectors)
        scores[ids[None, :] == self.ids[active][:, None]] = NONE
        score = np.concatenate([self.score[active], scores], axis=1)
        vec = np.concatenate([self.vec[active], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score[active] = np.take_along_axis(score, order, 1)
        self.vec[active] = np.take_along_axis(vec, order, 1)
        self.kth[active] = np.maximum(self.floor[active], self.score[active][:, -1])

    def frame(self, block: int) -> pd.DataFrame:
        some = (self.score != NONE) & (self.score >= self.floor[:, None])
        rows = np.broadcast_to(np.arange(len(self.ids))[:, None], some.shape)[some]
        return pd.DataFrame({"block": np.full(len(rows), block, np.int64), "row": rows, "query_id": self.ids[rows], "vec_id": self.vec[some], "score": self.score[some]})


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as d:
        return {k: d[k] for k in d.files}


def _read(folder: str, path: str) -> bytes:
    fs, _ = open_fs(folder)
    with fs.open_input_file(path) as source:
        return source.read()


def _save(folder: str, raw: bytes) -> str:
    """Writes a file under a name of its own and returns its path."""
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}.npz"
    with fs.open_output_stream(path) as out:
        out.write(raw)
    return path


def _stored(rows: DataFrame, folder: str, most: int, tree: bool, name: str) -> DataFrame:
    """Files of at most `most` vectors of one length each, made where the rows are: a numbered manifest `at`, dim, path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, list] = {}

        def saved(dim: int) -> pd.DataFrame:
            ids, vectors = zip(*open_.pop(dim), strict=True)
            ids, vectors = np.array(ids, np.int64), np.array(vectors, np.float64)
            raw = Tree(ids, vectors).save() if tree else _packed(ids=ids, vectors=vectors)
            return pd.DataFrame({"dim": [dim], "path": [_save(folder, raw)]})

        for pdf in batches:
            for vec_id, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                own = open_.setdefault(len(v), [])
                own.append((vec_id, v))
                if len(own) >= most:
                    yield saved(len(v))
                elif len(open_) > 8:
                    yield saved(max(open_, key=lambda d: len(open_[d])))
        for dim in list(open_):
            yield saved(dim)

    manifest = written(rows.mapInPandas(run, "dim int, path string"), name)
    return manifest.withColumn("at", F.row_number().over(Window.orderBy("path")) - 1)  # one row per file


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score. Both sides are results of clean_vectors."""
    spark = candidates.sparkSession
    folder = shared_dir(spark, "topk")
    trees = written(_stored(candidates, folder, shard, True, "topk-shards"), "topk-trees")
    asked = written(_stored(queries.dropDuplicates(["vec_id", "v"]), folder, block, False, "topk-blocks"), "topk-queries")
    asked_at = _folder(asked)
    shards, kth_at, best = trees.count(), None, None
    done, more = 0, 1
    while done < max(1, shards):
        new = _round(trees, folder, asked_at, kth_at, shards, done, min(shards, done + more), k)
        rows = new if best is None else best.union(new)
        rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
        best = written(rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "topk-best")
        done, more = done + more, GROWTH * (done + more)
        if done < shards:
            kth_at = _folder(_kth_files(best, folder, k))
    rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score")


def _folder(df: DataFrame) -> str:
    """Where a written table lies."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def _manifest(folder: str) -> pd.DataFrame:
    fs, root = open_fs(folder)
    return pq.read_table(root, filesystem=fs).to_pandas()


def _kth_files(best: DataFrame, folder: str, k: int) -> DataFrame:
    """A file per block with the kth scores of its queries that have k candidates by now: block, path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = _save(folder, _packed(rows=pdf["row"].to_numpy(np.int64), kth=pdf["kth"].to_numpy(np.int64)))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "path": [path]})

    kth = best.groupBy("block", "row").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    return written(kth.groupBy("block").applyInPandas(run, "block long, path string"), "topk-kth")


def _round(trees: DataFrame, folder: str, asked_at: str, kth_at: str | None, shards: int, low: int, high: int, k: int) -> DataFrame:
    """Blocks b against the shards (b + low) .. (b + high - 1), modulo the number of shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = _manifest(asked_at).sort_values("at") if asked_at else pd.DataFrame({"at": [], "dim": [], "path": []})
        blocks = list(zip(asked["at"].tolist(), asked["dim"].tolist(), asked["path"].tolist(), strict=True))
        known = {} if not kth_at else dict(_manifest(kth_at)[["block", "path"]].itertuples(index=False))
        for pdf in batches:
            for row in pdf.itertuples():
                tree = None
                for b, dim, path in blocks:
                    if dim != row.dim or not low <= (row.at - b) % shards < high:
                        continue
                    tree = tree or Tree.load(_read(folder, row.path))
                    own = _unpacked(_read(folder, path))
                    kth = np.full(len(own["ids"]), NONE)
                    if b in known:
                        found = _unpacked(_read(folder, known[b]))
                        kth[found["rows"]] = found["kth"]
                    best = Best(own["ids"], own["vectors"], kth, k)
                    tree.search(best)
                    yield best.frame(b)

    return spread(trees).mapInPandas(run, "block long, row long, query_id long, vec_id long, score long")
