"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import filesystem
from lodestone.plans.storage import fresh_dir

#: Candidates of a block, dimensions of a step, queries whose first step is taken together, candidates that seed a query's bound.
BLOCK, STEP, TOGETHER, SEEDS = 8192, 16, 32, 512
#: Scores are longs.
LONGEST = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector of finite components without null."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))


def matrix(lists, dims: int | None = None):
    """Rows as columns of a (dims, n) matrix; shorter vectors end in zeros."""
    import numpy as np

    dims = dims if dims is not None else max([0, *map(len, lists)])
    out = np.zeros((dims, len(lists)))
    for i, x in enumerate(lists):
        out[: len(x), i] = x[:dims]
    return out


class Blocks:
    """A partition's candidates in vertical layout, dimensions by falling mass."""

    def __init__(self, ids, x):
        import numpy as np

        with np.errstate(over="ignore"):
            self.order = np.argsort(-(x * x).sum(1), kind="stable")
        x = x[self.order]
        kind = "f4" if x.size == 0 or abs(x).max() < 1 << 24 else "f8"
        self.steps = [slice(a, min(a + STEP, len(x))) for a in range(0, len(x), STEP)]
        self.parts = []
        for a in range(0, x.shape[1], BLOCK):
            b = x[:, a : a + BLOCK]
            # mass[s]: length of what is left of a vector after step s; mass[-1]: all of it
            with np.errstate(over="ignore"):
                left = np.array([np.sqrt((b[s.stop :] ** 2).sum(0)) for s in self.steps] + [np.sqrt((b**2).sum(0))])
            self.parts.append((ids[a : a + BLOCK], b.astype(kind), left))


def inner(x, y) -> int:
    """The inner product of two vectors of whole numbers, of any size."""
    return sum([int(a) * int(b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a and b])


def beyond(score: int) -> str | None:
    """Of scores at or beyond the ends of longs: digits that sort as the scores do."""
    return None if -LONGEST - 1 < score < LONGEST else f"{score + (1 << 2300):0580x}"


def seeds(blocks: Blocks, query_ids, q, k: int, slack: float):
    """A score for each query that k candidates of an evenly spread sample of the first block reach: where pruning begins."""
    import numpy as np

    floor = np.full(q.shape[1], -np.inf)
    if not blocks.parts:
        return floor
    ids, x, mass = blocks.parts[0]
    step = max(1, len(ids) // SEEDS)
    some, own = x[:, ::step].astype("f8"), ids[::step]
    for i in range(q.shape[1]) if len(own) > k else ():
        score = q[:, i] @ some
        score = score - slack * np.sqrt(q[:, i] @ q[:, i]) * mass[-1, ::step]
        score = score[own != query_ids[i]]
        if len(score) >= k and np.isfinite(score).all():
            floor[i] = np.partition(score, len(score) - k)[len(score) - k]
    return floor


def best(blocks: Blocks, query_ids, q, k: int, exact: bool = True):
    """(query number, vec_id, score) of the k best candidates of each query (column of q).

    Scores grow step by step; a candidate goes once its score so far and the
    Cauchy-Schwarz bound of the rest are below the query's k-th best score. Sums of
    whole numbers below 2^53 are exact in doubles; the bound has slack for its roots.
    Where sums may be beyond (``exact`` off), each score also has the slack of its
    rounding, and what is left is scored again in whole numbers of any size.
    """
    import numpy as np

    q = q[blocks.order]
    slack = 0.0 if exact else (len(q) + 8) * 2.0**-50
    left = np.array([np.sqrt((q[s.stop :] ** 2).sum(0)) for s in blocks.steps] + [np.sqrt((q**2).sum(0))])
    n = q.shape[1]
    # Of each query's best so far: ids, scores, slack, and (block, place) where they stand.
    got = [(np.empty(0, "i8"), np.empty(0), np.empty(0), np.empty((0, 2), "i8")) for _ in range(n)]
    floor = seeds(blocks, query_ids, q, k, slack)
    for number, (ids, x, mass) in enumerate(blocks.parts):
        first = x[blocks.steps[0]].astype("f8") if blocks.steps else np.zeros((0, len(ids)))
        for a in range(0, n, TOGETHER):
            some = q[blocks.steps[0], a : a + TOGETHER].T @ first if blocks.steps else np.zeros((min(TOGETHER, n - a), len(ids)))
            for j in range(len(some)):
                i = a + j
                score = some[j]
                off = slack * left[-1, i] * mass[-1]
                # Not "below" rather than "at least": a bound beyond doubles is no number and keeps its candidate.
                keep = np.flatnonzero(~(score + off + (left[0, i] * mass[0] * (1 + 1e-9) + 1e-6) < floor[i]))
                score = score[keep]
                for s, step in enumerate(blocks.steps[1:], 1):
                    if not len(keep):
                        break
                    score = score + q[step, i] @ x[step][:, keep].astype("f8")
                    alive = ~(score + off[keep] + (left[s, i] * mass[s][keep] * (1 + 1e-9) + 1e-6) < floor[i])
                    keep, score = keep[alive], score[alive]
                own = ids[keep] != query_ids[i]
                keep, score = keep[own], score[own]
                place = np.stack([np.full(len(keep), number), keep], 1)
                found, score, off, place = (np.concatenate(c) for c in zip(got[i], (ids[keep], score, off[keep], place), strict=True))
                if len(found) > k and exact:
                    top = np.lexsort((found, -score))[:k]
                elif len(found) > k and np.isfinite(low := score - off).all():
                    top = np.flatnonzero(score + off >= np.partition(low, len(low) - k)[len(low) - k])
                else:
                    top = slice(None)
                got[i] = found[top], score[top], off[top], place[top]
                if len(got[i][0]) >= k and np.isfinite(low := got[i][1] - got[i][2]).all():
                    floor[i] = max(floor[i], np.partition(low, len(low) - k)[len(low) - k])
    if exact:
        scores = [s.astype("i8").tolist() for _, s, _, _ in got]
    else:
        scores = [[inner(q[:, i], blocks.parts[b][1][:, c].astype("f8")) for b, c in p.tolist()] for i, (_, _, _, p) in enumerate(got)]
        for i in range(n):
            order = sorted(range(len(scores[i])), key=lambda c: (-scores[i][c], got[i][0][c]))[:k]
            got[i], scores[i] = (got[i][0][order],), [scores[i][c] for c in order]
    return np.repeat(np.arange(n), [len(s) for s in scores]), np.concatenate([*(g[0] for g in got), np.empty(0, "i8")]).astype("i8"), [x for s in scores for x in s]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``.

    A component x counts as floor(scale * x), x as double. A row is no candidate for a
    query of its own id. Equal scores go by lesser vec_id; fewer than k candidates give
    fewer rows. Rows without id, and vectors that are null or hold null, NaN or
    infinity, take no part; shorter vectors end in zeros; equal query rows count once. Vectors
    of any size are ranked by their exact scores; a score that no long holds is given as
    the nearest long. Empty tables give no rows; other columns are ignored.

    The query set is written in files of ``query_rows`` rows; each task keeps its
    partition of the candidates in vertical layout and takes the files one at a time, so
    that memory is bounded by a partition and a file, however many queries there are.
    Tasks give k rows a query, of which Spark keeps k before and after its shuffle.
    """
    spark = vectors.sparkSession
    folder = fresh_dir(spark, "topk-queries")
    quantized(queries, id_col, vector_col).distinct().write.option("maxRecordsPerFile", query_rows).parquet(folder)

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        ids, xs = [], []
        for batch in batches:
            if len(batch):
                ids.append(np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False)))
                xs.append(np.floor(scale * matrix([np.asarray(v) for v in batch.column("v").to_numpy(zero_copy_only=False)])))
        if not ids:
            return
        dims = max(len(x) for x in xs)
        x = np.concatenate([np.pad(x, ((0, dims - len(x)), (0, 0))) for x in xs], 1)
        blocks = Blocks(np.concatenate(ids), x)
        with np.errstate(over="ignore"):
            most = np.sqrt((x * x).sum(0).max()) if x.size else 0.0
        del xs, x
        fs, path = filesystem(folder)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
        for number, file in enumerate(files):
            with fs.open_input_file(file) as f:
                rows = pq.read_table(f)
            if not len(rows):
                continue
            query_ids = rows.column("vec_id").to_numpy()
            q = np.floor(scale * matrix([np.asarray(v) for v in rows.column("v").to_pylist()], dims))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = bool(most * np.sqrt((q * q).sum(0).max()) < 2.0**53)
                at, found, score = best(blocks, query_ids, q, k, exact)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[at]), pa.array(at + number * query_rows), pa.array(found), pa.array([max(-LONGEST - 1, min(LONGEST, x)) for x in score], pa.int64()), pa.array(list(map(beyond, score)), pa.string())],
                ["query_id", "query_row", "vec_id", "score", "beyond"],
            )

    found = quantized(vectors, id_col, vector_col).mapInArrow(task, "query_id long, query_row long, vec_id long, score long, beyond string")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
