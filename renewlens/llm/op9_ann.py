"""Nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation of the principal axes, several
rotations side by side). A code is cut into substrings and each block of the table indexes every
substring. A query probes, in each substring, the buckets within radius // substrings bits; by the
pigeonhole principle that retrieves every code within the Hamming radius. Those codes are checked in
full and their vectors reranked by exact inner product in double precision. If a block holds fewer
than k codes within the radius, the radius is widened there until it does.

Rotations and radius are fitted on at most ``SAMPLE`` vectors (first in hash order); the radius is
that which holds ``COVER`` of the sample's own k nearest pairs. In a larger table the k nearest are
nearer, so recall does not fall. Every vector is indexed. Vectors of other lengths than the largest
get one more coordinate that makes all lengths equal, so that angle order is inner-product order.

The table is cut into blocks of about ``BLOCK`` vectors and the queries likewise; each pair of blocks
is one row of a join on the block number, and only its k best per query leave the task.

Defined results: vectors that are null, zero, hold nulls or non-finite numbers, or do not have the
most frequent dimension take no part; equal vec_ids are rows of their own, and a query finds every row
but those with its own id; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import table
from renewlens.session import stage

SAMPLE = 20_000
BITS = 256
SUBSTRING = 16
COVER = 0.97
BLOCK = 8192
QUERY_BLOCK = 1024
K = 20


@dataclass(frozen=True)
class Codes:
    rotation: np.ndarray  # (dimension + 1) x bits
    longest: float
    radius: int

    def encode(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Codes as 16-bit substrings, rows x substrings."""
        squares = (vectors * vectors).sum(1)
        if queries:
            scale = self.longest / np.sqrt(squares)
            full = np.c_[vectors * scale[:, None], np.zeros(len(vectors))]
        else:
            full = np.c_[vectors, np.sqrt(np.maximum(self.longest**2 - squares, 0))]
        return np.packbits(full @ self.rotation > 0, axis=1).view(np.uint16)


def _rotations(points: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Principal axes turned so that signs lose least, in as many independent turns as the bits need."""
    rng = np.random.default_rng(7)
    _, axes = np.linalg.eigh(points.T @ points)
    reduced = points @ axes
    out, d = [], points.shape[1]
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(reduced @ turn).T @ reduced)
            turn = (u @ v).T
        # the least axis comes first: the added coordinate of vectors that are all of one length
        out.append(axes @ turn)
    return np.concatenate(out, 1)[:, :bits]


def fit(sample: np.ndarray, longest: float, *, bits: int = BITS, k: int = K, cover: float = COVER) -> Codes:
    squares = (sample * sample).sum(1)
    points = np.c_[sample, np.sqrt(np.maximum(longest**2 - squares, 0))]
    rotation = _rotations(points, bits)
    codes = Codes(rotation, longest, bits)
    index, some = codes.encode(sample), np.arange(0, len(sample), max(1, len(sample) // 400))
    asked = codes.encode(sample[some], queries=True)
    far = []
    for i, q in zip(some, asked):
        near = sample @ sample[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(sample) - 1)]
        far.append(np.bitwise_count(index[best] ^ q).sum(1))
    far = np.concatenate(far) if far else np.zeros(0)
    return Codes(rotation, longest, int(np.quantile(far, cover, method="higher")) if len(far) else bits)


class Block:
    """The substring indexes of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.bits = codes.encode(vectors)
        self.index = []
        for s in range(self.bits.shape[1]):
            order = np.argsort(self.bits[:, s], kind="stable")
            values, first, counts = np.unique(self.bits[order, s], return_index=True, return_counts=True)
            self.index.append((values, first, counts, order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius of the query's."""
        reach = radius // len(query)
        marked = np.zeros(len(self.ids), bool)
        for q, (values, first, counts, order) in zip(query, self.index):
            hit = np.flatnonzero(np.bitwise_count(values ^ q) <= reach)
            n = counts[hit]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            marked[order[np.repeat(first[hit], n) + inside]] = True
        found = np.flatnonzero(marked)
        return found[np.bitwise_count(self.bits[found] ^ query).sum(1) <= radius]

    def nearest(self, own: int, vector: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best of this block, the query's own id left out."""
        radius, most = self.codes.radius, len(query) * 16
        while True:
            found = self.within(query, radius)
            found = found[self.ids[found] != own]
            if len(found) >= k or radius >= most:
                break
            radius = min(most, radius + len(query))
        scores = (self.vectors[found] * vector).sum(1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    whole = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(
        "vec_id is not null and embedding is not null"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    sizes = whole.groupBy(F.size("embedding").alias("d")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("embedding") == (best.d if best else 0))


def _packed(rows: DataFrame, blocks: int, salt: int, names: tuple[str, str, str]) -> DataFrame:
    """One row per block: its number, the ids and the vectors as bytes. A block is about one chunk of rows."""
    number, ids, vectors = names

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        flat = pa.concat_arrays([c.flatten() for c in group.column("embedding").chunks])
        return pa.table(
            {
                number: pa.array([group.column("block")[0].as_py()], pa.int32()),
                ids: pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()),
                vectors: pa.array([np.asarray(flat, np.float64).tobytes()], pa.binary()),
            }
        )

    block = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")
    grouped = rows.select(block.alias("block"), "vec_id", "embedding").groupBy("block")
    return grouped.applyInArrow(pack, f"{number} int, {ids} binary, {vectors} binary")


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = K, bits: int = BITS, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to every query; both are from :func:`usable`."""
    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    totals = vectors.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    asked = queries.count()
    if not totals.n or not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    some = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    codes = fit(np.array([r.embedding for r in some]), float(np.sqrt(totals.square)), bits=bits, k=k)
    sent = spark.sparkContext.broadcast(codes)

    n_blocks, n_asked = -(-totals.n // block), -(-asked // QUERY_BLOCK)
    index = stage(_packed(vectors, n_blocks, 1, ("block", "ids", "vectors")), "vector-blocks")
    questions = stage(_packed(queries, n_asked, 2, ("q_block", "q_ids", "q_vectors")), "query-blocks")
    # every block of queries goes to every block of vectors, by number
    dealt = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = index.join(dealt, "block").select("block", "ids", "vectors", "q_ids", "q_vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here, ids, vecs, q_ids, q_vecs = (batch.column(c)[i].as_py() for c in range(5))
                if here != number:
                    ids = np.frombuffer(ids, np.int64)
                    number, held = here, Block(ids, np.frombuffer(vecs).reshape(len(ids), -1), sent.value)
                q_ids = np.frombuffer(q_ids, np.int64)
                q_vecs = np.frombuffer(q_vecs).reshape(len(q_ids), -1)
                q_codes = sent.value.encode(q_vecs, queries=True)
                got = [held.nearest(q, v, c, k) for q, v, c in zip(q_ids.tolist(), q_vecs, q_codes)]
                counts = [len(g[0]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, counts)),
                        pa.array(np.concatenate([g[0] for g in got])),
                        pa.array(np.concatenate([g[1] for g in got])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
