"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector o is rotated by a seeded random orthogonal matrix and kept as the
signs of its coordinates (the code, of direction s) with one correction factor
a = <s, o>. For a unit vector q, <s, q> / a estimates <o, q> without bias over the
rotation, and it is off by at most sin(o, q) * sqrt(1 - a^2) / a; with chance
1 - delta the error is smaller by epsilon / sqrt(D - 1). The other side of a pair is
the rotated q in steps of a sixteenth of its range: four bit planes, with the sum of
what the steps leave out, so that <s, q> comes from bit counts of packed words and is
off by a known amount r at most. For a threshold t, a pair is compared exactly, in
double precision, unless

    <s, q> + r  <  a * t - sqrt(1 - t^2) * sqrt(1 - a^2) * min(1, epsilon / sqrt(D - 1)).

The default epsilon is unlimited, so the bound always holds and no link is lost. Codes,
factors and bit planes are computed once for each distinct vector and stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

THRESHOLD = 0.93
TILE_ROWS = 4096
SEED = 20
#: Bits of a rotated coordinate on the other side of a pair.
PLANES = 4
#: Slack for rounding.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows of ``vectors`` as unit vectors, rotated."""
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1], seed).T


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of the rows of ``vectors``."""
    turned = rotated(vectors, seed)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def in_words(bits: np.ndarray) -> np.ndarray:
    """Packed bytes of the last axis as 64-bit words, filled up with zeros."""
    wide = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 8) * 8), np.uint8)
    wide[..., : bits.shape[-1]] = bits
    return wide.view("<u8")


def stepped(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The rotated rows in steps: packed bit planes (row, plane, byte), and for each row
    the least coordinate, the step, the sum of the stepped coordinates and the greatest
    error of an inner product with a code's direction."""
    turned = rotated(vectors, seed)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
    level = np.rint((turned - low) / step).astype(np.uint8)
    planes = np.stack([np.packbits(level >> k & 1, axis=1) for k in range(PLANES)], axis=1)
    near = low + step * level
    error = np.abs(turned - near).sum(axis=1) / np.sqrt(vectors.shape[1])
    return planes, np.stack([low[:, 0], step[:, 0], near.sum(axis=1), error], axis=1)


def candidates(codes: np.ndarray, factors: np.ndarray, planes: np.ndarray, scale: np.ndarray, dim: int, threshold: float, epsilon: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of codes and stepped rows that the bound does not rule out."""
    words, other = in_words(codes), in_words(planes)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    low, step, total, error = scale.T
    part = 1.0 if epsilon is None else min(1.0, epsilon / np.sqrt(max(dim - 1, 1)))
    floor = threshold * factors - np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0.0, 1 - factors**2)) * part - SLACK
    for at in range(0, len(words), 512):
        mine = words[at : at + 512]
        count = np.zeros((len(mine), len(other)), np.uint16 if dim < 4096 else np.uint32)
        for k in range(PLANES):
            for w in range(words.shape[1]):
                count += np.bitwise_count(mine[:, w, None] & other[None, :, k, w]).astype(count.dtype) << k
        product = (2 * (count * step + ones[at : at + 512, None] * low) - total) / np.sqrt(dim)
        i, j = np.nonzero(product + error >= floor[at : at + 512, None])
        yield i + at, j


def linked_pairs(left: np.ndarray, right: np.ndarray, codes: np.ndarray, factors: np.ndarray, planes: np.ndarray, scale: np.ndarray, threshold: float, epsilon: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of rows of ``left`` (with their codes) and ``right`` (with their steps)
    with cosine at or above ``threshold``, in double precision, and how many pairs were
    recomputed exactly."""
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    found_i, found_j, exact = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, j in candidates(codes, factors, planes, scale, left.shape[1], threshold, epsilon):
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            exact += len(x)
            ok = np.einsum("ij,ij->i", left[x], right[y]) / (norm_l[x] * norm_r[y]) >= threshold
            found_i.append(x[ok])
            found_j.append(y[ok])
    return np.concatenate(found_i), np.concatenate(found_j), exact


def coded(classes: DataFrame, seed: int = SEED) -> DataFrame:
    """``classes(embedding array<double>, dim, ...)`` with ``code, factor, planes, scale``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            code, factor, planes, scale = [None] * len(dims), np.zeros(len(dims)), [None] * len(dims), [None] * len(dims)
            vectors = b.column("embedding").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.array([vectors[k] for k in at])
                codes, factor[at] = encode(x, seed)
                steps, scales = stepped(x, seed)
                for k, c, p, v in zip(at, codes, steps, scales):
                    code[k], planes[k], scale[k] = c.tobytes(), p.tobytes(), v.tolist()
            added = [pa.array(code, pa.binary()), pa.array(factor), pa.array(planes, pa.binary()), pa.array(scale, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, "code", "factor", "planes", "scale"])

    schema = StructType(classes.schema.fields + StructType.fromDDL("code binary, factor double, planes binary, scale array<double>").fields)
    return classes.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, epsilon: float | None = None, tile_rows: int = TILE_ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links,
    component_id, kept``.

    Vectors are compared where labels are equal and not null and lengths are equal.
    A vector that is null, empty or zero, or holds a null or non-finite component,
    links with nothing. Equal vectors of a label form one class, which is compared
    once and counted as often as it occurs, so copies never meet in pairs. The
    classes of a label are dealt to tiles of about ``tile_rows`` and each pair of
    tiles is one task's block, so no task holds a whole label. Repeated rows count
    as other vectors of the same id; a null vec_id keeps its row; further columns are
    ignored. With a finite ``epsilon`` a link may be lost with the chance that the
    bound leaves."""
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label").withColumn("usable", usable)
    good = rows.where("usable").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    classes = common.cut(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    stored = common.cut(coded(classes.select("label", "dim", "class", "n", "embedding"), seed))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("tiles"))
    dealt = stored.join(sizes, ["label", "dim"]).withColumn("tile", F.expr("cast(pmod(xxhash64(class), tiles) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other"), "first": F.col("tile") <= F.col("other")}).drop("tile", "other", "tiles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        first, n, dim = pdf["first"].to_numpy(), pdf["n"].to_numpy(), x.shape[1]
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        a = np.arange(len(x)) if same else np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        codes = np.frombuffer(b"".join(pdf["code"].iloc[a]), np.uint8).reshape(len(a), -1)
        planes = np.frombuffer(b"".join(pdf["planes"].iloc[b]), np.uint8).reshape(len(b), PLANES, -1)
        scale = np.array(pdf["scale"].iloc[b].tolist()).reshape(len(b), 4)
        i, j, _ = linked_pairs(x[a], x[b], codes, pdf["factor"].to_numpy()[a], planes, scale, threshold, epsilon)
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        count = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        classes = pdf["class"].to_numpy()
        root = np.full(len(x), np.iinfo(np.int64).max)
        label = common.forest(len(x), i, j)
        np.minimum.at(root, label, classes)
        keep = count > 0
        return pd.DataFrame({"class": classes[keep], "links": count[keep].astype(np.int64), "root": root[label][keep]})

    met = common.cut(dealt.groupBy("label", "dim", "lo", "hi").applyInPandas(compare, "class long, links long, root long"))
    found = common.components(met.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("class").agg(F.sum("links").alias("links"))
    own = classes.select("class", "low", "n").join(counts, "class", "left").join(found.withColumnRenamed("node", "class"), "class", "left")
    own = common.cut(own.withColumn("root", F.coalesce("root", "class")))
    lows = common.cut(own.groupBy("root").agg(F.min("low").alias("component")))
    named = common.cut(own.join(lows, "root").select("class", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    keys = classes.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "class").join(named, "class").drop("class")
    out = good.join(keys, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) as (select vec_id, vec_id from v union select r.a, p.b from r join p on r.b = p.a)
select e.vec_id, coalesce((select count(*) from p where p.a = e.vec_id), 0)::bigint as n_links,
  coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id) as component_id,
  coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id) = e.vec_id as kept
from embeddings e
"""
