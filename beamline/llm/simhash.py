"""SimHash near-duplicates by tiled exact comparison.

Each text becomes a 64-bit fingerprint: the majority vote, bit by bit, over the
XXH64 values of its word 3-shingles. Distinct fingerprints are compared in
tiles: exclusive-or and bit counts over whole numpy blocks, with the rows of a
tile in order of their population count, so that blocks whose counts differ by
more than the radius are skipped.

Which fingerprints share a tile is decided by views: the bits are cut into parts,
and a view is a choice of all parts but three. Two values that differ in at most
three bits agree in all parts of some view, so every link is met in some tile. Four
parts give 4 views of 16 bits, five 10 of 25, six 20 of 32, seven 35 of 36 and so on;
the number of parts follows the number of values, so that a view has more different
keys than there are tiles and the work grows with the number of rows times the tile
size. A tile that is too large (many near copies agree in a view) is split by
population count and hash, and its parts meet in pairs whose counts are within the
radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 3
TILE_ROWS = 2048
BLOCK = 256
#: Ids that are broadcast at most (16 to 32 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one whole text; 0 for null and for no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - 2)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        votes = np.array([digest(b" ".join(words), 42)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0] + [e + 1 for e in ends[: n - 1]]
        votes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[2:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = votes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp long``: the fingerprint as a signed 64-bit integer."""

    def start():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return common.add_columns(docs.drop("fp"), ("text",), "fp long", start).drop("text")


def near(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the values of ``a`` (and ``b``) at most ``radius`` bits apart.

    With ``b``, only pairs across the two are compared. Returns pairs
    (value, smallest value of its component in this tile)."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    other = a if b is None else b[np.argsort(np.bitwise_count(b), kind="stable")]
    values = a if b is None else np.concatenate([a, other])
    shift = 0 if b is None else len(a)
    ones, theirs = np.bitwise_count(a).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    label = np.arange(len(values))
    for i in range(0, len(a), BLOCK):
        block = a[i : i + BLOCK]
        lo = int(np.searchsorted(theirs, ones[i] - radius, "left"))
        hi = int(np.searchsorted(theirs, ones[min(i + BLOCK, len(a)) - 1] + radius, "right"))
        lo = max(lo, i) if b is None else lo
        if lo >= hi:
            continue
        x, y = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, lo:hi]) <= radius)
        x, y = x + i, y + lo + shift
        new = x < y
        if new.any():
            label = common.forest(len(values), x[new], y[new], label)
    signed = values.view(np.int64)
    smallest = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, signed)
    root = smallest[label]
    keep = root != signed
    return signed[keep], root[keep]


def views(radius: int, tiles: int) -> list[int]:
    """Masks of the views (as signed integers): the bits in ``radius + k`` parts of about
    the same size, and every choice of ``k`` parts, for the least ``k`` that gives four
    keys or more for each tile."""
    for k in range(1, 64 - radius):
        cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        masks = [sum(own) for own in combinations(parts, k)]
        if min(m.bit_count() for m in masks) >= (4 * tiles).bit_length() - 1 or radius + k >= 8:
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``(a, b)`` among the distinct values of ``fps(fp long)``.

    Every pair within ``radius`` is connected through the returned links; the links are a spanning forest of each tile, so a large group of near
    copies gives rows in proportion to its size."""
    n = fps.count()
    buckets = max(1, -(-n // tile_rows))
    masks = F.array(*[F.lit(m) for m in views(radius, buckets)])
    rows = (
        fps.select("fp", F.posexplode(masks).alias("view", "mask"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask"))), F.lit(buckets)))
        .withColumn("ones", F.expr("cast(bit_count(fp) as int)"))
        .drop("mask")
    )
    heavy = (
        rows.groupBy("view", "bucket", "ones")
        .count()
        .withColumn("parts", F.ceil(F.col("count") / F.lit(tile_rows)).cast("int"))
        .groupBy("view", "bucket")
        .agg(F.sum("count").alias("total"), F.collect_list(F.struct("ones", "parts")).alias("sizes"))
        .where(F.col("total") > 4 * tile_rows)
        .select(
            "view", "bucket",
            F.expr("flatten(transform(sizes, s -> transform(sequence(0, s.parts - 1), k -> named_struct('ones', s.ones, 'part', k))))").alias("tiles"),
            F.expr("map_from_entries(sizes)").alias("parts"),
        )
    )
    heavy = common.cut(heavy)
    dealt = rows.join(heavy, ["view", "bucket"], "left").withColumn(
        "own",
        F.when(F.col("tiles").isNotNull(), F.struct("ones", F.expr("cast(pmod(xxhash64(fp), parts[ones]) as int)").alias("part")))
        .otherwise(F.struct(F.lit(-1).alias("ones"), F.lit(0).alias("part"))),
    )
    met = F.when(F.col("tiles").isNotNull(), F.expr(f"filter(tiles, t -> abs(t.ones - ones) <= {radius})")).otherwise(F.array("own"))
    dealt = dealt.select("fp", "view", "bucket", "own", F.explode(met).alias("with")).select(
        "fp", "view", "bucket", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") <= F.col("with")).alias("first")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        values, first = pdf["fp"].to_numpy().view(np.uint64), pdf["first"].to_numpy()
        a, b = near(values, None, radius) if first.all() else near(values[first], values[~first], radius)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("view", "bucket", "lo", "hi").applyInPandas(compare, "a long, b long")


def classes_of(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(fp, root, component_id)`` of each distinct value of ``prints(doc_id, fp)``:
    the smallest linked value, and the smallest doc_id that has one of them."""
    classes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = common.components(links(classes.select("fp"), radius, tile_rows))
    linked = common.cut(classes.join(found, classes["fp"] == found["node"]).select("fp", "root", "low"))
    lows = common.cut(linked.groupBy("root").agg(F.min("low").alias("component")))
    named = linked.join(lows, "root").select("fp", "root", "component")
    return common.cut(classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "low").alias("component_id")))


def simhash_components(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Null and empty texts have fingerprint zero and link like any other. A null
    ``doc_id`` keeps its row and takes the component's smallest non-null id
    (null if there is none). Repeated rows keep their count. An empty table
    gives an empty result; further columns are ignored."""
    prints = common.cut(fingerprints(docs.select(F.col("doc_id").cast("long"), "text")))
    ids = classes_of(prints, radius, tile_rows)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs`` with one row of each component, in the same columns.

    The row with the smallest doc_id stays; of repeated doc_ids, and where all are
    null, the one with the smallest fingerprint (by sign), then with the smallest
    hash of its columns. Which rows stay is decided on doc_ids and fingerprints alone;
    texts are read twice and moved only where doc_ids repeat, or where more than
    ``BROADCAST_IDS`` documents go and as many stay. Very long texts take one pass of
    constant memory beside their words; an empty table gives an empty result."""
    key, own = F.col("doc_id").cast("long"), common.free_name(docs, "own_fingerprint")
    prints = common.cut(fingerprints(docs.select(key.alias("doc_id"), "text")))
    ids = classes_of(prints, radius, tile_rows)
    first = prints.join(ids, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = common.cut(first.groupBy("root").agg(F.min("fp").alias("wanted"), F.min("doc_id").alias("first_id")))
    seen = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    chosen = first.select("first_id").distinct().withColumn("first", F.lit(True))
    told = seen.join(chosen, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    one, first_of = F.col("doc_id").isNotNull() & (F.col("n") == 1), F.coalesce("first", F.lit(False))
    told = common.cut(told.select("doc_id", (one & first_of).alias("stays"), (~one & first_of).alias("several")))
    goes = F.col("doc_id").isNotNull() & ~F.col("stays")
    n = told.agg(F.count_if("stays").alias("stay"), F.count_if(goes).alias("go"), F.count_if("several").alias("several")).first()

    def listed(rule: Column, rows: int) -> DataFrame:
        return common.small(told.where(rule).select(F.col("doc_id").alias(own)), rows, BROADCAST_IDS)

    if n["go"] <= n["stay"]:
        out = docs.where(key.isNotNull()).join(listed(goes, n["go"]), key == F.col(own), "left_anti")
    else:
        out = docs.join(listed(F.col("stays"), n["stay"]), key == F.col(own), "left_semi")
    if not n["several"]:
        return out
    # rows that share a doc_id, or have none: one row of each chosen fingerprint
    shared = docs.join(listed(F.col("several"), n["several"]), key.eqNullSafe(F.col(own)), "left_semi")
    whole = fingerprints(shared.select(key.alias("doc_id"), "text", F.struct(*docs.columns).alias("whole")))
    hashed = F.xxhash64(*[F.col("whole")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("fp") == F.col("wanted"))
    picked = whole.join(first, same, "left_semi").groupBy("doc_id", "fp").agg(F.min_by("whole", hashed).alias("whole"))
    return out.unionByName(picked.select("whole.*"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(common.table(spark, sf_dir, "documents"))
