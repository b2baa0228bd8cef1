"""Exact similarity of hashed sets within candidate components, without listing all pairs.

Candidates are links between ids that share a key. Ids that candidate links
connect are compared in cells of at most two tiles, so that one task never holds a
whole component; a cell returns only links that connect ids it had not connected
before. That keeps every link between components and at most one row per id and
cell, whatever the number of similar pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored

TILE = 512
BITMAP_WORDS = 16
#: Ratio of the sizes that a band of a large component starts and ends at.
BAND = 1.25


def partial_stars(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, row) pairs: the distinct keys with their first row, and distinct (row, first row) of the others."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lead = rows[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else rows
    extra = ~new & (rows != lead)
    pairs = np.unique(np.stack([rows[extra], lead[extra]], 1), axis=0) if extra.any() else np.zeros((0, 2), rows.dtype)
    return keys[new], rows[new], pairs


def star_links(rows: DataFrame) -> DataFrame:
    """(id, lead) from rows (key, id, other): links for rows that share a key, and the (id, other) given already.

    Rows of a key come sorted and are read as a stream; a task keeps one leader.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, None
        for batch in batches:
            keys, ids, others = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            given = np.flatnonzero(np.asarray(others.is_valid()))
            out_a, out_b = [ids.take(pa.array(given))], [others.take(pa.array(given))]
            open_rows = np.flatnonzero(np.asarray(others.is_null()))
            if len(open_rows):
                k = keys[open_rows]
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                goes_on = last is not None and k[0] == last
                head = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                own = ~new
                first = np.cumsum(new) == 1
                if goes_on:
                    carried = np.flatnonzero(first)
                    out_a.append(ids.take(pa.array(open_rows[carried])))
                    out_b.append(pa.array([lead] * len(carried), ids.type))
                    own &= ~first
                out_a.append(ids.take(pa.array(open_rows[own])))
                out_b.append(ids.take(pa.array(head[own])))
                if not goes_on or k[-1] != last:
                    lead = ids[int(head[-1])].as_py()
                last = k[-1]
            a, b = pa.concat_arrays(out_a), pa.concat_arrays(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([a, b], names=["id", "lead"])

    dealt = rows.select("key", "id", "other").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, f"id {kind}, lead {kind}").where("id <> lead").distinct()


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: the bits in which two differ are no more than the hashes that only one set has."""
    out = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
    for i, s in enumerate(sets):
        bit = (s >> np.uint64(17)) & np.uint64(64 * BITMAP_WORDS - 1)
        np.bitwise_xor.at(out[i], (bit >> np.uint64(6)).astype(np.intp), np.uint64(1) << (bit & np.uint64(63)))
    return out


def linked(sets: list[np.ndarray], tiles: np.ndarray, cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with den * intersection >= num * union, leaving out pairs that earlier ones connect.

    Sets stand in order of size, so a row meets the sizes it can reach only; the
    bit count bounds the overlap from above before sorted arrays are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    tiles, sizes, bits = tiles[order], np.array([len(s) for s in sets]), bitmaps(sets)
    label, found = np.arange(len(sets)), []
    for i, s in enumerate(sets):
        to = int(np.searchsorted(sizes * num, sizes[i] * den, "right"))
        if to <= i + 1 or not len(s):
            continue
        apart = np.bitwise_count(bits[i + 1 : to] ^ bits[i]).sum(1)
        may = apart * (num + den) <= (den - num) * (sizes[i + 1 : to] + sizes[i])
        if cross:
            may &= tiles[i + 1 : to] != tiles[i]
        for j in np.flatnonzero(may) + i + 1:
            if label[j] == label[i]:
                continue
            other = sets[j]
            at = np.searchsorted(other, s)
            shared = int(np.count_nonzero(other[np.minimum(at, len(other) - 1)] == s))
            if den * shared >= num * (len(s) + len(other) - shared):
                label[label == label[j]] = label[i]
                found.append((order[i], order[j]))
    return found


def size_band(size: Column) -> Column:
    """Number of the band of a size; never falls as the size grows."""
    return F.floor(F.log(BAND, size)).cast("int")


def with_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root, n, bits) of rows (id, root, set): the set's size and parity bitmap, two bits and more for each hash."""
    for batch in batches:
        lists = batch.column(2)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        bits = []
        for i in range(batch.num_rows):
            s = flat[at[i] : at[i + 1]]
            words = max(BITMAP_WORDS, 1 << (2 * len(s) // 64).bit_length())
            bit = ((s >> np.uint64(17)) & np.uint64(64 * words - 1)).astype(np.intp)
            odd = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
            bits.append(np.packbits(odd, bitorder="little").view(np.int64))
        drawn = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bits)]).astype(np.int32), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
        columns = [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), drawn]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "n", "bits"])


def partnered(sizes: np.ndarray, bits: list[np.ndarray], tiles: np.ndarray, cross: bool, num: int, den: int) -> np.ndarray:
    """Which rows have one whose size and bitmap allow den * intersection >= num * union.

    A longer bitmap is folded to the length of the shorter one, which keeps the bound.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, tiles, bits = sizes[order], tiles[order], [bits[i] for i in order]
    width, hit, folded = np.array([len(b) for b in bits]), np.zeros(len(sizes), bool), {}
    for w in np.unique(width):
        # Bitmaps grow with the sizes, so those of this length and more come last.
        first = int(np.searchsorted(width, w))
        folded[w] = first, np.stack([np.bitwise_xor.reduce(b.reshape(-1, w), axis=0) for b in bits[first:]])
    for i, size in enumerate(sizes):
        to = int(np.searchsorted(sizes * num, size * den, "right"))
        if to <= i + 1 or not size:
            continue
        first, rows = folded[width[i]]
        apart = np.bitwise_count(rows[i + 1 - first : to - first] ^ rows[i - first]).sum(1, dtype=np.int64)
        may = apart * (num + den) <= (den - num) * (sizes[i + 1 : to] + size)
        if cross:
            may &= tiles[i + 1 : to] != tiles[i]
        if may.any():
            hit[i] = True
            hit[i + 1 : to] |= may
    found = np.zeros(len(sizes), bool)
    found[order] = hit
    return found


def with_partner(placed: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (cell, root, band, x, y, tile, id, n, bits) that have a possible partner in their cell, without n and bits."""
    keep = ["cell", "root", "band", "x", "y", "tile", "id"]
    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
            if rows is None or rows.num_rows < 2:
                return
            lists = rows.column("bits")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            bits = [flat[at[i] : at[i + 1]] for i in range(rows.num_rows)]
            hit = partnered(rows.column("n").to_numpy(), bits, rows.column("tile").to_numpy(), cell[2] != cell[3], num, den)
            if hit.any():
                yield rows.select(keep).filter(pa.array(hit))

        for batch in batches:
            roots, bands, xs, ys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "band", "x", "y"))
            new = (roots[1:] != roots[:-1]) | (bands[1:] != bands[:-1]) | (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])
            for a, b in itertools.pairwise([0, *(np.flatnonzero(new) + 1), batch.num_rows]):
                if a == b:
                    continue
                if (here := (roots[a], bands[a], xs[a], ys[a])) != cell:
                    yield from close()
                    cell, held = here, []
                held.append(batch.slice(a, b - a))
        yield from close()

    dealt = placed.repartition("cell").sortWithinPartitions("cell", "root", "band", "x", "y")
    return dealt.mapInArrow(scan, schema)


def verified_links(members: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """(a, b) for rows (id, root, set): links that connect ids of one root whose sets are similar enough.

    A root of more than a tile is cut by size: an id stands in the band of its size and in
    those up to the largest size that it can be similar to, so a pair meets in the band of its larger set.
    Bitmaps are sent to all cells first, and sets only to those in which their bitmap has a partner.
    """
    kind = members.schema["id"].dataType.simpleString()
    size = F.greatest(F.col("n"), F.lit(1)).cast("long")
    bands = F.sequence(size_band(size), size_band(F.floor(size * den / num)))
    # The sets are made twice: here for their sizes and bitmaps, and below for the cells.
    drawn = members.mapInArrow(with_bitmaps, f"id {kind}, root {members.schema['root'].dataType.simpleString()}, n long, bits array<long>")
    light = stored(drawn.withColumn("bands", bands), "set_bitmaps")
    large = light.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile).select("root", F.lit(True).alias("_large"))
    counts = light.join(large, "root").select("root", F.explode("bands").alias("band")).groupBy("root", "band").agg(F.count(F.lit(1)).alias("_n"))
    many = counts.where(F.col("_n") > tile).select("root", "band", F.ceil(F.col("_n") / tile).cast("int").alias("_t"))
    banded = light.join(large, "root", "left").withColumn("band", F.explode(F.when(F.col("_large"), F.col("bands")).otherwise(F.array(F.lit(0)))))
    tiles = F.coalesce("_t", F.lit(1))
    placed = (
        banded.join(many, ["root", "band"], "left")
        .withColumn("_tile", F.pmod(F.xxhash64("id", F.lit(3)), tiles).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(
            F.xxhash64("root", "band", F.least("_tile", "_with"), F.greatest("_tile", "_with")).alias("cell"),
            "root", "band", F.least("_tile", "_with").alias("x"), F.greatest("_tile", "_with").alias("y"), F.col("_tile").alias("tile"), "id", "n", "bits",
        )
    )
    # Rows that share an id count once.
    met = stored(with_partner(placed, num, den).distinct(), "met_cells")
    discard(light)
    spread = met.join(members, ["id", "root"]).select("cell", "root", "band", "x", "y", "tile", "id", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, tile_of, cell = [], [], [], None

        def close() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            pairs = linked(sets, np.array(tile_of), cell[2] != cell[3], num, den)
            a, b = [ids[i] for i, _ in pairs], [ids[j] for _, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], names=["a", "b"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            roots, bands, xs, ys = (batch.column(c).to_pylist() for c in ("root", "band", "x", "y"))
            own, ts = batch.column("id").to_pylist(), batch.column("tile").to_pylist()
            lists = batch.column("set")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(batch.num_rows):
                here = (roots[i], bands[i], xs[i], ys[i])
                if here != cell:
                    if (done := close()) is not None and done.num_rows:
                        yield done
                    ids, sets, tile_of, cell = [], [], [], here
                ids.append(own[i])
                sets.append(flat[at[i] : at[i + 1]].copy())
                tile_of.append(ts[i])
        if (done := close()) is not None and done.num_rows:
            yield done

    dealt = spread.repartition("cell").sortWithinPartitions("cell", "root", "band", "x", "y")
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}")


def candidate_roots(links: DataFrame, name: str) -> DataFrame:
    """(id, root) of the components of candidate links."""
    held = stored(links, name)
    roots = components(held, "id", "lead", name)
    discard(held)
    return roots
