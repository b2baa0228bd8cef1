"""Repeated byte strings across all texts, by sorted samples of suffixes.

Every 400-byte window owns one sampled position: the smallest 16-byte hash among
its first 192 starts. Equal windows own positions at equal offsets, which is what a
difference cover gives, with one sample in about 100 bytes instead of two in three.
The steps are those of the difference-cover method on that sample: names of short
strings are doubled into names of the 209 bytes that every window of a position
contains; positions are sorted by name, so that equal prefixes stand next to each
other; within a name, the runs of windows that positions own are compared; and only
where runs differ are the remaining suffixes, the single windows, sorted and
compared with their neighbours. README.md says why bytes are not sorted directly.

Defined results: a null text is empty; texts below 400 bytes keep all bytes; a text
that occurs twice is repeated as a whole; repeated rows and null doc_ids are texts
like any other; an empty table gives an empty result; other columns are passed over.
Strings are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .hashing import _BASE, _VALUES, buffers, mix

LENGTH = 400
GRAM = 16
STARTS = 192
CORE = LENGTH - STARTS + 1
PART = 1 << 18
HELD_ROWS = 100_000
_MASK = np.uint64((1 << 20) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Names:
    """Names of the strings of any length that start at each byte of a buffer, doubled from 1 to 256 bytes."""

    def __init__(self, data: np.ndarray, most: int):
        self.of = {1: _VALUES[False][data]}
        size = 1
        while 2 * size <= most:
            h, n = self.of[size], len(data) - 2 * size + 1
            self.of[2 * size] = h[:n] * _power(size) + h[size : size + n] if n > 0 else np.zeros(0, np.uint64)
            size *= 2

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        out, done = np.zeros(len(places), np.uint64), 0
        for size in sorted(self.of, reverse=True):
            while length - done >= size:
                out = out * _power(size) + self.of[size][places + done]
                done += size
        return mix(out)


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """(bytes, [(row, offset in the text, from, to)]): texts of 400 bytes or more in buffers of bounded size.

    A long text is cut into parts that share 399 bytes, so each window lies in one part.
    """
    data, offsets = buffers(column)
    held, size = [], 0

    def close() -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        at, pieces, where = 0, [], []
        for row, base, a, b in held:
            pieces.append(data[a:b])
            where.append((row, base, at, at + b - a))
            at += b - a
        return np.concatenate(pieces), where

    for row in range(len(offsets) - 1):
        a, end = int(offsets[row]), int(offsets[row + 1])
        for start in range(a, max(a, end - LENGTH + 1), PART):
            to = min(end, start + PART + LENGTH - 1)
            held.append((row, start - a, start, to))
            size += to - start
            if size >= PART:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def owners(names: Names, where: list[tuple[int, int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, position, first window, last window) of the sampled positions of a buffer."""
    key = mix(names.of[GRAM]) & ~_MASK | np.arange(len(names.of[GRAM]), dtype=np.uint64)
    low, size = key, 1
    while 2 * size <= STARTS:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    extra = STARTS - size
    low = np.minimum(low[: len(low) - extra], low[extra:])
    windows = np.concatenate([np.arange(a, b - LENGTH + 1) for _, _, a, b in where])
    part = np.repeat(np.arange(len(where)), [b - a - LENGTH + 1 for _, _, a, b in where])
    place = (low[windows] & _MASK).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(windows)) - 1
    return part[head], place[head], windows[head], windows[tail]


def combined(key: np.ndarray, run: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows (key, run, rid, pos, known) of a buffer, with one row per key and run.

    Places that share both within the buffer are repeated already: they go on as known
    rows under keys of their own, so that a frequent key sends one row per buffer.
    """
    order = np.lexsort((pos, rid, run, key))
    key, run, rid, pos = key[order], run[order], rid[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
    once = new.copy()
    once[1:] |= (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])
    key, run, rid, pos, new = key[once], run[once], rid[once], pos[once], new[once]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    own = mix(mix(rid[several].astype(np.uint64)) + pos[several].astype(np.uint64)).view(np.int64)
    columns = {
        "key": np.concatenate([key[new], own]), "run": np.concatenate([run[new], np.zeros(len(own), np.int64)]),
        "rid": np.concatenate([rid[new], rid[several]]), "pos": np.concatenate([pos[new], pos[several]]),
        "known": np.repeat([False, True], [np.count_nonzero(new), len(own)]),
    }
    return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


ROWS = "key long, run long, rid long, pos long, known boolean"


def text_id(text: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def samples(docs: DataFrame) -> DataFrame:
    """(key, run, rid, pos, known) of the sampled positions; pos holds the first window and their number less one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh_rows = [i for i, r in enumerate(rids.tolist()) if r not in seen and not seen.add(r)]
            rids = rids[fresh_rows]
            for data, where in parts(batch.column(1).take(pa.array(fresh_rows, pa.int64()))):
                names = Names(data, 256)
                part, place, first, last = owners(names, where, len(data))
                rows, bases, begins = (np.array([w[k] for w in where]) for k in (0, 1, 2))
                run = mix(names.at(first, LENGTH) * _BASE + names.at(last, LENGTH) + ((last - first) * 1024 + place - first).astype(np.uint64))
                pos = (first - begins[part] + bases[part]) * 256 + (last - first)
                yield combined(names.at(place, CORE).view(np.int64), run.view(np.int64), rids[rows[part]], pos)

    long_texts = docs.where(F.octet_length("text") >= LENGTH).select(text_id().alias("rid"), "text")
    return long_texts.mapInArrow(scan, ROWS)


def repeated(rows: DataFrame, with_key: bool = False) -> DataFrame:
    """(rid, pos, open) of rows (key, run, rid, pos) whose key occurs at two places or more; ``with_key`` adds the key.

    Rows of a run that occurs at two places are repeated (open is false). If a key has
    several runs, the first row of each is returned as open too, to be compared in
    detail. Rows with a true ``known`` are repeated whatever the others are. Keys arrive sorted; a task holds one key's rows, and of a long key only the
    rows that may still matter.
    """
    fields = ["key", "run", "rid", "pos"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, np.int64) for c in fields} | {c: np.zeros(0, bool) for c in ("known", "closed", "opened")}
        had_more = False

        def out(rows: dict, covered: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
            found = {c: pa.array(np.concatenate([rows[c][covered], rows[c][opened]])) for c in ("rid", "pos", "key")}
            flag = np.repeat([False, True], [np.count_nonzero(covered), np.count_nonzero(opened)])
            return pa.RecordBatch.from_pydict({"rid": found["rid"], "pos": found["pos"], "open": pa.array(flag)} | ({"key": found["key"]} if with_key else {}))

        def step(new: dict | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, had_more
            rows = held
            if new is not None:
                m = len(new["key"])
                rows = {c: np.concatenate([held[c], new.get(c, np.zeros(m, bool))]) for c in held}
            n = len(rows["key"])
            if not n:
                return
            differs = {c: np.concatenate([[True], rows[c][1:] != rows[c][:-1]]) for c in fields}
            once = differs["key"] | differs["run"] | differs["rid"] | differs["pos"]
            if not once.all():
                rows = {c: v[once] for c, v in rows.items()}
                n = len(rows["key"])
                differs = {c: np.concatenate([[True], rows[c][1:] != rows[c][:-1]]) for c in fields}
            new_run = differs["key"] | differs["run"]
            key_no, run_no = np.cumsum(differs["key"]) - 1, np.cumsum(new_run) - 1
            in_run = np.bincount(run_no)[run_no]
            runs = np.bincount(key_no[new_run])
            runs[0] += had_more
            covered = ((in_run >= 2) | rows["known"]) & ~rows["closed"]
            opened = new_run & (runs[key_no] >= 2) & ~rows["opened"]
            done = np.ones(n, bool) if new is None else key_no < key_no[-1]
            if done.any():
                yield out(rows, covered & done, opened & done)
            keep = ~done
            had_more = bool(had_more and key_no[-1] == 0)
            if np.count_nonzero(keep) > HELD_ROWS:
                # All but the last run are complete if another run follows; of the last one two rows tell that it is repeated.
                several = runs[-1] >= 2
                last = run_no == run_no[-1]
                yield out(rows, covered & keep, opened & keep)
                rows["closed"] = rows["closed"] | covered
                rows["opened"] = rows["opened"] | opened
                first = np.flatnonzero(last)[:2]
                keep = np.zeros(n, bool)
                keep[first] = True
                had_more = bool(several)
            held = {c: v[keep] for c, v in rows.items()}

        for batch in batches:
            if batch.num_rows:
                yield from step({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*fields, "known")})
        yield from step(None)

    known = F.col("known") if "known" in rows.columns else F.lit(False)
    dealt = rows.select(*fields, known.alias("known")).repartition("key").sortWithinPartitions(*fields)
    return dealt.mapInArrow(scan, "rid long, pos long, open boolean" + (", key long" if with_key else ""))


def windows(texts: DataFrame) -> DataFrame:
    """(key, run, rid, pos, known) of the single windows of rows (rid, text, ranges); ranges are first windows and numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for data, where in parts(batch.column(1)):
                names, found = Names(data, 256), []
                for row, base, a, b in where:
                    packed = flat[at[row] : at[row + 1]]
                    first, more = packed // 256, packed % 256
                    begin = np.repeat(first - np.concatenate([[0], np.cumsum(more + 1)[:-1]]), more + 1)
                    starts = np.unique(begin + np.arange(int((more + 1).sum())))
                    starts = starts[(starts >= base) & (starts <= base + b - a - LENGTH)]
                    if len(starts):
                        key = names.at(starts - base + a, LENGTH).view(np.int64)
                        found.append((key, np.zeros(len(starts), np.int64), np.full(len(starts), rids[row]), starts))
                if found:
                    yield combined(*map(np.concatenate, zip(*found, strict=True)))

    return texts.select("rid", "text", "ranges").mapInArrow(scan, ROWS)


def cut_out(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, removed runs) for spans (start, end), sorted by start."""
    kept, at, runs, removed, end_before = [], 0, 0, 0, -1
    for start, end in spans.tolist():
        if start > end_before:
            kept.append(data[at:start])
            runs += 1
            removed += end - start
            at = end_before = end
        elif end > end_before:
            removed += end - end_before
            at = end_before = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


RESULT = "rid long, n_removed long, n_spans long, kept binary"


def removed(texts: DataFrame) -> DataFrame:
    """(rid, n_removed, n_spans, kept) of rows (rid, text, starts, ends)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            at, flat = spans.offsets.to_numpy(), spans.values
            starts, ends = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = []
            for i, (rid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = np.stack([starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]], 1)
                kept, gone, runs = cut_out(text.encode(), own[np.lexsort((own[:, 1], own[:, 0]))])
                rows.append((rid, gone, runs, kept))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rid", "n_removed", "n_spans", "kept"])

    return texts.select("rid", "text", "spans").mapInArrow(scan, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_docs = docs.select("doc_id", text.alias("text"))
    sizes = stored(
        all_docs.select("doc_id", text_id().alias("rid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha")),
        "text_sizes",
    )
    copies = stored(sizes.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "copies")
    found = stored(repeated(samples(all_docs)), "repeats")
    # One copy of each text that has a repeat; copies stand in different partitions, as doc_id is part of the key.
    wanted = found.select("rid").distinct().join(copies, "rid").select(F.col("rid").alias("of"), "first_id")
    keyed = all_docs.withColumn("rid", text_id())
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    one = keyed.join(wanted.hint("shuffle_hash"), (F.col("rid") == F.col("of")) & first).select("rid", "text")
    texts = stored(one, "repeat_texts")
    ranges = found.where("open").groupBy("rid").agg(F.collect_list("pos").alias("ranges"))
    single = repeated(windows(texts.join(ranges, "rid")))
    spans = found.where("not open").select("rid", F.expr("pos div 256").alias("start"), (F.expr("pos div 256") + F.col("pos") % 256 + LENGTH).alias("end")).union(
        single.where("not open").select("rid", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("end"))
    )
    listed = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = stored(
        removed(texts.join(listed, "rid")).select("rid", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha")).dropDuplicates(["rid"]), "removed"
    )
    discard(found, texts)
    twin = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return (
        sizes.join(copies, "rid")
        .join(cut, "rid", "left")
        .select(
            "doc_id", "n_bytes",
            F.when(twin, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(twin, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(twin, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )
    )
