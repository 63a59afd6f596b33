"""SimHash near-duplicates by the generalised pigeonhole principle (operator 8).

A text's fingerprint has bit k set if more than half of its shingles' XXH64 values have.  Fingerprints
within ``DISTANCE`` bits are linked.  Equal fingerprints count as one, so groups of copies are one row.

Search: the 64 bits are grouped into parts, correlated bits together; each part p has its own threshold
t_p (-1: not probed) with sum(t_p + 1) = DISTANCE + 1.  Two linked fingerprints are then within t_p in at
least one part.  A dynamic programme over (number of parts, thresholds) picks the plan of least estimated
cost, from candidate counts on a bounded sample of fingerprints.  For a part of threshold t, a fingerprint
is filed under its bits there and under all values with up to t of its set bits cleared; two
fingerprints that differ there in d <= t bits meet at the value both can reach.  Those that meet are
verified on all 64 bits.  Each task hands on a spanning forest of the links it verified, never all pairs.
A value that very many share is split by the bits outside its part: of DISTANCE + 1 groups of them, two
linked fingerprints agree in one, so they meet under that group's value too.  Splitting loses no link,
whichever values are split, so counts by hashed value, of bounded number, may choose them.

Defined results: null text has no words, so fingerprint zero, and is linked like any other; null ids take
part, a component's id is its smallest non-null id; repeated rows get equal results.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, shared_dir
from .components import connected_components, hand_back
from .decontaminate import _free
from .repeats import NULL_ID

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Distinct fingerprints that the plan is estimated on.
SAMPLE = 1500
#: Rows of one value that are compared pair by pair at once; larger groups are searched breadth-first.
SMALL = 24
#: Bins that filings are counted in, by hash of their value, and filings of a bin from which its values are split.
BINS, CROWDED = 1 << 18, 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers."""
    hashes, counts = [], []
    for text in texts:
        parts = text.translate(_LOWER).split() if text else []
        n = len(parts)
        if n <= SHINGLE:
            hashes.append([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if n else [])
        else:
            line = b" ".join(parts)
            ends = np.cumsum([len(p) + 1 for p in parts])
            starts = [0, *ends[: n - SHINGLE].tolist()]
            hashes.append(list(map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], repeat(SEED))))
        counts.append(len(hashes[-1]))
    out = np.zeros(len(texts), np.uint64)
    for k, h in enumerate(hashes):
        if h:
            ones = np.zeros(BITS, np.int64)
            for i in range(0, len(h), 1 << 14):
                block = np.array(h[i : i + (1 << 14)], np.uint64).view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


class Plan(NamedTuple):
    masks: tuple[int, ...]  #: bits of each part
    thresholds: tuple[int, ...]


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near equal width: each part grows from the first free bit by the most correlated ones."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(0)
    size = np.sqrt((centred**2).sum(0)) + 1e-9
    near = np.abs(centred.T @ centred / size[:, None] / size)
    free, out = list(range(BITS)), []
    for p in range(parts):
        width = -(-len(free) // (parts - p))
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda b: (near[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def make_plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> Plan:
    """The cheapest plan for ``total`` fingerprints: filing a row costs 1, verifying a candidate 0.05."""
    best: tuple[float, Plan] | None = None
    sample = np.unique(sample)
    for parts in range(1, distance + 2):
        groups = group_bits(sample, parts) if len(sample) else [[b for b in range(BITS) if b * parts // BITS == p] for p in range(parts)]
        masks = [sum(1 << b for b in g) for g in groups]
        costs = []
        for mask, g in zip(masks, groups, strict=True):
            cut = sample & np.uint64(mask)
            differ = np.zeros(len(g) + 1)
            for k in range(1, len(cut)):
                differ += np.bincount(np.bitwise_count(cut[:-k] ^ cut[k:]), minlength=len(g) + 1)[: len(g) + 1]
            share = np.cumsum(differ) / max(1.0, differ.sum())
            chance = np.cumsum([comb(len(g), d) for d in range(len(g) + 1)]) / 2.0 ** len(g)
            filed = [sum(comb(len(g) // 2 + len(g) % 2, d) for d in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0] + [total * filed[t] + 0.05 * total * total / 2 * max(share[min(t, len(g))], chance[min(t, len(g))]) for t in range(distance + 1)])
        # least[s]: cheapest thresholds of the parts so far with sum(t + 1) = s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, chosen) in least.items():
                for t in range(-1, distance - s + 1):
                    new = (c + cost[t + 1], (*chosen, t))
                    if s + t + 1 not in following or new < following[s + t + 1]:
                        following[s + t + 1] = new
            least = following
        cost, chosen = least[distance + 1]
        if best is None or cost < best[0]:
            best = cost, Plan(tuple(masks), chosen)
    return best[1]


def file_rows(prints: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, value, cleared bits, fingerprint) of every filing."""
    out = []
    for p, (mask, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
        if t < 0:
            continue
        bits = [np.uint64(1 << b) for b in range(BITS) if mask >> b & 1]
        cut = prints & np.uint64(mask)
        for d in range(t + 1):
            for chosen in combinations(bits, d):
                clear = np.uint64(sum(map(int, chosen)))
                has = np.flatnonzero(cut & clear == clear)
                out.append((np.full(len(has), p, np.int8), cut[has] ^ clear, np.full(len(has), d, np.int8), prints[has]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars around each component's smallest vertex."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = np.flatnonzero(root != np.arange(len(root)))
    return names[off], names[root[off]]


def _search(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large group, breadth-first: every step compares one vertex with those not yet reached."""
    left, a, b = np.unique(prints), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += list(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def verified_links(part: np.ndarray, value: np.ndarray, cleared: np.ndarray, prints: np.ndarray, group: np.ndarray, rest: np.ndarray, thresholds: tuple[int, ...], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that were filed under the same value.

    ``group`` and ``rest``: for split values, the group of other bits and its value; elsewhere the same for all.
    """
    order = np.lexsort((prints, rest, group, value, part))
    part, value, cleared, prints, group, rest = (x[order] for x in (part, value, cleared, prints, group, rest))
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (group[1:] != group[:-1]) | (rest[1:] != rest[:-1])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(part)))
    size = np.repeat(sizes, sizes)
    limit = np.array(thresholds)[part] if len(part) else part
    a, b = [], []
    place = np.flatnonzero((size > 1) & (size <= SMALL))
    offset = np.arange(len(part)) - np.repeat(starts, sizes)
    for lag in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = place[offset[place] + lag < size[place]]
        if not len(i):
            break
        near = (cleared[i].astype(np.int64) + cleared[i + lag] <= limit[i]) & (np.bitwise_count(prints[i] ^ prints[i + lag]) <= distance) & (prints[i] != prints[i + lag])
        a.append(prints[i[near]])
        b.append(prints[i[near] + lag])
    for k in np.flatnonzero(sizes > SMALL):
        x, y = _search(prints[starts[k] : starts[k] + sizes[k]], distance)
        a.append(x)
        b.append(y)
    if not a:
        return prints[:0], prints[:0]
    return _forest(np.concatenate(a), np.concatenate(b))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp bigint) of every document, checkpointed: it is read several times."""
    shared_dir(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.lit(0) if row is None else row).cast("bigint").alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2).to_pylist()).view(np.int64))], ["doc_id", "row", "fp"])

    return map_slices(source, "body", "doc_id bigint, row bigint, fp bigint", run).checkpoint()


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _split_values(filed: DataFrame, plan: Plan, distance: int, crowded: int) -> DataFrame:
    """Filings with (group, rest): those of crowded values once for each group of the bits outside their part."""
    bin_of = F.pmod(F.xxhash64("part", "value"), F.lit(BINS)).cast("int").alias("bin")
    counts = filed.groupBy(bin_of).count()
    rows = counts.agg(F.sum("count")).first()[0] or 0
    full = counts.where(F.col("count") > max(crowded, 4 * rows // BINS)).select("bin", F.lit(True).alias("full"))  # BINS rows at most
    groups = F.array(F.struct(F.lit(-1).cast("tinyint").alias("group"), F.lit(0).cast("bigint").alias("rest")))
    for p, mask in enumerate(plan.masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        masks = [_signed(sum(1 << b for b in free[g :: distance + 1])) for g in range(distance + 1)]
        others = F.array(*(F.struct(F.lit(g).cast("tinyint").alias("group"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("rest")) for g, m in enumerate(masks)))
        groups = F.when(F.col("full") & (F.col("part") == p), others).otherwise(groups)
    return filed.select("*", bin_of).join(F.broadcast(full), "bin", "left").select("part", "value", "cleared", "fp", F.inline(groups))


def links(distinct: DataFrame, plan: Plan, parts: int, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits of another."""

    def file(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(prints), 4096):
                part, value, cleared, fp = file_rows(prints[i : i + 4096], plan)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view(np.int64)), pa.array(cleared), pa.array(fp.view(np.int64))], ["part", "value", "cleared", "fp"])

    def verify(batches):
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            part, value, cleared, fp, group, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = verified_links(part, value.view(np.uint64), cleared, fp.view(np.uint64), group, rest, plan.thresholds, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    filed = distinct.select("fp").mapInArrow(file, "part tinyint, value bigint, cleared tinyint, fp bigint")
    return _split_values(filed, plan, distance, crowded).repartition(parts, "part", "value", "group", "rest").mapInArrow(verify, "a bigint, b bigint")


def classes_of(distinct: DataFrame, distance: int) -> DataFrame:
    """(fp, component) of the fingerprints that are linked with another; ``distinct`` has each once, checkpointed."""
    spark = distinct.sparkSession
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()
    plan = make_plan(np.array([r.fp for r in sample], np.int64).view(np.uint64), total, distance)
    rows = total * sum(sum(comb(bin(m).count("1") // 2, d) for d in range(t + 1)) for m, t in zip(plan.masks, plan.thresholds, strict=True))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 500_000))
    return connected_components(links(distinct, plan, parts, distance)).withColumnRenamed("vertex", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp bigint, component_id) of every document."""
    prints = fingerprint_table(docs, id_col, text_col)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    classes = classes_of(distinct, distance)
    linked = distinct.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    lone = distinct.join(classes, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    placed = hand_back(linked, least, "component").select("fp", "component_id").union(lone)
    return prints.join(placed, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that of its smallest (id, hash of the row), null ids last."""
    id_name, row_name = _free(docs.columns, "key"), _free(docs.columns, "row")
    hashed = [F.col(f.name) for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    # The hash covers the id too, so a null id and the number that stands for it differ in it.
    key, row = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), F.xxhash64(F.col("doc_id").isNull(), *hashed)
    prints = fingerprint_table(docs, row=row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "row")).alias("first")
    distinct = prints.groupBy("fp").agg(first).checkpoint()
    classes = classes_of(distinct.select("fp"), distance)
    placed = distinct.join(classes, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    chosen = placed.select(F.col("first.id").alias(id_name), F.col("first.row").alias(row_name))
    keyed = docs.withColumns({id_name: key, row_name: row})
    return keyed.join(chosen, [id_name, row_name], "left_semi").dropDuplicates([id_name, row_name]).select(*docs.columns)
