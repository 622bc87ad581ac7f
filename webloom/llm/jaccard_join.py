"""N-gram Jaccard join: an exact metric-space join of documents on word-shingle sets.

Two documents link when ``100 * |A & B| >= threshold * |A | B|`` (Jaccard distance of at most
``eps = 1 - threshold/100``); a document's class is the smallest doc_id reachable by links.

How it works, all of it exact but for equal hashes of different shingles (48 bits and those of the hash
range are kept: 52 at least, 64 from 65,536 ranges on; a collision moves an intersection by one):

1. *Shingles.* Texts become sets of hashed word shingles; equal word sequences share a fingerprint.
   Shingles go, packed and added up by batch of texts, to the partition of their hash range, which counts in how
   many texts each occurs and returns those that occur at least twice: one that every text holds costs its range
   an entry a batch, not one a text. A text with fewer than ``threshold`` percent of
   such shingles is farther than ``eps`` from every other and needs no further work.
2. *Pivots.* Documents without common shingles all lie at distance 1, where a metric cannot separate
   them, so regions start from shingles: in the order (frequency, hash), two sets within ``eps`` share
   one of their first ``n - ceil(threshold*n) + 1`` shingles. The least document of each such shingle
   is its pivot; a document belongs to the regions of all its pivots (its boundary copies included),
   so each linking pair meets in at least one region.
3. *Voronoi recursion.* A region above ``leaf_shingles`` takes new pivots; each document goes to its
   nearest pivot's cell and, by the triangle inequality, to every cell whose pivot is at most
   ``2 * eps`` farther. Cells are split again; a region whose cells would not halve its work is cut into
   blocks instead, each pair of which is a leaf, so no region is dropped, capped or held in one task.
4. *Leaves.* Inside a leaf all pairs' distances are found exactly, block of members by block. A leaf gives its
   components as stars, and each member's number of links; a pair that meets in several leaves is counted
   in the first one that holds both. No pair leaves its task.
5. *Classes.* Links form stars; alternating large-star and small-star steps on written tables give
   connected components without gathering them anywhere.

``n_links`` of a document is the number of other documents (doc_id and text) that it links with, copies included.
To count all links takes work that grows with the square of a group of near copies of different texts, spread over
blocks; exact copies are one vertex and cost nothing.

Cases: null text, empty text or text without words has an empty set, links with nothing and is a
class of its own (with equal doc_ids: the same). A null doc_id links with nothing; its component is null and its
links 0. Repeated rows are returned as often as they occur and counted once; texts that share a doc_id as their
least one share a class. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_ENTRY = "doc_id long, hi long, lo long, n long"
_PACKED = "batch long, rng int, kind int, counts binary, hashes binary, marks binary"
_SETS = "hi long, lo long, n long, uniques long, hashes binary"


def _prefix(n: int, threshold: int) -> int:
    """Shingles of which a linking pair shares at least one: n - ceil(threshold% of n) + 1."""
    return n - (threshold * n + 99) // 100 + 1


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts).tolist()
    raw = hashes.tobytes()
    got = b"".join(hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() for e, c in zip(ends, counts.tolist()))
    return np.frombuffer(got, np.int64).reshape(-1, 2)


def document_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, (hi, lo) fingerprint of the word sequence, n: size of the shingle set; one row per document."""

    def run(batches):
        for table in shared.gathered(batches):
            hashes, counts = shared.hashed_words(table["text"])
            marks = _fingerprints(hashes, counts)
            sizes = [len(s) for s in shared.shingle_sets(hashes, counts, width)]
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sizes, pa.int64())],
                names=["doc_id", "hi", "lo", "n"],
            )

    return _texts(docs).mapInArrow(run, _ENTRY)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _few(values: np.ndarray) -> bytes:
    """Small counts, compressed: a batch tells each range how many shingles each document has there."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).tobytes())


def _from_few(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32)


def _six(values: np.ndarray) -> bytes:
    """The low 48 bits; the range holds the upper bits."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by byte plane: the upper ones are near empty and compress."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _by_range(sets: list[np.ndarray], shift: np.uint64) -> tuple[bytes, list[tuple]]:
    """A batch's shingles by hash range, added up: a shingle that several of its texts hold is one entry of its range.

    Returns postings, which stay with the batch (for each such shingle, in order, how many texts hold it; then which),
    and rows (range, how many shingles each text alone holds, names of these and of the others, holders of the others)."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.append(heads, len(flat)))
    several = times > 1
    again = np.repeat(several, times)
    names, times = flat[heads[several]], times[several]
    postings = _few(np.concatenate([times, doc[again]]))
    flat, doc = flat[~again], doc[~again]
    own, named = (flat >> shift).astype(np.int64), (names >> shift).astype(np.int64)
    order = np.argsort(own * len(sets) + doc, kind="stable")
    flat, doc = flat[order], doc[order]
    present = np.unique(np.concatenate([own, named]))
    ends = [np.searchsorted(x, present, side=side).tolist() for x in (own, named) for side in ("left", "right")]
    rows = []
    for rng, a, b, c, d in zip(present.tolist(), *ends):
        per = np.bincount(doc[a:b], minlength=len(sets))
        rows.append((rng, _few(per), _six(np.append(flat[a:b], names[c:d])), _few(times[c:d]) if c < d else None))
    return postings, rows


def shared_shingles(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Distinct texts of which `threshold` percent of the shingles occur in other texts too: their
    fingerprint, n, the number of other shingles, and the 48-bit names of the shared ones, by (frequency, name)."""
    spark = docs.sparkSession
    parts = shared.shuffle_partitions(spark)
    bits = max(4, int(np.ceil(np.log2(max(4 * parts, shared.size_in_bytes(docs) / (8 << 20))))))
    ranges = 1 << min(bits, 20)
    # A batch spreads over all ranges: it grows with them, so that a packed row stays worth its overhead.
    limit = shared.BATCH_BYTES if ranges <= 1 << 14 else 8 * shared.BATCH_BYTES
    shift = np.uint64(64 - int(np.log2(ranges)))

    def spread(batches):
        from pyspark import TaskContext

        seen: set[bytes] = set()
        base, serial = TaskContext.get().partitionId() << 32, 0
        for table in shared.gathered(batches, limit=limit):
            hashes, counts = shared.hashed_words(table["text"])
            marks = _fingerprints(hashes, counts)
            keep, sets = [], []
            for i, s in enumerate(shared.shingle_sets(hashes, counts, width)):
                if len(s) and (key := marks[i].tobytes()) not in seen:
                    seen.add(key)
                    keep.append(i)
                    sets.append(s)
            if not keep:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            postings, parts_of = _by_range(sets, shift)
            out = [(base + serial, int(serial % ranges), 0, marks[keep].tobytes(), sizes.astype(np.uint32).tobytes(), postings)]
            out += [(base + serial, rng, 1, *part) for rng, *part in parts_of]
            serial += 1
            yield _rows(out, _PACKED_ARROW)

    def count(batches):
        for rng, rows in _runs(batches, "rng"):
            packed = [r for r in rows if r["kind"] == 1]
            out = [(r["batch"], rng, 0, r["counts"], r["hashes"], r["marks"]) for r in rows if r["kind"] == 0]
            if packed:
                values = [_from_six(r["hashes"]) for r in packed]
                held = [_from_few(r["marks"]) if r["marks"] else np.zeros(0, np.uint32) for r in packed]
                flat = np.concatenate(values)
                texts = np.concatenate([np.append(np.ones(len(v) - len(t), np.uint32), t) for v, t in zip(values, held)])
                order = np.argsort(flat)
                ordered = flat[order]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                entries = np.diff(np.append(heads, len(ordered)))
                times = np.add.reduceat(texts[order], heads, dtype=np.int64)
                # A common shingle is named by its range and its place among the range's common shingles.
                nth = np.empty(len(flat), np.uint32)
                nth[order] = np.repeat(np.cumsum(times > 1) - 1, entries).astype(np.uint32)
                mark = np.empty(len(flat), np.uint8)
                mark[order] = np.repeat(np.minimum(255, np.floor(8 * np.log2(times))).astype(np.uint8), entries)
                at = 0
                for r, own, more in zip(packed, values, held):
                    m, name = mark[at : at + len(own)], nth[at : at + len(own)]
                    at += len(own)
                    common = m > 0  # all of the names that several texts of the batch hold, which stand last
                    per = _from_few(r["counts"])
                    doc = np.repeat(np.arange(len(per)), per)
                    once = common[: len(own) - len(more)]
                    both = np.stack([np.bincount(doc[~once], minlength=len(per)), np.bincount(doc[once], minlength=len(per))])
                    out.append((r["batch"], rng, 1, _few(both), _planes(name[common]), m[common].tobytes()))
                del flat, order, ordered, texts, mark, nth
            for i in range(0, len(out), 64):
                yield _rows(out[i : i + 64], _PACKED_ARROW)

    def gather(batches):
        for _, rows in _runs(batches, "batch"):
            head = next(r for r in rows if r["kind"] == 0)
            marks = np.frombuffer(head["counts"], np.int64).reshape(-1, 2)
            sizes = np.frombuffer(head["hashes"], np.uint32).astype(np.int64)
            uniques = np.zeros(len(sizes), np.int64)
            docs_of, hashes, classes, again = [], [], [], []
            for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["rng"]):
                alone, common = _from_few(r["counts"]).reshape(2, -1)
                uniques += alone
                names, own = _from_planes(r["hashes"]) | np.uint64(r["rng"] << 28), np.frombuffer(r["marks"], np.uint8)
                k = int(common.sum())
                docs_of.append(np.repeat(np.arange(len(common)), common))
                hashes.append(names[:k])
                classes.append(own[:k])
                again.append((names[k:], own[k:]))
            held = _from_few(head["marks"]).astype(np.int64)
            k = sum(len(names) for names, _ in again)
            docs_of.append(held[k:])
            hashes.append(np.repeat(np.concatenate([names for names, _ in again]), held[:k]))
            classes.append(np.repeat(np.concatenate([own for _, own in again]), held[:k]))
            doc, flat, cls = np.concatenate(docs_of), np.concatenate(hashes), np.concatenate(classes)
            good = 100 * (sizes - uniques) >= threshold * sizes
            pick = good[doc]
            doc, flat, cls = doc[pick], flat[pick], cls[pick]
            order = np.lexsort((flat, cls, doc))
            doc, flat = doc[order], flat[order]
            ends = np.searchsorted(doc, np.arange(len(sizes)), side="right")
            starts = np.searchsorted(doc, np.arange(len(sizes)), side="left")
            out = [(int(marks[i, 0]), int(marks[i, 1]), int(sizes[i]), int(uniques[i]), _six(flat[starts[i] : ends[i]])) for i in np.flatnonzero(good)]
            for i in range(0, len(out), 256):
                yield _rows(out[i : i + 256], _SETS_ARROW)

    packed = _texts(docs).mapInArrow(spread, _PACKED)
    counted = packed.repartition(parts, "rng").sortWithinPartitions("rng").mapInArrow(count, _PACKED)
    return counted.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(gather, _SETS)


_PACKED_ARROW = pa.schema([("batch", pa.int64()), ("rng", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("hashes", pa.binary()), ("marks", pa.binary())])
_SETS_ARROW = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("uniques", pa.int64()), ("hashes", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def _runs(batches, key: str):
    """Runs of rows with one key, from batches sorted by it."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def leaf_links(ids: list[int], sizes: list[int], sets: list[np.ndarray], leaves: list[np.ndarray], copies: list[int], me: int, threshold: int, rows: int = 256) -> tuple[list[tuple[int, int]], np.ndarray]:
    """One leaf, joined exactly: its components, as (member, least member) links, and each member's number of linked
    documents in texts other than its own. sets hold the shared shingles only.

    A pair that meets in several leaves (``leaves`` names each member's, ascending) is counted in the first of them.
    Shingles that a sixteenth of the members hold are compared by one matrix product, the others by their postings."""
    count = len(ids)
    n, weight = np.array(sizes, np.int64), np.array(copies, np.int64)

    def index(lists):
        """(member, name) of each entry, and the number of names."""
        names, token = np.unique(np.concatenate(lists), return_inverse=True) if count else (np.zeros(0), np.zeros(0, int))
        return np.repeat(np.arange(count), [len(x) for x in lists]), token, len(names)

    def product(member, token, kinds):
        """For a block of members: how many names they share with each member."""
        times = np.bincount(token, minlength=kinds)
        dense = times * 16 > count
        place = np.cumsum(dense) - 1
        matrix = np.zeros((count, int(dense.sum())), np.float32)
        common = dense[token]
        matrix[member[common], place[token[common]]] = 1
        member, token = member[~common], token[~common]
        by = np.argsort(token, kind="stable")
        posting, heads = member[by], np.searchsorted(token[by], np.arange(kinds + 1))
        starts = np.searchsorted(member, np.arange(count + 1))

        def block(a, b):
            out = np.rint(matrix[a:b] @ matrix.T).astype(np.int64)
            t = token[starts[a] : starts[b]]
            row = member[starts[a] : starts[b]] - a
            many = heads[t + 1] - heads[t]
            # Postings in pieces of about a million, however many members share these names.
            upto = np.cumsum(many)
            cuts = np.searchsorted(upto, np.arange(1, int(upto[-1]) // (1 << 20) + 1) << 20) if len(upto) else np.zeros(0, int)
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)]):
                if i < j and (own := many[i:j]).sum():
                    first = np.repeat(heads[t[i:j]] - np.cumsum(own) + own, own)
                    other = posting[first + np.arange(own.sum())]
                    out += np.bincount(np.repeat(row[i:j], own) * count + other, minlength=(b - a) * count).reshape(b - a, count)
            return out

        return block

    shared_by = product(*index(sets))
    earlier = [own[own < me] for own in leaves]
    met_before = product(*index(earlier)) if any(map(len, earlier)) else None
    comp, linked = np.arange(count), np.zeros(count, np.int64)
    rows = max(1, min(rows, (1 << 22) // max(1, count)))  # a block's counts are at most 4 million
    for a in range(0, count, rows):
        b = min(count, a + rows)
        common = shared_by(a, b)
        near = 100 * common >= threshold * (n[a:b, None] + n[None, :] - common)
        near[np.arange(b - a), np.arange(a, b)] = False
        fresh = near & (met_before(a, b) == 0) if met_before else near
        linked[a:b] = fresh @ weight
        for k in np.flatnonzero(near.any(1)).tolist():
            joined = np.unique(np.append(comp[near[k]], comp[a + k]))
            if len(joined) > 1:
                comp[np.isin(comp, joined)] = joined[0]
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, np.array(ids, np.int64))
    return [(i, int(m)) for i, m in zip(ids, least[comp].tolist()) if i != m], linked


def _leaves(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Rows of links (a, b) and of counts (a, links): members has region, id; sets has id, first, copies, n, hashes."""
    named = members.select("id", F.xxhash64("region").alias("leaf")).distinct()
    lists = named.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    rows = named.join(sets.join(lists, "id"), "id")

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_pylist()
        firsts = column("first")
        links, counts = leaf_links(firsts, column("n"), [_from_six(h) for h in column("hashes")], [np.array(x, np.int64) for x in column("leaves")], column("copies"), table["leaf"][0].as_py(), threshold)
        told = [(i, None, int(k)) for i, k in zip(column("id"), counts.tolist()) if k]
        a, b, k = zip(*([(x, y, None) for x, y in links] + told)) if links or told else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(k, pa.int64())})

    return rows.groupBy("leaf").applyInArrow(run, "a long, b long, links long")


def _distances(rows: DataFrame) -> DataFrame:
    """Adds d, the Jaccard distance of (n, hashes) and (pn, phashes)."""

    def run(batches):
        for batch in batches:
            x, y = batch["hashes"].to_pylist(), batch["phashes"].to_pylist()
            n, m = batch["n"].to_pylist(), batch["pn"].to_pylist()
            d = []
            for a, b, i, j in zip(x, y, n, m):
                common = len(np.intersect1d(_from_six(a), _from_six(b), assume_unique=True))
                d.append(1 - common / (i + j - common))
            yield pa.RecordBatch.from_arrays([batch["region"], batch["id"], batch["pivot"], pa.array(d, pa.float64())], names=["region", "id", "pivot", "d"])

    return rows.select("region", "id", "pivot", "n", "hashes", "pn", "phashes").mapInArrow(run, "region string, id long, pivot long, d double")


def _split(big: DataFrame, sets: DataFrame, eps: float, pivots: int) -> DataFrame:
    """One step of the recursion: (parent, region, id), Voronoi cells of each region's new pivots, with boundary copies.

    ``pivots`` documents are taken from each region by hash (one from each of as many hash classes)."""
    slot = F.pmod(F.xxhash64("region", "id"), F.lit(pivots))
    chosen = big.groupBy("region", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", "region").alias("h"), "id")).alias("p")).select("region", F.col("p.id").alias("pivot"))
    own = sets
    with_pivot = big.join(own, "id").join(chosen.join(own.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("hashes").alias("phashes")), "pivot"), "region")
    far = shared.materialize(_distances(with_pivot), "distances")
    nearest = far.groupBy("region", "id").agg(F.min("d").alias("least"))
    cells = far.join(nearest, ["region", "id"]).filter(F.col("d") <= F.col("least") + 2 * eps + 1e-9)
    return cells.select(F.col("region").alias("parent"), F.concat_ws("/", "region", F.col("pivot").cast("string")).alias("region"), "id")


def _blocks(big: DataFrame, sizes: DataFrame, leaf_shingles: int) -> DataFrame:
    """Cut each region into blocks; each pair of blocks is a region. A pair of blocks holds a leaf of shingles, but for
    regions above four leaves, of which a pair holds a quarter until that is ten leaves: a member is copied to as many
    pairs as there are blocks."""
    k = F.greatest(F.lit(2), F.ceil(2 * F.col("weight") / (10 * leaf_shingles)), F.least(F.lit(8), F.ceil(2 * F.col("weight") / leaf_shingles)))
    cut = big.join(sizes.select("region", k.cast("long").alias("k")), "region")
    mine = cut.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return pairs.select(F.concat_ws("#", "region", F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string")).alias("region"), "id")


def links(sets: DataFrame, threshold: int = 75, leaf_shingles: int = 100_000, pivots: int = 8) -> DataFrame:
    """Links (a, b) by `first`, whose connected components are those of all pairs within the threshold, and rows
    (a, links) that add up to the number of documents with other texts linked to the vertex of that id.

    sets: id, first, copies, n, uniques, hashes (shared shingles by (frequency, name)); rows of one id are equal."""
    eps = 1 - threshold / 100

    def heads(batches):
        for batch in batches:
            out_id, out_s = [], []
            for i, n, u, raw in zip(*(batch[c].to_pylist() for c in ("id", "n", "uniques", "hashes"))):
                first = _from_six(raw)[: max(0, _prefix(n, threshold) - u)].view(np.int64)
                out_id.append(np.full(len(first), i, np.int64))
                out_s.append(first)
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_s))], names=["id", "s"])

    postings = sets.select("id", "n", "uniques", "hashes").mapInArrow(heads, "id long, s long")
    # A text may stand in several batches: its shingles then count twice, and all of them are "shared". The pivots
    # are a table of their own, so that a shingle of many texts is split by adaptive execution when it is joined.
    pivot = shared.materialize(postings.groupBy("s").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("last > pivot").select("s", "pivot"), "pivots")
    members = shared.materialize(postings.join(pivot, "s").select(F.col("pivot").cast("string").alias("region"), "id").distinct(), "regions")
    slim = sets.select("id", F.col("n").alias("w")).distinct()
    sets = sets.select("id", "first", "copies", "n", "hashes").dropDuplicates(["id"])
    found = []
    while True:
        weights = members.join(slim, "id").groupBy("region").agg(F.sum("w").alias("weight"), F.count("*").alias("k"))
        big = shared.materialize(weights.filter(F.col("weight") > leaf_shingles).filter("k > 2"), "big")
        if big.isEmpty():
            found.append(members)
            break
        found.append(members.join(big, "region", "left_anti"))
        rest = members.join(big.select("region"), "region", "left_semi")
        cells = shared.materialize(_split(rest, sets, eps, pivots).distinct(), "cells")
        # The work of a region goes with its square. Where its cells save less than half of it (they overlap, or its
        # documents lie at one distance), the region's own blocks are taken; so each further step halves the work.
        work = cells.join(slim, "id").groupBy("parent", "region").agg(F.sum("w").cast("double").alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
        told = big.join(work.withColumnRenamed("parent", "region"), "region").select("region", "weight", (2 * F.col("work") <= F.col("weight").cast("double") * F.col("weight")).alias("better"))
        told = shared.materialize(told, "told")
        same = told.filter("not better").select("region", "weight")
        found.append(shared.materialize(_blocks(members.join(same.select("region"), "region", "left_semi"), same, leaf_shingles), "blocks"))
        members = shared.materialize(cells.join(told.filter("better").select(F.col("region").alias("parent")), "parent", "left_semi").select("region", "id"), "members")
    out = found[0].select("region", "id")
    for more in found[1:]:
        out = out.unionByName(more.select("region", "id"))
    return _leaves(shared.materialize(out, "leaves"), sets, threshold)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b), by alternating large-star and small-star steps."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared.materialize(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are tables of their own, so that adaptive execution can split a star's many rows.
        low = shared.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = shared.materialize(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = shared.materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = tuple(now)


def jaccard_join(docs: DataFrame, width: int = 5, threshold: int = 75, leaf_shingles: int = 100_000, pivots: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs(doc_id, text)."""
    shared.tune(docs.sparkSession)
    entries = shared.materialize(document_sets(docs, width), "entries")
    # Equal word sequences are one vertex, named by the upper half of their fingerprint; in the odd case that
    # two sequences share that half, the lower half decides and both keep names of their own.
    own = entries.filter("n > 0 and doc_id is not null").distinct()
    prints = own.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    prints = shared.materialize(prints, "prints")
    clash = prints.groupBy("hi").agg(F.count("*").alias("k")).filter("k > 1").select("hi")
    name = F.when(F.col("clash"), F.xxhash64("hi", "lo")).otherwise(F.col("hi"))
    # Broadcast by a bound on its size: among n texts about n * n / 2^64 halves are shared, a few dozen for 10^10.
    clashing = clash.select("hi", F.lit(True).alias("clash"))
    named = lambda df: df.join(F.broadcast(clashing), "hi", "left").withColumn("clash", F.coalesce("clash", F.lit(False))).withColumn("id", name)
    sets = named(shared_shingles(docs.filter("doc_id is not null"), width, threshold).join(prints, ["hi", "lo"]))
    sets = shared.materialize(sets.select("id", "first", "copies", "n", "uniques", "hashes"), "sets")
    found = shared.materialize(links(sets, threshold, leaf_shingles, pivots), "links")
    # Vertices carry their least doc_id: a component's name is the answer already, and no class is joined.
    whole = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = named(prints).join(whole.withColumnRenamed("id", "first"), "first", "left").join(counts, "id", "left")
    known = shared.materialize(known.select("hi", "lo", F.coalesce("component", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    has_set = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return (
        entries.join(known, ["hi", "lo"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(has_set, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has_set, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))
    )
