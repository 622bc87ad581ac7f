"""Sequence packing by non-negative least squares.

Documents are tokenised, closed with an end id and cut into windows; the remainders' lengths form a
histogram. Shallow combinations of lengths (pairs and triples) that fill a window exactly are the columns
of a non-negative least squares problem, whose rounded solution says how often each combination is used.
What is left is packed greedily, largest first, each window filled to the brim by cutting the next piece.
A shard's last ids go to sequences whose lengths are powers of two, which need no padding.

Packing runs inside the tasks that tokenise: each shard (at most ``shard_tokens`` ids of one partition)
has its own histogram and solution, so nothing is shuffled, no count is gathered, and a sequence's number
holds its partition's. A shard leaves at most log2(window) short sequences.

Ids are those of the ``tokenizers`` file. Where a text holds only characters for which both libraries
were shown to agree (see ``agreed``; the tests try every such character in a frame and random mixtures of
them), the faster ``tiktoken`` reading of the same vocabulary is used. Of the triples of lengths an even grid of at
most about 4,096 stands in the least squares problem; what they do not fit is packed greedily.

Cases: null or empty text is one piece holding the end id alone. A text longer than a shard is a shard
of its own. Repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Latin, IPA, Greek, Cyrillic, Hebrew, Arabic letters, general punctuation, CJK, Hangul and Kana: assigned
#: since the earliest Unicode version in use, so both libraries class them alike. All else takes `tokenizers`.
agreed = re.compile("[\\x00-ɏɐ-˿Α-ΡΣ-ϿЀ-џ‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣！-～]*")


class Encoder:
    """Token ids of the byte-level BPE file `path`; `ranks` is the same vocabulary for tiktoken, or None."""

    def __init__(self, path: str, ranks: str | None, pattern: str, end_text: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        self.special = end_text
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and agreed.fullmatch(text) and self.special not in text:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()) if hasattr(self.fast, "encode_to_numpy") else np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def combinations(lengths: np.ndarray, window: int, triples: int = 4096) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 of present lengths that fill the window; c = 0 for pairs.

    All pairs; of the triples those of an even grid over the present lengths, at most about `triples`."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    b = lengths[lengths <= window // 2]
    a = window - b
    pairs = np.stack([a, b, np.zeros_like(b)], 1)[present[a]] if len(b) else np.zeros((0, 3), np.int64)
    small = lengths[lengths <= window // 2]
    step = max(1, int(np.ceil(len(small) / max(1, np.sqrt(2 * triples)))))
    x, y = np.meshgrid(small[::step], small, indexing="ij")
    z = window - x - y
    ok = (z >= 1) & (x >= y) & (z >= x) & (z <= window)
    ok[ok] = present[z[ok]]
    found = np.stack([z[ok], x[ok], y[ok]], 1)
    return np.concatenate([pairs, found[:: max(1, len(found) // triples)]]).astype(np.int64)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 120) -> np.ndarray:
    """Non-negative least squares: x >= 0 with sum_j x_j * column_j near the histogram, by accelerated
    projected gradient (columns have three entries, so products are gathers); slot 0 has no weight."""
    if not len(combos):
        return np.zeros(0, np.int64)
    weight = (combos > 0).astype(float)
    target = histogram.astype(float)
    degree = np.bincount(combos.ravel(), weights=weight.ravel(), minlength=len(histogram))
    bound = 3.0 * max(1.0, degree[1:].max())  # of the largest eigenvalue
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        made = np.bincount(combos.ravel(), weights=(weight * y[:, None]).ravel(), minlength=len(histogram))
        slope = (weight * (made - target)[combos]).sum(1)
        nxt = np.maximum(0, y - slope / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return np.maximum(0, np.rint(x)).astype(np.int64)


def pack_lengths(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first id, ids) over pieces of the given lengths (each 1..window)."""
    order = np.argsort(-lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(window + 1)]
    for i in order[::-1].tolist():
        stock[lengths[i]].append(i)
    out = [[(i, 0, window)] for i in stock[window]]
    histogram = np.array([len(s) for s in stock])
    histogram[0] = histogram[window] = 0
    combos = combinations(np.flatnonzero(histogram), window)
    times = solve_counts(combos, histogram)
    for k in np.argsort(-times, kind="stable").tolist():
        if not times[k]:
            break
        parts = [int(v) for v in combos[k] if v]
        need = {v: parts.count(v) for v in parts}
        for _ in range(min(int(times[k]), *(len(stock[v]) // c for v, c in need.items()))):
            out.append([(stock[v].pop(), 0, v) for v in parts])
    left = [(i, v) for v in range(window - 1, 0, -1) for i in stock[v]]
    room, sequence = window, []
    for i, v in left:
        first = 0
        while v:
            take = min(room, v)
            sequence.append((i, first, take))
            first, v, room = first + take, v - take, room - take
            if not room:
                out.append(sequence)
                room, sequence = window, []
    size = window - room  # the tail: one sequence for each binary digit
    digits = [1 << k for k in range(window.bit_length(), -1, -1) if size >> k & 1]
    for want in digits:
        part = []
        while want:
            i, first, v = sequence.pop(0)
            take = min(want, v)
            part.append((i, first, take))
            want -= take
            if take < v:
                sequence.insert(0, (i, first + take, v - take))
        out.append(part)
    return out


def pack(docs: DataFrame, path: str, ranks: str | None, pattern: str, window: int = 1024, end_id: int = 0, shard_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece; sequences of at most `window` ids."""
    shared.tune(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder(path, ranks, pattern)
        number = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0
        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                got = np.append(encoder(text), np.uint32(end_id)).astype(np.uint32) if text else np.array([end_id], np.uint32)
                if held and held + len(got) > shard_tokens:
                    yield from shard(names, ids, number)
                    number += held
                    names, ids, held = [], [], 0
                names.append(name)
                ids.append(got)
                held += len(got)
        if held:
            yield from shard(names, ids, number)

    def shard(names, ids, number):
        sizes = np.array([len(x) for x in ids])
        pieces = (sizes + window - 1) // window
        doc = np.repeat(np.arange(len(ids)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lengths = np.minimum(window, sizes[doc] - nth * window)
        columns: list[list] = [[] for _ in range(7)]
        for k, sequence in enumerate(pack_lengths(lengths, window)):
            offset = 0
            for piece, first, take in sequence:
                d = int(doc[piece])
                start = int(nth[piece]) * window + first
                own = ids[d][start : start + take]
                for column, value in zip(columns, (names[d], start, take, zlib.crc32(own.astype("<u4").tobytes()), len(ids[d]), number + k, offset)):
                    column.append(value)
                offset += take
        for i in range(0, len(columns[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], pa.int64()) for c in columns], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
