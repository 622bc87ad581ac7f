"""Quality rules by compression bands.

Base counts of every whole text (words are ``[^\\x20\\x09-\\x0D]+``) and a verdict: the zstandard ratio
(compressed / raw bytes) of the whole document and of each fixed chunk must lie in the band that belongs
to its length. Below the band a text is repetitive, above it incompressible (noise, encoded data).

Bands are wide for short texts, where frame overhead hides repetition, and narrow for long ones. A text
shorter than the first band has no verdict of its own and is kept if the base rules keep it. No ratio tells
hexadecimal digits of less than about 4.5 KB, or templates of less than 1 KB, from prose of that length.

Cases: null text counts as no text: all counts 0, ratio null, base_failed true (fewer than 50 words),
kept false; the same for empty text. A very long text is held in memory
with its counts (about 40 bytes for each of its own), but no more than that one text at a time. Repeated rows and ties are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Bands:
    """(least bytes, least ratio, largest ratio), the last row whose bytes fit is used.

    Measured at this level, by bytes: English manuals and licences reach 0.88 (256), 0.75 (512), 0.67 (1 KB),
    0.61 (2 KB), 0.53 (4 KB), 0.45 (8 KB), 0.41 (16 KB); Chinese messages 0.82 (512), 0.70, 0.60, 0.52, 0.45 (8 KB).
    Base64 takes 0.93 (300), 0.85 (512), 0.80, 0.78, 0.76, 0.76, 0.76; random printable ASCII 0.83 or more; base32
    0.64 from 2 KB; hexadecimal 0.50-0.53 from 4 KB and 0.65-0.54 below, where its ratio is that of prose. Filled-in
    templates fall from 0.38 (600) to 0.31 (1.2 KB), 0.25 (2.5 KB), 0.22 (5 KB), 0.21 (20 KB); prose stays above
    0.34 (1 KB), 0.34, 0.32, 0.29, 0.27 (16 KB), up to a few tables and lists."""

    document: tuple = (
        (256, 0.35, 0.90), (384, 0.35, 0.84), (512, 0.33, 0.82), (768, 0.33, 0.78), (1024, 0.32, 0.72), (2048, 0.28, 0.62),
        (4096, 0.26, 0.522), (4608, 0.26, 0.511), (6144, 0.26, 0.50), (8192, 0.25, 0.485), (16384, 0.24, 0.46),
    )
    chunk: tuple = ((1024, 0.32, 0.72), (2048, 0.28, 0.62), (4096, 0.26, 0.522))
    chunk_bytes: int = 4096
    #: Share of chunks outside their band from which a document is rejected.
    bad_chunks: float = 0.25
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _outside(size: int, ratio: float, bands: tuple) -> bool:
    band = None
    for row in bands:
        if size >= row[0]:
            band = row
    return band is not None and not band[1] <= ratio <= band[2]


def compression(raw, bands: Bands, codec) -> tuple[float | None, int, int, bool]:
    """(ratio, chunks, chunks outside their band, verdict) of one text's bytes."""
    size = len(raw)
    if not size:
        return None, 0, 0, False
    ratio = len(codec.compress(raw)) / size
    chunks = bad = 0
    for at in range(0, size, bands.chunk_bytes):
        piece = raw[at : at + bands.chunk_bytes]
        chunks += 1
        bad += _outside(len(piece), len(codec.compress(piece)) / len(piece), bands.chunk)
    return ratio, chunks, bad, not _outside(size, ratio, bands.document) and bad < max(1, bands.bad_chunks * chunks)


def duplicate_lines(raw: bytes) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def compression_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: base counts, base_failed, kept, and the ratios behind the verdict."""
    shared.tune(docs.sparkSession)

    def run(batches):
        import zstandard

        codec = zstandard.ZstdCompressor(level=bands.level)
        for table in shared.gathered(batches):
            hashes, counts = shared.hashed_words(table["text"], lower=False)
            at, raw = shared.offsets_of(table["text"])
            start = int(at[0])
            body = raw[start : int(at[-1])]
            at = at - start
            solid = ~shared._SPACE[body] & ((body & 0xC0) != 0x80)

            def per_text(flags):
                total = np.zeros(len(body) + 1, np.int64)
                np.cumsum(flags, out=total[1:])
                return np.diff(total[at])

            doc = np.repeat(np.arange(len(counts)), counts)
            repeated = np.zeros(len(counts), np.int64)
            if len(hashes) >= 3:
                n = len(hashes) - 2
                inside = doc[:n] == doc[2:]
                keys = shared.mix(hashes[:n]) + shared.mix(hashes[1 : n + 1] + np.uint64(1)) * np.uint64(3) + shared.mix(hashes[2:] + np.uint64(2)) * np.uint64(5)
                keys = shared.mix(shared.mix(keys) + doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, back, times = np.unique(keys[inside], return_inverse=True, return_counts=True)
                twice = np.zeros(n, bool)
                twice[inside] = times[back] > 1
                covered = np.zeros(len(hashes), bool)
                for j in range(3):
                    covered[j : j + n] |= twice
                repeated = np.bincount(doc[covered], minlength=len(counts))
            failed = (counts < bands.min_words) | (100 * repeated > bands.repeat_percent * counts)
            view = memoryview(body)
            lines, found = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                piece = view[a:b]
                lines.append(duplicate_lines(bytes(piece)))
                found.append(compression(piece, bands, codec))
            ratio, chunks, bad, good = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    table["doc_id"].combine_chunks(), pa.array(counts.astype(np.int64)), pa.array(per_text(solid)), pa.array(per_text(_SYMBOLS[body])),
                    pa.array(lines, pa.int64()), pa.array(repeated.astype(np.int64)), pa.array(failed), pa.array(~failed & np.array(good)),
                    pa.array(ratio, pa.float64()), pa.array(chunks, pa.int64()), pa.array(bad, pa.int64()),
                ],
                names=[f.split()[0] for f in _SCHEMA.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
