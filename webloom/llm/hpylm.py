"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants, in three levels: the root serves all words (base: uniform over the vocabulary and one unknown word);
below it stands one restaurant for each previous word of the corpus, and all of them share the root as parent; below
these stands one for each two previous words, and all whose last word is the same share that word's restaurant as
parent. Customers enter at the lowest level; every table is a customer of the same dish one level up. The model
gathers one restaurant for each word and for each pair of words that follow each other, and one dish for each pair
and for each triple, so it grows with the corpus; no context is hashed together with another. A text starts, and
ends, at the same mark: the first word's context is twice that mark.

Seating is sampled by Gibbs. A sweep takes ``rounds`` customers of every dish in turn, at random, from their
tables and seats them anew: at a table with a chance of (its customers - discount), at a new one with a chance
of (strength + discount * tables of the restaurant) * the parent's predictive probability. Seats are kept from
sweep to sweep. The first seats are drawn by seating the customers in turn (dishes of many customers in runs,
see ``Seats.grow``); Gibbs goes on from there. Dishes move at the same time: within a round each sees the
restaurant as the others left it in the round before, and the root's probabilities and the tables that other
ranges hold are those of the last sweep. After a sweep all totals are summed anew, so tables, totals and root
belong to one state: the predictive probabilities of each sample sum to 1. They are averaged over ``samples``
states after ``burn_in`` sweeps. A sweep goes from the lowest level up; the seats of the two levels above gain and
lose customers with the tables below and are reseated in the same way.

Distribution: a batch of texts becomes its distinct triples (word before, previous word, word), held by pair
(previous word, word); words that a bounded sample holds often are written by number, all others by name. Pairs lie in a grid of ranges: rows by the hash of the previous word, columns by that of the
word, both growing with the root of the input. A frequent word's pairs are thus spread over a whole row and a whole
column, and a frequent triple comes once for each batch. A range holds the counts and seats of its triples and of
their pairs, which are their parents' dishes. Totals of the restaurants of one and of two previous words and the
root (by word) lie in slots, some for each row and column: after a sweep a range sends its words' and contexts' new
tables to its slots, packed and without names, and gets the totals of its own back. Nothing that grows with the
corpus comes to the driver; it gets six numbers a sweep. Only merged ranges are stored: their distinct triples with
counts, and for each batch the places of its own among them. At the end the triples' probabilities return to their
batch, which adds them up by document.

Base score: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, by exact counts of all training texts.
Words are told apart by their row or column and the next 48 bits of their hash, the word before by 48 bits, the
context of two words by its row and 52 bits.

Cases: null text is empty: one end token. Without training rows N = V = 0, and either score is 0. A null
doc_id is held out (its crc32 is unknown). Repeated rows count and score as often as they occur; other
columns are ignored, whatever their names. A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Settings:
    burn_in: int = 2
    samples: int = 3
    #: Customers of each dish that are reseated in a sweep.
    rounds: int = 8
    strength: float = 1.0
    seed: int = 7
    #: Previous words of the longest context: 1 or 2.
    words: int = 2
    #: Bytes of input for each range; bounds a worker's memory.
    range_bytes: int = 6 << 20
    #: Words that batches write by number, and the texts (and characters of each) that tell which words are common.
    common: int = 1 << 15
    common_texts: int = 2048
    common_chars: int = 4096


_END = np.uint64(0x5851F42D4C957F2D)
_CONTEXT_BITS = 52
_NO_ID = -(1 << 63)
_ROW = "rng int, slot int, batch long, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, x double"
_ARROW = pa.schema([("rng", pa.int32()), ("slot", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), *[(n, pa.binary()) for n in "abcdefgh"], ("x", pa.float64())])
# Kinds of rows: a batch's documents; its pairs in a range; a range's totals for a slot; a slot's answer; seats;
# a number for the driver; training counts; a batch's probabilities from a range; a batch's places in a range.
_HOME, _PAIRS, _TOTALS, _ANSWER, _SEATS, _NUMBER, _COUNTS, _VALUES, _PLACES = range(9)


def _row(kind: int, rng: int = -1, slot: int = -1, batch: int = -1, a=None, b=None, c=None, d=None, e=None, f=None, g=None, h=None, x=None) -> tuple:
    return rng, slot, batch, kind, a, b, c, d, e, f, g, h, x


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)] if rows else [], _ARROW)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers >= 0, by byte plane and compressed: upper planes are near empty."""
    import zstandard

    values = np.ascontiguousarray(values, np.int64)
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, : raw[0]] = got.T
    return out.reshape(-1).view(np.int64)


def _names(words: np.ndarray, common: np.ndarray | None = None) -> bytes:
    """Distinct ascending names of words, as steps; those of common words as steps of their numbers."""
    if common is None:
        return _pack(np.diff(words, prepend=0))
    at = np.minimum(np.searchsorted(common, words), len(common) - 1) if len(common) else np.zeros(len(words), np.int64)
    short = common[at] == words if len(common) else np.zeros(len(words), bool)
    numbers = _names(at[short])
    return len(numbers).to_bytes(4, "little") + numbers + _names(words[~short])


def _words(raw: bytes, common: np.ndarray | None = None) -> np.ndarray:
    if common is None:
        return np.cumsum(_unpack(raw))
    cut = 4 + int.from_bytes(raw[:4], "little")
    return np.sort(np.concatenate([common[_words(raw[4:cut])], _words(raw[cut:])]))


class Seats:
    """Tables of dishes: for each table its dish (ascending) and its customers."""

    def __init__(self, dish: np.ndarray, size: np.ndarray, dishes: int):
        self.dish, self.size, self.dishes = dish, size, dishes

    @classmethod
    def none(cls, dishes: int) -> Seats:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), dishes)

    @classmethod
    def read(cls, tables: bytes, sizes: bytes) -> Seats:
        per = _unpack(tables)
        return cls(np.repeat(np.arange(len(per)), per), _unpack(sizes).copy(), len(per))

    def written(self) -> tuple[bytes, bytes]:
        return _pack(self.tables()), _pack(self.size)

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=self.dishes)

    def customers(self) -> np.ndarray:
        return np.bincount(self.dish, weights=self.size, minlength=self.dishes).astype(np.int64)

    def grow(self, customers: np.ndarray, attraction: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Seat customers in turn until each dish has as many as asked for. A customer opens a table with
        probability attraction / (attraction + seated - discount * tables). Those of one dish come in runs of an
        eighth of the seated, whose new tables are one binomial draw; the others join by a Polya urn."""
        seated, tables = self.customers(), self.tables()
        joins = customers - seated
        opened = np.zeros(self.dishes, np.int64)
        live = np.flatnonzero(joins > 0)
        n, t, a = seated[live], tables[live], attraction[live]
        while len(live):
            steps = np.minimum(np.maximum(1, n // 8), customers[live] - n)
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(n == 0, 1.0, np.clip(a / (a + n + (steps - 1) / 2 - discount * t), 0, 1))
            new = rng.binomial(steps, p)
            opened[live] += new
            n, t = n + steps, t + new
            more = customers[live] > n
            live, n, t, a = live[more], n[more], t[more], a[more]
        joins = np.maximum(0, joins) - opened
        order = np.argsort(np.concatenate([self.dish, np.repeat(np.arange(self.dishes), opened)]), kind="stable")
        dish = np.concatenate([self.dish, np.repeat(np.arange(self.dishes), opened)])[order]
        size = np.concatenate([self.size, np.ones(int(opened.sum()), np.int64)])[order]
        if len(dish):
            share = rng.gamma(size - discount)
            upto = np.cumsum(share)
            last = np.cumsum(np.bincount(dish, minlength=self.dishes)) - 1
            ends = np.where(last >= 0, upto[last], 0.0)
            begins = np.concatenate([[0.0], ends[:-1]])
            part = np.where(ends > begins, ends - begins, 1.0)
            to = np.floor(np.clip((upto - begins[dish]) / part[dish], 0, 1) * joins[dish] + rng.random(self.dishes)[dish]).astype(np.int64)
            final = np.zeros(len(dish), bool)
            final[last[np.bincount(dish, minlength=self.dishes) > 0]] = True
            to[final] = joins[dish[final]]
            before = np.concatenate([[0], to[:-1]])
            before[1:][dish[1:] != dish[:-1]] = 0
            size = size + to - before
        self.dish, self.size = dish, size

    def shrink(self, customers: np.ndarray, rng: np.random.Generator) -> None:
        """Take customers away at random until no dish has more than asked for."""
        left = np.maximum(0, self.customers() - customers)
        rest = self.customers()
        first = np.searchsorted(self.dish, np.arange(self.dishes))
        tables, k = self.tables(), 0
        live = np.flatnonzero(left)
        while len(live):
            at = first[live] + k
            own = self.size[at]
            rest[live] -= own
            whole = own + rest[live]
            gone = np.where(whole < 10**9, rng.hypergeometric(np.minimum(own, 10**9), np.minimum(rest[live], 10**9), np.minimum(left[live], np.minimum(whole, 10**9))), np.minimum(own, rng.binomial(left[live], own / whole)))
            gone = np.maximum(gone, left[live] - rest[live])
            self.size[at] -= gone
            left[live] -= gone
            k += 1
            live = live[(left[live] > 0) & (tables[live] > k)]
        held = self.size > 0
        self.dish, self.size = self.dish[held], self.size[held]

    def reseat(self, parent: np.ndarray, restaurant: np.ndarray, tables: np.ndarray, strength: float, discount: float, rng: np.random.Generator, rounds: int) -> None:
        """Gibbs: in each round one customer of every dish with two or more leaves its table and is seated anew.

        parent: the parent's probability of each dish; restaurant: that of each dish; tables: all tables of each
        restaurant, those of other ranges too, kept up to date."""
        customers = self.customers()
        who = np.flatnonzero(customers > 1)
        if not len(who):
            return
        moving = (customers > 1)[self.dish]
        kept = self.dish[~moving], self.size[~moving]
        name = np.full(self.dishes, -1)
        name[who] = np.arange(len(who))
        dish, size = name[self.dish[moving]], self.size[moving]
        n, p, of = customers[who], parent[who], restaurant[who]
        base = np.cumsum(n) - n
        mine = np.bincount(dish, minlength=len(who))
        for _ in range(rounds):
            ends = np.cumsum(np.bincount(dish, minlength=len(who)))
            picked = np.searchsorted(np.cumsum(size), base + (rng.random(len(who)) * n).astype(np.int64), side="right")
            size[picked] -= 1
            died = size[picked] == 0
            mine -= died
            tables -= np.bincount(of[died], minlength=len(tables))
            a = (strength + discount * tables[of]) * p
            opens = rng.random(len(who)) < a / (a + (n - 1) - discount * mine)
            pull = np.cumsum(np.where(size > 0, size - discount, 0.0))
            high = pull[ends - 1]
            low = np.concatenate([[0.0], high[:-1]])
            joined = np.searchsorted(pull, low + rng.random(len(who)) * (high - low), side="right")
            first = np.concatenate([[0], ends[:-1]])
            joined = np.clip(joined, first, ends - 1)
            lost = size[joined] == 0  # a rounding error met an empty table
            joined = np.where(lost, np.where(died, joined, picked), joined)
            opens |= size[joined] == 0
            size[joined[~opens]] += 1
            size[picked[opens & died]] = 1
            new = opens & ~died
            mine += opens
            tables += np.bincount(of[opens], minlength=len(tables))
            held = size > 0
            at = ends[new]
            dish, size = np.insert(dish, at, np.flatnonzero(new)), np.insert(size, at, 1)
            if not held.all():
                held = size > 0
                dish, size = dish[held], size[held]
        dish = np.concatenate([kept[0], who[dish]])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], np.concatenate([kept[1], size])[order]


@dataclass(frozen=True)
class _Grid:
    """Ranges, numbered by row and column; the words of each row and of each column lie in `subs` slots, the contexts of
    two words of a row in as many as it has ranges."""

    rows: int
    columns: int
    subs: int

    @classmethod
    def of(cls, docs: DataFrame, settings: Settings) -> _Grid:
        """By the input's size alone: ranges of equal size; a slot takes the words of about four ranges."""
        wanted = min(1 << 28, max(8, shared.size_in_bytes(docs) / settings.range_bytes))
        rows = int(np.ceil(np.sqrt(wanted)))
        return cls(rows, int(np.ceil(wanted / rows)), int(np.ceil(rows / 4)))

    def ranges(self) -> int:
        return self.rows * self.columns

    def axis(self, slot: int) -> int:
        return 0 if slot < self.rows * self.subs else 1 if slot < (self.rows + self.columns) * self.subs else 2

    def sent(self, number: int, axis: int, names: np.ndarray, *values: np.ndarray):
        """(slot, names, values...) of what a range has on an axis: 0 previous words, 1 words, 2 contexts of two words."""
        row, column = divmod(number, self.columns)
        subs, bits = (self.columns, _CONTEXT_BITS) if axis == 2 else (self.subs, 48)
        first = (row * self.subs, (self.rows + column) * self.subs, (self.rows + self.columns) * self.subs + row * self.columns)[axis]
        cuts = np.searchsorted(names, [-(-(k << bits) // subs) for k in range(subs + 1)])
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield first + k, *(v[cuts[k] : cuts[k + 1]] for v in (names, *values))

    def told(self, answers: list[dict], axis: int, column: str) -> np.ndarray:
        """The answers to what was sent on an axis, in the same order."""
        return np.concatenate([_unpack(r[column]) for r in sorted((r for r in answers if self.axis(r["slot"]) == axis), key=lambda r: r["slot"])])


def _placed(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The row or column of word hashes, and their names there: the next 48 bits, ascending with the hash."""
    part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    first = np.array([-(-(k << 32) // parts) << 32 for k in range(parts)], np.uint64)
    return part, ((words - first[part]) >> np.uint64(max(0, 16 - (parts.bit_length() - 1)))).astype(np.int64)


def _before(words: np.ndarray) -> np.ndarray:
    """The names of words before the previous word."""
    return (words >> np.uint64(16)).astype(np.int64)


def _released() -> None:
    """Give memory that a worker no longer uses back to the system, where the C library can; the worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class _Common:
    """The names of common words by row, by column and as words before the previous word; in each list, a word's number
    is its place. Batches write these words in a byte or two; all others by name."""

    def __init__(self, words: np.ndarray, grid: _Grid):
        words = np.unique(words)  # parts and names ascend with the hash
        self._rows, self._columns = _placed(words, grid.rows), _placed(words, grid.columns)
        self.before = np.unique(_before(words))

    def row(self, number: int) -> np.ndarray:
        return self._of(number, *self._rows)

    def column(self, number: int) -> np.ndarray:
        return self._of(number, *self._columns)

    @staticmethod
    def _of(number: int, part: np.ndarray, names: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(part, [number, number + 1])
        return np.unique(names[first:last])


def _common_words(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Hashes of words that a bounded sample of the texts holds most often. They change how batches are written, no result."""
    share = min(1.0, 2 * settings.common_texts * settings.common_chars / max(1, shared.size_in_bytes(docs)))
    texts = docs.select(F.substring(F.col("text").cast("string"), 1, settings.common_chars)).sample(share, settings.seed).limit(settings.common_texts).collect()
    words, counts = np.unique(shared.hashed_words(pa.array([r[0] for r in texts], pa.string()))[0], return_counts=True)
    return np.append(words[np.argsort(-counts, kind="stable")[: settings.common]], _END)


def _home(batch: int, ranges: int) -> int:
    """The range that a batch's documents wait at."""
    return (batch & 0xFFFFFFFF) % ranges


def _packed_rows(docs: DataFrame, grid: _Grid, words_before: int = 1, common: np.ndarray | None = None) -> DataFrame:
    """For each batch of texts: a row of its documents, and one for each range that some of its pairs lie in, with their
    triples if contexts have two words. common: hashes of words that are written by number."""

    def run(batches):
        from pyspark import TaskContext

        short = common is not None and _Common(common, grid)
        base, serial = TaskContext.get().partitionId() << 32, 0
        for table in shared.gathered(batches, limit=3 * shared.BATCH_BYTES // 2):
            hashes, counts = shared.hashed_words(table["text"])
            sizes = counts + 1
            ends = np.cumsum(sizes)
            words = np.empty(int(ends[-1]), np.uint64)
            is_end = np.zeros(len(words), bool)
            is_end[ends - 1] = True
            words[~is_end], words[is_end] = hashes, _END
            held = np.array(table["held_out"].to_pylist(), bool)
            distinct, word = np.unique(words, return_inverse=True)
            before = np.empty_like(word)
            before[1:] = word[:-1]
            before[ends - sizes] = np.searchsorted(distinct, _END)  # a text starts where another has ended
            pairs, token = np.unique(before * np.int64(len(distinct)) + word, return_inverse=True)
            u, w = pairs // len(distinct), pairs % len(distinct)
            (row, row_name), (column, column_name) = _placed(distinct, grid.rows), _placed(distinct, grid.columns)
            own = (row[u] * grid.columns + column[w]).astype(np.int32)
            order = np.argsort(own, kind="stable")
            u, w, own = u[order], w[order], own[order]
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            token = place[token]
            if words_before == 2:
                earlier = np.empty_like(before)
                earlier[1:] = before[:-1]
                earlier[ends - sizes] = before[0]
                triples, token = np.unique(token * np.int64(len(distinct)) + earlier, return_inverse=True)
                within, v = np.bincount(triples // len(distinct), minlength=len(pairs)), triples % len(distinct)
                name = _before(distinct)
                del triples, earlier
            else:
                within = np.ones(len(pairs), np.int64)
            del before, word
            first = np.concatenate([[0], np.cumsum(within)])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            by = np.argsort(token, kind="stable")
            learned = np.bincount(token, weights=~held[doc], minlength=first[-1]).astype(np.int64)
            ids = np.array([_NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
            number = base + serial
            out = [_row(_HOME, _home(number, grid.ranges()), batch=number, a=held.tobytes(), b=_pack(np.bincount(token, minlength=first[-1])), c=_pack(doc[by]), d=ids.tobytes())]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                heads = np.flatnonzero(np.concatenate([[True], u[i + 1 : j] != u[i : j - 1]]))
                per = np.diff(np.append(heads, j - i))
                ws, w_at = np.unique(w[i:j], return_inverse=True)
                deep = {}
                if words_before == 2:
                    vs, v_at = np.unique(v[first[i] : first[j]], return_inverse=True)
                    deep = {"f": _pack(within[i:j]), "g": _names(name[vs], short.before if short else None), "h": _pack(v_at)}
                of_row, of_column = (None, None) if not short else (short.row(own[i] // grid.columns), short.column(own[i] % grid.columns))
                out.append(_row(_PAIRS, int(own[i]), batch=number, a=_names(row_name[u[i:j][heads]], of_row), b=_pack(per), c=_names(column_name[ws], of_column), d=_pack(w_at), e=_pack(learned[first[i] : first[j]]), **deep))
            serial += 1
            for i in range(0, len(out), 64):
                yield _rows(out[i : i + 64])
        hashes = counts = words = distinct = u = w = v = token = doc = by = learned = out = table = None
        _released()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return texts.mapInArrow(run, _ROW)


def _distinct_pairs(rows: list[dict], of_row: np.ndarray | None = None, of_column: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Previous words and words of rows of pairs, the distinct pairs' places among them, and each pair's place among the pairs."""
    us, u = np.unique(np.concatenate([_words(r["a"], of_row) for r in rows]), return_inverse=True)
    u = np.repeat(u, np.concatenate([_unpack(r["b"]) for r in rows]))
    ws, w = _looked_up(rows, "c", "d", of_column)
    u *= len(ws)
    u += w  # one key for each pair; big arrays go as soon as they are used
    del w
    heads, place = _distinct(u)
    return us, ws, heads // len(ws), heads % len(ws), place


def _looked_up(rows: list[dict], names: str, at: str, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names that rows hold in a column, and the place among them of each entry of another column."""
    lists = [_words(r[names], common) for r in rows]
    every, place = np.unique(np.concatenate(lists), return_inverse=True)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return every, np.concatenate([own[_unpack(r[at])] for own, r in zip(np.split(place, cuts), rows)])


def _merged(number: int, found: list[dict], grid: _Grid, short: _Common) -> list[tuple]:
    """A range's rows with those of its pairs made one: names once, distinct pairs and triples, training customers added up.
    Of each batch the places of its triples (or pairs) among them remain; they ascend, as all rows have the same order."""
    out = [_row(r["kind"], number, batch=r["batch"], **{c: r[c] for c in "abcd"}) for r in found if r["kind"] == _HOME]
    rows = sorted((r for r in found if r["kind"] == _PAIRS), key=lambda r: r["batch"])
    if not rows:
        return out
    row, column = divmod(number, grid.columns)
    learned = [_unpack(r["e"]) for r in rows]
    us, ws, u, w, place = _distinct_pairs(rows, short.row(row), short.column(column))
    deep = {}
    if rows[0]["f"] is not None:
        at = np.repeat(place, np.concatenate([_unpack(r["f"]) for r in rows]))
        vs, v = _looked_up(rows, "g", "h", short.before)
        at *= len(vs)
        at += v
        del v
        heads, place = _distinct(at)
        deep = {"f": _pack(np.bincount(heads // len(vs))), "g": _names(vs), "h": _pack(heads % len(vs))}
        del at, heads
    served = np.bincount(place, weights=np.concatenate(learned)).astype(np.int64)
    out.append(_row(_PAIRS, number, a=_names(us), b=_pack(np.bincount(u)), c=_names(ws), d=_pack(w), e=_pack(served), **deep))
    cuts = np.cumsum([len(x) for x in learned])[:-1]
    return out + [_row(_PLACES, number, batch=r["batch"], a=_names(at)) for r, at in zip(rows, np.split(place, cuts))]


class _Range:
    """The distinct pairs of a range: previous word u, word w, training customers. With contexts of two words also its
    triples: the context k, the pair at, training customers; else each pair stands for itself."""

    def __init__(self, rows: list[dict], keep_places: bool = False):
        rows = sorted((r for r in rows if r["kind"] == _PAIRS), key=lambda r: r["batch"])
        self.deep = rows[0]["f"] is not None
        learned = np.concatenate([_unpack(r["e"]) for r in rows])
        self.us, self.ws, self.u, self.w, place = _distinct_pairs(rows)
        if self.deep:
            at = np.repeat(place, np.concatenate([_unpack(r["f"]) for r in rows]))
            del place
            context = np.concatenate([_words(r["g"])[_unpack(r["h"])] for r in rows]).view(np.uint64)
            context += shared.mix(self.us.view(np.uint64))[self.u[at]]
            context = (shared.mix(context) >> np.uint64(64 - _CONTEXT_BITS)).view(np.int64)
            self.contexts, context = np.unique(context, return_inverse=True)
            at *= len(self.contexts)
            at += context
            del context
            heads, place = _distinct(at)
            del at
            self.at, self.k = heads // len(self.contexts), heads % len(self.contexts)
        self.served = np.bincount(place, weights=learned).astype(np.int64)
        #: Training customers of the pairs; in `served` those of the lowest level's dishes.
        self.customers = np.bincount(self.at, weights=self.served).astype(np.int64) if self.deep else self.served
        if keep_places:
            self.places = place

    def totals(self, per_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums by previous word and by word."""
        return tuple(np.bincount(at, weights=per_pair, minlength=len(of)).astype(np.int64) for at, of in ((self.u, self.us), (self.w, self.ws)))

    def by_context(self, per_triple: np.ndarray) -> np.ndarray:
        return np.bincount(self.k, weights=per_triple, minlength=len(self.contexts)).astype(np.int64)

    def by_pair(self, per_triple: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=per_triple, minlength=len(self.u)).astype(np.int64)

    def tables(self, per_dish: bytes | None, many: np.ndarray, served: np.ndarray) -> np.ndarray:
        """Tables of all dishes: as kept for those of many customers, one for others that are served; at first one each."""
        each = (served > 0).astype(np.int64)
        if per_dish is not None:
            each[many] = _unpack(per_dish)
        return each


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty_like(order)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


@dataclass
class _State:
    """What the driver holds of a state: numbers of the whole model."""

    vocabulary: float
    tokens: float
    root_customers: float
    root_tables: float
    discount: float
    root_discount: float
    strength: float
    #: That of contexts of two words.
    deep_discount: float = 0.5

    def lift(self) -> float:
        """What the base gives each word, as customers of the root."""
        return (self.strength + self.root_discount * self.root_tables) / (self.vocabulary + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's predictive probabilities."""
        return (customers - self.root_discount * tables + self.lift()) / (self.strength + self.root_customers)

    def predictive(self, own: np.ndarray, own_tables: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, deep: bool = False) -> np.ndarray:
        """Probabilities of dishes, given their and their restaurant's customers and tables."""
        discount = self.deep_discount if deep else self.discount
        return (own - discount * own_tables + (self.strength + discount * tables) * parent) / (self.strength + customers)


def _discount(ones: float, twos: float) -> float:
    """The usual estimate from counts of counts, kept inside (0, 1)."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos else 0.5


def _counted(packed: DataFrame, grid: _Grid) -> DataFrame:
    """Each range's words and contexts, their training customers, and one table for each dish: its first totals."""

    def run(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        part, number = _Range(found), found[0]["rng"]
        customers, tables = part.totals(part.customers), part.totals(part.customers > 0)
        below = part.by_pair(part.served > 0) if part.deep else part.customers
        out = [_row(_TOTALS, number, slot, a=_names(names), b=_pack(c), c=_pack(t)) for slot, names, c, t in grid.sent(number, 1, part.ws, customers[1], tables[1])]
        out += [_row(_TOTALS, number, slot, a=_names(names), b=_pack(c), c=_pack(t), d=_pack(n) if part.deep else None) for slot, names, c, t, n in grid.sent(number, 0, part.us, customers[0], tables[0], part.totals(below)[0])]
        if part.deep:
            out += [_row(_TOTALS, number, slot, a=_names(names), b=_pack(c), c=_pack(t)) for slot, names, c, t in grid.sent(number, 2, part.contexts, part.by_context(part.served), part.by_context(part.served > 0))]
        numbers = (below == 1).sum(), (below == 2).sum(), (part.served == 1).sum(), (part.served == 2).sum()
        return _table(out + [_row(_NUMBER, slot=-1 - k, x=float(v)) for k, v in enumerate(numbers)])

    return packed.filter(F.col("kind") == _PAIRS).groupBy("rng").applyInArrow(run, _ROW)


def _answers(slot: int, names: list[dict], told: dict[int, tuple], seats: dict | None, grid: _Grid, state: _State | None, settings: Settings, sweep: int) -> list[tuple]:
    """A slot's answers to its ranges: tables by context (of one word: and customers, if longer contexts stand below), or
    the root's customers and tables by word."""
    names = sorted(names, key=lambda r: r["rng"])
    lists = [_words(r["a"]) for r in names]
    words, back = np.unique(np.concatenate(lists), return_inverse=True)
    total = lambda values: np.bincount(back, weights=np.concatenate(values), minlength=len(words)).astype(np.int64)
    counts, now = total([_unpack(r["b"]) for r in names]), total([_unpack(told[r["rng"]][0]) for r in names])
    places = np.split(back, np.cumsum([len(x) for x in lists])[:-1])
    # Training counts do not change: only the first answers hold them.
    out = [_row(_COUNTS, r["rng"], slot, a=_pack(counts[at])) for r, at in zip(names, places)] if state is None else []
    if grid.axis(slot) != 1:
        below = total([_unpack(told[r["rng"]][1]) for r in names]) if names[0]["d"] is not None else None
        return out + [_row(_ANSWER, r["rng"], slot, b=_pack(now[at]), c=None if below is None else _pack(below[at])) for r, at in zip(names, places)]
    if state is None:
        tables = (now > 0).astype(np.int64)
    else:
        rng = np.random.default_rng([settings.seed, 1, sweep, slot])
        root = Seats.read(seats["a"], seats["b"]) if seats else Seats.none(len(words))
        lift = np.full(len(words), state.lift())
        root.shrink(now, rng)
        root.grow(now, lift, state.root_discount, rng)
        uniform = np.full(len(words), 1 / (state.vocabulary + 1))
        root.reseat(uniform, np.zeros(len(words), np.int64), np.array([state.root_tables]), settings.strength, state.root_discount, rng, settings.rounds)
        tables = root.tables()
        a, b = root.written()
        out.append(_row(_SEATS, slot=slot, a=a, b=b))
    out += [_row(_ANSWER, r["rng"], slot, b=_pack(now[at]), c=_pack(tables[at])) for r, at in zip(names, places)]
    numbers = ((counts > 0).sum(), counts.sum(), now.sum(), tables.sum(), (now == 1).sum(), (now == 2).sum())
    return out + [_row(_NUMBER, slot=-5 - k, x=float(v)) for k, v in enumerate(numbers)]


def _pairs(part: _Range, own: list[dict], served: np.ndarray, tables: np.ndarray, grid: _Grid, state: _State) -> np.ndarray:
    """Probabilities of a range's pairs, the parents of its triples, in the state that was told."""
    p = state.root(grid.told(own, 1, "b"), grid.told(own, 1, "c"))
    return state.predictive(served, tables, grid.told(own, 0, "c")[part.u], grid.told(own, 0, "b")[part.u], p[part.w])


def _swept(number: int, found: list[dict], answers: list[dict], grid: _Grid, state: _State, settings: Settings, sweep: int) -> list[tuple]:
    """A sweep over a range: its new seats, and its tables by context and by word."""
    part = _Range(found)
    own = [r for r in answers if r["kind"] == _ANSWER]
    many = np.flatnonzero(part.customers > 1)
    rng = np.random.default_rng([settings.seed, 0, sweep, number])
    old = next((r for r in answers if r["kind"] == _SEATS), None)
    each = part.tables(old and old["a"], many, part.customers)
    kept, served = {}, part.customers
    if part.deep:
        often = np.flatnonzero(part.served > 1)
        below = part.tables(old and old["f"], often, part.served)
        parent = _pairs(part, own, part.by_pair(below), each, grid, state)[part.at[often]]
        seats = _reseated(old and (old["f"], old["g"]), part.served[often], below[often], parent, part.k[often], grid.told(own, 2, "b"), state.deep_discount, settings, rng)
        below[often] = seats.tables()
        kept = dict(zip("fg", seats.written()))
        served = part.by_pair(below)
    p = state.root(grid.told(own, 1, "b"), grid.told(own, 1, "c"))
    seats = _reseated(old and (old["a"], old["b"]), served[many], each[many], p[part.w[many]], part.u[many], grid.told(own, 0, "b"), state.discount, settings, rng)
    each[many] = seats.tables()
    a, b = seats.written()
    tables, customers = part.totals(each), part.totals(served)[0]
    out = [_row(_SEATS, number, a=a, b=b, **kept)]
    out += [_row(_TOTALS, number, slot, a=_pack(t)) for slot, _, t in grid.sent(number, 1, part.ws, tables[1])]
    out += [_row(_TOTALS, number, slot, a=_pack(t), b=_pack(c) if part.deep else None) for slot, _, t, c in grid.sent(number, 0, part.us, tables[0], customers)]
    if part.deep:
        out += [_row(_TOTALS, number, slot, a=_pack(t)) for slot, _, t in grid.sent(number, 2, part.contexts, part.by_context(below))]
    return out


def _reseated(old: tuple[bytes, bytes] | None, customers: np.ndarray, before: np.ndarray, parent: np.ndarray, restaurant: np.ndarray, tables: np.ndarray, discount: float, settings: Settings, rng: np.random.Generator) -> Seats:
    """Dishes' seats after a sweep, with as many customers as they have now. before: the tables of each dish that are
    part of `tables`, all those of each restaurant."""
    tables = tables.astype(float)
    seats = Seats.read(*old) if old else Seats.none(len(customers))
    seats.shrink(customers, rng)
    seats.grow(customers, (settings.strength + discount * tables[restaurant]) * parent, discount, rng)
    tables += np.bincount(restaurant, weights=seats.tables() - before, minlength=len(tables))
    seats.reseat(parent, restaurant, tables, settings.strength, discount, rng, settings.rounds)
    return seats


def _valued(number: int, found: list[dict], answers: list[dict], grid: _Grid, states: list[_State]) -> list[tuple]:
    """For each batch, its triples' (or pairs') training counts of the word and log10 of their averaged probability."""
    part = _Range(found, keep_places=True)
    total = np.zeros(len(part.served))
    many = part.customers > 1
    counts = [r for r in answers if r["kind"] == _COUNTS]
    of_context = grid.told(counts, 2 if part.deep else 0, "a")
    for k, state in enumerate(states):
        own = [r for r in answers if r["batch"] == k and r["kind"] == _ANSWER]
        seats = next(r for r in answers if r["batch"] == k and r["kind"] == _SEATS)
        each = part.tables(seats["a"], many, part.customers)
        if part.deep:
            below = part.tables(seats["f"], part.served > 1, part.served)
            parent = _pairs(part, own, part.by_pair(below), each, grid, state)
            total += state.predictive(part.served, below, of_context[part.k], grid.told(own, 2, "b")[part.k], parent[part.at], deep=True)
        else:
            p = state.root(grid.told(own, 1, "b"), grid.told(own, 1, "c"))
            total += state.predictive(part.customers, each, of_context[part.u], grid.told(own, 0, "b")[part.u], p[part.w])
    value = np.log10(total / len(states)).astype(np.float32)
    known = grid.told(counts, 1, "a")[part.w]
    if part.deep:
        known = known[part.at]
    value, known = value.view(np.uint32)[part.places], known[part.places]
    # They go where the batch's documents lie; the slot column tells which range they come from.
    return [_row(_VALUES, _home(r["batch"], grid.ranges()), number, r["batch"], a=_pack(known[at]), b=_pack(value[at])) for r in found if r["kind"] == _PLACES for at in [_words(r["a"])]]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs within are deleted when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _buckets(df: DataFrame, parts: int, key: str) -> tuple[DataFrame, str]:
    """The table, written to the shared folder in buckets, so that later joins see its partitioning, and its path. df must be
    partitioned by the key; the catalog's entry is gone when this returns."""
    spark, name = df.sparkSession, f"webloom_{uuid.uuid4().hex}"
    path = shared.fresh_path(spark, key)
    with _cleaned(spark):
        df.write.format("parquet").option("compression", "none").bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")
    return found, path


def _fixed(df: DataFrame, parts: int, key: str) -> DataFrame:
    """The table in buckets of a key."""
    return _buckets(df.repartition(parts, key), parts, key)[0]


def _numbers(df: DataFrame) -> dict[int, float]:
    return {r[0]: r[1] for r in df.filter(F.col("kind") == _NUMBER).groupBy("slot").agg(F.sum("x")).collect()}


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table, written to the shared folder, and its path."""
    path = shared.fresh_path(df.sparkSession, name)
    with _cleaned(df.sparkSession):
        df.write.option("compression", "none").parquet(path)  # columns are packed already
    return df.sparkSession.read.schema(_ROW).parquet(path), path


def _at_ranges(packed: DataFrame, answers: DataFrame, work, kinds: tuple[int, ...] = (_PAIRS,)) -> DataFrame:
    """work(range, its packed rows of some kinds, its answers) for all ranges with pairs; only answers move."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = left.to_pylist()
        return _table(work(found[0]["rng"], found, right.to_pylist()) if any(r["kind"] == _PAIRS for r in found) else [])

    return packed.filter(F.col("kind").isin(*kinds)).groupBy("rng").cogroup(answers.groupBy("rng")).applyInArrow(run, _ROW)


def _sampled(packed: DataFrame, grid: _Grid, parts: int, settings: Settings) -> tuple[list[_State], DataFrame]:
    """The states of the samples, and a table of their seats and answers by range, numbered in `batch`."""
    first, directory_path = _buckets(_counted(packed, grid).repartition(parts, "slot"), parts, "slot")
    number = _numbers(first)
    directory = first.filter(F.col("kind") == _TOTALS)

    def meet(told: DataFrame, state: _State | None, sweep: int) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names, rest = left.to_pylist(), right.to_pylist()
            values = {r["rng"]: (r["a"], r["b"]) for r in rest if r["kind"] == _TOTALS} if state else {r["rng"]: (r["c"], r["d"]) for r in names}
            return _table(_answers(names[0]["slot"], names, values, next((r for r in rest if r["kind"] == _SEATS), None), grid, state, settings, sweep))

        return _stored(directory.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(run, _ROW), "answers")

    answers, _ = meet(first.filter("1 = 0"), None, 0)
    n = _numbers(answers)
    discounts = [_discount(x.get(-k, 0), x.get(-k - 1, 0)) for x, k in ((number, 1), (n, 9), (number, 3))]
    state = _State(n.get(-5, 0.0), n.get(-6, 0.0), n.get(-7, 0.0), n.get(-8, 0.0), discounts[0], discounts[1], settings.strength, discounts[2])
    states, kept = [], answers.filter(F.col("kind") == _COUNTS)
    old = answers.filter(F.col("kind") == _ANSWER)
    root, spent = first.filter("1 = 0"), []
    for sweep in range(1, settings.burn_in + settings.samples + 1):
        work = lambda number, found, told, state=state, sweep=sweep: _swept(number, found, told, grid, state, settings, sweep)
        swept, at = _stored(_at_ranges(packed, old, work), "swept")
        answers, to = meet(swept.filter(F.col("kind") == _TOTALS).unionByName(root), state, sweep)
        for path in spent:
            shared.delete(packed.sparkSession, path)
        spent = [] if sweep > settings.burn_in else [at, to]  # samples are kept
        n = _numbers(answers)
        state = replace(state, root_customers=n.get(-7, 0.0), root_tables=n.get(-8, 0.0))
        root = answers.filter(F.col("kind") == _SEATS)
        old = answers.filter(F.col("kind") == _ANSWER).unionByName(swept.filter(F.col("kind") == _SEATS))
        if sweep > settings.burn_in:
            sample = old.withColumn("batch", F.lit(len(states)).cast("long"))
            kept = kept.unionByName(sample)
            states.append(state)
    shared.delete(packed.sparkSession, directory_path)
    return states, kept


def _gathered(texts: DataFrame, grid: _Grid, parts: int, settings: Settings) -> DataFrame:
    """The ranges' merged rows, in buckets. The batches' rows are only shuffled, not stored."""
    common = _common_words(texts, settings)
    short: list[_Common] = []  # made once in each task

    def run(table: pa.Table) -> pa.Table:
        if not short:
            short.append(_Common(common, grid))
        found = table.to_pylist()
        out = _table(_merged(found[0]["rng"], found, grid, short[0]))
        _released()
        return out

    return _buckets(_packed_rows(texts, grid, settings.words, common).groupBy("rng").applyInArrow(run, _ROW), parts, "rng")[0]


def score(docs: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    shared.tune(spark)
    shared.checkpoint_dir(spark)
    parts = shared.shuffle_partitions(spark)
    texts = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    grid = _Grid.of(docs, settings)
    packed = _gathered(texts, grid, parts, settings)
    states, kept = _sampled(packed, grid, parts, settings)
    values = _at_ranges(packed, kept, lambda number, found, told: _valued(number, found, told, grid, states), (_PAIRS, _PLACES))
    tokens = int(states[-1].tokens)
    shift = float(np.log10(tokens + 0.1 * (states[-1].vocabulary + 1)))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of the batches that wait at a range."""
        told: dict[int, list[dict]] = {}
        for r in right.to_pylist():
            told.setdefault(r["batch"], []).append(r)
        out = []
        for home in left.to_pylist():
            values = sorted(told.pop(home["batch"]), key=lambda r: r["slot"])
            held, ids = np.frombuffer(home["a"], bool), np.frombuffer(home["d"], np.int64)
            times, doc = _unpack(home["b"]), _unpack(home["c"])
            count = np.repeat(np.concatenate([_unpack(r["a"]) for r in values]), times)
            value = np.repeat(np.concatenate([_unpack(r["b"]).astype(np.uint32).view(np.float32) for r in values]).astype(float), times)
            add = lambda v: np.bincount(doc, weights=v, minlength=len(ids))
            sizes = np.bincount(doc, minlength=len(ids))
            names = pa.array([None if x == _NO_ID else x for x in ids.tolist()], pa.int64())
            out.append(pa.table([names, pa.array(held), pa.array(sizes), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(len(sizes), tokens)), pa.array(add(np.log10(count + 0.1)) - sizes * shift), pa.array(add(value))], schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    homes = packed.filter(F.col("kind") == _HOME)
    return homes.groupBy("rng").cogroup(values.groupBy("rng")).applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, and the perplexities of the base and the model."""
    n = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(n.alias("tokens"), F.pow(10.0, -F.sum("base_score") / n).alias("base_perplexity"), F.pow(10.0, -F.sum("score") / n).alias("perplexity"))
