"""Repeated passages: paragraph MinHash banding, and windows for passages inside paragraphs.

Paragraphs (lines) of 40 words or more are signed by 16 bands of 4 MinHash symbols over
five-word shingles; equal ones are one item, colliding ones are compared by signature and
then by exact Jaccard similarity, and links are joined to components (``near``). A pair at
similarity 0.8 collides with probability 0.9998.

A passage set into a longer paragraph leaves that paragraph's similarity low, which no
banding of paragraphs can find. So each text also gives windows of WINDOW words that begin
where a hash has its least value among REACH neighbouring words: equal passages of
WINDOW + REACH - 1 words, 51, share such a window wherever they stand. Windows are
range-partitioned by digest and place and sorted, so equal ones stream past with their first
copy ahead, however many there are. Where the windows next to a repeated one differ from
its first copy's, or there is none, an equal run may end within REACH - 1 words; there the
words beside it are compared, one row for each such side, so runs are covered to their ends.

Texts are read once for paragraphs and windows, and again for the documents that have
paragraphs to confirm, such sides, or passages, whose places are words until then.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near
from .common import LOWER, SPACES, TEXT_ROWS, as_bytes, slices, table, written
from .shingles import Signer, mixed

WIDTH, LEAST_WORDS = 5, 40
BANDS, ROWS = 16, 4
#: Of 64 symbols a pair at 0.8 differs in 13, and in more than 28 once in a million.
MAX_ERRORS = 28
WINDOW, REACH = 30, 22
NO_ID = -(2**63)
#: Bytes of texts that are cut into words together, so that arrays stay in a core's cache.
BYTES_AT_ONCE = 1 << 18
#: Longer words are hashed one by one, others eight bytes at a time.
LONG_WORD = 64

_rng = np.random.Generator(np.random.PCG64(3))
_ODD = _rng.integers(0, 2**63, (2, WINDOW // WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = bytes(b in SPACES for b in range(256))
#: The first bytes of a word of 0 to 8 in a number of eight.
_HEAD = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_LOW = np.uint64(2**32 - 1)
_MOST = np.uint64(2**64 - 1)


class Words:
    """Hashes of the words of texts with A-Z lowered, and their places; each made when asked
    for. Several texts are joined by line feeds, so no line is of two."""

    def __init__(self, *texts: bytes):
        self.text = b"\n".join(texts)
        self.raw, self.sizes = np.frombuffer(self.text, np.uint8), np.array([len(t) for t in texts])

    @cached_property
    def hash(self) -> np.ndarray:
        low, begin, size = self.text.translate(LOWER) + bytes(8), self.begin, self.end - self.begin
        eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # from each byte on
        x = mixed((eight[begin] & _HEAD[np.minimum(size, 8)]) * _M + size.astype(np.uint64))
        rest, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(rest):
            left = size[rest] - at
            x[rest] = mixed(x[rest] * _M + (eight[begin[rest] + at] & _HEAD[np.minimum(left, 8)]))
            rest, at = rest[left > 8], at + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            x[i] = xxhash.xxh3_64_intdigest(low[begin[i] : begin[i] + size[i]])
        return x

    @cached_property
    def _edges(self) -> np.ndarray:
        blank = np.ones(len(self.raw) + 2, bool)
        blank[1:-1] = np.frombuffer(self.text.translate(_BLANK), bool)
        return np.flatnonzero(blank[1:] != blank[:-1])

    @cached_property
    def begin(self) -> np.ndarray:
        return np.ascontiguousarray(self._edges[::2])

    @cached_property
    def end(self) -> np.ndarray:
        return np.ascontiguousarray(self._edges[1::2])

    @cached_property
    def bounds(self) -> np.ndarray:
        """The first word of each text, and the number of all."""
        return np.append(np.searchsorted(self.begin, np.cumsum(self.sizes + 1) - self.sizes - 1), len(self.begin))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that each word of ``at`` is in."""
        return np.searchsorted(self.bounds, at, "right") - 1

    @cached_property
    def shingle(self) -> np.ndarray:
        n = max(0, len(self.hash) - WIDTH + 1)
        x = self.hash[:n].copy()
        for j in range(1, WIDTH):
            x *= _M
            x += self.hash[j : n + j]
        return mixed(x)

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte of ``at``."""
        return at - np.searchsorted(np.flatnonzero(self.raw & 0xC0 == 0x80), at)

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line of LEAST_WORDS words or more."""
        cuts = np.concatenate([[0], np.searchsorted(self.begin, np.flatnonzero(self.raw == 10)), [len(self.begin)]])
        size = np.diff(cuts)
        long = size >= LEAST_WORDS
        return cuts[:-1][long], size[long]

    def shingles(self, lo: int, n: int) -> np.ndarray:
        return np.unique(self.shingle[lo : lo + n - WIDTH + 1])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows and two 64-bit digests of each."""
        lo, hi = self.bounds[:-1], self.bounds[1:] - WINDOW + 1  # the places of each text
        lo, hi = lo[hi > lo], hi[hi > lo]
        if not len(lo):
            return np.empty(0, np.int64), np.empty((0, 2), np.int64)
        # half of a hash, then the place from the right: the rightmost least of each reach
        n = len(self.hash)
        least = np.full(n, _MOST)
        least[: n - WIDTH + 1] = self.shingle & ~_LOW | _LOW - np.arange(n - WIDTH + 1, dtype=np.uint64)
        least[~_within(lo, hi, n)] = _MOST
        wide = 1
        while wide < REACH:
            step = min(wide, REACH - wide)
            least, wide = np.minimum(least[:-step], least[step:]), wide + step
        # a text with fewer places has one reach
        at = (_LOW - (least[_within(lo, np.maximum(lo + 1, hi - REACH + 1), len(least))] & _LOW)).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        return at, self.at_digests(at)

    def at_digests(self, at: np.ndarray) -> np.ndarray:
        x = np.zeros((2, len(at)), np.uint64)
        for j in range(WINDOW // WIDTH):
            own = self.shingle[at + j * WIDTH]
            for k in range(2):
                x[k] += own * _ODD[k, j]
        return mixed(x).T.view(np.int64)


def _within(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places are in one of the ranges, none of them empty, in order and apart."""
    inside = np.zeros(n + 1, np.int8)
    inside[lo] += 1
    inside[hi] -= 1
    return np.cumsum(inside[:-1], dtype=np.int8).view(bool)


def links(at: np.ndarray, digests: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after each window in its text, ``of``: 32 bits of a hash of the
    neighbouring window and its distance, 0 for none."""
    before, after = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    if len(at) > 1:
        d, gap, same = digests[:, 0].view(np.uint64) * _M, np.diff(at).astype(np.uint64), of[1:] == of[:-1]
        short = lambda x: np.where(same, (mixed(x) >> np.uint64(32) | np.uint64(1)).astype(np.uint32).view(np.int32), 0)
        before[1:], after[:-1] = short(d[:-1] + gap), short(d[1:] + gap)
    return before, after


def version(text: bytes) -> int:
    """What tells the texts of one doc_id apart; the upper half of a place."""
    return zlib.crc32(text) - 2**31


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, version, text) of each row, ``version`` as above."""
    text = as_bytes()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), (F.crc32(F.coalesce(text, F.lit(b""))) - F.lit(2**31)).alias("version"), text.alias("text"))


UNITS = "paragraph boolean, doc long, at long, words int, d1 long, d2 long, before int, after int, signature binary"


def _together(docs: np.ndarray, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, Sequence[bytes]]]:
    """Documents and texts in groups of BYTES_AT_ONCE, or of one text that is longer."""
    at = total = 0
    texts = [t or b"" for t in texts]
    for i, text in enumerate(texts):
        if i > at and total + len(text) > BYTES_AT_ONCE:
            yield docs[at:i], texts[at:i]
            at, total = i, 0
        total += len(text)
    if texts:
        yield docs[at:], texts[at:]


def _units(docs: DataFrame) -> DataFrame:
    """Windows and signed paragraphs of whole texts: a row for each, with its place. ``at`` is
    its first word, below the text's version; ``d2`` of a window has 32 bits."""
    sign = Signer(BANDS * ROWS, seed=2)
    schema = pa.schema([(n, {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in UNITS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows: list[list[np.ndarray]] = [[] for _ in range(7)]
            paragraphs: list[list[np.ndarray]] = [[] for _ in range(7)]
            signatures: list[np.ndarray] = []
            for docs, texts in _together(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                w = Words(*texts)
                base = np.array([version(t) << 32 for t in texts]) - w.bounds[:-1]
                at, digests = w.windows()
                of = w.text_of(at)
                before, after = links(at, digests, of)
                for o, c in zip(windows, (docs[of], base[of] + at, np.full(len(at), WINDOW), digests[:, 0], digests[:, 1] >> 32, before, after), strict=True):
                    o.append(c)
                lo, n = w.paragraphs()
                if len(lo):
                    of = w.text_of(lo)
                    parts = [w.shingle[a : a + m - WIDTH + 1] for a, m in zip(lo.tolist(), n.tolist(), strict=True)]
                    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
                    for o, c in zip(paragraphs, (docs[of], base[of] + lo, n, digests[:, 0], digests[:, 1]), strict=False):
                        o.append(c)
                    signatures.append(sign.each(parts))
            yield batch_of(windows, False, None)
            yield batch_of(paragraphs, True, signatures)

    def batch_of(columns: list[list[np.ndarray]], paragraph: bool, signatures: list[np.ndarray] | None) -> pa.RecordBatch:
        n = sum(map(len, columns[0]))
        made = [pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype(), copy=False)) if c else pa.nulls(n, f.type) for f, c in zip(list(schema)[1:-1], columns, strict=True)]
        signs = pa.nulls(n, pa.binary())
        if signatures:
            ends = np.arange(n + 1, dtype=np.int32) * np.int32(2 * BANDS * ROWS)
            signs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(signatures))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, paragraph)), *made, signs], schema=schema)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), as_bytes()).mapInArrow(run, UNITS)


def band_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of ROWS symbols for each row of symbols; none makes another idle."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(x), BANDS), np.uint64)
    for j in range(ROWS):
        key = key << np.uint64(16) | x[:, :, j]
    return mixed(key + mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64), np.full(key.shape, -1, np.int32)


def _texts_of(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, text, parts): the texts that ``parts`` (doc, version, part) are of, each with all
    its parts. Texts of other documents don't enter the exchange if the ids of the wanted
    ones are few enough to broadcast."""
    lists = written(parts.groupBy("doc", "version").agg(F.collect_set("part").alias("parts")), "parts")
    wanted = _identified(docs).join(near.bounded(lists.select("doc").distinct()), "doc", "left_semi")
    return wanted.join(lists, ["doc", "version"]).select("doc", "text", "parts")


def _sets(docs: DataFrame, holders: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of paragraphs, from the text of the first document that holds each."""
    part = F.struct("id", F.expr("cast(at & 4294967295 as int) as at"), "words").alias("part")
    texts = _texts_of(docs, holders.join(near.bounded(ids), "id").select("doc", F.shiftright("at", 32).alias("version"), part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids_, sets = [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = Words(text or b"")
                for p in parts:
                    ids_.append(p["id"])
                    sets.append(w.shingles(p["at"], p["words"]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def _paragraph_matches(docs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """(doc, at, words, cluster, removed, paragraph): paragraphs that other documents have."""
    units = units.where("paragraph")
    units = units.withColumn("id", F.xxhash64("d1", "d2"))
    classes = written(units.groupBy("id").agg(F.min(F.struct("doc", "at", "words")).alias("holder"), F.max("doc").alias("last"), F.first("signature").alias("signature")), "classes")
    holders = classes.select("id", "holder.doc", "holder.at", "holder.words")
    labels = near.groups(classes.select("id", "signature"), band_keys, MAX_ERRORS, lambda ids: _sets(docs, holders, ids).dropDuplicates(["id"]), percent)
    of = classes.join(labels, "id", "left").withColumn("cluster", F.coalesce("label", "id"))
    clusters = of.groupBy("cluster").agg(F.min(F.struct("holder.doc", "holder.at")).alias("first"), F.max("last").alias("last")).where("first.doc <> last")
    hot = written(of.select("id", "cluster").join(clusters, "cluster").select("id", "cluster", "first"), "hot")
    removed = ((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at"))).alias("removed")
    return units.join(hot, "id").select("doc", "at", "words", "cluster", removed, F.lit(True).alias("paragraph"))


PLACE = ["d1", "d2", "doc", "at", "before", "after"]
FOUND = "kind byte, d1 long, d2 long, doc long, at long, before int, after int, first_doc long, first_at long, first_before int, first_after int"
REPEATED, PENDING, SUMMARY = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows of PLACE the runs of equal digests that several documents have, each
    row with the run's first one. A run that may have begun in an earlier partition gives
    PENDING rows, as does one at the end that only one document has so far; both a SUMMARY.

    Held are one batch and the rows that the first document has of the open run.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    key, first, last, several, held = None, None, None, False, []
    head = fresh = True  # the open run may have begun earlier; no run was seen yet

    def rows(kind: int, part: pa.RecordBatch, firsts: list) -> pa.RecordBatch:
        cells = [pa.array(np.broadcast_to(x, part.num_rows), t) for x, t in zip(firsts, types, strict=True)] if firsts else [pa.nulls(part.num_rows, t) for t in types]
        return pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, kind, np.int8)), *part.columns, *cells], names=names)

    def put(part: pa.RecordBatch, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The next rows of the open run, which they may open."""
        nonlocal key, first, last, several, held, head, fresh
        doc = columns[2]
        if key is None:
            key, first, several, held = (int(columns[0][0]), int(columns[1][0])), [int(columns[i][0]) for i in range(2, 6)], False, []
            head, fresh = fresh, False
        last = int(doc[-1])
        if head:
            yield rows(PENDING, part, [])
        elif last == first[0]:
            held.append(part)
        else:
            for p in (*held, part):
                yield rows(REPEATED, p, first)
            several, held = True, []

    def close(at_edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, held
        if key is not None and (head or at_edge):
            for p in held:
                yield rows(PENDING, p, [])
            one = pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 4 else pa.int32()) for i, x in enumerate([*key, *first])], names=PLACE)
            yield rows(SUMMARY, one, [last, 0, 0, 0])
        key, held = None, []

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy() for i in range(6)]
        a, b, doc = columns[:3]
        begin = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
        end = np.append(begin[1:], n)
        part = lambda lo, hi: (batch.slice(lo, hi - lo), [c[lo:hi] for c in columns])  # noqa: B023, E731
        done = 0
        if key is not None and key != (int(a[0]), int(b[0])):
            yield from close(False)
        if key is not None or fresh:
            yield from put(*part(0, end[0]))
            done = 1
            if len(begin) > 1:
                yield from close(False)
        if len(begin) > done:  # whole runs of the batch, then the one that may go on
            lo, hi = begin[done:-1], end[done:-1]
            lengths = np.where(doc[lo] != doc[hi - 1], hi - lo, 0)
            if lengths.any():
                at_first = np.repeat(lo, lengths)
                take = at_first + np.arange(len(at_first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield rows(REPEATED, batch.take(pa.array(take)), [columns[i][at_first] for i in range(2, 6)])
            yield from put(*part(begin[-1], n))
    yield from close(True)


def _repeated(units: DataFrame) -> DataFrame:
    """Windows that several documents have, with the place and neighbours of the first."""
    places = units.where("not paragraph").select(*PLACE)
    dealt = places.repartitionByRange("d1", "d2", "doc", "at").sortWithinPartitions("d1", "d2", "doc", "at")
    found = written(dealt.mapInArrow(_stream, FOUND), "windows", codec="lz4_raw")
    ends = found.where(F.col("kind") == SUMMARY).groupBy("d1", "d2").agg(F.min(F.struct("doc", "at", "before", "after")).alias("f"), F.max("first_doc").alias("last")).where("f.doc <> last")
    # a partition has two summaries at most, so their number is bounded by that of partitions
    firsts = {(r["d1"], r["d2"]): tuple(r["f"]) for r in ends.collect()}

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(firsts), np.int64).reshape(-1, 2)
        values = np.array([firsts[tuple(k)] for k in keys.tolist()], np.int64).reshape(-1, 4)
        for batch in batches:
            if not batch.num_rows or not len(keys):
                continue
            groups, of = np.unique(np.stack([batch.column(i).to_numpy() for i in range(2)], 1), axis=0, return_inverse=True)
            place = {tuple(k): i for i, k in enumerate(keys.tolist())}
            row = np.array([place.get(tuple(g), -1) for g in groups.tolist()])[of.ravel()]
            late, row = np.flatnonzero(row >= 0), row[row >= 0]
            cells = [pa.array(values[row, i].astype(t)) for i, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.select(PLACE).take(pa.array(late)).columns, *cells], names=names)

    names = [x.split()[0] for x in FOUND.split(", ")][1:]
    pending = found.where(F.col("kind") == PENDING).select(PLACE).mapInArrow(settled, FOUND.split(", ", 1)[1])
    return found.where(F.col("kind") == REPEATED).select(names).union(pending)


SIDES = "c1 long, c2 long, doc long, at long, side int, depth int, context binary"


def _sides(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each open side of a window, before (0) and after (1) it: ``context`` has
    hashes of the words there, from the window on. A side is open if the neighbouring windows of this copy and the first aren't the same.
    """
    other = F.expr("doc <> first_doc or at <> first_at")
    left, right = F.expr("before = 0 or before <> first_before").alias("left"), F.expr("after = 0 or after <> first_after").alias("right")
    open_ = found.where(other).select("doc", "at", "first_doc", "first_at", left, right).where("left or right")
    both = open_.select("left", "right", F.inline(F.expr("array(struct(doc, at), struct(first_doc as doc, first_at as at))")))
    code = F.expr("(at & 4294967295) * 4 + if(left, 2, 0) + if(right, 1, 0) as part")
    texts = _texts_of(docs, both.select("doc", F.shiftright("at", 32).alias("version"), code).distinct())
    reach = REACH - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            every, own = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            ends, docs = np.cumsum(own), batch.column(0).to_numpy()
            for rows, texts in _together(np.arange(batch.num_rows), batch.column(1).to_pylist()):
                w, base = Words(*texts), np.array([version(t) << 32 for t in texts])
                codes = every[ends[rows[0]] - own[rows[0]] : ends[rows[-1]]]
                places = (codes >> 2) + np.repeat(w.bounds[:-1], own[rows])
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                for side, bit in ((0, 2), (1, 1)):
                    at = np.unique(places[codes & bit > 0])
                    of = w.text_of(at)
                    within = at > w.bounds[of] if side == 0 else at + WINDOW < w.bounds[of + 1]
                    at, of = at[within], of[within]
                    digests, lo, hi = w.at_digests(at), w.bounds[of], w.bounds[of + 1]
                    beside = at[:, None] + (WINDOW + np.arange(reach) if side else -1 - np.arange(reach))
                    there = (beside >= lo[:, None]) & (beside < hi[:, None])
                    cells = digests[:, 0], digests[:, 1] ^ side, docs[rows][of], base[of] + at - lo, np.full(len(at), side, np.int32), there.sum(1), short[beside[there]]
                    for o, c in zip(out, cells, strict=True):
                        o.append(c)
            c = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
            ends = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(c[5])]).astype(np.int32))
            context = pa.BinaryArray.from_buffers(pa.binary(), len(c[0]), [None, ends, pa.py_buffer(c[6].astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in c[:4]], pa.array(c[4].astype(np.int32)), pa.array(np.zeros(len(c[0]), np.int32)), context], names=[x.split()[0] for x in SIDES.split(", ")])

    return texts.mapInArrow(run, SIDES)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``same``, the words that the row's context and its first's have in common from
    the window on, and ``step``, the next word of the row's own, -1 for none."""
    def padded(cells: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """A row of words for each cell, and how many of them are its own."""
        ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
        size, out = np.diff(ends) // 4, np.zeros((len(cells), REACH - 1), np.uint32)
        raw = cells.buffers()[2]
        out[np.arange(REACH - 1) < size[:, None]] = np.frombuffer(raw[int(ends[0]) : int(ends[-1])], np.uint32) if raw and ends[-1] > ends[0] else 0
        return out, size

    for batch in batches:
        if not batch.num_rows:
            continue
        (x, m), (y, n) = (padded(batch.column(i)) for i in ("context", "first_context"))
        equal = np.concatenate([x == y, np.zeros((len(x), 1), bool)], axis=1)
        same = np.minimum(equal.argmin(1), np.minimum(m, n)).astype(np.int32)
        step = np.where(same < m, x[np.arange(len(x)), np.minimum(same, REACH - 2)].astype(np.int64), -1)
        rest = batch.drop_columns(["first_context"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(same), pa.array(step)], names=[*rest.schema.names, "same", "step"])


def _extended(sides: DataFrame) -> list[DataFrame]:
    """(doc, at, words, removed, group, and steps or not): what repeated windows have in
    common beside them. A row with ``steps`` stands for as many more parts of WINDOW words,
    each a word further.

    Rows of one window and side are held against the first of them, which settles most.
    Those that leave it after the same words by the same word may go on together: they are
    held against the first of them once more. What goes on after that, such as families of
    copies with an edit each, has each of its beginnings counted, once for all copies that
    have the same words there.
    """
    rows, out = written(sides, "sides", TEXT_ROWS), []
    removed = F.expr("doc <> first_doc or at <> first_at as removed")
    for _ in range(2):
        firsts = rows.groupBy("c1", "c2").agg(F.min(F.struct("doc", "at", "context")).alias("f"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("f.doc <> last")
        firsts = firsts.select("c1", "c2", F.col("f.doc").alias("first_doc"), F.col("f.at").alias("first_at"), F.col("f.context").alias("first_context"), "n")
        both = rows.join(written(firsts, "firsts"), ["c1", "c2"])  # apart, so that a join of many copies is split
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "first_context") + ", same int, step long"
        done = written(both.mapInArrow(_alike, schema), "alike", TEXT_ROWS)
        most = done.where("doc <> first_doc").groupBy("c1", "c2").agg(F.max("same").alias("most"))
        own = done.where("doc = first_doc").join(most, ["c1", "c2"]).withColumn("same", F.least("same", "most")).drop("most")
        piece = done.where("doc <> first_doc").unionByName(own).where("same > depth")
        out.append(piece.select(
            "doc", F.expr("if(side = 1, at + depth + 1, at - same) as at"), F.expr(f"{WINDOW - 1} + same - depth as words"), removed, F.col("c1").alias("group"),
        ))
        left = done.where("n > 2 and step >= 0 and (doc <> first_doc or at <> first_at)")
        go = [F.xxhash64(F.lit(i), "c1", "c2", "same", "step").alias(f"c{i}") for i in (1, 2)]
        rows = left.select(*go, "doc", "at", "side", F.col("same").alias("depth"), "context")
    several = rows.groupBy("c1", "c2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("c1", "c2")
    # copies with the same words beside them are one kind, whose beginnings are counted once
    kind = [F.xxhash64(F.lit(i), "c1", "c2", "context").alias(f"k{i}") for i in (1, 2)]
    rows = written(rows.join(written(several, "several"), ["c1", "c2"]).select("c1", "c2", *kind, "doc", "at", "side", "depth", "context"), "rest")
    kinds = rows.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("c1", "c2", "depth", "context")], F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last"))
    k = written(kinds, "kinds").select("*", F.explode(F.expr("sequence(depth + 1, cast(length(context) / 4 as int))")).alias("k"))
    go = [F.xxhash64(F.lit(i), "c1", "c2", F.expr("substring(context, 1, 4 * k)")).alias(f"p{i}") for i in (1, 2)]
    begun = written(k.select(*go, "k1", "k2", "k", "f", "last"), "begun")
    firsts = begun.groupBy("p1", "p2").agg(F.min("f").alias("first"), F.max("last").alias("last")).where("first.doc <> last").select("p1", "p2", "first")
    # a kind's least copy is the first of its longer beginnings, or of none; other copies never
    own, at_k, at_p = F.col("first") == F.col("f"), F.col("k"), F.col("p1")
    shared = begun.select("p1", "p2", "k1", "k2", "k", "f").join(written(firsts, "firsts"), ["p1", "p2"]).groupBy("k1", "k2").agg(
        F.first("f").alias("f"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("p1").alias("group"),
        F.max(F.when(~own, at_k)).alias("going_hi"), F.min(F.when(~own, at_p)).alias("going"), F.min(F.when(own, at_k)).alias("staying_lo"), F.min(F.when(own, at_p)).alias("staying"),
    )
    pieces = F.expr("""filter(if(doc <> f.doc or at <> f.at,
        array(struct(lo, hi, group, true as removed)),
        array(struct(lo, going_hi as hi, going as group, true as removed), struct(staying_lo as lo, hi, staying as group, false as removed))), x -> x.group is not null)""")
    copies = rows.select("k1", "k2", "doc", "at", "side").join(written(shared, "shared"), ["k1", "k2"]).select("doc", "at", "side", F.inline(pieces))
    out.append(copies.select("doc", F.expr("if(side = 1, at + lo, at - hi) as at"), F.expr(f"{WINDOW} + hi - lo as words"), "removed", "group", F.expr("hi - lo as steps")))
    return out


def _window_matches(docs: DataFrame, units: DataFrame) -> DataFrame:
    """The same of windows, and of what they have in common beside them, with a group instead."""
    found = _repeated(units)
    removed = F.expr("doc <> first_doc or at <> first_at as removed")
    out = found.select("doc", "at", F.lit(WINDOW).alias("words"), F.xxhash64("d1", "d2").alias("cluster"), removed, F.lit(None).cast("long").alias("group"), F.lit(None).cast("int").alias("steps"))
    for more in _extended(_sides(docs, found)):
        out = out.unionByName(more, allowMissingColumns=True)  # without a cluster
    return out.withColumn("paragraph", F.lit(False))


SPANS = "doc long, version long, lo int, words int, removed boolean, cluster long"
_NONE = 2**63 - 1


def _merged(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """SPANS of rows (doc, version, at, words, removed, cluster, group, paragraph, steps) sorted
    by the first three: overlapping parts with the same fate are one. A part that the text's
    removed passages cover isn't kept: its first copy is elsewhere, though no window there.
    Without a paragraph, a passage has ``least_words`` at least.

    Held are one batch and the parts of one text.
    """
    held: list[list[np.ndarray]] = []

    def runs(lo: np.ndarray, hi: np.ndarray, cluster: np.ndarray, group: np.ndarray, paragraph: np.ndarray) -> list[np.ndarray]:
        """First word, end, cluster of the merged parts, and if they are passages."""
        at = np.flatnonzero(np.concatenate([[True], lo[1:] >= np.maximum.accumulate(hi)[:-1]]))
        begin, end = lo[at], np.maximum.reduceat(hi, at)
        whole, window, beside = (np.minimum.reduceat(x, at) for x in (np.where(paragraph, cluster, _NONE), cluster, group))
        return [begin, end, np.where(whole != _NONE, whole, np.where(window != _NONE, window, beside)), (end - begin >= least_words) | np.maximum.reduceat(paragraph, at)]

    def settled() -> pa.RecordBatch:
        doc, part = (int(held[0][i][0]) for i in range(2))
        at, words, removed, cluster, group, paragraph, steps = (np.concatenate([h[i] for h in held]) for i in range(2, 9))
        if (several := ~removed & (steps > 0)).any():  # each of their parts stays or not
            each = np.where(several, steps + 1, 1)
            further = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            at, words = np.repeat(at, each) + further, np.repeat(np.where(several, words - steps, words), each)
            order = np.argsort(at, kind="stable")
            at, words = at[order], words[order]
            removed, cluster, group, paragraph = (np.repeat(x, each)[order] for x in (removed, cluster, group, paragraph))
        lo = at & 0xFFFFFFFF
        c, keep, out = [lo, lo + words, cluster, group, paragraph], ~removed, []
        if removed.any():
            out.append((True, r := runs(*[x[removed] for x in c])))
            i = np.searchsorted(r[0], lo, "right") - 1
            keep &= (i < 0) | (c[1] > r[1][i])
        if keep.any():
            out.append((False, runs(*[x[keep] for x in c])))
        begin, end, cluster = (np.concatenate([r[i][r[3]] for _, r in out]) for i in range(3))
        fate = np.concatenate([np.full(int(r[3].sum()), f) for f, r in out])
        cells = [np.full(len(fate), doc), np.full(len(fate), part), begin.astype(np.int32), (end - begin).astype(np.int32), fate, cluster]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=[x.split()[0] for x in SPANS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = [batch.column(i).fill_null(_NONE).to_numpy() if i in (5, 6) else batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        cuts = [0, *(np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = [x[lo:hi] for x in c]
            if held and (held[0][0][0], held[0][1][0]) != (part[0][0], part[1][0]):
                yield settled()
                held = []
            held.append(part)
    if held:
        yield settled()


PASSAGES = "doc long, version long, start long, end long, n_words long, removed boolean, cluster_id long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PASSAGES of rows (doc, text, parts): where words are in code points."""
    for batch in slices(batches):
        out: list[list] = [[] for _ in range(7)]
        for doc, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = Words(text or b"")
            lo, n = (np.array([p[k] for p in parts]) for k in ("lo", "words"))
            start, end = w.chars(w.begin[lo]), w.chars(w.end[lo + n - 1])
            for o, c in zip(out, ([doc] * len(parts), [version(text or b"")] * len(parts), start.tolist(), end.tolist(), n.tolist(), [p["removed"] for p in parts], [p["cluster"] for p in parts]), strict=True):
                o += c
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(out)], names=[x.split()[0] for x in PASSAGES.split(", ")])


def passages(docs: DataFrame, percent: int = 80, least_words: int = WINDOW + REACH - 1) -> DataFrame:
    """``doc_id, start, end, n_words, removed, cluster_id``: passages that documents share.

    start and end are code points of the whole text, end excluded. Of each repeated window,
    and of each group of near-equal paragraphs, the copy with the least doc_id, and there
    the first, stays (``removed`` false); overlapping parts with the same fate are one
    passage. Equal runs are reported from ``least_words`` words on, and from 51 on each is
    found, to its ends. ``cluster_id`` is the least group of its paragraphs, or else of its
    windows; copies of a passage share one.

    Text repeated within one document alone isn't reported. Null and empty texts have no
    passage; rows without doc_id count as one document with the least id and are reported
    with a null one. Rows of one doc_id are one document; each of its texts has passages of
    its own, and rows that repeat id and text are one. Texts of any length count whole: a
    task holds one slice of a batch of them. An empty table gives none.
    """
    units = written(_units(docs), "units", TEXT_ROWS, kinds="paragraph", codec="lz4_raw")
    parts = _paragraph_matches(docs, units, percent).unionByName(_window_matches(docs, units), allowMissingColumns=True)
    placed = parts.select("doc", F.shiftright("at", 32).alias("version"), "at", "words", "removed", "cluster", "group", "paragraph", F.coalesce("steps", F.lit(0)).alias("steps"))
    dealt = placed.repartition("doc", "version").sortWithinPartitions("doc", "version", "at")
    spans = dealt.mapInArrow(lambda batches: _merged(batches, least_words), SPANS).select("doc", "version", F.struct("lo", "words", "removed", "cluster").alias("part"))
    found = _texts_of(docs, spans).mapInArrow(_placed, PASSAGES).distinct()  # once for rows that repeat
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "start", "end", "n_words", "removed", "cluster_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
