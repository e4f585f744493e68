"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of its documents' tokens. A window of several sequences takes from
every queue its share of the window; what rounding withholds is the queue's deficit and is
carried to the next window. The schedule is stateless: how much a queue has given before
window k is a function of k (``Span.bounds``), so each task knows the deficits at its first
window without seeing any other task's. When a queue runs dry, one window is filled by
explicit rounds and the rest of the queues go on with their weights.

So packing needs no grouping and no sort: documents are tokenized where they are read,
token counts, one row for each input part and queue, are summed up along the queues, and
each document then computes its own pieces.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TEXT_ROWS, releasing, table, written

SEQUENCE, WINDOW_SEQUENCES, END_ID = 2048, 32, 1
#: Weights are whole parts of so many.
PARTS = 2**40
#: Words whose ids a worker remembers, about 0.2 kB each.
MAX_WORDS = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts; each distinct word goes through the tokenizer once.

    The file's normalizer and pre-tokenizer treat white space as a border, so a text's ids
    are those of its space-separated parts in turn. A full stop or comma after a word of
    letters is a token of its own, and capital letters of ASCII are lowered, so such a word
    is put together from its plain form.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 2**16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.lowers = self._ids("Ab") == self._ids("ab")
        self.splits = all(self._ids(f"a{m}") == self._ids("a") + self._ids(m) for m in ".,")
        self.marks = {m: self._ids(m) if m else b"" for m in ("", ".", ",")}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        if not self.ends.any():
            self.ends = None

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, words: list[str]) -> None:
        """Learns distinct words. Those of letters go as one text, which is cut after each
        token that ends a word, if there are as many as words."""
        known, code, width = self.known, "H" if self.dtype.itemsize == 2 else "I", self.dtype.itemsize
        letters = [w for w in words if w.isalpha()] if self.ends is not None else []
        rest = [w for w in words if not w.isalpha()] if letters else words
        for at in range(0, len(letters), 10_000):
            part = letters[at : at + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(cuts) != len(part) or cuts[-1] != len(ids) * width:
                rest = rest + part
                continue
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(part, cuts.tolist(), strict=True):
                known[w] = raw[lo:hi]
                lo = hi
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = array(code, e.ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        known, new, formed = self.known, set(), []
        for w in words:
            mark = ""
            bare = w
            if not w.isalpha():
                mark = w[-1] if self.splits and w[-1] in ".," else ""
                bare = w[:-1]
                if not mark or not bare.isalpha():
                    new.add(w)
                    continue
            if self.lowers and not bare.islower() and bare.isascii():
                bare = bare.lower()
            if bare == w:
                new.add(w)
            else:
                formed.append((w, bare, mark))
                if bare not in known:
                    new.add(bare)
        self._encode(list(new))
        marks = self.marks
        for w, bare, mark in formed:
            known[w] = known[bare] + marks[mark]

    def __call__(self, texts: Sequence[str | None], end: int) -> list[bytes]:
        """The ids of each text, and ``end``, as little-endian bytes of ``dtype``."""
        last = np.array([end], self.dtype).tobytes()
        if len(self.known) > self.max_words:  # words met early are the frequent ones
            self.known = dict(islice(self.known.items(), self.max_words // 2))
        lines = [(t or "").replace("\n", " ") for t in texts]
        words = " ".join(lines).split(" ") if lines else []
        found = list(map(self.known.get, words))
        missing, at = [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                missing.append(at)
        except ValueError:  # no further one
            pass
        self._learn({words[i] for i in missing})
        known = self.known
        for i in missing:
            found[i] = known[words[i]]
        out, at = [], 0
        for line in lines:
            own = line.count(" ") + 1
            out.append(b"".join(found[at : at + own]) + last)
            at += own
        return out


@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each process, so that later tasks of a worker know its words."""
    return WordTokenizer(path)


@dataclass(frozen=True)
class Span:
    """``windows`` windows of ``size`` tokens from window ``first`` on, with fixed weights.

    ``cum``: sums of the queues' weights, 0 first. ``starts``: what each queue gave before.
    """

    first: int
    windows: int
    size: int
    cum: tuple[int, ...]
    starts: tuple[int, ...]
    known: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict, compare=False, repr=False)

    def place(self, q: int, k: int) -> tuple[int, int]:
        """What the queues before q, and what q itself gives to the first k windows.

        The total is halved among the queues by their weights, down to one queue. Each part
        grows by 0 or 1 with the total, so no window takes a negative amount; each halving
        rounds to the nearest token, so a queue is off by less than one where weights are
        alike, and by half a token for each halving at most.
        """
        if (found := self.known.get((q, k))) is None:
            if len(self.known) > 65536:
                self.known.clear()
            cum, lo, hi, total, before = self.cum, 0, len(self.cum) - 1, k * self.size, 0
            while hi - lo > 1:
                m, left = _halved(cum, lo, hi, total)
                if q < m:
                    hi, total = m, left
                else:
                    lo, before, total = m, before + left, total - left
            found = self.known[q, k] = (before, total)
        return found

    def given(self, q: int, k: int) -> int:
        return self.place(q, k)[1]

    def window(self, q: int, at: int) -> int:
        """The window, counted from ``first``, that takes token ``at`` of queue q's span."""
        k = min(at * self.cum[-1] // (self.size * (self.cum[q + 1] - self.cum[q])), self.windows - 1)
        while self.given(q, k) > at:
            k -= 1
        while self.given(q, k + 1) <= at:
            k += 1
        return k


def _halved(cum: Sequence[int], lo: int, hi: int, total: int) -> tuple[int, int]:
    """Where queues lo to hi are parted, near half of their weight, and the first part's share."""
    weight = cum[hi] - cum[lo]
    if not weight:
        return (lo + hi) // 2, 0
    half = cum[lo] + weight // 2
    m = bisect_left(cum, half, lo + 1, hi - 1)
    if m > lo + 1 and half - cum[m - 1] < cum[m] - half:
        m -= 1
    return m, (2 * total * (cum[m] - cum[lo]) + weight) // (2 * weight)


def _shared(cum: Sequence[int], total: int) -> list[int]:
    """What each queue gives to the first ``total`` tokens: ``Span.place`` of all queues."""
    out, todo = [0] * (len(cum) - 1), [(0, len(cum) - 1, total)]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1:
            out[lo] = n
        elif n:
            m, left = _halved(cum, lo, hi, n)
            todo += [(lo, m, left), (m, hi, n - left)]
    return out


def _enough(cum: Sequence[int], left: Sequence[int], size: int) -> int:
    """The most full windows that no queue falls short in."""
    def short(k: int) -> bool:
        return any(x > n for x, n in zip(_shared(cum, k * size), left, strict=True))

    slack = 2 * len(cum).bit_length() + 64  # tokens that halving may be off by, and more
    bounds = [(n, cum[q + 1] - cum[q]) for q, n in enumerate(left) if cum[q + 1] > cum[q]]
    hi = min(sum(left) // size, min((n + slack) * cum[-1] // (w * size) for n, w in bounds))
    lo = min(hi, max(0, min((n - slack) * cum[-1] // (w * size) for n, w in bounds)))
    while lo and short(lo):
        lo //= 2
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (lo, mid - 1) if short(mid) else (mid, hi)
    return lo


def schedule(totals: Sequence[int], weights: Sequence[int], size: int) -> list[Span]:
    """Spans that together take all ``totals`` tokens; every window but the last is full.

    While all queues with a weight last, windows hold their shares as ``Span.place`` tells. A
    queue of weight 0 is served when the others are dry. There is a span or two for each
    queue that runs dry, so the work grows with the square of the number of queues.
    """
    left, spans, first = list(totals), [], 0
    while sum(left):
        active = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        if not sum(active):
            active = left[:]
        cum = (0, *accumulate(active))
        starts = tuple(t - n for t, n in zip(totals, left, strict=True))
        if lo := _enough(cum, left, size):
            span, take = Span(first, lo, size, cum, starts), _shared(cum, lo * size)
        else:
            want = min(size, sum(left))
            take = [min(n, x) for n, x in zip(left, _shared(cum, want), strict=True)]
            while gap := want - sum(take):  # rounds over the queues that still have tokens
                rooms = [q for q, n in enumerate(left) if n > take[q]]
                for q in rooms:
                    more = min(left[q] - take[q], -(-gap // len(rooms)), want - sum(take))
                    take[q] += more
            span = Span(first, 1, want, (0, *accumulate(take)), starts)
        spans.append(span)
        left = [n - t for n, t in zip(left, take, strict=True)]
        first += span.windows
    return spans


def pieces(spans: Sequence[Span], q: int, start: int, length: int, window: int = WINDOW_SEQUENCES, sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """(start in document, length, sequence_id, offset) of a document's tokens, which are
    those from ``start`` on in queue q."""
    done, s = 0, 0
    while done < length:
        at = start + done
        while s + 1 < len(spans) and (spans[s + 1].starts[q] <= at):
            s += 1
        span = spans[s]
        rel = at - span.starts[q]
        k = span.window(q, rel)
        (a, own), (b, end) = span.place(q, k), span.place(q, k + 1)
        before = b - a + rel - own  # tokens of this window ahead of ours
        n = min(length - done, end - rel)
        while n:
            offset = before % sequence
            part = min(n, sequence - offset)
            yield done, part, (span.first + k) * window + before // sequence, offset
            done, before, n = done + part, before + part, n - part


def tokenized(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """``doc_id, source_hash, part, slot, file, block, before, n_tokens, ids`` for each row.

    A part is what one task reads of one file; ``before`` counts the tokens of the same
    source ahead of the document in its part. File, offset and row order give the queues'
    order, so a table written in mixed order is packed in that order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0"))).alias("h"), F.spark_partition_id(), F.input_file_name(), F.input_file_block_start(), F.col("text").cast("string"))
    names = ["doc_id", "source_hash", "part", "slot", "file", "block", "before", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sums, slot, where = word_tokenizer(tokenizer), {}, -1, None
        width = tok.dtype.itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = tok(batch.column(5).to_pylist(), end)
                slots, before, counts = [], [], []
                for h, f, b, raw in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), ids, strict=True):
                    if (f, b) != where:
                        where, slot, sums = (f, b), slot + 1, {}
                    n = len(raw) // width
                    slots.append(slot)
                    before.append(sums.get(h, 0))
                    counts.append(n)
                    sums[h] = before[-1] + n
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(slots, pa.int32()), batch.column(3), batch.column(4), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=names)

    return placed.mapInArrow(releasing(run), f"doc_id {kind}, source_hash long, part int, slot int, file string, block long, before long, n_tokens long, ids binary")


def packed(docs: DataFrame, weights: dict[str, float] | None = None, tokenizer: str | None = None, window: int = WINDOW_SEQUENCES, sequence: int = SEQUENCE, end: int = END_ID, targets: dict[int, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``sequence`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue. Each
    token, and the ``end`` id after each document, lies in one piece; all sequences but the
    last are full, the last is shorter.

    ``weights``: target share by source; sources that it doesn't name come when those are
    used up. ``targets``: the same by the xxhash64 of the source's name, as
    ``mixing.targets`` gives it. By default the sources' own token shares, which every
    window then holds.
    Each source is a queue of its own at any count; the driver holds a row for each.
    Null and empty texts are the ``end`` id alone; null sources are a source. Repeated rows
    are packed again. Texts of any length count whole: a task holds the ids of one batch.
    An empty table gives no pieces.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = written(tokenized(docs, tokenizer, end), "tokens", TEXT_ROWS)
    spark = docs.sparkSession
    parts = written(rows.groupBy("source_hash", "part", "slot").agg(F.sum("n_tokens").alias("n"), F.min("file").alias("file"), F.min("block").alias("block")).withColumn("queue", F.col("source_hash")), "parts")
    ahead = W.partitionBy("queue").orderBy("file", "block", "part", "slot", "source_hash").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("source_hash", "part", "slot", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    queues = sorted(totals)
    if weights is not None:
        names = sorted(weights)
        hashes = spark.range(1).select(*[F.xxhash64(F.lit(s)).alias(f"h{i}") for i, s in enumerate(names)]).first() if names else ()
        targets = {h: weights[s] for s, h in zip(names, hashes, strict=True)}
    if targets is None:
        parts_of = [totals[q] for q in queues]
    else:
        whole = math.fsum(targets.values()) or 1.0
        parts_of = [max(1, round(w / whole * PARTS)) if (w := targets.get(q, 0)) > 0 else 0 for q in queues]
    spans = schedule([totals[q] for q in queues], parts_of, window * sequence)
    index = {q: i for i, q in enumerate(queues)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = word_tokenizer(tokenizer).dtype
    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            take = []
            for i, (q, at, n, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(1, 5)], strict=True)):
                ids = np.frombuffer(raw, wide).astype("<u4")
                for lo, size, seq, offset in pieces(spans, index[q], at, n, window, sequence):
                    take.append(i)
                    out.append((lo, size, zlib.crc32(ids[lo : lo + size].tobytes()), n, seq, offset, q))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=names_out)

    placed = rows.join(bases, ["source_hash", "part", "slot"]).select("doc_id", "queue", F.col("base") + F.col("before"), "n_tokens", "ids")
    return placed.mapInArrow(releasing(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents; every window holds the sources' own token shares."""
    return packed(table(spark, sf_dir, "documents")).drop("queue")
