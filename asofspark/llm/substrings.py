"""Removal of repeated substrings by a sampled, range-partitioned suffix array.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier (smaller doc_id, or same document and
earlier start). Every such string contains an anchor, the start of its smallest-hashed GRAM bytes, which depends on the
string alone. So only suffixes at anchors are sorted: neighbouring strings with one anchor travel as one record, which
holds their bytes, and records with equal strings have equal leading bytes from the anchor on.

Splitters sampled from the records' leading bytes range-partition them into buckets. Records that repeat within a
task's batch are combined before the shuffle, and a batch's records for a bucket are shuffled as one compressed block.
Beyond FANOUT buckets they are dealt in two steps, to groups of buckets and from there to buckets, so that a batch never
falls into more than FANOUT blocks. Each bucket sorts its suffixes by multikey quicksort; records that end up equal
repeat, but for the earliest, and strings of different records with one anchor are compared with each other. A crowded
anchor is cut by splitters into several buckets; strings of anchors at a bucket's boundary are compared once more across
buckets, byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LENGTH = 100
GRAM = 24
LEAD = 16  # leading bytes from the anchor on, by which records are partitioned, followed by a hash of the record
KEY = LEAD + 8
BUCKET_BYTES = 6 << 20  # of text, on average; beyond GROWS it grows with the square root of the table
GROWS = 1 << 40  # so that 100 TB have some two million splitters, which go to every task
SAMPLE_DOCS = 3000  # documents at least whose records are the splitters' sample, about
PER_BUCKET = 64  # records of the sample for each bucket, about
FANOUT = 4096  # buckets or groups of buckets that a batch is dealt to at most
CHUNK = 1 << 18  # bytes of text handled at once; longer texts are cut into overlapping pieces
BATCH = 24 << 20  # bytes of text combined before records are emitted
RECORD = 40  # bytes of text for each record, about
_M = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _M(31))) * _M(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _M(29))) * _M(0x94D049BB133111EB)
    return h ^ (h >> _M(32))


def _words(buf: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each position on, as a view."""
    return np.ndarray((max(0, len(buf) - 7),), kind, buf, strides=(1,))


def records(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, strings, left) of each record of the joined texts: `strings` strings of `length` bytes start at
    `start` (in the joined texts) and the positions after it; their common anchor is at start + left."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n, m = int(sizes.sum()), int(sizes.sum()) - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    w, g = _words(buf), np.zeros(m, np.uint64)
    for j in range(0, gram, 8):
        j = min(j, gram - 8)
        g = (g ^ w[j : j + m]) * _M(0xD6E8FEB86659FD93)
        g ^= g >> _M(32)
    low = (g >> _M(32)) << _M(32) | np.arange(m, dtype=np.uint64)
    span, p = length - gram + 1, 1
    while p * 2 <= span:
        low = np.minimum(low[:-p], low[p:])
        p *= 2
    if span - p:
        low = np.minimum(low[: p - span], low[span - p :])
    ends = np.cumsum(sizes)
    at = np.arange(len(low))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    ok = np.flatnonzero(at + length <= ends[text])
    if not len(ok):
        return none, none, none, none
    anchor = (low[ok] & _M(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[ok][1:] != text[ok][:-1])])
    where = np.flatnonzero(first)
    start = ok[where]
    return text[start], start, np.diff(np.append(where, len(ok))), anchor[where] - start


def multikey(ranks: np.ndarray, word: Callable[[int, np.ndarray], np.ndarray], depths: range) -> np.ndarray:
    """Refines ranks (equal: not yet told apart) by one word of 8 bytes after the other, as multikey quicksort does:
    only rows that tie go on to the next word. A rank is the number of rows that are smaller."""
    ranks = ranks.copy()
    active = np.arange(len(ranks))
    for d in depths:
        if not len(active):
            break
        key = word(d, active)
        order = np.lexsort((key, ranks[active]))
        rows, key = active[order], key[order]
        old = ranks[rows]
        at = np.arange(len(rows))
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], key[1:] != key[:-1]])
        ranks[rows] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        last = np.concatenate([new[1:], [True]])
        active = rows[~(new & last)]
    return ranks


def _runs(row: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of consecutive j within a row; row and j are in order."""
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)]) if len(j) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(j) else first
    return row[first], j[first], j[last]


class Bucket:
    """Records of a bucket; removed() gives the byte ranges that repeat, and the strings to compare across buckets."""

    def __init__(self, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, strings: np.ndarray, left: np.ndarray, data: bytes, length: int = LENGTH, gram: int = GRAM):
        self.doc, self.sub, self.start, self.strings, self.left = doc, sub, start, strings.astype(np.int64), left.astype(np.int64)
        self.length, self.gram = length, gram
        self.size = self.strings + length - 1
        self.off = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(data + bytes(8), np.uint8)
        self.word = _words(self.buf, ">u8")

    def _earliest(self, group: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Marks rows at their group's smallest (doc, pos)."""
        order = np.lexsort((pos, doc, group))
        g = group[order]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        out = np.zeros(len(g), bool)
        out[order] = (doc[order] == doc[order][head]) & (pos[order] == pos[order][head])
        return out

    def removed(self, lower: bytes | None, upper: bytes | None) -> tuple[list[tuple], list[tuple]]:
        n, steps = len(self.doc), self.gram // 8
        if not n:
            return [], []
        lead = self.off + self.left
        anchor = multikey(np.zeros(n, np.int64), lambda d, r: self.word[lead[r] + 8 * d].astype(np.uint64), range(steps))
        shape = (self.left << 16 | self.strings).astype(np.uint64)
        most = -(-int(self.size.max()) // 8)
        inside = lambda d, r: shape[r] if d == 0 else self.word[self.off[r] + np.minimum(8 * (d - 1), self.size[r] - 8)].astype(np.uint64)
        same = multikey(anchor, inside, range(most + 1))
        keep = self._earliest(same, self.doc, self.start)
        gone = np.flatnonzero(~keep)
        ranges = [(self.doc[gone], self.sub[gone], self.start[gone], self.start[gone] + self.size[gone])]
        # strings of different records that have one anchor in common, or one that other buckets may have too
        kinds = np.unique(np.stack([anchor, same], 1), axis=0)[:, 0]
        several = np.bincount(kinds, minlength=n)[anchor] > 1
        edge = np.zeros(n, bool)
        for s in (lower, upper):
            if s is not None and len(s) > LEAD:  # a splitter within records of the same leading bytes
                a, b = (int.from_bytes(s[i : i + 8].ljust(8, b"\0"), "big") for i in (0, 8))
                edge |= (self.word[lead] == a) & (self.word[lead + 8] == b)
        open_ = np.flatnonzero(keep & (several | edge))
        across: list[tuple] = []
        if len(open_):
            row = np.repeat(open_, self.strings[open_])
            count = self.strings[open_]
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = self.off[row] + j
            steps = [min(8 * i, self.length - 8) for i in range(-(-self.length // 8))]
            h = np.zeros(len(row), np.uint64)
            for s in steps:
                h = _mix(h + self.word[at + s].astype(np.uint64))
            rank = np.unique(h, return_inverse=True)[1]
            head = np.zeros(int(rank.max()) + 1, np.int64)
            head[rank[::-1]] = np.arange(len(row))[::-1]
            peer = head[rank]
            if not all((self.word[at + s] == self.word[at[peer] + s]).all() for s in steps):  # hashes that collide
                rank = multikey(rank, lambda d, r: self.word[at[r] + steps[d]].astype(np.uint64), range(len(steps)))
            pos = self.start[row] + j
            stays = self._earliest(rank, self.doc[row], pos)
            r, a, b = _runs(row[~stays], j[~stays])
            ranges.append((self.doc[r], self.sub[r], self.start[r] + a, self.start[r] + b + self.length))
            x = np.flatnonzero(stays & edge[row])
            across.append((self.doc[row][x], self.sub[row][x], pos[x], pos[x] + self.length, [self.buf[p : p + self.length].tobytes() for p in at[x].tolist()]))
        return ranges, across


def _pack(doc, sub, start, strings, left, data: bytes) -> bytes:
    import zstandard

    head = struct.pack("<I", len(doc))
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *(np.ascontiguousarray(x, t).tobytes() for x, t in ((doc, "<i8"), (sub, "<i8"), (start, "<i8"), (strings, "u1"), (left, "u1"))), data]))


def _unpack(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for t, w in (("<i8", 8), ("<i8", 8), ("<i8", 8), ("u1", 1), ("u1", 1)):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * w
    return (*out, raw[at:])


def _contents_hash(word: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each record's bytes; word: the 8 bytes from each position of the joined texts on."""
    h = np.full(len(start), salt, np.uint64) ^ size.astype(np.uint64)
    for i in range(-(-int(size.max()) // 8) if len(size) else 0):
        some = np.flatnonzero(size > 8 * i)
        h[some] = (h[some] ^ word[start[some] + np.minimum(8 * i, size[some] - 8)]) * _M(0xD6E8FEB86659FD93)
        h[some] ^= h[some] >> _M(29)
    return _mix(h)


def _keys(word: np.ndarray, start: np.ndarray, left: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.empty((len(start), 3), np.uint64)
    out[:, 0], out[:, 1], out[:, 2] = word[start + left].byteswap(), word[start + left + 8].byteswap(), h
    return out


def _distinct(word: np.ndarray, off: np.ndarray, size: np.ndarray, left: np.ndarray, h: np.ndarray, doc: np.ndarray, sub: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, rows that repeat an earlier one): of records with equal bytes (off, size in the joined texts) and
    left the earliest stays, and once each that equals it in place too."""
    order = np.lexsort((sub, pos, doc, left, h))
    n = len(order)
    first = np.ones(n, bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (left[order][1:] != left[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
    again = np.zeros(n, bool)
    again[1:] = ~first[1:] & (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1]) & (sub[order][1:] == sub[order][:-1])
    later = ~first & ((doc[order] != doc[head]) | (pos[order] != pos[head])) & ~again
    at = np.flatnonzero(later)
    a, b = order[at], head[at]
    same = size[a] == size[b]  # equal hashes alone don't count
    for i in range(-(-int(size[a].max()) // 8) if len(a) else 0):
        some = np.flatnonzero(same & (size[a] > 8 * i))
        step = np.minimum(8 * i, size[a[some]] - 8)
        same[some] = word[off[a[some]] + step] == word[off[b[some]] + step]
    later[at] = same
    return order[~later & ~again], order[later]


def _union(doc: np.ndarray, sub: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges with those of a document that meet made one."""
    order = np.lexsort((s, sub, doc))
    doc, sub, s, e = doc[order], sub[order], s[order], e[order]
    if not len(doc):
        return doc, sub, s, e
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    base = np.cumsum(fresh) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(base + e) - base
    fresh[1:] |= s[1:] > reach[:-1]
    return doc[fresh], sub[fresh], s[fresh], reach[np.append(fresh[1:], True)]


class _Combiner:
    """Collects records of a task, combines equal ones, and emits a block for each bucket that has any."""

    def __init__(self, splitters: np.ndarray):
        self.splitters = splitters
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []  # doc, sub, place, strings, left, hash and offset of records
        self.gone: list[tuple] = []
        self.texts: list[bytes] = []
        self.size = 0

    def _hold(self, data: bytes, doc, sub, pos, strings, left, h, off) -> None:
        self.parts.append((doc, sub, pos, strings, left, h, off + self.size))
        self.texts.append(data)
        self.size += len(data)

    def add(self, docs: list[int], subs: list[int], bases: list[int], texts: list[bytes]) -> None:
        """Records of texts, pieces of documents that start at bases."""
        joined = b"".join(texts)
        begin = np.cumsum([0, *map(len, texts)])
        text, start, strings, left = records(texts)
        word = _words(np.frombuffer(joined + bytes(8), np.uint8))
        size = strings + LENGTH - 1
        h = _contents_hash(word, start, size, 1)
        doc, sub = np.array(docs, np.int64)[text], np.array(subs, np.int64)[text]
        pos = start - begin[text] + np.array(bases, np.int64)[text]
        if len(start) * 16 > len(joined):  # periodic texts have a record for every byte
            rest, gone = _distinct(word, start, size, left, h, doc, sub, pos)
            self.gone.append(_union(doc[gone], sub[gone], pos[gone], pos[gone] + size[gone]))
            doc, sub, pos, strings, left, h, start = (x[rest] for x in (doc, sub, pos, strings, left, h, start))
        self._hold(joined, doc, sub, pos, strings, left, h, start)

    def add_block(self, doc, sub, pos, strings, left, data: bytes) -> None:
        strings, left = strings.astype(np.int64), left.astype(np.int64)
        size = strings + LENGTH - 1
        off = np.cumsum(size) - size
        h = _contents_hash(_words(np.frombuffer(data + bytes(8), np.uint8)), off, size, 1)
        self._hold(data, doc, sub, pos, strings, left, h, off)

    def emit(self) -> Iterator[pa.RecordBatch]:
        parts, texts, dropped = self.parts, self.texts, self.gone
        self.clear()
        if not parts:
            return
        joined = b"".join([*texts, bytes(8)])
        del texts
        word = _words(np.frombuffer(joined, np.uint8))
        doc, sub, pos, strings, left, h, off = (np.concatenate([p[i] for p in parts]) for i in range(7))
        size = strings + LENGTH - 1
        rest, gone = _distinct(word, off, size, left, h, doc, sub, pos)
        keys = _keys(word, off[rest], left[rest], h[rest])
        order = np.lexsort(keys.T[::-1])
        rest, sorted_keys = rest[order], keys[order].astype(">u8").view(f"S{KEY}").ravel()
        bucket = np.searchsorted(self.splitters, sorted_keys, "right")
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist() if len(bucket) else [0]
        buckets, blobs = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = rest[a:b]
            buckets.append(int(bucket[a]))
            contents = b"".join([joined[x:y] for x, y in zip(off[part].tolist(), (off[part] + size[part]).tolist(), strict=True)])
            blobs.append(_pack(doc[part], sub[part], pos[part], strings[part], left[part], contents))
        dropped.append(_union(doc[gone], sub[gone], pos[gone], pos[gone] + size[gone]))
        d, u, s, e = (np.concatenate([x[i] for x in dropped]) for i in range(4))
        if len(d):
            buckets.append(-1 - int(d[0] % (1 << 30)))  # any task may unpack these
            blobs.append(_pack(d, u, s, np.zeros(len(d)), np.zeros(len(d)), e.astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block"])


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """(documents, subs, bases, texts) of about CHUNK bytes at once. A longer text is cut into pieces, which overlap so
    that each of its strings lies whole in the one in which it starts; its base is where a piece starts."""
    docs, subs, bases, texts, size = [], [], [], [], 0
    for b in batches:
        column = b.column("text").cast(pa.binary())
        for doc, sub, text in zip(b.column("_doc").to_pylist(), b.column("_sub").to_pylist(), column):
            text = text.as_py() or b""
            for base in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
                piece = text[base : base + CHUNK + LENGTH - 1] if len(text) > CHUNK else text
                if size and size + len(piece) > CHUNK:
                    yield docs, subs, bases, texts
                    docs, subs, bases, texts, size = [], [], [], [], 0
                docs.append(doc), subs.append(sub), bases.append(base), texts.append(piece)
                size += len(piece)
    if docs:
        yield docs, subs, bases, texts


def _sampled_keys(stride: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of every stride-th record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for _, _, _, texts in _inputs(batches):
            _, start, strings, left = records(texts)
            word = _words(np.frombuffer(b"".join(texts) + bytes(8), np.uint8))
            some = np.arange(-seen % stride, len(start), stride)
            seen += len(start)
            start, strings, left = start[some], strings[some], left[some]
            keys = _keys(word, start, left, _contents_hash(word, start, strings + LENGTH - 1, 1))
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys.astype(">u8")], pa.binary())], names=["key"])

    return run


def _every(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first key, and those at which the count so far passes a multiple of step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = total + np.cumsum(n)
            pick = ends // step > (ends - n) // step
            pick[:1] |= total == 0
            yield b.select(["key"]).take(pa.array(np.flatnonzero(pick)))
            total = int(ends[-1]) if len(ends) else total

    return run


def splitters_of(docs: DataFrame, n_docs: int, size: int, n_buckets: int) -> np.ndarray:
    """Keys that cut the records of docs into about n_buckets even ranges. The sample grows with n_buckets; it is ranked
    by range partitions, each of which gives its every so many-th key, so only splitters reach the driver."""
    part = min(1.0, max(SAMPLE_DOCS / max(1, n_docs), PER_BUCKET * n_buckets * RECORD / max(1, size)))
    stride = max(1, int(part * size / RECORD / (PER_BUCKET * n_buckets)))
    draw = F.pmod(F.xxhash64("_doc", "_sub", F.lit(1)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1
    keys = staged(docs.where(draw).select("_doc", "_sub", "text").mapInArrow(_sampled_keys(stride), "key binary"))
    total = keys.count()
    ranged = keys.groupBy("key").agg(F.count("*").alias("n")).repartitionByRange(max(1, total // 500_000), "key").sortWithinPartitions("key")
    picked = sorted(set(ranged.mapInArrow(_every(max(1, total // n_buckets)), "key binary").toArrow().column("key").to_pylist()))
    # leading bytes that are picked once are not cut: the bucket begins with them
    cuts = [k if before[:LEAD] == k[:LEAD] else k[:LEAD] for before, k in zip(picked[:-1], picked[1:], strict=True)]
    return np.array(sorted(set(cuts)), f"S{KEY}")


_OUT = "doc long, sub long, s long, e long, string binary"


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([np.asarray(p[i], np.int64) for p in parts]) if parts else np.zeros(0, np.int64)) for i in range(4)]
    strings = pa.array([x for p in parts for x in p[4]], pa.binary()) if parts and len(parts[0]) == 5 else pa.nulls(len(columns[0]), pa.binary())
    return pa.RecordBatch.from_arrays([*columns, strings], names=["doc", "sub", "s", "e", "string"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        yield from zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """docs (_doc long, _sub long, text) -> (doc, sub, s, e): byte ranges to remove; ranges of a document may overlap."""
    spark = docs.sparkSession
    seen = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    size, parallel = seen["size"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = int(BUCKET_BYTES * max(1.0, size / GROWS) ** 0.5)
    n_buckets = max(1, size // each, min(parallel, size // CHUNK))  # small tables use all tasks too
    fine = splitters_of(docs, seen["n"], size, n_buckets)
    step = len(fine) // FANOUT + 1  # buckets of a group
    splitters, groups = spark.sparkContext.broadcast(fine), spark.sparkContext.broadcast(fine[step - 1 :: step])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combiner(groups.value)
        for some in _inputs(batches):
            held.add(*some)
            if held.size >= BATCH:
                yield from held.emit()
        yield from held.emit()

    def redealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, some in groupby(_blocks(batches), lambda x: x[0]):
            if group < 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.binary()))], names=["bucket", "block"])
                continue
            held = _Combiner(splitters.value)
            for _, block in some:
                held.add_block(*_unpack(block))
                if held.size >= BATCH:
                    yield from held.emit()
            yield from held.emit()

    def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = splitters.value
        for bucket, some in groupby(_blocks(batches), lambda x: x[0]):
            parts = [_unpack(b) for _, b in some]
            if bucket < 0:
                for doc, sub, s, _, _, data in parts:
                    yield _batch([(doc, sub, s, np.frombuffer(data, "<i8"))])
                continue
            cols = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            data = b"".join(p[5] for p in parts)
            del parts
            ranges, across = Bucket(*cols, data).removed(limits[bucket - 1] if bucket else None, limits[bucket] if bucket < len(limits) else None)
            yield _batch([_union(*(np.concatenate([np.asarray(r[i], np.int64) for r in ranges]) for i in range(4)))])
            if across:
                yield _batch(across)

    blocks = docs.select("_doc", "_sub", "text").mapInArrow(emitted, "bucket long, block binary")
    tasks = max(parallel, len(fine) + 1)
    if step > 1:
        # a group's blocks go to as many tasks as its share asks for
        spread = F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.col("bucket") * step + F.pmod(F.xxhash64("block"), F.lit(step)))
        blocks = blocks.repartitionById(tasks, F.pmod(spread, F.lit(tasks)).cast("int")).sortWithinPartitions("bucket").mapInArrow(redealt, "bucket long, block binary")
    dealt = blocks.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    local = staged(dealt.mapInArrow(sorted_buckets, _OUT))
    across = local.where("string is not null")
    first = across.groupBy("string").agg(F.min(F.struct("doc", "s")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = across.join(first, "string").where(F.struct("doc", "s") > F.col("f"))
    return local.where("string is null").select("doc", "sub", "s", "e").unionByName(later.select("doc", "sub", "s", "e"))


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _apply(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    if not len(starts):
        return len(text), 0, 0, text
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    a, b = s[new], e[np.concatenate([new[1:], [True]])]
    keep = [text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)]
    return len(text), int((b - a).sum()), len(a), b"".join(keep)


def _applied(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            texts = b.column("text").cast(pa.binary())
            for i, r in enumerate(b.column("_ranges")):
                pairs = r.values
                s = pairs.field("s").to_numpy() if pairs is not None else np.zeros(0, np.int64)
                e = pairs.field("e").to_numpy() if pairs is not None else s
                n, gone, spans, kept = _apply(texts[i].as_py() or b"", s, e)
                rows.append((n, gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *(n for n, _ in _RESULT)])

    return run


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null if not asked for).

    One row per input row. Null and empty texts, and those under LENGTH bytes, lose nothing. A null doc_id comes after
    all others. Rows that share a doc_id are one document at one place: equal rows fare alike, and in differing texts
    only an earlier start is earlier. An empty table gives no rows; further columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("long").alias("_doc"), "text")
    repeats = rows.groupBy("_doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("_sub", F.lit(0).cast("long") if repeats else F.xxhash64("text"))
    ranges = repeated_ranges(rows).groupBy("doc", "sub").agg(F.collect_list(F.struct("s", "e")).alias("_ranges"))
    joined = rows.join(ranges, (F.col("_doc") == F.col("doc")) & (F.col("_sub") == F.col("sub")), "left").select("doc_id", "text", "_ranges")
    return joined.mapInArrow(_applied(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
