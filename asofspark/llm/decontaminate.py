"""Benchmark decontamination by winnowing.

Of every k consecutive words a hash is taken, and of every w consecutive hashes the smallest is kept, with
k + w - 1 = the window's words: every shared span of that length has a kept hash in common. Kept hashes of documents
and benchmark items are joined; a document and an item that meet are extended once, over all windows of both, and words
are compared as such, in time linear in their words.
Items of fewer words are looked up by a hash of the whole item at every position, and compared in the same way.

A benchmark of up to INDEX_BYTES goes to every task as an index. Beyond, the join is a shuffle: a bitmap of the items'
hashes, of fixed size, lets tasks drop document hashes that no item has before they are written, and each text then
meets its items in parts of PART_BYTES.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, sheltered, staged, table

GRAM, KEEP = 5, 6
WINDOW = GRAM + KEEP - 1
CHUNK = 1 << 20  # bytes of text handled at once, at least one document
INDEX_BYTES = 32 << 20  # of benchmark text; beyond it hits are found by a shuffled join
FILTER_BITS = 1 << 28  # of the bitmap of items' hashes (32 MB), whatever the benchmark's size
PART_BYTES = 4 << 20  # of item text that one text is compared with at once, about

_LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LOWER[_b] = _b
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_POW = _powers(64)


class Words:
    """The words of several texts: bounds in `low` (lower-cased bytes), text number and hash of each."""

    def __init__(self, texts: list[bytes]):
        self._column: pa.Array | None = None
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.low = low = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        n, ends_of_text = len(low), np.cumsum(self.sizes)
        first = np.zeros(n + 1, bool)
        first[ends_of_text - self.sizes] = True
        isw = low > 0
        opens = isw.copy()
        opens[1:] &= ~isw[:-1] | first[1:n]
        closes = isw.copy()
        closes[:-1] &= ~isw[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(ends_of_text, self.start, "right")
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        if len(self.start):
            lens = self.end - self.start
            at = np.flatnonzero(isw)
            pos = at - np.repeat(self.start, lens)
            powers = _POW if pos.max() < len(_POW) else _powers(int(pos.max()) + 1)
            h = np.add.reduceat(low[at].astype(np.uint64) * powers[pos], np.cumsum(lens) - lens)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            self.hash = h ^ (h >> np.uint64(29))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, n: int) -> np.ndarray:
        """A hash of each n consecutive words, by the first; those over a text's end are of no use (see within)."""
        m = max(0, len(self.hash) - n + 1)
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + m]
        return g ^ (g >> np.uint64(32))

    def within(self, n: int) -> np.ndarray:
        m = max(0, len(self.hash) - n + 1)
        return self.text[:m] == self.text[n - 1 : n - 1 + m]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of first words) and hashes that winnowing keeps: all ties of each window's minimum."""
        g, ok = self.grams(GRAM), self.within(WINDOW)
        m = len(ok)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = g[:m].copy()
        for j in range(1, KEEP):
            np.minimum(low, g[j : j + m], out=low)
        sel = np.zeros(len(g), bool)
        for j in range(KEEP):
            sel[j : j + m] |= (g[j : j + m] == low) & ok
        at = np.flatnonzero(sel)
        return at, g[at]

    def column(self) -> pa.Array:
        """The words themselves."""
        if self._column is None:
            ends = np.append(0, np.cumsum(self.end - self.start))
            self._column = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.low[self.low > 0])])
        return self._column

    def bytes_of(self, i: int, j: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


class Index:
    """Benchmark items (id, text) by kept hash, and short items by a hash of the whole. Items of one text are one."""

    def __init__(self, items: list[tuple[object, bytes]]):
        ids: dict[bytes, list] = {}
        for i, text in items:
            ids.setdefault(text, []).append(i)
        self.ids = list(ids.values())
        self.words = w = Words(list(ids))
        at, g = w.kept()
        owner = w.text[at]
        order = np.lexsort((owner, g))
        g, owner = g[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        self.gram, self.owner = g[new], owner[new]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.short = {}
        for n in sorted(set(w.counts[(w.counts > 0) & (w.counts < WINDOW)].tolist())):
            which = np.flatnonzero(w.counts == n)
            h = w.grams(n)[w.first[which]]
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], which[order])

    @staticmethod
    def _matches(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h and values of equal keys, each pair once; keys are ordered."""
        low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        n = high - low
        place = np.repeat(np.arange(len(h)), n)
        return place, values[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(place))] if len(place) else values[:0]

    def candidates(self, d: Words) -> Iterator[tuple[int, int]]:
        """Texts and items that have a kept hash in common, each pair once."""
        at, g = d.kept()
        t = d.text[at]
        order = np.lexsort((g, t))
        t, g = t[order], g[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
        place, item = self._matches(self.gram, self.owner, g[new])
        both = np.unique(t[new][place] * max(1, len(self.ids)) + item)
        yield from zip(*(x.tolist() for x in np.divmod(both, max(1, len(self.ids)))), strict=True)

    def _windows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of an item's windows, in order, and where each window begins among its words."""
        if i not in self.windows:
            w = self.words
            h = w.grams(WINDOW)[w.first[i] : w.first[i] + w.counts[i] - WINDOW + 1]
            order = np.argsort(h, kind="stable")
            self.windows[i] = h[order], order
        return self.windows[i]

    def extended(self, d: Words, grams: np.ndarray, t: int, i: int) -> np.ndarray:
        """Where windows of item i occur among the words of text t: hits extended over all of both, in time linear in
        the words of both (but for the order of the item's), however often a word repeats. Words are compared as such."""
        first, n = int(d.first[t]), int(d.counts[t])
        h, at = self._windows(i)
        mine = grams[first : first + n - WINDOW + 1]
        lo = np.searchsorted(h, mine)
        p = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == mine)
        if not len(p):
            return p
        w = self.words
        spelled = pa.concat_arrays([d.column()[first : first + n], w.column()[int(w.first[i]) : int(w.first[i] + w.counts[i])]]).dictionary_encode().indices.to_numpy()
        ours, theirs = spelled[:n], spelled[n:]
        step = np.arange(WINDOW)
        same = np.zeros(len(p), bool)
        for k in range(0, len(p), 1 << 16):
            part = slice(k, k + (1 << 16))
            same[part] = (ours[p[part, None] + step] == theirs[at[lo[p[part]], None] + step]).all(axis=1)
        for k in np.flatnonzero(~same).tolist():  # another window of the same hash may be the one
            others = at[lo[p[k]] : np.searchsorted(h, mine[p[k]], "right")]
            same[k] = (theirs[others[:, None] + step] == ours[p[k] + step]).all(axis=1).any()
        return p[same]

    def hits(self, texts: list[bytes]) -> tuple[Words, np.ndarray, list[set]]:
        """The words of the texts, a mark for each word that is hit, and the ids of occurring items by text."""
        d, w = Words(texts), self.words
        hit, items = np.zeros(len(d.hash), bool), [set() for _ in texts]
        grams = None
        for t, i in self.candidates(d):
            grams = d.grams(WINDOW) if grams is None else grams
            p = self.extended(d, grams, t, i)
            if len(p):
                for k in range(WINDOW):
                    hit[p + (int(d.first[t]) + k)] = True
                items[t].update(self.ids[i])
        for n, (keys, which) in self.short.items():
            ok = np.flatnonzero(d.within(n))
            place, item = self._matches(keys, which, d.grams(n)[ok])
            for p, i in zip(ok[place].tolist(), item.tolist(), strict=True):
                q = int(w.first[i])
                if d.bytes_of(p, p + n) == w.bytes_of(q, q + n):
                    hit[p : p + n] = True
                    items[int(d.text[p])].update(self.ids[i])
        return d, hit, items

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, list[object]]]:
        """(words, words hit, ids of items with occurring windows) of each text."""
        d, hit, items = self.hits(texts)
        total = np.bincount(d.text[hit], minlength=len(texts))
        return [(int(d.counts[t]), int(total[t]), sorted(items[t], key=str)) for t in range(len(texts))]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_FOUND = "_n_words long, _n_hit long, _items array<string>"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_held: list = []  # the index that this worker process has built last, and what of


def _index_of(held) -> Index:
    """The index of broadcast items, built once in a worker process."""
    if not _held or _held[0] != held.value[0]:
        _held[:] = held.value[0], Index(held.value[1])
    return _held[1]


def overlaps(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (with text) and benchmark (item_id, text) -> docs with _n_words, _n_hit, _items (ids as sorted strings).

    The benchmark's size is checked: up to index_bytes its index goes to every task; beyond, the kept hashes of both
    sides are joined by a shuffle, and each text then meets only the items it shares a hash with. One row per input
    row. Null and empty texts have no words; items without words never occur; null item_ids are the string 'null';
    repeated item rows count once; empty tables on either side give zero counts; all columns of docs are kept, but for
    those that have the name of a new one, which are replaced.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > index_bytes:
        return _overlaps_shuffled(docs, items)
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"].encode()) for r in items.collect()]))

    def scan(b: pa.RecordBatch) -> list[pa.Array]:
        index = _index_of(held)
        found = [x for c in chunks(_bytes(b.column("text"))) for x in index.scan(c)]
        return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([[str(i) for i in x[2]] for x in found], pa.list_(pa.string()))]

    return appended(docs, scan, _FOUND)


def _hashes(lengths: list[int], whole: bool, bits: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) -> (key, gram): the hashes that winnowing keeps and those of n words for each n of lengths (whole:
    only of texts of n words in all), each once for a key, and only those that the bitmap holds, if one is given."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = b.column(0), 0
            for c in chunks(_bytes(b.column("text"))):
                w = Words(c)
                pos, h = w.kept()
                owner, gram = [w.text[pos]], [h]
                for n in lengths:
                    ok = _whole(w, n) if whole else w.within(n)
                    owner.append(w.text[: len(ok)][ok])
                    gram.append(w.grams(n)[ok] + np.uint64(n))  # hashes of other lengths are others
                t, g = np.concatenate(owner), np.concatenate(gram)
                if bits is not None:
                    slot = g & np.uint64(FILTER_BITS - 1)
                    some = np.flatnonzero(bits.value[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                    t, g = t[some], g[some]
                order = np.lexsort((g, t))
                t, g = t[order], g[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(t[new] + at)), pa.array(g[new].view(np.int64))], names=[b.schema.names[0], "gram"])
                at += len(c)

    return emit


def _overlaps_shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    items = staged(items.distinct())
    # item rows that share an id are told apart
    items = items.withColumn("row", F.unhex(F.md5(F.concat_ws("\0", "item_id", "text").cast("binary"))))
    count = F.regexp_count(F.translate("text", _UPPER, _SMALL), F.lit(_PATTERN))
    lengths = sorted(r["n"] for r in items.select(count.alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    theirs = staged(items.select("row", "text").mapInArrow(_hashes(lengths, True), "row binary, gram long").distinct())
    slot = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    words = theirs.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 31 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 5, np.uint32)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    bits = spark.sparkContext.broadcast(bitmap)

    key = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    texts = docs.where(F.length("text") > 0).select(key.alias("key"), "text")
    ours = texts.mapInArrow(_hashes(lengths, False, bits), "key binary, gram long").distinct()
    sized = items.select("row", F.octet_length("text").alias("n"))
    pairs = staged(ours.join(theirs, "gram").select("key", "row").distinct().join(sized, "row"))
    parts = pairs.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / PART_BYTES)).cast("long").alias("parts"))
    dealt = pairs.join(parts, "key").select("key", "row", F.pmod(F.xxhash64("row"), "parts").alias("part"))
    mine = dealt.join(items, "row").groupBy("key", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("mine"))
    met = texts.join(parts.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, ids = [], []
            for t, some in zip(_bytes(b.column("text")), b.column("mine").to_pylist(), strict=True):
                _, hit, found = Index([(x["item_id"], x["text"].encode()) for x in some]).hits([t])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                spans.append([{"s": s, "e": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                ids.append(sorted(found[0]))
            kinds = (pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(spans, kinds[0]), pa.array(ids, kinds[1])], names=["key", "spans", "ids"])

    each = met.join(mine, "key").select("key", "text", "mine").mapInArrow(compared, "key binary, spans array<struct<s:long,e:long>>, ids array<string>")
    # words under the union of a text's spans: in order of their starts, each adds what lies beyond the ends so far
    union = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["e"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    found = staged(each.groupBy("key").agg(union.alias("_n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("_items"))).withColumnRenamed("key", "_key")
    taken = {"_n_words", "_n_hit", "_items"}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in taken])
    joined = kept.join(found, key == F.col("_key"), "left")
    n_words = F.coalesce(F.regexp_count(F.translate("text", _UPPER, _SMALL), F.lit(_PATTERN)), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return joined.select(*[kept[f"`{c}`"] for c in kept.columns], n_words.alias("_n_words"), F.coalesce("_n_hit", F.lit(0).cast("long")).alias("_n_hit"), F.coalesce("_items", none).alias("_items"))


def _whole(w: Words, n: int) -> np.ndarray:
    """Marks, among the n-grams, those that are a whole text of n words."""
    m = np.zeros(max(0, len(w.hash) - n + 1), bool)
    m[w.first[w.counts == n]] = True
    return m


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a window of a benchmark item occurs. All columns are returned, whatever their names."""
    return sheltered(docs, lambda d: overlaps(d, benchmark).where("_n_hit = 0"), "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH it AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS s FROM it WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT item_id, 10, array_to_string(list_slice(w, i, i + 9), ' ') FROM it, unnest(range(1, len(w) - 8)) u(i) WHERE len(w) >= 10),
lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) u(j) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
