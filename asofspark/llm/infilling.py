"""Fill-in-middle transformation by displacement scatter.

Cuts are found by one scan over the code points of a batch. Between cuts all bytes move by the same distance, so a
difference array at the cuts, summed up, gives every byte of the batch its output position; numpy scatters the bytes
there and the sentinels into the gaps. Restoring scans an output for its sentinels, builds the same kind of difference
array for the opposite way, and gathers. All arrays over bytes are made for SLICE bytes at a time, so a long text takes
its own size and its output's, not a multiple of eight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 1 << 20  # bytes for which positions are held at a time
TOGETHER = 8 << 20  # bytes of text that go through as one batch (a longer text goes alone)


def _steps(at: np.ndarray, delta: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices (from, to, moved) of n bytes: moved is the running sum of delta, which begins at the ordered places at."""
    carry = 0
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        i, j = np.searchsorted(at, (a, b))
        moved = np.zeros(b - a, np.int64)
        np.add.at(moved, at[i:j] - a, delta[i:j])
        moved[0] += carry
        np.cumsum(moved, out=moved)
        carry = int(moved[-1])
        yield a, b, moved


def _ranks(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of code points that begin before each of the ordered byte places."""
    out, done = np.zeros(len(places), np.int64), 0
    for a in range(0, len(data) + 1, SLICE):
        starts = np.flatnonzero((data[a : a + SLICE] & 0xC0) != 0x80)
        i, j = np.searchsorted(places, (a, a + SLICE))
        out[i:j] = done + np.searchsorted(starts, places[i:j] - a)
        done += len(starts)
    return out


def _places(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The byte at which the code point of each of the ordered ranks begins (the end, beyond the last)."""
    out, done = np.full(len(ranks), len(data), np.int64), 0
    for a in range(0, len(data), SLICE):
        starts = np.flatnonzero((data[a : a + SLICE] & 0xC0) != 0x80)
        i, j = np.searchsorted(ranks, (done, done + len(starts)))
        out[i:j] = a + starts[ranks[i:j] - done]
        done += len(starts)
    return out


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (bytes, offsets of rows), two draws and a form ("", "psm" or "spm") a row -> (outputs, their offsets, cuts).

    cuts has a row of three numbers a text: code points in all, before the middle, and before the suffix."""
    ranks = _ranks(data, offsets)
    n = np.diff(ranks)
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    cut = _places(data, (ranks[:-1, None] + np.stack([low, high], 1)).ravel()).reshape(-1, 2)
    s, e, marked = offsets[:-1], offsets[1:], form != ""
    ends = np.concatenate([[0], np.cumsum(e - s + 9 * marked)])
    o, psm = ends[:-1], form == "psm"
    head, middle, tail = cut[:, 0] - s, cut[:, 1] - cut[:, 0], e - cut[:, 1]
    # where each part begins in the output; the parts of a plain text stay in their order
    p = o + np.where(marked, np.where(psm, 3, tail + 6), 0)
    t = o + np.where(marked, np.where(psm, head + 6, 3), head + middle)
    m = o + np.where(marked, head + tail + 9, head)
    moves = np.stack([p - s, m - cut[:, 0], t - cut[:, 1]], 1).ravel()
    at, delta = np.stack([s, cut[:, 0], cut[:, 1]], 1).ravel(), np.diff(moves, prepend=0)
    inside = at < len(data)
    out = np.empty(int(ends[-1]), np.uint8)
    for a, b, moved in _steps(at[inside], delta[inside], len(data)):
        moved += np.arange(a, b)
        out[moved] = data[a:b]
    for sign, begin in ((PREFIX, p), (SUFFIX, t), (MIDDLE, m)):
        for k, c in enumerate(sign.encode()):
            out[begin[marked] - 3 + k] = c
    return out, ends, np.stack([n, low, high], 1)


def _signs(data: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The places of the three sentinels in each marked row, in order."""
    found = []
    for a in range(0, len(data), SLICE):
        x = data[a : a + SLICE + 2]
        hit = np.flatnonzero((x[:-2] == ord("<")) & (x[2:] == ord(">")) & np.isin(x[1:-1], np.frombuffer(b"PSM", np.uint8)))
        found.append(hit + a)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, places, side="right") - 1
    places = places[marked[row] & (places + 3 <= offsets[row + 1])]
    if len(places) != 3 * marked.sum():
        raise ValueError("an output does not hold its three sentinels once each")
    return places.reshape(-1, 3)


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and forms -> (texts, their offsets); the inverse of scatter. Only the outputs and forms are looked at."""
    marked = form != ""
    signs = np.zeros((len(form), 3), np.int64)
    signs[marked] = _signs(data, offsets, marked)
    s, e, psm = offsets[:-1], offsets[1:], form == "psm"
    one, two, three = signs.T
    ends = np.concatenate([[0], np.cumsum(e - s - 9 * marked)])
    o = ends[:-1]
    # (begin, length) in the output of prefix, middle and suffix
    head = np.where(psm, one, two) + 3
    head_n = np.where(psm, two, three) - head
    tail = np.where(psm, two, one) + 3
    tail_n = np.where(psm, three, two) - tail
    head, head_n = np.where(marked, head, s), np.where(marked, head_n, e - s)
    middle, middle_n = np.where(marked, three + 3, s), np.where(marked, e - three - 3, 0)
    tail = np.where(marked, tail, s)
    at = np.stack([o, o + head_n, o + head_n + middle_n], 1).ravel()
    moves = np.stack([head, middle, tail], 1).ravel() - at
    delta, inside = np.diff(moves, prepend=0), at < ends[-1]
    text = np.empty(int(ends[-1]), np.uint8)
    for a, b, moved in _steps(at[inside], delta[inside], len(text)):
        moved += np.arange(a, b)
        np.take(data, moved, out=text[a:b])
    return text, ends


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    large = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return large.cast(pa.string())


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows that hold TOGETHER bytes or one row."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > TOGETHER:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    yield slice(begin, len(sizes))


def _put(batch: pa.RecordBatch) -> list[pa.Array]:
    texts, out, cuts = batch.column("_text"), [], []
    sizes = np.diff(_bytes(texts)[1])
    form = np.asarray(batch.column("form").to_pylist(), object)
    first, second = (batch.column(c).to_numpy() for c in ("_one", "_two"))
    for g in _groups(sizes):
        data, offsets = _bytes(texts[g.start : g.stop])
        kind = np.where(form[g] == "plain", "", form[g]).astype("U3")
        done, ends, cut = scatter(data, offsets, first[g], second[g], kind)
        out.append(_strings(done, ends))
        cuts.append(cut)
    n, low, high = np.concatenate(cuts).T
    plain = form == "plain"
    return [pa.array(n), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.chunked_array(out, pa.string()).combine_chunks()]


def _back(batch: pa.RecordBatch) -> list[pa.Array]:
    texts, out = batch.column("_output"), []
    form = np.asarray(batch.column("_form").to_pylist(), object)
    for g in _groups(np.diff(_bytes(texts)[1])):
        kind = np.where(form[g] == "plain", "", form[g]).astype("U3")
        out.append(_strings(*gather(*_bytes(texts[g.start : g.stop]), kind)))
    return [pa.chunked_array(out, pa.string()).combine_chunks()]


def draw(key: Column, seed: int, nth: int) -> Column:
    """The nth 8-digit group of the hex sha256 of `seed:key` as an unsigned number; a null key is taken as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """docs (doc_id, text and any others) -> docs with n, form, prefix_chars, middle_chars and output, one row per row.

    Units are code points. A null or empty text, a text that holds a sentinel, and those drawn beyond percent stay
    plain: output is the text (empty for null), and the numbers of characters are null. A null doc_id draws as an empty
    one; rows that repeat draw alike. An empty table gives no rows. Columns of docs with these names are replaced, all
    others stay, whatever their names. Rows are worked on where they are read: nothing is shuffled.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new])
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    key, text = F.col(at["doc_id"]), F.coalesce(F.col(at["text"]), F.lit(""))
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | held | (draw(key, seed, 3) % 100 >= percent)
    form = F.when(plain, "plain").when(draw(key, seed, 4) % 100 < spm_percent, "spm").otherwise("psm")
    read = docs.toDF(*names).select(*names, text.alias("_text"), draw(key, seed, 1).alias("_one"), draw(key, seed, 2).alias("_two"), form.alias("form"))
    done = appended(read, _put, "n long, prefix_chars long, middle_chars long, output string")
    return done.select(*names, *new).toDF(*docs.columns, *new)


def restored(docs: DataFrame) -> DataFrame:
    """docs (output, form and any others) -> docs with restored: the text that fill_in_middle had, from these two alone.

    A null output is an empty text; a null form is plain. An output without its three sentinels is an error.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "restored"])
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    read = docs.toDF(*names).select(*names, F.col(at["output"]).alias("_output"), F.coalesce(F.col(at["form"]), F.lit("plain")).alias("_form"))
    return appended(read, _back, "restored string").select(*names, "restored").toDF(*docs.columns, "restored")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
        ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM h),
f AS (SELECT *, least(c1, c2) AS low, greatest(c1, c2) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
             WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
