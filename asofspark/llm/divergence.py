"""Source divergence audit: how far the word use of each source of a language lies from the others and the language.

CountVectorizer, with minDF and the largest vocabSize, is fitted to the documents. Each term carries its language, so one
fit gives the vocabulary of every language. From this vocabulary exact sparse vectors of documents are made, those that
its model makes, but looked up in numpy: the model's own transform took a third of all time. The vectors are summed by
source as Summarizer does, but sparsely: only terms that occur are added up. Pairs of sources are evaluated on these sparse sums: terms that
neither of two sources has are counted, not visited, and add the same difference each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

MIN_DF, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
MOST_TERMS = 1 << 21  # kept terms that may go to the driver and every task as CountVectorizer's vocabulary
SAMPLED = 64  # one in so many terms is counted to know beforehand how many are kept
SHARD = 1 << 11  # terms of a language that are evaluated together
SOURCES = 128  # sources of a language that are evaluated against as many others
TOGETHER = 64  # rows whose terms are told apart at a time
LOOKED_UP = 1024  # rows whose terms are looked up at a time
MARKS = 1 << 24  # rows x terms that may be marked in a table
PART = 1000  # vectors that are added at a time
HELD = 1 << 20  # sums of sources and terms that a task holds
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _words(batch: pa.RecordBatch, together: int) -> Iterator[tuple[pa.LargeStringArray, np.ndarray, pa.Array]]:
    """For each run of rows its terms, one after another, the numbers of terms of its rows, and the rows' languages."""
    text = batch.column("_text").cast(pa.large_binary())
    for i in range(0, len(text), together):
        part = text[i : i + together]
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = _LETTER[data]
        joined = inside[1:] & inside[:-1]
        joined[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False  # a term does not go on into the next row
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~joined
        last[:-1] &= ~joined
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(_LOWER[data[inside]]))
        yield words, np.diff(np.searchsorted(starts, offsets)), batch.column("_lang")[i : i + together].cast(pa.large_string())


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of key, in order, and where each begins in key, which is sorted in place."""
    key.sort()
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begins], begins


def _distinct(words: pa.LargeStringArray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of each row, and their numbers."""
    coded = words.dictionary_encode()
    width, rows = max(1, len(coded.dictionary)), len(counts)
    row, code = np.repeat(np.arange(rows), counts), coded.indices.to_numpy()
    if rows * width <= MARKS:
        there = np.zeros((rows, width), bool)
        there[row, code] = True
        row, code = np.nonzero(there)
    else:
        row, code = np.divmod(_runs(row * width + code)[0], width)
    return coded.dictionary.take(pa.array(code)), np.bincount(row, minlength=rows)


def _sampled(words: pa.LargeStringArray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms that a hash of their length and first and last bytes puts into one sample of SAMPLED."""
    _, offsets, data = words.buffers()
    if not len(words):
        return words, counts
    offsets, data = np.frombuffer(offsets, np.int64)[: len(words) + 1], np.frombuffer(data, np.uint8)
    a, b = offsets[:-1], offsets[1:]
    h = (b - a).astype(np.uint64)
    for at in (a, np.minimum(a + 1, b - 1), np.minimum(a + 2, b - 1), np.maximum(b - 2, a), b - 1):
        h = (h + data[at]) * np.uint64(0x9E3779B97F4A7C15)
    take = (h >> np.uint64(40)) % np.uint64(SAMPLED) == 0
    return words.filter(pa.array(take)), np.bincount(np.repeat(np.arange(len(counts)), counts)[take], minlength=len(counts))


def _with_language(words: pa.Array, counts: np.ndarray, langs: pa.Array) -> pa.ListArray:
    """A list of terms for each row, each followed by a space and the row's language."""
    lang = langs.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
    values = pc.binary_join_element_wise(words, lang, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _read(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(blank("lang").alias("_lang"), blank("source").alias("_source"), blank("text").alias("_text"))


def termed(docs: DataFrame, distinct: bool = False, sampled: bool = False) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, terms): each term is a maximal run of ASCII letters and non-ASCII
    characters with A-Z lower-cased, then a space and the language. Nulls are empty. If distinct, a document has each
    term once; if sampled, only the terms that a hash puts into one of SAMPLED samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for words, counts, langs in _words(b, TOGETHER):
                if sampled:
                    words, counts = _sampled(words, counts)
                if distinct:
                    words, counts = _distinct(words, counts)
                rows = b.slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([rows.column("_lang"), rows.column("_source"), _with_language(words, counts, langs)], names=["lang", "source", "terms"])

    return _read(docs).mapInArrow(run, "lang string, source string, terms array<string>")


def _kept_terms(docs: DataFrame, min_df: int) -> int:
    """About how many terms are kept: exact document counts of the terms that a hash puts into one sample of SAMPLED."""
    per_doc = termed(docs, True, True).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return SAMPLED * per_doc.where(F.col("n") >= min_df).count()


def _vectors(batch: pa.RecordBatch, vocabulary: dict[str, tuple[pa.Array, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The sparse vectors of each run of rows: row, number of the term and occurrences, and how many rows there are."""
    for words, counts, langs in _words(batch, LOOKED_UP):
        coded, lang = words.dictionary_encode(), langs.dictionary_encode()
        size = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(counts)), counts)
        both = lang.indices.to_numpy().astype(np.int64)[row] * size + coded.indices.to_numpy()
        number = np.full((len(lang.dictionary), size), -1, np.int64)
        asked = np.zeros(number.shape, bool)
        asked.ravel()[both] = True
        for k, name in enumerate(lang.dictionary.to_pylist()):
            if name in vocabulary:
                terms, numbers = vocabulary[name]
                at = np.flatnonzero(asked[k])
                found = pc.index_in(coded.dictionary.take(pa.array(at)), value_set=terms).fill_null(-1).to_numpy()
                number[k, at[found >= 0]] = numbers[found[found >= 0]]
        i = number.ravel()[both]
        key = row[i >= 0] * width + i[i >= 0]
        found, begins = _runs(key)
        row, i = np.divmod(found, width)
        yield row, i, np.diff(np.append(begins, len(key))), len(counts)


def document_vectors(docs: DataFrame, vocabulary: Broadcast, width: int) -> DataFrame:
    """docs -> (lang, source, i, n): the numbers of the terms that a document has and how often, as CountVectorizer's
    model with this vocabulary (terms and numbers by language) gives them. One row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for row, i, n, rows in _vectors(b, vocabulary.value, width):
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32())
                part = b.slice(at, rows)
                at += rows
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i.astype(np.int32), n)]
                yield pa.RecordBatch.from_arrays([part.column("_lang"), part.column("_source"), *lists], names=["lang", "source", "i", "n"])

    return _read(docs).mapInArrow(run, "lang string, source string, i array<int>, n array<long>")


def summed(vectors: DataFrame, width: int) -> DataFrame:
    """document_vectors -> (source, i, n): sums by source, of the terms that occur in it. A task adds up vectors until it
    holds HELD sums, whatever the width, and Spark adds up what tasks put out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def added_up() -> None:
            key, n = np.concatenate(keys), np.concatenate(sums)
            order = np.argsort(key)
            found, begins = _runs(key[order])
            keys[:], sums[:] = [found], [np.add.reduceat(n[order], begins) if len(begins) else n]

        def out() -> pa.RecordBatch:
            added_up()
            source = pa.array(list(names), pa.string()).take(pa.array(keys[0] // width))
            b = pa.RecordBatch.from_arrays([source, pa.array((keys[0] % width).astype(np.int32)), pa.array(sums[0])], names=["source", "i", "n"])
            keys[:], sums[:] = [keys[0][:0]], [sums[0][:0]]
            names.clear()
            return b

        for b in (whole.slice(k, PART) for whole in batches for k in range(0, whole.num_rows, PART)):
            coded, lists = b.column("source").dictionary_encode(), b.column("i")
            number = np.array([names.setdefault(s, len(names)) for s in coded.dictionary.to_pylist()], np.int64)
            source = np.repeat(number[coded.indices.to_numpy()], pc.list_value_length(lists).to_numpy())
            keys.append(source * width + lists.flatten().to_numpy())
            sums.append(b.column("n").flatten().to_numpy())
            if sum(map(len, keys[1:])) > HELD:
                added_up()
                if len(keys[0]) > HELD:
                    yield out()
        if sum(map(len, keys)):
            yield out()

    parts = vectors.select("source", "i", "n").mapInArrow(run, "source string, i int, n long")
    return parts.groupBy("source", "i").agg(F.sum("n").alias("n"))


def _language(term: Column) -> Column:
    return F.substring(term, F.length(F.substring_index(term, " ", 1)) + 2, (1 << 31) - 1)


def source_counts(docs: DataFrame, min_df: int = MIN_DF, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, term, n): the occurrences of each kept term in each source that has it.

    A language keeps the terms of min_df of its documents at least; rows that repeat count each. CountVectorizer's
    vocabulary goes to the driver and to every task, so its size is estimated first; where it may pass most_terms, or be
    empty, which the fit refuses, the same counts come from a shuffle by term instead.
    """
    once = termed(docs, distinct=True)
    if not 0 < 2 * _kept_terms(docs, min_df) <= most_terms:
        held = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
        found = termed(docs).select("source", F.explode("terms").alias("term")).groupBy("source", "term").agg(F.count("*").alias("n")).join(held, "term")
        return found.select(_language(F.col("term")).alias("lang"), "source", F.substring_index("term", " ", 1).alias("term"), "n")
    # which terms are kept depends on documents alone
    words = [w.split(" ", 1) for w in CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(min_df), vocabSize=(1 << 31) - 1).fit(once).vocabulary]
    by_lang: dict[str, list[tuple[str, int]]] = {}
    for i, (term, lang) in enumerate(words):
        by_lang.setdefault(lang, []).append((term, i))
    vocabulary = {lang: (pa.array([t for t, _ in found], pa.large_string()), np.array([i for _, i in found])) for lang, found in by_lang.items()}
    spark = docs.sparkSession
    names = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(words)), pa.int32()), "term": pa.array([w[0] for w in words], pa.string()), "lang": pa.array([w[1] for w in words], pa.string())}))
    vectors = document_vectors(docs, spark.sparkContext.broadcast(vocabulary), len(words))
    return summed(vectors, len(words)).join(names, "i").select("lang", "source", "term", "n")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) in whole numbers of 38 digits."""
    whole = lambda x: x.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * whole(count + SMOOTH)
    return F.lit(1) + F.call_function("div", above, whole(total + SMOOTH * kept))


def _differences(rows: pa.Table) -> pa.Table:
    """Of one shard of a language's terms and two blocks of its sources: for each pair the sum of differences over the
    terms that either block has, and how many these are. Rows of term null give each source's share of an absent term."""
    lang, one, two = (rows.column(c)[0].as_py() for c in ("lang", "one", "two"))
    absent = pc.is_null(rows.column("term"))
    sources, shares = rows.filter(absent), rows.filter(pc.invert(absent))
    number, block, rest = (sources.column(c).to_numpy() for c in ("number", "block", "p"))
    order = np.argsort(number)
    number, block, rest = number[order], block[order], rest[order]
    terms = shares.column("term").combine_chunks().dictionary_encode() if shares.num_rows else None
    width = len(terms.dictionary) if terms is not None else 0
    p = np.repeat(rest[:, None], width, 1)
    if width:
        p[np.searchsorted(number, shares.column("number").to_numpy()), terms.indices.to_numpy()] = shares.column("p").to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    out = []
    for a in left.tolist():
        others = right[right > a] if one == two else right
        out.append((np.full(len(others), number[a]), number[others], np.abs(p[others] - p[a]).sum(axis=1)))
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    n = len(a)
    return pa.table(
        [pa.array([lang] * n, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64()), pa.array(np.full(n, width), pa.int64())],
        names=["lang", "a", "b", "value", "n"],
    )


def pair_differences(counts: DataFrame, groups: DataFrame, shard: int = SHARD, sources: int = SOURCES) -> DataFrame:
    """counts (lang, number, term, p) and groups (lang, number, kept, absent) -> (lang, a, b, value) for numbers a < b.

    number counts a language's sources from 0, kept its terms; absent is a source's share of a term it does not have.
    Terms are dealt by a hash into shards, sources into blocks of `sources`; a task takes one shard and two
    blocks, so it holds 2 * sources * shard shares whatever the table, and a shard's differences are summed up after it.
    """
    block = F.floor(F.col("number") / sources).cast("int")
    shards = F.greatest(F.ceil(F.col("kept") / shard).cast("int"), F.lit(1))
    g = groups.withColumns({"block": block, "shards": shards})
    per_lang = g.groupBy("lang").agg(F.max("block").alias("last"), F.max("shards").alias("shards"))
    rest = g.select("lang", "number", "block", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    rows = counts.withColumn("block", block).join(per_lang.select("lang", "shards"), "lang")
    rows = rows.select("lang", "number", "block", "term", "p", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    every = rows.unionByName(rest).join(per_lang.select("lang", "last"), "lang")
    every = every.select("lang", "number", "block", "term", "p", "shard", F.explode(F.sequence(F.lit(0), "last")).alias("with"))
    every = every.select("lang", "shard", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "number", "block", "term", "p")
    parts = every.groupBy("lang", "shard", "one", "two").applyInArrow(_differences, "lang string, a long, b long, value long, n long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    of = lambda k: g.select("lang", F.col("number").alias(k), F.col("absent").alias(f"{k}_absent"), "kept")
    both = summed.join(of("a"), ["lang", "a"]).join(of("b").drop("kept"), ["lang", "b"])
    return both.select("lang", "a", "b", (F.col("value") + (F.col("kept") - F.col("n")) * F.abs(F.col("a_absent") - F.col("b_absent"))).alias("value"))


def divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, part, item, value, rank): for each source of a language the others
    by the difference of their shares, summed over the kept terms (part `pair`), and the first `top` terms whose share
    is above the language's (part `term`).

    Nulls are empty: an empty language and an empty source are groups like others. Texts without terms count as
    documents. A language that keeps no term has pairs of value 0 and no terms. Ranks go by falling value, then by item
    in the order of its UTF-8 bytes, so ties have one order. Rows that repeat count each; further columns are ignored;
    an empty table gives no rows.
    """
    counts = staged(source_counts(docs, min_df, most_terms))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(blank("lang"), blank("source")).distinct()
    language = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = language.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source of a language
    absent = F.when(F.col("kept") > 0, _share(F.lit(0), zero("total"), F.col("kept"))).otherwise(0)
    groups = staged(groups.select("lang", "source", number.cast("long").alias("number"), zero("total").alias("total"), zero("kept").alias("kept"), absent.alias("absent")))
    shares = counts.join(groups.drop("absent"), ["lang", "source"]).select("lang", "source", "number", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    pairs = pair_differences(shares.select("lang", "number", "term", "p"), groups)
    name = lambda k, c: groups.select("lang", F.col("number").alias(k), F.col("source").alias(c))
    named = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    named = named.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", F.lit("pair").alias("part"), "x.*")
    q = language.join(kept, "lang").select("lang", "term", _share(F.col("n"), F.col("all"), F.col("kept")).alias("q"))
    over = shares.join(q, ["lang", "term"]).where("p > q").select("lang", F.lit("term").alias("part"), "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = over.withColumn("rank", ranked).where(F.col("rank") <= top)
    return named.withColumn("rank", ranked).unionByName(first).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
tok AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total::HUGEINT + 5 * v.v::HUGEINT) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY 1, 2),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 5)::HUGEINT) // ((SELECT sum(n) FROM l x WHERE x.lang = l.lang)::HUGEINT + 5 * v.v::HUGEINT) AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
