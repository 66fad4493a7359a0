"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases
that occur in that language's text; phrases times the log of the language's length of training text (a phrase grows
with that log) over the text's length are its entropy, and the language of the least wins.

Every text is parsed whole, as letters and the gaps between words. Blocks of BLOCK symbols are walked side by side in
numpy, each as if a phrase began with it. Then each block is walked again from the state that the one before ends in,
up to the first phrase that begins where one began before: from there on the two agree. So the phrases are those of one
parse from the text's first symbol to its last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, staged, table
from .quality import fold

SAMPLE_ROWS = 120  # labelled rows per language, at most: the smallest by a hash of doc_id among whole rows ...
SAMPLE_CHARS = 3000  # ... of at most so many characters
TRAIN_CHARS = 40_000  # characters of a language at which no further row is added
MODEL_CHARS = 8_000_000  # characters of all languages at most: from 200 languages on each has an equal share
BLOCK = 192
LANES = 1 << 15  # blocks walked at once
ROUNDS = 6  # walks over all blocks at once, after which those still open are walked one by one
OTHER, GAP = 0, 1  # symbols of letters in no labelled text, and of a run of anything else


class Automaton:
    """Suffix automaton whose states' transitions lie interleaved in one table: a state is the offset of its own, and
    table[state + symbol] holds state << 32 | next state, or something else where the phrase ends. Its size is that of
    the transitions (three for each symbol of the text at most), whatever the alphabet's."""

    def __init__(self, symbols: np.ndarray, width: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(symbols)
        base = self._placed(nxt, width)
        self.table = np.full(max(base) + width + 1, -1, np.int64)
        for s, out in enumerate(nxt):
            for c, t in out.items():
                self.table[base[s] + c] = base[s] << 32 | base[t]

    @staticmethod
    def _placed(nxt: list[dict[int, int]], width: int) -> list[int]:
        """An offset of its own for each state, so that no two transitions share a place; the root has 0. States with
        many transitions go first; each takes the first offset that fits from where its kind stands."""
        base, used = [0] * len(nxt), {0}
        taken = bytearray(4 * sum(map(len, nxt)) + 4 * len(nxt) + width)
        for c in nxt[0]:
            taken[c] = 1
        stand: dict[int, int] = {}
        for s in sorted(range(1, len(nxt)), key=lambda s: -len(nxt[s])):
            places = sorted(nxt[s])
            b = stand.get(len(places), 1)
            tries = 0
            while b in used or any(b + c < len(taken) and taken[b + c] for c in places):
                b += 1
                tries += 1
            if tries > 64 or len(places) < 2:  # crowded up to here
                stand[len(places)] = b
            base[s] = b
            used.add(b)
            if b + width >= len(taken):
                taken.extend(bytes(len(taken) + width))
            for c in places:
                taken[b + c] = 1
        return base

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase starts here) of each state and symbol; a symbol unknown to the language is a
        phrase of its own."""
        found = self.table[state + c]
        fail = found >> 32 != state
        at_root = self.table[c]
        return np.where(fail, np.where(at_root >> 32 == 0, at_root, 0), found & 0xFFFFFFFF), fail | (state == 0)


class Model:
    """The automata of the languages that have text. samples: language -> labelled texts."""

    def __init__(self, samples: dict[str, list[str]]):
        joined = {k: "\n".join(v).lower() for k, v in samples.items()}
        self.langs = sorted(k for k, v in joined.items() if v)
        chars = np.unique(np.frombuffer("".join(joined.values()).encode("utf-32-le", "replace"), np.uint32))
        self.symbol = np.fromiter((OTHER if chr(c).isalpha() else GAP for c in range(0x110000)), np.int32, 0x110000)
        known = chars[self.symbol[chars] == OTHER]
        self.symbol[known] = np.arange(len(known)) + 2
        self.width = len(known) + 2
        self.automata = [Automaton(self._symbols(joined[k]), self.width) for k in self.langs]

    def _symbols(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[first]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """texts x languages: phrases of each whole lower-cased text."""
        parts = [self._symbols(t.lower()) for t in texts]
        blocks = np.fromiter((-(-len(p) // BLOCK) for p in parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), blocks)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(owner):
            return out
        flat = np.concatenate([*parts, np.zeros(BLOCK, np.int32)])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        lens = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        for k, a in enumerate(self.automata):
            out[:, k] = np.bincount(owner, _parsed(a, flat, start, lens, nth > 0), len(texts))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, score) of each text, None without a letter. The score falls from 1 towards 0.5 as the runner-up
        needs as few normalised phrases as the winner; of languages that need equally few the first by name wins."""
        if not self.langs or not texts:
            return [(None, 0.0)] * len(texts)
        need = self.phrases(texts) * np.log2([max(2, a.size) for a in self.automata])
        sizes = np.maximum(1, [len(t) for t in texts])[:, None]
        rate = need / sizes
        best = rate.argmin(1)
        least = rate[np.arange(len(texts)), best]
        other = np.where(np.arange(rate.shape[1]) == best[:, None], np.inf, rate).min(1)
        margin = np.where(np.isfinite(other), 1 - least / np.maximum(other, 1e-12), 1.0)
        letters = [any(map(str.isalpha, t)) for t in texts]
        return [(self.langs[b], float(np.clip(0.5 + 0.5 * m, 0, 1))) if ok else (None, 0.0) for b, m, ok in zip(best, margin, letters, strict=True)]


def _parsed(a: Automaton, flat: np.ndarray, start: np.ndarray, lens: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that start in each block of flat (start, lens) if texts are parsed from their first symbol on; follows
    marks the blocks that go on from the one before."""
    n = len(start)
    count, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begins = np.zeros((n, BLOCK), bool)  # where phrases start in each block, as parsed so far
    by_len = np.argsort(-lens, kind="stable")
    for i in range(0, n, LANES):
        rows = by_len[i : i + LANES]
        state = np.zeros(len(rows), np.int64)
        active = np.searchsorted(-lens[rows], -np.arange(BLOCK), "left")  # blocks longer than each step
        for step in range(BLOCK):
            m = active[step]
            if not m:
                break
            state[:m], new = a.step(state[:m], flat[start[rows[:m]] + step])
            begins[rows[:m], step] = new
        end[rows] = state
    count = begins.sum(1)
    todo, entry = np.flatnonzero(follows), np.zeros(n, np.int64)
    todo = todo[end[todo - 1] != 0]
    for _ in range(ROUNDS):
        if not len(todo):
            return count
        entry[todo] = end[todo - 1]
        changed = []
        for i in range(0, len(todo), LANES):
            changed.append(_again(a, flat, start, lens, begins, count, end, todo[i : i + LANES], entry))
        after = np.concatenate(changed) + 1
        after = after[after < n]
        todo = after[follows[after]]
        todo = todo[end[todo - 1] != entry[todo]]
    table, symbols = a.table, flat
    for b in np.unique(todo).tolist():  # periodic texts whose blocks do not fall into step: one parse to the text's end
        while b < n and follows[b] and end[b - 1] != entry[b]:
            entry[b] = state = int(end[b - 1])
            phrases = 0
            for c in symbols[start[b] : start[b] + lens[b]].tolist():
                found = int(table[state + c])
                if found >> 32 == state:
                    phrases += state == 0
                    state = found & 0xFFFFFFFF
                else:
                    phrases += 1
                    found = int(table[c])
                    state = found if found >> 32 == 0 else 0
            count[b], end[b] = phrases, state
            b += 1
    return count


def _again(a: Automaton, flat: np.ndarray, start: np.ndarray, lens: np.ndarray, begins: np.ndarray, count: np.ndarray, end: np.ndarray, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Walks blocks (rows) from their entry states and corrects begins, count and end; the rows whose end changed."""
    live, state, changed = np.arange(len(rows)), entry[rows], []
    for step in range(BLOCK):
        over = lens[rows[live]] <= step
        if over.any():
            done = rows[live[over]]
            changed.append(done[end[done] != state[over]])
            end[done] = state[over]
            live, state = live[~over], state[~over]
        if not len(live):
            break
        r = rows[live]
        state, new = a.step(state, flat[start[r] + step])
        old = begins[r, step]
        begins[r, step] = new
        open_ = ~(new & old)
        live, state = live[open_], state[open_]
    if len(live):
        done = rows[live]
        changed.append(done[end[done] != state])
        end[done] = state
    count[rows] = begins[rows].sum(1)
    return np.sort(np.concatenate(changed)) if changed else rows[:0]


def train(docs: DataFrame) -> Model:
    """A model of the languages in docs, from rows with text and lang whose crc32(doc_id) mod 4 is not 2.

    The rows of a language are a bounded sample: SAMPLE_ROWS of at most SAMPLE_CHARS characters, whole; a language
    without such rows takes the first SAMPLE_CHARS characters of longer ones. What reaches the driver is bounded by
    that and the number of languages; the model, which goes to every task, by MODEL_CHARS: about 24 bytes for each."""
    known = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False)) & (F.length("text") > 0))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ROWS))
    rank = F.struct((F.length("text") > SAMPLE_CHARS).alias("long"), F.xxhash64(F.col("doc_id")).alias("h"), "doc_id")
    picks = staged(known.groupBy("lang", slot.alias("slot")).agg(F.min(rank).alias("r")).select("lang", "slot", "r.*"))
    chosen = picks.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "slot", "long", "h")
    got = known.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    got = got.groupBy("lang", "slot", "long", "h", "doc_id").agg(F.min(F.left("text", F.lit(SAMPLE_CHARS))).alias("text"))  # of repeated ids one
    samples: dict[str, list[str]] = {}
    rows = sorted(got.collect(), key=lambda r: (r["lang"], r["long"], r["h"], r["doc_id"]))
    most = min(TRAIN_CHARS, MODEL_CHARS // max(1, len({r["lang"] for r in rows})))
    for r in rows:
        mine = samples.setdefault(r["lang"], [])
        if not mine or not r["long"] and sum(map(len, mine)) < most:
            mine.append(r["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) with _lang ('und' if text is null or has no letter) and _score; one row per input row; repeated
    rows fare alike; all columns are kept, but for those that have the name of a new one, which are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(b: pa.RecordBatch) -> list[pa.Array]:
        texts = [x or "" for x in b.column("text").to_pylist()]
        found, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= LANES * BLOCK):
                size += len(texts[end])
                end += 1
            found += held.value.predict(texts[at:end])
            at = end
        return [pa.array([x[0] or "und" for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return appended(docs, predicted, "_lang string, _score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
