"""Fill-in-middle, chat formatting and the source divergence audit: brute force, round trips, SQL and odd inputs."""

import glob
import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.llm import chat, divergence, infilling
from asofspark.llm.queries import QUERIES, SQL

from ..test_oracles import rows
from .test_operators import odd  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_source_mixing", "op10_decontamination", "op11_fill_in_middle", "op12_chat_format", "op13_source_divergence"])
@pytest.mark.parametrize("where", ["given", "odd"])
def test_against_sql(spark, odd, name, where):  # noqa: F811
    if (name, where) == ("op10_decontamination", "odd"):
        pytest.skip("its SQL takes two minutes on the long texts; test_operators.py has brute force for it")
    d = SF if where == "given" else odd
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    ours, theirs = QUERIES[name](spark, d).toPandas(), c.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def _packed(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in enc])]).astype(np.int64)


@pytest.mark.parametrize("step", [7, 64, infilling.SLICE])
def test_scatter_and_gather_are_slices(monkeypatch, step):
    monkeypatch.setattr(infilling, "SLICE", step)
    r = random.Random(step)
    for _ in range(120):
        texts = ["".join(r.choice("ab<>PSM é漢😀\n") for _ in range(r.choice([0, 0, 1, 2, 5, 60]))) for _ in range(r.randint(1, 9))]
        form = ["" if not t or re.search("<[PSM]>", t) else r.choice(["", "psm", "spm"]) for t in texts]
        one, two = (np.array([r.randrange(1 << 32) for _ in texts]) for _ in "ab")
        data, offsets = _packed(texts)
        out, ends, cuts = infilling.scatter(data, offsets, one, two, np.array(form, "U3"))
        for i, t in enumerate(texts):
            low, high = sorted((int(one[i]) % (len(t) + 1), int(two[i]) % (len(t) + 1)))
            p, m, s = t[:low], t[low:high], t[high:]
            want = {"": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form[i]]
            assert bytes(out[ends[i] : ends[i + 1]]).decode() == want
            assert cuts[i].tolist() == [len(t), low, high]
        back, again = infilling.gather(out, ends, np.array(form, "U3"))
        assert bytes(back) == bytes(data) and again.tolist() == offsets.tolist()


def test_one_long_text_takes_little_memory():
    data = np.frombuffer(("é<x " * (8 << 20)).encode(), np.uint8)  # 40 MB
    offsets, form = np.array([0, len(data)]), np.array(["spm"])
    tracemalloc.start()
    out, ends, _ = infilling.scatter(data, offsets, np.array([123456789]), np.array([23456]), form)
    back, _ = infilling.gather(out, ends, form)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(back, data) and peak < 4 * len(data)


def test_outputs_without_their_sentinels_are_refused():
    with pytest.raises(ValueError):
        infilling.gather(*_packed(["<P>a<S>b"]), np.array(["psm"]))


def test_infilling_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text to cut", "a", 1), (None, None, "b", 2), (3, "<P> held", "c", 3)], "doc_id long, text string, _text string, kept_0 int")
    got = infilling.restored(infilling.fill_in_middle(docs, percent=100)).orderBy("kept_0").collect()
    assert [r["_text"] for r in got] == ["a", "b", "c"] and [r["restored"] for r in got] == ["some text to cut", "", "<P> held"]
    assert [r["form"] == "plain" for r in got] == [False, True, True] and got[1]["n"] == 0
    assert infilling.restored(infilling.fill_in_middle(docs.limit(0))).collect() == []


LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def replay(events):
    """The fold, one event after another."""
    state = defaultdict(dict)
    seen = set()
    first = lambda x: (x is not None, x if x is not None else 0)
    for conv, seq, turn, kind, role, text in sorted(events, key=lambda e: tuple(first(e[k]) if k < 3 else (e[k] is not None, e[k] or "") for k in (1, 2, 3, 4, 5))):
        if seq is not None and (conv, seq) in seen or kind not in ("message", "delta", "edit", "regenerate"):
            continue
        seen.add((conv, seq))
        turns = state[conv]
        turn = chat.FIRST if turn is None else turn
        if kind == "regenerate":
            for t in [t for t in turns if t > turn]:
                del turns[t]
        old_role, old = turns.get(turn, (None, ""))
        turns[turn] = (role if role is not None else old_role, (old if kind == "delta" else "") + (text or ""))
    return {(c, t, r or "", x) for c, turns in state.items() for t, (r, x) in turns.items()}


def test_fold_is_a_replay(spark):
    r = random.Random(5)
    events = [
        (r.randrange(12), r.randrange(60) if r.random() < 0.95 else None, r.choice([1, 2, 3, 4, None]), r.choice(["message", "delta", "delta", "edit", "regenerate", "other"]),
         r.choice(["user", "assistant", None]), r.choice(["a", "bc", "", None, "</turn>", "\\turn"])) for _ in range(600)
    ]
    got = chat.fold(spark.createDataFrame(events, LOG).repartition(5)).collect()
    assert len(got) == len({(x["conv_id"], x["turn"]) for x in got})
    assert {tuple(x) for x in got} == replay(events)
    assert chat.fold(spark.createDataFrame([], LOG)).collect() == []


def test_streams_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "drop"), (1, 4, 3, "message", "user", "gone"),
        (1, 5, 2, "regenerate", None, ""), (1, 7, 2, "delta", None, "lo"), (1, 6, 2, "delta", None, "hel"), (1, 6, 2, "delta", None, "hel"), (1, 8, 1, "edit", None, "hi you"),
    ]
    got = chat.fold(spark.createDataFrame(log, LOG)).orderBy("turn").collect()
    assert [tuple(x) for x in got] == [(1, 1, "user", "hi you"), (1, 2, "assistant", "hello")]


def test_formatting_is_read_back(spark):
    r = random.Random(2)
    bits = ["<turn>", "</turn>", "\\", "\\\\", "<\\turn>", "<", "turn", "/turn", "\n", "é", "😀", "$1", "assistant", ""]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(300)]
    roles = ["user", "assistant", "assistant", "a b+c%", "x\n<turn>", None]
    m = [(i // 7, i % 7, r.choice(roles), t if t or i % 2 else None) for i, t in enumerate(texts)]
    made = chat.rendered(spark.createDataFrame(m, "conv_id long, turn long, role string, text string").repartition(4))
    back = {x["conv_id"]: x for x in chat.read_back(made).collect()}
    made = {x["conv_id"]: x for x in made.collect()}
    for c in {x[0] for x in m}:
        mine = [(role or "", text or "") for conv, _, role, text in m if conv == c]
        assert [tuple(x) for x in back[c]["turns"]] == mine
        assert back[c]["trained"] == "".join(t for role, t in mine if role == "assistant")
        whole = made[c]["formatted"]
        cut = [whole[s["offset"] : s["offset"] + s["length"]] for s in made[c]["loss"]]
        assert [re.sub(r"\\(\\|(?=/?turn))", r"\1", x) for x in cut] == [t for role, t in mine if role == "assistant"]


def test_a_derived_log_gives_its_conversation(spark):
    said = [(1, k, "assistant" if k % 2 else "user", f"say {k} " * (k * 13)) for k in range(40)] + [(2, None, None, None), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, 1, "assistant", "y")]
    log = chat.logged(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    assert {x["kind"] for x in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = chat.fold(log).collect()
    assert Counter((x["conv_id"], x["role"], x["text"]) for x in got) == Counter((c, role or "", t or "") for c, _, role, t in said)


def test_no_python_on_the_main_path(spark):
    plan = QUERIES["op12_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1


def audit(docs, min_df, top):
    """The audit in plain Python."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source, w = lang or "", source or "", words(text)
        df[lang].update(set(w))
        count[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_df]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("way", ["vectors", "shuffle"])
def test_divergence_is_brute_force(spark, way):
    r = random.Random(8)
    words = ["the", "The", "été", "x", "漢字", "word", "a1b", "zz", "😀", "I'm"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = [(r.choice(["en", "de", None, "en"]), r.choice(["s1", "s2", "s3", "s4", "s5", None, ""]), " ".join(r.choices(words, k=r.randrange(30)))) for _ in range(150)]
    docs += [("fr", "only", "alone"), ("fr", "other", None), ("it", None, "words"), (None, "s9", None), docs[0], docs[0], ("long", "a", "w " * 60_000), ("long", "b", "w v" * 10)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "terms", "n", "number", "i", "rank", "part", "item", "kept")})
    got = divergence.divergence(frame.repartition(5), min_df=2, top=7, most_terms=0 if way == "shuffle" else 1 << 20)
    assert sorted(map(tuple, got.collect())) == audit(docs, 2, 7)
    assert divergence.divergence(frame.limit(0)).collect() == []


def test_pairs_in_blocks_and_shards(spark):
    r = random.Random(4)
    groups = [("en", k, 40, r.randrange(5, 9)) for k in range(7)] + [("de", 0, 0, 0), ("de", 1, 0, 0)]
    counts = [("en", k, f"t{t}", r.randrange(100)) for k in range(6) for t in range(40) if r.random() < 0.3]
    g = spark.createDataFrame(groups, "lang string, number long, kept long, absent long")
    c = spark.createDataFrame(counts, "lang string, number long, term string, p long")
    p = {(k, t): next((x[3] for x in counts if x[1:3] == (k, f"t{t}")), groups[k][3]) for k in range(7) for t in range(40)}
    want = {("en", a, b, sum(abs(p[a, t] - p[b, t]) for t in range(40))) for a in range(7) for b in range(a + 1, 7)} | {("de", 0, 1, 0)}
    for shard, sources in ((1000, 100), (9, 2), (1, 3)):
        assert {tuple(x) for x in divergence.pair_differences(c, g, shard, sources).collect()} == want


def test_terms_end_with_their_row(spark):
    texts = ["ab", "cd e", "", "É1F", None, "x", "b a b A"] * 100
    docs = spark.createDataFrame([("q r", "s", t) for t in texts], "lang string, source string, text string").coalesce(1)
    got = [r["terms"] for r in divergence.termed(docs).collect()]
    assert got == [["ab q r"], ["cd q r", "e q r"], [], ["É q r", "f q r"], [], ["x q r"], ["b q r", "a q r", "b q r", "a q r"]] * 100
    assert [sorted(r["terms"]) for r in divergence.termed(docs, distinct=True).collect()] == [sorted(set(x)) for x in got]


@pytest.mark.parametrize("marks", [0, 1 << 24])
def test_distinct_terms(monkeypatch, marks):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "MARKS", marks)
    words, counts = divergence._distinct(pa.array(["b", "a", "b", "b", "c", "c"], pa.large_string()), np.array([3, 0, 3]))
    assert sorted(words.to_pylist()[:2]) == ["a", "b"] and sorted(words.to_pylist()[2:]) == ["b", "c"] and counts.tolist() == [2, 0, 2]


def test_vectors_are_those_of_the_model(spark):
    from pyspark.ml.feature import CountVectorizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    terms = divergence.termed(docs)
    model = CountVectorizer(inputCol="terms", outputCol="counts", minDF=5.0, vocabSize=(1 << 31) - 1).fit(terms)
    import pyarrow as pa

    by_lang = defaultdict(list)
    for i, w in enumerate(model.vocabulary):
        term, lang = w.split(" ", 1)
        by_lang[lang].append((term, i))
    vocabulary = {lang: (pa.array([t for t, _ in x], pa.large_string()), np.array([i for _, i in x])) for lang, x in by_lang.items()}
    want = [dict(zip(map(int, r["counts"].indices), map(int, r["counts"].values), strict=True)) for r in model.transform(terms).collect()]
    got = divergence.document_vectors(docs, spark.sparkContext.broadcast(vocabulary), len(model.vocabulary)).collect()
    assert [dict(zip(r["i"], r["n"], strict=True)) for r in got] == want and sum(map(len, want)) > 1000


def test_about_as_many_terms_are_kept_as_estimated(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(20_000)]
    docs = spark.createDataFrame([("en", "s", " ".join(words[i::4])) for i in range(4)] * 2, "lang string, source string, text string")
    assert 0.8 < divergence._kept_terms(docs, 2) / len(set(words)) < 1.25


def test_digests_are_those_of_the_texts(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(docs) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["restored_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in got)
