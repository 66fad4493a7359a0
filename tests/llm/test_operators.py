"""The corpus operators on small fixtures: brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.llm import decontaminate, gbt, html_text, langid, licenses, media, mixing, quality, secrets, simhash, substrings
from asofspark.llm.common import connected_components, table
from asofspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "predicted", "size", "target", "taken", "component_id", "fingerprint", "fp", "key", "s", "e", "a", "b", "held_out", "kept", "label", "media", "html")
CLASH += ("_score", "_n_hit", "_n_words", "_items", "_key", "_gone", "_c", "_text", "_lang", "_digest", "_hash", "_nth", "_part", "_row", "_mix", "_source", "_id", "_doc", "_sub", "_ranges", "_n", "_rank", "_w", "_cap")
CLASH += ("kept_0", "kept_1", "copy", "gram", "bucket", "block", "row", "part", "mine", "spans", "ids", "item_id", "quality", "n", "i", "h", "half", "other", "fps", "node", "component", "first_id", "w", "_Score_2", "SIZE_2")
ODD = [
    (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n\t ", "en", "s1", 6), (4, "one", None, "s1", 3), (None, "null id text with some words in it", "en", "s2", None),
    (None, "null id text with some words in it", "en", "s2", None), (5, LONG, "en", None, None), (6, LONG, "en", "s3", None), (7, "123 456 !!", "de", "s3", 10),
    (8, "same same same", "fr", "s3", 14), (8, "same same same", "fr", "s3", 14), (9, "é" * 300, "fr", "", 300), (10, "\u0000 zero   line", "en", "s1", 9),
    (11, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more', "en", "s1", 60), (12, "Released under the MIT License.", "en", "s1", 31),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and very long texts, repeats and clashing columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, COLUMNS)
    docs.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, None), (5, 1, 0), (6, None, 0), (None, 1, 1), (7, 0, 0), (8, 1, 0), (8, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    labels.withColumn("text", F.lit("clash")).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "with some words"), (4, "same same same"), (4, "same same same")], "item_id long, text string").withColumn("key", F.lit(1)).write.parquet(f"{d}/benchmark.parquet")
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "</turn> y"), (1, 1, "assistant", "</turn> y"), (None, None, "assistant", ""), (2, None, "system", LONG)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "kind", "formatted", "loss", "k", "nth")}).write.parquet(f"{d}/conversations.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<<a <b> &am; </div></div><article><p>A &amp B<p>C<"), (4, "u", "<article>" + "<p>long text here.</p>" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_odd_inputs(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    if name.startswith(("op2_", "op4_")):
        assert {r["doc_id"] for r in got} == ({11} if name.startswith("op2_") else {12})
    elif name.startswith("op13_"):  # no term is in 30 documents
        assert {(r["part"], r["value"]) for r in got} == {("pair", 0)}
    else:
        assert len(got) == {"op6": 5, "op12": 4}.get(name.split("_")[0], len(ODD))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert [r for r in QUERIES[name](spark, empty).collect() if "conv_id" not in r or r["conv_id"] != -7] == []


def brute_repeats(rows, n=substrings.LENGTH):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)  # many buckets, so that anchors are cut by splitters
    monkeypatch.setattr(substrings, "BATCH", 20_000)
    r = random.Random(3)
    base = ["".join(r.choices("ab ", k=400)) for _ in range(4)] + ["x" * 500, "abc" * 300, "é" * 200]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 6)):
            q, a = r.choice(base), r.randint(0, 300)
            parts.append(q[a : a + r.randint(20, 300)] if r.random() < 0.7 else "".join(r.choices("abcdefghij", k=r.randint(1, 90))))
        rows.append((i, "".join(parts)))
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [tuple(x)[:5] for x in got] == brute_repeats(rows)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] for x in got)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = substrings.without_repeats(docs, False).drop("kept").orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_repeats([tuple(x) for x in docs.collect()])


def test_suffix_dedup_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "FANOUT", 5)
    monkeypatch.setattr(substrings, "CHUNK", 700)  # texts are cut into pieces
    r = random.Random(9)
    base = ["".join(r.choices("abcde ", k=900)) for _ in range(3)] + ["xy" * 450, "z" * 1500, "".join(r.choices("ab", k=900))]
    rows = [(i, "".join((q := r.choice(base))[(a := r.randint(0, 500)) : a + r.randint(90, 900)] for _ in range(r.randint(0, 4)))) for i in range(90)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), False).drop("kept").orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_repeats(rows)


def test_periodic_texts_stay_small():
    for unit, size in (("q", 20 << 20), ("abc", 3 << 20)):
        held = substrings._Combiner(np.array([], "S24"))
        batch = __import__("pyarrow").RecordBatch.from_pydict({"_doc": [1, 2], "_sub": [0, 0], "text": [unit * (size // len(unit)), None]})
        for some in substrings._inputs(iter([batch])):
            held.add(*some)
        assert sum(len(p[0]) for p in held.parts) <= len(unit) * 2 * (size // substrings.CHUNK + 1) and sum(len(g[0]) for g in held.gone) <= 2 * (size // substrings.CHUNK + 1)


def test_multikey_ranks():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (200, 4)).astype(np.uint64)
    ranks = substrings.multikey(np.zeros(200, np.int64), lambda d, r: words[r, d], range(4))
    keys = [tuple(w) for w in words.tolist()]
    assert ranks.tolist() == [sum(k < x for k in keys) for x in keys]


def test_secret_forest_holds_out(spark):
    scored = secrets.forest(secrets.derived_findings(spark, 1500))
    held = secrets.derived_findings(spark, 600, seed=77)
    both = held.select("label", secrets._candidates(F.col("text"), scored)[0]["score"].alias("s")).where("s is not null").collect()
    assert sum((r["s"] >= 0.5) == (r["label"] == 1) for r in both) / len(both) > 0.97


def brute_features(value, before, after, known=()):
    import re

    kinds = re.sub("[^aA#]", "-", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "#", value))))
    runs, low, n = re.sub(r"(.)\1+", r"\1", kinds), value.lower(), max(1, len(value))
    near = before[-secrets.CONTEXT :].rpartition("\n")[2].lower()
    last = re.search(r"(\S*\s*\S*\s*\S*)$", near)[1]
    vowels = re.sub("[bcdfghjklmnpqrstvwxz]+", "c", re.sub("[aeiouy]", "v", low))
    words = "|".join(sorted(secrets.WORDS, key=lambda w: (-len(w), w)))
    parts = lambda t: [p for p in re.split("[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", t).lower()) if len(p) >= 4 and p in known]
    following = re.match(r"\W*(\S*\s*\S*)", (after or "")[: secrets.CONTEXT].partition("\n")[0])
    around = f"{last} {following[1] if following else ''}"
    yes = lambda pattern, t: float(bool(re.search(pattern, t)))
    return [
        min(len(value), 256), (len(runs) - 1) / n, len(re.findall("[aA]#", runs)), len(re.findall("[a-z][A-Z]|[A-Z][a-z]", value)) / n,
        sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(not c.isalnum() for c in value) / n, len(set(low)) / n**0.5,
        len(re.findall("cv", vowels)) / n, 1 - len(re.sub(words, "", low)) / n, yes("^[0-9a-fA-F]+$", value),
        yes("^(?i:akia|asia|ghp_|gho_|github_pat_|sk_live_|sk-|xox[bp]-|glpat-|eyj|aiza)", value), yes("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", value),
        value.count("/"), float(bool(re.search(r"[/\\.]$", before) or re.search(r"^[/\\.]\w", after or ""))), yes(r"[\"'`]$", before), yes(r"[=:]\s*[\"'`]?$", before),
        yes(secrets.ASKED, last), yes(secrets.OTHERWISE, last), yes(r"://\S*$", last),
        sum(map(len, parts(value))) / n if known else 0.0, len(parts(around)) / max(1, len(around.split())) if known else 0.0,
    ]


def test_secret_scan_is_brute_force(spark):
    import re

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    known = ["that", "with", "this", "config", "thon"]
    findings = secrets.derived_findings(spark, 400, words=known).select(F.lit(0).alias("doc_id"), "text")
    some = docs.where(F.col("text").rlike(secrets.CANDIDATE)).unionByName(findings)
    values, gaps = secrets.split_at_candidates(F.col("text"))
    rows = some.select("text", F.posexplode(values).alias("i", "v"), gaps.alias("g")).select("text", "i", "v", F.col("g")[F.col("i")].alias("b"), F.col("g")[F.col("i") + 1].alias("a"))
    got = rows.select("text", "i", F.array(*secrets.features(F.col("v"), F.col("b"), F.col("a"), known)).alias("x")).collect()
    assert len(got) > 300
    for r in got:
        found = list(re.finditer(secrets.CANDIDATE, r["text"]))
        m = found[r["i"]]
        before = r["text"][found[r["i"] - 1].end() if r["i"] else 0 : m.start()]
        after = r["text"][m.end() : found[r["i"] + 1].start() if r["i"] + 1 < len(found) else len(r["text"])]
        assert r["x"] == pytest.approx(brute_features(m[0], before, after, known)), m[0]
    want = sorted((d["doc_id"], k, m.start(), len(m[0]), hashlib.sha256(m[0].encode()).hexdigest()) for d in docs.collect() for k, m in enumerate(re.finditer(secrets.CANDIDATE, d["text"] or "")))
    assert sorted(tuple(r)[:5] for r in QUERIES["op2_secret_scan"](spark, "/root/testdata/sf0.01").collect()) == want


def test_dictionary_counts_all_documents(spark):
    rows = [("Alpha beta-Alpha x1gamma",), ("gamma GAMMA abc",), (None,), ("",)]
    assert secrets.dictionary(spark.createDataFrame(rows, "text string"), 2) == ["gamma", "alpha"]


def test_secrets_are_masked_in_place(spark):
    text = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff end'
    rows = [(1, text, "en", "s", len(text)), (2, None, "en", "s", None), (3, "plain", "en", "s", 5)]
    got = secrets.masked(spark.createDataFrame(rows, COLUMNS), lambda f: F.when(f[17] == 1, 0.9).otherwise(0.1)).orderBy("doc_id").collect()
    want = text.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", secrets.MASK, 1)
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert [tuple(r) for r in got[1:]] == rows[1:]


def test_secret_spans(spark):
    r = secrets.scan(spark.createDataFrame(ODD, COLUMNS).where("doc_id = 11"), lambda f: F.lit(1.0)).collect()
    assert [(x["start"], x["n_chars"]) for x in r] == [(9, 40)]


def test_trees_learn_and_are_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = gbt.fit(x[:600], y[:600], trees=40)
    s = t.score(x[600:])
    assert ((s > 0.5) == y[600:]).mean() > 0.93 and 0 <= s.min() <= s.max() <= 1
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_holds_out(spark):
    d = "/root/testdata/sf0.01"
    r = QUERIES["op3_quality_trees"](spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) > 0.95


def test_quality_is_one_tree_after_another(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_trees"](spark, SF).collect()}
    for d in docs.collect():
        x, total = quality.statistics((d["text"] or "").encode()), trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if x[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        s = 1 / (1 + np.exp(-total))
        assert got[d["doc_id"]]["score"] == pytest.approx(s) and got[d["doc_id"]]["predicted"] == (s >= 0.3)


def test_licenses_are_told_apart(spark):
    notice = licenses._NOTICE.format
    cases = [
        (notice("library", "Lesser General Public License", "2.1"), ["LGPL-2.1"]), (notice("library", "Lesser General Public License", "3"), ["LGPL-3.0"]),
        (notice("library", "Library General Public License", "2"), ["LGPL-2.0"]), (notice("program", "Affero General Public License", "3"), ["AGPL-3.0"]),
        (notice("program", "General Public License", "2"), ["GPL-2.0"]), (notice("program", "General Public License", "3"), ["GPL-3.0"]),
        (notice("program", "General Public License", "1"), ["GPL-1.0"]), (notice("program", "General Public License", "4"), []),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]), ("This work is licensed under the GNU General Public License, version 9.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY 3.0.", []), ("Licensed under CC BY-NC-SA 4.0.", []),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
        ("This file is not released under the MIT License.", []), ("It isn't licensed under the Apache License, Version 2.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []), ("Not this. Released under the MIT License.", ["MIT"]), ("para no***\nReleased under the MIT License.", ["MIT"]), ("This is not\nreleased under the MIT License.", []),
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        (licenses._BSD.replace("1. ", "* ").replace("2. ", "* "), ["BSD-2-Clause"]), (licenses.TEMPLATES["BSD-4-Clause"][0].replace("organization", "university"), ["BSD-4-Clause"]),
    ]
    texts = [t for t, _ in cases] + [f"Some words before.\n\n{t if chr(10) in t else textwrap.fill(t, 60)}\n\nand after" for t, _ in cases]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("confirmed").orderBy("start").collect()
    for i, (_, want) in enumerate(cases * 2):
        assert [r["license"] for r in got if r["doc_id"] == i] == want, texts[i]


def test_license_scan_is_brute_force(spark):
    """Short templates, word for word, at every place of every text; of those that overlap the longest."""
    sf = "/root/testdata/sf0.01"
    short = {tuple(licenses.words(t)): n for n, ts in licenses.TEMPLATES.items() for t in ts if len(licenses.words(t)) < 10}
    want = []
    for d in table(spark, sf, "documents").collect():
        w, taken = licenses.words(d["text"] or ""), set()
        for n in range(9, 0, -1):
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in short and not taken & set(range(p, p + n)):
                    taken |= set(range(p, p + n))
                    want.append((d["doc_id"], short[tuple(w[p : p + n])]))
    got = [(r["doc_id"], r["license"]) for r in QUERIES["op4_license_scan"](spark, sf).where("confirmed").collect()]
    longer = [x for x in got if x not in want]
    assert len(want) > 5 and sorted(x for x in got if x not in longer) == sorted(want)


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"])
def test_full_license_texts(name):
    path = f"/usr/share/common-licenses/{name}"
    if not __import__("os").path.exists(path):
        pytest.skip("no full text on this machine")
    found = {x[2] for x in licenses.licenses_in(open(path).read())}
    assert found == {name if "." in name else f"{name}.0"}


def test_licenses():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            got = licenses.judge(t)
            assert got[0] == name and got[3] == [] and got[4]
            noisy = licenses.judge("  ".join(f"{w}%%%" for w in t.split()))
            assert noisy[0] == name and noisy[4]
    assert not licenses.judge("Licensed under CC BY-NC-SA 4.0.")[4]
    assert not licenses.judge("he lost his driving license in the hat shop")[4]
    text = "intro\nReleased under the MIT License.\n\n" + "x\n" * 9 + "All rights reserved.\n"
    assert [text[a:b] for a, b in licenses.blocks(text)] == ["Released under the MIT License.", "All rights reserved."]


def test_wrapped_and_several_licenses(spark):
    wrap = lambda t, lead="": "\n".join(lead + x for x in textwrap.wrap(t, 72 - len(lead)))
    full = {n: t[-1] for n, t in licenses.TEMPLATES.items()}
    texts = [f"intro\n\n{wrap(t, lead)}\n\nmore" for t in full.values() for lead in ("", " * ", "# ")]
    want = [[n] for n in full for _ in range(3)]
    texts += ["Released under the MIT License.\n\nAll rights reserved.", f"{wrap(full['MIT'])}\n\n{wrap(full['Apache-2.0'])}", "Licensed under CC BY 4.0. Released under the MIT License."]
    want += [["MIT", "All-Rights-Reserved"], ["MIT", "Apache-2.0"], ["CC-BY-4.0", "MIT"]]
    texts += [wrap(full["ISC"].replace("fee is hereby", "any fee hereby")), "into the public\ndomain", f"Foo License\n{full['ISC']}\nfurther warranty", full["MIT"] * 3, ""]
    want += [["ISC"], [None], [None, "ISC", None], ["MIT"] * 3, []]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[r["license"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])] for i in range(len(texts))] == want
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert by[len(full) * 3 + 3, "ISC"]["differences"].split() == ["+any", "-is"]
    isc = by[3, "ISC"]
    assert texts[3][isc["start"] : isc["start"] + isc["n_chars"]] == wrap(full["ISC"])


def test_alignment_is_the_best():
    def cost(t, w):
        row = list(range(len(w) + 1))
        for i, x in enumerate(t, 1):
            new = [i]
            for j, y in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else 99))
            row = new
        return row[-1]

    r = random.Random(8)
    for _ in range(60):
        t = r.choices("abcdef", k=20)
        inner = [x for x in t if r.random() > 0.06]
        inner.insert(r.randint(0, 19), "z")
        w = r.choices("abcdef", k=5) + inner + r.choices("abcdef", k=r.randint(0, 4))
        best = min(cost(t, w[i:j]) for i in range(len(w)) for j in range(i, len(w) + 1))
        lo, hi, same, diff = licenses.align(t, w, 5, 12)
        assert len(diff) == best == cost(t, w[lo:hi])
        assert same + sum(d[0] == "-" for d in diff) == 20 and same + sum(d[0] == "+" for d in diff) == hi - lo
        assert licenses.align(t, w, 5, best - 1) is None


def test_media_round_trip():
    r = random.Random(4)
    payloads = [media.payload(b""), media.payload(b"hello"), media.payload(r.randbytes(5000)), media.payload(bytes([255]) * 700), media.payload(bytes([0, 255]) * 900)]
    files = media.write(payloads)
    assert [x[:, :, 0].tobytes() for x in media.read(files)] == payloads
    assert all(f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") == len(f) - 8 for f in files)


def test_media_reads_full_blocks():
    """A JPEG whose blocks have AC coefficients, written bit by bit with two-symbol tables, against a plain DCT."""
    ac = {0x00: "0", 0x01: "10", 0x11: "110"}  # end of block; size 1 at once; size 1 after one zero
    bits = ""
    blocks = [{0: 40, 1: 1}, {0: 40, 2: -1}, {0: 40}, {0: 40, 1: -1, 3: 1}]
    last = 0
    for b in blocks:
        d = b[0] - last
        last = b[0]
        size = abs(d).bit_length()
        code, n = media._DC[size]
        bits += f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        k = 1
        for pos in sorted(p for p in b if p):
            bits += ac[(pos - k) << 4 | 1] + ("1" if b[pos] > 0 else "0")
            k = pos + 1
        bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0")
    head = media._head(16, 16)
    old = media._segment(0xC4, bytes([0x10, *media.AC_COUNTS, *media.AC_SYMBOLS]))
    new = media._segment(0xC4, bytes([0x10, 1, 1, 1, *[0] * 13, 0x00, 0x01, 0x11]))
    got = media.read([media._avi([head.replace(old, new) + scan + media.END], 16, 16)])[0][0]
    for b, pixels in zip(blocks, got, strict=True):
        c = np.zeros(64)
        for k, x in b.items():
            c[media.ZIGZAG[k]] = x * media.QUANT
        c = c.reshape(8, 8)
        cu = lambda u: 0.5**0.5 if u == 0 else 1
        want = [[128 + 0.25 * sum(cu(u) * cu(v) * c[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
        assert np.abs(pixels.reshape(8, 8) - np.array(want)).max() <= 0.51


def test_media_columns_are_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_avi_media"](spark, SF).collect()}
    by_text = {}
    for d in table(spark, SF, "documents").collect():
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        stored = media.write([full])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        cuts, last = [0], len(full) // 192
        hist = [np.bincount(np.frombuffer(full[k * 192 : k * 192 + 192], np.uint8) >> 4, minlength=16) / 192 for k in range(last)]
        diff = [np.abs(hist[k + 1] - hist[k]).sum() / 2 for k in range(last - 1)]
        for k, x in enumerate(diff):
            before = diff[max(0, k - 8) : k] or [0.0]
            if x >= 0.3 and x > np.mean(before) + 3 * np.std(before) + 1e-12:
                cuts.append(k + 1)
        assert [c["first_frame"] for c in r["clips"]] == cuts and r["n_clips"] == len(cuts)
        assert [(c["start_s"], c["end_s"]) for c in r["clips"]] == [(a / 25, z / 25) for a, z in zip(cuts, [*cuts[1:], last], strict=True)]
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]


def test_shots_and_clips(spark):
    dark, light = bytes(range(0, 60)) * 32, bytes(range(190, 250)) * 32
    assert media.shots(np.frombuffer(dark * 2 + light * 2, np.uint8).reshape(-1, 192, 1)).tolist() == [0, 20]
    docs = spark.createDataFrame([(1, "a" * 192 * 12 + "zZ" * 96 * 12)], "doc_id long, text string")
    clips = media.clip_rows(media.store(docs)).orderBy("clip").collect()
    assert [(c["first_frame"], c["frames"], c["start_s"]) for c in clips] == [(0, 12, 0.0), (12, 12, 12 / media.FPS)]


def test_html_on_unseen_layouts(spark):
    trees = html_text.train(table(spark, SF, "pages"))
    right = 0
    for k in range(9000, 9040):
        nodes = html_text._nodes(html_text.parse(html_text.made_page(random.Random(k))))
        want = "\n".join(s[2] for s in sorted((s for n in nodes if n.label == 1 for s in n.segs), key=lambda s: s[0]))
        right += html_text.decode(nodes, trees.score(html_text.features(nodes))) == want
    assert right >= 38
    page = '<body><nav><ul><li><a href="/">Home</a></ul></nav><script>var x="<p>no</p>"</script><!-- no --><article><h1>A&amp;B</h1><p>one<br>two \n three<p>four <b>five</b></article><footer>no</footer>'
    got = html_text.extract(spark.createDataFrame([(page,)], "html string"), trees).collect()
    assert got[0]["_text"] == "A&B\none two three\nfour five"


def test_html_query_is_brute_force(spark):
    """The given pages name their articles, so a plain reader of that element knows the text."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.inside = [[]], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag == "br":
                self.blocks[-1].append(" ")
            elif tag not in ("b", "a", "i"):
                self.blocks.append([])

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i", "br"):
                self.blocks.append([])
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    sf, right, n = "/root/testdata/sf0.01", 0, 0
    got = {r["page_id"]: r for r in QUERIES["op6_html_text"](spark, sf).collect()}
    for p in table(spark, sf, "pages").collect():
        reader = Reader()
        reader.feed(p["html"] or "")
        reader.close()
        want = "\n".join(t for b in reader.blocks if (t := " ".join("".join(b).split())))
        n += 1
        right += got[p["page_id"]]["text"] == want
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
    assert right >= 0.99 * n


def _extracted(page, trees):
    nodes = html_text._nodes(html_text.parse(page))
    return html_text.decode(nodes, trees.score(html_text.features(nodes))).split("\n"), nodes


def test_html_layouts_without_names(spark):
    trees = html_text.train(table(spark, SF, "pages"))
    said = "The council met on Tuesday, and after two hours of talks it agreed to pay for the bridge. Nobody objected."
    menu = '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul></div>'
    comments = '<div class="comments"><h3>Comments</h3><div class="comment"><p>Anna</p><p>I liked this article very much, thanks.</p></div><div class="comment"><p>Bob</p><p>Not me. It is wrong!</p></div></div>'
    for n in (3, 30, 198, 202, 500):
        want = [f"Paragraph {i}. {said}" for i in range(n)]
        text = "".join(f'<p data-y="{"top" if i % 2 else 2.5}">{t}</p>' for i, t in enumerate(want))
        layouts = [
            "{}", "<div>{}</div>", '<div class="wrapper">{}</div>', "<section>{}</section>", f"<table><tr><td>{menu}</td><td>{{}}</td></tr></table>", "<article>{}</article>",
            "<div><div><div>{}</div></div></div>", f"<article>{{}}{comments}</article>", f"<div>{{}}{comments}</div>",
        ]
        for layout in layouts:
            got, _ = _extracted(f'<html><body>{menu}{layout.format(text)}<div class="footer">Copyright 2020 Example Corp.</div></body></html>', trees)
            assert got == want, (n, layout)


@pytest.mark.parametrize("held_out", [("table", "section", "article"), ("plain", "nested", "main")])
def test_html_holds_out_by_layout(held_out):
    xs, ys = [], []
    for k in range(600):
        r = random.Random(k)
        layout = r.choice(html_text.LAYOUTS)
        if layout not in held_out:
            nodes = html_text._nodes(html_text.parse(html_text.made_page(r, layout)))
            use = html_text.labelled(nodes)
            xs.append(html_text.features(nodes)[use])
            ys += [nodes[i].label for i in use]
    trees = gbt.fit(np.concatenate(xs), np.array(ys, float), trees=60, depth=4)
    for layout in held_out:
        recall, precision = [], []
        for k in range(9000, 9040):
            got, nodes = _extracted(html_text.made_page(random.Random(k), layout), trees)
            want = [s[2] for n in nodes if n.label == 1 for s in n.segs]
            same = sum(min(got.count(t), want.count(t)) for t in set(want))
            recall.append(same / len(want))
            precision.append(same / max(1, len(got)))
        assert np.mean(recall) > 0.9 and np.mean(precision) > 0.9, layout


@pytest.mark.parametrize(("page", "want"), [
    ('<nav><svg class="icon"/>menu</nav><article><p>text', "menu|text"), ("<nav><svg/></nav><p>text<p>more<svg><text>no</text></svg>", "text|more"),
    ('<svg a="x>y" b=\'/\' hidden />one', "one"), ("<svg><path d='M0'/></svg>one<svg width=1/>no</svg>two", "onetwo"), ("<svg\n/>one<math/>two", "onetwo"),
    ("<video-player><p>one</p></video-player><title-bar>two</title-bar><template-card>three", "one|two|three"), ("<title>no</title-bar>no</title>one", "one"),
    ("<p>a <math><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mi>y</mi></math> b", "a x2=y b"), ("<script src=x>no</script>one<style>no", "one"), ("one<script", "one"),
    ('<p data-y="top">one<p data-y=0.5>two<p data-y>three', "one|two|three"),
])
def test_html_tokens(page, want):
    nodes = html_text._nodes(html_text.parse(page))
    assert "|".join(s[2] for s in sorted((s for n in nodes for s in n.segs), key=lambda s: s[0])) == want
    assert all(n.label is None for n in nodes)


def test_sibling_features_at_any_width():
    kids = "".join(f"<{t}>{'word ' * (1 + k * k % 11)}.</{t}>" for k in range(450) for t in ["h2" if k % 7 == 3 else "p"])
    nodes = html_text._nodes(html_text.parse(f"<body><div>{kids}</div><p>end"))
    x = html_text.features(nodes)[:, -20:]
    assert max(len(n.kids) for n in nodes) == 450
    for n, row in zip(nodes, x, strict=True):
        sib = n.parent.kids if n.parent else [n]
        at = [s is n for s in sib].index(True)
        near = [sib[k].chars if 0 <= k < len(sib) else 0 for k in (at - 1, at + 1)]
        assert row[9:12].tolist() == [at, len(sib), sum(s.tag == n.tag for s in sib) / len(sib)] and row[14:16].tolist() == near


def test_simhash_is_brute_force(spark):
    import xxhash

    def slow(text):
        w = text.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = table(spark, SF, "documents").select("doc_id", "text")
    fps = {r["doc_id"]: slow(r["text"] or "") for r in docs.collect()}
    got = QUERIES["op7_simhash_dedup"](spark, SF).collect()
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] for r in got)
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(comp[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3)
            changed |= low < comp[i]
            comp[i] = min(comp[i], low)
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_simhash_crowded_families(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(40):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 1, 2, 2, 3]))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {x: min(comp) for comp in _components(fps) for x in comp if len(comp) > 1}
    for crowded in (0, 3, 10**6):
        got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, crowded)).collect()}
        assert got == want


def _components(fps):
    left, out = set(fps), []
    while left:
        todo = [left.pop()]
        comp = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
            left -= near
            comp |= near
            todo += near
        out.append(comp)
    return out


def test_long_chains_connect(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 3000), (5, 5)]
    r = random.Random(1)
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000, 3000: 1000}


def test_keep_one_keeps_clean_documents(spark):
    rows = [(1, "alpha beta gamma delta", "en", "s", 1), (2, "alpha beta gamma delta", "en", "s", 1), (3, "quite another text than that", "en", "s", 1), (3, "quite another text than that", "en", "s", 1), (None, "alpha beta gamma delta", "en", "s", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3]


def test_mix_matches_its_plan(spark):
    docs = table(spark, SF, "documents")
    plan = {r["doc_id"]: (r["copies"], r["size"], r["source_size"], r["target"]) for r in mixing.mix_plan(docs).collect()}
    got = mixing.mix(docs.withColumn("size", F.lit("clash"))).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {k: v[0] for k, v in plan.items() if v[0]}
    assert all(v[0] <= 2 and v[3] <= 2 * v[2] for v in plan.values())
    by_source = {}
    for _, _, s, t in plan.values():
        by_source[(s, t)] = None
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(v[1] for v in plan.values()))


def test_rows_without_an_id_draw_on_their_own(spark):
    words = "a b c d e f g h i j " * 10
    rows = [(None, words, s) for s in ("s1", "s2", "s3") for _ in range(200)] + [(7, f"{words}{i % 90}", s) for s in ("s1", "s2", "s3") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    runs = []
    for _ in range(2):
        plan = mixing.mix_plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).orderBy("target").collect()
        assert len(plan) == 3 and all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in plan)
        runs.append(plan)
    assert runs[0] == runs[1]
    staged = mixing.staged(docs)
    mixed = mixing.mix(staged).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("taken")).orderBy("taken").collect()
    assert [r["taken"] for r in mixed] == sorted(r["taken"] for r in runs[0])


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 50), ("", 40), ("z", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights: '' 5, a 2, b 1, z 5, null 2; all sizes 200, shared 300
    assert got[""] == 80 and got["b"] == 20 and got["z"] == 0
    assert got["a"] == pytest.approx(100) and got[None] == pytest.approx(100)


def test_language_holds_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    r = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) / len(r) > 0.98


def test_cross_parsing_counts_phrases():
    m = langid.Model({"x": ["abracadabra"], "y": ["zzzz"]})
    for text in ("abra", "abracadabra", "dabra brac", "zzz abra"):
        low, n, i = text, 0, 0
        while i < len(low):
            j = i + 1
            while j < len(low) and low[i : j + 1] in "abracadabra":
                j += 1
            n, i = n + 1, j
        assert m.phrases([text])[0][0] == n
    assert m.predict(["", "12 34", "abra"])[:2] == [(None, 0.0), (None, 0.0)]


def test_parse_goes_on_over_blocks():
    r, letters = random.Random(3), [chr(0x4E00 + i) for i in range(300)]
    known = {"a": "".join(r.choices("ab", k=3000)), "b": "".join(r.choices("abc", k=2000)), "c": "".join(r.choices(letters, k=3000)), "d": "aaa"}
    m = langid.Model({k: [v] for k, v in known.items()})
    texts = ["".join(r.choices("abc", k=k)) for k in (1, 191, 192, 193, 400, 5000)] + ["a" * 500, "a" * 3001, "ab" * 1500, "abc" * 700, "q" * 700, "".join(r.choices(known["c"], k=900)), known["a"][100:1500], known["c"][5:2000]]
    got = m.phrases(texts)
    for k, text in enumerate(known.values()):
        for t, n in zip(texts, got[:, k], strict=True):
            phrases, i = 0, 0
            while i < len(t):
                j = i + 1
                while j < len(t) and t[i : j + 1] in text:
                    j += 1
                phrases, i = phrases + 1, j
            assert n == phrases


def test_scripts_of_many_letters(spark):
    r = random.Random(6)
    scripts = {"x": [chr(0x0980 + i) for i in range(0x80) if chr(0x0980 + i).isalpha()], "y": [chr(0x4E00 + 7 * i) for i in range(70)], "z": [chr(0x4E00 + 7 * i + 1) for i in range(70)]}
    write = lambda k, n: " ".join("".join(r.choices(scripts[k], k=r.randint(1, 6))) for _ in range(n))
    rows = [(i, write(k, 40), k) for i, k in enumerate(["x", "y", "z"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs.withColumn("_lang", F.lit("clash")), langid.train(docs)).collect()
    assert all(g["_lang"] == g["lang"] for g in got)


def test_languages_with_less_text_are_not_at_a_loss():
    r = random.Random(2)
    words = {k: ["".join(r.choices(c, k=r.randint(2, 7))) for _ in range(400)] for k, c in (("much", "abcdefghij"), ("little", "cdefghijkl"))}
    write = lambda k, n: " ".join(r.choices(words[k], k=n))
    m = langid.Model({"much": [write("much", 6000)], "little": [write("little", 600)]})
    for k in words:
        assert sum(x[0] == k for x in m.predict([write(k, 30) for _ in range(40)])) >= 38


@pytest.mark.parametrize("lang", ["de", "en"])
def test_equal_languages_go_to_the_first_name(lang):
    assert langid.Model({"en": ["abc abc"], lang: ["abc abc"]}).predict(["abc"])[0][0] == min("en", lang)


def test_decontamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 30)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 10)  # most hashes pass
    docs = table(spark, SF, "documents").select("doc_id", "text")
    bench = table(spark, SF, "benchmark").unionByName(spark.createDataFrame([(900, "the"), (901, "of the"), (902, "the of"), (903, "in the and of"), (None, "zzz")], "item_id long, text string"))
    near, far = (decontaminate.overlaps(docs, bench, n).orderBy("doc_id").collect() for n in (1 << 20, 0))
    assert near == far and max(len(r["_items"]) for r in near) >= 2


def test_decontamination_both_ways(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, "a b c one two d"), (10**6 + 1, None), (10**6 + 2, "ONE, two!")], "doc_id long, text string")
    bench = table(spark, SF, "benchmark").unionByName(spark.createDataFrame([(900, "one two"), (901, None), (None, "zzz")], "item_id long, text string"))
    docs = docs.unionByName(extra)
    near, far = (decontaminate.overlaps(docs, bench, n).orderBy("doc_id").collect() for n in (1 << 20, 0))
    assert near == far
    items = [(str(r["item_id"]) if r["item_id"] is not None else "null", _words(r["text"])) for r in bench.collect()]
    for r in near:
        w, hit, found = _words(r["text"]), set(), set()
        for i, x in items:
            n = min(10, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found.add(i)
        assert (r["_n_words"], r["_n_hit"], r["_items"]) == (len(w), len(hit), sorted(found))


def _words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_repeated_words_take_linear_time():
    import time

    n, began = 60_000, time.time()
    index = decontaminate.Index([(1, b"na " * n), (2, b"la " * n), (3, b"na na")] + [(k, b"same words") for k in range(10, 5010)])
    got = index.scan([b"na " * n, b"xx " + b"na " * 9 + b"b", b"ab " * n, b"the same words"])
    assert [x[:2] for x in got] == [(n, n), (11, 9), (n, 0), (3, 2)]
    assert [x[2] for x in got[:3]] == [[1, 3], [3], []] and len(got[3][2]) == 5000
    assert time.time() - began < 10


def test_windows_are_those_of_brute_force():
    r = random.Random(1)
    for _ in range(200):
        words = [b"a", b"b", b"cc", b"D", "é".encode(), b"9"][: r.choice([1, 2, 6])]
        text = lambda most, words=words: b" ".join(r.choice(words) for _ in range(r.randrange(most)))
        items = [(i, text(r.choice([5, 15, 40]))) for i in range(r.randrange(1, 6))] + [(98, b"a a"), (99, b"a a")]
        texts = [text(r.choice([3, 20, 60])) for _ in range(5)] + [b"x y " + items[0][1] + b" z"]
        split = lambda t: [w.encode() for w in _words(t.decode())]
        for t, got in zip(texts, decontaminate.Index(items).scan(texts), strict=True):
            w, hit, found = split(t), set(), set()
            for i, x in ((i, split(x)) for i, x in items):
                n = min(10, len(x))
                windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
                for p in range(len(w) - n + 1) if n else ():
                    if tuple(w[p : p + n]) in windows:
                        hit |= set(range(p, p + n))
                        found.add(i)
            assert got == (len(w), len(hit), sorted(found, key=str))


def test_a_long_text_takes_little_memory_as_media():
    import tracemalloc

    text = media.payload(b"a line of some text, and more. " * (1 << 18))  # 8 MB
    tracemalloc.start()
    (blocks,) = media.read(media.write([text]))
    cuts, peak = media.shots(blocks), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert blocks[:, :, 0].tobytes() == text and cuts[0] == 0 and peak < 20 * len(text)
