"""Secret scans, in DataFrame functions only: a random forest removes false positives among candidates.

Candidates are long tokens with letters and digits. The forest sees a candidate's length, its character transitions,
how much of it dictionary words cover, whether it is part of a path, and the neighbouring words. The dictionary holds the
most frequent words of all documents beside a list of technical ones. The forest is fitted with Spark ML on labelled
findings and then written out as one column expression, so that scoring, and masking within the text, need no shuffle
and no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sheltered, staged, table

CANDIDATE = r"(?<![A-Za-z0-9_+/=\-])(?=[A-Za-z_+/=\-]*[0-9])(?=[0-9_+/=\-]*[A-Za-z])[A-Za-z0-9_+/=\-]{16,}+"
MASK = "[SECRET]"
SECRET_AT = 0.5
FINDINGS = 6000  # labelled findings that are derived where none are given
CONTEXT = 60  # characters of the gap on each side that hold the neighbouring words
DICTIONARY = 2000  # most frequent words of the documents that make a token, or its neighbourhood, readable

# technical words that make a token readable, whatever the documents
WORDS = (
    "access account admin agent alpha android api app archive asset auth base beta bin block blob body book bot branch "
    "build bundle byte cache cert channel chart check class client cloud code color commit common config content "
    "control core count create credential data date debug default delete demo deploy dev device dist doc domain "
    "download draft driver dummy edit email enable encode error event example export fail fake file filter final fixed "
    "flag folder font form format frame front full function global group guide handler hash head health height help "
    "here home host html http icon image import index info init input install internal item java job json key kind "
    "label lang last layer lib library limit line link linux list load local log login main make manager map master "
    "max media menu message meta method min mode model module name network node note number object office online "
    "option order output package page parser part pass password path patch photo placeholder plugin point port post "
    "prod profile project public query queue random read record redacted release remote report request resource "
    "response result retry role root route rule sample schema script search secret select send server service session "
    "set setting shared sign site size source spec stage start state static status step storage store stream string "
    "style sub support sync system table target task team temp test text theme thread time title token tool track "
    "tree type unit update upload url user usr util value version video view web width window work worker write www "
    "xxxx year your zero"
).split()
ASKED = "secret|token|passw|pwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|auth|bearer|credential|client[ _-]?key"
OTHERWISE = "commit|sha|checksum|digest|etag|hash|uuid|guid|version|revision|build|example|placeholder|sample|fingerprint|image|base64,|href|src|path|file"


def split_at_candidates(text: Column) -> tuple[Column, Column]:
    """(values, gaps): the candidates in order, and the stretches between them (one more)."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(part).cast("double"), F.length(whole).cast("double")), F.lit(0.0))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The `size` most frequent words of 4 to 20 letters (a to z, lower-cased) in all texts of docs, ties by the word."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(4, 20))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(size).collect()]


def _known(text: Column, words: Sequence[str]) -> Column:
    """The words of a text (runs of letters, also in camel case) that are in the dictionary."""
    parts = F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    return F.filter(parts, lambda p: (F.length(p) >= 4) & p.isin(list(words)))


def features(value: Column, before: Column, after: Column, words: Sequence[str] = ()) -> list[Column]:
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "[^aA#]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    near, low = F.lower(F.substring_index(F.right(before, F.lit(CONTEXT)), "\n", -1)), F.lower(value)
    last_words = F.regexp_extract(near, r"(\S*\s*\S*\s*\S*)$", 1)
    vowels = F.regexp_replace(F.regexp_replace(low, "[aeiouy]", "v"), "[bcdfghjklmnpqrstvwxz]+", "c")
    one = lambda c: c.cast("int").cast("double")
    technical = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    near_after = F.regexp_extract(F.substring_index(F.left(F.coalesce(after, F.lit("")), F.lit(CONTEXT)), "\n", 1), r"^\W*(\S*\s*\S*)", 1)
    around = F.concat_ws(" ", last_words, near_after)
    if words:
        covered = F.aggregate(_known(value, words), F.lit(0), lambda n, w: n + F.length(w)) / F.greatest(F.length(value), F.lit(1)).cast("double")
        neighbours = F.size(_known(around, words)) / F.greatest(F.size(F.split(F.trim(around), r"\s+")), F.lit(1)).cast("double")
    else:
        covered = neighbours = F.lit(0.0)
    return [
        F.least(F.length(value), F.lit(256)).cast("double"),
        _share(F.substring(runs, 2, 1 << 30), value),
        F.size(F.regexp_extract_all(runs, F.lit("[aA]#"), F.lit(0))).cast("double"),
        F.size(F.regexp_extract_all(value, F.lit("[a-z][A-Z]|[A-Z][a-z]"), F.lit(0))) / F.greatest(F.length(value), F.lit(1)).cast("double"),
        _share(F.regexp_replace(value, "[^0-9]", ""), value),
        _share(F.regexp_replace(value, "[^A-Z]", ""), value),
        _share(F.regexp_replace(value, "[A-Za-z0-9]", ""), value),
        F.size(F.array_distinct(F.split(low, ""))).cast("double") / F.sqrt(F.greatest(F.length(value), F.lit(1)).cast("double")),
        F.size(F.regexp_extract_all(vowels, F.lit("cv"), F.lit(0))) / F.greatest(F.length(value), F.lit(1)).cast("double"),
        F.lit(1.0) - _share(F.regexp_replace(low, technical, ""), value),
        one(value.rlike("^[0-9a-fA-F]+$")),
        one(value.rlike("^(?i:akia|asia|ghp_|gho_|github_pat_|sk_live_|sk-|xox[bp]-|glpat-|eyj|aiza)")),
        one(value.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        F.size(F.regexp_extract_all(value, F.lit("/"), F.lit(0))).cast("double"),
        one(before.rlike(r"[/\\.]$") | F.coalesce(after.rlike(r"^[/\\.]\w"), F.lit(False))),
        one(before.rlike(r"[\"'`]$")),
        one(before.rlike(r"[=:]\s*[\"'`]?$")),
        one(last_words.rlike(ASKED)),
        one(last_words.rlike(OTHERWISE)),
        one(last_words.rlike(r"://\S*$")),
        covered,
        neighbours,
    ]


FEATURES = 22


def derived_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 5, words: Sequence[str] = ()) -> DataFrame:
    """(text, label): labelled findings in the forms that scanners meet, drawn by hash from fixed templates, and from
    the first hundred of words (a dictionary), where there are any.

    Positive: random hexadecimal, base64 and vendor-prefixed values, most of them assigned to a telling name.
    Negative: digests, commit ids, UUIDs, paths, identifiers, placeholders, dated names, embedded images."""
    def drawn(i: Column) -> Column:
        part = lambda k: F.sha1(F.concat(i.cast("string"), F.lit(f":{seed}:{k}")))
        draw = lambda k, m: F.conv(F.substring(part(k), 1, 8), 16, 10).cast("long") % m
        pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (draw(k, len(xs)) + 1).cast("int"))
        b64 = lambda k: F.base64(F.unhex(F.sha2(part(k), 384)))
        alnum = lambda k: F.translate(b64(k), "+/=", "x7Q")
        word = lambda k: pick(k, WORDS)
        syll = lambda k: F.concat(*[pick(f"{k}{i}", ["th", "an", "er", "tion", "re", "ou", "le", "que", "ar", "os", "en", "ung", "sch", "ment"]) for i in range(3)])
        number = draw("n", 90000) + 10000
        some = list(words[:100])
        known = lambda k: pick(k, some)
        name = pick("nm", ["token", "secret", "api_key", "password", "access_key", "auth", "client_secret", "API key", "private key", "bearer"])
        sign, quote = pick("sg", [" = ", "=", ": ", ":"]), pick("qt", ['"', "'", "", '"'])
        assigned = F.concat(syll("w"), F.lit(" "), name, sign, quote)
        bare = F.concat(syll("w"), F.lit(" "), syll("x"), F.lit(" "))
        secret = [
            (part("v"), assigned), (F.substring(part("v"), 1, 32), assigned), (b64("v"), assigned), (F.substring(alnum("v"), 1, 40), assigned),
            (F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(alnum("v"), "abcdefgh", "23456723"), 1, 16))), pick("cx", ["aws ", "key id ", "access_key="])),
            (F.concat(pick("px", ["ghp_", "sk_live_", "glpat-", "xoxb-"]), F.substring(alnum("v"), 1, 36)), F.when(draw("bb", 2) == 0, bare).otherwise(assigned)),
            (part("v"), F.concat(syll("w"), F.lit(" "), name, F.lit(" "))),
        ]
        plain = [
            (part("v"), F.concat(syll("w"), F.lit(" "), pick("cm", ["commit ", "sha1: ", "checksum = ", "etag: ", "revision ", "hash="]))),
            (F.sha2(part("v"), 256), F.concat(syll("w"), F.lit(" "), pick("cm", ["sha256:", "digest ", "checksum: "]))),
            (F.concat_ws("-", *[F.substring(part("v"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), pick("cu", ["uuid: ", "id=", "order ", "session ", "user "])),
            (F.concat(F.lit("/usr/"), word("a"), F.lit("/"), word("b"), F.lit("/"), word("c"), number.cast("string")), pick("cp", ["open ", "path = ", "see ", "file "])),
            (F.concat_ws("_", F.lit("your"), word("a"), F.lit("here"), number.cast("string")), assigned),
            (F.concat(F.lit("EXAMPLE_"), F.upper(word("a")), F.lit("_TOKEN_"), number.cast("string")), assigned),
            (F.concat_ws("_", word("a"), word("b"), word("c"), word("d"), number.cast("string")), F.when(draw("bb", 3) == 0, assigned).otherwise(bare)),
            (F.concat_ws("-", F.lit("2024-01"), word("a"), word("b"), word("c"), number.cast("string")), bare),
            (F.concat(syll("a"), syll("b"), syll("c"), number.cast("string")), bare),
            (F.concat(b64("v"), alnum("v2"), alnum("v3")), F.lit("img src data:image/png;base64,")),
            (F.concat(word("a"), F.lit("-"), word("b"), F.lit("-"), word("c"), F.lit("-"), number.cast("string")), F.lit("https://www.example.com/")),
        ]
        if some:
            bare = F.when(draw("kb", 2) == 0, bare).otherwise(F.concat(known("d1"), F.lit(" "), known("d2"), F.lit(" ")))
            plain += [
                (F.concat(known("e1"), F.lit("-"), known("e2"), F.lit("-"), known("e3"), F.lit("-"), number.cast("string")), bare),
                (F.concat(known("e1"), F.initcap(known("e2")), F.initcap(known("e3")), F.initcap(known("e4")), number.cast("string")), F.when(draw("bb", 3) == 0, assigned).otherwise(bare)),
            ]
        kinds = [(v, c, 1.0) for v, c in secret] + [(v, c, 0.0) for v, c in plain]
        kind = i % len(kinds)
        choose = lambda i: F.coalesce(*[F.when(kind == k, x[i] if i < 2 else F.lit(x[2])) for k, x in enumerate(kinds)])
        text = F.concat(choose(1), choose(0), F.when(draw("q", 2) == 0, F.lit('" ')).otherwise(" "), syll("z"))
        return F.struct(text.alias("text"), choose(2).alias("label"))

    # inside a lambda the templates are interpreted; as plain columns their generated code would be too large
    return spark.range(0, n, 1, 1).select(F.explode(F.transform(F.array("id"), drawn)).alias("f")).select("f.*")


@dataclass
class Forest:
    """A fitted forest: called with features it gives the score column. words is the dictionary its features need."""

    score: Callable[[list[Column]], Column]
    words: Sequence[str] = ()

    def __call__(self, f: list[Column]) -> Column:
        return self.score(f)


def trained(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None) -> Forest:
    """A forest for docs: its dictionary is that of docs, its findings are those given (text with one candidate, label 0
    or 1) or, without any, derived ones."""
    words = dictionary(docs)
    return forest(derived_findings(spark, words=words) if findings is None else findings, words=words)


def forest(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 11, words: Sequence[str] = ()) -> Forest:
    """A function from features to a score column, fitted on findings (text with one candidate, label 0 or 1).

    Findings are a bounded table (see derived_findings); those without a candidate or label are not used. Without
    any, or with one label only, every candidate scores that label (or 1)."""
    values, gaps = split_at_candidates(F.col("text"))
    rows = findings.where(F.col("text").rlike(CANDIDATE) & F.col("label").isin(0, 1)).select(F.col("label").cast("double").alias("label"), values.alias("v"), gaps.alias("g"))
    one = F.array(F.struct(F.col("v")[0].alias("value"), F.col("g")[0].alias("before"), F.col("g")[1].alias("after")))
    x = F.transform(one, lambda c: F.array(*features(c["value"], c["before"], c["after"], words)))[0]
    rows = staged(rows.select("label", x.alias("x"))).select("label", array_to_vector("x").alias("features"))
    seen = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        only = float(seen[0]) if seen else 1.0
        return Forest(lambda f: F.lit(only), words)
    ordered = rows.coalesce(1).sortWithinPartitions("label", F.xxhash64(F.col("features").cast("string")))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ordered)

    def written(node, f: list[Column]) -> Column:
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return F.lit(counts[1] / max(sum(counts), 1e-9))
        split = node.split()
        return F.when(f[split.featureIndex()] <= float(split.threshold()), written(node.leftChild(), f)).otherwise(written(node.rightChild(), f))

    roots = [t._call_java("rootNode") for t in model.trees]

    def scored(f: list[Column]) -> Column:
        total = written(roots[0], f)
        for r in roots[1:]:
            total = total + written(r, f)
        return F.round(total / len(roots), 6)

    return Forest(scored, words)


def _candidates(text: Column, scored: Callable[[list[Column]], Column]) -> Column:
    """An array of (value, score, gap) structs, in order; gap is the text before the candidate."""
    values, gaps = split_at_candidates(text)
    after = F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1)))
    zipped = F.arrays_zip(values.alias("value"), F.slice(gaps, 1, F.size(values)).alias("before"), after.alias("after"))
    # features are bound to a one-element array, so that each is computed once though the trees use it often
    words = getattr(scored, "words", ())
    one = lambda x: F.transform(F.array(F.array(*features(x["value"], x["before"], x["after"], words))), lambda f: scored([f[i] for i in range(FEATURES)]))[0]
    return F.transform(zipped, lambda x: F.struct(x["value"].alias("value"), one(x).alias("score"), x["before"].alias("before")))


def scan(docs: DataFrame, scored: Callable[[list[Column]], Column]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ordinal, start, n_chars, value_sha256, score, is_secret: a row per candidate.

    start counts characters from 0. Documents without a candidate (null and empty ones too) give no rows; repeated
    rows give repeated findings; the values themselves are not returned."""
    found = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", _candidates(F.col("text"), scored).alias("c"))
    placed = F.aggregate(
        "c",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct(
            (acc["end"] + F.length(x["before"]) + F.length(x["value"])).alias("end"),
            F.concat(acc["starts"], F.array(acc["end"] + F.length(x["before"]))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    rows = found.select("doc_id", F.posexplode(F.arrays_zip(F.col("c"), placed.alias("start"))).alias("ordinal", "x"))
    return rows.select(
        "doc_id", "ordinal", F.col("x.start").cast("long").alias("start"), F.length("x.c.value").cast("long").alias("n_chars"),
        F.sha2("x.c.value", 256).alias("value_sha256"), F.col("x.c.score").alias("score"), (F.col("x.c.score") >= SECRET_AT).alias("is_secret"),
    )


def masked(docs: DataFrame, scored: Callable[[list[Column]], Column]) -> DataFrame:
    """docs with every secret in text replaced by MASK; other texts, rows and columns as they are, whatever their names.
    A column n_chars, where there is one, follows the new text."""
    def run(d: DataFrame) -> DataFrame:
        c = F.col("_c")
        gaps = F.split("text", CANDIDATE, -1)
        shown = F.transform(c, lambda x: F.concat(x["before"], F.when(x["score"] >= SECRET_AT, F.lit(MASK)).otherwise(x["value"])))
        text = F.when(F.size(c) > 0, F.concat(F.array_join(shown, ""), F.element_at(gaps, -1))).otherwise(F.col("text"))
        with_c = d.withColumn("_c", F.when(F.col("text").rlike(CANDIDATE), _candidates(F.col("text"), scored)))
        changed = F.exists("_c", lambda x: x["score"] >= SECRET_AT)
        out = with_c.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return out

    return sheltered(docs, run, "text", "n_chars")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, trained(spark, docs))
