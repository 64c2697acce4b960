"""Secret scan: patterns, and character Markov models of random strings and identifiers.

Patterns give the base spans. The method adds spans of kind ``random``: runs of 16 or more key
characters whose log-likelihood ratio under a first-order character model of random strings
against one of ordinary identifiers is high per character. Both models are transition tables
over at most 67 characters, counted from labelled samples of several families: secret values of
the documents and strings drawn from alphabets; words of the documents, alone and joined to names
and paths, numbers, dates and rules. Each family weighs the same. A fifth of the samples is held
out; they choose the threshold and give its error rates.

Positions come from the built-in functions: the pieces between matches and the matches
alternate, so their lengths add up to the spans. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.session import cut

#: The patterns of the base kinds, in order, the group that is measured and its least length.
BASE = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32))
#: The same spans with the least length in the pattern, where a match that is too short hides no other.
FASTER = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Strings of which a text with a match has one.
HINTS = {"assign": ("=", ":"), "access": ("AKIA",)}
LEAST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = " "
#: Alphabets of drawn strings, as slices of ``ALPHABET``: letters of one case, with digits, all.
DRAWN = {"upper": ALPHABET[:26] + "234567", "lower": ALPHABET[26:52], "lower digits": ALPHABET[26:62], "hex": "0123456789abcdef",
         "letters digits": ALPHABET[:62], "base 64": ALPHABET[:64], "url base 64": ALPHABET[:62] + "_-"}
SPANS = "array<struct<start:bigint,end:bigint>>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once.

    The optimiser copies a projection into each of its uses; it leaves a generated row alone.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern; texts without one of its hints are not searched."""
    found = F.regexp_extract_all(text, F.lit(FASTER.get(kind, pattern)), F.lit(0))
    hinted = F.lit(False)
    for hint in HINTS.get(kind, ()):
        hinted = hinted | F.contains(text, F.lit(hint))
    return F.when(hinted, found).otherwise(F.array().cast("array<string>")) if kind in HINTS else found


def with_spans(df: DataFrame, patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``df`` (text and more) with an array<struct<start, end>> per kind of (pattern, group, least).

    Spans are the leftmost non-overlapping matches whose group has ``least`` characters; they come
    from the lengths of the matches and of the pieces between them.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    df = once(df, **{f"{kind}_found": matches(text, kind, p) for kind, (p, *_) in patterns.items()})
    pieces = {}
    for kind, (pattern, group, _) in patterns.items():
        some = F.size(f"{kind}_found") > 0
        pieces[f"{kind}_between"] = F.when(some, F.split(text, FASTER.get(kind, pattern), -1)).otherwise(none)
        if group:
            pieces[f"{kind}_inner"] = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
    df = once(df, **pieces)
    spans = {}
    for kind, (_, group, least) in patterns.items():
        rows = F.zip_with(F.slice(f"{kind}_between", F.lit(1), F.size(f"{kind}_found")),
                          F.arrays_zip(F.col(f"{kind}_found").alias("found"), F.col(f"{kind}_{'inner' if group else 'found'}").alias("inner")),
                          lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(m["found"]).cast("bigint").alias("n"),
                                                  F.length(m["inner"]).alias("inner")))
        spans[kind] = _long_enough(_walked(rows), least).cast(SPANS)
    df = once(df, **spans)
    return df.drop(*[f"{kind}_{part}" for kind in patterns for part in ("found", "between", "inner")])


def _walked(rows: Column) -> Column:
    """array<struct<start, end, inner>> from the lengths of gaps and matches in order."""
    span = "array<struct<start:bigint,end:bigint,inner:int>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(rows, begin, lambda acc, m: F.struct(
        (acc["at"] + m["gap"] + m["n"]).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["n"]).alias("end"),
                                                m["inner"].alias("inner")))).cast(span).alias("spans")))["spans"]


def _long_enough(spans: Column, least: int) -> Column:
    return F.transform(F.filter(spans, lambda s: s["inner"] >= least),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def named(spans: Column, place: int, kind: str) -> Column:
    """The spans with their kind and its place in the order of kinds."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def transition_counts(samples: DataFrame) -> DataFrame:
    """(random, family, pair, n) from labelled samples (token string, random boolean, family string).

    A pair is two adjacent characters, the first of a token behind ``START``. At most 67 * 68 rows a
    family and label; without a column of that name all samples are one. Null tokens and labels are left out.
    """
    if "family" not in samples.columns:
        samples = samples.withColumn("family", F.lit(""))
    tokens = samples.filter("token is not null and random is not null")
    chars = once(tokens.filter(F.length("token") > 0).select("random", "family", "token"), chars=F.split(F.concat(F.lit(START), "token"), ""))
    pairs = F.transform(F.sequence(F.lit(1), F.size("chars") - 1),
                        lambda i: F.concat(F.element_at("chars", i), F.element_at("chars", i + 1)))
    return (chars.select("random", "family", F.explode(pairs).alias("pair"))
            .filter(F.contains(F.lit(ALPHABET), F.substring("pair", 2, 1)))
            .groupBy("random", "family", "pair").agg(F.count("*").alias("n")))


def log_ratios(counts: DataFrame, smoothing: float = 0.5, weight: float = 8.0, family_weight: float = 20_000.0) -> dict[str, float]:
    """Pair -> log(P(second | first, random) / P(second | first, identifier)).

    Every family counts as ``family_weight`` pairs, so that one frequent kind of secret does not hide
    the others. A character's share after another is backed off, with ``weight``, to its share after any, and
    that, with ``smoothing`` for each character, to the same share for all.
    """
    rows = counts.collect()  # bounded by the alphabet and the families
    sizes: dict[tuple, int] = {}
    for row in rows:
        sizes[row["random"], row["family"]] = sizes.get((row["random"], row["family"]), 0) + row["n"]
    shares = {}
    for label in (True, False):
        table: dict[str, float] = {}
        after, anywhere = dict.fromkeys(START + ALPHABET, 0.0), dict.fromkeys(ALPHABET, smoothing)
        for row in rows:
            if row["random"] == label:
                pair, n = row["pair"], family_weight * row["n"] / sizes[label, row["family"]]
                table[pair] = table.get(pair, 0.0) + n
                after[pair[0]] = after.get(pair[0], 0.0) + n
                anywhere[pair[1]] += n
        total = sum(anywhere.values())
        shares[label] = {first + second: (table.get(first + second, 0.0) + weight * anywhere[second] / total)
                         / (after[first] + weight) for first in START + ALPHABET for second in ALPHABET}
    return {pair: math.log(shares[True][pair] / shares[False][pair]) for pair in shares[True]}


def mean_log_ratio(token: Column, ratios: dict[str, float]) -> Column:
    """Log-likelihood ratio per character of a token over the alphabet."""
    table = F.lit([ratios[a + b] for a in START + ALPHABET for b in ALPHABET])

    def step(acc: Column, c: Column) -> Column:
        now = F.position(c, F.lit(START + ALPHABET)) - 1  # the start is 0
        ratio = F.element_at(table, acc["last"] * len(ALPHABET) + now)
        return F.struct((acc["sum"] + ratio).alias("sum"), now.alias("last"))

    walked = F.aggregate(F.split(token, ""), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), step)
    return walked["sum"] / F.length(token)


def _at_least(least: int):
    return lambda value: F.length(value) >= least


def _pick(choices: list[Column], *seeds: Column | str) -> Column:
    """One of the choices by a hash of the seeds."""
    return F.element_at(F.array(*choices), (F.pmod(F.xxhash64(*seeds), F.lit(len(choices))) + 1).cast("int"))


def _drawn(letters: Column, length: Column, *seeds: Column | str) -> Column:
    """A string of ``length`` characters from ``letters``, each by a hash of the seeds and its place."""
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda j: F.substring(
        letters, (F.pmod(F.xxhash64(*seeds, j), F.length(letters)) + 1).cast("int"), F.lit(1))), "")


def drawn_strings(spark: SparkSession, each: int = 1_000) -> DataFrame:
    """(token, random, family): ``each`` random strings of 16 to 47 characters from every alphabet of ``DRAWN``."""
    length = (LEAST + F.pmod(F.xxhash64("family", "id"), F.lit(32))).cast("int")
    rows = spark.range(each).select("id", F.inline(F.array(*[
        F.struct(F.lit(name).alias("family"), F.lit(letters).alias("letters")) for name, letters in DRAWN.items()])))
    return rows.select(_drawn(F.col("letters"), length, "family", "id").alias("token"), F.lit(True).alias("random"), "family")


def plain_strings(spark: SparkSession, each: int = 1_000) -> DataFrame:
    """(token, random, family): ``each`` long numbers and dates with times, and rules of every character."""
    rows = spark.range(each)
    length = (LEAST + F.pmod(F.xxhash64("id"), F.lit(32))).cast("int")
    number = rows.select(_drawn(F.lit("0123456789"), length, F.lit("number"), "id").alias("token"), F.lit("number").alias("family"))
    moment = F.timestamp_seconds(F.pmod(F.xxhash64(F.lit("moment"), "id"), F.lit(2_000_000_000)))
    shapes = [F.date_format(moment, f) for f in ("yyyy-MM-dd-HH-mm-ss", "yyyy/MM/dd/HH/mm/ss", "yyyyMMdd_HHmmss", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd")]
    date = rows.select(_pick(shapes, F.lit("shape"), "id").alias("token"), F.lit("date").alias("family"))
    rule = spark.range(len(ALPHABET)).select(F.inline(F.array(*[F.struct(
        F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)), F.lit(n)).alias("token"),
        F.lit("rule").alias("family")) for n in (16, 20, 30, 40, 60, 72, 80, 120)])))
    return number.unionByName(date).unionByName(rule).select("token", F.lit(False).alias("random"), "family")


def _names(words: Column) -> Column:
    """Every three words in a row as a name or path of one of nine shapes."""
    def shape(i: Column) -> Column:
        a, b, c = (F.element_at(words, i + k) for k in range(3))
        year = (F.lit(1990) + F.pmod(F.xxhash64(a, b), F.lit(50))).cast("string")
        month = F.lpad((F.pmod(F.xxhash64(b, c), F.lit(12)) + 1).cast("string"), 2, "0")
        count = F.pmod(F.xxhash64(c, a), F.lit(1_000)).cast("string")
        return _pick([F.concat_ws("-", a, b, c), F.concat_ws("_", a, b, c), F.concat_ws("/", a, b, c), F.concat(a, b, c),
                      F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.concat_ws("/", a, year, month, F.concat_ws("-", b, c)),
                      F.concat_ws("_", a, b, count), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", year, month, a, b)], a, b, c)
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2, F.lit(3)), shape))


def labelled_samples(docs: DataFrame, identifiers_from: int = 2_000, drawn: int = 1_000) -> DataFrame:
    """(token, random, family), every sample once.

    Random: values of base spans in all documents, and ``drawn`` strings of each alphabet. Ordinary:
    words of 8 letters or more, and names made of words, of at most ``identifiers_from`` documents in
    hash order, those that hold no base span; numbers, dates and rules.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = once(rows, **{kind: matches(F.col("text"), kind, pattern) for kind, pattern, *_ in BASE})
    values = []
    for kind, pattern, group, least in BASE:
        value = F.when(F.size(kind) > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col(kind)
        values.append(F.filter(F.coalesce(value, F.array().cast("array<string>")), _at_least(least)))
    secret = found.select(F.explode(F.concat(*values)).alias("token"), F.lit(True).alias("random"), F.lit("document").alias("family"))
    clean = ~F.regexp_like("text", F.lit(BASE[0][1])) & ~F.regexp_like("text", F.lit(BASE[1][1]))
    chosen = rows.select("doc_id").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(identifiers_from)
    texts = rows.join(F.broadcast(chosen), "doc_id").filter(clean)
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]{8,}"), F.lit(0))).alias("token"),
                         F.lit(False).alias("random"), F.lit("word").alias("family"))
    lower = once(texts.select("text"), words=F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{2,20}\b"), F.lit(0)))
    names = lower.select(F.explode(_names(F.col("words"))).alias("token"), F.lit(False).alias("random"), F.lit("name").alias("family"))
    return (secret.unionByName(words).unionByName(names).distinct()
            .unionByName(drawn_strings(spark, drawn)).unionByName(plain_strings(spark, drawn)))


class Model(NamedTuple):
    ratios: dict[str, float]
    least_ratio: float
    false_alarms: float  #: share of held-out ordinary samples at or above the threshold, mean over families
    misses: float  #: share of held-out random samples below it, mean over families


def trained(samples: DataFrame, alarm_cost: float = 10.0) -> Model:
    """Ratios counted from four fifths of the samples, and the threshold that the others choose.

    Samples are split by a hash of the token. Of the thresholds from -1 to 1.5 the one with the least
    ``alarm_cost`` * false alarms + misses is taken, the middle one of several; held-out samples too short to
    be a candidate have no part. Without held-out samples of both labels it is 0.5 and both rates are NaN.
    """
    rows = cut(samples.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0))
    ratios = log_ratios(transition_counts(rows.filter("not held")))
    steps = [round(-1 + 0.05 * i, 2) for i in range(51)]
    candidates = rows.filter(F.col("held") & F.regexp_like("token", F.lit(f"^[A-Za-z0-9+/_=-]{{{LEAST},}}$")))
    scored = once(candidates.select("random", "family", "token"), ratio=mean_log_ratio(F.col("token"), ratios))
    above = (scored.groupBy("random", "family").agg(*[F.avg((F.col("ratio") >= t).cast("int")).alias(str(i)) for i, t in enumerate(steps)])
             .groupBy("random").agg(*[F.avg(str(i)).alias(str(i)) for i in range(len(steps))]).collect())  # two rows at most
    rates = {r["random"]: [r[str(i)] for i in range(len(steps))] for r in above}
    if len(rates) < 2:
        return Model(ratios, 0.5, math.nan, math.nan)
    costs = [alarm_cost * alarm + 1 - hit for alarm, hit in zip(rates[False], rates[True])]
    best = [i for i, cost in enumerate(costs) if cost == min(costs)]
    i = best[len(best) // 2]
    return Model(ratios, steps[i], rates[False][i], 1 - rates[True][i])


def scan(docs: DataFrame, ratios: dict[str, float], least_ratio: float = 0.5) -> DataFrame:
    """One row per document: doc_id, base (spans), added (spans).

    Spans are array<struct<start, place, kind, end>>, code points, end exclusive. Added ones do
    not overlap base ones. A null text is empty and has none. Whole texts are scanned; repeated
    rows are scanned each; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_spans(rows, {kind: (pattern, group, least) for kind, pattern, group, least in BASE}
                      | {"candidate": (CANDIDATE, 0, 0)})
    rows = once(rows, base=F.array_sort(F.concat(*[named(F.col(kind), i, kind) for i, (kind, *_) in enumerate(BASE)])))
    rows = once(rows, free=F.filter("candidate", lambda s: ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    token = lambda s: F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    added = F.filter("free", lambda s: mean_log_ratio(token(s), ratios) >= least_ratio)
    return once(rows, added=named(added, len(BASE), "random")).select("doc_id", "base", "added")
