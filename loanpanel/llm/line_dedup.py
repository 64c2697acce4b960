"""Line deduplication by a deletion-neighbourhood join.

Lines are compared by their words (ASCII case and white space aside). A line goes when an
earlier line (by doc_id, then line number) is equal or, for lines of at least ``min_words``
words, when one edit turns it into the earlier one: a word inserted, deleted or replaced.
A line's variants are itself and itself without each of its words; two lines within one edit
have an equal variant. Variants are hashed keys; of the lines with an equal key and the same
word left out, all but the earliest go, and so do lines that one more word turns into an earlier
line, or the other way round. The partner found is verified word by word.

Only lines that may have a partner emit variants: an edit leaves the first or the last words of a
line alone, so a line that shares neither end with another has none. Everything is DataFrame
functions; keys are pre-aggregated, so a line or a variant of very many lines is no hot group.
Tables of suspects are sent to the executors up to a number of bytes; beyond, they are joined by
shuffle. A document is known by its id and a digest of its text, so that documents which share an
id, or have none, keep their lines apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.storage import cut, sent_if_small, shared_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER_BLANKS = "\t\x0b\x0c\r"
DOCUMENT = ["doc_id", "text1", "text2"]  # the digest in two halves
PLACE = [*DOCUMENT, "line_no"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text1, text2, text."""
    return docs.select("doc_id", *[F.xxhash64(F.lit(i), "text").alias(f"text{i}") for i in (1, 2)], "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """The document, line_no (from 0), line of every line with a word, for documents of :func:`keyed`.

    The words of ``line`` are parted by single blanks and have A-Z as a-z. Null text has no lines.
    """
    folded = F.translate("text", UPPER + OTHER_BLANKS, UPPER.lower() + " " * len(OTHER_BLANKS))
    lines = docs.select(*DOCUMENT, F.posexplode(F.split(folded, "\n", -1)).alias("line_no", "line")).filter(F.trim("line") != "")
    single = F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", "  +", " ")).otherwise(F.col("line"))
    return lines.select(*PLACE, F.trim(single).alias("line"))


def _end_length(n: Column) -> Column:
    """Words of either end that make a key for a line of n words: at most (n - 1) / 2.

    Steps of a quarter, so that lines of nearly the same length agree on it.
    """
    step = F.floor(F.log((n - 1) / 2) / F.log(F.lit(1.25)) + 1e-9)
    return F.floor(F.pow(F.lit(1.25), step) + 1e-9).cast("int")


def _ends(line: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share at least one.

    The first and the last words in the number for n; where it differs for n - 1, also in that
    one, as the longer line of an insertion. One edit cannot change both ends.
    """
    def pair(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit("front"), m, F.call_function("substring_index", line, F.lit(" "), m)),
                F.xxhash64(F.lit("back"), m, F.call_function("substring_index", line, F.lit(" "), -m))]

    own, shorter = _end_length(n), _end_length(n - 1)
    return F.when(own == shorter, F.array(*pair(own))).otherwise(F.array(*pair(own), *pair(shorter)))


def line_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """The place, x, y (128 bits of the words), ends (null for lines below ``min_words``)."""
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    rows = lines_of(docs).withColumn("n", (blanks + 1).cast("int"))
    return rows.select(*PLACE, F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"),
                       F.when(F.col("n") >= min_words, _ends(F.col("line"), F.col("n"))).alias("ends"))


def suspects_of(keys: DataFrame) -> DataFrame:
    """x of the lines that share an end with another line."""
    ends = keys.filter("ends is not null").select("x", F.explode("ends").alias("shared"))
    shared = (ends.groupBy("shared").agg(F.min("x").alias("low"), F.max("x").alias("high"))
              .filter("low <> high").select("shared"))
    return ends.join(sent_if_small(shared), "shared", "left_semi").select("x").distinct()


def variants_of(lines: DataFrame) -> DataFrame:
    """x, y, first, vx, vy, left_out: the whole line (0), then without its i-th word.

    A key is the exclusive or of the hashes of the words with their places, so all keys of a line
    come from running sums over its words, in time linear in its length.
    """
    words = lines.select("x", "y", "first", F.posexplode("words").alias("j", "word"))
    line = Window.partitionBy("x", "y", "first")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys, whole = [], []
    for name, seed in (("vx", 0), ("vy", 1)):
        here, moved = F.xxhash64(F.lit(seed), "word", "j"), F.xxhash64(F.lit(seed), "word", F.col("j") - 1)
        words = words.withColumn(f"{name}_here", here).withColumn(f"{name}_moved", moved)
        before = F.bit_xor(f"{name}_here").over(upto).bitwiseXOR(F.col(f"{name}_here"))
        after = F.bit_xor(f"{name}_moved").over(line).bitwiseXOR(F.bit_xor(f"{name}_moved").over(upto))
        keys.append(before.bitwiseXOR(after).alias(name))
        whole.append(F.bit_xor(f"{name}_here").over(line).alias(name))
    without = F.struct(*keys, (F.col("j") + 1).alias("left_out"))
    entire = F.when(F.col("j") == 0, F.struct(*whole, F.lit(0).alias("left_out")))
    rows = words.select("x", "y", "first", F.array(without, entire).alias("v"))
    return rows.select("x", "y", "first", F.explode("v").alias("v")).filter("v is not null").select(
        "x", "y", "first", "v.vx", "v.vy", "v.left_out")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced word turns the words ``a`` into ``b``, or none."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at(a, i) != F.element_at(b, i))
    first = F.array_position(differ, True).cast("int")  # 0: none differs
    tail = lambda x, at: F.slice(x, at, F.size(x))
    return (F.when(F.abs(F.size(a) - F.size(b)) > 1, F.lit(False)).when(first == 0, F.lit(True))
            .when(F.size(a) == F.size(b), tail(a, first + 1) == tail(b, first + 1))
            .when(F.size(a) > F.size(b), tail(a, first + 1) == tail(b, first))
            .otherwise(tail(a, first) == tail(b, first + 1)))


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(x, y, first, partner) of those ``lines`` with an earlier one within one edit: verified places.

    ``docs`` as of :func:`keyed`; ``lines`` has x, y and first, the earliest place of a line.
    """
    texts = lines_of(docs).select(F.struct(*PLACE).alias("first"), "line")
    # a place names one line; repeated rows of a document repeat it
    same = F.col("t.first").eqNullSafe(F.col("l.first"))
    found = texts.alias("t").join(sent_if_small(lines).alias("l"), same).select("l.*", F.split("line", " ").alias("words"))
    lines = cut(found.dropDuplicates(["x", "y"]))
    variants = variants_of(lines.repartition("x", "y"))
    # most variants are of a single line and have no partner
    shared = (variants.groupBy("vx").agg(F.min("x").alias("low"), F.max("x").alias("high"))
              .filter("low <> high").select("vx"))
    variants = cut(variants.join(sent_if_small(shared), "vx", "left_semi"))
    by_place = variants.groupBy("vx", "vy", "left_out").agg(F.min("first").alias("earliest"))
    by_key = by_place.groupBy("vx", "vy").agg(
        F.min(F.when(F.col("left_out") == 0, F.col("earliest"))).alias("whole"),
        F.min(F.when(F.col("left_out") > 0, F.col("earliest"))).alias("longer"))
    known = by_place.join(by_key, ["vx", "vy"]).select(
        "vx", "vy", "left_out", F.when(F.col("left_out") == 0, F.col("longer"))
        .otherwise(F.least("earliest", "whole")).alias("partner"))
    partners = (variants.join(known, ["vx", "vy", "left_out"]).filter("partner < first")
                .groupBy("x", "y", "first").agg(F.min("partner").alias("partner")))
    mine = lines.select("x", "y", "words")
    theirs = lines.select(F.col("first").alias("partner"), F.col("words").alias("other"))
    return (partners.join(mine, ["x", "y"]).join(theirs, "partner")
            .filter(within_one_edit(F.col("words"), F.col("other"))).select("x", "y", "first", "partner"))


def removed_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, text1, text2, line_no, near (boolean): the lines that go, equal copies and near ones.

    Earlier means by doc_id, null first, then by the text's digest, then by line number.
    """
    docs = keyed(docs)
    keys = shared_table(line_keys(docs, min_words), "lines")
    suspects = suspects_of(keys).withColumn("suspect", F.lit(True))
    distinct = keys.groupBy("x", "y").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"))
    lines = cut(distinct.join(sent_if_small(suspects), "x", "left").filter("copies > 1 or suspect"))
    near = near_lines(docs, lines.filter("suspect").select("x", "y", "first")).select("x", "y", F.lit(True).alias("near"))
    repeated = lines.join(near, ["x", "y"], "left").filter("copies > 1 or near").select("x", "y", "first", "near")
    rows = keys.select(*PLACE, "x", "y").join(sent_if_small(repeated), ["x", "y"])
    is_first = F.struct(*PLACE).eqNullSafe(F.col("first"))
    return rows.filter(F.col("near") | ~is_first).select(*PLACE, (F.coalesce("near", F.lit(False)) & is_first).alias("near"))


def without(lines: Column, gone: Column) -> Column:
    """The array ``lines`` without the elements at the places ``gone`` (ascending, from 0), in linear time.

    What stays are the runs between two places that go.
    """
    def runs(x: Column) -> Column:  # x holds both arrays, so neither is formed again for every run
        starts = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda g: g + 1))
        ends = F.concat(x["gone"], F.array(F.size(x["lines"])))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(x["lines"], a + 1, b - a)))

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), runs), F.lit(0))


def _cleared(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns of ``docs``), left (the text that stays), exact and near (numbers of lines that go)."""
    gone = (removed_lines(docs, min_words).groupBy(*DOCUMENT)
            .agg(F.sort_array(F.collect_set("line_no")).alias("gone"), F.count_if(~F.col("near")).alias("exact"),
                 F.count_if("near").alias("near")))  # at most a document's lines
    columns = [F.xxhash64(F.lit(i), "text").alias(f"text{i}") for i in (1, 2)]
    rows = docs.select("doc_id", *columns, F.col("text").alias("whole"), F.struct("*").alias("row")).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in DOCUMENT]
    rows = rows.join(sent_if_small(gone).alias("g"), same, "left")
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(without(F.split("whole", "\n", -1), F.col("gone")), "\n"))
    none = F.lit(0).cast("long")
    return rows.select("row", text.alias("left"), F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with removed_exact and removed_near (long), the text without the lines that go.

    Blank lines stay. A null text stays null. Documents that share a doc_id, or have none, are told
    apart by their texts; rows equal in both are one document, so the same lines go from each.
    Texts count whole; other columns pass, but for those named like the two new ones. An empty table
    gives no rows.
    """
    new = ["removed_exact", "removed_near"]
    columns = [F.col("left").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns if c not in new]
    return _cleared(docs, min_words).select(*columns, F.col("exact").alias(new[0]), F.col("near").alias(new[1]))


def documents_left(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with the lines that stay, without the documents that lost their last word.

    ``n_chars``, where there is such a column, is counted anew for changed texts.
    """
    changed = F.col("exact") + F.col("near") > 0
    rows = _cleared(docs, min_words).filter(~changed | F.regexp_like("left", F.lit(r"[^\x20\x09-\x0D]")))
    own = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        count = F.when(changed, F.length("left")).otherwise(F.col("row.n_chars"))
        own["n_chars"] = count.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])
