"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.llm import (
    bpe,
    divergence,
    embedding_dedup,
    language_id,
    line_dedup,
    minhash_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    token_shards,
    url_filter,
)
from loanpanel.llm.storage import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_FITS = "(p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)"


@query("op10_url_filter", f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                              THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id
                ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS nth FROM p JOIN rules r ON {_FITS})
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON p.page_id = f.page_id AND f.nth = 1""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


# the water level as in mixing.source_targets, running sums in one window per source
@query("op6_mixing", r"""
WITH d AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           ('0x' || substr(md5(concat_ws(':', '42', doc_id::varchar, text)), 1, 15))::bigint AS u FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size,
      row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([5e0, 2e0, 1e0])[1 + place % 3] AS weight, ([-6e-1, 0e0, 6e-1])[1 + place % 3] AS ramp,
      2e0 * source_size AS cap FROM s),
c AS (SELECT *, (1.5e0 * sum(source_size) OVER () - (sum(cap) OVER before - cap))
             / (sum(weight) OVER () - sum(weight) OVER before + weight) AS level FROM w
      WINDOW before AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min(level) FILTER (level <= cap / weight) AS none,
             arg_min(level, cap / weight) FILTER (level <= cap / weight) AS level FROM c),
t AS (SELECT c.source, c.place, source_size, ramp, least(cap, coalesce(weight * l.level, cap)) AS target FROM c, l),
r AS (SELECT d.*, source_size, target, ramp, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
      sum(size) OVER (PARTITION BY place ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (whole + (start + size / 2e0 < target - whole * source_size)::int)::int AS copies FROM r),
p AS (SELECT *, (start + size / 2e0) / nullif(target, 0) AS done1,
             (source_size + start + size / 2e0) / nullif(target, 0) AS done2 FROM k),
q AS (SELECT *, least(coalesce(done1, 0), 1) AS x1, least(coalesce(done2, 0), 1) AS x2 FROM p)
SELECT doc_id, size::bigint AS size, source_size, round(target, 6) AS target, (copies * size)::bigint AS taken, copies,
 CASE WHEN copies >= 1 THEN round(CASE WHEN ramp = 0 THEN x1 ELSE 2 * x1 / ((1 - ramp)
      + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * x1)) END, 9) END AS position,
 CASE WHEN copies >= 2 THEN round(CASE WHEN ramp = 0 THEN x2 ELSE 2 * x2 / ((1 - ramp)
      + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * x2)) END, 9) END AS second_position FROM q""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    first, second = (F.round(F.get("positions", F.lit(i)), 9) for i in (0, 1))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies",
                        first.alias("position"), second.alias("second_position"))


@query("op3_token_shards")
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards' bytes, as blocks of records; ``write_shards`` appends the same blocks to files."""
    return token_shards.token_shards(read(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [list_aggregate(words, 'string_agg', ' ')]
      ELSE list_distinct([list_aggregate(words[i:i + 3], 'string_agg', ' ')
           for i in range(1, len(words) - 2)]) END AS own FROM w)"""


@query("op9_minhash_dedup", f"""
WITH RECURSIVE {_SHINGLES},
x AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM s UNION
          SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.to_id = l.a)
SELECT s.doc_id, any_value(len(own))::bigint AS n_shingles, min(to_id) AS component_id,
       s.doc_id = min(to_id) AS kept FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id""")
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4)


@query("op1_embedding_dedup", """
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::double[] AS v, label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.usable AND b.usable
      AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, to_id) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON r.to_id = l.a),
c AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::bigint AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id""")
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "token_entropy")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = secret_scan.trained(secret_scan.labelled_samples(docs))
    found = secret_scan.scan(docs, model.ratios, model.least_ratio)
    count = [F.size(secret_scan.of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}")
             for kind, *_ in secret_scan.BASE]
    return found.select("doc_id", *count, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


_NEAR_LINES = r"""
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM
      (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, line_no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM l),
d AS (SELECT words, min((doc_id, line_no)) AS first FROM k WHERE len(words) > 0 GROUP BY words),
v AS (SELECT words, first, i, CASE WHEN i = 0 THEN words ELSE list_concat(words[:i - 1], words[i + 1:]) END AS rest
      FROM (SELECT words, first, unnest(range(0, len(words) + 1)) AS i FROM d WHERE len(words) >= 8)),
near AS (SELECT DISTINCT a.words FROM v a JOIN v b ON a.rest = b.rest AND b.first < a.first
         AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
g AS (SELECT k.doc_id, k.line_no, (k.doc_id, k.line_no) = d.first AS is_first, n.words IS NOT NULL AS near
      FROM k JOIN d ON k.words = d.words LEFT JOIN near n ON k.words = n.words)"""


@query("op4_line_dedup", f"""
WITH {_NEAR_LINES},
s AS (SELECT doc_id, count(*) FILTER (NOT is_first) AS removed_exact, count(*) FILTER (is_first) AS removed_near,
      list(line_no) AS gone FROM g WHERE near OR NOT is_first GROUP BY doc_id)
SELECT d.doc_id, coalesce(removed_exact, 0)::bigint AS removed_exact, coalesce(removed_near, 0)::bigint AS removed_near,
 md5(CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(string_split(d.text,
     chr(10)))), lambda i: NOT list_contains(gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END) AS text_md5
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "removed_exact", "removed_near", F.md5("text").alias("text_md5"))


# counts of kept terms for every source of the language, 0 where it has none
_SHARES = r"""
d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gr AS (SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v FROM d LEFT JOIN size ON d.lang = size.lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, g.v, coalesce(o.n, 0) AS n, sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
      sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang) AS lang_total
      FROM gr g JOIN kept k ON g.lang = k.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT lang, source, term, n, (1 + 1000000000 * (n + 1)::hugeint // (total + v))::bigint AS p,
      (1 + 1000000000 * (lang_n + 1)::hugeint // (lang_total + v))::bigint AS q FROM c)"""


@query("op11_divergence", f"""
WITH {_SHARES},
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
           FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value FROM gr a JOIN gr b
      ON a.lang = b.lang AND a.source <> b.source LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


# crc32 bit by bit; paths are lists of turn digests, and a subtree is the nodes whose path goes on
@query("op13_prefix_trie", r"""
WITH c AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS k, turn,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM c),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)) AS bytes
      FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: x::bigint)),
      lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) % 4 AS h FROM n),
b AS (SELECT h.conv_id, h.h, count(t.pos) AS taken FROM h LEFT JOIN t ON t.conv_id = h.base AND t.pos <= h.h GROUP BY ALL),
rows_ AS (SELECT b.conv_id, t.pos, t.k, t.words FROM b JOIN h USING (conv_id) JOIN t ON t.conv_id = h.base AND t.pos <= b.h
      UNION ALL SELECT t.conv_id, t.pos - b.h + b.taken, t.k, t.words FROM t JOIN b ON t.conv_id = b.conv_id AND t.pos > b.h
      UNION ALL SELECT conv_id, 0, '', 0 FROM b),
p AS (SELECT conv_id, pos, words, list(k) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path,
      pos = max(pos) OVER (PARTITION BY conv_id) AS is_end FROM rows_),
node AS (SELECT path, any_value(pos) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n,
      coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends FROM p GROUP BY path),
kids AS (SELECT path[:len(path) - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
f AS (SELECT a.*, coalesce(k.n, 0) AS kids, u.conv_id AS up FROM node a LEFT JOIN kids k ON a.path = k.path
      LEFT JOIN node u ON u.path = a.path[:len(a.path) - 1] AND a.depth > 0)
SELECT a.conv_id, a.depth::bigint AS depth, any_value(a.up) AS parent_conv_id, any_value(a.n)::bigint AS n_convs, any_value(a.kids)::bigint AS n_children,
 count(*) FILTER (d.kids = 0)::bigint AS n_leaves, sum((d.n - 1) * d.words)::bigint AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM f a JOIN f d ON d.path[:len(a.path)] = a.path AND d.depth >= a.depth GROUP BY a.conv_id, a.depth""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
