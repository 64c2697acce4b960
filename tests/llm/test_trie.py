"""Conversation prefixes, byte-pair encoding and source divergence against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanpanel.llm import bpe, divergence, prefix_trie
from tests.llm.common import WORD, corpus, words


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            by_conv[conv].append((turn is not None, turn or 0, key, len(WORD.findall(text))))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in by_conv.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        paths[c] = tuple(base[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * (p[-1][1] if p else 0)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


def conversations(seed=4, n=130):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.randint(0, 6))) for _ in range(5)]
    rows = []
    for c in list(range(n)) + [-7, -20, -41, 1007, 10**12 + 5]:
        if c % 17 == 3 or c in (40, 60):  # families without their first conversation
            continue
        for turn in range(1 if c % 20 == 0 and c % 3 == 0 else rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(pool)))
    hot = [(c, turn, "user", f"hot {turn}") for c in range(300, 380) for turn in range(7)]
    odd = [(2, None, "user", None), (2, None, "user", ""), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 1, "user", "x"), (22, -3, None, "y")]
    return rows + hot + odd


def got_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("n", F.lit(0))
    out = prefix_trie.prefix_trie(df.repartition(5)).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out)


def test_trie(spark):
    rows = conversations()
    assert got_trie(spark, rows) == brute_trie(rows)
    assert got_trie(spark, []) == []


def test_trie_in_small_tiles(spark, monkeypatch):
    """Many shards, segments and ranges; a long conversation with copies, one that holds a third of all turns."""
    for name, value in (("RANGE_ROWS", 150), ("SEGMENT", 4), ("MEMBERS", 16)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(8)
    long = [(turn, "user", " ".join(words(rng, 3))) for turn in range(60)]
    rows = conversations() + [(c, *t) for c in (500, 520, 540) for t in long] + [(c, *t) for c in (560, 580) for t in long[:33]]
    rows += [(600, turn, "user", f"own {turn}") for turn in range(700)]
    assert got_trie(spark, rows) == brute_trie(rows)


def texts():
    rng = random.Random(3)
    some = [r[1] for r in corpus()] + ["<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|", "a" * 3000, "ab" * 2000, "İx İ's ΑΣ ß",
            "é 각 漢字 हिन्दी ไทย \U0001f469‍\U0001f467", "x's I'LL 12½² __ --", "\u0085   \x1c\x1f",
            "".join(map(chr, range(1, 0x250)))]
    pools = [range(1, 128), range(1, 0x250), range(1, 0x2fff), [*range(0x1f300, 0x1f6ff), 32]]
    some += ["".join(chr(rng.choice(pool)) for _ in range(rng.choice([3, 30]))) for pool in pools for _ in range(100)]
    return some + ["".join(rng.choice("aeinrst'") for _ in range(200)) for _ in range(30)]


def test_encoding_is_the_librarys(spark):
    some = texts()
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = bpe.encode_texts(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == dict(enumerate(want))
    decoded = [library.decode(i, skip_special_tokens=False) for i in want]
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded).collect()} == dict(enumerate(decoded))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs).collect()} == {
        i: (len(ids), digest(" ".join(map(str, ids))), digest(t)) for i, (ids, t) in enumerate(zip(want, decoded))}
    assert bpe.round_trip(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (1, "a b")], "doc_id int, text string")
    assert sorted(r["n_tokens"] for r in bpe.round_trip(repeated).collect()) == [0, 2, 2, 2]


def test_words_are_forgotten_beyond_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    codec = bpe.Codec()
    for text in ("one two three four five", "six seven eight nine ten eleven", "one " * 5 + " ".join(words(random.Random(1), 40))):
        assert codec.encode([text])[0] == codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(codec.seen) <= 45
    assert codec.decode([5, 10**6, -1, 49407]) == codec.pieces[5] + " <|endoftext|>"


def brute_divergence(rows, min_docs=3, top=200):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in low).split(" ")

    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = [t for t in terms(text) if t]
        docs[lang or ""].update(set(own))
        counts[lang or "", source or ""].update(own)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            telling = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(telling)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(6)
    common = words(rng, 60)
    rows = []
    for i in range(150):
        some = [w.upper() if rng.random() < 0.2 else w for w in rng.choices(common, k=rng.randint(0, 80))]
        rows.append((i, " ".join(some) + ("\x00é,ß;漢字" if i % 3 else ""), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None, "ü"])))
    return rows + [(1, None, "xx", "a"), (1, "", "xx", "b"), (2, "same", "yy", "a"), (2, "same", "yy", "a"), (None, "same", "yy", "b"), (3, "1 2 --", "en", "no terms")]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_TERMS": 7, "COLUMNS": 5, "PENDING": 40}])
def test_divergence(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("clash"))
    for top in (200, 4):
        got = divergence.audit(docs.repartition(3), top_terms=top).collect()
        assert sorted(map(tuple, got)) == brute_divergence(rows, top=top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_and_prices_are_exact(spark):
    big = 10**13
    row = spark.range(1).select(
        divergence.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(1).cast("long")).alias("all"),
        divergence.price(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("top")).first()
    assert tuple(row) == (1 + 10**9 * (big + 1) // (3 * big + 7), 1 + 10**9, 10**18)
