"""Near-duplicate documents, embeddings and lines against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanpanel.llm import embedding_dedup, line_dedup, minhash_dedup
from loanpanel.llm.components import connected_components
from tests.llm.common import SCHEMA, WORD, corpus, reachable, words


def shingles(text, k):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(own)} if 0 < len(own) < k else {tuple(own[i:i + k]) for i in range(len(own) - k + 1)}


def near_documents(rows, k, threshold=0.8):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in reachable(ids, links).items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_documents(spark, k):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("kept", F.lit(0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs, words=k).collect()}
    assert got == near_documents([r[:2] for r in rows], k)
    left = minhash_dedup.one_of_each(docs, words=k)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_near_documents_in_large_groups(spark):
    """Nodes over the limit, chains of near copies, and a group of copies with a third of all rows."""
    rng = random.Random(5)
    base = words(rng, 60)
    texts = [" ".join(base)] * 40
    chain = list(base)
    for i in range(60):  # neighbours are similar, the ends are not
        chain = list(chain)
        chain[(i * 7) % 60] = words(rng, 1)[0]
        texts.append(" ".join(chain))
    texts += [" ".join(words(rng, 50)) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in minhash_dedup.near_duplicates(docs, words=2, limit=8, levels=2, recall=0.9999).collect()}
    assert got == near_documents(rows, 2)


def test_repeated_ids_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (None, "q r s")],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (1, 1), (2, 1)]
    # (1, x ...) and (2, x ...) are copies; the document without an id is one of its own
    assert sorted((r["doc_id"] or -1, r["text"]) for r in minhash_dedup.one_of_each(docs).collect()) == [
        (-1, "q r s"), (1, "a b c d e f"), (1, "x y z u v w")]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_no_text_is_lost_with_null_or_repeated_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, 30)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (2, texts[3]), (2, texts[3] + " more"),
            (3, texts[4]), (None, texts[4]), (4, None), (4, ""), (None, None), (5, texts[5] + " tail")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, number int")
    left = minhash_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    near = [t for t in kept if t[1] in (texts[3], texts[3] + " more")]
    assert len(near) == 1 and near[0][0] == 2
    assert sorted(map(str, set(kept) - set(near))) == sorted(map(str, [
        (None, texts[0]), (None, texts[1]), (2, texts[2]), (3, texts[4]), (4, None), (4, ""), (None, None), (5, texts[5] + " tail")]))
    assert len(kept) == len(set(kept))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 300), (300, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 500: 300}


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(500):
        base = rng.normal(size=8)
        rows += [base, base + rng.normal(size=8) * 0.12]
    hot = rng.normal(size=8)
    rows += [hot + rng.normal(size=8) * 0.1 for _ in range(400)] + [hot] * 30
    table = [(i, [float(x) for x in v], i % 3 if i < 1000 else 1) for i, v in enumerate(rows)]
    table += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [math.nan] + [1.0] * 7, 1), (5003, [math.inf] + [1.0] * 7, 1),
              (5004, [None] + [1.0] * 7, 1), (5005, [], 1), (5006, [1.0] * 8, None), (5007, [1.0] * 8, None),
              (5008, [1.0] * 4, 1), (5009, [2.0] * 4, 1), (5010, [1e-200] * 8, 2), (5011, [1e200] * 8, 2)]
    return table


def near_vectors(table, threshold):
    usable = {i: (np.array(v, float) / max(map(abs, v)), label) for i, v, label in table
              if v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    unit = {i: (v / np.sqrt(v @ v), label) for i, (v, label) in usable.items()}
    ids = sorted(unit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= threshold]
    count = {i: 0 for i, *_ in table}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = reachable([i for i, *_ in table], links)
    return {i: (count[i], label[i]) for i in count}


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_near_vectors(spark, shard_rows):
    table = vectors()
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in embedding_dedup.near_duplicates(df, 0.93, shard_rows=shard_rows).collect()}
    want = near_vectors(table, 0.93)
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * all_links
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(got[i] == (0, i) for i in range(5000, 5008))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(300, 16)), 6, 0) + rng.normal(size=(1800, 16)) * 0.1
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    graph = embedding_dedup.SmallWorld(x)
    found, audits = embedding_dedup.search(graph, x, x, 0.9, 16, 0.95)
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    assert not (found & ~true)[~np.eye(len(x), dtype=bool)].any()
    assert (found & true).sum() >= 0.95 * true.sum() and audits[-1][1] >= 0.95


def near_line_rules(rows, least):
    """Lines that go: (doc_id, line number) -> whether it goes as a near line."""
    places, first = {}, {}
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            own = tuple(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(line))
            if own:
                places[i, k] = own
                first.setdefault(own, (i, k))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    near = {own for own, at in first.items() if len(own) >= least and any(
        len(o) >= least and p < at and abs(len(o) - len(own)) <= 1 and edits(own, o) <= 1 for o, p in first.items())}
    return {at: first[own] == at for at, own in places.items() if own in near or first[own] != at}


def test_lines_of_documents_with_null_or_repeated_ids(spark):
    shared = "a line that both documents share in full here"
    rows = [(2, f"{shared}\nunique tail alpha"), (2, f"unique head beta\nunique tail gamma\n{shared}"),
            (None, f"{shared}\nonly here"), (None, f"first\n{shared}\nsecond"), (None, f"first\n{shared}\nsecond")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).collect()
    lines = [line for r in out for line in r["text"].split("\n")]
    assert sum(r["removed_exact"] for r in out) == 3 + 1 - lines.count(shared) + 1  # rows equal in id and text are one document
    for once in ("unique tail alpha", "unique head beta", "unique tail gamma", "only here"):
        assert lines.count(once) == 1
    assert lines.count("first") == lines.count("second") == 2
    assert lines.count(shared) in (1, 2)
    null_first = [r["text"] for r in out if r["doc_id"] == 2]
    assert all(shared not in t for t in null_first)


def test_a_text_of_very_many_equal_lines(spark):
    n = 200_000
    rows = [(1, "\n".join(["same again"] * n + ["last"])), (2, "\n".join(f"line {i}" if i % 2 else "same again" for i in range(2_001)))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == "same again\nlast" and got[1]["removed_exact"] == n - 1
    assert got[2]["text"] == "\n".join(f"line {i}" for i in range(1, 2_001, 2)) and got[2]["removed_exact"] == 1_001


def test_lines(spark):
    rng = random.Random(2)
    rows = [r[:2] for r in corpus()]
    long = words(rng, 30)
    for cut in range(12):  # variants of one line: a word less, more, other, twice the same word
        line = list(long)
        if cut % 3 == 0:
            line.pop(cut)
        elif cut % 3 == 1:
            line.insert(cut, "extra")
        else:
            line[cut] = line[cut + 1]
        rows.append((100 + cut, "\n".join([" ".join(line), "  ", " ".join(words(rng, 8)), "Short line"])))
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, near int, gone string")
    want = near_line_rules(rows, 8)
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.removed_lines(docs).collect()}
    assert got == want and any(want.values())
    assert spark.range(1).select(line_dedup.without(F.array(*map(F.lit, "abcde")), F.array(F.lit(0), F.lit(2), F.lit(4)))).first()[0] == ["b", "d"]
    for r in line_dedup.dedup_lines(docs).collect():
        text = dict(rows)[r["doc_id"]]
        stay = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (r["doc_id"], k) not in want)
        assert r["text"] == stay and r["near"] == 5 and r["gone"] == "x"
        assert r["removed_near"] == sum(v for (i, _), v in want.items() if i == r["doc_id"])
    left = line_dedup.documents_left(docs)
    assert left.columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_one_edit(spark):
    rows = [("a b c", "a b c", True), ("a b c", "a b", True), ("a b", "x a b", True), ("a b c", "a x c", True),
            ("a b c", "a c b", False), ("a b c d", "a b", False), ("a a b", "a b", True), ("a", "b", True), ("a b", "b c", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    for r in df.withColumn("got", line_dedup.within_one_edit(F.split("a", " "), F.split("b", " "))).collect():
        assert r["got"] == r["want"], r
