"""Mixing, packing, token shards and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loanpanel.llm import mixing, packing, token_shards, tokens
from tests.llm.common import SCHEMA, WORD, corpus, words


def targets(sizes, weights, share, most):
    """Cut what is above the cap and share it out again until none is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return got | {s: left * weight[s] / total for s in free}
        for s in over:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in over)
        free -= over
    return got


def mixed_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "é", "Z", "z", None, ""])) for i in range(400)]
    return rows + [(500, None, "a"), (501, "", "only empty"), (1, rows[1][1], rows[1][2]), (502, " ".join(words(rng, 900)), "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mixed_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("u", F.lit(0))
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (*_, s) in zip(size, rows):
        total[s] += n
    want = targets(dict(total), (5, 2, 1), 1.5, 2)
    got = mixing.mix(docs, rows_per_slice=16).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for n, (i, *_) in zip(size, rows))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == total[r["source"]]
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(docs.repartition(7), rows_per_slice=1000).collect()
    key = lambda rs: sorted((r["doc_id"], r["copies"], tuple(np.round(r["positions"], 9))) for r in rs)
    assert key(got) == key(again)
    out = mixing.mixed_documents(docs, rows_per_slice=16)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in got:
        count[r["doc_id"]] += r["copies"]
    listed = [r["doc_id"] for r in out.collect()]
    assert sorted(listed) == sorted(i for i, n in count.items() for _ in range(n))
    order = [r["doc_id"] for r in mixing.in_training_order(mixing.mix(docs)).collect()]
    assert sorted(order) == sorted(listed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_curriculum_inverts_the_demand(spark):
    """Of a source whose weight rises, the first half of the words takes more than half of the run."""
    df = spark.range(1).select(*[mixing.training_position(F.lit(x), F.lit(r)).alias(f"x{i}") for i, (x, r) in enumerate(
        [(0.5, 0.0), (0.5, 0.6), (0.5, -0.6), (0.0, 0.6), (1.0, -0.6)])]).first()
    assert df[0] == 0.5 and df[1] > 0.5 > df[2] and df[3] == 0 and df[4] == pytest.approx(1)
    for x, ramp in ((df[1], 0.6), (df[2], -0.6)):
        assert (1 - ramp) * x + ramp * x * x == pytest.approx(0.5)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", "a", "Hello  world", "a   b", " lead", "trail ", "tab\t x\n\ny \n  z", "<|endoftext|> in text", "naïve café 漢字 😀  🎉", "\u00a0 x\u00a0",
         "don't we'll 12345 a_b", "x" * 5000, "\n", "  ", "a \n b", "é" * 300, "\u2003a \u2003b", "'s 's"]


def test_ids_are_the_tokenizers(tokenizer):
    encode = tokens.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").whole
    rng = random.Random(3)
    mixed = ["".join(rng.choice([" ", " ", "\n", "\t", "a", "Bc", "é", "1", "!", "漢", "'", "\u00a0", "ing"]) for _ in range(60)) for _ in range(500)]
    for text in [*TEXTS, *mixed, *(t or "" for _, t, *_ in corpus())]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pack(spark, tokenizer):
    rows = [r[:2] for r in corpus()] + [(400 + i, t) for i, t in enumerate(TEXTS)] + [(1, corpus()[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("piece", F.lit(0))
    got = packing.pack_documents(docs, capacity=128).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert bytes(r["ids"]) == np.array(own, "<u4").tobytes() and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in pieces.items():
        once = sorted(set(found))
        assert [p for p, *_ in once] == list(range(len(once))) and sum(n for *_, n in once) == len(ids[i])
        assert all(n == 128 for _, _, n in once[1:]) and len(found) == len(once) * (2 if i == 1 else 1)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    sizes = np.array([r["length"] for r in got])
    assert len(sequences) <= packing.lower_bound(sizes, 128) + 1
    out = packing.sequences(packing.pack_documents(docs, capacity=128)).collect()
    assert sum(r["length"] for r in out) == sizes.sum() and all(sum(map(len, r["ids"])) == 4 * r["length"] for r in out)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_exchange_between_partitions(spark):
    rng = random.Random(1)
    sizes = [rng.choice([30, 35, 45, 60, 20, 100]) for _ in range(900)]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "row long, piece int, length long")
    got = packing.pack(pieces, capacity=100, per_partition=50).collect()
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert len(got) == 900 and max(used.values()) <= 100
    alone = packing.best_fit_decreasing(np.array(sizes), 100)[2]
    assert len(used) <= alone + 6


def best_packing(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1:]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        best = best_packing(sorted(sizes, reverse=True), 20)
        assert packing.lower_bound(np.array(sizes), 20) <= best <= packing.best_fit_decreasing(np.array(sizes), 20)[2]
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 6), 20) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation(n):
    slots = token_shards.permuted(np.arange(n), n, key=9)
    assert sorted(slots.tolist()) == list(range(n))
    assert token_shards.permuted(slots, n, key=9, backwards=True).tolist() == list(range(n))
    if n > 60:
        assert slots.tolist() != list(range(n)) and slots.tolist() != token_shards.permuted(np.arange(n), n, key=10).tolist()


def test_token_shards_round_trip(spark, tokenizer, tmp_path):
    rows = [r[:2] for r in corpus()] + [(400 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "shards")
    shards = token_shards.write_shards(docs, folder, key=7, length=64, per_shard=32, per_block=10)
    stride = 4 + 2 * 64
    # by brute force: numbers in the order of the ids, sent through the permutation
    wanted = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        wanted += [(i, k, ids[at:at + 64]) for k, at in enumerate(range(0, len(ids), 64))]
    n = len(wanted)
    by_slot = dict(zip(token_shards.permuted(np.arange(n), n, key=7).tolist(), wanted))
    index = {}
    for r in shards.index.collect():
        with open(f"{folder}/{token_shards.shard_name(r['shard'])}", "rb") as f:
            f.seek(r["first_slot"] % 32 * stride)
            records = f.read(r["n"] * stride)
        assert zlib.crc32(records) == r["crc32"] and r["stride"] == stride and r["first_slot"] // 32 == r["shard"]
        for i in range(r["n"]):
            index[r["first_slot"] + i] = r["doc_ids"][i], r["pieces"][i], records[i * stride:(i + 1) * stride]
    assert sorted(index) == list(range(n))
    for slot, (i, k, ids) in by_slot.items():
        record = index[slot][2]
        assert index[slot][:2] == (i, k) and int.from_bytes(record[:4], "little") == len(ids)
        assert np.frombuffer(record, "<u2", len(ids), 4).tolist() == ids and not any(record[4 + 2 * len(ids):])
    files = {p.name for p in (tmp_path / "shards").iterdir() if p.name.endswith(".bin")}
    manifest = shards.manifest.collect()
    assert files == {r["file"] for r in manifest} and sum(r["n"] for r in manifest) == n
    assert all((tmp_path / "shards" / r["file"]).stat().st_size == r["bytes"] == r["n"] * stride for r in manifest)
    read = {r["slot"]: r["ids"] for r in token_shards.read_slots(spark, folder).collect()}
    assert read == {slot: ids for slot, (_, _, ids) in by_slot.items()}
    # a resumed read opens no other file
    for name in files - {token_shards.shard_name(1)}:
        (tmp_path / "shards" / name).write_bytes(b"")
    later = token_shards.read_slots(spark, folder, first=37, last=63).collect()
    assert [r["slot"] for r in later] == list(range(37, 64)) and all(r["ids"] == by_slot[r["slot"]][2] for r in later)
    with pytest.raises(Exception, match="cut short"):
        token_shards.read_slots(spark, folder, first=20).collect()
    assert token_shards.write_shards(docs.limit(0)).index.count() == 0


def test_token_order_does_not_depend_on_partitions(spark):
    rows = [r[:2] for r in corpus()] + [(None, f"no id {i}") for i in range(9)] + [(1, "again " * i) for i in range(9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (2, 5, 32):
        ordered, n = token_shards.training_order(docs.repartition(parts), length=64)
        found.append(sorted((r["slot"], r["doc_id"], r["piece"], bytes(r["ids"])) for r in
                            ordered.fillna({"doc_id": -1}).collect()))
        assert [x[0] for x in found[-1]] == list(range(n))
    assert found[0] == found[1] == found[2]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = corpus()
    rows += [(900, None, None, None, None), (901, "# " * 100, "en", "a", 200)]
    rows += [(902 + i, " ".join(words(rng, 60)), "en", "b", None) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    before = docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == before.columns, name
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert not ids & {900, 901, 44, 45, 46} and ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in out.select("doc_id").collect()} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_mix_rows_stand_in_training_order(spark):
    rows = [(i, f"s{i % 3}", "w " * (1 + i * 7 % 11)) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)).collect()
    first = [r["positions"][0] if r["positions"] else 2.0 for r in got]
    assert first == sorted(first) and len(got) == 300
