"""Quality rules, secrets, URL filter and language identification."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loanpanel.llm import language_id, quality, secret_scan, url_filter
from loanpanel.llm.queries import URL_RULES
from tests.llm.common import SCHEMA, WORD, corpus, prose, words


def base_counts(text):
    text = text or ""
    own = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(own[i:i + 5]) for i in range(len(own) - 4))
    covered = {k for i in range(len(own) - 4) if windows[tuple(own[i:i + 5])] > 1 for k in range(i, i + 5)}
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_base_rules(spark):
    rng = random.Random(4)
    rows = [r[:4] for r in corpus()]
    again = " ".join(words(rng, 7))
    rows += [(200, f"{again}\n{again} x\n{again}\n\n{again}", "en", "a"), (201, "a a a a a a a a a a a", "en", "a"),
             (202, "# * $ % & | < > \x0b\x0c\x1c x", "fr", "a"), (203, "X x X x X x X x X x X x", "fr", "a"), (204, "w" * 50_000, "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("group", F.lit(1))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, text, *_ in rows:
        want = base_counts(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    left = quality.passing(docs)
    assert left.columns == docs.columns and sorted(r[0] for r in left.select("doc_id").collect()) == sorted(
        i for i in got if got[i]["kept"])
    assert quality.judge(docs.limit(0)).count() == 0


def test_fertility_rejects_what_its_language_does_not_write(spark):
    rng = random.Random(9)
    vocabulary = words(rng, 300)
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 200))), "en") for i in range(150)]
    rows += [(1000, " ".join("".join(chr(rng.randint(0x3400, 0x4DB0)) for _ in range(3)) for _ in range(80)), "en"),  # byte fallback
             (1001, " ".join(["same", "word"] * 60), "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000]["fertility_failed"] and got[1000]["byte_share"] > 0.5 and got[1001]["fertility_failed"]
    assert sum(not got[i]["kept"] for i in range(150)) <= 2


def test_one_rare_character_does_not_reject(spark):
    rng = random.Random(12)
    vocabulary = words(rng, 300)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in [12] * 60 + [rng.randint(100, 400) for _ in range(120)]]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(1000, texts[70] + " \U0001F9EC", "en"), (1001, texts[0] + " \U0001F9EC", "en"),
             (1002, texts[71] + " " + "\U0001F9EC " * 200, "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["byte_share"] == 0 for i in range(180)) and got[1000]["byte_share"] > 0
    assert got[1000]["kept"] and got[1001]["kept"] and got[1002]["fertility_failed"]


def test_copies_do_not_set_the_bands(spark):
    """A third of all rows are copies of one text, once a middling one and once a hex dump."""
    rng = random.Random(15)
    vocabulary = words(rng, 400)
    texts = [" ".join(rng.choice(vocabulary[:rng.randint(60, 400)]) for _ in range(rng.randint(90, 250))) for _ in range(200)]
    schema = "doc_id long, text string, lang string"
    alone = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], schema)).collect()}
    middling = sorted(alone, key=lambda i: alone[i]["token_entropy"])[100]
    dump = " ".join("%08x" % rng.getrandbits(32) for _ in range(100))
    for hot in (texts[middling], dump):
        rows = [(i, t, "en") for i, t in enumerate(texts + [hot] * 100)]
        got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
        assert len(got) == 300 and len({got[i]["kept"] for i in range(200, 300)}) == 1  # every row is judged
        assert sum(got[i]["kept"] != alone[i]["kept"] for i in range(200)) <= 2
        assert got[200]["kept"] == (hot != dump)


def test_scripts():
    assert [quality.main_script(t) for t in ("abc", "где", "漢字 a", "日本のこと", "12 !", "", "ελ")] == [
        "latin", "cyrillic", "han", "japanese", "none", "none", "greek"]


ASSIGN = re.compile(secret_scan.BASE[0][1])


def spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def secrets():
    rng = random.Random(6)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    blob = "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(40))
    rows = [r[:2] for r in corpus()]
    rows += [(300, f'é漢 token = "{blob}" and API_KEY:{blob[:7]} Password="{blob[:8]}"'), (301, f"AKIA{key} AKIAAKIA{key}é"),
             (302, "0123456789abcdef" * 2 + " " + "ab" * 15 + "\n" + "f" * 70), (303, f"seen {blob} here"),
             (304, "password=password=abcdefgh secret: 'x' passwd : 12345678"), (305, "an_ordinary_identifier_name_of_some_length"),
             (306, f"token={'ab12' * 9} {blob}=="), (307, "ToKeN\u017f = abcdefghij \u212aey")]
    return rows, blob


def test_secrets(spark):
    rows, blob = secrets()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash"))
    model = secret_scan.trained(secret_scan.labelled_samples(docs))
    ratios = model.ratios
    got = secret_scan.scan(docs, ratios, model.least_ratio).select("doc_id", secret_scan.joined(F.col("base")).alias("base"), "added")
    added = {}
    for r in got.collect():
        text = dict(rows)[r["doc_id"]]
        assert r["base"] == spans(text), r["doc_id"]
        for s in r["added"]:
            added.setdefault(r["doc_id"], []).append(text[s["start"]:s["end"]])
    assert added == {303: [blob], 306: [f"{blob}=="]}
    assert secret_scan.scan(docs.limit(0), ratios).count() == 0
    assert hashlib.sha256(b"").hexdigest() == got.select(F.sha2(F.lit(""), 256)).first()[0]


ORDINARY = ["-" * 40, "=" * 30, "_" * 18, "12345678901234567890", "20240115103000123456", "2024-01-15-10-30-00-000000",
            "blog/2020/01/some-article-title-here", "internationalization", "my-long-kebab-case-name", "SOME_CONSTANT_NAME_HERE",
            "getUserAccountSettings", "usr/local/share/applications", "Donaudampfschifffahrtsgesellschaft", "release_notes_2023_11"]
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", secret_scan.ALPHABET[:62],
             secret_scan.ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
PROSE = ("the committee will publish its report about public transport before the end of this year and several members "
         "asked whether additional information from local authorities should have been included in the international "
         "comparison since many regions have introduced new applications for settings accounts and release notes that "
         "users share with their friends der bericht wird vor ende des jahres erscheinen und die gesellschaft hat mehrere "
         "fragen zur schifffahrt auf der donau gestellt some constant name here title article kebab case long blog").split()


def test_secret_model_tells_random_from_ordinary(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(PROSE) for _ in range(150))) for i in range(60)]
    rows += [(100 + i, f"see {token} here") for i, token in enumerate(ORDINARY)]
    drawn = ["".join(rng.choice(a) for _ in range(32)) for a in ALPHABETS for _ in range(8)]
    rows += [(200 + i, f"see {token} here") for i, token in enumerate(drawn)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    samples = secret_scan.labelled_samples(docs.filter("doc_id < 100"), drawn=400)
    assert samples.groupBy("token", "random").count().filter("count > 1").join(
        samples.filter("family in ('word', 'name', 'document')"), ["token", "random"], "left_semi").count() == 0
    model = secret_scan.trained(samples)
    assert model.false_alarms < 0.01 and model.misses < 0.05
    added = {r["doc_id"]: len(r["added"]) for r in secret_scan.scan(docs, model.ratios, model.least_ratio).collect()}
    assert [t for i, t in enumerate(ORDINARY) if added[100 + i]] == []
    assert [t for i, t in enumerate(drawn) if not added[200 + i]] == [] and not any(added[i] for i in range(60))


def test_secret_ratios_against_plain_counts(spark):
    samples = [("abab", True, "x"), ("zz", True, "y"), ("ab", False, "x"), ("a-b", False, "x")]
    got = secret_scan.log_ratios(secret_scan.transition_counts(spark.createDataFrame(
        samples, "token string, random boolean, family string")), 0.5, 8.0, 100.0)

    def share(label, first, second):
        pairs = Counter()
        for token, random_, family in samples:
            total = sum(len(t) for t, r, f in samples if (r, f) == (random_, family))
            if random_ == label:
                pairs.update({p: 100.0 * n / total for p, n in Counter(zip(" " + token, token)).items()})
        anywhere = {c: 0.5 + sum(n for p, n in pairs.items() if p[1] == c) for c in secret_scan.ALPHABET}
        after = sum(n for p, n in pairs.items() if p[0] == first)
        return (pairs[first, second] + 8 * anywhere[second] / sum(anywhere.values())) / (after + 8)

    for pair in ("ab", "ba", "zz", " a", "a-", "qq", "-b"):
        assert got[pair] == pytest.approx(math.log(share(True, *pair) / share(False, *pair)))


def test_secret_model_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = secret_scan.trained(secret_scan.labelled_samples(none, drawn=50))
    assert secret_scan.scan(none, model.ratios, model.least_ratio).count() == 0
    bare = secret_scan.trained(spark.createDataFrame([("abc", True)], "token string, random boolean").withColumn("family", F.lit("x")))
    assert bare.least_ratio == 0.5 and bare.misses != bare.misses


def test_secret_model_of_no_samples(spark):
    none = spark.createDataFrame([(None, True), ("", False), ("x", None)], "token string, random boolean")
    assert set(secret_scan.log_ratios(secret_scan.transition_counts(none)).values()) == {0.0}


PAGES = ["https://example.org/es/x", "http://A.Example.ORG/en/1?q", "https://example.org/en/2", "https://xexample.org/es/", "http://org/",
         "http://org", "https://m.example.com/fr/1#t", "https://example.com/de", "https://com/de/#", "//example.org/es/", "", None,
         "ftp://example.org?/es/", "https://example.org/es", "x://y://z.org/", "https://a..org/", "https://example.org:80/es/",
         "HTTPS://EXAMPLE.ORG/ES/", "https://org./", "https://example.org//es/"]


def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


RULES = [*URL_RULES, ("example.org", "/es/", "allow"), ("m.example.com", "", "block"), ("z.org", "/", "block"), ("com", "/fr/1", "block")]


@pytest.mark.parametrize("most", [100, 2])
@pytest.mark.parametrize("rules", [URL_RULES, RULES])
def test_urls(spark, most, rules):
    pages = spark.createDataFrame(list(enumerate(PAGES)) + [(3, PAGES[3])], "page_id long, url string").withColumn("rule", F.lit(1))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])
                 for r in url_filter.filter_urls(pages, rules, max_broadcast_rules=most).collect())
    assert got == sorted((i, *verdict(u, rules)) for i, u in [*enumerate(PAGES), (3, PAGES[3])])


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, url string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, [], default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


SYLLABLES = {"en": ["the", "ing", "and", "er", "th", "ou"], "de": ["sch", "ung", "ein", "ich", "ö", "ge"], "es": ["ción", "ado", "ra", "os", "ñ", "ue"]}


def test_languages(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40)))
        rows.append((i, text, None if i % 10 == 0 else lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 3", "de"), (1003, "é", "es"), (1000, None, "en"), (1004, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, per_language=100).collect()}
    true = {i: list(SYLLABLES)[i % 3] for i in range(600)}
    aside = [i for i in true if got[i]["held_out"]]
    assert 100 < len(aside) < 200 and sum(got[i]["lang_pred"] == true[i] for i in aside) >= 0.98 * len(aside)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1004]["lang_pred"] in SYLLABLES
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_one_script_differ_by_the_order_of_letters(spark):
    """Three-byte letters, all equally frequent in both languages."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        circle = "กขคงจฉ"[::1 if i % 2 else -1] * 3
        starts = [rng.randrange(6) for _ in range(rng.randint(10, 30))]
        rows.append((i, " ".join(circle[k:k + 6] for k in starts), ("xx", "yy")[i % 2]))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    assert len(got) > 60 and all(r["lang_pred"] == ("xx", "yy")[r["doc_id"] % 2] for r in got)


def test_features_are_of_characters():
    def found(text):
        return [(f.tolist(), n.tolist()) for _, f, n in language_id.features([text.encode()])]

    assert found("a\u2013b\u00a0c") == found("a b c") and found("ÉÑ где") == found("éñ ГДЕ")
    assert found("กา") != found("ก า") and sum(found("漢字仮名")[0][1]) == 5 + 4 + 3  # with the break at the end


def test_language_weights_are_sparse_and_calibrated(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 1) if i % 2 else " ".join(rng.choice(SYLLABLES["es"]) for _ in range(20)), ("xx", "es")[(i + 1) % 2]) for i in range(200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (model.weights == 0).mean() > 0.8 and model.temperature > 0 and model.languages == ["es", "xx"]


def test_schema_of_the_fixture(spark):
    assert spark.createDataFrame(corpus(), SCHEMA).count() == len(corpus())
