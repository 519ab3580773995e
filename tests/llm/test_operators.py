"""The corpus operators against brute force, round trips and held-out labels; nulls, empties, ties, repeats, clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from logweave.llm import html_extract, language_id, license_scan, packing, piece_nbest, quality, queries, simhash, token_count, topk_search, toxicity, word_encoder
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sf_texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def docs_of(spark, texts, clash=True):
    """Numbered texts as documents, with columns that clash with those the operators make."""
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    names = ("salt", "words", "block", "low", "fingerprint", "length", "features", "score", "rank", "word") if clash else ()
    return df.withColumns({n: F.lit("x") for n in names})


ODD = [None, "", " \n\t ", "a", "Ünïcode ẞ 日本語 <|endoftext|> ²³", "same same", "same same", "word " * 5000, "x" * 3000, "\x00\x01 ctrl"]


@pytest.mark.parametrize("run", [
    license_scan.scan, lambda d: language_id.identify(d, d), piece_nbest.digest, packing.pack, simhash.near_duplicates, token_count.count_tokens,
    lambda d: quality.quality_rules(d, d.select("doc_id", F.lit(1).alias("quality")).limit(3)),
    lambda d: toxicity.score_toxicity(d, d, d.select("doc_id", F.lit(None).cast("int").alias("toxic"))),
    lambda d: html_extract.extract(d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "salt")),
])
def test_odd_texts_null_ids_and_empty_tables(run, spark):
    docs = docs_of(spark, ODD)
    odd = docs.union(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    found = run(odd)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    assert Counter(r[0] for r in found.select(key).distinct().collect()) == Counter([*range(len(ODD)), None])
    assert run(docs.limit(0)).count() == 0


def test_license_scan_equals_comparing_every_block_with_every_template(spark, duck):
    texts = ["Licensed under CC BY-NC 4.0", "x\nreleased under the mit license now\ny", "All rights reserved. ALL RIGHTS RESERVED cc by", "the mit license", "cc  by\ncc\nby"]
    texts += [" ".join(random.Random(i).sample(license_scan.words_of(license_scan.TEMPLATES[i % 11][1]), k=min(6 + i % 9, len(license_scan.words_of(license_scan.TEMPLATES[i % 11][1]))))) for i in range(40)]
    docs = docs_of(spark, [*texts, None, "", texts[0]])
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({license_scan.sql()}) ORDER BY doc_id").fetchall()
    got = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in names) for r in got] == [tuple(r) for r in expected]
    assert got[2]["base_labels"] == "cc-by,reserved" and got[2]["n_base"] == 3 and (got[2]["first_word"], got[2]["last_word"]) == (0, 6)


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    r = random.Random(2)
    fill = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    texts, expected = [], []
    for label, text in license_scan.TEMPLATES:
        for width in (1, 3, 7):
            own = text.split()
            wrapped = "\n".join(" ".join(own[i : i + width]) for i in range(0, len(own), width))
            texts.append(f"{fill(r.randrange(70))}\n{wrapped}\n{fill(r.randrange(70))}")
            expected.append(label)
    scattered = " ".join(f"{w} {fill(60)}" for w in license_scan.words_of("Released under the MIT License"))
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(docs_of(spark, [*texts, scattered, fill(5000)])).collect()}
    assert all(label in got[i] for i, label in enumerate(expected)) and got[len(texts)] == got[len(texts) + 1] == [""]


def test_license_scan_on_the_tables(spark, duck):
    duck[1](queries.op1_license_scan(spark, duck[0]), queries.oracle_sql()["op1_license_scan"])


def test_language_held_out(spark):
    found = queries.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    own = language_id.identify(docs_of(spark, [None, "", "12 34!", "the"]), docs_of(spark, ["the cat", "a dog"])).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in own] == ["und", "und", "und", "en"] and own[0]["score"] == 0


def test_n_best_rows_round_trip(spark):
    docs = docs_of(spark, ["Some text, here.", None, "two  spaces ✓"])
    back = piece_nbest.decode(piece_nbest.encode(docs, 3)).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(0, "Some text, here."), (1, ""), (2, "two  spaces ✓")}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 8), 1)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(500, None), (520, [float("nan")] * 8), (540, [None] + [0.5] * 7), (560, []), (580, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)}
    expected = []
    for q in sorted(i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:20]
        expected += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    got = topk_search.search(df, df.filter("vec_id % 20 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_top_k_on_the_tables(spark, duck):
    duck[1](queries.op4_topk_search(spark, duck[0]), queries.TOPK_SQL)


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing_holds_every_token_once_without_gaps(spark):
    known = dict(sf_texts(spark)) | {10**6: None, 10**6 + 1: "", 10**6 + 2: "long text here " * 4000}
    df = spark.createDataFrame(list(known.items()), "doc_id long, text string")
    rows = packing.pack(df).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for (doc_id, text), ids in zip(known.items(), library_ids(known.values())):
        ids = np.array([*ids, 1], "<u4")
        own = by_doc[doc_id]
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(s, len(p), zlib.crc32(p.tobytes())) for s in range(0, len(ids), 4096) for p in [ids[s : s + 4096]]]
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(places[-1]) <= 4096
    assert len(taken) <= 1.02 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_plan_equals_best_fit_decreasing_by_piece():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.randrange(1, 40) for _ in range(r.randrange(1, 60))]
        plan = packing.best_fit_plan(Counter(lengths), 40)
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 40) - n)
        used = {first + k for _, lo, hi, per, first, _ in plan for k in range((hi - lo + per - 1) // per)}
        assert len(used) <= len(rooms) and sum(hi - lo for _, lo, hi, *_ in plan) == len(lengths)


def brute_fingerprint(text):
    import re

    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids, top = list(prints), {i: i for i in prints}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark):
    texts = dict(sf_texts(spark)) | {10**6 + i: t for i, t in enumerate([None, "", "A b", "a  B", "x y z"])}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def test_chains_of_close_fingerprints_and_split_shards(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(6)]
    values = set(seeds)
    for s in seeds:
        for _ in range(40):
            s ^= sum(1 << b for b in r.sample(range(64), 2))
            values.add(s)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), 2)).collect()
    groups = Counter(r["comp"] for r in found)
    classes = simhash.Classes()
    simhash.link_shard(sorted(values), list(range(64)), 2, classes, tree_size=20)
    whole = brute_components({v: v for v in values})
    assert sorted(groups.values()) == sorted(n for n in Counter(whole.values()).values() if n > 1)
    assert {v: classes.find(v) for v in values} == whole


def test_token_counts_by_chunks_equal_the_library(spark):
    texts = ["Hello, wörld! <|endoftext|> x", "word " * 3000, "long" * 500 + " end", "áé  x " * 300, None, ""] + [t for _, t in sf_texts(spark)][:50]
    got = token_count.count_tokens(docs_of(spark, texts), chunk_chars=200, overlap=10).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == list(map(len, library_ids(texts)))
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts] and got[1]["over_limit"]


def test_components_with_nodes_that_most_edges_share(spark):
    hub = spark.range(1, 12_000).selectExpr("0L - id as a", "-20000L as b").union(spark.range(50).selectExpr("id + 1 as a", "id as b"))
    found = simhash.components(hub.union(hub.selectExpr("b", "a")))
    assert sorted(map(tuple, found.groupBy("comp").count().collect())) == [(-20000, 12_000), (0, 51)]
    docs = spark.range(12_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same few words', concat('word', id, ' of text ', id * 7)) as text")
    got = simhash.near_duplicates(docs).filter("doc_id % 3 = 0")
    assert got.count() == 4000 and got.select("fingerprint", "component_id").distinct().count() == 1


def test_encoder_with_a_memo_smaller_than_a_batch():
    first, second = ([" ".join(f"{'ab'[k % 2]}x{k}é" for k in range(a, b))] for a, b in ((0, 6), (4, 14)))
    encoder = word_encoder.WordEncoder(capacity=16)
    for texts in (first, second, first + second, second):
        assert [x.tolist() for x in encoder.ids(texts)] == library_ids(texts)
        assert len(encoder.memo) <= 8 and len(encoder.old) <= 8


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=#>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id=content><h1>A &amp; B</h1><p>First   paragraph, with some commas, and&nbsp;words.</p><script>x</script>
<p>Second one, <a href=#>with link</a>, is also here.</p><ul><li>item one</li><li>item two</li></ul></div>
<aside class=sidebar><a href=#>Ad</a></aside><div class="comments"><p>I am a reader, and I say, this is great.</p></div><footer>Legal</footer></body></html>"""


def test_main_text_of_a_page(spark):
    assert html_extract.main_text(PAGE) == "A & B\nFirst paragraph, with some commas, and words.\nSecond one, with link, is also here.\nitem one\nitem two"
    assert html_extract.main_text(None) == html_extract.main_text("<nav>x</nav>") == ""
    rows = queries.op8_html_extraction(spark, SMALL).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(bool(r["text"]) for r in rows) > 0.9 * len(rows)


LONG = "This is a paragraph of the article, with commas, and with quite enough words to be worth some points."


@pytest.mark.parametrize("name", ["content with-sidebar", "layout has-sidebar", "no-ads", "page has-nav", "main-menu-open", "mainMenuOpen", "notices"])
def test_names_of_wrappers_dont_cut_the_article(name):
    for inner in (f"<article><p>{LONG}</p><p>{LONG}</p></article>", f"<p>{LONG}</p><p>{LONG}</p>"):
        html = f"<body><div>Site</div><div class='{name}'>{inner}<div class=sidebar><p>Other news, and more.</p></div></div><div class=comments><p>{LONG}</p></div></body>"
        assert html_extract.main_text(html) == f"{LONG}\n{LONG}"


def test_long_sidebars_and_comments_stay_out():
    other = f"<p>{LONG}</p>" * 5
    for name in ("sidebar", "comments", "related"):
        assert html_extract.main_text(f"<body><article><p>{LONG}</p></article><div class={name}>{other}</div></body>") == LONG
    assert html_extract.main_text(f"<body><div><p>{LONG}</p></div><div id=comments><article class=comment>{other}</article></div></body>") == LONG


def test_leads_short_sections_and_references_belong_to_the_text():
    assert html_extract.main_text(f"<article><p class=teaser>The lead.</p><p>{LONG}</p></article>") == f"The lead.\n{LONG}"
    assert html_extract.main_text(f"<body><section><p>{LONG}</p><p>{LONG}</p></section><section><p>That is all.</p></section></body>").endswith("That is all.")
    refs = "<ul>" + "".join(f"<li><a href=#>Reference {i}</a></li>" for i in range(4)) + "</ul>"
    assert html_extract.main_text(f"<body>{refs}<article><p>{LONG}</p>{refs}</article></body>").count("Reference") == 4


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = toxicity.BiGRU(3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table, ids = rng.normal(0, 1, (5, 18)), rng.integers(0, 5, (4, 6))
    _, _, cache = net.forward(table, ids, keep=True)
    grads, _ = net.backward(ids, np.ones(4), cache)
    for name in ("recurrent", "attention", "out"):
        for at in [tuple(int(rng.integers(n)) for n in net.p[name].shape) for _ in range(6)]:
            if name == "recurrent" and not net.mask[at]:
                continue
            old, eps, sums = net.p[name][at], 1e-2, []
            for x in (old + eps, old - eps):
                net.p[name][at] = x
                sums.append(net.forward(table, ids)[0].astype(float).sum())
            net.p[name][at] = old
            assert abs((sums[0] - sums[1]) / (2 * eps) - grads[name][at]) < 2e-2


def test_toxicity_learns_and_windows_cover_the_whole_text(spark):
    r = random.Random(0)
    plain = "the of and river stone light under window morning table paper walk".split()
    text = lambda bad: " ".join([r.choice(plain) for _ in range(60)] + (["zorgle", "grumfik", "zorgle"] if bad else []) + [r.choice(plain) for _ in range(60)])
    docs = docs_of(spark, [text(i % 3 == 0) for i in range(300)] + [text(False) * 20 + " zorgle grumfik zorgle", None])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, docs, labels, char_steps=200, word_epochs=8).collect()}
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in range(200, 300)]
    assert sum(right) >= 95 and got[300]["predicted"] == 1 and got[301]["predicted"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    model = toxicity.Model(2, 32, 0)
    for n in (0, 1, 31, 32, 33, 100):
        ids = model.window_ids(np.arange(n), -1)
        assert set(range(n)) <= set(ids.ravel().tolist())


def brute_statistics(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality_statistics_equal_brute_force(spark):
    texts = [t for _, t in sf_texts(spark) if len(t or "") < 20_000] + [None, "", "a b c d e f g h " * 3, "x\n\nx\r\n x \nx", "\x1c\x85   y"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.quality_rules(docs_of(spark, texts), spark.createDataFrame([(0, 1)], "doc_id long, quality int")).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in names) for r in got] == list(map(brute_statistics, texts))
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_isolation_forest_finds_the_far_row_and_the_threshold_keeps_good_rows():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.uniform(0, 0.2, (500, 4)), [[0.9, 0.9, 0.9, 0.9]]])
    forest = quality.IsolationForest(rows, 50, 256, 1)
    scores = forest.score(rows)
    assert scores.argmax() == 500 and abs(float(quality.normal_path(256)) - 10.2448) < 0.01
    assert quality.threshold([(50, 1000, 1), (90, 0, 30), (80, 1, 5)], 100, 0.001) == 0.8 and quality.threshold([], 100, 0.001) == 2.0
