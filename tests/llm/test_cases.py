"""Clashing columns, repeated and null ids, ties, and brute-force versions of fitted or searched results."""

import math
import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgraph.functions import storage
from trackgraph.llm import decontamination, groups, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sharding, token_records

NAMES = ["score", "lang_pred", "copies", "h", "vid", "key", "doc", "th", "removed", "row", "__row", "node", "component", "n", "a b"]


def clashing(spark, rows):
    columns = ["doc_id", "text", "lang", "source"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select(*columns, *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two = text(40), text(40)
    rows = [(1, one, "en", "s"), (1, two, "en", "s"), (1, one, "en", "s"), (2, one, "en", None), (None, one, "de", "s"), (None, None, None, None), (3, "", "en", "s"), (4, text(300), "de", "t"), (5, text(30) + "\n" + text(20), "en", "t")]
    return clashing(spark, rows)


def test_clashing_columns_pass_every_stage(spark, odd):
    bench = spark.createDataFrame([(1, "no such passage at all")], "item_id long, text string")
    for out in (ngram_join.one_of_each(odd), decontamination.decontaminated(odd, bench), mixing.mixed(odd), line_dedup.without_repeated_lines(odd, 8, 1)):
        assert out.columns == odd.columns
        for r in out.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in NAMES)
    out = sharding.sharded(odd, shards=3)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count()
    model = language_id.fit(odd)
    out = language_id.identify(odd, model, F.struct(*[F.col(f"`{c}`") for c in odd.columns]).alias("row")).select("row.*")
    assert out.columns == odd.columns and out.count() == odd.count()


def test_pipeline_with_clashing_columns_and_without_rows(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench = spark.createDataFrame([(1, "no such passage at all")], "item_id long, text string")
    for k, docs in enumerate([odd, odd.limit(0)]):
        folder = str(tmp_path / str(k))
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[: len(odd.columns)] == odd.columns and (out.count() > 0) == (k == 0)


def test_one_of_each_keeps_other_texts_of_a_doc_id(odd):
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(odd).collect())
    rows = Counter((r.doc_id, r.text) for r in odd.collect())
    assert set(kept) == {k for k in rows if k[0] != 2} and all(n == 1 for k, n in kept.items() if k[0] is not None)


def test_the_order_of_tokens_counts_every_document(spark):
    docs = spark.range(60_000).select(F.when(F.col("id") % 6 < 3, F.concat(F.lit("same words "), F.col("id") % 3)).when(F.col("id") % 6 == 4, F.concat(F.lit("w"), "id")).alias("text"))
    count = Counter()
    for _, n, tokens in ngram_join._sets(docs.toArrow()["text"], 5):
        count.update(int(x) % ngram_join.BUCKETS for x in tokens[:n])
    want = np.zeros(ngram_join.BUCKETS, np.int8)
    for x, n in count.items():
        want[x] = n.bit_length()
    assert sum(count.values()) == 40_000 and sorted(want)[-3:] == [14] * 3  # 10,000 documents each; of a sample of 40,000 a digit less
    assert (ngram_join.token_ranks(docs.repartition(5), 5) == want).all()


def test_prefixes_hold_tokens_of_one_document(spark):
    """100 tokens of its own and 18 shared with one other document; 97 go into the prefix. 300,000 tokens meet in buckets by chance."""
    words = lambda n, kind, at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit(kind), at.cast("string"), F.lit("_"), i.cast("string")))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words(100, "w", F.col("id")), words(20, "p", F.floor(F.col("id") / 2))).alias("text"))
    order = ngram_join.token_order(docs, 3)
    prefixes = [r.prefix for r in ngram_join.sketches(docs, 3, 18, order).collect()]
    count = Counter(x for p in prefixes for x in p)
    assert {len(p) for p in prefixes} == {97} and sum(any(count[x] > 1 for x in p) for p in prefixes) < 30
    tokens = np.array(prefixes[0]).view(np.uint64)
    order.room[:] = 0  # no room: all count as shared
    assert (order.rank(tokens) >= 32).all()


def test_prefixes_are_stored_without_lone_tokens(spark):
    """Shared tokens keep their places in the prefix; of those in one document only a few are left, which meet shared ones by chance."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"own{i}_"), "id") for i in range(20)], *[F.concat(F.lit(f"pair{i}_"), F.floor(F.col("id") / 2)) for i in range(20)])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    order = ngram_join.token_order(docs, 3)
    whole = {r.doc_id: list(r.prefix) for r in ngram_join.sketches(docs, 3, 20, order).collect()}
    less = {r.doc_id: dict(zip(r.places, r.prefix)) for r in ngram_join.sketches(docs, 3, 20, order, lone=False).collect()}
    count = Counter(x for p in whole.values() for x in p)
    assert whole.keys() == less.keys() and any(count[x] > 1 for x in whole[0])
    for doc, prefix in whole.items():
        assert all(prefix[k] == x for k, x in less[doc].items())
        assert {x for x in prefix if count[x] > 1} <= set(less[doc].values())
    assert sum(count[x] == 1 for p in less.values() for x in p.values()) < 0.1 * sum(n == 1 for n in count.values())


def test_pairs_of_lines_are_staged_before_all_lines_are_judged(spark):
    """The last plan holds no shuffle of variants."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i\nshort one"), (2, "a b c d e f g h x\nshort onf")], "doc_id long, text string")
    out = line_dedup.line_report(docs)
    assert out.inputFiles() and not [f for f in out.inputFiles() if "/variants-" in f]
    assert [(r.doc_id, r.removed) for r in out.orderBy("doc_id").collect()] == [(1, []), (2, [0, 1])]


def test_staged_tables_free_the_driver(spark):
    held, weak = spark._jvm.java.util.HashMap(), spark._jvm.java.util.WeakHashMap()
    held.put("no longer used", 1)
    weak.putAll(held)
    spark._jvm.System.gc()  # now it is old, and small collections pass it by
    held.clear()
    storage.staged(spark.range(3), "numbers")
    assert weak.size() == 0


def test_short_items_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "it says: Zebra crossing here"), (2, "zebracrossing"), (None, "a zebra crossing"), (None, "clean"), (1, "clean as well"), (3, "exactly twenty four chars")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "zebra"), (None, "exactly twenty four char"), (9, "!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()}
    assert got == {(1, 7), (None, 7), (3, None)}
    assert sorted((r.doc_id or 0, r.text) for r in decontamination.decontaminated(docs, bench).collect()) == [(0, "clean"), (1, "clean as well"), (2, "zebracrossing")]


def edits_within(pattern, text):
    """Least edits that turn the pattern into any part of the text (brute force)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_all_alignments(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(i, text(rnd.choice([4, 8, 12]))) for i in range(12)]
    docs = []
    for d in range(60):
        body = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 9)):
            at = rnd.randrange(len(body))
            body[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "q"])
        docs.append((d, f"{text(20)} {''.join(body)} {text(20)}"))
    docs.append((60, items[0][1] + " " + text(4000)))
    found = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    want = set()
    for d, t in docs:
        for i, item in items:
            segments = decontamination.segments_of(decontamination.normalised(item), 100, 100)
            most = lambda s: max(min(int(len(s) * 0.05), (len(s) - 12) // 12), 0)
            if d < 60 and any(edits_within(s, decontamination.normalised(t)) <= most(s) for s in segments):
                want.add((d, i))
    assert {x for x in got if x[0] < 60} == want and (60, 0) in got


def test_every_word_of_the_sample_is_known(spark):
    word = lambda lead, i: lead + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(" ".join(word(lead, i) for i in range(25_000)), lang) for lead, lang in (("x", "aa"), ("y", "bb"))]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    found = language_id.identify(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string"), model, "doc_id").collect()
    assert {r.doc_id: r.lang_pred for r in found} == {0: "aa", 1: "bb"} and len(model.words.index) == 50_000


def test_the_driver_holds_the_language_model_as_arrays(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(6))
    docs = spark.createDataFrame([(" ".join(word(7919 * i) for i in range(k, 60_000, 20)), "aa") for k in range(20)], "text string, lang string")
    tracemalloc.start()
    try:
        model = language_id.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.words.added) == 60_000 and peak < 40 << 20  # 14 MB; with Python objects for each row 134 MB
    assert len(model.words.index) == 60_000
    sent = pickle.loads(pickle.dumps(model)).words
    assert "index" not in vars(sent) and sent.index == model.words.index


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(f"word{chr(97 + i % 26)} " + "same " * (i % 50) + chr(97 + i // 26 % 26), "aa") for i in range(2000)], "text string, lang string")
    size = sum(len(r.text) for r in docs.collect())
    for bound in ({"sample_rows": 200}, {"sample_bytes": size // 10}):
        n = sum(np.exp(language_id.fit(docs, **bound).words.added) - 1) / 2  # words of the sample, counted again from their logarithms
        assert 0.03 * size / 5 < n < 0.2 * size / 5


def test_language_scores_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.where("doc_id % 3 = 0")  # leaves words of the others unseen
    m = language_id.fit(learned)
    words, grams = {}, {}
    for r in learned.where("text is not null and lang is not null").collect():
        for w in language_id.LETTERS.findall(r.text.lower()):
            words.setdefault(w, Counter())[r.lang] += 1
            for n in range(1, 5):
                for g in language_id.grams_of(w, n):
                    grams.setdefault(n, {}).setdefault(g, Counter())[r.lang] += 1

    tables = {0: words} | grams
    sums = {n: {lang: sum(c[lang] for c in t.values()) for lang in m.languages} for n, t in tables.items()}

    def logs(n, x):
        return [math.log((tables[n][x][lang] + 0.5) / (sums[n][lang] + 0.5 * len(tables[n]))) for lang in m.languages]

    for r in language_id.identify(docs, m, "doc_id", "text").collect():
        total = [0.0] * len(m.languages)
        own = language_id.LETTERS.findall((r.text or "").lower())
        for w in own:
            rows = [logs(0, w)] if w in words else []
            for n in range(4, 0, -1):
                rows = rows or [logs(n, g) for g in language_id.grams_of(w, n) if g in grams[n]]
            for j in range(len(total)):
                total[j] += sum(x[j] for x in rows) / max(len(rows), 1)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            best = max(total)
            assert m.languages[total.index(best)] == r.lang_pred or r.score < 0.51
            assert abs(r.score - 1 / sum(math.exp(t - best) for t in total)) < 1e-6


def test_quality_model_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    first = quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).collect()
    docs, labels = docs.repartition(7, "text"), labels.repartition(3)
    assert sorted(first) == sorted(quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).collect())


def test_certified_levels_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        junk = rnd.random() < 0.3
        words = [f"w{rnd.randrange(10**6)}" + ("%%" if rnd.random() < (0.5 if junk else 0.02) else "") for _ in range(rnd.randint(40, 80))]
        rows.append((i, " ".join(words), ["en", "de", "xx"][min(i % 40, 2)] if i % 40 < 3 else "en", int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = quality_rules.judged(docs, docs.select("doc_id", "quality")).collect()
    import hashlib

    good = {r[0] for r in rows if r[3]}
    cut = {}
    held = [r for r in got if not r.base_failed and r.doc_id in good]
    first = lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest() < "8"
    out = lambda r, rule, c: (100 * r[rule[0]] > c * r.n_words) if rule[1] else (100 * r[rule[0]] < c * r.n_words)
    strata = sorted({r.stratum for r in held if first(r)})
    for s in strata:
        a, b = ([r for r in held if r.stratum == s and first(r) == side] for side in (True, False))
        for budget in quality_rules.BUDGETS:
            level = {n: next((c for c in rule[2] if sum(out(r, rule, c) for r in a) <= budget * len(a)), None) for n, rule in quality_rules.RULES.items()}
            k, n = sum(any(c is not None and out(r, quality_rules.RULES[x], c) for x, c in level.items()) for r in b), len(b)
            if sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / len(strata):
                break
            cut[s] = level
    assert list(cut) == ["en"]  # the others have too few labels
    for r in got:
        bad = any(c is not None and out(r, quality_rules.RULES[x], c) for x, c in cut.get(r.stratum, {}).items())
        assert r.kept == (not r.base_failed and not bad)


def test_records_are_read_in_any_order(spark, odd, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    index = token_records.write_records(odd, f"file://{tmp_path}/records", P.path("byte_bpe_50k.json"), 2, file_bytes=500)
    rows = token_records.read_records(index.orderBy(F.rand(3)), f"file://{tmp_path}/records").collect()
    encode = token_records.Encoder(P.path("byte_bpe_50k.json")).pieces.tokenizer.encode
    want = Counter((r.doc_id, *encode(r.text or "", add_special_tokens=False).ids, 2) for r in odd.collect())
    assert Counter((r.doc_id, *r.ids) for r in rows) == want and len({r.file for r in rows}) > 1


def test_join_with_a_large_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 0).when(F.col("id") < 4900, F.col("id")).alias("k"))
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("group_rows"), F.min("id").alias("first"))
    got = {(r.id, r.k, r["first"]) for r in groups.join_groups(rows, table, ["k"], 5000).collect()}
    assert got == {(i, 0 if i < 3000 else i, 0 if i < 3000 else i) for i in range(4900)}
    assert groups.join_groups(rows, table, ["k"], 5000, how="left").count() == 5000
