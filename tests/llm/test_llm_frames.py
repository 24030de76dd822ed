"""Edge cases of the operators as DataFrames: nulls, empty tables, repeated rows, clashing columns."""

import re

from pyspark.sql import Row

from folioflow.llm import encoding, language, mixing, names, overlap, packing, pairs, quality, splitting


def test_splitting_edges(spark):
    limits = spark.createDataFrame([(1, 20, 4)], "level int, max_chars int, overlap_chars int")
    rows = [(1, "b", 1, 1, 1, 1, "word " * 12, "x"), (2, None, 1, None, None, None, None, "x"), (3, "b", None, 1, 1, 1, "word " * 12, None), (1, "b", 1, 1, 1, 1, "word " * 12, "x")]
    df = spark.createDataFrame(rows, "vec_rowid bigint, book_id string, level int, section_order int, part_n int, part_of int, text string, pieces string")
    out = splitting.split_oversized(df, limits).collect()
    assert {r.vec_rowid for r in out} == {1} and all(len(r.text) <= 20 for r in out)
    assert splitting.oversized_ids(df, limits).collect() == [Row(vec_rowid=1)]
    assert splitting.split_oversized(df.limit(0), limits).count() == 0
    numbered = splitting.renumbered_pieces(df, limits).collect()
    assert {r.part_of for r in numbered} == {max(r.part_n for r in numbered)}


def test_encoding_edges(spark):
    cost = encoding.GarblingCost(["Das zuverlässige Verfahren beschreibt das genaue Gerät."] * 20)
    df = spark.createDataFrame([(1, "Das zuverlÃ¤ssige Verfahren beschreibt das GerÃ¤t.", "k"), (2, None, "k"), (3, "", None), (4, "plain", "k")], "id int, t string, steps string")
    got = {r.id: r for r in encoding.repair(df, cost, "t").collect()}
    assert got[1].restored == "Das zuverlässige Verfahren beschreibt das Gerät." and got[2].restored is None and got[3].restored == "" and not got[4].steps
    assert encoding.repair(df.limit(0), cost, "t").count() == 0


def test_language_edges(spark):
    en, ru = "The reliable method describes the exact device of the book. ", "Надёжный способ описывает точный прибор этой книги. "
    model = language.LanguageModel([(en * 9, "en"), (ru * 9, "ru")])
    df = spark.createDataFrame([(1, en + ru), (2, None), (3, ""), (4, "12 34 ++"), (5, en)], "id int, text string")
    got = {r.id: r.detected for r in language.detect(df, model).collect()}
    assert got[1].langs == ["en", "ru"] and len(got[1].segments) == 2 and got[2].lang is None and got[3].lang is None and got[5].lang == "en"
    labels = spark.createDataFrame([("en_GB", "en"), ("русский", "ru"), ("ger", "de"), (" UK ", "uk"), ("xx", None), (None, None)], "l string, want string")
    assert labels.filter(~language.label_code(labels.l).eqNullSafe(labels.want)).count() == 0


def test_overlap_pairs_match_brute_force(spark):
    import random

    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(0, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        if w and r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, r.choice(["train", "val", "eval"]), "s", [("user", " ".join(w).upper() if r.random() < 0.3 else " ".join(w)), ("assistant", None)]))
    rows += [(90, "train", None, None), (91, "val", None, [])]
    df = spark.createDataFrame(rows, "line_id bigint, split string, source string, messages array<struct<role string, content string>>")
    got = {(r.line_a, r.line_b) for r in overlap.pairs(df).collect()}
    folded = {x[0]: (x[1], overlap.words_of(x[3][0][1]) if x[3] else []) for x in rows}
    want = set()
    for a, (sa, wa) in folded.items():
        for b, (sb, wb) in folded.items():
            if sa == "train" and sb != "train" and wa and wb and overlap.edits_within(wa, wb, max(len(wa), len(wb)) // 6) is not None:
                want.add((min(a, b), max(a, b)))
    assert got == want
    assert overlap.pairs(df.limit(0)).count() == 0


def test_names_edges(spark):
    forms = spark.createDataFrame([("Edward", "Ted"), ("Edward", "Эдвард"), (None, None)], "full_form string, other_form string")
    df = spark.createDataFrame([(x,) for x in ("Edward Rozhekegard", "Ted Rozhekegard", "Рожекегард Э.", "Edward Rozhrkegard", "Unknown", None, "", "Maria Zubova", "Edward Rozhekegard")], "name string")
    got = {frozenset(r.names) for r in names.entities(df, forms).groupBy("entity").agg({"name": "collect_set"}).withColumnRenamed("collect_set(name)", "names").collect()}
    assert got == {frozenset({"Edward Rozhekegard", "Ted Rozhekegard", "Рожекегард Э.", "Edward Rozhrkegard"}), frozenset({"Maria Zubova"})}
    assert names.linked(names.entities(df.limit(0), forms)).count() == 0


def test_index_of_deletions_is_not_broadcast(spark, monkeypatch):
    mains = names.cut(spark.createDataFrame([("person", "shufelobrord", 3), ("person", "shufelobrort", 1), ("person", "zubova", 1)], "kind string, main string, n bigint"))
    plans, cut = [], names.cut
    monkeypatch.setattr(names, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert {(r.main, r.root) for r in names.canonical_mains(mains).collect()} == {("shufelobrord", "shufelobrord"), ("shufelobrort", "shufelobrord"), ("zubova", "zubova")}
    by_deletion = [x for p in plans for x in re.findall(r"(\w+Join) \[kind#\d+, v#\d+\]", p)]
    assert by_deletion and set(by_deletion) == {"SortMergeJoin"}


def test_pairs_edges(spark):
    chats = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)]), (2, None), (3, [("user", None)])], "line_id bigint, messages array<struct<role string, content string>>")
    assert sorted((r.record_no, r.pair_no) for r in pairs.pairs_of_chats(chats).collect()) == [(1, 1), (3, 1)]
    raws = spark.createDataFrame([(1, None), (2, "x"), (3, '{"pairs":[{"question":"a","answer":"b."}]}')], "sample_id bigint, raw string")
    assert [r.answer for r in pairs.pairs_of_raw(raws).collect()] == ["b."]


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, "The dog, the cat and it.\nNo end"), (2, None), (3, ""), (4, "a;b;c")], "doc_id int, text string").selectExpr("*", "'x' AS words")
    got = {r.doc_id: r for r in quality.statistics(df, ["the", "and", "it"]).collect()}
    assert got[1].words == 8 and abs(got[1].common_share - 0.5) < 1e-9 and got[1].closed_line_share == 0.5 and got[2].words == 0 and got[3].lines == 0
    rules = quality.induce(__import__("numpy").array([[0.0] * len(quality.FEATURES)] * 10), __import__("numpy").array(["prose"] * 10))
    assert rules == [] and quality.classify(quality.statistics(df, []), rules).filter("kind = 'junk'").count() == 2


def test_packing_and_mixing_edges(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 40) for i in range(200)] + [(900, "a", 130), (901, None, 5)], "doc_id bigint, source string, tokens int")
    packed = packing.pack(sizes, 50).collect()
    assert sum(r.tokens for r in packed) == sum(r.tokens for r in sizes.collect()) and {r.doc_id for r in packed} == {r.doc_id for r in sizes.collect()}
    load: dict = {}
    for r in packed:
        load[r.pack] = load.get(r.pack, 0) + r.tokens
    assert max(load.values()) <= 50 and packing.pack(sizes.limit(0), 50).count() == 0
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.02 and got["b"].most_repeats <= 2 and got["a"].most_repeats <= 1
    assert mixing.mix(sizes.limit(0), targets).count() == 0
