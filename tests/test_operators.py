"""Operators of the core against transcribed cases, brute force and SQL."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import catalog, chunking, dedup, export, filters, graph, vectors
from folioflow.sources import parsers
from folioflow.streaming import monitors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filter_errors(spark):
    fields = {"a"}
    for bad in ({}, {"$or": []}, {"a": {"$in": []}}, {"b": 1}, {"a": {"$x": 1}}, {"a": [1]}, {"a": float("nan")}):
        with pytest.raises(filters.FilterError):
            filters.compile_filter(bad, fields)


def test_filter_semantics(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "a int")
    spec = {"$or": [{"a": {"$gt": 7}}, {"a": {"$in": [1, 2]}}], "a": {"$ne": 2}}
    assert sorted(r.a for r in df.filter(filters.compile_filter(spec, {"a"})).collect()) == [1, 8, 9]


def test_canonical_and_entities(spark):
    df = spark.createDataFrame([("Saturn V", 1), ("saturn v.", 2), ("!", 3), ("Apollo, 11!", 4)], "name string, seq int")
    got = {r.canonical: (r.display, r.aliases) for r in graph.resolve_entities(df).collect()}
    assert got == {"saturn v": ("Saturn V", "saturn v."), "apollo 11": ("Apollo, 11!", "")}


def ppr(spark, edges, seeds):
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame(seeds, "node string, weight double")
    return {r.node: r.score for r in graph.personalised_pagerank(e, s, iterations=8).collect()}


def test_pagerank_star_and_missing_seed(spark):
    got = ppr(spark, [("1", "2"), ("1", "3"), ("1", "4")], [("1", 1.0)])
    assert got["1"] > got["2"] and abs(got["2"] - got["3"]) < 1e-9 and abs(sum(got.values()) - 1) < 1e-6
    assert ppr(spark, [("1", "2")], [("9", 1.0)]) == {}


def test_nearest_is_exact(spark):
    rows = [(i, [float((i * 7 + k) % 11 - 5) for k in range(4)]) for i in range(30)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["query"]: round(r.sim, 5) for r in vectors.nearest(e, e.repartition(3), 1).collect()}
    import numpy as np

    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    assert all(abs(got[i] - s[i].max()) < 1e-4 for i in got) and len(got) == 30


def test_sections_and_units():
    md = "# Part I\n## Chapter 1\na\n### 1.1\nb\n### 1.2\n\nc\n## Chapter 2\n# Part II\n"
    got = chunking.markdown_sections(md)
    assert [s[0] for s in got] == [1, 2, 3, 3, 2, 1] and got[2][2] == ["Part I", "Chapter 1", "1.1"] and got[4][2] == ["Part I", "Chapter 2"]
    assert chunking.markdown_sections(None) == [] and chunking.markdown_sections("x\n\ny")[0][0] == 0


def test_chunkers():
    assert len(chunking.char_chunks("\n\n".join(["p" * 141] * 5))) == 1
    packs = chunking.pack_paragraphs([("w " * 200).strip()] * 12)
    assert len(packs) > 1 and all(len(p.split()) <= 1700 for p in packs)
    assert chunking.token_windows(list(range(10)), 4, 1) == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]


def test_cleaning(spark):
    lines = ["— 47 —", "[123]", "Page 200", "стр. 88", "© 2001 X", "ISBN 1", "* * *", "Конец главы", "Real text here.", "run", "run", "run", "As shown before [12]", "in 1969", "--- 12", "one", None, ""]
    df = spark.createDataFrame([(1, lines), (2, None), (3, [])], "k int, ps array<string>")
    got = [(r.k, r.paragraph) for r in T.clean_paragraphs(df, "k", F.col("ps")).orderBy("position").collect()]
    assert got == [(1, "Real text here."), (1, "As shown before"), (1, "in"), (1, "one")]
    kept = T.clean_paragraphs(df, "k", F.col("ps"), pages=False, running=False, footnotes=False)
    assert [r.paragraph for r in kept.orderBy("position").collect()].count("run") == 3 and kept.filter("paragraph = 'Page 200'").count() == 1
    assert one(spark, T.clean_paragraph(F.lit(" a\u00adb\r\n\r\n\r\nc  \t d \x07"))) == "ab\n\nc d"


def test_numbers(spark):
    assert one(spark, T.approx_tokens(F.lit("a" * 400))) == 100
    a, b = F.array(*map(F.lit, "linear finite element converges quadratic".split())), F.array(*map(F.lit, "finite element method converges quadratically".split()))
    assert abs(one(spark, T.jaccard(a, b)) - 3 / 7) < 1e-9
    assert one(spark, T.isbn13(F.lit("see 0-306-40615-2."))) == "9780306406157" and one(spark, T.isbn13(F.lit("978-0-306-40615-7"))) == "9780306406157" and one(spark, T.isbn13(F.lit("1234567890"))) is None


def test_keys(spark):
    k = lambda t, a: one(spark, dedup.near_key(F.lit(t), F.lit(a), F.lit(365)))
    assert k("War & Peace!", "Leo  Tolstoy") == k("war   peace ", "LeoTolstoy") and k("ab", "x") is None
    w = lambda t: one(spark, dedup.work_key(F.lit(t), F.lit("John Doe")))
    assert w("Neural Systems 2nd Edition 2024") == w("Neural Systems")


def test_greedy_tiers(spark):
    rows = [(1, "a", "one two three four five six seven eight nine tens"), (2, "a", "one two three four five six seven eight nine tens"), (3, "a", "other words stand here"), (4, "b", "one two three four five six seven eight nine tens"), (5, "a", None), (6, None, "x")]
    df = spark.createDataFrame(rows, "line_id bigint, tier string, text string")
    assert sorted(r.line_id for r in dedup.greedy_tiers(df).collect()) == [1, 3, 4, 5, 6]


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_greedy_tiers_shuffles_less_than_its_texts(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    rows, kept = [], {"a": [], "b": []}
    for i in range(3000):
        text = rnd.choice(rows)[2].split() if rows and rnd.random() < 0.1 else rnd.choices(words, k=rnd.choice([1, 5, 12, 30, 45, 60, 100]))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, rnd.choice("ab"), " ".join(text)))
        if not any(len(k & set(text)) > 0.92 * len(k | set(text)) for _, k in kept[rows[-1][1]]):
            kept[rows[-1][1]].append((i, set(text)))
    spark.createDataFrame(rows, "line_id bigint, tier string, text string").write.parquet(f"{tmp_path}/lines")
    before = shuffled(spark)
    assert sorted(r.line_id for r in dedup.greedy_tiers(spark.read.parquet(f"{tmp_path}/lines")).collect()) == sorted(i for k in kept.values() for i, _ in k)
    assert 0 < shuffled(spark) - before < sum(len(text) for _, _, text in rows)


def test_idea_clusters(spark):
    rows = [("b", i, v) for i, v in enumerate([[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.99, 0.05, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]])]
    df = spark.createDataFrame(rows, "book_id string, seq int, embedding array<double>")
    assert dedup.idea_clusters(df).count() == 4


def test_exports(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "id int, messages array<struct<role string, content string>>")
    assert df.select(export.chatml(F.col("messages"))).first()[0] == "<|im_start|>human\nq<|im_end|>\n<|im_start|>gpt\n<|im_end|>"
    ids = spark.range(5000).select(export.hash_split(F.col("id"), 42, 0.9).alias("s")).filter("s = 'train'").count()
    assert 0.85 < ids / 5000 < 0.95 and sorted(export.seeded_shuffle([1, 2, 3, 4], 7)) == [1, 2, 3, 4]
    pairs = spark.range(3000).select(export.split_bucket(F.col("id"), F.lit(1), 42, 0.9).alias("s")).filter("s = 'train'").count()
    assert 0.87 < pairs / 3000 < 0.93 and one(spark, export.split_bucket(F.lit(None).cast("string"), F.lit(0), 1, 0.5)) is None


def test_exported_splits_read_back(spark, tmp_path):
    c = spark.createDataFrame([("a", "ai", "Essence.", "Proof.", None, "Use."), ("b", None, "", None, None, None), ("c", "ux", "E", None, "F", None)], "id string, domain string, essence string, proof string, cipher string, applicability string")
    d = export.template_dialogues(c, 3)
    got = {(r.concept_id, r.depth): r.answer for r in d.collect()}
    assert got["a", 1] == "Essence." and got["a", 3] == "Essence.\n\nОбоснование: Proof.\n\nПрименение: Use." and got["c", 2] == "E\n\nФормула: F" and ("b", 3) not in got
    counts = export.export_splits(d, f"{tmp_path}/out", ratio=0.5)
    back = spark.read.json(f"{tmp_path}/out")
    assert sum(counts.values()) == 6 == back.count() and {r.role for r in back.select(F.explode("messages.role").alias("role")).collect()} == {"system", "user", "assistant"}
    qa = "struct<question:string,answer:string>"
    t = spark.createDataFrame([("a", "b", "c", "now", "ai", ["x"], ("q1", "a1"), ("q2", "a2"), None)], f"concept_id string, book_id string, collection_name string, created_at string, domain string, flags array<string>, t1 {qa}, t2 {qa}, t3 {qa}")
    lines = export.tier_lines(t).collect()
    assert [x.metadata.tier for x in lines] == ["t1", "t2"] and lines[0].conversations[0].value == "You are an expert in ai."
    export.to_jsonl(t.select("concept_id"), f"{tmp_path}/lines", "concept_id")
    assert spark.read.json(f"{tmp_path}/lines").collect()[0].concept_id == "a"


def test_catalog(spark):
    df = spark.createDataFrame([("1", "T", 5, None), ("2", "U", None, True), ("3", "V", 9, False)], "id string, title string, quality_score int, is_fiction_or_water boolean")
    got = [r.id for r in catalog.query_catalog(df, hide_fiction=True, order="quality").collect()]
    assert got == ["3", "1"]
    with pytest.raises(ValueError, match="empty"):
        catalog.query_catalog(df, statuses=[])


def test_parsers():
    fb2 = "<FictionBook><description><title-info><book-title>T</book-title><author><first-name>A</first-name></author><lang>ru</lang></title-info></description><body><section><title><p>H</p></title><p>x</p></section></body></FictionBook>".encode()
    assert parsers.parse(fb2, "fb2")["sections"] == [(2, "H", ["x"])]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r>Head</w:r></w:p><w:p>body</w:p></d>')
    assert parsers.parse(buf.getvalue(), "docx")["sections"] == [(1, "Head", ["body"])]
    h = parsers.parse(b"<title>G</title><h1>Glossary</h1><p>Quick &amp; sort<p>two", "html")
    assert h["title"] == "G" and h["sections"] == [(1, "Glossary", ["Quick & sort", "two"])]
    assert parsers.parse(b"Chapter One\n\nText of it.", "txt")["sections"] == [(1, "Chapter One", ["Text of it."])]
    assert parsers.parse(b"broken", "epub")["warning"] and parsers.parse(None, "txt")["warning"] == "empty file" and parsers.parse(b"x", "zzz")["warning"] == "no parser"
    assert parsers.decode("Привет".encode("cp1251")) == "Привет" and parsers.kind_of(b"%PDF-1.7") == "pdf" and parsers.uniform(b"\0" * 20000)
    assert parsers.palm_decompress(b"abc\x80\x18d") [:3] == b"abc"
    assert parsers.parse(rb"{\rtf1\ansicpg1251 \'cf\'f0\par x}", "rtf")["sections"][0][2] == ["Пр", "x"]
    assert parsers.front_matter('---\ntitle: "a \\"b\\""\nyear: 3\n---\n') == {"title": 'a "b"', "year": "3"}
    assert parsers.file_name_fields("/x/John Doe - A Book (2001).pdf") == {"author": "John Doe", "title": "A Book", "year": "2001"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 6}:10:00", "click", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = monitors.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, monitors.tumbling_counts(df).collect()))


def test_without_llm(tmp_path):
    """The library stands without the optional subpackage."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "folioflow", tmp_path / "folioflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q[0] == 'p' and q[1].isdigit() for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-1] == "False"


def test_graph_at_once_and_by_joins(spark):
    import random

    r = random.Random(1)
    edges = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(90)] + [(None, 1), (2, None)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0), (99, 1.0), (3, -1.0)], "node bigint, weight double")
    a = {x.node: x.score for x in graph.personalised_pagerank(edges, seeds).collect()}
    b = {x.node: x.score for x in graph.personalised_pagerank(edges, seeds, local_edges=0).collect()}
    near = {}
    for x in graph.adjacency(edges).collect():
        near.setdefault(x.src, set()).add(x.dst)
    t = {n: {1: 0.2, 2: 0.6}.get(n, 0.0) for n in near}
    score = dict(t)
    for _ in range(25):
        score = {n: 0.15 * t[n] + 0.85 * sum(score[m] / len(near[m]) for m in near[n]) for n in near}
    assert a == pytest.approx(score) and b == pytest.approx(score)
    assert graph.personalised_pagerank(edges, seeds.filter("node = 99")).count() == 0 and graph.personalised_pagerank(edges.limit(0), seeds).count() == 0


def test_seeds_and_ingest(spark):
    t = spark.createDataFrame([("Saturn V", "flies_to", "Moon", 1, "c1"), ("saturn  v!", "burns", "Kerosene", 2, "c2"), ("???", "is", "x", 3, "c3"), (None, "is", "y", 4, "c4")], "subject string, predicate string, object string, seq int, source string")
    ents, rels = graph.ingest_relations(t)
    got = {r.canonical: r for r in ents.collect()}
    assert got["saturn v"].display == "Saturn V" and got["saturn v"].aliases == "saturn  v!" and rels.count() == 2
    name = {r.id: r.canonical for r in ents.collect()}
    assert {name[r.node] for r in graph.seeds(ents, "the saturn rocket").collect()} == {"saturn v"} and graph.seeds(ents, "a b").count() == 0
    kept, left = graph.without_source(ents, rels, spark.createDataFrame([("c2",)], "source string"))
    assert left.count() == 1 and {r.canonical for r in kept.collect()} == {"saturn v", "moon"}


def test_titles_and_names_of_every_script(spark, tmp_path):
    from folioflow.plans import registry

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    titles = [("1", "Теория систем", "Theory of Systems"), ("2", "Übersicht", "Ubersicht"), ("3", "Log", "Logs"), ("4", None, "x"), ("5", "Ёлка", None)]
    names = ["Иван  Петров!", "José Ñandú", "Knuth, D. E.", None, None]
    spark.createDataFrame([(*t, a) for t, a in zip(titles, names, strict=True)], "id string, title string, title_en string, author string").write.parquet(f"{tmp_path}/books.parquet")
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path)).collect()
    want = {i: 1 - edits(a, b) / max(len(a), len(b)) for i, a, b in titles if a and b}
    assert {r.id: r.ratio for r in run("levenshtein_titles")} == pytest.approx(want, abs=1e-6)
    assert {r.author: r.canonical for r in run("canonical_names")} == {"Иван  Петров!": "иван петров", "José Ñandú": "josé ñandú", "Knuth, D. E.": "knuth d e"}


def test_revisions_and_editions(spark):
    score = lambda *t: one(spark, dedup.revision_score(*[F.lit(x).cast("string") for x in t]))
    assert score("Neural Systems 2nd Edition 2024", None) == 124 + 8 and score("Neural Systems", "old.zip") == 0 and score("Book v12, revised", None) == 40 + 20
    work = lambda t, a: one(spark, dedup.work_key(F.lit(t).cast("string"), F.lit(a).cast("string")))
    assert work("Systems volume 1", "J. Doe") != work("Systems volume 2", "J. Doe") and work("Systems edition 3", "J. Doe") == work("Systems v2", "J. Doe") == "systems|j doe"
    assert work("abc", "J. Doe") is None and work("abcdef", None) is None and work("abcdefghij", "") == "abcdefghij|"
    rows = [("1", "w", 5), ("2", "w", 9), ("3", "w", 9), ("4", None, 1), ("5", "v", 0)]
    got = {r.id: (r.rival, r.decision) for r in dedup.revision_decisions(spark.createDataFrame(rows, "id string, work string, score int")).collect()}
    assert got == {"1": ("2", "older"), "2": ("3", "same"), "3": ("2", "same"), "4": (None, "new"), "5": (None, "new")}
    files = spark.createDataFrame([("a/x", "n", "pdf", 1), ("A/X", "N", "epub", 2), ("a/x", "n", "epub", 3), (None, None, "lit", 4)], "d string, b string, f string, at int")
    assert {r.at for r in dedup.best_format(files, F.col("d"), F.col("b"), F.col("f"), ["at"]).collect()} == {2, 4}
    assert one(spark, dedup.format_priority(F.lit("xyz"))) == -1 == one(spark, dedup.format_priority(F.lit(None).cast("string")))


def test_latest_without_a_date(spark):
    df = spark.createDataFrame([("a", None, "t"), ("b", None, "old"), ("b", 1, "new")], "id string, at int, title string")
    assert {r.id: r.title for r in catalog.latest(df, "id", "at").collect()} == {"a": "t", "b": "new"}


def test_replies():
    from folioflow.operators import replies as R

    assert R.reply_state("```json\n{\"a\": 1}\n```") == ("value", '{"a": 1}') and R.reply_state(" NULL ") == ("null", None) and R.reply_state(None)[0] == "empty" and R.reply_state('{"a": ')[0] == "failure"
    assert R.split_reasoning("<think>why</think> {}") == ("why", "{}") and R.split_reasoning("<think>cut") == ("cut", "") and R.split_reasoning("x") == (None, "x")
    got = R.parse_reply('<think>a { b</think>so {"x": "}{", "y": {"z": 1}} end')
    assert got["json"] == '{"x": "}{", "y": {"z": 1}}' and got["problem"] is None
    assert R.parse_reply("no object")["problem"] == "no_object" and R.parse_reply("{bad}")["problem"] == "invalid" and R.parse_reply("<think>x")["problem"] == "unclosed"
    assert R.last_json('first {"a": 1} then {"b": 2} and {broken}') == '{"b": 2}' and R.last_json("[1] and [2, 3]", "[", "]") == "[2, 3]" and R.last_json(None) is None
    assert R.without_prose('Okay, let\'s see {"a": 1} or {"b": 2}') == '{"b": 2}' and R.without_prose("Let me think about it") == "" and R.without_prose("Plain {") == "Plain {"


def test_concepts_and_meta(spark):
    from folioflow.operators import replies as R

    points = ['{"principle": " E ", "domain": "ai", "tagsCsv": "|a| b ||", "explanation": "p"}', '{"essence": "E", "domain": "ai", "tagsJson": "[\\"x\\", \\"\\"]"}', '{"essence": "E", "domain": "ai", "tagsJson": "oops"}', '{"essence": "E", "domain": " "}', "no json", None]
    got = [r.c for r in spark.createDataFrame([(p,) for p in points], "p string").select(R.concept_of(F.col("p")).alias("c")).collect()]
    assert got[0].essence == "E" and got[0].tags == ["a", "b"] and got[0].proof == "p" and got[1].tags == ["x"] and got[2].tags == [] and got[3:] == [None, None, None]
    meta = lambda t: one(spark, R.text_meta(F.lit(t)))
    assert meta('```json\n{"title": " T ", "year": "1999 ed", "language": "EN"}\n```')[:4] == ("T", None, 1999, "en") and meta('{"year": 3000}') is None


def test_packing_breaks_at_headings():
    size = lambda n: [" ".join(["w"] * 100) for _ in range(n)]
    chunks = chunking.pack_paragraphs([*size(5), "## Heading", *size(5)], target=300, most=600, least=100, overlap=0)
    assert len(chunks) == 2 and chunks[1].startswith("## Heading")
    assert [len(c.split()) for c in chunking.pack_paragraphs(["w " * 700, "w " * 700, "w " * 700])] == [700, 1400, 1400]
    assert chunking.pack_paragraphs(None) == [] and chunking.pack_paragraphs(["a", " "]) == ["a"]


def test_semantic_operators(spark):
    from folioflow.operators import seams

    e = seams.HashedEmbedder(64)
    assert abs(float(e(["a b"])[0] @ e(["b a"])[0]) - 1) < 1e-9
    ps = ["cats purr softly " * 40, "cats purr softly " * 40, "stocks fell hard " * 40]
    got = seams.semantic_chunks_of(ps, "T", e, safe=100, least=50, hard=1000)
    assert [c["part_n"] for c in got] == [1, 2] and got[1]["text"].startswith("stocks") and got[1]["overlap"]
    assert seams.semantic_chunks_of(None, None, e) == [] and len(seams.semantic_chunks_of(["tiny"], "T", e)) == 1
    v = lambda *t: [float(x) for x in t]
    stored = spark.createDataFrame([(1, v(1, 0), 0)], "id bigint, vector array<double>, created_at int")
    fresh = spark.createDataFrame([(2, v(1, 0.01), 1), (3, v(0, 1), 2), (4, v(0.01, 1), 3), (5, v(1, 1), 4)], "id bigint, vector array<double>, created_at int")
    assert {r.id for r in seams.new_concepts(fresh, stored, 0.93).collect()} == {3, 5} and seams.new_concepts(fresh.limit(0), stored).count() == 0
    units = spark.createDataFrame([(["A", "B"], ["one", "two"]), (["A"], []), ([], None)], "path_titles array<string>, essences array<string>")
    assert [r.summary for r in seams.summaries(units, seams.echo_provider).collect()] == ["2. two", "Chapter: A", "Chapter: Body"]
    books = spark.createDataFrame([(1,)], "id int")
    asked = seams.evaluated(books, lambda prompts: ["{}" if "not valid" in p else "x" for p in prompts], F.lit("rate"), lambda c: c == "{}").first()
    assert asked.reply == "{}" and asked.valid


def test_surrogates(spark):
    from folioflow.operators import surrogates as U

    rows = [("small", 1, "One", 1, "word " * 10), ("small", 2, "", 2, "last words")] + [("big", c, f"C{c}", 10 * c + i, f"c{c} " * 200) for c in range(1, 7) for i in range(3)] + [("none", 1, "N", 1, None)]
    df = spark.createDataFrame(rows, "b string, section_order int, title string, position int, text string")
    got = {r.b: r.surrogate for r in U.surrogates(df, "b").collect()}
    assert got["none"] == "[empty book]" and "## Chapter 2" in got["small"] and got["small"].startswith("# Table of Contents\n1. One (10 words)\n2. Chapter 2 (2 words)")
    assert "# Nodal Slices" in got["big"] and "## C2" in got["big"] and "## C1\n" not in got["big"] and got["big"].count("c1 ") == 600
    assert one(spark, U.word_slice(F.lit("a b c d"), 2)) == "a b […]" and one(spark, U.word_slice(F.lit("a b c d"), 2, True)) == "c d […]"


def test_ingest(spark):
    from folioflow.operators import ingest as I

    files = [("a/b/book.pdf", 10), ("images/book.pdf", 10), ("x/readme.txt", 99_999), ("x/long.txt", 20_000), ("x/long.txt", 5), ("guide/guide to spark.html", 70_000), ("x/part 3.html", 70_000), ("forum_1/x.pdf", 9), ("solution.pdf", 9), (None, 1)]
    got = [r.candidate for r in I.candidates(spark.createDataFrame(files, "path string, size bigint")).collect()]
    assert got == [True, False, False, True, False, True, False, False, False, False] or got[:5] + got[6:] == [True, False, False, True, False, False, False, False, False]
    names = ["c10_001", "c02_002", "c02_001", "c1"]
    assert [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(I.natural_key(F.col("n"))).collect()] == ["c1", "c02_001", "c02_002", "c10_001"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("in/a.txt", "hello")
        z.writestr("../out.txt", "bad")
    got = I.unzip(spark.createDataFrame([("z", buf.getvalue()), ("q", b"no")], "path string, content binary")).collect()
    assert [(r.path, r.problem) for r in got] == [("in/a.txt", None), (None, "invalid")]
    assert I.unzip(spark.createDataFrame([("z", buf.getvalue())], "path string, content binary"), most_files=1).first().problem == "files"
    pages = [("d", f"p{i}.html", "") for i in range(1, 12)] + [("d", "index.html", '<a href="p11.html">x</a><a href="p2.html">y</a>'), ("e", "p1.html", "")]
    order = [r.name for r in I.html_books(spark.createDataFrame(pages, "folder string, name string, content string")).orderBy("place").collect()]
    assert order[:3] == ["p11.html", "p2.html", "index.html"] and order[3:5] == ["p1.html", "p3.html"] and len(order) == 12
    seg = lambda t: one(spark, I.path_segment(F.lit(t)))
    assert seg("a: b/c..") == "a_bc" and seg("...") == "_unnamed" and seg("con.txt") == "_con.txt" and len(seg("x" * 200)) == 50


def test_monitors(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, 1, t0 + timedelta(seconds=i), i < 10 or i > 40, 5.0) for i in range(80)]
    e = spark.createDataFrame(rows, "event_id int, k int, ts timestamp, ok boolean, value double")
    limits = {r.event_id: (r.limit, r.reason) for r in monitors.controller_limits(e, "k").collect()}
    assert limits[9] == (5, "increase") and any(r == "failures" for _, r in limits.values()) and all(1 <= n <= 16 for n, _ in limits.values())
    states = {r.event_id: r.state for r in monitors.breaker_states(e, "k", window=10, rest=15.0).collect()}
    assert states[5] == "closed" and states[16] == "open" and "half_open" in states.values() and states[79] == "closed"
    rate = {r.event_id: r.recent for r in monitors.rate_in_window(e, "k", 10).collect()}
    assert rate == {i: min(i, 10) + 1 for i in range(80)}
    tries = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.7), (1, 3, 0.9), (2, 1, 0.3), (2, 2, 0.3)], "k int, tier int, quality double")
    assert {r.k: (r.tier, r.quality) for r in monitors.first_good_tier(tries, "k").collect()} == {1: (2, 0.7), 2: (1, 0.3)}


def test_token_bucket(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t0 + timedelta(seconds=s)) for s in (0, 0, 0, 1, 30)], "k string, ts timestamp").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").json(f"{tmp_path}/in")
    q = monitors.token_bucket(stream, "k", 2, 0.5).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert [r.admitted for r in spark.table("bucket").orderBy("ts").collect()].count(True) == 3


def test_token_budget(spark):
    text = "One two three. " * 100
    b = one(spark, T.token_budget(F.lit(text), 100))
    assert b.trimmed and b.tokens == 375 and text.startswith(b.text) and b.text.endswith(".") and len(b.text) <= 380
    assert one(spark, T.token_budget(F.lit("short"), 100)) .text == "short" and one(spark, T.token_budget(F.lit("x" * 1000), 100)).text.endswith(" …")


def test_repair_of_lines_and_titles(spark):
    from folioflow.functions import repair as P

    ru = "Надёжный способ описывает точный прибор и новый раздел этой книги"
    assert P.repaired_line(ru.encode().decode("cp1251")) == (ru, "double_utf8")
    assert P.repaired_line(ru.encode("koi8-r").decode("cp1251")) == (ru, "koi8") or P.repaired_line(ru.lower().encode("koi8-r").decode("cp1251"))[1] == "koi8"
    assert P.repaired_line(ru.encode("cp1251").decode("latin-1")) == (ru, "latin1") and P.repaired_line(ru) == (ru, None) and P.repaired_line("café") == ("café", None)
    got = spark.createDataFrame([(None,), ("",), ("\n".join([ru.encode("cp1251").decode("latin-1")] * 5),)], "t string").select(P.repaired_lines(F.col("t")).alias("r")).collect()
    assert got[0].r is None and got[1].r.problem == "clean" and got[2].r.problem == "encoding_garble" and got[2].r.text == "\n".join([ru] * 5)
    mix = one(spark, P.mixed_scripts(F.lit("тeкст и cлово 06pa3y стр0ка чисто i")))
    assert mix.lookalikes == 2 and mix.digits == 1 and mix.confused and not one(spark, P.mixed_scripts(F.lit("чистый русский текст без примеси"))).confused
    assert P.hex_title("<" + "Книга".encode("cp1251").hex() + ">") == "Книга" and P.hex_title("<feff0041>") == "A" and P.hex_title("<abc>") is None and P.hex_title("plain") is None
    best = lambda *t: one(spark, P.best_title(*[F.lit(x).cast("string") for x in t]))
    assert best(None, "Contents", " Real ") == "Real" and best("Глава 3", None) == "Глава 3" and best("", None) is None and best("<" + "Том".encode("cp1251").hex() + ">") == "Том"


def test_stored_rows_and_books(spark, tmp_path):
    from folioflow.operators import stored as S
    from folioflow.sources import parsers as Q

    meta = S.typed_front_matter('---\nid: "a \\"b\\""\nyear: 1999\ntags: [x, "y z"]\nauthors:\n  - A\n  - B\nisFictionOrWater: true\n---\nbody')
    assert meta == {"id": 'a "b"', "year": 1999, "tags": ["x", "y z"], "authors": ["A", "B"], "isFictionOrWater": True} and S.typed_front_matter(None) == {}
    text = "x\n" + "\n".join(f"Chapter {i}. Name\nBody {i}" for i in (1, 2, 3))
    df = spark.createDataFrame([(1, text), (2, "Chapter 1. A\nb"), (3, None)], "k int, t string")
    assert [(r.title, r.body) for r in S.marked_chapters(df, "k", "t").collect()] == [(f"Chapter {i}. Name", f"Body {i}") for i in (1, 2, 3)]
    secs = spark.createDataFrame([(1, 1, 3, "Stray", ["s"]), (1, 2, 1, "One", ["a"]), (1, 3, 3, "Deep", ["b"]), (1, 4, 2, None, [])], "k int, section_order int, level int, title string, paragraphs array<string>")
    assert {r.title: r.paragraphs for r in S.folded_chapters(secs, "k").filter("chapter_no > 0").collect()} == {"One": ["a", "### Deep", "b"], "Body": []}
    blobs = spark.createDataFrame([(b"x",), (b"x",), (b"y",), (None,)], "content binary")
    assert S.put_blobs(blobs, f"{tmp_path}/b").count() == 2 and S.put_blobs(blobs, f"{tmp_path}/b").count() == 2 and spark.read.parquet(f"{tmp_path}/b").count() == 2
    note = spark.range(1).select(S.cut_metadata(F.map_from_arrays(F.array(*[F.lit(f"k{i}") for i in range(60)]), F.array(*[F.lit("v" * 400)] * 60))).alias("x")).first().x
    assert '"keysDropped":20' in note and len(note) < 8000
    assert Q.merged_headings([(1, "A", []), (1, "B", ["x"]), (1, "C", [])]) == [(1, "A / B / C", ["x"])] and Q.merged_headings([]) == []
    assert one(spark, T.isbns(F.lit("0-306-40615-2 and 978-0-306-40615-7, 978-3-16-148410-0"))) == ["9780306406157", "9783161484100"]


def test_api(spark, tmp_path):
    from folioflow import api
    from folioflow.operators import seams

    e = seams.HashedEmbedder(64)
    texts = ["saturn rocket engine", "moon landing", "garden flowers", "saturn rings"]
    chunks = spark.createDataFrame([(i, "u", i % 2, t, e([t])[0].tolist()) for i, t in enumerate(texts)], "id bigint, user_id string, level int, text string, vector array<double>")
    triples = spark.createDataFrame([("Saturn V", "reaches", "Moon", 1, 1), ("Flower", "in", "Garden", 2, 2)], "subject string, predicate string, object string, seq int, source bigint")
    ents, rels = graph.ingest_relations(triples)
    got = api.search_chunks(chunks, ents, rels, "saturn rocket", e, user="u", limit=4).collect()
    assert got[0].id == 0 and {r.id: r.graph > 0 for r in got}[1] and [r.id for r in got].index(1) < [r.id for r in got].index(2)
    plain = api.search_chunks(chunks, ents, rels, "saturn rocket", e, user="u", limit=4, beta=0, level=0).collect()
    assert [r.id for r in plain][0] == 0 and {r.id for r in plain} <= {0, 2} and api.search_chunks(chunks, ents, rels, "x", e, user="nobody").count() == 0
    concepts = chunks.selectExpr("id", "user_id", "'c' AS collection_name", "vector")
    assert api.search(concepts, "moon landing", e, user="u", limit=1).first().id == 1 and api.collections(concepts, "u").first().concepts == 4
    rows = spark.createDataFrame([("a", "u", "c", True, 2, '{"essence": "E", "domain": "ai", "proof": "P"}'), ("b", "u", "c", True, 1, "broken"), ("d", "u", "c", False, 0, "{}")], "id string, user_id string, collection_name string, accepted boolean, created_at int, payload string")
    assert api.export_dataset(rows, f"{tmp_path}/j", user="u", collection="c") == (1, 1) and spark.read.json(f"{tmp_path}/j").first().conceptId == "a"
    assert api.export_dataset(rows, f"{tmp_path}/s", user="u", collection="c", form="sharegpt") == (3, 1)
    assert api.export_dataset(rows, f"{tmp_path}/t", user="u", collection="c", form="chatml")[0] == 3 and "<|im_start|>system" in spark.read.json(f"{tmp_path}/t").first().text
    books = spark.createDataFrame([(str(i), f"T{i}", 5, "indexed") for i in range(5)], "id string, title string, quality_score int, status string")
    page, total = api.catalogue_page(books, least_quality=5, order="title", limit=2)
    assert [r.id for r in page.collect()] == ["0", "1"] and total == 5
    page, last = api.next_page(books, ["indexed"], "1", 2)
    assert last == "3" and api.next_page(books, ["indexed"], last, 2)[1] is None
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text('---\nid: "1"\ntitle: "T"\nyear: 1999\ntags: [x, y]\n---\nbody')
    (tmp_path / "md" / "b.md").write_text("no front matter")
    made = api.catalogue_from_files(spark, f"{tmp_path}/md").collect()
    assert [(r.id, r.title, r.year, r.tags) for r in made] == [("1", "T", 1999, "x,y")]


def test_cut_tables_are_released(spark):
    from folioflow import session

    df = session.cut(spark.range(3))
    path = session._WRITTEN[-1]
    assert df.count() == 3 and session.release(spark) >= 1 and not session._WRITTEN
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)
