"""Operators for training data against brute force, exact round trips and edge cases, without Spark where none is needed."""

import itertools
import random

import numpy as np
import pytest

from folioflow.llm import encoding, names, overlap, packing, pairs, scans, splitting
from folioflow.llm.boosting import Boosted
from folioflow.llm.language import LanguageModel
from folioflow.llm.mixing import flight, landing, plan

RU = "Надёжный способ описывает точный прибор. Простой закон объясняет новый раздел книги. Это не так, как было раньше. "
EN = "The reliable method describes the exact device. A simple law explains the new section of the book. This is not as it was. "
DE = "Das zuverlässige Verfahren beschreibt das genaue Gerät. Ein einfaches Gesetz erklärt das neue Kapitel. Das ist nicht so, wie es war. "
UK = "Надійний спосіб описує точний прилад. Простий закон пояснює новий розділ книги. Це не так, як було раніше. "


@pytest.mark.parametrize("seed", range(40))
def test_split_points_hold_limit_overlap_and_cover(seed):
    r = random.Random(seed)
    text = "".join(r.choice("abcdefg   .,\n") for _ in range(r.randint(0, 2500)))
    limit = r.randint(12, 400)
    overlap_ = r.randint(0, limit // 2)
    spans = splitting.split_points(text, limit, overlap_)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(e - s <= limit for s, e in spans)
    assert all(b[0] == a[1] - overlap_ for a, b in itertools.pairwise(spans))


def test_split_prefers_paragraphs():
    text = "a" * 90 + "\n\n" + "b" * 95
    assert splitting.split_points(text, 110, 0)[0][1] == 92


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="smaller"):
        splitting.split_points("x" * 30, 10, 10)


COST = encoding.GarblingCost([RU * 5, EN * 5, DE * 5, UK * 5])


@pytest.mark.parametrize(("right", "wrong", "text"), [("utf-8", "cp1252", DE), ("utf-8", "cp1251", RU), ("cp1251", "latin-1", RU), ("cp1251", "koi8-r", RU), ("koi8-r", "cp1251", RU), ("cp866", "cp1251", RU), ("cp1252", "mac_roman", DE)])
def test_round_trip_restores(right, wrong, text):
    garbled = text.encode(right).decode(wrong, "replace")
    if "�" in garbled:
        pytest.skip("this pair loses bytes")
    out, steps, lost = encoding.repair_text(garbled, COST)
    assert out == text and steps and not lost


def test_nested_layers_and_clean_texts():
    twice = DE.encode().decode("cp1252").encode().decode("cp1252", "replace")
    assert encoding.repair_text(twice, COST)[0] == DE
    for clean in (RU, EN, DE, UK, "", None, "x ± 2 µm, 5 °C, §7"):
        assert encoding.repair_text(clean, COST) == (clean, [], False)
    assert encoding.repair_text("sch�ma", COST)[2]


def test_language_model_separates_relatives():
    m = LanguageModel([(RU * 8, "ru"), (UK * 8, "uk"), (EN * 8, "en"), (DE * 8, "de")])
    for text, want in ((RU, "ru"), (UK, "uk"), (EN, "en"), (DE, "de")):
        lang, sure = m.decide(m.sums([text.replace(".", "").split()]))
        assert lang[0] == want and sure[0] > 0.5
    assert m.decide(m.sums([[]]))[0][0] is None


def test_boosting_learns_a_threshold_and_takes_no_rows():
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 1] > 0.3).astype(int)
    b = Boosted(x, y, trees=15)
    assert ((b.probability(x) > 0.5) == y).mean() > 0.97 and len(b.probability(np.zeros((0, 3)))) == 0


def test_index_counts_every_window():
    r = random.Random(1)
    records = [[ord(r.choice("abcd")) for _ in range(r.randint(0, 12))] for _ in range(30)]
    index = overlap.TextIndex.build([np.array(x, np.int64) for x in records])
    for w in itertools.product(map(ord, "abcde"), repeat=3):
        lo, hi = index.backward(index.numbers(np.array(w, np.int64)), np.array([3]), np.array([3]))
        assert hi[0] - lo[0] == sum(tuple(rec[i : i + 3]) == w for rec in records for i in range(len(rec) - 2))


@pytest.mark.parametrize("seed", range(4))
def test_alignment_of_batches_matches_brute_force(seed):
    r = np.random.default_rng(seed)
    texts = [r.integers(1, 6, r.integers(1, 30)) for _ in range(80)]
    a, b = texts[:40], texts[40:]
    wide = lambda xs, pad: np.array([np.pad(x, (0, 30 - len(x)), constant_values=pad) for x in xs], np.int32)
    n, m = np.array(list(map(len, a))), np.array(list(map(len, b)))
    allowed = np.maximum(n, m) // 2
    got = overlap.aligned(wide(a, -1), wide(b, -2), n, m, allowed)
    covered, _ = overlap.merged_matches(wide(a, -1), wide(b, -2), n, allowed)
    for x, y, d, most, c in zip(a, b, got, allowed, covered, strict=True):
        want = overlap.edits_within(x.tolist(), y.tolist(), int(most))
        assert (int(d) if d <= most else None) == want and (want is None or c >= len(x) - most)


def test_folding_of_words():
    assert overlap.words_of("<b>Die</b> GRÖSSE – «x»") == overlap.words_of("die größe x") == ["die", "grosse", "x"]
    assert overlap.words_of(None) == []


def test_names_align():
    forms = names.Forms([("Edward", "Ted"), ("Edward", "Эдвард")])
    parse = lambda n: names.parse(n, forms)
    assert parse("Dr Edward Rozhekegard") == parse("ROZHEKEGARD, EDWARD") == {"kind": "person", "main": "rozhekegard", "parts": ["edvard"]}
    assert parse("Рожекегард Эдвард")["main"] == "rozhekegard"
    assert {parse(x)["kind"] for x in ("Unknown", "-", "", "Неизвестный автор")} == {"nobody"} and parse(None)["kind"] == "nobody"
    assert parse("«Хофешиле», конструкторское бюро")["parts"] == parse("Khofeshile Design Bureau")["parts"]
    assert names.resolve([["edvard"], ["e."], ["ted"], ["viktoria"]], forms)[:3] == [0, 0, 0] or len(set(names.resolve([["edvard"], ["e."], ["ted"], ["viktoria"]], forms))) == 2


def test_deletes_meet_within_two_edits():
    a, b = "rozhekegard", "rozhekegpard"
    assert set(names.deletes(a)) & set(names.deletes(b)) and names.close_enough(a, b)
    assert names.edit_distance("abcd", "abdc", 2) == 1


def test_pair_defects():
    m = LanguageModel([(RU * 8, "ru"), (EN * 8, "en"), (DE * 8, "de"), (UK * 8, "uk")])
    ends = pairs.EndModel({"device": 3}, {"the": 9})
    q = "How does the law explain the section of the book?"
    check = lambda a, **k: pairs.defect(k.get("q", q), a, k.get("s"), m, ends, k.get("cut", False))
    assert {check(a) for a in (None, "", " \n", "N/A", "<br>", "​", "...")} == {"empty_answer"}
    assert check("I'm sorry, but I cannot help with that request.") == "refusal"
    assert check("how does the law explain the section of the book") == "copied_question"
    assert check("> " + q + "\n" + q) == "copied_question"
    assert check(DE) == "other_language" and check(DE, s="Answer in German.") is None
    assert check(EN.strip() + " The simple law") == "truncated_answer"
    assert check(EN.strip()) is None and check(EN.strip(), cut=True) == "truncated_answer"
    assert check(EN + "```\nx = 1") == "truncated_answer" and check(EN + "\n- the device") is None and check(EN + "\n- the") == "truncated_answer"


def test_raw_replies():
    good = '<think>x</think>```json\n{"pairs": [{"question": "A?", "answer": "B \\"c\\"."}, {"question": "D?", "answer": null}]}\n```'
    got = pairs.raw_pairs(good)
    assert [(p["question"], p["answer"], p["cut"]) for p in got] == [("A?", 'B "c".', False), ("D?", None, False)]
    assert pairs.raw_pairs('{"pairs": [{"question": "A?", "answer": "B c')[0]["cut"]
    assert pairs.raw_pairs(None) == [] and pairs.raw_pairs("no json") == []
    assert pairs.raw_pairs('{\\"pairs\\": [{\\"question\\": \\"A?\\", \\"answer\\": \\"B.\\"}]}')[0]["answer"] == "B."
    assert pairs.chat_pairs(None) == [] and pairs.chat_pairs([{"role": "user", "content": "q"}])[0]["answer"] is None


def test_packing_fills_and_keeps_every_item():
    r = random.Random(3)
    for _ in range(30):
        cap = r.randint(10, 80)
        sizes = [r.randint(0, cap) for _ in range(r.randint(0, 60))]
        bins = packing.pack_sizes(sizes, cap)
        sums = {b: sum(s for s, x in zip(sizes, bins, strict=True) if x == b) for b in set(bins)}
        assert len(bins) == len(sizes) and all(v <= cap for v in sums.values())
    with pytest.raises(ValueError, match="larger"):
        packing.pack_sizes([11], 10)


def test_fullest_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        items = [r.randint(1, 12) for _ in range(r.randint(1, 8))]
        cap = r.randint(max(items), 30)
        available = {s: items.count(s) for s in items}
        got = packing.fullest(available, cap, max(items))
        rest = sorted(items)
        rest.remove(max(items))
        best = max(sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) <= cap - max(items))
        assert sum(got) == best + max(items) and all(got.count(s) <= available[s] for s in got)


def test_flight_keeps_balances_and_lands():
    r = np.random.default_rng(5)
    size = r.integers(1, 500, 300).astype(float)
    p = r.random(300)
    x = np.stack([size / size.max(), np.ones(300)])
    q = flight(p, x, 1)
    assert abs((q * size).sum() - (p * size).sum()) < 1e-3 * size.sum() and ((q > 0) & (q < 1)).sum() <= 2
    done = landing(q, x, 1)
    assert set(np.unique(done)) <= {0.0, 1.0}
    assert plan({}, {"a": (0.5, 1)}) == {"a": 0.0}


def test_scan_noise_of_a_page():
    words = {w: 400 for w in ("the", "early", "protocol", "describes", "edition", "of", "kernel", "reliable", "filter", "and", "matrix")}
    text = " ".join(["The early protocol describes the reliable edition of the kernel and the filter of the matrix."] * 4)
    model = scans.model_of(words, ["zubrun", "kastil"], [(text, ["The hidden matrix"]) for _ in range(60)])
    page = "The early protocol describes the reli-\nable edition of the kcrnel and the\nTHE HIDDEN MATRIX    17\nfilter of the matrix."
    lines, noise = scans.line_noise(page, ["The hidden matrix"], model)
    assert noise.header == [2] and noise.page_no == [2] and noise.hyphens == [(0, 1)]
    assert scans.repaired_text(page, ["The hidden matrix"], model) == "The early protocol describes the reliable edition of the kernel and the filter of the matrix."
    assert scans.repaired_text(None, None, model) is None and scans.repaired_text("", [], model) == ""
    assert scans.page_number("- 17 -") and scans.page_number("xvii") and not scans.page_number("17 pages of text")


def test_misread_nouns_inside_a_line():
    text = "Das innere Ergebnis beschreibt das System. Die neutrale Temperatur misst der Apparat. Das alte Lehrbuch nennt das Modell und die Lösung. " * 3
    words = {w: 40 for w in set(text.replace(".", "").lower().split())}
    model = scans.model_of(words, ["Zubrun", "kastil", "Mokwark"], [(text, ["Das Modell"]) for _ in range(60)])
    page = "Hier misst das Ergebiiis der Apparat und das Lebrbuch des Herrn Zubrun."
    assert scans.repaired_text(page, ["Das Modell"], model) == "Hier misst das Ergebnis der Apparat und das Lehrbuch des Herrn Zubrun."
    joined = scans.suspects(["Das misst die Tem-", "perafur der Apparat."], scans.LineNoise([], [], [(0, 1)]), model)
    assert joined == [("Temperafur", False)] and model.corrections(joined, [1])[0][0] == "Temperatur"


def test_text_index_finds_what_brute_force_finds():
    r = random.Random(3)
    base = [[r.randrange(60) for _ in range(r.randint(1, 45))] for _ in range(25)]

    def variant(words):
        w = list(words)
        for _ in range(r.randint(0, 1 + len(w) // 6)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = [r.randrange(60) for _ in range(r.randint(0, 1))]
        return w or [1]

    held = [list(x) for x in sorted({tuple(variant(r.choice(base))) for _ in range(150)})]
    asked = [list(x) for x in sorted({tuple(variant(r.choice(base))) for _ in range(150)})]
    index = overlap.TextIndex.build([np.array(x, np.int64) for x in held])
    assert [index.texts[i][: index.sizes[i]].tolist() for i in range(len(held))] == [(index.numbers(np.array(x)) if x else np.array([])).tolist() for x in held]
    flat, sizes = np.array([w for x in asked for w in x], np.int64), np.array([len(x) for x in asked])
    sketch = np.zeros(1 << 12, np.uint16)
    heldflat, heldsizes = np.array([w for x in held for w in x], np.int64), np.array([len(x) for x in held])
    for h, ok in overlap.window_hashes(heldflat, heldsizes).values():
        np.add.at(sketch, h[ok] & (len(sketch) - 1), 1)
    row, start, length, _ = overlap.choose_seeds(flat, sizes, sketch)
    got = index.search(flat, sizes, row, start, length)
    want = {(i, j): d for i, a in enumerate(asked) for j, b in enumerate(held) if (d := overlap.edits_within(a, b, max(len(a), len(b)) // 6)) is not None}
    assert {(int(q), int(k)): int(e) for q, k, e in zip(got["query"], got["record"], got["edits"], strict=True)} == want


@pytest.mark.parametrize("seed", range(6))
def test_quick_look_misses_nothing_the_pattern_finds(seed):
    r = random.Random(seed)
    alphabet = "abzAZ яжЯЖёЁіїҐ éàÀÞÿôöùûЧЦ ‘’“”„«»°±§· .,!?\n\t09_-�×\x85𝒳漢"
    texts = [None, "", *("".join(r.choice(alphabet) if r.random() < 0.3 else r.choice("abc зик  .") for _ in range(r.randint(1, 14))) for _ in range(3000))]
    texts += ["two ôreadingsö support", "sensor Ч the ritual", "a ù b", "ôter", "Ьbersicht", "plain Text, schön"]
    array = encoding.pa.array(texts)
    bad = [bool(x) for _, _, _, _, slice_ in encoding._looked_at(array) for x in slice_]
    assert len(bad) == len(texts)
    missed = [t for t, b in zip(texts, bad, strict=True) if t and encoding._SUSPECT.search(t) and not b]
    assert not missed
    assert not any(bad[i] for i, t in enumerate(texts) if t in ("plain Text, schön", "", None))


def test_counted_pairs_give_the_same_costs(spark):
    texts = [RU, EN, DE, UK, "sch�ma", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert encoding.fit_cost(df).bits == pytest.approx(encoding.GarblingCost([t for t in texts if t]).bits)


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_the_cheapest(seed):
    r = random.Random(seed)
    n = r.randint(1, 5)
    m = r.randint(n, 6)
    costs = [[r.choice((0.0, 0.1, 0.3, 1e6)) + r.random() for _ in range(m)] for _ in range(n)]
    got = names.assignment(costs)
    want = min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    assert len(set(got)) == n and sum(costs[i][j] for i, j in enumerate(got)) == pytest.approx(want)


def test_all_parts_must_have_a_place():
    forms = names.Forms([])
    four = ["anna", "boris", "karl", "diana"]
    assert names.align([*four, "zzzzz"], [*four, "qqqqq"], forms) is None and names.align([*four, "eva"], ["eva", *four], forms) is not None
    assert names.align(["boris"], ["anna", "boris"], forms) is None and names.align(["anna"], ["anna", "boris"], forms) is not None
    assert names.close_enough("ivan", "ivani") == 1 and names.close_enough("ivan", "oleg") is None


def test_landing_meets_balances_and_probabilities():
    r = np.random.default_rng(1)
    size = np.sort(r.lognormal(6, 1, 66))[::-1]
    x = np.stack([size / size.max(), np.ones(66)])
    p = np.full(66, 0.37)
    runs = np.array([landing(p, x, seed) for seed in range(300)])
    assert set(np.unique(runs)) <= {0.0, 1.0} and np.abs(runs @ size - p @ size).max() < 0.01 * size.sum() and np.abs(runs.sum(1) - p.sum()).max() < 3
    assert abs(runs.mean() - 0.37) < 0.02 and abs(runs[:, :33].mean() - 0.37) < 0.04
    assert set(landing(np.array([0.5]), x[:, :1], 1)) <= {0.0, 1.0} and landing(p[:0], x[:, :0], 1).size == 0
