"""Garbled text, near-duplicates, packing, leaks and subjects: fixtures, brute force, round trips, held-out accuracy."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import contamination, garbled, near_duplicates, packing, subjects

TEXTS = {
    "fr": "Le marché a été déplacé très tôt à Nîmes, où 204 personnes attendaient déjà près du côté étroit.", "de": "Die größere Fähre prüfte öffentlich die Straße, und früher zählte Köln die Gärten.", "es": "El señor midió el túnel aún más; según Íñigo, era un bono cómodo.",
    "ru": "Один хрупкий скрипт стоит 68, говорит Замнев, а вокзал отметил браузер.", "pl": "Źródło późny próżny skóra żółty święto szczęście książka.", "ja": "地図の新聞と資料と計画を地図の報告は8です。", "en": "“What he saw was a cache”, says Zoë, who wouldn’t pay £74 – not one.",
}
WRONG = [
    ("fr", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("de", "utf-8", "mac_roman"), ("es", "utf-8", "cp437"), ("de", "utf-8", "cp1251"), ("ru", "utf-8", "cp1251"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "cp1251"), ("pl", "cp1250", "cp1252"), ("pl", "iso8859-2", "cp1252"), ("ja", "shift_jis", "cp1252"), ("ja", "euc_jp", "latin-1"),
    ("fr", "cp1252", "mac_roman"), ("en", "utf-8", "cp1252"), ("en", "cp1252", "latin-1"), ("es", "cp1252", "cp1251"), ("pl", "utf-8", "iso8859-2"),
]


def misread(text, written, read):
    raw = text.encode(written, "ignore")
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize("lang,written,read", WRONG)
def test_garbled_text_is_found_and_restored(lang, written, read):
    bad = misread(TEXTS[lang], written, read)
    assert bad != TEXTS[lang]
    found, text, _ = garbled.judge_body(f"{TEXTS['en']}\n{bad}\n{TEXTS['en']}")
    assert found
    same = sum(a == b for a, b in zip(text.split("\n")[1], TEXTS[lang])) / len(TEXTS[lang])
    assert same > 0.9, (text, garbled.repair(bad))


def test_twice_garbled_and_escaped():
    twice = misread(misread(TEXTS["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert garbled.judge_body(twice)[:2] == (True, TEXTS["fr"])
    entities = "".join(c if c.isascii() else f"&#{ord(c)};" for c in misread(TEXTS["de"], "utf-8", "cp1252"))
    assert garbled.judge_body(f"<p>{entities}</p>")[:2] == (True, f"<p>{TEXTS['de']}</p>")
    escapes = "".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in misread(TEXTS["ru"], "utf-8", "cp1251"))
    assert garbled.judge_body('{"a": "' + escapes + '"}')[0]


def test_losses_are_found():
    assert garbled.judge_body(TEXTS["es"].encode("cp1252").decode("utf-8", "replace"))[0]
    assert garbled.judge_body(TEXTS["fr"].encode("ascii", "replace").decode())[0]
    assert garbled.judge_body(TEXTS["ru"].encode("ascii", "replace").decode())[0]


SOUND = [*TEXTS.values(), "Â gặp Hoa tại Hà Nội, uống 5 cốc trà và nói về đường phố.", "SÃO PAULO: A COMISSÃO ADIOU A VOTAÇÃO. Às 4 horas.", "Það var ð og þ í orði, en Ísland hafa bæði Æ og Ö.", "The symbol � marks a character that could not be read.", "He sees Ã© where the writer meant é. Nothing else is wrong.",
         "Box drawing signs ├ ┤ ┬ and the root sign √ here.", "În oraș a cântat până când a început să plângă.", "Why? Because. https://a.example/b?c=d&e=f What?", "", "Íñíñíñ en Íñver", "“café” – naïve… ‘été’ «à» 5 €, 20°C, ½, §4"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert garbled.judge_body(text) == (False, text, 0)


def test_cut_ends_are_no_cases():
    assert not garbled.judge_body("Die Brücke wiederholte die gro�", True)[0]
    assert garbled.judge_body("Die Br�cke wiederholte die gro�e", True)[0]


def test_garbled_table(spark):
    rows = [(1, TEXTS["fr"], False), (2, misread(TEXTS["fr"], "utf-8", "cp1252"), None), (2, misread(TEXTS["fr"], "utf-8", "cp1252"), None), (3, None, None), (4, "", True), (None, "Ã©Ã©", False), (5, "word " * 200_000 + misread(TEXTS["ru"], "koi8-r", "cp1251"), False)]
    df = spark.createDataFrame(rows, "response_id bigint, body string, truncated boolean").withColumn("passages", F.lit("clash"))
    assert sorted(r.response_id for r in garbled.find_garbled(df).collect()) == [2, 5]
    assert garbled.find_garbled(df.where("false")).count() == 0


# ---- near-duplicates

WORDS = [f"w{k}" for k in range(400)]


def brute_pairs(texts, words, t):
    sets = {i: set(near_duplicates.shingle_hashes([x], words).tolist()) for i, x in texts.items()}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def family(rng, n, base=60):
    out = {}
    for i in range(n):
        if i and rng.random() < 0.5:
            w = out[rng.randrange(i)].split()
            for _ in range(rng.randrange(0, 14)):
                if not w:
                    break
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.sample(WORDS, rng.randrange(2))
            out[i] = " ".join(w)
        else:
            out[i] = " ".join(rng.choices(WORDS, k=rng.randrange(0, base)))
    return out


@pytest.mark.parametrize("words,t,seed", [(3, 0.6, 1), (3, 0.6, 2), (5, 0.8, 3), (2, 0.5, 4)])
def test_pairs_agree_with_brute_force(spark, words, t, seed):
    texts = family(random.Random(seed), 150)
    table = near_duplicates.shingle_table(spark.createDataFrame(list(texts.items()), "id bigint, text string"), lambda x: [x], words)
    pairs, members = near_duplicates.similar_pairs(table, t)
    got = {(r.page_a, r.page_b) for r in near_duplicates.expand_pairs(pairs, members).collect()}
    assert got == brute_pairs(texts, words, t)


def test_hot_tiles_are_split_without_loss(spark):
    texts = family(random.Random(9), 80, base=25)
    texts |= {1000 + k: f"the same few common words stand here number {k % 9}" for k in range(60)}
    table = near_duplicates.shingle_table(spark.createDataFrame(list(texts.items()), "id bigint, text string"), lambda x: [x], 3).persist()
    first = table.groupBy("whole").agg(F.min("id").alias("id"))
    sets = table.join(first.select("id"), "id", "left_semi")
    want = {p for p in brute_pairs(texts, 3, 0.6) if {*p} <= {r.id for r in first.collect()}}
    counts = near_duplicates.rarity(sets)
    counts[:] = 40  # every tile counts as large
    candidates = near_duplicates.candidate_pairs(sets, 0.6, counts=counts, tile_rows=7)
    near_duplicates_room = near_duplicates.verified_pairs(candidates, sets, 0.6, blocks=3)
    assert {(r.a, r.b) for r in near_duplicates_room.collect()} == want
    table.unpersist()


def test_more_blocks_than_a_few_lose_nothing(spark):
    """Beyond FEW_BLOCKS blocks (131,072 records) signatures go only where their record has pairs."""
    texts = family(random.Random(5), 120)
    table = near_duplicates.shingle_table(spark.createDataFrame(list(texts.items()), "id bigint, text string"), lambda x: [x], 3).persist()
    first = table.groupBy("whole").agg(F.min("id").alias("id"))
    sets = table.join(first.select("id"), "id", "left_semi")
    want = {p for p in brute_pairs(texts, 3, 0.6) if {*p} <= {r.id for r in first.collect()}}
    got = near_duplicates.verified_pairs(near_duplicates.candidate_pairs(sets, 0.6), sets, 0.6, blocks=near_duplicates.FEW_BLOCKS + 1)
    assert want and {(r.a, r.b) for r in got.collect()} == want
    table.unpersist()


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300), st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300), st.integers(0, 200))
def test_bitmaps_bound_from_above(a, b, shared):
    b = b | set(list(a)[:shared])
    x, y = (np.array(sorted(s), dtype=np.int64) for s in (a, b))
    most = min(len(a) - near_duplicates._outside(near_duplicates.signature(x), near_duplicates.signature(y)), len(b) - near_duplicates._outside(near_duplicates.signature(y), near_duplicates.signature(x)))
    assert most >= len(a & b)


def test_groups_of_copies(spark):
    rows = [(k, "one two three four five six seven") for k in range(200)] + [(500, "one two three four five six seven eight"), (501, "nine ten eleven twelve"), (501, "nine ten eleven twelve"), (None, "one two three"), (502, None), (503, ""), (504, "a b")]
    table = near_duplicates.shingle_table(spark.createDataFrame(rows, "id bigint, text string"), lambda x: [x or ""], 3)
    pairs, members = near_duplicates.similar_pairs(table, 0.6)
    got = {(r.page_a, r.page_b) for r in near_duplicates.expand_pairs(pairs, members).collect()}
    assert got == {(0, k) for k in range(1, 200)} | {(0, 500)}
    small = near_duplicates.expand_pairs(pairs, members, whole_groups=300).distinct().count()
    assert small == 200 * 199 // 2 + 200
    empty = near_duplicates.shingle_table(spark.createDataFrame([], "id bigint, text string"), lambda x: [x], 3)
    assert near_duplicates.expand_pairs(*near_duplicates.similar_pairs(empty, 0.6)).count() == 0


def test_only_garbled_passages_change():
    sound, bad = "caf&eacute; &copy; 2020 &#8364;5 \\u00e9t\\u00e9", misread("Un été très long à Nîmes", "utf-8", "cp1252")
    body = f"<p>{sound}</p><p>{bad}</p><p>{bad} and more of it</p>"
    found, text, changed = garbled.judge_body(body)
    assert found and changed == 2 and text.startswith(f"<p>{sound}</p><p>Un été très long à Nîmes</p>")
    assert garbled.judge_body(f"<p>{sound}</p>") == (False, f"<p>{sound}</p>", 0)
    assert garbled.judge_body(f"<p>{bad}</p>", charset="windows-1252")[1] == "<p>Un été très long à Nîmes</p>" == garbled.judge_body(f"<p>{bad}</p>", charset="nonsense")[1]
    # one loss in each of several passages
    assert garbled.judge_body("<p>Le march? a ouvert</p><p>un caf?s ferm</p><p>la for?t verte</p>")[0] and not garbled.judge_body("<p>Why?no idea</p>")[0]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aéÃ©Â±?ž™РЂвà³√├Łą\ufffd ")), max_size=30))
def test_class_tables_lose_nothing_that_the_screen_finds(text):
    assert garbled._suspicious(text) == (garbled._SCREEN.search(text) is not None)


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=24), st.integers(1, 6))
def test_buckets_are_optimal(counts, most):
    histogram = np.array([0, *counts])
    uppers = packing.choose_buckets(histogram, most)
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        assert len(uppers) == 0
        return
    assert len(uppers) == min(most, len(lengths)) and uppers[-1] == lengths[-1]  # the budget is used to the full

    def padding(ends):
        at = np.searchsorted(ends, lengths)
        return int(((np.array(ends)[at] - lengths) * histogram[lengths]).sum())

    best = {(): 0}
    n = len(lengths)
    cost = np.full((most + 1, n + 1), np.inf)
    cost[0, 0] = 0
    for k in range(1, most + 1):
        for i in range(1, n + 1):
            cost[k, i] = min(cost[k - 1, j] + sum((lengths[i - 1] - lengths[m]) * histogram[lengths[m]] for m in range(j, i)) for j in range(i))
    assert best and padding(uppers) <= min(cost[: len(uppers) + 1, n]) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.integers(50, 90))
def test_plans_place_every_piece_once(rows, capacity):
    rows.sort()
    uppers, counts = (np.array(x) for x in zip(*rows))
    plan = packing.plan_containers(uppers, counts, capacity)
    fill = np.zeros(plan.containers, dtype=int)
    for u, n, slots in zip(uppers, counts, plan.slots):
        ends = [s[0] for s in slots[1:]] + [n]
        for (start, first, each), end in zip(slots, ends):
            for r in range(start, end):
                fill[first + (r - start) // each] += u
    assert fill.max() <= capacity and (fill > 0).all() and fill.sum() == (uppers * counts).sum()
    assert plan.containers <= 2 * -(-int(fill.sum()) // capacity) + 1


def test_packing(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice((3, 17, 60, 100, 130, 250, 999))) for k in range(900)] + [(2000 + k, 55) for k in range(600)] + [(1, 17), (3000, 0)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), [("s", 100), ("l", 300)], max_buckets=20).collect()
    for name, capacity in (("s", 100), ("l", 300)):
        own = [r for r in packed if r.container_kind == name]
        assert sum(r.n_tokens for r in own) == sum(n for _, n in rows)
        fill: dict = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            assert r.piece == 0 or r.first_token == r.piece * capacity
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert sum(fill.values()) > 0.85 * capacity * len(fill)
        cut = {r.doc_id for r in own if r.piece}
        assert cut == {i for i, n in rows if n > capacity}
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), [("s", 100)]).count() == 0


def test_tokens_are_counted_by_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world, hello again."), (2, ""), (3, None), (None, "x"), (4, "слово " * 50)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(df).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and 5 <= got[1] <= 9 and got[4] >= 50


# ---- leaks


def brute_leaks(docs, items):
    n = contamination.WORDS
    seen: dict = {}
    for i, x in items.items():
        w = contamination.words_of(x or "")[0]
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, x in docs.items():
        w = contamination.words_of(x or "")[0]
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in seen.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark):
    base = "In 1998 Anna Kowalska measured twelve barrels near the harbour of Lisbon and found that 40 km of rope cost 300 euros per month in total"
    items = {1: f"Question. {base}?", 2: f"Other start, then {base} and an end", 3: "too short to leak", 4: None, 5: ""}
    docs = {
        10: f"Intro. {base}. Outro.", 11: base.upper(), 12: base.replace("a", "á").replace("measured", "mea­sured"), 13: " ".join(base.split()[:12]), 14: " ".join(base.split()[3:16]), 15: base.replace("1998", "2011").replace("Anna Kowalska", "Peter Novak").replace("40", "77").replace("300", "512"),
        16: base.replace("barrels", "crates"), 17: None, 18: "", 19: ("x y z " * 50_000) + base, 20: base.replace(" ", "-"),
    }
    d = spark.createDataFrame([*docs.items(), (10, docs[10]), (None, base)], "doc_id bigint, text string").withColumn("slots", F.lit("clash"))
    windows = contamination.leak_windows(d, spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    got = contamination.leaks(windows)
    assert {(r.doc_id, r.item_id) for r in got.where("literal > 0").collect()} == brute_leaks(docs, items)
    changed = {r.doc_id for r in got.where("literal = 0 and changed > 0").collect()}
    assert 15 in changed and 13 not in changed
    unscreened = contamination.leak_windows(d, spark.createDataFrame(list(items.items()), "item_id bigint, text string"), max_screen=0)
    assert sorted(map(str, unscreened.collect())) == sorted(map(str, windows.collect()))
    assert contamination.leak_windows(d.where("false"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).count() == 0
    assert contamination.leak_windows(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_slots_must_agree_over_a_whole_passage(spark):
    """A mapping that contradicts itself in another window of the same alignment is chance; a short item is found as a whole."""
    item = "A train with 40 seats leaves Warsaw at 7 and meets another train with 40 seats from Gdynia at 9 near the old bridge"
    items = spark.createDataFrame([(1, item), (2, "Where does the grey lamp of Torun stand?"), (3, "Two words")], "item_id bigint, text string")
    docs = [
        (1, item.replace("40", "52").replace("Warsaw", "Lublin").replace("Gdynia", "Poznan")), (2, item.replace("40 seats leaves", "52 seats leaves").replace("40 seats from", "61 seats from")),
        (3, item + ". " + item.replace("40", "52") + ". " + item.replace("40", "77")), (4, "Asked: where does the grey lamp of Krakow stand? Nobody knew."), (5, "Where does the grey lamp stand?"), (6, "Two words"),
    ]
    got = {(r.doc_id, r.item_id): r for r in contamination.leaks(contamination.leak_windows(spark.createDataFrame(docs, "doc_id bigint, text string"), items)).collect()}
    assert got[1, 1].changed > 0 and got[1, 1].chance == got[1, 1].literal == 0
    assert got[2, 1].chance > 0 and got[2, 1].changed == 0
    assert got[3, 1].literal > 0 and got[3, 1].changed > 0 and got[3, 1].chance == 0
    assert got[4, 2].short == 1 and got[4, 2].literal == 0 and set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words_are_reduced(s):
    low, as_is = contamination.words_of(s)
    assert len(low) == len(as_is) and all(w for w in low)
    assert contamination.words_of(s.upper())[0] == [w for w in contamination.words_of(s.upper().casefold())[0]]


# ---- subjects


def test_bisecting_kmeans_separates_groups():
    rng = np.random.default_rng(3)
    ptr, idx, val = [0], [], []
    truth = []
    for k in range(200):
        g = k % 4
        truth.append(g)
        terms = rng.choice(10, 5, replace=False) + 10 * g
        idx += list(terms)
        val += [1 / 5**0.5] * 5
        ptr.append(len(idx))
    label = subjects.bisecting_kmeans((np.array(ptr), np.array(idx), np.array(val)), 40, 4)
    assert len(set(zip(truth, label))) == 4
    assert len(subjects.bisecting_kmeans((np.array([0]), np.zeros(0, int), np.zeros(0)), 5, 4)) == 0


def test_subjects_by_held_out_labels(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [r.subject for r in spark.read.parquet(f"{folder}/subjects.parquet").collect()]
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    model = subjects.fit(subjects.fit_sample(docs.where(~held), labels), names)
    got = subjects.assign(docs.where(held), model)
    known = labels.where("subject is not null").select("doc_id", "subject").distinct()
    pairs = known.join(docs.where(held).where("length(text) > 200").select("doc_id"), "doc_id", "left_semi")
    hit = pairs.join(got.select("doc_id", "subject"), ["doc_id", "subject"], "left_semi").count()
    assert hit > 0.9 * pairs.count()  # a few labels are wrong by themselves
    assert {r.subject for r in got.select("subject").distinct().collect()} == set(names)


def test_subjects_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 100_000), (3, "word")], "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(1, "a"), (1, None), (3, "b"), (3, "c")], "doc_id bigint, subject string")
    model = subjects.fit(subjects.fit_sample(docs, labels), ["a", "b"])
    assert subjects.assign(docs, model).count() == 0
    assert subjects.fit(subjects.fit_sample(docs.where("false"), labels), ["a"]).terms == {}
    assert subjects.mixture(None, model)[1] == 0


def test_a_text_on_a_third_of_all_rows_has_its_subject(spark):
    rng = random.Random(5)
    words = {"law": "court judge verdict appeal lawyer statute clause trial jury bench".split(), "sport": "goal match referee league striker keeper pitch trophy season coach".split()}
    make = lambda s: " ".join(w for _ in range(6) for w in (*rng.sample(words[s], 4), *rng.sample(["the", "and", "of", "was"], 3))) + "."
    subject = {k: "law" if k % 2 else "sport" for k in range(120)}
    rows = [(k, make(s)) for k, s in subject.items()] + [(1000 + k, "The court and the judge gave the verdict of the trial.") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, s) for k, s in subject.items() if k % 5 < 3], "doc_id bigint, subject string")
    model = subjects.fit(subjects.fit_sample(docs, labels), ["law", "sport"])
    assert not {"the", "and", "of", "was"} & set(model.terms)
    got = {(r.doc_id, r.subject) for r in subjects.assign(docs, model).collect()}
    assert got == {(k, s) for k, s in subject.items()} | {(1000 + k, "law") for k in range(60)}


def test_the_fit_counts_all_texts(spark):
    """More texts than any sample of former rounds held: none is left out of the frequencies and leaves."""
    docs = spark.range(13_000).selectExpr("id as doc_id", "concat('alpha beta number', ' ', if(id % 2 = 0, 'court', 'goal'), ' ', id) as text")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    # each text is another one by its number, and all of them count
    corpus = subjects.fit_sample(docs, labels)
    assert corpus.texts == 13_000 and corpus.vectors.count() == 13_000
    assert dict(zip(corpus.words, corpus.df.tolist())) == {"alpha": 13_000, "beta": 13_000, "number": 13_000, "court": 6_500, "goal": 6_500}
    model = subjects.fit(corpus, ["law"], leaves=2)
    assert sum(n for _, _, n, _ in subjects.leaf_table(model)) == 13_000


def test_words_by_pieces_and_sentences():
    """The quick ways to words and sentences give what the plain expressions give."""
    rng = random.Random(1)
    plain = re.compile(r"(?<=[.!?。！？])\s+|[\r\n]+")
    codes = subjects._Codes(lambda w: w)
    for _ in range(20_000):
        text = "".join(rng.choice("aB. \n\r\t!。?Éß-1_'İΣ\u3000\x1c") for _ in range(rng.randint(0, 25)))
        assert subjects._SENTENCE.split(text) == plain.split(text)
        assert codes.of(text) == subjects._WORD.findall(text.lower())


def test_few_passes_over_all_texts(spark, monkeypatch):
    """A pass costs as much as the corpus is large: two levels of the tree are found in the same passes, over all texts."""
    groups = ["court judge verdict appeal trial", "court judge verdict statute clause", "goal match striker league trophy", "goal match striker keeper coach"]
    other = ["and", "the", "of", "was", "in", "on", "at"]
    docs = spark.createDataFrame([(k, f"{groups[k % 4]} {other[k % 7]} {other[k % 5]}.") for k in range(320)], "doc_id bigint, text string")
    docs = docs.withColumn("text", F.concat("text", F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")))
    labels = docs.where("doc_id % 3 > 0").selectExpr("doc_id", "if(doc_id % 4 < 2, 'law', 'sport') as subject")
    corpus = subjects.fit_sample(docs, labels)
    passes = []
    sweep = subjects._sweep
    monkeypatch.setattr(subjects, "_sweep", lambda *a, **k: passes.append(1) or sweep(*a, **k))
    tree = subjects.bisect(corpus, 4)
    assert len(passes) <= 4  # 1 for all texts, 3 for two levels; a level at a time took 7
    size = sweep(corpus, tree, subjects._leaves(tree))[0]
    assert size.sum() == 320 and len(size) == 4
    model = subjects.fit(corpus, ["law", "sport"], leaves=4)
    got = {(r.doc_id, r.subject): r.share for r in subjects.assign(docs, model).collect()}
    for r in docs.where("doc_id % 7 = 0").collect():
        shares = dict(zip(model.subjects, subjects.mixture(r.text, model)[0]))
        assert {s for s, x in shares.items() if x >= subjects.MIN_SHARE} == {s for d, s in got if d == r.doc_id}
        assert all(abs(got.get((r.doc_id, s), x) - x) < 1e-5 for s, x in shares.items())


def test_mixture_of_leaves():
    """A document's subjects are those of its leaves: without the leaves' own mixtures a leaf of two subjects would count for one."""
    model = subjects.Model(["law", "sport"], {"court": 0, "goal": 1, "club": 2}, np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]], np.float32), np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]))
    text = "The court sat for long today. A goal fell in the end today. Nothing else was said."
    leaves, n = subjects.leaf_mixture(text, model)
    assert n and abs(leaves[0] - 0.5) < 0.1 and leaves[2] == 0 and abs(leaves.sum() - 1) < 1e-6
    assert abs(subjects.mixture(text, model)[0][0] - 0.5) < 0.1
    both = subjects.mixture("The club met here.", model)[0]
    assert both.tolist() == [0.5, 0.5]  # one leaf, two subjects
    assert subjects.mixture("The club met here. A goal fell in the end.", model)[0][1] > 0.7


def test_queries(spark, data):
    from folio.llm.queries import queries

    q = queries()
    assert set(q["p3_found"](spark, data).columns) == {"page_id", "field", "utc_s"} if "p3_found" in q else True
    for name, columns in {"p4_found": ["response_id"], "p5_found": ["page_a", "page_b"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"]}.items():
        df = q[name](spark, data)
        rows = df.collect()
        assert df.columns == columns and len(rows) == len(set(rows))
    assert all(r.page_a < r.page_b for r in q["p5_found"](spark, data).collect())
    assert q["p7_fill"](spark, data).where("filled < 0.9 and container_kind <> 'large'").count() == 0
