"""Splitting, repair, languages, subjects, leaks and mixing on small tables."""

import random

import pytest

from millrace.llm import chunking, language, leakage, mixing, scans, sentences, subjects

CONFIG = "config_id int, source string, pdf_parse_mode string, chunk_size int, chunk_overlap int"


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([(1, "default", "auto", 60, 10), (2, "plain", "text", 40, 8), (3, "odd", None, None, None), (4, "scan", "ocr", 100, 0)], CONFIG)


def records(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *(["x"] if extra else [])) for r in rows], "id string, source string, text_content string" + extra)


# --- splitting -----------------------------------------------------------------------------------------------------------



def test_split_round_trip_and_limits(spark, config):
    rng = random.Random(1)
    words = ["alpha", "beta,", "gamma.", "delta!", "漢字漢字", "épsilon;", "x" * 90]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "\r\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(f"r{k}", rng.choice(["plain", "odd", "nowhere", None]), t) for k, t in enumerate(texts)]
    df = records(spark, rows, ", chunk_size string")  # a column with the name of a setting
    got: dict = {}
    for r in chunking.split_oversized(df, config).collect():
        got.setdefault(r.id, []).append(r)
    limit = {"plain": 40}
    for ident, source, text in rows:
        size = limit.get(source, 60)
        plain = text.strip(" \t\n\x0b\f\r")
        if len(plain) <= size:
            assert ident not in got
            continue
        pieces = sorted(got[ident], key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        assert "".join(p.piece[p.overlap_chars :] for p in pieces) == plain
        assert all(len(p.piece) <= size for p in pieces)
        for a, b in zip(pieces, pieces[1:]):
            assert b.overlap_chars <= 10 and a.piece.endswith(b.piece[: b.overlap_chars])


def test_oversized_paragraphs(spark, config):
    rows = [("a", "plain", "short\n\n" + "w" * 41 + "\n \t\n" + "z" * 40), ("a", "plain", "short\n\n" + "w" * 41 + "\n \t\n" + "z" * 40), ("b", "plain", " " * 50), ("c", "plain", None), ("d", None, ""), ("e", "odd", "v" * 200_000)]
    got = sorted(map(tuple, chunking.find_oversized(records(spark, rows), config).collect()))
    assert got == [("a", 0), ("a", 2), ("e", 0), ("e", 1)]


def test_split_empty_tables(spark, config):
    none = records(spark, [("a", "plain", "x")]).limit(0)
    assert chunking.find_oversized(none, config).count() == 0
    assert chunking.split_oversized(none, config.limit(0)).count() == 0
    assert chunking.find_oversized(records(spark, [("a", None, "q " * 400)]), config.limit(0)).count() == 2  # the fallback limit


# --- scans ---------------------------------------------------------------------------------------------------------------

CLEAN = "The warehouse keeps spare valves for the winter season and sends a monthly report to the board. Every clerk signs the register before noon. "


def page(lines, number):
    return ["Notes on spare valves", *lines, f"- {number} -"]


def test_noise_kinds(spark, config):
    clean = [(f"c{k}", "plain", CLEAN * 3) for k in range(20)]
    body1 = ["The warehouse keeps spare valves for the winter sea-", "son and sends a m0nthly report to the board. Every clerk", "signs the register before noon. The warehouse keeps spare"]
    body2 = ["valves for the winter season and sends a monthly rcport", "to the board.", "", "915", "558", "", "Every clerk signs the register before noon."]
    text = "\n".join(page(body1, 4)) + "\n\f" + "\n".join(page(body2, 5))
    df = records(spark, [*clean, ("s", "scan", text), ("s", "scan", text), ("n", "scan", None), ("e", "scan", "")])
    got = sorted((r.line_no, r.noise_kind) for r in scans.find_noise(df, config).collect())
    assert got == [(1, "header"), (2, "hyphen"), (3, "misread"), (5, "page_number"), (6, "header"), (7, "misread"), (14, "page_number")]
    told = [r.paragraph for r in scans.repair(df, config).where("id = 's'").orderBy("para_no").collect()]
    assert told[0].startswith("The warehouse keeps spare valves for the winter season and sends a monthly report to the board. Every clerk signs")
    assert "monthly report to the board." in told[0] and "Notes on" not in " ".join(told)


def test_rival_forms_are_decided_by_clean_text(spark, config):
    """That beads are of glass stands only in clean text; heads are more frequent."""
    clean = [(f"c{k}", "plain", "We saw the head of it. " * 3 + "We saw a glass bead there.") for k in range(20)]
    text = "Page 1 of 2\nWe saw a glass 8ead\nthere and the head of it\nthere."
    told = " ".join(r.paragraph for r in scans.repair(records(spark, [*clean, ("s", "scan", text)]), config).where("id = 's'").orderBy("para_no").collect())
    assert "glass bead there" in told


def test_natural_hyphens_stay(spark, config):
    clean = [(f"c{k}", "plain", "The double-blind trial ended in May. It was a double-blind study of many things. ") for k in range(20)]
    text = "Page 1 of 2\nThe trial was a double-\nblind study of many\nthings and ended in May."
    got = {(r.line_no, r.noise_kind) for r in scans.find_noise(records(spark, [*clean, ("s", "scan", text)]), config).collect()}
    assert (2, "hyphen") not in got and (1, "page_number") in got


def test_scans_without_records(spark, config):
    none = records(spark, [("a", "scan", "x")]).limit(0)
    assert scans.find_noise(none, config).count() == 0
    assert scans.repair(none, config).count() == 0


# --- languages -----------------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "The committee approved the budget for the coming year after a long discussion about the roads. Nobody expected the bridge to be closed for so many weeks, and the shops along the river suffered.",
    "de": "Der Ausschuss hat den Haushalt für das kommende Jahr nach langer Debatte über die Straßen beschlossen. Niemand hatte erwartet, dass die Brücke so viele Wochen gesperrt bleibt, und die Läden am Fluss litten darunter.",
    "fr": "Le comité a approuvé le budget de l'année prochaine après une longue discussion sur les routes. Personne ne s'attendait à ce que le pont reste fermé pendant des semaines, et les commerces en ont souffert.",
    "es": "El comité aprobó el presupuesto del próximo año después de una larga discusión sobre las carreteras. Nadie esperaba que el puente estuviera cerrado durante tantas semanas, y las tiendas lo sufrieron.",
    "pt": "A comissão aprovou o orçamento do próximo ano depois de uma longa discussão sobre as estradas. Ninguém esperava que a ponte ficasse fechada durante tantas semanas, e as lojas sofreram com isso.",
    "zh": "委员会在长时间讨论道路问题以后批准了明年的预算。没有人想到大桥会关闭这么多个星期，河边的商店因此受到影响。",
}
DOCS = "doc_id bigint, lang string, text string, source string"


def test_languages(spark):
    train = [(k * 10 + j, code, text, "x") for j, (code, text) in enumerate(SAMPLES.items()) for k in range(1, 9)]
    both = SAMPLES["en"] + "\n\n" + SAMPLES["fr"]
    ask = [(1000, None, SAMPLES["de"], "x"), (1001, "en", SAMPLES["es"], "x"), (1002, "EN-us", SAMPLES["en"], "x"), (1003, "en", both, "x"), (1004, "??", None, "x"), (1005, "", "", "x"), (1006, "zho", SAMPLES["zh"], "x"), (1007, "en", SAMPLES["en"] + " He wrote `SELECT x FROM t` and “le stockage objet” there.", "x")]
    df = spark.createDataFrame(train + ask, DOCS)
    profiles = language.fit(df)
    got = sorted(map(tuple, language.relabel(df, profiles).where("doc_id >= 1000").collect()))
    assert got == [(1000, "de"), (1001, "es"), (1003, "en"), (1003, "fr")]
    told = {r.doc_id: r for r in language.segments(df, profiles).where("doc_id in (1004, 1005)").collect()}
    assert all(r.lang_code is None and r.confidence == 0 for r in told.values())
    pieces = language.segments(df, profiles).where("doc_id = 1003").orderBy("segment_no").collect()
    assert [p.lang_code for p in pieces] == ["en", "fr"] and pieces[-1].last_char == len(both)
    assert all(0 <= p.confidence <= 1 for p in pieces)


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    profiles = language.fit(none)
    assert language.relabel(none, profiles).count() == 0
    assert language.segments(spark.createDataFrame([(1, None, "some text", "x")], DOCS), profiles).first().lang_code is None


def test_sentences():
    text = "A note (No. AB-12) came, e.g. today. Was it new? Yes.\n\n# Title\n\nLast one 3.5 long."
    assert [text[a:b].strip() for a, b in sentences.spans(text)] == ["A note (No. AB-12) came, e.g. today.", "Was it new?", "Yes.", "# Title", "Last one 3.5 long."]


# --- subjects ------------------------------------------------------------------------------------------------------------

WORDS = {"law": ["court ruling", "appeal filing", "notarial deed", "jury verdict"], "medicine": ["blood panel", "kidney scan", "triage note", "vaccine batch"], "finance": ["bond yield", "margin call", "ledger entry", "cash reserve"]}


def sentence(rng, subject):
    a, b = rng.sample(WORDS[subject], 2)
    return rng.choice([f"The {a} was compared with the {b} in town number {rng.randint(1, 99)}.", f"Nobody expected the {a} to follow the {b} so soon.", f"In spring the office counted every {a} and one {b}."])


def test_subjects_held_out(spark):
    rng = random.Random(4)
    docs, labels, truth = [], [], {}
    for k in range(400):
        subject = rng.choice(list(WORDS))
        other = rng.choice([s for s in WORDS if s != subject])
        parts = [sentence(rng, subject) for _ in range(6)] + ([sentence(rng, other) for _ in range(4)] if k % 4 == 0 else [])
        docs.append((k, " ".join(parts), "nonsense"))
        truth[k] = {subject, other} if k % 4 == 0 else {subject}
        if k < 150:
            labels += [(k, s.upper() if k % 3 else s, "a") for s in truth[k]]
    docs += [(900, None, "x"), (901, "", "x"), (902, "Please keep this page.", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject_area string")
    model = subjects.fit(df, spark.createDataFrame(labels, "doc_id bigint, subject_area string, annotator string"), spark.createDataFrame([(s,) for s in WORDS], "subject_area string"))
    got: dict = {}
    for r in subjects.assign(df, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_area)
    held_out = [k for k in range(150, 400)]
    assert sum(got.get(k, set()) == truth[k] for k in held_out) >= 0.95 * len(held_out)
    assert not {900, 901} & set(got)


def test_subjects_without_labels(spark):
    df = spark.createDataFrame([(1, "The court ruling.")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject_area string, annotator string")
    model = subjects.fit(df, none, spark.createDataFrame([("law",)], "subject_area string"))
    assert subjects.assign(df, model).count() == 0


# --- leaks ---------------------------------------------------------------------------------------------------------------

PASSAGES = [
    "The letter that Sochen Defall never posted was found in Madaburg behind a loose brick. Nobody believed Sochen Defall, although 56 fishermen from Gretiport had seen the same light. The keeper of Molmuford counted 31 lamps before he went home.",
    "Each of the 79 keys kept by Stavel Trontudal opens a different gate in Stegifield. Stavel Trontudal traded a brass compass for 5,459 sheets of paper and a seat on the boat to Lodaport. The bell of Merliham had been silent for 69 years.",
]


def test_leaks(spark):
    items = [(k, "s", "Read the passage and answer.\n\n" + p + f"\nWhat happened to number {k}?", None) for k, p in enumerate(PASSAGES)] + [(9, "s", None, None), (10, "s", "", None)]
    first = PASSAGES[0]
    half = first.split(". ")[0] + ". " + first.split(". ")[1] + "."
    docs = {
        1: "Intro text stands here. " + first.upper().replace(",", "") + " And more follows.",
        2: "Quite another text. " + half.replace("loose", "broken").replace(" ", "\n", 3),
        3: first.replace("Sochen Defall", "Pavel Norit").replace("56", "12").replace("Madaburg", "Kolbuton").replace("Gretiport", "Hasuby").replace("Molmuford", "Laport").replace("31", "8"),
        4: "They quote: “found in Madaburg behind a loose brick”.",
        5: "Read the passage and answer. What happened to number 1?",
        6: None,
        7: "",
        8: "* " + PASSAGES[1].split(". ")[0] + ".\n\nSomething else stands between them here.\n\n(2) " + PASSAGES[1].split(". ")[1] + ".",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()] + [(1, docs[1], "x")], "doc_id bigint, text string, item_text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, spark.createDataFrame(items, "item_id bigint, suite string, item_text string, answer string")).collect())
    assert got == [(1, 0), (2, 0), (8, 1)]


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, item_text string")
    assert leakage.find_leaks(docs, items).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------


def test_mix_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["Big-Source", "big_source", "small", "none_wanted", None]) if k > 60 else "tiny", "word " * rng.randint(5, 60)) for k in range(3000)] + [(5000, "small", None), (5001, "small", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 4), ("missing", 0.0, 2)], "source_name string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    rows = mixed.groupBy("doc_id", "source_name").count().collect()
    most = {"big_source": 1, "small": 3, "tiny": 4}
    assert all(r["count"] <= most[r.source_name] for r in rows)
    assert {r.doc_id for r in rows}.isdisjoint({5000, 5001})
    shares = {r.source_name: r for r in mixing.shares(df, targets).collect()}
    for name, share in (("big_source", 0.6), ("small", 0.3), ("tiny", 0.1)):
        assert abs(shares[name].actual_share - share) < 0.01
    assert shares["missing"].tokens == 0
    assert sum(r["count"] for r in rows) == sum(s.copies for s in shares.values())
    assert mixing.mix(df, targets).exceptAll(mixed).count() == 0  # the same each time


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    assert mixing.mix(df, targets).count() == 0
    assert mixing.shares(df, targets).first().tokens == 0
