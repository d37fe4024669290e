"""Decontamination: re-parameterised variants are found, other documents are left alone, odd tables do no harm."""

import random

from loamwork.llm import decontamination

NOUNS = "apples bricks candles drums engines feathers garments hammers islands jackets kettles lanterns mirrors needles oranges".split()
VERBS = "bought carried counted delivered exchanged finished gathered handed invented joined loaded measured noticed offered packed".split()
PLACES = "market harbour station library meadow workshop garden village".split()
NAMES = ["Tom", "Anna", "Mary Jane", "Paul", "Ingrid", "José", "Ann-Marie", "Omar"]
NUMBERS = ["5", "12", "1,200", "3.5", "forty", "forty-two", "9.25", "1250", "three hundred", "2 million"]


def items(n=40, seed=9):
    random.seed(seed)
    out = []
    for _ in range(n):
        a, b, c = random.sample(NOUNS, 3)
        v, w = random.sample(VERBS, 2)
        out.append(f"{{p0}} {v} {{n0}} {a} at the {random.choice(PLACES)}. Then {{p1}} {w} {{n1}} kg of {b} for {{n2}} dollars, and {{p0}} wanted {c}. How many {a} did {{p0}} keep in the end?")
    return out


def filled(template):
    p, n = random.sample(NAMES, 2), random.sample(NUMBERS, 3)
    return template.format(p0=p[0], p1=p[1], n0=n[0], n1=n[1], n2=n[2])


def test_recall_on_variants_and_clean_documents(spark, docs_of):
    templates = items()
    benchmark = spark.createDataFrame([(i, filled(t)) for i, t in enumerate(templates)], "item_id long, text string")
    rows = []
    for i, t in enumerate(templates):
        for k in range(5):
            rows.append((i * 10 + k, f"{random.choice(['', 'So it goes on and on, ', 'It rained all day. '])}{filled(t)} That was all there is to say."))
        swapped = t.replace("Then", "Later").replace("How many", "Which of the").replace(" at the ", " near some ").replace(" for ", " against ").replace("wanted", "sold {p1} all").replace(" kg of ", " ")
        rows.append((i * 10 + 9, filled(swapped)))  # shares words and names with the item, but no 13 words in a row
    for most in (decontamination.BROADCAST_WINDOWS, 1):
        found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(rows), benchmark, most=most).collect()}
        want = {(i * 10 + k, i) for i in range(len(templates)) for k in range(5)}
        assert len(found & want) >= 0.9 * len(want)
        assert not {d for d, _ in found if d % 10 == 9}


def test_values_are_one_to_one_over_runs(spark, docs_of):
    item = "Anna has 5 red apples and Paul has 7 green pears while nobody else in town has anything to eat so Anna gives Paul 5 apples"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("Anna", "Mary Jane").replace("Paul", "Omar").replace("5", "forty").replace("7", "1,250.75")
    rows = [(1, same), (2, same.replace("so Mary Jane", "so Ingrid")), (3, item.replace("5", "five")), (4, item.lower()), (5, item.upper())]
    out = {r.doc_id: r for r in decontamination.matches(docs_of(rows), benchmark).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert out[1].consistent and out[1].reparameterised and out[1].covered == 1
    assert not out[2].consistent  # each window agrees, the whole does not
    assert out[3].consistent and out[4].covered == 1 and not out[4].reparameterised


def test_short_items_hold_nothing(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "river"), (2, "the red house"), (3, "12 5 7 9 10"), (4, "the old red house")], "item_id long, text string")
    rows = [(1, "by the river"), (2, "in the red house"), (3, "12 5 7 9 10 3 4"), (4, "in the old red house")]
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(rows), benchmark).collect()} == {(4, 4)}


def test_odd_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "what is the largest city of the northern island in the sea"), (None, None)], "item_id long, text string")
    text = "They ask: what is the largest city of the northern island in the sea"
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "§n¤ " * 50), (5, "x" * 1_000_000), (6, "word " * 200_000 + text)]
    docs = docs_of(rows)
    for name in ("item_id", "hash", "form", "at", "plain", "free", "pairs"):
        docs = docs.withColumn(name, docs.lang)
    found = decontamination.matches(docs, benchmark.withColumn("doc_id", benchmark.item_id).withColumn("hash", benchmark.text))
    assert sorted((r.doc_id or 0, r.item_id, r.covered) for r in found.collect()) == [(0, 1, 1.0), (1, 1, 1.0), (6, 1, 1.0)]
    assert decontamination.matches(docs_of([]), benchmark).count() == 0


def test_a_header_of_all_items_names_all_of_them(spark, docs_of):
    header = "Read the following short question with care and then choose the best answer from the list below:"
    text = lambda i: f"{header} item{chr(97 + i % 26)}{chr(97 + i // 26)} asks what comes after the number {i} here"
    benchmark = spark.createDataFrame([(i, text(i)) for i in range(200)], "item_id long, text string")
    rows = [(1, header), (2, text(54)), (3, "nothing of the kind"), (4, text(7))]
    for most in (decontamination.BROADCAST_WINDOWS, 1):
        found = {(r.doc_id, r.item_id): r.covered for r in decontamination.matches(docs_of(rows), benchmark, most=most).collect()}
        assert set(found) == {(d, i) for d in (1, 2, 4) for i in range(200)}
        assert found[2, 54] == found[4, 7] == 1.0 and all(v < 1 for k, v in found.items() if k not in {(2, 54), (4, 7)})


CHINESE = "据《本草纲目》记载，人参味甘微苦，性微温，归脾肺心经，能大补元气，复脉固脱。主治体虚欲脱，肢冷脉微。"


def test_unspaced_scripts_and_typographic_marks(spark, docs_of):
    quoted = "Who's the author of the king's diary and what's its name?"
    spoken = 'She said "the old mill by the river - the one with 12 wheels - was sold again" and left'
    wide = "The parcel of 45 kg went by ship to the northern harbour in March (see list)"
    benchmark = spark.createDataFrame([(1, CHINESE), (2, quoted), (3, spoken), (4, wide), (5, "人参甘"), (6, "今日は良い天気ですね散歩に行きましょう")], "item_id long, text string")
    full = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in wide).replace(" ", "\u3000")
    rows = [
        (1, CHINESE), (2, "前文。" + CHINESE[9:30] + "后文"), (3, quoted.replace("'", "\u2019")), (4, spoken.replace('"', "\u201c", 1).replace('"', "\u201d").replace("-", "\u2014")), (5, full),
        (6, "人参是一种药材，味道不同，这里没有引文。"), (7, "人参甘"), (8, "昨日、今日は良い天気ですね散歩に行きましょうと言った"), (9, CHINESE.replace("，", ",").replace("。", ".")),
    ]
    for most in (decontamination.BROADCAST_WINDOWS, 1):
        found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(rows), benchmark, most=most).collect()}
        assert found == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (8, 6), (9, 1)}


def test_recall_on_variants_with_typographic_marks(spark, docs_of):
    """The generator's variants once more, with curly quotes and dashes in the documents alone."""
    templates = [t.replace("kept", "'kept'").replace(". Then", "; 'then' - as they say - Then") for t in items(20, 4)]
    benchmark = spark.createDataFrame([(i, filled(t)) for i, t in enumerate(templates)], "item_id long, text string")
    rows = [(i * 10 + k, filled(t).replace("'", "\u2019").replace(" - ", " \u2013 ")) for i, t in enumerate(templates) for k in range(3)]
    other = [t.replace("Then", "Later").replace("How many", "Which of the").replace(" at the ", " near some ").replace(" for ", " against ").replace("wanted", "sold {p1} all").replace(" kg of ", " ") for t in templates]
    clean = [(i * 10 + 9, "\u201c" + filled(t) + "\u201d") for i, t in enumerate(other)]
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(rows + clean), benchmark).collect()}
    want = {(d, d // 10) for d, _ in rows}
    assert len(found & want) >= 0.9 * len(want) and not {d for d, _ in found if d % 10 == 9}


def plain_windows(text):
    """Free form of a text of plain ASCII words, digits and single capitalised names: (canonical words, values)."""
    words = text.replace(".", " ").replace("?", " ").split()
    return [("N" if w.isdigit() else "P" if w[0].isupper() else w.lower(), w) for w in words]


def test_free_form_against_brute_force(spark, docs_of):
    """Windows of 13 canonical words with names and numbers one to one, tried for all pairs of documents and items."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "sto", "vel", "pon", "dix")]
    names, numbers = ["Arvo", "Belto", "Cirda", "Dunve"], ["5", "17", "230", "44"]
    word = lambda: rng.choice([names, numbers, vocabulary, vocabulary, vocabulary, vocabulary])
    made = [[rng.choice(word()) for _ in range(rng.choice([14, 20, 30]))] for _ in range(25)]
    made = [["so", *(w for k, w in enumerate(m) if not (w in names and k and m[k - 1] in names) and not (w in numbers and k and m[k - 1] in numbers))] for m in made]
    swap = lambda words, table: [table.get(w, w) for w in words]
    docs = []
    for i, m in enumerate(made):
        turn = dict(zip(names, rng.sample(names, 4), strict=True)) | dict(zip(numbers, rng.sample(numbers, 4), strict=True))
        docs += [(i * 4, " ".join(swap(m, turn))), (i * 4 + 1, " ".join(m[: len(m) // 2] + made[i - 1][8:])), (i * 4 + 2, " ".join(rng.choice(names) if w in names else w for w in m)), (i * 4 + 3, " ".join(rng.choices(vocabulary, k=30)))]
    benchmark = spark.createDataFrame([(i, " ".join(m)) for i, m in enumerate(made)], "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, m in enumerate(made):
            mine, theirs = plain_windows(text), plain_windows(" ".join(m))
            for free in (True, False):
                form = lambda x, free=free: [(c if free or c != "P" else v.lower(), v) for c, v in x]
                a, b = form(mine), form(theirs)
                size = min(13, len(b))
                for x in range(len(a) - size + 1):
                    for y in range(len(b) - size + 1):
                        p, q = a[x : x + size], b[y : y + size]
                        literal = sum(c not in ("N", "P") for c, _ in q)
                        if [c for c, _ in p] != [c for c, _ in q] or (2 * literal < size if free else not literal):
                            continue
                        pairs = {(v, w) for (c, v), (_, w) in zip(p, q, strict=True) if c in ("N", "P")}
                        if len(pairs) == len({v for v, _ in pairs}) == len({w for _, w in pairs}):
                            want.add((d, i))
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(docs), benchmark).collect()}
    assert found == want and len(want) > 40
