import random
import re

from pyspark.sql import functions as F

from recollect.llm.decontaminate import clean, contaminated, slot_values, template

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(*d, 9) for d in docs], DOCS)
    b = spark.createDataFrame([(*i, 9) for i in items], ITEMS)
    return sorted(((r.doc_id, r.item_id, r.windows, r.found) for r in contaminated(a, b, **more).collect()), key=str)


def test_template_and_values(spark):
    rows = {
        "We met Anna Smith, then Bob. Carl paid 3.50 dollars for twelve km\x02!": (["\x02n", "met", "\x02n", "then", "\x02n", "\x02n", "paid", "\x02d", "\x02u", "for", "\x02d", "\x02u"], ["we", "smith", "bob", "carl", "3.50", "dollars", "twelve", "km"]),
        "A1 20km 7:30 \u00dcber uns \u00c4RGER, \u00d6l": (["a1", "\x02d", "\x02u", "\x02d", "\x02n", "uns", "\x02n", "\x02n"], ["20", "km", "7:30", "\u00fcber", "\u00e4rger", "\u00f6l"]),
        "Twenty five men, forty-two and Six 3 thousand 4": (["\x02d", "men", "\x02d", "\x02d", "\x02d"], ["twenty five", "forty-two and six", "3 thousand", "4"]),
        "Jean-Paul Anna McCoy USA 5-km 50% tens": (["\x02n", "\x02d", "\x02u", "\x02d", "\x02u", "tens"], ["usa", "5", "km", "50", "%"]),
        "O'Neil met IBM men. THE USA OR A UK ISN'T OK": (["\x02n", "met", "\x02n", "men", "the", "usa", "or", "a", "uk", "isn", "t", "ok"], ["o'neil", "ibm"]),
        "Drei Tage und zwölf stunden, one or zero, quatre-vingt ans, veintidós horas": (["\x02d", "\x02n", "und", "\x02d", "\x02u", "\x02d", "or", "\x02d", "\x02d", "\x02u", "\x02d", "\x02u"], ["drei", "tage", "zwölf", "stunden", "one", "zero", "quatre-vingt", "ans", "veintidós", "horas"]),
        "": ([], []),
        None: ([], []),
    }
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(template(F.col("t")), slot_values(F.col("t"))).collect()
    assert [tuple(r) for r in got] == list(rows.values())


def test_endless_runs_do_not_exhaust_the_stack(spark):
    texts = ["Word " * 40_000, "seven " * 40_000, "1." * 80_000 + "1", "A" * 100_000, "7 km " * 40_000, "Anna-" * 40_000, "9" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(template(F.col("t")).alias("a"), slot_values(F.col("t")).alias("b")).collect()
    assert all(sum(w.startswith("\x02") for w in r.a) == len(r.b) for r in rows)


QUESTION = "A train leaves with Anna on board at 9 and drives 120 km to the north. How long does Anna need if it drives 60 km in every hour of the day?"


def test_parameters_may_change_if_consistent(spark):
    other = QUESTION.replace("Anna", "Boris").replace("120", "450").replace("60", "90").replace("9 ", "11 ")
    mixed = QUESTION.replace("Anna", "Boris", 1)
    docs = [(1, "Intro text here. " + other.upper().lower().replace("boris", "Boris") + " More text."), (2, mixed), (3, QUESTION), (4, "nothing of the kind"), (5, None), (6, ""), (3, QUESTION), (None, QUESTION)]
    got = {(d, i): f / w for d, i, w, f in run(spark, docs, [(7, QUESTION), (8, None), (9, "two words"), (10, "")], share=0.01)}
    assert got[1, 7] > 0.9 and got[3, 7] == 1 and got[None, 7] == 1 and got[2, 7] < 0.6
    assert set(got) == {(1, 7), (2, 7), (3, 7), (None, 7)}


def brute(docs, items, share):
    """Literal texts in lower case: the share of an item's windows of eight words."""
    out = []
    for d, t in docs:
        words = (t or "").split()
        held = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        for i, u in items:
            w = u.split()
            windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
            found = sum(x in held for x in windows)
            if windows and found / len(windows) >= share:
                out.append((d, i, len(windows), found))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            part = rnd.choice(items)[1].split()
            words[len(words) // 2 : len(words) // 2] = part[: rnd.randint(4, len(part))]
        docs.append((d, " ".join(words)))
    assert run(spark, docs, items) == brute(docs, items, 0.5)
    monkeypatch.setattr("recollect.llm.decontaminate.BROADCAST_WINDOWS", 0)
    assert run(spark, docs, items) == brute(docs, items, 0.5)


def test_short_items_long_text_and_empty_tables(spark):
    long = "word " * 60_000 + "alpha beta gamma delta epsilon zeta"
    assert run(spark, [(1, long)], [(5, "beta gamma delta epsilon zeta")]) == [(1, 5, 2, 2)]
    docs = spark.createDataFrame([(1, "beta gamma delta epsilon", 3), (None, "x", 3)], DOCS)
    items = spark.createDataFrame([(5, "beta gamma delta epsilon", 3)], ITEMS)
    assert [r.doc_id for r in clean(docs, items).collect()] == [None]
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0


def test_a_unit_word_behind_a_name_is_no_value(spark):
    texts = ["Le soir Marie s'est assise.", "Paul l'a vu et Paul l'a dit.", "They met on Christmas day here.", "for Anna\x03 km, 5\x03 km, 5\x04 km and 7 km", "At Seven h, seven h; Anna h 5-7 h 3.5 % 2/3 m"]
    rnd = random.Random(5)
    parts = ["Anna", "Öl", "seven", "Seven", "twenty", "and", "thousand", "12", "3.5", "km", "h", "%", "s", "l", "day", "a", "\x02", "\x03", "\x04", "'", ".", ",", "\n", "-", "é"]
    texts += ["".join(rnd.choice(parts) + rnd.choice([" ", " ", " ", ""]) for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template(F.col("t")).alias("a"), slot_values(F.col("t")).alias("b")).collect()
    assert [r.t for r in rows if sum(w.startswith("\x02") for w in r.a) != len(r.b)] == []
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template(F.col("t"), True).alias("a"), slot_values(F.col("t"), True).alias("b")).collect()
    assert [r.t for r in rows if sum(w.startswith("\x02") for w in r.a) != len(r.b)] == []


def test_verbatim_items_behind_a_name_and_a_unit_word(spark):
    french = "dans la petite ville où habite Claire il y a 12 maisons et 12 jardins, mais la tante de Claire garde la plus vieille des maisons du bord."
    english = "the old baker asks Peter for 30 loaves of bread, so Peter carries 30 loaves to the market place."
    docs = [(1, "Le soir Marie s'est assise. " + french), (2, "They met on Christmas day here. " + english), (3, french), (4, english)]
    got = {(d, i): (w, f) for d, i, w, f in run(spark, docs, [(7, french), (8, english)])}
    assert set(got) == {(1, 7), (3, 7), (2, 8), (4, 8)} and all(w == f for w, f in got.values())


def test_items_without_literal_words_are_found_word_by_word(spark):
    items = [(1, "Compute 12 + 45 + 78 + 3 + 9 - 14 + 88 + 20."), (2, "Anna Smith, Bob Miller, Carl Jones, Dora Brown, Emil Stone, Fred White"), (3, "What is love?"), (4, "Why 7"), (5, "Zugzwang!"), (6, "12 + 30 + 45 + 7"), (7, "?!"), (8, None)]
    docs = [(i, f"Some words, before: {t} And after it.") for i, t in items if t] + [(11, items[0][1].replace("45", "46")), (12, "love is what"), (13, "what is\nLOVE"), (14, "7 why")]
    assert run(spark, docs, items) == [(1, 1, 2, 2), (13, 3, 1, 1), (2, 2, 5, 5), (3, 3, 1, 1), (4, 4, 1, 1), (5, 5, 1, 1), (6, 6, 1, 1)]


def test_names_that_begin_a_sentence_and_glued_units_may_change(spark):
    tom = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    way = "a bus goes 20km to the lake, then 35km to the hill and 15km back to the old town, how far was it?"
    ann = tom.replace("Tom", "Ann").replace("3", "7").replace("4", "9")
    far = way.replace("20", "31").replace("35", "48").replace("15", "77")
    docs = [(1, ann), (2, f"It says:\n\u201c{ann}\u201d and more"), (3, "So " + tom), (4, far), (5, far.replace("km", " km")), (6, ann.replace("Ann buys", "Bob buys")), (7, tom.lower())]
    got = {(d, i): (w, f) for d, i, w, f in run(spark, docs, [(8, tom), (9, way)], share=0.01)}
    assert all(got[d, 8][0] == got[d, 8][1] for d in (1, 2, 3)) and all(got[d, 9][0] == got[d, 9][1] for d in (4, 5))
    assert got.get((6, 8), (2, 0))[1] / got.get((6, 8), (2, 0))[0] < 0.5


TOM = "Tom has 12 apples. Anna has 15 pears. How many fruits do they have?"


def test_cases_of_changed_parameters(spark):
    """Names at sentence starts, merged number words, short items, lists."""
    items = [(1, TOM), (2, "The box holds twelve red balls and 25 blue balls, so how many balls are in it?"), (3, "What is 7?"), (4, "Capital of France?"), (5, "Paris Rome Oslo 3 4 5 6 7 8")]
    docs = [(1, "Here: " + TOM.replace("Tom", "Carl").replace("Anna", "Beth").replace("12", "31").replace("15", "44")), (2, items[1][1].replace("twelve", "forty").replace("25", "twenty five")), (3, "So what is 7? Yes."), (4, "The capital of France? It is"), (5, items[4][1]), (6, TOM.upper()), (7, TOM.lower() + " and more"), (8, "Yesterday " + TOM)]
    got = {(d, i) for d, i, _, _ in run(spark, docs, items)}
    assert {(d, d) for d in range(1, 6)} | {(6, 1), (7, 1), (8, 1)} <= got


def brute_template(text):
    """(tokens, values) of texts made of words, capitalised names and numbers in digits, single-spaced."""
    tokens, values, run_of = [], [], False
    for w in text.split():
        bare = w.strip(",.?")
        name = bare[:1].isupper() and bare[1:].islower()
        if name and run_of:
            values[-1] = bare.lower()
        elif name or bare.isdigit():
            tokens.append("\x02n" if name else "\x02d")
            values.append(bare.lower())
        else:
            tokens.append(bare.lower())
        run_of = name and w == bare
    return tokens, values


def brute_slots(docs, items, share=0.5, size=8, literals=4):
    out = []
    for d, t in docs:
        tokens, values = brute_template(t)
        for i, u in items:
            best = None
            for v in (u, u[:1].lower() + u[1:], u.lower()):
                theirs, their_values = brute_template(v)
                wanted = [j for j in range(len(theirs) - size + 1) if sum(w[0] != "\x02" for w in theirs[j : j + size]) >= literals]
                pairs, hits = {}, []
                for j in wanted:
                    for k in range(len(tokens) - size + 1):
                        if tokens[k : k + size] == theirs[j : j + size]:
                            n = sum(w[0] == "\x02" for w in theirs[j : j + size])
                            x = sum(w[0] == "\x02" for w in theirs[:j])
                            y = sum(w[0] == "\x02" for w in tokens[:k])
                            both = list(zip(their_values[x : x + n], values[y : y + n]))
                            hits.append((k - j, j, both))
                            for a, b in both:
                                pairs.setdefault((k - j, a), set()).add(b)
                found = {j for shift, j, both in hits if all(len(pairs[shift, a]) == 1 for a, _ in both)}
                if wanted and len(found) / len(wanted) >= share and (best is None or len(found) / len(wanted) > best[1] / best[0]):
                    best = (len(wanted), len(found))
            if best:
                out.append((d, i, *best))
    return sorted(out, key=str)


def planted(rnd, n_items=15, n_docs=90):
    """Items with names and numbers, and texts that hold them as they are, with other parameters, or mixed up."""
    vocab = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    names = ["Anna", "Bob", "Carl", "Dora", "Emil", "Fred", "Gina", "Hugo", "Ida", "Jan"]

    def question():
        held = rnd.sample(names, 2) + [str(rnd.randint(2, 9)), str(rnd.randint(10, 99))]
        return " ".join(rnd.choice(held) if rnd.random() < 0.25 else rnd.choice(vocab) for _ in range(rnd.randint(14, 36))).capitalize() + "?"

    def changed(text, consistent=True):
        to = {}
        out = []
        for w in text.split():
            bare = w.strip("?")
            if bare in names or bare.isdigit():
                new = (rnd.choice(names) if bare in names else str(rnd.randint(100, 999))) if not consistent else to.setdefault(bare, rnd.choice(["Nina", "Otto", "Paul", "Rita"]) if bare in names else str(rnd.randint(100, 999)))
                w = w.replace(bare, new)
            out.append(w)
        return " ".join(out)

    items = [(i, question()) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        part = {0: lambda t: t, 1: changed, 2: lambda t: changed(t, False), 3: str.lower, 4: lambda t: ""}[d % 5](items[d % n_items][1])
        docs.append((d, " ".join([*(rnd.choice(vocab) for _ in range(9)), *([part] if part else []), *(rnd.choice(vocab) for _ in range(9))])))
    return docs, items


def test_names_and_numbers_against_brute_force(spark):
    docs, items = planted(random.Random(11))
    want = brute_slots(docs, items)
    assert run(spark, docs, items) == want
    found = {(d, i) for d, i, _, _ in want}
    recall = [(d, d % 15) in found for d, _ in docs if d % 5 == 1]
    assert sum(recall) / len(recall) >= 0.9 and all((d, d % 15) in found for d, _ in docs if d % 5 in (0, 3))


CLASSES = {
    "German number words": ("Ein Zug fährt mit drei Wagen nach Norden und holt dort mit zwei Männern Holz für die neue Brücke, die im Winter am alten Fluss gebaut wird.", {"drei": "sieben", "zwei": "fünf"}),
    "French number words": ("Le train roule avec trois wagons vers le nord et ramène ensuite quatre hommes qui doivent construire le pont avant la fin de la saison.", {"trois": "sept", "quatre": "neuf"}),
    "Spanish number words": ("El tren lleva tres vagones hacia el norte y trae luego cuatro hombres que deben hacer el puente antes del final de la estación.", {"tres": "siete", "cuatro": "nueve"}),
    "one": ("how long does one man need to carry the stones over the river if the old bridge is closed for one week in the middle of summer", {"one": "two"}),
    "names of other forms": ("how long does it take until McCoy has carried all the stones over the river and how many did O'Brien bring before the bridge was closed", {"McCoy": "O'Neil", "O'Brien": "DeWitt"}),
    "acronyms": ("how much of the coal that the USA sold last winter went over the old river and how much did IBM buy from those who had to carry it home", {"USA": "UK", "IBM": "NASA"}),
    "units": ("die Reise dauerte 7 Stunden und der Weg war 40 Kilometer lang, wie schnell fuhr dann der Wagen auf dem letzten Teil der Strecke am Fluss", {"Stunden": "Tage", "Kilometer": "Meilen"}),
}


def test_re_parameterised_classes(spark):
    docs, items = [], []
    for i, (text, changes) in enumerate(CLASSES.values()):
        items.append((i, text))
        other, broken = text, text
        for old, new in changes.items():
            other = re.sub(rf"\b{old}\b", new, other)
            broken = re.sub(rf"\b{old}\b", new, broken, count=1)
        docs += [(2 * i, "some words before it and " + other + " and some behind it"), (2 * i + 1, broken)]
    got = {(d, i): f / w for d, i, w, f in run(spark, docs, items, share=0.01)}
    for i, name in enumerate(CLASSES):
        assert got[2 * i, i] >= 0.9, name
    assert got[7, 3] < 1  # one value of "one" for two others: the windows that hold both do not count
