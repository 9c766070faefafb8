"""Benchmark decontamination by template windows.

Texts and benchmark items become templates: names, numbers and units turn into
typed placeholders, everything else into lower-case words.  Hashes of all windows
of eight template tokens are joined by equality, so an item is found although its
parameters were changed.  The slots then have to be consistent: along one
alignment of a text with an item, one value of the item always stands for one
value of the text.  Windows that break this don't count.

Every capitalised word is a name, also where a sentence begins, as are ``McCoy``,
``O'Neil`` and a short word in capitals between others in small letters; a run of names or number words is one placeholder.  Texts have this one template.  Items are
looked for in three readings, as they are, with small letters where a sentence,
line or quotation begins, and with small letters throughout, so that copies in
other letters are found too; the one that a text holds most of counts.

Windows that are mostly placeholders say too little.  Items that keep none as they
are (lists of names, sums, a few words) are looked for word by word, by the same join.

Only DataFrame functions are used.  The items' windows are broadcast if there are
at most ``BROADCAST_WINDOWS`` of them, and their texts if they also have at most
``BROADCAST_CHARS``; otherwise the same joins are shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._shared import content_key, cut, join_split, narrow

BROADCAST_WINDOWS = 200_000  # of 32 bytes: under 10 MB
BROADCAST_CHARS = 4_000_000  # of the items that have these windows
WINDOW, SHORT = 8, 4  # tokens; the second for items of fewer than eight
LITERALS = 4  # words in a window at least that are no placeholder (half of them in a short one)

# Words for numbers and units in English, German, French and Spanish. Articles ("a", "ein", "une", "una") are no numbers.
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden
zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante cent cents mille millions milliard milliards
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés treinta cuarenta cincuenta sesenta setenta ochenta noventa ciento cien mil millón millones
"""
MAGNITUDES = "hundred thousand million billion hundert tausend millionen milliarden cent mille millions milliards mil millones"
UNITS = """
% mm cm m km kilometers kilometres meters metres miles mile feet foot inches inch yards mg g kg t grams kilograms pounds lbs oz ounces tons tonnes ml cl l liters litres gallons s sec seconds second min minutes minute h hours hour days day weeks week months month years year dollars dollar euros euro cents usd eur percent degrees mph kmh gb mb kb tb
meter kilometer zentimeter meilen gramm kilo kilogramm pfund tonnen liter sekunden sekunde minuten stunde stunden tage tagen tag wochen woche monate monaten monat jahre jahren jahr prozent grad cent
mètres mètre kilomètres kilomètre centimètres grammes kilos litres litre secondes seconde heures heure jours jour semaines semaine mois ans an années année degrés
metros metro kilómetros kilómetro centímetros millas gramos kilogramos litros litro segundos segundo minutos minuto horas hora días día semanas semana meses mes años año dólares grados
"""


def _one_of(words: str) -> str:
    """A pattern for any of the words, in any letters; words with one first letter share it."""
    groups = groupby(sorted(set(words.split())), key=lambda w: w[0])
    return "(?i:" + "|".join(first + "(?:" + "|".join(w[1:] for w in sorted(some, key=len, reverse=True)) + ")" for first, some in groups) + ")"


_FIRST = "".join(sorted({x for w in NUMBER_WORDS.split() for x in w[0] + w[0].upper()}))

# A group that may repeat without end would exhaust the stack of Java's matcher, so repeats are bounded;
# the look ahead comes first because it is the cheapest test.
_END = r"(?![\p{L}\p{N}])"
_DIGITS = r"[0-9]+(?:[.,:/][0-9]+){0,15}"
_WORD = _one_of(NUMBER_WORDS)
# "Anna", "McCoy", "O'Neil"; "USA" beside a word in small letters, not among other capitals, as in a text that shouts
_ONE_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_ACRONYM = r"(?:(?<=\p{Ll}[ \t-])\p{Lu}{2,5}(?![ \t-]\p{Lu}(?!\p{Ll}))|(?<!\p{Lu}[ \t-])\p{Lu}{2,5}(?=[ \t-]\p{Ll}))"
_NAMES = rf"(?!{_WORD}{_END})(?:{_ONE_NAME}[ \t-]){{0,7}}({_ONE_NAME}|{_ACRONYM}){_END}"
_NAME = r"(?=\p{Lu})(?<![\p{L}\p{N}])" + _NAMES
_INNER_NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},;][ \t])" + _NAMES
_NUMBER = rf"(?=[0-9{_FIRST}])(?<![\p{{L}}\p{{N}}\x02])(?:{_DIGITS}(?:[ -]{_one_of(MAGNITUDES)})?|{_WORD}(?:[ -](?:and |und |et |y )?{_WORD}){{0,7}}){_END}"
_GLUED = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}])({_DIGITS})({_one_of(UNITS)}){_END}"
_UNIT = "(" + "|".join(sorted(set(UNITS.split()), key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}\x02])"
_SLOT = "\x02"


def _clean(text: Column) -> Column:
    """The text without the marks that are used here, with a blank between a number and the unit glued to it."""
    text = F.coalesce(text, F.lit(""))
    marks = [F.contains(text, F.lit(m)) for m in "\x02\x03\x04"]
    return F.regexp_replace(F.when(marks[0] | marks[1] | marks[2], F.translate(text, "\x02\x03\x04", "   ")).otherwise(text), _GLUED, "$1 $2")


def template(text: Column, inner: bool = False) -> Column:
    """Template tokens of a text: lower-case words, and \\x02n, \\x02d, \\x02u for names, a number, a unit.

    ``inner``: a capitalised word is a name only inside a sentence, behind a word, comma or semicolon and a blank.
    """
    named = F.regexp_replace(_clean(text), _INNER_NAME if inner else _NAME, _SLOT + "n")
    counted = F.regexp_replace(named, _NUMBER, _SLOT + "d")
    measured = F.regexp_replace(F.lower(counted), r"(?<=\x02d[ -])" + _UNIT, _SLOT + "u")
    return F.filter(F.split(measured, r"[^\p{L}\p{N}\x02]+"), lambda w: w != "")


def slot_values(text: Column, inner: bool = False) -> Column:
    """What stood at the placeholders of a text, lower-cased, in order; the last one of several names.

    The text is split at its names and numbers the same way, each kept between
    two marks; a number's closing mark is its own, and only behind it is a unit taken.
    """
    named = F.regexp_replace(_clean(text), _INNER_NAME if inner else _NAME, "\x02n$1\x03")
    counted = F.regexp_replace(named, f"({_NUMBER})", "\x02d$1\x04")
    measured = F.regexp_replace(F.lower(counted), r"(?<=\x04[ -])" + _UNIT, "\x02u$1\x03")
    return F.regexp_extract_all(measured, F.lit("\x02[ndu]([^\x03\x04]*)[\x03\x04]"), F.lit(1))


def plain(text: Column) -> Column:
    """All words and digits of a text, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: The readings of an item; a tie goes to the first.
AS_IS, INNER, LOWERED, EXACT = range(4)


def _read(text: Column, form: int, how) -> Column:
    """template or slot_values of a reading."""
    return how(F.lower(text) if form == LOWERED else text, form == INNER)


def _tokens(text: Column, form: int) -> Column:
    return plain(text) if form == EXACT else _read(text, form, template)


def _next(hashes: Column, step: int) -> Column:
    """Hashes of windows twice as long, from those of windows of ``step`` tokens."""
    n = F.greatest(F.size(hashes) - F.lit(step), F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _windows(rows: DataFrame) -> DataFrame:
    """rows(..., tokens) with the window hashes short (of 4 tokens) and long (of 8)."""
    rows = rows.withColumn("_h1", F.transform("tokens", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_h2", _next(F.col("_h1"), 1)).withColumn("short", _next(F.col("_h2"), 2))
    return rows.withColumn("long", _next(F.col("short"), 4)).drop("_h1", "_h2")


def _slots(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: w.startswith(_SLOT)))


def _hashes(rows: DataFrame, width: int) -> Column:
    """Hashes of the windows of ``width`` tokens in rows(..., tokens, short, long)."""
    if width in (SHORT, WINDOW):
        return F.col("long" if width == WINDOW else "short")
    have = F.transform("tokens", lambda w: F.xxhash64(w))
    for step in range(1, width):
        n = F.greatest(F.size("tokens") - F.lit(step), F.lit(0))
        have = F.zip_with(F.slice(have, F.lit(1), n), F.slice(F.transform("tokens", lambda w: F.xxhash64(w)), F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
    return have


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, form, width, at, hash, slotted, windows): the windows to look for, and how many the item has in that form.

    A template's windows need enough literal words.  Items that have none as they
    are have those of their plain words, all of them.
    """

    def exploded(form: int, rows: DataFrame) -> DataFrame:
        rows = _windows(rows.withColumn("tokens", _tokens(F.col("text"), form)))
        size = F.size("tokens")
        rows = rows.withColumn("width", F.when(size >= WINDOW, F.lit(WINDOW)).when(size >= SHORT, F.lit(SHORT)).when((size > 0) & F.lit(form == EXACT), size))
        hashes = F.when(F.col("width") == WINDOW, F.col("long")).when(F.col("width") == SHORT, F.col("short"))
        for n in range(1, SHORT if form == EXACT else 1):
            hashes = hashes.when(F.col("width") == n, _hashes(rows, n))
        rows = rows.where("width is not null").select("item", "tokens", F.lit(form).alias("form"), "width", F.posexplode_outer(hashes).alias("at", "hash"))
        part = F.slice("tokens", F.col("at") + 1, F.col("width"))
        if form != EXACT:
            rows = rows.where(F.col("width") - _slots(part) >= F.col("width") * F.lit(LITERALS) / F.lit(WINDOW))
        return rows.select("item", "form", "width", "at", "hash", (_slots(part) > 0).alias("slotted"))

    rows = exploded(AS_IS, benchmark)
    bare = benchmark.join(rows.select("item").distinct(), "item", "left_anti")
    capitals = benchmark.where(F.lower("text") != F.col("text"))  # the others have one reading
    rows = reduce(DataFrame.unionByName, [rows, exploded(INNER, capitals), exploded(LOWERED, capitals), exploded(EXACT, bare)])
    return rows.join(rows.groupBy("item", "form").agg(F.count(F.lit(1)).alias("windows")), ["item", "form"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, found, share) for every text that holds at least ``share`` of an item's windows.

    ``windows`` are the item's windows in the reading that the text holds most of,
    ``found`` those of them that it holds, in a template with consistent slots.
    An item whose template leaves no window of enough literal words
    (fewer than four tokens, mostly names or numbers) is also looked for word by word, as
    a whole sequence if it has fewer than four words.  Items without a letter or
    digit, null or empty items and texts match nothing.  Repeated rows (of either
    table) and rows without an id repeat in the result.  Empty tables give an
    empty result; other columns are not read.
    """
    rows = narrow(docs, doc_id, text).withColumn("content", content_key(F.col("text")))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.md5(F.concat_ws("|", F.coalesce(F.col(item_id).cast("string"), F.lit("none")), item_text).cast("binary")).alias("item"))
    distinct = items.dropDuplicates(["item"])
    indexed = cut(_item_windows(distinct))
    kinds = sorted(tuple(r) for r in indexed.groupBy((F.col("form") == EXACT).alias("exact"), "width").count().collect())
    small = sum(n for _, _, n in kinds) <= BROADCAST_WINDOWS
    found = []
    for exact, width, _ in kinds or [(False, WINDOW, 0)]:
        keys = indexed.where(((F.col("form") == EXACT) == F.lit(exact)) & (F.col("width") == width)).select("item", "form", "width", F.col("at").alias("item_at"), "hash", "slotted")
        # the outer form: the plain one would infer a filter that computes the hashes once more
        texts = _windows(rows.select("content", _tokens(F.col("text"), EXACT if exact else AS_IS).alias("tokens")))
        texts = texts.select("content", F.posexplode_outer(_hashes(texts, width)).alias("at", "hash"))
        found.append(texts.join(F.broadcast(keys) if small else keys, "hash").select("content", "item", "form", "width", "at", "item_at", "slotted"))
    matches = cut(reduce(DataFrame.unionByName, found).distinct())

    # values at the slots of both sides, for the windows that have any
    slotted = matches.where("slotted")
    # copies go before the shuffle, so a text that very many documents have is no hot key
    held = rows.select("content", "text").dropDuplicates(["content"]).join(slotted.select("content").distinct(), "content", "left_semi")
    values = held.select("content", template(F.col("text")).alias("tokens"), slot_values(F.col("text")).alias("values"))
    chosen = distinct.join(indexed.where("slotted").select("item").distinct(), "item", "left_semi")
    chars = (chosen.agg(F.sum(F.length("text"))).first()[0] or 0) if small else 0
    readings = F.array(*[F.struct(F.lit(form).alias("form"), _read(F.col("text"), form, template).alias("item_tokens"), _read(F.col("text"), form, slot_values).alias("item_values")) for form in (AS_IS, INNER, LOWERED)])
    wanted = chosen.select("item", F.explode(readings).alias("_form")).select("item", "_form.*")
    wanted = F.broadcast(wanted) if small and chars <= BROADCAST_CHARS else wanted

    def at_slots(tokens: str, values: str, at: str) -> Column:
        return F.slice(values, _slots(F.slice(tokens, F.lit(1), F.col(at))) + 1, _slots(F.slice(tokens, F.col(at) + 1, F.col("width"))))

    pairs = slotted.join(values, "content").join(wanted, ["item", "form"])
    pairs = pairs.select("content", "item", "form", "at", "item_at", F.explode_outer(F.arrays_zip(at_slots("item_tokens", "item_values", "item_at").alias("theirs"), at_slots("tokens", "values", "at").alias("ours"))).alias("pair"))
    pairs = cut(pairs.select("content", "item", "form", (F.col("at") - F.col("item_at")).alias("shift"), "at", "item_at", "pair.theirs", "pair.ours"))
    split = pairs.groupBy("content", "item", "form", "shift", "theirs").agg(F.count_distinct(F.coalesce("ours", F.lit(""))).alias("n")).where("n > 1").drop("n")
    broken = pairs.join(split, ["content", "item", "form", "shift", "theirs"], "left_semi").select("content", "item", "form", "at", "item_at").distinct()
    good = matches.join(broken, ["content", "item", "form", "at", "item_at"], "left_anti")
    held = good.groupBy("content", "item", "form").agg(F.count_distinct("item_at").alias("found"))
    named = indexed.select("item", "form", "windows").distinct()
    verdicts = held.join(named, ["item", "form"]).withColumn("share", F.col("found") / F.col("windows")).where(F.col("share") >= share)
    best = verdicts.groupBy("content", "item").agg(F.max(F.struct("share", (-F.col("form")).alias("form"), "windows", "found")).alias("best")).select("content", "item", "best.windows", "best.found", "best.share")
    ids = items.select("item", "item_id")
    return join_split(rows.select("doc_id", "content"), best, ["content"], "inner").join(ids, "item").select("doc_id", "item_id", "windows", "found", "share")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose text is not contaminated, with all their columns."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark, share).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
