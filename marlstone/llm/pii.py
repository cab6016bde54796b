"""Surrogates for personal data, in DataFrame expressions alone.

Entities are found by patterns: e-mail addresses, IP addresses, card and phone numbers, US social security numbers, IBANs,
keys of 32 or more hexadecimal digits, and names after a title. Each distinct entity (an address in any case, a number in
any layout) has one row in a dictionary, with a surrogate made from a keyed SHA-512: digits for digits, letters for letters,
a given name of the same gender and script. A name has two rows, one for its last word and one for what stands before it, so
that Mr. John Smith, Mr. Smith and Mrs. Ann Smith keep one surname, in all documents. A surrogate that another entity has or that is itself found in
the corpus is made anew with the next attempt number, until all differ; so distinct entities stay distinct, and all
mentions of one stay alike; surnames grow longer with the attempts, so there is no end of them. The surrogate is then laid out as
the mention was: separators, case, checksum.

Documents without entities pass through; the others, with the places of their entities, are written once, joined with the
dictionary by entity, and put together again by row. No text is grouped, and nothing reaches the driver but counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, remove, written

#: Titles by gender and script, and given names to draw from.
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor", "Sir"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Mme"),
    ("m", "cyrillic"): ("Господин",),
    ("f", "cyrillic"): ("Госпожа",),
    ("m", "greek"): ("Κύριος",),
    ("f", "greek"): ("Κυρία",),
    ("n", "latin"): ("Dr", "Prof", "Professor", "Mx"),
}
GIVEN = {
    ("m", "latin"): ("Adrian", "Bruno", "Conrad", "Dominic", "Emil", "Felix", "Gustav", "Hugo", "Ivo", "Julian", "Kaspar", "Leon", "Martin", "Nicolas", "Oscar", "Paul"),
    ("f", "latin"): ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина"),
    ("m", "greek"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Ειρήνη", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"),
    ("n", "latin"): ("Alex", "Andrea", "Chris", "Dominique", "Jean", "Jo", "Kai", "Kim", "Luca", "Nico", "Noa", "Robin", "Sam", "Sascha", "Toni", "Val"),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne no ra re ri ro sa".split(),
    "cyrillic": "ба бе бо да де до ка ко ла ле ли ло ма ме ми мо".split(),
    "greek": "βα βε δα δε κα κε κο λα λε λι μα με μι να νε νο".split(),
}

#: Capitalised words that end a name; those of the second line may be one, right after a title.
STOP = "The An This That These Those He She It They We You His Her Its Their My Our Your And But Or So If When While As At In On Of For From To With By After Before Then There Here Who What Where Why How Is Was Has Had Will Not No Yes All Some Many Most Later Today Yesterday Tomorrow Now Der Die Das Und Aber Le La Les Et Mais El Los Las Pero".split()
DATES = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Lunes Martes Jueves Viernes Domingo Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre".split()

ALL_TITLES = {g: (*names, *(n.upper() for n in names)) for g, names in TITLES.items()}
TITLE = "|".join(t for names in ALL_TITLES.values() for t in names)
_END = r"(?![\p{L}\p{M}])"
_NO_STOP, _NO_DATE = (rf"(?!(?:{'|'.join([*words, *(w.upper() for w in words)])}){_END})" for words in (STOP, DATES))
#: A word of a name: an initial, or a capital and letters of either case, over hyphens and apostrophes but for a genitive's.
NAME = r"\p{Lu}(?:\.(?= {1,4}\p{Lu})|[\p{L}\p{M}]*+(?:(?:-|['’](?!s(?!\p{L})))\p{L}[\p{L}\p{M}]*+)*+)"
PARTICLES = "van|von|der|den|de|del|della|di|da|do|dos|du|la|le|bin|al|ter|zu|af|av"
#: Possessive and anchored, so that a long run without an entity costs its length once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:]))(?:[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}))(?![\w:])",
    "card": r"(?<![\w.+\-])(?:\d{16}|3[47]\d{13}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|3[47]\d{2} \d{6} \d{5})(?![\w\-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[.\- ])\d{3}[.\- ]\d{4}|\+\d(?:[ .\-()]{0,2}\d){7,14})(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: \d{4}){3,7}+(?: \d{1,3})?)(?!\w)",
    "key": r"(?<!\w)(?=[a-fA-F]*+\d)[0-9a-fA-F]{32,}+(?!\w)",
    "name": r"(?<!\p{L})(?:" + TITLE + r")\.? {1,4}+" + _NO_STOP + NAME + r"(?:(?: {1,4}+(?:" + PARTICLES + r")){0,3}+ {1,4}+" + _NO_STOP + _NO_DATE + NAME + r")*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap look first: most texts have none of these.
HINT = r"[0-9@]|(?:" + TITLE + r")\.? +"


def kind_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("key"))


def normal_form(kind: Column, entity: Column) -> Column:
    """What all mentions of one entity share."""
    digits = F.regexp_replace(entity, r"\D", "")
    name = F.regexp_replace(F.regexp_replace(entity, r"^\S+ +", ""), " +", " ")
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.replace(entity, F.lit(" "))).when(kind == "name", name).when(kind == "ipv6", _groups(entity)).otherwise(F.lower(entity))


def _groups(address: Column) -> Column:
    """An IPv6 address in full: eight groups of four digits in small letters."""
    full = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    left, right = full(F.substring_index(address, "::", 1)), F.when(address.contains("::"), full(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0000"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.concat(left, zeros, right), ":")


def _byte(digest: Column, k) -> Column:
    """Byte k (from 0, modulo 64) of a hexadecimal digest."""
    return F.conv(F.substring(digest, (k % 64) * 2 + 1, F.lit(2)) if isinstance(k, Column) else F.substring(digest, (k % 64) * 2 + 1, 2), 16, 10).cast("int")


def _alike(text: Column, digest: Column, skip: int = 0) -> Column:
    """text with digits and small letters replaced by keyed ones, position by position; other characters stay."""
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, (i + skip) * 7 % 61)
        return F.when(c.rlike("^[0-9]$"), (b % 10).cast("string")).when(c.rlike("^[a-z]$"), F.char(b % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _address(digest: Column) -> Column:
    """An IPv6 address of the prefix for documents, with 64 keyed bits around two groups of zeros."""
    group = lambda k: F.concat(F.substring(F.lit("123456789abcdef"), _byte(digest, k) % 15 + 1, F.lit(1)), F.substring(digest, k * 2 + 3, 3))
    return F.concat_ws(":", F.lit("2001:db8"), group(8), group(16), F.lit("0:0"), group(24), group(32))


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second one from the right doubled, modulo 10."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, form: Column, title: Column, key: str, attempt: Column) -> Column:
    """The keyed replacement of a normal form; attempt tells apart what it was made anew for."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string")), 512)
    drawn = _alike(form, digest)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    email = F.concat(_alike(local, digest), F.lit("@"), F.concat_ws(".", _alike(F.element_at(F.split(domain, r"\."), 1), digest, 31), F.lit("example"), F.substring_index(domain, ".", -1)))
    email = F.when(F.length(local) < 4, F.concat(F.substring(F.sha2(digest, 256), 1, 8), F.lit("."), email)).otherwise(email)
    ip = F.concat_ws(".", *[(_byte(digest, k) % 254 + 1).cast("string") for k in range(4)])
    head = F.substring(drawn, F.lit(1), F.length(form) - 1)
    valid = _luhn(form) == 0
    check = (10 - _luhn(F.concat(head, F.lit("0")))) % 10
    card = F.concat(head, F.when(valid, check).otherwise((check + 1 + _byte(digest, 63) % 9) % 10).cast("string"))
    area = F.when(F.length(form) > 10, F.length(form) - 10).otherwise(0)
    phone = F.concat(F.substring(form, F.lit(1), area), F.substring(drawn, area + 1, F.length(form)))
    iban = F.concat(F.substring(form, 1, 2), F.upper(_alike(F.lower(F.substring(form, F.lit(3), F.length(form))), digest)))
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(form) / 128).cast("int")), lambda i: F.sha2(F.concat(digest, i.cast("string")), 512)), "")
    hexed = F.substring(F.when(F.length(form) > 256, long).otherwise(F.concat(digest, digest)), F.lit(1), F.length(form))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", _address(digest)).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", drawn).when(kind == "iban", iban).when(kind == "key", hexed).otherwise(_name(kind, form, title, digest, attempt))


def _name(kind: Column, form: Column, style: Column, digest: Column, attempt: Column) -> Column:
    """For a surname one of four syllables in its script and one more an attempt; for given names one of the style, with such a
    word after it where there were several or where the first choice was taken."""
    def draw(values, b: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), b % len(values) + 1)

    def word(script: str, at: int) -> Column:
        more = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i < attempt, draw(SYLLABLES[script], _byte(digest, i + at + 4))).otherwise(""))
        return F.initcap(F.concat(*[draw(SYLLABLES[script], _byte(digest, at + k)) for k in range(4)], F.array_join(more, "")))

    def made(gender: str, script: str) -> Column:
        given = draw(GIVEN[gender, script], _byte(digest, 1))
        more = form.contains(" ") | (attempt > 0)
        return F.when(kind == "surname", word(script, 10)).when(more, F.concat_ws(" ", given, word(script, 20))).otherwise(given)

    return reduce(lambda c, g: c.when(style == f"{g[0]} {g[1]}", made(*g)), GIVEN, F.when(F.lit(False), F.lit(""))).otherwise(made("n", "latin"))


def surname_style(style: Column) -> Column:
    """A surname's style is its script alone, so that all of a family share it."""
    return F.concat(F.lit("f "), F.substring_index(style, " ", -1))


def style_of(kind: Column, entity: Column) -> Column:
    """Gender and script of a name, by its title; empty for other entities."""
    title = F.regexp_extract(entity, r"^([^ .]+)", 1)
    return F.coalesce(*[F.when((kind == "name") & title.isin(*names), F.lit(f"{g} {s}")) for (g, s), names in ALL_TITLES.items()], F.lit(""))


def is_shouted(name: Column) -> Column:
    """Whether a name is in capitals; a single initial doesn't tell."""
    return name.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


def lay_out(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate in the mention's own layout and case."""
    chars = F.split(entity, "")
    marks = F.transform(chars, lambda c: F.when(c.rlike(r"^\d$"), 1).otherwise(0))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(made, F.aggregate(F.slice(marks, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x), F.lit(1))).otherwise(c)), "")
    spaced = F.trim(F.regexp_replace(made, "(.{4})", "$1 "))
    upper = (entity == F.upper(entity)) & (entity != F.lower(entity))
    shouted = is_shouted(F.regexp_replace(entity, r"^\S+ +", ""))
    return (
        F.when(kind.isin("card", "phone", "ssn"), filled)
        .when(kind == "iban", F.when(entity.contains(" "), spaced).otherwise(made))
        .when(kind == "ipv6", F.when(upper, F.upper(F.when(entity.contains("::"), F.replace(made, F.lit(":0:0:"), F.lit("::"))).otherwise(made))).when(entity.contains("::"), F.replace(made, F.lit(":0:0:"), F.lit("::"))).otherwise(made))
        .when(kind == "name", F.concat(F.regexp_extract(entity, r"^\S+ +", 0), F.when(shouted, F.upper(made)).otherwise(made)))
        .otherwise(F.when(upper, F.upper(made)).otherwise(made))
    )


def dictionary(found: DataFrame, key: str, most: int = 64) -> DataFrame:
    """kind, form, style, made of the distinct entities of found(kind, form, style): surrogates all different and none of them an
    entity, whatever the case. Only those that clash are made anew; the others are written once."""
    known = written(found.groupBy("kind", "form", "style").agg(F.count("*").alias("mentions")).drop("mentions"), "entities")
    real = known.select("kind", F.lower("form").alias("low"))
    settled, open_ = [], known
    for attempt in range(most):
        made = open_.withColumn("made", surrogate(F.col("kind"), F.col("form"), F.col("style"), key, F.lit(attempt))).withColumn("low", F.lower("made"))
        taken = reduce(DataFrame.unionByName, [real, *(t.select("kind", F.lower("made").alias("low")) for t in settled)])
        first = made.groupBy("kind", "low").agg(F.min(F.struct("form", "style")).alias("first"))
        marked = made.join(first, ["kind", "low"]).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "low"], "left")
        clash = F.col("taken").isNotNull() | (F.struct("form", "style") != F.col("first"))
        marked = written(marked.select("kind", "form", "style", "made", clash.alias("clash")), "surrogates")
        settled.append(marked.where("not clash").drop("clash"))
        if marked.where("clash").isEmpty():
            return reduce(DataFrame.unionByName, settled)
        open_ = marked.where("clash").select("kind", "form", "style")
    raise ValueError("entities outnumber their surrogates")


#: A dictionary of at most so many rows is broadcast, so that a very common entity is no key of a shuffle.
SMALL = 1 << 16


def replace(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with each entity in text_col replaced; with `counts`, a column n_replaced (or that name after underscores).

    A null or empty text stays as it is. Rows that repeat get equal texts. Mentions without a
    title of a name that has one elsewhere in its text, or of its last word, are replaced and counted, too, but for words that
    are a day's or a month's. Notations of one IPv6 address are one entity, and so are names in any case. Columns keep their names, types and order,
    whatever they are called. A text of any length is looked through whole; where two patterns fit at one place, the one that
    is named first counts. An empty table gives an empty one.
    """
    columns = list(docs.columns)
    rid, ents, count, row, new, names = (fresh(x, columns) for x in ("_rid", "_ents", "n_replaced", "_row", "_new", "_names"))
    text = F.col(text_col)
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    clean = docs.where(~has)
    held = written(docs.where(has).withColumn(ents, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).withColumn(rid, F.monotonically_increasing_id()), "entities")
    spots = held.select(F.col(rid).alias("rid"), F.posexplode(ents).alias("at", "entity"))
    spots = spots.withColumn("kind", kind_of(F.col("entity")))
    spots = written(spots.withColumn("form", normal_form(F.col("kind"), F.col("entity"))).withColumn("style", style_of(F.col("kind"), F.col("entity"))), "spots")
    named, last = F.col("kind") == "name", lambda c: F.substring_index(c, " ", -1)
    spots = spots.select("rid", "at", "entity", "kind", "form", F.when(named, "surname").otherwise(F.col("kind")).alias("k"), F.when(named, F.lower(last(F.col("form")))).otherwise(F.col("form")).alias("f"), F.when(named, surname_style(F.col("style"))).otherwise(F.col("style")).alias("s"), F.when(named & F.col("form").contains(" "), F.lower(F.regexp_replace("form", " [^ ]+$", ""))).alias("given"), "style")
    parts = spots.select(F.explode(F.array(F.struct(F.col("k").alias("kind"), F.col("f").alias("form"), F.col("s").alias("style")), F.struct(F.lit("given").alias("kind"), F.col("given").alias("form"), "style"))).alias("p")).select("p.*").where("form is not null")
    table = dictionary(parts, key)
    if table.count() <= SMALL:
        table = F.broadcast(table)
    main = table.select(F.col("kind").alias("k"), F.col("form").alias("f"), F.col("style").alias("s"), F.col("made").alias("own"))
    before = table.where("kind = 'given'").select(F.col("form").alias("given"), "style", F.col("made").alias("first"))
    spots = spots.join(main, ["k", "f", "s"]).join(before, ["given", "style"], "left").withColumn("made", F.concat_ws(" ", "first", "own"))
    laid = spots.select("rid", F.struct("at", lay_out(F.col("kind"), F.col("entity"), F.col("made")).alias("new"), F.when(F.col("kind") == "name", F.col("form")).alias("form"), "made").alias("spot"))
    rows = laid.groupBy("rid").agg(F.sort_array(F.collect_list("spot")).alias("spots")).select(F.col("rid").alias(row), F.transform("spots", lambda s: s["new"]).alias(new), F.filter("spots", lambda s: s["form"].isNotNull()).alias(names))
    joined = held.join(rows, F.col(rid) == F.col(row))
    plain = F.split(text, ANY, -1)
    full = F.transform(names, lambda s: F.struct(s["form"].alias("form"), s["made"].alias("made")))
    pairs = F.concat(full, F.transform(F.filter(full, lambda s: s["form"].contains(" ")), lambda s: F.struct(last(s["form"]).alias("form"), last(s["made"]).alias("made"))))
    # in capitals, too; what is written so at its first place is so at the others
    pairs = F.transform(pairs, lambda s: F.struct(s["form"].alias("form"), F.when(is_shouted(s["form"]), F.upper(s["made"])).otherwise(s["made"]).alias("made")))
    pairs = F.concat(pairs, F.transform(pairs, lambda s: F.struct(F.upper(s["form"]).alias("form"), F.upper(s["made"]).alias("made"))))
    pairs = F.filter(pairs, lambda s: ~F.initcap(s["form"]).isin(*STOP, *DATES))  # alone, such a word is more often the date
    joined = joined.withColumn(names, pairs)
    known = F.reverse(F.array_sort(F.transform(names, lambda s: F.struct(F.length(s["form"]).alias("n"), s["form"].alias("form")))))
    mention = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(F.transform(known, lambda s: F.concat(F.lit(r"\Q"), F.replace(s["form"], F.lit(" "), F.lit(r"\E +\Q")), F.lit(r"\E"))), "|"), F.lit(r")(?!-?[\p{L}\p{M}])"))

    def renamed(piece: Column) -> Column:
        again = F.transform(F.regexp_extract_all(piece, mention, F.lit(0)), lambda m: F.filter(F.col(names), lambda s: s["form"] == F.regexp_replace(m, " +", " "))[0]["made"])
        return F.array_join(F.flatten(F.zip_with(F.split(piece, mention, -1), again, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

    named = F.size(names) > 0
    pieces = F.when(named, F.transform(plain, renamed)).otherwise(plain)
    later = F.when(named, F.aggregate(F.transform(plain, lambda p: F.size(F.regexp_extract_all(p, mention, F.lit(0)))), F.lit(0), lambda a, x: a + x)).otherwise(0)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = joined.select(*[(whole.alias(c) if c == text_col else F.col(c)) for c in columns], (F.size(ents) + later).cast("long").alias(count))
    out = out.unionByName(clean.withColumn(count, F.lit(0).cast("long")))
    return out if counts else out.select(*columns)
