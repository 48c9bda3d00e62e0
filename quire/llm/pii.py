"""Surrogates for personal data, in built-in functions only.

Entities (e-mail addresses, phone, account and social security numbers, IP addresses, names after a title) are found in one pass of one pattern. Where a text has names after titles, its pattern also finds their later
mentions: the whole name without its title, the family name or the given name alone, which refer to the first titled name in the text that has them. A person's family name and given name are entities by themselves,
told apart by the title's gender and the letters' script, so every mention of a person, however short, gets the same surrogate.

Each distinct entity of the whole corpus gets a surrogate core from a keyed hash. The check for collisions takes a core only if no other entity of the corpus has it, as surrogate or as itself; the others hash again,
into longer cores after some rounds, so surrogates never run out. So equal entities, in whatever format they are written, get equal surrogates everywhere, and different ones different surrogates.
An occurrence's own format (punctuation of numbers, capitals, which names are given) is kept; family names have about as many letters as before, more if the corpus has more names than such surrogates.

Texts without a sign of an entity pass without a shuffle. Rounds of the check work on distinct entities only.

Edge cases: null texts stay null; empty texts and texts without entities are unchanged; very long texts are searched whole, in one pass; rows with null ids, repeated rows, ties and different texts under one id are all kept,
each with its own entities (a row is known by its id and a hash of its text); an empty table gives no rows; other columns are passed through, except that one named as the text is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

TYPES = ("email", "phone", "account", "ssn", "ip", "name")
#: Rounds of the check for collisions after which cores become longer.
PATIENCE = 6

#: Titles by (gender, script), given names by the same, syllables of family names by script.
TITLES = {
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"),
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor"),
    ("n", "latin"): ("Dr", "Prof"),
    ("f", "cyrillic"): ("г-жа",),
    ("m", "cyrillic"): ("г-н",),
    ("f", "arabic"): ("السيدة",),
    ("m", "arabic"): ("السيد",),
}
GIVEN = {
    ("f", "latin"): ("Alma", "Clara", "Edith", "Greta", "Ines", "Louise", "Nora", "Vera"),
    ("m", "latin"): ("Albert", "Bruno", "Emil", "Hugo", "Jonas", "Leon", "Oscar", "Victor"),
    ("n", "latin"): ("Alex", "Charlie", "Kim", "Robin", "Sam", "Toni"),
    ("f", "cyrillic"): ("Анна", "Вера", "Ирина", "Нина"),
    ("m", "cyrillic"): ("Борис", "Глеб", "Игорь", "Павел"),
    ("f", "arabic"): ("أمل", "ليلى", "مريم", "نور"),
    ("m", "arabic"): ("أحمد", "حسن", "سامي", "كريم"),
}
SYLLABLES = {
    "latin": ("bar", "dol", "fen", "gar", "hal", "kem", "lor", "mav", "nes", "pol", "ran", "sel", "tor", "ven", "wil", "zan"),
    "cyrillic": ("бар", "дол", "вен", "гар", "кал", "лор", "мав", "нес", "пол", "ран", "сел", "тор", "вил", "зан", "кем", "фед"),
    "arabic": ("بار", "دول", "فن", "غار", "هال", "كم", "لور", "ماف", "نس", "بل", "ران", "سل", "تور", "ون", "ول", "زان"),
}
#: Ends of made-up names by (gender, script): given names, family names.
GIVEN_ENDS = {("f", "latin"): "a", ("m", "latin"): "o", ("n", "latin"): "y", ("f", "cyrillic"): "а", ("m", "cyrillic"): "ий", ("f", "arabic"): "ة", ("m", "arabic"): "ي"}
FAMILY_ENDS = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов"}
_title = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_name = r"[\p{Lu}\p{Lo}][\p{L}'-]+"
#: What marks a text that may hold an entity, or a name.
NAME_SIGN = rf"(?<!\p{{L}})(?:{_title})\.? [\p{{Lu}}\p{{Lo}}]"
SIGN = rf"[0-9@]|{NAME_SIGN}"
NAME = rf"(?<!\p{{L}})(?:{_title})\.? {_name}(?: \p{{Lu}}[\p{{L}}'-]+)?"
PATTERN = "|".join((
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    rf"(?<![\p{{L}}\p{{N}}.]){_octet}(?:\.{_octet}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<![\p{L}\p{N}+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+.-])0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+.()/-])\d{3}-\d{4}(?![\p{L}\p{N}-])",
    NAME,
))
PERSON = "struct<group:string,given:string,family:string>"
ENTITY = "struct<kind:string,value:string,surrogate:string>"


def found(text: Column, pattern: Column | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$|^\d{3}-\d{4}$|^0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}$"), "phone")
        .when(value.rlike(r"^\d"), "account")
        .otherwise("name")
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def group_of(value: Column) -> Column:
    """gender:script of a name's title."""
    title = F.regexp_replace(F.substring_index(value, " ", 1), r"\.$", "")
    out = F.lit("n:latin")
    for (gender, script), titles in TITLES.items():
        out = F.when(title.isin(list(titles)), f"{gender}:{script}").otherwise(out)
    return out


def persons_of(text: Column) -> Column:
    """array<PERSON>: the names after titles in order; given is null where one name is told."""

    def person(value: Column) -> Column:
        names = F.split(value, " ")
        return F.struct(group_of(value).alias("group"), F.when(F.size(names) > 2, F.get(names, F.lit(1))).alias("given"), F.element_at(names, -1).alias("family"))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), person))


def mentions(persons: Column) -> Column:
    """The pattern of a text that names these persons."""
    names = F.flatten(F.transform(persons, lambda p: F.array(F.concat_ws(" ", p["given"], p["family"]), p["family"], p["given"])))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(F.array_compact(names)), lambda n: F.struct((-F.length(n)).alias("n"), n.alias("name")))), lambda x: x["name"])
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def occurrence(value: Column, persons: Column) -> Column:
    """struct<kind, value, title, main, identity, given>: what an occurrence is, the entity that its core comes from (`main` is its kind) and the given name's identity, if any."""
    kind, titled = kind_of(value), value.rlike(rf"^(?:{_title})\.? ")
    names = F.regexp_replace(value, rf"^(?:{_title})\.? ", "")
    whole = lambda p: F.concat_ws(" ", p["given"], p["family"])
    # the first person told whose whole, family or given name it is; after a title, of the title's gender
    fits = lambda p: (~titled | (p["group"] == group_of(value))) & ((whole(p) == names) | (p["family"] == names) | (p["given"] == names))
    who = F.get(F.filter(persons, fits), F.lit(0))
    name = lambda part: F.concat(who["group"], F.lit(":"), F.lower(part))
    only_given = (kind == "name") & (who["given"] == names) & (who["family"] != names)
    main = F.when(kind != "name", kind).when(only_given, "given").otherwise("family")
    number = F.when(kind == "phone", F.concat(F.when(F.startswith(value, F.lit("+")), "+").otherwise(""), digits(value))).otherwise(digits(value))
    identity = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).when(only_given, name(who["given"])).when(kind == "name", name(who["family"])).otherwise(number)
    both = (kind == "name") & who["given"].isNotNull() & (whole(who) == names)
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(titled, F.substring_index(value, " ", 1)).alias("title"), main.alias("main"), identity.alias("identity"), F.when(both, name(who["given"])).alias("given"))


def stream(*parts: Column) -> Column:
    """128 hexadecimal digits of a keyed hash."""
    one = F.concat_ws("|", *parts)
    return F.concat(F.sha2(F.concat(one, F.lit("|a")), 256), F.sha2(F.concat(one, F.lit("|b")), 256))


def number(hexes: Column, at: int, below: int) -> Column:
    return F.pmod(F.conv(F.substring(hexes, at, 8), 16, 10).cast("bigint"), F.lit(below))


def core(kind: Column, identity: Column, attempt: int, key: str, syllables: int) -> Column:
    """A surrogate without format: an address in lower case, digits, or a name. syllables: so many at least in a made-up name, for the number of names."""
    hexes, longer = stream(F.lit(key), kind, identity, F.lit(str(attempt))), max(0, attempt - PATIENCE)
    tables = {s: F.array(*map(F.lit, each)) for s, each in SYLLABLES.items()}

    def word(script: str, n: Column) -> Column:
        part = lambda i: F.element_at(tables[script], (F.pmod(F.conv(F.substring(hexes, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint"), F.lit(16)) + 1).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(30))), part), "")

    own = F.element_at(F.split(identity, ":"), -1)  # of a name
    group = F.substring_index(identity, ":", 2)
    like = F.greatest(F.round(F.length(own) / 3).cast("int"), F.lit(syllables)) + longer
    family, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (gender, script), listed in GIVEN.items():
        here = group == f"{gender}:{script}"
        family = F.when(here, F.concat(word(script, F.greatest(like, F.lit(2))), F.lit(FAMILY_ENDS.get((gender, script), "")))).otherwise(family)
        known = F.element_at(F.array(*map(F.lit, listed)), (number(hexes, 1, len(listed)) + 1).cast("int"))
        made = F.concat(word(script, F.greatest(F.lit(syllables), F.lit(1)) + longer), F.lit(GIVEN_ENDS[gender, script]))
        given = F.when(here, known if attempt < 2 else made).otherwise(given)
    mail = F.concat(word("latin", F.lit(3 + longer)), F.lit("."), F.lpad(number(hexes, 33, 100_000).cast("string"), 5, "0"), F.lit("@mail"), number(hexes, 41, 10).cast("string"), F.lit(".example.org"))
    octets = [number(hexes, 1 + 8 * i, 256).cast("string") for i in range(2)] + [(number(hexes, 17, 254) + 1).cast("string")]
    ip = F.concat(F.lit("10."), F.concat_ws(".", *octets))
    if longer:  # the reserved networks from 240 on, then the documentation prefix of the longer addresses
        ip = F.concat((F.lit(240) + number(hexes, 25, 15)).cast("string"), F.lit("."), F.concat_ws(".", *octets)) if longer <= PATIENCE else F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substring(hexes, 1 + 4 * i, 4) for i in range(6)]))
    figures = F.translate(hexes, "abcdef", "012345")
    same_length = F.substring(figures, F.lit(1), F.length(identity) + longer)
    # after a plus sign the country's code stays: 1, 7 or two digits
    code = F.when(identity.rlike(r"^\+[17]"), F.substring(identity, 2, 1)).otherwise(F.substring(identity, 2, 2))
    abroad = F.concat(code, F.substring(figures, F.lit(1), F.length(identity) - 1 - F.length(code) + longer))
    same_length = F.when(F.startswith(identity, F.lit("+")), abroad).otherwise(same_length)
    return F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "family", F.initcap(family)).when(kind == "given", F.initcap(given)).otherwise(same_length)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, identity, core of distinct entities; no core is another's, nor any entity's own."""
    known = common.shared_table(entities.select("kind", "identity").distinct(), "entities")
    names = known.where("kind in ('family', 'given')").groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    syllables = 1
    while 16**syllables < 4 * names:
        syllables += 1
    itself = known.select("kind", F.when(F.col("kind").isin("family", "given"), F.initcap(F.regexp_replace("identity", "^.*:", ""))).otherwise(F.regexp_replace("identity", r"^\+", "")).alias("core")).distinct()
    left, done, attempt = known, [], 0
    while True:
        tried = left.select("kind", "identity", core(F.col("kind"), F.col("identity"), attempt, key, syllables).alias("core"))
        free = tried.groupBy("kind", "core").agg(F.min("identity").alias("identity")).join(itself, ["kind", "core"], "left_anti")
        if done:
            free = free.join(reduce(DataFrame.unionByName, done).select("kind", "core"), ["kind", "core"], "left_anti")
        done.append(common.shared_table(free.select("kind", "identity", "core"), "surrogates"))
        left, before = common.shared_table(left.join(done[-1], ["kind", "identity"], "left_anti"), "left"), left
        common.drop_table(*[before] * (attempt > 0))
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        attempt += 1


def written(o: Column, core: Column, given: Column) -> Column:
    """The surrogate in the occurrence's format."""
    value, kind = o["value"], o["kind"]
    same_case = lambda x: F.when(F.regexp_replace(value, r"^\S+\. ", "") == F.upper(F.regexp_replace(value, r"^\S+\. ", "")), F.upper(x)).otherwise(x)
    # numbers: each digit is the core's at its place, and what a longer core has more follows
    place = lambda i: F.length(digits(F.substring(value, F.lit(1), i + 1)))
    laid = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(core, place(i), F.lit(1))).otherwise(c)), "")
    laid = F.concat(laid, F.substring(core, F.length(digits(value)) + 1, F.lit(64)))
    person = F.concat_ws(" ", o["title"], given, core)
    cased = F.when((kind == "name") & (F.lower(F.col("o.identity")) != F.upper(F.col("o.identity"))), F.concat_ws(" ", o["title"], same_case(F.concat_ws(" ", given, core)))).otherwise(person)
    return F.when(kind == "email", F.when(value == F.upper(value), F.upper(core)).otherwise(core)).when(kind == "ip", core).when(kind == "name", cased).otherwise(laid)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, and `__entities`: an array of (kind, value, surrogate) in order of place."""
    names = docs.columns
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__fp"), text.alias("__text"))
    sign, named = (F.coalesce(F.col("__text").rlike(p), F.lit(False)) for p in (SIGN, NAME_SIGN))
    nobody = F.array().cast(f"array<{PERSON}>")

    def parted(rows: DataFrame, *columns) -> DataFrame:
        """The rows with a sign, with `values` and what columns(pattern) tells; only texts with names have a pattern of their own."""
        plain = rows.where(sign & ~named).withColumn("persons", nobody)
        told = rows.where(sign & named).withColumn("persons", persons_of(F.col("__text")))
        own = F.when(F.size("persons") > 0, mentions(F.col("persons"))).otherwise(F.lit(PATTERN))
        return plain.select("*", *columns[0](F.lit(PATTERN))).unionByName(told.select("*", *columns[0](own)))

    seen = parted(rows.select("__id", "__fp", "__text"), lambda p: [found(F.col("__text"), p).alias("values")])
    seen = seen.select("__id", "__fp", "persons", F.posexplode("values").alias("pos", "value")).select("__id", "__fp", "pos", occurrence(F.col("value"), F.col("persons")).alias("o"))
    seen = common.shared_table(seen.distinct(), "occurrences")
    entities = seen.select(F.col("o.main").alias("kind"), F.col("o.identity").alias("identity")).unionByName(seen.where("o.given is not null").select(F.lit("given").alias("kind"), F.col("o.given").alias("identity")))
    cores = assign(entities, key)
    main = cores.select(F.col("kind").alias("__kind"), F.col("identity").alias("__identity"), "core")
    given = cores.where("kind = 'given'").select(F.col("identity").alias("__given"), F.col("core").alias("given_core"))
    told = seen.join(main, (F.col("o.main") == F.col("__kind")) & (F.col("o.identity") == F.col("__identity"))).join(given, F.col("o.given") == F.col("__given"), "left")
    told = told.select("__id", "__fp", F.struct("pos", F.col("o.kind").alias("kind"), F.col("o.value").alias("value"), written(F.col("o"), F.col("core"), F.col("given_core")).alias("surrogate")).alias("e"))
    by_doc = told.groupBy(F.col("__id").alias("__of"), F.col("__fp").alias("__like")).agg(F.sort_array(F.collect_list("e")).alias("__told"))
    # the text's pieces between the entities, each followed by a surrogate
    hit = parted(rows, lambda p: [F.split(F.col("__text"), p, -1).alias("__pieces")])
    hit = hit.join(by_doc, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__fp") == F.col("__like")), "left")
    hit = hit.select("__row", "__text", "__pieces", F.coalesce(F.transform("__told", lambda e: F.struct(e["kind"], e["value"], e["surrogate"])), F.array().cast(f"array<{ENTITY}>")).alias("__entities"))
    text = F.array_join(F.flatten(F.zip_with("__pieces", "__entities", lambda p, e: F.array(F.coalesce(p, F.lit("")), F.coalesce(e["surrogate"], F.lit(""))))), "")
    out = hit.select("__row", F.when(F.size("__entities") == 0, F.col("__text")).otherwise(text).alias("__new"), "__entities")
    plain = rows.where(~sign).select("__row", F.col("__text").alias("__new"), F.array().cast(f"array<{ENTITY}>").alias("__entities"))
    both = out.unionByName(plain)
    return both.select(*[F.col("__new").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names], "__entities")
