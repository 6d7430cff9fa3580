"""Surrogates for personal data and secrets, in DataFrame operations only.

One pattern finds the entities of a text. What an entity is about is its canonical form (digits
of a number, lower case of an address or name), and the surrogate is drawn for that form with a
secret key, so the same entity gets the same surrogate in every document and in every way of
writing it. Surrogates keep the type and the format: digits for digits, vowels for vowels and
consonants for consonants of the same script and case, country codes, top-level domains, check
digits, and given names of the same gender and script. All surrogates are then held against each
other and against all entities that occur; whatever collides is drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import join_unique, keep

# Given names by script and gender, and titles.
GIVEN = {
    "latin_f": "Anna Maria Emma Julia Laura Sarah Sophie Marie Claire Camille Isabelle Carmen Lucia Elena Sofia Ingrid Petra Sabine Ursula Emily Alice Helen Margaret Susan".split(),
    "latin_m": "John James Robert Michael William David Richard Thomas Peter Paul Pierre Jean Jacques Antoine Carlos Juan Miguel Pablo Hans Klaus Stefan Wolfgang Henry George".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "cyrillic_m": "Иван Александр Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел".split(),
}
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sra Srta Señor Señora Господин Госпожа".split()

_names = "|".join(n for group in GIVEN.values() for n in group)
_word = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Name and pattern of each type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "secret": r"(?:(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[ ]?[:=][ ]?[\"']?[A-Za-z0-9+/_.-]{8,200}|\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,200}|\bAKIA[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9A-Za-z])",
    "person": rf"\b(?:(?:{'|'.join(TITLES)})\.? (?:{_word} )?{_word}|(?:{_names}) {_word})\b",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Types whose entities have check digits, and what stands around an entity.
CHECKED = {"iban": (r"\b", r"\b"), "card": (r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])")}
#: Draws of an entity's own format and length, and after these of longer ones.
DRAWS, LONGER = 8, 4

# Vowels and consonants of a script, each drawn for its like.
_CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "äöü", "àâáéèêëíîïóôòúùû", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ",
    "ãåæõøœāăąēėęěīįōőūůűųýÿ", "çćčďđðğģķłļľñńņňřśşšșťțþźżžß", "ёєіїѐѝ", "йъьґђѓќћљњџўјѕ",
    "αεηιουω", "άέήίόύώϊϋΐΰ", "βγδζθκλμνξπρσςτφχψ", "աեէըիոօ", "բգդզթժլխծկհձղճմյնշչպջռսվտրցւփքֆև",
    "აეიოუ", "ბგდვზთკლმნპჟრსტფქღყშჩცძწჭხჯჰ",
]
#: Letters of no class, and longer forms, are drawn from consonants: of the script, else of Latin.
_CONSONANTS = {"Cyrillic": "бвгджзклмнпрстфх", "Greek": "βγδζθκλμνξπρστφχ", "Armenian": "բգդզթժլխծկհձղճմն", "Georgian": "ბგდვზთკლმნპჟრსტფ"}
_LATIN = "bcdfghjklmnpqrst"
_HEX = "0123456789abcdef"


def _may(text: Column) -> Column:
    """False only for texts in which no pattern can match, and much cheaper than the patterns: all
    have a digit, an @, an equals sign or colon, a key's prefix, a title or a listed name."""
    out = text.contains("@") | text.contains("=") | text.contains(":") | text.rlike("[0-9]")
    for part in ("sk-", "sk_", "pk-", "pk_", "ghp", "xox", "AKIA", *TITLES, *(n for group in GIVEN.values() for n in group)):
        out = out | text.contains(part)
    return out


def _has(text: Column) -> Column:
    return F.coalesce(_may(text) & text.rlike(PATTERN), F.lit(False))


def _draw(seed: Column, i: Column) -> Column:
    """A number that follows from seed and place."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")


def _like(c: Column, draw: Column, hexadecimal: Column) -> Column:
    """A character of the class of c."""
    pick = lambda chars: F.substring(F.lit(chars), F.pmod(draw, F.lit(len(chars))).cast("int") + 1, F.lit(1))
    out = F.when(hexadecimal & F.lit(_HEX).contains(c), pick(_HEX))
    for chars in _CLASSES:
        out = out.when(F.lit(chars).contains(c), pick(chars))
    for chars in _CLASSES[1:]:
        upper = "".join(x.upper() for x in chars if len(x.upper()) == 1)
        out = out.when(F.lit(upper).contains(c), pick(upper))
    for script, chars in _CONSONANTS.items():
        out = out.when(c.rlike(rf"^(?=\p{{L}})\p{{Is{script}}}$"), pick(chars))
    return out.when(c.rlike(r"^\p{Lu}$"), pick(_LATIN.upper())).when(c.rlike(r"^\p{L}$"), pick(_LATIN)).otherwise(c)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid card number."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _mod97(chars: Column) -> Column:
    """The remainder of a number in which A is 10 and Z is 35."""
    return F.aggregate(_chars(chars), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def _checked(text: Column) -> tuple[Column, Column]:
    """Whether anything in the text has the form of an entity with check digits, and the pattern
    in which of these forms only those of the text stand whose check digits are right."""
    at_each = lambda kind: F.regexp_extract_all(text, F.lit(f"(?=({PATTERNS[kind]}))"), F.lit(1))
    cards, ibans = at_each("card"), at_each("iban")
    right = {"card": F.filter(F.array_distinct(cards), lambda c: F.pmod(_luhn(F.regexp_replace(c, "[^0-9]", "")), F.lit(10)) == 0)}
    # Words after an IBAN can look like its last groups: all of its beginnings are tried, the
    # longest first.
    starts = F.flatten(F.transform(F.array_distinct(ibans), lambda c: F.transform(F.sequence(F.size(F.split(c, " ")), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(F.split(c, " "), F.lit(1), n), " "))))
    plain = lambda c: F.regexp_replace(c, " ", "")
    right["iban"] = F.filter(F.array_distinct(starts), lambda c: c.rlike(f"^(?:{PATTERNS['iban']})$") & (_mod97(F.concat(F.substring(plain(c), 5, 99), F.substring(plain(c), 1, 4))) == 1))
    pattern = []
    for name, general in PATTERNS.items():
        if name in CHECKED:
            before, after = CHECKED[name]
            longest = F.reverse(F.array_sort(F.transform(right[name], lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
            pattern.append(F.when(F.size(right[name]) > 0, F.concat(F.lit(f"(?:{before}(?:"), F.array_join(F.transform(longest, lambda x: x["c"]), "|"), F.lit(f"){after})"))).otherwise(F.lit("(?!)")))
        else:
            pattern.append(F.lit(f"(?:{general})"))
    return (F.size(cards) + F.size(ibans)) > 0, F.concat_ws("|", *pattern)


def _surrogate(kind: Column, form: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 256)
    hexadecimal = (kind == "secret") & form.rlike("^[0-9a-f]+$")
    like = F.array_join(F.transform(_chars(form), lambda c, i: _like(c, _draw(seed, i), hexadecimal)), "")
    # The first digit stays a card's, the last makes the check sum what it was.
    body = F.concat(F.substring(form, 1, 1), F.expr("substring(_like, 2, length(_like) - 2)"))
    card = F.concat(body, F.pmod(_luhn(form) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    octets = F.array_join(F.transform(F.split(form, r"\."), lambda o, i: (F.pmod(_draw(seed, i), F.lit(254)) + 1).cast("string")), ".")
    rest = F.expr("substring(_like, 3)")
    iban = F.concat(F.lpad((98 - _mod97(F.concat(rest, F.col("tail"), F.lit("00")))).cast("string"), 2, "0"), rest)
    return like, F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "iban", iban).otherwise(F.col("_like"))


def _kind(entity: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        test = entity.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _parts(kind: Column, entity: Column) -> Column:
    """What of an entity gets surrogates of its own: an array of (kind, form, tail). tail is kept
    beside the form and tells forms apart, as a domain tells local parts apart."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    part = lambda k, form, tail="": F.struct(F.lit(k).alias("kind"), form.alias("form"), (F.lit(tail) if isinstance(tail, str) else tail).alias("tail"))
    address = F.lower(entity)
    domain = F.substring_index(address, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 2)
    secret = F.regexp_extract(entity, r"([A-Za-z0-9+/_.-]+)[\"']?$", 1)
    names = F.filter(F.split(F.regexp_replace(entity, rf"^(?:{'|'.join(TITLES)})\.? ", ""), "[ -]"), lambda w: ~w.rlike(f"^(?:{_names})$"))
    country = F.regexp_extract(entity, r"^\+([0-9]{1,3})[ .(-]", 1)
    return (
        F.when(kind == "email", F.array(part("local", F.substring_index(address, "@", 1), domain), part("host", host, top)))
        .when(kind == "person", F.transform(names, lambda w: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("form"), F.lit("").alias("tail"))))
        .when(kind == "secret", F.array(part("secret", secret)))
        .when(kind == "iban", F.array(part("iban", F.regexp_replace(F.substring(entity, 3, 99), " ", ""), F.substring(entity, 1, 2))))
        .when(kind == "phone", F.array(part("phone", F.expr("substring(_digits, length(_country) + 1)"), country)))
        .when(kind == "ip", F.array(part("ip", entity)))
        .when(kind == "card", F.array(part("card", digits)))
        .otherwise(F.array(part("ssn", digits)))
    ), digits, country


def _given(key: str) -> dict[str, str]:
    """Each listed given name's own surrogate: the next one of its list in the order of keyed
    hashes, so a list maps onto itself and nobody keeps a name."""
    import hashlib

    out = {}
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, form, tail, to) of distinct (kind, form, tail): keyed, like the form, different from
    every other surrogate and from every form that occurs with that tail."""
    drawn = parts.withColumn("attempt", F.lit(0))
    forms = parts.select("kind", F.col("form").alias("to"), "tail").withColumn("real", F.lit(True))
    # If too few of the form are left, as for names of two letters, what still collides gives way to
    # a longer print of its own, in letters of its script or in digits.
    print_of = F.sha2(F.concat_ws("|", F.lit(key), "kind", "form", "tail", F.col("attempt").cast("string")), 256)
    letters = None
    for script, chars in _CONSONANTS.items():
        test, own_print = F.col("form").rlike(rf"\p{{Is{script}}}"), F.translate(F.substring(print_of, 1, 12), _HEX, chars)
        letters = F.when(test, own_print) if letters is None else letters.when(test, own_print)
    letters = letters.otherwise(F.translate(F.substring(print_of, 1, 12), _HEX, _LATIN))
    digits = F.translate(F.substring(F.concat(print_of, print_of), F.lit(1), F.length("form") + 2), "abcdef", "012345")
    longer = F.when(F.col("kind").isin("card", "ssn", "phone"), digits).otherwise(letters)
    for attempt in range(DRAWS + LONGER):
        like, final = _surrogate(F.col("kind"), F.col("form"), key, F.col("attempt"))
        to = final if attempt < DRAWS else F.when(F.col("attempt") < DRAWS, final).otherwise(longer)
        own = keep(drawn.withColumn("_like", like).withColumn("to", to).drop("_like"), "surrogates")
        taken = own.groupBy("kind", "to", "tail").agg(F.min("form").alias("owner"), F.count(F.lit(1)).alias("n"))
        taken = taken.join(forms, ["kind", "to", "tail"], "left").where("n > 1 or real")
        clash = own.join(taken, ["kind", "to", "tail"]).where("real or form <> owner").select("kind", "form", "tail", F.lit(True).alias("again"))
        clash = keep(clash, "clashes")
        if clash.limit(1).count() == 0:
            return own.select("kind", "form", "tail", "to")
        drawn = own.drop("to").join(clash, ["kind", "form", "tail"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(False)).cast("int")).drop("again")
    raise ValueError("surrogates collide however long they get: is the key's hash known to the texts' writer?")


def _written(kind: Column, entity: Column, to: Column, given: Column, title: Column) -> Column:
    """The entity's surrogate in the entity's format; to: canonical surrogates by kind and form."""
    get = lambda k, form, tail=F.lit(""): F.element_at(to, F.concat_ws("|", F.lit(k), form, tail))
    # Case and separators come from the entity: each of its letters and digits takes the next one.
    def fill(form: Column, by: Column, what: str) -> Column:
        source = _chars(by)
        step = F.aggregate(
            _chars(form), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
            lambda a, c: F.when(c.rlike(what), F.struct(F.concat(a["out"], F.when(c.rlike(r"\p{Lu}"), F.upper(F.get(source, a["i"]))).otherwise(F.get(source, a["i"]))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
        )
        return F.concat(step["out"], F.array_join(F.slice(source, step["i"] + 1, F.greatest(F.size(source) - step["i"], F.lit(0))), ""))

    address = F.lower(entity)
    domain = F.substring_index(address, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 2)
    email = F.concat(fill(F.substring_index(entity, "@", 1), get("local", F.substring_index(address, "@", 1), domain), "."), F.lit("@"), get("host", host, top), F.lit("."), F.substring_index(entity, ".", -1))
    secret = F.regexp_extract(entity, r"([A-Za-z0-9+/_.-]+)[\"']?$", 1)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    country = F.regexp_extract(entity, r"^\+([0-9]{1,3})[ .(-]", 1)
    national = F.expr("substring(_entity, case when _country = '' then 1 else length(_country) + 2 end)")
    number = F.concat(F.when(country != "", F.concat(F.lit("+"), country)).otherwise(""), fill(national, get("phone", F.expr("substring(_digits, length(_country) + 1)"), country), "[0-9]"))
    head = F.regexp_extract(entity, rf"^((?:{'|'.join(TITLES)})\.? )?", 0)
    tail = F.expr("substring(_entity, length(_head) + 1)")
    name = lambda w: F.coalesce(F.element_at(given, w), F.initcap(get("name", F.lower(w))))
    names = F.array_join(F.transform(F.split(tail, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), name), "-")), " ")
    return digits, country, head, (
        F.when(kind == "email", email)
        .when(kind == "person", F.concat(head, names))
        .when(kind == "secret", F.concat(F.regexp_extract(entity, r"^(.*?)[A-Za-z0-9+/_.-]+[\"']?$", 1), get("secret", secret), F.regexp_extract(entity, r"([\"']?)$", 1)))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), fill(F.substring(entity, 3, 99), get("iban", F.regexp_replace(F.substring(entity, 3, 99), " ", ""), F.substring(entity, 1, 2)), "[A-Z0-9]")))
        .when(kind == "phone", number)
        .when(kind == "ip", get("ip", entity))
        .when(kind == "card", fill(entity, get("card", digits), "[0-9]"))
        .otherwise(fill(entity, get("ssn", digits), "[0-9]"))
    )


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text with all entities replaced, n_entities, kinds.

    key is the secret: with another one all surrogates change. Null texts stay null and have no
    entities, as do texts without any. Rows that repeat come out alike; entities that repeat in
    any document have one surrogate; null ids are allowed; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    has = _has(F.col("text"))
    print_of = F.struct("id", F.xxhash64("text"), F.octet_length("text"))
    shaped, own = _checked(F.col("text"))
    private = docs.where(has).withColumn("pattern", F.when(shaped, own).otherwise(F.lit(PATTERN)))
    private = keep(private.select("id", "text", "pattern", print_of.alias("row"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("hits")), "private")
    none, private = private.where(F.size("hits") == 0).select("id", "text"), private.where(F.size("hits") > 0)
    found = keep(private.select("row", F.explode(F.array_distinct("hits")).alias("entity")).distinct(), "entities")

    # Distinct entities, how many rows have them, and their parts.
    entities = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    kinds = entities.withColumn("kind", F.coalesce(_kind(F.col("entity")), F.lit("ssn")))
    array, digits, country = _parts(F.col("kind"), F.col("entity"))
    kinds = keep(kinds.withColumn("_digits", digits).withColumn("_country", country).withColumn("parts", array).drop("_digits", "_country"), "kinds")
    parts = kinds.select(F.explode("parts").alias("p")).select("p.*").distinct()
    to = surrogates(keep(parts, "parts"), key)
    each = kinds.select("entity", F.explode("parts").alias("p")).select("entity", "p.*").join(to, ["kind", "form", "tail"])
    each = each.groupBy("entity").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "form", "tail"), "to"))).alias("map"))
    table = kinds.drop("parts").join(each, "entity", "left").withColumn("map", F.coalesce("map", F.create_map().cast("map<string,string>")))
    given = F.create_map(*(F.lit(x) for pair in _given(key).items() for x in pair))
    digits, country, head, written = _written(F.col("kind"), F.col("_entity"), F.col("map"), given, None)
    table = table.withColumn("_entity", F.col("entity")).withColumn("_digits", digits).withColumn("_country", country).withColumn("_head", head)
    table = keep(table.select("entity", "kind", "n", written.alias("written")), "written")

    total = max(found.count(), 1)
    by_row = join_unique(found, table, "entity", "n", total, "inner").groupBy("row").agg(F.collect_set(F.struct("entity", "kind", "written")).alias("found"))
    changed = private.join(by_row, "row")
    lookup = F.map_from_entries(F.transform("found", lambda x: F.struct(x["entity"], x["written"])))
    between = F.split(F.col("text"), F.col("pattern"), F.lit(-1))
    new = F.array_join(F.transform(F.arrays_zip(F.col("between"), F.col("hits")), lambda x: F.concat(x["between"], F.coalesce(F.element_at(F.col("lookup"), x["hits"]), F.lit("")))), "")
    changed = changed.select("id", between.alias("between"), "hits", lookup.alias("lookup"), "found")
    changed = changed.select(F.col("id").alias(id_col), new.alias("text"), F.size("hits").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))).alias("kinds"))
    same = docs.where(~has).select("id", "text").unionByName(none).select(F.col("id").alias(id_col), "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)
