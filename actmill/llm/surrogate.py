"""Operator 3: surrogates for personal data. DataFrame functions only.

PATTERNS find e-mail addresses, secrets (hexadecimal strings and prefixed keys), IPv4 addresses, telephone numbers, IBANs,
social security numbers, payment cards and names after an honorific. Each distinct part of an entity gets one surrogate,
made from SHA-256 of the key, the part and an attempt number, so that it has the same surrogate everywhere (coreference)
and nobody without the key can make or undo it:

* characters are replaced within their kind (digit, lower-case or upper-case letter; hexadecimal digit in secrets), all
  punctuation stays; the top-level domain, country code and first card digit stay; a card number that passes the Luhn
  check gets one that passes it, an IBAN with right check digits gets right ones; each IPv4 octet becomes an octet;
* an address is its local part and its domain, a name its honorific, its given name and its surname: each domain, given
  name and surname is an entity of its own, so that a domain is the same in all addresses, and "Herr Klaus Meyer",
  "Herr. Meyer" and "Frau Meyer" share a surname. Honorifics stay as they are; given names get one of their gender and
  script, surnames are made of syllables of the same script, and names in Cyrillic keep their feminine ending.

Names are one to three capitalised words after an honorific, with particles (von, de) between them, which stay; the first
of several is the given name. Names without an honorific are not found.

Collision checks: entities of one kind that share a surrogate, or whose surrogate is itself an entity of the table, make
another attempt, but for the first of them, until none is left; from ROOMIER attempts on surrogates get extra characters,
so that a crowded format cannot go on forever. As parts are distinct, so are the addresses and names made of them. Given
names come from short lists, and are made of syllables with an ending of their gender where the list has been used up.

Defined results: a null text stays null and has no entity; an empty text stays empty; repeated entities are replaced
each time, and rows equal in all columns get the same result; a null doc_id is a row like any other. Other columns stay
as they are; n_entities and kinds replace columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed
from actmill.llm.ordering import apart

# Honorifics that tell the gender, and those that do not; words inside surnames.
TITLES, NEUTRAL, PARTICLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Señor Señora Господин Госпожа".split(), "Dr Prof".split(), "von van der den de da del di la".split()
#: A word of a name: O'Brien, McDonald and Jean-Luc are one each.
_WORD = r"\p{Lu}(?:\p{L}*\p{Ll}|['’]\p{Lu}\p{L}+)(?:-\p{Lu}\p{L}+)*"
_NAME = rf"(?<!\p{{L}})(?:{'|'.join(TITLES + NEUTRAL)})\.? {_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) )*{_WORD}){{0,2}}(?![\p{{L}}'’-])"
#: Kinds in order of preference where two could start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\d.(-])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "name": _NAME,
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What each pattern needs, in searches that are much cheaper: a text without any of it has no entity.
HINTS = ("[@0-9]", r"[a-f]{32}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z]{16}", rf"(?:{'|'.join(TITLES + NEUTRAL)})\.? \p{{Lu}}")
#: Where the title says nothing, a given name that ends like a woman's decides.
MALE = r"^(?:Mr|Herr|Monsieur|Señor|Господин)(?:\.| )|^(?:Dr|Prof)\.? (?!\p{L}*[aая] )"
GIVEN = {
    ("latin", "m"): "Adam Boris Carl David Emil Felix Georg Hugo Ivo Jonas Karl Leo Max Noel Otto Paul".split(),
    ("latin", "f"): "Alma Berta Clara Dora Emma Flora Greta Hanna Ida Julia Klara Lena Mona Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Инна Клара".split(),
}
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ra se ti vo wa ze lu".split(),
    "cyrillic": "ба де фи го ку ла ме ни по ра се ти во ва зе лу".split(),
}
ROOMIER, MOST_ATTEMPTS = 8, 64
HONORIFIC = r"^\p{L}+\.? "


def kind_of(entity: Column) -> Column:
    """The first kind that matches the whole entity."""
    return reduce(lambda rest, k: F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(rest), reversed(list(PATTERNS)), F.lit(None).cast("string"))


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    """A number from 0 to n - 1, place i of the stream of a seed."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _letter(alphabet: str, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, alphabet)), at + 1)


def _like(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each character replaced by one of its kind."""
    small = "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        digit = _letter(small if hexadecimal else "0123456789", _draw(seed, i, 16 if hexadecimal else 10))
        low = _letter(small, _draw(seed, i, len(small)))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(seed, i, 26))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _seed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of an array of digits: every second one from the right, after the last, is doubled."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def parts_of(entity: Column) -> Column:
    """An array of (kind, part): what an entity is made of, in order. Only addresses and names have several parts."""
    kind = kind_of(entity)
    one = lambda k, x: F.struct(k.alias("kind"), x.alias("part"))
    names = F.split(F.regexp_replace(entity, HONORIFIC, ""), " ")
    gender = F.when(entity.rlike(MALE), "m").otherwise("f")
    family = F.concat(F.lit("family"), F.when(entity.rlike("\\p{IsCyrillic}"), gender).otherwise(""))
    kind_at = lambda x, i: F.when(x.isin(PARTICLES), "particle").when((i == 0) & (F.size(names) > 1), F.concat(F.lit("given"), gender)).otherwise(family)
    name = F.transform(names, lambda x, i: one(kind_at(x, i), x))
    mail = F.array(one(F.lit("local"), F.substring_index(entity, "@", 1)), one(F.lit("domain"), F.lower(F.substring_index(entity, "@", -1))))
    return F.when(kind == "email", mail).when(kind == "name", name).otherwise(F.array(one(kind, entity)))


def put_together(entity: Column, made: Column) -> Column:
    """The surrogate of an entity from those of its parts, in order."""
    mail = F.concat_ws("@", made)
    return F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), mail).when(entity.rlike(f"^(?:{PATTERNS['name']})$"), F.concat(F.regexp_extract(entity, HONORIFIC, 0), F.array_join(made, " "))).otherwise(F.element_at(made, 1))


def _rest_of_97(iban: Column) -> Column:
    """The number of an IBAN modulo 97: letters count as 10 to 35, the first four characters stand last."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97)


def surrogate_of(kind: Column, part: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a part at an attempt; a pure function of its arguments."""
    seed = _seed(key, kind, part, attempt.cast("string"))
    more = F.when(attempt >= ROOMIER, _like(F.lit("000000"), F.concat(seed, F.lit("+")))).otherwise("")
    domain = F.concat(_like(F.regexp_extract(part, r"^(.*)\.[A-Za-z]+$", 1), seed), more, F.lit("."), F.regexp_extract(part, r"([A-Za-z]+)$", 1))
    secret_head = F.regexp_extract(part, r"^(sk|pk|ghp|AKIA)?[-_]?", 0)
    rest = F.substring(part, F.length(secret_head) + 1, F.length(part))
    secret = F.when(part.rlike("^[0-9a-f]+$"), F.concat(_like(part, seed, hexadecimal=True), more)).otherwise(F.concat(secret_head, _like(rest, seed), more))
    octets = F.array_join(F.transform(F.split(part, r"\."), lambda o, i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    country = F.regexp_extract(part, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(country, _like(F.substring(part, F.length(country) + 1, F.length(part)), seed), more)
    # Check digits come last: with 00 in their place, they are 98 less the rest.
    body = F.concat(_like(F.substring(part, 5, 64), seed), more)
    digits = F.lpad((98 - _rest_of_97(F.concat(F.substring(part, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    iban = F.concat(F.substring(part, 1, 2), F.when(_rest_of_97(part) == 1, digits).otherwise(_like(F.substring(part, 3, 2), seed)), body)
    first = F.substring(part, 1, 1)
    drawn = F.concat(first, _like(F.substring(part, 2, 64), seed))
    # The last digit is turned so that the Luhn sum is what it was.
    turn = F.pmod(_luhn(_digits(part)) - _luhn(_digits(drawn)), F.lit(10))
    last = F.substring(drawn, -1, 1).cast("int")
    card = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.pmod(last + turn, F.lit(10)).cast("string"), more)
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    listed = lambda g: F.when(script == "latin", F.element_at(F.array(*map(F.lit, GIVEN["latin", g])), _draw(seed, 0, len(GIVEN["latin", g])) + 1)).otherwise(F.element_at(F.array(*map(F.lit, GIVEN["cyrillic", g])), _draw(seed, 0, len(GIVEN["cyrillic", g])) + 1))

    def surname(alphabet: str) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.lit(3) + F.least(attempt, F.lit(6))), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[alphabet])), _draw(seed, i, 16) + 1))
        return F.initcap(F.array_join(pieces, ""))

    def given(gender: str) -> Column:
        """One of the list; at later attempts a made name that ends like those of its gender."""
        latin, cyrillic = {"m": ("n", "н"), "f": ("na", "на")}[gender]
        made = F.when(script == "cyrillic", F.concat(surname("cyrillic"), F.lit(cyrillic))).otherwise(F.concat(surname("latin"), F.lit(latin)))
        return F.when(attempt == 0, listed(gender)).otherwise(made)

    family = F.when(script == "cyrillic", F.concat(surname("cyrillic"), F.when(kind == "familyf", "ва").otherwise("в"))).otherwise(surname("latin"))
    made = {"local": F.concat(_like(part, seed), more), "domain": domain, "secret": secret, "ip": octets, "phone": phone, "iban": iban, "ssn": F.concat(_like(part, seed), more), "card": card, "givenm": given("m"), "givenf": given("f"), "family": family, "familym": family, "familyf": family}
    return reduce(lambda rest, k: F.when(kind == k, made[k]).otherwise(rest), made, part)


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, part, surrogate) of the distinct rows; no two parts of a kind share one.

    A listed given name may be one that somebody in the table has: lists are short and the whole name differs.
    """
    # Few bytes but long expressions: dealt out by a fixed number, or all would be one task's.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = parts.select("kind", "part").distinct().repartition(tasks, "kind", "part").withColumn("attempt", F.lit(0))
    made = surrogate_of(F.col("kind"), F.col("part"), F.col("attempt"), key)
    current = checkpointed(distinct.withColumn("surrogate", made))
    known = current.select("kind", F.col("part").alias("surrogate"))
    for _ in range(MOST_ATTEMPTS):
        shared = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "part")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("kind", "surrogate", "owner")
        real = current.filter("kind not like 'given%' or attempt > 0").join(known, ["kind", "surrogate"], "left_semi").select("kind", "part")
        clash = current.join(shared, ["kind", "surrogate"]).filter("part <> owner.part").select("kind", "part").unionByName(real).distinct()
        if clash.isEmpty():
            break
        again = current.join(clash.withColumn("again", F.lit(1)), ["kind", "part"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        current = checkpointed(again.select("kind", "part", "attempt", F.when(F.col("again").isNull(), F.col("surrogate")).otherwise(made).alias("surrogate")))
    else:
        raise ValueError("surrogates still collide")
    return current.select("kind", "part", "surrogate")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with its text rewritten, n_entities, and kinds: the kind of each entity, in text order.

    key is the secret from which surrogates are made; it is an argument and never stored.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_entities", "kinds")
    row, found, put = (apart(docs, x) for x in ("row_key", "found", "put"))
    none = F.array().cast("array<string>")
    hinted = F.col("text").isNotNull() & (F.col("text").rlike(HINTS[0]) | F.col("text").rlike(HINTS[1]) | F.col("text").rlike(HINTS[2]))
    clean = docs.filter(~F.when(hinted, F.col("text").rlike(ENTITY)).otherwise(False)).withColumns({"n_entities": F.lit(0), "kinds": none})
    # The texts with entities are few and are written, so that the long pattern is run once over each.
    with_found = docs.filter(hinted).withColumn(found, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    marked = checkpointed(with_found.filter(F.size(found) > 0).withColumn(row, F.xxhash64("text")))
    # A text's entities depend on the text alone: equal texts are looked up once.
    texts = marked.groupBy(row).agg(F.first(found).alias(found))
    places = texts.select(row, F.posexplode(found).alias("place", "entity"))
    # Each different entity is taken apart and put together once.
    entities = checkpointed(places.select("entity").distinct().withColumn("parts", parts_of(F.col("entity"))))
    parts = entities.select("entity", F.posexplode("parts").alias("at", "p")).select("entity", "at", "p.kind", "p.part")
    table = surrogates(parts.filter("kind <> 'particle'").select("kind", "part"), key)
    shown = parts.join(table, ["kind", "part"], "left").withColumn("surrogate", F.coalesce("surrogate", "part"))
    made = shown.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    whole = made.select("entity", put_together(F.col("entity"), F.col("s.surrogate")).alias("surrogate"), kind_of(F.col("entity")).alias("kind"))
    answers = places.join(whole, "entity").groupBy(row).agg(F.sort_array(F.collect_list(F.struct("place", "surrogate", "kind"))).alias(put))
    split = F.split("text", ENTITY, -1)
    rebuilt = F.array_join(F.zip_with(split, F.col(f"{put}.surrogate"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    done = marked.join(answers, row).select(*(rebuilt.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.size(put).alias("n_entities"), F.col(f"{put}.kind").alias("kinds"))
    return clean.unionByName(done)
