"""Personal data to surrogates.

Detected entities get keyed replacements of their own kind and form: digits for digits in the same places, addresses of the same shape,
names of the same gender and script. Entities of the whole corpus are made distinct first; a surrogate that two of them share, or that
is itself an entity of the corpus, is drawn anew until none does, so distinct entities stay distinct and every mention of one gets the
same replacement. Everything is DataFrame functions; only texts with entities are joined with replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.session import materialize

# Forms of the entities. Bounded repeats and leading boundaries keep the search linear.
MALE = "Mr|Herr|Herrn|Señor|Monsieur|Sir|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Mlle|госпожа|г-жа"
NEUTRAL = "Dr|Prof"
KINDS = {
    "email": r"(?<![\w.%+@-])[A-Za-z0-9][\w.%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32}(?:[0-9a-f]{8}){0,4}|"
    r"[0-9A-F]{32}(?:[0-9A-F]{8}){0,4})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![\w])|"
    r"(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![\w])|(?<![\w+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w])",
    "name": rf"(?<![\p{{L}}\w])(?:{MALE}|{FEMALE}|{NEUTRAL})(?:\.? )\p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}(?!\p{{L}})",
}
ANY = "|".join(KINDS.values())
#: No entity is without a digit, an at sign or the start of a title or key id. Looking for them first is far cheaper than the forms.
SIGNS = "[0-9@]|(?=[MHFSDPAг])(?:Mr|Ms|Miss|Herr|Frau|Señor|Monsieur|Madame|Mme|Mlle|Sir|Dr|Prof|госп|г-н|г-ж|AKIA|ASIA)"
CARDS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:2[2-9]|[3-6][0-9]|7[01])[0-9]{13}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nico Oscar Paul".split(),
    ("latin", "female"): "Alice Berta Clara Diana Emma Frida Greta Helena Irene Julia Klara Laura Maria Nora Olga Paula".split(),
    ("latin", "neutral"): "Alex Andrea Chris Dominique Eden Frances Gabriel Jamie Jordan Kim Lee Morgan Noel Robin Sam Taylor".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Юрий".split(),
    ("cyrillic", "female"): "Алла Белла Вера Галина Дарья Ева Зоя Инна Кира Лидия Мария Нина Ольга Полина Рита Юлия".split(),
    ("cyrillic", "neutral"): "Женя Саша Валя Слава Паша Никита Миша Лёша Гена Витя Боря Аркаша Сеня Тоша Фима Яша".split(),
}
FAMILY = {
    "latin": "Alder Birch Cooper Dale Ellis Field Grove Hale Ingram Jasper Keller Linden Marsh North Olsen Potter".split(),
    "cyrillic": "Белов Волков Громов Дубов Ершов Жуков Зимин Клёнов Ладов Морев Носов Орлов Полев Родин Соколов Тихов".split(),
}
ROUNDS, WIDEN = 64, 6


def may_hold(text: Column) -> Column:
    """False only where no entity can be; never null."""
    return F.coalesce(text.rlike(SIGNS), F.lit(False))


def kind_of(mention: Column) -> Column:
    """The first kind whose form the whole mention has."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right."""
    places = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(places, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _heads(mention: Column) -> list[tuple[int, Column]]:
    """(n, the start of the mention that holds its first n digits) for the lengths of card numbers; empty if a digit follows at once."""
    return [(n, F.regexp_extract(mention, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0)) for n in range(13, 20)]


def _card(mention: Column) -> Column:
    """The digits of the first card number that the mention starts with: an expiry date or check number may follow."""
    found = [_digits(head) for _, head in _heads(mention)]
    return F.coalesce(*[F.when(d.rlike(CARDS) & luhn(d), d) for d in found])


def canonical(kind: Column, mention: Column) -> Column:
    """What two mentions of one entity have in common; null if the mention is none after all (a number that no card can have)."""
    digits = _digits(mention)
    name = F.regexp_replace(mention, rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.? ", "")
    title = F.regexp_extract(mention, rf"^({MALE}|{FEMALE}|{NEUTRAL})\.? ", 1)
    gender = F.when(title.rlike(f"^(?:{MALE})$"), "male").when(title.rlike(f"^(?:{FEMALE})$"), "female").otherwise("neutral")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "ssn"), digits)
        .when(kind == "card", _card(mention))
        .when((kind == "secret") & mention.rlike("^[0-9A-F]{32,}$"), F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "name", F.concat(gender, F.lit(":"), name))
        .otherwise(mention)
    )


def in_form(kind: Column, canon: Column) -> Column:
    """An entity in the form that surrogates have: a name without its gender."""
    return F.when(kind == "name", F.substring_index(canon, ":", -1)).otherwise(canon)


def _byte(h: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a hexadecimal text of 64 bytes, around and around."""
    return F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _scramble(text: Column, h: Column) -> Column:
    """Letters by letters of their case, digits by digits, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(h, i)
        return (
            F.when(c.between("0", "9"), (v % 10).cast("string"))
            .when(c.between("a", "z"), F.char(v % 26 + 97))
            .when(c.between("A", "Z"), F.char(v % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity at this attempt, in canonical form. Later attempts are longer, so there are always more of them."""
    sign = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    h = sign(kind, canon, attempt.cast("string"))
    more = F.when(attempt > WIDEN, F.substr(h, F.lit(97), F.least(attempt, F.lit(32)) - WIDEN)).otherwise("")
    more_digits = F.translate(more, "abcdef", "012345")
    digits = F.concat(_scramble(canon, h), more_digits)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(digits) - 2))  # the issuer's digit stays
    tens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    card = F.concat(body, F.filter(tens, lambda d: luhn(F.concat(body, d)))[0])
    domain = F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_scramble(F.substring_index(canon, "@", 1), h), more, F.lit("@"), _scramble(host, sign(F.lit("host"), domain)), F.lit(".example"))
    octets = [(_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.concat(F.substr(h, F.lit(1), F.length(canon)), more)).otherwise(
        F.concat(F.substr(canon, F.lit(1), F.lit(4)), _scramble(F.substr(canon, F.lit(5)), h), F.upper(more))
    )
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _scramble(F.substr(canon, F.lit(3)), h), more_digits)
    return (
        F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *octets)).when(kind == "secret", secret)
        .when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", _name(canon, h, attempt))
        .otherwise(digits)
    )


def _name(canon: Column, h: Column, attempt: Column) -> Column:
    gender, name = F.substring_index(canon, ":", 1), F.substring_index(canon, ":", -1)
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), _byte(h, F.lit(i)) % len(words) + 1)
    given, family = F.lit(None).cast("string"), F.when(cyrillic, pick(FAMILY["cyrillic"], 1)).otherwise(pick(FAMILY["latin"], 1))
    for (script, of), words in GIVEN.items():
        given = F.when((gender == of) & (cyrillic == F.lit(script == "cyrillic")), pick(words, 0)).otherwise(given)
    second = F.when(cyrillic, pick(FAMILY["cyrillic"], 2)).otherwise(pick(FAMILY["latin"], 2))
    third = F.when(cyrillic, pick(FAMILY["cyrillic"], 3)).otherwise(pick(FAMILY["latin"], 3))
    extra = F.concat(F.when(attempt > 0, F.concat(F.lit("-"), second)).otherwise(""), F.when(attempt > 2, F.concat(F.lit("-"), third)).otherwise(""))
    many = F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(attempt, F.lit(4))), lambda i: F.element_at(
        F.when(cyrillic, F.array(*[F.lit(w) for w in FAMILY["cyrillic"]])).otherwise(F.array(*[F.lit(w) for w in FAMILY["latin"]])),
        _byte(h, i) % 16 + 1)), "-")
    extra = F.concat(extra, F.when(attempt > 4, F.concat(F.lit("-"), many)).otherwise(""))
    parts = F.size(F.split(name, " "))
    return F.concat(F.when(parts > 1, F.concat(given, F.lit(" "))).otherwise(""), family, extra)


def render(kind: Column, whole: Column, canon: Column, new: Column) -> Column:
    """A mention's replacement: the surrogate in the mention's own form. What follows a card number stays."""
    head = F.coalesce(*[F.when((kind == "card") & (F.length(canon) == n), head) for n, head in _heads(whole)], whole)
    mention = head
    between = F.split(mention, "[0-9]", -1)
    filled = F.array_join(
        F.transform(between, lambda p, i: F.concat(p, F.when(i < F.size(between) - 1, F.substr(new, i + 1, F.lit(1))).otherwise(""))), ""
    )
    longer = F.concat(filled, F.substr(new, F.size(between)))
    spaced = F.when(mention.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    title = F.regexp_extract(mention, rf"^((?:{MALE}|{FEMALE}|{NEUTRAL})\.? )", 1)
    shouted = (F.upper(mention) == mention) & mention.rlike("[A-Z]")
    return (
        F.when(kind == "card", F.concat(longer, F.substr(whole, F.length(head) + 1)))
        .when(kind.isin("phone", "ssn"), longer).when(kind == "iban", spaced).when(kind == "name", F.concat(title, new))
        .when(kind.isin("email", "secret") & shouted, F.upper(new)).otherwise(new)
    )


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of ``entities(kind, canon)``, distinct within a kind and none of them an entity itself.

    Each round draws for those that are still without, and keeps of equal draws the one whose entity comes first; surrogates given
    before keep theirs. Rounds go on until all have one.
    """
    own = entities.withColumn("attempt", F.lit(0))
    given = None
    for _ in range(ROUNDS):
        drawn = own.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        taken = entities.select("kind", in_form(F.col("kind"), F.col("canon")).alias("surrogate"))
        if given is not None:
            taken = taken.unionByName(given.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(taken, ["kind", "surrogate"], "left_anti")
        won = materialize(first.select("kind", "canon", "surrogate"), "surrogates")
        given = won if given is None else given.unionByName(won)
        own = materialize(own.join(won, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "surrogates-open")
        if own.isEmpty():
            return given
    raise RuntimeError("entities without a surrogate of their own are left")


def replace_pii(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, ``text_col`` with surrogates for its entities, and ``pii_count`` added (a column of that name goes).

    Null texts stay null with count 0; empty texts stay. Texts without a sign of entities are passed on,
    without a shuffle. Repeated
    rows are replaced alike. Very long texts are searched whole. An empty table gives no rows. The same ``key`` gives the same first
    draw for an entity in any corpus.
    """
    columns = [c for c in docs.columns if c != "pii_count"]
    docs, text = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).alias("text")), F.col("text")
    doubtful, digest = may_hold(text), F.sha2(text, 256)
    found = docs.where(doubtful).select("text", F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)).alias("found"))
    found = materialize(found.where(F.size("found") > 0).select(digest.alias("pii_digest"), "found"), "pii-found")
    mentions = found.select(F.explode("found").alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention")))
    mentions = materialize(mentions.withColumn("canon", canonical(F.col("kind"), F.col("mention"))), "pii-mentions")
    entities = materialize(mentions.where(F.col("canon").isNotNull()).select("kind", "canon").distinct(), "pii-entities")
    surrogates = draw_surrogates(entities, key)
    known = mentions.join(surrogates, ["kind", "canon"]).select("mention", render(F.col("kind"), F.col("mention"), F.col("canon"), F.col("surrogate")).alias("new"))
    known = materialize(known.where("mention <> new"), "pii-replacements")

    places = found.dropDuplicates(["pii_digest"]).select("pii_digest", F.posexplode("found").alias("at", "own"))
    replaced = places.join(known, F.col("own") == F.col("mention"), "left").groupBy("pii_digest").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("new", "own").alias("new"), F.col("new").isNotNull().cast("int").alias("hit")))).alias("pii")
    )
    replaced = materialize(replaced, "pii-replaced")
    between = F.split(text, ANY, -1)
    filled = F.array_join(
        F.transform(between, lambda p, i: F.concat(p, F.when(i < F.size("pii"), F.get(F.col("pii.new"), i)).otherwise(""))), ""
    )
    hits = F.aggregate("pii.hit", F.lit(0), lambda a, h: a + h)
    with_pii = docs.where(doubtful).withColumn("pii_key", digest).join(replaced, F.col("pii_key") == F.col("pii_digest"), "left")
    new_text = F.when(F.col("pii").isNotNull(), filled).otherwise(text)
    kept = [new_text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns]
    changed = with_pii.select(*kept, F.coalesce(hits, F.lit(0)).alias("pii_count"))
    return docs.where(~doubtful).select("row.*", F.lit(0).alias("pii_count")).unionByName(changed)
