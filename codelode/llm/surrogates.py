r"""Personal data replaced by surrogates (operator 5).

Found are e-mail addresses, IPv4 addresses, payment card numbers (with a right check digit), telephone
numbers and names behind a title. Every mention is traced to an entity: the address in lower case, the
digits without country prefix and punctuation, the words of a name one by one with gender and script.
An entity's surrogate follows from a keyed hash, so it is the same in all documents, and cannot be traced
back without the key; each mention gets it in its own format (case, punctuation, prefix, check digit).

Distinctness is checked, not hoped for: a candidate that another entity of the type has or wants, or that
is itself an entity of the texts, is given up and the entity with the greater hash tries again. A format
with few possible values is left in steps: first its fixed parts, then its length.

A number behind a country code ends with the digits of that code's plan. Where the plan isn't fixed it has up to
15 digits, its blanks stand before its hyphens, and dots stand alone; a number behind it that goes on in that way
can't be told from it. No telephone number reaches into an IP address. A name has up to three words, which may hold
capitals, hyphens and apostrophes or be initials.

Not looked for: names without a title or behind one that tells no gender (Dr, Prof), further titles, particles in
small letters (von, de), IPv6 addresses, national numbers other than (ddd) ddd-dddd, ddd-ddd-dddd and ddd.ddd.dddd,
and numbers of less than eight digits.

DataFrame functions only. Texts are scanned where they are; what is shuffled are the mentions, and the
texts of those documents that have one. A hot entity or text is reduced before the shuffle or split
by adaptive joins.

Edge cases: null and empty texts stay as they are; rows that repeat are replaced alike; ids aren't used;
further columns stay, `n_replaced` steps aside for a clashing name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import free_name, settled

# Titles by gender, in the languages that are looked for.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "господин")
# Words that surrogate names are made of.
GIVEN = {
    "female Latin": ("Anna", "Clara", "Dora", "Elsa", "Frida", "Greta", "Helen", "Ida", "Julia", "Laura", "Maria", "Nora"),
    "male Latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Leo", "Martin"),
    "female Cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Нина", "Ольга", "Тамара"),
    "male Cyrillic": ("Антон", "Борис", "Денис", "Иван", "Михаил", "Олег", "Павел", "Юрий"),
}
SURNAME = {
    "Latin": (
        ("Alder", "Birken", "Castel", "Dal", "Elm", "Fair", "Gal", "Hol", "Kal", "Lin", "Mar", "Nor", "Oster", "Rav", "Sol", "Wal"),
        ("beck", "dorf", "field", "gard", "holm", "land", "mont", "rose", "stedt", "ton", "vale", "wood"),
    ),
    "Cyrillic": (
        ("Бел", "Вор", "Гор", "Дом", "Зим", "Кор", "Лес", "Мор", "Нов", "Пол", "Сол", "Тар"),
        ("аев", "анов", "енко", "ин", "кин", "ов", "овский", "уев"),
    ),
}

_WORD = r"\p{L}\p{N}._%+-"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_EMAIL = rf"(?<![{_WORD}])[{_WORD}]{{1,64}}+@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,8}}\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}])"
_QUAD = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\p{{N}}|\.\p{{N}})"
_IP = rf"(?<![\p{{N}}.]){_QUAD}"
_CARD = r"(?<!\p{N})(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\p{N})"
# What divides a number; no IP address begins behind it.
_BLANK, _HYPHEN = rf" (?!{_QUAD})", rf"-(?!{_QUAD})"
_GAP = rf"(?:{_BLANK}|{_HYPHEN}|\.)"
# Country codes by the digits that all their numbers have.
_PLANS = {10: "1|7|44|91", 9: "3[134]|4[18]|61", 8: "4[57]"}
_PLANNED = "|".join(
    rf"(?:{codes})(?:{_GAP}|\(){{0,2}}\d(?:(?:{_GAP}(?=\d\d)|[()]){{0,2}}\d){{{digits - 1}}}(?!\p{{N}})"
    for digits, codes in _PLANS.items()
)
# Four pairs with dots may be the end of a number although they look like an IP address.
_OTHER = (
    r"\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])"
    rf"(?:(?!{_QUAD})|(?=\d\d(?:\.\d\d){{3}}(?!\p{{N}})))"
    rf"(?:\d{{2,4}}(?:\.\d{{2,4}}){{1,3}}"
    rf"|(?:(?:\d{{2,4}}{_BLANK})?\d{{5,10}}|\d{{2,4}}(?:{_BLANK}\d{{2,4}}){{0,3}})(?:{_HYPHEN}\d{{2,4}}){{0,3}})"
    rf"(?<!\d{r'[ .()-]{0,3}\d' * 15})"
)
_PHONE = (
    rf"(?<![\p{{N}}+])(?:\+(?:{_PLANNED}|\d{{8,15}}(?!\.?\p{{N}})|{_OTHER})"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\p{N})"
)
# The country code: what is divided from the rest, or else by the codes there are.
_COUNTRY = (
    r"^\+(?:\d{1,3}(?=\D)|(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?=\d))"
)
# Initials, or a word of two letters at least with its hyphens and apostrophes.
_CASED = r"[\p{Lu}\p{Ll}\p{M}]"
_PART = (
    rf"(?:(?:\p{{Lu}}\.){{1,3}}+"
    rf"|\p{{Lu}}(?:{_CASED}|(?=['’-]\p{{Lu}})){_CASED}*+(?:(?:-|['’](?=\p{{Lu}})){_CASED}++)*+)"
)
_NAME = (
    rf"(?<!\p{{L}})(?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? "
    rf"{_PART}(?: {_PART}){{0,2}}"
)
MENTION = "|".join((_EMAIL, _IP, _CARD, _PHONE, _NAME))
#: Attempts from which an entity may leave its format's fixed parts, and its length.
_FREE, _LONGER = 8, 24
ATTEMPTS = 64


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column, odd: int) -> Column:
    """The sum of digits from the right, doubled at every second one (places 1, 3 ... if odd is 1)."""

    def step(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == odd, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _traced(matches: DataFrame) -> DataFrame:
    """(match, kind, parts): the entities of each distinct mention, as structs of place, type, canonical."""
    match = F.col("match")
    kind = (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^{_IP}$"), "ip")
        .when(match.rlike(rf"^{_CARD}$") & (_luhn(_digits(match), 0) % 10 == 0), "card")
        .when(match.rlike(rf"^(?:{_PHONE})$") & (F.length(_digits(match)) >= 8), "phone")
        .when(match.rlike(rf"^{_NAME}$"), "name")
    )
    plain = F.when(F.col("kind") == "email", F.lower(match)).when(
        F.col("kind") == "phone", _digits(F.regexp_replace(match, _COUNTRY, ""))
    ).when(F.col("kind") == "card", _digits(match)).otherwise(match)
    gender = F.when(match.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? "), "female").otherwise("male")
    script = F.when(match.rlike(r" \p{IsCyrillic}"), "Cyrillic").otherwise("Latin")
    words = F.slice(F.split(match, " "), 2, 3)
    named = F.transform(
        words,
        lambda word, k: F.struct(
            k.alias("place"),
            F.when(k == F.size(words) - 1, F.concat(F.lit("surname "), script))
            .otherwise(F.concat(F.lit("given "), gender, F.lit(" "), script)).alias("type"),
            F.lower(word).alias("canonical"),
        ),
    )
    single = F.array(F.struct(F.lit(0).alias("place"), F.col("kind").alias("type"), plain.alias("canonical")))
    return (
        matches.withColumn("kind", kind).filter("kind is not null")
        .withColumn("parts", F.when(F.col("kind") == "name", named).otherwise(single))
    )


def _spread(hexadecimal: Column, low: int, high: int, *places: int) -> Column:
    """A number from low to high - 1 of four hexadecimal digits at each place."""
    number = F.conv(F.concat(*(F.substring(hexadecimal, p, 4) for p in places)), 16, 10).cast("long")
    return low + number % (high - low)


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (number % len(words) + 1).cast("int"))


def _like(text: Column, hexadecimal: Column) -> Column:
    """Letters and digits by others, each script by its own; marks stay."""
    letters = {"[а-яё]": "бвгджзклмнпрстуф", r"\p{L}": "abcdefghkmnprstv"}

    def other(char: Column, place: Column) -> Column:
        # 48 of the 64 digits, so that a long text doesn't repeat soon; the place shifts them then.
        digit = F.conv(F.substring(hexadecimal, 1 + place % 48, F.lit(1)), 16, 10).cast("int")
        shifted = (digit + F.floor(place / 48).cast("int")) % 16
        chosen = F.when(char.rlike("[0-9]"), (shifted % 10).cast("string"))
        for kind, alphabet in letters.items():
            chosen = chosen.when(char.rlike(kind), F.substring(F.lit(alphabet), shifted + 1, F.lit(1)))
        return chosen.otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _candidate(key: str) -> Column:
    """The surrogate that an entity (type, canonical) wants at its n-th attempt."""
    kind, own, attempt = F.col("type"), F.col("canonical"), F.col("attempt")
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, own, attempt.cast("string")), 256)
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.substring_index(own, "@", -1)), 256)
    ending = F.substring_index(own, ".", -1)
    email = F.concat(
        _like(F.substring_index(own, "@", 1), digest),
        F.when(attempt >= _FREE, F.concat(F.lit("."), attempt.cast("string"))).otherwise(""),
        F.lit("@"),
        _like(F.regexp_extract(own, r"@([^.]*)", 1), domain),
        F.lit(".example."),
        F.when(ending.isin("com", "net", "org"), ending).otherwise("org"),
    )
    # Addresses that nobody has: the reserved block, and for private ones a private block.
    private = own.rlike(r"^(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.")
    first = F.when(private & (attempt < _FREE), F.lit(10)).when(
        attempt < _FREE, _spread(digest, 240, 255, 1)
    ).otherwise(_spread(digest, 1, 255, 1))
    ip = F.concat_ws(".", *(x.cast("string") for x in (first, *(_spread(digest, 0, 256, p) for p in (5, 9, 13)))))
    # Hexadecimal digits as decimal ones; two digests, as numbers have up to 19 digits and more to spare.
    decimal = F.translate(F.concat(digest, F.sha2(digest, 256)), "abcdef", "246135")
    size = F.length(own) + F.when(attempt >= _LONGER, 2).otherwise(0)
    drawn = F.substring(decimal, F.lit(1), size)
    phone = F.when(
        (F.length(own) == 10) & (F.substring(own, 4, 3) == "555") & (attempt < _FREE),
        F.concat(F.substring(drawn, 1, 3), F.lit("555"), F.substring(drawn, 7, 4)),
    ).otherwise(drawn)
    body = F.concat(F.substring(own, 1, 1), F.substring(drawn, F.lit(2), size - 2))
    card = F.concat(body, ((10 - _luhn(body, 1) % 10) % 10).cast("string"))

    def name(parts) -> Column:
        return F.lower(parts)

    result = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    more = F.conv(F.substring(digest, 13, 12), 16, 10).cast("long")
    # A name that is taken grows by another word, and then by letters.
    for group, words in GIVEN.items():
        longer = F.concat(_pick(words, number), F.lit("-"), _pick(words, more))
        value = F.when(attempt == 0, _pick(words, number)).when(attempt < _FREE, longer).otherwise(
            F.concat(longer, F.lit("-"), _like(own, digest))
        )
        result = result.when(kind == f"given {group}", name(value))
    for group, (starts, ends) in SURNAME.items():
        one = F.concat(_pick(starts, number), _pick(ends, F.floor(number / 64)))
        two = F.concat(one, F.lit("-"), _pick(starts, more), _pick(ends, F.floor(more / 64)))
        value = F.when(attempt == 0, one).when(attempt < _FREE, two).otherwise(F.concat(two, F.lit("-"), _like(own, digest)))
        result = result.when(kind == f"surname {group}", name(value))
    return result


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate) of distinct entities (type, canonical); no two of a type share one."""
    entities = settled(entities, "pii-entities")
    originals = entities.select("type", F.col("canonical").alias("surrogate"))
    pending, done = entities.withColumn("attempt", F.lit(0)), None
    for _ in range(ATTEMPTS):
        wanted = pending.withColumn("surrogate", _candidate(key)).join(originals, ["type", "surrogate"], "left_anti")
        if done is not None:
            wanted = wanted.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        # Of those that want the same, the one with the least hash gets it.
        rank = F.struct(F.xxhash64("canonical", F.lit(key)).alias("hash"), F.col("canonical").alias("canonical"))
        won = settled(
            wanted.groupBy("type", "surrogate").agg(F.min(rank)["canonical"].alias("canonical"))
            .select("type", "canonical", "surrogate"),
            "pii-surrogates",
        )
        done = won if done is None else done.unionByName(won)
        pending = settled(
            pending.join(won, ["type", "canonical"], "left_anti").withColumn("attempt", F.col("attempt") + 1),
            "pii-pending",
        )
        if pending.isEmpty():
            return done
    raise RuntimeError("Some entities found no surrogate of their own; their format has too few values.")


def _filled(pattern: Column, digits: Column) -> Column:
    """The pattern with its digits replaced in order; digits beyond them stand behind the last."""
    filled = F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit(1).alias("next"), F.lit("").alias("out")),
        lambda state, char: F.when(
            char.rlike("[0-9]"),
            F.struct(
                (state["next"] + 1).alias("next"),
                F.concat(state["out"], F.substring(digits, state["next"], F.lit(1))).alias("out"),
            ),
        ).otherwise(F.struct(state["next"].alias("next"), F.concat(state["out"], char).alias("out"))),
        lambda state: state["out"],
    )
    return F.concat(filled, F.substring(digits, F.length(_digits(pattern)) + 1, F.lit(9)))


def _rendered(traced: DataFrame, surrogates: DataFrame) -> DataFrame:
    """(match, replacement): the surrogates of each mention in its own format."""
    match, new = F.col("match"), F.col("surrogate")
    prefix, rest = F.regexp_extract(match, _COUNTRY, 0), F.regexp_replace(match, _COUNTRY, "")
    one = (
        F.when(F.col("kind") == "email", F.when(match == F.upper(match), F.upper(new)).otherwise(new))
        .when(F.col("kind") == "phone", F.concat(prefix, _filled(rest, new)))
        .when(F.col("kind") == "card", _filled(match, new))
        .when(F.col("kind") == "name", F.initcap(F.regexp_replace(new, "-", " ")))
        .otherwise(new)
    )
    parts = traced.select("match", "kind", F.explode("parts").alias("part")).select("match", "kind", "part.*")
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " "
    )
    return (
        parts.join(surrogates, ["type", "canonical"]).withColumn("text", one)
        .withColumn("text", F.when(F.col("kind") == "name", F.regexp_replace("text", " ", "-")).otherwise(F.col("text")))
        .groupBy("match", "kind").agg(whole.alias("text"))  # up to three words of a name
        .select(
            "match",
            F.when(F.col("kind") == "name", F.concat_ws(" ", F.substring_index("match", " ", 1), "text"))
            .otherwise(F.col("text")).alias("replacement"),
        )
    )


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with personal data replaced, and `n_replaced`, the number of mentions.

    `key` is the secret of the surrogates. Equal keys give equal surrogates for entities whose
    candidates are free in both tables.
    """
    count, found, digest = (free_name(docs, n) for n in ("n_replaced", "_found", "_digest"))
    scanned = docs.withColumn(found, mentions(F.col(text)))
    touched = F.coalesce(F.size(found), F.lit(0)) > 0
    hits = scanned.filter(touched).withColumn(digest, F.sha2(text, 256))
    # Texts stand for their rows, so that copies add nothing.
    places = hits.select(
        F.col(digest).alias("digest"), F.posexplode(found).alias("place", "match")
    ).distinct()
    places = settled(places, "pii-mentions")
    traced = settled(_traced(places.select("match").distinct()), "pii-matches")
    entities = traced.select(F.explode("parts").alias("part")).select("part.type", "part.canonical").distinct()
    rendering = settled(_rendered(traced, assigned(entities, key)), "pii-replacements")
    new = places.join(rendering, "match", "left").select(
        "digest", "place", F.coalesce("replacement", "match").alias("text"),
        F.col("replacement").isNotNull().cast("long").alias("one"),
    )
    # The mentions of one text.
    by_text = new.groupBy("digest").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("_new"),
        F.sum("one").alias("_count"),
    )
    own = [c for c in docs.columns if c != text]
    rebuilt = F.array_join(
        F.zip_with(F.split(F.col(text), MENTION, -1), "_new", lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), ""
    )
    changed = hits.join(by_text, hits[digest] == by_text["digest"]).select(
        *own, rebuilt.alias(text), F.col("_count").alias(count)
    )
    same = scanned.filter(~touched).select(*own, text, F.lit(0).cast("long").alias(count))
    return same.unionByName(changed).select(*docs.columns, count)
