"""Personal data replaced by surrogates, DataFrame functions only.

Detected entities get keyed replacements of their own kind: an e-mail address stays one, a phone
number keeps its punctuation and country code, an address of four octets stays valid, a card number
and an IBAN keep passing (or failing) their check sums, letters keep their case and script.  Names keep
their pattern of vowels and consonants and the ending that tells a gender; a name found after a title
is replaced where it stands alone in the same text, too.

An entity's letters and digits go through a keyed permutation of all strings of its own shape (a
Feistel network: by turns, one half is shifted by what a keyed hash makes of the other half).  So an
entity has one surrogate in the whole corpus (coreference), two entities never share one, and the
surrogate is computed in the row that holds it.  A check over the distinct entities of the corpus looks
for surrogates that are other entities of it, and for shared ones, which only letters of scripts
without an alphabet here or impossible check digits can make; these few exceptions get another
permutation.  Shapes of few strings (short names, short numbers) may be full, with no other string left:
there a surrogate that is an entity stays, distinct from all other surrogates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import stored

KEY = "surrogates-1"  # the secret that surrogates are derived with: a parameter of every call
ROUNDS = 4  # of the Feistel network
TRIES = 3  # further permutations that an exception may get
ROOM = 10_000  # strings of a shape, whoever shares it, above which surrogates may be no entity of the corpus

# -- fixed values: titles, by the gender that they tell ------------------------------------------------
MALE_TITLES = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "госпожа")

# -- fixed values: letters that take each other's place -------------------------------------------------
#: of names
NAME_ALPHABETS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "աեէըիօու", "բգդզթժլխծկհձղճմյնշչպջռսվտրցփքֆ",
)
#: of everything else
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
)
HEXADECIMAL = "abcdef"
#: first code point and number of letters of scripts with many
RANGES = ((0x4E00, 0x5200), (0xAC00, 0x2BA4), (0x3041, 0x56), (0x30A1, 0x5A))

# -- detection --------------------------------------------------------------------------------------
_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
#: What kinds that start a word look like, most specific first.
WORD_PATTERNS = {
    "email": r"[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?=\.[A-Za-z]{2,}(?![A-Za-z]))",
    "secret": r"[0-9a-fA-F]{32,128}(?![A-Za-z0-9])",
    "person": rf"(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,3}}(?![\p{{L}}\d])",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: What kinds that start with a digit or a bracket look like.
NUMBER_PATTERNS = {
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": (
        r"(?:(?<=\+\d{1,3}[ .-]{0,1})\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
        r"|(?<![\d.-])\d{3}[. -]\d{3}[. -]\d{4}(?![\d-])"
        r"|(?<=\+\d{1,3}[ .-])\d{1,4}(?:[ .-]\d{2,4}){2,3}(?![\d.])"
        r"|(?<=\+)\d{8,15}(?!\d))"
    ),
}
# a place inside a word costs two looks at single characters
PATTERN = (
    rf"(?<![\p{{L}}0-9._%+-])(?=[\p{{L}}0-9._%+-])(?:{'|'.join(WORD_PATTERNS.values())})|(?=[0-9(])(?:{'|'.join(NUMBER_PATTERNS.values())})"
)
_TITLE = rf"^(?:{_TITLES})\.? "
_PERSON = rf"{_TITLE}\p{{Lu}}\p{{Ll}}"
_HINT = rf"[0-9@]|(?:{_TITLES})[. ]"  # texts without any of these hold no entity
_DIGIT_KINDS = ("card", "ssn", "phone")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def names_of(mentions: Column) -> Column:
    """The names, each once, of the persons among a text's mentions, as written and in capitals."""
    persons = F.filter(mentions, lambda m: m.rlike(_PERSON))
    names = F.flatten(F.transform(persons, lambda m: F.split(F.regexp_replace(m, _TITLE, ""), "[ -]")))
    return F.array_distinct(F.concat(names, F.transform(names, F.upper)))


def pattern_of(names: Column) -> Column:
    """The pattern of entities with the given names among them."""
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def found_in(text: Column) -> Column:
    """Struct of a text's entity mentions, in order, and the gaps before, between and after them.

    Names of persons found after a title count wherever they stand; null gives null, a text without
    entities no mentions and no gaps.
    """
    none = F.array().cast("array<string>")

    def parted(pattern: Column, mentions: Column) -> Column:
        return F.struct(mentions.alias("mentions"), F.split(text, pattern, -1).alias("gaps"))

    def seen(mentions: Column) -> Column:
        def with_names(names: Column) -> Column:
            everywhere = parted(pattern_of(names), F.regexp_extract_all(text, pattern_of(names), F.lit(0)))
            return F.when(F.size(names) > 0, everywhere).otherwise(parted(F.lit(PATTERN), mentions))

        nothing = F.struct(none.alias("mentions"), none.alias("gaps"))
        return F.when(F.size(mentions) > 0, _bound(names_of(mentions), with_names)).otherwise(nothing)

    first = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    return _bound(first, seen)


def kind_of(mention: Column) -> Column:
    """The kind of a mention, from its own looks."""
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(_PERSON), "person")
        .when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(mention.rlike(r"^\p{Lu}[\p{Lu}\p{Ll}]+$"), "name")
        .when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,}$"), "iban")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^[\d -]{13,}$") & F.length(F.regexp_replace(mention, "[^0-9]", "")).between(13, 19), "card")
        .otherwise("phone")
    )


def key_of(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, lower case of others."""
    return F.when(kind.isin(*_DIGIT_KINDS), F.regexp_replace(mention, "[^0-9]", "")).otherwise(F.lower(mention))


def described(mention: Column) -> Column:
    """A mention as struct (mention, kind, parts): parts are the (kind, key) that it stands for.

    One part, or one per name of a person; a name is the same entity in every role.
    """

    def parts(kind: Column) -> Column:
        tokens = F.split(F.regexp_replace(mention, _TITLE, ""), "[ -]")
        named = F.transform(tokens, lambda t: F.struct(F.lit("name").alias("kind"), F.lower(t).alias("key")))
        one = F.array(F.struct(kind.alias("kind"), key_of(kind, mention).alias("key")))
        return F.struct(
            mention.alias("mention"), F.when(kind == "name", "person").otherwise(kind).alias("kind"), F.when(kind == "person", named).otherwise(one).alias("parts")
        )

    return _bound(kind_of(mention), parts)


# -- surrogates -------------------------------------------------------------------------------------

SIGN = "struct<c:string,of:int,at:int,wide:int>"  # a sign, its alphabet (-1: it stays), place in it and size


def _sign(c: Column, of: int, at: Column, wide: int) -> Column:
    return F.struct(c.alias("c"), F.lit(of).alias("of"), at.cast("int").alias("at"), F.lit(wide).alias("wide"))


def _placed(c: Column, alphabets: tuple[str, ...], first: int) -> Column:
    """A sign's place in the alphabet that holds it, else null."""
    out = F.lit(None).cast(SIGN)
    for k, letters in reversed(list(enumerate(alphabets))):
        out = F.when(F.instr(F.lit(letters), c) > 0, _sign(c, first + k, F.instr(F.lit(letters), c) - 1, len(letters))).otherwise(out)
    return out


_NAMES_AT, _HEX_AT, _RANGES_AT, _OCTETS_AT, _HASHED = 20, 40, 50, 60, 70


def _code(c: Column) -> Column:
    """Code point of a sign of the basic plane."""
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def _other(c: Column) -> Column:
    """Letters of large alphabets; the rest turns Latin, by a hash that says which."""
    out = _sign(c, _HASHED, F.pmod(F.xxhash64(c), F.lit(26)), 26)
    for k, (first, wide) in reversed(list(enumerate(RANGES))):
        out = F.when(_code(c).between(first, first + wide - 1), _sign(c, _RANGES_AT + k, _code(c) - first, wide)).otherwise(out)
    return out


def _fixed(c: Column) -> Column:
    return _sign(c, -1, F.lit(0), 1)


def _octet(o: Column) -> Column:
    """Octets of one width are an alphabet of their own."""
    return (
        F.when(F.length(o) == 1, _sign(o, _OCTETS_AT, o.cast("int"), 10))
        .when(F.length(o) == 3, _sign(o, _OCTETS_AT + 1, o.cast("int") - 100, 156))
        .when(o.startswith("0"), _sign(o, _OCTETS_AT + 2, o.cast("int"), 10))
        .otherwise(_sign(o, _OCTETS_AT + 3, o.cast("int") - 10, 90))
    )


def letters_of(entity: Column) -> Column:
    return F.split(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""), "")


def signs_of(kind: Column, entity: Column, letters: Column) -> Column:
    """An entity's letters and digits as SIGNs; those that its kind keeps, or makes again, are fixed.

    Fixed are the check digit of a card, country and check digits of an IBAN, and a name's last letter
    (two in Cyrillic), which tells a gender.
    """
    n = F.size(letters)

    def name(c: Column, i: Column) -> Column:
        ending = F.when(c.rlike(r"\p{IsCyrillic}"), 2).otherwise(1)
        return F.when((i > 0) & (i >= n - ending), _fixed(c)).otherwise(F.coalesce(_placed(c, NAME_ALPHABETS, _NAMES_AT), _fixed(c)))

    def other(c: Column, i: Column) -> Column:
        kept = ((kind == "card") & (i == n - 1)) | ((kind == "iban") & (i < 4))
        hexadecimal = (kind == "secret") & c.rlike("[a-f]")
        return (
            F.when(kept, _fixed(c))
            .when(hexadecimal, _placed(c, (HEXADECIMAL,), _HEX_AT))
            .otherwise(F.coalesce(_placed(c, ALPHABETS, 0), _other(c)))
        )

    octets = F.transform(F.split(entity, r"\."), _octet)
    return F.when(kind == "ip", octets).when(kind == "name", F.transform(letters, name)).otherwise(F.transform(letters, other))


def permuted(signs: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The signs moved by the keyed permutation of their shape that `attempt` numbers."""

    def turn(now: Column, r: Column) -> Column:
        half = F.floor(F.size(now) / 2)

        def mine(i: Column) -> Column:
            return F.when(r % 2 == 1, i < half).otherwise(i >= half)

        rest = F.array_join(F.transform(now, lambda s, i: F.when(mine(i), F.lit(-1)).otherwise(s["at"]).cast("string")), ",")
        tweak = F.concat_ws("|", F.lit(key), r.cast("string"), kind, attempt.cast("string"), rest)
        return _bound(
            F.sha2(tweak.cast("binary"), 256),
            lambda digest: F.transform(
                now,
                lambda s, i: F.struct(
                    s["c"].alias("c"), s["of"].alias("of"),
                    F.when(mine(i), F.pmod(s["at"] + F.pmod(F.xxhash64(digest, i), s["wide"]).cast("int"), s["wide"])).otherwise(s["at"]).alias("at"),
                    s["wide"].alias("wide"),
                ),
            ),
        )

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), signs, turn)


def spelt(signs: Column) -> Column:
    """The letters and digits that signs stand for, as one string."""
    tables = {k: a for k, a in enumerate(ALPHABETS)} | {_NAMES_AT + k: a for k, a in enumerate(NAME_ALPHABETS)} | {_HEX_AT: HEXADECIMAL, _HASHED: ALPHABETS[1]}

    def letter(s: Column) -> Column:
        out = s["c"]
        for k, letters in tables.items():
            out = F.when(s["of"] == k, F.substring(F.lit(letters), s["at"] + 1, F.lit(1))).otherwise(out)
        for k, (first, _) in enumerate(RANGES):
            out = F.when(s["of"] == _RANGES_AT + k, F.decode(F.unhex(F.hex(s["at"] + first)), "UTF-16BE")).otherwise(out)
        for k, base in enumerate((0, 100, 0, 10)):
            out = F.when(s["of"] == _OCTETS_AT + k, F.lpad((s["at"] + base).cast("string"), F.length(s["c"]), F.lit("0"))).otherwise(out)
        return out

    return F.array_join(F.transform(signs, letter), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, modulo 10."""
    values = F.reverse(F.transform(F.split(digits, ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))))
    twice = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    return F.aggregate(twice, F.lit(0), lambda a, v: a + v) % 10


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters (a is 10), read as one number."""

    def step(sum_: Column, c: Column) -> Column:
        letter = F.instr(F.lit(ALPHABETS[1]), c)
        return F.when(letter > 0, (sum_ * 100 + letter + 9) % 97).otherwise((sum_ * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def checked(kind: Column, entity: Column, made: Column) -> Column:
    """A spelt surrogate with the check digits that its kind makes."""
    front = F.substring(made, F.lit(1), F.length(made) - 1)
    last = F.pmod(_luhn(entity) - _luhn(F.concat(front, F.lit("0"))), F.lit(10)).cast("string")
    country, rest = F.substring(made, 1, 2), F.substring(made, F.lit(5), F.length(made))
    whole = F.concat(F.substring(entity, F.lit(5), F.length(entity)), F.substring(entity, 1, 4))
    two = F.pmod(_mod97(whole) - _mod97(F.concat(rest, country, F.lit("00"))), F.lit(97)).cast("string")
    return F.when(kind == "card", F.concat(front, last)).when(kind == "iban", F.concat(country, F.lpad(two, 2, "0"), rest)).otherwise(made)


def with_surrogates(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Column `column`, an array of (kind, key, attempt), with signs and made beside them.

    made is the letters and digits that take the place of an entity's, in order, in lower case.  Each
    step is a projection of its own: nested in one another they would be too deep to resolve.
    """

    def step(name: str, value: Callable[[Column], Column], *kept: str) -> None:
        nonlocal rows
        named = ("kind", "key", "attempt", *kept)
        rows = rows.withColumn(column, F.transform(column, lambda e: F.struct(*[e[c].alias(c) for c in named], value(e).alias(name))))

    step("letters", lambda e: letters_of(e["key"]))
    step("signs", lambda e: signs_of(e["kind"], e["key"], e["letters"]))
    step("moved", lambda e: permuted(e["signs"], e["kind"], e["attempt"], key), "signs")
    step("made", lambda e: spelt(e["moved"]), "signs")
    rows = rows.withColumn(column, F.transform(column, lambda e: e.withField("made", checked(e["kind"], e["key"], e["made"]))))
    return rows


def filled(shape: Column, signs: Column) -> Column:
    """`shape` with its letters and digits replaced by `signs` in order, upper case where it had it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, c: Column) -> Column:
        sign = F.substring(signs, state["at"] + 1, F.lit(1))
        sign = F.when(c.rlike(r"\p{Lu}"), F.upper(sign)).otherwise(sign)
        ours = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(
            F.concat(state["out"], F.when(ours, sign).otherwise(c)).alias("out"),
            (state["at"] + F.when(ours, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def replacement(m: Column, made: Column) -> Column:
    """The surrogate of a described mention; `made` maps kind|key of its entities to their letters and digits."""
    signs = F.array_join(F.transform(m["parts"], lambda part: F.element_at(made, _label(part["kind"], part["key"]))), "")
    title = F.when(m["kind"] == "person", F.regexp_extract(m["mention"], _TITLE, 0)).otherwise("")
    return _bound(title, lambda t: F.concat(t, filled(F.substring(m["mention"], F.length(t) + 1, F.length(m["mention"])), signs)))


def _label(kind: Column, entity: Column) -> Column:
    return F.concat_ws("|", kind, entity)


# -- the check over the corpus ------------------------------------------------------------------------


def places(docs: DataFrame) -> DataFrame:
    """Distinct (kind, key, place) of all texts; the place is a hash of the text that holds the entity."""
    found = docs.select(F.xxhash64("text").alias("place"), F.explode(found_in(F.col("text"))["mentions"]).alias("mention"))
    return found.select("place", F.explode(described(F.col("mention"))["parts"]).alias("e")).select("e.kind", "e.key", "place").distinct()


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, key) of all texts."""
    return places(docs).select("kind", "key").distinct()


def exceptions(found: DataFrame, key: str = KEY, tries: int = TRIES) -> DataFrame:
    """(kind, key, attempt) of the entities that get another permutation than the first.

    Those whose surrogate is another entity's too (the least key keeps it), or is itself an entity of
    the corpus although its shape has more than ROOM strings: the shape alone decides, not how many
    entities share it.  A further try counts if its surrogate is nobody else's and no entity; without
    one the first surrogate stays.
    """

    def made(rows: DataFrame, attempt: int) -> DataFrame:
        one = F.array(F.struct("kind", "key", F.lit(attempt).alias("attempt")))
        spelt_ = with_surrogates(rows.select(one.alias("e")), "e", key).select(F.inline("e"))
        digits = F.aggregate("signs", F.lit(0.0), lambda sum_, s: sum_ + F.log10(s["wide"].cast("double")))
        # sums of logarithms: the margin keeps a shape of just ROOM strings out
        roomy = digits > F.log10(F.lit(ROOM)) + 1e-6
        return spelt_.select("kind", "key", roomy.alias("roomy"), filled(F.col("key"), F.col("made")).alias("made"))

    first = stored(made(found, 0), "surrogates")
    taken = first.groupBy("kind", "made").agg(F.min("key").alias("owner"), F.count("*").alias("n"))
    shared = first.join(taken.filter("n > 1"), ["kind", "made"]).filter("key != owner").select("kind", "key")
    real = first.where("roomy").join(first.select("kind", F.col("key").alias("made")), ["kind", "made"], "left_semi")
    open_ = stored(shared.union(real.select("kind", "key")).distinct(), "open")
    settled = None
    for attempt in range(1, tries + 1):
        if open_.isEmpty():
            break
        tried = stored(made(open_, attempt), "tried")
        good = tried.groupBy("kind", "made").agg(F.min("key").alias("key"))
        for others in (first.select("kind", "made"), first.select("kind", F.col("key").alias("made")), settled):
            good = good.join(others.select("kind", "made"), ["kind", "made"], "left_anti") if others is not None else good
        good = stored(good.withColumn("attempt", F.lit(attempt)).select("kind", "key", "made", "attempt"), "good")
        settled = good if settled is None else stored(settled.union(good), "settled")
        open_ = stored(open_.join(good, ["kind", "key"], "left_anti"), "open")
    return settled.select("kind", "key", "attempt") if settled is not None else found.select("kind", "key", F.lit(0).alias("attempt")).limit(0)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of `docs` with personal data of `text` replaced, and pii_count, pii_kinds beside them.

    Texts without entities come back as they are; null stays null with count 0.  Whole texts are
    read, whatever their length.  Rows with null or repeated doc_ids are treated like others: a
    surrogate hangs on the entity alone.  Columns named pii_* must not be there before.
    """
    if clash := [c for c in docs.columns if c.startswith("pii_")]:
        raise ValueError(f"columns {clash} are in the way")
    where = stored(places(docs), "places")
    settled = stored(exceptions(where.select("kind", "key").distinct(), key), "exceptions")
    rows = docs.withColumn("pii_found", found_in(F.col("text")))
    rows = rows.withColumn("pii_mentions", F.transform("pii_found.mentions", described))
    if settled.isEmpty():
        rows = rows.withColumn("pii_attempts", F.create_map().cast("map<string,int>"))
    else:  # few texts hold an exception: their table is small and broadcast by its size
        pairs = F.collect_list(F.struct(_label(F.col("kind"), F.col("key")), "attempt"))
        few = where.join(settled, ["kind", "key"]).groupBy(F.col("place").alias("pii_place")).agg(F.map_from_entries(pairs).alias("pii_attempts"))
        rows = rows.join(stored(few, "attempts"), F.xxhash64("text") == F.col("pii_place"), "left").drop("pii_place")
        rows = rows.withColumn("pii_attempts", F.coalesce("pii_attempts", F.create_map().cast("map<string,int>")))
    parts = F.array_distinct(F.flatten("pii_mentions.parts"))
    attempt = lambda e: F.coalesce(F.element_at(F.col("pii_attempts"), _label(e["kind"], e["key"])), F.lit(0))
    rows = rows.withColumn("pii_parts", F.transform(parts, lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key"), attempt(e).alias("attempt"))))
    rows = with_surrogates(rows, "pii_parts", key)
    rows = rows.withColumn("pii_made", F.map_from_arrays(F.transform("pii_parts", lambda e: _label(e["kind"], e["key"])), "pii_parts.made"))
    new = F.transform("pii_mentions", lambda m: replacement(m, F.col("pii_made")))
    woven = F.array_join(F.flatten(F.zip_with("pii_found.gaps", new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    count = F.coalesce(F.size("pii_mentions"), F.lit(0))
    text = F.when(count > 0, woven).otherwise(F.col("text"))
    kinds = F.coalesce(F.array_sort(F.array_distinct(F.col("pii_mentions.kind"))), F.array().cast("array<string>"))
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return rows.select(*kept, count.alias("pii_count"), kinds.alias("pii_kinds"))


def without_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The columns of `docs` with text replaced; n_chars, where there, counts the new text's."""
    clean = replaced(docs, key)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(docs.columns)
