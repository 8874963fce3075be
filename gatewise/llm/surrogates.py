"""PII surrogates: keyed, type-consistent replacements, by DataFrame functions only.

Found entities: e-mail addresses, IPv4 addresses, card numbers, IBANs, social
security numbers, Turkish national ids (11 digits, by their check digits),
phone numbers, and personal names: behind a title, and any capitalised mention
of such a name's words in the same text.  Not found: names that no title
introduces in their text, and bare digits other than Turkish mobile numbers
as phone numbers (they look like any other number).  Each
distinct entity (each word of a name) gets one surrogate in the whole table,
drawn from a keyed digest of its type and normal form:

* the same entity always gets the same surrogate (coreference), also the same
  mail domain, the same surname and the same first name;
* the format stays: digits for digits, letters for letters in their case,
  separators in place, card numbers with a valid check digit, IBANs with their
  country and valid check digits, addresses in ranges that nobody owns;
* names keep gender (of the title) and script (Latin, Cyrillic, Greek); behind a
  neutral title a first name is that of the gendered titles, if those agree.

*Collision check*: a surrogate must differ from every other surrogate and from
every real entity of its type.  Rejected ones are drawn again with the next
attempt number until none is left, so distinct entities stay distinct.

Replacement: texts are split at their entities, the entities' surrogates are
joined on, and text and surrogates are zipped.  Only texts that may hold an
entity (a cheap guard) are searched or shuffled.

Tables that are read again are written under ``spark.checkpoint.dir``: plans on
cached tables repeat the cached plans inside one another, and the driver keeps
and logs each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.functions.pii import tc_kimlik_valid
from gatewise.llm.batches import bound_batches
from gatewise.operators.common import materialize

# Titles by the gender they state (_N: none).
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "κυρία")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος")
TITLES_N = ("Dr", "Prof", "Professor", "Doctor")

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\w.])\d{4}[ -]?(?:\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{6}[ -]?\d{4,5})(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
GROUPED = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{2,4}|\d{2,4}(?<=\+\d{1,3}[ .-]?\d{2,4})[ .-]\d{2,4}|\d{3}[.-]\d{3})(?:[ .-]?\d{2,4}){1,3}(?!\w)"
MOBILE = r"(?:90[ .-]?|0)?5\d{2}[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}"
COMPACT = r"(?<![\w+.])(?:\+\d{1,3}[ .-]?\d{6,12}|" + MOBILE + r"|(?:1 )?[2-9]\d{2} [2-9]\d{2} \d{4})(?!\w|\.\d)"
PHONE = f"{GROUPED}|{COMPACT}"
NATIONAL = r"(?<![\w+.])[1-9]\d{10}(?!\w|\.\d)"
TITLES = r"(?:(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")\.? )+"
NAME_WORD = r"\p{Lu}[\p{L}'’]*\p{L}(?<!['’][sS])"
NAME = rf"(?<![\p{{L}}\p{{N}}_]){TITLES}{NAME_WORD}(?: {NAME_WORD}){{0,2}}"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, IP, IBAN, CARD, SSN, PHONE, NATIONAL, NAME))

# Syllables of surrogate names, by script.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"),
    "greek": ("βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "ζι", "θο"),
}
# Endings of (feminine, masculine first name, surname, first name of unknown gender), by script.
ENDINGS = {"latin": ("lia", "ric", "man", "ren"), "cyrillic": ("лия", "рик", "ман", "рен"), "greek": ("λια", "ρικος", "μανης", "ρεν")}
FIRST_NAMES = ("first_f", "first_m", "first_n")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def may_hold(text: Column) -> Column:
    """Cheap guard: a text without a digit, an @ or a title holds no entity."""
    guard = text.contains("@") | text.rlike("[0-9]")
    for title in TITLES_F + TITLES_M + TITLES_N:
        guard = guard | text.contains(title)
    return F.coalesce(guard, F.lit(False))


def kind_of(entity: Column) -> Column:
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\p{L}+\.? \p{Lu}|^\p{L}-\p{L}+ "), "name")
        .when(whole(IP), "ip")
        .when(entity.rlike(r"^[A-Z]{2}"), "iban")
        .when(whole(SSN), "ssn")
        .when(whole(CARD), "card")
        .when(whole(NATIONAL) & ~whole(PHONE), F.when(tc_kimlik_valid(entity), "national"))  # null: some other number
        .otherwise("phone")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _name_parts(entity: Column) -> Column:
    """(type, form) of a name's words: first names carry the title's gender, the last word is the surname."""
    words = F.split(F.regexp_replace(entity, f"^{TITLES}", ""), " ")
    titles = F.transform(F.split(F.regexp_extract(entity, f"^{TITLES}", 0), " "), lambda t: F.regexp_replace(t, r"\.$", ""))
    has = lambda those: F.arrays_overlap(titles, F.array(*map(F.lit, those)))
    first = F.when(has(TITLES_F), "first_f").when(has(TITLES_M), "first_m").otherwise("first_n")
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise(first).alias("type"), F.lower(w).alias("form")))


def parts_of(entity: Column) -> Column:
    """The replaceable parts of an entity: its type and normal form (formatting removed); null for none."""
    return _let(kind_of(entity), lambda kind: _parts(kind, entity))


def _parts(kind: Column, entity: Column) -> Column:
    one = lambda t, f: F.array(F.struct(t.alias("type"), f.alias("form")))
    mail = F.array(
        F.struct(F.lit("mailbox").alias("type"), F.lower(entity).alias("form")),
        F.struct(F.lit("domain").alias("type"), F.lower(F.regexp_extract(entity, "@(.*)$", 1)).alias("form")),
    )
    plain = F.when(kind == "ip", entity).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(_digits(entity))
    plain = F.when((kind == "phone") & entity.startswith("+"), F.concat(F.lit("+"), plain)).otherwise(plain)
    return F.when(kind == "email", mail).when(kind == "name", _name_parts(entity)).when(kind.isNotNull(), one(kind, plain))


# ---- surrogates of normal forms ---------------------------------------------------


def _bytes(secret: Column) -> Column:
    """64 keyed pseudo-random numbers 0..255."""
    hexes = F.concat(F.sha2(F.concat(secret, F.lit("|a")), 256), F.sha2(F.concat(secret, F.lit("|b")), 256))
    return _let(hexes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _like(form: Column, noise: Column, keep: int | Column = 0) -> Column:
    """The form with digits for digits and letters for letters; the first ``keep`` characters stay."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    letters, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")

    def one(c: Column, i: Column) -> Column:
        r = F.element_at(noise, F.pmod(i, F.lit(64)) + 1)
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), F.substring(digits, F.pmod(r, F.lit(10)) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(letters, F.pmod(r, F.lit(26)) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.upper(F.substring(letters, F.pmod(r, F.lit(26)) + 1, F.lit(1))))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _luhn(number: Column) -> Column:
    """``number`` with its last digit set so that the whole passes the Luhn check."""
    n = F.length(number)
    body = F.split(F.substring(number, F.lit(1), n - 1), "")

    def weigh(total: Column, x: Column) -> Column:
        d = x["d"] * F.when(x["twice"], 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    placed = F.transform(body, lambda c, i: F.struct(c.cast("int").alias("d"), (F.pmod(n - i, F.lit(2)) == 0).alias("twice")))
    total = F.aggregate(placed, F.lit(0), weigh)
    return F.concat(F.substring(number, F.lit(1), n - 1), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _iban(form: Column) -> Column:
    """``form`` with valid check digits (ISO 7064 mod 97-10)."""
    moved = F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, 1, 2), F.lit("00"))

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(r * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(r * 100 + letter, F.lit(97)))

    rest = F.aggregate(F.split(moved, ""), F.lit(0), step)
    return F.concat(F.substring(form, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(form, F.lit(5), F.length(form)))


def _national(form: Column) -> Column:
    """``form`` with the two check digits of its first nine digits."""
    d = lambda i: F.substring(form, i, 1).try_cast("int")
    odd, even = d(1) + d(3) + d(5) + d(7) + d(9), d(2) + d(4) + d(6) + d(8)
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return F.concat(F.substring(form, 1, 9), tenth.cast("string"), F.pmod(odd + even + tenth, F.lit(10)).cast("string"))


def _octet(noise: Column, i: int) -> Column:
    return F.element_at(noise, i).cast("string")


def _picked(table: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.element_at(table, i))


def _word(form: Column, noise: Column, ending: int, attempt: Column) -> Column:
    """A made-up name in the form's script; later attempts are longer."""
    built = None
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", None)):
        table = F.array(*(F.lit(s) for s in SYLLABLES[script]))
        count = F.least(3 + attempt, F.lit(40))
        picked = F.transform(F.slice(noise, F.lit(1), count), lambda r: F.pmod(r, F.lit(16)) + 1)
        name = F.concat(F.array_join(_picked(table, picked), ""), F.lit(ENDINGS[script][ending]))
        built = F.when(form.rlike(test), name) if built is None else built.when(form.rlike(test), name) if test else built.otherwise(name)
    return built


def surrogate_of(kind: Column, form: Column, key: Column, attempt: Column) -> Column:
    """The attempt-th candidate for a normal form."""
    secret = F.concat_ws("|", key, kind, form, attempt.cast("string"))
    return _let(_bytes(secret), lambda noise: _drawn(kind, form, noise, attempt))


def _drawn(kind: Column, form: Column, noise: Column, attempt: Column) -> Column:
    tail = F.concat(F.lit(""), *(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.element_at(noise, 40 + i), F.lit(26)) + 1, F.lit(1)) for i in range(4)))
    longer = lambda c: F.when(attempt > 3, F.concat(c, tail)).otherwise(c)  # noqa: E731  short forms have few surrogates
    box = F.regexp_extract(form, "^(.*)@", 1)
    labels = F.regexp_extract(form, r"^(.*)\.[^.]*$", 1)
    return (
        F.when(kind == "mailbox", longer(_like(box, noise)))
        .when(kind == "domain", F.concat(longer(_like(labels, noise)), F.lit(".example")))
        .when(kind == "ip", F.concat_ws(".", (240 + F.pmod(F.element_at(noise, 1), F.lit(15))).cast("string"), _octet(noise, 2), _octet(noise, 3), _octet(noise, 4)))
        .when(kind == "iban", _iban(_like(form, noise, 2)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_like(form, noise), 2, 8)))
        .when(kind == "card", _luhn(_like(form, noise, 1)))
        .when(kind == "national", _let(_like(form, noise, 1), _national))
        .when(kind == "first_n", _word(form, noise, 3, attempt))
        .when(kind == "first_f", _word(form, noise, 0, attempt))
        .when(kind == "first_m", _word(form, noise, 1, attempt))
        .when(kind == "surname", _word(form, noise, 2, attempt))
        .otherwise(_like(form, noise, F.when(form.startswith("+"), 2).otherwise(0)))
    )


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """(type, form, surrogate) of the distinct (type, form) rows, without collisions.

    A mailbox is checked within its type together with its domain's form, so
    two addresses can never meet.  The smallest form wins a contested
    surrogate; the others, and surrogates equal to a real form, try again.
    """
    real = materialize(parts.distinct(), "forms")
    taken_forms = real.select("type", F.when(F.col("type") == "mailbox", F.regexp_extract("form", "^(.*)@", 1)).otherwise(F.lower("form")).alias("surrogate")).distinct()
    todo, done, attempt = real, None, 0
    while True:
        drawn = materialize(todo.select("type", "form", F.lower(surrogate_of(F.col("type"), F.col("form"), F.lit(key), F.lit(attempt))).alias("surrogate")), "drawn")
        free = drawn.join(taken_forms, ["type", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = materialize(free.groupBy("type", "surrogate").agg(F.min("form").alias("form")).select("type", "form", "surrogate"), "won")
        done = won if done is None else done.unionAll(won)
        lost = materialize(drawn.select("type", "form").join(won.select("type", "form"), ["type", "form"], "left_anti"), "redrawn")
        attempt += 1
        if lost.isEmpty():
            return done
        todo = lost


def _spaced(original: Column, new: Column, pattern: str) -> Column:
    """``new`` written with the separators of ``original`` (characters matching ``pattern`` are slots)."""
    slots = F.split(original, "")
    used = F.transform(slots, lambda c, i: F.size(F.filter(F.slice(slots, F.lit(1), i + 1), lambda x: x.rlike(pattern))))
    return F.array_join(F.zip_with(slots, used, lambda c, n: F.when(c.rlike(pattern), F.substring(new, n, F.lit(1))).otherwise(c)), "")


def _case_like(original: Column, new: Column) -> Column:
    return F.when(original == F.upper(original), F.upper(new)).when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def written(entity: Column, surrogates: Column) -> Column:
    """An entity rewritten with the surrogates of its parts, in its own format."""
    return _let(kind_of(entity), lambda kind: _written(kind, entity, surrogates))


def _written(kind: Column, entity: Column, surrogates: Column) -> Column:
    first = F.element_at(surrogates, 1)
    words = F.split(F.regexp_replace(entity, f"^{TITLES}", ""), " ")
    name = F.concat(F.regexp_extract(entity, f"^{TITLES}", 0), F.array_join(F.zip_with(words, surrogates, _case_like), " "))
    numeric = _spaced(entity, F.when(kind == "phone", F.regexp_replace(first, r"\D", "")).otherwise(first), "[0-9]")
    return (
        F.when(kind == "email", F.concat_ws("@", first, F.element_at(surrogates, 2)))
        .when(kind == "name", name)
        .when(kind == "ip", first)
        .when(kind == "iban", _spaced(entity, F.upper(first), "[A-Z0-9]"))
        .otherwise(numeric)
    )


def _with_neutral(parts: DataFrame, key: str) -> DataFrame:
    """``surrogate_table``, with first names behind neutral titles as behind the gendered ones that all state one gender."""
    real = materialize(parts.distinct(), "parts")
    told = real.where(F.col("type").isin("first_f", "first_m")).groupBy("form").agg(F.min("type").alias("as"), F.max("type").alias("other")).where(F.col("as") == F.col("other"))
    known = materialize(real.where(F.col("type") == "first_n").join(told.select("form", "as"), "form").select("type", "form", "as"), "known")
    drawn = surrogate_table(real.join(known.select("type", "form"), ["type", "form"], "left_anti"), key)
    again = known.join(drawn.select(F.col("type").alias("as"), "form", "surrogate"), ["as", "form"]).select("type", "form", "surrogate")
    return drawn.unionByName(again)


def _pieces(piece: Column) -> Column:
    """Words (letters and apostrophes, no possessive ending) and what stands between them."""
    return F.split(piece, r"(?<![\p{L}'’])(?=\p{L})|(?<=\p{L})(?![\p{L}'’])|(?<=\p{L})(?=['’](?:[sS]?(?!\p{L})))", -1)


def _named(word: Column, names: Column) -> Column:
    """The surrogate of a capitalised word that the text's names hold, else null."""
    return F.when(word.rlike(r"^\p{Lu}"), F.element_at(names, F.lower(word)))


def surrogate_texts(docs: DataFrame, key: str = "gatewise") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities``.

    All columns and rows stay; ``n_chars``, where there is one, follows the new
    text.  Null texts stay null with 0 entities; equal texts (repeated rows)
    get equal results.  ``key`` decides the surrogates.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text")
    guarded = docs.where(may_hold(text))
    others = docs.where(~may_hold(text)).withColumn("n_entities", F.lit(0))

    holding = guarded.select(F.md5(text.cast("binary")).alias("__key"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("entities")).where(F.size("entities") > 0)
    found = materialize(holding.groupBy("__key").agg(F.first("entities").alias("entities")), "entities")
    each = found.select("__key", F.posexplode("entities").alias("at", "entity"))
    parts = each.select("__key", "at", F.posexplode(parts_of(F.col("entity"))).alias("part", "p")).select("__key", "at", "part", "p.type", "p.form")
    table = _with_neutral(parts.select("type", "form"), key)
    with_surrogates = materialize(parts.join(table, ["type", "form"]), "drawn-parts")
    told = with_surrogates.groupBy("__key", "at").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("s"))
    new = told.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("s.surrogate").alias("surrogates")))).alias("new"))
    words = with_surrogates.where(F.col("type").isin("surname", *FIRST_NAMES)).groupBy("__key", "form").agg(F.max(F.struct("type", "surrogate")).alias("s"))  # surnames first
    names = words.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("form", F.col("s.surrogate").alias("surrogate")))).alias("names"))

    # written once: the rewrite below is planned on a fresh read of it
    mapping = materialize(new.join(names, "__key", "left"), "surrogates")

    rows = guarded.withColumn("__row", F.md5(text.cast("binary"))).join(mapping, F.col("__row") == F.col("__key"), "left")
    pieces = F.split(text, ENTITY, -1)
    entities = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    given = lambda i: F.element_at(F.col("new"), i)
    rewritten = F.transform(entities, lambda e, i: F.when(given(i).isNull(), e).otherwise(written(e, given(i))))
    mention = lambda w: _let(_named(w, F.col("names")), lambda new: F.coalesce(_case_like(w, new), w))
    between = F.when(F.col("names").isNull(), pieces).otherwise(F.transform(pieces, lambda p: F.array_join(F.transform(_pieces(p), mention), "")))
    mentions = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.size(F.filter(_pieces(p), lambda w: _named(w, F.col("names")).isNotNull())))
    joined = F.array_join(F.zip_with(between, rewritten, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    changed = rows.withColumn("n_entities", F.when(F.col("new").isNull(), 0).otherwise(F.size("new") + F.when(F.col("names").isNull(), 0).otherwise(mentions)))
    changed = changed.withColumn("text", F.when(F.col("new").isNull(), text).otherwise(joined))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns, "n_entities").unionByName(others.select(*docs.columns, "n_entities"))
