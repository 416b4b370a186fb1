r"""Surrogates for personal data, in DataFrame functions only.

Detected: e-mail addresses, phone numbers, IPv4 addresses, card numbers, social security numbers, IBANs, secrets
after a key word and long hexadecimal keys, and persons after a title (initials, particles, several names, scripts
without case) with the further occurrences of their names in the same text.  Each mention is made of units (a name token,
or the whole mention); a unit's surrogate comes from a keyed SHA-256 of its type and canonical form, so that the same
person, address or number gets the same surrogate in every text and spelling (coreference), and is written in the
mention's own format: digits stay digits, letters keep their case and script, separators, country codes, card issuer
digits and check-digit validity (cards, IBANs) remain, octets are octets, given names keep their gender: that of the
titles they stand with anywhere in the table, also where a title tells none.

Collision check: the surrogates of all distinct units are counted; where two units would share one, or where one
would be left as it is or equal an original, all but the first take another attempt, until none is left.  Where
originals fill a format (short numbers), surrogates grow by digits after ``MAX_ROUNDS`` attempts.  Only texts with
mentions are joined with their surrogates.

Defined results: null text stays null, empty text empty; texts without a detected entity stay as they are; repeated
rows give repeated results; the key is a parameter.  Other columns are kept as they are by ``replaced``; the count of
mentions takes underscores until its name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import dropped, read, stored

KEY = "surrogate-key-1"
MAX_ROUNDS, LAST_ROUND = 12, 40

# Titles by gender, and syllables that surrogate names are made of, by script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа")
OTHER_TITLES = ("Dr", "Prof")
GIVEN_MALE = "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noel Oscar Paul".split()
GIVEN_FEMALE = "Anna Berta Clara Diana Emma Flora Gina Helen Irene Julia Karin Laura Maria Nora Olga Paula".split()
GIVEN_MALE_CYRILLIC = "Адам Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Никита Олег Павел Роман Семён Тимур".split()
GIVEN_FEMALE_CYRILLIC = "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса Софья".split()
SYLLABLES = "bar den fol gar hal jen kor lan mer nol pas quin ros sel tor vin".split()
SYLLABLES_CYRILLIC = "бар ден фол гар хал жен кор лан мер нол пас рин рос сел тор вин".split()

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
PARTICLES = "al bin da de del della den der di dos du el ibn la le ten ter van von y".split()
# Letters, and signs between them: possessive, so that a word of any length takes no stack; 60 signs at most in one piece.
_LETTERS, _JOINT = r"[\p{L}\p{M}]++", r"['’-](?!s(?!\p{L}))(?=\p{L})"
_RUN = rf"(?:{_JOINT})?{_LETTERS}(?:{_JOINT}{_LETTERS}){{0,60}}+"
_NAME = rf"(?:\p{{Lu}}{_RUN}|\p{{IsHan}}{{2,4}}|[\p{{Lo}}&&[^\p{{IsHan}}]][\p{{Lo}}\p{{M}}]+)"
_INITIAL = r"(?:(?:\p{Lu}\.)+|\p{Lu})"
_BEFORE = rf"(?:(?:{_INITIAL}|{'|'.join(PARTICLES)}) ){{0,4}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "SECRET": r"""(?<=["'=:\s])(?<=[=:]\s{0,3}["']?)(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9+/_-]{8,}"""
    r"|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "IBAN": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IP": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "CARD": r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){3}(?![\d]|[.-]\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "PHONE": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "PERSON": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_BEFORE}{_NAME}(?: {_BEFORE}{_NAME}){{0,4}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(mention: Column) -> Column:
    """The first type whose pattern fits the whole mention; a secret's context is outside the mention."""
    m = lambda p: mention.rlike(rf"^(?:{p})$")
    return (
        F.when(mention.contains("@"), "EMAIL")
        .when(mention.rlike(rf"^(?:{_TITLES})\.? "), "PERSON")
        .when(m(_OCTET + rf"(?:\.{_OCTET}){{3}}"), "IP")
        .when(m(r"\d{4}(?:[ -]?\d{4}){3}"), "CARD")
        .when(m(r"\d{3}-\d{2}-\d{4}"), "SSN")
        .when(mention.startswith("+") | m(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}"), "PHONE")
        .when(m(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}"), "IBAN")
        .otherwise("SECRET")
    )


def units_of(mention: Column) -> Column:
    """array<struct<kind, canon, shape>> of one mention: name tokens of a person, otherwise the mention itself."""
    kind = kind_of(mention)
    title = F.regexp_extract(mention, rf"^({_TITLES})(?=[. ])", 1)
    given = F.when(title.isin(*MALE_TITLES), "GIVEN_M").when(title.isin(*FEMALE_TITLES), "GIVEN_F").otherwise("GIVEN_X")
    tokens = F.split(mention, " ")
    person = F.transform(
        F.slice(tokens, 2, F.size(tokens) - 1),
        lambda t, i: F.struct(
            F.when(t.rlike(f"^{_INITIAL}$"), F.lit("INITIAL")).when(t.isin(*PARTICLES), "PARTICLE").when(i == F.size(tokens) - 2, "SURNAME").otherwise(given).alias("kind"),
            F.when(t.rlike(f"^{_INITIAL}$"), t).otherwise(F.lower(t)).alias("canon"),
            t.alias("shape"),
        ),
    )
    canon = (
        F.when(kind == "EMAIL", F.lower(mention))
        .when(kind.isin("PHONE", "CARD", "SSN"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "IBAN", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    return F.when(kind == "PERSON", person).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), mention.alias("shape"))))


def _nibble(code: Column, i: int) -> Column:
    return F.conv(F.substring(code, i, 1), 16, 10).cast("int")


def _picked(names: list[str], code: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), _nibble(code, at) + 1)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string with the rightmost digit not doubled; 1 (not valid) for anything else."""
    each = F.transform(
        F.reverse(F.split(digits, "")), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(1)) * (i % 2 + 1)
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))


def _mod97(digits: Column) -> Column:
    """Remainder by 97 of an IBAN in upper case with its first four characters at the end."""
    each = F.transform(F.split(F.concat(F.substr(digits, F.lit(5)), F.substring(digits, 1, 4)), ""), lambda c: F.ascii(c))
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def with_surrogates(units: DataFrame, key: str) -> DataFrame:
    """``units`` (kind, canon, shape, attempt) with ``made``: the surrogate of each in the format of its shape.

    Steps are columns of their own, so that no expression holds another many times over.
    """
    kind, canon, shape, attempt = F.col("kind"), F.col("canon"), F.col("shape"), F.col("attempt")
    t = units.withColumn("_code", F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256))
    code = F.col("_code")
    more = [F.sha2(F.concat(code, F.lit(str(i))), 256) for i in range(3)]
    t = t.withColumn("_stream", F.concat(code, *more))
    t = t.withColumn("_digits", F.translate("_stream", "abcdef", "274913")).withColumn("_letters", F.translate("_stream", "0123456789", "ghjkmnprst"))
    domain = F.substring_index(canon, "@", -1)
    t = t.withColumn("_zone", F.when(kind == "EMAIL", F.regexp_extract(domain, r"(\.(?:example\.)?[a-z]+)$", 1)).otherwise(""))
    t = t.withColumn("_base", F.when(kind == "EMAIL", F.substr(canon, F.lit(1), F.length(canon) - F.length("_zone"))).when(kind == "SECRET", shape).otherwise(canon))
    country = F.length(F.regexp_extract(shape, r"^\+(\d{1,3}?)(?=[ .(-])", 1))
    t = t.withColumn("_keep", F.when(kind == "PHONE", country).when(kind == "CARD", 1).when(kind == "IBAN", 2).otherwise(0))
    t = t.withColumn("_hex", shape.rlike("^[0-9a-f]+$") & shape.rlike("[a-f]"))

    def drawn(c: Column, i: Column) -> Column:
        at = i % 256 + 1
        letter = F.substr(F.col("_letters"), at, F.lit(1))
        return (
            F.when(i < F.col("_keep"), c)
            .when(F.col("_hex"), F.substr(F.col("_stream"), at, F.lit(1)))
            .when(c.rlike("[0-9]"), F.substr(F.col("_digits"), at, F.lit(1)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.translate(letter, "abcdefghjkmnprst", "абвгдежзиклмнопр"))
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    t = t.withColumn("_drawn", F.array_join(F.transform(F.split("_base", ""), drawn), ""))
    # A valid card number stays valid: its last digit is the check digit of the others.
    short = F.substr(F.col("_drawn"), F.lit(1), F.length("_drawn") - 1)
    t = t.withColumn("_open", F.concat(short, F.lit("0"))).withColumn("_check", ((10 - _luhn_sum(F.col("_open")) % 10) % 10).cast("string"))
    t = t.withColumn("_valid", (kind == "CARD") & (_luhn_sum(canon) % 10 == 0))
    # So does a valid IBAN: its two check digits follow from the country and the account.
    account = F.substr(F.col("_drawn"), F.lit(5))
    t = t.withColumn("_unchecked", F.concat(F.substring("_drawn", 1, 2), F.lit("00"), account))
    t = t.withColumn("_iban", (kind == "IBAN") & (_mod97(canon) == 1))
    iban = F.concat(F.substring("_drawn", 1, 2), F.lpad((98 - _mod97(F.col("_unchecked"))).cast("string"), 2, "0"), account)
    t = t.withColumn("_flow", F.when(F.col("_valid"), F.concat(short, F.col("_check"))).when(F.col("_iban"), iban).otherwise(F.col("_drawn")))
    seen = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    poured = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(F.col("_flow"), seen(i), F.lit(1))).otherwise(c))
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    t = t.withColumn("_female", (kind == "GIVEN_F") | ((kind == "GIVEN_X") & (_nibble(code, 9) % 2 == 0)))
    latin_name = F.when(F.col("_female"), _picked(GIVEN_FEMALE, code, 1)).otherwise(_picked(GIVEN_MALE, code, 1))
    other_name = F.when(F.col("_female"), _picked(GIVEN_FEMALE_CYRILLIC, code, 1)).otherwise(_picked(GIVEN_MALE_CYRILLIC, code, 1))
    syllables = F.when(cyrillic, F.array(*[_picked(SYLLABLES_CYRILLIC, code, i) for i in range(2, 12)])).otherwise(
        F.array(*[_picked(SYLLABLES, code, i) for i in range(2, 12)])
    )
    # Given names come from short lists: a syllable for each further attempt keeps them distinct.
    t = t.withColumn("_given", F.when(cyrillic, other_name).otherwise(latin_name)).withColumn("_syllables", syllables)
    n = F.when(kind == "SURNAME", attempt + 3).otherwise(attempt)
    t = t.withColumn("_tail", F.array_join(F.slice("_syllables", F.lit(1), F.least(n, F.lit(10))), ""))
    name = F.when(kind == "SURNAME", F.initcap("_tail")).otherwise(F.concat("_given", "_tail"))
    t = t.withColumn("_name", name)
    octets = F.concat_ws(".", *[F.conv(F.substring(code, 1 + 2 * i, 2), 16, 10) for i in range(4)])
    made = (
        F.when(kind == "EMAIL", F.concat("_drawn", "_zone"))
        .when(kind == "IP", octets)
        .when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), F.array_join(poured, ""))
        .when(kind == "SECRET", F.col("_drawn"))
        .when(kind == "PARTICLE", shape)
        .when(kind == "INITIAL", F.when(F.col("_drawn") == shape, F.regexp_replace(shape, r"\p{Lu}", "Z")).otherwise(F.col("_drawn")))
        .when((shape == F.upper(shape)) & (shape != F.lower(shape)), F.upper("_name"))
        .otherwise(F.col("_name"))
    )
    longer = kind.isin("PHONE", "CARD", "SSN", "IBAN", "SECRET") & (attempt > MAX_ROUNDS)
    more = F.substr(F.col("_digits"), F.lit(200), attempt - MAX_ROUNDS)
    made = F.when(longer, F.concat(made, more)).when((kind == "EMAIL") & (attempt > MAX_ROUNDS), F.replace(made, F.lit("@"), F.concat(more, F.lit("@")))).otherwise(made)
    return t.select(*units.columns, made.alias("made"))


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def attempts_of(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of all distinct units, after as many rounds of collision checks as they need."""
    # Surrogates are compared within a type; given names are of one type whatever their gender.
    family = F.when(F.col("kind").startswith("GIVEN"), F.lit("GIVEN")).otherwise(F.col("kind"))
    plain = F.when(F.col("kind").isin("PHONE", "CARD", "SSN"), F.regexp_replace("made", r"\D", "")).otherwise(F.lower("made"))
    few = F.col("kind").isin("INITIAL", "PARTICLE")  # letters are too few to stay distinct, particles stay as they are
    others = units.where(few).select("kind", "canon", F.lit(0).alias("attempt")).distinct()
    current = stored(units.where(~few).groupBy("kind", "canon").agg(F.min("shape").alias("shape"), F.lit(0).alias("attempt")), "pii-units")
    first = current
    original = current.select(family.alias("family"), F.lower("canon").alias("form"), F.lit(True).alias("is_original")).distinct()
    for _ in range(LAST_ROUND):
        made = with_surrogates(current, key).select("kind", "canon", "shape", "attempt", family.alias("family"), plain.alias("form"))
        rank = F.row_number().over(Window.partitionBy("family", "form").orderBy("attempt", "canon", "kind"))
        ranked = made.withColumn("rank", rank).join(original, ["family", "form"], "left")
        wrong = (F.col("rank") > 1) | F.coalesce(F.col("is_original"), F.lit(False))
        checked = ranked.select("kind", "canon", "shape", (F.col("attempt") + wrong.cast("int")).alias("attempt"), wrong.alias("again"))
        last, current = current, stored(checked, "pii-attempts")
        if last is not first:  # the originals are read in every round
            dropped(last)
        if current.where("again").isEmpty():
            return current.select("kind", "canon", "attempt").unionByName(others)
    raise ValueError("surrogates still collide: the key or the name lists are too weak for these entities")


def with_gender(units: DataFrame) -> DataFrame:
    """Given names after a title without gender take the gender that the name has elsewhere."""
    known = units.where(F.col("kind").isin("GIVEN_M", "GIVEN_F")).groupBy("canon").agg(F.max("kind").alias("__known"))
    neutral = F.col("kind") == "GIVEN_X"
    own = units.columns
    found = units.where(neutral).join(known, "canon", "left").withColumn("kind", F.coalesce("__known", "kind")).select(*own)
    return units.where(~neutral).unionByName(found)


def names_of(units: DataFrame) -> DataFrame:
    """(key, names): for each text a map from the name tokens found in it, in lower case, to their surrogates."""
    tokens = units.where(F.col("kind").startswith("GIVEN") | (F.col("kind") == "SURNAME"))
    # A token found as a surname and as a given name is taken as the surname.
    one = tokens.groupBy("key", "canon").agg(F.initcap(F.max(F.struct("kind", "made"))["made"]).alias("made"))
    return one.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canon", "made")))).alias("names"))


def without_names(piece: Column, names: Column) -> Column:
    """``piece`` with the further occurrences of ``names``: whole capitalised words, and any place in scripts without case."""

    def word(w: Column) -> Column:
        made = F.element_at(names, F.lower(w))
        made = F.when(F.length(w) > 1, F.when(w == F.upper(w), F.upper(made)).otherwise(made))
        return F.when(w.rlike(r"^\p{Lu}"), F.coalesce(made, w)).otherwise(w)

    words = F.regexp_extract_all(piece, F.lit(rf"{_RUN}|[^\p{{L}}\p{{M}}'’-]++|[\s\S]"), F.lit(0))
    whole = lambda w: F.map_contains_key(names, F.lower(w))
    text = F.array_join(F.transform(words, lambda w: F.when(whole(w), word(w)).otherwise(F.array_join(F.transform(F.split(w, "-"), word), "-"))), "")
    caseless = F.filter(F.map_keys(names), lambda n: n.rlike(r"^\p{Lo}"))
    longest_first = F.array_sort(caseless, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest_first, text, lambda t, n: F.replace(t, n, F.element_at(names, n)))


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of mentions that the patterns find as ``n_entities``."""
    own, count = docs.columns, "n_entities"
    while count in own:
        count += "_"
    # The patterns are searched once; everything else is on the few texts with mentions.  All columns of a row are one, so that
    # none can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    marked = stored(docs.select(row, F.col("text"), mentions_of(F.coalesce(F.col("text"), F.lit(""))).alias("found")), "pii-found")
    marked = marked.withColumn("n_found", F.size("found"))
    clean, private = marked.where("n_found = 0"), marked.where("n_found > 0")
    text_key = F.sha2("text", 256)
    mentions = private.select(text_key.alias("key"), F.posexplode("found").alias("pos", "mention"))
    units = mentions.select("key", "pos", "mention", F.posexplode(units_of(F.col("mention"))).alias("part", "u"))
    units = stored(with_gender(stored(units.select("key", "pos", "part", "mention", "u.*"), "pii-parts")), "pii-mentions")
    forms = units.select("kind", "canon", "shape").distinct().join(attempts_of(units, key), ["kind", "canon"])
    made = stored(with_surrogates(forms, key).select("kind", "canon", "shape", "made"), "pii-surrogates")
    title = F.regexp_extract("mention", rf"^((?:{_TITLES})\.? )", 1)
    part = F.struct("pos", "part", F.concat(F.when(F.col("part") == 0, title).otherwise(" "), "made").alias("made"))
    # A text's mentions meet in one row; copies of a text share it.
    joined = units.distinct().join(made, ["kind", "canon", "shape"])
    found = joined.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    found = found.join(names_of(joined), "key", "left")
    rows = private.withColumn("key", text_key).join(found, "key")
    in_place = F.transform(
        F.sequence(F.lit(0), F.col("n_found") - 1),
        lambda i: F.array_join(F.transform(F.filter("parts", lambda p: p["pos"] == i), lambda p: p["made"]), ""),
    )
    rows = rows.withColumn("made", in_place).withColumn("between", F.split("text", PATTERN, -1))
    rows = rows.withColumn("between", F.when(F.col("names").isNull(), F.col("between")).otherwise(F.transform("between", lambda x: without_names(x, F.col("names")))))
    text = F.array_join(F.zip_with("between", "made", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = rows.select(F.col("row").withField("text", text).alias("row"), "n_found")
    return clean.select("row", "n_found").unionByName(out).select("row.*", F.col("n_found").alias(count))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(read(spark, sf_dir, "documents").select("doc_id", "text"))
