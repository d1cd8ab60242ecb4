"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Mentions are found by one regular expression, which sets marks around them. A mention's identity is its type and its
normalised value, so that one person's phone number in two notations is one entity. A person is introduced by a form of
address or by a known given name; all further mentions in the document, by the full name, the family name or the given
name, with or without a title, are then found as well and belong to that person. The same full name is the same person
everywhere; the gender is what any title tells, or else the given name.

An entity's surrogate is drawn from a keyed hash of its identity and written in the shape of the mention: digits for
digits, letters for letters in their case, a check digit where the original had one, a name of the same gender and script.
Domains and numbers set aside for examples stay so. Distinctness is checked over the whole input: the surrogates of all
entities are compared with each other and with every value that occurs. The later of two entities that meet, and any that
meets an existing value, is drawn again with the next attempt number until none is left.

Texts are searched once: the rows are stored with their mentions, and the surrogates are joined to them by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.plans.storage import materialize

#: Mentions of one entity from which on it goes to its rows instead of they to it.
HOT_MENTIONS = 100_000
MAX_ATTEMPTS = 24

# Forms of address by the gender that they tell.
MALE_TITLES = "Mr Mister Sir Herr Herrn Monsieur Señor Г-н Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Г-жа Госпожа".split()
OPEN_TITLES = "Dr Prof Professor".split()

_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES, key=len, reverse=True)) + r")\.?[  ]+"
_NAME_WORD = r"\p{Lu}[\p{Ll}\p{Mn}]+(?:[-'’]\p{Lu}[\p{Ll}\p{Mn}]+)?"
# Each pattern begins with what tells soonest that it can't match: its first character, or that a word goes on.
TITLED = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME_WORD}(?: {_NAME_WORD}){{0,2}}"

# Common given names, by the gender that they tell.
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kevin Brian George "
        "Edward Peter Hans Klaus Jürgen Wolfgang Heinz Günther Stefan Andreas Matthias Pierre Jean Jacques Michel Philippe François Louis Nicolas Juan José Carlos "
        "Luis Miguel Antonio Francisco Javier Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Пётр"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Laura Emma "
        "Olivia Sophia Anna Ursula Monika Petra Sabine Renate Helga Claudia Katharina Marie Jeanne Françoise Isabelle Nathalie Sophie Camille María Carmen Josefa "
        "Isabel Dolores Lucía Ana Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина"
    ).split(),
}


def _any_of(words: list[str]) -> str:
    """An alternative of words, first by their initials."""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(f"{h}(?:" + "|".join(sorted((w[1:] for w in words if w[0] == h), key=len, reverse=True)) + ")" for h in heads) + ")"


NAME = rf"{TITLED}|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_any_of(GIVEN['m'] + GIVEN['f'])}(?: {_NAME_WORD}){{1,2}}(?![\p{{L}}\p{{N}}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}-]{0,62}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
SECRET = r"(?=[pstaPSTA])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}"
CLOUD_KEY = r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][.,-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
IP = r"(?=[0-9])(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?!\.?[0-9])"
IP6 = (
    r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:])"
)
PHONE = (
    r"(?=[+(0-9])(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?=\+)(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
)
SSN = r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: In the order in which they are tried.
PATTERNS = {"name": NAME, "email": EMAIL, "secret": SECRET, "key": CLOUD_KEY, "iban": IBAN, "ssn": SSN, "phone": PHONE, "ip": IP, "ip6": IP6, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Characters that no text uses, around mentions; one that does use them is written otherwise in between.
_BEGIN, _END, _ESCAPE = "\ue000", "\ue001", "\ue002"

# Syllables of surrogate names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se".split(),
    "cyrillic": "ба бе бо да де до фа фе га ка ке ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се".split(),
}
ENDINGS = {
    "latin": {"f": ["lina", "rita", "nia", "sara"], "m": ["lin", "rick", "ton", "bert"], "o": ["lis", "ren", "mar", "sel"]},
    "cyrillic": {"f": ["лина", "рита", "ния", "сара"], "m": ["лин", "рик", "тон", "берт"], "o": ["лис", "рен", "мар", "сель"]},
}


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _kind(mention: Column) -> Column:
    out = F.lit("name")  # a further mention of a known one
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, "^" + _TITLE, "")


def _gender(mention: Column) -> Column:
    told = lambda titles: mention.rlike("^(?:" + "|".join(titles) + r")[.\s ]")
    return F.when(told(FEMALE_TITLES), F.lit("f")).when(told(MALE_TITLES), F.lit("m")).otherwise(F.lit("o"))


def _secret_prefix(mention: Column) -> Column:
    return F.regexp_extract(mention, "^([^=:]*[=:]\\s*[\"']?)", 1)


def _identity(kind: Column, mention: Column) -> Column:
    """The value that makes an entity, whatever its notation; of a person, the name as it is mentioned."""
    return (
        F.when(kind == "name", F.lower(_bare_name(mention)))
        .when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind == "phone", F.right(_digits(mention), F.lit(10)))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.substring(mention, F.length(_secret_prefix(mention)) + 1, F.length(mention)))
        .otherwise(mention)
    )


def _pick(draw: Column, k: Column | int, n: Column | int) -> Column:
    """The ``k``-th number below ``n`` of a hex string, four digits of it each."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.lit(n) if isinstance(n, int) else n
    at = F.pmod(k * 4, F.length(draw) - 3) + 1
    return (F.conv(F.substring(draw, at, F.lit(4)), 16, 10).cast("int") + k) % n


def _reshape(text: Column, draw: Column, hexadecimal: Column, skip: int = 0, digits_only: Column | None = None) -> Column:
    """Other characters of the same classes: digits, capital and small letters of Latin or Cyrillic; the rest stays, as do
    the first ``skip`` characters and, with ``digits_only``, all letters."""
    letters_stay = F.lit(False) if digits_only is None else digits_only

    def one(c: Column, k: Column) -> Column:
        code = lambda base, n: F.substring(F.lit(base), _pick(draw, k, n) + 1, F.lit(1))
        small = "abcdefghijklmnopqrstuvwxyz"
        cyrillic = "абвгдежзиклмнопрстуфхцчшэюя"
        return (
            F.when(k < skip, c)
            .when(c.rlike("[0-9]"), _pick(draw, k, 10).cast("string"))
            .when(letters_stay, c)
            .when(hexadecimal & c.rlike("[a-f]"), code("abcdef", 6))
            .when(hexadecimal & c.rlike("[A-F]"), code("ABCDEF", 6))
            .when(c.rlike("[a-z]"), code(small, 26))
            .when(c.rlike("[A-Z]"), code(small.upper(), 26))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Ll}"), code(cyrillic, 27))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), code(cyrillic.upper(), 27))
            .when(c.rlike(r"\p{Lu}"), code(small.upper(), 26))
            .when(c.rlike(r"\p{L}"), code(small, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum; ``double_last``: of digits that a check digit will follow."""
    each = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, k: F.when(F.pmod(k, F.lit(2)) == (0 if double_last else 1), (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _fill_digits(mention: Column, digits: Column) -> Column:
    """The mention with its last digits replaced by ``digits``; signs between them and earlier digits stay."""
    first = F.length(_digits(mention)) - F.length(digits)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        own = F.when(is_digit & (acc["k"] >= first), F.substring(digits, acc["k"] - first + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], own).alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step, lambda acc: acc["out"])


def _new_name(identity: Column, gender: Column, draw: Column, attempt: Column) -> Column:
    """As many names as in the original, of its gender and script; each other attempt adds a syllable."""
    words = F.split(identity, " ")

    def made(script: str) -> Column:
        part = _array(SYLLABLES[script])
        end = F.when(gender == "f", _array(ENDINGS[script]["f"])).when(gender == "m", _array(ENDINGS[script]["m"])).otherwise(_array(ENDINGS[script]["o"]))

        def one(_: Column, k: Column) -> Column:
            count = F.lit(2) + F.when(k > 0, 1).otherwise(0) + F.floor(attempt / 2).cast("int")
            body = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda j: F.element_at(part, _pick(draw, k * 5 + j, len(SYLLABLES[script])) + 1)), "")
            return F.initcap(F.concat(body, F.when(k == 0, F.element_at(end, _pick(draw, k + 11, 4) + 1)).otherwise("")))

        return F.array_join(F.transform(words, one), " ")

    return F.when(identity.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _new_value(kind: Column, identity: Column, gender: Column, draw: Column, attempt: Column) -> Column:
    """The surrogate of an entity in the notation of its identity."""
    no = F.lit(False)
    size = F.length(identity)
    body = F.concat(F.substring(identity, 1, 1), _reshape(F.substring(identity, F.lit(2), size - 2), draw, no))
    check = F.pmod(-_luhn_sum(body, True), F.lit(10)).cast("string")
    other = F.pmod(check.cast("int") + 1 + _pick(draw, 3, 9), F.lit(10)).cast("string")
    card = F.concat(body, F.when(_luhn_sum(identity, False) % 10 == 0, check).otherwise(other))
    local, domain = F.substring_index(identity, "@", 1), F.substring_index(identity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    octet = lambda k: (_pick(draw, k, 254) + 1).cast("string")
    reserved = domain.rlike(r"(^|\.)example\.(com|net|org)$")
    label = F.when(reserved, F.regexp_replace(domain, r"example\.(com|net|org)$", "")).otherwise(host)
    tail = F.when(reserved, F.regexp_extract(domain, r"(example\.(com|net|org))$", 1)).otherwise(top)
    # a short name has few shapes: later attempts lengthen it
    longer = F.when(attempt > 1, F.substring(F.translate(F.reverse(draw), "0123456789", "ghijkmnpqr"), F.lit(1), attempt)).otherwise("")
    email = F.concat(_reshape(local, draw, no), longer, F.lit("@"), _reshape(label, F.reverse(draw), no, 0, reserved), tail)
    # numbers with 555 are set aside for examples and stay so as long as that leaves enough
    phone = _reshape(identity, draw, no)
    phone = F.when((size == 10) & (F.substring(identity, 4, 3) == "555") & (attempt < 4), F.concat(F.substring(phone, 1, 3), F.lit("555"), F.substring(phone, 7, 4))).otherwise(phone)
    return (
        F.when(kind == "name", _new_name(identity, gender, draw, attempt))
        .when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(kind == "ip6", _reshape(identity, draw, F.lit(True)))
        .when(kind == "card", card)
        .when(kind.isin("key", "iban"), _reshape(identity, draw, no, 4))
        .when(kind == "secret", _reshape(identity, draw, identity.rlike("^[0-9a-f]+$")))
        .otherwise(_reshape(identity, draw, no))
    )


def _draw(key: str, kind: Column, identity: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, identity, attempt.cast("string")), 512)


def _written(kind: Column, mention: Column, identity: Column, value: Column) -> Column:
    """The surrogate in the notation of a mention."""
    title, bare = F.regexp_extract(mention, f"^({_TITLE})", 1), F.lower(_bare_name(mention))
    part = F.when(F.size(F.split(bare, " ")) == F.size(F.split(identity, " ")), value).when(
        bare == F.substring_index(identity, " ", 1), F.substring_index(value, " ", 1)
    )
    name = F.concat(title, part.otherwise(F.substring_index(value, " ", -1)))
    capital = F.when(mention.rlike(r"^[^@]*\p{Lu}") & (mention == F.upper(mention)), F.upper(value)).otherwise(value)
    return (
        F.when(kind == "name", name)
        .when(kind.isin("email", "ip6"), capital)
        .when(kind.isin("phone", "card", "ssn"), _fill_digits(mention, _digits(value)))
        .when(kind == "secret", F.concat(_secret_prefix(mention), value))
        .when((kind == "iban") & mention.contains(" "), F.trim(F.regexp_replace(value, "(.{4})", "$1 ")))
        .otherwise(value)
    )


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "2"))
    out = F.replace(F.replace(out, F.lit(_BEGIN), F.lit(_ESCAPE + "0")), F.lit(_END), F.lit(_ESCAPE + "1"))
    return F.when(text.rlike(f"[{_BEGIN}{_END}{_ESCAPE}]"), out).otherwise(text)


def _plain(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(_ESCAPE + "0"), F.lit(_BEGIN)), F.lit(_ESCAPE + "1"), F.lit(_END))
    return F.when(text.contains(_ESCAPE), F.replace(out, F.lit(_ESCAPE + "2"), F.lit(_ESCAPE))).otherwise(text)


def _cut_at(text: Column, pattern: Column) -> Column:
    """What is between the matches of a pattern and the matches, by turns."""
    return F.split(F.regexp_replace(text, pattern, F.lit(f"{_BEGIN}$0{_END}")), f"[{_BEGIN}{_END}]", -1)


def _told(parts: Column) -> Column:
    """Names that mentions introduce, as they are written, and the genders that their titles tell."""
    mentions = F.filter(parts, lambda p, k: k % 2 == 1)
    names = F.filter(mentions, lambda m: _kind(m) == "name")
    return F.transform(names, lambda m: F.struct(_bare_name(m).alias("name"), _gender(m).alias("gender")))


def _people(told: Column) -> Column:
    """The full names among them, in order, each with the first gender told."""
    full = F.array_distinct(F.transform(F.filter(told, lambda t: t["name"].contains(" ")), lambda t: t["name"]))
    genders = lambda n: F.transform(F.filter(told, lambda t: (t["name"] == n) & (t["gender"] != "o")), lambda t: t["gender"])
    return F.transform(full, lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at(genders(n), F.lit(1)), F.lit("o")).alias("gender")))


def _further(told: Column) -> Column:
    """A pattern of all further mentions of these names: the longest first, whole or one word of them."""
    every = F.array_distinct(F.concat(F.transform(told, lambda t: t["name"]), F.flatten(F.transform(told, lambda t: F.split(t["name"], " ")))))
    ordered = F.transform(F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("size"), w.alias("word")))), lambda x: x["word"])
    quoted = F.array_join(F.transform(ordered, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))


def _mark(mention: Column, people: Column) -> Column:
    """Kind, identity and gender of a mention. One word of a name is the first person of the document who has it and whose
    gender the title allows; without any, a person of its own."""
    kind, gender = _kind(mention), _gender(mention)
    bare = _bare_name(mention)
    fits = lambda p: ((F.substring_index(p["name"], " ", -1) == bare) | (F.substring_index(p["name"], " ", 1) == bare)) & (
        (gender == "o") | (p["gender"] == "o") | (p["gender"] == gender)
    )
    known = F.try_element_at(F.transform(F.filter(people, fits), lambda p: F.lower(p["name"])), F.lit(1))
    identity = F.when((kind == "name") & ~bare.contains(" "), F.coalesce(known, F.lower(bare))).otherwise(_identity(kind, mention))
    return F.struct(kind.alias("kind"), identity.alias("identity"), F.when(kind == "name", gender).otherwise("o").alias("gender"))


def searched(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, and for texts with mentions ``parts`` (what is between mentions and the mentions, by turns) and
    ``marks`` (kind, identity and gender of each mention)."""
    out = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("parts", _cut_at(_escaped(F.col("text")), F.lit(ANY)))
    out = out.withColumn("told", F.when(F.size("parts") > 1, _told(F.col("parts"))))
    pattern = _further(F.col("told"))
    again = F.flatten(F.transform("parts", lambda p, k: F.when(k % 2 == 0, _cut_at(p, F.col("further"))).otherwise(F.array(p))))
    out = out.withColumn("further", F.when(F.size("told") > 0, pattern)).withColumn("parts", F.when(F.size("told") > 0, again).otherwise(F.col("parts")))
    mentions = F.filter("parts", lambda p, k: k % 2 == 1)
    out = out.withColumn("people", F.when(F.size("told") > 0, _people(F.col("told"))).otherwise(F.array().cast("array<struct<name:string,gender:string>>")))
    marks = F.transform(mentions, lambda m: _mark(m, F.col("people")))
    some = F.size("parts") > 1
    return out.select(*docs.columns, "row", F.when(some, F.col("parts")).alias("parts"), F.when(some, marks).alias("marks"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """The stored table ``kind, identity, n, value`` of all entities in the table ``found`` (kind, identity, gender)."""
    given = lambda g: F.substring_index("identity", " ", 1).isin([w.lower() for w in GIVEN[g]])
    gender = F.coalesce(F.min(F.when(F.col("gender") != "o", F.col("gender"))), F.when(given("f"), "f").when(given("m"), "m"), F.lit("o"))
    entities = materialize(found.groupBy("kind", "identity").agg(gender.alias("gender"), F.count("*").alias("n")), "entities")
    own = entities.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        drawn = own.withColumn("draw", _draw(key, F.col("kind"), F.col("identity"), F.col("attempt")))
        value = _new_value(F.col("kind"), F.col("identity"), F.col("gender"), F.col("draw"), F.col("attempt"))
        drawn = materialize(drawn.select("kind", "identity", "gender", "n", "attempt", value.alias("value")), "surrogates")
        # a name's surrogate is compared in lower case, like the original
        bare = drawn.withColumn("value", F.when(F.col("kind") == "name", F.lower("value")).otherwise(F.col("value")))
        met = bare.groupBy("kind", "value").agg(F.count("*").alias("times"), F.min(F.struct("attempt", "identity")).alias("first")).where("times > 1")
        late = bare.join(met, ["kind", "value"]).where(F.struct("attempt", "identity") != F.col("first")).select("kind", "identity")
        there = entities.select("kind", F.col("identity").alias("value"))
        known = bare.join(there, ["kind", "value"], "left_semi").select("kind", "identity")
        again = materialize(late.unionByName(known).distinct().withColumn("again", F.lit(1)), "redraw")
        if again.isEmpty():
            return drawn.select("kind", "identity", "n", "value")
        own = drawn.drop("value").join(again, ["kind", "identity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def replace_personal_data(docs: DataFrame, key: str = "kinstrand") -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text) with the personal data in ``text`` replaced, and ``n_replaced long``.

    Equal entities get equal surrogates in every document, different ones different surrogates, none of which occurs in
    the input as a value of its type. A column ``n_chars`` is kept true. A null text stays null with 0 replaced; texts
    without mentions are returned as they are; repeated rows are treated alike; a column named ``n_replaced`` is replaced;
    other columns may have any names; an empty table gives no rows. Other keys give other surrogates. A name that neither a
    form of address nor a given name of the list introduces in the document is not found.
    """
    columns = [c for c in docs.columns if c != "n_replaced"]
    # further columns travel under names of their own, so that none can clash
    inner = {c: f"column {k}" for k, c in enumerate(columns) if c != "text"}
    rows = docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    rows = materialize(searched(rows), "searched")
    marked = rows.where("marks IS NOT NULL").select("row", F.explode("marks").alias("m")).select("row", "m.*")
    values = surrogates(marked, key)
    mentioned = marked.select("row", "kind", "identity").distinct()
    hot = F.broadcast(values.where(F.col("n") > HOT_MENTIONS).drop("n"))  # at most one of HOT_MENTIONS mentions
    rest = mentioned.join(hot, ["kind", "identity"], "left_anti").join(values.where(F.col("n") <= HOT_MENTIONS).drop("n"), ["kind", "identity"])
    valued = rest.unionByName(mentioned.join(hot, ["kind", "identity"]).select(*rest.columns))
    by_row = valued.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "identity"), "value"))).alias("values"))
    value = lambda s: F.element_at(F.col("values"), F.concat_ws(":", s["kind"], s["identity"]))

    def part(p: Column, k: Column) -> Column:
        mark = F.element_at(F.col("marks"), (F.floor(k / 2) + 1).cast("int"))
        return F.when(k % 2 == 0, p).otherwise(_written(mark["kind"], p, mark["identity"], value(mark)))

    new = _plain(F.array_join(F.transform("parts", part), ""))
    replaced = rows.where("marks IS NOT NULL").join(by_row, "row").select(new.alias("text"), *inner.values(), F.size("marks").cast("long").alias("n_replaced"))
    same = rows.where("marks IS NULL").select("text", *inner.values(), F.lit(0).cast("long").alias("n_replaced"))

    def picked(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(inner[c])).alias(c)
        return F.col(inner[c]).alias(c)

    return replaced.unionByName(same).select(*(picked(c) for c in columns), "n_replaced")
