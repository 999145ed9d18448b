r"""PII surrogates in DataFrame functions only.

Entities are found by one pattern and classified. Each stands for one identity or two,
whatever its spelling: an address in lower case, a number's digits with the country, a
family name and a given name within that family. A surrogate is drawn for the identity
from a keyed digest, and then written in the form of the entity - case, script,
punctuation, card prefix and check digit, title and grammatical gender of a name. So the
same identity gets the same surrogate everywhere (coreference), also in another format or
when a full name is followed by the bare family name.

Distinctness is checked over the whole table: distinct identities whose surrogates
coincide, or whose surrogate is itself an identity in the table, are drawn again with
the next attempt number until none is left; where the space of a format is small, later
attempts draw from a wider one, so this always ends. Only such identities, usually few,
are kept in a table of exceptions; documents that hold one of them are joined with it.

A text is rebuilt from the pieces between entities, so nothing outside an entity
changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column, others, unused
from .storage import Scratch

#: Titles by grammatical gender (fixed values); Dr and Prof have none.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Srta", "Señora", "Doña")
NEUTRAL_TITLES = ("Dr", "Prof")

#: Given names by script and gender, and endings of family names by script (fixed values).
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Noah", "Oskar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Maria", "Nina", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Chris", "Dana", "Eden", "Finley", "Jamie", "Jordan", "Kim", "Kai", "Lee", "Morgan", "Noel", "Quinn", "Robin", "Sasha", "Toni"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава", "Паша", "Тоня", "Шура", "Лёля"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ro", "sa", "se", "ta"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "та", "то"),
}

_NAME = r"\p{Lu}[\p{L}'-]{1,30}"
_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES))
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_SECRET_NAME = "token|secret|api_key|apikey|password"
SECRET = (
    rf"""(?i:{_SECRET_NAME})["']?\s{{0,3}}[=:]\s{{0,3}}(?:["'][A-Za-z0-9_/+=.-]{{16,4096}}["']"""
    r"""|(?=[A-Za-z_/+=.-]{0,64}[0-9])[A-Za-z0-9_/+=.-]{16,4096}(?![A-Za-z0-9_/+=.-]))"""
)
SSN = r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.+-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d|[.]\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])"
)
PERSON = rf"\b(?:{_TITLE})\b\.? {_NAME}(?: {_NAME})?"
ENTITY = "|".join((EMAIL, SECRET, SSN, CARD, IP, PHONE, PERSON))

#: What every entity has one of: a cheap test that spares most texts the pattern.
HINTS = (r"[0-9@]", rf"\b(?:{_TITLE})\b\.? \p{{Lu}}", rf"""(?i:{_SECRET_NAME})["']?\s{{0,3}}[=:]""")

#: Attempts after which a format's space is widened, again and again.
WIDEN = 8

#: Country codes of one and of two digits in international numbers; others have three (fixed values).
ONE_DIGIT, TWO_DIGITS = "17", r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn scheme, the last digit counting once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def classify(value: Column) -> Column:
    """Type of a match of ``ENTITY``; null if it only looks like one."""
    digits = _digits(value)
    card = value.rlike(rf"^(?:{CARD})$") & digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)") & (luhn_sum(digits) % 10 == 0)
    ip = F.forall(F.split(value, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(value.rlike(rf"""^(?i:{_SECRET_NAME})["']?\s{{0,3}}[=:]"""), F.lit("secret"))
        .when(value.rlike("@"), F.lit("email"))
        .when(value.rlike(rf"^(?:{_TITLE})\b"), F.lit("person"))
        .when(value.rlike(rf"^(?:{SSN})$"), F.lit("ssn"))
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(ip, F.lit("ip")))
        .when(value.rlike(r"^\d[\d -]*\d$") & digits.rlike(r"^\d{15,16}$"), F.when(card, F.lit("card")))
        .when(value.rlike(r"^[+(\d][\d ().+-]*$"), F.lit("phone"))
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class _Stream:
    """Numbers derived from a keyed digest of type, value and attempt: 16 of a SHA-256."""

    def __init__(self, digests: Column):
        self.digests = digests

    @classmethod
    def use(cls, key: str, kind: str, value: Column, attempt: Column, n: Column | int, body) -> Column:
        """``body(stream)`` with a stream of ``n`` numbers."""
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), attempt.cast("string"), value)
        n = n if isinstance(n, Column) else F.lit(n)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int"))
        text = F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256)), "")
        return _let(text, lambda digests: body(cls(digests)))

    def number(self, i: Column | int) -> Column:
        """The i-th number, 0 to 2**16 - 1."""
        at = (i if isinstance(i, Column) else F.lit(i)) * 4 + 1
        return F.conv(F.substr(self.digests, at, F.lit(4)), 16, 10).cast("int")

    def pick(self, alphabet: str | tuple[str, ...], i: Column | int) -> Column:
        nth = self.number(i) % len(alphabet)
        if isinstance(alphabet, str):
            return F.substr(F.lit(alphabet), nth + 1, F.lit(1))
        return F.element_at(F.array(*[F.lit(c) for c in alphabet]), nth + 1)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"


def _reshape(value: Column, stream: _Stream, *, hexadecimal: bool = False) -> Column:
    """Every letter and digit replaced by another of its class, case and script; the
    rest, and letters of other scripts' signs, kept."""
    lower, upper = ("abcdef", "ABCDEF") if hexadecimal else (_LOWER, _UPPER)

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), stream.pick(_DIGIT, i))
            .when(c.rlike("[a-zß-ÿ]"), stream.pick(lower, i))
            .when(c.rlike("[A-ZÀ-Þ]"), stream.pick(upper, i))
            .when(c.rlike("[а-яё]"), stream.pick(_CYRILLIC, i))
            .when(c.rlike("[А-ЯЁ]"), stream.pick(_CYRILLIC.upper(), i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits_of(stream: _Stream, first: int, n: Column) -> Column:
    """``n`` random digits, by the numbers from ``first`` on; '' for none."""
    places = F.filter(F.sequence(F.lit(first), F.lit(first) + F.greatest(n, F.lit(1)) - 1), lambda i: i < n + first)
    return F.array_join(F.transform(places, lambda i: stream.pick(_DIGIT, i)), "")


def _wider(attempt: Column) -> Column:
    """How often the space of a format has been widened at an attempt."""
    return F.floor(attempt / WIDEN).cast("int")


# --- identities: what is drawn for ---------------------------------------------------------

_PLAIN_SECRET = rf"""^(.*?(?i:{_SECRET_NAME})["']?\s{{0,3}}[=:]\s{{0,3}}["']?)(.*?)(["']?)$"""


def _phone_id(value: Column) -> Column:
    """Country and national digits, 'cc:digits'. Numbers without a country are those of the
    formats that the country 1 has."""
    digits = _digits(value)
    code = (
        F.when(~value.startswith("+"), F.lit("1"))
        .when(digits.rlike(f"^[{ONE_DIGIT}]"), F.substring(digits, 1, 1))
        .when(digits.rlike(f"^(?:{TWO_DIGITS})"), F.substring(digits, 1, 2))
        .otherwise(F.substring(digits, 1, 3))
    )
    national = F.when(value.startswith("+"), F.substr(digits, F.length(code) + 1, F.length(digits))).otherwise(digits)
    return F.concat_ws(":", code, national)


def _words_of(value: Column) -> tuple[Column, Column, Column]:
    """Title, given name ('' if there is none) and family name of a person."""
    words = F.split(value, " ")
    given = F.when(F.size(words) > 2, F.element_at(words, 2)).otherwise(F.lit(""))
    return F.element_at(words, 1), given, F.element_at(words, -1)


def _gender(title: Column) -> Column:
    bare = F.replace(title, F.lit("."), F.lit(""))
    return F.when(bare.isin(*MALE_TITLES), "m").when(bare.isin(*FEMALE_TITLES), "f").otherwise("n")


def _family_id(value: Column) -> Column:
    return F.concat(F.lit("family|"), F.lower(_words_of(value)[2]))


def _given_id(value: Column) -> Column:
    """A given name is one of its family and gender."""
    title, given, family = _words_of(value)
    return F.concat_ws("|", F.lit("given"), F.lower(family), _gender(title), F.lower(given))


def identities(value: Column, kind: Column) -> Column:
    """The identities ('type|what') of an entity, as an array; empty for a null kind."""
    simple = (
        F.when(kind == "email", F.lower(value)).when(kind == "phone", _phone_id(value)).when(kind == "card", _digits(value))
        .when(kind == "secret", F.regexp_extract(value, _PLAIN_SECRET, 2)).otherwise(value)
    )
    return (
        F.when(kind.isNull(), F.array().cast("array<string>"))
        .when(kind != "person", F.array(F.concat_ws("|", kind, simple)))
        .when(_words_of(value)[1] == "", F.array(_family_id(value)))
        .otherwise(F.array(_family_id(value), _given_id(value)))
    )


def _draw_email(what: Column, key: str, attempt: Column) -> Column:
    local, domain = F.substring_index(what, "@", 1), F.substring_index(what, "@", -1)
    # addresses of a domain stay together
    host = _Stream.use(key, "domain", domain, F.lit(0), 2, lambda s: (s.number(0).cast("long") * 65536 + s.number(1)).cast("string"))
    more = _wider(attempt)
    made = _Stream.use(
        key, "email", what, attempt, F.length(local) + more,
        lambda s: F.concat(_reshape(local, s), F.substr(F.sha2(s.digests, 256), F.lit(1), more)),
    )
    return F.concat(made, F.lit("@mail"), host, F.lit(".example.org"))


def _draw_phone(what: Column, key: str, attempt: Column) -> Column:
    code, national = F.substring_index(what, ":", 1), F.substring_index(what, ":", -1)
    area = F.substring(national, 1, 1)

    def made(s: _Stream) -> Column:
        first = F.when(area.isin("0", "1"), area).otherwise(s.pick("23456789", 0))
        return F.concat(code, F.lit(":"), first, _digits_of(s, 1, F.length(national) - 1 + _wider(attempt)))

    return _Stream.use(key, "phone", what, attempt, F.length(national) + _wider(attempt) + 1, made)


def _draw_card(what: Column, key: str, attempt: Column) -> Column:
    body = _Stream.use(key, "card", what, attempt, 20, lambda s: F.concat(F.substring(what, 1, 2), _digits_of(s, 0, F.length(what) - 3)))
    return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _draw_ip(what: Column, key: str, attempt: Column) -> Column:
    first = F.substring_index(what, ".", 1)
    private = first.isin("10", "127") | what.rlike(r"^192\.168\.") | what.rlike(r"^172\.(1[6-9]|2\d|3[01])\.")
    wide = attempt >= WIDEN  # any address of 10.0.0.0/8, of 127.0.0.0/8, or any public one but for the first

    def made(s: _Stream) -> Column:
        octet = lambda i: (s.number(i) % 256).cast("string")
        kept = F.when(wide, F.concat_ws(".", F.when(first == "127", first).otherwise("10"), octet(1))).otherwise(F.substring_index(what, ".", 2))
        public = F.when(wide, s.number(0) % 91 + 12).otherwise(s.number(0) % 98 + 128).cast("string")
        return F.concat_ws(".", F.when(private, kept).otherwise(F.concat_ws(".", public, octet(1))), octet(2), octet(3))

    return _Stream.use(key, "ip", what, attempt, 4, made)


def _draw_secret(what: Column, key: str, attempt: Column) -> Column:
    made = lambda s: F.when(what.rlike("^[0-9a-fA-F]+$"), _reshape(what, s, hexadecimal=True)).otherwise(_reshape(what, s))
    return _Stream.use(key, "secret", what, attempt, F.length(what), made)


def _syllables(s: _Stream, script: str, first: int, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first) + n - 1), lambda i: s.pick(SYLLABLES[script], i)), "")


def _draw_family(what: Column, key: str, attempt: Column) -> Column:
    n = F.lit(4) + _wider(attempt)
    made = lambda s: F.when(what.rlike(r"^\p{IsCyrillic}"), _syllables(s, "cyrillic", 0, n)).otherwise(_syllables(s, "latin", 0, n))
    return _Stream.use(key, "family", what, attempt, n, made)


#: Endings of given names made of syllables, by script and gender (fixed values).
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "n"): "i", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", "n"): "и"}


def _draw_given(what: Column, key: str, attempt: Column) -> Column:
    """Of the family and gender 'family|gender|given': names of the tables at first, then of syllables."""
    family, gender = F.substring_index(what, "|", 1), F.substring_index(F.substring_index(what, "|", 2), "|", -1)

    def of(script: str, s: _Stream) -> Column:
        listed, ending = F.lit(""), F.lit("")
        for g in ("m", "f", "n"):
            listed = F.when(gender == g, F.lower(s.pick(GIVEN[script, g], 0))).otherwise(listed)
            ending = F.when(gender == g, F.lit(_ENDINGS[script, g])).otherwise(ending)
        made = F.concat(_syllables(s, script, 1, F.lit(2) + _wider(attempt)), ending)
        return F.when(attempt < 4, listed).otherwise(made)

    name = _Stream.use(
        key, "given", what, attempt, F.lit(4) + _wider(attempt),
        lambda s: F.when(family.rlike(r"^\p{IsCyrillic}"), of("cyrillic", s)).otherwise(of("latin", s)),
    )
    return F.concat_ws("|", family, gender, name)


def draw_identity(ident: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an identity at an attempt, an identity of the same type."""
    kind, what = F.substring_index(ident, "|", 1), F.substr(ident, F.instr(ident, "|") + 1, F.length(ident))
    made = (
        F.when(kind == "email", _draw_email(what, key, attempt))
        .when(kind == "phone", _draw_phone(what, key, attempt))
        .when(kind == "ip", _draw_ip(what, key, attempt))
        .when(kind == "card", _draw_card(what, key, attempt))
        .when(kind == "ssn", _Stream.use(key, "ssn", what, attempt, F.length(what), lambda s: _reshape(what, s)))
        .when(kind == "family", _draw_family(what, key, attempt))
        .when(kind == "given", _draw_given(what, key, attempt))
        .when(kind == "secret", _draw_secret(what, key, attempt))
        .otherwise(what)
    )
    return F.concat(kind, F.lit("|"), made)


# --- the written form -----------------------------------------------------------------------


def _keep_shape(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by those of ``digits``; more than it
    has go to the end."""
    n = F.length(_digits(value))
    out = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(
            c.rlike(r"\d"), F.struct(F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
    )
    return F.concat(out["s"], F.substr(digits, n + 1, F.length(digits)))


def _keep_case(value: Column, made: Column) -> Column:
    """``made`` (lower case) with capitals where ``value`` has them."""
    all_caps = value.rlike(r"\p{Lu}") & ~value.rlike(r"\p{Ll}") & (F.length(value) > 1)
    mixed = F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.substr(value, i + 1, F.lit(1)).rlike(r"^\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(all_caps, F.upper(made)).when(value.rlike(r"\p{Lu}"), mixed).otherwise(made)


def _render(value: Column, kind: Column, made: Column) -> Column:
    """The surrogate identities (an array) of an entity in its own form."""
    what = F.substr(made[0], F.instr(made[0], "|") + 1, F.length(made[0]))
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    caps = host.rlike("[A-Z]") & ~host.rlike("[a-z]")
    email = F.concat(
        _keep_case(local, F.substring_index(what, "@", 1)), F.lit("@"),
        F.when(caps, F.upper(F.substring_index(what, "@", -1))).otherwise(F.substring_index(what, "@", -1)),
    )
    national = F.substring_index(what, ":", -1)
    phone = F.when(value.startswith("+"), F.concat(F.substring_index(what, ":", 1), national)).otherwise(national)
    secret = F.concat(F.regexp_extract(value, _PLAIN_SECRET, 1), what, F.regexp_extract(value, _PLAIN_SECRET, 3))
    title, given, family = _words_of(value)
    name = lambda old, new: F.when(old.rlike(r"\p{Ll}") | (F.length(old) == 1), F.initcap(new)).otherwise(F.upper(new))
    person = F.concat_ws(" ", title, F.when(given != "", name(given, F.substring_index(made[1], "|", -1))), name(family, what))
    return (
        F.when(kind == "email", email).when(kind.isin("phone", "card"), _keep_shape(value, F.when(kind == "phone", phone).otherwise(what)))
        .when(kind == "secret", secret).when(kind == "person", person).when(kind.isin("ip", "ssn"), what).otherwise(value)
    )


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity; false for null."""
    found = F.lit(False)
    for hint in HINTS:
        found = found | text.rlike(hint)
    return F.coalesce(found, F.lit(False))


def matches(text: Column) -> Column:
    """All matches of the pattern in order, valid or not; null for a text without a hint."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)))


def exceptions(docs: DataFrame, *, key: str, text: str, scratch: Scratch, draw=draw_identity) -> DataFrame | None:
    """(ident, attempt) of identities whose first surrogate is taken; None if there are none.

    Identities keep their surrogate by order; the others try again, against all surrogates
    given so far and all identities in the table.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.filter(hinted(column(text))).select(F.explode(F.array_distinct(matches(column(text)))).alias("value"))
    idents = found.distinct().select(F.explode(identities(F.col("value"), classify(F.col("value")))).alias("ident")).distinct()
    idents = scratch.save(idents, "identities")

    def drawn(rows: DataFrame, attempt: int, name: str) -> DataFrame:
        # dealt out first: a table of small rows would else be one task's work
        dealt = rows.select("ident").repartition(parts, "ident")
        return scratch.save(dealt.select("ident", draw(F.col("ident"), key, F.lit(attempt)).alias("made")), name)

    def settled(rows: DataFrame, taken: DataFrame) -> DataFrame:
        """The rows with ``stays``: whether they are the first of their surrogate, and it is free."""
        first = F.row_number().over(Window.partitionBy("made").orderBy("ident")) == 1
        taken = taken.select(F.col("made").alias("_made"), F.lit(True).alias("_taken"))
        return rows.join(taken, F.col("made") == F.col("_made"), "left").select("ident", "made", (first & F.col("_taken").isNull()).alias("stays"))

    real = idents.select(F.col("ident").alias("made"))
    out, attempt = None, 0
    round_ = scratch.save(settled(drawn(idents, 0, "drawn-0"), real), "round-0")
    kept = round_.filter("stays")
    while not round_.filter("not stays").isEmpty():
        attempt += 1
        rows = drawn(round_.filter("not stays"), attempt, f"drawn-{attempt}")
        taken = real.unionByName(kept.select("made"))
        round_ = scratch.save(settled(rows, taken.distinct()), f"round-{attempt}")
        now = round_.filter("stays")
        mark = now.select("ident", F.lit(attempt).alias("attempt"))
        out = mark if out is None else out.unionByName(mark)
        kept = kept.unionByName(now)
    return out


def replace_pii(
    docs: DataFrame,
    *,
    secret_key: str,
    key: str = "doc_id",
    text: str = "text",
    scratch: Scratch | None = None,
    draw=draw_identity,
) -> DataFrame:
    """``docs`` with ``text`` replaced and ``pii_types`` added: the types of its entities in order.

    Null text stays null with null types. Rows that repeat are treated alike. Values of
    digits that fail a check (octets, Luhn, issuer prefix) are not entities and stay. A
    column ``pii_types`` is replaced; all others, whatever their names, pass through.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    special = exceptions(docs, key=secret_key, text=text, scratch=scratch, draw=draw)
    found, again, at = unused([*docs.columns, "pii_types"], "found", "again", "at")
    body = column(text)
    typed = F.transform(matches(body), lambda v: F.struct(v.alias("value"), classify(v).alias("kind")))
    typed = F.transform(typed, lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"), identities(e["value"], e["kind"]).alias("idents")))
    rows = docs.withColumn(found, typed)
    if special is not None:
        # only documents with such an identity; a hot key among them is combined before it moves
        held = rows.select(column(key).alias(at), F.explode(F.array_distinct(F.flatten(F.transform(found, lambda e: e["idents"])))).alias("ident")).distinct()
        held = held.join(special, "ident").groupBy(at).agg(F.map_from_entries(F.collect_set(F.struct("ident", "attempt"))).alias(again))
        held = scratch.save(held, "again")
        rows = rows.join(held, column(key).eqNullSafe(F.col(at)), "left").drop(at)
    attempt = lambda i: F.coalesce(F.element_at(again, i), F.lit(0)) if special is not None else F.lit(0)
    drawn = lambda e: F.transform(e["idents"], lambda i: draw(i, secret_key, attempt(i)))
    made = F.transform(found, lambda e: F.when(e["kind"].isNull(), e["value"]).otherwise(_let(drawn(e), lambda m: _render(e["value"], e["kind"], m))))
    pieces = F.split(body, ENTITY, -1)
    joined = F.array_join(F.zip_with(pieces, made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    types = F.filter(F.transform(found, lambda e: e["kind"]), lambda t: t.isNotNull())
    kept = others(docs.columns, ["pii_types"])
    columns = [F.when(F.size(found) > 0, joined).otherwise(body).alias(text) if c == text else column(c) for c in kept]
    # without a match the pattern is not run again to cut the text
    none = F.when(body.isNotNull(), F.array().cast("array<string>"))
    return rows.select(*columns, F.coalesce(types, none).alias("pii_types"))
