"""Operator 2, PII: detected entities get keyed surrogates of the same type and form.

DataFrame functions only. An entity is led back to a canonical value (a phone number's digits, an address in lower
case, an IBAN without spaces), which a keyed permutation of all values of its form takes to its surrogate:
a Feistel network over characters, in which each character moves within its own alphabet. So different entities have
different surrogates by construction, one entity has the same one everywhere without a join, and every space is used
in full. The surrogate is then dressed in the form in which the entity was found. What has no such
permutation (names, and numbers whose check digits are wrong) is hashed, all different ones are checked together,
and those that collide are hashed again; only these reach the documents by a join.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import materialise, table

_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
#: Titles by script and gender. Fixed values.
_TITLES = {
    "latin_m": ("Mr", "Herr", "Monsieur", "Señor", "Sr"), "latin_f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"),
    "cyrillic_m": ("господин", "г-н"), "cyrillic_f": ("госпожа", "г-жа"), "devanagari_m": ("श्री",), "devanagari_f": ("श्रीमती",),
}
#: Given names by script and gender, and the syllables of family names by script.
_GIVEN = {
    "latin_m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Karl", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    "latin_f": ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nina", "Olga", "Rosa", "Sara", "Vera"),
    "cyrillic_m": ("Борис", "Виктор", "Игорь", "Олег", "Павел", "Роман", "Степан", "Фёдор"),
    "cyrillic_f": ("Анна", "Вера", "Дарья", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    "devanagari_m": ("अजय", "गणेश", "दीपक", "मोहन", "राजेश", "विजय", "संजय", "सुनील"),
    "devanagari_f": ("अनिता", "कविता", "गीता", "नीता", "मीना", "लता", "सीमा", "सुनीता"),
}
_SYLLABLES = {
    "latin": ("ban", "cor", "del", "fen", "gar", "hol", "kel", "lin", "mar", "nor", "pel", "ros", "sal", "tam", "ver", "wes"),
    "cyrillic": ("бал", "вор", "гал", "дан", "жар", "зин", "кор", "лав", "мар", "нов", "пал", "рон", "сав", "тим", "фад", "шар"),
    "devanagari": ("बल", "चर", "दव", "गन", "हर", "जग", "कम", "लक", "मन", "नव", "पट", "रज", "सर", "तल", "वर", "यश"),
}
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
_WORD = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+|[А-ЯЁ][а-яё-]+|[ऄ-ह][ऀ-ॣ]*)"
NAME = rf"(?:{_TITLE})\.? {_WORD}(?: {_WORD})?"
#: Every kind of entity, tried in this order at the start of a token.
PATTERN = (
    r"(?<![\p{L}\p{N}_.%+-])(?:"
    + _SECRET + r"[^\s\"',;]{4,}"
    + r"|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    + r"|AKIA[0-9A-Z]{12,20}(?![0-9A-Za-z])"
    + r"|(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d])(?!\.\d)"
    + r"|\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)|3[47]\d{13}(?!\d)"
    + r"|\d{3}-\d{2}-\d{4}(?!\d)"
    + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
    + r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
    + "|" + NAME + ")"
)
#: What any entity has in it: a cheap test before the long pattern.
_HINT = rf"@|\d\d|\d\.\d|[=:]|AKIA|(?:{_TITLE})\.? "


def kind_of(e: Column) -> Column:
    return (
        F.when(e.rlike(f"^{_SECRET}"), "secret").when(e.contains("@"), "email").when(e.rlike("^AKIA"), "access_key")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(e.rlike(r"^\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}$|^3[47]\d{13}$"), "card")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(e.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


#: Country codes of phone numbers: one digit, two digits; all others have three. Fixed values of the public numbering plan.
_CODES_1, _CODES_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: A character moves within its alphabet; hexadecimal letters have one of their own, so that hexadecimal stays such. All other characters stay.
_PLAIN = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: Those of a secret's characters.
_ALPHABETS = (*_PLAIN, "!#$%&()*+-./:<=>?@[]^_{|}~", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß")
ROUNDS = 6
#: Hashed values of a task in the collision check: few where that fills the session's shuffle partitions, many beyond.
FEW, MANY = 500, 50_000
KEY_CONF = "hybridqa.pii.key"
Lookup = Callable[[Column], Column]


def lead_of(e: Column) -> Column:
    """What stays: the name of a secret, a name's title."""
    return F.when(e.rlike(f"^{_SECRET}"), F.regexp_extract(e, f"^{_SECRET}", 0)).when(e.rlike(rf"^(?:{_TITLE})\.? "), F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0)).otherwise("")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _number(h: Column, i: Column) -> Column:
    """The i-th number from 0 to 4095 of a digest; the digits are used again after 21."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(21)) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _moved(s: Column, h: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved within its alphabet by the digest's numbers."""

    def one(c: Column, i: Column, d: Column) -> Column:
        out = c
        for a in alphabets:
            at = F.position(c, F.lit(a))
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + _number(d, i), F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return out

    return _bound(h, lambda d: F.array_join(F.transform(_chars(s), lambda c, i: one(c, i, d)), ""))


def permuted(s: Column, tweak: Column, key: str, alphabets: tuple[str, ...] = _PLAIN) -> Column:
    """A keyed permutation, one for each tweak, of the strings with the same alphabets at the same places."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("x"), F.substring(s, half + 1, F.length(s)).alias("y"))
    step = lambda a, r: F.struct(a["y"].alias("x"), _moved(a["x"], _digest(key, tweak, r.cast("string"), a["y"]), alphabets).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["x"], a["y"]))


def _dressed(found: Column, new: Column) -> Column:
    """The letters and digits of new in the places of those of found, small where found has small letters."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(_chars(found), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, nth(i), F.lit(1))).otherwise(c)), "")


def _cased(found: Column, new: Column) -> Column:
    """new, of the same length, with capitals where found has them."""
    return F.array_join(F.transform(_chars(found), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")


def luhn(body: Column) -> Column:
    """The check digit that follows the digits of a card number."""
    n = F.length(body)
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(_chars(body), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def title_class(lead: Column) -> Column:
    """Script and gender of a name's title."""
    title, out = F.regexp_replace(lead, r"\.? $", ""), F.lit("")
    for which, titles in _TITLES.items():
        out = F.when(title.isin(*titles), which).otherwise(out)
    return out


def family_id(which: Column, core: Column) -> Column:
    """What a family name is checked by: its script and last word."""
    return F.concat_ws("\x1f", F.lit("family"), F.substring_index(which, "_", 1), F.substring_index(core, " ", -1))


def given_id(which: Column, core: Column) -> Column:
    return F.concat_ws("\x1f", F.lit("given"), which, core)


def _spelled(h: Column, parts: tuple[str, ...], last: Column, between: str) -> Column:
    """Parts 0 to last, each chosen by a number of the digest."""
    some = F.array(*map(F.lit, parts))
    return _bound(h, lambda d: F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(some, F.pmod(_number(d, i), F.lit(len(parts))) + 1)), between))


def _family(which: Column, core: Column, attempt: Column, key: str) -> Column:
    """A family name of syllables in the title's script; one more syllable for each attempt."""
    out = F.lit("")
    for script, syllables in _SYLLABLES.items():
        out = F.when(which.startswith(script), _spelled(_digest(key, family_id(which, core), attempt.cast("string")), syllables, 2 + attempt, "")).otherwise(out)
    return _bound(out, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))


def _given(which: Column, core: Column, attempt: Column, key: str) -> Column:
    """A given name of the title's gender and script; one more, joined by a hyphen, for each attempt."""
    out = F.lit("")
    for each, names in _GIVEN.items():
        out = F.when(which == each, _spelled(_digest(key, given_id(which, core), attempt.cast("string")), names, attempt, "-")).otherwise(out)
    return out


def _name(lead: Column, core: Column, attempt: Lookup, key: str) -> Column:
    """The family name hangs on the last word alone, so that `Mr Smith` and `Mr John Smith` share it."""
    which = title_class(lead)
    family = _family(which, core, attempt(family_id(which, core)), key)
    return F.when(core.contains(" "), F.concat_ws(" ", _given(which, core, attempt(given_id(which, core)), key), family)).otherwise(family)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def number_id(kind: Column, core: Column) -> Column:
    return F.concat_ws("\x1f", kind, F.upper(F.regexp_replace(core, "[ -]", "")))


def _card(core: Column, attempt: Lookup, key: str) -> Column:
    """The first digit stays, the check digit is valid. Numbers whose own isn't valid are hashed by how far it is off."""

    def new(d: Column) -> Column:
        n = F.length(d)
        off = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - luhn(F.substring(d, F.lit(1), n - 1)), F.lit(10))
        tweak = F.concat_ws("|", F.lit("card"), F.substring(d, 1, 1), off.cast("string"), F.when(off != 0, attempt(number_id(F.lit("card"), d))).otherwise(0).cast("string"))
        body = F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), n - 2), tweak, key))
        return _bound(body, lambda b: F.concat(b, luhn(b).cast("string")))

    return _dressed(core, _bound(_digits(core), new))


def _iban(core: Column, attempt: Lookup, key: str) -> Column:
    def new(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
        right = F.substring(v, 3, 2) == iban_check(country, account)
        tweak = F.concat_ws("|", F.lit("iban"), country, F.when(right, "").otherwise(F.concat_ws("|", F.substring(v, 3, 2), attempt(number_id(F.lit("iban"), v)).cast("string"))))
        return _bound(permuted(account, tweak, key), lambda b: F.concat(country, iban_check(country, b), b))

    return _dressed(core, _bound(F.regexp_replace(core, " ", ""), new))


def _phone(core: Column, key: str) -> Column:
    """The country code stays, wherever the spaces are."""

    def new(d: Column) -> Column:
        n = F.when(~core.startswith("+"), 0).when(F.substring(d, 1, 1).isin(*_CODES_1), 1).when(F.substring(d, 1, 2).isin(*_CODES_2), 2).otherwise(3)
        code = F.substring(d, F.lit(1), n)
        return F.concat(code, permuted(F.substring(d, n + 1, F.length(d)), F.concat_ws("|", F.lit("phone"), F.substring(core, 1, 1) == "+", code), key))

    return _dressed(core, _bound(_digits(core), new))


def _email(core: Column, key: str) -> Column:
    """The part before the sign and the host move, the last label stays, and the reserved domain `.example` follows."""
    local, host = F.substring_index(core, "@", 1), F.lower(F.substring_index(core, "@", -1))
    last = F.substring_index(host, ".", -1)
    first = F.substring(host, F.lit(1), F.length(host) - F.length(last) - 1)
    return F.concat(_cased(local, permuted(F.lower(local), F.concat_ws("|", F.lit("email"), host), key)), F.lit("@"), permuted(first, F.concat_ws("|", F.lit("host"), last), key), F.lit("."), last, F.lit(".example"))


def _ip(core: Column, key: str) -> Column:
    """A permutation of all addresses: the halves move by each other's digests, octet by octet."""
    octets = F.transform(F.split(core, "\\."), lambda o: o.cast("int"))
    half = lambda a, b: F.struct(F.element_at(octets, a).alias("p"), F.element_at(octets, b).alias("q"))
    start = F.struct(half(1, 2).alias("x"), half(3, 4).alias("y"))

    def step(a: Column, r: Column) -> Column:
        h = _digest(key, F.lit("ip"), r.cast("string"), a["y"]["p"].cast("string"), a["y"]["q"].cast("string"))
        moved = _bound(h, lambda d: F.struct(F.pmod(a["x"]["p"] + _number(d, F.lit(0)), F.lit(256)).alias("p"), F.pmod(a["x"]["q"] + _number(d, F.lit(1)), F.lit(256)).alias("q")))
        return F.struct(a["y"].alias("x"), moved.alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat_ws(".", a["x"]["p"], a["x"]["q"], a["y"]["p"], a["y"]["q"]))


def _secret(core: Column, key: str) -> Column:
    """Permuted by form; of a secret without any character of the alphabets, a digest of its length."""
    return F.when(core.rlike("[" + "".join(_ALPHABETS).replace("[", "\\[").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-").replace("&", "\\&") + "]"), permuted(core, F.lit("secret"), key, _ALPHABETS)).otherwise(F.substring(_digest(key, F.lit("secret"), core), F.lit(1), F.greatest(F.length(core), F.lit(16))))


def surrogate(e: Column, attempt: Lookup, key: str) -> Column:
    """What stands in the text instead of an entity (kind, lead, core), after its lead."""
    kind, core = e["kind"], e["core"]
    return (
        F.when(kind == "email", _email(core, key))
        .when(kind == "ip", _ip(core, key))
        .when(kind == "card", _card(core, attempt, key))
        .when(kind == "name", _name(e["lead"], core, attempt, key))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), permuted(F.substring(core, F.lit(5), F.length(core)), kind, key)))
        .when(kind == "iban", _iban(core, attempt, key))
        .when(kind == "phone", _phone(core, key))
        .when(kind == "ssn", _dressed(core, permuted(_digits(core), kind, key)))
        .otherwise(_secret(core, key))
    )


def _entity(e: Column) -> Column:
    lead = lead_of(e)
    return F.struct(kind_of(e).alias("kind"), lead.alias("lead"), F.substring(e, F.length(lead) + 1, F.length(e)).alias("core"))


def collided(hashed: DataFrame, new: Callable[[Column], Column], parts: int = 1) -> DataFrame:
    """id, attempt (1 or more) of those of hashed (id, space, movable, other columns) whose first surrogate can't be used.

    parts: tasks of the first round, as its few bytes say little of its work.

    new: the surrogate, from the columns of hashed and an attempt. In a space, an id that can't move keeps its surrogate;
    of others with one, the least by a hash does. A value that any id has had is never given again, so only the
    ids that collide go through a round; what the rounds before gave is read, not written again.
    """
    now = materialise(hashed.repartition(parts, "id").withColumn("attempt", F.lit(0)).withColumn("new", new(F.lit(0))), "pii-hashed")
    given, out, attempt = now.select("space", "new"), None, 0
    while True:
        keeper = now.groupBy("space", "new").agg(F.min(F.struct("movable", F.xxhash64("id").alias("h"), "id")).alias("best"), F.count("*").alias("n")).where("n > 1").select("space", "new", F.col("best.id").alias("keeper"))
        lost = now.join(keeper, ["space", "new"]).where("id <> keeper and movable").select(*hashed.columns)
        if attempt:
            taken = now.join(before, ["space", "new"], "left_semi").select(*hashed.columns)  # noqa: F821
            lost = lost.unionByName(taken).dropDuplicates(["id"])
            stay = now.select("id", "attempt")
            out = stay if out is None else out.unionByName(stay)
        lost = materialise(lost, "pii-lost")
        if not lost.take(1):
            break
        attempt, before = attempt + 1, given
        now = materialise(lost.withColumn("attempt", F.lit(attempt)).withColumn("new", new(F.lit(attempt))), "pii-hashed")
        given = given.unionByName(now.select("space", "new"))
    if out is None:
        return now.where("false").select("id", "attempt")
    return out.groupBy("id").agg(F.max("attempt").alias("attempt"))


def _bumped(entities: DataFrame, key: str) -> DataFrame:
    """id, attempt of all hashed values that had to be hashed again."""
    n, slots = entities.count(), int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(n // FEW + 1, slots), n // MANY + 1)
    which = title_class(F.col("lead"))
    names = entities.where("kind = 'name'").select(which.alias("which"), "core").distinct()
    families = names.withColumn("id", family_id(F.col("which"), F.col("core"))).groupBy("id").agg(F.min(F.struct("which", "core")).alias("w")).select("id", "w.which", "w.core", F.substring_index("w.which", "_", 1).alias("space"), F.lit(True).alias("movable"))
    family = collided(families, lambda a: _family(F.col("which"), F.col("core"), a, key), parts)
    pairs = names.where(F.col("core").contains(" ")).select(given_id(F.col("which"), F.col("core")).alias("id"), "which", "core", F.concat_ws("\x1f", "which", F.substring_index("core", " ", -1)).alias("space"), F.lit(True).alias("movable"))
    given = collided(pairs, lambda a: _given(F.col("which"), F.col("core"), a, key), parts)
    numbers = entities.where("kind in ('card', 'iban')").select("kind", F.upper(F.regexp_replace("core", "[ -]", "")).alias("core")).distinct()
    right = F.when(F.col("kind") == "card", luhn(F.substring("core", F.lit(1), F.length("core") - 1)).cast("string") == F.substring("core", F.length("core"), F.lit(1))).otherwise(iban_check(F.substring("core", 1, 2), F.substring("core", F.lit(5), F.length("core"))) == F.substring("core", 3, 2))
    numbers = numbers.select(number_id(F.col("kind"), F.col("core")).alias("id"), "kind", "core", F.col("kind").alias("space"), (~right).alias("movable"))
    number = collided(numbers, lambda a: F.when(F.col("kind") == "card", _card(F.col("core"), lambda _: a, key)).otherwise(_iban(F.col("core"), lambda _: a, key)), parts)
    return family.unionByName(given).unionByName(number)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with each entity in text replaced, and n_entities; other columns stay, n_chars follows the text.

    A null text stays null, without entities; an empty table stays empty. Repeated rows, rows with one doc_id and rows
    without one are each replaced in their own text. A column n_entities of docs gives way to the new one; any other name may
    occur. Different entities of a kind never share a surrogate; one entity has the same one in all its forms. A name that
    a text has after a title is replaced where it stands without one, too. Who has not got the key can't lead a
    surrogate back; there is no default.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names = [c for c in docs.columns if c != "n_entities"]
    has = F.coalesce(F.col("text").rlike(_HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    rows = docs.where(has).select(F.struct(*names).alias("row"), "text")
    found = materialise(rows.select("row", "text", F.transform(F.regexp_extract_all("text", F.lit(PATTERN), 0), _entity).alias("found")).withColumn("at", F.monotonically_increasing_id()), "pii-found")
    entities = found.select(F.explode("found").alias("e")).select("e.*").where("kind in ('name', 'card', 'iban')").distinct()
    bumped = materialise(_bumped(materialise(entities, "pii-entities"), key), "pii-bumped")
    ids = lambda e: F.when(e["kind"] == "name", F.array(family_id(title_class(e["lead"]), e["core"]), given_id(title_class(e["lead"]), e["core"]))).otherwise(F.array(number_id(e["kind"], e["core"])))
    hashed = F.filter("found", lambda e: e["kind"].isin("name", "card", "iban"))
    again = found.select("at", F.explode(F.array_distinct(F.flatten(F.transform(hashed, ids)))).alias("id")).join(bumped, "id").groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("id", "attempt"))).alias("again"))
    attempt = lambda i: F.coalesce(F.try_element_at(F.col("again"), i), F.lit(0))
    done = found.join(again, "at", "left").withColumn("new", F.transform("found", lambda e: surrogate(e, attempt, key)))
    # names that occur without a title: first a mark, then the surrogate, so that no surrogate is taken for a name
    named = F.filter(F.arrays_zip("found", "new"), lambda z: z["found"]["kind"] == "name")
    whole = F.transform(named, lambda z: F.struct(z["found"]["core"].alias("core"), z["new"].alias("new")))
    family = F.transform(named, lambda z: F.struct(F.substring_index(z["found"]["core"], " ", -1).alias("core"), F.substring_index(z["new"], " ", -1).alias("new")))
    known = F.array_distinct(F.concat(whole, family))
    known = F.array_sort(known, lambda a, b: F.length(b["core"]) - F.length(a["core"]))
    done = done.withColumn("known", F.transform(known, lambda k, i: F.struct(k["core"].alias("core"), k["new"].alias("new"), F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001")).alias("mark"))))
    alone = lambda core: F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_@.-])"), core, F.lit(r"(?![\p{L}\p{M}\p{N}_@'’-])"))
    marked = lambda g: F.aggregate("known", g, lambda t, k: F.regexp_replace(t, alone(k["core"]), k["mark"]))
    filled = lambda g: F.aggregate("known", marked(g), lambda t, k: F.replace(t, k["mark"], k["new"]))
    gaps = F.transform(F.split("text", PATTERN, -1), lambda g: F.when(F.size("known") > 0, filled(g)).otherwise(g))
    new = F.transform(F.arrays_zip("found", "new"), lambda z: F.concat(z["found"]["lead"], z["new"]))
    text = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    done = done.select("row", text.alias("new_text"), F.size("found").cast("long").alias("n"))
    swapped = {"text": F.col("new_text")} | ({"n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    changed = done.select(*(swapped.get(c, F.col("row")[c]).alias(c) for c in names), F.col("n").alias("n_entities"))
    return changed.unionByName(docs.where(~has).select(*names).withColumn("n_entities", F.lit(0).cast("long")))


def key_of(spark: SparkSession) -> str:
    """The key in the session's `hybridqa.pii.key`; where none is set, a random one that this session keeps to itself."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, found)
    return found


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
