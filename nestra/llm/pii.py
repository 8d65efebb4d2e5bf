"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities get replacements of their own type and format: an e-mail address becomes one with letters for
letters and digits for digits under a reserved domain; telephone numbers keep their grouping and country code, card
numbers their grouping and check digit, accounts their country and grouping, with check digits that hold; an IPv4
address stays one; hexadecimal and prefixed secrets keep length and alphabet; names (after a title, or a common given
name with a family name) keep title, script, case and the gender that title or given name tells. What looks like an
account or card number but fails its check is no entity.

A surrogate is a function of a secret key, the type, the entity's canonical form (case, spacing and punctuation
do not matter) and an attempt number, so the same entity has the same surrogate wherever it stands, and no table
is needed to apply it. Distinctness is then checked: the canonical entities of the corpus are grouped by their
surrogates, and whichever share one, or hit a real entity, take the next attempt, until none do. From attempt
``WIDER`` on each attempt draws one more letter or digit than the last (addresses become longer ones), so the space
outgrows any set of entities and the search ends. Only documents with such an entity are joined with its attempt.

The patterns run once: cheap tests pick the texts that may have an entity, these are taken apart, and the table of
documents and pieces is written; everything else reads it.

Cases: null and empty texts stay as they are, as do texts without entities. Repeated rows are treated alike.
All columns are kept; ``n_chars``, if there, follows the text. The count of replaced entities is the last column,
``pii`` or, if the documents have that, the first of pii_2, pii_3, ... that is free. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, release, small, stored

KEY = "surrogates-1"
#: Attempts from this one on draw from larger and larger spaces.
WIDER = 3
# Private-use code points that mark entities while a text is taken apart.
_MARK, _ESCAPE = "\ue000", "\ue001"

# Titles by gender; Latin, Cyrillic and Greek ones.
_TITLES = {
    "f": "Mrs|MRS|Ms|MS|Miss|MISS|Madam|Frau|Señora|Señorita|Sra|Doña|Madame|Mademoiselle|Mme|Mlle|Signora|Госпожа|госпожа|Κυρία|κυρία",
    "m": "Mr|MR|Mister|Sir|Herrn?|Señor|Sr|Don|Monsieur|Signor|Господин|господин|Κύριος|κύριος",
    "n": "Dr|DR|Prof|Professor|Mx|Доктор|Профессор|Δρ",
}
_ALL_TITLES = "|".join(_TITLES.values())
# Common given names by gender, which with a capitalised word after them are a name without a title.
_GIVEN = {
    "f": "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Emma|Anna|Laura|Julia|Sophie|Katharina|Ursula|Monika|Claire|Camille|Isabelle|María|Carmen|Lucía|Giulia|Chiara|Анна|Мария|Елена|Ольга|Μαρία|Ελένη",
    "m": "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Matthew|Andrew|Peter|Paul|Hans|Klaus|Wolfgang|Stefan|Pierre|Jean|François|José|Juan|Carlos|Miguel|Giovanni|Luca|Иван|Алексей|Сергей|Дмитрий|Γιώργος|Νίκος",
}
_ALL_GIVEN = "|".join(_GIVEN.values())
_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’-]*[\p{L}\p{M}]"
# titles and given names begin with one of these letters: everywhere else the alternatives are not tried
_BEGINS = "".join(sorted({w[0] for w in (_ALL_TITLES + "|" + _ALL_GIVEN).split("|")}))
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?=[{_BEGINS}])(?:(?:{_ALL_TITLES})\.? (?:(?:\p{{Lu}}\.|{_CAPITAL}) ){{0,2}}|(?:{_ALL_GIVEN}) (?:\p{{Lu}}\. )?){_CAPITAL}(?!\p{{L}})"
# What entities of each type look like, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9.A-Za-z])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|(?=(?:[^0-9]{0,2}[0-9]){9,12}(?![0-9]))\(?0[0-9]{2,4}\)?[ /-]{1,2}[0-9]{3,8}(?:[ -][0-9]{2,8}){0,2})(?![0-9A-Za-z]|\.[0-9])",
    "name": _NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NOT_EMAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")
# what any entity but an address with an at sign has: two digits near one another, a long hexadecimal run, a secret's
# prefix, or a title or given name before a capital
_HINTS = (
    r"[0-9][^\p{L}]{0,3}[0-9]",
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{32}",
    r"AKIA|gh[pousr]_|[spr]k_(?:live|test)_|xox[abprs]-",
    rf"(?<![\p{{L}}\p{{N}}])(?=[{_BEGINS}])(?:(?:{_ALL_TITLES})\.?|{_ALL_GIVEN}) \p{{Lu}}",
)

# Country codes of one and of two digits; all others have three. None is the start of another.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

# Syllables of made-up names by script, and endings by gender.
_SYLLABLES = {
    "Latin": "ba be bo da de di do fa fe ga ka ke ki la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se ta te ti va ve vi".split(),
    "Cyrillic": "ба бе бо ва ве ви да де до ка ке ки ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти фа".split(),
    "Greek": "βα βε βο γα γε δα δε δο κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα ρα ρε ρι ρο σα σε τα τε τι φα".split(),
    "Armenian": "բա բե գա գե դա դե կա կե կի լա լե լի մա մե մի նա նե նի պա րա րե րի սա սե տա տե տի".split(),
}
_ENDINGS = {
    "Latin": {"f": "na", "m": "ron", "n": "lis"},
    "Cyrillic": {"f": "на", "m": "рон", "n": "лис"},
    "Greek": {"f": "να", "m": "ρος", "n": "λις"},
    "Armenian": {"f": "նե", "m": "րոն", "n": "լիս"},
}
_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. A plain column would be worked out at every use, which within
    a loop over characters is at every character."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


# --- checks


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check over an array of digits, modulo 10: 0 if valid."""
    n = F.size(digits)
    doubled = lambda d, i: F.when((n - 1 - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, x: a + x) % 10


def _digits(c: Column) -> Column:
    return F.transform(_characters(F.regexp_replace(c, "[^0-9]", "")), lambda d: d.cast("int"))


def mod97(c: Column) -> Column:
    """Letters and digits as one number (A is 10), modulo 97."""
    step = lambda a, x: F.when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(_characters(c), F.lit(0), step)


def _turned(iban: Column) -> Column:
    """Country and check digits behind the account."""
    return F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))


# --- types and canonical forms


def kind(entity: Column) -> Column:
    """The first type whose pattern the whole entity matches; null if it fails the type's check."""
    out = F.lit("name")
    for name, pattern in list(PATTERNS.items())[-2::-1]:
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    bare = F.replace(entity, F.lit(" "), F.lit(""))
    return _let(out, lambda k: F.when((k == "iban") & (mod97(_turned(bare)) != 1), F.lit(None)).when((k == "card") & (luhn(_digits(entity)) != 0), F.lit(None)).otherwise(k))


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions one entity: lower case for addresses, the bare characters for numbers (with the
    plus sign of an international telephone number), and the family name (the last word, lower case) for names."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "name", F.lower(F.regexp_extract(entity, r"([^ ]+)$", 1)))
        .when(kind == "phone", F.regexp_replace(entity, r"(?!^\+)[^0-9]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "given", F.lower(entity))
        .otherwise(entity)
    )


def _gender(words: Column) -> Column:
    """Of a name's words: what the title says, else what the given name says, else n."""
    title = F.replace(F.get(words, F.lit(0)), F.lit("."), F.lit(""))
    said = F.when(title.rlike(f"^(?:{_TITLES['f']}|{_GIVEN['f']})$"), "f").when(title.rlike(f"^(?:{_TITLES['m']}|{_GIVEN['m']})$"), "m")
    second = F.get(words, F.lit(1))
    return F.coalesce(said, F.when(F.size(words) > 2, F.when(second.rlike(f"^(?:{_GIVEN['f']})$"), "f").when(second.rlike(f"^(?:{_GIVEN['m']})$"), "m")), F.lit("n"))


def _titled(words: Column) -> Column:
    return F.get(words, F.lit(0)).rlike(rf"^(?:{_ALL_TITLES})\.?$")


def _given(words: Column) -> Column:
    """The given names and initials of a name as entities of kind given: gender, colon, word."""
    begin = F.when(_titled(words), 2).otherwise(1)
    return F.transform(F.slice(words, begin, F.greatest(F.size(words) - begin, F.lit(0))), lambda w: F.concat(_gender(words), F.lit(":"), w))


# --- drawing


def _stream(key: str, *parts: Column) -> Column:
    """256 keyed hexadecimal digits."""
    seed = F.concat_ws(":", F.lit(key), *parts)
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f":{i}")), 256) for i in range(4)))


def _drawn(stream: Column, i: Column, below: int | Column) -> Column:
    """The i-th number below ``below``, of four digits of the stream."""
    return (F.conv(F.substring(stream, (i * 4 % 252 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _pick(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), i + 1, F.lit(1))


def _like(entity: Column, stream: Column, kept: Column, attempt: Column, hexadecimal: Column) -> Column:
    """Letters and digits drawn anew after the first ``kept`` of them; everything else stays in its place. Late
    attempts have more characters."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(a: Column, c: Column) -> Column:
        i = a["k"]
        new = F.when(c.between("0", "9"), _pick(_DIGITS, _drawn(stream, i, 10))).when(c.between("a", "z"), _pick(_LOWER, _drawn(stream, i, 26))).when(c.between("A", "Z"), _pick(_UPPER, _drawn(stream, i, 26)))
        digit = _pick(_HEX, _drawn(stream, i, 16))
        new = F.when(hexadecimal & c.rlike("[0-9a-z]"), digit).when(hexadecimal, F.upper(digit)).otherwise(new)
        counted = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(a["s"], F.when(counted & (i >= kept), new).otherwise(c)).alias("s"), F.when(counted, i + 1).otherwise(i).alias("k"))

    wider = F.concat(entity, F.repeat(F.lit("0"), F.greatest(F.lit(0), attempt - (WIDER - 1))))
    return F.aggregate(_characters(wider), start, step, lambda a: a["s"])


def _syllabic(key: str, what: str, word: Column, gender: Column, attempt: Column, ending: bool) -> Column:
    """A made-up word in the script of ``word``; later attempts are longer, so there is always another one. A script
    without a table of syllables draws from the word's own letters."""

    def chosen(x: Column) -> Column:
        seed = _stream(key, F.lit(what), x["g"], F.lower(x["w"]), x["n"].cast("string"))
        table = _characters(F.regexp_replace(F.lower(x["w"]), r"[^\p{L}\p{M}]", ""))
        ends = F.array(F.lit(""), F.lit(""), F.lit(""))
        for script, syllables in _SYLLABLES.items():
            written = x["w"].rlike(rf"^\p{{Is{script}}}")
            table = F.when(written, F.array(*map(F.lit, syllables))).otherwise(table)
            ends = F.when(written, F.array(*(F.lit(_ENDINGS[script][g]) for g in "fmn"))).otherwise(ends)
        end = F.element_at(ends, F.when(x["g"] == "f", 1).when(x["g"] == "m", 2).otherwise(3)) if ending else F.lit("")
        return _let(F.struct(seed.alias("s"), table.alias("t"), x["n"].alias("n"), x["w"].alias("w"), end.alias("e")), made)

    def made(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), x["n"] + (1 if ending else 2)), lambda i: F.get(x["t"], _drawn(x["s"], i, F.greatest(F.size(x["t"]), F.lit(1)))))
        drawn = F.initcap(F.concat(F.array_join(parts, ""), x["e"]))
        return F.when((x["w"] == F.upper(x["w"])) & (F.length(x["w"]) > 1), F.upper(drawn)).otherwise(drawn)

    return _let(F.struct(word.alias("w"), (gender if ending else F.lit("")).alias("g"), attempt.alias("n")), chosen)


def _given_made(key: str, word: Column, gender: Column, attempt: Column) -> Column:
    """A given name, or the initial of one."""

    def of(x: Column) -> Column:
        made = _syllabic(key, "given", F.replace(x["w"], F.lit("."), F.lit("")), x["g"], x["n"], True)
        return _let(made, lambda m: F.when(x["w"].rlike(r"^\p{Lu}\.$"), F.concat(F.upper(F.substring(m, 1, 1)), F.lit("."))).otherwise(m))

    return _let(F.struct(word.alias("w"), gender.alias("g"), attempt.alias("n")), of)


def surrogate(entity: Column, kind: Column, attempt_of, key: str = KEY) -> Column:
    """The replacement of one entity. ``attempt_of`` gives the attempt of (kind, canonical form)."""

    def of(x: Column) -> Column:
        return _let(F.struct(x["e"].alias("e"), x["k"].alias("k"), canonical(x["k"], x["e"]).alias("o")), tried)

    def tried(x: Column) -> Column:
        return _let(F.struct(x["e"].alias("e"), x["k"].alias("k"), x["o"].alias("o"), attempt_of(x["k"], x["o"]).alias("a")), drawn)

    def drawn(x: Column) -> Column:
        seeded = F.struct(x["e"].alias("e"), x["k"].alias("k"), x["a"].alias("a"), _stream(key, x["k"], x["o"], x["a"].cast("string")).alias("s"))
        return _let(seeded, lambda y: _made(y["e"], y["k"], y["a"], y["s"], attempt_of, key))

    return _let(F.struct(entity.alias("e"), kind.alias("k")), of)


def _made(entity: Column, k: Column, attempt: Column, stream: Column, attempt_of, key: str) -> Column:
    # what stays: a secret's prefix, an account's country and place of check digits, and of a telephone number's digits
    # alone (their grouping differs between mentions) the country code or the leading zero
    prefix = F.length(F.regexp_extract(F.regexp_replace(entity, "[^A-Za-z0-9]", ""), "^(AKIA|gh[pousr]|[spr]k(?:live|test)|xox[abprs])", 1))
    country = F.length(F.regexp_extract(F.regexp_replace(entity, "[^0-9]", ""), _COUNTRY, 0))
    number = F.when(entity.startswith("+"), country).when(entity.rlike(r"^\(?0"), 1).otherwise(0)
    kept = F.when(k == "secret", prefix).when(k == "iban", 4).when(k == "phone", number).otherwise(0)
    drawn = F.when(k == "email", F.regexp_extract(entity, r"^([^@]+)@", 1)).otherwise(entity)
    like = _like(drawn, stream, kept, attempt, (k == "secret") & entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    # domains become a made-up one under their own top level of example names
    domain = F.concat(*(_pick(_LOWER, _drawn(stream, F.lit(50 + i), 26)) for i in range(6)))
    top = F.when(entity.rlike(r"(?i)\.(org|net)$"), F.lower(F.regexp_extract(entity, r"([A-Za-z]+)$", 1))).otherwise("com")
    ip4 = F.concat_ws(".", *((_drawn(stream, F.lit(i), 254) + 1).cast("string") for i in range(4)))
    ip6 = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(stream, 1 + 4 * i, 4)) for i in range(6)))
    name = _let(F.split(entity, " "), lambda words: _name_made(key, words, attempt, attempt_of))
    given = F.concat(F.substring(entity, 1, 2), _given_made(key, F.substring(entity, F.lit(3), F.length(entity)), F.substring(entity, 1, 1), attempt))
    changed = _let(like, lambda x: F.when(k == "iban", _checked_iban(x)).when(k == "card", _checked_card(x)).when(k == "email", F.concat(x, F.lit("@"), domain, F.lit(".example."), top)).otherwise(x))
    return F.when(k == "ip", F.when(attempt < WIDER, ip4).otherwise(ip6)).when(k == "name", name).when(k == "given", given).otherwise(changed)


def _name_made(key: str, words: Column, attempt: Column, attempt_of) -> Column:
    def of(x: Column) -> Column:
        family = _syllabic(key, "family", F.element_at(x["w"], -1), F.lit("n"), attempt, False)
        begin = F.when(x["t"], 2).otherwise(1)
        given = F.transform(F.slice(x["w"], begin, F.greatest(F.size(x["w"]) - begin, F.lit(0))), lambda w: _given_made(key, w, x["g"], attempt_of(F.lit("given"), F.lower(F.concat(x["g"], F.lit(":"), w)))))
        title = F.when(x["t"], F.slice(x["w"], 1, 1)).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(title, given, F.array(family)), " ")

    return _let(F.struct(words.alias("w"), _gender(words).alias("g"), _titled(words).alias("t")), of)


def _checked_card(made: Column) -> Column:
    """``made`` with a last digit that passes the Luhn check."""
    head = F.substring(made, F.lit(1), F.length(made) - 1)
    return F.concat(head, ((10 - luhn(F.concat(_digits(head), F.array(F.lit(0))))) % 10).cast("string"))


def _checked_iban(made: Column) -> Column:
    """``made`` with the check digits that its account needs."""
    bare = F.replace(made, F.lit(" "), F.lit(""))
    account, country = F.substring(bare, F.lit(5), F.length(bare)), F.substring(made, 1, 2)
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, F.substring(made, F.lit(5), F.length(made)))


# --- texts


def _unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_ESCAPE + "0"), F.lit(_MARK)), F.lit(_ESCAPE + "1"), F.lit(_ESCAPE))


def hinted(text: Column) -> Column:
    """True for every text in which ANY finds something, and few others."""
    out = text.contains("@")
    for hint in _HINTS:
        out = out | text.rlike(hint)
    return F.coalesce(out, F.lit(False))


def _pieces(text: Column) -> Column:
    """The text taken apart: (t, k) with the type of an entity, null for what stands between; null without any."""
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "1")), F.lit(_MARK), F.lit(_ESCAPE + "0"))
    marked = F.when(text.contains("@"), F.regexp_replace(safe, f"(?:{ANY})", f"{_MARK}$0{_MARK}")).otherwise(F.regexp_replace(safe, f"(?:{_NOT_EMAIL})", f"{_MARK}$0{_MARK}"))
    typed = F.transform(F.split(marked, _MARK, -1), lambda p, i: F.struct(p.alias("t"), F.when(i % 2 == 1, kind(p)).alias("k")))
    return F.when(hinted(text), _let(typed, lambda ps: F.when(F.exists(ps, lambda p: p["k"].isNotNull()), ps)))


def entities(taken_apart: DataFrame, pieces: str, *keys: str) -> DataFrame:
    """One row per mention: ``keys``, kind, own (its canonical form), entity. Given names are entities of their own."""
    mention = F.explode(F.filter(F.col(pieces), lambda p: p["k"].isNotNull()))
    found = taken_apart.where(F.col(pieces).isNotNull()).select(*keys, mention.alias("_p")).select(*keys, F.col("_p.t").alias("t"), F.col("_p.k").alias("k"))
    given = F.when(F.col("k") == "name", F.transform(_given(F.split("t", " ")), lambda w: F.struct(F.lit("given").alias("kind"), w.alias("entity")))).otherwise(F.array().cast("array<struct<kind:string,entity:string>>"))
    both = found.select(*keys, F.explode(F.concat(F.array(F.struct(F.col("k").alias("kind"), F.col("t").alias("entity"))), given)).alias("_m"))
    return both.select(*keys, "_m.kind", canonical(F.col("_m.kind"), F.col("_m.entity")).alias("own"), F.col("_m.entity").alias("entity"))


def attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, own, attempt) of the entities whose attempt is not 0: those whose surrogate is another's or is real."""
    own = stored(found.groupBy("kind", "own").agg(F.min("entity").alias("entity")))
    real = own.select("kind", F.col("own").alias("made"))

    def tried(rows: DataFrame) -> DataFrame:
        made = surrogate(F.col("entity"), F.col("kind"), lambda k, o: F.col("attempt"), key)
        # initials have few letters: they need not be distinct
        told = ~((F.col("kind") == "given") & F.col("entity").rlike(r"\.$"))
        return rows.withColumn("made", F.when(told, canonical(F.col("kind"), made)))

    held = stored(tried(own.withColumn("attempt", F.lit(0))))
    while True:
        # the smallest of those that share a surrogate keeps it, unless it is a real entity's
        shared = held.where("made is not null").groupBy("kind", "made").agg(F.min("own").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = held.join(shared, ["kind", "made"]).where("own <> keeps").select("kind", "own")
        clash = stored(clash.union(held.join(real, ["kind", "made"], "left_semi").select("kind", "own")).distinct())
        if not clash.limit(1).count():
            break
        few = small(clash.withColumn("again", F.lit(1)))
        moved = held.join(few, ["kind", "own"], "left")
        # surrogates are drawn for those that move only
        stay = moved.where("again is null").select("kind", "own", "entity", "attempt", "made")
        moved = tried(moved.where("again is not null").select("kind", "own", "entity", (F.col("attempt") + 1).alias("attempt")))
        again = stored(stay.unionByName(moved))
        release(held)
        release(clash)
        held = again
    return held.where("attempt > 0").select("kind", "own", "attempt")


def replace(documents: DataFrame, key: str = KEY) -> DataFrame:
    """``documents`` with every entity replaced, and a last column ``pii`` (entities replaced in the row)."""
    count, pieces, row, taken, new = free_names(documents.columns, "pii", "pieces", "row", "taken", "new")
    apart = stored(documents.withColumn(pieces, _pieces(F.col("text"))).withColumn(row, F.monotonically_increasing_id()))
    later = stored(attempts(entities(apart, pieces), key))
    rows = apart.withColumn(taken, F.lit(None).cast("map<string,int>"))
    if later.limit(1).count():
        touched = entities(apart, pieces, row).select(row, "kind", "own").distinct().join(small(later), ["kind", "own"]).groupBy(row)
        touched = touched.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "own"), "attempt"))).alias(taken))
        rows = apart.join(small(stored(touched)), row, "left")
    attempt_of = lambda k, own: F.when(F.col(taken).isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(F.col(taken), F.concat_ws(":", k, own)), F.lit(0)))
    put = F.array_join(F.transform(pieces, lambda p: F.when(p["k"].isNull(), p["t"]).otherwise(surrogate(p["t"], p["k"], attempt_of, key))), "")
    rows = rows.withColumn(new, F.when(F.col(pieces).isNotNull(), _unescaped(put)))
    replaced = F.size(F.filter(F.col(pieces), lambda p: p["k"].isNotNull()))
    changed = {"text": F.coalesce(new, "text"), count: F.when(F.col(pieces).isNull(), F.lit(0)).otherwise(replaced).cast("long")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col(new).isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(documents.schema["n_chars"].dataType))
    return rows.withColumns(changed).select(*documents.columns, count)
