"""Personal data: keyed surrogates for detected entities, DataFrame expressions only.

Detected are e-mail addresses, payment cards, phone numbers, IPv4 addresses,
social security numbers, IBANs, IPv6 addresses, access keys, assigned secrets
(``password=``, ``token = "..."``), long hexadecimal tokens, and names of persons:
a title, a given name and a surname, or a title or known given name and a
surname, which is taken whole with its particles, apostrophes and inner capitals.
Given names are known from a short list and learned from the corpus: a name that
stands between a title and a surname in at least ``NAME_DOCS`` different texts,
and in a share of ``NAME_SHARE`` of all texts that have it before a capitalised
word, is known everywhere, with the gender that most of its titles have; a
rarer one is known in the texts that have it with a title.  All texts
are counted.  An entity is its normalised form (digits of a number,
lower-case address, given name and surname on their own), so every mention of
it, in whatever format, gets the same surrogate.

A surrogate is derived from SHA-256 of a secret key, the type, the entity and
an attempt number, and keeps the type: cards keep network digit, grouping and a
valid check digit, IBANs country and check digits, phone numbers country code
and punctuation, secrets their alphabet and length, given names the gender,
all names the script and their capitals.  Drawn names are made of syllables, far
more of them than there are names to detect.

Distinctness is checked over the whole corpus: entities are counted once,
surrogates that several entities would share are drawn again by all but one of
them, and surrogates that are entities of the corpus, their own included, by all,
until none is left.
Attempts above 0 are rare; they are kept by document in a stored table, and the
learned names by text, which Spark broadcasts if their sizes allow and otherwise
joins by a shuffle.

Edge cases: null texts stay null, empty ones empty; documents without
entities are unchanged; repeated rows get equal results; a null doc_id is an id
of its own; very long texts are scanned whole; empty tables give empty results;
extra columns are ignored.  A capitalised word right after a title and a
surname counts as the surname ("Mr Smith Road").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Different texts that make a name known everywhere, and their share of the texts with the name before a capitalised word.
NAME_DOCS, NAME_SHARE = 3, 0.01

# Given names that are recognised from the start, by script and gender, titles, particles of surnames, and the syllables and endings of drawn names.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Paul Mark Peter Hans Karl Jean Pierre Luis Carlos Juan".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Anna Emma Laura Maria Julia Claire Sophie Carmen Lucia".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Борис".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера".split(),
}
TITLES = {"m": "Mr Herr Señor Monsieur господин".split(), "f": "Mrs Ms Miss Frau Señora Madame госпожа".split(), "any": "Dr Prof Professor Doctor".split()}
PARTICLES = "van von de del della der den di da dos la le du ten ter zu".split()
SYLLABLES = {"latin": "bar ben cor dal den far gar hol kel lan lin mar mor nel nor par ral ren sel ton".split(),
             "cyrillic": "бар бел вор гор дан зар кол лан лин мар мир ром рус сал тим тор".split()}
ENDINGS = {"latin": {"m": "er", "f": "er"}, "cyrillic": {"m": "ов", "f": "ова"}}
GIVEN_ENDINGS = {("latin", "m"): "o us ik ald ert".split(), ("latin", "f"): "a ia ina elle ise".split(), ("cyrillic", "m"): "ил ан ей ий".split(), ("cyrillic", "f"): "а ия ина ья".split()}

_KNOWN = [n for names in GIVEN.values() for n in names]


def _by_first(words: list[str]) -> str:
    """An alternation that fails at the first character of most other words."""
    firsts = dict.fromkeys(w[0] for w in words)
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in firsts)


_NAMES = _by_first([*_KNOWN, *(n.upper() for n in _KNOWN)])
_TITLES = _by_first([t for titles in TITLES.values() for t in titles])
_PARTICLES = "|".join(PARTICLES)
#: A capitalised name: O'Brien, McDonald, Jean-Luc, SMITH; with particles before it: van der Berg.
_CAPITALISED = r"\p{Lu}(?:['\u2019]\p{Lu})?\p{L}++(?:['\u2019-]\p{Lu}\p{L}++)*+"
_SURNAME = rf"(?:(?:{_PARTICLES}) ){{0,3}}+{_CAPITALISED}"
#: One pattern per type, tried in this order at each word begin.  Repetitions are bounded by the type's format, or open-ended and
#: possessive over one character class (secrets, hexadecimal tokens, surnames: taken whole at any length), so long texts stay linear.
PATTERNS = {
    "secret": r"(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{6,}+",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "access_key": r"A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "card": r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "hex": r"[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "ip6": r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![0-9A-Za-z:])",
    "name": rf"(?:{_TITLES})\.? (?:{_CAPITALISED} )?{_SURNAME}|(?:{_NAMES}) {_SURNAME}",
}
#: What a mention can be by its first character; types in the order of ``PATTERNS``.
STARTS = {r"[a-z]": ("secret", "email", "hex", "ip6"), r"\d": ("email", "ip", "ssn", "card", "phone", "hex", "ip6"), r"[(+]": ("phone",),
          r"\p{Lu}|г": ("email", "access_key", "iban", "ip6", "name")}
#: Nothing starts inside a word; the look-aheads let most positions fail at once.
_BEGIN_OF_WORD = r"(?<![\p{L}\p{N}_@])"
_MENTIONS = "|".join(f"(?={c})(?:{'|'.join(PATTERNS[t] for t in types)})" for c, types in STARTS.items())
ANY = f"{_BEGIN_OF_WORD}(?:{_MENTIONS})"
#: A title and a given name, and a capitalised word, each before a surname; the look-aheads let most positions fail at once.
_TITLED = rf"(?=[{''.join(sorted({t[0] for titles in TITLES.values() for t in titles}))}]){_BEGIN_OF_WORD}(?:{_TITLES})\.? {_CAPITALISED}(?= {_SURNAME})"
_BEFORE_SURNAME = rf"(?=\p{{Lu}}){_BEGIN_OF_WORD}{_CAPITALISED}(?= {_SURNAME})"
#: Characters that mark a mention's begin and end; texts that hold them are split the long way.
BEGIN, END = "\ue000", "\ue001"
MENTION = "struct<text:string,type:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _alternatives(words: list[str]) -> str:
    return "|".join(words)


def type_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _secret_prefix(mention: Column) -> Column:
    return F.regexp_extract(mention, r"^([A-Za-z_-]+[ \t]*[=:][ \t]*[\"']?)", 1)


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def _gender_of_title(mention: Column) -> Column:
    """m or f; null for a neutral title and without one."""
    return F.when(mention.rlike(rf"^(?:{_alternatives(TITLES['f'])})\b"), F.lit("f")).when(mention.rlike(rf"^(?:{_alternatives(TITLES['m'])})\b"), F.lit("m"))


def _gender(mention: Column, women: Column) -> Column:
    """Of the title, else of a known or learned given name; m where none tells."""
    names = GIVEN["latin", "f"] + GIVEN["cyrillic", "f"]
    female = _alternatives([*names, *(n.upper() for n in names)])
    listed = mention.rlike(rf"^(?:(?:{_TITLES})\.? )?(?:{female}) ")
    return F.coalesce(_gender_of_title(mention), F.when(listed | F.array_contains(women, F.lower(_given(mention))), F.lit("f")), F.lit("m"))


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^((?:{_TITLES})\.? )", 1)


def _bare(mention: Column) -> Column:
    """The name without its title."""
    return F.substring(mention, F.length(_title(mention)) + 1, F.length(mention))


def _given(mention: Column) -> Column:
    """The given name in a name; empty without one."""
    return F.regexp_extract(_bare(mention), rf"^({_NAMES}|{_CAPITALISED}) (?=\S)", 1)


def _surname(mention: Column) -> Column:
    """The surname with its particles."""
    given = _given(mention)
    return F.substring(_bare(mention), F.when(given != "", F.length(given) + 2).otherwise(F.lit(1)), F.length(mention))


def entities_of(mention: Column, kind: Column, women: Column) -> Column:
    """Array of (type, entity) that a mention holds: two for a full name, else one; ``women`` has the text's learned names of women."""
    def one(t: Column, e: Column) -> Column:
        return F.struct(t.alias("type"), e.alias("entity"))

    given = one(F.concat(F.lit("given_"), _gender(mention, women)), F.lower(_given(mention)))
    # a Slavic surname's masculine and feminine forms are one entity
    surname = one(F.lit("surname"), F.regexp_replace(F.lower(_surname(mention)), "(?<=\\p{IsCyrillic}(?:ов|ев|ин))а$", ""))
    names = F.when(_given(mention) != "", F.array(given, surname)).otherwise(F.array(surname))
    entity = (F.when(kind.isin("email", "ip6"), F.lower(mention)).when(kind.isin("card", "phone", "ssn"), _digits(mention))
              .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "secret", F.substring(mention, F.length(_secret_prefix(mention)) + 1, F.length(mention)))
              .otherwise(mention))
    return F.when(kind == "name", names).otherwise(F.array(one(kind, entity)))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th pseudo-random number from 0 to 255 (the digest has 64, repeating)."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str | list[str], v: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in chars]), v % len(chars) + 1)


def _chars(c: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(character, place)`` of each character, joined; linear in the length."""
    chars = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(chars, body), "")


def _same_shape(c: Column, digest: Column) -> Column:
    """Digits become digits, letters letters of the same case, the rest stays; an all-hexadecimal text stays hexadecimal."""
    return _let(c.rlike("^[0-9a-f]++$") & c.rlike("[a-f]"), lambda hexadecimal: _chars(
        c, lambda x, i: F.when(hexadecimal, _pick("0123456789abcdef", _byte(digest, i))).when(x.rlike("[0-9]"), (_byte(digest, i) % 10).cast("string"))
        .when(x.rlike("[a-z]"), F.char(_byte(digest, i) % 26 + 97)).when(x.rlike("[A-Z]"), F.char(_byte(digest, i) % 26 + 65)).otherwise(x)))


def _luhn(digits: Column) -> Column:
    """The check digit for a number without one."""
    n = F.length(digits)

    def doubled(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + doubled(i))
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN (98 minus the number modulo 97; letters count from 10)."""
    text = F.concat(rest, country, F.lit("00"))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(text, i, F.lit(1))
        return F.when(x.rlike("[0-9]"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)).cast("string"), 2, "0")


def _phone(c: Column, digest: Column, attempt: Column) -> Column:
    """Country code kept; area and exchange codes begin with 2 to 9; a 555 exchange stays one at first."""
    american = c.rlike("^1?[2-9]?[0-9]{9}$") & F.length(c).isin(10, 11)
    lead = F.length(c) - 10

    def digit(x: Column, i: Column) -> Column:
        at, v = i - lead, _byte(digest, i)
        fictional = (F.substring(c, lead + 4, F.lit(3)) == "555") & (attempt < 2)
        return (F.when(american & (at < 0), x).when(american & fictional & at.isin(3, 4, 5), x).when(american & at.isin(0, 3), (v % 8 + 2).cast("string"))
                .when(~american & (i < 2), x).otherwise((v % 10).cast("string")))

    return _chars(c, digit)


def _given_name(script: str, gender: str, digest: Column, attempt: Column) -> Column:
    """A drawn given name: syllables as of a surname, one less, and an ending of its gender."""
    places = F.sequence(F.lit(0), _byte(digest, F.lit(61)) % 2 + attempt)
    stem = F.array_join(F.transform(places, lambda i: _pick(SYLLABLES[script], _byte(digest, i + 8))), "")
    return F.initcap(F.concat(stem, _pick(GIVEN_ENDINGS[script, gender], _byte(digest, F.lit(62)))))


def _word(script: str, digest: Column, attempt: Column) -> Column:
    """A drawn surname: two or three syllables and one more for each further attempt."""
    places = F.sequence(F.lit(0), _byte(digest, F.lit(60)) % 2 + 1 + attempt)
    return F.initcap(F.array_join(F.transform(places, lambda i: _pick(SYLLABLES[script], _byte(digest, i))), ""))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, in normalised form."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string"))
    digest = F.concat(F.sha2(F.concat(seed, F.lit("\u00010")), 256), F.sha2(F.concat(seed, F.lit("\u00011")), 256))

    def made(d: Column) -> Column:
        domain = F.substring_index(entity, "@", -1)
        label = F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), domain), 256), 1, 10)
        email = F.concat(_same_shape(F.substring_index(entity, "@", 1), d), F.when(attempt > 1, attempt.cast("string")).otherwise(F.lit("")), F.lit("@m"), label, F.lit(".example.com"))
        card = _let(F.concat(F.substring(entity, 1, 1), F.substring(_same_shape(entity, d), F.lit(2), F.length(entity) - 2)), lambda x: F.concat(x, _luhn(x)))
        octets = [(_byte(d, F.lit(0)) % 223 + 1), *[_byte(d, F.lit(i)) for i in (1, 2, 3)]]
        iban = _let(_same_shape(F.substring(entity, F.lit(5), F.length(entity)), d), lambda x: F.concat(F.substring(entity, 1, 2), _iban_check(F.substring(entity, 1, 2), x), x))
        ssn = F.concat((_byte(d, F.lit(63)) % 8 + 1).cast("string"), F.substring(_same_shape(entity, d), F.lit(2), F.length(entity)))
        given = F.lit(None).cast("string")
        for script, gender in GIVEN:
            given = F.when((_script(entity) == script) & (kind == f"given_{gender}"), _given_name(script, gender, d, attempt)).otherwise(given)
        groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.hex(_byte(d, 2 * i) * 256 + _byte(d, 2 * i + 1)))), ":")
        surname = F.when(_script(entity) == "cyrillic", _word("cyrillic", d, attempt)).otherwise(_word("latin", d, attempt))
        return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", _phone(entity, d, attempt)).when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
                .when(kind == "ip6", F.concat(F.lit("2001:db8:"), groups)).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind.startswith("given"), given).when(kind == "surname", surname)
                .when(kind == "access_key", F.concat(F.substring(entity, 1, 4), F.substring(_same_shape(entity, d), F.lit(5), F.length(entity)))).otherwise(_same_shape(entity, d)))

    return _let(digest, made)


def _refill(mention: Column, text: Column, pattern: str) -> Column:
    """``mention`` with its characters of ``pattern`` replaced by those of ``text``, one after the other."""
    begin = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(mention, i, F.lit(1))
        return F.when(x.rlike(pattern), F.struct(F.concat(acc["s"], F.substring(text, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["s"], x).alias("s"), acc["k"].alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.length(mention)), begin, step)["s"]


def rendered(mention: Column, kind: Column, key: str, attempts: Column, women: Column) -> Column:
    """What replaces a mention: the surrogates of its entities, in its format."""
    def drawn(e: Column) -> Column:
        tried = F.coalesce(F.try_element_at(attempts, F.concat_ws("\u0001", e["type"], e["entity"])), F.lit(0))
        return surrogate(e["type"], e["entity"], tried, key)

    def formatted(s: Column) -> Column:
        ending = F.when(_script(mention) == "cyrillic", F.when(_gender(mention, women) == "f", F.lit(ENDINGS["cyrillic"]["f"])).otherwise(F.lit(ENDINGS["cyrillic"]["m"]))).otherwise(F.lit(ENDINGS["latin"]["m"]))
        name = F.concat(F.array_join(s, " "), ending)
        upper = _bare(mention).rlike(r"^[\p{Lu} '\u2019-]+$")
        return (F.when(kind.isin("card", "phone", "ssn"), _refill(mention, s[0], "[0-9]")).when(kind == "iban", _refill(mention, s[0], "[0-9A-Z]"))
                .when(kind == "secret", F.concat(_secret_prefix(mention), s[0])).when(kind == "name", F.concat(_title(mention), F.when(upper, F.upper(name)).otherwise(name))).otherwise(s[0]))

    return _let(F.transform(entities_of(mention, kind, women), drawn), formatted)


def _mention(text: Column) -> Column:
    return F.struct(text.alias("text"), type_of(text).alias("type"))


def mentions_of(text: Column, pattern: Column) -> Column:
    """All mentions in a text, in order, with their types."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), _mention)


# --- names ------------------------------------------------------------------------

def learned_names(docs: DataFrame, min_docs: int = NAME_DOCS, min_share: float = NAME_SHARE) -> DataFrame:
    """_text (hash of a text), _forms (learned given names in it, as written), _women (those of women, lower-case).

    Equal texts count once.  Names are joined as a table, so their number has no
    bound; a text's row holds the names of that text alone.
    """
    text = F.xxhash64("text").alias("_text")
    titled = docs.select(text, F.explode(F.regexp_extract_all("text", F.lit(_TITLED), F.lit(0))).alias("m"))
    titled = titled.select("_text", F.lower(_bare(F.col("m"))).alias("name"), _gender_of_title(F.col("m")).alias("gender"))
    titled = stored(titled.groupBy("_text", "name").agg(*(F.max((F.col("gender") == g).cast("int")).alias(g) for g in "fm")), "titled-names")
    names = titled.groupBy("name").agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("f"), F.lit(0)) > F.coalesce(F.sum("m"), F.lit(0))).alias("female"))
    names = stored(names, "names")
    forms = docs.select(text, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_BEFORE_SURNAME), F.lit(0)))).alias("form"))
    met = stored(forms.join(names, F.lower("form") == F.col("name")).select("_text", "form", "name", "female").distinct(), "names-met")
    seen = met.select("_text", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("seen"))
    everywhere = names.join(seen, "name").where((F.col("n") >= min_docs) & (F.col("n") >= min_share * F.col("seen"))).select("name", F.lit(True).alias("_everywhere"))
    here = titled.select("_text", "name", F.lit(True).alias("_here"))
    taken = met.join(everywhere, "name", "left").join(here, ["_text", "name"], "left").where("_everywhere or _here")
    return stored(taken.groupBy("_text").agg(F.array_sort(F.collect_set("form")).alias("_forms"), F.collect_set(F.when(F.col("female"), F.col("name"))).alias("_women")), "names-by-text")


def attempts_needed(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, attempt) of the entities whose first surrogate is not theirs alone; ``entities`` has distinct (type, entity)."""
    given = stored(entities.withColumn("attempt", F.lit(0)), "entities")
    kind = F.regexp_replace("type", "^given_.$", "given")
    while True:
        drawn = given.withColumn("made", F.lower(surrogate(F.col("type"), F.col("entity"), F.col("attempt"), key)))
        # the first by entity keeps a surrogate; min is combined before the shuffle
        keeper = drawn.groupBy(kind.alias("_k"), F.col("made").alias("_m")).agg(F.min("entity").alias("keeper"), F.count(F.lit(1)).alias("n"))
        real = given.select(kind.alias("_rk"), F.lower("entity").alias("_re")).distinct()
        checked = (drawn.join(keeper, (kind == F.col("_k")) & (F.col("made") == F.col("_m")))
                   .join(real, (kind == F.col("_rk")) & (F.col("made") == F.col("_re")), "left"))
        again = (F.col("n") > 1) & (F.col("entity") != F.col("keeper")) | F.col("_re").isNotNull()
        checked = stored(checked.select("type", "entity", "attempt", again.alias("again")), "entities")
        if not checked.where("again").limit(1).count():
            return checked.where("attempt > 0").select("type", "entity", "attempt")
        given = stored(checked.select("type", "entity", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "entities")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_mentions, types (sorted) of every document; ``docs`` has doc_id and text."""
    names = learned_names(docs)
    named = docs.select("doc_id", "text").join(names, F.xxhash64("text") == F.col("_text"), "left")
    learned = F.concat(F.lit(f"{_BEGIN_OF_WORD}(?:{_MENTIONS}|(?:"), F.array_join("_forms", "|"), F.lit(f") {_SURNAME})"))
    pattern = F.coalesce(learned, F.lit(ANY))
    women = F.coalesce("_women", F.array().cast("array<string>"))
    # one scan a pass: mentions are marked, and the marked text is split
    marked = F.regexp_replace("text", pattern, F.lit(f"{BEGIN}$0{END}"))
    plain = F.col("text").rlike(f"[{BEGIN}{END}]")
    found = named.select("doc_id", "text", women.alias("_women"), pattern.alias("_pattern"), F.when(~plain, F.split(marked, f"[{BEGIN}{END}]", -1)).alias("_pieces"))
    numbered = F.sequence(F.lit(0), F.size("_pieces") - 1)
    gaps = F.transform(F.filter(numbered, lambda i: i % 2 == 0), lambda i: F.col("_pieces")[i])
    between = F.transform(F.filter(numbered, lambda i: i % 2 == 1), lambda i: _mention(F.col("_pieces")[i]))
    # the pieces are used several times: a generator keeps them from being computed again for each
    found = found.select("doc_id", "text", "_women", "_pattern", F.explode(F.array("_pieces")).alias("_pieces"))
    found = found.select("doc_id", "text", "_women", F.when(F.col("_pieces").isNull(), F.split("text", F.col("_pattern"), -1)).otherwise(gaps).alias("_gaps"),
                         F.when(F.col("_pieces").isNull(), mentions_of(F.col("text"), F.col("_pattern"))).otherwise(between).alias("_found"))
    held = (found.where(F.size("_found") > 0).select("doc_id", "_women", F.explode("_found").alias("m"))
            .select("doc_id", F.explode(entities_of(F.col("m.text"), F.col("m.type"), F.col("_women"))).alias("e")))
    held = stored(held.select("doc_id", "e.type", "e.entity").distinct(), "mentions")
    again = attempts_needed(held.select("type", "entity").distinct(), key)
    entry = F.struct(F.concat_ws("\u0001", held["type"], held["entity"]), F.col("attempt"))
    by_doc = stored(held.join(again.select(F.col("type").alias("_t"), F.col("entity").alias("_e"), "attempt"), (F.col("type") == F.col("_t")) & (F.col("entity") == F.col("_e")))
                    .groupBy(F.col("doc_id").alias("_id")).agg(F.map_from_entries(F.collect_list(entry)).alias("_attempts")), "attempts")
    found = found.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    attempts = F.coalesce("_attempts", F.create_map().cast("map<string,int>"))
    parts = F.zip_with("_gaps", "_found", lambda g, m: F.concat(g, F.coalesce(F.when(m.isNotNull(), rendered(m["text"], m["type"], key, attempts, F.col("_women"))), F.lit(""))))
    text = F.when(F.size("_found") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), F.size("_found").alias("n_mentions"), F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["type"]))).alias("types"))
