"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Entities are found by patterns.  An entity is its kind and its canonical value (the
digits of a number, a lower-case address), so every mention of it in the corpus gets
the same surrogate, shown in the format of the mention.  Surrogates come from a keyed
hash; the table of all distinct entities is checked for two entities with one
surrogate and for surrogates that are themselves found in the corpus, and those are
drawn again until none is left.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.plans.layout import cut

# Countries by the length of their account numbers (IBAN registry).
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The length of its country, else 15 to 34 characters; solid or in groups of four and a shorter last one.

    Behind a blank a last group of an unknown length has a digit, so a word after the number is not taken.
    """
    group, end = "(?: ?[A-Z0-9]{4})", "(?![A-Za-z0-9])"
    known = "|".join(
        f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{group}{{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + end
        for n, codes in _IBAN_LENGTHS.items()
    )

    def last(most: int) -> str:
        return f"(?: (?=[A-Z]{{0,{most - 1}}}[0-9])[A-Z0-9]{{1,{most}}}|[A-Z0-9]{{1,{most}}})?{end}"

    more = f"{group}{{7}}{last(2)}|{group}{{3,6}}{last(3)}|{group}{{2}} ?[A-Z0-9]{{3}}{end}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:{more}))"


# Part of a host name; all its repetitions are possessive, which the engine runs as loops, not by recursion.
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
# Patterns of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@{_LABEL}(?:\.{_LABEL})++",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "iban": _iban(),
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "name": (
        r"(?<!\p{L})(?:Mrs|Mr|Ms|Frau|Herr|Madame|Monsieur|Señora|Señor|Госпожа|Господин)\.? "
        r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
    ),
}
# Every entity has one of these, and few texts without an entity do.
_SIGN, _TITLES = "[0-9@]", ["Mr", "Ms", "Frau", "Herr", "Madame", "Monsieur", "Señor", "Госпо"]
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = r"^(\p{L}+\.?) "
# Forms of address of women, and names to choose from by gender and script.
_FEMALE = ["Mrs", "Ms", "Frau", "Madame", "Señora", "Госпожа"]
_GIVEN = {
    ("female", "latin"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hedda", "Ida", "Julia", "Klara", "Lena", "Mara", "Nora", "Olga", "Paula"],
    ("male", "latin"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Igor", "Jonas", "Karl", "Leon", "Max", "Nils", "Oskar", "Paul"],
    ("female", "cyrillic"): ["Алла", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
}
_SYLLABLES = {
    "latin": ["ba", "do", "fe", "gi", "ka", "lo", "me", "ni", "pa", "ro", "se", "ti", "va", "wo", "ze", "lu"],
    "cyrillic": ["ба", "до", "фе", "ги", "ка", "ло", "ме", "ни", "па", "ро", "се", "ти", "ва", "во", "зе", "лу"],
}


# Draws from which a surrogate may start with any digit, be an entity of the corpus, and be another one's too.
_ANY_START, _MAY_BE_REAL, _MAY_SHARE = 3, 6, 10


def kind_of(mention: Column) -> Column:
    """Kind of a mention: the first pattern that takes all of it."""
    chosen = None
    for kind, pattern in PATTERNS.items():
        fits = mention.rlike(f"^(?:{pattern})$")
        chosen = F.when(fits, F.lit(kind)) if chosen is None else chosen.when(fits, F.lit(kind))
    return chosen.otherwise(F.lit("card"))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "name", F.regexp_replace(mention, r"\.", ""))
        .when(kind == "ip", mention)
        .otherwise(F.lower(mention))
    )


def _stream(key: str, salt: str, *parts: Column) -> Column:
    """128 hexadecimal digits from the key and the entity."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(salt), *(p.cast("string") for p in parts)), 512)


def _digits(hexadecimal: Column) -> Column:
    """Decimal digits of a stream; letters give digits of their own."""
    return F.translate(hexadecimal, "abcdef", "072583")


def _number(hexadecimal: Column, place: int) -> Column:
    """A number below 65536 from four places of a stream."""
    return F.conv(F.substring(hexadecimal, 4 * place + 1, 4), 16, 10).cast("int")


def _like(value: Column, digits: Column, letters: Column) -> Column:
    """``value`` with every letter and digit replaced by one of its own class."""

    def one(here: Column, k: Column) -> Column:
        at = (k % 128) + 1
        letter = F.substring(letters, at, F.lit(1))
        return (
            F.when(here.between("0", "9"), F.substring(digits, at, F.lit(1)))
            .when(here.between("a", "z"), letter)
            .when(here.between("A", "Z"), F.upper(letter))
            .otherwise(here)
        )

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), "")


def _passes_check(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled, divisible by 10."""

    def counted(k: Column) -> Column:
        digit = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(k % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), counted), F.lit(0), lambda a, x: a + x) % 10 == 0


def _name(value: Column, stream: Column, attempt: Column) -> Column:
    """A name for the same form of address, gender, script and number of parts.

    Family names grow with the draws, so many names do not run out.
    """
    title = F.regexp_extract(value, _TITLE, 1)
    gender = F.when(title.isin(*_FEMALE), "female").otherwise("male")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    family = None
    given = None
    for (g, s), names in _GIVEN.items():
        parts = F.array(*map(F.lit, _SYLLABLES[s]))
        syllables = [F.get(parts, _number(stream, k) % 16) for k in range(4)]
        first = F.get(F.array(*map(F.lit, names)), _number(stream, 5) % len(names))
        fits = (gender == g) & (script == s)
        given = F.when(fits, first) if given is None else given.when(fits, first)
        more = F.concat(*(F.get(parts, _number(stream, k) % 16) for k in (6, 7, 8, 9)))
        last = F.initcap(F.concat(*syllables, F.when(attempt >= 2, more).otherwise("")))
        family = F.when(fits, last) if family is None else family.when(fits, last)
    both = F.size(F.split(value, " ")) > 2
    return F.concat_ws(" ", title, F.when(both, given), family)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """Surrogate of an entity's canonical value at a draw."""
    stream = _stream(key, "surrogate", kind, value, attempt)
    digits = _digits(stream)
    letters = F.translate(_stream(key, "letters", kind, value, attempt), "0123456789abcdef", "bcdfghjklmnpqrstv")
    # The first digit of a number stays at first, so lengths and issuers stay valid; a number with a check digit gets one.
    opening = F.when(attempt < _ANY_START, F.substring(value, 1, 1)).otherwise(F.substring(digits, 128, 1))
    number = F.concat(opening, F.substring(digits, F.lit(1), F.length(value) - 1))
    body = F.substring(number, F.lit(1), F.length(value) - 1)
    checked = [F.concat(body, F.lit(str(d))) for d in range(10)]
    card = F.when(_passes_check(value), F.get(F.filter(F.array(*checked), _passes_check), F.lit(0))).otherwise(number)
    octets = F.concat_ws(".", *((_number(stream, k) % 254 + 1).cast("string") for k in range(4)))
    at = F.instr(value, "@")
    ending = F.regexp_extract(value, r"(\.[a-z0-9-]+)$", 1)
    local = F.substring(value, F.lit(1), F.length(value) - F.length(ending))
    hexadecimal = F.substring(F.concat(stream, stream), F.lit(1), F.length(value))
    return (
        F.when(kind == "email", F.when(at > 0, F.concat(_like(local, digits, letters), ending)))
        .when(kind == "secret", hexadecimal)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), number)
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), _like(F.substring(value, F.lit(3), F.length(value)), digits, letters)))
        .otherwise(_name(value, stream, attempt))
    )


def shown_as(kind: Column, mention: Column, value: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its case."""

    def digit(k: Column) -> Column:
        here = F.substring(mention, k, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), k), "[^0-9]", ""))
        return F.when(here.rlike("[0-9]"), F.substring(value, before, F.lit(1))).otherwise(here)

    def solid(k: Column) -> Column:
        here = F.substring(mention, k, F.lit(1))
        before = F.length(F.replace(F.substring(mention, F.lit(1), k), F.lit(" "), F.lit("")))
        return F.when(here == " ", here).otherwise(F.substring(value, before, F.lit(1)))

    places = F.sequence(F.lit(1), F.length(mention))
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(places, digit), ""))
        .when(kind == "iban", F.array_join(F.transform(places, solid), ""))
        .when((kind == "name") & mention.contains("."), F.regexp_replace(value, "^([^ ]+) ", "$1. "))
        .when(kind.isin("email", "secret") & upper, F.upper(value))
        .otherwise(value)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` of distinct entities; no two of a kind share a surrogate.

    A surrogate that another entity has too (the one with the smaller value keeps it),
    or that is an entity of the corpus, is drawn again.  Where the entities fill nearly
    all values of their format, the rules are given up one after the other, so the
    draws end: first the first digit, then being no entity, at last being the only one.
    """
    drawn = cut(
        entities.select("kind", "value", F.lit(0).alias("attempt")).withColumn(
            "surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))
        )
    )
    real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        owner = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        seen = drawn.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        shared = (F.col("value") != F.col("owner")) & (F.col("attempt") < _MAY_SHARE)
        clash = shared | (F.col("real").isNotNull() & (F.col("attempt") < _MAY_BE_REAL))
        marked = cut(seen.select("kind", "value", "attempt", "surrogate", clash.alias("clash")))
        if not marked.where("clash").limit(1).count():
            return marked.select("kind", "value", "surrogate")
        again = F.col("attempt") + F.col("clash").cast("int")
        redrawn = surrogate(F.col("kind"), F.col("value"), key, F.col("next"))
        drawn = cut(
            marked.withColumn("next", again).select(
                "kind", "value", F.col("next").alias("attempt"),
                F.when(F.col("clash"), redrawn).otherwise(F.col("surrogate")).alias("surrogate"),
            )
        )


def pseudonymize(docs: DataFrame, key: str = "corpus", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; all other columns stay as they are.

    ``count`` names an extra column with the number of replaced mentions.  A null or
    empty text stays; rows of equal text get equal results; repeated rows stay; an
    empty table gives no row.  Only texts with an entity are moved, by their digest.
    """
    # Names for columns that come and go, unlike any of the input's.
    mark = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    digest, lists_of, whole = f"{mark}digest", f"{mark}shown", f"{mark}body"
    sign = F.col(text).rlike(_SIGN)
    for title in _TITLES:
        sign = sign | F.contains(F.col(text), F.lit(title))
    has = F.coalesce(sign & F.col(text).rlike(ANY), F.lit(False))
    columns = docs.columns
    counted = [] if count is None else [F.lit(0).alias(count)]
    clean = docs.where(~has).select(*columns, *counted)
    marked = docs.where(has).withColumn(digest, F.sha2(F.col(text), 256))
    mentions = (
        marked.select(digest, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("place", "mention"))
        .groupBy(digest, "place")
        .agg(F.first("mention").alias("mention"))
    )
    kind = kind_of(F.col("mention"))
    mentions = cut(mentions.withColumn("kind", kind).withColumn("value", canonical(F.col("kind"), F.col("mention"))))
    table = surrogates(mentions.select("kind", "value").distinct(), key)
    replaced = mentions.join(table, ["kind", "value"]).select(
        digest, "place", shown_as(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("shown")
    )
    # The mentions of one text, which its own length bounds.
    lists = replaced.groupBy(digest).agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias(lists_of))
    gaps = F.split(F.col(text), ANY, -1)
    shown = F.transform(lists_of, lambda x: x["shown"])
    body = F.array_join(F.zip_with(gaps, shown, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    joined = marked.join(lists, digest).withColumn(whole, body)
    chosen = [F.col(whole).alias(c) if c == text else F.col(f"`{c}`") for c in columns]
    counted = [] if count is None else [F.size(lists_of).alias(count)]
    return joined.select(*chosen, *counted).unionByName(clean)
