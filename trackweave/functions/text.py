"""Names, references and short labels as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Umlauts and how they are spelt out.
UMLAUTS = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss"}
# Letters with other marks; without them they are the first of their decomposed form.
MARKED = "áàâãåāăąéèêëēėęěíìîïīįóòôõōőúùûūůűųýÿçćčñńňśšşźżžřťďľĺģķļņŗ"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)

#: Tokens of a town name that may stand before a stop's name; shortest part of a word that is split in two.
TOWN_TOKENS, SPLIT_PART = 2, 3


def replaced(col: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, col)


def normalise_name(col: Column, keep_station_words: bool = False) -> Column:
    """Lower case without brackets, marks or punctuation; words for station dropped, or spelt one way."""
    s = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"\([^)]*\)", " "))
    s = F.translate(replaced(s, *UMLAUTS.items()), MARKED, PLAIN)
    if keep_station_words:
        s = replaced(s, (r"\bhbf\.?\b", "hauptbahnhof"), (r"\bbf\.?\b", "bahnhof"))
    else:
        s = replaced(s, (r"\b(hauptbahnhof|bahnhof)\b", " "), (r"\b(hbf|bf)\.?\b", " "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def name_forms(col: Column) -> Column:
    """Both forms of a name in one struct; computed once for each side, before names are joined and compared."""
    return F.struct(normalise_name(col).alias("bare"), normalise_name(col, True).alias("full"))


def comparable(a: Column, b: Column) -> tuple[Column, Column]:
    """Of two structs of name_forms the names without station words, or, where one would be empty, those with them."""
    bare = (a["bare"] != "") & (b["bare"] != "")
    return F.when(bare, a["bare"]).otherwise(a["full"]), F.when(bare, b["bare"]).otherwise(b["full"])


def names_equal(a: Column, b: Column) -> Column:
    """Of two structs of name_forms; so are those of the next ones."""
    na, nb = comparable(a, b)
    return (na != "") & (na == nb)


def either_starts(x: Column, y: Column) -> Column:
    return x.startswith(y) | y.startswith(x)


def tokens_match(station: Column, candidate: Column) -> Column:
    """Token by token one is the start of the other, after at most two town tokens; one station word may be split in two."""
    n = F.size(station)
    found = F.lit(False)
    for skip in range(TOWN_TOKENS + 1):
        tail = F.slice(candidate, skip + 1, F.greatest(F.size(candidate) - skip, F.lit(0)))
        found = found | F.coalesce(same_tokens(station, tail, n), F.lit(False)) | F.coalesce(split_tokens(station, tail, n), F.lit(False))
    return found


def same_tokens(station: Column, tail: Column, n: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return (F.size(tail) == n) & F.forall(places, lambda i: either_starts(F.get(tail, i - 1), F.get(station, i - 1)))


def split_tokens(station: Column, tail: Column, n: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def split_at(k: Column) -> Column:
        first, second, word = F.get(tail, k - 1), F.get(tail, k), F.get(station, k - 1)
        parts = (F.length(first) >= SPLIT_PART) & (F.length(second) >= SPLIT_PART) & (F.length(first) + F.length(second) <= F.length(word))
        rest = F.forall(places, lambda i: (i == k) | either_starts(F.get(tail, i - 1 + F.when(i > k, 1).otherwise(0)), F.get(station, i - 1)))
        return parts & word.startswith(first) & word.endswith(second) & rest

    return (F.size(tail) == n + 1) & (n > 0) & F.exists(places, split_at)


def names_contain(a: Column, b: Column) -> Column:
    """Equal, or one of three characters at least is part of the other."""
    na, nb = comparable(a, b)
    inside = ((F.length(na) >= 3) & nb.contains(na)) | ((F.length(nb) >= 3) & na.contains(nb))
    return (na != "") & (nb != "") & ((na == nb) | inside)


def names_match(a: Column, b: Column) -> Column:
    na, nb = comparable(a, b)
    ta, tb = F.split(na, " "), F.split(nb, " ")
    return names_contain(a, b) | ((na != "") & (nb != "") & (tokens_match(ta, tb) | tokens_match(tb, ta)))


def same_stop_name(a: Column, b: Column) -> Column:
    """For names that are normalised already."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    return (a == b) | tokens_match(ta, tb) | tokens_match(tb, ta)


def normalise_ref(col: Column) -> Column:
    """Without a bracket at the end and white space, in lower case."""
    return F.lower(replaced(F.coalesce(col, F.lit("")), (r"\s*\([^()]*\)\s*$", ""), (r"\s+", "")))


# Prefixes that a bare number may borrow from the kind of train.
MODE_PREFIXES = ("re", "rb", "s", "rs", "mex", "r")


def row_ref(line_number: Column, train_type: Column) -> Column:
    """The line that a departure names: its reference, or its number behind the kind of train; empty if neither."""
    line, kind = normalise_ref(line_number), normalise_ref(train_type)
    borrowed = F.when(kind.isin(*MODE_PREFIXES), F.concat(kind, line)).otherwise("")
    return F.when(line == "", "").when(~line.rlike(r"^\d+[a-z]?$"), line).otherwise(borrowed)


# Kinds of train that a passenger line's reference begins with.
PASSENGER_REF = r"(?i)^(ICE|IC|EC|ECE|RE|RB|S|U|STR|FLX|NJ|EN|RJ|TGV)\s?\d"


def pick_ref(col: Column) -> Column:
    """Of several references parted by semicolons the first of a passenger line, else the first."""
    parts = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    best = F.filter(parts, lambda t: t.rlike(PASSENGER_REF))
    return F.when(F.size(parts) <= 1, F.trim(F.coalesce(col, F.lit("")))).otherwise(F.coalesce(F.get(best, F.lit(0)), F.get(parts, F.lit(0))))


def clean_name(col: Column) -> Column:
    """The part behind a short prefix and colon, arrows as dashes."""
    name = F.coalesce(col, F.lit(""))
    colon = F.instr(name, ":") - 1
    base = F.when((colon > 0) & (colon <= 6), F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)
    return F.trim(replaced(base, (r"\s*=>\s*", " – "), (r"\s+", " ")))


# Legal forms in an operator's name.
LEGAL_FORM = r"(?i)\b(GmbH|mbH|AG|KG|SE|e\.?\s?V\.?|Co\.?KG|Co\.?|&)\b"


def search_variants(col: Column) -> Column:
    """Up to four distinct search forms of an operator's name, of more than two characters: the first of several, then without address, brackets and legal form."""
    first = F.trim(F.get(F.split(col, ";"), F.lit(0)))
    place = F.trim(F.regexp_replace(first, ",.*$", ""))
    bare = F.trim(replaced(place, (r"\s*[(\[][^)\]]*[)\]]\s*", " "), (r"\s+", " ")))
    short = F.trim(replaced(bare, (LEGAL_FORM, " "), (r"\s+", " ")))
    return F.array_distinct(F.filter(F.array(first, place, bare, short), lambda v: F.length(v) > 2))


# File extensions by type.
EXTENSIONS = {"image/svg+xml": "svg", "image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/gif": "gif"}


def slug(name: Column, kind: Column) -> Column:
    """A file name of plain letters: the stem, at most 48 characters, a hash of the whole name in base 36, the type's extension."""
    stem = F.when(F.length(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)) > 0, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    plain = F.translate(replaced(F.lower(stem), ("ß", "ss"), ("ø", "o"), ("ł", "l")), MARKED + "äöü", PLAIN + "aou")
    short = F.regexp_replace(F.substring(replaced(plain, ("[^a-z0-9]+", "-"), ("^-|-$", "")), 1, 48), "-$", "")
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    code = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 0xFFFFFF)
    extension = F.coalesce(*[F.when(kind == k, v) for k, v in EXTENSIONS.items()], F.lit("svg"))
    return F.concat(F.when(short == "", "logo").otherwise(short), F.lit("-"), F.lower(F.conv(code.cast("string"), 10, 36)), F.lit("."), extension)


def area_name(areas: Column, level: int = 8) -> Column:
    """Of an array of areas (name, level, main) the main one's name, else that of the level, else the last one's."""
    main, same = F.filter(areas, lambda a: a["main"]), F.filter(areas, lambda a: a["level"] == level)
    return F.coalesce(F.get(main, F.lit(0))["name"], F.get(same, F.lit(0))["name"], F.get(areas, F.size(areas) - 1)["name"], F.lit(""))


def badge(line: Column) -> Column:
    """A line's label without the trip number in brackets; other brackets stay."""
    return F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s*\(\d+\)\s*$", ""))


def minutes_text(value: Column, last_edge: int) -> Column:
    """Minutes as text; at the open end of a histogram with a plus."""
    return F.concat(value.cast("string"), F.when(value >= last_edge, "+").otherwise(""))


# The order of reference prefixes in an index of lines.
PREFIX_ORDER = ("ICE", "IC", "EC", "ECE", "FLX", "NJ", "EN", "RJ", "TGV", "RE", "RB", "S", "U", "STR")


def ref_sort_columns(ref: Column) -> list[Column]:
    """Rank of a known prefix, prefix, number and rest."""
    letters = "[A-Za-zÄÖÜäöü]"
    prefix = F.upper(F.regexp_extract(ref, rf"^\s*({letters}*)", 1))
    number = F.regexp_extract(ref, rf"^\s*{letters}*\s*(\d+)", 1)
    rank = F.coalesce(*[F.when(prefix == p, F.lit(i)) for i, p in enumerate(PREFIX_ORDER)], F.lit(len(PREFIX_ORDER)))
    rest = F.regexp_replace(F.trim(ref), rf"^{letters}*\s*\d*", "")
    return [rank, german(prefix), F.when(number == "", F.lit((1 << 53) - 1)).otherwise(number.try_cast("bigint")), german(rest)]


def german(col: Column) -> Column:
    """Text in the order of German words."""
    return F.collate(col, "DE")


def natural_columns(ref: Column) -> list[Column]:
    """References as people read them: text in German order, then the number in it by its value, then the rest."""
    number = F.regexp_extract(ref, r"^\D*(\d+)", 1)
    return [german(F.regexp_extract(ref, r"^\D*", 0)), F.coalesce(number.try_cast("bigint"), F.lit(-1)), german(F.regexp_replace(ref, r"^\D*\d*", ""))]
