"""Text operators: cleaning, segmentation, sections, titles and tokens."""
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x{A0}]+"


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"\([^)]*\d{4}[^)]*\)", "")


def lines(text: Column, longer_than: int = 2) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(trimmed, lambda x: F.length(x) > longer_than)


def verses(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\n\s*\n"), lambda x: F.trim(x) != "")


def tokens(text: Column, pattern: str = r"[a-z']+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"))


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` of ``tokens``; the rest of a text isn't searched."""
    return tokens(F.regexp_extract(F.lower(text), rf"^(?:[^a-z']*+[a-z']++){{0,{n}}}", 0))


def has_token(text: Column, pattern: str = r"[a-z']+") -> Column:
    """Whether ``tokens`` finds any.  A condition on their number would make Spark find them twice, to filter and to keep."""
    return F.lower(text).rlike(pattern)


def word_count(text: Column, pattern: str = r"\S+") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def sections(text: Column) -> Column:
    """``[marker: credit] body`` blocks as an array of (marker, credit, body); text before the first marker is one too."""
    marked = F.regexp_extract_all(F.concat(F.lit("[]"), text), F.lit(r"(?s)\[([^\]]*)\]([^\[]*)"), F.lit(0))
    return F.transform(marked, lambda m: F.struct(
        F.regexp_extract(m, r"(?s)^\[([^\]:]*)", 1).alias("marker"),
        F.trim(F.regexp_extract(m, r"(?s)^\[[^\]:]*:([^\]]*)\]", 1)).alias("credit"),
        F.regexp_replace(F.regexp_extract(m, r"(?s)^\[[^\]]*\](.*)$", 1), r"^\s+|\s+$", "").alias("body")))


def bodies_credited_to(parsed: Column, name: str, keep_uncredited: bool = True) -> Column:
    """Bodies of the sections credited to a name, or to none."""
    mine = F.filter(parsed, lambda s: F.contains(F.lower(s["credit"]), F.lit(name.lower())) | ((s["credit"] == "") if keep_uncredited else F.lit(False)))
    return F.array_join(F.filter(F.transform(mine, lambda s: s["body"]), lambda b: b != ""), "\n")


def artists(credit: Column) -> Column:
    parts = F.split(F.regexp_replace(credit, r"(?i)\s*(?:&|,|/|\bwith\b|\band\b|\bfeat\.?|\bft\.?)\s*", "|"), r"\|")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def normal_title(title: Column) -> Column:
    """Lower-case letters and digits with single spaces; accents go, typographic quotes are plain."""
    plain = F.translate(F.lower(title), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ’‘“”", "aaaaaaceeeeiiiinooooouuuuyy''\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"['’]", ""), r"[^a-z0-9]+", " "))


def compact_title(title: Column) -> Column:
    return F.regexp_replace(normal_title(title), " ", "")


def relaxed_title(title: Column) -> Column:
    """Without brackets and a tail of guests."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)|\[[^\]]*\]", ""), r"(?i)\s+(?:feat\.?|ft\.?|featuring)\s.*$", ""))


def repair_encoding(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read right; texts with other characters, and those whose bytes aren't UTF-8, stay."""
    suspicious = text.rlike("[Ãâ]") & text.rlike(r"^[\x{0}-\x{FF}]*$")
    read = F.when(suspicious, F.try_validate_utf8(F.encode(F.when(suspicious, text), "ISO-8859-1").cast("string")))
    return F.coalesce(read, text)


def is_placeholder(text: Column, marks=("yet to be transcribed",)) -> Column:
    """Whether a text only announces one."""
    out = F.lit(False)
    for m in marks:
        out = out | F.coalesce(F.contains(F.lower(text), F.lit(m)), F.lit(False))
    return out


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def prefers_direct(title: Column, found: Column, direct: Column) -> Column:
    """Whether an address that was given beats one that was found: their last parts differ (an empty one differs from none,
    unless the title is a remix and only the given address is one, too)."""
    tidy = lambda u: F.regexp_replace(F.lower(F.coalesce(u, F.lit(""))), "/+$", "")
    last = lambda u: F.element_at(F.split(u, "/"), -1)
    a, b = last(tidy(found)), last(tidy(direct))
    remix = F.lower(title).rlike(r"\(remix\)| remix$") & ~F.contains(a, F.lit("remix")) & F.contains(b, F.lit("remix"))
    return (tidy(direct) != "") & (tidy(found) != tidy(direct)) & (F.coalesce(remix, F.lit(False)) | ((a != "") & (b != "") & (a != b)))


def score_sentence(text: Column) -> Column:
    """``score`` and ``reviews`` of "average score of s, based on n reviews" (or critics); nulls if there is none."""
    pattern = r"(?i)average score of (\d+), based on (\d+) (?:reviews|critics)"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("score"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("reviews"))


def weeks_listed(text: Column, chart: str = "Hot 100") -> Column:
    """n of "spent n weeks on the <chart>"."""
    return F.regexp_extract(F.regexp_replace(text, r"\s+", " "), rf"(?i)spent (\d+) weeks on the {chart}", 1).try_cast("int")


def strip_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    return F.regexp_replace(t, r"[*_`~]+", "")


def quoted_spans(text: Column, shortest: int = 2, longest: int = 80) -> Column:
    found = F.regexp_extract_all(text, F.lit("[\"“]([^\"“”\n]+)[\"”]"))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x).between(shortest, longest)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def skeleton(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def signature(text: Column, size: int = 120) -> Column:
    return F.left(squeeze(F.split_part(F.lower(text), F.lit("("), F.lit(1))), F.lit(size))


def canonical_types(tag: Column, mapping: dict) -> Column:
    """Parts between slashes, each by the first key it contains, once, in order."""
    def one(part):
        out = F.when(F.lit(False), "")
        for k, v in mapping.items():
            out = out.when(F.contains(F.lower(part), F.lit(k)), v)
        return out.otherwise(F.trim(part))
    return F.array_join(F.array_distinct(F.transform(F.split(tag, "/"), one)), "/")


def has_word(text: Column, words) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b"), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive; null is false."""
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def url_slug(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]*)/?$", 1)


def clean_boilerplate(text: Column) -> Column:
    """Ordered removals: carriage returns, contributor heads, embed tails, advert lines, leading blank lines."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern, put in ((r"(?s)^\s*\d+ Contributors?[^\n]*\n", ""), (r"(?m)^\s*You might also like\s*$", ""), (r"\d*Embed\s*$", ""), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, put)
    return t


def from_marker(text: Column, marker: str) -> Column:
    at = F.locate(marker, text)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def drop_lines(text: Column, numbers) -> Column:
    """Without the lines of these numbers (from 0)."""
    unwanted = F.array(*[F.lit(int(n)) for n in numbers])
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(unwanted, i)), "\n")


def dedup_key(*cols: Column) -> Column:
    return F.concat_ws("||", *[F.lower(squeeze(c)) for c in cols])


# Marks of a page's chrome, in the order in which they go, and phrases of a line that describes a text.
PAGE_CHROME = (
    (r"(?s)^.*?Read More\s*", ""),
    (r"(?s)^\d+\s*Contributors?.*?Lyrics\s*", ""),
    (r"(?i)You might also like", "\n"),
    (r"(?is)See .+? LiveGet tickets as low as \$\d+", ""),
    (r"(?i)\d*Embed\s*$", ""),
    (r"\n{3,}", "\n\n"),
)
DESCRIPTIONS = ("is a ", "was released", "features", "produced by", "samples", "from the album", "track from", "song from", "this song", "on the album", "debut album")
# What a bracket at the end of a title may begin with to be a suffix.
SUFFIXES = (r"remix", r"remaster", r"skit", r"live", r"explicit", r"clean\s*version", r"album\s*version", r"radio\s*edit", r"extended\s*version", r"extended", r"single\s*version", r"instrumental",
            r"acoustic", r"demo", r"edit", r"main", r"pt\.?\s*\d+", r"part\s*\d+", r"vol\.?\s*\d+", r"feat", r"featuring")
# Words of the first person singular.
FIRST_PERSON = ("i", "me", "my", "mine", "myself", "i'd", "i'll", "i'm", "i've", "imma", "i'ma")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_page(text: Column, described=DESCRIPTIONS, at_most: int = 5, longer_than: int = 80) -> Column:
    """Text without a page's chrome, and without up to ``at_most`` leading lines of prose about it: long lines that end
    with a full stop and hold a phrase of ``described``.  Null is empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "​", "")
    for pattern, put in PAGE_CHROME:
        t = F.regexp_replace(t, pattern, put)
    phrase = "|".join(described)

    def code(line):
        return bound(strip_ends(line), lambda x: F.when(x == "", "b").when((F.length(x) > longer_than) & F.endswith(x, F.lit(".")) & F.lower(x).rlike(phrase), "d").otherwise("x"))

    def kept(lines):
        dropped = F.length(F.regexp_extract(F.array_join(F.transform(lines, code), ""), rf"^(?:b*d){{0,{at_most}}}", 0))
        return F.array_join(F.slice(lines, dropped + 1, F.size(lines)), "\n")

    return strip_ends(bound(F.split(strip_ends(t), "\n"), kept))


def strip_suffixes(title: Column) -> Column:
    """Without all bracketed suffixes at the end."""
    return strip_ends(F.regexp_replace(strip_ends(title), rf"(?i)(?:\s*[\[(](?:{'|'.join(SUFFIXES)})[^)\]]*[\])])+\s*$", ""))


def title_forms(title: Column) -> Column:
    """Keys to look a title up by: as it is, without suffixes, without full stops at the end, without both; in small
    letters, each once, none empty."""
    whole = strip_ends(title)
    undotted = F.regexp_replace(whole, r"\.+$", "")
    forms = F.array(*[F.lower(squeeze(x)) for x in (whole, strip_suffixes(whole), undotted, strip_suffixes(undotted))])
    return F.filter(F.array_distinct(F.flatten(F.transform(forms, lambda k: F.array(k, F.regexp_replace(k, r"\.+$", ""))))), lambda k: k != "")


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC); null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def first_person_rate(text: Column, words=FIRST_PERSON) -> Column:
    """Share of first-person words among the tokens; 0 where there are none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"))
    mine = lambda all_words: F.filter(all_words, lambda w: F.trim(w, F.lit("'")).isin(*words))
    return bound(found, lambda ws: F.when(F.size(ws) > 0, F.size(mine(ws)) / F.size(ws)).otherwise(0.0))


def attributed(parsed: Column, names: str, lead: Column, rule: str = "track", unsung=("sample", "interlude", "instrumental", "skit")) -> Column:
    """(body, method) of what a text's sections give to the names that match a pattern; ``lead`` says whose text it is.

    ``track``: a lead keeps all but sections credited to others alone, a guest what is credited to them; sections whose
    marker holds a word of ``unsung`` go.  ``role``: credited sections if there are any, else all for a lead and none
    for a guest.  ``solo``: the same, but a lead without a credit keeps what isn't credited to others."""
    own = lambda s: s["credit"].rlike(f"(?i){names}")
    other = lambda s: (s["credit"] != "") & ~own(s)
    sung = lambda s: ~F.lower(s["marker"]).rlike("|".join(unsung))

    def made(kept, method):
        return F.struct(F.array_join(F.transform(kept, lambda s: s["body"]), "\n\n").alias("body"), (method if isinstance(method, Column) else F.lit(method)).alias("method"))

    return bound(F.filter(parsed, lambda s: s["body"] != ""), lambda full: _by_rule(full, rule, lead, own, other, sung, made))


def _by_rule(full, rule, lead, own, other, sung, made):
    mine, rest, nothing = F.filter(full, own), F.filter(full, lambda s: ~other(s)), F.filter(full, lambda s: F.lit(False))
    if rule == "track":
        kept = F.filter(rest, sung)
        return F.when(lead, made(kept, F.when(F.size(kept) < F.size(full), "lead, filtered").otherwise("lead, whole"))).otherwise(made(F.filter(mine, sung), "guest"))
    found = F.when(F.size(mine) > 0, made(mine, "credited")).when(~lead, made(nothing, "none"))
    if rule == "role":
        return found.otherwise(made(full, "lead, uncredited"))
    return found.when(F.size(rest) == F.size(full), made(full, "solo")).when(F.size(rest) > 0, made(rest, "solo, partial")).otherwise(made(nothing, "none"))
