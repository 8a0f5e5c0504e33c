"""Text expressions: normalised names, extraction, parsing. All are column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seniority words that an alias key lacks (not "lead", which names a role), level words that a
# canonical title lacks, legal forms and the like in company names, wage levels, pay bands, and units of pay.
SENIORITY = (
    "intern", "graduate", "grad", "entry", "junior", "jr", "associate", "mid", "senior", "sr", "staff", "principal", "prin", "distinguished", "fellow", "vice president",
    "i", "ii", "iii", "iv", "v", "1", "2", "3", "4",
)
LEVEL_WORDS = ("senior", "sr", "junior", "jr", "staff", "principal", "lead", "associate", "intern", "entry", "mid", "i", "ii", "iii", "iv", "v")
LEGAL_FORMS = ("inc", "llc", "ltd", "limited", "gmbh", "corp", "co", "company", "plc", "pvt", "private", "technologies", "labs", "group")
WAGE_LEVELS = {"i": "0-2", "ii": "3-5", "iii": "6-9", "iv": "10+"}
PAY_TOKENS = ((40_000, "sal-0"), (75_000, "sal-1"), (120_000, "sal-2"), (180_000, "sal-3"), (260_000, "sal-4"))
UNITS_PER_YEAR = {
    "year": 1.0, "yr": 1.0, "annual": 1.0, "hour": 2080.0, "hr": 2080.0, "hourly": 2080.0, "month": 12.0, "mth": 12.0, "monthly": 12.0,
    "week": 52.0, "wk": 52.0, "weekly": 52.0, "bi-weekly": 26.0, "biweekly": 26.0, "bi weekly": 26.0,
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def one_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, " +", " "))


def any_word(words: Sequence[str]) -> str:
    """A pattern of these whole words."""
    return r"\b(" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def normalize_surface(c: Column, drop: Sequence[str] = SENIORITY) -> Column:
    """Lower case; letters, digits and ``+#./`` only; without seniority words, unless nothing else is left."""
    # Characters one by one: a class of ranges is many times slower on long texts.
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{ascii_lowercase}{digits}+#./ ]+", " ")
    # Words left as bare punctuation go.
    clean = lambda x: F.array_join(F.filter(F.split(x, " +"), lambda w: w.rlike("[a-z0-9]")), " ")
    return F.coalesce(F.nullif(clean(F.regexp_replace(kept, any_word(drop), " ")), F.lit("")), clean(kept))


def canon_title(c: Column, drop: Sequence[str] = LEVEL_WORDS) -> Column:
    """Lower case, letters and digits only, without level words."""
    words = F.split(one_space(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*drop)), " ")


def norm_employer(c: Column) -> Column:
    """Lower case, letters and digits only, without legal forms."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), any_word(LEGAL_FORMS), " "), "[^a-z0-9]+", " "))


def wage_band(level: Column) -> Column:
    """The experience band of a wage level: I to IV, 1 to 4, with or without the word, or ``entry``; null for others."""
    low = F.regexp_replace(F.lower(F.btrim(level)), "^level ", "")
    bands = dict(WAGE_LEVELS)
    found = F.when((low == "entry") & (F.lower(F.btrim(level)) == "entry"), "0-2")
    for k, (roman, band) in enumerate(bands.items(), 1):
        found = found.when((low == roman) | (F.lower(F.btrim(level)) == str(k)), band)
    return found


def pay_token(value: Column) -> Column:
    """A coarse token of yearly pay."""
    found = F.when(value.isNull() | (value <= 0), "sal-unknown")
    for most, token in PAY_TOKENS:
        found = found.when(value < most, token)
    return found.otherwise("sal-5")


def composite_document(title: Column, skills: Column, department: Column, pay: Column) -> Column:
    """Title, the first twelve skills in the order of letters, department and pay token, set apart by bars."""
    low = F.array_sort(F.array_distinct(F.filter(F.transform(skills, lambda x: F.lower(F.btrim(x))), lambda x: x != "")))
    parts = F.concat_ws(" || ", normalize_surface(title), F.array_join(F.slice(low, 1, 12), " "), normalize_surface(department), pay_token(pay))
    return F.btrim(F.regexp_replace(parts, "\\s+", " "))


def token_overlap(name: Column, text: Column) -> Column:
    """The share of the name's words that the text has; words may hold ``+#./-``."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9+#./-]+"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(name), words(text))), F.size(words(name))), F.lit(0.0))


def words_of(c: Column) -> Column:
    """Words of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def extract_terms(c: Column, vocabulary: Sequence[str], most: int = 12) -> Column:
    """Distinct vocabulary words of the text in order of appearance, the longest at each place."""
    import re

    longest_first = sorted(vocabulary, key=lambda w: (-len(w), w))
    pattern = r"(?<![a-z0-9])(" + "|".join(map(re.escape, longest_first)) + r")(?![a-z0-9])"
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), 1)), 1, most)


def lexicon(c: Column, aliases: Mapping[str, str]) -> Column:
    """Sorted names whose alias pattern occurs in the text."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in sorted(aliases.items())]))


def strip_html(c: Column) -> Column:
    """Text without markup, with the five common references decoded and single spaces."""
    bare = F.regexp_replace(F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    for reference, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(reference), F.lit(char))
    return F.btrim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def parse_number(c: Column) -> Column:
    """A number without ``$``, ``,`` and ``%``; null for blanks and the usual marks of no data."""
    bare = F.btrim(F.regexp_replace(c, "[$,%]", ""))
    return F.when(~F.lower(bare).isin("", "-", "n/a", "na", "..", "*", "#"), bare.try_cast("double"))


def annualise(value: Column, unit: Column, trusted: float = 20_000.0) -> Column:
    """Pay by its unit; of an unknown unit only what is a year's pay by its size."""
    times = F.create_map(*[F.lit(x) for pair in UNITS_PER_YEAR.items() for x in pair])[unit]
    return F.coalesce(value * times, F.when(times.isNull() & (value >= trusted), value))


def midpoint(low: Column, high: Column) -> Column:
    """The mean of a band, or the bound that is there."""
    return F.when(high >= low, (low + high) / 2).otherwise(F.coalesce(low, high))


def posted_midpoint(low: Column, high: Column) -> Column:
    """The mean of two bounds, or the one that is there; 0 counts as none."""
    a, b = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    return F.coalesce((a + b) / 2, a, b)


def experience_of(c: Column) -> Column:
    """The band of an answer that is a number of years, 'Less than 1 year' or 'More than 50 years'; pooled for any other."""
    s = F.lower(F.btrim(c))
    return experience_band(F.when(s.contains("less than 1"), 0.0).when(s.contains("more than") | s.contains("50"), 50.0).otherwise(s.try_cast("double")))


def experience_of_range(c: Column) -> Column:
    """The band of an answer like '9 to 10 years' by its first number, 'Less than a year' forms and '20 or more years'; pooled for any other."""
    s = F.lower(F.btrim(c))
    first = F.regexp_extract(s, "([0-9]+)", 1).try_cast("double")
    return experience_band(F.when(s.contains("less than 1"), 0.0).when(s.contains("20 or more") | s.contains("more than"), 20.0).otherwise(first))


def experience_band(years: Column) -> Column:
    return F.when(years.isNull(), "pooled").when(years <= 2, "0-2").when(years <= 5, "3-5").when(years <= 9, "6-9").otherwise("10+")


def confidence(n: Column, high: int, medium: int) -> Column:
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


def horizon_years(c: Column) -> Column:
    """Years of '2023-2033' or '3yr'; null for 'current' or nothing, 10 for other words."""
    first, last = F.regexp_extract(c, "^(\\d{4})-(\\d{4})$", 1), F.regexp_extract(c, "^(\\d{4})-(\\d{4})$", 2)
    some = F.regexp_extract(c, "^(\\d+) ?yr", 1)
    span = F.when(first != "", last.try_cast("int") - first.try_cast("int")).when(some != "", some.try_cast("int"))
    return F.coalesce(span, F.when(~F.coalesce(c, F.lit("")).isin("", "current"), F.lit(10)))


def ordered_rules(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))


def years_mentioned(c: Column, default: int = 4) -> Column:
    """The most years that the text mentions, like '5+ years'."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([0-9]{1,2})[+]? *(?:years|yrs)"), 1), lambda x: x.cast("int"))), F.lit(default))


def month_of(c: Column) -> Column:
    """'YYYY-MM' of a title with a month's name and a year; null without."""
    low = F.lower(c)
    pattern = "(" + "|".join(MONTHS) + ") ([0-9]{4})"
    name, year = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.when(name != "", F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0")))


def month_of_epoch(seconds: Column) -> Column:
    """'YYYY-MM' of seconds since 1970, in UTC; null for 0, null and what is no number."""
    s = F.nullif(seconds.try_cast("long"), F.lit(0))
    return F.date_format(F.to_date(F.lit("1970-01-01")) + F.floor(s / 86_400).cast("int"), "yyyy-MM")


def pay_band(c: Column) -> tuple[Column, Column]:
    """Low and high of a band like '$120k - 150k'; thousands are implied below 1000; null outside 10k to 2M."""
    pattern = "[$]?([0-9]{2,3}(?:,[0-9]{3})?)(k?) *[-] *[$]?([0-9]{2,3}(?:,[0-9]{3})?)(k?)"
    number = lambda k: F.regexp_replace(F.regexp_extract(F.lower(c), pattern, k), ",", "").try_cast("double")
    full = lambda v: F.when(v < 1000, v * 1000).otherwise(v)
    a, b = full(number(1)), full(number(3))
    low, high = F.least(a, b), F.greatest(a, b)
    valid = (low >= 10_000) & (high <= 2_000_000)
    return F.when(valid, low), F.when(valid, high)


def remote_flag(c: Column) -> Column:
    """Whether remote work is offered, and not denied."""
    low = F.lower(c)
    return low.rlike(r"\bremote\b") & ~low.rlike(r"\b(no\s+remote|not\s+remote|on-?site\s+only)\b")


def host_of(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def surt(url: Column) -> Column:
    """The reversed host that sorts pages by site."""
    return F.array_join(F.reverse(F.split(host_of(url), "[.]")), ",")


def tail_of(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the text, padded with two spaces in front and one behind."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def word_runs(words: Column, width: int = 5) -> Column:
    """Runs of ``width`` words of an array of words, repeats too; fewer words are one, none none.

    Pass a column of an earlier select: an expression would run anew for each run. Words are taken by place, as a slice copies
    the whole array.
    """
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), run)).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, width: int = 5) -> Column:
    """Distinct word shingles of an array of words, a column of an earlier select; fewer words are one, none none."""
    return F.array_distinct(word_runs(words, width))


def indian_digits(c: Column) -> Column:
    """A whole number with the last three digits and then pairs of digits set apart."""
    text = c.cast("long").cast("string")
    head = F.when(F.length(text) > 3, F.substring(text, F.lit(1), F.length(text) - 3))
    tail = F.when(F.length(text) > 3, F.substring(text, F.length(text) - 2, F.lit(3))).otherwise(text)
    pairs = F.reverse(F.regexp_replace(F.reverse(head), "([0-9]{2})(?=[0-9])", "$1,"))
    return F.concat_ws(",", pairs, tail)


def tag_list(c: Column, drop: Sequence[str] = ()) -> Column:
    """Tags of '<a><b>' or '|a|b|', without those to drop."""
    bare = F.btrim(F.translate(F.regexp_replace(c, "><", "|"), "<>", ""), F.lit("|"))
    return F.filter(F.split(bare, "[|]"), lambda x: (x != "") & ~x.isin(*drop))


def coerce_word(c: Column, allowed: Sequence[str], other: str = "unknown") -> Column:
    return F.when(c.isin(*allowed), c).otherwise(other)


def coerce_range(c: Column, low: int, high: int) -> Column:
    """The number if it is within the bounds, else null."""
    return F.when(c.between(low, high), c)
