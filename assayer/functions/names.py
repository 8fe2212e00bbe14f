"""Canonical countries and institutions by look-up, and equality of author names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup_key

# A country's canonical name and the look-up keys that mean it.
COUNTRY_ALIASES = {
    "United States": ["usa", "us", "u s", "u s a", "united states of america", "united states of america america", "america"],
    "United Kingdom": ["uk", "u k", "britain", "great britain", "england", "united kingdom of great britain and northern ireland", "scotland", "wales", "northern ireland"],
    "Russian Federation": ["russia", "russian fed", "rf"],
    "Korea, Rep.": ["south korea", "korea", "republic of korea", "rok"],
    "Korea, Dem. People's Rep.": ["north korea", "dprk", "north korea dprk", "democratic peoples republic of korea"],
    "Czech Republic": ["czechia", "czech"],
    "Iran, Islamic Rep.": ["iran", "islamic republic of iran", "iran ir"],
    "Egypt, Arab Rep.": ["egypt", "arab republic of egypt", "egypt ar"],
    "Yemen, Rep.": ["yemen", "republic of yemen"],
    "Venezuela, RB": ["venezuela", "bolivarian republic of venezuela"],
    "Congo, Dem. Rep.": ["democratic republic of congo", "drc", "congo dr", "congo kinshasa", "zaire", "d r congo"],
    "Congo, Rep.": ["republic of congo", "congo brazzaville", "roc"],
    "Slovak Republic": ["slovakia"],
    "Kyrgyz Republic": ["kyrgyzstan"],
    "Lao PDR": ["laos", "lao", "lao peoples democratic republic"],
    "Syrian Arab Republic": ["syria"],
    "Turkiye": ["turkey", "türkiye"],
    "Cote d'Ivoire": ["ivory coast", "cote d ivoire", "côte d ivoire", "republic of cote d ivoire"],
    "Cabo Verde": ["cabo verde", "cape verde"],
    "Eswatini": ["swaziland"],
    "Timor-Leste": ["east timor", "timor leste", "democratic republic of timor leste"],
    "Bahamas, The": ["bahamas"],
    "Gambia, The": ["gambia"],
}

# An institution's short form and its name.
INSTITUTION_ALIASES = {
    "mit": "Massachusetts Institute of Technology",
    "caltech": "California Institute of Technology",
    "uc berkeley": "University of California Berkeley",
    "ucla": "University of California Los Angeles",
    "uc davis": "University of California Davis",
    "nyu": "New York University",
    "upenn": "University of Pennsylvania",
    "penn state": "Pennsylvania State University",
    "osu": "Ohio State University",
    "uiuc": "University of Illinois Urbana Champaign",
    "umich": "University of Michigan",
    "utaustin": "University of Texas at Austin",
    "gt": "Georgia Institute of Technology",
    "gatech": "Georgia Institute of Technology",
    "oxford": "University of Oxford",
    "cambridge": "University of Cambridge",
    "imperial college": "Imperial College London",
    "ucl": "University College London",
    "lse": "London School of Economics",
    "edinburgh": "University of Edinburgh",
    "who": "World Health Organization",
    "un": "United Nations",
    "unicef": "United Nations Children's Fund",
    "undp": "United Nations Development Programme",
    "world bank": "World Bank",
    "imf": "International Monetary Fund",
    "fao": "Food and Agriculture Organization",
    "ilo": "International Labour Organization",
    "ifpri": "International Food Policy Research Institute",
    "jpal": "Abdul Latif Jameel Poverty Action Lab",
    "jpml": "Abdul Latif Jameel Poverty Action Lab",
    "3ie": "International Initiative for Impact Evaluation",
    "icddrb": "International Centre for Diarrhoeal Disease Research Bangladesh",
    "icddr b": "International Centre for Diarrhoeal Disease Research Bangladesh",
    "cdc": "Centers for Disease Control and Prevention",
    "nih": "National Institutes of Health",
    "nsf": "National Science Foundation",
    "columbia": "Columbia University",
    "harvard": "Harvard University",
    "stanford": "Stanford University",
    "yale": "Yale University",
    "princeton": "Princeton University",
    "cornell": "Cornell University",
    "duke": "Duke University",
    "johns hopkins": "Johns Hopkins University",
    "jhu": "Johns Hopkins University",
    "kellogg": "Kellogg Foundation",
}
# Words of a university's name.
UNIVERSITY_WORDS = ("university", "college", "institute of technology")


def key_of(text: str) -> str:
    """lookup_key of a string on the driver."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower().strip())).strip()


def country_keys(countries: list[str]) -> dict[str, str]:
    """Look-up key -> canonical name for the taxonomy's countries.

    Aliases count only for countries of the taxonomy. "X, Rep." is also found as "X", unless a second
    country starts alike: then X alone means neither, even if an alias says so.
    """
    known = set(countries)
    found = {k: name for name, aliases in COUNTRY_ALIASES.items() if name in known for k in (key_of(name), *aliases)}
    heads: dict[str, set[str]] = {}
    for name in countries:
        found.setdefault(key_of(name), name)
        if "," in name:
            heads.setdefault(key_of(name.split(",", 1)[0]), set()).add(name)
    for head, names in heads.items():
        if len(names) > 1:
            found.pop(head, None)
        else:
            found.setdefault(head, next(iter(names)))
    return found


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def country(value: Column, countries: list[str]) -> Column:
    """The canonical country; the value itself if its key is unknown."""
    return F.coalesce(F.try_element_at(_map(country_keys(countries)), lookup_key(value)), value)


def institution(value: Column) -> Column:
    """The full name of a known abbreviation, also as University of X or X University where that is one."""
    every = {key_of(k): v for k, v in INSTITUTION_ALIASES.items()}
    universities = {k: v for k, v in every.items() if any(w in v.lower() for w in UNIVERSITY_WORDS)}

    def named(key: Column) -> Column:
        stem = F.when(key.rlike("^(the )?university of "), F.regexp_replace(key, "^(the )?university of ", ""))
        tail = F.when(key.endswith(" university"), F.regexp_replace(key, " university$", ""))
        by_stem = [F.try_element_at(_map(universities), x) for x in (stem, tail)]
        return F.coalesce(F.try_element_at(_map(every), key), *by_stem)

    return F.coalesce(F.transform(F.array(lookup_key(value)), named)[0], value)  # the key is made once


def author_parts(name: Column) -> Column:
    """struct(surname, given): from `Last, First M.` or `First M. Last`."""
    text = F.trim(F.coalesce(name, F.lit("")))
    comma = F.locate(",", text)
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    last = F.when(comma > 0, F.substring(text, F.lit(1), comma - 1)).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    given = F.when(comma > 0, F.substring(text, comma + 1, F.length(text))).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    tokens = F.filter(F.split(lookup_key(given), " "), lambda x: x != "")
    return F.struct(lookup_key(last).alias("surname"), tokens.alias("given"))


def _split_initials(given: Column, other: Column) -> Column:
    """One token of two letters as two initials, where the other side starts with just these."""
    one = F.get(given, F.lit(0))
    letters = F.array(F.substring(one, 1, 1), F.substring(one, 2, 1))
    fits = (F.size(given) == 1) & (F.size(other) >= 2) & one.rlike(r"(?U)^\p{Alpha}{2}$") & (F.slice(other, 1, 2) == letters)
    return F.when(fits, letters).otherwise(given)


def authors_equal(a: Column, b: Column) -> Column:
    """Same surname and agreeing given names, of which at least two agree or one is identical."""
    x, y = author_parts(a), author_parts(b)
    left = _split_initials(x["given"], y["given"])
    right = _split_initials(y["given"], left)
    n = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda p, q: F.struct(p.alias("l"), q.alias("r")))
    agree = lambda p: (p["l"] == p["r"]) | (F.length(p["l"]) == 1) & p["r"].startswith(p["l"]) | (F.length(p["r"]) == 1) & p["l"].startswith(p["r"])
    exact = F.size(F.filter(pairs, lambda p: p["l"] == p["r"]))
    surname = (x["surname"] != "") & (x["surname"] == y["surname"])
    bare = (F.size(x["given"]) == 0) | (F.size(y["given"]) == 0)
    return surname & (bare | F.forall(pairs, agree) & ((n >= 2) | (exact >= 1)))
