"""Small vocabularies for synthetic figures, and pickers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import draws

TOPICS = {
    "de": [("Umsatzerlöse", "Mio. €", 1), ("Betriebsergebnis", "Mio. €", 1), ("Mitarbeitende", "", 0), ("Eigenkapitalquote", "%", 1), ("Investitionen", "Mio. €", 1), ("Auftragseingang", "Mio. €", 0), ("CO2-Ausstoß", "kt", 1), ("Dividende je Aktie", "€", 2)],
    "en": [("Net sales", "EUR m", 1), ("Operating result", "EUR m", 1), ("Headcount", "", 0), ("Equity ratio", "%", 1), ("Capital spending", "EUR m", 1), ("Order intake", "EUR m", 0), ("CO2 emissions", "kt", 1), ("Dividend per share", "EUR", 2)],
}
REGIONS = {"de": ["Deutschland", "Übriges Europa", "Nordamerika", "Südamerika", "Asien", "Afrika", "Ozeanien"], "en": ["Germany", "Rest of Europe", "North America", "South America", "Asia", "Africa", "Oceania"]}
SEGMENTS = {"de": ["Antriebe", "Pumpen", "Dienste", "Sensorik", "Energie", "Bau"], "en": ["Drives", "Pumps", "Services", "Sensors", "Energy", "Construction"]}
NOTES = {"de": ["Quelle: eigene Angaben", "Stand: 31.12.", "Angaben gerundet"], "en": ["Source: company data", "As of 31 December", "Rounded figures"]}
REFERENCES = {("de", "target"): ["Zielwert", "Vorgabe"], ("en", "target"): ["Goal", "Target level"], ("de", "average"): ["Mittel", "Schnitt"], ("en", "average"): ["Mean", "Typical"]}
FONTS = {"sans": ["DejaVu Sans", "Liberation Sans"], "serif": ["DejaVu Serif", "Liberation Serif"]}


def _by_language(language: Column, make) -> Column:
    return F.when(language == "de", make("de")).otherwise(make("en"))


def topic(seed: Column, language: Column) -> Column:
    u = draws.unit(seed, "topic")
    return _by_language(language, lambda x: draws.pick(u, [t[0] for t in TOPICS[x]]))


def unit_of(seed: Column, language: Column) -> Column:
    u = draws.unit(seed, "topic")
    return _by_language(language, lambda x: draws.pick(u, [t[1] for t in TOPICS[x]]))


def note(seed: Column, language: Column) -> Column:
    u = draws.unit(seed, "note")
    return _by_language(language, lambda x: draws.pick(u, NOTES[x]))


def reference(seed: Column, language: Column, kind: str) -> Column:
    u = draws.unit(seed, "reference")
    return _by_language(language, lambda x: draws.pick(u, REFERENCES[x, kind]))


def categories(seed: Column, language: Column, kind: str, n: int) -> Column:
    """n different names of the kind, or all of them."""
    words = REGIONS if kind == "region" else SEGMENTS
    return _by_language(language, lambda x: draws.sample(F.array(*[F.lit(w) for w in words[x]]), seed, kind, n))


def font(seed: Column, kind: str) -> Column:
    return draws.pick(draws.unit(seed, "font"), FONTS[kind])
