"""Text functions as column expressions (JVM, codegen where Spark has it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens in order; a hyphenated compound is followed by its parts. Null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda w: F.when(F.instr(w, "-") > 0, F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))


def entry_text(topic: Column, text: Column) -> Column:
    """What of an entry is searched: topic and text."""
    return F.concat(F.coalesce(topic, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def past_horizon(text: Column, words: int = 350) -> Column:
    """Whether a text has more words than an embedder reads."""
    return word_count(text) > words


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int = 160) -> Column:
    """White space collapsed; beyond `most` characters cut and marked with three dots."""
    c = collapse(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def heading_slug(heading: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("intro")).otherwise(s)


def name_slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-")


def gloss(topic: Column, text: Column, words: int = 15) -> Column:
    """A one-line handle: of a topic with '#' its base name and section, else the topic; without topic the first words."""
    base = F.regexp_replace(F.regexp_replace(topic, r"#[^#]*$", ""), r"^.*/", "")
    tag = F.element_at(F.split(topic, "#"), -1)
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    opening = F.concat(F.array_join(F.slice(w, 1, words), " "), F.when(F.size(w) > words, F.lit("…")).otherwise(F.lit("")))
    return F.when(F.coalesce(topic, F.lit("")) == "", opening).when(F.instr(topic, "#") > 0, F.concat(base, F.lit("#"), tag)).otherwise(topic)


def attenuation_reading(w: Column) -> Column:
    return F.when(w >= 0.88, F.lit("near-restatement")).when(w >= 0.80, F.lit("strong overlap")).otherwise(F.lit("borderline"))


def verdict(support: Column, settled: float = 0.65, unwritten: float = 0.55) -> Column:
    return F.when(support >= settled, F.lit("settled")).when(support < unwritten, F.lit("unwritten")).otherwise(F.lit("sparse"))


def parse_slots(pairs: Column) -> Column:
    """A map of 'name=value' strings; later ones win, one without '=' has the value ''."""
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != F.split(p, "=", 2)[0]), F.create_map(F.split(p, "=", 2)[0], F.regexp_extract(p, r"^[^=]*=?([\s\S]*)$", 1))),
    )
