"""Translators: files of other kinds as entries. Each takes a DataFrame of files or lines and gives ENTRY's columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULTS, ENTRY

# Sections that only navigate, by slug.
NAVIGATION = ("contents", "table-of-contents", "list-of-tables", "list-of-figures", "index")
# The tags of a ledger that are prose.
LEDGER_TAGS = ("Note", "ForkRuled")

_LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("at", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("slots", T.MapType(T.StringType(), T.StringType()))])
_LEDGER = T.StructType([T.StructField(n, T.StringType()) for n in ("_tag", "at", "node", "text", "choice")])
HEADING = re.compile(r"(#{1,3})\s+(.*)")


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _entries(df: DataFrame) -> DataFrame:
    """ENTRY's columns in order; what is missing is empty."""
    empty = {"slots": F.create_map().cast("map<string,string>"), "displaces": F.array().cast("array<struct<target_h:string,w:double>>"), "questions": F.array().cast("array<string>")}
    cols = []
    for f in ENTRY.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append((F.coalesce(c.cast(f.dataType), empty[f.name]) if f.name in empty else c.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def lines_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The lines of files (globs allowed), column value."""
    return spark.read.text(paths)


def _records(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.select(line.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def jsonl(lines: DataFrame) -> DataFrame:
    """Lines of JSON with text and, if they have them, topic, at (else now), kind (else note), slots. Blank lines and # comments are
    left out; a malformed line, or one without text, is an error."""
    rec = _records(lines).select(F.from_json("value", _LINE, {"mode": "FAILFAST"}).alias("r"), "value")
    rec = rec.withColumn("text", F.when(F.col("r.text").isNotNull(), F.col("r.text")).otherwise(F.raise_error(F.concat(F.lit("no text: "), F.col("value")))))
    at = F.when(F.coalesce("r.at", F.lit("")) != "", F.col("r.at")).otherwise(now())
    return _entries(rec.select("text", F.col("r.topic").alias("topic"), at.alias("at"), F.coalesce("r.kind", F.lit("note")).alias("kind"), F.col("r.slots").alias("slots")))


def ledger(lines: DataFrame) -> DataFrame:
    """Tagged JSON lines: notes, and rulings as 'fork <node> ruled: <choice>'; the topic is the node, the kind the tag. Other tags and
    malformed lines are left out."""
    rec = _records(lines).select(F.from_json("value", _LEDGER, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").filter(F.col("_tag").isin(*LEDGER_TAGS))
    ruled = F.concat(F.lit("fork "), F.coalesce("node", F.lit("")), F.lit(" ruled: "), F.coalesce("choice", F.lit("")))
    return _entries(rec.select(F.when(F.col("_tag") == "Note", F.col("text")).otherwise(ruled).alias("text"), F.col("node").alias("topic"), "at", F.col("_tag").alias("kind")))


def slug(heading: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", heading.lower()).strip("-") or "intro"


def headed_parts(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body) of each part of a markdown text; before the first heading it is 'intro'."""
    heading, body = "intro", []
    for line in text.splitlines():
        m = HEADING.match(line)
        if m is None:
            body.append(line)
            continue
        yield heading, "\n".join(body)
        heading, body = m[2].strip(), []
    yield heading, "\n".join(body)


def sections(text: str, least: int = DEFAULTS.min_chunk_chars) -> Iterator[tuple[str, str]]:
    """(topic suffix, text) of the sections of a markdown text with bodies of at least `least` characters."""
    for heading, body in headed_parts(text):
        body = body.strip()
        if len(body) >= least:
            yield slug(heading), body if heading == "intro" else f"{heading}\n{body}"


def packed(paragraphs: list[str], words: int) -> list[str]:
    """Consecutive paragraphs together while they have at most `words` words; one that alone has more stays whole."""
    out: list[list[str]] = []
    room = 0
    for p in paragraphs:
        n = len(p.split())
        if out and n <= room:
            out[-1].append(p)
            room -= n
        else:
            out.append([p])
            room = words - n
    return ["\n\n".join(c) for c in out]


def chunks(text: str, words: int = DEFAULTS.pack_words, least: int = DEFAULTS.min_chunk_chars) -> Iterator[tuple[str, str]]:
    """(topic suffix, text) of a paper's sections in chunks of whole paragraphs; chunks after a section's first have /2, /3 and so on. Sections that
    only navigate and chunks below `least` characters are left out, these before chunks are numbered."""
    for heading, body in headed_parts(text):
        s = slug(heading)
        if s in NAVIGATION:
            continue
        paragraphs = [p for p in (q.strip() for q in re.split(r"\n\s*\n", body)) if p]
        kept = [c for c in packed(paragraphs, words) if len(c) >= least]
        for n, c in enumerate(kept, 1):
            yield s if n == 1 else f"{s}/{n}", c if heading == "intro" else f"{heading}\n{c}"


def _by_file(files: DataFrame, cut: Callable[[str], Iterator[tuple[str, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(x, f"{p}#{s}", a, "doc") for p, a, t in zip(b["path"], b["at"], b["text"]) if t is not None for s, x in cut(t)], columns=["text", "topic", "at", "kind"])

    return _entries(files.select("path", "at", "text").mapInPandas(run, "text string, topic string, at string, kind string"))


def markdown(files: DataFrame) -> DataFrame:
    """One entry per section of files (path, at, text); the topic is path#section, so sections are slots that an edited file supersedes."""
    return _by_file(files, sections)


def paper(files: DataFrame) -> DataFrame:
    """Like markdown, in chunks that an embedder can read whole."""
    return _by_file(files, chunks)


#: Converters of other formats to markdown, by file suffix: bytes to text. Users add their own.
CONVERTERS: dict[str, Callable[[bytes], str]] = {s: lambda b: b.decode("utf-8") for s in (".md", ".markdown", ".txt")}


def files_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, at, text) of whole files; at is the time of their last change. Suffixes without a converter are an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    known = dict(CONVERTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, at, content in zip(b["path"], b["at"], b["content"]):
                suffix = "." + path.rsplit(".", 1)[-1].lower()
                if suffix not in known:
                    raise ValueError(f"no converter for {suffix} files")
                rows.append((re.sub(r"^file:/+", "/", path), at, known[suffix](content)))
            yield pd.DataFrame(rows, columns=["path", "at", "text"])

    at = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return df.select("path", at.alias("at"), "content").mapInPandas(run, "path string, at string, text string")


#: Name to (reader of paths, translator).
TRANSLATORS: dict[str, tuple[Callable, Callable]] = {"jsonl": (lines_of, jsonl), "ledger": (lines_of, ledger), "markdown": (files_of, markdown), "paper": (files_of, paper)}


def ingest(spark: SparkSession, name: str, paths: list[str] | str, at: str | None = None) -> DataFrame:
    """The entries of files by a translator's name; with at, all bear that stamp."""
    if name not in TRANSLATORS:
        raise ValueError(f"no translator {name}; there are {', '.join(sorted(TRANSLATORS))}")
    read, translate = TRANSLATORS[name]
    out = translate(read(spark, paths))
    return out if at is None else out.withColumn("at", F.lit(at))
