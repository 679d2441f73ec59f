"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattice.functions.vectors import bind, unit

ROLE_MARKERS = tuple(f"<|{r}|>" for r in ("system", "user", "assistant")) + tuple(f"[{r}]" for r in ("SYSTEM", "USER", "ASSISTANT")) + tuple(f"{r}:" for r in ("System", "User", "Assistant"))


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down; null and empty give 0."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def truncate_tokens(text: Column, tokens: int) -> Column:
    """The first 4 * tokens characters and a marker, where the text is longer."""
    most = 4 * tokens
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("... [TRUNCATED]"))).otherwise(text)


def sanitize(text: Column, markers: tuple[str, ...] = ROLE_MARKERS, most: int = 10_000) -> Column:
    """Role markers out, then a cap on the length."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(""))
    return F.substring(text, 1, most)


def length_score(text: Column) -> Column:
    return F.least(F.coalesce(F.length(text), F.lit(0)) / 1000.0, F.lit(1.0))


def _dotted(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: F.regexp_replace(s, r"\s", "") != "")


def complexity(text: Column) -> Column:
    """(min(mean words a sentence / 20, 1) + distinct / all words) / 2; sentences end at '.', 0 for no words."""
    parts = F.transform(_dotted(text), lambda s: F.size(words(s)))

    def per_sentence(n: Column) -> Column:
        return F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(n), F.lit(0))

    def variety(w: Column) -> Column:
        return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))

    return F.coalesce((F.least(F.coalesce(bind(parts, per_sentence), F.lit(0.0)) / 20.0, F.lit(1.0)) + bind(words(F.lower(text)), variety)) / 2.0, F.lit(0.0))


def long_word_ratio(text: Column) -> Column:
    """Share of words of more than 6 characters; 0 without words."""
    return bind(words(text), lambda w: F.coalesce(F.size(F.filter(w, lambda x: F.length(x) > 6)) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0)))


def structural_parts(text: Column) -> list[Column]:
    """Length, words, sentences, words a sentence, long-word ratio, each scaled to at most 1."""
    n, s = F.size(words(text)), F.size(_dotted(text))
    return [
        F.least(F.coalesce(F.length(text), F.lit(0)) / 1000.0, F.lit(1.0)),
        F.least(n / 100.0, F.lit(1.0)),
        F.least(s / 10.0, F.lit(1.0)),
        F.least(F.coalesce(n / F.nullif(s, F.lit(0)), F.lit(0.0)) / 20.0, F.lit(1.0)),
        long_word_ratio(text),
    ]


def structural_vector(text: Column, dim: int = 64) -> Column:
    """The parts, then their rotation over the further dimensions, scaled to length 1."""

    def spread(f: Column) -> Column:
        rest = F.transform(F.sequence(F.lit(5), F.lit(dim - 1)), lambda j: (f[0] * (j % 3) + f[1] * ((j + 1) % 3) + f[2] * ((j + 2) % 3)) / 3.0) if dim > 5 else F.array().cast("array<double>")
        return F.concat(F.slice(f, 1, min(dim, 5)), rest)

    return unit(bind(F.array(*structural_parts(text)).cast("array<double>"), spread))


def blended_vector(semantic: Column, text: Column, domain: Column | None = None, dim: int = 64) -> Column:
    """0.5 semantic + 0.3 domain (zeros where there is none) + 0.2 structural, scaled to length 1."""
    out = F.zip_with(semantic.cast("array<double>"), structural_vector(text, dim), lambda a, b: 0.5 * a + 0.2 * b)
    if domain is not None:
        out = F.zip_with(out, domain.cast("array<double>"), lambda a, b: a + 0.3 * b)
    return unit(out)


def md5_vector(text: Column, dim: int = 16) -> Column:
    """The 16 bytes of the MD5 over 255, padded with zeros (or cut) to dim: a deterministic stand-in for an embedding."""

    def numbers(digest: Column) -> Column:
        return F.array(*[F.ascii(F.substring(digest, i + 1, 1)) / 255.0 for i in range(min(dim, 16))])

    head = bind(F.decode(F.unhex(F.md5(F.coalesce(text, F.lit("")))), "ISO-8859-1"), numbers)  # a character a byte
    return F.concat(head, F.array_repeat(F.lit(0.0), dim - 16)) if dim > 16 else head


def label(text: Column, most: int = 80) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def session_name(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def recency(created_at: Column) -> Column:
    """Text before the first '.', Unknown where there is none."""
    return F.coalesce(F.substring_index(created_at.cast("string"), ".", 1), F.lit("Unknown"))


def context_row(source: Column, created_at: Column, content: Column) -> Column:
    """One row of the markdown context table."""
    return F.concat(F.lit("| "), F.coalesce(source, F.lit("Unknown")), F.lit(" | "), recency(created_at), F.lit(" | "), F.replace(F.coalesce(content, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" |"))


def mode_of(answer: Column) -> Column:
    """The retrieval mode named in an answer; hybrid where none is."""
    low = F.lower(F.trim(answer))
    return F.when(low.contains("episodic"), "episodic").when(low.contains("causal"), "causal").otherwise("hybrid")
