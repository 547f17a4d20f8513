"""Tokens, chunk text and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chunk, at most, and what marks a longer one as cut.
MAX_CHUNK_CHARS = 8000
TRUNCATION_MARK = "\n\n_[... truncated]_"
#: Words of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"

#: Ids that name a repository, and citations of a file's line.
_STABLE_ID = r"^(ep|ctrl)::([^:]+)::"
_CITATION = r"\b([\w.]+\.cs):(\d+)\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: Words that an analyser leaves out and endings that it takes off, by language. An ending goes if three letters or more are
#: left before it, the longest one first.
STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "fr": "au aux avec ce ces dans de des du elle en et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
    "de": "aber als am an auch auf aus bei bin bis das dem den der des die du ein eine einem einen einer er es für ich im in ist mit nicht oder sie und von zu",
    "es": "al con de del el ella en es esta este la las lo los no o para pero por que se sin sobre su sus un una uno y",
}
ENDINGS = {"en": "ations ation ingly edly ings ing ies ed es ly s", "fr": "issements issement ements ement ations ation euses euse ives ive ées és ée er ez es s", "de": "ungen ung keiten keit heiten heit lichen liche lich ern en er em es e s", "es": "aciones ación amientos amiento mente adas ados ada ado ando iendo ar er ir es os as s"}


def analysed(text: Column, language: str | None = None) -> Column:
    """The tokens of a text; with a language, without its stop words and endings."""
    out = tokens(text)
    if language is None:
        return out
    stop = F.array(*map(F.lit, STOPWORDS[language].split()))
    kept = F.filter(out, lambda t: ~F.array_contains(stop, t))
    return F.transform(kept, lambda t: F.regexp_replace(t, ending(language), "$1"))


def ending(language: str) -> str:
    """A pattern of words with an ending: what stands before it is the first group."""
    return f"^(.{{3,}}?)({'|'.join(ENDINGS[language].split())})$"


def strip_end(text: Column) -> Column:
    """The text without white space at its end (rtrim takes spaces only)."""
    return F.regexp_replace(text, r"\s+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cap(text: Column, most: int = MAX_CHUNK_CHARS) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(strip_end(F.substring(text, 1, most)), F.lit(TRUNCATION_MARK)))


def chunk_text(title: Column, body: Column) -> Column:
    return cap(strip(F.concat(F.lit("# "), title, F.lit("\n\n"), body)))


def chunk_id(doc_type: Column, key: Column, content: Column) -> Column:
    """The first 24 hexadecimal digits of a hash of type, key and content; metadata is not part of it."""
    return F.substring(F.sha2(F.concat_ws("|", doc_type, key, content), 256), 1, 24)


def filled(*columns: Column | str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def repo_of(stable_id: Column) -> Column:
    """The repository of an endpoint's or controller's id; null for others."""
    return F.nullif(F.regexp_extract(stable_id, _STABLE_ID, 2), F.lit(""))


def cited_files(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_CITATION), F.lit(1))))


def file_lines(text: Column) -> Column:
    """All distinct citations of a text, as (file, line)."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_CITATION), F.lit(0)))
    return F.transform(found, lambda c: F.struct(F.substring_index(c, ":", 1).alias("file"), F.substring_index(c, ":", -1).cast("long").alias("line")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)

