"""Parsing of page text: metadata lines, page types, tags, controller sections, HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip

#: Keys of metadata, what stands before the first, and values; titles of endpoints and databases, headings of controller
#: sections.
_KEY, _LEAD, _VALUE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:", r"^\s*[—\-:]\s*", "`([^`]*)`"
_VERB = r"^(GET|POST|PUT|PATCH|DELETE)\s"
_BRACKET = r"\[[^\]]+\]\s*$"
_SECTION, _NEXT, _NAME = r"^##\s+Controllers\s*$", r"^##\s+\S", r"^###\s+(?=.)"


def metadata(markdown: Column) -> Column:
    """The metadata line in the first three lines as map<string, array<string>>; null without one. Of equal keys the last
    wins, and a segment without back-quoted values is left out."""
    line = F.get(F.filter(F.slice(F.split(markdown, "\n", 4), 1, 3), lambda x: x.contains("**Metadata**")), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(line, r"^.*?\*\*Metadata\*\*", ""), _LEAD, "")
    segments = F.split(F.replace(rest, F.lit("\\_"), F.lit("_")), r"\s*·\s*")
    pairs = F.transform(segments, lambda s: F.struct(F.regexp_extract(s, _KEY, 1).alias("k"), F.regexp_extract_all(s, F.lit(_VALUE), F.lit(1)).alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & (F.size(p["v"]) > 0))
    last = lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda q: q["k"] == p["k"]))
    # each is bound once, as the only element of an array, and then used several times
    return _bound(_bound(good, last), lambda x: F.when(F.size(x) > 0, F.map_from_entries(x)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one(meta: Column, key: str) -> Column:
    """A key's first value, null if it is missing."""
    return F.get(F.try_element_at(meta, F.lit(key)), F.lit(0))


def page_type(meta: Column, title: Column, parent_title: Column) -> Column:
    """The first rule that holds, null if none does."""
    return (
        F.when(one(meta, "docType").isNotNull(), one(meta, "docType"))
        .when(one(meta, "endpoint_id").isNotNull(), "endpoint")
        .when(one(meta, "store").isNotNull() & one(meta, "collection").isNotNull(), "db-collection")
        .when(one(meta, "repoType").isNotNull(), "repo-registry")
        .when(title.rlike(_BRACKET), "db-collection")
        .when(title.endswith("· Technical Hub"), "technical-hub")
        .when(title.rlike(_VERB), "endpoint")
        .when(parent_title == "Features", "feature-hub")
    )


def joined_id(kind: str, *parts: Column) -> Column:
    """kind::part::part, null unless all parts are there."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull() & (p != "")
    return F.when(whole, F.concat_ws("::", F.lit(kind), *parts))


#: Types of pages and the fields of each, in the order of the table; pages of other types keep their metadata as it is.
TAGS = {
    "feature-hub": ("feature",),
    "technical-hub": ("feature",),
    "endpoint": ("repo", "feature", "endpoint_id", "controller_id", "db_ids", "route"),
    "db-collection": ("store", "type", "db_collection", "db_id", "consumed_by"),
}
LISTS = ("feature", "db_ids", "consumed_by")


def tags(meta: Column, doc_type: Column, title: Column) -> dict[str, Column]:
    """A column for each field of any type: null where the page's type doesn't have it, an empty list where it has no values."""
    repo, store, collection = (one(meta, k) for k in ("repo", "store", "collection"))
    values = {k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.array().cast("array<string>")) for k in LISTS}
    values |= {k: one(meta, k) for k in ("repo", "endpoint_id", "store", "type")} | {"route": title, "db_collection": collection}
    values |= {"controller_id": joined_id("ctrl", repo, one(meta, "controller")), "db_id": joined_id("db", store, collection)}
    return {k: F.when(doc_type.isin([t for t, fields in TAGS.items() if k in fields]), v) for k, v in values.items()}


def controller_sections(markdown: Column) -> Column:
    """The sections under "## Controllers", as an array of (name, text) in their order."""
    block = F.regexp_extract(markdown, rf"(?dms){_SECTION}(.*?)(?={_NEXT}|\z)", 1)
    parts = F.split(block, f"(?dm){_NAME}")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("name"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("text")))


def html_to_markdown(html: Column) -> Column:
    """Headings, list items and line breaks as Markdown, all other tags dropped: an outline, in columns alone. Pages that are parsed further
    need functions/markdown.py, which keeps what metadata lines are written with."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{n}(\s[^>]*)?>", "\n" + "#" * n + " ")
    out = F.regexp_replace(out, r"(?i)<li(\s[^>]*)?>", "\n* ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</h[1-6]>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
