"""Text helpers as column expressions: front matter, tokens, inbox files, scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents, and what they are without.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuzzz"
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n*(.*)"


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower case, Latin accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vector_tokens(text: Column) -> Column:
    """ASCII words of two letters or more, and numbers, of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}|[0-9]+"), F.lit(0))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The ``key: value`` lines between the first two ``---`` as a map (the last of a key wins), and the body.

    A text without a front matter has an empty map and is all body.
    """
    present = F.rlike(text, F.lit(FRONT_MATTER))
    lines = F.split(F.regexp_extract(text, FRONT_MATTER, 1), "\n")
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.length(F.substring_index(x, ":", 1)) + 2)).alias("value")),
    )
    # Of a repeated key only the last line stays, whatever the session does with repeated keys.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q.key == p.key))
    meta = F.when(present, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))
    return meta, F.when(present, F.regexp_extract(text, FRONT_MATTER, 2)).otherwise(text)


def yaml_scalar(value: Column) -> Column:
    """``value`` as a YAML scalar, in quotes where it would not stay one."""
    # Characters that mean something at the start of a scalar.
    quoted = (value == "") | F.contains(value, F.lit(": ")) | F.contains(value, F.lit("\n")) | F.rlike(value, F.lit(r"[: ]$")) | F.rlike(value, F.lit(r"""^[-?{"'\[\]{}#&*!|>%@`,]"""))
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.isNull(), "null").when(quoted, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def classify_file(name: Column, content: Column) -> Column:
    """``title, url, source_type`` of an inbox file from its name and content."""
    base, extension = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    lines = F.split(_strip(content), r"\r?\n")
    first = _strip(lines[0])
    is_url = F.rlike(first, F.lit(r"^https?://\S+"))
    bookmark = (extension == ".url") | ((extension == ".txt") & is_url)
    rest = _strip(F.substr(_strip(content), F.length(first) + 1))
    next_line = _strip(F.split(rest, r"\r?\n")[0])
    headline = F.regexp_replace(first, "^# +", "")
    title = F.when(bookmark, base).when(is_url, F.when(next_line == "", base).otherwise(next_line)).otherwise(F.when(headline == "", base).otherwise(headline))
    return F.struct(title.alias("title"), F.when(bookmark | is_url, first).alias("url"), F.when(bookmark | is_url, "web").otherwise("memo").alias("source_type"))


def inbox_body(content: Column, url: Column) -> Column:
    """The body of an inbox file: without the line that is its URL, with one line end after it."""
    stripped = _strip(content)
    first = _strip(F.split(stripped, r"\r?\n")[0])
    rest = _strip(F.regexp_replace(stripped, r"^[^\n]*\n?", ""))
    body = F.when(url.isNotNull() & (first == url) & F.rlike(first, F.lit(r"^https?://\S+")), rest).otherwise(stripped)
    return F.when(url.isNotNull() & (body == ""), "").otherwise(F.concat(body, F.lit("\n")))


def broken_front_matter(content: Column) -> Column:
    """Whether a front matter begins and never ends."""
    stripped = _strip(content)
    return stripped.startswith("---") & ~F.contains(F.substr(stripped, F.lit(4)), F.lit("\n---"))
