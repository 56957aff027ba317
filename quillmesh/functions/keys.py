"""Identity of documents: source keys, canonical URLs, hashes and storage paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a visitor came from.
TRACKING = ("ref", "source", "fbclid", "gclid")
# Scheme, authority, path, query of a URL (RFC 3986, appendix B).
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# Identifiers as publishers write them.
ARXIV_NEW, ARXIV_OLD = r"(\d{4}\.\d{4,5}(?:v\d+)?)", r"([a-z-]+/\d{7})"
DOI = r"(10\.\d{4,9}/\S+)"
VIDEO = r"(?:youtube\.com/(?:watch\?(?:[^#\s]*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def host_of(url: Column) -> Column:
    """Lower-case host without user, password and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":\d*$", ""))


def _decoded(text: Column) -> Column:
    """A part of a query string as typed; what isn't encoded rightly stays."""
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def _encoded(text: Column) -> Column:
    """Form encoding: a plus for a blank, letters, digits and ``-._~`` as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """``url`` with a lower-case host alone, without trailing slashes, fragment, tracking and empty parameters; the others are encoded anew."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: F.rlike(p, F.lit("(?s)=.")))
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("v")))
    wanted = F.filter(named, lambda p: ~F.lower(p.k).startswith("utm_") & ~F.lower(p.k).isin(*TRACKING))
    query = F.array_join(F.transform(wanted, lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.concat(
        F.when(_part(url, 1) != "", F.concat(F.lower(_part(url, 1)), F.lit(":"))).otherwise(""),
        F.when(host_of(url) != "", F.concat(F.lit("//"), host_of(url))).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def title_hash(title: Column) -> Column:
    return F.left(F.sha2(F.lower(F.trim(title)), 256), F.lit(16))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def bare_hash(value: Column) -> Column:
    """A stored hash without its ``sha256:`` prefix."""
    return F.regexp_replace(value, "^sha256:", "")


def shard_path(doc_id: Column) -> Column:
    """Two levels of folders from the hash of the id, then ``id.md``."""
    digest = F.sha2(doc_id, 256)
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(doc_id, F.lit(".md")))


# Digits of base 32 as Spark writes them, and as identifiers use them (no I, L, O and U).
_BASE32, _CROCKFORD = "0123456789abcdefghijklmnopqrstuv", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.translate(F.lower(F.conv(number, base, 32)), _BASE32, _CROCKFORD), width, "0")


def ulid(created_at: Column, seed: Column) -> Column:
    """An id of 26 characters that sorts by time: milliseconds, then 80 bits of the hash of ``seed``, so that a rerun gives the same."""
    digest = F.sha2(seed, 256)
    millis = F.unix_millis(created_at.cast("timestamp")).cast("string")
    return F.concat(_base32(millis, 10, 10), _base32(F.substring(digest, 1, 10), 16, 8), _base32(F.substring(digest, 11, 10), 16, 8))


def slug(name: Column) -> Column:
    """Lower-case letters and digits with single hyphens; ``all`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("all"))


def arxiv_id(text: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(text, ARXIV_NEW, 1), F.lit("")), F.nullif(F.regexp_extract(text, ARXIV_OLD, 1), F.lit("")))
    return found


def doi(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DOI, 1), F.lit(""))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, VIDEO, 1), F.lit(""))


def repo_name(url: Column) -> Column:
    """``owner/name`` of a repository given as a URL, a clone address or in short."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")
    return F.nullif(F.regexp_extract(bare, r"([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)$", 1), F.lit(""))


def repo_key(url: Column) -> Column:
    plain = F.regexp_replace(F.trim(url), "/+$", "")
    short = (F.size(F.split(plain, "/")) == 2) & ~F.contains(url, F.lit("://"))
    path = F.regexp_replace(F.trim(_part(url, 3), F.lit("/")), r"\.git$", "")
    host = F.coalesce(F.nullif(host_of(url), F.lit("")), F.lit("github.com"))
    return F.when(short, F.concat(F.lit("repo:github.com/"), plain)).otherwise(F.concat(F.lit("repo:"), host, F.lit("/"), path))


def paper_key(url: Column, title: Column) -> Column:
    lower = F.lower(url)
    has_doi = F.contains(lower, F.lit("doi.org/")) | lower.startswith("doi:")
    named = F.trim(F.substring_index(F.substring_index(url, "doi.org/", -1), "doi:", -1))
    has_arxiv = (F.contains(lower, F.lit("arxiv.org")) | lower.startswith("arxiv:")) & arxiv_id(url).isNotNull()
    return (
        F.when(has_doi, F.concat(F.lit("doi:"), named))
        .when(has_arxiv, F.concat(F.lit("arxiv:"), arxiv_id(url)))
        .when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("paper:"), title_hash(title)))
        .otherwise("paper:unknown")
    )


def source_key(source_type: Column, url: Column, title: Column, doc_id: Column) -> Column:
    """The key under which a document's source is known: ``repo:``, ``doi:``, ``arxiv:``, ``url:``, ``paper:`` or ``memo:``."""
    url = F.nullif(url, F.lit(""))
    title = F.nullif(title, F.lit(""))
    memo = F.concat(F.lit("memo:"), F.coalesce(doc_id, F.lit("unknown")))
    by_url = F.when(url.isNotNull(), F.concat(F.lit("url:"), canonical_url(url))).when(title.isNotNull(), F.concat(F.lit("paper:"), title_hash(title))).otherwise(memo)
    return (
        F.when(source_type.isin("git_repo", "repo"), repo_key(F.coalesce(url, F.lit(""))))
        .when(source_type == "paper", paper_key(url, title))
        .when(source_type.isin("web", "video", "pdf"), by_url)
        .otherwise(memo)
    )
