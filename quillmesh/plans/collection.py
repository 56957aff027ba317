"""Queries over the document collection, with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import analysis as A
from quillmesh.functions import keys as K
from quillmesh.functions import text as T
from quillmesh.functions import training_records as R
from quillmesh.operators import graph as G
from quillmesh.operators import health as H
from quillmesh.operators import ingest as I
from quillmesh.operators import search as S
from quillmesh.operators import serving as W
from quillmesh.operators import vectors as V
from quillmesh.operators import views
from quillmesh.session import shared_folder, table
from quillmesh.sources.markdown import read_concepts
from quillmesh.streaming.inbox import run_to_table, windowed_counts

QUERIES = {}
ORACLES: dict[str, str] = {}

#: What several queries ask for.
CONCEPT, TYPE = "streaming-grounding", "paper"
SYSTEM = "You answer from the document."


_INDEXES: dict[tuple[str, str], S.SearchIndex] = {}


class Tables:
    """Clean states of the tables under a folder, read when asked for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.raw = lambda name: table(spark, root, name)
        self.spark, self.root = spark, root

    docs = property(lambda self: views.current_docs(self.raw("docs")))
    assigned = property(lambda self: views.assignments(self.raw("doc_concepts")))
    concepts = property(lambda self: self.raw("concepts"))
    edges = property(lambda self: views.current_edges(self.raw("edges")))
    stats = property(lambda self: views.current_stats(self.raw("doc_stats")))
    sources = property(lambda self: views.current_sources(self.raw("sources")))
    frequency = property(lambda self: G.concept_frequency(self.concepts, self.assigned))

    @property
    def index(self) -> S.SearchIndex:
        """The full-text index of the documents, written once for a session and a folder of tables."""
        key = (self.spark.sparkContext.applicationId, self.root)
        if key not in _INDEXES:
            _INDEXES[key] = S.write_index(self.docs, f"{shared_folder(self.spark)}/search-{uuid.uuid4().hex}")
        return _INDEXES[key]


def query(sql: str | None = None):
    """Register a query over ``Tables`` and its SQL."""

    def register(f):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return f(Tables(spark, root))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


DOCS = """d as (select id, coalesce(trim(title), '') as title, coalesce(source, '') as source, coalesce(source_type, 'web') as source_type, rel_path, coalesce(content, '') as content, content_hash, ingested_at
    from (select *, row_number() over (partition by id order by ingested_at desc nulls last, title asc nulls last) as rn from docs where id is not null) where rn = 1)"""
MEMBERS = "m as (select distinct trim(doc_id) as doc_id, lower(trim(concept_id)) as concept_id from doc_concepts where trim(coalesce(doc_id, '')) <> '' and trim(coalesce(concept_id, '')) <> '')"
FREQUENCY = MEMBERS + """, f as (select lower(trim(c.concept_id)) as concept_id, coalesce(c.label, lower(trim(c.concept_id))) as label, c.kind, coalesce(c.is_stop, 0) as is_stop, coalesce(n.df, 0)::bigint as df
    from concepts c left join (select concept_id, count(*) as df from m group by 1) n on n.concept_id = lower(trim(c.concept_id)))"""
EDGES = """e as (select src_id, dst_id, edge_type, coalesce(weight, 0) as weight from
    (select src_id, dst_id, lower(trim(edge_type)) as edge_type, weight, row_number() over (partition by src_id, dst_id, lower(trim(edge_type)) order by try_cast(updated_at as timestamptz) desc nulls last, weight desc nulls last) as rn
     from edges where src_id is not null and dst_id is not null and edge_type is not null and src_id <> dst_id) where rn = 1)"""
STATS = """s as (select doc_id, source_type, coalesce(has_source, 0) as has_source, coalesce(importance, 0) as importance from
    (select *, row_number() over (partition by doc_id order by try_cast(updated_at as timestamptz) desc nulls last, importance desc nulls last) as rn from doc_stats where doc_id is not null) where rn = 1)"""
SOURCES = """l as (select n.source_key, n.canonical_url, n.last_doc_id, n.content_hash, n.updated_at, o.first_doc_id, o.created_at from
    (select *, row_number() over (partition by source_key order by try_cast(updated_at as timestamptz) desc nulls last, last_doc_id) as rn from sources where source_key is not null) n join
    (select *, row_number() over (partition by source_key order by try_cast(updated_at as timestamptz) asc nulls last, last_doc_id) as rn from sources where source_key is not null) o on o.source_key = n.source_key and o.rn = 1 where n.rn = 1)"""
HUB = "h as (select count(*) as n_docs, least(5000, greatest(50, floor(0.002 * count(*))))::bigint as hub from d)"


def _q(*ctes: str) -> str:
    return "with " + ", ".join(ctes) + " "


# --- clean states ---------------------------------------------------------


@query(_q(DOCS) + "select id, title, source_type, md5(content) as body from d")
def view_docs(t: Tables) -> DataFrame:
    """The newest state of each document."""
    return t.docs.select("id", "title", "source_type", F.md5("content").alias("body"))


@query(_q(EDGES) + "select src_id, dst_id, edge_type, weight from e")
def view_edges(t: Tables) -> DataFrame:
    """The newest state of each edge."""
    return t.edges


@query(_q(STATS) + "select doc_id, source_type, has_source, importance from s")
def view_stats(t: Tables) -> DataFrame:
    """The newest statistics of each document."""
    return t.stats


@query(_q(SOURCES) + "select source_key, canonical_url, first_doc_id, last_doc_id, content_hash, created_at, updated_at from l")
def view_sources(t: Tables) -> DataFrame:
    """The ledger with one row per key."""
    return t.sources.select("source_key", "canonical_url", "first_doc_id", "last_doc_id", "content_hash", "created_at", "updated_at")


# --- full-text search -----------------------------------------------------

_FOLDED = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"
_TOKENS = "x as (" + " union all ".join(
    f"select id, '{c}' as col, unnest(range(0, len(k))) as pos, unnest(k) as term from (select id, regexp_extract_all({_FOLDED.format(c)}, '[\\p{{L}}\\p{{N}}]+') as k from d)" for c in S.COLUMNS
) + ")"


def _ranked(ids: str, terms: str) -> str:
    """SQL of BM25 for documents chosen by ``ids``; ``terms`` names the token of a row."""
    return (
        _q(DOCS, _TOKENS)
        + f""", ids as ({ids}), ln as (select id, count(*) as length from x group by 1), co as (select count(*) as n, avg(length) as average from ln),
      hit as (select id, t, count(*) as f from (select id, {terms} as t from x) where t is not null group by 1, 2), fr as (select t, count(*) as df from hit group by 1),
      sc as (select hit.id, -sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))) as score
             from hit join fr using (t) join ln on ln.id = hit.id cross join co where hit.id in (select id from ids) group by 1)
      select d.id, d.title, d.source, round(score, 6) as score from sc join d on d.id = sc.id"""
    )


@query(_q(DOCS, _TOKENS) + "select id, term, count(*) as tf from x group by 1, 2")
def fts_postings(t: Tables) -> DataFrame:
    """How often each token stands in each document."""
    return t.index.postings.groupBy("id", "term").agg(F.count("*").alias("tf"))


@query(_ranked("select id from x where term in ('shard', 'buffer') group by 1 having count(distinct term) = 2", "case when term in ('shard', 'buffer') then term end"))
def fts_and(t: Tables) -> DataFrame:
    """Documents with both words, ranked."""
    return S.search(t.index, "shard buffer", limit=None)


@query(_ranked("select id from x where term in ('replica', 'puffer')", "case when term in ('replica', 'puffer') then term end"))
def fts_or(t: Tables) -> DataFrame:
    """Documents with either word, ranked."""
    return S.search(t.index, "replica OR puffer", limit=None)


@query(_ranked("select id from x where term = 'graph' and id not in (select id from x where term = 'index')", "case when term = 'graph' then term end"))
def fts_not(t: Tables) -> DataFrame:
    """Documents with one word and without another, ranked."""
    return S.search(t.index, "graph NOT index", limit=None)


@query(_ranked("select id from x where starts_with(term, 'schem')", "case when starts_with(term, 'schem') then 'schem*' end"))
def fts_prefix(t: Tables) -> DataFrame:
    """Documents with words of a beginning, ranked."""
    return S.search(t.index, "schem*", limit=None)


@query(_ranked("select a.id from x a join x b on a.id = b.id and a.col = b.col and b.pos = a.pos + 1 where a.term = 'argue' and b.term = 'that'", "case when term in ('argue', 'that') then term end"))
def fts_phrase(t: Tables) -> DataFrame:
    """Documents with two words next to each other, ranked."""
    return S.search(t.index, '"argue that"', limit=None)


@query(_ranked("select a.id from x a join x b on a.id = b.id and a.col = b.col and abs(b.pos - a.pos) - 1 <= 3 where a.term = 'version' and b.term = 'updates'", "case when term in ('version', 'updates') then term end"))
def fts_near(t: Tables) -> DataFrame:
    """Documents with two words at most three apart, ranked."""
    return S.search(t.index, "NEAR(version updates, 3)", limit=None)


@query(_ranked("select id from x where col = 'title' and term = 'shard'", "case when term = 'shard' then term end"))
def fts_column(t: Tables) -> DataFrame:
    """Documents with a word in their title, ranked."""
    return S.search(t.index, "title:shard", limit=None)


@query("with r as (" + _ranked("select id from x where term in ('replica', 'puffer')", "case when term in ('replica', 'puffer') then term end") + ") select *, least(1000, count(*) over ()) as total from r order by score, id limit 20 offset 20")
def fts_page(t: Tables) -> DataFrame:
    """The second page of a search, with how much there is in all."""
    return S.search_page(t.index, "replica OR puffer", page=2)


_HIT = _FOLDED.format("x") + " in ('shard', 'buffer')"
_SNIPPETS = f"""with r as ({_ranked("select id from x where term in ('shard', 'buffer') group by 1 having count(distinct term) = 2", "case when term in ('shard', 'buffer') then term end")} order by score, id limit 20),
    s as (select r.*, c.content, regexp_extract_all(c.content, '[\\p{{L}}\\p{{N}}]+') as w, string_split_regex(c.content, '[\\p{{L}}\\p{{N}}]+') as g from r join (with {DOCS} select id, content from d) c on c.id = r.id),
    l as (select *, len(w) as n, greatest(0, least(coalesce(list_position(list_transform(w, lambda x: {_HIT}), true), 1) - 1 - 10, len(w) - 40)) as low from s)
    select id, title, source, score, case when n = 0 then content else (case when low > 0 then '...' else g[1] end)
      || array_to_string(list_transform(range(low + 1, least(n, low + 40) + 1), lambda i: (case when list_transform([w[i]], lambda x: {_HIT})[1] then '>>>' || w[i] || '<<<' else w[i] end) || (case when i < least(n, low + 40) then g[i + 1] else '' end)), '')
      || (case when least(n, low + 40) < n then '...' else g[n + 1] end) end as snippet from l"""


@query(_SNIPPETS)
def fts_snippets(t: Tables) -> DataFrame:
    """The best twenty with a piece of their content."""
    return S.search_with_snippets(t.index, "shard buffer")


# --- keys and hashes ------------------------------------------------------

_U = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def _dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def _canonical(u: str) -> str:
    scheme, host, path, args = (f"regexp_extract({u}, {_U}, {g})" for g in (1, 2, 3, 4))
    host = f"lower(regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', ''))"
    pairs = f"list_transform(list_filter(string_split({args}, '&'), lambda p: regexp_matches(p, '=.')), lambda p: {{'k': {_dec("split_part(p, '=', 1)")}, 'v': {_dec("substr(p, strpos(p, '=') + 1)")}}})"
    wanted = f"list_filter({pairs}, lambda p: not starts_with(lower(p.k), 'utm_') and lower(p.k) not in ('ref', 'source', 'fbclid', 'gclid'))"
    args = f"array_to_string(list_transform({wanted}, lambda p: {_enc('p.k')} || '=' || {_enc('p.v')}), '&')"
    return f"((case when {scheme} <> '' then lower({scheme}) || ':' else '' end) || (case when {host} <> '' then '//' || {host} else '' end) || regexp_replace({path}, '/+$', '') || (case when {args} <> '' then '?' || {args} else '' end))"


_TITLE = "left(sha256(lower(trim(title))), 16)"
_ARXIV = r"coalesce(nullif(regexp_extract(source, '(\d{4}\.\d{4,5}(?:v\d+)?)', 1), ''), nullif(regexp_extract(source, '([a-z-]+/\d{7})', 1), ''))"
_KEY = f"""case
  when source_type in ('git_repo', 'repo') then case when len(string_split(regexp_replace(trim(source), '/+$', ''), '/')) = 2 and not contains(source, '://') then 'repo:github.com/' || regexp_replace(trim(source), '/+$', '')
    else 'repo:' || coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_extract(source, {_U}, 2), '^.*@', ''), ':[0-9]*$', '')), ''), 'github.com') || '/' || regexp_replace(trim(regexp_extract(source, {_U}, 3), '/'), '\\.git$', '') end
  when source_type = 'paper' then case when contains(lower(source), 'doi.org/') or starts_with(lower(source), 'doi:') then 'doi:' || trim(list_last(string_split(list_last(string_split(source, 'doi.org/')), 'doi:')))
    when (contains(lower(source), 'arxiv.org') or starts_with(lower(source), 'arxiv:')) and {_ARXIV} is not null then 'arxiv:' || {_ARXIV}
    when title <> '' then 'paper:' || {_TITLE} else 'paper:unknown' end
  when source_type in ('web', 'video', 'pdf') then case when source <> '' then 'url:' || {_canonical("source")} when title <> '' then 'paper:' || {_TITLE} else 'memo:' || id end
  else 'memo:' || id end"""


@query(_q(DOCS) + f"select id, {_KEY} as source_key from d")
def key_sources(t: Tables) -> DataFrame:
    """The source key of each document."""
    return t.docs.select("id", K.source_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("id")).alias("source_key"))


@query(f"select distinct source as url, {_canonical('source')} as canonical from docs where source is not null")
def key_canonical_urls(t: Tables) -> DataFrame:
    """Every source as typed with its canonical URL."""
    return t.raw("docs").where("source is not null").select(F.col("source").alias("url")).distinct().select("url", K.canonical_url(F.col("url")).alias("canonical"))


@query(_q(SOURCES, DOCS, f"k as (select {_KEY} as source_key, min(id) as doc_id from d group by 1)") + "select source_key, doc_id from k where source_key in (select source_key from l)")
def key_documents(t: Tables) -> DataFrame:
    """The first document of each key that the ledger knows."""
    keyed = t.docs.select("id", K.source_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("id")).alias("source_key"))
    return I.find_by_source_key(keyed, t.sources.select("source_key"))


@query(_q(DOCS) + f"select id, left(sha256(id), 2) || '/' || substr(sha256(id), 3, 2) || '/' || id || '.md' as path, {_TITLE} as title_hash from d")
def key_paths(t: Tables) -> DataFrame:
    """Storage path and title hash of each document."""
    return t.docs.select("id", K.shard_path(F.col("id")).alias("path"), K.title_hash(F.col("title")).alias("title_hash"))


@query(_q(DOCS) + "select id, case when content_hash is null then 'missing' when regexp_replace(content_hash, '^sha256:', '') = sha256(content) then 'same' else 'other' end as state from d")
def key_hash_check(t: Tables) -> DataFrame:
    """Whether the stored hash of a document is that of its content."""
    stored = K.bare_hash(F.col("content_hash"))
    return t.docs.select("id", F.when(F.col("content_hash").isNull(), "missing").when(stored == K.content_hash(F.col("content")), "same").otherwise("other").alias("state"))


_SCALAR = r"""case when title = '' or contains(title, ': ') or contains(title, chr(10)) or regexp_matches(title, '[: ]$') or regexp_matches(title, '^[-?{"''\[\]{}#&*!|>%@`,]') then '"' || replace(replace(title, '\', '\\'), '"', '\"') || '"' else title end"""


@query(_q(DOCS) + f"select id, trim({_SCALAR}) as title, source_type, md5(regexp_replace(content, '^\\n+', '')) as body from d")
def text_front_matter(t: Tables) -> DataFrame:
    """Documents written as text with a front matter and read again."""
    written = t.docs.select(F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: "), T.yaml_scalar(F.col("title")), F.lit("\nsource_type: "), "source_type", F.lit("\n---\n\n"), "content").alias("text"))
    meta, body = T.front_matter(F.col("text"))
    return written.select(meta.alias("meta"), body.alias("body")).select(F.col("meta")["id"].alias("id"), F.col("meta")["title"].alias("title"), F.col("meta")["source_type"].alias("source_type"), F.md5("body").alias("body"))


# --- ingestion ------------------------------------------------------------


def _incoming(t: Tables) -> DataFrame:
    key = K.source_key(F.col("source_type"), F.col("url"), F.col("title"), F.col("doc_id"))
    rows = t.raw("docs").where("id is not null").select(
        F.col("rel_path").alias("name"), F.coalesce(F.trim("title"), F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("url"),
        F.coalesce("source_type", F.lit("web")).alias("source_type"), F.coalesce("content", F.lit("")).alias("body"), F.col("id").alias("doc_id"),
    )
    return rows.distinct().withColumn("content_hash", F.sha2("body", 256)).withColumn("source_key", key)


def _ledger(t: Tables) -> DataFrame:
    return t.sources.withColumn("content_hash", K.bare_hash(F.col("content_hash")))


_INCOMING = (
    "i as (select *, sha256(content) as hash, " + _KEY + " as key from (select distinct id, rel_path, coalesce(trim(title), '') as title, coalesce(source, '') as source, coalesce(source_type, 'web') as source_type, coalesce(content, '') as content from docs where id is not null))"
)


@query(
    _q(SOURCES, _INCOMING)
    + """select rel_path as name, id as incoming_id, hash as content_hash, coalesce(l.last_doc_id, first_value(id) over w) as doc_id,
      case when row_number() over w = 1 and l.last_doc_id is null then 'new' when coalesce(lag(hash) over w, regexp_replace(l.content_hash, '^sha256:', '')) = hash then 'skip' else 'update' end as action
      from i left join l on l.source_key = i.key window w as (partition by key order by rel_path, id, hash, title, source_type, source)"""
)
def ingest_actions(t: Tables) -> DataFrame:
    """What each stored state would do as an incoming file."""
    rows = _incoming(t).withColumn("incoming_id", F.col("doc_id")).withColumn("turn", F.struct("name", "doc_id", "content_hash", "title", "source_type", "url"))
    return I.ingest_decisions(rows, _ledger(t), order="turn").select("name", "incoming_id", "content_hash", "doc_id", "action")


@query(_q(SOURCES, DOCS) + """select path, case when a.o is null then 'A' when b.o is null then 'D' else 'M' end as change from
      (select distinct last_doc_id as path, regexp_replace(content_hash, '^sha256:', '') as h, 1 as o from l) a full join (select id as path, sha256(content) as h, 1 as o from d) b using (path) where a.o is null or b.o is null or a.h is distinct from b.h""")
def ingest_changes(t: Tables) -> DataFrame:
    """Documents added, modified and deleted since the ledger was written."""
    return I.snapshot_changes(_ledger(t).withColumnRenamed("last_doc_id", "path"), t.docs.select(F.col("id").alias("path"), F.sha2("content", 256).alias("content_hash")), path="path")


@query(_q(DOCS, STATS) + "select id, 'ghost' as problem from d where id not in (select doc_id from s) union all select doc_id, 'missing' from s where doc_id not in (select id from d)")
def index_problems(t: Tables) -> DataFrame:
    """Documents without statistics and statistics without a document."""
    return I.verify_index(t.docs, t.stats.select(F.col("doc_id").alias("id")))


@query(_q(DOCS, STATS) + "select id from d where id in (select doc_id from s) union select doc_id from s where doc_id not in (select id from d)")
def index_repaired(t: Tables) -> DataFrame:
    """The index after ghosts left and missing documents came in."""
    return I.repair_index(t.docs.select("id"), t.stats.select(F.col("doc_id").alias("id"))).distinct()


# --- concept graph --------------------------------------------------------

_SCORE = r"""greatest(0, 0.40 * 1 + 0.25 * (ln(1 + n_docs / (df + 1.0)) / ln(1 + n_docs)) + 0.15 * ((case when contains(concept_id, '-') then 0.5 else 0 end) + (case when regexp_matches(label, '\p{Lu}') then 0.5 else 0 end))
   + 0.10 * least(1, len(string_split(concept_id, '-')) / 3.0) - df / n_docs::double - (df / hub::double) ** 2)"""
_ACTIVE = f"""a as (select * from (select m.doc_id, m.concept_id, df, score, row_number() over (partition by m.doc_id order by score desc, m.concept_id) as place
    from m join (select concept_id, df, round({_SCORE}, 9) as score from f cross join h where is_stop = 0 and df >= 2 and df <= hub) u on u.concept_id = m.concept_id) where place <= 5)"""


@query(_q(FREQUENCY) + "select concept_id, kind, is_stop, df from f")
def graph_concept_frequency(t: Tables) -> DataFrame:
    """Documents of each concept."""
    return t.frequency.select("concept_id", "kind", "is_stop", "df")


@query(_q(DOCS, HUB) + "select n_docs, hub from h")
def graph_hub_threshold(t: Tables) -> DataFrame:
    """From which frequency on a concept is a hub."""
    return G.hub_threshold(t.docs)


@query(_q(DOCS, HUB, FREQUENCY) + f"select concept_id, df, round({_SCORE}, 6) as score from f cross join h")
def graph_term_scores(t: Tables) -> DataFrame:
    """The score of each concept as a term."""
    rows = t.frequency.crossJoin(F.broadcast(G.hub_threshold(t.docs)))
    return rows.select("concept_id", "df", F.round(G.score_term(F.col("concept_id"), F.col("label"), F.col("df"), F.lit(1.0), F.col("n_docs"), F.col("hub")), 6).alias("score"))


@query(_q(DOCS, HUB, FREQUENCY, _ACTIVE) + "select doc_id, concept_id, df, round(score, 6) as score, place from a")
def graph_active_terms(t: Tables) -> DataFrame:
    """The best terms of each document."""
    return G.active_terms(t.docs, t.concepts, t.assigned).withColumn("score", F.round("score", 6))


_TYPE_WEIGHT = "(case s.source_type " + " ".join(f"when '{k}' then {v}" for k, v in G.TYPE_WEIGHTS.items()) + " else 0.0 end)"


@query(
    _q(FREQUENCY, STATS)
    + f"""select s.doc_id, round(case when n is null then 0 else least(1, greatest(0, 0.40 * least(1, n / 3.0) + 0.30 * least(1, 2 * rarity) + 0.15 * {_TYPE_WEIGHT} + 0.15 * (has_source > 0)::int)) end, 6) as importance
     from s left join (select doc_id, count(distinct m.concept_id) as n, avg(case when df > 0 then 1.0::double / df else 1.0 end) as rarity from m join f on f.concept_id = m.concept_id and is_stop = 0 group by 1) p on p.doc_id = s.doc_id"""
)
def graph_importance(t: Tables) -> DataFrame:
    """The importance of each document with statistics."""
    return G.importance(t.assigned, t.concepts, t.stats).select("doc_id", F.round("importance", 6).alias("importance"))


@query(
    _q(DOCS, HUB, FREQUENCY, _ACTIVE)
    + """select src_id, dst_id, round(weight, 6) as weight from (select *, row_number() over (partition by src_id order by round(weight, 9) desc, dst_id) as place from
     (select a.doc_id as src_id, m.doc_id as dst_id, sum(1.0::double / greatest(a.df, 1)) as weight from a join m on m.concept_id = a.concept_id and m.doc_id <> a.doc_id group by 1, 2)) where place <= 10"""
)
def graph_related_edges(t: Tables) -> DataFrame:
    """Up to ten documents that share each document's best terms."""
    return G.related_edges(t.docs, t.concepts, t.assigned).withColumn("weight", F.round("weight", 6))


_PAIRS = "p as (select a.concept_id as c1, b.concept_id as c2, count(*) as n from m a join m b on a.doc_id = b.doc_id and a.concept_id < b.concept_id where a.concept_id in (select concept_id from v) and b.concept_id in (select concept_id from v) group by 1, 2 having count(*) >= 2)"
_USABLE = "v as (select concept_id from f cross join h where is_stop = 0 and df >= 2 and df <= hub)"


@query(_q(DOCS, HUB, FREQUENCY, _USABLE, _PAIRS) + "select c1, c2, n from p")
def graph_concept_pairs(t: Tables) -> DataFrame:
    """Concepts that share two documents or more."""
    return G.concept_pairs(t.docs, t.concepts, t.assigned)


_GREEDY = """o as (select c1, c2, n, row_number() over (order by n desc, c1, c2) as i from p),
     r as (select 0::bigint as i, map(['']::varchar[], [0]) as used, null::varchar as a, null::varchar as b, null::bigint as w
       union all select o.i, case when free then map_concat(used, map([c1, c2], [coalesce(used[c1], 0) + 1, coalesce(used[c2], 0) + 1])) else used end, case when free then c1 end, case when free then c2 end, n
       from (select o.i, o.c1, o.c2, o.n, r.used, coalesce(r.used[o.c1], 0) < 3 and coalesce(r.used[o.c2], 0) < 3 as free from r join o on o.i = r.i + 1) o)"""


@query("with recursive " + ", ".join((DOCS, HUB, FREQUENCY, _USABLE, _PAIRS, _GREEDY)) + " select a as src_id, b as dst_id, w::double as weight from r where a is not null union all select b, a, w::double from r where a is not null")
def graph_cooccurrence_edges(t: Tables) -> DataFrame:
    """Co-occurrence edges with at most three from a concept, accepted in falling order."""
    return G.cooccurrence_edges(t.docs, t.concepts, t.assigned, top_k=3)


@query(_q(EDGES, DOCS) + "select src_id, dst_id, weight, place, title from (select src_id, dst_id, weight, row_number() over (partition by src_id order by round(weight, 9) desc, dst_id) as place from e where edge_type = 'related') r left join d on d.id = r.dst_id where place <= 10")
def graph_find_related(t: Tables) -> DataFrame:
    """Related documents of each document as stored."""
    return G.find_related(t.edges, t.docs)


@query(_q(EDGES) + """, k as (select lower(trim(concept_id)) as dst_id, label from concepts)
     select r.src_id, r.dst_id, r.weight, place, label from (select src_id, dst_id, weight, row_number() over (partition by src_id order by round(weight, 9) desc, dst_id) as place from e where edge_type = 'cooccurrence' and dst_id in (select dst_id from k)) r join k on k.dst_id = r.dst_id where place <= 10""")
def graph_cooccurring(t: Tables) -> DataFrame:
    """Concepts that stand beside each concept as stored."""
    return G.cooccurring_concepts(t.edges, t.concepts)


@query(_q(DOCS, MEMBERS, STATS) + f"select d.id, d.title, d.source_type, coalesce(s.importance, 0) as importance from d left join s on s.doc_id = d.id where d.id in (select doc_id from m where concept_id = '{CONCEPT}' union select doc_id from s where source_type = '{TYPE}')")
def graph_collection(t: Tables) -> DataFrame:
    """Documents of a concept or of a type."""
    return G.resolve_collection(t.docs, t.assigned, t.stats, [f"concept:{CONCEPT}"], [TYPE])


_NOTES = """c as (select f.concept_id, f.label, f.df, coalesce((select list(title order by place) from (select m.concept_id, d.title, row_number() over (partition by m.concept_id order by d.title, d.id) as place from m join d on d.id = m.doc_id) x where x.concept_id = f.concept_id and place <= 5), []) as titles
    from f where is_stop = 0 and df >= 2 and f.concept_id not in (select lower(trim(concept_id)) from concepts where kind = 'entity'))"""


@query(_q(DOCS, FREQUENCY, _NOTES) + "select concept_id, df, '# ' || label || chr(10) || chr(10) || 'Appears in ' || df || ' document(s).' || (case when len(titles) > 0 then chr(10) || chr(10) || '## Documents' || chr(10) || array_to_string(list_transform(titles, lambda x: '- ' || x), chr(10)) else '' end) || chr(10) as note from c")
def graph_notes(t: Tables) -> DataFrame:
    """Notes for concepts that have none (entities count as noted)."""
    noted = t.concepts.where("kind = 'entity'").select(F.lower(F.trim("concept_id")).alias("concept_id"))
    rows = G.note_candidates(t.concepts, t.assigned, t.docs, noted)
    return rows.select("concept_id", "df", G.concept_note(F.col("label"), F.col("df"), F.col("titles")).alias("note"))


@query(_q(MEMBERS) + "select concept_id, count(*) as df from m group by 1")
def graph_incremental(t: Tables) -> DataFrame:
    """Frequencies of a graph that knew primary concepts only, after the documents with other ones were read again."""
    before = views.assignments(t.raw("doc_concepts").where("lower(trim(role)) = 'primary'"))
    changed = views.assignments(t.raw("doc_concepts").where("role is null or lower(trim(role)) <> 'primary'")).select("doc_id").distinct()
    again = G.replace_documents(before, t.assigned.join(changed, "doc_id", "left_semi"), changed)
    return again.groupBy("concept_id").agg(F.count("*").alias("df"))


@query(_q(EDGES) + "select src_id, dst_id, edge_type, weight from e")
def graph_edges_updated(t: Tables) -> DataFrame:
    """The edges of the oldest state, brought up to date with the newest of those that changed."""
    oldest, newest = views.current_edges(t.raw("edges"), newest=False), t.edges
    changed = newest.exceptAll(oldest.select(*newest.columns))
    return I.upsert(oldest, changed, "src_id", "dst_id", "edge_type")


_ENTITY_EDGES = "select distinct m.doc_id as src_id, m.concept_id as dst_id, 'entity' as edge_type, 1.0::double as weight from m join concepts c on lower(trim(c.concept_id)) = m.concept_id and c.kind = 'entity'"
_RELATED = """select src_id, dst_id, 'related' as edge_type, round(weight, 6) as weight from (select *, row_number() over (partition by src_id order by round(weight, 9) desc, dst_id) as place from
     (select a.doc_id as src_id, m.doc_id as dst_id, sum(1.0::double / greatest(a.df, 1)) as weight from a join m on m.concept_id = a.concept_id and m.doc_id <> a.doc_id group by 1, 2)) where place <= 10"""


@query(_q(DOCS, HUB, FREQUENCY, _ACTIVE) + f"{_RELATED} union all {_ENTITY_EDGES} union all select distinct id, {_KEY}, 'source', 1.0::double from d")
def graph_build(t: Tables) -> DataFrame:
    """Edges of a whole build (co-occurrence edges are a query of their own)."""
    keyed = t.docs.withColumn("source_key", K.source_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("id")))
    built = G.full_build(keyed, t.concepts, t.assigned, t.stats)
    return built["edges"].where("edge_type <> 'cooccurrence'").withColumn("weight", F.round("weight", 6))


@query(_q(DOCS, HUB, FREQUENCY, STATS) + f"""select 'concepts' as name, count(*) as n, sum(df)::bigint as total from f union all select 'doc_concepts', count(*), count(distinct concept_id) from m
     union all select 'doc_stats', count(*), sum(has_source)::bigint from s""")
def graph_build_tables(t: Tables) -> DataFrame:
    """Rows and totals of the tables of an incremental build over an older one."""
    keyed = t.docs.withColumn("source_key", K.source_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("id")))
    older = views.assignments(t.raw("doc_concepts").where("lower(trim(role)) = 'primary'"))
    changed = views.assignments(t.raw("doc_concepts").where("role is null or lower(trim(role)) <> 'primary'")).select("doc_id").distinct()
    built = G.incremental_build({"doc_concepts": older}, keyed, t.concepts, t.assigned.join(changed, "doc_id", "left_semi"), changed, t.stats)
    totals = {"concepts": F.sum("df"), "doc_concepts": F.count_distinct("concept_id"), "doc_stats": F.sum("has_source")}
    rows = [built[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), total.cast("long").alias("total")) for name, total in totals.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_q(DOCS) + f"select id as src_id, {_KEY} as dst_id, 'source' as edge_type, 1.0::double as weight from d union select distinct m.doc_id, m.concept_id, 'entity', 1.0::double from (select distinct trim(doc_id) as doc_id, lower(trim(concept_id)) as concept_id from doc_concepts where trim(coalesce(doc_id, '')) <> '') m join concepts c on lower(trim(c.concept_id)) = m.concept_id and c.kind = 'entity'")
def graph_document_edges(t: Tables) -> DataFrame:
    """Edges from documents to entities and sources."""
    entities = t.concepts.where("kind = 'entity'").select(F.lower(F.trim("concept_id")).alias("concept_id"))
    keyed = t.docs.withColumn("source_key", K.source_key(F.col("source_type"), F.col("source"), F.col("title"), F.col("id")))
    return G.document_edges(t.assigned.join(entities, "concept_id", "left_semi"), keyed)


# --- vectors --------------------------------------------------------------

_BUCKETS = "b as (select id, ('0x' || right(md5(token), 3))::int as dim, count(*) as tf from (select id, unnest(regexp_extract_all(lower(title || ' ' || content), '[a-z]{2,}|[0-9]+')) as token from d) group by 1, 2), n as (select count(*) as n_docs from d), g as (select dim, ln(1 + n_docs / (df + 1.0)) as idf from (select dim, count(*) as df from b group by 1) cross join n), w as (select id, dim, tf * idf as w from b join g using (dim)), u as (select id, dim, w / sqrt(sum(w * w) over (partition by id)) as w from w)"


@query(_q(DOCS, _BUCKETS) + "select id, dim, round(w, 6) as w from u")
def vector_tfidf(t: Tables) -> DataFrame:
    """Hashed TF-IDF vectors."""
    return V.tfidf(t.docs).withColumn("w", F.round("w", 6))


@query(
    _q(DOCS, _BUCKETS)
    + """, q as (select dim, count(*) * max(idf) as q from (select ('0x' || right(md5(token), 3))::int as dim from unnest(['native', 'schema', 'trace']) as z(token)) join g using (dim) group by 1)
     select id, round(s, 4) as score from (select id, sum(w * q) / (select sqrt(sum(q * q)) from q) as s from u join q using (dim) group by 1) where round(s, 4) > 0 order by round(s, 4) desc, id limit 10"""
)
def vector_tfidf_search(t: Tables) -> DataFrame:
    """The ten documents most like a few words."""
    return V.tfidf_search(t.docs, "native schema trace")


@query(
    _q(DOCS)
    + """, k as (select id, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') as words from d), p as (select id, words, unnest(range(1, len(words) + 1)) as i from k),
     c as (select id, ('0x' || right(sha256(array_to_string(words[greatest(i - 1, 1):i + 1], ' ')), 2))::int as dim, count(*) as n from p group by 1, 2)
     select id, dim, round(n / sqrt(sum(n * n) over (partition by id)), 6) as w from c"""
)
def vector_hash_embedding(t: Tables) -> DataFrame:
    """Hash embeddings in sparse form."""
    return V.hash_embedding(t.docs).withColumn("w", F.round("w", 6))


@query(
    """with v as (select vec_id, embedding::double[] as e from doc_vectors where model = 'hash-64' and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
     q as (select e from v order by vec_id limit 1) select vec_id, score from (select vec_id, round(list_cosine_similarity(v.e, q.e), 4) as score from v, q) where score > 0 order by score desc, vec_id limit 10"""
)
def vector_search(t: Tables) -> DataFrame:
    """The ten vectors most like the first."""
    vectors = V.usable_vectors(t.raw("doc_vectors")).where("model = 'hash-64'")
    first = vectors.orderBy("vec_id").limit(1).collect()
    return V.embedding_search(vectors, first[0]["embedding"]) if first else vectors.select("vec_id", F.lit(0.0).alias("score")).limit(0)


# --- health ---------------------------------------------------------------


@query(_q(DOCS) + "select source_type, count(*) as n from d group by 1")
def health_source_types(t: Tables) -> DataFrame:
    """Documents of each type."""
    return H.source_type_counts(t.docs)


@query(_q(DOCS, STATS) + "select case when importance >= 0.7 then 'high' when importance >= 0.4 then 'medium' when importance > 0 then 'low' else 'unscored' end as bucket, count(*) as n from d left join s on s.doc_id = d.id group by 1")
def health_importance(t: Tables) -> DataFrame:
    """Documents by importance."""
    return H.importance_buckets(t.docs, t.stats)


@query(_q(DOCS, MEMBERS) + "select id from d where id not in (select doc_id from m)")
def health_orphans(t: Tables) -> DataFrame:
    """Documents without concepts."""
    return H.orphans(t.docs, t.assigned)


@query(_q(DOCS, EDGES) + "select id from d where id not in (select src_id from e where edge_type = 'related' union select dst_id from e where edge_type = 'related')")
def health_isolated(t: Tables) -> DataFrame:
    """Documents without related ones."""
    return H.isolated(t.docs, t.edges)


@query(_q(EDGES) + "select id, count(*) as degree from (select src_id as id from e union all select dst_id from e) group by 1")
def health_degrees(t: Tables) -> DataFrame:
    """Edges at each node."""
    return H.degrees(t.edges)


@query("select source_key, count(*) as n from sources where source_key is not null group by 1 having count(*) > 1")
def health_duplicate_keys(t: Tables) -> DataFrame:
    """Keys that the ledger holds more than once."""
    return H.duplicate_source_keys(t.raw("sources"))


@query(
    _q(DOCS, STATS)
    + """select id, 'no title' as problem from d where title = '' union select id, 'no content' from d where trim(content) = '' union select id, 'no path' from d where trim(coalesce(rel_path, '')) = ''
     union select source_key, 'source key twice' from sources where source_key is not null group by 1 having count(*) > 1 union select id, 'not indexed' from d where id not in (select doc_id from s) union select doc_id, 'no document' from s where doc_id not in (select id from d)"""
)
def health_doctor(t: Tables) -> DataFrame:
    """What is wrong with documents, ledger and index."""
    return H.doctor(t.docs, t.raw("sources"), t.stats.select(F.col("doc_id").alias("id")))


@query(_q(DOCS, FREQUENCY) + "select concept_id, df from f where df >= 2 and concept_id not in (select lower(trim(concept_id)) from concepts where kind = 'entity')")
def health_missing_notes(t: Tables) -> DataFrame:
    """Concepts in two documents or more that have no note (entities count as noted)."""
    return H.missing_notes(t.frequency, t.concepts.where("kind = 'entity'").select(F.lower(F.trim("concept_id")).alias("concept_id")))


@query(_q(DOCS, HUB, FREQUENCY) + "select concept_id, df from f cross join h where df > hub order by df desc, concept_id limit 10")
def health_hubs(t: Tables) -> DataFrame:
    """The most frequent hubs."""
    return H.hubs(t.frequency, G.hub_threshold(t.docs))


@query(
    _q(DOCS, MEMBERS, EDGES)
    + """, o as (select (select count(*) from d) as documents, (select count(*) from concepts where coalesce(is_stop, 0) = 0) as concepts, (select count(*) from e where edge_type = 'related') as related_edges, (select count(*) from e where edge_type = 'cooccurrence') as cooccurrence_edges,
       (select count(*) from d where id not in (select doc_id from m)) as orphans, (select count(*) from d where id not in (select src_id from e where edge_type = 'related' union select dst_id from e where edge_type = 'related')) as isolated,
       (select round(avg(n), 6) from (select count(*) as n from m group by doc_id)) as concepts_per_document, (select round(avg(n), 6) from (select count(*) as n from e where edge_type = 'related' group by src_id)) as related_per_document,
       (select max(n) from (select count(*) as n from (select src_id as id from e union all select dst_id from e) group by id)) as max_degree, (select count(*) from (select source_key from sources where source_key is not null group by 1 having count(*) > 1)) as duplicate_keys,
       (select coalesce(sum(n - 1), 0) from (select count(*) as n from d where content_hash is not null group by regexp_replace(content_hash, '^sha256:', '') having count(*) > 1)) as copies)
     select documents, concepts, related_edges, cooccurrence_edges, orphans, isolated, concepts_per_document, related_per_document, max_degree, duplicate_keys, round(1 - isolated / documents::double, 6) as connectivity, round(copies / documents::double, 6) as duplicate_rate from o"""
)
def health_overview(t: Tables) -> DataFrame:
    """Totals, averages and rates in one row."""
    return H.overview(t.docs, t.assigned, t.edges, t.concepts, t.raw("sources"))


# --- listings -------------------------------------------------------------


@query(_q(DOCS, STATS) + "select id, title, d.source_type, coalesce(importance, 0) as importance from d left join s on s.doc_id = d.id order by id desc limit 20 offset 20")
def list_recent(t: Tables) -> DataFrame:
    """The second page of the newest documents."""
    return W.listing(t.docs, t.stats, page=2)


@query(_q(DOCS, STATS) + "select id, title, d.source_type, coalesce(importance, 0) as importance from d left join s on s.doc_id = d.id order by 4 desc, id desc limit 20")
def list_important(t: Tables) -> DataFrame:
    """The first page by importance."""
    return W.listing(t.docs, t.stats, sort="importance")


@query(_q(DOCS) + "select count(*) as total, greatest(1, ceil(count(*) / 20.0))::bigint as pages from d")
def list_pages(t: Tables) -> DataFrame:
    """How many documents and pages there are."""
    return W.pages(t.docs)


@query(
    _q(DOCS, FREQUENCY)
    + """, k as (select concept_id from f where is_stop = 0 and df > 0 order by df desc, concept_id limit 50), x as (select id from d where id in (select doc_id from m where concept_id in (select concept_id from k)) order by title, id limit 100)
     select 'd:' || doc_id as source, 'c:' || concept_id as target from m where concept_id in (select concept_id from k) and doc_id in (select id from x)"""
)
def list_graph_view(t: Tables) -> DataFrame:
    """Links between the most frequent concepts and the first of their documents."""
    return W.graph_view(t.docs, t.frequency, t.assigned)


@query(_q(DOCS, STATS) + f"select id, title, importance from d join s on s.doc_id = d.id and s.source_type = '{TYPE}'")
def list_category(t: Tables) -> DataFrame:
    """Documents of a type."""
    return W.category(t.docs, t.stats, TYPE)


@query(_q(DOCS, MEMBERS) + f"select id, title, source_type from d where id in (select doc_id from m where concept_id = '{CONCEPT}')")
def list_concept(t: Tables) -> DataFrame:
    """Documents of a concept."""
    return W.concept_documents(t.docs, t.assigned, CONCEPT)


@query(_q(FREQUENCY) + "select concept_id, label, df from f where is_stop = 0 and df >= 1 order by df desc, label, concept_id limit 200")
def list_concepts(t: Tables) -> DataFrame:
    """The two hundred most frequent concepts."""
    return W.concept_list(t.frequency)


@query(_q(DOCS) + "select id, rel_path from d where source_type = 'paper' and (contains(lower(title), 'papers') or contains(lower(source), 'papers') or contains(lower(id), 'papers'))")
def list_selected(t: Tables) -> DataFrame:
    """Documents of a type whose metadata mention a word."""
    return W.select_documents(t.docs, "papers", "paper").select("id", "rel_path")


# --- training records and streams -----------------------------------------

_CLEAN = r"regexp_replace(coalesce({0}, ''), '^[\s]+|[\s]+$', '', 'g')"
_PAIR = (
    "p as (select * from (select pair_id, instruction, context, response, row_number() over (partition by lower(instruction) order by pair_id) as rn from (select pair_id, "
    + ", ".join(f"{_CLEAN.format(c)} as {c}" for c in ("instruction", "context", "response"))
    + " from training_pairs) where instruction <> '' and response <> '') where rn = 1)"
)


@query(_q(_PAIR) + f"select pair_id, '{SYSTEM}' as system, case when context <> '' then instruction || chr(10) || chr(10) || context else instruction end as user, response as assistant from p")
def records_chat(t: Tables) -> DataFrame:
    """Pairs as chat messages, one per instruction."""
    rows = R.distinct_pairs(t.raw("training_pairs")).select("pair_id", R.chat_record(SYSTEM).alias("m"))
    return rows.select("pair_id", *(F.col("m")[i].content.alias(role) for i, role in enumerate(("system", "user", "assistant"))))


@query(_q(_PAIR) + "select pair_id, instruction, context as input, response as output from p")
def records_instruction(t: Tables) -> DataFrame:
    """Pairs as instruction records, one per instruction."""
    return R.distinct_pairs(t.raw("training_pairs")).select("pair_id", *R.instruction_record())


_GENERATED = (
    "p as (select * from (select pair_id, doc_id, difficulty, tags, instruction, context, response, row_number() over (partition by lower(instruction) order by pair_id) as rn from (select pair_id, doc_id, difficulty, tags, "
    + ", ".join(f"{_CLEAN.format(c)} as {c}" for c in ("instruction", "context", "response"))
    + " from training_pairs) where instruction <> '' and response <> '') where rn = 1)"
)


@query(_q(_GENERATED) + "select pair_id, doc_id, instruction, context, response, coalesce(difficulty, '') as difficulty, array_to_string(coalesce(tags, []), ',') as tags from p")
def records_generated(t: Tables) -> DataFrame:
    """Pairs read from model answers (each pair written as an answer first), with difficulty, tags and document."""
    pair = F.to_json(F.array(F.struct("instruction", "context", "response", "difficulty", "tags")))
    answers = t.raw("training_pairs").select("pair_id", "doc_id", F.concat(F.lit("Here they are [as asked]:\n```json\n"), pair, F.lit("\n```")).alias("answer"))
    read = R.read_generated(answers, order="pair_id")
    return read.select(F.col("at").alias("pair_id"), "doc_id", "instruction", "context", "response", "difficulty", F.array_join("tags", ",").alias("tags"))


@query(_q(DOCS, MEMBERS) + "select m.doc_id, m.concept_id as name from m join d on d.id = m.doc_id union all select id, 'of-old' from d where id not in (select doc_id from m)")
def analysis_written(t: Tables) -> DataFrame:
    """Concepts written into the front matter of each document as an analysis, and read from there again; without one the old stay."""
    rows = t.raw("doc_concepts").select(F.trim("doc_id").alias("doc_id"), F.lower(F.trim("concept_id")).alias("id"), (F.lower(F.trim("role")) == "primary").alias("main")).where("doc_id <> '' and id <> ''").distinct()
    ref = F.struct("id", F.col("id").alias("label"))
    found = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("main"), ref))).alias("primary_concepts"), F.sort_array(F.collect_list(F.when(~F.coalesce("main", F.lit(False)), ref))).alias("candidate_concepts"))
    texts = t.docs.select(F.col("id").alias("doc_id"), F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: "), T.yaml_scalar(F.col("title")), F.lit("\nconcepts:\n  - of-old\n---\n\n"), "content").alias("content"))
    return read_concepts(A.write_analyses(texts, found)).select("doc_id", "name").distinct()


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_event_windows(t: Tables) -> DataFrame:
    """Events per hour and type, counted by a stream that reads the table to its end."""
    schema = t.raw("events").schema
    # Written as a pattern, the path may be a file as well as a folder.
    rows = t.spark.readStream.schema(schema).parquet(f"{t.root}/[e]vents.parquet")
    return run_to_table(windowed_counts(rows), f"{shared_folder(t.spark)}/streams")
