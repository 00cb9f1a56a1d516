"""Registered queries of the store's own operators, with their SQL.

The driver's tables stand in for the store's: events for frames, documents for
texts and files, conversations for messages, customer and orders for agents
and their tags, part and supplier for keyed records.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import context, counting, fulltext, fuzzy, listing, maintenance, search, similarity, timeline
from ..session import table, with_instants
from ..sources import files
from ..streaming import absorb, frames, status

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """The modules that register further queries here."""
    from . import records, scalars, stores, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


_NTZ = "timestamp_ntz"


def _at(text: str):
    return F.lit(text).cast(_NTZ)


# Listing ---------------------------------------------------------------------

_PAGE_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@_register("""
with c as (select ts, event_id from events where event_id = 100)
select e.event_id, e.ts, e.user_id, e.event_type, e.value from events e, c
where e.ts > c.ts or (e.ts = c.ts and e.event_id > c.event_id)
order by e.ts nulls last, e.event_id nulls last limit 50""")
def keyset_asc(spark, d):
    return listing.page(table(spark, d, "events"), "ts", "event_id", cursor=100).select(*_PAGE_COLUMNS)


@_register("""
with c as (select ts, event_id from events where event_id = 900)
select e.event_id, e.ts, e.user_id, e.event_type, e.value from events e, c
where e.ts < c.ts or (e.ts = c.ts and e.event_id < c.event_id)
order by e.ts desc nulls last, e.event_id desc nulls last limit 50""")
def keyset_desc(spark, d):
    return listing.page(table(spark, d, "events"), "ts", "event_id", cursor=900, ascending=False).select(*_PAGE_COLUMNS)


@_register("select event_id, ts, user_id from events where ts > timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-09 12:00:00'")
def list_range_strict(spark, d):
    return listing.within(table(spark, d, "events"), "ts", datetime(2024, 1, 3), datetime(2024, 1, 9, 12)).select("event_id", "ts", "user_id")


@_register("select event_id, ts, user_id from events where ts between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-09 12:00:00'")
def list_range_inclusive(spark, d):
    return listing.during(table(spark, d, "events"), "ts", datetime(2024, 1, 3), datetime(2024, 1, 9, 12)).select("event_id", "ts", "user_id")


@_register("select event_id, event_type, user_id from events where event_type in ('click', 'error') and user_id = 7")
def list_in_filter(spark, d):
    return listing.match(table(spark, d, "events"), event_type=["click", "error"], user_id=7).select("event_id", "event_type", "user_id")


@_register("select count(*) as n from events where event_type = 'view'")
def count_truthy_filters(spark, d):
    return counting.count(listing.match_truthy(table(spark, d, "events"), event_type="view", user_id=0, props=None))


@_register("""
select user_id, event_id, ts, event_type from (
  select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc nulls last) p from events) where p = 1""")
def latest_per_scope(spark, d):
    return listing.newest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


@_register("""
select user_id, event_id, k from (
  select user_id, event_id, cast(json_extract_string(props, '$.k') as bigint) k,
    row_number() over (partition by user_id order by cast(json_extract_string(props, '$.k') as bigint) desc nulls last, event_id desc) p from events) where p = 1""")
def most_recent_modified(spark, d):
    changed = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return listing.newest(changed, ["user_id"], "k", "event_id").select("user_id", "event_id", "k")


@_register("select user_id, count(event_id) as n from events group by user_id")
def count_per_scope(spark, d):
    return counting.count_ids(table(spark, d, "events"), "user_id", "event_id")


@_register("select event_type as status, count(*) as n from events group by event_type")
def count_by_status(spark, d):
    return counting.by_status(table(spark, d, "events").withColumnRenamed("event_type", "status"))


@_register("""
with t(table_name, n) as (select 'customer', count(*) from customer union all select 'documents', count(*) from documents
  union all select 'events', count(*) from events union all select 'orders', count(*) from orders)
select table_name as "table", n::bigint as n from t union all select 'total', sum(n)::bigint from t""")
def table_counts(spark, d):
    return counting.table_counts({name: table(spark, d, name) for name in ("customer", "documents", "events", "orders")})


@_register("select 'lang' as \"column\", count(*) filter (where lang is null) as nulls from documents union all select 'quality', count(*) filter (where quality is null) from documents left join labels using (doc_id)")
def null_counts(spark, d):
    return counting.null_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["lang", "quality"])


@_register("select event_id, ts from events where ts > (select ts from events where event_id = 10) and ts < (select ts from events where event_id = 400)")
def between_events(spark, d):
    return listing.between_rows(table(spark, d, "events"), "ts", "event_id", after=10, before=400).select("event_id", "ts")


# Tags ------------------------------------------------------------------------


def _bridge(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("tag")).distinct()


_SQL_BRIDGE = "with bridge as (select distinct o_custkey as c_custkey, o_orderpriority as tag from orders) "


@_register(_SQL_BRIDGE + "select c_custkey, c_name from customer where c_custkey in (select c_custkey from bridge where tag in ('1-URGENT', '5-LOW'))")
def tags_any(spark, d):
    return listing.with_any_tag(table(spark, d, "customer"), _bridge(spark, d), "c_custkey", ["1-URGENT", "5-LOW"]).select("c_custkey", "c_name")


@_register(_SQL_BRIDGE + "select c_custkey, c_name from customer where c_custkey in (select c_custkey from bridge where tag in ('1-URGENT', '2-HIGH', '5-LOW') group by 1 having count(*) = 3)")
def tags_all(spark, d):
    return listing.with_all_tags(table(spark, d, "customer"), _bridge(spark, d), "c_custkey", ["1-URGENT", "2-HIGH", "5-LOW"]).select("c_custkey", "c_name")


@_register(_SQL_BRIDGE + "select distinct tag from bridge where tag > '2' and tag ilike '%o%' order by tag limit 2")
def tags_distinct_page(spark, d):
    return listing.tag_page(table(spark, d, "customer"), _bridge(spark, d), "c_custkey", cursor="2", like="o", limit=2)


@_register("select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey = o_custkey")
def children_of(spark, d):
    return listing.children(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", keep_childless=True).select("c_custkey", "c_name", "o_orderkey")


@_register("select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def joined_hierarchy(spark, d):
    """Region, nation, customer and order in a chain of plain joins."""
    out = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


# Files -----------------------------------------------------------------------


@_register("select count(*) as files, coalesce(sum(n_chars), 0)::bigint as total_size, count(distinct source) as kinds from documents")
def file_stats(spark, d):
    return counting.file_statistics(table(spark, d, "documents"), "n_chars", "source")


@_register("select source, count(*) as files, sum(n_chars)::bigint as total_size from documents group by source")
def files_by_type(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("total_size"))


@_register("select doc_id, source from documents where contains(lower(source), 'src1')")
def files_name_contains(spark, d):
    return table(spark, d, "documents").where(X.contains(F.col("source"), "SRC1")).select("doc_id", "source")


@_register("""
select page_id, case when ext = 'html' then 'text/html' when ext = 'com' then 'application/octet-stream' else 'application/octet-stream' end as type
from (select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) ext from pages)""")
def page_types(spark, d):
    return table(spark, d, "pages").select("page_id", files.mime_type(F.col("url")).alias("type"))


# Messages --------------------------------------------------------------------


def _messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


def _agents(spark, d) -> DataFrame:
    """Each conversation's list names its turns that are even."""
    return _messages(spark, d).groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("held"))


@_register("select conv_id, turn from conversations where turn % 2 = 1")
def detached_messages(spark, d):
    return listing.detached(_messages(spark, d), _agents(spark, d), "conv_id", "turn", "held").select("conv_id", "turn")


@_register("""
with per as (select conv_id, count(*) filter (where turn % 2 = 1) as n from conversations group by conv_id)
select conv_id, n::bigint as n from per union all select null, sum(n)::bigint from per""")
def detached_message_counts(spark, d):
    return listing.detached_counts(_messages(spark, d), _agents(spark, d), "conv_id", "turn", "held")


@_register("select p as position, d.doc_id, d.lang from (values (0, 17), (1, 3), (2, 99), (3, 3)) v(p, i) join documents d on d.doc_id = v.i")
def ordered_id_fetch(spark, d):
    return listing.in_asked_order(table(spark, d, "documents"), "doc_id", [17, 3, 99, 3]).select("position", "doc_id", "lang")


@_register("select conv_id, turn, text from conversations where role = 'user' and contains(lower(text), 'the') order by conv_id, turn limit 5 offset 5")
def conversation_search(spark, d):
    return search.conversation_search(_messages(spark, d), "THE", "conv_id", "turn", page=1).select("conv_id", "turn", "text")


@_register("""
select conv_id, coalesce(arg_max(text, turn) filter (where role = 'user' and trim(coalesce(text, '')) <> ''), arg_max(text, turn)) as topic
from conversations group by conv_id""")
def last_user_topic(spark, d):
    return search.topic(_messages(spark, d), "conv_id", "turn")


@_register("select conv_id, string_agg(role || ': ' || coalesce(text, ''), e'\\n\\n' order by turn, role, text) as history from conversations group by conv_id")
def conversation_history(spark, d):
    return _messages(spark, d).groupBy("conv_id").agg(X.history(F.col("role"), F.col("text"), F.col("turn")).alias("history"))


# Text and search ---------------------------------------------------------------

_SQL_CLEAN = r"trim(regexp_replace(lower(regexp_replace(coalesce({}, ''), '[!-/:-@\[-`{{-~]', ' ', 'g')), '[\s\x{{00a0}}]+', ' ', 'g'))"
_SQL_TOKENS = "list_filter(string_split(" + _SQL_CLEAN + ", ' '), lambda w: length(w) > 1)"


@_register(f"select doc_id, {_SQL_CLEAN.format('text')} as cleaned from documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@_register(f"select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as words from (select doc_id, {_SQL_TOKENS.format('text')} t from documents)")
def token_stats(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("words"))


@_register("select doc_id, n_chars from documents where contains(lower(text), 'license, version') order by n_chars desc, doc_id desc limit 50")
def contains_literal(spark, d):
    return search.contains(table(spark, d, "documents"), "text", "License, Version", "n_chars", "doc_id").select("doc_id", "n_chars")


@_register("select doc_id from documents where lower(text) like '%gnu%license_ version%'")
def contains_wildcards(spark, d):
    return table(spark, d, "documents").where(X.contains(F.col("text"), "GNU%license_ version", wildcards=True)).select("doc_id")


_SQL_BM25 = f"""
toks as (select doc_id, t from (select doc_id, {_SQL_TOKENS.format('text')} t from documents) where len(t) > 0),
corpus as (select count(*) n, avg(len(t)) mean from toks),
tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from toks) group by all),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) idf from tf, corpus group by term, n),
idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end idf from raw)"""
_QUERY = "The thandnd license reonth, version of the license"


@_register(f"""
with {_SQL_BM25}, q as (select unnest({_SQL_TOKENS.format(repr(_QUERY))}) term),
part as (select tf.doc_id, idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(toks.t) / corpus.mean)) p
  from q join idf using (term) join tf using (term) join toks using (doc_id), corpus)
select toks.doc_id, round(coalesce(sum(p), 0), 6) as score from toks left join part using (doc_id) group by toks.doc_id
order by coalesce(sum(p), 0) desc, toks.doc_id limit 20""")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), "text", _QUERY, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@_register(f"""
with {_SQL_BM25}, q as (select item_id, term, count(*) qf from (select item_id, unnest({_SQL_TOKENS.format('text')}) term from benchmark) group by all),
s as (select item_id, tf.doc_id, round(sum(qf * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(toks.t) / corpus.mean))), 6) score
  from q join idf using (term) join tf using (term) join toks using (doc_id), corpus group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s) where rank <= 3""")
def bm25_batch(spark, d):
    return search.bm25_batch(table(spark, d, "documents"), "text", "doc_id", table(spark, d, "benchmark"), "item_id", "text")


@_register("select doc_id, (contains(lower(coalesce(text, '')), 'license')::int + contains(lower(coalesce(text, '')), 'version')::int + contains(lower(coalesce(text, '')), 'the')::int) as hits from documents")
def word_match_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_matches(["license", "version", "the"], F.col("text")).alias("hits"))


def _query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 3").first()["embedding"]


_SQL_DISTANCE = "1 - list_dot_product(e.embedding::double[], q.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.v, q.v)))"


@_register(f"""
with q as (select embedding::double[] v from embeddings where vec_id = 3)
select vec_id, round({_SQL_DISTANCE}, 6) as distance from embeddings e, q order by {_SQL_DISTANCE}, vec_id limit 10""")
def vector_topk(spark, d):
    out = search.by_vector(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), "vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@_register(f"""
with q as (select embedding::double[] v from embeddings where vec_id = 3)
select vec_id, label, round({_SQL_DISTANCE}, 6) as distance from embeddings e, q where label in (1, 2) order by {_SQL_DISTANCE}, vec_id limit 10""")
def vector_topk_filtered(spark, d):
    out = search.by_vector(listing.match(table(spark, d, "embeddings"), label=[1, 2]), "embedding", _query_vector(spark, d), "vec_id")
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_register("""
select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, (4096 - len(embedding))::int as padding from embeddings""")
def vector_norms(spark, d):
    """Norms of the padded vectors: padding changes nothing."""
    whole = V.padded(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(whole), 6).alias("norm"), (F.size(whole) - F.size("embedding")).alias("padding"))


@_register("""
(select 'documents' as store, 0 as place, doc_id as id, n_chars as size from documents where contains(lower(text), 'version') order by n_chars desc, doc_id desc limit 10)
union all (select 'conversations', 1, conv_id * 1000 + turn, length(text) from conversations where contains(lower(text), 'version') or contains(lower(text), 'onst') order by length(text) desc, conv_id * 1000 + turn desc limit 10)
union all (select 'pages', 2, page_id, length(html) from pages where contains(lower(html), 'onst') order by length(html) desc, page_id desc limit 10)""")
def contains_in_stores(spark, d):
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("size"))
    said = _messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.length("text").cast("long").alias("size"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.length("html").cast("long").alias("size"))
    either = said.where(X.any_contains("version", F.col("text")) | X.any_contains("onst", F.col("text")))
    parts = [
        search.contains(documents, "text", "version", "size", "id", 10).select(F.lit("documents").alias("store"), F.lit(0).alias("place"), "id", "size"),
        search.contains(either, "text", "", "size", "id", 10).select(F.lit("conversations").alias("store"), F.lit(1).alias("place"), "id", "size"),
        search.contains(pages, "text", "onst", "size", "id", 10).select(F.lit("pages").alias("store"), F.lit(2).alias("place"), "id", "size"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("""
with c(store, total) as (select 'conversations', count(*) from conversations union all select 'documents', count(*) from documents union all select 'pages', count(*) from pages)
select store as "table", total::bigint as n from c union all select 'total', sum(total)::bigint from c""")
def searched_store_counts(spark, d):
    return counting.table_counts({name: table(spark, d, name) for name in ("conversations", "documents", "pages")})


@_register()
def fulltext_and_or(spark, d):
    out = fulltext.search(table(spark, d, "documents"), ["source", "text"], "Licensed under version", "n_chars", "doc_id", 50)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@_register()
def fuzzy_topk(spark, d):
    return fuzzy.fuzzy(table(spark, d, "documents"), "text", "relesed under teh MIT licence", "doc_id", 10).select("doc_id", F.round("score", 4).alias("score"))


# Vault -------------------------------------------------------------------------


def _vault(spark, d) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").when(F.col("quality") == 0, "medium")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("sensitivity", grade)


_SQL_VAULT = "with vault as (select d.*, case when toxic = 1 then 'high' when quality = 1 then 'low' when quality = 0 then 'medium' end sensitivity from documents d left join labels using (doc_id)) "


@_register(_SQL_VAULT + "select doc_id, sensitivity, case when sensitivity = 'high' then repeat('•', 8) when length(text) > 200 then substring(text, 1, 200) || '...' else text end as shown from vault")
def masked_vault(spark, d):
    shown = X.masked(X.preview(F.col("text")), F.col("sensitivity"))
    return _vault(spark, d).select("doc_id", "sensitivity", shown.alias("shown"))


@_register(_SQL_VAULT + "select doc_id, sensitivity from vault where sensitivity in ('low', 'medium')")
def sensitivity_filter(spark, d):
    return listing.match(_vault(spark, d), sensitivity=["low", "medium"]).select("doc_id", "sensitivity")


# Similarity ----------------------------------------------------------------------

_SQL_SETS = r"""
sets as (select words, min(doc_id) rep, count(*) copies, len(words) n from (
    select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x{00a0}]+'), lambda w: w <> ''))) words from documents)
  where len(words) > 0 group by words),
w as (select rep, n, unnest(words) word from sets),
pairs as (select x.rep a, y.rep b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) similarity from w x join w y on x.word = y.word and x.rep < y.rep
  and least(x.n, y.n) > 0.7 * greatest(x.n, y.n) group by all having count(*) / (any_value(x.n) + any_value(y.n) - count(*)) > 0.7)"""


@_register("with " + _SQL_SETS + " select a, b, round(similarity, 6) as similarity from pairs")
def jaccard_pairs(spark, d):
    sets = similarity.word_sets(table(spark, d, "documents"), "doc_id", F.col("text"))
    return similarity.similar_pairs(sets).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_register("with " + _SQL_SETS + """,
counted as (select case when similarity > 0.9 then 'duplicate' else 'similar' end kind, x.copies * y.copies pairs from pairs join sets x on a = x.rep join sets y on b = y.rep
  union all select 'duplicate', copies * (copies - 1) // 2 from sets where copies > 1)
select kind, sum(pairs)::bigint as pairs, case when kind = 'duplicate' then 'merge or remove' else 'review' end as recommendation from counted group by kind""")
def jaccard_report(spark, d):
    return similarity.redundancy_report(table(spark, d, "documents"), "doc_id", F.col("text"))


@_register(r"""
with s as (select conv_id k, len(w) n, w from (select conv_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\x{00a0}]+'), lambda x: x <> '')) w from conversations where turn = 0) where len(w) > 0),
e as (select k, n, unnest(w) word from s)
select x.k a, y.k b, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) as overlap from e x join e y on x.word = y.word and x.k < y.k
group by all having count(*) / least(any_value(x.n), any_value(y.n)) > 0.3""")
def overlap_pairs(spark, d):
    """Overlaps of the first turns alone; overlap_turns has those of all."""
    out = similarity.overlapping_blocks(_messages(spark, d).where("turn = 0"), "conv_id", "text")
    return out.select("a", "b", F.round("overlap", 6).alias("overlap"))


@_register(r"""
with s as (select conv_id k, turn t, len(w) n, w from (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\x{00a0}]+'), lambda x: x <> '')) w from conversations) where len(w) > 0),
e as (select k, t, n, unnest(w) word from s)
select x.k a, x.t turn_a, y.k b, y.t turn_b, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) as overlap
from e x join e y on x.word = y.word and (x.k < y.k or x.k = y.k and x.t < y.t)
group by all having count(*) / least(any_value(x.n), any_value(y.n)) > 0.3""")
def overlap_turns(spark, d):
    """Overlaps of all turns, of one conversation and of different ones."""
    turns = _messages(spark, d).withColumn("block", F.struct("conv_id", "turn"))
    out = similarity.overlapping_blocks(turns, "block", "text")
    return out.select(F.col("a.conv_id").alias("a"), F.col("a.turn").alias("turn_a"), F.col("b.conv_id").alias("b"), F.col("b.turn").alias("turn_b"), F.round("overlap", 6).alias("overlap"))


# Timeline ------------------------------------------------------------------------

_SQL_SESSIONS = """
g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events),
n as (select *, sum(case when gap is null or gap > 300000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) session from g)"""
_SQL_MODE = "(select event_type from n m where m.user_id = n.user_id and m.session = n.session group by event_type order by count(*) desc, event_type limit 1)"


@_register("with " + _SQL_SESSIONS + """,
k as (select user_id, session, event_type, row_number() over (partition by user_id, session order by count(*) desc, event_type) p from n group by user_id, session, event_type)
select n.user_id, n.session::bigint as session, min(ts) as start_time, max(ts) as end_time, any_value(k.event_type) as primary_app, count(*) as frame_count, sum(length(props))::bigint as total_words
from n join k on k.user_id = n.user_id and k.session = n.session and k.p = 1 group by n.user_id, n.session""")
def sessions_gap300(spark, d):
    return timeline.sessions(table(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type", F.length("props"))


@_register("select user_id, time_bucket(interval 15 minutes, ts) as bucket, count(*) as n, round(sum(value), 4) as total from events group by all")
def bucket_15min(spark, d):
    out = timeline.buckets(with_instants(table(spark, d, "events")), ["user_id"], "ts", total=F.sum("value"))
    return out.select("user_id", F.col("bucket").cast(_NTZ).alias("bucket"), "n", F.round("total", 4).alias("total"))


_SQL_DAY_MODE = "k as (select user_id, d, event_type, row_number() over (partition by user_id, d order by count(*) desc, event_type) p from (select *, ts::date d from events) group by user_id, d, event_type)"


@_register("with " + _SQL_DAY_MODE + """
select e.user_id, strftime(ts::date, '%Y-%m-%d') as day, count(*) as frames, count(distinct e.event_type) as apps, any_value(k.event_type) as primary_app, min(ts) as first_at, max(ts) as last_at
from events e join k on k.user_id = e.user_id and k.d = e.ts::date and k.p = 1 group by e.user_id, ts::date""")
def day_activity_rollup(spark, d):
    out = timeline.days(table(spark, d, "events"), ["user_id"], "ts", "event_type")
    return out.withColumn("day", F.col("day").cast("string"))


@_register("""
select user_id, event_type as app from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) p from events group by user_id, event_type) where p = 1""")
def primary_app(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(timeline.primary(F.col("event_type")).alias("app"))


@_register("select event_id, user_id, value, lag(value) over (partition by user_id order by ts, event_id) as previous from events")
def previous_frame(spark, d):
    return timeline.with_previous(table(spark, d, "events"), ["user_id"], "ts", "event_id", "value").select("event_id", "user_id", "value", "previous")


# Context -------------------------------------------------------------------------


@_register("select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding)::bigint as running from conversations")
def running_block_total(spark, d):
    return context.running_total(_messages(spark, d), ["conv_id"], "turn", F.length("text")).select("conv_id", "turn", "running")


@_register("""
with n as (select conv_id, role, ceil(length(coalesce(text, '')) / 4)::bigint tokens, row_number() over (partition by conv_id order by turn) - 1 i from conversations),
r as (select *, sum(tokens) over (partition by conv_id) total, count(*) over (partition by conv_id) many, sum(tokens) over (partition by conv_id order by i) cum from n where i > 0),
s as (select *, min(case when role not in ('user', 'tool', 'function') and (cum >= floor(total * 0.9) or many - i <= 5) then i end) over (partition by conv_id) stop from r),
b as (select *, min(case when i > stop and role <> 'tool' then i end) over (partition by conv_id) beyond from s)
select conv_id, coalesce(any_value(case when stop is not null then coalesce(beyond, many + 1) end), 0)::bigint as cutoff from b group by conv_id""")
def summarizer_cutoff(spark, d):
    return context.summarizer_cutoff(_messages(spark, d), "conv_id", "turn", "role", X.token_estimate(F.col("text")))


@_register("""
with t as (select conv_id, sum(ceil(length(coalesce(text, '')) / 4)) tokens, count(*) n from conversations group by conv_id)
select conv_id, (case when tokens > 0.75 * 200 then floor(n * (0.75 * 200 / tokens) * 0.8) else 0 end)::bigint as folded from t""")
def fold_count(spark, d):
    return context.fold_count(_messages(spark, d), "conv_id", X.token_estimate(F.col("text")), 200)


@_register("""
select event_id, user_id from (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id) f from events) where f is null or event_id < f""")
def ready_prefix(spark, d):
    """Events of a user before the first purchase, the pending state of this data."""
    return context.ready_prefix(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id", "user_id")


@_register("""
select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) p, max(ts) over (partition by user_id) newest from events)
where p <= 20 and ts >= newest - interval 86400 seconds""")
def newest_n_minute(spark, d):
    return context.last_then_recent(table(spark, d, "events"), ["user_id"], "ts", "event_id", 20, 86400).select("event_id", "user_id", "ts")


@_register("select event_id from (select event_id, row_number() over (order by ts desc, event_id desc) p from events) where p > 600")
def beyond_newest(spark, d):
    return context.beyond_newest(table(spark, d, "events"), "ts", "event_id").select("event_id")


# Maintenance ---------------------------------------------------------------------


def _records(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts with a key below 60 % of the largest are ours; those above 30 %, some renamed, theirs."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    top = part.agg(F.max("id").alias("top"))
    both = part.crossJoin(F.broadcast(top))
    renamed = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" v2"))).otherwise(F.col("name"))
    return both.where("id < top * 0.6").select("id", "name"), both.where("id > top * 0.3").select("id", renamed.alias("name"))


_SQL_RECORDS = """with top as (select max(p_partkey) t from part),
ours as (select p_partkey id, p_name as name from part, top where p_partkey < t * 0.6),
theirs as (select p_partkey id, case when p_partkey % 3 = 0 then p_name || ' v2' else p_name end as name from part, top where p_partkey > t * 0.3)"""


@_register(_SQL_RECORDS + " select coalesce(o.id, t.id) as id, case when o.id is null then 'new' when t.id is null then 'obsolete' else 'current' end as state from ours o full join theirs t on o.id = t.id")
def sync_diff(spark, d):
    return maintenance.sync_difference(*_records(spark, d), "id")


@_register(_SQL_RECORDS + " select coalesce(t.id, o.id) as id, coalesce(t.name, o.name) as name from ours o full join theirs t on o.id = t.id")
def upsert_merge(spark, d):
    return maintenance.upsert(*_records(spark, d), ["id"])


@_register(_SQL_RECORDS + """ select coalesce(o.id, t.id) as id, coalesce(t.name, o.name) as name,
case when o.id is null then 'insert' when t.id is null then 'drop' when o.name is not distinct from t.name then 'keep' else 'update' end as action from ours o full join theirs t on o.id = t.id""")
def key_sync(spark, d):
    return maintenance.key_sync(*_records(spark, d), "id", "name")


@_register(_SQL_RECORDS + " select t.id, t.name from theirs t where t.id not in (select id from ours)")
def insert_new(spark, d):
    ours, theirs = _records(spark, d)
    return maintenance.insert_new(ours, theirs, ["id"])


@_register(_SQL_RECORDS + ", p as (select id, case when id % 2 = 0 then name end as name, id % 5 <> 0 as flag from theirs) select o.id, case when p.flag then p.name else o.name end as name from ours o left join p on o.id = p.id")
def patch_set_fields(spark, d):
    """Names of even ids set, of odd ones cleared, of every fifth left alone."""
    ours, theirs = _records(spark, d)
    changes = theirs.select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"), (F.col("id") % 5 != 0).alias("set_name"))
    return maintenance.patch(ours, changes, "id")


@_register("""
with o as (select s_suppkey a, s_suppkey + 1 b from supplier where s_suppkey % 2 = 0), n as (select s_suppkey a, s_suppkey + (s_suppkey % 3) b from supplier)
select a, b from n where exists (select 1 from o where o.a = n.a and o.b <> n.b) or exists (select 1 from o where o.b = n.b and o.a <> n.a)""")
def mapping_conflicts(spark, d):
    key = F.col("s_suppkey")
    supplier = table(spark, d, "supplier")
    old = supplier.where(key % 2 == 0).select(key.alias("a"), (key + 1).alias("b"))
    return maintenance.mapping_conflicts(old, supplier.select(key.alias("a"), (key + key % 3).alias("b")), "a", "b")


@_register(_SQL_RECORDS + " select o.id, o.name, coalesce(t.id is not null, false) as is_deleted from ours o left join theirs t on o.id = t.id")
def soft_delete(spark, d):
    ours, theirs = _records(spark, d)
    return maintenance.delete(ours.withColumn("is_deleted", F.lit(False)), theirs, "id", soft="is_deleted")


@_register("""
select user_id, to_json(map_from_entries(list((event_type, v) order by event_type))) as settings from (
  select user_id, event_type, arg_max(value, event_id) v from events group by all) group by user_id""")
def last_value_settings(spark, d):
    out = maintenance.last_value_map(table(spark, d, "events"), "user_id", "event_type", "value", "event_id")
    return out.select("user_id", F.to_json("settings").alias("settings"))


@_register("select lang as value, min(doc_id) as position from documents group by lang")
def first_appearance(spark, d):
    return maintenance.first_positions(table(spark, d, "documents").select(F.col("lang").alias("value"), F.col("doc_id").alias("position")), "value", "position")


# Exports ---------------------------------------------------------------------------


@_register("""
select memory_type, doc_id, lang, page_id, url, conv_id, turn, role from (
  select 'document' memory_type, doc_id, lang, null::bigint page_id, null url, null::bigint conv_id, null::bigint turn, null as role from documents
  union all select 'page', null, null, page_id, url, null, null, null from pages
  union all select 'message', null, null, null, null, conv_id, turn, role from conversations)""")
def export_union(spark, d):
    stores = {
        "document": table(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").alias("created_at")),
        "page": table(spark, d, "pages").select("page_id", "url", F.col("page_id").alias("created_at")),
        "message": _messages(spark, d).select("conv_id", "turn", "role", F.col("turn").alias("created_at")),
    }
    return files.export_union(stores).select("memory_type", "doc_id", "lang", "page_id", "url", "conv_id", "turn", "role")


# Stateful --------------------------------------------------------------------------


def _frames(spark, d) -> DataFrame:
    """Events as sampled frames: an eighth of them differ clearly."""
    return with_instants(table(spark, d, "events")).select("user_id", "ts", "event_id", (F.when(F.col("event_id") % 8 == 0, 0.5).otherwise(0.001)).alias("difference"))


@_register("""
with recursive f as (select user_id, event_id, epoch_us(ts) t, case when event_id % 8 = 0 then 0.5 else 0.001 end diff, row_number() over (partition by user_id order by ts, event_id) i from events),
k as (select user_id, event_id, i, t last, true kept from f where i = 1
  union all select f.user_id, f.event_id, f.i, case when f.diff < 0.01 and f.t - k.last < 3600000000 then k.last else f.t end, not (f.diff < 0.01 and f.t - k.last < 3600000000)
  from k join f on f.user_id = k.user_id and f.i = k.i + 1)
select user_id, event_id, kept from k""")
def frame_keep_rule(spark, d):
    """The keep rule with an hour for its seconds, as events are minutes apart."""
    return frames.keep(_frames(spark, d), "user_id", "ts", "event_id", "difference", force_s=3600.0).select("user_id", "event_id", "kept")


@_register("""
with recursive p as (select user_id, ts::date poll, count(*) size, row_number() over (partition by user_id order by ts::date) i from events group by user_id, ts::date),
w as (select user_id, poll, i, case when size >= 20 then 0 else size end waiting, case when size >= 20 then 1 else 0 end batch, size >= 20 ends from p where i = 1
  union all select p.user_id, p.poll, p.i, case when w.waiting + p.size >= 20 then 0 else w.waiting + p.size end, w.batch + case when w.waiting + p.size >= 20 then 1 else 0 end, w.waiting + p.size >= 20
  from w join p on p.user_id = w.user_id and p.i = w.i + 1)
select e.user_id, e.event_id, (select min(batch) from w where w.user_id = e.user_id and w.ends and w.poll >= e.ts::date)::bigint as batch from events e""")
def absorb_batches(spark, d):
    """Daily polls; twenty waiting events make a batch."""
    items = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").cast("string").alias("poll"))
    return absorb.batches(items, "user_id", "poll", "event_id")[["user_id", "event_id", "batch"]]


@_register("""
select event_id, case when event_type = 'error' then -1 when length(props) >= 1 then 2 else 2 end as ocr_status, event_type <> 'error' as has_text from events""")
def status_machine(spark, d):
    """The reading stage over all frames: errors have no text and fail."""
    text = F.when(F.col("event_type") != "error", F.col("props"))
    out = status.read_result(table(spark, d, "events").withColumn("ocr_status", F.lit(1)), text)
    return out.select("event_id", "ocr_status", "has_text")


@_register("with " + _SQL_SESSIONS + " select user_id, count(*) as frame_count, min(ts) as start_time, max(ts) as end_time from n group by user_id, session")
def session_window_batch(spark, d):
    out = timeline.session_windows(with_instants(table(spark, d, "events")), ["user_id"], "ts")
    return out.select("user_id", "frame_count", F.col("start_time").cast(_NTZ).alias("start_time"), F.col("end_time").cast(_NTZ).alias("end_time"))
