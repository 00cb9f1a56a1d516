"""Registered queries of scalar functions, files and tools, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions import text as X
from ..functions import tools
from ..functions import vectors as V
from ..session import table, with_instants
from ..sources import files
from .catalog import _messages, _register

_NTZ = "timestamp_ntz"

# Text ----------------------------------------------------------------------------------


@_register("select doc_id, case when length(text) > 100 then substring(text, 1, 100) || '... [truncated]' else text end as shown from documents")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 100).alias("shown"))


@_register("select doc_id, case when length(text) > 0 then substring(text, 1, 200) || '...' else '' end as shown from documents where text is not null")
def preview_always(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.preview(F.col("text"), always=True).alias("shown"))


@_register(r"select page_id, regexp_replace(regexp_replace(string_split_regex(url, '[/\\]')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '^\.+', '') as name from pages")
def safe_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@_register("select p_partkey, substr(translate(md5(p_name || chr(1) || p_brand), '0123456789', 'ghijklmnop'), 1, 1) || substr(md5(p_name || chr(1) || p_brand), 2, 7) as short from part")
def short_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.short_id(F.col("p_name"), F.col("p_brand"), size=8).alias("short"))


@_register("select conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, e'\\n', '|'), '|'), lambda x: trim(x, ' ')), lambda x: x <> ''), ' > ') as path from conversations where text is not null")
def steps_and_paths(spark, d):
    """Steps of a text as a list, shown as a path (2.10)."""
    steps = X.steps_list(F.col("text"))
    return _messages(spark, d).where("text is not null").select("conv_id", "turn", X.path_text(steps).alias("path"))


@_register(r"select doc_id, regexp_matches(case when doc_id % 3 = 0 then 'Line ' || doc_id || ': x' else text end, '^\s*Line \d+:') as refused from documents where text is not null")
def line_numbers_refused(spark, d):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Line "), F.col("doc_id").cast("string"), F.lit(": x"))).otherwise(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.has_line_numbers(content).alias("refused"))


@_register("select doc_id, coalesce(nullif(substring(text, 1, 1000), ''), '(no text detected)') as shown from documents")
def prompt_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.prompt_text(F.col("text")).alias("shown"))


@_register("select doc_id, substring(text, 1, 48) as head from documents")
def first_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_tokens(F.col("text"), 12).alias("head"))


@_register(r"""
with s as (select conv_id, turn, generate_subscripts(l, 1) p, unnest(l) s from (select conv_id, turn, list_filter(string_split_regex(text, '[\s]+'), lambda x: x <> '') l from conversations where text is not null)),
c as (select conv_id, turn, p, unnest(range(0, (length(s) - 1) // 5 + 1)) k, s from s)
select conv_id, turn, count(*) as chunks, max(length(substring(s, k * 5 + 1, 5)))::bigint as longest from c group by all""")
def word_chunks(spark, d):
    """Chunks of at most five characters: every word a sentence of its own."""
    held = _messages(spark, d).where("text is not null").select("conv_id", "turn", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"))
    parts = held.select("conv_id", "turn", F.explode(X.sentence_chunks(F.col("word"), 5)).alias("chunk"))
    return parts.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("chunk")).cast("long").alias("longest"))


@_register("""
select conv_id, turn, trim(concat_ws(e'\\n', coalesce(text, ''), '[Image: ' || turn || ']', '[File: f]', '[Cloud File: g]', '[Unknown content type: sound]')) as shown from conversations where coalesce(text, '') not like ' %'""")
def typed_parts(spark, d):
    """Messages of several kinds of parts (2.10)."""
    kinds = {"text": F.col("text"), "image_url": F.col("turn").cast("string"), "file_uri": F.lit("f"), "google_cloud_file_uri": F.lit("g"), "sound": F.lit("s")}
    parts = F.array(*(F.struct(F.lit(k).alias("type"), v.alias("value")) for k, v in kinds.items()))
    return _messages(spark, d).where(~F.coalesce("text", F.lit("")).startswith(" ")).select("conv_id", "turn", X.parts_text(parts).alias("shown"))


@_register("select event_id, case when event_id % 5 = 4 then null else json_extract_string(props, '$.k')::bigint end as k from events")
def tolerant_json(spark, d):
    """Objects as they are, in a fence of text, with a trailing comma, with single quotes, and none (2.10)."""
    n, props = F.col("event_id") % 5, F.col("props")
    told = (
        F.when(n == 0, props)
        .when(n == 1, F.concat(F.lit("Here it is: "), props, F.lit(" done")))
        .when(n == 2, F.regexp_replace(props, r"\}\s*$", ",}"))
        .when(n == 3, F.translate(props, '"', "'"))
        .otherwise(F.lit("no object here"))
    )
    return table(spark, d, "events").select("event_id", X.json_object(told, "k long")["k"].alias("k"))


@_register(r"""
with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x{00a0}]+'), lambda x: x <> '')) w from conversations)
select a.conv_id, a.turn, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(least(len(a.w), len(b.w)), 0), 0), 6) as overlap,
  round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0), 6) as jaccard
from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def turn_similarity(spark, d):
    """Overlap coefficient and Jaccard similarity of each turn with the next (2.10)."""
    words = _messages(spark, d).select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    following = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    both = words.join(following, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(X.overlap(F.col("w"), F.col("v")), 6).alias("overlap"), F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


# Time ----------------------------------------------------------------------------------


@_register("select event_id, strftime(ts, '%Y-%m-%d %I:%M:%S %p') as shown, date_trunc('second', ts) as back, epoch(date_trunc('second', ts))::bigint as seconds, strftime(ts, '%Y-%m-%d') as day from events")
def time_forms(spark, d):
    """A time in twelve hours and back, as seconds, and the date its text begins with (2.10)."""
    events = with_instants(table(spark, d, "events")).withColumn("shown", M.twelve_hour(F.col("ts")))
    return events.select("event_id", "shown", M.from_twelve_hour(F.col("shown")).cast(_NTZ).alias("back"), M.epoch(F.col("ts")).alias("seconds"), M.date_prefix(F.col("ts").cast("string")).alias("day"))


@_register("select event_id, ts + interval 5 hours as at from events where ts < timestamp '2024-03-01'")
def local_times(spark, d):
    """Winter times of New York, some with fractions of a second, as UTC (2.10)."""
    exact = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.when(exact.endswith(".000000"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(exact)
    events = table(spark, d, "events").where(F.col("ts") < F.lit("2024-03-01").cast(_NTZ))
    return events.select("event_id", M.local_to_utc(text, F.lit("America/New_York (UTC-05:00)")).cast(_NTZ).alias("at"))


@_register("select event_id, date_trunc('second', ts) as at from events")
def mixed_instants(spark, d):
    """ISO text with Z and without, and seconds as text, as one instant (2.10)."""
    at = F.date_trunc("second", "ts")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 3 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(M.epoch(at).cast("string"))
    )
    return with_instants(table(spark, d, "events")).select("event_id", M.mixed_instant(text).cast(_NTZ).alias("at"))


@_register("select event_id, case when event_id % 4 = 0 then timestamp '2024-01-01 00:00:00' else ts end as at, ts as again from events")
def utc_fill(spark, d):
    """Zone-less times read as UTC, nulls filled (2.10)."""
    naive = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    filled = M.as_utc(naive, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", filled.cast(_NTZ).alias("at"), M.as_utc(F.col("ts")).cast(_NTZ).alias("again"))


# Files ---------------------------------------------------------------------------------

_EXTENSIONS = ["png", "txt", "bmp", "JPG", "rtf", "mp3", "md", "pptx"]
_UPLOADED = {"png": "image/png", "txt": "text/plain", "bmp": "image/bmp", "JPG": "image/jpeg", "rtf": "application/rtf", "mp3": "application/octet-stream", "md": "application/octet-stream", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
_STORED = {"png": "image/png", "txt": "text/plain", "JPG": "image/jpeg", "md": "text/markdown"}


def _path():
    return F.concat(F.lit("file:///data/f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int")))


_SQL_EXT = "[" + ", ".join(f"'{x}'" for x in _EXTENSIONS) + "][doc_id % 8 + 1]"


def _sql_case(types: dict[str, str]) -> str:
    return "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in types.items()) + " else 'application/octet-stream' end"


@_register(f"""
select doc_id, '/data/f' || doc_id || '.' || ext as path, 'f' || doc_id || '.' || ext as name, lower(ext) as extension, {_sql_case(_UPLOADED)} as uploaded, {_sql_case(_STORED)} as stored
from (select doc_id, {_SQL_EXT} ext from documents)""")
def file_paths(spark, d):
    """Path, name, extension and the types of uploads and of the file store (2.1 #6, #8, #9)."""
    p = _path()
    return table(spark, d, "documents").select(
        "doc_id", files.local_path(p).alias("path"), files.base_name(p).alias("name"), files.extension(p).alias("extension"), files.mime_type(p).alias("uploaded"), files.mime_type(p, files.STORED_MIME).alias("stored")
    )


@_register(f"""
select doc_id, 'data:' || case when ext = 'png' then 'image/png' when ext = 'bmp' then 'image/bmp' else 'image/jpeg' end || ';base64,' || base64(encode(source || ' content')) as uri from (select doc_id, source, {_SQL_EXT} ext from documents) where source is not null""")
def data_uris(spark, d):
    """Bytes as data URIs; what is no image by its name counts as JPEG (2.1 #7)."""
    content = F.encode(F.concat("source", F.lit(" content")), "utf-8")
    return table(spark, d, "documents").where("source is not null").select("doc_id", files.data_uri(_path(), content).alias("uri"))


@_register("select e.event_id, case when e.event_id % 2 = 0 then 'image ' || e.event_id end as image from events e")
def images_by_path(spark, d):
    """Frames with their image's bytes, null where the file is missing (2.1 #6)."""
    events = table(spark, d, "events").select("event_id", F.concat(F.lit("file:///shots/"), F.col("event_id").cast("string")).alias("image_ref"))
    shots = table(spark, d, "events").where("event_id % 2 = 0").select(
        F.concat(F.lit("file:/shots/"), F.col("event_id").cast("string")).alias("path"), F.encode(F.concat(F.lit("image "), F.col("event_id").cast("string")), "utf-8").alias("content")
    )
    return files.with_content(events, shots, "image_ref").select("event_id", F.decode("content", "utf-8").alias("image"))


@_register("select conv_id, '{\"turn\":' || turn || ',\"role\":\"' || role || '\"}' as said, '[1.5,2.0]' as vector from conversations")
def export_columns(spark, d):
    """Nested columns and vectors as JSON (2.1 #11, #13)."""
    vector = F.array(F.lit(1.5), F.lit(2.0)).alias("vector")
    nested = _messages(spark, d).select("conv_id", F.struct("turn", "role").alias("said"), vector)
    return files.flattened(nested, include_embeddings=True)


@_register("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts from events")
def export_times(spark, d):
    return files.flattened(table(spark, d, "events").select("event_id", "ts", F.array(F.lit(0.5)).alias("vector")))


@_register("select 'customer' as name, true as there union all select 'events', true")
def session_catalog(spark, d):
    """Views of the session (2.1 #17)."""
    for name in ("customer", "events"):
        table(spark, d, name).createOrReplaceTempView(name)
    return files.catalog(spark).where(F.col("name").isin("customer", "events")).select("name", F.lit(True).alias("there")).distinct()


# Vectors -------------------------------------------------------------------------------


@_register("select vec_id, round(list_sum(embedding::double[]), 4) as total, true as same from embeddings")
def vector_texts(spark, d):
    """Vectors from three text forms, and of the length that is asked (2.10)."""
    held, n = F.transform("embedding", lambda x: x.cast("string")), F.col("vec_id") % 3
    text = F.when(n == 0, F.concat(F.lit("["), F.array_join(held, ", "), F.lit("]"))).when(n == 1, F.array_join(held, ",")).otherwise(F.array_join(held, " "))
    parsed = V.of_length(V.parse_text(text), 64)
    total = F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 4).alias("total"), (parsed == F.col("embedding").cast("array<float>")).alias("same"))


@_register("select vec_id, 2::int as dims, (vec_id % 100)::double as first from embeddings")
def vector_bytes(spark, d):
    """Little-endian bytes in base64 (2.10): two numbers, the second one zero."""
    bits = {k: V.to_base64([float(k), 0.0]) for k in range(100)}
    coded = F.element_at(F.create_map(*(F.lit(x) for pair in bits.items() for x in pair)), (F.col("vec_id") % 100).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", V.from_base64(coded).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), F.element_at("v", 1).cast("double").alias("first"))


_SQL_COSINE = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


@_register(f"select a.vec_id, round(1 - {_SQL_COSINE}, 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def sql_cosine_distance(spark, d):
    """The registered SQL function (2.12 #1)."""
    V.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("embeddings_of_query")
    return spark.sql(
        "select a.vec_id, round(cosine_distance(cast(a.embedding as array<double>), cast(b.embedding as array<double>)), 6) as distance "
        "from embeddings_of_query a join embeddings_of_query b on b.vec_id = a.vec_id + 1"
    )


# Tools ---------------------------------------------------------------------------------


def repeat_word(word: str, times: int = 2) -> str:
    """Repeat a word.

    Args:
        word: what to repeat
        times: how often
    """
    if times < 0:
        raise ValueError("times is negative")
    return word * times


@_register("""
select event_id, case event_id % 4 when 0 then 'success' when 1 then 'success' else 'error' end as status,
  case event_id % 4 when 0 then repeat(event_type, 3) when 1 then repeat(event_type, 2) when 2 then 'ValueError: times is negative' else 'missing [''word''], unknown [''text'']' end as result from events""")
def tool_calls(spark, d):
    """A registered tool on JSON arguments; a failing call is a row's result (2.12 #2, #5)."""
    registry = tools.Registry(spark)
    registry.add(repeat_word)
    n = F.col("event_id") % 4
    word = F.col("event_type")
    arguments = (
        F.when(n == 0, F.to_json(F.struct(word.alias("word"), F.lit(3).alias("times"))))
        .when(n == 1, F.to_json(F.struct(word.alias("word"))))
        .when(n == 2, F.to_json(F.struct(word.alias("word"), F.lit(-1).alias("times"))))
        .otherwise(F.to_json(F.struct(word.alias("text"))))
    )
    calls = table(spark, d, "events").select("event_id", arguments.alias("arguments"))
    return registry.run(calls, "repeat_word", "arguments").select("event_id", "status", "result")


@_register("select 'repeat_word' as name, 'Repeat a word.' as description, 'string' as word, 'integer' as times, 'word' as required")
def tool_schemas(spark, d):
    registry = tools.Registry(spark)
    registry.add(repeat_word)

    def at(path: str):
        return F.get_json_object("json_schema", f"$.parameters.{path}")

    return registry.table().select("name", "description", at("properties.word.type").alias("word"), at("properties.times.type").alias("times"), at("required[0]").alias("required"))


@_register("""
select event_id, case when event_id % 3 = 2 then null else event_id end as number, event_id % 2 = 0 as truth, event_id || ',1' as members from events""")
def coerced_arguments(spark, d):
    """Arguments given as text, by their type; what doesn't fit is null (2.12 #3, #4)."""
    key = F.col("event_id").cast("string")
    number = tools.coerced(F.when(F.col("event_id") % 3 == 2, F.concat(key, F.lit(".5"))).otherwise(F.concat(F.lit(" "), key)), int)
    truth = tools.coerced(F.when(F.col("event_id") % 2 == 0, "true").otherwise("False"), bool)
    members = tools.coerced(F.concat(F.lit("["), key, F.lit(",1]")), list[int])
    return table(spark, d, "events").select("event_id", number.alias("number"), truth.alias("truth"), F.array_join(members.cast("array<string>"), ",").alias("members"))
