"""Catalogue queries: each runs operators over subtitle data derived from the given tables.

``SQL`` holds the same results in DuckDB's SQL, written from the rules rather than from the Spark code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions import names, timecode
from cueflow.functions import text as tx
from cueflow.functions.emphasis import scanned_html
from cueflow.operators import detect, loss, model, paths
from cueflow.plans import convert as cv
from cueflow.plans.parse import by_format, cues_of, documents_from_cues, parse
from cueflow.plans.write import write
from cueflow.sources.encoding import decode
from cueflow.sources.staging import spread, staged

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived cues ---------------------------------------------------------------------------------


def cues_conv(spark: SparkSession, sf_dir: str, flat: bool = True) -> DataFrame:
    """Turns of conversations as cues one after another; ``flat`` takes line breaks out."""
    t = read(spark, sf_dir, "conversations")
    dur = F.lit(1000) + 40 * F.length("text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(dur).over(before), F.lit(0)).cast("bigint")
    text = F.replace("text", F.lit("\n"), F.lit(" ")) if flat else F.col("text")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("bigint").alias("cue_seq"), start.alias("start_ms"), (start + dur - 200).cast("bigint").alias("end_ms"), text.alias("text"), F.col("role").alias("style_ref"))


def cues_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues without ends."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("cue_seq"), F.floor(us / 1000).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"), F.col("event_type").alias("text")
    )


def _conv(flat: bool = True) -> str:
    text = "replace(text, chr(10), ' ')" if flat else "text"
    return f"""base AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS cue_seq, {text} AS text, role AS style_ref, 1000 + 40 * length(text) AS dur FROM conversations),
        timed AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY doc_id ORDER BY cue_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM base),
        c AS (SELECT doc_id, cue_seq, start_ms, CAST(start_ms + dur - 200 AS BIGINT) AS end_ms, text, style_ref FROM timed)"""


_EVT = "e AS (SELECT user_id AS doc_id, event_id AS cue_seq, CAST((epoch_us(ts) - 1704067200000000) // 1000 AS BIGINT) AS start_ms, event_type AS text FROM events)"


def _time(ms: str, sep: str = ".", digits: int = 3, hours: int = 2) -> str:
    cut = {3: 1, 2: 10, 1: 100}[digits]
    return f"printf('%0{hours}d:%02d:%02d{sep}%0{digits}d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000 // {cut})"


def _minutes(ms: str) -> str:
    return f"printf('%02d:%02d.%02d', {ms} // 60000, {ms} // 1000 % 60, {ms} % 1000 // 10)"


# --- time -----------------------------------------------------------------------------------------


@query(f"WITH {_conv()} SELECT doc_id, cue_seq, {_time('start_ms', ',')} AS srt, {_time('start_ms')} AS vtt, {_time('start_ms', hours=1)} AS sbv, {_time('start_ms', digits=2, hours=1)} AS ass, {_minutes('start_ms')} AS lrc, {_time('start_ms', digits=1)} AS tenths FROM c")
def timestamp_format_all(spark, sf_dir):
    s = F.col("start_ms")
    return cues_conv(spark, sf_dir).select("doc_id", "cue_seq", timecode.srt_time(s).alias("srt"), timecode.vtt_time(s).alias("vtt"), timecode.sbv_time(s).alias("sbv"), timecode.ass_time(s).alias("ass"), timecode.lrc_time(s).alias("lrc"), timecode.format_ms(s, ".", 1).alias("tenths"))


@query(f"WITH {_conv()} SELECT doc_id, cue_seq, start_ms AS srt_ms, start_ms // 10 * 10 AS ass_ms, CASE WHEN start_ms < 3600000 THEN start_ms // 10 * 10 END AS lrc_ms, CAST(NULL AS BIGINT) AS two_as_three FROM c")
def timestamp_parse_roundtrip(spark, sf_dir):
    s = F.col("start_ms")
    return cues_conv(spark, sf_dir).select(
        "doc_id", "cue_seq",
        timecode.parse_ms(timecode.srt_time(s)).alias("srt_ms"), timecode.parse_ms(timecode.ass_time(s)).alias("ass_ms"),
        timecode.parse_ms(timecode.lrc_time(s), 2).alias("lrc_ms"), timecode.parse_ms(timecode.lrc_time(s), 3).alias("two_as_three"),
    )


_EDGES = ["00:00:01,500", " 1 : 2 : 3 . 4 ", "01:02.5", "01:02:03", "00:60:00.0", "999:59:59.999999", "1000:00:00.0", "00:00:01", "", "a:00:01.0", "00:00:01:5", "0:0:0.1", "61:00.1", "00:00:01.0x"]
_CLOCK = r"^\s*(\d{1,3})\s*:\s*([0-5]?\d)(?:\s*:\s*([0-5]?\d))?\s*[.,:]\s*(\d{1,6})\s*$"


def _parsed(raw: str, fields: int) -> str:
    g = [f"regexp_extract({raw}, '{_CLOCK}', {k})" for k in range(1, 5)]
    n = [f"TRY_CAST({x} AS BIGINT)" for x in g]
    part = f"TRY_CAST(rpad(substr({g[3]}, 1, 3), 3, '0') AS BIGINT)"
    three = f"(({n[0]} * 3600 + {n[1]} * 60 + {n[2]}) * 1000 + {part})"
    if fields == 3:
        return f"CASE WHEN {g[3]} <> '' THEN {three} END"
    return f"CASE WHEN {g[3]} = '' THEN NULL WHEN {g[2]} <> '' THEN {three} WHEN {n[0]} <= 59 THEN ({n[0]} * 60 + {n[1]}) * 1000 + {part} END"


# Each event takes one of the edge cases, or its own time in one of the notations.
_RAW = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_EDGES)) + " WHEN 14 THEN user_id % 700 || ':' || event_id % 60 || ':' || user_id % 60 || '.' || event_id % 1000 ELSE event_id % 90 || ' : ' || user_id % 75 || ' , ' || event_id END"


@query(f"WITH r AS (SELECT event_id, {_RAW} AS raw FROM events) SELECT event_id, raw, {_parsed('raw', 3)} AS three, {_parsed('raw', 2)} AS two FROM r")
def timestamp_parse_edge(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.expr(_RAW).alias("raw"))
    return df.select("event_id", "raw", timecode.parse_ms(F.col("raw")).alias("three"), timecode.parse_ms(F.col("raw"), 2).alias("two"))


# --- relational -----------------------------------------------------------------------------------


def _shift(ms: int) -> str:
    return f"WITH {_conv()} SELECT doc_id, cue_seq, greatest(0, start_ms + ({ms})) AS start_ms, CASE WHEN cue_seq % 3 <> 0 THEN greatest(0, end_ms + ({ms})) END AS end_ms FROM c"


def _shifted(spark, sf_dir, ms):
    c = cues_conv(spark, sf_dir).withColumn("end_ms", F.when(F.col("cue_seq") % 3 != 0, F.col("end_ms")))
    return model.shift(c, ms).select("doc_id", "cue_seq", "start_ms", "end_ms")


@query(_shift(-5000))
def shift_clamp_negative(spark, sf_dir):
    return _shifted(spark, sf_dir, -5000)


@query(_shift(1500))
def shift_clamp_positive(spark, sf_dir):
    return _shifted(spark, sf_dir, 1500)


@query(f"WITH {_EVT}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, cue_seq) AS nx FROM e) SELECT doc_id, cue_seq, start_ms, CASE WHEN nx > start_ms THEN nx ELSE start_ms + 5000 END AS end_ms, text FROM n")
def resolve_missing_ends(spark, sf_dir):
    return model.resolve_missing_ends(cues_evt(spark, sf_dir), "doc_id")


@query(f"WITH {_EVT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, cue_seq) - 1 AS INTEGER) AS cue_seq, start_ms, text FROM e")
def sort_by_start_rank(spark, sf_dir):
    return model.sort_by_start(cues_evt(spark, sf_dir), "doc_id").select("doc_id", "cue_seq", "start_ms", "text")


@query(f"WITH {_conv()} SELECT doc_id, cue_seq, text FROM c WHERE cue_seq % 4 <> 1 AND cue_seq % 4 <> 2")
def visible_filter(spark, sf_dir):
    blank = F.when(F.col("cue_seq") % 4 == 1, F.lit(" \t\u00a0\u3000\n")).when(F.col("cue_seq") % 4 == 2, F.lit("\ufeff")).otherwise(F.col("text"))
    return model.visible(cues_conv(spark, sf_dir).withColumn("text", blank)).select("doc_id", "cue_seq", "text")


_INVERTED = "CASE WHEN cue_seq % 2 = 1 THEN start_ms - 1 WHEN cue_seq % 6 = 0 THEN NULL ELSE end_ms END"


def _inverted(spark, sf_dir):
    c = cues_conv(spark, sf_dir)
    return c.withColumn("end_ms", F.when(F.col("cue_seq") % 2 == 1, F.col("start_ms") - 1).when(F.col("cue_seq") % 6 == 0, F.lit(None)).otherwise(F.col("end_ms")))


@query(f"WITH {_conv()} SELECT doc_id, cue_seq, start_ms, {_INVERTED} AS end_ms FROM c WHERE {_INVERTED} < start_ms")
def malformed_filter(spark, sf_dir):
    return model.malformed(_inverted(spark, sf_dir)).select("doc_id", "cue_seq", "start_ms", "end_ms")


@query(f"WITH {_conv()} SELECT doc_id, CAST(count(*) FILTER (WHERE {_INVERTED} < start_ms) AS BIGINT) AS inverted, CAST(count(*) AS BIGINT) AS n_cues, CAST(count({_INVERTED}) AS BIGINT) AS n_ends FROM c GROUP BY doc_id")
def inverted_count(spark, sf_dir):
    return _inverted(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("end_ms") < F.col("start_ms")).alias("inverted"), F.count(F.lit(1)).alias("n_cues"), F.count("end_ms").alias("n_ends"))


@query(f"WITH {_conv()} SELECT doc_id, cue_seq, style_ref, CASE WHEN style_ref = 'user' THEN 'first' END AS look FROM c")
def style_lookup(spark, sf_dir):
    c = cues_conv(spark, sf_dir)
    of = lambda seq, name, look: c.select("doc_id").distinct().select("doc_id", F.lit(seq).alias("style_seq"), F.lit(name).alias("name"), F.array(F.struct(F.lit("look").alias("k"), F.lit(look).alias("v"))).alias("fields"))
    styles = of(0, "user", "first").unionAll(of(1, "user", "second")).unionAll(of(2, "USER", "third"))
    return model.with_style(c, styles, "doc_id").select("doc_id", "cue_seq", "style_ref", F.get("style_fields", F.lit(0))["v"].alias("look"))


@query("SELECT s_suppkey AS id, v.wanted, CASE v.wanted WHEN 'Title' THEN s_name WHEN 'title' THEN 'b' WHEN 'TITLE' THEN s_name WHEN 'Lang' THEN CAST(s_nationkey AS VARCHAR) END AS found FROM supplier, (VALUES ('Title'), ('title'), ('TITLE'), ('Lang'), ('none')) AS v(wanted)")
def ci_field_lookup(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    fields = F.array(pair("Title", F.col("s_name")), pair("title", F.lit("b")), pair("lang", F.col("s_nationkey")))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), fields.alias("fields"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("wanted"), tx.field_ci(F.col("fields"), k).alias("found")) for k in ("Title", "title", "TITLE", "Lang", "none")]))
    return rows.select("id", each.alias("one")).select("id", "one.*")


# --- text -----------------------------------------------------------------------------------------

_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?\s*>"


@query(f"SELECT page_id, regexp_replace(regexp_replace(html, '{_TAG}', '', 'g'), '\\r\\n?', chr(10), 'g') AS text FROM pages")
def strip_html_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


def _decoded(c: str) -> str:
    for name, value in tx.ENTITIES.items():
        c = f"regexp_replace({c}, '(?i)&{name};', chr({ord(value)}), 'g')"
    return c


@query(f"SELECT page_id, {_decoded('html')} AS text FROM pages")
def decode_entities_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.decode_entities(F.col("html")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def escape_entities(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.escape_entities(F.col("text")).alias("text"))


_WRAPS = ["{\\an8}%s", "{\\b1}%s{\\b0}", "%s{\\pos(10,20)}", "{C:\\path}%s", "{comment}%s", "%s {\\i1"]


def _wrap_sql(c: str) -> str:
    cases = " ".join(f"WHEN {i} THEN replace('{w}', '%s', {c})" for i, w in enumerate(_WRAPS))
    return f"CASE doc_id % {len(_WRAPS)} {cases} END"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_wrap_sql('text')}, '{tx.OVERRIDE_BLOCK}', '', 'g'), '(?m){tx.OVERRIDE_TO_LINE_END.replace('(?=' + chr(92) + 'n|' + chr(92) + 'z)', '$')}', '', 'g') AS text FROM documents")
def strip_ass_overrides(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    wrapped = F.lit(None).cast("string")
    for i, w in enumerate(_WRAPS):
        wrapped = F.when(F.col("doc_id") % len(_WRAPS) == i, F.replace(F.lit(w), F.lit("%s"), F.col("text"))).otherwise(wrapped)
    return d.select("doc_id", tx.strip_overrides(wrapped).alias("text"))


_ESCAPED = "replace(replace(replace(replace(text, chr(10), '\\N'), '{', '\\{'), '}', '\\}'), chr(160), '\\h')"


@query(f"SELECT conv_id, turn, {_ESCAPED} AS text FROM conversations")
def ass_escape_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.ass_escape(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, text || ' {x}' || chr(10) || chr(160) || 'tail' AS text FROM conversations")
def ass_unescape_text(spark, sf_dir):
    raw = F.concat(F.lit("{\\an8}"), tx.ass_escape(F.concat("text", F.lit(" {x}\n\u00a0tail"))), F.lit("{note}"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.ass_plain(raw).alias("text"))


_LETTERS = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query(
    f"""WITH w AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, {_LETTERS} AS t FROM conversations)
    SELECT conv_id, turn, CASE k WHEN 0 THEN CASE WHEN length(t) > 0 THEN '0-' || length(t) || ':italic|' ELSE '' END || (length(t) + 5) || '-' || (length(t) + 9) || ':bold' WHEN 1 THEN '0-2:bold|2-3:bold+italic|3-4:italic'
           WHEN 2 THEN '0-' || (4 + length(t)) || ':underline' WHEN 3 THEN '' ELSE '0-2:strikethrough' END AS ranges,
           CASE k WHEN 0 THEN t || ' and bold' WHEN 1 THEN 'abcd' || t WHEN 2 THEN 'open' || t WHEN 3 THEN 'x' || t ELSE chr(131072) || 'y' || t END AS text FROM w"""
)
def inline_style_ranges(spark, sf_dir):
    """Turns within emphasis that nests, crosses, stays open, encloses nothing, or holds a character of two units."""
    t, k = F.regexp_replace("text", "[^A-Za-z ]", ""), (F.col("conv_id") + F.col("turn")) % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("<i>"), t, F.lit("</i> and <b>bold</b>")))
        .when(k == 1, F.concat(F.lit("<b>ab<i>c</b>d</i>"), t))
        .when(k == 2, F.concat(F.lit("<u>open"), t))
        .when(k == 3, F.concat(F.lit("x</b><b></b>"), t))
        .otherwise(F.concat(F.lit("<s>\U00020000</s>y"), t))
    )
    s = scanned_html(raw)
    one = lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit(":"), F.array_join(r["styles"], "+"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("s.inline_styles", one), "|").alias("ranges"), F.col("s.text").alias("text"))


# --- formats --------------------------------------------------------------------------------------


def _written(spark, sf_dir, fmt, cues=None):
    docs = documents_from_cues(cues if cues is not None else cues_conv(spark, sf_dir), "doc_id", fmt=fmt)
    return write(docs, fmt).select("doc_id", "content")


def _reparsed(spark, sf_dir, fmt, cues=None):
    texts = _written(spark, sf_dir, fmt, cues).withColumnRenamed("content", "text")
    return cues_of(parse(texts, fmt), "doc_id")


_AGG = "string_agg(%s, %s ORDER BY cue_seq)"
_SHOWN = "WHERE trim(text) <> ''"


def _joined(block: str, sep: str = "chr(10) || chr(10)") -> str:
    return f"string_agg({block}, {sep} ORDER BY cue_seq)"


@query(f"WITH {_conv(False)}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) AS k FROM c {_SHOWN}) SELECT doc_id, {_joined('k || chr(10) || ' + _time('start_ms', ',') + chr(32) + '|| chr(32) || ' + repr('-->') + ' || chr(32) || ' + _time('end_ms', ',') + ' || chr(10) || text')} || chr(10) AS content FROM n GROUP BY doc_id")
def srt_write(spark, sf_dir):
    return _written(spark, sf_dir, "srt", cues_conv(spark, sf_dir, False))


_CUES = f"WITH {_conv()} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) - 1 AS INTEGER) AS cue_seq, start_ms, end_ms, text FROM c"


@query(_CUES.replace("text FROM c", "text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) AS VARCHAR) AS srt_index FROM c"))
def srt_parse(spark, sf_dir):
    return _reparsed(spark, sf_dir, "srt").select("doc_id", "cue_seq", "start_ms", "end_ms", "text", F.get("metadata", F.lit(0))["v"].alias("srt_index"))


@query(f"WITH {_conv(False)} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_cues, CAST(sum(start_ms) AS BIGINT) AS starts, CAST(sum(end_ms) AS BIGINT) AS ends, CAST(0 AS BIGINT) AS differing FROM c GROUP BY doc_id")
def srt_roundtrip(spark, sf_dir):
    once = _reparsed(spark, sf_dir, "srt", cues_conv(spark, sf_dir, False))
    before = cues_conv(spark, sf_dir, False).withColumn("cue_seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("cue_seq")) - 1).cast("int")).select("doc_id", "cue_seq", F.col("text").alias("was"))
    both = once.join(before, ["doc_id", "cue_seq"], "left")
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cues"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.count_if(~F.col("text").eqNullSafe(F.col("was"))).alias("differing"))


_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"WITH {_conv()} SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || {_joined(_time('start_ms') + ' || chr(32) || ' + repr('-->') + ' || chr(32) || ' + _time('end_ms') + ' || chr(10) || ' + _ESC)} || chr(10) AS content FROM c {_SHOWN} GROUP BY doc_id")
def vtt_write(spark, sf_dir):
    return _written(spark, sf_dir, "vtt")


@query(_CUES)
def vtt_parse(spark, sf_dir):
    return _reparsed(spark, sf_dir, "vtt").select("doc_id", "cue_seq", "start_ms", "end_ms", "text")


@query(f"WITH {_conv()} SELECT doc_id, {_joined(_time('start_ms', hours=1) + ' || chr(44) || ' + _time('end_ms', hours=1) + ' || chr(10) || text')} || chr(10) AS content FROM c {_SHOWN} GROUP BY doc_id")
def sbv_write(spark, sf_dir):
    return _written(spark, sf_dir, "sbv")


@query(_CUES)
def sbv_parse(spark, sf_dir):
    return _reparsed(spark, sf_dir, "sbv").select("doc_id", "cue_seq", "start_ms", "end_ms", "text")


def _near(spark, sf_dir):
    """Events within the hour that the format can name."""
    return cues_evt(spark, sf_dir).withColumn("start_ms", F.col("start_ms") % 3_600_000)


@query(f"WITH {_EVT} SELECT doc_id, string_agg('[' || {_minutes('(start_ms % 3600000)')} || ']' || text, chr(10) ORDER BY start_ms % 3600000, cue_seq) || chr(10) AS content FROM e GROUP BY doc_id")
def lrc_write(spark, sf_dir):
    return _written(spark, sf_dir, "lrc", _near(spark, sf_dir))


@query(
    f"""WITH {_EVT}, m AS (SELECT doc_id, cue_seq * 2 + k AS seq, (start_ms % 3600000 // 10 * 10 + k * 1000) % 3600000 AS s, text FROM e, (VALUES (0), (1)) AS v(k)),
    r AS (SELECT *, row_number() OVER w - 1 AS n, lead(s) OVER w AS nx FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s, seq))
    SELECT doc_id, CAST(n AS INTEGER) AS cue_seq, CAST(s AS BIGINT) AS start_ms, CAST(CASE WHEN nx > s THEN nx ELSE s + 5000 END AS BIGINT) AS end_ms, text FROM r"""
)
def lrc_parse_multi_tag(spark, sf_dir):
    s = F.col("start_ms")
    line = F.concat(F.lit("["), timecode.lrc_time(s), F.lit("]["), timecode.lrc_time((s + 1000) % 3_600_000), F.lit("]<00:01.00>"), F.col("text"))
    lines = spread(_near(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cue_seq", line.alias("line")))).alias("l"))
    texts = lines.select("doc_id", F.concat(F.lit("[ti:x]\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    return cues_of(parse(texts, "lrc"), "doc_id").select("doc_id", "cue_seq", "start_ms", "end_ms", "text")


def _ass_sql(dialect: str) -> str:
    from cueflow.plans import write as w

    x, y = w.PLAY_RES[dialect]
    head = f"[Script Info]\nScriptType: {w.SCRIPT_TYPE[dialect]}\nTitle: \nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: {x}\nPlayResY: {y}\n\n{w.STYLE_SECTION[dialect]}\n"
    head += f"Format: {', '.join(w.STYLE_FIELDS[dialect])}\nStyle: {','.join(w.STYLE_DEFAULTS[f] for f in w.STYLE_FIELDS[dialect])}\n\n[Events]\nFormat: {', '.join(w.EVENT_FIELDS[dialect])}\n"
    layer = "0" if dialect == "ass" else "Marked=0"
    block = f"'Dialogue: {layer},' || {_time('start_ms', digits=2, hours=1)} || ',' || {_time('end_ms', digits=2, hours=1)} || ',' || style_ref || ',,0,0,0,,' || {_ESCAPED} || chr(10)"
    return f"WITH {_conv(False)} SELECT doc_id, '{head}' || {_joined(block, repr(''))} AS content FROM c {_SHOWN} GROUP BY doc_id"


@query(_ass_sql("ass"))
def ass_write(spark, sf_dir):
    return _written(spark, sf_dir, "ass", cues_conv(spark, sf_dir, False))


@query(_ass_sql("ssa"))
def ssa_write(spark, sf_dir):
    return _written(spark, sf_dir, "ssa", cues_conv(spark, sf_dir, False))


@query(f"WITH {_conv(False)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) - 1 AS INTEGER) AS cue_seq, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, text, style_ref, '0' AS layer FROM c")
def ass_parse(spark, sf_dir):
    out = _reparsed(spark, sf_dir, "ass", cues_conv(spark, sf_dir, False))
    return out.select("doc_id", "cue_seq", "start_ms", "end_ms", "text", "style_ref", tx.field_ci(F.col("metadata"), "Layer").alias("layer"))


# --- detection, names -----------------------------------------------------------------------------

_FORMATS = list(names.FORMATS)


def _rendered(spark, sf_dir):
    """Conversations in all six formats under a name without extension or with a misleading one."""
    docs = documents_from_cues(cues_conv(spark, sf_dir), "doc_id")
    for fmt in _FORMATS:
        docs = write(docs, fmt).withColumnRenamed("content", f"as_{fmt}")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(fmt).alias("truth"), F.col(f"as_{fmt}").alias("text")) for i, fmt in enumerate(_FORMATS)]))
    out = docs.select("doc_id", each.alias("one")).select((F.col("doc_id") * 6 + F.col("one.i")).alias("id"), "one.truth", "one.text")
    name = F.when(F.col("id") % 4 == 0, F.lit("file")).when(F.col("id") % 4 == 1, F.concat(F.lit("file."), F.col("truth"))).when(F.col("id") % 4 == 2, F.lit("FILE.SRT")).otherwise("x.substation")
    return out.withColumn("path", name)


_TRUE_SCORE = {"srt": 60, "vtt": 140, "lrc": 60, "ass": 360, "ssa": 260, "sbv": 60}
_EXT = "CASE id % 4 WHEN 1 THEN truth WHEN 2 THEN 'srt' WHEN 3 THEN 'ssa' ELSE '' END"


def _detected_sql(columns: str) -> str:
    """Scores of the rendered formats by rule: own signatures, what they share with others, and the name."""
    shared = {("vtt", "vtt"): 140, ("srt", "srt"): 60, ("sbv", "sbv"): 60, ("lrc", "lrc"): 60, ("ass", "ass"): 360, ("ass", "ssa"): 60, ("ssa", "ssa"): 260, ("ssa", "ass"): 160}
    rows = ", ".join(f"('{t}', '{f}', {w}, {n})" for (t, f), w in shared.items() for n in [{("ass", "ass"): 4, ("ssa", "ssa"): 3, ("ssa", "ass"): 2, ("vtt", "vtt"): 2}.get((t, f), 1)])
    order = ", ".join(f"('{f}', {i})" for i, f in enumerate(_FORMATS))
    # A lone conversation of one cue has a single stamped line, which its format needs two of.
    return f"""WITH d AS (SELECT conv_id, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id),
    o AS (SELECT * FROM (VALUES {order}) AS v(fmt, ord)), w AS (SELECT * FROM (VALUES {rows}) AS v(truth, fmt, weight, ev)),
    t AS (SELECT conv_id * 6 + ord AS id, fmt AS truth, n FROM d, o),
    s AS (SELECT t.id, t.truth, o.fmt, o.ord, CASE WHEN t.truth = 'lrc' AND t.n < 2 THEN 0 ELSE coalesce(w.weight, 0) END + CASE WHEN {_EXT.replace('truth', 't.truth').replace('id %', 't.id %')} = o.fmt THEN 30 ELSE 0 END AS score,
          {_EXT.replace('truth', 't.truth').replace('id %', 't.id %')} = o.fmt AS ext, CASE WHEN t.truth = 'lrc' AND t.n < 2 THEN 0 ELSE coalesce(w.ev, 0) END AS ev
          FROM t CROSS JOIN o LEFT JOIN w ON w.truth = t.truth AND w.fmt = o.fmt),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ext DESC, ev DESC, ord) AS rk FROM s),
    p AS (SELECT a.id, a.truth, CASE WHEN a.score > 0 THEN a.fmt END AS format, CAST(a.score AS INTEGER) AS score, CASE WHEN a.score > 0 THEN a.ev ELSE 0 END AS n_evidence, a.score > 0 AND a.ext AS ext_matched,
          CASE WHEN a.score > 0 AND b.score > 0 THEN b.fmt END AS runner_up, CASE WHEN a.score > 0 AND b.score > 0 THEN CAST(b.score AS INTEGER) ELSE 0 END AS runner_up_score, a.score > 0 AND b.score > 0 AND a.score = b.score AS ambiguous
          FROM r a JOIN r b ON a.id = b.id AND a.rk = 1 AND b.rk = 2)
    SELECT {columns} FROM p"""


@query(_detected_sql("id, truth, format, score, CAST(n_evidence AS INTEGER) AS n_evidence, ext_matched"))
def detect_format(spark, sf_dir):
    return detect.detect(_rendered(spark, sf_dir)).select("id", "truth", "format", "score", F.size("evidence").alias("n_evidence"), "ext_matched")


@query(_detected_sql("id, truth, runner_up, runner_up_score, ambiguous"))
def detect_runner_up_ambiguous(spark, sf_dir):
    return detect.detect(_rendered(spark, sf_dir)).select("id", "truth", "runner_up", "runner_up_score", "ambiguous")


_NAMES = "SELECT p_partkey AS id, replace(p_name, ' ', '_') || CASE p_partkey % 8 WHEN 0 THEN '.srt' WHEN 1 THEN '.en.VTT' WHEN 2 THEN '' WHEN 3 THEN '.mp4.ass' WHEN 4 THEN '.txt' WHEN 5 THEN '.MKV' WHEN 6 THEN '.SubRip' ELSE '.ts.lrc' END AS name FROM part"
_EXT_OF = "CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END"
_REGISTERED = ", ".join(f"'{e}'" for e in names.extensions())


def _names(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("cueflow_part")
    return spark.sql(_NAMES.replace("FROM part", "FROM cueflow_part"))


_TO_FORMAT = " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in names.extensions().items())


@query(f"SELECT id, name, {_EXT_OF} AS ext, {_EXT_OF} = '' OR {_EXT_OF} IN ({_REGISTERED}) AS admitted FROM ({_NAMES})")
def format_admission(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("id", "name", names.extension_of(n).alias("ext"), names.admitted(n).alias("admitted"))


@query(f"SELECT id, {_EXT_OF} AS ext, CASE {_EXT_OF} {_TO_FORMAT} END AS format FROM ({_NAMES})")
def extension_of(spark, sf_dir):
    n = F.concat(F.lit("/some/dir.d/"), F.col("name"))
    return _names(spark, sf_dir).select("id", names.extension_of(n).alias("ext"), names.format_of(n).alias("format"))


_STEM = "CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END"
_MEDIA = "(?i)^(.+)[.](?:" + "|".join(names.MEDIA) + ")$"


@query(f"SELECT id, regexp_replace(name, '{_MEDIA}', '\\1') AS bare FROM ({_NAMES})")
def strip_media_suffix(spark, sf_dir):
    return _names(spark, sf_dir).select("id", names.strip_media(F.col("name")).alias("bare"))


@query(f"SELECT id, {_STEM} || '.vtt' AS plain, regexp_replace({_STEM}, '{_MEDIA}', '\\1') || '.vtt' AS stripped FROM ({_NAMES})")
def target_name(spark, sf_dir):
    n, ext = F.concat(F.lit("/in/"), F.col("name")), F.lit("vtt")
    return _names(spark, sf_dir).select("id", names.target_name(n, ext).alias("plain"), names.target_name(n, ext, True).alias("stripped"))


_RENAMED = "SELECT p_partkey AS pos, '/in/f' || CASE WHEN p_partkey % 3 = 0 THEN 'all' ELSE CAST(CAST(floor(p_partkey / 100) AS INTEGER) AS STRING) END || CASE p_partkey % 4 WHEN 0 THEN '.ass' WHEN 1 THEN '.sbv' ELSE '.lrc' END AS path FROM part"


@query(
    f"""WITH f AS ({_RENAMED.replace('STRING', 'VARCHAR')}), k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(path, '[.][^.]*$', '') ORDER BY pos) - 1 + CASE WHEN regexp_replace(path, '[.][^.]*$', '') = '/in/f7' THEN 2 ELSE 0 END AS n FROM f)
    SELECT pos, path, CASE WHEN n <= 500 THEN 'write' ELSE 'skip' END AS action, CASE WHEN n <= 500 THEN regexp_replace(path, '[.][^.]*$', '') || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.srt' END AS output_path, n BETWEEN 1 AND 500 AS renamed FROM k"""
)
def auto_rename(spark, sf_dir):
    """Hundreds of inputs ask for one name and a third of all for another; some names exist, and numbers end at 500."""
    read(spark, sf_dir, "part").createOrReplaceTempView("cueflow_part")
    files = spark.sql(_RENAMED.replace("FROM part", "FROM cueflow_part"))
    there = spark.sql("SELECT path FROM VALUES ('/in/f7.srt'), ('/in/f7 (1).srt') AS v(path)")
    out = paths.assign(paths.requested(files, F.lit("srt")), there, "autoRename")
    return out.select("pos", "path", "action", "output_path", "renamed")


# Five rows after another share a stem, so sources repeat, and a source is asked for by its own rows and by others.
_POLICY = "SELECT p_partkey AS pos, '/in/f' || CAST(CAST(floor(p_partkey / 5) AS INTEGER) AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '.srt' ELSE '.sbv' END AS path FROM part"
_EXISTING = "SELECT '/in/f' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.srt' ELSE ' (1).srt' END AS path FROM part WHERE p_partkey % 3 <> 1"


@query(
    f"""WITH f AS (SELECT *, replace(path, '.sbv', '.srt') AS requested, path LIKE '%.srt' AS own FROM ({_POLICY.replace('STRING', 'VARCHAR')})), e AS ({_EXISTING.replace('STRING', 'VARCHAR')}),
    a AS (SELECT f.*, e0.path IS NOT NULL AS there, CASE WHEN e1.path IS NULL THEN 0 ELSE 1 END AS shift, min(CASE WHEN NOT own THEN pos END) OVER (PARTITION BY requested) AS first
          FROM f LEFT JOIN e e0 ON e0.path = requested LEFT JOIN e e1 ON e1.path = replace(requested, '.srt', ' (1).srt')),
    w AS (SELECT *, NOT own AND NOT there AND pos = first AS plain FROM a),
    n AS (SELECT *, row_number() OVER (PARTITION BY requested, plain ORDER BY pos) + shift AS k, row_number() OVER (PARTITION BY requested, own ORDER BY pos) + shift AS k_own FROM w)
    SELECT pos, path, 'skip' AS policy, CASE WHEN plain THEN 'write' ELSE 'skip' END AS action, CASE WHEN plain THEN requested END AS output_path, FALSE AS renamed FROM n
    UNION ALL SELECT pos, path, 'overwrite', 'write', CASE WHEN own THEN replace(path, '.srt', ' (' || k_own || ').srt') ELSE requested END, own FROM n
    UNION ALL SELECT pos, path, 'autoRename', 'write', CASE WHEN plain THEN requested ELSE replace(requested, '.srt', ' (' || k || ').srt') END, NOT plain FROM n"""
)
def name_policies(spark, sf_dir):
    """All three policies, with repeated sources, sources that are among the names asked for, and names that exist."""
    read(spark, sf_dir, "part").createOrReplaceTempView("cueflow_part")
    files = spark.sql(_POLICY.replace("FROM part", "FROM cueflow_part"))
    there = spark.sql(_EXISTING.replace("FROM part", "FROM cueflow_part"))
    each = [paths.assign(paths.requested(files, F.lit("srt")), there, p).select("pos", "path", F.lit(p).alias("policy"), "action", "output_path", "renamed") for p in ("skip", "overwrite", "autoRename")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT min(page_id) AS pos, split_part(url, '/', -1) AS name FROM pages GROUP BY 2")
def dedupe_paths(spark, sf_dir):
    """Pages under one file name are one path, written in several ways."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.element_at(F.split("url", "/"), -1).alias("name"))
    path = F.concat(F.when(F.col("pos") % 2 == 0, F.lit("/a//b/./")).otherwise("/a/b/"), F.col("name"), F.lit("/"))
    return paths.dedupe(p.withColumn("path", path)).select("pos", "name")


# --- bytes, loss, batches -------------------------------------------------------------------------

_BYTES = [("", "UTF-8", "", False), ("EFBBBFE4B8ADE69687", "UTF-8 BOM", "\u4e2d\u6587", True), ("FFFE2D4E8765", "UTF-16 LE", "\u4e2d\u6587", True), ("41004200", "UTF-16 LE", "AB", False), ("2D4E8765", "UTF-16 LE", "\u4e2d\u6587", False),
    ("4E2D6587", "UTF-16 BE", "\u4e2d\u6587", False), ("FFFE000048000000690000002D4E0000", "UTF-32 LE", "Hi\u4e2d", True), ("0000FEFF0000004800000069", "UTF-32 BE", "Hi", True), ("D6D0CEC4", "GBK", "\u4e2d\u6587", False),
    ("95328236", "GB18030", "\U00020000", False), ("93FA967B", "Shift_JIS", "\u65e5\u672c", False), ("636166E9", "Windows-1252", "caf\u00e9", False), ("FFFEFFFFFF", None, None, False), ("818D90", None, None, False), ("4101E9", "Windows-1252", "A\u0001\u00e9", False), ("0101E9", None, None, False), ("8FB0A1A4A2", "EUC-JP", "\u4e02\u3042", False)]
_NULL = lambda v: "NULL" if v is None else f"'{v}'"


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{h}{chr(39)}, {_NULL(e)}, {_NULL(t)}, {b})' for h, e, t, b in _BYTES)}) AS v(hex, encoding, text, had_bom) UNION ALL SELECT 'doc' || doc_id, 'UTF-16 LE', text, TRUE FROM documents UNION ALL SELECT 'utf8-' || doc_id, 'UTF-8', text, FALSE FROM documents")
def encoding_detect(spark, sf_dir):
    literal = spark.sql(f"SELECT hex, unhex(hex) AS content FROM VALUES {', '.join(f'({chr(39)}{x[0]}{chr(39)})' for x in _BYTES)} AS v(hex)")
    d = read(spark, sf_dir, "documents")
    wide = d.select(F.concat(F.lit("doc"), "doc_id").alias("hex"), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")).alias("content"))
    plain = d.select(F.concat(F.lit("utf8-"), "doc_id").alias("hex"), F.encode("text", "UTF-8").alias("content"))
    return decode(literal.unionAll(wide).unionAll(plain)).select("hex", "encoding", "text", "had_bom")


_TARGETS = ", ".join(f"('{f}')" for f in _FORMATS)


@query(
    f"""WITH {_conv(False)}, a AS (SELECT doc_id, bool_or(contains(text, chr(10))) AS br, bool_or(end_ms IS NOT NULL) AS en, bool_or(style_ref <> '') AS st FROM c GROUP BY doc_id)
    SELECT doc_id, target, concat_ws(',', CASE WHEN target NOT IN ('ass', 'ssa') AND st THEN 'namedStylesDropped:1' END, CASE WHEN target = 'lrc' AND br THEN 'lrcLineBreaksJoined:1' END, CASE WHEN target = 'lrc' AND en THEN 'lrcEndTimesDropped:1' END) AS warnings
    FROM a, (VALUES {_TARGETS}) AS v(target)"""
)
def loss_report(spark, sf_dir):
    found = loss.loss_of_cues(cues_conv(spark, sf_dir, False), _FORMATS, "doc_id", source="ass")
    one = lambda w: F.concat(w["kind"], F.lit(":"), w["count"].cast("string"))
    return found.select("doc_id", "target", F.array_join(F.transform("warnings", one), ",").alias("warnings"))


_RESULT = "CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'succeeded' END"


@query(
    f"""WITH r AS (SELECT o_orderpriority AS batch, {_RESULT} AS status, o_orderkey % 2 = 0 AS warned FROM orders),
    g AS (SELECT batch, CAST(count(*) FILTER (WHERE status = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS skipped,
          CAST(count(*) FILTER (WHERE status = 'succeeded' AND warned) AS BIGINT) AS lossy, CAST(count(*) AS BIGINT) AS completed, CAST(count(*) AS BIGINT) AS total FROM r GROUP BY batch)
    SELECT *, concat_ws(', ', CASE WHEN succeeded > 0 THEN succeeded || ' succeeded' END, CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END) || '.' || CASE WHEN lossy > 0 THEN ' ' || lossy || ' lost some styling.' ELSE '' END AS summary FROM g"""
)
def batch_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    warning = F.array(F.struct(F.lit("positionsDropped").alias("kind"), F.lit(1).alias("count")))
    status = F.when(k % 7 == 0, "failed").when(k % 5 == 0, "skipped").otherwise("succeeded")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), status.alias("status"), F.when(k % 2 == 0, warning).otherwise(F.expr("cast(array() as array<struct<kind:string,count:int>>)")).alias("warnings"))
    return cv.batch_counts(rows, "batch")


@query(
    f"""WITH {_conv()} SELECT doc_id, CAST(count(*) AS INTEGER) AS cue_count, '' AS failure, md5('WEBVTT' || chr(10) || chr(10) || {_joined(_time('start_ms') + " || ' --> ' || " + _time('end_ms') + ' || chr(10) || ' + _ESC)} || chr(10)) AS content
    FROM c {_SHOWN} GROUP BY doc_id UNION ALL SELECT -1, 0, 'invalidSubtitleSyntax', NULL"""
)
def convert_srt_to_vtt(spark, sf_dir):
    """Files of one format, one of them broken, into another; failures as values."""
    texts = _written(spark, sf_dir, "srt").withColumnRenamed("content", "text")
    bad = spark.sql("SELECT CAST(-1 AS BIGINT) AS doc_id, 'no cues here' AS text")
    done = cv.convert_texts(texts.unionAll(bad), "srt", "vtt")
    return done.select("doc_id", "cue_count", F.coalesce("error.failure", F.lit("")).alias("failure"), F.md5("content").alias("content"))


def _within_hour(spark, sf_dir):
    return cues_conv(spark, sf_dir).withColumn("start_ms", F.col("start_ms") % 3_000_000).withColumn("end_ms", F.col("start_ms") + 900)


#: Cues as each format keeps them: (doc_id, cue_seq, text, fmt, s, e); one without ends fills them from the next start.
_KEPT = f"""{_conv()}, near AS (SELECT doc_id, cue_seq, text, start_ms % 3000000 AS s, start_ms % 3000000 + 900 AS e FROM c {_SHOWN}), v AS (SELECT * FROM (VALUES {_TARGETS}) AS v(fmt)),
    cut AS (SELECT doc_id, cue_seq, text, fmt, CASE WHEN fmt IN ('lrc', 'ass', 'ssa') THEN s // 10 * 10 ELSE s END AS s, CASE WHEN fmt IN ('lrc', 'ass', 'ssa') THEN e // 10 * 10 ELSE e END AS e FROM near, v),
    nxt AS (SELECT *, lead(s) OVER (PARTITION BY doc_id, fmt ORDER BY s, cue_seq) AS nx FROM cut),
    kept AS (SELECT doc_id, cue_seq, text, fmt, s, CASE WHEN fmt <> 'lrc' THEN e WHEN nx > s THEN nx ELSE s + 5000 END AS e FROM nxt)"""


@query(
    f"""WITH {_KEPT}, cut2 AS (SELECT doc_id, cue_seq, text, kept.fmt AS source, v.fmt AS target, CASE WHEN v.fmt IN ('lrc', 'ass', 'ssa') THEN s // 10 * 10 ELSE s END AS s, CASE WHEN v.fmt IN ('lrc', 'ass', 'ssa') THEN e // 10 * 10 ELSE e END AS e FROM kept, v),
    nxt2 AS (SELECT *, lead(s) OVER (PARTITION BY doc_id, source, target ORDER BY s, cue_seq) AS nx FROM cut2)
    SELECT source, target, CAST(count(DISTINCT doc_id) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS cues, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(CASE WHEN target <> 'lrc' THEN e WHEN nx > s THEN nx ELSE s + 5000 END) AS BIGINT) AS ends,
           CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS failed FROM nxt2 GROUP BY 1, 2"""
)
def convert_matrix(spark, sf_dir):
    """Every format into every format, and the output parsed again.

    Each step is one table with a branch for each format, so that 24 small plans do the work of 36 long ones.
    """
    docs = documents_from_cues(_within_hour(spark, sf_dir), "doc_id")
    for fmt in _FORMATS:
        docs = write(docs, fmt).withColumnRenamed("content", f"as_{fmt}")
    # A column for each format, so that a branch reads no other's texts.
    texts = staged(docs.select("doc_id", *[f"as_{f}" for f in _FORMATS]), "texts")
    source = lambda f: parse(texts.select("doc_id", F.lit(f).alias("source"), F.col(f"as_{f}").alias("text")), f)
    parsed = staged(reduce(DataFrame.unionByName, map(source, _FORMATS)), "parsed")
    target = lambda f: cv.converted_documents(parsed, F.col("source"), f).select("doc_id", "source", F.lit(f).alias("target"), F.col("content").alias("text"), F.col("error").alias("before"))
    done = staged(reduce(DataFrame.unionByName, map(target, _FORMATS)), "converted")
    again = by_format(done, "target", lambda f, mine: parse(mine, f))
    total = lambda value: F.aggregate("cues", F.lit(0).cast("bigint"), lambda a, c: a + value(c))
    one = again.select("source", "target", F.size("cues").alias("n"), total(lambda c: c["start_ms"]).alias("s"), total(lambda c: c["end_ms"]).alias("e"), total(lambda c: F.length(c["text"])).alias("t"), (F.col("error").isNotNull() | F.col("before").isNotNull()).alias("bad"))
    return one.groupBy("source", "target").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("cues"), F.sum("s").alias("starts"), F.sum("e").alias("ends"), F.sum("t").alias("chars"), F.count_if("bad").alias("failed"))


_OF = "['srt', 'vtt', 'lrc', 'ass', 'ssa', 'sbv'][doc_id % 6 + 1]"
#: Files that fail: position, name, bytes in hex, and the failure.
_BROKEN = [(-1, "bad.srt", "6E6F20637565732068657265", "invalidSubtitleSyntax"), (-2, "gone.srt", None, "readFailed"), (-3, "odd.srt", "FFFEFFFFFF", "encodingDetectionFailed"), (-4, "notes.txt", "68656C6C6F", "unsupportedFormat"), (-5, "none.vtt", "5745425654540A", "emptyDocument")]


@query(
    f"""WITH {_KEPT}, mine AS (SELECT * FROM kept WHERE fmt = {_OF}),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN fmt = 'lrc' THEN s ELSE 0 END, cue_seq) AS k FROM mine)
    SELECT doc_id AS pos, '/in/' || doc_id || '.' || fmt AS source_path, 'succeeded' AS status, fmt AS source_format, '/in/' || doc_id || CASE WHEN fmt = 'srt' THEN ' (1)' ELSE '' END || '.srt' AS output_path, CAST(count(*) AS INTEGER) AS cue_count,
           CASE WHEN fmt IN ('ass', 'ssa') THEN 'namedStylesDropped' ELSE '' END AS kinds, '' AS failure,
           md5(string_agg(k || chr(10) || {_time('s', ',')} || ' --> ' || {_time('e', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10)) AS output FROM k GROUP BY doc_id, fmt
    UNION ALL SELECT pos, '/in/' || name, 'failed', NULL, NULL, 0, '', failure, NULL FROM (VALUES {', '.join(f"({n}, '{name}', '{failure}')" for n, name, _, failure in _BROKEN)}) AS b(pos, name, failure)"""
)
def convert_batch(spark, sf_dir):
    """The whole way from bytes of mixed formats to results, with files that fail in every way."""
    docs = documents_from_cues(_within_hour(spark, sf_dir), "doc_id")
    for fmt in _FORMATS:
        docs = write(docs, fmt).withColumnRenamed("content", f"as_{fmt}")
    order = ["srt", "vtt", "lrc", "ass", "ssa", "sbv"]
    own = F.get(F.array(*[F.struct(F.lit(f).alias("fmt"), F.col(f"as_{f}").alias("text")) for f in order]), (F.col("doc_id") % 6).cast("int"))
    files = docs.select("doc_id", own.alias("own")).select(F.col("doc_id").alias("pos"), F.concat(F.lit("/in/"), "doc_id", F.lit("."), "own.fmt").alias("path"), F.encode("own.text", "UTF-8").alias("content"))
    broken = ", ".join(f"({n}, '/in/{name}', {_NULL(h)})" for n, name, h, _ in _BROKEN)
    bad = spark.sql(f"SELECT CAST(pos AS BIGINT) AS pos, path, unhex(hex) AS content FROM VALUES {broken} AS v(pos, path, hex)")
    existing = files.select("path").unionByName(bad.select("path"))
    out = cv.convert(files.unionByName(bad), cv.Options(target="srt"), existing)
    kinds = F.array_join(F.transform("warnings", lambda w: w["kind"]), ",").alias("kinds")
    return out.select("pos", "source_path", "status", "source_format", "output_path", "cue_count", kinds, F.coalesce("failure", F.lit("")).alias("failure"), F.md5("output").alias("output"))


# --- headers, styles, emphasis --------------------------------------------------------------------


@query(
    f"""WITH {_conv()} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) - 1 AS INTEGER) AS cue_seq, 'Talk ' || doc_id AS title, 'de' AS language, 'captions' AS kind, start_ms, end_ms, 'id-' || cue_seq AS identifier, 'align:start line:' || cue_seq AS settings, text FROM c {_SHOWN}"""
)
def vtt_header_and_blocks(spark, sf_dir):
    """WebVTT with a title, fields, notes, styles, regions, identifiers and settings."""
    c = cues_conv(spark, sf_dir).filter(tx.has_visible_text(F.col("text")))
    block = F.concat(F.lit("NOTE about "), "cue_seq", F.lit("\n\nid-"), "cue_seq", F.lit("\n"), timecode.vtt_time(F.col("start_ms")), F.lit(" --> "), timecode.vtt_time(F.col("end_ms")), F.lit(" align:start line:"), "cue_seq", F.lit("\n"), tx.escape_entities(F.col("text")))
    head = F.concat(F.lit("WEBVTT\nTalk "), "doc_id", F.lit("\nKind: captions\nLanguage: de\n\nSTYLE\n::cue { color: red }\n\nREGION\nid:r\n\n"))
    rows = spread(c.select("doc_id", "cue_seq", block.alias("block")), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cue_seq", "block"))).alias("b"))
    docs = parse(rows.select("doc_id", F.concat(head, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("text")), "vtt")
    cues = cues_of(docs.withColumn("kind", tx.field_ci(F.col("fields"), "kind")), "doc_id", "title", "language", "kind")
    of = lambda k: F.get(F.filter("metadata", lambda e: e["k"] == k), F.lit(0))["v"]
    return cues.select("doc_id", "cue_seq", "title", "language", "kind", "start_ms", "end_ms", of("vtt.identifier").alias("identifier"), of("vtt.settings").alias("settings"), "text")


_DIALECTS = "(VALUES ('ass', 'v4.00+', '[V4+ Styles]', 'Layer', '3'), ('ssa', 'v4.00', '[V4 Styles]', 'Marked', 'Marked=0')) AS d(dialect, script, section, first, layer)"


@query(
    f"""WITH {_conv()} SELECT doc_id, dialect, CAST(row_number() OVER (PARTITION BY doc_id, dialect ORDER BY cue_seq) - 1 AS INTEGER) AS cue_seq, 'T ' || doc_id AS title, '640' AS width, 'Main,Side' AS styles, '#' || doc_id AS colour, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, layer, text FROM c, {_DIALECTS} {_SHOWN}"""
)
def ass_info_and_styles(spark, sf_dir):
    """ASS and SSA with script information, two styles, comments, and columns in another order."""
    c = cues_conv(spark, sf_dir).filter(tx.has_visible_text(F.col("text"))).join(F.broadcast(spark.sql(f"SELECT * FROM {_DIALECTS}")))
    line = F.concat(F.lit("Dialogue: "), "layer", F.lit(","), timecode.ass_time(F.col("start_ms")), F.lit(","), timecode.ass_time(F.col("end_ms")), F.lit(",Main,"), tx.ass_escape(F.col("text")))
    rows = spread(c.select("doc_id", "dialect", "script", "section", "first", "cue_seq", line.alias("line")), "doc_id").groupBy("doc_id", "dialect", "script", "section", "first").agg(F.array_sort(F.collect_list(F.struct("cue_seq", "line"))).alias("l"))
    head = F.concat(F.lit("[Script Info]\n; a remark\nTitle: T "), "doc_id", F.lit("\nScriptType: "), "script", F.lit("\nPlayResX: 640\n\n"), "section", F.lit("\nFormat: Name, PrimaryColour\nStyle: Main,#"), "doc_id", F.lit("\nStyle: Side,0\n\n[Events]\nFormat: "), "first", F.lit(", Start, End, Style, Text\nComment: 0,0:00:00.00,0:00:01.00,Main,not shown\n"))
    texts = rows.select("doc_id", "dialect", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    docs = by_format(texts, "dialect", lambda f, mine: parse(mine, f), ["ass", "ssa"])
    docs = docs.withColumns({"width": tx.field_ci(F.col("fields"), "playresx"), "styles": F.array_join(F.transform("styles", lambda x: x["name"]), ","), "colour": tx.field_ci(F.get("styles", F.lit(0))["fields"], "primarycolour")})
    cues = cues_of(docs, "doc_id", "dialect", "title", "width", "styles", "colour")
    layer = F.coalesce(tx.field_ci(F.col("metadata"), "Layer"), tx.field_ci(F.col("metadata"), "Marked"))
    return cues.select("doc_id", "dialect", "cue_seq", "title", "width", "styles", "colour", "start_ms", "end_ms", layer.alias("layer"), "text")


_WORD = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query(
    f"""WITH {_conv()}, w AS (SELECT doc_id, cue_seq, 'w' || trim({_WORD}) AS t FROM c)
    SELECT doc_id, cue_seq, md5('1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || '<b>' || t || '</b> and <i>more</i>' || chr(10)) AS srt, 'WEBVTT' || chr(10) || 'ScriptType: v4.00+' || chr(10) || chr(10) || '00:00:01.000 --> 00:00:02.000' || chr(10) || '<b>' || t || '</b> and <i>more</i>' || chr(10) AS vtt,
           'Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{{\\an8}}{{\\b1}}' || t || '{{\\b0}} and {{\\i1}}more{{\\i0}}' AS ass, '00:01.00' AS lrc_at, t || ' and more' AS lrc, 'positionsDropped,namedStylesDropped' AS to_srt, 'inlineStylesDropped,positionsDropped,namedStylesDropped' AS to_sbv FROM w"""
)
def emphasis_through_writers(spark, sf_dir):
    """A line with a position and emphasis, from ASS into the other formats, with what each loses."""
    cues = cues_conv(spark, sf_dir)
    t = F.concat(F.lit("w"), F.trim(F.regexp_replace("text", "[^A-Za-z ]", "")))
    head = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name\nStyle: Default\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\an8}{\\b1}"
    texts = cues.select("doc_id", "cue_seq", F.concat(F.lit(head), t, F.lit("{\\b0} and {\\i1}more{\\i0}\n")).alias("text"))
    docs = parse(texts, "ass")
    docs = docs.withColumns({f"to_{f}": F.array_join(F.transform(loss.loss_of(F.lit("ass"), F.lit(f)), lambda w: w["kind"]), ",") for f in ("srt", "sbv")})
    for f in ("srt", "vtt", "ass", "lrc"):
        docs = write(docs, f).withColumnRenamed("content", f"as_{f}")
    return docs.select("doc_id", "cue_seq", F.md5("as_srt").alias("srt"), F.col("as_vtt").alias("vtt"), F.regexp_extract("as_ass", r"(Dialogue: .*)", 1).alias("ass"), F.regexp_extract("as_lrc", r"\[(\d[\d:.]+)\]", 1).alias("lrc_at"), F.regexp_extract("as_lrc", r"\[\d[\d:.]+\](.*)", 1).alias("lrc"), "to_srt", "to_sbv")


@query(f"WITH {_conv()} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_cues, FALSE AS is_empty, CAST(sum(end_ms - start_ms) AS BIGINT) AS shown_ms FROM c GROUP BY doc_id")
def document_counts(spark, sf_dir):
    docs = documents_from_cues(cues_conv(spark, sf_dir), "doc_id")
    shown = F.aggregate("cues", F.lit(0).cast("bigint"), lambda a, c: a + timecode.duration_ms(c["start_ms"], c["end_ms"]))
    return model.counts(docs.withColumn("shown_ms", shown), "doc_id", "shown_ms").select("doc_id", "n_cues", "is_empty", "shown_ms")


from cueflow.plans import catalogue_more  # noqa: E402, F401  (registers its queries)
