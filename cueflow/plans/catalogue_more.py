"""More queries of the catalogue: long documents, inspection, numbers, positions, marks, and the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.operators import loss, model
from cueflow.plans import sql_functions
from cueflow.plans.catalogue import _EVT, _INVERTED, _conv, _detected_sql, _inverted, _rendered, _written, cues_evt, query, read
from cueflow.plans.parse import parse
from cueflow.plans.write import write
from cueflow.sources.encoding import encode
from cueflow.sources.files import inspect

_THIRD = "CASE WHEN cue_seq % 3 = 0 THEN -1 ELSE doc_id END"


@query(
    f"""WITH {_EVT}, d AS (SELECT {_THIRD} AS doc_id, cue_seq AS seq, start_ms, text FROM e)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS cue_seq, start_ms, CASE WHEN lead(start_ms) OVER w > start_ms THEN lead(start_ms) OVER w ELSE start_ms + 5000 END AS end_ms, text FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, seq)"""
)
def long_document_sorted_and_filled(spark, sf_dir):
    """A third of all cues are one document's, which no task holds."""
    cues = cues_evt(spark, sf_dir).withColumn("doc_id", F.expr(_THIRD).cast("bigint"))
    return model.sort_and_fill(cues, "doc_id").select("doc_id", "cue_seq", "start_ms", "end_ms", "text")


_KIND = "CASE id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-8 BOM' ELSE 'UTF-16 LE' END"


@query(f"SELECT id, format, score, CAST(n_evidence AS INTEGER) AS n_evidence, ext_matched, {_KIND} AS encoding, id % 3 <> 0 AS had_bom FROM ({_detected_sql('*')})")
def inspect_files(spark, sf_dir):
    """Files of all formats as bytes in three encodings: what they are, without being parsed."""
    text, kind = F.col("text"), F.col("id") % 3
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    content = F.when(kind == 0, encode(text)).when(kind == 1, encode(text, bom=True)).otherwise(wide)
    files = _rendered(spark, sf_dir).withColumn("content", content).select("id", "path", F.octet_length("content").cast("bigint").alias("length"), "content")
    # The id rides along in the path, which is looked at by its name alone.
    found = inspect(files.withColumn("path", F.concat(F.col("id").cast("string"), F.lit("/"), "path")))
    number = F.split("path", "/")[0].cast("bigint")
    return found.select(number.alias("id"), "format", "score", F.size("evidence").alias("n_evidence"), "ext_matched", "encoding", "had_bom")


_NUMBER = "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || '.50' WHEN 2 THEN p_name ELSE '-' || p_size || 'e1' END"


@query(f"SELECT p_partkey AS id, {_NUMBER} AS raw, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + CAST(0.5 AS DOUBLE) WHEN 3 THEN -10 * CAST(p_size AS DOUBLE) END AS value FROM part")
def numeric_fields(spark, sf_dir):
    raw = F.expr(_NUMBER)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), model.numeric_field(raw).alias("value"))


@query(
    f"""WITH {_conv()}, a AS (SELECT doc_id, CAST(count(*) FILTER (WHERE {_INVERTED} < start_ms) AS VARCHAR) AS n, bool_or({_INVERTED} IS NOT NULL) AS ends FROM c GROUP BY doc_id), t AS (SELECT * FROM (VALUES ('srt'), ('lrc')) AS v(target))
    SELECT doc_id, target, concat_ws(',', CASE WHEN target = 'lrc' AND ends THEN 'lrcEndTimesDropped:1' END, CASE WHEN n <> '0' THEN 'invertedCueTiming:' || n END) AS warnings FROM a, t"""
)
def loss_of_inverted_cues(spark, sf_dir):
    """Cues that end before they start are told of whatever the formats, with their number."""
    found = loss.loss_of_cues(_inverted(spark, sf_dir).withColumn("style_ref", F.lit(None).cast("string")), ("srt", "lrc"), "doc_id", source="srt")
    one = lambda w: F.concat(w["kind"], F.lit(":"), w["count"].cast("string"))
    return found.select("doc_id", "target", F.array_join(F.transform("warnings", one), ",").alias("warnings"))


@query("SELECT doc_id, 'EFBBBF' || hex(encode(text)) AS marked, hex(encode(text)) AS plain FROM documents")
def encode_with_mark(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.hex(encode(F.col("text"), bom=True)).alias("marked"), F.hex(encode(F.col("text"))).alias("plain"))


@query(
    r"""WITH p AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations)
    SELECT conv_id, turn, CASE WHEN k = 1 THEN 8 END AS alignment, CASE k WHEN 0 THEN CAST(turn AS DOUBLE) WHEN 1 THEN 3.0 WHEN 4 THEN 7.25 END AS x, CASE k WHEN 0 THEN turn + 0.5 WHEN 1 THEN 4.0 WHEN 4 THEN -1.0 END::DOUBLE AS y,
           CASE k WHEN 0 THEN '{\pos(' || turn || ',' || turn || '.5)}' WHEN 1 THEN '{\an8}{\pos(3,4)}' WHEN 4 THEN '{\pos(7.25,-1)}' ELSE '' END || 'word ' || turn AS again FROM p"""
)
def positions_through_ass(spark, sf_dir):
    """Override blocks with positions: two numbers, whole ones without their point, too few, no numbers, the last of several."""
    turn = F.col("turn").cast("string")
    mark = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("{\\pos("), turn, F.lit(" , "), turn, F.lit(".5)}")))
        .when(F.col("conv_id") % 5 == 1, F.lit("{\\an8\\pos(3.0,4)}"))
        .when(F.col("conv_id") % 5 == 2, F.lit("{\\pos(5)}"))
        .when(F.col("conv_id") % 5 == 3, F.lit("{\\pos(a,b)}"))
        .otherwise(F.lit("{\\pos(1,2)\\t(0,10,\\fs(3))\\pos(7.25,-1)}"))
    )
    head = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,"
    texts = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(head), mark, F.lit("word "), turn).alias("text"))
    docs = write(parse(texts, "ass").withColumn("first", F.get("cues", F.lit(0))), "ass")
    again = F.regexp_extract("content", r"Dialogue: (?:[^,]*,){9}([^\n]*)", 1)
    return docs.select("conv_id", "turn", "first.position.alignment", "first.position.x", "first.position.y", again.alias("again"))


_CUES = f"WITH {_conv()} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cue_seq) - 1 AS INTEGER) AS cue_seq, start_ms, end_ms, text FROM c"


def _by_table_function(spark, sf_dir, fmt):
    sql_functions.register(spark)
    _written(spark, sf_dir, fmt).withColumnRenamed("content", "text").createOrReplaceTempView(f"cueflow_{fmt}_files")
    return spark.sql(f"SELECT f.doc_id, c.cue_seq, c.start_ms, c.end_ms, c.text FROM cueflow_{fmt}_files f, LATERAL parse_{fmt}(f.text) c")


@query(_CUES)
def sql_parse_srt(spark, sf_dir):
    return _by_table_function(spark, sf_dir, "srt")


@query(_CUES)
def sql_parse_sbv(spark, sf_dir):
    return _by_table_function(spark, sf_dir, "sbv")


