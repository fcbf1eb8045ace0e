"""The engine in SQL: scalar and table functions that Catalyst inlines into a query's plan.

``register(spark)`` makes them known in a session, as temporary functions. ``FROM files, LATERAL parse_srt(text)``
gives a row for each cue: no Python runs, and filters and columns are pushed through. A file that breaks its format's rules gives no rows.
Emphasis and positions are what the DataFrame parsers keep beside the text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cueflow.functions.text import HS, OVERRIDE_BLOCK, OVERRIDE_TO_LINE_END, TAG, WS
from cueflow.functions.timecode import CLOCK
from cueflow.plans.parse import _SRT_BLOCK, _TOKEN_TIME

_VISIBLE = WS.replace("[", "[^", 1)


def _r(pattern: str) -> str:
    """A pattern as a literal."""
    if "'" in pattern:
        raise ValueError(pattern)
    return f"r'{pattern}'"


_PARTS = f"split(regexp_replace(raw, {_r(CLOCK)}, '$1:$2:$3:$4'), ':')"
_N = [f"try_cast(get({_PARTS}, {k}) AS BIGINT)" for k in range(3)]
# A cast that fails throws within, so the field that may be missing is told by its text.
_N[2] = f"CASE WHEN get({_PARTS}, 2) <> '' THEN {_N[2]} END"
_MS = f"try_cast(rpad(get({_PARTS}, 3), 3, '0') AS BIGINT)"
_CLOCK_MS = f"""CASE WHEN raw RLIKE {_r(CLOCK)} THEN coalesce(({_N[0]} * 3600 + {_N[1]} * 60 + ({_N[2]})) * 1000 + {_MS},
    CASE WHEN fields < 3 AND {_N[0]} <= 59 THEN ({_N[0]} * 60 + {_N[1]}) * 1000 + {_MS} END) END"""
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(raw, {_r(OVERRIDE_BLOCK)}, ''), {_r(OVERRIDE_TO_LINE_END)}, ''), {_r(TAG)}, '')"
_BLOCKS = f"""filter(split(regexp_replace(regexp_replace(regexp_replace(content, {_r(chr(92) + "A" + chr(92) + "uFEFF")}, ''), r'\\r\\n?', '\\n'), {_r(rf'\A(?:{HS}*\n)+|(?:\n{HS}*)+\z')}, ''), {_r(rf'\n(?:{HS}*\n)+')}), b -> b RLIKE {_r(_VISIBLE)})"""
_LINE = CLOCK.removeprefix(r"\A").removesuffix(r"\z")
_BARE = _LINE.replace("(\\d", "(?:\\d").replace("([0-5]", "(?:[0-5]")
#: Blocks whose first line gives both times.
_SRT_VALID = rf"\A(?:{HS}*\d+{HS}*\n)?{_BARE}-->[^\n]*?{_TOKEN_TIME}"
_SBV_VALID = rf"\A{_BARE},{_BARE}(?:\n|\z)"

FUNCTIONS = {
    "clock_ms": f"(raw STRING, fields INT) RETURNS BIGINT RETURN {_CLOCK_MS}",
    "plain_text": f"(raw STRING) RETURNS STRING RETURN {_PLAIN}",
    "subtitle_blocks": f"(content STRING) RETURNS ARRAY<STRING> RETURN {_BLOCKS}",
    "parse_srt": f"""(content STRING) RETURNS TABLE (cue_seq INT, start_ms BIGINT, end_ms BIGINT, text STRING, srt_index STRING) RETURN
        SELECT pos, clock_ms(substring_index(line, '-->', 1), 3), clock_ms(regexp_extract(substring(line, instr(line, '-->') + 3), {_r(_TOKEN_TIME)}, 0), 3), plain_text(rest), nullif(number, '') FROM
        (SELECT pos, regexp_extract(block, {_r(_SRT_BLOCK)}, 2) AS line, regexp_extract(block, {_r(_SRT_BLOCK)}, 3) AS rest, regexp_replace(regexp_extract(block, {_r(_SRT_BLOCK)}, 1), r'\\A0+(?=\\d)', '') AS number FROM
        (SELECT posexplode(CASE WHEN forall(blocks, b -> b RLIKE {_r(_SRT_VALID)}) THEN blocks END) AS (pos, block) FROM (SELECT subtitle_blocks(content) AS blocks)))""",
    "parse_sbv": f"""(content STRING) RETURNS TABLE (cue_seq INT, start_ms BIGINT, end_ms BIGINT, text STRING) RETURN
        SELECT pos, clock_ms(substring_index(line, ',', 1), 3), clock_ms(substring(line, instr(line, ',') + 1), 3), plain_text(rest) FROM
        (SELECT pos, substring_index(block, '\\n', 1) AS line, CASE WHEN instr(block, '\\n') > 0 THEN substring(block, instr(block, '\\n') + 1) ELSE '' END AS rest FROM
        (SELECT posexplode(CASE WHEN forall(blocks, b -> b RLIKE {_r(_SBV_VALID)}) THEN blocks END) AS (pos, block) FROM (SELECT subtitle_blocks(content) AS blocks)))""",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known in the session; registering again replaces them."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
