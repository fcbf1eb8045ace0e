"""Formats of one's own: what a name means, how its texts are told, parsed and written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from cueflow.functions.names import FORMATS, Format, extensions
from cueflow.operators.detect import SIGNATURES, Signature
from cueflow.plans.parse import PARSERS
from cueflow.plans.write import WRITERS


def register_format(fmt: Format, parse: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame], signatures: Sequence[Signature] = ()) -> None:
    """Makes ``fmt`` known to detection, names, parsing, writing and conversion, in this Python process.

    ``parse`` takes a table with column ``text`` and adds title, language, fields, styles, cues and error
    (see ``plans.parse``); ``write`` takes such a table and adds ``content``. Both should be narrow.
    It comes last in the order that breaks ties. A code or extension that is taken is an error.
    """
    taken = {fmt.code, fmt.extension, *fmt.aliases} & {*FORMATS, *extensions()}
    if taken:
        raise ValueError(f"registered already: {sorted(taken)}")
    foreign = {s.fmt for s in signatures} - {fmt.code}
    if foreign:
        raise ValueError(f"signatures of other formats: {sorted(foreign)}")
    FORMATS[fmt.code], PARSERS[fmt.code], WRITERS[fmt.code] = fmt, parse, write
    SIGNATURES.extend(signatures)


def unregister_format(code: str) -> None:
    for registry in (FORMATS, PARSERS, WRITERS):
        registry.pop(code, None)
    SIGNATURES[:] = [s for s in SIGNATURES if s.fmt != code]
