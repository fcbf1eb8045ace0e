"""Formats, extensions and file names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    code: str
    label: str
    aliases: tuple[str, ...] = ()
    styles: bool = False
    inline: bool = False
    positions: bool = False
    needs_end: bool = True

    @property
    def extension(self) -> str:
        return self.code


#: In the order of registration, which breaks ties in detection.
FORMATS: dict[str, Format] = {
    f.code: f
    for f in (
        Format("srt", "SRT", ("subrip",), inline=True),
        Format("vtt", "WebVTT", ("webvtt",), inline=True),
        Format("lrc", "LRC", needs_end=False),
        Format("ass", "ASS", ("advancedsubstation",), styles=True, inline=True, positions=True),
        Format("ssa", "SSA", ("substation",), styles=True, inline=True, positions=True),
        Format("sbv", "SBV"),
    )
}

# Extensions of media files that a target name may lose.
MEDIA = (
    "aac", "ape", "flac", "m4a", "mp3", "oga", "ogg", "opus", "wav", "wma",
    "avi", "flv", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv",
)


def extensions() -> dict[str, str]:
    """Every registered extension with its format's code."""
    return {e: f.code for f in FORMATS.values() for e in (f.extension, *f.aliases)}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*\z", "")


def extension_of(path: Column) -> Column:
    """Lower-case text after the last dot of the name; none: empty."""
    name = F.lower(base_name(path))
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def format_of(path: Column) -> Column:
    """Format code of a path, a name or a bare extension, aliases included; null if unknown."""
    name = F.lower(base_name(F.trim(path)))
    ext = F.substring_index(name, ".", -1)
    table = F.create_map(*[F.lit(x) for pair in extensions().items() for x in pair])
    return F.try_element_at(table, ext)


def format_by_label(text: Column) -> Column:
    """Format code by label or code, whatever the case; no aliases."""
    out = F.lit(None).cast("string")
    for f in FORMATS.values():
        out = F.when(F.lower(F.trim(text)).isin(f.label.lower(), f.code), F.lit(f.code)).otherwise(out)
    return out


def admitted(path: Column) -> Column:
    """Files without an extension, or with a registered one."""
    return (F.instr(base_name(path), ".") == 0) | extension_of(path).isin(*extensions())


def matches_extension(path: Column, code: str) -> Column:
    """Whether a path, a name or a bare extension is of the format, by its extension or an alias."""
    return F.coalesce(format_of(path) == code, F.lit(False))


def format_by_extension(text: Column) -> Column:
    """Format code by its own extension, with or without a dot; aliases don't count."""
    ext = F.lower(F.ltrim(F.trim(text), F.lit(".")))
    return F.when(ext.isin(*[f.extension for f in FORMATS.values()]), ext)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot does not begin one."""
    return F.regexp_replace(base_name(path), r"(?<=[\s\S])\.[^.]*\z", "")


def strip_media(name: Column) -> Column:
    """Without one trailing media extension, unless nothing would be left."""
    return F.regexp_replace(name, r"(?i)(?<=[\s\S])\.(?:" + "|".join(MEDIA) + r")\z", "")


def target_name(path: Column, extension: Column, media: bool = False) -> Column:
    base = strip_media(stem(path)) if media else stem(path)
    return F.concat(base, F.lit("."), extension)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def normalized_path(path: Column) -> Column:
    """Without doubled separators, ``.`` steps and the separator at the end."""
    p = F.regexp_replace(F.trim(path), r"/+", "/")
    p = F.regexp_replace(p, r"(?:(?<=/)|\A)(?:\./)+", "")
    return F.regexp_replace(p, r"(?<=.)/\.?\z", "")


def absolute_path(path: Column, folder: str) -> Column:
    """One spelling for all of one file: a relative path below ``folder``, normalized, with its ``..`` steps taken."""
    rooted = path.rlike(r"\A(?:[/\\]|[A-Za-z][A-Za-z0-9+.-]*:[/\\])")
    p = normalized_path(F.when(rooted, path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path)))
    none = F.expr("cast(array() as array<string>)")
    back = lambda a, x: F.when((x == "..") & (F.size(a) > 1), F.slice(a, F.lit(1), F.size(a) - 1)).when(x == "..", a).otherwise(F.array_append(a, x))
    return F.when(p.rlike(r"/\.\.(?:/|\z)"), F.array_join(F.aggregate(F.split(p, "/"), none, back), "/")).otherwise(p)
