"""Scalar functions."""

from __future__ import annotations

import difflib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that Python's str.strip() removes.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
CUTOFF = 0.7
MEMORY = 100_000


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; trim() knows blanks only."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def duration(seconds: Column) -> Column:
    """1.5h, 2.0min or 30.0s."""
    return (
        F.when(seconds >= 3600, F.format_string("%.1fh", seconds / 3600))
        .when(seconds >= 60, F.format_string("%.1fmin", seconds / 60))
        .otherwise(F.format_string("%.1fs", seconds.cast("double")))
    )


def duration_text(seconds: float) -> str:
    for size, unit in ((3600, "h"), (60, "min")):
        if seconds >= size:
            return f"{seconds / size:.1f}{unit}"
    return f"{seconds:.1f}s"


def prompt(template: str, text: Column, context: Column) -> Column:
    """The user prompt, natively: a format string with {text} and {context} and doubled braces."""
    parts: list[Column] = []
    for literal in re.findall(r"\{\{|\}\}|\{text\}|\{context\}|[^{}]+", template):
        parts.append({"{{": F.lit("{"), "}}": F.lit("}"), "{text}": text, "{context}": context}.get(literal, F.lit(literal)))
    return F.concat(*parts) if parts else F.lit("")


def prompt_hash(text: str | Column) -> Column:
    return F.substring(F.md5(text.cast("binary") if isinstance(text, Column) else F.lit(text).cast("binary")), 1, 8)


def fuzzy_names(categories: list[str], cutoff: float = CUTOFF):
    """A function of an array of names: the closest category of each, or null; a task compares each distinct name once."""

    memory: dict[str, str | None] = {}

    def closest(name: str) -> str | None:
        if name not in memory:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[name] = next(iter(difflib.get_close_matches(name, categories, n=1, cutoff=cutoff)), None)
        return memory[name]

    @F.arrow_udf("array<string>")
    def best(names: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [closest(x) if x is not None else None for x in row] for row in names.to_pylist()], pa.list_(pa.string()))

    return best


def repaired(text: str | None) -> str | None:
    """Strict JSON for text that almost is: fences, prose around it, trailing commas, single quotes, a lost end.

    Null where no JSON value can be made out."""
    if text is None:
        return None
    body = text.strip()
    if fenced := re.search(r"```(?:json)?\s*(.*?)\s*(?:```|$)", body, re.S | re.I):
        body = fenced[1]
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    for candidate in (body, body[start:] if start >= 0 else ""):
        if (value := _load(candidate)) is not _NOTHING:
            return json.dumps(value, ensure_ascii=False, allow_nan=True)
    if start < 0:
        return None
    value = _load(_mended(body[start:]))
    return None if value is _NOTHING else json.dumps(value, ensure_ascii=False, allow_nan=True)


_NOTHING = object


def _load(text: str):
    try:
        return json.JSONDecoder().raw_decode(text.strip())[0] if text.strip() else _NOTHING
    except (ValueError, RecursionError):
        return _NOTHING


def _mended(text: str) -> str:
    """One pass over the characters: closes what is open, drops commas before a close, makes single quotes double."""
    out: list[str] = []
    closing: list[str] = []
    quote, escaped = "", False
    for c in text:
        if quote:
            if escaped:
                escaped = False
                out.append(c if quote == '"' or c != "'" else "'")
                continue
            if c == "\\":
                escaped = True
                out.append(c)
            elif c == quote:
                quote = ""
                out.append('"')
            elif c == '"':
                out.append('\\"')
            elif c == "\n":
                out.append("\\n")
            else:
                out.append(c)
            continue
        if c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            if not closing or closing[-1] != c:
                continue
            closing.pop()
            _drop_comma(out)
            out.append(c)
            if not closing:
                break
        else:
            out.append(c)
    if quote:
        if escaped:
            out.pop()
        out.append('"')
    if closing:
        while out and out[-1].isspace():
            out.pop()
        if out and out[-1] == ":":
            out.append("null")
        _drop_comma(out)
        if closing[-1] == "}" and _key_alone(out):
            out.append(": null")
        out.extend(reversed(closing))
    made = "".join(out)
    for word, value in (("True", "true"), ("False", "false"), ("None", "null")):
        made = re.sub(rf'(?<=[:\[,\s]){word}(?=\s*[,\]}}])', value, made)
    return made


def _drop_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def _key_alone(out: list[str]) -> bool:
    return bool(re.search(r'[{,]\s*"(?:[^"\\]|\\.)*"$', "".join(out[-4000:])))


def repair_json():
    @F.arrow_udf("string")
    def repair(text: pa.Array) -> pa.Array:
        return pa.array([repaired(x) for x in text.to_pylist()], pa.string())

    return repair
