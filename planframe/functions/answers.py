"""Text of model answers: repair of their JSON, numbers; file stems and warning headers."""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A whole string, one that is cut off, a comment, a fence, a mark, a line's end, blanks, and whatever else stands together.
_TOKEN = re.compile(r"""(?P<string>"(?:[^"\\]|\\.)*")|(?P<open>"(?:[^"\\]|\\.)*\\?\Z)|(?P<comment>\#[^\n]*|//[^\n]*)|(?P<fence>```(?:json)?)|(?P<mark>[{}\[\],:])|(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<word>[^\s{}\[\],:"#/`]+|[/`])""", re.S)

#: Words that mean no value.
_NOTHING = ("undefined", "NaN", "Infinity", "-Infinity")


def repaired(text: str | None) -> str | None:
    """The JSON of a model's answer without blanks between its parts, or null if nothing whole can be made of it.

    What stands before the first bracket and after its value is passed over, and so are fences and comments that
    ``#`` or ``//`` start outside of strings. A comma that is missing between values on two lines is put in, one
    before a closing bracket left out; a closing bracket that fits none that is open is left out. undefined, NaN and
    Infinity are null. Where the text ends early, an open string and the open brackets are closed; if that leaves a broken
    last element, all back to the last whole one beside it goes. A list of one object is that object.
    """
    if text is None:
        return None
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    out: list[str] = []
    stack: list[str] = []
    whole: dict[int, int] = {}  # where the last bracket at each depth closed
    ended = line = cut = False  # after a value, after a line's end, in a string that is cut off
    for m in _TOKEN.finditer(text, begin):
        kind, token = m.lastgroup, m.group()
        if kind == "line":
            line = True
        if kind in ("line", "blank", "comment", "fence"):
            continue
        if kind == "mark" and token in "}]":
            if not stack or stack[-1] != token:
                continue
            if out[-1] == ",":
                out.pop()
            stack.pop()
            out.append(token)
            whole[len(stack)] = len(out)
            ended = True
            if not stack:
                break
        elif kind == "mark" and token in ",:":
            out.append(token)
            ended = False
        else:
            if ended and line:
                out.append(",")
            if token in _NOTHING:
                token = "null"
            if kind == "open":
                cut = True
                token += '"' if len(token) - len(token.rstrip("\\")) & 1 == 0 else '\\"'
            out.append(token)
            ended = token not in ("{", "[")
            if not ended:
                stack.append("}" if token == "{" else "]")
        line = False
    return _closed(out, stack, whole, cut)


def _closed(out: list[str], stack: list[str], whole: dict[int, int], cut: bool) -> str | None:
    tries = []
    if stack:
        if cut:
            tries.append(out + stack[::-1])
        if (at := whole.get(len(stack) - 1)) is not None:
            tries.append(out[:at] + stack[-2::-1] if len(stack) > 1 else out[:at])
        bare = out[:-1] if out[-1] == "," else out
        tries.append(bare + stack[::-1])
    else:
        tries.append(out)
    for parts in tries:
        made = "".join(parts)
        try:
            value = json.loads(made)
        except ValueError:
            continue
        if isinstance(value, list) and len(value) == 1 and isinstance(value[0], dict):
            return made[1:-1]
        return made
    return None


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    """``repaired`` over a batch: brackets within strings and a stack have no built-in form."""
    return texts.map(repaired)


def number(text: Column) -> Column:
    """The number in an answer such as "800 mm" or "1,200", or null."""
    digits = F.regexp_replace(F.regexp_replace(text, ",", ""), r"[^0-9.\-]", "")
    return digits.try_cast("double")


def stem(name: Column) -> Column:
    """A file stem of word characters, dots and dashes, without underscores at the ends; model if nothing is left."""
    t = F.regexp_replace(name, r"\.[A-Za-z]{1,5}$", "")
    t = F.regexp_replace(t, r"(?U)[^\w.\-]+", "_")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(t, "_+", "_"), F.lit("_")), F.lit("")), F.lit("model"))


def warnings(header: Column) -> Column:
    """Warnings of a header as array<struct<text, element_ids>>: version 2 has objects, version 1 plain texts."""
    two = F.from_json(header, "array<struct<text:string,element_ids:array<int>>>")
    one = F.transform(F.from_json(header, "array<string>"), lambda t: F.struct(t.alias("text"), F.array().cast("array<int>").alias("element_ids")))
    return F.when(header.rlike(r"^\s*\[\s*\{"), two).otherwise(one)
