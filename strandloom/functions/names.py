"""Column functions on names and patterns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes nothing that a name or path has, so that a backslash is an ordinary character.
_ESCAPE = "\x01"
#: Brackets within brackets that plain patterns take away; deeper ones are read sign by sign.
_PASSES = 4


def fold(value: Column | str) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def like(value: Column | str, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters; ``%`` and ``_`` are wild."""
    return F.like(fold(value), fold(F.lit(pattern)), F.lit(_ESCAPE))


def has(value: Column | str, text: str) -> Column:
    return like(value, f"%{text}%")


def begins(value: Column | str, text: str) -> Column:
    return like(value, f"{text}%")


def ends(value: Column | str, text: str) -> Column:
    return like(value, f"%{text}")


def short_name(fqname: Column | str) -> Column:
    """What follows the first dot after the last slash."""
    tail = F.element_at(F.split(fqname, "/"), -1)
    return F.when(F.instr(tail, ".") > 0, F.substr(tail, F.instr(tail, ".") + 1)).otherwise(tail)


def _signs_outside(name: Column) -> Column:
    """The characters outside all brackets, read from left to right."""

    def step(state: Column, sign: Column) -> Column:
        depth = state["depth"] + F.when(sign == "[", 1).when((sign == "]") & (state["depth"] > 0), -1).otherwise(0)
        kept = F.when((depth > 0) | sign.isin("[", "]"), state["kept"]).otherwise(F.concat(state["kept"], sign))
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))
    return F.aggregate(F.split(name, ""), begin, step, lambda state: state["kept"])


def strip_generics(name: Column | str) -> Column:
    """Without bracketed text, brackets in brackets too; an open bracket takes the rest with it."""
    whole = out = F.col(name) if isinstance(name, str) else name
    for _ in range(_PASSES):
        out = F.regexp_replace(out, r"\[[^\[\]]*\]", "")
    simple = F.replace(F.regexp_replace(out, r"(?s)\[.*$", ""), F.lit("]"), F.lit(""))
    return F.when(F.regexp_like(out, F.lit(r"(?s)\[.*\]")), _signs_outside(whole)).otherwise(simple)


def plain_generics(name: str) -> str:
    """The same for a Python string."""
    depth, out = 0, []
    for c in name:
        depth = max(0, depth + (c == "[") - (c == "]")) if c in "[]" else depth
        if c not in "[]" and not depth:
            out.append(c)
    return "".join(out)


def type_part(fqname: Column | str) -> Column:
    """What precedes the last dot, the first pointer mark dropped."""
    return F.regexp_replace(F.regexp_extract(fqname, r"(?s)^(.*)\.[^.]*$", 1), r"^([^*]*?\.)\*", "$1")


def method_part(fqname: Column | str) -> Column:
    return F.substring_index(fqname, ".", -1)


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def dir_name(path: Column | str) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)


def is_test_file(path: Column | str) -> Column:
    """A path that has the test suffix anywhere, in this case of letters."""
    return F.instr(path, "_test.go") > 0
