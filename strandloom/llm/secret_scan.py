"""Secret scans by assignment-aware lexing of source code and configuration.

Every ``=``, ``:``, ``:=``, ``=>`` or ``+=`` in a text is read as an assignment where a
name stands to its left and an expression to its right: string literals in any quoting,
bare configuration values, names of constants assigned earlier, concatenations of these
and ``${NAME}`` inside them. Constants are propagated in the order of the text, so that a
password put together from parts is found at the name it ends up in. A literal is scored
by how sensitive its target's name is and by how random the literal looks.

What constants make of a text is bounded: once the characters that references, and
indented blocks within blocks, brought in sum to more than EXPANSION and the text's own
length, later ones stay unread, so that memory and time stay in proportion to the text.
Literals are always read.
Names have no scope: the last assignment before a use counts, in comments too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

THRESHOLD = 0.5
#: Characters that references to constants may bring into a text beyond its own length.
EXPANSION = 100_000

FINDINGS = "doc_id long, at long, name string, kind string, length int, score double, digest string"

_OPERATOR = re.compile(r":=|=>|\+=|[=:]")
_QUOTED = re.compile(r"""[rRbBuUfF@$]{0,2}(?:\"{3}((?:[^"\\]++|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]++|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`]*+)`)""", re.S)
_NAME = re.compile(r"[A-Za-z_][\w.]*(?![\w.(\[])")
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>|&]+")
_INSIDE = re.compile(r"\$\{(\w+)\}|\{\{\s*(\w+)\s*\}\}|\$(\w+)|\{(\w+)\}|%\((\w+)\)s")
_BLANK = re.compile(r"[ \t]*")
#: A literal in parentheses or on the next line.
_OPEN = re.compile(r"[ \t]*(?:\(\s*|\\?\r?\n\s*(?:\(\s*)?)(?=[rRbBuUfF@$]{0,2}[\"'`])")
_NEXT = re.compile(r"\s+(?=[\"'])")
_BLOCK = re.compile(r"[|>][-+\d]{0,2}[ \t]*\r?\n")
_SCHEME = re.compile(r"(?i)\s*(?:bearer|basic)\s+(\S+)\s*$")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)(?:-----END|$)", re.S)
_PLUS = re.compile(r"\s*(?:\+|\.(?=\s*[\"'$])|\|\|)\s*|[ \t]+(?=[\"'])|[ \t]*\\\r?\n[ \t]*(?=[\"'])")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ESCAPE = re.compile(r"\\(.)", re.S)

#: Words of a name, in this order of precedence, with the kind and its weight.
_KINDS = (
    (("private", "key"), "private_key", 1.0), (("api", "key"), "api_key", 1.0), (("apikey",), "api_key", 1.0), (("access", "key"), "access_key", 1.0),
    (("secret",), "secret", 1.0), (("password",), "password", 1.0), (("passwd",), "password", 1.0), (("passphrase",), "password", 1.0), (("pwd",), "password", 0.9),
    (("pass",), "password", 0.8), (("token",), "token", 0.9), (("bearer",), "token", 0.9), (("credential",), "credential", 0.9), (("credentials",), "credential", 0.9),
    (("encryption", "key"), "key", 0.9), (("signing", "key"), "key", 0.9), (("auth",), "credential", 0.7), (("authorization",), "credential", 0.8), (("webhook",), "credential", 0.6), (("key",), "key", 0.55),
)
_HARMLESS = {"count", "counts", "limit", "length", "len", "size", "type", "name", "path", "file", "url", "uri", "expires", "expiry", "ttl", "id", "index", "field", "public", "hint", "policy", "header", "max", "min", "num", "number", "prompt", "label"}
_PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|test|todo|n/?a|x+|\*+|\.+|-+|<.*>|.*(?:change[-_ ]?me|placeholder|redacted|your[-_ ]|example|dummy|insert[-_ ]).*)$")


def kind_of(name: str) -> tuple[str, float]:
    """Kind and weight of the most sensitive thing that a name speaks of; ("", 0) for others."""
    found = [w.lower() for w in _WORD.findall(name)]
    weights = [(weight, kind) for needed, kind, weight in _KINDS if all(n in found for n in needed)]
    if not weights:
        return "", 0.0
    weight, kind = max(weights, key=lambda x: x[0])
    return kind, weight * (0.4 if found[-1] in _HARMLESS or "public" in found else 1.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy of the characters and how many there are."""
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0
    return min(1.0, entropy / 3.5) * min(1.0, n / 16)


def score(name: str, literal: str) -> tuple[str, float]:
    """Kind, and score from 0 to 1, of a literal that the name gets."""
    kind, weight = kind_of(name)
    # What follows a scheme, and the body of a PEM block, count alone.
    if m := _SCHEME.match(literal):
        literal = m[1]
    elif m := _PEM.search(literal):
        literal = re.sub(r"\s", "", m[1])
    if not weight or len(literal) < 6 or _PLACEHOLDER.match(literal):
        return kind, 0.0
    value = randomness(literal)
    if kind == "password":
        # People's passwords are short and have words in them; sentences aren't passwords.
        value = max(value, 0.7) if not re.search(r"\s", literal) else value / 2
    elif re.search(r"\s", literal) or literal.isalpha() and (literal.islower() or literal.istitle()):
        value *= 0.3
    return kind, weight * value


_TYPES = ("str", "string", "bytes", "text", "char", "final", "const")


def _before(text: str, at: int, signs: str) -> int:
    """Where the run of ``signs`` that ends at a place begins."""
    while at and text[at - 1] in signs:
        at -= 1
    return at


def _name_before(text: str, at: int) -> tuple[int, int]:
    """Where the run of name characters that ends at a place begins, and that place."""
    k = at
    while k and (text[k - 1].isalnum() or text[k - 1] in "_.-$"):
        k -= 1
    return k, at


def _target(text: str, at: int) -> str:
    """The name that ends left of ``at``, or ""."""
    k, end = _name_before(text, _before(text, _before(text, at, " \t"), "\"']"))
    name = text[k:end].strip(".-$")
    # A type stands between a name and "=" as in ``name: str = ...`` or ``name: None | str = ...``.
    if text[at] == "=" and name.lower() in _TYPES and text[end : end + 1] != "]":
        k = _before(text, k, " \t")
        if k and text[k - 1] == "|":
            k = _before(text, _name_before(text, _before(text, k - 1, " \t"))[0], " \t")
        if k and text[k - 1] == ":":
            a, b = _name_before(text, _before(text, k - 1, " \t"))
            if typed := text[a:b].strip(".-$"):
                return typed
    return name


class _Constants(dict):
    """Values of names, and how many characters references and blocks within blocks may still bring in."""

    def __init__(self, left: int):
        super().__init__()
        self.left, self.block_end = left, 0

    def use(self, name: str) -> str | None:
        value = self.get(name)
        if value is not None:
            if len(value) > self.left:
                return None
            self.left -= len(value)
        return value


def _fill(literal: str, known: _Constants) -> str:
    def value(m: re.Match) -> str:
        found = known.use(next(g for g in m.groups() if g is not None))
        return m[0] if found is None else found

    return _INSIDE.sub(value, literal)


def _operand(text: str, at: int, known: _Constants) -> tuple[str | None, int]:
    """Value of a literal or a known constant at a place, and where it ends; None for anything else."""
    if m := _QUOTED.match(text, at):
        body = next(g for g in m.groups() if g is not None)
        return _fill(_ESCAPE.sub(r"\1", body), known), m.end()
    if m := _NAME.match(text, at):
        name = m[0].rstrip(".")
        return known.use(name), at + len(name) if name in known else at
    return None, at


def _begin(text: str, at: int) -> int:
    return (_OPEN.match(text, at) or _BLANK.match(text, at)).end()


def _block(text: str, at: int) -> tuple[str, int]:
    """The lines from ``at`` on that are indented deeper than the line before, and where they end."""
    line = text.rfind("\n", 0, text.rfind("\n", 0, at)) + 1
    depth = len(text[line:at]) - len(text[line:at].lstrip(" "))
    lines = []
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        row = text[at:end]
        if row.strip() and len(row) - len(row.lstrip(" ")) <= depth:
            break
        lines.append(row.strip())
        at = end
    return "\n".join(lines).strip(), at


def _value(text: str, at: int, known: _Constants) -> tuple[str | None, int]:
    """Value of the expression at a place, and where it ends."""
    before, at = at, _begin(text, at)
    if m := _BLOCK.match(text, at):
        inner = m.end() < known.block_end
        if inner and known.left <= 0:
            return None, at
        value, end = _block(text, m.end())
        known.left -= inner * (end - at)
        known.block_end = max(known.block_end, end)
        return value, end
    value, end = _operand(text, at, known)
    opened = text[before:at].strip(" \t")
    # On the next line a name may begin, as in ``key:`` above ``"name": ...``.
    if opened and value is not None and re.compile(r"\s*(?::|=)").match(text, end):
        return None, at
    if value is None:
        m = _BARE.match(text, at)
        if not m or text[m.end() : m.end() + 1] in ("(", "["):
            return None, at
        if m[0].lower() in ("bearer", "basic") and (more := _BARE.match(text, _BLANK.match(text, m.end()).end())):
            return f"{m[0]} {_fill(more[0].rstrip('.,:'), known)}", more.end()
        return _fill(m[0].rstrip(".,:"), known), m.end()
    while m := _PLUS.match(text, end) or "(" in opened and _NEXT.match(text, end):
        more, after = _operand(text, m.end(), known)
        if more is None:
            break
        value, end = value + more, after
    return value, end


def findings(text: str, threshold: float = THRESHOLD) -> list[tuple[int, str, str, int, float, str]]:
    """(at, name, kind, length, score, digest) of each literal that scores ``threshold`` at least, in order.

    ``at`` is the character at which the expression starts. The literal itself isn't
    reported, only the start of its SHA-256.
    """
    known = _Constants(EXPANSION + len(text))
    out = []
    for m in _OPERATOR.finditer(text):
        a, b = m.span()
        if text[a - 1 : a] in ("=", "!", "<", ">", ":", "+", "-", "*", "/", "%") and a or text[b : b + 1] in ("=", ":", "~") or text[b : b + 2] == "//":
            continue
        name = _target(text, a)
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        # What is added to something unknown is scored by itself.
        old = known.use(name) if m[0] == "+=" else ""
        value, _ = _value(text, b, known)
        if value is None:
            known.pop(name, None)
            continue
        value = (old or "") + value
        if old is None:
            known.pop(name, None)
        else:
            known[name] = value
        kind, found = score(name, value)
        if found >= threshold:
            start = _begin(text, b)
            out.append((start, name, kind, len(value), round(found, 6), hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]))
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, at, name, kind, length, score, digest) of every secret in ``docs``.

    Constants are known within one text only. A null or empty text has none; a long one is
    read whole, in time and memory in proportion to it. Repeated rows report alike, and a
    null doc_id stays null. A score that equals ``threshold`` is reported. Other columns,
    whatever their names, are not read. An empty table gives no rows. ``at`` counts
    characters from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for x in findings(text, threshold)]
            columns = list(zip(*got)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "at", "name", "kind", "length", "score", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINDINGS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
