"""Size and cyclomatic complexity of each function of C-like source files, from a token stream and running sums.

Strings and comments are masked, line feeds kept. A file's tokens are numbered; sums over them give the brace depth, the
line and the statement of each. A function is a brace whose statement has balanced parentheses behind a name that is no
control word, outside other functions; it ends at the next closing brace of its depth. A file is one row and is read where
it lies: files are spread over all tasks, no token is shuffled, and a task holds the tokens of one file.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import _without_strings
from graphloom.shared import small_batches

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\n|&&|\|\||::|[^\s\w]", re.ASCII)
NAME = re.compile(r"((?:~ )?[A-Za-z_]\w*(?: :: (?:~ )?[A-Za-z_]\w*)*)\Z", re.ASCII)
#: Tokens that add a path (fixed values).
DECISIONS = ("if", "for", "while", "case", "catch", "&&", "||", "?")
#: Words before a parenthesis that make no function (fixed values).
CONTROL = ("if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "new", "delete", "throw", "defined", "decltype", "alignas", "noexcept")


def _named(words: list[str]) -> str | None:
    """The name before a statement's first parenthesis, if its parentheses are balanced and it is no control word."""
    if "(" not in words[1:] or words[0] == "(" or words.count("(") != words.count(")"):
        return None
    m = NAME.search(" ".join(words[: words.index("(")]))
    name = m[1].replace(" ", "") if m else ""
    return name if name and name not in CONTROL else None


def functions_of(code: str) -> list[tuple[str, int, int, int, int]]:
    """(name, start_line, end_line, nloc, complexity) of a file's functions."""
    tokens, line, depth, before = [], 1, 0, ""  # (token, line), without line feeds
    opened: dict[int, int] = {}  # by level: the place of the brace that was met last, if it opens
    end: dict[int, int] = {}  # of an opening brace: its closing one, where both are next to each other in their level
    heads, begin = [], 0  # (brace, head, name) of braces that may be functions; where the statement begins
    for token in TOKEN.findall(_without_strings(code)):
        if token == "\n":
            line += 1
        else:
            at = len(tokens)
            tokens.append((token, line))
            if token in (";", "{", "}") or token == ":" and before in ("public", "private", "protected"):
                if token == "{":
                    depth += 1
                    opened[depth] = at
                    name = _named([t for t, _ in tokens[begin:at]]) if at > begin else None
                    if name:
                        heads.append((at, begin, name))
                elif token == "}":
                    if depth in opened:
                        end[opened.pop(depth)] = at
                    depth -= 1
                begin = at + 1
        before = token
    covered, found = -1, []
    for brace, head, name in heads:
        if brace in end:
            if covered < brace:
                found.append((head, end[brace], name))
            covered = max(covered, end[brace])
    out = []
    for i, (head, last, name) in enumerate(found):
        own = tokens[head : min(last + 1, found[i + 1][0] if i + 1 < len(found) else len(tokens))]
        out.append((name, tokens[head][1], tokens[last][1], len({n for _, n in own}), sum(t in DECISIONS for t, _ in own) + 1))
    return out


def function_metrics(files: DataFrame, id: str = "id", code: str = "code") -> DataFrame:
    """(id, name, start_line, end_line, nloc, complexity): a row a function, for files (id, code).

    nloc: lines from the function's head to its end that have a token. complexity: its decisions and one. Functions inside
    functions count for the outer one. A brace that is never closed makes no function; a constructor whose initialiser list
    has braces ends at the first of them. Null or empty code: none. Repeated
    ids are files of their own.
    """
    small_batches(files.sparkSession)
    rows = files.select(F.col(id).alias("id"), F.col(code).cast("string").alias("code")).where("code <> ''")
    names, kinds = ("start_line", "end_line", "nloc", "complexity"), T.LongType()
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("name", T.StringType()), *(T.StructField(n, kinds) for n in names)])

    def run(batches):
        for batch in batches:
            found = [(i, *f) for i, c in enumerate(batch.column(1)) for f in functions_of(c.as_py())]
            at, name, *numbers = zip(*found) if found else [()] * 6
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
