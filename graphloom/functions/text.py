"""Text, path, parsing and reward expressions; built-in functions unless the name says udf."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: C++ keywords, which are no identifiers of interest (fixed values).
KEYWORDS = (
    "auto", "bool", "break", "case", "catch", "char", "class", "const", "constexpr", "continue", "default", "delete", "do", "double", "else", "enum", "explicit", "extern",
    "false", "float", "for", "friend", "goto", "if", "inline", "int", "long", "namespace", "new", "nullptr", "operator", "private", "protected", "public", "return", "short",
    "signed", "sizeof", "static", "struct", "switch", "template", "this", "throw", "true", "try", "typedef", "typename", "union", "unsigned", "virtual", "void", "volatile", "while",
)
TYPES = ("int", "char", "long", "short", "double", "float", "bool", "void", "signed", "unsigned", "auto")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row: Spark computes what a lambda names anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def name_tokens(name: Column) -> Column:
    """Lower-case parts between underscores, then the whole name if it's not among them."""
    parts = F.filter(F.split(F.lower(name), "_"), lambda x: x != "")
    return F.when(F.array_contains(parts, F.lower(name)), parts).otherwise(F.concat(parts, F.array(F.lower(name))))


def identifier_tokens(identifier: Column) -> Column:
    """Runs of A-Z and a-z, cut where a capital follows a small letter and before the last capital of several that a
    small letter follows; lower, without keywords."""
    marked = F.regexp_replace(identifier, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    words = F.filter(F.transform(F.split(marked, "[^A-Za-z]+"), F.lower), lambda x: (x != "") & ~x.isin(*KEYWORDS))
    return F.when(identifier.isin(*KEYWORDS), F.array().cast("array<string>")).otherwise(words)


def strip_comments(code: Column) -> Column:
    """Block comments become a blank, so that what stands beside them isn't joined; line comments go."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")


def declaration_count(code: Column) -> Column:
    """Classes, structs and enums that are named, and function declarations (not definitions), outside comments.

    A kind's word counts where a word follows and it isn't itself the name after such a word (`enum class A` is one).
    A statement, which is what ends with a semicolon, declares a function if, but for qualifiers, it ends with a
    closing parenthesis and, after any earlier closing one, two words stand before an opening one; so `return f(x);`
    counts, and a function whose last parameter has parentheses doesn't.
    """
    return let(strip_comments(code), _declared)


def _declared(c: Column) -> Column:
    kind = lambda w: w.isin("class", "struct", "enum")

    def kinds(words: Column) -> Column:
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        return F.size(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: kind(at(i)) & at(i + 1).rlike(r"^\w") & ~kind(F.when(i > 0, at(i - 1)).otherwise(""))))

    statements = F.regexp_extract_all(c, F.lit("[^;{}]*;"), F.lit(0))
    bare = F.transform(statements, lambda s: F.regexp_replace(s, r"(?:(?<=[\s)])(?:const|override|noexcept)|\s)*;$", ""))
    inside = F.transform(F.filter(bare, lambda s: s.endswith(")")), lambda s: F.substring_index(F.substring(s, F.lit(1), F.length(s) - 1), ")", -1))
    words = F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), F.lit(0))
    return let(words, kinds) + F.size(F.filter(inside, lambda s: s.rlike(r"\w\s+\w+\s*\(")))


def naming_consistency(body: Column) -> Column:
    """Mean Jaccard similarity over all pairs of the token sets of a body's identifiers, repeated ones too; 1 with fewer
    than two. Equal sets are counted once with their number, so that the work grows with the different ones."""
    names = F.filter(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0)), lambda n: (F.length(n) > 1) & ~n.isin(*KEYWORDS))
    sets = F.filter(F.transform(names, lambda n: F.array_sort(F.array_distinct(identifier_tokens(n)))), lambda t: F.size(t) > 0)
    return let(sets, _consistency)


def _consistency(sets: Column) -> Column:
    jaccard = lambda a, b: F.size(F.array_intersect(a["t"], b["t"])) / F.size(F.array_union(a["t"], b["t"]))
    n = F.size(sets).cast("double")

    def mean(kinds: Column) -> Column:
        alike = F.aggregate(kinds, F.lit(0.0), lambda s, a: s + a["n"] * (a["n"] - 1) / 2)
        others = F.flatten(F.transform(kinds, lambda a, i: F.transform(F.slice(kinds, i + 2, F.size(kinds)), lambda b: a["n"] * b["n"] * jaccard(a, b))))
        return F.aggregate(others, alike, lambda s, x: s + x) / (n * (n - 1) / 2)

    kinds = F.transform(F.array_distinct(sets), lambda t: F.struct(t.alias("t"), F.size(F.filter(sets, lambda u: u == t)).cast("double").alias("n")))
    return F.when(n > 1, let(kinds, mean)).otherwise(F.lit(1.0))


def _split_parameters(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += c in "(<[{"
        depth -= c in ")>]}"
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now.strip() or out else []


@F.udf(T.StringType(), useArrow=True)
def normalize_signature_udf(signature: str | None) -> str | None:
    """A C++ signature without parameter names and defaults; function pointers stay as they are."""
    if signature is None or "(" not in signature:
        return signature
    name, _, rest = signature.partition("(")
    body, close, tail = rest.rpartition(")")
    if not close:
        return signature
    kinds = []
    for p in _split_parameters(body):
        p = p.split("=")[0].strip() if "(" not in p.split("=")[0] else p.strip()
        if "(" not in p:
            m = re.fullmatch(r"(.*[\s*&>])([A-Za-z_]\w*)(\[\d*\])?", p, re.S)
            if m and m[2] not in TYPES and m[1].strip() not in ("const", "struct", "volatile"):
                p = m[1].strip() + (m[3] or "")
        kinds.append(re.sub(r"\s+", " ", p))
    return f"{name.strip()}({', '.join(kinds)}){tail.rstrip()}"


def base_name(signature: Column) -> Column:
    return F.split_part(signature, F.lit("("), F.lit(1))


def node_id(kind: Column, name: Column, path: Column, strategy: str = "relative") -> Column:
    """Id of a code node: by relative path, by basename (smart), by the whole (absolute), or hashed."""
    whole = F.concat_ws(":", kind, path, name)
    if strategy == "hash":
        return F.concat_ws(":", kind, F.substring(F.md5(whole), 1, 8))
    return F.concat_ws(":", kind, F.substring_index(path, "/", -1), name) if strategy == "smart" else whole


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def path_of_id(id: Column) -> Column:
    return F.regexp_extract(id, r"^func:([^:]*)", 1)


def outline(text: Column) -> Column:
    """(name, kind) of outline lines `name (Kind)`."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*.+ \([A-Za-z]+\)\s*$"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(.+) \([A-Za-z]+\)\s*$", 1).alias("name"), F.regexp_extract(x, r"\(([A-Za-z]+)\)\s*$", 1).alias("kind")))


def strip_control(text: Column) -> Column:
    """Without control characters but tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROL, "")


@F.udf(T.StringType(), useArrow=True)
def unescape_udf(text: str | None) -> str | None:
    return None if text is None else re.sub(CONTROL, "", html.unescape(text)).strip().strip('"')


def records(text: Column, record: str = "##", field: str = "<|>") -> Column:
    """Arrays of trimmed fields of `(a<|>b)##(c<|>d)`."""
    parts = F.filter(F.transform(F.split(text, re.escape(record)), lambda x: F.trim(x)), lambda x: x.startswith("(") & x.endswith(")"))
    return F.transform(parts, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\(|\)$", ""), re.escape(field)), lambda y: F.trim(y)))


def entities(text: Column) -> Column:
    """(name, kind, type, relation, description) of records with 5 fields whose kind is code or semantic."""
    good = F.filter(records(text), lambda r: (F.size(r) >= 5) & F.lower(r[1]).rlike("code|semantic"))
    return F.transform(good, lambda r: F.struct(F.upper(r[0]).alias("name"), F.upper(r[1]).alias("kind"), F.upper(r[2]).alias("type"), F.upper(r[3]).alias("relation"), r[4].alias("description")))


def relations(text: Column) -> Column:
    """(source, relationship, target) of records with 3 fields."""
    return F.transform(F.filter(records(text), lambda r: F.size(r) >= 3), lambda r: F.struct(F.upper(r[0]).alias("source"), F.upper(r[1]).alias("relationship"), F.upper(r[2]).alias("target")))


def summary(text: Column) -> Column:
    """(type, description) of `TYPE: description`, type empty where there's none."""
    has = F.instr(text, ": ") > 0
    return F.struct(F.when(has, F.split_part(text, F.lit(": "), F.lit(1))).otherwise("").alias("type"), F.when(has, F.regexp_replace(text, r"(?s)^.*?: ", "")).otherwise(text).alias("description"))


def code_blocks(text: Column, language: str = "") -> Column:
    """Bodies of fenced blocks."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{re.escape(language)}[^\n]*\n(.*?)```"), F.lit(1))


def last_block(text: Column, language: str = "") -> Column:
    return F.try_element_at(code_blocks(text, language), F.lit(-1))


@F.udf(T.StringType(), useArrow=True)
def repair_json_udf(text: str | None) -> str | None:
    """Single-quoted JSON-like text as JSON, null where it can't be repaired."""
    for candidate in (text, re.sub(r"(?<!\\)'", '"', text or "")):
        try:
            return json.dumps(json.loads(candidate), sort_keys=True)
        except (TypeError, ValueError):
            continue
    return None


@F.udf(T.StringType(), useArrow=True)
def literal_blocks_udf(text: str | None) -> str | None:
    """YAML whose `key: |` blocks hold fenced code, without the fences and indented by two."""
    if text is None:
        return None
    out, inside = [], False
    for line in text.split("\n"):
        if re.fullmatch(r"\s*```\w*\s*", line):
            continue
        if re.fullmatch(r"\S[^:]*:\s*\|\s*", line):
            inside = True
        elif inside and re.match(r"[A-Za-z_]\w*:", line):
            inside = False
        elif inside and line and not line.startswith("  "):
            line = "  " + line
        out.append(line)
    return "\n".join(out)


def split_thoughts(text: Column) -> Column:
    """(content, reasoning) around the last </think>."""
    has = text.contains("</think>")
    return F.struct(
        F.regexp_replace(F.when(has, F.substring_index(text, "</think>", -1)).otherwise(text), r"^\s+|\s+$", "").alias("content"),
        F.when(has, F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)</think>(?!.*</think>).*$", ""), r"^\s*<think>", ""))).otherwise("").alias("reasoning"),
    )


def tag_reward(text: Column, tags: list[str], each: float = 0.25) -> Column:
    """each for every tag that occurs exactly once."""
    return sum((F.when(F.regexp_count(text, F.lit(re.escape(t))) == 1, each).otherwise(0.0) for t in tags), F.lit(0.0))


def format_reward(text: Column, first: str = "think", second: str = "answer") -> Column:
    return F.when(text.rlike(rf"(?s)^\s*<{first}>.*?</{first}>\s*<{second}>.*?</{second}>\s*$"), 1.0).otherwise(0.0)


def accuracy_reward(text: Column, label: Column, reward: float = 2.0) -> Column:
    return F.when(F.trim(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)) == F.trim(label), reward).otherwise(0.0)


def single_json_block(text: Column, schema: str) -> Column:
    """The parsed JSON of the only fenced block, else null."""
    blocks = code_blocks(text, "json")
    return F.when(F.size(blocks) == 1, F.from_json(F.try_element_at(blocks, F.lit(1)), schema))


def final_answer(text: Column) -> Column:
    """What stands behind ####, null where there's none."""
    return F.when(text.contains("####"), F.trim(F.split_part(text, F.lit("####"), F.lit(2))))


def word_count(text: Column) -> Column:
    """Token count in absence of a tokenizer."""
    return F.regexp_count(text, F.lit(r"\S+"))


def numbered(rows: Column) -> Column:
    """<1>..</1><2>..</2> of an array of texts."""
    return F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("<"), i + 1, F.lit(">"), x, F.lit("</"), i + 1, F.lit(">"))), "")


def chat_text(messages: Column, begin: str = "<|{role}|>\n", end: str = "\n") -> Column:
    """Messages (role, content) through a template."""
    head, tail = begin.split("{role}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), m["content"], F.lit(end))), "")


def with_end(text: Column, end: str) -> Column:
    t = F.regexp_replace(text, r"\n+$", "")
    return F.when(t.endswith(end), t).otherwise(F.concat(t, F.lit(" " + end)))


def with_reward(text: Column, reward: Column, template: str = "{input} <reward>{reward}") -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{reward}"), F.format_string("%.2f", reward)), F.lit("{input}"), text)


def comment_lines(code: Column) -> Column:
    """Lines with comments, those inside block comments too: an ordered fold over the lines."""
    step = lambda s, line: F.struct(
        F.when(s["open"], ~line.contains("*/")).otherwise(line.contains("/*") & ~line.rlike(r"/\*.*\*/")).alias("open"),
        (s["n"] + F.when(s["open"] | line.contains("//") | line.contains("/*"), 1).otherwise(0)).alias("n"),
    )
    return F.aggregate(F.split(code, "\n"), F.struct(F.lit(False).alias("open"), F.lit(0).alias("n")), step)["n"]


_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(["']).*?(?:(?<!\\)\1|\Z)""", re.S)


def _without_strings(code: str) -> str:
    """Comments gone but for their line feeds, and strings blank."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " " if m[1] else "", m[0]), code)


@F.udf(T.StringType(), useArrow=True)
def strip_strings_udf(code: str | None) -> str | None:
    return None if code is None else _without_strings(code)


#: Operators that are counted (fixed values).
OPERATORS = (
    "+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "&", "|", "^", "~", "<<", ">>", "++", "--",
    "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "->", ".", "::", "?", ":", ",", ";", "(", ")", "[", "]", "{", "}",
    "new", "delete", "sizeof", "typeof",
)


#: Names, numbers and operators, of which the longest that fits; anything else is no token.
_CODE_TOKEN = "|".join([r"[A-Za-z_]\w*", r"\d+(?:\.\d+)?[fFlLuU]*", *(re.escape(x) for x in sorted(OPERATORS, key=len, reverse=True) if not x.isalpha())])


_HIDDEN_JAVA = "(?s)" + _HIDDEN.pattern.replace(r"\Z", r"\z")


def halstead(code: Column) -> Column:
    """Struct of Halstead's volume, difficulty and effort, from one pass over the tokens outside strings and comments.

    Operators are tokens of OPERATORS; names that are no keywords, and numbers, are operands.
    """
    tokens_ = F.regexp_extract_all(F.regexp_replace(F.coalesce(code, F.lit("")), _HIDDEN_JAVA, " "), F.lit(_CODE_TOKEN), F.lit(0))
    kinds = lambda t: F.struct(
        F.filter(t, lambda x: x.isin(*OPERATORS)).alias("operators"),
        F.filter(t, lambda x: x.rlike(r"^\w") & ~x.isin(*OPERATORS) & ~x.isin(*KEYWORDS)).alias("operands"),
    )
    counts = lambda k: F.struct(*(n.cast("double").alias(c) for c, n in (("n1", F.size(F.array_distinct(k["operators"]))), ("n2", F.size(F.array_distinct(k["operands"]))), ("operators", F.size(k["operators"])), ("used", F.size(k["operands"])))))
    return let(let(let(tokens_, kinds), counts), _measures)


def _measures(n: Column) -> Column:
    volume = F.when(n["n1"] + n["n2"] > 0, (n["operators"] + n["used"]) * F.log2(n["n1"] + n["n2"])).otherwise(0.0)
    difficulty = F.when(n["n2"] > 0, n["n1"] / 2 * n["used"] / n["n2"]).otherwise(0.0)
    return F.struct(volume.alias("volume"), difficulty.alias("difficulty"), (volume * difficulty).alias("effort"))


def halstead_of_tokens(total: Column) -> list[Column]:
    """Estimates from the number of tokens: vocabulary total^0.7, of which 40 % are operators."""
    vocabulary = F.floor(F.pow(total.cast("double"), F.lit(0.7)))
    n1, n2 = F.floor(vocabulary * 0.4), F.greatest(vocabulary - F.floor(vocabulary * 0.4), F.lit(1))
    volume = F.when(vocabulary > 1, total * F.log2(F.greatest(vocabulary, F.lit(2)).cast("double"))).otherwise(0.0)
    difficulty = n1 / 2 * F.floor(total * 0.6) / n2
    return [volume.alias("volume"), difficulty.alias("difficulty"), (volume * difficulty).alias("effort")]


def halstead_of_lines(lines: Column) -> list[Column]:
    return [(lines * 25.0).alias("volume"), (lines * 1.2).alias("difficulty"), (lines * 25.0 * (lines * 1.2)).alias("effort")]


def complexity(code: Column) -> Column:
    """Decision points and one: an approximation of cyclomatic complexity."""
    return F.regexp_count(strip_comments(code), F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?")) + 1


def change(actual: Column, design: Column, higher_is_better: bool = True) -> list[Column]:
    """diff, percent (0 where the base is 0) and status."""
    diff = actual - design
    better = diff > 0 if higher_is_better else diff < 0
    return [diff.alias("diff"), F.when(design != 0, 100.0 * diff / F.abs(design)).otherwise(F.lit(0.0)).alias("percent"), F.when(diff == 0, "same").when(better, "better").otherwise("worse").alias("status")]


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def strip_repeated(text: Column, pad: str, end: str) -> Column:
    """Without the pad string, repeated, in front, and the end string, repeated, behind."""
    return F.regexp_replace(F.regexp_replace(text, f"^(?:{re.escape(pad)})+", ""), f"(?:{re.escape(end)})+$", "")
