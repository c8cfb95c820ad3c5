"""Identifier and text tokenisation as Spark column expressions.

Two different splitters are in play and must not be mixed up:

* ``split_identifier`` works on names.  It keeps every character except the
  separators, keeps one-letter pieces and keeps stopwords.
* ``tokenize`` works on free text.  Anything outside ASCII letters and digits
  separates, one-letter pieces and stopwords are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no signal in a task description.
STOPWORDS = (
    "the", "a", "an", "is", "are", "fix", "bug", "issue", "error",
    "please", "to", "for", "in", "on", "of", "and", "or", "problem",
)

# Fixed value: the number of body tokens (after filtering) of the scoring rule that reads the beginning of a body only.
# No search uses it by itself; pass it as a cap to get that rule.
BODY_TOKEN_CAP = 500

# One piece of an alphanumeric run, at least two characters long.  A piece ends
# where a lower-case letter or digit meets an upper-case letter, so a run of
# capitals stays whole and joins the lower-case letters that follow it.
_PIECE = "[A-Z]+[a-z0-9]+|[A-Z]{2,}|[a-z0-9]{2,}"

# White space in the sense of Unicode text processing.  Java's and RE2's \s
# cover ASCII only, so the class is spelled out.
WHITE_SPACE = (
    "[\\x09-\\x0d\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
)


def split_identifier(name: Column) -> Column:
    """Lower-case pieces of an identifier, in order, duplicates kept."""
    camel = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.lower(F.regexp_replace(camel, "[_.-]", " "))
    return F.filter(F.split(spaced, WHITE_SPACE), lambda piece: piece != "")


def tokenize(text: Column) -> Column:
    """Lower-case text tokens, in order, without short pieces and stopwords."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.filter(F.transform(pieces, F.lower), lambda token: ~token.isin(*STOPWORDS))


def body_tokens(code: Column, cap: int | None = None) -> Column:
    """Tokens of a unit body: all of them, or the first ``cap``."""
    tokens = tokenize(code)
    return tokens if cap is None else F.slice(tokens, 1, cap)


def token_estimate(text: Column) -> Column:
    """Context-size estimate: a quarter of the length, rounded up.

    Lengths count code points, so text outside the basic plane counts shorter
    than it would in UTF-16 units.
    """
    return F.ceil(F.length(text) / 4).cast("bigint")


def unit_key(file_path: Column, name: Column) -> Column:
    """``file:name``, the key relevance labels use."""
    return F.concat(file_path, F.lit(":"), name)


def unit_label(class_name: Column, name: Column) -> Column:
    """``Class.name()`` or ``name()``."""
    return F.concat(qualified_name(class_name, name), F.lit("()"))


def qualified_name(class_name: Column, name: Column) -> Column:
    """``Class.name`` or ``name``; an empty class name counts as no class."""
    prefix = F.when(F.length(class_name) > 0, F.concat(class_name, F.lit("."))).otherwise("")
    return F.concat(prefix, name)


def embedding_text(class_name: Column, name: Column, code: Column) -> Column:
    """Text handed to an embedder: qualified name, newline, body."""
    return F.concat(qualified_name(class_name, name), F.lit("\n"), code)
