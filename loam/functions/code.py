"""Code as tokens, and fingerprints of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keywords of the language that samples are in.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
#: What a token is, by its first match: comments, strings, numbers, names, operators, anything else.
_PREFIX = "(?:[rRbBuUfF]|[bBfF][rR]|[rR][bBfF])?"
_STRINGS = [r"'''(?s:.*?)'''", r'"""(?s:.*?)"""', r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'", r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"']
_NUMBER = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[jJ]?"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
_OPERATOR = r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|->|:=|==|!=|<=|>=|[+\-*/%&|^@]="
LEXER = "|".join(["#[^\\r\\n]*", *[_PREFIX + s for s in _STRINGS], _NUMBER, NAME, _OPERATOR, r"[^ \t\r\n\f]"])


def tokens(code: Column) -> Column:
    """The tokens of a text: strings and numbers as written, names, operators; without comments, line ends and
    indentation. A quote that isn't closed, and whatever else begins no token, is one by itself. Null: null."""
    return F.filter(F.regexp_extract_all(code, F.lit(LEXER), 0), lambda t: ~t.startswith("#"))


def is_identifier(token: Column) -> Column:
    return token.rlike(f"^(?:{NAME})$") & ~token.isin(*KEYWORDS)


def list_hash(items: Column) -> Column:
    """SHA-256 of a list of strings as compact JSON."""
    return F.sha2(F.to_json(items), 256)


def fingerprints(code: Column) -> Column:
    """struct(token_hash, identifier_normalized_hash): of the tokens, and with every identifier as ``IDENT``."""
    found = tokens(code)
    plain = F.transform(found, lambda t: F.when(is_identifier(t), "IDENT").otherwise(t))
    return F.struct(list_hash(found).alias("token_hash"), list_hash(plain).alias("identifier_normalized_hash"))


def _numbers(names: pa.Array) -> pa.Array:
    """For each text the number of each name's first appearance among its names, from 1; null stays null."""
    out = []
    for text in names:
        seen: dict[str, int] = {}
        out.append(None if not text.is_valid else [None if n is None else seen.setdefault(n, len(seen) + 1) for n in text.as_py()])
    return pa.array(out, pa.list_(pa.int32()))


def renamed(found: Column) -> Column:
    """Tokens with each identifier as ``v`` and the number of its first appearance among the text's identifiers."""
    numbers = F.arrow_udf(_numbers, "array<int>")(F.transform(found, lambda t: F.when(is_identifier(t), t)))
    return F.zip_with(found, numbers, lambda t, n: F.coalesce(F.concat(F.lit("v"), n.cast("string")), t))


def renamed_hashes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, renamed_hash): the hash of the tokens as :func:`renamed` gives them, so that texts have it in common if
    consistent renaming makes them equal. A text's tokens are read once, in its own row: linear, and nothing is shuffled. A
    text without tokens or null: the hash of no tokens."""
    found = rows.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("found"))
    return found.select("id", list_hash(renamed(F.col("found"))).alias("renamed_hash"))


def all_hashes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token_hash, identifier_normalized_hash, renamed_hash) from one reading of a text's tokens. Null: as no tokens."""
    found = rows.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("found"))
    plain = F.transform("found", lambda t: F.when(is_identifier(t), "IDENT").otherwise(t))
    return found.select("id", list_hash(F.col("found")).alias("token_hash"), list_hash(plain).alias("identifier_normalized_hash"), list_hash(renamed(F.col("found"))).alias("renamed_hash"))
