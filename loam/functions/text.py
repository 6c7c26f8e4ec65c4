"""Text and hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.arrays import bound

#: An API key, what replaces it, the line ends, explicit edit instructions, a traceback's frame, and the
#: relations that a reviewer may name.
SECRET = r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{8,}"
REDACTED = "[REDACTED_API_KEY]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
INSTRUCTION = r"\b(change|replace|edit|modify)\b.{0,40}\b(to|with)\b|把.{0,30}(改成|替换为)|第\s*\d+\s*行"
FRAME = r'(?m)^\s*File "([^"]+)", line (\d+), in ([^\n]+)$'
DECISION_RELATIONS = ("CALL", "DEF_USE", "CONTROL", "TYPE", "IMPORT", "ATTRIBUTE", "INHERITANCE", "OVERRIDE", "EXCEPTION", "TRACEBACK", "DECORATOR", "NONE")


def splitlines(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line. Null: null."""
    return bound(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def normalize_fragment(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def fragment_hash(text: Column) -> Column:
    return F.sha2(normalize_fragment(text), 256)


def stable_hash(*parts: Column, length: int = 24) -> Column:
    """A prefix of the SHA-256 of the parts as text, joined by a NUL; a null part is the empty text."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), stable_hash(*parts))


def unit_hash(*parts: Column) -> Column:
    """A number from 0 to 1 by the first 32 bits of the parts' hash."""
    return F.conv(stable_hash(*parts, length=8), 16, 10).cast("double") / F.lit(4294967295.0)


def query_tokens(text: Column) -> Column:
    """Distinct lower-case identifiers of three or more characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), 1), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def has_secret(text: Column, more: str = "") -> Column:
    """``more``: a further pattern that counts as a secret."""
    return text.rlike(f"{SECRET}|{more}" if more else SECRET)


def redact(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, f"{SECRET}|{more}" if more else SECRET, REDACTED)


def has_instruction(text: Column) -> Column:
    return text.rlike("(?i)" + INSTRUCTION)


def canonical_json(*names: str, **cols: Column) -> Column:
    """Compact JSON of columns with their names sorted and nulls written; for strings and integers without control
    characters. Structs inside keep their own order."""
    both = {**{n: F.col(n) for n in names}, **cols}
    return F.to_json(F.struct(*[both[n].alias(n) for n in sorted(both)]), {"ignoreNullFields": "false"})


def json_hash(*parts: Column, length: int = 24) -> Column:
    """A prefix of the SHA-256 of the parts as a compact JSON list: numbers stay numbers, null is null."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_replace(F.to_json(F.array(p), {"ignoreNullFields": "false"}), r"^\[|\]$", "") for p in parts]), F.lit("]")), 256), 1, length)


def hash64(*parts: Column) -> Column:
    """The first 64 bits of the SHA-256 of the parts joined by \\x1f, as a decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def name_words(name: Column) -> Column:
    """Distinct words of a name, split at underscores and what is no word character."""
    return F.array_distinct(F.split(F.lower(name), r"[_\W]+", -1))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words of two names; where many pairs are compared, make :func:`name_words` once a name."""
    return jaccard(name_words(a), name_words(b))


def repo_of(value: Column) -> Column:
    """(repository, commit) of ``x/owner__name.commit``; null if it is none or has unsafe characters."""
    encoded = F.regexp_replace(value, "^[^/]*/", "")
    pattern = r"^([A-Za-z0-9_.-]+?)__([A-Za-z0-9_.-]+)\.([^.]*)$"
    return F.when(encoded.rlike(pattern), F.struct(F.concat_ws("/", F.regexp_extract(encoded, pattern, 1), F.regexp_extract(encoded, pattern, 2)).alias("repository"), F.regexp_extract(encoded, pattern, 3).alias("commit")))


def slug(value: Column, limit: int = 96) -> Column:
    safe = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.concat_ws("_", F.substring(safe, 1, limit), stable_hash(value, length=12))


def numbered_view(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), x)), "\n")


def grep_line(path: Column, line: Column, text: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), text)


def pair_document(anchor: Column, candidate: Column) -> Column:
    return F.concat(F.lit("[ANCHOR]\n"), anchor, F.lit("\n[CANDIDATE]\n"), candidate)


def fenced_json(text: Column) -> Column:
    """The text inside a Markdown code fence, or all of it."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def braces(text: Column) -> Column:
    """From the first brace to the last; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def valid_decision(d: Column, block_id: Column) -> Column:
    """Whether a reviewer's decision (block_id, role, relation, confidence) is well formed and about the block."""
    relation = F.coalesce(d["relation"], F.lit("NONE"))
    return F.coalesce((d["block_id"] == block_id) & d["role"].isin("SUPPORT", "DROP") & relation.isin(*DECISION_RELATIONS) & d["confidence"].between(0, 1), F.lit(False))


def patch_path(raw: Column) -> Column:
    """A diff header's path: up to a tab, no a/ or b/, leading dots and slashes off; /dev/null is empty."""
    path = F.trim(F.split_part(raw, F.lit("\t"), F.lit(1)))
    return F.when(path == "/dev/null", "").otherwise(F.ltrim(F.regexp_replace(path, "^[ab]/", ""), F.lit("./")))


def traceback_frames(text: Column) -> Column:
    """(path, line, name) of each frame of a Python traceback, in order; a line without the name is no frame."""
    all_ = lambda k: F.regexp_extract_all(text, F.lit(FRAME), k)
    return F.transform(F.arrays_zip(all_(1).alias("path"), all_(2).alias("line"), all_(3).alias("name")), lambda x: F.struct(x["path"].alias("path"), x["line"].cast("int").alias("line"), F.trim(x["name"]).alias("name")))
