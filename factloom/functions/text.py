"""Identifiers, terms and lines of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms, and suffixes that stemming strips.
STOPWORDS = "the and for are was were with from into that this not but you our all can has had its who what".split()
SUFFIXES = ("ing", "ings", "es", "ed", "s")
#: Hints in keys, and openings of values, that mark a secret.
SECRET_KEYS = "password passwd secret token api_key apikey access_key private_key client_secret auth".split()
SECRET_VALUES = "sk- ghp_ gho_ xoxb- AKIA postgres:// postgresql:// mysql:// mongodb:// redis://".split()
MASK = "***REDACTED***"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits of three bytes or more, A-Z lowered, without stopwords, sorted."""
    found = F.split(ascii_lower(text), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.octet_length(t) >= 3) & ~t.isin(STOPWORDS))))


def stem_variants(term: Column) -> Column:
    """The term and its stems, sorted and distinct; lengths are in bytes, terms of fewer than five have no stem."""
    out = [F.array(term)]
    for s in ("ation", "ations"):
        out.append(F.when(term.endswith(s), F.array(F.concat(_cut(term, len(s)), F.lit("e")))))
    for s in SUFFIXES:
        base = _cut(term, len(s))
        out.append(F.when(term.endswith(s) & (F.octet_length(base) >= 4), F.array(base)))
        # every base ends in its own last character, so the shorter form always comes with it
        out.append(F.when(term.endswith(s) & (F.octet_length(_cut(base, 1)) >= 3), F.array(_cut(base, 1))))
    every = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in out])))))
    return F.when(F.octet_length(term) < 5, F.array(term)).otherwise(every)


def _cut(c: Column, n: int) -> Column:
    return F.left(c, F.greatest(F.char_length(c) - n, F.lit(0)))


def term_match(a: Column, b: Column) -> Column:
    """Equal, or both of four characters or more and one the beginning of the other."""
    return F.when((F.octet_length(a) < 4) | (F.octet_length(b) < 4), a == b).otherwise(F.startswith(a, b) | F.startswith(b, a))


def term_hits(goal: Column, own: Column) -> Column:
    """How many goal terms match one of the own terms."""
    return F.size(F.filter(goal, lambda g: F.exists(own, lambda n: term_match(g, n))))


def similarity(goal: Column, name: Column, attributes: Column) -> Column:
    """Hits in the name count twice, hits in the attributes once."""
    return (2 * term_hits(goal, terms(name)) + term_hits(goal, terms(attributes))).cast("double")


def sanitize_key(c: Column) -> Column:
    """Slug: A-Z lowered, runs of other characters than letters, digits, '.', '/' one dash, none at the end."""
    slug = F.rtrim(F.regexp_replace(ascii_lower(c), r"[^a-z0-9./]+", "-"), F.lit("-"))
    return F.when(slug == "", F.lit("unnamed")).otherwise(slug)


def encode_component(c: Column) -> Column:
    """Percent-encode every byte but ASCII letters, digits, '/', '.', '_' and '-'."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    plain = lambda h: F.decode(F.unhex(h), "UTF-8")
    return F.array_join(F.transform(pairs, lambda h: F.when((h < "80") & plain(h).rlike(r"^[A-Za-z0-9/._-]$"), plain(h)).otherwise(F.concat(F.lit("%"), h))), "")


def decode_component(c: Column) -> Column:
    """Undo ``encode_component``; a percent sign without two hexadecimal digits stays."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    raw = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^%[0-9A-Fa-f]{2}$"), F.upper(F.substring(p, 2, 2))).otherwise(F.hex(F.encode(p, "UTF-8")))), "")
    return F.decode(F.unhex(raw), "UTF-8")


def entity_id(repo: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("repo://"), sanitize_key(repo), F.lit("/"), kind, F.lit("/"), sanitize_key(key))


def symbol_id(repo: Column, file: Column, name: Column) -> Column:
    return F.concat(F.lit("repo://"), sanitize_key(repo), F.lit("/symbol/"), encode_component(file), F.lit("/"), encode_component(name))


def occurrence_id(repo: Column, concept: Column, path: Column, owner: Column, line: Column) -> Column:
    return F.concat(F.lit("repo://"), sanitize_key(repo), F.lit("/occurrence/"), F.concat_ws("@", encode_component(concept), encode_component(path), encode_component(owner), line.cast("string")))


def content_id(*parts: Column) -> Column:
    """First twelve hexadecimal digits of the SHA-256 of the parts, each ended by '|'."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("|"))]), 256), 1, 12)


def normalize_id(entity: Column) -> Column:
    """Struct of kind and name of an entity id."""
    return F.struct(F.regexp_extract(entity, r"^repo://[^/]*/([^/]+)/", 1).alias("kind"), F.regexp_extract(entity, r"([^/]+)$", 1).alias("name"))


def norm(c: Column) -> Column:
    """Lower case, '::' as '.', without a leading 'fn ' or './'."""
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("::"), F.lit(".")), r"^(fn |\./)", "")


def truncate(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most)), F.lit("…")))


def truncate_to_budget(c: Column, tokens: int) -> Column:
    """Four characters a token; the cut moves back to a line's end if that keeps half or more."""
    n = 4 * tokens
    cut = F.left(c, F.lit(n))
    back = F.char_length(cut) - F.instr(F.reverse(cut), "\n")
    lined = F.contains(cut, F.lit("\n")) & (back * 2 >= n)
    return F.when(F.char_length(c) <= n, c).when(lined, F.left(cut, back)).otherwise(cut)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.char_length(c) / 4).cast("long")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop, else the whole."""
    found = F.regexp_extract(c, r"^[^.]*\.", 0)
    return F.when(found == "", c).otherwise(found)


def first_paragraph(c: Column) -> Column:
    return F.trim(F.element_at(F.split(F.trim(c), r"\n[ \t]*\n"), 1))


def readme_purpose(c: Column) -> Column:
    """The first paragraph that is no heading, on one line; null if there is none."""
    paragraphs = F.transform(F.split(c, r"\n[ \t]*\n"), lambda p: collapse(F.regexp_replace(p, r"(?m)^#.*$", "")))
    return F.try_element_at(F.filter(paragraphs, lambda p: p != ""), F.lit(1))


def classify_secret(key: Column, value: Column) -> Column:
    k, v = ascii_lower(key), F.trim(value)
    hit = F.lit(False)
    for h in SECRET_KEYS:
        hit = hit | F.contains(k, F.lit(h))
    for h in SECRET_VALUES:
        hit = hit | v.startswith(h)
    return hit | (v.startswith("-----BEGIN") & v.contains("PRIVATE KEY"))


def redact_value(v: Column) -> Column:
    return F.when(v == "", v).when(F.octet_length(v) <= 8, F.lit(MASK)).otherwise(F.concat(F.left(v, F.lit(2)), F.lit("…" + MASK)))


def has_keyword(c: Column, word: str) -> Column:
    return c.rlike(rf"(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")


def sql_op_table(sql: Column) -> Column:
    """Struct of the operation (read, write or query) and the table that SQL text names first."""
    table = F.regexp_extract(sql, r"(?i)\b(?:from|into|update|join|table)\s+[\"'`]?([A-Za-z_][A-Za-z0-9_.]*)", 1)
    op = F.when(sql.rlike(r"(?i)^\s*(insert|update|delete|replace|merge|create|drop|alter)\b"), "write").when(sql.rlike(r"(?i)^\s*select\b"), "read").otherwise("query")
    return F.struct(op.alias("op"), F.when(table != "", table).alias("table"))


def chain_matches(lines: Column, chain: Column) -> Column:
    """Whether the chain's items occur in the lines in order."""
    step = lambda at, line: F.when((at < F.size(chain)) & line.contains(F.get(chain, at)), at + 1).otherwise(at)
    return F.aggregate(lines, F.lit(0), step) == F.size(chain)


def item_matches(haystack: Column, item: Column) -> Column:
    """Substring, or for an item 'A -> B' an ordered chain over the haystack's lines."""
    chain = F.transform(F.split(item, "->"), lambda x: F.trim(x))
    return F.when(F.contains(item, F.lit("->")), chain_matches(F.split(haystack, "\n"), chain)).otherwise(F.contains(haystack, item))


def normalize_path(p: Column) -> Column:
    """Collapse '.' and '..' segments."""
    step = lambda out, s: F.when((s == "") | (s == "."), out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
