"""Column expressions over file contents. Contents are bytes: `latin` gives one character a byte, so patterns see bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds by extension (fixed values). Kind 1 is the source language's; its extension is a parameter of the calls below.
KINDS = {"md": 2, "json": 3, "toml": 4, "yaml": 5, "yml": 5, "txt": 6, "text": 6, "log": 7}
MODULE_EXTENSION = "mod"
#: Bounds in bytes (fixed values): extension, token, tokens of a file, name, link target, file.
MOST_EXTENSION, MOST_TOKEN, MOST_TOKENS, MOST_NAME, MOST_TARGET, MOST_FILE = 8, 32, 256, 64, 256, 64 << 20
DECLARATIONS = ("module", "fn", "record", "use")
RELATIONS = ("defines", "references", "depends-on", "rfc-ref")
RANKS = {"term": 100, "sym": 101, "heading": 102, "rel": 103, "press": 104}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latin(content: Column | str) -> Column:
    """Binary as text, one character a byte."""
    return F.decode(_c(content), "ISO-8859-1")


def utf8_bytes(latin_text: Column | str) -> Column:
    """The bytes behind text that `latin` made."""
    return F.encode(_c(latin_text), "ISO-8859-1")


def as_utf8(latin_text: Column | str) -> Column:
    """That text read as UTF-8; null if it is not valid."""
    raw = utf8_bytes(latin_text)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def path_extension(path: Column | str) -> Column:
    """Lower-case extension of the last path part; empty for dotfiles, for names without a dot and beyond 8 bytes."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(F.instr(name, ".") <= 1, "").when(F.octet_length(ext) > MOST_EXTENSION, "").otherwise(ext)


def classify_kind(ext: Column | str, module_extension: str = MODULE_EXTENSION) -> Column:
    """Kind of an extension; 0 for any other. One lookup, so that the extension is cut once and not for every kind."""
    kinds = KINDS | {module_extension: 1}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), _c(ext)), F.lit(0))


def admitted(path: Column | str, module_extension: str = MODULE_EXTENSION) -> Column:
    """Whether a file of that path is indexed: it has a known extension, or none."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    ext = F.when(F.instr(name, ".") <= 1, "").otherwise(F.lower(F.element_at(F.split(name, r"\."), -1)))
    return ext.isin("", module_extension, *KINDS)


def safe_path(path: Column | str) -> Column:
    """The path; an error if it holds a line break or a tab."""
    return F.when(_c(path).rlike("[\\n\\r\\t]"), F.raise_error(F.concat(F.lit("path contains control characters: "), _c(path)))).otherwise(_c(path))


def byte_class(byte: Column | str) -> Column:
    """Of a byte value: 1 line feed, 2 other white space, 3 part of a token, 0 anything else."""
    b = _c(byte)
    return F.when(b == 10, 1).when(b.isin(9, 13, 32), 2).when(b.between(48, 57) | b.between(65, 90) | b.between(97, 122) | (b == 95), 3).otherwise(0)


def word_count(content: Column | str) -> Column:
    """Runs of bytes other than space, tab, line feed and carriage return."""
    return F.size(F.filter(F.split(latin(content), "[ \\t\\r\\n]+"), lambda x: x != "")).cast("bigint")


def line_count(content: Column | str) -> Column:
    """Line feeds."""
    return F.regexp_count(latin(content), F.lit("\\n")).cast("bigint")


def tokens(content: Column | str) -> Column:
    """Distinct runs of token bytes of at most 32 bytes, sorted, the first 256."""
    runs = F.regexp_extract_all(latin(content), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(F.filter(runs, lambda x: F.length(x) <= MOST_TOKEN))), 1, MOST_TOKENS)


def is_symbol(token: Column | str) -> Column:
    return _c(token).rlike("^[A-Za-z_][A-Za-z0-9_]{0,31}$")


def symbol_mask(tokens_: Column | str) -> Column:
    """For up to eight tokens, bit i set if token i is a symbol."""
    bits = F.transform(_c(tokens_), lambda t, i: F.when(is_symbol(t), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(F.slice(bits, 1, 8), F.lit(0), lambda a, b: a + b)


def compare_bytes(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by unsigned byte order."""
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).otherwise(0)


def record_less(a: tuple, b: tuple) -> Column:
    """Whether (kind, path, seq) a comes before b."""
    return F.struct(*map(_c, a)) < F.struct(*map(_c, b))


def contains_short(hay: Column | str, needle: Column | str) -> Column:
    """Whether a needle of at most eight bytes occurs; longer ones never do, empty ones always."""
    return (F.octet_length(_c(needle)) <= 8) & F.contains(_c(hay), _c(needle))


def classify_change(old_there: Column, old: Column, new_there: Column, new: Column) -> Column:
    """0 same, 1 added, 2 removed, 3 modified."""
    return F.when(~old_there & ~new_there, 0).when(~old_there, 1).when(~new_there, 2).when(old == new, 0).otherwise(3)


def declaration(trimmed: Column | str) -> Column:
    """The keyword that begins a line and is followed by a space or tab; else empty."""
    return F.regexp_extract(_c(trimmed), f"^({'|'.join(DECLARATIONS)})[ \\t]", 1)


def dotted_name(rest: Column | str) -> Column:
    """The dotted name at the beginning, of at most 64 bytes and 32 a segment; empty if there is none or more follows."""
    # the lookahead bounds the whole run, so that the pattern is matched once
    return F.regexp_extract(_c(rest), r"^(?![A-Za-z0-9_.]{%d})([A-Za-z_][A-Za-z0-9_]{0,31}(?:\.[A-Za-z_][A-Za-z0-9_]{0,31})*)(?![A-Za-z0-9_.])" % (MOST_NAME + 1), 1)


def heading_level(trimmed: Column | str) -> Column:
    """1 to 6 for as many hashes and a space at the beginning, else 0."""
    return F.length(F.regexp_extract(_c(trimmed), "^(#{1,6}) ", 1))


def contains_link(line: Column | str) -> Column:
    return F.contains(_c(line), F.lit("]("))


def link_targets(line: Column | str) -> Column:
    """Targets of ](target) spans, angle brackets taken off; empty, over-long and invalid ones left out."""
    spans = F.regexp_extract_all(_c(line), F.lit(r"\]\(([^)]*)\)"), F.lit(1))
    kept = F.filter(spans, lambda t: (t != "") & (F.length(t) <= MOST_TARGET))
    bare = F.transform(kept, lambda t: F.when(t.rlike("(?s)^<.*>$"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    return F.filter(F.transform(bare, as_utf8), lambda t: t.isNotNull() & ~t.rlike("[\\n\\r\\t]"))


def press_ids(line: Column | str) -> Column:
    return F.regexp_extract_all(_c(line), F.lit("PRESS-[0-9]{3}"), F.lit(0))


def is_press_id(token: Column | str) -> Column:
    return _c(token).rlike("^PRESS-[0-9]{3}$")


def rfc_class(token: Column | str) -> Column:
    """1 for RFC, 3 for RFCS (any case), 2 for four digits, else 0."""
    return F.when(F.upper(_c(token)) == "RFC", 1).when(F.upper(_c(token)) == "RFCS", 3).when(_c(token).rlike("^[0-9]{4}$"), 2).otherwise(0)


def rfc_numbers(line: Column | str) -> Column:
    """Numbers that directly follow RFC or RFCS in a line's tokens."""
    runs = F.filter(F.regexp_extract_all(_c(line), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda x: F.length(x) <= MOST_TOKEN)
    # bound to a variable, so that the tokens are cut once and not for every pair
    return F.transform(F.array(runs), lambda r: F.filter(r, lambda x, i: (i > 0) & (rfc_class(x) == 2) & rfc_class(F.get(r, i - 1)).isin(1, 3)))[0]


def should_visit(visited: Column, depth: Column, max_depth: Column, used: Column, limit: Column) -> Column:
    return (~visited) & (depth <= max_depth) & (used < limit)
