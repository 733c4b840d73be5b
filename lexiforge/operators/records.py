"""The record tables of a corpus frame (path, content): documents, terms, and the rich tables.

Null contents count as empty. Paths have to be distinct; a repeated path keeps every row. An empty corpus gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import text as T
from ..plans.lineage_cut import written
from .ordering import dense_numbers, dense_starts


def prepared(corpus: DataFrame, module_extension: str = T.MODULE_EXTENSION) -> DataFrame:
    """path, kind, content of the admitted files."""
    files = corpus.where(T.admitted("path", module_extension)).select(T.safe_path("path").alias("path"), F.coalesce("content", F.lit(b"")).alias("content"))
    return files.select("path", T.classify_kind(T.path_extension("path"), module_extension).alias("kind"), "content")


def documents(files: DataFrame) -> DataFrame:
    """kind, path, digest, size, words, lines, crc of prepared files."""
    return files.select("kind", "path", digests.merkle64_hex("content").alias("digest"), F.octet_length("content").cast("bigint").alias("size"), T.word_count("content").alias("words"), T.line_count("content").alias("lines"), F.crc32("content").alias("crc"))


def term_rows(files: DataFrame) -> DataFrame:
    """path, token, seq: a file's symbols among its first 256 sorted tokens, numbered after the others are dropped."""
    kept = F.filter(T.tokens("content"), T.is_symbol)
    return files.select("path", F.posexplode(kept).alias("seq", "token")).select("path", "token", F.col("seq").cast("bigint").alias("seq"))


def placed_records(files: DataFrame) -> DataFrame:
    """rank, path, seq, place of every document (seq 0) and term, in canonical order. Sorted are two rows for each path, not one for each term:
    the seqs of a file's terms are 0, 1, 2 ..., so its number of terms tells them. Files of one path share an array of seqs."""
    n = F.size(F.filter(T.tokens("content"), T.is_symbol))
    counts = written(files.select("kind", "path", n.alias("n")).groupBy("kind", "path").agg(F.count("*").alias("files"), F.filter(F.collect_list("n"), lambda k: k > 0).alias("ns")))
    docs = counts.select(F.col("kind").alias("rank"), "path", F.transform(F.sequence(F.lit(1).cast("bigint"), "files"), lambda _: F.lit(1)).alias("ns"), F.col("files").alias("rows"))
    of_terms = counts.where("size(ns) > 0").select(F.lit(T.RANKS["term"]).alias("rank"), "path", "ns", F.aggregate("ns", F.lit(0).cast("bigint"), lambda x, k: x + k).alias("rows"))
    starts = dense_starts(docs.unionByName(of_terms), ["rank", "path"], "rows")
    seqs = F.sort_array(F.flatten(F.transform("ns", lambda k: F.sequence(F.lit(0), k - 1))))
    rows = starts.select("rank", "path", "start", F.posexplode(seqs).alias("nth", "seq"))
    return rows.select("rank", "path", F.col("seq").cast("bigint").alias("seq"), (F.col("start") + F.col("nth")).alias("place"))


def terms(files: DataFrame) -> DataFrame:
    """path, token, tid, seq."""
    return term_rows(files).select("path", "token", digests.fnv64_hex(F.col("token").cast("binary")).alias("tid"), "seq")


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row. They come out of a generator, below which the optimizer pushes no filter;
    it would write the expressions of plain columns into the filters on them, again wherever one builds on another."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def lines(files: DataFrame) -> DataFrame:
    """path, kind, lineno, line, trimmed of every line that is not blank, without the carriage return before its end; contents as one character a byte."""
    rows = files.select("path", "kind", F.posexplode(F.split(T.latin("content"), "\\n", -1)).alias("lineno", "raw"))
    rows = with_once(rows, line=F.when(F.endswith("raw", F.lit("\r")), F.substr("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw"))).drop("raw")
    return with_once(rows, trimmed=F.ltrim("line", F.lit(" \t"))).where("trimmed <> ''")


def parsed_lines(files: DataFrame) -> DataFrame:
    """lines with the declaration, its name, the heading level and title, and whether the line counts at all."""
    rows = with_once(lines(files), decl=F.when(F.col("kind") == 1, T.declaration("trimmed")).otherwise(""), level=F.when(F.col("kind") == 2, T.heading_level("trimmed")).otherwise(0))
    rest = F.ltrim(F.substr("trimmed", F.length("decl") + 1), F.lit(" \t"))
    title = F.when(F.col("level") > 0, T.as_utf8(F.substr("trimmed", F.col("level") + 2)))
    rows = with_once(rows, name=F.when(F.col("decl") != "", T.dotted_name(rest)), title=title)
    # a declaration without a valid name or a heading that is not UTF-8 hides its whole line
    return rows.where("NOT (decl <> '' AND name = '') AND NOT (level > 0 AND title IS NULL)")


def _targets() -> tuple[Column, Column]:
    """edges and pids of a parsed line: its pairs (rel, dst) and the press ids in it."""
    none = F.array().cast("array<string>")
    as_pairs = lambda rel, targets: F.transform(targets, lambda t: F.struct(F.lit(rel).alias("rel"), t.alias("dst")))
    name = lambda test: F.when(test, F.array("name")).otherwise(none)
    edges = F.concat(
        as_pairs("defines", name(~F.col("decl").isin("", "use"))),
        as_pairs("references", name(F.col("decl") == "use")),
        as_pairs("depends-on", name(F.col("decl") == "use")),
        as_pairs("references", F.when((F.col("kind") == 2) & T.contains_link("trimmed"), T.link_targets("trimmed")).otherwise(none)),
        as_pairs("rfc-ref", F.when(F.col("line").rlike("(?i)rfc"), T.rfc_numbers("line")).otherwise(none)),
    )
    pids = F.when(F.contains("line", F.lit("PRESS-")), T.press_ids("line")).otherwise(none)
    return edges, pids


def record_lines(files: DataFrame) -> DataFrame:
    """The parsed lines that hold a record, with edges and pids."""
    edges, pids = _targets()
    found = with_once(parsed_lines(files), edges=edges, pids=pids).where("decl <> '' OR level > 0 OR size(edges) > 0 OR size(pids) > 0")
    return found.select("path", "lineno", "decl", "name", "level", "title", "edges", "pids")


def _rows(rows: DataFrame, edges: Column, pids: Column) -> dict[str, DataFrame]:
    syms = rows.where("decl <> ''").groupBy("path", F.col("decl").alias("sym"), "name").agg(F.min("lineno").alias("lineno"))
    headings = rows.where("level > 0").select("path", "lineno", F.col("level").cast("bigint").alias("level"), "title").distinct()
    rels = rows.select("path", F.explode(edges).alias("e")).select(F.col("path").alias("src"), "e.rel", "e.dst").distinct()
    press = rows.select("path", F.explode(pids).alias("pid")).distinct()
    return {"syms": syms, "headings": headings, "rels": rels, "press": press}


def rows_of(lines: DataFrame) -> dict[str, DataFrame]:
    """rich_rows from record_lines."""
    return _rows(lines, F.col("edges"), F.col("pids"))


def rich_rows(files: DataFrame, shared: bool = False) -> dict[str, DataFrame]:
    """The rich tables before numbering: syms (with lineno), headings (with lineno), rels and press. shared: for a caller that reads
    more than one of them; lines that hold a record are written once, so that the contents are parsed once."""
    return rows_of(written(record_lines(files))) if shared else _rows(parsed_lines(files), *_targets())


#: The canonical order of each rich table, from which its sequence numbers follow.
ORDER = {"syms": ["path", "lineno", "sym", "name"], "headings": ["path", "lineno", "level", "title"], "rels": ["src", "rel", "dst"], "press": ["path", "pid"]}


def globalized(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rich tables with digests and sequence numbers over the whole corpus."""
    out = {}
    for name, table in rows.items():
        table = dense_numbers(table, ORDER[name])
        if name == "syms":
            table = table.select("path", "sym", "name", digests.fnv64_hex(F.col("name").cast("binary")).alias("ndigest"), "seq")
        if name == "headings":
            table = table.select("path", "level", "seq", digests.fnv64_hex(F.col("title").cast("binary")).alias("tdigest"), "title")
        out[name] = table
    return out


def rich(files: DataFrame) -> dict[str, DataFrame]:
    return globalized(rich_rows(files, shared=True))
