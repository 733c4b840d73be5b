"""Queries over the test tables, one or more for each operator, and the SQL that DuckDB runs to the same result.

Digests, CRCs and budgets that SQL cannot express have no SQL here; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests
from .functions import text as T
from .operators import canonical, changes, feed, graph, lookups, records
from .plans.lineage_cut import removed, scratch, written
from .sources import adapters, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _duck(sql: str) -> str:
    """An adapter in DuckDB's dialect."""
    return sql.replace("{", "").replace("}", "").replace("AS STRING", "AS VARCHAR")


_CONV = f"SELECT 'conv/' || conv_id || '.md' AS path, '# Conversation ' || conv_id || chr(10) || string_agg({adapters.TURN}, '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id"
_EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
_KIND = f"CASE {_EXT} WHEN 'mod' THEN 1 WHEN 'md' THEN 2 WHEN 'txt' THEN 6 ELSE 0 END"
_ALL = f"everything AS ({_duck(adapters.DOCUMENTS)} UNION ALL {_CONV} UNION ALL {_duck(adapters.MODULES)} UNION ALL {_duck(adapters.PAGES)}), files AS (SELECT path, {_KIND} AS kind, text FROM everything WHERE path NOT LIKE '%.html')"
_SPLIT = "split AS (SELECT path, kind, text, regexp_extract_all(text, '[A-Za-z0-9_]+') AS runs FROM files)"
_KEPT = f"{_ALL}, {_SPLIT}, sorted AS (SELECT path, list_sort(list_distinct(list_filter(runs, lambda x: length(x) <= 32))) AS lexical FROM split), kept AS (SELECT path, lexical, list_filter(lexical[1:256], lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*')) AS tokens FROM sorted)"
_TERMS = f"{_KEPT}, terms AS (SELECT path, unnest(tokens) AS token, unnest(range(len(tokens))) AS seq FROM kept)"
_DOCS = "docs AS (SELECT kind, path, strlen(text) AS size, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS words, length(text) - length(replace(text, chr(10), '')) AS lines FROM files)"
_NAME = "regexp_extract(rest, '^([A-Za-z_][A-Za-z0-9_]{0,31}(\\.[A-Za-z_][A-Za-z0-9_]{0,31})*)($|[^A-Za-z0-9_.])', 1)"
_PARSED = f"""{_ALL}, raws AS (SELECT path, kind, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS lineno FROM files),
lines AS (SELECT path, kind, lineno, regexp_replace(raw, '\\r$', '') AS line, ltrim(regexp_replace(raw, '\\r$', ''), ' ' || chr(9)) AS trimmed FROM raws),
declared AS (SELECT *, CASE WHEN kind = 1 THEN regexp_extract(trimmed, '^(module|fn|record|use)[ \\t]', 1) ELSE '' END AS decl, CASE WHEN kind = 2 THEN length(regexp_extract(trimmed, '^(#{{1,6}}) ', 1)) ELSE 0 END AS level FROM lines WHERE trimmed <> ''),
named AS (SELECT *, ltrim(substr(trimmed, length(decl) + 1), ' ' || chr(9)) AS rest FROM declared),
parsed AS (SELECT *, {_NAME} AS name, substr(trimmed, level + 2) AS title FROM named WHERE decl = '' OR {_NAME} <> '')"""
_RFC = "list_transform(list_filter(range(1, len(t)), lambda i: upper(t[i]) IN ('RFC', 'RFCS') AND regexp_full_match(t[i + 1], '[0-9]{4}')), lambda i: t[i + 1])"
_RELS = f"""{_PARSED}, numbered AS (SELECT path, list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda x: length(x) <= 32) AS t FROM parsed),
links AS (SELECT path, unnest(list_filter(regexp_extract_all(trimmed, '\\]\\(([^)]*)\\)', 1), lambda x: x <> '')) AS dst FROM parsed WHERE kind = 2),
edges AS (SELECT path AS src, 'defines' AS rel, name AS dst FROM parsed WHERE decl NOT IN ('', 'use') UNION SELECT path, 'references', name FROM parsed WHERE decl = 'use' UNION SELECT path, 'depends-on', name FROM parsed WHERE decl = 'use'
UNION SELECT path, 'references', CASE WHEN dst LIKE '<%>' THEN substr(dst, 2, length(dst) - 2) ELSE dst END FROM links UNION SELECT path, 'rfc-ref', unnest({_RFC}) FROM numbered),
rels AS (SELECT src, rel, dst, row_number() OVER (ORDER BY src, rel, dst) - 1 AS seq FROM edges)"""
_SYMS = f"{_PARSED}, found AS (SELECT path, decl AS sym, name, min(lineno) AS lineno FROM parsed WHERE decl <> '' GROUP BY ALL), syms AS (SELECT path, sym, name, row_number() OVER (ORDER BY path, lineno) - 1 AS seq FROM found)"
_HEADS = f"{_PARSED}, headings AS (SELECT path, level, title, row_number() OVER (ORDER BY path, lineno) - 1 AS seq FROM parsed WHERE level > 0)"
_PRESS = f"{_PARSED}, mentions AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, 'PRESS-[0-9]{{3}}')) AS pid FROM parsed), press AS (SELECT path, pid, row_number() OVER (ORDER BY path, pid) - 1 AS seq FROM mentions)"


def _files(spark: SparkSession, sf_dir: str, *sqls: str) -> DataFrame:
    return records.prepared(adapters.corpus(spark, sf_dir, *sqls))


def _plain_docs(found: DataFrame) -> DataFrame:
    """The document table without its digest, for queries that don't need it."""
    return found.select("kind", "path", F.octet_length("content").cast("bigint").alias("size"), T.word_count("content").alias("words"), T.line_count("content").alias("lines"))


def _rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dense_numbers(records.rich_rows(_files(spark, sf_dir))["rels"], records.ORDER["rels"])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships without their numbers, for walks and counts, which need no order over the corpus."""
    return records.rich_rows(_files(spark, sf_dir))["rels"]


@query(f"WITH {_ALL} SELECT path, path NOT LIKE '%.html' AS admitted FROM everything")
def admission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.corpus(spark, sf_dir).select("path", T.admitted("path").alias("admitted"))


@query(f"WITH {_ALL} SELECT kind, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM files GROUP BY kind")
def census_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query(f"WITH {_ALL} SELECT {_EXT} AS extension, {_KIND} AS kind, count(*) AS n FROM everything GROUP BY ALL")
def kind_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = T.path_extension("path")
    return adapters.corpus(spark, sf_dir).groupBy(ext.alias("extension"), T.classify_kind(ext).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {_ALL}, {_DOCS} SELECT * FROM docs")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_docs(_files(spark, sf_dir))


@query()
def crc_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", F.crc32("content").alias("crc"))


@query()
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", digests.merkle64_hex("content").alias("digest"))


@query(f"""WITH {_TERMS}, words AS (SELECT DISTINCT token FROM terms), bytes AS (SELECT token, list_transform(string_split(token, ''), lambda c: ord(c)::HUGEINT) AS b FROM words)
SELECT token, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS tid FROM bytes""")
def token_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = records.term_rows(_files(spark, sf_dir)).select("token").distinct()
    return words.select("token", digests.fnv64_hex(F.col("token").cast("binary")).alias("tid"))


@query(f"WITH {_TERMS} SELECT path, token, seq FROM terms")
def term_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.term_rows(_files(spark, sf_dir))


@query(f"WITH {_KEPT} SELECT path, least(len(lexical), 256) AS lexical, len(tokens) AS kept FROM kept")
def term_cap_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir).withColumn("t", T.tokens("content"))
    return found.select("path", F.size("t").cast("bigint").alias("lexical"), F.size(F.filter("t", T.is_symbol)).cast("bigint").alias("kept"))


@query(f"WITH {_ALL}, {_SPLIT}, words AS (SELECT DISTINCT unnest(runs) AS token FROM split) SELECT token, regexp_full_match(token, '[A-Za-z_][A-Za-z0-9_]{{0,31}}') AS valid FROM words")
def token_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _files(spark, sf_dir).select(F.explode(F.regexp_extract_all(T.latin("content"), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("token")).distinct()
    return words.select("token", T.is_symbol("token").alias("valid"))


@query(f"WITH {_ALL} SELECT min(path) AS first_path, count(*) AS files FROM files GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _files(spark, sf_dir).select("path", digests.merkle64_hex("content").alias("digest"))
    return docs.groupBy("digest").agg(F.min("path").alias("first_path"), F.count("*").alias("files")).where("files > 1").drop("digest")


@query(f"WITH {_ALL} SELECT kind, path FROM files WHERE text = (SELECT text FROM documents WHERE doc_id = 0)")
def by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = adapters.table(spark, sf_dir, "documents").where("doc_id = 0").select(digests.merkle64_hex(F.col("text").cast("binary"))).first()[0]
    docs = _files(spark, sf_dir).withColumn("digest", digests.merkle64_hex("content")).drop("content")
    return lookups.Lookup({"docs": docs}).by_id(digest).records.select("kind", "path")


@query(f"WITH {_ALL}, {_DOCS} SELECT * FROM docs WHERE path = 'geo/nation_3.mod'")
def by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"docs": _plain_docs(_files(spark, sf_dir))}).by_path("geo/nation_3.mod").records


@query(f"WITH {_ALL}, {_DOCS} SELECT * FROM docs WHERE kind = 2")
def by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"docs": _plain_docs(_files(spark, sf_dir))}).by_kind(2).records


def _searched(spark: SparkSession, sf_dir: str, term: str) -> DataFrame:
    """The document table with its terms as an array. Contents without the term have no such token, so only the others are cut into tokens."""
    found = _files(spark, sf_dir).where(F.contains(T.latin("content"), F.lit(term)))
    tokens = F.filter(T.tokens("content"), T.is_symbol).alias("tokens")
    return found.select("kind", "path", F.octet_length("content").cast("bigint").alias("size"), T.word_count("content").alias("words"), T.line_count("content").alias("lines"), tokens)


def _substring(spark: SparkSession, sf_dir: str, term: str) -> DataFrame:
    return lookups.Lookup({"docs": _searched(spark, sf_dir, term)}).term_substring(term).records


@query(f"WITH {_TERMS}, {_DOCS} SELECT * FROM docs WHERE path IN (SELECT path FROM terms WHERE contains(token, 'tion'))")
def term_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring(spark, sf_dir, "tion")


@query(f"WITH {_TERMS}, {_DOCS} SELECT * FROM docs WHERE path IN (SELECT path FROM terms WHERE contains(token, 'customer_1'))")
def term_substring_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring(spark, sf_dir, "customer_1")


@query(f"WITH {_TERMS}, {_DOCS} SELECT * FROM docs WHERE kind = 6 AND path IN (SELECT path FROM terms WHERE contains(token, 'and'))")
def query_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"docs": _searched(spark, sf_dir, "and")}).match(kind=6, term="and").records


@query(f"WITH {_ALL}, {_DOCS} SELECT *, (SELECT count(*) FROM docs) AS total FROM docs ORDER BY kind, path LIMIT 100")
def all_docs_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.Lookup({"docs": _plain_docs(_files(spark, sf_dir))}).all_docs(100)
    return found.records.withColumn("total", F.lit(found.total).cast("bigint"))


@query(f"WITH {_ALL}, asked AS (SELECT 'documents/' || source || '/' || doc_id || '.txt' AS path FROM documents UNION SELECT 'none/' || doc_id FROM documents) SELECT asked.path, files.path IS NOT NULL AS found, strlen(text) AS size, CASE WHEN files.path IS NOT NULL THEN 7 END AS established_generation FROM asked LEFT JOIN files ON asked.path = files.path")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records.documents(_files(spark, sf_dir))
    asked = adapters.table(spark, sf_dir, "documents").select(F.explode(F.array(F.expr("'documents/' || source || '/' || doc_id || '.txt'"), F.expr("'none/' || doc_id"))).alias("path"))
    return lookups.provenance(docs, docs.select("path", F.lit(7).alias("generation")), asked).drop("digest")


@query(f"WITH {_SYMS} SELECT * FROM syms")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dense_numbers(records.rich_rows(_files(spark, sf_dir))["syms"], records.ORDER["syms"]).drop("lineno")


@query(f"WITH {_SYMS} SELECT * FROM syms WHERE name = 'nation_name'")
def symbols_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"syms": symbols(spark, sf_dir)}).symbols("nation_name").records


@query(f"WITH {_PARSED} SELECT path, decl AS sym, name, count(*) AS declared, min(lineno) AS first_line FROM parsed WHERE decl <> '' GROUP BY ALL HAVING count(*) > 1")
def symbol_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls = records.parsed_lines(_files(spark, sf_dir)).where("decl <> ''")
    return decls.groupBy("path", F.col("decl").alias("sym"), "name").agg(F.count("*").alias("declared"), F.min("lineno").cast("bigint").alias("first_line")).where("declared > 1")


@query(f"WITH {_HEADS} SELECT * FROM headings")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dense_numbers(records.rich_rows(_files(spark, sf_dir))["headings"], records.ORDER["headings"]).drop("lineno")


@query(f"WITH {_HEADS} SELECT * FROM headings WHERE path = 'conv/1.md'")
def headings_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"headings": headings(spark, sf_dir)}).headings_for("conv/1.md").records


@query(f"WITH {_RELS} SELECT src AS path, dst AS target FROM rels WHERE rel = 'references' AND src LIKE 'conv/%'")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.parsed_lines(_files(spark, sf_dir, adapters.CONVERSATIONS))
    return rows.select("path", F.explode(T.link_targets("trimmed")).alias("target")).distinct()


@query(f"WITH {_PRESS} SELECT * FROM press")
def press_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dense_numbers(records.rich_rows(_files(spark, sf_dir))["press"], records.ORDER["press"])


@query(f"WITH {_PRESS} SELECT * FROM press WHERE pid = 'PRESS-003'")
def pressure_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.Lookup({"press": press_mentions(spark, sf_dir)}).pressure("PRESS-003").records


@query(f"WITH {_RELS} SELECT src, dst, seq FROM rels WHERE rel = 'rfc-ref'")
def rfc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rels(spark, sf_dir).where("rel = 'rfc-ref'").drop("rel")


@query(f"WITH {_RELS} SELECT * FROM rels")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rels(spark, sf_dir)


def _edge(name: str, test: str, call):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return call(lookups.Lookup({"rels": _rels(spark, sf_dir)})).records

    run.__name__ = name
    query(f"WITH {_RELS} SELECT * FROM rels WHERE {test}")(run)


_edge("defines", "rel = 'defines' AND dst = 'account.building'", lambda x: x.defines("account.building"))
_edge("references", "rel = 'references' AND dst = 'geo.nation_3'", lambda x: x.references("geo.nation_3"))
_edge("depends_on", "rel = 'depends-on' AND src = 'ord/order_1.mod'", lambda x: x.depends_on("ord/order_1.mod"))
_edge("dependents", "rel = 'depends-on' AND dst = 'geo.nation_3'", lambda x: x.dependents("geo.nation_3"))
_edge("rfc_refs_for", "rel = 'rfc-ref' AND dst = '0003'", lambda x: x.rfc_refs("0003"))

_HOPS = f"{_RELS}, hop AS (SELECT d.src AS needs, f.src AS needed FROM rels d JOIN rels f ON d.rel = 'depends-on' AND f.rel = 'defines' AND d.dst = f.dst)"
_BIG = 1 << 40


@query(f"WITH RECURSIVE {_HOPS}, walk AS (SELECT 'ord/order_1.mod' AS node UNION SELECT needed FROM walk JOIN hop ON needs = node) SELECT node FROM walk WHERE node <> 'ord/order_1.mod'")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(written(_edges(spark, sf_dir)), "ord/order_1.mod").nodes


@query(f"WITH RECURSIVE {_HOPS}, walk AS (SELECT 'geo/region_2.mod' AS node UNION SELECT needs FROM walk JOIN hop ON needed = node) SELECT node FROM walk WHERE node <> 'geo/region_2.mod'")
def transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(written(_edges(spark, sf_dir)), "geo/region_2.mod", max_nodes=_BIG).nodes


@query(f"WITH RECURSIVE {_HOPS}, walk AS (SELECT unnest(['geo/nation_1.mod', 'crm/customer_1.mod']) AS node UNION SELECT needs FROM walk JOIN hop ON needed = node) SELECT node FROM walk")
def invalidation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.invalidated(written(_edges(spark, sf_dir)), ["geo/nation_1.mod", "crm/customer_1.mod"], max_nodes=_BIG).nodes


@query()
def budgeted_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.dependents(written(_edges(spark, sf_dir)), "geo/region_2.mod", max_depth=4, max_nodes=50)
    return found.nodes.withColumn("truncated", F.lit(found.truncated))


@query(f"WITH {_RELS} SELECT src, count(*) AS fanout FROM rels WHERE rel = 'depends-on' GROUP BY src ORDER BY fanout DESC, src LIMIT 20")
def fanout_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_edges(spark, sf_dir), 20)


@query(f"WITH {_RELS}, old AS ({_duck(adapters.DOCUMENTS)}), new AS ({_duck(adapters.MUTATED)}), changed AS (SELECT coalesce(o.path, n.path) AS node FROM old o FULL JOIN new n ON o.path = n.path WHERE o.text IS DISTINCT FROM n.text), hubs AS (SELECT src AS node FROM (SELECT src, count(*) AS fanout FROM rels WHERE rel = 'depends-on' GROUP BY src ORDER BY fanout DESC, src LIMIT 20)) SELECT coalesce(c.node, h.node) AS node, c.node IS NOT NULL AS changed, h.node IS NOT NULL AS hub FROM changed c FULL JOIN hubs h ON c.node = h.node")
def invalidation_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where invalidation begins: the files that changed and the files with the most dependencies."""
    old, new = (f.select("path", F.sha2("content", 256).alias("digest")) for f in _versions(spark, sf_dir))
    return graph.invalidation_roots(changes.verdicts(old, new), _edges(spark, sf_dir), 20)


@query(f"WITH {_ALL} SELECT split_part(path, '/', 1) AS repository, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM files GROUP BY 1")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.census(_files(spark, sf_dir))


@query(f"WITH {_ALL}, {_SPLIT}, words AS (SELECT DISTINCT unnest(runs) AS token FROM split) SELECT token, CASE WHEN upper(token) = 'RFC' THEN 1 WHEN upper(token) = 'RFCS' THEN 3 WHEN regexp_full_match(token, '[0-9]{{4}}') THEN 2 ELSE 0 END AS rfc_class, regexp_full_match(token, 'PRESS-[0-9]{{3}}') AS is_press FROM words")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _files(spark, sf_dir).select(F.explode(F.regexp_extract_all(T.latin("content"), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("token")).distinct()
    return words.select("token", T.rfc_class("token").alias("rfc_class"), T.is_press_id("token").alias("is_press"))


@query(f"WITH {_KEPT}, firsts AS (SELECT path, lexical[1:8] AS t FROM kept) SELECT path, coalesce(list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN regexp_full_match(t[i], '[A-Za-z_][A-Za-z0-9_]{{0,31}}') THEN (1 << (i - 1)) ELSE 0 END)), 0)::INT AS mask FROM firsts")
def symbol_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a file's first eight tokens are symbols."""
    return _files(spark, sf_dir).withColumn("t", T.tokens("content")).select("path", T.symbol_mask("t").alias("mask"))


@query("SELECT i::INT AS byte, CASE WHEN i = 10 THEN 1 WHEN i IN (9, 13, 32) THEN 2 WHEN i BETWEEN 48 AND 57 OR i BETWEEN 65 AND 90 OR i BETWEEN 97 AND 122 OR i = 95 THEN 3 ELSE 0 END AS class FROM range(256) t(i)")
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), T.byte_class("id").alias("class"))


_OLD_NEW = f"old AS ({_duck(adapters.DOCUMENTS)}), new AS ({_duck(adapters.MUTATED)}), sides AS (SELECT coalesce(o.path, n.path) AS path, o.text AS a, n.text AS b, CASE WHEN o.path IS NULL THEN 1 WHEN n.path IS NULL THEN 2 WHEN o.text = n.text THEN 0 ELSE 3 END AS verdict FROM old o FULL JOIN new n ON o.path = n.path)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _files(spark, sf_dir, adapters.DOCUMENTS), _files(spark, sf_dir, adapters.MUTATED)


@query(f"WITH {_OLD_NEW} SELECT path, verdict FROM sides")
def change_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return changes.verdicts(records.documents(old), records.documents(new)).select("path", "verdict")


@query(f"""WITH {_OLD_NEW}, gone AS (SELECT a AS text, path FROM sides WHERE verdict = 2), come AS (SELECT b AS text, path FROM sides WHERE verdict = 1),
pairs AS (SELECT g.text, g.one AS old, c.one AS new FROM (SELECT text, min(path) AS one FROM gone GROUP BY text HAVING count(*) = 1) g JOIN (SELECT text, min(path) AS one FROM come GROUP BY text HAVING count(*) = 1) c ON g.text = c.text)
SELECT old, new, 'moved' AS kind FROM pairs UNION ALL SELECT path, NULL, 'removed' FROM gone WHERE text NOT IN (SELECT text FROM pairs) UNION ALL SELECT NULL, path, 'added' FROM come WHERE text NOT IN (SELECT text FROM pairs)""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    found = written(changes.verdicts(records.documents(old), records.documents(new)))
    gone = found.where("verdict = 2").select("path", F.col("old_digest").alias("digest"))
    come = found.where("verdict = 1").select("path", F.col("new_digest").alias("digest"))
    return changes.lineage(gone, come).drop("digest")


_NEW_TERMS = _TERMS.replace(_ALL, f"files AS (SELECT path, 6 AS kind, text FROM ({_duck(adapters.MUTATED)}))")


@query(f"WITH {_NEW_TERMS} SELECT path, token, seq FROM terms")
def incremental_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return changes.updated({"docs": records.documents(old), "terms": records.terms(old)}, new)[0]["terms"].select("path", "token", "seq")


@query("SELECT 'docs' AS relation, 0 AS differing UNION ALL SELECT 'terms', 0 UNION ALL SELECT 'syms', 0 UNION ALL SELECT 'headings', 0 UNION ALL SELECT 'rels', 0 UNION ALL SELECT 'press', 0")
def incremental_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an update of one corpus to another and a build of the latter do not share, by table. The update takes the steps of
    changes.updated, table by table, and what no later table needs is removed, so that disk holds the tables of one comparison at a time, and the large tables are compared by parts of the paths, one after another."""
    old = _files(spark, sf_dir, adapters.DOCUMENTS, adapters.CONVERSATIONS)
    new = _files(spark, sf_dir, adapters.MUTATED, adapters.CONVERSATIONS, adapters.MODULES)
    differing: dict[str, int] = {}

    def compare(name: str, updated: DataFrame, rebuilt: DataFrame) -> None:
        differing[name], parts = 0, 4 if name in ("terms", "syms", "rels") else 1
        for k in range(parts):  # every path falls into one of the parts, which meet in turn
            mine, theirs = (t.where(F.pmod(F.xxhash64("src" if name == "rels" else "path"), F.lit(parts)) == k) for t in (updated.select(*rebuilt.columns), rebuilt))
            with scratch():
                differing[name] += written(changes.differing(mine, theirs)).first()["n"]

    docs = written(records.documents(new))
    verdicts = written(changes.verdicts(records.documents(old), docs).select("path", "verdict"))
    compare("docs", docs, records.documents(new))
    removed(docs)
    same, changed = changes.split(verdicts, new)
    changed = written(changed)
    compare("terms", changes.kept("terms", records.terms(old), same).unionByName(records.terms(changed)), records.terms(new))
    lines = [written(records.record_lines(changed))]
    removed(changed)
    lines += [written(records.record_lines(files)) for files in (old, new)]
    fresh, before, whole = (records.rows_of(rows) for rows in lines)
    numbered = lambda name, rows: records.globalized({name: rows})[name]
    for name in whole:
        with scratch():
            compare(name, numbered(name, changes.kept(name, numbered(name, before[name]), same).unionByName(fresh[name])), numbered(name, whole[name]))
    removed(verdicts, *lines)
    rows = [F.struct(F.lit(name).alias("relation"), F.lit(n).cast("int").alias("differing")) for name, n in differing.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


_FEED = f"feed AS ({_duck(adapters.FEED)}), relations AS (SELECT position, commit, hex(raw) AS raw, ('0x' || substr(hex(raw), 9, 2))::INT AS kind, substr(hex(raw), 17, 24) AS source, substr(hex(raw), 41, 24) AS target, ('0x' || substr(hex(raw), 65, 16))::BIGINT AS generation, ('0x' || substr(hex(raw), 145, 16))::BIGINT AS ordinal FROM feed), latest AS (SELECT kind, source, target, ordinal, arg_max(raw, (generation, position)) AS raw, max(generation) AS generation FROM relations GROUP BY ALL)"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.decoded_relations(adapters.rows(spark, sf_dir, adapters.FEED))


def _shown(df: DataFrame) -> DataFrame:
    """Bytes as hexadecimal, big numbers as long."""
    return df.select(*(F.hex(c).alias(c) if t == "binary" else F.col(c).cast("bigint").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_FEED} SELECT position, kind, source, target, generation, ordinal FROM relations")
def feed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_relations(spark, sf_dir).select("position", "kind", "source", "target", "generation", "ordinal"))


@query(f"WITH {_FEED} SELECT * FROM latest")
def feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feed.latest(_relations(spark, sf_dir)))


@query(f"WITH {_FEED} SELECT * FROM latest WHERE target = hex('000000000007') AND kind = 4")
def feed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feed.selected(feed.latest(_relations(spark, sf_dir)), target=b"000000000007", kind=4))


@query(f"WITH {_FEED}, top AS (SELECT max(commit) AS top FROM feed) SELECT DISTINCT commit AS through, CASE WHEN commit = top THEN 'complete' ELSE 'stale' END AS freshness FROM feed, top")
def feed_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.rows(spark, sf_dir, adapters.FEED)
    top = rows.agg(F.max("commit").alias("top"))
    return rows.select(F.col("commit").alias("through")).distinct().crossJoin(F.broadcast(top)).select("through", feed.freshness(F.col("through"), F.col("top")).alias("freshness"))


@query(f"""WITH {_FEED}, hashed AS (SELECT sha256(unhex(raw)) AS h FROM latest WHERE kind = 2),
parts AS (SELECT count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::UBIGINT::HUGEINT) % 18446744073709551616::HUGEINT AS s{k}" for k in range(4))} FROM hashed)
SELECT sha256(n || ' ' || s0 || ' ' || s1 || ' ' || s2 || ' ' || s3) AS result_identity FROM parts""")
def feed_result_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.result_identity(feed.selected(feed.latest(_relations(spark, sf_dir)), kind=2))


@query(f"WITH {_TERMS}, {_DOCS} SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM terms) AS terms, (SELECT sum(size) FROM docs)::BIGINT AS bytes")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir)
    n_terms = records.term_rows(found).agg(F.count("*").alias("terms"))
    return _plain_docs(found).agg(F.count("*").alias("docs"), F.sum("size").cast("bigint").alias("bytes")).crossJoin(n_terms)


@query(f"WITH {_ALL}, sized AS (SELECT path, split_part(path, '/', 1) AS repository, strlen(text) AS size FROM everything), nth AS (SELECT *, row_number() OVER (PARTITION BY repository, size <= 4000 ORDER BY path) AS n FROM sized) SELECT path, repository, size, CASE WHEN size > 4000 THEN 'too large' WHEN n > 100 THEN 'beyond tier' ELSE 'staged' END AS reason FROM nth")
def staged_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.staged(adapters.corpus(spark, sf_dir), 100, 4000)


@query(f"WITH {_TERMS}, records AS (SELECT kind AS rank, path, 0 AS seq FROM files UNION ALL SELECT 100, path, seq FROM terms) SELECT rank, path, seq, row_number() OVER (ORDER BY rank, path, seq) - 1 AS place FROM records")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.placed_records(_files(spark, sf_dir))


@query()
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir)
    return canonical.canonical_lines({"docs": records.documents(found), "terms": records.terms(found)} | records.rich(found))


@query()
def canonical_index_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of the whole index: an aggregate over the digests of all canonical lines, in whatever partitions they lie."""
    found = _files(spark, sf_dir)
    lines = canonical.canonical_lines({"docs": records.documents(found), "terms": records.terms(found)} | records.rich(found))
    return canonical.set_digest(lines.select(F.col("line").cast("binary").alias("raw")), "raw").select(F.col("n").alias("lines"), F.col("digest").alias("index_identity"))


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name > b.n_name THEN 1 ELSE 0 END AS compared, (a.n_regionkey, a.n_name, a.n_nationkey) < (b.n_regionkey, b.n_name, b.n_nationkey) AS less, contains(a.n_name, substr(b.n_name, 1, 3)) AS contained FROM nation a JOIN nation b ON a.n_regionkey >= b.n_regionkey")
def record_less_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.table(spark, sf_dir, "nation")
    a, b = n.select(*(F.col(c).alias(f"a_{c}") for c in n.columns)), n.select(*(F.col(c).alias(f"b_{c}") for c in n.columns))
    less = T.record_less(("a_n_regionkey", "a_n_name", "a_n_nationkey"), ("b_n_regionkey", "b_n_name", "b_n_nationkey"))
    return a.join(b, F.col("a_n_regionkey") >= F.col("b_n_regionkey")).select(F.col("a_n_name").alias("a"), F.col("b_n_name").alias("b"), T.compare_bytes("a_n_name", "b_n_name").alias("compared"), less.alias("less"), T.contains_short("a_n_name", F.substring("b_n_name", 1, 3)).alias("contained"))
