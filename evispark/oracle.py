"""DuckDB SQL that each query must equal, over the same tables."""

from __future__ import annotations


def fnv(text: str) -> str:
    """The label of a text without characters beyond the basic plane."""
    return (
        f"printf('%08x', CASE WHEN {text} = '' THEN 2166136261 ELSE list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT), "
        "lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) END)"
    )


def key(name: str) -> str:
    return f"lower(regexp_replace({name}, '[^A-Za-z0-9_$]', '', 'g'))"


def endpoint(name: str) -> str:
    return key(f"string_split(string_split({name}, '::')[-1], '.')[-1]")


def label(kind: str, source: str, target: str) -> str:
    return "'edge:' || " + fnv(f"({kind} || '|' || {source} || '|' || {target})")


FILES = """files AS (
  SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '.' || lower(c_mktsegment) AS path, lower(c_mktsegment) AS language,
         true AS is_candidate, c_acctbal >= 0 AS is_indexed, c_custkey AS seq
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ENTITIES = FILES + """, ents AS (
  SELECT 'order:' || o_orderkey AS id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'component' WHEN '2-HIGH' THEN 'class' WHEN '3-MEDIUM' THEN 'function' WHEN '5-LOW' THEN 'method' ELSE 'property' END AS kind,
         'Order#' || (o_orderkey % 97) AS name, path || '::Order#' || (o_orderkey % 97) AS qualified_name, path AS file_path, language, o_orderkey AS seq
  FROM orders JOIN files ON o_custkey = files.seq)"""
RELATIONS = ENTITIES + """, rels AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'references' WHEN 'A' THEN 'calls' ELSE 'imports' END AS kind, e.id AS source, 'part:' || l_partkey AS target,
         e.qualified_name AS source_name, p_name AS target_name, e.file_path,
         CASE l_suppkey % 10 WHEN 0 THEN 'external' WHEN 1 THEN 'unresolved' ELSE 'internal' END AS resolution,
         l_orderkey AS seq, l_discount < 0.09 AS is_actual, l_tax < 0.07 AS is_truth
  FROM lineitem JOIN ents e ON l_orderkey = e.seq JOIN part ON l_partkey = p_partkey)"""
EVERY = RELATIONS + """, every_ent AS (
  SELECT id, kind, name, qualified_name, file_path, language, seq FROM ents
  UNION ALL SELECT 'part:' || p_partkey, 'external_symbol', p_name, p_name, '', 'none', p_partkey + 1099511627776 FROM part WHERE p_partkey % 7 <> 0)"""
DOC_FILES = """dfiles AS (
  SELECT doc_id, source || '/' || lang || '/doc' || doc_id || '.txt' AS path, lang AS language, doc_id IN (SELECT doc_id FROM labels) AS is_indexed FROM documents)"""
LINES = DOC_FILES + """, doc_lines AS (
  SELECT 'line:' || (doc_id * 1000000 + k - 1) AS id, doc_id * 1000000 + k - 1 AS seq, path AS file_path, language,
         lower(coalesce(string_split(body, ' ')[1], '')) AS name, lower(coalesce(string_split(body, ' ')[2], '')) AS text
  FROM (SELECT d.doc_id, f.path, f.language, unnest(string_split(d.text, chr(10))) AS body, generate_subscripts(string_split(d.text, chr(10)), 1) AS k
        FROM documents d JOIN dfiles f ON d.doc_id = f.doc_id)),
  lines AS (SELECT *, file_path || '::' || name AS qualified_name FROM doc_lines)"""
DOC_PATHS = """paths AS (
  SELECT (CASE WHEN doc_id % 11 = 0 THEN 'build/' WHEN doc_id % 13 = 0 THEN 'src/node_modules/' ELSE 'src/' END) || source || '/doc' || doc_id || '.' ||
         ['ts', 'py', 'txt', 'java', 'xml', 'ets', 'md'][doc_id % 7 + 1] AS path FROM documents),
  supported AS (
  SELECT path, CASE string_split(path, '.')[-1] WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'xml' THEN 'xml' WHEN 'ets' THEN 'arkts' END AS language
  FROM paths WHERE NOT regexp_matches(path, '(^|/)(build|node_modules)/'))"""
NODES = """nodes AS (
  SELECT 'part:' || p_partkey AS id, ['struct', 'class', 'function'][p_size % 3 + 1] AS native_kind, p_name AS name, 'lib\\p.ets::' || p_name AS qualified_name,
         'lib/' || p_brand || '.ets' AS file_path, ['arkts', 'typescript'][p_size % 2 + 1] AS language, p_size AS start_line, p_size + 3 AS end_line,
         CASE p_partkey % 4 WHEN 0 THEN '@Entry,@State' WHEN 1 THEN 'ComponentV2' WHEN 2 THEN '@Prop' END AS decorators,
         CASE WHEN p_partkey % 3 = 0 THEN p_type END AS visibility
  FROM part),
  projected AS (SELECT *, CASE WHEN language = 'arkts' AND native_kind IN ('struct', 'class') AND decorators IN ('@Entry,@State', 'ComponentV2') THEN 'component' ELSE native_kind END AS kind FROM nodes)"""
MANIFESTS = """manifests AS (
  SELECT o_orderkey, CASE o_orderkey % 6
           WHEN 0 THEN root || '/src/main/module.json5' WHEN 1 THEN root || '/src/test/module.json5' WHEN 2 THEN root || '/package.json'
           WHEN 3 THEN root || '/x' || o_orderkey || '/pom.xml' WHEN 4 THEN 'package.json' ELSE root || '/build-profile.json5' END AS path,
         CASE o_orderkey % 4 WHEN 0 THEN '{broken' WHEN 1 THEN '{"name": 5}' ELSE '{"name": "pack' || o_orderkey || '"}' END AS content
  FROM (SELECT o_orderkey, 'r' || (o_orderkey % 5) || '/n' || (o_orderkey % 25) AS root FROM orders)),
  packs AS (
  SELECT *, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM manifests)"""
NAMED = "CASE WHEN path = 'package.json' OR path LIKE '%/package.json' THEN CASE WHEN o_orderkey % 4 >= 2 THEN 'pack' || o_orderkey END END"
STARS = RELATIONS + """, a_ents AS (SELECT * FROM ents WHERE seq % 7 <> 0), t_ents AS (SELECT * FROM ents WHERE seq % 5 <> 0)"""
EVALUATED = "kind IN ('module', 'package', 'class', 'struct', 'interface', 'function', 'method', 'import', 'component')"
ENT_KEY = f"SELECT DISTINCT kind, lower(file_path) AS file, {key('name')} AS name"
REL_KEY = f"SELECT DISTINCT kind, {endpoint('source_name')} AS source, {endpoint('target_name')} AS target, resolution"


def overlap(actual: str, truth: str, name: str = "") -> str:
    a, t, n = f"a{name}", f"t{name}", f"n{name}"
    return f"""{a} AS ({actual}), {t} AS ({truth}), {n} AS (
      SELECT (SELECT count(*) FROM {a}) AS n_actual, (SELECT count(*) FROM {t}) AS n_truth, (SELECT count(*) FROM (SELECT * FROM {a} INTERSECT SELECT * FROM {t})) AS n_both)"""


RATES = "SELECT n_actual, n_truth, n_both, n_both / nullif(n_actual, 0)::DOUBLE AS precision, n_both / nullif(n_truth, 0)::DOUBLE AS recall FROM n"
DOT_TEXTS = """texts AS (
  SELECT DISTINCT id, qualified_name, seq, text FROM (
    SELECT id, qualified_name, seq, name AS text FROM lines
    UNION ALL
    SELECT id, qualified_name, seq, array_to_string(list_slice(string_split(qualified_name, '.'), k, len(string_split(qualified_name, '.'))), '.')
    FROM (SELECT *, unnest(range(2, len(string_split(qualified_name, '.')) + 1)) AS k FROM lines)) WHERE text <> ''),
  cand AS (SELECT text, min(seq) AS first_seq, arg_min(id, seq) AS first_id, arg_min(qualified_name, seq) AS first_name FROM texts GROUP BY text)"""
JSON5 = MANIFESTS + r""", written AS (SELECT path, folder, min(o_orderkey) AS k FROM packs WHERE path LIKE '%.json5' GROUP BY path, folder),
  facts AS (
    SELECT *, CASE WHEN k % 4 >= 2 AND path LIKE '%/module.json5' THEN k::VARCHAR END AS module_name,
           CASE WHEN k % 4 >= 2 AND path NOT LIKE '%/module.json5' THEN 'm' || k || '=./lib/core/' ELSE '' END AS modules FROM written)"""
SYMBOLS = """symbol_lines AS (
    SELECT path AS file_path, unnest(string_split(text, chr(10))) AS body FROM documents d JOIN dfiles f ON d.doc_id = f.doc_id)"""
SYMBOL_FILES = "SELECT file_path FROM symbol_lines WHERE ends_with(body, '.')"
# What pages declare: places are numbers of characters, rows numbers of line feeds
PAGES = r"""pages_ AS (
    SELECT page_id, page_id || '/' || url AS path, html FROM pages WHERE html IS NOT NULL),
  declared AS (
    SELECT *, strpos(html, '<' || tag || '>') - 1 AS start, CASE WHEN strpos(html, '</' || tag || '>') > 0 THEN strpos(html, '</' || tag || '>') + len(tag) + 2 ELSE len(html) END AS stop
    FROM pages_, (VALUES ('nav', 'namespace', 'namespace_declaration'), ('article', 'struct', 'struct_declaration'), ('h1', 'method', 'method_definition'), ('footer', 'function', 'function_declaration')) AS t(tag, kind, native_kind)
    WHERE strpos(html, '<' || tag || '>') > 0),
  rows_ AS (
    SELECT *, len(string_split(substr(html, 1, start), chr(10))) AS start_line, len(string_split(substr(html, 1, stop), chr(10))) AS end_line,
           nullif(regexp_extract(substr(html, start + 1), '^<(h1|footer)>([^\s<]+)', 2), '') AS word
    FROM declared),
  own AS (
    SELECT page_id, path, html, kind, native_kind, tag, start, stop, start_line, end_line, path || ':' || start || ':' || kind AS id, coalesce(word, '<anonymous@' || start_line || '>') AS name
    FROM rows_),
  owned AS (
    SELECT o.*, a.id AS owner, o.path || '::' || CASE WHEN o.tag = 'h1' THEN a.name || '.' ELSE '' END || o.name AS qualified_name, a.path || '::' || a.name AS owner_name
    FROM own o LEFT JOIN own a ON a.page_id = o.page_id AND a.tag = 'article' AND o.tag = 'h1'),
  every_page AS (
    SELECT id, kind, native_kind, name, qualified_name, path AS file_path, start_line, end_line, page_id * 4294967296 + start + 1 AS seq FROM owned
    UNION ALL SELECT 'file:' || path, 'file', NULL, string_split(path, '/')[-1], path, path, 1, 1, page_id FROM pages_)"""
PAGE_CALLS = PAGES + r""", sites AS (
    SELECT id AS owner, path || '::' || name AS owner_name, unnest(regexp_extract_all(substr(html, start + 1, stop - start), '<a [^>]*>([^\s<]+)', 1)) AS text,
           page_id * 4294967296 + start + 2 AS seq
    FROM own WHERE tag = 'nav'),
  texts AS (
    SELECT DISTINCT id, qualified_name, seq, text FROM (
      SELECT id, qualified_name, seq, name AS text FROM every_page
      UNION ALL SELECT id, qualified_name, seq, array_to_string(list_slice(string_split(qualified_name, '.'), k, len(string_split(qualified_name, '.'))), '.')
      FROM (SELECT *, unnest(range(2, len(string_split(qualified_name, '.')) + 1)) AS k FROM every_page)) WHERE text <> ''),
  cand AS (SELECT text, min(seq) AS first_seq, arg_min(id, seq) AS first_id, arg_min(qualified_name, seq) AS first_name FROM texts GROUP BY text)"""
# The lines after a change: words of files that aren't indexed swapped, those of one source gone
NEXT = """ next_lines AS (
    SELECT id, seq, file_path, name, text, qualified_name FROM lines WHERE file_path IN (SELECT path FROM dfiles WHERE is_indexed)
    UNION ALL SELECT id, seq, file_path, text, name, file_path || '::' || text FROM lines
    WHERE file_path IN (SELECT path FROM dfiles WHERE NOT is_indexed) AND NOT starts_with(file_path, 'src0/')),
  next_texts AS (
    SELECT DISTINCT id, qualified_name, seq, text FROM (
      SELECT id, qualified_name, seq, name AS text FROM next_lines
      UNION ALL
      SELECT id, qualified_name, seq, array_to_string(list_slice(string_split(qualified_name, '.'), k, len(string_split(qualified_name, '.'))), '.')
      FROM (SELECT *, unnest(range(2, len(string_split(qualified_name, '.')) + 1)) AS k FROM next_lines)) WHERE text <> ''),
  next_cand AS (SELECT text, min(seq) AS first_seq, arg_min(id, seq) AS first_id, arg_min(qualified_name, seq) AS first_name FROM next_texts GROUP BY text)"""
# An ordered walk: open texts are settled by falling length, each against the symbols made so far
IN_ORDER = """ met AS (SELECT text, min(seq) AS met FROM lines WHERE text <> '' GROUP BY text),
  opened AS MATERIALIZED (
    SELECT text, met, row_number() OVER (ORDER BY len(string_split(text, '.')) DESC, text) AS k
    FROM met LEFT JOIN cand USING (text) WHERE first_seq IS NULL OR met < first_seq),
  levels AS (SELECT len(string_split(text, '.')) AS dots, list({'t': text, 'm': met}) AS texts FROM opened GROUP BY 1),
  settled AS (
    SELECT (SELECT coalesce(max(dots), 0) + 1 FROM levels) AS dots, []::STRUCT(t VARCHAR, m BIGINT)[] AS made
    UNION ALL
    SELECT s.dots - 1, made || list_filter(texts, lambda x: len(list_filter(made, lambda y: y.m <= x.m AND ends_with(y.t, '.' || x.t))) = 0)
    FROM settled s LEFT JOIN levels l ON l.dots = s.dots - 1 WHERE s.dots > 1),
  symbols AS (SELECT made.t AS text, made.m AS symbol_seq FROM (SELECT unnest(made) AS made FROM settled WHERE dots = 1)),
  reach AS (
    SELECT text, arg_min(symbol, symbol_seq) AS symbol, min(symbol_seq) AS symbol_seq FROM (
      SELECT text, text AS symbol, symbol_seq FROM symbols
      UNION ALL SELECT array_to_string(list_slice(string_split(text, '.'), k, len(string_split(text, '.'))), '.'), text, symbol_seq
      FROM (SELECT *, unnest(range(2, len(string_split(text, '.')) + 1)) AS k FROM symbols)) GROUP BY text),
  met_calls AS (
    SELECT id AS owner, l.seq, l.text, s.symbol_seq IS NOT DISTINCT FROM l.seq AS creates, first_id, first_name,
           CASE WHEN s.symbol_seq IS NOT DISTINCT FROM l.seq THEN 'external:' || l.text WHEN first_seq <= coalesce(r.symbol_seq, first_seq) THEN first_id ELSE 'external:' || symbol END AS target
    FROM lines l LEFT JOIN cand USING (text) LEFT JOIN symbols s USING (text) LEFT JOIN reach r USING (text) WHERE l.text <> ''),
  walked AS (
    SELECT owner, CASE WHEN creates AND first_id IS NOT NULL THEN first_id ELSE target END AS target, CASE WHEN creates AND first_id IS NOT NULL THEN first_name ELSE text END AS target_name,
           CASE WHEN creates AND first_id IS NULL THEN 'unresolved' ELSE 'internal' END AS resolution, seq
    FROM met_calls)"""
WITH_FILES = EVERY + """, ents_f AS (
  SELECT * FROM every_ent UNION ALL SELECT 'file:' || path, 'file', NULL, NULL, path, language, seq - 1099511627776 FROM files WHERE seq % 10 <> 0)"""
SCORES = WITH_FILES + f""", scored AS (
  SELECT path, f.seq, coalesce(l.language, 'unknown') AS language,
         coalesce(ne, 0) + coalesce(nr, 0) + CASE WHEN coalesce(ui, false) THEN 100 ELSE 0 END + CASE WHEN entry THEN 40 ELSE 0 END + CASE WHEN coalesce(boundary, false) THEN 20 ELSE 0 END
           + ('0x' || substr(h, 1, 4))::BIGINT / 65535.0::DOUBLE AS score,
         list_filter([CASE WHEN ui THEN 'contains UI component' END, CASE WHEN entry THEN 'entry/service/test path' END, CASE WHEN boundary THEN 'boundary or unresolved relation' END], lambda x: x IS NOT NULL) AS why
  FROM (SELECT *, regexp_matches(path, '(?i)(entry|main|ability|service|controller|router|test)') AS entry, {fnv("('review-v1:' || path)")} AS h FROM files WHERE is_indexed) f
  LEFT JOIN (SELECT file_path, count(*) AS ne, bool_or(kind = 'component') AS ui FROM ents_f GROUP BY file_path) e ON e.file_path = path
  LEFT JOIN (SELECT file_path, count(*) AS nr, bool_or(resolution IN ('external', 'unresolved')) AS boundary FROM rels GROUP BY file_path) r ON r.file_path = path
  LEFT JOIN (SELECT file_path, arg_min(language, seq) AS language FROM ents_f WHERE kind = 'file' GROUP BY file_path) l ON l.file_path = path),
  ranked AS (SELECT *, CASE WHEN len(why) > 0 THEN why ELSE ['structural diversity'] END AS reasons,
             row_number() OVER (PARTITION BY language ORDER BY score DESC, path) AS place, min(seq) OVER (PARTITION BY language) AS stratum FROM scored),
  winners AS (SELECT path, stratum FROM ranked WHERE place = 1 ORDER BY stratum LIMIT 30),
  marked AS (SELECT r.path, r.score, r.reasons, w.stratum FROM ranked r LEFT JOIN winners w ON r.path = w.path),
  chosen AS (SELECT path FROM marked ORDER BY stratum IS NULL, stratum, score DESC, path LIMIT 30),
  sampled AS (SELECT path, path IN (SELECT path FROM chosen) AS selected, CASE WHEN stratum IS NOT NULL THEN list_append(reasons, 'language stratum') ELSE reasons END AS reasons FROM marked)"""


def verdict(ok: str) -> str:
    return f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END"


ORACLE_SQL = {
    "files_supported": f"WITH {DOC_PATHS} SELECT path, language FROM supported WHERE language IS NOT NULL",
    "files_one_language": f"WITH {DOC_PATHS} SELECT path, language FROM supported WHERE language = 'python'",
    "entity_projection": f"WITH {NODES} SELECT id, kind, native_kind, name, qualified_name, file_path, language, start_line::INT AS start_line, end_line::INT AS end_line, decorators, visibility, 'graph' AS provenance FROM projected",
    "component_kind": f"WITH {NODES} SELECT native_kind, kind, count(*) AS n FROM projected GROUP BY ALL",
    "relation_projection": f"""WITH {EVERY} SELECT DISTINCT {label('r.kind', 'r.source', 'r.target')} AS id, r.kind, r.source, r.target, s.qualified_name AS source_name, t.qualified_name AS target_name,
        nullif(s.file_path, '') AS file_path, CASE WHEN t.file_path = '' THEN 'external' ELSE 'internal' END AS resolution
      FROM rels r JOIN every_ent s ON r.source = s.id JOIN every_ent t ON r.target = t.id""",
    "key_name": f"WITH {LINES} SELECT seq, {key('name')} AS key FROM lines",
    "endpoint_name": f"WITH {LINES} SELECT seq, {endpoint('qualified_name')} AS key FROM lines",
    "entity_key": f"WITH {ENTITIES} SELECT id, kind || '|' || lower(file_path) || '|' || {key('name')} AS key FROM ents",
    "relation_key": f"WITH {RELATIONS} SELECT kind || '|' || {endpoint('source_name')} || '|' || {endpoint('target_name')} || '|' || resolution AS key, count(*) AS n FROM rels GROUP BY 1",
    "stable_id": f"SELECT p_partkey, {fnv('p_name')} AS label FROM part",
    "jitter": f"WITH {FILES} SELECT path, ('0x' || substr({fnv(chr(40) + chr(39) + 'review-v1:' + chr(39) + ' || path)')}, 1, 4))::BIGINT / 65535.0::DOUBLE AS jitter FROM files",
    "module_root": f"WITH {MANIFESTS} SELECT o_orderkey, regexp_replace(path, '(?i)/src/main/module\\.json5$', '') AS root FROM manifests",
    "package_name": f"WITH {MANIFESTS} SELECT o_orderkey, coalesce({NAMED}, string_split(folder, '/')[-1]) AS name FROM packs",
    "srcpath_root": f"WITH {MANIFESTS} SELECT o_orderkey, (CASE WHEN folder = '.' THEN '' ELSE folder || '/' END) || ['entry', 'entry', 'lib/core', 'a/b'][o_orderkey % 4 + 1] AS root FROM packs",
    "import_name": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name FROM part",
    "json_string_at": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS name FROM events",
    "endpoint_completion": f"""WITH {EVERY} SELECT DISTINCT x AS id, 'external_symbol' AS kind, x AS name, 'none' AS language
      FROM (SELECT unnest([source, target]) AS x FROM rels) WHERE x NOT IN (SELECT id FROM every_ent)""",
    "file_entity_completion": f"WITH {DOC_FILES} SELECT 'file:' || {fnv('path')} AS id, string_split(path, '/')[-1] AS name, path AS file_path, language FROM dfiles WHERE NOT is_indexed",
    "prefix_containment": f"""WITH {FILES}, roots AS (
        SELECT 'r' || n_regionkey || '/n' || n_nationkey AS root FROM nation UNION SELECT 'r' || n_regionkey FROM nation UNION SELECT '')
      SELECT root, count(*) AS n_files FROM roots JOIN files ON root = '' OR path = root OR starts_with(path, root || '/') GROUP BY root""",
    "module_applies": f"""WITH {FILES}, owners AS (
        SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'module' ELSE 'package' END AS kind, n_nationkey, lower('R' || n_regionkey || '/n' || n_nationkey) AS root FROM nation)
      SELECT kind || ':' || n_nationkey AS id, kind FROM owners WHERE EXISTS (SELECT 1 FROM files WHERE is_indexed AND starts_with(lower(path), root || '/'))""",
    "coverage": f"""WITH {FILES} SELECT count(DISTINCT lower(path)) AS candidate_files, count(DISTINCT lower(path)) FILTER (is_indexed) AS indexed_files,
        count(DISTINCT lower(path)) FILTER (is_indexed) AS covered_files,
        coalesce(count(DISTINCT lower(path)) FILTER (is_indexed) / nullif(count(DISTINCT lower(path)), 0)::DOUBLE, 1.0) AS file_coverage FROM files""",
    "missing_files": f"WITH {DOC_FILES} SELECT path FROM dfiles WHERE NOT is_indexed",
    "orphan_edges": f"WITH {EVERY} SELECT kind, source, target, count(*) AS n FROM rels WHERE source NOT IN (SELECT id FROM every_ent) OR target NOT IN (SELECT id FROM every_ent) GROUP BY ALL",
    "zero_symbol_files": f"WITH {LINES}, {SYMBOLS} SELECT path FROM dfiles WHERE is_indexed AND path NOT IN ({SYMBOL_FILES})",
    "diagnostic_text": f"""WITH {EVERY}, {LINES}, {SYMBOLS},
      m AS (SELECT path FROM dfiles WHERE NOT is_indexed),
      z AS (SELECT path FROM dfiles WHERE is_indexed AND path NOT IN ({SYMBOL_FILES})),
      o AS (SELECT count(*) AS n FROM rels WHERE source NOT IN (SELECT id FROM every_ent) OR target NOT IN (SELECT id FROM every_ent))
      SELECT 0::INT AS place, (SELECT count(*) FROM m) || ' supported source file(s) were not indexed: ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM m ORDER BY path LIMIT 10)) AS line WHERE (SELECT count(*) FROM m) > 0
      UNION ALL SELECT 1, n || ' relation(s) have missing endpoints' FROM o WHERE n > 0
      UNION ALL SELECT 2, (SELECT count(*) FROM z) || ' indexed source file(s) produced zero symbols: ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM z ORDER BY path LIMIT 10)) WHERE (SELECT count(*) FROM z) > 0""",
    "entity_precision_recall": f"WITH {STARS}, {overlap(f'{ENT_KEY} FROM a_ents WHERE {EVALUATED}', f'{ENT_KEY} FROM t_ents WHERE {EVALUATED}')} {RATES}",
    "edge_precision_recall": f"WITH {STARS}, {overlap(f'{REL_KEY} FROM rels WHERE is_actual', f'{REL_KEY} FROM rels WHERE is_truth')} {RATES}",
    "engine_agreement": f"""WITH {STARS}, scope AS (SELECT path FROM files WHERE is_indexed),
      {overlap(f'{ENT_KEY} FROM a_ents WHERE {EVALUATED} AND file_path IN (FROM scope)', f'{ENT_KEY} FROM t_ents WHERE {EVALUATED} AND file_path IN (FROM scope)', '_e')},
      {overlap(f'{REL_KEY} FROM rels WHERE is_actual AND file_path IN (FROM scope)', f'{REL_KEY} FROM rels WHERE is_truth AND file_path IN (FROM scope)')}
      SELECT 1.0::DOUBLE AS file_coverage, (SELECT count(*) FROM scope) AS candidate_files, (SELECT count(*) FROM scope) AS indexed_files,
        (SELECT count(*) FROM a_ents WHERE {EVALUATED} AND file_path IN (FROM scope)) AS entities, (SELECT count(*) FROM rels WHERE is_actual AND file_path IN (FROM scope)) AS relations,
        n_e.n_both / nullif(n_e.n_truth, 0)::DOUBLE AS entity_recall, n_e.n_both / nullif(n_e.n_actual, 0)::DOUBLE AS entity_precision,
        n.n_both / nullif(n.n_truth, 0)::DOUBLE AS edge_recall, n.n_both / nullif(n.n_actual, 0)::DOUBLE AS edge_precision FROM n_e, n""",
    "count_entities_by_kind": f"WITH {EVERY} SELECT kind, count(*) AS n FROM every_ent GROUP BY kind",
    "count_relations_by_kind": f"WITH {RELATIONS} SELECT kind, count(*) AS n FROM rels GROUP BY kind",
    "count_relations_by_resolution": f"WITH {RELATIONS} SELECT resolution, count(*) AS n FROM rels GROUP BY resolution",
    "summary_by_language": f"""WITH {WITH_FILES}, tagged AS (
        SELECT coalesce(e.language, 'unknown') AS language, 1 AS f, 0 AS e, 0 AS r FROM files LEFT JOIN (SELECT file_path, arg_min(language, seq) AS language FROM ents_f WHERE kind = 'file' GROUP BY 1) e ON file_path = path WHERE is_indexed
        UNION ALL SELECT language, 0, 1, 0 FROM ents_f
        UNION ALL SELECT coalesce(s.language, 'none'), 0, 0, 1 FROM rels LEFT JOIN every_ent s ON s.id = CASE WHEN rels.seq % 9 = 0 THEN 'lost' ELSE source END)
      SELECT language, sum(f)::BIGINT AS files, sum(e)::BIGINT AS entities, sum(r)::BIGINT AS relations FROM tagged GROUP BY language""",
    "acceptance": f"""SELECT o_orderkey, {verdict('(o_orderkey % 11) / 10.0::DOUBLE >= 0.95')} AS file_coverage,
        CASE WHEN o_orderkey % 3 = 0 THEN 'not-evaluated' ELSE {verdict('(o_orderkey % 20) / 20.0::DOUBLE >= 0.85')} END AS entity_recall,
        CASE WHEN o_orderkey % 4 = 0 THEN 'not-evaluated' ELSE {verdict('(o_orderkey % 10) / 10.0::DOUBLE >= 0.9')} END AS edge_precision,
        {verdict('o_orderkey % 5 > 0 AND o_totalprice / 20 <= 5000')} AS incremental_staleness, 'pass' AS no_crash FROM orders""",
    "upper_median": "SELECT event_type, list_sort(list(value))[(count(*) // 2)::INT + 1] AS median, count(*) AS n FROM events GROUP BY event_type",
    "last_write_wins": "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "first_write_wins": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id",
    "first_match": "SELECT event_type, arg_min(user_id, event_id) AS first_user FROM events GROUP BY event_type",
    "sample_scores": f"WITH {SCORES} SELECT path, language, round(score, 9) AS score, array_to_string(reasons, '; ') AS reasons FROM ranked",
    "sample_strata": f"WITH {SCORES} SELECT path, stratum FROM winners",
    "sample_select": f"WITH {SCORES} SELECT path FROM chosen",
    "sample_reasons": f"WITH {SCORES} SELECT array_to_string(reasons, '; ') AS reasons, selected, count(*) AS n FROM sampled GROUP BY ALL",
    "review_seed_entities": f"""WITH {SCORES}, edges AS (SELECT * FROM rels WHERE file_path IN (FROM chosen))
      SELECT id, kind, file_path, 'manual' AS provenance FROM every_ent WHERE file_path IN (FROM chosen) OR id IN (SELECT source FROM edges) OR id IN (SELECT target FROM edges)""",
    "review_seed_relations": f"WITH {SCORES} SELECT kind, source, target, 'manual' AS provenance, count(*) AS n FROM rels WHERE file_path IN (FROM chosen) GROUP BY ALL",
    "reviewed_gate": "SELECT o_orderkey, o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS is_truth FROM orders",
    "call_resolution": f"""WITH {LINES}, {DOT_TEXTS} SELECT l.id AS owner, l.text, c.first_id AS target, CASE WHEN c.first_id IS NULL THEN 'unresolved' ELSE 'internal' END AS resolution,
        CASE WHEN c.first_id IS NULL THEN 'external' WHEN c.first_seq <= l.seq THEN 'visit' ELSE 'forward' END AS pass FROM lines l LEFT JOIN cand c ON l.text = c.text WHERE l.text <> ''""",
    "call_resolution_in_order": f"WITH RECURSIVE {LINES}, {DOT_TEXTS}, {IN_ORDER} SELECT owner, target, target_name, resolution, seq FROM walked",
    "calls_after_change": f"""WITH {LINES}, {NEXT} SELECT l.id AS owner, l.text, c.first_id AS target, coalesce(c.first_name, l.text) AS target_name,
        CASE WHEN c.first_id IS NULL THEN 'unresolved' ELSE 'internal' END AS resolution, CASE WHEN c.first_id IS NULL THEN 'external' WHEN c.first_seq <= l.seq THEN 'visit' ELSE 'forward' END AS pass
      FROM next_lines l LEFT JOIN next_cand c ON l.text = c.text WHERE l.text <> ''""",
    "calls_resolved_anew": f"""WITH {LINES}, {DOT_TEXTS}, {NEXT} SELECT l.id AS owner, l.text, n.first_id AS target, CASE WHEN n.first_id IS NULL THEN 'unresolved' ELSE 'internal' END AS resolution
      FROM lines l LEFT JOIN cand c ON l.text = c.text LEFT JOIN next_cand n ON l.text = n.text
      WHERE l.text <> '' AND l.file_path IN (SELECT path FROM dfiles WHERE is_indexed) AND (c.first_id, c.first_name, c.first_seq) IS DISTINCT FROM (n.first_id, n.first_name, n.first_seq)""",
    "page_entities": f"WITH {PAGES} SELECT id, kind, native_kind, name, qualified_name, file_path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM every_page",
    "page_owners": f"""WITH {PAGES} SELECT coalesce(owner, 'file:' || path) AS source, id AS target, CASE WHEN owner IS NULL THEN path ELSE owner_name END AS source_name,
        qualified_name AS target_name, path AS file_path FROM owned""",
    "page_decorators": f"""WITH {PAGES} SELECT id, regexp_extract(substr(html, 1, start), '<div[^>]*>[^<]*</div>$') AS decorators FROM own WHERE tag = 'article' AND regexp_matches(substr(html, 1, start), '<div[^>]*>[^<]*</div>$')""",
    "page_calls": f"""WITH {PAGE_CALLS} SELECT owner AS source, coalesce(first_id, 'external:' || s.text) AS target, owner_name AS source_name, coalesce(first_name, s.text) AS target_name,
        CASE WHEN first_id IS NULL THEN 'unresolved' ELSE 'internal' END AS resolution FROM sites s LEFT JOIN cand c ON s.text = c.text""",
    "page_node_types": """WITH tags AS (
        SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)[^>]*>).*?(</(script|style)>)', '\\1', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS tag FROM pages)
      SELECT coalesce(map {'nav': 'namespace_declaration', 'article': 'struct_declaration', 'h1': 'method_definition', 'footer': 'function_declaration', 'a': 'call_expression', 'div': 'decorator'}[lower(tag)], lower(tag)) AS type,
        count(*) AS n FROM tags GROUP BY 1""",
    "counts_after_change": f"""WITH {LINES}, {NEXT}, every_line AS (SELECT n.*, l.language FROM next_lines n JOIN lines l USING (id))
      SELECT 'entities_by_kind' AS measure, CASE WHEN text = '' THEN 'line' ELSE 'call' END AS value, count(*) AS n FROM every_line GROUP BY 1, 2
      UNION ALL SELECT 'entities_by_language', language, count(*) FROM every_line GROUP BY 1, 2
      UNION ALL SELECT 'relations_by_kind', 'calls', count(*) FROM every_line WHERE text <> ''
      UNION ALL SELECT 'relations_by_resolution', CASE WHEN name = text THEN 'internal' ELSE 'unresolved' END, count(*) FROM every_line WHERE text <> '' GROUP BY 1, 2""",
    "manifest_scan": f"""WITH {MANIFESTS}, scanned AS (
        SELECT ['', 'x/', '.git/', 'build/a/', 'a/.hidden/', 'src/oh_modules/b/', 'lib/'][o_orderkey % 7 + 1] || o_orderkey || '/' ||
               CASE o_orderkey % 3 WHEN 0 THEN '.package.json' WHEN 1 THEN string_split(path, '/')[-1] ELSE 'go.mod' END AS path FROM manifests)
      SELECT path FROM scanned WHERE NOT regexp_matches(path, '(^|/)([.]|(build|oh_modules|node_modules)(/|$))')""",
    "json5_facts": f"WITH {JSON5} SELECT path, module_name, modules FROM facts",
    "structure_of_json5": f"""WITH {FILES}, {JSON5}, declared AS (
        SELECT regexp_replace(path, '(?i)/src/main/module\\.json5$', '') AS root, coalesce(module_name, string_split(regexp_replace(path, '(?i)/src/main/module\\.json5$', ''), '/')[-1]) AS name, path AS manifest
        FROM facts WHERE path LIKE '%/module.json5'
        UNION ALL SELECT folder || '/lib/core', 'm' || k, path FROM facts WHERE modules <> ''),
      roots AS (SELECT root, min(manifest) AS manifest, arg_min(name, manifest) AS name FROM declared GROUP BY root)
      SELECT root, name, manifest, (SELECT count(*) FROM files WHERE root = '' OR path = root OR starts_with(path, root || '/')) AS n_files FROM roots""",
    "sample_all": f"WITH {FILES} SELECT path, true AS selected, 'all files selected' AS reasons FROM files WHERE is_indexed",
    "forward_calls": f"WITH {LINES}, {DOT_TEXTS} SELECT l.id AS owner, c.first_id AS target, c.first_name AS target_name FROM lines l JOIN cand c ON l.text = c.text WHERE c.first_seq > l.seq",
    "import_edges": f"""WITH {LINES} SELECT DISTINCT 'file:' || file_path AS source, 'external:' || {fnv('name')} AS target, file_path AS source_name, name AS target_name, 'external' AS resolution FROM lines WHERE name <> ''""",
    "incremental_replace": """SELECT user_id, event_id, event_type, value FROM events WHERE user_id % 7 <> 3
      UNION ALL SELECT user_id, event_id + 1000000, event_type, value * 2 FROM events WHERE user_id % 7 = 3 AND event_id % 2 = 0""",
    "graph_build_entities": f"""WITH {RELATIONS}
      SELECT id, kind, name, qualified_name, file_path, language, 'graph' AS provenance FROM ents
      UNION ALL SELECT 'repository:' || {fnv("'/repo'")}, 'repository', 'repo', 'repo', '', 'mixed', 'synthetic'
      UNION ALL SELECT 'file:' || {fnv('path')}, 'file', string_split(path, '/')[-1], path, path, language, 'synthetic' FROM files WHERE is_indexed
      UNION ALL SELECT DISTINCT target, 'external_symbol', target, target, '', 'none', 'synthetic' FROM rels""",
    "graph_build_relations": f"""WITH {RELATIONS}
      SELECT DISTINCT kind, source, target, source_name, target AS target_name, file_path, 'external' AS resolution, 'graph' AS provenance FROM rels
      UNION ALL SELECT 'contains', 'repository:' || {fnv("'/repo'")}, 'file:' || {fnv('path')}, 'repo', path, path, 'internal', 'synthetic' FROM files WHERE is_indexed""",
    "entry_paths": """SELECT path, regexp_matches(path, '(?i)(entry|main|ability|service|controller|router|test)') AS is_entry FROM (
        SELECT ['src/Main', 'lib/core', 'entryability', 'x/UserService', 'app/router', 'docs', 'unit-tests', 'controller'][doc_id % 8 + 1] || '/d' || doc_id || '.ts' AS path FROM documents)""",
    "speaking_owners": f"""WITH {LINES} SELECT owner_kind, count(*) AS n
      FROM (SELECT ['file', 'function', 'repository', 'method', 'import', 'class'][seq % 6 + 1] AS owner_kind FROM lines WHERE text <> '') WHERE owner_kind NOT IN ('file', 'repository', 'import') GROUP BY 1""",
    "figures_without_truth": f"""WITH {STARS} SELECT
        (SELECT count(*) FILTER (is_indexed) / count(*)::DOUBLE FROM files) AS file_coverage, (SELECT count(*) FROM files) AS candidate_files, (SELECT count(*) FILTER (is_indexed) FROM files) AS indexed_files,
        (SELECT count(*) FROM a_ents WHERE {EVALUATED}) AS entities, (SELECT count(*) FROM rels WHERE is_actual) AS relations,
        NULL::DOUBLE AS entity_recall, NULL::DOUBLE AS entity_precision, NULL::DOUBLE AS edge_recall, NULL::DOUBLE AS edge_precision""",
    "profile_modules": f"""WITH {MANIFESTS}, one AS (SELECT path, folder, min(o_orderkey) AS k FROM packs GROUP BY path, folder), declared AS (
        SELECT regexp_replace(path, '(?i)/src/main/module\\.json5$', '') AS root, 'mod' || k AS name, path AS manifest, 0 AS pos FROM one WHERE path LIKE '%/module.json5'
        UNION ALL SELECT folder || '/entry', 'm' || k, path, 0 FROM one WHERE path LIKE '%/build-profile.json5'
        UNION ALL SELECT folder || '/lib/core', 'n' || k, path, 2 FROM one WHERE path LIKE '%/build-profile.json5')
      SELECT root, name, manifest FROM declared QUALIFY row_number() OVER (PARTITION BY root ORDER BY manifest, pos) = 1""",
    "affected_relations": f"""WITH {LINES}, {DOT_TEXTS}, rel AS (SELECT DISTINCT l.id AS source, c.first_id AS target, l.file_path FROM lines l JOIN cand c ON l.text = c.text WHERE l.text <> ''),
      changed AS (SELECT path FROM dfiles WHERE NOT is_indexed), ids AS (SELECT id FROM lines WHERE file_path IN (FROM changed))
      SELECT 'calls' AS kind, source, target, file_path FROM rel WHERE file_path NOT IN (FROM changed) AND (source IN (FROM ids) OR target IN (FROM ids))""",
    "project_structure": f"""WITH {FILES}, {MANIFESTS}, one AS (SELECT path, folder, arg_min(o_orderkey, content) AS o_orderkey, min(content) AS content FROM packs GROUP BY path, folder),
      mods AS (SELECT 'module' AS kind, regexp_replace(path, '(?i)/src/main/module\\.json5$', '') AS root, path AS manifest FROM one WHERE path LIKE '%/module.json5'),
      pks AS (SELECT 'package' AS kind, CASE WHEN folder = '.' THEN '' ELSE folder END AS root, path AS manifest,
                coalesce(CASE WHEN path = 'package.json' OR path LIKE '%/package.json' THEN CASE WHEN content LIKE '%pack%' THEN regexp_extract(content, 'pack[0-9]+') END END, string_split(folder, '/')[-1]) AS name FROM one WHERE path LIKE '%package.json' OR path LIKE '%pom.xml'),
      roots AS (
        SELECT kind, root, min(manifest) AS manifest, string_split(root, '/')[-1] AS name FROM mods GROUP BY kind, root
        UNION ALL SELECT kind, root, min(manifest), arg_min(name, manifest) FROM pks GROUP BY kind, root)
      SELECT kind, name, manifest AS file_path, CASE WHEN kind = 'module' THEN root ELSE '-' END AS root,
        (SELECT count(*) FROM files WHERE root = '' OR path = root OR starts_with(path, root || '/')) AS n_files FROM roots""",
}
