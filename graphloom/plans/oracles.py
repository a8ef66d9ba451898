"""DuckDB SQL for the rows of plans.registry: candidates are joined and counted for each call, not looked up."""

from __future__ import annotations

from graphloom.plans import samples

_BUILTINS = "('dict','list','set','frozenset','tuple','str','bytes','bytearray','int','float','complex','bool','object','type','BaseException','Exception')"

#: The derived corpus: symbols_0, calls_0, names_0, files_0, aliases_0.
_CORPUS = r"""
size AS (SELECT count(*) AS n FROM part),
k AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS base, p_size, p_brand, p_partkey % 4 AS role, (p_partkey // 4) % 40 AS m, (p_partkey // 4) % 5 AS p, (p_partkey // 160) * 40 AS top FROM part),
k2 AS (SELECT *, CASE WHEN m % 3 = 0 THEN 'rust' ELSE 'python' END AS lang,
    CASE role WHEN 0 THEN 'C_' || base || '_' || p_size WHEN 3 THEN 'f_' || base ELSE base END AS name,
    'pkg' || p || '/m' || m || CASE WHEN m % 3 = 0 THEN '.rs' ELSE '.py' END AS file FROM k),
symbols_0 AS (
    SELECT s.k AS id, s.file, s.k AS seq, s.name, CASE WHEN s.role = 0 THEN 'class' ELSE 'function' END AS kind, o.name AS parent_class,
        s.top + CASE s.role WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 14 ELSE 31 END AS start_line,
        s.top + CASE s.role WHEN 0 THEN 30 WHEN 1 THEN 12 WHEN 2 THEN 28 ELSE 39 END AS end_line,
        CASE WHEN s.role = 0 THEN 'class ' || s.name || ':' ELSE 'def ' || s.name || '():' END AS signature,
        b.name AS base_class, CASE WHEN s.k % 2 = 0 THEN 'Made by ' || s.p_brand END AS docstring, s.lang
    FROM k2 s CROSS JOIN size
    LEFT JOIN k2 o ON s.role IN (1, 2) AND o.k = s.k - s.role
    LEFT JOIN k2 b ON s.role = 0 AND s.k % 3 <> 0 AND b.k = (7 * s.k) % n - ((7 * s.k) % n) % 4),
calls_0 AS (
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, name, call_kind, receiver_class NULLS FIRST) AS seq,
        lang, enclosing, name, line, call_kind, receiver_class
    FROM (
        SELECT c.file, c.lang, c.name AS enclosing, l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(t.name, 'ext_' || (l_orderkey % 17)) AS name,
            c.start_line + 1 + l_linenumber AS line, CASE WHEN l_returnflag = 'N' THEN 'func' ELSE 'method' END AS call_kind,
            CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_suppkey % 4 = 0 THEN 'dict' WHEN l_suppkey % 4 = 1 THEN 'Pool'
                WHEN l_linestatus = 'F' THEN coalesce(t.parent_class, CASE WHEN t.kind = 'class' THEN t.name END, 'Nope') ELSE coalesce(u.name, 'Nope') END AS receiver_class
        FROM lineitem CROSS JOIN size JOIN symbols_0 c ON c.id = l_partkey
        LEFT JOIN symbols_0 t ON t.id = (31 * l_orderkey + 7 * l_suppkey + l_linenumber) % ((5 * n) // 4)
        LEFT JOIN symbols_0 u ON u.id = 4 * (l_orderkey % 50))),
paths_0 AS (SELECT DISTINCT file AS path, lang, CAST(regexp_extract(file, 'm([0-9]+)', 1) AS BIGINT) AS m, CAST(regexp_extract(file, 'pkg([0-9]+)', 1) AS BIGINT) AS p FROM symbols_0),
files_0 AS (SELECT path, paths_0.lang, sha256(coalesce(text, '')) AS hash, text AS content FROM paths_0 LEFT JOIN documents ON doc_id = m * 5 + p),
names_0 AS (
    SELECT f.path AS file, x.id AS seq, x.name AS local, CASE WHEN x.id % 5 = 0 THEN 'nowhere.mod' ELSE replace(regexp_replace(x.file, '[.](py|rs)$', ''), '/', '.') END AS source_module
    FROM paths_0 f JOIN symbols_0 x ON x.kind = 'function' AND x.id < 400 AND (length(f.path) + x.id) % 11 = 0
    UNION ALL SELECT path, 0, 'Pool', 'ext.sdk' FROM paths_0 WHERE lang = 'python'),
aliases_0 AS (
    SELECT h.file, o_orderkey AS seq, 'ext_' || (o_orderkey % 17) AS local, s.name AS source
    FROM orders CROSS JOIN size JOIN symbols_0 h ON h.id = o_custkey % n JOIN symbols_0 s ON s.id = (13 * o_custkey) % n WHERE o_orderkey % 11 = 0),
failures_0 AS (SELECT path AS file, 'suspect: parsed with zero defs/calls/imports for a non-empty file' AS error FROM paths_0 WHERE m % 13 = 0)
"""


def _edges(s: str = "_0", callee: str = "c.name", suffix: str = "") -> str:
    """CTEs up to edges<suffix>, from symbols<s>, calls<s>, files<s> and names<s>: each call against all its candidates."""
    return rf"""
first_names{suffix} AS (SELECT file, local, replace(source_module, '.', '/') || '.py' AS module FROM (
    SELECT *, row_number() OVER (PARTITION BY file, local ORDER BY seq, source_module) AS r FROM names{s}) WHERE r = 1),
alone{suffix} AS (SELECT name, lang, count(*) AS n, min(kind) AS kind, min(base_class) AS base FROM symbols{s} GROUP BY name, lang),
told{suffix} AS (
    SELECT c.file, c.seq, c.lang, c.enclosing, c.name AS plain, {callee} AS name, c.line, c.call_kind, c.receiver_class, i.module, r.n AS rn, r.kind AS rkind, r.base,
        b.n = 1 AND b.kind = 'class' AS good_base,
        c.receiver_class IN {_BUILTINS} OR (x.module IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files{s} f WHERE f.path = x.module OR f.path LIKE '%/' || x.module)) AS outside
    FROM calls{s} c
    {"LEFT JOIN (SELECT file, local, arg_max(source, seq) AS source FROM aliases_0 GROUP BY ALL) a ON a.file = c.file AND a.local = c.name" if "source" in callee else ""}
    LEFT JOIN first_names{suffix} i ON c.call_kind = 'func' AND i.file = c.file AND i.local = {callee}
    LEFT JOIN first_names{suffix} x ON c.call_kind = 'method' AND x.file = c.file AND x.local = c.receiver_class
    LEFT JOIN alone{suffix} r ON c.call_kind = 'method' AND r.name = c.receiver_class AND r.lang = c.lang
    LEFT JOIN alone{suffix} b ON b.name = r.base AND b.lang = c.lang),
tried{suffix} AS (
    SELECT t.file, t.seq, any_value(t) AS t, count(d.id) AS cn, min(d.id) AS c1,
        count(d.id) FILTER (d.parent_class = t.receiver_class) AS pn, min(d.id) FILTER (d.parent_class = t.receiver_class) AS p1,
        count(d.id) FILTER (d.parent_class = t.base) AS hn, min(d.id) FILTER (d.parent_class = t.base) AS h1,
        count(d.id) FILTER (d.parent_class IS NULL) AS mn, min(d.id) FILTER (d.parent_class IS NULL) AS m1,
        arg_max(d.id, d.seq) FILTER (d.parent_class IS NULL AND d.file = t.file) AS s1,
        count(d.id) FILTER (d.parent_class IS NULL AND (d.file = t.file OR d.file = t.module OR d.file LIKE '%/' || t.module)) AS inn,
        min(d.id) FILTER (d.parent_class IS NULL AND (d.file = t.file OR d.file = t.module OR d.file LIKE '%/' || t.module)) AS i1
    FROM told{suffix} t LEFT JOIN symbols{s} d ON d.name = t.name AND d.lang = t.lang GROUP BY t.file, t.seq),
ruled{suffix} AS (
    SELECT *, CASE WHEN cn = 0 THEN 'U'
        WHEN t.call_kind = 'method' AND t.receiver_class IS NOT NULL AND t.rn IS NULL AND cn > 1 AND t.lang = 'python' AND t.outside THEN 'EXT'
        WHEN t.call_kind = 'method' AND t.rn = 1 AND t.rkind = 'class' AND pn > 0 THEN CASE WHEN pn = 1 THEN 'RC' ELSE 'A_RC' END
        WHEN t.call_kind = 'method' AND t.rn = 1 AND t.rkind = 'class' AND t.good_base AND hn = 1 THEN 'BASE'
        WHEN t.call_kind = 'func' AND t.module IS NOT NULL AND inn > 0 THEN CASE WHEN inn = 1 THEN 'IMP' ELSE 'A_IMP' END
        WHEN t.call_kind = 'func' AND s1 IS NOT NULL THEN 'SAME'
        WHEN t.call_kind = 'func' AND mn > 0 THEN CASE WHEN mn = 1 THEN 'MOD' ELSE 'A_MOD' END
        WHEN cn = 1 THEN 'ONE' ELSE 'A' END AS rule FROM tried{suffix}),
homes{suffix} AS (SELECT file, name, arg_min(id, seq) AS id FROM symbols{s} GROUP BY file, name),
edges{suffix} AS (
    SELECT e.file, e.seq, t.line, t.lang, h.id AS caller_id, CASE rule WHEN 'RC' THEN p1 WHEN 'BASE' THEN h1 WHEN 'IMP' THEN i1 WHEN 'SAME' THEN s1 WHEN 'MOD' THEN m1 WHEN 'ONE' THEN c1 END AS callee_id,
        t.name AS callee_name, t.plain AS name, rule, t.call_kind, t.receiver_class,
        CASE WHEN rule IN ('U', 'EXT') THEN 'unresolved' WHEN rule LIKE 'A%' THEN 'ambiguous' ELSE 'exact' END AS kind
    FROM ruled{suffix} e LEFT JOIN homes{suffix} h ON h.file = e.file AND h.name = e.t.enclosing)
"""


def _q(select: str, *more: str, edges: str | None = None) -> str:
    parts = [_CORPUS, *([edges] if edges else []), *more]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def _e(select: str, *more: str) -> str:
    return _q(select, *more, edges=_edges())


_FQ = r"concat_ws('.', replace(regexp_replace(regexp_replace(file, '\.(py|rs)$', ''), '^src/', ''), '/', '.'), parent_class, name)"
_LABELS = "count(*) AS edges, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'ambiguous') AS ambiguous, count(*) FILTER (kind = 'unresolved') AS unresolved"
_WANTED = "wanted AS (SELECT DISTINCT name AS wanted FROM symbols_0 WHERE id % 7 = 0)"
_MODULES = r"""
modules AS (SELECT DISTINCT unnest([path, regexp_extract(path, '[^/]+$'), replace(regexp_replace(path, '\.(py|rs)$', ''), '/', '.'), 'no.such.module']) AS module FROM paths_0 WHERE m % 3 <> 1),
asked AS (SELECT module, CASE WHEN regexp_matches(module, '\.(py|rs)$') THEN module ELSE replace(module, '.', '/') || '.py' END AS want FROM modules),
found AS (SELECT module, coalesce((SELECT arg_min(path, (path <> want, path)) FROM files_0 WHERE path = want OR ends_with(path, '/' || want)), want) AS file FROM asked),
open AS (SELECT DISTINCT file FROM found)
"""
_RANGES = r"""
ranges AS (SELECT 'pkg' || ((o_orderkey % 40) % 5) || '/m' || (o_orderkey % 40) || CASE WHEN (o_orderkey % 40) % 3 = 0 THEN '.rs' ELSE '.py' END AS file,
    1 + o_custkey % 400 AS a, 1 + o_custkey % 400 + o_orderkey % 5 AS b FROM orders WHERE o_orderkey % 97 = 0),
hit AS (SELECT * FROM symbols_0 s WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.file = s.file AND s.start_line <= r.b AND s.end_line >= r.a))
"""
_MUTATED = r"""
symbols_1 AS (SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN name || '_v2' ELSE name END AS name) FROM symbols_0 WHERE file NOT LIKE '%/m7.py'
    UNION ALL SELECT -1, 'new/extra.py', 0, 'ext_3', 'function', NULL, 1, 2, 'def ext_3():', NULL, NULL, 'python'),
calls_1 AS (SELECT * FROM calls_0 WHERE file NOT LIKE '%/m7.py'),
names_1 AS (SELECT * FROM names_0 WHERE file NOT LIKE '%/m7.py'),
files_1 AS (SELECT path FROM files_0 WHERE path NOT LIKE '%/m7.py' UNION ALL SELECT 'new/extra.py'),
touched AS (SELECT DISTINCT file AS path, 'changed' AS change FROM symbols_0 WHERE id % 97 = 0 AND file NOT LIKE '%/m7.py'),
changes AS (SELECT * FROM touched UNION ALL SELECT 'new/extra.py', 'added' UNION ALL SELECT DISTINCT path, 'deleted' FROM files_0 WHERE path LIKE '%/m7.py')
"""
_TESTED = r"""
moved AS (SELECT e.* REPLACE (regexp_replace(e.file, '^pkg3/m38', 'tests/m38') AS file), coalesce(s.name, '<module>') AS caller FROM edges e LEFT JOIN symbols_0 s ON s.id = e.caller_id),
ranked AS (SELECT *, file LIKE 'tests/%' AS is_test, row_number() OVER (PARTITION BY callee_name ORDER BY file LIKE 'tests/%' DESC, file, line, seq) AS place FROM moved)
"""


def _lookup(form: str) -> str:
    """Specs of one form, each tried as the target grammar says."""
    dotted = r"replace(regexp_replace(file, '\.(py|rs)$', ''), '/', '.')"
    base = "regexp_extract(file, '[^/]+$')"
    specs = {
        "bare": ["name"],
        "file_name": ["file || '::' || name", f"{base} || '::' || name"],
        "line": ["file || ':' || (start_line + 2)", f"{base} || ':' || (start_line + 2)"],
        "module": [f"{dotted} || '.' || name"],
        "class_method": ["coalesce(parent_class, 'NoClass') || '.' || name"],
    }[form]
    given = f"specs AS (SELECT DISTINCT unnest([{', '.join(specs)}]) AS spec FROM symbols_0 WHERE id % 17 = 0)"
    if form == "bare":
        return _q("SELECT spec, spec AS name, coalesce(id, -1) AS id FROM specs LEFT JOIN symbols_0 ON name = spec", given)
    if form == "file_name":
        return _q(
            "SELECT spec, n AS name, coalesce(id, -1) AS id FROM parts LEFT JOIN symbols_0 s ON s.name = n AND (s.file = f OR ends_with(s.file, '/' || f))",
            given, "parts AS (SELECT spec, split_part(spec, '::', 1) AS f, split_part(spec, '::', 2) AS n FROM specs)",
        )
    if form == "line":
        return _q(
            "SELECT spec, coalesce(name, spec) AS name, coalesce(id, -1) AS id FROM (SELECT spec, name, id, row_number() OVER (PARTITION BY spec ORDER BY end_line - start_line, file, start_line, seq) AS r "
            "FROM parts LEFT JOIN symbols_0 s ON (s.file = f OR ends_with(s.file, '/' || f)) AND start_line <= l AND end_line >= l) WHERE r = 1",
            given, "parts AS (SELECT spec, split_part(spec, ':', 1) AS f, CAST(split_part(spec, ':', 2) AS BIGINT) AS l FROM specs)",
        )
    return _q(
        "SELECT spec, coalesce(name, spec) AS name, coalesce(id, -1) AS id FROM specs LEFT JOIN (SELECT * FROM in_module UNION ALL SELECT * FROM in_class WHERE spec NOT IN (SELECT spec FROM in_module)) USING (spec)",
        given,
        r"parts AS (SELECT spec, regexp_extract(spec, '^(.*)\.([^.]*)$', 1) AS p, regexp_extract(spec, '^(.*)\.([^.]*)$', 2) AS n FROM specs)",
        "in_module AS (SELECT spec, name, id FROM parts JOIN symbols_0 s ON name = n AND parent_class IS NULL AND (file = replace(p, '.', '/') || '.py' OR ends_with(file, '/' || replace(p, '.', '/') || '.py')))",
        "in_class AS (SELECT spec, name, id FROM parts JOIN symbols_0 s ON name = n AND parent_class = regexp_extract(p, '[^.]*$'))",
    )


ORACLES: dict[str, str] = {
    "resolve_edges": _e("SELECT file, seq, line, callee_name, call_kind, receiver_class, coalesce(caller_id, -1) AS caller_id, coalesce(callee_id, -1) AS callee_id, kind, rule FROM edges"),
    "rule_histogram": _e("SELECT rule, kind, count(*) AS edges FROM edges GROUP BY ALL"),
    "label_totals": _e(f"SELECT {_LABELS} FROM edges"),
    "label_by_call_kind": _e(f"SELECT *, 1000 * exact // (exact + ambiguous) AS in_repo_exact_permille FROM (SELECT call_kind, {_LABELS} FROM edges GROUP BY call_kind)"),
    "status_counts": _e(f"SELECT {_LABELS}, (SELECT count(*) FROM files_0) AS files, (SELECT count(*) FROM symbols_0) AS symbols, (SELECT count(*) FROM names_0) AS imports, (SELECT count(*) FROM failures_0) AS unparsed FROM edges"),
    "resolve_edges_aliased": _q("SELECT file, seq, name, callee_name, kind, rule FROM edges WHERE name <> callee_name", edges=_edges(callee="coalesce(a.source, c.name)")),
    "alias_expand": _q(
        "SELECT c.file, c.name, coalesce(a.source, c.name) AS callee_name, count(*) AS calls FROM calls_0 c "
        "LEFT JOIN (SELECT file, local, source FROM aliases_0 x WHERE seq = (SELECT max(seq) FROM aliases_0 y WHERE y.file = x.file AND y.local = x.local)) a ON a.file = c.file AND a.local = c.name GROUP BY ALL"
    ),
    "import_resolve": _e("SELECT file, seq, callee_name, coalesce(callee_id, -1) AS callee_id, kind FROM edges WHERE rule IN ('IMP', 'A_IMP')"),
    "receiver_resolve": _e("SELECT file, seq, callee_name, receiver_class, coalesce(callee_id, -1) AS callee_id, kind FROM edges WHERE rule IN ('RC', 'A_RC')"),
    "base_hop": _e("SELECT file, seq, callee_name, receiver_class, callee_id FROM edges WHERE rule = 'BASE'"),
    "external_receivers": _e("SELECT receiver_class, count(*) AS calls, count(DISTINCT file) AS files FROM edges WHERE rule = 'EXT' GROUP BY ALL"),
    "same_file_last_def": _e("SELECT file, seq, callee_name, callee_id FROM edges WHERE rule = 'SAME'"),
    "caller_attribution": _q(
        "SELECT c.file, enclosing, min_id AS caller_id, count(*) AS calls FROM calls_0 c LEFT JOIN (SELECT file, name, min(id) AS min_id FROM symbols_0 GROUP BY ALL) s ON s.file = c.file AND s.name = c.enclosing GROUP BY ALL"
    ),
    "edge_candidates": _e(
        "SELECT e.callee_name, e.lang, candidates, count(*) AS edges FROM edges e JOIN (SELECT name, lang, count(*) AS candidates FROM symbols_0 GROUP BY ALL) s ON s.name = e.callee_name AND s.lang = e.lang WHERE kind = 'ambiguous' GROUP BY ALL"
    ),
    "top_externals": _e("SELECT callee_name, count(*) AS calls FROM edges WHERE kind = 'unresolved' GROUP BY 1 ORDER BY calls DESC, callee_name LIMIT 25"),
    "enumerate_all": _e(
        "SELECT name, coalesce(def_count, 0) AS def_count, coalesce(caller_count, 0) AS caller_count, coalesce(caller_file_count, 0) AS caller_file_count, "
        "coalesce(exact, 0) AS exact, coalesce(ambiguous, 0) AS ambiguous, coalesce(unresolved, 0) AS unresolved "
        f"FROM (SELECT name, count(*) AS def_count FROM symbols_0 GROUP BY 1) FULL JOIN (SELECT callee_name AS name, count(*) AS caller_count, count(DISTINCT file) AS caller_file_count, {_LABELS.partition(', ')[2]} FROM edges GROUP BY 1) USING (name)"
    ),
    "closure_callers": _e("SELECT callee_name AS name, coalesce(s.name, '<module>') AS caller, e.file, line, e.seq, e.kind AS resolution FROM edges e LEFT JOIN symbols_0 s ON s.id = e.caller_id"),
    "closure_callees": _e(
        "SELECT target AS name, callee_name, x.kind AS resolution, t.file AS callee_file, coalesce(t.start_line, -1) AS callee_line, signature, docstring FROM (SELECT s.name AS target, e.*, row_number() OVER "
        "(PARTITION BY s.name, callee_name ORDER BY s.file, s.start_line, s.id, e.seq) AS r FROM edges e JOIN symbols_0 s ON s.id = e.caller_id) x LEFT JOIN symbols_0 t ON t.id = x.callee_id WHERE r = 1"
    ),
    "fq_names": _q(f"SELECT {_FQ} AS fq_name, name, kind, file, start_line, end_line, signature, docstring, parent_class, id FROM symbols_0"),
    "exists_exact": _q(f"SELECT wanted, {_FQ} AS fq_name, kind, file, start_line, end_line, signature, docstring FROM symbols_0 JOIN wanted ON name = wanted", _WANTED),
    "exists_prefix": _q("SELECT head AS wanted, count(*) AS defs, count(DISTINCT file) AS files FROM (SELECT DISTINCT substr(wanted, 1, 5) AS head FROM wanted) JOIN symbols_0 ON starts_with(name, head) GROUP BY 1", _WANTED),
    "exists_imports": _q("SELECT DISTINCT wanted, file, source_module FROM names_0 JOIN wanted ON local = wanted", _WANTED),
    "surface_modules": _q("SELECT module, file, file IN (SELECT file FROM failures_0) AS unparsed FROM found", _MODULES),
    "surface_defs": _q("SELECT file, name, kind, start_line, end_line, signature, docstring FROM symbols_0 JOIN open USING (file) WHERE parent_class IS NULL", _MODULES),
    "surface_methods": _q(
        "SELECT m.file, m.name, m.kind, m.start_line, m.end_line, m.signature, m.docstring, c.name AS class_name, c.start_line AS class_line FROM symbols_0 m JOIN open USING (file) "
        "JOIN symbols_0 c ON c.file = m.file AND c.name = m.parent_class AND c.kind = 'class' AND c.parent_class IS NULL", _MODULES
    ),
    "surface_imports": _q("SELECT file, 'from ' || source_module || ' import ' || local AS raw, 1 + seq % 50 AS line FROM names_0 JOIN open USING (file)", _MODULES),
    **{f"lookup_{form}": _lookup(form) for form in ("bare", "file_name", "line", "module", "class_method")},
    "impact_changed": _e(
        f"SELECT {_FQ} AS fq_name, name, file, start_line, end_line, kind, 'changed' AS status, coalesce(n, 0) AS caller_count, coalesce(f, 0) AS caller_files, greatest(coalesce(n, 0) - 20, 0) AS callers_omitted "
        "FROM hit LEFT JOIN (SELECT callee_name, count(*) AS n, count(DISTINCT file) AS f FROM edges GROUP BY 1) ON callee_name = name", _RANGES
    ),
    "impact_callers_capped": _e(
        "SELECT callee_name AS name, place, coalesce(s.name, '<module>') AS caller, x.file, line, x.kind AS resolution FROM (SELECT *, row_number() OVER (PARTITION BY callee_name ORDER BY file, line, seq) AS place "
        "FROM edges WHERE callee_name IN (SELECT name FROM hit)) x LEFT JOIN symbols_0 s ON s.id = caller_id WHERE place <= 20", _RANGES
    ),
    "impact_files_no_symbols": _q(
        "SELECT DISTINCT file FROM (SELECT file FROM ranges UNION ALL SELECT 'new/n' || (o_orderkey % 7) || '.py' FROM orders WHERE o_orderkey % 1009 = 0) WHERE file NOT IN (SELECT file FROM hit)", _RANGES
    ),
    "impact_deleted": _e(
        f"SELECT {_FQ} AS fq_name, name, file, start_line, end_line, kind, 'deleted' AS status, coalesce(n, 0) AS caller_count, coalesce(f, 0) AS caller_files, greatest(coalesce(n, 0) - 20, 0) AS callers_omitted "
        "FROM symbols_0 LEFT JOIN (SELECT callee_name, count(*) AS n, count(DISTINCT file) AS f FROM edges WHERE file NOT LIKE '%/m7.py' GROUP BY 1) ON callee_name = name WHERE file LIKE '%/m7.py'"
    ),
    "delta_changed": _q("SELECT path, change FROM changes WHERE change <> 'deleted'", _MUTATED),
    "delta_deleted": _q("SELECT path FROM changes WHERE change = 'deleted'", _MUTATED),
    "delta_edges": _q("SELECT file, callee_name, kind, rule, count(*) AS edges, CAST(sum(seq) AS BIGINT) AS seqs FROM edges GROUP BY ALL", _MUTATED, _edges("_1")),
    "affected_names": _q("SELECT DISTINCT name FROM (SELECT file, name FROM symbols_0 UNION ALL SELECT file, name FROM symbols_1) WHERE file IN (SELECT path FROM changes)", _MUTATED),
    "delta_relabelled": _q(
        "SELECT a.file, a.seq, a.kind AS old_kind, b.kind AS new_kind FROM edges a JOIN edges_b b USING (file, seq) LEFT JOIN symbols_0 s ON s.id = a.callee_id LEFT JOIN symbols_1 t ON t.id = b.callee_id "
        "WHERE a.file NOT IN (SELECT path FROM changes) AND (a.kind <> b.kind OR (s.file, s.name, s.start_line) IS DISTINCT FROM (t.file, t.name, t.start_line))",
        _MUTATED, _edges(), _edges("_1", suffix="_b"),
    ),
    "bundle_callers_tests_first": _e("SELECT callee_name AS name, place, caller, kind AS resolution, is_test, file, line FROM ranked WHERE place <= 20", _TESTED),
    "bundle_omitted": _e(
        "SELECT callee_name AS name, count(*) AS caller_count, least(count(*), 20) AS callers_included, count(*) FILTER (is_test) AS test_caller_count, "
        "coalesce(string_agg(file || ':' || line, ',' ORDER BY place) FILTER (place > 20), '') AS omitted FROM ranked GROUP BY 1", _TESTED
    ),
    "bundle_snippets": _e(
        r"SELECT callee_name AS name, place, r.file, line, CASE WHEN is_test AND body <> '' THEN body ELSE array_to_string(lines[greatest(line - 3, 1) : greatest(line + 3, 1)], chr(10)) END AS snippet "
        "FROM spans r",
        _TESTED,
        r"texts AS (SELECT regexp_replace(path, '^pkg3/m38', 'tests/m38') AS file, string_split(regexp_replace(coalesce(content, ''), '\n$', ''), chr(10)) AS lines FROM files_0)",
        "spans AS (SELECT r.*, lines, array_to_string(lines[s.start_line : s.end_line][1 : 60], chr(10)) AS body FROM ranked r LEFT JOIN texts USING (file) LEFT JOIN symbols_0 s ON s.id = "
        "(SELECT arg_min(caller_id, seq) FROM ranked o WHERE o.callee_name = r.callee_name AND o.file = r.file AND o.line = r.line AND caller_id IS NOT NULL AND o.place <= 5) WHERE place <= 5)",
    ),
    "doc_spans": r"SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\n$', ''), chr(10))[greatest(doc_id % 3, 1) : doc_id % 3 + 2], chr(10)) AS span FROM documents",
    "doc_snippets": r"SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\n$', ''), chr(10))[greatest(doc_id % 6 - 1, 1) : doc_id % 6 + 1], chr(10)) AS snippet FROM documents",
    "doc_tokens": r"SELECT doc_id, (octet_length(encode(text)) + 3) // 4 AS tokens, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS lines, string_split(text, chr(10))[1] AS first_line FROM documents",
    "test_file_flags": _q(
        r"SELECT path, list_has_any(string_split(path, '/'), ['test', 'tests']) OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\.py$') AS is_test, CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' END AS lang "
        r"FROM (SELECT DISTINCT unnest([path, 'tests/' || path, 'a/test/' || path, 'a/test_' || regexp_extract(path, '[^/]+$'), 'contest/' || path, replace(path, '.py', '_test.py')]) AS path FROM paths_0)"
    ),
    "parse_failures_kinds": _q("SELECT split_part(error, ':', 1) AS kind, count(*) AS files FROM failures_0 GROUP BY 1"),
}

ORACLES |= {f"parse_{name}": samples.oracle(name) for name in samples.SOURCES}
