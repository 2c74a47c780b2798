"""DuckDB texts of the queries over source texts, with patterns of their own.

The operators read whole texts with patterns over many lines; these texts cut sources into
lines first and look at one line at a time wherever the rules allow it.
"""

from __future__ import annotations

from treeledger.functions.paths import resolve_sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE, _LETTERS = r"[ \t]+", r"[A-Za-z0-9_]+"
_STRING = r"""['"]([^'"]+)['"]"""
_SCRIPT = "(const|let|var|function|class|interface|type|enum)"
_RUST = "(fn|struct|enum|trait|type|const|static|mod)"

# kind, family, rule, pattern of one line, group. Rules are listed in the order in which names come.
LINE_RULES = (
    ("exports", "script", 1, rf"^export{_SPACE}((default|async|abstract){_SPACE})*{_SCRIPT}[ \t*]+({_LETTERS})", 4),
    ("exports", "python", 1, rf"^(async{_SPACE})?(def|class){_SPACE}([A-Za-z][A-Za-z0-9_]*)", 3),
    ("exports", "go", 1, rf"^func{_SPACE}(\([^()]*\)[ \t]*)?([A-Z][A-Za-z0-9_]*)", 2),
    ("exports", "go", 2, rf"^type{_SPACE}([A-Z][A-Za-z0-9_]*){_SPACE}(struct|interface)", 1),
    ("exports", "go", 3, rf"^var{_SPACE}([A-Z][A-Za-z0-9_]*)", 1),
    ("exports", "go", 4, rf"^const{_SPACE}([A-Z][A-Za-z0-9_]*)", 1),
    ("exports", "rust", 1, rf"^pub{_SPACE}(async{_SPACE})*{_RUST}{_SPACE}({_LETTERS})", 3),
    ("imports", "script", 1, rf"^import{_SPACE}.*?[ \t]from{_SPACE}{_STRING}", 1),
    ("imports", "script", 2, rf"^import{_SPACE}{_STRING}", 1),
    ("imports", "python", 1, rf"^from{_SPACE}([^ \t]+){_SPACE}import\b", 1),
    ("imports", "python", 2, rf"^import{_SPACE}([A-Za-z0-9_.]+)", 1),
    ("imports", "go", 2, rf'\bimport{_SPACE}({_LETTERS}{_SPACE})?"([^"]+)"', 2),
    ("imports", "rust", 2, rf"^[ \t]*mod{_SPACE}({_LETTERS})[ \t]*;", 1),
    ("declarations", "script", 1, rf"^((export|declare|abstract|async){_SPACE})*({_SCRIPT}[ \t*]+{_LETTERS})", 3),
    ("declarations", "python", 1, rf"^(async{_SPACE})?((def|class){_SPACE}{_LETTERS})", 2),
    ("declarations", "go", 1, rf"^(func{_SPACE}(\([^()]*\)[ \t]*)?{_LETTERS}|type{_SPACE}{_LETTERS}{_SPACE}(struct|interface)|(var|const){_SPACE}{_LETTERS})", 1),
    ("declarations", "rust", 1, rf"^((pub|async){_SPACE})*((impl|fn|struct|enum|trait|type|const|static|mod){_SPACE}{_LETTERS})", 3),
)
# kind, family, rule, SQL list of the names of a whole text.
_ALL_LIST = "regexp_extract(contents, '__all__\\s*=\\s*\\[([^\\]]*)\\]', 1)"
TEXT_RULES = (
    ("imports", "go", 1, "regexp_extract_all(array_to_string(regexp_extract_all(contents, '\\bimport[ \\t]*\\(([^()]*)\\)', 1), chr(10)), '\"([^\"]+)\"', 1)"),
    ("imports", "rust", 1, "regexp_extract_all(contents, '(?m)^(?:pub[ \\t]+)*use[ \\t]+([A-Za-z0-9_:]+(?:\\{[^}]*\\})?)\\s*;', 1)"),
    ("listed", "python", 1, f"CASE WHEN contains(contents, '__all__') THEN list_filter(list_transform(string_split({_ALL_LIST}, ','), lambda s: regexp_replace(s, '^\\s+|\\s+$|[''\"]', '', 'g')), lambda s: s <> '') ELSE [] END"),
)
_OTHERS = (
    (("json", "yml", "yaml", "env"), "config"), (("md",), "documentation"), (("css", "scss", "less"), "styles"), (("html",), "markup"),
    (("svg", "png", "jpg", "jpeg", "gif"), "asset"), (("sh", "bash"), "script"), (("lock",), "lockfile"),
)


def _purpose() -> str:
    others = " ".join(f"WHEN ext IN ({', '.join(_quoted('.' + x) for x in exts)}) THEN {_quoted(name)}" for exts, name in _OTHERS)
    return f"""CASE WHEN fam IS NULL THEN CASE {others} ELSE 'other' END WHEN ext = '.d.ts' THEN 'types' WHEN regexp_matches(base, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') THEN 'test'
  WHEN regexp_matches(base, '\\.config\\.(ts|tsx|js|jsx|mjs)$') THEN 'config' WHEN base IN ('types.ts', 'interfaces.ts') THEN 'types' WHEN base IN ('index.ts', 'index.js') THEN 'entry point'
  WHEN fam = 'python' THEN CASE WHEN base LIKE 'test\\_%' ESCAPE '\\' OR ends_with(base, '_test.py') OR contains(path, '/tests/') OR contains(path, '/test/') OR base = 'conftest.py' THEN 'test' WHEN base IN ('setup.py', 'settings.py', 'config.py') THEN 'config'
    WHEN base IN ('__init__.py', '__main__.py') OR regexp_matches(contents, '\\bif\\s+__name__\\s*==\\s*.__main__.\\s*:') THEN 'entry point' ELSE 'source' END
  WHEN fam = 'go' THEN CASE WHEN ends_with(base, '_test.go') THEN 'test' WHEN base = 'main.go' OR regexp_matches(contents, '\\bfunc\\s+main\\s*\\(') THEN 'entry point' ELSE 'source' END
  WHEN fam = 'rust' THEN CASE WHEN contains(path, '/tests/') OR starts_with(base, 'test_') THEN 'test' WHEN base IN ('main.rs', 'lib.rs', 'mod.rs') THEN 'entry point' WHEN base = 'build.rs' THEN 'config' WHEN regexp_matches(contents, '\\bfn\\s+main\\s*\\(') THEN 'entry point' ELSE 'source' END
  WHEN contains(path, '/bin/') OR regexp_matches(contents, '\\bmain\\s*\\(') THEN 'entry point' ELSE 'source' END"""


def summaries_sql(texts: str) -> str:
    """CTEs up to ``sums``: the summaries of the rows of the CTE ``texts`` (key, path, contents)."""
    by_line = "\n  UNION ALL ".join(f"SELECT key, '{k}', {r}, n, regexp_extract(line, {_quoted(p)}, {g}) FROM lines WHERE fam = '{f}' AND regexp_matches(line, {_quoted(p)})" for k, f, r, p, g in LINE_RULES)
    by_text = "\n  UNION ALL ".join(f"SELECT key, '{k}', {r}, generate_subscripts(l, 1), unnest(l) FROM (SELECT key, {e} AS l FROM typed WHERE fam = '{f}')" for k, f, r, e in TEXT_RULES)
    return f"""typed AS (SELECT *, string_split(path, '/')[-1] AS base, CASE WHEN ends_with(path, '.d.ts') THEN '.d.ts' ELSE regexp_extract(path, '(\\.[^.]*)$', 1) END AS ext,
  CASE WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$') THEN 'script' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.rs') THEN 'rust' END AS fam FROM {texts}),
lines AS (SELECT key, fam, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT key, fam, string_split(contents, chr(10)) AS l FROM typed WHERE fam IS NOT NULL)),
raw(key, kind, rule, n, name) AS ({by_line}
  UNION ALL {by_text}),
tidy AS (SELECT key, kind, rule, n, CASE WHEN kind = 'declarations' THEN regexp_replace(regexp_replace(regexp_replace(name, '^func[ \\t]+\\([^()]*\\)', 'func '), '[ \\t]*\\*', ' ', 'g'), '[ \\t]+', ' ', 'g') ELSE name END AS name FROM raw),
firsts AS (SELECT key, kind, name, min(rule * 1000000 + n) AS place FROM tidy GROUP BY 1, 2, 3),
named AS (SELECT key, kind, list(name ORDER BY place) AS l FROM firsts GROUP BY 1, 2),
lists AS (SELECT t.*, coalesce(CASE WHEN fam = 'python' AND regexp_matches(contents, '__all__\\s*=\\s*\\[[^\\]]*\\]') THEN coalesce(a.l, CAST([] AS VARCHAR[])) ELSE e.l END, CAST([] AS VARCHAR[]))
    || CASE WHEN fam = 'script' AND regexp_matches(contents, '(?m)^export[ \\t\\n]+default[ \\t\\r\\n]') THEN ['default'] ELSE CAST([] AS VARCHAR[]) END AS exports,
  coalesce(i.l, CAST([] AS VARCHAR[])) AS imports, coalesce(d.l, CAST([] AS VARCHAR[])) AS declarations, CAST(CASE WHEN contents = '' THEN 0 ELSE len(string_split(contents, chr(10))) END AS INTEGER) AS "lineCount"
  FROM typed t LEFT JOIN named e ON e.key = t.key AND e.kind = 'exports' LEFT JOIN named a ON a.key = t.key AND a.kind = 'listed'
  LEFT JOIN named i ON i.key = t.key AND i.kind = 'imports' LEFT JOIN named d ON d.key = t.key AND d.kind = 'declarations'),
purposed AS (SELECT *, {_purpose()} AS purpose FROM lists),
sums AS (SELECT *, CASE WHEN fam IS NULL THEN CASE WHEN "lineCount" > 0 AND ext IN ('.json', '.yaml', '.yml', '.toml') THEN 'medium' ELSE 'low' END
  WHEN "lineCount" = 0 OR len(exports) + len(imports) + len(declarations) = 0 THEN 'low' WHEN len(exports) > 0 OR purpose IN ('entry point', 'config', 'types', 'test') THEN 'high' ELSE 'medium' END AS confidence FROM purposed)"""


# Versions of source texts and the lines that each adds and removes.
VERSIONS = f"""v AS (SELECT DISTINCT {resolve_sql('path')} AS path, contents, mtime FROM source_files WHERE path IS NOT NULL AND contents IS NOT NULL AND mtime IS NOT NULL),
p AS (SELECT path, mtime, contents, row_number() OVER (ORDER BY path, mtime, contents) AS key, lag(contents) OVER (PARTITION BY path ORDER BY mtime, contents) AS before FROM v),
both_lines AS (SELECT key, 1 AS sign, unnest(string_split(contents, chr(10))) AS line FROM p WHERE before IS NOT NULL UNION ALL SELECT key, -1, unnest(string_split(before, chr(10))) FROM p WHERE before IS NOT NULL),
net AS (SELECT key, line, sum(sign) AS net FROM both_lines GROUP BY 1, 2),
d AS (SELECT key, CAST(coalesce(sum(net) FILTER (net > 0), 0) AS BIGINT) AS n_added, CAST(coalesce(-sum(net) FILTER (net < 0), 0) AS BIGINT) AS n_removed,
  coalesce(bool_or(net <> 0 AND (regexp_matches(line, '^\\s*import\\s') OR regexp_matches(line, '^\\s*export\\s+(default\\s|\\{{|\\*)') OR regexp_matches(line, '^\\s*export\\s+(default\\s+)?(const|let|var|function|class|interface|type|enum)\\b')
    OR regexp_matches(line, '^\\s*(abstract\\s+)?(function|class|interface|type|enum)\\s+[A-Za-z0-9_]'))), false) AS structural FROM net GROUP BY 1)"""

# Import references: pass, names (SQL of one match), module, type. Each pattern has at most three groups.
_ID = "([A-Za-z_$][A-Za-z0-9_$]*)"
REF_PASSES = {
    "script": (
        (rf"\bimport\s*(?:type\b)?\s*\{{([^{{}}]*)\}}\s*from\s*{_STRING}", "g1", "g2", "static"),
        (rf"\bimport\s+{_ID}\s*\bfrom\s*{_STRING}", "g1", "g2", "static"),
        (rf"\bimport\s*\*\s*as\s+{_ID}\s*\bfrom\s*{_STRING}", "'* as ' || g1", "g2", "static"),
        (rf"\bimport\s*{_STRING}", "''", "g1", "static"),
        (rf"\bimport\(\s*{_STRING}\s*\)", "''", "g1", "dynamic"),
        (rf"\bexport\s*\{{([^{{}}]*)\}}\s*from\s*{_STRING}", "g1", "g2", "re-export"),
        (rf"\bexport\s*\*\s*from\s*{_STRING}", "'*'", "g1", "re-export"),
        (rf"\brequire\(\s*{_STRING}\s*\)", "''", "g1", "static"),
    ),
    "python": (
        (r"(?m)^[ \t]*import[ \t]+([A-Za-z0-9_., \t]*[A-Za-z0-9_])", "''", "g1", "static"),
        (r"(?m)^[ \t]*from[ \t]+(\.{0,3}[A-Za-z0-9_.]*)[ \t]+import\b[ \t]*(?:\(([^)]*)\)|([^(;\n]+))", "g2 || g3", "g1", "static"),
    ),
    "go": ((r'\bimport[ \t]+(?:([A-Za-z0-9_.]+)[ \t]+)?"([^"]+)"', "g1", "g2", "static"),),
    "gogroup": ((r'(?:([A-Za-z0-9_.]+)[ \t]+)?"([^"]+)"', "g1", "g2", "static"),),
    "rust": (
        (r"\buse\s+([A-Za-z0-9_:]+)::\{([^}]*)\}\s*;", "g2", "g1", "static"),
        (r"\buse\s+([A-Za-z0-9_:]+)\s*;", "''", "g1", "static"),
        (r"\bmod\s+([A-Za-z0-9_]+)\s*;", "''", "'./' || g1", "static"),
    ),
    "kotlin": (
        (r"(?m)^[ \t]*import\s+([A-Za-z0-9_.]+)\.\*[ \t]*;?[ \t\r]*$", "'*'", "g1", "static"),
        (r"(?m)^[ \t]*import\s+([A-Za-z0-9_.]+)\s+as\s+([A-Za-z0-9_]+)[ \t]*;?[ \t\r]*$", "g2", "g1", "static"),
        (r"(?m)^[ \t]*import\s+([A-Za-z0-9_.]*[A-Za-z0-9_])[ \t]*;?[ \t\r]*$", "''", "g1", "static"),
    ),
    "java": (
        (r"(?m)^[ \t]*import\s+(?:static\s+)?([A-Za-z0-9_.]+)\.\*\s*;", "'*'", "g1", "static"),
        (r"(?m)^[ \t]*import\s+static\s+([A-Za-z0-9_.]+)\.([A-Za-z0-9_]+)\s*;", "g2", "g1", "static"),
        (r"(?m)^[ \t]*import\s+([A-Za-z0-9_.]*[A-Za-z0-9_])\s*;", "''", "g1", "static"),
    ),
}


def _groups(pattern: str) -> int:
    return pattern.replace("(?", "").replace("\\(", "").count("(")


def _refs(fam: str, source: str, first: int) -> str:
    out = []
    for number, (pattern, names, module, kind) in enumerate(REF_PASSES[fam]):
        lists = ", ".join(f"regexp_extract_all(plain, {_quoted(pattern)}, {g}) AS l{g}" for g in range(1, _groups(pattern) + 1))
        groups = ", ".join(f"coalesce(l{g}[n], '') AS g{g}" for g in range(1, _groups(pattern) + 1))
        out.append(f"SELECT path AS source, {first + number} AS pass, n, {module} AS module, {names} AS names, '{kind}' AS import_type FROM (SELECT path, n, {groups} FROM (SELECT path, {lists} FROM {source}), LATERAL (SELECT unnest(range(1, len(l1) + 1)) AS n))")
    return "\nUNION ALL ".join(out)


_COMMENTS = r"regexp_replace(regexp_replace(contents, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g')"
_PY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(contents, '''''''[\\s\\S]*?''''''', '', 'g'), '\"\"\"[\\s\\S]*?\"\"\"', '', 'g'), '#[^\\n]*', '', 'g'), '\\\\\\r?\\n', ' ', 'g')"
_PLAIN = {
    "script": ("regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')", "contents"),
    "python": ("ends_with(path, '.py')", _PY),
    "go": ("ends_with(path, '.go')", f"regexp_replace({_COMMENTS}, '`[^`]*`', '', 'g')"),
    "rust": ("ends_with(path, '.rs')", f"regexp_replace({_COMMENTS}, 'r#+\"[\\s\\S]*?\"#+', '', 'g')"),
    "kotlin": ("regexp_matches(path, '\\.kts?$')", f"regexp_replace({_COMMENTS}, '\"\"\"[\\s\\S]*?\"\"\"', '', 'g')"),
    "java": ("ends_with(path, '.java')", f"regexp_replace({_COMMENTS}, '\"\"\"[\\s\\S]*?\"\"\"', '', 'g')"),
}
_TRY = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def import_refs_sql(sources: str, files: str) -> str:
    """References and their targets: every candidate path is looked up among the files, the first one found counts.

    ``sources`` and ``files`` are the CTEs src (path, contents) and f (path).
    """
    plains = ",\n".join(f"t_{fam} AS (SELECT path, {text} AS plain FROM src WHERE contents IS NOT NULL AND {where})" for fam, (where, text) in _PLAIN.items())
    grouped = "t_gogroup AS (SELECT path, array_to_string(regexp_extract_all(plain, '\\bimport\\s*\\(([^()]*)\\)', 1), chr(10)) AS plain FROM t_go)"
    rows = "\nUNION ALL ".join(f"SELECT *, '{fam.removesuffix('group')}' AS fam FROM ({_refs(fam, f't_{fam}', 10 if fam == 'gogroup' else 0)})" for fam in REF_PASSES)
    joined = resolve_sql("folder || '/' || module")
    script = ["b", *(f"CASE WHEN regexp_matches(b, '[^./]\\.{old}$') THEN regexp_replace(b, '\\.{old}$', '.{new}') END" for old, news in (("js", ("ts", "tsx")), ("jsx", ("tsx",)), ("mjs", ("mts",)), ("cjs", ("cts",))) for new in news)]
    script += [f"CASE WHEN NOT regexp_matches(b, '[^./]\\.[^./]*$') THEN b || '.{x}' END" for x in _TRY] + [f"b || '/index.{x}'" for x in _TRY]
    ending = {"python": (".py", "/__init__.py"), "rust": (".rs", "/mod.rs")}
    simple = lambda b, fam: [b, *(f"{b} || '{x}'" for x in ending[fam])]
    return f"""WITH {sources}, {files}, {plains}, {grouped},
found AS ({rows}),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY pass, n) - 1 AS INTEGER) AS ordinal FROM found),
several AS (SELECT source, fam, ordinal, import_type, names, unnest(CASE WHEN fam = 'python' AND pass = 0 THEN list_transform(string_split(module, ','), lambda s: regexp_replace(trim(s), '\\s+as\\s+.*$', ''))
  WHEN fam = 'rust' THEN [replace(module, '::', '/')] WHEN fam IN ('kotlin', 'java') THEN [replace(module, '.', '/')] ELSE [module] END) AS module FROM numbered),
placed AS (SELECT *, regexp_replace(source, '/[^/]*$', '') AS folder, string_split(source, '/')[1] AS root,
  list_filter(list_transform(string_split(names, ','), lambda s: CASE WHEN starts_with(s, '* as ') THEN s ELSE regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' as .*$', '') END), lambda s: s <> '') AS specifiers FROM several),
based AS (SELECT *, CASE
  WHEN fam = 'script' AND starts_with(module, '.') THEN {joined}
  WHEN fam = 'python' AND starts_with(module, '.') THEN {resolve_sql("folder || repeat('/..', len(regexp_extract(module, '^(\\.+)', 1)) - 1) || '/' || replace(regexp_replace(module, '^\\.+', ''), '.', '/')")}
  WHEN fam = 'python' THEN root || '/' || replace(module, '.', '/')
  WHEN fam = 'rust' AND regexp_matches(module, '^(super|self|\\.)/') THEN {resolve_sql("folder || '/' || regexp_replace(regexp_replace(module, '^self/', ''), '\\bsuper/', '../', 'g')")} END AS b,
  CASE WHEN fam = 'rust' AND starts_with(module, 'crate/') THEN module[7:] END AS in_crate FROM placed),
tried AS (SELECT *, CASE WHEN in_crate IS NOT NULL THEN [{', '.join(simple("root || '/' || in_crate", 'rust') + simple("root || '/src/' || in_crate", 'rust'))}]
  WHEN fam = 'script' THEN [{', '.join(script)}] WHEN fam = 'python' THEN [{', '.join(simple('b', 'python'))}] WHEN fam = 'rust' THEN [{', '.join(simple('b', 'rust'))}] ELSE [] END AS tries FROM based),
looked AS (SELECT source, ordinal, module, specifiers, import_type, fam, b, in_crate, u.x, u.k FROM tried LEFT JOIN LATERAL (SELECT unnest(tries) AS x, generate_subscripts(tries, 1) AS k) u ON true),
hit AS (SELECT l.source, l.ordinal, l.module, arg_min(f.path, l.k) AS path FROM looked l JOIN f ON f.path = l.x GROUP BY 1, 2, 3)
SELECT t.source, t.ordinal, t.module, coalesce(hit.path, CASE WHEN fam = 'python' AND NOT starts_with(t.module, '.') THEN replace(t.module, '.', '/') ELSE coalesce(in_crate, b, t.module) END) AS target, specifiers, import_type, hit.path IS NULL AS external
FROM tried t LEFT JOIN hit ON hit.source = t.source AND hit.ordinal = t.ordinal AND hit.module = t.module"""


_W = "[A-Za-z0-9_]+"
# kind, language, pattern of a line that declares a name, group.
NAME_RULES = (
    ("classes", "script", rf"^(export{_SPACE})?(default{_SPACE})?(declare{_SPACE})?(abstract{_SPACE})?class{_SPACE}({_W})", 5),
    ("functions", "script", rf"^(export{_SPACE})?(default{_SPACE})?(declare{_SPACE})?(async{_SPACE})?function[ \t]*\*?[ \t]*({_W})", 5),
    ("types", "script", rf"^(export{_SPACE})?(declare{_SPACE})?(const{_SPACE})?(interface|type|enum){_SPACE}({_W})", 5),
    ("constants", "script", rf"^(export{_SPACE})?const{_SPACE}({_W})", 2),
    ("classes", "python", rf"^class{_SPACE}({_W})", 1),
    ("functions", "python", rf"^(async{_SPACE})?def{_SPACE}({_W})", 2),
    ("types", "python", rf"^type{_SPACE}({_W})[ \t]*=", 1),
    ("constants", "python", r"^([A-Z][A-Z0-9_]*)[ \t]*(:[^=]*)?=", 1),
    ("classes", "go", rf"^type{_SPACE}({_W}){_SPACE}struct\b", 1),
    ("functions", "go", rf"^func{_SPACE}({_W})[ \t]*(\[[^\]]*\])?\(", 1),
    ("constants", "go", rf"^(const|var){_SPACE}({_W})", 2),
    ("classes", "rust", rf"^(pub{_SPACE})?(struct|enum|trait){_SPACE}({_W})", 3),
    ("functions", "rust", rf"^(pub{_SPACE})?((const|async|unsafe){_SPACE})*fn{_SPACE}({_W})", 4),
    ("types", "rust", rf"^(pub{_SPACE})?type{_SPACE}({_W})", 2),
    ("constants", "rust", rf"^(pub{_SPACE})?(const|static){_SPACE}({_W})", 3),
    ("classes", "kotlin", rf"^((public|private|internal|protected|open|abstract|sealed|inline|value|annotation|fun){_SPACE})*(data class|enum class|class|interface|object){_SPACE}({_W})", 4),
    ("functions", "kotlin", rf"^((public|private|internal|inline|suspend|operator|infix|tailrec){_SPACE})*fun{_SPACE}(<[^>]*>[ \t]*)?([A-Za-z0-9_<>?, ]+\.)?({_W})[ \t]*\(", 5),
    ("types", "kotlin", rf"^((public|private|internal){_SPACE})*typealias{_SPACE}({_W})", 3),
    ("constants", "kotlin", rf"^((public|private|internal|const){_SPACE})*(val|var){_SPACE}({_W})", 4),
    ("classes", "java", rf"^((public|protected|private|abstract|final|sealed|non-sealed|static|strictfp){_SPACE})*(class|interface|enum|record|@interface){_SPACE}({_W})", 4),
)


def outline_names_sql(sources: str) -> str:
    """Declared names by kind, one line of a text at a time."""
    rows = "\n  UNION ALL ".join(f"SELECT path, '{k}', n, regexp_extract(line, {_quoted(p)}, {g}) FROM lines WHERE language = '{f}' AND regexp_matches(line, {_quoted(p)})" for k, f, p, g in NAME_RULES)
    # Go types that are no structs: RE2 has no look-ahead.
    types = f"SELECT path, 'types', n, regexp_extract(line, '^type{_SPACE}({_W})', 1) FROM lines WHERE language = 'go' AND regexp_matches(line, '^type{_SPACE}{_W}{_SPACE}[^ \\t\\r]') AND NOT regexp_matches(line, '^type{_SPACE}{_W}{_SPACE}struct\\b')"
    listed = ", ".join(f"coalesce((SELECT list(name ORDER BY n) FROM named WHERE named.path = t.path AND kind = '{k}'), CAST([] AS VARCHAR[])) AS {k}" for k in ("classes", "functions", "types", "constants"))
    return f"""WITH {sources}, t AS (SELECT path, contents, CASE WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$') THEN 'script' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.rs') THEN 'rust'
  WHEN regexp_matches(path, '\\.kts?$') THEN 'kotlin' WHEN ends_with(path, '.java') THEN 'java' END AS language FROM src WHERE contents IS NOT NULL),
lines AS (SELECT path, language, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT path, language, string_split(contents, chr(10)) AS l FROM t WHERE language IS NOT NULL)),
named(path, kind, n, name) AS ({rows}
  UNION ALL {types})
SELECT path, language, {listed}, CAST(CASE WHEN contents = '' THEN 0 ELSE len(string_split(contents, chr(10))) END AS INTEGER) AS lines FROM t WHERE language IS NOT NULL"""
