"""Shared SQL of the checks: the driver-table adaptors as common table expressions."""

from __future__ import annotations

from fencegraph import vocab
from fencegraph.sources.adaptors import LABELS, REVEAL_LAG, STAR_EDGES


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def sql_case(expr: str, mapping: dict[str, object], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def hex_int(expr: str, start: int, length: int) -> str:
    return f"CAST(('0x' || substr(md5({expr}), {start}, {length})) AS BIGINT)"


def norm(expr: str) -> str:
    """normal form of a surface, for RE2"""
    punct = "[" + "".join("\\" + c if c.isascii() else c for c in vocab.OUTER_PUNCTUATION) + "]"
    p = quoted(f"^{punct}+|{punct}+$")
    bare = f"regexp_replace(regexp_replace(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'), {p}, '', 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"trim(regexp_replace(lower(regexp_replace({bare}, '\\s+', ' ', 'g')), '^(?:the|a|an) ', ''))"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def snippet(text: str, start: str, end: str, pad: int) -> str:
    lo = f"greatest({start} - {pad}, 0)"
    return squeeze(f"substr({text}, CAST({lo} + 1 AS BIGINT), CAST({end} + {pad} - {lo} AS BIGINT))")


DOCS = """
ch AS (
  SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) + 1 AS work_id,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS ordinal, text AS clean_text
  FROM documents)"""

TOKENS = """
tk AS (SELECT work_id, ordinal, unnest(string_split(clean_text, ' ')) AS tok,
              generate_subscripts(string_split(clean_text, ' '), 1) AS i FROM ch),
tks AS (SELECT *, coalesce(lead(tok) OVER w, '') AS nxt,
               CAST(sum(length(tok) + 1) OVER w - length(tok) - 1 AS INTEGER) AS start
        FROM tk WINDOW w AS (PARTITION BY work_id, ordinal ORDER BY i))"""

SPANS = f"""
named AS (SELECT work_id, ordinal AS chapter_ordinal, tok, nxt, start FROM tks WHERE regexp_matches(tok, '^[A-Z][a-z]{{3,}}$')),
surf AS (SELECT work_id, chapter_ordinal, tok, start, tok AS surface FROM named
         UNION ALL
         SELECT work_id, chapter_ordinal, tok, start, tok || ' ' || nxt FROM named
         WHERE length(tok) % 2 = 0 AND regexp_matches(nxt, '^[a-z]+$')),
spans AS (SELECT work_id, chapter_ordinal, surface,
                 {sql_list(LABELS)}[{hex_int("lower(tok) || ':' || (chapter_ordinal % 3)", 1, 1)} + 1] AS label,
                 start AS char_start, CAST(start + length(surface) AS INTEGER) AS char_end,
                 {hex_int("lower(tok) || ':' || chapter_ordinal", 3, 4)} / 65535.0 AS score
          FROM surf)"""

MENTIONS = f"""
typed AS (SELECT *, {sql_case("label", vocab.LABEL_TYPES)} AS type FROM spans),
men AS (SELECT *, CAST(chapter_ordinal AS BIGINT) * 2147483648 + ordinal AS mention_id
        FROM (SELECT work_id, chapter_ordinal, surface, type, char_start, char_end, score,
                     CAST(row_number() OVER (PARTITION BY work_id, chapter_ordinal ORDER BY char_start, char_end, type) - 1 AS INTEGER) AS ordinal
              FROM typed WHERE type IS NOT NULL AND score >= 0.4))"""

MENTION_CTES = [DOCS, TOKENS, SPANS, MENTIONS]

NAMES = f"""
mn AS (SELECT *, {norm("surface")} AS norm FROM men),
votes AS (SELECT work_id, norm, type, count(*) AS n, min(mention_id) AS pos FROM mn WHERE norm <> '' GROUP BY ALL),
nm AS (SELECT work_id, norm, list_distinct(string_split(norm, ' ')) AS tokens, type, members, first_pos FROM (
         SELECT work_id, norm, type, sum(n) OVER (PARTITION BY work_id, norm) AS members,
                min(pos) OVER (PARTITION BY work_id, norm) AS first_pos,
                row_number() OVER (PARTITION BY work_id, norm ORDER BY n DESC, pos) AS rk
         FROM votes) WHERE rk = 1)"""

FOLDS = f"""
sup AS (SELECT r.work_id, r.norm, h.norm AS host, len(h.tokens) AS h_n, h.members AS h_members, h.first_pos AS h_pos
        FROM nm r JOIN nm h ON r.work_id = h.work_id AND r.type = h.type AND len(r.tokens) < len(h.tokens)
         AND list_has_all(h.tokens, r.tokens)
        WHERE NOT list_has_all({sql_list(vocab.GENERIC_NAME_TOKENS)}, r.tokens)),
fold AS (SELECT n.work_id, n.norm, n.type, n.members, n.first_pos, len(n.tokens) AS n_tokens, coalesce(b.host, n.norm) AS host
         FROM nm n LEFT JOIN (
           SELECT work_id, norm, host, row_number() OVER (PARTITION BY work_id, norm ORDER BY h_n DESC, h_members DESC, h_pos) AS rk
           FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sup z WHERE z.work_id = s.work_id AND z.norm = s.host)
         ) b ON b.work_id = n.work_id AND b.norm = n.norm AND b.rk = 1)"""

CLUSTERS = """
mem AS (SELECT m.*, f.host, f.n_tokens, f.members, f.first_pos, trim(m.surface) AS sf
        FROM mn m JOIN fold f ON f.work_id = m.work_id AND f.norm = m.norm),
mo AS (SELECT *, row_number() OVER (PARTITION BY work_id, host ORDER BY n_tokens DESC, members DESC, first_pos, mention_id) AS seq FROM mem),
best AS (SELECT work_id, host, sf AS name, row_number() OVER (PARTITION BY work_id, host ORDER BY count(*) DESC, length(sf) DESC, min(seq)) AS rk
         FROM mo GROUP BY work_id, host, sf),
ev AS (SELECT work_id, host, chapter_ordinal AS ev_ch, char_start AS ev_s, char_end AS ev_e,
              row_number() OVER (PARTITION BY work_id, host ORDER BY chapter_ordinal, char_start, seq) AS rk FROM mo),
clu AS (SELECT a.work_id, a.host, o.type, b.name, a.first_seen_chapter, a.mention_count, e.ev_ch, e.ev_s, e.ev_e, o.n_tokens, o.members, o.first_pos
        FROM (SELECT work_id, host, min(chapter_ordinal) AS first_seen_chapter, count(*) AS mention_count FROM mo GROUP BY ALL) a
        JOIN best b ON b.work_id = a.work_id AND b.host = a.host AND b.rk = 1
        JOIN ev e ON e.work_id = a.work_id AND e.host = a.host AND e.rk = 1
        JOIN fold o ON o.work_id = a.work_id AND o.norm = a.host),
nodes AS (SELECT work_id, work_id * 268435456 + row_number() OVER (PARTITION BY work_id ORDER BY first_seen_chapter, mention_count DESC, name,
                 n_tokens DESC, members DESC, first_pos) AS node_id, type, name, CAST(mention_count AS DOUBLE) AS importance,
                 first_seen_chapter, first_seen_chapter AS revealed_chapter, host, ev_ch, ev_s, ev_e FROM clu),
lm AS (SELECT m.*, n.node_id, n.type AS node_type FROM mn m
       LEFT JOIN fold f ON f.work_id = m.work_id AND f.norm = m.norm
       LEFT JOIN nodes n ON n.work_id = f.work_id AND n.host = f.host)"""

ENTITY_CTES = [*MENTION_CTES, NAMES, FOLDS, CLUSTERS]

# ------------------------------------------------------------------ star graph

_SQL_ID = {
    "cust": ("Character", "o_custkey"), "supp": ("Organization", "l_suppkey"), "part": ("Item", "l_partkey"),
    "cnat": ("Place", "c_nationkey"), "snat": ("Place", "s_nationkey"),
    "brand": ("Ability", "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)"),
    "ptype": ("Concept", hex_int("p_type", 1, 8)), "segm": ("Title", hex_int("c_mktsegment", 1, 8)),
    "prio": ("Event", hex_int("o_orderpriority", 1, 8)),
}
_SQL_NAME = {
    "cust": "CASE WHEN o_custkey % 5 = 0 THEN 'customer ' ELSE 'Customer ' END || o_custkey", "supp": "'Supplier ' || l_suppkey",
    "part": "'Part ' || l_partkey", "cnat": "'Nation ' || c_nationkey", "snat": "'Nation ' || s_nationkey", "brand": "p_brand",
    "ptype": "p_type", "segm": "c_mktsegment", "prio": "o_orderpriority",
}


def _star_id(k: str) -> str:
    t, key = _SQL_ID[k]
    return f"((work_id * 8 + {vocab.NODE_TYPES.index(t)}) * 1000000000000 + {key})"


LINES = """
lines AS (SELECT CAST(n_regionkey AS BIGINT) + 1 AS work_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS chapter,
                 l_partkey, l_suppkey, l_returnflag, l_linestatus, o_custkey, o_orderpriority, c_nationkey, s_nationkey, c_mktsegment, p_brand, p_type
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

STAR_NODES = "\nsn0 AS (" + "\n UNION ALL ".join(
    f"SELECT work_id, {_star_id(k)} AS node_id, '{_SQL_ID[k][0]}' AS type, {_SQL_NAME[k]} AS name, chapter FROM lines" for k in _SQL_ID
) + f"""),
snodes AS (SELECT work_id, node_id, type, name, CAST(count(*) AS DOUBLE) AS importance, min(chapter) AS first_seen_chapter,
                  CAST(min(chapter) + {sql_case("type", REVEAL_LAG, "0")} AS INTEGER) AS revealed_chapter FROM sn0 GROUP BY work_id, node_id, type, name)"""

STAR_EDGES_SQL = "\nse0 AS (" + "\n UNION ALL ".join(
    f"SELECT work_id, {_star_id(s)} AS source_id, {_star_id(t)} AS target_id, '{rel}' AS relation, {tier} AS tier, {lag} AS lag, chapter FROM lines"
    + ("" if cond is None else f" WHERE l_returnflag = '{cond[0]}' AND l_linestatus = '{cond[1]}'")
    for s, t, rel, tier, lag, cond in STAR_EDGES
) + f"""),
sedges AS (SELECT work_id, {hex_int("source_id || '|' || target_id || '|' || relation", 1, 15)} AS edge_id, source_id, target_id, relation, tier,
                  min(chapter) AS first_seen_chapter, min(chapter) + lag AS revealed_chapter,
                  ['rule', 'gliner', 'llm'][tier] AS method, 'line ' || relation AS evidence
           FROM se0 GROUP BY work_id, source_id, target_id, relation, tier, lag),
seff AS (SELECT e.*, greatest(e.revealed_chapter, s.revealed_chapter, t.revealed_chapter) AS effective_reveal
         FROM sedges e JOIN snodes s ON e.source_id = s.node_id JOIN snodes t ON e.target_id = t.node_id)"""

STAR_PROPS = """
sprops AS (SELECT n.work_id, n.node_id * 10 + p.no AS prop_id, n.node_id, p.key, p.value, n.first_seen_chapter,
                  CAST(n.first_seen_chapter + p.lag AS INTEGER) AS revealed_chapter, n.revealed_chapter AS node_reveal
           FROM snodes n JOIN customer c ON n.node_id % 1000000000000 = c.c_custkey,
           LATERAL (VALUES ('balance', CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR), 3, 1), ('segment', c_mktsegment, 0, 2),
                           ('balance', 'about ' || CAST(floor(c_acctbal / 1000) AS BIGINT), 6, 3)) p(key, value, lag, no)
           WHERE n.type = 'Character')"""

STAR_CTES = [LINES, STAR_NODES, STAR_EDGES_SQL]

VECTORS = """
vec AS (SELECT vec_id AS chunk_id, CAST(label AS BIGINT) + 1 AS work_id, CAST(vec_id % 20 + 1 AS INTEGER) AS chapter_ordinal,
               CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""


def query(ctes: list[str], select: str, *, recursive: bool = False) -> str:
    """Join CTEs and a final select; a select that starts with a comma adds CTEs of its own."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(ctes) + "\n" + select
