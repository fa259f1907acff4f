"""DuckDB SQL for the registered queries over the driver's tables."""

from __future__ import annotations

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax
from juriscope.functions import text
from juriscope.operators.citations import ICONS, marker
from juriscope.sources.testdata import ORDER, SQL

_O = ", ".join(ORDER)
_TIER = "['Stop', 'Warning', 'Caution', 'Neutral']"
_NAME = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'))"
_NAME_KEY = f"({_NAME} = '' OR starts_with({_NAME}, 'unnamed opinion')), {_NAME}"
_ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def _with(select: str) -> str:
    return f"WITH {SQL}\n{select}"


#: Acts of rows: the first own act and the first citing act of each row, and of each opinion.
_ACTS = f""",
acts AS (SELECT k.*, f.row_rank, f.date_filed, f.first_ord, f.case_name, f.relation AS row_relation FROM kept k JOIN first_seen f USING (cited, citing)),
own AS (SELECT cited, treatment, severity, case_name, citing FROM acts WHERE is_direct
  QUALIFY row_number() OVER (PARTITION BY cited ORDER BY rank, recognized, row_rank, date_filed DESC, first_ord, nth) = 1),
cr AS (SELECT *, CASE WHEN row_relation IN ('controlling', 'equal') THEN 0 ELSE 1 END AS standing FROM acts WHERE NOT is_direct
  QUALIFY row_number() OVER (PARTITION BY cited, citing ORDER BY rank, recognized, nth) = 1),
first_cr AS (SELECT cited, severity FROM cr QUALIFY row_number() OVER (PARTITION BY cited ORDER BY rank, recognized, row_rank, date_filed DESC, first_ord) = 1),
lead AS (SELECT cited, treatment, severity, citing FROM cr WHERE rank < 3
  QUALIFY row_number() OVER (PARTITION BY cited ORDER BY standing, rank, recognized, row_rank, date_filed DESC, first_ord) = 1),
n AS (SELECT cited, count(*) AS n_later, count(*) FILTER (rank < 3) AS n_negative FROM cr GROUP BY cited),
nr AS (SELECT cited, count(*) AS n_rows FROM first_seen GROUP BY cited),
st AS (SELECT s.cluster_id, s.tier, coalesce(s.last_resort, false) AS last_resort, s.tier = 'anchor' OR coalesce(n_rows, 0) > 0 AS populated,
    own.treatment AS ot, own.severity AS os, lead.treatment AS lt, lead.severity AS ls, lead.citing AS lc, coalesce(n_later, 0) AS n_later, coalesce(n_negative, 0) AS n_negative, first_cr.severity AS fs
  FROM sides s LEFT JOIN nr ON nr.cited = s.cluster_id LEFT JOIN own ON own.cited = s.cluster_id LEFT JOIN lead ON lead.cited = s.cluster_id
    LEFT JOIN n ON n.cited = s.cluster_id LEFT JOIN first_cr ON first_cr.cited = s.cluster_id WHERE s.is_scoped)
"""

_INDEX = (
    _ACTS
    + f""",
ix AS (SELECT o.*, o.raw_name = '' AS name_missing, {_ALNUM.format("concat(o.case_name, o.citations[1], o.citations[2])")} AS key, st.os AS dh_severity, coalesce(st.ls, st.fs) AS cr_severity FROM opinions o JOIN st USING (cluster_id)),
hit AS (SELECT * FROM ix WHERE tier = 'anchor' AND (lower(coalesce(dh_severity, 'none')) IN ('stop', 'warning') OR lower(coalesce(cr_severity, 'none')) = 'stop') AND contains(key, 'customer00000'))
"""
)
_INDEX_ORDER = "name_missing, date_filed DESC, lower(case_name), load_ord"

#: Rows in DOM order.
_DOM = f""",
rows_ AS (SELECT *, row_number() OVER (PARTITION BY cited ORDER BY row_rank, date_filed DESC, first_ord) - 1 AS dom_index FROM first_seen),
ranked AS (SELECT *,
  row_number() OVER (PARTITION BY cited ORDER BY row_rank, date_filed DESC, dom_index) - 1 AS severity_index,
  row_number() OVER (PARTITION BY cited ORDER BY date_filed DESC, dom_index) - 1 AS recency_index,
  row_number() OVER (PARTITION BY cited ORDER BY {_NAME_KEY.format("case_name")}, dom_index) - 1 AS name_index,
  row_number() OVER (PARTITION BY cited ORDER BY n_mentions DESC, dom_index) - 1 AS mentions_index,
  row_number() OVER (PARTITION BY cited ORDER BY CASE WHEN relation IN ('controlling', 'equal') THEN 0 ELSE 1 END, court_level, {_NAME_KEY.format("case_name")}, dom_index) - 1 AS court_index FROM rows_)
"""

_DIRECT = f""",
pairs AS (SELECT citing AS actor, cited AS target, count(*)::INT AS n_links, arg_min(treatment, (rank, {_O})) AS worst FROM views
  WHERE verdict = 'ok' AND NOT recognized AND is_direct GROUP BY citing, cited)
"""
_REACH = (
    _DIRECT
    + """,
down AS (SELECT * FROM down_),
chains AS (SELECT top AS cluster_id, node, 'below' AS role FROM down WHERE top <> node UNION SELECT node, top, 'above' FROM down WHERE top <> node)
"""
)
_DOWN = "down_(top, node) AS (SELECT actor, target FROM pairs UNION SELECT d.top, p.target FROM down_ d JOIN pairs p ON p.actor = d.node)"


def _recursive(select: str) -> str:
    return f"WITH RECURSIVE {SQL}{_DIRECT}, {_DOWN}" + _REACH.replace(_DIRECT, "") + select


def _raw(select: str) -> str:
    """Over direct history as recorded: its strong components (scc), and what components reach (cr)."""
    return f"""WITH RECURSIVE {SQL},
pairs AS (SELECT DISTINCT citing AS a, cited AS b FROM edges JOIN tr ON tr.label = edges.label WHERE is_direct AND NOT recognized),
core AS (SELECT a AS node FROM pairs INTERSECT SELECT b FROM pairs),
steps AS (SELECT a, b FROM pairs WHERE a <> b AND a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
r AS (SELECT a, b FROM steps UNION SELECT r.a, s.b FROM r JOIN steps s ON s.a = r.b),
scc AS (SELECT r.a AS node, min(r.b) AS comp FROM r JOIN r back ON back.a = r.b AND back.b = r.a GROUP BY r.a),
of_ AS (SELECT node, coalesce(comp, node) AS comp FROM (SELECT cluster_id AS node FROM opinions UNION SELECT a FROM pairs UNION SELECT b FROM pairs) LEFT JOIN scc USING (node)),
sizes AS (SELECT comp, count(*) AS n FROM of_ GROUP BY comp),
ce AS (SELECT DISTINCT x.comp AS a, y.comp AS b FROM pairs JOIN of_ x ON x.node = a JOIN of_ y ON y.node = b WHERE x.comp <> y.comp),
cr AS (SELECT a, b FROM ce UNION SELECT cr.a, ce.b FROM cr JOIN ce ON ce.a = cr.b)
{select}"""


_VERBS = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[;,]|\\band\\b'), lambda w: trim(replace(replace(w, 'in part', ''), 'by', ''))), lambda v: v <> '')))"
_PAST = "regexp_replace(replace({0}, ' as recognized by', ' by'), ' by$', '')"

_GROUPS = f""",
gr AS (SELECT {_O}, l_orderkey AS cluster_id, l_partkey AS part, label, l_suppkey % 3 AS how, l_quantity::INT AS n_mentions, l_linenumber % 4 = 0 AS reports, strftime(l_shipdate, '%Y-%m-%d') AS iso,
    CASE l_suppkey % 7 WHEN 0 THEN 'Distinguished by' WHEN 1 THEN label END AS expert, concat(l_partkey % 600 + 1, 'us', l_partkey % 150 + 1) AS key, concat('customer', lpad((l_partkey % 200)::VARCHAR, 9, '0')) AS nm FROM labelled),
cite_own AS (SELECT {_ALNUM.format("c")} AS key, min(cluster_id) AS owner FROM (SELECT cluster_id, unnest(citations) AS c FROM opinions) GROUP BY 1),
name_own AS (SELECT nm AS name, min(cluster_id) AS owner FROM (SELECT cluster_id, {_ALNUM.format("regexp_replace(case_name, '\\s+v\\.?\\s+.*$', '')")} AS nm FROM opinions) WHERE length(nm) >= 5 GROUP BY nm HAVING count(DISTINCT cluster_id) = 1),
res AS (SELECT gr.*, coalesce(CASE WHEN how = 0 AND part <> 0 THEN part END, CASE WHEN how = 1 THEN c.owner END, n.owner) AS hit, CASE WHEN how = 0 THEN part END AS orig
  FROM gr LEFT JOIN cite_own c ON c.key = gr.key LEFT JOIN name_own n ON n.name = gr.nm),
grp AS (SELECT res.*, CASE WHEN o.cluster_id IS NOT NULL THEN hit ELSE orig END AS cited, row_number() OVER (PARTITION BY res.cluster_id ORDER BY {_O}) AS n, tr.severity, tr.is_direct,
    CASE tr.severity WHEN 'Stop' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Caution' THEN 2 ELSE 3 END AS rank
  FROM res LEFT JOIN opinions o ON o.cluster_id = res.hit JOIN tr ON tr.label = res.label)
"""
_AUTH = (
    _GROUPS
    + f""",
au AS (SELECT g.*, tr.active, s.is_scoped, s.level, CASE
    WHEN coalesce(s.court, '') = me.court THEN 'equal' WHEN s.category = 'scotus' THEN 'controlling' WHEN me.category = 'scotus' THEN 'other'
    WHEN coalesce(s.jurisdiction, '') <> me.jurisdiction THEN 'other' WHEN me.jurisdiction = 'state' AND s.state <> me.state THEN 'other'
    WHEN coalesce(s.level, 99) < me.level THEN 'controlling' WHEN s.level = me.level THEN 'equal' ELSE 'other' END AS relation,
    CASE WHEN reports THEN 0 ELSE rank END AS overall, CASE WHEN reports THEN 0 ELSE 3 END AS rec
  FROM grp g JOIN tr ON tr.label = g.label JOIN sides me ON me.cluster_id = g.cluster_id LEFT JOIN sides s ON s.cluster_id = g.cited WHERE g.cited IS DISTINCT FROM g.cluster_id)
"""
)

_CATS = ", ".join(f"({i}, '{c}', '{d}')" for i, (c, d, _) in enumerate(court_fn.CATEGORIES))


def _short_date(x: str) -> str:
    return f"concat({x}[6:7], '/', {x}[9:10], '/', {x}[1:4])"


ORACLES = {
    "later_courts_status": _with(
        _ACTS
        + """SELECT cluster_id, CASE WHEN tier = 'anchor' THEN 'controlling' ELSE 'collection' END AS scope,
  CASE WHEN ot IS NOT NULL THEN 'treated' WHEN last_resort THEN 'not_reviewable' WHEN populated THEN 'none' ELSE 'unknown' END AS on_appeal_state, ot AS on_appeal_treatment, os AS on_appeal_severity,
  CASE WHEN lt IS NOT NULL THEN 'negative' WHEN n_later > 0 THEN 'plain' WHEN populated OR tier <> 'anchor' THEN 'none' ELSE 'unknown' END AS later_state, lt AS later_treatment, ls AS later_severity, lc AS later_citing,
  CASE WHEN lt IS NOT NULL THEN n_negative - 1 END AS n_other_negative, CASE WHEN lt IS NOT NULL THEN n_later - n_negative END AS n_plain, CASE WHEN n_later > 0 THEN n_later END AS n_total FROM st"""
    ),
    "status_passages": _with(
        _ACTS
        + """, ps AS (SELECT cited, citing, arg_min(quote, (recognized, rank, nth)) AS quote, arg_min(l_linenumber, nth)::INT AS authority_n FROM kept GROUP BY cited, citing),
so AS (SELECT cited, own.citing, ps.quote, authority_n FROM own JOIN ps USING (cited, citing)), sl AS (SELECT cited, lead.citing, ps.quote, authority_n FROM lead JOIN ps USING (cited, citing))
SELECT cluster_id, so.citing AS on_appeal_citing, so.quote AS on_appeal_quote, so.authority_n AS on_appeal_authority_n, CASE WHEN so.citing IS NOT NULL THEN concat('/opinion/', so.citing, '/#authority-', so.authority_n) END AS on_appeal_href,
  sl.citing AS later_citing, sl.quote AS later_quote, sl.authority_n AS later_authority_n, CASE WHEN sl.citing IS NOT NULL THEN concat('/opinion/', sl.citing, '/#authority-', sl.authority_n) END AS later_href
FROM st LEFT JOIN so ON so.cited = cluster_id LEFT JOIN sl ON sl.cited = cluster_id"""
    ),
    "severity_summary": _with(_ACTS + "SELECT cluster_id, os AS dh_severity, coalesce(ls, fs) AS cr_severity FROM st"),
    "later_courts_rows": _with(
        f""", ev AS (SELECT cited, citing, bool_or(label <> 'Cited by' AND quote <> '') AS has_detail FROM kept GROUP BY cited, citing)
SELECT cited, citing, case_name, court_display, date_filed, {_short_date("date_filed")} AS date_short, relation, lead_treatment AS treatment, {_TIER}[row_rank + 1] AS severity,
  coalesce({_TIER}[rec_rank + 1], 'none') AS recognized_filter, n_applied, n_recognized, n_mentions, has_detail FROM first_seen JOIN ev USING (cited, citing)"""
    ),
    "later_courts_pills": _with(
        """SELECT cited, citing, (row_number() OVER (PARTITION BY cited, citing ORDER BY recognized, rank, nth) - 1)::INT AS pos, treatment, severity,
  CASE WHEN recognized THEN 'Related Reference' WHEN is_direct THEN 'Direct History' ELSE 'Citing Reference' END AS direction FROM kept"""
    ),
    "later_courts_ranks": _with(_DOM + "SELECT cited, citing, dom_index::INT AS dom_index, severity_index::INT AS severity_index, recency_index::INT AS recency_index, name_index::INT AS name_index, mentions_index::INT AS mentions_index, court_index::INT AS court_index FROM ranked"),
    "list_sort_court": _with(
        _DOM
        + f""", al AS (SELECT cited, citing, coalesce(min(rank) FILTER (NOT recognized), min(rank)) AS ar FROM kept GROUP BY cited, citing)
SELECT cited, citing, court_index::INT AS ord FROM ranked JOIN al USING (cited, citing) JOIN opinions o ON o.cluster_id = citing
WHERE contains({_ALNUM.format("concat(o.case_name, o.citations[1], o.citations[2])")}, 'customer') AND (ar < 2 OR rec_rank = 0)"""
    ),
    "edge_validation": _with("SELECT verdict, severity, count(*) AS n FROM views GROUP BY verdict, severity"),
    "court_relation": _with(
        """SELECT b.court AS cited_court, a.court AS citing_court, b.state AS cited_state,
  CASE WHEN a.court = b.court THEN 'equal' WHEN a.category = 'scotus' THEN 'controlling' WHEN b.category = 'scotus' THEN 'other' WHEN a.jurisdiction <> b.jurisdiction THEN 'other'
    WHEN b.jurisdiction = 'state' AND a.state <> b.state THEN 'other' WHEN a.level < b.level THEN 'controlling' WHEN a.level = b.level THEN 'equal' ELSE 'other' END AS relation FROM courts a CROSS JOIN courts b"""
    ),
    "court_list": _with("SELECT (row_number() OVER (ORDER BY level, lower(display), court) - 1)::INT AS ord, court AS key, display, level, category FROM courts"),
    "court_picker": _with(
        f""", cat(ord, category, shown) AS (VALUES {_CATS}),
c AS (SELECT courts.*, cat.ord, CASE WHEN category IN ('scotus', 'circuit') THEN 0 WHEN category = 'district' THEN 1 ELSE 2 END AS t, cat.shown FROM courts JOIN cat USING (category)),
g AS (SELECT *, CASE WHEN t = 0 THEN shown WHEN state = '' THEN 'Other courts' ELSE state END AS group_name FROM c)
SELECT ['federal_appellate', 'federal_district', 'state'][t + 1] AS tab, count(*) OVER (PARTITION BY t) AS n_courts,
  (dense_rank() OVER (PARTITION BY t ORDER BY CASE WHEN t = 0 THEN ord ELSE 0 END, group_name = 'Other courts', group_name) - 1)::INT AS group_ord, group_name,
  (row_number() OVER (PARTITION BY t, group_name ORDER BY level, lower(display), court) - 1)::INT AS court_ord, court AS key,
  (dense_rank() OVER (PARTITION BY t, group_name ORDER BY level) - 1)::INT AS depth FROM g"""
    ),
    "edges_all": _with(
        _GROUPS
        + f""", use_ AS (SELECT g.* FROM grp g JOIN opinions o ON o.cluster_id = g.cited WHERE g.cited <> 0 AND g.cited <> g.cluster_id),
pair AS (SELECT DISTINCT g.cluster_id AS citing, g.cited FROM grp g JOIN opinions o ON o.cluster_id = g.cited AND o.tier = 'anchor' WHERE g.cluster_id % 2 = 0),
fl AS (SELECT u.*, CASE WHEN p.citing IS NULL THEN 'collection' ELSE 'controlling' END AS scope, row_number() OVER (PARTITION BY cluster_id, u.cited ORDER BY {_O}) AS nth FROM use_ u LEFT JOIN pair p ON p.citing = u.cluster_id AND p.cited = u.cited),
e AS (SELECT cluster_id, cited, label AS treatment, scope, n_mentions FROM fl WHERE nth = 1 UNION ALL SELECT cluster_id, cited, 'Overruled as recognized by', scope, n_mentions FROM fl WHERE reports)
SELECT treatment, scope, count(*) AS n, sum(n_mentions)::BIGINT AS mentions, count(DISTINCT (cluster_id, cited)) AS pairs FROM e GROUP BY treatment, scope"""
    ),
    "resolve_groups": _with(_GROUPS + "SELECT cluster_id, count(*) AS n_groups, count(cited) AS n_resolved, sum(cited)::BIGINT AS sum_ids FROM grp GROUP BY cluster_id"),
    "cite_owners": _with(_GROUPS + "SELECT key, owner FROM cite_own"),
    "name_owners": _with(_GROUPS + "SELECT name, owner FROM name_own"),
    "authority_rows": _with(
        _AUTH
        + f"""SELECT active AS treatment_active, relation AS court_relation, {_TIER}[overall + 1] AS overall_severity, CASE WHEN reports THEN 'Stop' ELSE 'none' END AS recognized_filter,
  CASE WHEN expert IS NULL THEN 'unverified' WHEN label = expert THEN 'agree' WHEN expert = 'Distinguished by' AND label IN ('Cited by', 'Limited by') THEN 'unverified' ELSE 'disagree' END AS validation,
  coalesce(is_scoped, false) AS is_scoped, count(*) AS n, sum((label <> 'Cited by')::INT + 2 * reports::INT)::BIGINT AS n_cards, count(*) FILTER (reports) AS n_detail FROM au GROUP BY ALL"""
    ),
    "authority_ranks": _with(
        _AUTH
        + f""", d AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank, rec, n) - 1 AS dom, concat('Customer#', lpad((part % 200)::VARCHAR, 9, '0'), ' v. P') AS name FROM au)
SELECT cluster_id, n::INT AS n, dom::INT AS dom_index, (row_number() OVER (PARTITION BY cluster_id ORDER BY overall, rank, rec, n) - 1)::INT AS severity_index,
  (row_number() OVER (PARTITION BY cluster_id ORDER BY iso DESC, dom) - 1)::INT AS date_index, (row_number() OVER (PARTITION BY cluster_id ORDER BY {_NAME_KEY.format("name")}, dom) - 1)::INT AS name_index,
  (row_number() OVER (PARTITION BY cluster_id ORDER BY n_mentions DESC, dom) - 1)::INT AS mentions_index,
  (row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN relation IN ('controlling', 'equal') THEN 0 ELSE 1 END, coalesce(level, 99), {_NAME_KEY.format("name")}, dom) - 1)::INT AS court_index FROM d"""
    ),
    "page_bodies": _with(
        _AUTH
        + f""", ic(tier, svg) AS (VALUES {", ".join(f"('{t}', '{marker(t)}')" for t in ICONS)}),
nm AS (SELECT g.cluster_id, g.n, g.cited, concat('Customer#', lpad((g.part % 200)::VARCHAR, 9, '0'), ' v. P') AS name, s.cluster_id IS NOT NULL AS scoped, au.cluster_id IS NOT NULL AS held, coalesce(au.is_scoped, false) AS has_page, coalesce(svg, '') AS svg
  FROM grp g JOIN opinions me ON me.cluster_id = g.cluster_id LEFT JOIN opinions s ON s.cluster_id = g.cited AND s.is_scoped LEFT JOIN au ON au.cluster_id = g.cluster_id AND au.n = g.n LEFT JOIN ic ON ic.tier = {_TIER}[au.overall + 1]),
lk AS (SELECT cluster_id, n, CASE
    WHEN n % 5 <> 4 AND held THEN concat('<a class="cited-case-wrap" href="#authority-', n, '" title="', name, '" data-group="', n, '" data-name="', name, '" data-url="', CASE WHEN has_page THEN concat('/opinion/', cited, '/') ELSE '' END,
      '"><span class="cited-case', CASE WHEN n % 3 = 0 THEN ' cited-case--added' ELSE '' END, '">cite ', n, '</span>', svg, '</a>')
    WHEN n % 5 <> 4 THEN concat('<span class="cited-case">cite ', n, '</span>') WHEN cited IS NULL THEN concat('cite ', n)
    ELSE concat('<span class="cited-case-wrap">', CASE WHEN scoped THEN concat('<a class="cited-case" href="/opinion/', cited, '/" title="', name, '">cite ', n, '</a>') ELSE concat('<span class="cited-case" title="', name, '">cite ', n, '</span>') END, '</span>') END AS link FROM nm),
tx AS (SELECT cluster_id, string_agg(concat(' ', link, '.'), '' ORDER BY n) AS said, arg_min(link, n) AS first, CASE WHEN cluster_id % 2 = 0 THEN 'p' ELSE 'blockquote' END AS tag FROM lk GROUP BY cluster_id)
SELECT cluster_id, concat(CASE WHEN cluster_id % 4 = 0 THEN '<section id="section-Opinion-Order" data-section-id="Opinion &amp; Order"><h2>Opinion &amp; Order</h2>' ELSE '<section id="writing-1" data-section-id="writing-1">' END, '<', tag, '><em>See', said, '</em></', tag,
  '><aside class="opinion-footnotes" aria-label="Footnotes"><h3 class="opinion-heading opinion-heading--notes">Footnotes</h3><ol><li id="fn-1-1"><span class="fn-label"><a class="fn-label__link" href="#fnref-1-1" aria-label="Back to reference 1">1</a></span><div class="fn-body"><p>', first, '</p></div></li></ol></aside></section>') AS body FROM tx"""
    ),
    "authority_meta": "SELECT l_orderkey AS cluster_id, count(*) AS n_authorities, sum(l_quantity::INT)::BIGINT AS n_mentions FROM lineitem GROUP BY 1",
    "scope_counts": _with(
        """, s AS (SELECT count(*) AS opinions, count(*) FILTER (tier = 'anchor') AS anchors, count(*) FILTER (tier = 'authority') AS authorities, count(*) FILTER (tier = 'citing') AS citing,
  (SELECT count(*) FROM courts) AS courts, coalesce(min(date_filed[1:4]) FILTER (tier = 'anchor'), '') AS anchor_earliest_year, coalesce(max(date_filed[1:4]) FILTER (tier = 'anchor'), '') AS anchor_latest_year FROM opinions)
SELECT *, format('{:,}', opinions) AS opinions_display, format('{:,}', authorities) AS authorities_display, format('{:,}', citing) AS citing_display FROM s"""
    ),
    "index_entries": _with(
        f"""SELECT cluster_id, case_name, {_ALNUM.format("concat(case_name, citations[1], citations[2])")} AS search_text, replace(docket_number, ', ', '|') AS dockets, {_short_date("date_filed")} AS date_short,
  concat(citations[2], '|', citations[1]) AS cites, concat('/opinion/', cluster_id, '/') AS url FROM opinions"""
    ),
    "home_search": _with(_INDEX + f"SELECT (row_number() OVER (ORDER BY {_INDEX_ORDER}) - 1)::INT AS page_index, cluster_id, case_name, date_filed, dh_severity, cr_severity FROM hit QUALIFY page_index < 10"),
    "home_search_page2": _with(_INDEX + f"SELECT (row_number() OVER (ORDER BY {_INDEX_ORDER}) - 1)::INT AS page_index, cluster_id, case_name FROM ix WHERE tier = 'anchor' QUALIFY page_index BETWEEN 10 AND 19"),
    "home_search_counts": _with(
        _INDEX
        + """, c AS (SELECT (SELECT count(*) FROM hit) AS visible, (SELECT count(*) FROM ix) AS total)
SELECT visible, total, greatest(1, ceil(visible / 10))::BIGINT AS page_count, 0::BIGINT AS page, CASE WHEN visible = 0 THEN 'No opinions match' ELSE concat('1–', least(visible, 10), ' of ', visible) END AS label FROM c"""
    ),
    "index_order": _with("SELECT cluster_id, row_number() OVER (ORDER BY raw_name = '', date_filed DESC, lower(case_name), load_ord) - 1 AS ord FROM opinions"),
    "opinion_index_union": _with("SELECT cluster_id, CASE WHEN NOT is_scoped OR cluster_id % 50 = 0 THEN concat('external ', case_name) ELSE case_name END AS case_name, CASE WHEN NOT is_scoped OR cluster_id % 50 = 0 THEN 1 ELSE 0 END AS side FROM opinions"),
    "keep_first_tier": "SELECT o_orderkey % 700 AS cluster_id, left(o_orderpriority, 1)::INT AS folder, o_orderkey AS stem FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 700 ORDER BY folder, o_orderkey) = 1",
    "history_edges": _with(_DIRECT.replace("verdict = 'ok' AND ", "") + "SELECT * FROM pairs"),
    "history_components": _raw("SELECT node, comp AS component FROM scc"),
    "history_reach_raw": _raw("""SELECT n.node, n.comp AS component, z.n AS n_component, (coalesce(b.n, 0) + z.n - 1)::BIGINT AS n_below, coalesce(a.n, 0)::BIGINT AS n_above FROM of_ n JOIN sizes z USING (comp)
  LEFT JOIN (SELECT cr.a AS comp, sum(n) AS n FROM cr JOIN sizes ON sizes.comp = cr.b GROUP BY 1) b USING (comp) LEFT JOIN (SELECT cr.b AS comp, sum(n) AS n FROM cr JOIN sizes ON sizes.comp = cr.a GROUP BY 1) a USING (comp)"""),
    "history_reach": _recursive("SELECT * FROM chains"),
    "history_chain": _recursive(
        """, m0 AS (SELECT DISTINCT cluster_id, cluster_id AS node, 'self' AS role FROM chains UNION ALL SELECT * FROM chains),
m AS (SELECT m0.*, s.date_filed, s.level, s.category, s.last_resort, row_number() OVER (PARTITION BY m0.cluster_id ORDER BY role <> 'self', node) - 1 AS nth FROM m0 JOIN sides s ON s.cluster_id = m0.node),
g AS (SELECT *, (count(*) OVER (PARTITION BY cluster_id) - row_number() OVER t) * 2 + 1 AS row, 2 + dense_rank() OVER (PARTITION BY cluster_id ORDER BY level DESC) AS col,
    CASE level WHEN 0 THEN 'Highest court' WHEN 1 THEN CASE WHEN bool_and(last_resort) OVER l THEN 'Court of last resort' ELSE 'Appellate court' END
      WHEN 2 THEN CASE WHEN bool_and(category = 'state_appellate') OVER l THEN 'Intermediate appellate court' ELSE 'Trial court' END ELSE 'Trial court' END AS lab
  FROM m WINDOW t AS (PARTITION BY cluster_id ORDER BY date_filed, nth), l AS (PARTITION BY cluster_id, level)),
lv AS (SELECT cluster_id, col, any_value(lab) AS lab FROM g GROUP BY cluster_id, col),
p AS (SELECT g.*, lag(col) OVER (PARTITION BY cluster_id ORDER BY date_filed, nth) AS prev FROM g)
SELECT p.cluster_id, p.node, p.role, p.nth::INT AS "at", p.row, p.col::INT AS col, CASE WHEN up.lab = p.lab THEN 'Lower court' ELSE p.lab END AS tier,
  CASE WHEN prev IS NULL THEN NULL WHEN p.col > prev THEN 'up' WHEN p.col < prev THEN 'down' ELSE 'same' END AS dir,
  CASE WHEN prev IS NOT NULL THEN least(prev, p.col)::INT END AS col_start, CASE WHEN prev IS NOT NULL THEN greatest(prev, p.col)::INT + 1 END AS col_end, (abs(p.col - prev) + 1)::INT AS span
FROM p LEFT JOIN lv up ON up.cluster_id = p.cluster_id AND up.col = p.col + 1"""
    ),
    "reported_acts_antijoin": _with(
        _DIRECT
        + f""", links AS (SELECT DISTINCT cited AS target, {_VERBS.format(_PAST.format("treatment"))} AS known FROM views WHERE verdict = 'ok' AND NOT recognized AND is_direct),
rep AS (SELECT *, {_VERBS.format(_PAST.format("treatment"))} AS verbs FROM kept WHERE recognized AND is_direct)
SELECT cited AS target, count(*) AS n, count(DISTINCT citing) AS n_citing FROM rep r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.target = r.cited AND list_has_all(l.known, r.verbs)) GROUP BY cited"""
    ),
    "treatment_labels": _with(
        """, f AS (SELECT treatment AS label, count(*) AS n FROM views GROUP BY 1),
b AS (SELECT label, n, contains(label, ' as recognized by') AS recognized, replace(label, ' as recognized by', ' by') AS base, regexp_replace(replace(label, ' as recognized by', ' by'), ' by$', '') AS past FROM f)
SELECT b.label, n, recognized, base, past, coalesce(t.severity, 'Other') AS severity, CASE t.severity WHEN 'Stop' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Caution' THEN 2 WHEN 'Neutral' THEN 3 ELSE 4 END AS rank,
  CASE WHEN recognized THEN concat('Recognizes as ', lower(past)) ELSE coalesce(t.active, past) END AS active, concat('Recognizes to be ', lower(past)) AS recognizes, replace(base, ' by', ' as recognized by') AS reported_as,
  CASE WHEN recognized THEN 'Related Reference' WHEN t.is_direct THEN 'Direct History' ELSE 'Citing Reference' END AS direction, base <> 'Cited by' AS evidence, coalesce(t.is_direct, false) AS direct,
  coalesce(t.severity <> 'Neutral', false) AS negative FROM b LEFT JOIN tr t ON t.label = b.base"""
    ),
    "treatment_table": _with(
        """, f AS (SELECT label, count(*) AS n FROM views WHERE NOT recognized GROUP BY 1)
SELECT severity, coalesce(string_agg(label, '|' ORDER BY ord) FILTER (is_direct), '') AS direct_history, coalesce(string_agg(label, '|' ORDER BY ord) FILTER (NOT is_direct), '') AS citing_reference, sum(n)::BIGINT AS n FROM f JOIN tr USING (label) GROUP BY severity"""
    ),
    "disposition": """WITH d AS (SELECT o_orderkey AS cluster_id, CASE o_orderkey % 5 WHEN 0 THEN 'Affirmed' WHEN 1 THEN 'Reversed and remanded' WHEN 2 THEN 'Modified' WHEN 3 THEN 'None' ELSE '' END AS l,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('Motion ', o_orderstatus) ELSE '' END AS x FROM orders),
t AS (SELECT *, CASE WHEN l IN ('Affirmed', 'Reversed and remanded') THEN concat(l, ' by') WHEN x <> '' OR l NOT IN ('', 'None', 'Other') THEN 'Ordered by' END AS treatment FROM d)
SELECT cluster_id, treatment, CASE treatment WHEN 'Reversed and remanded by' THEN 'Stop' WHEN 'Affirmed by' THEN 'Neutral' WHEN 'Ordered by' THEN 'Neutral' END AS severity,
  CASE treatment WHEN 'Affirmed by' THEN 'Affirms' WHEN 'Reversed and remanded by' THEN 'Reverses and remands' WHEN 'Ordered by' THEN 'Ordered' END AS label,
  CASE WHEN treatment = 'Ordered by' THEN CASE WHEN x <> '' THEN x ELSE l END WHEN treatment IS NOT NULL THEN '' END AS said FROM t""",
    "text_keys": f"""WITH p AS (SELECT p_partkey, concat(p_name, ' v. ', p_brand) AS name, concat(p_size, 'us', p_partkey) AS cite_key, {_ALNUM.format("p_name")} AS short_name FROM part)
SELECT p_partkey, cite_key, short_name, CASE WHEN length(short_name) >= 5 THEN short_name ELSE '' END AS quote_key, concat('section-', trim(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS anchor, {_NAME.format("name")} AS name_key,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({text.STOP_WORDS!r}, w)))), ' ') AS words FROM p""",
    "token_streams": """WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\\*\\d+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "excerpts": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, coalesce(list_filter(ps, lambda x: length(x) >= 120 AND NOT regexp_matches(x, '(?s)\bAttorneys? for\b|\b(?:LLP|LLC|PLLC|P\.\s?C\.)\b.*\b(?:Suite|Street|Avenue|Road)\b'))[1], ps[1], '') AS x FROM p),
c AS (SELECT doc_id, x, x[1:280] AS h, 280 - strpos(reverse(x[1:280]), ' .') - 1 AS nth FROM f),
e AS (SELECT doc_id, CASE WHEN length(x) <= 280 THEN x WHEN strpos(reverse(h), ' .') > 0 AND nth > 168 THEN h[1:nth + 1] ELSE concat(rtrim(h), '…') END AS e FROM c)
SELECT doc_id, md5(e) AS digest, length(e) AS n_chars FROM e""",
    "writing_titles": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, concat(upper(role[1:1]), role[2:], CASE WHEN n > 1 AND k > 1 THEN concat(' ', k) ELSE '' END) AS title FROM c""",
    "mention_navigator": "SELECT l_orderkey AS cluster_id, l_linenumber AS n, count(*) AS last, count(*) AS total FROM lineitem GROUP BY 1, 2",
}


def _definitions() -> str:
    rows = []
    for label, text_ in tax.DEFINITIONS.items():
        if label != tax.PLAIN:
            rows.append("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (label, text_)) + ")")
    return f"""WITH {SQL}, d(label, text) AS (VALUES {", ".join(rows)}),
x AS (SELECT d.*, active, regexp_replace(label, ' by$', '') AS past, CASE WHEN is_direct THEN 'another court' ELSE 'a later case' END AS actor, CASE WHEN is_direct THEN 'the decision below' ELSE 'the cited case' END AS target,
  CASE WHEN is_direct THEN 'another court' ELSE 'another case' END AS reported FROM d JOIN tr USING (label)),
f AS (SELECT label AS form, '' AS lead, replace(replace(text, '{{actor}}', actor), '{{target}}', 'this case') AS t FROM x UNION ALL SELECT past, '', replace(replace(text, '{{actor}}', actor), '{{target}}', 'this case') FROM x
  UNION ALL SELECT active, '', replace(replace(text, '{{actor}}', 'this case'), '{{target}}', target) FROM x
  UNION ALL SELECT concat(past, ' as recognized by'), 'A later case noted that ', replace(replace(text, '{{actor}}', reported), '{{target}}', 'this case') FROM x
  UNION ALL SELECT concat('Recognizes to be ', lower(past)), 'This case noted that ', replace(replace(text, '{{actor}}', reported), '{{target}}', 'the cited case') FROM x)
SELECT form, CASE WHEN lead = '' THEN concat(upper(t[1:1]), t[2:]) ELSE concat(lead, lower(t[1:1]), t[2:]) END AS definition, n FROM f JOIN (SELECT treatment AS form, count(*) AS n FROM views GROUP BY 1) USING (form)"""


ORACLES["treatment_definitions"] = _definitions()


_QUOTED = r"""
dw AS (SELECT doc_id, text, regexp_split_to_array(text, '\s+') AS w FROM documents),
bw AS (SELECT item_id, text AS quote, array_to_string(regexp_split_to_array(trim(text), '\s+')[1:4], ' ') AS head FROM benchmark),
hd AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i+3], ' ')))) AS head FROM dw),
q AS (SELECT DISTINCT doc_id, item_id, quote FROM hd JOIN bw USING (head))"""
_TOKENS = "concat(' ', trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\*\\d+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')"

_TIDY = "trim(regexp_replace(translate(lower({0}), '‘’“”–—', '\'\'\'\'\"\"--'), '\\s+', ' ', 'g'))"
ORACLES |= {
    "quote_containment": f"WITH {_QUOTED} SELECT doc_id, item_id, contains({_TOKENS.format('text')}, {_TOKENS.format('quote')}) AS found FROM q JOIN documents USING (doc_id)",
    "quote_location": f"""WITH {_QUOTED}, t AS (SELECT doc_id, item_id, list_transform(string_split(d.text, chr(10)), lambda b: {_TIDY.format('b')}) AS bs, {_TIDY.format('quote')} AS goal FROM q JOIN documents d USING (doc_id))
SELECT doc_id, item_id, coalesce(nullif(coalesce(list_position(list_transform(bs, lambda b: contains(b, goal)), true), 0), 0) - 1,
  CASE WHEN length(goal) > 60 THEN nullif(coalesce(list_position(list_transform(bs, lambda b: contains(b, left(goal, 60))), true), 0), 0) - 1 END)::BIGINT AS block FROM t""",
    "quote_names_case": _with("SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN CASE WHEN length(" + _ALNUM.format("citations[2]") + ") >= 5 THEN 'cite' ELSE '' END WHEN 1 THEN CASE WHEN raw_name = '' THEN 'cite' ELSE 'name' END ELSE '' END AS names FROM opinions"),
    "mark_case": _with(
        f"""SELECT cluster_id, CASE WHEN raw_name = ''
  THEN concat('&quot;In &lt;<strong class="evidence-card__case">', case_name, '&gt; (', citations[2], '</strong>) &amp; later.')
  ELSE concat('&quot;In &lt;<strong class="evidence-card__case">', split_part(case_name, ' v. ', 1), '</strong> v. ', split_part(case_name, ' v. ', 2), '&gt; (', CASE WHEN length({_ALNUM.format('citations[2]')}) < 5 THEN citations[2] ELSE concat('<strong class="evidence-card__case">', citations[2], '</strong>') END, ') &amp; later.') END AS marked FROM opinions"""
    ),
    "cite_map": _with(
        """, c AS (SELECT cluster_id, citations[2] AS cite, cluster_id % 100 AS target, case_name FROM opinions)
SELECT cluster_id, concat(cite, ', 12') AS cite, target, case_name FROM c UNION ALL SELECT cluster_id, cite, target, case_name FROM c"""
    ),
    "document_titles": """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS k, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE trim(text) <> '')
SELECT conv_id, pos, CASE WHEN n > 1 THEN concat(CASE role WHEN 'user' THEN 'Dissent' ELSE 'Opinion of the Court' END, CASE WHEN k > 1 THEN concat(' ', k) ELSE '' END) END AS title, 1::BIGINT AS n_blocks FROM c""",
}


ORACLES["mark_case_sql"] = ORACLES["mark_case"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _small() -> dict[str, str]:
    from juriscope.plans.queries import FORMS, PROSE, TAGGED

    pick = lambda values: f"{_list(values)}[o_orderkey % {len(values)} + 1]"
    cases = "[" + ", ".join(str(c).lower() for _, c in FORMS) + "]"
    return {
        "case_groups": f"SELECT o_orderkey AS k, o_orderkey % 11 = 0 OR {cases}[o_orderkey % {len(FORMS)} + 1] AS is_case FROM orders",
        "canonical_courts": f"SELECT o_orderkey AS k, {pick([c for _, c, _ in PROSE])} AS court, {pick([n for _, _, n in PROSE])} AS name FROM orders",
        "authority_names": f"SELECT o_orderkey AS k, {pick([n for _, n in TAGGED])} AS name FROM orders",
        "page_links": """SELECT o_orderkey AS k, concat('/opinion/', o_orderkey, '/', CASE WHEN o_orderkey % 3 = 0 THEN concat('#authority-', o_orderkey % 7)
  WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN concat('#q=in%20part%20', o_orderstatus) ELSE '' END) AS href FROM orders""",
        "list_clamps": "SELECT o_orderkey AS k, array_to_string(range(1, least(3, o_orderkey % 6 + 1) + 1), ',') AS shown, greatest(o_orderkey % 6 - 2, 0)::INT AS more FROM orders",
        "lead_cards": """WITH c AS (SELECT o_orderkey AS k, list_transform([1, 4, 16], lambda n: ['Neutral', 'Stop', 'Odd', 'Caution'][(o_orderkey // n) % 4 + 1]) AS t FROM orders),
r AS (SELECT k, unnest([0, 1, 2]) AS nth, unnest(t) AS t FROM c)
SELECT k, arg_min(nth, (CASE WHEN t = 'Odd' THEN CASE WHEN nth = 0 THEN -1 ELSE 4 END WHEN t = 'Stop' THEN 0 WHEN t = 'Caution' THEN 2 ELSE 3 END, nth))::INT AS lead FROM r GROUP BY k""",
        "below_entries": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'ct' WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'a court' ELSE 'ct' END AS court,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Smithson matter' WHEN o_orderkey % 3 = 0 THEN 'People v. Roe' ELSE '' END AS name FROM orders""",
        "act_verbs": _with(f", f AS (SELECT treatment AS label, count(*) AS n FROM views GROUP BY 1) SELECT label, n, array_to_string({_VERBS.format(_PAST.format('label'))}, '|') AS verbs FROM f"),
        "court_typeahead": _with(
            f""", cat(ord, category, shown) AS (VALUES {_CATS}),
g AS (SELECT display, CASE WHEN category IN ('scotus', 'circuit') THEN 'federal_appellate' WHEN category = 'district' THEN 'federal_district' ELSE 'state' END AS tab,
  CASE WHEN category IN ('scotus', 'circuit') THEN shown WHEN state = '' THEN 'Other courts' ELSE state END AS group_name FROM courts JOIN cat USING (category))
SELECT tab, group_name, bool_or(contains(lower(display), 'ar')) OR contains(lower(group_name), 'ar') AS shown, (count(*) FILTER (contains(lower(display), 'ar')))::INT AS n_courts FROM g GROUP BY tab, group_name"""
        ),
        "citing_scope": _with("SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem JOIN opinions ON cluster_id = l_partkey AND tier = 'anchor'"),
        "last_counts": """WITH f AS (SELECT l_partkey AS cluster_id, 1 - l_linenumber % 2 AS file, count(*) AS total FROM lineitem GROUP BY 1, 2)
SELECT cluster_id, arg_max(total, file) AS total FROM f GROUP BY cluster_id""",
        "levels_placed": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS l FROM orders)
SELECT k AS cluster_id, unnest([0, 1, 2, 3])::INT AS "at", unnest([l, least(l + 1, 4), l - 1, 0])::INT AS level FROM o""",
    }


ORACLES |= _small()

#: Whole chains: nodes and edges of three kinds; reports are drawn one after the other.
_LAYOUT = f""",
m0 AS (SELECT cluster_id, cluster_id AS node, 'self' AS role FROM opinions UNION ALL SELECT * FROM chains),
m AS (SELECT m0.*, s.case_name, s.display, s.date_filed, s.level, s.category, s.last_resort, row_number() OVER (PARTITION BY m0.cluster_id ORDER BY role <> 'self', node) - 1 AS pl FROM m0 JOIN sides s ON s.cluster_id = m0.node),
nm AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY cluster_id),
ln AS (SELECT citing AS actor, cited AS target, list(label ORDER BY rank, {_O}) AS labels, min(({_O})) AS first_ord FROM views WHERE verdict = 'ok' AND NOT recognized AND is_direct GROUP BY 1, 2),
rec AS (SELECT a.cluster_id, a.pl AS actor, b.pl AS target, labels, row_number() OVER (PARTITION BY a.cluster_id, a.pl ORDER BY first_ord) AS ord
  FROM ln JOIN m a ON a.node = ln.actor JOIN m b ON b.node = ln.target AND b.cluster_id = a.cluster_id),
be AS (SELECT m.cluster_id, m.pl, CASE WHEN node % 3 = 1 THEN concat('Trial Court ', node % 4) ELSE '' END AS court, CASE WHEN node % 3 = 0 THEN m.case_name ELSE '' END AS name,
    CASE WHEN node % 5 = 0 THEN 'Affirmed by' WHEN node % 5 = 1 THEN 'Reversed and remanded by' WHEN node % 2 = 0 OR node % 5 = 2 THEN 'Ordered by' END AS did,
    CASE WHEN node % 5 < 2 THEN '' WHEN node % 2 = 0 THEN concat('Motion ', node % 10) ELSE 'Modified' END AS said
  FROM m WHERE node % 3 < 2 AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.cluster_id = m.cluster_id AND rec.actor = m.pl)),
bn AS (SELECT cluster_id, court, name, any_value(n) + row_number() OVER (PARTITION BY cluster_id ORDER BY min(pl)) - 1 AS pl FROM be JOIN nm USING (cluster_id) GROUP BY cluster_id, court, name),
kb AS (SELECT cluster_id, count(*) AS n FROM bn GROUP BY cluster_id),
onrec AS (SELECT DISTINCT cluster_id, target, {_VERBS.format("regexp_replace(x, ' by$', '')")} AS known FROM (SELECT cluster_id, target, unnest(labels) AS x FROM rec)),
rp AS (SELECT m.cluster_id, m.pl AS t, m.date_filed AS tdate, k.citing, k.label, k.rank, ({", ".join("k." + c for c in ORDER)}) AS ord, k.citing_name, k.citing_date, k.l_suppkey % 3 AS acting FROM kept k JOIN m ON m.node = k.cited
  WHERE recognized AND is_direct AND NOT EXISTS (SELECT 1 FROM onrec o WHERE o.cluster_id = m.cluster_id AND o.target = m.pl AND list_has_all(o.known, {_VERBS.format("regexp_replace(k.label, ' by$', '')")}))),
rl AS (SELECT cluster_id, t, citing, label, any_value(rank) AS rank, min(ord) AS ord FROM rp GROUP BY cluster_id, t, citing, label),
ev AS (SELECT cluster_id, t, citing, any_value(tdate) AS tdate, arg_min(citing_name, ord) AS name, arg_min(citing_date, ord) AS date, arg_min(acting, ord) AS acting, min(ord) AS first_ord FROM rp GROUP BY cluster_id, t, citing),
en AS (SELECT ev.*, labels, concat(name, '|', date) AS who, row_number() OVER (PARTITION BY ev.cluster_id ORDER BY date, tdate, ev.t, first_ord) AS ord
  FROM ev JOIN (SELECT cluster_id, t, citing, list(label ORDER BY rank, ord) AS labels FROM rl GROUP BY cluster_id, t, citing) l USING (cluster_id, t, citing)),
dr AS (SELECT cluster_id, ord, t, who, fresh, name, date, acting FROM (
  SELECT en.*, list_filter(labels, lambda x: NOT list_contains(coalesce(claimed, []), concat(en.t, '|', x)) AND NOT list_contains(coalesce(claimed, []), concat(who, '#', x))) AS fresh FROM en LEFT JOIN claims c ON c.cluster_id = en.cluster_id AND c.ord = en.ord - 1) WHERE len(fresh) > 0),
cd AS (SELECT cluster_id, who, any_value(f) + row_number() OVER (PARTITION BY cluster_id ORDER BY min(ord)) - 1 AS pl, arg_min(name, ord) AS name, arg_min(date, ord) AS date, arg_min(acting, ord) AS acting
  FROM dr JOIN (SELECT nm.cluster_id, nm.n + coalesce(kb.n, 0) AS f FROM nm LEFT JOIN kb USING (cluster_id)) USING (cluster_id) GROUP BY cluster_id, who),
e AS (SELECT cluster_id, actor, target, 0 AS kind, ord, list_transform(labels, lambda x: {{'l': x, 't': ''}}) AS links FROM rec
  UNION ALL SELECT be.cluster_id, be.pl, bn.pl, 1, 0, CASE WHEN did IS NULL THEN [] ELSE [{{'l': did, 't': said}}] END FROM be JOIN bn ON bn.cluster_id = be.cluster_id AND bn.court = be.court AND bn.name = be.name
  UNION ALL SELECT dr.cluster_id, cd.pl, t, 2, ord, list_transform(fresh, lambda x: {{'l': x, 't': ''}}) FROM dr JOIN cd USING (cluster_id, who)),
nd AS (SELECT cluster_id, pl, role, node, case_name, display AS court, level, category, last_resort, date_filed, true AS in_court, false AS top FROM m
  UNION ALL SELECT cluster_id, pl, 'below', NULL, name, court, NULL, NULL, false, '', false, false FROM bn
  UNION ALL SELECT cluster_id, pl, 'reported', NULL, name, ['Supreme Court of the United States', 'Court of Appeals for the Ninth Circuit', 'Court not identified'][acting + 1], NULL, NULL, false, date, acting < 2, acting = 0 FROM cd),
lv1 AS (SELECT nd.*, CASE WHEN nd.level IS NOT NULL THEN nd.level WHEN role = 'below' THEN least((SELECT max(m.level) FROM e JOIN m ON m.cluster_id = e.cluster_id AND m.pl = e.actor WHERE e.cluster_id = nd.cluster_id AND e.target = nd.pl) + 1, 4)
    WHEN top THEN 0 ELSE greatest((SELECT min(m.level) FROM e JOIN m ON m.cluster_id = e.cluster_id AND m.pl = e.target WHERE e.cluster_id = nd.cluster_id AND e.actor = nd.pl) - 1, 0) END AS lvl FROM nd),
g AS (SELECT *, (count(*) OVER (PARTITION BY cluster_id) - row_number() OVER t) * 2 + 1 AS row, 2 + dense_rank() OVER (PARTITION BY cluster_id ORDER BY lvl DESC) AS col, row_number() OVER t AS seq,
    CASE lvl WHEN 0 THEN 'Highest court' WHEN 1 THEN CASE WHEN bool_or(in_court) OVER l AND NOT bool_or(in_court AND NOT last_resort) OVER l THEN 'Court of last resort' ELSE 'Appellate court' END
      WHEN 2 THEN CASE WHEN bool_or(in_court) OVER l AND NOT bool_or(in_court AND coalesce(category, '') <> 'state_appellate') OVER l THEN 'Intermediate appellate court' ELSE 'Trial court' END ELSE 'Trial court' END AS lab
  FROM lv1 WINDOW t AS (PARTITION BY cluster_id ORDER BY date_filed, pl), l AS (PARTITION BY cluster_id, lvl)),
lv AS (SELECT cluster_id, col, any_value(lab) AS lab FROM g GROUP BY cluster_id, col),
sl AS (SELECT e.cluster_id, actor, kind, ord, unnest(links) AS x, generate_subscripts(links, 1) AS i FROM e),
sa AS (SELECT sl.cluster_id, actor, kind, sl.ord AS ord, string_agg(concat(coalesce(active, regexp_replace(x.l, ' by$', '')), '=', CASE WHEN actor = 0 THEN coalesce(active, regexp_replace(x.l, ' by$', '')) ELSE regexp_replace(x.l, ' by$', '') END, ':', coalesce(severity, 'Neutral'), ':', x.t), ', ' ORDER BY i) AS said
  FROM sl LEFT JOIN tr ON tr.label = x.l GROUP BY sl.cluster_id, actor, kind, sl.ord),
ac AS (SELECT cluster_id, actor, string_agg(said, ' / ' ORDER BY kind, ord) AS acts FROM sa GROUP BY cluster_id, actor),
p AS (SELECT g.*, lag(col) OVER (PARTITION BY cluster_id ORDER BY seq) AS prev, count(*) OVER (PARTITION BY cluster_id) AS n_nodes, count(node) OVER (PARTITION BY cluster_id) AS n_opinions, bool_or(role = 'reported') OVER (PARTITION BY cluster_id) AS has_reported FROM g)
SELECT p.cluster_id, p.pl::INT AS "at", p.role, p.node, p.case_name, p.court, p.lvl::INT AS level, p.row::INT AS row, p.col::INT AS col, CASE WHEN up.lab = p.lab THEN 'Lower court' ELSE p.lab END AS tier,
  CASE WHEN prev IS NULL THEN NULL WHEN p.col > prev THEN 'up' WHEN p.col < prev THEN 'down' ELSE 'same' END AS dir, coalesce(acts, '') AS acts, n_opinions, has_reported
FROM p LEFT JOIN lv up ON up.cluster_id = p.cluster_id AND up.col = p.col + 1 LEFT JOIN ac ON ac.cluster_id = p.cluster_id AND ac.actor = p.pl WHERE n_nodes > 1"""
#: Acts that are claimed after each event of a chain: of its decision, and of its card.
_CLAIMS = """,
claims(cluster_id, ord, claimed) AS (SELECT DISTINCT cluster_id, 0::BIGINT, []::VARCHAR[] FROM en UNION ALL
  SELECT c.cluster_id, en.ord, list_concat(claimed, flatten(list_transform(list_filter(labels, lambda x: NOT list_contains(claimed, concat(en.t, '|', x)) AND NOT list_contains(claimed, concat(who, '#', x))), lambda x: [concat(en.t, '|', x), concat(who, '#', x)])))
  FROM claims c JOIN en ON en.cluster_id = c.cluster_id AND en.ord = c.ord + 1),
dr AS ("""
_LAYOUT = _LAYOUT.replace(",\ndr AS (", _CLAIMS, 1)
_CHAINS = _LAYOUT[: _LAYOUT.rindex("\nSELECT p.cluster_id")]
ORACLES["history_layout_full"] = _recursive(_LAYOUT)
ORACLES["history_summary"] = _recursive(_CHAINS + "\nSELECT cluster_id, count(node) AS n_opinions, bool_or(role = 'reported') AS has_reported FROM nd GROUP BY cluster_id")
ORACLES["card_labels"] = _recursive(
    _CHAINS + """
SELECT coalesce(active, regexp_replace(x.l, ' by$', '')) AS treatment, CASE WHEN actor = 0 THEN coalesce(active, regexp_replace(x.l, ' by$', '')) ELSE regexp_replace(x.l, ' by$', '') END AS defined_as, coalesce(severity, 'Neutral') AS severity, count(*) AS n
FROM sl LEFT JOIN tr ON tr.label = x.l GROUP BY ALL"""
)
ORACLES["drawn_reports"] = _recursive(
    _CHAINS + "\nSELECT dr.cluster_id, m.node AS target, en.citing, ['Supreme Court of the United States', 'Court of Appeals for the Ninth Circuit', 'Court not identified'][dr.acting + 1] AS court, len(fresh)::INT AS n FROM dr JOIN en USING (cluster_id, ord) JOIN m ON m.cluster_id = dr.cluster_id AND m.pl = dr.t"
)

ORACLES["pill_validation"] = _with(
    """, ex AS (SELECT cited, citing, expert_treatment AS e FROM kept QUALIFY row_number() OVER (PARTITION BY cited, citing ORDER BY recognized, rank, nth) = 1),
p AS (SELECT k.cited, k.citing, k.recognized, k.label, k.rank, e, contains(e, ' as recognized by') AS er, replace(e, ' as recognized by', ' by') AS eb,
    row_number() OVER (PARTITION BY cited, citing ORDER BY rank, recognized, nth) AS o FROM kept k JOIN ex USING (cited, citing)),
a AS (SELECT p.*, t.severity AS es, coalesce(recognized = er AND p.label = eb, false) AS agree, coalesce(recognized = er AND rank < 3, false) AS guilty,
    coalesce(min(CASE WHEN NOT recognized THEN o END) OVER w, 1) AS fa, min(CASE WHEN NOT recognized THEN o END) OVER w AS fa0 FROM p LEFT JOIN tr t ON t.label = p.eb WINDOW w AS (PARTITION BY cited, citing)),
b AS (SELECT *, bool_or(agree) OVER w AS any_agree, bool_or(guilty) OVER w AS any_guilty, coalesce(bool_or(o = fa0 AND label IN ('Cited by', 'Limited by')) OVER w, false) AS mild FROM a WINDOW w AS (PARTITION BY cited, citing)),
s AS (SELECT *, CASE WHEN e IS NULL THEN 'unverified' WHEN agree THEN 'agree' WHEN any_agree OR coalesce(es, 'Other') NOT IN ('Stop', 'Warning', 'Caution') OR (eb = 'Distinguished by' AND mild) THEN 'unverified'
    WHEN CASE WHEN any_guilty THEN guilty ELSE o = fa END THEN 'disagree' ELSE 'unverified' END AS state FROM b),
r AS (SELECT *, CASE WHEN bool_or(state = 'disagree') OVER w THEN 'disagree' WHEN bool_or(state = 'agree') OVER w THEN 'agree' ELSE 'unverified' END AS row_state FROM s WINDOW w AS (PARTITION BY cited, citing))
SELECT row_state, CASE WHEN recognized THEN 'recognized' ELSE 'applied' END AS kind, state, count(*) AS n FROM r GROUP BY ALL"""
)

# Places are the same however rows are cut.
ORACLES |= {f"{name}_hubs": ORACLES[name] for name in ("later_courts_ranks", "authority_ranks")}


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


ORACLES["text_bodies"] = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, regexp_split_to_array(concat('@@', coalesce(text, '')), '

') AS ps FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps, {_escaped("lang")} AS lang, {_escaped("source")} AS source,
  regexp_replace(regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM d),
h AS (SELECT *, array_to_string(list_transform(ps, lambda x: concat('<p>', {_escaped("x")}, '</p>')), chr(10)) AS inside,
  concat('<span class="cited-case-wrap">', CASE WHEN doc_id % 2 = 0 THEN concat('<a class="cited-case" href="/opinion/', doc_id, '/">', lang, '</a>') ELSE concat('<span class="cited-case">', lang, '</span>') END, '</span>') AS link FROM p),
b AS (SELECT doc_id, concat('<p>Of &lt;', lang, '&gt;</p>', chr(10), '<section id="', CASE WHEN slug = '' THEN '' ELSE concat('section-', slug) END, '" data-section-id="', source, '"><h2>', source, '</h2>',
  CASE WHEN starts_with(inside, '<p>@@</p>') THEN concat('<p>', link, inside[6:]) ELSE concat('<p>', link, ' ', inside[6:]) END, '</section>') AS body FROM h)
SELECT doc_id AS cluster_id, length(body) AS n_chars, md5(body) AS digest FROM b"""
