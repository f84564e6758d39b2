"""DuckDB SQL for the queries of ``report_queries``, written from their definitions."""

from __future__ import annotations

from ..schemas import CORE_ANCHORED
from .oracle import _DOMAINS, _turns, _COHEN, _EVID, _LONG, _SHIFT, _metrics, _pool, _with, AGG, BASE, CELL

_W = "CASE WHEN {u} >= 1 THEN NULL WHEN {u} <= 0 THEN 0.0 ELSE {u} * 5 / (1 - {u}) END"
_VECTOR = """vx AS (
  SELECT d.suite, d.model, d.item, split_part(d.condition, '_', 1) AS grp, split_part(d.condition, '_', -1) AS direction,
         CASE WHEN abs(d.anchor - c.answer) >= 3 THEN CAST(d.answer - c.answer AS DOUBLE) / (d.anchor - c.answer) END AS uai
  FROM d JOIN d c ON c.item = d.item AND c.condition = 'control' WHERE d.condition NOT LIKE 'control%'),
vv AS (SELECT * FROM vx WHERE uai IS NOT NULL)"""
_VARIANTS = f"va AS (SELECT suite, model, difficulty, {_pool('u', 'irrelevant')} AS ui, {_pool('u', 'plausible')} AS u, {_pool('u', 'plausible')} - {_pool('u', 'irrelevant')} AS dd, avg(abs(y - g)) AS mae FROM it GROUP BY suite, model, difficulty)"
_PAIRS = "pr AS (SELECT a.suite, a.model, a.u AS ua, b.u AS ub, a.mae AS ma, b.mae AS mb FROM va a JOIN va b ON a.suite = b.suite AND a.model = b.model AND a.difficulty = 'easy' AND b.difficulty = 'hard')"
_BOUNDS = f"bd AS (SELECT suite, model, {_pool('u', 'irrelevant')} AS ui, {_pool('u', 'plausible')} AS u FROM it GROUP BY suite, model)"


def _domains(name: str, domains: str, more: str = "") -> str:
    return f"{name} AS (SELECT suite, model, {_pool('u', 'irrelevant')} AS ui, {_pool('u', 'plausible')} AS u FROM it WHERE domain IN ({domains}) {more} GROUP BY suite, model)"


_RULES = "ru AS (SELECT a.suite, a.model, b.ui - a.ui AS di, b.u - a.u AS du FROM ra a JOIN rb b ON a.suite = b.suite AND a.model = b.model)"
_RULE_CTES = (_domains("ra", "0, 1, 2"), _domains("rb", "3, 4, 5, 6"), _RULES)
_FAMILY = "fa AS (SELECT e.suite, e.model, e.ui AS ei, e.u AS eu, b.ui AS bi, b.u AS bu, m.ui AS mi, m.u AS mu FROM fe e LEFT JOIN fb b ON e.suite = b.suite AND e.model = b.model LEFT JOIN fm m ON e.suite = m.suite AND e.model = m.model)"
_FAMILY_CTES = (_domains("fe", "0"), _domains("fb", "1, 2", "AND suite <> 'P'"), _domains("fm", "3"), _FAMILY)
_CURVE2 = """co AS (SELECT suite, model, item, answer AS control FROM d WHERE condition = 'control'),
cv AS (
  SELECT r.suite, r.model, split_part(r.condition, '_', 1) AS level, r.condition, r.domain, CASE WHEN abs(r.anchor - control) >= 3 THEN CAST(r.answer - control AS DOUBLE) / (r.anchor - control) END AS uai
  FROM rec r JOIN co USING (suite, model, item) WHERE r.parsed_ok AND r.anchor IS NOT NULL AND (r.condition LIKE 'irr%' OR r.condition LIKE 'pla_sible%')),
cu AS (SELECT suite, model, level, avg(uai) AS uai FROM cv GROUP BY ALL)"""
_USAGE = """us AS (
  SELECT suite, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens,
         CAST(sum(CASE WHEN stage1 > 50 THEN stage1 ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(answer % 7) AS BIGINT) AS cached_tokens,
         sum(CASE WHEN model = '1-URGENT' THEN 0.25::DOUBLE ELSE 0 END) AS cost, count(DISTINCT item) AS n_items, max(CASE WHEN parsed_ok THEN 'vendor/' || model END) AS model_id
  FROM rec GROUP BY suite, model)"""
_BILL = """bl AS (
  SELECT model, string_agg(suite, ',' ORDER BY suite) AS suites, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
         CASE WHEN sum(cost) <> 0 THEN sum(cost) ELSE (sum(prompt_tokens) * any_value(pi) + sum(completion_tokens) * any_value(po)) / 1000000.0::DOUBLE END AS cost, CAST(sum(n_items) AS BIGINT) AS k
  FROM us JOIN (VALUES ('1-URGENT', 1.0::DOUBLE, 3.0::DOUBLE), ('2-HIGH', 2.0, 5.0), ('5-LOW', 4.0, 9.0)) AS t(model, pi, po) USING (model) GROUP BY model),
bm AS (SELECT *, cost * 100000 / greatest(k, 1) AS full_cost FROM bl)"""
_OWN = """ob AS (
  SELECT suite, model, item, max(CASE WHEN condition = 'control_twostage' THEN answer END) AS y2, max(CASE WHEN condition = 'control' THEN answer END) AS y1, max(CASE WHEN condition = 'plausible_high' THEN answer END) AS a
  FROM d GROUP BY suite, model, item),
ox AS (SELECT suite, model, a, y2 AS y FROM ob WHERE a IS NOT NULL AND y2 IS NOT NULL)"""


def _d(rows: str, a: str, b: str) -> str:
    return (
        f"SELECT suite, model, n, round(m, 6) AS mean_diff, round(CASE WHEN n >= 5 AND sd > 0 THEN m / sd END, 6) AS d_z, round(CASE WHEN n >= 5 AND sd > 0 AND sqrt((sa * sa + sb * sb) / 2) > 0 THEN m / sqrt((sa * sa + sb * sb) / 2) END, 6) AS d_av "
        f"FROM (SELECT suite, model, count(*) AS n, avg({a} - {b}) AS m, stddev_samp({a} - {b}) AS sd, stddev_samp({a}) AS sa, stddev_samp({b}) AS sb FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY suite, model) q"
    )


_SHARE = "count(*) AS n, count(CASE WHEN shift = 'harmful' THEN 1 END) AS n_harmful, round(count(CASE WHEN shift = 'harmful' THEN 1 END) * 100.0 / count(*), 6) AS pct_harmful, round(avg(d_error), 6) AS mean_d_error"
# metrics over each (suite, domain)'s own baseline: the plain control, the two-stage one in domain 0
_OWN_IT = """w2 AS (
  SELECT d.item, max(CASE WHEN condition = (CASE WHEN domain = 0 THEN 'control_twostage' ELSE 'control' END) THEN answer END) AS y,
         max(CASE WHEN condition = (CASE WHEN domain = 0 THEN 'control_twostage' ELSE 'control' END) THEN gold END) AS g
  FROM d GROUP BY d.item),
it2 AS (
  SELECT b.suite, b.domain, b.n_records - CASE WHEN b.domain = 0 THEN coalesce(x.lost, 0) ELSE 0 END AS n_records, b.n_answered - CASE WHEN b.domain = 0 THEN coalesce(x.lost_ok, 0) ELSE 0 END AS n_answered,
         w2.y, w2.g, {more}
  FROM base b LEFT JOIN w USING (item) LEFT JOIN w2 USING (item)
  LEFT JOIN (SELECT item, count(*) AS lost, count(CASE WHEN parsed_ok THEN 1 END) AS lost_ok FROM rec WHERE condition = 'control' GROUP BY item) x USING (item))"""
_OWN_EFF = ", ".join(
    f"CASE WHEN abs(w.k_{c} - w2.y) >= 3 THEN CAST(w.a_{c} - w2.y AS DOUBLE) / (w.k_{c} - w2.y) END AS u_{c}, CASE WHEN (w.a_{c} - w2.y) * (w.k_{c} - w2.y) > 0 THEN 1.0 WHEN (w.a_{c} - w2.y) * (w.k_{c} - w2.y) IS NOT NULL THEN 0.0 END AS t_{c}"
    for c in CORE_ANCHORED
)
_OWN_METRICS = ", ".join(f"{AGG[c]} AS {c}" for c in BASE)

MEDICAL = ("triage", "recovery", "dosage")


def _unbalanced(domains: tuple[str, ...]) -> str:
    """Errors of balance of customers as items: domains, difficulties."""
    by = f"(SELECT count(*) AS n FROM {_turns(domains)} i GROUP BY domain)"
    level = lambda d: f"(SELECT count(*) FROM {_turns(domains)} i WHERE difficulty = '{d}')"
    return f"CAST((SELECT CASE WHEN max(n) > 2 * min(n) THEN 1 ELSE 0 END FROM {by} q) + CASE WHEN {level('easy')} > 0 AND {level('hard')} > 0 AND {level('easy')} <> {level('hard')} THEN 1 ELSE 0 END AS BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "tar_by_condition": _with("SELECT suite, model, " + ", ".join(f"round(avg(t_{c}), 6) AS tar_{c}" for c in CORE_ANCHORED) + " FROM it GROUP BY suite, model"),
    "metrics_over_own_baseline": _with(f"SELECT suite, domain, CAST(sum(n_records) AS BIGINT) AS n_records, {_OWN_METRICS}, CASE WHEN domain = 0 THEN 'control_twostage' ELSE 'control' END AS baseline FROM it2 GROUP BY suite, domain", _OWN_IT.format(more=_OWN_EFF)),
    "metrics_by_known_difficulty": _with(_metrics(["n_records", "n_items", *BASE], "suite, model, difficulty", "kd"), "kd AS (SELECT * REPLACE (CASE WHEN domain < 5 THEN difficulty ELSE 'unknown' END AS difficulty) FROM it)"),
    "uai_vectors": _with("SELECT suite, model, grp, direction, count(*) AS n, round(avg(uai), 6) AS mean_uai FROM vv GROUP BY ALL", _VECTOR),
    "vector_summary": _with(
        "SELECT suite, model, 'uai_' || grp AS vector, count(*) AS n, round(avg(uai), 6) AS mean FROM vv GROUP BY ALL UNION ALL SELECT suite, model, 'disc_delta', count(*), round(avg(x), 6) FROM dl WHERE x IS NOT NULL GROUP BY ALL "
        "UNION ALL SELECT suite, model, 'mae', count(*), round(avg(abs(answer - gold)), 6) FROM d WHERE condition = 'control' GROUP BY ALL",
        _VECTOR,
        "dl AS (SELECT suite, model, item, direction, max(CASE WHEN grp = 'plausible' THEN uai END) - max(CASE WHEN grp = 'irrelevant' THEN uai END) AS x FROM vv GROUP BY ALL)",
    ),
    "prepared_items": _with("SELECT item AS item_id, suite, difficulty, domain, o_custkey AS owner FROM (SELECT item, suite, difficulty, domain FROM rec WHERE condition NOT IN ('control_twostage', 'placebo_low') GROUP BY ALL HAVING count(DISTINCT condition) = 5) q JOIN orders ON o_orderkey = item"),
    "seeded_items": "SELECT o_orderkey AS item, CAST(row_number() OVER (ORDER BY sha256('42:' || o_orderkey)) - 1 AS INTEGER) AS ord FROM orders QUALIFY ord < 100",
    "ablation_split": _with("SELECT condition, count(*) AS n, CASE WHEN condition IN ('control_twostage', 'placebo_low') THEN 'ablation' ELSE 'core' END AS part FROM rec GROUP BY condition"),
    "visible_count_slices": _with("SELECT domain + 1 AS k, condition, count(*) AS n, CAST(sum(answer) AS BIGINT) AS answers FROM rec WHERE domain < 3 GROUP BY ALL"),
    "realism_curve": _with("SELECT suite, CASE domain WHEN 0 THEN 'rank1' WHEN 1 THEN 'rank5' WHEN 2 THEN 'rank5_distract' ELSE 'baseline' END AS level, round(avg(uai), 6) AS uai, count(uai) AS n FROM cv GROUP BY ALL", _CURVE2),
    "strategy_effect_means": _with(
        "SELECT difficulty, round(avg(x), 6) AS mean_change, count(x) AS n, CAST(row_number() OVER (ORDER BY avg(x) NULLS LAST, difficulty) AS INTEGER) AS place FROM (SELECT a.difficulty, a.dd - b.dd AS x FROM va a JOIN va b ON a.suite = b.suite AND a.model = b.model AND b.difficulty = 'easy' WHERE a.difficulty <> 'easy' AND a.dd IS NOT NULL AND b.dd IS NOT NULL) q GROUP BY difficulty",
        _VARIANTS,
    ),
    "reasoning_pairs": _with("SELECT suite, model, round(ua, 6) AS uai_plaus_easy, round(ub, 6) AS uai_plaus_hard, round(ma, 6) AS mae_easy, round(mb, 6) AS mae_hard, round(ub - ua, 6) AS d_uai_plaus, round(mb - ma, 6) AS d_mae FROM pr", _VARIANTS, _PAIRS),
    "reasoning_summary": _with(
        "SELECT coalesce(suite, 'ALL') AS suite, count(*) AS n, count(CASE WHEN ub - ua < 0 THEN 1 END) AS n_lower, round(avg(ub - ua), 6) AS mean_change, count(CASE WHEN ub > 0 THEN 1 END) AS n_above_zero, round(avg(ub), 6) AS mean_level FROM pr GROUP BY ROLLUP (suite)", _VARIANTS, _PAIRS
    ),
    "rule_changes": _with("SELECT suite, model, round(di, 6) AS d_uai_irr, round(du, 6) AS d_uai_plaus FROM ru", *_RULE_CTES),
    "rule_change_means": _with("SELECT 'd_uai_irr' AS \"column\", round(avg(di), 6) AS mean, count(di) AS n FROM ru UNION ALL SELECT 'd_uai_plaus', round(avg(du), 6), count(du) FROM ru", *_RULE_CTES),
    "domain_families": _with("SELECT suite, model, " + ", ".join(f"round({p}{x}, 6) AS {n}_uai_{m}" for p, n in (("e", "extension"), ("b", "business"), ("m", "medical")) for x, m in (("i", "irr"), ("u", "plaus"))) + " FROM fa", *_FAMILY_CTES),
    "domain_family_means": _with(" UNION ALL ".join(f"SELECT suite, 'uai_{m}' AS metric, '{n}' AS family, round(avg({p}{x}), 6) AS mean, count({p}{x}) AS n FROM fa GROUP BY suite" for p, n in (("e", "extension"), ("b", "business"), ("m", "medical")) for x, m in (("i", "irr"), ("u", "plaus"))), *_FAMILY_CTES),
    "experiment_cells": """WITH t AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS ord FROM (SELECT DISTINCT r_name AS name FROM region) q),
m AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS ord FROM (SELECT DISTINCT s_name AS name FROM supplier) q), s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS ord FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) q)
SELECT t.name AS tier, m.name AS model, s.name AS suite, CAST(m.ord % 2 AS INTEGER) AS slot, CAST((t.ord * (SELECT count(*) FROM m) + m.ord) * (SELECT count(*) FROM s) + s.ord AS INTEGER) AS ord FROM t, m, s""",
    "panel_summaries": _with("SELECT p.model, p.suite, round(u, 6) AS uai_plaus FROM (SELECT model, suite FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) a(model), (VALUES ('F'), ('O'), ('X')) b(suite)) p LEFT JOIN bd ON bd.model = p.model AND bd.suite = p.suite", _BOUNDS),
    "placebo_bias": _with("SELECT suite, count(CASE WHEN m > 0.05 THEN 1 END) AS n_over, count(*) AS n FROM (SELECT suite, model, avg(CASE WHEN grp = 'placebo' THEN uai END) AS m FROM vv GROUP BY suite, model) q GROUP BY suite", _VECTOR),
    "mean_effect_size": _with("SELECT suite, round(avg(abs(d_z)), 6) AS mean_abs_d, count(d_z) AS n FROM f GROUP BY suite", _COHEN),
    "pooled_rounded_d": _with("SELECT suite, model, round(sum(abs(round(d_z, 3)) * n) / sum(n), 6) AS abs_d, round(sum(round(d_z, 3) * n) / sum(n), 6) AS signed_d, CAST(sum(n) AS BIGINT) AS n FROM f WHERE d_z IS NOT NULL GROUP BY suite, model", _COHEN),
    "bound_headline": _with(
        f"SELECT count(*) AS n, count(CASE WHEN u > 1.0 / 6 THEN 1 END) AS n_above, round(coalesce(count(CASE WHEN u > 1.0 / 6 THEN 1 END) / nullif(count(*), 0)::DOUBLE, 0), 6) AS share_above, round(median({_W.format(u='u')}), 6) AS median_w, round(coalesce(median({_W.format(u='ui')}), 0), 6) AS median_w_lo, count(CASE WHEN {_W.format(u='u')} > 5 THEN 1 END) AS n_over_evidence FROM bd WHERE suite <> 'P' AND u IS NOT NULL",
        _BOUNDS,
    ),
    "certain_excess": _with(f"SELECT suite, model, round(ui, 6) AS uai_irr, ui > 1.0 / 6 AS surely_above, round({_W.format(u='ui')}, 6) AS implied_w_lo FROM bd", _BOUNDS),
    "dose_response": _with("SELECT suite, round(avg(CASE WHEN level = 'irrelevant' THEN uai END), 6) AS low, round(avg(CASE WHEN level = 'plausible' THEN uai END), 6) AS high, round(avg(CASE WHEN level = 'plausible' THEN uai END) - avg(CASE WHEN level = 'irrelevant' THEN uai END), 6) AS change FROM cu GROUP BY suite", _CURVE2),
    "shift_breakdowns": _with(
        f"SELECT 'relevance' AS grouping, NULL AS model, relevance, NULL AS proximity, {_SHARE} FROM sh GROUP BY relevance UNION ALL SELECT 'proximity', NULL, NULL, proximity, {_SHARE} FROM sh GROUP BY proximity UNION ALL SELECT 'model+relevance', model, relevance, NULL, {_SHARE} FROM sh GROUP BY model, relevance", _LONG, _SHIFT
    ),
    "curves_with_mean": _with(
        "SELECT coalesce(model, 'MEAN') AS model, round(avg(i), 6) AS irrelevant, round(avg(p), 6) AS plausible FROM (SELECT suite, model, max(CASE WHEN level = 'irrelevant' THEN uai END) AS i, max(CASE WHEN level = 'plausible' THEN uai END) AS p FROM cu GROUP BY suite, model) q GROUP BY ROLLUP (model)", _CURVE2
    ),
    "detailed_usage": _with("SELECT suite, model, prompt_tokens, completion_tokens, reasoning_tokens, cached_tokens, round(cost, 6) AS cost, n_items, model_id FROM us", _USAGE),
    "bill": _with("SELECT model, suites, prompt_tokens, completion_tokens, round(cost, 6) AS cost, round(full_cost, 6) AS full_cost FROM bm UNION ALL SELECT 'TOTAL', NULL, CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT), round(sum(cost), 6), round(sum(full_cost), 6) FROM bm", _USAGE, _BILL),
    "high_low_effects": _with(_d("it", "a_plausible_high", "a_plausible_low")),
    "effect_over_two_stage": _with(_d("ox", "a", "y"), _OWN),
    "case_study_texts": _with(
        "SELECT q.suite, q.model, q.item, rank, substr(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN repeat(o_orderpriority || ' ', 30) END, ''), 1, 200) AS text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY suite, model ORDER BY CASE WHEN dr > 1 THEN 1 ELSE 0 END, score DESC, item) AS INTEGER) AS rank FROM c2) q JOIN orders ON o_orderkey = q.item WHERE rank <= 3",
        "c1 AS (SELECT suite, model, item, domain, abs(a_plausible_high - y) - abs(a_irrelevant_high - y) AS margin, abs(a_plausible_high - y) * (1 + (abs(a_plausible_high - y) - abs(a_irrelevant_high - y)) / 30.0::DOUBLE) AS score FROM it)",
        "c2 AS (SELECT *, row_number() OVER (PARTITION BY suite, model, domain ORDER BY score DESC, item) AS dr FROM c1 WHERE margin > 0)",
    ),
    "suite_manifests": f"SELECT suite, n AS n_items, n * k AS n_views, CAST(k AS BIGINT) AS conditions_per_item, domains FROM (SELECT count(*) AS n, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM {_turns(_DOMAINS)} i) q, (VALUES ('external', 9), ('history', 6), ('icl', 7), ('icl_dist', 5), ('rag', 17), ('tool', 5)) t(suite, k)",
    "suite_errors": f"SELECT suite, {_unbalanced(_DOMAINS)} AS n_errors FROM (VALUES ('external'), ('history'), ('icl'), ('icl_dist'), ('rag'), ('tool')) t(suite)",
    "medical_weighted_manifest": f"SELECT count(*) * 9 AS n_views, count(*) AS n_items, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, 'authority_high,authority_low,control,irrelevant_high,irrelevant_low,placebo_high,placebo_low,plausible_high,plausible_low' AS conditions, CAST(9 AS BIGINT) AS conditions_per_item, {_unbalanced(MEDICAL)} AS n_errors FROM {_turns(MEDICAL)} i",
    "variant_views": """WITH dirs AS (SELECT * FROM (VALUES ('low'), ('high')) t(d)), rels AS (SELECT * FROM (VALUES ('plausible'), ('irrelevant')) t(r)),
c AS (
  SELECT 'rag_realism' AS kind, r || '_' || d || v AS condition, true AS anchored FROM rels, dirs, (VALUES ('_rank1'), ('_rank5'), ('_rank5_distract')) t(v)
  UNION ALL SELECT k, 'plausible_' || i || '_' || d, true FROM dirs, (VALUES ('mild'), ('strong')) t(i), (VALUES ('rag_intensity'), ('history_intensity')) u(k)
  UNION ALL SELECT 'tool_realism', r || '_' || d || v, true FROM rels, dirs, (VALUES ('_elicited'), ('_noisy')) t(v)
  UNION ALL SELECT 'uncertain', 'uncertain_p' || p || '_' || r || '_' || d, true FROM rels, dirs, range(1, 4) t(p)
  UNION ALL SELECT 'uncertain', 'uncertain_p' || p || '_control', false FROM range(1, 4) t(p))
SELECT condition, i AS n, CASE WHEN anchored THEN i ELSE 0 END AS n_anchored, CASE WHEN anchored THEN i ELSE 0 END AS n_marked, i AS n_items, kind FROM c, (SELECT count(*) AS i FROM customer) q""",
    "rag_corpus": "SELECT doc_type, relevance, i * k AS n, i * k AS n_ids, CASE WHEN a THEN i * k ELSE 0 END AS n_anchored, i * k AS n_texts FROM (SELECT count(*) AS i FROM customer) q, (VALUES ('core', 'none', 1, false), ('filler', 'none', 1, false), ('anchor_slot', 'none', 1, false), ('anchor_slot', 'irrelevant', 4, true), ('anchor_slot', 'plausible', 2, true), ('anchor_slot', 'authority', 2, true)) t(doc_type, relevance, k, a)",
    "tool_message_counts": "SELECT r || '_' || d || '_' || v AS condition, role, i * k AS n, CASE WHEN role = 'assistant' THEN 2 * i ELSE 0 END AS n_calls, CASE WHEN role = 'assistant' AND v = 'noisy' THEN 0 ELSE i * k END AS n_contents FROM (SELECT count(*) AS i FROM customer) q, (VALUES ('plausible'), ('irrelevant')) a(r), (VALUES ('low'), ('high')) b(d), (VALUES ('elicited'), ('noisy')) c(v), (VALUES ('system', 1), ('user', 1), ('assistant', 2), ('tool', 2)) e(role, k)",
    "subset_of_five": f"""WITH {_EVID}, f AS (SELECT item, every_one[1:5] AS v FROM ev WHERE len(every_one) >= 5),
pr AS (SELECT item, i, j, list_filter([v[i + 1], v[j + 1]], lambda x: x IS NOT NULL) AS s FROM f, (SELECT a.range AS i, b.range AS j FROM range(5) a, range(5) b WHERE a.range < b.range) q),
m AS (SELECT item, i, j, CASE WHEN len(s) > 0 THEN list_sum(s)::DOUBLE / len(s) ELSE 0 END AS mean FROM pr)
SELECT item, round(abs(mean - 20), 6) AS gap, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY item ORDER BY abs(mean - 20), i, j) = 1""",
    "item_set_errors": """WITH i AS (SELECT o_orderstatus || '-' || o_custkey || '-' || o_orderpriority AS item_id, o_orderstatus AS suite, o_orderpriority AS domain, o_custkey % 3 AS lv, o_orderkey AS ok, o_custkey AS ck FROM orders),
s AS (SELECT suite, count(*) AS n, count(CASE WHEN lv = 0 THEN 1 END) AS e, count(CASE WHEN lv = 2 THEN 1 END) AS h, count(DISTINCT ok % 3) AS sc, count(DISTINCT 2 * ok % 2) AS qu, count(DISTINCT ck % 2) AS la FROM i GROUP BY suite),
u AS (SELECT suite FROM (SELECT suite, domain, count(*) AS n FROM i GROUP BY suite, domain) q GROUP BY suite HAVING max(n) > 2 * min(n))
SELECT 'item' AS scope, item_id AS key, 'item repeated' AS error FROM i GROUP BY item_id HAVING count(*) > 1
UNION ALL SELECT 'suite', suite, 'domains uneven' FROM u UNION ALL SELECT 'suite', suite, 'difficulties uneven' FROM s WHERE e > 0 AND h > 0 AND e <> h
UNION ALL SELECT 'suite', suite, 'one scenario for all' FROM s WHERE n >= 4 AND sc = 1 UNION ALL SELECT 'suite', suite, 'one question for all' FROM s WHERE n >= 4 AND qu = 1
UNION ALL SELECT 'suite', suite, 'one label for all' FROM s WHERE n >= 6 AND la = 1 UNION ALL SELECT 'suite', suite, 'one phrasing for all' FROM s WHERE n >= 8 AND la = 1""",
    "balance_checks": "SELECT suite, max(n) > 2 * min(n) AS uneven, max(n) AS largest, min(n) AS smallest FROM (SELECT o_orderstatus AS suite, o_orderpriority AS domain, count(*) AS n FROM orders GROUP BY ALL) q GROUP BY suite",
}


def _suffixes() -> str:
    from ..operators.suites import SUFFIXES

    names = list(SUFFIXES)
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    texts = " ".join(f"WHEN '{n}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for n, t in SUFFIXES.items())
    return f"SELECT item_id, name, md5(CASE WHEN name = 'baseline' THEN text ELSE text || chr(10) || chr(10) || CASE name {texts} END END) AS prompt_md5 FROM (SELECT item_id, text, CASE length(text) % {len(names)} {cases} END AS name FROM benchmark) q"


ORACLE_SQL["suffixed_prompts"] = _suffixes()
