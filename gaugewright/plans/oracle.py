"""DuckDB SQL that gives the rows of the queries, written from their definitions over the same tables."""

from __future__ import annotations

from ..schemas import CORE_ANCHORED
from ..sources.adapters import LINE_CONDITIONS

_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LINE_CONDITIONS, 1))
REC = f"""rec AS (
  SELECT l_orderkey AS item, CASE l_linenumber {_CASE} END AS condition, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
         CAST(floor(l_quantity * 2) AS INTEGER) AS answer, CASE WHEN l_linenumber NOT IN (1, 6) THEN CAST(l_partkey % 101 AS INTEGER) END AS anchor,
         CAST(l_suppkey % 101 AS INTEGER) AS stage1, l_returnflag <> 'R' AS parsed_ok, CAST(floor(l_extendedprice) AS BIGINT) AS prompt_tokens,
         CASE WHEN l_tax > 0.01 THEN CAST(floor(l_quantity) AS BIGINT) END AS completion_tokens,
         o_orderstatus AS suite, o_orderpriority AS model, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS gold,
         CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
         CASE o_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 25 WHEN 2 THEN 40 END AS "offset", CAST(o_custkey % 7 AS INTEGER) AS domain
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (
  SELECT * FROM rec WHERE parsed_ok
  QUALIFY row_number() OVER (PARTITION BY item, condition ORDER BY l_partkey DESC, CAST(round(l_extendedprice * 100) AS BIGINT) DESC) = 1)"""


def _val(c: str, x: str) -> str:
    return f"max(CASE WHEN condition = '{c}' THEN {x} END)"


_WIDE = ", ".join([f"{_val('control', 'answer')} AS y", f"{_val('control', 'gold')} AS g"] + [f"{_val(c, x)} AS {p}_{c}" for c in CORE_ANCHORED for x, p in (("answer", "a"), ("anchor", "k"), ("stage1", "s"), ("gold", "gg"))])
_EFF = ", ".join(
    f"CASE WHEN abs(k_{c} - y) >= 3 THEN CAST(a_{c} - y AS DOUBLE) / (k_{c} - y) END AS u_{c}, "
    f"CASE WHEN (a_{c} - y) * (k_{c} - y) > 0 THEN 1.0 WHEN (a_{c} - y) * (k_{c} - y) IS NOT NULL THEN 0.0 END AS t_{c}"
    for c in CORE_ANCHORED
)
ITEMS = f"""w AS (SELECT item, {_WIDE} FROM d GROUP BY item),
base AS (SELECT item, suite, model, difficulty, "offset", domain, count(*) AS n_records, sum(CASE WHEN parsed_ok AND answer IS NOT NULL THEN 1 ELSE 0 END) AS n_answered, max(CASE WHEN parsed_ok THEN 1 ELSE 0 END) AS ok FROM rec GROUP BY ALL),
it AS (SELECT base.*, w.* EXCLUDE (item), {_EFF} FROM base LEFT JOIN w USING (item))"""


def _pool(p: str, kind: str) -> str:
    a, b = (f"{p}_{kind}_{x}" for x in ("low", "high"))
    return f"(coalesce(sum({a}), 0) + coalesce(sum({b}), 0)) / nullif(count({a}) + count({b}), 0)"


AGG = {
    "n_records": "CAST(sum(n_records) AS BIGINT)",
    "n_items": "CAST(sum(ok) AS BIGINT)",
    "parse_rate": "round(CAST(sum(n_answered) AS DOUBLE) / sum(n_records), 6)",
    "mae": "round(avg(abs(y - g)), 6)",
    "acc10": "round(avg(CASE WHEN abs(y - g) <= 10 THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END), 6)",
    **{f"uai_{c}": f"round(avg(u_{c}), 6)" for c in CORE_ANCHORED},
    "uai_irr": f"round({_pool('u', 'irrelevant')}, 6)",
    "uai_plaus": f"round({_pool('u', 'plausible')}, 6)",
    "n_uai_irr": "count(u_irrelevant_low) + count(u_irrelevant_high)",
    "n_uai_plaus": "count(u_plausible_low) + count(u_plausible_high)",
    "tar_irr": f"round({_pool('t', 'irrelevant')}, 6)",
    "tar_plaus": f"round({_pool('t', 'plausible')}, 6)",
    "disc_delta": f"round({_pool('u', 'plausible')} - {_pool('u', 'irrelevant')}, 6)",
}
BASE = ["uai_irr", "uai_plaus", "tar_irr", "tar_plaus", "disc_delta", "mae", "acc10", "parse_rate"]


def _metrics(cols: list[str], group: str, source: str = "it") -> str:
    return f"SELECT {group}, {', '.join(f'{AGG[c]} AS {c}' for c in cols)} FROM {source} GROUP BY {group}"


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([REC, ITEMS, *ctes])} {body}"


CELL = "suite, model"
_LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT suite, model, item, '{c}' AS condition, a_{c} AS answer, k_{c} AS anchor, y AS control, g AS gold, u_{c} AS uai FROM it WHERE y IS NOT NULL AND a_{c} IS NOT NULL AND k_{c} IS NOT NULL" for c in CORE_ANCHORED
) + ")"
_SHIFT = """sh AS (
  SELECT *, abs(answer - gold) - abs(control - gold) AS d_error, CASE WHEN condition LIKE 'irr%' THEN 'irrelevant' ELSE 'plausible' END AS relevance,
         CASE WHEN abs(answer - gold) > abs(control - gold) THEN 'harmful' WHEN abs(answer - gold) < abs(control - gold) THEN 'helpful' ELSE 'neutral' END AS shift,
         CASE WHEN abs(anchor - gold) < abs(control - gold) THEN 'closer' WHEN abs(anchor - gold) > abs(control - gold) THEN 'farther' ELSE 'equidistant' END AS proximity
  FROM lg WHERE gold IS NOT NULL)"""
_SHARES = "count(*) AS n, " + ", ".join(f"count(CASE WHEN shift = '{k}' THEN 1 END) AS n_{k}, round(count(CASE WHEN shift = '{k}' THEN 1 END) * 100.0 / count(*), 6) AS pct_{k}" for k in ("harmful", "helpful", "neutral")) + ", round(avg(d_error), 6) AS mean_d_error"
_COHEN = "e AS (" + " UNION ALL ".join(
    f"SELECT suite, model, '{c}' AS condition, count(*) AS n, avg(a_{c} - y) AS mean_diff, stddev_samp(a_{c} - y) AS sd, stddev_samp(a_{c}) AS sa, stddev_samp(y) AS sb FROM it WHERE a_{c} IS NOT NULL AND y IS NOT NULL GROUP BY suite, model" for c in CORE_ANCHORED
) + "), f AS (SELECT suite, model, condition, n, mean_diff, CASE WHEN n >= 5 AND sd > 0 THEN mean_diff / sd END AS d_z, CASE WHEN n >= 5 AND sd > 0 AND sqrt((sa * sa + sb * sb) / 2) > 0 THEN mean_diff / sqrt((sa * sa + sb * sb) / 2) END AS d_av FROM e)"
_CURVE = """co AS (SELECT suite, model, item, answer AS control FROM d WHERE condition = 'control'),
cv AS (
  SELECT r.suite, r.model, split_part(r.condition, '_', 1) AS level, CASE WHEN abs(r.anchor - control) >= 3 THEN CAST(r.answer - control AS DOUBLE) / (r.anchor - control) END AS uai
  FROM rec r JOIN co USING (suite, model, item) WHERE r.parsed_ok AND r.anchor IS NOT NULL),
cu AS (SELECT suite, model, level, avg(uai) AS uai, count(uai) AS n FROM cv GROUP BY ALL)"""
_EVID = """ev AS (
  SELECT l_orderkey AS item, list(CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_quantity) AS INTEGER) END ORDER BY l_linenumber, l_partkey, l_suppkey, floor(l_quantity), CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS every_one
  FROM lineitem GROUP BY l_orderkey),
vis AS (SELECT item, list_filter(every_one, lambda x: x IS NOT NULL) AS v FROM ev)"""
_RAW = """comp AS (
  SELECT CASE l_suppkey % 8
    WHEN 0 THEN 'After thought <answer>' || q || '.5</answer>' WHEN 1 THEN 'The ratings were mixed.' || chr(10) || 'My final answer is ' || p WHEN 2 THEN q
    WHEN 3 THEN 'First 12 then 30.' || chr(10) || 'I settle on ' || q WHEN 4 THEN 'It could be 20 or ' || p || ' or 35, hard to say' WHEN 5 THEN 'No number here'
    WHEN 6 THEN '{"name": "lookup", "value": ' || q || '}' ELSE '**' || q || '**' END AS raw, l_suppkey % 8 AS shape, CAST(q AS INTEGER) AS qi, CAST(p AS INTEGER) AS pi
  FROM (SELECT l_suppkey, CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) AS q, CAST(l_partkey % 140 AS VARCHAR) AS p FROM lineitem)),
txt AS (SELECT raw, count(*) AS n, min(shape) AS shape, min(qi) AS qi, min(pi) AS pi FROM comp GROUP BY raw)"""
_BOUND = ", ".join(f"round({w} / (5 + {w}), 6) AS ceiling_{str(w).replace('.', '_')}" for w in (0.5, 1.0, 1.5, 2.0, 3.0, 5.0))
_IMPLIED = "CASE WHEN u >= 1 THEN NULL WHEN u <= 0 THEN 0.0 ELSE u * 5 / (1 - u) END"
_CELLU = f"cl AS (SELECT suite, model, {_pool('u', 'irrelevant')} AS ui, {_pool('u', 'plausible')} AS u FROM it GROUP BY suite, model)"
_HASH = "'sha256:' || substr(sha256(text), 1, 16)"
_SLUG = "regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g')"
_TASKS = "(SELECT o_orderkey AS item, c.condition, c.ord FROM orders CROSS JOIN (VALUES ('control', 0), ('irrelevant_low', 1), ('irrelevant_high', 2), ('plausible_low', 3), ('plausible_high', 4)) AS c(condition, ord))"


def _by(column: str) -> str:
    return _with(f"{_metrics(['n_records', 'n_items', *BASE], f'suite, model, {column}')} HAVING {column} IS NOT NULL")


def _sets() -> str:
    cols = ["n_records", "n_items", *BASE]
    body = ", ".join(f"{AGG[c]} AS {c}" for c in cols)
    total = f"SELECT 'total' AS level, suite, model, CAST(NULL AS INTEGER) AS \"offset\", CAST(NULL AS VARCHAR) AS difficulty, {body} FROM it GROUP BY suite, model"
    off = f"SELECT 'offset' AS level, suite, model, \"offset\", NULL AS difficulty, {body} FROM it WHERE \"offset\" IS NOT NULL GROUP BY suite, model, \"offset\""
    dif = f"SELECT 'difficulty' AS level, suite, model, NULL AS \"offset\", difficulty, {body} FROM it GROUP BY suite, model, difficulty"
    return _with(f"{total} UNION ALL {off} UNION ALL {dif}")


def _weights() -> str:
    return "[1.0, 1.0, 1.5, 1.5, 2.0]"


ORACLE_SQL: dict[str, str] = {
    "dedup_last_wins": _with("SELECT suite, model, item, condition, answer, anchor FROM d"),
    "uai_by_cell": _with(_metrics([*[f"uai_{c}" for c in CORE_ANCHORED], "uai_irr", "uai_plaus", "n_uai_irr", "n_uai_plaus"], CELL)),
    "tar_by_cell": _with(_metrics(["tar_irr", "tar_plaus"], CELL)),
    "unified_metrics": _with(_metrics(["n_records", "n_items", "n_uai_irr", "n_uai_plaus", *BASE], CELL)),
    "metrics_by_offset": _by('"offset"'),
    "metrics_by_difficulty": _by("difficulty"),
    "metrics_grouping_sets": _sets(),
    "parse_rate_by_condition": _with("SELECT suite, model, condition, count(*) AS n, round(CAST(count(CASE WHEN parsed_ok THEN 1 END) AS DOUBLE) / count(*), 6) AS parse_rate FROM rec GROUP BY ALL"),
    "mae_acc10_control": _with(_metrics(["mae", "acc10"], CELL)),
    "acr_rr_history": _with(
        "SELECT suite, model, round(avg(acr), 6) AS acr, round(avg(rr), 6) AS rr, count(acr) AS n_acr FROM h GROUP BY suite, model",
        "h AS (" + " UNION ALL ".join(f"SELECT suite, model, CASE WHEN abs(gg_{c} - s_{c}) >= 1 THEN CAST(a_{c} - s_{c} AS DOUBLE) / (gg_{c} - s_{c}) END AS acr, CASE WHEN abs(gg_{c} - s_{c}) >= 1 THEN 1 - CAST(abs(a_{c} - gg_{c}) AS DOUBLE) / abs(s_{c} - gg_{c}) END AS rr FROM it" for c in CORE_ANCHORED[2:]) + ")",
    ),
    "baseline_choice": _with("SELECT suite, model, difficulty, CASE WHEN max(CASE WHEN condition = 'control_twostage' THEN 1 ELSE 0 END) = 1 THEN 'control_twostage' WHEN max(CASE WHEN condition = 'control' THEN 1 ELSE 0 END) = 1 THEN 'control' ELSE 'control_twostage' END AS baseline FROM rec GROUP BY suite, model, difficulty"),
    "complete_items_semijoin": _with("SELECT suite, model, item, CAST(count(DISTINCT condition) AS INTEGER) AS n_conditions FROM rec WHERE condition NOT IN ('control_twostage', 'placebo_low') GROUP BY suite, model, item HAVING count(DISTINCT condition) = 5"),
    "item_condition_cross": f"SELECT item, condition, ord FROM {_TASKS} t",
    "pending_tasks_antijoin": _with(f"SELECT item, condition, ord FROM {_TASKS} t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.item = t.item AND d.condition = t.condition)"),
    "pair_join_plaus_irr": _with(" UNION ALL ".join(f"SELECT suite, model, '{x}' AS direction, count(*) AS n, round(avg(u_plausible_{x} - u_irrelevant_{x}), 6) AS mean_diff FROM it WHERE u_plausible_{x} - u_irrelevant_{x} IS NOT NULL GROUP BY suite, model" for x in ("low", "high"))),
    "gold_shift_items": _with("SELECT suite, model, item, condition, shift, proximity, relevance, d_error FROM sh", _LONG, _SHIFT),
    "gold_shift_rollup": _with(f"SELECT suite, {_SHARES} FROM sh GROUP BY suite UNION ALL SELECT 'ALL', {_SHARES} FROM sh", _LONG, _SHIFT),
    "gold_shift_strata": _with(f"SELECT suite, relevance, proximity, {_SHARES} FROM sh GROUP BY suite, relevance, proximity", _LONG, _SHIFT),
    "cohens_d_paired": _with("SELECT suite, model, condition, n, round(mean_diff, 6) AS mean_diff, round(d_z, 6) AS d_z, round(d_av, 6) AS d_av FROM f", _COHEN),
    "cohens_d_pooled": _with("SELECT suite, model, round(sum(abs(d_z) * n) / sum(n), 6) AS abs_d, round(sum(d_z * n) / sum(n), 6) AS signed_d, CAST(sum(n) AS BIGINT) AS n FROM f WHERE d_z IS NOT NULL GROUP BY suite, model", _COHEN),
    "strategy_deltas": _with(
        "SELECT a.suite, a.model, a.difficulty, round(a.dd - b.dd, 6) AS d_disc_delta, round(a.mae - b.mae, 6) AS d_mae, CASE WHEN a.dd - b.dd > 0.01 THEN 'better' WHEN a.dd - b.dd < -0.01 THEN 'worse' ELSE 'same' END AS disc_verdict, "
        "CASE WHEN a.mae - b.mae < -0.5 THEN 'better' WHEN a.mae - b.mae > 0.5 THEN 'worse' ELSE 'same' END AS mae_verdict FROM m a JOIN m b ON a.suite = b.suite AND a.model = b.model AND b.difficulty = 'easy' WHERE a.difficulty <> 'easy'",
        f"m AS (SELECT suite, model, difficulty, {_pool('u', 'plausible')} - {_pool('u', 'irrelevant')} AS dd, avg(abs(y - g)) AS mae FROM it GROUP BY suite, model, difficulty)",
    ),
    "greedy_vs_sampled": _with(
        "SELECT suite, model, round(greedy, 6) AS greedy, round(sm, 6) AS sampled_mean, round(ss, 6) AS sampled_std, n_sampled, round(sm - greedy, 6) AS delta FROM x WHERE greedy IS NOT NULL AND sm IS NOT NULL",
        f"m AS (SELECT suite, model, domain, {_pool('u', 'plausible')} AS u FROM it GROUP BY suite, model, domain)",
        "x AS (SELECT suite, model, avg(CASE WHEN domain = 0 THEN u END) AS greedy, avg(CASE WHEN domain <> 0 THEN u END) AS sm, stddev_pop(CASE WHEN domain <> 0 THEN u END) AS ss, count(CASE WHEN domain <> 0 THEN u END) AS n_sampled FROM m GROUP BY suite, model)",
    ),
    "intensity_curve": _with("SELECT suite, model, level, round(uai, 6) AS uai, n FROM cu", _CURVE),
    "monotone_check": _with("SELECT suite, model, CASE WHEN count(uai) = 3 THEN max(CASE WHEN level = 'placebo' THEN round(uai, 6) END) <= max(CASE WHEN level = 'irrelevant' THEN round(uai, 6) END) AND max(CASE WHEN level = 'irrelevant' THEN round(uai, 6) END) <= max(CASE WHEN level = 'plausible' THEN round(uai, 6) END) END AS monotone FROM cu GROUP BY suite, model", _CURVE),
    "uncertain_curve": _with("SELECT suite, k, round(avg(uai), 6) AS uai, count(uai) AS n, round(avg(CASE WHEN abs(control - gold) <= 10 THEN 1.0 ELSE 0.0 END), 6) AS acc10, round(1 / (k + 1.0), 6) AS ceiling FROM lg JOIN (SELECT item, CAST(least(3, greatest(1, len(v))) AS INTEGER) AS k FROM vis) q USING (item) GROUP BY suite, k", _LONG, _EVID),
    "bayesian_bound": _with(f"SELECT suite, model, round(ui, 6) AS uai_irr, round(u, 6) AS uai_plaus, round({_IMPLIED}, 6) AS implied_w, {_BOUND}, round(u - 1.0 / 6, 6) AS excess, u > 1.0 / 6 AS above FROM cl", _CELLU),
    "suite_summary_top3": _with(
        "SELECT suite, count(*) AS n_cells, round(avg(u), 6) AS mean_uai, round(median(w), 6) AS median_w, count(CASE WHEN w > 1 THEN 1 END) AS above_ref, count(CASE WHEN w > 5 THEN 1 END) AS above_n, count(CASE WHEN u > 1.0 / 6 THEN 1 END) AS above_ceiling, string_agg(CASE WHEN w IS NOT NULL AND r <= 3 THEN model END, ',' ORDER BY r) AS top FROM cb GROUP BY suite",
        _CELLU,
        f"cw AS (SELECT suite, model, u, {_IMPLIED} AS w FROM cl)",
        "cb AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY w DESC NULLS LAST, model) AS r FROM cw)",
    ),
    "case_studies_topk": _with(
        "SELECT suite, model, item, domain, round(margin, 6) AS margin, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY suite, model ORDER BY CASE WHEN dr > 1 THEN 1 ELSE 0 END, score DESC, item) AS INTEGER) AS rank FROM c2) q WHERE rank <= 3",
        "c1 AS (SELECT suite, model, item, domain, abs(a_plausible_high - y) - abs(a_irrelevant_high - y) AS margin, abs(a_plausible_high - y) * (1 + (abs(a_plausible_high - y) - abs(a_irrelevant_high - y)) / 30.0::DOUBLE) AS score FROM it)",
        "c2 AS (SELECT *, row_number() OVER (PARTITION BY suite, model, domain ORDER BY score DESC, item) AS dr FROM c1 WHERE margin > 0)",
    ),
    "leaderboard": _with("SELECT suite, model, u AS uai_plaus, CAST(row_number() OVER (PARTITION BY suite ORDER BY coalesce(u, 0) DESC, model) AS INTEGER) AS rank FROM (SELECT suite, model, round(u, 6) AS u FROM cl) q", _CELLU),
    "model_suite_pivot": _with(
        "SELECT model, " + ", ".join(f"round(avg(CASE WHEN suite = '{s}' THEN u END), 6) AS \"{s}\"" for s in "FOP") + " FROM cl GROUP BY model UNION ALL SELECT 'MEAN', " + ", ".join(f"round(avg(CASE WHEN suite = '{s}' THEN u END), 6)" for s in "FOP") + " FROM cl",
        _CELLU,
    ),
    "token_usage": _with("SELECT suite, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, count(DISTINCT item) AS n_items FROM rec GROUP BY suite, model"),
    "cost_rollup": _with(
        "SELECT model, p AS prompt_tokens, c AS completion_tokens, round((p * pi + c * po) / 1000000.0::DOUBLE, 6) AS cost, round((p * pi + c * po) / 1000000.0::DOUBLE * 100000 / greatest(k, 1), 6) AS full_cost FROM (SELECT model, CAST(sum(p) AS BIGINT) AS p, CAST(sum(c) AS BIGINT) AS c, CAST(sum(k) AS BIGINT) AS k FROM u GROUP BY model) q JOIN (VALUES ('1-URGENT', 1.0::DOUBLE, 3.0::DOUBLE), ('2-HIGH', 2.0, 5.0), ('3-MEDIUM', 3.0, 7.0), ('5-LOW', 4.0, 9.0)) AS t(model, pi, po) USING (model)",
        "u AS (SELECT suite, model, sum(prompt_tokens) AS p, sum(coalesce(completion_tokens, 0)) AS c, count(DISTINCT item) AS k FROM rec GROUP BY suite, model)",
    ),
    "slug_intersection": _with("SELECT a.item, a.answer AS a, b.answer AS b, b.answer - a.answer AS delta FROM d a JOIN d b ON a.item = b.item WHERE a.condition = 'control' AND b.condition = 'control_twostage'"),
    "splice_core_union": _with("SELECT 0 AS part, condition, count(*) AS n, CAST(sum(answer) AS BIGINT) AS answers FROM rec WHERE condition IN ('control', 'plausible_low') GROUP BY condition UNION ALL SELECT 1, condition, count(*), CAST(sum(answer) AS BIGINT) FROM rec WHERE condition = 'placebo_low' GROUP BY condition"),
    "wilcoxon_signed_rank": _with(
        "SELECT suite, model, count(*) AS n, round(sum(CASE WHEN dd > 0 THEN r ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN dd < 0 THEN r ELSE 0 END), 6) AS w_minus, CAST(sum(k * k - 1) AS DOUBLE) AS tie_term FROM x GROUP BY suite, model",
        _LONG,
        "x AS (SELECT suite, model, answer - control AS dd, count(*) OVER s AS k, rank() OVER (PARTITION BY suite, model ORDER BY abs(answer - control)) + (count(*) OVER s - 1) / 2.0::DOUBLE AS r FROM lg WHERE condition = 'plausible_high' AND answer <> control WINDOW s AS (PARTITION BY suite, model, abs(answer - control)))",
    ),
    "bh_adjust": "WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 5 AS INTEGER) AS family, CASE WHEN p_partkey % 11 <> 0 THEN round((p_partkey * 7919 % 1000) / 1000.0::DOUBLE, 3) END AS p FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS n FROM p WHERE p IS NOT NULL) SELECT id, family, p, round(least(1.0, min(p * n / r) OVER (PARTITION BY family ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh FROM q UNION ALL SELECT id, family, NULL, NULL FROM p WHERE p IS NULL",
    "pearson_r": _with("SELECT suite, model, count(*) AS n, round(corr(answer, anchor), 6) AS r FROM lg GROUP BY suite, model", _LONG),
    "gold_answer_rules": f"WITH {_EVID}, z AS (SELECT item, v, v[1:5] AS f FROM vis) SELECT item, CASE WHEN len(v) > 0 THEN CAST(round_even(list_avg(v), 0) AS INTEGER) ELSE 0 END AS mean_gold, CASE WHEN len(v) > 0 THEN CAST(round_even(list_median(v), 0) AS INTEGER) ELSE 0 END AS median_gold, CASE WHEN len(f) > 0 THEN CAST(round_even(list_sum(list_transform(f, lambda x, i: x * CAST({_weights()}[i] AS DOUBLE))) / list_sum(list_transform({_weights()}[1:len(f)], lambda x: CAST(x AS DOUBLE))), 0) AS INTEGER) ELSE 0 END AS weighted_gold FROM z",
    "evidence_summary": f"WITH {_EVID} SELECT item, CAST(len(v) AS INTEGER) AS n, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, list_min(v) AS lowest, list_max(v) AS highest FROM vis",
    "subset_argmin": f"WITH {_EVID}, u AS (SELECT item, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vis), pr AS (SELECT a.item, CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, (a.x + b.x) / 2.0::DOUBLE AS mean FROM u a JOIN u b ON a.item = b.item AND a.i < b.i) SELECT item, abs(mean - 20.0) AS distance, i, j, mean FROM pr QUALIFY row_number() OVER (PARTITION BY item ORDER BY abs(mean - 20.0), i, j) = 1",
    "prompt_hash": f"SELECT item_id, {_HASH} AS prompt_hash FROM benchmark",
    "document_hashes": f"SELECT doc_id, {_HASH} AS prompt_hash FROM documents",
    "parse_xml": f"WITH {_RAW} SELECT raw, n, CASE WHEN shape = 0 THEN CAST(round_even(qi + 0.5, 0) AS INTEGER) END AS answer FROM txt",
    "parse_last_number": f"WITH {_RAW} SELECT raw, n, CASE shape WHEN 0 THEN CAST(round_even(qi + 0.5, 0) AS INTEGER) WHEN 1 THEN CASE WHEN pi <= 100 THEN pi END WHEN 4 THEN 35 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE qi END AS answer FROM txt",
    "parse_declared": f"WITH {_RAW} SELECT raw, n, CASE WHEN shape = 1 AND pi <= 100 THEN pi WHEN shape = 7 THEN qi END AS answer FROM txt",
    "parse_cascade": f"""WITH {_RAW}, r AS (
      SELECT raw, n, CASE shape WHEN 0 THEN CAST(round_even(qi + 0.5, 0) AS INTEGER) WHEN 1 THEN CASE WHEN pi <= 100 THEN pi END WHEN 2 THEN qi WHEN 3 THEN qi
        WHEN 4 THEN CASE WHEN pi <= 100 AND pi NOT IN (20, 35) THEN pi ELSE 35 END WHEN 7 THEN qi END AS answer,
        CASE shape WHEN 0 THEN 'xml_tag' WHEN 1 THEN CASE WHEN pi <= 100 THEN 'final_answer' ELSE 'failed' END WHEN 2 THEN 'regex' WHEN 3 THEN 'regex'
        WHEN 4 THEN CASE WHEN pi <= 100 AND pi NOT IN (20, 35) THEN 'regex' ELSE 'last_number' END WHEN 7 THEN 'final_answer' ELSE 'failed' END AS strategy FROM txt)
      SELECT raw, n, answer, answer IS NOT NULL AS ok, strategy FROM r""",
    "runs_by_day": "WITH e AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS run, user_id, event_type AS condition, least(100, greatest(0, CAST(floor(value) AS INTEGER))) AS answer, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS anchor FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT run, condition, count(*) AS n, round(avg(answer), 6) AS mean_answer, CAST(sum(anchor) AS BIGINT) AS anchors FROM e GROUP BY run, condition",
    "two_stage_flatten": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text)) AS flat_sha256 FROM conversations GROUP BY conv_id",
    "doc_rank_insert": "WITH o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey), p AS (SELECT o_custkey, l, greatest(1, least(o_custkey % 9, len(l) + 1)) AS r FROM o), q AS (SELECT o_custkey, list_concat(list_concat(l[1:r - 1], ['ANCHOR']), l[r:]) AS m FROM p) SELECT o_custkey, array_to_string(list_transform(m, lambda d, i: '[Document ' || i || '] ' || d), chr(10)) AS block FROM q",
    "tool_reference_json": "SELECT s_suppkey, '{\"source\": \"' || s_name || '\", ' || CASE WHEN s_suppkey % 5 <> 0 THEN '\"value\": ' || (s_suppkey % 101) || ', ' ELSE '' END || '\"note\": \"for information\"}' AS reference FROM supplier",
    "slugs": f"SELECT c_custkey, {_SLUG} AS slug FROM customer",
    "stale_export": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 100 = 7 THEN -1 ELSE 1 END AS side FROM part WHERE p_partkey % 100 IN (3, 7)",
    "domain_balance": "SELECT max(n) AS largest, min(n) AS smallest, max(n) > 2 * min(n) AS imbalanced FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) q",
}
ORACLE_SQL["parse_strategy_histogram"] = f"SELECT strategy, CAST(sum(n) AS BIGINT) AS n, count(CASE WHEN ok THEN 1 END) AS n_texts_ok FROM ({ORACLE_SQL['parse_cascade']}) q GROUP BY strategy"
_DOMAINS = ("snacks", "streaming", "travel", "fitness", "coffee", "electronics")


def _turns(domains: tuple[str, ...]) -> str:
    """Customers as items: domain and difficulty by their number from 0."""
    names = ", ".join(f"'{d}'" for d in domains)
    return f"(SELECT c_custkey AS idx, [{names}][c_custkey % {len(domains)} + 1] AS domain, ['easy', 'hard'][c_custkey // {len(domains)} % 2 + 1] AS difficulty FROM customer)"


_GRID = f"(SELECT domain, condition FROM {_turns(_DOMAINS)} i, (VALUES ('control'), ('irrelevant_high'), ('irrelevant_low'), ('plausible_high'), ('plausible_low')) u(condition))"
ORACLE_SQL["generated_errors"] = f"SELECT count(*) AS n_items, CAST(0 AS BIGINT) AS n_errors FROM {_GRID} g WHERE condition = 'control'"
ORACLE_SQL["generated_manifest"] = f"SELECT count(*) AS n_views, count(*) // 5 AS n_items, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, string_agg(DISTINCT condition, ',' ORDER BY condition) AS conditions, CAST(5 AS BIGINT) AS conditions_per_item FROM {_GRID} g"
ORACLE_SQL["exported_rows"] = f"SELECT domain, condition, CASE WHEN condition = 'control' THEN 'none' ELSE split_part(condition, '_', 1) END AS relevance, 'test' AS split, count(*) AS n, count(CASE WHEN condition <> 'control' THEN 1 END) AS n_anchored, count(CASE WHEN condition <> 'control' THEN 1 END) AS n_polarity FROM {_GRID} g GROUP BY domain, condition"
ORACLE_SQL["streamed_metrics"] = ORACLE_SQL["unified_metrics"]
ORACLE_SQL["interval_means"] = _with(
    "SELECT suite, model, 'mean' AS of, count(uai) AS n, round(avg(uai), 6) AS value FROM lg WHERE uai IS NOT NULL GROUP BY suite, model UNION ALL SELECT suite, model, 'r', count(*), round(corr(answer, anchor), 6) FROM lg GROUP BY suite, model", _LONG)
ORACLE_SQL["pull_by_sql_text"] = _with(
    "SELECT suite, model, count(uai) AS n, round(avg(uai), 6) AS uai, round(avg(CASE WHEN (answer - control) * (anchor - control) > 0 THEN 1.0 ELSE 0.0 END), 6) AS tar, round(max(CASE WHEN uai >= 1 THEN NULL WHEN uai <= 0 THEN 0.0 ELSE uai * 5 / (1 - uai) END), 6) AS weight, count(CASE WHEN abs(answer - gold) > abs(control - gold) THEN 1 END) AS n_harmful FROM lg GROUP BY suite, model", _LONG)
ORACLE_SQL["anchor_gold_by_sql_text"] = f"WITH {_EVID}, z AS (SELECT item, v[1:5] AS f FROM vis) SELECT item, CASE WHEN len(f) > 0 THEN CAST(round_even(list_avg(f), 0) AS INTEGER) ELSE 0 END AS gold_mean, CASE WHEN len(f) > 0 THEN CAST(round_even(list_median(f), 0) AS INTEGER) ELSE 0 END AS gold_median, CASE WHEN len(f) > 0 THEN CAST(round_even(list_sum(list_transform(f, lambda x, i: x * CAST({_weights()}[i] AS DOUBLE))) / list_sum(list_transform({_weights()}[1:len(f)], lambda x: CAST(x AS DOUBLE))), 0) AS INTEGER) ELSE 0 END AS gold_weighted FROM z"
