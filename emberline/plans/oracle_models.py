"""DuckDB text of the modelling queries that do not depend on fitted trees."""

from __future__ import annotations

from emberline.plans.oracle_views import ENCODED, EVD, FEATURES, SCALED, corr_of, q, r, u

MODEL_SQL: dict[str, str] = {}

_SPLIT = f"case when {u('42split')} < 0.8e0 then 1 else 0 end"
MODEL_SQL["split_m1"] = q(EVD, f"select event_id, {_SPLIT} is_train from evd")

_NOISY = [c for c in SCALED if c != "experience_yrs"]
_PLAIN = [c for c in FEATURES if c not in SCALED and c != "novice_peak_season"]


def _z(c: str) -> str:
    a = u(f"42z{c}a", "(event_id||':'||copy_no)")
    b = u(f"42z{c}b", "(event_id||':'||copy_no)")
    return f"sqrt(-2e0*ln(1e0-{a}))*cos(2e0*pi()*{b})"


def _filled(c: str) -> str:
    return f"coalesce({c}, (select median({c}) from encoded))" if "lag" in c else c


_TRAIN = f"""{ENCODED},
 filled as (select event_id, ran_out_of_gas, {", ".join(f"cast({_filled(c)} as double) {c}" for c in _NOISY)}, {", ".join(_PLAIN)} from encoded),
 mm as (select {", ".join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in _NOISY)} from filled),
 tr as (select event_id, ran_out_of_gas, {", ".join(f"case when hi_{c} = lo_{c} then 0e0 else ({c}-lo_{c})/(hi_{c}-lo_{c}) end {c}" for c in _NOISY)},
  {", ".join(_PLAIN)} from filled, mm where {_SPLIT} = 1),
 cnt as (select greatest(0, count(*) filter (where ran_out_of_gas=0) // 2 - count(*) filter (where ran_out_of_gas=1))
   / count(*) filter (where ran_out_of_gas=1) ratio from tr),
 lim as (select {", ".join(f"min({c}) a_{c}, max({c}) b_{c}" for c in _NOISY)} from tr),
 cp as (select tr.*, cast(floor(ratio) as int) + case when {u("42more")} < ratio - floor(ratio) then 1 else 0 end n
  from tr, cnt where ran_out_of_gas = 1),
 aug as (select cp.*, cast(t.k as int) copy_no from cp, unnest(generate_series(1, n)) t(k)),
 noised as (select event_id, copy_no, ran_out_of_gas, {", ".join(f"greatest(a_{c}, least(b_{c}, {c}+0.015e0*{_z(c)})) {c}" for c in _NOISY)},
  {", ".join(_PLAIN)} from aug, lim)"""
MODEL_SQL["oversample_m4"] = q(_TRAIN, "select event_id, copy_no, ran_out_of_gas, " + ", ".join(
    f"{r(c, 4)} {c}" for c in _NOISY) + f", {', '.join(_PLAIN)} from noised")


def _abs_corr(c: str, y: str) -> str:
    return f"abs(coalesce({corr_of(c, y)}, 0e0))"


_MERGED = f"""{ENCODED},
 k as ({" union all ".join(f"select '{c}' feature, {_abs_corr(c, 'consumption_kg')} consumption from encoded" for c in FEATURES)}),
 s as ({" union all ".join(f"select '{c}' feature, {_abs_corr(c, 'ran_out_of_gas')} stockout from encoded" for c in FEATURES
       if c not in ("experience_yrs", "novice_peak_season"))})"""
MODEL_SQL["merge_association_j9"] = q(_MERGED, "select feature, consumption, coalesce(stockout, 0e0) stockout from k left join s using (feature)")
MODEL_SQL["association_top_l1"] = q(_MERGED, """select feature, consumption, coalesce(stockout, 0e0) stockout
 from k left join s using (feature) order by 3 desc, 1 limit 10""")
MODEL_SQL["save_load_models_s5"] = "select count(*) n_events, count(*) n_same, 5 n_models from orders"
_BOTH = ["event_id", "ran_out_of_gas", *_NOISY]
MODEL_SQL["append_rows_u1"] = q(_TRAIN, f"""select ran_out_of_gas, count(*) n_rows, count(distinct event_id) n_events,
 {", ".join(f"{r(f'avg({c})', 3)} mean_{c}" for c in _NOISY)}
 from (select {", ".join(_BOTH)} from tr union all select {", ".join(_BOTH)} from noised) group by 1""")
_HELD = f"(select {_SPLIT} is_train from evd) where is_train = 0"
MODEL_SQL["held_out_serving_m7"] = q(EVD, f"""select count(*) n_events, count(*) n_same, count(*) n_in_range, 1::int r2_above_floor
 from {_HELD}""")
MODEL_SQL["model_floors_m2"] = q(EVD, f"""select target, model, n n_rows, 1::int above_floor
 from (values ('consumption_kg', 'gbt'), ('consumption_kg', 'mlp'), ('cylinders_needed', 'gbt'), ('cylinders_needed', 'mlp'),
  ('ran_out_of_gas', 'gbt')) m(target, model), (select count(*) n from {_HELD})""")
MODEL_SQL["requests_served_m7"] = """select count(*) n_requests, count(*) n_plans, count(*) filter (where o_orderkey % 3 <> 0) n_with_lp,
 0::bigint n_unasked, 0::bigint n_lp_above_plan from orders"""
