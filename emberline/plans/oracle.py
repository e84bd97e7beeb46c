"""DuckDB text for every query that SQL can state, by query name."""

from __future__ import annotations

from emberline.plans.oracle_views import (
    CAL, CURVE, EFF, ENC, ENCODED, ETYPE, EV, EVD, EVX, FEAT, FEATURES, GBP, HOT, MENU, PL, PR, PRED,
    PROFILES, RATE, RC, REF_PRICES, REQUESTS, RISK, RULE, SCALED, SHIFT, TARGETS, TIER, TIER_NAME,
    V1, WSP, corr_of, draw, favg, fsum, gas_rate, menu_class, q, r, series, u,
)
from emberline.plans.oracle_models import MODEL_SQL

SQL: dict[str, str] = {}

# ---- sources and sinks -----------------------------------------------------
SQL["read_table_csv_s1"] = q(PR, f"""select strftime("date", '%d-%b-%y') date_str,
 {r("commercial_price_inr/2", 2)} domestic_price_inr, commercial_price_inr from pr""")
SQL["parse_date_lenient_s2"] = """select o_orderkey, strftime(o_orderdate, '%d-%b-%y') date_str,
 cast(o_orderdate as date) "date" from orders where o_orderkey % 10 <> 0"""
SQL["write_stage_s3"] = q(EVX, """select "year", count(*) n_events, cast(sum(cylinders_needed) as bigint) cylinders
 from evx group by 1""")
SQL["column_ranges_s4"] = q(EVX, " union all ".join(
    f"select '{c}' column_name, count({c}) n_values, cast(min({c}) as double) min_value, "
    f"cast(max({c}) as double) max_value from evx"
    for c in [*TARGETS, "price_lag1_inr", "price_lag2_inr", "headcount"]))
SQL["column_statistics_s4"] = SQL["column_ranges_s4"]
SQL["write_metadata_s4"] = q(FEAT, " union all ".join(
    f"select '{p}' part, '{c}' column_name, cast(min({c}) as double) min_value, cast(max({c}) as double) max_value from feat"
    for p, cols in (("features", SCALED), ("targets", TARGETS)) for c in cols))
SQL["ingest_requests_s6"] = q(EV, """
select event_id, case when event_id % 2 = 0 then 50000e0 end budget_inr, 0 "position", 'CAT'||caterer_id caterer_id,
 'Murugan Catering' caterer_name, case when event_id % 3 <> 0 then experience_yrs else 8 end experience_yrs, 8 num_burners,
 'medium' business_size, event_date, 'wedding' event_type, case when event_id % 3 <> 1 then headcount else 300 end headcount,
 6 num_dishes, 5e0 duration_hrs, case when event_id % 3 <> 2 then menu_profile else 'mixed_standard' end menu_profile,
 case when event_id % 3 = 0 then festival_flag else 0 end is_festival_season from ev
union all
select event_id, case when event_id % 2 = 0 then 50000e0 end, 1, 'CAT001', 'Murugan Catering', 8, 8, 'medium',
 cast(event_date + 1 as date), 'wedding', 300, 6, 5e0, 'mixed_standard', 0 from ev""")

# ---- recipes and wastage ---------------------------------------------------
SQL["filter_recipes_p1"] = q(RC, "select recipe_id, cook_time_mins, servings from rcf")
SQL["gas_rate_t1"] = q(RC, f"select recipe_id, {gas_rate()} gas_rate from rcl")
SQL["gas_rate_other_words_t1"] = q(RC, f"""select recipe_id,
 {gas_rate(high=['sch', 'qu'], low=['ing', 'eau'], med=['ent', 'on'])} gas_rate from rcl""")
SQL["gas_per_serving_t2"] = q(RC, "select recipe_id, gas_per_serving_kg from rcp")
SQL["menu_profile_t3"] = q(RC, f"select recipe_id, {menu_class()} menu_profile from rcl")
SQL["menu_profile_other_words_t3"] = q(RC, f"""select recipe_id,
 {menu_class(nv=['th', 'au'], vg=['he', 'er'])} menu_profile from rcl""")
SQL["gas_by_profile_a2"] = q(f"{RC},{GBP}", "select * from gbp")
SQL["cook_time_by_profile_a3"] = q(RC, f"""select menu_profile,
 {r("sum(cook_time_mins)/count(*)", 1)} avg_cook_time_mins from rcp group by 1""")
SQL["commercial_rates_t4"] = q(f"{RC},{GBP},{MENU}", f"""select menu_profile,
 coalesce({r("gas_intensity_mean/3.5e0", 5)}, gas) gas_intensity_per_serving from menu left join gbp using (menu_profile)""")
SQL["menu_lookup_j3"] = q(f"{RC},{GBP},{MENU},{REQUESTS}", f"""
select event_id, {r(f"coalesce({r('gas_intensity_mean/3.5e0', 5)}, gas, 0.012e0)", 5)} gas_intensity_per_serving,
 coalesce(dishes, 5) typical_dishes, {r("coalesce(cook, 30e0)", 1)} avg_cook_time_mins
from req left join menu using (menu_profile) left join gbp using (menu_profile)
 left join (select menu_profile, {r("sum(cook_time_mins)/count(*)", 1)} cook from rcp group by 1) using (menu_profile)""")
SQL["remap_category_p3"] = q(WSP, "select l_orderkey, l_linenumber, event_type, cooking_intensity, season from wsp")
SQL["wastage_rate_p4"] = q(WSP, "select l_orderkey, l_linenumber, wastage_rate from wsp")
SQL["mean_rate_by_type_a1"] = q(WSP, "select * from wrate")
SQL["mean_rate_of_records_a1"] = SQL["mean_rate_by_type_a1"]
SQL["rate_lookup_j5"] = q(f"{WSP},{ETYPE},{REQUESTS}", """select event_id, event_type,
 coalesce(mean_wastage_rate, bench_rate, 0.09e0) wastage_rate
 from req left join wrate using (event_type) left join et using (event_type)""")

# ---- prices ----------------------------------------------------------------
_NS = f"{PR},{series('pr', '1995-01-01', '2001-12-01', 'ns')}"
SQL["grid_left_join_j1"] = q(_NS, 'select series, "date", v commercial_price_inr from ns_j')
SQL["interpolate_linear_w1"] = q(_NS, 'select series, "date", commercial_price_inr from ns')
SQL["lag_features_w2"] = q(_NS, 'select series, "date", price_lag1, price_lag2 from ns')
SQL["diff_feature_w3"] = q(_NS, 'select series, "date", price_mom_change from ns')
SQL["series_summary_a4"] = q(PR, """select count(*) n_rows, min(commercial_price_inr) min_price,
 max(commercial_price_inr) max_price, cast(min(year("date")) as int) first_year, cast(max(year("date")) as int) last_year from pr""")
SQL["price_lookup_j2"] = q(f"{EV},{REF_PRICES}", f"""
select event_id, yr22 "year", mon "month",
 case when p.series is null then 1500e0 else {r("p.commercial_price_inr", 2)} end commercial_price_inr,
 case when p.series is null then 1480e0 else {r("p.price_lag1", 2)} end price_lag1_inr,
 case when p.series is null then 1460e0 else {r("p.price_lag2", 2)} end price_lag2_inr,
 case when p.series is null then 20e0 else {r("p.price_mom_change", 2)} end price_mom_change_inr
from ev left join price p on p."year" = yr22 and p."month" = mon""")

# ---- joins -----------------------------------------------------------------
SQL["season_lookup_j4"] = q(f"{REQUESTS},{CAL}", """select event_id, mon "month", wedding_season, fest festival_flag,
 festival_name, demand_multiplier from req join cal on mon = month(event_date)""")
SQL["weather_lookup_j6"] = q(f"{REQUESTS},{CAL}", """select event_id, mon "month", temp_mean_c, precipitation_mm
 from req join cal on mon = month(event_date)""")
SQL["profile_join_j7"] = q(f"{PROFILES},{REQUESTS}", "select * from req join prof using (caterer_id)")
SQL["delivery_lead_j8"] = q(EV, "select event_id, region, lead_days from ev")
SQL["calendar_demand_join_j10"] = q(CURVE, 'select region, dealer, d "date", raw raw_demand from curve')

# ---- derivation ------------------------------------------------------------
SQL["derive_consumption_v1"] = q(EVD, "select event_id, consumption_kg from evd")
SQL["shock_factor_v2"] = q(EVD, "select event_id, shock_factor, covid_period from evd")
SQL["cylinders_needed_v3"] = q(EVD, "select event_id, cylinders_needed from evd")
SQL["wastage_kg_v4"] = q(EVX, "select event_id, wastage_rate, wastage_kg from evx")
SQL["first_label_v5"] = q(EVD, f"""select event_id, o ordered, case when o < cylinders_needed
  or (wedding_season=1 and {u("42s1")}<0.08e0) or (headcount>500 and experience_yrs<=3 and {u("42g1")}<0.15e0)
  then 1 else 0 end stockout
 from (select *, cast(greatest(1, floor(cylinders_needed*{draw(TIER, V1, u("42a1"))})) as int) o from evd)""")
SQL["derive_stockout_v6"] = q(EVD, "select event_id, cylinders_ordered, ran_out_of_gas from evd")
SQL["order_lead_days_v7"] = q(EVD, "select event_id, order_lead_days from evd")
SQL["event_table_v"] = q(EVX, "select * from evx")

# ---- cleaning and features -------------------------------------------------
SQL["clean_events_p2"] = q(EVX, """select event_id, consumption_kg from evx where headcount between 10 and 5000
 and consumption_kg between 0.5e0 and 500 and cylinders_needed between 1 and 29 and duration_hrs between 0.5e0 and 16
 and wastage_kg >= 0 and order_lead_days between 0 and 30""")
_NARROW = {
    "headcount": "headcount between 100 and 2000", "consumption_kg": "consumption_kg between 5e0 and 300e0",
    "cylinders_needed": "cylinders_needed between 1 and 15", "duration_hrs": "duration_hrs between 2.5e0 and 9.5e0",
    "wastage_kg": "wastage_kg >= 0.5e0", "order_lead_days": "order_lead_days between 1 and 9",
}
SQL["clean_report_p2"] = q(EVX, "select count(*) rows_in, count(*) filter (where "
    + " and ".join(_NARROW.values()) + ") rows_kept, "
    + ", ".join(f"count(*) filter (where not ({c})) bad_{n}" for n, c in _NARROW.items()) + " from evx")
SQL["select_features_p5"] = q(FEAT, f"""select * exclude (experience_tier_enc) from (
 select event_id, {", ".join(SCALED)}, wedding_season, festival_flag, is_monsoon, covid_period, month_sin, month_cos,
  heat_stress, price_surge_flag, novice_peak_season, {ENC}, {HOT} from feat)""")
SQL["coerce_numeric_p6"] = """select o_orderkey, case when o_orderkey % 5 = 0 then null else cast(o_custkey as double) end a,
 try_cast(o_orderpriority as double) b from orders"""
SQL["inverse_scale_clip_p7"] = f"""select o_orderkey event_id,
 {r(f"least(500e0, greatest(1.5e0, {r(u('42z', 'o_orderkey') + '*1.2e0-0.1e0', 4)}*498.5e0+1.5e0))", 2)} kg from orders"""
for _name, _cols in {
    "rate_features_f1": "kg_per_guest, kg_per_burner_hr", "size_features_f2": "log_headcount, event_scale, dish_load",
    "month_cycle_f3": "month_sin, month_cos", "season_intensity_f4": "season_intensity",
    "condition_flags_f5": "heat_stress, price_surge_flag, is_monsoon, novice_peak_season",
    "price_index_f6": "price_index", "experience_tier_f7": "experience_tier",
}.items():
    SQL[_name] = q(FEAT, f"select event_id, {_cols} from feat")
SQL["label_encode_e1"] = q(FEAT, f"select event_id, {ENC} from feat")
SQL["one_hot_e2"] = f"select event_id, {HOT} from (select o_orderkey event_id, " + """case o_orderkey % 8 when 0 then 'wedding'
 when 1 then 'corporate_lunch' when 2 then 'college_canteen' when 3 then 'birthday_party' when 4 then 'festival_event'
 when 5 then 'hospital_canteen' when 6 then 'school_canteen' else 'dhaba_daily' end event_type from orders)"""
SQL["median_e3"] = q(FEAT, " union all ".join(
    f"select '{c}' column_name, cast(median({c}) as double) median from feat" for c in [*SCALED, *TARGETS]))
SQL["impute_e3"] = q(EVX, """select event_id, coalesce(price_lag1_inr, (select median(price_lag1_inr) from evx)) price_lag1_inr,
 coalesce(price_lag2_inr, (select median(price_lag2_inr) from evx)) price_lag2_inr from evx""")
_MM = [*SCALED, *TARGETS]
SQL["min_max_scale_e4"] = q(f"""{FEAT},
 filled as (select event_id, {", ".join(f"coalesce(cast({c} as double), (select cast(median({c}) as double) from feat)) {c}" if "lag" in c else f"cast({c} as double) {c}" for c in _MM)} from feat),
 rng as (select {", ".join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in _MM)} from filled)""",
 "select event_id, " + ", ".join(
    r(f"coalesce(({c}-lo_{c})/nullif(hi_{c}-lo_{c}, 0e0), 0e0)", 6) + f" {c}" for c in _MM) + " from filled, rng")

# ---- quality -----------------------------------------------------------------
_CHECKS = [
    ("experience_yrs between 1 and 40", "experience_yrs out of range"),
    ("num_burners between 1 and 30", "num_burners out of range"),
    ("headcount between 10 and 5000", "headcount out of range"),
    ("num_dishes between 1 and 20", "num_dishes out of range"),
    ("duration_hrs between 0.5e0 and 16e0", "duration_hrs out of range"),
    ("business_size in ('small','medium','large')", "business_size unknown"),
    ("event_date is not null", "event_date missing"),
]
SQL["validate_requests_q1"] = f"""select event_id, case when reasons = '' then 1 else 0 end accepted, reasons from (
 select event_id, concat_ws('; ', {", ".join(f"case when {c} then null else '{m}' end" for c, m in _CHECKS)}) reasons from (
 select o_orderkey event_id, o_custkey % 45 experience_yrs, o_orderkey % 33 num_burners,
  case o_orderkey % 4 when 0 then 'small' when 1 then 'medium' when 2 then 'large' else 'huge' end business_size,
  floor(o_totalprice/80) headcount, o_orderkey % 23 num_dishes, (o_orderkey % 171)/10e0 duration_hrs,
  case when o_orderkey % 50 <> 0 then o_orderdate end event_date from orders))"""
_NORM_COLS = [*_MM, "year", "month", "day", "wedding_season", "festival_flag", "is_monsoon", "covid_period",
              "heat_stress", "price_surge_flag", "novice_peak_season", "ran_out_of_gas", "month_sin", "month_cos",
              "cylinders_ordered", "wastage_rate"]
SQL["dataset_checks_q2"] = q(f"""{FEAT},
 enc as (select {", ".join(f"coalesce({c}, (select median({c}) from feat)) {c}" if "lag" in c else c for c in _NORM_COLS)}, {ENC}, {HOT} from feat)""",
 """select count(*) n_rows, 0::bigint n_nulls, 0e0 min_scaled, 1e0 max_scaled,
 cast(count(*) - (select count(*) from (select distinct * from enc)) as bigint) n_duplicates,
 case when count(*) = (select count(*) from (select distinct * from enc)) then 1 else 0 end passed from enc""")
SQL["duplicate_rows_q2"] = """select l_orderkey, l_linenumber, l_returnflag, count(*) n_copies from lineitem
 group by 1,2,3 having count(*) > 1"""
SQL["correlations_a18"] = q(ENCODED, " union all ".join(
    f"select '{y}' target, '{c}' feature, {corr_of(c, y)} correlation from encoded"
    for y in ("consumption_kg", "ran_out_of_gas") for c in FEATURES))
SQL["leakage_audit_q3"] = q(f"""{ENCODED}, c as ({" union all ".join(
    f"select '{c}' feature, {corr_of(c, 'consumption_kg')} correlation from encoded" for c in FEATURES)})""",
 """select feature, correlation, abs(correlation) abs_correlation,
 case when feature in ('kg_per_guest','kg_per_burner_hr') then 'derived_from_target'
  when feature in ('experience_yrs','novice_peak_season') then 'label_input' else 'independent' end lineage,
 case when feature in ('kg_per_guest','kg_per_burner_hr') then 0 else 1 end in_leak_free_set from c""")
SQL["vocabulary_encode_e1"] = """select o_orderkey event_id,
 cast(dense_rank() over (order by cast(o_orderdate as date)::varchar || ' ' || o_custkey::varchar) - 1 as int) visit_enc,
 cast(dense_rank() over (order by o_orderpriority) - 1 as int) priority_enc from orders"""

# ---- reports -------------------------------------------------------------------
SQL["dataset_summary_a5"] = q(EVX, f"""select count(*) n_events, {r(fsum("consumption_kg", 2) + "/count(*)", 1)} avg_consumption_kg,
 max(consumption_kg) max_consumption_kg, {r("sum(cylinders_needed)/count(*)", 1)} avg_cylinders_needed,
 {r("sum(ran_out_of_gas)/count(*)*100e0", 1)} stockout_rate_pct, min(commercial_price_inr) min_price_inr,
 max(commercial_price_inr) max_price_inr, count(*) filter (where wedding_season=1) wedding_season_events,
 count(*) filter (where covid_period=1) covid_period_events from evx""")
SQL["share_of_a6"] = q(EVX, f"""select event_type, count(*) n, {r("count(*)/(select count(*) from evx)*100e0", 1)} share_pct
 from evx group by 1""")
SQL["monthly_mean_a7"] = q(EVX, f"""select "month", {r(fsum("consumption_kg", 2) + "/count(*)", 1)} avg_consumption_kg from evx group by 1""")
SQL["type_profile_a8"] = q(EVX, f"""select event_type, count(*) n, {r(fsum("consumption_kg", 2) + "/count(*)", 1)} avg_consumption_kg,
 {r("count(*)/(select count(*) from evx)*100e0", 1)} share_pct from evx group by 1""")
SQL["benchmark_check_a9"] = q(EVX, f"""select *, case when avg_kg_per_guest between 0.08e0 and 0.15e0 then 1 else 0 end in_band from (
 select event_type, count(*) n_events, {r(fsum("k", 4) + "/count(*)", 4)} avg_kg_per_guest,
  count(*) filter (where not k between 0.08e0 and 0.15e0) n_out_of_band
 from (select event_type, {r("consumption_kg/headcount", 4)} k from evx) group by 1)""")
SQL["stockout_rate_a10"] = q(EVD, f"""select count(*) n_events, cast(sum(ran_out_of_gas) as bigint) stockout_events,
 {r("sum(ran_out_of_gas)/count(*)*100e0", 1)} stockout_rate_pct,
 case when sum(ran_out_of_gas)/count(*)*100e0 > 40 then 1 else 0 end rate_warning from evd""")
SQL["top_k_l2"] = q(EVD, """select event_id, caterer_id, consumption_kg from evd
 order by consumption_kg desc, event_id limit 10""")
SQL["first_n_l3"] = q(CURVE, """select region, dealer, d "date", raw raw_demand from curve order by d, dealer limit 30""")

# ---- metrics ---------------------------------------------------------------------
_CM = """cm as (select count(*) filter (where label=0 and prediction=0) tn, count(*) filter (where label=0 and prediction=1) fp,
 count(*) filter (where label=1 and prediction=0) fn, count(*) filter (where label=1 and prediction=1) tp from pred)"""
SQL["confusion_matrix_a14"] = q(f"{PRED},{_CM}", "select * from cm")
SQL["classification_report_a15"] = q(f"""{PRED},{_CM},
 pr2 as (select 0 k, 'ok' row_name, tn/nullif(tn+fn,0) p, tn/nullif(tn+fp,0) rc, tn+fp s from cm
  union all select 1, 'stockout', tp/nullif(tp+fp,0), tp/nullif(tp+fn,0), tp+fn from cm),
 pc as (select k, row_name, coalesce(p,0e0) p, coalesce(rc,0e0) rc, coalesce(2e0*p*rc/nullif(p+rc,0e0),0e0) f, s from pr2),
 w as (select max(case when k=0 then p end) p0, max(case when k=1 then p end) p1, max(case when k=0 then rc end) r0,
  max(case when k=1 then rc end) r1, max(case when k=0 then f end) f0, max(case when k=1 then f end) f1,
  cast(max(case when k=0 then s end) as double) s0, cast(max(case when k=1 then s end) as double) s1 from pc)""",
 f"""select row_name, {r("p", 4)} "precision", {r("rc", 4)} recall, {r("f", 4)} f1, s support from pc
 union all select 'accuracy', {r("(tn+tp)/(tn+fp+fn+tp)", 4)}, {r("(tn+tp)/(tn+fp+fn+tp)", 4)}, {r("(tn+tp)/(tn+fp+fn+tp)", 4)}, tn+fp+fn+tp from cm
 union all select 'macro avg', {r("(p0+p1)/2e0", 4)}, {r("(r0+r1)/2e0", 4)}, {r("(f0+f1)/2e0", 4)}, cast(s0+s1 as bigint) from w
 union all select 'weighted avg', {r("(p0*s0+p1*s1)/(s0+s1)", 4)}, {r("(r0*s0+r1*s1)/(s0+s1)", 4)}, {r("(f0*s0+f1*s1)/(s0+s1)", 4)}, cast(s0+s1 as bigint) from w""")
SQL["roc_auc_a16"] = q(f"""{PRED},
 sc as (select score, sum(label) pos, sum(1-label) neg from pred group by 1),
 cu as (select *, sum(neg) over (order by score rows between unbounded preceding and current row) - neg before from sc)""",
 f"""select cast(sum(pos) as bigint) n_pos, cast(sum(neg) as bigint) n_neg,
 {r("cast(sum(pos*(2*before+neg)) as double)/2e0/(cast(sum(pos) as double)*cast(sum(neg) as double))", 6)} auc from cu""")
SQL["regression_metrics_a17"] = q(PRED, f"""select count(*) n_rows,
 {r("1e0-sum((actual-predicted)*(actual-predicted))/(var_pop(actual)*count(*))", 6)} r2, {r("avg(abs(actual-predicted))", 6)} mae from pred
 where actual is not null and predicted is not null""")

# ---- planning ----------------------------------------------------------------------


def _plan(source: str, kg: str, notes: str) -> str:
    """CTEs that end in ``plan``: the thirteen plan columns from a final kg."""
    return f"""
p1 as (select *, {RULE} rule_kg from {source}),
p2 as (select *, {kg} kg from p1),
p3 as (select *, greatest(1, cast(ceil(kg*(1e0+(case when experience_yrs<3 then 0.20e0 when experience_yrs<6 then 0.15e0 else 0.10e0 end))/17.5e0) as int)) cyl,
  {RATE} rate from p2),
p4 as (select *, {RISK} risk, {r("kg*rate", 2)} waste, cast(cyl*1910 as double) cost from p3),
p5 as (select *, {EFF} eff from p4),
plan as (select event_id, caterer_id, event_date, kg predicted_consumption_kg, cyl cylinders_to_order,
  cast(event_date - cast(lead_days+1+(case when risk>50 then 3 when risk>25 then 1 else 0 end)+(case when experience_yrs<3 then 2 else 0 end) as int) as date) recommended_order_date,
  cast(event_date - cast(lead_days+1 as int) as date) latest_safe_order_date, risk stockout_risk_pct, waste wastage_estimate_kg,
  cost estimated_cost_inr, eff efficiency_score, {TIER_NAME} recommendation_tier, {_actions()} action_items,
  {notes} optimization_notes from p5)"""


def _actions() -> str:
    return """coalesce(nullif(concat_ws(' | ',
   case when risk > 50 then 'Order ' || (cyl+1) || ' cylinders (add 1 safety buffer — high risk event)' end,
   case when experience_yrs < 3 then 'Consider ordering 2–3 days earlier — novice buffer recommended' end,
   case when rate > 0.10e0 then 'Wastage high for ' || event_type || ' events — track actual usage post-event' end,
   case when festival_flag = 1 then 'Festival season: dealer supply pressure likely — order at least 5 days early' end,
   case when headcount > 500 and experience_yrs < 5 then 'Large event for inexperienced caterer — add 20% buffer to cylinder order' end),
  ''), 'Procurement on track — follow recommended order date')"""


def _f1(x: str) -> str:
    return f"printf('%.1f', {r(x, 1)})"


_RULE_NOTE = f"'Rule-based: ' || {_f1('rule_kg')} || 'kg | Final: ' || {_f1('kg')} || 'kg'"
_BLEND_NOTE = (f"'Rule-based: ' || {_f1('rule_kg')} || 'kg | ML prediction: ' || {_f1('ml')} || 'kg | Blended: ' || {_f1('kg')} || 'kg'")
_PLAN = f"{EV},{MENU},{ETYPE}, src as (select * from ev join menu using (menu_profile) join et using (event_type))," + _plan(
    "src", "rule_kg", _RULE_NOTE)
_BLENDED = f"""{EVX}, src as (select evx.*, per100, planner_rate, case when event_id % 4 <> 0 then consumption_kg end ml
  from evx join menu using (menu_profile) join et using (event_type)),""" + _plan(
    "src", f"case when ml > 0 then {r('ml*0.7e0+rule_kg*0.3e0', 2)} else rule_kg end",
    f"case when ml is not null and ml <> 0 then {_BLEND_NOTE} else {_RULE_NOTE} end")
SQL["plan_events_o11"] = q(_PLAN, "select * from plan")
SQL["blended_plan_o11"] = q(_BLENDED, "select * from plan")
SQL["blend_o2"] = q(_BLENDED, "select event_id, predicted_consumption_kg blended_kg from plan")
for _name, _cols in {
    "rule_consumption_o1": "predicted_consumption_kg", "cylinders_with_buffer_o3": "cylinders_to_order",
    "wastage_and_cost_o6": "wastage_estimate_kg, estimated_cost_inr", "efficiency_o7": "efficiency_score",
    "tier_o8": "recommendation_tier", "notes_o10": "optimization_notes",
}.items():
    SQL[_name] = q(_PLAN, f"select event_id, {_cols} from plan")
SQL["action_items_o9"] = q(f"""{EVD},{ETYPE},
 s0 as (select *, consumption_kg kg, cylinders_ordered cyl, {RATE} rate from evd join et using (event_type)),
 s1 as (select *, {RISK} risk from s0), s2 as (select event_id, {_actions()} action_items from s1)""",
 "select event_id, cast(len(string_split(action_items, ' | ')) as int) n_items, action_items from s2")
SQL["stockout_risk_o4"] = q(PL, "select event_id, risk from pl")
SQL["order_dates_o5"] = q(PL, "select event_id, order_date recommended_order_date, latest_date latest_safe_order_date from pl")
_BATCH = f"""{EVD},
 bud as (select n_name dealer, case when n_nationkey % 5 <> 0 then cast(b as double) end budget_inr from nation left join
  (select c_nationkey, sum(cast(floor(c_acctbal) as bigint))*28 b from customer group by 1) on c_nationkey = n_nationkey),
 need as (select *, greatest(1, cast(ceil(consumption_kg/17.5e0) as int)) mn from evd),
 tot as (select dealer, count(*) n, sum(mn) cyl, {fsum("greatest(0e0, mn*17.5e0-consumption_kg)", 4)} excess from need group by 1),
 bt as (select bud.dealer, bud.budget_inr, coalesce(n,0) n, cyl, excess, case when n is null then 'no events'
  when budget_inr is null or budget_inr = 0 or cyl*1910 <= budget_inr then 'optimal' else 'fallback' end status
  from bud left join tot using (dealer))"""
SQL["batch_procurement_o12"] = q(_BATCH, """select event_id, dealer, event_date, consumption_kg,
 case when dealer in ('KENYA', 'PERU') then 'not listed' else bt.status end status,
 case when bt.status='optimal' and dealer not in ('KENYA', 'PERU') then mn end cylinders_lp, mn cylinders_rule,
 case when bt.status='optimal' and dealer not in ('KENYA', 'PERU') then 0e0 end lp_saving_pct from need join bt using (dealer)""")
SQL["batch_totals_o12"] = q(_BATCH, f"""select dealer, status, n n_events, budget_inr,
 cast(case when status='optimal' then cyl end as bigint) total_cylinders,
 cast(case when status='optimal' then cyl*1910 end as bigint) total_cost_inr,
 case when status='optimal' then {r("excess", 2)} end total_wastage_kg from bt""")
SQL["delivery_cap_o13"] = q(PL, """select event_id, cast(run as bigint) running_cylinders, cast(tot as bigint) day_cylinders,
 case when run <= 50 then 1 else 0 end within_cap, case when tot > 50 then 1 else 0 end day_over_cap
 from (select event_id, sum(cyl) over (partition by dealer, order_date order by risk desc, event_id
   rows between unbounded preceding and current row) run, sum(cyl) over (partition by dealer, order_date) tot from pl)""")
SQL["batch_summary_a11"] = q(PL, f"""select count(*) total_events, cast(sum(cyl) as bigint) total_cylinders,
 {fsum("cost", 0)} total_cost_inr, {r(fsum("risk", 1) + "/count(*)", 1)} avg_stockout_risk,
 count(*) filter (where tier='RED') high_risk_events from plt""")
SQL["batch_summary_by_dealer_a11"] = q(PL, f"""select dealer, count(*) total_events, cast(sum(cyl) as bigint) total_cylinders,
 {fsum("cost", 0)} total_cost_inr, {r(fsum("risk", 1) + "/count(*)", 1)} avg_stockout_risk,
 count(*) filter (where tier='RED') high_risk_events from plt group by dealer""")
SQL["caterer_rollup_a19"] = q(PL, f"""select *, {r("total_wastage_kg/greatest(total_kg,1e0)*100e0", 2)} wastage_pct,
 case when avg_efficiency < 65 then 1 else 0 end inefficient from (
 select caterer_id, count(*) n_events, {r(fsum("kg", 2), 2)} total_kg, {r(fsum("waste", 2), 2)} total_wastage_kg,
  {r(fsum("eff", 1) + "/count(*)", 1)} avg_efficiency from pl group by 1)""")

# ---- regional ------------------------------------------------------------------------
SQL["demand_curve_r1"] = q(CURVE, """select region, dealer, d "date", raw raw_demand,
 case when isodow(d) >= 6 then 1 else 0 end is_weekend from curve""")
SQL["rolling_mean_w4"] = q(CURVE, 'select region, dealer, d "date", smooth smoothed_demand from curve2')
SQL["capacity_pressure_r2"] = q(CURVE, """select region, dealer, d "date", smooth smoothed_demand, pressure capacity_pressure,
 case when spike then 1 else 0 end spike_flag from curve2""")
SQL["shift_rank_w5"] = q(SHIFT, """select event_id, rk shift_rank, n day_plans, case when rk <= n // 2 then 1 else 0 end is_candidate from ranked""")
SQL["shift_plan_r3"] = q(SHIFT, """select event_id, original_order_date, order_date recommended_order_date,
 cast(shifted_days as int) shifted_days from shifted""")
SQL["shift_plan_strict_guard_r3"] = q(PL, "select event_id, order_date recommended_order_date, 0 shifted_days from pl")
SQL["smoothed_curve_r4"] = q(SHIFT, """select region, dealer, d "date", raw raw_demand, after_shift smoothed_orders,
 reduction peak_reduction_pct from curve3""")
_SUM = f"""
 tt as (select region, dealer, count(*) np, sum(cyl) cy, {fsum("cost", 0)} co, {fsum("risk", 1)} ri, {fsum("waste", 2)} wa,
  count(*) filter (where tier='RED') red, count(*) filter (where risk>50) so from plt group by 1,2),
 dd as (select region, dealer, max(raw) pk, {r("sum(raw)/count(*)", 1)} av, count(*) filter (where spike) sp from curve2 group by 1,2),
 summ as (select region, dealer, np total_caterers, cast(cy as bigint) total_cylinders_30d, co total_revenue_inr,
  {r("ri/np", 1)} avg_stockout_risk_pct, pk peak_demand_cylinders, av avg_daily_demand, 200 dealer_capacity, sp spike_days_count,
  red high_risk_caterers, {r("av/200*100e0", 1)} capacity_utilization_pct from tt join dd using (region, dealer))"""
_CHG = f"""
 pk2 as (select region, dealer, max(raw) pb, max(after_shift) pa from curve3 group by 1,2),
 chg as (select region, dealer, np total_events, so before_stockout_events, {r("wa*1.4e0", 1)} before_wastage_kg,
  {r("co*1.08e0", 2)} before_cost_inr, pb peak_before, {r("ri/np", 1)} after_avg_risk_pct, {r("wa", 1)} after_wastage_kg,
  co after_cost_inr, pa peak_after, {r("(wa*1.4e0-wa)/greatest(wa*1.4e0,1e0)*100e0", 1)} wastage_reduction_pct,
  {r("co*1.08e0-co", 2)} cost_saving_inr, {r("(pb-pa)/greatest(pb,1)*100e0", 1)} peak_demand_reduction_pct
  from tt join pk2 using (region, dealer))"""
SQL["regional_summary_a12"] = q(f"{CURVE},{_SUM}", "select * from summ")
SQL["before_after_a13"] = q(f"{SHIFT},{_SUM},{_CHG}", "select * from chg")
SQL["regional_forecast_r5"] = q(f"{SHIFT},{_SUM},{_CHG}", "select * from summ join chg using (region, dealer)")

SQL.update(MODEL_SQL)
