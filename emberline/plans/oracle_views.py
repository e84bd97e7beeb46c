"""The views of ``views.py`` written a second time, as DuckDB SQL.

These texts are the independent side of the comparison: they share no code
with the Spark operators, only the meaning and the fixed values.
"""

from __future__ import annotations

from emberline import fixed_values as fv


def u(salt: str, key: str = "event_id") -> str:
    """Hash uniform of (salt, key)."""
    return f"((('0x'||substr(md5('{salt}:'||{key}),1,8))::UBIGINT)/4294967296.0::double)"


def r(x: str, k: int) -> str:
    """Round half up to k places."""
    p = 10**k
    return f"(floor(({x})*{p}e0+0.5e0)/{p}e0)"


def fsum(x: str, k: int) -> str:
    """Fixed-point sum of a column with k decimals."""
    p = 10**k
    return f"(cast(sum(cast(floor(({x})*{p}e0+0.5e0) as bigint)) as double)/{p}e0)"


def favg(x: str, k: int) -> str:
    return f"({fsum(x, k)}/nullif(count({x}),0))"


PROFILES = """
prof as (
 select c_custkey caterer_id, cast(1 + c_custkey % 25 as int) experience_yrs,
  cast(2 + c_custkey % 18 as int) num_burners,
  case when c_acctbal < 3000 then 'small' when c_acctbal < 8000 then 'medium' else 'large' end business_size,
  n_name dealer, r_name region
 from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""

REQUESTS = """
req as (
 select o_orderkey event_id, o_custkey caterer_id, cast(o_orderdate as date) event_date,
  case o_orderkey % 8 when 0 then 'wedding' when 1 then 'corporate_lunch' when 2 then 'college_canteen'
   when 3 then 'birthday_party' when 4 then 'festival_event' when 5 then 'hospital_canteen'
   when 6 then 'school_canteen' else 'dhaba_daily' end event_type,
  case (o_orderkey + o_custkey) % 7 when 0 then 'veg_simple' when 1 then 'veg_elaborate'
   when 2 then 'nonveg_simple' when 3 then 'nonveg_elaborate' when 4 then 'mixed_standard'
   when 5 then 'snacks_only' else 'biryani_special' end menu_profile,
  cast(10 + floor(o_totalprice / 200) as int) headcount,
  2 + (o_orderkey % 81) / cast(10 as double) duration_hrs,
  cast(greatest(2, coalesce(n, 0) + 1) as int) num_dishes
 from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey)"""

EV = f"""{PROFILES},{REQUESTS},
ev as (
 select req.*, prof.* exclude (caterer_id), cast(year(event_date) + 22 as int) yr22, cast(month(event_date) as int) mon,
  cast(day(event_date) as int) dom,
  case when month(event_date) in (1,4,8,10,11,12) then 1 else 0 end festival_flag,
  case region when 'AFRICA' then 1 when 'AMERICA' then 2 when 'ASIA' then 2 when 'EUROPE' then 2 else 3 end lead_days
 from req join prof using (caterer_id))"""

def _values(rows) -> str:
    """Rows of fixed values as the body of a VALUES list."""

    def cell(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    return ",".join(f"({','.join(map(cell, row))})" for row in rows)


CAL = f"""
cal(mon, wedding_season, fest, festival_name, demand_multiplier, temp_mean_c, precipitation_mm) as (values
 {_values(fv.CALENDAR)})"""

MENU = f"""
menu(menu_profile, gas, dishes, per100) as (values
 {_values((m, fv.GAS_PER_SERVING[m], fv.DISHES_PER_MENU[m], fv.GAS_PER_100_GUESTS[m]) for m in fv.MENU_PROFILES)})"""

ETYPE = f"""
et(event_type, planner_rate, bench_rate) as (values
 {_values((t, fv.PLANNER_WASTAGE_RATE[t], fv.BENCHMARK_WASTAGE_RATE[t]) for t in fv.EVENT_TYPES)})"""


def _any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


HIGH, MED, LOW = fv.HIGH_HEAT_WORDS, fv.MEDIUM_HEAT_WORDS, fv.LOW_HEAT_WORDS


def gas_rate(ing="ing", crs="crs", high=HIGH, low=LOW, med=MED) -> str:
    return f"""case when {_any(ing, high)} then 0.35e0 when {_any(ing, low)} then 0.18e0
   when {_any(ing, med)} then 0.28e0 when {_any(crs, ['snack', 'appetizer'])} then 0.30e0
   when contains({crs}, 'dessert') then 0.22e0 when contains({crs}, 'breakfast') then 0.20e0 else 0.26e0 end"""


def menu_class(ing="ing", crs="crs", dt="dt", nv=None, vg=None) -> str:
    nv = nv or fv.NONVEG_ELABORATE_WORDS
    vg = vg or fv.VEG_ELABORATE_WORDS
    main = _any(crs, fv.MAIN_COURSE_MARKS)
    non = _any(dt, fv.NONVEG_DIET_MARKS)
    return f"""case when contains({ing},'biryani') or contains({crs},'biryani') then 'biryani_special'
   when {_any(crs, ['snack', 'appetizer'])} then 'snacks_only'
   when {non} and {main} then case when {_any(ing, nv)} then 'nonveg_elaborate' else 'nonveg_simple' end
   when {main} then case when {_any(ing, vg)} then 'veg_elaborate' else 'veg_simple' end
   else 'mixed_standard' end"""


RC = f"""
rc as (
 select doc_id recipe_id, text ingredients,
  case doc_id % 7 when 0 then 'Main Course' when 1 then 'Snack' when 2 then 'Dessert' when 3 then 'Breakfast'
   when 4 then 'Lunch' when 5 then 'Appetizer' end course,
  case lang when 'en' then 'Vegetarian' when 'de' then 'Non Vegeterian' when 'fr' then 'High Protein Non Vegetarian'
   else 'Eggetarian' end diet,
  cast(n_chars % 331 as int) cook_time_mins, cast(doc_id % 104 as int) servings
 from documents),
rcl as (select *, lower(coalesce(ingredients,'nan')) ing, lower(coalesce(course,'nan')) crs,
  lower(coalesce(diet,'nan')) dt from rc),
rcf as (select * from rcl where ingredients is not null and cook_time_mins > 0 and cook_time_mins <= 300
  and servings between 1 and 100),
rcp as (select *, {r("cook_time_mins/60e0*rate/servings", 5)} gas_per_serving_kg
 from (select *, {gas_rate()} rate, {menu_class()} menu_profile from rcf))"""

GBP = f"""gbp as (select menu_profile, {r(favg("gas_per_serving_kg", 5), 5)} gas_intensity_mean,
 {r("stddev_samp(gas_per_serving_kg)", 5)} gas_intensity_std, count(*) recipe_count from rcp group by 1)"""

WS = """
ws as (
 select l_orderkey, l_linenumber,
  case o_orderpriority when '1-URGENT' then 'Wedding' when '2-HIGH' then 'Corporate' when '3-MEDIUM' then 'Birthday'
   when '4-NOT SPECIFIED' then 'Social Gathering' end event_type_raw,
  l_quantity - 1 quantity_of_food, l_quantity*l_discount wastage_amount,
  case l_linenumber % 4 when 0 then 'Buffet' when 1 then 'Sit-down Dinner' when 2 then 'Finger Food' end preparation,
  case when month(l_shipdate) in (11,12,1,2) then 'Winter' when month(l_shipdate) in (4,5,6) then 'Summer'
   when month(l_shipdate)=9 then 'All Seasons' end seasonality
 from lineitem join orders on o_orderkey = l_orderkey)"""

WSP = f"""{WS},
wsp as (
 select *, case event_type_raw when 'Wedding' then 'wedding' when 'Corporate' then 'corporate_lunch'
   when 'Birthday' then 'birthday_party' else 'festival_event' end event_type,
  {r("wastage_amount / greatest(quantity_of_food, 1e0)", 4)} wastage_rate,
  case preparation when 'Buffet' then 'high' when 'Finger Food' then 'low' else 'medium' end cooking_intensity,
  case seasonality when 'Winter' then 'winter' when 'Summer' then 'summer' else 'all' end season
 from ws),
wrate as (select event_type, {r(favg("wastage_rate", 4), 8)} mean_wastage_rate, count(*) n_records
 from wsp group by 1)"""

PR = f"""
pr as (
 select n_name series, half "date", commercial_price_inr
 from (select c_nationkey, make_date(year(o_orderdate), case when month(o_orderdate) < 7 then 1 else 7 end, 1) half,
   {r(fsum("o_totalprice", 2) + "/count(*)", 2)} commercial_price_inr
  from orders join customer on c_custkey = o_custkey group by 1, 2)
 join nation on n_nationkey = c_nationkey)"""


def series(anchors: str, start: str, end: str, name: str) -> str:
    """Monthly series with interpolation, lags and change over ``anchors``."""
    return f"""
{name}_grid as (
 select a.series, cast(m as date) "date", row_number() over (partition by a.series order by m) pos
 from (select distinct series from {anchors}) a, unnest(generate_series(timestamp '{start}', timestamp '{end}', interval 1 month)) t(m)),
{name}_j as (select g.series, g."date", g.pos, x.commercial_price_inr v from {name}_grid g
 left join {anchors} x on x.series = g.series and x."date" = g."date"),
{name}_e as (select *,
  last_value(v ignore nulls) over b v0, last_value(case when v is not null then pos end ignore nulls) over b p0,
  first_value(v ignore nulls) over f v1, first_value(case when v is not null then pos end ignore nulls) over f p1
 from {name}_j window b as (partition by series order by "date" rows between unbounded preceding and current row),
  f as (partition by series order by "date" rows between current row and unbounded following)),
{name}_i as (select series, "date", case when v is not null then v when v0 is null then v1 when v1 is null then v0
  else v0 + (v1 - v0) * (pos - p0) / (p1 - p0) end commercial_price_inr from {name}_e),
{name} as (select series, "date", commercial_price_inr, cast(year("date") as int) "year", cast(month("date") as int) "month",
  lag(commercial_price_inr,1) over w price_lag1, lag(commercial_price_inr,2) over w price_lag2,
  coalesce(commercial_price_inr - lag(commercial_price_inr,1) over w, 0e0) price_mom_change
 from {name}_i window w as (partition by series order by "date"))"""


REF_PRICES = f"""
anch(series, "date", commercial_price_inr) as (values
 ('commercial', date '2018-04-01', 1176.5e0), ('commercial', date '2019-04-01', 1305.5e0),
 ('commercial', date '2020-04-01', 1285.5e0), ('commercial', date '2021-04-01', 1641e0),
 ('commercial', date '2022-04-01', 2253e0), ('commercial', date '2023-04-01', 2028e0)),
{series("anch", "2018-04-01", "2024-03-01", "price")}"""

SHOCK = """case when pm between 2020*12+3 and 2020*12+8 then 0.35e0 when pm between 2020*12+9 and 2020*12+12 then 0.60e0
  when pm between 2021*12+1 and 2021*12+6 then 0.70e0 else 1e0 end"""


def draw(tier: str, ranges: list[tuple[float, float]], uni: str) -> str:
    parts = " ".join(
        f"when {i} then {lo}e0+{round(hi - lo, 10)}e0*{uni}" for i, (lo, hi) in enumerate(ranges)
    )
    return f"(case {tier} {parts} end)"


TIER = "(case when experience_yrs>10 then 3 when experience_yrs>5 then 2 when experience_yrs>2 then 1 else 0 end)"
LEAD_TIER = "(case when experience_yrs<5 then 0 when experience_yrs<10 then 1 when experience_yrs<15 then 2 else 3 end)"
V2, V1 = fv.TRAINING_LABEL_ACCURACY, fv.FIRST_LABEL_ACCURACY
LEADS = [(1.0, 4.0), (2.0, 6.0), (4.0, 10.0), (5.0, 12.0)]

_KG = r(
    "least(500e0, greatest(1.5e0, headcount*num_dishes*gas*(1e0+least(0.40e0,greatest(-0.15e0,(duration_hrs-4e0)*0.05e0)))"
    "*(1e0+(num_burners-4)*0.02e0)*demand_multiplier*shock_factor*(0.88e0+0.26e0*" + u("42n") + ")))",
    2,
)

# the event table without cook times, wastage rates and prices
EVD = f"""{EV},{CAL},{MENU},{RC},{GBP},
evd as (
 select *, case when cylinders_ordered<cylinders_needed or (wedding_season=1 and order_lead_days<=1 and {u("42s")}<0.12e0)
  or (headcount>1000 and experience_yrs<=2 and {u("42g")}<0.10e0) then 1 else 0 end ran_out_of_gas
 from (select *, cast(greatest(1, floor(cylinders_needed*{draw(TIER, V2, u("42a"))})) as int) cylinders_ordered,
   cast(floor({draw(LEAD_TIER, LEADS, u("42l"))}) as int) order_lead_days
  from (select *, cast(ceil(consumption_kg/17.5e0) as int) cylinders_needed
   from (select *, {_KG} consumption_kg
    from (select *, {SHOCK} shock_factor, case when pm between 2020*12+3 and 2021*12+6 then 1 else 0 end covid_period
     from (select ev.*, yr22*12+mon pm, wedding_season, festival_name, demand_multiplier, temp_mean_c, precipitation_mm,
       {r(f"coalesce({r('gas_intensity_mean/3.5e0', 5)}, gas)", 5)} gas
      from ev join cal using (mon) join menu using (menu_profile) left join gbp using (menu_profile)))))))"""

EVX = f"""{EVD},{ETYPE},{WSP},{REF_PRICES},
ct as (select menu_profile, {r("sum(cook_time_mins)/count(*)", 1)} cook from rcp group by 1),
evx as (
 select event_id, caterer_id, event_date, yr22 "year", mon "month", dom "day", region, dealer, event_type, menu_profile,
  headcount, num_dishes, duration_hrs, num_burners, experience_yrs, business_size, wedding_season, festival_flag, festival_name,
  case when mon in (6,7,8,9) then 1 else 0 end is_monsoon, demand_multiplier, temp_mean_c, precipitation_mm,
  case when p.series is null then 1500e0 else {r("p.commercial_price_inr", 2)} end commercial_price_inr,
  case when p.series is null then 1480e0 else {r("p.price_lag1", 2)} end price_lag1_inr,
  case when p.series is null then 1460e0 else {r("p.price_lag2", 2)} end price_lag2_inr,
  case when p.series is null then 20e0 else {r("p.price_mom_change", 2)} end price_mom_change_inr,
  covid_period, gas gas_intensity_per_serving, {r("coalesce(cook, 30e0)", 1)} avg_cook_time_mins,
  consumption_kg, cylinders_needed, cylinders_ordered,
  {r(f"consumption_kg*coalesce(mean_wastage_rate, bench_rate, 0.09e0)*greatest(0.6e0, 1e0-experience_yrs*0.02e0)*(0.8e0+0.4e0*{u('42w')})", 3)} wastage_kg,
  {r("coalesce(mean_wastage_rate, bench_rate, 0.09e0)", 4)} wastage_rate, order_lead_days, ran_out_of_gas, lead_days
 from evd left join ct using (menu_profile) left join price p on p."year" = yr22 and p."month" = mon
  left join wrate using (event_type) left join et using (event_type))"""

FEAT = f"""{EVX},
feat as (
 select *, {r("consumption_kg/headcount", 4)} kg_per_guest, {r("consumption_kg/(num_burners*duration_hrs)", 4)} kg_per_burner_hr,
  {r("ln(1e0+headcount)", 4)} log_headcount, {r("sin(2e0*pi()*month/12e0)", 4)} month_sin, {r("cos(2e0*pi()*month/12e0)", 4)} month_cos,
  {r("wedding_season*0.4e0+festival_flag*0.3e0+(demand_multiplier-1e0)*0.3e0", 4)} season_intensity,
  case when temp_mean_c > 32 then 1 else 0 end heat_stress, {r("commercial_price_inr/1500e0", 4)} price_index,
  case when price_mom_change_inr > 100 then 1 else 0 end price_surge_flag,
  {r("num_dishes*gas_intensity_per_serving", 5)} dish_load, {r("headcount*duration_hrs/100e0", 3)} event_scale,
  case when experience_yrs <= 3 and wedding_season = 1 then 1 else 0 end novice_peak_season,
  case when experience_yrs <= 0 then null when experience_yrs <= 2 then 'novice' when experience_yrs <= 5 then 'intermediate'
   when experience_yrs <= 10 then 'experienced' when experience_yrs <= 30 then 'expert' end experience_tier
 from evx where headcount between 10 and 5000 and consumption_kg between 0.5e0 and 500 and cylinders_needed between 1 and 29
  and duration_hrs between 0.5e0 and 16 and wastage_kg >= 0 and order_lead_days between 0 and 30)"""

SCALED = [
    "headcount", "num_dishes", "duration_hrs", "num_burners", "experience_yrs", "demand_multiplier",
    "temp_mean_c", "precipitation_mm", "commercial_price_inr", "price_lag1_inr", "price_lag2_inr",
    "price_mom_change_inr", "gas_intensity_per_serving", "avg_cook_time_mins", "kg_per_guest",
    "kg_per_burner_hr", "log_headcount", "season_intensity", "price_index", "dish_load", "event_scale",
]
TARGETS = ["consumption_kg", "cylinders_needed", "wastage_kg", "order_lead_days"]

TYPES = fv.EVENT_TYPES
ENC = ", ".join(f"cast(dense_rank() over (order by {c}) - 1 as int) {c}_enc" for c in
                ["event_type", "menu_profile", "business_size", "festival_name", "experience_tier"])
HOT = ", ".join(f"case when event_type = '{t}' then 1 else 0 end etype_{t}" for t in TYPES)
FLAGS = ["wedding_season", "festival_flag", "is_monsoon", "covid_period", "month_sin", "month_cos", "heat_stress",
         "price_surge_flag", "novice_peak_season"]
CODES = ["event_type_enc", "menu_profile_enc", "business_size_enc", "festival_name_enc"]
# the 42 features: scaled, flags, codes, one column a type
FEATURES = [*SCALED, *FLAGS, *CODES, *[f"etype_{t}" for t in TYPES]]
ENCODED = f"{FEAT}, encoded as (select *, {ENC}, {HOT} from feat)"


def corr_of(c: str, y: str) -> str:
    return r(f"case when min({c}) = max({c}) then null else corr({y}, {c}) end", 6)


RISK = r(
    "least(99e0, greatest(0e0,(kg-cyl*17.5e0)/greatest(kg,1e0)*100e0)*(case when experience_yrs<3 then 1.5e0 "
    "when experience_yrs<6 then 1.2e0 else 1e0 end))",
    1,
)
RATE = ("(coalesce(planner_rate, 0.09e0)*(case when experience_yrs>8 then 0.7e0 else 1e0 end))")
EFF = r(
    "greatest(0e0, 100e0 - (waste + greatest(0e0, cyl*17.5e0-kg))/greatest(kg,1e0)*100e0*1.5e0)", 1
)
TIER_NAME = ("(case when risk>50 or eff<40 then 'RED' when risk>25 or eff<65 then 'AMBER' else 'GREEN' end)")

PL = f"""{EVD},{ETYPE},
pl0 as (
 select event_id, caterer_id, region, dealer, event_type, headcount, experience_yrs, cast(1 + caterer_id % 3 as int) lead_days,
  cast(date '2024-11-04' + cast((event_id*7+caterer_id) % 45 as int) as date) event_date,
  consumption_kg kg, cylinders_ordered cyl, planner_rate
 from evd join et using (event_type)),
pl1 as (select *, {RISK} risk, {r("kg*" + RATE, 2)} waste from pl0),
pl as (select *, {EFF} eff, cast(cyl*1910 as double) cost,
  cast(event_date - cast(lead_days+1+(case when risk>50 then 3 when risk>25 then 1 else 0 end)
   +(case when experience_yrs<3 then 2 else 0 end) as int) as date) order_date,
  cast(event_date - cast(lead_days+1 as int) as date) latest_date from pl1),
plt as (select *, {TIER_NAME} tier from pl)"""

# daily curve and shift plan: capacity 200, window of 30 days from 2024-11-01
CURVE = f"""{PL},
daily as (select region, dealer, order_date d, sum(cyl) q from pl
 where order_date >= date '2024-11-01' and order_date < date '2024-12-01' group by 1,2,3),
grid as (select region, dealer, cast(x as date) d from (select distinct region, dealer from pl),
 unnest(generate_series(timestamp '2024-11-01', timestamp '2024-11-30', interval 1 day)) t(x)),
curve as (select g.region, g.dealer, g.d, cast(coalesce(q,0) as bigint) raw from grid g
 left join daily using (region, dealer, d)),
curve2 as (select *, {r("avg(raw) over (partition by region, dealer order by d rows between 1 preceding and 1 following)", 1)} smooth,
  {r("raw/200*100e0", 1)} pressure, raw > 200*0.8e0 spike from curve)"""

SHIFT = f"""{CURVE},
ranked as (select plt.*, row_number() over (partition by region, dealer, order_date order by risk, event_id) rk,
  count(*) over (partition by region, dealer, order_date) n
 from plt join (select region, dealer, d order_date from curve2 where spike) using (region, dealer, order_date)),
moved as (select event_id, case when risk < 15 then 2 else 1 end step from ranked where rk <= n // 2),
shifted as (select plt.* exclude (order_date), order_date original_order_date, coalesce(step,0) shifted_days,
  cast(order_date - cast(coalesce(step,0) as int) as date) order_date
 from plt left join moved using (event_id)),
daily2 as (select region, dealer, order_date d, sum(cyl) q2 from shifted
 where order_date >= date '2024-11-01' and order_date < date '2024-12-01' group by 1,2,3),
curve3 as (select c.*, cast(coalesce(q2,0) as bigint) after_shift,
  {r("(raw-coalesce(q2,0))/(case when raw=0 then 1 else raw end)*100e0", 1)} reduction
 from curve2 c left join daily2 using (region, dealer, d))"""

PRED = f"""{EVX},
pred as (
 select event_id, ran_out_of_gas label, score, case when score >= 0.5 then 1 else 0 end prediction, consumption_kg actual,
  {r('''greatest(1.5e0, headcount/100e0*per100*(duration_hrs/5e0)*(1e0+(num_burners-4)*0.03e0)
   *greatest(0.85e0,1e0-experience_yrs*0.008e0)*(case when festival_flag=1 then 1.2e0 else 1e0 end)*greatest(0.8e0,num_dishes/5e0))''', 2)} predicted
 from (select evx.*, per100, {r(f"0.5e0*{u('42p')}+0.4e0*ran_out_of_gas*{u('42q')}", 2)} score
  from evx join menu using (menu_profile)))"""

RULE = r(
    "greatest(1.5e0, headcount/100e0*per100*(duration_hrs/5e0)*(1e0+(num_burners-4)*0.03e0)"
    "*greatest(0.85e0,1e0-experience_yrs*0.008e0)*(case when festival_flag=1 then 1.2e0 else 1e0 end)"
    "*greatest(0.8e0,num_dishes/5e0))",
    2,
)


def q(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body.strip()}"
