"""Oracle SQL per query key (DuckDB dialect, flat input).

Each query works from the flat mapping in `oracle.base` (one column per
parameter, one row per item), with plain SQL: subqueries, window
functions, QUALIFY and UNION ALL. It does not follow the Spark plans, so it
checks them independently. Doubles are rounded to 6 digits (as on the
Spark side) so summation order does not matter.
"""

from __future__ import annotations

from oracle.base import channel_case, raw_win, win, with_base

SQL: dict[str, str] = {}

ENGAGED = "coalesce(engaged_str, CAST(engaged_int AS VARCHAR))"


def skey(user: str = "user_pseudo_id", sid: str = "session_id") -> str:
    """user text followed by session id text (NULL when the id is NULL)"""
    return f"{user} || CAST({sid} AS VARCHAR)"


# ---------------------------------------------------------------- R13 / M6 / M7
def _labels_by_session(days: int) -> str:
    return f"""
SELECT user_pseudo_id, ga_session_id AS session_id, max({ENGAGED}) AS session_engaged,
  max(source) AS source, max(medium) AS medium, max(campaign) AS campaign
FROM ev WHERE {win(days)}
GROUP BY user_pseudo_id, ga_session_id"""


SQL["r13_session_source"] = with_base(_labels_by_session(60))
SQL["r13_session_source_10d"] = with_base(_labels_by_session(10))


# ---------------------------------------------------------------- R12
def _counts_by_label(days: int) -> str:
    return with_base(f"""
SELECT source, medium, campaign,
  count(DISTINCT {skey()}) AS count_sessions,
  count(DISTINCT CASE WHEN session_engaged = '1' THEN {skey()} END) AS count_engaged_sessions,
  count(DISTINCT user_pseudo_id) AS count_users
FROM labelled GROUP BY source, medium, campaign""", f"labelled AS ({_labels_by_session(days)})")


SQL["r12_session_user_counts"] = _counts_by_label(60)
SQL["r12_session_user_counts_10d"] = _counts_by_label(10)


# ---------------------------------------------------------------- R3
def _device_flags(days: int) -> str:
    return f"""
device_account AS (
  SELECT user_pseudo_id, max(user_id) AS user_id FROM ev WHERE {win(days)}
  GROUP BY user_pseudo_id),
device_flags AS (
  SELECT d.user_pseudo_id, d.user_id, f.renew, f.new, f.lapsed
  FROM device_account d JOIN buyers f ON f.const_id = CAST(d.user_id AS BIGINT)
  WHERE d.user_id IS NOT NULL)"""


SQL["r03_buyer_behavior_by_user"] = with_base("SELECT * FROM device_flags", _device_flags(60))
SQL["r03_buyer_behavior_by_user_10d"] = with_base("SELECT * FROM device_flags", _device_flags(10))


# ---------------------------------------------------------------- R2
def _buyer_mix(days: int) -> str:
    return _device_flags(days) + f""",
buying_sessions AS (
  SELECT user_pseudo_id, ga_session_id AS session_id,
    max(source) AS source, max(medium) AS medium, max(campaign) AS campaign
  FROM ev WHERE {win(days)}
  GROUP BY user_pseudo_id, ga_session_id
  HAVING count_if(event_name = 'purchase') > 0),
buyer_mix AS (
  SELECT b.source, b.medium, b.campaign,
    count(DISTINCT {skey('b.user_pseudo_id', 'b.session_id')}) AS count_purchasing_sessions,
    count(DISTINCT b.user_pseudo_id) AS count_purchasing_user_pseudo_id,
    count(DISTINCT b.user_pseudo_id) FILTER (WHERE f.new = 1) AS count_new_buyers,
    count(DISTINCT b.user_pseudo_id) FILTER (WHERE f.renew = 1) AS count_renew_buyers,
    count(DISTINCT b.user_pseudo_id) FILTER (WHERE f.lapsed = 1) AS count_lapsed_buyers
  FROM buying_sessions b LEFT JOIN device_flags f USING (user_pseudo_id)
  GROUP BY b.source, b.medium, b.campaign)"""


SQL["r02_buyer_behavior_by_campaign"] = with_base("SELECT * FROM buyer_mix", _buyer_mix(60))
SQL["r02_buyer_behavior_by_campaign_10d"] = with_base("SELECT * FROM buyer_mix", _buyer_mix(10))


# ---------------------------------------------------------------- R14 / R15
def _acq(days: int, first_user: bool, specific: str | None = None, source_medium: bool = False) -> str:
    """R14 (session scope) or R15 (first-user scope)."""
    if first_user:
        s, m, c = "first_source", "first_medium", "first_campaign"
        pre, engaged = "first_user_", ENGAGED
        labels = f"""coalesce(ts_source, '(direct)') AS {s}, coalesce(ts_medium, '(none)') AS {m},
      coalesce(ts_name, '(not set)') AS {c},"""
        keys = f"user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')}, {s}, {m}, {c}"
        names = (f"{s} AS first_user_source", f"{m} AS first_user_medium", f"{c} AS first_user_campaign")
        group = "first_user_default_channel_group"
    else:
        s, m, c = "source", "medium", "campaign"
        pre, engaged = "session_", "engaged_str"

        def first(col: str, default: str) -> str:
            return f"coalesce(first({col} ORDER BY event_timestamp, {col}) FILTER (WHERE {col} IS NOT NULL), '{default}') AS {col},"

        labels = first("source", "(direct)") + first("medium", "(none)") + first("campaign", "(not set)")
        keys = f"user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')}"
        names = (f"{s} AS session_source", f"{m} AS session_medium", f"{c} AS session_campaign")
        group = "session_default_channel_group"
    sm = f"{s} || ' / ' || {m} AS {pre}source_medium," if source_medium else ""
    dims = 6 if source_medium else 5
    spec_in = f"count_if(event_name = '{specific}') AS specific_event_count," if specific else ""
    spec_out = "CAST(sum(specific_event_count) AS BIGINT) AS specific_event_count," if specific else ""
    if first_user:
        sessions = f"""count(session_id) AS sessions,
  count(session_id) FILTER (WHERE session_engaged = '1') AS engaged_sessions,
  count(DISTINCT user_pseudo_id) FILTER (WHERE session_number = 1) AS new_users,
  count(DISTINCT user_pseudo_id) FILTER (WHERE session_number > 1) AS returning_users,"""
    else:
        sessions = """count(DISTINCT session_id) AS sessions,
  count(DISTINCT session_id) FILTER (WHERE session_engaged = '1') AS engaged_sessions,"""
    per_session = f"""
per_session AS (
  SELECT user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')} AS session_id, {labels} {spec_in}
    min(strptime(event_date, '%Y%m%d')::DATE) AS date,
    max(ga_session_number) FILTER (WHERE event_name = 'session_start') AS session_number,
    max({engaged}) AS session_engaged,
    max(engagement_time_msec) AS engagement_time_msec,
    count(event_name) AS event_count,
    count_if(event_name = 'purchase') AS conversions,
    sum(purchase_revenue) AS total_revenue
  FROM ev WHERE {win(days)}
  GROUP BY {keys})"""
    body = f"""
SELECT date, {channel_case(s, m, c)} AS {group},
  {names[0]}, {names[1]}, {sm} {names[2]},
  count(DISTINCT user_pseudo_id) AS total_users,
  count(DISTINCT user_pseudo_id) FILTER (WHERE engagement_time_msec > 0 OR session_engaged = '1') AS active_users,
  {sessions}
  round(sum(engagement_time_msec / 1000), 6) AS engagement_time,
  CAST(sum(event_count) AS BIGINT) AS total_event_count, {spec_out}
  CAST(sum(conversions) AS BIGINT) AS conversions,
  round(coalesce(sum(total_revenue), 0), 6) AS total_revenue
FROM per_session GROUP BY {', '.join(str(i) for i in range(1, dims + 1))}"""
    return with_base(body, per_session)


SQL["r14_traffic_acquisition"] = _acq(30, False)
SQL["r14_traffic_acquisition_10d"] = _acq(10, False)
SQL["r14_traffic_acquisition_options"] = _acq(30, False, "add_to_cart", True)
SQL["r15_user_acquisition"] = _acq(30, True)
SQL["r15_user_acquisition_10d"] = _acq(10, True)
SQL["r15_user_acquisition_options"] = _acq(30, True, "add_to_cart", True)


# ---------------------------------------------------------------- R8
def _item_sums(days: int, name: str = "item_sums") -> str:
    don = "item_id IN ('Donation', 'hd3g4y')"
    prod = "item_id NOT IN ('Donation', 'Fees')"
    return f"""
{name} AS (
  SELECT user_pseudo_id, ga_session_id AS session_id,
    sum(item_revenue) FILTER (WHERE {don}) AS donation_revenue,
    CAST(sum(quantity) FILTER (WHERE {don}) AS BIGINT) AS donation_quantity,
    sum(item_revenue) FILTER (WHERE {prod}) AS product_revenue,
    CAST(sum(quantity) FILTER (WHERE {prod}) AS BIGINT) AS product_quantity,
    CAST(max(CASE WHEN event_name = 'purchase' THEN 1 END) AS BIGINT) AS conversion_flag
  FROM ev_items WHERE {win(days)} AND event_name = 'purchase'
  GROUP BY user_pseudo_id, ga_session_id)"""


_R8_OUT = ("SELECT user_pseudo_id, session_id, round(donation_revenue, 6) AS donation_revenue, donation_quantity, "
           "round(product_revenue, 6) AS product_revenue, product_quantity, conversion_flag FROM item_sums")
SQL["r08_items_by_session"] = with_base(_R8_OUT, _item_sums(60))
SQL["r08_items_by_session_10d"] = with_base(_R8_OUT, _item_sums(10))


# ---------------------------------------------------------------- R4 / R1 / M13-M15
def _money(x: str) -> str:
    """Plain digits of the shortest text of a double, over its whole range."""
    t = f"CAST({x} AS VARCHAR)"
    return f"""(SELECT CASE
      WHEN t IS NULL THEN NULL WHEN t = 'nan' THEN 'NaN' WHEN t LIKE '%inf' THEN t
      WHEN t NOT LIKE '%e%' THEN regexp_replace(t, '\\.0$', '')
      WHEN e >= length(f) THEN w || f || repeat('0', e - length(f))
      WHEN e >= 0 THEN w || substr(f, 1, e) || '.' || substr(f, e + 1)
      ELSE regexp_replace(w, '[0-9]+', '') || '0.' || repeat('0', -e - 1) || ltrim(w, '-') || f END
    FROM (SELECT t, split_part(split_part(t, 'e', 1), '.', 1) AS w, split_part(split_part(t, 'e', 1), '.', 2) AS f,
                 CAST(nullif(split_part(t, 'e', 2), '') AS INTEGER) AS e FROM (SELECT {t} AS t)))"""


_FOLD = "list_reduce(list({v} ORDER BY {o}) FILTER ({v} IS NOT NULL), lambda a, b: a + b)"


def _cart(days: int) -> str:
    qty, lo, hi = "CAST(item_quantity AS VARCHAR)", _money("min_item_price"), _money("max_item_price")
    nl = "' each' || chr(10)"
    text = f"""CASE
      WHEN item_id = 'Donation' THEN {qty} || ' donation(s) for ' || item_name || ', for $' || {hi} || {nl}
      WHEN item_id = 'Fees' OR item_id IS NULL THEN NULL
      WHEN min_item_price <> max_item_price
        THEN {qty} || ' ticket(s) for ' || item_name || ', for $' || {lo} || ' - $' || {hi} || {nl}
      ELSE {qty} || ' ticket(s) for ' || item_name || ', for $' || {hi} || {nl} END"""
    return f"""
carted AS (
  SELECT user_pseudo_id, ga_session_id AS session_id, item_id, item_name, quantity, price
  FROM ev_items WHERE {win(days)} AND event_name = 'add_to_cart'),
priced AS (
  SELECT user_pseudo_id, session_id, item_id, item_name, price, CAST(sum(quantity) AS DOUBLE) * price AS value
  FROM carted GROUP BY user_pseudo_id, session_id, item_id, item_name, price),
line_value AS (
  SELECT user_pseudo_id, session_id, item_id, item_name, {_FOLD.format(v='value', o='price')} AS value
  FROM priced GROUP BY user_pseudo_id, session_id, item_id, item_name),
cart_value AS (
  SELECT user_pseudo_id, session_id,
    {_FOLD.format(v='value', o='item_name NULLS FIRST, item_id NULLS FIRST')} AS total_cart_price
  FROM line_value GROUP BY user_pseudo_id, session_id),
cart_items AS (
  SELECT user_pseudo_id, session_id, item_id, item_name,
    CAST(sum(quantity) AS BIGINT) AS item_quantity, max(price) AS max_item_price, min(price) AS min_item_price
  FROM carted GROUP BY ALL),
cart_words AS (
  SELECT user_pseudo_id, session_id,
    string_agg(line, '' ORDER BY item_name, item_id) AS product_quantity_price
  FROM (SELECT *, {text} AS line FROM cart_items)
  GROUP BY user_pseudo_id, session_id),
session_days AS (
  SELECT user_pseudo_id, ga_session_id AS session_id, event_date,
    max(user_id) AS user_id,
    min(event_timestamp) FILTER (WHERE event_name = 'add_to_cart') AS add_to_cart_timestamp,
    min(event_timestamp) FILTER (WHERE event_name = 'purchase') AS purchase_timestamp
  FROM ev WHERE {win(days)}
  GROUP BY user_pseudo_id, ga_session_id, event_date),
abandoned AS (
  SELECT d.*, w.product_quantity_price || 'Your cart total: $' || {_money('v.total_cart_price')} AS product_quantity_price
  FROM session_days d
  LEFT JOIN cart_words w ON w.user_pseudo_id = d.user_pseudo_id AND w.session_id = d.session_id
  LEFT JOIN cart_value v ON v.user_pseudo_id = d.user_pseudo_id AND v.session_id = d.session_id
  WHERE d.user_id IS NOT NULL AND d.add_to_cart_timestamp IS NOT NULL AND d.purchase_timestamp IS NULL)"""


SQL["r04_cart_abandonment"] = with_base("SELECT * FROM abandoned", _cart(1))
SQL["r04_cart_abandonment_10d"] = with_base("SELECT * FROM abandoned", _cart(10))
SQL["r01_abandoned_cart_user_ids"] = with_base("SELECT user_id, product_quantity_price FROM abandoned", _cart(1))
SQL["m13_cart_total"] = with_base(
    "SELECT user_pseudo_id, session_id, round(total_cart_price, 6) AS total_cart_price FROM cart_value", _cart(1))
SQL["m14_cart_items"] = with_base(
    "SELECT user_pseudo_id, session_id, item_id, item_name, item_quantity, round(max_item_price, 6) AS max_item_price, "
    "round(min_item_price, 6) AS min_item_price FROM cart_items", _cart(1))
SQL["m15_cart_text"] = with_base("SELECT * FROM cart_words", _cart(1))


# ---------------------------------------------------------------- R5 / R6 / M11 / M12
_TITLE = r"'^(.*?)\s*\|'"


def _landing(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, {_TITLE}) THEN regexp_extract({col}, {_TITLE}, 1) END"


def _funnel(days: int, by_date: bool, steps: tuple[str, ...] = ("page_view", "add_to_cart", "purchase")) -> str:
    day = "CAST(make_timestamp(t) AS DATE)"
    names = ", ".join(f"'{x}'" for x in steps)
    firsts = ",\n    ".join(f"min(t) FILTER (WHERE step = '{x}') AS t_{i}" for i, x in enumerate(steps))
    rule = " AND ".join(f"(s.t_{i} IS NULL OR s.t_{i} > s.t_{i - 1})" for i in range(1, len(steps)))
    return f"""
steps AS (
  SELECT user_pseudo_id AS u, ga_session_id AS sid, event_name AS step, event_timestamp AS t, page_title
  FROM ev WHERE {win(days)} AND event_name IN ({names})),
opening AS (
  SELECT u, sid, CASE WHEN step = '{steps[0]}' THEN page_title END AS opening_title
  FROM steps QUALIFY row_number() OVER (PARTITION BY u, sid ORDER BY t, step, coalesce(page_title, '')) = 1),
step_times AS (
  SELECT u, sid, {day + ' AS session_date,' if by_date else ''}
    {firsts}
  FROM steps GROUP BY u, sid{', ' + day if by_date else ''}),
passing AS (
  SELECT s.*, o.opening_title
  FROM step_times s JOIN opening o ON o.u = s.u AND o.sid IS NOT DISTINCT FROM s.sid
  WHERE s.t_0 IS NOT NULL{' AND ' + rule if rule else ''})"""


_FUNNEL_COUNTS = f"""count({skey('u', 'sid')}) AS sessions_page_view,
  count({skey('u', 'sid')}) FILTER (WHERE t_1 IS NOT NULL) AS sessions_add_to_cart,
  count(sid) FILTER (WHERE t_2 IS NOT NULL) AS sessions_purchase"""

for _d, _sfx in ((30, ""), (10, "_10d")):
    SQL[f"r05_closed_funnel_by_date{_sfx}"] = with_base(
        f"SELECT session_date, {_landing('opening_title')} AS first_page_view, {_FUNNEL_COUNTS} FROM passing GROUP BY 1, 2",
        _funnel(_d, True))
    SQL[f"r06_closed_funnel{_sfx}"] = with_base(
        f"SELECT 'all_pages' AS all_pages, {_landing('opening_title')} AS first_page_view, {_FUNNEL_COUNTS} FROM passing GROUP BY 2",
        _funnel(_d, False))
SQL["m11_funnel_sessions"] = with_base(
    """SELECT u AS user_pseudo_id, sid AS session_id, session_date, opening_title AS first_page_view,
  t_0 AS first_page_view_timestamp, t_1 AS first_add_to_cart_timestamp, t_2 AS first_purchase_timestamp
FROM passing""", _funnel(30, True))
SQL["r06_closed_funnel_two_steps"] = with_base(
    f"""SELECT 'all_pages' AS all_pages, {_landing('opening_title')} AS first_page_view,
  count({skey('u', 'sid')}) AS sessions_page_view,
  count(sid) FILTER (WHERE t_1 IS NOT NULL) AS sessions_purchase
FROM passing GROUP BY 2""", _funnel(30, False, ("page_view", "purchase")))
SQL["m12_landing_page"] = with_base(
    f"SELECT u AS user_pseudo_id, sid AS session_id, opening_title AS page_title, {_landing('opening_title')} AS landing_page FROM opening",
    _funnel(30, False))


# ---------------------------------------------------------------- R7
def _geo(days: int) -> str:
    fields = ("continent", "sub_continent", "country", "region", "city", "metro")
    # the first event by (time, name), equal times broken by the geo values
    # (NULL first), like the struct minimum on the Spark side
    order = "event_timestamp, event_name, " + ", ".join(f"geo_{f} NULLS FIRST" for f in fields)
    firsts = ",\n  ".join(f"first(geo_{f} ORDER BY {order}) AS {f}" for f in fields)
    return with_base(f"""
SELECT user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')} AS session_id,
  max({ENGAGED}) AS session_engaged,
  {firsts}
FROM ev WHERE {win(days)}
GROUP BY 1, 2""")


SQL["r07_geo_by_session"] = _geo(30)
SQL["r07_geo_by_session_10d"] = _geo(10)


# ---------------------------------------------------------------- R10 / R11 / M16-M22
def _credit(conv: int, acq: int, campaign: bool) -> str:
    direct = "(direct)/(none)/(none)" if campaign else "(direct)/(none)"
    lbl = "coalesce(source, '(direct)') || '/' || coalesce(medium, '(none)')"
    if campaign:
        lbl += " || '/' || coalesce(campaign, '(none)')"
    return f"""
purchases AS (
  SELECT user_pseudo_id AS u, ga_session_id AS sid, {skey('user_pseudo_id', 'event_timestamp')} AS conv_id,
    max(event_timestamp) AS conv_ts
  FROM ev WHERE {raw_win(conv, 1)} AND event_name = 'purchase'
  GROUP BY 1, 2, 3),
earliest AS (
  SELECT * FROM purchases
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY conv_ts, conv_id, sid NULLS FIRST) = 1),
visits AS (
  SELECT e.user_pseudo_id AS u, e.ga_session_id AS sid, min(e.event_timestamp) AS started, max({lbl}) AS lbl
  FROM ev e
  WHERE {raw_win(conv + acq, 1)} AND EXISTS (SELECT 1 FROM earliest x WHERE x.u = e.user_pseudo_id)
  GROUP BY 1, 2),
scoped AS (
  SELECT v.*, CASE WHEN v.sid = x.sid THEN x.conv_id END AS conv_id
  FROM visits v JOIN earliest x ON x.u = v.u
  WHERE v.started BETWEEN x.conv_ts - {acq} * 86400000000 AND x.conv_ts),
numbered AS (
  SELECT *,
    row_number() OVER (PARTITION BY u ORDER BY started, sid NULLS FIRST) AS pos,
    count(DISTINCT sid) OVER (PARTITION BY u) AS n_sess,
    count(*) OVER (PARTITION BY u) AS n_rows
  FROM scoped),
weighted AS (
  SELECT *,
    CAST(1.0 AS DOUBLE) / n_rows AS w_linear,
    CASE WHEN n_sess = 1 THEN CAST(1 AS DOUBLE)
      ELSE power(2, pos / nullif(n_sess, 0)) / sum(power(2, pos / nullif(n_sess, 0))) OVER (PARTITION BY u) END AS w_decay,
    CAST(CASE WHEN n_sess = 1 THEN 1 WHEN n_sess = 2 THEN 0.5
      WHEN n_sess > 2 THEN CASE WHEN pos IN (1, n_sess) THEN 0.4 ELSE 0.2 / (n_sess - 2) END END AS DOUBLE) AS w_position
  FROM numbered),
non_direct AS (
  SELECT c.u, c.conv_id,
    coalesce((SELECT p.lbl FROM numbered p WHERE p.u = c.u AND p.pos <= c.pos AND p.lbl <> '{direct}'
              ORDER BY p.pos DESC LIMIT 1), '{direct}') AS lbl
  FROM numbered c WHERE c.conv_id IS NOT NULL),
credit AS (
  SELECT 'first click' AS model, lbl, CAST(1 AS DOUBLE) AS w FROM numbered WHERE pos = 1
  UNION ALL SELECT 'last click', lbl, CAST(1 AS DOUBLE) FROM numbered WHERE pos = n_sess
  UNION ALL SELECT 'last non direct click', lbl, CAST(1 AS DOUBLE) FROM non_direct
  UNION ALL SELECT 'linear', lbl, w_linear FROM weighted
  UNION ALL SELECT 'time decay', lbl, w_decay FROM weighted
  UNION ALL SELECT 'position based', lbl, w_position FROM weighted)"""


def _attr(conv: int, acq: int, campaign: bool) -> str:
    col = "source_medium_campaign" if campaign else "source_medium"
    return with_base(f"SELECT model AS attribution_model, lbl AS {col}, round(sum(w), 6) AS attribution_weight "
                     f"FROM credit GROUP BY 1, 2", _credit(conv, acq, campaign))


SQL["r10_attribution_source_medium"] = _attr(30, 30, False)
SQL["r10_attribution_source_medium_10_10"] = _attr(10, 10, False)
SQL["r11_attribution_source_medium_campaign"] = _attr(30, 30, True)
SQL["r11_attribution_source_medium_campaign_10_10"] = _attr(10, 10, True)
_ROWS = ("SELECT u AS user_pseudo_id, sid AS session_id, pos AS session_number, lbl AS source_medium, "
         "round({w}, 6) AS attribution_weight FROM {src}")
for _n, _sfx in ((30, ""), (10, "_10_10")):
    _ctes = _credit(_n, _n, False)
    SQL[f"m16_first_conversion{_sfx}"] = with_base(
        "SELECT u AS user_pseudo_id, sid AS session_id, conv_id AS conversion_id, conv_ts AS conversion_timestamp "
        "FROM earliest", _ctes)
    SQL[f"m17_first_click{_sfx}"] = with_base(_ROWS.format(w="CAST(1 AS DOUBLE)", src="numbered WHERE pos = 1"), _ctes)
    SQL[f"m18_last_click{_sfx}"] = with_base(_ROWS.format(w="CAST(1 AS DOUBLE)", src="numbered WHERE pos = n_sess"), _ctes)
    SQL[f"m19_last_non_direct{_sfx}"] = with_base(
        "SELECT u AS user_pseudo_id, conv_id AS conversion_id, lbl AS source_medium, CAST(1 AS DOUBLE) AS attribution_weight "
        "FROM non_direct", _ctes)
    SQL[f"m20_linear{_sfx}"] = with_base(_ROWS.format(w="w_linear", src="weighted"), _ctes)
    SQL[f"m21_time_decay{_sfx}"] = with_base(_ROWS.format(w="w_decay", src="weighted"), _ctes)
    SQL[f"m22_position_based{_sfx}"] = with_base(_ROWS.format(w="w_position", src="weighted"), _ctes)


# ---------------------------------------------------------------- R9
def _email(session_days: int, item_days: int) -> str:
    metrics = ("send_amt", "opens", "uniqueopens", "linkclicks", "uniquelinkclicks", "subscriberclicks",
               "forwards", "uniqueforwards", "hardbounces", "softbounces", "unsubscribes", "unsubreasons",
               "replies", "uniquereplies", "socialshares")
    casts = ",\n  ".join(f"CAST(k.{m} AS BIGINT) AS {m}" for m in metrics)
    ctes = _buyer_mix(session_days) + "," + _item_sums(item_days) + f""",
labelled AS ({_labels_by_session(session_days)}),
label_counts AS (
  SELECT source, medium, campaign,
    count(DISTINCT {skey()}) AS count_sessions,
    count(DISTINCT CASE WHEN session_engaged = '1' THEN {skey()} END) AS count_engaged_sessions,
    count(DISTINCT user_pseudo_id) AS count_users
  FROM labelled GROUP BY source, medium, campaign),
mail_sessions AS (
  SELECT l.source, l.medium, l.campaign,
    sum(i.donation_revenue) AS total_donation_revenue,
    CAST(sum(i.donation_quantity) AS BIGINT) AS total_donation_quantity,
    sum(i.product_revenue) AS total_product_revenue,
    CAST(sum(i.product_quantity) AS BIGINT) AS total_product_quantity,
    CAST(sum(i.conversion_flag) AS BIGINT) AS conversion_count
  FROM labelled l
  LEFT JOIN item_sums i ON i.user_pseudo_id = l.user_pseudo_id AND i.session_id = l.session_id
  WHERE l.medium = 'email'
  GROUP BY l.source, l.medium, l.campaign)"""
    return with_base(f"""
SELECT m.source, m.medium, m.campaign,
  round(m.total_donation_revenue, 6) AS total_donation_revenue, m.total_donation_quantity,
  round(m.total_product_revenue, 6) AS total_product_revenue, m.total_product_quantity, m.conversion_count,
  n.count_sessions, n.count_engaged_sessions, n.count_users AS count_user_pseudo_id,
  b.count_purchasing_user_pseudo_id, b.count_new_buyers, b.count_renew_buyers, b.count_lapsed_buyers,
  k.ldate,
  {casts}
FROM mail_sessions m
LEFT JOIN label_counts n ON n.source = m.source AND n.medium = m.medium AND n.campaign = m.campaign
LEFT JOIN buyer_mix b ON b.source = m.source AND b.medium = m.medium AND b.campaign = m.campaign
LEFT JOIN campaigns k ON k.name = m.campaign""", ctes)


SQL["r09_email_campaign_stats"] = _email(60, 30)
SQL["r09_email_campaign_stats_items_5d"] = _email(60, 5)


# ---------------------------------------------------------------- M1 - M10
def _shard_counts(where: str) -> str:
    return with_base(f"""
SELECT regexp_extract(suffix, '[0-9]+') AS event_date,
  CASE WHEN suffix LIKE 'intraday%' THEN 'intraday' ELSE 'daily' END AS export_kind,
  count(*) AS event_count, count(DISTINCT user_pseudo_id) AS user_count,
  count(DISTINCT {skey('user_pseudo_id', 'ga_session_id')}) AS session_count
FROM ev WHERE {where} GROUP BY 1, 2""")


SQL["m01_read_with_intraday"] = _shard_counts(win(1))
SQL["m02_read_daily_only"] = _shard_counts(raw_win(1, 0))
SQL["m03_event_param"] = with_base(f"""
SELECT user_pseudo_id, event_timestamp, event_name, ga_session_id, page_title, ga_session_number,
  engaged_str AS session_engaged_string, engaged_int AS session_engaged_int, engagement_time_msec,
  source, medium, campaign
FROM ev WHERE {win(30)}""")
SQL["m04_session_id"] = with_base(
    f"SELECT user_pseudo_id, event_timestamp, ga_session_id AS session_id FROM ev WHERE {win(30)}")
SQL["m05_session_id_concat"] = with_base(
    f"SELECT user_pseudo_id, event_timestamp, {skey('user_pseudo_id', 'ga_session_id')} AS session_id FROM ev WHERE {win(30)}")
SQL["m06_session_engaged"] = with_base(f"""
SELECT user_pseudo_id, ga_session_id AS session_id,
  max({ENGAGED}) AS session_engaged, max(engaged_str) AS session_engaged_string_only
FROM ev WHERE {win(30)} GROUP BY 1, 2""")
SQL["m07_session_source_max"] = with_base(f"""
SELECT user_pseudo_id, ga_session_id AS session_id, max(source) AS source, max(medium) AS medium, max(campaign) AS campaign
FROM ev WHERE {win(30)} GROUP BY 1, 2""")
_FIRST_SEEN = f"""
first_seen AS (
  SELECT user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')} AS session_id,
    coalesce(first(source ORDER BY event_timestamp, source) FILTER (WHERE source IS NOT NULL), '(direct)') AS source,
    coalesce(first(medium ORDER BY event_timestamp, medium) FILTER (WHERE medium IS NOT NULL), '(none)') AS medium,
    coalesce(first(campaign ORDER BY event_timestamp, campaign) FILTER (WHERE campaign IS NOT NULL), '(not set)') AS campaign
  FROM ev WHERE {win(30)} GROUP BY 1, 2)"""
SQL["m08_session_source_first"] = with_base("SELECT * FROM first_seen", _FIRST_SEEN)
SQL["m09_first_user_source"] = with_base(f"""
SELECT user_pseudo_id, {skey('user_pseudo_id', 'ga_session_id')} AS session_id,
  coalesce(ts_source, '(direct)') AS first_source, coalesce(ts_medium, '(none)') AS first_medium,
  coalesce(ts_name, '(not set)') AS first_campaign, count(*) AS event_count
FROM ev WHERE {win(30)} GROUP BY 1, 2, 3, 4, 5""")
SQL["m10_channel_group"] = with_base(f"""
SELECT source, medium, campaign, {channel_case('source', 'medium', 'campaign')} AS channel_group, count(*) AS sessions
FROM first_seen GROUP BY 1, 2, 3, 4""", _FIRST_SEEN)
SQL["m10_channel_group_events"] = with_base(f"""
SELECT source, medium, campaign, count(*) AS events, {channel_case('source', 'medium', 'campaign')} AS channel_group
FROM ev WHERE {win(30)} GROUP BY 1, 2, 3""")

# the same reports over saved tables
SQL["r01_saved"] = SQL["r01_abandoned_cart_user_ids"]
SQL["r02_saved"] = SQL["r02_buyer_behavior_by_campaign"]
SQL["r09_saved"] = SQL["r09_email_campaign_stats"]

# the same reports over the day store's states and over folders per shard
for _name, _same in {
    "r13": "r13_session_source", "r12": "r12_session_user_counts", "r02": "r02_buyer_behavior_by_campaign",
    "r08": "r08_items_by_session", "r05": "r05_closed_funnel_by_date", "r06": "r06_closed_funnel",
    "r07": "r07_geo_by_session", "r14": "r14_traffic_acquisition", "r15": "r15_user_acquisition",
    "r10": "r10_attribution_source_medium", "r11": "r11_attribution_source_medium_campaign",
}.items():
    SQL[f"{_name}_day_store"] = SQL[_same]
SQL["m01_shard_folders"] = SQL["m01_read_with_intraday"]
SQL["m02_shard_folders"] = SQL["m02_read_daily_only"]
SQL["r14_shard_folders"] = SQL["r14_traffic_acquisition"]
for _name, _same in {
    "m03": "m03_event_param", "r13": "r13_session_source", "r14": "r14_traffic_acquisition", "r06": "r06_closed_funnel",
}.items():
    SQL[f"{_name}_shredded"] = SQL[_same]
