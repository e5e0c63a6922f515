"""The same results in plain SQL over the given tables, written for DuckDB.

Named steps are kept in ``STEPS``; ``query`` puts the steps a statement needs in front of it, in
order.  ``fin`` gives the result the plain form of ``workloads.queries.plain``.
"""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def query(sql: str) -> str:
    """Put the steps the statement refers to, directly or through other steps, in front of it."""
    text, chosen = sql, []
    for name in reversed(STEPS):
        if re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
            chosen.insert(0, name)
            text += STEPS[name]
    if not chosen:
        return sql
    recursive = "RECURSIVE " if {"walk"} & set(chosen) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS (\n{STEPS[n]}\n)" for n in chosen) + "\n" + sql


def fin(sql: str, ints: str = "", floats: str = "", dates: str = "", stamps: str = "", lists: str = "") -> str:
    swaps = (
        [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
        + [f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in floats.split()]
        + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
        + [f"epoch_us({c}) AS {c}" for c in stamps.split()]
        + [f"array_to_string({c}, ',') AS {c}" for c in lists.split()]
    )
    star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    return query(f"SELECT {star} FROM (\n{sql}\n)")


# ---- the shape of the nested events, flat -------------------------------------------------------

step(
    "line_rows",
    """
SELECT event_id, pos, l_extendedprice AS price,
       CASE WHEN l_partkey % 13 <> 0 THEN 'P' || l_partkey END AS item_id,
       CASE WHEN l_partkey % 11 <> 0 THEN ' Part ' || l_partkey END AS item_name,
       'B' || l_suppkey AS item_brand, l_returnflag AS item_variant, l_linestatus AS item_category,
       CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice) END AS price_in_usd,
       CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS item_revenue,
       CASE WHEN l_linenumber < 5 THEN floor(l_extendedprice) END AS item_revenue_in_usd
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY event_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
  FROM (SELECT *, l_orderkey % (SELECT count(*) FROM events) AS event_id FROM lineitem))
""",
)
step(
    "line_lists",
    """
SELECT event_id, count(*) AS item_n,
       to_json(list({item_id: item_id, item_name: item_name, item_brand: item_brand,
         item_variant: item_variant, item_category: item_category, price: price,
         price_in_usd: price_in_usd, quantity: quantity, item_revenue: item_revenue,
         item_revenue_in_usd: item_revenue_in_usd} ORDER BY pos)) AS items_text
FROM line_rows GROUP BY event_id
""",
)
step(
    "ev",
    """
SELECT e.event_id, e.user_id, CAST(e.user_id AS VARCHAR) AS uid, e.event_type = 'purchase' AS buys,
       CASE e.event_type WHEN 'purchase' THEN 'purchase' WHEN 'view' THEN 'view_item'
            WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'first_visit' ELSE 'page_view' END AS event_name,
       e.ts, epoch_us(e.ts) AS micros, CAST(e.ts AS DATE) AS d, strftime(e.ts, '%Y%m%d') AS suffix,
       k, k % 10 AS tail, coalesce(l.item_n, 0) AS item_n,
       coalesce(CAST(l.items_text AS VARCHAR), '[]') AS items_text,
       r.r_name, n.n_name, c.c_mktsegment
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) e
LEFT JOIN line_lists l USING (event_id)
LEFT JOIN customer c ON c.c_custkey = e.user_id
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""",
)
step(
    "shaped",
    """
SELECT *, CAST(suffix AS BIGINT) AS sid,
  CASE WHEN buys THEN CASE
    WHEN tail = 0 THEN CASE WHEN k % 20 = 0 THEN '(not set)' ELSE 'NOT SET' || chr(9) END
    WHEN tail = 1 THEN CASE WHEN k % 20 = 1 THEN NULL ELSE ' ' || chr(9) END
    WHEN tail = 2 THEN 'X' || k
    ELSE ' T' || uid || '-' || k || chr(10) END END AS raw_id,
  CASE WHEN buys THEN CAST(CASE WHEN tail = 2 THEN event_id % 500 ELSE k END AS DOUBLE) END AS revenue,
  CASE tail WHEN 2 THEN 'google' WHEN 3 THEN 'google' WHEN 4 THEN 'google' WHEN 5 THEN 'partner'
    WHEN 6 THEN 'partner' WHEN 7 THEN 'news' WHEN 8 THEN 'aff' WHEN 9 THEN 'x' END AS src,
  CASE tail WHEN 2 THEN 'organic' WHEN 3 THEN 'organic' WHEN 4 THEN 'cpc' WHEN 5 THEN 'referral'
    WHEN 6 THEN 'referral' WHEN 7 THEN 'email' WHEN 8 THEN 'affiliate' WHEN 9 THEN 'other' END AS med,
  CASE tail WHEN 3 THEN 'brand' WHEN 4 THEN 'spring' WHEN 6 THEN 'deal' WHEN 7 THEN 'weekly' END AS camp
FROM ev
""",
)
step(
    "clean",
    """
SELECT *, nullif(trim(raw_id, ' ' || chr(9) || chr(10)), '') AS bare_id,
  sha256(suffix || '|' || uid || '|' || micros || '|' || event_name || '|' || event_id || '|' ||
         CASE WHEN k % 5 = 0 THEN 'NULL' ELSE CAST(k % 5 AS VARCHAR) END) AS fp
FROM shaped
""",
)
step(
    "stg",
    """
SELECT fp AS source_event_fingerprint, suffix AS source_table_suffix, d AS event_date,
  ts AS event_timestamp_utc, micros AS event_timestamp_micros, event_name, uid AS user_pseudo_id,
  event_id AS event_bundle_sequence_id,
  CASE WHEN k % 5 <> 0 THEN CAST(k % 5 AS BIGINT) END AS event_server_timestamp_offset,
  'WEB' AS platform, sid AS ga_session_id, CAST(day(d) AS BIGINT) AS ga_session_number,
  uid || '|' || sid AS session_key,
  CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false WHEN k % 6 = 2 THEN true END AS session_engaged,
  CASE WHEN k % 2 = 0 THEN CAST(event_id % 1000 AS DOUBLE) END AS engagement_time_msec,
  CAST(NULL AS BIGINT) AS engaged_session_event, CAST(NULL AS BIGINT) AS debug_mode,
  src AS event_source, med AS event_medium, camp AS event_campaign,
  CASE WHEN user_id % 4 <> 0 THEN 'google' END AS first_user_source,
  CASE WHEN user_id % 4 = 1 THEN 'cpc' WHEN user_id % 4 > 1 THEN 'organic' END AS first_user_medium,
  CASE WHEN user_id % 4 = 1 THEN 'launch' END AS first_user_campaign,
  CASE WHEN k % 7 <> 0 THEN 'https://shop.example/p/' || k END AS page_location,
  CASE WHEN k % 7 <> 0 THEN 'Page ' || k END AS page_title, CAST(NULL AS VARCHAR) AS page_referrer,
  CASE WHEN user_id % 10 = 0 THEN '(not set)' ELSE r_name END AS geo_country,
  CASE WHEN user_id % 10 = 0 THEN ' ' ELSE n_name END AS geo_region, c_mktsegment AS geo_city,
  CASE WHEN user_id % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_category,
  CASE WHEN user_id % 3 = 0 THEN 'Android' ELSE 'Windows' END AS device_operating_system,
  CASE WHEN user_id % 2 = 0 THEN 'Chrome' ELSE 'Firefox' END AS device_browser,
  raw_id AS transaction_id_raw,
  CASE WHEN lower(bare_id) NOT IN ('(not set)', 'not set', 'not_set') THEN bare_id END AS transaction_id_normalized,
  CASE WHEN bare_id IS NULL THEN 'MISSING' WHEN lower(bare_id) IN ('(not set)', 'not set', 'not_set')
       THEN 'NOT_SET' ELSE 'VALID' END AS transaction_id_status,
  revenue AS ecommerce_purchase_revenue, revenue AS ecommerce_purchase_revenue_in_usd,
  CASE WHEN buys AND k % 9 <> 0 THEN CAST(item_n AS BIGINT) END AS ecommerce_total_item_quantity,
  CASE WHEN buys AND k % 50 <> 49 THEN 'USD' END AS currency,
  CASE WHEN buys THEN CASE WHEN k % 2 = 0 THEN revenue WHEN k % 4 = 1 THEN k + 1.0 ELSE k END END AS event_value,
  CAST(item_n AS BIGINT) AS item_record_count, items_text AS items_json,
  CAST(NULL AS VARCHAR) AS gclid, CAST(NULL AS VARCHAR) AS gclsrc, CAST(NULL AS VARCHAR) AS dclid,
  'Yes' AS analytics_storage, CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS ads_storage,
  'No' AS uses_transient_token, buys AS is_purchase_event, true AS has_user_pseudo_id,
  true AS has_session_id, item_n > 0 AS has_item_records, false AS has_click_identifier
FROM clean
""",
)
step(
    "entries",
    """
SELECT event_name, u.key AS key, u.s AS s, u.i AS i, CAST(u.f AS DOUBLE) AS f
FROM (SELECT *, unnest([
  {key: 'ga_session_id', ok: true, s: CASE WHEN tail = 9 THEN CAST(sid AS VARCHAR) END,
   i: CASE WHEN tail <> 9 THEN sid END, f: CAST(NULL AS DOUBLE)},
  {key: 'ga_session_number', ok: true, s: NULL, i: day(d), f: NULL},
  {key: 'ga_session_number', ok: k % 17 = 0, s: NULL, i: 1, f: NULL},
  {key: 'session_engaged', ok: k % 6 <> 5, s: CASE WHEN k % 3 = 0 THEN '1' END,
   i: CASE WHEN k % 3 = 1 THEN 0 END, f: CASE WHEN k % 6 = 2 THEN 1.0 END},
  {key: 'engagement_time_msec', ok: k % 2 = 0, s: NULL, i: event_id % 1000, f: NULL},
  {key: 'source', ok: tail > 1, s: src, i: NULL, f: NULL},
  {key: 'medium', ok: tail > 1, s: med, i: NULL, f: NULL},
  {key: 'campaign', ok: tail > 1, s: camp, i: NULL, f: NULL},
  {key: 'page_location', ok: k % 7 <> 0, s: 'https://shop.example/p/' || k, i: NULL, f: NULL},
  {key: 'page_title', ok: k % 7 <> 0, s: 'Page ' || k, i: NULL, f: NULL},
  {key: 'currency', ok: buys AND k % 50 <> 49, s: 'USD', i: NULL, f: NULL},
  {key: 'value', ok: buys, s: CASE WHEN k % 4 = 1 THEN CAST(k + 1 AS VARCHAR) END,
   i: CASE WHEN k % 4 = 3 THEN k END, f: CASE WHEN k % 2 = 0 THEN revenue END},
  {key: 'transaction_id', ok: buys, s: CASE WHEN k % 4 <> 3 THEN raw_id END,
   i: CASE WHEN k % 4 = 3 THEN k END, f: NULL}
]) AS u FROM shaped) WHERE u.ok
""",
)

# ---- facts --------------------------------------------------------------------------------------

step("purchase_rows", "SELECT * FROM stg WHERE is_purchase_event")
step(
    "id_prof",
    """
SELECT transaction_id_normalized, count(*) AS transaction_id_purchase_event_rows,
  count(DISTINCT user_pseudo_id) AS transaction_id_distinct_users,
  count(DISTINCT ecommerce_purchase_revenue_in_usd) AS transaction_id_distinct_revenue_values
FROM purchase_rows WHERE transaction_id_status = 'VALID' GROUP BY ALL
""",
)
step(
    "keyed",
    """
SELECT *, CASE transaction_key_method
    WHEN 'RELIABLE_TRANSACTION_ID' THEN 'TRANSACTION_ID|' || transaction_id_normalized
    WHEN 'FALLBACK_CONFLICTING_TRANSACTION_ID' THEN 'CONFLICTING_ID|' || source_event_fingerprint
    WHEN 'FALLBACK_NOT_SET' THEN 'NOT_SET|' || source_event_fingerprint
    ELSE 'MISSING_ID|' || source_event_fingerprint END AS transaction_key
FROM (SELECT b.*, p.* EXCLUDE (transaction_id_normalized),
    CASE b.transaction_id_status WHEN 'NOT_SET' THEN 'FALLBACK_NOT_SET' WHEN 'MISSING' THEN 'FALLBACK_MISSING_ID'
      ELSE CASE WHEN p.transaction_id_distinct_users = 1 AND p.transaction_id_distinct_revenue_values <= 1
        THEN 'RELIABLE_TRANSACTION_ID' ELSE 'FALLBACK_CONFLICTING_TRANSACTION_ID' END END AS transaction_key_method
  FROM purchase_rows b LEFT JOIN id_prof p ON p.transaction_id_normalized = b.transaction_id_normalized)
""",
)
step(
    "tx",
    """
SELECT transaction_key, transaction_key_method, event_date AS transaction_date,
  event_timestamp_utc AS transaction_timestamp_utc, event_timestamp_micros AS transaction_timestamp_micros,
  source_event_fingerprint AS canonical_source_event_fingerprint, user_pseudo_id, ga_session_id,
  ga_session_number, session_key, transaction_id_raw, transaction_id_normalized, transaction_id_status,
  ecommerce_purchase_revenue_in_usd AS transaction_revenue_usd, currency AS transaction_currency,
  ecommerce_total_item_quantity AS transaction_item_quantity, item_record_count,
  count(*) OVER same AS measurement_event_rows, count(*) OVER same - 1 AS duplicate_measurement_rows,
  min(event_timestamp_utc) OVER same AS first_measurement_timestamp_utc,
  max(event_timestamp_utc) OVER same AS last_measurement_timestamp_utc,
  (max(event_timestamp_micros) OVER same - min(event_timestamp_micros) OVER same) // 1000000 AS measurement_span_seconds,
  transaction_id_purchase_event_rows, transaction_id_distinct_users, transaction_id_distinct_revenue_values,
  coalesce(transaction_id_distinct_users > 1, false) AS transaction_id_cross_user_conflict,
  coalesce(transaction_id_distinct_revenue_values > 1, false) AS transaction_id_revenue_conflict,
  NOT starts_with(transaction_key, 'TRANSACTION_ID|') AS uses_fallback_transaction_key,
  event_source, event_medium, event_campaign, first_user_source, first_user_medium, first_user_campaign,
  page_location, geo_country, geo_region, geo_city, device_category, device_operating_system, device_browser,
  analytics_storage, ads_storage, uses_transient_token
FROM keyed
WINDOW same AS (PARTITION BY transaction_key)
QUALIFY row_number() OVER (PARTITION BY transaction_key ORDER BY event_timestamp_micros, source_event_fingerprint) = 1
""",
)
FUNNEL = {
    "session_start_event_count": "session_start",
    "first_visit_event_count": "first_visit",
    "page_view_count": "page_view",
    "scroll_event_count": "scroll",
    "user_engagement_event_count": "user_engagement",
    "view_item_event_count": "view_item",
    "view_item_list_event_count": "view_item_list",
    "select_item_event_count": "select_item",
    "add_to_cart_event_count": "add_to_cart",
    "begin_checkout_event_count": "begin_checkout",
    "add_shipping_info_event_count": "add_shipping_info",
    "add_payment_info_event_count": "add_payment_info",
    "raw_purchase_measurement_event_count": "purchase",
}
_funnel = ",\n  ".join(f"count(*) FILTER (event_name = '{e}') AS {c}" for c, e in FUNNEL.items())
_first = [
    "first_user_source",
    "first_user_medium",
    "first_user_campaign",
    "geo_country",
    "geo_region",
    "geo_city",
    "device_category",
    "device_operating_system",
    "device_browser",
    "analytics_storage",
    "ads_storage",
    "uses_transient_token",
]
_at = "(event_timestamp_micros, event_bundle_sequence_id)"
step(
    "ses_raw",
    f"""
SELECT session_key, max(user_pseudo_id) AS user_pseudo_id, max(ga_session_id) AS ga_session_id,
  max(ga_session_number) AS ga_session_number, min(event_date) AS session_date,
  min(event_timestamp_utc) AS session_start_timestamp_utc, max(event_timestamp_utc) AS session_end_timestamp_utc,
  (max(event_timestamp_micros) - min(event_timestamp_micros)) // 1000000 AS session_duration_seconds,
  count(*) AS event_count, count(DISTINCT event_name) AS distinct_event_name_count,
  {_funnel},
  sum(coalesce(engagement_time_msec, 0)) AS total_engagement_time_msec,
  coalesce(bool_or(session_engaged), false) AS is_engaged_session,
  CAST(sum(item_record_count) AS BIGINT) AS item_interaction_record_count,
  list({{w: event_timestamp_utc, s: event_source, m: event_medium, c: event_campaign}} ORDER BY {_at})
    FILTER (coalesce(event_source, event_medium, event_campaign) IS NOT NULL)[1] AS acq,
  list({{{', '.join(f'{c}: {c}' for c in _first)}}} ORDER BY {_at})[1] AS head,
  list({{l: page_location, t: page_title}} ORDER BY {_at}) FILTER (page_location IS NOT NULL) AS pages
FROM stg GROUP BY session_key
""",
)
step(
    "ses_tx",
    """
SELECT session_key, count(*) AS canonical_transaction_count, sum(transaction_revenue_usd) AS canonical_revenue_usd,
  CAST(sum(coalesce(transaction_item_quantity, 0)) AS BIGINT) AS canonical_item_quantity,
  count(*) FILTER (uses_fallback_transaction_key) AS fallback_transaction_count,
  min(transaction_timestamp_utc) AS first_transaction_timestamp_utc,
  max(transaction_timestamp_utc) AS last_transaction_timestamp_utc
FROM tx GROUP BY session_key
""",
)
step(
    "ses",
    f"""
SELECT session_key, user_pseudo_id, ga_session_id, ga_session_number, session_date,
  session_start_timestamp_utc, session_end_timestamp_utc, session_duration_seconds,
  event_count, distinct_event_name_count, {', '.join(FUNNEL)},
  total_engagement_time_msec, total_engagement_time_msec / 1000 AS total_engagement_time_seconds,
  total_engagement_time_msec / (1000 * event_count) AS average_engagement_seconds_per_event,
  is_engaged_session, first_visit_event_count > 0 AS is_new_user_session, item_interaction_record_count,
  acq.w AS attribution_timestamp_utc, session_source, session_medium,
  coalesce(acq.c, '(not set)') AS session_campaign,
  CASE session_medium WHEN '(none)' THEN 'Direct' WHEN 'cpc' THEN 'Paid Search' WHEN 'organic' THEN 'Organic Search'
    WHEN 'email' THEN 'Email' WHEN 'affiliate' THEN 'Affiliate' WHEN 'referral' THEN 'Referral'
    ELSE 'Other' END AS session_channel_group,
  {', '.join(f'head.{c} AS {c}' for c in _first[:3])},
  pages[1].l AS entry_page_location, pages[1].t AS entry_page_title,
  pages[-1].l AS exit_page_location, pages[-1].t AS exit_page_title,
  coalesce(canonical_transaction_count, 0) AS canonical_transaction_count,
  coalesce(canonical_revenue_usd, 0) AS canonical_revenue_usd,
  coalesce(canonical_item_quantity, 0) AS canonical_item_quantity,
  canonical_revenue_usd / canonical_transaction_count AS average_order_value_usd,
  coalesce(fallback_transaction_count, 0) AS fallback_transaction_count,
  greatest(raw_purchase_measurement_event_count - coalesce(canonical_transaction_count, 0), 0)
    AS duplicate_purchase_measurement_rows,
  canonical_transaction_count IS NOT NULL AS is_converting_session,
  first_transaction_timestamp_utc, last_transaction_timestamp_utc,
  {', '.join(f'head.{c} AS {c}' for c in _first[3:])}
FROM (SELECT *, CASE WHEN acq IS NULL THEN '(direct)' ELSE acq.s END AS session_source,
        CASE WHEN acq IS NULL THEN '(none)' ELSE acq.m END AS session_medium FROM ses_raw)
LEFT JOIN ses_tx USING (session_key)
""",
)

LOOKBACK = 7
step(
    "pairs_in_window",
    f"""
SELECT t.transaction_key, t.transaction_key_method, t.transaction_id_status, t.transaction_date,
  t.transaction_timestamp_utc, t.user_pseudo_id, t.session_key AS transaction_session_key,
  t.ga_session_id AS transaction_ga_session_id, t.ga_session_number AS transaction_ga_session_number,
  t.transaction_revenue_usd, t.transaction_currency, t.transaction_item_quantity,
  t.item_record_count AS transaction_item_record_count, t.measurement_event_rows,
  t.duplicate_measurement_rows, t.uses_fallback_transaction_key,
  s.session_key AS touchpoint_session_key, s.ga_session_id AS touchpoint_ga_session_id,
  s.ga_session_number AS touchpoint_ga_session_number, s.session_date AS touchpoint_session_date,
  s.session_start_timestamp_utc AS touchpoint_start_timestamp_utc,
  s.session_end_timestamp_utc AS touchpoint_end_timestamp_utc,
  s.attribution_timestamp_utc AS touchpoint_attribution_timestamp_utc,
  s.session_duration_seconds AS touchpoint_duration_seconds, s.session_source AS touchpoint_source,
  s.session_medium AS touchpoint_medium, s.session_campaign AS touchpoint_campaign,
  s.session_channel_group AS touchpoint_channel_group, s.first_user_source, s.first_user_medium,
  s.first_user_campaign, s.event_count AS touchpoint_event_count,
  s.page_view_count AS touchpoint_page_view_count, s.view_item_event_count AS touchpoint_view_item_count,
  s.add_to_cart_event_count AS touchpoint_add_to_cart_count,
  s.begin_checkout_event_count AS touchpoint_begin_checkout_count,
  s.raw_purchase_measurement_event_count AS touchpoint_purchase_measurement_event_count,
  s.total_engagement_time_seconds AS touchpoint_engagement_seconds,
  s.is_engaged_session AS is_engaged_touchpoint, s.is_new_user_session AS is_new_user_touchpoint,
  s.entry_page_location AS touchpoint_entry_page_location, s.entry_page_title AS touchpoint_entry_page_title,
  s.geo_country AS touchpoint_geo_country, s.geo_region AS touchpoint_geo_region,
  s.geo_city AS touchpoint_geo_city, s.device_category AS touchpoint_device_category,
  s.device_operating_system AS touchpoint_operating_system, s.device_browser AS touchpoint_browser,
  s.analytics_storage AS touchpoint_analytics_storage, s.ads_storage AS touchpoint_ads_storage,
  s.uses_transient_token AS touchpoint_uses_transient_token,
  (SELECT min(session_date) FROM ses) AS source_data_start_date,
  (SELECT max(session_date) FROM ses) AS source_data_end_date,
  t.transaction_timestamp_utc - INTERVAL {LOOKBACK} DAY AS lookback_window_start_utc,
  t.transaction_timestamp_utc AS lookback_window_end_utc,
  (epoch_us(t.transaction_timestamp_utc) - epoch_us(s.session_start_timestamp_utc)) // 1000000
    AS seconds_before_transaction,
  t.transaction_date - s.session_date AS calendar_days_before_transaction,
  s.session_key = t.session_key AS is_conversion_session,
  s.session_channel_group = 'Direct' AS is_direct_touchpoint,
  t.transaction_date - {LOOKBACK} < (SELECT min(session_date) FROM ses) AS is_lookback_left_censored
FROM tx t JOIN ses s ON s.user_pseudo_id = t.user_pseudo_id
 AND s.session_start_timestamp_utc <= t.transaction_timestamp_utc
 AND s.session_start_timestamp_utc >= t.transaction_timestamp_utc - INTERVAL {LOOKBACK} DAY
""",
)
step(
    "bridge",
    """
SELECT *, touchpoint_position_asc = 1 AS is_first_touchpoint, touchpoint_position_desc = 1 AS is_last_touchpoint,
  coalesce(non_direct_touchpoint_position_asc = 1, false) AS is_first_non_direct_touchpoint,
  coalesce(non_direct_touchpoint_position_desc = 1, false) AS is_last_non_direct_touchpoint,
  coalesce(non_direct_touchpoint_position_desc = 1, false)
    OR (non_direct_touchpoint_count = 0 AND touchpoint_position_desc = 1) AS is_last_non_direct_attribution_touchpoint
FROM (SELECT *, count(*) OVER j AS touchpoint_count,
    count(*) FILTER (NOT is_direct_touchpoint) OVER j AS non_direct_touchpoint_count,
    row_number() OVER fwd AS touchpoint_position_asc, row_number() OVER bwd AS touchpoint_position_desc,
    CASE WHEN NOT is_direct_touchpoint THEN row_number() OVER (PARTITION BY transaction_key, is_direct_touchpoint
      ORDER BY touchpoint_start_timestamp_utc, touchpoint_session_key) END AS non_direct_touchpoint_position_asc,
    CASE WHEN NOT is_direct_touchpoint THEN row_number() OVER (PARTITION BY transaction_key, is_direct_touchpoint
      ORDER BY touchpoint_start_timestamp_utc DESC, touchpoint_session_key DESC) END AS non_direct_touchpoint_position_desc
  FROM pairs_in_window
  WINDOW j AS (PARTITION BY transaction_key),
    fwd AS (PARTITION BY transaction_key ORDER BY touchpoint_start_timestamp_utc, touchpoint_session_key),
    bwd AS (PARTITION BY transaction_key ORDER BY touchpoint_start_timestamp_utc DESC, touchpoint_session_key DESC))
""",
)
step(
    "credit",
    """
SELECT *, attribution_weight AS attributed_conversion_credit,
  transaction_revenue_usd * attribution_weight AS attributed_revenue_usd,
  NOT is_lookback_left_censored AS is_complete_lookback_window
FROM (
  SELECT 'first_touch' AS attribution_model, 1 AS attribution_model_order, 1e0 AS attribution_weight, *
    FROM bridge WHERE is_first_touchpoint
  UNION ALL BY NAME SELECT 'last_touch' AS attribution_model, 2 AS attribution_model_order,
    1e0 AS attribution_weight, * FROM bridge WHERE is_last_touchpoint
  UNION ALL BY NAME SELECT 'last_non_direct' AS attribution_model, 3 AS attribution_model_order,
    1e0 AS attribution_weight, * FROM bridge WHERE is_last_non_direct_attribution_touchpoint
  UNION ALL BY NAME SELECT 'linear' AS attribution_model, 4 AS attribution_model_order,
    1e0 / touchpoint_count AS attribution_weight, * FROM bridge
  UNION ALL BY NAME SELECT 'position_based' AS attribution_model, 5 AS attribution_model_order,
    CASE touchpoint_count WHEN 1 THEN 1e0 WHEN 2 THEN 5e-1 ELSE
      CASE WHEN touchpoint_position_asc IN (1, touchpoint_count) THEN 4e-1 ELSE 2e-1 / (touchpoint_count - 2) END
    END AS attribution_weight, * FROM bridge)
""",
)
step(
    "pops",
    """
SELECT * FROM (VALUES (1, 'all_observed', false), (2, 'complete_window', true))
  v(analysis_population_order, analysis_population, is_complete_window_population)
""",
)
step(
    "cells",
    """
SELECT p.*, m.attribution_model_order, m.attribution_model, ch.touchpoint_channel_group,
  count(c.transaction_key) AS credited_touchpoint_rows, count(DISTINCT c.transaction_key) AS credited_transactions,
  coalesce(sum(c.attributed_conversion_credit), 0) AS attributed_conversion_credit,
  coalesce(sum(c.attributed_revenue_usd), 0) AS attributed_revenue_usd
FROM pops p, (SELECT DISTINCT attribution_model_order, attribution_model FROM credit) m,
  (SELECT DISTINCT touchpoint_channel_group FROM credit) ch
LEFT JOIN credit c ON c.attribution_model = m.attribution_model
  AND c.touchpoint_channel_group = ch.touchpoint_channel_group
  AND (c.is_complete_lookback_window OR NOT p.is_complete_window_population)
GROUP BY ALL
""",
)
step(
    "mart",
    """
SELECT analysis_population_order, analysis_population, is_complete_window_population, attribution_model_order,
  attribution_model, touchpoint_channel_group, credited_touchpoint_rows, credited_transactions, cv AS attributed_conversion_credit,
  rv AS attributed_revenue_usd, rv / nullif(cv, 0) AS attributed_average_order_value_usd,
  tc AS model_total_attributed_conversions, tr AS model_total_attributed_revenue_usd,
  cv / nullif(tc, 0) AS model_conversion_share, rv / nullif(tr, 0) AS model_revenue_share,
  lc AS last_touch_attributed_conversions, lr AS last_touch_attributed_revenue_usd,
  cv - lc AS conversion_delta_vs_last_touch, rv - lr AS revenue_delta_vs_last_touch_usd,
  (cv - lc) / nullif(lc, 0) AS conversion_delta_pct_vs_last_touch,
  (rv - lr) / nullif(lr, 0) AS revenue_delta_pct_vs_last_touch,
  (rv - lr) / nullif(tr, 0) AS revenue_share_delta_vs_last_touch,
  nc AS last_non_direct_attributed_conversions, nr AS last_non_direct_attributed_revenue_usd,
  cv - nc AS conversion_delta_vs_last_non_direct, rv - nr AS revenue_delta_vs_last_non_direct_usd,
  row_number() OVER (PARTITION BY analysis_population, attribution_model
    ORDER BY round(rv, 9) DESC, touchpoint_channel_group) AS channel_revenue_rank_within_model
FROM (SELECT c.*, c.attributed_conversion_credit AS cv, c.attributed_revenue_usd AS rv,
    t.tc, t.tr, l.attributed_conversion_credit AS lc, l.attributed_revenue_usd AS lr,
    n.attributed_conversion_credit AS nc, n.attributed_revenue_usd AS nr
  FROM cells c
  JOIN (SELECT analysis_population, attribution_model, sum(attributed_conversion_credit) AS tc,
          sum(attributed_revenue_usd) AS tr FROM cells GROUP BY ALL) t USING (analysis_population, attribution_model)
  JOIN cells l ON l.attribution_model = 'last_touch' AND l.analysis_population = c.analysis_population
    AND l.touchpoint_channel_group = c.touchpoint_channel_group
  JOIN cells n ON n.attribution_model = 'last_non_direct' AND n.analysis_population = c.analysis_population
    AND n.touchpoint_channel_group = c.touchpoint_channel_group)
""",
)

ORACLES: dict[str, str] = {}

# ---- sources ------------------------------------------------------------------------------------

ORACLES["read_events_pruned"] = query(
    "SELECT suffix AS event_date, count(*) AS event_count, count(DISTINCT uid) AS unique_pseudo_users "
    "FROM shaped WHERE suffix BETWEEN '20240108' AND '20240121' GROUP BY suffix"
)
ORACLES["register_views"] = fin(
    "SELECT event_name, count(*) AS event_rows, sum(item_n) AS nested_items, "
    "(SELECT sum(item_n) FROM ev) AS all_item_rows FROM ev GROUP BY event_name",
    ints="nested_items all_item_rows",
)

# Path -> type and condition on the flat events (or, for items, on the lines of an event).
_paths = {
    "event_date": ("string", "true"),
    "event_timestamp": ("bigint", "true"),
    "event_name": ("string", "true"),
    "user_pseudo_id": ("string", "true"),
    "event_bundle_sequence_id": ("bigint", "true"),
    "event_server_timestamp_offset": ("bigint", "k % 5 <> 0"),
    "platform": ("string", "true"),
    "event_params.key": ("string", "true"),
    "event_params.value.string_value": (
        "string",
        "tail = 9 OR k % 3 = 0 OR tail > 1 OR k % 7 <> 0 OR (buys AND (k % 50 <> 49 OR k % 4 = 1))"
        " OR (buys AND k % 4 <> 3 AND raw_id IS NOT NULL)",
    ),
    "event_params.value.int_value": ("bigint", "true"),
    "event_params.value.float_value": ("double", "false"),
    "event_params.value.double_value": ("double", "k % 6 = 2 OR (buys AND k % 2 = 0)"),
    "traffic_source.name": ("string", "user_id % 4 = 1"),
    "traffic_source.medium": ("string", "user_id % 4 <> 0"),
    "traffic_source.source": ("string", "user_id % 4 <> 0"),
    "ecommerce.transaction_id": ("string", "raw_id IS NOT NULL"),
    "ecommerce.purchase_revenue": ("double", "buys"),
    "ecommerce.purchase_revenue_in_usd": ("double", "buys"),
    "ecommerce.total_item_quantity": ("bigint", "buys AND k % 9 <> 0"),
    "geo.country": ("string", "user_id % 10 = 0 OR r_name IS NOT NULL"),
    "geo.region": ("string", "user_id % 10 = 0 OR n_name IS NOT NULL"),
    "geo.city": ("string", "c_mktsegment IS NOT NULL"),
    "device.category": ("string", "true"),
    "device.operating_system": ("string", "true"),
    "device.web_info.browser": ("string", "true"),
    "privacy_info.analytics_storage": ("string", "true"),
    "privacy_info.ads_storage": ("string", "true"),
    "privacy_info.uses_transient_token": ("string", "true"),
}
_item_paths = {
    "item_id": "string",
    "item_name": "string",
    "item_brand": "string",
    "item_variant": "string",
    "item_category": "string",
    "price": "double",
    "price_in_usd": "double",
    "quantity": "bigint",
    "item_revenue": "double",
    "item_revenue_in_usd": "double",
}
_schema_rows = [
    f"SELECT '{p}' AS required_field_path, '{t}' AS data_type, 'AVAILABLE' AS schema_status, "
    # Events from the 16th on come in a shard without device and privacy settings.
    f"count(*) FILTER (({cond}){" AND suffix < '20240116'" if p.startswith(('device', 'privacy_info')) else ''}) AS populated_rows FROM shaped"
    for p, (t, cond) in _paths.items()
] + [
    f"SELECT 'items.{c}', '{t}', 'AVAILABLE', count(DISTINCT event_id) FILTER ({c} IS NOT NULL) "
    "FROM line_rows SEMI JOIN events USING (event_id)"
    for c, t in _item_paths.items()
]
ORACLES["verify_schema"] = query(
    " UNION ALL ".join(_schema_rows + ["SELECT 'app_info.version', NULL, 'MISSING', 0"])
)

# ---- profiling ----------------------------------------------------------------------------------

ORACLES["dataset_overview"] = fin(
    "SELECT count(*) AS event_count, count(DISTINCT uid) AS unique_pseudo_users, count(DISTINCT d) AS active_dates, "
    "min(d) AS first_event_date, max(d) AS last_event_date, count(DISTINCT event_name) AS distinct_event_names, "
    "count(*) FILTER (buys) AS purchase_event_count FROM shaped",
    dates="first_event_date last_event_date",
)
ORACLES["event_name_profile"] = fin(
    "SELECT event_name, count(*) AS event_count, count(DISTINCT uid) AS unique_pseudo_users, "
    "round(100e0 * count(*) / (SELECT count(*) FROM events), 2) AS event_share_pct, "
    "round(100e0 * count(DISTINCT uid) / (SELECT count(DISTINCT user_id) FROM events), 2) AS user_reach_pct, "
    "min(d) AS first_event_date, max(d) AS last_event_date FROM shaped GROUP BY event_name",
    dates="first_event_date last_event_date",
)
ORACLES["parameter_profile"] = fin(
    """
SELECT key AS parameter_key, count(*) AS parameter_occurrences,
  count(DISTINCT event_name) AS event_types_using_parameter, list_sort(list(DISTINCT event_name)) AS event_names,
  CASE WHEN count(s) > 0 AND count(i) + count(f) = 0 THEN 'STRING' WHEN count(i) > 0 AND count(s) + count(f) = 0
    THEN 'INTEGER' WHEN count(f) > 0 AND count(s) + count(i) = 0 THEN 'DOUBLE'
    WHEN count(s) + count(i) + count(f) = 0 THEN 'NULL_ONLY' ELSE 'MIXED' END AS observed_value_type,
  count(s) AS string_value_rows, count(i) AS int_value_rows, 0 AS float_value_rows, count(f) AS double_value_rows,
  count(*) FILTER (s IS NULL AND i IS NULL AND f IS NULL) AS null_value_rows,
  list_sort(list(DISTINCT v) FILTER (v IS NOT NULL))[:3] AS sample_values
FROM (SELECT *, coalesce(s, CAST(i AS VARCHAR), CAST(CAST(f AS BIGINT) AS VARCHAR)) AS v FROM entries) GROUP BY key
""",
    lists="event_names sample_values",
    ints="float_value_rows",
)
ORACLES["purchase_quality"] = fin(
    """
SELECT count(*) AS purchase_event_count, count(DISTINCT uid) AS unique_purchase_users,
  count(sid) AS purchase_events_with_session_id, count(bare_id) AS purchase_events_with_ecommerce_transaction_id,
  count(p) AS purchase_events_with_parameter_transaction_id, count(DISTINCT p) AS distinct_parameter_transaction_ids,
  count(*) FILTER (bare_id = p) AS matching_transaction_id_events,
  count(*) FILTER (bare_id <> p) AS mismatched_transaction_id_events,
  count(revenue) AS purchase_events_with_ecommerce_revenue, round(sum(revenue), 2) AS raw_ecommerce_purchase_revenue,
  count(revenue) AS purchase_events_with_usd_revenue, round(sum(revenue), 2) AS raw_purchase_revenue_in_usd,
  count(v) AS purchase_events_with_parameter_value,
  count(*) FILTER (abs(revenue - v) <= 0.01) AS matching_revenue_value_events,
  count(*) FILTER (abs(revenue - v) > 0.01) AS mismatched_revenue_value_events,
  count(*) FILTER (k % 50 <> 49) AS purchase_events_with_currency, 'USD' AS currencies_observed,
  count(*) FILTER (k % 9 <> 0) AS purchase_events_with_item_quantity,
  count(*) FILTER (item_n > 0) AS purchase_events_with_item_records,
  count(DISTINCT bare_id) AS distinct_ecommerce_transaction_ids,
  (SELECT count(*) FROM (SELECT 1 FROM clean WHERE bare_id IS NOT NULL GROUP BY bare_id HAVING count(*) > 1))
    AS duplicated_transaction_ids,
  count(bare_id) - count(DISTINCT bare_id) AS excess_purchase_event_rows
FROM (SELECT *, CASE WHEN k % 4 = 3 THEN CAST(k AS VARCHAR) ELSE bare_id END AS p,
        CASE WHEN k % 2 = 0 THEN revenue WHEN k % 4 = 1 THEN k + 1e0 ELSE k END AS v FROM clean WHERE buys)
"""
)
ORACLES["duplicate_transaction_patterns"] = fin(
    """
SELECT transaction_pattern, count(bare_id) AS transaction_id_groups, sum(n) AS purchase_event_rows,
  sum(CASE WHEN bare_id IS NULL THEN 0 ELSE n - 1 END) AS excess_purchase_event_rows,
  round(avg(n) FILTER (bare_id IS NOT NULL), 2) AS average_event_rows_per_transaction_id,
  max(n) FILTER (bare_id IS NOT NULL) AS maximum_event_rows_for_one_transaction_id,
  max(span) AS maximum_event_span_seconds,
  (list(bare_id ORDER BY n DESC, bare_id) FILTER (bare_id IS NOT NULL))[:5] AS sample_transaction_ids
FROM (SELECT bare_id, count(*) AS n, (max(micros) - min(micros)) // 1000000 AS span,
    CASE WHEN bare_id IS NULL THEN 'MISSING_TRANSACTION_ID' WHEN count(*) = 1 THEN 'UNIQUE_TRANSACTION_ID'
      WHEN count(DISTINCT uid) > 1 THEN 'ID_REUSED_ACROSS_USERS'
      WHEN count(DISTINCT revenue) > 1 THEN 'SAME_ID_DIFFERENT_REVENUE'
      WHEN count(DISTINCT micros) = 1 THEN 'SAME_ID_SAME_TIMESTAMP'
      WHEN count(DISTINCT (uid, sid)) = 1 THEN 'SAME_ID_REPEATED_WITHIN_SESSION'
      ELSE 'SAME_ID_REPEATED_ACROSS_SESSIONS' END AS transaction_pattern
  FROM clean WHERE buys GROUP BY bare_id) GROUP BY transaction_pattern
""",
    ints="purchase_event_rows excess_purchase_event_rows",
    lists="sample_transaction_ids",
)
step(
    "signed",
    """
SELECT *, lower(bare_id) = '(not set)' AS unset,
  concat_ws('~', uid, sid, micros, coalesce(CAST(revenue AS VARCHAR), '?'), items_text) AS sig
FROM clean WHERE buys
""",
)


def _key_report(method: str, keys: str, relation: str) -> str:
    return f"""
SELECT {method}, count(*) AS {keys}, sum(n) AS purchase_event_rows,
  round(100e0 * sum(n) / (SELECT count(*) FROM signed), 2) AS purchase_event_share_pct,
  count(*) FILTER (n > 1) AS duplicated_candidate_keys, sum(n - 1) AS excess_purchase_event_rows,
  count(*) FILTER (users > 1) AS cross_user_candidate_keys,
  count(*) FILTER (revenues > 1) AS conflicting_revenue_candidate_keys,
  max(n) AS maximum_event_rows_for_one_candidate_key
FROM (SELECT {method}, key, count(*) AS n, count(DISTINCT uid) AS users, count(DISTINCT revenue) AS revenues
  FROM ({relation}) GROUP BY ALL) GROUP BY {method}
"""


ORACLES["candidate_key_profile"] = fin(
    _key_report(
        "transaction_key_method",
        "candidate_transaction_keys",
        "SELECT *, CASE WHEN bare_id IS NULL THEN 'FALLBACK_SIGNATURE_MISSING_ID' WHEN unset "
        "THEN 'FALLBACK_SIGNATURE_NOT_SET' ELSE 'VALID_TRANSACTION_ID' END AS transaction_key_method, "
        "CASE WHEN bare_id IS NULL OR unset THEN sig ELSE bare_id END AS key FROM signed",
    ),
    ints="purchase_event_rows excess_purchase_event_rows",
)
ORACLES["final_key_profile"] = fin(
    _key_report(
        "final_key_method",
        "final_candidate_transaction_keys",
        "SELECT *, CASE WHEN bare_id IS NULL THEN 'FALLBACK_MISSING_ID' WHEN unset THEN 'FALLBACK_NOT_SET' "
        "WHEN sound THEN 'RELIABLE_TRANSACTION_ID' ELSE 'FALLBACK_CONFLICTING_TRANSACTION_ID' END AS final_key_method, "
        "CASE WHEN sound AND NOT unset THEN bare_id ELSE sig END AS key FROM signed LEFT JOIN "
        "(SELECT bare_id, count(DISTINCT uid) = 1 AND count(DISTINCT revenue) = 1 AS sound FROM signed "
        "WHERE bare_id IS NOT NULL GROUP BY bare_id) USING (bare_id)",
    ),
    ints="purchase_event_rows excess_purchase_event_rows",
)

# ---- staging ------------------------------------------------------------------------------------

ORACLES["extract_params"] = fin(
    "SELECT event_bundle_sequence_id, ga_session_id, ga_session_number, CASE WHEN session_engaged THEN '1' "
    "WHEN NOT session_engaged THEN '0' END AS session_engaged_raw, engagement_time_msec, engaged_session_event, "
    "debug_mode, event_source, event_medium, event_campaign, page_location, page_title, page_referrer, currency, "
    "event_value, gclid, gclsrc, dclid FROM stg",
    floats="event_value engagement_time_msec",
)
ORACLES["event_fingerprint"] = query(
    "SELECT source_event_fingerprint, event_bundle_sequence_id FROM stg"
)
ORACLES["session_key"] = query(
    "SELECT event_bundle_sequence_id, session_key, has_user_pseudo_id, has_session_id FROM stg"
)
ORACLES["transaction_id_status"] = query(
    "SELECT event_bundle_sequence_id, transaction_id_raw, transaction_id_normalized, transaction_id_status FROM stg"
)
ORACLES["stage_events"] = fin(
    "SELECT * FROM stg",
    dates="event_date",
    stamps="event_timestamp_utc",
    floats="engagement_time_msec event_value",
)
step(
    "stg_items",
    """
SELECT sha256(s.source_event_fingerprint || '|' || l.pos) AS item_record_fingerprint, s.source_event_fingerprint,
  l.pos AS item_offset, s.source_table_suffix, s.event_date, s.event_timestamp_utc, s.event_timestamp_micros,
  s.event_name, s.event_bundle_sequence_id, s.event_server_timestamp_offset, s.platform, s.user_pseudo_id,
  s.ga_session_id, s.ga_session_number, s.session_key, s.transaction_id_raw, s.transaction_id_normalized,
  s.transaction_id_status, s.is_purchase_event, s.ecommerce_purchase_revenue_in_usd AS event_purchase_revenue_in_usd,
  s.ecommerce_total_item_quantity AS event_total_item_quantity, s.currency, l.item_id, l.item_id AS item_id_normalized,
  l.item_name, ltrim(l.item_name) AS item_name_normalized,
  coalesce('ID:' || l.item_id, 'NAME:' || ltrim(l.item_name)) AS item_identity, l.item_brand, l.item_variant,
  l.item_category, l.price AS item_price, l.price_in_usd AS item_price_in_usd, l.quantity AS item_quantity,
  l.item_revenue, l.item_revenue_in_usd, l.price_in_usd * l.quantity AS calculated_item_value_in_usd,
  s.event_source, s.event_medium, s.event_campaign, s.first_user_source, s.first_user_medium, s.first_user_campaign,
  s.geo_country, s.geo_region, s.geo_city, s.device_category, s.device_operating_system, s.device_browser,
  s.analytics_storage, s.ads_storage, s.uses_transient_token, l.item_id IS NOT NULL AS has_item_id,
  l.item_name IS NOT NULL AS has_item_name, true AS has_session_id
FROM stg s JOIN line_rows l ON l.event_id = s.event_bundle_sequence_id
""",
)
ORACLES["stage_items"] = fin(
    "SELECT * FROM stg_items",
    dates="event_date",
    stamps="event_timestamp_utc",
    floats="item_price item_revenue item_price_in_usd item_revenue_in_usd calculated_item_value_in_usd",
)

# ---- transactions and sessions ------------------------------------------------------------------

_id_profile = (
    "transaction_id_purchase_event_rows, transaction_id_distinct_users, transaction_id_distinct_revenue_values"
)
ORACLES["transaction_id_profile"] = query("SELECT * FROM id_prof")
ORACLES["classify_key_method"] = query(
    f"SELECT source_event_fingerprint, transaction_key_method, {_id_profile} FROM keyed"
)
ORACLES["classify_key_method_hot"] = ORACLES["classify_key_method"]
ORACLES["assign_transaction_key"] = query(
    "SELECT source_event_fingerprint, transaction_key_method, transaction_key FROM keyed"
)
ORACLES["fct_transactions"] = fin(
    "SELECT * FROM tx",
    dates="transaction_date",
    stamps="transaction_timestamp_utc first_measurement_timestamp_utc last_measurement_timestamp_utc",
)
ORACLES["sessionize"] = fin(
    "SELECT * EXCLUDE (acq, head, pages), acq.s AS acquisition_source, acq.m AS acquisition_medium, "
    "acq.c AS acquisition_campaign, pages[1].l AS entry_page_location, pages[-1].l AS exit_page_location FROM ses_raw",
    dates="session_date",
    stamps="session_start_timestamp_utc session_end_timestamp_utc",
)
ORACLES["transactions_by_session"] = fin(
    "SELECT * FROM ses_tx", stamps="first_transaction_timestamp_utc last_transaction_timestamp_utc"
)
ORACLES["session_source_medium"] = query(
    "SELECT session_key, session_source, session_medium, session_campaign FROM ses"
)
ORACLES["channel_group"] = query(
    "SELECT session_source, session_medium, session_channel_group, count(*) AS session_rows FROM ses GROUP BY ALL"
)
ORACLES["fct_sessions"] = fin(
    "SELECT * FROM ses",
    dates="session_date",
    stamps="session_start_timestamp_utc session_end_timestamp_utc attribution_timestamp_utc "
    "first_transaction_timestamp_utc last_transaction_timestamp_utc",
    floats="total_engagement_time_msec total_engagement_time_seconds average_engagement_seconds_per_event "
    "canonical_revenue_usd average_order_value_usd",
)
ORACLES["session_build_summary"] = fin(
    "SELECT count(*) AS session_rows, count(DISTINCT user_pseudo_id) AS unique_users, "
    "sum(event_count) AS represented_event_rows, count(*) FILTER (is_converting_session) AS converting_sessions, "
    "sum(canonical_transaction_count) AS canonical_transactions, sum(canonical_revenue_usd) AS canonical_revenue_usd, "
    "sum(duplicate_purchase_measurement_rows) AS duplicate_purchase_measurement_rows FROM ses",
    ints="represented_event_rows canonical_transactions duplicate_purchase_measurement_rows",
)

# ---- attribution --------------------------------------------------------------------------------

_bridge_dates = "transaction_date touchpoint_session_date source_data_start_date source_data_end_date"
_bridge_stamps = (
    "transaction_timestamp_utc touchpoint_start_timestamp_utc touchpoint_end_timestamp_utc "
    "lookback_window_start_utc lookback_window_end_utc"
)
_more_stamps = _bridge_stamps + " touchpoint_attribution_timestamp_utc"
_secs = "touchpoint_engagement_seconds"
ORACLES["eligible_touchpoints"] = fin(
    "SELECT * FROM pairs_in_window", dates=_bridge_dates, stamps=_more_stamps, floats=_secs
)
ORACLES["eligible_touchpoints_cut"] = ORACLES["eligible_touchpoints"]
ORACLES["rank_touchpoints"] = query(
    "SELECT transaction_key, touchpoint_session_key, touchpoint_count, non_direct_touchpoint_count, "
    "touchpoint_position_asc, touchpoint_position_desc, non_direct_touchpoint_position_asc, "
    "non_direct_touchpoint_position_desc FROM bridge"
)
ORACLES["bridge_touchpoints"] = fin(
    "SELECT * FROM bridge", dates=_bridge_dates, stamps=_more_stamps, floats=_secs
)
ORACLES["bridge_summary"] = fin(
    "SELECT count(*) AS bridge_row_count, count(*) FILTER (is_last_touchpoint) AS represented_transactions, "
    "count(DISTINCT user_pseudo_id) AS represented_users, "
    "round(count(*) / count(*) FILTER (is_last_touchpoint), 2) AS average_touchpoints_per_transaction, "
    "max(touchpoint_count) AS maximum_touchpoints_for_one_transaction, "
    "count(*) FILTER (is_last_touchpoint AND touchpoint_count > 1) AS multi_touch_transactions, "
    "count(*) FILTER (is_last_touchpoint AND non_direct_touchpoint_count = 0) AS direct_only_transactions, "
    "count(*) FILTER (is_last_touchpoint AND is_lookback_left_censored) AS left_censored_transactions, "
    "sum(transaction_revenue_usd) FILTER (is_last_touchpoint) AS represented_canonical_revenue_usd FROM bridge"
)
ORACLES["attribution_credits"] = fin(
    "SELECT * EXCLUDE (touchpoint_attribution_timestamp_utc, touchpoint_duration_seconds, first_user_source, "
    "first_user_medium, first_user_campaign, touchpoint_purchase_measurement_event_count, "
    "non_direct_touchpoint_position_asc, non_direct_touchpoint_position_desc) FROM credit",
    dates=_bridge_dates,
    stamps=_bridge_stamps,
    floats=f"{_secs} attribution_weight attributed_conversion_credit attributed_revenue_usd",
)
ORACLES["credit_summary"] = query(
    "SELECT attribution_model_order, attribution_model, count(*) AS credit_row_count, "
    "count(DISTINCT transaction_key) AS represented_transactions, count(DISTINCT user_pseudo_id) AS represented_users, "
    "count(DISTINCT transaction_key) FILTER (is_complete_lookback_window) AS complete_window_transactions, "
    "round(sum(attributed_conversion_credit), 6) AS attributed_conversions, "
    "round(sum(attributed_revenue_usd), 2) AS attributed_revenue_usd, "
    "round(sum(attributed_revenue_usd) FILTER (is_complete_lookback_window), 2) "
    "AS complete_window_attributed_revenue_usd FROM credit GROUP BY ALL"
)
_mart_floats = (
    "attributed_conversion_credit attributed_revenue_usd attributed_average_order_value_usd "
    "model_total_attributed_conversions model_total_attributed_revenue_usd model_conversion_share model_revenue_share "
    "last_touch_attributed_conversions last_touch_attributed_revenue_usd conversion_delta_vs_last_touch "
    "revenue_delta_vs_last_touch_usd conversion_delta_pct_vs_last_touch revenue_delta_pct_vs_last_touch "
    "revenue_share_delta_vs_last_touch last_non_direct_attributed_conversions last_non_direct_attributed_revenue_usd "
    "conversion_delta_vs_last_non_direct revenue_delta_vs_last_non_direct_usd"
)
ORACLES["channel_comparison"] = fin("SELECT * FROM mart", floats=_mart_floats)
ORACLES["comparison_summary"] = fin(
    "SELECT analysis_population_order, analysis_population, attribution_model_order, attribution_model, "
    "count(*) AS represented_channels, round(sum(attributed_conversion_credit), 6) AS attributed_conversions, "
    "round(sum(attributed_revenue_usd), 2) AS attributed_revenue_usd, "
    "round(sum(model_conversion_share), 6) AS conversion_share_sum, "
    "round(sum(model_revenue_share), 6) AS revenue_share_sum, "
    "round(sum(abs(revenue_delta_vs_last_touch_usd)) / 2, 2) AS revenue_reallocated_vs_last_touch_usd, "
    "round(sum(attributed_revenue_usd) FILTER (touchpoint_channel_group = 'Direct'), 2) "
    "AS direct_attributed_revenue_usd FROM mart GROUP BY ALL",
    floats="revenue_reallocated_vs_last_touch_usd",
)


def _shift_side(side: str, a: str, b: str) -> str:
    """Columns of one population: a is the model's row, b the row of last touch."""
    return f"""
  round({a}.attributed_revenue_usd, 2) AS {side}_model_revenue_usd,
  round({b}.attributed_revenue_usd, 2) AS {side}_last_touch_revenue_usd,
  round({a}.revenue_delta_vs_last_touch_usd, 2) + 0e0 AS {side}_revenue_delta_vs_last_touch_usd,
  round({a}.revenue_delta_pct_vs_last_touch, 6) + 0e0 AS {side}_relative_revenue_delta_vs_last_touch,
  round({a}.model_revenue_share, 6) AS {side}_model_revenue_share,
  round({b}.model_revenue_share, 6) AS {side}_last_touch_revenue_share,
  round({a}.model_revenue_share - {b}.model_revenue_share, 6) + 0e0 AS {side}_revenue_share_delta_vs_last_touch,
  {a}.channel_revenue_rank_within_model AS {side}_model_revenue_rank,
  {b}.channel_revenue_rank_within_model AS {side}_last_touch_revenue_rank,
  {a}.channel_revenue_rank_within_model - {b}.channel_revenue_rank_within_model
    AS {side}_revenue_rank_change_vs_last_touch"""


ORACLES["channel_shift"] = query(
    f"""
SELECT f.attribution_model_order, f.attribution_model, f.touchpoint_channel_group,
  {_shift_side('full', 'f', 'fb')}, {_shift_side('complete', 'c', 'cb')},
  round(x, 6) + 0e0 AS full_delta_share_of_population_revenue,
  round(y, 6) + 0e0 AS complete_delta_share_of_population_revenue,
  round(y - x, 6) + 0e0 AS normalized_delta_change_between_populations,
  reading <> 'Direction changes across populations' AS attribution_direction_consistent,
  reading AS directional_interpretation
FROM mart f
JOIN mart c USING (attribution_model, touchpoint_channel_group)
JOIN mart fb USING (touchpoint_channel_group)
JOIN mart cb USING (touchpoint_channel_group),
LATERAL (SELECT f.revenue_delta_vs_last_touch_usd / f.model_total_attributed_revenue_usd AS x,
  c.revenue_delta_vs_last_touch_usd / c.model_total_attributed_revenue_usd AS y,
  CASE WHEN abs(f.revenue_delta_vs_last_touch_usd) < 0.01 AND abs(c.revenue_delta_vs_last_touch_usd) < 0.01
      THEN 'No material difference from last touch'
    WHEN sign(f.revenue_delta_vs_last_touch_usd) + sign(c.revenue_delta_vs_last_touch_usd) = 2
      THEN 'Potentially undervalued by last touch'
    WHEN sign(f.revenue_delta_vs_last_touch_usd) + sign(c.revenue_delta_vs_last_touch_usd) = -2
      THEN 'Potentially overvalued by last touch'
    ELSE 'Direction changes across populations' END AS reading)
WHERE f.attribution_model <> 'last_touch' AND f.analysis_population = 'all_observed'
  AND c.analysis_population = 'complete_window' AND fb.analysis_population = 'all_observed'
  AND cb.analysis_population = 'complete_window' AND fb.attribution_model = 'last_touch'
  AND cb.attribution_model = 'last_touch'
"""
)

# ---- geo panel ----------------------------------------------------------------------------------

START, PRE_END, TEST_START, END = "1995-01-01", "1999-12-25", "1999-12-26", "2001-08-04"
GEO_LIMITS = {"weeks": 180, "sessions": 345, "transactions": 262, "revenue": 66_500_000, "cv": 1.15}


def _geo_sessions(country: str) -> str:
    return f"""
SELECT CAST(o_orderkey AS VARCHAR) AS session_key, CAST(o_custkey AS VARCHAR) AS user_pseudo_id,
  CAST(o_orderdate AS DATE) AS session_date,
  CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week_start_date,
  CASE WHEN o_custkey % 40 = 7 THEN '(not set)' ELSE {country} END AS geo_country,
  CASE WHEN o_custkey % 30 = 3 THEN 'Unknown' ELSE n_name END AS geo_region,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_engaged_session, o_orderstatus = 'O' AS is_new_user_session,
  o_orderkey % 7 AS view_item_event_count, o_orderkey % 3 AS add_to_cart_event_count,
  o_orderkey % 2 AS begin_checkout_event_count,
  CAST(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS BIGINT) AS canonical_transaction_count,
  CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) ELSE 0 END AS canonical_revenue_usd,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 + 1 ELSE 0 END AS canonical_item_quantity,
  o_custkey % 40 <> 7 AND o_custkey % 30 <> 3 AS is_valid_geography
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
WHERE o_orderdate >= DATE '{START}' AND o_orderdate < DATE '{END}' + 1
"""


step("places", _geo_sessions("r_name"))
step("world", _geo_sessions("'World'"))
step(
    "weeks",
    f"""
SELECT CAST(w AS DATE) AS week_start_date, CASE WHEN w <= DATE '{PRE_END}' THEN 'PRE' ELSE 'TEST' END AS period_name
FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 7 DAY) g(w)
""",
)
step(
    "place_weeks",
    """
SELECT u.geo_country, u.geo_region, w.week_start_date, w.period_name, count(p.session_key) AS session_count,
  count(DISTINCT p.user_pseudo_id) AS weekly_unique_users,
  coalesce(sum(p.canonical_transaction_count), 0) AS canonical_transaction_count,
  coalesce(sum(p.canonical_revenue_usd), 0) AS canonical_revenue_usd
FROM (SELECT DISTINCT geo_country, geo_region FROM places WHERE is_valid_geography) u CROSS JOIN weeks w
LEFT JOIN places p ON p.geo_country = u.geo_country AND p.geo_region = u.geo_region
  AND p.week_start_date = w.week_start_date AND p.is_valid_geography
GROUP BY ALL
""",
)


def _reason(sessions: str, transactions: str) -> str:
    g = GEO_LIMITS
    return f"""
CASE WHEN pre_active_session_weeks < {g['weeks']} THEN 'INSUFFICIENT_ACTIVE_WEEKS'
  WHEN {sessions} < {g['sessions']} THEN 'INSUFFICIENT_PRE_SESSIONS'
  WHEN {transactions} < {g['transactions']} THEN 'INSUFFICIENT_PRE_TRANSACTIONS'
  WHEN pre_revenue_usd < {g['revenue']} THEN 'INSUFFICIENT_PRE_REVENUE'
  WHEN pre_revenue_coefficient_of_variation IS NULL THEN 'UNDEFINED_PRE_REVENUE_VARIATION'
  WHEN pre_revenue_coefficient_of_variation > {g['cv']} THEN 'UNSTABLE_PRE_REVENUE' ELSE 'ELIGIBLE' END"""


step(
    "place_profile",
    f"""
SELECT *, eligibility_status = 'ELIGIBLE' AS meets_initial_eligibility FROM (
SELECT *, {_reason('pre_sessions', 'pre_transactions')} AS eligibility_status FROM (
SELECT *, pre_transactions / nullif(pre_sessions, 0) AS pre_transaction_rate,
  pre_revenue_usd / nullif(pre_sessions, 0) AS pre_revenue_per_session_usd,
  pre_weekly_revenue_stddev_usd / nullif(pre_average_weekly_revenue_usd, 0) AS pre_revenue_coefficient_of_variation
FROM (
SELECT geo_country, geo_region, geo_country || ' | ' || geo_region AS geo_key, count(*) AS total_panel_weeks,
  count(*) FILTER (pre AND session_count > 0) AS pre_active_session_weeks,
  count(*) FILTER (pre AND canonical_transaction_count > 0) AS pre_transaction_active_weeks,
  CAST(sum(session_count) FILTER (pre) AS BIGINT) AS pre_sessions,
  CAST(sum(canonical_transaction_count) FILTER (pre) AS BIGINT) AS pre_transactions,
  sum(canonical_revenue_usd) FILTER (pre) AS pre_revenue_usd,
  avg(canonical_revenue_usd) FILTER (pre) AS pre_average_weekly_revenue_usd,
  stddev_samp(canonical_revenue_usd) FILTER (pre) AS pre_weekly_revenue_stddev_usd,
  count(*) FILTER (pre AND canonical_revenue_usd = 0) AS pre_zero_revenue_weeks,
  count(*) FILTER (NOT pre AND session_count > 0) AS test_active_session_weeks,
  CAST(sum(session_count) FILTER (NOT pre) AS BIGINT) AS test_sessions,
  CAST(sum(canonical_transaction_count) FILTER (NOT pre) AS BIGINT) AS test_transactions,
  sum(canonical_revenue_usd) FILTER (NOT pre) AS test_revenue_usd
FROM (SELECT *, period_name = 'PRE' AS pre FROM place_weeks) GROUP BY ALL)
JOIN (SELECT geo_country, geo_region, count(DISTINCT user_pseudo_id) AS distinct_users FROM places
  WHERE is_valid_geography GROUP BY ALL) USING (geo_country, geo_region)))
""",
)
step("target", "SELECT * FROM world WHERE geo_country = 'World' AND geo_region <> 'Unknown'")
_rate = "observed_transaction_count / nullif(observed_session_count, 0)"
step(
    "outcome",
    f"""
SELECT *, eligibility_status = 'ELIGIBLE' AS meets_initial_eligibility, 'PUBLIC_GA4_OBSERVED' AS data_origin,
  'UNASSIGNED' AS treatment_assignment_status, false AS is_synthetic_outcome FROM (
SELECT *, {_reason('pre_session_count', 'pre_transaction_count')} AS eligibility_status FROM (
SELECT *, pre_transaction_count / nullif(pre_session_count, 0) AS pre_transaction_rate,
  pre_revenue_usd / nullif(pre_session_count, 0) AS pre_revenue_per_session_usd,
  pre_weekly_revenue_stddev_usd / nullif(pre_average_weekly_revenue_usd, 0) AS pre_revenue_coefficient_of_variation,
  observed_engaged_sessions / nullif(observed_session_count, 0) AS observed_engagement_rate,
  {_rate} AS observed_transaction_rate,
  observed_revenue_usd / nullif(observed_session_count, 0) AS observed_revenue_per_session_usd,
  observed_revenue_usd / nullif(observed_transaction_count, 0) AS observed_average_order_value_usd
FROM (
SELECT *, count(*) FILTER (pre AND observed_session_count > 0) OVER r AS pre_active_session_weeks,
  count(*) FILTER (pre AND observed_transaction_count > 0) OVER r AS pre_transaction_active_weeks,
  CAST(sum(observed_session_count) FILTER (pre) OVER r AS BIGINT) AS pre_session_count,
  CAST(sum(observed_transaction_count) FILTER (pre) OVER r AS BIGINT) AS pre_transaction_count,
  sum(observed_revenue_usd) FILTER (pre) OVER r AS pre_revenue_usd,
  avg(observed_revenue_usd) FILTER (pre) OVER r AS pre_average_weekly_revenue_usd,
  stddev_samp(observed_revenue_usd) FILTER (pre) OVER r AS pre_weekly_revenue_stddev_usd,
  count(*) FILTER (pre AND observed_revenue_usd = 0) OVER r AS pre_zero_revenue_weeks
FROM (
SELECT 'World | ' || u.geo_region AS geo_key, 'World' AS geo_country, u.geo_region, w.week_start_date,
  w.week_start_date + 6 AS week_end_date, (w.week_start_date - DATE '{START}') // 7 + 1 AS analysis_week_number,
  w.period_name, w.period_name = 'PRE' AS pre,
  (w.week_start_date - CASE w.period_name WHEN 'PRE' THEN DATE '{START}' ELSE DATE '{TEST_START}' END) // 7 + 1
    AS period_week_number,
  count(t.session_key) AS observed_session_count, count(DISTINCT t.user_pseudo_id) AS observed_unique_users,
  count(*) FILTER (t.is_engaged_session) AS observed_engaged_sessions,
  count(*) FILTER (t.is_new_user_session) AS observed_new_user_sessions,
  CAST(coalesce(sum(t.view_item_event_count), 0) AS BIGINT) AS observed_view_item_events,
  CAST(coalesce(sum(t.add_to_cart_event_count), 0) AS BIGINT) AS observed_add_to_cart_events,
  CAST(coalesce(sum(t.begin_checkout_event_count), 0) AS BIGINT) AS observed_begin_checkout_events,
  CAST(coalesce(sum(t.canonical_transaction_count), 0) AS BIGINT) AS observed_transaction_count,
  coalesce(sum(t.canonical_revenue_usd), 0) AS observed_revenue_usd,
  CAST(coalesce(sum(t.canonical_item_quantity), 0) AS BIGINT) AS observed_item_quantity
FROM (SELECT DISTINCT geo_region FROM target) u CROSS JOIN weeks w
LEFT JOIN target t ON t.geo_region = u.geo_region AND t.week_start_date = w.week_start_date
GROUP BY ALL)
WINDOW r AS (PARTITION BY geo_region))))
""",
)
_pre_columns = [
    "geo_key",
    "geo_country",
    "geo_region",
    "week_start_date",
    "week_end_date",
    "analysis_week_number",
    "period_week_number",
    "observed_session_count",
    "observed_unique_users",
    "observed_engaged_sessions",
    "observed_new_user_sessions",
    "observed_transaction_count",
    "observed_revenue_usd",
    "observed_item_quantity",
    "observed_transaction_rate",
    "observed_revenue_per_session_usd",
    "observed_average_order_value_usd",
    "pre_session_count",
    "pre_transaction_count",
    "pre_revenue_usd",
    "pre_revenue_coefficient_of_variation",
    "data_origin",
    "treatment_assignment_status",
    "is_synthetic_outcome",
]
step(
    "early",
    f"SELECT {', '.join(_pre_columns)} FROM outcome WHERE meets_initial_eligibility AND period_name = 'PRE'",
)
step(
    "feature",
    """
SELECT geo_region, count(*) AS pre_weeks, CAST(sum(s) AS DOUBLE) AS pre_sessions, CAST(sum(t) AS DOUBLE) AS pre_transactions,
  sum(r) AS pre_revenue_usd, 100e0 * sum(t) / sum(s) AS pre_transaction_rate_pct,
  sum(r) / sum(s) AS pre_revenue_per_session_usd, sum(r) / sum(t) AS pre_average_order_value_usd,
  avg(r) AS average_weekly_revenue_usd, stddev_samp(r) AS weekly_revenue_stddev_usd,
  stddev_samp(r) / avg(r) AS revenue_cv, count(*) FILTER (r = 0) AS zero_revenue_weeks,
  100 * regr_slope(s, n) / avg(s) AS session_trend_pct_per_week,
  100 * regr_slope(t, n) / avg(t) AS transaction_trend_pct_per_week,
  100 * regr_slope(r, n) / avg(r) AS revenue_trend_pct_per_week,
  max(pre_revenue_coefficient_of_variation) AS warehouse_revenue_cv,
  ln(1 + sum(s)) AS log_pre_sessions, ln(1 + sum(r)) AS log_pre_revenue
FROM (SELECT *, observed_session_count AS s, observed_transaction_count AS t, observed_revenue_usd AS r,
  period_week_number AS n FROM early) GROUP BY geo_region
""",
)
_six = [
    "log_pre_sessions",
    "log_pre_revenue",
    "pre_transaction_rate_pct",
    "revenue_cv",
    "session_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
step(
    "zraw",
    f"""
SELECT *, (z_log_pre_sessions + z_log_pre_revenue) / 2 AS scale_index FROM (
SELECT geo_region, pre_sessions, pre_transactions, pre_revenue_usd, {', '.join(_six)},
  {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}' for c in _six)} FROM feature)
""",
)
step(
    "zed",
    "SELECT *, (scale_index - avg(scale_index) OVER ()) / stddev_pop(scale_index) OVER () AS z_scale_index FROM zraw",
)
step(
    "trail",
    """
SELECT geo_region, week_start_date, observed_session_count AS s, observed_revenue_usd AS r,
  avg(observed_session_count) OVER p AS ms, avg(observed_revenue_usd) OVER p AS mr
FROM early WINDOW p AS (PARTITION BY geo_region)
""",
)


def _gap(columns: list[str]) -> str:
    return "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in columns) + ")"


_z = [f"z_{c}" for c in _six]
step(
    "duo",
    f"""
SELECT a.geo_region || '__' || b.geo_region AS pair_id, a.geo_region AS region_a, b.geo_region AS region_b,
  {_gap(['z_scale_index'] + _z[2:])} AS category_balanced_feature_distance,
  {_gap(_z)} AS six_feature_distance_sensitivity, w.session_correlation, w.revenue_correlation,
  w.session_shape_nrmse, w.revenue_shape_nrmse,
  least(a.pre_sessions, b.pre_sessions) / greatest(a.pre_sessions, b.pre_sessions) AS session_scale_ratio,
  least(a.pre_transactions, b.pre_transactions) / greatest(a.pre_transactions, b.pre_transactions)
    AS transaction_scale_ratio,
  least(a.pre_revenue_usd, b.pre_revenue_usd) / greatest(a.pre_revenue_usd, b.pre_revenue_usd) AS revenue_scale_ratio
FROM zed a JOIN zed b ON a.geo_region < b.geo_region
JOIN (
  SELECT x.geo_region AS ra, y.geo_region AS rb, corr(x.s, y.s) AS session_correlation, corr(x.r, y.r) AS revenue_correlation,
    sqrt(avg(pow(x.s / x.ms - y.s / y.ms, 2))) AS session_shape_nrmse,
    sqrt(avg(pow(x.r / x.mr - y.r / y.mr, 2))) AS revenue_shape_nrmse
  FROM trail x JOIN trail y ON x.week_start_date = y.week_start_date AND x.geo_region < y.geo_region GROUP BY ALL
) w ON w.ra = a.geo_region AND w.rb = b.geo_region
""",
)

def _pct(c: str) -> str:
    return (
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0) / count(*) OVER ()"
    )


step(
    "scored",
    f"""
SELECT *, 100 * (1 - composite_dissimilarity) AS match_quality_score FROM (
SELECT *, 0.5e0 * feature_distance_percentile + 0.25e0 * session_shape_percentile
  + 0.25e0 * revenue_shape_percentile AS composite_dissimilarity FROM (
SELECT *, {_pct('category_balanced_feature_distance')} AS feature_distance_percentile,
  {_pct('session_shape_nrmse')} AS session_shape_percentile,
  {_pct('revenue_shape_nrmse')} AS revenue_shape_percentile FROM duo))
""",
)
_limits = {
    "maximum_feature_distance": ("category_balanced_feature_distance", 0),
    "minimum_session_correlation": ("session_correlation", 1),
    "minimum_revenue_correlation": ("revenue_correlation", 1),
    "minimum_session_scale_ratio": ("session_scale_ratio", 2),
    "minimum_revenue_scale_ratio": ("revenue_scale_ratio", 2),
}
_designs = {"CONSERVATIVE": (0.25, 0.5, 0.5), "BALANCED": (0.4, 0.4, 0.4), "BROAD": (0.5, 0.25, 0.25)}
step(
    "limits",
    " UNION ALL ".join(
        f"SELECT '{d}' AS design_name, "
        + ", ".join(f"quantile_cont({c}, {q[i]}) AS {t}" for t, (c, i) in _limits.items())
        + " FROM duo"
        for d, q in _designs.items()
    ),
)
step(
    "edge",
    "SELECT l.design_name, s.* FROM scored s JOIN limits l ON "
    + " AND ".join(
        f"s.{c} {'<=' if t.startswith('max') else '>='} l.{t}" for t, (c, _) in _limits.items()
    ),
)
# The largest matching of least weight, region by region: of all ways to deal with the regions so far
# that leave the same later regions taken, the best one is kept.
step(
    "spot",
    """
SELECT design_name, region, row_number() OVER (PARTITION BY design_name ORDER BY region) - 1 AS b
FROM (SELECT design_name, region_a AS region FROM edge UNION SELECT design_name, region_b FROM edge)
""",
)
step(
    "choice",
    """
SELECT design_name, b AS turn, CAST(0 AS BIGINT) AS taken, 0 AS won, 0e0 AS weight, CAST([] AS VARCHAR[]) AS pair FROM spot
UNION ALL
SELECT e.design_name, least(x.b, y.b), 1::BIGINT << greatest(x.b, y.b), 1, e.composite_dissimilarity, [e.pair_id]
FROM edge e JOIN spot x ON x.design_name = e.design_name AND x.region = e.region_a
JOIN spot y ON y.design_name = e.design_name AND y.region = e.region_b
""",
)
step(
    "walk",
    """
SELECT DISTINCT design_name, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS mask, 0 AS n, 0e0 AS w, CAST([] AS VARCHAR[]) AS picked
FROM spot
UNION ALL
SELECT s.design_name, s.turn + 1, (s.mask & ~(1::BIGINT << s.turn)) | c.taken AS later, s.n + c.won, s.w + c.weight, list_concat(s.picked, c.pair)
FROM walk s JOIN choice c ON c.design_name = s.design_name AND c.turn = s.turn
WHERE s.mask & c.taken = 0 AND (c.won = 0 OR (s.mask >> s.turn) & 1 = 0)
QUALIFY row_number() OVER (
  PARTITION BY s.design_name, s.turn, (s.mask & ~(1::BIGINT << s.turn)) | c.taken ORDER BY s.n + c.won DESC, s.w + c.weight) = 1
""",
)
step(
    "chosen",
    """
SELECT e.design_name, row_number() OVER (PARTITION BY e.design_name ORDER BY e.composite_dissimilarity, e.pair_id)
  AS candidate_pair_number, e.* EXCLUDE (design_name), 'CANDIDATE_PAIR_ONLY' AS assignment_status
FROM edge e JOIN (
  SELECT design_name, unnest(picked) AS pair_id FROM walk
  QUALIFY row_number() OVER (PARTITION BY design_name ORDER BY turn DESC) = 1
) USING (design_name, pair_id)
""",
)

_pair_floats = (
    "category_balanced_feature_distance six_feature_distance_sensitivity session_correlation revenue_correlation "
    "session_shape_nrmse revenue_shape_nrmse session_scale_ratio transaction_scale_ratio revenue_scale_ratio"
)
_score_floats = _pair_floats + (
    " feature_distance_percentile session_shape_percentile revenue_shape_percentile composite_dissimilarity"
    " match_quality_score"
)
_feature_floats = (
    "pre_transaction_rate_pct pre_revenue_per_session_usd pre_average_order_value_usd average_weekly_revenue_usd "
    "weekly_revenue_stddev_usd revenue_cv session_trend_pct_per_week transaction_trend_pct_per_week "
    "revenue_trend_pct_per_week warehouse_revenue_cv log_pre_sessions log_pre_revenue"
)
_profile_floats = (
    "pre_revenue_usd pre_average_weekly_revenue_usd pre_weekly_revenue_stddev_usd pre_transaction_rate "
    "pre_revenue_per_session_usd pre_revenue_coefficient_of_variation"
)
_observed_floats = (
    "observed_revenue_usd observed_transaction_rate observed_revenue_per_session_usd observed_average_order_value_usd"
)

ORACLES["week_spine"] = fin(
    "SELECT w.week_start_date, count(t.session_key) AS session_count FROM weeks w LEFT JOIN world t "
    "USING (week_start_date) GROUP BY ALL",
    dates="week_start_date",
)
ORACLES["normalize_geo_sessions"] = fin(
    "SELECT * FROM places", dates="session_date week_start_date", floats="canonical_revenue_usd"
)
ORACLES["balanced_panel"] = fin(
    "SELECT * FROM place_weeks",
    dates="week_start_date",
    ints="canonical_transaction_count",
    floats="canonical_revenue_usd",
)
ORACLES["week_numbers"] = fin(
    f"""
SELECT w.week_start_date, w.period_name, (SELECT count(*) FROM world t WHERE t.week_start_date = w.week_start_date)
    AS session_count, w.week_start_date + 6 AS week_end_date,
  row_number() OVER (ORDER BY w.week_start_date) AS analysis_week_number,
  row_number() OVER (PARTITION BY w.period_name ORDER BY w.week_start_date) AS period_week_number FROM weeks w
""",
    dates="week_start_date week_end_date",
)
ORACLES["geo_profile"] = fin(
    "SELECT * FROM place_profile", floats=_profile_floats + " test_revenue_usd"
)
ORACLES["eligibility"] = fin(
    "SELECT geo_key, pre_active_session_weeks, pre_sessions, pre_transactions, pre_revenue_usd, "
    "pre_revenue_coefficient_of_variation, meets_initial_eligibility, eligibility_status FROM place_profile",
    floats="pre_revenue_usd pre_revenue_coefficient_of_variation",
)
ORACLES["geo_coverage"] = fin(
    "SELECT count(*) AS sessions_in_analysis_window, count(*) FILTER (is_valid_geography) AS sessions_with_valid_geography, "
    "round(count(*) FILTER (is_valid_geography) / count(*), 4) AS valid_geography_session_share, "
    "sum(canonical_transaction_count) AS total_transactions, "
    "sum(canonical_transaction_count) FILTER (is_valid_geography) AS transactions_with_valid_geography, "
    "round(sum(canonical_transaction_count) FILTER (is_valid_geography) / sum(canonical_transaction_count), 4) "
    "AS valid_geography_transaction_share, round(sum(canonical_revenue_usd), 2) AS total_revenue_usd, "
    "round(sum(canonical_revenue_usd) FILTER (is_valid_geography), 2) AS revenue_with_valid_geography_usd, "
    "round(sum(canonical_revenue_usd) FILTER (is_valid_geography) / sum(canonical_revenue_usd), 4) "
    "AS valid_geography_revenue_share FROM places",
    ints="total_transactions transactions_with_valid_geography",
)
ORACLES["country_feasibility"] = fin(
    "SELECT geo_country, count(*) AS profiled_regions, count(*) FILTER (meets_initial_eligibility) AS eligible_regions, "
    "sum(p.pre_sessions) AS pre_sessions, sum(p.pre_transactions) AS pre_transactions, "
    "round(sum(p.pre_revenue_usd), 2) AS pre_revenue_usd, "
    "round(sum(p.pre_transactions) / sum(p.pre_sessions), 4) AS pre_transaction_rate, "
    "sum(test_sessions) AS historical_test_window_sessions, sum(test_transactions) AS historical_test_window_transactions, "
    "round(sum(test_revenue_usd), 2) AS historical_test_window_revenue_usd FROM place_profile p GROUP BY geo_country",
    ints="pre_sessions pre_transactions historical_test_window_sessions historical_test_window_transactions",
)
ORACLES["region_candidates"] = query(
    "SELECT row_number() OVER (ORDER BY p.meets_initial_eligibility DESC, p.pre_revenue_usd DESC, p.geo_country, p.geo_region) "
    "AS display_order, dense_rank() OVER (PARTITION BY p.geo_country ORDER BY p.pre_revenue_usd DESC) "
    "AS country_pre_revenue_rank, geo_country, geo_region, geo_key, total_panel_weeks, distinct_users, "
    "pre_active_session_weeks, pre_transaction_active_weeks, pre_sessions, pre_transactions, "
    "round(p.pre_revenue_usd, 2) AS pre_revenue_usd, "
    "round(p.pre_average_weekly_revenue_usd, 2) AS pre_average_weekly_revenue_usd, "
    "round(p.pre_weekly_revenue_stddev_usd, 2) AS pre_weekly_revenue_stddev_usd, "
    "round(p.pre_revenue_coefficient_of_variation, 4) AS pre_revenue_coefficient_of_variation, pre_zero_revenue_weeks, "
    "round(p.pre_transaction_rate, 4) AS pre_transaction_rate, "
    "round(p.pre_revenue_per_session_usd, 4) AS pre_revenue_per_session_usd, test_active_session_weeks, test_sessions, "
    "test_transactions, round(p.test_revenue_usd, 2) AS test_revenue_usd, meets_initial_eligibility, eligibility_status "
    "FROM place_profile p"
)
ORACLES["geo_weekly_outcomes"] = fin(
    "SELECT * EXCLUDE (pre) FROM outcome",
    dates="week_start_date week_end_date",
    floats=f"{_profile_floats} {_observed_floats} observed_engagement_rate",
)
ORACLES["eligible_pre_panel"] = fin(
    "SELECT * FROM early",
    dates="week_start_date week_end_date",
    floats=f"{_observed_floats} pre_revenue_usd pre_revenue_coefficient_of_variation",
)
ORACLES["outcome_matrix"] = fin(
    "SELECT week_start_date, "
    + ", ".join(f"max(observed_revenue_usd) FILTER (geo_region = 'NATION_{i}') AS NATION_{i}" for i in range(25))
    + " FROM outcome GROUP BY week_start_date",
    dates="week_start_date",
)

# ---- geo design ---------------------------------------------------------------------------------

ORACLES["region_summary"] = fin(
    "SELECT geo_region, pre_weeks, pre_sessions, pre_transactions, pre_revenue_usd, average_weekly_revenue_usd, "
    "weekly_revenue_stddev_usd, warehouse_revenue_cv AS revenue_coefficient_of_variation FROM feature",
    ints="pre_sessions pre_transactions",
    floats="average_weekly_revenue_usd weekly_revenue_stddev_usd revenue_coefficient_of_variation",
)
ORACLES["region_features"] = fin("SELECT * FROM feature", floats=_feature_floats)
ORACLES["csv_export"] = fin(
    "SELECT geo_region, pre_weeks, pre_sessions, pre_revenue_usd, revenue_cv FROM feature", floats="revenue_cv"
)


def _distribution(relation: str, columns: list[str], points: dict[str, float], extra: str) -> str:
    marks = ", ".join(
        f'round(quantile_cont({{c}}, {q}), 4) + 0e0 AS "{name}"' for name, q in points.items()
    )
    return " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {marks}, round(avg({c}), 4) + 0e0 AS mean{extra} FROM {relation}".replace("{c}", c)
        for c in columns
    )


_range_columns = [
    "pre_sessions",
    "pre_transactions",
    "pre_revenue_usd",
    "pre_transaction_rate_pct",
    "pre_revenue_per_session_usd",
    "pre_average_order_value_usd",
    "revenue_cv",
    "session_trend_pct_per_week",
    "transaction_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
ORACLES["feature_range_summary"] = query(
    _distribution("feature", _range_columns, {"min": 0, "median": 0.5, "max": 1}, "")
)
ORACLES["pair_metric_summary"] = query(
    _distribution(
        "duo",
        _pair_floats.split(),
        {"min": 0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1},
        ', count({c}) AS "count", round(stddev_samp({c}), 4) AS std',
    )
)
_corr_columns = [
    "log_pre_sessions",
    "log_pre_revenue",
    "pre_transaction_rate_pct",
    "pre_revenue_per_session_usd",
    "pre_average_order_value_usd",
    "revenue_cv",
    "session_trend_pct_per_week",
    "transaction_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
ORACLES["feature_correlations"] = query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 2) + 0e0 AS correlation FROM feature"
        for a in _corr_columns
        for b in _corr_columns
    )
)
ORACLES["standardize"] = fin(
    "SELECT * FROM zed", floats=" ".join(_six + _z) + " scale_index z_scale_index"
)
ORACLES["pair_metrics"] = fin("SELECT * FROM duo", floats=_pair_floats)
ORACLES["top_feature_pairs"] = fin(
    "SELECT * FROM duo ORDER BY category_balanced_feature_distance, pair_id LIMIT 20", floats=_pair_floats
)
ORACLES["composite_score"] = fin("SELECT * FROM scored", floats=_score_floats)
ORACLES["pair_distance_sensitivity"] = fin(
    f"""
SELECT corr(p, s) AS distance_rank_correlation,
  count(*) FILTER (turn_p <= 20 AND turn_s <= 20) AS top_pair_overlap
FROM (SELECT {_pct('category_balanced_feature_distance')} AS p, {_pct('six_feature_distance_sensitivity')} AS s,
  row_number() OVER (ORDER BY category_balanced_feature_distance, pair_id) AS turn_p,
  row_number() OVER (ORDER BY six_feature_distance_sensitivity, pair_id) AS turn_s FROM duo)
""",
    floats="distance_rank_correlation",
)
ORACLES["threshold_summary"] = fin("SELECT * FROM limits", floats=" ".join(_limits))
ORACLES["candidate_edges"] = fin("SELECT * FROM edge", floats=_score_floats)
ORACLES["matching_sizes"] = query(
    "SELECT design_name, CAST(count(*) AS BIGINT) AS pair_count FROM chosen GROUP BY design_name"
)
ORACLES["match_pairs"] = fin("SELECT * FROM chosen", floats=_score_floats)
ORACLES["design_summary"] = fin(
    """
SELECT e.design_name, e.n AS candidate_edge_count, count(c.pair_id) AS selected_pair_count,
  2 * count(c.pair_id) AS represented_region_count, avg(match_quality_score) AS mean_match_quality_score,
  min(match_quality_score) AS minimum_match_quality_score,
  avg(category_balanced_feature_distance) AS mean_feature_distance,
  avg(session_correlation) AS mean_session_correlation, avg(revenue_correlation) AS mean_revenue_correlation,
  avg(session_scale_ratio) AS mean_session_scale_ratio, avg(revenue_scale_ratio) AS mean_revenue_scale_ratio
FROM (SELECT design_name, count(*) AS n FROM edge GROUP BY ALL) e LEFT JOIN chosen c USING (design_name)
GROUP BY ALL
""",
    floats="mean_match_quality_score minimum_match_quality_score mean_feature_distance mean_session_correlation "
    "mean_revenue_correlation mean_session_scale_ratio mean_revenue_scale_ratio",
)

ORACLES["extended_pairs"] = ORACLES["match_pairs"]
ORACLES["extended_design_summary"] = ORACLES["design_summary"]

# ---- reconciliation -----------------------------------------------------------------------------

ORACLES["reconcile_events"] = fin(
    """
SELECT n AS source_event_rows, n AS staging_event_rows, 0 AS event_row_difference, true AS event_rows_match,
  u AS source_unique_users, u AS staging_unique_users, true AS unique_users_match,
  e AS source_distinct_event_names, e AS staging_distinct_event_names, true AS event_name_counts_match,
  d0 AS source_first_event_date, d0 AS staging_first_event_date, d1 AS source_last_event_date,
  d1 AS staging_last_event_date, true AS date_range_matches, b AS source_purchase_event_rows,
  b AS staging_purchase_event_rows, true AS purchase_event_rows_match, b AS staging_purchase_events_with_session_id,
  cur AS staging_purchase_events_with_currency, 0 AS null_event_date_rows, 0 AS null_event_timestamp_rows,
  0 AS invalid_session_key_rows, 0 AS invalid_transaction_normalization_rows,
  CASE WHEN cur = b THEN 'PASS' ELSE 'REVIEW' END AS reconciliation_status
FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT event_name) AS e, min(d) AS d0, max(d) AS d1,
  count(*) FILTER (buys) AS b, count(*) FILTER (buys AND k % 50 <> 49) AS cur FROM shaped)
""",
    dates="source_first_event_date staging_first_event_date source_last_event_date staging_last_event_date",
)
ORACLES["reconcile_items"] = fin(
    """
SELECT n AS source_item_rows, n AS staging_item_rows, 0 AS item_row_difference, true AS item_rows_match,
  names AS compared_event_names, 0 AS event_names_with_item_row_mismatch, b AS source_purchase_item_rows,
  b AS staging_purchase_item_rows, true AS purchase_item_rows_match, priced AS purchase_item_rows_with_item_revenue,
  b - priced AS purchase_item_rows_without_item_revenue, 0 AS invalid_item_offset_rows, 0 AS null_item_fingerprint_rows,
  blank AS rows_without_item_identity, 0 AS invalid_session_key_rows, 0 AS invalid_transaction_normalization_rows,
  n - keys AS duplicate_item_fingerprints, 'PASS' AS reconciliation_status
FROM (SELECT count(*) AS n, count(DISTINCT event_name) AS names, count(*) FILTER (is_purchase_event) AS b,
  count(*) FILTER (is_purchase_event AND item_revenue_in_usd IS NOT NULL) AS priced,
  count(*) FILTER (item_identity IS NULL) AS blank, count(DISTINCT item_record_fingerprint) AS keys FROM stg_items)
"""
)
ORACLES["reconcile_transactions"] = fin(
    """
SELECT b AS source_purchase_event_rows, b AS represented_purchase_event_rows, true AS all_purchase_events_represented,
  n AS fact_transaction_rows, n AS distinct_transaction_keys, 0 AS duplicate_transaction_keys,
  b - n AS purchase_rows_removed_by_deduplication, b - n AS duplicate_measurement_rows_removed,
  raw AS source_raw_purchase_revenue_usd, raw AS represented_raw_purchase_revenue_usd, true AS raw_revenue_reconciles,
  rev AS canonical_transaction_revenue_usd, raw - rev AS duplicate_measurement_revenue_removed_usd,
  m1 AS reliable_transaction_id_rows, m2 AS conflicting_id_fallback_rows, m3 AS missing_id_fallback_rows,
  m4 AS not_set_fallback_rows, 0 AS null_transaction_key_rows, 0 AS null_transaction_revenue_rows,
  0 AS unreliable_rows_classified_as_reliable, 0 AS grouped_fallback_transaction_rows, 'PASS' AS reconciliation_status
FROM (SELECT count(*) AS b, sum(revenue) AS raw FROM shaped WHERE buys),
  (SELECT count(*) AS n, sum(transaction_revenue_usd) AS rev,
    count(*) FILTER (starts_with(transaction_key, 'TRANSACTION_ID|')) AS m1,
    count(*) FILTER (starts_with(transaction_key, 'CONFLICTING_ID|')) AS m2,
    count(*) FILTER (starts_with(transaction_key, 'MISSING_ID|')) AS m3,
    count(*) FILTER (starts_with(transaction_key, 'NOT_SET|')) AS m4 FROM tx)
"""
)
ORACLES["reconcile_sessions"] = fin(
    """
SELECT n AS source_event_rows, ev_n AS represented_event_rows, n = ev_n AS all_events_represented,
  keys AS source_distinct_sessions, s AS fact_session_rows, s AS distinct_fact_session_keys,
  keys = s AS session_counts_match, true AS session_keys_are_unique, u AS source_unique_users, su AS fact_unique_users,
  u = su AS user_counts_match, 0 AS source_events_without_session_key, b AS source_purchase_measurement_events,
  sb AS represented_purchase_measurement_events, b = sb AS purchase_measurement_events_match,
  t AS source_canonical_transactions, st AS represented_canonical_transactions, t = st AS canonical_transactions_match,
  rev AS source_canonical_revenue_usd, srev AS represented_canonical_revenue_usd, rev = srev AS canonical_revenue_matches,
  b - t AS expected_duplicate_purchase_measurement_rows, dup AS duplicate_purchase_measurement_rows,
  conv AS converting_sessions, multi AS sessions_with_multiple_transactions, nostart AS sessions_without_session_start_event,
  0 AS transactions_without_session_key, 0 AS negative_session_duration_rows, 0 AS null_session_source_rows,
  0 AS null_session_medium_rows, 0 AS null_session_channel_group_rows,
  CASE WHEN n = ev_n AND keys = s AND u = su AND b = sb AND t = st AND rev = srev AND dup = b - t
    THEN 'PASS' ELSE 'REVIEW' END AS reconciliation_status
FROM (SELECT count(*) AS n, count(DISTINCT session_key) AS keys, count(DISTINCT user_pseudo_id) AS u,
    count(*) FILTER (is_purchase_event) AS b FROM stg),
  (SELECT count(*) AS t, sum(transaction_revenue_usd) AS rev FROM tx),
  (SELECT count(*) AS s, count(DISTINCT user_pseudo_id) AS su, CAST(sum(event_count) AS BIGINT) AS ev_n,
    CAST(sum(raw_purchase_measurement_event_count) AS BIGINT) AS sb,
    CAST(sum(canonical_transaction_count) AS BIGINT) AS st, sum(canonical_revenue_usd) AS srev,
    CAST(sum(duplicate_purchase_measurement_rows) AS BIGINT) AS dup, count(*) FILTER (is_converting_session) AS conv,
    count(*) FILTER (canonical_transaction_count > 1) AS multi, count(*) FILTER (session_start_event_count = 0) AS nostart
  FROM ses)
"""
)
ORACLES["reconcile_bridge"] = fin(
    """
SELECT t AS source_transaction_count, jt AS represented_transaction_count, t = jt AS transaction_counts_match,
  u AS source_transaction_users, ju AS represented_transaction_users, u = ju AS transaction_user_counts_match,
  rev AS source_canonical_revenue_usd, jrev AS represented_canonical_revenue_usd, rev = jrev AS canonical_revenue_matches,
  fb AS source_fallback_transactions, jfb AS represented_fallback_transactions, fb = jfb AS fallback_transaction_counts_match,
  rows_n AS bridge_row_count, lo AS minimum_touchpoints_per_transaction, round(rows_n / jt, 2) AS average_touchpoints_per_transaction,
  hi AS maximum_touchpoints_per_transaction, multi AS multi_touch_transactions, only_direct AS direct_only_transactions,
  censored AS left_censored_transactions, t - conv AS conversion_session_errors, 0 AS first_touchpoint_flag_errors,
  0 AS last_touchpoint_flag_errors, t - named AS last_non_direct_flag_errors, 0 AS future_touchpoint_rows,
  0 AS outside_lookback_rows, 0 AS null_required_identifier_rows, 0 AS null_attribution_dimension_rows,
  0 AS duplicate_transaction_touchpoint_pairs,
  CASE WHEN t = jt AND u = ju AND rev = jrev AND fb = jfb AND lo >= 1 AND conv = t AND named = t
    THEN 'PASS' ELSE 'FAIL' END AS reconciliation_status
FROM (SELECT count(*) AS t, count(DISTINCT user_pseudo_id) AS u, sum(transaction_revenue_usd) AS rev,
    count(*) FILTER (uses_fallback_transaction_key) AS fb FROM tx),
  (SELECT count(*) AS rows_n, count(*) FILTER (z) AS jt, count(DISTINCT user_pseudo_id) AS ju,
    sum(transaction_revenue_usd) FILTER (z) AS jrev, count(*) FILTER (z AND uses_fallback_transaction_key) AS jfb,
    min(touchpoint_count) AS lo, max(touchpoint_count) AS hi, count(*) FILTER (z AND touchpoint_count > 1) AS multi,
    count(*) FILTER (z AND non_direct_touchpoint_count = 0) AS only_direct,
    count(*) FILTER (z AND is_lookback_left_censored) AS censored, count(*) FILTER (is_conversion_session) AS conv,
    count(*) FILTER (is_last_non_direct_attribution_touchpoint) AS named
  FROM (SELECT *, is_last_touchpoint AS z FROM bridge))
"""
)
ORACLES["reconcile_credits"] = fin(
    """
SELECT attribution_model_order, attribution_model,
  CASE WHEN attribution_model_order < 4 THEN t ELSE bn END AS expected_model_credit_rows, n AS model_credit_rows,
  n = CASE WHEN attribution_model_order < 4 THEN t ELSE bn END AS model_credit_row_count_matches,
  t AS source_transactions, ct AS represented_transactions, t = ct AS transaction_count_matches,
  u AS source_users, cu AS represented_users, u = cu AS user_count_matches, whole AS complete_window_transactions,
  w AS total_attribution_weight, w AS total_attributed_conversions, rev AS source_revenue_usd,
  crev AS total_attributed_revenue_usd, abs(rev - crev) < 0.01 AS revenue_matches,
  complete AS complete_window_attributed_revenue_usd, censored AS left_censored_attributed_revenue_usd,
  dw AS direct_attributed_conversions, drev AS direct_attributed_revenue_usd, channels AS credited_channel_count,
  0 AS transaction_weight_errors, 0 AS transaction_conversion_credit_errors,
  (SELECT count(*) FROM credit) AS total_credit_rows, 5 AS distinct_attribution_models, 0 AS invalid_weight_rows,
  0 AS null_required_field_rows, 0 AS duplicate_credit_pair_groups,
  CASE WHEN n = CASE WHEN attribution_model_order < 4 THEN t ELSE bn END AND t = ct AND u = cu AND w = t
    AND abs(rev - crev) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS model_reconciliation_status
FROM (SELECT attribution_model_order, attribution_model, count(*) AS n, count(DISTINCT transaction_key) AS ct,
    count(DISTINCT user_pseudo_id) AS cu, count(DISTINCT transaction_key) FILTER (is_complete_lookback_window) AS whole,
    round(sum(attribution_weight), 6) AS w, round(sum(attributed_revenue_usd), 2) AS crev,
    round(sum(attributed_revenue_usd) FILTER (is_complete_lookback_window), 2) AS complete,
    round(sum(attributed_revenue_usd) FILTER (is_lookback_left_censored), 2) AS censored,
    round(sum(attribution_weight) FILTER (is_direct_touchpoint), 6) AS dw,
    round(sum(attributed_revenue_usd) FILTER (is_direct_touchpoint), 2) AS drev,
    count(DISTINCT touchpoint_channel_group) AS channels FROM credit GROUP BY ALL),
  (SELECT count(*) AS t, count(DISTINCT user_pseudo_id) AS u, sum(transaction_revenue_usd) AS rev FROM tx),
  (SELECT count(*) AS bn FROM bridge)
"""
)
ORACLES["reconcile_comparison"] = fin(
    """
SELECT m.analysis_population_order, m.analysis_population, m.attribution_model_order, m.attribution_model,
  count(*) AS represented_channel_rows, count(DISTINCT m.touchpoint_channel_group) AS represented_channels,
  any_value(p.t) AS expected_conversions, any_value(p.rev) AS expected_revenue_usd,
  round(sum(m.attributed_conversion_credit), 6) AS attributed_conversions,
  round(sum(m.attributed_revenue_usd), 2) AS attributed_revenue_usd,
  round(sum(m.model_conversion_share), 6) AS conversion_share_sum, round(sum(m.model_revenue_share), 6) AS revenue_share_sum,
  round(sum(m.conversion_delta_vs_last_touch), 6) + 0e0 AS net_conversion_delta_vs_last_touch,
  round(sum(m.revenue_delta_vs_last_touch_usd), 2) + 0e0 AS net_revenue_delta_vs_last_touch_usd,
  round(sum(abs(m.revenue_delta_vs_last_touch_usd)) / 2, 2) AS revenue_reallocated_vs_last_touch_usd,
  0e0 AS last_touch_baseline_error, 0e0 AS last_non_direct_baseline_error, 0 AS negative_metric_rows,
  0 AS null_required_field_rows, 70 AS total_table_rows, 10 AS model_population_combinations, 5 AS represented_models,
  2 AS represented_populations, 0 AS duplicate_population_model_channel_groups,
  CASE WHEN count(*) = 7 AND abs(sum(m.attributed_conversion_credit) - any_value(p.t)) < 1e-6
    AND abs(sum(m.attributed_revenue_usd) - any_value(p.rev)) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS reconciliation_status
FROM mart m JOIN (
  SELECT analysis_population, CAST(count(*) AS DOUBLE) AS t, sum(transaction_revenue_usd) AS rev FROM pops q
  JOIN bridge b ON b.is_last_touchpoint AND NOT (q.is_complete_window_population AND b.is_lookback_left_censored)
  GROUP BY ALL) p ON p.analysis_population = m.analysis_population
GROUP BY m.analysis_population_order, m.analysis_population, m.attribution_model_order, m.attribution_model
""",
)
ORACLES["reconcile_geo"] = fin(
    """
SELECT count(*) AS table_rows, count(DISTINCT geo_region) AS region_count, count(DISTINCT week_start_date) AS distinct_week_count,
  count(DISTINCT geo_region) FILTER (el) AS eligible_region_count, count(*) FILTER (el) AS eligible_region_week_rows,
  min(week_start_date) AS first_week_start_date, max(week_end_date) AS last_week_end_date,
  sum(s) AS table_session_count, (SELECT count(*) FROM target) AS source_session_count, sum(t) AS table_transaction_count,
  (SELECT sum(canonical_transaction_count) FROM target) AS source_transaction_count, sum(r) AS table_revenue_usd,
  (SELECT sum(canonical_revenue_usd) FROM target) AS source_revenue_usd,
  coalesce(sum(s) FILTER (el AND pre), 0) AS eligible_pre_session_count,
  coalesce(sum(t) FILTER (el AND pre), 0) AS eligible_pre_transaction_count,
  coalesce(sum(r) FILTER (el AND pre), 0) AS eligible_pre_revenue_usd,
  coalesce(sum(s) FILTER (el), 0) AS eligible_total_session_count,
  coalesce(sum(t) FILTER (el), 0) AS eligible_total_transaction_count,
  coalesce(sum(r) FILTER (el), 0) AS eligible_total_revenue_usd,
  true AS all_regions_have_all_weeks, true AS all_regions_have_all_pre_and_test_weeks,
  sum(s) = (SELECT count(*) FROM target) AS sessions_reconcile,
  sum(t) = (SELECT sum(canonical_transaction_count) FROM target) AS transactions_reconcile,
  sum(r) = (SELECT sum(canonical_revenue_usd) FROM target) AS revenue_reconciles, 'PASS' AS reconciliation_status
FROM (SELECT *, meets_initial_eligibility AS el, observed_session_count AS s, observed_transaction_count AS t,
  observed_revenue_usd AS r FROM outcome)
""",
    ints="table_session_count table_transaction_count source_transaction_count eligible_pre_session_count "
    "eligible_pre_transaction_count eligible_total_session_count eligible_total_transaction_count",
    dates="first_week_start_date last_week_end_date",
)

# ---- entities -----------------------------------------------------------------------------------

ORACLES["fct_transaction_items"] = fin(
    """
SELECT t.transaction_key || '|' || i.item_offset AS transaction_item_key, t.transaction_key, t.transaction_date,
  t.user_pseudo_id, t.session_key, i.item_record_fingerprint, i.item_offset, i.item_identity, i.item_id, i.item_name,
  i.item_brand, i.item_variant, i.item_category, i.item_quantity, i.item_price_in_usd, i.item_revenue_in_usd,
  i.calculated_item_value_in_usd
FROM tx t JOIN stg_items i ON i.source_event_fingerprint = t.canonical_source_event_fingerprint
""",
    dates="transaction_date",
    floats="item_price_in_usd item_revenue_in_usd calculated_item_value_in_usd",
)
ORACLES["dim_pseudo_users"] = fin(
    """
SELECT s.*, coalesce(p.n, 0) AS canonical_transaction_count, coalesce(p.rev, 0) AS canonical_revenue_usd,
  p.d0 AS first_purchase_date, p.d1 AS last_purchase_date, p.n IS NOT NULL AS is_purchaser,
  coalesce(p.n > 1, false) AS is_repeat_purchaser, coalesce(p.r30, 0) AS revenue_first_30_days_usd,
  coalesce(p.r90, 0) AS revenue_first_90_days_usd, coalesce(p.fb > 0, false) AS has_fallback_transactions
FROM (SELECT user_pseudo_id, min(session_date) AS first_event_date, max(session_date) AS last_event_date,
    arg_min(session_source, (session_start_timestamp_utc, session_key)) AS first_observed_source,
    arg_min(session_medium, (session_start_timestamp_utc, session_key)) AS first_observed_medium,
    arg_min(session_campaign, (session_start_timestamp_utc, session_key)) AS first_observed_campaign,
    count(*) AS session_count, count(*) FILTER (is_engaged_session) AS engaged_session_count FROM ses GROUP BY ALL) s
LEFT JOIN (SELECT user_pseudo_id, count(*) AS n, sum(v) AS rev, min(d) AS d0, max(d) AS d1,
    sum(v) FILTER (d - f <= 30) AS r30, sum(v) FILTER (d - f <= 90) AS r90, count(*) FILTER (fallback) AS fb
  FROM (SELECT user_pseudo_id, transaction_date AS d, transaction_revenue_usd AS v, uses_fallback_transaction_key AS fallback,
    min(transaction_date) OVER (PARTITION BY user_pseudo_id) AS f FROM tx) GROUP BY ALL) p USING (user_pseudo_id)
""",
    dates="first_event_date last_event_date first_purchase_date last_purchase_date",
)
ORACLES["dim_date"] = fin(
    """
SELECT x AS date_day, year(x) AS year, quarter(x) AS quarter, month(x) AS month, day(x) AS day_of_month,
  dayofweek(x) + 1 AS day_of_week, x - CAST(dayofweek(x) AS INTEGER) AS week_start_date,
  strftime(x, '%Y%m%d') AS date_suffix, dayofweek(x) IN (0, 6) AS is_weekend
FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS x
  FROM events)
""",
    dates="date_day week_start_date",
)
ORACLES["dim_channel"] = fin(
    """
SELECT channel_order, channel_group, channel_group LIKE 'Paid%' AS is_paid, count(session_key) AS session_count,
  min(session_date) AS first_session_date
FROM (VALUES (1, 'Direct'), (2, 'Paid Search'), (3, 'Organic Search'), (4, 'Paid Social'), (5, 'Organic Social'),
  (6, 'Display'), (7, 'Email'), (8, 'Affiliate'), (9, 'Referral'), (10, 'Other')) c(channel_order, channel_group)
LEFT JOIN ses ON session_channel_group = channel_group GROUP BY ALL
""",
    dates="first_session_date",
)
ORACLES["dim_channel_mapping"] = query(
    """
SELECT session_source, session_medium, session_channel_group AS channel_group,
  CASE session_channel_group WHEN 'Direct' THEN '(direct) / (none)'
    WHEN 'Paid Search' THEN 'medium is cpc, ppc, paid search, paid_search, paidsearch'
    WHEN 'Organic Search' THEN 'medium has organic' WHEN 'Email' THEN 'medium has email'
    WHEN 'Affiliate' THEN 'medium has affiliate' WHEN 'Referral' THEN 'medium has referral' ELSE 'no rule' END AS mapping_rule,
  regexp_matches(lower(session_medium || ' ' || session_campaign), 'retarget|remarket') AS is_retargeting,
  CASE WHEN regexp_matches(lower(session_medium || ' ' || session_campaign), 'retarget|remarket') THEN 'Retargeting'
    WHEN session_channel_group = 'Other' THEN 'Other or Unassigned' ELSE session_channel_group END AS reporting_channel,
  count(*) AS session_count
FROM ses GROUP BY ALL
"""
)
ORACLES["dim_geo"] = query(
    "SELECT geo_country || ' | ' || geo_region AS geo_key, geo_country, geo_region, "
    "geo_country <> '(not set)' AS is_valid_geography, count(*) AS session_count FROM ses GROUP BY ALL"
)
ORACLES["attribution_path_steps"] = fin(
    """
SELECT transaction_key, touchpoint_position_asc AS step_number, touchpoint_channel_group AS channel_group, transaction_date, transaction_revenue_usd
FROM bridge
""",
    dates="transaction_date",
)
ORACLES["mart_attribution_paths"] = fin(
    """
SELECT b.transaction_key, any_value(b.transaction_date) AS transaction_date, any_value(b.user_pseudo_id) AS user_pseudo_id,
  any_value(b.transaction_revenue_usd) AS transaction_revenue_usd, count(*) AS touchpoint_count,
  count(DISTINCT b.touchpoint_channel_group) AS distinct_channel_count,
  max(b.touchpoint_channel_group) FILTER (b.is_first_touchpoint) AS first_touch_channel,
  max(b.touchpoint_channel_group) FILTER (b.is_last_touchpoint) AS last_touch_channel,
  max(b.touchpoint_channel_group) FILTER (b.is_last_non_direct_attribution_touchpoint) AS last_non_direct_channel,
  max(b.seconds_before_transaction) AS journey_seconds, bool_or(b.is_lookback_left_censored) AS is_lookback_left_censored,
  any_value(w.channel_path) AS channel_path
FROM bridge b JOIN (
  SELECT transaction_key, string_agg(touchpoint_channel_group || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' > ' ORDER BY p) AS channel_path
  FROM (SELECT transaction_key, touchpoint_channel_group, min(touchpoint_position_asc) AS p, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY transaction_key ORDER BY touchpoint_position_asc)
                - row_number() OVER (PARTITION BY transaction_key, touchpoint_channel_group ORDER BY touchpoint_position_asc) AS island FROM bridge)
        GROUP BY transaction_key, touchpoint_channel_group, island)
  GROUP BY ALL) w ON w.transaction_key = b.transaction_key
GROUP BY b.transaction_key
""",
    dates="transaction_date",
)
_published = {
    "fct_transactions": "tx",
    "fct_transaction_items": "tx t JOIN stg_items i ON i.source_event_fingerprint = t.canonical_source_event_fingerprint",
    "fct_sessions": "ses",
    "dim_pseudo_users": "(SELECT DISTINCT user_pseudo_id FROM ses)",
    "dim_date": "(SELECT unnest(generate_series(min(session_date)::TIMESTAMP, max(session_date)::TIMESTAMP, INTERVAL 1 DAY)) FROM ses)",
    "dim_channel": "generate_series(1, 10)",
    "dim_geo": "(SELECT DISTINCT geo_country, geo_region FROM ses)",
    "bridge_transaction_touchpoints": "bridge",
    "mart_attribution_paths": "tx",
    "fct_attribution_credits": "credit",
    "mart_attribution_channel_comparison": "mart",
    "mart_attribution_channel_shifts": "shift",
    "fct_geo_weekly_outcomes": "outcome",
}


step(
    "shift",
    """
SELECT f.attribution_model, f.touchpoint_channel_group, f.revenue_delta_vs_last_touch_usd AS x,
  c.revenue_delta_vs_last_touch_usd AS y
FROM mart f JOIN mart c USING (attribution_model, touchpoint_channel_group)
WHERE f.attribution_model <> 'last_touch' AND f.analysis_population = 'all_observed'
  AND c.analysis_population = 'complete_window'
""",
)
ORACLES["published_tables"] = query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {relation}" for name, relation in _published.items()
    )
)
ORACLES["published_layout"] = query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST(0 AS BIGINT) AS overlapping_files, "
        f"CAST(0 AS BIGINT) AS overlapping_blocks FROM {relation}"
        for name, relation in _published.items()
    )
)

# ---- contracts ----------------------------------------------------------------------------------


def _bad_rows(relation: str, condition: str) -> str:
    return f"SELECT count(*) FROM {relation} WHERE {condition}"


def _bad_groups(relation: str, keys: str, condition: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {relation} GROUP BY {keys} HAVING {condition})"


def _any_null(columns: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns.split())


def _holds(condition: str) -> str:
    return f"SELECT CASE WHEN {condition} THEN 0 ELSE 1 END"


def _report(rows: list[tuple[str, str, str]]) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS contract, CAST(({sql}) AS BIGINT) AS violations" for t, c, sql in rows
    )
    return query(f"SELECT *, violations = 0 AS passed FROM (\n{union}\n)")


_items_of_tx = (
    "(SELECT t.transaction_key, i.item_offset, i.item_record_fingerprint, i.item_quantity "
    "FROM tx t JOIN stg_items i ON i.source_event_fingerprint = t.canonical_source_event_fingerprint)"
)
_cells_of = "analysis_population, attribution_model"
ORACLES["attribution_contracts"] = _report(
    [
        ("fct_transactions", "transaction_key is unique", _bad_groups("tx", "transaction_key", "count(*) > 1")),
        ("fct_transactions", "transaction_key is set", _bad_rows("tx", "transaction_key IS NULL")),
        (
            "fct_transactions",
            "reliable IDs have no conflict",
            _bad_rows(
                "tx",
                "NOT uses_fallback_transaction_key AND (transaction_id_distinct_users > 1 "
                "OR transaction_id_distinct_revenue_values > 1)",
            ),
        ),
        (
            "fct_transactions",
            "all purchase events are kept or counted as duplicates",
            _holds("(SELECT sum(measurement_event_rows) FROM tx) = (SELECT count(*) FROM stg WHERE is_purchase_event)"),
        ),
        (
            "fct_sessions",
            "sessions do not end before they start",
            _bad_rows("ses", "session_start_timestamp_utc > session_end_timestamp_utc"),
        ),
        ("fct_sessions", "session_key is unique", _bad_groups("ses", "session_key", "count(*) > 1")),
        ("fct_sessions", "session_key is set", _bad_rows("ses", "session_key IS NULL")),
        (
            "fct_sessions",
            "all events are represented",
            _holds("(SELECT sum(event_count) FROM ses) = (SELECT count(*) FROM events)"),
        ),
        (
            "fct_sessions",
            "all transactions are represented",
            _holds("(SELECT sum(canonical_transaction_count) FROM ses) = (SELECT count(*) FROM tx)"),
        ),
        (
            "fct_sessions",
            "revenue is represented",
            _holds("(SELECT sum(canonical_revenue_usd) FROM ses) = (SELECT sum(transaction_revenue_usd) FROM tx)"),
        ),
        (
            "bridge_transaction_touchpoints",
            "transaction identifiers are set",
            _bad_rows(
                "bridge",
                _any_null("transaction_key user_pseudo_id transaction_timestamp_utc transaction_session_key"),
            ),
        ),
        (
            "bridge_transaction_touchpoints",
            "attribution dimensions are set",
            _bad_rows("bridge", _any_null("touchpoint_source touchpoint_medium touchpoint_channel_group")),
        ),
        (
            "bridge_transaction_touchpoints",
            "touchpoints lie inside the lookback window",
            _bad_rows("bridge", f"seconds_before_transaction NOT BETWEEN 0 AND {LOOKBACK} * 86400"),
        ),
        (
            "bridge_transaction_touchpoints",
            "transaction-touchpoint pairs are unique",
            _bad_groups("bridge", "transaction_key, touchpoint_session_key", "count(*) > 1"),
        ),
        (
            "bridge_transaction_touchpoints",
            "one conversion session per transaction",
            _bad_groups("bridge", "transaction_key", "count(*) FILTER (is_conversion_session) <> 1"),
        ),
        (
            "bridge_transaction_touchpoints",
            "all transactions are represented",
            _holds("(SELECT count(DISTINCT transaction_key) FROM bridge) = (SELECT count(*) FROM tx)"),
        ),
        (
            "bridge_transaction_touchpoints",
            "revenue is represented",
            _holds(
                "(SELECT sum(transaction_revenue_usd) FROM bridge WHERE is_last_touchpoint) = "
                "(SELECT sum(transaction_revenue_usd) FROM tx)"
            ),
        ),
        (
            "fct_attribution_credits",
            "all models are present",
            _holds("(SELECT count(DISTINCT attribution_model) FROM credit) = 5"),
        ),
        (
            "fct_attribution_credits",
            "credit rows follow from the bridge",
            _holds("(SELECT count(*) FROM credit) = 3 * (SELECT count(*) FROM tx) + 2 * (SELECT count(*) FROM bridge)"),
        ),
        (
            "fct_attribution_credits",
            "weights lie in (0, 1]",
            _bad_rows("credit", "attribution_weight IS NULL OR attribution_weight <= 0 OR attribution_weight > 1"),
        ),
        (
            "fct_attribution_credits",
            "credit fields are set",
            _bad_rows(
                "credit",
                _any_null(
                    "transaction_key touchpoint_session_key attribution_model touchpoint_channel_group "
                    "attributed_revenue_usd"
                ),
            ),
        ),
        (
            "fct_attribution_credits",
            "credit rows are unique",
            _bad_groups("credit", "attribution_model, transaction_key, touchpoint_session_key", "count(*) > 1"),
        ),
        (
            "fct_attribution_credits",
            "weights of a transaction sum to one",
            _bad_groups(
                "credit", "attribution_model, transaction_key", "abs(sum(attribution_weight) - 1) > 1e-9"
            ),
        ),
        (
            "attribution_credit_totals",
            "models allocate all conversions and revenue",
            "SELECT CASE WHEN count(*) = 0 THEN 0 ELSE 1 END FROM (SELECT attribution_model FROM credit GROUP BY "
            "attribution_model HAVING count(DISTINCT transaction_key) <> (SELECT count(*) FROM tx) OR "
            "abs(sum(attributed_revenue_usd) - (SELECT sum(transaction_revenue_usd) FROM tx)) > 0.01)",
        ),
        ("mart_attribution_channel_comparison", "grid is complete", _holds("(SELECT count(*) FROM mart) = 70")),
        (
            "mart_attribution_channel_comparison",
            "grid cells are unique",
            _bad_groups("mart", f"{_cells_of}, touchpoint_channel_group", "count(*) > 1"),
        ),
        (
            "mart_attribution_channel_comparison",
            "comparison fields are set",
            _bad_rows("mart", _any_null("touchpoint_channel_group attributed_revenue_usd")),
        ),
        (
            "mart_attribution_channel_comparison",
            "credit is not negative",
            _bad_rows("mart", "least(attributed_conversion_credit, attributed_revenue_usd) < 0"),
        ),
        (
            "mart_attribution_channel_comparison",
            "totals are those of the population",
            "SELECT count(*) FROM (SELECT analysis_population AS p, sum(attributed_conversion_credit) AS c, "
            "sum(attributed_revenue_usd) AS v FROM mart GROUP BY analysis_population, attribution_model) JOIN "
            "(SELECT 'all_observed' AS p, count(*) AS n, sum(transaction_revenue_usd) AS r FROM bridge WHERE is_last_touchpoint "
            "UNION ALL SELECT 'complete_window', count(*), sum(transaction_revenue_usd) FROM bridge "
            "WHERE is_last_touchpoint AND NOT is_lookback_left_censored) USING (p) "
            "WHERE abs(c - n) > 1e-6 OR abs(v - r) > 0.01",
        ),
        (
            "mart_attribution_channel_comparison",
            "shares sum to one",
            _bad_groups(
                "mart",
                _cells_of,
                "abs(sum(model_conversion_share) - 1) > 1e-9 OR abs(sum(model_revenue_share) - 1) > 1e-9",
            ),
        ),
        (
            "mart_attribution_channel_comparison",
            "deltas against last touch cancel",
            _bad_groups("mart", _cells_of, "abs(sum(revenue_delta_vs_last_touch_usd)) > 0.01"),
        ),
        (
            "mart_attribution_channel_comparison",
            "models agree within a population",
            _bad_groups(
                "mart",
                "analysis_population",
                "max(model_total_attributed_revenue_usd) - min(model_total_attributed_revenue_usd) > 0.01",
            ),
        ),
        (
            "mart_attribution_channel_comparison",
            "last touch equals its baseline",
            _bad_rows("mart", "attribution_model = 'last_touch' AND abs(revenue_delta_vs_last_touch_usd) > 0.01"),
        ),
        (
            "mart_attribution_channel_comparison",
            "last non-direct equals its baseline",
            _bad_rows(
                "mart", "attribution_model = 'last_non_direct' AND abs(revenue_delta_vs_last_non_direct_usd) > 0.01"
            ),
        ),
        ("channel_shift_analysis", "analysis is complete", _holds("(SELECT count(*) FROM shift) = 28")),
        (
            "channel_shift_analysis",
            "comparison models are present",
            _holds("(SELECT count(DISTINCT attribution_model) FROM shift) = 4"),
        ),
        (
            "channel_shift_analysis",
            "channels are present",
            _holds("(SELECT count(DISTINCT touchpoint_channel_group) FROM shift) = 7"),
        ),
        ("channel_shift_analysis", "analysis fields are set", _bad_rows("shift", "x IS NULL OR y IS NULL")),
        (
            "channel_shift_analysis",
            "shifts cancel within a model",
            _bad_groups("shift", "attribution_model", "abs(sum(x)) > 0.01 OR abs(sum(y)) > 0.01"),
        ),
        (
            "dim_pseudo_users",
            "users are unique",
            _bad_groups("(SELECT DISTINCT user_pseudo_id FROM ses)", "user_pseudo_id", "count(*) > 1"),
        ),
        (
            "dim_pseudo_users",
            "event dates are ordered",
            _bad_groups("ses", "user_pseudo_id", "min(session_date) > max(session_date)"),
        ),
        (
            "dim_pseudo_users",
            "purchase dates are ordered",
            _bad_groups("tx", "user_pseudo_id", "min(transaction_date) > max(transaction_date)"),
        ),
        (
            "dim_pseudo_users",
            "transactions reconcile",
            _bad_rows("tx", "user_pseudo_id NOT IN (SELECT user_pseudo_id FROM ses)"),
        ),
        (
            "fct_transaction_items",
            "transaction_item_key is unique",
            _bad_groups(_items_of_tx, "transaction_key, item_offset", "count(*) > 1"),
        ),
        ("fct_transaction_items", "items are linked", _bad_rows(_items_of_tx, "transaction_key IS NULL OR item_record_fingerprint IS NULL")),
        ("fct_transaction_items", "quantities are not negative", _bad_rows(_items_of_tx, "item_quantity < 0")),
        (
            "fct_transaction_items",
            "all items of transactions are present",
            _holds(f"(SELECT count(*) FROM {_items_of_tx}) = (SELECT sum(item_record_count) FROM tx)"),
        ),
        (
            "fct_transaction_items",
            "transactions with items are present",
            _holds(f"(SELECT count(DISTINCT transaction_key) FROM {_items_of_tx}) = (SELECT count(*) FROM tx WHERE item_record_count > 0)"),
        ),
        ("mart_attribution_paths", "journeys are unique", _bad_groups("tx", "transaction_key", "count(*) > 1")),
        (
            "mart_attribution_paths",
            "paths are set",
            _bad_rows("tx", "transaction_key NOT IN (SELECT transaction_key FROM bridge WHERE touchpoint_channel_group IS NOT NULL)"),
        ),
        (
            "mart_attribution_paths",
            "all transactions have a path",
            _holds("(SELECT count(DISTINCT transaction_key) FROM bridge) = (SELECT count(*) FROM tx)"),
        ),
        (
            "mart_attribution_paths",
            "revenue is represented",
            _holds(
                "abs((SELECT sum(transaction_revenue_usd) FROM bridge WHERE is_first_touchpoint) - "
                "(SELECT sum(transaction_revenue_usd) FROM tx)) <= 0.01"
            ),
        ),
        *[
            row
            for name, key in (("dim_channel", "session_channel_group"), ("dim_geo", "geo_country, geo_region"))
            for row in (
                (name, "members are unique", _bad_groups(f"(SELECT DISTINCT {key} FROM ses)", key, "count(*) > 1")),
                (name, "members are named", _bad_rows("ses", _any_null(key.replace(",", "")))),
                (
                    name,
                    "all sessions have a member",
                    _holds(f"(SELECT sum(n) FROM (SELECT count(*) AS n FROM ses GROUP BY {key})) = (SELECT count(*) FROM ses)"),
                ),
            )
        ],
    ]
)
_corrs = "session_correlation revenue_correlation"
_ratios = "session_scale_ratio transaction_scale_ratio revenue_scale_ratio"
ORACLES["geo_contracts"] = _report(
    [
        ("fct_geo_weekly_outcomes", "regions have all weeks", _bad_groups("outcome", "geo_region", "count(*) <> 344")),
        (
            "fct_geo_weekly_outcomes",
            "regions have all PRE and TEST weeks",
            _bad_groups("outcome", "geo_region", "count(*) FILTER (pre) <> 260 OR count(*) FILTER (NOT pre) <> 84"),
        ),
        (
            "fct_geo_weekly_outcomes",
            "panel keys are set",
            _bad_rows("outcome", _any_null("geo_key geo_region week_start_date period_name")),
        ),
        (
            "fct_geo_weekly_outcomes",
            "outcomes are not negative",
            _bad_rows(
                "outcome",
                "least(observed_session_count, observed_unique_users, observed_transaction_count, "
                "observed_revenue_usd, observed_item_quantity) < 0",
            ),
        ),
        (
            "fct_geo_weekly_outcomes",
            "outcomes are observed and unassigned",
            _bad_rows("outcome", "treatment_assignment_status <> 'UNASSIGNED' OR is_synthetic_outcome"),
        ),
        (
            "fct_geo_weekly_outcomes",
            "sessions reconcile",
            _holds("(SELECT sum(observed_session_count) FROM outcome) = (SELECT count(*) FROM target)"),
        ),
        (
            "fct_geo_weekly_outcomes",
            "transactions reconcile",
            _holds(
                "(SELECT sum(observed_transaction_count) FROM outcome) = "
                "(SELECT sum(canonical_transaction_count) FROM target)"
            ),
        ),
        (
            "fct_geo_weekly_outcomes",
            "revenue reconciles",
            _holds("(SELECT sum(observed_revenue_usd) FROM outcome) = (SELECT sum(canonical_revenue_usd) FROM target)"),
        ),
        ("region_features", "regions are unique", _bad_groups("feature", "geo_region", "count(*) > 1")),
        ("region_features", "regions have all PRE weeks", _bad_rows("feature", "pre_weeks <> 260")),
        (
            "region_features",
            "variation agrees with the panel",
            _bad_rows("feature", "abs(revenue_cv - warehouse_revenue_cv) > 1e-6 * (1 + warehouse_revenue_cv)"),
        ),
        (
            "region_features",
            "features are defined",
            _bad_rows(
                "feature",
                _any_null("pre_transaction_rate_pct revenue_cv session_trend_pct_per_week revenue_trend_pct_per_week"),
            ),
        ),
        *[
            row
            for z in [*_z, "z_scale_index"]
            for row in (
                ("matching_profiles", f"{z} has mean zero", f"SELECT CASE WHEN abs(avg({z})) <= 1e-10 THEN 0 ELSE 1 END FROM zed"),
                (
                    "matching_profiles",
                    f"{z} has deviation one",
                    f"SELECT CASE WHEN abs(stddev_pop({z}) - 1) <= 1e-10 THEN 0 ELSE 1 END FROM zed",
                ),
            )
        ],
        ("pair_metrics", "pair_id is unique", _bad_groups("duo", "pair_id", "count(*) > 1")),
        ("pair_metrics", "pair measures are defined", _bad_rows("duo", _any_null(_pair_floats))),
        (
            "pair_metrics",
            "distances are not negative",
            _bad_rows(
                "duo",
                "least(category_balanced_feature_distance, six_feature_distance_sensitivity, session_shape_nrmse, "
                "revenue_shape_nrmse) < 0",
            ),
        ),
        (
            "pair_metrics",
            "correlations lie in [-1, 1]",
            _bad_rows("duo", " OR ".join(f"abs({c}) > 1 + 1e-12" for c in _corrs.split())),
        ),
        (
            "pair_metrics",
            "scale ratios lie in (0, 1]",
            _bad_rows("duo", " OR ".join(f"{c} <= 0 OR {c} > 1" for c in _ratios.split())),
        ),
        (
            "candidate_designs",
            "regions are not reused",
            _bad_groups(
                "(SELECT design_name, unnest([region_a, region_b]) AS region FROM chosen)",
                "design_name, region",
                "count(*) > 1",
            ),
        ),
    ]
)
