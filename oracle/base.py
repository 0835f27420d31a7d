"""Common CTEs of the oracle: the fixture mapping written in DuckDB SQL over
the driver's flat `events` / `customer` tables, with one column per looked-up
parameter and one row per item. The shard suffix is rebuilt as text
(`intraday_` + date for the last day) so windows are compared the way the
source reports compare `_table_suffix`."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2024, 1, 30)


def d(days_back: int) -> str:
    return (AS_OF - dt.timedelta(days=days_back)).strftime("%Y%m%d")


BASE = r"""
src AS (
  SELECT event_id, ts, user_id AS uid, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dd
  FROM events
),
traffic(j, t_source, t_medium, t_campaign) AS (VALUES
  (0,'google','cpc','brand'), (1,'google','organic',NULL), (2,'bing','ppc','fall'),
  (3,'facebook','paid-social','fb1'), (4,'instagram','social','ig'), (5,'youtube','cpc','yt1'),
  (6,'vimeo','video','vm'), (7,'amazon','cpc','shopping-a'), (8,'etsy','referral','crafts'),
  (9,'newsletter','email','oct-news'), (10,'newsletter','email','nov-news'),
  (11,'partner','affiliate','aff1'), (12,'blog','referral',NULL), (13,'podcast','audio','pod'),
  (14,'sms','sms','txt'), (15,'app','web push','wp'), (16,'app','mobile-notification','mn'),
  (17,'adnet','display','ban'), (18,'x','cpc','cross-network'), (19,'unknownsite','other','misc'),
  (20,'(direct)','(not set)',NULL), (21,'dm','e-mail','dm1'), (22,'google','cpc','shop-sale'),
  (23,NULL,'email','oct-news')
),
alt_source(j, v) AS (SELECT * FROM (VALUES
  (0,'alibaba'), (1,'amazon'), (2,'google shopping'), (3,'shopify'), (4,'etsy'), (5,'ebay'), (6,'stripe'), (7,'walmart'),
  (8,'baidu'), (9,'bing'), (10,'duckduckgo'), (11,'ecosia'), (12,'google'), (13,'yahoo'), (14,'yandex'),
  (15,'badoo'), (16,'facebook'), (17,'fb'), (18,'instagram'), (19,'linkedin'), (20,'pinterest'), (21,'tiktok'),
  (22,'twitter'), (23,'whatsapp'), (24,'dailymotion'), (25,'disneyplus'), (26,'netflix'), (27,'youtube'), (28,'vimeo'),
  (29,'twitch'), (30,'email'), (31,'e-mail'), (32,'e_mail'), (33,'e mail'), (34,'(direct)'), (35,'plain'), (36,NULL))),
alt_medium(j, v) AS (SELECT * FROM (VALUES
  (0,'cpc'), (1,'ppc'), (2,'paid'), (3,'paid' || chr(13) || 'x'), (4,'a' || chr(13) || 'cpc'), (5,'xcp' || chr(8232) || 'y'),
  (6,'organic'), (7,'(none)'), (8,'(not set)'), (9,'display'), (10,'banner'), (11,'expandable'), (12,'interstitial'), (13,'cpm'),
  (14,'social'), (15,'social-network'), (16,'social-media'), (17,'sm'), (18,'social network'), (19,'social media'),
  (20,'a video b'), (21,'vi' || chr(133) || ' video'), (22,'email'), (23,'e-mail'), (24,'e_mail'), (25,'e mail'),
  (26,'affiliate'), (27,'referral'), (28,'audio'), (29,'sms'), (30,'web push'), (31,'mobile'), (32,'app notification'),
  (33,'misc'), (34,'ppc' || chr(10)), (35,NULL))),
alt_campaign(j, v) AS (SELECT * FROM (VALUES
  (0,NULL), (1,'brand'), (2,'cross-network x'), (3,'e-shop'), (4,'a' || chr(13) || 'shopping'))),
first_user(r, fu_source, fu_medium, fu_name) AS (VALUES
  (0,'google','cpc','brand'), (1,NULL,NULL,NULL), (2,'newsletter','email','oct-news'), (3,'facebook','social','fb1')
),
ev AS (
  SELECT
    s.event_id, s.uid, s.k, s.value, s.ts,
    'u' || CAST(s.uid AS VARCHAR) AS user_pseudo_id,
    CASE WHEN s.uid % 5 = 2 THEN CASE WHEN s.k % 2 = 0 THEN '9' ELSE '10' END
      WHEN s.uid % 3 = 0 THEN NULL ELSE CAST(s.uid AS VARCHAR) END AS user_id,
    CASE s.event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
      WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'session_start'
      WHEN 'error' THEN 'user_engagement' END AS event_name,
    epoch_us(s.ts) AS event_timestamp,
    strftime(s.ts, '%Y%m%d') AS event_date,
    CASE WHEN CAST(s.ts AS DATE) = DATE '2024-01-30' THEN 'intraday_' ELSE '' END
      || strftime(s.ts, '%Y%m%d') AS suffix,
    CASE WHEN s.event_id % 37 <> 0 THEN CAST(1704067200 + (s.dd - ((s.dd % 3) + 3) % 3) * 86400 AS BIGINT) END AS ga_session_id,
    CASE WHEN s.event_type = 'view' THEN
      CASE s.k % 7 WHEN 0 THEN 'Home | Demo' WHEN 1 THEN 'Shows  | Demo' WHEN 2 THEN 'Tickets | Demo'
        WHEN 3 THEN 'Plain title' WHEN 5 THEN 'Ho' || chr(13) || 'me | Demo'
        WHEN 6 THEN 'Late' || chr(8232) || 'show' || chr(11) || chr(133) || ' | Demo' END END AS page_title,
    CAST(CASE WHEN s.event_type = 'signup' THEN s.event_id % 4 + 1 ELSE 99 END AS BIGINT) AS ga_session_number,
    CASE s.event_id % 3 WHEN 0 THEN '1' WHEN 2 THEN '0' END AS engaged_str,
    CAST(CASE WHEN s.event_id % 3 = 1 THEN 1 END AS BIGINT) AS engaged_int,
    CAST(CASE WHEN s.event_id % 2 = 0 THEN floor(s.value * 1000) END AS BIGINT) AS engagement_time_msec,
    CASE WHEN s.k % 4 = 0 THEN NULL WHEN s.event_id % 7 = 3 THEN a_s.v ELSE t.t_source END AS source,
    CASE WHEN s.k % 4 = 0 THEN NULL WHEN s.event_id % 7 = 3 THEN a_m.v ELSE t.t_medium END AS medium,
    CASE WHEN s.k % 4 = 0 THEN NULL WHEN s.event_id % 7 = 3 THEN a_c.v ELSE t.t_campaign END AS campaign,
    CASE WHEN s.event_type = 'purchase' THEN s.value END AS purchase_revenue,
    f.fu_source AS ts_source, f.fu_medium AS ts_medium, f.fu_name AS ts_name,
    'R' || CAST((s.uid + s.k % 2) % 5 AS VARCHAR) AS geo_continent,
    'S' || CAST((s.uid + s.k % 3) % 10 AS VARCHAR) AS geo_sub_continent,
    'C' || CAST((s.uid + s.k % 5) % 25 AS VARCHAR) AS geo_country,
    'G' || CAST((s.uid + s.k % 7) % 40 AS VARCHAR) AS geo_region,
    CASE WHEN s.k % 6 <> 0 THEN 'T' || CAST(s.uid % 50 AS VARCHAR) END AS geo_city,
    'M' || CAST((s.uid + s.k % 4) % 20 AS VARCHAR) AS geo_metro
  FROM src s
  LEFT JOIN traffic t ON t.j = CASE WHEN s.k % 10 = 0 THEN s.k % 24
    ELSE ((s.uid * 7 + CAST(floor(s.dd / 3) AS BIGINT)) % 24 + 24) % 24 END
  LEFT JOIN alt_source a_s ON a_s.j = (s.event_id // 7) % 37
  LEFT JOIN alt_medium a_m ON a_m.j = (s.event_id // 7) % 36
  LEFT JOIN alt_campaign a_c ON a_c.j = (s.event_id // 7) % 5
  LEFT JOIN first_user f ON f.r = (s.uid + CASE WHEN s.k % 9 = 0 THEN 1 ELSE 0 END) % 4
),
item_shapes(shape, kind) AS (VALUES (0,'sku'), (1,'sku'), (1,'Donation'), (2,'Fees'), (3,'hd3g4y'), (3,'Fees')),
ev_items AS (
  SELECT e.*,
    CASE sh.kind WHEN 'sku' THEN 'SKU' || CAST(e.k % 7 AS VARCHAR) ELSE sh.kind END AS item_id,
    CASE sh.kind WHEN 'sku' THEN 'Show ' || CAST(e.k % 7 AS VARCHAR) WHEN 'Donation' THEN 'Annual fund'
      WHEN 'Fees' THEN 'Handling' WHEN 'hd3g4y' THEN 'Gift' END AS item_name,
    e.price, CAST(e.k % 3 + 1 AS BIGINT) AS quantity,
    CASE WHEN e.event_name = 'purchase' THEN e.price * CAST(e.k % 3 + 1 AS DOUBLE) END AS item_revenue
  FROM (SELECT *, CASE
      WHEN k % 20 = 0 THEN CAST('0.0005' AS DOUBLE) * CAST(k % 3 + 1 AS DOUBLE)
      WHEN k % 20 = 1 AND event_name = 'add_to_cart' THEN CAST('12345678.25' AS DOUBLE) + CAST(k % 3 AS DOUBLE)
      ELSE CAST(floor(value) AS DOUBLE) + CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) END AS price FROM ev) e
    JOIN item_shapes sh ON sh.shape = e.k % 4
  WHERE e.event_name IN ('add_to_cart', 'purchase')
),
buyers AS (
  SELECT c_custkey AS const_id, CAST(0 AS INTEGER) AS new, CAST(1 AS INTEGER) AS renew, CAST(0 AS INTEGER) AS lapsed
  FROM customer WHERE c_custkey % 10 = 0
  UNION ALL
  SELECT c_custkey AS const_id,
    CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS new,
    CAST(CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS renew,
    CAST(CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS lapsed
  FROM customer
),
campaigns(name, ldate, send_amt, opens, uniqueopens, linkclicks, uniquelinkclicks, subscriberclicks,
          forwards, uniqueforwards, hardbounces, softbounces, unsubscribes, unsubreasons, replies,
          uniquereplies, socialshares) AS (VALUES
  ('oct-news','2023-10-03','1200','640','410','95','71','60','12','9','14','6','8','3','5','4','2'),
  ('oct-news','2023-10-24','1180','600','398','88','64','55','10','8','11','4','7',NULL,'4','3','1'),
  ('nov-news','2023-11-07','1310','702','455','120','90','81','15','12','9','5','6','2','6','5','3'),
  ('never-used','2023-12-01','900','300','250','40','33','30','4','4','7','2','3','1','1','1','0')
)"""


def win(days: int, end: int = 0) -> str:
    """Digits of the shard suffix within [as_of - days, as_of - end]."""
    return f"regexp_extract(suffix, '[0-9]+') BETWEEN '{d(days)}' AND '{d(end)}'"


def raw_win(days: int, end: int) -> str:
    """Raw shard suffix compare: intraday shards sort after digits."""
    return f"suffix BETWEEN '{d(days)}' AND '{d(end)}'"


def channel_case(s: str, m: str, c: str) -> str:
    """The channel rules as SQL of their own (RE2: partial match, `$` = end of
    text), written from the reports and not from the library's rule table."""
    def has(col: str, pattern: str) -> str:
        return f"regexp_matches({col}, '{pattern}')"

    shop = f"({has(s, 'alibaba|amazon|google shopping|shopify|etsy|ebay|stripe|walmart')} OR {has(c, '^(.*(([^a-df-z]|^)shop|shopping).*)$')})"
    paid = has(m, "^(.*cp.*|ppc|paid.*)$")
    search = has(s, "baidu|bing|duckduckgo|ecosia|google|yahoo|yandex")
    social = has(s, "badoo|facebook|fb|instagram|linkedin|pinterest|tiktok|twitter|whatsapp")
    video = has(s, "dailymotion|disneyplus|netflix|youtube|vimeo|twitch|vimeo|youtube")
    mail = "email|e-mail|e_mail|e mail"
    return f"""CASE
    WHEN {s} = '(direct)' AND {m} IN ('(not set)', '(none)') THEN 'Direct'
    WHEN {has(c, 'cross-network')} THEN 'Cross-network'
    WHEN {shop} AND {paid} THEN 'Paid Shopping'
    WHEN {search} AND {paid} THEN 'Paid Search'
    WHEN {social} AND {paid} THEN 'Paid Social'
    WHEN {video} AND {paid} THEN 'Paid Video'
    WHEN {m} IN ('display', 'banner', 'expandable', 'interstitial', 'cpm') THEN 'Display'
    WHEN {shop} THEN 'Organic Shopping'
    WHEN {social} OR {m} IN ('social', 'social-network', 'social-media', 'sm', 'social network', 'social media') THEN 'Organic Social'
    WHEN {video} OR {has(m, '^(.*video.*)$')} THEN 'Organic Video'
    WHEN {search} OR {m} = 'organic' THEN 'Organic Search'
    WHEN {has(s, mail)} OR {has(m, mail)} THEN 'Email'
    WHEN {m} = 'affiliate' THEN 'Affiliates'
    WHEN {m} = 'referral' THEN 'Referral'
    WHEN {m} = 'audio' THEN 'Audio'
    WHEN {m} = 'sms' THEN 'SMS'
    WHEN {m} LIKE '%push' OR {has(m, 'mobile|notification')} THEN 'Mobile Push Notifications'
    ELSE 'Unassigned' END"""


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = BASE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
