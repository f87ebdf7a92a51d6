"""DuckDB oracle CTEs for the listing jobs, computed from base columns only.

They restate, in SQL over customer / nation / region / orders / part, what the
rendered pages contain and what the listing rules must extract from them.
"""

from .sqlkit import r10, sid

SEG = """seg AS (
  SELECT keyword, CAST(row_number() OVER (ORDER BY keyword) - 1 AS INTEGER) AS keyword_index,
         coalesce(lead(keyword) OVER (ORDER BY keyword), first_value(keyword) OVER (ORDER BY keyword)) AS next_keyword
  FROM (SELECT DISTINCT c_mktsegment AS keyword FROM customer))"""

CUST = f"""c AS (
  SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, n_name AS nat, r_name AS reg,
         CAST(c_custkey % 90 AS VARCHAR) || '.5' AS lat, CAST(c_custkey % 180 AS VARCHAR) || '.25' AS lng
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cf AS (
  SELECT *,
    'https://www.google.com/maps/place/' || replace(name, '#', '+') || '/@' || lat || ',' || lng || ',17z' AS canon,
    'https://www.google.com/maps/place/' || replace(name, '#', '+') || '/@' || lat || ',' || lng || ',17z'
      || CASE WHEN k % 4 = 1 THEN '?hl=en' ELSE '' END AS place_url,
    CASE WHEN k % 11 = 0 THEN name || ' · ' || seg WHEN k % 13 = 0 THEN name
         ELSE name || ' · ' || seg || ' · ' || {r10('k % 51')} || ' stars · ' || format('{{:,}}', k * 37) || ' reviews'
              || CASE WHEN k % 17 = 0 THEN ' · Open 24 hours' ELSE '' END END AS raw_label,
    CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN NULL ELSE seg END AS category,
    CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN NULL ELSE CAST(k % 51 AS DOUBLE) / 10 END AS rating,
    CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN NULL ELSE CAST(k * 37 AS BIGINT) END AS review_count,
    CASE WHEN k % 17 = 0 AND k % 11 <> 0 AND k % 13 <> 0 THEN 'Open 24 hours' END AS snippet
  FROM c)"""


def search_ctes(limit: int | None = None) -> str:
    lim = "" if limit is None else f"WHERE rank <= {max(limit, 1)}"
    return f"""{SEG},
{CUST},
listed AS (
  SELECT cf.*, seg AS keyword FROM cf
  UNION ALL
  SELECT cf.*, s.next_keyword AS keyword FROM cf JOIN seg s ON cf.seg = s.keyword WHERE cf.k % 10 = 0),
ranked AS (
  SELECT *, nat AS region, CAST(row_number() OVER (PARTITION BY keyword, nat ORDER BY k) AS INTEGER) AS rank FROM listed),
sr AS (
  SELECT r.*, s.keyword_index, {sid('r.keyword', 'r.region', 'r.place_url', 'r.name', 'r.rank - 1')} AS id
  FROM ranked r JOIN seg s ON r.keyword = s.keyword {lim})"""


def place_ctes(limit: int | None = None, dedup: bool = False) -> str:
    d = ""
    if dedup:
        d = """,
pd AS (
  SELECT * FROM (SELECT pl.*, row_number() OVER (PARTITION BY region, pid ORDER BY keyword_index, rank) AS dn FROM pl)
  WHERE dn = 1)"""
    return search_ctes(limit) + f""",
pl0 AS (
  SELECT sr.*,
    CASE WHEN k % 3 = 0 THEN place_url ELSE canon END AS source_url,
    CASE WHEN k % 3 = 1 THEN seg ELSE category END AS p_category,
    CASE k % 3 WHEN 1 THEN CAST(k AS VARCHAR) || ' Main St, ' || nat || ', ' || reg
               WHEN 2 THEN CAST(k AS VARCHAR) || ' Side Rd, ' || nat
               ELSE seg || ' in ' || nat || ' City' END AS address,
    CAST(lat AS DOUBLE) AS p_lat, CAST(lng AS DOUBLE) AS p_lng,
    CASE WHEN k % 3 = 0 THEN rating ELSE CAST(k % 41 AS DOUBLE) / 10 END AS p_rating,
    CASE WHEN k % 3 = 0 THEN review_count ELSE CAST(k * 3 AS BIGINT) END AS p_review_count,
    CASE k % 3 WHEN 1 THEN repeat('$', CAST(k % 4 + 1 AS INTEGER)) WHEN 2 THEN '$$$' END AS price_level,
    CASE WHEN k % 2 = 0 THEN '+1-555-' || CAST(k AS VARCHAR) END AS phone,
    CASE WHEN k % 5 <> 0 THEN 'https://site' || CAST(k AS VARCHAR) || '.example.com/'
         WHEN k % 2 = 1 THEN 'https://alt' || CAST(k AS VARCHAR) || '.example.com/' END AS website,
    seg || ' in ' || nat || ' City' AS description,
    CASE WHEN k % 3 = 0 THEN name || ' - Google Maps' ELSE name END AS raw_title,
    keyword || '|' || region || '|' || name AS keywords
  FROM sr),
pl AS (SELECT pl0.*, {sid('source_url', 'name', 'region')} AS pid FROM pl0){d}"""


PLACE_COLS = """pid AS id, id AS search_result_id, keyword AS search_keyword, region, name, p_category AS category,
  address, p_lat AS lat, p_lng AS lng, p_rating AS rating, p_review_count AS review_count, price_level, phone, website,
  description, source_url, place_url AS search_url, raw_title, raw_label, keywords"""


def review_ctes(limit: int | None = None, place_limit: int | None = None) -> str:
    lim = "" if limit is None else f"WHERE idx < {max(limit, 1)}"
    return place_ctes(place_limit, dedup=True) + f""",
ob AS (
  SELECT o_orderkey AS o, o_custkey AS ok, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS pri,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 10 = 0), o_orderkey) - 1 AS BIGINT) AS idx
  FROM orders),
rv AS (
  SELECT pd.pid AS place_id, pd.source_url AS src, pd.name AS pname, ob.*
  FROM pd JOIN ob ON ob.ok = pd.k {lim})"""


REVIEW_COLS = f"""CASE WHEN o % 10 = 2 THEN {sid('place_id', 'pname', 'd', 'pri', 'idx')} ELSE 'o' || CAST(o AS VARCHAR) END AS id,
  place_id, src AS place_url, pname AS author_name, CAST(NULL AS VARCHAR) AS author_profile_url,
  CAST(o % 51 AS DOUBLE) / 10 AS rating, d AS published_at, pri AS text, CAST(NULL AS VARCHAR) AS translated_text,
  CASE WHEN o % 4 = 0 THEN CAST(o % 97 AS BIGINT) END AS likes, src AS source_url,
  'Reviewed by ' || pname || ' · ' || {r10('o % 51')} || ' stars · Posted on ' || d AS raw_label"""
