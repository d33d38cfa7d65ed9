"""Relational analytics over companies, filings, sections and derived edges, as SQL.

Each entry is text for both engines, or a pair where they spell something differently (or the engine has another plan). Tables stand
in braces. Companies are customers, filings are orders, sections are lineitem rows; a market edge
joins a company to the nations of its filings' suppliers, a competitor edge to the suppliers.
"""

from __future__ import annotations

FY = "CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS BIGINT)"
GEO = """geo AS (SELECT DISTINCT o_custkey AS cik, n_name AS market, n_regionkey AS regionkey FROM {orders}
  JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey)"""
COMP = "comp AS (SELECT DISTINCT o_custkey AS cik, l_suppkey AS rival FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey)"
PROD = "prod AS (SELECT DISTINCT o_custkey AS cik, p_brand AS segment, p_type AS category FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey)"
JOINED_SPARK, JOINED_DUCK = "array_join(sort_array(collect_set({0})), ',')", "array_to_string(list_sort(list_distinct(list({0}))), ',')"


def _both(sql: str, **pairs: tuple[str, str]) -> tuple[str, str]:
    """The text with each @name@ replaced by its spelling in either engine."""
    spark = duck = sql
    for name, (a, b) in pairs.items():
        spark, duck = spark.replace(f"@{name}@", a), duck.replace(f"@{name}@", b)
    return spark, duck


def _joined(column: str) -> tuple[str, str]:
    return JOINED_SPARK.format(column), JOINED_DUCK.format(column)


STATS = {
    "markets_by_year": f"""SELECT {FY} AS fiscal_year, n_name AS market, count(DISTINCT o_custkey) AS companies FROM {{orders}}
      JOIN {{lineitem}} ON o_orderkey = l_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
      GROUP BY 1, 2 ORDER BY 1, 2""",
    "stats_filings_by_year": f"SELECT {FY} AS fiscal_year, count(*) AS filings FROM {{orders}} GROUP BY 1 ORDER BY 1",
    "stats_node_counts": """SELECT 'Company' AS label, count(*) AS n FROM {customer} UNION ALL SELECT 'Filing', count(*) FROM {orders}
      UNION ALL SELECT 'Section', count(*) FROM {lineitem} UNION ALL SELECT 'Competitor', count(*) FROM {supplier}
      UNION ALL SELECT 'GeographicMarket', count(*) FROM {nation} UNION ALL SELECT 'Product', count(*) FROM {part}""",
    "stats_edge_counts": f"WITH {GEO}, {COMP}, {PROD}" + """ SELECT 'OPERATES_IN' AS relation, count(*) AS n FROM geo UNION ALL SELECT 'COMPETES_WITH', count(*) FROM comp
      UNION ALL SELECT 'OFFERS', count(*) FROM prod UNION ALL SELECT 'FILED_BY', count(*) FROM {orders} UNION ALL SELECT 'HAS_SECTION', count(*) FROM {lineitem}""",
    "stats_sections_by_type": "SELECT l_returnflag AS section_type, count(*) AS sections, avg(l_quantity) AS avg_words FROM {lineitem} GROUP BY 1",
    "stats_top_companies": """SELECT c_custkey AS cik, c_name AS name, count(*) AS filings FROM {customer} JOIN {orders} ON c_custkey = o_custkey
      GROUP BY 1, 2 ORDER BY filings DESC, cik LIMIT 20""",
    "stats_year_range": f"SELECT min({FY}) AS first_year, max({FY}) AS last_year, count(DISTINCT {FY}) AS years FROM {{orders}}",
    "stats_top_markets": f"WITH {GEO} SELECT market, count(*) AS companies FROM geo GROUP BY 1 ORDER BY companies DESC, market LIMIT 15",
    "stats_top_competitors": f"WITH {COMP} SELECT rival, count(*) AS companies FROM comp GROUP BY 1 ORDER BY companies DESC, rival LIMIT 15",
    "approx_companies_per_market": (f"WITH {GEO} SELECT market, approx_count_distinct(cik) AS companies FROM geo GROUP BY 1", None),
    "company_filing_history": f"""SELECT c_custkey AS cik, o_orderkey AS accession, o_orderpriority AS form_type, CAST(o_orderdate AS DATE) AS filing_date, {FY} AS fiscal_year,
      CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS recency FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey""",
    "target_list_top1": """SELECT cik, accession, form_type FROM (SELECT o_custkey AS cik, o_orderkey AS accession, o_orderpriority AS form_type,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1""",
    "latest_n_filings": """SELECT cik, accession, CAST(rn AS BIGINT) AS recency FROM (SELECT o_custkey AS cik, o_orderkey AS accession,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) t WHERE rn <= 3""",
    "filing_pairs": """SELECT * FROM (SELECT o_custkey AS cik, o_orderkey AS latest, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS previous
      FROM {orders}) t WHERE previous IS NOT NULL""",
    "target_page_offset": "SELECT c_custkey AS cik, c_name AS name FROM {customer} ORDER BY c_custkey LIMIT 25 OFFSET 50",
    "pending_anti_join": "SELECT o_orderkey AS accession FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "incomplete_years_matrix": f"""SELECT o_custkey AS cik, {FY} AS fiscal_year, count(DISTINCT l_returnflag) AS section_types,
      CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 'Complete' WHEN count(DISTINCT l_returnflag) > 0 THEN 'Partial' ELSE 'Missing' END AS status
      FROM {{orders}} LEFT JOIN {{lineitem}} ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "collect_markets_per_company": _both(f"WITH {GEO} SELECT cik, @all@ AS markets, count(*) AS n_markets FROM geo GROUP BY 1", all=_joined("market")),
    # companies of one home and sector are compared with one another
    "shared_markets": f"""WITH {GEO}, held AS (SELECT c_nationkey AS home, c_mktsegment AS sector, market, count(*) AS n FROM geo JOIN {{customer}} ON c_custkey = cik GROUP BY 1, 2, 3),
      size AS (SELECT c_nationkey AS home, c_mktsegment AS sector, count(*) AS companies FROM {{customer}} WHERE c_custkey IN (SELECT cik FROM geo) GROUP BY 1, 2)
      SELECT held.home, held.sector, market, companies FROM held JOIN size ON held.home = size.home AND held.sector = size.sector WHERE n = companies AND companies > 1""",
    "unique_markets": f"""WITH {GEO}, held AS (SELECT c_nationkey AS home, c_mktsegment AS sector, market, count(*) AS n, min(cik) AS cik FROM geo JOIN {{customer}} ON c_custkey = cik GROUP BY 1, 2, 3)
      SELECT home, sector, cik, market FROM held WHERE n = 1""",
    "presence_matrix": f"""WITH {GEO}, s AS (SELECT DISTINCT market, c_mktsegment AS sector FROM geo JOIN {{customer}} ON c_custkey = cik) SELECT market,
      max(CASE WHEN sector = 'AUTOMOBILE' THEN 'Yes' ELSE '' END) AS automobile, max(CASE WHEN sector = 'BUILDING' THEN 'Yes' ELSE '' END) AS building,
      max(CASE WHEN sector = 'FURNITURE' THEN 'Yes' ELSE '' END) AS furniture, max(CASE WHEN sector = 'HOUSEHOLD' THEN 'Yes' ELSE '' END) AS household,
      max(CASE WHEN sector = 'MACHINERY' THEN 'Yes' ELSE '' END) AS machinery FROM s GROUP BY 1""",
    "china_style_alias_union": f"WITH {GEO} SELECT DISTINCT cik FROM geo WHERE market IN ('CHINA', 'NATION_1') UNION SELECT cik FROM geo WHERE market LIKE '%2'",
    "alias_merge": f"""WITH {GEO}, canon AS (SELECT market, min(market) OVER (PARTITION BY regionkey) AS canonical, cik FROM geo)
      SELECT canonical, count(DISTINCT cik) AS companies, count(*) AS edges_before FROM canon GROUP BY 1""",
    "competitor_prune": f"""WITH {COMP}, deg AS (SELECT rival, count(*) AS degree FROM comp GROUP BY 1)
      SELECT comp.cik, comp.rival FROM comp JOIN deg ON comp.rival = deg.rival WHERE degree > 1""",
    "competitor_degree": f"""WITH {COMP} SELECT s_suppkey AS rival, count(cik) AS degree, count(cik) <= 1 AS pruned FROM {{supplier}} LEFT JOIN comp ON rival = s_suppkey GROUP BY 1""",
    "competitor_degree_buckets": f"""WITH m AS (SELECT o_custkey AS cik, l_suppkey AS rival, count(*) AS mentions FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey GROUP BY 1, 2)
      SELECT CASE WHEN mentions = 1 THEN '1' WHEN mentions = 2 THEN '2' WHEN mentions <= 9 THEN '3-9' ELSE '10+' END AS bucket, count(*) AS pairs FROM m GROUP BY 1""",
    "parallel_edge_check": "SELECT o_custkey AS cik, l_suppkey AS rival, count(*) AS edges FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(*) > 1",
    "edge_endpoint_semi": """SELECT l_orderkey AS accession, l_suppkey AS rival, count(*) AS n FROM {lineitem} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
      AND EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY 1, 2""",
    "edge_merge_last_writer": _both(
        """SELECT o_custkey AS cik, l_suppkey AS rival, @last@ AS filing_ref, count(*) AS writes FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1, 2""",
        last=("max_by(o_orderkey, struct(o_orderdate, o_orderkey))", "arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey))"),
    ),
    "node_merge_last_nonnull": _both(
        """SELECT cik, @last@ AS priority, max(seq) AS last_seq FROM (SELECT o_custkey AS cik, o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS p FROM {orders}) t GROUP BY 1""",
        last=("max_by(p, seq) FILTER (WHERE p IS NOT NULL)", "arg_max(p, seq) FILTER (WHERE p IS NOT NULL)"),
    ),
    "reciprocal_edges": f"WITH {COMP} SELECT a.cik, a.rival FROM comp a JOIN comp b ON a.cik = b.rival AND a.rival = b.cik WHERE a.cik < a.rival",
    "consecutive_year_join": f"""WITH y AS (SELECT o_custkey AS cik, {FY} AS fy, count(*) AS n FROM {{orders}} GROUP BY 1, 2)
      SELECT a.cik, a.fy AS year, a.n AS filings, b.n AS next_filings, b.n - a.n AS change FROM y a JOIN y b ON a.cik = b.cik AND b.fy = a.fy + 1""",
    "year_chain_recursive": f"""WITH RECURSIVE years AS (SELECT DISTINCT {FY} AS fy FROM {{orders}}),
      chain(first_year, year, hops) AS (SELECT fy, fy, CAST(0 AS BIGINT) FROM years UNION ALL SELECT first_year, fy, hops + 1 FROM chain JOIN years ON fy = year + 1) SELECT first_year, year, hops FROM chain""",
    "triple_condition_companies": f"""WITH {PROD}, {COMP}, {GEO} SELECT c_custkey AS cik FROM {{customer}} WHERE EXISTS (SELECT 1 FROM prod WHERE prod.cik = c_custkey AND segment = 'Brand#1')
      OR (EXISTS (SELECT 1 FROM geo WHERE geo.cik = c_custkey AND regionkey = 1) AND EXISTS (SELECT 1 FROM comp WHERE comp.cik = c_custkey AND rival = 1))""",
    "first_appearance_year": f"SELECT l_suppkey AS rival, min({FY}) AS first_year, max({FY}) AS last_year FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey GROUP BY 1",
    "cooccurrence_pairs": """WITH t AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus AS term FROM {lineitem})
      SELECT a.term AS a, b.term AS b, count(*) AS sections FROM t a JOIN t b ON a.k = b.k AND a.term < b.term GROUP BY 1, 2""",
    "ego_subgraph": f"""WITH {GEO}, {COMP} SELECT 'OPERATES_IN' AS relation, cik, market AS target FROM geo WHERE cik = 1
      UNION ALL SELECT 'COMPETES_WITH', cik, CAST(rival AS VARCHAR(20)) FROM comp WHERE cik = 1""",
    "overview_subgraph": f"""WITH {COMP}, top AS (SELECT rival, count(*) AS degree FROM comp GROUP BY 1 ORDER BY degree DESC, rival LIMIT 10)
      SELECT comp.rival, degree, count(*) AS edges FROM comp JOIN top ON comp.rival = top.rival GROUP BY 1, 2""",
    "coverage_by_sector": """SELECT c_mktsegment AS sector, count(DISTINCT c_custkey) AS companies, count(DISTINCT o_custkey) AS with_filings, count(o_orderkey) AS filings
      FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY 1""",
    "union_of_years": f"SELECT {FY} AS year FROM {{orders}} UNION SELECT {FY.replace('o_orderdate', 'l_shipdate')} FROM {{lineitem}}",
    "yearly_change": f"""WITH y AS (SELECT {FY} AS fy, count(*) AS n FROM {{orders}} GROUP BY 1)
      SELECT fy AS fiscal_year, n AS filings, n - lag(n) OVER (ORDER BY fy) AS change, first_value(n) OVER (ORDER BY fy) AS baseline FROM y""",
    "latest_year_card": f"SELECT o_custkey AS cik, CAST(year(max(o_orderdate)) AS BIGINT) AS latest_year, max({FY}) AS latest_fiscal_year FROM {{orders}} GROUP BY 1",
    "batch_assignment": """SELECT accession, cik, CAST(floor((rn - 1) / 20) AS BIGINT) AS batch FROM (SELECT o_orderkey AS accession, o_custkey AS cik,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}) t""",
    "companies_in_market": f"""WITH {GEO} SELECT market, cik, place FROM (SELECT market, cik, CAST(row_number() OVER (PARTITION BY market ORDER BY cik) AS BIGINT) AS place FROM geo) t WHERE place <= 50""",
    "corpus_stats_rollup": f"""SELECT o_orderstatus AS status, {FY} AS fiscal_year, count(*) AS filings FROM {{orders}} GROUP BY ROLLUP (o_orderstatus, {FY})""",
    "category_ranking": f"""WITH {PROD} SELECT category, companies, CAST(rank() OVER (ORDER BY companies DESC) AS BIGINT) AS position FROM
      (SELECT category, count(DISTINCT cik) AS companies FROM prod GROUP BY 1) t""",
    "events_by_category_year": f"SELECT event_type AS category, {FY.replace('o_orderdate', 'ts')} AS fiscal_year, count(*) AS events FROM {{events}} GROUP BY 1, 2",
    "event_timeline": """SELECT user_id AS cik, event_id, event_type AS category, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}""",
    "event_windows_tumbling": _both(
        "SELECT @day@ AS day, event_type AS category, count(*) AS events FROM {events} GROUP BY 1, 2",
        day=("CAST(date_trunc('day', ts) AS DATE)", "CAST(date_trunc('day', ts) AS DATE)"),
    ),
    "event_windows_session": (
        """SELECT user_id AS cik, count(*) AS events, unix_micros(CAST(min(ts) AS TIMESTAMP)) AS first_us FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')""",
        """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
        SELECT user_id AS cik, count(*) AS events, epoch_us(min(ts)) AS first_us FROM s GROUP BY user_id, sid""",
    ),
    "json_props_extract": _both(
        "SELECT event_id, @k@ AS k FROM {events}",
        k=("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    ),
    "conversation_window8": _both(
        "SELECT conv_id, turn, @all@ AS roles, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS held FROM {conversations}",
        all=(
            "array_join(collect_list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',')",
            "array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',')",
        ),
    ),
    "context_carry": _both(
        "SELECT conv_id, turn, @last@ AS active FROM (SELECT *, CASE WHEN role = 'user' THEN turn END AS u FROM {conversations}) t",
        last=(
            "last(u, true) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "last_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        ),
    ),
    "metadata_predicates": "SELECT vec_id FROM {embeddings} JOIN {labels} ON vec_id = doc_id WHERE label IN (1, 2, 3) AND quality = 1 AND toxic = 0",
}
