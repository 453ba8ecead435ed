"""Every registered ledger query and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The domain's tables in DuckDB, for the twins: what ``sources.views`` derives.
VIEWS = """
products AS (SELECT p_partkey AS product_id, p_name AS raw_name, p_brand AS article, 'C' || (CAST(substr(p_brand, 7) AS INT) % 5) AS category,
  5 + CAST(substr(p_brand, 7) AS INT) % 20 AS loss_percent, CAST(p_size AS DECIMAL(12,1)) / 10 AS equiv_d, CAST(CAST(p_size AS DECIMAL(12,2)) / 10 AS DECIMAL(12,1)) AS stock_equivalent, p_type AS type FROM part),
lines AS (SELECT l_orderkey AS invoice_id, l_linenumber AS line, l_partkey AS product_id, l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS day,
  CAST(l_quantity AS DECIMAL(12,3)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS ht, CAST(l_tax AS DECIMAL(4,2)) AS vat, CAST(l_discount AS DECIMAL(4,2)) AS discount, l_returnflag AS flag FROM lineitem),
movements AS (SELECT * EXCLUDE (quantity, ht), CASE WHEN flag = 'A' AND line = 7 THEN 'LOSS' ELSE 'PURCHASE' END AS kind,
  CASE WHEN flag = 'R' OR (flag = 'A' AND line = 7) THEN -quantity ELSE quantity END AS quantity, CASE WHEN flag = 'R' OR (flag = 'A' AND line = 7) THEN -ht ELSE ht END AS ht FROM lines),
till_days AS (SELECT event_type AS product, CAST(ts AS DATE) AS day, count(*) AS quantity, sum(CAST(value AS DECIMAL(12,2))) AS revenue FROM events GROUP BY 1, 2),
till_payments AS (SELECT CAST(ts AS DATE) AS day, (['card', 'cash', 'cheque', 'voucher', 'transfer'])[user_id % 5 + 1] AS method, sum(CAST(value AS DECIMAL(12,2))) AS amount FROM events GROUP BY 1, 2),
bank_lines AS (SELECT o_orderkey AS line_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE -CAST(o_totalprice AS DECIMAL(12,2)) END AS amount,
  o_custkey AS payee_id, o_orderpriority AS account FROM orders)
"""


def query(oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name. The twin sees the domain's tables."""

    def of(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            text = oracle.strip()
            head, _, rest = text.partition(" ")
            ORACLES[f.__name__] = f"WITH RECURSIVE {VIEWS}, {rest}" if head == "WITH" else f"WITH RECURSIVE {VIEWS} {text}"
        return f

    return of


from . import bank, documents, forecast, lists, matching, misc, packs, parties, series, slips, stock, tickets, till, upkeep, values  # noqa: E402, F401
