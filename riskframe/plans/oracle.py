"""DuckDB SQL for the views, used to build the oracle queries that check
each Spark query (tables are registered as views by the checker)."""

TX = """tx AS (
  SELECT e.event_id AS transaction_id,
         e.ts AS ts,
         (epoch_us(e.ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS "Time",
         e.value AS "Amount",
         e.user_id AS customer_id,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS merchant_id,
         e.event_type AS transaction_type,
         c.c_mktsegment AS card_type,
         r.r_name AS region,
         (['web', 'mobile', 'pos', 'atm'])[CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 4 + 1] AS channel,
         CAST(e.event_type = 'error' AND e.value >= 75 AS INTEGER) AS "Class"
  FROM events e
  LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SCORED = """scored AS (
  SELECT *, round(1.0 - exp(-"Amount" / 50.0), 6) AS fraud_probability FROM tx)"""

BANDED = """banded AS (
  SELECT *, CASE WHEN fraud_probability > 0.8 THEN 'High'
                 WHEN fraud_probability > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM scored)"""

#: width of the driver's embeddings
ML_WIDTH = 64
ML_COLUMNS = [f"V{i}" for i in range(1, ML_WIDTH + 1)]

ML = """ml AS (
  SELECT vec_id AS transaction_id,
         {vcols},
         CAST(label = 0 AS INTEGER) AS "Class"
  FROM embeddings)""".format(vcols=",\n         ".join(
    f'CAST(embedding[{i + 1}] AS DOUBLE) AS "V{i + 1}"' for i in range(ML_WIDTH)))

TX_BIG = """tx_big AS (
  SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, l.l_suppkey AS merchant_id,
         l.l_extendedprice * (1.0 - l.l_discount) AS "Amount", o.o_orderdate AS ts,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS "Class"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

_DEPS = {"tx": [], "scored": ["tx"], "banded": ["scored"], "ml": [], "tx_big": []}
_TEXT = {"tx": TX, "scored": SCORED, "banded": BANDED, "ml": ML, "tx_big": TX_BIG}


def sql(views, *ctes: str, body: str) -> str:
    """``WITH <views + their dependencies>, <ctes> <body>``."""
    order: list[str] = []

    def add(v):
        for d in _DEPS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in ([views] if isinstance(views, str) else views):
        add(v)
    parts = [_TEXT[v] for v in order] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body
