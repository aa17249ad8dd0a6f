"""Sample contracts in two versions, made of ``orders``: one clause an order, one contract a customer.

The SQL below is plain enough for Spark and DuckDB to give the same strings.  Version B edits version A by
``o_orderkey % 8``: 0-1 nothing, 2 formatting, 3 the amount, 4 a duty becomes a permission, 5 a permission becomes a prohibition,
6 the clause is deleted, 7 it is deleted and another one added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLAUSES = """
base AS (
  SELECT o_orderkey AS k, o_custkey AS contract_id, o_orderstatus AS s,
         cast(cast(o_totalprice AS decimal(14,2)) AS string) AS amount,
         cast(cast(o_totalprice + 100 AS decimal(14,2)) AS string) AS other_amount,
         cast(10 + o_orderkey % 80 AS string) AS days,
         concat(lpad(cast(month(o_orderdate) AS string), 2, '0'), '/', lpad(cast(day(o_orderdate) AS string), 2, '0'),
                '/', cast(year(o_orderdate) AS string)) AS d,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Licensor' WHEN '2-HIGH' THEN 'Supplier' WHEN '3-MEDIUM' THEN 'Company'
              WHEN '5-LOW' THEN 'Consultant' ELSE 'Vendor' END AS p1,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Licensee' WHEN '2-HIGH' THEN 'Customer' WHEN '3-MEDIUM' THEN 'Employee'
              WHEN '5-LOW' THEN 'Client' ELSE 'Buyer' END AS p2,
         CASE o_orderkey % 5 WHEN 0 THEN 'Delivery' WHEN 1 THEN 'Payment' WHEN 2 THEN 'License Grant' WHEN 3 THEN 'Insurance'
              ELSE 'Termination' END AS heading
  FROM orders),
texts AS (
  SELECT *, concat(cast(k AS string), '. ', heading, '. The ', p1,
      CASE s WHEN 'F' THEN ' shall pay $' WHEN 'O' THEN ' agrees to pay $' ELSE ' shall not be required to pay $' END,
      amount, ' within ', days, ' days after ', d, '. The ', p2, ' may inspect the goods and audit the books and records. ',
      CASE k % 3 WHEN 0 THEN 'Neither party shall assign this agreement without notice to Acme Inc. The term is 2.5 years.'
        WHEN 1 THEN '"Fee" means the amount due; The insured goods are governed by the laws of the state.'
        ELSE 'In no event shall the liability exceed 10% of the fees under the license to use the source code.' END) AS text_a
  FROM base),
clauses_a AS (
  SELECT contract_id, k, heading, text_a AS text,
         row_number() OVER (PARTITION BY contract_id ORDER BY k) AS ordinal,
         concat(cast(contract_id AS string), '_A_', cast(k AS string)) AS chunk_id
  FROM texts),
edited AS (
  SELECT contract_id, k, heading,
         CASE k % 8 WHEN 2 THEN replace(upper(text_a), ' WITHIN ', '  - WITHIN ')
           WHEN 3 THEN replace(text_a, amount, other_amount)
           WHEN 4 THEN replace(replace(text_a, 'shall pay', 'may pay'), 'agrees to pay', 'may pay')
           WHEN 5 THEN replace(text_a, 'may inspect', 'shall not inspect') ELSE text_a END AS text
  FROM texts WHERE k % 8 NOT IN (6, 7)
  UNION ALL
  SELECT contract_id, k + 1000000000 AS k, 'Arbitration' AS heading,
         concat(cast(k + 1000000000 AS string), '. Arbitration. Disputes must be settled by ', p2, ' arbitration in Geneva; Each party will bear its costs.') AS text
  FROM texts WHERE k % 8 = 7),
clauses_b AS (
  SELECT contract_id, k, heading, text,
         row_number() OVER (PARTITION BY contract_id ORDER BY k) AS ordinal,
         concat(cast(contract_id AS string), '_B_', cast(k AS string)) AS chunk_id
  FROM edited)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clauses(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """``(contract_id, k, heading, text, ordinal, chunk_id)`` of version ``a`` or ``b``."""
    sql = f"WITH {CLAUSES} SELECT * FROM clauses_{version}".replace("FROM orders", "FROM {orders}")
    # The text work that follows is heavy for its bytes: it is spread by contract; how far is left to the planner.
    return spark.sql(sql, orders=table(spark, sf_dir, "orders")).repartition("contract_id")


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return clauses(spark, sf_dir, "a"), clauses(spark, sf_dir, "b")
