"""Domain tables derived from the driver's TPC-H-ish parquet (stand-in input).

Each view is one SQL text written in the common subset of Spark SQL and
DuckDB. Spark runs it with ``spark.sql(text, **frames)`` (no global temp
views); the oracle side pastes the same text as a CTE. The only dialect
difference is the timestamp type name (Spark keeps TIMESTAMP_NTZ, which is
what parquet timestamps load as).

These views only produce rows in the schema the operators expect; none of
the operators relies on how the rows were made.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from slotwise.session import small_partitions
from slotwise.sources.tables import Tables, conform, empty_table

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# The fixture view definitions (see FIXTURES.md), in dependency order.
VIEWS: dict[str, str] = {
    "users": """
SELECT CAST(c_custkey AS BIGINT) AS id, lower(c_name) AS username, lower(c_name) || '@example.com' AS email,
 'user' AS role, split_part(c_name, '#', 1) AS first_name,
 CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
 CAST(NULL AS STRING) AS phone,
 CAST(DATE '1995-01-01' + CAST((c_custkey * 17) % 2400 AS INT) AS TIMESTAMP) AS created_at
FROM {customer}
UNION ALL
SELECT 1000000000 + s_suppkey, lower(s_name), lower(s_name) || '@example.com', 'owner',
 split_part(s_name, '#', 1), split_part(s_name, '#', 2), CAST(NULL AS STRING),
 CAST(DATE '1995-01-01' + CAST((s_suppkey * 31) % 2400 AS INT) AS TIMESTAMP)
FROM {supplier}""",
    "court_owners": """
SELECT s_suppkey AS id, 1000000000 + s_suppkey AS user_id, s_name AS business_name,
 n_name || ', ' || r_name AS business_address,
 '03-' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS business_phone,
 CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE lower(replace(s_name, '#', '.')) || '@courts.example' END AS business_email,
 CASE WHEN s_acctbal < 0 THEN '' ELSE r_name || ' BANK' END AS bank_name,
 CAST(1000000 + s_suppkey AS STRING) AS bank_account_number,
 s_name AS account_holder_name,
 CASE WHEN s_nationkey % 2 = 0 THEN 'basic' ELSE 'premium' END AS subscription_plan,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'active' END AS subscription_status
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "courts": """
SELECT p_partkey AS id, p_partkey % (SELECT COUNT(*) FROM {supplier}) AS owner_id, p_name AS name,
 p_type || ' ' || p_brand AS address,
 CASE WHEN p_size % 3 = 0 THEN 'cement' ELSE 'synthetic' END AS court_type,
 CASE WHEN p_size % 4 = 0 THEN 'outdoor' ELSE 'indoor' END AS indoor_outdoor,
 CAST(p_size % 2 AS INT) AS has_ac, CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS INT) AS has_food,
 CAST(CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS INT) AS has_parking,
 CAST(10 + p_size AS DECIMAL(12,2)) AS hourly_rate,
 lpad(CAST(6 + p_size % 4 AS STRING), 2, '0') || CASE WHEN p_size % 6 = 0 THEN ':30' ELSE ':00' END AS open_time,
 lpad(CAST(20 + p_size % 3 AS STRING), 2, '0') || ':00' AS close_time,
 CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS INT) AS is_active,
 CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS INT) AS is_approved,
 CAST(DATE '1995-01-01' + CAST((p_partkey * 13) % 2400 AS INT) AS TIMESTAMP) AS created_at
FROM {part}""",
    "bookings": """
SELECT l_orderkey * 8 + l_linenumber AS id, MIN(CASE WHEN l_partkey % 40 = 3 THEN l_partkey - 1 ELSE l_partkey END) AS court_id,
 MIN(o_custkey) AS user_id,
 DATE '2001-06-01' + CAST(MIN(EXTRACT(DAY FROM l_shipdate) + EXTRACT(MONTH FROM l_shipdate) * 31) % 28 AS INT) AS booking_date,
 lpad(CAST(6 + CAST(MIN(l_quantity) AS INT) % 14 AS STRING), 2, '0') || CASE WHEN MIN(l_linenumber) = 7 THEN ':30' ELSE ':00' END AS start_time,
 lpad(CAST(6 + CAST(MIN(l_quantity) AS INT) % 14 + 1 + MIN(l_linenumber) % 3 AS STRING), 2, '0') || CASE WHEN MIN(l_linenumber) = 7 THEN ':30' ELSE ':00' END AS end_time,
 CAST(1 + MIN(l_linenumber) % 3 AS INT) AS total_hours, CAST(MIN(l_extendedprice) AS DECIMAL(12,2)) AS total_amount,
 CAST(NULL AS STRING) AS notes,
 CASE WHEN MIN(l_returnflag) = 'R' THEN 'pending' ELSE 'paid' END AS payment_status,
 CASE MIN(o_orderstatus) WHEN 'O' THEN 'confirmed' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS booking_status,
 CAST(NULL AS STRING) AS voucher_code, CAST(0 AS DECIMAL(12,2)) AS discount_amount,
 CAST(MIN(o_orderdate) AS TIMESTAMP) AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber""",
    "reviews": """
SELECT id, court_id, user_id, id AS booking_id, CAST(1 + id % 5 AS INT) AS rating, created_at
FROM {bookings} WHERE booking_status = 'completed' AND id % 3 = 0""",
    "payouts": """
SELECT s_suppkey * 2 + i AS id, s_suppkey AS owner_id, CAST(abs(s_acctbal) AS DECIMAL(12,2)) AS amount,
 'completed' AS status,
 CAST(DATE '1996-01-01' + CAST((s_suppkey * 37 + i * 400) % 1500 AS INT) AS TIMESTAMP) AS created_at
FROM {supplier} CROSS JOIN (VALUES (0), (1)) AS g(i) WHERE s_suppkey % 3 <> 0""",
    "court_images": """
SELECT p_partkey * 4 + i AS id, p_partkey AS court_id,
 'img-' || CAST(p_partkey AS STRING) || '-' || CAST(i AS STRING) || '.jpg' AS image_path,
 CAST(CASE WHEN i = 1 THEN 1 ELSE 0 END AS INT) AS is_primary
FROM {part} CROSS JOIN (VALUES (0), (1), (2)) AS g(i) WHERE i < p_size % 4""",
    "promotions": """
SELECT p_partkey AS id, 'PROMO' || CAST(p_partkey AS STRING) AS code, p_name AS title,
 CASE WHEN p_size % 2 = 0 THEN 'percentage' ELSE 'fixed' END AS discount_type,
 CAST(5 + p_size % 26 AS DECIMAL(12,2)) AS discount_value,
 CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size * 20 AS DECIMAL(12,2)) END AS min_booking_amount,
 CASE p_size % 4 WHEN 0 THEN NULL WHEN 2 THEN CAST(50 AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS max_discount_amount,
 DATE '1995-01-01' + CAST((p_partkey * 7) % 1200 AS INT) AS start_date,
 DATE '1998-01-01' + CAST((p_partkey * 11) % 1400 AS INT) AS end_date,
 CAST(CASE WHEN p_size % 8 = 0 THEN 0 ELSE 1 END AS INT) AS is_active,
 CAST(CASE WHEN p_size % 3 = 0 THEN -1 ELSE 10 END AS INT) AS usage_limit, CAST(p_size % 13 AS INT) AS used_count,
 1000000000 + p_partkey % (SELECT COUNT(*) FROM {supplier}) AS created_by,
 CASE WHEN p_size % 5 < 2 THEN 'specific' ELSE 'all' END AS target_type,
 CAST(DATE '1995-01-01' + CAST((p_partkey * 7) % 1200 AS INT) AS TIMESTAMP) AS created_at
FROM {part} WHERE p_partkey % 20 = 0""",
    "promotion_targets": """
SELECT MIN(l_orderkey * 8 + l_linenumber) AS id, p.id AS promotion_id, CAST(o_custkey AS BIGINT) AS user_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {promotions} p ON p.id = l_partkey - l_partkey % 20
WHERE l_linenumber = 1 AND (p.target_type = 'specific' OR l_orderkey % 9 = 0) GROUP BY p.id, o_custkey""",
    "payments": """
SELECT id, id AS booking_id, total_amount AS amount, 'online' AS payment_method, CAST(NULL AS STRING) AS transaction_id,
 'completed' AS status, created_at
FROM {bookings} WHERE payment_status = 'paid' AND id % 4 = 0""",
    "voucher_usage": """
SELECT l_orderkey * 8 + l_linenumber AS id, MIN(p.id) AS promotion_id, l_orderkey * 8 + l_linenumber AS booking_id,
 MIN(o_custkey) AS user_id, CAST(MIN(5 + l_orderkey % 20) AS DECIMAL(12,2)) AS discount_amount,
 CAST(MIN(o_orderdate) AS TIMESTAMP) AS used_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {promotions} p ON p.id = l_partkey - l_partkey % 20
WHERE l_linenumber = 4 AND l_orderkey % 5 = 0 GROUP BY l_orderkey, l_linenumber""",
    # request tables (one row per incoming request)
    "voucher_requests": """
SELECT o_orderkey AS request_id, o_custkey AS user_id,
 CASE WHEN o_orderkey % 17 = 0 THEN '  promo' || CAST(20 * (o_orderkey % 110) AS STRING) || ' '
      ELSE 'promo' || CAST(20 * (o_orderkey % 110) AS STRING) END AS code,
 CAST(100 + o_orderkey % 1500 AS DECIMAL(12,2)) AS booking_amount, CAST(o_orderdate AS TIMESTAMP) AS requested_at
FROM {orders}""",
}

VIEWS["booking_requests"] = """
SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderkey % (SELECT COUNT(*) FROM {part}) AS court_id,
 DATE '2001-06-01' + CAST(o_orderkey % 28 AS INT) AS booking_date,
 lpad(CAST(6 + o_orderkey % 15 AS STRING), 2, '0') || CASE WHEN o_orderkey % 9 = 0 THEN ':30' ELSE ':00' END AS start_time,
 lpad(CAST(CASE WHEN o_orderkey % 23 = 0 THEN 6 + o_orderkey % 15 - o_custkey % 3 ELSE 7 + o_orderkey % 15 + o_custkey % 3 END AS STRING), 2, '0') || CASE WHEN o_orderkey % 9 = 0 THEN ':30' ELSE ':00' END
   AS end_time,
 CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE CAST(1 + o_custkey % 3 AS INT) END AS total_hours,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'PROMO' || CAST(20 * (o_custkey % 100) AS STRING) END AS voucher_code,
 CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN CAST(5 + o_orderkey % 20 AS DECIMAL(12,2)) END
   AS discount_amount,
 o_orderpriority AS notes, CAST(o_orderdate AS TIMESTAMP) AS requested_at
FROM {orders}"""

# More request tables for the change jobs (stand-in input: rows of the request schema only).
VIEWS["slot_requests"] = """
SELECT DISTINCT l_orderkey AS request_id, l_orderkey % (SELECT COUNT(*) FROM {part}) AS court_id,
 DATE '2001-06-01' + CAST(l_orderkey % 28 AS INT) AS booking_date,
 lpad(CAST(6 + CAST(l_quantity AS INT) % 14 AS STRING), 2, '0') || ':00' AS slot
FROM {lineitem}"""

VIEWS["booking_actions"] = """
SELECT id * 2 + i AS request_id, id AS booking_id,
 CASE WHEN id % 13 = 0 THEN user_id + 1 ELSE user_id END AS user_id, created_at AS requested_at
FROM {bookings} CROSS JOIN (VALUES (0), (1)) AS g(i) WHERE i = 0 OR id % 5 = 0"""

VIEWS["review_requests"] = """
SELECT id * 2 + i AS request_id, id AS booking_id,
 CASE WHEN id % 11 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
 CAST((id + i) % 7 AS INT) AS rating, 'review of ' || CAST(id AS STRING) AS comment, created_at AS requested_at
FROM {bookings} CROSS JOIN (VALUES (0), (1)) AS g(i)"""

VIEWS["registration_requests"] = """
SELECT o_orderkey AS request_id, lower(c_name) || '-' || substr(o_orderpriority, 1, 1) AS username,
 lower(c_name) || '.' || CAST(o_orderkey % 3 AS STRING) || '@mail.example' AS email,
 split_part(c_name, '#', 1) AS first_name,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
 CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'owner' WHEN substr(o_orderpriority, 1, 1) = '2' THEN ''
      ELSE NULL END AS role,
 CAST(o_orderdate AS TIMESTAMP) AS requested_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

VIEWS["promotion_requests"] = """
SELECT rid AS request_id, eid AS id,
 CASE WHEN p_size % 23 = 0 THEN '' ELSE 'promo' || CAST(cnum AS STRING) END AS code,
 p_name AS title, p_type AS description,
 CASE WHEN p_size % 2 = 0 THEN 'percentage' ELSE 'fixed' END AS discount_type,
 CASE WHEN p_size % 17 = 0 THEN NULL ELSE CAST(5 + p_size % 30 AS DECIMAL(12,2)) END AS discount_value,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size * 10 AS DECIMAL(12,2)) END AS min_booking_amount,
 CASE WHEN p_size % 4 = 1 THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(40 AS DECIMAL(12,2)) END AS max_discount_amount,
 DATE '2001-01-01' + CAST(p_partkey % 200 AS INT) AS start_date,
 DATE '2001-09-01' + CAST(p_partkey % 300 AS INT) AS end_date,
 CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS usage_limit,
 CASE WHEN p_size % 6 = 0 THEN 'specific' WHEN p_size % 6 = 1 THEN NULL ELSE 'all' END AS target_type,
 1000000000 + p_partkey % (SELECT COUNT(*) FROM {supplier}) AS created_by,
 CAST(DATE '2001-06-01' + CAST(p_partkey % 28 AS INT) AS TIMESTAMP) AS requested_at
FROM (SELECT part.*, p_partkey AS rid, CASE WHEN p_partkey % 40 = 0 THEN p_partkey END AS eid, p_partkey % 1500 AS cnum FROM {part} part
 UNION ALL
 SELECT part.*, p_partkey + 1000000, CASE WHEN p_partkey % 40 < 4 THEN p_partkey - p_partkey % 40 END,
  CASE WHEN p_size % 3 = 0 THEN p_partkey - p_partkey % 40 ELSE p_partkey - p_partkey % 40 + 20 * (p_partkey % 4) END
 FROM {part} part WHERE p_partkey % 40 BETWEEN 1 AND 5) asked"""

VIEWS["promotion_target_requests"] = """
SELECT DISTINCT l_partkey AS request_id, CAST(o_custkey AS BIGINT) AS user_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey
WHERE l_linenumber = 2 AND p_size % 6 < 2"""

VIEWS["court_requests"] = """
SELECT p_partkey AS request_id, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS id,
 CASE WHEN p_size % 9 = 0 THEN CAST(p_partkey AS BIGINT)
      WHEN p_size % 8 = 0 THEN 1000000000 + (p_partkey + 1) % (SELECT COUNT(*) FROM {supplier})
      ELSE 1000000000 + p_partkey % (SELECT COUNT(*) FROM {supplier}) END AS user_id,
 CASE WHEN p_size % 11 = 0 THEN NULL ELSE upper(p_name) END AS name, p_type AS description,
 CASE WHEN p_size % 13 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS address,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_retailprice / 100 AS DOUBLE) END AS latitude,
 CAST(p_retailprice / 50 AS DOUBLE) AS longitude,
 CASE WHEN p_size % 4 = 0 THEN '' ELSE 'cement' END AS court_type,
 CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'outdoor' END AS indoor_outdoor,
 CASE WHEN p_size % 2 = 0 THEN 'on' END AS has_ac, CASE WHEN p_size % 3 = 0 THEN 'on' END AS has_food,
 CASE WHEN p_size % 5 = 0 THEN 'on' END AS has_rest_area, CAST(NULL AS STRING) AS has_changing_room,
 CASE WHEN p_size % 7 = 0 THEN 'on' END AS has_parking,
 CASE WHEN p_size % 19 = 0 THEN NULL ELSE CAST(12 + p_size AS DECIMAL(12,2)) END AS hourly_rate,
 CASE WHEN p_size % 7 = 0 THEN NULL ELSE '07:00' END AS open_time, '21:00' AS close_time,
 CAST(DATE '2001-06-01' + CAST(p_partkey % 28 AS INT) AS TIMESTAMP) AS requested_at
FROM {part}"""

VIEWS["court_image_requests"] = """
SELECT p_partkey AS request_id, 'new-' || CAST(p_partkey AS STRING) || '.jpg' AS image_path
FROM {part} WHERE p_size % 3 = 0"""

VIEWS["court_image_removals"] = """
SELECT court_id AS request_id, id AS image_id FROM {court_images} WHERE is_primary = 0"""

VIEWS["court_delete_requests"] = """
SELECT p_partkey AS request_id, p_partkey AS court_id,
 CASE WHEN p_size % 8 = 0 THEN CAST(1 AS BIGINT) ELSE 1000000000 + p_partkey % (SELECT COUNT(*) FROM {supplier}) END
   AS user_id
FROM {part}"""

VIEWS["approval_requests"] = """
SELECT id, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS approved FROM {courts} WHERE is_approved = 0"""

VIEWS["toggle_requests"] = """
SELECT p_partkey AS request_id, p_partkey - p_partkey % 20 + CASE WHEN p_size = 20 THEN 1 ELSE 0 END AS id
FROM {part} WHERE p_size % 10 = 0"""

VIEWS["promotion_delete_requests"] = """
SELECT id FROM {promotions} WHERE is_active = 0"""

VIEWS["profile_requests"] = """
SELECT CAST(c_custkey AS BIGINT) AS id, upper(split_part(c_name, '#', 1)) AS first_name,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
 '+60-' || CAST(1000 + c_custkey AS STRING) AS phone, n_name AS address
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal < 0"""

DEPENDS: dict[str, tuple[str, ...]] = {
    name: tuple(dep for dep in list(RAW) + list(VIEWS) if "{" + dep + "}" in text)
    for name, text in VIEWS.items()
}

DOMAIN = ("users", "court_owners", "courts", "bookings", "reviews", "payouts", "court_images", "promotions",
          "promotion_targets", "payments", "voucher_usage")


def spark_text(name: str) -> str:
    return VIEWS[name].replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


def duck_text(name: str) -> str:
    text = VIEWS[name]
    for dep in DEPENDS[name]:
        text = text.replace("{" + dep + "}", dep)
    return text


def closure(names) -> list[str]:
    """Views needed by ``names``, in definition order."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in VIEWS and n not in need:
            need.add(n)
            for d in DEPENDS[n]:
                visit(d)

    for n in names:
        visit(n)
    return [n for n in VIEWS if n in need]


def with_views(sql: str, names) -> str:
    """Prefix DuckDB ``sql`` with the CTEs of the fixture views it needs."""
    views = closure(names)
    if not views:
        return sql
    ctes = ",\n".join(f"{n} AS ({duck_text(n)}\n)" for n in views)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {ctes},\n{rest[9:].lstrip()}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


_MATERIALIZED: set[str] = set()


class Fixture:
    """Lazily built fixture frames over one ``sf_dir``.

    If ``sf_dir`` was written by ``materialize`` the views are read back as
    parquet (with scan pushdown and pruning) instead of being recomputed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialized = self.sf_dir in _MATERIALIZED
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def view(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        if name not in self._frames:
            if self.materialized:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}")
            else:
                args = {dep: self.view(dep) for dep in DEPENDS[name]}
                self._frames[name] = self.spark.sql(spark_text(name), **args)
        return self._frames[name]

    def over(self, **frames: DataFrame) -> "Fixture":
        """The same views, those that are made from a view in ``frames`` made from its given rows."""
        other = Fixture(self.spark, self.sf_dir)
        other._frames = dict(frames)
        return other

    def tables(self, conform_schema: bool = False) -> Tables:
        frames = {}
        for name in ("users", "court_owners", "courts", "court_images", "bookings", "reviews",
                     "court_availability", "payments", "payouts", "promotions", "promotion_targets",
                     "voucher_usage"):
            if name in VIEWS:
                df = self.view(name)
                frames[name] = conform(df, name) if conform_schema else df
            else:
                frames[name] = empty_table(self.spark, name)
        return Tables(**frames)


@lru_cache(maxsize=8)
def _fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(spark, sf_dir)


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    small_partitions(spark)
    return _fixture(spark, sf_dir.rstrip("/"))


def materialize(spark: SparkSession, sf_dir: str, out_dir: str, names=DOMAIN, declared: bool = False) -> None:
    """Write fixture views as parquet (bookings partitioned by booking_date), with ``declared`` in the declared schema.

    Afterwards ``fixture(spark, out_dir)`` reads them back instead of recomputing.
    """
    fx = Fixture(spark, sf_dir)
    for name in names:
        df = conform(fx.view(name), name) if declared and name in DOMAIN else fx.view(name)
        writer = df.write.mode("overwrite")
        if name == "bookings":
            writer = writer.partitionBy("booking_date")
        writer.parquet(f"{out_dir}/{name}")
    if set(names) >= set(VIEWS):
        _MATERIALIZED.add(out_dir.rstrip("/"))
        _fixture.cache_clear()


def column_profile(t: Tables) -> DataFrame:
    """(table_name, column_name, row_count, non_null, least, greatest) of every declared column; bounds in text order."""
    from pyspark.sql import functions as F

    from slotwise.sources.schema import SCHEMAS

    out = None
    for name, df in t.items():
        cols = SCHEMAS[name].fieldNames()
        text = {c: F.col(c).cast("string") for c in cols}
        one = df.agg(F.count(F.lit(1)).alias("row_count"), *[
            F.struct(F.lit(c).alias("column_name"), F.count(c).alias("non_null"), F.min(text[c]).alias("least"),
                     F.max(text[c]).alias("greatest")).alias(c) for c in cols])
        rows = one.select(F.lit(name).alias("table_name"), "row_count", F.explode(F.array(*cols)).alias("c")).select(
            "table_name", "c.column_name", "row_count", "c.non_null", "c.least", "c.greatest")
        out = rows if out is None else out.unionByName(rows)
    return out
