"""News-shaped views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]

ART = """select o_orderkey as pos, o_orderkey as idx,
 case o_orderkey % 6 when 0 then 'earthquake' when 1 then 'cyclone' when 2 then 'wildfire' when 3 then 'drought' when 4 then 'flood' else 'not_related' end as label,
 cast(cast(o_orderdate as date) as STRING) as event_date,
 case when o_custkey % 11 = 0 then null else substr('USJPCNINAUIDPHNPTRMX', cast(1 + 2*(o_custkey % 10) as int), 2) end as country_iso2,
 case when o_orderkey % 13 = 0 then null else p_name end as location_text,
 concat('Report ', cast(o_orderkey as STRING), ' [SEP] ', case o_orderkey % 6
 when 0 then concat('A magnitude ', cast(4 + o_custkey % 5 as STRING), '.', cast(o_orderkey % 10 as STRING), ' earthquake struck at a depth of ', cast(5 + o_custkey % 90 as STRING), ' km. It killed ', cast(o_custkey % 300 as STRING), ' people.')
 when 1 then concat('The cyclone made landfall with ', cast(60 + o_custkey % 120 as STRING), ' mph winds. A storm surge of ', cast(1 + o_orderkey % 15 as STRING), ' feet hit the port.')
 when 2 then concat('The wildfire burned ', cast(100 + o_custkey as STRING), ' acres of forest. Insurers expect claims.')
 when 3 then concat('Drought lasting ', cast(1 + o_custkey % 20 as STRING), ' months hit crops. ', cast(2 + o_orderkey % 9 as STRING), ' countries affected.')
 when 4 then concat('Flood killed ', cast(o_custkey % 200 as STRING), ' people. ', cast(100 * (o_orderkey % 2000) as STRING), ' people were displaced.')
 else 'Nothing happened here.' end) as text
 from orders join part on p_partkey = o_custkey % 1000"""

CAT = """select p_partkey as eventid,
 case p_partkey % 5 when 0 then 'EQ' when 1 then 'TC' when 2 then 'WF' when 3 then 'DR' else 'FL' end as eventtype,
 case p_size % 3 when 0 then 'green' when 1 then 'orange' else 'red' end as alertlevel,
 substr('USJPCNINAUIDPHNPTRMX', cast(1 + 2*(p_partkey % 10) as int), 2) as iso2,
 {dt} as fromdate, cast(p_size as double) as magnitude from part"""
CAT_SPARK = CAT.replace("{dt}", "date_add(date'1995-01-01', cast(p_partkey*7 % 2400 as int))")
CAT_DUCK = CAT.replace("{dt}", "date'1995-01-01' + cast(p_partkey*7 % 2400 as int)")

PX = """select p_type as ticker, cast(l_shipdate as date) as date, max(l_extendedprice) as close
 from lineitem join part on l_partkey = p_partkey group by 1, 2"""
MKT = """select 'MKT' as ticker, cast(l_shipdate as date) as date, max(l_extendedprice) as close from lineitem group by 2"""

EV = """select o_orderkey as event_id, cast(o_orderdate as date) as event_date,
 case cast(floor(o_orderkey / 10) as bigint) % 5 when 0 then 'EQ' when 1 then 'TC' when 2 then 'WF' when 3 then 'DR' else 'FL' end as event_type,
 case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'orange_or_red' else 'green' end as severity,
 case o_custkey % 6 when 0 then 'ECONOMY' when 1 then 'LARGE' when 2 then 'MEDIUM' when 3 then 'PROMO' when 4 then 'SMALL' else 'STANDARD' end as ticker
 from orders"""

# the same events on the first day of their month, so that dates lie free between them
EVM = EV.replace("cast(o_orderdate as date) as event_date", "cast(date_trunc('month', o_orderdate) as date) as event_date")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables of a folder. The tables get names of their own, so that several folders can be open at once."""
    import re
    import zlib

    mark = f"{zlib.crc32(sf_dir.encode()):08x}"
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{mark}")
            sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {name}_{mark}", sql)
    return spark.sql(sql)


def duck(sql: str) -> str:
    return sql.replace("STRING", "VARCHAR")
