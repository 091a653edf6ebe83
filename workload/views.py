"""Fixture views over the driver tables; the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FX_CATALOG = """
select p_partkey as seq,
 '/mnt/' || (case when p_partkey % 3 = 0 then 'c' else 'g' end) || '/music/' || p_type || '/' || cast(p_partkey as varchar(20))
   || (case when p_partkey % 5 = 0 then '.flac' else '.mp3' end) as file_path,
 case when p_partkey % 16 in (3, 5, 6) then 'Other Act ' || cast(p_partkey as varchar(20)) else 'Artist ' || p_brand end as artist,
 case when p_partkey % 16 in (4, 5, 7) then 'Elsewhere'
  when p_partkey % 16 in (10, 11, 12, 13) then p_type || ' Sessions ' || cast(p_partkey % 50 as varchar(20)) || ' Deluxe'
  else p_type || ' Sessions ' || cast(p_partkey % 50 as varchar(20)) end as album,
 case when p_partkey % 16 = 1 then 'Untitled ' || cast(p_partkey as varchar(20))
  when p_partkey % 16 in (6, 7) then p_name || ' ' || cast(p_partkey as varchar(20)) || ' Long Cut'
  when p_partkey % 16 in (8, 10) then replace(p_name, ' ', '') || cast(p_partkey as varchar(20))
  when p_partkey % 16 = 11 then p_name
  when p_partkey % 16 = 12 then 'z' || p_name || ' ' || cast(p_partkey as varchar(20))
  when p_partkey % 16 = 13 then 'Live Recording ' || p_name || ' ' || cast(p_partkey as varchar(20))
  else p_name || ' ' || cast(p_partkey as varchar(20)) || ' (Original Mix)' end as title,
 case when p_partkey % 16 = 1 then 'GBX' || lpad(cast(p_partkey as varchar(20)), 9, '0') else '' end as isrc
from part where p_partkey % 16 <> 15
"""

FX_PURCHASES = """
select o_orderkey as track_id,
 case when p_partkey % 16 = 14 then 'Missing ' || p_name else p_name || ' ' || cast(p_partkey as varchar(20)) end as title,
 'Artist ' || p_brand || (case when o_orderkey % 7 = 0 then ' & Guest' else '' end) as artists,
 case when p_partkey % 16 = 7 then '' else p_type || ' Sessions ' || cast(p_partkey % 50 as varchar(20)) end as release_title,
 case when p_partkey % 16 = 1 then 'GBX' || lpad(cast(p_partkey as varchar(20)), 9, '0') else '' end as isrc,
 o_orderdate as purchased_at
from orders join part on p_partkey = o_orderkey % (select count(*) from part)
"""

FX_CANDIDATES = """
select o_orderkey as id, p_name || ' ' || cast(p_partkey as varchar(20)) as name,
 case o_orderkey % 4 when 0 then '' when 1 then 'Original Mix' when 2 then 'Instrumental' else 'Extended Mix' end as mix_name,
 'Artist ' || p_brand as artists,
 case when o_orderkey % 11 = 0 then '' else substr(cast(o_orderdate as varchar(30)), 1, 10) end as publish_date,
 case when o_orderkey % 13 = 0 then 0 else 180000 + (p_partkey % 60) * 1000 + (o_orderkey % 5) * 3500 end as length_ms
from orders join part on p_partkey = o_orderkey % (select count(*) from part)
"""

FX_FILES = """
select p_partkey as seq, 'Artist ' || p_brand as artist, p_name || ' ' || cast(p_partkey as varchar(20)) as title,
 case when p_partkey % 9 = 0 then 0 else 180000 + (p_partkey % 60) * 1000 end as duration_ms,
 case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then 'House www.example.com' else 'House' end as genre,
 case when p_partkey % 3 = 0 then '' else '2020-01-01' end as date,
 case when p_partkey % 5 = 0 then '' else p_type || ' Sessions' end as album
from part
"""

FX_RUN_LOG = """
select event_id as seq, ts, user_id as run_id,
 case event_type when 'error' then 'error' when 'purchase' then 'matched' when 'view' then 'no-candidates'
  when 'click' then 'skipped' else 'ambiguous' end as status
from events
"""

VIEWS = {
    "fx_catalog": FX_CATALOG,
    "fx_purchases": FX_PURCHASES,
    "fx_candidates": FX_CANDIDATES,
    "fx_files": FX_FILES,
    "fx_run_log": FX_RUN_LOG,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, built on the driver tables of *sf_dir*."""
    for t in ("part", "orders", "events"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


PURCHASE_FIELDS = {"isrc": "isrc", "artist": "artists", "title": "title", "album": "release_title"}
CATALOG_FIELDS = {"isrc": "isrc", "artist": "artist", "title": "title", "album": "album", "path": "file_path"}
