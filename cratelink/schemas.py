"""Fixed schemas. Nothing is inferred; extra fields are ignored, absent ones default."""

from __future__ import annotations

from pyspark.sql import types as T

PURCHASE_COLUMNS = (
    "Track ID",
    "Title",
    "Artists",
    "Remixers",
    "Genre",
    "Sub Genre",
    "Label",
    "Catalog Number",
    "Release Date",
    "Purchase Date",
    "Price",
    "BPM",
    "Key",
    "ISRC",
    "Release ID",
    "Release Title",
    "Duration",
)
PATH_COLUMN = "Local File Path"
MATCHED_COLUMNS = (*PURCHASE_COLUMNS, PATH_COLUMN)
CATALOG_COLUMNS = (
    "File Path",
    "Artist",
    "Album Artist",
    "Title",
    "Album",
    "ISRC",
    "Track Number",
    "Genre",
    "Date",
    "Duration",
    "File Size",
)


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


_ID_NAME = "struct<id:string,name:string>"
_ARTISTS = "array<struct<id:string,name:string,slug:string,role:string,type:string>>"

#: A purchased track. Loose scalars (ids, numbers, the price) are read as text.
TRACK = (
    f"struct<id:string,name:string,artists:{_ARTISTS},remixers:{_ARTISTS},"
    f"genre:{_ID_NAME},sub_genre:{_ID_NAME},label:{_ID_NAME},"
    f"release:struct<id:string,name:string,label:{_ID_NAME}>,key:{_ID_NAME},"
    "price:string,bpm:string,isrc:string,catalog_number:string,publish_date:string,"
    "purchase_date:string,length_ms:string,length:string,mix_name:string,slug:string>"
)
PAGE = f"struct<count:bigint,page:string,per_page:int,results:array<{TRACK}>,next:string,previous:string>"

#: A candidate as a search answers it.
API_CANDIDATE = (
    "struct<id:string,name:string,mix_name:string,artists:array<struct<name:string>>,"
    "genre:struct<name:string>,sub_genre:struct<name:string>,label:struct<name:string>,"
    "release:struct<id:string,name:string,label:struct<name:string>,"
    "image:struct<dynamic_uri:string,uri:string>>,"
    "image:struct<dynamic_uri:string,uri:string>,key:struct<name:string>,"
    "publish_date:string,new_release_date:string,bpm:string,isrc:string,"
    "catalog_number:string,length_ms:string>"
)

RECORDING = (
    "struct<id:string,title:string,score:string,length:string,"
    "`artist-credit`:array<struct<name:string>>,"
    "releases:array<struct<title:string,date:string,"
    "`label-info`:array<struct<label:struct<name:string>>>>>>"
)
RELEASE_RESULT = "struct<id:bigint,type:string,title:string>"
RELEASE = (
    "struct<id:bigint,title:string,artists:array<struct<name:string>>,"
    "labels:array<struct<name:string>>,genres:array<string>,styles:array<string>,"
    "tracklist:array<struct<title:string,duration:string>>,released:string,year:string,"
    "images:array<struct<type:string,uri:string>>>"
)

_TEXT = T.StringType()
_MAP = T.MapType(_TEXT, _TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


MANIFEST = _struct(
    path=_TEXT,
    artist=_TEXT,
    title=_TEXT,
    album=_TEXT,
    genre=_TEXT,
    date=_TEXT,
    duration_ms=T.LongType(),
    missing=T.ArrayType(_TEXT),
    candidate_id=T.LongType(),
    snapshot=_MAP,
)
RESULT_LOG = _struct(
    path=_TEXT, status=_TEXT, candidate_id=T.LongType(), applied=_MAP, source=_TEXT, snapshot=_MAP
)
