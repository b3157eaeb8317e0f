"""Schemas of all tables of the movement domain. Coordinates are struct<lat,lon>; SI units are in names."""

from __future__ import annotations

from pyspark.sql import types as T

LATLON = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


class _Schema(str):
    """DDL of a schema, parsed when it is asked for, as parsing needs a session."""


_s = _Schema


_NAME = "STRUCT<Zh_tw: STRING, En: STRING>"
_POSITION = "STRUCT<PositionLat: DOUBLE, PositionLon: DOUBLE>"

#: A position report as a feed delivers it.
RAW_PING = _s(
    f"PlateNumb STRING, OperatorID STRING, RouteUID STRING, SubRouteUID STRING, Direction STRING, BusPosition {_POSITION}, Speed DOUBLE, Azimuth DOUBLE, "
    "DutyStatus STRING, BusStatus STRING, MessageType STRING, GPSTime STRING, _corrupt_record STRING"
)
PINGS = _s(
    "plate STRING, route_uid STRING, direction INT, speed_kph DOUBLE, azimuth_deg DOUBLE, gps_time TIMESTAMP, lat DOUBLE, lon DOUBLE, "
    "bus_status STRING, duty_status STRING, src_file STRING, src_pos BIGINT"
)
POINT = "STRUCT<t: TIMESTAMP, lat: DOUBLE, lon: DOUBLE, speed_kph: DOUBLE, azimuth_deg: DOUBLE>"
RUNS = _s(f"run_id STRING, plate STRING, route_uid STRING, direction INT, pts ARRAY<{POINT}>, bus_status STRING, duty_status STRING, quality STRING")
RAW_STOPS_OF_ROUTE = _s(
    f"RouteUID STRING, SubRouteUID STRING, SubRouteID STRING, Direction STRING, RouteName {_NAME}, "
    f"Stops ARRAY<STRUCT<StopUID: STRING, StopID: STRING, StationID: STRING, StopName: {_NAME}, StopSequence: INT, StopPosition: {_POSITION}>>"
)
RAW_SHAPE = _s("RouteUID STRING, Direction STRING, Geometry STRING")
ROUTE_STOPS = _s("route_uid STRING, subroute_uid STRING, direction INT, seq INT, stop_uid STRING, station_id STRING, name_zh STRING, name_en STRING, lat DOUBLE, lon DOUBLE")
#: Stops of a route in two languages, as one file a route.
RAW_BILINGUAL_STOPS = _s(
    ", ".join(
        f"{lang} ARRAY<STRUCT<Id: STRING, pgp: INT, GoBack: INT, SID: BIGINT, NameZh: STRING, RouteId: BIGINT, SeqNo: INT, Terminal: INT, DistrictId: INT, "
        "Latitude: DOUBLE, Longitude: DOUBLE, IVRNo: INT, EXTVoiceNo: INT, traveltime: INT, holidayTraveltime: INT>>"
        for lang in ("en", "zh")
    )
)
RAW_OPERATORS = _s(f"ProviderID STRING, OperatorID STRING, OperatorName {_NAME}, OperatorPhone STRING, OperatorUrl STRING, OperatorCode STRING, AuthorityCode STRING, OperatorNo STRING, UpdateTime STRING")
RAW_ARRIVALS = _s(
    "GroupNo STRING, PathId STRING, PathName STRING, StopName STRING, Type STRING, "
    "Info ARRAY<STRUCT<Car: STRING, Dept: STRING, Desc: STRING, Dest: STRING, Goback: STRING, PathName: STRING, Pathid: STRING, Time: STRING>>"
)
RAW_VEHICLE_POSITIONS = _s("Azimuth STRING, BusID STRING, GoBack STRING, ImgIndex STRING, Latitude STRING, Longitude STRING, RouteID STRING")
RAW_LIVE_STOPS = _s("IVRNO STRING, Id STRING, SID STRING, latitude STRING, longitude STRING, nameZh STRING, seqNo STRING")
NODES = _s("id BIGINT, lat DOUBLE, lon DOUBLE")
EDGES = _s("src BIGINT, dst BIGINT, len_m DOUBLE, highway STRING, name STRING, oneway STRING, way_id BIGINT")
WAYS = _s("id BIGINT, tags MAP<STRING, STRING>, node_ids ARRAY<BIGINT>")
MAPMATCHED = _s("SubRouteUID STRING, Direction INT, RunUUID STRING, PlateNumb STRING, MapMatchUUID STRING, waypoints_used ARRAY<INT>, path ARRAY<BIGINT>, geo_path ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>, mapmatcher_version STRING")
TIMETABLE = _s("scenario STRING, route_uid STRING, direction INT, run_id STRING, seq INT, stop_uid STRING, eta TIMESTAMP")
TRIPS = _s("ta TIMESTAMP_NTZ, tb TIMESTAMP_NTZ, pickup_lat DOUBLE, pickup_lon DOUBLE, dropoff_lat DOUBLE, dropoff_lon DOUBLE, distance_m DOUBLE, duration_s DOUBLE")
EDGE_METRIC = _s("src BIGINT, dst BIGINT, len_m DOUBLE, met_m DOUBLE, weekday INT, hour INT, round INT")
EDGE_TIME = _s("src BIGINT, dst BIGINT, len_m DOUBLE, dt_s DOUBLE")
HIGHWAY_MATRIX = _s("highway STRING, drivable BOOLEAN, cyclable BOOLEAN, walkable BOOLEAN")
REACH = _s("origin_lat DOUBLE, origin_lon DOUBLE, t0 TIMESTAMP, lat DOUBLE, lon DOUBLE, seconds DOUBLE, pred_lat DOUBLE, pred_lon DOUBLE")

_DDL = {name: value for name, value in list(globals().items()) if isinstance(value, _Schema)}
for _name in _DDL:
    del globals()[_name]


def __getattr__(name: str) -> T.StructType:
    if name not in _DDL:
        raise AttributeError(name)
    return T.StructType.fromDDL(_DDL[name])
