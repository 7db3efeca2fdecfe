"""Declared schemas of the evidence tables."""

from .functions.geo import GEOMETRY_DDL, LINE_DDL, POINT_DDL

VISION_DDL = "struct<ok:boolean,cleared:boolean,load_type:string,confidence:double,notes:string>"

BILLS = (
    "bill_id string, contractor string, ward string, rate_per_tonne decimal(18,3), claimed_tonnes decimal(18,3), "
    "window_start string, window_end string, status string, site_id string"
)
DRAINS = (
    "bill_id string, drain_id string, name string, length_m double, width_m double, depth_m double, "
    f"plausible_max_tonnes double, geofence {GEOMETRY_DDL}, centreline {LINE_DDL}, decision string, note string"
)
TRIPS = (
    "bill_id string, drain_id string, trip_no string, trip_id string, vehicle_no string, "
    "claimed_tonnes decimal(18,3), slip_key string, trace_key string, start_time string, arrival_time string"
)
VEHICLES = "vehicle_no string, capacity_tonnes double"
SITES = f"site_id string, name string, geofence {GEOMETRY_DDL}, center {POINT_DDL}"
PHOTOS = (
    "bill_id string, drain_id string, s3_key string, role string, status string, error string, has_gps boolean, "
    f"lat double, lon double, timestamp string, p_hash string, problems array<string>, vision {VISION_DDL}"
)
SLIPS = (
    "s3_key string, status string, error string, ticket_no string, vehicle_no string, gross double, tare double, "
    "net double, time_in string, time_out string, site string, missing_fields array<string>"
)
TRACE_ITEMS = "s3_key string, status string, error string, point_count bigint"
POINTS = "bill_id string, trace_key string, seq bigint, lat double, lon double, t string"

# ---- case mode
DRAIN_LOCATION_DDL = (
    f"struct<point:{POINT_DDL},line:{LINE_DDL},tolerance_m:double,source:string,derived_from_photos:boolean,"
    "name:string,length_m:double,width_m:double,depth_m:double>"
)
DISPOSAL_SITE_DDL = f"struct<point:{POINT_DDL},radius_m:double,polygon:{LINE_DDL},name:string>"
CLAIM_DDL = (
    "struct<quantity_tonnes:double,rate_per_tonne:double,amount_rupees:double,contractor:string,reference:string>"
)
WINDOW_DDL = "struct<start:string,end:string>"
TRUCK_DDL = "struct<vehicle_no:string,capacity_tonnes:double>"
CASES = (
    f"case_id string, drain {DRAIN_LOCATION_DDL}, site {DISPOSAL_SITE_DDL}, claim {CLAIM_DDL}, "
    f"window {WINDOW_DDL}, truck {TRUCK_DDL}"
)
CASE_PHOTOS = (
    "case_id string, evidence_id string, filename string, role string, pos int, has_gps boolean, lon double, "
    "lat double, timestamp string, timestamp_has_offset boolean, gps_accuracy_m double, p_hash string, "
    "vision struct<ran:boolean,ok:boolean,cleared:boolean,confidence:double,mocked:boolean,skipped_reason:string>"
)
CASE_SLIPS = (
    "case_id string, evidence_id string, filename string, pos int, net double, gross double, tare double, "
    "time_in string, vehicle_no string, net_derived boolean, mocked boolean"
)
CASE_TRACES = "case_id string, evidence_id string, filename string, pos int, vehicle_no string"
CASE_POINTS = "case_id string, evidence_id string, seq bigint, lon double, lat double, t string"
