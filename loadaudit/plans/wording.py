"""Rule ids, rule texts, thresholds and sentence patterns. They are
part of the result, so they are stated once, here."""

HARD, SOFT = "hard", "soft"
HOLD, REVIEW, VERIFIED = "HOLD", "REVIEW", "VERIFIED"
RED, AMBER, GREEN = "RED", "AMBER", "GREEN"

RATE_PER_TONNE = 1800
SILT_DENSITY = 1.4
HEADROOM = 1.2
SOFT_BAND_M = 60.0
BUFFER_M = 30.0
SPEED_LIMIT_KMH = 40.0
SLIP_TOLERANCE_MIN = 10.0
GAP_LIMIT_S = 180.0
REUSE_MAX_BITS = 12

RULE_TEXT = {
    "R1": "Photo GPS must fall inside the drain's 30 m geofence",
    "R2": "Photo must have been taken inside the bill's work window",
    "R3": "Photo must not be a reused copy of another photo on this bill",
    "R4": "After-photo must show a cleared drain, and the load must be silt",
    "R5": "GPS trace must enter the approved dump site",
    "R6": "Consecutive trips by one truck must be physically possible",
    "R7": "Slip net weight must not exceed the truck's capacity",
    "R8": "Slip time-in must match the GPS arrival at the dump site",
    "R9": "Slip vehicle number must match the trip's truck",
    "R10": "Drain total must fit the section's length, width and depth",
    "GPS_GAP": "GPS trace must not go dark for more than three minutes",
    "SLIP_MISSING": "A weighbridge slip must exist for the trip",
    "TRACE_MISSING": "A GPS trace must exist for the trip",
    "PHOTOS_MISSING": "The drain must have photo evidence",
    "EVIDENCE_ERROR": "Evidence must have been read successfully",
}

# Weightiest reason first.
REASON_ORDER = [
    "R3", "R5", "R8", "R4", "R7", "R6", "R9", "R2", "R1", "R10",
    "GPS_GAP", "SLIP_MISSING", "TRACE_MISSING", "PHOTOS_MISSING", "EVIDENCE_ERROR",
]
ROUTE_RULES = ["R5", "R6", "GPS_GAP", "TRACE_MISSING"]
SLIP_RULES = ["R7", "R8", "R9", "SLIP_MISSING"]
PHOTO_RULES = ["R1", "R2", "R3", "R4", "PHOTOS_MISSING"]

# Sentences with %s for each measured value.
SAY = {
    "photos_missing": "No photo evidence was ingested for this drain.",
    "photo_error": "%s could not be read during ingestion.",
    "r1_no_gps": "%s carries no GPS, so its location cannot be checked.",
    "r1_far": "%s was taken %s m from the drain, well outside its 30 m geofence.",
    "r1_near": "%s was taken %s m outside the geofence, within the margin of a consumer GPS fix.",
    "r2_undated": "%s has no timestamp, so it cannot be dated.",
    "r2_outside": "%s was taken on %s, outside the bill's work window.",
    "r3_reused": "%s is the same image as %s, already submitted for drain %s.",
    "r4_unassessed": "%s could not be assessed by the vision model.",
    "r4_debris": "The load in %s is construction debris, not drain silt.",
    "r4_unclear": "The load in %s could not be identified.",
    "r4_not_cleared": "%s is an after-photo, but the channel does not look cleared.",
    "trace_error": "The GPS trace could not be read during ingestion.",
    "trace_missing": "No GPS trace was ingested for this trip.",
    "trace_unreadable": "The GPS trace was ingested but could not be read back, so the route cannot be checked.",
    "r5_never": "The truck's GPS trace never enters the approved dump site.",
    "gap": "The GPS trace goes dark for %s minutes.",
    "r6_overlap": "The same truck is logged on trip %s at the same time, %s km away.",
    "r6_speed": "The same truck is logged on trip %s %s minutes and %s km away, which needs %s km/h.",
    "slip_missing": "No weighbridge slip was ingested for this trip.",
    "slip_error": "The weighbridge slip could not be read.",
    "r7_unread": "The slip's net weight could not be read.",
    "r7_over": "The slip claims %s t on a truck rated %s t.",
    "r8_unread": "The slip's time-in could not be read.",
    "r8_no_arrival": "There is no GPS arrival to compare the slip's time-in against.",
    "r8_entered": "The slip records time-in at %s, %s minutes %s the truck's GPS reached the dump site at %s.",
    "r8_start": "The slip records time-in at %s",
    "r8_lead": ", %s minutes before the truck left the drain at %s",
    "r8_last_fix": ". The GPS trace never reaches the dump site; its last fix, at %s, is %s minutes %s the slip's time-in.",
    "r9_unread": "The slip's vehicle number could not be read.",
    "r9_differs": "The slip is for %s, but the trip is logged to %s.",
    "r10_over": "The drain claims %s t, more than the %s t its length, width and depth allow.",
}
