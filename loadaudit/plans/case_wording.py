"""Fixed values of case mode: statuses, titles, tolerances and sentence patterns."""

PASS, CONSISTENT, REVIEW, FAIL = "PASS", "CONSISTENT", "REVIEW", "FAIL"
INCONCLUSIVE, NOT_EVALUATED = "INCONCLUSIVE", "NOT_EVALUATED"
STATUSES = [PASS, CONSISTENT, REVIEW, FAIL, INCONCLUSIVE, NOT_EVALUATED]

TITLES = {
    "R1": "Photo GPS against the drain location",
    "R2": "Photo taken inside the work window",
    "R3": "Photo not reused within this trial",
    "R4": "After-photo shows a cleared channel",
    "R5": "GPS trace enters the designated disposal site",
    "R6": "Consecutive trips of one truck are physically possible",
    "R7": "Slip net weight within the truck's capacity",
    "R8": "Slip time-in matches the GPS arrival",
    "R9": "Slip vehicle matches the trip's truck",
    "R10": "Claimed quantity fits the drain's volume",
    "GPS_GAP": "GPS trace does not go dark for more than three minutes",
    "T1": "Claim arithmetic: quantity × rate = amount",
    "T2": "Slip arithmetic: gross − tare = net",
    "T3": "Slips account for the claimed quantity",
}

MARGIN_M = 30.0
TOLERANCE_M = 30.0
T1_RUPEES, T1_FRACTION = 1.0, 0.005
T2_TONNES = 0.05
T3_FRACTION = 0.98

SECTIONS = {
    "problems": "Findings against the claim",
    "clear": "Checks with nothing against the claim",
    "inconclusive": "Inconclusive",
    "missing": "Not evaluated — insufficient evidence",
}

SAY = {
    "insufficient": "Not evaluated: insufficient evidence.",
    "r1_far": "%s was taken %s m from the supplied drain %s, beyond its %s m tolerance and the %s m margin.",
    "r1_near": "%s was taken %s m from the supplied drain %s, %s m outside its %s m tolerance: within the margin of a "
    "consumer GPS fix, so a person should look.",
    "r1_circular": "%s is %s m from the drain %s, but that %s was drawn from these same photographs, so the comparison "
    "is circular and proves nothing.",
    "r1_vague": "%s is %s m from the drain %s, but the phone reports a GPS accuracy of %s m, wider than the %s m tolerance.",
    "r1_inside": "%s is %s m from the supplied drain %s, inside its %s m tolerance. The location was supplied for this "
    "trial and is not an official drain map, so this is consistency, not proof.%s",
    "r1_accuracy": " The phone reports %s m accuracy.",
    "r1_no_accuracy": " The photo does not record its GPS accuracy.",
    "r2_unread": "The capture time could not be read as a date.",
    "r2_assumed": " The photo's time carries no timezone, so it was read in the work window's timezone.",
    "r2_outside": "%s was taken at %s %s, outside the work window.%s",
    "r2_inside": "%s was taken at %s %s, inside the work window.%s",
    "r3_same": "%s is the same image as %s (%s of 64 hash bits differ; the threshold is %s).",
    "r3_unlike": "%s does not match any other photo in this trial. Trials are not compared with each other or with Bill B1.",
    "r4_not_run": "Not evaluated: the model did not read this photo.",
    "r4_unusable": "The model's answer for %s did not fit the expected form, so it cannot decide whether the channel is cleared.",
    "r4_not_cleared": "%s is labelled 'after', but the model does not see a cleared channel (confidence %s).",
    "r4_cleared": "The model sees a cleared channel in %s (confidence %s). A model reading is an observation, not proof "
    "that desilting happened.",
    "r5_enters": "The trace enters the designated disposal site at %s. The site was designated for this trial; that does "
    "not make it an authorised landfill.",
    "r5_untimed": "an untimed fix",
    "r5_never": "The trace never enters the designated disposal site. Its last fix is %s km from the site's centre.",
    "gap_few": "The trace has too few timed points.",
    "gap_dark": "The trace goes dark for %s minutes.",
    "gap_fine": "The longest gap between fixes is %s s.",
    "r6_clash": "%s and %s put the same truck %s km apart with only %s minutes between them (limit %s km/h).",
    "r6_fine": "%s does not clash with the truck's other traces.",
    "r7_unread": "The slip's net weight could not be read.",
    "r7_over": "The slip claims %s t on a truck rated %s t.",
    "r7_within": "Net %s t is within the truck's rated %s t.",
    "r8_unread": "The slip's time-in could not be read.",
    "r8_untimed": "There is no timed GPS fix to compare the slip against.",
    "r8_within": "The slip's time-in %s is within %s minutes of the GPS %s at %s.",
    "r9_unread": "The slip's vehicle number could not be read.",
    "r9_differs": "The slip is for %s, but the trip's truck is %s.",
    "r9_same": "The slip and the trip both name %s.",
    "t2_unread": "Gross, tare and net could not all be read, so the slip's arithmetic cannot be checked.",
    "t2_circular": "The net weight was not read from the slip; it was computed as gross − tare, so checking it against "
    "gross − tare would be circular.",
    "t2_differs": "Gross %s t − tare %s t = %s t, but the slip prints net %s t.",
    "t2_same": "Gross %s t − tare %s t matches net %s t.",
    "t1_differs": "%s t × ₹%s/t = ₹%s, but the claim is ₹%s (a difference of ₹%s).",
    "t1_same": "%s t × ₹%s/t = ₹%s, matching the claim.",
    "r10_fits": "%s t is within the %s t that the stated dimensions allow (1.4 t/m³, ×1.2 headroom).",
    "t3_unread": "No slip's net weight could be read.",
    "t3_note": " %s slip(s) had no readable net weight.",
    "t3_covered": "The slips' net weights total %s t against %s t claimed.%s",
    "t3_short": "The slips account for %s t of the %s t claimed (%s%%).%s",
    "mock": "OFFLINE MOCK, no real reading: the rule ran on test-fixture values and would say: %s",
}

NEED = {
    "gps": "GPS coordinates in the photo's EXIF",
    "drain": "a drain location",
    "time": "a capture time in the photo's EXIF",
    "window": "a work window",
    "photo": "a drain photograph",
    "hashes": "at least two photographs with a readable image hash",
    "after": "a photograph labelled 'after'",
    "model": "a model result (%s)",
    "site": "a designated disposal site",
    "trace": "a truck GPS trace",
    "two_traces": "two or more traces for the same truck",
    "capacity": "the truck's rated capacity",
    "paired": "a GPS trace paired with this slip (same vehicle number)",
    "vehicle": "a vehicle number from a trace or the truck details",
    "slip": "a weighbridge slip",
    "quantity": "the claimed quantity",
    "rate": "the claimed rate",
    "amount": "the claimed amount",
    "dimensions": "the drain's length, width and depth",
    "real": "a real Amazon Textract or Bedrock reading (this run used offline mocks)",
}

SUMMARY = {
    "mocked": "OFFLINE MOCK: the photo and slip readings below came from test fixtures, not from Amazon Bedrock or Textract.",
    "counts": "%s checks: %s failed, %s need review, %s passed, %s consistent with an approximate reference, %s inconclusive, "
    "and %s not evaluated for lack of evidence.",
    "problems": "Problems: %s%s",
    "more": " (+%s more)",
    "no_problem": "No check found a problem with the evidence that was supplied.",
    "supplying": "Supplying %s%s would let more checks run.",
    "and_more": " and more",
    "end": "Not evaluated is not passed.",
}
