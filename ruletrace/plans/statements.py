"""The sentences candidates are worded in, and the probes' own constants.

Slots in braces are filled with columns of the finding.
"""

OVERLAP_SOMETIMES = (
    "A {kind} is sometimes booked on two jobs whose times overlap. This happened {pairs} times "
    "across {resources} of them. Is the overlap allowed, or are these mistakes?")
OVERLAP_NEVER = (
    "A {kind} is never booked on two jobs whose times overlap. Across {assignments} assignments "
    "there is not one exception. Is that a rule?")
FLOOR_HARD = (
    "After a {kind} finishes a job, at least {edge} minutes always passes before it starts the "
    "next one. Across {pairs} consecutive pairs there is not one exception. Is {edge} minutes a "
    "required turnaround?")
FLOOR_SOFT = (
    "After a {kind} finishes a job, at least {edge} minutes almost always passes before it starts "
    "the next one: {kept} of {pairs} consecutive pairs. The {below} exception(s) go as low as "
    "{least} minutes. Is {edge} minutes a required turnaround that got broken those times, or is "
    "there no minimum?")
CEILING_CLIFF = (
    "The number of {phrase} never goes above {top}. It reaches {top} {at_max} times out of "
    "{observations} and never once goes higher. Is {top} a limit somebody set?")
CEILING_TAPER = (
    "The number of {phrase} tops out at {top}, but only {at_max} times out of {observations}, and "
    "the numbers just below it thin out gradually. Is {top} a limit, or just the busiest it ever "
    "got?")
DEPENDENCY = (
    "When {partition} is {high}, {field} is filled in almost every time ({high_filled} of "
    "{high_rows}). When it is {low}, it is almost never filled in ({low_filled} of {low_rows}). Is "
    "{field} required for one and not the other?")
EXEMPTION = (
    "{field} is essentially never filled in when {partition} is {low} ({low_filled} of "
    "{low_rows}), though it is filled in elsewhere. Is that case exempt from needing {field}?")
OVERRIDE = (
    "Somebody went back and changed {field} on {entities} {table} records, {events} times in all, "
    "after it had already been set.{when} What is the system getting wrong that keeps needing "
    "this?")
OVERRIDE_WHEN = (
    " Typically {median} day(s) before the job, and {late} of them on the day or after.")

GAP_BIN_MINUTES = 5
GAP_TAIL = 0.01
GAP_HEAD_BINS = 24
OVERLAP_EXAMPLES = 10
CLIFF_RATIO = 0.5
HIGH_FILL = 0.95
LOW_FILL = 0.05
OVERREPRESENTED_TIMES = 2
OVERREPRESENTED_SHARE = 0.5

CEILING_PHRASES = {
    "customers_per_work": "guests on one job",
    "resources_per_work": "resources assigned to one job",
    "work_per_day": "jobs on one day",
    "work_per_resource_per_day": "jobs for one resource on one day",
    "work_per_location_per_day": "jobs at one location on one day",
}
FILL_FIELDS = ("work_type", "start_ts", "end_ts", "location_id", "status", "customer_count")
FILL_PARTITIONS = ("work_type", "location_id", "status")
