"""Contracts of the stored tables, as DDL."""

BARS = (
    "ticker string, date date, open double, high double, low double, close double, volume double, provider string, "
    "first_public_at timestamp, recorded_at timestamp, ingest_id string, price_basis string, year int"
)
ACTIONS = "ticker string, ex_date date, kind string, value double, provider string, first_public_at timestamp, recorded_at timestamp, ingest_id string"

# Price bases, and New York times at which bars and actions become public.
SPLIT_ADJUSTED, RAW = "split_adjusted_as_of_recorded_at", "raw"
ZONE, BAR_TIME, ACTION_TIME = "America/New_York", "16:00:00", "09:30:00"
