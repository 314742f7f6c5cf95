"""Scalar functions: native Column expressions only (no Python UDFs)."""

from .aqi import (  # noqa: F401
    alert_level,
    alert_message,
    aqi_category,
    aqi_class,
    aqi_score,
    battery_band,
    has_alert,
    health_message,
    health_risk_level,
    joint_label,
    risk_word,
)
from .text import (  # noqa: F401
    canonical_location,
    city_token,
    hashed_id,
    image_path,
    is_weekend,
    iso_utc,
    json_point,
    legacy_alert_id,
    lenient_double,
    lenient_int,
    parse_timestamp,
    ratio_score,
    sensor_type,
    text_to_number,
    time_band,
)
