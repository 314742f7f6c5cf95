"""Thresholds, labels and messages shared by every operator.

Everything in the FIXED VALUES block must stay equal to the behaviour being
reproduced (band edges, label texts, alert texts); change nothing there
without a matching change in the oracle SQL.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# AQI piecewise-linear bands: (upper bound of band, conc_lo, conc_hi, aqi_lo, aqi_hi).
# The last band has no upper bound and extrapolates above 500.
PM25_BANDS = [
    (12.0, 0.0, 12.0, 0.0, 50.0),
    (35.4, 12.1, 35.4, 51.0, 100.0),
    (55.4, 35.5, 55.4, 101.0, 150.0),
    (150.4, 55.5, 150.4, 151.0, 200.0),
    (250.4, 150.5, 250.4, 201.0, 300.0),
    (None, 250.5, 500.4, 301.0, 500.0),
]
PM10_BANDS = [
    (54.0, 0.0, 54.0, 0.0, 50.0),
    (154.0, 55.0, 154.0, 51.0, 100.0),
    (254.0, 155.0, 254.0, 101.0, 150.0),
    (354.0, 255.0, 354.0, 151.0, 200.0),
    (424.0, 355.0, 424.0, 201.0, 300.0),
    (None, 425.0, 604.0, 301.0, 500.0),
]

# AQI category, upper-inclusive: (aqi <= bound) -> label; above the last bound -> "Hazardous".
AQI_CATEGORIES = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
]
AQI_CATEGORY_TOP = "Hazardous"

# Health message per AQI category.
HEALTH_MESSAGES = {
    "Good": "Air quality is satisfactory",
    "Moderate": "Some pollutants may be a concern for sensitive groups",
    "Unhealthy for Sensitive Groups": "Sensitive groups may experience health effects",
    "Unhealthy": "Everyone may begin to experience health effects",
    "Very Unhealthy": "Health warnings of emergency conditions",
    "Hazardous": "Health alert: everyone may experience serious health effects",
}

# Alert level, lower-inclusive: (aqi >= bound) -> label, else "Good".
ALERT_LEVELS_6 = [
    (300, "Hazardous"),
    (200, "Very Unhealthy"),
    (150, "Unhealthy"),
    (100, "Unhealthy for Sensitive Groups"),
    (50, "Moderate"),
]
ALERT_LEVELS_5 = [
    (200, "Very Unhealthy"),
    (150, "Unhealthy"),
    (100, "Unhealthy for Sensitive Groups"),
    (50, "Moderate"),
]
ALERT_LEVEL_BOTTOM = "Good"

# Alert message, lower-inclusive, no tier at 50.
ALERT_MESSAGES = [
    (300, "Hazardous air quality! Avoid outdoor activities!"),
    (200, "Very unhealthy air quality! Limit outdoor activities!"),
    (150, "Unhealthy air quality! Sensitive groups should avoid outdoor activities!"),
    (100, "Moderate air quality. Sensitive groups may experience minor health effects."),
]
ALERT_MESSAGE_BOTTOM = "Good air quality. No health concerns."

HAS_ALERT_AQI = 100

# Health risk level, lower-inclusive.
HEALTH_RISK_LEVELS = [
    (200, "High Risk"),
    (100, "Moderate Risk"),
    (50, "Low Risk"),
]
HEALTH_RISK_BOTTOM = "No Risk"

# Joint categorical AQI: first tier where pm2_5 <= a AND pm10 <= b.
JOINT_LABELS = [
    (12.0, 54.0, "Good"),
    (35.4, 154.0, "Moderate"),
    (55.4, 254.0, "Unhealthy for Sensitive Groups"),
    (150.4, 354.0, "Unhealthy"),
    (250.4, 424.0, "Very Unhealthy"),
]
JOINT_LABEL_TOP = "Hazardous"

# Risk word per categorical label; unknown label -> "Unknown".
RISK_WORDS = {
    "Good": "Low",
    "Moderate": "Low",
    "Unhealthy for Sensitive Groups": "Medium",
    "Unhealthy": "High",
    "Very Unhealthy": "Very High",
    "Hazardous": "Extreme",
}

# Colour classes, upper-inclusive.
AQI_CLASSES_6 = [
    (50, "aqi-good"),
    (100, "aqi-moderate"),
    (150, "aqi-unhealthy-sensitive"),
    (200, "aqi-unhealthy"),
    (300, "aqi-very-unhealthy"),
]
AQI_CLASS_6_TOP = "aqi-hazardous"
AQI_CLASSES_4 = [
    (50, "aqi-good"),
    (100, "aqi-moderate"),
    (150, "aqi-unhealthy"),
]
AQI_CLASS_4_TOP = "aqi-hazardous"

# Battery band, lower-inclusive.
BATTERY_BANDS = [(70, "battery-high"), (30, "battery-medium")]
BATTERY_BAND_BOTTOM = "battery-low"

# Sensor type and canonical place by substring, first match wins.
# (substring, also match area_type, type, location name)
SENSOR_TYPES = [
    ("urban", True, "Urban", "City Center"),
    ("industrial", True, "Industrial", "Factory Zone"),
    ("residential", True, "Residential", "Suburban Area"),
    ("bus", False, "Mobile", "City Bus Route"),
    ("wearable", False, "Wearable", "Cyclist / Pedestrian"),
    ("drone", False, "Drone", "Aerial / City Monitoring"),
]
UNKNOWN = "Unknown"
IMAGE_PATH_PREFIX = "/images/sensor_"
IMAGE_PATH_SUFFIX = ".png"

# Validation (streaming job): hard validity and outlier limits.
PM_MIN = 0.0
AQI_MIN, AQI_MAX = 0, 500
TEMP_MIN, TEMP_MAX = -50.0, 60.0
HUM_MIN, HUM_MAX = 0.0, 100.0
OUTLIER_PM25_MAX = 200.0
OUTLIER_PM10_MAX = 300.0
OUTLIER_TEMP_MIN, OUTLIER_TEMP_MAX = -20.0, 50.0
OUTLIER_HUM_MIN, OUTLIER_HUM_MAX = 5.0, 95.0

# Validation error texts, in output order: (rule id, message).
VALIDATION_MESSAGES = [
    ("pm25_null", "PM2.5 missing"),
    ("pm10_null", "PM10 missing"),
    ("aqi_null", "AQI missing"),
    ("pm25_neg", "PM2.5 negative"),
    ("pm10_neg", "PM10 negative"),
    ("aqi_neg", "AQI negative"),
    ("aqi_high", "AQI too high"),
    ("temp_null", "Temperature missing"),
    ("hum_null", "Humidity missing"),
    ("temp_low", "Temperature too low"),
    ("temp_high", "Temperature too high"),
    ("hum_neg", "Humidity negative"),
    ("hum_high", "Humidity too high"),
]

# First-error validation (per-record processors).
FIRST_ERROR_REQUIRED = ["sensor_id", "timestamp", "pm2_5", "pm10", "aqi"]
FIRST_ERROR_PM25_MAX = 200.0
FIRST_ERROR_PM10_MAX = 300.0
FIRST_ERROR_VALID = "Valid"

# Ratio anomaly threshold.
RATIO_ANOMALY_THRESHOLD = 0.5
SIGMA_FACTOR = 2.0

# Pollution alerts: (severity, alert_type, message prefix, pm2_5 >, pm10 >), first match wins.
POLLUTION_TIERS = [
    ("HIGH", "POOR_AIR_QUALITY", "Poor air quality detected", 55.4, 254.0),
    ("MEDIUM", "MODERATE_AIR_QUALITY", "Moderate air quality", 35.4, 154.0),
    ("LOW", "MILD_AIR_QUALITY", "Slightly elevated levels", 12.0, 54.0),
]
ALERT_DEFAULT_SEVERITY = "MEDIUM"
ALERT_DEFAULT_AQI_LEVEL = "Unknown"

# Device alerts.
DEVICE_AQI_ALERT = 100
DEVICE_AQI_CRITICAL = 150
DEVICE_BATTERY_LOW = 30
DEVICE_SIGNAL_WEAK = 40

# Time-of-day bands.
RUSH_HOURS = [(7, 9), (17, 19)]
NIGHT_FROM, NIGHT_TO = 22, 6

# Topic -> table routing.
TOPIC_TABLES = {
    "air-quality-data": "air_quality_data",
    "smart-sensor-data": "smart_virtual_sensors",
    "smart-sensor-alerts": "smart_sensor_alerts",
    "smart-sensor-stats": "smart_sensor_stats",
    "air-quality-alerts": "air_quality_alerts",
}

PROCESSING_VERSION = "enhanced_spark_streaming"
ANALYTICS_TREND = "stable"
NO_DATA_ERROR = "No data available for this sensor in the requested period"
INSUFFICIENT_DATA_ERROR = "Insufficient data for analysis"

# Defaults of the API routes.
RECENT_DEFAULT_LIMIT = 20
ALERTS_DEFAULT_LIMIT = 10
LOOKBACK_DEFAULT_HOURS = 24
KEEP_LAST_PER_SENSOR = 100
KEEP_LAST_OVERALL = 1000
LAST_N_ROWS = 10
DIGEST_TOP_HIGH = 3
DIGEST_COOLDOWN_MINUTES = 30

# ---------------------------------------------------------------------------
# Tunables (not behaviour): window frames and skew-safe bucketing
# ---------------------------------------------------------------------------
MICROS_PER_MINUTE = 60_000_000
TRAILING_MINUTES = (5, 15, 60)
