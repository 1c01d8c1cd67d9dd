"""Table layouts. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

#: Counter pages and feeds number their circuits 9 to 16.
FEED_CIRCUITS = range(9, 17)
CIRCUITS = range(1, 9)


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


COUNTER_FEED = _struct(
    ("id", LongType()),
    ("ts", StringType()),
    *[(f"circuit{n}_cumul", StringType()) for n in FEED_CIRCUITS],
    *[(f"circuit{n}_curr", StringType()) for n in FEED_CIRCUITS],
)

COUNTER_RAW = _struct(
    ("ts", TimestampType()),
    *[(f"circuit{n}_cumul", LongType()) for n in FEED_CIRCUITS],
    *[(f"circuit{n}_curr", LongType()) for n in FEED_CIRCUITS],
)

COUNTER_DAILY = _struct(
    ("ts", StringType()),
    *[(f"circuit{n}_cumul", StringType()) for n in FEED_CIRCUITS],
)

_POWER_TRIPLES = [
    (f"{name}_{part}", LongType())
    for name in [*(f"c{n}" for n in CIRCUITS), "all"]
    for part in ("use", "cumul", "peak")
]

POWER_STATS = _struct(
    ("groupNanoTs", LongType()),
    *_POWER_TRIPLES,
    ("measures_count", LongType()),
    ("deltaNanoTs", LongType()),
    ("groupTimestamp", TimestampType()),
    ("rowCreatedTimestamp", TimestampType()),
)

WATER_STATS = _struct(
    ("groupNanoTs", LongType()),
    *[
        (f"c{n}_{part}", kind)
        for n in CIRCUITS
        for part, kind in (
            ("indirect", BooleanType()),
            ("delta", LongType()),
            ("cumul", LongType()),
            ("peak", LongType()),
        )
    ],
    ("measures_count", LongType()),
    ("deltaNanoTs", LongType()),
    ("groupTimestamp", TimestampType()),
    ("rowCreatedTimestamp", TimestampType()),
)

#: Record id -> (measure, how its text value is read).
#: scaled: factor x value, truncated; litres: also x 1000; plain: value, truncated;
#: degrees: factor x value as a real number; text: as it is.
MEASURES = {
    1: ("heatingEnergy", "scaled"),
    2: ("coolingEnergy", "scaled"),
    3: ("energyM3T1", "plain"),
    4: ("energyM3T2", "plain"),
    5: ("volume", "litres"),
    6: ("hourCounter", "plain"),
    7: ("errorHourCounter", "plain"),
    8: ("temp1", "degrees"),
    9: ("temp2", "degrees"),
    10: ("deltaT1T2", "degrees"),
    11: ("power", "scaled"),
    12: ("powerMax", "scaled"),
    13: ("flow", "litres"),
    14: ("flowMax", "litres"),
    15: ("errorFlags", "text"),
    16: ("timePoint", "text"),
    17: ("targetHeatingEnergy", "scaled"),
    18: ("targetCoolingEnergy", "scaled"),
    19: ("targetEnergyM3T1", "plain"),
    20: ("targetEnergyM3T2", "plain"),
    21: ("targetVolume", "litres"),
    22: ("targetPowerMax", "scaled"),
    23: ("targetFlowMax", "scaled"),
    24: ("targetTimepoint", "text"),
}

_MEASURE_TYPES = {"scaled": LongType(), "plain": LongType(), "litres": LongType(), "degrees": DoubleType(), "text": StringType()}

METER_FEED = _struct(
    ("rowId", LongType()),
    ("accessNumber", LongType()),
    ("address", LongType()),
    ("id", StringType()),
    ("recordTimestampRaw", StringType()),
    ("recordTimestamp", StringType()),
    *[(name, _MEASURE_TYPES[kind]) for name, kind in MEASURES.values()],
    ("rowCreatedTimestamp", StringType()),
)

DEVICE = _struct(
    ("address", LongType()),
    ("id", StringType()),
    ("manufacturer", StringType()),
    ("version", LongType()),
    ("productName", StringType()),
    ("medium", StringType()),
    ("accessNumber", LongType()),
    ("signature", StringType()),
    ("lastStatus", StringType()),
    ("rowCreatedTimestamp", TimestampType()),
    ("rowUpdatedTimestamp", TimestampType()),
)

DEVICE_RECORD = _struct(
    ("address", LongType()),
    ("id", StringType()),
    ("accessNumber", LongType()),
    ("recordId", IntegerType()),
    ("recordFrame", StringType()),
    ("recordFunction", StringType()),
    ("recordStorageNumber", IntegerType()),
    ("recordTariff", StringType()),
    ("recordDevice", StringType()),
    ("recordUnit", StringType()),
    ("recordValue", StringType()),
    ("recordTimestampRaw", StringType()),
    ("recordTimestamp", TimestampType()),
)

#: One reply of a meter on the bus; attributes of an element start with "_".
METER_REPLY = _struct(
    (
        "SlaveInformation",
        _struct(
            ("Id", StringType()),
            ("Manufacturer", StringType()),
            ("Version", StringType()),
            ("ProductName", StringType()),
            ("Medium", StringType()),
            ("AccessNumber", StringType()),
            ("Status", StringType()),
            ("Signature", StringType()),
        ),
    ),
    (
        "DataRecord",
        ArrayType(
            _struct(
                ("_id", StringType()),
                ("_frame", StringType()),
                ("Function", StringType()),
                ("StorageNumber", StringType()),
                ("Tariff", StringType()),
                ("Device", StringType()),
                ("Unit", StringType()),
                ("Value", StringType()),
                ("Timestamp", StringType()),
            )
        ),
    ),
)

CLIMATE_EVENT = _struct(
    ("eventTimestamp", TimestampType()),
    ("sourceType", StringType()),
    ("sourceId", StringType()),
    ("eventType", StringType()),
    ("value", DecimalType(14, 3)),
    ("locationType", StringType()),
    ("rowTimestamp", TimestampType()),
)

CLIMATE_DAY = _struct(
    ("sourceType", StringType()),
    ("sourceId", StringType()),
    ("eventType", StringType()),
    ("eventGroupTimestamp", StringType()),
    ("aggregationTimezone", StringType()),
    ("minvalue", DecimalType(14, 3)),
    ("avgvalue", DecimalType(18, 7)),
    ("maxvalue", DecimalType(14, 3)),
    ("eventCount", LongType()),
    ("locationType", StringType()),
)

CLIMATE_DEVICE = _struct(
    ("sourceType", StringType()),
    ("sourceId", StringType()),
    ("locationType", StringType()),
    ("name", StringType()),
)

DAY_FILE = _struct(
    ("Timestamp", LongType()),
    ("ts", StringType()),
    ("value", DoubleType()),
    ("Humidity", IntegerType()),
)

ROUTING = _struct(("device", StringType()), ("datatype", StringType()), ("dataset", StringType()))
