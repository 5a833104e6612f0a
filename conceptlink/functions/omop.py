"""Clinical records extracted from text: schemas, constraints and their violations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.DateType(), "time": T.TimestampNTZType()}


@dataclass(frozen=True)
class RecordModel:
    """Fields by name with kind and longest length, ordered pairs, lower bounds and required fields."""

    name: str
    fields: dict[str, tuple[str, int | None]]
    ordered: tuple[tuple[str, str], ...]
    at_least: dict[str, int] = field(default_factory=dict)
    strict: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _KINDS[k], n not in self.required) for n, (k, _) in self.fields.items()])

    def extended(self, name: str, more: dict[str, tuple[str, int | None]], required: tuple[str, ...]) -> RecordModel:
        return RecordModel(name, {**more, **self.fields}, self.ordered, self.at_least, self.strict, required)


def _s(n: int | None = None) -> tuple[str, int | None]:
    return ("str", n)


INT, FLOAT, DATE, TIME = ("int", None), ("float", None), ("date", None), ("time", None)

# The fields of the three OMOP tables that text can tell, and their limits.
CONDITION = RecordModel(
    "condition_occurrence",
    {
        "condition_source_value": _s(50), "condition_source_concept_id": INT, "condition_start_date": DATE, "condition_start_datetime": TIME,
        "condition_end_date": DATE, "condition_end_datetime": TIME, "condition_status_source_value": _s(50), "stop_reason": _s(20),
    },
    (("condition_start_date", "condition_end_date"), ("condition_start_datetime", "condition_end_datetime")),
)
DRUG = RecordModel(
    "drug_exposure",
    {
        "drug_source_value": _s(50), "drug_source_concept_id": INT, "drug_exposure_start_date": DATE, "drug_exposure_start_datetime": TIME,
        "drug_exposure_end_date": DATE, "drug_exposure_end_datetime": TIME, "verbatim_end_date": DATE, "stop_reason": _s(20), "refills": INT,
        "quantity": FLOAT, "days_supply": INT, "sig": _s(), "lot_number": _s(50), "route_source_value": _s(50), "dose_unit_source_value": _s(50),
    },
    (("drug_exposure_start_date", "drug_exposure_end_date"), ("drug_exposure_start_datetime", "drug_exposure_end_datetime")),
    {"quantity": 0, "days_supply": 1},
    ("days_supply",),
)
DEVICE = RecordModel(
    "device_exposure",
    {
        "device_source_value": _s(50), "device_source_concept_id": INT, "device_exposure_start_date": DATE, "device_exposure_start_datetime": TIME,
        "device_exposure_end_date": DATE, "device_exposure_end_datetime": TIME, "unique_device_id": _s(255), "production_id": _s(255),
        "quantity": INT, "unit_source_value": _s(50), "unit_source_concept_id": INT,
    },
    (("device_exposure_start_date", "device_exposure_end_date"), ("device_exposure_start_datetime", "device_exposure_end_datetime")),
    {"quantity": 0},
)
_VISIT = {"provider_id": INT, "visit_occurrence_id": INT, "visit_detail_id": INT}
FULL_CONDITION = CONDITION.extended(
    "condition_occurrence_row",
    {"condition_occurrence_id": INT, "person_id": INT, "condition_concept_id": INT, "condition_type_concept_id": INT, "condition_status_concept_id": INT} | _VISIT,
    ("condition_occurrence_id", "person_id", "condition_concept_id", "condition_start_date", "condition_type_concept_id"),
)
FULL_DRUG = DRUG.extended(
    "drug_exposure_row",
    {"drug_exposure_id": INT, "person_id": INT, "drug_concept_id": INT, "drug_type_concept_id": INT, "route_concept_id": INT} | _VISIT,
    ("drug_exposure_id", "person_id", "drug_concept_id", "drug_type_concept_id"),
)
FULL_DEVICE = DEVICE.extended(
    "device_exposure_row",
    {"device_exposure_id": INT, "person_id": INT, "device_concept_id": INT, "device_type_concept_id": INT, "unit_concept_id": INT} | _VISIT,
    ("device_exposure_id", "person_id", "device_concept_id", "device_type_concept_id"),
)

MODELS: dict[str, RecordModel] = {}
LIST_SUFFIX = "_list"


def register_model(model: RecordModel) -> RecordModel:
    if model.name in MODELS:
        raise ValueError(f"a model named {model.name} is there already")
    MODELS[model.name] = model
    return model


for _m in (CONDITION, DRUG, DEVICE, FULL_CONDITION, FULL_DRUG, FULL_DEVICE):
    register_model(_m)


def model_of(name: str | RecordModel) -> tuple[RecordModel, bool]:
    """A model by id and whether the id asks for a list of records."""
    if isinstance(name, RecordModel):
        return name, False
    many = name.endswith(LIST_SUFFIX)
    base = name.removesuffix(LIST_SUFFIX)
    if base not in MODELS:
        raise ValueError(f"unknown model {name}; known are {sorted([*MODELS, *(m + LIST_SUFFIX for m in MODELS)])}")
    return MODELS[base], many


def raw_fields(json: Column, model: RecordModel) -> Column:
    """Every field as the JSON text it has, so that missing, null and malformed can be told apart."""
    return F.from_json(json, T.MapType(T.StringType(), T.StringType()))


def _parsed(raw: Column, kind: str) -> Column:
    if kind == "str":
        return raw
    if kind == "date":
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    if kind == "time":
        return raw.try_cast("timestamp_ntz")
    if kind == "int":
        return F.when(raw.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_extract(raw, r"^([+-]?\d+)", 1).try_cast("long"))
    return raw.try_cast("double")


def violations(json: Column, model: RecordModel, raw: Column, parsed: Column) -> Column:
    """What is wrong with a record given as JSON text, as an array of short texts; empty if nothing is.

    ``raw`` are its fields as they stand (``raw_fields``), ``parsed`` the typed ones (``record``).
    """
    found = [F.when(raw.isNull(), F.lit("not a JSON object"))]
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    found.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, model.fields)))) > 0, F.lit("unknown field")))
    values = {}
    for name, (kind, longest) in model.fields.items():
        text = raw[name]
        values[name] = parsed[name]
        if kind != "str":
            found.append(F.when(text.isNotNull() & values[name].isNull(), F.lit(f"{name}: not a {kind}")))
        if longest:
            found.append(F.when(F.char_length(text) > longest, F.lit(f"{name}: longer than {longest}")))
        if name in model.strict:
            quoted = F.get_json_object(json, f"$.{name}").isNotNull() & ~json.rlike(rf'"{name}"\s*:\s*[+-]?\d+\s*[,}}]')
            found.append(F.when(quoted, F.lit(f"{name}: not a plain integer")))
        if name in model.required:
            found.append(F.when(text.isNull(), F.lit(f"{name}: missing")))
    for start, end in model.ordered:
        found.append(F.when(values[end] < values[start], F.lit(f"{end}: before {start}")))
    for name, least in model.at_least.items():
        found.append(F.when(values[name] < least, F.lit(f"{name}: below {least}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def record(raw: Column, model: RecordModel) -> Column:
    """The typed record of raw fields; those that cannot be read are null."""
    return F.struct(*(_parsed(raw[n], k).cast(_KINDS[k]).alias(n) for n, (k, _) in model.fields.items()))


def validated(df: DataFrame, json_col: str, model: str | RecordModel) -> DataFrame:
    """Rows with ``record`` and ``violations``; for a list model one row per record of {"records": [...]}."""
    found, many = model_of(model)
    if many:
        each = F.from_json(F.get_json_object(json_col, "$.records"), "array<string>")
        df = df.withColumn("_json", F.explode_outer(each))
    else:
        df = df.withColumn("_json", F.col(json_col))
    # each step is a projection of its own, so that the text is parsed once
    df = df.withColumn("_raw", raw_fields(F.col("_json"), found)).withColumn("record", record(F.col("_raw"), found))
    return df.withColumn("violations", violations(F.col("_json"), found, F.col("_raw"), F.col("record"))).drop("_json", "_raw")
